import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + str((seed * k) % 13) for k in range(n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empties, one very long text, copies, near copies, ties, repeated rows."""
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    long = prose(2, 20_000)
    texts = {
        1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: "   \n\t ", 7: "one two", 8: "ONE two", 9: long, 10: long + " tail", 11: base.upper(), 12: "  " + base + "\n", 13: prose(3, 40),
        14: prose(3, 40) + " " + prose(4, 40), 15: prose(4, 40), 16: "ä ö ü ß é", 17: "x" * 3000, 18: prose(5, 13), 19: "zz " + prose(5, 13) + " yy", 20: "▁ mark  double",
    }
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"src{k % 3}", None) for k, t in texts.items()]
    return [*rows, rows[0], (None, base, None, None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows, with extra columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward_rows(), SCHEMA)
    for name in ("rep", "component", "hits", "words", "digest", "votes", "shard", "band", "keep_id", "_id", "_key", "_hits", "_digest", "score", "ids", "round_trip", "lang_pred", "ambiguous", "gone_id", "GONE_RAW", "gone_key", "raw", "kept", "text_key", "spans", "exact", "decoded"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)

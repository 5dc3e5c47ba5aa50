"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


#: A public vocabulary file; any SentencePiece model with identity normalisation serves.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html import extract

    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    from lodestone.llm.sentencepiece import encode, read_model

    coded = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(spark, tokenizer))
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.langid import fit, predict

    held_out = "crc32(CAST(doc_id AS STRING)) % 3 = 1"
    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, f"NOT coalesce({held_out}, false)")
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    _, scorer = fit(docs)
    return score(docs, scorer).select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import assign

    placed = assign(_table(spark, sf_dir, "documents"), 8)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import fit, score

    held_out = "crc32(CAST(doc_id AS STRING)) % 5 = 0"
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, _table(spark, sf_dir, "labels"), f"NOT coalesce({held_out}, false)")
    scored = score(docs, machine)
    return scored.select("doc_id", F.expr(f"coalesce({held_out}, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), 13, text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.exact import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontam import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 13, 5)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_positions").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


#: A public byte-level vocabulary, whose id 1 ends a document.
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op11_harmonic(spark: SparkSession, sf_dir: str, tokenizer: str = BYTE_TOKENIZER) -> DataFrame:
    from lodestone.llm.packing import pack
    from lodestone.llm.sentencepiece import read_model

    pieces = pack(_table(spark, sf_dir, "documents"), read_model(spark, tokenizer), 2048, end=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by the hash of their id, go on periodically from some word on."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))
    counted = hashed.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    placed = counted.withColumn("a", F.expr("CAST(IF(n > 0, g % n, 0) AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    tail = "flatten(array_repeat(slice(words, a + 1, p), CAST(ceil((n - a) / p) AS INT)))"
    return placed.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN array_join(slice(concat(slice(words, 1, a), {tail}), 1, n), ' ') ELSE text END AS text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.periodic import collapse

    found = collapse(_planted(_table(spark, sf_dir, "documents")), 24, 3, text=False)
    best = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (best, r) -> IF(best IS NULL OR r.length * best.period > best.length * r.period, r, best))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, chr(10))), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.col("kept_sha256").alias("collapsed_sha256"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.negatives import mine

    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), vec_id % 100 == 0, 5, 5, 80, 100, scale=256)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_html": op2_html,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_substring": op8_substring,
    "op9_exact": op9_exact,
    "op10_decontam": op10_decontam,
    "op11_harmonic": op11_harmonic,
    "op12_periodic": op12_periodic,
    "op13_negatives": op13_negatives,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB SQL for those that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM d)
        ), n AS (
            SELECT doc_id, count(k) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
        ), both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e), r AS (
            SELECT doc_id, doc_id AS root FROM n UNION SELECT y, root FROM r JOIN both_ways ON x = doc_id
        )
        SELECT doc_id, n AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r JOIN n USING (doc_id) GROUP BY 1, 2""",
    "op8_substring": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), w AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT *, unnest(generate_series(1, len(ws) - 12)) AS i FROM d)
        ), f AS (
            SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM w
        ), g AS (
            SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM f WHERE first < doc_id) GROUP BY 1
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)""",
    "op9_exact": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op10_decontam": rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS k
            FROM (SELECT *, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM (SELECT *, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0))
        ), dw AS (
            SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS k FROM (SELECT d.*, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM bw))
        ), h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, k)), hits AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS p FROM h) GROUP BY 1
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op13_negatives": r"""
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS alike, CAST(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM e AS a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}

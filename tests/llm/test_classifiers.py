"""What the classifiers are made of, against plain loops and data whose truth is known."""

import itertools
import math
import random

import numpy as np
import pytest

from lodestone.llm import langid, quality, toxicity


def test_codewords_are_decoded_by_their_weighted_loss():
    rng = np.random.default_rng(3)
    for n in (2, 4, 7):
        code = langid.codewords(n)
        bits = code.shape[1]
        assert len({tuple(row) for row in code.tolist()}) == n  # no two languages share a codeword
        model = langid.Model([f"l{k}" for k in range(n)], code, np.zeros((1, bits)), rng.uniform(0.5, 5, bits), rng.uniform(0.1, 1, bits), rng.normal(size=n) * 0.1)
        margins = rng.normal(size=(50, bits))
        best, score, second = model.decode(margins)
        for i, row in enumerate(margins):
            loss = [sum(model.trust[b] * math.log1p(math.exp(-code[k, b] * row[b] * model.slope[b])) for b in range(bits)) - model.prior[k] for k in range(n)]
            weight = [math.exp(-x) for x in loss]
            ranked = sorted((w / sum(weight) for w in weight), reverse=True)
            assert best[i] == loss.index(min(loss)) and abs(score[i] - ranked[0]) < 1e-9 and abs(second[i] - ranked[1]) < 1e-9


def test_one_wrong_bit_is_corrected():
    """Of seven dichotomies of four languages any single one may fail."""
    code = langid.codewords(4)
    model = langid.Model(list("abcd"), code, np.zeros((1, code.shape[1])), np.ones(code.shape[1]), np.ones(code.shape[1]), np.zeros(4))
    for language, bit in itertools.product(range(4), range(code.shape[1])):
        margins = 3.0 * code[language : language + 1].astype(float)
        margins[0, bit] *= -1
        assert model.decode(margins)[0][0] == language


def voters(seed, rows=6000):
    """(votes, good): one fault a bad text, which one voter sees well; all voters err a little and sometimes say nothing."""
    rng = np.random.default_rng(seed)
    n = len(quality.LABELLERS)
    good = rng.random(rows) < 0.7
    fault = rng.integers(0, n, rows)
    says_bad = np.where(good[:, None], 0.04, np.where(fault[:, None] == np.arange(n), 0.95, 0.15))
    votes = np.where(rng.random((rows, n)) < says_bad, 0, 1)
    votes[rng.random((rows, n)) < 0.1] = -1
    return votes, good


def test_estimated_accuracies_are_those_of_the_voters():
    votes, good = voters(5)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts)
    assert abs(model.share[0] - 0.7) < 0.08
    for j, (on_bad, on_good) in enumerate(model.accuracy().values()):
        said = votes[:, j] >= 0
        assert abs(on_good - (votes[said & good, j] == 1).mean()) < 0.05
        assert abs(on_bad - (votes[said & ~good, j] == 0).mean()) < 0.15
    n, cast = votes.shape[1], votes >= 0
    own = lambda p: np.where(cast, np.where(votes == 0, p, 1 - p), 1.0).prod(axis=1)
    bad = np.mean([own(np.where(np.arange(n) == j, 0.95, 0.15)) for j in range(n)], axis=0)
    best = 0.7 * own(np.full(n, 0.04)) > 0.3 * bad  # what one would say who knew all this
    posterior = model.posterior(votes)
    assert ((posterior > 0.5) == good).mean() > (best == good).mean() - 0.03
    clear = (posterior > 0.95) | (posterior < 0.05)
    assert clear.mean() > 0.3 and ((posterior > 0.5) == good)[clear].mean() > 0.93


def test_expectation_maximisation_never_falls():
    """The log likelihood with its priors rises with each round."""
    votes, _ = voters(8, 1500)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    n, total = votes.shape[1], counts.sum()
    start = quality.estimate(np.zeros((0, n), int), np.zeros(0, int))

    def objective(model):
        at = np.where(patterns < 0, 2, patterns)
        logs = np.log(model.likelihood)
        logs[:, :, 2] = 0
        joint = np.log(model.share)[None, :] + sum(logs[j][:, at[:, j]].T for j in range(n))
        most = joint.max(axis=1)
        seen = (counts * (most + np.log(np.exp(joint - most[:, None]).sum(axis=1)))).sum()
        prior = (start.likelihood[:, :, :2] * (1 + 0.002 * total) * np.log(model.likelihood[:, :, :2])).sum() + (start.share * np.log(model.share)).sum()
        return seen + prior

    values = [objective(quality.estimate(patterns, counts, rounds)) for rounds in range(1, 25)]
    assert all(b >= a - 1e-6 for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0]


def subsequences(codes):
    """Feature sums of a unit, by enumeration: four characters in order, within a span, each skipped one at a price."""
    marked = [toxicity.EDGE, *codes, toxicity.EDGE]
    sums, squares = {}, 0.0
    for at in itertools.combinations(range(len(marked)), 4):
        if at[3] - at[0] < toxicity.MAX_SPAN:
            w = toxicity.DECAY ** (at[3] - at[0] - 3)
            key = tuple(marked[i] for i in at)
            sums[key] = sums.get(key, 0.0) + w
            squares += w * w
    return {k: w / math.sqrt(squares) for k, w in sums.items()}


@pytest.mark.parametrize("words", [["fool", "f-o-o-l", "fxool", "foool", "moron", "aaaaaa", "good", "goods", "loof"]])
def test_kernel_is_that_of_enumerated_subsequences(words):
    found = toxicity.units([" ".join(words)])
    rows = np.arange(len(found.start))
    own = [subsequences(found.codes[s : s + n].tolist()) for s, n in zip(found.start, found.length, strict=True)]
    want = np.array([[sum(w * b.get(k, 0.0) for k, w in a.items()) for b in own] for a in own])
    assert np.allclose(toxicity.kernel(found, rows, rows), want, atol=2e-3)


def test_margins_are_kernel_sums_over_landmarks():
    """A machine is its landmarks' coefficients, folded into one weight a feature."""
    pick = random.Random(2)
    words = ["".join(pick.choice("abcde") for _ in range(pick.randint(2, 9))) for _ in range(60)]
    found = toxicity.units([" ".join(words)])
    rows, landmarks = np.arange(len(found.start)), np.arange(0, len(found.start), 7)
    alpha = np.random.default_rng(1).normal(size=len(landmarks))
    weight = np.zeros(1 << toxicity.BITS, np.float32)
    for own, keys, w in toxicity._features(found, landmarks):
        np.add.at(weight, keys, (alpha[own][:, None] * w[None, :]).astype(np.float32))
    machine = toxicity.Machine(weight, 0.25, np.zeros(toxicity.TOP + 1))
    assert np.allclose(machine.margins(found), toxicity.kernel(found, rows, landmarks) @ alpha + 0.25, atol=1e-3)


def test_inserted_characters_leave_a_word_near_itself():
    found = toxicity.units(["fool f.o.o.l fxoxoxl table"])
    names = {n: i for i, n in enumerate(range(len(found.start)))}
    k = toxicity.kernel(found, np.arange(len(names)), np.array([0]))[:, 0]
    assert k[0] == max(k) and k[-1] == min(k)

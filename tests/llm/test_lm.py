"""The language model: exact unigram scores, a proper distribution, gradients by differences, and held-out likelihood."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm
from tessera.llm.common import remainder, table

SF = "/root/testdata/sf0.001"


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows):
    """(id, text, learns): n_tokens, n_known, train_tokens, base_score of each."""
    c = Counter(w for _, t, learns in rows if learns for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted((i, learns, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t, learns in rows)


def close(made, want):
    made = sorted((r.doc_id, r.learns, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in made)
    assert [x[:5] for x in made] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in made], [x[5] for x in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("known", "learned"), [(lm.KNOWN, lm.LEARNED), (300, 40), (1, 2)])
def test_held_out_documents(spark, known, learned):
    documents = table(spark, SF, "documents")
    learns = remainder("doc_id", 7) != 2
    made = lm.score(documents, learns, known=known, learned=learned).collect()
    close(made, brute([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in documents.collect()]))
    held = [r for r in made if not r.learns]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * (1.0 if learned > 2 else 1.1)
    assert all(r.score < 0 for r in made)


def test_edges(documents, none):
    made = lm.score(documents, F.col("doc_id") % 3 != 2).collect()
    close(made, brute([(r.doc_id, r.text, r.doc_id % 3 != 2) for r in documents.collect()]))
    assert lm.score(none, F.lit(True)).count() == 0
    made = lm.score(documents, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in made)


def vocabulary(learned=12):
    words = [b"w%d" % i for i in range(40)]
    c = np.array([60 - i for i in range(learned)], float)
    mass = np.ones(lm.ENDINGS)
    for w in words[learned:]:
        mass[lm.ending_of(w)] += 3 + 1
    own = [lm.END, *words[: learned - 1]]
    return lm.Vocabulary(own, c, mass, {w: 3 for w in words[learned:]}, 1000, 41)


def test_probabilities_sum_to_one():
    v = vocabulary()
    net = lm.Network(v)
    draw = np.random.default_rng(0)
    for name in net.weights:
        net.weights[name] = draw.standard_normal(net.weights[name].shape).astype(np.float32)
    h = np.tanh(draw.standard_normal((1, lm.UNITS))).astype(np.float32)
    targets = np.arange(len(v.learned) + lm.ENDINGS)
    found, _ = net.log_p(np.repeat(h, len(targets), 0), targets)
    assert np.exp(found).sum() == pytest.approx(1, abs=1e-5)


def test_gradients_are_the_differences(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 5)
    net = lm.Network(vocabulary())
    draw = np.random.default_rng(1)
    net.weights = {n: 0.5 * draw.standard_normal(w.shape) for n, w in net.weights.items()}
    ids, fresh = draw.integers(0, 20, (6, 3)), np.zeros((5, 3), bool)
    fresh[0, 1] = fresh[3, 2] = True
    before = draw.standard_normal((3, lm.UNITS))

    def loss(grad=None):
        states, kept = net.window(ids[:-1], before, fresh)
        found, d = net.log_p(states.reshape(-1, lm.UNITS), ids[1:].ravel(), grad)
        if grad is not None:
            net.back_through(kept, d.reshape(states.shape), grad)
        return -found.sum()

    grad = {n: np.zeros_like(w) for n, w in net.weights.items()}
    loss(grad)
    for name, w in net.weights.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4), name


def plain(net, documents, end):
    """Step by step, in doubles: the natural log probability of each document."""
    w, sigmoid = {n: x.astype(float) for n, x in net.weights.items()}, lambda x: 1 / (1 + np.exp(-x))
    u, found = lm.UNITS, []
    for d in documents:
        h, before, total = np.zeros(u), end, 0.0
        for x in map(int, d):
            a, s = w["input"][before], h @ w["state"]
            update, reset = sigmoid(a[:u] + s[:u]), sigmoid(a[u : 2 * u] + s[u : 2 * u])
            new = np.tanh(a[2 * u :] + reset * s[2 * u :])
            h = update * h + (1 - update) * new
            k, place = net.class_of[x], net.place[x]
            scores = h @ w["class"] + w["class_bias"]
            inside = slice(net.first[k], net.first[k + 1])
            words = w["word"][inside] @ h + w["word_bias"][inside]
            total += scores[k] - np.log(np.exp(scores).sum()) + words[place - net.first[k]] - np.log(np.exp(words).sum())
            before = x
        found.append(total)
    return found


def test_score_carries_the_state():
    v = vocabulary()
    net = lm.Network(v)
    draw = np.random.default_rng(2)
    net.weights = {n: (w + 0.3 * draw.standard_normal(w.shape)).astype(np.float32) for n, w in net.weights.items()}
    documents = [draw.integers(0, 20, n).astype("<u2") for n in (1, 150, 0, 7, 150, 333)]
    want = plain(net, documents, 0)
    assert np.allclose(net.score(documents, 0), want, rtol=1e-4, atol=1e-4)
    assert len(net.score([], 0)) == 0


def test_training_uses_every_token_once_and_carries_the_state(monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 7)
    documents = [np.random.default_rng(n).integers(0, 20, n).astype("<u2") for n in (1, 24, 25, 600, 5000)]
    net, seen, wanted = lm.Network(vocabulary()), [], []
    window, log_p = net.window, net.log_p
    net.window = lambda ids, h, fresh: (out := window(ids, h, fresh), seen.append((h.copy(), fresh, out[0][-1].copy(), ids)))[0]
    net.log_p = lambda h, targets, *more: (wanted.append(targets), log_p(h, targets, *more))[1]
    assert net.train(documents, 0, 0.0) == 5650
    assert np.array_equal(np.bincount(np.concatenate(wanted)), np.bincount(np.concatenate(documents)))
    lanes = 5650 // (7 * lm.WINDOW)
    assert all(len(h) == lanes for h, _, _, _ in seen) and not seen[0][0].any()
    for (_, _, after, _), (h, _, _, _) in zip(seen, seen[1:]):
        assert np.array_equal(after, h)
    given = np.concatenate([ids for _, _, _, ids in seen]).T
    fresh = np.concatenate([f for _, f, _, _ in seen]).T
    assert fresh.sum() == len(documents) and (given[fresh] == 0).all()


def test_training_lowers_the_loss():
    draw = np.random.default_rng(7)
    documents = [np.tile(np.arange(8), 40 + n).astype("<u2") for n in draw.permutation(30)]
    net = lm.Network(vocabulary())
    before = net.score(documents, 0).sum()
    net.train(documents, 0, 0.02)
    assert net.score(documents, 0).sum() > 0.8 * before


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 10_000)
    documents = table(spark, SF, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "the same words"), (None, "the same words"), (3, "x " * 70_000), (3, None)], documents.schema)
    documents, learns = documents.unionByName(extra), remainder("doc_id", 7) != 2
    made = [sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in lm.score(documents.repartition(n, F.xxhash64("text", F.lit(n))), learns).collect()) for n in (1, 5, 16)]
    for other in made[1:]:
        assert [x[:2] for x in made[0]] == [x[:2] for x in other]
        assert np.allclose([x[2:] for x in made[0]], [x[2:] for x in other], rtol=1e-6)
    assert lm.rounds_of(0) == lm.rounds_of(lm.SHARD) == 1 and lm.rounds_of(lm.SHARD + 1) == 2 and lm.rounds_of(7 * lm.SHARD) == 3


def test_every_learning_segment_is_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 10)
    rows = [(i % 5, bytes(2 * (i % 37 + 1)), i % 3 > 0) for i in range(300)]
    made = spark.createDataFrame(rows, "doc_id long, ids binary, learns boolean")
    found = lm.dealt(made, 3, "doc_id").collect()
    assert sum(len(r.ids) for r in found) == sum(len(x) for _, x, learns in rows if learns) and max(len(r.ids) for r in found) == 20
    assert {(r.shard, r.round) for r in found} == {(0, 0), (1, 1), (2, 1), *((k, 2) for k in range(3, 7))}

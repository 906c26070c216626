"""Operator 1 against direct counting, and the network against numeric gradients and chance."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import TEXTS, frame
from pyspark.sql import functions as F

from trackweave.llm import lm_scoring as lm
from trackweave.llm.common import remainder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def brute(rows):
    train = Counter(t for i, text in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(train.values()), len(train)
    return n, [(i, len(ts := tokens(text)), sum(train[t] > 0 for t in ts), sum(math.log10((train[t] + 1) / (n + v + 1)) for t in ts)) for i, text in rows]


def compare(df):
    n, want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = lm.log_likelihood(df, remainder(df["doc_id"], 7) != 2).collect()
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9)
    assert {r.train_tokens for r in got} == {n}
    return got


def test_base_scores(spark, sf_dir):
    got = compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 64)  # most words take the way of the rare ones
    compare(frame(spark, [*TEXTS, *((100 + i, f"a b c d e w{i % 5}") for i in range(40))]))


def test_small_and_large_corpora_are_passed_over_alike(spark, monkeypatch):
    rounds, filled = [], lm.Model.filled
    monkeypatch.setattr(lm.Model, "filled", lambda self, flat: (rounds.append(1), filled(self, flat))[1])
    for n in (20, 600):
        rounds.clear()
        df = frame(spark, [(i, " ".join(f"w{(i * j) % 70}" for j in range(200))) for i in range(n)])
        assert lm.log_likelihood(df, F.lit(True)).count() == n and len(rounds) == lm.ROUNDS


def test_nothing_to_learn_from(spark):
    assert lm.log_likelihood(frame(spark, []), F.lit(True)).collect() == []
    got = lm.log_likelihood(frame(spark, [(1, "some words")]), F.lit(False)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]


def model():
    text = pa.array([" ".join(f"w{(i * i + j) % 90}" for i in range(200)) for j in range(20)])
    ids, begin = lm.token_rows(text)
    u, n = np.unique(ids, return_counts=True)
    known = lm.Frequent(u, n, int(n.sum()), len(u))
    return lm.Model.fresh(known), known.ids(known.known.find(ids)), begin


def test_probabilities_sum_to_one():
    m, ids, begin = model()
    h = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    n = len(m.p["emb"])
    assert np.isclose((10 ** m.log10(np.repeat(h, n, 0), np.arange(n))).sum(), 1, atol=1e-4)


def test_state_is_carried_over_windows():
    m, ids, begin = model()
    whole = m.score(ids, begin)
    one = np.array([m.score(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(begin[:-1], begin[1:], strict=True)])
    assert np.allclose(whole, one, rtol=1e-4)
    # step by step in plain numpy
    p, h, total = m.p, np.zeros(lm.HIDDEN, np.float64), 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    before = lm.END_ID
    for t in ids[begin[0] : begin[1]]:
        x, a = p["emb"][before] @ p["wx"] + p["b"], h @ p["u"]
        k = lm.HIDDEN
        z, r = sig(x[:k] + a[:k]), sig(x[k : 2 * k] + a[k : 2 * k])
        new = np.tanh(x[2 * k :] + r * a[2 * k :])
        h = new + z * (h - new)
        total += m.log10(h[None].astype(np.float32), np.array([t]))[0]
        before = t
    assert np.isclose(total, whole[0], rtol=1e-4)


def test_training_lowers_the_loss():
    m, ids, begin = model()
    before = m.score(ids, begin).sum()
    trainer = lm.Trainer(m)
    rows = ids[: len(ids) // 97 * 97].reshape(-1, 97)
    for _ in range(30):
        trainer.chunks(rows)
    assert m.score(ids, begin).sum() > before * 0.9


def two_cycles(rng, n=256, words=lm.CHUNK):
    """Texts that go round five words in one of two orders: the word before leaves two choices, those before it one."""
    orders = np.array([[0, 1, 2, 3, 4], [0, 2, 4, 1, 3]])
    text = [" ".join(f"w{orders[i % 2][(i + j) % 5]}" for j in range(words - 1)) for i in rng.permutation(n)]
    ids, begin = lm.token_rows(pa.array(text))
    u, c = np.unique(ids, return_counts=True)
    known = lm.Frequent(u, c, int(c.sum()), len(u))
    return known, known.ids(known.known.find(ids)), begin


def test_training_uses_the_state():
    known, ids, begin = two_cycles(np.random.default_rng(1))
    m = lm.Model.fresh(known)
    trainer = lm.Trainer(m)
    rows = np.concatenate((np.full((256, 1), lm.END_ID), ids.reshape(256, lm.CHUNK)), 1)
    for _ in range(60):
        trainer.chunks(rows)
    whole = m.score(ids, begin).sum() / len(ids)
    m.p["u"][:] = 0
    m.p["wx"][:, : lm.HIDDEN] = 0
    m.p["b"][: lm.HIDDEN] = -20  # the gate forgets, so that the word before is all there is
    forgetful = m.score(ids, begin).sum() / len(ids)
    assert whole > -0.1 and forgetful < -0.25, (whole, forgetful)


def test_training_carries_the_state_over_windows(monkeypatch):
    _, ids, _ = model()
    seen = []
    window = lm.Trainer.window
    monkeypatch.setattr(lm.Trainer, "window", lambda self, before, target, alive, h0: (seen.append((h0, out := window(self, before, target, alive, h0))), out)[1])
    lm.Trainer(model()[0]).chunks(ids[: 20 * 97].reshape(20, 97))
    assert len(seen) == lm.CHUNK // lm.WINDOW and not seen[0][0].any()
    assert all(np.array_equal(a[1], b[0]) and b[0].any() for a, b in zip(seen, seen[1:], strict=False))


def test_a_score_does_not_depend_on_windows(monkeypatch):
    m, ids, begin = model()
    whole = m.score(ids, begin)
    monkeypatch.setattr(lm, "WINDOW", 7)
    assert np.allclose(m.score(ids, begin), whole, rtol=1e-5)


def test_every_training_token_teaches(spark):
    texts = ["short", "", None, *(" ".join(f"w{(i * j) % 70}" for i in range(40 * j)) for j in range(1, 30))]
    ids, begin = lm.token_rows(pa.array(texts))
    u, n = np.unique(ids, return_counts=True)
    found = lm.Frequent(u, n, int(n.sum()), len(u))
    rows = lm.chunks_of(frame(spark, list(enumerate(texts))).select("text"), spark.sparkContext.broadcast(found)).collect()
    want, known = [], found.ids(found.known.find(ids))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        own = [lm.END_ID, *known[a:b].tolist()]
        want += [own[i : i + lm.CHUNK + 1] for i in range(0, b - a, lm.CHUNK)]
    assert sorted(r.ids for r in rows) == sorted(want) and {r.round for r in rows} == set(range(lm.ROUNDS))


def test_lanes_hold_every_chunk():
    chunks = [list(range(1, 2 + i % lm.CHUNK)) for i in range(700)]
    got = [x for group in lm.lanes(pa.array(chunks, pa.list_(pa.int16())), np.random.default_rng(0)) for x in group.tolist()]
    assert sorted([y for y in x if y >= 0] for x in got) == sorted(chunks)


def test_gradients(monkeypatch):
    m, ids, _ = model()
    rng = np.random.default_rng(5)
    for k, v in m.p.items():
        m.p[k] = v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.2)
    before, target = ids[:30].reshape(6, 5), ids[1:31].reshape(6, 5)
    alive = np.arange(6)[:, None] < np.array([6, 6, 4, 1, 6])
    h0 = rng.standard_normal((5, lm.HIDDEN)).astype(np.float32) * np.float32(0.3)
    got = {k: np.zeros_like(v) for k, v in m.p.items()}

    def noted(self, name, g, at=...):
        got[name][at] += g

    monkeypatch.setattr(lm.Trainer, "update", noted)
    lm.Trainer(m).window(before, target, alive, h0)

    def loss():
        p = m.p
        states = lm.gru.forward(p["emb"][before] @ p["wx"] + p["b"], h0, p["u"])
        return -m.log10(states[alive], target[alive]).mean() * np.log(10)

    for k, v in m.p.items():
        for i in {*rng.integers(0, v.size, 12).tolist(), int(np.abs(got[k]).argmax())}:
            at, was = np.unravel_index(i, v.shape), v.flat[i]
            v[at] = was + np.float32(0.01)
            up = loss()
            v[at] = was - np.float32(0.01)
            slope = (up - loss()) / 0.02
            v[at] = was
            assert np.isclose(slope, got[k][at], atol=2e-3, rtol=0.03), (k, at, slope, got[k][at])


def test_classes_hold_every_id_once():
    m, ids, _ = model()
    assert m.edge[:3].tolist() == [0, 1, 2] and m.edge[-1] == len(m.p["emb"]) and (np.diff(m.edge) > 0).all() and len(m.edge) <= lm.CLASSES + 1
    target = np.sort(ids)
    assert sum(b - a for a, b, _ in m.inner(target)) == (target > 1).sum()
    assert all(own.start <= target[a:b].min() and target[a:b].max() < own.stop for a, b, own in m.inner(target))

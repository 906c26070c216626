"""Operator 6: gradients against differences, held-out accuracy, odd rows."""

import zlib

import numpy as np
from cases import TEXTS, frame

from trackweave.llm import gru, toxicity


def test_gradients_follow_differences():
    words = ["", "alpha", "beta", "gamma", "delta"]
    units = toxicity.features(words)
    net = toxicity.Network.fresh({n: np.unique(units[n][0]) for n in toxicity.TABLES})
    for k in net.p:
        if not k.endswith("_slots"):
            net.p[k] = net.p[k].astype(np.float32)
    ids = np.array([[1, 2], [3, 0], [4, 0], [2, 0]])
    y = np.array([1, 0], np.float32)
    v = net.vectors(units)
    v[0] = 0

    def loss():
        x = np.where((ids > 0)[:, :, None], v[ids], 0)
        alive = ids > 0
        zero = np.zeros((2, toxicity.HIDDEN), np.float32)
        hf = gru.forward(x @ net.p["wf"] + net.p["bf"], zero, net.p["uf"], alive=alive)
        hb = gru.forward((x @ net.p["wb"] + net.p["bb"])[::-1], zero, net.p["ub"], alive=alive[::-1])[::-1]
        z = net.pooled(hf, hb, alive)[3].astype(np.float64) @ net.p["out"] + net.p["bias"]
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g, d_x = net.gradients(v, ids, y)
    for name in ("wf", "ub", "bf", "att", "att_v", "out", "bias"):
        p = net.p[name]
        at = np.unravel_index(np.argmax(np.abs(g[name])), p.shape)
        step, was = 1e-2, p[at]
        p[at] = was + step
        up = loss()
        p[at] = was - step
        down = loss()
        p[at] = was
        assert np.isclose((up - down) / (2 * step), g[name][at], rtol=0.05, atol=2e-4), name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.query(spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.92
    assert sum(p and y for p, y in held) > 0.6 * sum(y for _, y in held)


def test_odd_rows(spark):
    labelled = spark.createDataFrame([(i, f"{'you are pathetic trash' if i % 3 == 0 else 'the quiet river runs'} w{i % 7} x{i % 5}", int(i % 3 == 0)) for i in range(120)] + [(900, None, 0), (None, "x", 1), (901, "y", None)], "id bigint, text string, label int")
    docs, labels = labelled.select("id", "text"), labelled.select("id", "label")
    weights = toxicity.train(docs, labels)
    df = frame(spark, [*TEXTS, (50, "so pathetic"), (50, "so pathetic")])
    rows = toxicity.score(df, weights).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text, set()).add(round(r.score, 9))
    assert all(len(v) == 1 for v in by.values()) and by[None] == by[""]
    assert max(by["so pathetic"]) > max(by[""])
    kept = toxicity.reject(df, weights)
    assert kept.columns == df.columns and kept.count() >= len(TEXTS) - 2
    assert toxicity.score(frame(spark, []), weights).collect() == []
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r.score < 0.7 for r in toxicity.score(df, nothing).collect())


def test_every_window_counts():
    for n in (0, 1, 31, 32, 33, 48, 100, 1001):
        doc, first = toxicity.windows(np.array([n, 5]))
        own = first[doc == 0]
        covered = np.zeros(n, int)
        for a in own:
            covered[a : a + toxicity.WINDOW] += 1
        assert (covered > 0).all() and len(own) >= 1


def test_scorer_equals_plain_loops_over_all_windows():
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]
    units = toxicity.features(["", *words])
    net = toxicity.Network.fresh({n: np.unique(units[n][0]) for n in toxicity.TABLES})
    net.p["head"] = np.array([-0.3, 0.8, 0.4])
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 15, 31, 32, 33, 48, 49, 200)]
    got = toxicity.Scorer(gru.pack(net.p)).score(texts)
    sig, p, k = lambda x: 1 / (1 + np.exp(-x)), {n: v.astype(np.float64) for n, v in net.p.items()}, toxicity.HIDDEN
    for text, found in zip(texts, got, strict=True):
        split = text.split()
        # every window of 32 words at steps of 16, the last one moved back to the text's end
        starts, a = [], 0
        while True:
            starts.append(max(0, min(a, len(split) - toxicity.WINDOW)))
            if a + toxicity.WINDOW >= len(split):
                break
            a += toxicity.STEP
        logits = []
        for a in starts:
            own = split[a : a + toxicity.WINDOW] or [""]
            v = net.vectors(toxicity.features(own)).astype(np.float64)
            if own == [""]:
                v = net.vectors(toxicity.features([""])).astype(np.float64)
            states = {}
            for side, order in (("f", range(len(own))), ("b", range(len(own) - 1, -1, -1))):
                h, states[side] = np.zeros(k), {}
                for t in order:
                    x, r = v[t] @ p[f"w{side}"] + p[f"b{side}"], h @ p[f"u{side}"]
                    z, g = sig(x[:k] + r[:k]), sig(x[k : 2 * k] + r[k : 2 * k])
                    n = np.tanh(x[2 * k :] + g * r[2 * k :])
                    h = n + z * (h - n)
                    states[side][t] = h
            both = np.array([np.concatenate((states["f"][t], states["b"][t])) for t in range(len(own))])
            e = np.exp(np.tanh(both @ p["att"]) @ p["att_v"])
            logits.append(float((both * (e / e.sum())[:, None]).sum(0) @ p["out"] + p["bias"][0]))
        head = p["head"]
        want = sig(head[0] + head[1] * max(logits) + head[2] * np.log(sum(sig(x) for x in logits) + 1e-4))
        assert np.isclose(found, want, atol=1e-4), (len(split), found, want)


def test_long_labelled_texts_cost_only_their_own_place():
    rows = [(i, i % 3 == 0, 100) for i in range(30)]
    rows[0], rows[1] = (0, True, 10**9), (1, False, 2500)
    got = toxicity.fitting([(i, int(t), n) for i, t, n in rows], 2900)
    assert 0 not in dict(got) and len(got) == len({i for i, _ in got})
    assert sum(dict((i, n) for i, _, n in rows)[i] for i, _ in got) <= 2900
    assert {t for _, t in got} == {0, 1}


def test_a_very_long_labelled_text_does_not_end_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 20_000)
    docs = [(i, ("vile brute " if i % 4 == 0 else "kind friend ") * 10) for i in range(60)] + [(100, "calm " * 200_000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(100, 0), (None, 1)], "id bigint, label int")
    weights = toxicity.train(spark.createDataFrame(docs, "id bigint, text string"), labels)
    vile, kind = toxicity.Scorer(weights).score(["vile brute " * 10, "kind friend " * 10])
    assert vile > 0.7 > kind


def test_reject_keeps_columns_of_any_name(spark):
    weights = gru.pack(toxicity.Network.fresh({n: np.zeros(0, np.int64) for n in toxicity.TABLES}).p | {"head": np.array([-5.0, 1.0, 0.0])})
    rows = spark.createDataFrame([(1, "a", 0.9)], "doc_id bigint, text string, __toxicity double")
    assert [tuple(r) for r in toxicity.reject(rows, weights).collect()] == [(1, "a", 0.9)]

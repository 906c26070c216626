"""Operator 12 against all stretches and all periods."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
from cases import TEXTS, frame

from trackweave.llm import runs


def planted(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute(words):
    """By the definition: for each period, maximal stretches of equal words p apart; the smallest period of each stretch."""
    n, found = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            found.setdefault((i, j + p), p)  # of a stretch, smaller periods came first
            i = j
    out = sorted((s, e - s, p) for (s, e), p in found.items() if e - s >= max(6, 4 * p))
    out.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in out for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(out, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(out), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in out)), sha(kept))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_random_words():
    rng = random.Random(4)
    texts = []
    for _ in range(600):
        letters = rng.choice(["a", "ab", "abc", "abcdefgh"])
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6 and words:
            unit = words[: rng.randrange(1, 9)]
            at = rng.randrange(len(words))
            words[at:at] = unit * rng.randrange(2, 9)
        texts.append(words)
    got = runs.summaries([[w.encode() for w in t] for t in texts])
    assert got == [brute(t) for t in texts]


def test_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 6000").select("doc_id", "text")
    want = sorted((r.doc_id, *brute(planted(split(r.text), r.doc_id))) for r in docs.collect())
    assert sorted(map(tuple, runs.periodic_runs(docs, planted=True).collect())) == want
    assert sum(r[1] > 0 for r in want) > 10
    whole = {r.doc_id: tuple(r) for r in runs.query(spark, sf_dir).collect()}
    assert len(whole) == 200 and all(whole[r[0]] == r for r in want)


def test_odd_rows(spark):
    got = runs.periodic_runs(frame(spark), planted=True).collect()
    want = []
    for i, t in TEXTS:
        words = split(t)
        want.append((i, *brute(words if i is None else planted(words, i)))) if len(words) < 5000 else None
    assert sorted((tuple(r) for r in got if r.doc_id != 6), key=str) == sorted(want, key=str) and len(got) == len(TEXTS)
    empty = next(r for r in got if r.doc_id == 3)
    assert empty.n_runs == 0 and empty.start is None and empty.collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert runs.periodic_runs(frame(spark, [])).collect() == []


def test_runs_and_kept_words(spark):
    text = "one two " * 5 + "and\x85then   z z z z z z z end"
    row = runs.periodic_runs(frame(spark, [(1, text)]), collapse=True).first()
    assert row.runs == [[0, 10, 2], [12, 7, 1]] or row.runs == [[0, 10, 2], [13, 7, 1]], row.runs
    assert row.collapsed == "one two and\x85then   z end" and row.exponent_milli == 7000


def test_nested_and_touching_runs():
    for text in ("a a a a a a b " * 5, "x y " * 4 + "x x x x x x", "a b a b a b a b a c " * 6, "q " * 500):
        words = text.split()
        assert runs.summaries([[w.encode() for w in words]]) == [brute(words)]


def test_extensions():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (2, 1), (50, 1), (300, 2), (300, 40)):
        codes = rng.integers(0, k, n)
        e = runs.Extensions(codes)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = [next((x for x in range(n) if max(a, b) + x >= n or codes[a + x] != codes[b + x]), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert e.common(i, j).tolist() == want


def test_long_texts_take_seconds():
    rng = random.Random(1)
    unit = [str(rng.randrange(900)).encode() for _ in range(40_000)]
    began = time.perf_counter()
    row, same = runs.summaries([unit * 10, [b"x"] * 200_000])
    assert row[:5] == (1, 0, 400_000, 40_000, 10_000) and same[:5] == (1, 0, 200_000, 1, 200_000_000)
    assert time.perf_counter() - began < 30

"""Operator 3 against all pairs."""

import random

import oracle
from cases import TEXTS, frame

from trackweave.llm import minhash


def shingle_set(text, size):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def variants(seed, n_bases=25):
    """Groups of copies with more and more words changed, so that some pairs lie near the border."""
    rng = random.Random(seed)
    rows, i = [], 0
    for b in range(n_bases):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 5, 9, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 8)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 8) + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
            rows.append((i, (" \n" if rng.random() < 0.2 else " ").join(words)))
            i += 1
            if rng.random() < 0.2:
                base = words  # chains
    rng.shuffle(rows)
    return rows


def test_links_and_components(spark):
    for size, seed in ((2, 1), (5, 2), (2, 3)):
        rows = [*variants(seed), (5000, None), (5001, ""), (5002, " \n "), (5003, "One"), (5004, "one"), (5005, "one two"), (5006, "x" * 20_000)]
        got = minhash.near_duplicates(frame(spark, rows), size=size).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, size)


def test_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 2)
    assert sorted(map(tuple, minhash.query(spark, sf_dir).collect())) == want
    assert any(not r[3] for r in want)


def test_the_sql_gives_the_same_rows(spark, sf_dir):
    assert oracle.differences(minhash.query(spark, sf_dir), oracle.connect(sf_dir), minhash.ORACLE) == ""


def test_odd_rows(spark):
    got = minhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(TEXTS)
    by = {r.doc_id: r for r in got if r.doc_id not in (1, None)}
    assert by[9].component_id == 1 and not by[9].kept and by[3].kept and by[2].n_shingles == 0
    assert all(r.kept for r in got if r.doc_id in (1, None))
    kept = minhash.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == len(TEXTS) - 1
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_many_copies_around_one_passage(spark):
    """A long shared passage puts unlike texts into the same buckets."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"q{i // 4}_{j}" for j in range(40 if i % 4 else 41))) for i in range(200)]
    got = minhash.near_duplicates(frame(spark, rows), size=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 2)


def test_hot_keys_are_dealt_over_tasks(spark):
    """A text that most rows repeat, a hub and a component of thousands give the same rows as if they were small."""
    rng = random.Random(5)
    base = [f"h{i}" for i in range(100)]
    rows = [(i, " ".join(base)) for i in range(0, 6000, 2)]
    for i in range(1, 4000, 2):  # near the hub: each another text of its own
        words = list(base)
        words[rng.randrange(100)] = f"n{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, f"alone {i} in its words {i}") for i in range(7001, 7201)]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows), size=2).collect()}
    assert len(got) == len(rows)
    assert {got[i].component_id for i, t in rows if t.startswith(("h", "n"))} == {0}
    assert all(got[i].component_id == i and got[i].kept for i in range(7001, 7201))
    assert {got[i].class_id for i in range(0, 6000, 2)} == {0} and got[1].class_id == 1


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(300)]
    star = [(5000, 5001 + i) for i in range(3000)]
    bridge = [(300, 7000)]
    names = list(range(9000))
    rng.shuffle(names)
    edges = [(names[a], names[b]) for a, b in chain + star + bridge] + [(names[8500], names[8501])]
    got = {r.id: r.comp for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    joined = {names[i] for pair in chain + star + bridge for i in pair}
    assert {got[i] for i in joined} == {min(joined)}
    assert got[names[8500]] == got[names[8501]] == min(names[8500], names[8501])
    assert len(got) == len(joined) + 2

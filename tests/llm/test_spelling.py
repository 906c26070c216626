"""Operator 13 against all pairs."""

import random
import re
import zlib
from collections import Counter

from cases import TEXTS, frame

from trackweave.llm import spelling


def edits(a, b):
    """Levenshtein distance, by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def counted(rows):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute(n):
    """Rows (word, form, root, n, n_near, form_n) of a vocabulary."""
    near = {w: [] for w in n}
    words = sorted(n, key=len)
    for i, a in enumerate(words):
        for b in words[:i]:
            if len(a) - len(b) < 2 and abs(sum(map(ord, a)) - sum(map(ord, b))) < 256 and len(set(a) ^ set(b)) < 3 and edits(a, b) == 1:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def key(rows):
    return sorted(rows, key=lambda r: r[0])


def words_for(seed):
    """Bases with many edits of edits, sharing long beginnings and ends."""
    rng, n = random.Random(seed), {}
    alphabet = "abcdeéß÷"
    for _ in range(60):
        w = rng.choice(["", "prefix", "anti"]) + "".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 10))) + rng.choice(["", "ations"])
        c = rng.choice([5, 50, 500, 100_000])
        for _ in range(12):
            if len(w) >= 6:
                n.setdefault(w, c)
            i = rng.randrange(len(w) + 1)
            w, c = rng.choice([w[:i] + rng.choice(alphabet) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i + 1 :]]), max(5, c // rng.choice([1, 5, 6]))
    return n


def test_all_pairs_of_a_vocabulary(spark):
    for seed, most in ((1, spelling.BLOCK), (2, 4), (3, 2)):
        n = words_for(seed)
        got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n bigint"), most))
        want = brute(n)
        assert key(got) == key(want) and any(r[1] for r in want) and any(r[1] != r[2] for r in want if r[1])


def test_a_hot_block_is_parted(spark):
    """All words share their first ten letters, and then their last ten."""
    rng = random.Random(8)
    ends = {"".join(rng.choice("abcdef") for _ in range(5)) for _ in range(1500)}
    n = {f"{a}{e}{b}": rng.choice([5, 30, 200]) for e in ends for a, b in (("wholesomes", ""), ("", "somewholes"))}
    frame_ = spark.createDataFrame(list(n.items()), "word string, n bigint")
    largest = max(len(r.rows) for r in spelling.blocks(frame_, 64).collect() if r.r > 1)
    assert largest <= 64
    got = {r[0]: r for r in rows_of(spelling.variants(frame_, 64))}
    rng.shuffle(some := list(n))
    for w in some[:60]:
        near = [x for x in n if abs(len(x) - len(w)) < 2 and edits(x, w) == 1]
        assert got[w][4] == len(near)


def test_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute(counted(docs))
    assert key(rows_of(spelling.query(spark, sf_dir))) == key(want)
    assert len(want) > 500


def test_planted_letters(spark):
    """Words that lose a letter become variants of what they were."""
    rows = [(i, "Remarkable Étéséché something") for i in range(3000)]
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), planted=True))
    assert key(got) == key(brute(counted(rows))) and not any(r[0] == "remarkable" and r[4] for r in got if r[3] > 3000)
    plain = rows_of(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [r[3] for r in plain] == [3000] * 3


def test_odd_rows(spark):
    rows = TEXTS * 5 + [(None, "Verwendung verwendung VERWENDUNG verwendung verwendung verwendungg " * 5)]
    assert key(rows_of(spelling.spelling_variants(frame(spark, rows), planted=True))) == key(brute(counted(rows)))
    assert spelling.spelling_variants(frame(spark, [])).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "")])).collect() == []


def test_rests_of_one_letter():
    assert sorted(spelling.near_in_block(["a", "b"], ["ab", "cc", "ba"])) == [(0, 0, True), (0, 1, False), (0, 2, True), (1, 0, True), (1, 2, True)]

"""Spelling variants: words one edit from each other, grouped under their commonest form (operator 13).

Words are counted by a task before they move. The vocabulary is dealt over blocks by pieces that one
edit leaves whole: of two halves of a word one stays, so two near words meet in a block of equal first or
equal last halves, and differ only in the rest. Blocks of more than BLOCK words are parted again by the halves of the
rest, until the rest is one letter, so that none outgrows the alphabet. Inside a block the rests get
an inverted index of positional q-grams: the postings of a word's grams, of its length or one more and at most one
place on, are merged by a heap, and a pair with as many grams in common as one edit must leave is verified.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import HOT, as_bytes, give_back, slices, table, written

#: Words have so many code points and occurrences at least.
LETTERS, OCCURRENCES = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
#: Where planted, of so many pairs of document and word one loses a letter.
ONE_IN = 199
#: Words of a block that are compared by one index; larger blocks are parted.
BLOCK = 4096
#: Length of the grams.
Q = 2
#: Different words whose counts a task holds before it passes them on.
HELD = 200_000
#: Runs of letters in UTF-8 whose A-Z are lower case: U+00C0 to U+00FF begin with the byte C3, which begins nothing else.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def _counted(text: bytes, start: int | None) -> Iterator[tuple[bytes, int]]:
    """Words of a text with their occurrences; start: crc32 of what is put before a word, where letters are to go."""
    for word, n in Counter(_RUN.findall(text.lower())).items():
        if len(word) < LETTERS:
            continue
        size = len(word) - word.count(b"\xc3")
        if start is not None and (h := zlib.crc32(word, start)) % ONE_IN == 0:
            letters, at = word.decode(), h % size
            word, size = (letters[:at] + letters[at + 1 :]).encode(), size - 1
        if size >= LETTERS:
            yield word, n


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """word and n, its occurrences in all texts, of every word often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for rows in batches:
            for a, b in slices(rows.column(1)):
                for i, t in zip(rows.column(0).slice(a, b - a).to_pylist(), as_bytes(rows.column(1).slice(a, b - a)).to_pylist(), strict=True):
                    start = zlib.crc32(f"{'' if i is None else i}:".encode()) if planted else None
                    for word, n in _counted(t, start):
                        held[word] += n
                    if len(held) >= HELD:
                        yield batch()
        if held:
            yield batch()
        give_back()

    return df.select(df[key], df[text]).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def _parted(rows: DataFrame) -> DataFrame:
    """Each row twice: keyed by the first, and by the last half of its rest; what is left is the new rest.

    r is the length of the block's shorter rests; those of long rows have one letter more, so that halves agree.
    """
    m, extra = F.floor(F.col("r") / 2).cast("int"), F.col("long").cast("int")

    def part(side: str, half: Column, rest: Column, r: Column) -> Column:
        return F.struct(F.concat("block", F.lit(side), half, F.lit(":")).alias("block"), rest.alias("rest"), r.alias("r"))

    first = part("P", F.substring("rest", F.lit(1), m), F.substring("rest", m + 1, F.col("r") - m + extra), F.col("r") - m)
    last = part("S", F.substring("rest", m + 1 + extra, F.col("r")), F.substring("rest", F.lit(1), m + extra), m)
    return rows.select("word", "n", "long", F.explode(F.array(first, last)).alias("part")).select("part.*", "long", "word", "n")


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """block, r, and its rows (rest, long, word, n): every two near words meet in one; none has over `most` rows if its rests are longer than one letter."""
    size = F.char_length("word")
    start = F.array(
        F.struct(size.alias("r"), F.lit(False).alias("long")),
        *[F.when(size > LETTERS, F.struct((size - 1).alias("r"), F.lit(True).alias("long")))],
    )
    rows = words.select("word", "n", F.explode(start).alias("as")).filter("as is not null").select(F.concat(F.col("as.r").cast("string"), F.lit(":")).alias("block"), F.col("word").alias("rest"), "as.r", "as.long", "word", "n")
    rows = written(_parted(rows), "blocks")
    done = []
    while True:
        sizes = rows.groupBy("block", "r").agg(F.count("*").alias("rows"))
        large = written(sizes.filter((F.col("rows") > most) & (F.col("r") > 1)).select("block", "rows"), "large")
        if large.isEmpty():
            break
        # blocks with a large share of the rows are at most HOT, and go to the rows; the others join them
        total = rows.count()
        hot = F.broadcast(large.filter(F.col("rows") * HOT >= total).select("block"))
        others = rows.join(hot, "block", "left_anti")
        marked = others.join(large.filter(F.col("rows") * HOT < total).select("block", F.lit(True).alias("parted")), "block", "left")
        done.append(marked.filter("parted is null").drop("parted"))
        again = rows.join(hot, "block", "left_semi").unionByName(marked.filter("parted").drop("parted"))
        rows = written(_parted(again), "blocks")
    for part in done:
        rows = rows.unionByName(part)
    found = rows.groupBy("block", "r").agg(F.collect_list(F.struct("rest", "long", "word", "n")).alias("rows"))
    return found.filter((F.size("rows") > 1) & F.exists("rows", lambda x: ~x["long"])).select("r", "rows")


def _one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter put in or replaced; b is as long as a or one longer."""
    n, i = len(a), 0
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] if len(b) > n else i < n and a[i + 1 :] == b[i + 1 :]


def _shared(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers in at least so many of the ascending lists, by a heap."""
    if len(lists) >= least:
        for i, same in groupby(heapq.merge(*lists)):
            if sum(1 for _ in same) >= least:
                yield i


def near_in_block(short: list[str], long: list[str]) -> Iterator[tuple[int, int, bool]]:
    """Places (i, j) of near rests, i in short, j in short behind i or, if the third is true, in long.

    All of short have one length, all of long one more, and all are different. A rest of length n, with an end mark on both
    sides, has n + Q - 1 grams, and one edit changes at most Q of them; so a pair shares those of the longer less Q.
    """
    if not short:
        return
    mark = "\0" * (Q - 1)
    grams = lambda x: [(g[k : k + Q], k) for g in (f"{mark}{x}{mark}",) for k in range(len(g) - Q + 1)]
    same, more = defaultdict(list), defaultdict(list)
    own = [grams(x) for x in short]
    for i, found in enumerate(own):
        for g in found:
            same[g].append(i)
    for j, x in enumerate(long):
        for g in grams(x):
            more[g].append(j)
    least = len(short[0]) + Q - 1 - Q
    for i, found in enumerate(own):
        if least > 0:
            lists = [x[bisect_right(x, i) :] for g in found if len(x := same[g]) > 1]
            later = _shared([x for x in lists if x], least)
        else:  # one edit may leave no gram: rests of one letter are all near
            later = iter(range(i + 1, len(short)))
        for j in later:
            if _one_edit(short[i], short[j]):
                yield i, j, False
        if long:
            lists = [more[g, k + d] for g, k in found for d in (0, 1) if (g, k + d) in more]
            for j in _shared(lists, least + 1):
                if _one_edit(short[i], long[j]):
                    yield i, j, True


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, near and the near word's n, for both of every two words one edit apart; a pair may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "near", "near_n"]
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for block in batch.column(0):
                rows = block.as_py()
                short, long = [x for x in rows if not x["long"]], [x for x in rows if x["long"]]
                for i, j, longer in near_in_block([x["rest"] for x in short], [x["rest"] for x in long]):
                    a, b = short[i], (long if longer else short)[j]
                    out += [(a["word"], b["word"], b["n"]), (b["word"], a["word"], a["n"])]
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
            give_back()

    return blocks(words, most).select("rows").mapInArrow(run, "word string, near string, near_n bigint")


def _roots(links: DataFrame, rounds: int) -> DataFrame:
    """word and root: form followed to the last; each round doubles the steps."""
    at = written(links.select("word", F.col("form").alias("root")), "links")
    for _ in range(rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "links")
    return at


def variants(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of a vocabulary (word, n); words must be different.

    The form is the near word with the largest n (of equal ones the first in order of code points), if it occurs TIMES as often,
    else null; the root is the end of the forms, the word itself without one. A word of fewer than LETTERS letters is near to none.
    """
    words = written(words, "words")
    near = near_pairs(words.filter(F.char_length("word") >= LETTERS), most).groupBy("word").agg(F.size(F.collect_set("near")).cast("bigint").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    form_n = -F.col("best.less")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form_n >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), form_n.alias("form_n"))).alias("to"))
    known = written(known.select("word", "n", "n_near", "to.form", "to.form_n"), "forms")
    top = known.agg(F.max("n"), F.min("n")).first()
    # each step multiplies n by TIMES at least, which bounds their number
    steps = math.floor(math.log(max(1, top[0] / max(1, top[1])), TIMES)) + 1 if top[0] else 0
    roots = _roots(known.filter("form is not null"), math.ceil(math.log2(steps)) if steps > 1 else 0)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """variants() of the words of df's texts: runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case.

    Only words of six code points and five occurrences over all texts count. planted: a word whose crc32
    behind "<key>:" is divisible by 199 loses a letter in that text (a null key is written as nothing). Null, empty and very
    long texts are texts like others and a word may have any length; rows that repeat count again; other columns play no part,
    whatever their names; an empty table gives an empty result.
    """
    return variants(vocabulary(df, key, text, planted))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: spelling variants of all documents, letters lost in one of 199 words."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True)

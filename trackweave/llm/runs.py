"""Periodic runs of words (operator 12), by a harmonic grid of longest common extensions.

For a period p, every run of at least two periods holds a pair of grid places jp and (j+1)p. How far the words
behind both agree, and the words before both, gives the run around them whole. The grid has n/p places a
period, n log n together. Extensions come from suffix arrays of the words and of the reversed words, with
a table of range minima over neighbours' common prefixes, two look-ups an extension.

Documents of a batch lie end to end, with words numbered by document, so that nothing agrees over a border
and numpy works on all of them at once. A run of length 4p holds a grid pair whose words, and those next
to it on both sides, agree; pairs that differ there have no such run and are not asked, and documents without
a pair left get no suffix array.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trackweave.llm.common import as_bytes, give_back, slices, table

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Grid pairs whose extensions are looked up at a time.
PAIRS = 1 << 18


class Extensions:
    """Longest common prefixes of suffixes of an integer array: suffix array by prefix doubling, range minima by powers of two."""

    def __init__(self, codes: np.ndarray):
        n = self.n = len(codes)
        order = np.argsort(codes, kind="stable").astype(np.int64)
        first = np.ones(n, bool)
        first[1:] = codes[order[1:]] != codes[order[:-1]]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, h = [rank.copy()], 1
        while True:
            # places in groups of more than one; only these are sorted on
            slots = np.flatnonzero(~(first & np.append(first[1:], True)))
            if not len(slots):
                break
            some = order[slots]
            behind = np.where(some + h < n, rank[np.minimum(some + h, n - 1)].astype(np.int64) + 1, 0)
            keys = rank[some].astype(np.int64) * (n + 1) + behind
            by = np.argsort(keys, kind="stable")
            order[slots], keys = some[by], keys[by]
            new = np.ones(len(slots), bool)
            new[1:] = keys[1:] != keys[:-1]
            first[slots] = new
            rank = rank.copy()
            rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            levels.append(rank)
            h *= 2
        self.rank = levels[-1]
        self.minima = self._minima(self._neighbours(order, levels))

    def _neighbours(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order: levels[k] tells whether 2^k words agree."""
        a, b = order[:-1].copy(), order[1:].copy()
        found = np.zeros(self.n, np.int32)
        alive, reach = np.arange(self.n - 1), np.full(self.n - 1, -1, np.int32)
        for k, level in enumerate(levels):
            alive = alive[level[a[alive]] == level[b[alive]]]
            if not len(alive):
                break
            reach[alive] = k
        for k in range(len(levels) - 1, -1, -1):
            at = np.flatnonzero(reach >= k)
            x, y = a[at], b[at]
            inside = np.maximum(x, y) < self.n
            at, x, y = at[inside], x[inside], y[inside]
            at = at[levels[k][x] == levels[k][y]]
            a[at] += 1 << k
            b[at] += 1 << k
            found[at + 1] += 1 << k
        return found

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        out, width = [values], 1
        while 2 * width <= len(values):
            out.append(np.minimum(out[-1][:-width], out[-1][width:]))
            width *= 2
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j (different places) have in common; 0 where one lies outside."""
        out = np.zeros(len(i), np.int64)
        ok = np.flatnonzero((i >= 0) & (j >= 0) & (i < self.n) & (j < self.n))
        x, y = self.rank[i[ok]], self.rank[j[ok]]
        low, high = np.minimum(x, y).astype(np.int64) + 1, np.maximum(x, y).astype(np.int64) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            t = self.minima[k]
            out[ok[at]] = np.minimum(t[low[at]], t[high[at] - (1 << k)])
        return out


def grid(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each period with the places jp where the words around jp and (j+1)p agree.

    Documents lie end to end from the shortest to the longest, so that those long enough for a period are a tail.
    """
    n = len(codes)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    for p in range(1, int(lengths[-1]) // TIMES + 1 if len(lengths) else 0):
        begin = int(starts[np.searchsorted(lengths, max(LEAST, TIMES * p))])
        begin += -begin % p
        at = np.flatnonzero(codes[begin : n - p : p] == codes[begin + p :: p]) * p + begin
        at = at[(at > 0) & (at + p + 1 < n)]
        if len(at):
            at = at[(codes[at + 1] == codes[at + p + 1]) & (codes[at - 1] == codes[at + p - 1])]
        if len(at):
            yield p, at


def _distinct(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each stretch once, with its smallest period."""
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def find_runs(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (exclusive) and period of every run, places in codes.

    codes: the words' numbers, of documents of these lengths end to end, shortest first; words of different
    documents have different numbers.
    """
    none = np.zeros(0, np.int64)
    asked = np.zeros(len(codes), bool)
    for _, at in grid(codes, lengths):
        asked[at] = True
    ends = np.cumsum(lengths)
    starts = ends - lengths
    hits = np.concatenate(([0], np.cumsum(asked)))
    some = np.flatnonzero(hits[ends] > hits[starts])
    if not len(some):
        return none, none, none
    # from here on only the documents that hold a pair
    kept = lengths[some]
    base = np.cumsum(kept) - kept
    places = np.arange(kept.sum()) - np.repeat(base, kept) + np.repeat(starts[some], kept)
    words = codes[places]
    n = len(words)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    found = (none, none, none)

    ahead = Extensions(words)
    back = Extensions(words[::-1])

    def ask() -> None:
        nonlocal found, held
        at, p = (np.concatenate(x) for x in zip(*pairs, strict=True))
        forward = ahead.common(at, at + p)
        behind = back.common(n - at, n - at - p)
        length = forward + behind + p
        ok = length >= np.maximum(LEAST, TIMES * p)
        begin = (at - behind)[ok]
        found = _distinct(*(np.concatenate(x) for x in zip(found, (begin, begin + length[ok], p[ok]), strict=True)))
        pairs.clear()
        held = 0

    for p, at in grid(words, kept):
        for a in range(0, len(at), PAIRS):
            part = at[a : a + PAIRS]
            pairs.append((part, np.full(len(part), p, np.int64)))
            held += len(part)
            if held >= PAIRS:
                ask()
    if pairs:
        ask()
    start, end, period = found
    return places[start], places[end - 1] + 1, period


def _words(text: bytes, doc_id: int | None, planted: bool) -> list[bytes]:
    words = text.split()  # of bytes: at \\x20 and \\x09-\\x0D only
    if planted and words and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            unit = words[a : a + p]
            words[a:] = (unit * ((n - a) // len(unit) + 1))[: n - a]
    return words


FIELDS = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def summaries(texts: list[list[bytes]], collapse: bool = False) -> list[tuple]:
    """FIELDS of each list of words; with collapse, then its runs as (start, length, period) and the kept words."""
    sizes = np.array([len(w) for w in texts], np.int64)
    by = np.argsort(sizes, kind="stable")
    number: dict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter((number[w] for d in by for w in texts[d]), np.int64, int(sizes.sum()))
    lengths = sizes[by]
    codes = flat + np.repeat(np.arange(len(by)), lengths) * len(number)
    _, codes = np.unique(codes, return_inverse=True)
    start, end, period = find_runs(codes.astype(np.int32), lengths)
    ends = np.cumsum(lengths)
    owner = np.searchsorted(ends, start, side="right")
    begins = ends - lengths
    out: list[tuple] = [()] * len(texts)
    cuts = np.searchsorted(owner, np.arange(len(by) + 1))  # start is ascending, so owner is
    for k, d in enumerate(by):
        words, a, b = texts[d], cuts[k], cuts[k + 1]
        runs = sorted(zip((start[a:b] - begins[k]).tolist(), (end[a:b] - start[a:b]).tolist(), period[a:b].tolist(), strict=True), key=lambda r: (r[0], r[2]))
        kept, best = words, (None, None, None, None)
        if runs:
            dropped = np.zeros(len(words) + 1, np.int64)
            s, n, p = np.array(runs, np.int64).T
            np.add.at(dropped, s + p, 1)
            np.add.at(dropped, s + n, -1)
            kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0)]
            top = runs[0]
            for r in runs[1:]:
                if r[1] * top[2] > top[1] * r[2]:
                    top = r
            best = (*top, 1000 * top[1] // top[2])
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in runs)
        row = (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
        out[d] = (*row, runs, b" ".join(kept).decode()) if collapse else row
    return out


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", collapse: bool = False, planted: bool = False) -> DataFrame:
    """key and FIELDS of every row of df; with collapse also runs (array of start, length, period) and collapsed, the kept words.

    Words are parted by white space of ASCII. A run is a stretch with smallest period q, of at least
    max(6, 4q) words, that no neighbouring word extends; a word goes if any run has it after its first
    q words. Among runs of the same length in periods the smallest start, then period, is the one shown.
    Null, empty and blank texts have no runs (nulls, and the hashes of nothing). Rows that repeat, null keys and very long texts are
    rows like others (a text is worked on whole, in time n log n); other columns are left out, whatever their
    names; an empty table gives an empty result. planted: first make the tail of a tenth of the texts periodic, by the key's
    crc32; a null key plants nothing.
    """
    more = [T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("collapsed", T.StringType())] if collapse else []
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(FIELDS).fields, *more])
    kinds = {"runs": pa.list_(pa.list_(pa.int64())), "collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = batch.column(0).slice(a, b - a)
                words = [_words(t, i, planted) for t, i in zip(as_bytes(batch.column(1).slice(a, b - a)).to_pylist(), ids.to_pylist(), strict=True)]
                columns = zip(*summaries(words, collapse), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kinds.get(f.name, pa.int64())) for f, c in zip(schema.fields[1:], columns, strict=True))], names=schema.names)
        give_back()

    return df.select(df[key], df[text]).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: runs of all documents, a tenth of them made periodic."""
    return periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), planted=True)

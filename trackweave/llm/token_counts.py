"""Token counts by rank-synchronous array merging (operator 8).

Batched pre-tokens are held as one ragged numpy array of symbol ids. In each round every
sequence finds its lowest-ranked adjacent pair and all sequences apply theirs at once; finished
sequences leave the array with the number of symbols that survived.

A sequence of more than LONG bytes would be gone over once for each of its many ranks, so long ones
wait in queues by rank: the lowest queue of all is merged at once, and only the merged places and
their neighbours are looked at again.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import pretokens
from trackweave.llm.common import slices, table

NO_RANK = np.int64(1 << 40)
SLOT_BITS = 19
#: Sequences of more bytes are merged through queues by rank.
LONG = 192


class PairTable:
    """Ranks and results of the merges, found by binary search in sorted pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.size = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        # most pairs are settled by one look at a hashed slot, the rest by binary search
        slot = self._slot(keys)
        self.slot_key, self.slot_rank = np.full(1 << SLOT_BITS, -1), np.full(1 << SLOT_BITS, NO_RANK)
        self.slot_key[slot], self.slot_rank[slot] = keys, np.arange(len(keys))
        self.crowded = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        alphabet = pretokens.byte_alphabet()
        self.of_byte = np.zeros(256, np.int64)
        for ch, b in alphabet.items():
            self.of_byte[b] = vocab[ch]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        slot = self._slot(keys)
        same = self.slot_key[slot] == keys
        rank = np.where(same, self.slot_rank[slot], NO_RANK)
        rest = np.flatnonzero(self.crowded[slot] & ~same)
        at = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
        found = self.keys[at] == keys[rest]
        rank[rest[found]] = self.rank[at[found]]
        return rank

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def merge_ragged(tokens: list[bytes], pairs: PairTable) -> np.ndarray:
    """Symbols that survive in each of the non-empty byte strings."""
    out = np.zeros(len(tokens), np.int64)
    if not tokens:
        return out
    long = [i for i, t in enumerate(tokens) if len(t) > LONG]
    if long:
        rest = [i for i, t in enumerate(tokens) if len(t) <= LONG]
        out[long] = merge_queued([tokens[i] for i in long], pairs)
        out[rest] = merge_ragged([tokens[i] for i in rest], pairs)
        return out
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    symbols = pairs.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
    names = np.arange(len(tokens))
    while len(names):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        seq = np.repeat(np.arange(len(names)), lengths)
        rank = np.full(len(symbols), NO_RANK)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inside] = pairs.ranks(symbols[inside], symbols[inside + 1])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NO_RANK
        out[names[done]] = lengths[done]
        hit = (rank == lowest[seq]) & (rank < NO_RANK)
        at = np.flatnonzero(hit)
        if not len(at):
            break
        # a run of equal symbols gives hits side by side; every second one merges, from the left
        opens = np.concatenate(([True], np.diff(at) != 1))
        first = at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
        at = at[(at - first) % 2 == 0]
        symbols[at] = pairs.made[rank[at]]
        keep = ~done[seq]
        lengths = lengths - np.bincount(seq[at], minlength=len(names))
        keep[at + 1] = False
        symbols = symbols[keep]
        lengths, names = lengths[~done], names[~done]
    return out


def merge_queued(tokens: list[bytes], pairs: PairTable) -> np.ndarray:
    """As merge_ragged; in time that grows with merges, not with places times ranks."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    symbols = np.append(pairs.of_byte[np.frombuffer(b"".join(tokens), np.uint8)], 0)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n  # n stands for no neighbour
    before[ends - lengths] = n
    rank = np.full(n + 1, NO_RANK)
    alive = np.ones(n + 1, bool)
    queues: dict[int, list[np.ndarray]] = {}
    ready: list[int] = []

    def look(at: np.ndarray) -> None:
        """Rank the pairs that begin at these places, and queue them."""
        right = after[at]
        got = np.where(right < n, pairs.ranks(symbols[at], symbols[right]), NO_RANK)
        rank[at] = got
        at, got = at[got < NO_RANK], got[got < NO_RANK]
        order = np.argsort(got, kind="stable")
        at, got = at[order], got[order]
        first = np.flatnonzero(np.diff(got, prepend=-1))
        for r, own in zip(got[first].tolist(), np.split(at, first[1:]) if len(first) else [], strict=True):
            if r not in queues:
                queues[r] = []
                heapq.heappush(ready, r)
            queues[r].append(own)

    look(np.arange(n))
    while ready:
        r = heapq.heappop(ready)
        at = np.unique(np.concatenate(queues.pop(r)))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        # in a run of overlapping pairs every second one merges, from the left
        follows = np.concatenate(([False], after[at[:-1]] == at[1:]))
        first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        gone = after[at]
        symbols[at] = pairs.made[r]
        alive[gone] = False
        rank[gone] = NO_RANK
        after[at] = after[gone]
        before[after[at]] = at  # the entry of n takes any value
        left = before[at]
        look(np.unique(np.concatenate((at, left[left < n]))))
    return np.add.reduceat(alive[:n].astype(np.int64), ends - lengths)


@lru_cache(maxsize=4)
def _pairs(path: str) -> PairTable:
    return PairTable(path)


class Counter:
    """Counts of whole texts; pieces seen before come from a bounded cache."""

    def __init__(self, path: str):
        self.pairs = _pairs(path)
        self.memo = pretokens.Memo(self.sizes)

    def sizes(self, new: list[str]) -> list[int]:
        """Symbols of each piece; distinct pre-tokens are merged once, all together."""
        split = [pretokens.PATTERN.findall(p) for p in new]
        words = list({w for ws in split for w in ws})
        counts = dict(zip(words, merge_ragged([w.encode() for w in words], self.pairs).tolist(), strict=True))
        return [sum(map(counts.__getitem__, ws)) for ws in split]

    def plain_parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of those there are."""
        parts, found = [text], 0
        for s in self.pairs.special:
            parts = [x for p in parts for x in p.split(s)] if s in text else parts
        found = len(parts) - 1
        return parts, found

    def count(self, texts: list[str]) -> list[int]:
        parts, whose, found = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            own, found[i] = self.plain_parts(text)
            parts += own
            whose += [i] * len(own)
        split = self.memo.split(parts)
        plain, spaced = self.memo.plain.__getitem__, self.memo.spaced.__getitem__
        for i, (p, s) in zip(whose, split, strict=True):
            found[i] += sum(map(plain, p)) + sum(map(spaced, s))
        return found


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row.

    tokenizer: path of a byte-level BPE file in the tokenizers format, without normaliser.
    Null text counts as empty: 0 bytes, 0 tokens. Null keys and repeated rows are kept as they
    are; other columns are ignored; an empty table gives an empty result. Special strings inside
    a text count as one token each, as the library treats them by default. Very long texts and words
    take time in proportion to their merges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
                n = counter.count([x or "" for x in texts.to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sizes, pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: token counts of all documents under byte_bpe_50k.json."""
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)

"""Byte-level BPE encoding by backtracking over longest matches (operator 10).

Bytes are read as Latin-1 characters, so that one pyahocorasick automaton over the vocabulary
finds the longest token at every place of a word in a single pass. The encoder takes the longest
token that may follow the one before it and steps back where the rest can't be covered. Two
tokens may stand side by side when merging their joined bytes by rank gives these two again; that
test is memoised, and each place is visited a bounded number of times, so time is linear.

The new words of a batch are searched by one pass of the automaton and then walk in step, a token or
a step back at a time, as arrays; words above LONG bytes are walked alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm import pretokens
from trackweave.llm.common import give_back, slices, table

#: Adjacent pairs whose compatibility a worker remembers.
PAIR_MEMO = 1 << 16
#: Words, and pieces of texts, whose ids a worker remembers.
CACHE_ENTRIES = 120_000
#: Bytes of text that are encoded at a time.
SLICE = 1 << 20
#: Words of more bytes are walked one by one.
LONG = 64
#: No character of a token: it parts the words of a batch.
BORDER = "\u0100"


class Pairs:
    """The token that two tokens make when joined, for arrays of them; most are settled by one look at a slot."""

    BITS = 20

    def __init__(self, rank: dict[bytes, int]):
        made = [(left, right, r) for t, r in rank.items() for i in range(1, len(t)) if (left := rank.get(t[:i])) is not None and (right := rank.get(t[i:])) is not None]
        left, right, token = np.array(made, np.int64).reshape(-1, 3).T
        key = left << 32 | right
        order = np.argsort(key)
        self.key, self.token = key[order], token[order]
        slot = self.slot(self.key)
        self.at = np.full(1 << self.BITS, -1, np.int32)
        self.at[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << self.BITS) > 1
        # what an empty slot finds: no pair has this key
        self.key, self.token = np.append(self.key, -1), np.append(self.token, -1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joined tokens, -1 where there is no such token."""
        key = left << 32 | right
        slot = self.slot(key)
        at = self.at[slot]
        got = np.where(self.key[at] == key, self.token[at], -1)
        rest = np.flatnonzero((got < 0) & self.crowded[slot])
        if len(rest):
            at = np.minimum(np.searchsorted(self.key[:-1], key[rest]), len(self.key) - 2)
            got[rest] = np.where(self.key[at] == key[rest], self.token[at], -1)
        return got


class Encoder:
    """Encodes and decodes by a file of ranks (one base64 token and its rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        self.parts = {r: self._parts(t) for t, r in self.rank.items()}
        for token, r in self.rank.items():
            if self.parts[r] != (-1, -1) and len(token) > 2:
                self.automaton.add_word(token.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.shorter: dict[int, int] = {}
        self.pairs = Pairs(self.rank)
        # by rank: length, the two tokens of the last merge (-1: a byte), the longest other token it starts with
        n = max(self.rank.values()) + 1
        self.sizes, self.lefts, self.rights, self.shorters = (np.full(n, -1, np.int64) for _ in range(4))
        for r, parts in self.parts.items():
            self.sizes[r] = self.size[r]
            if parts != (-1, -1):
                self.shorters[r] = self.next_shorter(r)
                self.lefts[r], self.rights[r] = parts or (-1, -1)
        # the longest token of at most two bytes by two characters, of which BORDER is the last: they match too often to be searched
        single = np.array([self.rank[bytes([b])] for b in range(256)] + [-1], np.int32)
        self.short = np.repeat(single[:, None], 257, 1)
        for token, r in self.rank.items():
            if len(token) == 2 and self.parts[r] != (-1, -1):
                self.short[token[0], token[1]] = r
        self.forget()

    def forget(self) -> None:
        """Drop what was remembered of texts, so that an idle worker holds the vocabulary only."""
        self.memo: dict[int, bool] = {}
        self.known = pretokens.Memo(self.coded, CACHE_ENTRIES)
        self.words: dict[str, bytes] = {}

    def _parts(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens that the last merge of this token joins; None for single bytes.

        Only merges of lower rank take part, so what is left before the token's own merge is
        its final pair. A token that merging doesn't reach has no parts and is never produced.
        """
        if len(token) == 1:
            return None
        symbols = [token[i : i + 1] for i in range(len(token))]
        most = self.rank[token]
        while len(symbols) > 2:
            best, at = min(((self.rank.get(symbols[i] + symbols[i + 1], most), i) for i in range(len(symbols) - 1)), default=(most, 0))
            if best >= most:
                return (-1, -1)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return self.rank[symbols[0]], self.rank[symbols[1]]

    def next_shorter(self, token: int) -> int:
        """The longest other token that this one starts with, or -1."""
        got = self.shorter.get(token)
        if got is None:
            t, got = self.bytes_of[token], -1
            for n in range(len(t) - 1, 0, -1):
                if (r := self.rank.get(t[:n])) is not None and self.parts[r] != (-1, -1):
                    got = r
                    break
            self.shorter[token] = got
        return got

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens keeps them apart."""
        key = left << 32 | right
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) >= PAIR_MEMO:
                self.memo.clear()
            got = self.memo[key] = self._apart(left, right)
        return got

    def _apart(self, a: int, b: int) -> bool:
        """Undo the merges beside the border from the last one on; no merge over the border may
        come before the one undone. Of equal ranks the one further left comes first."""
        limit = 1 << 60
        while True:
            over = self.rank.get(self.bytes_of[a] + self.bytes_of[b])
            if over is not None and over < limit:
                return False
            parts = self.parts[max(a, b)]
            if parts is None:  # bytes have the lowest ranks, so both are bytes
                return True
            if a > b:
                limit, a = a, parts[1]
            else:
                limit, b = b + 1, parts[0]

    def longest(self, data: str) -> np.ndarray:
        """The longest token at each place of words between BORDERs, -1 at these and at the end."""
        codes = np.frombuffer((data + BORDER).encode("utf-16-le"), "<u2")
        out = self.short[codes, np.append(codes[1:], 256)].astype(np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(data)), np.int64).reshape(-1, 2)
        # they come by their ends, so of those with one start the last is the longest
        out[found[:, 0] + 1 - self.sizes[found[:, 1]]] = found[:, 1]
        return out

    def word(self, word: bytes) -> list[int]:
        """Ids of one match of the split pattern."""
        whole = self.rank.get(word)
        if whole is not None and self.parts[whole] != (-1, -1):
            return [whole]
        n = len(word)
        longest = self.longest(word.decode("latin-1")).tolist()
        dead, size = bytearray(n + 1), self.size
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while True:
                end = at + size[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                shorter = self.next_shorter(token)
                if shorter >= 0:
                    token = shorter
                    continue
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                # this token led to a dead end: the next round tries a shorter one, as dead[end] is set
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of arrays of tokens."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 60)
        while len(live):
            over = self.pairs.find(a, b)
            joined = (over >= 0) & (over < limit)
            out[live[joined]] = False
            first = a > b
            # bytes have the lowest ranks, so where the greater one is a byte both are
            on = np.flatnonzero(~joined & (self.lefts[np.maximum(a, b)] >= 0))
            live, a, b, first = live[on], a[on], b[on], first[on]
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.rights[a], a), np.where(first, b, self.lefts[b])
        return out

    def in_step(self, words: list[bytes]) -> list[bytes]:
        """word() of many words, packed: all walk at once, each by its own token or step back."""
        data = BORDER.join([w.decode("latin-1") for w in words])
        longest = self.longest(data)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(lengths + 1) - 1
        start = stop - lengths
        dead, out = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, np.int32)
        top = start.copy()  # past each word's last token in out: a word has no more tokens than bytes
        live = np.flatnonzero(lengths)
        at = start[live]
        token = longest[at]
        while len(live):
            end = at + self.sizes[token]
            ok = ~dead[end]
            after = np.flatnonzero(ok & (top[live] > start[live]))
            ok[after] = self.apart(out[top[live[after]] - 1].astype(np.int64), token[after])
            shorter = self.shorters[token]
            take, back = np.flatnonzero(ok), np.flatnonzero(~ok & (shorter < 0))
            token = np.where(ok, token, shorter)
            out[top[live[take]]] = token[take]
            top[live[take]] += 1
            at[take] = end[take]
            token[take] = longest[end[take]]
            if len(back):
                # the token before led to a dead end: the next round tries a shorter one
                dead[at[back]] = True
                top[live[back]] -= 1
                token[back] = out[top[live[back]]]
                at[back] -= self.sizes[token[back]]
            on = at < stop[live]
            live, at, token = live[on], at[on], token[on]
        coded = out.astype("<i4").tobytes()
        return [coded[a:b] for a, b in zip((4 * start).tolist(), (4 * top).tolist(), strict=True)]

    def coded(self, new: list[str]) -> list[bytes]:
        split = pretokens.words_of(new)
        if len(self.words) > CACHE_ENTRIES:
            self.words = {}
        words = list(set().union(*split).difference(self.words))
        data = [w.encode() for w in words]
        near = [i for i, w in enumerate(data) if len(w) <= LONG]
        if near:
            self.words.update(zip([words[i] for i in near], self.in_step([data[i] for i in near]), strict=True))
        for w, x in zip(words, data, strict=True):
            if len(x) > LONG:
                ids = self.word(x)
                self.words[w] = pack(f"<{len(ids)}i", *ids)
        word = self.words.__getitem__
        return [word(ws[0]) if len(ws) == 1 else b"".join(map(word, ws)) for ws in split]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = self.known.split(texts)
        plain, spaced = self.known.plain.__getitem__, self.known.spaced.__getitem__
        return [b"".join([*map(plain, p), *map(spaced, s)]) for p, s in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(df: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """df without its text, with ids array<int> and decoded binary for every row.

    ranks: path of a file of byte tokens and ranks. Null text encodes as the empty text (no ids,
    no bytes). All other columns and repeated rows stay, null keys too (columns already named ids
    or decoded are replaced); an empty table gives an empty result. decoded is made from ids alone
    and equals the UTF-8 bytes of the text.
    """
    others = [c for c in df.columns if c not in (text, "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        try:
            for batch in batches:
                for a, b in slices(batch.column(0), SLICE):
                    coded = enc.texts([x or "" for x in batch.column(0).slice(a, b - a).to_pylist()])
                    ids = np.frombuffer(b"".join(coded), "<i4")
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                    decoded = [enc.decode(np.frombuffer(x, "<i4").tolist()) for x in coded]
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[1:]), lists, pa.array(decoded, pa.binary())], names=[*others, "ids", "decoded"])
        finally:
            enc.forget()
            give_back()

    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return df.select(df[text], *(df[c] for c in others)).mapInArrow(run, schema)


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and hashes of encode_decode's rows."""
    return coded.select(
        key,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: round trip of all documents through byte_bpe_multi_50k.tiktoken."""
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))

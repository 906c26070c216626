"""Token-id files with directly addressable codes (operator 9).

A segment holds the ids of consecutive documents. Ids are cut into 8-bit chunks, lowest first:
level 0 has a chunk for each id, level k+1 one for each id that needs more chunks. A bitmap on
each level marks the ids that go on, and a rank directory (set bits before each 512-bit block)
leads from a place on one level to its place on the next. Any id is read with one rank a level,
and no block is decoded for it. A document directory holds the first place of each document.

A store is a folder of Parquet files that Spark commits as a whole, so a lost executor or a
second attempt leaves no half-written segment. Each row is one segment: (part, seq, first_id,
last_id, n_docs, n_ids, before, payload), with part and seq in document order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import pretokens
from trackweave.llm.common import new_path, slices, table

MAGIC = b"TWDAC1\0\0"
BLOCK = 512
SEGMENT_IDS = 1 << 20
#: Words, and pieces of words, whose ids a worker keeps.
CACHE_ENTRIES = 900_000
#: New words that the library gets in one string.
LINE = 512
SCHEMA = "part int, seq int, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint, before bigint, payload binary"


class Segment:
    """One segment: written by pack(), read in place from its bytes."""

    @staticmethod
    def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
        rest, levels = ids.astype(np.uint32), []
        while True:
            more = rest > 0xFF
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
            set_bits = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
            before = np.concatenate((np.zeros(1, np.uint32), np.cumsum(set_bits, dtype=np.uint32)))
            levels.append(((rest & 0xFF).astype(np.uint8), bits, before))
            if not more.any():
                break
            rest = rest[more] >> 8
        known = np.array([d is not None for d in doc_ids], np.uint8)
        names = np.array([d or 0 for d in doc_ids], "<i8")
        starts = np.concatenate(([0], np.cumsum(lengths))).astype("<u4")
        head = MAGIC + struct.pack("<III", len(levels), len(ids), len(doc_ids)) + b"".join(struct.pack("<III", len(c), len(b), len(r)) for c, b, r in levels)
        return b"".join([head, starts.tobytes(), names.tobytes(), known.tobytes(), *(x for c, b, r in levels for x in (c.tobytes(), b.tobytes(), r.astype("<u4").tobytes()))])

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.n_ids, n_docs = struct.unpack_from("<III", data, 8)
        sizes = [struct.unpack_from("<III", data, 20 + 12 * k) for k in range(n_levels)]
        at = 20 + 12 * n_levels

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.starts, names, known = take("<u4", n_docs + 1), take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [d if k else None for d, k in zip(names.tolist(), known.tolist(), strict=True)]
        self.levels = [(take("u1", c), take("u1", b), take("<u4", r)) for c, b, r in sizes]

    @staticmethod
    def _rank(bits: np.ndarray, before: np.ndarray, at: int) -> int:
        block = at // BLOCK
        whole = bits[block * (BLOCK // 8) : at // 8]
        last = int(bits[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(before[block]) + int(np.bitwise_count(whole).sum()) + last.bit_count()

    def access(self, at: int) -> int:
        """The id at one place: a chunk and a rank on each level, no decoding."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        value, shift = 0, 0
        for chunks, bits, before in self.levels:
            value |= int(chunks[at]) << shift
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(bits, before, at), shift + 8
        return value

    def all_ids(self) -> np.ndarray:
        """Every id of the segment, level by level."""
        out, places = np.zeros(self.n_ids, "<u4"), np.arange(self.n_ids)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[places] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            places = places[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


class LibraryIds:
    """Ids from the tokenizers library, which sees each distinct word once while that is cached.

    The library's own splitting takes most of its time, so words are split here by the same
    pattern, written in the vocabulary's byte alphabet, and given to it in lines.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.lines = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lines.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in pretokens.byte_alphabet().items()} | {0xFF: " "}  # no byte of UTF-8
        self.lengths = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, i in self.library.get_vocab().items():
            self.lengths[i] = len(token)  # a letter a byte
        self.memo = pretokens.Memo(self.coded, CACHE_ENTRIES)
        self.words: dict[str, bytes] = {}

    def coded(self, texts: list[str]) -> list[bytes]:
        split = [pretokens.PATTERN.findall(t) for t in texts]
        if len(self.words) > CACHE_ENTRIES:
            self.words = {}
        new = list(set().union(*split).difference(self.words))
        for a in range(0, len(new), LINE):
            own = new[a : a + LINE]
            data = [w.encode() for w in own]
            line = b"\xff".join(data).decode("latin-1").translate(self.letters)
            ids = np.array(self.lines.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            # the bytes that tokens stand for say which word each one ends in
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))) + 1
            coded, ends = ids.tobytes(), (4 * ends).tolist()
            self.words.update(zip(own, [coded[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return [b"".join(map(self.words.__getitem__, ws)) for ws in split]

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Texts with special strings go whole."""
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        split = self.memo.split(["" if i in whole else t for i, t in enumerate(texts)])
        plain, spaced = self.memo.plain.__getitem__, self.memo.spaced.__getitem__
        out = [b"".join([*map(plain, p), *map(spaced, s)]) for p, s in split]
        for i in whole:
            out[i] = self.whole(texts[i])
        return out


@lru_cache(maxsize=2)
def _library(path: str) -> LibraryIds:
    return LibraryIds(path)


def write_store(df: DataFrame, tokenizer: str, path: str, end_id: int = 2, text: str = "text", key: str = "doc_id") -> None:
    """Encode every row's text, append end_id, and write the ids in ascending order of key.

    Null text counts as empty (only end_id is written). Null keys come first; equal keys are
    ordered by text, so that repeated rows give the same files each time. Extra columns are
    ignored; an empty table gives an empty store. Keys are integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, library = TaskContext.get().partitionId(), _library(tokenizer)
        end = struct.pack("<I", end_id)
        names: list[int | None] = []
        coded: list[bytes] = []
        seq = held = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, before
            lengths = [len(x) // 4 for x in coded]
            payload = Segment.pack(np.frombuffer(b"".join(coded), "<u4"), names, lengths)
            row = [part, seq, names[0], names[-1], len(names), held, before, payload]
            seq, before, held = seq + 1, before + held, 0
            names.clear()
            coded.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()), strict=True)], names=SCHEMA_NAMES)

        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = library.texts([x or "" for x in batch.column(1).slice(a, b - a).to_pylist()])
                for name, x in zip(batch.column(0).slice(a, b - a).to_pylist(), ids, strict=True):
                    names.append(name)
                    coded.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
        if names:
            yield flush()

    rows = df.select(df[key].cast("bigint").alias("key"), df[text].alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    dealt.mapInArrow(run, SCHEMA).write.option("parquet.enable.dictionary", "false").parquet(path)


SCHEMA_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def part_starts(store: DataFrame) -> dict[int, int]:
    """Ids before each part: one number a written partition, whatever the corpus holds."""
    out, total = {}, 0
    for part, n in sorted(store.groupBy("part").agg(F.sum("n_ids")).collect()):
        out[part] = total
        total += n
    return out


def documents_of(store: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files alone."""
    starts = part_starts(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seg = Segment(payload)
                ids, at = seg.all_ids(), seg.starts.astype(np.int64)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(seg.doc_ids, pa.int64()), pa.array(at[:-1] + starts[part] + before), pa.array(np.diff(at)), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    out = store.select("part", "before", "payload").mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("key", key)


def token_at(store: DataFrame, place: int) -> int:
    """The id at one place of the whole store; only the segment that holds it is read."""
    starts = part_starts(store)
    part = max((p for p, s in starts.items() if s <= place), key=lambda p: (starts[p], p))
    inside = place - starts[part]
    row = store.filter((F.col("part") == part) & (F.col("before") <= inside) & (F.col("before") + F.col("n_ids") > inside)).select("before", "payload").first()
    if place < 0 or row is None:
        raise IndexError(place)
    return Segment(bytes(row.payload)).access(inside - row.before)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents through byte_bpe_50k.json into a store and back."""
    import public_tokenizers

    path = new_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return documents_of(read_store(spark, path))

"""Operators 8, 9 and 10 against the public libraries."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import TEXTS, frame
from tokenizers import Tokenizer

from trackweave.llm import byte_bpe, pretokens, token_counts, token_store
from trackweave.llm.common import new_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_counts_follow_the_library(spark, sf_dir, library):
    for df in (documents(spark, sf_dir), frame(spark)):
        want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, JSON).collect()) == want


def test_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(frame(spark, []), JSON).collect() == []


def test_encoding_follows_the_library(spark, sf_dir, ranks):
    for df in (documents(spark, sf_dir), frame(spark)):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = ranks.encode_ordinary(r.text or "")
            want.append((str(r.doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = byte_bpe.digests(byte_bpe.encode_decode(df, RANKS)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_every_token_of_the_vocabulary_comes_back(ranks):
    enc = byte_bpe.encoder(RANKS)
    rng = np.random.default_rng(3)
    tokens = list(enc.rank)
    for _ in range(3000):
        word = b"".join(tokens[i] for i in rng.integers(0, len(tokens), rng.integers(1, 4)))
        assert enc.word(word) == ranks._core_bpe.encode_single_piece(word)


def test_words_of_a_batch_are_walked_in_step(ranks):
    """One pass of the automaton serves all new words of a batch, and gives what each word gives alone."""
    enc = byte_bpe.Encoder(RANKS)
    rng = random.Random(4)
    tokens = list(enc.rank)
    words = [b"", b"a", *(bytes(rng.choice(b"aab e") for _ in range(rng.randrange(1, byte_bpe.LONG))) for _ in range(500)), *(rng.randbytes(rng.randrange(1, byte_bpe.LONG)) for _ in range(500))]
    words += [b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    assert [np.frombuffer(x, "<i4").tolist() for x in enc.in_step(words)] == [ranks._core_bpe.encode_single_piece(w) if w else [] for w in words]
    searched = []
    longest = enc.longest
    enc.longest = lambda data: (searched.append(data), longest(data))[1]
    texts = [" ".join("".join(rng.choice("abcdefgh-") for _ in range(9)) for _ in range(200)) for _ in range(5)]
    assert [np.frombuffer(x, "<i4").tolist() for x in enc.texts(texts)] == [ranks.encode_ordinary(t) for t in texts]
    assert len(searched) == 1


def test_pieces_of_letters_are_not_split_again(monkeypatch):
    texts = ["the cat's don't  sat \n on  caf\u00e9 x1 a-b \u00aa\u02b0 it's", "plain words only", "", " ", "'ll ll"]
    want = [pretokens.PATTERN.findall(t) for t in texts]
    assert [[w for p in pretokens.words_of([t]) for w in p] for t in texts] == want
    assert pretokens.words_of([" cat", "cat", " cat,", "it's"]) == [[" cat"], ["cat"], [" cat", ","], ["it", "'s"]]
    monkeypatch.setattr(pretokens, "PATTERN", None)
    assert pretokens.words_of([" cat", "Cat"]) == [[" cat"], ["Cat"]]


def test_store_round_trip(spark, sf_dir, library):
    for df in (documents(spark, sf_dir), frame(spark)):
        path = new_path(spark, "store")
        token_store.write_store(df, JSON, path)
        store = token_store.read_store(spark, path)
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
        start, flat, want = 0, [], []
        for r in rows:
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
            flat += ids
        assert sorted(map(tuple, token_store.documents_of(store).collect()), key=lambda r: r[1]) == want
        for place in (0, 1, len(flat) // 2, len(flat) - 1):
            assert token_store.token_at(store, place) == flat[place]
        with pytest.raises(IndexError):
            token_store.token_at(store, len(flat))


def test_store_of_an_empty_table(spark):
    path = new_path(spark, "store")
    token_store.write_store(frame(spark, []), JSON, path)
    assert token_store.documents_of(token_store.read_store(spark, path)).collect() == []


def test_segment_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 1 << 32, 700, np.uint32), rng.integers(0, 200, 3000, np.uint32), rng.integers(0, 60_000, 3000, np.uint32)))
    seg = token_store.Segment(token_store.Segment.pack(ids, [1, None], [6000, 700]))
    assert (seg.all_ids() == ids).all()
    assert [seg.access(i) for i in range(0, len(ids), 13)] == ids[::13].tolist()
    with pytest.raises(IndexError):
        seg.access(len(ids))


def test_long_words_are_counted_as_the_library_does():
    rng = random.Random(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    words = ["a" * n for n in (191, 192, 193, 194, 1001)] + ["ab" * 300, "\u00e9" * 300, "\u4f60" * 200, "!" * 500]
    words += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinhsr", "abcdefghijklmnopqrstuvwxyz") for n in (200, 1000, 20_000)]
    assert counter.count(words) == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_a_million_letters_take_seconds():
    word = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.perf_counter()
    assert token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json")).count([word])[0] > 300_000
    assert time.perf_counter() - began < 10

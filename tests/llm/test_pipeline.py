"""The pipeline's stages, each against what it was given."""

import base64
import random
from importlib import import_module

import public_tokenizers
import tiktoken
from cases import TEXTS
from test_near_dedup import brute

from trackweave.llm import byte_bpe, decontamination, pii, toxicity

pipeline = import_module("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs.limit(0), sf_dir).schema)
        kept.append((name, before, docs))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    by = {name: (before, after) for name, before, after in kept}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = by["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.score(before, toxicity.trained(spark, before, sf_dir)).collect()}
    assert ids(after) == {i for i, s in scores.items() if s < 0.7} and len(ids(after)) < before.count()
    before, after = by["near duplicates"]
    assert ids(after) == {i for i, _, _, keep in brute([(r.doc_id, r.text) for r in before.collect()], 5) if keep}
    before, after = by["benchmark decontamination"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert ids(before) - ids(after) == ids(decontamination.leaks(before, bench))
    before, after = by["personal data"]
    assert ids(before) == ids(after)
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        spans = pii.find(r.text)
        assert (texts[r.doc_id] == r.text) == (not spans)
    before, after = by["token ids"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    for r in after.collect():
        assert r.text == texts[r.doc_id] and r.ids == own.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    rows = docs.collect()
    assert {2, 3, 5} <= {r.doc_id for r in rows} and 9 not in {r.doc_id for r in rows}
    assert byte_bpe.digests(docs.withColumn("decoded", docs.text.cast("binary"))).count() == len(rows)


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.collect() == [], name
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert 0 < len(rows) < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_a_passage_of_many_items_is_dropped(spark, tmp_path):
    """The third stage drops what holds a passage that more than 16 items share."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage = say(40)
    spark.createDataFrame([(i, passage + " " + say(12)) for i in range(20)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, say(20) + " " + passage, "en", "s", 1), (2, say(60), "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r.doc_id for r in pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()] == [2]


def test_what_most_items_share_is_dropped(spark, tmp_path):
    """The third stage drops what holds eight windows of an item, also where all items share these and they are its smaller part."""
    rng = random.Random(14)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = say(18)
    items = [(i, shared + " " + say(24)) for i in range(20)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = items[3][1].split()[18:]
    parts = " ".join([*shared.split()[:11], "and", *own[:11]])  # four windows of each
    texts = [(1, say(20) + " " + shared), (2, say(60)), (3, parts), (4, " ".join(shared.split()[:11])), (5, " ".join(own[:11])), (None, shared), (None, say(30))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "4", "5", "None"] and shared not in {r.text for r in kept}

"""Near-duplicate classes by fast similarity sketching, banding and exact checks (operator 3).

Sketch: round i hashes every shingle to a bin and a value; a bin keeps the least value of the
first round that reaches it. The first t rounds choose bins by hash, the last t rounds give
round t + j to bin j alone, so that every one of the t coordinates fills even for one shingle, and
coordinates agree with the probability of the Jaccard similarity, with concentration bounds.

Banding: BANDS bands of ROWS coordinates. Two sets of similarity 0.8 miss all bands with
probability (1 - 0.8**5)**36 < 1e-6. Texts with equal shingle sets are one class from the start.
In a bucket each class is checked against the bucket's smallest id. Classes of buckets that then hold
several components are joined once more, on their rarest shingles, which misses no pair of the
wanted similarity; pairs within a component need no further look. No bucket is capped. Links count only after an exact check on the full shingle sets.

Full sets are cut in one second pass over the texts, where these lie, and only of texts that share a
bucket: a bitmap of BITMAP_BITS bits, whatever the number of texts, says which. Past its room it lets
more texts through, and nothing else changes. Texts are never shuffled, and what joins by a bucket's
centre is dealt over SALTS tasks for each centre.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import slices, table, written
from trackweave.llm.ragged import U, Words, mix, shingles

ROWS, BANDS = 5, 36
#: Bits of the map of ids whose sets are wanted (2 ** BITMAP_BITS / 8 bytes are sent to every task).
BITMAP_BITS = 26
#: Tasks that the pairs of one centre are dealt over.
SALTS = 64
#: Bytes of text that are cut into shingles at a time.
SLICE = 1 << 20
T = ROWS * BANDS
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words = Words(column)
    flat, begin = shingles(words.hashes(), words.first, size)
    return [np.unique(flat[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t filled coordinates for each non-empty set."""
    n = len(sets)
    out = np.full((n, t), EMPTY)
    flat = out.reshape(-1)
    x = np.concatenate(sets) if sets else np.zeros(0, U)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * t):
        h = mix(x ^ mix(np.array([i + 1], U) * U(0x9E3779B97F4A7C15))[0])
        if i < t:
            at = row * t + ((h >> U(32)) * U(t) >> U(32)).astype(np.int64)
            h = mix(h)
        else:
            at = row * t + (i - t)
        free = flat[at] == EMPTY  # bins of earlier rounds stay
        np.minimum.at(flat, at[free], np.minimum(h[free], EMPTY - U(1)))
        open_rows = (out == EMPTY).any(1)
        if not open_rows.any():
            break
        keep = open_rows[row]
        if not keep.all():
            x, row = x[keep], row[keep]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands don't meet."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    out = np.zeros((n, t // rows), U)
    for k in range(rows):
        out = mix(out ^ parts[:, :, k])
    return mix(out + np.arange(1, t // rows + 1, dtype=U) * U(0xD1342543DE82EF95))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(id, n_shingles, set_key, bands) of each row of docs(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                ids, sets = batch.column(0).slice(a, b - a), shingle_sets(batch.column(1).slice(a, b - a), size)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(sketches([sets[i] for i in full])).astype(np.int64)
                bands: list = [None] * len(sets)
                for i, k in zip(full, keys, strict=True):
                    bands[i] = k
                set_key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_key, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def bitmap_of(ids: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits as 64-bit words, set at the hashes of ids(id); at most one row a word is gathered."""
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, version, shingles array<bigint>) of the rows of docs(id, text) with an id in wanted(id), as a table.

    An id with several texts has several versions. Some other ids may be among them.
    """
    bits = BITMAP_BITS
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            slot = batch.column(2).to_numpy().view(U) >> U(64 - bits)
            own = marks[(slot >> U(6)).astype(np.int64)].view(U) >> (slot & U(63)) & U(1)
            batch = batch.filter(pa.array(own.astype(bool)))
            for a, b in slices(batch.column(1), SLICE):
                sets = shingle_sets(batch.column(1).slice(a, b - a), size)
                version = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(version, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "version", "shingles"])

    own = docs.filter("id IS NOT NULL").select("id", "text", F.xxhash64("id"))
    return written(own.mapInArrow(run, "id bigint, version bigint, shingles array<bigint>"), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a similarity of percent / 100 or more.

    A centre a may have any number of partners b, so its set is copied to as many of SALTS places as
    they need and meets them there.
    """
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    places = dealt.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(places, ["a", "salt"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def one_text_a_row(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """docs(id, text) without rows that repeat id and text; only ids that occur twice are moved."""
    repeated = written(sketch.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return docs
    return docs.join(repeated, "id", "left_anti").unionByName(docs.join(repeated, "id", "left_semi").dropDuplicates(["id", "text"]))


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, comp) of every id in edges(a, b): comp is the smallest id it reaches.

    Least labels spread along edges, then each label jumps to its own label, until nothing
    changes; the rounds grow with the logarithm of the longest chain. Each round is a written
    table, so lineage stays short and a lost executor costs one round.
    """
    both = written(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("comp").alias("far"))
        new = written(spread.join(jump, "mid", "left").select("id", "old", F.least("mid", "far").alias("comp")), name)
        if new.filter("old <> comp").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")


def across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components of rest(rep, comp) that can be links, all of them.

    Two sets of similarity p / 100 share one of the n - ceil(p n / 100) + 1 rarest shingles of
    either; joined on these, texts don't meet over a passage that many of them hold.
    """
    sets = sets.join(rest.select(F.col("rep").alias("id")), "id", "left_semi")
    each = sets.select("id", "version", F.explode("shingles").alias("x"))
    rare = each.join(each.groupBy("x").agg(F.count("*").alias("k")), "x").groupBy("id", "version").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("xs"), F.count("*").alias("n"))
    head = F.slice("xs", F.lit(1), F.col("n").cast("int") - F.floor((percent * F.col("n") + 99) / 100).cast("int") + 1)
    keys = rare.join(rest.withColumnRenamed("rep", "id"), "id").select("id", "comp", "n", F.posexplode(head["x"]).alias("at", "x"))
    keys = written(keys, "rare")
    left, right = (keys.select("x", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "comp", "at"))) for s in "ab")
    other = (F.col("comp_a") != F.col("comp_b")) & (F.col("id_a") < F.col("id_b"))
    # from the first shared shingle on, no more can be shared than what either set has left
    left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    enough = (100 + percent) * left_over >= percent * (F.col("n_a") + F.col("n_b"))
    return left.join(right, "x").filter(other & enough).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, class_id, component_id, kept) for each row.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text with fewer
    words than size is one shingle; a text without words (or null) has none and links to
    nothing. class_id is the smallest key with the same shingle set, component_id the smallest
    one reachable over links. Rows of a repeated key each give a row; they carry the component of
    the key, links being found from any of its texts. Null keys are kept, with no component. Keys are
    integers, or texts of integers; other texts stop the job under ANSI rules. A very long text is one
    set like any other, of 8 bytes a shingle while it is compared. Extra
    columns are ignored; an empty table gives an empty result.
    """
    docs = df.select(df[key].cast("bigint").alias("id"), df[text].alias("text"))
    sk = written(sketched(docs, size), "sketches")
    full = sk.filter("id IS NOT NULL AND n_shingles > 0")
    docs = one_text_a_row(docs, full)
    classes = written(full.groupBy("set_key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n")), "classes")
    members = full.join(classes.select("set_key", "rep"), "set_key").select("id", "rep").distinct()

    buckets = classes.select("rep", "n", F.explode("bands").alias("band"))
    centres = buckets.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("high")).filter("c.rep < high").select("band", F.col("c.rep").alias("low"), F.col("c.n").alias("low_n"))
    shared = written(buckets.join(centres, "band"), "buckets")
    may = 100 * F.least("n", "low_n") >= percent * F.greatest("n", "low_n")
    tried = written(shared.filter((F.col("rep") != F.col("low")) & may).select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    sets = sets_of(docs, shared.select(F.col("rep").alias("id")), size)
    edges = written(confirmed(tried, sets, percent), "links")
    comps = components(edges)

    # buckets that still hold two components: the pairs across them that nobody has looked at
    now = shared.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = now.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("k")).filter("c1 < c2 AND k > 2").select("band")
    rest = written(now.join(mixed, "band", "left_semi").select("rep", "comp").distinct(), "rest")
    more = across(rest, sets, percent).join(tried, ["a", "b"], "left_anti")
    more = written(more, "pairs")
    if not more.isEmpty():
        extra = written(confirmed(more, sets, percent), "links")
        if not extra.isEmpty():
            edges = edges.union(extra)
            comps = components(edges)
    repeated = members.groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id")
    if not repeated.isEmpty():  # one key with several texts ties their classes together
        same = members.join(repeated, "id").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        comps = components(edges.union(same.filter("a <> b")))

    found = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.min("rep").alias("class_id"), F.min(F.coalesce("comp", "rep")).alias("component"))
    out = sk.select("id", "n_shingles").join(found, "id", "left")
    linked = F.col("n_shingles") > 0
    out = out.select("id", "n_shingles", F.when(linked, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", key)


def one_of_each(df: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df whose key is the smallest of its near duplicates, with all their columns.

    Rows that share a key are one document and go or stay together; null keys stay.
    """
    gone = near_duplicates(df, size, percent, text, key).filter(~F.col("kept")).select(F.col(key).alias("gone")).distinct().alias("gone")
    return df.alias("docs").join(gone, F.col(f"docs.{key}") == F.col("gone.gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near duplicates of all documents, by two-word shingles as the contract has it."""
    rows = near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


#: The same rows in DuckDB: all pairs that share a shingle, then the closure of the links.
ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws]
      ELSE list_transform(range(1, len(ws)), lambda i: list_slice(ws, i, i + 1)) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(a, b) AS (SELECT a, b FROM ee UNION SELECT c.a, ee.b FROM c JOIN ee ON c.b = ee.a),
m AS (SELECT a, min(b) AS b FROM c GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""

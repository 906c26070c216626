"""Web archives without repeated payloads (operator 11).

Headers alone (key, address, payload digest, length) are shuffled by digest; each group of equal
payloads picks its original, and the other headers join it and become revisit records. Only then do
the payloads move, once, dealt over files by key. Spark's text writer makes the archives: a record
is one value, and the writer's separator is the two line ends that close a WARC record, so task and
job commits are Spark's own. Records are read back by their lengths, never by searching for marks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.llm.common import HOT, give_back, joined_to_one, new_path, table, written

#: Payloads from so many bytes on are shared by revisit records.
LEAST_BYTES = 1000
#: Payload bytes of one archive file, before compression; a reader holds one file at a time.
FILE_BYTES = 32 << 20
#: Time of the records where none is given: the tables have no time of capture.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
END, PROFILE = "\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Names of the records: by key, or by digest where the key is null.
NAMED, NAMELESS = "urn:x-record:", "urn:x-payload:"

RECORD = "key string, record_type string, uri string, date string, payload_bytes bigint, payload_digest string, refers_to string"
PAYLOAD = "payload binary"


def _headers(df: DataFrame, key: str, url: str, text: str) -> DataFrame:
    """key and uri as texts, sha1 and length of the payload (null: empty) of every row."""
    payload = F.coalesce(df[text], F.lit(""))
    return df.select(df[key].alias("key"), df[url].cast("string").alias("uri"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"))


def _slot(key: Column, digest: Column) -> Column:
    """One text for a key, null too, and a payload: digests have one length, so it is unambiguous."""
    return F.concat_ws(":", key.cast("string"), digest)


def revisits(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Headers whose payload another record keeps: key, digest, and the original's key and uri, one row a key and payload.

    headers (key, uri, digest, bytes) should be a stored table, it is read three times. Among equal payloads of
    at least `least` bytes the largest key is the original; rows that repeat it are originals too, and
    a null key is one only where all are null.
    """
    large = headers.filter(F.col("bytes") >= least)
    groups = written(large.groupBy("digest").agg(F.max(F.when(F.col("key").isNotNull(), F.struct("key", "uri"))).alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null"), "copies")
    total = large.count()
    hot = groups.filter(F.col("n") * HOT >= total)
    originals = groups.select("digest", F.col("original.key").alias("first_key"), F.col("original.uri").alias("first_uri"))
    pairs = joined_to_one(large.select("key", "digest"), originals, "digest", hot, F.xxhash64("key"))
    return pairs.filter(~F.col("key").eqNullSafe(F.col("first_key"))).dropDuplicates(["key", "digest"])


def _safe(value: Column) -> Column:
    """A header's value on one line: white space as percent codes, null as empty."""
    value = F.coalesce(value, F.lit(""))
    for mark, code in (("\r", "%0D"), ("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        value = F.replace(value, F.lit(mark), F.lit(code))
    return value


def _name(key: Column, digest: Column) -> Column:
    return F.coalesce(F.concat(F.lit(NAMED), F.url_encode(key.cast("string"))), F.concat(F.lit(NAMELESS), digest))


def _record(date: str) -> Column:
    """One WARC record of key, uri, digest, bytes, payload and, for revisits, first_key and first_uri."""
    revisit = F.col("first_key").isNotNull()
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", F.concat(F.lit("<"), _name(F.col("first_key"), F.col("digest")), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", _safe(F.col("first_uri"))),
        line("WARC-Refers-To-Date", F.lit(date)),
    )
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _name(F.col("key"), F.col("digest")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _safe(F.col("uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", text: str = "html", least: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write gzipped WARC 1.1 files with one record a row of df below path.

    The payload is the text in UTF-8. Null or empty texts are empty payloads, a null address is an empty one;
    rows that repeat are written again, as the original's rows or as revisits of it; null keys never
    stand for a group that has a key. Extra columns are left out, whatever their names. An empty table gives a
    folder without records. A payload is held by one task at a time, however long.
    """
    headers = written(_headers(df, key, url, text), "headers")
    links = revisits(headers, least).select(_slot(F.col("key"), F.col("digest")).alias("slot"), "first_key", "first_uri")
    total = headers.agg(F.sum("bytes")).first()[0] or 0
    # at least as many files as shuffles have partitions: then the plan keeps one exchange even where no payload occurs twice
    files = max(math.ceil(total / FILE_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    payload = F.coalesce(df[text], F.lit(""))
    rows = df.select(df[key].alias("key"), df[url].cast("string").alias("uri"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    rows = rows.withColumn("slot", _slot(F.col("key"), F.col("digest"))).repartition(files, "slot")
    # the links of a file's rows fit beside it: both sides are dealt alike, payloads are neither sorted nor moved again
    whole = rows.join(links.repartition(files, "slot").hint("shuffle_hash"), "slot", "left")
    whole.select(_record(date).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, _, value in pairs}


def _hex(digest: str | None) -> str | None:
    """A labelled sha1 as lower-case hex, from hex or base32."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1" or not value:
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive; ValueError where it is damaged."""
    end, at, n = END.encode(), 0, len(data)
    while at < n:
        stop = data.find(end, at)
        head = data[at:stop]
        if stop < 0 or not head.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(head)
        start = stop + len(end)
        at = start + int(fields["content-length"])
        if data[at : at + len(end)] != end:
            raise ValueError(f"record {fields.get('warc-record-id')} does not end at byte {at}")
        yield fields, data[start:at]
        at += len(end)


def _key(name: str | None) -> str | None:
    from urllib.parse import unquote_plus

    name = (name or "").strip("<>")
    return unquote_plus(name[len(NAMED) :]) if name.startswith(NAMED) else None


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row a record: key, record_type, uri, date, payload_bytes, payload_digest, refers_to and, if asked for, payload.

    Payloads are what follows the HTTP headers. Of records that hold one, length and digest are taken from
    it, and a digest that differs from the header's is an error; of revisits they are those of the
    headers, and their payload is null. Records of other types, and other archives' names, give null where they have no value.
    Any folder that Spark reads will do, with or without gzip.
    """

    def rows(content: bytes) -> Iterator[tuple]:
        for fields, block in parsed(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
            kind, digest = fields.get("warc-type"), _hex(fields.get("warc-payload-digest"))
            http, body, size = {}, None, None
            if fields.get("content-type", "").startswith("application/http"):
                head, _, body = block.partition(END.encode())
                http = _fields(head)
            if kind == "revisit":
                size, body = int(http["content-length"]) if "content-length" in http else None, None
            elif body is not None:
                own = hashlib.sha1(body).hexdigest()
                if digest not in (None, own):
                    raise ValueError(f"record {fields.get('warc-record-id')}: its payload has another digest")
                size, digest = len(body), own
            yield (_key(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), fields.get("warc-date"), size, digest, _key(fields.get("warc-refers-to")), *([body] if payload else ()))

    spec = f"{RECORD}, {PAYLOAD}" if payload else RECORD
    names = [x.split()[0] for x in spec.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*found, strict=True), strict=True)], names=names)

        for files in batches:
            for i in range(files.num_rows):
                found, held = [], 0
                for row in rows(files.column(0)[i].as_py()):
                    found.append(row)
                    held += len(row[-1] or b"") if payload else 0
                    if len(found) == 10_000 or held >= 4 << 20:
                        yield batch(found)
                        found, held = [], 0
                if found:
                    yield batch(found)
            give_back()

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, spec)


def resolved(records: DataFrame) -> DataFrame:
    """read_archives(payload=True) with every revisit's payload and refers_to filled from the response of its digest.

    Of several responses with one digest the largest key serves. Revisits whose digest has no response stay as
    they are; nothing is dropped. A digest with a large share of the revisits is dealt over many tasks.
    """
    records = written(records, "records")
    numbered = records.withColumn("_spread", F.xxhash64("key", "uri"))
    missing = numbered.filter("record_type = 'revisit' and payload_digest is not null")
    counts = missing.groupBy("payload_digest").agg(F.count("*").alias("n"))
    total = missing.count()
    wanted = counts.join(
        records.filter("record_type = 'response' and payload_digest is not null").groupBy("payload_digest").agg(F.max_by(F.struct("key", "payload"), F.coalesce("key", F.lit(""))).alias("_of")), "payload_digest"
    )
    wanted = written(wanted, "originals")
    found = joined_to_one(missing, wanted.drop("n"), "payload_digest", wanted.filter(F.col("n") * HOT >= total), F.col("_spread"))
    found = found.withColumns({"payload": F.col("_of.payload"), "refers_to": F.coalesce("refers_to", "_of.key")}).select(*records.columns)
    lost = missing.join(wanted.select("payload_digest"), "payload_digest", "left_anti").select(*records.columns)
    rest = records.filter("not (record_type <=> 'revisit') or payload_digest is null")
    return rest.unionByName(found).unionByName(lost)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: all pages written as archives without repeated payloads, read back."""
    pages, path = table(spark, sf_dir, "pages").select("page_id", "url", "html"), new_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path)
    long = T.LongType()
    return back.select(F.col("key").cast(long).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(long).alias("refers_to"))


ORACLE = """
with p as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), f as (
    select *, max(page_id) over (partition by payload_digest) as first from p
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 1000 and page_id <> first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 1000 and page_id <> first then first end as refers_to
from f
"""

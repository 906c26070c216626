"""Benchmark decontamination by template canonicalisation (operator 5).

Words are stripped of punctuation and lower-cased; numbers, names (capitalised words inside a
sentence) and units become typed placeholders. Windows of WINDOW template words
are hash-joined between documents and benchmark items. A filled slot is a value in a document for
a value of the item; a window counts where its values agree with the document's usual value for
each of the item's values, so a question asked again with other numbers is found, while windows
that only look alike are not counted. A document's matches are judged together and also for each
occurrence of the item, told apart by how far its windows are moved, and the best of these counts, as
copies with other numbers each agree only with themselves. Windows of little but placeholders keep their units, and count with other
numbers only in an occurrence that holds most of the item, word by word (signs between numbers are not seen); those of nothing else are hashed with their values. Items shorter than a window are compared at their own length.

Items of one template are a class. Every window of an item links it to documents, however many others hold it too. An instruction
(windows that most of a benchmark's classes hold and that are the smaller part of the item) is a class of its own: a document that
holds enough of it has one row with it instead of one with each item, and its windows count with an item where the document holds
others of the item as well. So a document that holds the share or number of any item's windows is always found, without
pairs of all documents and all items.

A bitmap of fixed size over the items' window hashes, whatever their number, lets tasks pass on
only the windows that can meet an item; the join itself is Spark's and exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.llm.common import HOT, as_bytes, give_back, joined_to_one, slices, table, written
from trackweave.llm.ragged import U, Words, mix, shingles

WINDOW = 8
#: A window with fewer words that are no placeholders (than all of them, if it is shorter) matches with its values only.
MIN_PLAIN = 4
#: A document is contaminated by an item when it holds this share of its windows, or this many.
SHARE, MANY = 0.3, 8
#: Windows moved by so many words more than the ones before them still belong to one occurrence of an item.
MOVED = 2
#: Share of an item's windows at one distance that makes windows of little but placeholders count with other numbers.
ALIKE = 0.8
#: A window that more than half of the classes of items hold is an instruction's, if it's more than so many classes.
COMMON = 16
#: An item of which this share is instruction is judged by all of it, as if it had none.
SAID = 0.5
#: Classes: an item's windows but its instruction's, an instruction's, and both parts of an item together.
ITEM, INSTRUCTION, TOGETHER = 0, 1, 2
#: What a document's matches are counted over: all of it, each occurrence of an item, each distance between item and text.
WHOLE, OCCURRENCE, STRICT = 0, 1, 2
BITMAP_BITS = 23
CACHE_WORDS = 120_000
#: Bytes of text that are cut into windows at a time.
SLICE = 1 << 20
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces pound pounds ton tons tonne tonnes "
    "ml cl l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years cent cents dollar dollars euro euros pence percent % degree degrees °c °f mph kmh w kw kwh v a hz mb gb tb".split()
)
#: Units of so many letters are units anywhere, shorter ones only after a number.
LONG_UNIT = 4
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
_EDGE = re.compile(r"^[^\w%°$€£+-]+|[^\w%°]+$")
_NUMBER = re.compile(r"[$€£+-]*\d[\d.,:/]*%?(?:st|nd|rd|th)?")


_END, _CLOSED = frozenset(".!?:"), frozenset(",;)]}\"")


def fresh(word: str) -> tuple[int, bool, bool, str]:
    """(class, capitalised, ends a sentence, value) of a word; class -1 for punctuation only."""
    last = word[-1:]
    if word.isalpha():
        core, ends = word, False
    elif (last in _END or last in _CLOSED) and word[:-1].isalpha():
        core, ends = word[:-1], last in _END
    else:
        core = _EDGE.sub("", word)
        ends = word.rstrip("\"')]»”’")[-1:] in _END
        value = core.lower()
        if not any(map(str.isalnum, core)) and value not in UNITS:
            return -1, False, ends, ""
        if _NUMBER.fullmatch(core):
            return NUMBER, False, ends, value
    value = core.lower()
    return UNIT if value in UNITS else PLAIN, core[0].isupper() and core[1:].islower(), ends, value


PLACEHOLDER = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in (b"", b"<number>", b"<unit>", b"<name>")], U)


#: Sets hashes of windows with their values apart from those of templates.
EXACT = U(0x5EED0FEAC7)
#: Sets hashes of windows of little but placeholders apart, which keep their units.
LOOSE = U(0x5EED100CE)


class Templates:
    """Template words of many texts; what is known of a word is kept up to a bound."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.values: list[str] = []
        self.hash, self.kind = np.zeros(0, U), np.zeros(0, np.int8)
        self.capital, self.ends, self.long = np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, bool)

    def learn(self, split: list[list[bytes]]) -> None:
        if len(self.row) > CACHE_WORDS:
            self.reset()
        new = list(set().union(*split).difference(self.row)) if split else []
        if new:
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            kind, capital, ends, values = zip(*(fresh(w.decode("utf-8", "replace")) for w in new), strict=True)
            # a letter in front, so that an empty value is a word too; values hold no white space
            h = Words(pa.array(["v" + v for v in values], pa.large_string())).hashes()
            self.values += values
            self.hash = np.concatenate((self.hash, h))
            self.kind = np.concatenate((self.kind, np.array(kind, np.int8)))
            self.capital = np.concatenate((self.capital, np.array(capital)))
            self.ends = np.concatenate((self.ends, np.array(ends)))
            self.long = np.concatenate((self.long, np.array([len(v) >= LONG_UNIT for v in values])))

    def of(self, texts: list[bytes]):
        """(word ids, template hashes, classes, first word of each text and the end)."""
        split = [t.split() for t in texts]
        self.learn(split)
        begin = np.concatenate(([0], np.cumsum([len(s) for s in split]))).astype(np.int64)
        ids = np.fromiter(map(self.row.__getitem__, chain.from_iterable(split)), np.int64, begin[-1])
        if not len(ids):
            return ids, np.zeros(0, U), np.zeros(0, np.int8), begin
        kind = self.kind[ids]
        opens = np.concatenate(([True], self.ends[ids[:-1]]))  # first words of sentences are no names
        opens[begin[:-1][begin[:-1] < len(ids)]] = True
        solid = kind >= 0
        kept = np.concatenate(([0], np.cumsum(solid)))
        # a sentence's first word stays first if only punctuation stands before it
        opens[1:] |= opens[:-1] & ~solid[:-1]
        ids, opens, kind, begin = ids[solid], opens[solid], kind[solid].copy(), kept[begin]
        kind[(kind == PLAIN) & self.capital[ids] & ~opens] = NAME
        first = np.zeros(len(ids) + 1, bool)
        first[begin] = True
        after_number = np.zeros(len(ids), bool)
        after_number[1:] = (kind[:-1] == NUMBER) & ~first[1:-1]
        kind[(kind == UNIT) & ~after_number & ~self.long[ids]] = PLAIN
        return ids, np.where(kind == PLAIN, self.hash[ids], PLACEHOLDER[kind]), kind, begin

    def spelled(self, ids: np.ndarray, hashes: np.ndarray, kind: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of windows of little but placeholders: with their units or, where they have no word and no unit, with all values."""
        kept = np.concatenate(([0], np.cumsum((kind == PLAIN) | (kind == UNIT))))
        some = kept[at + length] > kept[at]
        out = np.where(some, LOOSE, EXACT)
        for j in range(int(length.max())):
            i = np.minimum(at + j, len(ids) - 1)
            word = np.where(some & (kind[i] != UNIT), hashes[i], self.hash[ids[i]])
            step = (out ^ word) * U(0x9E3779B97F4A7C15)
            out = np.where(j < length, step ^ (step >> U(29)), out)
        return mix(out ^ length.astype(U))

    def windows(self, texts: list[bytes], size: int):
        """(text, place, hash, slot values, whether plain enough) of every window; slots is a function of the window's number."""
        return self.windows_in(self.of(texts), size)[:5]

    def windows_in(self, words, size: int):
        """windows() and each one's length, of what of() returns."""
        ids, hashes, kind, begin = words
        h, first = shingles(hashes, begin, size)
        row = np.repeat(np.arange(len(begin) - 1), np.diff(first))
        place = np.arange(len(h)) - first[row]
        at = begin[row] + place
        length = np.minimum(begin[row + 1] - at, size)
        plain = np.concatenate(([0], np.cumsum(kind == PLAIN)))
        enough = plain[at + length] - plain[at] >= np.minimum(MIN_PLAIN, length)
        if not enough.all():
            few = np.flatnonzero(~enough)
            h[few] = self.spelled(ids, hashes, kind, at[few], length[few])
        filled = np.concatenate(([0], np.cumsum(kind != PLAIN)))
        slotted = filled[at + length] > filled[at]

        def slots(i: int) -> list[str]:
            if not slotted[i]:
                return []
            a, b = int(at[i]), int(at[i] + length[i])
            return [self.values[ids[j]] for j in range(a, b) if kind[j] != PLAIN]

        return row, place, h, slots, enough, length


SCHEMA = "key {kind}, text_hash bigint, window bigint, at int, slots array<string>, plain boolean, words int, literals int"


def literals(words) -> np.ndarray:
    """Different plain words and units of each text of Templates.of()."""
    ids, _, kind, begin = words
    kept = (kind == PLAIN) | (kind == UNIT)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))[kept]
    return np.bincount(np.unique(np.stack((text, ids[kept])), axis=1)[0], minlength=len(begin) - 1).astype(np.int32)


def hashed(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows_of(df: DataFrame, text: str, key: str, bitmap: bytes | None = None, size: int = WINDOW, short: tuple[int, ...] = ()) -> DataFrame:
    """(key, text_hash, window, at, slots, plain, words, literals) of the windows that the bitmap lets through; literals of texts without a bitmap only.

    Without a bitmap all windows, where a text shorter than one is a window. With one, the windows of
    exactly size words, and those of each length in short.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                keys, texts = batch.column(0).slice(a, b - a), as_bytes(batch.column(1).slice(a, b - a)).to_pylist()
                words = templates.of(texts)
                different = literals(words) if bits is None else np.zeros(len(texts), np.int32)
                for own in (size, *short):
                    row, place, h, slots, plain, length = templates.windows_in(words, own)
                    passed = np.ones(len(h), bool)
                    if bits is not None:
                        slot = (h >> U(64 - BITMAP_BITS)).astype(np.int64)
                        passed = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0) & (length == own)
                    hit = np.flatnonzero(passed)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(row[hit])),
                            batch.column(2).slice(a, b - a).take(pa.array(row[hit])),
                            pa.array(h[hit].view(np.int64)),
                            pa.array(place[hit].astype(np.int32)),
                            pa.array([slots(i) for i in hit.tolist()], pa.list_(pa.string())),
                            pa.array(plain[hit]),
                            pa.array(length[hit].astype(np.int32)),
                            pa.array(different[row[hit]]),
                        ],
                        names=["key", "text_hash", "window", "at", "slots", "plain", "words", "literals"],
                    )
        del templates
        give_back()

    return df.select(df[key].alias("key"), df[text].alias("text"), hashed(df[text])).mapInArrow(run, SCHEMA.format(kind=kind))


def bitmap_of(windows: DataFrame) -> bytes:
    """2**BITMAP_BITS bits, set for the leading bits of the hashes; at most that many rows are gathered."""
    slots = windows.select(F.shiftrightunsigned("window", 64 - BITMAP_BITS).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bits = np.zeros(1 << BITMAP_BITS, np.uint8)
    bits[slots] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def classes_of(benchmark: DataFrame, text: str = "text", key: str = "item_id", size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(members, totals, theirs, said): the items of a benchmark by their templates.

    Items whose windows are the same, one after the other, are a class, be their values equal or not; texts that share an item's id are items of
    their own. members: class, item, of (the class's item of the smallest id), slots_hash, one row an item. totals: class, n_windows, n_plain, literals. theirs: class, window,
    place, item_slots, words, own windows of the item that stands for its class. An instruction's windows, which more than half of the
    classes (and more than COMMON) hold, in items of which less than SAID is instruction, are windows of the instruction's class instead, which
    has those items as members and counts as a part of the shortest of them. said is None without instructions, else (roles, spoken); roles: class, role, base
    (the class of the same items' own windows), instruction; spoken: class (ITEM), both (TOGETHER), instruction, window, place, item_slots of the instruction's windows of each class.
    """
    rows = windows_of(benchmark, text, key, size=size)
    whole = F.array_sort(F.collect_list(F.struct("at", "window", "slots", "plain", "words", "literals")))
    texts = rows.dropDuplicates(["key", "text_hash", "at"]).groupBy("key", "text_hash").agg(whole.alias("w"))
    texts = written(texts.select(F.col("key").alias("item"), "text_hash", F.xxhash64(F.transform("w", lambda x: x["window"])).alias("class"), F.xxhash64(F.transform("w", lambda x: x["slots"])).alias("slots_hash"), "w"), "items")
    first = texts.groupBy("class").agg(F.min(F.struct("item", "text_hash")).alias("first"))
    members = texts.groupBy("class", "item", "slots_hash").agg(F.lit(1).alias("one")).join(first.select("class", F.col("first.item").alias("of")), "class").drop("one")
    stands = texts.join(first.select("class", F.col("first.item").alias("i"), F.col("first.text_hash").alias("h")), "class").filter(F.col("item").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    windows = written(stands.select("class", F.explode("w").alias("x")).select("class", "x.*"), "classes")
    held = windows.select("class", "window").distinct().groupBy("window").agg(F.count("*").alias("held"))
    rated = windows.join(held.withColumn("instructs", F.col("held") > max(COMMON, windows.select("class").distinct().count() // 2)), "window")
    share = rated.groupBy("class").agg(F.avg(F.col("instructs").cast("int")).alias("share"))
    instructs = (F.col("instructs") & (F.col("share") < SAID)).alias("instructs")
    rated = written(rated.join(share, "class").select("class", "window", F.col("at").alias("place"), F.col("slots").alias("item_slots"), "plain", "words", "literals", instructs), "own")
    counted = lambda df: df.groupBy("class").agg(F.count("*").alias("n_windows"), F.count_if("plain").alias("n_plain"), F.max("literals").alias("literals"))
    told = rated.filter("instructs")
    if told.isEmpty():
        return members, counted(rated), rated.select("class", "window", "place", "item_slots", "words"), None

    # alike in places, templates and which of the values are equal, so that a text holds as many windows of one as of the other
    w = F.array_sort(F.collect_list(F.struct("place", "window", "item_slots", "plain")))
    values = F.flatten(F.transform("w", lambda x: x["item_slots"]))
    alike = F.xxhash64(
        F.lit("instruction"),
        F.transform("w", lambda x: x["place"] - F.col("w")[0]["place"]),
        F.transform("w", lambda x: x["window"]),
        F.transform("w", lambda x: F.when(~x["plain"], x["item_slots"])),
        F.transform(values, lambda x: F.array_position(values, x)),
    )
    parts = written(told.groupBy("class").agg(w.alias("w")).select("class", F.xxhash64(F.lit("both"), "class").alias("both"), alike.alias("instruction")), "instructions")
    as_class = lambda df, c: df.drop("class").withColumnRenamed(c, "class").select("class", *(x for x in df.columns if x not in ("class", "both", "instruction")))
    ids = parts.select("class", "both")
    spoken = written(told.select("class", "window", "place", "item_slots").join(parts, "class"), "spoken")
    all_of = counted(rated).join(parts, "class")
    part_of = all_of.groupBy("instruction").agg(F.min("n_windows").alias("n_windows"), F.min("n_plain").alias("n_plain"), F.max("literals").alias("literals"))
    totals = counted(rated.filter("not instructs")).unionByName(as_class(all_of, "both")).unionByName(part_of.withColumnRenamed("instruction", "class"))
    stand = parts.groupBy("instruction").agg(F.min("class").alias("class"))
    theirs = rated.filter("not instructs").unionByName(as_class(told.join(stand, "class"), "instruction")).select("class", "window", "place", "item_slots", "words")
    least = members.join(parts, "class").groupBy("instruction").agg(F.min("item").alias("of"))
    # an instruction is never the whole of an item, so its values name none
    asked = members.drop("of").join(parts, "class").drop("class", "both").join(least, "instruction").withColumnRenamed("instruction", "class")
    roles = members.select("class").distinct().join(parts.drop("both"), "class", "left").select("class", F.lit(ITEM).alias("role"), F.col("class").alias("base"), "instruction")
    roles = roles.unionByName(parts.select(F.col("both").alias("class"), F.lit(TOGETHER).alias("role"), F.col("class").alias("base"), "instruction"))
    roles = roles.unionByName(stand.select(F.col("instruction").alias("class"), F.lit(INSTRUCTION).alias("role"), F.col("instruction").alias("base"), "instruction"))
    members = members.unionByName(as_class(members.join(ids, "class"), "both")).unionByName(asked)
    return written(members, "members"), written(totals, "totals"), written(theirs, "theirs"), (written(roles, "roles"), spoken)


def with_instructions(met: DataFrame, spoken: DataFrame) -> DataFrame:
    """met, and for each text and item that share a window beside the instruction's all their windows, of the class TOGETHER."""
    met = written(met, "links")
    ids = spoken.select("class", "both", "instruction").distinct()
    own = met.join(ids, "class")
    pairs = own.select("key", "text_hash", "class", "both", "instruction").distinct()
    heard = met.join(ids.select(F.col("instruction").alias("class")).distinct(), "class").select("key", "text_hash", F.col("class").alias("instruction"), "window", "at", "slots", "plain").distinct()
    same = F.col("h.key").eqNullSafe(F.col("p.key")) & (F.col("h.text_hash") == F.col("p.text_hash")) & (F.col("h.instruction") == F.col("p.instruction"))
    also = heard.alias("h").join(pairs.alias("p"), same).select("h.*", "p.class", "p.both").join(spoken.select("class", "window", "place", "item_slots"), ["class", "window"])
    columns = ["key", "text_hash", F.col("both").alias("class"), "window", "at", "slots", "plain", "place", "item_slots"]
    return met.unionByName(own.select(*columns)).unionByName(also.select(*columns))


def links(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", size: int = WINDOW, share: float = SHARE, many: int = MANY) -> DataFrame:
    """(key, text_hash, item, n_matched, n_windows, coverage, kind) of each contaminated text and item, and of each text and instruction.

    n_matched counts the item's windows that the text holds with consistent slots, of n_windows, in the
    text as a whole or in the item's best occurrence, whichever has more. An item with an instruction (see classes_of) counts by its
    other windows alone and by all its windows; by all only where those others are enough or the instruction alone is not. A text with enough of an instruction
    for the shortest item that has it gets one row of kind "instruction" that names the smallest id of these items and has the windows of the shortest; such a row and the members stand for a row with each.
    Where an item's windows that aren't plain enough lower its coverage, the others alone are counted.
    kind is "exact" where every slot holds the item's own value, else "reparameterised". Windows of little but placeholders count with
    the item's own values; with others only where the text holds ALIKE of the item's windows, word by word at one distance, and
    the item has MIN_PLAIN different words or units. An item
    shorter than a window is one window, looked for at every place of the texts. Several of the item's
    values may have one value in the document, as other numbers can fall together; one of the item's
    has one. Of items with one template the result names the one whose values a text holds from end to end, else the
    one of the smallest id: one row a text, and classes_of says which others share it. Very long texts are taken whole. Null or empty texts and items match nothing. A row repeated
    with its key and text gives one result, and so do several texts of one item id that a text holds; null keys are kept as null; extra columns are ignored;
    empty tables give an empty result.
    """
    members, totals, theirs, said = classes_of(benchmark, item_text, item_key, size)
    short = tuple(sorted(r.words for r in theirs.filter(F.col("words") < size).select("words").distinct().collect()))  # fewer than size rows
    found = written(windows_of(df, text, key, bitmap_of(theirs), size, short), "windows")
    seen = found.groupBy("window").agg(F.count("*").alias("n"))
    hot = seen.filter(F.col("n") * HOT >= found.count())
    tight = F.col("plain") | (F.col("slots") == F.col("item_slots"))
    # a window has as many rows as classes hold it, which is as many links
    met = joined_to_one(found.drop("words", "literals"), theirs.drop("words"), "window", hot, F.xxhash64("text_hash", "at"))
    met = met.filter(F.size("slots") == F.size("item_slots"))
    met = with_instructions(met, said[1]) if said else met
    both = written(met.withColumn("tight", tight).join(totals.select("class", "n_windows", F.col("literals").alias("item_literals")), "class"), "matches")

    group = ["key", "text_hash", "class", "turn"]
    pair = Window.partitionBy("key", "text_hash", "class")
    moved = F.col("at") - F.col("place")
    side = Window.partitionBy("key", "text_hash", "class", "tight").orderBy(moved)
    # an item of a single window has as many occurrences as places
    gap = F.when(moved - F.lag(moved).over(side) > F.when(F.col("n_windows") > 1, MOVED).otherwise(0), 1).otherwise(0)
    turns = both.withColumn("gap", gap).withColumn("turn", F.sum("gap").over(side)).withColumn("strict", F.bool_or(~F.col("tight")).over(pair) & (F.col("item_literals") >= MIN_PLAIN))
    turn = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("bigint").alias("n"))
    # the whole text, its occurrences, and each distance alone where windows of other numbers may count
    each = F.array_compact(F.array(F.when(F.col("tight"), turn(WHOLE, F.lit(0))), F.when(F.col("tight"), turn(OCCURRENCE, F.col("turn"))), F.when(F.col("strict"), turn(STRICT, moved))))
    both = written(turns.withColumn("turn", F.explode(each)).drop("gap", "strict"), "turns")
    pairs = both.filter(F.size("slots") > 0).select(*group, "at", "place", F.explode(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))).alias("p")).select(*group, "at", "place", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    # one value of the document for each of the item's: the most frequent, of equals the item's own
    filled = pairs.groupBy(*group, "a", "b").agg(F.count("*").alias("n"))
    rank = F.struct("n", F.col("a") == F.col("b"), "b")
    usual = filled.groupBy(*group, "a").agg(F.max_by("b", rank).alias("usual"))
    same = F.lit(True)
    for c in (*group, "a"):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    wrong = pairs.alias("l").join(usual.alias("r"), same).filter(F.col("b") != F.col("usual")).select(*(F.col(f"l.{c}") for c in (*group, "at", "place"))).distinct()
    match = F.lit(True)
    for c in (*group, "at", "place"):
        match = match & F.col(f"m.{c}").eqNullSafe(F.col(f"w.{c}"))
    good = both.alias("m").join(wrong.alias("w"), match, "left_anti")
    # at one place of an item the values of one occurrence are alike, so any of them will do
    values = F.array_sort(F.collect_set(F.struct("place", "slots")))
    counted = good.groupBy(*group).agg(F.countDistinct("place").alias("n"), F.countDistinct(F.when(F.col("plain"), F.col("place"))).alias("p"), F.bool_and(F.col("slots") == F.col("item_slots")).alias("exact"), F.xxhash64(F.transform(values, lambda x: x["slots"])).alias("slots_hash"))
    counted = counted.join(totals, "class").filter((F.col("turn.kind") != STRICT) | (F.col("n") >= ALIKE * F.col("n_windows")))
    # the values of all of an item's windows tell which item of its class it is
    named = members.groupBy("class", "slots_hash").agg(F.min("item").alias("named"))
    whole = (F.col("n") == F.col("n_windows")) & (F.col("turn.kind") != WHOLE)
    counted = counted.join(named, ["class", "slots_hash"], "left").withColumn("named", F.when(whole, F.col("named")))
    counted = counted.withColumn("exact", F.col("exact") | F.col("named").isNotNull()).groupBy("key", "text_hash", "class").agg(F.max(F.struct("n", "p", "exact", "named", "n_windows", "n_plain")).alias("most")).select("key", "text_hash", "class", "most.*")
    cover = lambda n, of: F.struct((F.col(n) / F.col(of)).alias("coverage"), F.col(n).alias("n_matched"), F.col(of).alias("n_windows"))
    out = counted.withColumn("best", F.greatest(cover("n", "n_windows"), F.when(F.col("n_plain") > 0, cover("p", "n_plain"))))
    out = out.filter((F.col("best.n_matched") >= share * F.col("best.n_windows")) | (F.col("n") >= many))
    stands = members.select("class", "of").distinct()
    out = out.join(stands, "class").withColumn("item", F.coalesce("named", "of"))
    kind = F.when(F.col("exact"), "exact").otherwise("reparameterised")
    out = one_of_parts(out, said[0]) if said else out.withColumn("role", F.lit(ITEM))
    kind = F.when(F.col("role") == INSTRUCTION, "instruction").otherwise(kind)
    rows = out.select("key", "text_hash", "item", "role", F.struct("best.coverage", "best.n_matched", "best.n_windows", kind.alias("kind")).alias("best"), F.col("exact"))
    top = rows.groupBy("key", "text_hash", "item", "role").agg(F.max_by("best", F.struct("exact", "best.coverage", "best.n_matched")).alias("best"))
    return top.select(F.col("key").alias(key), "text_hash", F.col("item").alias(item_key), "best.n_matched", "best.n_windows", "best.coverage", "best.kind")


def one_of_parts(out: DataFrame, roles: DataFrame) -> DataFrame:
    """Of the rows of one text and item, by its own windows and TOGETHER, the best, with role ITEM; TOGETHER only if the own ones are enough or the instruction alone is not."""
    within = lambda role, c: F.bool_or(F.col("role") == role).over(Window.partitionBy("key", "text_hash", c))
    rows = out.join(roles, "class").withColumn("enough", within(ITEM, "base")).withColumn("heard", within(INSTRUCTION, "instruction"))
    rows = rows.filter((F.col("role") != TOGETHER) | F.col("enough") | ~F.col("heard"))
    role = F.when(F.col("role") == INSTRUCTION, INSTRUCTION).otherwise(ITEM).alias("role")
    best = F.max_by(F.struct("item", "best", "exact", role), F.struct(F.col("named").isNotNull(), "exact", "best.coverage", "best.n_matched"))
    return rows.groupBy("key", "text_hash", "base").agg(best.alias("top")).select("key", "text_hash", "top.*")


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", size: int = WINDOW, share: float = SHARE, many: int = MANY) -> DataFrame:
    """links() with items alone: what a text holds of an instruction only makes no leak of the items that have it."""
    return links(df, benchmark, text, key, item_text, item_key, size, share, many).filter(F.col("kind") != "instruction")


def clean(df: DataFrame, found: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df whose key and text are not in leaks(df, ...) or links(df, ...); all its columns, repeats and null keys too."""
    bad = found.select(F.col(key).alias("bad_key"), F.col("text_hash").alias("bad_hash")).distinct().alias("bad")
    docs = df.alias("docs")
    same = F.col(f"docs.{key}").eqNullSafe(F.col("bad.bad_key")) & (hashed(F.col(f"docs.{text}")) == F.col("bad.bad_hash"))
    return docs.join(bad, same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: documents that hold benchmark items, one row for each document and item, and for each document and instruction."""
    found = links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_windows", F.round("coverage", 6).alias("coverage"), "kind")

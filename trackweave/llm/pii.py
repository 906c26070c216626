"""Personal data by offset-preserving deobfuscation (operator 7).

Plain identifiers are found in the text as it stands. Then small transducers rewrite disguises
(look-alike characters, spelled digits, "at" and "dot" in words or brackets) while carrying, for
each character of the rewritten text, the span of source characters it came from. Identifiers
found in the rewritten text are mapped back; those that a plain one doesn't already cover are
added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
SPAN_FIELDS = ("kind", "start", "end", "base")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, looked for from each @, so that long words cost no more."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.group().split(".")):
                    out.append(m.span())
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Characters that look like Latin letters, each under the letter it passes for.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ",
    "k": "κк", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ",
    "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    ".": "․。｡・", "@": "﹫＠", "-": "‐‑‒–—−", "+": "﹢",
}
# Digit words of the four languages of the corpus.
DIGIT_WORDS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres",
    "4": "four vier quatre cuatro", "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete",
    "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_ALIKE = {other: plain for plain, others in LOOK_ALIKES.items() for other in others}
_DIGIT = {w: d for d, ws in DIGIT_WORDS.items() for w in ws.split()}
_ODD = re.compile("[ ­ıƅɑɡͰ-֏؀-ۿ०-९ᴀ-ᶿ -⁯⁰-₟−①-⓿　-。・︀-️﹐-￯\U0001d400-\U0001d7ff]")
_WORD_DIGITS = "|".join(sorted(_DIGIT, key=len, reverse=True))
#: Six or more digits in a row of which words spell some, with light separators between them.
_SPELLED = re.compile(rf"(?<![^\W_])(?:plus[ -]+)?(?:(?:{_WORD_DIGITS}|[0-9]+)(?:[ ,/-]+(?=[^\W_])|(?=[^\w])|$)){{4,}}", re.I)
_SPELLED_GATE = re.compile(rf"(?<![^\W_])(?:{_WORD_DIGITS})[ ,/-]+(?:{_WORD_DIGITS})[ ,/-]", re.I)
_SPELLED_TOKEN = re.compile(rf"plus|{_WORD_DIGITS}|[0-9]+", re.I)
_BRACKET_AT = re.compile(r" ?[\[({<] ?(?:at|@|ät|arroba|arobase) ?[\])}>] ?", re.I)
_BRACKET_DOT = re.compile(r" ?[\[({<] ?(?:dot|punkt|punto|point|\.) ?[\])}>] ?", re.I)
#: Parts before an at, and after it; no part is tried twice, so that a text of nothing but "a dot a dot" takes linear time.
_LOOSE_LOCAL = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:\.| dot )[A-Za-z0-9_%+-]++)*+", re.I)
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: dot |_dot[-_]|(?<=-dot)_| ?\. ?)[A-Za-z0-9-]++)*+", re.I)
_LOOSE_DOT = re.compile(r"(?: dot |[-_]dot[-_]| ?\. ?)(?=[A-Za-z0-9-])", re.I)
_NEXT_AT, _INNER_AT = re.compile(r" ?@ ?| at ", re.I), re.compile(r"[-_]at(?=[-_])", re.I)
_LOOSE_GATE = re.compile(r"[ _-](?:at|dot)[ _-]| @|@ ", re.I)
_WORD_DOT = re.compile(r" dot |[-_]dot[-_]", re.I)
_LOCAL_DOT = re.compile(" dot ", re.I)
_IP_DOT = re.compile(r"(?<=[0-9])(?: dot | ?[\[({] ?(?:\.|dot) ?[\])}] ?)(?=[0-9])", re.I)


class Traced:
    """A rewritten text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))
        self.changed = False

    def replace(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """edits: disjoint (from, to, new characters with their ranges in the present text)."""
        if not edits:
            return
        out, start, end, at = [], [], [], 0
        for a, b, new in edits:
            out.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            for ch, x, y in new:
                out.append(ch)
                start.append(self.start[x])
                end.append(self.end[y - 1])
            at = b
        out.append(self.text[at:])
        self.text, self.start, self.end, self.changed = "".join(out), start + self.start[at:], end + self.end[at:], True


def plain_characters(t: Traced) -> None:
    """Look-alikes, wide and styled forms, other digits and spaces; invisible characters go."""
    edits = []
    for m in _ODD.finditer(t.text):
        ch = m.group()
        if unicodedata.category(ch) in ("Cf", "Mn"):
            new = ""
        elif (d := unicodedata.digit(ch, None)) is not None:
            new = str(d)
        elif ch in _ALIKE:
            new = _ALIKE[ch]
        elif unicodedata.category(ch) == "Zs":
            new = " "
        else:
            new = unicodedata.normalize("NFKC", ch)
            new = new if len(new) == 1 else ch
        if new != ch:
            edits.append((*m.span(), [(new, *m.span())] if new else []))
    t.replace(edits)


def spelled_digits(t: Traced) -> list[tuple[int, int]]:
    """Digit words become digits; where the rewritten runs of mostly spelled digits now are."""
    edits, runs, moved = [], [], 0
    for m in _SPELLED.finditer(t.text) if _SPELLED_GATE.search(t.text) else ():
        tokens = list(_SPELLED_TOKEN.finditer(t.text, m.start(), m.end()))
        words = [_DIGIT[g] for x in tokens if (g := x.group().lower()) in _DIGIT]
        if len(words) < 4 or len(set(words)) < 3:  # "un, un, un" is an article, not a number
            continue
        new = []
        for x in tokens:
            g = x.group().lower()
            if g == "plus":
                new.append(("+", *x.span()))
            elif g in _DIGIT:
                new.append((_DIGIT[g], *x.span()))
            else:
                new += [(c, x.start() + i, x.start() + i + 1) for i, c in enumerate(g)]
        a, b = tokens[0].start(), tokens[-1].end()
        edits.append((a, b, new))
        runs.append((a - moved, a - moved + len(new)))
        moved += b - a - len(new)
    t.replace(edits)
    return runs


def _single(t: Traced, pattern: re.Pattern, ch: str) -> None:
    t.replace([(*m.span(), [(ch, *m.span())]) for m in pattern.finditer(t.text)])


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Ranges shaped like addresses with any number of parts, looked for around each at, in linear time."""
    free = 0
    for run in _LOOSE_LOCAL.finditer(text):
        start = run.start()
        if start and text[start - 1] in _LOCAL:
            if not (cut := _LOCAL_DOT.search(text, start, run.end())):
                continue
            start = cut.end()
        if start < free:
            continue
        marks = [(m.start(), m.end() + 1) for m in _INNER_AT.finditer(text, start + 1, run.end())]
        if m := _NEXT_AT.match(text, run.end()):
            marks.append(m.span())
        after, end, dotted = len(text), len(text), False
        for a, b in reversed(marks):  # a domain that runs into the next at goes on as that one's does
            d = _LOOSE_DOMAIN.match(text, b, after)
            own = d is not None and _LOOSE_DOT.search(text, b, d.end()) is not None
            if d is not None and d.end() == after < len(text):
                dotted = own or dotted
            else:
                end, dotted = d.end() if d else b, own
            after = b
            if dotted:
                yield start, end
                free = end
                break


def at_and_dot(t: Traced) -> None:
    """Bracketed forms anywhere; bare words only inside something shaped like an address."""
    if _BRACKET_AT.search(t.text):
        _single(t, _BRACKET_AT, "@")
    if _BRACKET_DOT.search(t.text):
        _single(t, _BRACKET_DOT, ".")
    if _IP_DOT.search(t.text):
        _single(t, _IP_DOT, ".")
    if not _LOOSE_GATE.search(t.text):
        return
    edits = []
    for first, last in addresses(t.text):
        g = t.text[first:last]
        at = re.search(r" ?@ ?| at |[-_]at[-_]", g, re.I)
        domain = g[at.end() :]
        if at.group() != "@" and not re.fullmatch(r"[A-Z]{2,12}", re.split(r"[. _-]+", domain)[-1], re.I):
            continue
        if " at " in at.group().lower() and (not _WORD_DOT.search(domain) or re.search(r" \.|\. ", domain)):
            continue  # "look at this. page" is no address
        if at.group() != "@":
            edits.append((first + at.start(), first + at.end(), [("@", first + at.start(), first + at.end())]))
        for d in re.finditer(r" dot |[-_]dot[-_]| ?\. ?", g, re.I):
            if d.group() != ".":
                a, b = first + d.start(), first + d.end()
                edits.append((a, b, [(".", a, b)]))
    t.replace(sorted(edits))


_GATE = re.compile(r"[\[({<] ?(?:at|@|ät|arroba|arobase|dot|punkt|punto|point|\.) ?[\])}>]|[ _-]dot[ _-]|[_-]at[_-]| @|@ ", re.I)


def merged(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint ranges that these cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(ranges):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def covered(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a range meets one of the disjoint ones."""
    at = bisect_right(ends, a)
    return at < len(starts) and starts[at] < b


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans (kind, start, end, base) by start and kind; end is exclusive."""
    spans = [(kind, *s, True) for kind in KINDS for s in FINDERS[kind](text)]
    odd = not text.isascii() and _ODD.search(text) is not None
    spelled = odd or _SPELLED_GATE.search(text) is not None
    if odd or spelled or _GATE.search(text):
        t = Traced(text)
        plain_characters(t)
        runs = spelled_digits(t)
        marks = [(t.start[a], t.end[b - 1]) for a, b in runs]
        at_and_dot(t)
        if t.changed:
            groups = [[(kind, t.start[a], t.end[b - 1]) for a, b in FINDERS[kind](t.text)] for kind in KINDS]
            if marks:  # ten digits or more that someone took the trouble to spell
                digits = list(accumulate(map(str.isdigit, t.text), initial=0))
                groups.append([("phone", a, b) for a, b in marks if 10 <= digits[bisect_right(t.end, b)] - digits[bisect_left(t.start, a)] <= 15])
            # plain spans of several kinds may overlap: what they cover, as disjoint ranges by start
            starts, ends = merged([s[1:3] for s in spans])
            added: list[tuple[str, int, int]] = []
            for group in groups:  # earlier ones go first; the spans of one come by start
                own, free = [], 0
                for kind, a, b in group:
                    if a >= free and not covered(starts, ends, a, b):
                        own.append((kind, a, b))
                        free = b
                if own:
                    added += own
                    starts, ends = merged([*zip(starts, ends, strict=True), *(x[1:] for x in own)])
            spans += [(*s, False) for s in added]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def spans_array(found: list[list[tuple[str, int, int, bool]]]) -> pa.Array:
    """The spans of some texts as an Arrow array of SPANS."""
    flat = [x for own in found for x in own]
    kinds, starts, ends, base = zip(*flat, strict=True) if flat else ([], [], [], [])
    fields = [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(base, pa.bool_())]
    offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=list(SPAN_FIELDS)))


def detect(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with a column of all spans, in code points, by start and kind.

    Null and empty texts get an empty array. All columns, repeated rows and null keys stay as
    they are (a column already named as `spans` is replaced); an empty table stays empty. Added
    spans never overlap plain ones. Time is linear in the length of a text.
    """

    @F.arrow_udf(SPANS)
    def spans_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [spans_array([find(x or "") for x in texts.slice(a, b - a).to_pylist()]) for a, b in slices(texts)]
            yield pa.concat_arrays(parts) if parts else spans_array([])

    return df.withColumn(spans, spans_of(F.col(text)))


def masked(text: str, spans: list[dict]) -> str:
    """The text with [KIND] in place of each span (by start), in one pass."""
    out, at = [], 0
    for x in spans:
        if x["start"] >= at:
            out += [text[at : x["start"]], "[", x["kind"].upper(), "]"]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """mask(detect(df)) in one step between Spark and Python, so that a task needs one worker instead of two."""

    @F.arrow_udf("string")
    def rewritten(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for a, b in slices(texts):
                own = [masked(t, [dict(zip(SPAN_FIELDS, s, strict=True)) for s in find(t)]) if t else t for t in texts.slice(a, b - a).to_pylist()]
                parts.append(pa.array(own, pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.withColumn(text, rewritten(F.col(text)))


def mask(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with each span of its text replaced by [KIND]; the spans column goes.

    Where spans of two kinds overlap, the earlier one is replaced and the other one's rest with it.
    Null texts stay null. Time is linear in the length of a text.
    """

    @F.arrow_udf("string")
    def rewritten(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            parts = []
            for a, b in slices(texts):
                own = zip(texts.slice(a, b - a).to_pylist(), found.slice(a, b - a).to_pylist(), strict=True)
                parts.append(pa.array([masked(t, s) if t and s else t for t, s in own], pa.string()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return df.withColumn(text, rewritten(F.col(text), F.col(spans))).drop(spans)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, spans: str = "pii_spans", key: str = "doc_id") -> DataFrame:
    base = F.filter(F.col(spans), lambda s: s["base"])
    count = lambda kind: F.size(F.filter(F.col(spans), lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select(key, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: personal data of all documents."""
    return digests(detect(table(spark, sf_dir, "documents").select("doc_id", "text")))

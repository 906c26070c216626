"""Quality rules as one Spark projection (operator 2): no user functions, no Python in the plan.

METRICS holds Spark expressions over let-bound arrays (words, lines, window hashes), RULES the
thresholds. compile_rules() turns the table into columns of the same projection.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import table

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Very common words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by at this are from an or not have "
    "de la le et les des un une en du que pour est dans qui par sur avec au "
    "der die und das ist von zu den mit sich des auf für im dem ein eine nicht "
    "el los las y del se por con para una su al lo como más"
).split()


class Rule(NamedTuple):
    """kept needs low <= metric <= high (a missing bound doesn't bind)."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 40.0),
    Rule("symbols", "symbols_per_word", high=0.15),
    Rule("dup_lines", "dup_line_ratio", high=0.5),
    Rule("shouting", "shouted_word_ratio", high=0.2),
    Rule("bars", "bar_word_ratio", high=0.08),
    Rule("stop_words", "stop_word_ratio", low=0.01),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element array binds it as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    n = F.size(words) - WINDOW + 1
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(h: Column) -> Column:
        # places of repeated windows, in order; each adds the words that the one before lacks
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = F.filter(
                F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))).alias("twice"))),
                lambda x: F.coalesce(x["twice"], F.lit(False)),
            )
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return F.aggregate(
            let(placed, places),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
            lambda s: s["n"],
        )

    return F.when(n < 2, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("bigint")


def measures(text: Column) -> Column:
    """All counts of one text as a struct."""
    words = F.filter(F.split(text, WHITE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(ws: Column) -> Column:
        count = lambda keep: F.size(F.filter(ws, keep)).cast("bigint")
        return F.struct(
            F.size(ws).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("bigint").alias("word_chars"),
            F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            F.size(lines).cast("bigint").alias("n_lines"),
            repeat_words(ws).alias("n_repeat_words"),
            count(lambda w: w.endswith("!!")).alias("n_shouted"),
            count(lambda w: w == "|").alias("n_bars"),
            count(lambda w: w.isin(*STOP_WORDS)).alias("n_stop"),
        )

    return let(words, of)


def compile_rules(rules: tuple[Rule, ...], m) -> dict[str, Column]:
    """Columns of every metric and of every rule's verdict; m(name) gives a count."""
    metrics = {
        "mean_word_chars": ratio(m("word_chars"), m("n_words")),
        "symbols_per_word": ratio(m("n_symbols"), m("n_words")),
        "dup_line_ratio": ratio(m("n_dup_lines"), m("n_lines")),
        "shouted_word_ratio": ratio(m("n_shouted"), m("n_words")),
        "bar_word_ratio": ratio(m("n_bars"), m("n_words")),
        "stop_word_ratio": ratio(m("n_stop"), m("n_words")),
    }
    out = dict(metrics)
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (metrics[r.metric] >= r.low)
        if r.high is not None:
            ok = ok & (metrics[r.metric] <= r.high)
        out[f"ok_{r.name}"] = ok
    return out


def quality(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, counts, metrics, verdict of each rule, base_failed, kept), one row for each row.

    Null and empty texts have no words and fail the base rule. Ratios over nothing are 0. Null
    keys, ties and repeated rows pass through; extra columns, of whatever name, are dropped; an
    empty table gives an empty result. Windows are compared by 64-bit hashes of their words.
    """
    m = df.select(df[key].alias("key"), measures(F.coalesce(df[text], F.lit(""))).alias("m")).select("key", "m.*")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    verdicts = compile_rules(rules, F.col)
    passed = ~base
    for r in rules:
        passed = passed & verdicts[f"ok_{r.name}"]
    out = m.select("*", *(c.alias(n) for n, c in verdicts.items()), base.alias("base_failed"), passed.alias("kept"))
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the rules over all documents."""
    rows = quality(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB SQL, counted by joins of windows instead of hashes."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    metric = {
        "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "shouted_word_ratio": "n_shouted / n_words", "bar_word_ratio": "n_bars / n_words", "stop_word_ratio": "n_stop / n_words",
    }
    tests = [f"{metric[r.metric]} >= {r.low!r}" for r in rules if r.low is not None] + [f"{metric[r.metric]} <= {r.high!r}" for r in rules if r.high is not None]
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS ls
  FROM documents),
g AS (
  SELECT r, i, list_slice(ws, i, i + 7) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda w: w LIKE '%!!')) AS n_shouted, len(list_filter(ws, lambda w: w = '|')) AS n_bars,
    len(list_filter(ws, lambda w: w IN ({stop}))) AS n_stop
  FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE {" AND ".join(tests)} END AS kept
FROM b"""

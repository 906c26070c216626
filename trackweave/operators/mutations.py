"""A keyed collection as the fold of its log: rows set, deleted, changed in a field, or promoted to another key.

log: seq (bigint, one a row), kind, id, new_id, field, and row, a struct of the collection's fields.

* set: row under id. A key that is there keeps its place, any other goes to the end.
* delete: the key goes; set again, it goes to the end.
* field: the field named takes its value from row; a key that isn't there is left alone.
* promote: a copy of id under new_id, a key used for nothing else before, with the fields of row that aren't null;
  the original goes unless it was permanent already. A key that isn't there is left alone.

Keys are never null. A key's rows spread over buckets of `width` numbers of seq, so that one with a large share
of the log is not one task's; only what a bucket passes on meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.ordered import with_last, with_previous
from trackweave.storage import written

WIDTH = 1 << 16


def _bucketed(log: DataFrame, width: int) -> DataFrame:
    return log.withColumn("__part", F.floor(F.col("seq") / width))


def _value(field: str) -> Column:
    """The field's value where the row gives it one, boxed."""
    gives = (F.col("kind") == "set") | ((F.col("kind") == "field") & (F.col("field") == field))
    return F.when(gives, F.struct(F.col("row")[field].alias("v")))


def _unfolded(log: DataFrame, fields: list[str], permanent: str, width: int) -> DataFrame:
    """log with each promotion as the set and the delete that it comes to.

    A copy can be promoted again: those whose original is no copy are told first, then those of their copies.
    """
    log = written(log, "log")
    while True:
        waiting = log.filter("kind = 'promote'").select("seq", "id", "new_id")
        if waiting.isEmpty():
            return log
        copies = waiting.select(F.col("new_id").alias("id"), F.col("seq").alias("made"))
        later = waiting.join(copies, "id").filter("made < seq").select("seq").distinct()
        ready = waiting.select("seq").join(later, "seq", "left_anti")
        state = with_last(_bucketed(log, width), ["id"], ["seq"], {f"__{f}": _value(f) for f in fields}, "__part").drop("__part")
        takes = ~F.coalesce(F.col(f"__{permanent}.v"), F.lit(False))
        asked = written(state.filter("kind = 'promote'").join(ready, "seq", "left_semi").withColumn("__takes", takes), "asked")
        # a promotion that takes the original is a delete to those after it, so each one asks what came before, then tells
        ends = log.filter("kind IN ('set', 'delete')").select("seq", "id", F.lit(0).alias("step"), F.col("kind").alias("says"), F.lit(False).alias("asks"))
        asks = asked.select("seq", "id", F.lit(0).alias("step"), F.lit(None).cast("string").alias("says"), F.lit(True).alias("asks"))
        tells = asked.filter("__takes").select("seq", "id", F.lit(1).alias("step"), F.lit("delete").alias("says"), F.lit(False).alias("asks"))
        life = with_last(_bucketed(ends.unionByName(asks).unionByName(tells), width), ["id"], ["seq", "step"], {"__life": F.col("says")}, "__part")
        now = asked.join(life.filter("asks AND __life = 'set'").select("seq"), "seq", "left_semi")
        copy = F.struct(*(F.coalesce(F.col("row")[f], F.col(f"__{f}.v")).alias(f) for f in fields))
        none = F.lit(None).cast("string")
        sets = now.select("seq", F.lit("set").alias("kind"), F.col("new_id").alias("id"), F.lit(None).cast(log.schema["new_id"].dataType).alias("new_id"), none.alias("field"), copy.alias("row"))
        gone = now.filter("__takes").select("seq", F.lit("delete").alias("kind"), "id", F.lit(None).cast(log.schema["new_id"].dataType).alias("new_id"), none.alias("field"), F.lit(None).cast(log.schema["row"].dataType).alias("row"))
        log = written(log.join(ready, "seq", "left_anti").unionByName(sets).unionByName(gone), "log")


def fold(log: DataFrame, permanent: str = "isPermanent", width: int = WIDTH) -> DataFrame:
    """(id, the fields, ord): the collection after the whole log; ord orders it."""
    fields = log.select("row.*").columns
    log = _unfolded(log.select("seq", "kind", "id", "new_id", "field", "row"), fields, permanent, width)
    life = with_previous(_bucketed(log.filter("kind IN ('set', 'delete')"), width), ["id"], ["seq"], F.col("kind"), "__prev", "__part")
    enters = (F.col("kind") == "set") & (F.coalesce(F.col("__prev.value"), F.lit("delete")) == "delete")
    there = life.groupBy("id").agg(F.max_by("kind", "seq").alias("kind"), F.max(F.when(enters, F.col("seq"))).alias("ord")).filter("kind = 'set'")
    # of the rows that give a field a value the last one counts: what came before a delete is older than the set after it
    values = log.groupBy("id").agg(*(F.max_by(_value(f), F.when(_value(f).isNotNull(), F.col("seq"))).alias(f) for f in fields))
    return there.join(values, "id").select("id", *(F.col(f"{f}.v").alias(f) for f in fields), "ord")


def with_table(table: DataFrame, log: DataFrame) -> DataFrame:
    """log with the rows of a collection (id, fields, ord) as sets before it; seq of log counts from 0."""
    fields = log.select("row.*").columns
    size = table.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("__from"))
    first = table.crossJoin(F.broadcast(size)).select((F.col("ord") - F.col("__from")).alias("seq"), F.lit("set").alias("kind"), "id", F.lit(None).cast(log.schema["new_id"].dataType).alias("new_id"), F.lit(None).cast("string").alias("field"), F.struct(*fields).cast(log.schema["row"].dataType).alias("row"))
    return first.unionByName(log.select(*first.columns))

"""A collection kept by a stream of its log: after each batch the whole of it, in order.

The log is that of operators.mutations, with the fields as columns beside the others instead of row, and the collection's
name. State is a map of the rows by their keys, so a batch touches only the keys it names; what it
puts out is every row of the collections that it changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that map state needs; set it before the query starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Snapshots(StatefulProcessor):
    """fields: names of the collection's fields; permanent: that which keeps the original of a promotion."""

    def __init__(self, fields: str, permanent: str):
        self.schema, self.permanent = fields, permanent
        self.fields = [f.split()[0] for f in fields.split(",")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "id string", f"place bigint, {self.schema}")

    def _apply(self, op: tuple, given: dict) -> None:
        rows, key = self.rows, (op.id,)
        old = rows.getValue(key) if rows.containsKey(key) else None
        if op.kind == "set":
            rows.updateValue(key, (int(op.seq) if old is None else old[0], *(given[f] for f in self.fields)))
        elif old is None:
            return
        elif op.kind == "delete":
            rows.removeKey(key)
        elif op.kind == "field":
            rows.updateValue(key, (old[0], *(given[f] if f == op.field else v for f, v in zip(self.fields, old[1:], strict=True))))
        elif op.kind == "promote":
            rows.updateValue((op.new_id,), (int(op.seq), *(v if given[f] is None else given[f] for f, v in zip(self.fields, old[1:], strict=True))))
            if not old[1 + self.fields.index(self.permanent)]:
                rows.removeKey(key)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("seq", kind="stable")
        log = log.astype(object).where(log.notna(), None)
        for op in log.itertuples(index=False):
            self._apply(op, {f: getattr(op, f) for f in self.fields})
        all_rows = sorted((v[0], k[0], *v[1:]) for k, v in self.rows.iterator())
        upto = int(log["seq"].iloc[-1])
        # an empty collection is told too: one row without a key
        found = [(key[0], upto, i, k, *v) for i, (_, k, *v) in enumerate(all_rows)] or [(key[0], upto, None, None, *[None] * len(self.fields))]
        yield pd.DataFrame(found, columns=["collection", "upto", "place", "id", *self.fields]).astype(object)

    def close(self) -> None:
        pass


def snapshots(log: DataFrame, fields: str, permanent: str = "isPermanent") -> DataFrame:
    """(collection, upto, place, id, fields) of a stream log(collection, seq, kind, id, new_id, field, the fields).

    Each batch gives every collection that it changed whole: its rows numbered from 0 in order, upto being the last seq taken in; an
    empty collection is one row without id. seq ascends from batch to batch; keys are texts. fields: their names and types, as "name string, price double".
    """
    columns = [f.split()[0] for f in fields.split(",")]
    rows = log.select("collection", "seq", "kind", "id", "new_id", "field", *columns)
    kind = rows.schema["collection"].dataType.simpleString()
    return rows.groupBy("collection").transformWithStateInPandas(Snapshots(fields, permanent), f"collection {kind}, upto bigint, place bigint, id string, {fields}", "Update", "None")

"""Values kept per key in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State processors need this store; what a session had before is put back once a query has started.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LOWEST = -(1 << 63)


def places(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Order columns as values that compare the same way in Python: times and dates as whole numbers, null first."""
    out = []
    for name in order:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(kind, T.DateType):
            c = F.unix_date(c)
        elif not isinstance(kind, T.IntegralType):
            raise ValueError(f"cannot keep a place in the order of {name}: {kind.simpleString()}")
        out.append(F.coalesce(c.cast("long"), F.lit(_LOWEST)))
    return out


class LastValue(StatefulProcessor):
    """Per key the value with the highest place so far.

    A step is one batch's last value of the key.  For each step the processor
    gives what was kept before it.  The step that was taken last is remembered with what it
    met, so a step that comes again gets the same answer.
    """

    def __init__(self, keys: Sequence[str], forget_ms: int | None):
        self.keys, self.forget_ms = keys, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "batch long, place array<long>, value string, old_place array<long>, old_value string", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = tuple(self.last.get()) if self.last.exists() else None
        for batch, place, value in sorted((r["batch"], tuple(r["place"]), r["value"]) for r in rows):
            if kept and batch < kept[0]:
                continue  # settled long ago
            old = (kept[3], kept[4]) if kept and batch == kept[0] else (kept[1], kept[2]) if kept else (None, None)
            newer = old[0] is None or place > tuple(old[0])
            kept = (batch, list(place), value, *old) if newer else (batch, list(old[0]), old[1], *old)
            yield Row(**dict(zip(self.keys, key, strict=True)), batch=batch, place=old[0] and list(old[0]), value=old[1])
        if kept:
            self.last.update(kept)

    def close(self) -> None:
        pass


def kept_before(steps: DataFrame, keys: Sequence[str], forget_ms: int | None = None) -> DataFrame:
    """(keys, batch, place, value): for each step (keys, batch, place, value) of a stream, what was kept for its key before."""
    shape = T.StructType([*[steps.schema[k] for k in keys], T.StructField("batch", T.LongType()), T.StructField("place", T.ArrayType(T.LongType())), T.StructField("value", T.StringType())])
    return steps.groupBy(*keys).transformWithState(LastValue(list(keys), forget_ms), shape, "append", "ProcessingTime" if forget_ms else "None")

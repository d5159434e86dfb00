"""Decisions in the order of event time over streams whose rows come in any order.

Rows of a key wait in a list state until the watermark has passed them, then they are decided
one after another, as a replay of the whole log decides them.  An event-time timer wakes a
key when its earliest row is due.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows that are sorted together, and that ``step`` takes at once, at most (but for rows of one time).
BAND, STEP = 1_000_000, 10_000


def _packed(rows: pa.Table) -> tuple[bytes, int]:
    """Rows as compressed Arrow, and the least of their times."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return sink.getvalue().to_pybytes(), pc.min(rows["us"]).as_py()


def _read(packs: list[bytes]) -> Iterator[pa.Table]:
    return (pa.ipc.open_stream(p).read_all() for p in packs)


class InOrder(StatefulProcessor):
    """Rows (``us`` and other fields) of a key, given to ``step`` sorted once no earlier one can come.

    ``step(key, memory, rows)`` returns the new memory (JSON; None drops the key) and a list of rows.
    Rows wait in packs, and those due are read band by band of time, so a task holds a key's packs and
    one band.  Rows without a request_id are not given.
    """

    def __init__(self, fields: str, columns: list[str], order: list[str], step: Callable):
        self.schema, self.columns, self.order, self.step = to_arrow_schema(StructType.fromDDL(fields)), columns, order, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary, least long")
        self.memory = handle.getValueState("memory", "json string")

    def _wake(self, packs: list[tuple[bytes, int]]) -> None:
        self.handle.registerTimer(-(-min(least for _, least in packs) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = [_packed(pa.Table.from_pandas(frame[self.schema.names], schema=self.schema, preserve_index=False)) for frame in rows if len(frame)]
        if found:
            self.waiting.appendList(found)
            self._wake(found)
        yield pd.DataFrame(columns=self.columns)

    def _bands(self, packs: list[bytes], until: int) -> Iterator[pa.Table]:
        """The rows up to ``until`` in order, of equal times together."""
        n, some = 0, []
        for t in _read(packs):
            us = np.sort(t["us"].to_numpy())
            us = us[us <= until]
            n += len(us)
            some.append(us[::100])
        ends = [*np.unique(np.quantile(np.concatenate(some), np.linspace(0, 1, n // BAND + 2)[1:-1], method="nearest")).tolist(), until] if n else []
        low = None
        for end in ends:
            inside = [t.filter((pc.field("us") <= end) & (pc.field("us") > low) if low is not None else pc.field("us") <= end) for t in _read(packs)]
            yield pa.concat_tables(inside).filter(pc.field("request_id").is_valid()).sort_by([(c, "ascending") for c in self.order])
            low = end

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # The watermark is a number of milliseconds: later microseconds of it may still come.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        packs = [tuple(p) for p in self.waiting.get()]
        due = [bytes(rows) for rows, least in packs if least <= until]
        if not due:
            return
        memory = json.loads(self.memory.get()[0]) if self.memory.exists() else None
        for band in self._bands(due, until):
            us, start = band["us"].to_numpy(), 0
            while start < len(us):
                end = int(np.searchsorted(us, us[min(start + STEP, len(us)) - 1], side="right"))
                memory, out = self.step(key, memory, band.slice(start, end - start).to_pandas().itertuples(index=False))
                memory, start = json.loads(json.dumps(memory)), end
                yield pd.DataFrame(out, columns=self.columns)
        if memory is None:
            self.memory.clear()
        else:
            self.memory.update((json.dumps(memory),))
        late = [t for t in (t.filter(pc.field("us") > until) for t in _read(due)) if t.num_rows]
        rest = [p for p in packs if p[1] > until] + [_packed(t) for t in late]
        if rest:
            self.waiting.put(rest)
            self._wake(rest)
        else:
            self.waiting.clear()


def in_order(df: DataFrame, keys: list[str], fields: str, out: str, order: list[str], step: Callable, watermark_s: int) -> DataFrame:
    """``df`` (with ``ts``) decided by ``step`` in the order of ``order`` within ``keys``.

    Rows later than the watermark are dropped, as Spark drops them for any operator with
    state; the last ``watermark_s`` wait for later rows, whatever key these have.  Rows without
    a request_id only move the watermark.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    names = [c.split()[0] for c in out.split(", ")]
    timed = df.withWatermark("ts", f"{watermark_s} seconds").withColumn("us", F.unix_micros("ts"))
    return timed.groupBy(*keys).transformWithStateInPandas(InOrder(fields, names, order, step), outputStructType=out, outputMode="Append", timeMode="EventTime")

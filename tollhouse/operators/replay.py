"""Decisions that depend on earlier ones, taken in order within a key."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are packed together at most.
PACK = 4096


def _kept_packed(rows: DataFrame, keys: list[str], cut: list[str], order: list[str]) -> DataFrame:
    """``rows`` as compressed Arrow batches ``__rows`` of up to ``PACK``, each of one value of ``keys`` and ``cut``, with these and the first values of ``order``."""
    head = [*keys, *cut, *order]
    schema = StructType([rows.schema[c] for c in head]).add("__rows", "binary")
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table)
            first = [pa.array([table[c][0].as_py()], out.field(c).type) for c in head]
            held.clear()
            return pa.RecordBatch.from_arrays([*first, pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=out)

        for batch in batches:
            groups = pd.DataFrame({c: batch.column(c).to_pandas() for c in (*keys, *cut)})
            starts = (groups.ne(groups.shift()) & ~(groups.isna() & groups.shift().isna())).any(axis=1).to_numpy().nonzero()[0].tolist()
            starts = sorted({0, *starts})
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                now = tuple(batch.column(c)[start].as_py() for c in (*keys, *cut))
                if held and now != own:
                    yield flush()
                own = now
                while start < end:
                    step = min(end - start, PACK - sum(b.num_rows for b in held))
                    held.append(batch.slice(start, step))
                    start += step
                    if sum(b.num_rows for b in held) == PACK:
                        yield flush()
        if held:
            yield flush()

    return rows.repartition(*keys, *cut).sortWithinPartitions(*keys, *cut, *order).mapInArrow(run, schema)


def replayed(rows: DataFrame, keys: list[str], order: list[str], fresh: Callable[[], Callable[[tuple], tuple]], schema: str, cut: list[str] | None = None) -> DataFrame:
    """A row of ``schema`` for each of ``rows`` for which the decider has one, decided in the order of ``order`` within equal ``keys``.

    ``fresh`` gives a new decider, a function of a row, for each key.  Rows stream through a
    task sorted, in Arrow batches, so only the decider's state is held, whatever rows a key has.
    With ``cut``, columns that ascend with ``order``, rows are sorted in their stretches by many
    tasks first and packed; the task of a key then sorts compressed packs instead of rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, decide = None, None
        for frame in frames:
            found = []
            for r in frame.itertuples(index=False):
                # Missing values of pandas differ from themselves; null is a key like others.
                own = tuple(v if v == v else None for v in (getattr(r, k) for k in keys))
                if decide is None or own != last:
                    last, decide = own, fresh()
                if (said := decide(r)) is not None:
                    found.append(said)
            if found:
                yield pd.DataFrame(found, columns=names)

    if not cut:
        return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    result = to_arrow_schema(StructType.fromDDL(schema))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = (p.as_py() for b in batches for p in b.column("__rows"))
        for frame in run(pa.ipc.open_stream(p).read_all().to_pandas() for p in packs):
            yield pa.RecordBatch.from_pandas(frame, schema=result, preserve_index=False)

    return _kept_packed(rows, keys, cut, order).repartition(*keys).sortWithinPartitions(*keys, *cut, *order).mapInArrow(unpacked, schema)


def stepped(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the session's shared folder (``spark.checkpoint.dir``): lineage ends at files that outlive executors.

    Where a session on one machine names none, as in tests, one is set; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tollhouse-shared-"))
    return df.checkpoint()

"""Row numbers over any number of rows by a prefix scan of sorted partitions: no task holds a key or the whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from serigraph.sources.storage import checkpoint


def _sorted(rows: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Rows in ranges of by, sorted within; explicit partitions, which are not merged later."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)


def numbered(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """rows with name, their number from 0 in the order of by, which must be total; null sorts first.

    The sorted partitions are checkpointed, so that a row's place does not change while the sizes of the partitions
    before its own are summed, a row for each task.
    """
    placed = _sorted(rows, by).select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed = checkpoint(placed)
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = placed.groupBy("_task").agg(F.count("*").alias("n")).select("_task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_task").select(*rows.columns, (F.col("_base") + F.col("_place")).alias(name))


def running_sums(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows with c_before for each of columns (whole numbers): its sum over the rows before, in the order of by, which must be total."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    names = [f"{c}_before" for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, so_far = TaskContext.get().partitionId(), [0] * len(columns)
        for batch in batches:
            more = []
            for i, c in enumerate(columns):
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                more.append(pa.array(so_far[i] + np.cumsum(x) - x))
                so_far[i] += int(x.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(np.full(batch.num_rows, task, np.int32))], names=[*batch.schema.names, *names, "_task"])

    placed = checkpoint(_sorted(rows, by).mapInArrow(run, f"{kinds}, {', '.join(f'`{n}` long' for n in names)}, _task int"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    totals = placed.groupBy("_task").agg(*[F.sum(c).alias(c) for c in columns])
    bases = totals.select("_task", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    return placed.join(F.broadcast(bases), "_task").select(*rows.columns, *[(F.col(n) + F.col(f"_{c}")).alias(n) for n, c in zip(names, columns, strict=True)])


class _Runs:
    """Counts along sorted batches: how many rows, and how many that count, of the same key came before each row."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys, self.last, self.seen = keys, None, (0, 0)

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each row's key differs from the one before, and the two counts."""
        n = batch.num_rows
        new = np.zeros(n, bool)
        for key in self.keys:
            column = batch.column(key)
            null, value = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
            new[1:] |= (null[1:] != null[:-1]) | (value[1:] != value[:-1])
        first = tuple(batch.column(k)[0].as_py() for k in self.keys)
        new[0] = first != self.last
        counts = batch.column("_counts").to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: the key goes on from the batch before
        before = np.cumsum(counts) - counts
        raw = np.arange(n) - np.where(run >= 0, starts[run] if len(starts) else 0, 0) + np.where(run < 0, self.seen[0], 0)
        some = before - np.where(run >= 0, before[starts[run]] if len(starts) else 0, 0) + np.where(run < 0, self.seen[1], 0)
        self.last = tuple(batch.column(k)[n - 1].as_py() for k in self.keys)
        self.seen = int(raw[-1]) + 1, int(some[-1] + counts[-1])
        return new, raw, some


def numbered_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], counts: Column, raw: str, pos: str) -> DataFrame:
    """rows with raw, the number from 0 of a row among those of its keys (whole numbers) in the given order, and pos, how many of those before it meet counts.

    Rows are dealt in ranges of keys and order, so that one key of any length is many tasks of like size. Each task numbers
    its rows; what its first key has in the tasks before is added, told by the first and last keys of all tasks, a row for each.
    Columns of order are dropped.
    """
    kept = [c for c in rows.columns if c not in order]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, task, leading = _Runs(keys), TaskContext.get().partitionId(), True
        for batch in batches:
            if not batch.num_rows:
                continue
            began = runs.last is not None
            new, first, some = runs(batch)
            changes = np.cumsum(new) - (not began)
            lead = (changes == 0) & leading
            leading = bool(lead[-1])
            columns = [*(batch.column(c) for c in kept), pa.array(first), pa.array(some), pa.array(np.full(len(new), task, np.int32)), pa.array(lead)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_raw", "_pos", "_task", "_lead"])

    source = _sorted(rows.withColumn("_counts", counts), [*keys, *order]).select(*kept, "_counts")
    placed = checkpoint(source.mapInArrow(number, f"{kinds}, _raw long, _pos long, _task int, _lead boolean"))
    met = counts.cast("int")
    key = F.struct(*keys)
    # of the first and the last key of each task: the rows, and those that count, in that task
    at = F.struct("_lead", "_raw", "_pos")
    edges = placed.groupBy("_task").agg(
        F.max(F.when(F.col("_lead"), F.struct(at, key.alias("key"), met.alias("met")))).alias("head"), F.max(F.struct((~F.col("_lead")).alias("later"), key.alias("key"), at.alias("at"), met.alias("met"))).alias("tail"),
    )
    tasks = Window.orderBy("_task")  # a row for each task
    own = edges.select("_task", F.col("head.key").alias("first"), F.col("tail.key").alias("last"), (~F.col("tail.later")).alias("single"), (F.col("tail.at._raw") + 1).alias("n"), (F.col("tail.at._pos") + F.col("tail.met")).alias("m"))
    goes_on = F.coalesce(F.lag("last").over(tasks).eqNullSafe(F.col("first")) & (F.row_number().over(tasks) > 1), F.lit(False))
    chained = own.withColumn("on", goes_on).withColumn("chain", F.sum(F.when(F.col("on") & F.col("single"), 0).otherwise(1)).over(tasks.rowsBetween(Window.unboundedPreceding, 0)))
    so_far = Window.partitionBy("chain").orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)
    sums = chained.select("_task", "on", F.sum("n").over(so_far).alias("n"), F.sum("m").over(so_far).alias("m"))
    bases = sums.select("_task", *[F.when(F.col("on"), F.lag(c).over(tasks)).otherwise(0).alias(f"_{c}") for c in "nm"])
    joined = placed.join(F.broadcast(bases), "_task")
    base = lambda c: F.when(F.col("_lead"), F.col(c)).otherwise(0)
    return joined.select(*kept, (F.col("_raw") + base("_n")).alias(raw), (F.col("_pos") + base("_m")).alias(pos))

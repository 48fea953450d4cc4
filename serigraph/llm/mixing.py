"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from serigraph.llm._common import checkpoint

#: Words: runs of bytes other than space and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of sources is broadcast only when it has no more rows and bytes of names than these.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Add weight and target to (source, source_size).

    Sources in code-point order, null last, get the weights in turn. share * (sum of sizes) is dealt by weight; a target
    above limit * source_size is set to that, and what is over goes to the others by weight, again and again until no
    target is above its limit. Each turn is an aggregate to one row.
    """
    ordered = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = checkpoint(ordered.withColumn("weight", weight).drop("rank"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap, level, full = limit * F.col("source_size"), 0.0, -1
    while True:
        above = cap < level * F.col("weight")
        row = sources.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if row[0] == full:
            break
        full = row[0]
        level = (share * total - limit * (row[1] or 0)) / row[2] if row[2] else float("inf")
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _ranked(sources: DataFrame) -> DataFrame:
    """rank from 0 in order of source, null last: ranks inside range partitions, moved by the rows of those before."""
    order = F.col("source").asc_nulls_last()
    parts = checkpoint(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").count()
    offsets = counts.withColumn(
        "before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("inside", inside).join(offsets, "part").withColumn("rank", F.col("inside") + F.col("before")).drop("part", "count", "before", "inside")


ADDED = ("size", "source_size", "target", "copies")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, seed: int = 17, keep_text: bool = True) -> DataFrame:
    """Add size, source_size, target and copies to docs (doc_id, text, source, ...).

    copies = floor(rate), and one more with a probability of the rest, drawn from a hash of seed and doc_id, where rate =
    target / source_size of the source. Reruns agree; rows that repeat a doc_id get the same draw. Null text has size 0;
    a null source is a source; a source without words has rate 0; an empty table gives an empty one. Other columns stay, but
    those named like the added ones are replaced. At most ceil(limit) copies are made. Without keep_text the words are
    counted once, and the column text goes.
    """
    row = F.struct(*[docs[c] for c in docs.columns if c.lower() not in ADDED and (keep_text or c.lower() != "text")])
    return _planned(docs, row, weights, share, limit, seed, keep_text).select("row.*", *ADDED)


def _planned(docs: DataFrame, row: F.Column, weights: tuple[float, ...], share: float, limit: float, seed: int, keep_text: bool) -> DataFrame:
    """(row, size, source_size, target, copies): the struct row stands for whatever columns docs has."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    sized = docs.select(row.alias("row"), F.col("source").alias("of_source"), draw.alias("draw"), F.xxhash64("doc_id", "text").alias("salt"), size.alias("size"))
    if not keep_text:
        sized = checkpoint(sized)
    sums = sized.groupBy(F.col("of_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = checkpoint(source_targets(sums, weights, share, limit))
    rows, names = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    same = F.col("source").eqNullSafe(F.col("of_source"))  # the null source meets its own sum
    if rows <= BROADCAST_ROWS and names <= BROADCAST_BYTES:
        joined = sized.join(F.broadcast(targets), same)
    else:
        # many sources: shuffle join on (source, salt), so that a hot source is dealt over 32 tasks
        salted = targets.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = sized.withColumn("salt", F.pmod("salt", F.lit(32)).cast("int")).join(salted, same & (F.col("salt") == F.col("of_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = F.when(F.col("draw") < rate - F.floor(rate), 1).otherwise(0)
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + extra).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus itself: every row of docs as often as plan_mix says, with the columns of docs, whatever their names."""
    planned = _planned(docs, F.struct("*"), weights, share, limit, seed, True).where("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

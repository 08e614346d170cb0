"""Ordered-history helpers that stay spread out when one key holds most of the rows.

A plain window partitioned by key puts all of a key's history in one task. Here each key's history is cut into time
buckets: the ordered work runs per (key, bucket), one summary row per bucket is carried from bucket to bucket, and the
two are joined on (key, bucket). Only the summaries, whose number is bounded by the time range over the bucket width,
ever meet in one task. The rows are shuffled once, since window, join and later windows share the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
BUCKET = "_bucket"


def with_bucket(df: DataFrame, order: str, seconds: int = DAY) -> DataFrame:
    return df if BUCKET in df.columns else df.withColumn(BUCKET, F.floor(F.unix_micros(order) / (seconds * 1_000_000)))


def _order(order: str, tie: Sequence[str]) -> list[Column]:
    return [F.col(order), *[F.col(t) for t in tie]]


def _carry(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(summary, [*keys, BUCKET], "left")


def previous_row(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], tie: Sequence[str] = (), name: str = "prev", seconds: int = DAY) -> DataFrame:
    """Add struct ``name`` holding ``cols`` of the row before this one in the key's history; null on the first row."""
    rows = with_bucket(df, order, seconds)
    at = F.struct(*_order(order, tie))
    wanted = F.struct(*cols)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie))
    tails = rows.groupBy(*keys, BUCKET).agg(F.max_by(wanted, at).alias("_tail"))
    tails = tails.select(*keys, BUCKET, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_before"))
    return _carry(rows.withColumn(name, F.lag(wanted).over(local)), tails, keys).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def next_row(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], tie: Sequence[str] = (), name: str = "next", seconds: int = DAY) -> DataFrame:
    """Mirror image of ``previous_row``."""
    rows = with_bucket(df, order, seconds)
    at = F.struct(*_order(order, tie))
    wanted = F.struct(*cols)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie))
    heads = rows.groupBy(*keys, BUCKET).agg(F.min_by(wanted, at).alias("_head"))
    heads = heads.select(*keys, BUCKET, F.lead("_head").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("_after"))
    return _carry(rows.withColumn(name, F.lead(wanted).over(local)), heads, keys).withColumn(name, F.coalesce(name, "_after")).drop("_after")


def around_row(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Add structs ``prev`` and ``next`` in one pass."""
    rows = with_bucket(df, order, seconds)
    at = F.struct(*_order(order, tie))
    wanted = F.struct(*cols)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie))
    per_key = Window.partitionBy(*keys).orderBy(BUCKET)
    ends = rows.groupBy(*keys, BUCKET).agg(F.max_by(wanted, at).alias("_tail"), F.min_by(wanted, at).alias("_head"))
    ends = ends.select(*keys, BUCKET, F.lag("_tail").over(per_key).alias("_before"), F.lead("_head").over(per_key).alias("_after"))
    joined = _carry(rows.select("*", F.lag(wanted).over(local).alias("prev"), F.lead(wanted).over(local).alias("next")), ends, keys)
    return joined.withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after")).drop("_before", "_after")


def last_known(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], tie: Sequence[str] = (), include_current: bool = True, seconds: int = DAY) -> DataFrame:
    """Add, per name, the latest non-null value of its expression up to this row (or strictly before it)."""
    rows = with_bucket(df, order, seconds)
    at = F.struct(*_order(order, tie))
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie)).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    tails = rows.groupBy(*keys, BUCKET).agg(*[F.max_by(F.when(e.isNotNull(), e), F.when(e.isNotNull(), at)).alias(f"_t_{n}") for n, e in values.items()])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select(*keys, BUCKET, *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in values])
    rows = rows.select("*", *[F.last(e, ignorenulls=True).over(local).alias(f"_l_{n}") for n, e in values.items()])
    joined = _carry(rows, tails, keys)
    kept = [c for c in df.columns if c not in values and c != BUCKET]
    return joined.select(*kept, *([BUCKET] if BUCKET in joined.columns else []), *[F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in values])


def next_known(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Add, per name, the earliest non-null value of its expression from this row on."""
    rows = with_bucket(df, order, seconds)
    at = F.struct(*_order(order, tie))
    # walked backwards: a frame that grows costs a step a row, one that shrinks is read anew to its end for every row
    local = Window.partitionBy(*keys, BUCKET).orderBy(*[c.desc() for c in _order(order, tie)]).rowsBetween(Window.unboundedPreceding, 0)
    heads = rows.groupBy(*keys, BUCKET).agg(*[F.min_by(F.when(e.isNotNull(), e), F.when(e.isNotNull(), at)).alias(f"_t_{n}") for n, e in values.items()])
    after = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*keys, BUCKET, *[F.last(f"_t_{n}", ignorenulls=True).over(after).alias(f"_b_{n}") for n in values])
    rows = rows.select("*", *[F.last(e, ignorenulls=True).over(local).alias(f"_l_{n}") for n, e in values.items()])
    joined = _carry(rows, heads, keys)
    kept = [c for c in df.columns if c not in values and c != BUCKET]
    return joined.select(*kept, BUCKET, *[F.coalesce(f"_l_{n}", f"_b_{n}").alias(n) for n in values])


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Add, per name, the key's running total of its expression up to and including this row."""
    rows = with_bucket(df, order, seconds).select("*", *[e.alias(f"_v_{n}") for n, e in values.items()])
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, BUCKET).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, BUCKET, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in values])
    joined = _carry(rows.select("*", *[F.sum(f"_v_{n}").over(local).alias(f"_l_{n}") for n in values]), totals, keys)
    extra = [f"_{x}_{n}" for n in values for x in "vlo"]
    return joined.withColumns({n: F.coalesce(f"_o_{n}", F.lit(0)) + F.col(f"_l_{n}") for n in values}).drop(*extra)


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Add the key's running total of ``value`` up to and including this row."""
    return running_sums(df, keys, order, {name: value}, tie, seconds)


def running_max(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Add the largest ``value`` strictly before this row."""
    rows = with_bucket(df, order, seconds).withColumn("_value", value)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie)).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, BUCKET).agg(F.max("_value").alias("_top"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, BUCKET, F.max("_top").over(before).alias("_earlier"))
    joined = _carry(rows.withColumn("_local", F.max("_value").over(local)), tops, keys)
    return joined.withColumn(name, F.greatest("_local", "_earlier")).drop("_value", "_local", "_earlier")


def drop_bucket(df: DataFrame) -> DataFrame:
    return df.drop(BUCKET)


def islands(df: DataFrame, keys: Sequence[str], order: str, starts: Column, name: str = "island", tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Number each key's runs: ``starts`` is true on the first row of a run."""
    return running_sum(df, keys, order, F.when(starts, 1).otherwise(0), name, tie, seconds)


def gap_islands(df: DataFrame, keys: Sequence[str], order: str, gap_seconds: float, name: str = "island", tie: Sequence[str] = (), seconds: int = DAY) -> DataFrame:
    """Number runs in which consecutive rows are at most ``gap_seconds`` apart."""
    seen = previous_row(df, keys, order, [order], tie, "_prev", seconds)
    gap = F.unix_micros(order) - F.unix_micros(F.col("_prev")[order])
    return islands(seen, keys, order, F.col("_prev").isNull() | (gap > int(gap_seconds * 1_000_000)), name, tie, seconds).drop("_prev")


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], direction: str = "backward", tie: str | None = None, seconds: int = DAY) -> DataFrame:
    """Add struct ``match`` with ``on`` and ``cols`` of the nearest right row at or before (or at or after) the left row.

    Both sides become one history per key, so a row is matched by a running last value and no pairs are formed.
    Right rows at the same moment count; among them the one with the greatest (backward) or least (forward) ``tie`` wins.
    """
    # right rows sort before left ones going backward and after them going forward, so equal times always match
    right_side = 0 if direction == "backward" else 1
    match = F.struct(on, *cols)
    tie_value = F.col(tie) if tie else F.lit(None).cast("string")
    wide_left = left.select(*by, F.col(on), F.struct(*left.columns).alias("_row"), F.lit(1 - right_side).alias("_side"))
    wide_right = right.select(*by, F.col(on), match.alias("_match"), F.lit(right_side).alias("_side"), tie_value.alias("_tie"))
    both = wide_left.unionByName(wide_right, allowMissingColumns=True)
    fill = last_known if direction == "backward" else next_known
    filled = fill(both, by, on, {"match": F.col("_match")}, tie=["_side", "_tie"], seconds=seconds)
    return filled.where(F.col("_row").isNotNull()).select("_row.*", "match")


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, cols: Sequence[str], tolerance_s: float | None = None, tie: str | None = None, seconds: int = DAY) -> DataFrame:
    """Nearest right row in time within the tolerance; on equal gaps the later one wins."""
    backward = asof(left, right, by, on, cols, "backward", tie, seconds).withColumnRenamed("match", "_back")
    both = asof(backward, right, by, on, cols, "forward", tie, seconds).withColumnRenamed("match", "_fwd")
    at = F.unix_micros(on)
    back_gap, fwd_gap = at - F.unix_micros(F.col("_back")[on]), F.unix_micros(F.col("_fwd")[on]) - at
    later = fwd_gap.isNotNull() & (back_gap.isNull() | (fwd_gap <= back_gap))
    gap = F.when(later, fwd_gap).otherwise(back_gap) / 1e6
    result = both.withColumn("match", F.when(later, F.col("_fwd")).otherwise(F.col("_back"))).withColumn("gap_s", gap).drop("_back", "_fwd")
    if tolerance_s is not None:
        inside = F.col("gap_s") <= tolerance_s
        result = result.withColumn("match", F.when(inside, F.col("match"))).withColumn("gap_s", F.when(inside, F.col("gap_s")))
    return result


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> DataFrame:
    """The newest row per key; rows are combined before the shuffle."""
    whole = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(*_order(order, tie))).alias("_r")).select("_r.*")


def top_per_key(df: DataFrame, keys: Sequence[str], ordering: Sequence[Column], n: int, name: str = "_rank") -> DataFrame:
    """First n rows per key; Spark keeps n per key on each side of the shuffle, so a hot key never travels whole."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)))
    return ranked.where(F.col(name) <= n)


def previous_rows(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], n: int, tie: Sequence[str] = (), name: str = "prev", seconds: int = DAY) -> DataFrame:
    """Add array ``name`` with the n rows before this one, nearest last."""
    rows = with_bucket(df, order, seconds)
    wanted = F.struct(*cols)
    at = F.struct(*_order(order, tie))
    local = Window.partitionBy(*keys, BUCKET).orderBy(*_order(order, tie)).rowsBetween(-n, -1)
    tails = top_per_key(rows.select(*keys, BUCKET, at.alias("at"), wanted.alias("w")), [*keys, BUCKET], [F.col("at").desc()], n)
    tails = tails.groupBy(*keys, BUCKET).agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(-n, -1)
    tails = tails.select(*keys, BUCKET, F.flatten(F.collect_list(F.col("_tail.w")).over(before)).alias("_before"))
    joined = _carry(rows.withColumn("_local", F.collect_list(wanted).over(local)), tails, keys)
    both = F.concat("_before", "_local")
    return joined.withColumn(name, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n)).drop("_local", "_before")


def newest_rows(df: DataFrame, keys: Sequence[str], order: str, n: int, name: str = "age", seconds: int = DAY) -> DataFrame:
    """The n newest rows per key, numbered from 1. For large n: rows per time bucket are counted first, buckets older than the
    one holding the n-th row are dropped, and only what is left is ordered per key."""
    rows = with_bucket(df, order, seconds)
    newer = Window.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, BUCKET).agg(F.count("*").alias("_n"))
    needed = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < n).select(*keys, BUCKET)
    return top_per_key(rows.join(needed, [*keys, BUCKET], "left_semi").drop(BUCKET), keys, [F.col(order).desc()], n, name)

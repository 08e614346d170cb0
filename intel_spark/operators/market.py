"""Candle series, anomaly detectors, coordination and liquidation cascades."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.scoring import clamp, severity_for, severity_rank
from intel_spark.operators.timeline import drop_bucket, latest_per_key, newest_rows, running_sums, top_per_key
from intel_spark.session import checkpoint_ready

# Severity ladders.
PRICE_SIGMA = (3.0, 4.0, 5.0, 7.0)
VOLUME_MULTIPLE = (2.0, 3.0, 5.0, 10.0)
SERIES = ["asset", "exchange"]
RULES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14_400, "1d": 86_400}


def micros(col: str):
    return F.unix_micros(F.col(col))


def floor_time(col: str, seconds: int):
    return F.timestamp_seconds(F.floor(micros(col) / (seconds * 1_000_000)) * seconds)


def resample(candles: DataFrame, rule: str = "1h") -> DataFrame:
    """Open, high, low, close and volume per left-closed bucket; empty buckets do not appear."""
    return candles.groupBy(*SERIES, floor_time("ts", RULES[rule]).alias("ts_bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("ts_bucket", "ts")


def composite(candles: DataFrame) -> DataFrame:
    """One row per (asset, ts): bars by exchange, mean close and total volume."""
    bar = F.struct("exchange", F.struct("open", "high", "low", "close", "volume").alias("bar"))
    return candles.groupBy("asset", "ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(bar))).alias("bars"), F.round(F.avg("close"), 8).alias("close"), F.round(F.sum("volume"), 8).alias("volume_total")
    )


def percent_change(value: Column, base: Column) -> Column:
    """Change in percent as floating point has it: from zero it is infinite, from zero to zero not a number."""
    moved = value - base
    return F.when(base != 0, moved / base * 100).when(moved > 0, float("inf")).when(moved < 0, float("-inf")).when(moved.isNotNull(), float("nan"))


def returns(candles: DataFrame, span_seconds: int = 86_400) -> DataFrame:
    """Percent change from the series' previous candle; the first candle has none."""
    from intel_spark.operators.timeline import previous_row

    seen = previous_row(candles, SERIES, "ts", ["ts", "close"], seconds=span_seconds)
    return seen.withColumn("ret", percent_change(F.col("close"), F.col("prev.close")))


def volatility(candles: DataFrame, window_minutes: int = 60, extreme_percent: float = 5.0) -> DataFrame:
    """Realised volatility and window moves per series; needs five returns."""
    moves = returns(candles)
    # the step between a series' first two candles decides how many make a day
    heads = top_per_key(candles.select(*SERIES, "ts"), SERIES, [F.col("ts")], 2).groupBy(*SERIES).agg((F.max(micros("ts")) - F.min(micros("ts"))).alias("step"))
    stats = moves.groupBy(*SERIES).agg(F.count("*").alias("candles"), F.count("ret").alias("n"), F.stddev_samp("ret").alias("std"), F.avg(F.abs("ret")).alias("mean_abs"))
    windows = candles.groupBy(*SERIES, floor_time("ts", window_minutes * 60).alias("w")).agg(F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"))
    move = F.abs(percent_change(F.col("b"), F.col("a")))
    extremes = windows.groupBy(*SERIES).agg(F.max(move).alias("max_move"), F.count_if(move >= extreme_percent).alias("extreme_windows"))
    per_day = F.when(F.col("step") <= 60_000_000, 1440).otherwise(288)
    daily = F.col("std") * F.sqrt(per_day)
    return stats.where(F.col("n") >= 5).join(heads, SERIES).join(extremes, SERIES).select(
        *SERIES, "candles", F.round(daily, 4).alias("daily_percent"), F.round(daily * F.sqrt(F.lit(365)), 2).alias("annual_percent"),
        F.round("max_move", 4).alias("max_window_move"), F.round("mean_abs", 5).alias("mean_abs_return"), "extreme_windows",
    )


def volatility_series(candles: DataFrame, window_minutes: int = 60) -> DataFrame:
    """Sample deviation of returns per window (windows with one return drop out) and the series' median."""
    per_window = returns(candles).where(F.col("ret").isNotNull()).groupBy(*SERIES, floor_time("ts", window_minutes * 60).alias("w")).agg(F.stddev_samp("ret").alias("vol")).where(F.col("vol").isNotNull())
    baseline = per_window.groupBy(*SERIES).agg(F.median("vol").alias("baseline"))
    return per_window.join(baseline, SERIES)


def volatility_clusters(series: DataFrame, multiple: float = 2.0, window_minutes: int = 60) -> DataFrame:
    """Runs of consecutive windows above ``multiple`` times the median."""
    from intel_spark.operators.timeline import around_row, drop_bucket, islands

    active = F.when(F.col("baseline") > 0, F.col("vol") > F.col("baseline") * multiple).otherwise(F.col("vol") > 0)
    flagged = around_row(series.withColumn("active", active), SERIES, "w", ["w", "active"])
    starts = F.col("active") & ~F.coalesce(F.col("prev.active"), F.lit(False))
    runs = drop_bucket(islands(flagged, SERIES, "w", starts)).where("active")
    # a run ends where the next surviving window begins; the last window of a series ends on the clock
    last = F.max_by(F.coalesce("next.w", F.timestamp_micros(micros("w") + window_minutes * 60_000_000)), F.col("w"))
    return runs.groupBy(*SERIES, "island").agg(
        F.min("w").alias("start"), last.alias("end"), F.count("*").alias("windows"), F.round(F.max("vol"), 5).alias("peak"),
        F.round(F.max("vol") / F.nullif(F.max("baseline"), F.lit(0.0)), 2).alias("multiple_of_median"),
    ).drop("island")


def price_anomalies(candles: DataFrame, sigma: float = 3.0, baseline: int = 10_080, min_points: int = 60, last: int = 10) -> DataFrame:
    """Closes more than ``sigma`` deviations from the trailing mean that excludes them, in the last rows only.

    Only the newest ``last + baseline`` candles of a series can matter. Older days are dropped by a count per day, so a
    series holding most of the table still brings a bounded number of rows to its window.
    """
    recent = newest_rows(candles.select(*SERIES, "ts", "close"), SERIES, "ts", last + baseline)
    history = Window.partitionBy(*SERIES).orderBy("ts").rowsBetween(-baseline, -1)
    scored = recent.select("*", F.avg("close").over(history).alias("mean"), F.stddev_samp("close").over(history).alias("std"), F.count("close").over(history).alias("points"))
    z = (F.col("close") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    hits = scored.where((F.col("age") <= last) & (F.col("points") >= min_points)).withColumn("z", z).where(F.abs("z") >= sigma)
    change = F.when(F.col("mean") != 0, F.round((F.col("close") - F.col("mean")) / F.col("mean") * 100, 3))
    return hits.select(
        *SERIES, "ts", F.lit("price_anomaly").alias("alert_type"), F.col("close").alias("price"), change.alias("change_pct"), F.round("z", 2).alias("z_score"),
        severity_for(F.abs("z"), PRICE_SIGMA).alias("severity"), F.round(clamp(F.abs("z") / (2 * sigma)), 2).alias("confidence"),
        F.format_string("%s: close %,.2f is %.1f sigma %s the trailing mean (%,.2f)", F.col("exchange"), F.col("close"), F.abs("z"), F.when(F.col("z") > 0, "above").otherwise("below"), F.col("mean")).alias("summary"),
    )


def volume_spikes(candles: DataFrame, multiple: float = 2.0, window_minutes: int = 5, baseline_hours: int = 24, min_windows: int = 12) -> DataFrame:
    """Latest window against the mean of the windows before it, empty ones counting as zero.

    Windows in the look-back are a fixed number, so their zero-filled mean is the volume in it divided by that number;
    no calendar is generated.
    """
    width = window_minutes * 60
    ends = candles.groupBy(*SERIES).agg(F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"))
    first_w, last_w = F.floor(micros("first_ts") / (width * 1_000_000)), F.floor(micros("last_ts") / (width * 1_000_000))
    lookback = max(1, baseline_hours * 60 // window_minutes)
    ends = ends.select(*SERIES, last_w.alias("last_w"), F.least(last_w - first_w, F.lit(lookback)).alias("back"), (last_w - first_w + 1).alias("windows")).where(F.col("windows") >= min_windows + 1)
    placed = candles.withColumn("w", F.floor(micros("ts") / (width * 1_000_000))).join(ends, SERIES).where(F.col("w") >= F.col("last_w") - F.col("back"))
    latest = F.col("w") == F.col("last_w")
    sums = placed.groupBy(*SERIES, "last_w", "back").agg(
        F.sum(F.when(latest, F.col("volume"))).alias("volume"), F.sum(F.when(~latest, F.col("volume")).otherwise(0.0)).alias("earlier"), F.max_by("close", "ts").alias("price")
    )
    ratio = F.col("volume") / F.col("baseline")
    hits = sums.withColumn("baseline", F.col("earlier") / F.col("back")).where((F.col("baseline") > 0) & (ratio >= multiple))
    return hits.select(
        *SERIES, F.timestamp_seconds(F.col("last_w") * width).alias("ts"), F.lit("volume_spike").alias("alert_type"), "price", F.round("volume", 4).alias("volume"), F.round(ratio, 2).alias("volume_multiplier"),
        severity_for(ratio, VOLUME_MULTIPLE).alias("severity"), F.round(clamp(0.5 + (ratio - multiple) / (multiple * 4)), 2).alias("confidence"),
    )


def aligned_returns(candles: DataFrame, last: int | None = None, min_candles: int = 3) -> DataFrame:
    """Percent returns on timestamps every exchange of the asset has.

    With ``last`` only the newest returns per asset are built; ``pos`` counts back from the newest one (1).
    """
    venues = candles.groupBy(*SERIES).agg(F.count("*").alias("n")).where(F.col("n") >= min_candles)
    needed = venues.groupBy("asset").agg(F.count("*").alias("venues")).where(F.col("venues") >= 2)
    usable = candles.join(venues.select(*SERIES), SERIES, "left_semi")
    closes = usable.groupBy("asset", "ts").agg(F.map_from_entries(F.collect_list(F.struct("exchange", "close"))).alias("closes"))
    full = closes.join(needed, "asset").where(F.size("closes") == F.col("venues"))
    if last is not None:
        full = top_per_key(full, ["asset"], [F.col("ts").desc()], last + 1, "pos")
        prior = F.lead("closes").over(Window.partitionBy("asset").orderBy("pos"))
        paired = full.withColumn("before", prior)
    else:
        from intel_spark.operators.timeline import drop_bucket, previous_row

        paired = drop_bucket(previous_row(full, ["asset"], "ts", ["closes"])).withColumn("before", F.col("prev.closes")).drop("prev").withColumn("pos", F.lit(None).cast("int"))
    long = paired.where(F.col("before").isNotNull()).select("asset", "ts", "pos", "before", F.explode("closes").alias("exchange", "close"))
    base = F.element_at("before", F.col("exchange"))
    return long.select("asset", "exchange", "ts", "pos", "close", percent_change(F.col("close"), base).alias("ret"))


def _rolling_correlation(rets: DataFrame, movers: DataFrame, lookback: int) -> DataFrame:
    """(asset, centre, a, b, c): correlation of two movers' returns over the ``lookback`` + 1 returns up to a centre.

    Sums of both returns, their squares and their product run along the positions of each pair of venues, so a window's
    correlation is the difference of two rows. Windows in which a venue hardly moves have none and count as 0.
    """
    met = movers.select("asset", "centre", F.col("exchange").alias("a")).join(movers.select("asset", "centre", F.col("exchange").alias("b")), ["asset", "centre"]).where("a < b")
    of = lambda x: rets.select("asset", F.col("exchange").alias(x), "pos", F.col("ret").alias(f"r{x}"))
    both = met.select("asset", "a", "b").distinct().join(of("a"), ["asset", "a"]).join(of("b"), ["asset", "b", "pos"])
    # returns from a price of zero are not finite: they count in windows that hold them and are kept out of the sums
    finite = lambda c: F.abs(c) < float("inf")
    odd = F.when(finite(F.col("ra")) & finite(F.col("rb")), 0.0).otherwise(1.0)
    both = both.select("asset", "a", "b", "pos", odd.alias("odd"), *[F.when(odd == 0, F.col(c)).otherwise(0.0).alias(c) for c in ("ra", "rb")])
    terms = {"n": F.lit(1.0), "odd": F.col("odd"), "x": F.col("ra"), "y": F.col("rb"), "xx": F.col("ra") * F.col("ra"), "yy": F.col("rb") * F.col("rb"), "xy": F.col("ra") * F.col("rb")}
    upto = Window.partitionBy("asset", "a", "b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = both.select("asset", "a", "b", "pos", F.struct(*[F.sum(e).over(upto).alias(k) for k, e in terms.items()]).alias("s"))
    pair = ["asset", "a", "b"]
    last = sums.groupBy(*pair).agg(F.max("pos").alias("deepest"))
    windows = met.join(last, pair).select(*pair, "centre", F.least(F.col("centre") + lookback, F.col("deepest")).alias("far"), (F.col("centre") - 1).alias("near"))
    spans = windows.join(sums.select(*pair, F.col("pos").alias("far"), F.col("s").alias("f")), [*pair, "far"]).join(sums.select(*pair, F.col("pos").alias("near"), F.col("s").alias("e")), [*pair, "near"], "left")
    d = {k: F.col(f"f.{k}") - F.coalesce(F.col(f"e.{k}"), F.lit(0.0)) for k in terms}
    vx, vy = d["n"] * d["xx"] - d["x"] * d["x"], d["n"] * d["yy"] - d["y"] * d["y"]
    # a difference of large sums is no variance below their rounding
    moved = (vx > 1e-9 * F.col("f.n") * F.col("f.xx")) & (vy > 1e-9 * F.col("f.n") * F.col("f.yy"))
    return spans.select("asset", "centre", "a", "b", F.when(d["odd"] > 0, float("nan")).when(moved, (d["n"] * d["xy"] - d["x"] * d["y"]) / F.sqrt(vx * vy)).otherwise(0.0).alias("c"))


def _volume_multiple(candles: DataFrame, probes: DataFrame, lookback: int) -> DataFrame:
    """(asset, exchange, ts, multiple): a candle's volume over the mean of the ``lookback`` candles before it.

    Candles are numbered and their volumes summed along each series of the probes; the mean is the difference of two
    numbered rows, so an event meets three candles of its series and not all of them.
    """
    series = candles.join(probes.select("asset", "exchange").distinct(), ["asset", "exchange"], "left_semi").select("asset", "exchange", "ts", "volume")
    numbered = drop_bucket(running_sums(series, ["asset", "exchange"], "ts", {"k": F.lit(1).cast("long"), "total": F.col("volume")}))
    at = probes.join(numbered.select("asset", "exchange", "ts", "k", "volume"), ["asset", "exchange", "ts"]).withColumns({"before": F.col("k") - 1, "begin": F.greatest(F.col("k") - 1 - lookback, F.lit(0).cast("long"))})
    sums = lambda n: numbered.select("asset", "exchange", F.col("k").alias(n), F.col("total").alias(f"{n}_total"))
    found = at.join(sums("before"), ["asset", "exchange", "before"]).join(sums("begin"), ["asset", "exchange", "begin"], "left")
    mean = (F.col("before_total") - F.coalesce("begin_total", F.lit(0.0))) / (F.col("before") - F.col("begin"))
    return found.where(mean > 0).select("asset", "exchange", "ts", (F.col("volume") / mean).alias("multiple"))


def coordination(candles: DataFrame, min_correlation: float = 0.85, min_move: float = 2.0, lookback: int = 60, last: int = 10, candle_seconds: int = 60, neighbour: int = 1) -> DataFrame:
    """Two or more exchanges moving together within one candle, with correlated recent returns."""
    rets = aligned_returns(candles, last + lookback + neighbour)
    # Only the newest returns take part from here on: their number per asset is fixed by the arguments.
    enough = rets.groupBy("asset").agg(F.max("pos").alias("depth")).where(F.col("depth") >= 5)
    checkpoint_ready(candles.sparkSession)
    rets = rets.join(enough.select("asset"), "asset", "left_semi").checkpoint()
    centres = rets.select("asset", F.col("pos").alias("centre")).distinct().where(F.col("centre") <= last)
    near = centres.join(rets, "asset").where(F.abs(F.col("pos") - F.col("centre")) <= neighbour)
    movers = near.groupBy("asset", "centre", "exchange").agg(F.max_by(F.struct("ts", "ret", "pos"), F.struct(F.abs("ret"), F.col("pos"))).alias("m")).where(F.abs("m.ret") >= min_move)
    groups = movers.groupBy("asset", "centre").agg(
        F.count("*").alias("venues"), F.sort_array(F.collect_list("exchange")).alias("exchanges"), F.min("m.ts").alias("ts"), F.max("m.ts").alias("last_ts"), F.avg(F.abs("m.ret")).alias("move"),
        F.min(F.signum("m.ret")).alias("lo"), F.max(F.signum("m.ret")).alias("hi"), F.min("exchange").alias("lead"),
    ).where((F.col("venues") >= 2) & (F.col("lo") == F.col("hi")))
    pairs = _rolling_correlation(rets, movers, lookback).groupBy("asset", "centre").agg(F.min("c").alias("correlation"))
    found = groups.join(pairs, ["asset", "centre"]).withColumn("delta_s", ((micros("last_ts") - micros("ts")) / 1e6).cast("int"))
    found = found.where((F.col("correlation") >= min_correlation) & (F.col("delta_s") <= candle_seconds * neighbour))
    # the oldest centre that reports a moment wins, as when rows are read in time order
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("asset", "ts").orderBy(F.col("centre").desc()))).where("_r = 1").drop("_r")
    found = found.checkpoint()  # a few moments per asset
    probes = found.select("asset", "ts", F.explode("exchanges").alias("exchange"))
    multiples = probes.join(_volume_multiple(candles, probes, lookback), ["asset", "exchange", "ts"]).groupBy("asset", "ts").agg(F.round(F.avg("multiple"), 2).alias("volume_coordination"))
    price = candles.select("asset", F.col("exchange").alias("lead"), "ts", F.col("close").alias("price"))
    confidence = clamp(0.4 + 0.3 * (F.col("correlation") - min_correlation) / max(1e-9, 1 - min_correlation) + 0.3 * F.least(F.lit(1.0), (F.col("move") - min_move) / max(min_move, 1e-9)))
    out = found.join(multiples, ["asset", "ts"], "left").join(price, ["asset", "lead", "ts"], "left")
    return out.select("asset", "exchanges", "ts", "delta_s", F.round("move", 3).alias("move_pct"), F.round("correlation", 3).alias("correlation"), "volume_coordination", "price", F.round(confidence, 2).alias("confidence"))


def cascades(orders: DataFrame, gap_minutes: float = 2.0, min_events: int = 5, min_usd: float = 1_000_000) -> DataFrame:
    """W05 + G05: bursts of liquidation orders no further apart than the gap, with their summary.

    Sessions are merged inside each map task before the shuffle, so a venue holding most orders ships few rows.
    """
    sums = orders.groupBy(*SERIES, F.session_window("ts", f"{int(gap_minutes * 60)} seconds").alias("w")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("count"), F.min_by("usd", "ts").alias("initial_usd"), F.sum("usd").alias("total_usd"),
        F.min_by("price", "ts").alias("p0"), F.max_by("price", "ts").alias("p1"), F.sum(F.when(F.col("side") == "sell", F.col("usd")).otherwise(0.0)).alias("sells"),
    ).where((F.col("count") >= min_events) & (F.col("total_usd") >= min_usd))
    side = F.when(F.col("sells") >= F.col("total_usd") / 2, "sell").otherwise("buy")
    impact = F.when(F.col("p0") != 0, F.round((F.col("p1") - F.col("p0")) / F.col("p0") * 100, 3))
    minutes = (micros("end") - micros("start")) / 6e7
    return sums.select(
        *SERIES, "start", "end", "count", "initial_usd", "total_usd", impact.alias("price_impact"), side.alias("side"), F.col("p1").alias("last_price"),
        F.format_string("%d %s liquidations on %s in %.1f min totalling $%,.0f (%s flushed)", F.col("count"), F.col("asset"), F.col("exchange"), minutes, F.col("total_usd"), F.when(side == "sell", "longs").otherwise("shorts")).alias("summary"),
    )


def nearest_external(found: DataFrame, external: DataFrame, minutes: int = 15) -> DataFrame:
    """Attach the external event (asset, ts, description) nearest to a cascade's start or end, within the window.

    Either end is matched to its neighbours in time by a running value, so no event is paired with every cascade.
    """
    from intel_spark.operators.timeline import asof_nearest

    right = external.select("asset", "ts", "description")
    keyed = found.withColumn("ts", F.col("start"))
    at_start = asof_nearest(keyed, right, ["asset"], "ts", ["description"], minutes * 60, tie="description").select(*found.columns, F.col("match.description").alias("d0"), F.col("gap_s").alias("g0"))
    keyed = at_start.withColumn("ts", F.col("end"))
    both = asof_nearest(keyed, right, ["asset"], "ts", ["description"], minutes * 60, tie="description").select(*at_start.columns, F.col("match.description").alias("d1"), F.col("gap_s").alias("g1"))
    start_wins = F.col("g0").isNotNull() & (F.col("g1").isNull() | (F.col("g0") <= F.col("g1")))
    gap = F.when(start_wins, F.col("g0")).otherwise(F.col("g1"))
    return both.select(*found.columns, F.when(start_wins, F.col("d0")).otherwise(F.col("d1")).alias("external_event"), F.round(1 - gap / 60 / minutes, 2).alias("correlation_score"))


# Cascade severity in dollars (low, medium, high, critical).
LIQUIDATION_USD = (1_000_000, 5_000_000, 20_000_000, 100_000_000)


def market_alerts(prices: DataFrame | None = None, volumes: DataFrame | None = None, coordinated: DataFrame | None = None, liquidations: DataFrame | None = None) -> DataFrame:
    """One alert schema over the detectors' outputs."""
    columns = ["asset", "alert_type", "severity", "exchanges", "price", "change_pct", "volume", "volume_multiplier", "ts", "confidence"]
    none = F.lit(None).cast("double")
    parts = []
    if prices is not None:
        parts.append(prices.select("asset", "alert_type", "severity", F.array("exchange").alias("exchanges"), "price", "change_pct", none.alias("volume"), none.alias("volume_multiplier"), "ts", "confidence"))
    if volumes is not None:
        parts.append(volumes.select("asset", "alert_type", "severity", F.array("exchange").alias("exchanges"), "price", none.alias("change_pct"), "volume", "volume_multiplier", "ts", "confidence"))
    if coordinated is not None:
        level = F.when(F.col("confidence") >= 0.8, "critical").when(F.col("confidence") >= 0.6, "high").otherwise("medium")
        parts.append(coordinated.select("asset", F.lit("coordination").alias("alert_type"), level.alias("severity"), "exchanges", "price", F.col("move_pct").alias("change_pct"), none.alias("volume"), F.col("volume_coordination").alias("volume_multiplier"), "ts", "confidence"))
    if liquidations is not None:
        level = severity_for(F.col("total_usd"), LIQUIDATION_USD)
        level = F.when(level == "none", "low").otherwise(level)
        parts.append(liquidations.select(
            "asset", F.lit("liquidation").alias("alert_type"), level.alias("severity"), F.array("exchange").alias("exchanges"), F.col("last_price").alias("price"), F.col("price_impact").alias("change_pct"),
            F.col("total_usd").alias("volume"), none.alias("volume_multiplier"), F.col("start").alias("ts"), F.least(F.lit(0.99), 0.5 + F.col("count") / 100).alias("confidence")))
    merged = parts[0].select(columns)
    for part in parts[1:]:
        merged = merged.unionByName(part.select(columns))
    return merged


def cooldown(alerts: DataFrame, minutes: int = 30) -> DataFrame:
    """Drop an alert (alert_id, ...) when its series was alerted within the cooldown at the same or a higher severity.

    Which alerts survive depends on the earlier survivors: a survivor hands over to the next alert that is either past
    the cooldown or of a higher severity. Those hand-overs are links, and the survivors are what the links reach from
    alerts that follow a silence longer than the cooldown.
    """
    from intel_spark.operators.graph import reachable
    from intel_spark.operators.timeline import asof, drop_bucket, next_known, previous_row

    keyed = alerts.withColumn("_key", F.array_join(F.sort_array("exchanges"), "|")).withColumn("_rank", severity_rank(F.col("severity")))
    keys = ["asset", "alert_type", "_key"]
    # one alert per moment and series: a second one at the same moment is the same alert again
    first = Window.partitionBy(*keys, "ts").orderBy(F.col("_rank").desc(), "alert_id")
    slim = keyed.select(*keys, "ts", "_rank", "alert_id", F.row_number().over(first).alias("_n")).where("_n = 1").drop("_n")
    span = minutes * 60_000_000
    seen = drop_bucket(previous_row(slim, keys, "ts", ["ts"]))
    heads = seen.where(F.col("prev").isNull() | (micros("ts") - F.unix_micros("prev.ts") > span)).select(F.col("alert_id").alias("id"))
    # next alert above each severity rank, then the first alert past the cooldown
    here = F.struct(micros("ts").alias("at"), F.col("alert_id").alias("id"))
    above = drop_bucket(next_known(slim, keys, "ts", {f"above_{r}": F.when(F.col("_rank") > r, here) for r in range(3)}))
    shifted = above.withColumn("ts0", F.col("ts")).withColumn("ts", F.timestamp_micros(micros("ts") + span + 1))
    later = asof(shifted, slim, keys, "ts", ["alert_id"], "forward")
    higher = F.when(F.col("_rank") == 0, F.col("above_0")).when(F.col("_rank") == 1, F.col("above_1")).when(F.col("_rank") == 2, F.col("above_2"))
    past = F.when(F.col("match").isNotNull(), F.struct(F.unix_micros("match.ts").alias("at"), F.col("match.alert_id").alias("id")))
    links = later.select(F.col("alert_id").alias("id"), F.array_min(F.array_compact(F.array(higher, past)))["id"].alias("next")).where(F.col("next").isNotNull())
    kept = reachable(links, heads).withColumnRenamed("id", "alert_id")
    return alerts.join(kept, "alert_id", "left_semi")


def latest_prices(candles: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Q01: newest candle per series, change against the last candle a day earlier, and the day's dollar volume.

    The newest time per series is an aggregate; everything else is aggregated against it in one more pass.
    """
    keys = [*SERIES, "timeframe"]
    newest = latest_per_key(candles.select(*keys, "ts", "close"), SERIES, "ts", ["timeframe"]).withColumnRenamed("ts", "last_ts").withColumnRenamed("close", "price")
    joined = candles.join(newest, keys)
    since = F.col("last_ts") - F.expr("INTERVAL 24 HOURS")
    agg = joined.groupBy(*keys, "last_ts", "price").agg(
        F.max_by(F.when(F.col("ts") <= since, F.col("close")), F.when(F.col("ts") <= since, F.col("ts"))).alias("reference"), F.sum(F.when(F.col("ts") > since, F.col("volume_usd"))).alias("day_volume")
    )
    change = F.when(F.coalesce("reference", F.lit(0.0)) != 0, F.round((F.col("price") - F.col("reference")) / F.col("reference") * 100, 3))
    out = agg.select(*keys, F.col("last_ts").alias("ts"), "price", change.alias("change_24h"), F.round("day_volume", 2).alias("volume_24h"))
    return out if as_of is None else out.withColumn("signal_quality", signal_quality(F.col("ts"), as_of))


def signal_quality(ts, as_of: datetime):
    """100 for data under two minutes old, 0 beyond about an hour."""
    age = (F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)) / 1e6
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (age - 120) / 34)).cast("int")

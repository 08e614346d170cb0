"""Structured Streaming jobs T03-T11; those on ships and aircraft are in ``vessels``. Each takes a stream and a checkpoint folder and returns the running query; the
detectors are the batch functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from intel_spark.operators import fusion, market, sanctions
from intel_spark.operators.chain import assess_transfers, capture
from intel_spark.operators.timeline import newest_rows
from intel_spark.session import checkpoint_ready

BASELINE_BARS = 10_080  # candles a price baseline may look back over


def _start(df: DataFrame, checkpoint: str, path: str, available_now: bool, interval: str = "30 seconds") -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def _each(stream: DataFrame, checkpoint: str, handle, available_now: bool, interval: str = "60 seconds") -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows written so far; none before the first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return like.limit(0)


def span(batch: DataFrame, col: str = "ts"):
    """The first and last moment of a batch: one row that becomes literals, so that stores are read by the days they name."""
    return batch.agg(F.min(col), F.max(col)).first()


def stored_days(spark: SparkSession, path: str, like: DataFrame, first: datetime, last: datetime) -> DataFrame:
    """Stored rows, without ``day``, of the days between two moments; other days' folders are not read."""
    have = stored(spark, path, like.withColumn("day", F.lit(None).cast("date")))
    return have.where(F.col("day").between(F.lit(first.date()), F.lit(last.date()))).drop("day")


def append_days(rows: DataFrame, path: str, ts: str = "ts") -> None:
    rows.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)


def start_cascades(orders: DataFrame, checkpoint: str, path: str, gap_minutes: float = 2.0, min_events: int = 5, min_usd: float = 1_000_000, watermark: str = "5 minutes", available_now: bool = False) -> StreamingQuery:
    """Sessions are emitted once the watermark passes them, so no cascade is cut by a polling interval."""
    found = market.cascades(orders.withWatermark("ts", watermark), gap_minutes, min_events, min_usd)
    return _start(found, checkpoint, path, available_now)


def start_candles(candles: DataFrame, checkpoint: str, path: str, watermark: str = "10 minutes", available_now: bool = False) -> StreamingQuery:
    """Candle upserts by day; only the days a batch touches are read and replaced."""
    spark = candles.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.withColumn("day", F.to_date("ts")).withColumn("ingest", F.lit(batch_id).cast("long"))
        fresh = fresh.persist()
        have = stored(spark, path, fresh)
        touched = have.join(fresh.select("day").distinct(), "day", "left_semi")
        merged = sanctions.upsert(fresh, touched.select(*fresh.columns), ["asset", "exchange", "timeframe", "ts"], "ingest")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        fresh.unpersist()

    return _each(candles.withWatermark("ts", watermark), checkpoint, handle, available_now)


def start_resample(candles: DataFrame, checkpoint: str, path: str, minutes: int = 60, watermark: str = "10 minutes", available_now: bool = False) -> StreamingQuery:
    """Tumbling bars of a candle stream without repeats."""
    once = candles.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["asset", "exchange", "timeframe", "ts"])
    bars = once.groupBy("asset", "exchange", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return _start(bars.select("asset", "exchange", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume"), checkpoint, path, available_now)


def start_market_alerts(candles: DataFrame, checkpoint: str, history: str, path: str, baseline: int = BASELINE_BARS, last: int = 10, sigma: float = 3.0, available_now: bool = False) -> StreamingQuery:
    """Detectors over the newest ``baseline + last`` candles of each series that a batch touches, from the store kept by
    T04; known alerts are not repeated.

    Days are counted per series first, and only those that hold one of the newest candles are read.
    """
    spark = candles.sparkSession
    series, bars = ["asset", "exchange", "timeframe"], baseline + last

    def handle(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("asset", "exchange").distinct().persist()
        first, newest = span(batch)
        if newest is None:
            return
        known = stored(spark, history, batch.withColumn("day", F.to_date("ts"))).join(touched, ["asset", "exchange"], "left_semi")
        newer = Window.partitionBy(*series).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
        days = known.groupBy(*series, "day").agg(F.count("*").alias("n")).withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
        oldest = days.where(F.col("newer") < bars).agg(F.min("day")).first()[0]
        if oldest is None:
            return
        recent = newest_rows(known.where(F.col("day") >= F.lit(oldest)).drop("day"), series, "ts", bars).drop("age").persist()
        alerts = market.market_alerts(prices=market.price_anomalies(recent, sigma, baseline=baseline, last=last), volumes=market.volume_spikes(recent))
        start, end = span(recent)
        fresh = sanctions.insert_if_absent(alerts, stored_days(spark, path, alerts, start, end), ["asset", "alert_type", "exchanges", "ts"])
        append_days(fresh, path)
        recent.unpersist()
        touched.unpersist()

    return _each(candles, checkpoint, handle, available_now)


def start_mempool_screen(transactions: DataFrame, checkpoint: str, path: str, labels: DataFrame, whale_coins: float = 100.0, available_now: bool = False) -> StreamingQuery:
    """Transactions (tx_hash, ts, inputs, outputs, total_out) that are large or touch a listed or mixer wallet. Stateless:
    a stream-static join on the addresses of each transaction."""
    marked = labels.where((F.col("chain") == "bitcoin") & F.col("wallet_type").isin("sanctioned", "mixer")).select(F.col("address"), "wallet_type").distinct()
    ends = transactions.select("tx_hash", "ts", "total_out", "inputs", "outputs", F.explode(F.array_distinct(F.concat("inputs.addr", "outputs.addr", F.array(F.lit(""))))).alias("address"))
    # every transaction keeps one placeholder row, so a large one passes without any label
    hits = ends.join(marked, "address", "left").where(F.col("wallet_type").isNotNull() | ((F.col("address") == "") & (F.col("total_out") >= whale_coins)))
    spent = F.exists("inputs", lambda i: i["addr"] == F.col("address"))
    received = F.aggregate(F.filter("outputs", lambda o: o["addr"] == F.col("address")), F.lit(0.0), lambda acc, o: acc + o["value"])
    amount = F.when(F.col("wallet_type").isNotNull() & ~spent, received).otherwise(F.col("total_out"))
    return _start(hits.select("tx_hash", "ts", F.nullif("address", F.lit("")).alias("focus"), "wallet_type", F.when(spent, "out").otherwise("in").alias("direction"), amount.alias("amount")), checkpoint, path, available_now)


def start_token_flows(transfers: DataFrame, checkpoint: str, path: str, labels: DataFrame, whale_usd: float = 5_000_000, available_now: bool = False) -> StreamingQuery:
    """Flagged or large token transfers, stored once; a transfer's day says where an earlier copy of it lies."""
    spark = transfers.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        first, last = span(batch)
        if first is None:
            return
        have = stored_days(spark, path, assess_transfers(batch, labels, whale_usd), first, last)
        append_days(capture(batch, labels, have, whale_usd=whale_usd), path)

    return _each(transfers, checkpoint, handle, available_now)


def start_listing_feed(deliveries: DataFrame, checkpoint: str, table: str, log: str, as_of: datetime, available_now: bool = False) -> StreamingQuery:
    """Each batch is one delivery of a list. The table is kept as numbered snapshots, so a replayed batch rewrites its
    own one; the change log grows by what the diff found."""
    spark = deliveries.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        empty = batch.withColumn("id", F.lit(None).cast("long")).withColumn("is_active", F.lit(True)).withColumn("delisting_date", F.lit(None).cast("timestamp"))
        # batches are numbered without a gap, so the newest snapshot is named and no other is read
        old = empty.limit(0) if batch_id == 0 else spark.read.schema(empty.schema).parquet(f"{table}/snapshot={batch_id - 1}").select(*empty.columns)
        diff = sanctions.diff_listings(old, batch).persist()
        sanctions.change_log(diff, as_of).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        sanctions.apply_diff(old, batch, diff, as_of).write.mode("overwrite").parquet(f"{table}/snapshot={batch_id}")
        diff.unpersist()
        batch.unpersist()

    return _each(deliveries, checkpoint, handle, available_now)


def start_event_ingest(drafts: DataFrame, checkpoint: str, path: str, days: int = 3, available_now: bool = False) -> StreamingQuery:
    """One event per URL within ``days``; state is bounded by the watermark."""
    return _start(drafts.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["url"]), checkpoint, path, available_now)


def start_watch_hits(records: DataFrame, checkpoint: str, path: str, items: DataFrame, available_now: bool = False) -> StreamingQuery:
    """New records that touch watched items (id, kind, key, created_at, last_checked_at), each hit stored once.

    Records are (kind, key, record_type, record_id, ts, severity) by exact key; those with a ``text`` and the ``kinds`` of items
    that look into it are searched for companies, domains and keywords too. An item sees what is not older than its last
    check, or than a week before it was created, as in the batch job.
    """
    spark = records.sparkSession
    watched = items if "last_checked_at" in items.columns else items.withColumns({"created_at": F.lit(None).cast("timestamp"), "last_checked_at": F.timestamp_seconds(F.lit(0))})

    def handle(batch: DataFrame, batch_id: int) -> None:
        first, last = span(batch)
        if first is None:
            return
        batch = batch.withColumn("record_id", F.col("record_id").cast("string"))
        texts = batch.where(F.col("text").isNotNull()).select("record_type", "record_id", "ts", "severity", "text", "kinds") if "text" in batch.columns else None
        none = batch.limit(0).select(F.lit(0).cast("long").alias("item_id"), "record_type", "record_id")
        empty = batch.limit(0).select("record_type", "record_id", "ts", "severity", F.lit("").alias("text"), F.array(F.lit("")).alias("kinds"))
        exact = batch.where(F.col("key").isNotNull()).select("kind", "key", "record_type", "record_id", "ts", "severity")
        hits = fusion.watch_hits(watched, exact, empty if texts is None else texts, none, last)
        append_days(sanctions.insert_if_absent(hits, stored_days(spark, path, hits, first, last), ["item_id", "record_type", "record_id"]), path)

    return _each(records, checkpoint, handle, available_now)


def start_fusion(signals: DataFrame, checkpoint: str, store: str, path: str, horizon_hours: float = 48.0, min_score: float = 0.45, min_domains: int = 3, available_now: bool = False) -> StreamingQuery:
    """Each batch joins the stored signals; links and clusters are counted anew over the horizon before the newest signal
    and new composite alerts appended. Signals and alerts are stored by day, and only the horizon's days are read."""
    spark = signals.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        _, newest = span(batch)
        if newest is None:
            return
        # a replayed batch replaces its own folder
        batch.withColumn("day", F.to_date("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{store}/batch={batch_id}")
        start = newest - timedelta(hours=horizon_hours)
        recent = spark.read.parquet(store).where((F.col("day") >= F.lit(start.date())) & (F.col("ts") >= F.lit(start))).drop("batch", "day").dropDuplicates(["ref"])
        checkpoint_ready(spark)
        recent = recent.checkpoint()
        alerts = fusion.composite_alerts(recent, fusion.Rules(horizon_hours, min_score), min_domains)
        # an alert is named after its anchor and first day, which lies inside the horizon
        append_days(sanctions.insert_if_absent(alerts, stored_days(spark, path, alerts, start, newest), ["fingerprint"]), path, "window_start")

    return _each(signals, checkpoint, handle, available_now)

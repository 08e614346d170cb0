"""Transfer labelling, risk patterns and wallet state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.functions.chain import listed_addresses, normalize_address, usd_value
from intel_spark.operators.sanctions import insert_if_absent

TRACEABLE = ["bitcoin", "ethereum", "tron"]
MANY_LABELS = 100_000


def wallet_assets(listings: DataFrame, labels: DataFrame) -> DataFrame:
    """F21 + J24: wallets named in listing remarks, plus labelled ones not among them."""
    found = listings.where(F.contains("remarks", F.lit("Digital Currency Address"))).select("id", "name", "authority", "is_active", F.explode(listed_addresses(F.col("remarks"))).alias("a"))
    best = found.groupBy(F.col("a.chain").alias("chain"), F.col("a.address").alias("address")).agg(F.max_by(F.struct("id", "name", "authority", "is_active", F.col("a.symbol").alias("symbol")), "id").alias("l"))
    listed = best.select(
        "chain", "address", F.when(F.col("l.is_active"), "sanctioned").otherwise("delisted").alias("wallet_type"), F.concat_ws(" ", "l.authority", "l.symbol", F.lit("-"), "l.name").alias("label"), F.col("l.name").alias("owner"),
        F.col("l.id").alias("entity_id"), F.col("l.is_active").alias("is_sanctioned"), F.col("chain").isin(TRACEABLE).alias("watch"), F.when(F.col("l.is_active"), 1.0).otherwise(0.6).alias("risk_score"),
    )
    known = labels.select("chain", normalize_address(F.col("chain"), F.col("address")).alias("address"), "wallet_type", "label", "owner").dropDuplicates(["chain", "address"])
    extra = known.join(listed.select("chain", "address"), ["chain", "address"], "left_anti").select(
        "chain", "address", "wallet_type", "label", "owner", F.lit(None).cast("long").alias("entity_id"), F.lit(False).alias("is_sanctioned"), F.lit(False).alias("watch"), F.when(F.col("wallet_type") == "mixer", 0.8).otherwise(0.2).alias("risk_score"))
    return listed.unionByName(extra)


def label_transfers(transfers: DataFrame, labels: DataFrame) -> DataFrame:
    """Wallet type and name on both ends of each transfer; Spark broadcasts the labels while they are small. Beyond that
    they are hashed partition by partition, so that transfers are shuffled to them, but not sorted and spilled for it."""
    marks = labels.where(F.col("wallet_type").isin("sanctioned", "exchange", "mixer")).select("chain", "address", "wallet_type", F.coalesce("owner", "label").alias("who"))
    if marks.count() > MANY_LABELS:
        marks = marks.hint("shuffle_hash")
    named = transfers.withColumn("_f", normalize_address(F.col("chain"), F.col("src")))
    src = marks.select("chain", F.col("address").alias("_f"), F.col("wallet_type").alias("from_type"), F.col("who").alias("source_entity"))
    dst = marks.select("chain", F.col("address").alias("_t"), F.col("wallet_type").alias("to_type"), F.col("who").alias("destination_entity"))
    # the second key is made behind the first shuffle, which need not carry it
    half = named.join(src, ["chain", "_f"], "left").drop("_f").withColumn("_t", normalize_address(F.col("chain"), F.col("dst")))
    return half.join(dst, ["chain", "_t"], "left").drop("_t")


def _patterned(transfers: DataFrame, labels: DataFrame, whale_usd: float) -> DataFrame:
    """Transfers (with ``usd``) with the names, kinds and pattern that the labels on their ends and their size give."""
    t = label_transfers(transfers, labels)
    either = lambda kind: (F.coalesce(F.col("from_type") == kind, F.lit(False)) | F.coalesce(F.col("to_type") == kind, F.lit(False)))
    sanctioned, mixer, exchange = either("sanctioned"), either("mixer"), either("exchange")
    whale = F.coalesce("usd", F.lit(0.0)) >= whale_usd
    pattern = (
        F.when(sanctioned & exchange, F.when(F.col("to_type") == "exchange", "exchange_cashout").otherwise("exchange_withdrawal_to_sanctioned"))
        .when(sanctioned & mixer, "sanctioned_mixer_usage").when(sanctioned, "sanctioned_counterparty").when(mixer, "mixer_usage").when(whale, "whale_transfer").otherwise("watched_wallet_activity")
    )
    return t.select(*transfers.columns, "source_entity", "destination_entity", sanctioned.alias("involves_sanctioned"), mixer.alias("involves_mixer"), exchange.alias("involves_exchange"), pattern.alias("pattern"))


def _described(t: DataFrame, whale_usd: float) -> DataFrame:
    """Risk and text, which follow from what ``_patterned`` gives."""
    sanctioned, mixer, exchange, pattern = (F.col(c) for c in ("involves_sanctioned", "involves_mixer", "involves_exchange", "pattern"))
    usd = F.coalesce("usd", F.lit(0.0))
    whale = usd >= whale_usd
    base = (
        F.when(sanctioned & (exchange | mixer), 0.95).when(sanctioned, 0.85).when(mixer, 0.6 + F.when(whale, 0.2).otherwise(0.0)).when(whale, 0.4 + F.least(F.lit(0.3), usd / (whale_usd * 20))).otherwise(0.3)
    )
    score = F.round(F.least(F.lit(1.0), base + F.when(usd >= whale_usd * 5, 0.05).otherwise(0.0)), 2)
    size = F.when(usd > 0, F.format_string("$%,.0f", usd)).otherwise("unknown value")
    summary = F.concat(F.replace(pattern, F.lit("_"), F.lit(" ")), F.lit(": "), size, F.lit(" "), F.coalesce("token", F.lit("")), F.lit(" from "), F.coalesce("source_entity", F.lit("unlabelled")), F.lit(" to "), F.coalesce("destination_entity", F.lit("unlabelled")))
    return t.select("*", score.alias("risk_score"), F.substring(summary, 1, 300).alias("summary"))


def assess_transfers(transfers: DataFrame, labels: DataFrame, whale_usd: float = 5_000_000, prices: DataFrame | None = None) -> DataFrame:
    """Pattern and risk of each transfer from the labels on its ends and its size.

    ``transfers`` carry ``usd``, or ``amount`` and ``token`` valued with ``prices`` (token, price).
    """
    if prices is not None:
        transfers = transfers.join(prices.select("token", F.col("price").alias("_p")), "token", "left").withColumn("usd", usd_value(F.col("amount"), F.col("token"), F.col("_p"))).drop("_p")
    return _described(_patterned(transfers, labels, whale_usd), whale_usd)


def capture(transfers: DataFrame, labels: DataFrame, stored: DataFrame, watched: DataFrame | None = None, whale_usd: float = 5_000_000) -> DataFrame:
    """X11: transfers worth storing (sanctioned, mixer, whale, or touching a watched wallet) that are not stored yet.

    Risk and text are worked out for the rows that are left: they follow from the other columns, so they neither travel
    with the rows nor decide which of two equal keys is the least.
    """
    scored = _patterned(transfers, labels, whale_usd)
    keep = F.col("involves_sanctioned") | F.col("involves_mixer") | (F.col("pattern") == "whale_transfer")
    if watched is not None:
        ends = scored.select("chain", "tx_hash", F.explode(F.array("src", "dst")).alias("address"))
        touched = ends.join(watched.select("chain", "address").distinct(), ["chain", "address"], "left_semi").select("chain", "tx_hash").distinct().withColumn("_w", F.lit(True))
        scored = scored.join(touched, ["chain", "tx_hash"], "left")
        keep = keep | F.coalesce("_w", F.lit(False))
        scored = scored.where(keep).drop("_w")
    else:
        scored = scored.where(keep)
    return _described(insert_if_absent(scored, stored, ["chain", "tx_hash"]), whale_usd)


def wallet_transfers(utxo: DataFrame, wallets: DataFrame) -> DataFrame:
    """One transfer per (watched address, transaction): direction and amount as seen from the address.

    ``utxo`` has (tx_hash, ts, inputs, outputs) with arrays of struct(addr, value).
    """
    sides = utxo.select("tx_hash", "ts", "inputs", "outputs", F.explode(F.array_distinct(F.concat("inputs.addr", "outputs.addr"))).alias("address"))
    mine = sides.join(wallets.where("chain = 'bitcoin'").select("address").distinct(), "address", "left_semi")
    total = lambda items: F.aggregate(F.filter(items, lambda i: i["addr"] == F.col("address")), F.lit(0.0), lambda acc, i: acc + i["value"])
    flows = mine.withColumn("sent", total(F.col("inputs"))).withColumn("received", total(F.col("outputs")))
    first_other = F.try_element_at(F.filter("outputs", lambda o: o["addr"] != F.col("address")), F.lit(1))["addr"]
    out = F.col("sent") > 0
    return flows.select(
        "address", "tx_hash", "ts", F.when(out, "out").otherwise("in").alias("direction"), F.when(out, F.col("address")).otherwise(F.try_element_at("inputs", F.lit(1))["addr"]).alias("src"),
        F.when(out, first_other).otherwise(F.col("address")).alias("dst"), F.when(out, F.col("sent")).otherwise(F.col("received")).alias("amount"), "sent", "received",
    )


def wallet_state(flows: DataFrame, price: float | None = None) -> DataFrame:
    """Balance, totals and activity per watched address from its transfers."""
    agg = flows.groupBy("address").agg(F.round(F.sum("received") - F.sum("sent"), 8).alias("balance"), F.round(F.sum("received"), 8).alias("inflow"), F.round(F.sum("sent"), 8).alias("outflow"), F.countDistinct("tx_hash").alias("transactions"), F.max("ts").alias("last_active"))
    return agg.withColumn("balance_usd", F.round(F.col("balance") * price, 2) if price else F.lit(None).cast("double"))


def chain_summary(wallets: DataFrame, transfers: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Tidy (metric, key, value)."""
    since = F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS")
    listed = wallets.where("is_sanctioned")
    totals = listed.agg(F.count("*").cast("double").alias("sanctioned_wallets"), F.round(F.coalesce(F.sum("balance_usd"), F.lit(0.0)), 2).alias("sanctioned_balance"), F.count_if(F.col("last_active") >= since).cast("double").alias("active_wallets")).unpivot([], ["sanctioned_wallets", "sanctioned_balance", "active_wallets"], "metric", "value").select("metric", F.lit("").alias("key"), "value")
    by_chain = listed.groupBy(F.lit("by_chain").alias("metric"), F.col("chain").alias("key")).agg(F.count("*").cast("double").alias("value"))
    recent = transfers.where(F.col("ts") >= since)
    patterns = recent.groupBy(F.lit("by_pattern").alias("metric"), F.col("pattern").alias("key")).agg(F.count("*").cast("double").alias("value"))
    volume = recent.where("involves_sanctioned").agg(F.round(F.coalesce(F.sum("usd"), F.lit(0.0)), 2).alias("value")).select(F.lit("sanctioned_volume").alias("metric"), F.lit("").alias("key"), "value")
    return totals.unionByName(by_chain).unionByName(patterns).unionByName(volume)

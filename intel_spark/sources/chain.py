"""Blockchain payloads to transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.functions.chain import hex_to_units, topic_address

SATOSHI = 100_000_000
SUN = 1_000_000
UTXO_JSON = "txid string, fee long, vin array<struct<prevout:struct<scriptpubkey_address:string,value:long>>>, vout array<struct<scriptpubkey_address:string,value:long>>, status struct<block_time:long,block_height:long>"
BLOCK_JSON = "number string, timestamp string, transactions array<struct<hash:string,from:string,to:string,value:string>>"
LOG_JSON = "address string, topics array<string>, data string, transactionHash string, logIndex string, blockNumber string"
TRON_TOKEN_JSON = "transaction_id string, block_ts long, block long, from_address string, to_address string, contract_address string, quant string, tokenInfo struct<tokenAbbr:string,tokenDecimal:int>"
TRON_NATIVE_JSON = "hash string, timestamp long, block long, ownerAddress string, toAddress string, contractType int, contractData struct<amount:string>"
TRON_ACCOUNT_JSON = "address string, balance long, transactions long, trc20token_balances array<struct<tokenId:string,tokenAbbr:string,balance:string,tokenDecimal:int>>"
# Event signature of a token transfer, and one token's contract.
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRON_USDT = "TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t"


def parsed(messages: DataFrame, schema: str) -> DataFrame:
    """JSON text rows (value) as columns; works on batches and streams."""
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("j")).select("j.*")


def load_utxo(messages: DataFrame, focus: str | None = None) -> DataFrame:
    """Inputs and outputs in coins; sources without an address are "coinbase" and "op_return"."""
    side = lambda items, address, value, missing: F.transform(items, lambda i: F.struct(F.coalesce(address(i), F.lit(missing)).alias("addr"), (F.coalesce(value(i), F.lit(0)) / SATOSHI).alias("value")))
    tx = parsed(messages, UTXO_JSON).select(
        F.col("txid").alias("tx_hash"), F.timestamp_seconds("status.block_time").alias("ts"), F.col("status.block_height").alias("height"), (F.coalesce("fee", F.lit(0)) / SATOSHI).alias("fee"),
        side(F.col("vin"), lambda i: i["prevout"]["scriptpubkey_address"], lambda i: i["prevout"]["value"], "coinbase").alias("inputs"), side(F.col("vout"), lambda o: o["scriptpubkey_address"], lambda o: o["value"], "op_return").alias("outputs"),
    )
    total = F.round(F.aggregate("outputs", F.lit(0.0), lambda acc, o: acc + o["value"]), 8)
    everyone = F.array_sort(F.array_distinct(F.concat("inputs.addr", "outputs.addr")))
    skip = [F.lit("coinbase"), F.lit("op_return"), *([F.lit(focus)] if focus else [])]
    others = F.array_except(everyone, F.array(*skip)) if focus else F.array().cast("array<string>")
    return tx.select("*", total.alias("total_out"), others.alias("counterparties"))


def load_native(messages: DataFrame, min_amount: float = 0.0) -> DataFrame:
    """Native-coin transfers of whole blocks at or above an amount."""
    txs = parsed(messages, BLOCK_JSON).select("number", "timestamp", F.explode("transactions").alias("t"))
    block = F.conv(F.regexp_replace("number", "^0x", ""), 16, 10).cast("long")
    at = F.timestamp_seconds(F.conv(F.regexp_replace("timestamp", "^0x", ""), 16, 10).cast("long"))
    out = txs.select(F.lit("ethereum").alias("chain"), F.col("t.hash").alias("tx_hash"), at.alias("ts"), block.alias("block"), F.lower("t.from").alias("src"), F.lower("t.to").alias("dst"), hex_to_units(F.col("t.value"), 18).alias("amount"), F.lit("ETH").alias("token"))
    return out.where(F.col("amount") >= min_amount)


def load_token_logs(messages: DataFrame, contracts: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """Token transfers of known contracts (address, symbol, decimals); with ``watched`` only those touching one."""
    logs = parsed(messages, LOG_JSON).where((F.size("topics") >= 3) & (F.lower(F.col("topics")[0]) == TRANSFER_TOPIC))
    known = contracts.select(F.lower("address").alias("_c"), "symbol", "decimals")
    rows = logs.withColumn("_c", F.lower("address")).join(known, "_c").select(
        F.lit("ethereum").alias("chain"), F.concat_ws(":", "transactionHash", F.conv(F.regexp_replace("logIndex", "^0x", ""), 16, 10)).alias("tx_hash"), topic_address(F.col("topics")[1]).alias("src"), topic_address(F.col("topics")[2]).alias("dst"),
        hex_to_units(F.col("data"), F.col("decimals")).alias("amount"), F.col("symbol").alias("token"), F.conv(F.regexp_replace("blockNumber", "^0x", ""), 16, 10).cast("long").alias("block"),
    )
    if watched is None:
        return rows
    seen = watched.select(F.lower("address").alias("src")).distinct()
    by_sender = rows.join(seen, "src", "left_semi")
    by_receiver = rows.join(seen.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return by_sender.unionByName(by_receiver).dropDuplicates(["chain", "tx_hash"])


def load_tron(tokens: DataFrame | None = None, native: DataFrame | None = None) -> DataFrame:
    """Token and native transfers under one schema; unreadable amounts drop out."""
    parts = []
    if tokens is not None:
        t = parsed(tokens, TRON_TOKEN_JSON)
        symbol = F.when(F.col("contract_address") == TRON_USDT, "USDT").otherwise(F.coalesce("tokenInfo.tokenAbbr", F.lit("TRC20")))
        amount = F.coalesce("quant", F.lit("0")).try_cast("double") / F.pow(F.lit(10.0), F.coalesce(F.nullif("tokenInfo.tokenDecimal", F.lit(0)), F.lit(6)))
        parts.append(t.select(F.lit("tron").alias("chain"), F.col("transaction_id").alias("tx_hash"), F.timestamp_millis("block_ts").alias("ts"), "block", F.col("from_address").alias("src"), F.col("to_address").alias("dst"), amount.alias("amount"), symbol.alias("token")))
    if native is not None:
        t = parsed(native, TRON_NATIVE_JSON).where(F.col("contractType") == 1)
        amount = F.coalesce("contractData.amount", F.lit("0")).try_cast("double") / SUN
        parts.append(t.select(F.lit("tron").alias("chain"), F.col("hash").alias("tx_hash"), F.timestamp_millis("timestamp").alias("ts"), "block", F.col("ownerAddress").alias("src"), F.col("toAddress").alias("dst"), amount.alias("amount"), F.lit("TRX").alias("token")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.where(F.col("amount").isNotNull())


def load_tron_balances(accounts: DataFrame) -> DataFrame:
    """Token balances summed per account and symbol."""
    rows = parsed(accounts, TRON_ACCOUNT_JSON).select("address", F.explode("trc20token_balances").alias("b"))
    amount = F.coalesce("b.balance", F.lit("0")).try_cast("double") / F.pow(F.lit(10.0), F.coalesce(F.nullif("b.tokenDecimal", F.lit(0)), F.lit(6)))
    return rows.select("address", F.coalesce("b.tokenAbbr", "b.tokenId", F.lit("?")).alias("token"), amount.alias("amount")).where(F.col("amount").isNotNull()).groupBy("address", "token").agg(F.sum("amount").alias("balance"))

"""Wallet address and token value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticker to chain, used where the address shape does not decide.
SYMBOL_CHAIN = {
    "XBT": "bitcoin", "BTC": "bitcoin", "BCH": "bitcoin_cash", "LTC": "litecoin", "ETH": "ethereum", "ETC": "ethereum_classic", "USDC": "ethereum",
    "USDT": "ethereum", "DAI": "ethereum", "BNB": "bsc", "BSC": "bsc", "ARB": "arbitrum", "TRX": "tron", "XMR": "monero", "ZEC": "zcash",
    "DASH": "dash", "XVG": "verge", "BTG": "bitcoin_gold", "SOL": "solana", "DOGE": "dogecoin", "XRP": "ripple", "TON": "ton",
}
EVM_CHAINS = ["ethereum", "bsc", "arbitrum", "ethereum_classic"]
EVM_TICKERS = ["ETH", "USDT", "USDC", "ETC", "BNB", "ARB", "DAI"]
STABLECOINS = ["USDT", "USDC", "DAI", "BUSD"]
ADDRESS_PATTERN = r"Digital Currency Address - ([A-Z0-9]{2,6}) ([A-Za-z0-9]{20,120})"


def detect_chain(symbol: Column, address: Column) -> Column:
    """address shape first, ticker second."""
    tickers = F.create_map(*[F.lit(x) for pair in SYMBOL_CHAIN.items() for x in pair])
    evm = F.when(symbol.isin("BNB", "BSC"), "bsc").when(symbol == "ARB", "arbitrum").otherwise("ethereum")
    bitcoin_shape = address.rlike("^(bc1|1|3)") & symbol.isin("XBT", "BTC", "USDT") & F.length(address).between(26, 62)
    return (
        F.when(F.startswith(address, F.lit("0x")) & (F.length(address) == 42), evm)
        .when(F.startswith(address, F.lit("T")) & (F.length(address) == 34), "tron")
        .when(symbol.isin("XBT", "BTC") | bitcoin_shape, "bitcoin")
        .when(F.startswith(address, F.lit("bnb1")), "bnb_beacon")
        .when(symbol.isin(EVM_TICKERS), "unknown")
        .otherwise(F.coalesce(F.try_element_at(tickers, symbol), F.lower(symbol)))
    )


def normalize_address(chain: Column, address: Column) -> Column:
    return F.when(chain.isin(EVM_CHAINS), F.lower(address)).otherwise(address)


def listed_addresses(remarks: Column) -> Column:
    """array of struct(chain, address, symbol), first mention of each (chain, address) kept."""
    symbols = F.regexp_extract_all(remarks, F.lit(ADDRESS_PATTERN), 1)
    addresses = F.regexp_extract_all(remarks, F.lit(ADDRESS_PATTERN), 2)

    def entry(symbol, address):
        chain = detect_chain(symbol, address)
        return F.struct(chain.alias("chain"), normalize_address(chain, address).alias("address"), symbol.alias("symbol"))

    found = F.zip_with(symbols, addresses, entry)
    return F.coalesce(
        F.filter(found, lambda e, i: ~F.exists(F.slice(found, F.lit(1), i), lambda p: (p["chain"] == e["chain"]) & (p["address"] == e["address"]))),
        F.array().cast("array<struct<chain:string,address:string,symbol:string>>"),
    )


def usd_value(amount: Column, token: Column, price: Column) -> Column:
    """stablecoins at par, else amount times the given price, null when there is none."""
    return F.when(token.isin(STABLECOINS), F.round(amount, 2)).when(F.coalesce(price, F.lit(0.0)) != 0, F.round(amount * price, 2))


def hex_to_decimal(value: Column) -> Column:
    """Hex quantity of any width to DECIMAL(38,0), combined from 60-bit parts; null when it does not fit."""
    digits = F.lower(F.regexp_replace(value, "^0[xX]0*", ""))
    padded = F.lpad(digits, 45, "0")
    total = F.lit(0).cast("decimal(38,0)")
    for start in (1, 16, 31):
        part = F.conv(F.substring(padded, start, 15), 16, 10).cast("decimal(38,0)")
        total = F.try_add((total * F.lit(2**60).cast("decimal(19,0)")).cast("decimal(38,0)"), part) if start > 1 else part
    # 31 hex digits (124 bits) always fit 38 decimal digits
    return F.when(value.rlike("^0[xX][0-9a-fA-F]*$") & (F.length(digits) <= 31), total)


def hex_to_units(value: Column, decimals) -> Column:
    """Token amount as a double: the hex quantity over ten to the number of decimals."""
    places = decimals if isinstance(decimals, Column) else F.lit(decimals)
    return hex_to_decimal(value).cast("double") / F.pow(F.lit(10.0), places)


def topic_address(topic: Column) -> Column:
    """Address held in the last forty hex digits of an indexed log topic."""
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, -40, 40)))

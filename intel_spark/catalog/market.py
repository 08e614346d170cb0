"""Registered market queries."""

from pyspark.sql import functions as F

from intel_spark.catalog.registry import query, r4, ts
from intel_spark.functions.scoring import severity_rank
from intel_spark.operators import market as m
from intel_spark.operators.timeline import asof, asof_nearest

SERIES = "asset, exchange"


@query("g01_resample", inputs="candles", oracle=f"""
    SELECT asset, exchange, {ts("time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')", "ts")}, {r4("min_by(open, ts)", "open")}, {r4("max(high)", "high")}, {r4("min(low)", "low")},
    {r4("max_by(close, ts)", "close")}, {r4("sum(volume)", "volume")} FROM {{candles}} c GROUP BY asset, exchange, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')""")
def _(candles):
    return m.resample(candles, "4h")


@query("g02_composite", inputs="candles", oracle=f"""
    SELECT asset, {ts("ts")}, {r4("avg(close)", "close")}, {r4("sum(volume)", "volume_total")}, count(*) AS venues, string_agg(exchange, ',' ORDER BY exchange) AS exchanges FROM {{candles}} GROUP BY asset, ts""")
def _(candles):
    return m.composite(candles).select("asset", "ts", "close", "volume_total", F.size("bars").alias("venues"), F.array_join(F.map_keys("bars"), ",").alias("exchanges"))


RETURNS = "r AS (SELECT *, (close - lag(close) OVER s) / lag(close) OVER s * 100 AS ret FROM {candles} WINDOW s AS (PARTITION BY asset, exchange ORDER BY ts))"


@query("g03_volatility", inputs="candles", oracle=f"""
    WITH {RETURNS}, st AS (SELECT asset, exchange, count(*) AS candles, count(ret) AS n, stddev_samp(ret) AS std, avg(abs(ret)) AS ma FROM r GROUP BY 1, 2),
    h AS (SELECT asset, exchange, max(epoch(ts)) - min(epoch(ts)) AS step FROM (SELECT *, row_number() OVER (PARTITION BY asset, exchange ORDER BY ts) AS k FROM {{candles}}) WHERE k <= 2 GROUP BY 1, 2),
    w AS (SELECT asset, exchange, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b, min_by(close, ts) AS a, max_by(close, ts) AS z FROM {{candles}} GROUP BY 1, 2, 3),
    x AS (SELECT asset, exchange, max(abs((z - a) / a * 100)) AS mm, count(*) FILTER (abs((z - a) / a * 100) >= 5) AS ext FROM w GROUP BY 1, 2)
    SELECT asset, exchange, candles, round(std * sqrt(CASE WHEN step <= 60 THEN 1440 ELSE 288 END), 4) AS daily_percent, round(std * sqrt(CASE WHEN step <= 60 THEN 1440 ELSE 288 END) * sqrt(365), 2) AS annual_percent,
    round(mm, 4) AS max_window_move, {r4("round(ma, 5)", "mean_abs_return")}, ext AS extreme_windows FROM st JOIN h USING (asset, exchange) JOIN x USING (asset, exchange) WHERE n >= 5""")
def _(candles):
    return m.volatility(candles, 360)


VOL = RETURNS + """, v AS (SELECT asset, exchange, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w, stddev_samp(ret) AS vol FROM r WHERE ret IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1),
    s AS (SELECT *, median(vol) OVER (PARTITION BY asset, exchange) AS baseline FROM v)"""


@query("g04_volatility_series", inputs="candles", oracle=f"WITH {VOL} SELECT asset, exchange, {ts('w')}, {r4('vol')}, {r4('baseline')} FROM s")
def _(candles):
    return m.volatility_series(candles, 360)


@query("w06_volatility_clusters", inputs="candles", oracle=f"""
    WITH {VOL}, a AS (SELECT *, vol > baseline * 1.5 AS act, coalesce(lead(w) OVER k, w + INTERVAL 6 HOUR) AS nxt, lag(vol > baseline * 1.5) OVER k AS was FROM s WINDOW k AS (PARTITION BY asset, exchange ORDER BY w)),
    i AS (SELECT *, sum(CASE WHEN act AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY asset, exchange ORDER BY w) AS island FROM a)
    SELECT asset, exchange, {ts("min(w)", "start")}, {ts("max(nxt)", '"end"')}, count(*) AS windows, {r4("round(max(vol), 5)", "peak")}, round(max(vol) / max(baseline), 2) AS multiple_of_median
    FROM i WHERE act GROUP BY asset, exchange, island""")
def _(candles):
    return m.volatility_clusters(m.volatility_series(candles, 360), 1.5, 360)


@query("w01_price_anomalies", inputs="candles", oracle=f"""
    WITH s AS (SELECT *, avg(close) OVER h AS mean, stddev_samp(close) OVER h AS std, count(close) OVER h AS points, row_number() OVER (PARTITION BY asset, exchange ORDER BY ts DESC) AS age FROM {{candles}}
      WINDOW h AS (PARTITION BY asset, exchange ORDER BY ts ROWS BETWEEN 10080 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, (close - mean) / nullif(std, 0) AS z FROM s WHERE age <= 120 AND points >= 60)
    SELECT asset, exchange, {ts("ts")}, 'price_anomaly' AS alert_type, {r4("close", "price")}, round((close - mean) / mean * 100, 3) AS change_pct, round(z, 2) AS z_score,
    CASE WHEN abs(z) >= 7 THEN 'critical' WHEN abs(z) >= 5 THEN 'high' WHEN abs(z) >= 4 THEN 'medium' ELSE 'low' END AS severity, round(least(0.99, abs(z) / 6), 2) AS confidence
    FROM z WHERE abs(z) >= 3""")
def _(candles):
    return m.price_anomalies(candles, last=120).drop("summary")


@query("w02_volume_spikes", inputs="candles", oracle=f"""
    WITH b AS (SELECT *, floor(epoch(ts) / 7200) AS w FROM {{candles}}), e AS (SELECT asset, exchange, min(w) AS fw, max(w) AS lw FROM b GROUP BY 1, 2),
    cal AS (SELECT asset, exchange, lw, unnest(generate_series(CAST(fw AS BIGINT), CAST(lw AS BIGINT))) AS w FROM e WHERE lw - fw + 1 >= 13),
    v AS (SELECT cal.asset, cal.exchange, cal.lw, cal.w, coalesce(sum(volume), 0) AS vol, max_by(close, ts) AS price FROM cal LEFT JOIN b ON b.asset = cal.asset AND b.exchange = cal.exchange AND b.w = cal.w GROUP BY 1, 2, 3, 4),
    q AS (SELECT asset, exchange, max(lw) AS lw, max(vol) FILTER (w = lw) AS volume, avg(vol) FILTER (w < lw AND w >= lw - 36) AS baseline, max(price) FILTER (w = lw) AS price FROM v GROUP BY 1, 2)
    SELECT asset, exchange, {ts("to_timestamp(lw * 7200) AT TIME ZONE 'UTC'", "ts")}, 'volume_spike' AS alert_type, {r4("price")}, {r4("volume")}, round(volume / baseline, 2) AS volume_multiplier,
    CASE WHEN volume / baseline >= 10 THEN 'critical' WHEN volume / baseline >= 5 THEN 'high' WHEN volume / baseline >= 3 THEN 'medium' WHEN volume / baseline >= 2 THEN 'low' ELSE 'none' END AS severity,
    round(greatest(0, least(0.99, 0.5 + (volume / baseline - 1.2) / 4.8)), 2) AS confidence FROM q WHERE baseline > 0 AND volume / baseline >= 1.2""")
def _(candles):
    return m.volume_spikes(candles, 1.2, 120, 72)


# bars of twelve hours give every venue the same clock
BARS = "(SELECT asset, exchange, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, max_by(close, ts) AS close, sum(volume) AS volume FROM {candles} GROUP BY 1, 2, 3)"
ALIGNED = f"""b AS {BARS}, f AS (SELECT asset, ts FROM b GROUP BY asset, ts HAVING count(*) = 3), al AS (SELECT b.* FROM b JOIN f USING (asset, ts)),
    r AS (SELECT *, (close - lag(close) OVER k) / lag(close) OVER k * 100 AS ret FROM al WINDOW k AS (PARTITION BY asset, exchange ORDER BY ts))"""


@query("w03_aligned_returns", inputs="candles", oracle=f"WITH {ALIGNED} SELECT asset, exchange, {ts('ts')}, {r4('ret')} FROM r WHERE ret IS NOT NULL")
def _(candles):
    return m.aligned_returns(m.resample(candles, "4h")).select("asset", "exchange", "ts", "ret")


@query("w04_coordination", inputs="candles", oracle=f"""
    WITH {ALIGNED}, p AS (SELECT *, row_number() OVER (PARTITION BY asset, exchange ORDER BY ts DESC) AS pos FROM r WHERE ret IS NOT NULL),
    c AS (SELECT DISTINCT asset, pos AS centre FROM p WHERE pos <= 40),
    mv AS (SELECT c.asset, centre, exchange, max_by(ts, (abs(ret), pos)) AS mts, max_by(ret, (abs(ret), pos)) AS mret FROM c JOIN p ON p.asset = c.asset AND abs(p.pos - centre) <= 1 GROUP BY 1, 2, 3 HAVING abs(mret) >= 2),
    g AS (SELECT asset, centre, count(*) AS venues, string_agg(exchange, ',' ORDER BY exchange) AS exchanges, min(mts) AS ts, max(mts) AS lts, avg(abs(mret)) AS move FROM mv GROUP BY 1, 2 HAVING count(*) >= 2 AND min(sign(mret)) = max(sign(mret))),
    co AS (SELECT a.asset, a.centre, a.exchange AS ea, b.exchange AS eb, coalesce(corr(pa.ret, pb.ret), 0) AS co FROM mv a JOIN mv b ON a.asset = b.asset AND a.centre = b.centre AND a.exchange < b.exchange
      JOIN p pa ON pa.asset = a.asset AND pa.exchange = a.exchange AND pa.pos BETWEEN a.centre AND a.centre + 60 JOIN p pb ON pb.asset = a.asset AND pb.exchange = b.exchange AND pb.pos = pa.pos GROUP BY 1, 2, 3, 4),
    m AS (SELECT g.*, (SELECT min(co) FROM co WHERE co.asset = g.asset AND co.centre = g.centre) AS corr FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY asset, ts ORDER BY centre DESC) AS rn FROM m WHERE corr >= -0.5 AND epoch(lts) - epoch(ts) <= 14400)
    SELECT asset, exchanges, {ts("ts")}, CAST(epoch(lts) - epoch(ts) AS BIGINT) AS delta_s, round(move, 3) AS move_pct, round(corr, 3) AS correlation,
    round(greatest(0, least(0.99, 0.4 + 0.3 * (corr + 0.5) / 1.5 + 0.3 * least(1.0, (move - 2) / 2))), 2) AS confidence FROM o WHERE rn = 1""")
def _(candles):
    found = m.coordination(m.resample(candles, "4h"), min_correlation=-0.5, last=40, candle_seconds=14_400)
    return found.drop("volume_coordination", "price")


SESSIONS = f"""l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY asset, exchange ORDER BY ts, event_id) AS gap FROM {{liquidations}}),
    i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 5400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset, exchange ORDER BY ts, event_id) AS island FROM l),
    s AS (SELECT asset, exchange, island, min(ts) AS start, max(ts) AS stop, count(*) AS n, min_by(usd, ts) AS initial_usd, sum(usd) AS total_usd, min_by(price, ts) AS p0, max_by(price, ts) AS p1,
      sum(CASE WHEN side = 'sell' THEN usd ELSE 0 END) AS sells FROM i GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND sum(usd) >= 100000)"""


@query("w05_g05_cascades", inputs="liquidations", oracle=f"""
    WITH {SESSIONS} SELECT asset, exchange, {ts("start")}, {ts("stop", '"end"')}, n AS count, {r4("initial_usd")}, {r4("total_usd")}, round((p1 - p0) / p0 * 100.0, 3) AS price_impact, CASE WHEN sells >= total_usd / 2 THEN 'sell' ELSE 'buy' END AS side FROM s""")
def _(orders):
    return m.cascades(orders, 90, 5, 100_000).drop("last_price", "summary")


@query("j18_nearest_external", inputs="liquidations external_events", oracle=f"""
    WITH {SESSIONS}, d AS (SELECT s.asset, s.exchange, s.start, s.stop, x.description AS x_desc, x.ts AS x_ts, least(abs(epoch_us(x.ts) - epoch_us(start)), abs(epoch_us(x.ts) - epoch_us(stop))) / 1e6 AS gap FROM s LEFT JOIN {{external_events}} x ON x.asset = s.asset)
    SELECT asset, exchange, {ts("start")}, CASE WHEN min(gap) <= 10800 THEN round(1 - min(gap) / 10800, 2) END AS correlation_score, CASE WHEN min(gap) <= 10800 THEN min_by(x_desc, (gap, x_ts)) END AS external_event FROM d GROUP BY asset, exchange, start""")
def _(orders, external):
    return m.nearest_external(m.cascades(orders, 90, 5, 100_000), external, 180).select("asset", "exchange", "start", "correlation_score", "external_event")


@query("q01_latest_prices", inputs="candles", oracle=f"""
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY asset, exchange ORDER BY ts DESC) AS rn FROM {{candles}}), n AS (SELECT asset, exchange, timeframe, ts AS last_ts, close AS price FROM l WHERE rn = 1),
    a AS (SELECT n.asset, n.exchange, n.timeframe, last_ts, price, max_by(c.close, c.ts) FILTER (c.ts <= last_ts - INTERVAL 24 HOUR) AS ref, sum(volume_usd) FILTER (c.ts > last_ts - INTERVAL 24 HOUR) AS vol FROM n JOIN {{candles}} c ON c.asset = n.asset AND c.exchange = n.exchange GROUP BY 1, 2, 3, 4, 5)
    SELECT asset, exchange, timeframe, {ts("last_ts", "ts")}, {r4("price")}, round((price - ref) / ref * 100, 3) AS change_24h, round(vol, 2) AS volume_24h FROM a""")
def _(candles):
    return m.latest_prices(candles)


@query("j12_asof_backward", inputs="fixes quotes", oracle=f"""
    SELECT f.event_id, {ts("f.ts", "ts")}, {ts("q.ts", "quote_ts")}, {r4("q.price", "price")} FROM {{fixes}} f ASOF LEFT JOIN (SELECT asset, ts, max(price) AS price FROM {{quotes}} GROUP BY asset, ts) q ON f.asset = q.asset AND f.ts >= q.ts""")
def _(fixes, quotes):
    return asof(fixes, quotes, ["asset"], "ts", ["price"], tie="price").select("event_id", "ts", F.col("match.ts").alias("quote_ts"), F.col("match.price").alias("price"))


@query("x26_market_alerts", inputs="candles liquidations", oracle=f"""
    WITH {SESSIONS}, st AS (SELECT *, avg(close) OVER h AS mean, stddev_samp(close) OVER h AS std, count(close) OVER h AS points, row_number() OVER (PARTITION BY asset, exchange ORDER BY ts DESC) AS age FROM {{candles}}
      WINDOW h AS (PARTITION BY asset, exchange ORDER BY ts ROWS BETWEEN 10080 PRECEDING AND 1 PRECEDING)), z AS (SELECT *, (close - mean) / nullif(std, 0) AS z FROM st WHERE age <= 120 AND points >= 60)
    SELECT asset, 'price_anomaly' AS alert_type, CASE WHEN abs(z) >= 7 THEN 'critical' WHEN abs(z) >= 5 THEN 'high' WHEN abs(z) >= 4 THEN 'medium' ELSE 'low' END AS severity, exchange AS exchanges, {ts("ts")}, round(least(0.99, abs(z) / 6), 2) AS confidence FROM z WHERE abs(z) >= 3
    UNION ALL SELECT asset, 'liquidation', CASE WHEN total_usd >= 1e8 THEN 'critical' WHEN total_usd >= 2e7 THEN 'high' WHEN total_usd >= 5e6 THEN 'medium' ELSE 'low' END, exchange, {ts("start", "ts")}, round(least(0.99, 0.5 + n / 100.0), 4) FROM s""")
def _(candles, orders):
    alerts = m.market_alerts(prices=m.price_anomalies(candles, last=120), liquidations=m.cascades(orders, 90, 5, 100_000))
    return alerts.select("asset", "alert_type", "severity", "exchanges", "ts", "confidence")


@query("w07_cooldown", inputs="raw_alerts", oracle=f"""
    WITH RECURSIVE o AS (SELECT *, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS rk, row_number() OVER (PARTITION BY asset, exchange ORDER BY ts, alert_id) AS k FROM {{raw_alerts}}),
    walk AS (SELECT asset, exchange, k, alert_id, true AS kept, ts AS lt, rk AS lr FROM o WHERE k = 1
      UNION ALL SELECT o.asset, o.exchange, o.k, o.alert_id, (o.ts - w.lt > INTERVAL 360 MINUTE OR o.rk > w.lr), CASE WHEN o.ts - w.lt > INTERVAL 360 MINUTE OR o.rk > w.lr THEN o.ts ELSE w.lt END, CASE WHEN o.ts - w.lt > INTERVAL 360 MINUTE OR o.rk > w.lr THEN o.rk ELSE w.lr END
      FROM walk w JOIN o ON o.asset = w.asset AND o.exchange = w.exchange AND o.k = w.k + 1)
    SELECT alert_id FROM walk WHERE kept""")
def _(alerts):
    return m.cooldown(alerts.withColumn("exchanges", F.array("exchange")), 360).select("alert_id")


@query("f30_signal_quality", inputs="candles", oracle=f"""
    SELECT asset, exchange, {ts("ts")}, CAST(trunc(greatest(0.0, least(100.0, 100 - (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) - 120) / 34))) AS BIGINT) AS quality FROM {{candles}}""")
def _(candles):
    from datetime import datetime, timezone
    return candles.select("asset", "exchange", "ts", m.signal_quality(F.col("ts"), datetime(2024, 1, 31, tzinfo=timezone.utc)).alias("quality"))

"""Queries over bar building, strategies, outputs, files and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions import ta
from barframe.operators import output, strategy
from barframe.operators.frames import bar_index, last
from barframe.plans.indicators import BARS
from barframe.sources.bars import bars_from_csv, bars_to_json, event_bars, newest, order_bars, resample
from barframe.sources.folders import shared_path
from barframe.streaming.bars import closed_bars, forming_average, run_to_end, tick_stream


def _six(x):
    return F.round(F.round(x, 9), 6)


def _plain(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.unix_millis("time").alias("time_ms"), "open", "high", "low", "close", "volume")


def bars_events(spark, folder: str) -> DataFrame:
    """Hourly bars of the event stream."""
    return _plain(event_bars(spark, folder))


def bars_orders(spark, folder: str) -> DataFrame:
    """Daily bars of orders."""
    return _plain(order_bars(spark, folder))


def bars_resampled(spark, folder: str) -> DataFrame:
    """Four-hour bars from hourly ones."""
    return _plain(resample(event_bars(spark, folder), "4h"))


def bars_newest(spark, folder: str) -> DataFrame:
    """The newest hundred bars of each symbol."""
    return _plain(newest(event_bars(spark, folder), 100))


def bars_csv(spark, folder: str) -> DataFrame:
    """Bars written as CSV and read by column position."""
    path = shared_path(spark, "csv")
    made = event_bars(spark, folder)
    made.select((F.unix_millis("time") / 1000).cast("long").alias("time"), "open", "high", "low", "close", "volume", "symbol").write.option("header", True).csv(path)
    back = bars_from_csv(spark, path, "all")
    return back.groupBy("time").agg(F.count(F.lit(1)).alias("bars"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume")).select(F.unix_millis("time").alias("time_ms"), "bars", "high", "low", "volume")


_SELECT = "SELECT symbol, epoch_ms(time) AS time_ms, open, high, low, close, volume FROM"


def _crosses(spark, folder: str) -> DataFrame:
    bars = bar_index(event_bars(spark, folder))
    means = bars.withColumns({"f5": F.avg("close").over(last(5)), "f20": F.avg("close").over(last(20))})
    return ta.crossunder(ta.crossover(means, "f5", "f20", "up"), "f5", "f20", "down")


def _signals(spark, folder: str) -> DataFrame:
    bars = _crosses(spark, folder)
    index = F.col("bar_index")
    return (
        strategy.entries(bars, F.col("up"), "L", "strategy.long", 2.0).union(strategy.closes(bars, F.col("down"), "L"))
        .union(strategy.entries(bars, F.col("down"), "S", "strategy.short")).union(strategy.exits(bars, F.col("up"), "X", "S")).union(strategy.closes(bars, index % 50 == 49, "L", 1.0))
    )


def strategy_signals(spark, folder: str) -> DataFrame:
    """Entries, closes and exits of a crossing of averages."""
    return _signals(spark, folder).select("symbol", "bar_index", F.unix_millis("time").alias("time_ms"), "kind", "ident", "direction", "qty", "price", "comment")


def _trades(spark, folder: str) -> DataFrame:
    return strategy.trades(_signals(spark, folder), commission=0.1, slippage=0.01)


def strategy_trades(spark, folder: str) -> DataFrame:
    """Closed trades, first in first out."""
    made = _trades(spark, folder)
    return made.select("symbol", "entry_id", "exit_id", "direction", "entry_bar", "exit_bar", *[_six(F.col(c)).alias(c) for c in ("entry_price", "exit_price", "qty", "gross_pnl", "commission", "slippage_cost", "pnl", "pnl_percent")], "bars_held")


def strategy_report(spark, folder: str) -> DataFrame:
    """Profit, rates and drawdown of each symbol."""
    made = strategy.report(_trades(spark, folder))
    return made.select(*[_six(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes])


def strategy_equity(spark, folder: str) -> DataFrame:
    """Equity after each trade."""
    made = strategy.equity_curve(_trades(spark, folder))
    return made.select("symbol", "trade", "exit_bar", *[_six(F.col(c)).alias(c) for c in ("pnl", "equity", "peak", "drawdown")])


def strategy_open(spark, folder: str) -> DataFrame:
    """Lots that are still open."""
    return strategy.open_lots(_signals(spark, folder))


def output_plots(spark, folder: str) -> DataFrame:
    """The newest value of each plotted series."""
    made = _crosses(spark, folder)
    long = output.plots(made, {"fast": F.col("f5"), "slow": F.col("f20"), "above": F.col("f5") > F.col("f20")})
    return output.last_values(long).select("symbol", "title", _six("value").alias("value"), "bars")


def output_json(spark, folder: str) -> DataFrame:
    """JSON documents of plots, levels and alerts for each symbol and month, read back: what each of them holds."""
    crosses = _crosses(spark, folder)
    made = bars_to_json(output.plots(crosses, {"close": F.col("close")}), {"middle": 50.0}, output.alerts(crosses, F.col("close") > F.col("f20"), "above"))
    kind = "version string, plots array<struct<title:string,data:array<struct<time:long,value:double>>>>, hlines array<struct<title:string,price:double>>, alerts array<struct<time:long,title:string>>"
    read = made.withColumn("d", F.from_json("json", kind)).withColumn("data", F.col("d.plots")[0]["data"])
    total = F.aggregate("data", F.lit(0.0), lambda s, p: s + p["value"])
    return read.select("symbol", F.unix_millis("span").alias("span_ms"), F.col("d.version").alias("version"), F.col("d.hlines")[0]["price"].alias("level"), F.size("data").cast("long").alias("points"), F.col("data")[0]["time"].alias("first_ms"), _six(total).alias("total"), F.coalesce(F.size("d.alerts"), F.lit(0)).cast("long").alias("alerts"))


def output_alerts(spark, folder: str) -> DataFrame:
    """The newest hundred alerts of each symbol."""
    return output.alerts(_crosses(spark, folder), F.col("close") > F.col("f20"), "above").select("symbol", F.unix_millis("time").alias("time_ms"), "title")


def stream_bars(spark, folder: str) -> DataFrame:
    """Closed bars of the event stream, by Structured Streaming."""
    return _plain(run_to_end(closed_bars(tick_stream(spark, folder), "event_type", "ts", "value", "event_id"), "bars"))


def stream_average(spark, folder: str) -> DataFrame:
    """The forming bar's exponential average after all ticks, by stateful streaming."""
    updates = run_to_end(forming_average(tick_stream(spark, folder), "event_type", "ts", "value", "event_id", 12), "average", "update")
    newest_update = updates.groupBy("symbol").agg(F.max_by(F.struct("time", "close", "value", "bars", "ticks"), "batch").alias("u"))
    return newest_update.select("symbol", F.unix_millis("u.time").alias("time_ms"), F.col("u.close").alias("close"), _six(F.col("u.value")).alias("value"), F.col("u.bars").alias("bars"), F.col("u.ticks").alias("ticks"))


_CROSS = f"""WITH {BARS}, m AS (
  SELECT *, k - 1 AS bar_index, avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f5, avg(close) OVER (PARTITION BY symbol ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS f20 FROM b
), x AS (
  SELECT *, coalesce(lag(f5) OVER w <= lag(f20) OVER w AND f5 > f20, false) AS up, coalesce(lag(f5) OVER w >= lag(f20) OVER w AND f5 < f20, false) AS down FROM m WINDOW w AS (PARTITION BY symbol ORDER BY time)
)"""
#: Lots of one entry id are intervals of its cumulative quantity, and so is what each close takes: a trade is where two overlap.
_LOTS = _CROSS.replace("WITH ", "WITH RECURSIVE ", 1) + """, sig AS (
  SELECT symbol, bar_index, close, 'L' AS lot, 0 AS r, 'L' AS ident, 'entry' AS kind, 2.0::DOUBLE AS qty FROM x WHERE up UNION ALL SELECT symbol, bar_index, close, 'S', 0, 'S', 'entry', 1.0::DOUBLE FROM x WHERE down
  UNION ALL SELECT symbol, bar_index, close, 'L', 1, 'L', 'close', 0.0::DOUBLE FROM x WHERE down UNION ALL SELECT symbol, bar_index, close, 'S', 1, 'X', 'exit', 0.0::DOUBLE FROM x WHERE up
  UNION ALL SELECT symbol, bar_index, close, 'L', 1, 'L', 'close', 1.0::DOUBLE FROM x WHERE bar_index % 50 = 49
), ev AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, lot ORDER BY bar_index, r, ident, kind, qty) AS n FROM sig
), walk AS (
  SELECT symbol, lot, n, CASE WHEN r = 0 THEN qty ELSE 0.0::DOUBLE END AS open, 0.0::DOUBLE AS used FROM ev WHERE n = 1
  UNION ALL
  SELECT e.symbol, e.lot, e.n, CASE WHEN e.r = 0 THEN w.open + e.qty WHEN e.qty = 0 THEN 0.0::DOUBLE ELSE greatest(w.open - e.qty, 0.0::DOUBLE) END, CASE WHEN e.r = 0 THEN 0.0::DOUBLE WHEN e.qty = 0 THEN w.open ELSE least(w.open, e.qty) END
  FROM walk w JOIN ev e ON e.symbol = w.symbol AND e.lot = w.lot AND e.n = w.n + 1
), cum AS (
  SELECT ev.*, w.used, sum(CASE WHEN r = 0 THEN qty ELSE 0 END) OVER o AS eb, sum(w.used) OVER o AS cb FROM ev JOIN walk w USING (symbol, lot, n) WINDOW o AS (PARTITION BY symbol, lot ORDER BY n)
), paired AS (
  SELECT e.symbol, e.ident AS entry_id, c.ident AS exit_id, CASE WHEN e.lot = 'L' THEN 'long' ELSE 'short' END AS direction, e.bar_index AS entry_bar, c.bar_index AS exit_bar,
         e.close + CASE WHEN e.lot = 'L' THEN 0.01 ELSE -0.01 END::DOUBLE AS entry_price, c.close - CASE WHEN e.lot = 'L' THEN 0.01 ELSE -0.01 END::DOUBLE AS exit_price, least(e.eb, c.cb) - greatest(e.eb - e.qty, c.cb - c.used) AS qty
  FROM cum e JOIN cum c ON e.symbol = c.symbol AND e.lot = c.lot AND e.r = 0 AND c.r = 1 AND least(e.eb, c.cb) > greatest(e.eb - e.qty, c.cb - c.used)
), t AS (
  SELECT *, gross_pnl - commission - slippage_cost AS pnl FROM (
    SELECT *, move * qty AS gross_pnl, (abs(entry_price) + abs(exit_price)) * qty * (0.1 / 100)::DOUBLE AS commission, 0.01::DOUBLE * qty * 2 AS slippage_cost, coalesce(move / nullif(entry_price, 0) * 100, 0) AS pnl_percent, greatest(exit_bar - entry_bar, 0) AS bars_held
    FROM (SELECT *, (exit_price - entry_price) * CASE WHEN direction = 'short' THEN -1.0 ELSE 1.0 END::DOUBLE AS move FROM paired))
), eq AS (
  SELECT *, greatest(100000.0::DOUBLE, max(equity) OVER (o ROWS UNBOUNDED PRECEDING)) AS peak FROM (SELECT *, row_number() OVER o AS trade, 100000.0::DOUBLE + sum(pnl) OVER (o ROWS UNBOUNDED PRECEDING) AS equity FROM t WINDOW o AS (PARTITION BY symbol ORDER BY exit_bar, entry_bar, entry_id, exit_id, qty))
  WINDOW o AS (PARTITION BY symbol ORDER BY exit_bar, entry_bar, entry_id, exit_id, qty)
)"""


def _rounded(value: str, name: str) -> str:
    return f"round(round({value}, 9), 6) + 0.0 AS {name}"


def _report_sql() -> str:
    doubles = {
        "net_profit": "sum(pnl)", "gross_profit": "coalesce(sum(pnl) FILTER (pnl > 0), 0)", "gross_loss": "coalesce(-sum(pnl) FILTER (pnl < 0), 0)", "commission": "sum(commission)", "slippage_cost": "sum(slippage_cost)",
        "largest_win": "max(pnl)", "largest_loss": "min(pnl)", "average_trade": "avg(pnl)", "average_win": "avg(pnl) FILTER (pnl > 0)", "average_loss": "avg(pnl) FILTER (pnl < 0)", "average_bars_held": "avg(bars_held)",
        "long_profit": "coalesce(sum(pnl) FILTER (direction = 'long'), 0)", "short_profit": "coalesce(sum(pnl) FILTER (direction = 'short'), 0)", "win_rate": "count(*) FILTER (pnl > 0) * 100.0 / count(*)",
        "profit_factor": "coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(coalesce(-sum(pnl) FILTER (pnl < 0), 0), 0)", "net_profit_percent": "sum(pnl) / 100000.0::DOUBLE * 100", "equity": "100000.0::DOUBLE + sum(pnl)", "max_drawdown": "max(peak - equity)",
    }
    counts = {"closed_trades": "count(*)", "winning_trades": "count(*) FILTER (pnl > 0)", "losing_trades": "count(*) FILTER (pnl < 0)"}
    for side in ("long", "short"):
        counts |= {f"{side}_trades": f"count(*) FILTER (direction = '{side}')", f"{side}_wins": f"count(*) FILTER (direction = '{side}' AND pnl > 0)"}
    return f"{_LOTS} SELECT symbol, {', '.join(f'{v} AS {c}' for c, v in counts.items())}, {', '.join(_rounded(v, c) for c, v in doubles.items())} FROM eq GROUP BY symbol"


_MONEY = ("entry_price", "exit_price", "qty", "gross_pnl", "commission", "slippage_cost", "pnl", "pnl_percent")
_AVERAGE = """, h AS (SELECT symbol, max(time) AS time, list(close ORDER BY time) AS cl, arg_max(close, time) AS close, arg_max(volume, time) AS ticks FROM bars GROUP BY symbol)"""
QUERIES: dict[str, Callable] = {f.__name__: f for f in (bars_events, bars_orders, bars_resampled, bars_newest, bars_csv, strategy_signals, strategy_trades, strategy_report, strategy_equity, strategy_open, output_plots, output_json, output_alerts, stream_bars, stream_average)}
ORACLE_SQL: dict[str, str] = {
    "bars_events": f"WITH {BARS} {_SELECT} bars",
    "bars_orders": f"WITH bars AS (SELECT o_orderpriority AS symbol, time_bucket(INTERVAL 1 DAY, o_orderdate) AS time, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL) {_SELECT} bars",
    "bars_resampled": f"WITH {BARS}, r AS (SELECT symbol, time_bucket(INTERVAL 4 HOUR, time, TIMESTAMP '1970-01-01') AS t, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume FROM bars GROUP BY ALL) SELECT symbol, epoch_ms(t) AS time_ms, open, high, low, close, volume FROM r",
    "bars_newest": f"WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM bars) {_SELECT} r WHERE n <= 100",
    "bars_csv": f"WITH {BARS} SELECT epoch_ms(time) AS time_ms, count(*) AS bars, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM bars GROUP BY time",
    "strategy_signals": f"""{_CROSS} SELECT symbol, bar_index, epoch_ms(time) AS time_ms, kind, ident, direction, qty, close AS price, comment FROM (
      SELECT *, 'entry' AS kind, 'L' AS ident, 'strategy.long' AS direction, 2.0::DOUBLE AS qty, NULL::VARCHAR AS comment FROM x WHERE up UNION ALL SELECT *, 'close', 'L', '', 0.0::DOUBLE, NULL FROM x WHERE down
      UNION ALL SELECT *, 'entry', 'S', 'strategy.short', 1.0::DOUBLE, NULL FROM x WHERE down UNION ALL SELECT *, 'exit', 'X', '', 0.0::DOUBLE, 'S' FROM x WHERE up UNION ALL SELECT *, 'close', 'L', '', 1.0::DOUBLE, NULL FROM x WHERE bar_index % 50 = 49)""",
    "strategy_trades": f"{_LOTS} SELECT symbol, entry_id, exit_id, direction, entry_bar, exit_bar, {', '.join(_rounded(c, c) for c in _MONEY)}, bars_held FROM t",
    "strategy_report": _report_sql(),
    "strategy_equity": f"{_LOTS} SELECT symbol, trade, exit_bar, {', '.join(_rounded(c, c) for c in ('pnl', 'equity', 'peak'))}, {_rounded('peak - equity', 'drawdown')} FROM eq",
    "strategy_open": f"{_LOTS}, gone AS (SELECT symbol, lot, max(cb) AS taken FROM cum GROUP BY ALL) SELECT symbol, ident, CASE WHEN lot = 'L' THEN 'long' ELSE 'short' END AS direction, bar_index, close AS price, least(qty, eb - taken) AS qty FROM cum JOIN gone USING (symbol, lot) WHERE r = 0 AND eb > taken",
    "output_plots": f"""{_CROSS} SELECT symbol, title, round(round(arg_max(value, time), 9), 6) + 0.0 AS value, count(*) AS bars FROM (
      SELECT symbol, time, 'fast' AS title, f5 AS value FROM x UNION ALL SELECT symbol, time, 'slow', f20 FROM x UNION ALL SELECT symbol, time, 'above', CASE WHEN f5 > f20 THEN 1.0 ELSE 0.0 END FROM x) GROUP BY ALL""",
    "output_alerts": f"{_CROSS} SELECT symbol, epoch_ms(time) AS time_ms, 'above' AS title FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM x WHERE close > f20) WHERE n <= 100",
    "output_json": f"""{_CROSS}, a AS (SELECT symbol, date_trunc('month', time) AS span, count(*) AS alerts FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS n FROM x WHERE close > f20) WHERE n <= 100 GROUP BY ALL),
      p AS (SELECT symbol, date_trunc('month', time) AS span, count(*) AS points, epoch_ms(min(time)) AS first_ms, sum(close) AS total FROM x GROUP BY ALL)
      SELECT symbol, epoch_ms(p.span) AS span_ms, '1.0.0' AS version, 50.0::DOUBLE AS level, points, first_ms, round(round(total, 9), 6) + 0.0 AS total, coalesce(alerts, 0) AS alerts FROM p LEFT JOIN a USING (symbol, span)""",
    "stream_bars": f"WITH {BARS} {_SELECT} bars WHERE time + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)",
    "stream_average": f"WITH {BARS}{_AVERAGE} SELECT symbol, epoch_ms(time) AS time_ms, close, round(round(list_reduce(list_concat([list_avg(cl[1:12])], cl[13:]), lambda p, q: (2.0 / 13) * q + (1 - (2.0 / 13)) * p), 9), 6) + 0.0 AS value, CAST(len(cl) AS BIGINT) AS bars, CAST(ticks AS BIGINT) AS ticks FROM h",
}

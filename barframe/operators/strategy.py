"""Strategies: signals, first-in-first-out matching of lots, and reports.

Signals are rows (symbol, bar_index, time, kind, ident, direction, qty, price, comment); ``kind``
is entry, close or exit.  Matching streams each symbol's signals through a queue of open lots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNAL = "symbol string, bar_index long, time timestamp, kind string, ident string, direction string, qty double, price double, comment string"
TRADE = "symbol string, entry_id string, exit_id string, direction string, entry_bar long, exit_bar long, entry_time timestamp, exit_time timestamp, entry_price double, exit_price double, qty double"
LOT = "symbol string, ident string, direction string, bar_index long, price double, qty double"


def entries(bars: DataFrame, condition: Column, ident: str, direction: str = "long", qty: float = 1.0, comment: str | None = None) -> DataFrame:
    """An entry on each bar where the condition holds, at the bar's close."""
    return _signals(bars, condition, "entry", ident, direction, qty, comment)


def closes(bars: DataFrame, condition: Column, ident: str, qty: float = 0.0) -> DataFrame:
    """Closes the lots of an entry id; a quantity of 0 is all."""
    return _signals(bars, condition, "close", ident, "", qty, None)


def exits(bars: DataFrame, condition: Column, ident: str, from_entry: str | None = None, qty: float = 0.0) -> DataFrame:
    """Exits from the lots of one entry id, or of all."""
    return _signals(bars, condition, "exit", ident, "", qty, from_entry)


def _signals(bars: DataFrame, condition: Column, kind: str, ident: str, direction: str, qty: float, comment: str | None) -> DataFrame:
    chosen = bars.filter(F.coalesce(condition, F.lit(False)))
    return chosen.select("symbol", "bar_index", "time", F.lit(kind).alias("kind"), F.lit(ident).alias("ident"), F.lit(direction).alias("direction"), F.lit(float(qty)).alias("qty"), F.col("close").alias("price"), F.lit(comment).cast("string").alias("comment"))


def _slipped(price: float, direction: str, entry: bool, slippage: float) -> float:
    worse = 1 if (direction != "short") == entry else -1
    return price + worse * max(slippage, 0.0)


def _match(slippage: float, trades: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in (TRADE if trades else LOT).split(", ")]
        symbol, lots = None, []
        for batch in batches:
            schema_time = batch.schema.field("time").type
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("symbol", "bar_index", "kind", "ident", "direction", "qty", "price", "comment")]
            times = batch.column("time").to_pylist()
            for (own, bar, kind, ident, direction, qty, price, comment), time in zip(zip(*columns), times):
                if own != symbol:
                    if not trades:
                        out += _open(symbol, lots)
                    symbol, lots = own, []
                price = 0.0 if price is None else price
                if kind == "entry":
                    side = "short" if (direction or "").endswith("short") else "long"
                    lots.append([ident, side, bar, time, _slipped(price, side, True, slippage), abs(qty or 0.0)])
                    continue
                target = ident if kind == "close" else comment or None
                fits = [lot for lot in lots if target is None or lot[0] == target]
                left = qty if qty and qty > 0 else sum(lot[5] for lot in fits)
                if left <= 0:
                    continue
                side = fits[0][1] if target is not None and fits else "long"
                out_price = _slipped(price, side, False, slippage)
                for lot in fits:
                    if left <= 0:
                        break
                    closed = min(lot[5], left)
                    if trades:
                        out.append((own, lot[0], ident, lot[1], lot[2], bar, lot[3], time, lot[4], out_price, closed))
                    lot[5] -= closed
                    left -= closed
                lots = [lot for lot in lots if lot[5] > 0]
            yield _batch(out, names, schema_time)
        if not trades:
            yield _batch(_open(symbol, lots), names, None)

    return run


def _open(symbol: str | None, lots: list[list]) -> list[tuple]:
    return [(symbol, lot[0], lot[1], lot[2], lot[4], lot[5]) for lot in lots]


def _batch(rows: list[tuple], names: list[str], time: pa.DataType | None) -> pa.RecordBatch:
    kinds = {"entry_bar": pa.int64(), "exit_bar": pa.int64(), "bar_index": pa.int64(), "entry_time": time, "exit_time": time, "entry_price": pa.float64(), "exit_price": pa.float64(), "price": pa.float64(), "qty": pa.float64()}
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for c, n in zip(columns, names)], names=names)


def _ordered(signals: DataFrame) -> DataFrame:
    ranked = signals.withColumn("__r", F.when(F.col("kind") == "entry", 0).otherwise(1))
    return ranked.repartition("symbol").sortWithinPartitions("symbol", "bar_index", "__r", "ident", "kind", "qty", "comment").drop("__r")


def trades(signals: DataFrame, commission: float = 0.0, slippage: float = 0.0) -> DataFrame:
    """Closed trades with profit: on a bar entries come first, then by id, kind and quantity; lots close in the order of entry."""
    matched = _ordered(signals).mapInArrow(_match(slippage, True), TRADE)
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    move = (F.col("exit_price") - F.col("entry_price")) * sign
    return (
        matched.withColumn("gross_pnl", move * F.col("qty"))
        .withColumn("commission", (F.abs("entry_price") + F.abs("exit_price")) * F.col("qty") * (commission / 100))
        .withColumn("slippage_cost", abs(slippage) * F.col("qty") * 2)
        .withColumn("pnl", F.col("gross_pnl") - F.col("commission") - F.col("slippage_cost"))
        .withColumn("pnl_percent", F.coalesce(F.try_divide(move, F.col("entry_price")) * 100, F.lit(0.0)))
        .withColumn("bars_held", F.greatest(F.col("exit_bar") - F.col("entry_bar"), F.lit(0)))
    )


def open_lots(signals: DataFrame, slippage: float = 0.0) -> DataFrame:
    """What is still open after all signals."""
    return _ordered(signals).mapInArrow(_match(slippage, False), LOT)


def equity_curve(closed: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """Equity after each closed trade, its peak so far and the drawdown from it."""
    order = Window.partitionBy("symbol").orderBy("exit_bar", "entry_bar", "entry_id", "exit_id", "qty")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    equity = closed.withColumn("trade", F.row_number().over(order).cast("long")).withColumn("equity", capital + F.sum("pnl").over(run))
    peaked = equity.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(run)))
    return peaked.select("symbol", "trade", "exit_bar", "exit_time", "pnl", "equity", "peak", (F.col("peak") - F.col("equity")).alias("drawdown"))


def report(closed: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """A row for each symbol: profits, losses, rates, averages, extremes, drawdown, by direction too."""
    won, lost = F.col("pnl") > 0, F.col("pnl") < 0
    side = lambda d: [F.count(F.when(F.col("direction") == d, 1)).alias(f"{d}_trades"), F.count(F.when((F.col("direction") == d) & won, 1)).alias(f"{d}_wins"), F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("pnl"))), F.lit(0.0)).alias(f"{d}_profit")]
    summed = closed.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("closed_trades"), F.count(F.when(won, 1)).alias("winning_trades"), F.count(F.when(lost, 1)).alias("losing_trades"),
        F.sum("pnl").alias("net_profit"), F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("gross_profit"), F.coalesce(-F.sum(F.when(lost, F.col("pnl"))), F.lit(0.0)).alias("gross_loss"),
        F.sum("commission").alias("commission"), F.sum("slippage_cost").alias("slippage_cost"), F.max("pnl").alias("largest_win"), F.min("pnl").alias("largest_loss"),
        F.avg("pnl").alias("average_trade"), F.avg(F.when(won, F.col("pnl"))).alias("average_win"), F.avg(F.when(lost, F.col("pnl"))).alias("average_loss"), F.avg("bars_held").alias("average_bars_held"), *side("long"), *side("short"),
    )
    down = equity_curve(closed, capital).groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"))
    rates = summed.withColumns({"win_rate": F.col("winning_trades") * 100.0 / F.col("closed_trades"), "profit_factor": F.try_divide(F.col("gross_profit"), F.col("gross_loss")), "net_profit_percent": F.col("net_profit") / capital * 100, "equity": capital + F.col("net_profit")})
    return rates.join(down, "symbol")

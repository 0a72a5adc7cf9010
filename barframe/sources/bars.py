"""Bar tables: symbol, time, open, high, low, close, volume.

Building bars combines ticks before the shuffle, so a symbol with a third of all ticks costs no
more than its number of bars.  That number is bounded by the time span over the timeframe, which
is what lets the windows over a symbol's bars stay in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "time", "open", "high", "low", "close", "volume")
#: Seconds of each timeframe; any other name is an hour.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}


def timeframe_seconds(name: str) -> int:
    """Seconds of a timeframe; an hour for an unknown one."""
    return TIMEFRAMES.get(name, 3600)


def bucket(time: Column, timeframe: str) -> Column:
    """The start of the timeframe's window (aligned to the epoch) that ``time`` falls into."""
    step = timeframe_seconds(timeframe)
    return F.timestamp_seconds(F.floor(F.unix_micros(time) / (step * 1_000_000)) * step)


def instants(table: DataFrame, *names: str) -> DataFrame:
    """``table`` with times without a zone read as UTC, whatever the session's zone."""
    kinds = dict(table.dtypes)
    return table.withColumns({n: F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(n))) for n in names if kinds[n] == "timestamp_ntz"})


def bars_from_ticks(ticks: DataFrame, symbol: str, time: str, price: str, timeframe: str = "1h", volume: Column | None = None, tie: str | None = None) -> DataFrame:
    """Bars of ``timeframe`` from single prices; ``tie`` orders ticks of equal time.

    Volume is the number of ticks unless a column is given.
    """
    ticks = instants(ticks, time)
    order = F.struct(F.col(time), F.col(tie)) if tie else F.col(time)
    value = F.col(price).cast("double")
    known = ticks.filter(F.col(time).isNotNull() & value.isNotNull())
    return known.groupBy(F.col(symbol).alias("symbol"), bucket(F.col(time), timeframe).alias("time")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.coalesce(F.sum(volume), F.lit(0)).cast("double").alias("volume") if volume is not None else F.count(F.lit(1)).cast("double").alias("volume")
    )


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe from bars."""
    return bars.groupBy("symbol", bucket(F.col("time"), timeframe).alias("time")).agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum("volume").alias("volume"))


def bar_time(text: Column) -> Column:
    """A time from text: whole numbers (seconds below 1e12, else milliseconds), ISO 8601, or a date; else null."""
    number = text.try_cast("bigint")
    millis = F.when(number < 10**12, number * 1000).otherwise(number)
    return F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp(text))


def bars_from_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Bars from CSV files with a header; lines that begin with ``#`` are skipped.

    Columns count by position: time, open, high, low, close, volume; a file of two to five columns is
    time and close (open, high and low the same, volume 0).  The symbol is the file's name up to the
    first ``_`` or ``.`` unless given.
    """
    raw = spark.read.option("header", True).option("comment", "#").option("enforceSchema", False).csv(path)
    names = raw.columns
    if len(names) < 2:
        raise ValueError("a bar file needs a time and a close column")
    pick = dict(zip(("open", "high", "low", "close", "volume"), names[1:6])) if len(names) >= 6 else dict.fromkeys(("open", "high", "low", "close"), names[1])
    number = lambda c: F.col(f"`{c}`").try_cast("double") if c else F.lit(0.0)
    own = F.lit(symbol) if symbol else F.regexp_extract(F.col("_metadata.file_name"), r"^([^_.]+)", 1)
    return raw.select(own.alias("symbol"), bar_time(F.trim(F.col(f"`{names[0]}`"))).alias("time"), *[number(pick.get(c)).alias(c) for c in BAR_COLUMNS[2:]])


def synthetic_bars(spark: SparkSession, symbols: int, bars: int, timeframe: str = "1h", seed: int = 1) -> DataFrame:
    """Pseudo-random bars, the same for the same arguments."""
    step = timeframe_seconds(timeframe)
    unit = lambda *c: F.pmod(F.xxhash64(F.lit(seed), "symbol", "k", *map(F.lit, c)), F.lit(10_000)) / 10_000.0
    rows = spark.range(symbols * bars).select(F.concat(F.lit("S"), (F.col("id") / bars).cast("long").cast("string")).alias("symbol"), (F.col("id") % bars).alias("k"))
    middle = 100 + 10 * F.sin(F.col("k") / 17.0) + unit(0)
    rows = rows.select("symbol", F.timestamp_seconds(F.lit(1_700_000_000 // step * step) + F.col("k") * step).alias("time"), middle.alias("m"), (unit(1) - 0.5).alias("a"), (unit(2) - 0.5).alias("b"), unit(3).alias("u"), (unit(4) * 1000).alias("volume"))
    opened, closed = F.col("m") + F.col("a"), F.col("m") + F.col("b")
    return rows.select("symbol", "time", opened.alias("open"), (F.greatest(opened, closed) + F.col("u")).alias("high"), (F.least(opened, closed) - F.col("u")).alias("low"), closed.alias("close"), "volume")


def event_bars(spark: SparkSession, folder: str, timeframe: str = "1h") -> DataFrame:
    """Bars of the event stream: a symbol for each event type, its value as price."""
    return bars_from_ticks(spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "event_type", "value"), "event_type", "ts", "value", timeframe, tie="event_id")


def order_bars(spark: SparkSession, folder: str, timeframe: str = "1d") -> DataFrame:
    """Bars of orders: a symbol for each priority, the total price as price."""
    return bars_from_ticks(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_orderdate", "o_totalprice", timeframe, tie="o_orderkey")


def newest(bars: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` bars of each symbol."""
    from pyspark.sql import Window

    return bars.withColumn("__n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("time")))).filter(F.col("__n") <= limit).drop("__n")


def bars_to_json(plots: DataFrame, hlines: dict[str, float] | None = None, alerts: DataFrame | None = None, span: str = "month") -> DataFrame:
    """JSON documents from long plots (symbol, time, title, value): one for each symbol and span of time.

    A span bounds a document, whatever the length of the history.  ``hlines`` are titled levels;
    ``alerts`` has symbol, time and title.
    """
    point = F.struct(F.unix_millis("time").alias("time"), "value")
    own = ["symbol", F.date_trunc(span, "time").alias("span")]
    series = plots.groupBy(*own, "title").agg(F.sort_array(F.collect_list(point)).alias("data"))
    documents = series.groupBy("symbol", "span").agg(F.sort_array(F.collect_list(F.struct("title", "data"))).alias("plots"))
    parts = [F.lit("1.0.0").alias("version"), "plots"]
    if hlines:
        parts.append(F.array(*[F.struct(F.lit(title).alias("title"), F.lit(float(price)).alias("price")) for title, price in sorted(hlines.items())]).alias("hlines"))
    if alerts is not None:
        fired = alerts.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(F.unix_millis("time").alias("time"), "title"))).alias("alerts"))
        documents = documents.join(fired, ["symbol", "span"], "left")
        parts.append("alerts")
    return documents.select("symbol", "span", F.to_json(F.struct(*parts)).alias("json"))

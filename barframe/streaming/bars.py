"""Structured Streaming over ticks.

A table's files are read in one batch, as their times may overlap; what files come later is late.
``closed_bars`` emits a bar once the watermark has passed its end.  ``forming_average`` keeps, for
each symbol, what is committed (bars that are closed) apart from the working value of the forming
bar: further ticks of the same bar replace the working value where they are newer, ticks of a new
bar commit it, ticks of an older bar are dropped.  Spark combines the ticks of a batch into bars
first, so the stateful step sees no more rows than bars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barframe.sources.bars import bucket, instants, timeframe_seconds
from barframe.sources.folders import shared_path


def tick_stream(spark: SparkSession, folder: str, table: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a Parquet table's files: all that are there in one batch, unless a number is given."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stream = reader.parquet(f"{folder}/{table}.parquet*")
    return instants(stream, *[n for n, kind in stream.dtypes if kind == "timestamp_ntz"])


def closed_bars(ticks: DataFrame, symbol: str, time: str, price: str, tie: str, timeframe: str = "1h", late: str = "0 seconds") -> DataFrame:
    """Bars of a stream (or a table) of ticks; ticks later than ``late`` are dropped."""
    order, value = F.struct(F.col(time), F.col(tie)), F.col(price).cast("double")
    dealt = ticks.filter(value.isNotNull()).withWatermark(time, late)
    grouped = dealt.groupBy(F.col(symbol).alias("symbol"), F.window(time, f"{timeframe_seconds(timeframe)} seconds").alias("w"))
    made = grouped.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return made.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def _partial_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The newest price and the number of ticks for each symbol and bar of a task."""
    held: list[pa.Table] = []

    def combined() -> pa.Table:
        rows = pa.concat_tables(held).sort_by([("at", "ascending"), ("tie", "ascending")])
        made = rows.group_by(["symbol", "bar"], use_threads=False).aggregate([("at", "last"), ("tie", "last"), ("price", "last"), ("ticks", "sum")])
        return pa.table({"symbol": made["symbol"], "bar": made["bar"], "at": made["at_last"], "tie": made["tie_last"], "price": made["price_last"], "ticks": made["ticks_sum"]})

    size = limit = 0
    for batch in batches:
        held.append(pa.table({c: batch.column(c) for c in batch.schema.names}))  # without what Spark says of nulls
        size += batch.num_rows
        if size > limit:
            held[:] = [combined()]
            size = held[0].num_rows
            limit = 2 * size + 100_000
    if held:
        yield from combined().combine_chunks().to_batches()


def forming_average(ticks: DataFrame, symbol: str, time: str, price: str, tie: str, n: int, timeframe: str = "1h") -> DataFrame:
    """The exponential average of closes with the forming bar's last price, after each batch of ticks.

    Columns: symbol, time (of the forming bar), close, value, bars, ticks (of the forming bar).
    """
    alpha = 2 / (n + 1)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, count, total, committed, close, seen, newest, newest_tie = state.get if state.exists else (None, 0, 0.0, None, None, 0, None, None)

        def value_with(x: float) -> float | None:
            if count + 1 <= n:
                return (total + x) / n if count + 1 == n else None
            return alpha * x + (1 - alpha) * committed

        # Spark may split a key's rows; they are put in order here
        rows = pd.concat(list(batches)).sort_values(["bar", "at", "tie"])
        for start, at, tie_of, x, n_ticks in zip(*(rows[c].tolist() for c in ("bar", "at", "tie", "price", "ticks"))):
            if bar is not None and start < bar:
                continue
            if bar is not None and start > bar:  # commit
                committed, total, count = value_with(close), total + close, count + 1
                seen, newest = 0, None
            if newest is None or (at, tie_of) >= (newest, newest_tie):
                close, newest, newest_tie = x, at, tie_of
            bar, seen = start, seen + n_ticks
        if bar is None:
            return
        state.update((bar, count, total, committed, close, seen, newest, newest_tie))
        yield pd.DataFrame({"symbol": [key[0]], "bar": [bar], "close": [close], "value": [value_with(close)], "bars": [count + 1], "ticks": [seen]})

    known = ticks.filter(F.col(price).isNotNull() & F.col(time).isNotNull())
    rows = known.select(F.col(symbol).alias("symbol"), F.unix_micros(bucket(F.col(time), timeframe)).alias("bar"), F.unix_micros(F.col(time)).alias("at"), F.coalesce(F.col(tie).cast("long"), F.lit(-(1 << 63))).alias("tie"), F.col(price).cast("double").alias("price"), F.lit(1).cast("long").alias("ticks"))
    partial = rows.mapInArrow(_partial_bars, rows.schema)
    out = partial.groupBy("symbol").applyInPandasWithState(run, "symbol string, bar long, close double, value double, bars long, ticks long", "bar long, count long, total double, committed double, close double, seen long, newest long, newest_tie long", "update", GroupStateTimeout.NoTimeout)
    return out.select("symbol", F.timestamp_micros("bar").alias("time"), "close", "value", "bars", "ticks")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    In update mode each batch is a folder of its own; ``batch`` numbers them.
    """
    spark = stream.sparkSession
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(out)

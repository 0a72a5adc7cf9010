"""Technical indicators: each takes bars and returns them with one or more columns more.

``x``, ``a`` and ``b`` name columns, ``n`` is a number of bars (at least 1), ``out`` names the
result.  Bars need ``symbol`` and ``time``; functions of ranges also ``high``, ``low``, ``close``.
Every table of no rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barframe.operators.folds import Fold, apply_folds, dmi_fold, ema_fold, macd_fold, rma_fold, rsi_fold, supertrend_fold, tsi_fold
from barframe.operators.frames import last, ordered, rolling, running, staged


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def sma(bars: DataFrame, x: str, n: int, out: str = "sma", dense: bool = True) -> DataFrame:
    """Mean of the last n values."""
    return rolling(bars, x, n, out, lambda c, w: F.avg(c).over(w), dense)


def ema(bars: DataFrame, x: str, n: int, out: str = "ema") -> DataFrame:
    """Exponential average, started by a mean of n values."""
    return apply_folds(bars, [ema_fold(x, n, out)])


def rma(bars: DataFrame, x: str, n: int, out: str = "rma") -> DataFrame:
    """Wilder's average."""
    return apply_folds(bars, [rma_fold(x, n, out)])


def wma(bars: DataFrame, x: str, n: int, out: str = "wma", dense: bool = True) -> DataFrame:
    """Mean weighted 1 to n, the newest most."""
    weighted = lambda c, w: F.aggregate(F.transform(F.collect_list(c).over(w), lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v) / (n * (n + 1) / 2)
    return rolling(bars, x, n, out, weighted, dense)


def vwma(bars: DataFrame, x: str, n: int, out: str = "vwma", volume: str = "volume") -> DataFrame:
    """Mean weighted by volume; null where the volume is 0."""
    w = last(n)
    return bars.withColumn(out, F.when(F.count(x).over(w) == n, _divide(F.sum(F.col(x) * F.col(volume)).over(w), F.sum(volume).over(w))))


def swma(bars: DataFrame, x: str, out: str = "swma") -> DataFrame:
    """Mean of four bars weighted 1, 2, 2, 1."""
    lag = [F.lag(x, k).over(ordered()) for k in range(1, 4)]
    return bars.withColumn(out, (lag[2] + 2 * lag[1] + 2 * lag[0] + F.col(x)) / 6)


def roc(bars: DataFrame, x: str, n: int = 1, out: str = "roc") -> DataFrame:
    """Change over n bars in per cent; null from 0."""
    before = F.lag(x, n).over(ordered())
    return bars.withColumn(out, _divide(F.col(x) - before, before) * 100)


def change(bars: DataFrame, x: str, n: int = 1, out: str = "change") -> DataFrame:
    """Difference to n bars ago; whether it differs, of a boolean column."""
    before = F.lag(x, n).over(ordered())
    return bars.withColumn(out, F.col(x) != before if bars.schema[x].dataType.simpleString() == "boolean" else F.col(x) - before)


def mom(bars: DataFrame, x: str, n: int, out: str = "mom") -> DataFrame:
    """Difference to n bars ago."""
    return bars.withColumn(out, F.col(x) - F.lag(x, n).over(ordered()))


def cum(bars: DataFrame, x: str, out: str = "cum") -> DataFrame:
    """Running sum; null until the first value."""
    return bars.withColumn(out, F.sum(x).over(running()))


def obv(bars: DataFrame, x: str = "close", volume: str = "volume", out: str = "obv") -> DataFrame:
    """Running volume, added on rises and taken off on falls."""
    return staged(bars, {"__d": F.coalesce(F.signum(F.col(x) - F.lag(x).over(ordered())) * F.col(volume), F.lit(0.0))}, {out: F.sum("__d").over(running())})


def pvt(bars: DataFrame, x: str = "close", volume: str = "volume", out: str = "pvt") -> DataFrame:
    """Running volume times relative change."""
    before = F.lag(x).over(ordered())
    return staged(bars, {"__d": F.coalesce(_divide(F.col(x) - before, before) * F.col(volume), F.lit(0.0))}, {out: F.sum("__d").over(running())})


def rsi(bars: DataFrame, x: str, n: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength index."""
    return apply_folds(bars, [rsi_fold(x, n, out)])


def macd(bars: DataFrame, x: str, fast: int = 12, slow: int = 26, signal: int = 9, out: str = "macd") -> DataFrame:
    """Columns ``out_line``, ``out_signal`` and ``out_hist``."""
    return apply_folds(bars, [macd_fold(x, fast, slow, signal, out)])


def tsi(bars: DataFrame, x: str, short: int = 13, long: int = 25, out: str = "tsi") -> DataFrame:
    """True strength index."""
    return apply_folds(bars, [tsi_fold(x, short, long, out)])


def _spread(values: Column, mean: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + F.abs(v - mean)) / F.size(values)


def dev(bars: DataFrame, x: str, n: int, out: str = "dev", dense: bool = True) -> DataFrame:
    """Mean absolute deviation from the mean."""
    return rolling(bars, x, n, out, lambda c, w: _spread(F.collect_list(c).over(w), F.avg(c).over(w)), dense)


def cci(bars: DataFrame, x: str, n: int = 20, out: str = "cci") -> DataFrame:
    """Distance to the mean over 0.015 of the mean deviation."""
    w = last(n)
    made = bars.withColumns({"__m": F.avg(x).over(w), "__l": F.collect_list(x).over(w), "__n": F.count(x).over(w)})
    return made.withColumn(out, F.when(F.col("__n") == n, _divide(F.col(x) - F.col("__m"), 0.015 * _spread(F.col("__l"), F.col("__m"))))).drop("__m", "__l", "__n")


def mfi(bars: DataFrame, x: str, n: int = 14, out: str = "mfi", volume: str = "volume") -> DataFrame:
    """Money flow: 100 where none flows out."""
    before, flow = F.lag(x).over(ordered()), F.col(x) * F.col(volume)
    w = last(n)
    temporary = {"__u": F.when(F.col(x) > before, flow).otherwise(0.0), "__d": F.when(F.col(x) < before, flow).otherwise(0.0), "__k": F.row_number().over(ordered())}
    up, down = F.sum("__u").over(w), F.sum("__d").over(w)
    return staged(bars, temporary, {out: F.when(F.col("__k") > n, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + _divide(up, down))))})


def true_range() -> Column:
    """The greatest of high - low and both distances to the close before."""
    before = F.lag("close").over(ordered())
    return F.when(F.col("high").isNotNull() & F.col("low").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def tr(bars: DataFrame, out: str = "tr") -> DataFrame:
    """True range."""
    return bars.withColumn(out, true_range())


def atr(bars: DataFrame, n: int = 14, out: str = "atr") -> DataFrame:
    """Wilder's average of the true range."""
    return apply_folds(bars.withColumn("__tr", true_range()), [rma_fold("__tr", n, out)]).drop("__tr")


def bb(bars: DataFrame, x: str, n: int = 20, k: float = 2.0, out: str = "bb") -> DataFrame:
    """Columns ``out_basis``, ``out_upper`` and ``out_lower``: mean and k population deviations."""
    w = last(n)
    full, mean, spread = F.count(x).over(w) == n, F.avg(x).over(w), F.stddev_pop(x).over(w)
    return bars.withColumns({f"{out}_basis": F.when(full, mean), f"{out}_upper": F.when(full, mean + k * spread), f"{out}_lower": F.when(full, mean - k * spread)})


def bbw(bars: DataFrame, x: str, n: int, k: float = 2.0, out: str = "bbw") -> DataFrame:
    """Width of the bands over their basis."""
    w = last(n)
    return bars.withColumn(out, F.when(F.count(x).over(w) == n, _divide(2 * k * F.stddev_pop(x).over(w), F.avg(x).over(w))))


def dmi(bars: DataFrame, di: int = 14, adx: int = 14, out: str = "dmi") -> DataFrame:
    """Columns ``out_plus``, ``out_minus`` and ``out_adx``."""
    return apply_folds(bars, [dmi_fold(di, adx, out)])


def supertrend(bars: DataFrame, factor: float = 3.0, n: int = 10, out: str = "supertrend") -> DataFrame:
    """The trend line in ``out`` and ``out_direction`` (1 down, -1 up)."""
    return apply_folds(bars, [supertrend_fold(factor, n, out)])


def highest(bars: DataFrame, x: str, n: int, out: str = "highest", dense: bool = True) -> DataFrame:
    """Greatest of the last n values, or of as many as there are."""
    return rolling(bars, x, n, out, lambda c, w: F.max(c).over(w), dense, full=False)


def lowest(bars: DataFrame, x: str, n: int, out: str = "lowest", dense: bool = True) -> DataFrame:
    """Least of the last n values, or of as many as there are."""
    return rolling(bars, x, n, out, lambda c, w: F.min(c).over(w), dense, full=False)


def value_range(bars: DataFrame, x: str, n: int, out: str = "range", dense: bool = True) -> DataFrame:
    """Highest less lowest."""
    return rolling(bars, x, n, out, lambda c, w: F.max(c).over(w) - F.min(c).over(w), dense, full=False)


def stoch(bars: DataFrame, x: str, high: str, low: str, n: int, out: str = "stoch") -> DataFrame:
    """Where x stands between the lowest low and the highest high, in per cent."""
    w = last(n)
    top, bottom = F.max(high).over(w), F.min(low).over(w)
    return bars.withColumn(out, F.when(F.count(x).over(w) == n, _divide(F.col(x) - bottom, top - bottom) * 100))


def wpr(bars: DataFrame, n: int, out: str = "wpr") -> DataFrame:
    """Where the close stands below the highest high, from 0 to -100."""
    w = last(n)
    top, bottom = F.max("high").over(w), F.min("low").over(w)
    return bars.withColumn(out, _divide(top - F.col("close"), top - bottom) * -100)


def _bars_back(bars: DataFrame, x: str, n: int, out: str, sign: int) -> DataFrame:
    key = F.when(F.col(x).isNotNull(), F.struct((F.col(x) * sign).alias("v"), F.col("__k").alias("k")))
    return bars.withColumn("__k", F.row_number().over(ordered())).withColumn(out, (F.col("__k") - F.max(key).over(last(n))["k"]).cast("long")).drop("__k")


def highestbars(bars: DataFrame, x: str, n: int, out: str = "highestbars") -> DataFrame:
    """Bars since the greatest of the last n bars, the latest of ties."""
    return _bars_back(bars, x, n, out, 1)


def lowestbars(bars: DataFrame, x: str, n: int, out: str = "lowestbars") -> DataFrame:
    """Bars since the least of the last n bars, the latest of ties."""
    return _bars_back(bars, x, n, out, -1)


def _over(a: str, b: str) -> Column:
    return F.coalesce((F.lag(a).over(ordered()) <= F.lag(b).over(ordered())) & (F.col(a) > F.col(b)), F.lit(False))


def crossover(bars: DataFrame, a: str, b: str, out: str = "crossover") -> DataFrame:
    """Whether a rose above b on this bar; never null."""
    return bars.withColumn(out, _over(a, b))


def crossunder(bars: DataFrame, a: str, b: str, out: str = "crossunder") -> DataFrame:
    """Whether a fell below b on this bar; never null."""
    return bars.withColumn(out, _over(b, a))


def cross(bars: DataFrame, a: str, b: str, out: str = "cross") -> DataFrame:
    """Either."""
    return bars.withColumn(out, _over(a, b) | _over(b, a))


def barssince(bars: DataFrame, condition: str, out: str = "barssince") -> DataFrame:
    """Bars since the condition was true; null if it never was."""
    return staged(bars, {"__k": F.row_number().over(ordered())}, {out: (F.col("__k") - F.last(F.when(F.col(condition), F.col("__k")), ignorenulls=True).over(running())).cast("long")})


def valuewhen(bars: DataFrame, condition: str, x: str, k: int = 0, out: str = "valuewhen") -> DataFrame:
    """x at the k-th latest bar on which the condition was true (0: the latest).

    True bars are numbered and looked up by number, so no history is gathered.
    """
    if k == 0:
        return bars.withColumn(out, F.last(F.when(F.col(condition), F.struct(F.col(x).alias("v"))), ignorenulls=True).over(running())["v"])
    numbered = bars.withColumn("__n", F.count(F.when(F.col(condition), 1)).over(running()))
    hits = numbered.filter(F.col(condition)).select("symbol", (F.col("__n") + k).alias("__n"), F.col(x).alias(out))
    return numbered.join(hits, ["symbol", "__n"], "left").drop("__n")


def stdev(bars: DataFrame, x: str, n: int, out: str = "stdev", dense: bool = True) -> DataFrame:
    """Population deviation."""
    return rolling(bars, x, n, out, lambda c, w: F.stddev_pop(c).over(w), dense)


def variance(bars: DataFrame, x: str, n: int, out: str = "variance", dense: bool = True) -> DataFrame:
    """Population variance."""
    return rolling(bars, x, n, out, lambda c, w: F.var_pop(c).over(w), dense)


def correlation(bars: DataFrame, a: str, b: str, n: int, out: str = "correlation") -> DataFrame:
    """Pearson's; null where either doesn't vary."""
    w = last(n)
    varies = (F.count(F.col(a) + F.col(b)).over(w) == n) & (F.min(a).over(w) < F.max(a).over(w)) & (F.min(b).over(w) < F.max(b).over(w))
    return bars.withColumn(out, F.when(varies, _divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))))


def linreg(bars: DataFrame, x: str, n: int, offset: int = 0, out: str = "linreg") -> DataFrame:
    """The line fitted to the last n bars, at the current one plus ``offset``."""
    if n < 2:
        return bars.withColumn(out, F.lit(None).cast("double"))
    w = last(n)
    made = bars.withColumn("__k", F.row_number().over(ordered()).cast("double"))
    line = F.regr_intercept(x, "__k").over(w) + F.regr_slope(x, "__k").over(w) * (F.col("__k") + offset)
    return made.withColumn(out, F.when(F.count(x).over(w) == n, line)).drop("__k")


def median(bars: DataFrame, x: str, n: int, out: str = "median", dense: bool = True) -> DataFrame:
    """Middle value, or mean of the two."""
    return rolling(bars, x, n, out, lambda c, w: F.percentile(c, 0.5).over(w), dense)


def percentrank(bars: DataFrame, x: str, n: int, out: str = "percentrank") -> DataFrame:
    """Share of the last n values up to the current one, itself included, in per cent."""
    w = last(n)
    made = bars.withColumns({"__l": F.collect_list(x).over(w), "__n": F.count(x).over(w)})
    return made.withColumn(out, F.when(F.col("__n") == n, F.size(F.filter("__l", lambda v: v <= F.col(x))) * 100.0 / n)).drop("__l", "__n")


def percentile_linear_interpolation(bars: DataFrame, x: str, n: int, p: float, out: str = "percentile", dense: bool = True) -> DataFrame:
    """Percentile between neighbours."""
    return rolling(bars, x, n, out, lambda c, w: F.percentile(c, p / 100).over(w), dense)


def percentile_nearest_rank(bars: DataFrame, x: str, n: int, p: float, out: str = "percentile", dense: bool = True) -> DataFrame:
    """Percentile that is one of the values."""
    import math

    at = min(max(math.ceil(p / 100 * n) - 1, 0), n - 1)
    return rolling(bars, x, n, out, lambda c, w: F.get(F.sort_array(F.collect_list(c).over(w)), F.lit(at)), dense)


def _steps(bars: DataFrame, x: str, n: int, out: str, rises: bool) -> DataFrame:
    before = F.lag(x).over(ordered())
    step = (F.col(x) > before) if rises else (F.col(x) < before)
    return staged(bars, {"__s": F.when(step, 1).otherwise(0)}, {out: F.sum("__s").over(last(n)) == n})


def rising(bars: DataFrame, x: str, n: int, out: str = "rising") -> DataFrame:
    """Whether each of the last n steps went up; never null."""
    return _steps(bars, x, n, out, True)


def falling(bars: DataFrame, x: str, n: int, out: str = "falling") -> DataFrame:
    """Whether each of the last n steps went down; never null."""
    return _steps(bars, x, n, out, False)


def rolling_sum(bars: DataFrame, x: str, n: int, out: str = "sum") -> DataFrame:
    """Sum of what is there in the last n bars; null before n bars."""
    w = last(n)
    return bars.withColumn(out, F.when(F.count(F.lit(1)).over(w) == n, F.sum(x).over(w)))


def rolling_avg(bars: DataFrame, x: str, n: int, out: str = "avg") -> DataFrame:
    """Mean of what is there in the last n bars; null before n bars."""
    w = last(n)
    return bars.withColumn(out, F.when(F.count(F.lit(1)).over(w) == n, F.avg(x).over(w)))


def recursive(bars: DataFrame, folds: list[Fold]) -> DataFrame:
    """Several recursive indicators in one pass."""
    return apply_folds(bars, folds)


"""One query for each indicator over hourly bars of the event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions import ta
from barframe.operators.frames import bar_index, compacting, last, ordered
from barframe.sources.bars import event_bars

BARS = """bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS time, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER w AS k, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl, (high + low + close) / 3 AS hlc3, lag((high + low + close) / 3) OVER w AS phlc3,
         CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY time)
)"""
_W = "PARTITION BY symbol ORDER BY time"


def _frame(n: int) -> str:
    return f"({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _all() -> str:
    return f"({_W} ROWS UNBOUNDED PRECEDING)"


def _full(n: int, value: str, column: str = "close") -> str:
    return f"CASE WHEN count({column}) OVER {_frame(n)} = {n} THEN {value} END"


def _list(n: int, column: str = "close") -> str:
    return f"list({column}) OVER {_frame(n)}"


def _smooth(values: str, n: int, alpha: str) -> str:
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_concat([list_avg({values}[1:{n}])], {values}[{n + 1}:]), lambda p, q: {alpha} * q + (1 - {alpha}) * p) END"


def _ema(values: str, n: int) -> str:
    return _smooth(values, n, f"(2.0 / {n + 1})")


def _rma(values: str, n: int) -> str:
    return _smooth(values, n, f"(1.0 / {n})")


def _query(make: Callable[[DataFrame], DataFrame], columns: list[str], digits: int) -> Callable:
    def run(spark, folder: str) -> DataFrame:
        made = make(event_bars(spark, folder).withColumn("hlc3", (F.col("high") + F.col("low") + F.col("close")) / 3))
        kinds = dict(made.dtypes)
        return made.select("symbol", F.unix_millis("time").alias("time_ms"), *[F.round(F.round(c, 9) if digits < 8 else F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])

    return run


def _sql(columns: dict[str, str], more: str = "", source: str = "b") -> str:
    out = ", ".join(f"{value} AS {name}" for name, value in columns.items())
    return f"WITH RECURSIVE {BARS}{more} SELECT symbol, epoch_ms(time) AS time_ms, {out} FROM {source}"


def _r(value: str, digits: int = 6) -> str:
    return f"round({f'round({value}, 9)' if digits < 8 else value}, {digits}) + 0.0"


QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, make: Callable[[DataFrame], DataFrame], columns: dict[str, str], more: str = "", source: str = "b", also: tuple[str, ...] = (), digits: int = 6) -> None:
    QUERIES[f"ta_{name}"] = _query(make, list(columns), digits)
    ORACLE_SQL[f"ta_{name}"] = _sql({c: v if c in also else _r(v, digits) for c, v in columns.items()}, more, source)


_HISTORY = ", h AS (SELECT *, list(close) OVER {w} AS cl, list(tr) OVER {w} AS trl, list(close - pc) FILTER (WHERE pc IS NOT NULL) OVER {w} AS dl FROM b)".format(w=_all())
_lit = lambda s, p: f"list_transform({s}, lambda v: {p})"

_add("sma", lambda b: ta.sma(b, "close", 14), {"sma": _full(14, f"avg(close) OVER {_frame(14)}")})
_add("ema", lambda b: ta.ema(b, "close", 12), {"ema": _ema("cl", 12)}, _HISTORY, "h")
_add("rma", lambda b: ta.rma(b, "close", 14), {"rma": _rma("cl", 14)}, _HISTORY, "h")
_add("wma", lambda b: ta.wma(b, "close", 10), {"wma": _full(10, f"list_sum(list_transform({_list(10)}, lambda v, i: v * i)) / 55")})
_add("vwma", lambda b: ta.vwma(b, "close", 10), {"vwma": _full(10, f"sum(close * volume) OVER {_frame(10)} / sum(volume) OVER {_frame(10)}")}, digits=8)
_add("swma", lambda b: ta.swma(b, "close"), {"swma": f"(lag(close, 3) OVER ({_W}) + 2 * lag(close, 2) OVER ({_W}) + 2 * pc + close) / 6"})
_add("roc", lambda b: ta.roc(b, "close", 10), {"roc": f"(close - lag(close, 10) OVER ({_W})) / nullif(lag(close, 10) OVER ({_W}), 0) * 100"})
_add("change", lambda b: ta.change(b, "close", 2), {"change": f"close - lag(close, 2) OVER ({_W})"})
_add("mom", lambda b: ta.mom(b, "close", 10), {"mom": f"close - lag(close, 10) OVER ({_W})"})
_add("cum", lambda b: ta.cum(b, "volume"), {"cum": f"sum(volume) OVER {_all()}"})
_add("obv", lambda b: ta.obv(b), {"obv": f"sum(coalesce(sign(close - pc) * volume, 0)) OVER {_all()}"})
_add("pvt", lambda b: ta.pvt(b), {"pvt": f"sum(coalesce((close - pc) / nullif(pc, 0) * volume, 0)) OVER {_all()}"})
_UP, _DOWN = _lit("dl", "greatest(v, 0.0)"), _lit("dl", "greatest(-v, 0.0)")
_add("rsi", lambda b: ta.rsi(b, "close", 14), {"rsi": "CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END"}, _HISTORY + f", m AS (SELECT symbol, time, {_rma(_UP, 14)} AS u, {_rma(_DOWN, 14)} AS d FROM h)", "m")
_MACD = _HISTORY + f", m AS (SELECT symbol, time, {_ema('cl', 12)} - {_ema('cl', 26)} AS line FROM h), n AS (SELECT *, list(line) FILTER (WHERE line IS NOT NULL) OVER {_all()} AS ll FROM m), o AS (SELECT *, {_ema('ll', 9)} AS signal FROM n)"
_add("macd", lambda b: ta.macd(b, "close"), {"macd_line": "line", "macd_signal": "signal", "macd_hist": "line - signal"}, _MACD, "o")
_TSI = _HISTORY + f", m AS (SELECT symbol, time, {_ema('dl', 25)} AS a, {_ema(_lit('dl', 'abs(v)'), 25)} AS c FROM h), n AS (SELECT *, list(a) FILTER (WHERE a IS NOT NULL) OVER {_all()} AS al, list(c) FILTER (WHERE c IS NOT NULL) OVER {_all()} AS xl FROM m), o AS (SELECT *, {_ema('al', 13)} AS p, {_ema('xl', 13)} AS q FROM n)"
_add("tsi", lambda b: ta.tsi(b, "close"), {"tsi": "100 * p / nullif(q, 0)"}, _TSI, "o")
_DEV = "list_sum(list_transform(l, lambda v: abs(v - m))) / len(l)"
_add("dev", lambda b: ta.dev(b, "close", 10), {"dev": f"CASE WHEN len(l) = 10 THEN {_DEV} END"}, f", m AS (SELECT *, {_list(10)} AS l, avg(close) OVER {_frame(10)} AS m FROM b)", "m")
_add("cci", lambda b: ta.cci(b, "hlc3", 20), {"cci": f"CASE WHEN len(l) = 20 THEN (hlc3 - m) / nullif(0.015 * {_DEV}, 0) END"}, f", m AS (SELECT *, {_list(20, 'hlc3')} AS l, avg(hlc3) OVER {_frame(20)} AS m FROM b)", "m")
_add("mfi", lambda b: ta.mfi(b, "hlc3", 14), {"mfi": f"CASE WHEN k > 14 THEN CASE WHEN sum(dn) OVER {_frame(14)} = 0 THEN 100 ELSE 100 - 100 / (1 + sum(up) OVER {_frame(14)} / sum(dn) OVER {_frame(14)}) END END"}, ", m AS (SELECT *, CASE WHEN hlc3 > phlc3 THEN hlc3 * volume ELSE 0 END AS up, CASE WHEN hlc3 < phlc3 THEN hlc3 * volume ELSE 0 END AS dn FROM b)", "m")
_add("tr", lambda b: ta.tr(b), {"tr": "tr"})
_add("atr", lambda b: ta.atr(b, 14), {"atr": _rma("trl", 14)}, _HISTORY, "h")
_add("bb", lambda b: ta.bb(b, "close", 20, 2.0), {"bb_basis": _full(20, f"avg(close) OVER {_frame(20)}"), "bb_upper": _full(20, f"avg(close) OVER {_frame(20)} + 2 * stddev_pop(close) OVER {_frame(20)}"), "bb_lower": _full(20, f"avg(close) OVER {_frame(20)} - 2 * stddev_pop(close) OVER {_frame(20)}")})
_add("bbw", lambda b: ta.bbw(b, "close", 20, 2.0), {"bbw": _full(20, f"4 * stddev_pop(close) OVER {_frame(20)} / nullif(avg(close) OVER {_frame(20)}, 0)")})
_DMI = f""", d AS (
  SELECT *, list(tr) FILTER (WHERE k > 1) OVER {_all()} AS tl,
    list(CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END) FILTER (WHERE k > 1) OVER {_all()} AS ul,
    list(CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END) FILTER (WHERE k > 1) OVER {_all()} AS ol FROM b
), e AS (
  SELECT symbol, time, 100 * ({_rma('ul', 14)}) / nullif({_rma('tl', 14)}, 0) AS p, 100 * ({_rma('ol', 14)}) / nullif({_rma('tl', 14)}, 0) AS m FROM d
), f AS (
  SELECT *, list(100 * abs(p - m) / nullif(p + m, 0)) FILTER (WHERE p + m <> 0) OVER {_all()} AS xl FROM e
)"""
_add("dmi", lambda b: ta.dmi(b, 14, 14), {"dmi_plus": "p", "dmi_minus": "m", "dmi_adx": _rma("xl", 14)}, _DMI, "f")
_TREND = _HISTORY + f""", a AS (
  SELECT symbol, time, k, close, pc, (high + low) / 2 + 3 * ({_rma('trl', 10)}) AS bu, (high + low) / 2 - 3 * ({_rma('trl', 10)}) AS bl FROM h
), s AS (
  SELECT symbol, time, k, bu AS u, bl AS l, bu AS t, 1 AS way FROM a WHERE k = 10
  UNION ALL
  SELECT symbol, time, k, u, l, CASE WHEN way = -1 THEN l ELSE u END, way FROM (
    SELECT symbol, time, k, u, l, CASE WHEN was THEN CASE WHEN close > u THEN -1 ELSE 1 END ELSE CASE WHEN close < l THEN 1 ELSE -1 END END AS way FROM (
      SELECT a.symbol, a.time, a.k, a.close, abs(s.t - s.u) < 1e-10 AS was, CASE WHEN a.bu < s.u OR a.pc > s.u THEN a.bu ELSE s.u END AS u, CASE WHEN a.bl > s.l OR a.pc < s.l THEN a.bl ELSE s.l END AS l
      FROM s JOIN a ON a.symbol = s.symbol AND a.k = s.k + 1))
), z AS (SELECT b.symbol, b.time, s.t, CAST(s.way AS BIGINT) AS way FROM b LEFT JOIN s ON b.symbol = s.symbol AND b.k = s.k)"""
_add("supertrend", lambda b: ta.supertrend(b, 3.0, 10), {"supertrend": "t", "supertrend_direction": "way"}, _TREND, "z", ("supertrend_direction",))
_add("stoch", lambda b: ta.stoch(b, "close", "high", "low", 14), {"stoch": _full(14, f"(close - min(low) OVER {_frame(14)}) / nullif(max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)}, 0) * 100")})
_add("wpr", lambda b: ta.wpr(b, 14), {"wpr": f"(max(high) OVER {_frame(14)} - close) / nullif(max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)}, 0) * -100"})
_add("highest", lambda b: ta.highest(b, "high", 10), {"highest": f"max(high) OVER {_frame(10)}"})
_add("lowest", lambda b: ta.lowest(b, "low", 10), {"lowest": f"min(low) OVER {_frame(10)}"})
_add("range", lambda b: ta.value_range(b, "close", 10), {"range": f"max(close) OVER {_frame(10)} - min(close) OVER {_frame(10)}"})
_add("highestbars", lambda b: ta.highestbars(b, "high", 10), {"highestbars": f"k - arg_max(k, row(high, k)) OVER {_frame(10)}"}, also=("highestbars",))
_add("lowestbars", lambda b: ta.lowestbars(b, "low", 10), {"lowestbars": f"k - arg_max(k, row(-low, k)) OVER {_frame(10)}"}, also=("lowestbars",))
_MEANS = f", m AS (SELECT *, avg(close) OVER {_frame(5)} AS f5, avg(close) OVER {_frame(20)} AS f20 FROM b), x AS (SELECT *, coalesce(lag(f5) OVER ({_W}) <= lag(f20) OVER ({_W}) AND f5 > f20, false) AS up, coalesce(lag(f5) OVER ({_W}) >= lag(f20) OVER ({_W}) AND f5 < f20, false) AS dn FROM m)"


def _means(b: DataFrame) -> DataFrame:
    return b.withColumns({"f5": F.avg("close").over(last(5)), "f20": F.avg("close").over(last(20))})


_add("crossover", lambda b: ta.crossover(_means(b), "f5", "f20"), {"crossover": "up"}, _MEANS, "x", ("crossover",))
_add("crossunder", lambda b: ta.crossunder(_means(b), "f5", "f20"), {"crossunder": "dn"}, _MEANS, "x", ("crossunder",))
_add("cross", lambda b: ta.cross(_means(b), "f5", "f20", "crossed"), {"crossed": "up OR dn"}, _MEANS, "x", ("crossed",))
_add("barssince", lambda b: ta.barssince(ta.crossover(_means(b), "f5", "f20"), "crossover"), {"barssince": f"k - max(CASE WHEN up THEN k END) OVER {_all()}"}, _MEANS, "x", ("barssince",))
_add("valuewhen", lambda b: ta.valuewhen(ta.valuewhen(ta.crossover(_means(b), "f5", "f20"), "crossover", "close", 0, "latest"), "crossover", "close", 1, "before"), {"latest": "l[len(l)]", "before": "CASE WHEN len(l) > 1 THEN l[len(l) - 1] END"}, _MEANS + f", y AS (SELECT *, list(close) FILTER (WHERE up) OVER {_all()} AS l FROM x)", "y")
_add("stdev", lambda b: ta.stdev(b, "close", 10), {"stdev": _full(10, f"stddev_pop(close) OVER {_frame(10)}")})
_add("variance", lambda b: ta.variance(b, "close", 10), {"variance": _full(10, f"var_pop(close) OVER {_frame(10)}")})
_add("correlation", lambda b: ta.correlation(b, "close", "volume", 10), {"correlation": f"CASE WHEN count(close) OVER {_frame(10)} = 10 AND min(volume) OVER {_frame(10)} < max(volume) OVER {_frame(10)} AND min(close) OVER {_frame(10)} < max(close) OVER {_frame(10)} THEN corr(close, volume) OVER {_frame(10)} END"})
_add("linreg", lambda b: ta.linreg(b, "close", 10), {"linreg": _full(10, f"regr_intercept(close, CAST(k AS DOUBLE)) OVER {_frame(10)} + regr_slope(close, CAST(k AS DOUBLE)) OVER {_frame(10)} * k")})
_add("median", lambda b: ta.median(b, "close", 10), {"median": _full(10, f"median(close) OVER {_frame(10)}")})
_add("percentrank", lambda b: ta.percentrank(b, "close", 10), {"percentrank": _full(10, f"len(list_filter({_list(10)}, lambda v: v <= close)) * 10.0")})
_add("percentile_linear", lambda b: ta.percentile_linear_interpolation(b, "close", 10, 30), {"percentile": _full(10, f"quantile_cont(close, 0.3) OVER {_frame(10)}")})
_add("percentile_nearest", lambda b: ta.percentile_nearest_rank(b, "close", 10, 30), {"percentile": _full(10, f"list_sort({_list(10)})[3]")})
_STEP = f", m AS (SELECT *, CASE WHEN close > pc THEN 1 ELSE 0 END AS su, CASE WHEN close < pc THEN 1 ELSE 0 END AS sd FROM b)"
_add("rising", lambda b: ta.rising(b, "close", 3), {"rising": f"sum(su) OVER {_frame(3)} = 3"}, _STEP, "m", ("rising",))
_add("falling", lambda b: ta.falling(b, "close", 3), {"falling": f"sum(sd) OVER {_frame(3)} = 3"}, _STEP, "m", ("falling",))
_add("rolling_sum", lambda b: ta.rolling_sum(b, "close", 10, "total"), {"total": f"CASE WHEN k >= 10 THEN sum(close) OVER {_frame(10)} END"})
_add("rolling_avg", lambda b: ta.rolling_avg(b, "close", 10, "mean"), {"mean": f"CASE WHEN k >= 10 THEN avg(close) OVER {_frame(10)} END"})
_add("history", lambda b: bar_index(b).withColumn("before", F.lag("close", 3).over(ordered())), {"before": f"lag(close, 3) OVER ({_W})", "bar_index": "k - 1", "is_first": "k = 1", "is_last": f"lead(time) OVER ({_W}) IS NULL"}, also=("bar_index", "is_first", "is_last"))


def _gaps(b: DataFrame) -> DataFrame:
    """Bars of which each seventh lacks its values, with the compacting indicators."""
    there = F.row_number().over(ordered()) % 7 != 4
    b = b.withColumns({c: F.when(there, F.col(c)) for c in ("open", "high", "low", "close", "volume", "hlc3")})

    def make(own: DataFrame) -> DataFrame:
        own = ta.vwma(ta.swma(ta.roc(own, "close", 10), "close"), "close", 10)
        own = ta.bbw(ta.bb(ta.cci(own, "hlc3", 20), "close", 20, 2.0), "close", 20, 2.0)
        own = ta.correlation(ta.wpr(ta.stoch(own, "close", "high", "low", 14), 14), "close", "volume", 10)
        own = ta.percentrank(ta.linreg(own, "close", 10), "close", 10)
        return ta.crossover(ta.falling(ta.rising(own, "close", 2), "close", 2), "close", "hlc3")

    return compacting(b, ["open", "high", "low", "close", "volume"], make)


_THERE = f""", g AS (SELECT * FROM b WHERE k % 7 <> 4), p AS (
  SELECT symbol, time, high, low, close, volume, hlc3, row_number() OVER ({_W}) AS k, lag(close) OVER ({_W}) AS pc FROM g
), q AS (
  SELECT *, {_list(20, "hlc3")} AS l, avg(hlc3) OVER {_frame(20)} AS m, coalesce(CASE WHEN close > pc THEN 1 ELSE 0 END, 0) AS su, coalesce(CASE WHEN close < pc THEN 1 ELSE 0 END, 0) AS sd FROM p
)"""
_GAPS = {
    "roc": f"(close - lag(close, 10) OVER ({_W})) / nullif(lag(close, 10) OVER ({_W}), 0) * 100",
    "swma": f"(lag(close, 3) OVER ({_W}) + 2 * lag(close, 2) OVER ({_W}) + 2 * pc + close) / 6",
    "vwma": _full(10, f"sum(close * volume) OVER {_frame(10)} / sum(volume) OVER {_frame(10)}"),
    "cci": f"CASE WHEN len(l) = 20 THEN (hlc3 - m) / nullif(0.015 * {_DEV}, 0) END",
    "bb_upper": _full(20, f"avg(close) OVER {_frame(20)} + 2 * stddev_pop(close) OVER {_frame(20)}"),
    "bbw": _full(20, f"4 * stddev_pop(close) OVER {_frame(20)} / nullif(avg(close) OVER {_frame(20)}, 0)"),
    "stoch": _full(14, f"(close - min(low) OVER {_frame(14)}) / nullif(max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)}, 0) * 100"),
    "wpr": f"(max(high) OVER {_frame(14)} - close) / nullif(max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)}, 0) * -100",
    "correlation": f"CASE WHEN count(close) OVER {_frame(10)} = 10 AND min(volume) OVER {_frame(10)} < max(volume) OVER {_frame(10)} AND min(close) OVER {_frame(10)} < max(close) OVER {_frame(10)} THEN corr(close, volume) OVER {_frame(10)} END",
    "linreg": _full(10, f"regr_intercept(close, CAST(k AS DOUBLE)) OVER {_frame(10)} + regr_slope(close, CAST(k AS DOUBLE)) OVER {_frame(10)} * k"),
    "percentrank": _full(10, f"len(list_filter({_list(10)}, lambda v: v <= close)) * 10.0"),
    "rising": f"sum(su) OVER {_frame(2)} = 2",
    "falling": f"sum(sd) OVER {_frame(2)} = 2",
    "crossover": f"coalesce(pc <= lag(hlc3) OVER ({_W}) AND close > hlc3, false)",
}
_CARRY = _THERE + f", r AS (SELECT symbol, time, {', '.join(f'{v} AS {c}' for c, v in _GAPS.items())} FROM q), z AS (SELECT symbol, time, {', '.join(f'last_value(r.{c} IGNORE NULLS) OVER {_all()} AS {c}' for c in _GAPS)} FROM b LEFT JOIN r USING (symbol, time))"
_add("gaps", _gaps, {c: c for c in _GAPS}, _CARRY, "z", ("rising", "falling", "crossover"))

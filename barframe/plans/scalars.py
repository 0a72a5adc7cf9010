"""Queries over the scalar, text, array, map and colour functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.functions import arrayfn, colorfn, mapfn, mathfn, na, strfn


def _table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _six(x):
    return F.round(F.round(x, 9), 6)


def math_functions(spark, folder: str) -> DataFrame:
    """Scalar mathematics over line items."""
    d, t, q, p = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_extendedprice")
    x = d - 0.05
    rows = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        F.abs(x).alias("absolute"), mathfn.maximum(d, t).alias("greatest_rate"), mathfn.minimum(d, t).alias("least_rate"), _six(F.sqrt(q)).alias("root"), _six(F.pow(q, F.lit(1.5))).alias("power"), _six(F.exp(x)).alias("e_to"),
        _six(mathfn.log(q)).alias("natural_log"), F.round(mathfn.log10(p), 8).alias("decimal_log"), mathfn.log(x - 1).alias("log_of_negative"), _six(F.sin(q)).alias("sine"), _six(F.cos(q)).alias("cosine"), _six(F.tan(x)).alias("tangent"),
        _six(mathfn.asin(x)).alias("arc_sine"), _six(mathfn.acos(x)).alias("arc_cosine"), mathfn.asin(q + 1).alias("arc_sine_beyond"), _six(F.atan(q)).alias("arc_tangent"), _six(F.sinh(x)).alias("sinh"), _six(F.cosh(x)).alias("cosh"), _six(F.tanh(x)).alias("tanh"),
        mathfn.rounded(p).alias("rounded"), _six(mathfn.round_to_nearest(p, F.lit(0.25))).alias("to_quarter"), mathfn.ceil(p).alias("up"), mathfn.floor(p).alias("down"), mathfn.trunc(p).alias("cut"), mathfn.sign(x).alias("sign"), mathfn.copysign(q, x).alias("signed"),
        _six(F.degrees(x)).alias("degrees"), _six(F.radians(q)).alias("radians"), na.nz(F.when(q > 25, q)).alias("or_zero"), mathfn.tostring(q).alias("text"),
    )


_R = lambda v: f"round(round({v}, 9), 6) + 0.0"
MATH_SQL = f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, abs(x) AS absolute, greatest(l_discount, l_tax) AS greatest_rate, least(l_discount, l_tax) AS least_rate, {_R('sqrt(q)')} AS root, {_R('pow(q, 1.5)')} AS power, {_R('exp(x)')} AS e_to,
  {_R('ln(q)')} AS natural_log, round(log10(p), 8) AS decimal_log, CAST(NULL AS DOUBLE) AS log_of_negative, {_R('sin(q)')} AS sine, {_R('cos(q)')} AS cosine, {_R('tan(x)')} AS tangent, {_R('asin(x)')} AS arc_sine, {_R('acos(x)')} AS arc_cosine, CAST(NULL AS DOUBLE) AS arc_sine_beyond, {_R('atan(q)')} AS arc_tangent,
  {_R('(exp(x) - exp(-x)) / 2')} AS sinh, {_R('(exp(x) + exp(-x)) / 2')} AS cosh, {_R('(exp(x) - exp(-x)) / (exp(x) + exp(-x))')} AS tanh, CAST(round(p) AS BIGINT) AS rounded, {_R('round(p / 0.25) * 0.25')} AS to_quarter, CAST(ceil(p) AS BIGINT) AS up, CAST(floor(p) AS BIGINT) AS down, CAST(trunc(p) AS BIGINT) AS cut,
  CAST(sign(x) AS BIGINT) AS sign, CASE WHEN x >= 0 THEN q ELSE -q END AS signed, {_R('degrees(x)')} AS degrees, {_R('radians(q)')} AS radians, CASE WHEN q > 25 THEN q ELSE 0 END AS or_zero, CAST(CAST(q AS BIGINT) AS VARCHAR) AS text
FROM (SELECT *, l_discount - 0.05 AS x, l_quantity AS q, l_extendedprice AS p FROM lineitem)"""


def na_operators(spark, folder: str) -> DataFrame:
    """Arithmetic and comparisons where values are missing or zero."""
    rows = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("a"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") - 1).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", na.add(a, b).alias("plus"), na.subtract(a, b).alias("minus"), na.multiply(a, b).alias("times"), _six(na.divide(a, b)).alias("over"), na.modulo(a, b).alias("rest"), na.equal(a, b).alias("eq"), na.not_equal(a, b).alias("ne"), na.less(a, b).alias("lt"), na.less_equal(a, b).alias("le"),
        na.greater(a, b).alias("gt"), na.greater_equal(a, b).alias("ge"), (na.greater(a, F.lit(20.0)) & (b > 1)).alias("both"), na.choose(b > 1, a, -a).alias("chosen"), F.coalesce(a, b).alias("first_there"), na.switch(b, [(F.lit(0.0), F.lit("zero")), (F.lit(1.0), F.lit("one"))], F.lit("many")).alias("named"), na.switch(None, [(a > 40, F.lit("high")), (a > 20, F.lit("middle"))], F.lit("low")).alias("level"),
        na.truthy(b, numeric=True).alias("zero_is_true"), na.power(F.lit(-8.0), na.divide(F.lit(1.0), b)).isNull().alias("no_root"),
    )


NA_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, a + b AS plus, a - b AS minus, a * b AS times, round(round(a / nullif(b, 0), 9), 6) + 0.0 AS over, fmod(a, nullif(b, 0)) AS rest, coalesce(a = b, false) AS eq, coalesce(a <> b, true) AS ne, coalesce(a < b, false) AS lt, coalesce(a <= b, false) AS le, coalesce(a > b, false) AS gt, coalesce(a >= b, false) AS ge,
  coalesce(a > 20, false) AND b > 1 AS both, CASE WHEN b > 1 THEN a ELSE -a END AS chosen, coalesce(a, b) AS first_there, CASE WHEN b = 0 THEN 'zero' WHEN b = 1 THEN 'one' ELSE 'many' END AS named, CASE WHEN a > 40 THEN 'high' WHEN a > 20 THEN 'middle' ELSE 'low' END AS level, b IS NOT NULL AS zero_is_true,
  b IS NULL OR b = 0 OR b NOT IN (1) AS no_root
FROM (SELECT *, CASE WHEN l_quantity > 10 THEN l_quantity END AS a, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber - 1 AS DOUBLE) END AS b FROM lineitem)"""


def text_functions(spark, folder: str) -> DataFrame:
    """Text functions over whole documents."""
    rows = _table(spark, folder, "documents").select("doc_id", "text", "source")
    s, src = F.col("text"), F.col("source")
    words = strfn.split(s, F.lit(" "))
    return rows.select(
        "doc_id", strfn.length(s).alias("bytes"), F.md5(F.encode(strfn.replace_all(s, F.lit("e"), F.lit("3")), "UTF-8")).alias("replaced"), F.size(words).cast("long").alias("pieces"), strfn.contains(s, F.lit("License")).alias("licensed"), strfn.startswith(s, F.lit("The")).alias("begins"), strfn.endswith(s, F.lit(".")).alias("ends"),
        F.upper(src).alias("upper"), F.lower(F.upper(src)).alias("lower"), strfn.trim(F.concat(F.lit("  "), src, F.lit("\t "))).alias("trimmed"), F.concat(strfn.trim_start(F.concat(F.lit(" "), src, F.lit(" "))), F.lit("|")).alias("left_trimmed"), F.concat(F.lit("|"), strfn.trim_end(F.concat(F.lit(" "), src, F.lit(" ")))).alias("right_trimmed"), F.concat(src, F.lit("/"), src).alias("joined_pair"),
        strfn.substring(src, F.lit(3)).alias("number_text"), strfn.tonumber(strfn.substring(src, F.lit(3))).alias("number"), strfn.substring(src, F.lit(9), F.lit(4)).alias("no_part"), F.md5(F.encode(strfn.join(words, "-"), "UTF-8")).alias("dashed"), strfn.pos(s, F.lit(" ")).alias("first_blank"), strfn.formatted("{0}:{1}", src, F.lit(None).cast("string")).alias("formatted"), strfn.match(s, F.lit("the")).alias("matched"),
    )


TEXT_SQL = """SELECT doc_id, octet_length(encode(text)) AS bytes, md5(replace(text, 'e', '3')) AS replaced, CAST(len(string_split(text, ' ')) AS BIGINT) AS pieces, coalesce(contains(text, 'License'), false) AS licensed, coalesce(starts_with(text, 'The'), false) AS begins, coalesce(ends_with(text, '.'), false) AS ends, upper(source) AS upper, lower(source) AS lower, source AS trimmed,
  source || ' |' AS left_trimmed, '| ' || source AS right_trimmed, source || '/' || source AS joined_pair, substr(source, 4) AS number_text, CAST(substr(source, 4) AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS no_part, md5(replace(text, ' ', '-')) AS dashed, CASE WHEN instr(text, ' ') > 0 THEN octet_length(encode(substr(text, 1, instr(text, ' ') - 1))) END AS first_blank, source || ':NaN' AS formatted, CASE WHEN contains(text, 'the') THEN 'the' END AS matched
FROM documents"""


def array_functions(spark, folder: str) -> DataFrame:
    """Array functions over embeddings."""
    rows = _table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 64).cast("double")).alias("a"))
    a, three, i = F.col("a"), F.lit(3.0), F.lit
    small = arrayfn.cut(a, i(0), i(8))
    return rows.select(
        "vec_id", F.size(a).cast("long").alias("size"), arrayfn.first(a).alias("first"), arrayfn.last(a).alias("last"), arrayfn.get(a, i(-4)).alias("clamped"), arrayfn.get(a, i(10_000)).alias("beyond"), arrayfn.total(a).alias("sum"), _six(arrayfn.mean(a)).alias("avg"), arrayfn.smallest(a).alias("min"), arrayfn.largest(a).alias("max"), arrayfn.spread(a).alias("range"), arrayfn.median(a).alias("median"), _six(arrayfn.stdev(small)).alias("stdev"), _six(arrayfn.variance(small)).alias("variance"),
        _six(arrayfn.percentrank(a, three)).alias("percentrank"), arrayfn.includes(a, three).alias("includes"), arrayfn.every(a, three).alias("every"), arrayfn.indexof(a, three).cast("long").alias("indexof"), arrayfn.lastindexof(a, three).cast("long").alias("lastindexof"), arrayfn.binary_search(arrayfn.ordered(a), three).cast("long").alias("searched"), _six(arrayfn.covariance(small, F.reverse(small))).alias("covariance"),
        F.array_join(F.transform(arrayfn.ordered(small), lambda v: v.cast("long").cast("string")), ",").alias("ordered"), F.size(arrayfn.push(a, three)).cast("long").alias("pushed"), arrayfn.first(arrayfn.unshift(a, three)).alias("unshifted"), arrayfn.get(arrayfn.insert(a, i(2), i(99.0)), i(2)).alias("inserted"), arrayfn.get(arrayfn.put(a, i(1), i(98.0)), i(1)).alias("set"), arrayfn.total(arrayfn.fill(small, i(2.0))).alias("filled"), arrayfn.cut(a, i(5), i(4)).isNull().alias("no_slice"), _six(arrayfn.total(arrayfn.standardize(small))).alias("standardized"), arrayfn.total(arrayfn.new(i(1.5), 4)).alias("repeated"),
    )


ARRAY_SQL = """SELECT vec_id, CAST(len(a) AS BIGINT) AS size, a[1] AS first, a[len(a)] AS last, a[1] AS clamped, CAST(NULL AS DOUBLE) AS beyond, list_sum(a) AS sum, round(round(list_avg(a), 9), 6) + 0.0 AS avg, list_min(a) AS min, list_max(a) AS max, list_max(a) - list_min(a) AS range, list_median(a) AS median, round(round(list_stddev_pop(s), 9), 6) + 0.0 AS stdev, round(round(list_var_pop(s), 9), 6) + 0.0 AS variance,
  round(round(len(list_filter(a, lambda v: v < 3)) * 100.0 / len(a), 9), 6) + 0.0 AS percentrank, list_contains(a, 3) AS includes, len(list_filter(a, lambda v: v <> 3)) = 0 AS every, CAST(nullif(coalesce(list_position(a, 3), 0), 0) - 1 AS BIGINT) AS indexof, CAST(len(a) - nullif(coalesce(list_position(list_reverse(a), 3), 0), 0) AS BIGINT) AS lastindexof, CAST(nullif(coalesce(list_position(list_sort(a), 3), 0), 0) - 1 AS BIGINT) AS searched,
  round(round(list_sum(list_transform(list_zip(s, list_reverse(s)), lambda z: (z[1] - list_avg(s)) * (z[2] - list_avg(s)))) / len(s), 9), 6) + 0.0 AS covariance, array_to_string(list_transform(list_sort(s), lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS ordered, CAST(len(a) + 1 AS BIGINT) AS pushed, 3.0::DOUBLE AS unshifted, 99.0::DOUBLE AS inserted, 98.0::DOUBLE AS set, 16.0::DOUBLE AS filled, true AS no_slice, 0.0::DOUBLE AS standardized, 6.0::DOUBLE AS repeated
FROM (SELECT vec_id, a, a[1:8] AS s FROM (SELECT vec_id, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 64)) AS a FROM embeddings))"""


def map_functions(spark, folder: str) -> DataFrame:
    """Map functions over the properties of events."""
    rows = _table(spark, folder, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("own"))
    m = mapfn.put(F.coalesce(F.col("own"), F.create_map().cast("map<string,string>")), F.lit("kind"), F.col("event_type"))
    made = rows.select("event_id", "event_type", m.alias("m"))
    m, kind = F.col("m"), F.lit("kind")
    return made.select("event_id", mapfn.get(m, kind).alias("kind"), mapfn.get(m, F.lit("none")).alias("none"), mapfn.contains(m, kind).alias("has"), mapfn.contains(mapfn.remove(m, kind), kind).alias("still"), mapfn.size(m).alias("size"), mapfn.size(mapfn.remove(m, kind)).alias("rest"), mapfn.is_empty(mapfn.clear(m)).alias("cleared"), F.array_contains(mapfn.keys(m), "kind").alias("listed"), F.array_contains(mapfn.values(m), F.col("event_type")).alias("valued"), mapfn.get(mapfn.new_from_pair(kind, F.lit(1)), kind).alias("pair"))


MAP_SQL = """SELECT event_id, event_type AS kind, CAST(NULL AS VARCHAR) AS none, true AS has, false AS still, CAST(n + 1 AS BIGINT) AS size, CAST(n AS BIGINT) AS rest, true AS cleared, true AS listed, true AS valued, 1 AS pair
FROM (SELECT event_id, event_type, coalesce(len(list_filter(json_keys(props), lambda k: k <> 'kind')), 0) AS n FROM events)"""


def color_functions(spark, folder: str) -> DataFrame:
    """Colours made of part keys."""
    rows = _table(spark, folder, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    c = colorfn.rgba((k % 256).cast("int"), (k * 7 % 256).cast("int"), (k * 13 % 256).cast("int"), (k * 5 % 256).cast("int"))
    made = rows.select("p_partkey", "p_size", c.alias("c"), colorfn.from_hex(F.lit(colorfn.NAMED["blue"])).alias("blue"))
    c, blue = F.col("c"), F.col("blue")
    return made.select("p_partkey", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), c["a"].alias("a"), colorfn.to_hex(c).alias("hex"), _six(colorfn.transparency(c)).alias("transparency"), colorfn.with_transparency(c, F.col("p_size").cast("double"))["a"].alias("alpha"), colorfn.mix(c, blue, 0.25)["g"].alias("mixed"), colorfn.lighten(c, 0.5)["r"].alias("lighter"), colorfn.darken(c, 0.5)["b"].alias("darker"), colorfn.rgba(c["r"] + 256, c["g"], c["b"]).isNull().alias("refused"), colorfn.to_hex(blue).alias("named"))


COLOR_SQL = """SELECT p_partkey, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CAST(a AS INTEGER) AS a, '#' || printf('%02x%02x%02x', r, g, b) || CASE WHEN a = 255 THEN '' ELSE printf('%02x', a) END AS hex, round(round(100 - a / 255.0::DOUBLE * 100, 9), 6) + 0.0 AS transparency, CAST(trunc(255 - CAST(p_size AS DOUBLE) / 100.0::DOUBLE * 255) AS INTEGER) AS alpha,
  CAST(trunc(g * 0.75::DOUBLE + 120 * 0.25::DOUBLE) AS INTEGER) AS mixed, CAST(trunc(r + (255 - r) * 0.5::DOUBLE) AS INTEGER) AS lighter, CAST(trunc(b * 0.5::DOUBLE) AS INTEGER) AS darker, true AS refused, '#0078ff' AS named
FROM (SELECT p_partkey, p_size, p_partkey % 256 AS r, p_partkey * 7 % 256 AS g, p_partkey * 13 % 256 AS b, p_partkey * 5 % 256 AS a FROM part)"""

QUERIES: dict[str, Callable] = {"math_functions": math_functions, "na_operators": na_operators, "text_functions": text_functions, "array_functions": array_functions, "map_functions": map_functions, "color_functions": color_functions}
ORACLE_SQL: dict[str, str] = {"math_functions": MATH_SQL, "na_operators": NA_SQL, "text_functions": TEXT_SQL, "array_functions": ARRAY_SQL, "map_functions": MAP_SQL, "color_functions": COLOR_SQL}

import math

import duckdb
import pytest

import __spark_entry__ as entry
from barframe.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each kind; the driver holds all of them against their SQL.
CHOSEN = ["ta_sma", "ta_macd", "ta_supertrend", "ta_dmi", "ta_valuewhen", "ta_linreg", "bars_events", "bars_orders", "bars_csv", "na_operators", "array_functions", "color_functions", "strategy_signals", "strategy_trades", "strategy_report", "strategy_equity", "strategy_open", "ta_gaps", "script_loops", "script_while", "output_json", "script_branches", "script_variables", "stream_bars", "stream_average"]


def rows(frame):
    clean = lambda v: None if v is None or v != v else 0.0 if v == 0 else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want, got = rows(db.execute(ORACLE_SQL[name]).df()), rows(QUERIES[name](spark, FOLDER).toPandas())
    assert len(want) == len(got)
    for a, b in zip(want, got):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(a, b))


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

from datetime import datetime

import pytest

from barframe.operators import strategy

AT = datetime(2024, 1, 1)


def signals(spark, rows):
    return spark.createDataFrame([("A", bar, AT, kind, ident, side, qty, price, comment) for bar, kind, ident, side, qty, price, comment in rows], strategy.SIGNAL)


def test_lots_close_in_order_and_in_part(spark):
    made = signals(spark, [(0, "entry", "L", "long", 2.0, 10.0, None), (1, "entry", "L", "long", 1.0, 20.0, None), (2, "close", "L", "", 2.5, 30.0, None), (3, "close", "L", "", 0.0, 5.0, None)])
    rows = [(r.entry_bar, r.exit_bar, r.qty, r.gross_pnl, r.bars_held) for r in strategy.trades(made).orderBy("exit_bar", "entry_bar").collect()]
    assert rows == [(0, 2, 2.0, 40.0, 2), (1, 2, 0.5, 5.0, 1), (1, 3, 0.5, -7.5, 2)]
    assert strategy.open_lots(made).count() == 0


def test_short_side_slippage_and_commission(spark):
    made = signals(spark, [(0, "entry", "S", "strategy.short", 1.0, 100.0, None), (0, "entry", "L", "long", 1.0, 100.0, None), (4, "exit", "X", "", 0.0, 90.0, "S")])
    (trade,) = strategy.trades(made, commission=1.0, slippage=0.5).collect()
    assert (trade.entry_price, trade.exit_price, trade.direction) == (99.5, 90.5, "short")
    assert trade.gross_pnl == pytest.approx(9.0) and trade.commission == pytest.approx(1.9) and trade.slippage_cost == 1.0 and trade.pnl == pytest.approx(6.1)
    assert [(r.ident, r.qty) for r in strategy.open_lots(made).collect()] == [("L", 1.0)]


def test_entries_come_before_exits_of_a_bar(spark):
    made = signals(spark, [(0, "close", "L", "", 0.0, 10.0, None), (0, "entry", "L", "long", 1.0, 10.0, None)])
    (trade,) = strategy.trades(made).collect()
    assert trade.bars_held == 0 and trade.pnl == 0


def test_report_and_equity(spark):
    made = signals(spark, [(0, "entry", "L", "long", 1.0, 10.0, None), (1, "close", "L", "", 0.0, 15.0, None), (2, "entry", "L", "long", 1.0, 20.0, None), (3, "close", "L", "", 0.0, 12.0, None)])
    closed = strategy.trades(made)
    (r,) = strategy.report(closed, 100.0).collect()
    assert (r.net_profit, r.gross_profit, r.gross_loss, r.win_rate, r.profit_factor, r.max_drawdown, r.largest_loss) == (-3.0, 5.0, 8.0, 50.0, 0.625, 8.0, -8.0)
    assert [x.equity for x in strategy.equity_curve(closed, 100.0).orderBy("trade").collect()] == [105.0, 97.0]

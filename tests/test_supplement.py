from pyspark.sql import functions as F

from barloom.operators import supplement as sp


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_reference_tables(spark):
    assert one(spark, sp.spread_pips(F.lit("USDJPY"))) == 0.9 and one(spark, sp.spread_pips(F.lit("XXXYYY"))) == 0
    assert one(spark, sp.price_digits(F.lit("EURJPY"))) == 3 and one(spark, sp.to_pips(F.lit("EURUSD"), F.lit(-0.00123))) == 12.3
    assert one(spark, sp.secondary_timeframe(F.lit("h1"))) == "h4" and one(spark, sp.relative_timeframe(F.lit("h1"), F.lit("m15"))) == "lower"
    assert one(spark, sp.default_currency(F.lit("EURUSD"), ["USD"])) == "USD" and one(spark, sp.default_currency(F.lit("EURUSD"), [])) == "JPY"
    assert one(spark, sp.cot_context(F.lit(5.0), F.lit(True))) == "supports_pair" and one(spark, sp.cot_context(F.lit(5.0), F.lit(False))) == "weighs_on_pair"
    assert sp.seven_points(10) == [5.0, 8.3, 11.7, 15.0, 18.3, 21.7, 25.0]


def test_strategy_problems(spark):
    schema = "strategy_id string, tf string, kind string, stop_pips double, target_pips double, trailing_pips double, session_start string, session_end string, mode string"
    good = ("a", "h1", "rsi", 10.0, 20.0, None, None, None, "fixedLot")
    rows = [good, ("b", "w1", "odd", 0.0, None, -1.0, "24:00", "06:00", "x"), ("c", *good[1:]), ("c", *good[1:]), (None, *good[1:])]
    got = sorted((str(r.strategy_id), r.problem) for r in sp.strategy_problems(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([*(("b", p) for p in ("timeframe", "rule", "stop", "target", "trailing", "session", "mode")), ("c", "repeated"), ("None", "id")])


def test_calendar_and_journal(spark):
    events = spark.createDataFrame([("a", "USD", 5, "high"), ("b", "USD", 9, "low"), ("c", "EUR", 9, "medium"), ("d", "GBP", 1, "high")], "title string, currency string, time long, impact string")
    assert sorted(r.title for r in sp.calendar_for(events, "EURUSD").collect()) == ["a", "c"]
    assert [(r.title, r.side, r.distance) for r in sp.calendar_sides(events, 5).collect()] == [("c", "upcoming", 4), ("b", "upcoming", 4), ("a", "past", 0), ("d", "past", 4)]
    journal, new = (spark.createDataFrame(rows, "k string, t long, p double") for rows in ([("a", 1, 0.5)], [("a", 9, 0.9), ("b", 2, 0.6), ("c", 3, 0.7)]))
    assert [tuple(r) for r in sp.journal_append(journal, new, ["k"], 2).collect()] == [("c", 3, 0.7), ("b", 2, 0.6)]


def test_iso_and_factor(spark):
    assert str(one(spark, sp.newest_iso(F.array(F.lit("2024-01-02 00:00:00"), F.lit("bad"), F.lit("2024-01-03 00:00:00")), F.lit(0)))) == "2024-01-03 00:00:00"
    df = spark.createDataFrame([(0.0, 0.0, 0), (5.0, 0.0, 1), (0.0, 0.0, 1), (6.0, -3.0, 2)], "g double, l double, n int")
    assert [r[0] for r in df.select(sp.retired_profit_factor(F.col("g"), F.col("l"), F.col("n"))).collect()] == [None, None, 0.0, 2.0]


def test_levels_and_rates(spark):
    levels = spark.createDataFrame([("A", "h1", 1.0, "support", 3.0, 2.0), ("A", "h1", 2.0, "support", 9.0, 2.0), ("A", "h1", 5.0, "resistance", 1.0, 4.0)], "symbol string, tf string, price double, direction string, strength double, distance double")
    assert sorted((r.direction, r.price) for r in sp.nearest_levels(levels).collect()) == [("resistance", 5.0), ("support", 2.0)]
    bars = spark.createDataFrame([("EURUSD", "h1", 7200), ("EURJPY", "h1", 7200)], "symbol string, tf string, t long")
    assert {r.symbol: r.pip_value for r in sp.pip_values(bars, None).collect()} == {"EURUSD": 1500.0, "EURJPY": 1000.0}


def test_nearest_rate_at_any_distance(spark):
    day = 86400
    times = [0, 30 * day, 34 * day, 60 * day, 71 * day, 90 * day, 400 * day]
    rates = {40 * day: 100.0, 44 * day + 7: 110.0, 80 * day: 120.0, 81 * day: -1.0}
    bars = spark.createDataFrame([("EURUSD", "h1", t) for t in times], "symbol string, tf string, t long")
    usdjpy = spark.createDataFrame(list(rates.items()), "t long, c double")
    got = {r.t: r.pip_value for r in sp.pip_values(bars, usdjpy).collect()}
    nearest = {t: rates[min(rates, key=lambda at: (abs(at - t), at))] for t in times}
    assert got == {t: 10 * (rate if rate > 0 else 150.0) for t, rate in nearest.items()}
    assert {r.pip_value for r in sp.pip_values(bars, usdjpy.limit(0)).collect()} == {1500.0}

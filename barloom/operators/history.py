"""Confirmed history of strategies: equity at the end of every day, sums over what was persisted, and its integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import half_up
from barloom.operators.asof import backward
from barloom.operators.backtest import ratio, streaks

RUN = ["run_id", "symbol", "tf"]
DAY = 86_400


def day_equity(days: DataFrame, equity: DataFrame, trades: DataFrame, balance: float = 1_000_000.0) -> DataFrame:
    """``days`` (run, day) with the last equity mark by the end of the day, what of it is not realised, and the day's largest drawdowns.

    A day without marks of its own has the last one before it and no drawdown (0); one
    before all marks has nulls.  Trades closed by the end of the data are not realised.
    """
    ends = days.select(*RUN, "day", ((F.col("day") + 1) * DAY - 1).alias("__end"))
    marks = ["equity_pips", "equity_yen", "realised_yen"]
    closing = backward(ends, equity.select(*RUN, F.col("t").alias("as_of"), *marks), RUN, "__end", "as_of", marks, "").drop("__end")
    done = trades.where("exit_reason <> 'end'").select(*RUN, "exit_time", "id", "net_pips")
    order = Window.partitionBy(*RUN).orderBy("exit_time").rangeBetween(Window.unboundedPreceding, 0)
    running = done.withColumn("__pips", F.sum("net_pips").over(order)).groupBy(*RUN, "exit_time").agg(F.max_by("__pips", "id").alias("__pips"))
    realised = backward(closing, running, RUN, "as_of", "exit_time", ["__pips"], "").drop("exit_time")
    worst = equity.groupBy(*RUN, F.floor(F.col("t") / DAY).alias("day")).agg(*(F.max(f"drawdown_{x}").alias(f"max_drawdown_{x}") for x in ("pips", "yen", "pct")))
    out = realised.join(worst, [*RUN, "day"], "left")
    known = F.col("as_of").isNotNull()
    return out.select(
        *RUN, "day", "as_of", F.when(known, half_up(F.col("equity_pips") - F.coalesce("__pips", F.lit(0.0)), 1)).alias("unrealised_pips"), F.when(known, half_up(F.col("equity_yen") - balance - F.col("realised_yen"))).alias("unrealised_yen"),
        *(F.when(known, F.coalesce(f"max_drawdown_{x}", F.lit(0.0))).alias(f"max_drawdown_{x}") for x in ("pips", "yen", "pct")),
    )


def persisted_summary(trades: DataFrame, equity: DataFrame, balance: float = 1_000_000.0) -> DataFrame:
    """Per run the figures of its persisted trades; drawdowns are the larger of the realised ones and those of ``day_equity``."""
    done = trades.where("exit_reason <> 'end'")
    net, pips = F.col("net_yen"), F.col("net_pips")
    order = Window.partitionBy(*RUN).orderBy("exit_time", "id").rowsBetween(Window.unboundedPreceding, 0)
    running = done.withColumn("__y", F.sum("net_yen").over(order)).withColumn("__p", F.sum("net_pips").over(order))
    running = running.withColumn("__ty", F.greatest(F.lit(0.0), F.max("__y").over(order))).withColumn("__tp", F.greatest(F.lit(0.0), F.max("__p").over(order)))
    part = lambda x, cond: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    sums = running.groupBy(*RUN).agg(
        F.count("*").alias("trades"), F.count_if(net > 0).alias("wins"), F.count_if(net < 0).alias("losses"), part(net, net > 0).alias("gain"), part(net, net < 0).alias("loss"), part(pips, pips > 0).alias("gain_pips"), part(pips, pips < 0).alias("loss_pips"),
        F.max(F.col("__ty") - F.col("__y")).alias("__dy"), F.max(F.col("__tp") - F.col("__p")).alias("__dp"), F.max((F.col("__ty") - F.col("__y")) / (balance + F.col("__ty")) * 100).alias("__dc"),
    )
    seen = equity.groupBy(*RUN).agg(*(F.max(f"max_drawdown_{x}").alias(f"__m{x}") for x in ("pips", "yen", "pct")))
    both = sums.join(seen, RUN, "left").join(streaks(done, RUN), RUN, "left")
    most = lambda a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    win = F.when(F.col("wins") > 0, F.col("gain") / F.when(F.col("wins") > 0, F.col("wins"))).otherwise(0.0)
    lose = F.when(F.col("losses") > 0, F.col("loss") / F.when(F.col("losses") > 0, F.col("losses"))).otherwise(0.0)
    return both.select(
        *RUN, "trades", "wins", "losses", ratio(F.col("gain"), F.col("loss")).alias("profit_factor"), ratio(win, lose).alias("reward_ratio"), half_up(F.col("gain_pips") + F.col("loss_pips"), 1).alias("net_pips"), half_up(F.col("gain") + F.col("loss")).alias("net_yen"),
        half_up(most("__dp", "__mpips"), 1).alias("max_drawdown_pips"), half_up(most("__dy", "__myen")).alias("max_drawdown_yen"), most("__dc", "__mpct").alias("max_drawdown_pct"), F.coalesce("max_wins", F.lit(0)).alias("max_wins"), F.coalesce("max_losses", F.lit(0)).alias("max_losses"),
    )


def problems(history: DataFrame) -> DataFrame:
    """What is wrong with a history: one row per strategy, date and problem; none for a sound one.

    ``history`` has strategy_id, date (text), net_pips, net_yen, bars, initial_balance,
    spread_pips, fingerprint and trades (array of exit_time, exit_reason, net_pips, net_yen).
    """
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    dated = F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & day.isNotNull() & (F.date_format(day, "yyyy-MM-dd") == F.col("date"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    total = lambda name, digits: half_up(F.aggregate("trades", F.lit(0.0), lambda a, t: a + t[name]), digits)
    sound = F.forall("trades", lambda t: t["exit_time"].isNotNull() & finite(t["net_pips"]) & finite(t["net_yen"]))
    on_day = F.forall("trades", lambda t: (t["exit_reason"] != "end") & (F.date_format(F.timestamp_seconds(t["exit_time"]), "yyyy-MM-dd") == F.col("date")))
    checks = {
        "date": ~dated,
        "balance": ~(finite(F.col("initial_balance")) & (F.col("initial_balance") > 0)),
        "spread": ~(finite(F.col("spread_pips")) & (F.col("spread_pips") >= 0)),
        "fingerprint": F.col("fingerprint").isNotNull() & ~F.col("fingerprint").rlike("^[a-f0-9]{64}$"),
        "bars": F.col("bars").isNull() | (F.col("bars") < 0),
        "values": ~finite(F.col("net_pips")) | ~finite(F.col("net_yen")) | F.col("trades").isNull() | ~sound,
        "trade_day": sound & ~on_day,
        "sum": sound & ((F.col("net_pips") != total("net_pips", 1)) | (F.col("net_yen") != total("net_yen", 0))),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(True)), k) for k, x in checks.items())))
    return history.select("strategy_id", "date", F.explode(found).alias("problem"))

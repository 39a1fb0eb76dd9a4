"""Append-only daily results of simulated strategies, their roll-ups, lifecycle rules and data-quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def canonical(value: object) -> object:
    """A rule definition with the keys of all its objects in order, so that equal definitions are written alike."""
    if isinstance(value, dict):
        return {k: canonical(value[k]) for k in sorted(value)}
    return [canonical(x) for x in value] if isinstance(value, (list, tuple)) else value


def fingerprint(rows: DataFrame, fields: list[str], rules: str = "rules") -> Column:
    """SHA-256 of the canonical JSON of ``fields`` of a row; ``rules`` holds JSON text that is already canonical."""
    parts = []
    for f in sorted([*fields, rules]):
        value = F.col(f) if f == rules else F.get_json_object(F.to_json(F.struct(F.col(f).alias("x"))), "$.x")
        if f != rules and rows.schema[f].dataType.typeName() == "string":
            value = F.regexp_extract(F.to_json(F.struct(F.col(f).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
        parts.append(F.concat(F.lit(f'"{f}":'), F.coalesce(value, F.lit("null"))))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def confirmed_days(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """(run_id, symbol, tf, day, trades, net_pips, net_yen) for every closed UTC day of a series.

    The newest day is still forming and is left out, as are trades that only the end of
    the data closed; days without trades have zeros; days without bars do not appear.
    """
    days = bars.select("symbol", "tf", F.floor(F.col("t") / DAY).alias("day")).distinct()
    newest = days.groupBy("symbol", "tf").agg(F.max("day").alias("newest"))
    spine = days.join(newest, ["symbol", "tf"]).where("day < newest").drop("newest")
    done = trades.where("exit_reason <> 'end'").groupBy("run_id", "symbol", "tf", F.floor(F.col("exit_time") / DAY).alias("day")).agg(F.count("*").alias("trades"), F.sum("net_pips").alias("net_pips"), F.sum("net_yen").alias("net_yen"))
    ids = trades.select("run_id", "symbol", "tf").distinct()
    return ids.join(spine, ["symbol", "tf"]).join(done, ["run_id", "symbol", "tf", "day"], "left").fillna(0, ["trades", "net_pips", "net_yen"]).select("run_id", "symbol", "tf", "day", "trades", "net_pips", "net_yen")


def merged(existing: DataFrame, candidate: DataFrame, keys: list[str], day: str = "day", mark: str = "fingerprint") -> DataFrame:
    """Upsert where confirmed days win: new days are inserted, known days stay as first recorded.

    A changed ``mark`` of a key (another rule definition) replaces all of its days.
    """
    marks = candidate.groupBy(*keys).agg(F.max(mark).alias("__new"))
    kept = existing.join(marks, keys, "left").where(F.col("__new").isNull() | (F.col(mark) == F.col("__new"))).drop("__new")
    return kept.unionByName(candidate.join(kept.select(*keys, day), [*keys, day], "left_anti"))


def equity(days: DataFrame, balance: float = 1_000_000.0) -> DataFrame:
    """Running result, balance and drawdown from the running peak per strategy, over its days."""
    w = Window.partitionBy("run_id", "symbol", "tf").orderBy("day")
    out = days.withColumn("cum_yen", F.sum("net_yen").over(w)).withColumn("cum_pips", F.sum("net_pips").over(w))
    out = out.withColumn("balance", balance + F.col("cum_yen"))
    return out.withColumn("peak", F.greatest(F.lit(balance), F.max("balance").over(w))).withColumn("drawdown_yen", F.col("peak") - F.col("balance"))


def monthly(days: DataFrame) -> DataFrame:
    """Totals per month and per month and strategy (grouping sets), with distinct days and whether the month is closed."""
    month = F.date_format(F.to_date(F.from_unixtime(F.col("day") * DAY)), "yyyy-MM")
    rows = days.withColumn("month", month)
    out = rows.groupingSets([[F.col("month")], [F.col("month"), F.col("run_id")]], F.col("month"), F.col("run_id")).agg(
        F.sum("net_yen").alias("net_yen"), F.sum("net_pips").alias("net_pips"), F.sum("trades").alias("trades"), F.countDistinct("day").alias("days")
    )
    newest = rows.agg(F.max("month").alias("newest"))
    return out.crossJoin(F.broadcast(newest)).withColumn("complete", F.col("month") < F.col("newest")).drop("newest")


def retirement(trades: Column, days: Column, profit_factor: Column, net: Column) -> Column:
    """Lifecycle: retire on a poor factor after 20 trades or a loss after 45 days, probation under factor 1, else active."""
    return (
        F.when((trades >= 20) & (profit_factor < 0.9), "retire_factor").when((days >= 45) & (trades >= 10) & (net < 0), "retire_loss").when((trades >= 10) & (profit_factor < 1), "probation").otherwise("active")
    )


def status(trades: Column, profit_factor: Column) -> Column:
    """Display label of a strategy in its forward test."""
    return F.when(trades < 10, "collecting").when(profit_factor >= 1.1, "good").when(profit_factor < 0.9, "poor").otherwise("watch")


def strategy_report(days: DataFrame, trades: DataFrame) -> DataFrame:
    """Per strategy: trades, days, net, profit factor, lifecycle and status."""
    from barloom.operators.backtest import ratio

    net = F.col("net_yen")
    done = trades.where("exit_reason <> 'end'").groupBy("run_id", "symbol", "tf").agg(F.count("*").alias("trades"), F.sum(F.when(net > 0, net).otherwise(0.0)).alias("gain"), F.sum(F.when(net < 0, net).otherwise(0.0)).alias("loss"))
    span = days.groupBy("run_id", "symbol", "tf").agg(F.count("*").alias("days"), F.sum("net_yen").alias("net_yen"))
    both = span.join(done, ["run_id", "symbol", "tf"], "left").fillna(0, ["trades", "gain", "loss"]).withColumn("profit_factor", ratio(F.col("gain"), F.col("loss")))
    return both.withColumn("lifecycle", retirement(F.col("trades"), F.col("days"), F.col("profit_factor"), F.col("net_yen"))).withColumn("status", status(F.col("trades"), F.col("profit_factor")))


def integrity(days: DataFrame, trades: DataFrame) -> DataFrame:
    """Days whose recorded result is not the sum of their trades."""
    sums = trades.where("exit_reason <> 'end'").groupBy("run_id", "symbol", "tf", F.floor(F.col("exit_time") / DAY).alias("day")).agg(F.sum("net_yen").alias("traded"))
    both = days.join(sums, ["run_id", "symbol", "tf", "day"], "left")
    return both.where(F.abs(F.col("net_yen") - F.coalesce("traded", F.lit(0.0))) > 0.5)


def freshness(bars: DataFrame, now: int, stale_hours: int = 96, lag_hours: int = 3) -> DataFrame:
    """Per series its newest bar, age, lag behind its timeframe's newest, and verdict (fail, warn, ok)."""
    latest = bars.groupBy("symbol", "tf").agg(F.max("t").alias("latest"))
    peers = Window.partitionBy("tf")
    out = latest.withColumn("age_hours", (now - F.col("latest")) / 3600.0).withColumn("lag_hours", (F.max("latest").over(peers) - F.col("latest")) / 3600.0)
    return out.withColumn("verdict", F.when(F.col("age_hours") > stale_hours, "fail").when(F.col("lag_hours") >= lag_hours, "warn").otherwise("ok"))


def health(sources: DataFrame, now: int, fail_hours: int = 120, warn_hours: int = 6) -> DataFrame:
    """Verdict per source from its last success and whether the primary feed served it."""
    age = (now - F.col("last_success")) / 3600.0
    return sources.withColumn("verdict", F.when(F.col("last_success").isNull() | (age > fail_hours), "fail").when(~F.col("primary_ok") | (age > warn_hours), "warn").otherwise("ok"))


def conflicts(active: DataFrame, retired: DataFrame, keys: list[str]) -> DataFrame:
    """Generations that are both active and retired; must be empty."""
    return active.join(retired, keys, "left_semi")


def latest_entry(entries: DataFrame) -> DataFrame:
    """The newest generation of every strategy in a ledger (registered_at, then retired_at)."""
    row = F.struct(*(c for c in entries.columns if c != "strategy_id"))
    return entries.groupBy("strategy_id").agg(F.max_by(row, F.struct("registered_at", "retired_at")).alias("x")).select("strategy_id", "x.*")

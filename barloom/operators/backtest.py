"""Bar-by-bar trade simulation and its metrics.

Signals are computed once as columns; runs (strategy x parameters) are rows of a
table.  A chunk of runs streams the bars of a series in time order, its states as
vectors.  Rules, in the order they are applied on a bar:

1. a position whose opposite signal fired on the previous bar closes at the open;
2. a pending entry opens at the open if the session allows that bar, else lapses;
3. stop before target, also on the entry bar; a bar that opens beyond the stop
   fills at the open;
4. without an exit the trailing stop follows the bar's extreme, from the next bar on;
5. equity is marked at the bar's worst price less the spread;
6. an opposite signal marks the position for closing, otherwise a flat run takes
   the first of its directions that signals; neither on the last bar;
7. a position open at the end closes at the last close.

Profits accumulate in rounded units: pips to 0.1, money to 1, half upwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.fleet import Fleet
from barloom.sources.bars import KEY

#: Runs that are stepped together, and rows that are held before they are passed on.
CHUNK, FLUSH = 256, 50_000
#: One run: stops in pips; mode is fixedLot, compound or fixedRisk; directions in order of preference.
RUN = (
    "run_id string, stop_pips double, target_pips double, trailing_pips double, close_on_opposite boolean, directions string, "
    "session_start string, session_end string, session_offset int, mode string, balance double, fixed_lot double, risk_pct double, max_lot double, spread_pips double"
)
TRADE = (
    "run_id string, symbol string, tf string, kind string, id long, direction string, entry_time long, exit_time long, entry_price double, exit_price double, gross_pips double, "
    "spread_pips double, net_pips double, lot double, pip_value double, gross_yen double, spread_yen double, net_yen double, balance_after double, exit_reason string, "
    "equity_pips double, drawdown_pips double, equity_yen double, drawdown_yen double, drawdown_pct double, realised_yen double"
)


def half_up(x: float, digits: int = 0) -> float:
    k = 10**digits
    return math.floor(x * k + 0.5) / k


def simulate(signals: DataFrame, runs: DataFrame, pip: float | None = None, equity: bool = True) -> DataFrame:
    """Trades and equity marks (``TRADE``) of every run over every series of ``signals``.

    ``signals`` has bars with long, short and optionally pip_value and run_key;
    ``runs`` has the columns of ``RUN`` (and run_key where signals have it, which then
    ties runs to signal sets).  Without ``equity`` a run has one row of kind "worst" in
    place of its marks, with its largest drawdowns.

    Runs of a key are dealt into chunks of at most about ``CHUNK``.  A chunk's runs and the
    bars of one series meet in one sorted stream, runs first, and are stepped as vectors
    (``fleet``): bars are shuffled once per series and chunk, not once per run.
    """
    newest = Window.partitionBy(*KEY, *(["run_key"] if "run_key" in signals.columns else [])).orderBy("t")
    bars = signals.withColumn("last", F.lead("t").over(newest).isNull())
    if "pip_value" not in bars.columns:
        bars = bars.withColumn("pip_value", F.lit(1000.0))
    bars = bars.withColumn("pip", F.lit(pip) if pip else F.when(F.col("symbol").endswith("JPY"), 0.01).otherwise(0.0001))
    if "run_key" not in signals.columns:
        bars, runs = bars.withColumn("run_key", F.lit("")), runs.withColumn("run_key", F.lit(""))
    sizes = runs.groupBy("run_key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    names = [x.strip().split(" ")[0] for x in RUN.split(",")]
    chunk = F.pmod(F.xxhash64("run_id"), F.col("chunks")).cast("int").alias("chunk")
    dealt = runs.join(sizes, "run_key").select("run_key", chunk, F.struct(*names).alias("run"))
    series_of = bars.select("run_key", *KEY).distinct()
    keys = ["run_key", "chunk", *KEY]
    fields = ["o", "h", "l", "c", "long", "short", "last", "pip_value", "pip"]
    each = bars.select("run_key", *KEY, "t", *fields).join(dealt.select("run_key", "chunk").distinct(), "run_key")
    heads = dealt.join(series_of, "run_key")
    none = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    heads = heads.select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t"), *(none(bars, x) for x in fields), "run")
    rows = heads.unionByName(each.select(*keys, F.lit(1).alias("kind"), "t", *fields, none(heads, "run")))
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in TRADE.split(","))])
    order = [*keys, "kind", "t", *fields, "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given, state = None, [], None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(order) - 1)]
            packed = batch.column(len(order) - 1)
            for k, row in enumerate(zip(*columns, strict=True)):
                if row[:4] != now:
                    if state:
                        yield from state.rows(schema)
                    now, given, state = row[:4], [], None
                if row[4] == 0:
                    given.append(packed[k].as_py())
                    continue
                if state is None:
                    state = Fleet(given, *now[2:], row[14], equity)
                state.bar(*row[5:14])
                if state.pending_rows > FLUSH:
                    yield from state.rows(schema)
        if state:
            yield from state.rows(schema)

    return rows.select(*order).repartition(*keys).sortWithinPartitions(*keys, "kind", "t").mapInArrow(run, TRADE)


def trades_of(simulated: DataFrame) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in TRADE.split(",")]
    return simulated.where("kind = 'trade'").select("run_id", *KEY, *(n for n in names[4:20]))


def equity_of(simulated: DataFrame) -> DataFrame:
    return simulated.where("kind = 'equity'").select("run_id", *KEY, F.col("exit_time").alias("t"), "equity_pips", "drawdown_pips", "equity_yen", "realised_yen", "drawdown_yen", "drawdown_pct")


def streaks(trades: DataFrame, by: list[str]) -> DataFrame:
    """Longest runs of winning and of losing trades per ``by``: islands of equal sign."""
    order = Window.partitionBy(*by).orderBy("id")
    sign = trades.withColumn("s", F.signum("net_yen")).withColumn("new", F.coalesce((F.col("s") != F.lag("s").over(order)).cast("int"), F.lit(1)))
    runs = sign.withColumn("island", F.sum("new").over(order)).groupBy(*by, "island", "s").agg(F.count("*").alias("n"))
    most = lambda s: F.coalesce(F.max(F.when(F.col("s") == s, F.col("n"))), F.lit(0))
    return runs.groupBy(*by).agg(most(1).alias("max_wins"), most(-1).alias("max_losses"))


def ratio(gain, loss):
    """Gain over loss; infinite without losses but with gains, 0 without either."""
    return F.when(loss == 0, F.when(gain > 0, float("inf")).otherwise(0.0)).otherwise(gain / F.abs(F.when(loss != 0, loss)))


def metrics(simulated: DataFrame, by: tuple[str, ...] = ("run_id", *KEY)) -> DataFrame:
    """One row per run and series: counts, win rate, profit factor, reward ratio, sums, means, drawdowns, streaks."""
    trade, net = F.col("kind") == "trade", F.col("net_yen")
    total = lambda x, cond: F.coalesce(F.sum(F.when(trade & cond, F.col(x))), F.lit(0.0))
    out = simulated.groupBy(*by).agg(
        F.count_if(trade).alias("trades"), F.count_if(trade & (net > 0)).alias("wins"), F.count_if(trade & (net < 0)).alias("losses"),
        total("net_yen", F.lit(True)).alias("net_yen"), total("net_pips", F.lit(True)).alias("net_pips"), total("net_yen", net > 0).alias("gross_profit_yen"), total("net_yen", net < 0).alias("gross_loss_yen"),
        F.coalesce(F.max("drawdown_yen"), F.lit(0.0)).alias("max_drawdown_yen"), F.coalesce(F.max("drawdown_pips"), F.lit(0.0)).alias("max_drawdown_pips"), F.coalesce(F.max("drawdown_pct"), F.lit(0.0)).alias("max_drawdown_pct"),
    )
    mean_win, mean_loss = F.when(F.col("wins") > 0, F.try_divide(F.col("gross_profit_yen"), F.col("wins"))).otherwise(0.0), F.when(F.col("losses") > 0, F.try_divide(F.col("gross_loss_yen"), F.col("losses"))).otherwise(0.0)
    out = out.withColumn("win_rate", F.when(F.col("trades") > 0, F.try_divide(F.col("wins") * 100.0, F.col("trades"))).otherwise(0.0)).withColumn("__w", mean_win).withColumn("__l", mean_loss)
    out = out.withColumn("profit_factor", ratio(F.col("gross_profit_yen"), F.col("gross_loss_yen"))).withColumn("reward_ratio", ratio(F.col("__w"), F.col("__l")))
    runs = streaks(simulated.where("kind = 'trade'"), list(by))
    joined = out.join(runs, list(by), "left").fillna(0, ["max_wins", "max_losses"])
    return joined.withColumn("average_win_yen", F.floor(F.col("__w") + 0.5)).withColumn("average_loss_yen", F.floor(F.col("__l") + 0.5)).withColumn("net_pips", F.floor(F.col("net_pips") * 10 + 0.5) / 10).drop("__w", "__l")

"""Stored results read back: what is absent is None, not an error; what does not fit its form is told apart.

Reports live in a ``Store`` (several that change together) or in JSON files of one record
a line, read with the columns they must have.  A row that lacks one of its needed values, or does not parse, is
left out and counted by ``misfits``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.sources.files import Files

#: Forms: columns, and those a record needs.
FORMS = {
    "bars": ("symbol string, tf string, t long, o double, h double, l double, c double, v double", ("symbol", "tf", "t", "o", "h", "l", "c")),
    "adaptive": ("symbol string, tf string, horizon int, w_signal double, w_drift double, w_regime double, accuracy double, samples long", ("symbol", "tf", "horizon")),
    "scanner": ("cell string, name string, n long, wins long, losses long, draws long, mean_r double, ewa_win_rate double", ("cell", "name", "n")),
    "forward": ("strategy_id string, registered_at long, status string, reason string, trades long, net_yen double, profit_factor double, confirmed_days long", ("strategy_id", "registered_at", "trades")),
    "retired": ("ledger_key string, strategy_id string, registered_at long, retired_at string, reason string, trades long, net_yen double, profit_factor double", ("strategy_id", "retired_at", "reason")),
    "calendar": ("title string, currency string, time long, impact string", ("title", "currency", "time")),
    "cot": ("currency string, date long, oi double, noncomm_net double", ("currency", "date")),
}


@dataclass(frozen=True)
class Loaded:
    """Fitting rows of a file, and how many others it has."""

    rows: DataFrame
    misfits: DataFrame


def load(spark: SparkSession, path: str, form: str) -> Loaded | None:
    """Records of a file or folder in one of ``FORMS``; None where it is absent."""
    if not Files(spark, path).exists(""):
        return None
    schema, needed = FORMS[form]
    read = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    fits = F.col("_corrupt").isNull()
    for name in needed:
        fits = fits & F.col(name).isNotNull()
    told = read.withColumn("__fits", fits)
    return Loaded(told.where("__fits").drop("__fits", "_corrupt"), told.agg(F.count_if(~F.col("__fits")).alias("misfits"), F.count("*").alias("records")))


def generation(rows: DataFrame) -> Column:
    """Registration second of a ledger row: its own, else the one in its key."""
    in_key = F.regexp_extract("ledger_key", r"@([0-9]+)$", 1).try_cast("long") if "ledger_key" in rows.columns else F.lit(None).cast("long")
    return F.coalesce("registered_at", in_key)


def retired(loaded: Loaded | None, spark: SparkSession) -> DataFrame:
    """One row per strategy and generation, the first in order of key; no rows where the ledger is absent."""
    if loaded is None:
        return spark.createDataFrame([], FORMS["retired"][0])
    rows = loaded.rows.withColumn("registered_at", generation(loaded.rows))
    first = Window.partitionBy("strategy_id", "registered_at").orderBy("ledger_key", "retired_at")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def forward(loaded: Loaded | None, spark: SparkSession) -> DataFrame:
    """Newest generation of every strategy of the forward results; a missing one is refused, as nothing can be shown without it."""
    if loaded is None:
        raise FileNotFoundError("forward results are missing")
    newest = Window.partitionBy("strategy_id").orderBy(F.desc("registered_at"), F.desc("trades"))
    return loaded.rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def observations(results: Loaded | None, history: DataFrame | None) -> DataFrame | None:
    """Observed strategies with the days of their history; None without results.

    ``history`` (strategy_id, day) may be absent: then the results' own count of days stands,
    as it does for a strategy that the history does not know.
    """
    if results is None:
        return None
    rows = results.rows.withColumn("history_available", F.lit(history is not None))
    if history is None:
        return rows.withColumn("history_days", F.coalesce("confirmed_days", F.lit(0)))
    days = history.groupBy("strategy_id").agg(F.countDistinct("day").alias("__days"))
    return rows.join(days, "strategy_id", "left").withColumn("history_days", F.coalesce("__days", "confirmed_days", F.lit(0))).drop("__days")

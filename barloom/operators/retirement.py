"""Retiring a strategy as a transaction over files: definition, archive and ledger.

``<lane>/<id>.json`` is an active definition, ``<lane>/retired/<id>@<registered_at>.json`` an
archived one, ``<lane>/ledger/<id>@<registered_at>.json`` its ledger entry.  Under a lock, a
record of what is about to happen is written first; then the definition moves, the
entry is written, and the record goes.  A process that dies at any point leaves a record,
and whoever comes next finishes the work from it.  An error that is caught moves the
definition back.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.files import Files, Lock

LANES = ("adopted", "observed")
_RECORD, _LOCK = "retiring.json", "retiring.lock"


class Retirement:
    """Retirements below ``root``; ``step`` is told after every step (tests stop it there)."""

    def __init__(self, spark: SparkSession, root: str, step: Callable[[str], None] = lambda name: None, patience: float = 10.0, stale: float = 60.0):
        self.spark, self.files, self.step = spark, Files(spark, root), step
        self.patience, self.stale = patience, stale

    # -- names --------------------------------------------------------------------

    @staticmethod
    def _checked(strategy_id: str, reason: str, retired_at: str, lane: str) -> None:
        if lane not in LANES:
            raise ValueError(f"no such lane: {lane}")
        if not strategy_id.strip() or "/" in strategy_id or "@" in strategy_id or not reason.strip():
            raise ValueError("an id without / and @ and a reason are needed")
        datetime.fromisoformat(retired_at)

    def _entries(self, strategy_id: str, lane: str) -> list[str]:
        return [n for n in self.files.names(f"{lane}/ledger") if n.startswith(f"{strategy_id}@") and n.endswith(".json")]

    # -- the transaction ------------------------------------------------------------

    def recover(self) -> dict | None:
        """Finish what a process that died has begun; its record, or None."""
        with self._lock():
            return self._recovered()

    def _lock(self) -> Lock:
        return Lock(self.files, _LOCK, self.patience, self.stale)

    def _recovered(self) -> dict | None:
        if not self.files.exists(_RECORD):
            return None
        record = self.files.read_json(_RECORD)
        self._finish(record)
        return record

    def _finish(self, record: dict) -> None:
        """Every step from the record on; each is left out where it is done already."""
        source, archive, entry = record["source"], record["archive"], record["entry_file"]
        if not self.files.exists(archive):
            self.files.move(source, archive)
        self.step("moved")
        if not self.files.exists(entry) and not self.files.create(entry, json.dumps(record["entry"], sort_keys=True)):
            raise FileExistsError(entry)
        self.step("entered")
        self.files.remove(_RECORD)
        self.step("cleared")

    def retire(self, strategy_id: str, reason: str, retired_at: str, snapshots: DataFrame, lane: str = "adopted") -> dict:
        """Retire the active generation of a strategy with its row of ``snapshots`` (``lifecycle.final_snapshots``).

        Returns the ledger entry with ``already``: True where that generation was retired
        before, which changes nothing.  Refused: unknown strategies, ones without a
        snapshot of that generation, archives without an entry.
        """
        self._checked(strategy_id, reason, retired_at, lane)
        with self._lock():
            self._recovered()
            source = f"{lane}/{strategy_id}.json"
            if not self.files.exists(source):
                return self._retired_before(strategy_id, lane)
            registered_at = int(self.files.read_json(source)["registered_at"])
            key = f"{strategy_id}@{registered_at}"
            archive, entry_file = f"{lane}/retired/{key}.json", f"{lane}/ledger/{key}.json"
            if self.files.exists(entry_file):
                return self.files.read_json(entry_file) | {"already": True}
            if self.files.exists(archive):
                raise ValueError(f"{archive} is archived without a ledger entry")
            rows = snapshots.where((snapshots.run_id == strategy_id) & (snapshots.registered_at == registered_at)).limit(2).collect()
            if len(rows) != 1:
                raise ValueError(f"{key}: {len(rows)} snapshots of this generation")
            snapshot = {k: v for k, v in rows[0].asDict().items() if k not in ("run_id", "registered_at")}
            entry = {"strategy_id": strategy_id, "registered_at": registered_at, "reason": reason.strip(), "retired_at": retired_at, "snapshot": snapshot}
            record = {"source": source, "archive": archive, "entry_file": entry_file, "entry": entry}
            if not self.files.create(_RECORD, json.dumps(record, sort_keys=True)):
                raise FileExistsError(_RECORD)
            self.step("recorded")
            try:
                self._finish(record)
            except Exception:
                if self.files.exists(archive) and not self.files.exists(source) and not self.files.exists(entry_file):
                    self.files.move(archive, source)
                if not self.files.exists(entry_file):
                    self.files.remove(_RECORD)
                raise
            return entry | {"already": False}

    def _retired_before(self, strategy_id: str, lane: str) -> dict:
        entries = self._entries(strategy_id, lane)
        if not entries:
            raise FileNotFoundError(f"{lane}/{strategy_id}.json")
        newest = max(entries, key=lambda n: int(n.removesuffix(".json").rsplit("@", 1)[1]))
        if not self.files.exists(f"{lane}/retired/{newest}"):
            raise ValueError(f"{newest} has a ledger entry but no archive")
        return self.files.read_json(f"{lane}/ledger/{newest}") | {"already": True}

    def ledger(self, lane: str = "adopted") -> DataFrame:
        """Entries of a lane: strategy_id, registered_at, reason, retired_at and the snapshot's values."""
        schema = "strategy_id string, registered_at long, reason string, retired_at string, snapshot struct<trades:long, profit_factor:double, net_yen:double, first_day:long, last_day:long, days:long>"
        if not self.files.names(f"{lane}/ledger"):
            return self.spark.createDataFrame([], schema).select("*", "snapshot.*").drop("snapshot")
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.files.root}/{lane}/ledger").select("*", "snapshot.*").drop("snapshot")

"""Reports that change together: versioned folders and one manifest swapped by rename.

Tables of a version are written into a folder of their own; then a manifest with the next
number names them all.  Readers take the manifest of the highest number, so they see all
tables of a version or none, also when a writer dies between two of them.  Of two writers
that race for a number, one gets it and the other starts from the newer version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.files import Files

_MANIFESTS, _VERSIONS = "manifests", "versions"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def versions(self) -> list[int]:
        """Numbers of finished versions, ascending."""
        return [int(n.removesuffix(".json")) for n in self.files.names(_MANIFESTS) if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Folders of the tables of a version (the newest one by default); empty before the first."""
        known = self.versions()
        if not known:
            return {}
        return self.files.read_json(f"{_MANIFESTS}/{known[-1] if version is None else version:020d}.json")

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table of a version; None (absent) where that version has no such table."""
        folder = self.manifest(version).get(name)
        return None if folder is None else self.spark.read.parquet(f"{self.files.root}/{folder}")

    def publish(self, tables: dict[str, DataFrame], step: Callable[[str], None] = lambda name: None) -> int:
        """Replace the given tables, keep the others; the new version's number.  ``step`` is told of every finished table."""
        folder = f"{_VERSIONS}/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.files.root}/{folder}/{name}")
            step(name)
        while True:
            known = self.versions()
            after = self.manifest() | {name: f"{folder}/{name}" for name in tables}
            number = (known[-1] if known else 0) + 1
            if self.files.create(f"{_MANIFESTS}/{number:020d}.json", json.dumps(after, sort_keys=True)):
                return number

    def vacuum(self, keep: int = 2) -> int:
        """Remove all but the newest versions and what only they or unfinished writers hold; the number of folders removed."""
        for old in self.versions()[:-keep]:
            self.files.remove(f"{_MANIFESTS}/{old:020d}.json")
        used = {folder.split("/")[1] for v in self.versions() for folder in self.manifest(v).values()}
        unused = [n for n in self.files.names(_VERSIONS) if n not in used]
        for name in unused:
            self.files.remove(f"{_VERSIONS}/{name}")
        return len(unused)

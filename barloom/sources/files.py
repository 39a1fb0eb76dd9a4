"""Small files on any file system that Spark reaches: whole-file writes, renames, locks.

Everything goes through the Hadoop file system of a path, so the same code serves local
disks, HDFS and others.  A file appears under its name at once or not at all.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    """The file system below ``root``; names are relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str = "") -> list[str]:
        where = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def age(self, name: str) -> float:
        """Seconds since the file was written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does (HDFS checks that with the rename, local disks just before it)."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(temporary), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not self.exists(name) and self.fs.rename(self.path(temporary), self.path(name)):
            return True
        self.remove(temporary)
        return False

    def move(self, name: str, to: str) -> None:
        """Rename; refuses to overwrite."""
        if self.exists(to):
            raise FileExistsError(f"{self.root}/{to}")
        self.fs.mkdirs(self.path(to).getParent())
        if not self.fs.rename(self.path(name), self.path(to)):
            raise FileNotFoundError(f"{self.root}/{name}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Lock:
    """A lock file with owner and expiry, as a context; a lock older than ``stale`` seconds is taken over."""

    def __init__(self, files: Files, name: str, patience: float = 10.0, stale: float = 60.0):
        self.files, self.name, self.patience, self.stale = files, name, patience, stale
        self.owner = uuid.uuid4().hex

    def __enter__(self) -> Lock:
        until = time.time() + self.patience
        while not self.files.create(self.name, json.dumps({"owner": self.owner, "at": time.time()})):
            try:
                held = self.files.read_json(self.name)
            except Exception:  # released, or half written by a process that died
                held = None
            if held is None or time.time() - held["at"] >= self.stale:
                if held is not None or (self.files.exists(self.name) and self.files.age(self.name) >= self.stale):
                    self.files.remove(self.name)
                continue
            if time.time() >= until:
                raise TimeoutError(f"{self.files.root}/{self.name} is held by {held['owner']}")
            time.sleep(0.02)
        return self

    def __exit__(self, *failure) -> None:
        try:
            if self.files.read_json(self.name)["owner"] == self.owner:
                self.files.remove(self.name)
        except Exception:  # taken over after it expired
            return

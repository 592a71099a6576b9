"""Atomic commits on any Hadoop file system: numbered JSON manifests, each made visible by one rename.

Data files are written first, under names no manifest mentions; a reader only follows the newest manifest. So a job that
dies leaves nothing visible, and of two writers that race for a number one fails with ``CommitConflict``.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from typing import Any

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._dir = self._path(f"{self.root}/_manifests")
        self._fs = self._dir.getFileSystem(self._conf)

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._dir):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._dir))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def age(self, version: int) -> float:
        """Seconds since a version was committed."""
        return time.time() - self._fs.getFileStatus(self._path(f"{self.root}/_manifests/{version}.json")).getModificationTime() / 1000

    def read(self, version: int | None = None) -> dict[str, Any] | None:
        """The manifest of a version (default: the newest); None if nothing was committed yet."""
        version = version if version is not None else next(reversed(self.versions()), None)
        if version is None:
            return None
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict[str, Any]) -> None:
        self._fs.mkdirs(self._dir)
        final, draft = self._path(f"{self.root}/_manifests/{version}.json"), self._path(f"{self.root}/_manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content | {"version": version}).encode()))
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE  # never overwrites
        if self._fs.exists(final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version} of {self.root} exists")
        context = fs.FileContext.getFileContext(final.getFileSystem(self._conf).getUri(), self._conf)
        try:
            context.rename(draft, final, options)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise CommitConflict(f"version {version} of {self.root} exists") from e
            raise

    def delete(self, below: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{below}"), True)

    def exists(self, below: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.root}/{below}".rstrip("/")))

    def children(self, below: str) -> list[str]:
        p = self._path(f"{self.root}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

"""Versions of a folder: immutable files under names of their own, and one small document a version that names them.

Files are written first, whole, under new names; a version begins to exist when its document is moved into place, in
one step, at the end. So a writer that is lost at any point leaves the last version as it was, and files that no
version names, which `vacuum` removes. A reader holds on to the version it opened: later ones never change its files.
One writer at a time: a version that another writer has meanwhile put in place is an error, not an overwrite.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def fresh(self, kind: str) -> str:
        """A new name for files of a kind."""
        return f"{kind}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.folder}/files/{name}"

    def _children(self, name: str) -> list[str]:
        path = self._path(f"{self.folder}/{name}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def all(self) -> list[int]:
        return [int(n) for n in self._children("versions") if n.isdigit()]

    def latest(self) -> int:
        """The last version; 0 if there is none."""
        return max(self.all(), default=0)

    def read(self, version: int | None = None) -> dict:
        """A version's document, by default the last one's; empty for version 0."""
        version = self.latest() if version is None else version
        if not version:
            return {}
        path = f"{self.folder}/versions/{version:010d}"
        return json.loads(self.spark.read.text(path, wholetext=True).first()["value"])

    def commit(self, version: int, document: dict, files: list[str]) -> int:
        """Put a version in place; `files` are the names that it needs."""
        final = self._path(f"{self.folder}/versions/{version:010d}")
        draft = self._path(f"{self.folder}/versions/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(document | {"version": version, "files": sorted(files)}, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise FileExistsError(f"version {version} of {self.folder} is there already")
        return version

    def vacuum(self, keep: int = 1) -> list[str]:
        """Remove all but the last `keep` versions, and the files that these don't name; gives the files' names."""
        every = self.all()
        kept = every[-keep:]
        named = {name for v in kept for name in self.read(v)["files"]}
        for v in every[:-keep]:
            self._fs.delete(self._path(f"{self.folder}/versions/{v:010d}"), False)
        gone = [name for name in self._children("files") if name not in named]
        for name in gone:
            self._fs.delete(self._path(self.at(name)), True)
        return gone

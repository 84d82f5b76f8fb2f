"""Versioned bundles (S9): immutable data, numbered manifests, optimistic updates.

A version's files go to a folder of their own and are never touched again. It becomes a version when
a manifest with the next number is created, which succeeds only if that number is still free;
whoever comes second reads the new state, applies the change to it and tries the next number. A
reader takes the highest manifest that is complete, so an update that dies half way is never seen.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Bundles:
    """Versions under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, n: int) -> str:
        return f"{self.root}/manifests/{n:012d}.json"

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def _read(self, n: int) -> dict | None:
        """The manifest, None if whoever made it did not finish."""
        stream = self._fs.open(self._path(self._manifest(n)))
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if found.get("complete") else None

    def _create(self, n: int, manifest: dict) -> bool:
        """Create manifest ``n``; False if the number is taken."""
        path = self._path(self._manifest(n))
        self._fs.mkdirs(path.getParent())
        if self._fs.getUri().getScheme() == "file":
            # Hadoop's local create looks first and creates then; a link takes the name and the content at once.
            name = path.toUri().getPath()
            whole = f"{name}.{uuid.uuid4().hex}"
            with open(whole, "w", encoding="utf-8") as f:
                json.dump(manifest, f)
            try:
                os.link(whole, name)
            except FileExistsError:
                return False
            finally:
                os.remove(whole)
            return True
        try:
            stream = self._fs.create(path, False)
        except Exception as e:  # Py4J wraps the file system's own error
            if "exist" in str(e).lower():
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(manifest).encode("utf-8")))
        finally:
            stream.close()
        return True

    def latest(self) -> dict | None:
        """The newest complete version: {"version", "data", "config"}; None without one."""
        for n in reversed(self._numbers()):
            found = self._read(n)
            if found:
                return found
        return None

    def update(self, change: Callable[[dict], dict], write: Callable[[str], None] | None = None, tries: int = 100) -> dict:
        """A new version: ``change`` maps the newest version's config ({} at first) to the new one;
        ``write`` writes new files into the folder it is given, without it the version keeps
        the data of the one before. If ``write`` fails there is no new version."""
        data = None
        if write is not None:
            data = f"{self.root}/data/{uuid.uuid4().hex}"
            write(data)
        for _ in range(tries):
            now = self.latest()
            taken = self._numbers()
            manifest = {"version": (taken[-1] if taken else 0) + 1, "data": data or (now or {}).get("data"),
                        "config": change(dict((now or {}).get("config", {}))), "complete": True}
            if self._create(manifest["version"], manifest):
                return manifest
        raise RuntimeError(f"no free version after {tries} tries")

"""The files of a database: version folders of Parquet, and numbered manifests.

A manifest is written under another name and renamed to a number that no file has yet, so
no store has to replace a file; the newest one that is whole counts, and a writer that
dies in between leaves the one before.  A lock file keeps writers of other processes out.

Paths go through Hadoop's file systems, so a database can lie in any store that the
cluster reads.
"""

from __future__ import annotations

import json
import os
import re
import socket
import tempfile
import uuid

from pyspark.sql import SparkSession

from tessella.errors import IoError


LOCK, MANIFEST = "writer.lock", re.compile(r"manifest-(\d+)\.json")
#: Manifests that stay besides the newest.
KEPT = 1


class Store:
    """A folder with numbered manifests and one folder of data files for each write."""

    #: Folders that are open in this process: path -> number of readers, or -1 for a writer.
    _open: dict[str, int] = {}

    def __init__(self, spark: SparkSession, path: str | None, *, read_only: bool = False):
        self.spark, self.read_only, self.temporary = spark, read_only, path is None
        if path is None:  # in memory for the caller; its files go with the handle
            shared = spark.conf.get("spark.checkpoint.dir", None)
            path = f"{shared.rstrip('/')}/tessella-{uuid.uuid4().hex}" if shared else "file://" + tempfile.mkdtemp(prefix="tessella-")
        self.path = path if "://" in path or path.startswith("file:") else "file://" + path
        held = Store._open.get(self.path, 0)
        if held < 0 or held > 0 and not read_only:
            raise IoError(f"database {path} is in use")
        self.number, self.locked = 0, False
        if not self.temporary:
            self._lock()
        Store._open[self.path] = held + 1 if read_only else -1
        self.closed = False

    def _lock(self) -> None:
        """Refuse a folder that a live process writes to; a writer leaves its name there."""
        fs, where = self._hadoop(f"{self.path}/{LOCK}")
        if fs.exists(where):
            host, _, pid = self._read(fs, where).partition(" ")
            if host != socket.gethostname() or pid.isdigit() and int(pid) != os.getpid() and os.path.exists(f"/proc/{pid}"):
                raise IoError(f"database {self.path} is in use by process {pid} on {host}")
            if not self.read_only:
                fs.delete(where, False)  # its process has ended
        if not self.read_only:
            if not fs.createNewFile(where):
                raise IoError(f"database {self.path} is in use")
            stream = fs.create(where, True)
            stream.write(bytearray(f"{socket.gethostname()} {os.getpid()}".encode()))
            stream.close()
            self.locked = True

    def _read(self, fs, where) -> str:
        stream = fs.open(where)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifests(self, fs) -> list[tuple[int, object]]:
        """Numbers and paths, the newest first."""
        _, folder = self._hadoop(self.path)
        if not fs.exists(folder):
            return []
        found = [(MANIFEST.fullmatch(str(s.getPath().getName())), s.getPath()) for s in fs.listStatus(folder)]
        return sorted(((int(m[1]), path) for m, path in found if m), key=lambda x: -x[0])

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def read_manifest(self) -> dict | None:
        """The newest manifest that is whole."""
        fs, _ = self._hadoop(self.path)
        found = self._manifests(fs)
        for number, where in found:
            try:
                told = json.loads(self._read(fs, where))
            except ValueError:  # its writer died
                continue
            self.number = found[0][0]
            return told
        if found:
            raise IoError(f"the manifest of {self.path} is damaged")
        return None

    def write_manifest(self, manifest: dict) -> None:
        """Write under another name and rename to the next number."""
        fs, where = self._hadoop(f"{self.path}/manifest-{uuid.uuid4().hex}.tmp")
        stream = fs.create(where, True)
        stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
        stream.close()
        _, final = self._hadoop(f"{self.path}/manifest-{self.number + 1:012d}.json")
        if not fs.rename(where, final):
            raise IoError(f"can't write a manifest of {self.path}")
        self.number += 1
        for number, old in self._manifests(fs):
            if number < self.number - KEPT:
                fs.delete(old, False)

    def new_folder(self, table: str) -> str:
        safe = "".join(c if c.isalnum() else "_" for c in table)
        return f"{self.path}/data/{safe}-{uuid.uuid4().hex}"

    def files_of(self, folder: str) -> list[str]:
        """The data files that Spark has written to a folder."""
        fs, where = self._hadoop(folder)
        return sorted(str(s.getPath().toString()) for s in fs.listStatus(where) if s.getPath().getName().endswith(".parquet") and s.getLen() > 0)

    def vacuum(self, keep: set[str]) -> tuple[int, int]:
        """Delete data files that no version refers to; numbers of files and bytes."""
        fs, where = self._hadoop(f"{self.path}/data")
        gone = size = 0
        if fs.exists(where):
            for folder in fs.listStatus(where):
                left = 0
                for status in fs.listStatus(folder.getPath()):
                    path = str(status.getPath().toString())
                    if path.endswith(".parquet"):
                        if path in keep:
                            left += 1
                        else:
                            gone, size = gone + 1, size + status.getLen()
                            fs.delete(status.getPath(), False)
                if not left:
                    fs.delete(folder.getPath(), True)
        return gone, size

    def close(self) -> None:
        if self.closed:
            return
        self.closed = True
        held = Store._open.get(self.path, 0)
        if held <= 1:
            Store._open.pop(self.path, None)
        else:
            Store._open[self.path] = held - 1
        if self.locked:
            fs, where = self._hadoop(f"{self.path}/{LOCK}")
            fs.delete(where, False)
        if self.temporary:
            fs, where = self._hadoop(self.path)
            fs.delete(where, True)

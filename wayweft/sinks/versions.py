"""Versions of a folder: what is written beside it becomes visible in one step.

Every version is a small JSON file with the next number, made through the Hadoop file system so that it
works wherever tables do. A file that exists is never opened for writing again: of two writers that
start from the same version one wins and the other gets ``Conflict``. A reader holds the state of one
version and reads the folders it names, which later versions leave in place.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LOG = "_versions"


class Conflict(RuntimeError):
    """Somebody else committed first."""


class Version(NamedTuple):
    number: int
    state: dict


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def new_place(self, name: str) -> str:
        """A folder that no version names yet."""
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path(LOG)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(LOG))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def current(self) -> Version:
        """The newest whole version; number 0 with an empty state where there is none."""
        for number in reversed(self.numbers()):
            stream = self._fs.open(self._path(f"{LOG}/{number}.json"))
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):  # a writer that broke off leaves no line end
                return Version(number, json.loads(text))
        return Version(0, {})

    def commit(self, state: dict, after: int) -> Version:
        """Make ``state`` the version that follows ``after``."""
        number = after + 1
        while number in self.numbers() and self.current().number < number:
            number += 1  # a broken one lies there
        if self.current().number != after:
            raise Conflict(f"{self.folder}: version {self.current().number} came after {after}")
        try:
            out = self._fs.create(self._path(f"{LOG}/{number}.json"), False)
        except Py4JJavaError as error:
            raise Conflict(f"{self.folder}: version {number} is taken") from error
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()
        return Version(number, state)

    def clean(self) -> int:
        """Delete the folders that the newest version does not name, and older version files; returns how many folders went.

        Readers pinned to older versions lose their tables, so this is for times without any.
        """
        now = self.current()
        used = json.dumps(now.state)
        gone = 0
        for status in self._fs.listStatus(self._path("")) if self._fs.exists(self._path("")) else []:
            name = status.getPath().getName()
            if name != LOG and status.isDirectory() and name not in used:
                self._fs.delete(status.getPath(), True)
                gone += 1
        for number in self.numbers():
            if number < now.number:
                self._fs.delete(self._path(f"{LOG}/{number}.json"), False)
        return gone

    def delete(self) -> bool:
        return self._fs.delete(self._path(""), True)


def versioned_folders(spark: SparkSession, parent: str) -> list[str]:
    """The folders right under ``parent`` that have versions."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(parent)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    inside = [s.getPath() for s in fs.listStatus(base) if s.isDirectory()]
    return sorted(p.toString() for p in inside if fs.exists(jvm.org.apache.hadoop.fs.Path(p, LOG)))

"""A log of numbered entries in the shared store, for jobs that run at the same time.

An entry is one small JSON file.  It is written aside and then moved to its number only if nothing is
there yet, so of several runs that want the same number one gets it and the others are told; a reader sees
whole entries only.  What an entry names (a batch folder) is written before it and read only through it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from fieldmodes.session import path_exists


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def entries(self) -> list[dict]:
        """The entries in order, up to the first number that is free."""
        if not path_exists(self.spark, self.folder):
            return []
        folder = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = folder.getFileSystem(self._conf)
        found = {x.getPath().getName() for x in fs.listStatus(folder)}
        out: list[dict] = []
        while (name := f"{len(out):08d}.json") in found:
            stream = fs.open(self._path(name))
            try:
                out.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
        return out

    def append(self, number: int, entry: dict) -> bool:
        """Write ``entry`` as entry ``number``; False if that number is taken."""
        aside, target = self._path(f".{uuid.uuid4().hex}"), self._path(f"{number:08d}.json")
        fs = target.getFileSystem(self._conf)
        out = fs.create(aside, False)
        out.write(json.dumps(entry).encode())
        out.close()
        try:
            return self._move_if_free(fs, aside, target)
        finally:
            fs.delete(aside, False)

    def _move_if_free(self, fs, aside, target) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            if fs.getScheme() == "file":  # a local rename would replace the target; a second link to the file does not
                where = self._jvm.java.nio.file.Paths.get
                uri = lambda p: self._jvm.java.net.URI.create("file://" + p.toUri().getPath())
                self._jvm.java.nio.file.Files.createLink(where(uri(target)), where(uri(aside)))
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(aside, target, none)
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise

"""Outputs of several tables and files that appear as a whole or not at all.

A run writes into a folder of its own beside the output.  Committing it records every file with
its size and SHA-256, and then puts the folder in the output's place by a rename.  A run
that is killed before leaves the old output as it was; one killed between the two renames is
completed or undone by ``recover``, which every new run calls first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


class Publication:
    """One run that is to replace the output at ``out``, a folder of a file system that Spark reads.

    ``folder`` is where the run writes.  ``commit`` publishes it, ``abandon`` deletes it; one that is neither stays for inspection.
    """

    def __init__(self, spark: SparkSession, out: str, overwrite: bool = False):
        self.spark, self.out, self.overwrite = spark, out.rstrip("/"), overwrite
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.out).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._path(self.out).getName():
            raise ValueError("the root of a file system is no output")
        recover(spark, out)
        if not overwrite and self._fs.exists(self._path(self.out)):
            raise FileExistsError(f"there is an output at {self.out} already")
        self.folder = f"{self.out}.run-{uuid.uuid4().hex[:12]}"
        self._fs.mkdirs(self._path(self.folder))

    def put_text(self, name: str, text: str) -> None:
        """Writes one small file of the driver's."""
        stream = self._fs.create(self._path(f"{self.folder}/{name}"), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def commit(self) -> DataFrame:
        """Publishes the run and returns its manifest; raises FileExistsError if another run was faster and this one may not overwrite."""
        found = _listed(self.spark, self.folder)
        rows = sorted((r["name"], r["size"], r["sha256"]) for r in found.collect())
        self.put_text(MANIFEST, "".join(json.dumps({"name": n, "size": s, "sha256": h}) + "\n" for n, s, h in rows))
        old = f"{self.out}.old-{uuid.uuid4().hex[:12]}"
        if self._fs.exists(self._path(self.out)):
            if not self.overwrite:
                raise FileExistsError(f"there is an output at {self.out} already")
            self._move(self.out, old)
        self._move(self.folder, self.out)
        self._fs.delete(self._path(old), True)
        return manifest(self.spark, self.out)

    def abandon(self) -> None:
        self._fs.delete(self._path(self.folder), True)

    def _move(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"cannot rename {a} to {b}")


def recover(spark: SparkSession, out: str) -> None:
    """Puts the old output back if a run was killed after it had moved it away, and deletes what is left of replaced ones."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    here = path(out.rstrip("/"))
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{out.rstrip('/')}.old-*")) or []:
        if fs.exists(here):
            fs.delete(status.getPath(), True)
        elif not fs.rename(status.getPath(), here):
            raise OSError(f"cannot put {status.getPath()} back")


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha256) of every file under a folder but the manifest; a file is hashed by one task, files in parallel."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.substring_index(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), f"{root}/", -1)
    return files.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).where(F.col("name") != MANIFEST)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(name, size, sha256) of the files of a published output, as its manifest has them."""
    return spark.read.schema("name string, size long, sha256 string").json(f"{out.rstrip('/')}/{MANIFEST}")


def differences(spark: SparkSession, out: str) -> DataFrame:
    """(name, problem) of files that are ``missing``, ``changed`` or ``unknown`` against the manifest."""
    want = manifest(spark, out).select("name", F.struct("size", "sha256").alias("_want"))
    have = _listed(spark, out.rstrip("/")).select("name", F.struct("size", "sha256").alias("_have"))
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unknown").when(F.col("_have") != F.col("_want"), "changed")
    return want.join(have, "name", "full").select("name", problem.alias("problem")).where("problem is not null")

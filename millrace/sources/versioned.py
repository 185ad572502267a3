"""Keyed tables that are merged into by copy on write, with whole versions.

Rows lie in buckets by a hash of the key. A merge reads and rewrites only the buckets that the new rows fall into, into a folder of its
own; the others stay the files that they are. What a version holds is said by a manifest, one small file, written last
and put in its place by a rename that fails if another writer was first. Readers take the highest manifest: until the rename
they see the whole old version, after it the whole new one, whenever a writer dies.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.seed import upsert


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one began with."""


@dataclass(frozen=True)
class Version:
    number: int
    buckets: int
    key: str
    schema: str  # as JSON
    folders: dict[int, str]  # bucket to folder, relative to the table


class VersionedTable:
    """A table at a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._at("").getFileSystem(self._conf)

    # ---- manifests --------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._at("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one asked for. Raises FileNotFoundError if there is none."""
        known = self.versions()
        if not known or number is not None and number not in known:
            raise FileNotFoundError(f"{self.path} has no version {'at all' if number is None else number}")
        number = known[-1] if number is None else number
        stream = self._fs.open(self._at(f"manifests/{number:012d}.json"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, said["buckets"], said["key"], said["schema"], {int(k): v for k, v in said["folders"].items()})

    def _commit(self, v: Version) -> None:
        draft = self._at(f"drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"buckets": v.buckets, "key": v.key, "schema": v.schema, "folders": v.folders}).encode()))
        out.close()
        target = self._at(f"manifests/{v.number:012d}.json")
        self._fs.mkdirs(target.getParent())
        sc = self.spark.sparkContext
        none = sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # does not replace
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {v.number} of {self.path} is another writer's") from None
            raise

    # ---- data -------------------------------------------------------------------------------------------------------

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, key: str, buckets: int) -> str:
        """Rows, each bucket one file in a folder of its own; the folder above."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _folders(self, folder: str) -> dict[int, str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.isDirectory()]
        return {int(n.partition("=")[2]): f"{folder}/{n}" for n in names}

    def create(self, rows: DataFrame, key: str, buckets: int = 64) -> Version:
        """The first version. Raises Conflict if there is one already. Keys must be distinct."""
        v = Version(1, buckets, key, rows.schema.json(), self._folders(self._write(rows, key, buckets)))
        self._commit(v)
        return v

    def _read(self, v: Version, folders: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(v.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, number: int | None = None) -> DataFrame:
        v = self.version(number)
        return self._read(v, sorted(v.folders.values()))

    def merge(self, new: DataFrame, rank: Column | None = None) -> Version:
        """One row per key: the new one unless the old one outranks it (see seed.upsert). Only buckets with new rows are read and written.
        Without new rows the version stays. Raises Conflict if another writer was first; then nothing has changed."""
        v = self.version()
        new = new.select(*[f["name"] for f in json.loads(v.schema)["fields"]])
        touched = [r[0] for r in new.select(self._bucket(v.key, v.buckets).alias("b")).distinct().collect()]  # as many as buckets, at most
        if not touched:
            return v
        old = self._read(v, sorted(v.folders[b] for b in touched if b in v.folders))
        folder = self._write(upsert(old, new, v.key, rank), v.key, v.buckets)
        after = Version(v.number + 1, v.buckets, v.key, v.schema, v.folders | self._folders(folder))
        self._commit(after)
        return after

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the newest `keep`, and folders that none of these names, those of writers that died included; not
        to be run beside a writer. What was deleted."""
        known = self.versions()
        gone = [f"manifests/{n:012d}.json" for n in known[:-keep]]
        used = {f for n in known[-keep:] for f in self.version(n).folders.values()}
        for top in self._fs.listStatus(self._at("data")) if self._fs.exists(self._at("data")) else []:
            folder = f"data/{top.getPath().getName()}"
            own = self._folders(folder).values()
            gone += [f for f in own if f not in used] if any(f in used for f in own) else [folder]
        if self._fs.exists(self._at("drafts")):
            gone += [f"drafts/{s.getPath().getName()}" for s in self._fs.listStatus(self._at("drafts"))]
        for f in gone:
            self._fs.delete(self._at(f), True)
        return gone

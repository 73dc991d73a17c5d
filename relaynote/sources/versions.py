"""Tables that batches change bucket by bucket, and whose readers see whole versions.

Rows lie in Parquet folders, one for each bucket of a hashed key that a batch wrote. A version is a small manifest that
names, for each table, the folders of each bucket and the last batch of each writer. It is made by a rename that fails
if another writer was first, so a version is there as a whole or not at all. A batch that comes again, after a restart,
finds its number in the manifest and changes nothing; what it wrote before it was broken off is named by no manifest.
"""

from __future__ import annotations

import json
import uuid
import weakref
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Only a local master may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
    return f"{path.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


#: Spark's setting that frees a query's shuffle files at its end, not when the driver's garbage is collected.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back: its plan is run once, whoever reads it. Its shuffle files go at once."""
    conf, path = df.sparkSession.conf, shared_folder(df.sparkSession, label)
    before = conf.get(FREES)
    conf.set(FREES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(FREES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*frames: DataFrame) -> None:
    """Delete the files of frames that written() returned, once nothing will read them any more."""
    for df in frames:
        path = _paths.pop(df, None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Versions:
    """The tables under `path`, with their schemas by name, in `buckets` buckets of the hash of `key` (or of bucket_id).

    With every version a reader gets all tables as one batch left them. Manifests have a name for each folder of each
    bucket, so their size follows from the number of buckets, and of appended batches since the last compact().
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schemas: dict[str, str], buckets: int = 32) -> None:
        self.spark, self.path, self.key, self.schemas, self.buckets = spark, path.rstrip("/"), key, schemas, buckets
        self.read_buckets: list[int] = []  # of the last read, for whoever wants to know what it touched

    # Files, by the store's own client

    def _hadoop(self):  # noqa: ANN202
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        return jvm, jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf), conf

    def _names(self) -> list[int]:
        jvm, fs, _ = self._hadoop()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in found if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, the last by default; an empty one before the first."""
        names = self._names()
        if not names:
            return {"version": 0, "batches": {}, "folders": {}}
        jvm, fs, _ = self._hadoop()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{version or names[-1]}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Make the next version. False if there is one of that number already."""
        jvm, fs, conf = self._hadoop()
        make = jvm.org.apache.hadoop.fs.Path
        aside, place = make(f"{self.path}/versions/.{uuid.uuid4().hex}"), make(f"{self.path}/versions/{manifest['version']}.json")
        out = fs.create(aside)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, place, none)
        except Exception as e:  # noqa: BLE001 - py4j has one class for all
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(aside, False)
            return False
        return True

    # Tables

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table as the last version has it (or the given manifest), or some buckets of it: others' files are not listed."""
        folders = (manifest or self.manifest())["folders"].get(name, {})
        wanted = sorted(map(int, folders)) if buckets is None else sorted({int(b) for b in buckets} & set(map(int, folders)))
        self.read_buckets = wanted
        paths = [f"{self.path}/{folder}/bucket={b}" for b in wanted for folder in folders[str(b)]]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*paths)

    def _write(self, name: str, rows: DataFrame, batch: int) -> tuple[str, list[int]]:
        """Write rows by bucket; a bucket of many rows is written by several tasks. Returns the folder and its buckets."""
        folder = f"{name}/{batch}-{uuid.uuid4().hex}"
        names = [f.name for f in self.spark.createDataFrame([], self.schemas[name]).schema]
        bucket = F.col("bucket_id") if "bucket_id" in names else self.bucket()
        rows.select(*names, bucket.alias("bucket")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        jvm, fs, _ = self._hadoop()
        there = [f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}"))]
        return folder, [int(n.partition("=")[2]) for n in there if n.startswith("bucket=")]

    def seen(self, writer: str, batch: int) -> bool:
        """Whether the writer's batch, or a later one, is in the last version."""
        return batch <= self.manifest()["batches"].get(writer, -1)

    def commit(self, writer: str, batch: int, change: Callable[[dict], dict[str, tuple[DataFrame, bool]]]) -> bool:
        """Make a version with a batch's changes; False, and nothing done, if the writer's batch is in one already.

        change(manifest) gives, by table, rows and whether they replace their buckets or are added to them. Where another
        writer's version comes first, the change is made anew from that.
        """
        while True:
            last = self.manifest()
            if batch <= last["batches"].get(writer, -1):
                return False
            folders = {name: {b: list(f) for b, f in of.items()} for name, of in last["folders"].items()}
            for name, (rows, replaces) in change(last).items():
                folder, buckets = self._write(name, rows, batch)
                of = folders.setdefault(name, {})
                for b in map(str, buckets):
                    of[b] = [folder] if replaces else [*of.get(b, []), folder]
            if self._publish({"version": last["version"] + 1, "batches": {**last["batches"], writer: batch}, "folders": folders}):
                return True

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows with the key's columns fall to."""
        return [r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]  # `buckets` rows at most

    def compact(self, name: str, writer: str, batch: int) -> bool:
        """Rewrite the buckets that lie in several folders, each into one."""

        def change(last: dict) -> dict[str, tuple[DataFrame, bool]]:
            several = [int(b) for b, f in last["folders"].get(name, {}).items() if len(f) > 1]
            return {name: (self.read(name, several, last), True)}

        return self.commit(writer, batch, change)

    def expire(self, keep: int = 2) -> int:
        """Delete folders and manifests that none of the last `keep` versions needs. Returns how many folders went.

        Only for a time without writers: a batch's folders are named by no manifest until it is committed.
        """
        jvm, fs, _ = self._hadoop()
        make, names = jvm.org.apache.hadoop.fs.Path, self._names()
        needed = {f for v in names[-keep:] for of in self.manifest(v)["folders"].values() for fs_ in of.values() for f in fs_}
        gone = 0
        for name in self.schemas:
            if fs.exists(make(f"{self.path}/{name}")):
                for f in fs.listStatus(make(f"{self.path}/{name}")):
                    if f"{name}/{f.getPath().getName()}" not in needed:
                        fs.delete(f.getPath(), True)
                        gone += 1
        for v in names[:-keep]:
            fs.delete(make(f"{self.path}/versions/{v}.json"), False)
        return gone

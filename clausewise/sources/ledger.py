"""Commits that happen once: a history with a ledger of batches, a keyed table with a manifest.

Data files are written first, under a folder of their own for each attempt, and count only
from the moment a small JSON file names them. That file is put in place by a rename that
fails where its target exists, so of several attempts at the same batch or version one wins,
and a writer that dies on the way leaves files that nobody reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.operators.ordering import guard_unions


class Commits:
    """Small JSON files in one folder of any file system, each put there at most once."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.spark, self.folder, self._jvm = spark, folder.rstrip("/"), jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        self._system = path.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.makeQualified(
            self._system.getUri(), self._system.getWorkingDirectory()).toUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def has(self, name: str) -> bool:
        return self._system.exists(self._path(name))

    def names(self) -> list[str]:
        if not self._system.exists(self._path(".")):
            return []
        found = [s.getPath().getName() for s in self._system.listStatus(self._path("."))]
        return sorted(n for n in found if n.endswith(".json"))

    def put(self, name: str, body: dict) -> bool:
        """False if there is one of that name."""
        draft = self._path(f".{uuid.uuid4().hex}")
        out = self._system.create(draft)
        out.write(bytearray((json.dumps(body) + "\n").encode()))
        out.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(
            self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            if self.has(name):
                return False
            self._context.rename(draft, self._path(name), options)
            return True
        except Exception as e:
            if self.has(name):
                return False
            raise e
        finally:
            if self._system.exists(draft):
                self._system.delete(draft, False)

    def get(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}").first()[0])


# --- history -----------------------------------------------------------------------

_ENTRY = "source string, batch long, attempt string, files array<string>"


def append_batch(df: DataFrame, path: str, source: str, batch: int) -> bool:
    """Appends a batch of a source to the history, or nothing if it is there already.

    The ledger entry names the batch together with its files.
    """
    ledger = Commits(df.sparkSession, f"{path}/_ledger")
    name = f"{source}-{batch}.json"
    if ledger.has(name):
        return False
    attempt = uuid.uuid4().hex
    folder = f"{path}/source={source}/batch={batch}/attempt={attempt}"
    df.write.option("ignoreNullFields", "false").json(folder)
    at = ledger._jvm.org.apache.hadoop.fs.Path(folder)
    files = sorted(s.getPath().getName() for s in ledger._system.listStatus(at) if s.getPath().getName().startswith("part-"))
    return ledger.put(name, {"source": source, "batch": batch, "attempt": attempt, "files": files})


def read_history(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the batches in the ledger; files of unfinished attempts are left out."""
    from pyspark.sql import types as T

    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    named = spark.read.schema(_ENTRY).json(f"{path}/_ledger").select("attempt", F.explode("files").alias("_file"))
    whole = T.StructType([*schema.fields, *T.StructType.fromDDL("source string, batch long, attempt string").fields])
    rows = spark.read.schema(whole).option("basePath", path).json(f"{path}/source=*").withColumn(
        "_file", F.col("_metadata.file_name"))
    return rows.join(named, ["attempt", "_file"], "left_semi").drop("attempt", "_file")


# --- keyed table -------------------------------------------------------------------

class BucketedTable:
    """A table by key whose upserts rewrite only the hash buckets they touch.

    The newest manifest names the folder of every bucket. An upsert reads the touched
    buckets, writes them anew and puts the next manifest in place; other buckets keep their
    files. A writer that finds its manifest's number taken starts again from the winner's.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.commits = Commits(spark, f"{self.path}/_manifest")
        self.buckets = self.manifest()["buckets"] if self.commits.names() else buckets

    def manifest(self) -> dict:
        names = self.commits.names()
        return self.commits.get(names[-1]) if names else {
            "version": 0, "buckets": self.buckets, "folders": {}, "schema": None, "batches": {}}

    def _read(self, manifest: dict, numbers=None) -> DataFrame | None:
        from pyspark.sql import types as T

        wanted = [f for b, f in sorted(manifest["folders"].items()) if numbers is None or int(b) in numbers]
        if not manifest["schema"]:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in wanted])

    def read(self) -> DataFrame:
        table = self._read(self.manifest())
        if table is None:
            raise FileNotFoundError(self.path)
        return table

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, source: str | None = None, number: int | None = None, attempts: int = 5) -> bool:
        """Rows of the batch replace those with their key; False if the batch is in already.

        Of rows with one key the one with the largest ``seq`` counts, where there is such a
        column. ``source`` and ``number`` name a stream's batch.
        """
        from clausewise.sources.writers import upsert

        touched = sorted(r[0] for r in batch.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        for _ in range(attempts):
            manifest = self.manifest()
            if source is not None and manifest["batches"].get(source, -1) >= number:
                return False
            if not touched and source is None:
                return True
            new = dict(manifest["folders"])
            schema = manifest["schema"] or batch.drop("seq").schema.jsonValue()
            if touched:
                before = self._read(manifest, set(touched))
                before = self.spark.createDataFrame([], batch.drop("seq").schema) if before is None else before
                merged = upsert(before, batch, self.key).withColumn("_bucket", self._bucket())
                folder = f"data/{uuid.uuid4().hex}"
                merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
                new |= {str(b): f"{folder}/_bucket={b}" for b in touched}
            body = {"version": manifest["version"] + 1, "buckets": self.buckets, "folders": new, "schema": schema,
                    "batches": manifest["batches"] | ({source: number} if source is not None else {})}
            if self.commits.put(f"{body['version']:012d}.json", body):
                return True
        raise RuntimeError(f"{self.path}: another writer was first {attempts} times")

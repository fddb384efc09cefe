"""Tables of versions (SNK-01, A-08) and the ledger of the runs that made them (SRC-07).

A table is a folder: ``data`` holds Parquet of each version's changed buckets, ``versions`` one small manifest for each version, which names the folder of
every bucket of keys. A version is written beside what is there and counts from the moment that its manifest is in place, in one rename; until then readers see the version
before, and two writers cannot both make the same version. A run's success stands in the manifest of its data, so neither is ever there without the other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUNS = "run_id string, source string, status string, started_at timestamp, finished_at timestamp, rows_read long, created long, updated long, version int, message string"


class Conflict(RuntimeError):
    """Another writer has made the version that was about to be made."""


class _Folder:
    """Small files of a table by the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.top = path.rstrip("/")
        root = self.jvm.org.apache.hadoop.fs.Path(self.top)
        conf = spark._jsc.hadoopConfiguration()
        self.fs, root = root.getFileSystem(conf), root.getFileSystem(conf).makeQualified(root)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)

    def path(self, name: str):
        return self.fs.makeQualified(self.jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}"))

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def put(self, name: str, content: dict) -> None:
        """A whole new file or none: Conflict where there is one of this name."""
        side = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self.path(side), True)
        stream.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        stream.close()
        try:
            self.context.rename(self.path(side), self.path(name), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(self.path(side), False)
            if "FileAlreadyExists" in str(e) or self.fs.exists(self.path(name)):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _manifests(folder: _Folder) -> list[int]:
    return [int(n[:-5]) for n in folder.names("versions") if n.endswith(".json")]


def _manifest(folder: _Folder, version: int | None) -> dict | None:
    found = _manifests(folder)
    if not found:
        return None
    if version is not None and version not in found:
        raise ValueError(f"no version {version}")
    return folder.read(f"versions/{max(found) if version is None else version:09d}.json")


def _rows(spark: SparkSession, path: str, manifest: dict | None, schema: StructType, buckets: set[str] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets."""
    wanted = [f"{path.rstrip('/')}/{at}" for b, at in (manifest or {"buckets": {}})["buckets"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*wanted) if wanted else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at ``path`` as its newest version, or an older one, has it."""
    manifest = _manifest(_Folder(spark, path), version)
    if manifest is None:
        raise ValueError(f"no table at {path}")
    return _rows(spark, path, manifest, StructType.fromJson(manifest["schema"]))


def newest_version(spark: SparkSession, path: str) -> int | None:
    return max(_manifests(_Folder(spark, path)), default=None)


def _differs(columns: list[str], old: str, new: str) -> Column:
    return ~F.struct(*[F.col(f"{old}.{c}") for c in columns]).eqNullSafe(F.struct(*[F.col(f"{new}.{c}") for c in columns]))


def _compared(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """change (created, updated, deleted), and the row of each key whose row is not the same in both; for deleted ones the old row."""
    columns = new.columns
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    j = old.withColumn("_there", F.lit(True)).alias("a").join(new.withColumn("_there", F.lit(True)).alias("b"), same, "full_outer")
    change = F.when(F.col("a._there").isNull(), "created").when(F.col("b._there").isNull(), "deleted").when(_differs(columns, "a", "b"), "updated")
    rows = j.withColumn("change", change).where("change is not null")
    return rows.select("change", *[F.when(F.col("change") == "deleted", F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in columns])


def changes(spark: SparkSession, path: str, since: int | None, until: int | None = None) -> DataFrame:
    """A-08: change and the row of every key that was created, updated or deleted from version ``since`` (None: from nothing) to ``until`` (None: the newest).

    Only buckets whose folders differ are read.
    """
    folder = _Folder(spark, path)
    new = _manifest(folder, until)
    old = _manifest(folder, since) if since is not None else None
    schema = StructType.fromJson(new["schema"])
    before = (old or {"buckets": {}})["buckets"]
    touched = {b for b in {*before, *new["buckets"]} if before.get(b) != new["buckets"].get(b)}
    return _compared(_rows(spark, path, old, schema, touched), _rows(spark, path, new, schema, touched), new["key"])


def upsert_version(df: DataFrame, path: str, key: list[str], *, by: str, fill: bool = False, buckets: int = 64, run: dict | None = None) -> dict:
    """SNK-01 and A-08: ``df`` merged into the table at ``path``, as a new version; returns version, created and updated.

    Of the stored and new rows of a key the one with the highest ``by`` stays, a new one on ties. With ``fill``, its null and empty values are those of the
    newest row that has them. Only buckets with keys of ``df`` are rewritten. Rows without a value in ``by`` come last; null keys are a key. A table keeps the columns, key and
    number of buckets of its first version. A failed write, or one that meets another (``Conflict``), leaves the table as it was.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path)
    old = _manifest(folder, None)
    schema = StructType.fromJson(old["schema"]) if old else df.schema
    key, buckets = (old["key"], old["n_buckets"]) if old else (key, buckets)
    number = (old["version"] if old else 0) + 1
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")
    batch = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # as many as there are buckets, at most
    stored = _rows(spark, path, old, schema, touched)
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    order = F.struct(F.col(by).isNotNull(), F.col(by), "_new")
    rest = [c for c in schema.names if c not in key]
    if fill:
        has = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        merged = both.groupBy(*key).agg(*[F.coalesce(F.max_by(c, F.when(has(c), order)), F.max_by(c, order)).alias(c) for c in rest])
    else:
        merged = both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")
    side = f"data/{number:09d}-{uuid.uuid4().hex}"
    merged.select(*schema.names, bucket.alias("bucket")).write.partitionBy("bucket").parquet(f"{folder.top}/{side}")
    there = {n.removeprefix("bucket="): f"{side}/{n}" for n in folder.names(side) if n.startswith("bucket=")}
    manifest = {"version": number, "key": key, "n_buckets": buckets, "schema": json.loads(schema.json()), "buckets": {**(old["buckets"] if old else {}), **there}}
    found = {r["change"]: r["count"] for r in _compared(stored, _rows(spark, path, manifest, schema, touched), key).groupBy("change").count().collect()}
    done = {"version": number, "created": found.get("created", 0), "updated": found.get("updated", 0)}
    if run is not None:
        manifest["run"] = run | done | {"status": "success", "finished_at": _now()}
    folder.put(f"versions/{number:09d}.json", manifest)
    return done


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> None:
    """Drops the manifests but the newest ``keep`` that hold no run, and data that no manifest left names. Not beside a writer."""
    folder = _Folder(spark, path)
    found = sorted(_manifests(folder))
    old = {v: folder.read(f"versions/{v:09d}.json") for v in found}
    for v in found[:-keep]:
        if "run" in old[v]:
            folder.put(f"runs/{old[v]['run']['run_id']}-success.json", old[v]["run"])
        folder.delete(f"versions/{v:09d}.json")
    named = {at.split("/")[1] for v in found[-keep:] for at in old[v]["buckets"].values()}
    for n in folder.names("data"):
        if n not in named:
            folder.delete(f"data/{n}")


def _now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: a row for each run of the table at ``path``: run_id, source, status (running, success, error), times, counts, version, message.

    A run that ended well is told by its version; one that failed, or never ended, by what it left. A run that is tried again has the status of its last try.
    """
    folder = _Folder(spark, path)
    top, files = folder.top, []
    parts = []
    if versions := [n for n in folder.names("versions") if n.endswith(".json")]:
        manifests = spark.read.schema(f"run struct<{RUNS.replace(' string', ':string').replace(' timestamp', ':timestamp').replace(' long', ':bigint').replace(' int', ':int')}>").json([f"{top}/versions/{n}" for n in versions])
        parts.append(manifests.where("run is not null").select("run.*"))
    if files := [f"{top}/runs/{n}" for n in folder.names("runs") if n.endswith(".json")]:
        parts.append(spark.read.schema(RUNS).json(files))
    if not parts:
        return spark.createDataFrame([], RUNS)
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rank = F.struct(F.col("status") == "success", F.coalesce("finished_at", "started_at"), F.col("status") == "error")
    names = [f.name for f in every.schema if f.name != "run_id"]
    return every.groupBy("run_id").agg(F.max_by(F.struct(*names), rank).alias("r")).select("run_id", "r.*")


def run_import(df: DataFrame, path: str, key: list[str], *, by: str, run_id: str, source: str, fill: bool = False) -> dict | None:
    """SRC-07: ``upsert_version`` as a run that the ledger has: running at once, then success with its counts in one step with the data, or error with a message.

    ``run_id`` tells what is imported, such as a digest of its files: one that has succeeded is not run again (None), so a repeated run changes nothing.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path)
    if not run_log(spark, path).where((F.col("run_id") == run_id) & (F.col("status") == "success")).isEmpty():
        return None
    run = {"run_id": run_id, "source": source, "started_at": _now()}
    folder.put(f"runs/{run_id}-{uuid.uuid4().hex}.json", run | {"status": "running"})
    try:
        return upsert_version(df, path, key, by=by, fill=fill, run=run | {"rows_read": df.count()})
    except Exception as e:
        folder.put(f"runs/{run_id}-{uuid.uuid4().hex}.json", run | {"status": "error", "finished_at": _now(), "message": str(e).split("\n")[0][:500]})
        raise


def import_files(spark: SparkSession, folder: str, path: str, load: Callable[[list[str]], DataFrame], key: list[str], *, by: str) -> dict | None:
    """SRC-07: the files of ``folder`` whose content no successful run has, loaded and merged into the table at ``path`` as one run; None where there is none.

    What each run took in is a table of its own (``ledger``: run_id, file_hash, path), which counts if its run succeeded. Of files with one content the first path is loaded.
    """
    from plotline.sources.files import file_hashes

    files = file_hashes(spark, folder).groupBy("file_hash").agg(F.min("path").alias("path"))
    done = taken_files(spark, path)
    fresh = files.join(done.select("file_hash"), "file_hash", "left_anti")
    rows = fresh.orderBy("file_hash").collect()  # the names of new files
    if not rows:
        return None
    import hashlib

    run_id = hashlib.sha256("".join(r.file_hash for r in rows).encode()).hexdigest()[:32]
    spark.createDataFrame([(run_id, r.file_hash, r.path) for r in rows], "run_id string, file_hash string, path string").write.mode("overwrite").parquet(f"{path.rstrip('/')}/ledger/run={run_id}")
    return run_import(load([r.path for r in rows]), path, key, by=by, run_id=run_id, source="files")


def taken_files(spark: SparkSession, path: str) -> DataFrame:
    """run_id, file_hash, path of the files of successful runs."""
    schema = "run_id string, file_hash string, path string"
    runs = _Folder(spark, path).names("ledger")
    if not runs:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/ledger/{n}" for n in runs])
    return rows.join(run_log(spark, path).where("status = 'success'").select("run_id"), "run_id", "left_semi")

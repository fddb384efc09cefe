"""What the training-data operators share: checkpoints, shared folders and row bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of exact dedup and SimHash name it.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Where that is unset, one machine's session gets a temporary one; a cluster none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


#: Bytes of rows that go to a Python worker at a time. Batches by a number of rows grow with the texts; the JVM and the worker each hold them more than once.
BATCH_BYTES = 4 << 20


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """For tables made meanwhile: Arrow batches of at most ``BATCH_BYTES``, or one row (a lower bound of the session stays), and shuffle files that go
    as soon as a table is made, not when the driver happens to collect its garbage. The session's own settings are restored.
    """
    batch, clean = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {name: spark.conf.get(name, None) for name in (batch, clean)}
    most = (before[batch] or "").rstrip("bB")
    spark.conf.set(batch, str(min(int(most), BATCH_BYTES) if most.isdigit() and int(most) else BATCH_BYTES))
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the reliable checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    with sparing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under these settings


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder: less disk than a checkpoint."""
    path = shared_path(df.sparkSession, name)
    with sparing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows, as they are written, up to which one side of a join is broadcast.
BROADCAST_BYTES = 16 << 20


def attached(big: DataFrame, small: DataFrame, keys: list[str], *, most: int | None = None) -> DataFrame:
    """``big`` left-joined with ``small``, a ``written`` table of one row for each value of ``keys``.

    The files of ``small`` are measured: up to ``BROADCAST_BYTES`` they are broadcast. Beyond, a key may have a third of ``big``:
    both are joined by key and salt, as many salts as shuffle partitions for the keys that have more than a task's share of the rows, one for others.
    """
    spark = big.sparkSession
    files = small.inputFiles()
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] if files else 0
    if size <= (BROADCAST_BYTES if most is None else most):
        return big.join(F.broadcast(small), keys, "left")
    n = shuffle_partitions(spark)
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = counts.join(counts.agg((F.sum("_n") / n).alias("_share")), F.col("_n") > F.col("_share")).select(*keys)  # fewer than n
    hot = F.broadcast(durable(hot).withColumn("_salts", F.lit(n)))
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), salts).cast("int")).drop("_salts")
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_as_text(docs: DataFrame, *columns: str, name: str = "doc_id") -> DataFrame:
    """``name`` as a string and ``columns``: pandas would turn integers beside a null into doubles. See ``id_restored``."""
    return docs.select(F.col(name).cast("string").alias(name), *columns)


def id_restored(found: DataFrame, docs: DataFrame, name: str = "doc_id") -> DataFrame:
    """``found`` with ``name`` of the type that it has in ``docs``."""
    return found.withColumn(name, F.col(name).cast(docs.schema[name].dataType))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_REMEMBERED: dict = {}


def remembered(key, make):
    """What a worker keeps between tasks under ``key``; only the last used is kept, so operators do not add up."""
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]

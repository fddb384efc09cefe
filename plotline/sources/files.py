"""Readers and writers (SRC-01, SRC-04, SRC-06 to SRC-08, SNK-01, SNK-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Columns of a lead sheet and the heads, as text keys, under which they come.
LEAD_COLUMNS = {
    "phone_raw": ["numero de telefono", "telefono", "telefono de contacto"], "name_raw": ["nombre"], "property_type_raw": ["tipo de propiedad"], "source_portal": ["fuente"], "address_raw": ["direccion"], "price_raw": ["precio"],
    "status": ["estado del anuncio", "estado"], "area_raw": ["area construida", "superficie construida"], "property_url": ["pagina de la propiedad", "url propiedad"], "listing_url": ["pagina del anuncio", "url anuncio"],
    "created_raw": ["fecha de creacion del lead", "fecha lead"],
}
SEPARATORS = [",", ";", "\t", "|"]


def _key(head: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", head.strip().lower()) if unicodedata.category(c) != "Mn")
    return " ".join("".join(c for c in bare if c.isalnum() or c in " ,.-").split())


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: a lead sheet with canonical columns, all strings. The separator that gives most of the columns wins (ties: the first)."""
    if not path.lower().rstrip("/").endswith((".csv", ".txt")):
        raise ValueError(f"unsupported file: {path}")
    head = (spark.read.text(path).first() or [""])[0].lstrip("﻿")
    alias = {a: k for k, names in LEAD_COLUMNS.items() for a in names}
    best = max(SEPARATORS, key=lambda s: len({alias.get(_key(h.strip('"'))) for h in head.split(s)} - {None}))
    df = spark.read.csv(path, header=True, sep=best, inferSchema=False)
    df = df.withColumnsRenamed({c: alias[_key(c.lstrip("﻿"))] for c in df.columns if _key(c.lstrip("﻿")) in alias})
    if missing := [c for c in LEAD_COLUMNS if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(c).cast(StringType()) for c in LEAD_COLUMNS])


def read_official_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", sep: str = ";") -> DataFrame:
    """SRC-04: heads and values are trimmed, '' and '-' are null; heads become lower-case words joined by underscores."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    clean = lambda c: F.when(~F.trim(F.col(f"`{c}`")).isin("", "-"), F.trim(F.col(f"`{c}`"))).alias(_key(c.lstrip("﻿")).replace(" ", "_"))
    return df.select(*[clean(c) for c in df.columns])


#: First bytes of a file that tell how it is written.
PROBE_BYTES = 1 << 16


def probe(head: bytes, wanted: list[str] | None = None) -> tuple[str, str, tuple[str, ...]]:
    """SRC-04: encoding, separator and heads of a file that begins with ``head``.

    UTF-8 if its bytes are, apart from a letter that is cut at the end; Latin-1 otherwise. The separator that finds most of ``wanted`` (any heads: most columns) wins; ties go to the first.
    """
    import codecs

    try:
        text, encoding = codecs.getincrementaldecoder("utf-8-sig")().decode(head), "UTF-8"
    except UnicodeDecodeError:
        text, encoding = head.decode("latin-1"), "ISO-8859-1"
    line = text.splitlines()[0] if text else ""
    split = {s: tuple(_key(h.strip('"')).replace(" ", "_") for h in line.split(s)) for s in SEPARATORS}
    best = max(SEPARATORS, key=lambda s: len(set(split[s]) & set(wanted)) if wanted else len(split[s]))
    return encoding, best, split[best]


def read_official_folder(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """SRC-04: all CSV files of a folder as one table, each by its own encoding, separator and order of columns; columns that a file lacks are null.

    Only the first bytes of each file are looked at first; files that are written alike are read together.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    alike: dict[tuple, list[str]] = {}
    for status in fs.listStatus(at):
        name = status.getPath().toString()
        if status.isFile() and name.lower().endswith((".csv", ".txt")):
            stream = fs.open(status.getPath())
            try:
                head = bytes(stream.readNBytes(PROBE_BYTES))
            finally:
                stream.close()
            if head:
                alike.setdefault(probe(head, wanted), []).append(name)
    out = None
    for (encoding, sep, _), names in sorted(alike.items()):
        part = read_official_csv(spark, names, encoding, sep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no CSV files in {path}")
    return out if wanted is None else out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def read_catalog_packages(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: a row for each package (struct) of JSON dumps that hold one, a list, or a search's result with a list of them."""
    raw = spark.read.option("multiLine", True).json(path)
    if "result" in raw.columns:
        return raw.select(F.explode("result.results").alias("package"))
    return raw.select(F.struct("*").alias("package"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: path, name, length, modified and sha256 of each supported file, newest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    names = F.element_at(F.split("path", "/"), -1)
    out = f.select("path", names.alias("name"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("file_hash"))
    return out.where(F.lower("name").rlike(r"\.(csv|xlsx|xls|txt)$")).orderBy(F.col("modified").desc(), "path")


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """SRC-07: files whose content no successful or skipped run of the ledger has."""
    done = ledger.where(F.col("status").isin("success", "skipped_duplicate")).select("file_hash")
    return files.join(done, "file_hash", "left_anti")


def ledger_rows(files: DataFrame, ledger: DataFrame, *, as_of) -> DataFrame:
    """SRC-07: a ledger row for each file: file_hash, path, status (pending, or skipped_duplicate where its content is done or comes twice), started_at."""
    from pyspark.sql import Window

    done = ledger.where(F.col("status").isin("success", "skipped_duplicate")).select("file_hash").distinct().withColumn("_done", F.lit(True))
    again = F.row_number().over(Window.partitionBy("file_hash").orderBy("path")) > 1
    status = F.when(F.coalesce("_done", F.lit(False)) | again, "skipped_duplicate").otherwise("pending")
    return files.join(done, "file_hash", "left").select("file_hash", "path", status.alias("status"), as_of.alias("started_at"))


def write_table(df: DataFrame, path: str, *, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """SNK-01: Parquet, facts partitioned by date."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK-02: one JSON object a line."""
    df.write.mode("overwrite").json(path)

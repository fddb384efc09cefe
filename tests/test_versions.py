"""Versions of tables and their runs (SNK-01, A-08, SRC-07, A-06): failures, conflicts, repeats, differences."""

import random

import pytest
from pyspark.sql import functions as F

from plotline.operators.profiles import freshness_days
from plotline.sources import versions as v

SCHEMA = "k long, name string, phone string, at long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_newest_row_of_each_key(spark, tmp_path):
    df = lambda x: spark.createDataFrame(x, SCHEMA)
    path = str(tmp_path / "t")
    with pytest.raises(ValueError):
        v.read_version(spark, path)
    assert v.upsert_version(df([(1, "a", None, 1), (2, "b", "p", 5), (None, "n", None, 1)]), path, ["k"], by="at", buckets=4) == {"version": 1, "created": 3, "updated": 0}
    assert v.upsert_version(df([(1, "c", "q", 2), (2, "d", None, 4), (3, "e", None, None)]), path, ["k"], by="at") == {"version": 2, "created": 1, "updated": 1}
    assert rows(v.read_version(spark, path)) == sorted([(1, "c", "q", 2), (2, "b", "p", 5), (3, "e", None, None), (None, "n", None, 1)], key=str)
    assert rows(v.read_version(spark, path, 1)) == sorted([(1, "a", None, 1), (2, "b", "p", 5), (None, "n", None, 1)], key=str)
    assert rows(v.changes(spark, path, 1)) == [("created", 3, "e", None, None), ("updated", 1, "c", "q", 2)]
    assert v.changes(spark, path, None, 1).count() == 3 and v.changes(spark, path, 2).count() == 0
    again = v.upsert_version(df([(1, "c", "q", 2), (1, "z", "q", 1)]), path, ["k"], by="at")
    assert again == {"version": 3, "created": 0, "updated": 0} and v.newest_version(spark, path) == 3
    assert v.upsert_version(df([]), path, ["k"], by="at") == {"version": 4, "created": 0, "updated": 0}


def test_last_value_that_is_not_empty(spark, tmp_path):
    """A-08: equal to a plain loop over the batches."""
    rng = random.Random(2)
    path, held = str(tmp_path / "t"), {}
    for n in range(4):
        batch = [(rng.randint(0, 20), rng.choice([None, "", "a", "b"]), rng.choice([None, "p", "q"]), n * 100 + i) for i in range(25)]
        before = {k: dict(r) for k, r in held.items()}
        for k, name, phone, at in batch:
            r = held.setdefault(k, {"name": None, "phone": None, "at": None})
            r.update({c: x for c, x in (("name", name), ("phone", phone), ("at", at)) if x not in (None, "")})
        got = v.upsert_version(spark.createDataFrame(batch, SCHEMA), path, ["k"], by="at", fill=True, buckets=3)
        assert got["created"] == len(held) - len(before) and got["updated"] == sum(before[k] != held[k] for k in before)
    assert {r.k: (r.name or None, r.phone, r.at) for r in v.read_version(spark, path).collect()} == {k: (r["name"], r["phone"], r["at"]) for k, r in held.items()}


def test_a_write_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, "a", None, 1) for i in range(20)], SCHEMA)
    v.upsert_version(df, path, ["k"], by="at")

    def dies(*_):
        raise OSError("no more")

    with monkeypatch.context() as m:
        m.setattr(v._Folder, "put", dies)
        with pytest.raises(OSError):
            v.upsert_version(df.withColumn("at", F.lit(9).cast("long")), path, ["k"], by="at")
    assert rows(v.read_version(spark, path)) == rows(df) and v.newest_version(spark, path) == 1
    with monkeypatch.context() as m:  # another writer makes version 2 meanwhile
        m.setattr(v, "_compared", lambda *a, f=v._compared: (v._Folder(spark, path).put("versions/000000002.json", v._manifest(v._Folder(spark, path), 1) | {"version": 2}), f(*a))[1])
        with pytest.raises(v.Conflict):
            v.upsert_version(df.withColumn("at", F.lit(9).cast("long")), path, ["k"], by="at")
    assert rows(v.read_version(spark, path)) == rows(df)
    v.vacuum(spark, path, keep=1)
    assert rows(v.read_version(spark, path)) == rows(df) and len(v._Folder(spark, path).names("data")) == 1


def test_runs_commit_with_their_data(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, "a", None, 1) for i in range(5)], SCHEMA)
    status = lambda: {r.run_id: (r.status, r.rows_read, r.created, r.updated) for r in v.run_log(spark, path).collect()}
    assert status() == {}
    bad = df.withColumn("at", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        v.run_import(bad, path, ["k"], by="at", run_id="r1", source="csv")
    assert status() == {"r1": ("error", None, None, None)} and v.newest_version(spark, path) is None
    assert v.run_import(df, path, ["k"], by="at", run_id="r1", source="csv")["created"] == 5
    assert v.run_import(df, path, ["k"], by="at", run_id="r1", source="csv") is None
    with monkeypatch.context() as m:  # the worker dies without a word
        m.setattr(v, "upsert_version", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            v.run_import(df, path, ["k"], by="at", run_id="r2", source="csv")
    assert status() == {"r1": ("success", 5, 5, 0), "r2": ("running", None, None, None)} and v.newest_version(spark, path) == 1
    v.run_import(df.withColumn("name", F.lit("b")), path, ["k"], by="at", run_id="r2", source="csv")
    v.run_import(df.withColumn("at", F.lit(7).cast("long")), path, ["k"], by="at", run_id="r3", source="csv")
    v.vacuum(spark, path, keep=1)
    assert status() == {"r1": ("success", 5, 5, 0), "r2": ("success", 5, 0, 5), "r3": ("success", 5, 0, 5)}
    assert v.run_import(df, path, ["k"], by="at", run_id="r2", source="csv") is None
    runs = v.run_log(spark, path).select(F.lit("csv").alias("source_type"), "status", "finished_at", F.col("run_id").alias("id"))
    assert freshness_days(runs, F.current_timestamp() + F.expr("INTERVAL 51 HOURS")).first().freshness_days == 2


def test_files_are_taken_once(spark, tmp_path):
    path, folder = str(tmp_path / "t"), tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("1,x,,1\n2,y,,1\n")
    (folder / "copy.csv").write_text("1,x,,1\n2,y,,1\n")
    load = lambda paths: spark.read.schema(SCHEMA).csv(paths)
    assert v.import_files(spark, str(folder), path, load, ["k"], by="at") == {"version": 1, "created": 2, "updated": 0}
    assert v.import_files(spark, str(folder), path, load, ["k"], by="at") is None
    (folder / "b.csv").write_text("2,z,,2\n3,w,,2\n")
    assert v.import_files(spark, str(folder), path, load, ["k"], by="at") == {"version": 2, "created": 1, "updated": 1}
    assert v.taken_files(spark, path).count() == 2 and v.run_log(spark, path).agg(F.sum("rows_read")).first()[0] == 4

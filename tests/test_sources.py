"""Official files (SRC-04), cards of history pages (P-02), audits of alerts (A-16), zone counts of a stream (S-03)."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from plotline.operators import captures
from plotline.sources import files
from plotline.streaming import flow


def test_official_folder(spark, tmp_path):
    """One table of files in both encodings, with both separators, in another order of columns, with a BOM, and empty."""
    (tmp_path / "a.csv").write_bytes("Código de vía;Nombre de la vía;Distrito\n1; Alcalá ;-\n2;Señora;Centro\n".encode())
    (tmp_path / "b.csv").write_bytes("﻿Nombre de la vía;Código de vía\nPeñíscola;3\n".encode())
    (tmp_path / "c.csv").write_bytes("Código de vía,Nombre de la vía,Distrito\n4,Núñez de Balboa,Salamanca\n".encode("latin-1"))
    (tmp_path / "d.txt").write_bytes("Código de vía;Nombre de la vía\n5;Ñandú\n".encode("latin-1"))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "f.pdf").write_bytes(b"x")
    wanted = ["codigo_de_via", "nombre_de_la_via", "distrito", "barrio"]
    got = sorted(map(tuple, files.read_official_folder(spark, str(tmp_path), wanted).collect()))
    assert got == [("1", "Alcalá", None, None), ("2", "Señora", "Centro", None), ("3", "Peñíscola", None, None), ("4", "Núñez de Balboa", "Salamanca", None), ("5", "Ñandú", None, None)]
    assert files.probe("año;b".encode() + "ñ".encode()[:1])[:2] == ("UTF-8", ";")  # a letter cut at the end of the probe


def test_alert_audits(spark):
    rows = [("k1", "price_drop", "Idealista", 3), ("k2", "price_drop", None, 1), ("k3", None, "Idealista", 2)]
    alerts = spark.createDataFrame(rows, "canonical_key string, event_type_guess string, source_portal string, occurrence_count long")
    alerts = alerts.withColumns({x: F.when(F.col("canonical_key") != "k2", "x") for x in ("listing_url", "contact_phone_raw", "address_raw", "price_eur", "area_m2", "message_datetime")})
    got = {(r.kind, r.value): r.n for r in captures.alert_audit(alerts).collect()}
    assert got["coverage", "alerts"] == 3 and got["coverage", "occurrences"] == 6 and got["coverage", "price_eur"] == 2
    assert got["type", "price_drop"] == 2 and got["type", "none"] == 1 and got["portal", "Idealista"] == 2
    assert [k for k in got if k[0] == "repeated"] == [("repeated", "k1"), ("repeated", "k3")]
    resolved = spark.createDataFrame([(1, 2, "a"), (None, 2, "a"), (None, None, "b")], "listing_id long, asset_id long, strategy string")
    assert {(r.kind, r.value): r.n for r in captures.resolution_audit(resolved).collect()} == {("flag", "with_listing"): 1, ("flag", "with_asset"): 2, ("flag", "unresolved"): 1, ("strategy", "a"): 2, ("strategy", "b"): 1}


def test_windows_of_a_stream_equal_batch_counts(spark, tmp_path):
    """S-03: events of 7, 14 and 30 days up to each day, from one state of days for each zone and type; rows later than the watermark go."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    events = sorted((start + dt.timedelta(minutes=rng.randint(0, 40 * 1440)), rng.choice(["Sol", "Goya"]), rng.choice(["sold", "price_drop"])) for _ in range(400))
    schema = "event_datetime timestamp, zone_label string, event_type string"
    for k in range(4):  # files in order of time, each with some rows of the day before
        part = events[k * 100 : (k + 1) * 100]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flow.run_once(flow.stream_window_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.day, r.zone_label, r.event_type): (r.events_7d, r.events_14d, r.events_30d) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = max(e[0] for e in events)
    closed = (last - dt.timedelta(days=1)).date()
    by_day = Counter((at.date(), z, t) for at, z, t in events)
    for day in {at.date() for at, *_ in events}:
        for z in ("Sol", "Goya"):
            for t in ("sold", "price_drop"):
                n = tuple(sum(by_day[day - dt.timedelta(days=i), z, t] for i in range(w)) for w in (7, 14, 30))
                if day < closed and by_day[day, z, t]:
                    assert got[day, z, t] == n
    assert all(v == tuple(sum(by_day[d - dt.timedelta(days=i), z, t] for i in range(w)) for w in (7, 14, 30)) for (d, z, t), v in got.items())


def test_house_numbers_are_no_prices(spark):
    """F-10: a number right behind a street's name is its house's, however long; with a currency, or behind a word of a price, it is a price."""
    from plotline.functions.numbers import flow_price_pair
    from plotline.operators import captures

    cases = {
        "Piso en venta en Calle Mayor 31239 - Barrio Sol": None, "Calle Mayor 899999": None, "Avda. de América 450000 tel": None, "Calle Mayor 85000 eur": 85000.0, "venta en Calle Mayor precio 350000": 350000.0,
        "Calle Mayor 5 venta 350000": 350000.0, "venta en Madrid 85000": 85000.0, "Calle Mayor 350.000 €": 350000.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: r.p.current for r in df.select("a", flow_price_pair(F.col("a")).alias("p")).collect()} == cases
    content = '{"url": "https://a.example.com/x?historyType=sold", "data": [{"title": "Piso en venta en Calle Mayor 31239 - Barrio Sol", "listingId": "L1", "portal": "Idealista", "price": 12345}]}'
    rows = captures.flow_records(captures.payload_records(spark.createDataFrame([("p", 1, content)], "page_url string, page_number int, content string"))).collect()
    assert [(r.address_raw, r.current_price_eur) for r in rows] == [("Calle Mayor 31239", None)]

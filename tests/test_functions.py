"""Known values of the scalar functions, file readers, streams, and the plans of the queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plotline.functions import bands, geo, labels, numbers, semantics, text


def one(spark, f, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in rows.select(f(F.col("v"))).collect()]


def test_text(spark):
    assert one(spark, text.text_key, "  Ático   C/ Alcalá_1|2 ", "weak_identity", None, "###") == ["atico c alcala12", "weakidentity", None, ""]
    assert one(spark, text.normalize_phone, "699 111 222", "0034699111222", "1234567", None) == ["+34699111222", "+34699111222", None, None]
    assert one(spark, text.normalize_url, "http://www.idealista.com/inmueble/123/?x=1") == ["https://idealista.com/inmueble/123"]
    assert one(spark, text.external_id, "https://x.com/a/listing-77", "https://x.com/a") == ["77", "https://x.com/a"]
    assert one(spark, text.portal_label, "Fotocasa for Sale", "Idealista: Hector", "Pisos.com", "Otro: x") == ["Fotocasa", "Idealista", "Pisos", "Otro"]
    assert one(spark, text.portal_key, "Fotocasa for Sale", "Pisos.com", None) == ["fotocasa", "pisos", None]


def test_numbers(spark):
    assert one(spark, numbers.parse_price_eur, "350.000 €", "350.000,50", "x") == [350000.0, 35000050.0, None]
    assert one(spark, numbers.parse_area_m2, "85,5 m²", "1.250 m2") == [85.5, 1.25]
    assert one(spark, numbers.parse_lead_date, "20.03.2026", "2026-03-20") == [dt.date(2026, 3, 20), None]
    assert one(spark, numbers.spanish_date, "26 mar 2026", "1 de enero de 2026", "03/11/2025", "enero 2024", "x") == [dt.date(2026, 3, 26), dt.date(2026, 1, 1), dt.date(2025, 11, 3), dt.date(2024, 1, 1), None]
    assert [tuple(x) for x in one(spark, numbers.flow_price_pair, "antes 520.000 € ahora 470.000 €", "sin precio")] == [(520000.0, 470000.0), (None, None)]
    assert one(spark, numbers.spanish_float, "1.234,5") == [1234.5] and one(spark, numbers.spanish_int, "1.234") == [1234]
    assert abs(one(spark, numbers.dms_to_decimal, "3º40'23.6'' W")[0] + 3.67322222) < 1e-6


def test_geo(spark):
    p = spark.createDataFrame([(40.4168, -3.7038), (40.4171, -3.7040), (40.4205, -3.7105), (None, 1.0)], "lat double, lon double")
    assert [r[0] for r in p.select(geo.microzone_cell(F.col("lat"), F.col("lon"))).collect()] == ["mox-p9x2", "mox-p9x2", "moz-p9x4", None]
    km = spark.range(1).select(geo.haversine_km(F.lit(40.4168), F.lit(-3.7038), F.lit(40.4171), F.lit(-3.7041))).first()[0]
    assert abs(km - 0.041926) < 1e-5


def test_semantics(spark):
    got = [tuple(x) for x in one(spark, semantics.address_semantics, "Calle Mayor 10", "Lavapies - Madrid", "Gran via larga", None, "Barrio Sol")]
    assert got == [("precise", None), ("zone_like", "Lavapies"), ("partial", None), ("unknown", None), ("zone_like", "Barrio Sol")]
    assert one(spark, semantics.event_type_of_url, "https://x/?historyType=price-drop", "https://x/?a=1") == ["price_drop", None]
    assert [r[0] for r in spark.createDataFrame([(71.9,), (72.0,), (39.0,)], "s double").select(bands.prediction_band(F.col("s"))).collect()] == ["media", "alta", "baja"]


def test_zone_labels(spark):
    known = spark.createDataFrame([("Guindalera",), ("Sol",)], "zone_label string")
    rows = spark.createDataFrame([(1, None, None, "calle Alcala"), (2, "GUINDALERA", None, None), (3, None, None, "Calle X 1, Sol, 28009 Madrid"), (4, "sol barrio", None, None)], "id int, neighborhood string, district string, address_raw string")
    got = {r.id: r.zone_label for r in labels.with_zone(rows, known, aliases={"sol barrio": "Sol"}).collect()}
    assert got == {1: "Sin zona", 2: "Guindalera", 3: "Sol", 4: "Sol"}


def test_winsorize_and_min_max(spark):
    from plotline.operators.zones import min_max, winsorize

    z = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 999])], "id int, s double")
    assert max(r.s_sort for r in winsorize(z, ["s"]).collect()) == 502.0
    assert max(r.s_sort for r in winsorize(z.where("id <> 0"), ["s"]).collect()) == 999.0
    assert {r.n for r in min_max(z, {"n": F.lit(3)}).collect()} == {0.5}


def test_match_metrics(spark):
    from plotline.operators.quality import matching_metrics

    r = matching_metrics(spark.createDataFrame([("match", "resolved"), ("match", "unresolved")], "review_label string, predicted_status string")).first()
    assert (r.tp, r.fn, r.precision, r.recall) == (1, 1, 1.0, 0.5)


def test_files(spark, tmp_path):
    from plotline.sources import files

    head = "Número de teléfono;Nombre;Tipo de propiedad;Fuente;Dirección;Precio;Estado del anuncio;Área construida;Página de la propiedad;Página del anuncio;Fecha de creación del lead"
    (tmp_path / "a.csv").write_text(head + "\n699111222;Ana;Piso;Fotocasa for Sale;Calle Mayor 10;350.000 €;En venta;80;http://p;http://l;20.03.2026\n", encoding="utf-8")
    row = files.read_leads(spark, str(tmp_path / "a.csv")).first()
    assert (row.phone_raw, row.source_portal, row.address_raw) == ("699111222", "Fotocasa for Sale", "Calle Mayor 10")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_leads(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        files.read_leads(spark, str(tmp_path / "b.pdf"))
    found = files.file_hashes(spark, str(tmp_path))
    done = found.where("name = 'a.csv'").select("file_hash", F.lit("success").alias("status"))
    assert [r.name for r in files.new_files(found, done).collect()] == ["b.csv"]
    files.write_json(spark.range(3).toDF("id"), str(tmp_path / "j"))
    assert files.read_catalog_packages(spark, str(tmp_path / "j")).count() == 3


def test_streams_equal_batch(spark, tmp_path):
    from plotline.streaming import flow

    rows = [(f"u{i % 20}", "a" if i % 3 else "b", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=30 * i)) for i in range(200)]
    schema = "source_uid string, event_type string, event_datetime timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    flow.run_once(flow.stream_flow(stream), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    flow.run_once(flow.stream_event_counts(stream), str(tmp_path / "n"), str(tmp_path / "c2"))
    batch = spark.createDataFrame(rows, schema).groupBy(F.to_date("event_datetime").alias("d"), "event_type").count()
    want = {(r.d, r.event_type): r["count"] for r in batch.collect()}
    got = {(r.day.date(), r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    state = spark.createDataFrame([("flow", dt.datetime(2024, 1, 2)), ("new", None)], "source_name string, last_success_to timestamp")
    since = {r.source_name: r.since for r in flow.sync_range(state, F.to_timestamp(F.lit("2024-01-10 00:00:00"))).collect()}
    assert since == {"flow": dt.datetime(2024, 1, 1), "new": dt.datetime(2024, 1, 7)}


def test_entry_without_training_data():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "zone_scores_v2" in queries


def test_addresses(spark):
    from plotline.functions.addresses import address_base, address_key

    assert one(spark, address_base, "C/ Alcala 123, 3o B, 28009 Madrid", "Avda. de America 45 portal 2, Madrid", "Lavapies - Madrid") == ["calle alcala, 123", "avenida america, 45", "lavapies"]
    assert one(spark, address_key, "C/ Alcala 123, 3o B, 28009 Madrid", "Calle de Alcala numero 123") == ["callealcala", "callealcala"]


def test_fuzzy(spark):
    import random
    from functools import lru_cache

    from plotline.functions import fuzzy

    @lru_cache(None)
    def lcs(a, b):
        if not a or not b:
            return 0
        return lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert fuzzy.common_subsequence(a, b) == lcs(a, b)
    assert fuzzy.best_window_ratio("mayor", "calle mayor") == 100.0 and fuzzy.indel_ratio("", "") == 100.0
    df = spark.createDataFrame([("Calle Mayor 10", "Calle Mayor 12"), ("Calle Mayor 10", None), ("Luchana", "Alcala")], "a string, b string")
    got = [r[0] for r in df.select(fuzzy.address_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 100.0 and got[1] == 0.0 and got[2] < 70


def test_archives(spark, tmp_path):
    import zipfile

    from plotline.sources import archives

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>A</t></si><si><t>B</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row/><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>7</v></c></row><row><c r="A3" t="inlineStr"><is><t>x</t></is></c><c r="B3"><v>8</v></c></row></sheetData></worksheet>')
        z.writestr("m.html", "<p>x</p>")
    read = lambda align: [dict(r.cells) for r in archives.read_xlsx(spark, str(tmp_path), "S", align=align).orderBy("row_no").collect()]
    assert read("positional") == [{"A": "7"}, {"A": "x", "B": "8"}] and read("column") == [{"B": "7"}, {"A": "x", "B": "8"}]
    with pytest.raises(KeyError):
        archives.sheet_rows((tmp_path / "a.xlsx").read_bytes(), "none")
    (tmp_path / "c.html").write_text("<p>y</p>")
    (tmp_path / "a.xlsx").rename(tmp_path / "a.zip")
    assert sorted(r.html for r in archives.read_chat_export(spark, str(tmp_path)).collect()) == ["<p>x</p>", "<p>y</p>"]


def test_titles_of_capitals(spark):
    from plotline.functions.labels import _title_if_upper

    names = ["SOL", "SAN BLAS-CANILLEJAS", "EL VISO", "Sol", "VILLA DE VALLECAS", "L'ILLA", "ÁLAMOS", "A.B. CENTRO", "CASCO H.VALLECAS", "", None, "12 DE OCTUBRE"]
    got = spark.createDataFrame([(x,) for x in names], "x string").select(_title_if_upper(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [x.title() if x and x.upper() == x else x for x in names]


def test_address_parts_name_zones(spark):
    """Parts are trimmed of blanks only; those with a digit anywhere are passed over."""
    known = spark.createDataFrame([("Sol",), ("Goya",)], "zone_label string")
    rows = [(1, None, None, "Calle Mayor 3, Sol"), (2, None, None, "1 Sol, x"), (3, None, None, "Calle, 1 Goya"), (4, None, "GOYA", "Sol"), (5, None, None, None), (6, "SOL", "Goya", "")]
    df = spark.createDataFrame(rows, "id int, neighborhood string, district string, address_raw string")
    assert {r.id: r.zone_label for r in labels.with_zone(df, known).collect()} == {1: "Sol", 2: "Sin zona", 3: "Sin zona", 4: "Goya", 5: "Sin zona", 6: "Sol"}


def test_district_lists(spark):
    cases = {"01-03-04 ": ["01", "03", "04"], "04/05": ["04", "05"], "1-2/3": ["1-2", "3"], " - ": [], "": [], None: [], "7": ["7"]}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", numbers.split_district_list(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == cases


def test_compatibility_forms_of_all_code_points(spark):
    """F-01: every code point alone, and each that may join another after a letter, equal the Unicode tables."""
    import random
    import unicodedata

    signs = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) not in ("Cn", "Co", "Zs", "Zl", "Zp", "Cc")]
    rng = random.Random(4)
    rows = [f"a{x}b" for x in signs] + ["".join(rng.choice(signs) for _ in range(4)) for _ in range(5000)] + ["e\u0301\u0323", "\u1100\u1161\u11a8", "\uac00\u11a8", "ﬁn  Ⅳ", "½ m²"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").repartition(4)
    got = {r.i: r.y for r in df.select("i", text.unicode_text(F.col("x")).alias("y")).collect()}
    wrong = [x for i, x in enumerate(rows) if (got[i] or "") != " ".join(unicodedata.normalize("NFKC", x).split())]
    assert not wrong, (len(wrong), [x.encode("unicode_escape") for x in wrong[:10]])

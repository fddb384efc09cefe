"""Matching without all pairs, assets, streets and streams, each against brute force or typed values."""

import random

import pytest
from pyspark.sql import functions as F

from plotline.functions import addresses, fuzzy
from plotline.operators import geography, identity, matching, quality
from plotline.streaming import flow


@pytest.fixture(scope="module")
def flow_tables(spark):
    rng = random.Random(4)
    streets = ["alcala", "alcaia", "mayor", "mayor alta", "gran via", "sol"]
    listings, items = [], []
    for i in range(160):
        s = rng.choice(streets)
        price = rng.choice([None, 0.0, 100000.0, 101000.0, 108000.0, 118000.0, 300000.0])
        listings.append((i, f"https://p/{i}", str(i), rng.choice([None, "Idealista", "Pisos"]), rng.choice([None, "+34600000001", "+34600000002"]), rng.choice([None, "ana", "luis"]), s.replace(" ", ""), f"{s} {rng.choice(['centro', 'norte'])}", price, rng.choice([None, "owner_like", "broker_like"])))
    for i in range(120):
        s = rng.choice(streets)
        items.append((i, rng.choice([None, f"https://p/{i}"]), rng.choice([None, str(i + 1)]), rng.choice([None, "Idealista", "Pisos"]), rng.choice([None, "+34600000001", "+34600000009"]), rng.choice([None, "ana"]), s.replace(" ", ""), f"{s} {rng.choice(['centro', 'norte'])}", rng.random() < 0.9, rng.choice([None, 100000.0, 104000.0, 250000.0])))
    left = spark.createDataFrame(items, "item_id long, url string, external string, portal string, phone string, name string, street string, fragment string, placed boolean, price double")
    right = spark.createDataFrame(listings, "listing_id long, url string, external string, portal string, phone string, name string, street string, fragment string, price double, profile string").withColumn("name_norm", F.col("name"))
    return left.cache(), right.cache()


@pytest.mark.parametrize("fuzzy_too", [False, True])
def test_best_matches_equal_all_pairs(flow_tables, fuzzy_too):
    items, listings = flow_tables
    similar = matching.similar_fragments(items, listings).cache() if fuzzy_too else None
    every = matching.score_candidates(matching.flow_candidates(items, listings, similar), items, listings, similar).collect()
    of = {}
    for r in every:
        near = r.ratio if r.ratio is not None and r.ratio <= 0.2 else 1.0
        of.setdefault(r.item_id, []).append((-r.score, near, r.listing_id))
    got = {r.item_id: (r.listing_id, r.score, r.second_score) for r in matching.best_matches(items, listings, similar).collect()}
    want = {}
    for i, rows in of.items():
        rows.sort()
        want[i] = (rows[0][2], -rows[0][0], -rows[1][0] if len(rows) > 1 else -999.0)
    assert got == want


def test_similar_fragments_equal_brute_force(flow_tables):
    items, listings = flow_tables
    a, b = ({r.fragment for r in df.select("fragment").collect()} for df in flow_tables)
    want = {(x, y) for x in a for y in b if set(x.split()) & set(y.split()) and max(fuzzy.indel_ratio(x, y), fuzzy.best_window_ratio(x, y)) >= 70}
    assert {(r.fragment, r.other) for r in matching.similar_fragments(items, listings).collect()} == want


def test_weighted_ratio():
    assert fuzzy.weighted("calle|alcala", "calle|alcala") == 100 and fuzzy.weighted("", "a") == 0
    assert fuzzy.weighted("mayor gran", "gran mayor") == pytest.approx(95) and fuzzy.weighted("calle|alcala", "calle|alcalaa") == pytest.approx(96)
    assert fuzzy.weighted("alcala", "paseo de la castellana y de alcala") == pytest.approx(90)


def one_after_another(rows, ratio=fuzzy.indel_ratio):
    """Find-or-create, row by row, over all assets: building 50, street 40 or a similar one 20, type 20, area 20; 60 are enough."""
    assets, out = [], {}
    for row_id, street, building, kind, area in sorted(rows):
        found = [a for a in assets if building and a["building"] == building]
        found += [a for a in assets if street and a["street"] == street and a not in found]
        best, most = None, 0
        for a in found or [a for a in assets if kind and a["kind"] == kind]:
            points = 50 if building and a["building"] == building else 0
            if street and a["street"]:
                points += 40 if a["street"] == street else 20 if ratio(street, a["street"]) >= 92 else 0
            points += 20 if kind and a["kind"] == kind else 0
            points += 20 if a["area"] is None or area is None or abs(a["area"] - area) <= max(5, 0.08 * max(a["area"], area)) else 0
            if points > most:
                best, most = a, points
        if most < 60:
            best = {"id": row_id, "building": None, "street": street, "kind": kind, "area": area}
            assets.append(best)
        best["building"] = best["building"] or building
        best["area"] = area if best["area"] is None else best["area"]
        out[row_id] = best["id"]
    return out


ASSET_ROWS = "row_id long, address_norm string, building_id string, asset_type_detail string, area_m2 double"


@pytest.mark.parametrize("seed", range(4))
def test_assets_equal_find_or_create(spark, seed):
    """Q2: shared buildings over streets, chains of similar streets, repeated rows, missing values."""
    rng = random.Random(seed)
    chain = ["callealcaladehenares", "callealcaladehenarez", "callealcaladehenarezz", "callealcaladehenarzzz"]
    streets = [*chain, "callesol", "plazanueva", "callemayor", "callemayorr", "", None]
    rows = [(i, rng.choice(streets), rng.choice([None, None, "", *(f"h{k}" for k in range(12))]), rng.choice([None, "piso", "local", "atico"]), rng.choice([None, 50.0, 51.0, 53.0, 55.5, 56.0, 90.0])) for i in range(400)]
    df = spark.createDataFrame(rows, ASSET_ROWS).repartition(3)
    got = {r.row_id: r.asset_id for r in identity.match_asset(df, identity.similar_streets(df)).collect()}
    assert got == one_after_another(rows)
    assert all(got[a] == a for a in set(got.values()))  # every asset is its own founder
    alone = {r.row_id: r.asset_id for r in identity.match_asset(df).collect()}
    assert alone == one_after_another(rows, lambda a, b: 0)


def test_assets_of_one_building(spark):
    """Q2: one building over two streets and a row without one is one asset; a chain of similar streets has no founder that moved."""
    rows = [(1, "callesol", "B1", "piso", 50.0), (2, "plazanueva", "B1", "piso", 50.0), (3, None, "B1", "piso", 50.0), (4, None, None, "piso", 50.0)]
    df = spark.createDataFrame(rows, ASSET_ROWS)
    assert {r.row_id: r.asset_id for r in identity.match_asset(df, identity.similar_streets(df)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    rows = [(1, "callealcaladehenares", None, "piso", 50.0), (2, "callealcaladehenarez", None, "piso", 52.0), (3, "callealcaladehenarezz", None, "piso", 50.0)]
    df = spark.createDataFrame(rows, ASSET_ROWS)
    assert {r.row_id: r.asset_id for r in identity.match_asset(df, identity.similar_streets(df)).collect()} == one_after_another(rows)
    assert identity.match_asset(df.limit(0), identity.similar_streets(df.limit(0))).count() == 0


def test_edit_join_equals_all_pairs(spark):
    """Prefix, length and count filters lose no pair, with words in any order, short keys and repeated letters."""
    from plotline.functions import similar

    rng = random.Random(8)
    base = ["callealcala", "gran via", "paseo de la castellana", "aa", "a", "avenida de america", "plaza mayor de la villa", "aaaaaaaaaa", "calle de fuencarral norte"]
    keys = set(base)
    for _ in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "e", "s", " "])
        keys.add(" ".join("".join(w).split()))
    keys = sorted(k for k in keys if k)
    left, right = spark.createDataFrame([(k,) for k in keys[::2]], "key string"), spark.createDataFrame([(k,) for k in keys], "other string")
    for least in (80, 92):
        want = {(a, b) for a in keys[::2] for b in keys if fuzzy.indel_ratio(a, b) >= least}
        assert {(r.key, r.other) for r in similar.edit_pairs(left, right, least=least).collect()} == want
        turned = {(a, b) for a in keys[::2] for b in keys if fuzzy.indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) >= least}
        assert turned <= {(r.key, r.other) for r in similar.edit_candidates(left, right, least=least).collect()}
    choices = right.withColumnRenamed("other", "choice").withColumn("place", F.monotonically_increasing_id())
    got = {r.key: r.score for r in fuzzy.best_keys(left, choices).collect()}
    best = {a: max(fuzzy.weighted(a, b) for b in keys) for a in keys[::2]}
    assert got == {a: s for a, s in best.items() if s >= 92}


def test_addresses(spark):
    cases = {
        "C/ Alcalá 123, 3º B, 28009 Madrid": ("calle alcala, 123", "callealcala"), "Avda. de la Ilustración 10b portal 2, Madrid": ("avenida ilustracion, 10b", "avenidailustracion"),
        "Lavapiés - Madrid": ("lavapies", "lavapies"), "Calle de Fuencarral número 45 Madrid": ("calle fuencarral, 45", "callefuencarral"), "Plaza Mayor": ("plaza mayor", "plazamayor"), "": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: (r.b, r.k) for r in df.select("a", addresses.address_base(F.col("a")).alias("b"), addresses.address_key(F.col("a")).alias("k")).collect()} == cases


def test_streets_are_resolved(spark):
    streets = spark.createDataFrame([(0, 10, "calle", "alcala", "Centro"), (1, 11, "avenida", "alcala", "Centro"), (2, 12, "paseo", "prado", "Salamanca"), (3, 13, "calle", "fuencarral", None)], "row_no long, code long, street_type string, street_name string, district string")
    points = spark.createDataFrame([(10, 4, "D", "H", 1.0, 2.0), (10, 9, "D2", "H2", 3.0, 4.0)], "code long, number long, district string, neighborhood string, lat double, lon double")
    texts = ["Calle Alcalá 6", "Prado", "Calle Fuencarrall 3", "Lavapiés - Barrio", "Calle Inventada, Chueca", "Calle Nada", None, "Alcala 1"]
    got = {r.id: r for r in geography.resolve_streets(spark.createDataFrame(list(enumerate(texts)), "id int, address string"), streets, points).collect()}
    assert [got[i].match_type for i in range(8)] == ["exact_lookup_key", "exact_name_only", "fuzzy_lookup_key", "neighborhood_only", "trailing_neighborhood_only", "not_found", "empty", "not_found"]
    assert (got[0].street_code, got[0].district, got[0].lat, got[0].confidence) == (10, "D", 1.0, 1.0) and (got[1].street_code, got[1].district, got[1].lat) == (12, "Salamanca", None)
    assert got[2].confidence > 0.92 and got[3].neighborhood == "Embajadores" and got[4].district == "Centro"
    one = geography.geo_audit(spark.createDataFrame([tuple(r) for r in got.values()], "id int, matched boolean, confidence double, match_type string, street_code long, district string, neighborhood string, lat double, lon double")).first()
    assert tuple(one) == (8, 5, 3, 4)


def test_oldest_match_is_applied_last(spark):
    listings = spark.createDataFrame([(1, 50.0, 1.0, 10.0, "active", None, None, None)], "id long, price_eur double, price_per_m2 double, area_m2 double, status string, source_portal string, listing_url string, external_id string").withColumns({"first_seen_at": F.lit(None).cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp")})
    matched = spark.createDataFrame([(7, 1, 90.0, "2024-01-01 00:00:00", "sold", "idealista.com", "https://x/listing-5"), (8, 1, 80.0, "2024-01-03 00:00:00", "reserved", None, None), (9, 1, None, "2023-12-01 00:00:00", "history_item", "Pisos", None)], "item_id long, listing_id long, current_price_eur double, at string, event_type_guess string, portal string, listing_url string").withColumn("event_datetime", F.to_timestamp("at"))
    r = identity.apply_matches(listings, matched).first()
    assert (r.price_eur, r.price_per_m2, r.status, r.source_portal, r.listing_url, r.external_id, r.matched_items) == (90.0, 9.0, "sold", "Idealista", "https://x/listing-5", "5", 3) and str(r.last_seen_at) == "2024-01-03 00:00:00"


def test_focus_comes_after_the_limit(spark):
    rows = [(i, "unresolved" if i % 2 else "pending", f"2024-01-{i + 1:02d} 00:00:00", "zone_like" if i < 3 else "precise", "unknown", "weak_identity", None, "Ana", None, "Pisos", "x") for i in range(8)]
    links = spark.createDataFrame(rows, "flow_item_id long, match_status string, at string, address_precision string, phone_profile string, reason string, address_raw string, contact_name string, contact_phone string, portal string, match_note string").withColumn("event_datetime", F.to_timestamp("at"))
    reviews = spark.createDataFrame([(1, 7, "match")], "id long, flow_item_id long, review_label string").withColumn("created_at", F.current_timestamp())
    ids = lambda **o: [r.flow_item_id for r in quality.filter_links(links, reviews, **o).collect()]
    assert ids(status="unresolved", limit=2) == [7, 5] and ids(focus="poor_address", limit=5) == [] and sorted(ids(focus="poor_address")) == [0, 1, 2]
    assert 7 not in ids(focus="review_needed") and len(ids(query="ana")) == 8 and ids(query="luis") == []


def test_stream_equals_batch(spark, flow_tables, tmp_path):
    rows = [(i, f"https://p/{i}", "Idealista", "600000001", None, None, "Calle Mayor 3, Sol", 100000.0) for i in range(20)]
    items = spark.createDataFrame(rows, "id long, listing_url string, portal string, contact_phone string, contact_name string, address_norm string, address_raw string, current_price_eur double")
    items.write.parquet(str(tmp_path / "in"))
    flow.stream_reconcile(spark.readStream.schema(items.schema).parquet(str(tmp_path / "in")), flow_tables[1], str(tmp_path / "out"), str(tmp_path / "state"))
    keys = matching.item_keys(items)
    want = matching.decide_matches(keys, matching.best_matches(keys, flow_tables[1]))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    state = spark.createDataFrame([("flow", "2024-01-01 00:00:00", "success", None)], "source_name string, at string, status string, message string").withColumn("last_success_to", F.to_timestamp("at"))
    runs = spark.createDataFrame([("flow", "2024-01-02 00:00:00", "success", None), ("flow", "2024-01-03 00:00:00", "error", "x")], "source_name string, at string, status string, message string").withColumn("until", F.to_timestamp("at"))
    r = flow.sync_state(state, runs).first()
    assert str(r.last_success_to) == "2024-01-02 00:00:00" and (r.status, r.message) == ("error", "x")


def test_tables_and_ledger(spark, tmp_path):
    from plotline.sources import files

    found = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h2", "c")], "file_hash string, path string")
    ledger = spark.createDataFrame([("h1", "success")], "file_hash string, status string")
    assert {r.path: r.status for r in files.ledger_rows(found, ledger, as_of=F.current_timestamp()).collect()} == {"a": "skipped_duplicate", "b": "pending", "c": "skipped_duplicate"}
    head = "Teléfono de contacto;Nombre;Tipo de propiedad;Fuente;Dirección;Precio;Estado del anuncio;Superficie construida;URL propiedad;URL anuncio;Fecha lead\n1;A;piso;x;y;3;z;5;u;v;01.02.2024\n"
    (tmp_path / "leads.csv").write_text(head)
    assert files.read_leads(spark, str(tmp_path / "leads.csv")).first().phone_raw == "1"


def test_house_numbers_of_any_length(spark):
    """F-14: a street's first number is its house's, also one of five digits or one like a postal code; before the city it is the code."""
    cases = {
        "C/ large ring 19999, 3º B, 28009 Madrid": ("calle large ring, 19999", "callelarge ring"), "Avda. de large ring 28001 portal 2, Madrid": ("avenida large ring, 28001", "avenidalarge ring"),
        "Calle de red rod número 1200000": ("calle red rod, 1200000", "callered rod"), "C/ Alcalá 28005, 3º B, 28009 Madrid": ("calle alcala, 28005", "callealcala"),
        "Calle Mayor 28013 Madrid": ("calle mayor madrid", "callemayor madrid"), "Calle Mayor 5 28013 Madrid": ("calle mayor, 5", "callemayor"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    assert {r.a: (r.b, r.k) for r in df.select("a", addresses.address_base(F.col("a")).alias("b"), addresses.address_key(F.col("a")).alias("k")).collect()} == cases


def test_age_of_events_counts_parts_of_seconds(spark):
    """W-07: an event half a second after midnight is not yet a whole day older."""
    from plotline.operators.opportunities import whole_days

    df = spark.sql("SELECT i, TIMESTAMP_NTZ '2024-01-31 00:00:00' AS now, at FROM VALUES (1, TIMESTAMP_NTZ '2024-01-28 00:00:00.5'), (2, TIMESTAMP_NTZ '2024-01-28 00:00:00'), (3, TIMESTAMP_NTZ '2024-01-30 23:59:59.9'), (4, TIMESTAMP_NTZ '2024-02-02 00:00:00') AS t(i, at)")
    assert [r.d for r in df.orderBy("i").select(whole_days(F.col("now"), F.col("at")).alias("d")).collect()] == [2, 3, 0, 0]


def test_strict_assets_equal_all_pairs(spark):
    """J-05: shapes that meet give what all pairs of a street give, with missing types and areas; no street lists its pairs."""
    rng = random.Random(7)
    area = lambda: rng.choice([None, 0.0, float(rng.randint(1, 200)), rng.random() * 200, 62.5, 67.9, 57.5])
    kind = lambda: rng.choice([None, "a", "b", "c"])
    assets = [(i, f"s{rng.randint(0, 30)}", kind(), area()) for i in range(300)]
    items = [(i, rng.choice([None, *(f"s{k}" for k in range(33))]), kind(), area()) for i in range(600)]
    close = lambda x, y: x is None or y is None or abs(x - y) <= max(5.0, max(x, y) * 0.08)
    want = {}
    for i, street, t, m in items:
        there = [(1 if (t is None or k == t) and close(a, m) else 2 if t is None or k == t else 3 if close(a, m) else 4, j) for j, s, k, a in assets if s == street]
        if there and (min(there)[0] < 4 or len(there) == 1):
            want[i] = min(there)
    names = "id long, address_norm string, asset_type_detail string, area_m2 double"
    got = identity.match_asset_strict(spark.createDataFrame(items, names), spark.createDataFrame(assets, names)).collect()
    assert {r.id: (r.tier, r.asset_id) for r in got} == want and len(got) == len(want)
    many = spark.range(40000).selectExpr("id", "'s' AS address_norm", "'a' AS asset_type_detail", "CAST(id % 150 AS DOUBLE) AS area_m2")
    assert identity.match_asset_strict(many, many).where("tier = 1").count() == 40000  # 1.6e9 pairs


@pytest.mark.parametrize("fuzzy_too", [False, True])
def test_pairs_of_blocks_stand_once(flow_tables, fuzzy_too):
    """U-02: the pairs of all blocks, each once, as a plain loop finds them, and no exchange of pairs after the joins; their scores where they are made equal those by id."""
    items, listings = flow_tables
    similar = matching.similar_fragments(items, listings).cache() if fuzzy_too else None
    like = {(r.fragment, r.other) for r in similar.collect()} if fuzzy_too else set()
    left, right = items.collect(), listings.collect()
    want = set()
    for i in left:
        by = lambda k: min((x.listing_id for x in right if i[k] is not None and x[k] == i[k]), default=None)  # noqa: B023, E731
        first = by("url") if by("url") is not None else by("external")
        for x in right:
            eq = lambda a, b: a is not None and a == b
            fits = i.portal is None or x.portal is None or i.portal == x.portal
            near = i.placed and fits and (eq(i.fragment, x.fragment) or (i.fragment, x.fragment) in like)
            if x.listing_id == first or eq(i.phone, x.phone) or eq(i.name, x.name_norm) or (i.placed and eq(i.street, x.street)) or near:
                want.add((i.item_id, x.listing_id))
    pairs = matching.flow_candidates(items, listings, similar)
    rows = [tuple(r) for r in pairs.select("item_id", "listing_id").collect()]
    assert set(rows) == want and len(rows) == len(want)
    if not fuzzy_too:
        assert "Distinct" not in pairs._jdf.queryExecution().analyzed().toString()
    by_id = matching.score_candidates(pairs, items, listings, similar)
    at = matching.scored_pairs(items, listings, similar)
    assert sorted(map(str, by_id.select("item_id", "listing_id", "score", "reasons").collect())) == sorted(map(str, at.select("item_id", "listing_id", "score", "reasons").collect()))

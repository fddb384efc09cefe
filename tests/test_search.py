"""Search: positions, phrases and prefixes (X-01 to X-04)."""

from pyspark.sql import functions as F

from plotline.operators import search


def found(spark, docs, *queries):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "entity_id long, title string").withColumns({"content": F.lit("uno"), "phone_digits": F.lit("612345678"), "sort_key": F.col("entity_id")})
    d = search.search_documents(things=d)
    q = spark.createDataFrame([(t, t) for t in queries], "query_id string, text string")
    out = {t: set() for t in queries}
    for r in search.search(q, d, search.build_search_index(d)).collect():
        out[r.query_id].add(r.entity_id)
    return out


def test_phrases_are_adjacent(spark):
    docs = ["gran via norte", "via gran", "gran calle via", "gran. Vías", None, "gran gran via gran via"]
    got = found(spark, docs, "gran_via", "gran via", "via_gran", "gran_v", "norte gran_via", "gran_uno", "_", "gran_via_norte")
    assert got["gran_via"] == {0, 3, 5} and got["gran via"] == {0, 1, 2, 3, 5} and got["via_gran"] == {1, 5} and got["gran_v"] == {0, 3, 5}
    assert got["norte gran_via"] == {0} and got["gran_uno"] == set() and got["_"] == set()  # fields do not join; a term without letters says nothing
    assert got["gran_via_norte"] == {0}


def test_prefixes_and_single_letters(spark):
    got = found(spark, ["a 35", "ab 3", "b"], "6", "a", "3", "612", "ab", "7")
    assert got["6"] == {0, 1, 2} == got["612"] and got["a"] == {0} and got["3"] == {0, 1} and got["ab"] == {1} and got["7"] == set()


def test_index_positions(spark):
    d = spark.createDataFrame([(1, "sol sol luna", "sol", None, 1)], "entity_id long, title string, content string, phone_digits string, sort_key long")
    rows = {(r.token, r.field): (r.tf, r.positions, r.n_tokens) for r in search.build_search_index(search.search_documents(x=d)).collect()}
    assert rows == {("sol", "title"): (2, [0, 1], 4), ("luna", "title"): (1, [2], 4), ("sol", "content"): (1, [0], 4)}


def test_common_words_are_looked_up_beside_rare_ones(spark):
    """X-04: 1200 queries share a word of 30000 documents (36 million hits if each lists them); each has the one document of its other term. Repeated and unknown terms count as well."""
    d = spark.range(30000).selectExpr("id AS entity_id", "concat('calle raro', CAST(id AS STRING), 'x') AS title", "'' AS content", "'' AS phone_digits", "id AS sort_key")
    d = search.search_documents(things=d)
    q = spark.range(1200).selectExpr("CAST(id AS STRING) AS query_id", "CASE id WHEN 0 THEN 'calle nada' WHEN 1 THEN 'raro1x calle calle' ELSE concat('calle raro', CAST(id AS STRING), 'x') END AS text")
    rows = search.search(q, d, search.build_search_index(d)).collect()
    assert {(int(r.query_id), r.entity_id) for r in rows} == {(i, i) for i in range(1, 1200)} and len(rows) == 1199

"""Batch full-text search (U-01, X-01 to X-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotline.functions.text import fold_accents
from plotline.operators.shared import stored

K1, B = 1.2, 0.75
FIELDS = ("title", "content", "phone_digits")


def search_tokens(c: Column) -> Column:
    """X-01: lower-case runs of letters and digits without marks."""
    return F.filter(F.split(fold_accents(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def search_documents(**sections: DataFrame) -> DataFrame:
    """U-01: one table of section, entity_id, title, content, phone_digits, sort_key."""
    out = None
    for section, df in sections.items():
        part = df.select(F.lit(section).alias("section"), "entity_id", *FIELDS, "sort_key")
        out = part if out is None else out.unionByName(part)
    return out


def build_search_index(docs: DataFrame) -> DataFrame:
    """X-02: token, section, entity_id, field, n_tokens (of the document, all fields), tf, positions (of the token in the field, from 0, ascending)."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), search_tokens(F.col(f)).alias("tokens")) for f in FIELDS])
    d = docs.select("section", "entity_id", fields.alias("f")).withColumn("n_tokens", F.aggregate("f", F.lit(0), lambda a, x: a + F.size(x["tokens"])))
    flat = d.select("section", "entity_id", "n_tokens", F.explode("f").alias("x")).select("section", "entity_id", "n_tokens", "x.field", F.posexplode("x.tokens").alias("position", "token"))
    return flat.groupBy("token", "section", "entity_id", "field", "n_tokens").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def parse_search_query(c: Column) -> Column:
    """X-03: at most ten terms of letters, digits and underscores: their tokens in order (``a_b`` is a phrase), and whether the last of them is a prefix.

    Terms with digits alone or of two signs at least are prefixes. Terms without a letter or digit say nothing.
    """
    terms = F.slice(F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}\p{M}_\s]", " "), r"\s+"), lambda t: t != ""), 1, 10)
    parsed = F.transform(terms, lambda t: F.struct(search_tokens(t).alias("tokens"), (t.rlike(r"^\p{Nd}+$") | (F.length(t) >= 2)).alias("prefix")))
    return F.filter(parsed, lambda t: F.size(t["tokens"]) > 0)


def _meant(asked: DataFrame, words: DataFrame) -> DataFrame:
    """_q, prefix, token: the words of the index that each asked token means: itself, or those that begin with it.

    Prefixes meet words by their first two letters, and those of one letter by the first, so a short prefix does not gather the longer ones' words.
    """
    exact = asked.where("not prefix").join(words, F.col("_q") == F.col("token"), "left_semi").withColumn("token", F.col("_q"))
    out = exact.select("_q", "prefix", "token")
    for letters, some in ((1, F.length("_q") == 1), (2, F.length("_q") > 1)):
        met = asked.where("prefix").where(some).withColumn("_head", F.substring("_q", 1, letters)).join(words.withColumn("_head", F.substring("token", 1, letters)), "_head")
        out = out.unionByName(met.where(F.startswith("token", "_q")).select("_q", "prefix", "token"))
    return out


def search(queries: DataFrame, docs: DataFrame, index: DataFrame, *, k: int = 25, weights: dict[str, float] | None = None) -> DataFrame:
    """X-04: query_id, section, entity_id, score, place: documents with every term of a query, the k best of each section by BM25.

    Terms are distinct over all queries: each meets the index once, by whole token. A phrase's hits are the places where all its tokens stand one after another in a
    field: positions less the token's place in the phrase, counted where all agree. A query then takes the documents of its rarest term and looks up its other terms
    for these alone, so a common word is not listed for every query. Ties go to the newest, then the id.
    """
    c = F.col
    w = weights or {}
    parsed = queries.select("query_id", F.posexplode(parse_search_query(c("text"))).alias("pos", "t"))
    term = F.concat(F.array_join("t.tokens", " "), F.when(c("t.prefix"), "*").otherwise("."))  # tokens have neither blanks nor signs
    asked = stored(parsed.select("query_id", "pos", term.alias("term"), c("t.tokens").alias("tokens"), c("t.prefix").alias("_open")), "search-terms")
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    q = asked.select("term", "tokens", "_open").distinct().select("term", F.size("tokens").alias("terms"), "_open", F.posexplode("tokens").alias("at", "_q"))
    q = q.select("term", "terms", "at", "_q", (c("_open") & (c("at") == c("terms") - 1)).alias("prefix"))
    meant = _meant(q.select("_q", "prefix").distinct(), index.select("token").distinct())
    hit = q.join(meant, ["_q", "prefix"]).join(index, "token")
    of = ["term", "section", "entity_id", "field", "n_tokens"]
    single = hit.where("terms = 1").select(*of, "tf")
    starts = hit.where("terms > 1").select(*of, "terms", F.explode(F.transform("positions", lambda p: p - c("at"))).alias("start"))
    phrases = starts.groupBy(*of, "terms", "start").agg(F.count("*").alias("n")).where("n = terms").groupBy(*of).agg(F.count("*").alias("tf"))
    weight = F.coalesce(*[F.when(c("field") == f, float(w.get(f, 1.0))) for f in FIELDS])
    f = stored(single.unionByName(phrases).groupBy("term", "section", "entity_id", "n_tokens").agg(F.sum(c("tf") * weight).alias("f")), "search-postings")
    n = f.groupBy("term").agg(F.count("*").alias("n"))
    size = index.select("section", "entity_id", "n_tokens").distinct().agg(F.count("*").alias("total"), F.avg("n_tokens").alias("mean"))
    s = f.join(n, "term").crossJoin(F.broadcast(size))
    idf = F.greatest(F.log((c("total") - c("n") + 0.5) / (c("n") + 0.5)), F.lit(1e-6))
    s = stored(s.select("term", "section", "entity_id", (idf * c("f") * (K1 + 1) / (c("f") + K1 * (1 - B + B * c("n_tokens") / c("mean")))).alias("s")), "search-scores")
    rarest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "pos"))
    ranks = stored(asked.join(n, "term", "left").select("query_id", "term", rarest.alias("_rank")), "search-ranks")
    lead = ranks.where("_rank = 1").join(s, "term").select("query_id", "section", "entity_id", "s")
    rest = lead.drop("s").join(ranks.where("_rank > 1").select("query_id", "term"), "query_id").join(s, ["term", "section", "entity_id"]).select("query_id", "section", "entity_id", "s")
    found = lead.unionByName(rest).groupBy("query_id", "section", "entity_id").agg(F.count("*").alias("got"), F.sum("s").alias("score")).join(need, "query_id").where("got = need")
    ranked = found.join(docs.select("section", "entity_id", "sort_key"), ["section", "entity_id"])
    place = F.row_number().over(Window.partitionBy("query_id", "section").orderBy(F.round("score", 9).desc(), c("sort_key").desc(), "entity_id"))
    return ranked.withColumn("place", place).where(c("place") <= k).select("query_id", "section", "entity_id", F.round("score", 6).alias("score"), "place")


def snippet(text: Column, tokens: Column, width: int = 80) -> Column:
    """X-04: about ``width`` letters around the first word of a text that begins with one of the tokens, which is set in brackets."""
    words = F.split(F.coalesce(text, F.lit("")), r"\s+")
    hit = lambda w: F.exists(search_tokens(w), lambda x: F.exists(tokens, lambda t: x.startswith(t)))
    at = F.coalesce(F.get(F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull()), 0), F.lit(0))
    low = F.greatest(at - 5, F.lit(0))
    shown = F.transform(F.slice(words, low + 1, 16), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.when(low > 0, "…").otherwise(""), F.substring(F.array_join(shown, " "), 1, width + 40))


def search_results(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """X-05: ``hits`` of ``search`` with title and content of the document, a snippet, and how many hits the section has among them."""
    tokens = queries.select("query_id", F.flatten(F.transform(parse_search_query(F.col("text")), lambda t: t["tokens"])).alias("_tokens"))
    shown = hits.join(docs.select("section", "entity_id", "title", "content", "phone_digits"), ["section", "entity_id"]).join(tokens, "query_id")
    shown = shown.withColumns({"snippet": snippet(F.concat_ws(" ", "title", "content", "phone_digits"), F.col("_tokens")), "section_total": F.count("*").over(Window.partitionBy("query_id", "section"))})
    return shown.drop("_tokens", "phone_digits")

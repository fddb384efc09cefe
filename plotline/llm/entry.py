"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import langid

    return langid.identify(_docs(spark, sf_dir))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import bitpack

    return bitpack.round_trip(_docs(spark, sf_dir))


def op3_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import nbest

    found = nbest.segment(_docs(spark, sf_dir))
    return found.select(
        "doc_id", "rank", "score", (F.length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import packing

    return packing.pack(_docs(spark, sf_dir))


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import sketches

    return sketches.edited_pairs(_docs(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import exact_dedup

    return exact_dedup.duplicates(_docs(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import simhash

    found = simhash.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import html_extract

    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import licenses

    return licenses.summary(licenses.scan(_docs(spark, sf_dir)))


def op8_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import chat

    says = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(turns))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import collocations

    return collocations.collocations(_docs(spark, sf_dir))


def op12_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import prefix_join

    return prefix_join.similar_sets(_docs(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plotline.llm import alignment

    return alignment.alignment(_docs(spark, sf_dir))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_blocks": op2_token_blocks,
    "op3_nbest_pieces": op3_nbest_pieces,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_scaled_sketch": op5_scaled_sketch,
    "op6_license_join": op6_license_join,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_chat_machine": op8_chat_machine,
    "op9_simhash": op9_simhash,
    "op10_html_wrappers": op10_html_wrappers,
    "op11_collocations": op11_collocations,
    "op12_prefix_join": op12_prefix_join,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op8_chat_machine": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(14 + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 ELSE 9 END + length(text) + length(text) - length(replace(text, '\', ''))
                   + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7) AS BIGINT) AS formatted_chars,
               bool_and(CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE role = 'user' END)
                   AND arg_max(role, turn) = 'assistant' AS valid
        FROM s GROUP BY conv_id
    """,
    "op11_collocations": r"""
        WITH d AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                   string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents
        ),
        p AS (SELECT doc, lang, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS x FROM d),
        s AS (SELECT doc, lang, piece, string_split_regex(trim(x, ' ' || chr(9)), '[\x20\x09]+') AS ws FROM p WHERE trim(x, ' ' || chr(9)) <> ''),
        t AS (SELECT doc, lang, piece, generate_subscripts(ws, 1) AS pos, unnest(ws) AS w FROM s),
        g AS (SELECT lang, w AS w1, lead(w) OVER (PARTITION BY doc, piece ORDER BY pos) AS w2, lead(w, 2) OVER (PARTITION BY doc, piece ORDER BY pos) AS w3 FROM t),
        n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
        f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        longer AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        cuts AS (
            SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, l.f AS l, r.f AS r
            FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w2
            LEFT JOIN longer x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2
            WHERE x.most IS NULL OR 100 * x.most < 50 * c.f
            UNION ALL
            SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 1, l.f, r.f
            FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.w1 = c.w1 JOIN f2 r ON r.lang = c.lang AND r.w1 = c.w2 AND r.w2 = c.w3
            UNION ALL
            SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, l.f, r.f
            FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.w1 = c.w1 AND l.w2 = c.w2 JOIN f1 r ON r.lang = c.lang AND r.w1 = c.w3
        ),
        scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
    """,
    "op7_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t
    """,
}

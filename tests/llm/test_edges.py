"""Faults that small tables show: ids beside nulls, clashing names, letters, short texts, repeated rows."""

import random
from collections import Counter

import pytest

BIG = (1 << 60) + 1
TEXTS = ["the cat sat on the mat", "", None, "under the MIT license the dog ran", "the cat  sat on the mat"]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(BIG, TEXTS[0]), (None, TEXTS[3]), (BIG + 2, TEXTS[1]), (7, TEXTS[2]), (BIG + 4, TEXTS[4])]
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(1)


def test_large_ids_beside_null(spark, wide):
    from plotline.llm import bitpack, chat, exact_dedup, langid, licenses, nbest, packing, simhash, sketches

    want = {BIG, None, BIG + 2, 7, BIG + 4}
    for found in (
        langid.identify(wide), bitpack.round_trip(wide), nbest.segment(wide), packing.pack(wide), sketches.edited_pairs(wide), licenses.scan(wide),
        exact_dedup.duplicates(wide), simhash.near_duplicates(wide), simhash.similar_groups(wide),
    ):
        assert {r.doc_id for r in found.select("doc_id").collect()} == want
    turns = spark.createDataFrame([(BIG, 0, "user", "a"), (BIG, 1, "assistant", "b"), (None, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.valid) for r in chat.read_back(chat.format_turns(turns)).collect()} == {(BIG, True), (None, False)}


def test_clashing_names(spark):
    from plotline.llm import exact_dedup, langid, simhash

    names = "doc_id long, text string, lang string, score long, _score long, lang_pred string, _lang_pred string, row long, id long, digest string, n long, key long, component_id long, _drop long"
    rows = [(i, "the cat sat on the mat", "en", 1, 2, "a", "b", 3, 4, "c", 5, 6, 7, 8) for i in range(3)]
    df = spark.createDataFrame(rows, names)
    for f in (langid.keep_identified, exact_dedup.drop_duplicates, simhash.drop_similar):
        got = f(df)
        assert got.columns == df.columns and got.collect()[0].asDict() == df.where("doc_id = 0").first().asDict()
    assert exact_dedup.drop_duplicates(df).count() == simhash.drop_similar(df).count() == 1


def test_near_copies_under_one_id(spark):
    from plotline.llm import simhash

    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(5, a), (5, b), (3, a + " x"), (None, b + " y"), (None, "z z"), (None, None), (8, "")]
    got = {(r.doc_id, r.text) for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, a + " x"), (5, b), (None, "z z"), (8, "")}
    assert [simhash.table_bits(n) for n in (10**6, 10**9, 10**13)] == [32, 48, 64]


@pytest.mark.parametrize("bits", [32, 48, 64])
def test_simhash_tables(spark, bits):
    from plotline.llm import simhash

    rng = random.Random(bits)
    prints = []
    for _ in range(30):
        x = rng.getrandbits(192)
        prints += [x, x ^ (1 << rng.randrange(192)) ^ (1 << rng.randrange(192))]
    split = lambda x: [v - (1 << 64) if v >> 63 else v for v in (x >> 64 * k & (1 << 64) - 1 for k in range(3))]
    got = {tuple(r) for r in simhash.simhash_pairs(spark.createDataFrame([(i, *split(x)) for i, x in enumerate(prints)], "key long, f0 long, f1 long, f2 long"), bits).collect()}
    assert {(i, i + 1) for i in range(0, 60, 2)} <= got
    near = lambda a, b: any(((prints[a] ^ prints[b]) >> bits * t & (1 << bits) - 1).bit_count() <= 2 for t in range(192 // bits))
    assert all(near(a, b) for a, b in got)


def test_numbers_are_no_letters(spark):
    from plotline.llm import langid

    long = "ab" * 3000
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("½ ²", None), ("Ⅷ 12", None), ("a½b", "en"), ("the cat", "en"), ("le chat", "fr"), (long, "fr"), ("世界", "zh")] * 8)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1)) and got[2].lang_pred == got[3].lang_pred == "en" and got[5].lang_pred == "fr" and got[6].lang_pred == "zh"
    assert [w for r in langid._RUN.findall("a½b Ⅷc²世d_é9") for w in langid.letters(r)] == ["a", "b", "c", "世d", "é"]


def test_em_equals_brute_force():
    from plotline.llm import langid

    path = langid.default_vocabulary()
    pieces = langid.vocabulary(path)
    number = {x: i for i, x in enumerate(pieces)}
    words, counts = ["▁the", "▁then", "▁at", "▁hé"], [5.0, 2.0, 3.0, 1.0]
    p = dict.fromkeys(range(len(pieces)), 1 / len(pieces)) | {len(pieces): langid.UNKNOWN_P}

    def ways(w):
        if not w:
            yield []
        for j in range(1, len(w) + 1):
            k = number.get(w[:j], len(pieces) if j == 1 else None)
            if k is not None:
                yield from ([k, *x] for x in ways(w[j:]))

    for _ in range(2):
        got: Counter = Counter()
        for w, n in zip(words, counts):
            score = {tuple(x): 1.0 for x in ways(w)}
            for x in score:
                for k in x:
                    score[x] *= p[k]
            for x, v in score.items():
                for k in x:
                    got[k] += n * v / sum(score.values())
        total = sum(v for k, v in got.items() if k < len(pieces)) + 0.01 * len(pieces)
        p |= {k: max((got[k] + 0.01) / total, langid.FLOOR_P) for k in range(len(pieces))}
    import numpy as np

    fit = langid.fit_language(words, np.array(counts), path, rounds=2)
    assert np.allclose(fit[:-2], [p[k] for k in range(len(pieces))]) and fit[-1] == 0


def test_sketches_equal_brute_force(spark):
    from pyspark.sql import functions as F

    from plotline.llm import sketches as s

    rng = random.Random(9)
    word = [f"w{i}" for i in range(5000)]
    book = [rng.choice(word) for _ in range(3000)]
    rows = []
    for i in range(40):
        a = book[i * 50 : i * 50 + rng.choice([7, 40, 80, 500])]
        rows.append((i, " ".join(a), " ".join(book if i % 2 else [rng.choice(word) for _ in range(rng.choice([1, 30, 900]))])))
    rows += [(40, "", ""), (41, "", "a b"), (42, "a b", "a b")]
    df = spark.createDataFrame([(i, a.split(), b.split()) for i, a, b in rows], "i int, a array<string>, b array<string>")
    df = df.select("i", s._hashes(F.col("a"), s.SHINGLE).alias("ha"), s._hashes(F.col("b"), s.SHINGLE).alias("hb"))
    df = spark.createDataFrame(df.collect(), df.schema).select("i", "ha", "hb", s.sketch(F.col("ha")).alias("a"), s.sketch(F.col("hb")).alias("b"))
    df = spark.createDataFrame(df.collect(), df.schema)
    got = df.select("i", "ha", "hb", "a", "b", s.containment(F.col("a"), F.col("b")).alias("c"), s.merged(F.col("a"), F.col("b")).alias("m")).collect()
    limit = -(1 << 63) + (1 << 64) // s.SCALE
    keep = lambda h: {x for x in h if x < limit}
    none = 0
    for r in got:
        assert (r.a.words, set(r.a.hashes), r.b.words, set(r.b.hashes)) == (bool(r.ha), keep(r.ha), bool(r.hb), keep(r.hb)) and r.a.hashes == sorted(r.a.hashes)
        assert (r.m.words, set(r.m.hashes)) == (bool(r.ha or r.hb), keep({*r.ha, *r.hb}))
        p, q = keep(r.ha), keep(r.hb)
        want = 1.0 if not r.ha and not r.hb else 0.0 if not r.ha or not r.hb else len(p & q) / min(len(p), len(q)) if p and q else None
        assert r.c == want
        none += want is None
        if r.i < 40 and r.i % 2:
            assert r.c in (1.0, None)  # a passage of the book
    assert none


def test_exact_copies_leave_one_row(spark):
    from plotline.llm import exact_dedup

    rows = [(5, "a b c", 1), (5, "a  b c", 2), (3, "x y", 3), (5, "x y", 4), (None, "a b c", 5), (None, "zz", 6), (None, "zz", 7), (9, None, 8), (9, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(4)
    for bits in (64, 2):
        got = [(r.doc_id, " ".join((r.text or "").split())) for r in exact_dedup.drop_duplicates(df, bits=bits).collect()]
        assert sorted(got, key=str) == sorted([(5, "a b c"), (3, "x y"), (None, "zz"), (9, "")], key=str)
    assert exact_dedup.drop_duplicates(df.limit(0)).count() == 0


def test_license_filters_prune_and_lose_nothing():
    from plotline.llm import licenses

    rng = random.Random(2)
    common = "the of this work is under a license you may use software and to in".split()
    table = licenses.Templates(licenses.TEMPLATES, {w.encode(): 1000 - i for i, w in enumerate(common)})
    matched = 0
    for _ in range(300):
        words = [rng.choice([*common, "general", "public", "gnu", "foo"]).encode() for _ in range(rng.randint(1, 80))]
        if rng.random() < 0.3:
            label, text = rng.choice(licenses.TEMPLATES)
            at = rng.randint(0, len(words))
            words[at:at] = [w.encode() for w in text.split() if rng.random() < 0.97]
        want = set()
        for label, bag, _, least, window in table.items:
            if any((Counter(words[i : i + window]) & bag).total() >= least for i in range(max(1, len(words) - window + 1))):
                want.add(label)
        assert {s.label for s in table.spans(words)} == want
        matched += bool(want)
    seen = table.seen
    assert matched > 50 and seen["prefix"] > seen["length"] > seen["positional"] > 0


def test_tables_made_once_spare_memory_and_disk(spark):
    """Batches to Python workers are bounded in bytes, shuffle files go with the job that made them, and settings are restored."""
    import time
    from pathlib import Path

    import pandas as pd
    from pyspark.sql import functions as F

    from plotline.llm import common

    def rows_of_batches(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    names = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [spark.conf.get(x, None) for x in names]
    folder = Path(spark.conf.get("spark.local.dir", "/tmp"))
    files = lambda: set(folder.glob("blockmgr-*/*/shuffle_*.data"))
    for made in (common.durable, lambda df: common.written(df, "test")):
        texts = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
        sizes = [r.n for r in made(texts.mapInPandas(rows_of_batches, "n long")).collect()]
        assert sum(sizes) == 2000 and max(sizes) * 10_000 <= common.BATCH_BYTES * 1.1
        old = files()
        found = made(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
        for _ in range(50):
            if not files() - old:
                break
            time.sleep(0.2)
        assert not files() - old
        assert found.agg(F.sum("n")).first()[0] == 10_000
        assert [spark.conf.get(x, None) for x in names] == before


def test_remembered_chunks_are_bounded(monkeypatch):
    """Ids do not depend on what is forgotten, and a worker remembers two generations of chunks at most."""
    from plotline.llm import tokens

    assert tokens.CACHE_CHUNKS * 2 <= 500_000
    path = tokens.public_path("byte_bpe_50k.json")
    text = " ".join(f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)}, größe{chr(97 + i % 7)} naïve" for i in range(200))
    want = tokens._tokenizer(path).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 50)
    encode = tokens.ChunkEncoder(path, tokens.space_chunks)
    found = encode([text])[0]
    assert len(encode) <= 51 and len(encode.older) <= 51
    assert [int.from_bytes(found[i : i + 4], "little") for i in range(0, len(found), 4)] == want


def test_ranks_of_an_index_add_one_array():
    import tracemalloc

    import numpy as np

    from plotline.llm.collocations import FMIndex

    n = 1 << 20
    ids = np.random.default_rng(1).integers(0, 1000, n, np.int32)
    index = FMIndex(ids, 2)
    tracemalloc.start()
    found = index.rank(np.array([5, 7]), np.array([1000, n]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * 1.5
    assert found.tolist() == [int((index.bwt[:1000] == 5).sum() + (index.bwt < 5).sum()), int((index.bwt <= 7).sum())]


def test_pairs_that_share_many_shingles_meet_about_once(spark):
    """Every pair of unlike texts that the bounds admit is listed, but not at each of the shingles that it shares."""
    import numpy as np

    from plotline.llm import simhash

    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(w if rng.random() > 0.015 else f"x{k}n{i}" for i, w in enumerate(base)) for k in range(30)]
    hashes = [simhash._gram_hashes(t) for t in texts]
    heads = [h[: simhash._head(len(h))] for h in hashes]
    rows = [
        (int(np.int64(np.uint64(g))), k, k, pos, len(hashes[k]), [int(np.int64(x)) for x in h[max(0, pos - simhash.AHEAD) : pos].view(np.int64)], *simhash._parity(hashes[k]).tolist())
        for k, h in enumerate(heads) for pos, g in enumerate(h)
    ]
    member = spark.createDataFrame(rows, f"gram long, key long, part long, pos int, size int, ahead array<long>, {', '.join(f'{p} long' for p in simhash.PARITY)}")
    got = simhash.met_once(member.select("gram", "key", "part", "pos", "size", "ahead", *simhash._folded())).select("key", "key_2").collect()
    want, shared = set(), 0
    folded = [np.bitwise_xor.reduce(simhash._parity(h).reshape(4, 4), axis=0) for h in hashes]
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            apart = len(np.setxor1d(hashes[a], hashes[b]))
            bits = [sum(int(x).bit_count() for x in (m ^ n).view(np.uint64)) for m, n in ((folded[a], folded[b]), (simhash._parity(hashes[a]), simhash._parity(hashes[b])))]
            assert bits[0] <= bits[1] <= apart
            for g in set(heads[a].tolist()) & set(heads[b].tolist()):
                p, q = heads[a].tolist().index(g), heads[b].tolist().index(g)
                m, n = len(hashes[a]), len(hashes[b])
                if min(m - p, n - q) * 9 >= (m + n) * 4 and min(m, n) * 5 >= max(m, n) * 4 and bits[0] * 9 <= m + n:
                    want.add((a, b))
                    shared += 1
    assert {tuple(r) for r in got} == want and len(want) > 100
    assert len(got) < 2 * len(want) < shared / 4


def test_index_of_phrases_adds_one_wide_array():
    """An index is built with one 64-bit array of the shard's length beside its transform, and orders rows as a sort by columns does."""
    import tracemalloc

    import numpy as np

    from plotline.llm.collocations import FMIndex

    rng = np.random.default_rng(3)
    ids = rng.integers(0, 5000, 2_000_000).astype(np.int32)
    tracemalloc.start()
    built = FMIndex(ids, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 14 * len(ids)
    few = ids[:3000] % 7
    for some, depth in ((few, 1), (few, 2), (few, 3), (few[:1], 2)):
        columns = [np.concatenate([some[k:], np.zeros(min(k, len(some)), some.dtype)]) for k in range(depth)]
        assert np.array_equal(FMIndex(some, depth).bwt, some[np.lexsort(columns[::-1]) - 1])
    assert len(built.bwt) == len(ids)

"""Each operator on small tables, against brute force or an exact round trip."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the cat sat on the mat and then it went to the house with other animals of that kind "
FR = "le chat est sur la maison et puis il va vers les autres animaux de cette sorte avec nous "


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(60):
        words = (EN if i % 2 else FR).split()
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 120)))
        out.append((i, text, "en" if i % 2 else "fr", "s", len(text)))
    out += [
        (60, None, None, None, None), (61, "", "en", "s", 0), (62, " \n\t ", "en", "s", 4), (63, "12 34 --", "en", "s", 8), (64, out[0][1], "fr", "s", 1),
        (65, out[0][1].replace(" ", " \n "), "fr", "s", 1), (66, "x" * 5000, "en", "s", 5000), (67, " ".join(f"w{k % 997}" for k in range(30000)), "en", "s", 1),
        (68, "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.", "en", "s", 1),
        (5, out[5][1], "en", "s", 1), (69, "é ́ 世界 😀 <|endoftext|> don't", "fr", "s", 1),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    from tokenizers import Tokenizer

    from plotline.llm.tokens import public_path

    t = Tokenizer.from_file(public_path(name))
    t.encode_special_tokens = True
    return t


def test_language(docs, empty, rows):
    from plotline.llm import langid

    got = langid.identify(docs).toPandas()
    assert len(got) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    assert dict(zip(got.doc_id, got.held_out)) == held
    lang = dict(zip(got.doc_id, got.lang_pred))
    assert all(lang[i] == ("en" if i % 2 else "fr") for i in range(60))
    assert all(lang[i] == "und" for i in (60, 61, 62, 63)) and got.score.between(0, 1).all()
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs.drop("source").withColumnRenamed("n_chars", "score"))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and {60, 61, 62, 63}.isdisjoint({r[0] for r in kept.select("doc_id").collect()})


def test_forward_sums_all_segmentations():
    from plotline.llm.langid import default_vocabulary, forward, lattice, vocabulary

    path = default_vocabulary()
    pieces = vocabulary(path)
    p = np.random.default_rng(1).random((len(pieces) + 2, 2)) * 1e-3
    p[-1] = 0
    number = {x: i for i, x in enumerate(pieces)}
    for word in ("▁the", "▁cats", "▁ñandu", "▁x" + "ab" * 20):
        def total(i, k):
            if i == len(word):
                return 1.0
            out = 0.0
            for j in range(i + 1, min(len(word), i + 16) + 1):
                at = number.get(word[i:j], len(pieces) if j == i + 1 else None)
                if at is not None:
                    out += p[at, k] * memo(j, k)
            return out

        cache = {}

        def memo(i, k):
            if (i, k) not in cache:
                cache[i, k] = total(i, k)
            return cache[i, k]

        assert np.allclose(forward(lattice([word], path), p)[0], [np.log(memo(0, k)) for k in (0, 1)])


def test_chunked_tokens_equal_whole_texts():
    from plotline.llm import tokens

    rng = random.Random(3)
    parts = [" ", "  ", "\n", "a", "B", "é", "'s", "1", "!", "\t", "\xa0", "\x1c", "\u0301", "\r", "ß", "世", "\u200b", "|", "word", "Mot"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for name, cut in (("word_bpe_49k.json", tokens.word_chunks), ("byte_bpe_50k.json", tokens.space_chunks)):
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer(name).encode_batch(texts, add_special_tokens=False)]
        assert tokens.ChunkEncoder(tokens.public_path(name), cut)(texts) == want


def test_token_blocks(spark, docs, empty, rows):
    from plotline.llm import bitpack
    from plotline.llm.common import shared_path

    t = tokenizer("word_bpe_49k.json")
    path = shared_path(spark, "test-blocks")
    bitpack.write(docs, path, block_ids=500)
    got = {}
    for r in bitpack.read_documents(spark, path).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, bytes(r.ids)))
    at, stream = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (at, len(ids), ids.tobytes()) in got[i]
        at += len(ids)
        stream.append(ids)
    stream = np.concatenate(stream)
    for a, b in ((0, 10), (490, 1700), (at - 5, at)):
        assert (bitpack.read_range(spark, path, a, b) == stream[a:b]).all()
    assert bitpack.round_trip(empty).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31])
def test_pack_bits(bits):
    from plotline.llm.bitpack import pack, unpack

    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001).astype("<u4")
    raw = pack(ids, bits)
    assert len(raw) == -(-len(ids) * bits // 8)
    assert (unpack(raw, bits, 0, len(ids)) == ids).all() and (unpack(raw, bits, 65530, 65541) == ids[65530:65541]).all()


def test_nbest_equals_brute_force(docs, empty):
    from plotline.llm import nbest
    from plotline.llm.tokens import public_path

    v = nbest.vocabulary(public_path("piece_bpe_32k.model"))
    encode = nbest.Encoder(public_path("piece_bpe_32k.model"), 4)
    rng = random.Random(2)

    def brute(m, i=0, score=0.0):
        if i == len(m):
            yield score
        for j in range(i + 1, len(m) + 1):
            k = v.number.get(m[i:j])
            if k is not None:
                yield from brute(m, j, score + v.score[k])
            elif j == i + 1:
                yield from brute(m, j, score + nbest.BYTE_SCORE)

    for _ in range(150):
        text = "".join(rng.choice("  theaéon世\n😀x") for _ in range(rng.randint(0, 9)))
        got, want = encode([text])[0], sorted(brute(nbest.marked(text)), reverse=True)[:4]
        assert np.allclose([s for s, *_ in got], want) and len({i for _, i, _ in got}) == len(got)
        assert all(nbest.decode(np.frombuffer(i, "<u4"), v) == text == t for _, i, t in got)
    words = ["▁" + "".join(rng.choice("theaéon世\n😀xabcs") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    together, alone = nbest.viterbi(words, v), [nbest.viterbi([w], v) for w in words]  # filled up to one length, or not
    assert all(np.allclose(a, np.concatenate([x[k] for x in alone])) for k, a in enumerate(together[:2])) and together[2] == [x[2][0] for x in alone]
    found = nbest.segment(docs).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(texts[d] == t for d, t in zip(found.doc_id, found.decoded)) and found[found.doc_id == 60].score.tolist() == [0.0]
    assert nbest.segment(empty).count() == 0


def test_packing_plan():
    from plotline.llm.packing import plan

    rng = random.Random(3)
    for _ in range(150):
        capacity, counts = rng.choice([10, 30, 97]), {}
        for _ in range(rng.randint(1, 60)):
            n = rng.randint(1, capacity)
            counts[n] = counts.get(n, 0) + rng.choice([1, 1, 2, 7, 50])
        runs, n_bins = plan(counts, capacity)
        bins, seen = {}, {}
        for r in runs:
            for i in range(r.n):
                bins.setdefault(r.bin + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
                seen.setdefault(r.length, set()).add(r.first + i)
        assert {k: len(s) for k, s in seen.items()} == counts and set(bins) == set(range(n_bins))
        for items in bins.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= capacity
        assert n_bins <= 1.25 * sum(k * c for k, c in counts.items()) / capacity + 1 + sum(c for k, c in counts.items() if 2 * k > capacity)


def test_packing(docs, empty, rows):
    from plotline.llm import packing

    t = tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs).toPandas()
    ids = {i: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4") for i, text, *_ in rows}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
    for i, x in ids.items():
        assert got[got.doc_id == i].length.sum() == len(x) * sum(r[0] == i for r in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty).count() == 0


def test_sketches(docs, empty, rows):
    from plotline.llm import sketches

    got = sketches.edited_pairs(docs).toPandas()
    order = sorted(((i, t or "") for i, t, *_ in rows))
    want = {}
    for k, (i, text) in enumerate(order):
        cut, after = len(text) // 4, order[(k + 1) % len(order)][1]
        want.setdefault(i, set()).add(hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest())
    assert len(got) == len(rows) and all(s in want[i] for i, s in zip(got.doc_id, got.edited_sha256))
    by = got.drop_duplicates("doc_id").set_index("doc_id")
    assert by.fingerprint[0] == by.fingerprint[64] == by.fingerprint[65] and by.fingerprint[60] == by.fingerprint[61] == ""
    assert by.near_next[64] == 1.0 and by.near_edited[67] > 0.6 and got[["near_edited", "near_next"]].stack().between(0, 1).all()
    assert sketches.edited_pairs(empty).count() == 0


def test_licenses(docs, empty):
    from collections import Counter

    from plotline.llm import licenses

    got = licenses.summary(licenses.scan(docs)).toPandas().drop_duplicates("doc_id").set_index("doc_id")
    assert got.base_labels[68] == "mit" and got.labels[68] == "gpl-3,mit" and (got.n_base[68], got.first_word[68], got.last_word[68]) == (1, 1, 1)
    assert got.labels.drop(68).eq("").all() and got.n_words[60] == 0 and got.score.between(0, 1).all()
    assert licenses.summary(licenses.scan(empty)).count() == 0
    rng, line = random.Random(7), dict(licenses.TEMPLATES)["gpl-3"].split()
    table = licenses.Templates(licenses.TEMPLATES, {b"under": 9})
    for _ in range(400):
        words = [rng.choice([*line, "foo"]).encode() for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5:
            words[rng.randint(0, len(words)) :] += [w.encode() for w in line if rng.random() < 0.95]
        want = {}
        for label, bag, size, least, window in table.items:
            for i in range(max(1, len(words) - window + 1)):
                n = (Counter(words[i : i + window]) & bag).total()
                if n >= least:
                    want[label] = max(want.get(label, 0), n / size)
        found = {}
        for s in table.spans(words):
            found[s.label] = max(found.get(s.label, 0), s.containment)
        assert found == want


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(docs, empty, rows, bits):
    from plotline.llm import exact_dedup

    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    got = exact_dedup.duplicates(docs, bits=bits).toPandas()
    key = {i: k for k, ids in groups.items() for i in ids}
    assert len(got) == len(rows)
    for r in got.itertuples():
        ids = groups[key[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(ids), len(ids), r.doc_id == min(ids)) and r.text_sha256 == hashlib.sha256(key[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_duplicates(docs, bits=bits)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {min(i) for i in groups.values()}
    assert exact_dedup.duplicates(empty).count() == 0


def test_chat(spark):
    from plotline.llm import chat

    t = chat.Template()
    rng = random.Random(1)
    parts = ["\\", "###", "#", "</turn>", "<", "/turn>", "\n", "a", " ", "### Assistant:\n", "é"]
    data = []
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            data.append((conv, turn, rng.choice(["user", "assistant", "system", 'x"y:\n', None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))])))
    data += [(50, 0, "user", "hi"), (50, 1, "assistant", "ho"), (None, None, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[50].valid and got[50].loss_chars == 2 and None in got
    for conv in range(40):
        turns = [(r or "", x or "") for c, _, r, x in data if c == conv]
        assert t.parse("".join(s for r, x in turns for s, _ in t.segments(r, x))) == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        state, ok = "", True
        for role, _ in turns:
            state, allowed = t.step(state, role)
            ok &= allowed
        assert r.valid == (ok and state in t.accepts)
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_simhash(spark, docs, empty):
    from plotline.llm import simhash

    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(60):
        x = rng.choice(fps)
        fps.append(x ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(1) << rng.randrange(64)))
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    parts = {r.node: r.label for r in simhash.components(edges).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert all(parts.get(x, x) == find(x) for x in signed)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[0].component_id == got[64].component_id == got[65].component_id == 0 and got[61].fp == got[60].fp == 0 and got[62].component_id == 60
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_groups(empty).count() == 0


def test_similar_groups(spark):
    from plotline.llm import simhash

    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    data, group = [], {}
    for i in range(30):
        base = [rng.choice(words) for _ in range(250)]
        for k in range(3):
            copy = list(base)
            for _ in range(2 * k):
                copy[rng.randrange(250)] = rng.choice(words)
            group[len(data)] = i
            data.append((len(data), " ".join(copy)))
    data.append((len(data), None))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert all(got[i] in range(3 * g, i + 1) for i, g in group.items())
    assert sum(got[i] == 3 * g for i, g in group.items()) >= 86
    assert 31 <= simhash.drop_similar(df).count() <= 35


def brute_groups(texts):
    """Smallest index of each text's group: links at a five-word similarity of 0.8 or more, followed."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for w in (t.split() for t in texts)]
    label = list(range(len(sets)))
    for b in range(len(sets)):
        for a in range(b):
            if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def test_similar_groups_interleaved(spark):
    from plotline.llm import simhash

    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    shared = [rng.choice(words) for _ in range(150)]
    families = [[rng.choice(words) for _ in range(60)] for _ in range(5)]
    texts = []
    for _ in range(24):  # families with one passage, one after another by doc_id
        for f in families:
            own = list(f)
            own[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(shared + own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_similar_groups_block_and_scattered_edits(spark):
    from plotline.llm import simhash

    rng = random.Random(12)
    words = [f"w{i}" for i in range(20000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(300)]
        texts.append(" ".join(base))
        texts.append(" ".join(base + [rng.choice(words) for _ in range(70)]))  # 0.81
    for _ in range(60):
        base = [rng.choice(words) for _ in range(300)]
        copy = list(base)
        for i in rng.sample(range(300), 13):
            copy[i] = rng.choice(words)
        texts += [" ".join(base), " ".join(copy)]  # about 0.65
    want = brute_groups(texts)
    assert sum(want[i] < i for i in range(120)) == 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_html(spark):
    from plotline.llm import html_extract as h

    cases = {
        '<html><body><div class="menu"><a href="/">Home</a></div><div id="content"><h1>T</h1><p>a <b>b</b>c<br>d &amp;lt; &nbsp; e</p><div class="comments"><p>nice</p></div><ul><li>x<li>y</ul></div></body></html>': "T a bc d &lt; e x y",
        '<article><header><h1>Hi</h1></header><p>x<p>y<aside>no</aside><form>f<input></form><section class="comments"><article>c</article></section></article><div class="ad">zz</div>': "Hi x y",
        "": "", "no markup < 3 & 5 > 2": "no markup < 3 & 5 > 2", "<div><p>a<div>b</div>c</div>": "a b c",
        '<article><p>A<script>if(a<b){document.write("</p>")}</script>B</p><!-- x --><style>p{}</style><table><tr><td>1<td>2</table></article>': "A B 1 2",
    }
    for html, want in cases.items():
        assert h.main_text(h.parse(html)) == want
    page = lambda i: f"<body><div><p>Welcome to us</p><div>{''.join(f'<p>story {i} {k}</p>' for k in range(1 + i % 3))}</div><h4>All rights</h4></div></body>"
    data = [(i, "http://a.example/x", page(i)) for i in range(9)] + [(20, None, None), (21, "http://b.example", "<article>z</article>"), (21, "http://b.example", "<article>z</article>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(df).collect()}
    assert all(got[i][0] == " ".join(f"story {i} {k}" for k in range(1 + i % 3)) for i in range(9)) and got[20] == ("", 0) and got[21] == ("z", 1)
    assert h.extract(df).count() == len(data) and h.extract(df.limit(0)).count() == 0
    (wrapper,) = [r.wrapper for r in h.wrappers(h.parsed(df.where("page_id < 9"))).collect()]
    assert "(<p>((#)?)+</p>)+" in h.expression(wrapper) and "|" not in h.expression(wrapper)


def test_html_long_texts_with_one_start(spark):
    from plotline.llm import html_extract as h

    lead = "The standing lead of this host, word for word the same on every page. " * 4
    page = "<html><body><div class='x'><h1>Host notice</h1></div><div class='y'><p>{}</p></div><div class='z'><h2>{}</h2></div></body></html>"
    data = [(i, f"https://a.example/{i}", page.format(f"{lead}Then number {i} goes its own way.", f"Other text {i}")) for i in range(6)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert all(got[i] == f"{lead}Then number {i} goes its own way. Other text {i}" for i in range(6))


def test_pipeline(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    kept = set(got.doc_id)
    assert {60, 61, 62, 63, 64, 65}.isdisjoint(kept) and {0, 67, 68} <= kept
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "best_fit_packing"]

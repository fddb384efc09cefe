"""Operators 11 to 13 against brute force: counts and scores of phrases, links of sets, groups and links of tokens."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, id long, key string, words string, row long, gram long, size long, part long, shard long, n long, c long, pair long, groups string"


def with_clashes(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "w", 1, 2, 3, 4, 5, 6, 7, 8, "g") for r in rows], SCHEMA)


# operator 11


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def phrases_by_hand(rows, least=10, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in count.items() if len(q) > len(p) and b * 100 >= share * a):
                continue
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["a", "B", "the", "New", "york", "ÄB", "x y", "día", "zz", "*"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "!"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None])) for i in range(120)]
    return rows + [(500, None, "en"), (501, "", None), (502, " .,;", "de"), (3, "new york the new york", "en"), (3, "new york the new york", "en"), (503, "New York " * 3000, "fr")]


def test_phrases_equal_brute_force(spark, monkeypatch):
    from plotline.llm import collocations

    rows = phrase_rows()
    df = with_clashes(spark, rows).repartition(3)
    want = phrases_by_hand(rows)
    assert sorted(map(tuple, collocations.collocations(df).collect())) == sorted(want) and len(want) > 20
    assert sorted(map(tuple, collocations.collocations(df, least=4, top=7, share=80).collect())) == sorted(phrases_by_hand(rows, 4, 7, 80))
    assert collocations.collocations(df.limit(0)).collect() == []


@pytest.mark.parametrize("depth", [2, 3, 4, 5])
def test_intervals_count_every_phrase(depth, monkeypatch):
    """Extension to the left and right by both transforms, over few or many rows at a time, counts all phrases within the separators."""
    from plotline.llm import collocations

    for seed in range(60):
        rng = random.Random(seed)
        monkeypatch.setattr(collocations, "ROWS", rng.choice([1, 3, 1000]))
        ids = [rng.randint(0, rng.randint(1, 5)) for _ in range(rng.randint(0, 60))]
        want = Counter(tuple(ids[i : i + k]) for k in range(2, depth + 1) for i in range(len(ids) - k + 1) if 0 not in ids[i : i + k])
        got = [(tuple(p), c) for phrases, counts in collocations.enumerate_phrases(np.array(ids, np.int32), depth) for p, c in zip(phrases.tolist(), counts.tolist(), strict=True)]
        assert len(got) == len(want) and dict(got) == want


def test_shards_do_not_matter(spark):
    from plotline.llm import collocations

    df = with_clashes(spark, phrase_rows())
    parts = collocations.shards(df.repartition(2), size=50).collect()
    assert len(parts) > 10 and len({p.shard for p in parts}) == len(parts)
    assert sum(map(sum, (p.counts for p in parts))) == sum(r.n for r in collocations.frequent_phrases(df, least=1)[0].select("lang", "n").distinct().collect())


# operator 12


def sets_by_hand(rows):
    sets = []
    for _, text, *_ in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(text or "")) if x]
        sets.append(frozenset(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))) if w else frozenset())
    unlike = sorted({s for s in sets if s}, key=len)
    group = list(range(len(unlike)))

    def of(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(unlike):
        for j in range(i + 1, len(unlike)):
            if 10 * len(a) < 9 * len(unlike[j]):
                break
            both = len(a & unlike[j])
            if 100 * both >= 90 * (len(a) + len(unlike[j]) - both):
                group[of(i)] = of(j)
    at = {s: of(i) for i, s in enumerate(unlike)}
    low = {}
    for (doc, *_), s in zip(rows, sets, strict=True):
        if s:
            low[at[s]] = min(low.get(at[s], doc), doc)
    return Counter((doc, len(s), low[at[s]] if s else doc) for (doc, *_), s in zip(rows, sets, strict=True))


def set_rows():
    rng = random.Random(3)
    word = lambda: str(rng.randint(0, 10**6))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(150):  # near copies, some longer, so that chains form
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((k, " ".join(w + base[: rng.randint(0, 8)]), "en"))
    for k in range(60):  # a shared passage in unlike texts
        rows.append((1000 + k, " ".join([word() for _ in range(rng.randint(5, 80))] + passage + [word() for _ in range(rng.randint(0, 40))]), "de"))
    for k in range(120):  # short ones, with ties and equal texts
        rows.append((2000 + k, " ".join(rng.choice("ABab") for _ in range(rng.randint(0, 6))), None))
    return rows + [(7, None, "en"), (5000, "", "en"), (5001, " \n ", "en"), (5, rows[0][1], "en"), (5, rows[0][1], "en"), (6000, " ".join(map(str, range(30000))), "en"), (6001, " ".join(map(str, range(29000))), "en")]


@pytest.mark.parametrize("chunk", [None, 400])
def test_prefix_join_equals_all_pairs(spark, monkeypatch, chunk):
    from plotline.llm import prefix_join

    if chunk:  # blocks of many tasks, in two rounds
        monkeypatch.setattr(prefix_join, "CHUNK", chunk)
    rows = set_rows()
    got = prefix_join.similar_sets(with_clashes(spark, rows).repartition(3))
    assert Counter(map(tuple, got.collect())) == sets_by_hand(rows)


def test_prefix_join_of_nothing(spark):
    from plotline.llm import prefix_join

    df = with_clashes(spark, [(1, None, None), (2, "", "en"), (None, "a b c d", "en"), (9, "a b c d", "en")])
    assert Counter(map(tuple, prefix_join.similar_sets(df).collect())) == Counter({(1, 0, 1): 1, (2, 0, 2): 1, (None, 2, 9): 1, (9, 2, 9): 1})
    assert prefix_join.similar_sets(df.limit(0)).collect() == []


def test_trie_joins_what_is_similar():
    """Groups by one traversal for each set equal those of all pairs."""
    from plotline.llm.prefix_join import Trie

    for seed in range(80):
        rng = random.Random(seed)
        base = sorted(rng.sample(range(60), rng.randint(1, 40)))
        sets = {tuple(sorted(set(base) - set(rng.sample(base, min(len(base) - 1, rng.randint(0, 3)))) | set(rng.sample(range(60), rng.randint(0, 2))))) for _ in range(40)}
        sets = [np.array(s, np.int64) for s in sorted(sets, key=lambda s: (len(s), s))]
        trie = Trie(sets, 60)
        for i in range(len(sets)):
            trie.probe(i)
            trie.insert(i)
        group = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
        pairs = lambda of: {(i, j) for i in range(len(sets)) for j in range(i) if of(i) == of(j)}
        assert pairs(trie.group) == pairs(group.__getitem__), seed


# operator 13


def aligned_by_hand(texts):
    """Whole texts, each byte's token on both sides."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of_char = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    out, docs = [], Counter()
    for x in texts:
        a, b = (bpe.encode(" " + x, add_special_tokens=False).ids, model.encode(x)) if x else ([], [])
        a_bytes = [bytes(of_char[c] for c in bpe.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not x or not b"".join(a_bytes) == (" " + x).encode() == b"".join(b_bytes):
            out.append(None)
            continue
        side_a, side_b = ([k for k, piece in enumerate(pieces) for _ in piece] for pieces in (a_bytes, b_bytes))
        met = sorted(set(zip(side_a, side_b, strict=True)))
        last = [i for i in range(len(side_a)) if i + 1 == len(side_a) or side_a[i] != side_a[i + 1] and side_b[i] != side_b[i + 1]]
        groups, i, j = [], 0, 0
        for at in last:
            groups.append(",".join(map(str, a[i : side_a[at] + 1])) + "|" + ",".join(map(str, b[j : side_b[at] + 1])))
            i, j = side_a[at] + 1, side_b[at] + 1
        pairs = [(a[p], b[q]) for p, q in met]
        docs.update(set(pairs))
        out.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    return [(0,) * 6 + ("",) if o is None else (*o[:3], len(o[3]), sum(docs[p] == best[p[0]] for p in o[3]), sum(docs[p] for p in o[3]), o[4]) for o in out]


def test_alignment_equals_brute_force(spark, monkeypatch):
    from plotline.llm import alignment

    rng = random.Random(1)
    signs = ["a", "foo", "Bar", " ", " ", "  ", "\n", "\n\n", " \n", "\t", "▁", "é", "日本", "<s>", "<|endoftext|>", "</s>", "'s", "\r", " ", "😀", "12", "!", "...", "ß", "_", "　", "é", "<0x0A>", "***", "$$$,", "don't", "x²", "(y"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += [None, "", " ", "\n", "x" * 5000, "the cat sat on the mat\nand ran away.", "the cat sat on the mat\nand ran away.", "word " * 20000]
    rows = [(i % 1490, t, "en") for i, t in enumerate(texts)]
    want = Counter((i, *w) for (i, *_), w in zip(rows, aligned_by_hand(texts), strict=True))
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    df = with_clashes(spark, rows).repartition(2)
    assert Counter(map(tuple, alignment.alignment(df).collect())) == want
    assert sum(w[1] > 0 for w in want) > 700 and alignment.alignment(df.limit(0)).collect() == []


def test_large_pair_tables_are_joined_by_key(spark, monkeypatch):
    from plotline.llm import alignment, common

    df = with_clashes(spark, [(i, "the cat sat on the mat " * (i % 3 + 1), "en") for i in range(50)])
    want = sorted(map(tuple, alignment.alignment(df).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, alignment.alignment(df).collect())) == want


def test_division_finds_all_common_ends():
    from plotline.llm import alignment

    for seed in range(100):
        rng = random.Random(seed)
        ends_a, ends_b, starts_a, starts_b, want, base = [], [], [0], [0], [], 0
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(0, 30)
            if n:
                a, b = ({base + n} | {base + rng.randint(1, n) for _ in range(rng.randint(0, n))} for _ in range(2))
                want += [len(ends_a) + i for i, x in enumerate(sorted(a)) if x in b]
                ends_a, ends_b, base = ends_a + sorted(a), ends_b + sorted(b), base + n
            starts_a.append(len(ends_a))
            starts_b.append(len(ends_b))
        got = alignment.divide(*(np.array(x, np.int64) for x in (ends_a, ends_b, starts_a, starts_b)))
        assert got.tolist() == want

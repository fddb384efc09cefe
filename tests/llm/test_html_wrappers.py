"""HTML extraction: wrappers, whatever the partitions and the size of pages."""

import random

import pytest


def pages_of(spark, data, parts=3):
    return spark.createDataFrame(data, "page_id long, url string, html string").repartition(parts)


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    """A host with a notice inside the article and a bare box below it, one of few pages, and odd rows."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n))
    out, want = [], {}
    for i in range(40):
        body = [words(rng.randint(8, 30)) + f" {i}" for _ in range(rng.randint(1, 6))]
        inner = "".join(f"<p>{x}</p>" for x in body) + ("<ul><li>one<li>two</ul>" if i % 3 else "")
        html = f"<html><body><div class='box{i}'><p>Visit us {i}</p></div><article><div>House notice: all rights</div><h1>T {i}</h1>{inner}</article><div><p>Same line</p></div></body></html>"
        out.append((i, f"https://a.example/{i}", html))
        want[i] = " ".join([f"T {i}", *body, *(["one", "two"] if i % 3 else [])])
    for i in range(40, 42):
        out.append((i, "https://few.example/x", "<article><div>House notice</div><p>z</p></article>"))
        want[i] = "House notice z"
    out += [(50, None, None), (51, None, ""), ((1 << 60) + 1, "https://a.example/0", out[0][2]), (None, "https://a.example/1", out[1][2])]
    return out, want | {50: "", 51: "", (1 << 60) + 1: want[0], None: want[1]}


def test_the_wrapper_decides(spark, data):
    from plotline.llm import html_extract as h

    rows, want = data
    df = pages_of(spark, rows)
    assert texts(h.extract(df)) == want
    without = texts(h.extract(df, infer=False))
    assert all(without[i] == "House notice: all rights " + want[i] for i in range(40))


def test_partitions_do_not_matter(spark, data, monkeypatch):
    from plotline.llm import common
    from plotline.llm import html_extract as h

    rows, want = data
    monkeypatch.setattr(h, "FAN", 2)  # several levels of groups
    for parts in (1, 4, 16):
        assert texts(h.extract(pages_of(spark, rows, parts))) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)  # joins by key and salt
    assert texts(h.extract(pages_of(spark, rows, 4))) == want


def test_without_articles_the_region_is_inferred(spark):
    from plotline.llm import html_extract as h

    story = lambda i, k: f"story {i} {k} goes on and on " * 9 + "to its end"
    page = lambda i: f"<body><div><p>Hot today: {i * 7}</p></div><div><h1>Title {i}</h1>{''.join(f'<p>{story(i, k)}</p>' for k in range(2 + i % 5))}</div><div><p>Printed {i}</p></div></body>"
    df = pages_of(spark, [(i, "http://c.example/x", page(i)) for i in range(12)])
    assert texts(h.extract(df)) == {i: " ".join([f"Title {i}", *(story(i, k) for k in range(2 + i % 5))]) for i in range(12)}
    (wrapper,) = [r.wrapper for r in h.wrappers(h.parsed(df)).collect()]
    assert "(<p>((#)?)+</p>)+" in h.expression(wrapper) and "|" not in h.expression(wrapper)


def test_long_and_deep_pages(spark):
    from plotline.llm import html_extract as h

    items = lambda i: "".join(f"<h2>head {i} {k}</h2><p>text {i} {k}</p>" for k in range(5000))
    odd = lambda i: "".join(f"<div class='{'abcde'[(k * k + i) % 5]}'><p>part {i} {k}</p></div>" for k in range(3000))
    page = lambda i: f"<body><div><p>Welcome to us</p></div><div>{items(i)}{odd(i)}</div>{'<div>' * 3000}deep {i}</body>"
    got = texts(h.extract(pages_of(spark, [(i, "http://d.example/x", page(i)) for i in range(4)])))
    for i in range(4):
        assert got[i].startswith(f"head {i} 0 text {i} 0 ") and got[i].endswith(f"part {i} 2999") and "Welcome" not in got[i]
        assert got[i].count("text") == 5000 and got[i].count("part") == 3000


def test_common_subsequence():
    from plotline.llm.html_extract import ALIGN_CELLS, common

    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = common(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
    long = [rng.choice("ab") for _ in range(int(ALIGN_CELLS**0.5) + 10)]
    assert len(common(long, long)) == len(long)

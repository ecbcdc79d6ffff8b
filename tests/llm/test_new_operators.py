"""Whitening, main text and ranked search against brute force, on small tables with odd rows."""

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from compare import compare, connect

from rankmill.llm import main_text, qd, search, whitening
from rankmill.llm.queries import ORACLE, QUERIES

RNG = np.random.default_rng(5)


def turned(values, rows=200):
    """A matrix with given singular values."""
    n = len(values)
    left, right = np.linalg.qr(RNG.normal(size=(rows, n)))[0], np.linalg.qr(RNG.normal(size=(n, n)))[0]
    return left @ np.diag(values) @ right


@pytest.mark.parametrize(
    "matrix",
    [
        RNG.normal(size=(300, 40)), RNG.normal(size=(300, 40)) * np.logspace(0, -8, 40), np.repeat(np.eye(20), 3, axis=0),
        turned([1.0] * 20 + [0.5] * 20), turned(1 + 1e-10 * RNG.normal(size=40)), RNG.normal(size=(5, 40)), RNG.normal(size=(9, 1)),
        np.diag(np.ones(21)) + np.diag(np.ones(20), 1), np.zeros((4, 6)), RNG.normal(size=(300, 40)) + 100 * RNG.normal(size=(300, 1)),
    ],
    ids=["random", "graded", "identity", "two_values", "close", "low_rank", "one", "toeplitz", "zero", "one_large"],
)
def test_singular_values_and_directions(matrix):
    dim = matrix.shape[1]
    r = np.zeros((dim, dim))
    own = np.linalg.qr(matrix, mode="r")
    r[: len(own)] = own
    values, directions = qd.singular(r, 16)
    want = np.linalg.svd(matrix, compute_uv=False)[:16] ** 2
    want = np.concatenate([want, np.zeros(min(16, dim) - len(want))])
    top = max(want.max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-10
    assert np.abs(matrix.T @ (matrix @ directions) - directions * values).max() <= 1e-12 * top


VECTORS = "vec_id long, embedding array<float>, component int, n string, x int"


def whitened_by_hand(rows, count=16):
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows]
    listed = np.array(sorted({tuple(x) for _, x in usable}), np.int64)
    n, s = len(listed), listed.sum(axis=0)
    centred = (listed * n - s) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1][:count], vector[:, ::-1][:, :count]
    out = {}
    for i, x in usable:
        off = [n * a - b for a, b in zip(x, s.tolist(), strict=True)]
        out[i] = (n, sum(o * o for o in off), (np.array(off) / n) @ vector / np.sqrt(value))
    return out, value / np.trace(centred.T @ centred / n)


def test_whitening_by_hand(spark):
    base = [(i, [float(np.float32(x)) for x in RNG.normal(size=24) * np.linspace(2, 0.5, 24)]) for i in range(300)]
    base += [(1000 + i, base[0][1]) for i in range(150)]  # a vector of a third of all rows
    odd = [(1, None), (2, []), (3, [1.0] * 23 + [None]), (4, [float("nan")] * 24), (5, [float("inf")] * 24), (6, [1.0, 2.0])]
    rows = [(i, v, 1, "n", 2) for i, v in [*base, *odd, (None, base[3][1])]]
    frame = spark.createDataFrame(rows, VECTORS).repartition(37)  # more parts than one level of triangles joins
    got = whitening.whitened(frame).toPandas()
    assert len(got) == 16 * 451
    want, explained = whitened_by_hand(base)
    for i, g in got.dropna(subset="vec_id").groupby("vec_id"):
        g = g.sort_values("component")
        n, deviation, y = want[int(i)]
        assert (g["n"] == n).all() and (g["deviation"] == deviation).all() and n == 300
        assert np.allclose(np.abs(g["whitened"]), np.abs(y), rtol=1e-8, atol=1e-9)
        assert np.allclose(g["explained"], explained, rtol=1e-10) and (g["identity_error"] < 1e-10).all()
    signs = got.dropna(subset="vec_id").assign(want=lambda t: [want[int(i)][2][c - 1] for i, c in zip(t["vec_id"], t["component"], strict=True)])
    for _, g in signs.groupby("component"):  # one sign for all rows
        assert abs(np.corrcoef(g["whitened"], g["want"])[0, 1]) > 1 - 1e-9


def test_whitening_of_few_and_no_vectors(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(7, [0.5, 0.25, 0.0], 1, "n", 2)] * 3, VECTORS)).toPandas()
    assert len(one) == 9 and one["whitened"].isna().all() and (one["n"] == 1).all() and (one["deviation"] == 0).all() and (one["explained"] == 0).all()
    two = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.0], 1, "n", 2), (2, [1.5, 1.0], 1, "n", 2)], VECTORS)).toPandas()
    assert np.allclose(np.abs(two[two["component"] == 1]["whitened"]), 1) and two[two["component"] == 2]["whitened"].isna().all()
    assert (two["identity_error"] < 1e-12).all() and (two["deviation"] == 64 * 64).all()


def test_whitening_of_the_table(spark):
    got = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001").toPandas()
    rows = pd.read_parquet("/root/testdata/sf0.001/embeddings.parquet")
    ok = [(i, list(v)) for i, v in zip(rows["vec_id"], rows["embedding"], strict=True) if v is not None and len(v) and np.isfinite(np.asarray(v, float)).all()]
    want, _ = whitened_by_hand(ok)
    assert len(got) == 16 * len(ok)
    for i, g in got.groupby("vec_id"):
        assert g["deviation"].iloc[0] == want[i][1] and np.allclose(np.abs(g.sort_values("component")["whitened"]), np.abs(want[i][2]), rtol=1e-7, atol=1e-8)


# ---- main text

SHELL = "<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{0}</body></html>"
ARTICLE = "<h1>Title &amp; more</h1><p>First <b>para</b>graph&nbsp;with\n  words, and some more of them.</p><p>Second paragraph, 1 &lt; 2.<br>After"
ARTICLE_TEXT = "Title & more First paragraph with words, and some more of them. Second paragraph, 1 < 2. After"
NOISE = (
    "<header><div class='logo'>Site</div></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>",
    "<aside><p>Side text that is quite long, longer than a line of the article, in fact.</p></aside><div id='adBox'>Buy now</div><form><p>Mail me</p><input></form>",
    "<section id='comments'><article class='comment'><p>Nice post, I liked it a great deal, more than anything else on this page.</p></article></section>"
    "<div class='related-posts'><a href='/x'>Other</a></div><footer><p>Copyright</p></footer>",
)


@pytest.mark.parametrize(
    "body",
    [
        "<article>{0}</article>", "<div class='wrap'><div class='post-17'>{0}</div></div>", "<main><section><div>{0}</div></section></main>",
        "<table><tr><td>Menu<td class=content>{0}</table>", "<article><header>{0}</header><!-- <p>no</p> --></article>", "<div class='content'><article class='x'>{0}</p></article>",
    ],
)
def test_main_text_of_layouts(body):
    page = SHELL.format(NOISE[0] + body.format(ARTICLE) + NOISE[1] + NOISE[2])
    assert main_text.main_text(page, []) == ARTICLE_TEXT
    inner = SHELL.format(NOISE[0] + body.format(ARTICLE + "</p>" + NOISE[1] + "<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>" + NOISE[2]))
    assert main_text.main_text(inner, []) == ARTICLE_TEXT


def test_main_text_of_odd_pages(spark):
    assert main_text.main_text(None, []) == main_text.main_text("", ["body"]) == main_text.main_text("<nav>x</nav>", []) == ""
    assert main_text.main_text("plain words", []) == "plain words"
    assert main_text.main_text("<p>a <i>b<p>c</i> d &#x41;&copy;", []) == "a b c d A©"
    assert main_text.main_text("<script>never closed <p>x", []) == main_text.main_text("<!-- never closed <p>x", []) == ""
    assert main_text.main_text("<p title='a > b' class=\"x>y\">t</p><p style='display:none'>u", []) == "t"
    long = "<article>" + "<p>word &amp; word</p>" * 200_000
    assert main_text.main_text(long, []) == " ".join(["word & word"] * 200_000)
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    assert main_text.main_text(deep, []) == "text"
    assert main_text.main_text("<" * 100_000 + "<p '" * 10_000, []) is not None
    schema = "page_id long, url string, html string, host string, path string, paths string, text string, votes int"
    rows = [(1, "http://a.b/x", SHELL.format(f"<article>{ARTICLE}"), "h", "p", "q", "t", 1), (2, None, None, "h", "p", "q", "t", 1), (None, "no url", "", "h", "p", "q", "t", 1)]
    frame = spark.createDataFrame([*rows, rows[0]], schema)
    got = main_text.extract(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    key = lambda r: str(r[0])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(
        [(1, "http://a.b/x", ARTICLE_TEXT, len(ARTICLE_TEXT))] * 2 + [(2, None, "", 0), (None, "no url", "", 0)], key=key
    )
    assert main_text.extract(frame.limit(0)).count() == 0


def test_hosts_decide_by_votes(spark):
    usual = "<div class='story-{0}'><p>{1}</p></div><div class='box'><p>{2}</p></div>"
    rows = [(i, f"https://News.example:80/{i}", SHELL.format(usual.format(i, f"story {i} " * 20, "box"))) for i in range(8)]
    # here the other box is the longer one: the host's pages know better
    rows.append((8, "https://news.example/8", SHELL.format(usual.format(8, "short story", "box text " * 40))))
    rows.append((9, "https://other.example/9", SHELL.format(usual.format(9, "short story", "box text " * 40))))
    # a layout that the host's paths do not know
    rows.append((10, "https://news.example/10", SHELL.format("<main><p>another layout</p></main>")))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {r["host"]: r["paths"] for r in main_text.host_paths(frame).collect()}
    assert paths["news.example"][0] == "body/div.story-#" and paths["other.example"] == ["body/div.box"]
    got = {r["page_id"]: r["text"] for r in main_text.extract(frame).collect()}
    assert got[8] == "short story" and got[9] == ("box text " * 40).strip() and got[10] == "another layout" and got[3] == ("story 3 " * 20).strip()


def test_main_text_of_the_table(spark):
    """Brute force for these pages: what stands in <article>, tags taken out by a plain pattern."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op12_main_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for i, url, text in zip(pages["page_id"], pages["url"], pages["html"], strict=True):
        inner = re.search(r"<article>(.*)</article>", text or "", re.S)
        blocks = re.split(r"</?(?:p|h1|br)>", inner[1]) if inner else []
        want = " ".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks) if x)
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["url"] == url


# ---- ranked search


def ranked_by_hand(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: pattern.findall((t or "").translate(fold))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    total, n = sum(x[2] for x in bags), len(bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None and t is not None:
            asked[i].add(t)
    out = set()
    for item, texts in asked.items():
        query = Counter(w for t in texts for w in terms(t))
        scores = []
        for doc, c, size in bags:
            m = 100 - 75 + (75 * size * n) // total
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in query.items() if t in c
            )
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out |= {(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_search_by_hand(spark):
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "ΑΒΓ", "x_y", "A1", "日本"]
    docs = [(i, " ".join(RNG.choice(words, RNG.integers(1, 60)))) for i in range(400)]
    docs += [(1000 + i, "w1 W2, w3. É") for i in range(200)] + [(5000, None), (5001, ""), (5002, " ._- "), (None, "w1 w2"), docs[7], (9999, "w5 " * 50_000)]
    items = [(i, " ".join(RNG.choice(words, 12))) for i in range(30)] + [(30, "w1 w1 w2"), (31, None), (None, "w1"), (32, ""), (33, "unknown"), (30, "w1 w1 w2"), (34, "w3"), (34, "w4")]
    extra = "doc_id long, text string, item_id long, rank int, score int, term string, doc string, task int, block int"
    frame = spark.createDataFrame([(i, t, 1, 2, 3, "t", "d", 4, 5) for i, t in docs], extra).repartition(7)
    asked = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in items], "item_id long, text string, doc_id long, block int, score int")
    want = ranked_by_hand(docs, items)
    for chars in (search.BLOCK_CHARS, 200):  # one block and several
        got = [tuple(r) for r in search.search(frame, asked, block_chars=chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert search.search(frame.limit(0), asked).count() == search.search(frame, asked.limit(0)).count() == 0


def test_search_against_sql(spark):
    con = connect("/root/testdata/sf0.001")
    verdict, n, _ = compare(spark, con, "/root/testdata/sf0.001", "op13_search", QUERIES["op13_search"], ORACLE["op13_search"])
    assert verdict == "ok" and n

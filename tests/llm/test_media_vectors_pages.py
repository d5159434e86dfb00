"""Lossless WebP, the M-tree and wrapper induction against round trips and brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tollhouse.llm import mtree, webp, wrapper


@pytest.mark.parametrize("seed", range(12))
def test_webp_round_trip(seed):
    rng = np.random.default_rng(seed)
    h, w = (int(x) for x in rng.integers(1, 21, 2))
    pixels = (rng.integers(0, 1 << 32, (h, w), dtype=np.uint64) if seed % 3 == 0 else rng.choice(rng.integers(0, 1 << 32, 1 + seed, dtype=np.uint64), (h, w)) if seed % 3 == 1 else np.add.outer(np.arange(h), np.arange(w)) * 0x010203).astype(np.uint32)
    for transforms in ((), (0,), (1,), (2,), (0, 1, 2), (3,)):
        if transforms == (3,) and len(np.unique(pixels)) > 256:
            continue
        modes = rng.integers(0, 14, (-(-h >> 2), -(-w >> 2)))
        raw = webp.encode(pixels, transforms, lz=bool(seed % 2), cache_bits=seed % 5, tile=(0, 2, 3)[seed % 3], predictor=modes, bits=2)
        assert (webp.decode(raw) == pixels).all()


def test_webp_known_stream():
    """A file put together bit by bit after the format's description: 1 x 1, opaque, (red, green, blue) = (1, 2, 3)."""
    bits = []
    put = lambda v, n: bits.extend(v >> i & 1 for i in range(n))
    for v, n in ((0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        put(v, n)
    for symbol in (2, 1, 3, 255, 0):
        put(1, 1), put(0, 1), put(1, 1), put(symbol, 8)
    data = np.packbits(bits, bitorder="little").tobytes()
    raw = b"RIFF" + (12 + len(data) + len(data) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) % 2)
    assert webp.decode(raw).tolist() == [[0xFF010203]]
    with pytest.raises(ValueError, match="not a lossless"):
        webp.decode(b"RIFF....WEBPVP8 ")


def test_stored_texts(spark):
    texts = [None, "", "a", "ab" * 5000, "x" * 576, "é" * 300, "abc " * 300, "plain words and more of them, 42.\n" * 3 + "end"]
    files, padded = webp.store_texts(pa.array(texts))
    for text, samples, n in zip(texts, webp.decode_grey(files), padded, strict=True):
        raw = (text or "").encode()
        assert n % 576 == 0 and n > 0 and samples[:n] == raw + b"\xff" * (n - len(raw))
    df = spark.createDataFrame(list(enumerate([*texts, "a"])), "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = {r.doc_id: r for r in webp.read_media(webp.store_media(df)).collect()}
    assert len(got) == 9 and bytes(got[2].media) == bytes(got[8].media)
    assert all(bytes(got[i].samples)[: got[i].n_bytes] == (t or "").encode() for i, t in enumerate(texts))
    assert webp.read_media(webp.store_media(df.limit(0))).count() == 0


@pytest.mark.parametrize("page", [1024, 8])
def test_mtree(spark, monkeypatch, page):
    monkeypatch.setattr(mtree, "PAGE", page)
    monkeypatch.setattr(mtree, "NODE", max(2, page // 8))
    rng = np.random.default_rng(page)
    vectors = [[float(x) for x in np.float32(rng.normal(size=6))] for _ in range(90)] + [[0.5] * 6] * 30
    vectors += [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] * 6, [math.inf] * 6, [0.0] * 6]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank string").repartition(3)
    whole = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all()}
    wanted = set()
    for q, x in whole.items():
        if q % 20 == 0:
            best = sorted(((-int(x @ y), i) for i, y in whole.items() if i != q))[:20]
            wanted |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in mtree.top_k(df).collect()} == wanted
    assert mtree.top_k(df.limit(0)).count() == 0
    assert mtree.top_k(df.filter("vec_id < 3")).count() == 2


@pytest.mark.parametrize("copies", [0, 300])
def test_mtree_splits(spark, monkeypatch, copies):
    """Full nodes split by their own vectors, level below level; copies of one vector fill pages by a hash; scores stay exact."""
    for name, value in {"PAGE": 8, "NODE": 4, "ROUTING": 2, "SPLIT": 2, "DEALT": 64, "QUERIES": 5}.items():
        monkeypatch.setattr(mtree, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(24, 6)) * 40
    x = np.concatenate([np.floor(centres[rng.integers(0, 24, 700)] + rng.normal(size=(700, 6))), np.full((copies, 6), 3.0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    score = x @ x.T
    wanted = set()
    for q in range(0, len(x), 20):
        best = sorted((-int(score[q, i]), i) for i in range(len(x)) if i != q)[:5]
        wanted |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {tuple(r) for r in mtree.top_k(df, k=5, scale=1).collect()} == wanted
    index = mtree.build_index(mtree.quantised(df, "vec_id", "embedding", 1))
    assert index.levels and sum(len(np.frombuffer(r.ids, np.int64)) for r in index.nodes.select("ids").collect()) == len(x)
    sizes = [r.n for r in index.nodes.groupBy("node", "sub").agg(F.sum(F.octet_length("ids") / 8).alias("n")).collect()]
    assert max(sizes) <= 3 * mtree.PAGE and len(sizes) >= len(x) // 16
    many = [r.subs for r in index.pages.collect() if r.subs > 1]
    assert len(many) <= (1 if copies else 0) + 2 and bool(copies) <= bool(many)


def test_mtree_levels():
    """Inner nodes above many routing objects find the nearest one and lose none within reach."""
    rng = np.random.default_rng(5)
    objects = np.concatenate([rng.normal(size=(1500, 4)) + 6 * rng.integers(0, 4, (1500, 1)), np.full((1, 4), 90.0)])
    radii = rng.random(len(objects))
    routes = np.arange(len(objects)) * 3
    inner = mtree.Inner(routes, objects, radii)
    assert len(inner.levels) == 3
    x = np.concatenate([objects[:40], rng.normal(size=(40, 4)) * 5])
    d = np.sqrt(((x[:, None] - objects[None]) ** 2).sum(axis=2))
    assert [d[i, inner.nearest(q) // 3] for i, q in enumerate(x)] == pytest.approx(d.min(axis=1), abs=1e-5)
    reach = rng.random(len(x)) * 2
    reach[0] = np.inf
    found = {(int(i), route // 3) for route, rows in inner.within(x, reach) for i in rows}
    assert found >= set(zip(*(i.tolist() for i in np.nonzero(d - radii <= reach[:, None] - 1e-6)), strict=True))
    assert found <= set(zip(*(i.tolist() for i in np.nonzero(d - radii <= reach[:, None] + 1e-6)), strict=True))


def test_mtree_odd_vectors(spark, monkeypatch):
    """Large whole numbers stay exact, vectors beyond 64 bits rank by their true scores, ids and vectors repeat, widths differ, columns clash."""
    monkeypatch.setattr(mtree, "BLOCK", 3)
    monkeypatch.setattr(mtree, "QUERIES", 2)
    big = float(2**24 + 1)
    rows = [(0, [big, 1.0]), (20, [big, 2.0]), (20, [big, 2.0]), (21, [big, 3.0]), (40, [1e30, 0.0]), (60, [1.7e308, 1.0]), (61, [1.7e308, -1e300]), (62, [-1e25, 3.0]), (63, [3e9, 1.0]), (80, []), (None, [1.0, 1.0]), (3, [2.0]), (100, [-big])]
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, embedding array<double>, score long, route long")
    exact = lambda x: math.floor(64 * x) if math.isfinite(64 * x) else 64 * int(x)
    part = [(i, [exact(x) for x in v] + [0] * (2 - len(v))) for i, v in rows if i is not None]
    wanted = []
    for q, x in {i: v for i, v in part if i % 20 == 0}.items():
        best = sorted((-(x[0] * y[0] + x[1] * y[1]), i) for i, y in part if i != q)[:20]
        wanted += [(q, r + 1, i, max(-mtree.MOST, min(mtree.MOST, -s))) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in mtree.top_k(df).collect()) == sorted(wanted)
    assert any(w[3] == mtree.MOST for w in wanted) and any(w[3] == -mtree.MOST for w in wanted)
    only = df.filter("vec_id IN (40, 60, 61)")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in mtree.top_k(only).collect()) == [(40, 1, 60), (40, 2, 61), (60, 1, 61), (60, 2, 40)]
    empty = spark.createDataFrame([(0, []), (20, [])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in mtree.top_k(empty).collect()) == [(0, 1, 20, 0), (20, 1, 0, 0)]


PAGES = [
    ("http://a.test/1", "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='page with-sidebar'><article><h1>One &amp; only</h1><p>First <b>bold</b> text.<br>Line<p>Second&nbsp;part</article></div><footer>foot</footer></body></html>", "One & only First bold text. Line Second part"),
    ("http://a.test/2", "<body><nav><a>Home</a></nav><div class='page with-sidebar'><article><h1>Two</h1><p>Other words</p><aside>ad</aside><script>var t='</p>';</script><div class=comments><p>nice</p></div></article></div><footer>foot</footer>", "Two Other words"),
    ("http://b.test/1", "<body><div id=menu>m</div><div id=content><h2>Head</h2><p>Alpha beta gamma delta</p></div><div class='cookie-notice'>We use</div><form>f</form></body>", "Head Alpha beta gamma delta"),
    ("http://b.test/2", "<body><div id=menu>n</div><div id=content><h2>Hood</h2><p>Epsilon zeta eta theta</p><ul><li>x<li>y</ul></div><div class='cookie-notice'>We use</div></body>", "Hood Epsilon zeta eta theta x y"),
    (None, None, ""),
    ("http://c.test", "", ""),
    ("http://c.test", "just text", "just text"),
    ("http://d.test", "<article><p>cut off he", "cut off he"),
    ("http://d.test", "<article><p>cut <b", "cut"),
]


def test_wrapper(spark):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string, main_text string").repartition(3)
    got = {r.page_id: r.main_text for r in wrapper.main_text(df).collect()}
    assert got == {i: t for i, (_, _, t) in enumerate(PAGES)}
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_tree_matching():
    one, two = (wrapper.skeleton(wrapper.parse(h)) for h in ("<div><p>a</p><span>s</span><h1>x</h1></div>", "<div><h1>y</h1></div>"))
    assert wrapper.matching(one, two, {}) == 3
    both = wrapper.merged(one, two)
    (div,) = both[5]
    assert [c[0] for c in div[5]] == ["p", "h1"] and div[5][1][2] == -1


def wrapped(spark, pages):
    """Main texts of pages of one host, in order."""
    df = spark.createDataFrame([(i, "http://one.example/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(2)
    return [r.main_text for r in sorted(wrapper.main_text(df).collect())]


def test_headline_and_lead_stay(spark):
    body = lambda i: f"Body {i} " + "and so on " * (200 if i else 9000)
    pages = [f"<body><main><h1>Headline {i}</h1><div class=lead>Lead {i}</div><div class=body><div class=text>{body(i)}</div></div></main></body>" for i in range(4)]
    assert wrapped(spark, pages) == [f"Headline {i} Lead {i} {body(i)}".strip() for i in range(4)]


def test_constant_texts_go(spark):
    """Blocks of neutral names and paragraphs that are the same on all pages go; copies of a page make nothing constant."""
    page = lambda i: f"<body><div class=content><p>Read more of our stories</p><h1>Title {i}</h1><div class=box>An <b>offer</b> for you</div><p>Text {i} alpha</p><p>more {i} beta</p><div class=box>Box {i}</div></div></body>"
    left = lambda i: f"Title {i} Text {i} alpha more {i} beta Box {i}"
    assert wrapped(spark, [page(i) for i in range(5)]) == [left(i) for i in range(5)]
    assert wrapped(spark, [page(0)] * 5 + [page(1)]) == [f"Read more of our stories Title {i} An offer for you Text {i} alpha more {i} beta Box {i}" for i in (0, 0, 0, 0, 0, 1)]


@pytest.mark.parametrize("name", ["class='page with-sidebar'", "class='no-sidebar'", "class=has-nav", "class=layout-footer", "id=legal-news", "class=related-work"])
def test_names_of_main_text(spark, name):
    """Without article or main, an element that holds most of the text stays; small ones of such names go."""
    page = lambda i, n: f"<body><h1>Title {i}</h1><div {name}><div class=content><p>{f'word{i} ' * n}</p></div><div class=sidebar>Side {i}</div></div><div class=ad>Buy {i}</div></body>"
    sizes = (30, 40, 4000, 20)
    assert wrapped(spark, [page(i, n) for i, n in enumerate(sizes)]) == [f"Title {i} {f'word{i} ' * n}".strip() for i, n in enumerate(sizes)]
    assert wrapped(spark, [page(0, 30)]) == [f"Title 0 {'word0 ' * 30}".strip()]


@pytest.mark.parametrize("tag", ["font", "b", "div"])
def test_deep_pages(spark, tag):
    """Elements nested 5,000 deep, without end tags."""
    deep = [f"<body><p>Start {i}</p>" + f"<{tag}>x{i} " * 5000 for i in range(2)]
    wanted = [f"Start {i}" + f" x{i}" * 5000 for i in range(2)]
    assert wrapped(spark, [*deep, "<body><p>Flat</p></body>"]) == [*wanted, "Flat"]


@pytest.mark.parametrize("shape", ["<form id=aspnetForm>{}</form>", "<form><article>{}</article></form>", "<form><fieldset><main>{}</main></fieldset></form>", "<form><div class=content>{}</div></form>", "<form role=search><input></form><form>{}</form>"])
def test_pages_in_a_form(spark, shape):
    """A form around the page's text stays; small forms and their buttons go."""
    page = lambda i: "<body><form class=login><label>Sign in</label><input><button>Go</button></form>" + shape.format(f"<h1>Title {i}</h1><p>{f'word{i} ' * 40}</p><select><option>x</select>") + "</body>"
    wanted = [f"Title {i} {f'word{i} ' * 40}".strip() for i in range(4)]
    assert wrapped(spark, [page(i) for i in range(4)]) == wanted
    assert wrapped(spark, [page(0)]) == wanted[:1]


@pytest.mark.parametrize("tag, name", [("p", "share-price"), ("div", "notice-of-motion"), ("div", "ad-hoc"), ("section", "related-work"), ("div", "article-header"), ("p", "no-comment")])
def test_names_inside_an_article(spark, tag, name):
    """A name counts as a whole: one that merely begins like an advert's condemns nothing."""
    page = lambda i: f"<body><article><header><h1>Head {i}</h1></header><{tag} class='{name}'>Kept {i} text</{tag}><p>{f'body{i} ' * 30}</p><div class='share-buttons'>Share {i}</div><div class=ads>Buy {i}</div></article></body>"
    wanted = [f"Head {i} Kept {i} text {f'body{i} ' * 30}".strip() for i in range(4)]
    assert wrapped(spark, [page(i) for i in range(4)]) == wanted
    assert wrapped(spark, [page(0)]) == wanted[:1]


def test_place_decides_beside_an_article(spark):
    """What stands beside the article goes whatever its name, unless it holds most of what varies; the page's heading stays."""
    page = lambda i, n: f"<body><div class=x1>Aside {i}</div><h1>Title {i}</h1><article><p>{f'main{i} ' * 20}</p></article><section class=x2>{f'more{i} ' * n}</section></body>"
    assert wrapped(spark, [page(i, 3) for i in range(4)]) == [f"Title {i} {f'main{i} ' * 20}".strip() for i in range(4)]
    assert wrapped(spark, [page(i, 100) for i in range(4)]) == [f"Title {i} {f'main{i} ' * 20}{f'more{i} ' * 100}".strip() for i in range(4)]


def test_given_pages_do_not_need_names(spark, sf):
    """The advert of the given pages goes by its place: another class gives the same text."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    renamed = pages.selectExpr("page_id", "url", "replace(html, 'class=\"ad\"', 'class=\"q\"') AS html")
    assert renamed.filter("html LIKE '%class=\"q\"%'").count() > 0
    assert {r.page_id: r.main_text for r in wrapper.main_text(renamed).collect()} == {r.page_id: r.main_text for r in wrapper.main_text(pages).collect()}


def test_given_pages_change_by_their_template(spark, sf):
    """A constant line put into the articles of the given hosts goes by induction alone, and is kept where pages are taken one by one."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").filter("html LIKE '%</article>%'")
    added = pages.selectExpr("page_id", "url", "replace(html, '</article>', '<p class=\"z\">Read more of our stories</p></article>') AS html")
    many = added.groupBy(wrapper._host("url").alias("h")).count().filter("count >= 3").collect()
    hosts = {r.h for r in many}
    before = {r.page_id: r.main_text for r in wrapper.main_text(pages).collect()}
    after = wrapper.main_text(added).withColumn("h", wrapper._host("url")).collect()
    by_template = [r for r in after if r.h in hosts]
    assert by_template and all(r.main_text == before[r.page_id] for r in by_template)
    assert all(wrapper.extract(r.html).endswith("Read more of our stories") for r in by_template)

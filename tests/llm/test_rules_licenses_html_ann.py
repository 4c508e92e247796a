import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from codecorpus.llm import ann, html_text, licenses, quality_rules
from codecorpus.llm.common import Scratch
from llm_fixtures import edge_docs, edge_labels, no_docs, no_labels  # noqa: F401

SF = "/root/testdata/sf0.001"


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    windows = [tuple(words[i:i + 8]) for i in range(n - 7)]
    often, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            cover |= set(range(i, i + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


def test_rules_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import zlib
    good = Counter()
    bad = {r["doc_id"] for r in labels.collect() if r["quality"] != 1}
    for r in labels.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] not in bad:
            good[r["doc_id"]] += 1

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        pair = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
                for a, b in zip(h, h[1:])]
        return [signed(g) % quality_rules.BUCKETS for g in h + pair]

    raw, target = Counter(), Counter()
    for i, t in texts.items():
        g = grams(t)
        raw.update(g)
        if i in good:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    k = quality_rules.PRIOR
    for i, t in texts.items():
        want = base_counts(t)
        r = rows[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        g = grams(t)
        ratio = sum(np.log((target[x] + k) / (raw[x] * share + k)) for x in g) / max(1, len(g))
        assert r["base_failed"] == failed and abs(r["score"] - ratio) < 1e-6
        assert r["kept"] == (not failed and r["score"] >= quality_rules.THRESHOLD)


def test_rules_edges(spark, edge_docs, edge_labels, no_docs, no_labels):
    assert quality_rules.quality_rules(no_docs, no_labels).collect() == []
    rows = quality_rules.quality_rules(edge_docs, edge_labels).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    assert len(rows) == 13
    for r in rows:
        assert tuple(r)[1:6] == base_counts(texts[r["doc_id"]])
    odd = ["a b c d e f g h a b c d e f g h", "x " * 40, "\n\na b\n a b\na b\n", "#|<> &", "a\x0bb\x0cc\x1cd e"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in quality_rules.quality_rules(docs, no_labels).collect():
        assert tuple(r)[1:6] == base_counts(odd[r["doc_id"]])


def test_rules_beyond_the_broadcast_bound(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(map(tuple, quality_rules.quality_rules(docs, labels).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, quality_rules.quality_rules(docs, labels).collect())) == want


def test_rules_on_held_out_labels(spark):
    """Of held-out labels that pass the base rules, good ones stay and bad ones go."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(docs, labels).where(quality_rules.held_out("doc_id"))
    n = {(r["quality"], r["kept"]): r["count"] for r in rows.where("not base_failed").join(labels, "doc_id")
         .groupBy("quality", "kept").count().collect()}
    print(n)
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.98
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.95


def test_rules_are_native(edge_docs, edge_labels):
    plan = quality_rules.quality_rules(edge_docs, edge_labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_licenses_against_every_window(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(licenses.oracle_sql()).fetchall())
    df = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(map(tuple, df.collect())) == want and want
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_license_texts_with_noise(spark, no_docs, edge_docs):
    filler = " ".join(f"filler{i}" for i in range(50))
    docs = [(i, f"{filler} {t.upper()} {filler}") for i, t in enumerate(licenses.TEMPLATES.values())]
    words = licenses.TEMPLATES["MIT-text"].split()
    docs.append((100, " ".join([*words[:12], "really", *words[12:]])))  # one word put in
    docs.append((101, " ".join(words[:9])))  # a third of the text only
    docs.append((102, " ".join(reversed(words))))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(i, k) for i, k in enumerate(licenses.TEMPLATES)} <= got and (100, "MIT-text") in got
    assert not {d for d, _ in got} & {101, 102}
    assert licenses.scan(no_docs).collect() == [] and licenses.scan(edge_docs).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/x>y">Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Head&nbsp;line</h1></header>
<p>One <b>bo</b>ld
  line&#33;<br>next<p>Two &lt;tags&gt; &copy 2020<aside>Side</aside><div class="share">Share</div>
<form><input value=q>Send</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<section id="comments"><p>First!</p></section><p>End</article><div class="ad">Buy</div><footer>Foot</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE, {}) == "Head line One bold line! next Two <tags> © 2020 a b c d End"
    assert html_text.main_text(None, {}) == html_text.main_text("", {}) == html_text.main_text("<p", {}) == ""
    assert html_text.main_text("<p>a &am", {}) == "a &am" and html_text.main_text("x <!-- y", {}) == "x"


def test_names_of_wrappers():
    """A name cuts a branch by what it is, not by what it stands beside."""
    for name in ("layout-sidebar-right", "content-with-sidebar", "sidebar-right", "sidebar", "page-header"):
        for at in ("class", "id"):
            page = f"<body><div {at}='{name}'><nav>Menu</nav><article><p>Words</p></article></div><p>Foot</p></body>"
            assert html_text.main_text(page, {}) == "Words"
    inside = "<article><p>A</p><div class='search-results'>B</div><p class='market-share'>C</p><div class='%s'>D</div></article>"
    for name in ("share", "share-buttons", "cookie-notice", "ad-1"):
        assert html_text.main_text(inside % name, {}) == "A B C"
    for name in ("sidebar", "site-nav", "comments"):
        page = f"<body><article>A</article><div class='{name}'><article>Teaser</article></div></body>"
        assert html_text.main_text(page, {}) == "A"
        assert html_text.main_text(f"<body><p>A</p><div class='{name}'>Menu</div></body>", {}) == "A"
        page = f"<body><p>A longer text</p><div class='{name}'><article>Teaser</article></div></body>"
        assert html_text.main_text(page, {}) == "A longer text"
    assert html_text.main_text("<body><p>A</p><div id=comments><article class=comment>B</article></div></body>", {}) == "A"


def test_style_tree_finds_unnamed_furniture(spark, edge_docs):
    """Branches without a telling name go by their importance on the host."""
    def page(i):
        return (f"<html><body><div class='box1'><p>Welcome to our site</p><p>Call us now</p></div>"
                f"<div class='box2'><h2>Story {i}</h2><p>Body of story {i} with own words {i * 7}</p></div>"
                f"<div class='box3'>All rights reserved</div></body></html>")
    pages = [(i, "http://h.example/p", page(i), "x") for i in range(60)] + [(90, None, None, "x"), (91, "", "", None)]
    pages.append((92, "http://other.example/p", "<p>only <i>page</i></p>", "x"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    rows = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert all(rows[i]["text"] == f"Story {i} Body of story {i} with own words {i * 7}" for i in range(60))
    assert rows[90]["text"] == rows[91]["text"] == "" and rows[92]["text"] == "only page" and rows[92]["n_chars"] == 9
    assert html_text.extract(df.where("false")).collect() == []


def test_copied_articles_stay(spark):
    page = "<body><nav>Menu</nav><article><p>Same words on every page</p></article></body>"
    df = spark.createDataFrame([(i, "http://h.example/", page) for i in range(50)], "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(df).collect()} == {"Same words on every page"}


def test_hosts_of_copies_keep_their_text(spark):
    """Copies of a page say nothing about which of its branches are furniture."""
    pages = {"plain": "<body><div class=content><p>Same words everywhere</p></div></body>",
             "named": "<body><article><div class=body><p>Same words everywhere</p></div></article></body>"}
    rows = [(i, f"http://{h}.example/{i}", page) for h, page in pages.items() for i in range(200)]
    # an article under changing furniture: the pages differ, its branch does not
    rows += [(i, f"http://near.example/{i}", f"<nav>Menu {i}</nav>{pages['named']}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in html_text.extract(df).collect()} == {"Same words everywhere"}


def _renamed(page):
    """The same page without a telling name: article, menu, footer and advert
    become boxes of meaningless classes."""
    for tag, name in (("article", "k1"), ("nav", "k2"), ("footer", "k3")):
        page = page.replace(f"<{tag}>", f'<div class="{name}">').replace(f"</{tag}>", "</div>")
    return page.replace('class="ad"', 'class="k4"')


def test_tree_finds_articles_without_names(spark):
    """All pages of sf0.1 with their names taken away: the tree alone decides."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    rows = [(r["page_id"], r["url"], _renamed(r["html"])) for r in pages.collect()]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(plain).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    # without the tree's figures the same pages keep their furniture
    assert sum(html_text.main_text(h, {}) == want[i] for i, _, h in rows) < 0.05 * len(want)


def test_style_tree_against_brute_force(spark):
    rng = random.Random(8)
    shared = ["<div class=m><ul><li><a href=/>Home</a></li><li><a href=/>About us</a></li></ul></div>", "<div class=f>Rights</div>"]
    pages = [(f"h{i % 3}.example", f"<body>{shared[0]}<div class=a>" + "".join(
        f"<p>{' '.join(rng.choices(['red', 'blue', 'green', 'old'], k=rng.randrange(1, 6)))} <a>x{i}</a></p>"
        for _ in range(rng.randrange(1, 6))) + f"</div>{shared[1]}</body>") for i in range(40)]
    pages += pages[:5]
    df = spark.createDataFrame(pages, "host string, html string")
    got = {(r["host"], r["node"]): r for r in html_text.style_tree(df, Scratch(spark, "tree-test"), pooled_pages=0).collect()}
    stats = {}
    for host, page in sorted(set(pages)):
        layouts, text = [], Counter()
        found = list(html_text.blocks(page, layouts))
        for block, branch, linked in found:
            for b in branch:
                if b[1] != html_text.ROOT:
                    text[b[0], "chars"] += len(block)
                    text[b[0], "links"] += round(len(block) * linked)
        for node in {n for n, _ in text}:
            x = stats.setdefault((host, node), {"layouts": Counter(), "chars": 0, "links": 0, "page": 0})
            x["layouts"].update(h for n, h in layouts if n == node)
            x["chars"] += text[node, "chars"]
            x["links"] += text[node, "links"]
            x["page"] += sum(len(b) for b, _, _ in found)
    assert stats.keys() == got.keys()
    for key, x in stats.items():
        n = sum(x["layouts"].values())
        entropy = -sum(c / n * np.log(c / n) for c in x["layouts"].values())
        want = (1 - np.exp(-entropy), x["links"] / x["chars"], x["chars"] / x["page"])
        assert np.allclose([got[key][c] for c in ("presentation", "links", "share")], want)


def brute(ids, vecs, k=20):
    out = {}
    for i, q in zip(ids, vecs):
        if i % 20 == 0:
            s = np.zeros(len(ids))
            for d in range(vecs.shape[1]):
                s += vecs[:, d] * q[d]
            rows = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), s[j]) for j in rows]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    data = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    want = brute(np.array([d[0] for d in data]), np.array([d[1] for d in data]))
    got = {}
    for r in ann.nearest(df).collect():  # with the settings of the registered query
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    hit = 0
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        exact = dict(want[q])
        hit += sum(v in exact for _, v, _ in rows)
        assert all(s == exact[v] for _, v, s in rows if v in exact)
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
    assert hit / (20 * len(got)) >= 0.9


def _block_figures(ids, vecs, asked):
    """(recall, share of the block verified for a query) of one full block."""
    results, verified = ann.search_block(ids, vecs, ids[asked], vecs[asked], 20, 0, 0.5)
    hit, at = 0, 0
    for best in results:
        for i in range(len(best.query_ids)):
            s = vecs @ vecs[asked[at]]
            s[asked[at]] = -np.inf
            hit += len(set(ids[np.argsort(-s)[:20]]) & set(best.ids[best.asked == i]))
            at += 1
    return hit / (20 * len(asked)), sum(verified) / (len(asked) * len(ids))


def test_ann_block_of_check_size_verifies_few():
    """16,384 vectors, the registered block size: directions with no cluster
    at all, the hardest case."""
    rng = np.random.default_rng(4)
    vecs = rng.standard_normal((16_384, 64))
    vecs /= np.linalg.norm(vecs, axis=1)[:, None]
    recall, share = _block_figures(np.arange(16_384), vecs, np.arange(0, 16_384, 16))
    assert recall >= 0.9 and share < 0.05
    # one vector of 50 times the length is a range of its own and presses no other together
    vecs[5] *= 50
    recall, share = _block_figures(np.arange(16_384), vecs, np.arange(0, 16_384, 64))
    assert recall >= 0.9 and share < 0.08


def test_ann_norm_ranges():
    rng = np.random.default_rng(6)
    vecs = rng.standard_normal((6000, 16)) * np.exp(rng.standard_normal((6000, 1)))
    recall, _ = _block_figures(np.arange(6000), vecs, np.arange(0, 6000, 20))
    assert recall >= 0.95
    places = ann.norm_ranges(np.linalg.norm(vecs, axis=1))
    assert sorted(np.concatenate(places).tolist()) == list(range(6000)) and len(places) > 4


def test_bit_sliced_counts():
    rng = np.random.default_rng(2)
    for m in (1, 2, 3, 5, 17, 64, 100):
        sets = rng.integers(0, 2 ** 64, (m, 3, 2), np.uint64)
        planes = ann.add_sets(iter(sets), m.bit_length())
        counts = np.unpackbits(sets.view(np.uint8), axis=2, bitorder="little").astype(int).sum(axis=0)
        for n in {1, m // 2 + 1, m}:
            got = np.unpackbits(ann.at_least(planes, n).view(np.uint8), axis=1, bitorder="little")
            assert (got == (counts >= n)).all()


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 4.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [9.0, 9.0, 9.0])]
    rows += [(100 + i, [5.0, 5.0]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == {0, 20, 40, 60, 100, 120}
    assert got[0] == [(100 + i, 5.0) for i in range(20)] and got[40] == [(60, 54.0)]
    assert got[100] == [(101 + i, 50.0) for i in range(20)]
    assert ann.nearest(df.where("false")).collect() == []

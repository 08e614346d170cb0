"""Sharding, archives, token files, search and extraction against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from intel_spark.llm import covertree as C
from intel_spark.llm import html as H
from intel_spark.llm import sharding as E
from intel_spark.llm import tokencounts as K
from intel_spark.llm import warc as W
from intel_spark.llm.base import fresh_path


def bits(doc, text):
    half = lambda s: f"{int(hashlib.md5(s.encode()).hexdigest()[:15], 16):060b}"
    return half("" if doc is None else str(doc)) + half(text or "")


def shards(rows, limit):
    """The shortest prefix that fits, by splitting bucket after bucket."""
    out, todo = {}, [("", list(range(len(rows))))]
    hashes = [bits(*r) for r in rows]
    size = lambda i: len((rows[i][1] or "").encode())
    while todo:
        prefix, members = todo.pop()
        if sum(map(size, members)) > limit and len({hashes[i] for i in members}) > 1:
            for bit in "01":
                part = [i for i in members if hashes[i].startswith(prefix + bit)]
                if part:
                    todo.append((prefix + bit, part))
        else:
            out.update({i: prefix for i in members})
    return out


@pytest.mark.parametrize("limit", [300, 2000, 10**7])
def test_shards_match_bucket_splitting(spark, limit):
    rng = np.random.default_rng(1)
    rows = [(i, "é" * int(rng.integers(0, 120))) for i in range(200)]
    rows += [(7, f"same key {i} " + "x" * 40) for i in range(30)] + [(8, "equal rows" * 10)] * 30 + [(9, "y" * 5000), (None, "z"), (None, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p1": F.lit("clash"), "depth": F.lit("clash")})
    got = Counter((r["doc_id"], r["text"], r["shard"]) for r in E.shard_documents(docs, limit).collect())
    want = shards(rows, limit)
    assert got == Counter((*rows[i], want[i]) for i in range(len(rows)))
    report = E.shard_report(docs, limit).collect()
    sums = defaultdict(int)
    for i, (_, text) in enumerate(rows):
        sums[want[i]] += len((text or "").encode())
    assert Counter((r["doc_id"], r["shard"], r["depth"], r["shard_bytes"], r["over_limit"]) for r in report) == Counter((rows[i][0], want[i], len(want[i]), sums[want[i]], sums[want[i]] > limit) for i in range(len(rows)))


def test_written_shards_are_whole(spark):
    docs = spark.createDataFrame([(i, "t" * 50) for i in range(100)], "doc_id long, text string")
    path = fresh_path(spark, "shards")
    E.write_shards(docs, path, 600)
    back = spark.read.option("basePath", path).parquet(path)
    assert back.count() == 100 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).where("n > 600").count() == 0
    assert E.shard_report(docs.limit(0)).count() == 0


def pages():
    body = "<p>" + "shared payload " * 10 + "</p>"
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77777>\r\nContent-Length: 5"
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 9)) for i in range(40)] + [(100 + i, "u", body) for i in range(5)]
    rows += [(200, None, None), (201, "bad\r\nurl", ""), (202, "u", "short"), (203, "u", "short"), (50, "u", body), (50, "u", body), (None, "u", "ü" * 300)]
    rows += [(300, "u", fake + "\r\n\r\nhello\r\n\r\n"), (301, "u", "a\r\n\r\n" + fake + "\r\n\r\nhello\r\n\r\n" + fake + "\r\n\r\n"), (302, "u", "\r\n\r\n" * 40), (303, "u", "ends\r\n\r\n"), (304, "u", "long " * 60_000 + "\r\n\r\n" + fake + "\r\n\r\n" + "x" * 90_000)]
    return rows


@pytest.mark.parametrize("block", ["128m", "20k"])
def test_archives_round_trip(spark, block):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).coalesce(2)
    folder = fresh_path(spark, "warc")
    W.write_archives(frame, folder)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = Counter(tuple(r) for r in W.resolved_records(W.read_archives(spark, folder)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for page, _, payload in rows:
        data = (payload or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    want = Counter()
    for page, _, payload in rows:
        data = (payload or "").encode()
        again = data in first and first[data] != page
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None)] += 1
    assert got == want


@pytest.mark.parametrize("block", ["128m", "701", "97"])
def test_payloads_may_end_in_line_ends(spark, block):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    fake = "WARC/1.0\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 3\r\n"
    ends = ["\r\n" * n for n in range(6)] + ["\n", "\r", "\r\n\r", "\n\r\n", "\r\nWARC/1.", "\r\n\r\nWARC/1.0", "\r\n" + fake, "\r\n\r\n" + fake + "\r\nabc"]
    rows = [(i, "http://x/WARC/1.0/spec", lead + "é" * (i % 5) + end) for i, (lead, end) in enumerate((a, b) for a in ("", "<html></html>", fake + "\r\n", "\r\n") for b in ends)]
    folder = fresh_path(spark, "warc")
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in W.resolved_records(W.read_archives(spark, folder)).collect() if r["record_type"] == "response"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    first = {}
    for page, _, payload in rows:
        data = payload.encode()
        first.setdefault(data if len(data) >= W.SHARED else page, (page, (len(data), hashlib.sha256(data).hexdigest())))
    assert got == dict(first.values())


def test_archive_that_breaks_off_raises(spark):
    folder = fresh_path(spark, "warc")
    header = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 5"
    spark.createDataFrame([(f"{header}\r\n\r\nhello\r\n\r\n{header}\r\n\r\nhel",)], "value string").write.text(folder)
    with pytest.raises(ValueError, match="end at"):
        W.read_archives(spark, folder)


def test_payload_that_is_a_header_is_no_record():
    assert W.parse_header(b"WARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 3") is not None
    for value in (b"WARC/1.0", b"WARC/1.0\r\nContent-Length: x\r\nWARC-Record-ID: <a>", b"xWARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 3", b"WARC/1.0\r\nContent-Length: 3"):
        assert W.parse_header(value) is None


def test_empty_pages_table(spark):
    folder = fresh_path(spark, "warc")
    W.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert W.resolved_records(W.read_archives(spark, folder)).count() == 0


@pytest.mark.parametrize("block", ["128m", "4k"])
def test_token_counts_match_the_tokenizer(spark, block):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rng = np.random.default_rng(4)
    rows = [(i, "".join(chr(int(c)) for c in rng.integers(32, 1500, int(rng.integers(0, 300))))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "same"), (502, "same"), (None, "no id"), (503, "long text " * 20_000), (504, "\n" * 50 + "Pä" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit("clash"))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        got = Counter(tuple(r) for r in K.token_counts(docs).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    encode = K.encoding(K.VOCABULARY)
    assert got == Counter((i, len(encode.encode_ordinary(t)) if t else 0) for i, t in rows)
    assert K.token_counts(docs.limit(0)).count() == 0


def brute_top(rows, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
            best[i] = min(best.get(i, q), q)
    out = []
    for q in best:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(best[q], v)), i) for i, v in best.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("leaves", [1, 40])
def test_top_k_matches_brute_force(spark, monkeypatch, leaves):
    monkeypatch.setattr(C, "LEAF_ROWS", 1200 // leaves)
    monkeypatch.setattr(C, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(scale=0.1, size=8)]) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(3000, None), (3050, [1.0, None]), (3100, [float("nan")] * 8), (3150, [float("inf")] * 8), (3200, []), (3250, [0.5, 0.5]), (None, rows[1][1]), (50, rows[50][1]), (100, [9.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "leaf": F.lit("clash")})
    got = sorted(tuple(r) for r in C.exact_top_k(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == brute_top(rows, 5)


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (51, [-1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in C.exact_top_k(frame, F.col("vec_id") % 50 == 0).collect()) == [(0, 1, 50, 131072), (0, 2, 51, -65536), (50, 1, 0, 131072), (50, 2, 51, -131072)]
    assert C.exact_top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_node_pairs_prune_and_lose_nothing():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(200, 4)) + c for c in (np.full(4, 30.0), np.full(4, -30.0), np.zeros(4))])
    root, leaves = C.build_tree(points, 40)
    at = C.descend(root, points)
    C.set_radii(root, {n: float(np.linalg.norm(points[at == n] - leaf.centre, axis=1).max()) for n, leaf in enumerate(leaves) if (at == n).any()})
    scores = points @ points.T
    kth = np.sort(scores, axis=1)[:, -5]
    C.set_bounds(root, {n: float(kth[at == n].min()) for n in range(len(leaves)) if (at == n).any()})
    pairs = {(a, b) for a, b, *_ in C.node_pairs(root, root)}
    assert len(pairs) < len(leaves) ** 2
    for i in range(len(points)):
        for j in np.argsort(-scores[i])[:5]:
            assert (at[i], at[j]) in pairs


@pytest.mark.parametrize("wanted", [24, 128])
def test_trees_keep_their_size_and_prune_clusters(wanted):
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(C.SAMPLE, 64)) * 20
    clustered = (rng.normal(size=(40, 64)) * 60)[rng.integers(0, 40, C.SAMPLE)] + rng.normal(size=(C.SAMPLE, 64)) * 4
    for points in (spread, clustered):
        root, leaves = C.build_tree(points, C.SAMPLE // wanted)
        assert wanted / 2 <= len(leaves) <= 2.5 * wanted
    at = C.descend(root, points)
    C.set_radii(root, {n: float(np.linalg.norm(points[at == n] - leaf.centre, axis=1).max()) for n, leaf in enumerate(leaves) if (at == n).any()})
    queries = np.arange(0, C.SAMPLE, 50)
    kth = np.sort(points[queries] @ points.T, axis=1)[:, -6]
    C.set_bounds(root, {n: float(kth[at[queries] == n].min()) for n in range(len(leaves)) if (at[queries] == n).any()})
    rows, asked = np.bincount(at, minlength=len(leaves)), np.bincount(at[queries], minlength=len(leaves))
    scored = sum(int(asked[a] * rows[b]) for a, b, *_ in C.node_pairs(root, root))
    assert scored < 0.5 * len(queries) * C.SAMPLE


def test_attained_negative_bounds_are_not_pruned():
    # copies at two places: every score across is the bound itself, and negative
    points = np.repeat(np.array([[3000.0, 1.0], [-3000.0, 1.0]]), 20, axis=0)
    root, leaves = C.build_tree(points, 20)
    at = C.descend(root, points)
    assert len(set(at)) == 2
    C.set_radii(root, {int(n): 0.0 for n in set(at)})
    own, other = int(at[0]), int(at[-1])
    score = float(points[0] @ points[-1])
    C.set_bounds(root, {own: score, other: score})
    assert {(own, other), (other, own)} <= {(a, b) for a, b, *_ in C.node_pairs(root, root)}


def brute_marginals(parents, unary, edge):
    n = len(parents)
    total = np.zeros((n, 2))
    for state in range(2**n):
        label = [(state >> i) & 1 for i in range(n)]
        weight = np.exp(sum(unary[i, label[i]] + (edge[i, label[parents[i]], label[i]] if parents[i] >= 0 else 0) for i in range(n)))
        for i in range(n):
            total[i, label[i]] += weight
    return total[:, 1] / total.sum(axis=1)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(8)
    page = H.Page()
    for i in range(1, 9):
        page.tags.append("div"), page.names.append(""), page.parents.append(int(rng.integers(0, i))), page.chars.append(0), page.links.append(0)
    unary, edge = rng.normal(size=(9, 2)), rng.normal(size=(9, 2, 2))
    got, _, total = H.marginals(H.Forest([page]), unary, edge)
    assert np.allclose(got, brute_marginals(page.parents, unary, edge))
    assert np.isfinite(total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies on all of these pages.</p></div>
<article><h1>Title &amp; more</h1><p><b>First  para<br>here &lt;b&gt; caf&eacute;.<p>Ok.</p><div class="ad">Buy now and save</div><ul><li>one<li>two</ul><blockquote>quoted words</blockquote></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think this is wrong in many ways.</p></div></section>
<form><label>Mail</label><button>Go</button></form><aside><p>Read this other piece too</p></aside><footer>&copy; all rights <p>of ours</footer>"""


def test_main_text_of_pages(spark):
    want = "Title & more\nFirst para here <b> café.\nOk.\none\ntwo\nquoted words"
    rows = [(1, "u", PAGE), (2, "u", PAGE[: PAGE.index("</article>")]), (3, None, None), (4, "u", ""), (4, "u", ""), (None, "u", "<p>alone</p><p>next</p>"), (6, "u", "<article>" + "<p>long text</p>" * 5000), (7, "u", "<p>cut <a hre"), (8, "u", "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in H.extract_pages(frame).where("page_id <> 8 or page_id is null").collect())
    texts = [(1, want), (2, want), (3, ""), (4, ""), (4, ""), (None, "alone\nnext"), (6, "\n".join(["long text"] * 5000)), (7, "cut")]
    assert got == Counter((i, t, len(t)) for i, t in texts)
    assert H.extract_pages(frame).count() == len(rows) and H.extract_pages(frame.limit(0)).count() == 0


# pages written by hand, with layouts and names that the training pages do not have, and their main text
BY_HAND = [
    ("<p don't>Hello there everyone</p><p>Second one here</p>", "Hello there everyone\nSecond one here"),
    ('<article><p class="a"b">First text of it</p><p>Next</p></article>', "First text of it\nNext"),
    ('<article><p class="open>Text of the first paragraph.</p><p class="x">Second paragraph.</p></article>', "Text of the first paragraph.\nSecond paragraph."),
    ("<article><p class='open>Text of the first paragraph.</p><p>Second paragraph.</p></article>", "Text of the first paragraph.\nSecond paragraph."),
    ('<div class="main"><p title="a > b" =odd id=>Shown text</p></div>', "Shown text"),
    ('<article><h1>T</h1><div class="related-work"><p>Earlier studies have shown that this works.</p></div><p class="more">There is more to say on this subject.</p><h2 class="header">Results</h2><p class="byline">By A. Writer</p><p class="print">All of it holds.</p></article>', "T\nEarlier studies have shown that this works.\nThere is more to say on this subject.\nResults\nBy A. Writer\nAll of it holds."),
    ("Just a few words without any tags at all, which a page may hold, say in a text file that was served as a page.", "Just a few words without any tags at all, which a page may hold, say in a text file that was served as a page."),
    ("short text", "short text"),
    ("<body>Some words directly below the body element, then <b>bold ones</b> and an end.</body>", "Some words directly below the body element, then bold ones and an end."),
    ('<table><tr><td><a href="/">Home</a><br><a href="/b">About</a></td><td><p>The main column holds the text of the page, which is of some length.</p><p>And more of it follows here.</p></td></tr></table>', "The main column holds the text of the page, which is of some length.\nAnd more of it follows here."),
    ("<main><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></main>", "Let x=2 hold."),
    ('<div id="wrapper"><div id="header"><a href="/">Site</a></div><div id="content"><h2>News of the day</h2><p>It rained a lot in the north of the country.</p><div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div><p>The south stayed dry.</p></div><div id="footer">All rights reserved</div></div>', "News of the day\nIt rained a lot in the north of the country.\nThe south stayed dry."),
    ('<div class="cookie-notice">We use cookies to make it better. <a href="/c">More</a></div><article><h1>A day out</h1><p>We went to the sea.</p><ul><li>sand</li><li>water</li></ul></article><section id="comments"><h3>2 comments</h3><div class="comment"><p>Lovely piece, thanks for writing it down.</p></div></section>', "A day out\nWe went to the sea.\nsand\nwater"),
    ('<form action="/s"><label>Search</label><input name=q><button>Go</button></form><main><p>One result only, in one sentence.</p></main>', "One result only, in one sentence."),
    ('<article><p>Text.</p><div class="ad">Buy now!</div><p>More text.</p><aside><p>Read also this</p></aside></article>', "Text.\nMore text."),
]


@pytest.mark.parametrize(("source", "text"), BY_HAND)
def test_pages_written_by_hand(source, text):
    assert H.extract(H.trained(), [source]) == [text]


def test_no_page_of_text_comes_out_empty():
    rng = np.random.default_rng(3)
    names = ["related-work", "more", "header", "print", "byline", "meta", "notice", "top"]
    for n in (1, 5, 40, 200):
        text = " ".join(["word"] * n)
        for source in (text, f"<p>{text}</p>", f"<div>{text}</div>", f"<body>{text}<br>{text}", f"<article>{text}</article>"):
            assert H.extract(H.trained(), [source])[0]
        body = "".join(f'<{t} class="{rng.choice(names)}">{text}</{t}>' for t in rng.choice(["p", "h2", "div", "section"], 8))
        assert H.extract(H.trained(), [f"<article>{body}</article>"])[0].count(text) == 8


def test_held_out_pages():
    model, right, total = H.trained(), 0, 0
    for source, labels in H.labelled_pages(80, seed=99):
        content = model.contents([H.parse(source)])[0]
        right += int(((content >= 0.5) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.95

"""Periodic runs, spelling variants and page texts against brute force."""

import hashlib
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from voxelforge.llm import jaccard, pages, periodic, topk, variants  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long, word string, runs string, start long, __w string, form string, page_id string, host string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", 1, "w", "r", 2, "v", "f", "p", "h") for i, t in texts], SCHEMA)


def all_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e - s + q >= max(6, 4 * q) and e > s:
                out.setdefault((s, e - s + q), q)
            s = max(e, s + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed):
    """Word lists with runs of all sorts: few letters, periods of periods, Fibonacci words."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 300))
    kind = seed % 4
    if kind == 0:
        return rng.integers(0, int(rng.integers(1, 4)), n).tolist()
    if kind == 1:
        out = []
        while len(out) < n:
            out += rng.integers(0, 3, int(rng.integers(1, 40))).tolist() * int(rng.integers(1, 8))
        return out
    if kind == 2:
        part = [0] * int(rng.integers(1, 20)) + [1] * int(rng.integers(0, 20))
        return (part * int(rng.integers(1, 7)) + [2] * int(rng.integers(0, 3))) * int(rng.integers(1, 7))
    a, b = [0, 1], [0]
    while len(a) < n:
        a, b = a + b, a
    return a[:n] * int(rng.integers(1, 6))


def test_runs_are_brute_force():
    for first in range(0, 160, 8):
        texts = [repetitive(first + i) for i in range(8)]
        word = np.array([w for t in texts for w in t], np.int64)
        doc, start, length, period = periodic.runs_of(word, np.cumsum([0] + [len(t) for t in texts]))
        for i, t in enumerate(texts):
            own = doc == i
            assert list(zip(start[own], length[own], period[own], strict=True)) == all_runs(t)


def test_wavelet_tree_counts_and_orders():
    rng = np.random.default_rng(3)
    values = rng.permutation(500)
    tree = periodic.WaveletTree(values, 9)
    lo = rng.integers(0, 500, 200)
    hi = np.minimum(lo + rng.integers(0, 60, 200), 500)
    v, k = rng.integers(0, 600, 200), rng.integers(0, 50, 200)
    for i, (below, kth) in enumerate(zip(tree.below(lo, hi, v), tree.kth(lo, hi, k), strict=True)):
        part = np.sort(values[lo[i] : hi[i]])
        assert below == (part < v[i]).sum()
        assert kth == (part[k[i]] if k[i] < len(part) else periodic.NONE)


def planted(i, t):
    w = WORD.findall(t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
    return w


def check_runs(got, texts):
    want = Counter()
    for i, t in texts:
        w = planted(i, t)
        found = all_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        want[(i, len(found), *best, best[1] and 1000 * best[1] // best[2], *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, found))))] += 1
    assert Counter(tuple(r) for r in got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()) == want


def odd_texts():
    base = " ".join(f"word{i}" for i in range(60))
    return [(1, base), (2, base), (3, (base + " ") * 5), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (7, "one"), (8, "a b " * 9), (8, "x " * 7), (None, "again " * 40), (9, "x" * 5000), (10, "x y\n" * 3000), (12, "    日本 " * 6), *((i, base + " tail " + base) for i in range(100, 140))]


def digests(docs):
    """The query's columns for any table: through a folder, as the query reads one."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs.write.parquet(f"{folder}/documents.parquet")
    return periodic.op11_periodic_runs(docs.sparkSession, folder)


def test_periodic_runs_odd(spark):
    texts = odd_texts()
    check_runs(digests(table(spark, texts)), texts)
    assert digests(table(spark, [])).count() == 0


def test_periodic_runs_query_is_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").where(F.length("text") < 6000)
    texts = [tuple(r) for r in docs.collect()]
    check_runs(digests(docs), texts)


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(texts):
    n = Counter()
    for i, t in texts:
        for w in LETTERS.findall(t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    close = {w: [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n)


def variants_of(docs):
    got = variants.group_variants(variants.count_words(docs)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return Counter(tuple(r) for r in got)


def test_variants_odd(spark):
    chain = "variation " * 1100 + "variatiom " * 105 + "variatiim " * 10 + "variaiim " * 2
    texts = [(1, chain), (1, chain), (2, None), (3, ""), (None, "élève×s÷ élève×s÷ Ābcdefgh Abcdefgh abcdefgh"), (4, "x" * 30_000 + " " + "x" * 30_001 + " " + "x" * 30_001), (5, "x" * 30_000), (6, "aaaabbb aaaabbb bbbaaaa bbbaaaa tieabcd tieabcd tieabce tieabce tieabcf")]
    texts += [(i, "tieabcd tieabce " * 20 + "tieabcf") for i in range(10, 14)]
    assert variants_of(table(spark, texts)) == grouped(texts)
    assert not variants_of(table(spark, []))


@pytest.mark.parametrize("leaf", [2000, 40])
def test_variants_are_brute_force_in_any_leaves(spark, monkeypatch, leaf):
    monkeypatch.setattr(variants, "LEAF", leaf)
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").where(F.length("text") < 2500)
    texts = [tuple(r) for r in docs.collect()]
    assert variants_of(docs) == grouped(texts)


def test_upper_trees_reach_every_near_word():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.choice(list(b"abcd"), 8).tolist()) for _ in range(900)})
    letters = variants.codes(words, 8)
    kinds = variants.Points(letters[::4])
    tree = variants.KdTree(kinds.of(letters[::4], 4), 12, tight=False)
    points = kinds.of(letters, 4)
    home, reached = tree.leaf_of(points), {(leaf, q) for leaf, _, own in tree.reached(tree.code.of(points), 1) for q in own.tolist()}
    assert tree.leaves > 6
    assert all((home[j], i) in reached for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b))


def page_table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", 1) for i, u, h in rows], "page_id long, url string, html string, host string, paths string, path string, n int")


def page_texts(spark, rows):
    return {r["page_id"]: r for r in pages.extract_text(page_table(spark, rows)).collect()}


BLOG = """<html><body class="home sidebar"><div id="top-menu"><a href=/>Start</a> <a href=/b>More of it</a></div><div class="cookieNotice"><p>We use cookies and you like them, all of them, always and ever.</p></div>
<div class="wrap"><div class="post post-{i}"><h1>Title {i} &amp; so on</h1><div class="entry">{body}</div><div class=share-buttons><p>Share this with all your friends</p></div></div>
<div class="col side-bar2"><div class="widget"><p>Other posts that you may like to read some day or other, or never.</p></div></div></div>
<div id="comments"><p>First comment, a very long one that goes on and on, longer than the text of many a page of this host.</p><form><p>Write one</p></form></div>
<div class=footer>&copy; us</div></body></html>"""


def test_page_text_by_consensus(spark):
    body = {i: "".join(f"<p>Paragraph {j} of page {i},\n with <b>words</b> and <a href=x>one link</a>.</p>" for j in range(5)) for i in range(8)}
    body[8] = "<p>Short.</p>"
    body[9] = "One<br>block <div>another</div><ul><li>item <i>a</i><li>item b</ul><table><tr><td>x<td>y</table><pre> p  q </pre><script>var a = '<p>no</p>'</script><!-- <p>no</p> --> tail"
    got = page_texts(spark, [(i, f"https://blog.example.com/{i}", BLOG.format(i=i, body=b)) for i, b in body.items()])
    for i in range(8):
        assert got[i]["text"] == "\n\n".join([f"Title {i} & so on"] + [f"Paragraph {j} of page {i}, with words and one link." for j in range(5)])
    assert got[8]["text"] == "Title 8 & so on\n\nShort."
    assert got[9]["text"] == "Title 9 & so on\n\nOne block\n\nanother\n\nitem a\n\nitem b\n\nx y\n\np q\n\ntail"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_page_text_odd(spark):
    article = "<html><body><nav>m</nav><article><header><h1>T</h1></header><p>One<p>two &lt;x&gt; &#x65e5;&nbsp;&eacute &unknown; <b>bold</article><footer>f</footer>"
    rows = [(1, None, None), (2, None, ""), (3, "not a url", "plain text & more"), (4, "http://h/", article), (4, "http://h/", article), (5, "http://H:80/x", "<html><body><article></article></body></html>"), (None, "http://h/", "<p>" * 2000 + "x" + "<div>" * 3000 + "y"), (6, "http://u@h/", "<article>cut off <p"), (7, "http://h/", "<body><script>never <p>ends"), (8, "http://h/", "</p></div>a < b <3 <article hidden>no</article>")]
    got = pages.extract_text(page_table(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {(r["page_id"], r["text"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert texts == {(1, ""), (2, ""), (3, "plain text & more"), (4, "T\n\nOne\n\ntwo <x> 日 é &unknown; bold"), (5, ""), (None, "x\n\ny"), (6, "cut off"), (7, ""), (8, "a < b <3")}
    assert pages.extract_text(page_table(spark, [])).count() == 0


def test_page_text_query(spark):
    """The pages of the tables hold one article each: plain patterns find it."""
    import html

    got = {r["page_id"]: r for r in pages.op13_page_text(spark, f"{DATA}/sf0.001").collect()}
    for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect():
        body = re.sub("</?b>", "", re.search("<article>(.*?)</article>", r["html"], re.S)[1])
        want = "\n\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split("</?(?:p|h1)>", body.replace("<br>", " "))) if x)
        assert (got[r["page_id"]]["url"], got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (r["url"], want, len(want))


def test_pages_take_linear_time():
    import time

    for source in ("<div>" * 100_000, "<" * 300_000, '<a "' * 50_000, "<!--" * 50_000, "<script>" * 50_000, "</p>" * 100_000, "<ul><li>a" * 30_000, "<a " + "class=x " * 100_000, "<p><i>" * 50_000 + "<div>" * 30_000, "&" * 300_000):
        began = time.time()
        pages.Page(source).texts([">html>body"])
        assert time.time() - began < 20


def test_nodes_of_texts_are_cut_from_sha256(spark):
    texts = ["", "one", "日本 two", "x" * 10_000]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", jaccard.text_key(F.col("text")).alias("k")).collect()
    assert {r["text"]: r["k"] for r in got} == {t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big", signed=True) for t in texts}


def test_large_products_are_exact_or_raise(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**31, 1.0]), (2, [2.0**31, 0.0]), (3, [2.0**31, 1.0]), (4, [-(2.0**31), 5.0]), (5, [2.0**30, 1.0])]
    vectors = lambda rows: topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1)
    both = vectors(rows)
    got = [tuple(r)[:4] for r in topk.top_k(both.where("id = 0"), both, 10).orderBy("rank").collect()]
    want = sorted(((i, sum(int(a) * int(b) for a, b in zip(rows[0][1], v, strict=True))) for i, v in rows[1:]), key=lambda r: (-r[1], r[0]))
    assert got == [(0, n + 1, i, score) for n, (i, score) in enumerate(want)]
    large = vectors([(i, [2.0**40, 2.0**40 - i]) for i in range(4)])
    with pytest.raises(Exception, match="exceeds 62 bits"):
        topk.top_k(large.where("id = 0"), large, 10).collect()

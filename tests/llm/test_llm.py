"""Training-data operators: odd inputs, brute force, exact round trips and held-out accuracy."""

import os
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import DATA, same  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from voxelforge import llm  # noqa: E402
from voxelforge.llm import bpe, chat, jaccard, langid, packing, pii, quality, substring, topk, toxicity  # noqa: E402

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, grp int, starts string, key long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, "x", 1, "y", 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long, repeated rows, ties, control strings, and extra columns with internal names."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word7 ", "changed ")
    texts = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (7, "one"), (8, "one two"), (9, "x" * 50_000), (10, " ".join(["again"] * 3000)), (11, base.upper()), (12, "</s> <|turn|> &lt; ünï   日本"), (13, "tail " + base + " end"), (14, "<|endoftext|> A  b\n\n\nc ")]
    return texts, table(spark, texts)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_sql(spark, duck, name):
    want = duck.sql(llm.ORACLES[name]).df()
    same(llm.QUERIES[name](spark, f"{DATA}/sf0.001").select(*want.columns).toPandas(), want)


def links(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, set()).update([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else [])
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                part[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(5, 80), (3, 90)])
def test_jaccard_is_brute_force(docs, odd, k, num):
    for texts, df in (([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], docs), odd):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(df, k, num, 100).collect()}
        assert got == links(texts, k, num, 100)


def test_jaccard_in_several_blocks(docs, monkeypatch):
    texts = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(jaccard, "ROUTE_ROWS", 3)
    monkeypatch.setattr(jaccard, "HOT", 1)  # no digest is hot; in the other tests all are
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.ngram_jaccard(docs, 5, 80, 100).collect()}
    assert got == links(texts, 5, 80, 100)


def repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = c.replace("c7 ", "other ")
    return table(spark, [(1, a), (2, b), (2, c), (3, near), (3, d), (4, a), (4, b + " end"), (5, "e"), (5, "e"), (5, ""), (None, "f g"), (None, "h i"), (None, a), (None, None), (None, "j k"), (None, "j k")]), (a, b, c, d)


def test_keep_one_with_repeated_and_null_ids(spark):
    df, (a, b, c, d) = repeated_ids(spark)
    want = [(1, a), (2, b), (2, c), (3, d), (5, ""), (5, "e"), (None, None), (None, "f g"), (None, "h i"), (None, "j k")]
    for parts in (1, 7):
        got = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(df.repartition(parts), 5, 80, 100).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("hot", [jaccard.HOT, 1])
def test_jaccard_with_repeated_and_null_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 500_000 if hot > 1 else 0)
    df, (a, *_) = repeated_ids(spark)
    got = jaccard.ngram_jaccard(df, 5, 80, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"]) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1), (5, 5), (5, 5), (5, 5)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] * 6
    assert jaccard.keep_one(df, 5, 80, 100).count() == 10


def test_count_tree_loses_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[rng.random(300) > 0.05], rng.integers(0, 2**63, 5, dtype=np.uint64)))) for _ in range(80)]
    pts = jaccard.points(sets)
    tree = jaccard.CountTree(pts)
    for i, a in enumerate(sets):
        near = set(tree.search(pts[i], 80, 100).tolist())
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert j in near


def repeats(texts, window):
    first, out = {}, {}
    words = [(i, WORD.findall(t or "")) for i, t in texts]
    for i, w in words:
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, i), i)
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_substrings_of_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, b, 1), (7, b, 1), (7, a, 1), (7, a, 1), (None, a, 1), (8, a + " end", 1), (9, "", 1), (9, None, 1)], "doc_id long, text string, row_key int")
    want = sorted([(1, b, 1), (7, "", 1), (7, a, 1), (7, a, 1), (None, a, 1), (8, "end", 1), (9, "", 1), (9, None, 1)], key=str)
    for parts in (1, 5):
        assert sorted(map(tuple, substring.dedupe_texts(df.repartition(parts), 13).collect()), key=str) == want


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_windows_with_equal_labels_are_told_apart_by_their_words(docs, monkeypatch, broadcast):
    texts = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    plain = substring.suffixes
    monkeypatch.setattr(substring, "BROADCAST_ROWS", broadcast)

    def coarse(words, window):
        label, doc, pos = plain(words, window)
        return label & np.uint64(0xFFF000000000F), doc, pos

    monkeypatch.setattr(substring, "suffixes", coarse)
    got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedupe_substrings(docs.repartition(4), 13).collect()}
    assert got == repeats(texts, 13)


@pytest.mark.parametrize("group", [substring.GROUP, 200])
def test_substrings_are_brute_force(docs, odd, group):
    for texts, df in (([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], docs), odd):
        got = {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedupe_substrings(df, 13, group).collect()}
        assert got == repeats(texts, 13)


def test_packing(odd):
    from tokenizers import Tokenizer

    texts, df = odd
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack_documents(df, path, 64, group_docs=5).toPandas()
    want = Counter()
    for i, t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        for s in range(0, len(ids), 64):
            want[i, s, ids[s : s + 64].tobytes(), len(ids)] += 1
    assert Counter(zip(got.doc_id, got.start, map(bytes, got.ids), got.doc_tokens, strict=True)) == want
    assert all(zlib.crc32(b) == c for b, c in zip(got.ids, got.ids_crc32, strict=True))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64


def test_first_fit_decreasing_is_the_plain_rule():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 65, 200)
    bins, offsets = packing.first_fit_decreasing(sizes, 64)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        b = next((b for b, f in enumerate(free) if f >= sizes[i]), len(free))
        if b == len(free):
            free.append(64)
        assert (bins[i], offsets[i]) == (b, 64 - free[b])
        free[b] -= sizes[i]


def test_bpe_is_the_library(odd):
    import tiktoken

    texts, df = odd
    path = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = bpe.encode_decode(df, path, P.PATTERN).collect()
    want = sorted((i, len(lib.encode_ordinary(t or "")), " ".join(map(str, lib.encode_ordinary(t or ""))), (t or "").encode()) for i, t in texts)
    assert sorted((r["doc_id"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in got) == want


def test_chat_round_trip_and_merging(spark):
    turns = [(1, 0, "user", "a <|turn|> & &lt;"), (1, 1, "assistant", "b"), (1, 2, "assistant", "<|end|>"), (1, 2, "assistant", "<|end|>"), (2, None, None, None), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, ts string")
    out = chat.format_chats(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["t"]] == [(r, t) for _, _, r, t, *_ in turns[:4]]
    assert got[1]["formatted"].count("<|turn|>") == 2 and got[1]["loss"] == "b<|end|><|end|>"
    assert [tuple(t) for t in got[2]["t"]] == [("", "")] and got[3]["loss"] == ""


def test_quality_base_counts(docs, odd):
    for texts, df in (([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], docs), odd):
        want = Counter()
        for i, t in texts:
            w, seen, dup = WORD.findall(t or ""), set(), 0
            for line in (t or "").split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            grams = Counter(zip(w, w[1:], w[2:], strict=False))
            rep = {p + j for p in range(len(w) - 2) if grams[w[p], w[p + 1], w[p + 2]] > 1 for j in range(3)}
            want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
        got = quality.quality_rules(df).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)


def test_distance_is_that_of_jensen_and_shannon():
    from math import log2, sqrt

    p, q = [3, 0, 5, 2], [1, 4, 0, 5]
    a, b = [x / 10 for x in p], [x / 10 for x in q]
    kl = lambda x, y: sum(u * log2(u / ((u + v) / 2)) for u, v in zip(x, y, strict=True) if u)
    assert np.isclose(quality.distance(np.array([p]), np.array(q))[0], sqrt((kl(a, b) + kl(b, a)) / 2))
    assert quality.distance(np.zeros((1, 4)), np.array(q))[0] == 1.0


def test_quality_references_are_plain_counts(docs):
    want = {}
    for r in docs.where("lang IS NOT NULL").collect():
        want.setdefault(r["lang"], Counter()).update(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")))
    got = quality.references(docs)
    assert set(got) == set(want)
    for lang, (chars, place, n) in got.items():
        top = sorted(want[lang].items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]
        assert list(place) == [w for w, _ in top] and list(n[: len(top)]) == [c for _, c in top]
        assert n.sum() == sum(want[lang].values()) and chars.sum() == sum(len(r["text"] or "") for r in docs.where(F.col("lang") == lang).collect())


def test_quality_keeps_prose_and_drops_symbols(spark, docs):
    prose = [r["text"] for r in docs.where("n_chars > 2000").limit(1).collect()]
    junk = " ".join(w + "%%%***" for w in prose[0].split())
    judged = quality.quality_rules(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, junk, None)], "doc_id long, text string, lang string")))
    assert judged.where("doc_id = -1").first()["kept"] is False
    assert judged.where("kept").count() > 0.6 * docs.count()


def test_language_held_out(spark):
    got = langid.op7_language_id(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 100").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_languages_of_one_script_and_rare_letters(spark):
    rng = np.random.default_rng(3)
    letters = {"ka": "აბგდევზთიკლმნოპ", "kb": "ჟრსტუფქღყშჩცძწჭ"}

    def text(alphabet):
        return " ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(30))

    rows = [(i, lang, text(alphabet[:10] + alphabet[5:])) for i, (lang, alphabet) in enumerate(sorted(letters.items()) * 40)]
    df = spark.createDataFrame([*rows, (900, None, "𰀀𰀁𰀂"), (901, None, "1 2 3")], "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in langid.language_id(df, df.where("doc_id % 4 < 2 AND lang IS NOT NULL").select("lang", "text")).collect()}
    assert all(got[i]["lang_pred"] == lang for i, lang, _ in rows)
    assert got[900]["lang_pred"] != "und" and got[901]["lang_pred"] == "und"


def test_bundle_is_the_sum_of_bound_letters():
    text = "Ab, ab Яж"
    v = lambda c, by: np.roll(langid.letter_vectors(np.array([ord(c) if c != " " else 0]))[0].astype(int), by)
    padded = " ab ab яж "
    want = sum(v(a, 2) * v(b, 1) * v(c, 0) for a, b, c in zip(padded, padded[1:], padded[2:], strict=False))
    assert np.array_equal(langid.bundle(text), want)
    langid._STATE.clear()


def test_texts_of_several_routes_meet_once(spark, docs, monkeypatch):
    seen = []
    edges = jaccard.route_edges
    monkeypatch.setattr(jaccard, "route_edges", lambda routed, num, den: (seen.append(routed), edges(routed, num, den))[1])
    jaccard.ngram_jaccard(docs, 5, 80, 100).count()
    by_route = seen[0].groupBy("key").agg(F.array_sort(F.collect_list("a")).alias("texts")).toPandas()
    assert len(by_route) and not by_route["texts"].map(tuple).duplicated().any()


def test_parts_by_bound_are_brute_force():
    rng = np.random.default_rng(8)
    pts = rng.integers(0, 6, (3, 64))[rng.integers(0, 3, 60)] + (rng.random((60, 64)) < 0.4) * rng.integers(0, 3, (60, 64))
    start = [i if i % 5 else 0 for i in range(60)]
    size = pts.sum(1)
    both = np.minimum(pts[:, None], pts[None]).sum(2)
    near = (180 * both >= 80 * (size[:, None] + size)) & (100 * size[:, None] >= 80 * size) & (100 * size >= 80 * size[:, None]) | (np.array(start)[:, None] == start)
    for _ in range(6):
        near = near @ near
    assert jaccard.bound_parts(pts.astype(np.int32), 80, 100, start).tolist() == near.argmax(1).tolist()


@pytest.mark.parametrize("table", [65_536, 40])
def test_remembered_trigrams_change_no_bundle(monkeypatch, table):
    monkeypatch.setattr(langid, "TABLE", table)
    langid._STATE.clear()
    texts = ["", " \n", "a", "Ab, ab", "ΟΔΟΣ Σ", "日本語テキスト" * 9, "".join(map(chr, range(0x4E00, 0x5000))), "x" * 999, "no no no, never"]
    for text in texts * 2:
        kind, count = np.unique(langid.trigrams(text), return_counts=True)
        got, n = langid.profile(text, damped=True)
        assert n == len(kind) and (got is None) == (n == 0)
        if n:
            np.testing.assert_allclose(got, (1 + np.log(count)) @ langid.trigram_vectors(kind).astype(float), atol=1e-3)
    langid._STATE.clear()


def test_language_odd(spark, odd):
    texts, df = odd
    got = {r["doc_id"]: r for r in langid.language_id(df, df.select("lang", "text")).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {4, 5, 6}
    none = langid.language_id(df, df.where("false").select("lang", "text"))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_language_stage_rejects_by_language(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    junk = ["".join(rng.choice(list("qxzjkvwpfg   "), 3000)), "".join(rng.choice(list("бвгджзклмн   "), 3000)), "%$ #@ {}; " * 200 + "x"]
    short = ["The of and.", "Der und die.", "Avec les.", "Edrere."]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)] + [(-101 - i, t) for i, t in enumerate(short)], "doc_id long, text string")
    both = docs.unionByName(more, allowMissingColumns=True)
    got = {r["doc_id"] for r in corpus_pipeline.language(spark, both, "").select("doc_id").collect()}
    want = {r["doc_id"] for r in docs.select("doc_id").collect()} | {-101 - i for i in range(len(short))}
    assert got == want
    unlabelled = both.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").count() == both.count()


PLAIN = {  # the base patterns as they are stated, with their checks
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.findall("[0-9]", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.findall("[0-9]", m)))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.findall("[0-9]", m)) <= 15),
}


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_is_plain_matching(docs, odd):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list(letters), n)) for letters in ("a1.@-_ +", "19.. a", "4 -1", "+1( )-.", "4111 -@.+a") for n in (5, 30, 80) for _ in range(300)]
    texts += ["4111 1111 1111 1111", "x@y.z_q@r.s", "a@b@c.de", "1.2.3.4.5.6.7.8"]
    for t in texts:
        assert [s[:3] for s in pii.spans(t) if s[0] in PLAIN] == plain_spans(t), t
    for df in (docs, odd[1]):
        rows = Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
        want = Counter()
        for (i, t), n in rows.items():
            own = plain_spans(t or "")
            want[i, tuple(sum(s[0] == k for s in own) for k in PLAIN), ",".join(f"{k}:{a}:{b}" for k, a, b in own)] += n
        assert Counter((r["doc_id"], tuple(r[f"n_{k}"] for k in PLAIN), r["base"]) for r in pii.find_pii(df).collect()) == want


def test_pii_of_very_long_runs_takes_linear_time():
    for t in ("1" * 1_000_000 + " . ", "a" * 1_000_000 + " @ b", "1." * 300_000, "a@" * 300_000, "+1 " * 200_000, "-" * 500_000 + "1"):
        began = time.process_time()
        pii.spans(t)
        assert time.process_time() - began < 6


def test_pii_further_kinds_and_masks():
    text = "mail a.b@c.de, 10.0.0.256 and 10.0.0.25, card 4111 1111 1111 1111 x, 4111-1111-1111-1112; tel +49 (30) 123456 IBAN DE89 3704 0044 0532 0130 00. ssn 123-45-6789; " + "1" * 9000 + ".2.3.4"
    got = pii.spans(text)
    assert [(k, text[a:b]) for k, a, b, _ in got] == [("email", "a.b@c.de"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123456"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789")]
    assert pii.mask("a b@c.de " + "x" * 20) == "a [EMAIL] " + "x" * 20
    key = "0a1b2c3d4e5f60718293"
    assert pii.mask(f"api_key={key}") == "api_key=[SECRET]" and pii.mask(f"{key} is the password") == "[SECRET] is the password"
    assert pii.mask(f"the monkey {key} ate") == f"the monkey {key} ate"  # no whole word
    assert pii.mask("DE89 3704 0044 0532 0130 01") == "DE89 3704 0044 0532 0130 01"


def test_toxicity_held_out(spark):
    sf = f"{DATA}/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op10_toxicity(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() > 0 and (got.predicted == got.toxic).mean() > 0.95
    assert got.predicted[got.toxic == 1].mean() > 0.75 and got.predicted[got.toxic == 0].mean() < 0.02


def test_marginals_are_those_of_the_chain():
    rng = np.random.default_rng(4)
    e, t = rng.standard_normal((1, 6)), rng.standard_normal((2, 2))
    model = toxicity.Chain({}, t, np.zeros(3))
    weight = {}
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        weight[tuple(y)] = np.exp(sum(e[0, i] * y[i] for i in range(6)) + sum(t[y[i], y[i + 1]] for i in range(5)))
    total = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(6)]
    assert np.allclose(model.marginals(e, np.ones((1, 6), bool))[0], want)
    longer, mask = np.zeros((1, 9)), np.arange(9)[None] < 6
    longer[:, :6] = e
    pairs = model.pair_marginals(longer, mask)
    for i in range(5):
        for a in (0, 1):
            for b in (0, 1):
                assert np.isclose(pairs[a, b, 0, i], sum(w for y, w in weight.items() if y[i] == a and y[i + 1] == b) / total)
    assert not pairs[..., 5:].any()


def test_toxicity_odd(spark, odd):
    _, df = odd
    more = df.unionByName(spark.createDataFrame([(100 + i, f"plain words and {w} here number {i}", "en", "s", 1, 1, "x", 1, "y", 2) for i in range(60) for w in [("vile" if i % 3 == 0 else "kind")]], SCHEMA))
    labels = more.where("doc_id >= 100").selectExpr("doc_id", "CAST(doc_id % 3 = 1 AS INT) AS toxic", "'z' AS text").union(spark.sql("SELECT 4L, 1, 'z' UNION ALL SELECT NULL, 1, NULL UNION ALL SELECT 5L, NULL, ''"))
    got = toxicity.toxicity(more, labels).collect()
    assert len(got) == more.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (4, 5, 6)} == {next(r["score"] for r in got if r["doc_id"] == 5)}
    one = toxicity.toxicity(more, labels.where("toxic = 0"))
    assert {r["predicted"] for r in one.collect()} == {0}


def test_toxicity_sample_is_bounded_before_it_is_collected(docs, spark):
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 4 = 0 AS INT) AS toxic")
    texts, toxic = toxicity.sample_rows(docs.union(docs), labels, F.lit(True), (30, 10), 100_000)
    assert 0 < sum(map(len, texts)) <= 100_000 and len(texts) == len(toxic) <= 40 and max(map(len, texts)) <= 1000
    assert toxicity.sample_rows(docs, labels.where("false"), F.lit(True)) == ([], [])


def test_top_k_odd(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [None, 0.1]), (4, [float("nan"), 1.0]), (5, [0.5, 0.25]), (5, [0.5, 0.25]), (6, [0.1]), (7, []), (None, [1.0, 1.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, q long")
    v = topk.integer_vectors(df, "vec_id", "embedding")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.top_k(v.where("id = 0"), v, 2).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 5)]
    assert topk.top_k(v.where("id = 0"), v, 10).count() == 4
    assert topk.top_k(v.where("id = 6"), v, 10).count() == 0
    assert topk.top_k(v.where("false"), v.where("false"), 10).count() == 0


def test_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    v = topk.integer_vectors(spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet"), "vec_id", "embedding")
    got = {(r[0], r[1]): (r[2], r[3]) for r in topk.top_k(v.where("id % 100 = 0"), v, 10).collect()}
    monkeypatch.undo()
    assert got == {(r[0], r[1]): (r[2], r[3]) for r in topk.op1_topk(spark, f"{DATA}/sf0.001").collect()}


def test_empty_documents(spark, odd):
    none = odd[1].where("false")
    path = P.path("word_bpe_49k.json")
    for df in (jaccard.ngram_jaccard(none), packing.pack_documents(none, path), substring.dedupe_substrings(none), quality.quality_rules(none), langid.language_id(none, none.select("lang", "text")), bpe.encode_digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), pii.find_pii(none), toxicity.toxicity(none, none.selectExpr("doc_id", "1 AS toxic"))):
        assert df.count() == 0
    assert chat.format_chats(none.selectExpr("doc_id AS conv_id", "1 AS turn", "text", "lang AS role")).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    texts, df = odd
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(left) == {1, 7, 8, 9, 10, 12, 14}
    assert left[1] == texts[0][1] and 2 not in left and 3 not in left and 11 not in left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == len(left)


def test_pipeline_run_masks_and_keeps_clean_documents(spark):
    import corpus_pipeline

    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.run(spark, sf)
    parts = links([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 5, 80, 100)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {i for i, (_, c) in parts.items() if i == c}


def test_long_words_are_scored_but_not_remembered():
    chain = toxicity.Chain({"3xxx": 1.5, "n12": 0.25, "wok": -2.0}, np.zeros((2, 2)), np.zeros(3))
    words = ["ok", "x" * 500, "ok", "x" * 20]
    want = [sum(chain.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words]
    assert chain.emission(words).tolist() == want == chain.emission(words).tolist()
    assert set(chain.cache) == {"ok", "x" * 20}

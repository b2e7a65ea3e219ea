"""Each training-data operator against brute force, a round trip or held-out accuracy."""

import base64
import gzip
import hashlib
import os
import random
import re
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from drawlake.llm import chat, importance, langid, minhash, mixing, nndescent, pieces, quality, queries, secrets, sitetree, substrings, trie, webp

SF = "/root/testdata/sf0.001"
have_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
TOKENIZER = pytest.mark.skipif(not os.path.exists(pieces.MODEL_FILE), reason="no vocabulary here")


def words(seed, n, k=400):
    r = random.Random(seed)
    return [f"w{r.randrange(k)}" for _ in range(n)]


# --- odd input: nulls, empty and long texts, repeated rows, clashing names, empty tables ----------------------


def odd_docs(spark):
    long = " ".join(words(1, 30_000))
    near = " ".join(words(2, 200))
    rows = [(1, None, None, None), (2, "", "en", "src1"), (3, "   \n\t ", "en", None), (4, "one two", "fr", "src2"), (5, "One TWO", "fr", "src2"), (6, long, "en", "src1"), (7, long + " tail", "en", "src1"), (8, near, None, "x"), (8, near, None, "x"), (9, near + " more", "de", "src13"), (None, near, "en", "src1"), (10, "é́ \U0001f600 \u0000 12345", "es", "")]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, n int, component_id string, epoch string, h long, b string, key string"
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "z", 1, "c", "e", 3, "q", "k") for r in rows], names)


def labels(spark, rows=((1, 1), (2, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int")


def test_odd_documents(spark):
    docs = odd_docs(spark)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert len(got) == 11 and got[2]["n_shingles"] == got[3]["n_shingles"] == got[1]["n_shingles"] == 0
    assert got[4]["component_id"] == got[5]["component_id"] == 4 and not got[5]["kept"]
    assert got[6]["component_id"] == got[7]["component_id"] == 6
    assert got[9]["component_id"] == 8 and got[None]["kept"] and got[None]["component_id"] is None
    left = minhash.without_duplicates(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 8, 10]
    assert secrets.find_secrets(docs).count() == 12
    assert secrets.mask_secrets(docs).columns == docs.columns
    scored = quality.quality_scores(docs, labels(spark))
    assert scored.count() == 12 and scored.where("score between 0 and 1 and predicted in (0, 1)").count() == 12
    assert quality.keep_good(docs, labels(spark)).columns == docs.columns
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.predicted_languages(docs).collect()}
    assert lang[1] == lang[2] == lang[3] == "und" and len(lang) == 11
    mixed = mixing.mix(docs)
    assert mixed.columns == [*(c for c in docs.columns if c != "epoch"), "epoch"] and mixed.count() > 0
    assert webp.text_media(docs).count() == 12


def test_clashing_names_keep_their_values(spark):
    names = ["h", "slice", "whole", "rest", "slices", "uses", "row", "k_id", "k_lang", "last", "cut_slice", "tokens", "other_id", "held_text", "held_text_", "score", "count", "a", "b", "id", "comp"]
    rows = [(i, f"text number {i} of its own {'w ' * i}", "en", f"src{i % 3}", *(f"{n}{i}" for n in names)) for i in range(30)] + [(31, "text number 31 of its own", None, None, *("z" for _ in names))]
    docs = spark.createDataFrame(rows + rows[:2], ["doc_id", "text", "lang", "source", *names])
    want = {r[0]: r[4:] for r in rows}
    frames = [mixing.mix(docs), minhash.without_duplicates(docs), quality.keep_good(docs, labels(spark, [(i, i % 2) for i in range(30)])), secrets.mask_secrets(docs)]
    if os.path.exists(pieces.MODEL_FILE):
        frames.append(pieces.encoded(docs))
    for f in frames:
        got = f.collect()
        assert got and all(tuple(r[n] for n in names) == want[r["doc_id"]] for r in got)


@TOKENIZER
def test_odd_documents_encoded(spark):
    rows = pieces.encoded(odd_docs(spark)).collect()
    assert len(rows) == 12 and all(r["round_trip"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}


def test_empty_tables(spark):
    docs = odd_docs(spark).where("doc_id < 0")
    empty = labels(spark).where("doc_id < 0")
    frames = [minhash.near_duplicates(docs), minhash.without_duplicates(docs), secrets.find_secrets(docs), quality.quality_scores(docs, empty), langid.predicted_languages(docs), mixing.mixture(docs), webp.text_media(docs)]
    frames.append(chat.render_maximal(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    frames.append(sitetree.main_text(spark.createDataFrame([], "page_id long, url string, html string")))
    frames.append(nndescent.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")))
    for f in frames:
        assert f.count() == 0


# --- 1 --------------------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<aside class=sidebar>Side</aside><!-- ad --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;  block<br><p>Second &copy; &#1046; block
goes on<div class="share-buttons">Share</div><form><input value=x>Sign up</form><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></article>
<section id="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""


def test_page_text():
    assert sitetree.article(PAGE) == "Title & more\nFirst block\nSecond © Ж block goes on\none\ntwo\nc1\nc2"
    assert [sitetree.article(s) for s in (None, "", "<p>", "<div><p>a</div>", "plain &lt;text&gt;", "<!--")] == ["", "", "", "a", "plain <text>", ""]


def test_class_names_are_no_rule():
    assert sitetree.article('<div class="site has-sidebar"><article class="post has-comments"><header><h1>T</h1></header><p>x</p></article></div>') == "T\nx"
    assert sitetree.article('<div class="widget"><p>only text</p></div>') == "only text"
    assert sitetree.article('<article><div class="legal-history">a</div><p class="share-price">b</p><ul class="menu"><li>c</ul><math><mi>d</mi></math></article>') == "a\nb\nc\nd"
    assert sitetree.article('<header>Site</header><p>x <a href=/>a link of some length</a></p><article id="comments">c</article>') == "x a link of some length"


def site(n, host, seed=0, wrap=lambda s: s):
    """Pages whose names tell nothing: a list of links, an advert and a foot that measure alike, and a body that doesn't."""
    r = random.Random(seed)
    some = lambda k: " ".join(words(r.random(), k, 3000))
    out = []
    for i in range(n):
        body = "".join(f"<p>{some(r.randrange(5, 90))}</p>" for _ in range(r.randrange(1, 14)))
        out.append((i, f"http://{host}/{i}", f"<body><div class=k1><ul>{''.join(f'<li>{some(1)}' for _ in range(5))}</ul></div><div class=k2>{some(8)}</div>{wrap(f'<div class=k3>{body}</div>')}<div class=k4>All rights with {host} {some(3)}</div></body>"))
    return out


def body_of(html):
    return "\n".join(re.findall("<p>(.*?)</p>", html))


def by_hand(rows, least_pages, least_share):
    """Texts of pages by the definition: entropies of each branch over distinct pages, products, cuts."""
    from math import log

    seen = {}
    for _, url, html in rows:
        page = sitetree.Page(html)
        host = re.match("(?:[a-z]+:)?//([^/?#]*)", (url or "").lower())
        for key, style, pieces_of, held in page.rows():
            for h in {sitetree.ALL, host[1] if host else sitetree.ALL}:
                at = seen.setdefault((h, key), {})
                at[page.mark()] = min(at.get(page.mark(), (style, pieces_of, held)), (style, pieces_of, held))
    value = {}
    for at, pages in seen.items():
        m = len(pages)
        if m < 2:
            continue
        count = lambda xs: [xs.count(x) for x in set(xs)]
        styles, found = count([p[0] for p in pages.values()]), count([x for p in pages.values() for x in p[1]])
        presentation = -sum(c / m * log(c / m) for c in styles) / log(min(m, sitetree.LAYOUTS))
        content = 1 - sum(c * log(c) for c in found) / sum(found) / log(m)
        value[at] = m, min(presentation, 1) * content, 2 * sum(p[2] for p in pages.values()) > m
    low = {}
    for (h, key), (m, v, held) in value.items():
        if m >= least_pages:
            low[h, key] = not held and v < least_share * max(x[1] for (g, _), x in value.items() if g == h and x[0] >= least_pages)
    texts = {}
    for i, url, html in rows:
        host = re.match("(?:[a-z]+:)?//([^/?#]*)", (url or "").lower())
        h = host[1] if host else sitetree.ALL
        known = {k: low.get((h, k), low.get((sitetree.ALL, k))) for g, k in value if g == h}
        known = {k: v for k, v in known.items() if v is not None}
        texts[i] = sitetree.article(html, [k for k, v in known.items() if v] if known else None)
    return texts


def test_site_tree_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sitetree, "LEAST_PAGES", 12)
    rows = site(60, "big.org", 1) + [(100 + i, *x) for i, *x in site(9, "small.org", 2, lambda b: f"<article>{b}</article>")] + [(200, None, None), (201, "http://alone.org/", "<div class=z><p>alone</div>"), (202, None, site(1, "x")[0][2])]
    rows += [(300 + i, *x) for i, *x in site(5, "big.org", 1)]  # copies
    data = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "page_id long, url string, html string, host string, cut string, text string")
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(data).collect()}
    assert got == by_hand(rows, 12, sitetree.LEAST_SHARE)
    assert all(got[i] == body_of(html) for i, _, html in rows if i not in (200, 201)) and got[200] == "" and got[201] == "alone"
    # the tree decides: without it everything stays
    monkeypatch.setattr(sitetree, "LEAST_SHARE", 0.0)
    assert not any(r["text"] == got[r["page_id"]] for r in sitetree.main_text(data.where("page_id < 60")).collect())


def test_near_copies_keep_their_article(spark, monkeypatch):
    monkeypatch.setattr(sitetree, "LEAST_PAGES", 6)
    body = f"<p class=lead>Lead of all copies</p><p>{' '.join(words(1, 60))}</p><table><tr><td>cell</td></tr></table>"
    html = {"a": "<body><div class=ad>{0} buy</div><article>" + body + "</article><div>visit {0}</div></body>", "b": "<body><div class=ad>{0} buy</div>" + body + "</body>"}
    rows = [(20 * n + i, f"http://{host}.org/{i}", h.format(i)) for n, (host, h) in enumerate(html.items()) for i in range(9)]
    rows += [(100 + i, f"http://{host}.org/x{i}", f"<body><article><p>{' '.join(words(i + 9, 60))}</p></article></body>") for host in html for i in range(3)]
    got = {r["page_id"]: r["text"] for r in sitetree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Lead of all copies" in got[i] and "cell" in got[i] for i in (*range(9), *range(20, 29)))


# --- 2 --------------------------------------------------------------------------------------------------------


def test_snapshots_by_brute_force(spark):
    r = random.Random(5)
    convs = {}
    for i in range(60):
        base = convs[r.choice(list(convs))] if convs and r.random() < 0.6 else []
        convs[i] = base[: r.randrange(len(base) + 1)] + [(r.choice(["user", "assistant", None]), r.choice(["a", "b", "", None])) for _ in range(r.randrange(3))]
    convs = {i: c for i, c in convs.items() if c}
    keep = {i for i, c in convs.items() if not any(len(d) > len(c) and d[: len(c)] == c for d in convs.values()) and not any(d == c and j < i for j, d in convs.items())}
    rows = [(i, t, *x, "extra") for i, c in convs.items() for t, x in enumerate(c)] + [(None, 0, "user", "x", "extra")]
    got = chat.render_maximal(spark.createDataFrame(rows + rows[:3], "conv_id long, turn long, role string, text string, rendered string"))
    assert {x["conv_id"] for x in got.collect()} == keep


# --- 3 --------------------------------------------------------------------------------------------------------


def test_components_by_brute_force(spark):
    r = random.Random(7)
    texts = []
    for g in range(25):
        base = words(g, r.choice([3, 6, 30, 80, 200]))
        for _ in range(r.randrange(1, 9)):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = f"x{r.randrange(1000)}"
            texts.append(" ".join(t))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    comp = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(comp[i], comp[j])
            changed |= comp[i] != m or comp[j] != m
            comp[i] = comp[j] = m
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}


def test_estimate_is_near_the_similarity(spark):
    a, b = words(1, 900, 10**6), words(1, 900, 10**6)
    b[600:] = words(2, 300, 10**6)
    sets = [minhash.shingle_set(" ".join(t)) for t in (a, b)]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    planes, _ = minhash.signatures(sets)
    rows = [tuple(int(x) for x in p.view(np.int64)) for p in planes]
    df = spark.createDataFrame([tuple(rows)], "x struct<" + ",".join(f"{p}:bigint" for p in minhash.PLANES) + ">, y struct<" + ",".join(f"{p}:bigint" for p in minhash.PLANES) + ">")
    assert abs(df.select(minhash.estimate("x", "y")).first()[0] - true) < 0.2


# --- 4 --------------------------------------------------------------------------------------------------------


@have_tables
def test_mixture_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(mixing.oracle_sql()).fetchall()
    got = queries.op4_hierarchical_mix(spark, SF).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 10, 1), ("d1", "en", "b", 1000, 1), ("d1", "fr", "c", 1000, 1), ("d2", "en", "e", 1000, 1)], "domain string, lang string, source string, tokens long, n_docs long")
    got = {r["source"]: r["share"] for r in mixing.leaf_budgets(leaves, (400, 3010), 1, lambda level, name: mixing.F.lit(1)).collect()}
    assert got == {"a": 10, "b": 90, "c": 100, "e": 200}


# --- 5 and 9 --------------------------------------------------------------------------------------------------


@have_tables
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_compression_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    good, bad = [r["predicted"] for r in got if r["quality"] == 1], [r["predicted"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.2


def test_calibration_of_many_labels(spark):
    # more labels than both samples hold, a tenth of them bad: held-out bad texts must still be rejected
    r = random.Random(2)
    rows = [(i, int(i % 10 != 0), " ".join(r.choice(["the", "of", "plain", "prose", "reads", "well", "here"]) if i % 10 else r.choice(["xx!!", "qq##", "zz%%"]) for _ in range(30))) for i in range(16_000)]
    data = spark.createDataFrame(rows, "doc_id long, quality int, text string").repartition(4).cache()
    got = quality.quality_scores(data, data).join(data.select("doc_id", "quality"), "doc_id").where("held_out").groupBy("quality", "predicted").count().collect()
    assert {(x[0], x[1]) for x in got} == {(0, 0), (1, 1)}
    # the same in plain Python: sizes of pieces with either dictionary, and the formula of the score
    model = quality.fit(data, data)
    known = {x["doc_id"]: x["score"] for x in quality.with_score(data.where("doc_id < 40"), model).collect()}
    import zstandard

    def size(raw, d):
        known_bytes = zstandard.ZstdCompressionDict(d)
        known_bytes.precompute_compress(level=3)
        c = zstandard.ZstdCompressor(level=3, dict_data=known_bytes, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(raw[i : i + 512])) for i in range(0, len(raw), 512))

    for i, _, text in rows[:40]:
        raw = text.encode()
        g, b = size(raw, model.good), size(raw, model.bad)
        x = [(b - g) / max(g, b), (b - g) / len(raw)]
        x += [v * np.log1p(len(raw)) for v in x]
        z = sum(w * min(max((v - m) / s, -6), 6) for w, v, m, s in zip(model.weights[1:], x, model.mean, model.scale)) + model.weights[0]
        assert known[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_few_labels_give_a_score(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels(spark, [(1, 1), (2, None), (None, 0)])).collect()}
    assert len(set(got.values())) == 1 and all(0 < s < 1 for s in got.values())


@have_tables
def test_languages_held_out(spark):
    got = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_languages_by_brute_force(spark):
    import unicodedata
    from collections import Counter

    def grams(text):
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower()).split()
        return Counter(g for w in kept for n in (1, 2, 3) for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if g != " ")

    def top(c):
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], [ord(a) for a in f"{x[0]:\0>3}"]))[: langid.TOP]]

    r = random.Random(4)
    sets = {"aa": "abcdé", "bb": "bcdef", "cc": "жзий"}
    rows = [(i, " ".join("".join(r.choice(sets[k]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 40))), k) for i in range(60) for k in [r.choice(list(sets))]]
    rows += [(100, "² ½ ① Ⅷ 12 _!", "aa"), (101, None, "bb"), (102, "", None), (103, "e\u0301a nai\u0308ve", None), (104, "zzz", None), (105, "a1b2c", "aa")]
    learnt = {}
    for i, text, k in rows:
        if k and zlib.crc32(str(i).encode()) % 4 != 2:
            learnt.setdefault(k, Counter()).update(grams(text))
    ranks = {k: {g: n for n, g in enumerate(top(c))} for k, c in learnt.items()}
    want = {}
    for i, text, _ in rows:
        own = top(grams(text))
        away = {k: sum(abs(rank[g] - n) if g in rank else langid.TOP for n, g in enumerate(own)) for k, rank in ranks.items()}
        best = min(away, key=lambda k: (away[k], k))
        want[i] = (best, pytest.approx(1 - away[best] / (langid.TOP * len(own)))) if own else ("und", 0.0)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predicted_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == want and all(got[i][0] == "und" for i in (100, 101, 102))


# --- 6 --------------------------------------------------------------------------------------------------------


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30 if g == 0 else 5))):
            rows.append((base + rng.normal(size=16) * 0.04).astype(np.float32).tolist())
    rows += [rows[0], rows[0], [0.0] * 16, [float("nan")] * 16, None, [1.0]]
    data = [(i, v, None if i == 3 else i % 2 if i > 30 else 0, "x") for i, v in enumerate(rows)]
    unit = [nndescent.usable(v) if lab is not None else None for _, v, lab, _ in data]
    near = [[j for j in range(len(data)) if j != i and unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(len(data))]
    comp = list(range(len(data)))
    for _ in range(len(data)):
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(data))]
    got = nndescent.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, n string")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (len(near[i]), comp[i]) for i in range(len(data))}


def test_vectors_repeated_rows_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0, "a", "b", 7), (1, [1.0, 0.0], 0, "a", "b", 7), (2, [1.0, 0.01], 0, "c", "d", 8), (3, [0.0, 1.0], 0, "e", "f", 9), (None, [1.0, 0.0], 0, None, None, None)]
    # a pair at the threshold itself, in every order of summation
    edge = np.array([0.98, np.sqrt(1 - 0.98**2)])
    rows += [(10, [1.0, 0.0], 1, "a", "b", 1), (11, edge.tolist(), 1, "a", "b", 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nndescent.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, part string, unit int")).collect()}
    linked = float(np.einsum("ij,ij->i", nndescent.usable([1.0, 0.0])[None], nndescent.usable(edge.tolist())[None])[0]) >= 0.98
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), None: (0, None, True), 10: (int(linked), 10, True), 11: (int(linked), 10 if linked else 11, not linked)}


def test_dense_groups_that_touch(spark):
    rng = np.random.default_rng(4)
    one, other = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
    x = np.stack([c * one + np.sqrt(1 - c * c) * other + rng.normal(size=32) * 0.002 for c in [1.0] * 60 + [0.981] * 60])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = [i for i in range(200) if i % 20][:120]
    got = nndescent.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")).collect()
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(n), 1) for i, n in zip(ids, want)}


def test_links_where_the_audit_falls_short(spark, monkeypatch):
    empty = lambda graph, vectors: vectors.selectExpr("id AS u", "id AS v").where("u <> v")
    monkeypatch.setattr(nndescent, "_confirmed", empty)
    monkeypatch.setattr(nndescent, "NEAR_BITS", -1)
    monkeypatch.setattr(nndescent, "TRIES", 1)
    x = np.eye(12)[np.repeat(np.arange(12), 8)] + np.random.default_rng(5).normal(size=(96, 12)) * 0.01
    got = nndescent.near_duplicate_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (7, i // 8 * 8) for i in range(96)}


# --- 7 --------------------------------------------------------------------------------------------------------


@TOKENIZER
@pytest.mark.parametrize("unigram", [False, True])
def test_pieces_equal_the_library(unigram):
    import sentencepiece

    raw = open(pieces.MODEL_FILE, "rb").read()
    v = pieces.load()
    r = random.Random(3)
    texts = ["", " ", "  a  b", "x▁y"] + ["".join(r.choice(["the", "ing", " ", "  ", "a", "é", "ж", "привет", "日本", "#", "\n", "_", "12", "😀", "tion", "er"]) for _ in range(r.randrange(200))) for _ in range(80)]
    texts.append("".join(r.choice("thereadings") for _ in range(3000)))
    if not unigram:
        library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        coder = pieces.Coder(v)
        assert coder.encode(texts) == [library.encode(t) for t in texts]
    else:
        # a unigram's path against a plain search over all pieces, on short words
        coder = pieces.Coder(pieces.Vocabulary(v.pieces, v.scores, v.kinds, True, v.unknown))
        score = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == 0}
        for w in ["the", "reading", "there", "nationing"]:
            best = {0: 0.0}
            t = "▁" + w
            for e in range(1, len(t) + 1):
                best[e] = max([best[s] + score[t[s:e]] for s in range(e) if t[s:e] in score and s in best], default=float("-inf"))
            assert sum(v.scores[i] for i in coder.encode([w])[0]) == pytest.approx(best[len(t)])
    assert [coder.decode(i) for i in coder.encode(texts)] == [t.replace("▁", " ") for t in texts]


# --- 8 --------------------------------------------------------------------------------------------------------


def plain_spans(text):
    kinds = {"assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    return sorted((m.start(), list(kinds).index(k), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m))


def test_base_spans_by_brute_force():
    r = random.Random(11)
    parts = ["password", "Token", "ſecret", "api_key", "apiKEY", "=", ":", " ", '"', "'", "abcdef", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "\n", "é", "secret"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert secrets.base_spans(t) == plain_spans(t), t


def test_layers():
    key = 'secret = "abcdefgh12345"'
    for wrapped in (quote(key, safe=""), quote(quote(key, safe=""), safe=""), "".join(f"\\u{ord(c):04x}" for c in key), base64.b64encode(key.encode()).decode(), base64.b64encode(base64.b64encode(key.encode())).decode(), base64.b64encode(gzip.compress(key.encode())).decode(), quote(base64.b64encode(zlib.compress(key.encode())).decode(), safe="")):
        text = f"é start {wrapped} end"
        base, spans = secrets.scan(text)
        added = [s for s in spans if s not in base]
        assert any(k == 0 and 8 <= s < e <= 8 + len(wrapped) for s, k, e in added), wrapped
    assert secrets.scan("%25%32%35" * 50)[0] == []
    assert secrets.joined(secrets.scan("x token=abcdef")[1]) == "assign:2:14"


def test_planted_layers():
    """Secrets under random nests of encodings: each is found, and its span covers what was encoded and no more."""
    r = random.Random(8)
    raw_deflate = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(9, zlib.DEFLATED, -15))
    pack = [gzip.compress, zlib.compress, raw_deflate, lambda b: gzip.compress(b"first ") + gzip.compress(b), lambda b: gzip.compress(zlib.compress(b))]
    coded = lambda b: base64.b64encode(b).decode()
    ways = [lambda s: quote(s, safe=""), lambda s: "".join(f"%{x:02X}" for x in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"\\x{ord(c):02x}" for c in s), lambda s: coded(s.encode()), lambda s: base64.urlsafe_b64encode(s.encode()).decode()]
    ways += [lambda s, f=f: coded(f(s.encode())) for f in pack]
    for n in range(400):
        value = "".join(r.choice("ghijklmnopqrstuvw") for _ in range(r.randrange(6, 30)))
        secret = r.choice([f"token={value}", f"password: '{value}'", "AKIA" + "".join(r.choice("ABCDEFGHJK2345") for _ in range(16))])
        kind = 1 if secret.startswith("AKIA") else 0
        depth = r.randrange(1, 4)
        for _ in range(depth):
            secret = r.choice(ways)(secret)
        before = "é word " * r.randrange(3)
        text = f"{before}{secret} after"
        added = [x for x in secrets.scan(text)[1] if x[1] == kind]
        assert added, (n, text)
        assert all(len(before) <= s < e <= len(before) + len(secret) for s, _, e in added), (n, text)
    for lead in ("data/", "a/", "ab/", "abc/"):
        text = f"x {lead}{coded(b'and a secret=abcdefghijk in it')} y"
        assert any(k == 0 for _, k, _ in secrets.scan(text)[1]), lead
    mixed = coded(bytes(range(128, 256)) + b" token=abcdefgh " + bytes(range(256)))
    assert any(k == 0 for _, k, _ in secrets.scan(mixed)[1])
    plain = " ".join(words(1, 4000)) + " " + coded(" ".join(words(2, 400)).encode()) + " 100% \\q C:\\path"
    assert secrets.scan(plain) == ([], [])


def test_long_runs_take_linear_time():
    import time

    start = time.perf_counter()
    for tail in ("%zz", "\\q", "%41", "\\x41", "", "%"):
        for unit in ("a", "%zz", "\\q", "%4", "AKIA", "g="):
            secrets.scan(unit * (300_000 // len(unit)) + tail)
    secrets.scan(" ".join(base64.b64encode(f"token=abcdef{i}".encode()).decode() for i in range(4000)))
    assert time.perf_counter() - start < 60


def test_layers_after_a_large_blob():
    key = 'secret = "abcdefgh12345"'
    coded = base64.b64encode(key.encode()).decode()
    blob = base64.b64encode(gzip.compress(b"word " * (14 << 20) + key.encode())).decode()
    text = f"{blob} {blob[:40]} {coded}"
    spans = secrets.scan(text)[1]
    assert (0, 0, len(blob)) in spans and any(k == 0 and s >= len(text) - len(coded) for s, k, _ in spans)


def test_layers_over_lines_and_members(monkeypatch):
    r = random.Random(3)
    key = "secret=" + "".join(r.choice("ghijklmnop") for _ in range(70))
    for end in ("\n", "\r\n"):
        wrapped = base64.encodebytes(f"{'plain words, '*4}{key} and more {'words ' * 20}".encode()).decode().replace("\n", end)
        for text in (f"x\n\n{wrapped}", f"Certificate_of_the_service{end}{wrapped}after{end}"):
            assert any(k == 0 and e - s > 70 * 4 // 3 for s, k, e in secrets.scan(text)[1]), text
    packed = base64.encodebytes(gzip.compress(bytes(r.randrange(97, 123) for _ in range(200)) + b" " + key.encode())).decode()
    assert any(k == 0 for _, k, _ in secrets.scan(packed)[1])
    members = base64.b64encode(gzip.compress(b"first part") + zlib.compress(b" and " + key.encode())).decode()
    assert secrets.scan(members)[1] == [(0, 0, len(members))]
    monkeypatch.setattr(secrets, "PIECE", 7)
    assert secrets.scan(members)[1] == [(0, 0, len(members))]


def test_digest_of_base_spans(spark):
    text = "x token=abcdef " + "0" * 24
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["base_sha256"] == hashlib.sha256(b"assign:2:14,hex:15:39").hexdigest() and (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 0, 1)


# --- 10 -------------------------------------------------------------------------------------------------------


def test_webp_round_trips():
    rng = np.random.default_rng(0)
    for k in range(24):
        h, w = rng.integers(1, 30, 2)
        n = [1, 2, 4, 17, 200, 256][k % 6]
        im = rng.integers(0, 256, (n, 4))[rng.integers(0, n, (h, w))].astype(np.uint8)
        for force in (None, ("palette",), ("green",), ("cross",), ("predictor",), ("predictor", "cross", "green")):
            b = int(rng.integers(2, 6))
            modes = rng.integers(0, 14, (-(-h >> b), -(-w >> b)))
            assert (webp.decode(webp.encode(im, force, modes, b)) == im).all()


def test_many_images_at_once():
    """The batch writer and reader against the single reader, over images that take each of the transforms."""
    rng = np.random.default_rng(5)
    smooth = np.cumsum(rng.integers(-2, 3, (40, 64, 3)), axis=1).astype(np.uint8)
    green = rng.integers(0, 256, (30, 64, 1))
    linked = np.concatenate([green + rng.integers(0, 3, green.shape), green, green], axis=2).astype(np.uint8)
    signed = green.astype(np.int8).astype(np.int64)
    half = np.concatenate([signed * 24 >> 5, green, signed * 16 >> 5], axis=2).astype(np.uint8)
    prose = np.frombuffer((" ".join(words(3, 2000)).encode() + bytes(192))[: 64 * 3 * 30], np.uint8).reshape(-1, 64, 3)
    images = [smooth, linked, half, prose, np.repeat(rng.integers(0, 256, (1, 64, 3)), 50, axis=0).astype(np.uint8), np.zeros((1, 64, 3), np.uint8), rng.integers(0, 256, (3, 64, 3)).astype(np.uint8), np.concatenate([prose, prose])]
    images += [rng.integers(97, 97 + k, (int(rng.integers(1, 60)), 64, 3)).astype(np.uint8) for k in (1, 2, 3, 20, 90, 158)]
    files = webp.encode_many(images)
    steps = [tuple(x[0] for x in webp._opened(f)[3]) for f in files]
    assert {(webp.PREDICTOR,), (webp.GREEN,), (webp.CROSS,), (webp.PALETTE,), ()} <= set(steps)
    for im, one, many in zip(images, map(webp.decode, files), webp.decode_many(files)):
        assert (one[..., :3] == im).all() and (one[..., 3] == 255).all() and (many == one).all()
    # files of the other writer, with grouped transforms, alpha and a cache, by the batch reader
    others = [rng.integers(0, 256, (n, 4))[rng.integers(0, n, (9, 17))].astype(np.uint8) for n in (1, 3, 200)]
    for im, got in zip(others, webp.decode_many([webp.encode(im, ("predictor", "cross", "green"), rng.integers(0, 14, (3, 5)), 2) for im in others])):
        assert (got == im).all()
    for cut in (5, 30, len(files[3]) // 2):
        with pytest.raises((ValueError, IndexError)):
            webp.decode_many([files[3][:-cut]])


def test_a_file_of_another_writer():
    # a picture of one pixel that browsers are tried with
    one = webp.decode(base64.b64decode("UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA="))
    assert one.shape == (1, 1, 4)


def test_text_media_by_brute_force(spark):
    texts = ["", "a", "x" * 192, "y" * 193, "abc " * 2000, " ".join(words(1, 3000)), "é😀 " * 300, None, "a", "".join(chr(k) for k in range(1, 500)), " ".join(words(2, 60_000, 10**6))]
    rows = {r["doc_id"]: r for r in webp.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        lines = [payload[i : i + 192] for i in range(0, len(payload), 192)]
        assert r["feature"] == f"rows={len(lines)};mean={sum(payload) * 1000 // len(payload)};kinds={len(set(payload))};same={sum(a == b for x in lines for a, b in zip(x, x[1:]))}"
        ((n, media),) = webp.stored_texts([t])
        assert webp.decode(media)[..., :3].tobytes() == payload and n == len(raw)
    assert rows[1]["media_sha256"] == rows[8]["media_sha256"] and rows[0]["media_sha256"] == rows[7]["media_sha256"]


def test_pixel_arrays(spark):
    files = spark.createDataFrame([(1, bytearray(webp.stored_texts(["abc"])[0][1])), (2, bytearray(b"junk")), (3, None)], "id int, content binary")
    got = {r["id"]: r for r in webp.pixel_arrays(files).collect()}
    assert got[1]["width"] == 64 and bytes(got[1]["pixels"])[:4] == b"abc\xff" and got[2]["error"] and got[3]["pixels"] is None


# --- conversation prefix trie ---------------------------------------------------------------------------------


def trie_by_hand(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    members = {}
    ends = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    leaf = {n: not any(m[:-1] == n for m in members if m) for n in members}
    out = []
    for n, found in members.items():
        under = [m for m in members if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in under if m)
        ids = ",".join(map(str, sorted(ends.get(n, []))))
        out.append((min(found), len(n), min(members[n[:-1]]) if n else None, len(found), sum(m[:-1] == n for m in members if m), sum(leaf[m] for m in under), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [2, 3, 32])
def test_trie_against_brute_force(spark, height):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é", "", None, "long text"])) for c in range(40) for t in range(r.randrange(9))]
    rows += [(70, t, "user", f"turn {t % 3}") for t in range(25)] + [(71, t, "user", f"turn {t % 3}") for t in range(40)] + [(73, None, "x", "first"), (73, 1, "x", "tie"), (73, 1, "x", "tie"), (73, 1, "w", None), (None, 1, "user", "nobody's")]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 130) for t in range(9)]
    frame = spark.createDataFrame([(*x, "z", 1) for x in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    got = sorted((tuple(x) for x in trie.prefix_trie(frame, height).collect()), key=repr)
    assert got == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(empty).collect() == []
    alone = spark.createDataFrame([(1, 1, "user", "dropped")], "conv_id long, turn long, role string, text string")
    assert [tuple(x)[:7] for x in trie.prefix_trie(alone).collect()] == [x[:7] for x in trie_by_hand([(1, 1, "user", "dropped")])]


def test_running_over_a_key_of_many_ranges(spark):
    frame = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 3).otherwise(F.col("id") % 4).alias("k"), (F.col("id") * 7919 % 5003).alias("o"), F.xxhash64("id").alias("x"))
    rows = trie.running(frame, "k", ["o"], "n", ("x",)).collect()
    raw = sorted((r["k"], r["o"], r["x"]) for r in frame.collect())
    want, at = {}, {}
    for k, o, x in raw:
        n, y = at.get(k, (0, 0))
        at[k] = want[k, o] = (n + 1, y ^ x)
    assert len(rows) == 5000 and all(want[r["k"], r["o"]] == (r["n"], r["x"]) for r in rows)


# --- target-distribution importance resampling ----------------------------------------------------------------


def sample_by_hand(docs, goal, n=1, buckets=10_000, percent=10, least=20):
    import math

    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    def counts(texts):
        c = [0] * buckets
        for t in texts:
            for g in grams(t)[1]:
                c[zlib.crc32(g.encode()) % buckets] += 1
        return c

    s, t = counts(x for _, x in docs), counts(goal)
    total_s, total_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (total_s + buckets) / ((a + 1) * (total_t + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        w, f = grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("n,buckets", [(1, 10_000), (3, 50)])
def test_importance_against_brute_force(spark, n, buckets):
    docs = [(i, " ".join(words(i, 10 + i % 60, 30 + i))) for i in range(150)] + [(200, None), (201, ""), (202, "É日本 A-b_c 12x\n\tÉ É"), (None, " ".join(words(9, 40))), (203, "x" * 40 + " " + "x" * 39 + "y " + "W1 " * 30)]
    goal = [" ".join(words(500 + i, 50, 40)) for i in range(10)] + [None]
    frame = spark.createDataFrame([(i, t, "c", 1, "r") for i, t in docs], "doc_id long, text string, score string, number int, rank string")
    target = spark.createDataFrame([(t,) for t in goal], "text string")
    got = importance.importance_sample(frame, target, n=n, buckets=buckets)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sample_by_hand(docs, goal, n, buckets)
    drawn = importance.resampled(frame, target, n=n, buckets=buckets)
    assert drawn.columns == [*frame.columns, "sample_rank"] and drawn.count() == got.where("rank is not null").count()


def test_importance_of_repeated_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "w " * 30)] * 20, "doc_id long, text string")
    rows = importance.importance_sample(frame, frame.limit(0)).collect()
    assert len(rows) == 20 and sorted(r["rank"] or 0 for r in rows)[-3:] == [0, 1, 2]
    assert importance.importance_sample(frame.limit(0), frame).collect() == []


def test_interning_keeps_strings_of_equal_keys_apart():
    texts = [b"abc", b"abd", b"abc", b"0123456789abcdef", b"0123456789abcdeg", b"abd", b"ab"]
    data = np.frombuffer(b" ".join(texts) + b" " * 8, np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    table = importance.Table(len(texts))
    slot = table.intern(data, start, size, np.zeros(len(texts), np.uint64))
    assert [slot[i] == slot[j] for i in range(7) for j in range(7)] == [texts[i] == texts[j] for i in range(7) for j in range(7)]
    assert sorted(table.count[table.count > 0]) == [1, 1, 1, 2, 2]


# --- repeated passages by super-k-mers ------------------------------------------------------------------------


def cut_by_hand(docs, span=20):
    every = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    place = lambda i: (i is not None, i or 0)
    for i, w in split:
        for p in range(len(w) - span + 1):
            k = tuple(w[p : p + span])
            every[k] = min(every.get(k, (place(i), p)), (place(i), p))
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - span + 1):
            if every[tuple(w[p : p + span])] < (place(i), p):
                gone.update(range(p, p + span))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def repeated_docs():
    passage, line = words(1, 60, 5000), words(2, 22, 5000)
    docs = [(i, " ".join([*words(10 + i, i % 40, 5000), *passage, *words(90 + i, 25, 5000), *(line if i % 3 else []), *words(300 + i, i % 7, 5000)])) for i in range(60)]
    docs += [(100, "a " * 500), (101, "a " * 30 + "b " + "a " * 19), (102, " \n" + " x　y \x1f " * 30), (103, None), (104, ""), (105, "one two"), (None, " ".join(passage)), (None, " ".join([*words(77, 5), *passage]))]
    docs += [(106, " ".join(words(5, 3000, 3))), (107, "\t".join(words(5, 3000, 3))), (107, "\t".join(words(5, 3000, 3))), (107, " ".join(words(6, 50, 2)))]
    return docs


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_repeats_against_brute_force(chunk, monkeypatch):
    from drawlake.llm import substrings

    monkeypatch.setattr(substrings, "CHUNK", chunk)
    docs = [(-(1 << 63) if i is None else i, t) for i, t in repeated_docs()]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([zlib.crc32((t or "").encode()) for _, t in docs]), pa.array([None if t is None else t.encode() for _, t in docs], pa.binary())], names=["doc", "tag", "text"])
    frequent = np.sort(substrings._together([docs[5][1].encode()])[0].hashes(4)[10:60])
    for hot in (frequent[:0], frequent):
        rows = [x for part in substrings._documents([batch]) for x in zip(*substrings.super_kmers(*part, hot, 20, 4))]
        where = np.array([r[2] for r in rows], substrings._STRING)
        found = substrings._runs(substrings.repeats([r[1] for r in rows], where, 20))
        first, later = substrings._earliest([r[1] for r in rows], where)
        some = substrings.repeats([rows[k][1] for k in first.tolist()], where[first], 20)
        assert (substrings._runs(np.concatenate([some, where[later]])) == found).all()
        got = []
        for (i, t), tag in zip(docs, batch.column("tag").to_pylist()):
            mine = found[(found["doc"] == i) & (found["tag"] == tag)]
            stay, n = substrings._kept((t or "").encode(), mine["at"].tolist(), mine["size"].tolist(), 20)
            got.append((i, n, n - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
        assert sorted(got, key=repr) == cut_by_hand(docs)


def test_repeats_through_spark(spark):
    docs = repeated_docs()
    frame = spark.createDataFrame([(i, t, "z", 1, "m") for i, t in docs], "doc_id long, text string, doc string, at int, marks string")
    got = substrings.drop_repeats(frame)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == cut_by_hand(docs)
    assert substrings.drop_repeats(frame.limit(0)).collect() == []


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    strings = [b" ".join(w) for w in ([b"a"] * 25, [b"a"] * 20, [b"b"] * 20, [b"b"] * 21)]
    where = np.array([(1, 0, 0, 6), (2, 0, 0, 1), (3, 0, 0, 1), (4, 0, 7, 2)], substrings._STRING)
    want = {(1, k) for k in range(1, 6)} | {(2, 0), (4, 7), (4, 8)}
    for name, hashes in (("as it is", substrings.Words.hashes), ("all equal", lambda self, n: np.zeros(max(0, len(self.start) - n + 1), np.uint64))):
        monkeypatch.setattr(substrings.Words, "hashes", hashes)
        found = substrings.repeats(strings, where, 20)
        assert {(r["doc"], r["at"]) for r in found} == want, name


def test_frequent_runs_are_few(spark):
    docs = [(i, " ".join([*words(10 + i, 40, 5000), *words(1, 30, 5000)])) for i in range(200)]
    rows = substrings._rows(spark.createDataFrame(docs, "doc_id long, text string"))
    hot = substrings.frequent_runs(rows, 10)
    assert 0 < len(hot) <= 80 and set(hot.tolist()) <= set(substrings._together([" ".join(words(1, 30, 5000)).encode()])[0].hashes(4).tolist())


# --- layers of secrets, by following a secret outwards through its encodings -----------------------------------


def outwards(r, text, span):
    """One more encoding of ``text``, and where ``span`` of it lies then; None where a decoder can't tell single characters."""
    kind, (s, e) = r.choice(["percent", "escape", "hex escape", "base64", "gzip", "zlib", "bz2", "xz"]), span
    at = [len(text[:k].encode()) for k in (s, e)]
    if kind == "percent":
        return "".join(f"%{b:02X}" for b in text.encode()), (3 * at[0], 3 * at[1])
    if kind == "escape" and all(ord(c) < 0xD800 for c in text):
        return "".join(f"\\u{ord(c):04x}" for c in text), (6 * s, 6 * e)
    if kind == "hex escape" and text.isascii():
        return "".join(f"\\x{ord(c):02x}" for c in text), (4 * s, 4 * e)
    if kind in ("percent", "escape", "hex escape", "base64"):
        out = base64.b64encode(text.encode()).decode()
        return out, (at[0] * 4 // 3, min(len(out.rstrip("=")), -(-at[1] * 4 // 3)))
    import bz2
    import lzma

    out = base64.b64encode({"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}[kind](text.encode())).decode()
    return out, (0, len(out))


def test_layers_against_encodings_followed_outwards():
    r = random.Random(11)
    for n in range(300):
        lead = r.choice(["words before it, ", "ключ: ", "\U0001f600 x ", "a" * r.randrange(30) + " "])
        text, span = lead + "password=hunter2xyz" + r.choice([" and after", "; конец", ""]), (len(lead), len(lead) + 19)
        for _ in range(r.randrange(1, 5)):
            text, span = outwards(r, text, span)
        before = r.choice(["", "plain prose. ", "п "])
        whole = before + text + r.choice(["", " and so on"])
        want = (span[0] + len(before), 0, span[1] + len(before))
        found = [x for x in secrets.scan(whole)[1] if x[1] == 0]
        # the same secret may also be told by a wider span, of a stream's whole fragment
        assert any(s <= want[0] and want[2] <= e for s, _, e in found), (n, whole[:80], found, want)
        assert want in found or any(want[2] - want[0] < e - s for s, _, e in found), (n, found, want)


def test_streams_of_many_levels_bad_bytes_and_long_words():
    raw = b"some words token=abcdef12 and more"
    for _ in range(2000):
        raw = zlib.compress(raw)
    text = base64.b64encode(raw).decode()
    assert secrets.scan(text)[1] == [(0, 0, len(text.rstrip("=")) if not text.endswith("=") else len(text))]
    prose = b"words of prose and so on " * 18_000
    text = base64.b64encode(gzip.compress(prose + b"\xff" + prose + b" password=hunter22 ")).decode()
    assert any(k == 0 for _, k, _ in secrets.scan(text)[1])
    text = base64.b64encode(gzip.compress(b"\xff\xfe password=hunter22")).decode()
    assert any(k == 0 for _, k, _ in secrets.scan(text)[1])
    binary = bytes(random.Random(3).randrange(256) for _ in range(30_000))
    text = base64.b64encode(gzip.compress(binary + b"\0token=abcdef99\0" + binary)).decode()
    assert any(k == 0 for _, k, _ in secrets.scan(text)[1])


def test_a_long_word_around_an_escape_takes_little_memory():
    import tracemalloc

    text = "z" * 8_000_000 + "%41 token%3Dabcdefgh"
    tracemalloc.start()
    spans = secrets.scan(text)[1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == [(8_000_004, 0, 8_000_020)] and most < 12 * len(text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_planted_copies_and_chains_among_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding", "label").collect()
    rng = np.random.default_rng(6)
    data = [(r["vec_id"], list(map(float, r["embedding"])), r["label"]) for r in rows]
    unit = lambda v: v / np.linalg.norm(v)
    for k, (_, v, label) in enumerate(data[:60]):
        v = unit(np.array(v))
        if k % 3 == 0:  # copies, exact and near
            data += [(10_000 + 10 * k, v.tolist(), label), (10_001 + 10 * k, v.tolist(), label), (10_002 + 10 * k, (v + rng.normal(size=len(v)) * 0.01).tolist(), label)]
        elif k % 3 == 1:  # a chain, whose ends don't link
            side = unit(rng.normal(size=len(v)))
            data += [(10_000 + 10 * k + j, unit(v + 0.15 * (j + 1) * side).tolist(), label) for j in range(6)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label long")).collect()}
    ids, label = np.array([d[0] for d in data]), np.array([-1 if d[2] is None else d[2] for d in data])
    x = np.stack([unit(np.array(d[1])) for d in data])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & (label >= 0)[:, None]
    np.fill_diagonal(near, False)
    comp = ids.copy()
    for _ in range(20):
        comp = np.minimum(comp, np.where(near, comp[None, :], np.iinfo(np.int64).max).min(axis=1))
    assert near.sum() > 200 and got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), comp)}


def test_pixel_arrays_keep_clashing_names(spark):
    image = webp.encode(np.zeros((2, 3, 4), np.uint8))
    frame = spark.createDataFrame([(bytearray(image), "raw", "held", 7)], "content binary, __raw string, held_content string, Width int")
    row = webp.pixel_arrays(frame).first()
    assert (row["__raw"], row["held_content"], row["width"], row["height"], len(row["pixels"])) == ("raw", "held", 3, 2, 24)


@TOKENIZER
def test_models_that_differ_in_a_middle_piece_share_no_coder():
    v = pieces.load()
    other = pieces.Vocabulary([*v.pieces[:5000], "zzqq", *v.pieces[5001:]], v.scores, v.kinds, v.unigram, v.unknown)
    assert pieces._coder(v) is pieces._coder(v) and pieces._coder(other) is not pieces._coder(v)
    assert pieces._coder(pieces.Vocabulary(v.pieces, [s - 1 for s in v.scores], v.kinds, v.unigram, v.unknown)) is not pieces._coder(v)

"""Operators 4, 6 and 8 and the pipeline: exact examples, held-out accuracy, planted cases."""

import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quorumstat.llm import htmltext, langid, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_visible_text():
    html = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><h1>Head &amp; line</h1>
    <p>One <b>bold</b>
       text<p>Two<br>lines <span hidden>never</span><div style="display: none">x</div>
    <ul><li>a<li>b <ol start=3><li>c<li>d</ol></ul><script>var a = "</p>";</script>
    <table><tr><th>k<th>value<tr><td>long key<td>1</table><pre> keep
   this </pre>tail</body></html>"""
    assert htmltext.visible_text(html).split("\n") == [
        "Head & line", "", "One bold text", "", "Two", "lines", "", "* a", "* b", "  3. c", "  4. d", "", "k         value", "long key  1", "", " keep", "   this", "", "tail",
    ]
    for odd in ("", "<", "</p></div>", "<td>a<td>b", "<ul><li><ul><li>" * 300 + "deep", "a<!-- b", "&#0; &bogus; &lt;"):
        htmltext.visible_text(odd)
    assert htmltext.visible_text("<td>a<td>b") == "ab"


def test_head_without_end_tag():
    assert htmltext.visible_text("<html><head><title>t</title><meta charset=x><p>Hello <b>all</b></html>") == "Hello all"
    assert htmltext.visible_text("<head><style>p{}</style>\n <script>x</script> Hello<p>all") == "Hello\n\nall"


def test_table_sections_and_shown_elements():
    show = htmltext.visible_text
    assert show("<table><tbody><td>x<td>y</tbody></table>") == "x  y" and show("<table><td>x</td></table>") == "x"
    assert show("<table><tbody>loose<b>one</b><tr><td>x</table>") == "looseone\nx"
    assert show("<table><colgroup><col><tbody><tr><td>a<td>b</table>") == "a  b"
    assert show("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b") == "a x=2 b"
    assert show("<svg><title>no</title><g>no<path/><text>one</text><text>two</text></g></svg> b") == "one two b"
    assert show("<p><textarea>typed</textarea><dialog>no</dialog><dialog open>yes</dialog>") == "typedyes"
    assert show("<select><option>a<option selected>b<option>c</select>") == "b" and show("<select><option>a<option>b</select>") == "a"
    assert show("<select multiple><option>a<option>b</select> c") == "a b c"


def test_html_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = queries.op6_html(spark, SF)
    assert out.count() == pages.count()
    row = out.where("page_id = 0").first()
    assert "track(" not in row["text"] and "Nicht aulich für sch" in row["text"] and "* and" in row["text"]
    none = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    assert [r["text"] for r in htmltext.extract(none).collect()] == ["", ""]


def brute_counts(texts, n_languages):
    t = np.full((langid.BINS, n_languages), 0.1)
    for lang, text in texts:
        np.add.at(t[:, lang], langid.trigram_bins(text.encode()), 1)
    return np.log(t / t.sum(0))


def test_language_model_and_fusion(spark, docs):
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(all_docs.select("text", "lang"))
    names = {x: i for i, x in enumerate(model.languages)}
    assert np.allclose(model.logp, brute_counts([(names[r.lang], r.text) for r in all_docs.collect()], len(names)), atol=1e-4)
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200")
    found = langid.fuse(langid.text_evidence(langid.document_rows(held.withColumn("lang", F.lit(None).cast("string"))), model), model)
    both = found.join(held.select(F.col("doc_id").alias("key"), F.col("lang").alias("truth")), "key")
    assert both.where("lang = truth").count() / both.count() > 0.97
    # a text without evidence follows its declared language and its host; strong text overrules both
    rows = [(1, "", "fr", "h1"), (2, None, None, "h2"), (3, None, None, None), (4, "1234 !!", "xx", "h2")]
    rows += [(10 + i, " ".join(["und der die nicht auf ein sich mit"] * 4), None, "h2") for i in range(40)] + [(60, " ".join(["the and of that with from this"] * 30), "fr", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["key"]: r for r in langid.fuse(langid.text_evidence(langid.document_rows(df), model), model).collect()}
    assert got[1]["lang"] == "fr" and got[2]["lang"] == "de" and got[4]["lang"] == "de" and got[60]["lang"] == "en"
    assert got[3]["lang"] in names and got[3]["confidence"] < 1
    kept = {r["doc_id"] for r in langid.accept(docs.unionByName(df, allowMissingColumns=True), model).collect()}
    assert not kept & {2, 3, 4, 5, 6} and set(range(17, 50)) <= kept and 60 not in kept
    assert langid.accept(all_docs).count() >= 0.99 * all_docs.count()
    assert langid.train(docs.limit(0)).languages == [] and langid.accept(docs.limit(0)).count() == 0


def test_rare_languages_are_modelled_and_kept(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in range(46):
        letters = rng.permutation(list("abcdefghijklmnopqrstuvwxyz"))[:9]
        vocabulary = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(60)]
        rows += [(len(rows) + i, " ".join(rng.choice(vocabulary, 120)), f"l{n:02d}") for i in range(600 if not n else 2)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(4)
    model = langid.train(df, 20)
    assert len(model.languages) == 46 and len(np.unique(model.logp, axis=1).T) == 46
    assert langid.accept(df, model).count() == len(rows)
    few = langid.train(df.where("lang < 'l03'"), 20)
    odd = spark.createDataFrame([(9000, "123", "l40", "s"), (9001, None, "l41", "s"), (9002, rows[-1][1], "l00", "s")], df.schema)
    assert {r["doc_id"] for r in langid.accept(df.unionByName(odd), few).collect()} == {r[0] for r in rows}


def brute_fusion(rows, model):
    """rows: (key, text, declared, host, domain, suffix) -> key: (lang, confidence), with loops over rows and levels."""
    langs, k = model.languages, len(model.languages)
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    own, soft = [], []
    for _, text, declared, *_ in rows:
        b = b" " + (text or "").lower().encode() + b" "
        letters = [c if chr(c).isalpha() or c >= 128 else 32 for c in b]
        squeezed = [c for i, c in enumerate(letters) if c != 32 or i == 0 or letters[i - 1] != 32]
        bins = [((squeezed[i] * 65536 + squeezed[i + 1] * 256 + squeezed[i + 2]) * 0x9E3779B1 >> 13) % langid.BINS for i in range(len(squeezed) - 2)] if any(c != 32 for c in letters) else []
        score = np.zeros(k)
        for x in bins:
            score += model.logp[x].astype(float) * langid.TEMPER
        if declared in langs:
            score += np.log([1 - langid.DECLARED_ERROR if x == declared else langid.DECLARED_ERROR / max(1, k - 1) for x in langs])
        own.append(score), soft.append(softmax(score))
    prior = np.full(k, 1 / k)
    smooth = lambda counts, p: (counts + langid.STRENGTH * p) / (counts.sum() + langid.STRENGTH)
    out = {}
    for i, r in enumerate(rows):
        p = prior
        for level in ((), (5,), (5, 4)):
            p = smooth(sum(s for s, q in zip(soft, rows, strict=True) if all(q[c] == r[c] for c in level)), p)
        host = sum(s for s, q in zip(soft, rows, strict=True) if all(q[c] == r[c] for c in (5, 4, 3)))
        post = softmax(own[i] + np.log(smooth(np.maximum(host - soft[i], 0), p)))
        out[r[0]] = (langs[int(post.argmax())], post.max())
    return out


def test_fusion_equals_loops_over_rows(spark):
    rng = np.random.default_rng(3)
    vocabulary = {"aa": "ana bana kala tara mala", "bb": "ost west knorz schlupf brumm", "cc": "ille bonus tempus quod"}
    docs = spark.createDataFrame([(" ".join(rng.choice(words.split(), 12)), lang) for lang, words in vocabulary.items() for _ in range(8)], "text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    rows = []
    for i in range(60):
        lang = list(vocabulary)[i % 3 if i % 4 else 0]
        n = int(rng.integers(0, 6))
        text = None if i == 7 else "" if i == 8 else "123 456" if i == 9 else " ".join(rng.choice(vocabulary[lang].split(), n)) if i != 10 else vocabulary["bb"] * 3000
        host = None if i % 11 == 0 else f"h{i % 5}.d{i % 2}.x{i % 3}"
        rows.append((i, text, [None, lang, "zz", "cc"][i % 4], host, host and host.split(".", 1)[1], host and host[-2:]))
    df = spark.createDataFrame(rows, "key long, text string, declared string, host string, domain string, suffix string")
    got = {r["key"]: (r["lang"], r["confidence"]) for r in langid.fuse(langid.text_evidence(df, model), model).collect()}
    want = brute_fusion(rows, model)
    assert set(got) == set(want)
    for key, (lang, sure) in want.items():
        assert got[key][0] == lang and abs(got[key][1] - sure) < 1e-4, key


def test_page_language_edges(spark):
    docs = spark.createDataFrame([("one two three", "en"), ("ein zwei drei", "de")], "text string, lang string")
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "", "", "y"), (3, "no address", "<html lang=de>drei", "z"), (None, "http://a.de/", "<p>ein zwei", "t"), (4, "http://a.de", "<html lang=en>" + "zwei drei " * 100_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = langid.identify_pages(pages, langid.train(docs)).collect()
    assert len(got) == len(rows) and all(r["lang"] in ("en", "de") for r in got)
    assert [r["lang"] for r in got if r["key"] == 4] == ["de"]
    assert langid.identify_pages(pages.limit(0), langid.train(docs)).count() == 0


def test_page_language(spark):
    out = queries.op4_language(spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert out.count() == pages.count() and out.where("lang is null").count() == 0
    assert out.where("lang = declared").count() > 0.8 * pages.count()


def test_deep_pages_keep_their_visibility():
    deep = "<div>" * 210
    assert htmltext.visible_text(deep + '<span hidden>SECRET</span><p style="display:none">ALSO</p>tail') == "tail"
    assert htmltext.visible_text(deep + "one<p>two</p><ul><li>three</ul><span style='visibility:hidden'>no<b style='visibility:visible'>yes</b></span>").split() == ["one", "two", "three", "yes"]
    assert htmltext.visible_text("<g>" * 50_000 + "x" + "<svg>" + "<g>" * 50_000 + "no<text>yes") == "x yes"
    assert htmltext.visible_text("<table><tr><td>" * 150 + "in") == "in"


def test_spans_and_widths():
    page = "<table><tr><td rowspan=2>a</td><td colspan=2>wide cell</td></tr><tr><td>b</td><td>c</td></tr><tr><td>日本</td><td>d</td><td>e</td></tr></table>"
    assert htmltext.visible_text(page) == "a     wide cell\n      b  c\n日本  d  e"
    assert htmltext.visible_text("<ol><li value=7>a<li>b</ol>") == "7. a\n8. b"
    assert htmltext.visible_text("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b></p>") == "yes"


def test_pages_edges(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", "y"), (None, "<p>a</p>", "z"), (3, "<p>long</p>" + "word " * 200_000, "t"), (3, "<p>a", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r["page_id"], len(r["text"])) for r in htmltext.extract(df).collect()), key=repr)
    assert got == sorted([(1, 0), (1, 0), (2, 0), (None, 1), (3, 6 + 999_999), (3, 1)], key=repr)
    assert htmltext.extract(df.limit(0)).count() == 0


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    e, trans = rng.normal(size=(2, 5)), rng.normal(size=(2, 2))
    there = np.array([[True] * 5, [True] * 3 + [False] * 2])
    p, pair, logz = toxicity.forward_backward(e, trans, there)
    pairs = np.zeros((2, 2))
    for row, n in ((0, 5), (1, 3)):
        weights, ones = [], np.zeros(n)
        for y in np.ndindex(*[2] * n):
            w = np.exp(sum(e[row, i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            weights.append((y, w))
        z = sum(w for _, w in weights)
        for y, w in weights:
            ones += np.array(y) * w / z
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w / z
        assert np.allclose(p[row, :n], ones) and np.isclose(logz[row], np.log(z)) and not p[row, n:].any()
    assert np.allclose(pair.sum(0), pairs)


def toxic_model():
    model = toxicity.Crf(features={"=scum": 6.0, "trash": 4.0}, scale=(1.0, 0.5))
    rng = np.random.default_rng(1)
    model.theta, model.trans = rng.normal(size=len(model.theta)), rng.normal(size=(2, 2))
    return model


def test_toxicity_score_equals_sentence_by_sentence(spark):
    model = toxic_model()
    texts = ["You scum of trashy trash. Nice day!\nscum", "", None, "\u0130stanbul scum", "good day " * 3000 + "scum", "İİİ scum. \u0130 trashcan", "scum"] * 2
    df = spark.createDataFrame([(i if i < 13 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {(r["doc_id"], r["score"], tuple(map(tuple, r["spans"]))) for r in toxicity.score(df, model).collect()}
    want = set()
    for i, t in enumerate(texts):
        total, spans = 0.0, []
        parts, at = [], 0
        for m in re.finditer(r"[^\W\d_]+|[.!?\n]+", t or ""):
            if m[0][0] in ".!?\n":
                at += 1
            else:
                parts.append((at, m.span(), model.code(m[0])))
        for sentence in sorted({p[0] for p in parts}):
            mine = [p for p in parts if p[0] == sentence]
            p = model.marginals(np.array([[c for _, _, c in mine]]))[0]
            total += (p**2).sum()
            spans += [s for (_, s, _), x in zip(mine, p, strict=True) if x >= 0.5] if any(c for _, _, c in mine) else []
        z = model.scale[0] * np.log(total + 0.01) + model.scale[1]
        want.add((i if i < 13 else None, round(1 / (1 + np.exp(-z)), 9), tuple(spans)))
    assert {(i, round(s, 9), x) for i, s, x in got} == want


def test_chain_is_fitted_to_all_pieces_alike():
    """Batches and counts change nothing; the likelihood rises."""
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 25, n) for n in (3, 9, 9, 40, 1)]
    tags = [(s > 12).astype(int) for s in seqs]
    fits = []
    for batch, times in ((200_000, [1, 2, 1, 1, 3]), (10, [1, 2, 1, 1, 3])):
        old, toxicity.BATCH = toxicity.BATCH, batch
        m = toxicity.Crf()
        toxicity.fit_chain(m, seqs, tags, times, rounds=30)
        toxicity.BATCH = old
        fits.append(m)
    again = toxicity.Crf()
    copies = [(s, t) for s, t, k in zip(seqs, tags, [1, 2, 1, 1, 3], strict=True) for _ in range(k)]
    toxicity.fit_chain(again, [c[0] for c in copies], [c[1] for c in copies], [1] * len(copies), rounds=30)
    assert np.allclose(fits[0].theta, fits[1].theta) and np.allclose(fits[0].theta, again.theta)
    p = fits[0].marginals(np.array([seqs[3]]))[0]
    assert p[tags[3] == 1].mean() > 0.6 > 0.4 > p[tags[3] == 0].mean()


def test_levels_beyond_the_fitted_ones_weigh_like_the_highest():
    """The whole sample's counts lift words to levels that neither half of it has."""
    rng = np.random.default_rng(5)
    top = toxicity.N_LEVEL - 1
    for unit in (toxicity.N_LEVEL, 1):  # levels of words, of prefixes
        seqs = [np.where(rng.random(12) < 0.2, unit * (top - 1), 0) for _ in range(60)]
        m = toxicity.Crf()
        toxicity.fit_chain(m, seqs, [(s > 0).astype(int) for s in seqs], [1] * len(seqs), rounds=60)
        below, above = (m.marginals(np.array([[0, 0, unit * k, 0, 0]]))[0, 2] for k in (top - 1, top))
        assert below > 0.7 and above >= below - 1e-9


def test_marginals_are_those_of_the_recursions():
    rng = np.random.default_rng(3)
    m = toxicity.Crf()
    for size in (1, 8):  # weights far apart, too
        m.theta, m.trans = size * rng.normal(size=len(m.theta)), size * rng.normal(size=(2, 2))
        codes = np.where(np.arange(30)[None] < rng.integers(1, 31, 50)[:, None], rng.integers(0, 25, (50, 30)), -1)
        assert np.allclose(m.marginals(codes), toxicity.forward_backward(m.emissions(codes), m.trans, codes >= 0)[0], atol=1e-9)
    assert abs(m._plain[7] - (m.marginals(np.zeros((1, 7), int)) ** 2).sum()) < 1e-12


def test_rows_without_id_are_held_out(spark):
    df = spark.createDataFrame([(None,), (1,)], "doc_id long").select(toxicity.training_rows().alias("t"))
    assert [r["t"] for r in df.collect()][0] is False


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op8_toxicity(spark, sf).cache()
    both = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = both.score.rank()
    n1 = (both.toxic == 1).sum()
    auc = (rank[both.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (both.toxic == 0).sum())
    assert auc > 0.85 and ((both.predicted == 1) & (both.toxic == 0)).sum() <= 2
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    r = out.where("doc_id in (0, 1, 2, 3)").orderBy("doc_id").collect()
    import zlib

    assert [x["held_out"] for x in r] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(4)]


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 16 and all(0 <= r["score"] < 0.01 for r in got)
    odd = spark.createDataFrame([(i, i % 2) for i in range(1, 17)] + [(4, None), (5, 7)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == 16
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    leak = " ".join(f"s{i}" for i in range(20, 40))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r["doc_id"] for r in out.collect()}
    assert 1 in kept and not kept & {2, 4, 5, 6, 8, 9, 12} and 13 in kept
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, at, str(tmp_path))
        assert nxt.columns == at.columns, name
        at = nxt
    assert "24be6443" not in at.where("doc_id = 13").first()["text"]
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_html_stays_in_proportion():
    """Wide cells, spans and nesting give text of a small multiple of the page's size, without losing any."""
    visible_text = htmltext.visible_text
    wide = "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2_000 + "</table>"
    text = visible_text(wide)
    assert len(text) < 3 * len(wide) and "x" * 20_000 + "  y" in text and text.count("a" + " " * 41 + "b") == 2_000
    spans = "<table>" + "<tr><td colspan=1000>a<td>b" * 1_000
    assert len(visible_text(spans)) < 10 * len(spans)
    assert visible_text("<div>" * 205 + "<ul><li>a<li>b") == "* a\n* b"
    assert visible_text("<div>" * 50_000 + "deep<p>er").split() == ["deep", "er"]
    lists = visible_text("<ul><li>a" * 3_000)
    assert lists.count("* a") == 3_000 and len(lists) < 3_000 * 100
    assert visible_text("<details><summary>S</summary>closed</details><details open><summary>T</summary>open</details>") == "S\nT\nopen"
    assert visible_text("<table><tr><td rowspan=0>A<td>1<tr><td>2<tr><td>3</table>") == "A  1\n   2\n   3"

"""Quality rules, language identification, licence scan and page text against brute force and on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import make_docs
from pyspark.sql import functions as F

from millrace.llm import html_extract, language_id, license_scan, quality_rules, queries


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_counts(spark, odd):
    rng = random.Random(3)
    rows = odd + [(100 + i, "".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\x0b", "\x1c", "c "]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    got = quality_rules.text_counts(make_docs(spark, rows, extra=True)).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter(map(tuple, got.collect())) == Counter((r[0], *counts_by_hand(r[1])) for r in rows)


def binomial_cdf(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))


def test_bound_is_exact():
    for n in (1, 10, 200, 900):
        for k in (0, 1, 3, 20):
            for rate in (0.01, 0.1):
                for delta in (0.05, 1e-4):
                    want = k <= rate * n and binomial_cdf(k, n, rate) <= delta
                    assert quality_rules.rejection_bound_holds(k, n, rate, delta) == want, (k, n, rate, delta)
    assert not quality_rules.rejection_bound_holds(0, 0, 0.1, 0.05)
    assert quality_rules.rejection_bound_holds(900_000, 10**8, 0.01, 1e-6)


def labelled(spark, prose, n=3000):
    """Good prose in stratum big, of which a twentieth shouts; shouting is labelled bad."""
    bad = lambda i: i % 20 == 0
    rows = [(i, prose(i, 60).upper() if bad(i) else prose(i, 60), "big" if i % 30 else "small") for i in range(n)]
    labels = spark.createDataFrame([(i, 0 if bad(i) else 1, 0) for i in range(n)] + [(None, 0, 0), (1, None, 0), (2, 1, 0)], "doc_id long, quality long, toxic long")
    return make_docs(spark, rows), labels, {i for i in range(n) if bad(i)}


def test_certified_cutoffs(spark, prose):
    docs, labels, bad = labelled(spark, prose)
    judged = quality_rules.quality_rules(docs, labels, max_false_rejection=0.06)
    rows = judged.select("id", "stratum", "kept", "rejected_by").collect()
    rejected = {r.id for r in rows if not r.kept}
    big_bad = {r.id for r in rows if r.stratum == "big"} & bad
    assert rejected <= big_bad and len(rejected) > 0.9 * len(big_bad)  # the small stratum has too few labels to reject anything
    assert all(r.rejected_by for r in rows if r.id in rejected)
    kept = quality_rules.keep_passing(docs, labels, max_false_rejection=0.06)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.id for r in rows} - rejected


def test_defaults_certify_with_few_hundred_labels(spark, prose):
    """One language with some 550 good documents in the holdout: six rules and their grids must not use up the error."""
    docs, labels, bad = labelled(spark, prose, 800)
    rows = quality_rules.quality_rules(docs, labels).select("id", "stratum", "kept").collect()
    big_bad = {r.id for r in rows if r.stratum == "big"} & bad
    rejected = {r.id for r in rows if not r.kept}
    assert rejected <= big_bad and len(rejected) > 0.9 * len(big_bad)


def test_certified_union_stays_below_the_rate(spark):
    """Two rules that each reject good documents: the bound holds for both together, and stricter cutoffs are left where the loosest fails."""
    rng = random.Random(5)
    counts, labels = [], []
    for i in range(4000):
        good = i % 4 > 0
        symbols, capitals = (rng.random() < (0.006 if good else 0.5)) * rng.randint(1, 9), (rng.random() < (0.012 if good else 0.5)) * rng.randint(1, 9)
        counts.append((i, "s", 100, 500, symbols, 0, 0, 10, capitals, 0))
        labels.append((i, int(good)))
    counts = spark.createDataFrame(counts, f"id long, stratum string, {quality_rules.COUNTS}")
    labels = spark.createDataFrame(labels, "doc_id long, quality long")
    cutoffs = quality_rules.certified_cutoffs(counts, labels)
    picked = cutoffs.collect()
    assert {r.rule for r in picked} == {"symbols", "capitals"}
    held = {r.id for r in counts.where("crc32(cast(cast(id AS string) AS binary)) % 4 > 0").collect() if r.id % 4}
    assert {r.good for r in picked} == {len(held)}
    lost = {r.id for r in quality_rules.judge(counts, cutoffs).where("not kept").collect()} & held
    assert len(lost) == max(r.good_rejected for r in picked) and quality_rules.rejection_bound_holds(len(lost), len(held), 0.02, 0.05)


def test_repeated_rows_certify_nothing_more(spark, prose):
    """A labelled id is one trial, however often its row occurs; a null stratum is not the empty one."""
    docs, labels, _ = labelled(spark, prose, 400)
    docs = docs.withColumn("lang", F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'b' END"))
    often = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 2 == 0, 20).otherwise(1)))).drop("copy")
    once, many = (quality_rules.certified_cutoffs(quality_rules.text_counts(d), labels, max_false_rejection=0.06) for d in (docs, often))
    assert sorted(map(repr, once.collect())) == sorted(map(repr, many.collect()))
    thirty = docs.where("doc_id % 20 <> 0").limit(30)
    many = quality_rules.text_counts(thirty.crossJoin(spark.range(20)).union(docs.where("doc_id % 20 = 0").crossJoin(spark.range(20))).drop("id"))
    assert quality_rules.certified_cutoffs(many, labels).count() == 0
    assert {r.stratum for r in quality_rules.text_counts(docs).select("stratum").distinct().collect()} == {quality_rules.NULL_STRATUM, "", "b"}


def test_quality_defaults_on_a_given_table(spark):
    """The dealt method acts on a given table, not the base rules alone."""
    from pathlib import Path

    if not Path(SF := "/root/testdata/sf0.1").is_dir():
        pytest.skip(f"no {SF}")
    judged = queries.QUERIES["op1_quality_rules"](spark, SF).where("NOT base_failed").select("doc_id", "kept").collect()
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    labelled_rows = [(good[r.doc_id], r.kept) for r in judged if good.get(r.doc_id) is not None]
    assert sum(not kept for q, kept in labelled_rows if not q) > 0.9 * sum(not q for q, _ in labelled_rows)
    assert sum(not kept for q, kept in labelled_rows if q) <= 0.02 * sum(q > 0 for q, _ in labelled_rows)


def test_quality_without_labels_and_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    docs = make_docs(spark, odd, extra=True)
    judged = quality_rules.quality_rules(docs, none)
    assert judged.count() == len(odd)
    n_words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert Counter((r.id, r.n_words, r.kept) for r in judged.collect()) == Counter((i, n_words(text), False) for i, text in odd)
    assert quality_rules.keep_passing(docs, none).columns == docs.columns
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0


def test_languages(spark, odd):
    rng = random.Random(1)
    stems = {"xx": "kato miru sola ne taki".split(), "yy": "brum grosch werk und zack".split(), "zz": "река дом и вода лес".split()}
    text = lambda lang, n: " ".join(rng.choice(stems[lang]) for _ in range(n))
    docs = make_docs(spark, [(i, text(lang, 30), lang) for i in range(90) for lang in stems] + [(None, "x", None)])
    model = language_id.train(docs)
    assert model.langs == ["xx", "yy", "zz"]
    mixed = text("xx", 20) + " 12 " + text("yy", 30) + ". " + text("zz", 8)
    rows = [(1, mixed), (2, text("zz", 3)), (3, None), (4, "12 + 34 !"), (4, "12 + 34 !"), (5, ""), (6, text("yy", 40_000))]
    got = language_id.identify(make_docs(spark, rows, extra=True), model).orderBy("id", "lang_pred").collect()
    assert [r.lang_pred for r in got] == ["yy", "zz", "und", "und", "und", "und", "yy"]
    spans = [(s.lang, mixed[s.begin : s.end].split()[0], mixed[s.begin : s.end].split()[-1]) for s in got[0].spans]
    words = re.findall(r"[^\W\d_]+", mixed)
    assert spans == [("xx", words[0], words[19]), ("yy", words[20], words[49]), ("zz", words[50], words[57])]
    assert got[2].score == 0 and got[6].score == 1.0
    assert language_id.identify(make_docs(spark, odd, extra=True), model).count() == len(odd)
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    cost = lambda s, p, penalty: s[np.arange(len(p)), p].sum() - penalty * (np.diff(p) != 0).sum()
    for _ in range(60):
        lengths = rng.integers(1, 7, 4)
        scores = rng.normal(size=(lengths.sum(), 2)) * 3
        ends = np.cumsum(lengths)
        path = language_id.viterbi(scores, ends - lengths, ends, 2.0)
        for a, b in zip(ends - lengths, ends):
            part = scores[a:b]
            best = max(cost(part, np.array([(c >> i) & 1 for i in range(b - a)]), 2.0) for c in range(1 << (b - a)))
            assert np.isclose(cost(part, path[a:b].astype(int), 2.0), best)
            assert np.isclose(cost(part, language_id.viterbi_one(part, 2.0).astype(int), 2.0), best)
            one = language_id.one_language(np.cumsum(part, axis=0), 2.0)
            assert one < 0 or np.isclose(part[:, one].sum(), best)


def test_one_language_is_the_best_path_of_three():
    scores = np.array([[10.0, -10.0, 0.0], [-11.0, 9.0, 0.0]])
    assert language_id.one_language(np.cumsum(scores, axis=0), 12.0) == -1  # the first, then the second: 7
    rng = np.random.default_rng(4)
    taken = 0
    for _ in range(400):
        n = int(rng.integers(1, 6))
        part = rng.normal(size=(n, 3)) * rng.choice([1, 3, 9])
        one = language_id.one_language(np.cumsum(part, axis=0), 6.0)
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        best = max(part[np.arange(n), p].sum() - 6.0 * (np.diff(p) != 0).sum() for p in paths)
        assert one < 0 or np.isclose(part[:, one].sum(), best)
        taken += one >= 0
    assert taken > 100
    labeller = language_id.Labeller(language_id.Model(["a", "b", "c"], np.zeros((language_id.BUCKETS, 3)), {}), 12.0)
    labeller.places, labeller.table = {"x": 0, "y": 1}, scores.astype(np.float32)
    assert labeller.label([["x", "y"]])[0].tolist() == [0, 1]


def test_held_out_accuracy(spark, sf_dir):
    rows = queries.QUERIES["op4_language_id"](spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def licences_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for n, t in enumerate(license_scan.TEMPLATES):
        key, whole = t.key.split(), t.text.split()
        offset = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for k in range(len(words)):
            if words[k : k + len(key)] == key:
                at = [k - offset + j for j in range(len(whole))]
                found.append((n, k, sum(0 <= i < len(words) and words[i] == w for i, w in zip(at, whole)) / len(whole)))
    return len(words), sorted(found)


def test_licences(spark, odd):
    rng = random.Random(9)
    phrases = [t.text for t in license_scan.TEMPLATES] + [t.key for t in license_scan.TEMPLATES] + ["MIT License", "mit", "license", "The", "É", "general public", "\x1c", "-", "cc by"]
    rows = odd + [(100 + i, rng.choice([" ", ". ", "\n", "--"]).join(rng.choice(phrases) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    rows.append((999, "mit license " * 20_000))
    got = license_scan.scan_licenses(make_docs(spark, rows, extra=True)).collect()
    mine = Counter((r.id, r.n_words, tuple(sorted((m.template, m.first_word, round(m.score, 9)) for m in r.matches))) for r in got)
    want = Counter()
    for i, text in rows:
        n, found = licences_by_hand(text)
        want[(i, n, tuple((t, k, round(s, 9)) for t, k, s in found))] += 1
    assert mine == want
    plan = license_scan.scan_licenses(make_docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/x">Home</a></li></ul></nav><header><h1>Site</h1></header><div class="cookie-notice">We use the cookies of the site.</div>
<article><h1>Head &amp; line</h1><!-- <p>no</p> --><p>First&nbsp;of
 the   <b>text</b>.<p>Short.<br>More<div class="ad">Buy <p>now</p></div><ul><li>item</li></ul><aside>side</aside>
<section id="comments"><p>I think this is the best of all the articles that I have read in the last years, and it is.</p></section></article>
<form><p>Name</p></form><footer>&copy; foot</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(PAGE) == "Head & line\nFirst of the text.\nShort. More\nitem"
    assert html_extract.main_text("<article><p>cut <b>off &lt;here") == "cut off <here"
    assert html_extract.main_text("<article><p>a < b and <a title='x > y'>c</a> d</p><p>text <unfinished") == "a < b and c d\ntext"
    assert html_extract.main_text("<div class=ad>x<article><p>Kept.</p></article>") == "Kept."
    prose = "It was the best of the days and it was for all of us that we had to go to the end of the road. " * 4
    blocks = f"<div><a href=/>Home</a> <a href=/>About</a></div><h2>Title</h2><div>{prose}</div><p>Yes, he did.</p><div>{prose}</div><div><a href=/>Imprint</a></div>"
    assert html_extract.main_text(blocks).split("\n") == ["Title", prose.strip(), "Yes, he did.", prose.strip()]
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == "" and html_extract.main_text("<nav>x</nav>") == ""
    assert len(html_extract.main_text("<article>" + "<p>word " * 50_000).split("\n")) == 50_000
    assert html_extract.main_text("<" * 100_000) == "<" * 100_000


def test_all_text_of_an_article_stays():
    for inner, text in (
        ("<ul><li><a href=/>one link only</a></li></ul>", "one link only"), ("<p>See <a href=/>one</a></p>", "See one"),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "where x=1 holds"), ("<object data=x><p>instead</p></object>", "instead"),
        *[(f"<div class='{c}'>kept</div>", "kept") for c in ("notice-board", "share-price", "related-work", "skip-lists", "popup-books")],
    ):
        for tag in ("article", "main"):
            assert html_extract.main_text(f"<nav>n</nav><{tag}><p>First.</p>{inner}</{tag}>") == f"First.\n{text}", inner
    for c in ("share-buttons", "ad", "ad-slot", "related-posts", "sidebar-left", "comment-list", "newsletter-box"):
        assert html_extract.main_text(f"<article><p>First.</p><div class='x {c}'>gone</div></article>") == "First.", c


def test_pages_made_from_known_text():
    """Random articles among random furniture: the text that comes back is the text that went in."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéß&<'") for _ in range(rng.randint(1, 8)))
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("é", rng.choice(["é", "&eacute;", "&#233;"]))
    words = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    furniture = [
        lambda: f"<nav><ul><li><a href='/{rng.random()}'>{escape(words(3))}</a></li></ul></nav>", lambda: f"<header><h1>{escape(words(4))}</h1></header>",
        lambda: f"<aside class=sidebar><p>{escape(words(30))}</p></aside>", lambda: f"<div class='ad'>{escape(words(20))}</div>",
        lambda: f"<script>var a = '<p>{words(3).replace('<', '')}</p>';</script><style>p > b {{}}</style>", lambda: f"<!-- <p>{words(5).replace('-', '')}</p> -->",
        lambda: f"<form><p>{escape(words(6))}</p><input></form>", lambda: f"<section class=comments><p>{escape(words(40))}</p></section>",
        lambda: f"<footer><p>{escape(words(9))}</p></footer>", lambda: f"<div id='cookie-notice'>{escape(words(9))}</div>",
    ]
    for _ in range(300):
        parts, blocks = [], []
        for _ in range(rng.randint(1, 12)):
            if rng.random() < 0.3:
                parts.append(rng.choice(furniture)())
            text = words(40)
            blocks.append(text)
            tag = rng.choice(["p", "h2", "li", "div", "blockquote", "pre", "td", "section"])
            inner = escape(text).replace(" ", rng.choice([" ", "\n  ", "&nbsp;", " <b>", "<br>"]), 1)
            parts.append(f"<{tag}>{inner}</{tag}>")
        page = f"<html><body>{rng.choice(furniture)()}<article>{''.join(parts)}</article>{rng.choice(furniture)()}</body></html>"
        assert html_extract.main_text(page) == "\n".join(blocks), page


def test_regions_around_the_main_text():
    for mark in ('class="content-with-sidebar"', "class=no-sidebar", 'id="page-header"', "class=widget", "hidden"):
        for inner in ("<article><p>Kept.</p></article>", "<main><p>Kept.</p></main>"):
            page = f"<div {mark}><p>Beside.</p>{inner}<div class=sidebar>side</div></div>"
            assert html_extract.main_text(page) == "Kept.", page
    assert html_extract.main_text("<form id=aspnetForm><nav>n</nav><main><p>Kept.</p></main></form>") == "Kept."
    assert html_extract.main_text("<main><div class='no-sidebar'><article><p>Kept.</p></article></div></main>") == "Kept."
    two = "<div class='has-sidebar'><article><p>One.</p></article></div><div><article><p>Two.</p></article></div>"
    assert html_extract.main_text(two) == "One.\nTwo."
    replies = "<section id=comments><article><p>Reply.</p></article></section>"
    assert html_extract.main_text(f"<article><p>Kept.</p>{replies}</article>") == "Kept."
    assert html_extract.main_text(f"<main><article><p>Kept.</p></article>{replies}</main>") == "Kept."
    prose = "It was the best of the days and it was for all of us that we had to go to the end of the road. " * 4
    assert html_extract.main_text(f"<div class='layout no-sidebar'><p>{prose}</p></div>") == prose.strip()
    assert html_extract.main_text("<div class=cookie-notice>x<p>y</p></div><div class='post-comments'>z</div>") == ""


@pytest.mark.parametrize("sentence", [
    "Aurinko paistoi koko päivän, ja lapset leikkivät pihalla iltaan saakka. ", "Il sole splendeva tutto il giorno e i bambini giocavano fuori fino a sera. ",
    "Весь день светило солнце, и дети играли во дворе до самого вечера. ", "太陽は一日中輝いていて、子供たちは夕方まで庭で遊んでいました。",
])
def test_languages_without_stop_words(sentence):
    links = "<ul>" + "<li><a href=/>Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod</a></li>" * 3 + "</ul>"
    long, short = (sentence * 5).strip(), (sentence * 2).strip()
    page = f"{links}<p>{long}</p><p>{short}</p><p>{long}</p>{links}"
    assert html_extract.main_text(page).split("\n") == [long, short, long]
    assert html_extract.main_text(f"{links}<p>{short}</p>{links}") == short
    english = "This is the notice of the site that we have for you and it is not in the language of the page. " * 2
    assert long in html_extract.main_text(f"{links}<p>{long}</p><p>{long}</p><p>{english}</p>{links}").split("\n")


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, None, "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = sorted(((r.page_id or 0, r.n_chars, r.text) for r in html_extract.extract_text(pages).collect()))
    assert [g[:2] for g in got] == [(0, 0), (1, 47), (1, 47), (2, 0), (3, 5)] and got[4][2] == "plain"
    assert html_extract.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op1_quality_rules", "op6_license_scan", "op9_html_text"])
def test_queries_keep_every_row(name, spark, sf_dir):
    table = "pages" if name.startswith("op9") else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()

"""Held-out accuracy of the classifiers, and pages with known main text."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborql.llm import labelled, quality, queries, toxicity, webpages

SYLLABLES = "lo re mi fa so la ti do ka ne".split()


def make_text(rng, n, extra=()):
    words = ["".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(n)]
    for w in extra:
        words.insert(int(rng.integers(0, n)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        toxic, good = int(i % 4 == 0), int(i % 5 != 1)
        text = make_text(rng, int(rng.integers(10, 200)), [f"grumblo{rng.choice(SYLLABLES)}"] * 2 if toxic else [])
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", len(text)))
        labels.append((i, good, toxic))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1001, "", "en", "s", 0), (None, "abc", "en", "s", 3), (1002, "x" * 200_000, "en", "s", 200_000)]
    labels += [(0, 1, 1), (None, 1, 0), (1, None, None), (5000, 1, 1)]
    path = tmp_path_factory.mktemp("classifiers")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("x")).withColumn("quality", F.lit(5)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{path}/none/{t}.parquet")
    return str(path)


@pytest.mark.parametrize(("name", "label", "threshold"), [("op5_toxicity", 2, 0.5), ("op8_quality", 1, 0.3)])
def test_held_out_accuracy(spark, folder, name, label, threshold):
    rows = queries.queries()[name](spark, folder).collect()
    assert len(rows) == 605
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    truth = {i: (None, int(i % 5 != 1), int(i % 4 == 0))[label] for i in range(600)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


@pytest.mark.parametrize("name", ["op5_toxicity", "op8_quality"])
def test_no_documents_and_no_labels(spark, folder, name):
    assert queries.queries()[name](spark, f"{folder}/none").count() == 0


@pytest.mark.parametrize("name", ["op5_toxicity", "op8_quality"])
def test_held_out_labels_change_nothing(spark, folder, tmp_path, name):
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels.select("doc_id", *[F.when(held, 1).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")]).write.parquet(f"{tmp_path}/labels.parquet")
    before, after = (sorted(map(str, queries.queries()[name](spark, str(p)).collect())) for p in (folder, tmp_path))
    assert before == after


def test_labels_of_one_class_only():
    for y in (0, 1):
        m = quality.fit(["some text"] * 5, np.full(5, y))
        assert (m.scorer()([b"x", b""]) > 0.5).all() == bool(y)
        t = toxicity.fit([b"some text"] * 5, np.full(5, y))
        assert round(t.scorer()(b"x")) == y
    assert toxicity.fit([], np.zeros(0, int)).scorer()(b"x") < 0.5
    assert len(quality.fit([], np.zeros(0, int)).scorer()([b"x"])) == 1


def test_a_misspelling_shares_vectors():
    rng = np.random.default_rng(2)
    texts = [make_text(rng, 40, ["grumbler"] * (i % 2)).encode() for i in range(120)]
    scorer = toxicity.fit(texts, np.arange(120) % 2).scorer()
    assert scorer(b"lore grumblerr mifa") > 0.5 > scorer(b"lore mifa")


def test_word_values_cover_every_word():
    at, word = toxicity.grams(["", "a", "äö\U0001f600", "longer"])
    assert np.bincount(word).tolist() == [1, 2, 7, 16] and at.min() >= 0 and at.max() < toxicity.BUCKETS


def test_long_words_and_stutters():
    assert toxicity.split(b"A a a b " + b"x" * 100) == ["a", "b", "x" * 40, "x" * 20]
    assert toxicity.split(b"") == [""]


def test_logistic_finds_the_rate():
    w = labelled.logistic(np.zeros((100, 1)), np.arange(100) % 4 == 0)
    assert 1 / (1 + np.exp(-w[-1])) == pytest.approx(0.25, abs=0.02)


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a="</div>";</script></head><body class=x><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div id="cookie-notice"><p>We use cookies and a lot of words here to say it at length.</p></div>
<div class="wrap"><div class="story-{i} body"><h1>Title {i} &amp; more</h1><p>First   para&shy;graph &eacute; <b>bold<p>Second<br>line <a href="#">link</a> 1 &lt; 2</p>
<div class="ad-box">Buy</div><ul><li>one<li>two</ul><blockquote>Quote {i}</blockquote><form><p>Mail?</p></form><section class="comments"><p>{long}</p></section></div>
<div class="sidebar"><p>Elsewhere</p></div></div><footer>&copy;</footer></body></html>"""


def page(i, long="I agree. " * 3):
    return PAGE.replace("{i}", str(i)).replace("{long}", long)


def test_pages(spark, tmp_path):
    rows = [(i, f"https://User@Host.example:80/{i}", page(i)) for i in range(6)]
    rows += [(6, "https://host.example/x", "<body><div class='wrap'><div class='body story-9'>Short</div></div><div><p>" + "Long menu text. " * 50 + "</p></div>")]
    rows += [(7, None, None), (8, "x", ""), (8, "x", ""), (None, "http://a/", "plain &amp; text"), (9, "http://b/", "<p>" * 3000 + "deep" + "<div>" * 3000 + "er"), (10, "http://c/", "<div><p>open <a href='x>y"), (11, "http://d/", "<table><tr><td>a<td>b<tr><td>c</table>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("id", F.lit(2)).withColumn("host", F.lit(2))
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_main_text(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    for i in range(6):
        assert by[i] == f"Title {i} & more\nFirst para\xadgraph é bold\nSecond line link 1 < 2\none\ntwo\nQuote {i}"
    assert by[6] == "Short"  # the host's path wins over the page's own best
    assert (by[7], by[8], by[None], by[9], by[11]) == ("", "", "plain & text", "deep\ner", "a\nb\nc") and by[10].startswith("open")
    df.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op3_main_text(spark, f"{tmp_path}/none").count() == 0


def test_votes_name_generalised_paths():
    assert webpages.votes(page(3))[0][0] == "body>div.wrap>div.body.story-"

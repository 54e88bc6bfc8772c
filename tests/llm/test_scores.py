"""Scores and main texts against plain, slow versions."""

import html.parser
import os

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from arborql.llm import quality, toxicity, webpages

TEXTS = ["", "one", "a b c d e f g h i j", "the theory of the thing and then some more of the same " * 9, "Ünïcode words ß and\tothers\n" * 4, "x" * 300]


def test_toxicity_against_vectors(spark):
    """Windows of words, each word the mean of its grams' vectors, softmax, and the chance that no window is toxic."""
    y = np.arange(len(TEXTS) * 8) % 2
    texts = [f"{t} {'bad' if b else 'good'}{i}".encode() for i, (t, b) in enumerate(zip(TEXTS * 8, y, strict=True))]
    model = toxicity.fit(texts, y, steps=5)
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "i long, t string").repartition(2)
    got = {r.i: r.score for r in toxicity.score(df, "t", model).collect()}
    for i, t in enumerate([*TEXTS, None]):
        words, none = toxicity.split((t or "").encode()), 1.0
        for at in range(0, len(words), toxicity.WINDOW):
            vectors = [np.mean([model.embeddings[g] for g in toxicity.grams([w])[0]], axis=0) for w in words[at : at + toxicity.WINDOW]]
            logits = toxicity.SCALE * np.mean(vectors, axis=0) @ model.softmax + np.array([0, model.bias])
            p = np.exp(logits - logits.max())
            none *= p[0] / p.sum()
        assert got[i] == pytest.approx(1 - none, abs=1e-5)


def test_quality_against_sizes(spark):
    """Sizes of pieces under two dictionaries, calibrated."""
    good, bad = (quality.dictionary([t.encode() for t in TEXTS * 5 if t and (len(t) % 2 == k)]) for k in (0, 1))
    model = quality.Model(good, bad, np.array([3.0, -2.0, 1.0, 0.5, -0.25]))
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "i long, t string").repartition(2)
    got = {r.i: r.score for r in quality.score(df, "t", model).collect()}
    coders = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]
    for i, t in enumerate([*TEXTS, None]):
        data = (t or "").encode()
        a, b = (sum(len(c.compress(data[k : k + quality.PIECE])) for k in range(0, len(data), quality.PIECE)) for c in coders)
        d, g = ((b - a) / len(data), a / len(data)) if data else (0.0, 0.0)
        z = 3 * d - 2 * d / max(g, 1e-3) + g + 0.5 * g * g - 0.25
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=0.02)


class Article(html.parser.HTMLParser):
    """Text of the elements below article, a line for each block."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "ol", "blockquote", "table", "tr", "td", "th", "div", "article", "section", "pre"}

    def __init__(self):
        super().__init__()
        self.inside, self.hidden, self.lines = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in ("script", "style", "nav", "aside", "form")
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.hidden -= tag in ("script", "style", "nav", "aside", "form")
        if tag in self.BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.inside > 0 and not self.hidden:
            self.lines[-1] += data


PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no tables")
def test_main_text_against_a_plain_parser(spark):
    pages = spark.read.parquet(PAGES).where(F.col("html").contains("</article>"))
    got = {r.id: r.text for r in webpages.main_text(pages, "page_id", "url", "html").collect()}
    for r in pages.collect():
        plain = Article()
        plain.feed(r.html)
        want = [" ".join(line.split()) for line in plain.lines]
        assert got[r.page_id] == "\n".join(filter(None, want)), r.page_id
    assert len(got) > 20

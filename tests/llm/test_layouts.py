"""Hosts with several layouts: every page is read by its own container."""

import pytest

from arborql.llm import webpages

NAMES = ["alpha", "beta", "gamma", "delta", "omega"]


@pytest.mark.parametrize("count", [2, 5])
def test_layouts_of_a_host(spark, count):
    rows = []
    for i in range(10 * count):
        name = NAMES[i % count]
        text = " ".join(f"{name}{i}word{k}" for k in range(80))
        rows.append((i, f"https://h.example/{i}", f"<html><body><div class='strip'>Our lines in town {i}</div><div class='{name}'><p>{text}</p></div></body></html>", text))
    rows.append((99, "https://h.example/99", f"<html><body>{'bare text ' * 40}</body></html>", ("bare text " * 40).strip()))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r.id: (r.text, r.path) for r in webpages.main_text(pages, "page_id", "url", "html").collect()}
    assert {i: t for i, (t, _) in got.items()} == {r[0]: r[3] for r in rows}
    assert all(got[i][1] == f"body>div.{NAMES[i % count]}" for i in range(10 * count))


def test_names_alone_do_not_tell_boilerplate(spark):
    """An article with parts named as boilerplate often is: they stay, unless they are links or the same on other pages."""
    text = lambda i, n: " ".join(f"word{(i * 31 + k * 7) % 97}" for k in range(n))
    page = (
        "<body><nav><a href=/>Home</a></nav><article><h1>Title {i}</h1><p class='popular'>{a}</p><section id='discussion'><h2>Discussion</h2><p>{b}</p></section>"
        "<div class='related'><a href=1>One</a> <a href=2>Two</a></div><div class='notice'>We moved. Read more about it.</div><div class='comments'>{c}</div></article></body>"
    )
    rows = [(i, "https://journal.example/a", page.format(i=i, a=text(i, 20), b=text(i + 1, 300), c=text(i + 2, 30))) for i in range(8)]
    rows += [(100 + i, "https://copies.example/a", rows[0][2]) for i in range(9)]  # copies are one page: nothing recurs
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for r in webpages.main_text(df, "page_id", "url", "html").collect():
        i = r.id if r.id < 100 else 0
        want = [f"Title {i}", text(i, 20), "Discussion", text(i + 1, 300)] + ["We moved. Read more about it."] * (r.id >= 100)
        assert r.text.split("\n") == want, r

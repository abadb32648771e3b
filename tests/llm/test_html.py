"""Main-text extraction: drawn pages that training didn't see, hand-written pages, odd input."""

from random import Random

import numpy as np

from tabulon.llm import html_text
from tests.conftest import SF


def test_unseen_pages():
    rng = Random(12345)
    pages = [html_text.sample_page(rng) for _ in range(200)]
    got = html_text.extract_many([p for p, _ in pages], html_text.trained())
    assert np.mean([a == "\n\n".join(b) for a, (_, b) in zip(got, pages, strict=True)]) > 0.93


def test_hand_written():
    page = """<html><head><title>T</title><script>if (a<b) document.write("<p>x</p>")</script></head><body class=page>
    <header><a href=/>Site</a><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav></header>
    <div id="cookie-notice"><p>We use cookies, as everyone does. Accept them all?</p><button>OK</button></div>
    <article><h1>A &amp; B &#8211; the  story</h1><p>First <b>bold</b>\n text, of&nbsp;some length; it goes on for a while.<br>
    <p>Second paragraph <a href=x>with a link</a> and more words to read.<div class="ad">Buy now! Best price.</div>
    <p>Third paragraph, and the last one, closes the story.</p></article>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thank you for it.</p></div></section>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=3>Other</a></li></ul></aside>
    <form action=/s><label>Search</label><input></form><footer>&copy; 2024 Site, all rights reserved.</footer></body></html>"""
    got = html_text.extract_many([page], html_text.trained())[0]
    assert got == "A & B – the story\n\nFirst bold text, of some length; it goes on for a while.\n\nSecond paragraph with a link and more words to read.\n\nThird paragraph, and the last one, closes the story."


def test_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain  text &lt;"), (3, "u", "plain  text &lt;"), (None, "u", "<p"), (4, "u", "<div><p>a</div></p></b><li>"), (5, "u", "<article><p>" + "word, " * 50_000 + "</p></article>"), (6, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "plain text <" and len(by[5]) == 50_000 * 6 - 1
    assert html_text.main_text(pages.where("false")).count() == 0


def test_decoding_never_contradicts():
    rng = np.random.default_rng(0)
    nodes, _ = html_text.parse(html_text.sample_page(Random(3))[0])
    for i, n in enumerate(nodes):
        n.index = i
    for _ in range(50):
        kept = html_text.decode(nodes, rng.normal(0, 2, len(nodes)))
        tops = {i for i in kept if nodes[i].parent is None or nodes[i].parent.index not in kept}
        for i in tops:  # nothing kept stands below something left out within an article
            up = nodes[i].parent
            while up is not None:
                assert up.index not in kept
                up = up.parent


def test_driver_pages(spark):
    import re

    rows = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.main_text(rows).join(rows.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html_text.references.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def one(body):
    return html_text.extract_many([f"<html><body><nav><a href=1>One</a> <a href=2>Two</a></nav><article>{body}</article></body></html>"], html_text.trained())[0]


def test_no_text_is_lost():
    first, second, third = ("The first paragraph has words enough to be one.", "The second one isn't short either, and goes on.", "The third paragraph ends the story at last.")
    for open_ in ("<p title=it's>", "<p data-x='a\"b' title=\"it's > that\">", "<p it's a=b\"c>", '<p class="x">'):
        assert one(f"<p>{first}{open_}{second}<p>{third}") == f"{first}\n\n{second}\n\n{third}"
    assert one(f"<p>{first}</p><p>{second} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object data=a>shown</object> <svg><text>drawn</text></svg> <canvas>too</canvas></p>") == f"{first}\n\n{second} x=2 shown drawn too"
    assert html_text.extract_many(["<![CDATA[hello world", "<![CDATA[hello world]]>"], html_text.trained()) == ["hello world"] * 2


def test_long_pages_have_the_same_rules():
    """Thousands of paragraphs in one parent, all kept, and time in proportion; hostile markup isn't quadratic either."""
    from time import process_time

    took = []
    for n in (5000, 20_000):
        many = [f"Paragraph {i} says a few words, and a few more, then ends." for i in range(n)]
        t = process_time()
        assert one("".join(f"<p>{m}</p>" for m in many)) == "\n\n".join(many)
        took.append(process_time() - t)
    assert took[1] < 8 * took[0]
    for bad in ('<a b="', "<a ", "<select><option>", "<div></b>", "<!-- "):
        t = process_time()
        html_text.extract_many([bad * 20_000 + "'"], html_text.trained())
        assert process_time() - t < 20, bad

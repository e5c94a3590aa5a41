"""Parts of an article that bear doubtful names, forms around pages, and references."""

import random

from curvelake.llm import html_text

SCHEMA = "page_id long, url string, html string"


def words_of(k, n=40):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


def texts(spark, pages):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], SCHEMA)
    return {r["page_id"]: r["text"] for r in html_text.main_texts(df).collect()}


def test_a_form_around_the_page_is_walked(spark):
    page = "<html><body><form action='/' method=post><input type=hidden value=x><h1>T%d</h1><p>%s</p><label>Name</label><button>Send</button></form><form>Small %d</form></body></html>"
    got = texts(spark, [(f"http://form{k}.example/", page % (k, words_of(k), k)) for k in range(3)])
    assert got == {k: f"T{k}\n\n{words_of(k)}" for k in range(3)}
    # a wide form of little text is no page
    options = "".join(f"<option>choice {k}</option>" for k in range(200))
    assert texts(spark, [("", f"<body><p>{words_of(1)}</p><form><select>{options}</select>Pick one</form></body>")])[0] == words_of(1)
    assert texts(spark, [("", f"<BODY><FORM ><P>{words_of(2)}")])[0] == words_of(2)


def test_doubtful_names_inside_an_article_stay():
    page = "<body><div class=header>Site</div><article><h1 class='header'>Title</h1><p class='notice'>Mind this.</p><section class='related work'><h2>Related work</h2><p>Others did it.</p></section><div class=comments>No</div></article>"
    assert html_text.extract(page, frozenset(), None) == "Title\n\nMind this.\n\nRelated work\n\nOthers did it."
    assert html_text.extract("<body><h1 class=header>Title</h1><div class=notice>Out</div><p>Text</p>", frozenset(), None) == "Title\n\nText"


def test_the_template_decides_on_doubtful_names(spark):
    """In the container a varying text stays, one of all pages goes; outside both go."""
    page = "<body><div class=header>Site %d</div><div id=main><h1>T%d</h1><div class='notice'>We are closed on Mondays.</div><p>%s</p><div class=related>%s</div></div><div class=widget>%s</div></body>"
    got = texts(spark, [("http://t.example/", page % (k, k, words_of(k), words_of(100 + k, 5), words_of(200 + k, 5))) for k in range(6)])
    assert got == {k: f"T{k}\n\n{words_of(k)}\n\n{words_of(100 + k, 5)}" for k in range(6)}


def test_references_are_decoded_in_their_own_text(spark):
    got = texts(spark, [("", "<p>R&<b>amp;</b>D &lt;b&gt; &amp;amp; a&nbsp;&nbsp;b<i>&eacute;</i>&#x41;</p>")])
    assert got[0] == "R&amp;D <b> &amp; a  béA".replace("  ", " ")


def test_classes_are_told_apart_by_both_sums(spark):
    from pyspark.sql import functions as F

    pages = [(k, "http://v.example/", f"<body><div><p>{words_of(k)}</p><i>a</i></div>") for k in range(4)]
    keyed = spark.createDataFrame(pages, SCHEMA).select(html_text._host().alias("host"), F.xxhash64("html").alias("row"), "html")
    rows = html_text.candidates(keyed).collect()
    assert all(len(r["class"]) == 32 for r in rows)
    assert all(len(r["vector"].split()) == 3 for r in rows)
    assert html_text.candidates(keyed.limit(0)).count() == 0

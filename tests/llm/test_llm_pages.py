"""Main text and language of pages."""

import re
import time
from html import unescape

import pytest
from pyspark.sql import functions as F

from odd_rows import with_clashes
from veilkit.llm import languages as L
from veilkit.llm.pages import extract, main_text

ARTICLE = ["The quick brown fox is in the house and it was not for the dog that it was to be seen there.",
           "A short one.", "Another of the long paragraphs that is about the fox and the dog in the house with many of the words."]
BOILERPLATE = """<header><h1>The site</h1><nav><ul><li><a href="/a">Home of the site</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies on this site and it is for the best of you that they are in use.</div>
<div id="topAd">Buy the best of all things that are for sale in this shop and it is not for long.</div>"""
END = """<aside class="sidebar"><p>Read more of the things that are to be read in the side bar and it is long.</p></aside>
<form action="x"><p>Your name and your mail are to be given in this form for the news of the site.</p><textarea>It is me</textarea></form>
<section id="comments"><h2>Comments</h2><p>I think that the article is of the best and it was a joy to read it all.</p></section>
<div style="display:none">This is not to be seen by the people that are here for the text of the page.</div>
<footer>&copy; The site and all of the people that are in it.</footer>"""


@pytest.mark.parametrize("box", ["article", "main", 'div class="entry-content"', "div"])
def test_boilerplate_goes_and_the_article_stays(box):
    paragraphs = "".join(f"<p>{p}" + ("</p>" if i % 2 else "") for i, p in enumerate(ARTICLE))
    page = f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{BOILERPLATE}<{box}>{paragraphs}</{box.split()[0]}>{END}</body></html>"
    assert main_text(page) == "\n\n".join(ARTICLE)


def test_markup():
    assert main_text("<article><p>a &lt;b&gt; &amp;amp; caf&eacute; &#x41;&nbsp;x<br>next  line\n\tend</p></article>") == "a <b> &amp; café A x next line end"
    assert main_text('<article><p title="a > b">one<!-- <p>no</p> --> two<script>var t="</p>";</script></p><P>three</P></article>') == "one two\n\nthree"
    assert main_text("<article><h1>Title</h1><header><h2>Sub</h2></header><p>is <a href=x>this</a> of it</p></article>") == "Title\n\nSub\n\nis this of it"
    assert main_text("<article><p>cut in the mid<p cla") == "cut in the mid"
    assert main_text("<article><p>a < b and c</p></article>") == "a < b and c"
    assert [main_text(x) for x in (None, "", "<p></p>", "<script>x")] == ["", "", "", ""]


def test_short_blocks_follow_their_neighbours():
    long_good, long_bad = ARTICLE[0], "Zyx wvu tsr qpo nml kji hgf edc bau zyx wvu tsr qpo nml kji hgf edc bau zyx"
    blocks = ["near good", long_good, "x", long_good, "near it", "between", "near that", long_bad, "near bad"]
    got = main_text("".join(f"<div>{b}</div>" for b in blocks)).split("\n\n")
    assert got == ["near good", long_good, "x", long_good, "near it"]


def test_elements_without_text():
    def text(middle):
        return main_text(f"<article><p>one</p>{middle}<p>two</p><p>three</p></article>").split("\n\n")
    for gone in ('<svg class="i"/>', "<svg><svg/><title>no</title><path></svg>", "<select-box></select-box>", "<title-bar>", "<SELECT><option>no</select >",
                 "<iframe>", "<svg>", "<noscript>", "<template>", "<textarea>", "<object/>", "<math/>", "<script-x/>", '<svg title="a > b"/>',
                 "<script>a</scripts><p>no</script\n>", "<style>p{}</style>"):
        assert text(gone) == ["one", "two", "three"], gone
    assert text("<p>is <math><mi>x</mi></math> or <object data=a>that</object></p>") == ["one", "is x or that", "two", "three"]
    assert text("<script>no") == ["one"]
    began = time.time()
    main_text("<svg><select>x" * 50_000)
    assert time.time() - began < 5


def test_article_places_are_no_veto():
    long = ARTICLE[0], ARTICLE[2]
    body = f"<h2>A title</h2><p>{long[0]}</p><p>{ARTICLE[1]}</p><p>{long[1]}</p>"
    whole = "\n\n".join(["A title", *ARTICLE])
    assert main_text(f'<div class="post-meta">By X</div><div class="content">{body}</div>') == "By X\n\n" + whole
    cards = "".join(f"<article><h3><a href=/{i}>More {i}</a></h3></article>" for i in range(3))
    assert main_text(f'<div class="content">{body}</div>{cards}') == whole
    assert main_text(f"<article><p>{long[0]}</p></article><div><p>{long[1]}</p></div>") == "\n\n".join(long)


@pytest.mark.parametrize("box", ['div class="layout no-sidebar"', 'div id="page" class="has-sidebar"', 'div class="main search"',
                                 'form action="page.aspx"', 'div class="single has-comments"'])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_marks_of_page_wrappers_are_no_veto(box, inner):
    paragraphs = "".join(f"<p>{p}</p>" for p in ARTICLE)
    name = box.split()[0]
    end = END if name != "form" else END.replace("<form", "<aside").replace("</form", "</aside")
    page = f"<body><{box}>Menu {BOILERPLATE}<{inner}>{paragraphs}</{inner}>{end}</{name}></body>"
    assert main_text(page) == "\n\n".join(ARTICLE)
    assert main_text(f"<{box}><{box}><{inner}>{paragraphs}</{inner}></{name}></{name}>") == "\n\n".join(ARTICLE)


def test_long_comments_and_deep_marks():
    comments = "".join(f"<article><p>{ARTICLE[0]}</p></article>" for _ in range(9))
    assert main_text(f'<div><p>{ARTICLE[2]}</p></div><div id="comments">{comments}</div>') == ARTICLE[2]
    began = time.time()
    main_text("<div class=ad>x" * 20_000)
    assert time.time() - began < 5


def test_pages_without_an_article():
    """Short pages, and languages whose stop words are not listed."""
    assert main_text("<body><p>Hello world.</p></body>") == "Hello world."
    assert main_text("<nav><a href=/>Home</a></nav><p>Hello world.</p><footer>end</footer>") == "Hello world."
    turkish = ["Yeni kanunun yürürlüğe girmesiyle birlikte şirketlerin kişisel verileri yurt dışına aktarması bir izne bağlandı.",
               "Uzmanlar, uygulamanın ilk aylarında çok sayıda başvuru yapıldığını ve sürecin daha uzun sürdüğünü söylüyor."]
    finnish = ["Uusi laki edellyttää yrityksiltä henkilötietojen käsittelyn huolellista suunnittelua, dokumentointia sekä valvontaa.",
               "Asiantuntijoiden mukaan muutokset parantavat kuluttajien luottamusta digitaalisiin palveluihin merkittävästi."]
    japanese = ["新しい法律の施行により企業は個人情報を海外に移転する前に許可を得る必要があると専門家は述べている。" * 3, "制度の開始から数か月で多くの申請が提出され審査に時間がかかっているという。" * 3]
    for paragraphs in (turkish, finnish, japanese):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        assert main_text(f"<body>{BOILERPLATE}<div>{body}</div>{END}</body>") == "\n\n".join(paragraphs)
        assert main_text(f"<body><ul><li><a href=/a>a link to another page of this site</a></li></ul>{body}</body>") == "\n\n".join(paragraphs)


@pytest.mark.parametrize("mark", ['div class="cookie-banner"', 'section id="newsletter"', 'form action="x"', 'div class="related"'])
def test_long_notices_beside_an_article(mark):
    notice = "We use cookies on this site and it is for the best of you that they are in use by all of us. " * 7
    for box in ("article", "main"):
        page = f"<body><{mark}><p>{notice}</p></{mark.split()[0]}><{box}><p>{ARTICLE[0]}</p><p>Short.</p></{box}></body>"
        assert main_text(page) == f"{ARTICLE[0]}\n\nShort."
        assert main_text(page.replace(ARTICLE[0], "It is so.")) == "It is so.\n\nShort."


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = extract(with_clashes(pages, "text", "url")).collect()
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == len(html)
    for r in rows:
        body = html[r["page_id"]].split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"<[a-z/][^<>]*(>|$)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "u", ""), (None, "u", "<p>x"), (3, "", "<div>" * 20_000 + "deep of the"), (4, "v", "<" * 50_000)]
    began = time.time()
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert time.time() - began < 20 and len(got) == 6
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", "", ""]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_of_held_out_texts(spark, sf):
    """Trained on one half of the documents, right on the other half's texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    other = docs.filter(~half & (F.length("text") > 100)).select(
        F.col("doc_id").alias("page_id"), F.lit("").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"), F.col("lang").alias("true"))
    got = L.identify(with_clashes(other, "url", "html"), docs.filter(half)).join(other.select("page_id", "true"), "page_id").collect()
    assert len(got) > 50 and sum(r["lang"] == r["true"] for r in got) / len(got) > 0.95


def test_pages_by_language(spark, sf):
    pages, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "documents"))
    rows = L.identify(pages, docs).collect()
    assert len(rows) == pages.count()
    assert sum(r["lang"] == re.search("//[^/]*/([a-z]+)/", r["url"])[1] for r in rows) / len(rows) > 0.98
    assert all(0.25 <= r["probability"] <= 1 for r in rows)


def test_evidence_beside_the_text(spark, sf):
    """Pages without text follow their declaration, else their host, else their domain, else all pages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {k: next(r["text"] for r in docs.filter(F.length("text") > 400).collect() if r["lang"] == k) for k in ("de", "fr")}
    rows, n = [], 0
    for lang, host in (("de", "www.blau.example"), ("fr", "bleu.other.test")):
        for _ in range(40):
            n += 1
            rows.append((n, f"https://{host}/{n}", f"<html lang='{lang}-XX'><p>{text[lang]}"))
    rows += [(101, "https://www.blau.example/x", ""), (102, "http://bleu.other.test:80/", None), (103, None, "<html lang=fr>"),
             (104, "https://neu.blau.example", "")]
    got = {r["page_id"]: r for r in L.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert [got[i]["lang"] for i in (1, 41, 101, 102, 103, 104)] == ["de", "fr", "de", "fr", "fr", "de"]
    assert got[101]["text_lang"] is None and got[103]["declared"] == "fr" and got[102]["host"] == "bleu.other.test"


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")
    assert [r["lang"] for r in L.identify(pages, docs).collect()] == [None]
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, "fr"), (3, "x", None)], docs.schema)
    assert L.identify(pages.limit(0), docs).count() == 0
    assert [r["lang"] for r in L.identify(pages, docs).collect()] == ["en"]

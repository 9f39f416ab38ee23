"""Main text of pages: against a plain parser of the standard library, on hand-made
layouts, and the vote of a host against its pages' own choices."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from cadence.llm import extraction, queries
from cadence.llm.extraction import Page, extract, extract_pages, winning_paths

SF01 = "/root/testdata/sf0.01"
PROSE = "This is a sentence of the article, with a comma and enough words to be prose. "


class Plain(HTMLParser):
    """Text of the article element, block by block."""

    BLOCKS = ("p", "h1", "br", "div", "article", "footer")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.out = False, []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.on = True
        if tag == "footer":
            self.on = False
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == "article":
            self.on = False
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.on:
            self.out.append(data)


def plain(html):
    p = Plain()
    p.feed(html or "")
    p.close()
    return " ".join("".join(p.out).split())


def test_whole_table_against_plain_parser(spark):
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = queries.op13_html_extraction(spark, SF01).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (*want[r.page_id], len(want[r.page_id][1]))


def body(html):
    return extract(html, [])[0]


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("just words", "just words"),
        ("a < b &amp;&nbsp;c &#8364; &eacute; &bogus; <3", "a < b & c € é &bogus; <3"),
        ("<p>one<p>two <b>th</b>ree<br>four", "one two three four"),
        ("<div>a<!-- <p>not me</p> -->b</div><!-- open", "ab"),
        ("<p>x</p><script>if (a < b) '</p>'</script><style>p{}</style><p>y</p>", "x y"),
        ("<p title='a > b' data-x=\"<p>\">attributes</p>", "attributes"),
        ("<ul><li>one<li>two</ul>", "one two"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("</p></div><p>stray ends</p></article>", "stray ends"),
        ("<TITLE>not the text</TITLE><P>UPPER</P>", "UPPER"),
        ("<p>a <span hidden>gone <span>too</span> gone</span>b</p>", "a b"),
        ("<p>shown</p><div style='display: none'><p>hidden</p></div>", "shown"),
        ("<p>  wide space \n\t here </p>", "wide space here"),
    ],
)
def test_small_pages(html, text):
    assert body(html) == text


ARTICLE = f"<h1>Headline</h1><p>{PROSE}</p><p>{PROSE}<b>bold</b> end</p>"
WANTED = " ".join(["Headline", PROSE.strip(), PROSE + "bold end"])


@pytest.mark.parametrize(
    "around",
    [
        "<nav><a href=/>Home</a></nav><article>{}</article><footer>&copy; us</footer>",
        "<div id='page' class='has-sidebar'><div class='site-header'><p>The Site</p></div><div class='main'>{}</div><div class=sidebar><p>Side text of the page, quite long, no doubt about it.</p></div></div>",
        "<div class=cookie-notice><p>We use cookies, and you should agree to them all.</p></div><main>{}</main>",
        "<main>{}<section id=comments><article class=comment><p>First reader says a lot of things, more than one would like to read, really.</p></article></section></main>",
        "<article>{}<form action=/go><label>Mail</label><input name=m><p>Write to us</p></form><aside><p>Aside</p></aside></article>",
        "<form id=aspnet><div role=navigation>menu</div><div class=text>{}</div></form>",
        "<table><tr><td><ul class=menu><li><a href=a>One</a></ul><td>{}</table>",
        "<div role='banner'><h2>Brand</h2></div><div class='adBox'>Buy now</div>{}<div class='advert-2'>Buy more</div>",
        "<article>{}<div class='share-buttons'><a href=x>Share</a></div><button>Like</button><div class=related-posts><p>Another story, with many words in its teaser line.</p></div></article>",
    ],
)
def test_layouts(around):
    assert body("<!DOCTYPE html><html><head><title>T</title></head><body>" + around.format(ARTICLE) + "</body></html>") == WANTED


def test_header_of_an_article_gives_its_headings():
    assert body(f"<article><header><h1>Head</h1><p>by someone</p></header><p>{PROSE}</p></article>") == "Head " + PROSE.strip()


def test_a_host_outvotes_a_page(spark):
    long = PROSE * 5
    normal = f"<div class='c-12 x'><h1>T</h1><p>{long}</p></div><div class=talk><p>short talk</p></div>"
    odd = f"<div class='c-7'><h1>T</h1><p>{PROSE}</p></div><div class=talk><p>{long}</p><p>{long}</p></div>"
    rows = [(i, f"https://H.example:80/{i}", normal) for i in range(9)] + [(9, "http://u:p@h.example?q", odd), (10, "http://other.example/", odd), (11, None, odd), (12, "nonsense", odd)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = {r.host: r.paths for r in winning_paths(pages).collect()}
    assert votes["h.example"][0] == "div.c-#" and set(votes) == {"h.example", "other.example"}
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert got[9].text == "T " + PROSE.strip() and got[9].path == "div.c-#"
    for i in (10, 11, 12):
        # left to itself the page takes the talk for its text
        assert got[i].text == " ".join(["T", PROSE.strip(), long.strip(), long.strip()]) and got[i].path == ""


def test_joined_by_shuffle_gives_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF01}/pages.parquet").withColumn("url", F.when(F.col("page_id") % 5 > 0, F.col("url")))
    want = sorted(extract_pages(pages).collect())
    monkeypatch.setattr(extraction, "small_side", lambda t: t.hint("merge"))
    assert sorted(extract_pages(pages).collect()) == want


def test_edges(spark):
    rows = [(1, None, None, 1, "x"), (1, None, None, 1, "x"), (None, "http://a.example/", "<p>no id", 1, "x"), (3, "http://a.example/", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, HTML int, Url string")
    assert sorted((str(r.page_id), r.text) for r in extract_pages(pages).collect()) == [("1", ""), ("1", ""), ("3", ""), ("None", "no id")]
    assert extract_pages(pages.limit(0)).count() == 0


def test_long_and_deep_pages():
    n = 50_000
    assert body(f"<p>{PROSE * n}</p>") == (PROSE * n).strip()
    assert body("<div>" * n + "deep" + "</div>" * 10) == "deep"
    assert body("<p>a" * n) == " ".join(["a"] * n)
    assert Page("<span class=x>" * n + "inline").best()[0] == 0

import pytest

from millrace.llm import op09_html as html
from millrace.llm.op09_html import extract, main_text

LONG = "This is a sentence of the story, with a comma or two, and enough words to count as text."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}<style>p{{a:b}}</style><script>var x='</p>';</script></head><body>{body}</body></html>"


ARTICLE = f"<h1>Head &amp; line</h1><p>{LONG}</p><p><b>{LONG}</b></p>"
EXPECTED = f"Head & line {LONG} {LONG}"


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><ul><li><a href='/a'>A</a></li></ul></nav><article>{ARTICLE}</article><footer>foot &copy;</footer>",
        f"<div class='ad'>{LONG}</div><article>{ARTICLE}</article><div id='comments'><p>{LONG}</p><p>{LONG}</p></div>",
        f"<header>Site, name</header><main>{ARTICLE}<form><p>{LONG}</p><button>Go</button></form></main><aside><p>{LONG}</p></aside>",
        f"<div class='cookie-notice'><p>{LONG}</p></div><div class='content'>{ARTICLE}<div class='share-buttons'>Share</div></div><div class='sidebar'><p>{LONG}</p></div>",
        f"<div id='wrap'><div class='menu'><a>x</a></div><div class='post'>{ARTICLE}</div><div class='comment-list'><div class='comment'><p>{LONG} {LONG}</p></div></div></div>",
        f"<article><header><h1>Head &amp; line</h1><span>by someone</span></header><p>{LONG}<p>{LONG}<script>1<2</script><!-- no > --></article>",
        f"<div><article>{ARTICLE}<section class='comments'><p>{LONG}</p></section></article></div>",
        f"<article class='post has-comments'>{ARTICLE}</article><article class='comment'><p>{LONG}</p></article>",
        f"<div class='layout no-sidebar'><div class='main-nav'>x</div><div class='entry comments-open'>{ARTICLE}</div></div>",
        f"<div class='ad'>{ARTICLE}</div>",
        f"<table><tr><td><a href=#>l</a><td>{ARTICLE}</table><div hidden><p>{LONG}</p></div>",
    ],
)
def test_only_the_article_is_kept(body):
    assert extract(page(body)) == EXPECTED


def test_white_space_references_and_blocks():
    assert extract(f"<article><p>a\n\t b&nbsp;&#x41;&lt;i&gt; <i>c</i>d<br>e, {LONG}</p><ul><li>one<li>two</ul></article>") == f"a b A<i> cd e, {LONG} one two"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("<html><body></body></html>", ""), ("<p>only", "only"), ("no tags at all", "no tags at all"), ("<div", ""), ("<a href='x", ""), ("</p></div>x", "x")])
def test_odd_pages(html, text):
    assert extract(html) == text


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    assert extract(deep) == LONG
    many = "<article>" + "".join(f"<p>{LONG} {i}</p>" for i in range(2000)) + "</article>"
    assert extract(many).count(LONG) == 2000


def test_query_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", page(f"<article>{ARTICLE}</article>"), "x"), (None, None, "", "x")], "page_id long, url string, html string, text string")
    out = main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in out.collect()) == [("", 0), ("", 0), (EXPECTED, len(EXPECTED))]
    assert main_text(df.limit(0)).collect() == []


def test_scores_alone_find_the_article_of_all_pages():
    """The lists of elements and names only back up the scores: on the bundled pages they change nothing."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert all(html.extract(p) == html.extract_by_score(p) != "" for p in pages)


def test_scores_outweigh_links_and_short_blocks():
    """Plain divs without any telling name: link lists, a teaser box and the article."""
    article = " ".join(f"Sentence number {i}, with a comma, says something of its own." for i in range(12))
    menu = "".join(f'<div><a href="/{i}">Entry {i} of a long menu, with words</a></div>' for i in range(40))
    page = f"<body><div>{menu}</div><div><div><p>{article}</p><p>{article}</p></div><div><a href=x>{article}</a></div></div><div><p>Short, box.</p></div></body>"
    assert html.extract(page) == html.extract_by_score(page) == f"{article} {article}"


def test_rows_and_clashing_columns(spark):
    rows = [(1, "u", "<p>one</p>", "x", "y"), (1, "u", "<p>one</p>", "x", "y"), (None, None, None, "x", "y"), (2, "v", "", "x", "y")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, score string"))
    assert got.columns == ["page_id", "url", "score", "text", "n_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "u", "y", "one", 3)] * 2 + [(None, None, "y", "", 0), (2, "v", "y", "", 0)]))
    assert html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, score string").limit(0)).collect() == []

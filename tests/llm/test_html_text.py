import re
import time
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinlink.llm.html_text import extract, main_text, op1_html_main_text

P = "<p>This is a paragraph of the article that is long enough to count.</p>"
PARAGRAPH = "This is a paragraph of the article that is long enough to count."


def test_articles_of_the_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op1_html_main_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|<footer)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_density_alone_finds_the_same_texts(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])) == main_text(r["html"])


@pytest.mark.parametrize("html, text", [
    (f"<body><div class='top-menu'><a href=x>Home</a></div><div><h1>Title</h1>{P}{P}</div><div id=comments>{P}</div></body>", f"Title\n{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<div class=\"cookie-notice\">We use cookies.</div><main><section>{P}</section><section>{P}</section></main><footer>{P}</footer>", f"{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<article>{P}<aside>{P}</aside><form>{P}</form><script>x='</p>'</script><style>p{{}}</style>{P}</article>", f"{PARAGRAPH}\n{PARAGRAPH}"),
    ("<p>a &amp; b&nbsp;&eacute; &#x41;<br>next\n  line <b>bo</b>ld", "a & b é A next line bold"),
    (f"<ul>{''.join(f'<li><a href=/{i}>link {i}</a>' for i in range(30))}</ul><div>{P}{P}</div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<body><div id='header'><h2>My site</h2>Welcome</div><h1>Title</h1><div class='text'>{P}{P}{P}</div><div id=sideBar>{P}</div><ol class=commentlist><li>{P}</ol></body>", "Title\n" + "\n".join([PARAGRAPH] * 3)),
    (f"<body><form id=aspnet><div class='content with-sidebar'>{P}{P}{P}</div><div class=promo>{P}</div></form></body>", "\n".join([PARAGRAPH] * 3)),
    (f"<article><header><h1>Title</h1></header>{P}<div hidden>{P}</div><section id=comments><article class=comment>{P}</article></section></article>", f"Title\n{PARAGRAPH}"),
    ("no tags at all", "no tags at all"), ("", ""), (None, ""), ("<!-- only -->", ""), ("<p title='unclosed>x", "x"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
])
def test_pages(html, text):
    assert main_text(html) == text


def test_depth_and_length():
    assert main_text("<div>" * 20000 + "deep") == "deep"
    assert main_text(f"<article>{P * 5000}</article>") == "\n".join([PARAGRAPH] * 5000)


def test_parts_go_whatever_they_hold():
    long = P * 20
    for name in ("class=comments", "id='article-comments'", "class='comment-list wide'", "class=sidebar", "class='top-ad'"):
        assert main_text(f"<body><div class=text><h1>Title</h1>{P}{P}</div><div {name}>{long}</div></body>") == f"Title\n{PARAGRAPH}\n{PARAGRAPH}"
    # Names that tell of the layout, and wrappers of the page's title, stay.
    for name in ("class='has-comments'", "class='post with-sidebar'", "class='sidebar-right'"):
        assert main_text(f"<body><div {name}><h1>Title</h1>{P}{P}</div></body>") == f"Title\n{PARAGRAPH}\n{PARAGRAPH}"


def test_unclosed_embedded_parts_take_nothing_with_them():
    for name in ("object", "video", "audio", "canvas", "svg", "noscript", "iframe"):
        assert main_text(f"{P}<{name} a=b>{P}") == f"{PARAGRAPH}\n{PARAGRAPH}"
    assert main_text(f"{P}<script>{P}") == PARAGRAPH


def test_time_is_linear_in_depth():
    t = time.perf_counter()
    main_text("<div><b></i>" * 60_000 + "deep" + "<object>x" * 60_000)
    assert time.perf_counter() - t < 20


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href='", "'>", "</a>", "<b", ">", "text ", "&amp;", "<!--", "-->", "<script>", "</script>", "<li>", "</ul>", "<", '"']), max_size=25))
def test_any_markup_is_survived(parts):
    assert isinstance(main_text("".join(parts)), str)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", P, 2), (2, "u", "", 3), (2, "u", "", 3)], "page_id bigint, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"]) for r in extract(df).collect()) == [(0, PARAGRAPH), (1, ""), (2, ""), (2, "")]
    assert extract(df.limit(0)).count() == 0

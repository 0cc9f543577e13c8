import html
import re

import pytest

from tests.llm.helpers import SF
from tracelode.llm import html_extract as H
from tracelode.llm.common import table

P = "A sentence of some length that tells a story, with commas, and goes on for a while until it ends. "


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


MENU = "<nav><ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(8)) + "</ul></nav>"
FOOT = "<footer>&copy; somebody &middot; all rights</footer>"


def test_whole_table(spark):
    """Against a plain reading of the one article of each page."""
    for r, (text, _) in ((r, H.extract(r["html"])) for r in table(spark, SF, "pages").collect()):
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|blockquote|pre)[^>]*>", inside)
        parts = [" ".join(html.unescape(re.sub("<br[^>]*>", " ", p)).split()) if "<" not in re.sub("<br[^>]*>", " ", p) else " ".join(html.unescape(re.sub("<[^>]+>", "", re.sub("<br[^>]*>", " ", p))).split()) for p in parts]
        assert text == "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize(
    "body",
    [
        f"{MENU}<article><h1>Title</h1><p>{P * 3}</p><p>{P * 2}</p></article>{FOOT}",
        f"{MENU}<div id='main-content'><h1>Title</h1><p>{P * 3}</p><p>{P * 2}</p><div class='share'>Share <a>this</a></div></div><div class='sidebar'><p>{P}</p></div>{FOOT}",
        f"<div class='cookie-notice'>We use cookies. {P}</div>{MENU}<main><h1>Title</h1><p>{P * 3}<p>{P * 2}</main><section class='comments'><p>{P}</p></section>",
        f"<header><h1>Site</h1></header><div class='wrap'><div class='post'><h1>Title</h1><p>{P * 3}</p><form><input><p>{P}</p></form><p>{P * 2}</p></div></div><aside>{P}</aside>",
    ],
)
def test_templates(body):
    assert H.extract(page(body))[0] == f"Title\n\n{(P * 3).strip()}\n\n{(P * 2).strip()}"


def test_references_and_white_space():
    text, n = H.extract(page(f"<article><p>a &amp;&lt;b&gt; &#233;\n\t &nbsp; c<br>d {P}</p><pre>x\n  y {P}</pre></article>"))
    assert text == f"a &<b> é c d {P.strip()}\n\nx y {P.strip()}" and n == 2


@pytest.mark.parametrize("source", [None, "", "   ", "<p>", "<html><body>", page(MENU), "<!-- only -->", "<script>x</script>"])
def test_nothing(source):
    assert H.extract(source)[0] == ""


def test_broken_pages():
    assert H.extract("just text")[0] == "just text"
    assert H.extract("<div><p>one two three")[0] == "one two three"
    assert H.extract("<table><tr><td>a<td>b<tr><td>c</table>")[0].split("\n\n") == ["a", "b", "c"]
    deep = "<div>" * 3000 + P + "</div>" * 3000
    assert H.extract(deep)[0] == P.strip()
    assert len(H.extract(page("<article>" + f"<p>{P}</p>" * 3000 + "</article>"))[0]) == 3000 * len(P.strip()) + 2 * 2999


def test_rows(spark):
    rows = [(1, None, None), (None, "u", page(f"<article><p>{P}</p></article>")), (3, "v", ""), (3, "v", "")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text long")
    got = sorted(H.extract_pages(pages).collect(), key=str)
    assert len(got) == 4 and {r["n_chars"] for r in got} == {0, len(P.strip())}
    assert H.extract_pages(pages.limit(0)).count() == 0


def test_smoothing_and_threshold():
    assert H.smooth([1.0] * 5) == pytest.approx([1.0] * 5)
    bumps = H.smooth([0, 0, 9, 0, 0])
    assert bumps[2] == max(bumps) and bumps[1] == pytest.approx(bumps[3])
    assert 1 < H.threshold([1, 1, 1, 5, 5]) < 5 and H.threshold([3.0]) == 3.0 and H.threshold([3.0, 3.1, 3.2]) == 3.0


def test_nothing_of_the_article_is_dropped():
    p = lambda w, n: "".join(f"<p>{w}{i} {'several words of running text ' * 8}</p>" for i in range(n))
    foot = "<footer><p>imprint</p></footer>"
    for page, last in (
        (f"<body><div><div>{p('a', 19)}</div><div>{p('b', 1)}</div></div>{foot}</body>", "b0"),
        (f"<body><main><article>{p('a', 6)}</article><article>{p('b', 4)}</article></main>{foot}</body>", "b3"),
        (f"<body><article>{p('a', 6)}</article><article>{p('b', 4)}</article>{foot}</body>", "b3"),
        (f"<body><p>short start</p>{p('a', 6)}<p>short</p>{p('b', 4)}<p>short end</p>{foot}</body>", "short end"),
        (f"<body><div>{p('a', 19)}</div><div>{p('b', 1)}</div>{foot}</body>", "b0"),
    ):
        text, blocks = H.extract(page)
        assert blocks == page.count("<p>") - 1 and text.split("\n\n")[-1].startswith(last) and "imprint" not in text


@pytest.mark.parametrize("name", ["has-sidebar", "with-sidebar", "sidebar-right", "comments-open", "no-footer", "page has-nav"])
def test_names_that_only_mention_furniture(name):
    body = f"<div class='{name}'>{MENU}<div><h1>Title</h1><p>{P * 3}</p><p>{P * 2}</p></div><div class='sidebar'>{P}</div></div>{FOOT}"
    assert H.extract(page(body))[0] == f"Title\n\n{(P * 3).strip()}\n\n{(P * 2).strip()}"
    assert H.extract(page(f"<form class='{name}'>{body}</form>"))[0] == f"Title\n\n{(P * 3).strip()}\n\n{(P * 2).strip()}"


def teasers(n, long=()):
    return "".join(f"<div><a href='/{i}'>read this</a> {P[:64] if i in long else 'by X'}</div>" for i in range(n))


PLAIN = f"<div>{teasers(12, (5,))}</div><div><h2>Title</h2><p>{P * 3}</p><p>Short.</p><p>{P * 2}</p></div><div>{teasers(12)}</div>"
WANT = f"Title\n\n{(P * 3).strip()}\n\nShort.\n\n{(P * 2).strip()}"


def test_ratios_smoothing_and_clusters_select(monkeypatch):
    """A page without any name, role or tag of meaning: only its ratios tell the article from lists of links, one of which is long."""
    assert H.extract(page(PLAIN))[0] == WANT
    with monkeypatch.context() as m:
        m.setattr(H, "smooth", lambda values, sigma=0: values)
        assert H.extract(page(PLAIN))[0] != WANT
    with monkeypatch.context() as m:
        m.setattr(H, "threshold", min)
        assert H.extract(page(PLAIN))[0] != WANT


def test_an_article_around_the_region_widens_it():
    body = f"<div>{teasers(9)}</div><main><article><h1>Title</h1><p>Short.</p><div><p>{P * 3}</p><p>{P * 2}</p></div><p>End.</p></article><div>{teasers(3)}</div></main>"
    assert H.extract(page(body))[0] == f"Title\n\nShort.\n\n{(P * 3).strip()}\n\n{(P * 2).strip()}\n\nEnd."


def test_nesting_takes_time_in_proportion():
    import time

    def took(tag, n):
        html = page(f"<{tag}>" * n + P + f"</{tag}>" * n)
        begin = time.perf_counter()
        assert H.extract(html)[0] == P.strip()
        return time.perf_counter() - begin

    for tag in ("div", "center", "section", "blockquote"):
        took(tag, 100)
        assert took(tag, 20_000) < 12 * max(0.05, took(tag, 5_000))

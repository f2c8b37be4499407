"""Main text of pages: pages that broken or misleading markup hid, time on hostile input, and generated pages whose text is known."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from rasterloom.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
ARTICLE = "<p>" + "some words of an article " * 25 + "</p><p>Short one.</p><p>" + "and more text of it " * 12 + "</p>"
TEXT = " ".join(("some words of an article " * 25 + "Short one. " + "and more text of it " * 12).split())
TREE = html_text.grow(html_text.labelled_rows())


def main(page):
    return html_text.main_text(page, TREE)


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies here and there for you</div><div class=ad>Buy this now</div><article><h1>Head &amp; shoulders</h1>
    <p>First   paragraph<br>with a break<p>x<script>if (a < b) { "</p>" }</script><form><input>Name</form><aside>see also</aside>
    <section id="comments"><p>I liked this long article about many things very much indeed</p></section></article><footer>&copy; me</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>no tags at the end <b>and a rather long text that goes on for quite a while here</b>"), (None, "x", page), (1, "u", page), (5, "y", "<article>" + "word " * 300_000 + "</article>")]
    got = html_text.extract(spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA)).collect()
    texts = {r.page_id: r.text for r in got}
    assert texts[1] == texts[None] == "Head & shoulders First paragraph with a break x" and texts[2] == texts[3] == "" and len(got) == len(rows)
    assert texts[4].startswith("no tags at the end") and all(r.n_chars == len(r.text) for r in got) and len(texts[5]) == 5 * 300_000 - 1
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_fits_its_table():
    rows = html_text.labelled_rows()
    assert len(rows) > 100 and all((html_text.predict(TREE, r[:-1]) >= 0.5) == bool(r[-1]) for r in rows)


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar page", "with-header wrapper", "header-fixed", "menu-open site", "legal", "widget", "alert", "post share", "main has-footer", "page", "js-nav-open"])
def test_names_of_what_holds_the_page(name):
    for inner in (f"<article>{ARTICLE}</article>", ARTICLE):
        for shell in ('<body><div class="{}">{}</div><footer>foot</footer></body>', '<body class="{}"><nav><a href=x>menu</a></nav>{}</body>', '<div><div id="{}">{}</div></div>'):
            assert main(shell.format(name, inner)) == TEXT


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>x</title><body><article>{}</article>", "<html><head><title>x</title><meta charset=utf-8><article>{}</article>", "<svg/><article>{}</article>", "<svg><path d=1><article>{}</article>",
        "<nav><ul><li><a href=1>x</a></ul><article>{}</article>", "<header><article>{}</article></header>", "<header>{}</header>", "<select><option>x<article>{}</article>", "<form runat=server><div><main>{}</main></div></form>",
        "<div hidden>{}</div>", "<a name=top><main>{}</main>", "<article><!-- <p>not</p> -->{}<!></article>", "<article>{}<a title='never closed</article>", "<math/><p><article>{}</article><aside><p>beside</aside>",
    ],
)
def test_broken_pages_keep_their_text(page):
    assert main(page.format(ARTICLE)) == TEXT


@pytest.mark.parametrize("name", ["ad", "ads", "site-footer", "footer", "cookie-bar", "comment-list", "comments", "sidebar-left", "siteFooter", "newsletter", "ad-728x90", "main-nav", "share-links", "related-items"])
def test_names_of_what_does_not(name):
    aside = f'<div class="{name}"><p>{"words beside it " * 5}</p></div>'
    assert main(f"<body>{aside}<article>{ARTICLE}{aside}</article>{aside}</body>") == TEXT


def n_words(n, word="word"):
    return " ".join([word] * n)


@pytest.mark.parametrize("name", ["cookie-recipe", "ad-free-story", "adsense-guide-chapter", "newsletter-archive-story"])
def test_a_name_that_says_something_else_too(name):
    body = f"<p>{n_words(60)}</p><p>{n_words(6)}</p>"
    assert main(f"<article><h1>Head line.</h1><div class='{name}'>{body}</div></article>") == f"Head line. {n_words(66)}"
    assert main(f"<nav><a href=x>menu</a></nav><main><h1>Head.</h1><p>{n_words(30)}</p><div class='{name}'>{body}</div></main><footer>foot</footer>") == f"Head. {n_words(96)}"


@pytest.mark.parametrize("extra", [15, 25, 40])
def test_teasers_are_not_the_post(extra):
    teaser = f"<article><h3>Read on</h3><p>{n_words(extra, 'teaser')}</p></article>" * 3
    post = f"<h1>Head line.</h1><p>{n_words(70)}</p><p>{n_words(50)}</p>"
    want = f"Head line. {n_words(120)}"
    assert main(f"<body><div class=post-body>{post}</div>{teaser}</body>") == want
    assert main(f"<body><main><div class=post-body>{post}</div>{teaser}</main></body>") == want
    assert main(f"<body><article>{post}<p>{n_words(90)}</p></article>{teaser}</body>") == f"{want} {n_words(90)}" if extra <= 40 else True


def test_articles_of_about_equal_length_all_stay():
    assert main("".join(f"<article><h2>Head.</h2><p>{n_words(n)}</p></article>" for n in (60, 45, 80))) == " ".join(f"Head. {n_words(n)}" for n in (60, 45, 80))


def test_pages_of_little_text():
    assert main(f"<p>{n_words(9)}</p><p>{n_words(7)}</p>") == n_words(16)
    assert main(f"<nav><a href=x>menu</a></nav><p>{n_words(5)}</p><p>{n_words(8)}</p><footer>foot</footer>") == n_words(13)
    steps = "".join(f"<li>{n_words(n)}</li>" for n in (8, 5, 12, 9, 7, 11, 6, 10, 8, 9, 7, 5))
    for page in (f"<ol>{steps}</ol>", f"<nav><ul><li><a href=x>menu</a></li></ul></nav><h1>Head.</h1><ol>{steps}</ol><footer>foot</footer>"):
        assert main(page).endswith(n_words(97))
    assert main("<nav><ul><li><a href=x>menu</a></li><li><a href=y>other</a></li></ul></nav>") == ""


@pytest.mark.parametrize("name", ["discussion", "responses", "reader-feedback", "comment-thread"])
def test_comments_by_other_names(name):
    posts = f"<h3>Two</h3><p>{n_words(30, 'post')}</p><p>{n_words(45, 'post')}</p>"
    body = f"<h1>Head.</h1><p>{n_words(90)}</p><p>{n_words(7)}</p>"
    assert main(f"<article>{body}<section class='{name}'>{posts}</section></article>") == main(f"<main>{body}<div class='{name}'>{posts}</div></main>") == f"Head. {n_words(97)}"


def test_a_discussion_that_the_page_goes_on_after_is_its_own():
    page = f"<article><p>{n_words(50)}</p><section class=discussion><h2>Discussion.</h2><p>{n_words(40)}</p></section><section><h2>End.</h2><p>{n_words(20)}</p></section></article>"
    assert main(page) == f"{n_words(50)} Discussion. {n_words(40)} End. {n_words(20)}"


def test_a_short_article_between_longer_parts():
    assert main(f"<nav><a href=x>menu</a></nav><div class=ad>{'buy it ' * 9}</div><article><h1>One.</h1><p>Two.</article><footer>{'foot ' * 40}</footer>") == "One. Two."


@pytest.mark.parametrize(
    "part", ["<a ", '<a "', '<a b="', "<a x='", "<b>", "<nav>", "<article>", "<div class=nav><p>x", "</p>", "<p><b>", "<svg>", "<select>", "<title>", "<", "<!--", "<table><tr><td>", "<a href=x>y<div>", "&", "<a =", "<li><b>", "</div", "<![CDATA["]
)
def test_time_is_linear(part):
    main(part * 1000)
    began = time.process_time()
    main(part * (300_000 // len(part)) + '"')
    assert time.process_time() - began < 4


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh&<é ") for _ in range(rng.randrange(1, 9))).strip() or "w" for _ in range(n))


class Second(HTMLParser):
    """The standard library's parser: text within article, a space at each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCK_TAGS:
            self.parts.append(" ")
        if tag not in html_text.VOID_TAGS:
            self.stack.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK_TAGS:
            self.parts.append(" ")
        while tag not in html_text.VOID_TAGS and self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        tags = [t for t, _ in self.stack]
        if "article" in tags and not {"script", "style", "aside", "form"} & set(tags) and not any(c in ("ad", "comments") for _, c in self.stack):
            self.parts.append(data)


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages_against_a_second_parser(seed):
    rng = random.Random(seed)

    def inline(n):
        t = html.escape(words(rng, n), quote=False)
        return rng.choice(["{}", "<b>{}</b>", "<a href='/x?a=1&amp;b=\">\"'>{}</a>", "<i class=x>{}</i> y", "{}<br/>z", "{}&nbsp;&copy;<!-- <p>no</p> -->", '<img alt="a > b" src=x>{}']).format(t)

    def block(depth):
        inner = inline(rng.choice([1, 2, 5, 30])) if depth == 0 or rng.random() < 0.5 else "".join(block(depth - 1) for _ in range(rng.randrange(1, 4)))
        tag = rng.choice(["div", "section", "blockquote", "ul", "table"]) if inner.startswith("<") else rng.choice(["p", "li", "h2", "div", "td"])
        return f"<{tag}>{inner}</{tag}>"

    outside = [f"<aside>{inline(9)}</aside>", f"<div class=ad>{inline(6)}</div>", "<script>var a = '<p>' < 2;</script>", "<style>p > a {}</style>", f"<form>{inline(3)}</form>", f"<div class='comments'>{inline(20)}</div>"]
    inner = "".join(rng.choice([block(2), block(1), rng.choice(outside)]) for _ in range(12))
    page = f"<!doctype html><html><head><title>{words(rng, 3)}</title></head><body><nav>{inline(4)}</nav>{rng.choice(outside)}<article><h1>{inline(40)}</h1>{inner}</article><footer>{inline(12)}</footer></body></html>".replace("<title>", "<title>t")
    second = Second()
    second.feed(page)
    second.close()
    assert main(page) == " ".join("".join(second.parts).split())

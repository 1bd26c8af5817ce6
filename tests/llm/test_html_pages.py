"""HTML extraction on pages built from known parts: what was put in as the article must come out, and nothing else."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plumbline.llm import html_text

SIDE = "Buy our things today and tell all your friends about the things that we sell here every single day. " * 5
CLASSES = ["left-sidebar", "newsletter-signup", "ad-container", "ad-slot", "cookie-banner-wrapper", "user-comments", "site-navigation-wrapper", "related-posts"]


@pytest.mark.parametrize("name", CLASSES)
@pytest.mark.parametrize("holder", ["main", "article"])
@pytest.mark.parametrize("body", ["Short but real article.", "A long article that goes on for quite a while about one thing. " * 20])
def test_boilerplate_beside_the_article(name, holder, body):
    body = body.strip()
    beside = f'<div class="{name}"><p>{SIDE}</p></div>'
    for page in (f"{beside}<{holder}><p>{body}</p></{holder}>", f"<{holder}><p>{body}</p></{holder}>{beside}", f"<{holder}><p>{body}</p>{beside}</{holder}>"):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == body


@pytest.mark.parametrize("name", [*CLASSES, "comment-list"])
def test_boilerplate_on_a_page_without_article(name):
    page = f'<div class="post"><h2>Head</h2><p>One real paragraph of the page.</p><p>Two.</p></div><div class="{name}"><p>{SIDE}</p></div>'
    assert html_text.main_text(page) == "Head\nOne real paragraph of the page.\nTwo."


@pytest.mark.parametrize("attr", [
    'class="has-sidebar"', 'class="with-comments"', 'id="comments-open"', 'class="ad-free-zone"', 'class="no-ads"', 'id="header-image"', 'class="notice-period"', 'id="social-history"'])
def test_states_and_other_compounds_stay(attr):
    assert html_text.main_text(f"<div {attr}><p>One real paragraph.</p><p>Two.</p></div>") in ("One real paragraph.\nTwo.",)


def test_headings_with_such_names_stay():
    page = '<article><h2 id="related-work">Related work</h2><p>Text of it.</p><h3 class="cookie-law">Cookie law</h3><p>More.</p></article>'
    assert html_text.main_text(page) == "Related work\nText of it.\nCookie law\nMore."


def test_comments_marked_as_articles():
    page = '<article><p>The article.</p><section><article class="comment"><p>A reader says this.</p></article></section></article><article class="comment-open"><p>Second.</p></article>'
    assert html_text.main_text(page) == "The article.\nSecond."


def test_nothing_left_without_compounds():
    assert html_text.main_text('<div class="comment-page"><p>All there is.</p></div>') == "All there is."


def test_link_lists_are_not_content():
    links = "".join(f'<li><a href="/{k}">A fairly long link text number {k} to another page</a></li>' for k in range(12))
    text = "".join(f"<p>Paragraph {k} of the text, without any link, of some length.</p>" for k in range(6))
    page = f"<div><ul>{links}</ul></div><div>{text}</div>"
    assert html_text.main_text(page) == "\n".join(f"Paragraph {k} of the text, without any link, of some length." for k in range(6))


@pytest.mark.parametrize("odd,text", [
    ("<p>a</p><![foo[x]]><p>b</p>", "a\nb"), ("<p>a</p><![CDATA[x]]><p>b</p>", "a\nb"), ("<p>a</p><!foo bar><p>b</p>", "a\nb"), ("<p>a</p><!DOCTYPE [<!x]><p>b</p>", "a\nb"),
    ("<p>a</p><!-- x", "a"), ("<p>a</p><!x", "a"), ("<p>a</p><![x", "a"), ("<p>a</p><div class='x", "a"), ("<p>a</p><?php x", "a"), ("<p>a</p></di", "a"),
    ("<p>a &lt; b", "a < b"), ("<p>a &am", "a &am"), ("<p>1 < 2</p>", "1 < 2"), ("<p>a<", "a<"), ("<![", ""), ("<", "<"), ("<!>x", "x")])
def test_odd_markup(odd, text):
    assert html_text.main_text(odd) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([
    "<", ">", "<!", "<![", "]]>", "<!--", "-->", "<p", "<p>", "</p>", "<div class='ad-slot'>", "</div>", "<table><tr><td>", "</table>", "<main>", "</main>", "<article>", "</article>",
    "<script>", "</script>", "<a href=x>", "</a>", "&amp;", "&#", "&#x110000;", "&#0;", "text", " ", "\n", "\"", "'", "=", "<?", "?>", "\x00", "é", "<h1>", "<li>", "<svg>", "</body>", "[", "CDATA["]), max_size=40))
def test_no_markup_ends_the_job(parts):
    text = html_text.main_text("".join(parts))
    assert isinstance(text, str) and "\n\n" not in text


def test_pages_the_parser_refuses(monkeypatch):
    def refuse(*_):
        raise AssertionError("no")

    monkeypatch.setattr(html_text.LineReader, "feed", refuse)
    assert html_text.main_text("<p>a &amp; b</p><div>c") == "a & b\nc"


WORDS = "river house winter market people village bridge garden letter morning".split()


def sentence(rng, n):
    return (" ".join(rng.choice(WORDS) for _ in range(n)) + ".").capitalize()


def page_of(rng, holder):
    """A page and its main text: an article of headings, paragraphs, lists, with boilerplate inside and around it."""
    junk = lambda: f'<{t}{a}>{"".join(f"<p>{sentence(rng, rng.randint(3, 60))}</p>" for _ in range(rng.randint(1, 4)))}</{t}>' if (
        (t := rng.choice(["div", "section", "aside", "nav"])) and (a := f' class="{rng.choice(CLASSES + ["ad", "sidebar widget", "comments"])}"')) else ""
    blocks, lines = [], []
    for _ in range(rng.randint(2, 9)):
        kind = rng.choice(["h2", "p", "p", "p", "ul", "blockquote", "junk"])
        if kind == "junk":
            blocks.append(junk())
        elif kind == "ul":
            items = [sentence(rng, rng.randint(4, 20)) for _ in range(3)]
            blocks.append("<ul>" + "".join(f"<li>{i}" + rng.choice(["", "</li>"]) for i in items) + "</ul>")
            lines += items
        else:
            text = sentence(rng, 4 if kind == "h2" else rng.randint(8, 80))
            blocks.append(f"<{kind}>{text.replace(' ', rng.choice([' ', chr(10) + '  ']), 1)}</{kind}>")
            lines.append(text)
    body = f"<{holder}>{''.join(blocks)}</{holder}>"
    around = [junk() for _ in range(rng.randint(0, 3))]
    at = rng.randint(0, len(around))
    return f"<!doctype html><html><head><title>T</title></head><body><header><h1>Site</h1></header>{''.join(around[:at])}{body}{''.join(around[at:])}<footer>F</footer></body></html>", "\n".join(lines)


@pytest.mark.parametrize("holder", ["article", "main"])
@pytest.mark.parametrize("seed", range(20))
def test_generated_pages(seed, holder):
    page, want = page_of(random.Random(seed), holder)
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("seed", range(20))
def test_generated_pages_without_article(seed):
    page, want = page_of(random.Random(100 + seed), 'div class="post"')
    assert html_text.main_text(page.replace('</div class="post">', "</div>")) == want

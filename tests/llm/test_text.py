"""Chat formatting and HTML extraction against plain recomputations."""

import hashlib
import html as html_module
import re

import pytest
from plumbline.llm import chat_format, html_text, queries

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check_chat(spark, rows):
    got = chat_format.read_back(chat_format.format_conversations(rows, queries.tokenizer_path())).collect()
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert len(got) == len(want)
    for g in got:
        turns = want[g.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))


def test_chat_round_trip(spark):
    check_chat(spark, spark.read.parquet(f"{SF}/conversations.parquet"))


def test_chat_edge_cases(spark):
    said = [
        "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\<|end|>\\\\", "a\\", " leading and trailing \n", "", None, "日本語 é🙂" * 3,
        "<<SYS>>[[INST]]<<s>s>", "x" * 5000, "\x00\x0b ",
    ]
    rows = [(c, t, role, text) for c, role in ((1, "assistant"), (None, "user")) for t, text in enumerate(said)]
    rows += [(2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, None, "z"), (3, 0, "us<|text|>er", "b"), (3, 1, "assistant", "c")]
    check_chat(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_conversations(empty, queries.tokenizer_path())).count() == 0


def test_chat_segments(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", 50)
    check_chat(spark, spark.read.parquet(f"{SF}/conversations.parquet"))


ODD_TEXTS = ["", "plain words and more.", "日本語 é🙂 ñ" * 5, "\u200d🙂\u0301 x", "a\n\n  b\t c", "\x00\x0b ", "don't 123456 'll", "🙂" * 40, " " * 300 + "x"]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_chat_encoders_agree(text):
    """Token ids and spans of the fast encoder are those of tokenizers."""
    rendered, _ = chat_format.render([("user", text), ("assistant", text + "<|end|>"), ("", text)])
    slow, fast = (chat_format.span_encoder(queries.tokenizer_path(name))(rendered) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    for a, b in zip(slow, fast):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize("waiting", [0, 8])
def test_chat_hot_conversation(spark, monkeypatch, waiting):
    """A third of all turns in one conversation: several tasks format it, and it reads back whole."""
    monkeypatch.setattr(chat_format, "MOST_WAITING", waiting)
    monkeypatch.setattr(chat_format, "SEGMENT_CHARS", 400)
    rows = [(7 if i % 3 == 0 else i // 12, i, ("user", "assistant")[i % 2], f"turn {i} says é \\ <s> " * (i % 4)) for i in range(900)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    formatted = chat_format.format_conversations(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be joined to one partition
    try:
        assert formatted.where("conv_id = 7").select("part").distinct().count() > 1
        check_chat(spark, docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text", ["", "\\", "<|end|>", "<s>", "\\<s>", "<\\s>", "[INST][/INST]", "<<s>", "a\\b"])
def test_escape_is_reversible(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROL)


def test_html_against_article_blocks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html_module.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><div class="cookie-notice">We use cookies</div>
<div id="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="post"><h2>Head &amp; line</h2><p>First long paragraph of the page with many words in it.
<p>Second   <i>long</i> paragraph of the page,<br>also with many words in it.</p><p>No.</p><script>var x = "</p>";</script></div>
<div class="comments"><p>Reader comment that is as long as any paragraph of the page.</p></div><form><p>Mail</p></form><footer>F</footer>"""


def test_html_without_article():
    assert html_text.main_text(PAGE) == (
        "Head & line\nFirst long paragraph of the page with many words in it.\n"
        "Second long paragraph of the page, also with many words in it.\nNo.")


def test_html_edge_cases(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "<p>x"), (2, "u", "plain"), (3, "u", "<nav>only menu</nav>"), (4, "u", "<article>" + "<p>ab</p>" * 3000)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got[:5]] == ["", "", "x", "plain", ""]
    assert got[5].n_chars == 3000 * 3 - 1


@pytest.mark.parametrize("skipped", [
    '<p class="notice">Notice.', '<ul><li class="ad">Ad.</ul>', '<ul><li>Item.<li class="ad">Ad.</ul>', '<dl><dt class="ad">Ad.<dd>Item.</dl>',
    '<div><p class="ad">Ad.</div>', '<div><span class="ad">Ad.</div>', '<table><tr class="ad"><td>Ad.<tr><td>Item.</table>', '<p><a class="ad">Ad.<p>',
    '<table><tr><td class="ad">Ad.<td>Item.</table>', '<div class="ad"><div><p>Ad.</div><p>Ad.</div>', '<p class="ad">Ad.<p class="ad">Ad.',
])
@pytest.mark.parametrize("start,end", [("<article>", "</article>"), ("", "")])
def test_html_skip_ends_with_its_element(skipped, start, end):
    text = html_text.main_text(f"<html><body>{skipped}{start}<p>One paragraph.</p><p>Two paragraphs.</p>{end}</body></html>")
    assert text.endswith("One paragraph.\nTwo paragraphs.") and "Ad." not in text and "Notice" not in text


def test_html_unclosed_head():
    assert html_text.main_text("<head><title>T</title><meta name=a><p>One.<p>Two.") == "One.\nTwo."


def test_html_skipped_span_ends_with_its_block():
    assert html_text.main_text('<article><div>One. <span class="ad">Ad.</div>Two. <b class="ad"><p>Ad.</p></b>Three.</article>') == "One.\nTwo. Three."


@pytest.mark.parametrize("page", [
    '<div id="content" class="has-sidebar"><h1>Head.</h1><p>Text.</p></div>', '<main class="with-sidebar"><h1>Head.</h1><p>Text.</p></main>',
    '<article class="post comments-open"><h1>Head.</h1><p>Text.</p></article>', '<article><h2 id="related-work">Head.</h2><p id="notice-period">Text.</p></article>',
    '<article><h3 id="social-history">Head.</h3><p>Text.</p></article>', '<article class="widget"><h2 class="header">Head.</h2><p>Text.</p></article>',
    '<div class="sidebar"><div class="ad">Ad.</div><div class="widget"><article><h2>Head.</h2><p>Text.</p></article></div></div>',
    '<div class="banner"><h1>Head.</h1><p>Text.</p></div>', '<article><p>Head.</p><figure><img><figcaption>Text.</figcaption></figure></article>',
])
def test_html_keeps_what_attributes_do_not_name(page):
    text = f"<body>{page}"
    assert html_text.main_text(text) == "Head.\nText."


@pytest.mark.parametrize("ad", [
    'class="box ad"', 'id="sidebar"', 'role="complementary"', 'class="cookie-notice"', 'class="nav_menu"', 'class="ad" hidden', "hidden", 'aria-hidden="true"'])
def test_html_skips_named_elements(ad):
    page = f"<article><p>One.</p><div {ad}><h3>Ad.</h3><p>Ad.</p></div><p>Two.</p></article>"
    assert html_text.main_text(page) == "One.\nTwo."
    assert html_text.main_text(f"<div hidden><div {ad}><h1>Ad.</h1></div></div><p>Two.</p>") == "Two."


@pytest.mark.parametrize("size", [20_000, 1_000_000])
@pytest.mark.parametrize("place", [0, 1, 2])
def test_html_one_very_long_paragraph(size, place):
    sections = [["w" * 300] * 20, ["v" * 300] * 20]
    sections.insert(place, ["x" * size])
    menu = "<div>" + "".join(f"<p><a href=x>Link {i}</a></p>" for i in range(10)) + "</div>"
    page = menu + "".join("<section>" + "".join(f"<p>{p}</p>" for p in ps) + "</section>" for ps in sections)
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join(p for ps in sections for p in ps)

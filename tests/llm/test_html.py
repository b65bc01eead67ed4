"""HTML extraction: what is marked goes, what is an article stays, both passes against a plain version, linear time."""

import random
import time

import pytest

from glyphspark.llm import html_extract as hx

EN = "The house that was on the hill is one of the oldest in the town and it was there for all of the time that we know of, as they say in the books that are on the shelf of the library by the river with the old bridge."
RU = "Старый дом стоял на холме над рекой, и каждый вечер в его окнах горел свет, который было видно далеко за городом."
HU = "A régi ház a dombon állt a folyó fölött, és minden este fény égett az ablakaiban, amelyet messziről is látni lehetett a város határából."
POOR = "kernel scheduler latency throughput buffers registers compiler opcode pipeline vector cache paging memory disk network socket packet router"


@pytest.mark.parametrize("name", "comment-body comment-content post-comments sidebar-content footer-text ad-content cookie-text newsletter-body commentlist commentList adbox cookiebar sidebarright siteFooter page-header main-nav topnav article-share widget_text".split())
def test_marked_elements_go_whatever_else_their_class_says(name):
    extra = f'<div class="{name}"><p>{EN} Extra.</p></div>'
    assert "Extra" not in hx.main_text(f"<article><p>{EN}</p></article>{extra}")
    assert "Extra" not in hx.main_text(f"<article><p>{EN}</p>{extra}<p>{EN}</p></article>")
    assert "Extra" not in hx.main_text(f"<body>{extra}<div><p>{EN}</p></div></body>")
    assert hx.main_text(f"<article><p>{EN}</p>{extra}</article>") == EN


@pytest.mark.parametrize("name", "content-with-sidebar has-sidebar entry-header article-header commentary headline story-body main-content no-comments addendum formatted".split())
def test_names_that_mark_nothing(name):
    assert hx.main_text(f'<div class="{name}"><p>{EN}</p></div>') == EN


@pytest.mark.parametrize("text", [RU, HU, EN])
def test_any_language_between_menus(text):
    page = f"<body><div><a href=1>Home page</a> <a href=2>All news</a></div><div>{text}</div><p>{text}</p><p>{text} {text}</p><div><a href=3>More of it</a></div></body>"
    assert hx.main_text(page).split("\n") == [text, text, f"{text} {text}"]


def test_recurring_words_take_the_place_of_stop_words():
    rng = random.Random(1)
    parts = [" ".join(rng.choice(["zum", "kel", "ot"]) + " " + "".join(rng.choice("bdgklmnprst") for _ in range(7)) for _ in range(20)) for _ in range(6)]
    blocks = [hx.Block(t, 0, False, 0) for t in parts]
    assert hx.stop_words_of(blocks) == {"zum", "kel", "ot"}
    page = "<body>" + "".join(f"<p>{t}</p>" for t in parts) + f"<p><a href=1>x</a></p><p>{POOR}</p><p><a href=1>Links</a></p></body>"
    assert hx.main_text(page).split("\n") == parts


def test_wrapping_form_and_lone_paragraph():
    assert hx.main_text(f'<body><form id="aspnetForm" action="/"><input name=x><div><p>{EN}</p><p>{EN}</p></div></form></body>') == f"{EN}\n{EN}"
    assert hx.main_text(f"<form id=form1><article><h1>Title</h1><p>{EN}</p></article></form>") == f"Title\n{EN}"
    assert hx.main_text(f"<article><p>{EN}</p><form><p>Your name</p><label>Mail</label></form></article>") == EN
    assert hx.main_text(f"<div><p>{EN}</p><p>{EN}</p></div><form class=search><p>{EN}</p></form>") == f"{EN}\n{EN}"
    assert hx.main_text("<ul><li><a href=1>One link</a><li><a href=2>Another</a></ul><p>A short paragraph.</p>") == "A short paragraph."


def test_density_decides_inside_articles_too():
    links = "<p><a href=1>Some linked words</a></p>"
    assert hx.main_text(f"<article>{links}<p>{POOR}</p>{links}<p>{EN}</p></article>") == EN
    assert hx.main_text(f"<article><p>{EN}</p><p>{POOR}</p><p>{EN}</p></article>").split("\n") == [EN, POOR, EN]
    assert hx.main_text(f"<div><p>{EN}</p><p>{POOR}</p><p>{EN}</p></div>").split("\n") == [EN, EN]


def plainly(blocks):
    """Both passes by their definition, looking along the page for each block."""
    known = hx.stop_words_of(blocks)
    first = []
    for b in blocks:
        density = b.links / max(1, len(b.text))
        stops = 1.0 if known is None else sum(w in known for w in b.words) / max(1, len(b.words))
        if b.article:
            stops = min(1.0, 2 * stops) if stops < hx.STOP_LOW else max(stops, hx.STOP_HIGH)
        long = len(b.text) >= hx.LENGTH_LOW
        if density > hx.LINKS_HIGH:
            first.append("bad")
        elif not long:
            first.append("bad" if b.links and not b.article else "short")
        elif stops >= hx.STOP_HIGH:
            first.append("good" if b.article or len(b.text) > hx.LENGTH_HIGH else "near")
        else:
            first.append("near" if b.article or stops >= hx.STOP_LOW else "bad")
    labels = list(first)
    for kind in ("near", "short"):
        now = list(labels)

        def seek(k, step):
            for j in range(k + step, len(blocks) if step > 0 else -1, step):
                if blocks[j].article == blocks[k].article and now[j] in ("good", "bad"):
                    return now[j], abs(j - k)
            return None, 0

        for k, b in enumerate(blocks):
            if now[k] != kind:
                continue
            (x, dx), (y, dy) = seek(k, -1), seek(k, 1)
            if kind == "near":
                labels[k] = "bad" if (x, y) == ("bad", "bad") else "good"
            elif x is None and y is None:
                labels[k] = "good" if b.article else "bad"
            elif b.article and (x is None or y is None):
                labels[k] = x or y
            elif b.heading and y:
                labels[k] = y
            elif x == y:
                labels[k] = x
            elif x is None or y is None or dx == dy:
                labels[k] = "bad"
            else:
                labels[k] = x if dx < dy else y
    if "good" not in labels:
        labels = ["good" if f in ("near", "short") and not b.links else x for f, x, b in zip(first, labels, blocks, strict=True)]
    return labels


def test_both_passes_against_the_definition():
    rng = random.Random(4)
    seen = set()
    for _ in range(600):
        blocks, article = [], 0
        language = rng.choice([EN, RU, POOR + " the of and"])
        for _ in range(rng.randrange(1, 14)):
            if rng.random() < 0.2:
                article = rng.choice([0, 0, article + 1])
            text = " ".join(rng.choice((language if rng.random() < 0.7 else POOR).split()) for _ in range(rng.choice([2, 5, 14, 30, 60])))
            blocks.append(hx.Block(text, rng.choice([0, 0, 0, 5, len(text)]), rng.random() < 0.2, article))
        hx.classify(blocks)
        assert [b.label for b in blocks] == plainly(blocks)
        seen |= {(b.label, bool(b.article), b.prose) for b in blocks}
    assert len(seen) >= 7


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "</p>" * 100_000, '<a href="x>' * 100_000 + "<!--", "<title>" * 100_000, "<span class=ad>" * 50_000 + "<div>" * 50_000 + "</span>" * 50_000, "<a '\">" * 100_000, "<form>" * 50_000 + "x", "<p " * 100_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    hx.main_text(page)
    assert time.process_time() - began < 8


def test_ids_keep_their_type(spark):
    pages = spark.createDataFrame([("p1", "u", f"<p>{EN}</p>"), (None, None, None)], "page_id string, url string, html string")
    assert {(r["id"], r["text"]) for r in hx.html_extract(pages).collect()} == {("p1", EN), (None, "")}

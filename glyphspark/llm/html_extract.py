"""HTML extraction by two-pass block rules.

A page is read as a stream of tags and texts. Block-level tags cut it into blocks; scripts, styles, forms, menus, page
headers and footers, sidebars, notices, adverts and reader comments are left out by element, role, class or id. Every block left has a length, a link density and a
stop-word density.

Pass 1, without context: much link text is bad; short blocks stay open; longer blocks are good with enough stop words,
near-good with some, else bad. Inside an article or main element half the density is enough, a long block with less is near-good,
never bad, and neighbours outside it don't count: the element raises a prior, density decides.
Pass 2, with context: open (short and near-good) blocks inherit the label of the nearest decided neighbours on both sides: near-good
blocks are bad between two bad ones and else good; short ones follow neighbours that agree, else the nearer side, a tie being bad.
Inside an article, a short block with a neighbour on one side follows that, and one without any is good. Headings follow the first decided block
after them. Where a page ends without a good block, its open blocks without links are good.

Stop words: a list for seven languages; where the long blocks of a page hold few of them, the page is in another language and its own
words that recur in half of its long blocks take their place; without enough of these (few blocks, or a script without spaces) length
and links decide alone.

A form that holds an article, or at least two long blocks and over half of all the page's long text, is a wrapper and not left out.

Edge cases: null and empty html give empty text; unclosed and misnested tags, unclosed comments and attributes with `>` are
read as browsers do; a page is read in time linear in its length, whatever tags and quotes it leaves open; repeated rows are
extracted alike; an empty table gives an empty result; ids keep their type; only the named columns are read, so extra columns
never clash. Texts are never cut.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphspark.llm.common import type_of

STEP = 64
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS_HIGH = 0.4
#: Long blocks of a page from which on its recurring words are taken for its stop words.
RECUR_FROM = 4
#: Tags with quotes that never close of which each may be read to the page's end; further ones end at the next >.
BROKEN_TAGS = 8

# Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset("""
the of and to a in is it that for was on are as with he be at by this had not from or have an they which one you were her all his
le la les de des du un une et en est que qui dans pour pas sur au avec ce il elle sont par plus ne se
der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an dem im war wird bei
el los las y del que por con para una su al lo como más pero sus este sí
di che è per un non sono con il della da si o os uma não com dos het een van niet zijn op te dat
""".split())

#: A comment (group 1), a declaration (group 2) or the start of a tag (groups 3 and 4).
OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*+))")
#: The inside of a tag up to its >, or up to a quote that never closes.
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")

# Element names by their part in a page.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("nav footer aside button select option label legend svg canvas object audio video map menu dialog head datalist".split()) | RAW
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Parts of class names and ids that mark what is not the article, and those that mark the article.
MARKS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
sidebar aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar comment comments disqus
respond reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay
pagination pager skip toolbar form search
""".split())
#: Such parts as the first or last of a joined name ("commentlist", "leftsidebar") mark it too.
JOINED = re.compile(r"(?:comment(?!ar|at)|sidebar|cookie|footer|header|advert|newsletter|breadcrumb|navbar|navigation|menu|sponsor|promo|subscri|pagination|social|related|banner|widget|popup|modal|notice|consent)[a-z]*|[a-z]*(?:sidebar|footer|navbar|comments|breadcrumbs)|(?:site|page|top|main|global|web|blog|left|right|bottom|side|user|reader|mobile)+(?:header|nav|menu|bar|banner|comment)|nav(?:links?|list|item|box|area|wrap|wrapper)|ads?(?:bygoogle|box|slot|unit|banner|container|wrap|wrapper|space|frame|block|area|label|text|content|link|links)|share(?:bar|box|buttons?|links?)")
# Parts that say what a layout has or lacks, and parts whose headers are headings of the text itself.
LAYOUT = frozenset("with has no without".split())
TITLED = frozenset("article content post entry story section text".split())
PARTS = re.compile(r"[^a-z0-9]+")


@lru_cache(maxsize=1 << 14)
def marked(token: str) -> bool:
    """Whether a class name or id marks an element as not part of an article; no other part of the name makes up for that."""
    parts = [re.sub(r"\d+$", "", p) for p in PARTS.split(re.sub(r"side-?bar", "sidebar", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", token).lower())) if p]
    for before, part in zip(["", *parts], parts, strict=False):
        if before in LAYOUT or (part in ("header", "headers") and TITLED.intersection(parts)):
            continue
        if part in MARKS or JOINED.fullmatch(part):
            return True
    return False


def marked_out(name: str, attributes: str) -> bool:
    """Whether an element's attributes say that it is not part of an article."""
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.strip().lower() in ROLES and not (name == "form" and value.strip().lower() == "form"):
            return True
        if key in ("class", "id"):
            if name == "form":  # "form1" and the like say nothing of a form
                value = re.sub(r"(?i)\b[a-z]*form\d*(?=\s|$)", "", value)
            if any(map(marked, value.split())):
                return True
    return False


class Block:
    __slots__ = ("text", "links", "heading", "article", "form", "label", "words")

    def __init__(self, text: str, links: int, heading: bool, article: int, form: int = 0):
        self.text, self.links, self.heading, self.article, self.form = text, links, heading, article, form
        self.label = ""
        self.words = [w.strip("\"'.,;:!?()[]%*#&$|").lower() for w in text.split()]

    @property
    def prose(self) -> bool:
        """Long, with few links."""
        return len(self.text) >= LENGTH_LOW and self.links <= LINKS_HIGH * len(self.text)


class Open:
    """An open element: what it says of the text inside, and the block elements open down to it."""

    __slots__ = ("name", "out", "article", "form", "blocks")

    def __init__(self, name: str, out: bool, article: int, form: int, blocks: int):
        self.name, self.out, self.article, self.form, self.blocks = name, out, article, form, blocks


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; article and form are the numbers of such elements around a block, or 0."""
    found: list[Block] = []
    stack: list[Open] = [Open("", False, 0, 0, 0)]
    where: dict[str, list[int]] = {}  # places of open elements by name
    parts: list[str] = []
    links = articles = forms = anchors = broken = 0
    heading = False
    holds_article: set[int] = set()  # forms
    unclosed: set[str] = set()  # raw elements that the rest of the page never closes

    def flush() -> None:
        nonlocal links, heading
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        if text:
            found.append(Block(text, links, heading, stack[-1].article, stack[-1].form))
        parts.clear()
        links, heading = 0, False

    def close_down(place: int) -> None:
        while len(stack) > place:
            where[stack.pop().name].pop()

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = OPEN.search(page, at)
        while m and not m[1] and m.start() > last:  # no tag any more, only an unclosed comment ends the text
            m = OPEN.search(page, m.end())
        end = m.start() if m else size
        if end > at and not stack[-1].out:
            text = page[at:end]
            parts.append(text)
            if anchors:
                links += len(text.strip())
        if not m:
            break
        if m[1]:
            to = page.find("-->", m.end())
            at = size if to < 0 else to + 3
            continue
        to = page.find(">", m.end()) if m[2] or broken >= BROKEN_TAGS else INSIDE.match(page, m.end()).end()
        if to >= size or page[to] != ">":  # a quote that never closes
            broken += 1
            to = page.find(">", m.end())
        at = to + 1
        if m[2]:
            continue
        name, attributes = m[4].lower(), page[m.end() : to]
        if m[3]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name in BLOCKS:
                flush()
            if where.get(name):
                place = where[name][-1]
                if name in BLOCKS or stack[-1].blocks == stack[place].blocks:
                    close_down(place)
            continue
        if name in RAW:
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(name)
                if name != "title":
                    break
            continue
        if name == "br":
            if not stack[-1].out:
                parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
            anchors = 0
            # a paragraph ends where a block starts, an item where the next item starts
            while stack[-1].name and (stack[-1].name == "p" or stack[-1].name not in BLOCKS or (name in ("li", "dt", "dd", "option") and stack[-1].name == name)):
                if stack[-1].name not in BLOCKS and not any(s.name == "p" for s in stack[-2:]):
                    break
                close_down(len(stack) - 1)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            continue
        if name == "a":
            anchors += 1
        out, article, form = stack[-1].out, stack[-1].article, stack[-1].form
        if name in ("article", "main") and not out:
            holds_article.add(form)
            if article == 0:
                articles += 1
                article = articles
        skips = name in LEFT_OUT or (name == "header" and not article) or marked_out(name, attributes)
        if name == "form":
            forms += 1
            form = forms
        if name in BLOCKS or name in LEFT_OUT or skips:
            where.setdefault(name, []).append(len(stack))
            stack.append(Open(name, out or skips, article, form, stack[-1].blocks + (name in BLOCKS)))
        if name in HEADINGS:
            heading = True
    flush()
    if not forms:
        return found
    long = Counter()
    for b in found:
        if b.prose:
            long[b.form] += len(b.text)
    several = Counter(b.form for b in found if b.prose)
    wrappers = {f for f in range(1, forms + 1) if f in holds_article or (several[f] > 1 and 2 * long[f] > sum(long.values()))}
    return [b for b in found if not b.form or b.form in wrappers]


def stop_words_of(blocks: list[Block]) -> frozenset[str] | None:
    """The stop words of a page's language; None if they can't be told."""
    prose = [b for b in blocks if b.prose]
    total = sum(len(b.words) for b in prose)
    enough = lambda known: sum(w in known for b in prose for w in b.words) >= STOP_LOW * total
    if enough(STOP_WORDS):
        return STOP_WORDS
    if len(prose) >= RECUR_FROM:
        held = Counter(w for b in prose for w in set(b.words) if w)
        own = frozenset(w for w, n in held.items() if 2 * n >= len(prose))
        if enough(own):
            return own
    return None


def classify(blocks: list[Block]) -> None:
    """Both passes; labels end as good or bad."""
    known = stop_words_of(blocks)
    for b in blocks:
        low, high = (STOP_LOW / 2, STOP_LOW) if b.article else (STOP_LOW, STOP_HIGH)
        stops = high if known is None else sum(w in known for w in b.words) / max(1, len(b.words))
        if b.links > LINKS_HIGH * len(b.text):
            b.label = "bad"
        elif len(b.text) < LENGTH_LOW:
            b.label = "bad" if b.links and not b.article else "short"
        elif stops >= high:
            b.label = "good" if b.article or len(b.text) > LENGTH_HIGH else "near"
        else:
            b.label = "near" if stops >= low or b.article else "bad"
    open_blocks = [b for b in blocks if b.label in ("short", "near")]
    for open_label in ("near", "short"):
        first = [b.label for b in blocks]
        decided = [None if x in ("short", "near") else x for x in first]
        before, after = _nearest(blocks, decided), _nearest(blocks[::-1], decided[::-1])[::-1]
        for b, label, left, right in zip(blocks, first, before, after, strict=True):
            if label == open_label:
                b.label = inherited(b, label, left, right)
    if not any(b.label == "good" for b in blocks):
        for b in open_blocks:
            if not b.links:
                b.label = "good"


def inherited(b: Block, label: str, left: tuple[str | None, int], right: tuple[str | None, int]) -> str:
    """The label of an open block from the nearest decided labels before and after it and their distances."""
    (before, far_before), (after, far_after) = left, right
    if label == "near":
        return "bad" if before == after == "bad" else "good"
    if before is None and after is None:
        return "good" if b.article else "bad"
    if b.article and (before is None or after is None):
        return before or after
    if b.heading and after is not None:
        return after
    if before == after:
        return before
    if before is None or after is None:
        return "bad"
    return before if far_before < far_after else after if far_after < far_before else "bad"


def _nearest(blocks: list[Block], decided: list[str | None]) -> list[tuple[str | None, int]]:
    """For each block the nearest earlier decided label in the same article (or outside all) and its distance."""
    last: dict[int, tuple[str, int]] = {}
    out = []
    for k, b in enumerate(blocks):
        label, place = last.get(b.article, (None, 0))
        out.append((label, k - place))
        if decided[k]:
            last[b.article] = (decided[k], k)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def html_extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per input row: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for off in range(0, batch.num_rows, STEP):
                part = batch.slice(off, STEP)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {type_of(pages, id_col)}, url string, text string, n_chars long")


def op7_html_extract(spark, sf_dir: str) -> DataFrame:
    return html_extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")

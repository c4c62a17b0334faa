"""Main text of web pages by two-pass block rules.

A page becomes blocks: runs of text between block-level tags.  The first
pass scores each block alone: its density of stop words, its length and its
link density, and as a further feature its place (a menu, footer, form, advert
or comment weighs against it, an article for it; a mark that also names
layouts, like "widget", weighs little).  Blocks whose score is between the
limits, too short or not telling enough, stay open.  In the second pass they
inherit the label of the nearest decided neighbour (on a tie, or between
different neighbours at equal distance, boilerplate wins; an open heading
shortly before a good block is good).  Inside an article only neighbours of
the article count, and without one an open block is good.

Scripts, styles, comments and the page head are no blocks.  Character
references are decoded and white space inside a block becomes one space.
Null or empty html gives an empty text.  Repeated pages give repeated rows;
page_id and url are carried as they are.  Each page is one pass over its
characters, whatever its length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Frequent function words of English, German, French, Spanish.
STOP_WORDS = frozenset("""
a about after all an and are as at be been but by can for from had has have he her his if in into is it its not of on
one or our out she so that the their them there they this to up was we were what when which who will with you your
aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich
ihr im in ist kann man mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn
wie wir wird zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me ne nous on ou par
pas plus pour qu que qui sa se ses son sont sur tu un une vous
al como con de del el ella en entre era es esta este fue ha hay la las lo los más mi muy no o para pero por que se ser
si sin sobre su sus también un una y ya
""".split())
# Elements that end a block, are skipped whole, or hold boilerplate.
BLOCK_TAGS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table
tbody td tfoot th thead tr ul
""".split())
SKIPPED = frozenset("canvas head iframe noscript object script style svg template textarea title".split())
BOILERPLATE_TAGS = frozenset("aside button dialog fieldset footer form menu nav select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset(("article", "main"))
# Words of class, id and role attributes that mark boilerplate.
MARKS = frozenset("""
ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent
contentinfo cookie cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter
notice notices notification pager pagination popup promo promoted reader related replies reply search share sharing
sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets
""".split())

# Those of them that wrappers of whole pages carry as well.
WEAK_MARKS = frozenset("reader related search share sharing social toolbar widget widgets".split())

#: In a name like "no-sidebar" the mark describes a layout, not the element.
NEGATIONS = frozenset(("has", "no", "with", "without"))

#: Block rules.  Up to SHORT characters a block is short, over LONG it is long;
#: a share of stop words of at least STOP is a text's, a share of linked
#: characters over LINKED is a list of links.
SHORT, LONG = 70, 100
STOP, LINKED = 0.1, 0.35
#: Weights of the features, and the scores from which a block is good or bad.
WEIGHTS = {"dense": 0.75, "long": 0.75, "short": -0.5, "linked": -4.0, "short_link": -1.5, "article": 1.0,
           "boilerplate": -4.0, "weak_mark": -0.5, "short_weak_mark": -2.0, "copyright": -2.0}
GOOD_FROM, BAD_TO = 1.0, -1.0
HEADING_REACH = 200

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"<]*+"|'[^'<]*+')*+)>"""
                   r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
GOOD, BAD, OPEN = 1, 0, None


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    boilerplate: bool
    article: bool
    weak: bool = False


def _marked(attributes: str) -> int:
    """2: class, id or role marks boilerplate; 1: by a weak mark only; 0: not."""
    most = 0
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = MARKS.intersection(re.split(r"[^a-z0-9]+", name))
            if words and NEGATIONS.isdisjoint(re.split(r"[^a-z0-9]+", name)):
                most = max(most, 1 if words <= WEAK_MARKS else 2)
    return most


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # Open elements that matter: (tag, boilerplate by tag, by mark (0 to 2), article inside).
    stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]
    open_tags: dict[str, int] = {}
    links, heading, at, line_break = 0, False, 0, False
    last_tag_end, unclosed = page.rfind(">"), set()

    def close() -> None:
        text = SPACE.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text:
            linked = sum(len(SPACE.sub(" ", html.unescape(p)).strip()) for p, in_link in parts if in_link)
            _, by_tag, mark, article = stack[-1]
            out.append(Block(text, linked, heading, by_tag or mark == 2, article, mark == 1))
        parts.clear()

    while True:
        m = TOKEN.search(page, at) if at <= last_tag_end or page.startswith("<!--", at) else None
        parts.append((page[at:m.start() if m else len(page)], links > 0))
        if line_break and parts[-1][0].strip():
            line_break = False
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    break
                else:
                    unclosed.add(tag)
            parts.append((" ", False))
        elif tag == "a":
            links = max(0, links - 1) if closing else links + 1
        elif tag == "br":
            if line_break:
                close()
            parts.append((" ", False))
            line_break = True
        if tag in BLOCK_TAGS:
            close()
            links, line_break = 0, False
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing
        if tag in VOID or attributes.endswith("/") or tag in SKIPPED:
            continue
        if closing:
            if open_tags.get(tag):
                while True:
                    name = stack.pop()[0]
                    open_tags[name] -= 1
                    if name == tag:
                        break
        elif tag in BLOCK_TAGS and tag != "p" or _marked(attributes):
            _, bad, mark, article = stack[-1]
            bad = tag != "main" and (bad or tag in BOILERPLATE_TAGS or (tag == "header" and not article))
            if tag in CONTENT_TAGS and not article:
                mark = 0                            # what is marked is a wrapper of the content
            if tag not in ("html", "body", "main"):
                mark = max(mark, _marked(attributes))
            stack.append((tag, bad, mark, article or tag in CONTENT_TAGS))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    close()
    return out


def features(b: Block) -> dict[str, bool]:
    """The features of a block that are present."""
    words = WORD.findall(b.text.lower())
    dense = bool(words) and sum(w in STOP_WORDS for w in words) >= STOP * len(words)
    size, linked = len(b.text), b.linked > LINKED * len(b.text)
    return {"dense": dense, "long": size > LONG, "short": size < SHORT, "linked": linked,
            "short_link": size < SHORT and b.linked > 0, "article": b.article, "boilerplate": b.boilerplate,
            "weak_mark": b.weak, "short_weak_mark": b.weak and size <= LONG,
            "copyright": "\u00a9" in b.text and size <= LONG and not b.article}


def first_pass(b: Block) -> int | None:
    """Label of a block by itself."""
    score = sum(WEIGHTS[k] for k, present in features(b).items() if present)
    return GOOD if score >= GOOD_FROM else BAD if score <= BAD_TO else OPEN


def decided(blocks: list[Block], labels: list[int | None], order: range) -> list[tuple[float, int]]:
    """(distance, label) of the last decided block up to each block in
    ``order``; a block marked as boilerplate by its place says less about its
    surroundings and counts as half a block farther.  The page's edge is
    boilerplate."""
    out: list[tuple[float, int]] = [(0, BAD)] * len(blocks)
    seen = (len(blocks) + 1.0, BAD)
    for i in order:
        seen = (seen[0] + 1, seen[1])
        if labels[i] is not OPEN:
            seen = (0.5 if blocks[i].boilerplate else 0, labels[i])
        out[i] = seen
    return out


def second_pass(blocks: list[Block], labels: list[int | None]) -> list[int]:
    """Open blocks take the label of the nearest decided neighbour."""
    before = decided(blocks, labels, range(len(blocks)))
    after = decided(blocks, labels, range(len(blocks) - 1, -1, -1))
    own = [i for i, b in enumerate(blocks) if b.article and not b.boilerplate]
    inside = [blocks[i] for i in own]
    own_before = decided(inside, [labels[i] for i in own], range(len(own)))
    own_after = decided(inside, [labels[i] for i in own], range(len(own) - 1, -1, -1))
    for k, i in enumerate(own):
        far = len(own)                              # beyond the article's first and last block: no neighbour
        before[i], after[i] = ((d, lab) if d <= far else (far + 1.0, GOOD) for d, lab in (own_before[k], own_after[k]))
    out = [BAD] * len(blocks)
    reach = HEADING_REACH + 1
    for i in range(len(blocks) - 1, -1, -1):
        if labels[i] is not OPEN:
            out[i] = labels[i]
        elif blocks[i].heading and reach <= HEADING_REACH:
            out[i] = GOOD
        else:
            out[i] = min(before[i], after[i])[1]
        reach = 0 if out[i] == GOOD else reach + len(blocks[i].text)
    return out


def main_text(page: str | None) -> str:
    """The page's good blocks, joined by an empty line."""
    if not page:
        return ""
    blocks = blocks_of(page)
    labels = [first_pass(b) for b in blocks]
    if GOOD not in labels:
        # Nothing is decided as good: the open blocks with most of a text's
        # traits, those of at least SHORT characters, stand in for it.
        labels = [GOOD if lab is OPEN and len(b.text) >= SHORT else lab for b, lab in zip(blocks, labels)]
    return "\n\n".join(b.text for b, good in zip(blocks, second_pass(blocks, labels)) if good)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """The ``carry`` columns with text and n_chars (code points)."""
    schema = StructType([pages.schema[c] for c in carry]).add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema.names)

    return pages.select(F.col(column).alias("__html"), *carry).mapInArrow(run, schema)

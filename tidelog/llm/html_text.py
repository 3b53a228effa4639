"""Main text of HTML pages by two-pass block rules.

Pass one decides blocks by link density, stop-word density and length, and by what encloses them; blocks that are too
short to tell stay open. Pass two gives open blocks the label of their nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words by language.
STOP_WORDS = frozenset(
    """
    the of and to a in is it that on for with as was be by are this at from or an not have but they his her you we
    de la le les et des en un une du que qui est pour dans par sur pas au avec ce se sont il elle ne plus ou
    der die das und den von zu mit dem nicht ein eine auf für ist im des sich auch als an werden aus er sie es bei
    el los las y del que en un una por con para su al lo como más pero sus le ya o este no es se
    di il che per non si da una sono con o e do os as com um uma não het een van dat op te zijn voor met
    """.split()
)
# Elements whose content is never text of the page (of these, some hold characters only and so reach to
# the end of the page where no end tag follows), elements beside the article, and elements that only mark up a run of text.
RAW = frozenset("script style noscript template iframe object svg math canvas select textarea button title".split())
CHARACTERS = frozenset("script style noscript iframe textarea title".split())
BESIDE = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role of an element that stands beside the article.
_BESIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav\w*|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notice|alert|newsletter|subscribe|signup|login|comments?|commentlist|disqus|respond|share|sharing|social|related|recommended|popup|modal|search|widget|pagination|pager)(?=$|[\s_-])",
    re.I,
)
#: Compounds that say how a page is laid out or what state it is in, not what the element is: has-sidebar, nav-open.
_STATE = re.compile(r"(?:^|[_-])(?:has|have|no|not|non|with|without|is|show|hide|open|opened|closed|collapsed|expanded|active|enabled|disabled|layout)(?=$|[_-])", re.I)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)

#: Share of linked characters over which a block is boilerplate, and the same within an article, whose paragraphs may
#: hold many references.
LINKS, ARTICLE_LINKS = 1 / 3, 0.8
#: Characters under which a block is too short to tell, and from which a block with stop words is text.
SHORT, LONG = 70, 120
#: Shares of stop words.
FEW, MANY = 0.15, 0.25
#: Characters of scripts that need fewer of them for the same text; each counts as three where length decides.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")

GOOD, BAD, NEAR, OPEN = "good", "bad", "near", "open"


class Block:
    __slots__ = ("article", "beside", "heading", "linked", "text", "wrapped")

    def __init__(self, text: str, linked: int, beside: bool, article: bool, wrapped: bool = False, heading: bool = False):
        self.heading = heading
        self.text, self.linked, self.beside, self.article, self.wrapped = text, linked, beside or wrapped, article, wrapped and not beside


def blocks(page: str) -> Iterator[Block]:
    """The blocks of text between block-level tags, in page order."""
    # element, beside the article by its markup, by names in its classes, by such names around its article only, inside one
    stack: list[tuple[str, bool, bool, bool, bool]] = []
    parts: list[tuple[str, bool]] = []
    by_markup = by_name = wrapped = article = own_beside = heading = False
    links = at = 0

    def flush() -> Iterator[Block]:
        nonlocal own_beside
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(" ".join(html.unescape(t).split())) for t, in_link in parts if in_link)
                yield Block(text, linked, by_markup or by_name or own_beside, article, wrapped, heading)
            parts.clear()

    unclosed: set[str] = set()  # elements of RAW that no end tag follows any more
    while True:
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            parts.append((page[at:end], links > 0))
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "")
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                over = None if tag in unclosed else _END[tag].search(page, at)
                if over:
                    at = page.find(">", over.end()) + 1 or len(page)
                elif tag in CHARACTERS:
                    at = len(page)
                else:
                    unclosed.add(tag)
            yield from flush()
            continue
        if tag == "head":  # what may stand in it is RAW or VOID; all else ends it, with or without its end tag
            yield from flush()
            continue
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in INLINE:
            if tag == "br":
                parts.append((" ", False))
            continue
        yield from flush()
        own_beside = heading = False
        links = 0
        if closing:
            if any(tag == s[0] for s in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag in VOID:
            continue
        elif tag in HEADINGS or tag in ("p", "li", "dt", "dd", "td", "th", "tr"):
            heading = tag in HEADINGS
            own_beside = _named_beside(attributes)  # these may end without an end tag: they hold until the next block
            continue
        else:
            page_header = tag == "header" and not article
            markup, name, around = by_markup or tag in BESIDE or page_header, by_name, wrapped
            if tag == "main":
                name = around = False
            elif tag == "article":
                if name and not _beside_by_name(attributes):
                    name, around = False, True
            elif tag not in ("html", "body"):
                markup, name = markup or _hidden(attributes), name or _beside_by_name(attributes)
            stack.append((tag, markup, name, around, article or tag in ARTICLE))
        by_markup, by_name, wrapped, article = stack[-1][1:] if stack else (False,) * 4
    yield from flush()


def _hidden(attributes: str) -> bool:
    return bool(attributes and _HIDDEN.search(attributes))


def _beside_by_name(attributes: str) -> bool:
    if not attributes:
        return False
    values = (next(filter(None, m.groups()), "") for m in _ATTRIBUTE.finditer(attributes))
    return any(_BESIDE_NAME.search(v) and any(_BESIDE_NAME.search(t) and not _STATE.search(t) for t in v.split()) for v in values)


def _named_beside(attributes: str) -> bool:
    return _hidden(attributes) or _beside_by_name(attributes)


def _boilerplate(b: Block) -> bool:
    return b.beside or b.linked > (ARTICLE_LINKS if b.article else LINKS) * len(b.text)


def _stop_share(b: Block) -> float:
    words = [w.strip(".,;:!?()\"'*%$#&|«»…").lower() for w in b.text.split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, listed: bool = True) -> str:
    """Good, bad, nearly good, or open. Length decides where the page is in no language whose stop words are listed.

    The same rules hold inside an article, but that a long block there is not bad for want of stop words: it is nearly good.
    """
    if _boilerplate(b):
        return BAD
    if not listed:
        n = len(b.text) + 2 * len(_DENSE.findall(b.text))
        return GOOD if n >= LONG else NEAR if n >= SHORT else OPEN
    if len(b.text) < SHORT:
        return OPEN
    stop = _stop_share(b)
    if stop >= MANY and len(b.text) >= LONG:
        return GOOD
    return NEAR if stop >= FEW or b.article else BAD


def in_listed_language(found: list[Block]) -> bool:
    """Whether at least half of the characters that stop words would decide on are in blocks that have some."""
    some = few = 0
    for b in found:
        if not _boilerplate(b):
            if len(b.text) >= SHORT and _stop_share(b) >= FEW:
                some += len(b.text)
            elif len(b.text) >= SHORT or _DENSE.search(b.text):
                few += len(b.text)
    return some >= few


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is text. Nearly good, then open ones take after the nearest good or bad ones.

    Inside an article only the article's blocks count: a nearly good block is text unless both its neighbours are bad,
    and an open one if one of them is good or none is decided. Elsewhere a nearly good block is text unless both are bad, or
    one where there is no other, and an open one if both are good, or, of a heading, the one after it. What stands beside the article by its markup is no
    neighbour there: it says nothing of the text around it.
    """
    labels = list(labels)
    for kind in (NEAR, OPEN):
        before, after = _nearest(found, labels, range(len(labels))), _nearest(found, labels, range(len(labels) - 1, -1, -1))
        for i in [i for i, label in enumerate(labels) if label == kind]:
            sides = {before[i], after[i]} - {None}
            if found[i].article:
                good = not before[i] == after[i] == BAD if kind == NEAR else GOOD in sides or not sides
            elif kind == NEAR:
                good = sides != {BAD}
            else:
                good = after[i] == GOOD and (found[i].heading or before[i] == GOOD)
            labels[i] = GOOD if good else BAD
    return [label == GOOD for label in labels]


def _nearest(found: list[Block], labels: list[str], order: range) -> list[str | None]:
    """The last decided label before each block in this order, as far as it counts for the block."""
    out: list[str | None] = [None] * len(labels)
    last: dict[bool, str] = {}
    for i in order:
        inside = found[i].article
        out[i] = last.get(inside)
        if labels[i] in (GOOD, BAD) and (inside or not found[i].beside):
            last[inside] = last[False] = labels[i]
        if not inside:
            last.pop(True, None)  # another article is another context
    return out


def main_text(page: str | None) -> str:
    """The text blocks of a page, a line each."""
    found = list(blocks(page or ""))
    if not any(b.article and not b.beside for b in found):  # names around the only articles are those of the layout
        for b in found:
            b.beside = b.beside and not b.wrapped
    listed = in_listed_language(found)
    labels = [first_pass(b, listed) for b in found]
    return "\n".join(b.text for b, keep in zip(found, second_pass(found, labels), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Null html counts as empty; a page without text gives an empty one; long and malformed pages are read to their end.
    Repeated rows are answered each; no rows give no rows; other columns are not looked at.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

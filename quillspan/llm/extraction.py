"""Main text of web pages by two passes of block rules.

A page is cut into blocks of text at block-level tags. Blocks inside menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, which elements, roles and class names tell, are no candidates. If what is left
has a block inside an article element, only articles count, else only a main element, else the whole page.

First pass: link density, length and stop-word density decide a block alone. Many links are bad; long text is
good if it has stop words, or in an article or main element; text of middle length is good if it has many stop
words. Short blocks, and headings, are not decided. Second pass: these inherit the label of the nearest decided
block of the same article (of the page, where there is none: then its two ends count as bad blocks). At equal
distance to a good and a bad one, what is in an article and headings are good; in an article, what holds no link
takes the good one of its two neighbours, however far. An article without a good block keeps all its undecided ones.

Null and empty pages, and pages without text, give an empty text. Markup that is cut off or not closed ends with
the page; tags, comments and quoted attributes are read as browsers do, in time linear in the page. Pages of any
length are read whole. Rows are judged one by one: repeated rows give repeated results. Tables without rows give
none; columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspan.llm.scratch import small_batches

#: Characters of long and of middle blocks, the share of link text that is bad, shares of stop words.
LONG, MIDDLE, LINKS, SOME, MANY = 140, 60, 0.5, 0.08, 0.22
#: Frequent words of the languages that are told from noise.
STOP_WORDS = frozenset(
    """a about all an and are as at be been but by can for from had has have he her his i if in is it its more not of on
    one or she so that the their there they this to was we were which who will with would you
    aber als am auch auf aus bei das dass dem den der des die ein eine einer er es für hat ich im ist mit nach nicht oder
    sich sie sind um und von war wie wird zu zum zur
    au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour que qui
    sa se ses son sur un une vous
    al como con del el esta este ha las lo los más muy no o para pero por si sin su sus también y ya""".split()
)
#: Elements, roles and words of class names and ids that mark what isn't the article.
BOILERPLATE = frozenset("nav footer aside form dialog menu noscript template svg canvas object audio video select button datalist label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar".split())
HINTS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion promoted
    comment comments commentlist respond disqus reply replies cookie cookies consent gdpr notice notices notification alert toast
    popup modal overlay newsletter subscribe subscription signup login sidebar aside nav navbar navigation menu submenu
    breadcrumb breadcrumbs pagination pager footer related recommended recommendations share sharing social widget skip
    toolbar copyright disclaimer search form teaser teasers""".split()
)
PAGE_HINTS = frozenset("header masthead banner topbar hero".split())
#: Class names that begin like this say what a layout has, not what an element is.
LAYOUT = frozenset("has with without no not is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th
    thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = {name: re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.I) for name in "script style title textarea xmp iframe noembed noframes".split()}

_SPACE = r" \t\n\r\f"
_TAG = re.compile(
    rf"<(/?)([A-Za-z][^{_SPACE}/>]*+)"
    rf"((?:[{_SPACE}/]++|=?[^{_SPACE}/>=]++(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^{_SPACE}>\"'][^{_SPACE}>]*+)?+)?+|=)*+)(?:>|\Z)"
)
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![A-Za-z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(rf"(?:^|[{_SPACE}/\"'])(class|id|role|itemprop|style|aria-hidden|hidden)(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"([^\"]*+)|'([^']*+)|([^{_SPACE}>\"'][^{_SPACE}>]*+)))?+(?=[{_SPACE}/\"']|\Z)", re.I)
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    linked: int
    heading: bool
    kind: int  # 2 in an article, 1 in a main element, else 0
    part: int  # which such element


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _marks(name: str, attributes: dict[str, str], kind: int) -> tuple[bool, int]:
    """Whether an element isn't part of an article, and 2 or 1 if it is an article or main element."""
    role = attributes.get("role", "").lower()
    names = [[p.lower() for p in _PART.findall(c)] for c in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()]
    if name in ("html", "body", "main") or role == "main":
        return False, int(name == "main" or role == "main")
    if name == "article" or role == "article" or "articleBody" in attributes.get("itemprop", ""):
        return any(len(c) == 1 and c[0] in HINTS for c in names), 2
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
    outside = not kind and name not in HEADINGS
    if hidden or name in BOILERPLATE or role in ROLES or (name == "header" and outside):
        return True, 0
    words = {p for c in names if c and c[0] not in LAYOUT for p in c}
    return bool(words & HINTS or (outside and words & PAGE_HINTS)), 0


def blocks(page: str) -> list[Block]:
    """Blocks of text that no markup rules out, in page order."""
    out: list[Block] = []
    pieces: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int, int]] = []  # name, and what held before it
    opened: dict[str, int] = {}
    bad, kind, part, parts, heading = False, 0, 0, 0, False
    link = -1  # the stack's height where a link began

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, len(" ".join("".join(linked).split())), heading, kind, part))
            pieces.clear()
            linked.clear()

    def pop() -> str:
        nonlocal bad, kind, part, link
        name, bad, kind, part = stack.pop()
        opened[name] -= 1
        if len(stack) < link:
            link = -1
        return name

    at = 0
    while at < len(page):
        mark = page.find("<", at)
        text = page[at:] if mark < 0 else page[at:mark]
        if text and not bad:
            text = entities.unescape(text)
            pieces.append(text)
            if link >= 0:
                linked.append(text)
        if mark < 0:
            break
        tag = _TAG.match(page, mark)
        if tag is None:
            other = _OTHER.match(page, mark)
            at = other.end() if other else mark + 1
            if other is None and not bad:
                pieces.append("<")
            continue
        at, name = tag.end(), tag[2].lower()
        if name in BLOCKS:
            flush()
            if stack and stack[-1][0] == "p":
                pop()
        if tag[1]:
            if name == "a":
                link = -1
            elif opened.get(name):
                if name not in BLOCKS and bad:
                    flush()
                while pop() != name:
                    pass
            heading = heading and name not in BLOCKS
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name in BLOCKS:
            heading = name in HEADINGS
            if name == "li" and stack and stack[-1][0] == "li":
                pop()
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            link = len(stack)
        if name in VOID or name in FORMATTING:
            continue
        stack.append((name, bad, kind, part))
        opened[name] = opened.get(name, 0) + 1
        if not bad or name in ("main", "article"):
            attributes = _attributes(tag[3])
            ruled_out, new = _marks(name, attributes, kind)
            if ruled_out and not bad and name not in BLOCKS:
                flush()  # what an inline element hides is no part of the block around it
            if new and (not bad or name == "main"):
                parts += 1
                bad, kind, part = False, new, parts
            bad = bad or ruled_out
    flush()
    return out


def _alone(block: Block) -> int:
    """First pass: 1 good, -1 bad, 0 not decided."""
    n = len(block.text)
    if block.linked > LINKS * n:
        return 0 if block.heading else -1
    if block.heading or n < MIDDLE:
        return -1 if not block.kind and block.text[0] == "©" else 0
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words)
    if n >= LONG and (block.kind or stops >= SOME * len(words)) or stops >= MANY * len(words) and words:
        return 1
    return -1 if n >= LONG else 0


def labels(part: list[Block]) -> list[bool]:
    """Both passes over the blocks of one article, or of a page without one."""
    alone = [_alone(b) for b in part]
    if not part:
        return []
    inside = part[0].kind > 0
    if inside and 1 not in alone:
        return [x == 0 for x in alone]
    n, far = len(part), 2 * len(part) + 2
    ahead = [(0, far)] * n  # label of, and distance to, the nearest decided block before and after
    behind = [(0, far)] * n
    for order, found, step in ((range(n), ahead, 1), (range(n - 1, -1, -1), behind, -1)):
        last, label = (None, 0) if inside else (-1 if step > 0 else n, -1)
        for i in order:
            if last is not None:
                found[i] = (label, abs(i - last))
            if alone[i]:
                last, label = i, alone[i]
    out = []
    for block, own, before, after in zip(part, alone, ahead, behind):
        if own:
            out.append(own > 0)
            continue
        good = min(d for label, d in (before, after, (1, far)) if label > 0)
        worse = min(d for label, d in (before, after, (-1, far)) if label < 0)
        if inside and not block.linked:
            out.append(good < far)
        else:
            out.append(good < worse or good == worse and (inside or block.heading))
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    found = blocks(page or "")
    best = max((b.kind for b in found), default=0)
    parts: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if b.kind == best:
            parts.setdefault(b.part if best else 0, []).append(i)
    kept = [i for part in parts.values() for i, good in zip(part, labels([found[i] for i in part])) if good]
    return "\n".join(found[i].text for i in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(pages.sparkSession)
    plain = pages.select("page_id", "url", "html")
    schema = StructType([plain.schema["page_id"], plain.schema["url"], StructField("text", StringType()), StructField("n_chars", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type), pa.array(texts, arrow.field(2).type), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return plain.mapInArrow(run, schema)

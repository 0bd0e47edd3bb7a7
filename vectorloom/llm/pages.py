"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectorloom.llm.common import arrow_schema, arrow_stage, fresh_name, table

# What a page holds besides text: comments, tags (quoted attributes may hold ">"), declarations.
MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
RAW = {tag: re.compile(rf"</{tag}\b", re.IGNORECASE) for tag in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr img br picture source td th".split()
)
SPACING = frozenset("br td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements whose start ends an open paragraph, and those that end an open one of their kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li tr tbody thead tfoot".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Elements that never hold main text.
DROPPED = frozenset(
    "head script style title noscript template button select option input textarea iframe object embed svg canvas audio"
    " video map noembed noframes datalist".split()
)
# Elements, roles and names that tell of boilerplate. All but comments and elements of such a
# kind are outweighed by holding most of the text.
MARKED_TAGS = frozenset("nav footer aside form dialog menu search header".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments reply replies disqus respond discussion".split())
MARKED_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar menu"
    " nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup"
    " modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget"
    " toolbar pagination pager login copyright topbar outbrain taboola paywall disclaimer skip".split()
)
# Words that a name of boilerplate may hold besides: "site-footer" is one, "share-price" is not.
NEUTRAL_NAMES = frozenset(
    "area articles bar block bottom box btn buttons col column container content desktop fixed form global group header holder"
    " icons inner item items left link links list main mobile module outer page panel post posts primary right row secondary"
    " section side site slot sticky strip thread title top unit wrap wrapper zone".split()
)
CONTENT = frozenset({"article", "main"})
CONTENT_WEIGHT = 3.0  # of paths in an article or main element that holds most of the text
# Elements that are parts of a text, so the content is what stands around them.
PARTS = frozenset("p li ul ol dl dt dd blockquote pre figure figcaption".split()) | HEADINGS
PAGE = frozenset({"body", "html", "#root"})
FEW = 300  # characters that marked elements hold at least, and the page beside them at most, to be content after all
WORD = re.compile(r"[A-Za-z]+")
HUMP = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
PUNCTUATION = re.compile(r"[,.;:!?…、。，！？；：]")


@dataclass
class Element:
    tag: str
    parent: Element | None
    path: str
    dropped: bool
    mark: str = ""  # "kind" or "name" of boilerplate
    content: bool = False  # an article or main element
    held: int = 0  # characters outside of links
    weight: float = 0.0


@dataclass
class Block:
    owner: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _words(token: str) -> list[str]:
    """The words of one name, parted by signs or by capitals."""
    words: list[str] = []
    for part in WORD.findall(token):
        known = part.lower() in MARKED_NAMES or part.lower() in NEUTRAL_NAMES
        words += [part] if known else HUMP.findall(part)
    return [w.lower() for w in words if len(w) > 1]


def _described(attrs: str) -> tuple[str, str, str, bool]:
    """Class text of a tag, its role, the mark that its names give, and whether it is hidden.
    A name counts only if all its words are of boilerplate or neutral."""
    classes, role, mark, hidden = "", "", "", False
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            classes = value if name == "class" else classes
            for token in value.split():
                words = set(_words(token))
                if words & MARKED_NAMES and words <= MARKED_NAMES | NEUTRAL_NAMES and mark != "kind":
                    mark = "kind" if words & COMMENT_NAMES else "name"
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden = hidden or bool(HIDDEN.search(value))
        else:
            hidden = hidden or name == "hidden" or value.lower() == "true"
    return classes, "kind" if role in MARKED_ROLES else role, mark, hidden


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order, with the element each stands in. Broken markup is fine:
    unclosed elements end where HTML says they do, or with their parent."""
    root = Element("#root", None, "", False)
    stack = [root]
    blocks: list[Block] = []
    current: Block | None = None
    links = 0

    def add(text: str) -> None:
        nonlocal current
        owner = stack[-1]
        while owner.tag in INLINE:
            owner = owner.parent
        if current is None or current.owner is not owner:
            current = Block(owner)
            blocks.append(current)
        current.pieces.append(text)
        if links:
            current.linked += len(text.strip())

    def pop_to(index: int) -> None:
        nonlocal links
        for e in stack[index:]:
            links -= e.tag == "a"
        del stack[index:]

    at = 0
    while True:
        m = MARKUP.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            add(unescape(text) if "&" in text else text)
        if m is None:
            break
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            places = [k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag]
            inside = tag not in INLINE or not places or all(e.tag in INLINE for e in stack[places[0] :])
            if places and inside:
                pop_to(places[0])
            if tag not in INLINE:
                current = None
            continue
        if tag in ENDS_P:
            places = [k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p"]
            if places and all(e.tag in INLINE for e in stack[places[0] + 1 :]):
                pop_to(places[0])
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPES[tag]:
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    pop_to(k)
                    break
        if tag == "body":
            while len(stack) > 1 and stack[-1].tag != "html":
                pop_to(len(stack) - 1)
        elif stack[-1].tag == "head" and tag not in ("script", "style", "title", "meta", "link", "base", "noscript", "template"):
            pop_to(len(stack) - 1)
        if tag in SPACING:
            add(" ")
        if tag in VOID:
            if tag not in INLINE:
                current = None
            continue
        parent = stack[-1]
        classes, role, mark, hidden = _described(m["attrs"]) if len(m["attrs"]) > 1 else ("", "", "", False)
        within = tag == "header" and any(e.content for e in stack)
        if role == "kind" or (tag in MARKED_TAGS and not within):
            mark = "kind"
        element = Element(
            tag, parent,
            parent.path if tag in INLINE else f"{parent.path}/{tag}.{classes}" if classes else f"{parent.path}/{tag}",
            parent.dropped or hidden or tag in DROPPED, "" if tag in PAGE else mark, tag in CONTENT or role in CONTENT,
        )
        stack.append(element)
        links += tag == "a"
        if tag not in INLINE:
            current = None
        if tag in RAW and m["attrs"][-2:] != "/>":
            end = RAW[tag].search(html, at)
            at = end.start() if end else len(html)
    kept = []
    for block in blocks:
        block.text = " ".join("".join(block.pieces).split())
        if block.text and not block.owner.dropped:
            kept.append(block)
    return kept


def _above(element: Element) -> Iterator[Element]:
    """The element and all that it stands in."""
    e: Element | None = element
    while e is not None:
        yield e
        e = e.parent


def _unlinked(block: Block) -> int:
    return max(len(block.text) - block.linked, 0)


def _unmarked(blocks: list[Block]) -> list[Block]:
    """The blocks that stand in no marked element, after marks are lifted from elements that
    are the content of the page all the same, and hold ``FEW`` characters at least. A name is
    lifted from what holds more than half of the text, unless an article or main element elsewhere holds a quarter as much; kinds
    (navigation, footers, forms, comments), which often are longer than the text, only if
    next to nothing stands outside."""
    marked: dict[int, Element] = {}
    total = 0
    for b in blocks:
        size = _unlinked(b)
        total += size
        for e in _above(b.owner):
            e.held += size
            if e.mark:
                marked[id(e)] = e
    for e in marked.values():
        if e.mark == "kind" and e.held >= FEW and total - e.held < min(FEW, e.held / 8):
            e.mark = ""
    rest = [b for b in blocks if not any(e.mark == "kind" for e in _above(b.owner))]
    total = sum(map(_unlinked, rest))
    for top in [e for e in marked.values() if e.mark == "name"]:
        own = sum(_unlinked(b) for b in rest if _below(b.owner, top)) if 2 * top.held > total else 0
        if own >= FEW and 2 * own > total:
            others = (b for b in rest if any(e.content for e in _above(b.owner)) and not any(e.mark for e in _above(b.owner)))
            if 4 * sum(map(_unlinked, others)) < own:
                top.mark = ""
    return [b for b in rest if not any(e.mark for e in _above(b.owner))]


def _smoothed(values: list[float]) -> list[float]:
    """A Gaussian of radius one over values in page order."""
    near = 0.6065306597126334  # exp(-1/2)
    padded = [values[0], *values, values[-1]]
    return [(near * (a + c) + b) / (1 + 2 * near) for a, b, c in zip(padded, padded[1:], padded[2:])]


def _deviation(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def path_scores(blocks: list[Block]) -> dict[str, float]:
    """Per tag path: text length per node and punctuation per node, each smoothed over the
    paths in page order, fused by their product."""
    sums: dict[str, list[float]] = {}
    for block in blocks:
        entry = sums.setdefault(block.owner.path, [0.0, 0.0, 0.0])
        entry[0] += _unlinked(block)
        entry[1] += len(PUNCTUATION.findall(block.text)) * (1 if block.linked * 2 < len(block.text) else 0)
        entry[2] += 1
    length = [s[0] / s[2] for s in sums.values()]
    marks = [s[1] / s[2] for s in sums.values()]
    # smoothing only lowers, so that a lone path beside the content does not rise with it
    length, marks = ([0.5 * v + 0.5 * min(v, s) for v, s in zip(own, _smoothed(own))] for own in (length, marks))
    return {path: n * (p + 0.1) for path, n, p in zip(sums, length, marks)}


def _own_content(blocks: list[Block]) -> Element | None:
    """The innermost article or main element that holds at least half of the text, if any."""
    held: dict[int, list] = {}
    for b in blocks:
        for e in _above(b.owner):
            if e.content:
                held.setdefault(id(e), [e, 0])[1] += _unlinked(b)
    total = sum(map(_unlinked, blocks))
    most = [h[0] for h in held.values() if 2 * h[1] >= total > 0]
    return max(most, key=lambda e: sum(1 for _ in _above(e)), default=None)


def main_blocks(blocks: list[Block]) -> list[Block]:
    """The content nodes among the blocks of a page: those of a high path score, and what
    stands around them in the element that holds nearly all of the score."""
    blocks = _unmarked(blocks)
    if not blocks:
        return []
    own = _own_content(blocks)
    scores = path_scores(blocks)
    values = [scores[b.owner.path] * (CONTENT_WEIGHT if own and _below(b.owner, own) else 1.0) for b in blocks]
    limit = min(_deviation(values) * 0.5, max(values)) if len(values) > 1 else 0.0
    chosen = [(b, v) for b, v in zip(blocks, values) if v >= limit and v > 0] or list(zip(blocks, values))
    # the deepest element that holds nearly all of the chosen text
    total = 0.0
    for b, v in chosen:
        weight = max(_unlinked(b), 1) * (v + 1e-9)
        total += weight
        for e in _above(b.owner):
            e.weight += weight
    top = max(chosen, key=lambda c: c[0].owner.weight)[0].owner
    while top.parent is not None and top.weight < 0.8 * total:
        top = top.parent
    if own is not None and own.tag != "main" and _below(top, own):
        top = own
    leaf = top.tag not in CONTENT and all(b.owner is top for b, _ in chosen if _below(b.owner, top))
    if leaf and top.parent is not None and top.parent.tag not in PAGE:
        top = top.parent
    while top.tag in PARTS and top.parent is not None:
        top = top.parent
    inside = [k for k, b in enumerate(blocks) if _below(b.owner, top)]
    marked = {id(b) for b, _ in chosen}
    order = [k for k in inside if id(blocks[k]) in marked]
    first, last = (order[0], order[-1]) if order else (inside[0], inside[-1])
    if top.tag in PAGE:  # what stands beside the text is part of it only where it is no section of its own
        while first > 0 and blocks[first - 1].owner.tag in HEADINGS and blocks[first - 1].owner.parent is blocks[first].owner.parent:
            first -= 1
        while last + 1 < len(blocks) and not _linked(blocks[last + 1]) and _part_of(blocks[last + 1].owner, top):
            last += 1
    else:
        first, last = inside[0], inside[-1]
        while first > 0 and blocks[first - 1].owner.tag in HEADINGS and blocks[first - 1].owner.parent is top.parent:
            first -= 1
            inside.insert(0, first)
    result = []
    for k in inside:
        b = blocks[k]
        if id(b) in marked or (first <= k <= last and (b.owner.tag in HEADINGS or not _linked(b))):
            result.append(b)
    return result


def _linked(block: Block) -> bool:
    return block.linked * 2 >= len(block.text)


def _part_of(element: Element, top: Element) -> bool:
    """Whether only parts of a text stand between the two."""
    return _below(element, top) and all(e.tag in PARTS for e in _above(element) if e is not top and _below(e, top))


def _below(element: Element, top: Element) -> bool:
    return any(e is top for e in _above(element))


def main_text(html: str) -> str:
    """The main text of a page: content blocks in page order, one per line."""
    return "\n".join(b.text for b in main_blocks(blocks_of(html)))


# --- on tables ------------------------------------------------------------------------


def _extract(kinds: str):
    target = arrow_schema(kinds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py() or "") for h in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], schema=target)

    return run


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col`` and with ``text_col``, one row per row, no shuffle.

    A null or empty page, and one without content, has an empty text. Other columns stay as
    they are; one named like ``text_col`` is replaced.
    """
    kept = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept])
    name = fresh_name(rows, "_html")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{text_col}` string"])
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(html_col).alias(name))
    return arrow_stage(source, _extract(schema), schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))

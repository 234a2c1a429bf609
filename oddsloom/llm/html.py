"""Main text of pages by deducing the template that pages of a host share.

A token is a tag or a word with the path of elements that it stands in. Tokens that occur equally often as each
other in every page of a group form an equivalence class. A class is valid if its tokens come in the same order in
each occurrence, and if its occurrences nest with those of other valid classes; valid classes are the template, what
lies between their tokens are slots. The template's tags that a page has once divide it into slots; the one that
holds the most words of the group's pages, and the element of the template around it, is the article. Template text in
it goes; what is left in its slots is the text, without elements that say by tag or class that they are something else.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize
from .urls import url_parts

GROUP = 32  # pages of a host whose template is deduced together, in expectation
LEAST_PAGES = 2  # different pages that a token must be in, at the same place, to be of the template
LEAST_TEXT_PAGES = 4  # the same for text

PIECE = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|head)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
)
ATTRIBUTE = re.compile(r"(?is)\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, and words of class, id or role, of what isn't the article.
OTHER_TAGS = frozenset("nav footer aside form button dialog menu".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation sidebar footer header masthead cookie cookies consent notice notices alert"
    " newsletter subscribe subscription signup popup modal overlay comment comments discussion reply replies share sharing social related breadcrumb breadcrumbs widget disclaimer login search toolbar".split()
)
#: Further parts of such a name; one with a part that is in neither, such as share-price, says nothing.
PLAIN_WORDS = frozenset("area bar block box button buttons container content group inner item items link links list outer panel section site top bottom left right wrap wrapper".split())
ARTICLE = frozenset(("article", "main"))
CONTAINERS = frozenset("article main section div td body html".split())
PARTS = re.compile(r"[a-z]+")


def names_other(name: str) -> bool:
    parts = set(PARTS.findall(name))
    return bool(parts & OTHER_WORDS) and parts <= OTHER_WORDS | PLAIN_WORDS


class Block:
    __slots__ = ("path", "parts", "other", "article", "linked", "_text", "_words")

    def __init__(self, path: str, other: bool, article: bool):
        self.path, self.parts, self.other, self.article, self.linked, self._text = path, [], other, article, True, None
        self._words: list[str] | None = None

    def text(self) -> str:
        """Of a block that is complete."""
        if self._text is None:
            self._words = unescape("".join(self.parts)).split()
            self._text = " ".join(self._words)
        return self._text

    def words(self) -> list[str]:
        self.text()
        return self._words


def is_other(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in OTHER_TAGS or tag == "header" and not in_article:
        return True
    if tag in ARTICLE or tag in ("body", "html"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        if any(map(names_other, (m[2] or m[3] or m[4] or "").lower().split())):
            return True
    return False


def label(tag: str, attributes: str) -> str:
    """The tag with its class or id, which tell siblings apart."""
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[2] or m[3] or m[4] or "").split()
        if name and m[1].lower() != "role":
            return f"{tag}.{name[0].lower().replace('/', '').replace('<', '')}"
    return tag


def plain(token: str) -> str:
    """The tag of an open tag's token."""
    return token.rpartition("<")[2].partition(".")[0]


def parse(html: str) -> tuple[list[Block], list[tuple[str, Block | None]]]:
    """Blocks in page order, and tags (with paths) and blocks as they come. Unclosed and cut off elements end with the page."""
    blocks: list[Block] = []
    events: list[tuple[str, Block | None]] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, not the article's, in the article
    block: Block | None = None
    links, at = 0, 0

    def add(raw: str) -> None:
        nonlocal block
        if block is None:
            if not raw.strip():
                return
            _, path, other, article = stack[-1]
            block = Block(path, other, article)
            blocks.append(block)
            events.append(("", block))
        block.parts.append(raw)
        if not links and raw.strip():
            block.linked = False

    for m in PIECE.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in INLINE and not is_other(tag, m[4], stack[-1][3]) and (not m[2] or all(x[0] != tag for x in stack)):
            if tag == "a":
                links = max(0, links - 1) if m[2] else links + 1
            continue
        block = None
        if m[2]:
            name = tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    name = stack[i][1].rpartition("/")[2]
                    del stack[i:]
                    links = 0
                    break
            events.append((f"{stack[-1][1]}</{name}", None))
            continue
        if tag in ENDS_P and any(x[0] == "p" for x in stack[-2:]):
            while stack.pop()[0] != "p":
                pass
        closes = SELF_CLOSING.get(tag)
        if closes and stack[-1][0] in closes:
            stack.pop()
        _, path, other, article = stack[-1]
        name = label(tag, m[4])
        events.append((f"{path}<{name}", None))
        if tag not in VOID:
            links = 0
            stack.append((tag, f"{path}/{name}", other or is_other(tag, m[4], article), article or tag in ARTICLE))
    if at < len(html):
        tail = html[at:]
        cut = re.search(r"<[a-zA-Z/!?]?[^<>]*\Z", tail)
        add(tail[: cut.start()] if cut else tail)
    return blocks, events


def tokens(events: list[tuple[str, Block | None]]) -> list[tuple[str, str]]:
    """Tags as (tag with path, ""), words as (path, word), and before its words each block of several as (path and a space, text)."""
    out: list[tuple[str, str]] = []
    for tag, block in events:
        if block is None:
            out.append((tag, ""))
        else:
            words = block.words()
            if len(words) > 1:
                out.append((f"{block.path} ", block.text()))
            out.extend((block.path, w) for w in words)
    return out


def template(pages: list[list[tuple[str, str]]]) -> set[tuple[str, str]]:
    """Tokens of the valid equivalence classes of different pages that at least half of them have: LEAST_PAGES, and for text LEAST_TEXT_PAGES."""
    least = max(LEAST_PAGES, (len(pages) + 1) // 2)
    if len(pages) < least:
        return set()
    least_text = max(LEAST_TEXT_PAGES, least)
    counts = [Counter(p) for p in pages]
    support = Counter(t for c in counts for t in c)
    classes: dict[tuple[int, ...], set[tuple[str, str]]] = defaultdict(set)
    for t, n in support.items():
        if n >= (least_text if t[1] else least):
            classes[tuple(c.get(t, 0) for c in counts)].add(t)
    # A word on its own is no template.
    classes = {v: m for v, m in classes.items() if len(m) > 1 or not next(iter(m))[1] or " " in next(iter(m))[1]}
    members = set().union(*classes.values())
    pages = [[t for t in p if t in members] for p in pages]
    valid: list[set[tuple[str, str]]] = []
    for _, members in sorted(classes.items(), key=lambda x: (-sum(map(bool, x[0])), sum(x[0]), -len(x[1]), min(x[1]))):
        members = ordered(members, pages)
        if members and all(nests(members, other, pages) for other in valid):
            valid.append(members)
    return set().union(*valid)


def ordered(members: set[tuple[str, str]], pages: list[list[tuple[str, str]]]) -> set[tuple[str, str]]:
    """The class, if its tokens come in one order in every occurrence; else the part of it that are tags, if those do; else nothing."""
    first: list[tuple[str, str]] | None = None
    for page in pages:
        mine = [t for t in page if t in members]
        for at in range(0, len(mine), len(members)):
            turn = mine[at : at + len(members)]
            first = first or turn
            if turn != first:
                tags = {t for t in members if not t[1]}
                return ordered(tags, pages) if tags and len(tags) < len(members) else set()
    return members


def nests(a: set[tuple[str, str]], b: set[tuple[str, str]], pages: list[list[tuple[str, str]]]) -> bool:
    """Whether each occurrence of one class lies in a single slot of the other, in every page."""

    def inside(x: set, y: set) -> bool:
        for page in pages:
            seen_x, seen_y, slot = 0, 0, 0
            for t in page:
                if t in y:
                    seen_y += 1
                elif t in x:
                    if seen_x % len(x) == 0:
                        slot = seen_y
                    elif slot != seen_y:
                        return False
                    seen_x += 1
        return True

    return inside(a, b) or inside(b, a)


class Slots:
    """Slots of a page: its blocks with the token of the skeleton before them and the skeleton's elements that are open there."""

    def __init__(self, events: list[tuple[str, Block | None]], skeleton: set[str]):
        self.found: list[tuple[Block, str, tuple[str, ...]]] = []
        last, within = "", []
        for tag, block in events:
            if block is not None:
                self.found.append((block, last, tuple(within)))
            elif tag in skeleton:
                last = tag
                path, _, name = tag.rpartition("<")
                if not name.startswith("/"):
                    within.append(tag)
                elif f"{path}<{name[1:]}" in within:
                    del within[within.index(f"{path}<{name[1:]}") :]
            elif within and tag.partition("</")[1]:
                path, _, name = tag.rpartition("</")
                if f"{path}<{name}" in within:
                    del within[within.index(f"{path}<{name}") :]


def article_of(pages: list[list[tuple[str, Block | None]]], shared: set[tuple[str, str]]) -> tuple[list[Slots], str | None]:
    """(slots of each page, element): of the template's tags that no page has twice, the innermost container around the slot with the most words.

    Words of links and of template text don't count; equal slots go to one in an article, then to the first by name.
    """
    skeleton = {t for t, text in shared if not text}
    for events in pages:
        skeleton -= {t for t, n in Counter([tag for tag, block in events if block is None and tag in skeleton]).items() if n > 1}
    slots = [Slots(events, skeleton) for events in pages]
    words: Counter[str] = Counter()
    around: dict[str, tuple[str, ...]] = {}
    for page in slots:
        for block, last, within in page.found:
            if not block.linked and not fixed(block, shared):
                words[last] += len(block.words())
            around.setdefault(last, within)
    for slot, _ in sorted(words.items(), key=lambda x: (-x[1], not any(plain(t) in ARTICLE for t in around[x[0]]), x[0])):
        for tag in reversed(around[slot]):
            if plain(tag) in CONTAINERS:
                return slots, tag
    return slots, None


def fixed(b: Block, shared: set[tuple[str, str]]) -> bool:
    """Whether a block is template text, as a whole or word by word."""
    t = b.text()
    return bool(t) and ((f"{b.path} ", t) in shared or all((b.path, w) in shared for w in b.words()))


def main_texts(pages: list[str]) -> list[str]:
    """Text of each of some pages of one host. Equal pages count once for the template."""
    parsed = {p: parse(p) for p in pages}
    shared = template([tokens(events) for _, events in parsed.values()])
    slots, element = article_of([events for _, events in parsed.values()], shared)
    texts = {}
    for (html, (blocks, _)), page in zip(parsed.items(), slots):
        own = [b for b, _, within in page.found if element in within] if element else []
        some = [b for b in own if b.text() and not b.other]
        if not any(not fixed(b, shared) for b in some):  # no template, or a page without its slots: by tags alone
            free = [b for b in blocks if b.text() and not b.other]
            some = [b for b in free if b.article] or [b for b in free if not (b.linked and re.search(r"/li\b", b.path))]
        if any(not fixed(b, shared) for b in some):
            # A single word is too little to be told from the article's own; an article that is template as a whole is a repeated one.
            some = [b for b in some if not fixed(b, shared) or b.article and " " not in b.text()]
        texts[html] = " ".join(b.text() for b in some)
    return [texts[p] for p in pages]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """Main text of each page: (id_col, url_col, text, n_chars), one row per input row.

    text: blocks of the article in page order, joined by a space, character references decoded, white space within
    a block made one space; empty if none. Null and empty html give an empty text; pages without a host share one.
    A host's pages are dealt by hash of id and html into groups of about group pages, each of which deduces its
    template, so no host is gathered in one task. A page that differs from no other of its host has no template, and
    its article is told by tags alone, as is that of a page without the template's slots. Equal rows fall into one group
    and get the same text; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    host, _ = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"), host.alias("_host"))
    sizes = materialize(rows.groupBy("_host").agg(F.ceil(F.count("*") / group).alias("_groups")), "hosts")  # so that its size is known to the join
    dealt = rows.join(sizes, "_host").withColumn("_group", F.pmod(F.xxhash64("_id", "_html"), F.col("_groups")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = main_texts(pdf["_html"].tolist())
        return pd.DataFrame({"_id": pdf["_id"].astype("Int64"), "_url": pdf["_url"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = dealt.groupBy("_host", "_group").applyInPandas(run, "_id long, _url string, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_url": url_col})


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

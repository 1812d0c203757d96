"""HTML extraction by wrapper induction.

Pages of one host are aligned in groups: every page's DOM tree is matched with the group's first by simple tree
matching. A text that stands at one matched node in most of the group's different articles is template; varying text
is a slot. Pages with the same article text (that of their named article, else all of the page's) count once. The
slot region that holds most of the varying text is the content; a named article (``article``, ``main``) that holds it or
lies within it gives its bounds, one elsewhere on the page (a teaser) does not. Elements that are no article by their tag, class, id or role go in any case: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments.

A host's pages are dealt into groups of about ``GROUP`` by a hash of the page, so a hot host is many groups, each
page in exactly one; a host with one page is judged by tags and text alone. Pages are shuffled once.

Defined results: null and empty html give an empty text; pages without a host form a host of their own; repeated
pages get a row each; a named article that would lose all its text as template keeps it; html without any tag is one
block.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare, table
from .dom import INLINE, Matcher, Node, parse
from .common import by_key as _by_key

GROUP = 96
#: Different pages that must share a text at a node, and their share of the group, for it to be template.
SAME, SHARE = 3, 0.5
#: Share of a region's varying text that one child needs to become the region.
MOST = 0.6
#: Hosts up to which their page counts are broadcast (a short name and a number each) instead of joined by a shuffle.
BROADCAST_HOSTS = 20_000

_DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select option input textarea iframe object embed svg canvas audio video map menu dialog datalist title link meta".split()
)
#: Names of what is no article, as a whole class or id, or as its first or last part.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner banners sponsor sponsored sponsors promo promos promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs"
    " pagination pager masthead footer sidebar sidebars widget widgets cookie cookies consent gdpr popup popups modal modals overlay overlays comments commentlist disqus newsletter newsletters toolbar".split()
)
#: Names that an article's own parts can have too: as a whole, or before one of the second words.
_WEAK = frozenset(
    "header foot side notice notices notification notifications alert alerts comment reply replies respond share sharing social related recommended subscribe subscription signup login search skip hidden".split()
)
_PARTS = frozenset("bar block box button buttons container form icons links link list nav panel posts articles stories section widget wrapper area content text message input field item items".split())


def _named_out(names: str) -> bool:
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if parts and (name in _WEAK or parts[0] in _NAMES or parts[-1] in _NAMES or (parts[0] in _WEAK and len(parts) > 1 and parts[-1] in _PARTS and parts[0] != "hidden")):
            return True
    return False


_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
_KEPT = frozenset(("article", "main", "body", "html", "#root"))


def dropped(node: Node) -> bool:
    """Whether the element is no part of an article, by its own tag and names."""
    if node.tag in _DROPPED:
        return True
    if not node.attributes or node.tag in _KEPT:
        return False
    if node.attribute("role").lower() in _ROLES or node.attribute("aria-hidden").lower() == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", node.attributes) or re.search(r"display\s*:\s*none", node.attributes):
        return True
    return _named_out(node.attribute("class", "id"))


class Block:
    """A run of text within one block element."""

    __slots__ = ("holder", "linked", "text")

    def __init__(self, text: str, holder: Node, linked: int):
        self.text, self.holder, self.linked = text, holder, linked


def blocks(root: Node) -> list[Block]:
    """The page's blocks in order, without dropped elements: references decoded, white space made single spaces."""
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0

    def flush(holder: Node) -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            out.append(Block(text, holder, linked))
        pieces.clear()
        linked = 0

    # Items: a child to visit with the block that holds it and whether it is in a link, or the end of a block.
    stack: list[tuple] = [(root, root, False)]
    while stack:
        item, holder, link = stack.pop()
        if item is None:
            flush(holder)
        elif type(item) is str:
            pieces.append(item)
            if link:
                linked += len(item.strip())
        elif not dropped(item):
            if item.tag == "br":
                pieces.append(" ")
                continue
            link = link or item.tag == "a"
            if item.tag not in INLINE:
                flush(holder)
                holder = item
                stack.append((None, item, link))
            stack += [(c, holder, link) for c in reversed(item.children)]
    flush(root)
    return out


def _up(node: Node) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _lists_of_links(found: list[Block]) -> set[int]:
    """Ids of lists whose items are nothing but links: menus without a name."""
    seen: dict[int, list[bool]] = {}
    for b in found:
        if b.holder.tag in ("li", "dd", "td"):
            up = next((n for n in _up(b.holder) if n.tag in ("ul", "ol", "dl", "table")), None)
            if up is not None:
                seen.setdefault(id(up), []).append(b.linked >= 0.8 * len(b.text))
    return {k for k, v in seen.items() if len(v) > 1 and all(v)}


class Page:
    def __init__(self, text: str | None):
        self.root = parse(text) if text else Node("#root")
        found = blocks(self.root)
        # a list of links is a menu, unless it stands in an article
        menus = _lists_of_links([b for b in found if not any(n.tag == "article" or "articleBody" in n.attributes for n in _up(b.holder))])
        self.blocks = [b for b in found if not (menus and any(id(n) in menus for n in _up(b.holder)))]


def _named(found: list[Block], mass: Counter) -> list[Block]:
    """Blocks within the page's large named articles, else within its named main part, else none."""
    for names in ("article",), ("main",):
        named: dict[int, Node] = {}
        for b in found:
            for n in _up(b.holder):
                if n.tag in names or (names == ("main",) and n.attribute("role").lower() == "main") or "articleBody" in n.attributes:
                    named[id(n)] = n
        if named:
            best = max(mass[k] for k in named)
            large = {k for k in named if mass[k] >= 0.5 * best}
            return [b for b in found if any(id(n) in large for n in _up(b.holder))]
    return []


def _region(mass: Counter, node: Node, children) -> Node:
    """Follow the child that holds most of the text, as long as there is one."""
    while True:
        best = max(children(node), key=lambda c: mass[id(c)], default=None)
        if best is None or mass[id(best)] < MOST * mass[id(node)] or mass[id(best)] == 0 or best.tag in ("p", "h1", "h2", "h3", "li"):
            return node
        node = best


def _mass(found: list[Block], to=lambda n: n) -> Counter:
    mass: Counter = Counter()
    for b in found:
        for n in _up(b.holder):
            mass[id(to(n))] += len(b.text) - b.linked if to(n) is not None else 0
    return mass


def extract_group(pages: list[str | None]) -> list[str]:
    """The main text of each page of one host."""
    read: dict[str | None, Page] = {p: Page(p) for p in dict.fromkeys(pages)}
    parsed = [read[p] for p in pages]
    first: dict[str, int] = {}
    for k, p in enumerate(pages):
        if p:
            first.setdefault(p, k)
    different = list(first.values())
    matcher = Matcher()
    aligned: list[dict[int, Node]] = [{} for _ in pages]
    told: dict[int, Counter] = {}
    region = None
    articles = {k: _named(parsed[k].blocks, _mass(parsed[k].blocks)) for k in different}
    contents: dict[tuple[str, ...], dict[int, set[str]]] = {}
    least = 0.0
    if len(different) > 1:
        guide = parsed[different[0]].root
        total: Counter = Counter()
        for k in different:
            aligned[k] = matcher.align(guide, parsed[k].root)
            here = contents.setdefault(tuple(b.text for b in articles[k] or parsed[k].blocks), {})
            for b in parsed[k].blocks:
                if (at := aligned[k].get(id(b.holder))) is not None:
                    here.setdefault(id(at), set()).add(b.text)
        for here in contents.values():
            for at, texts in here.items():
                told.setdefault(at, Counter()).update(texts)
        least = max(SAME, SHARE * len(contents))
        for k in different:
            varying = [b for b in parsed[k].blocks if not _constant(b, aligned[k], told, least)]
            total.update(_mass(varying, lambda n, a=aligned[k]: a.get(id(n))))
        region = _region(total, guide, lambda n: n.elements())
    out: dict[str, str] = {}
    for k in different:
        page = parsed[k]
        found = [b for b in page.blocks if not _constant(b, aligned[k], told, least)]
        kept = {id(b) for b in found}
        if articles[k] and not any(id(b) in kept for b in articles[k]):
            found = articles[k]
        out[pages[k]] = "\n".join(b.text for b in _content(found, page.root, aligned[k], region))
    return [out[p] if p else "" for p in pages]


def _constant(block: Block, aligned: dict[int, Node], told: dict[int, Counter], least: float) -> bool:
    at = aligned.get(id(block.holder))
    return at is not None and told.get(id(at), {}).get(block.text, 0) >= least


def _content(found: list[Block], root: Node, aligned: dict[int, Node], region: Node | None) -> list[Block]:
    """Blocks within the region that the aligned trees give, widened or narrowed to a named article that holds it or
    lies within; without a region, within the named article, else within the page's own region."""
    if not found:
        return found
    mass = _mass(found)
    inside = [b for b in found if any(aligned.get(id(n)) is region for n in _up(b.holder))] if region is not None else []
    named = _named(found, mass)
    if named and (not inside or {id(b) for b in named} & {id(b) for b in inside}):
        return named
    if inside:
        return inside
    own = _region(mass, root, lambda n: n.elements())
    return [b for b in found if any(n is own for n in _up(b.holder))]


def main_texts(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), group: int = GROUP) -> DataFrame:
    """``keep`` and text, the main text of every row of ``pages`` (url, html)."""
    prepare(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))
    named = pages.select(*keep, F.col("html").alias("_html_"), host.alias("_host_"), F.xxhash64("url", *(c for c in keep if c != "url")).alias("_hash_"))
    counts = materialise(named.groupBy("_host_").agg(F.count("*").alias("n")).select("_host_", F.expr(f"(n - 1) div {group} + 1").alias("_parts_")).where("_parts_ > 1"))
    small = counts.count() <= BROADCAST_HOSTS
    joined = named.join(F.broadcast(counts) if small else counts, "_host_", "left")
    dealt = joined.select(F.xxhash64("_host_", F.pmod("_hash_", F.coalesce("_parts_", F.lit(1)))).alias("_group_"), "_html_", "_host_", "_hash_", *keep)
    kinds = dict(pages.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            texts = extract_group(rows.column("_html_").to_pylist())
            yield from pa.table([*(rows.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "text"]).to_batches()

    ordered = dealt.repartition("_group_").sortWithinPartitions("_group_", "_hash_", "_html_")
    return ordered.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    found = main_texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

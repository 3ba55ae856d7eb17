"""Main text of HTML pages: site template removal by counting hashed element subtrees per host.

A page is parsed once into the blocks of its whole body. Each names the subtrees around it: every element outside of the
main region (article, else main, else body), containers inside of it, and every element of a page that marks no region.
Their hashes are counted per host, once for each different main region, so that copies of one article don't make its
parts a template. Subtrees that recur on many of a host's pages are deleted with all their blocks. What recurs on few
pages goes by two plainer rules: elements that are never main text by their kind (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments), and everything outside a marked region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import durable, lookup

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|textarea|title|xmp|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>]*\Z",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr input link meta".split())
_NEVER = frozenset("nav header footer aside form button select option datalist dialog menu head fieldset legend canvas audio video applet frameset".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead tfoot caption figcaption summary address hgroup hr br".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt tr td th".split())
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_REGION = frozenset(["article", "main"])
_WHOLE = frozenset(["html", "body", "article", "main"])
_NOT_TEXT = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist "
    "reply replies respond discussion disqus related recommended recommendations widget pagination pager skip login search toolbar".split()
)
_PLAIN = frozenset(
    "article bar block body bottom box button buttons col column container content field fixed float form global header icon icons inline inner item items left link links list main "
    "mobile outer page panel post posts primary reader right section secondary site small sticky story text thread title top user users wrap wrapper".split()
)
_HEADERS = frozenset(["header", "site-header", "page-header", "global-header", "top-header"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())


def _dropped(tag: str, attributes: str) -> tuple[bool, str]:
    """Whether an element is no main text by its kind, and its role. A class counts if all its parts say so or say nothing: related-links, not related-work."""
    if tag in _NEVER:
        return True, ""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, ""
    role = ""
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, ""
        if name == "role":
            role = value
            if value in _ROLES:
                return True, ""
        elif name in ("class", "id") and tag not in _WHOLE - {"article"}:
            for word in value.split():
                parts = [part for part in re.split(r"[-_0-9]+", word) if part]
                if word in _HEADERS or any(part in _NOT_TEXT for part in parts) and all(part in _NOT_TEXT or part in _PLAIN for part in parts):
                    return True, ""
    return False, role


KEEP, KIND, OUTSIDE = range(3)


class _Element:
    __slots__ = ("tag", "drop", "blocks", "counted", "inside", "heading")

    def __init__(self, tag: str, drop: bool, inside: bool, counted: bool, heading: bool = False):
        self.tag, self.drop, self.inside, self.counted, self.heading = tag, drop, inside, counted, heading
        self.blocks: list[tuple[str, list[int], int]] = []

    @property
    def rule(self) -> int:
        return KIND if self.drop else KEEP if self.inside else OUTSIDE


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(html: str) -> tuple[list[tuple[str, list[int]]], int]:
    """(blocks, hash of the main region's text): the blocks that no rule of their page drops, with their counted subtrees."""
    blocks, region = parse_body(html)
    return [(t, owners) for t, owners, rule in blocks if rule == KEEP], region


def parse_body(html: str) -> tuple[list[tuple[str, list[int], int]], int]:
    """(blocks, hash of the main region's text); a block is its text, the hashes of the counted subtrees around it, and the
    rule that drops it if none of them recurs: KEEP for none, KIND or OUTSIDE."""
    marked = {m.lower() for m in re.findall(r"<(article|main)\b|role\s*=\s*[\"']?(main)\b", html, re.I) for m in m if m}
    wanted = "article" if "article" in marked else "main" if "main" in marked else ""
    for choice in dict.fromkeys([wanted, "main" if "main" in marked else "", ""]):
        blocks = _collect(html, choice)
        if not choice or any(rule == KEEP for _, _, rule in blocks):
            break
    return blocks, _hash("\n".join(t for t, _, rule in blocks if rule == KEEP))


def _collect(html: str, wanted: str) -> list[tuple[str, list[int], int]]:
    stack = [_Element("", False, not wanted, False)]
    text: list[str] = []
    out: list[tuple[str, list[int], int]] = []

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                block = (joined, [], stack[-1].rule)
                out.append(block)
                for element in stack:
                    if element.counted:
                        element.blocks.append(block)
            text.clear()

    def close() -> None:
        element = stack.pop()
        if element.counted and element.blocks:
            own = element.rule
            h = _hash(element.tag + "\n" + "\n".join(t for t, _, rule in element.blocks if own != KEEP or rule == KEEP))
            for _, owners, _ in element.blocks:
                owners.append(h)

    def close_dropped(tag: str) -> None:
        """End the innermost open inline element of this tag; only dropped ones, and those inside of them, are on the stack."""
        for k in range(len(stack) - 1, 0, -1):
            if not stack[k].drop:
                break
            if stack[k].tag == tag:
                flush()
                while len(stack) > k:
                    close()
                break

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            text.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "hr":
            text.append(" ") if tag == "br" else flush()
            continue
        if tag in _VOID:
            continue
        inline = tag in _INLINE
        if m[2]:  # an end tag
            if inline:
                close_dropped(tag)
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    flush()
                    while len(stack) > k:
                        close()
                    break
            else:
                flush()
            continue
        drop, role = _dropped(tag, m[4])
        if tag == "a":  # links don't nest
            close_dropped(tag)
        if inline and not drop and not (stack[-1].drop and any(e.tag == tag for e in stack)):
            continue
        flush()
        if tag in _CLOSES_P and stack[-1].tag == "p":
            close()
        if tag in _SIBLINGS:
            ends, scope = _SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in scope:
                    break
                if stack[k].tag in ends:
                    while len(stack) > k:
                        close()
                    break
        if m[4].endswith("/") and tag not in _LEAVES and tag not in _WHOLE and tag != "div":
            continue
        top = stack[-1]
        region = tag == wanted or wanted == "main" and role == "main"
        inside = top.inside or region
        heading = top.heading and top.inside or wanted != "" and tag == "header" and inside and not top.drop
        gone = (drop or top.drop) and not (top.heading and tag in _HEADINGS and not drop)
        counted = not region and tag not in _WHOLE and tag != "head" and (gone or not inside or not wanted or tag not in _LEAVES)
        stack.append(_Element(tag, gone, inside, counted, heading and gone))
    if at < len(html):
        text.append(unescape(html[at:]))
    flush()
    while len(stack) > 1:
        close()
    return out


_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_BLOCK = pa.struct([("text", pa.string()), ("owners", pa.list_(pa.int64()))])


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, row, region, blocks, dropped, n_kind, n_outside): the blocks that no rule of their page drops with
    their counted subtrees, the counted subtrees of the others, and the code points that each rule takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, regions, dropped, taken = [], [], [], {KIND: [], OUTSIDE: []}
            for html in batch.column(2).to_pylist():
                blocks, region = parse_body(html or "")
                kept.append([{"text": t, "owners": owners} for t, owners, rule in blocks if rule == KEEP])
                dropped.append(sorted({h for _, owners, rule in blocks if rule != KEEP for h in owners}))
                regions.append(region)
                for rule, sums in taken.items():
                    sums.append(sum(len(t) for t, _, own in blocks if own == rule))
            columns = [pa.array(regions, pa.int64()), pa.array(kept, pa.list_(_BLOCK)), pa.array(dropped, pa.list_(pa.int64())), pa.array(taken[KIND], pa.int64()), pa.array(taken[OUTSIDE], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["page_id", "url", "region", "blocks", "dropped", "n_kind", "n_outside"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = rows.mapInArrow(run, "page_id long, url string, region long, blocks array<struct<text:string,owners:array<long>>>, dropped array<long>, n_kind long, n_outside long")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), _HOST, 1))
    return parsed.withColumn("row", F.monotonically_increasing_id()).withColumn("host", host)


def _templates(owned: DataFrame, parsed: DataFrame, share: float, least: int, many: int) -> DataFrame:
    """(host, owner, n, regions) of the subtrees of owned (host, owner, region) that recur."""
    counted = owned.select("host", "owner", "region").distinct().groupBy("host", "owner").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    sizes = parsed.select("host", "region").distinct().groupBy("host").agg(F.count("*").alias("regions"))
    return lookup(counted, sizes, ["host"], "regions").filter((F.col("n") >= share * F.col("regions")) | (F.col("n") >= many))


def site_templates(pages: DataFrame, share: float = 0.1, least: int = 3, many: int = 1000) -> DataFrame:
    """(host, owner, n, regions): every subtree of the bodies, menus and footers included, that recurs in n of a host's regions."""
    parsed = durable(_parsed(pages).drop("page_id", "url"), "subtrees")
    every = F.array_distinct(F.concat("dropped", F.flatten(F.transform("blocks", lambda b: b["owners"]))))
    return _templates(parsed.select("host", "region", F.explode(every).alias("owner")), parsed, share, least, many)


def extract(pages: DataFrame, share: float = 0.1, least: int = 3, many: int = 1000) -> DataFrame:
    """(page_id, url, text, n_chars, n_kind, n_outside) of every row of pages.

    A subtree is template if it recurs in at least `least` different regions and in `share` of the host's, or in `many` of
    them, so that a box of one section of a large host goes too. The last two columns are the code points of the blocks
    that went by their kind and as outside the region; what a rule drops isn't counted again here (site_templates counts
    all). A null page is empty; a null url is a host of its own; repeated rows stay; no rows give none.
    """
    owners = F.array_distinct(F.flatten(F.transform("blocks", lambda b: b["owners"])))
    parsed = durable(_parsed(pages).drop("dropped").withColumn("owners", owners), "pages")
    open_rows = parsed.filter(F.size("owners") > 0)
    owned = open_rows.select("row", "host", "region", F.explode("owners").alias("owner"))
    template = durable(_templates(owned, parsed, share, least, many).select("host", "owner", "n"), "templates")
    lost = lookup(owned.select("row", "host", "owner"), template, ["host", "owner"], "n").groupBy("row").agg(F.collect_set("owner").alias("template"))
    columns = ["page_id", "url", "n_kind", "n_outside"]
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["owners"], F.coalesce("template", F.array().cast("array<long>"))))
    cut = open_rows.join(lost, "row", "left").select(*columns, left.alias("blocks"))
    whole = parsed.filter(F.size("owners") == 0).select(*columns, "blocks")
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), " ")
    out = whole.unionByName(cut).withColumn("text", text)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_kind", "n_outside")

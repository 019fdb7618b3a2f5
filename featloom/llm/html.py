"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements. Pages of one host are folded into a wrapper: simple tree matching aligns the
children of two nodes in order, so that the number of matched nodes is largest; runs of equal siblings are one
repeating slot. A slot keeps how many pages have it and how much text and link text it holds. Tasks build a wrapper per host from the pages they hold, and wrappers of a host are folded into each other, in two
steps, so a very large host meets in a few rows. On how many different pages of its host a text stands at the same path of
elements is counted exactly, with partial sums.

A slot is template if its element or its class says so (menus, forms, notices, ...), if most of its text outside articles is link text, or
if one and the same text recurs in most pages of the host; what varies is content. Inside an article the words of `DOUBTFUL`
name no template. If a page has an article element outside comments, teasers and asides, only what lies in it counts, and
what is around it is no template, whatever its class says; else all content does. Articles inside an article's comments or
asides go with them.

Texts: character references are decoded, comments, scripts, styles and markup are dropped, white space inside a block
becomes one space, and blocks are joined by line breaks in page order.

Defined cases: null and empty pages have an empty text; a page without any element is one block; unclosed and stray
tags are tolerated; elements nested deeper than `DEEPEST` become children of the element at that depth, in page order,
each named by its outermost template or article below it, so that no text is lost; a null URL or one without a host belongs to the host of the empty name; repeated pages count once
where recurring texts are told from content; very long pages are read whole; further columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.core import col
from featloom.llm.base import ascii_lower, picked, query, stored, table

# Elements by their part in a page.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
             "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe object svg title select button canvas audio video".split())
DROPPED = set("nav header footer aside form menu dialog search fieldset".split()) | RAW
ARTICLE = set("article main".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "summary"}
MARKS = set("ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
            "sidebar aside widget notice notices cookie cookies consent gdpr alert popup modal overlay subscribe newsletter signup login form search share sharing social "
            "comment comments disqus reply replies respond related recommended pagination pager tags copyright legal skip toolbar topbar".split())
# Words that name template around an article, but may name its own parts inside.
DOUBTFUL = set("legal search header masthead copyright tags toolbar".split())
# Words and elements of what stands beside the article, even if it holds articles itself.
BESIDE = set("comment comments disqus reply replies respond related recommended sidebar aside widget teaser teasers".split())
BESIDE_TAGS = set("aside nav footer".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(script|style|textarea|title|noscript|iframe|template)\b[^>]*>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
MARK = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Depth of the tree of a page.
DEEPEST = 100
#: Different pages of a host, and share of them, that must have a text before it is template.
LEAST_PAGES, MOSTLY = 6, 0.6


class Node:
    __slots__ = ("holder", "key", "mark", "own", "tag")

    def __init__(self, tag: str, mark: str = ""):
        self.tag, self.mark = tag, mark
        self.key = f"{tag}.{mark}" if mark else tag
        # Texts of the blocks and child nodes, in page order; length of link text by block.
        self.own: list[tuple[str, int] | Node] = []
        # Below the deepest level: the element that says what the texts of this one are.
        self.holder: Node | None = None


def parsed(page: str) -> Node:
    """The tree of block elements; text runs between them are blocks."""
    root = Node("#page")
    stack, parts = [root], []
    linked = depth = 0
    raw_until: list[str] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and len(stack) - 1 > DEEPEST:
                held = Node(stack[-1].holder.tag, stack[-1].holder.mark)
                held.own.append((text, linked))
                stack[DEEPEST].own.append(held)
            elif text:
                stack[-1].own.append((text, linked))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not raw_until:
            text = html.unescape(text)
            parts.append(text)
            if depth:
                linked += len(text.strip())

    def close(names: set[str], stops: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stops:
                return
            if stack[i].tag in names:
                del stack[i:]
                return

    at = 0
    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        if m[1]:
            continue
        tag, attributes = (m[4] or m[7] or "").lower(), m[5] or m[8] or ""
        if not tag:
            continue
        if m[3] or m[6]:
            if raw_until:
                if tag == raw_until[-1]:
                    raw_until.pop()
                elif tag in raw_until:
                    del raw_until[raw_until.index(tag) :]
            elif tag == "a":
                depth = 0
            elif tag in BLOCKS:
                flush()
                close({tag}, set())
            continue
        if tag == "body" and raw_until:
            raw_until.clear()
        if raw_until:
            if tag in RAW and tag not in VOID and not attributes.endswith("/"):
                raw_until.append(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                raw_until.append(tag)
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            depth = 1
        elif tag in BLOCKS:
            flush()
            depth = 0
            if tag in ENDS_P:
                close({"p"}, {"td", "th", "li", "div", "article", "section", "table"} - CLOSES.get(tag, set()))
            if tag in CLOSES:
                close(CLOSES[tag], STOPS.get(tag, {"article", "section", "div", "td", "th"}))
            if tag != "hr":
                mark = " ".join(sorted({v.strip("\"'").lower() if k.lower() == "role" else v.strip("\"'") for k, v in MARK.findall(attributes)})) if attributes else ""
                node = Node(tag, re.sub(r"\d+", "0", mark))
                if len(stack) > DEEPEST:
                    above = stack[-1].holder
                    weight = [0 if n is None else 2 if named_template(n.key) else n.tag in ARTICLE for n in (above, node)]
                    node.holder = above if above is not None and weight[0] >= max(weight[1], 1) else node
                else:
                    stack[-1].own.append(node)
                stack.append(node)
    say(page[at:])
    flush()
    return root


class Slot:
    """A node of a wrapper."""

    __slots__ = ("chars", "key", "kids", "links", "pages")

    def __init__(self, key: str):
        self.key, self.kids, self.pages, self.chars, self.links = key, [], 0, 0, 0

    def dump(self) -> list:
        return [self.key, self.pages, self.chars, self.links, [k.dump() for k in self.kids]]

    @classmethod
    def load(cls, data: list) -> Slot:
        out = cls(data[0])
        out.pages, out.chars, out.links = data[1:4]
        out.kids = [cls.load(k) for k in data[4]]
        return out


def aligned(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Simple tree matching of two ordered lists of children: the pairs of a largest matching."""
    if [x.key for x in a] == [y.key for y in b]:
        return [(i, i) for i in range(len(a))]
    return _alignment(a, b)[0]


def _alignment(a: list[Slot], b: list[Slot]) -> tuple[list[tuple[int, int]], int]:
    """The pairs of a largest matching and its number of nodes."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    size = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i, j] = matched(x, y)
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size[i, j])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if size[i, j]:
                pairs.append((i, j))
    return pairs[::-1], best[len(a)][len(b)]


def matched(a: Slot, b: Slot) -> int:
    """Number of nodes of a largest matching of two trees."""
    if a.key != b.key:
        return 0
    if [x.key for x in a.kids] == [y.key for y in b.kids]:
        return 1 + sum([matched(x, y) for x, y in zip(a.kids, b.kids, strict=True)])
    return 1 + _alignment(a.kids, b.kids)[1]


def fold(into: Slot, other: Slot) -> None:
    """Add a wrapper of the same root to another."""
    into.pages += other.pages
    into.chars += other.chars
    into.links += other.links
    pairs = aligned(into.kids, other.kids)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(into.kids), len(other.kids))]:
        out += into.kids[i:p] + other.kids[j:q]
        if p < len(into.kids):
            fold(into.kids[p], other.kids[q])
            out.append(into.kids[p])
        i, j = p + 1, q + 1
    into.kids = out


def runs(node: Node) -> list[tuple[str, list]]:
    """Children in order, with runs of equal keys (texts, or elements of one tag and class) together."""
    out: list[tuple[str, list]] = []
    for child in node.own:
        key = "#text" if isinstance(child, tuple) else child.key
        if out and out[-1][0] == key:
            out[-1][1].append(child)
        else:
            out.append((key, [child]))
    return out


def below(path: int, key: str) -> int:
    """Hash of the path that goes on from `path` to a child of this key."""
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), path)


def place(path: int, text: str) -> int:
    """Signed 64-bit digest of a text at a path."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), path)
    return value - (1 << 64) if value >> 63 else value


def places(root: Node) -> set[int]:
    """The digests of all texts of a page with their paths."""
    out: set[int] = set()

    def walk(node: Node, path: int) -> None:
        for key, group in runs(node):
            own = below(path, key)
            for child in group:
                if isinstance(child, tuple):
                    out.add(place(own, child[0]))
                else:
                    walk(child, own)

    walk(root, 0)
    return out


def single(key: str, nodes: list) -> Slot:
    """The wrapper of one page's run of nodes."""
    slot = Slot(key)
    slot.pages = 1
    if key == "#text":
        for text, links in nodes:
            slot.chars += len(text)
            slot.links += min(links, len(text))
        return slot
    for i, node in enumerate(nodes):
        own = Slot(key)
        own.kids = [single(k, group) for k, group in runs(node)]
        if i:
            for k in own.kids:
                k.pages = 0
            fold(slot, own)
        else:
            slot.kids = own.kids
    return slot


def wrapper_of(root: Node) -> Slot:
    return single(root.key, [root])


@lru_cache(1 << 16)
def _words(key: str) -> tuple[str, frozenset[str]]:
    tag, _, mark = key.partition(".")
    return tag, frozenset(p.lower() for p in PARTS.findall(mark))


def named_template(key: str, article: bool = False) -> bool:
    """Element or class say template; `article`: inside an article."""
    tag, words = _words(key)
    if tag in DROPPED:
        return True
    if tag in ARTICLE:
        return bool(words & BESIDE)
    return tag not in ("body", "html") and bool(words & (MARKS - DOUBTFUL if article else MARKS))


def beside(key: str) -> bool:
    """What stands beside the article, whatever it holds."""
    tag, words = _words(key)
    return tag in BESIDE_TAGS or bool(words & BESIDE and tag not in ("body", "html"))


def verdicts(slot: Slot, article: bool = False) -> list:
    """The wrapper as [key, template, children], without its figures. Inside an article link text is as good as other text."""
    links = linked(slot)
    tag = slot.key.partition(".")[0]
    template = named_template(slot.key, article) or (not article and tag in BLOCKS and tag not in ("body", "html", *ARTICLE) and links[0] > 0 and links[1] >= 0.6 * links[0])
    return [slot.key, template, [verdicts(k, article or tag in ARTICLE) for k in slot.kids]]


def linked(slot: Slot) -> tuple[int, int]:
    chars, links = slot.chars, slot.links
    for k in slot.kids:
        a, b = linked(k)
        chars, links = chars + a, links + b
    return chars, links


def has_article(node: Node) -> bool:
    """An article outside of what stands beside it."""
    for c in node.own:
        if not isinstance(c, tuple) and not (beside(c.key) and not _around(c)) and (c.tag in ARTICLE or has_article(c)):
            return True
    return False


def _around(node: Node) -> bool:
    """A layout element whose class mentions what it puts beside the article, as in `with-sidebar`, holds a main element."""
    return node.tag not in BESIDE_TAGS and any(not isinstance(c, tuple) and (c.tag == "main" or _around(c)) for c in node.own)


def content(root: Node, wrapper: list | None, recurring: frozenset[int] = frozenset()) -> str:
    """The blocks of a page that its host's wrapper calls content; `recurring`: places of the texts that are template."""
    out: list[str] = []
    inside = has_article(root)

    def walk(node: Node, slots: list, article: bool, path: int) -> None:
        own = [Slot(k) for k, _ in runs(node)]
        groups = [g for _, g in runs(node)]
        pair = dict((i, j) for i, j in aligned(own, [_bare(s) for s in slots])) if slots else {}
        for i, group in enumerate(groups):
            slot = slots[pair[i]] if i in pair else None
            at = below(path, own[i].key)
            for child in group:
                if isinstance(child, tuple):
                    text, links = child
                    if (article or (not inside and links < max(1, 0.9 * len(text)))) and not (recurring and place(at, text) in recurring):
                        out.append(text)
                elif not (slot[1] if slot else named_template(child.key, article)) or (
                        inside and not article and not (beside(child.key) and not _around(child)) and has_article(child)):
                    # What holds the article is no template, whatever its class says.
                    walk(child, slot[2] if slot else [], article or child.tag in ARTICLE, at)

    walk(root, wrapper[2] if wrapper else [], False, 0)
    return "\n".join(out)


def _bare(verdict: list) -> Slot:
    return Slot(verdict[0])


def _packed(slot: Slot) -> bytes:
    return json.dumps(slot.dump(), separators=(",", ":")).encode()


def induced(pages: DataFrame) -> DataFrame:
    """host, its wrapper (verdicts as JSON) and the places of its recurring texts, joined by commas; pages: host, html."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Slot] = {}

        def batch_of(names: list, wrappers: list, marks: list, found: list) -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array(wrappers, pa.binary()), pa.array(marks, pa.int64()), pa.array(found, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["host", "wrapper", "mark", "place"])

        def rows():
            return batch_of(list(hosts), [_packed(s) for s in hosts.values()], [None] * len(hosts), [None] * len(hosts))

        for batch in batches:
            names, marks, found = [], [], []
            for host, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parsed(body or "")
                own = wrapper_of(root)
                if host in hosts:
                    fold(hosts[host], own)
                else:
                    hosts[host] = own
                # The row without a place stands for the page itself.
                here = [None, *places(root)]
                names += [host] * len(here)
                marks += [place(0, body or "")] * len(here)
                found += here
            yield batch_of(names, [None] * len(names), marks, found)
            if len(hosts) > 5_000:
                yield rows()
                hosts.clear()
        yield rows()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        slots = [Slot.load(json.loads(w)) for w in sorted(group["wrapper"])]
        for s in slots[1:]:
            fold(slots[0], s)
        return pd.DataFrame({"host": [group["host"].iat[0]], "wrapper": [_packed(slots[0])]})

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        whole = merge(group)
        slot = Slot.load(json.loads(whole["wrapper"].iat[0]))
        return pd.DataFrame({"host": whole["host"], "wrapper": [json.dumps(verdicts(slot), separators=(",", ":")).encode()]})

    kind = "host string, wrapper binary"
    local = stored(pages.select("host", "html").mapInArrow(build, f"{kind}, mark long, place long"), "page-parts")
    # Wrappers of a host meet in up to 64 groups first, then in one.
    part = local.where("wrapper IS NOT NULL").select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), F.lit(64)).alias("part"))
    wrappers = part.groupBy("host", "part").applyInPandas(merge, kind).groupBy("host").applyInPandas(decide, kind)
    # Different pages by place; repeated pages have the same mark. At most 1 / MOSTLY times the texts of a page are left of a host.
    counts = local.where("wrapper IS NULL").select("host", "place", "mark").distinct().groupBy("host", "place").count().where(F.col("place").isNull() | (F.col("count") >= LEAST_PAGES))
    counts = stored(counts, "place-counts")
    totals = counts.where("place IS NULL").select("host", F.col("count").alias("pages"))
    shared = counts.where("place IS NOT NULL").join(totals, "host").where(F.col("count") >= MOSTLY * F.col("pages"))
    shared = shared.groupBy("host").agg(F.array_join(F.sort_array(F.collect_list("place")).cast("array<string>"), ",").alias("recurring"))
    return wrappers.join(shared, "host", "left")


#: Bytes of wrappers that every task gets; more are joined by a shuffle.
SENT_BYTES = 16_000_000


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, url and text of every page."""
    host = F.coalesce(ascii_lower(F.regexp_extract(col(url), r"://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(col(key).alias("key"), col(url).alias("url"), host.alias("host"), col(body).alias("html"))
    wrappers = stored(induced(rows), "wrappers")
    if (wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + F.coalesce(F.length("recurring"), F.lit(0)))).first()[0] or 0) <= SENT_BYTES:
        wrappers = F.broadcast(wrappers)
    joined = rows.join(wrappers, "host", "left").select("key", "url", "html", "wrapper", "recurring")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for batch in batches:
            texts = []
            for page, *packed in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                own = tuple(packed)
                if own not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[own] = (json.loads(own[0]) if own[0] else None, frozenset(map(int, own[1].split(","))) if own[1] else frozenset())
                texts.append(content(parsed(page), *known[own]) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["key", "url", "text"])

    kind = f"key {pages.schema[key].dataType.simpleString()}, url string, text string"
    out = joined.mapInArrow(extract, kind)
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text")


@query("op8_html_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = main_texts(picked(table(spark, folder, "pages"), "page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

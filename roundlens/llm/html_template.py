"""Main text of pages by their elements and by the template that their host's pages share.

The template is deduced from equivalence classes. A page is read as a sequence of
tokens: the beginnings and ends of elements, told apart by their path, and blocks
of text. Tokens of a host that occur equally often on each of its pages share an
occurrence vector, of which fingerprints are gathered in one grouped aggregation;
those that share one are a class. A class is valid where its tokens follow each other in
one order on all pages and it lies in a single gap of the class around it. Valid
classes nest into the template. The gaps between their tokens are its slots, and
text that recurs in its place on nearly all pages belongs to the template.

Tags, roles and names of elements mark menus, headers, footers, sidebars, notices,
adverts, forms and comments. An article is content, names decide nothing within it
but that a list of comments goes, and articles that are comments or teasers are no
content. Elsewhere, within a main element too, slots decide: a slot of links is a menu, one whose every text
comes again on other pages is a notice or an advert, whatever its name, and
content lies in the deepest container of the template that holds most of the rest.

Pages are scanned once, left to right, in time linear in their length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import aliased, map_rows, parts, stage, text_column, tidy
from .url_filter import url_host

#: Tokens on a smaller share of a host's distinct pages are no template; text needs COMMON_TEXT of these and of all pages. Pages that share their longest blocks, NEAR of their text, are one.
COMMON, COMMON_TEXT, NEAR = 0.5, 0.9, 0.8
#: Text is of the template only on so many distinct pages of a host, or COMMON_TEXT of them if these are more: a few pages that share a paragraph are no evidence.
LEAST_PAGES = 8
#: A slot is a menu if links are a larger share of its text than LINKS, and is dealt out if at least AGAIN of it recurs and each text is on AGAIN_EACH pages; a container with MAIN of the text of the one around it is nearer to the content.
LINKS, AGAIN, AGAIN_EACH, MAIN = 0.5, 0.95, 3, 0.6
CONTAINERS = frozenset("div section ul ol dl table center main article".split())
#: Templates of so many tokens in all (some 100 bytes each) are sent to every task; beyond, they are joined with the pages by host, each host's pages in SALT parts.
BROADCAST_TOKENS, SALT = 200_000, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark math nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements of formulas stay in the line of text they are in.
MATHML = frozenset("mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle merror mpadded mphantom mfenced menclose mmultiscripts mprescripts mspace semantics annotation".split())
INLINE |= MATHML
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template iframe svg textarea title".split()}
LEFT_OUT = frozenset("head nav footer aside form menu dialog button select option fieldset".split()) | RAW.keys()
#: Names in class or id that mark an element as no content.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar navigation menu topmenu breadcrumb breadcrumbs "
    "footer sidebar aside related recommended comment comments commentlist respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social toolbar widget pagination pager skip".split()
)
#: Whole names of elements within an article that hold its readers' comments, and first words of names of articles that are comments or teasers.
COMMENT_LISTS = frozenset("comments comment-list commentlist comments-area comment-section disqus disqus_thread".split())
NO_ARTICLES = frozenset("comment comments reply replies teaser teasers related recommended promo promoted sponsored advert advertisement ad".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NEVER = frozenset("html body main article".split())
CLOSES_ITSELF = frozenset("li dt dd tr td th option".split())
NAME = re.compile(r"[a-zA-Z][\w:-]*")
STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# ---- pages -----------------------------------------------------------------------------------------------------------


def scan(page: str):
    """(text before, name, is an end tag, attributes) of each tag in page order, and the text after the last one with no name.

    Comments, declarations and the insides of scripts and the like are passed over; a tag that never ends, ends the page.
    """
    at, text_from, size = 0, 0, len(page)
    text: list[str] = []
    last_quote = {q: page.rfind(q) for q in "\"'"}
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        text.append(page[text_from:lt])
        after = page[lt + 1 : lt + 4]
        name, attributes, closing = "", "", after[:1] == "/"
        if after == "!--":
            end = page.find("-->", lt + 4)
            end = size if end < 0 else end + 3
        elif after[:1] in ("!", "?"):
            end = page.find(">", lt + 1)
            end = size if end < 0 else end + 1
        elif m := NAME.match(page, lt + 1 + closing):
            end = i = m.end()
            while True:
                stop = STOP.search(page, i)
                if not stop:
                    end = size
                    break
                quote = stop[0]
                if quote == ">":
                    end = stop.end()
                    name, attributes = m[0].lower(), page[m.end() : end - 1]
                    break
                i = page.index(quote, stop.end()) + 1 if stop.start() < last_quote[quote] else stop.end()
        elif closing:
            end = page.find(">", lt + 1)
            end = size if end < 0 else end + 1
        else:
            text.append("<")
            at = text_from = lt + 1
            continue
        if name:
            yield "".join(text), name, closing, attributes
            text = []
            if name in RAW and not closing and not (name == "svg" and attributes.endswith("/")):
                stop = RAW[name].search(page, end)
                end = stop.end() if stop else size
        at = text_from = end
        if end >= size:
            break
    yield "".join([*text, page[text_from:]]), "", False, ""


MAIN_ELEMENT, ARTICLE = 1, 2


class Element(NamedTuple):
    tag: str
    path: int
    out: bool  # itself or within one that is left out
    content: int  # ARTICLE or MAIN, itself or the innermost around it
    token: int


def _hash(*of) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(map(str, of)))


TEXT, CONTAINER, OPEN, CLOSE = range(4)


def _token(h: int, kind: int) -> int:
    """A token as a signed 64-bit number; its two lowest bits tell its kind."""
    return ((h >> 1) & ~3 | kind) - (1 << 62)


def _kind(token: int) -> int:
    return token & 3


def opened(close: int) -> int:
    """The token of an element's beginning, but for its kind, from that of its end."""
    return close & ~3


def _element(tag: str, attributes: str, around: Element) -> Element:
    values = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    named = f"{values.get('class', '')} {values.get('id', '')}".split()
    key = tag + "".join(f".{n}" for n in sorted(named) if not re.search(r"\d{3}|[-_]\d+$", n))
    role = values.get("role", "").lower()
    content = around.content
    if tag == "article" or role == "article" or values.get("itemprop", "") == "articleBody":
        content = ARTICLE
    elif tag == "main" or role == "main":
        content = max(content, MAIN_ELEMENT)
    out = tag in LEFT_OUT
    if content == ARTICLE != around.content or tag == "article":
        out |= any(first and first[0].lower() in NO_ARTICLES for first in map(WORD.findall, named))
    elif content == ARTICLE:
        out |= any(n.lower() in COMMENT_LISTS for n in named)
    elif tag not in NEVER and not (content and not around.content):
        words = {w.lower() for n in named if not re.match(r"(has|with|no|without|is)[-_]", n) for w in WORD.findall(n)}
        out |= bool(words & NAMES) or role in ROLES
        out |= not around.content and (tag == "header" or bool(words & HEADER_NAMES))
    path = _hash(around.path, key)
    return Element(tag, path, out or around.out, content, _token(path, CONTAINER if tag in CONTAINERS else OPEN))


_known_element = lru_cache(20_000)(_element)
#: Elements with attributes up to so many characters are kept for the next page.
KNOWN_CHARS = 200


def element_of(tag: str, attributes: str, around: Element) -> Element:
    return (_known_element if len(attributes) <= KNOWN_CHARS else _element)(tag, attributes, around)


class Block(NamedTuple):
    text: str
    token: int
    out: bool
    content: int
    links: int  # characters in links
    at: int  # tokens of elements before it


ROOT = Element("", 0, False, 0, _token(0, CONTAINER))


def read(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of text of a page and the tokens of its elements, both in page order."""
    stack, open_tags = [ROOT], Counter()
    blocks: list[Block] = []
    tokens: list[int] = []
    text: list[str] = []
    links = in_link = 0

    def close():
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                top = stack[-1]
                blocks.append(Block(joined, _token(_hash(top.path, joined), TEXT), top.out, top.content, min(links, len(joined)), len(tokens)))
            text.clear()
        links = 0

    def push(element: Element):
        stack.append(element)
        open_tags[element.tag] += 1
        tokens.append(element.token)

    def pop() -> str:
        element = stack.pop()
        open_tags[element.tag] -= 1
        tokens.append(opened(element.token) | CLOSE)
        return element.tag

    for before, tag, closing, attributes in scan(page):
        if before:
            piece = html_lib.unescape(before)
            text.append(piece)
            links += len(piece) * (in_link > 0)
        if not tag or tag in RAW:
            continue
        if tag in INLINE:
            in_link = max(0, in_link + (-1 if closing else 1)) if tag == "a" else in_link
            if not closing and stack[-1].content < ARTICLE and re.search(r"\b(class|id|role)\b", attributes):
                element = element_of(tag, attributes, stack[-1])
                if element.out and not stack[-1].out and not attributes.rstrip().endswith("/"):
                    close()
                    push(element)
            elif closing and stack[-1].tag == tag:
                close()
                pop()
        elif tag == "br":
            text.append("\n")
        elif closing:
            close()
            if open_tags[tag]:
                while pop() != tag:
                    pass
        else:
            close()
            if tag not in VOID:
                while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in INLINE or stack[-1].tag == tag and tag in CLOSES_ITSELF):
                    pop()
                push(element_of(tag, attributes, stack[-1]))
                if attributes.rstrip().endswith("/"):
                    pop()
    close()
    while len(stack) > 1:
        pop()
    return blocks, tokens


def undecided(blocks: list[Block]) -> list[Block]:
    """The blocks that tags and names leave to the template: none of a page with an article, else those in main, else all that aren't left out."""
    kept = [b for b in blocks if not b.out]
    most = max((b.content for b in kept), default=0)
    return [] if most == ARTICLE else [b for b in kept if b.content == most]


def near_key(blocks: list[Block]) -> int:
    """Equal for pages whose longest blocks, up to NEAR of the text that isn't left out, are the same: copies and near copies."""
    size: Counter = Counter()
    for b in blocks:
        if not b.out:
            size[b.token] += len(b.text)
    longest, left = [], NEAR * sum(size.values())
    for t in sorted(size, key=lambda t: (-size[t], t)):
        if left <= 0:
            break
        longest.append(t)
        left -= size[t]
    return _token(xxhash.xxh3_64_intdigest(np.sort(np.array(longest, np.int64)).tobytes()), TEXT)


# ---- the template ----------------------------------------------------------------------------------------------------

READ = "host string, near long, tokens array<long>, texts array<long>, chars array<int>, links array<int>, places array<int>"


def read_pages(pages: DataFrame) -> DataFrame:
    """READ of (host, html): the tokens of a page's elements, and of the texts that tags and names don't decide on, with where they stand."""

    @tidy
    def run(batches):
        for batch in batches:
            for part in parts(batch):
                rows = []
                for host, page in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
                    blocks, tokens = read(page or "")
                    left = undecided(blocks)
                    rows.append((host, near_key(blocks), [ROOT.token, *tokens], [b.token for b in left], [len(b.text) for b in left], [b.links for b in left], [b.at + 1 for b in left]))
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                kinds = [pa.string(), pa.int64(), longs, longs, ints, ints, ints]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in READ.split(", ")])

    return pages.mapInArrow(run, READ)


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, class, once) of the tokens of elements on COMMON of a host's ``pages`` (host, near, tokens), which are distinct; those that occur equally often on each page share a class."""
    each = pages.select("host", "near", F.explode("tokens").alias("token")).groupBy("host", "near", "token").agg(F.count("*").alias("n"))
    vector = [F.bit_xor(F.xxhash64("near", "n", F.lit(seed))).alias(f"f{seed}") for seed in (1, 2)]
    found = each.groupBy("host", "token").agg(*vector, F.count("*").alias("support"), F.sum("n").alias("total"))
    sizes = found.where(F.col("token") == ROOT.token).select("host", F.col("support").alias("pages"))
    common = found.join(sizes, "host").where((F.col("support") > 1) & (F.col("support") >= F.lit(COMMON) * F.col("pages")))
    return common.select("host", "token", F.xxhash64("f1", "f2", "support").alias("class"), (F.col("support") == F.col("total")).alias("once"))


class Template(NamedTuple):
    """Of a host: the class of each token and whether it occurs once a page; the slots that are no content, the container of content, and texts of the template."""

    of: dict[int, int]
    once: frozenset[int]
    out: frozenset[int] = frozenset()
    main: int | None = None
    constant: frozenset[int] = frozenset()


class Walk:
    """One page's tokens against a template: the order and nesting of its classes, and the slot and containers of places between tokens."""

    def __init__(self, tokens: list[int], template: Template):
        of = template.of
        left = Counter(of[t] for t in tokens if t in of)
        open_: list[tuple[int, int]] = []  # (class, its last token) from outer to inner
        self.before: dict[int, set] = {}  # of each token, the ones of its class before it
        self.around: dict[int, set] = {}  # of each class, the slots it begins in
        self.crossed: set[int] = set()  # classes that reach across a token of a class around them
        self.slots = np.empty(len(tokens) + 1, np.int64)
        self.boxes = np.empty(len(tokens) + 1, np.int64)
        self.parents: dict[int, int] = {}
        boxes = [0]
        last: dict[int, int] = {}
        self.slots[0] = self.boxes[0] = 0
        for i, t in enumerate(tokens):
            c = of.get(t)
            if c is not None:
                if c in last:
                    self.before.setdefault(t, set()).add(last[c])
                    if c not in self.crossed:
                        while open_[-1][0] != c:
                            self.crossed.add(open_.pop()[0])
                        open_.pop()
                else:
                    self.around.setdefault(c, set()).add(open_[-1][1] if open_ else 0)
                last[c] = t
                left[c] -= 1
                if left[c] and c not in self.crossed:
                    open_.append((c, t))
            if t in template.once and _kind(t) == CONTAINER:
                self.parents[t] = boxes[-1]
                boxes.append(t)
            elif _kind(t) == CLOSE and len(boxes) > 1 and opened(boxes[-1]) == opened(t):
                boxes.pop()
            self.slots[i + 1] = open_[-1][1] if open_ else 0
            self.boxes[i + 1] = boxes[-1]


def valid_tokens(pages: DataFrame, common: DataFrame) -> DataFrame:
    """The rows of ``common`` of valid classes: tokens that always follow the same one of their class, in classes that always lie in the same gap and cross none."""
    rows = common.groupBy("host").agg(F.collect_list("token").alias("t"), F.collect_list("class").alias("c"), F.collect_list("once").alias("o"))

    @tidy
    def run(batches):
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for host, tokens, t, c, o in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                walk = Walk(tokens, Template(dict(zip(t, c, strict=True)), frozenset(x for x, once in zip(t, o, strict=True) if once)))
                for kind, found in ((0, walk.before), (1, walk.around), (2, dict.fromkeys(walk.crossed, {0}))):
                    for key, where in found.items():
                        low, high = seen.get((host, kind, key), (min(where), max(where)))
                        seen[host, kind, key] = [min(low, *where), max(high, *where)]
            out = [(*key, *ends) for key, ends in seen.items()]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["host", "kind", "key", "low", "high"])

    joined = by_host(pages.select("host", "tokens"), rows, "host").select("host", "tokens", "t", "c", "o").where("t is not null")
    seen = joined.mapInArrow(run, "host string, kind int, key long, low long, high long").groupBy("host", "kind", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wrong = seen.where("kind = 2 or low <> high").select("host", "kind", "key")
    wrong = stage(wrong, "crossed")
    kept = common.join(wrong.where("kind > 0").select("host", F.col("key").alias("class")), ["host", "class"], "left_anti")
    kept = kept.join(wrong.where("kind = 0").select("host", F.col("key").alias("token")), ["host", "token"], "left_anti")
    large = kept.groupBy("host", "class").agg(F.count("*").alias("n")).where("n > 1").select("host", "class")
    return kept.join(large, ["host", "class"])


def by_host(pages: DataFrame, rows: DataFrame, host: str) -> DataFrame:
    """``pages`` with the one row that ``rows`` (bounded by the tokens of a page) has for their host, if any.

    Small tables are broadcast. Otherwise a host's pages are dealt to SALT tasks, and so is its row.
    """
    rows = stage(rows.withColumnRenamed("host", host), "by-host")
    if (rows.agg(F.sum(F.size("t"))).first()[0] or 0) <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(rows), host, "left")
    salted = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return pages.withColumn("_salt", F.pmod(F.xxhash64(*pages.columns), F.lit(SALT)).cast("int")).join(salted, [host, "_salt"], "left").drop("_salt")


TEXTS = "host string, near long, kind int, slot long, box long, token long, chars long, links long"


def slot_texts(pages: DataFrame, template: DataFrame) -> DataFrame:
    """TEXTS of pages that tags and names don't decide on: their texts by slot and container (kind 0), and the container around each container (kind 1, box in slot)."""

    @tidy
    def run(batches):
        for batch in batches:
            out = []
            for host, near, tokens, texts, chars, links, places, t, c, o in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                walk = Walk(tokens, Template(dict(zip(t or (), c or (), strict=True)), frozenset(x for x, once in zip(t or (), o or (), strict=True) if once)))
                held: dict[tuple, list[int]] = {}
                for token, n, in_links, at in zip(texts, chars, links, places, strict=True):
                    sums = held.setdefault((int(walk.slots[at]), int(walk.boxes[at]), token), [0, 0])
                    sums[0] += n
                    sums[1] += in_links
                out += [(host, near, 0, *key, *sums) for key, sums in held.items()]
                out += [(host, near, 1, box, parent, 0, 0, 0) for box, parent in walk.parents.items()]
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in TEXTS.split(", ")])

    rows = template.groupBy("host").agg(F.collect_list("token").alias("t"), F.collect_list("class").alias("c"), F.collect_list("once").alias("o"))
    left = pages.where(F.size("texts") > 0)
    return by_host(left, rows, "host").select(*[c.split()[0] for c in READ.split(", ")], "t", "c", "o").mapInArrow(run, TEXTS)


def heaviest(weight: Counter, parent: dict[int, int]) -> int:
    """The deepest container (0: none) reached from the outermost one by steps to one with MAIN of the text in the one around it.

    ``weight`` is each container's own text, to which that of the containers in it is
    added, from inner to outer, each once. Containers that pages nest in different ways
    and that so lie within each other count as outermost ones.
    """
    depth = {0: 0}
    for box in {*weight, *parent}:
        path = []
        while box not in depth:
            depth[box] = -1  # on the way
            path.append(box)
            box = parent.get(box, 0)
        at = max(depth[box], 0)
        for x in reversed(path):
            depth[x] = at = at + 1
    inside: dict[int, list[int]] = {}
    total = Counter(weight)
    for box in sorted((b for b in depth if b), key=lambda b: -depth[b]):
        around = parent.get(box, 0)
        around = around if depth.get(around, 0) < depth[box] else 0
        inside.setdefault(around, []).append(box)
        total[around] += total[box]
    main = 0
    while best := [b for b in inside.get(main, ()) if total[b] >= MAIN * total[main] > 0]:
        main = min(best, key=lambda b: (-total[b], b))
    return main


VERDICT = "host string, main long, out array<long>, constant array<long>"


def judge(rows: pd.DataFrame) -> pd.DataFrame:
    """VERDICT of one host from its slots (kind 0: slot, box, chars, links, again, texts, on), containers (kind 1: slot within box) and texts of the template (kind 2)."""
    slots, within, constant = (rows[rows["kind"] == k] for k in (0, 1, 2))
    parent = dict(zip(within["slot"].tolist(), within["box"].tolist(), strict=True))
    by_slot = slots.groupby("slot")[["chars", "links", "again", "texts", "on"]].sum()
    menu = by_slot["links"] > LINKS * by_slot["chars"]
    notice = (by_slot["again"] >= AGAIN * by_slot["chars"]) & (by_slot["on"] >= AGAIN_EACH * by_slot["texts"])
    out = set(by_slot.index[(menu | notice) & (by_slot.index != 0)])
    total = int(slots["chars"].sum())
    if int(slots[~slots["slot"].isin(out)]["chars"].sum()) < (1 - NEAR) * total:
        out = set()
    weight: Counter = Counter()
    for box, chars in slots[~slots["slot"].isin(out)].groupby("box")["chars"].sum().items():
        weight[box] += chars
    main = heaviest(weight, parent)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "main": [main], "out": [sorted(map(int, out))], "constant": [sorted(map(int, constant["token"]))]})


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, out, constant, t, c, o) of each host of READ pages with two distinct ones: its template and what it says of slots, in arrays bounded by the tokens of a page."""
    distinct = stage(pages.groupBy("host", "near").agg(F.min_by("tokens", F.xxhash64("tokens")).alias("tokens")), "distinct")
    common = stage(classes(distinct), "classes")
    template = stage(valid_tokens(distinct, common), "template")
    texts = slot_texts(pages, template)
    each = texts.groupBy("host", "kind", "slot", "box", "token", "near").agg(F.max("chars").alias("chars"), F.max("links").alias("links"), F.count("*").alias("copies"))
    each = each.groupBy("host", "kind", "slot", "box", "token").agg(F.count("*").alias("support"), F.sum("copies").alias("copies"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    each = stage(each, "slot-texts")
    more = F.col("support") > 1
    sums = {"chars": F.sum("chars"), "links": F.sum("links"), "again": F.sum(F.when(more, F.col("chars")).otherwise(0)), "texts": F.count_if(more), "on": F.sum(F.when(more, F.col("support")).otherwise(0))}
    slots = each.where("kind < 2").groupBy("host", "kind", "slot", "box").agg(*[v.alias(k) for k, v in sums.items()]).withColumn("token", F.lit(0).cast("long"))
    sizes = pages.groupBy("host").agg(F.count_distinct("near").alias("pages"), F.count("*").alias("all_pages")).where("pages > 1")
    same = each.where("kind = 0").groupBy("host", "token").agg(F.sum("support").alias("support"), F.sum("copies").alias("copies")).join(sizes, "host")
    same = same.where((F.col("support") >= LEAST_PAGES) & (F.col("support") >= F.lit(COMMON_TEXT) * F.col("pages")) & (F.col("copies") >= F.lit(COMMON_TEXT) * F.col("all_pages")))
    zero = [F.lit(0).cast("long").alias(k) for k in ("slot", "box", *sums)]
    constant = same.select("host", F.lit(2).alias("kind"), *zero, "token")
    judged = slots.join(sizes.select("host"), "host", "left_semi").unionByName(constant).groupBy("host").applyInPandas(judge, VERDICT)
    rows = template.groupBy("host").agg(F.collect_list("token").alias("t"), F.collect_list("class").alias("c"), F.collect_list("once").alias("o"))
    return judged.join(rows, "host", "left").select("host", "main", "out", "constant", *[F.coalesce(x, F.array().cast(kind)).alias(x) for x, kind in (("t", "array<long>"), ("c", "array<long>"), ("o", "array<boolean>"))])


# ---- extraction ------------------------------------------------------------------------------------------------------


def extract_text(page: str | None, template: Template | None = None) -> str:
    """The page's main text: its content blocks in page order, joined by an empty line.

    Articles are kept as they are. On pages without one, the slots that are no
    content and texts of the template go, these unless they make up NEAR of the
    page: it is a near copy then, and they are what it says.
    """
    blocks, tokens = read(page or "")
    if any(b.content == ARTICLE and not b.out for b in blocks):
        return "\n\n".join(b.text for b in blocks if b.content == ARTICLE and not b.out)
    kept = undecided(blocks)
    if template is not None and kept:
        walk = Walk([ROOT.token, *tokens], template)
        inside = {0}
        if template.main:
            inside = {template.main}
            for box, parent in walk.parents.items():  # from outer to inner
                if parent in inside:
                    inside.add(box)
            kept = [b for b in kept if int(walk.boxes[b.at + 1]) in inside] or kept
        kept = [b for b in kept if int(walk.slots[b.at + 1]) not in template.out] or kept
        differing = [b for b in kept if b.token not in template.constant]
        if sum(len(b.text) for b in differing) > (1 - NEAR) * sum(len(b.text) for b in kept):
            kept = differing
    return "\n\n".join(b.text for b in kept)


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text (string) and n_chars (long, code points): the main text of each whole page.

    Null and empty pages give an empty text; pages of any length and depth are
    read whole; pages whose host has no other page are read by their elements
    alone, and those with a null URL share the empty host; repeated rows are
    read each and count once in the template; columns named text and n_chars are
    replaced and all others pass, whatever their names; an empty table gives an empty one.
    """
    pages = text_column(text_column(pages, html), url)
    kept = [c for c in pages.columns if c.lower() not in {"text", "n_chars"} - {html.lower()}]
    rows, names = aliased(pages.select(*kept))
    keyed = rows.withColumn("_host", url_host(F.col(names[url])))
    scanned = stage(read_pages(keyed.select(F.col("_host").alias("host"), F.col(names[html]).alias("html"))), "pages")
    joined = by_host(keyed, templates(scanned), "_host").select(*rows.columns, "main", "out", "constant", "t", "c", "o")
    at = {c: i for i, c in enumerate(joined.columns)}
    last: list = [None, None]

    def template_of(batch, i: int) -> Template | None:
        """Pages of one host mostly come together: the last template is kept."""
        main = batch.column(at["main"])[i].as_py()
        if main is None:
            return None
        key = [batch.column(at[x])[i] for x in ("main", "out", "constant", "t", "c", "o")]
        if last[0] != key:
            out, constant, t, c, o = (x.as_py() for x in key[1:])
            last[:] = key, Template(dict(zip(t, c, strict=True)), frozenset(x for x, once in zip(t, o, strict=True) if once), frozenset(out), main, frozenset(constant))
        return last[1]

    def per_batch(batch):
        got = [extract_text(page, template_of(batch, i)) for i, page in enumerate(batch.column(at[names[html]]).to_pylist())]
        return {"text": pa.array(got, pa.string()), "n_chars": pa.array(np.array([len(g) for g in got], np.int64))}

    out = map_rows(joined, per_batch, [("text", T.StringType()), ("n_chars", T.LongType())])
    return out.select(*rows.columns, "text", "n_chars").toDF(*kept, "text", "n_chars")

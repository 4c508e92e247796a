"""Operator 8: main-text extraction with a site style tree.

The pages of a host are merged into one tree of presentation nodes: a node is
a chain of tags with their classes. Its importance on its host has a content
and a presentation side:

* content: what returns on many of the node's pages carries little
  information. A leaf's importance is one minus the mean of log(pages with a
  content) / log(pages with the node); an inner node's is the mean of the
  leaves below it, weighted by their occurrences. Text inside links counts
  against a node by its share (link density).
* presentation: the entropy H of the node's child layouts (the row of labels
  right below it) over its pages, as 1 - exp(-H): a menu or a footer looks
  alike everywhere, an article has as many layouts as it has lengths.

Hosts with few pages lean on the same node's figures over all hosts.

A page's DOM is cut from the top. Where no element is an article by its tag or
role, the tree says which one is: the deepest node that holds much of the
page's text and is important on both sides; inside it only link lists and
named furniture go, so shared passages stay whole. Where there is no such
node either (all pages of one shape), branches go when their content
importance is low. Names are a prior: tags and classes that name a role are of
known importance (article: 1; menu, footer, advert, form, ..: 0).

Pages with the same blocks on a host count once. The statistics are partial
aggregations over (host, node, content hash); a
third of all pages on one host is one row per content and task. The list of
low branches per host is small; Spark broadcasts it or splits the skewed join.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, columns

# HTML element classes and names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup
option p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("br body html caption tbody td tfoot th thead tr option optgroup legend".split())
FURNITURE_TAGS = frozenset("nav footer aside form button select datalist dialog menu head object audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu "
                            "menubar form".split())
FURNITURE_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion
banner sidebar sidebars sidenav aside menu menus nav navbar topnav subnav mainnav navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr
notice notices alert popup modal overlay comment comments commentlist disqus replies share sharing social related recommended newsletter
subscribe signup login search pagination pager toolbar widget masthead topbar skip""".split())
#: Parts that say where or in what box a name stands, and parts of the names of whole layouts.
BESIDE_NAMES = frozenset("""area bar block blocks body bottom box btn button buttons container floating global group holder icon icons
inner item items left link links list lower main mobile module outer page panel primary right row secondary section site
sticky top unit upper wrap wrapper zone""".split())
LAYOUT_NAMES = frozenset("layout content".split())
CONTENT_TAGS = frozenset("article main".split())
SELF_CLOSING = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
                "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|["'=])*+)>|<[!?/][^>]*(?:>|\Z)"""
                    r"""|<[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NAME = re.compile(r"[a-z]+")
_BESIDE = re.compile(r"(?:^|[-_])(?:has|with|no)[-_].*")

#: NAMED: furniture by a class or id alone, which may also name a wrapper of the article.
FURNITURE, CONTENT, PLAIN, ROOT, NAMED = 0, 1, 2, 3, 4
LOW = 0.5
#: An article by its tree: share of the host's text, importance on both sides, least share of its own page's text.
SHARE, BOTH_SIDES, OWN_SHARE = 0.3, 0.4, 0.25
#: Link density of a list of links.
LINKED = 0.8


_LOOKS: dict[tuple[str, str], tuple[str, int, int]] = {}
_CHAINS: dict[tuple[int, str], int] = {}
_REMEMBERED = 50_000


def _remembered(memory: dict, key: tuple, fn):
    """``fn(*key)``, remembered up to a bound."""
    found = memory.get(key)
    if found is None:
        if len(memory) >= _REMEMBERED:
            memory.clear()
        found = memory[key] = fn(*key)
    return found


def _names(token: str) -> tuple[bool, bool]:
    """Whether a class or id names furniture outside, inside an article. Its
    parts are furniture and words of place only; outside, the last part that
    is no word of place decides ('site-nav', not 'search-results')."""
    parts = _NAME.findall(_BESIDE.sub("", token))
    heads = [p for p in parts if p not in BESIDE_NAMES]
    if not heads or LAYOUT_NAMES.intersection(parts):
        return False, False
    return heads[-1] in FURNITURE_NAMES, FURNITURE_NAMES.issuperset(heads)


def _look(tag: str, attributes: str) -> tuple[str, int, int]:
    """(presentation label, role outside an article, role inside one)."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    classes = found.get("class", "").lower().split()
    label = ".".join([tag, *sorted(classes)])
    tokens = [*classes, *found.get("id", "").lower().split()]
    outer, inner = (any(x) for x in zip((False, False), *map(_names, tokens), strict=True))
    role = found.get("role", "").lower()
    hidden = (re.search(r"(?:^|\s)hidden(?:\s|$)", attributes or "") is not None
              or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""))
    if tag in CONTENT_TAGS or role in ("main", "article"):
        return label, CONTENT, FURNITURE if {"comment", "comments", "ad", "advert"}.intersection(
            _NAME.findall(" ".join(tokens))) else CONTENT
    if tag in ("html", "body"):
        return label, ROOT, ROOT
    if tag in FURNITURE_TAGS or role in FURNITURE_ROLES or hidden:
        return label, FURNITURE, FURNITURE
    header = any(_NAME.findall(_BESIDE.sub("", t))[-1:] == ["header"] for t in tokens)
    outside = FURNITURE if tag == "header" else NAMED if outer or header else PLAIN
    return label, outside, FURNITURE if inner else PLAIN


def _chain(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent}/{label}") - (1 << 63)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def blocks(page: str | None, layouts: list[tuple[int, int]] | None = None) -> Iterator[
        tuple[str, list[tuple[int, int, int]], float]]:
    """Text blocks of a page in order, each with its branch (for every open
    element: node hash, role outside, role inside) and the share of it inside
    links. ``layouts`` gathers (node, hash of its row of child labels) of every
    element."""
    stack: list[tuple[str, tuple[int, int, int], list[str]]] = []
    text: list[str] = []
    branch: list[tuple[int, int, int]] = []
    linked = 0

    def flush() -> tuple[str, list, float] | None:
        nonlocal linked
        block, links = "".join(text), linked
        text.clear()
        linked = 0
        share = links / max(1, len(block.strip()))
        block = " ".join((html.unescape(block) if "&" in block else block).split())
        return (block, branch, min(1.0, share)) if block else None

    def leave(i: int) -> None:
        if layouts is not None:
            layouts.extend((s[1][0], _hash(" ".join(s[2]))) for s in stack[i:])
        del stack[i:]

    def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                leave(i)
                return
            if stack[i][0] in stop:
                return

    at, raw, end = 0, None, len(page or "")
    while page and at < end:
        if raw:
            m = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at, raw = (m.end() if m else end), None
            continue
        m = _TOKEN.search(page, at)
        part = page[at:m.start()] if m else page[at:]
        if part:
            if not text or not any(t.strip() for t in text):
                branch = [s[1] for s in stack]
            text.append(part)
            if any(s[0] == "a" for s in stack):
                linked += len(part.strip())
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag in BLOCK and (out := flush()):
            yield out
        if m[1]:
            if any(s[0] == tag for s in stack):
                close((tag,), ())
            continue
        if tag in CLOSES_P and any(s[0] == "p" for s in stack):
            close(("p",), ("table", "td", "button", "object"))
        if tag in SELF_CLOSING:
            names, stop = SELF_CLOSING[tag]
            close(tuple(names.split()), tuple(stop.split()))
        if tag in RAW:
            raw = None if m[3].rstrip().endswith("/") else tag
        elif tag not in VOID and not (m[3].rstrip().endswith("/") and tag not in BLOCK):
            label, outside, inside = _remembered(_LOOKS, (tag, m[3]), _look)
            parent = stack[-1][1][0] if stack else 0
            if stack and tag in BLOCK:
                stack[-1][2].append(label)
            stack.append((tag, (_remembered(_CHAINS, (parent, label), _chain), outside, inside), []))
    if out := flush():
        yield out
    leave(0)


def article_by_tree(found: list[tuple[str, list, float]], roots: frozenset[int]) -> int | None:
    """The deepest of the ``roots`` that holds enough of the page's text outside
    named furniture."""
    chars: dict[int, int] = {}
    depth: dict[int, int] = {}
    whole = 0
    for block, branch, _ in found:
        if any(b[1] in (FURNITURE, NAMED) for b in branch):
            continue
        whole += len(block)
        for i, b in enumerate(branch):
            if b[0] in roots:
                chars[b[0]] = chars.get(b[0], 0) + len(block)
                depth[b[0]] = i
    return max((n for n in chars if chars[n] >= OWN_SHARE * whole), key=lambda n: (depth[n], chars[n], n), default=None)


def main_text(page: str | None, importance: dict[int, float], roots: frozenset[int] = frozenset(),
              linked: frozenset[int] = frozenset()) -> str:
    """Blocks of a page that survive the cut, joined by spaces. If the page
    names its article, only that is read; an article in a branch that only its
    name makes furniture (a teaser, or the article in a misleading wrapper) is
    read if the page names no other and it is longer than the rest. A page that
    names none is read below the node that the tree takes for the article, if
    there is one."""
    kept, named, wrapped = [], [], []
    found = list(blocks(page))
    if roots and not any(b[1] == CONTENT for _, branch, _ in found for b in branch):
        root = article_by_tree(found, roots)
        if root is not None:
            for block, branch, _ in found:
                nodes = [b[0] for b in branch]
                at = nodes.index(root) if root in nodes else len(nodes)
                gone = any(b[1] in (FURNITURE, NAMED) for b in branch[:at]) or any(
                    b[2] == FURNITURE or b[0] in linked for b in branch[at + 1:])
                if at < len(nodes) and not gone:
                    kept.append(block)
            return " ".join(kept)
    for block, branch, _ in found:
        # what holds a named article is not judged by what else it holds
        start = next((i for i, b in enumerate(branch) if b[1] == CONTENT), None)
        inside, gone, misnamed = False, False, False
        for i, (node, outside, within) in enumerate(branch):
            role = within if inside else outside
            if role == NAMED:
                # an article that is itself a comment or an advert is no main text
                if start is None or branch[start][2] == FURNITURE:
                    gone = True
                    break
                misnamed = True
                continue
            limit = LOW if start is None else 0.0
            if role == FURNITURE or (role == PLAIN and importance.get(node, 1.0) < limit):
                gone = True
                break
            inside = inside or i == start
        if not gone:
            (wrapped if misnamed else named if inside else kept).append(block)
    return " ".join(named) or max(" ".join(kept), " ".join(wrapped), key=len)


def _observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for page_host, page in zip(batch["host"], batch["html"], strict=True):
            shapes: list[tuple[int, int]] = []
            seen, chars, links = {}, Counter(), Counter()
            for block, branch, linked in blocks(page, shapes):
                seen[branch[-1][0] if branch else 0, _hash(block)] = [b[0] for b in branch if b[1] != ROOT]
                for node in {b[0] for b in branch if b[1] != ROOT}:
                    chars[node] += len(block)
                    links[node] += round(len(block) * linked)
                chars[0] += len(block)
            nodes: set[int] = set()
            found, whole = [], xxhash.xxh3_64()
            for (node, content), above in seen.items():
                found.append({"node": node, "content": content, "page": int(node not in nodes), "above": above})
                whole.update(f"{node}/{content} ")
                nodes.add(node)
            shape, first = [], set()
            for (node, layout), n in Counter(x for x in shapes if x[0] in chars).items():
                once = int(node not in first)
                first.add(node)
                shape.append({"node": node, "layout": layout, "n": n, "once": once, "chars": once * chars[node],
                              "links": once * links[node], "page": once * chars[0]})
            if found:
                rows.append((page_host, whole.intdigest() - (1 << 63), found, shape))
        yield pd.DataFrame(rows, columns=["host", "same", "found", "shape"])


_OBSERVED = ("host string, same long, found array<struct<node:long,content:long,page:int,above:array<long>>>, "
             "shape array<struct<node:long,layout:long,n:long,once:int,chars:long,links:long,page:long>>")


def _pooled(nodes: DataFrame, figures: list[str], pooled_pages: int) -> DataFrame:
    """A host's own figures and the node's over all hosts, weighted as
    pages : pooled_pages."""
    over_all = nodes.groupBy("node").agg(*[(F.sum(F.col(f) * F.col("pages")) / F.sum("pages")).alias(f"all_{f}") for f in figures])
    return nodes.join(over_all, "node").select("host", "node", "pages", *[
        ((F.col(f) * F.col("pages") + F.col(f"all_{f}") * pooled_pages) / (F.col("pages") + pooled_pages)).alias(f)
        for f in figures])


def style_tree(pages: DataFrame, scratch: Scratch, pooled_pages: int = 20) -> DataFrame:
    """(host, node, pages, importance, presentation, links, share) of the
    merged trees, inner nodes included; share is the node's part of the text
    of its pages. ``pages`` has host and html. Pages of a host with the same
    blocks count once: copies say nothing about which of their blocks are
    furniture."""
    rows = pages.mapInPandas(_observed, _OBSERVED).dropDuplicates(["host", "same"])
    rows = scratch.save(rows.select("host", "found", "shape"), "observed")
    contents = rows.select("host", F.inline("found")).groupBy("host", "node", "content").agg(
        F.count(F.lit(1)).alias("c"), F.sum("page").alias("pages"), F.first("above").alias("above"))
    leaves = contents.groupBy("host", "node").agg(
        F.sum("pages").alias("m"), F.avg(F.log("c")).alias("spread"), F.first("above").alias("above"))
    leaves = leaves.withColumn("imp", F.when(F.col("m") > 1, 1 - F.col("spread") / F.log("m")).otherwise(F.lit(1.0)))
    content = (leaves.select("host", F.explode("above").alias("node"), "m", "imp").groupBy("host", "node")
               .agg(F.sum("m").alias("pages"), (F.sum(F.col("imp") * F.col("m")) / F.sum("m")).alias("importance")))
    layouts = rows.select("host", F.inline("shape")).groupBy("host", "node", "layout").agg(
        *[F.sum(c).alias(c) for c in ("n", "once", "chars", "links", "page")])
    entropy = F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")
    shapes = layouts.groupBy("host", "node").agg(
        F.sum("once").alias("pages"), (1 - F.exp(-entropy)).alias("presentation"),
        (F.sum("links") / F.greatest(F.sum("chars"), F.lit(1))).alias("links"),
        (F.sum("chars") / F.greatest(F.sum("page"), F.lit(1))).alias("share"))
    content = scratch.save(_pooled(content, ["importance"], pooled_pages), "content")
    shapes = scratch.save(_pooled(shapes, ["presentation", "links", "share"], pooled_pages), "shapes")
    return content.join(shapes.drop("pages"), ["host", "node"], "left").fillna(0.0, ["presentation", "links", "share"])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for page, told in zip(batch["html"], batch["told"], strict=True):
            told = told if told is not None else []
            texts.append(main_text(page, {x["node"]: x["weight"] for x in told if x["weight"] < LOW},
                                   frozenset(x["node"] for x in told if x["root"]),
                                   frozenset(x["node"] for x in told if x["linked"])))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                            "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars (code
    points).

    Null and empty pages give empty texts; pages without a host share the
    host ''; repeated rows are extracted each; an empty table gives no rows."""
    scratch = Scratch(pages.sparkSession, "html")
    rows = columns(pages, page_id=id_col, url=url_col, html=html_col).withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))))
    tree = style_tree(rows.select("host", "html"), scratch)
    both = F.col("importance") * F.col("presentation") * (1 - F.col("links"))
    tree = tree.select("host", "node", (F.col("importance") * (1 - F.col("links"))).alias("weight"),
                       ((F.col("share") >= SHARE) & (both >= BOTH_SIDES)).alias("root"), (F.col("links") >= LINKED).alias("linked"))
    told = scratch.save(tree.where((F.col("weight") < LOW) | F.col("root") | F.col("linked")).groupBy("host").agg(
        F.collect_list(F.struct("node", "weight", "root", "linked")).alias("told")), "told")
    kind = rows.schema["page_id"].dataType.simpleString()
    return (rows.join(told, "host", "left").select("page_id", "url", "html", "told")
            .mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long"))

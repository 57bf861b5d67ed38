"""Main text of web pages by wrapper induction.

A page becomes a tree of its blocks, without the parts whose tags or names say that they are menus, adverts and
the like; neighbouring leaves of one kind are one slot. Trees of one host are aligned by simple
tree matching. Slots that read alike wherever they occur, on most of a host's distinct pages, are its template, and so are
single leaves of varying slots that most distinct pages repeat outside article and main elements; others are content. Template is known by the kinds of the elements
around it and its text, wherever a page has it. Where an article or main element holds most of the varying text, the content is what
stands in it, else all of it.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from communitylens.llm.store import written
from communitylens.session import cut_lineage

#: An article or main element is a host's place of content when it holds at least this share of the host's varying text.
SHARE = 0.6
#: A template's slot occurs on at least two, and on this share, of the host's distinct pages.
OFTEN = 0.75
#: Parts that a host's pages are dealt to when they meet its wrapper.
SALTS = 32
#: Elements below this depth count as parts of their parent.
DEEPEST = 150
ARTICLE = {"article", "main"}
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby
s samp small span strike strong sub sup time tt u var wbr""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "title", "textarea", "xmp"}
NO_CONTENT = set("""head nav header footer aside menu form button select option fieldset noscript template iframe object svg
canvas audio video map dialog""".split())
NO_CONTENT_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login menu menubar nav navbar
navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets header masthead topbar footer foot copyright comment
comments commentlist respond reply replies disqus share sharing social related recommended pagination pager search toolbar
skip hidden""".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Words that leave the meaning of the noise words beside them in a name ("comment-list", "post-share-buttons").
NEUTRAL = set("""article post posts page site user users reader readers entry story blog list lists item items box block container wrapper wrap
section area region group row bar buttons button links link icons icon form panel unit module holder zone inner outer main top bottom left
right inline small large js text title heading label""".split())
#: Elements that no name makes noise.
KEPT = {"html", "body"} | ARTICLE
_NUMBER = re.compile(r"\[\d+\]")
_IN_ARTICLE = re.compile(r"/(?:" + "|".join(sorted(ARTICLE)) + r")[.\[]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element, or a slot of equal leaves: its kind, its parts in order, and the texts of a slot.

    ``noise``: its names say that it is no content; ``plain``: one of them says nothing else.
    """

    __slots__ = ("kind", "tag", "parts", "texts", "noise", "plain")

    def __init__(self, kind: str, tag: str, noise: bool = False, plain: bool = False):
        self.kind, self.tag, self.parts, self.texts, self.noise, self.plain = kind, tag, [], [], noise, plain


def _open(tag: str, attributes: str) -> Node | None:
    """The node of a start tag, or None for a part whose tag says that it is no content."""
    if tag in NO_CONTENT:
        return None
    if "=" not in attributes:
        return Node(tag, tag)
    values = [a or b or c for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id", "role")]
    names = "".join(f".{v}" for value in values[:1] for v in re.sub(r"[\d/]+", "", value).split()[:2])
    if tag in KEPT:
        return Node(tag + names, tag)
    words = [[w.lower() for w in _WORD.findall(name)] for value in values for name in value.split()]
    noise = [name for name in words if not NO_CONTENT_NAMES.isdisjoint(name)]
    return Node(tag + names, tag, bool(noise), any(NO_CONTENT_NAMES.union(NEUTRAL).issuperset(name) for name in noise))


def _without_noise(root: Node) -> Node:
    """The tree without elements that are noise by name, but for those that hold most of the page's text.

    Such a name on them is a remark about the page ("has-sidebar"). Where the page's one article or its main element
    stands elsewhere, the text is known to be there, and no name is overruled. Inside an article or main element
    a name counts only where it says nothing else ("comment-list", not "share-price").
    """
    def measure(node: Node) -> tuple[int, int, int]:
        chars = articles = mains = 0
        for part in node.parts:
            if isinstance(part, str):
                chars += len(part)
            else:
                found = measure(part)
                chars, articles, mains = chars + found[0], articles + found[1] + (part.tag == "article"), mains + found[2] + (part.tag == "main")
        sizes[id(node)] = chars, articles, mains
        return chars, articles, mains

    def prune(node: Node, inside: bool) -> None:
        parts = []
        for part in node.parts:
            if isinstance(part, Node):
                if part.noise and (part.plain or not inside):
                    chars, articles, mains = sizes[id(part)]
                    elsewhere = not inside and (total[2] > mains or total[1] - articles == 1)
                    if elsewhere or 2 * chars <= total[0]:
                        continue
                prune(part, inside or part.tag in ARTICLE)
            parts.append(part)
        node.parts = parts

    sizes: dict[int, tuple[int, int, int]] = {}
    total = measure(root)
    prune(root, False)
    return root


def parse(page: str) -> Node:
    """The tree of a page; text parts are strings with single spaces.

    Of an inline element that is no content only what stands in it goes: its block stays open. Text is
    held only where it is content, so what is held belongs to the innermost element with a node.
    """
    root = Node("#root", "#root")
    stack: list[tuple[str, Node | None]] = [("#root", root)]
    held: list[str] = []
    at, size = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                next(node for _, node in reversed(stack) if node is not None).parts.append(text)
            held.clear()

    while at < size:
        token = _TOKEN.match(page, at)
        at = token.end()
        closing, tag, attributes, text = token.groups()
        if text is not None:
            if stack[-1][1] is not None:
                held.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in INLINE:
            if tag in VOID:
                held.append(" ")
            elif closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][1] is not None:
                        break
                    if stack[depth][0] == tag:
                        del stack[depth:]
                        break
            elif not attributes.endswith("/"):
                named = _open(tag, attributes) if stack[-1][1] is not None and "=" in attributes else None
                if stack[-1][1] is None or (named and named.noise and (named.plain or not any(t in ARTICLE for t, _ in stack))):
                    stack.append((tag, None))
            continue
        flush()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        block = len(stack) - 1
        while stack[block][0] in INLINE:
            block -= 1
        if stack[block][0] == "p":  # the start of a block ends a paragraph and the inline elements in it
            del stack[block + 1:]
        if stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag):
            stack.pop()
        if tag in VOID:
            continue
        parent = stack[-1][1]
        node = _open(tag, attributes) if parent is not None else None
        if node is not None and len(stack) < DEEPEST:
            parent.parts.append(node)
        elif node is not None:
            node = None if node.noise else parent
        if not attributes.endswith("/"):
            stack.append((tag, node))
    flush()
    return _without_noise(root)


def slots(node: Node) -> Node:
    """The tree with neighbouring leaves of one kind as one slot; empty elements go."""
    out = Node(node.kind, node.tag)
    for part in node.parts:
        if isinstance(part, str):
            kind, texts = "#text", [part]
        else:
            if any(isinstance(x, Node) for x in part.parts):
                part = slots(part)
                if part.parts:
                    out.parts.append(part)
                continue
            kind, texts = part.kind, part.parts
        if not texts:
            continue
        last = out.parts[-1] if out.parts else None
        if last is None or not last.texts or last.kind != kind:
            out.parts.append(last := Node(kind, kind))
        last.texts.append(" ".join(texts))
    return out


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the best order-keeping match of two trees, and its pairs.

    Slots that read alike count twice, so a template meets itself where other parts of its kind stand beside it.
    """
    if a.kind != b.kind or bool(a.texts) != bool(b.texts):
        return 0, []
    if a.texts:
        return 1 + (a.texts == b.texts), [(a, b)]
    n, m = len(a.parts), len(b.parts)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    found = {}
    for i in range(n):
        for j in range(m):
            size, pairs = match(a.parts[i], b.parts[j])
            found[i, j] = size, pairs
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + size)
    pairs, i, j = [(a, b)], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs += found[i - 1, j - 1][1]
            i, j = i - 1, j - 1
    return best[n][m] + 1, pairs


def host(url: str | None) -> str:
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return found[1].lower() if found else ""


def _paths(node: Node, path: str = "") -> Iterator[tuple[str, Node]]:
    """Every node with its path: the kinds from the root on, numbered among equal neighbours."""
    counts: dict[str, int] = {}
    for part in node.parts:
        k = counts[part.kind] = counts.get(part.kind, -1) + 1
        here = f"{path}/{part.kind}[{k}]"
        yield here, part
        yield from _paths(part, here)


def _chain(path: str) -> str:
    """The kinds of a path without its numbers, which differ where a page has one part more."""
    return _NUMBER.sub("", path)


def _leaf(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _chars(node: Node) -> int:
    return sum(map(len, node.texts)) + sum(map(_chars, node.parts))


def _mark(node: Node) -> int:
    return zlib.crc32("\n".join(node.texts).encode())


def _whole(tree: Node) -> int:
    """A checksum of all texts of a page with their places: copies have the same."""
    texts = "\n".join(f"{path}\t{text}" for path, node in _paths(tree) for text in node.texts)
    return int.from_bytes(hashlib.blake2b(texts.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Wrapper:
    """What the pages of one host in one batch have in common."""

    def __init__(self, first: Node):
        self.tree = first
        self.seen: dict[int, list] = {}  # by node: pages, checksum of its text, whether it varies, characters, checksums of its distinct pages
        self.add(first)

    def add(self, page: Node) -> None:
        """Align a page with the wrapper's tree; parts of the page that match nothing are added to it."""
        pairs = match(self.tree, page)[1] if page is not self.tree else [(node, node) for node in self._all(page)]
        matched = {id(b): a for a, b in pairs}
        whole = _whole(page)
        for a, b in pairs:
            self._count(a, b, whole)
            if page is not self.tree:
                for part in b.parts:
                    if id(part) not in matched:
                        a.parts.append(part)
                        for new in self._all(part):
                            self._count(new, new, whole)

    def _all(self, node: Node) -> Iterator[Node]:
        yield node
        for part in node.parts:
            yield from self._all(part)

    def _count(self, node: Node, page_node: Node, whole: int) -> None:
        mark = _mark(page_node)
        entry = self.seen.setdefault(id(node), [0, mark, False, 0, set()])
        entry[0] += 1
        entry[2] = entry[2] or entry[1] != mark
        entry[3] += _chars(page_node)
        entry[4].add(whole)

    def rows(self) -> Iterator[tuple[str, bool, int, int, bool, int]]:
        for path, node in _paths(self.tree):
            yield path, bool(node.texts), *self.seen[id(node)][:4]

    def distinct(self) -> Iterator[tuple[str, list[int]]]:
        """By path, checksums of the distinct pages that have it; the empty path is the page's own."""
        yield "", list(self.seen[id(self.tree)][4])
        for path, node in _paths(self.tree):
            yield path, list(self.seen[id(node)][4])


def learn(pages: DataFrame) -> DataFrame:
    """(host, fixed, place): per host with varying slots, its template and the path of its article's element.

    ``fixed`` lists "checksum chain" of template slots and "=checksum chain" of template leaves in varying slots; a chain is a path
    without numbers. The place is the outermost article or main element with most of the varying text; '' is the whole page.

    Distinct pages are counted by sketches of fixed size (approx_count_distinct), so that copies of a page, wherever they lie, are one.
    Leaves that would make up more than half of what a page has in their chain are no template: such pages are versions of each other.
    What an article or main element repeats is part of the articles.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            wrappers: dict[str, Wrapper] = {}
            leaves: dict[tuple[str, str, int], tuple[int, set[int]]] = {}
            for url, page in zip(frame["url"], frame["html"], strict=True):
                if page:
                    name, tree = host(url), slots(parse(page))
                    if name in wrappers:
                        wrappers[name].add(tree)
                    else:
                        wrappers[name] = Wrapper(tree)
                    whole = _whole(tree)
                    for path, node in _paths(tree):
                        for text in node.texts if not _IN_ARTICLE.search(path) else ():
                            leaves.setdefault((name, _chain(path), _leaf(text)), (len(text), set()))[1].add(whole)
            rows = []
            for name, wrapper in wrappers.items():
                found = {path: row for path, *row in wrapper.rows()}
                pages = wrapper.seen[id(wrapper.tree)][0]
                rows += [(name, path, *found.get(path, (False, pages, 0, False, 0)), wholes) for path, wholes in wrapper.distinct()]
            rows += [(name, chain, None, None, mark, None, chars, list(wholes)) for (name, chain, mark), (chars, wholes) in leaves.items()]
            made = pd.DataFrame(rows, columns=["host", "path", "slot", "pages", "mark", "varies", "chars", "wholes"])
            yield made.astype({"slot": "boolean", "pages": "Int64", "varies": "boolean"})

    rows = written(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInPandas(
        run, "host string, path string, slot boolean, pages bigint, mark bigint, varies boolean, chars bigint, wholes array<bigint>"))
    parts = rows.filter("slot is not null").select("host", "path", "slot", "pages", "mark", "varies", "chars", F.posexplode("wholes").alias("at", "whole"))
    once = F.col("at") == 0
    every = cut_lineage(
        parts.groupBy("host", "path").agg(
            F.max("slot").alias("slot"), F.approx_count_distinct("whole").alias("pages"), F.sum(F.when(once, F.col("chars"))).alias("chars"),
            F.sum(F.when(once, F.col("pages"))).alias("seen"),
            (F.max("varies") | (F.min("mark") != F.max("mark"))).alias("varies"), F.min("mark").alias("mark"),
        )
    )
    nodes = every.filter("path <> ''").withColumn("chain", F.regexp_replace("path", r"\[\d+\]", ""))
    sizes = every.filter("path = ''").select("host", F.col("pages").alias("all_pages"), F.col("seen").alias("all_seen"))
    depth = F.size(F.split("path", "/"))
    total = nodes.filter("slot and varies").groupBy("host").agg(F.sum("chars").alias("total"))
    place = (
        nodes.filter(F.col("path").rlike(r"/(" + "|".join(sorted(ARTICLE)) + r")(\.[^/]*)?\[\d+\]$")).join(total, "host")
        .filter(F.col("chars") >= F.col("total") * SHARE)
        .groupBy("host").agg(F.min_by("path", F.struct(depth, -F.col("chars"), "path")).alias("place"))
    )
    often = (F.col("pages") > 1) & (F.col("pages") >= F.col("all_pages") * OFTEN)
    # a slot that reads alike on all pages of a batch, whatever its number there, stands for these pages
    slot = (
        parts.filter("slot and not varies").groupBy("host", F.regexp_replace("path", r"\[\d+\]", "").alias("chain"), "mark")
        .agg(F.approx_count_distinct("whole").alias("pages")).join(sizes, "host").filter(often)
        .select("host", F.concat_ws(" ", "mark", "chain").alias("rule"))
    )
    leaves = rows.filter("slot is null").select("host", F.col("path").alias("chain"), "mark", "chars", F.explode("wholes").alias("whole"))
    # counted with copies first, which is never less: only what may be template is counted as distinct pages
    maybe = leaves.groupBy("host", "chain", "mark").agg(F.count("*").alias("pages")).join(sizes, "host").filter(often).select("host", "chain", "mark", "all_pages")
    shared = (
        leaves.join(maybe, ["host", "chain", "mark"]).groupBy("host", "chain", "mark", "all_pages")
        .agg(F.approx_count_distinct("whole").alias("pages"), F.max("chars").alias("chars")).filter(often)
    )
    around = nodes.filter("slot").groupBy("host", "chain").agg(F.sum("chars").alias("held")).join(sizes, "host").select(
        "host", "chain", (F.col("held") / F.col("all_seen")).alias("held"))
    small = shared.groupBy("host", "chain").agg(F.sum("chars").alias("shared")).join(around, ["host", "chain"]).filter("2 * shared <= held")
    leaf = shared.join(small.select("host", "chain"), ["host", "chain"]).select("host", F.concat(F.lit("="), F.concat_ws(" ", "mark", "chain")).alias("rule"))
    fixed = slot.unionByName(leaf).groupBy("host").agg(F.collect_set("rule").alias("fixed"))
    return total.select("host").join(place, "host", "left").join(fixed, "host", "left").withColumn("place", F.coalesce("place", F.lit("")))


def _own(node: Node, path: str, fixed: set[str]) -> list[str]:
    """A slot's texts that are no template."""
    if not fixed:
        return node.texts
    chain = _chain(path)
    return [] if f"{_mark(node)} {chain}" in fixed else [t for t in node.texts if f"={_leaf(t)} {chain}" not in fixed]


def _blocks(node: Node, path: str, fixed: set[str]) -> list[str]:
    return [text for here, part in _paths(node, path) for text in _own(part, here, fixed)]


def main_text(page: str, place: str | None, fixed: set[str]) -> str:
    """The blocks of the element at ``place`` ('': the page) that are not in ``fixed`` (rules of ``learn``).

    Without such an element, of the largest article element, else of all that is content.
    """
    tree = slots(parse(page))
    nodes = list(_paths(tree))
    found = tree if place == "" else dict(nodes).get(place)
    if found is not None:
        return "\n".join(_own(found, place, fixed) if found.texts else _blocks(found, place, fixed))
    articles = [(path, node) for path, node in nodes if node.tag in ARTICLE and not node.texts]
    if articles:
        path, node = max(articles, key=lambda x: _chars(x[1]))
        return "\n".join(_blocks(node, path, fixed))
    return "\n".join(_blocks(tree, "", fixed))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of ``pages``; other columns are not used.

    Null and empty pages, and pages of nothing but menus and the like, have an empty text. A null url is a host of
    its own name, ''. Repeated rows each get a row. A host on which nothing varies (one page, or
    copies of one) has no template: all content of its articles stays.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    rules = learn(pages).select(F.col("host").alias("h"), "place", "fixed", salts.alias("s"))
    named = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn(
        "host", F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    ).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = zip(*(part.column(c).to_pylist() for c in ("html", "place", "fixed")), strict=True)
                texts = [main_text(page or "", place, set(fixed or ())) for page, place, fixed in rows]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return (
        named.join(rules, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("s")), "left").select("page_id", "url", "html", "place", "fixed")
        .mapInArrow(run, f"{kinds[0]}, {kinds[1]}, text string")
    )

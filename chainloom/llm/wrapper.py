"""Main text of web pages by wrapper induction.

Every page becomes a DOM tree whose like siblings (same tag, class and id, digits left out) are one node.  The trees of a
host are aligned by simple tree matching and merged into the host's wrapper: a node whose text is the same on all its pages
stays constant, one whose text differs becomes a slot.  Names and link density mark slots that are furniture (menus, headers,
footers, sidebars, notices, adverts, forms, comments).  A page is then aligned with its host's wrapper; the text of its
content slots is the result.  Where the wrapper has an article or main element, everything in it but furniture is content;
elsewhere content is what varies, and constant nodes are template.

Spark first counts the pages of every (host, path), where a path is the keys from the root to a node.  Only nodes on at least
half of their host's pages can be template, so only those enter the wrapper: at most twice as many as a page has on average,
however many ids or classes of single pages there are.  Wrappers are merged like partial aggregates: in every task first,
then over groups of at most FAN of them until one is left per host, so a host with a third of all pages is one small row per
task.  All pages take part.

Defined results: a null or empty html has empty text; pages without a url share the wrapper of the empty host; a host with
one page, or whose pages are all alike, has no template, only marked furniture; repeated rows give equal results; unclosed
elements end with their parent, and elements nested deeper than MAX_DEPTH become siblings at that depth; an empty table
gives an empty result; other columns are left out, so no name clashes.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import ROWS_AT_ONCE
from chainloom.operators.storage import materialise

MAX_DEPTH = 200
FAN = 64
HOSTS_AT_ONCE = 2000
PATHS_AT_ONCE = 100_000
ROOT = 0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<[!?/A-Za-z][^>]*\Z"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^>])*)>",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An open element of the second set ends where an element of the first starts; the third stops the search.
_IMPLIED = tuple(
    (frozenset(a.split()), frozenset(b.split()), frozenset(c.split()))
    for a, b, c in (
        ("li", "li", "ul ol menu dir"),
        ("dt dd", "dt dd", "dl"),
        ("option optgroup", "option", "select"),
        ("tr tbody thead tfoot", "tr td th", "table"),
        ("td th", "td th", "tr table"),
        ("tbody thead tfoot", "tbody thead tfoot", "table"),
    )
)
_FENCE = frozenset("table td th caption button object html body".split())
_FURNITURE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea input dialog head object canvas".split()
)
_FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs header masthead topbar footer cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies discussion respond "
    "related recommended recommendations widget toolbar pagination pager paging skip alert search complementary contentinfo".split()
)


class Element:
    __slots__ = ("tag", "names", "kids", "node", "hidden")

    def __init__(self, tag: str, names: frozenset[str] = frozenset(), hidden: bool = False):
        self.tag, self.names, self.hidden = tag, names, hidden
        self.kids: list[Element | str] = []
        self.node: Node | None = None


class Node:
    """Like siblings of one page, or of the pages merged so far: ``same`` is the digest of their text, None if it differs."""

    __slots__ = ("key", "same", "pages", "kids")

    def __init__(self, key: str, same: str | None, pages: int = 1, kids: list[Node] | None = None):
        self.key, self.same, self.pages, self.kids = key, same, pages, kids or []

    def plain(self) -> list:
        return [self.key, self.same, self.pages, [k.plain() for k in self.kids]]


def from_plain(x: list) -> Node:
    return Node(x[0], x[1], x[2], [from_plain(k) for k in x[3]])


def _attributes(text: str) -> tuple[frozenset[str], bool]:
    names: set[str] = set()
    hidden = False
    if "=" in text or "hidden" in text:
        for m in _ATTR.finditer(text):
            if m[5]:
                hidden = True
                continue
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                names.update(_NAME.findall(_CAMEL.sub(" ", value).lower()))
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
    return frozenset(names), hidden


def parse(page: str) -> Element:
    """Forgiving DOM: text and elements only."""
    root = Element("html")
    stack, at = [root], 0
    closers: dict[str, re.Pattern] = {}
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if not m["tag"]:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m["tag"].lower()
        if m["close"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in _BLOCK and stack[depth].tag in _FENCE:
                    break
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P:
            _end(stack, {"p"}, _FENCE)
        for starts, ends, stop in _IMPLIED:
            if tag in starts:
                _end(stack, ends, stop)
        element = Element(tag, *_attributes(m["attrs"]))
        stack[-1].kids.append(element)
        if tag in _RAW:
            closer = closers.setdefault(tag, re.compile(f"</{tag}\\b[^>]*>", re.I))
            end = closer.search(page, at)
            at = end.end() if end else len(page)
        elif tag not in _VOID and not m["attrs"].endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(element)
    return root


def _end(stack: list[Element], tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            del stack[depth:]
            return
        if stack[depth].tag in stop:
            return


def tidy(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def folded(elements: list[Element], key: str) -> Node:
    """One node for like siblings; each element remembers its node."""
    texts, groups = xxhash.xxh64(), {}
    for element in elements:
        for kid in element.kids:
            if isinstance(kid, str):
                if not kid.isspace():
                    texts.update(tidy(kid).encode("utf-8", "surrogatepass"))
                    texts.update(b"\n")
            else:
                name = f"{kid.tag}.{'.'.join(sorted(kid.names))}" if kid.names else kid.tag
                groups.setdefault(name, []).append(kid)
    node = Node(key, texts.hexdigest(), 1, [folded(group, name) for name, group in groups.items()])
    for element in elements:
        element.node = node
    return node


def matched(a: list[Node], b: list[Node]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two sibling lists: nodes matched below them, and which siblings match."""
    known = {x.key for x in a} & {x.key for x in b}
    if len(known) < len(a) or len(known) < len(b):  # a key of one side only matches nothing
        at, of = ([i for i, x in enumerate(side) if x.key in known] for side in (a, b))
        if len(at) < len(a) or len(of) < len(b):
            total, pairs = matched([a[i] for i in at], [b[j] for j in of])
            return total, [(at[i], of[j]) for i, j in pairs]
    if [x.key for x in a] == [x.key for x in b]:
        return sum(size(x, y) for x, y in zip(a, b, strict=True)), [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = best[i - 1][j - 1] + size(a[i - 1], b[j - 1]) if a[i - 1].key == b[j - 1].key else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], same)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def size(a: Node, b: Node) -> int:
    """Nodes that match in two trees whose roots have one key."""
    return 1 + (matched(a.kids, b.kids)[0] if a.kids and b.kids else 0)


def merge(a: Node, b: Node) -> Node:
    """The wrapper of both: matched nodes meet, the others are kept in order."""
    pairs = matched(a.kids, b.kids)[1]
    kids, i, j = [], 0, 0
    for x, y in [*pairs, (len(a.kids), len(b.kids))]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            kids.append(merge(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    return Node(a.key, a.same if a.same == b.same else None, a.pages + b.pages, kids)


def paths(node: Node, at: int = ROOT) -> Iterator[tuple[int, Node]]:
    """Every node with the digest of the keys that lead to it."""
    yield at, node
    for kid in node.kids:
        yield from paths(kid, step(at, kid.key))


def step(at: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), at) >> 1


def pruned(node: Node, kept: set[int], at: int = ROOT) -> Node:
    """The nodes whose paths are ``kept``; a path's beginnings are on at least as many pages."""
    below = ((kid, step(at, kid.key)) for kid in node.kids)
    return Node(node.key, node.same, node.pages, [pruned(kid, kept, path) for kid, path in below if path in kept])


def is_furniture(element: Element, inside: bool) -> bool:
    if element.hidden or element.tag in _FURNITURE_TAGS:
        return True
    if element.tag == "header":
        return not inside
    if element.tag in ("html", "body", "main") or not element.names & _FURNITURE_NAMES:
        return False
    if element.tag == "article":
        return bool(element.names & {"comment", "comments", "reply", "ad", "ads", "advert", "related", "promo"})
    return not any(k.tag in ("article", "main", "h1") for k in _elements(element))


def _elements(element: Element) -> Iterator[Element]:
    todo = [k for k in element.kids if not isinstance(k, str)]
    while todo:
        e = todo.pop()
        yield e
        todo += [k for k in e.kids if not isinstance(k, str)]


def _weights(element: Element) -> tuple[int, int]:
    """Characters of text, and of those in links."""
    own = sum(len(k.strip()) for k in element.kids if isinstance(k, str))
    linked = 0
    for kid in element.kids:
        if not isinstance(kid, str):
            a, b = _weights(kid)
            own, linked = own + a, linked + (a if kid.tag == "a" else b)
    return own, linked


def constants(page: Node, host: Node) -> dict[int, bool]:
    """By node of the page: whether the host's wrapper has it with one text on at least half of its pages, of two or more."""
    out: dict[int, bool] = {}

    def walk(a: Node, b: Node) -> None:
        out[id(a)] = b.same is not None and b.pages > 1 and 2 * b.pages >= host.pages
        for i, j in matched(a.kids, b.kids)[1]:
            walk(a.kids[i], b.kids[j])

    walk(page, host)
    return out


def extract(page: str, host: Node | None) -> str:
    """The content of a page: its blocks, one a line."""
    root = parse(page)
    tree = folded([root], "html")
    template = constants(tree, host) if host else {}
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = tidy("".join(run))
        run.clear()
        if text:
            blocks.append(text)

    def emit(element: Element, inside: bool) -> None:
        for kid in element.kids:
            if isinstance(kid, str):
                run.append(kid)
            elif kid.tag == "br":
                run.append(" ")
            elif not is_furniture(kid, inside) and (inside or not is_template(kid)):
                if kid.tag in _BLOCK:
                    flush()
                    emit(kid, inside)
                    flush()
                else:
                    emit(kid, inside)

    def is_template(element: Element) -> bool:
        if element.tag in ("html", "body"):
            return False
        if element.tag in ("ul", "ol", "table", "div", "section", "p"):
            whole, linked = _weights(element)
            if whole and linked > 0.6 * whole:
                return True
        return fixed(element.node)

    def fixed(node: Node) -> bool:
        return template.get(id(node), False) and all(map(fixed, node.kids))

    tops = list(_containers(root, "article")) or list(_containers(root, "main"))
    for top in tops or [root]:
        emit(top, bool(tops))
        flush()
    return "\n".join(blocks)


def _containers(element: Element, tag: str) -> Iterator[Element]:
    for kid in element.kids:
        if not isinstance(kid, str) and not is_furniture(kid, False):
            if kid.tag == tag or tag == "main" and "main" in kid.names and kid.tag in ("div", "section"):
                yield kid
            else:
                yield from _containers(kid, tag)


def common_paths(pages: DataFrame) -> DataFrame:
    """(host, paths) of the hosts with texts that differ: the paths on at least half of their pages, from (host, html)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}

        def emit() -> pa.RecordBatch:
            hosts, at = [k[0] for k in found], [k[1] for k in found]
            n, low, high = zip(*found.values(), strict=True) if found else ((), (), ())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array(x, kind) for x, kind in zip((hosts, at, n, low, high), kinds, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["host", "path", "n", "low", "high"])

        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                name = host.as_py()
                for path, node in paths(folded([parse(page.as_py())], "html")):
                    known = found.get((name, path))
                    if known:
                        known[0] += 1
                        known[1], known[2] = min(known[1], node.same), max(known[2], node.same)
                    else:
                        found[name, path] = [1, node.same, node.same]
                if len(found) >= PATHS_AT_ONCE:
                    yield emit()
        yield emit()

    counted = pages.select("host", "html").mapInArrow(count, "host string, path long, n long, low string, high string")
    counted = counted.groupBy("host", "path").agg(F.sum("n").alias("n"), (F.min("low") != F.max("high")).alias("differs"))
    counted = materialise(counted, "wrapper-paths")
    of = F.max(F.when(F.col("path") == ROOT, F.col("n"))).alias("of")
    hosts = counted.groupBy("host").agg(of, F.max("differs").alias("varies")).filter("of > 1 AND varies").select("host", "of")
    kept = counted.join(hosts, "host").filter("2 * n >= of")
    return materialise(kept.groupBy("host").agg(F.collect_list("path").alias("paths")), "wrapper-kept")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host with texts that differ, from (host, html)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, known = TaskContext.get().partitionId(), {}, {}

        def emit() -> pa.RecordBatch:
            texts = [json.dumps(w.plain(), separators=(",", ":")) for w in found.values()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int64()), pa.array(texts, pa.string())],
                names=["host", "part", "wrapper"],
            )
            found.clear()
            return out

        for batch in batches:
            for host, page, kept in zip(*batch.columns, strict=True):
                name = host.as_py()
                if name not in known:
                    if len(known) >= HOSTS_AT_ONCE:
                        known.clear()
                    known[name] = set(kept.as_py())
                tree = pruned(folded([parse(page.as_py())], "html"), known[name])
                found[name] = merge(found[name], tree) if name in found else tree
                if len(found) >= HOSTS_AT_ONCE:
                    yield emit()
        yield emit()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "wrapper"])
        whole = None
        for text in group["wrapper"]:
            tree = from_plain(json.loads(text))
            whole = merge(whole, tree) if whole else tree
        first = group.iloc[0]
        return pd.DataFrame({"host": [first["host"]], "part": [first["part"]], "wrapper": [json.dumps(whole.plain(), separators=(",", ":"))]})

    schema = "host string, part long, wrapper string"
    taking = pages.select("host", "html").join(common_paths(pages), "host").select("host", "html", "paths")
    found = materialise(taking.mapInArrow(fold, schema), "wrapper-parts")
    most = found.agg(F.max("part")).first()[0] or 0
    while True:
        most //= FAN
        grouped = found.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        found = grouped.groupBy("host", "part").applyInPandas(meet, schema)
        if not most:
            return materialise(found.select("host", "wrapper"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = wrappers(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part, texts = batch.slice(start, ROWS_AT_ONCE), []
                for page, text in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                    if text is not None and text not in known:
                        if len(known) >= HOSTS_AT_ONCE:
                            known.clear()
                        known[text] = from_plain(json.loads(text))
                    texts.append(extract(page, known.get(text)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by wrappers, inferred as union-free regular expressions per host.

A page is a tree of labelled elements and texts. Neighbours that repeat are folded into a
repeated group; aligning two pages of a host matches what they share, makes what only one
has optional and texts that differ slots. Going on so over all pages of a host gives its
wrapper. Tasks align the pages that they read, host by host; what they found, one small
wrapper for each host and task, is merged in two rounds, so that a host with a third of all
pages is no large group. The wrapper tells which of its elements hold the article: the
article element if the host has one, else its main element, else the element with most
varying blocks; texts that never vary and that most pages have, two at least, are then left
out as template.

Each page goes through the rules of its host's wrapper; a page that has none of the wrapper's
places is its own wrapper. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and comments are recognised by element, role or class, wherever they stand, but for elements
that hold every article of the page, or without one most of what varies.

Blocks are block elements, in page order; white space inside a block becomes one space.
Defined cases: null or empty html has no text; unclosed and stray tags are read as browsers
do; a null or odd address is a host of its own kind (empty); repeated rows are extracted
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.llm.common import batch_of, small_batches, table, written

#: Wrappers of this many tasks meet in the first round.
ROUND = 64
#: Hosts whose wrappers a task holds before it hands them on.
HOSTS_HELD = 5000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?"
    r"|([^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg"}
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag of the key closes, up to the nearest of the second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "option": ({"option"}, {"select"}),
}
_DROP_TAGS = _RAW | set("head nav header footer aside form menu button select input label dialog object".split())
_PART = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notification|alert|popup|modal"
    r"|comments?|replies|disqus|sidebar|side|widget|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead"
    r"|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar)"
)
_BEFORE = (
    r"(?:site|page|main|top|bottom|left|right|upper|lower|primary|secondary|global|local|post|article|entry|user|web|blog"
    r"|sub|mobile|footer|header|inline|sticky|floating|google|gdpr|email|mail|wp|js|c|l|m|o)"
)
_AFTER = (
    r"(?:area|bar|block|body|box|bottom|button|buttons|col|column|container|content|footer|form|group|header|holder|icons"
    r"|inner|item|items|label|left|links?|list|main|outer|overlay|panel|policy|posts|primary|right|row|section|slot"
    r"|text|title|toggle|top|unit|wrap|wrapper)"
)
#: Whole words of class, id or role: a listed part, or several, with words that only say where or in what it stands.
_DROP_WORDS = re.compile(rf"(?:^| )(?:{_BEFORE}[-_]+)*{_PART}(?:[-_]+(?:{_PART}|{_AFTER}))*[-_]*(?=$| )")


class Node:
    """An element (or a text, whose label is empty) with how often it stands there: '', '?', '+' or '*'.

    ``pages`` is how many pages have it.
    """

    __slots__ = ("label", "often", "parts", "text", "pages")

    def __init__(self, label: str, often: str = "", parts: list | None = None, text: str | None = None, pages: int = 1):
        self.label, self.often, self.parts, self.text = label, often, parts if parts is not None else [], text
        self.pages = pages

    def packed(self) -> list:
        """Depth, label, often, text and pages of this and all below, in page order."""
        out, todo = [], [(self, 0)]
        while todo:
            node, depth = todo.pop()
            out.append([depth, node.label, node.often, node.text, node.pages])
            todo += [(p, depth + 1) for p in reversed(node.parts)]
        return out


def unpacked(data: list) -> Node:
    above: list[Node] = []
    for depth, label, often, text, pages in data:
        node = Node(label, often, text=text, pages=pages)
        del above[depth:]
        if above:
            above[-1].parts.append(node)
        above.append(node)
    return above[0]


def _deep(task):
    """The result of a generator that yields such generators for the results it needs; depth costs no Python stack."""
    stack, value = [task], None
    while stack:
        try:
            task = stack[-1].send(value)
        except StopIteration as done:
            stack.pop()
            value = done.value
        else:
            stack.append(task)
            value = None
    return value


def _label(tag: str, attributes: str) -> str:
    """Tag, then the words of class, id and role without digits."""
    if not attributes or "=" not in attributes:
        return tag
    words = set()
    for _, *values in _ATTRIBUTE.findall(attributes):
        words.update(re.sub(r"\d+", "", next((v for v in values if v), "")).lower().split())
    return " ".join([tag, *sorted(w for w in words if w)])


def tree(html: str) -> Node:
    """The elements and texts of a page."""
    root = Node("#")
    stack = [root]
    tags = ["#"]
    at, size = 0, len(html)
    match = _TOKEN.match
    while at < size:
        found = match(html, at)
        at = found.end()
        text = found[7]
        if text is not None:
            if text.strip():
                stack[-1].parts.append(Node("", text=text))
            elif stack[-1].parts and not stack[-1].parts[-1].label:
                stack[-1].parts[-1].text += " "
            else:
                stack[-1].parts.append(Node("", text=" "))
            continue
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1] or found[4]:
            if tag in tags:
                while tags.pop() != tag:
                    stack.pop()
                stack.pop()
            continue
        if tag in _BLOCK and "p" in tags and tag not in ("html", "body"):
            back = len(tags) - 1 - tags[::-1].index("p")
            if not any(t in ("button", "table", "td", "th", "object") for t in tags[back:]):
                del tags[back:], stack[back:]
        if tag in _CLOSES:
            ends, limits = _CLOSES[tag]
            for back in range(len(tags) - 1, 0, -1):
                if tags[back] in ends:
                    del tags[back:], stack[back:]
                    break
                if tags[back] in limits:
                    break
        attributes = found[3] or found[6] or ""
        if tag == "br":
            stack[-1].parts.append(Node("", text=" "))
            continue
        if tag in ("html", "body", "head") and tag in tags:
            continue
        if tag in ("article", "body", "main") and "head" in tags:
            back = tags.index("head")
            del tags[back:], stack[back:]
        node = Node(_label(tag, attributes))
        stack[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
            at = end.end() if end else size
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(node)
            tags.append(tag)
    return root


def dropped(label: str) -> bool:
    """Whether an element never belongs to the main text."""
    tag, _, words = label.partition(" ")
    return tag in _DROP_TAGS or bool(words and tag not in ("html", "body", "article", "main") and _DROP_WORDS.search(words))


def expression(node: Node) -> Node:
    """The union-free expression of one page: texts by checksum, repeated neighbours folded."""
    return _deep(_expression(node))


def _expression(node: Node):
    parts = []
    for part in node.parts:
        if part.label:
            parts.append((yield _expression(part)))
        elif part.text.strip():
            parts.append(Node("", text=f"{zlib.crc32(' '.join(part.text.split()).encode()):08x}"))
    return Node(node.label, node.often, (yield _folded(parts)))


def _folded(parts: list[Node]):
    """Neighbours that repeat (one, two or three at a time) as one repeated group."""
    out: list[Node] = []
    at = 0
    while at < len(parts):
        for width in (1, 2, 3):
            block = parts[at : at + width]
            names = [p.label for p in block]
            times = 1
            while [p.label for p in parts[at + times * width : at + (times + 1) * width]] == names:
                times += 1
            if times > 1 and any(names):
                merged = block
                for k in range(1, times):
                    others = parts[at + k * width : at + (k + 1) * width]
                    pairs, merged = zip(merged, others, strict=True), []
                    for a, b in pairs:
                        merged.append((yield _merging(a, b, True)))
                if width == 1:
                    merged[0].often = "+" if "?" not in merged[0].often and merged[0].often != "*" else "*"
                    out.append(merged[0])
                else:
                    out.append(Node("()", "+", merged))
                at += times * width
                break
        else:
            out.append(parts[at])
            at += 1
    return out


def _often(a: str, b: str) -> str:
    rep, opt = bool({a, b} & {"+", "*"}), bool({a, b} & {"?", "*"})
    return ("*" if opt else "+") if rep else ("?" if opt else "")


def _merged(a: Node, b: Node) -> Node:
    """The expression that covers two of different pages that have one label."""
    return _deep(_merging(a, b, False))


def _merging(a: Node, b: Node, one_page: bool):
    often = _often(a.often, b.often)
    pages = max(a.pages, b.pages) if one_page else a.pages + b.pages
    if not a.label:
        return Node("", often, text=a.text if a.text == b.text else None, pages=pages)
    return Node(a.label, often, (yield _aligned(a.parts, b.parts, one_page)), pages=pages)


def _optional(node: Node) -> Node:
    return Node(node.label, _often(node.often, "?"), node.parts, node.text, node.pages)


def _aligned(a: list[Node], b: list[Node], one_page: bool):
    """Two sequences as one: what both have is merged, what one has is optional."""
    if [x.label for x in a] == [y.label for y in b]:
        both = []
        for x, y in zip(a, b, strict=True):
            both.append((yield _merging(x, y, one_page)))
        return both
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            if a[i].label == b[j].label:
                best[i][j] = best[i + 1][j + 1] + (2 if a[i].label else 1)
            else:
                best[i][j] = max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i].label == b[j].label and best[i][j] == best[i + 1][j + 1] + (2 if a[i].label else 1):
            out.append((yield _merging(a[i], b[j], one_page)))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(_optional(a[i]))
            i += 1
        else:
            out.append(_optional(b[j]))
            j += 1
    return (yield _folded([*out, *map(_optional, a[i:]), *map(_optional, b[j:])]))


def _walk(node: Node, path: tuple[str, ...], kept: frozenset = frozenset()) -> Iterator[tuple[tuple[str, ...], Node]]:
    """Elements that may belong to the text, with their paths; groups are passed through."""
    todo = [(part, path) for part in reversed(node.parts)]
    while todo:
        part, path = todo.pop()
        if not part.label:
            continue
        if part.label != "()":
            path = (*path, part.label)
            if id(part) not in kept and dropped(part.label):
                continue
            yield path, part
        todo += [(p, path) for p in reversed(part.parts)]


def _inside(node: Node) -> list[Node]:
    """An element and all elements and groups below it, each before what it holds."""
    out = [node]
    for own in out:
        out += [p for p in own.parts if p.label]
    return out


def _texts(node: Node, fixed: bool, kept: frozenset | None = frozenset()) -> dict[int, float]:
    """Varying texts (or, if ``fixed``, all) in blocks below each element; repeated ones weigh more.

    What is dropped does not count, unless it is in ``kept`` or that is None.
    """
    total: dict[int, float] = {}
    for own in reversed(_inside(node)):
        n = 0.0
        for part in own.parts:
            if not part.label:
                n += fixed or part.text is None
            elif part.label == "()" or kept is None or id(part) in kept or not dropped(part.label):
                n += total[id(part)] * (4 if part.often in ("+", "*") else 1)
        total[id(own)] = n
    return total


def _never_dropped(wrapper: Node) -> frozenset:
    """Elements that hold all articles and main elements, or without these most of what varies."""
    inside = _inside(wrapper)
    held: dict[int, int] = {}
    for own in reversed(inside):
        held[id(own)] = (own.label.split(" ")[0] in ("article", "main")) + sum(held[id(p)] for p in own.parts if p.label)
    every = held[id(wrapper)]
    if every:
        return frozenset(id(n) for n in inside if held[id(n)] == every)
    # Elements that are dropped by their tag, such as menus, have no say in what varies.
    tags = frozenset(id(n) for n in inside if n.label.split(" ")[0] not in _DROP_TAGS)
    varying = _texts(wrapper, False, tags)
    if not varying[id(wrapper)]:
        varying = _texts(wrapper, True, tags)
    return frozenset(i for i in tags if varying[i] > 0.5 * varying[id(wrapper)])


def rules(wrapper: Node) -> dict:
    """Paths of the elements that hold the article, and checksums of template texts to leave out."""
    kept = _never_dropped(wrapper)
    found = list(_walk(wrapper, (), kept))
    spared = sorted({path for path, node in found if dropped(node.label)})
    more = {"kept": spared} if spared else {}
    for tag in ("article", "main"):
        roots = [path for path, node in found if node.label.split(" ")[0] == tag]
        outer = [p for p in roots if not any(p != q and p[: len(q)] == q for q in roots)]
        if outer:
            return {"roots": sorted(set(outer)), "template": [], **more}
    # The innermost block that still has most of what varies, or of all texts if nothing does.
    fixed = not _texts(wrapper, False, kept)[id(wrapper)]
    texts = _texts(wrapper, fixed, kept)
    whole = texts[id(wrapper)]
    rich = [
        path for path, node in found
        if node.label.split(" ")[0] in _BLOCK and texts[id(node)] >= 0.7 * whole
    ]
    path = max(rich, key=len, default=())
    template: set[str] = set()
    # A text of one page, or of few of the host's, is no template.
    several = max(2, wrapper.pages // 2 + 1)
    if not fixed:
        for _, node in found:
            same = [p for p in node.parts if not p.label and p.text is not None and p.often in ("", "?")]
            template |= {p.text for p in same if p.pages >= several}
    return {"roots": [path], "template": sorted(template), **more}


def blocks(root: Node, rule: dict) -> list[str]:
    """Texts of the blocks of a page that its rule takes."""
    roots, template = {tuple(p) for p in rule["roots"]}, set(rule["template"])
    kept = {tuple(p) for p in rule.get("kept", [])}
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text and not (template and f"{zlib.crc32(text.encode()):08x}" in template):
                out.append(text)
            held.clear()

    # Elements still to do, with their path and whether they are inside; None closes a block.
    todo: list = [(root, (), False)]
    while todo:
        item = todo.pop()
        if item is None:
            close()
            continue
        node, path, inside = item
        if not node.label:
            if inside:
                held.append(node.text)
            continue
        if path and dropped(node.label) and path not in kept:
            continue
        inside = inside or path in roots
        block = node.label.split(" ")[0] in _BLOCK
        if block:
            close()
            todo.append(None)
        for part in reversed(node.parts):
            todo.append((part, (*path, part.label) if part.label and (kept or not inside) else path, inside))
    close()
    return out


def main_text(html: str, rule: dict | None) -> str:
    """The main text of a page by its host's rule, or by its own if it has no place of that rule."""
    root = tree(html)
    found = blocks(root, rule) if rule else []
    if not found:
        found = blocks(root, rules(expression(root)))
    return "\n\n".join(found)


def host(url: Column) -> Column:
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


_WRAPPER = "host string, part long, wrapper string"
_WRAPPER_ARROW = pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())])


def _dump(node: Node) -> str:
    return json.dumps(node.packed(), separators=(",", ":"))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of a task's pages."""
    part = TaskContext.get().partitionId()
    held: dict[str, Node] = {}

    def out() -> pa.RecordBatch:
        return batch_of(_WRAPPER_ARROW, [list(held), [part] * len(held), [_dump(w) for w in held.values()]])

    for batch in batches:
        for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own = expression(tree(html or ""))
            held[name] = _merged(held[name], own) if name in held else own
        if len(held) > HOSTS_HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the wrappers of a host; they stand next to each other."""
    name, part, wrapper = None, 0, None
    done: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            own = unpacked(json.loads(row["wrapper"]))
            if wrapper is not None and row["host"] == name:
                wrapper = _merged(wrapper, own)
            else:
                if wrapper is not None:
                    done.append((name, part, _dump(wrapper)))
                name, part, wrapper = row["host"], row["part"], own
        if done:
            yield batch_of(_WRAPPER_ARROW, [list(c) for c in zip(*done, strict=True)])
            done = []
    if wrapper is not None:
        yield batch_of(_WRAPPER_ARROW, [[name], [part], [_dump(wrapper)]])


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper (as JSON) of all hosts."""
    small_batches(pages.sparkSession)
    found = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_infer, _WRAPPER)
    group = F.floor(F.col("part") / ROUND)
    first = found.repartition("host", group).sortWithinPartitions("host", group, "part").mapInArrow(_merge, _WRAPPER)
    return first.repartition("host").sortWithinPartitions("host", "part").mapInArrow(_merge, _WRAPPER).select("host", "wrapper")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    small_batches(pages.sparkSession)
    known = written(wrappers(pages), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
                if wrapper is not None and wrapper not in held:
                    if len(held) > HOSTS_HELD:
                        held.clear()
                    held[wrapper] = rules(unpacked(json.loads(wrapper)))
                texts.append(main_text(html or "", held.get(wrapper)))
            schema = pa.schema([batch.schema.field("page_id"), batch.schema.field("url"), ("text", pa.string())])
            yield batch_of(schema, [batch.column("page_id"), batch.column("url"), texts])

    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    id_type = pages.schema["page_id"].dataType.simpleString()
    return (
        rows.join(known, "host", "left").select("page_id", "url", "html", "wrapper")
        .mapInArrow(run, f"page_id {id_type}, url string, text string")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )

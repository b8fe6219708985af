"""Main text of web pages by wrapper induction: aligned pages of a host give its template and its content slots."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.shared import checkpointed, table

#: Fixed values of HTML: elements without end, elements that never hold article text, elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map nav footer aside "
    "form button select option textarea input label fieldset dialog menu".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start of the first closes an open element among the second, up to the third.
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id and role that mark what is not the article.
ASIDE = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "alert sidebar side menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar comment comments "
    "commentlist reply replies respond disqus discussion share sharing social related recommended newsletter subscribe subscription "
    "signup login popup modal overlay search pagination pager skip widget banner contentinfo complementary".split()
)
#: A page's header is not the article, but one inside the article holds its heading.
PAGE_HEADER = frozenset("header topbar".split())
#: Parts that a class name or id may have beside those words, and marks of remarks, which are never the article.
PLAIN = frozenset("site area box block list links posts buttons items slot bar".split())
REMARKS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Of the elements that never hold article text, those that pages put around everything.
AROUND = frozenset(("form", "fieldset"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Article and main elements are a hint: they are the content if they hold this share of the host's varying text, or
#: more than this share of the text of a page without a wrapper.
HINT_OF_HOST, HINT_OF_PAGE = 0.8, 0.5
#: A slot is template if this share of a host's distinct pages, and so many at least, surely have the same text in it.
SAME, LEAST_PAGES = 0.7, 5
#: A page with less than this share of text beside the template is one of many near copies: it keeps all its text.
OWN = 0.02
#: Keys that the pages of a host are dealt to.
SALTS = 32
#: Values kept for each slot to prove that; elements nested deeper than so many blocks are one slot.
KEPT, DEEPEST = 4, 60
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """An element, or text if it has no tag."""

    tag: str
    names: tuple[str, ...] = ()
    children: list[Node] = field(default_factory=list)
    text: str = ""
    marks: frozenset[str] = frozenset()

    @property
    def label(self) -> str:
        return " ".join((self.tag, *self.names))


@lru_cache(maxsize=4096)
def _named(value: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words of class names, an id or a role; and those that mark, of names that consist of marks and plain parts alone."""
    words: set[str] = set()
    marks: set[str] = set()
    for name in value.lower().split():
        parts = set(_TOKEN.findall(name))
        words |= parts
        telling = {part for part in parts if len(part) > 1} - PLAIN
        if telling <= ASIDE | PAGE_HEADER:
            marks |= telling
    return frozenset(words), frozenset(marks)


class _Parser(HTMLParser):
    """Builds a tree of any input, however broken; with open elements closed as browsers do in the common cases."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page")
        self.open = [self.root]

    def _close(self, tags: frozenset | set, stop: set | frozenset) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                del self.open[depth:]
                return
            if self.open[depth].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        given = dict(attrs)
        named = [_named(given[name]) for name in ("class", "id", "role") if given.get(name)]
        words, marks = (frozenset().union(*sets) for sets in zip(*named)) if named else ((), frozenset())
        node = Node(tag, tuple(sorted(words)), marks=marks)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(Node("", text=data))


def parse(html: str) -> Node:
    """Tree of a page."""
    parser = _Parser()
    parser.feed(html)
    parser.close()
    return parser.root


def _is_aside(node: Node, in_article: bool) -> bool:
    if node.tag in NEVER or not ASIDE.isdisjoint(node.marks):
        return node.tag not in ("body", "html")
    return not in_article and (node.tag == "header" or not PAGE_HEADER.isdisjoint(node.marks)) and node.tag not in ("body", "html")


def _is_remark(node: Node) -> bool:
    return node.tag not in ARTICLE and not REMARKS.isdisjoint(node.marks)


def _may_hold(node: Node) -> bool:
    """Whether an element may hold the article though its markup speaks against it."""
    return (node.tag not in NEVER or node.tag in AROUND) and not _is_remark(node)


def _most(root: Node) -> set[int]:
    """Elements that hold more than half of the page's text, without what can't be the article."""
    sizes: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            sizes[id(node)] = len(node.text.strip()) + sum(sizes.get(id(child), 0) for child in node.children)
        elif not node.tag or node is root or _may_hold(node):
            stack.append((node, True))
            stack += [(child, False) for child in node.children]
    return {number for number, size in sizes.items() if 2 * size > sizes[id(root)]}


def pruned(root: Node) -> Node:
    """The tree without what its own markup declares to be no article text.

    If that takes all article and main elements, or there are none, elements that hold most of the text stay.
    """
    kept, whole, dropped = _without(root, frozenset())
    if dropped and not whole and (most := _most(root)):
        kept = _without(root, most)[0]
    return kept


def _without(root: Node, held: set[int] | frozenset[int]) -> tuple[Node, bool, bool]:
    """The tree without marked elements but those held; whether an article or main is left; whether one that may hold it went."""
    kept = Node(root.tag, root.names, [], root.text, root.marks)
    stack = [(root, kept, root.tag in ARTICLE)]
    whole = dropped = False
    while stack:
        node, copy, inside = stack.pop()
        for child in node.children:
            if child.tag and id(child) not in held and _is_aside(child, inside):
                dropped = dropped or _may_hold(child)
                continue
            own = Node(child.tag, child.names, [], child.text, child.marks)
            copy.children.append(own)
            whole = whole or child.tag in ARTICLE
            if child.children:
                stack.append((child, own, inside or child.tag in ARTICLE))
    return kept, whole, dropped


def blocks(root: Node, skip: frozenset[int] = frozenset()) -> list[tuple[int, str]]:
    """(number of the node that holds it, text) of each block, in page order, white space joined."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    owner = [id(root)]

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            found.append((owner[0], text))

    stack: list[tuple] = [("in", root, 0)]
    while stack:
        what, node, outer = stack.pop()
        if what == "out":
            flush()
            owner[0] = outer
        elif not node.tag:
            held.append(node.text)
        elif id(node) in skip:
            continue
        elif node.tag == "br":
            held.append(" ")
        else:
            if node.tag in BLOCKS:
                flush()
                stack.append(("out", node, owner[0]))
                owner[0] = id(node)
            stack += [("in", child, 0) for child in reversed(node.children)]
    flush()
    return found


@dataclass
class Slot:
    """A node of a wrapper: siblings of one label are one slot, `many` if a page has several.

    n counts pages, size the characters of text, values (hash: count) texts that may be most pages'.
    """

    label: str
    n: int = 1
    many: bool = False
    size: int = 0
    values: dict[int, int] = field(default_factory=dict)
    slots: list[Slot] = field(default_factory=list)
    nodes: list[int] = field(default_factory=list)

    def packed(self) -> list:
        return [self.label, self.n, int(self.many), self.size, list(self.values.items()), [s.packed() for s in self.slots]]

    @staticmethod
    def unpacked(row: list) -> Slot:
        label, n, many, size, values, slots = row
        return Slot(label, n, bool(many), size, {k: v for k, v in values}, [Slot.unpacked(s) for s in slots])

    @property
    def tag(self) -> str:
        return self.label.split(" ")[0]

    @cached_property
    def path(self) -> list[Slot]:
        """Slots from a wrapper's root to its content."""
        return content_path(self)

    @property
    def constant(self) -> bool:
        """Whether the text is surely the same on most pages; what several siblings share is a list, not template."""
        return not self.many and self.n >= LEAST_PAGES and max(self.values.values(), default=0) >= SAME * self.n


def _summed(a: dict[int, int], b: dict[int, int]) -> dict[int, int]:
    """Frequent values of both, each count a lower bound (Misra-Gries)."""
    both = dict(a)
    for value, n in b.items():
        both[value] = both.get(value, 0) + n
    if len(both) > KEPT:
        cut = sorted(both.values(), reverse=True)[KEPT]
        both = {value: n - cut for value, n in both.items() if n > cut}
    return both


def _aligned(left: list[Slot], right: list[Slot]) -> tuple[int, list[tuple[Slot | None, Slot | None]]]:
    """Simple tree matching of two lists of subtrees: the most nodes that match in order, and which of the two lists do."""
    matches = [[_match(a, b) for b in right] for a in left]
    most = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left)):
        for j in range(len(right)):
            most[i + 1][j + 1] = max(most[i][j + 1], most[i + 1][j], most[i][j] + matches[i][j])
    pairs: list[tuple[Slot | None, Slot | None]] = []
    i, j = len(left), len(right)
    while i or j:
        if i and j and matches[i - 1][j - 1] and most[i][j] == most[i - 1][j - 1] + matches[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((left[i], right[j]))
        elif j and (not i or most[i][j] == most[i][j - 1]):
            j -= 1
            pairs.append((None, right[j]))
        else:
            i -= 1
            pairs.append((left[i], None))
    return most[-1][-1], pairs[::-1]


def _match(a: Slot, b: Slot) -> int:
    return 1 + _aligned(a.slots, b.slots)[0] if a.label == b.label else 0


def merged(a: Slot, b: Slot, siblings: bool = False) -> Slot:
    """Both slots as one: of two pages, or of two siblings of one page."""
    pairs = [x if y is None else y if x is None else merged(x, y, siblings) for x, y in _aligned(a.slots, b.slots)[1]]
    n = max(a.n, b.n) if siblings else a.n + b.n
    return Slot(a.label, n, siblings or a.many or b.many, a.size + b.size, _summed(a.values, b.values), pairs, a.nodes + b.nodes)


def folded(root: Node) -> Slot:
    """A page's tree of block elements, neighbouring siblings of one label folded into one slot."""
    text: dict[int, list[str]] = {}
    for owner, own in blocks(root):
        text.setdefault(owner, []).append(own)

    def slot_of(node: Node, nodes: list[int]) -> Slot:
        own = " ".join(part for number in nodes for part in text.get(number, ()))
        values = {zlib.crc32(own.encode("utf-8", "surrogatepass")): 1} if own else {}
        return Slot(node.label, size=len(own), values=values, nodes=nodes)

    def fold(node: Node, depth: int) -> Slot:
        slot = slot_of(node, [id(node)])
        for child in _block_children(node):
            inner = fold(child, depth + 1) if depth < DEEPEST else slot_of(child, [id(below) for below in _all(child)])
            if slot.slots and slot.slots[-1].label == inner.label:
                slot.slots[-1] = merged(slot.slots[-1], inner, siblings=True)
            else:
                slot.slots.append(inner)
        return slot

    return fold(root, 0)


def _block_children(node: Node) -> Iterator[Node]:
    """Nearest block elements below, through inline ones."""
    stack = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if child.tag in BLOCKS:
            yield child
        elif child.tag:
            stack += reversed(child.children)


def _varying(slot: Slot) -> int:
    own = 0 if slot.constant else slot.size
    return own + sum(_varying(s) for s in slot.slots)


def content_path(wrapper: Slot) -> list[Slot]:
    """Slots from the root to the lowest element that holds all of the varying text and is no single block of it.

    One article or main element needs to hold only most of it, unless a heading beside it varies.
    """
    path, total = [wrapper], _varying(wrapper)
    while total:
        best = max(path[-1].slots, key=_varying, default=None)
        if best is None or not best.slots or best.many:
            break
        hinted = best.tag in ARTICLE and not any(s.tag in HEADINGS and _varying(s) for s in path[-1].slots)
        if _varying(best) < total * (HINT_OF_HOST if hinted else 1):
            break
        path.append(best)
        total = _varying(best)
    return path


def _judged(wrapper: Slot, page: Slot) -> tuple[Slot, frozenset[int]]:
    """The page's slot that aligns with the wrapper's content, as deep as there is one; the nodes whose text is template."""
    found, template = page, set()

    def walk(slot: Slot, own: Slot, path: list[Slot]) -> None:
        nonlocal found
        for a, b in _aligned(slot.slots, own.slots)[1]:
            if a is None or b is None:
                continue
            if a.constant and b.values and a.values.get(next(iter(b.values)), 0) >= SAME * a.n:
                template.update(b.nodes)
            below = path[1:] if path and a is path[0] else []
            if path and a is path[0]:
                found = b
            walk(a, b, below)

    walk(wrapper, page, wrapper.path[1:])
    return found, frozenset(template)


def _elements(root: Node, wanted: frozenset[str] | set[str]) -> list[Node]:
    """Outermost elements of some tags."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in wanted:
            found.append(node)
        else:
            stack += reversed(node.children)
    return found


def _declared(root: Node) -> list[tuple[int, str]]:
    """Blocks of a page's article elements, else main elements, if these hold most of its text; else all."""
    whole = blocks(root)
    for tag in ("article", "main"):
        inside = [part for node in _elements(root, {tag}) for part in blocks(node)]
        if sum(len(text) for _, text in inside) > HINT_OF_PAGE * sum(len(text) for _, text in whole):
            return inside
    return whole


def main_text(html: str, wrapper: Slot | None = None) -> str:
    """Article text of a page. Template is left out unless nothing else is left; without a wrapper of enough pages, markup decides alone."""
    root = pruned(parse(html))
    if wrapper is not None and wrapper.n >= LEAST_PAGES:
        page = folded(root)
        found, template = _judged(wrapper, page)
        whole = blocks(root) if template else []
        own = [part for part in whole if part[0] not in template]
        if not template or sum(len(text) for _, text in own) >= OWN * sum(len(text) for _, text in whole):
            wanted = set(found.nodes)
            inside = [part for node in _all(root) if id(node) in wanted for part in blocks(node)]
            kept = [text for owner, text in inside if owner not in template]
            return "\n\n".join(kept or [text for _, text in own or inside])
    return "\n\n".join(text for _, text in _declared(root))


def _all(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.children)


def _host() -> Column:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)
    return F.lower(host)


@lru_cache(maxsize=256)
def _wrapper(packed: str) -> Slot:
    return Slot.unpacked(json.loads(packed))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) by aligning the trees of all pages of each host; pages all of whose blocks are equal count once.

    A task aligns the pages it holds, host by host, into partial wrappers, one per host and task; these are aligned
    in their turn. So pages of a host with very many are spread, and only small trees meet in one task.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, marks = [], []
            for html in batch.column(1).to_pylist():
                root = pruned(parse(html or ""))
                packed.append(json.dumps(folded(root).packed()))
                whole = "\n\n".join(text for _, text in blocks(root)).encode("utf-8", "surrogatepass")
                marks.append(int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed), pa.array(marks, pa.int64())], ["host", "tree", "mark"])

    def together(rows: list[tuple[str, str]], held: dict[str, Slot]) -> None:
        for host, packed in rows:
            tree = Slot.unpacked(json.loads(packed))
            held[host] = merged(held[host], tree) if host in held else tree

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slot] = {}
        for batch in batches:
            together(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([json.dumps(s.packed()) for s in held.values()], pa.string())],
            ["host", "tree"],
        )

    def whole(rows: pa.Table) -> pa.Table:
        held: dict[str, Slot] = {}
        together(sorted(zip(rows["host"].to_pylist(), rows["tree"].to_pylist())), held)
        return pa.table({"host": list(held), "wrapper": [json.dumps(s.packed()) for s in held.values()]})

    given = pages.select(_host().alias("host"), "html").where("host <> ''")
    found = given.mapInArrow(trees, "host string, tree string, mark bigint")
    # The least tree of each text, so that the result does not depend on the order of rows.
    distinct = found.groupBy("host", "mark").agg(F.min("tree").alias("tree")).select("host", "tree")
    return distinct.mapInArrow(partial, "host string, tree string").groupBy("host").applyInArrow(whole, "host string, wrapper string")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    text is the main text: blocks in page order, white space inside a block one space, blocks joined by two line ends;
    empty for null and empty html and for pages without article text. A page of a host with few pages, or without
    a host in its url, is judged by its own markup. Broken html is read as far as it goes. Repeated rows and
    rows without id stay. Other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(html or "", _wrapper(packed) if packed else None)
                for html, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    given = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", _host().alias("host")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")
    )
    # A host may have a third of all pages: its pages are dealt to several keys, each with a copy of its wrapper.
    dealt = checkpointed(wrappers(pages)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = given.join(dealt, ["host", "salt"], "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op6_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(table(spark, folder, "pages"))

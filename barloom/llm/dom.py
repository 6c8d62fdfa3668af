"""A page as a tree of elements and a list of text blocks, and simple tree matching."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
    r"|<[/a-zA-Z][^<>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: A start tag that ends an open element of these.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "body": {"head"},
}
#: Elements inside which an open element isn't ended from without.
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form blockquote".split())
#: Elements that never hold a page's main text.
APART = frozenset("nav aside footer form head button select option dialog menu object canvas audio video map svg".split()) | RAW
#: A start tag that ends an open drawing, as it is no part of one.
NOT_IN_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var article section main aside nav header footer form".split()
)
MAIN = frozenset(("article", "main"))
#: Elements whose own names don't set them apart.
WHOLE = MAIN | {"html", "body"}
#: Words in class, id or role that name such elements.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|contentinfo|cookie|cookies|"
    r"disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|promoted|"
    r"recommended|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)


@dataclass
class Block:
    text: str
    node: int
    apart: bool  # in an element that never holds main text
    main: int  # in an element that is the main text by its name: 2 for an article, 1 for another
    links: bool  # all of it is links


@dataclass
class Tree:
    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def add(self, label: str, parent: int) -> int:
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        if parent >= 0:
            self.children[parent].append(len(self.labels) - 1)
        return len(self.labels) - 1

    def finish(self, names: dict[tuple, int]) -> Tree:
        """Number equal subtrees equally (by ``names``) and count their nodes."""
        n = len(self.labels)
        self.sizes, self.kinds = [1] * n, [0] * n
        for i in reversed(range(n)):  # children come after their parent
            key = (self.labels[i], *(self.kinds[c] for c in self.children[i]))
            self.kinds[i] = names.setdefault(key, len(names))
            self.sizes[i] += sum(self.sizes[c] for c in self.children[i])
        return self


def parse(page: str) -> Tree:
    """Elements with forgiving ends (a block ends an open paragraph, an item an open item) and the blocks of text.

    An element that holds more than half of the page's text, and all of its marked main text, wraps
    the page: neither its tag nor its name sets it apart.
    """
    tree = Tree()
    root = tree.add("#root", -1)
    stack: list[tuple[str, int, int, int]] = [("#root", root, -1, 0)]  # tag, node, innermost element set apart, main
    outer: dict[int, int] = {-1: -1}  # elements set apart, to the next such element around them
    within: list[int] = []  # of each block the innermost such element
    text: list[str] = []
    linked: list[bool] = []
    in_link, in_svg, at = 0, 0, 0

    def flush() -> None:
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                top = next(x for x in reversed(stack) if x[0] not in INLINE)
                tree.blocks.append(Block(body, top[1], False, stack[-1][3], all(linked)))
                within.append(stack[-1][2])
            text.clear()
            linked.clear()

    def close(k: int) -> None:
        nonlocal in_link, in_svg
        if any(x[0] not in INLINE for x in stack[k:]):
            flush()
        in_link -= sum(x[0] == "a" for x in stack[k:])
        in_svg -= sum(x[0] == "svg" for x in stack[k:])
        del stack[k:]

    def end_open(tags: set[str] | frozenset[str], until: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                close(k)
                return
            if stack[k][0] in until:
                return

    size = len(page)
    while at < size:
        hit = _TOKEN.search(page, at)
        stop = hit.start() if hit else size
        if stop > at:
            part = page[at:stop]
            text.append(part)
            if not part.isspace():
                linked.append(in_link > 0)
        if not hit:
            break
        at = hit.end()
        tag = hit[2]
        if tag is None:
            continue
        tag = tag.lower()
        drawing = in_svg and next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ("svg", "foreignobject")), 0)
        if drawing and stack[drawing][0] != "svg":
            drawing = 0  # a page within the drawing
        if hit[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in SCOPE and tag not in SCOPE:
                    break
            continue
        if drawing and tag in NOT_IN_SVG:
            close(drawing)
            drawing = 0
        if tag not in INLINE:
            flush()
            if tag not in VOID:
                end_open({"p"}, SCOPE)
            if tag in ENDS:
                end_open(ENDS[tag], frozenset(("ul", "ol", "dl", "table", "select", "html")))
        attributes = hit[3]
        names = ""
        if "=" in attributes:
            names = " ".join(v.strip("\"'") for _, v in _ATTRIBUTE.findall(attributes))
        _, parent, apart, main = stack[-1]
        node = tree.add(f"{tag}.{names}" if names else tag, parent)
        if tag in VOID or (tag == "svg" or drawing) and attributes.endswith("/>"):
            continue
        if tag in APART or tag == "header" and not main or names and tag not in WHOLE and NAMED.search(names):
            outer[node] = apart
            apart = node
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = ended.end() if ended else size
            continue
        stack.append((tag, node, apart, max(main, 2 if tag == "article" else int(tag in MAIN or names == "main"))))
        in_link += tag == "a"
        in_svg += tag == "svg"
    flush()
    _set_apart(tree.blocks, outer, within)
    return tree


def _set_apart(blocks: list[Block], outer: dict[int, int], within: list[int]) -> None:
    """Mark the blocks in elements of ``outer`` that don't wrap the page."""
    held = {k: [0, 0] for k in outer}  # characters, and those of marked main text
    for b, k in zip(blocks, within, strict=True):
        held[k][0] += len(b.text)
        held[k][1] += len(b.text) * (b.main > 0)
    for k in sorted(outer, reverse=True)[:-1]:  # what is within an element has a larger number; -1 is the page
        held[outer[k]][0] += held[k][0]
        held[outer[k]][1] += held[k][1]
    total, marked = held[-1]
    apart = {-1: False}
    for k in sorted(outer)[1:]:
        apart[k] = apart[outer[k]] or not (2 * held[k][0] > total and held[k][1] == marked)
    for b, k in zip(blocks, within, strict=True):
        b.apart = apart[k]


class Matcher:
    """Simple tree matching: the most nodes that two trees have in common, in order and under matched parents."""

    def __init__(self):
        self.names: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}

    def finish(self, tree: Tree) -> Tree:
        if len(self.names) > 200_000 or len(self.weights) > 1_000_000:
            raise OverflowError("start with a new matcher")
        return tree.finish(self.names)

    def _known(self, a: Tree, i: int, b: Tree, j: int) -> int | None:
        if a.labels[i] != b.labels[j]:
            return 0
        if a.kinds[i] == b.kinds[j]:
            return a.sizes[i]
        if not a.children[i] or not b.children[j]:
            return 1
        return self.weights.get((a.kinds[i], b.kinds[j]))

    def weight(self, a: Tree, i: int, b: Tree, j: int) -> int:
        known = self._known(a, i, b, j)
        todo = [(i, j)] if known is None else []
        while todo:  # children first; trees of any depth, so no recursion
            x, y = todo[-1]
            key = (a.kinds[x], b.kinds[y])
            if key not in self.weights:
                left = {a.kinds[c]: c for c in a.children[x]}.values()
                right = {b.kinds[d]: d for d in b.children[y]}.values()
                missing = [(c, d) for c in left for d in right if self._known(a, c, b, d) is None]
                if missing:
                    todo += missing
                    continue
                self.weights[key] = 1 + self._table(a, x, b, y)[-1][-1]
            todo.pop()
        return self.weights[a.kinds[i], b.kinds[j]] if known is None else known

    def _table(self, a: Tree, i: int, b: Tree, j: int) -> list[list[int]]:
        right = b.children[j]
        table = [[0] * (len(right) + 1)]
        known: dict[int, list[int]] = {}
        for x in a.children[i]:
            kind = a.kinds[x]
            if kind not in known:
                known[kind] = [self.weight(a, x, b, y) for y in right]
            above, row, best = table[-1], [0], 0
            for k, w in enumerate(known[kind]):
                both = above[k] + w
                best = max(best, above[k + 1], both)
                row.append(best)
            table.append(row)
        return table

    def align(self, a: Tree, b: Tree) -> dict[int, int]:
        """Nodes of ``a`` to the nodes of ``b`` that they match."""
        found: dict[int, int] = {}
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            found[i] = j
            left, right = a.children[i], b.children[j]
            if not left or not right:
                continue
            if a.kinds[i] == b.kinds[j]:
                todo += zip(left, right, strict=True)
                continue
            table = self._table(a, i, b, j)
            m, k = len(left), len(right)
            while m and k:
                if table[m][k] == table[m - 1][k]:
                    m -= 1
                elif table[m][k] == table[m][k - 1]:
                    k -= 1
                else:
                    m, k = m - 1, k - 1
                    todo.append((left[m], right[k]))
        return found

"""A small tolerant HTML parser, and simple tree matching."""

from __future__ import annotations

import html
import math
import re

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation none"
    " a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag in the value ends an open element of the key, if that is the innermost of its kind and scope.
_ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
}
_SCOPE = frozenset("ul ol dl table select div section article body html main nav aside footer header form blockquote".split())


class Node:
    """An element; children are elements and strings (undecoded text)."""

    __slots__ = ("attributes", "children", "parent", "shape", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.shape = 0

    def elements(self) -> list[Node]:
        return [c for c in self.children if type(c) is Node]

    def attribute(self, *names: str) -> str:
        if not self.attributes:
            return ""
        found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(self.attributes)}
        return " ".join(html.unescape(found[n]) for n in names if n in found)


def parse(text: str) -> Node:
    """The tree of a page, whatever its faults: missing and wrong end tags, cut ends, stray signs."""
    root = at = Node("#root")
    end, scan, n = 0, _TOKEN.match, len(text)
    while end < n:
        m = scan(text, end)
        start, end = m.start(), m.end()
        tag = m.group(2)
        if tag is None:
            if text[start] != "<" or end == start + 1:
                at.children.append(text[start:end])
            continue
        tag = tag.lower()
        if m.group(1):
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        if tag not in INLINE:
            up = at  # a block ends an open paragraph
            while up is not root and up.tag in INLINE:
                up = up.parent
            if up.tag == "p":
                at = up.parent
            up = at
            while up is not root and up.tag not in _SCOPE:
                if tag in _ENDED_BY.get(up.tag, ()):
                    at = up.parent
                    break
                up = up.parent
        node = Node(tag, m.group(3), at)
        at.children.append(node)
        if tag in VOID or m.group(3).endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, end)
            end = n if close is None else text.find(">", close.end()) + 1 or n
            continue
        at = node
    _shape(root)
    return root


def _shape(root: Node) -> None:
    """Number every subtree by its form: tag, class and the children's forms."""
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if done:
            node.shape = hash((kind(node), tuple(c.shape for c in node.elements())))
        else:
            stack.append((node, True))
            stack += [(c, False) for c in node.elements()]


def kind(node: Node) -> tuple[str, str]:
    return node.tag, node.attribute("class") if "class" in node.attributes else ""


class Matcher:
    """Simple tree matching: the largest order-preserving match of two trees, roots matched, remembered by form."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """Size of the match and the pairs of element children that it matches. Works without deep recursion."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            key = x.shape, y.shape
            if key in self.known:
                todo.pop()
                continue
            xs, ys = x.elements(), y.elements()
            if x.shape == y.shape:
                self.known[key] = (self._size(x), [(i, i) for i in range(len(xs))])
                todo.pop()
                continue
            # Equal subtrees at either end can be no better matched than with each other.
            most = min(len(xs), len(ys))
            head = next((k for k in range(most) if xs[k].shape != ys[k].shape), most)
            tail = next((k for k in range(most - head) if xs[-1 - k].shape != ys[-1 - k].shape), most - head)
            left, right = ({n.shape: n for n in part[head : len(part) - tail]} for part in (xs, ys))
            open_pairs = [(m, n) for m in left.values() for n in right.values() if kind(m) == kind(n) and (m.shape, n.shape) not in self.known]
            if open_pairs:
                todo += open_pairs
                continue
            worth = np.array([[self.known[m.shape, n.shape][0] if kind(m) == kind(n) else 0 for n in right.values()] for m in left.values()], np.int64).reshape(len(left), len(right))
            rows, columns = (_places(of, part[head : len(part) - tail]) for of, part in ((left, xs), (right, ys)))
            size, middle = self._best(worth, np.array(rows, np.int64), np.array(columns, np.int64))
            ends = [(k, k) for k in range(head)], [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
            size += sum(self._size(xs[i]) for i, _ in (*ends[0], *ends[1]))
            self.known[key] = (1 + size, [*ends[0], *((i + head, j + head) for i, j in middle), *ends[1]])
            todo.pop()
        return self.known[a.shape, b.shape]

    @staticmethod
    def _size(x: Node) -> int:
        n, stack = 0, [x]
        while stack:
            n += 1
            stack += stack.pop().elements()
        return n

    @staticmethod
    def _best(worth: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
        """The heaviest order-preserving match, ``worth[rows[i], columns[j]]`` for a pair, and its pairs.

        Only every so-many-th row of the table is kept, and those between are made anew on the way back.
        """
        n, m = len(rows), len(columns)
        if not n or not m:
            return 0, []

        def after(last: np.ndarray, i: int) -> np.ndarray:
            row = np.empty(m + 1, np.int64)
            row[0] = 0
            np.maximum.accumulate(np.maximum(last[1:], last[:-1] + worth[rows[i]][columns]), out=row[1:])
            return row

        step = max(1, math.isqrt(n))
        row, kept = np.zeros(m + 1, np.int64), []
        for i in range(n):
            if i % step == 0:
                kept.append(row)
            row = after(row, i)
        total, out, i, j = int(row[-1]), [], n, m
        while i and j:
            begin = (i - 1) // step * step
            held = [kept[begin // step]]
            for k in range(begin, i):
                held.append(after(held[-1], k))
            while i > begin and j:
                here, above = held[i - begin], held[i - begin - 1]
                if here[j] == above[j]:
                    i -= 1
                elif here[j] == here[j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return total, out[::-1]

    def align(self, a: Node, b: Node) -> dict[int, Node]:
        """id of each matched node of ``b`` -> its node of ``a``."""
        out, stack = {id(b): a}, [(a, b)]
        while stack:
            x, y = stack.pop()
            xs, ys = x.elements(), y.elements()
            for i, j in self.match(x, y)[1]:
                out[id(ys[j])] = xs[i]
                stack.append((xs[i], ys[j]))
        return out


def _places(of: dict[int, Node], part: list[Node]) -> list[int]:
    at = {shape: k for k, shape in enumerate(of)}
    return [at[n.shape] for n in part]

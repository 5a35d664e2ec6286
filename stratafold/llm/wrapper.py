"""Main text of web pages by wrapper induction.

Pages of one host share a template. They are dealt into groups of about ``GROUP`` pages of one
host (a large host into many, so that no task holds a host), each page is parsed to a DOM tree,
and the trees of a group are aligned, element by element and text by text, with the one of them
that has most in common with the others, by simple tree matching: the largest matching that keeps
parents and the order of siblings. What is learnt from the alignment, of ``SUPPORT`` different
pages at least (copies of one page vote once):

* a text that is the same in nearly all pages aligned there is a constant of the template;
* from the root down, the aligned child that holds most of the varying text outside links is the
  content region, until no child does or the region is one that pages mark as their article;
* beside that path, aligned elements that recur on the host are template structure where they are
  mostly links, or hold little and neither a heading nor a paragraph: menus, adverts, notices and
  footers, though their texts vary.

Constants and template structure are dropped, slots are kept. So are, by HTML's own terms, no
regions that their tag or role calls a menu, header, footer, sidebar, form, dialog or script, and
none that their class or id does. A page that marks its article is bounded by it, and inside an
article only classes that mean adverts, sharing, comments and the like count. Hosts with fewer
pages than ``SUPPORT`` have these marks alone; of lists of links without a mark, those that are
mostly links go too, paragraphs never.

The text is that of the blocks in page order: character references decoded, white space inside
a block one space, blocks joined by an empty line. Defined results: null or empty html gives an
empty text; null urls are a host of their own; broken markup is read as far as it goes, an
unclosed comment or script to the end, a ``<`` that starts no tag as text; markup of any length
and depth is parsed in linear time and aligned whole; repeated rows each get the same result (they
share a group, and are read once in it, unless more than a group's rows share an id and url: these
are dealt to groups of their own); an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm import _bytesnp as B
from stratafold.llm._common import cut, small_batches, table

GROUP, SUPPORT, AGREEMENT = 64, 8, 0.9
#: Share of the pages in which a part of the template shows; of its parent's varying text that a content region
#: has more than; of the content region's text that a part of the template has at most; of links in a menu.
SHOWN, MOST, LITTLE, LINKS = 0.3, 0.5, 0.25, 0.5
#: Characters of html after which a group of long pages is cut in two, so that a worker's trees stay bounded.
GROUP_CHARS = 16 << 20
#: Cells up to which a matching's table is held whole; larger ones are traced back by halves.
TABLE_CELLS = 1 << 22
#: Rows of two numbers, for hosts and repeated pages of more than a group, that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_PLAIN = re.compile(r"[^'\">]*")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: fixed values of the HTML standard
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = frozenset("ul ol dl table article section div body html td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements that are text rather than regions of a page
_TEXT_LEVEL = _HEADINGS | frozenset("p ul ol dl li dt dd table tr td th pre blockquote figure address".split())
#: elements that can be lists of links
_LISTS = frozenset("ul ol dl table div section menu".split())
#: regions without content, by tag, by role, and by a class or id or its last part
_NOT_TAGS = frozenset("nav footer aside form script style noscript template iframe head button select textarea input svg canvas object dialog menu search title xmp noembed noframes audio video map".split())
_NOT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead"
    " topbar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup share sharing social related recommended"
    " recommendations comment comments respond reply replies disqus widget toolbar login search form pagination pager skip".split()
)
#: of these, what parts of an article are called too
_ARTICLE_WORDS = frozenset("banner header masthead menu notice notices search form reply respond widget toolbar skip".split())
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_LAYOUT = frozenset("has have with without no is".split())  # first parts of classes that tell of a page, not a region


def _named(value: str, in_article: bool) -> bool:
    """Whether a class or id names a region without content."""
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if words and words[-1] in _NOT_WORDS and words[0] not in _LAYOUT and not (in_article and words[-1] in _ARTICLE_WORDS):
            return True
    return False


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("boiler", "children", "code", "constant", "heading", "kids", "link", "links", "marks", "named", "paragraph", "size", "tag", "template", "text")

    def __init__(self, tag: str, boiler: bool = False, marks: str = "") -> None:
        self.tag, self.boiler, self.marks = tag, boiler, marks
        self.children: list = []
        self.named = marks == "named"  # whether it is boiler only by its class or id
        self.constant: set[int] = set()  # of the children, texts that belong to the template
        self.template = False  # whether the alignment shows it to be template structure
        self.code = -1


def _region(tag: str, raw: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element holds no content, and "named" if only by its class or id; "main" if it marks the main content."""
    if tag in _NOT_TAGS or tag == "header" and not in_article:
        return True, ""
    mark = "main" if tag in ("article", "main") else ""
    named = False
    if raw:
        for m in _ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True, ""
            if name == "role":
                if value.lower() in _NOT_ROLES:
                    return True, ""
                mark = "main" if value.lower() in ("main", "article") else mark
            elif name == "itemprop":
                mark = "main" if value.lower() == "articlebody" else mark
            elif name in ("class", "id") and tag not in ("html", "body") and _named(value, in_article):
                named = True
    return named, "named" if named else mark


class _Scanner:
    """Ends of tags, each quoted value and each stretch between them being looked at once."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.dead: set[int] = set()  # quotes, outside others, from which no tag ends
        self.bare = len(page) + 1  # from here no quote and no > follows

    def end(self, at: int) -> int:
        """Where the tag's > is; by a > in an unclosed quote if there is no other; -1: nowhere."""
        page, x, passed = self.page, at, []
        while x < self.bare:
            i = _PLAIN.match(page, x).end()
            if i == len(page):
                self.bare = x
                break
            if page[i] == ">":
                return i
            if i in self.dead:
                break
            passed.append(i)
            j = page.find(page[i], i + 1)
            if j < 0:
                break
            x = j + 1
        self.dead.update(passed)
        return page.find(">", at)


class _Stack:
    """The open elements, and where the last of each tag and the last that stops a search stand."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.limits: list[int] = []
        self.walls: list[int] = []  # limits other than table cells

    def push(self, node: Node) -> None:
        n = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(n)
        if node.tag in _LIMITS:
            self.limits.append(n)
            if node.tag not in ("td", "th"):
                self.walls.append(n)

    def cut(self, n: int) -> None:
        """Close the nth element and what is open in it."""
        while len(self.nodes) > n:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in _LIMITS:
                self.limits.pop()
                if node.tag not in ("td", "th"):
                    self.walls.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, tag: str) -> None:
        """An end tag: one of an inline element does not reach beyond a limit."""
        i = self.last((tag,))
        if i > 0 and (tag in _BLOCK or not self.limits or self.limits[-1] <= i):
            self.cut(i)

    def make_room(self, tag: str) -> None:
        """Close what a block or a list's part ends."""
        ends = {"p"} if tag not in _CLOSES else _CLOSES[tag] | {"p"}
        while (i := self.last(ends)) > 0:
            stops = self.walls if tag == "tr" else self.limits
            if stops and stops[-1] > i:
                break
            self.cut(i)
            if tag != "tr":
                break


def parse(page: str) -> Node:
    root = Node("#root")
    stack, scan = _Stack(root), _Scanner(page)
    at, n, text = 0, len(page), 0  # text: where what has not been taken begins

    def take(upto: int) -> None:
        if upto > text:
            stack.nodes[-1].children.append(page[text:upto])

    while (m := _OPEN.search(page, at)) is not None:
        start = m.start()
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                end = end + 3 if end >= 0 else n
            elif m[0] == "<![CDATA[":
                end = page.find("]]>", m.end())
                take(start)
                text = m.end()
                take(end if end >= 0 else n)
                text = at = end + 3 if end >= 0 else n
                continue
            else:
                end = page.find(">", m.end()) + 1 or n
            take(start)
            text = at = end
            continue
        close = scan.end(m.end())
        if close < 0:
            break  # nor does any later tag end
        take(start)
        text = at = close + 1
        tag = m[2].lower()
        if m[1]:
            stack.close(tag)
            continue
        if tag in _BLOCK or tag in _CLOSES:
            stack.make_room(tag)
        boiler, marks = _region(tag, page[m.end() : close], bool(stack.at.get("article")))
        node = Node(tag, boiler, marks)
        stack.nodes[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            text = at = page.find(">", end.start()) + 1 or n if end else n
        elif tag not in _VOID:
            stack.push(node)
    take(n)
    return root


def _postorder(root: Node) -> list[Node]:
    """Elements, each after those in it."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [c for c in x.children if not isinstance(c, str)]
    out.reverse()
    return out


# --- simple tree matching --------------------------------------------------------------------

_TEXT = 0  # the code of every text


def prepare(root: Node, codes: dict[tuple, int]) -> None:
    """Number the trees: equal codes are equal trees, texts aside. Raw text and blank texts do not count."""
    for x in _postorder(root):
        x.kids = [(i, c) for i, c in enumerate(x.children) if (c.strip() if isinstance(c, str) else c.tag not in _RAW)]
        key = (x.tag, *(_code(c) for _, c in x.kids))
        x.code = codes.setdefault(key, len(codes) + 1)
        x.size = 1 + sum(_size(c) for _, c in x.kids)


def _code(x) -> int:
    return _TEXT if isinstance(x, str) else x.code


def _size(x) -> int:
    return 1 if isinstance(x, str) else x.size


def _trimmed(x: list, y: list) -> tuple[int, int, int]:
    """(lo, hi of x, hi of y) of the lists without the equal trees at their two ends.

    These are always part of a largest matching, each being matched with as much as it has.
    """
    lo, hx, hy = 0, len(x), len(y)
    while lo < hx and lo < hy and _code(x[lo][1]) == _code(y[lo][1]):
        lo += 1
    while hx > lo and hy > lo and _code(x[hx - 1][1]) == _code(y[hy - 1][1]):
        hx, hy = hx - 1, hy - 1
    return lo, hx, hy


def _weights(x: list, y: list, known: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Codes' places of both lists, the weights of their pairs, and the pairs of trees not known yet."""
    of_x, of_y = {_code(c): c for _, c in x}, {_code(c): c for _, c in y}
    missing = []
    w = np.zeros((len(of_x), len(of_y)), np.int64)
    for i, (a, p) in enumerate(of_x.items()):
        for j, (b, q) in enumerate(of_y.items()):
            if a == b:
                w[i, j] = _size(p)
            elif a != _TEXT and b != _TEXT and p.tag == q.tag:
                got = known.get((a, b))
                if got is None:
                    missing.append((p, q))
                else:
                    w[i, j] = got
    at_x, at_y = {c: i for i, c in enumerate(of_x)}, {c: i for i, c in enumerate(of_y)}
    return np.fromiter((at_x[_code(c)] for _, c in x), np.int64, len(x)), np.fromiter((at_y[_code(c)] for _, c in y), np.int64, len(y)), w, missing


def _last_row(cx: np.ndarray, cy: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The greatest weights of matchings of all of x with each beginning of y."""
    row = np.zeros(len(cy) + 1, np.int64)
    for c in cx.tolist():
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w[c, cy]), out=row[1:])
    return row


def _largest(cx: np.ndarray, cy: np.ndarray, w: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a matching of greatest weight that keeps both orders."""
    out, todo = [], [(0, len(cx), 0, len(cy))]
    while todo:
        a, b, c, d = todo.pop()
        x, y = cx[a:b], cy[c:d]
        if not len(x) or not len(y):
            continue
        if len(x) == 1:
            j = int(np.argmax(w[x[0], y]))
            if w[x[0], y[j]]:
                out.append((a, c + j))
            continue
        if len(x) * len(y) <= TABLE_CELLS:
            table = np.zeros((len(x) + 1, len(y) + 1), np.int64)
            for i, code in enumerate(x.tolist()):
                np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + w[code, y]), out=table[i + 1, 1:])
            i, j = len(x), len(y)
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
            continue
        half = len(x) // 2
        cut = int(np.argmax(_last_row(x[:half], y, w) + _last_row(x[half:][::-1], y[::-1], w)[::-1]))
        todo += [(a, a + half, c, c + cut), (a + half, b, c + cut, d)]
    return out


def score(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """Nodes in the largest matching of two prepared trees whose roots match; known: results by codes."""
    if a.tag != b.tag:
        return 0
    todo = [(a, b)]
    while todo:
        p, q = todo[-1]
        key = (p.code, q.code)
        if key not in known:
            if p.code == q.code:
                known[key] = p.size
            else:
                lo, hx, hy = _trimmed(p.kids, q.kids)
                cx, cy, w, missing = _weights(p.kids[lo:hx], q.kids[lo:hy], known)
                if missing:
                    todo += missing
                    continue
                ends = sum(_size(c) for _, c in p.kids[:lo]) + sum(_size(c) for _, c in p.kids[hx:])
                known[key] = 1 + ends + int(_last_row(cx, cy, w)[-1])
        todo.pop()
    return known[a.code, b.code]


def align(a: Node, b: Node, known: dict[tuple[int, int], int]) -> tuple[list, list]:
    """The matched elements (of a, of b) and texts (parent in a, place, parent in b, place) of a largest matching."""
    nodes, texts, todo = [], [], [(a, b)] if a.tag == b.tag else []
    while todo:
        p, q = todo.pop()
        nodes.append((p, q))
        x, y = p.kids, q.kids
        lo, hx, hy = _trimmed(x, y)
        pairs = [(i, i) for i in range(lo)] + [(hx + i, hy + i) for i in range(len(x) - hx)]
        if lo < hx and lo < hy:
            while (got := _weights(x[lo:hx], y[lo:hy], known))[3]:
                for c, d in got[3]:
                    score(c, d, known)
            pairs += [(lo + i, lo + j) for i, j in _largest(*got[:3])]
        for i, j in pairs:
            (k, c), (m, d) = x[i], y[j]
            if isinstance(c, str):
                texts.append((p, k, q, m))
            else:
                todo.append((c, d))
    return nodes, texts


def match(a: Node, b: Node) -> int:
    """Nodes in the largest matching of two trees whose roots match."""
    codes: dict[tuple, int] = {}
    prepare(a, codes)
    prepare(b, codes)
    return score(a, b, {})


# --- induction -------------------------------------------------------------------------------


def _clean(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def measure(root: Node) -> None:
    """Characters of varying text outside and inside links, links, and whether there is a heading or a paragraph.

    Regions that are no content by a mark count nothing for what they stand in.
    """
    for x in _postorder(root):
        x.text = x.link = x.links = 0
        x.heading, x.paragraph = x.tag in _HEADINGS, x.tag == "p"
        if x.tag in _RAW:
            continue
        for i, c in enumerate(x.children):
            if isinstance(c, str):
                x.text += 0 if i in x.constant else len(c.strip())
            elif not c.boiler:
                x.text, x.link, x.links = x.text + c.text, x.link + c.link, x.links + c.links
                x.heading, x.paragraph = x.heading or c.heading, x.paragraph or c.paragraph
        if x.tag == "a" and x.text + x.link:
            x.text, x.link, x.links = 0, x.text + x.link, 1


def _paths(root: Node) -> set[tuple[str, ...]]:
    """Tag paths of the elements near the root."""
    out, todo = set(), [(root, ())]
    while todo:
        x, path = todo.pop()
        out.add(path)
        if len(path) < 6:
            todo += [(c, (*path, c.tag)) for _, c in x.kids if not isinstance(c, str)]
    return out


def _reference(trees: list[Node]) -> int:
    """The tree with most of the paths that half of the trees have, and least else; the larger one of equals."""
    paths = [_paths(t) for t in trees]
    seen = Counter(p for ps in paths for p in ps)
    common = {p for p, n in seen.items() if 2 * n >= len(trees)}
    return max(range(len(trees)), key=lambda i: (2 * len(paths[i] & common) - len(paths[i]), trees[i].size, -i))


def induce(trees: list[Node], support: int = SUPPORT, agreement: float = AGREEMENT) -> int:
    """Mark constants and template structure in one host's trees; how many parts their template has."""
    if len(trees) < support:
        return 0
    whole = [hash(tuple(extract_blocks(t))) for t in trees]
    if len(set(whole)) < support:
        return 0
    codes: dict[tuple, int] = {}
    for t in trees:
        prepare(t, codes)
    reference = trees[_reference(trees)]
    known: dict[tuple[int, int], int] = {}
    votes: dict[tuple[int, int], dict[int, str]] = {}
    places: dict[tuple[int, int], list] = {}
    aligned: dict[int, list] = {}
    for t, h in zip(trees, whole, strict=True):
        nodes, texts = align(reference, t, known)
        for a, b in nodes:
            aligned.setdefault(id(a), []).append((h, b))
        for a, i, b, j in texts:
            text = _clean(b.children[j])
            votes.setdefault((id(a), i), {})[h] = text  # copies of a page vote once
            places.setdefault((id(a), i), []).append((b, j, text))
    parts = 0
    for key, by_page in votes.items():
        if len(by_page) >= support:
            text, n = max(Counter(by_page.values()).items(), key=lambda c: (c[1], c[0]))
            if text and n >= agreement * len(by_page):
                parts += 1
                for b, j, own in places[key]:
                    if own == text:
                        b.constant.add(j)
    for t in trees:
        measure(t)
    return parts + _structure(reference, aligned, support, agreement)


def _structure(reference: Node, aligned: dict[int, list], support: int, agreement: float) -> int:
    """Mark the template structure beside the content region; how many elements of the reference it has."""
    region, parts = reference, 0
    while True:
        here = dict(aligned[id(region)])
        if len(here) < support or 2 * sum(b.marks == "main" for b in here.values()) >= len(here):
            break
        shown = []
        for _, c in region.kids:
            if not isinstance(c, str):
                at = dict(aligned.get(id(c), ()))
                shown.append((c, at, sum(b.text for b in at.values())))
        best = max((s for s in shown if not s[0].boiler), key=lambda s: s[2], default=None)
        total = sum(b.text for b in here.values())
        inner = best is not None and best[2] > MOST * total and len(best[1]) >= agreement * len(here) and best[0].tag not in _TEXT_LEVEL
        for c, at, mass in shown:
            if inner and c is best[0] or len(at) < max(support, SHOWN * len(here)):
                continue
            link, links = sum(b.link for b in at.values()), sum(b.links for b in at.values())
            if not mass + link:
                continue
            menu = links >= 2 * len(at) and link >= LINKS * (mass + link)
            rich = 2 * sum(b.heading or b.paragraph for b in at.values()) >= len(at)
            small = inner and c.tag not in _TEXT_LEVEL and not rich and mass * len(best[1]) <= LITTLE * best[2] * len(at)
            if (menu or small) and not any(b.marks == "main" for b in at.values()):
                parts += 1
                for _, b in aligned[id(c)]:
                    b.template = True
        if not inner:
            break
        region = best[0]
    return parts


# --- text ------------------------------------------------------------------------------------


def _outer(node: Node, through: bool = False) -> list[Node]:
    """The outermost elements that mark main content; through: also in regions told only by class or id."""
    out: list[Node] = []
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str) or x.template or x.boiler and not (through and x.named):
            continue
        if x.marks == "main":
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return out


def _mains(node: Node, through: bool = False) -> list[Node]:
    out = _outer(node, through)
    # an article inside a main element is what the page is about
    inner = [a for m in out if m.tag != "article" for a in _articles(m)]
    return inner if inner and all(m.tag != "article" for m in out) else out


def _articles(node: Node) -> list[Node]:
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if not isinstance(x, str) and not x.boiler and not x.template:
            if x.tag == "article":
                out.append(x)
            else:
                todo.extend(reversed(x.children))
    return out


def extract_blocks(root: Node) -> list[str]:
    mains = _mains(root)
    if not mains:
        # a marked article wins over its ancestors' names; beside other text it stands in its place
        inner = _mains(root, True)
        if inner and (any(m.tag != "article" for m in _outer(root, True)) or not _blocks(root, [], False)):
            mains = inner
    return _blocks(root, mains, True)


def _menus(root: Node) -> set[int]:
    """Lists of links, by their ids, that hold less than half of the page; paragraphs are none."""
    measure(root)
    out, todo = set(), [root]
    while todo:
        x = todo.pop()
        if x.tag in _LISTS and x.links >= 3 and x.link >= 2 * x.text and 2 * (x.text + x.link) < root.text + root.link:
            out.add(id(x))
        elif x.links >= 3:
            todo += [c for c in x.children if not isinstance(c, str)]
    return out


def _blocks(root: Node, mains: list[Node], through: bool) -> list[str]:
    out: list[str] = []
    now: list[str] = []
    menus = set() if mains else _menus(root)

    def close() -> None:
        if text := _clean("".join(now)):
            out.append(text)
        now.clear()

    for top in mains or [root]:
        todo: list = [(top, 0)]
        while todo:
            x, i = todo.pop()
            if isinstance(x, str):
                now.append(x)
                continue
            if i == 0:
                if x.boiler or x.template or id(x) in menus:
                    if x.tag in _BLOCK:
                        close()
                    now.append(" ")
                    if through and not mains and x.named:
                        todo += [(m, 0) for m in reversed(_mains(x, True))]
                    continue
                if x.tag in _BLOCK:
                    close()
                elif x.tag == "br":
                    now.append(" ")
            if i < len(x.children):
                todo.append((x, i + 1))
                if i not in x.constant:
                    todo.append((x.children[i], 0))
            elif x.tag in _BLOCK:
                close()
        close()
    return out


def extract_group(pages: list[str], support: int = SUPPORT, agreement: float = AGREEMENT, induction: bool = True) -> tuple[list[str], int]:
    """The main texts of one host's pages, and the number of parts of their template."""
    trees = [parse(p) for p in pages]
    parts = induce(trees, support, agreement) if induction else 0
    return ["\n\n".join(extract_blocks(t)) for t in trees], parts


# --- Spark -----------------------------------------------------------------------------------


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP, induction: bool = True) -> DataFrame:
    """(id, url, text, n_chars, template_nodes) for every page."""
    spark = pages.sparkSession
    small_batches(spark)
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = p.schema["id"].dataType.simpleString()
    if kind not in ("bigint", "int", "string"):
        raise TypeError(f"{id_col} is {kind}; cast it to a long or a string")

    def near(few: DataFrame) -> DataFrame:
        return F.broadcast(few) if few.count() <= MAX_BROADCAST_ROWS else few

    # only what more than a group's rows share has a row in these two, by its hash: an id and url, and a host
    p = p.withColumn("host", host(F.col("url"))).withColumn("same", F.xxhash64("id", "url"))
    repeated = p.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > group)
    repeated = cut(repeated.select(F.col("same").alias("__same"), F.ceil(F.col("n") / F.lit(group)).cast("int").alias("own_parts")))
    p = p.join(near(repeated), p["same"] == F.col("__same"), "left")
    p = p.withColumn("named", F.xxhash64("host"))
    large = p.where("own_parts is null").groupBy("named").agg(F.count("*").alias("n")).where(F.col("n") > group)
    large = cut(large.select(F.col("named").alias("__named"), F.ceil(F.col("n") / F.lit(group)).cast("int").alias("parts")))
    p = p.join(near(large), p["named"] == F.col("__named"), "left")
    part = F.when(F.col("own_parts").isNull(), F.pmod(F.xxhash64(F.lit("part"), "same"), F.coalesce("parts", F.lit(1)))).otherwise(
        F.pmod(F.monotonically_increasing_id(), F.col("own_parts"))
    )
    name = F.when(F.col("own_parts").isNull(), F.col("host")).otherwise(F.concat_ws("\n", "host", F.hex("same")))
    p = p.select(name.alias("host"), part.cast("int").alias("part"), "id", "url", "html")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = p.repartition(n, "host", "part").sortWithinPartitions("host", "part", "id", "url", "html")
    ids = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("id", ids), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("template_nodes", pa.int64())])

    def solve(held: list[tuple], times: list[int]) -> Iterator[pa.RecordBatch]:
        texts, parts = extract_group([r[4] or "" for r in held], induction=induction)
        for at in range(0, len(held), 16):
            rows = [(r[2], r[3], t, len(t), parts) for r, t, k in zip(held[at : at + 16], texts[at : at + 16], times[at : at + 16], strict=True) for _ in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        times: list[int] = []
        chars = 0
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in cols)
                if held and row == held[-1]:
                    times[-1] += 1
                    continue
                if held and (row[:2] != held[0][:2] or chars > GROUP_CHARS):
                    yield from solve(held, times)
                    held, times, chars = [], [], 0
                held.append(row)
                times.append(1)
                chars += len(row[4] or "")
        if held:
            yield from solve(held, times)

    out = dealt.mapInArrow(B.tidy(run), f"id {kind}, url string, text string, n_chars long, template_nodes long")
    return out.withColumnRenamed("id", id_col)


def op1_wrapper_extract(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

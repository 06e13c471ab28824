"""HTML extraction by wrapper induction: same-host DOM trees are aligned by simple tree matching; varying slots become content."""

from __future__ import annotations

import html
import re
from collections import Counter
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import drop, small_batches, staged

# Element names by role, and names of boilerplate in classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select")
BLOCK = frozenset(
    "html body head article aside main section nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre "
    "table caption thead tbody tfoot tr td th form fieldset figure figcaption address details summary hr hgroup menu dialog".split()
)
#: An element of the key's kind ends open elements of the value's kinds that it cannot stand in.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
SCOPE = frozenset("html body article main section div ul ol dl table td th blockquote aside nav header footer form".split())
CLOSES_P = BLOCK - {"html", "head", "body", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"}
DROPPED = frozenset("nav footer aside form head button dialog menu label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe "
    "subscription signup popup modal overlay share sharing social related recommended breadcrumb breadcrumbs pagination pager "
    "comment comments commentlist disqus respond replies form search widget toolbar skip login".split()
)
HEADERS = frozenset(["header", "masthead"])
REPLIES = frozenset("comment comments commentlist disqus respond replies".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:" + "|".join(RAW) + r")\b.*?(?:</(?P<raw>" + "|".join(RAW) + r")\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
_RAW = re.compile(r"<(?P<name>" + "|".join(RAW) + r")\b[^>]*>", re.IGNORECASE)
_CLOSE = {n: re.compile(rf"</{n}\s*>", re.IGNORECASE) for n in RAW}
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+")


def _tags(source: str):
    """(text before, kind, name, attributes) of each tag in order, raw elements skipped whole; the rest of the text last."""
    at = text = 0
    while m := _TAG.search(source, at):
        if m["name"] is None and (raw := _RAW.match(source, m.start())):
            close = _CLOSE[raw["name"].lower()].search(source, raw.end())
            yield source[text : m.start()], "raw", raw["name"].lower(), ""
            at = text = close.end() if close else len(source)
            continue
        if m["name"] is None:
            yield source[text : m.start()], "none", "", ""
        else:
            yield source[text : m.start()], "end" if m["end"] else "start", m["name"].lower(), m["attrs"]
        at = text = m.end()
    yield source[text:], "none", "", ""


def parse(source: str) -> tuple[list[tuple[int, str, frozenset]], list[tuple[int, str, int]]]:
    """Elements ``(parent, name, names in class, id and role)`` and text blocks ``(element, text, characters in links)`` of a page.

    Names are the words of classes and ids, whole ones after ``=``, and roles after ``role=``.
    """
    nodes: list[tuple[int, str, frozenset]] = [(-1, "#page", frozenset())]
    blocks: list[tuple[int, str, int]] = []
    stack = [0]
    outer = [0]  # for each depth of the stack: where its innermost block element is
    open_now: Counter = Counter()
    bits: list[str] = []
    links = link_depth = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(bits).split())
        if text:
            blocks.append((stack[outer[-1]], text, links))
        bits.clear()
        links = 0

    def close(kinds: frozenset, scope: frozenset) -> None:
        """End the innermost open block element of ``kinds``, unless one of ``scope`` stands in between."""
        depth = outer[-1] if any(open_now[k] for k in kinds) else 0
        while depth > 0:
            name = nodes[stack[depth]][1]
            if name in kinds:
                flush()
                cut(depth)
                return
            if name in scope:
                return
            depth = outer[depth - 1]

    def cut(depth: int) -> None:
        nonlocal link_depth
        ended = Counter(nodes[i][1] for i in stack[depth:])
        open_now.subtract(ended)
        link_depth -= ended["a"]
        del stack[depth:], outer[depth:]

    for text, kind, name, attrs in _tags(source):
        if text:
            text = html.unescape(text)
            bits.append(text)
            if link_depth:
                links += len(text.strip())
        if kind == "start":
            if name in BLOCK:
                flush()
            if name in CLOSES_P:
                close(frozenset(["p"]), SCOPE)
            if name in ENDS:
                close(ENDS[name], SCOPE - {"td", "th"} - ENDS[name])
            if name == "br":
                bits.append(" ")
            if name in VOID:
                continue
            names: set[str] = set()
            if attrs and ("class" in attrs or "id" in attrs or "role" in attrs or attrs.upper() != attrs.lower()):
                for key, *values in _ATTR.findall(attrs):
                    value = (values[0] or values[1] or values[2]).lower()
                    names |= {"role=" + value} if key.lower() == "role" else set(_WORD.findall(value)) | {"=" + v for v in value.split()}
            if attrs.endswith("/"):
                continue
            nodes.append((stack[-1], name, frozenset(names)))
            outer.append(len(stack) if name in BLOCK else outer[-1])
            stack.append(len(nodes) - 1)
            open_now[name] += 1
            link_depth += name == "a"
        elif kind == "end":
            if name in BLOCK:
                close(frozenset([name]), frozenset() if name in ("article", "body", "html", "main") else frozenset(["article", "main", "body"]))
                flush()
            elif open_now[name]:
                for depth in range(len(stack) - 1, outer[-1], -1):
                    if nodes[stack[depth]][1] == name:
                        cut(depth)
                        break
    flush()
    return nodes, blocks


def label(node: tuple[int, str, frozenset]) -> str:
    return node[1] + "".join("." + n for n in sorted(node[2]) if "=" not in n)


class Skeleton:
    """A page's block elements with equal sisters merged; ``slot[i]`` is the slot of element i, slot 0 the page.

    ``lines[s]`` is ``parent label``, ``keys[s]`` a 64-bit hash of the labels from the page down to the slot.
    """

    def __init__(self, nodes: list[tuple[int, str, frozenset]]) -> None:
        self.slot = [0] * len(nodes)
        self.lines, self.keys = ["0 "], [0]
        known: dict[tuple[int, str], int] = {}
        for i, node in enumerate(nodes[1:], 1):
            above = self.slot[node[0]]
            if node[1] not in BLOCK:
                self.slot[i] = above
                continue
            key = (above, label(node))
            if key not in known:
                known[key] = len(self.lines)
                self.lines.append(f"{above} {key[1]}")
                self.keys.append(xxhash.xxh3_64_intdigest(f"{self.keys[above]}/{key[1]}") - 2**63)
            self.slot[i] = known[key]

    def text(self) -> str:
        return "\n".join(self.lines)


class Tree:
    """A skeleton read back: tag, children, size and hash of each slot's subtree, and of what is below it."""

    def __init__(self, skeleton: str) -> None:
        lines = [line.partition(" ") for line in skeleton.split("\n")]
        n = len(lines)
        self.labels = [own for _, _, own in lines]
        self.tags = [own.partition(".")[0] for own in self.labels]
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.size, self.hash, self.below, self.keys = [1] * n, [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            above = int(lines[i][0])
            self.children[above].append(i)
            self.keys[i] = xxhash.xxh3_64_intdigest(f"{self.keys[above]}/{self.labels[i]}") - 2**63
        for i in range(n - 1, -1, -1):
            self.below[i] = hash(tuple(self.hash[c] for c in self.children[i]))
            self.hash[i] = hash((self.labels[i], self.below[i]))
            self.size[i] += sum(self.size[c] for c in self.children[i])


#: Pairs of sisters whose best values are held at once while matches are read off; what is found does not depend on it.
PIECE_PAIRS = 1 << 16


def sister_pieces(rows: list[int], cols: list[int], row_hashes: list, col_hashes: list) -> list[tuple[list[int], list[int]]]:
    """Two lists of sisters cut, in order, into pieces that may be aligned apart, as no match is better for them.

    Equal subtrees at either end are pieces of one pair; all between is one piece, however long.
    """
    n, head, tail = min(len(rows), len(cols)), 0, 0
    while head < n and row_hashes[rows[head]] == col_hashes[cols[head]]:
        head += 1
    while tail < n - head and row_hashes[rows[-1 - tail]] == col_hashes[cols[-1 - tail]]:
        tail += 1
    pieces = [([r], [c]) for r, c in zip(rows[:head], cols[:head], strict=True)]
    pieces.append((rows[head : len(rows) - tail], cols[head : len(cols) - tail]))
    pieces += [([r], [c]) for r, c in zip(rows[len(rows) - tail :], cols[len(cols) - tail :], strict=True)]
    return [(x, y) for x, y in pieces if x and y]


def best_values(last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The next row of the table of best values: a row's ``values`` with each column, taken once, in order, or left out."""
    out = last.copy()
    np.maximum.accumulate(np.maximum(last[:-1] + values, last[1:]), out=out[1:])
    return np.maximum(out, last[0], out=out)


class Sisters:
    """Two lists of sisters, and their order-keeping alignment of greatest value; every pair that may be part of one is looked at.

    A pair of equal tags counts ``unit``, 1 more for equal labels, and what the best
    match below it counts, which is the same for all pairs with the same two lists of children.
    """

    def __init__(self, a: Tree, b: Tree, rows: list[int], cols: list[int], unit: int, kind: type) -> None:
        self.a, self.b, self.rows, self.cols, self.unit, self.kind = a, b, rows, cols, unit, kind
        self.groups = [{(t.tags[x], t.below[x]): x for x in own} for t, own in ((a, rows), (b, cols))]
        number = {g: k for k, g in enumerate(self.groups[1])}
        self.group_of = np.array([number[b.tags[c], b.below[c]] for c in cols])
        place: dict[str, list[int]] = {}
        for j, c in enumerate(cols):
            place.setdefault(b.labels[c], []).append(j)
        self.same = [place.get(a.labels[r], ()) for r in rows]
        self.known: dict[tuple[str, int], np.ndarray] = {}
        self.step = max(PIECE_PAIRS // len(cols), isqrt(len(rows)), 1)

    def open_pairs(self, done: dict[tuple[int, int], int]):
        """A pair for each two lists of children that have to be aligned first."""
        a, b = self.a, self.b
        for (tag, below), r in self.groups[0].items():
            for (other, beneath), c in self.groups[1].items():
                if tag == other and below != beneath and a.children[r] and b.children[c] and (below, beneath) not in done:
                    yield r, c

    def evaluate(self, done: dict[tuple[int, int], int]) -> None:
        for (tag, below), r in self.groups[0].items():
            gains = [self.unit + below_gain(self.a, self.b, r, c, self.unit, done) if tag == t else 0 for (t, _), c in self.groups[1].items()]
            self.known[tag, below] = np.array(gains, dtype=self.kind)[self.group_of]

    def values(self, i: int, lo: int, hi: int) -> np.ndarray:
        """What row i counts with the columns ``lo .. hi`` (0: no match)."""
        out = self.known[self.a.tags[self.rows[i]], self.a.below[self.rows[i]]][lo:hi]
        own = [j - lo for j in self.same[i] if lo <= j < hi]
        if own:
            out = out.copy()
            out[own] += 1
        return out

    def bounds(self) -> np.ndarray:
        """For every ``step``-th row and each column: no alignment that parts there counts more."""
        parts = range(self.step, len(self.rows), self.step)
        if not parts:
            return np.zeros((0, len(self.cols) + 1), dtype=np.int64)
        of_rows = np.array([int(self.known[self.a.tags[r], self.a.below[r]].max()) for r in self.rows], dtype=np.int64)
        of_cols = np.max(list(self.known.values()), axis=0).astype(np.int64)
        rows, cols = (np.concatenate([[0], np.cumsum(x)]) for x in (of_rows, of_cols))
        points = np.array([(i, j) for i, own in enumerate(self.same) for j in own], dtype=np.int64).reshape(-1, 2)
        out = []
        for i in parts:
            before = points[:, 0] < i
            left, right = (np.concatenate([[0], np.cumsum(np.bincount(points[x, 1], minlength=len(cols) - 1))]) for x in (before, ~before))
            equal = left + right[-1] - right
            out.append(np.minimum(rows[i], cols) + np.minimum(rows[-1] - rows[i], cols[-1] - cols) + equal)
        return np.array(out)

    def bands(self, bounds: np.ndarray, least: int) -> list[tuple[int, int]]:
        """The columns, for each ``step`` rows, of all alignments that count ``least`` or more."""
        m = len(self.cols)
        first, last = [0], [m]
        for own in bounds >= least:
            inside = np.flatnonzero(own)
            first.append(int(inside[0]) if len(inside) else m)
            last.append(int(inside[-1]) if len(inside) else 0)
        if len(first) == 1:
            return [(0, m)]
        lows = np.maximum.accumulate(first).tolist()
        highs = np.minimum.accumulate([*last[1:], m][::-1])[::-1].tolist()
        return list(zip(lows, highs, strict=True))

    def table(self, bands: list[tuple[int, int]], rows: int) -> tuple[int, list[np.ndarray]]:
        """The best value of the first ``rows`` rows within ``bands`` (-1 if these do not meet), and the row before each ``step`` rows."""
        last, kept, low = np.zeros(1, dtype=self.kind), [], 0
        for k, (lo, hi) in enumerate(bands):
            if lo > hi or lo - low >= len(last):
                return -1, []
            last = last[lo - low : hi - low + 1]
            last = np.concatenate([last, np.full(hi - lo + 1 - len(last), last[-1])])
            low = lo
            kept.append(last)
            for i in range(k * self.step, min(rows, (k + 1) * self.step)):
                last = best_values(last, self.values(i, lo, hi))
        return int(last[-1]), kept

    def best(self) -> int:
        """The greatest value.

        A first table holds what may reach the bounds.  What it finds is an
        alignment, so a second one for that value misses no better one.
        """
        bounds = self.bounds()
        hoped = int(bounds.max(axis=1).min()) if len(bounds) else 0
        found = self.table(self.bands(bounds, hoped), len(self.rows))[0]
        return found if found >= hoped else self.table(self.bands(bounds, found), len(self.rows))[0]

    def pairs(self, best: int) -> list[tuple[int, int]]:
        """The pairs of an alignment that counts ``best``, the greatest value: rows are computed again, read from the end on."""
        bands = self.bands(self.bounds(), best)
        _, kept = self.table(bands, (len(bands) - 1) * self.step)
        out, j = [], len(self.cols)
        for k in range(len(kept) - 1, -1, -1):
            lo, first = bands[k][0], k * self.step
            table = [kept[k][: j - lo + 1]]
            for i in range(first, min(len(self.rows), first + self.step)):
                table.append(best_values(table[-1], self.values(i, lo, j)))
            for at in range(len(table) - 1, 0, -1):
                here, above, i = table[at], table[at - 1], first + at - 1
                if here[j - lo] == above[j - lo]:
                    continue
                gains = self.values(i, lo, j)
                while not gains[j - lo - 1] or here[j - lo] != above[j - lo - 1] + gains[j - lo - 1]:
                    j -= 1
                j -= 1
                out.append((self.rows[i], self.cols[j]))
        return out


def below_gain(a: Tree, b: Tree, x: int, y: int, unit: int, done: dict[tuple[int, int], int]) -> int:
    if a.below[x] == b.below[y]:
        return (a.size[x] - 1) * (unit + 1)
    return done[a.below[x], b.below[y]] if a.children[x] and b.children[y] else 0


def simple_tree_matching(a: Tree, b: Tree) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest order-keeping match of two trees whose roots match, and the matched slots.

    Of the largest matches it is one with the most equal labels.  Children are
    aligned by dynamic programming over the matches of their subtrees, by the
    same rule in lists of any length.  Equal subtrees at either end of two lists
    are matched at once, which loses nothing (``sister_pieces``).
    Depth is no limit: pairs wait on a list.
    """
    if a.tags[0] != b.tags[0]:
        return 0, []
    unit = 1 + min(len(a.labels), len(b.labels))
    kind = np.int32 if unit * (unit + 1) < 1 << 31 else np.int64
    done: dict[tuple[int, int], int] = {}

    def align(x: int, y: int) -> tuple[int, list[tuple[int, int]], Sisters | None]:
        """What equal ends count, these, and the sisters between them."""
        pieces = sister_pieces(a.children[x], b.children[y], a.hash, b.hash)
        equal = [(r[0], c[0]) for r, c in pieces if len(r) == len(c) == 1 and a.hash[r[0]] == b.hash[c[0]]]
        between = [(r, c) for r, c in pieces if len(r) > 1 or len(c) > 1 or a.hash[r[0]] != b.hash[c[0]]]
        return sum(a.size[r] for r, _ in equal) * (unit + 1), equal, Sisters(a, b, *between[0], unit, kind) if between else None

    waiting, begun = [(0, 0)], {}
    while waiting:
        x, y = waiting[-1]
        key = a.below[x], b.below[y]
        if key in done or key[0] == key[1]:
            waiting.pop()
            continue
        if key not in begun:
            begun[key] = align(x, y)
            sisters = begun[key][2]
            first = list(sisters.open_pairs(done)) if sisters else []
            if first:
                waiting += first
                continue
        total, _, sisters = begun.pop(key)
        if sisters:
            sisters.evaluate(done)
            total += sisters.best()
        done[key] = total
        waiting.pop()
    pairs, open_pairs = [], [(0, 0)]
    while open_pairs:
        x, y = open_pairs.pop()
        pairs.append((x, y))
        if a.below[x] == b.below[y]:
            open_pairs += zip(a.children[x], b.children[y], strict=True)
            continue
        count, equal, sisters = align(x, y)
        open_pairs += equal
        if sisters:
            sisters.evaluate(done)
            open_pairs += sisters.pairs(done[a.below[x], b.below[y]] - count)
    return len(pairs), pairs


class Aligner:
    """Slot keys of a page's skeleton in terms of its host's; matches are kept by pair of skeletons."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], dict[int, int]] = {}

    def of(self, page: str, host: str | None) -> dict[int, int]:
        if host is None or page == host:
            return {}
        if (found := self.known.get((page, host))) is None:
            if len(self.known) > 5000:
                self.known.clear()
            a, b = Tree(page), Tree(host)
            found = self.known[page, host] = {a.keys[x]: b.keys[y] for x, y in simple_tree_matching(a, b)[1]}
        return found


def _holds_article(nodes: list[tuple[int, str, frozenset]], blocks: list[tuple[int, str, int]]) -> set[int]:
    """The elements round the page's longest article or main element that is no reader's reply or aside."""
    reply, size = [False] * len(nodes), [0] * len(nodes)
    for i, (above, name, names) in enumerate(nodes[1:], 1):
        reply[i] = reply[above] or bool(names & REPLIES) or name in DROPPED
    for owner, text, _ in blocks:
        size[owner] += len(text)
    for i in range(len(nodes) - 1, 0, -1):
        size[nodes[i][0]] += size[i]
    whole = [i for i in range(1, len(nodes)) if nodes[i][1] in ("article", "main") and not reply[i]]
    out: set[int] = set()
    if whole:
        i = max(whole, key=lambda i: (size[i], -i))
        while i > 0:
            out.add(i)
            i = nodes[i][0]
    return out


def boilerplate(nodes: list[tuple[int, str, frozenset]], blocks: list[tuple[int, str, int]]) -> tuple[list[bool], list[bool], list[bool]]:
    """For each element: whether it or one above it is no part of an article; is in an article or main element; may be boilerplate.

    It may be if only a word of a longer name says so (share-price, cookie-notice): then its slot decides.
    """
    n = len(nodes)
    holds = _holds_article(nodes, blocks)
    out, main, maybe = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        above, name, names = nodes[i]
        main[i] = main[above] or (name in ("article", "main") and not out[above]) or "role=main" in names
        own = names & NAMES
        if main[i]:
            own = own - HEADERS
        nameable = name not in ("html", "body", "main")
        named = nameable and any("=" + w in names or w in REPLIES for w in own)
        role = any(r[5:] in ROLES for r in names if r.startswith("role="))
        plain = name in DROPPED or (name == "header" and not main[i])
        out[i] = out[above] or (i not in holds and (named or role or plain))
        maybe[i] = maybe[above] or (i not in holds and nameable and bool(own))
    return out, main, maybe


# What tags and names say of a slot before its texts are compared.
MAIN, PLAIN, BESIDE, NAMED = range(4)


def priors(nodes: list[tuple[int, str, frozenset]], blocks: list[tuple[int, str, int]]) -> tuple[list[int], list[bool]]:
    """For each block: in a marked article, plain, beside a marked article, or named boilerplate; and whether a word of a longer name says so."""
    out, main, maybe = boilerplate(nodes, blocks)
    marked = any(main[b[0]] and not out[b[0]] for b in blocks)
    kinds = [NAMED if out[i] else MAIN if main[i] else BESIDE if marked else PLAIN for i, _, _ in blocks]
    return kinds, [maybe[i] for i, _, _ in blocks]


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SLOTS_SQL = "array<struct<key:bigint,hash:bigint,chars:bigint,links:bigint>>"


def _slots(batches):
    item = pa.struct([("key", pa.int64()), ("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])
    for batch in batches:
        skeletons, slots, articles = [], [], []
        for source in batch.column("html").to_pylist():
            nodes, blocks = parse(source or "")
            skeleton = Skeleton(nodes)
            skeletons.append(skeleton.text())
            kinds, _ = priors(nodes, blocks)
            own = [b[1] for b, k in zip(blocks, kinds, strict=True) if k in (MAIN, PLAIN)]
            articles.append(xxhash.xxh3_64_intdigest("\n".join(own)) - 2**63)
            texts: dict[int, list] = {}
            for owner, text, links in blocks:
                slot = texts.setdefault(skeleton.slot[owner], [xxhash.xxh3_64(), 0, 0])
                slot[0].update(text + "\n")
                slot[1] += len(text)
                slot[2] += links
            slots.append(
                [{"key": skeleton.keys[s], "hash": h.intdigest() - 2**63, "chars": c, "links": k} for s, (h, c, k) in texts.items()]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(skeletons, pa.string()), pa.array(articles, pa.int64()), pa.array(slots, pa.list_(item))],
            names=["host", "skeleton", "article", "slots"],
        )


def _aligned(batches):
    aligner = Aligner()
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("host", "skeleton", "shape", "article", "slots"))
        for host, page, shape, article, slots in zip(*columns, strict=True):
            match = aligner.of(page, shape)
            rows += [(host, match.get(s["key"], s["key"]), article, s["hash"], s["chars"], s["links"]) for s in slots]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows, strict=True)], names=["host", "key", "article", "hash", "chars", "links"]
            )


#: Different articles of a host from which on a constant slot counts as template, and the share of the host's it stands in, at least.
LEAST_ARTICLES, LEAST_SHARE = 3, 0.5


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """One row per host: ``host, shape`` (its most frequent skeleton), ``articles`` (different ones) and ``slots``, from all pages of the host.

    A slot is a place of the aligned trees: ``key``, ``constant`` (always the
    same text) and ``linked`` (half of its characters in links).  Listed are
    those in LEAST_SHARE of the host's articles at least, so a list is at most
    1 / LEAST_SHARE times as long as an average page's, however many pages the host has.
    """
    parsed = staged(pages.select("host", "html").mapInArrow(_slots, f"host string, skeleton string, article long, slots {_SLOTS_SQL}"), "slots")
    counts = parsed.groupBy("host", "skeleton").agg(F.count("*").alias("n"))
    shapes = staged(counts.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("shape")), "shapes")
    articles = staged(parsed.groupBy("host").agg(F.count_distinct("article").alias("articles")), "articles")
    slots = (
        parsed.join(shapes, "host")
        .mapInArrow(_aligned, "host string, key long, article long, hash long, chars long, links long")
        .groupBy("host", "key", "article")
        .agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
        .groupBy("host", "key")
        .agg(
            F.count("*").alias("n"),
            (F.min("low") == F.max("high")).alias("constant"),
            (2 * F.sum("links") >= F.greatest(F.sum("chars"), F.lit(1))).alias("linked"),
        )
        .join(articles, "host")
        .where((F.col("n") >= LEAST_ARTICLES) & (F.col("n") >= LEAST_SHARE * F.col("articles")))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("key", "constant", "linked"))).alias("slots"))
    )
    wrappers = staged(shapes.join(articles, "host").join(slots, "host", "left"), "wrappers")
    drop(parsed, shapes, articles)
    return wrappers


def chosen_blocks(source: str, shape: str | None, slots: list[dict] | None, aligner: Aligner) -> tuple[list[str], bool]:
    """The blocks of one page that are content by its host's wrapper, and whether compared slots decided for most of its characters.

    A constant slot is template.  A varying one is content, unless its tag or
    name, or that of an element above, says otherwise, it is made of links
    outside of an article or within a doubtful name, or it stands beside the
    article that the page marks.  Where the host has too few articles to compare, tags, names and links decide alone.
    """
    nodes, blocks = parse(source)
    if not blocks:
        return [], False
    skeleton = Skeleton(nodes)
    match = aligner.of(skeleton.text(), shape)
    wrapper = {s["key"]: s for s in slots or []}
    kinds, doubtful = priors(nodes, blocks)
    sums: dict[int, list[int]] = {}
    for owner, text, links in blocks:
        own = sums.setdefault(skeleton.slot[owner], [0, 0])
        own[0] += len(text)
        own[1] += links
    kept, compared, template_only = [], 0, []
    for (owner, text, _), kind, doubt in zip(blocks, kinds, doubtful, strict=True):
        place = skeleton.slot[owner]
        slot = wrapper.get(match.get(skeleton.keys[place], skeleton.keys[place]))
        compared += len(text) * (slot is not None)
        linked = slot["linked"] if slot else 2 * sums[place][1] >= max(sums[place][0], 1)
        named = kind in (BESIDE, NAMED) or (doubt and (linked or (kind == PLAIN and slot is None)))
        if not named and (kind == MAIN or not linked):
            (template_only if slot and slot["constant"] else kept).append((text, kind))
    if not kept:  # nothing varies: what the page marks as its article is one
        kept = [b for b in template_only if b[1] == MAIN]
    return [t for t, _ in kept], 2 * compared >= sum(len(b[1]) for b in blocks)


def extract_articles(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, by_wrapper``: the main text of every page, its blocks joined by line feeds.

    All pages of a host are parsed; equal sisters in a tree are merged, and each
    page's tree is aligned with its host's most frequent one by simple tree
    matching.  Slots that stand in three or more different articles, and in half
    of the host's, are compared: one whose text never changes is template, inside
    a marked article too, and the others are content; copies of one article are one.  Tags,
    names and links break ties: varying slots of elements that name themselves menus,
    headers, footers, sidebars, notices, adverts, forms or comments are dropped,
    so are those made of links outside of an article, and those beside the article
    (or main part) that a page marks; where only a word of a longer name says so,
    linked slots are dropped alone.  If nothing of a marked article varies it is taken whole.
    ``by_wrapper`` tells whether slots compared across the host hold most of the page's text.

    A null or empty html gives an empty text.  Pages without a host are one
    group.  Broken markup is read leniently: missing end tags, unknown elements,
    any depth and text cut off within a tag do no harm.  Rows repeated whole are kept;
    other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induce_wrappers(rows)

    def run(batches):
        aligner = Aligner()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("html", "shape", "slots")]
            found = [chosen_blocks(h or "", s, w, aligner) for h, s, w in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(["\n".join(t) for t, _ in found], pa.string()),
                    pa.array([d for _, d in found], pa.bool_()),
                ],
                names=["page_id", "url", "text", "by_wrapper"],
            )

    id_type = pages.schema["page_id"].dataType.simpleString()
    return (
        rows.join(wrappers, "host", "left")
        .select("page_id", "url", "html", "shape", "slots")
        .mapInArrow(run, f"page_id {id_type}, url string, text string, by_wrapper boolean")
    )

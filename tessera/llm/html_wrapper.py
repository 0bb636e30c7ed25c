"""HTML extraction by wrapper induction.

The DOM tree of each page is aligned with those of up to ``REFERENCES`` other pages of its host by simple tree matching. A
text of a reference that stands unchanged on nearly all pages aligned with its node is template; everything else is a slot.
The main text of a page is what its slots hold: template goes wherever it stands, menus, adverts, comments and the like go
by their tag or role although they vary, and a single article or main element with nearly all of the rest stands for all of
it. A page of a host that has no other page has no template; it is judged by tags and roles alone.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Collection
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import marked, written
from tessera.llm.url_filter import host_and_path

#: Pages of a host that the others are aligned with.
REFERENCES = 3
#: What one distinct page counts for; its exact copies share it.
VOTE = 1 << 30
#: A text is template if it is the same on this share of the pages aligned with its node.
CONSTANT = 0.9
#: Sibling tables of more cells are aligned in linear space.
TABLE_CELLS = 1 << 20
#: Sibling tables of so few cells are filled without arrays.
SHORT_CELLS = 256
#: Pairs of siblings in an alignment that is kept for other nodes of the same kinds.
LONGEST_KEPT = 1_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are never article text.
NEVER = frozenset("head nav footer aside script style noscript template button select option iframe svg canvas dialog menu textarea object audio video map title".split())
#: Words in class, id or role that mark what is not article text.
ROLES = frozenset("ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar side aside widget comment comments commentlist disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs menu menubar nav navbar navigation toolbar pagination pager footer newsletter subscribe signup login search complementary contentinfo skip".split())
_OUTSIDE = frozenset(["header", "masthead", "banner"])
#: Words that may stand beside those in one class, id or role: they say only where or in what form. ``has-sidebar`` has another.
_PLACE = frozenset("area bar block body bottom box button buttons center column container div feed form global inner item items left link links list outer panel posts primary right row secondary section site slot text top unit wrap wrapper x".split())
#: Barred unless it wraps the article, as one element around a whole page may.
_FORM = "form"
#: Never barred by class, id or role.
_NEVER_BY_ROLE = frozenset(["html", "body", "main"])
#: Share of a text that is nearly all of it.
NEARLY_ALL = 0.9
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
_SCOPE = frozenset("table ul ol dl select article section div body html".split())


class Page:
    """A DOM tree in page order. Node 0 is the root; ``events`` are (node, text or None for a break).

    ``at`` names the place of a node: a hash of the tags from the root down to it. Nothing here recurses, so a page may be
    nested as deeply as it likes.
    """

    __slots__ = ("at", "events", "kids", "out", "parent", "tag", "text")

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.kids, self.out, self.text, self.at = ["#"], [-1], [[]], [False], [0], [1]
        self.events: list[tuple[int, str | None]] = []
        stack, at, find, inside = [0], 0, _TOKEN.search, 0
        opened: Counter[str] = Counter()
        roles: dict[int, str] = {}

        def shut(k: int) -> None:
            nonlocal inside
            for node in stack[k:]:
                opened[self.tag[node]] -= 1
                inside -= self.tag[node] in ("article", "main")
            del stack[k:]

        while m := find(source, at):
            if m.start() > at:
                self._say(stack[-1], source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    self._say(stack[-1], entities.escape(m[0][9:].removesuffix("]]>")))
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK:
                    self.events.append((stack[-1], None))
                if opened[name]:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    shut(k)
                continue
            if name in BLOCK:
                self._close(stack, name, shut)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.at.append(_place(self.at[stack[-1]], name))
            self.kids.append([])
            self.kids[stack[-1]].append(node)
            self.text.append(0)
            self.out.append(self.out[stack[-1]] or name in NEVER or name == "header" and not inside or bool(m[3]) and bool(_HIDDEN.search(m[3])))
            if not self.out[node]:
                if name == _FORM:
                    roles[node] = _FORM
                elif m[3] and name not in _NEVER_BY_ROLE and (role := _role(m[3], bool(inside))):
                    roles[node] = "weak" if role == "compound" or name == "article" else "whole"
            if name == "br":
                self.events.append((node, " "))
            elif name in BLOCK:
                self.events.append((node, None))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
                if name == "title":
                    self._say(node, source[at : end.start() if end else len(source)])
                at = end.end() if end else len(source)
            elif name not in VOID and not m[3].endswith("/"):
                stack.append(node)
                opened[name] += 1
                inside += name in ("article", "main")
        if at < len(source):
            self._say(stack[-1], source[at:])
        if roles:
            self._bar(roles)

    def _bar(self, roles: dict[int, str]) -> None:
        """Bar the elements with a role and all below. One with most of the page's text is a wrapper and stays, if it holds
        an article, main or h1, its role is weak, or it is no form and has nearly all text."""
        n = len(self.tag)
        mass = [0 if self.out[k] else self.text[k] for k in range(n)]
        marks = [self.tag[k] in ("article", "main", "h1") and not self.out[k] and roles.get(k, _FORM) == _FORM for k in range(n)]
        for k in range(n - 1, 0, -1):
            mass[self.parent[k]] += mass[k]
            if marks[k] and roles.get(k, _FORM) == _FORM:
                marks[self.parent[k]] = True
        for k in range(1, n):
            role = roles.get(k)
            wraps = role and 2 * mass[k] > mass[0] and (marks[k] or role == "weak" or role != _FORM and mass[k] >= NEARLY_ALL * mass[0])
            self.out[k] = self.out[k] or self.out[self.parent[k]] or bool(role) and not wraps

    def _close(self, stack: list[int], name: str, shut) -> None:
        ends = _CLOSES.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == "p" or tag in ends:
                self.events.append((stack[k], None))
                shut(k)
            elif tag in _SCOPE:
                break

    def _say(self, node: int, raw: str) -> None:
        self.events.append((node, raw))
        self.text[node] += len(raw.strip())

    def texts(self) -> dict[int, int]:
        """Key of each node that is not barred and has text of its own: its place and that text."""
        said: dict[int, list[str]] = {}
        for node, text in self.events:
            if text and self.text[node] and not self.out[node]:
                said.setdefault(node, []).append(text)
        return {n: xxhash.xxh64_intdigest(" ".join("".join(t).split()), self.at[n]) >> 1 for n, t in said.items()}

    def main_text(self, inside: list[bool] | None, template: Collection[int] = ()) -> str:
        """Text of the nodes ``inside`` (of all if None) but ``template``, a line for each block."""
        blocks, now = [], []
        for node, said in self.events:
            if said is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif (inside is None or inside[node]) and not self.out[node] and node not in template:
                now.append(said)
        blocks.append("".join(now))
        lines = (" ".join(entities.unescape(b).split()) for b in blocks)
        return "\n".join(line for line in lines if line)

    def region(self, template: Collection[int] = ()) -> list[bool] | None:
        """The nodes under the outermost article, or main, of the place that has nearly all text outside ``template``; None
        for the whole page."""
        n = len(self.tag)
        mass = [0 if self.out[k] or k in template else self.text[k] for k in range(n)]
        for k in range(n - 1, 0, -1):
            mass[self.parent[k]] += mass[k]
        for want in ("article", "main"):
            held: dict[int, int] = {}
            for k in range(1, n):
                if self.tag[k] == want and not self.out[k]:
                    held[self.at[k]] = held.get(self.at[k], 0) + mass[k]
            best = next((place for place, m in held.items() if m and m >= NEARLY_ALL * mass[0]), None)  # in page order
            if best is not None:
                inside = [False] * n
                for k in range(1, n):
                    inside[k] = inside[self.parent[k]] or self.at[k] == best and not self.out[k]
                return inside
        return None


@lru_cache(4096)
def _tag_number(tag: str) -> int:
    return zlib.crc32(tag.encode())


def _place(above: int, tag: str) -> int:
    return (above * 0x9E3779B97F4A7C15 + _tag_number(tag) + 1) & 0xFFFFFFFFFFFFFFFF


@lru_cache(10_000)
def _role(attributes: str, inside: bool) -> str:
    """``whole`` if a class, id or role is one of ROLES, ``compound`` if one is made of them and of _PLACE, else empty."""
    found = ""
    for m in _CLASS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - {""}
            marks = words & (ROLES if inside else ROLES | _OUTSIDE)
            if marks and words == marks and len(words) == 1:
                return "whole"
            if marks and words <= marks | _PLACE:
                found = "compound"
    return found


class Matcher:
    """Simple tree matching: a largest match of two trees that keeps order and goes from the roots down.

    Subtrees of equal shape are one ``kind``, so a pair of kinds is weighed once however often it occurs. Equal kinds at
    both ends of two sibling lists belong to a largest match and are taken off first; what stays in the middle is aligned
    by the usual table, row by row, and in linear space if the table would be large.
    """

    def __init__(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.weight: dict[tuple[int, int], int] = {}
        self.paths: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.held = 0  # steps of all paths

    def shape(self, tags: list[str], kids: list[list[int]]) -> list[int]:
        """The kind of each node."""
        out = [0] * len(tags)
        for n in range(len(tags) - 1, -1, -1):
            key = (tags[n], *[out[k] for k in kids[n]])
            kind = self.kinds.get(key)
            if kind is None:
                kind = self.kinds[key] = len(self.tag)
                self.tag.append(tags[n])
                self.below.append(key[1:])
                self.size.append(1 + sum(self.size[k] for k in key[1:]))
            out[n] = kind
        return out

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.size[a]
        return self.weight.get((a, b)) if self.tag[a] == self.tag[b] else 0

    def _weigh(self, a: int, b: int) -> None:
        """Fill in the size of the largest match of two kinds and of all that it needs."""
        todo = [(a, b)]
        while todo:
            a, b = todo[-1]
            if self._known(a, b) is not None:
                todo.pop()
                continue
            ka, kb = self.below[a], self.below[b]
            head, tail = _ends(ka, kb)
            ka_, kb_ = ka[head : len(ka) - tail], kb[head : len(kb) - tail]
            missing = [(x, y) for x in set(ka_) for y in set(kb_) if self._known(x, y) is None]
            if missing:
                todo += missing
                continue
            ends = sum(self.size[k] for k in (*ka[:head], *ka[len(ka) - tail :]))
            self.weight[a, b] = 1 + ends + (int(self._last_row(ka_, kb_)[-1]) if ka_ and kb_ else 0)
            todo.pop()

    def _table(self, ka, kb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of distinct kinds, and which of them each sibling is."""
        ua, ia = np.unique(ka, return_inverse=True)
        ub, ib = np.unique(kb, return_inverse=True)
        return np.array([[self._known(int(x), int(y)) for y in ub] for x in ua], np.int64), ia, ib

    def _last_row(self, ka, kb) -> np.ndarray:
        if len(ka) * len(kb) <= 256:
            row = [0] * (len(kb) + 1)
            for x in ka:
                new = [0]
                for j, y in enumerate(kb):
                    new.append(max(row[j + 1], new[j], row[j] + self._known(x, y)))
                row = new
            return np.array(row)
        return _rows(*self._table(ka, kb))

    def pairs(self, kinds_a: list[int], kids_a: list[list[int]], kinds_b: list[int], kids_b: list[list[int]]) -> list[tuple[int, int]]:
        """The pairs of nodes in a largest match."""
        out, todo = [], [(0, 0)]
        while todo:
            a, b = todo.pop()
            x, y = kinds_a[a], kinds_b[b]
            if x == y:  # nodes stand in page order, so a subtree is a range
                out += zip(range(a, a + self.size[x]), range(b, b + self.size[y]), strict=True)
                continue
            if self.tag[x] != self.tag[y]:
                continue
            out.append((a, b))
            ka, kb = kids_a[a], kids_b[b]
            todo += [(ka[i], kb[j]) for i, j in self._aligned(x, y)]
        return out

    def _aligned(self, x: int, y: int) -> list[tuple[int, int]]:
        """Which children of two different kinds go together; found once for a pair of kinds, unless it is very long."""
        known = self.paths.get((x, y))
        if known is not None:
            return known
        xa, xb = self.below[x], self.below[y]
        head, tail = _ends(xa, xb)
        na, nb = len(xa) - tail, len(xb) - tail
        path = [(i, i) for i in range(head)] + [(na + i, nb + i) for i in range(tail)]
        xa, xb = xa[head:na], xb[head:nb]
        if xa and xb:
            for p in set(xa):
                for q in set(xb):
                    self._weigh(p, q)
            middle = self._short_path(xa, xb) if len(xa) * len(xb) <= min(SHORT_CELLS, TABLE_CELLS) else _path(*self._table(xa, xb))
            path += [(head + i, head + j) for i, j in middle]
        if len(path) <= LONGEST_KEPT:
            self.paths[x, y] = path
            self.held += len(path)
        return path

    def _short_path(self, xa: tuple[int, ...], xb: tuple[int, ...]) -> list[tuple[int, int]]:
        """``_path`` of short lists, without arrays."""
        rows = [[0] * (len(xb) + 1)]
        for p in xa:
            row, new, last = rows[-1], [0], 0
            for j, q in enumerate(xb):
                last = max(row[j + 1], last, row[j] + self._known(p, q))
                new.append(last)
            rows.append(new)
        out, i, j = [], len(xa), len(xb)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out


def match(tags_a: list[str], kids_a: list[list[int]], tags_b: list[str], kids_b: list[list[int]]) -> list[tuple[int, int]]:
    """Simple tree matching of two trees at hand."""
    own = Matcher()
    return own.pairs(own.shape(tags_a, kids_a), kids_a, own.shape(tags_b, kids_b), kids_b)


def _ends(ka: tuple[int, ...], kb: tuple[int, ...]) -> tuple[int, int]:
    """How many kinds are equal at the beginnings, and at the ends of what is left."""
    short = min(len(ka), len(kb))
    head = next((i for i in range(short) if ka[i] != kb[i]), short)
    tail = next((i for i in range(short - head) if ka[-1 - i] != kb[-1 - i]), short - head)
    return head, tail


def _rows(weights: np.ndarray, ia: np.ndarray, ib: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The last row of the alignment table; all of them go to ``keep``."""
    row = np.zeros(len(ib) + 1, np.int64)
    wide = weights[:, ib]
    for i in ia:
        new = row.copy()
        np.maximum(row[1:], row[:-1] + wide[i], out=new[1:])
        row = np.maximum.accumulate(new)
        if keep is not None:
            keep.append(row)
    return row


def _path(weights: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of a best alignment; halves of a large table are settled one after the other."""
    out, todo = [], [(0, len(ia), 0, len(ib))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= TABLE_CELLS or b - a == 1:
            rows = [np.zeros(d - c + 1, np.int64)]
            _rows(weights, ia[a:b], ib[c:d], rows)
            i, j = b - a, d - c
            while i and j:
                if rows[i][j] == rows[i - 1][j]:
                    i -= 1
                elif rows[i][j] == rows[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
            continue
        half = (a + b) // 2
        above = _rows(weights, ia[a:half], ib[c:d])
        under = _rows(weights, ia[half:b][::-1], ib[c:d][::-1])[::-1]
        cut = c + int(np.argmax(above + under))
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return out


class _Aligner:
    """The references of one host: (hash of the page, tags, parents, keys), keys 0 where there is no text."""

    def __init__(self, refs: list[dict]) -> None:
        self.refs, self.matcher, self.trees = refs, Matcher(), []
        for r in refs:
            kids = _kids(r["p"])
            self.trees.append((r["h"], r["k"], kids, self.matcher.shape(r["t"], kids)))

    def votes(self, source: str, h: int) -> dict[tuple[int, int], bool]:
        """Whether the text is equal, by reference and key of each text of the other references that this page has a node for."""
        if len(self.matcher.weight) + len(self.matcher.tag) + len(self.matcher.paths) + self.matcher.held > 200_000:
            self.__init__(self.refs)
        page = Page(source)
        own, shape, out = page.texts(), self.matcher.shape(page.tag, page.kids), {}
        for other, keys, kids, kinds in self.trees:
            if other != h:
                for x, y in self.matcher.pairs(shape, page.kids, kinds, kids):
                    if keys[y]:
                        out[other, keys[y]] = out.get((other, keys[y])) or own.get(x) == keys[y]
        return out


def _kids(parents: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in parents]
    for node in range(1, len(parents)):
        kids[parents[node]].append(node)
    return kids


def extract(source: str, template: Collection[int] = (), pair: Collection[int] = ()) -> str:
    """Main text of one page.

    ``template`` holds the keys of template texts. Those in ``pair`` are shared by the only two pages of a host; they count
    if they are less than half of the page, else the two are copies of each other. A page that holds nothing but template
    is judged by itself.
    """
    page = Page(source)
    constant: set[int] = set()
    if template or pair:
        texts = page.texts()
        constant = {n for n, key in texts.items() if key in template}
        if pair:
            shared = {n for n, key in texts.items() if key in pair}
            if 2 * sum(page.text[n] for n in shared) < sum(page.text[n] for n in texts):
                constant |= shared
        if len(constant) == len(texts):
            constant = set()
    return page.main_text(page.region(constant), constant)


def induce(pages: DataFrame, host: Column, html_col: str) -> DataFrame:
    """(host, template, pair) of each host that has two different pages or more; see ``extract``.

    Each page is aligned with the references of its host that it does not equal, and votes on each of their texts. Copies
    of a page share one vote. Votes are counted before they are shuffled.
    """
    rows = pages.select(host.alias("host"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html")).where("host <> ''").withColumn("h", F.xxhash64("html"))
    copies, _ = written(rows.groupBy("host", "h").agg(F.count("*").alias("n")).where("n > 1"), "page-copies")
    first = rows.groupBy("host", F.pmod("h", F.lit(REFERENCES)).alias("part")).agg(F.min("h").alias("h"), F.min_by("html", "h").alias("html"))

    def skeletons(batches):
        for b in batches:
            trees = []
            for h, source in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                page = Page(source.as_py())
                keys = page.texts()
                trees.append({"h": h, "t": page.tag, "p": page.parent, "k": [keys.get(n, 0) for n in range(len(page.tag))]})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees, TREE)], ["host", "tree"])

    trees = first.select("host", "h", "html").mapInArrow(skeletons, f"host string, tree {TREE_SQL}")
    refs = trees.groupBy("host").agg(F.array_sort(F.collect_list("tree")).alias("refs"))  # at most REFERENCES trees
    refs, _ = written(refs, "references")  # read again, the join has plain exchanges, and Spark can split a hot host
    # only pages that may be copies are joined with the counts
    flagged = marked(rows, "h", copies.select("h"), "maybe")
    twins = flagged.where("maybe").join(copies, ["host", "h"], "left").select("host", "h", "html", F.coalesce("n", F.lit(1)).alias("n"))
    voters = flagged.where("not maybe").select("host", "h", "html", F.lit(1).cast("long").alias("n")).unionByName(twins)
    voters = voters.join(refs, "host").select("host", "html", "refs", F.greatest(F.lit(1), F.lit(VOTE) / F.col("n")).cast("long").alias("vote"), "h")

    def align(batches):
        kept: dict[str, _Aligner] = {}
        for b in batches:
            aligned: Counter[tuple[str, int, int]] = Counter()
            equal: Counter[tuple[str, int, int]] = Counter()
            hosts, votes, hashes = (b.column(k).to_pylist() for k in (0, 3, 4))
            for k, name in enumerate(hosts):
                if name not in kept:
                    if len(kept) >= 32:
                        kept.clear()
                    kept[name] = _Aligner(b.column(2)[k].as_py())
                for (ref, key), same in kept[name].votes(b.column(1)[k].as_py(), hashes[k]).items():
                    aligned[name, ref, key] += votes[k]
                    if same:
                        equal[name, ref, key] += votes[k]
            keys = list(aligned)
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([of[k] for k in keys], pa.int64()) for of in (aligned, equal))], ["host", "ref", "key", "aligned", "equal"])

    facts = voters.mapInArrow(align, "host string, ref long, key long, aligned long, equal long")
    facts = facts.groupBy("host", "ref", "key").agg(F.sum("aligned").alias("aligned"), F.sum("equal").alias("equal")).where(f"equal > 0 and equal >= {CONSTANT} * aligned")
    facts = facts.groupBy("host", "key").agg(F.max("equal").alias("equal"))
    two = F.col("equal") < F.lit(VOTE * 3 // 2)  # one other page only
    best = facts.groupBy("host").agg(F.collect_list(F.when(~two, F.col("key"))).alias("template"), F.collect_list(F.when(two, F.col("key"))).alias("pair"))
    return written(best, "wrappers")[0]


TREE = pa.struct([("h", pa.int64()), ("t", pa.list_(pa.string())), ("p", pa.list_(pa.int32())), ("k", pa.list_(pa.int64()))])
TREE_SQL = "struct<h:bigint,t:array<string>,p:array<int>,k:array<bigint>>"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of each row: the main text, one line for each block.

    Null and empty html gives an empty text. Pages with a null url, or of a host alone, are judged by themselves; so is a
    page that holds nothing but template. Repeated pages are all kept, get equal texts, and vote on the template as one
    page. Ties between references go to the smaller hash. Pages may be of any length and depth: a page is held whole by one
    task, aligned in time that grows with the number of differing subtree shapes, and in memory linear in its siblings.
    Other columns of ``pages`` are ignored, whatever their names; an empty table gives an empty result. A host may hold any
    share of all pages: references are found by a pre-aggregated minimum, and the joins by host only ever meet one row a
    host, so Spark can split their large side.
    """
    host, _ = host_and_path(F.col(f"`{url_col}`"))
    wrapper = induce(pages, host, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"), host.alias("host"))
    rows = rows.join(wrapper, "host", "left").select("page_id", "url", "html", "template", "pair", "host")

    def run(batches):
        kept: dict[str, tuple[frozenset, frozenset]] = {}
        for b in batches:
            texts = []
            for k, name in enumerate(b.column(5).to_pylist()):
                if name not in kept:
                    if len(kept) >= 1000:
                        kept.clear()
                    kept[name] = (frozenset(b.column(3)[k].as_py() or ()), frozenset(b.column(4)[k].as_py() or ()))
                texts.append(extract(b.column(2)[k].as_py() or "", *kept[name]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")

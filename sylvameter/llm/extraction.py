"""Main text of web pages by wrapper induction for each host.

The pages of a host are aligned by simple tree matching: siblings are matched in order so that the number of matched
nodes is largest. Text blocks of one kind that follow each other, paragraphs or entries, count as one group, as do
containers where more than SIDE_BY_SIDE follow each other, and blocks of a kind that comes again and again. The wrapper keeps, for each slot (group of text
runs), how many pages have it, how much text and how much linked text it holds, and counts of its runs. A run that half
of the slot's pages have there, two at least, is constant: template. Slots whose text varies are content.

A page is then read along its wrapper. Every block scores its own varying unlinked text and the mean of the slots it is
aligned with, so that a short article on one page is known by the long ones in its place on others. From the root the
reading goes down into the container that holds most of the score, article and main elements and telling class words
weighing more, and stops at the article or where no single container prevails. What it stopped at is read in order,
without the template runs (inside an article or main element nothing counts as template) and without menus, headers,
footers, sidebars, notices, adverts, forms and reader comments.

Copies count once: a page weighs one over the number of pages of its host with the same longest runs. How a page is
aligned depends on its shape alone, the tree of its groups' kinds. The distinct shapes of a host are merged into its
skeleton, in two steps, first by a salt and then as a whole, and always in the same order. Each shape is aligned with the
skeleton once, and pages, text and runs are summed by slot as rows. No group is forgotten and every run is counted,
however many pages a host has; the wrapper keeps the template runs. Texts do not depend on how pages are dealt to
tasks. A skeleton grows with the shapes of a host, not with its pages. Wrappers are broadcast below a checked size and
joined by host above it.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvameter.llm.common import own_exchange, slices
from sylvameter.llm.dom import Node, parse
from sylvameter.llm.marks import COMMENT_MARKS, MAIN_MARKS, OTHER_MARKS
from sylvameter.session import materialise

#: Share of a slot's pages that must have a run for it to be template, and the least number of pages.
CONSTANT, LEAST = 0.5, 1.99
#: Runs of a ``summary``.
RUNS = 48
#: Share of the score that a container must hold for the reading to go down into it.
PREVAILS = 0.6
#: Containers of one kind in a row that are matched one by one.
SIDE_BY_SIDE = 12
SALTS = 64
#: Counts of runs that a task holds before it hands them on.
HELD = 200_000
#: In place of a run: the text of a slot, and its pages.
TEXT, PAGES = -1, -2
#: Fixed value: elements that are not the article.
OTHER_TAGS = frozenset("head nav footer aside button select option dialog menu search".split())
CONTAINERS = frozenset("html body main article section div form fieldset center td tr tbody table".split())


# --- pages --------------------------------------------------------------------------------------------------------

def _key(run: str) -> int:
    return zlib.crc32(run.encode("utf-8", "replace")) << 20 | min(len(run), 0xFFFFF)


def unlinked(node: Node) -> float:
    """The share of a block's own text that is outside links."""
    own = sum(len(p) for p in node.parts if isinstance(p, str))
    return max(0.0, 1 - node.linked / own) if own else 0.0


def _marked(node: Node) -> bool:
    return bool((node.marks | node.ids) & (OTHER_MARKS | COMMENT_MARKS))


def tree(source: str | None) -> Node:
    return parse(source, lambda n: n.tag in OTHER_TAGS or n.aside)


class Page:
    """A parsed page with what lies in each block: unlinked text, and whether there is an article, main or h1 element."""

    def __init__(self, source: str | None) -> None:
        self.root = tree(source)
        self.mass: dict[Node, float] = {}
        self.holds: dict[Node, frozenset[str]] = {}
        self._measure(self.root)
        self.total = self.mass[self.root]

    def _measure(self, node: Node) -> None:
        share, mass, holds = unlinked(node), 0.0, set()
        for part in node.parts:
            if isinstance(part, str):
                mass += share * len(part)
            else:
                self._measure(part)
                mass += self.mass[part]
                holds |= self.holds[part]
        if node.tag in OTHER_TAGS or node.marks & COMMENT_MARKS and node.tag != "body":
            holds = set()
        elif node.tag in ("article", "main", "h1") and not (node.tag == "article" and node.aside):
            holds.add(node.tag)
        self.mass[node], self.holds[node] = mass, frozenset(holds)

    def other(self, node: Node, inside: bool) -> bool:
        """Whether a block is no part of the article. ``inside`` it, only class and role words that tell for sure count."""
        if node.tag in OTHER_TAGS:
            return True
        if node.tag in ("html", "body", "main"):
            return False
        if node.tag == "article" or inside and node.tag not in ("form", "fieldset"):
            return node.aside
        if node.tag in ("form", "fieldset"):  # some sites wrap whole pages in a form
            return not self.holds[node] and self.mass[node] <= self.total / 2
        if node.marks & COMMENT_MARKS or node.ids & COMMENT_MARKS:
            return "article" not in self.holds[node]
        if node.tag == "header" or _marked(node):  # a mark of a block around the whole page says nothing
            around = self.mass[node] >= (0.9 if "h1" in self.holds[node] else 1.0) * self.total
            return not self.holds[node] & {"article", "main"} and not around
        return False


# --- wrappers -----------------------------------------------------------------------------------------------------

def grouped(nodes: list[Node]) -> list[tuple[str, list]]:
    """The parts of like nodes as groups: (kind, nodes) for blocks and ("#text", (run, its unlinked share)).

    Neighbours of one kind are a group. A kind that comes again and again between others, as terms and their meanings do,
    is one group from its first place on: the groups of a page of any length are about as few as its kinds.
    """
    rows: list[tuple[str, list]] = []
    for node in nodes:
        share = unlinked(node)
        for part in node.parts:
            kind, entry = ("#text", (part, share)) if isinstance(part, str) else (part.kind, part)
            if rows and rows[-1][0] == kind:
                rows[-1][1].append(entry)
            else:
                rows.append((kind, [entry]))
    out: list[tuple[str, list]] = []
    for kind, members in rows:
        apart = kind != "#text" and members[0].tag in CONTAINERS and len(members) <= SIDE_BY_SIDE
        out += [(kind, [m]) for m in members] if apart else [(kind, members)]
    often = {kind for kind, n in Counter(kind for kind, _ in out).items() if n > 2 * SIDE_BY_SIDE}
    if not often:
        return out
    first: dict[str, list] = {}
    whole: list[tuple[str, list]] = []
    for kind, members in out:
        if kind in first:
            first[kind].extend(members)
        else:
            whole.append((kind, list(members)))
            if kind in often:
                first[kind] = whole[-1][1]
    return whole


_NUMBERS: dict[tuple, int] = {}
_NEXT = count()


class Wrapper:
    """A group aligned over pages: their weight, for text runs the counts of runs and the unlinked text, and groups."""

    __slots__ = ("kind", "pages", "text", "runs", "kids", "members", "_varying", "_kinds", "_alike")

    def __init__(self, kind: str, pages: float, text: float = 0.0, runs: dict[int, float] | None = None, kids: list[Wrapper] | None = None) -> None:
        self.kind, self.pages, self.text, self.runs, self.kids = kind, pages, text, runs or {}, kids or []
        self.members: list = []  # of one page's group: its blocks
        self._varying: float | None = None
        self._kinds: list[str] | None = None
        self._alike: int | None = None

    @classmethod
    def of(cls, kind: str, members: list, weight: float) -> Wrapper:
        """The wrapper of one page's group."""
        if kind == "#text":
            runs = {_key(r): weight for r, _ in members}
            return cls(kind, weight, weight * sum(len(r) * share for r, share in members), runs)
        whole = cls(kind, weight, kids=[cls.of(k, m, weight) for k, m in grouped(members)])
        whole.members = members
        return whole

    def constant(self) -> set[int]:
        """The template runs of a slot."""
        least = max(LEAST, CONSTANT * self.pages)
        return {k for k, n in self.runs.items() if n >= least}

    def varying(self) -> float:
        """Unlinked characters a page that are not template, all groups below included."""
        if self._varying is None:
            if self.kind == "#text":
                fixed = sum(self.runs[k] * (k & 0xFFFFF) for k in self.constant())
                all_of_it = max(0.0, self.text - fixed)
            else:
                all_of_it = sum(w.varying() * w.pages for w in self.kids)
            self._varying = all_of_it / self.pages if self.pages else 0.0
        return self._varying

    def kinds(self) -> list[str]:
        if self._kinds is None:
            self._kinds = [w.kind for w in self.kids]
        return self._kinds

    def alike(self) -> int:
        """A number that only wrappers of one shape share."""
        if self._alike is None:
            key = (self.kind, *(w.alike() for w in self.kids))
            if len(_NUMBERS) > HELD:  # numbers are not given again
                _NUMBERS.clear()
            self._alike = _NUMBERS.setdefault(key, next(_NEXT))
        return self._alike

    def groups(self) -> Iterator[Wrapper]:
        """This group and all below, each before its own; the places of groups and slots are those in this order."""
        yield self
        for w in self.kids:
            yield from w.groups()

    def shape(self) -> list:
        return [self.kind, *(w.shape() for w in self.kids)]

    @classmethod
    def shaped(cls, shape: list) -> Wrapper:
        return cls(shape[0], 0.0, kids=[cls.shaped(x) for x in shape[1:]])

    def flat(self) -> list:
        """What a reading needs: of the runs the template."""
        runs = sorted((k, self.runs[k]) for k in self.constant()) if self.runs else []
        return [self.kind, self.pages, self.text, runs, [w.flat() for w in self.kids]]

    @classmethod
    def read(cls, flat: list) -> Wrapper:
        return cls(flat[0], flat[1], flat[2], {k: n for k, n in flat[3]}, [cls.read(x) for x in flat[4]])


def summary(runs: dict[int, float]) -> dict[int, float]:
    """At most RUNS of the counts: the largest, less what the next one has.

    For callers that hold counts of a stream; no wrapper is cut to it.
    """
    if len(runs) <= RUNS:
        return runs
    ranked = sorted(runs.items(), key=lambda x: (-x[1], x[0]))
    least = ranked[RUNS][1]
    return {k: n - least for k, n in ranked[:RUNS] if n > least}


def match(left: list[str], right: list[str], score) -> list[tuple[int, int]]:
    """Simple tree matching of two sequences of kinds: pairs of places in order, with the largest total ``score(i, j)``.

    Only pairs of one kind are looked at, so that long lists of many kinds take little longer than short ones. Of equal
    totals it is the one that ends first on the left, then on the right, and so on backwards.
    """
    if left == right:
        return [(i, i) for i in range(len(left))]
    shared = set(left).intersection(right)
    pairs = _in_order(left, right)
    if len(pairs) == len(shared):  # all that there is to match
        return pairs
    places: dict[str, list[int]] = {k: [] for k in shared}
    for j, kind in enumerate(right):
        if kind in shared:
            places[kind].append(j)
    # runs of pairs (total, -i, -j, the run before), those that no run ending further left beats, by their last place
    ends: list[int] = []
    chain: list[tuple] = []
    for i, kind in enumerate(left):
        new = []
        for j in places.get(kind, ()):
            at = bisect_left(ends, j)
            before = chain[at - 1] if at else None
            new.append(((before[0] if before else 0) + score(i, j), -i, -j, before))
        for link in new:
            at = stop = bisect_left(ends, -link[2])
            if at and chain[at - 1] > link:
                continue
            while stop < len(ends) and chain[stop] < link:
                stop += 1
            ends[at:stop], chain[at:stop] = [-link[2]], [link]
    pairs, link = [], chain[-1] if chain else None
    while link:
        pairs.append((-link[1], -link[2]))
        link = link[3]
    return pairs[::-1]


def _in_order(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """The longest ascending run of places of the kinds that are once on either side."""
    once = [{k for k, n in Counter(side).items() if n == 1} for side in (left, right)]
    place = {k: j for j, k in enumerate(right) if k in once[1]}
    ends: list[int] = []  # the least last place of an ascending run of each length
    chain: list[tuple[int, int, tuple | None]] = []  # the run itself, as links
    for i, kind in enumerate(left):
        if kind in once[0] and kind in place:
            j = place[kind]
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
            chain[at : at + 1] = [(i, j, chain[at - 1] if at else None)]
    pairs, link = [], chain[-1] if chain else None
    while link:
        pairs.append(link[:2])
        link = link[2]
    return pairs[::-1]


def aligned(a: Wrapper, b: Wrapper, sizes: dict) -> list[tuple[int, int]]:
    """The matched groups below two wrappers of one kind."""
    return match(a.kinds(), b.kinds(), lambda i, j: _size(a.kids[i], b.kids[j], sizes))


def _size(a: Wrapper, b: Wrapper, sizes: dict) -> int:
    """Matched nodes of two wrappers of one kind, their roots included."""
    key = (a.alike(), b.alike())
    if key not in sizes:
        sizes[key] = 1 + sum(_size(a.kids[i], b.kids[j], sizes) for i, j in aligned(a, b, sizes))
    return sizes[key]


def merge(a: Wrapper, b: Wrapper, sizes: dict | None = None) -> Wrapper:
    """One wrapper for the pages of both; what only one has stays, with its own count of pages, and every run is counted."""
    sizes = {} if sizes is None else sizes
    pages = a.pages + b.pages
    if a.kind == "#text":
        runs = a.runs | {k: a.runs.get(k, 0.0) + n for k, n in b.runs.items()}
        return Wrapper("#text", pages, a.text + b.text, runs)
    kids, i, j = [], 0, 0
    for p, q in [*aligned(a, b, sizes), (len(a.kids), len(b.kids))]:
        kids += a.kids[i:p] + b.kids[j:q]
        if p < len(a.kids):
            kids.append(merge(a.kids[p], b.kids[q], sizes))
        i, j = p + 1, q + 1
    return Wrapper(a.kind, pages, kids=kids)


def slots(page: Wrapper, skeleton: Wrapper) -> list[int]:
    """For each group of a page or its shape the place of its slot, -1 where there is none."""
    place = {id(w): i for i, w in enumerate(skeleton.groups())}
    out, sizes = [], {}

    def walk(group: Wrapper, slot: Wrapper | None) -> None:
        out.append(place[id(slot)] if slot else -1)
        pairs = {i: slot.kids[j] for i, j in aligned(group, slot, sizes)} if slot else {}
        for i, kid in enumerate(group.kids):
            walk(kid, pairs.get(i))

    walk(page, skeleton)
    return out


# --- reading ------------------------------------------------------------------------------------------------------

def _prior(node: Node, page: Page) -> float:
    """How much more a container weighs for being or holding an article, or for its name."""
    holds = page.holds[node]
    return 10.0 if "article" in holds else 4.0 if "main" in holds else 2.0 if (node.marks | node.ids) & MAIN_MARKS else 1.0


class Reading:
    """One page read along the wrapper of its host."""

    def __init__(self, page: Page, wrapper: Wrapper | None) -> None:
        self.page = page
        self.own: dict[Node, float] = {}  # varying unlinked text of this page, by block
        self.score: dict[Node, float] = {}
        self.constant: dict[Node, set[int]] = {}  # template runs of each block's own text
        self._align(Wrapper.of("#root", [page.root], 1.0), wrapper, {})

    def _align(self, group: Wrapper, slot: Wrapper | None, sizes: dict) -> None:
        """Score the blocks of ``group``, one of the page's, which is aligned with ``slot`` of the wrapper."""
        pairs = {i: slot.kids[j] for i, j in aligned(group, slot, sizes)} if slot else {}
        fixed: set[int] = set()
        for i, kid in enumerate(group.kids):
            if kid.kind == "#text":
                fixed |= pairs[i].constant() if i in pairs else set()
            else:
                self._align(kid, pairs.get(i), sizes)
        mean, whole = slot.varying() if slot else 0.0, sum(self.page.mass[n] for n in group.members) or 1.0
        for node in group.members:
            self.constant[node] = fixed
            share, own = unlinked(node), 0.0
            for part in node.parts:
                if isinstance(part, str):
                    own += 0.0 if _key(part) in fixed else share * len(part)
                else:
                    own += self.own[part]
            other = self.page.other(node, False)
            self.own[node] = 0.0 if other else own
            self.score[node] = 0.0 if other else own + mean * self.page.mass[node] / whole

    def region(self) -> tuple[list[str], Node, bool]:
        """The title before the region, the region, and whether it is an article or main element or lies in one."""
        node, title, inside = self.page.root, [], False
        while node.tag != "article":
            blocks = [p for p in node.parts if not isinstance(p, str)]
            weights = {p: self.score[p] * _prior(p, self.page) for p in blocks}
            text = sum(len(p) for p in node.parts if isinstance(p, str) and _key(p) not in self.constant[node]) * unlinked(node)
            choice = self._choice([p for p in blocks if p.tag in CONTAINERS], weights, text + sum(weights.values()))
            if choice is None:
                break
            if "h1" not in self.page.holds[choice]:
                before = blocks[: next(i for i, p in enumerate(blocks) if p is choice)]
                title = [r for p in before if "h1" in self.page.holds[p] for r in self._heading(p)] or title
            else:
                title = []
            node, inside = choice, inside or choice.tag in ("article", "main")
        return title, node, inside

    def _choice(self, blocks: list[Node], weights: dict[Node, float], total: float) -> Node | None:
        """The container to go down into. Of several articles side by side it is the first of any size."""
        if not blocks or total <= 0:
            return None
        best = max(blocks, key=weights.__getitem__)
        articles = [p for p in blocks if p.tag == "article" and weights[p] > 0]
        if best.tag == "article" and len(articles) > 1:
            if sum(weights[p] for p in articles) < PREVAILS * total:
                return None
            return next(p for p in articles if weights[p] >= weights[best] / 3)
        return best if weights[best] >= PREVAILS * total else None

    def _heading(self, node: Node) -> list[str]:
        if self.page.other(node, False):
            return []
        if node.tag == "h1":
            return [r for r in self._runs(node, True, True)]
        return [r for p in node.parts if not isinstance(p, str) for r in self._heading(p)]

    def _runs(self, node: Node, inside: bool, template: bool) -> Iterator[str]:
        """Text runs in page order; without template runs if ``template``, and outside of a region without lists of links."""
        share = unlinked(node)
        for part in node.parts:
            if not isinstance(part, str):
                if not self.page.other(part, inside):
                    yield from self._runs(part, inside, template)
            elif (inside or share > 0.5) and not (template and _key(part) in self.constant[node]):
                yield part

    def text(self) -> str:
        title, node, inside = self.region()
        found = node.tag not in ("#root", "html", "body")
        return "\n\n".join([*title, *self._runs(node, found, not inside)])


def main_text(source: str | None, wrapper: Wrapper | None = None) -> str:
    """The article of a page, blocks joined by an empty line; empty if there is none."""
    return Reading(Page(source), wrapper).text() if source else ""


# --- pages of many hosts ------------------------------------------------------------------------------------------

def _host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\s]*@)?([^/?#\s]*)", 1))
    return F.coalesce(found, F.lit(""))


def _longest_runs(source: Column, n: int = 3) -> Column:
    """A hash of the longest pieces between tags: what copies of one article have in common."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)", " ")
    pieces = F.transform(F.split(bare, "<[^>]*>"), lambda x: F.struct(F.length(x), F.trim(x)))
    return F.xxhash64(F.slice(F.sort_array(pieces, False), 1, n))


def weighted(pages: DataFrame) -> DataFrame:
    """(host, html, weight): each page weighs one over the pages of its host with the same longest runs."""
    keyed = pages.select(
        _host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html")
    ).withColumn("copy", F.xxhash64("host", _longest_runs(F.col("html"))))
    copies = keyed.groupBy("copy").agg(F.count("*").alias("n")).where("n > 1")
    joined = keyed.join(own_exchange(materialise(copies), "copy"), "copy", "left")
    return joined.select("host", "html", (F.lit(1.0) / F.coalesce("n", F.lit(1))).alias("weight"))


def _table(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def _dump(w: Wrapper) -> str:
    return json.dumps(w.flat(), separators=(",", ":"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, weight) to (host, shape, weight, parts): pages of one shape, the text of their groups and the runs."""
    part = pa.list_(pa.struct([("at", pa.int64()), ("run", pa.int64()), ("n", pa.float64())]))
    held: dict[tuple[str, str], list] = {}
    counts = 0

    def out() -> pa.RecordBatch:
        rows = [(h, s, w, [{"at": i, "run": k, "n": n} for (i, k), n in parts.items()]) for (h, s), (w, parts) in held.items()]
        held.clear()
        return _table(rows, host=pa.string(), shape=pa.string(), weight=pa.float64(), parts=part)

    for batch in slices(batches, "html"):
        for host, source, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Wrapper.of("#root", [tree(source)], weight)
            entry = held.setdefault((host, json.dumps(page.shape(), separators=(",", ":"))), [0.0, {}])
            entry[0] += weight
            parts = entry[1]
            counts -= len(parts)
            for i, group in enumerate(page.groups()):
                if group.kind == "#text":
                    parts[i, TEXT] = parts.get((i, TEXT), 0.0) + group.text
                    for k, n in group.runs.items():
                        parts[i, k] = parts.get((i, k), 0.0) + n
            counts += len(parts) + 1
            if counts > HELD:
                yield out()
                counts = 0
    if held:
        yield out()


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge shapes that come sorted by host and salt."""
    key, whole = None, None

    def out() -> pa.RecordBatch:
        shape = json.dumps(whole.shape(), separators=(",", ":"))
        return _table([(*key, shape)], host=pa.string(), salt=pa.int64(), shape=pa.string())

    for batch in batches:
        for host, salt, shape in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = Wrapper.shaped(json.loads(shape))
            if (host, salt) == key:
                whole = merge(whole, new)
            else:
                if whole:
                    yield out()
                key, whole = (host, salt), new
    if whole:
        yield out()


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, weight, skeleton) to (host, id, weight, slots)."""
    last: tuple[str, Wrapper] | None = None
    for batch in slices(batches, "skeleton"):
        rows = []
        for host, shape, weight, skeleton in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is None or last[0] != skeleton:
                last = skeleton, Wrapper.shaped(json.loads(skeleton))
            found = slots(Wrapper.shaped(json.loads(shape)), last[1])
            rows.append((host, hashlib.md5(shape.encode()).hexdigest(), weight, found))
        yield _table(rows, host=pa.string(), id=pa.string(), weight=pa.float64(), slots=pa.list_(pa.int64()))


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, run, n, skeleton), sorted so that a host's skeleton comes first, to (host, wrapper)."""
    host, whole, places = None, None, []
    for batch in batches:
        rows = []
        for name, slot, run, n, skeleton in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if skeleton is not None:
                rows += [(host, _dump(whole))] if whole else []
                host, whole = name, Wrapper.shaped(json.loads(skeleton))
                places = list(whole.groups())
            elif run == PAGES:
                places[slot].pages = n
            elif run == TEXT:
                places[slot].text = n
            else:
                places[slot].runs[run] = n
        yield _table(rows, host=pa.string(), wrapper=pa.string())
    if whole:
        yield _table([(host, _dump(whole))], host=pa.string(), wrapper=pa.string())


def _sum(column: str) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.round(F.sum(column), 6)


def induce_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) for the hosts of ``pages`` (url, html); wrapper is JSON."""
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = materialise(weighted(pages).mapInArrow(_counted, "host string, shape string, weight double, parts array<struct<at:long,run:long,n:double>>"))
    shapes = counted.groupBy("host", "shape").agg(_sum("weight").alias("weight"))

    skeleton = "host string, salt long, shape string"
    salted = shapes.select("host", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).alias("salt"), "shape").repartition(tasks, "host", "salt")
    by_salt = salted.sortWithinPartitions("host", "salt", "shape").mapInArrow(_skeletons, skeleton)
    whole = by_salt.withColumn("salt", F.lit(0).cast("long")).repartition(tasks, "host").sortWithinPartitions("host", "shape")
    skeletons = materialise(whole.mapInArrow(_skeletons, skeleton).select("host", F.col("shape").alias("skeleton")))

    placed = shapes.join(own_exchange(skeletons, "host"), "host").select("host", "shape", "weight", "skeleton")
    placed = placed.mapInArrow(_placed, "host string, id string, weight double, slots array<long>")
    placed = placed.select("host", "id", "weight", F.posexplode("slots").alias("at", "slot")).where("slot >= 0")
    placed = materialise(placed.withColumn("at", F.col("at").cast("long")))
    of_slots = materialise(placed.groupBy("host", "slot").agg(_sum("weight").alias("pages")))

    places = placed.join(own_exchange(of_slots, "host", "slot"), ["host", "slot"]).select("host", "id", "at", "slot", "pages")
    runs = counted.select("host", F.md5("shape").alias("id"), F.inline("parts"))
    runs = runs.join(own_exchange(places, "host", "id", "at"), ["host", "id", "at"])
    runs = runs.groupBy("host", "slot", "run").agg(_sum("n").alias("n"), F.max("pages").alias("pages"))
    runs = runs.where((F.col("run") == TEXT) | (F.col("n") >= F.greatest(F.lit(LEAST), CONSTANT * F.col("pages"))))

    none = F.lit(None).cast("string").alias("skeleton")
    no = [F.lit(-1).cast("long").alias("slot"), F.lit(PAGES).cast("long").alias("run"), F.lit(0.0).alias("n")]
    rows = skeletons.select("host", *no, "skeleton")
    rows = rows.unionByName(of_slots.select("host", "slot", no[1], F.col("pages").alias("n"), none))
    rows = rows.unionByName(runs.select("host", "slot", "run", "n", none))
    return rows.repartition(tasks, "host").sortWithinPartitions("host", "slot", "run").mapInArrow(_filled, "host string, wrapper string")


def extract(pages: DataFrame, most_broadcast: int = 16 << 20) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html); other columns are ignored.

    Null or empty html has empty text; pages without a host share the wrapper of the host ""; repeated rows each have
    their text. Html of any length is read whole, nested to any depth; an empty table gives no rows. ``most_broadcast``
    bounds the bytes of wrappers that are broadcast.
    """
    spark = pages.sparkSession
    wrappers = materialise(induce_wrappers(pages))
    size = wrappers.agg(F.coalesce(F.sum(F.length("host") + F.length("wrapper")), F.lit(0))).first()[0]
    out = pages.select("page_id", F.col("url").cast("string").alias("url"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    narrow = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    narrow = narrow.withColumn("host", _host(F.col("url")))
    known = None
    if size <= most_broadcast:
        known = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        narrow = narrow.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        narrow = narrow.join(own_exchange(wrappers, "host"), "host", "left")
    narrow = narrow.select("page_id", "url", "html", "host", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, Wrapper] = {}

        def wrapper(host: str, text: str | None) -> Wrapper | None:
            text = known.value.get(host) if known else text
            if text is not None and host not in last:
                if len(last) > 200:
                    last.clear()
                last[host] = Wrapper.read(json.loads(text))
            return last.get(host)

        for batch in slices(batches, "html"):
            sources, hosts, own = (batch.column(i).to_pylist() for i in (2, 3, 4))
            texts = [main_text(s, wrapper(h, w)) for s, h, w in zip(sources, hosts, own, strict=True)]
            new = [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], ["page_id", "url", "text", "n_chars"])

    return narrow.mapInArrow(read, out)

"""HTML extraction by consensus host paths.

Every page's containers are scored by the text of their blocks, less the text
of links. A container is named by its path of tags with generalised classes and
ids (digits become ``#``), so that pages of one template share names. The pages of
a host vote: each gives its paths the shares they have of its score. Paths with
at least a fifth of the host's best vote and a fiftieth of all its votes win, at
most fifty a host. Each page is then parsed again and its text taken from the
winning container with most votes and the winners beside it. Votes find the place
only: every block of the region around it is kept, unless at least half of it is
links. The region is the least container below the body that holds blocks besides
the best winner, or the one that also holds all other winners below the body,
whichever is larger. A page that has no winning path keeps every such block.

Menus, headers, footers, sidebars, notices, adverts, forms, comments of readers
and the like are left out wherever they stand, by tag, role, or a word of the
class or id. Words that articles bear as well (``search``, ``notice``) have a vote:
where at least half of a host's pages would have no text for them, the host's pages
are read without them. Character references are decoded, white space inside a block
becomes one space, blocks are joined by a line break.

Defined results: a null or empty page has an empty text; a null URL, or one
without ``://``, belongs to the host with the empty name; markup that isn't
closed ends with its parent or the page; long and deeply nested pages are read whole,
in time that grows with their length (a path of over ``LONG`` characters is written as a hash of
its beginning and the rest); repeated rows are pages of their own
(and vote each); columns other than those named are kept, and one named like a
result is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as references
import re
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeweave.llm.arrays import mapped
from typeweave.llm.url_filter import host_and_path
from typeweave.operators.names import unused
from typeweave.sources.tables import handed_over

BEST_PART, ALL_PART, PARENT_PART, LONG = 0.2, 0.02, 0.6, 512
#: The vote for reading a host's pages without the words of _MILD.
MILD = "?"

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg math canvas object select xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An open element that a new one of the named kind ends, up to the nearest of those that hold it.
_SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_CONTAINERS = frozenset("body div section td main article center".split())
_OUT_TAGS = frozenset("nav header footer aside form button dialog menu head label fieldset".split()) | _RAW
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
_OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation"
    " breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices"
    " popup modal overlay alert comment comments commentlist discussion disqus replies reply respond share sharing social"
    " related recommended recommendations newsletter subscribe subscription signup login form search pager pagination"
    " copyright disclaimer toolbar skip".split()
)
#: Of these, those that name articles too.
_MILD = frozenset("notice notices alert share sharing social related search subscription disclaimer copyright promotion signup login widget".split())

#: These are never left out for a word, as they hold the whole page; nor is what only says that it has a sidebar.
_WHOLE = frozenset("html body main".split())
_SAYS_WHAT_IT_HAS = ("has-", "no-", "with-", "without-", "js-")


class _Container:
    """An element that may hold an article; ``up`` is the container around it, ``semantic`` the nearest article or main part from it on up."""

    __slots__ = ("path", "up", "semantic")

    def __init__(self, path: str, up: _Container | None, semantic: bool) -> None:
        self.path, self.up = path, up
        self.semantic: _Container | None = self if semantic else up and up.semantic


class _Element:
    __slots__ = ("tag", "path", "out", "container", "link")

    def __init__(self, tag: str, path: str, out: bool, container: _Container | None, link: bool) -> None:
        self.tag, self.path, self.out, self.container, self.link = tag, path, out, container, link


class _Open:
    """The open elements, and for each tag the places of those that have it."""

    def __init__(self) -> None:
        self.stack = [_Element("", "", False, None, False)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, element: _Element) -> None:
        self.places[element.tag].append(len(self.stack))
        if element.tag in _BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def last(self, tags) -> int:
        """The place of the innermost element with one of the tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in _BLOCKS:
                self.blocks.pop()

    def end(self, tags, within) -> None:
        """Ends the innermost element with one of the tags, unless one of ``within`` stands inside it."""
        depth = self.last(tags)
        if depth > self.last(within):
            self.cut(depth)


def _below(path: str, name: str) -> str:
    longer = f"{path}>{name}"
    return longer if len(longer) <= LONG else f"~{hashlib.blake2b(longer.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}>{name[:LONG // 2]}"


def _named(tag: str, attributes: str, mild: bool) -> tuple[str, bool]:
    """The element's part of a path, and whether it is left out."""
    name, out = tag, tag in _OUT_TAGS
    if "=" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "role":
                out = out or value.lower() in _OUT_ROLES
                name += "[main]" if value.lower() == "main" else ""
            else:
                mark = "." if key == "class" else "#"
                name += "".join(mark + re.sub(r"\d+", "#", v) for v in sorted(value.split()))
                if tag not in _WHOLE:
                    own = [v for v in value.split() if not v.lower().startswith(_SAYS_WHAT_IT_HAS)]
                    words = {w.lower() for v in own for w in _WORD.findall(v)} & _OUT_WORDS
                    out = out or bool(words - _MILD if mild else words)
    return name, out


def blocks(page: str, mild: bool = False) -> Iterator[tuple[str, _Container | None, int]]:
    """(text, the innermost container that holds it, characters in links) of each block kept."""
    opened = _Open()
    stack = opened.stack
    run: list[str] = []
    linked, at, end, find = 0, 0, len(page), _TOKEN.search

    def flush():
        nonlocal linked
        text = " ".join("".join(run).split())
        run.clear()
        links, linked = linked, 0
        if text:
            yield text, stack[-1].container, links

    while at < end:
        found = find(page, at)
        stop = found.start() if found else end
        if stop > at and not stack[-1].out:
            text = page[at:stop]
            text = references.unescape(text) if "&" in text else text
            run.append(text)
            if stack[-1].link:
                linked += len(text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in _BLOCKS:
                yield from flush()
            depth = opened.last((tag,))
            if depth and (tag in _BLOCKS or not opened.blocks or opened.blocks[-1] < depth):
                opened.cut(depth)
            continue
        if tag in _BLOCKS:
            yield from flush()
        elif tag == "br":
            run.append(" ")
        if tag in _VOID:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in _ENDS_P:
            opened.end(("p",), _CONTAINERS | {"li", "blockquote", "th"})
        if tag in _SIBLINGS:
            ends, within = _SIBLINGS[tag]
            opened.end(ends.split(), within.split())
        name, out = _named(tag, found[3], mild)
        top = stack[-1]
        path = _below(top.path, name) if tag in _BLOCKS and tag != "html" else top.path
        container = _Container(path, top.container, tag in ("article", "main") or "[main]" in name) if tag in _CONTAINERS else top.container
        opened.push(_Element(tag, path, out or top.out, container, tag == "a" or top.link))
    yield from flush()


def shares(page: str) -> dict[str, float]:
    """The part of the page's score that each container path has; MILD if it has none but for mild words."""
    found = list(blocks(page))
    mild = not found and page.strip() != ""
    score: dict[str, float] = defaultdict(float)
    for text, held, links in blocks(page, mild=True) if mild else found:
        if held is None:
            continue
        weight = max(len(text) - 2 * links, 0)
        if held.semantic:
            score[held.semantic.path] += weight
        else:
            score[held.path] += weight
            if held.up:
                score[held.up.path] += weight / 2
    total = sum(score.values())
    return {p: s / total for p, s in score.items() if s > 0} | ({MILD: 1.0} if mild else {}) if total else {}


class _Paths:
    """The container paths of a page as a tree; whether one holds another is told from places in a walk."""

    def __init__(self, found: list[tuple[str, _Container | None, int]]) -> None:
        self.up: dict[str, str | None] = {}
        for _, held, _ in found:
            while held is not None and held.path not in self.up:
                self.up[held.path] = held.up and held.up.path
                held = held.up
        below: dict[str | None, list[str]] = defaultdict(list)
        for path, up in self.up.items():
            below[up].append(path)
        self.enter: dict[str, int] = {}
        self.leave: dict[str, int] = {}
        self.depth: dict[str | None, int] = {None: 0}
        waiting = [(p, False) for p in below[None]]
        while waiting:
            path, done = waiting.pop()
            if done:
                self.leave[path] = len(self.enter)
                continue
            self.enter[path] = len(self.enter)
            self.depth[path] = self.depth[self.up[path]] + 1
            waiting.append((path, True))
            waiting += [(p, False) for p in below[path]]

    def holds(self, path: str, other: str) -> bool:
        return self.enter[path] <= self.enter[other] < self.leave[path]

    def around(self, path: str | None) -> Iterator[str]:
        while path is not None:
            yield path
            path = self.up[path]


def _region(found: list[tuple[str, _Container | None, int]], tree: _Paths, ranked: list[str], best: str) -> str:
    """The container around the first of the ranked paths whose blocks are kept, best or one that holds it."""
    first = ranked[0]
    above = [p for p in tree.around(tree.up[first]) if not re.match(r"body(?![\w-])", p.rpartition(">")[2])]  # innermost first
    beside: set[str] = set()
    for text, held, links in found:
        if held is not None and 2 * links < len(text) and not tree.holds(first, held.path):
            for path in tree.around(held.path):
                if path in beside:
                    break
                beside.add(path)
    found_in, line, seen = [best, next((p for p in above if p in beside), first)], set(above), set()
    for other in ranked[1:]:
        if not tree.holds(first, other) and not tree.holds(other, first):
            for path in tree.around(other):
                if path in seen:
                    break
                seen.add(path)
                if path in line:
                    found_in.append(path)
                    break
    return min(found_in, key=tree.depth.get)  # all hold the first, so the outermost holds the others


def extracted(page: str, votes: dict[str, float]) -> tuple[str, list[str]]:
    """The page's text and the container paths that it was taken from."""
    found = list(blocks(page, mild=MILD in votes))
    tree = _Paths(found)
    ranked = sorted((p for p in tree.up if p in votes), key=lambda p: (-votes[p], p))
    everywhere = not ranked
    if everywhere:
        votes = shares(page)
        ranked = sorted((p for p in tree.up if p in votes), key=lambda p: (-votes[p], p))
    if not ranked:
        return "\n".join(t for t, _, _ in found), []
    best = ranked[0]
    for path in ranked[1:]:
        if path != best and tree.holds(path, best) and not re.fullmatch(">[^>]*", path) and votes[path] >= PARENT_PART * votes[ranked[0]]:
            best = path
    region = _region(found, tree, ranked, best)
    taken, chosen = [(tree.enter[best], tree.leave[best])], [region]  # taken containers don't hold one another

    def in_taken(at: int) -> bool:
        k = bisect_right(taken, (at, len(tree.up) + 1))
        return k > 0 and at < taken[k - 1][1]

    for path in ranked:
        low, high = tree.enter[path], tree.leave[path]
        k = bisect_right(taken, (low, len(tree.up) + 1))
        if not in_taken(low) and (k == len(taken) or taken[k][0] >= high):
            insort(taken, (low, high))
            if path == region or not tree.holds(region, path):
                chosen.append(path)
    texts = []
    for text, held, links in found:
        plain = 2 * links < len(text)
        if held is None:
            keep = everywhere and plain
        else:
            keep = in_taken(tree.enter[held.path]) or ((everywhere or tree.holds(region, held.path)) and plain)
        if keep:
            texts.append(text)
    return "\n".join(texts), chosen


def winning_paths(pages: DataFrame, page: str) -> DataFrame:
    """(host, votes): the winning paths of each host with their votes; ``pages`` has a column host."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [list(shares(p or "").items()) for p in batch.column(page).to_pylist()]
            return {"_shares": pa.array(found, pa.map_(pa.string(), pa.float64()))}

        return run

    voted = mapped(pages.select("host", page), make, "_shares map<string,double>", page, drop=(page,))
    votes = voted.select("host", F.explode("_shares").alias("path", "share")).groupBy("host", "path").agg(F.sum("share").alias("votes"))
    votes = handed_over(votes, "host-votes")
    path = F.col("path") != MILD
    most = votes.groupBy("host").agg(F.max(F.when(path, F.col("votes"))).alias("best"), F.sum(F.when(path, F.col("votes"))).alias("all"))
    wins = (F.col("votes") >= BEST_PART * F.col("best")) & (F.col("votes") >= ALL_PART * F.col("all"))
    return (
        votes.join(most, "host")
        .where(F.when(path, wins).otherwise(2 * F.col("votes") >= F.col("all")))
        .groupBy("host")
        .agg(F.map_from_entries(F.collect_list(F.struct("path", "votes"))).alias("votes"))
    )


def main_text(pages: DataFrame, url: str = "url", page: str = "html", keep_html: bool = False) -> DataFrame:
    """Adds host, text, n_chars and paths to each page."""
    hosted = pages.withColumn("host", host_and_path(F.col(url))[0])
    votes_of, = unused(hosted.columns, "votes")
    winners = handed_over(winning_paths(hosted, page), "host-paths")
    # The written table's size decides whether it is broadcast or both sides are dealt out by host.
    joined = hosted.join(winners.withColumnRenamed("votes", votes_of), "host", "left")

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            done = [extracted(p or "", dict(v or ())) for p, v in zip(batch.column(page).to_pylist(), batch.column(votes_of).to_pylist())]
            texts = [t for t, _ in done]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64()), "paths": pa.array([p for _, p in done], pa.list_(pa.string()))}

        return run

    return mapped(joined, make, "text string, n_chars long, paths array<string>", page, drop=(votes_of,) if keep_html else (votes_of, page))

r"""Main text of web pages by consensus host paths.

A page is parsed into blocks of text and the elements around them. Each container is scored by the text of its blocks
less link text, as it counts for parent and grandparent; from the best one the page climbs to the whole article (see
Page.whole), and votes with its score for the path of what it reaches: the generalised tags and classes from the root
down. Spark adds up the votes per host, and every page is extracted again from the containers on its host's winning
path. A page that has none of the paths falls back to its own.

Names and tags that mark menus, forms, comments and the like only weigh: what holds the page's article stays, whatever
its name is (see Page.judge). Paths whose text is the same beside nearly all different articles of a host, and that no
page votes for, are boilerplate there, however long they are.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .urls import host_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^>]*/>|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|object|canvas)\b(?:.*?</(?P=raw)\b[^>]*>|[^>]*/>|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*)>|<[a-z/][^>]*\Z",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([a-z][\w:-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that are never text, those that mark by themselves, and those that may hold the article as well.
NEVER = frozenset("head title button".split())
STRONG_TAGS = frozenset("nav footer aside menu dialog".split())
WEAK_TAGS = frozenset("form fieldset".split())
#: Every page has one body, whether its tags are there or not.
ROOT = frozenset("html body".split())
#: Parts of class and id names that mark what is no article; the weak ones are common around articles too.
STRONG = re.compile(
    r"^(?:ads?|adv|advert\w*|adsense|sponsor\w*|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|cookies?|consent|gdpr|"
    r"popup|newsletter|pagination|pager|toolbar|disqus|repl(?:y|ies)|respond)$"
)
WEAK = re.compile(r"^(?:banners?|promo\w*|notices?|alerts?|modal|overlay|subscribe|signup|login|social|shar(?:e|ing)|related|recommend\w*|widgets?|forms?)$")
READERS = re.compile(r"(?:user|reader|visitor|member)s?[\W_]*(?:discussion|opinion|feedback|reaction|contribution|review)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names are compared without digits, so post-17 and post-18 are one.
DIGITS = re.compile(r"\d+")
SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
#: A longer path has the hash of its beginning instead.
PATH_CHARS = 1000
#: Share of the page's text that a weakly or strongly marked element must hold to stay, where no article or main shows what the text is.
WEAK_SHARE, STRONG_SHARE = 0.5, 0.8
#: Share of what is held that a container must add to be climbed to.
ADDED = 0.2
#: Different articles of a host, and the share of them with the same text, that make a path boilerplate.
ALIKE_PAGES, ALIKE = 5, 0.8
HASH_BASE = 0x1F3D5B79A2C4E6F1 % ((1 << 61) - 1)


@dataclass(eq=False)
class Element:
    tag: str
    path: str
    mark: int  # 0, 1 weak, 2 strong, 3 never text
    start: int
    end: int = -1
    score: float = 0.0
    up: Element | None = None
    gone: bool = False


def names(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)}


def generalised(tag: str, given: dict[str, str]) -> str:
    classes = sorted({DIGITS.sub("#", c).lower() for c in given.get("class", "").split()})
    return ".".join([tag, *classes])


def mark(tag: str, given: dict[str, str], inside: bool) -> int:
    """How strongly an element's tag and names say that it is no part of an article; inside: it is in an article or main."""
    if tag in NEVER:
        return 3
    if tag == "main":
        return 0
    if tag in STRONG_TAGS or tag == "header" and not inside:
        return 2
    if not given:
        return int(tag in WEAK_TAGS)
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return 2
    named = f"{given.get('class', '')} {given.get('id', '')}"
    words = {w.lower() for w in SPLIT.split(named) if w}
    if any(map(STRONG.match, words)) or READERS.search(named) or "header" in words and not inside or given.get("role", "").lower() in ROLES - {"form"}:
        return 2
    return int(tag in WEAK_TAGS or given.get("role") == "form" or any(map(WEAK.match, words)))


class Page:
    """The blocks of a page, those of them that may be article text, and its containers with the range of blocks in each."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.linked: list[int] = []  # characters of each block that are in links
        self.within: list[Element] = []  # the innermost element around each block
        self.elements: list[Element] = []
        self._stack = [Element("body", "body", 0, 0)]
        self._open_tags: Counter = Counter()
        self._text: list[str] = []
        self._links = self._depth_a = self._inside = self._never = 0
        at = 0
        for m in MARKUP.finditer(source):
            if m.start() > at:
                self._data(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self._close(tag)
            else:
                rest = m["rest"] or m["rest2"] or ""
                self._open(tag, names(rest) if rest.strip(" /") else {})
        self._data(source[at:])
        self._flush()
        while self._stack:
            self._pop()
        # characters outside of links before each block
        self.worth = list(accumulate((len(x) - n for x, n in zip(self.blocks, self.linked)), initial=0))
        self.judge()
        self._score()

    def _data(self, text: str) -> None:
        if self._never:
            return
        text = entities.unescape(text) if "&" in text else text
        if self._depth_a:
            self._links += len(text.strip())
        self._text.append(text)

    def _flush(self) -> None:
        block = " ".join("".join(self._text).split())
        self._text.clear()
        if block:
            self.blocks.append(block)
            self.linked.append(min(self._links, len(block)))
            self.within.append(self._stack[-1])
        self._links = 0

    def _open(self, tag: str, given: dict[str, str]) -> None:
        if tag in INLINE:
            if tag == "br":
                self._text.append(" ")
            self._depth_a += tag == "a"
            return
        self._flush()
        if tag in VOID or tag in ROOT:
            return
        closes = CLOSES.get(tag, ())
        while self._stack[-1].tag in closes or self._stack[-1].tag == "p":
            self._pop()
        top = self._stack[-1]
        above = top.path if len(top.path) <= PATH_CHARS else f"#{xxhash.xxh3_64_hexdigest(top.path)}"
        path = f"{above}>{generalised(tag, given)}"
        self._stack.append(Element(tag, path, mark(tag, given, self._inside > 0), len(self.blocks), up=top))
        self._open_tags[tag] += 1
        self._inside += tag in ("article", "main")
        self._never += self._stack[-1].mark == 3

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            self._depth_a = max(0, self._depth_a - (tag == "a"))
            return
        if self._open_tags[tag]:
            self._flush()
            while self._pop().tag != tag:
                pass

    def _pop(self) -> Element:
        e = self._stack.pop()
        self._open_tags[e.tag] -= 1
        self._inside -= e.tag in ("article", "main")
        self._never -= e.mark == 3
        self._depth_a = 0
        e.end = len(self.blocks)
        if e.end > e.start:
            self.elements.append(e)
        return e

    def unlinked(self, e: Element) -> int:
        return self.worth[e.end] - self.worth[e.start]

    def judge(self) -> None:
        """Say which marked elements go, and so which blocks are alive.

        The core is the page's largest article or main, if it has a quarter of the page's text (strongly marked elements
        don't count, unless it is in one itself). What is around it never
        goes, and marked elements beside it do. Within it, or on the whole page where there is none, a weakly marked
        element stays if it holds over half of the text, a strongly marked one if it holds over four fifths and no h1 is
        outside of it.
        """
        page, until, strong = self.worth[-1], 0, [False] * len(self.blocks)
        self.elements.sort(key=lambda e: (e.start, -e.end))
        for e in self.elements:
            if e.mark == 2 and e.end > until:
                strong[max(e.start, until) : e.end] = [True] * (e.end - max(e.start, until))
                until = e.end
        plain = page - sum(self.worth[i + 1] - self.worth[i] for i, x in enumerate(strong) if x)
        cores = [e for e in self.elements if e.tag in ("article", "main") and not e.mark and 4 * self.unlinked(e) >= (page if strong[e.start] else plain)]
        core = max(cores, key=self.unlinked, default=None)
        around, e = set(), core
        while e:
            around.add(id(e))
            e = e.up
        titles = [i for i, e in enumerate(self.within) if e.tag == "h1"]
        start, end = (core.start, core.end) if core else (0, len(self.blocks))
        base = max(1, self.worth[end] - self.worth[start])
        for e in self.elements:
            if e.mark and id(e) not in around:
                share = self.unlinked(e) / base
                stays = share > WEAK_SHARE if e.mark == 1 else share > STRONG_SHARE and (not titles or e.start <= titles[0] and titles[-1] < e.end)
                e.gone = not (start <= e.start and e.end <= end and stays)
        self.alive, until = [True] * len(self.blocks), 0
        for e in self.elements:
            if e.gone and e.end > until:
                self.alive[max(e.start, until) : e.end] = [False] * (e.end - max(e.start, until))
                until = e.end

    def _score(self) -> None:
        for i, block in enumerate(self.blocks):
            if not self.alive[i]:
                continue
            free, share, e, n = len(block) - self.linked[i], 1.0, self.within[i], 0
            worth = free if self.linked[i] * 2 < len(block) else free * 0.2
            while e and n < 2:
                if e.tag in CONTAINERS:
                    e.score += worth * share
                    share /= 2
                    n += 1
                e = e.up
        # before each block: characters alive, those of them in links, and headings alive
        rows = [(len(x), n, e.tag in ("h1", "h2")) if ok else (0, 0, 0) for x, n, e, ok in zip(self.blocks, self.linked, self.within, self.alive)]
        self._sums = [list(accumulate(x, initial=0)) for x in (zip(*rows) if rows else ((), (), ()))]
        self.containers = [e for e in self.elements if e.tag in CONTAINERS and self._held(e)[0]]

    def _held(self, e: Element) -> tuple[int, int, int]:
        """Characters alive in the element, those of them in links, and its headings."""
        return tuple(x[e.end] - x[e.start] for x in self._sums)

    def best(self) -> Element | None:
        """The whole of the container with the highest score; of equal ones the innermost and first."""
        best = max(self.containers, key=lambda e: (e.score, e.start - e.end), default=None)
        return best and self.whole(best)

    def whole(self, e: Element) -> Element:
        """Climbs from e to the articles and mains around it as long as what they add is text rather than links.

        Where there are none, it climbs container by container as long as these add text rather than links, and either
        a fifth of what is held or an h1 or h2.
        """
        around, x = [], e
        while x:
            if x.tag in CONTAINERS:
                around.append(x)
            x = x.up
        mains = [x for x in around if x.tag in ("article", "main")]
        top = mains[0] if mains else e
        for x in mains[1:] or ([] if mains else around[1:]):
            held = self._held(top)
            chars, linked, headings = (a - b for a, b in zip(self._held(x), held))
            if not chars and not mains:
                continue
            if 2 * linked > chars or not mains and not headings and chars - linked < ADDED * (held[0] - held[1]):
                break
            top = x
        return top

    def digests(self) -> list[int]:
        """A hash of the text alive in each container."""
        prime, powers, sums = (1 << 61) - 1, [1], [0]
        for x, ok in zip(self.blocks, self.alive):
            sums.append((sums[-1] * HASH_BASE + (xxhash.xxh3_64_intdigest(x) if ok else 0)) % prime)
            powers.append(powers[-1] * HASH_BASE % prime)
        return [(sums[e.end] - sums[e.start] * powers[e.end - e.start]) % prime for e in self.containers]

    def text(self, paths: list[str] = (), boilerplate: list[str] = ()) -> str:
        """Blocks of the containers on the first of the paths that the page has, else of its own best; without boilerplate paths.

        A page of which boilerplate is all keeps it. The path of the whole body is only for pages whose own best it is.
        """
        own = self.best()
        if own is None:
            return ""
        on: dict[str, list[Element]] = {}
        for e in self.containers:
            if e.tag != "body" or e is own:
                on.setdefault(e.path, []).append(e)
        chosen = next((on[path] for path in paths if path in on), [own])
        held = {i for e in chosen for i in range(e.start, e.end) if self.alive[i]}
        less = {i for path in boilerplate for e in on.get(path, ()) if e not in chosen for i in range(e.start, e.end)} & held
        return "\n".join(self.blocks[i] for i in sorted(held - less or held))


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and container: host, path, hashes of its text and of the text that the page votes for, and the score that it votes with."""
    for batch in batches:
        rows: list[tuple] = []
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = Page(source.as_py())
            best = page.best()
            digests = page.digests()
            article = next((text for e, text in zip(page.containers, digests) if e is best), 0)
            rows += [(host, e.path, text, article, float(page.unlinked(e)) + 1 if e is best else 0.0) for e, text in zip(page.containers, digests)]
        columns = zip(*rows) if rows else [()] * 5
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["host", "path", "text", "article", "score"])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [Page(h.as_py()).text(p.as_py() or (), b.as_py() or ()) for h, p, b in zip(batch.column(2), batch.column(3), batch.column(4))]
        yield pa.record_batch({"id": batch.column(0), "url": batch.column(1), "text": pa.array(text, pa.string())})


def host_paths(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """host, the paths that its pages voted for, best first, and its boilerplate paths.

    A path is boilerplate if no page votes for it and it has one and the same text on ALIKE of at least ALIKE_PAGES
    different articles; pages with the same article count once.
    """
    ship(pages.sparkSession)
    rows = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    found = rows.mapInArrow(votes, "host string, path string, text long, article long, score double")
    of_page = found.groupBy("host", "path", "text", "article").agg(F.sum("score").alias("score"))
    of_text = of_page.groupBy("host", "path", "text").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    of_path = of_text.groupBy("host", "path").agg(F.sum("score").alias("score"), F.sum("n").alias("n"), F.max("n").alias("most"))
    alike = (F.col("n") >= ALIKE_PAGES) & (F.col("most") >= ALIKE * F.col("n"))
    kept = of_path.filter((F.col("score") > 0) | alike)
    voted = F.collect_list(F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("less"), "path")))
    same = F.collect_list(F.when(F.col("score") == 0, F.col("path")))
    return kept.groupBy("host").agg(F.transform(F.array_sort(voted), lambda x: x["path"]).alias("paths"), F.array_sort(same).alias("boilerplate"))


def main_texts(pages: DataFrame, *, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per page: key, url, text, n_chars.

    Null or empty html gives an empty text; pages without a host (null url, or one without ://) vote together; repeated
    rows stay; any key type, null keys included; other columns are ignored; an empty table gives no rows. Nothing is cut.
    """
    kind = pages.schema[key].dataType.simpleString()
    # written, so its size is known: a small table is broadcast and no page is shuffled, a large one meets plain shuffles whose hot hosts Spark splits
    winning = Scratch(pages.sparkSession, "html").written(host_paths(pages, url=url, html=html), "paths")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    joined = rows.join(winning, "host", "left").select("id", "url", "html", "paths", "boilerplate")
    out = joined.mapInArrow(texts, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))

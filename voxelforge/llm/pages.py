"""Main text of web pages by consensus of host and page.

Every page's containers are scored by the text of their own blocks outside links, half of which also goes
to their parent; the best one gives its path a vote.  A path is the chain of tags and classes from the
root, with digits in class names made equal.  Spark counts the votes by host and path; the paths of a host
in order of votes are its consensus.  Then every page is read again: the first path of its host that
leads to text on the page names its containers, whose blocks are the main text.  A page on which no
voted path has text uses its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left
out by their tags, roles, and the words of their classes and ids; a name alone does not exclude an element
that holds the page's article, main part or first heading or, on a page without these, half of its text.  The heading and the head of an
article belong to it.
A line break is white space inside a block; cells of a table row are words of one block.

Edge cases: a null or empty html has no text.  Pages without a host share the empty one.  Pages that are cut
off or badly nested are read as far as they go; comments and scripts without an end run to the end.  Very long
pages are read whole, in linear time.  Repeated rows vote again and repeat their result.  Ties of votes go to
the larger text, then to the smaller path.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Voted paths of a host that its pages try before they fall back on their own best container.
PATHS = 32
#: Hosts up to which their paths are broadcast.
HOSTS = 50_000
#: Beyond this length the beginning of a path is replaced by its digest.
PATH_CHARS = 400
#: Rows of html in an Arrow batch.
ROWS = 256

_TOKEN = re.compile(r"""<(?:!--(?:.*?--!?>|.*+)|[!?][^>]*+>?|(/?+)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?))""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)\b\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""", re.I)
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object noframes select".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_WALLS = frozenset("ul ol dl table tbody thead tfoot article section div body main aside nav".split())
_APART = frozenset("nav footer aside form menu dialog search button head label".split())
_HOLDERS = frozenset("html body article main section div".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Words in names of classes and ids of what is no main text.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer sidebar aside widget widgets related recommended "
    "comment comments commentlist disqus respond reply replies share sharing social newsletter subscribe subscription signup login search form hidden skip".split()
)


class Page:
    """Elements in page order (tag, names, parent) and blocks of text (element, text, characters inside links)."""

    __slots__ = ("blocks", "names", "noise", "parent", "paths", "tag")

    def __init__(self, source: str):
        self.tag, self.names, self.parent, self.noise, self.blocks = [""], [""], [-1], [False], []
        self._read(source)
        self._judge()
        self.paths = self._name_paths()

    def _read(self, source: str) -> None:
        tags, parents = self.tag, self.parent
        stack, pieces, links, open_links, at = [0], [], 0, 0, 0
        block = [0]  # the innermost block elements that are open
        count: dict[str, int] = {}

        def flush() -> None:
            nonlocal links
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    self.blocks.append((block[-1], text, min(links, len(text))))
                pieces.clear()
            links = 0

        def add(text: str) -> None:
            nonlocal links
            if "&" in text:
                text = html.unescape(text)
            pieces.append(text)
            if open_links:
                links += len(text)

        def pop() -> None:
            nonlocal open_links
            t = tags[stack.pop()]
            count[t] -= 1
            if t == "a":
                open_links -= 1
            if t in _BLOCK:
                flush()
                block.pop()

        def close_implied(these: set[str] | frozenset[str], walls: frozenset[str]) -> None:
            i = len(stack) - 1
            while i > 0 and tags[stack[i]] not in walls:
                if tags[stack[i]] in these:
                    while len(stack) > i:
                        pop()
                    return
                i -= 1

        paragraph = frozenset(("p",))
        for m in iter(lambda: _TOKEN.search(source, at), None):
            if m.start() > at:
                add(source[at : m.start()])
            at = m.end()
            t = m[2]
            if t is None:
                continue
            t = t.lower()
            if m[1]:
                if count.get(t):
                    while tags[stack[-1]] != t:
                        pop()
                    pop()
                continue
            if t == "br":
                pieces.append(" ")
                continue
            if t in _RAW:
                end = _END[t].search(source, at)
                at = end.end() if end else len(source)
                continue
            if t in _BLOCK:
                if count.get("p"):
                    close_implied(paragraph, _BLOCK - paragraph)
                if t in _CLOSES and any(count.get(x) for x in _CLOSES[t]):
                    close_implied(_CLOSES[t], _WALLS)
                flush()
            elif t in ("td", "th"):
                if count.get("td") or count.get("th"):
                    close_implied(_CLOSES[t], _WALLS | {"tr"})
                pieces.append(" ")
            if t in _VOID:
                continue
            tags.append(t)
            parents.append(stack[-1])
            names, noise = self._attributes(t, m[3]) if len(m[3]) > 1 else ("", t in _APART)
            self.names.append(names)
            self.noise.append(noise)
            stack.append(len(tags) - 1)
            count[t] = count.get(t, 0) + 1
            if t == "a":
                open_links += 1
            if t in _BLOCK:
                block.append(len(tags) - 1)
        if at < len(source):
            add(source[at:])
        while len(stack) > 1:
            pop()
        flush()

    @staticmethod
    def _attributes(tag: str, text: str) -> tuple[str, bool | None]:
        """(classes for the path, whether the element is certainly no main text; None: by its names only)."""
        names, noise, classes = [], tag in _APART, ""
        for m in _ATTR.finditer(text):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class":
                classes = ".".join(sorted({_DIGITS.sub("0", c) for c in value.split()}))
            if key in ("class", "id"):
                names += [w.lower() for w in _NAME.findall(value)]
            elif key == "role":
                noise |= value.strip().lower() in _ROLES
            elif key == "style":
                noise |= bool(_HIDDEN.search(value))
            else:
                noise |= key == "hidden" or value.strip().lower() == "true"
        return classes, True if noise else None if not _WORDS.isdisjoint(names) else False

    def _judge(self) -> None:
        """Settle headers and elements that only their names speak against."""
        n, tag, parent, noise = len(self.tag), self.tag, self.parent, self.noise
        inside = [False] * n  # of an article or main element
        for i in range(1, n):
            inside[i] = inside[parent[i]] or tag[parent[i]] in ("article", "main")
            if tag[i] == "header" and not inside[i]:
                noise[i] = True
            elif tag[i] in ("html", "body", "article", "main") and noise[i] is None:
                noise[i] = False
        if None in noise:
            chars, core = [0] * n, [t in ("article", "main", "h1") for t in tag]
            for b, text, _ in self.blocks:
                chars[b] += len(text)
            for i in range(n - 1, 0, -1):
                if noise[i] is not True:
                    chars[parent[i]] += chars[i]
                    core[parent[i]] |= core[i]
            for i in range(1, n):
                if noise[i] is None:
                    noise[i] = not (core[i] or not core[0] and 2 * chars[i] > chars[0])
        for i in range(1, n):
            noise[i] = noise[i] or noise[parent[i]]

    def _name_paths(self) -> list[str]:
        """Tags and classes from the root to every element; the beginning of a very long chain is a digest."""
        paths = [""]
        for i in range(1, len(self.tag)):
            before = paths[self.parent[i]]
            if len(before) > PATH_CHARS:
                before = "#" + hashlib.blake2b(before.encode(), digest_size=12).hexdigest()
            paths.append(f"{before}>{self.tag[i]}{'.' if self.names[i] else ''}{self.names[i]}")
        return paths

    def best(self) -> tuple[int, float]:
        """(the container of the main text, its score); (-1, 0) without text.

        The one with most text of its own and, by half, of its children; or the article around it; or what
        also holds the first heading, if little else comes with it.
        """
        score: dict[int, float] = {}
        n, parent, chars = len(self.tag), self.parent, [0] * len(self.tag)
        for b, text, links in self.blocks:
            if not self.noise[b]:
                chars[b] += len(text)
                own = len(text) - 2 * links + 1e-3 * len(text)
                holder = parent[b] if b and self.tag[b] not in _HOLDERS else b
                score[holder] = score.get(holder, 0) + own
                if holder > 0:
                    score[parent[holder]] = score.get(parent[holder], 0) + own / 2
        if not score:
            return -1, 0.0
        top = max(score, key=lambda i: (score[i], -i))
        worth = score[top]
        around, i = [], top
        while i >= 0:
            if self.tag[i] == "article":
                return i, worth
            around.append(i)
            i = parent[i]
        head = next((i for i in range(n) if self.tag[i] == "h1" and not self.noise[i]), -1)
        if head >= 0:
            for i in range(n - 1, 0, -1):
                chars[parent[i]] += chars[i]
            above, i = set(around), head
            while i not in above:
                i = parent[i]
            if chars[i] - chars[top] <= chars[head] + chars[top] // 4:
                top = i
        return top, worth

    def texts(self, paths: list[str]) -> list[str]:
        """Blocks in the containers at the first of these paths that has any, or else in the page's own best one."""
        place, none = {p: i for i, p in enumerate(paths)}, len(paths)
        rank = [none] * len(self.tag)  # the first path among those of an element and of all around it
        for i, p in enumerate(self.paths):
            rank[i] = min(place.get(p, none), rank[self.parent[i]] if i else none)
        main = [(b, t) for b, t, _ in self.blocks if not self.noise[b]]
        first = min((rank[b] for b, _ in main), default=none)
        if first == none:
            top = self.best()[0]
            for i in range(max(top, 0), len(self.tag)):
                rank[i] = -1 if i == top or rank[self.parent[i]] == -1 else none
            first = -1
        return [t for b, t in main if rank[b] == first]


def _host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths): the voted paths of each host, most votes first, for a table (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "")
                top, score = page.best()
                if top >= 0:
                    v = votes.setdefault((host, page.paths[top]), [0, 0])
                    v[0] += 1
                    v[1] += round(1000 * score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in votes], pa.string()) for i in (0, 1)] + [pa.array([v[i] for v in votes.values()], pa.int64()) for i in (0, 1)], ["host", "path", "n", "score"]
            )

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, n long, score long").groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), F.desc("score"), "path"))
    best = votes.withColumn("rank", rank).where(F.col("rank") <= PATHS)
    return best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda r: r["path"]).alias("paths"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession, ROWS)
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", _host())
    paths = cut(consensus(own))
    if paths.count() <= HOSTS:
        paths = F.broadcast(paths)
    kind = own.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(Page(source or "").texts(some or [])) for source, some in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.join(paths, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

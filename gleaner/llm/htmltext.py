"""Main text of web pages by consensus of each host's pages.

Every page's containers are scored by the text they hold outside links, a
container getting half of what its children get.  The best container's path,
generalised to tags and first classes, is the page's vote; Spark counts the
votes of each host.  Each page is then read again and gives the text of the
containers on its host's winning path, or of its own best one where it has
none.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, table
from .urlfilter import host_of

#: Rows of the table of winning paths up to which it is sent to every executor.
BROADCAST_ROWS = 200_000

_RAW = "script|style|title|textarea|template|noscript|iframe|svg|select"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[/!?a-z](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|<[/!?a-z][^<>]*>|[^<]+|<""",
    re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: How elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body article main section div td th table tbody tr center blockquote details dl figure ul ol".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li pre address figcaption dd dt br hr summary caption thead tfoot html".split())
SKIPPED = frozenset("head nav header footer aside form button menu dialog object audio video canvas map fieldset".split())
#: Words in a class, id or role that mark what isn't the article, and what may be.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar side menu nav navbar navigation footer header "
    "masthead banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus replies reply share sharing "
    "social related recommended newsletter subscribe signup login breadcrumb breadcrumbs pagination pager toolbar widget copyright".split())
GOOD = frozenset("article content post entry story text body main prose".split())


def _open(tag: str, name: str) -> tuple[str, set[str]]:
    """An element's step in a path, and the words of its class, id and role."""
    words: set[str] = set()
    first = ""
    for key, a, b, c in _ATTR.findall(tag):
        value = a or b or c
        if key.lower() == "class" and value.split():
            first = "." + re.sub(r"\d+", "N", value.split()[0])
        words.update(w.lower() for w in _PART.findall(value))
    return name + first, words


class Page:
    """The containers of a page and its blocks of text, boilerplate left out."""

    def __init__(self, html: str | None):
        self.paths, self.parents, self.bonus = [""], [-1], [1.0]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        stack: list[tuple[str, int]] = []  # open elements with their containers
        at, skip, skipped, link = 0, "", 0, False
        parts: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((at, text, linked))
                parts, linked = [], 0

        for m in _TOKEN.finditer(html or ""):
            tok = m.group()
            if tok[0] != "<" or tok == "<" or m.group(1) or tok[1] in "!?":
                if (tok[0] != "<" or tok == "<") and not skip:
                    text = unescape(tok)
                    parts.append(text)
                    if link:
                        linked += len(text)
                continue
            name = _NAME.match(tok)
            if not name:
                continue
            tag, closing = name.group(1).lower(), tok[1] == "/"
            if skip:
                if tag == skip and not tok.endswith("/>"):
                    skipped += -1 if closing else 1
                    if not skipped:
                        skip = ""
                continue
            if tag in BLOCKS or tag in SKIPPED:
                flush()
            if tag == "a":
                link = not closing
            if closing:
                if tag in CONTAINERS and any(t == tag for t, _ in stack):
                    while stack and stack.pop()[0] != tag:
                        pass
                    at = stack[-1][1] if stack else 0
                continue
            if tag in VOID or tok.endswith("/>"):
                continue
            step, words = _open(tok, tag) if "=" in tok else (tag, set())
            boiler = tag in SKIPPED or (words & BOILER and tag not in ("html", "body") and not (tag in ("article", "main")))
            if boiler:
                flush()
                skip, skipped = tag, 1
                continue
            if tag in CONTAINERS:
                self.paths.append(f"{self.paths[at]}>{step}")
                self.parents.append(at)
                self.bonus.append(1.5 if tag in ("article", "main") or words & GOOD else 0.8 if tag in ("ul", "ol", "tr", "tbody", "table") else 1.0)
                at = len(self.paths) - 1
                stack.append((tag, at))
        flush()

    def scores(self) -> list[float]:
        out = [0.0] * len(self.paths)
        for node, text, linked in self.blocks:
            gain, n = float(max(0, len(text) - 2 * linked)), node
            while n >= 0 and gain > 0.5:
                out[n] += gain
                n, gain = self.parents[n], gain / 2
        return [s * b for s, b in zip(out, self.bonus)]

    def best(self) -> tuple[str, float] | None:
        """Path of the best container and its share of the page's text."""
        s = self.scores()
        top = max(range(len(s)), key=lambda i: (s[i], -i))
        total = sum(len(t) for _, t, _ in self.blocks)
        return (self.paths[top], min(1.0, s[top] / total)) if total and s[top] > 0 else None

    def text(self, path: str | None) -> str:
        """Text of the containers on ``path``; of the best one if there is none."""
        inside = [p == path for p in self.paths]
        if not any(inside):
            own = self.best()
            if own is None:
                return ""
            inside = [p == own[0] for p in self.paths]
        for i in range(1, len(self.paths)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return " ".join(t for node, t, _ in self.blocks if inside[node])


def page_votes(pages: DataFrame, html: str, host: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [Page(h.as_py()).best() for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b and b[0] for b in best], pa.string()), pa.array([b and b[1] for b in best], pa.float64())],
                names=["host", "path", "share"])

    return pages.select(F.col(host).alias("host"), html).mapInArrow(lean(run), "host string, path string, share double").filter("path is not null")


def host_paths(pages: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """Rows (host, path, votes): each host's winning path.  A host of any size
    costs one row a task and path; ties go to the path that sorts first."""
    counted = page_votes(pages, html, host).groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.round("share", 6)).alias("weight"))
    top = F.min_by(F.struct("path", "votes"), F.struct((-F.round("weight", 3)).alias("w"), "path"))
    return counted.groupBy("host").agg(top.alias("x")).select("host", "x.path", "x.votes")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars, path): one for each row of ``pages``.

    Null html and pages without an article have an empty text; very long pages are
    read whole.  Pages without a host form a host of their own.  Repeated rows each
    give their row and vote, ties go to the path that sorts first.  Other columns
    are not looked at; an empty table gives an empty one.
    """
    rows = pages.select(key, url, html).withColumn("_host", host_of(F.col(url)))
    paths = materialize(host_paths(rows, html, "_host")).select(F.col("host").alias("_host"), F.col("path").alias("_path"))
    small = paths.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(paths) if small else paths, "_host", "left").select(key, url, html, "_path")
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h.as_py()).text(p.as_py()) for h, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column(3)],
                names=[key, url, "text", "n_chars", "path"])

    return joined.mapInArrow(lean(run), f"`{key}` {kind}, `{url}` string, text string, n_chars long, path string")


def op6_hostpaths(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")

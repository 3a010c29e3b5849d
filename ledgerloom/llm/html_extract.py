"""HTML main-text extraction by consensus host paths.

1. Every page is cut into blocks of text under a tree of open elements; menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles and reader comments are recognised by tag, role and class words.  A class word
   silences no element that holds an article, a main, an h1 or, where no article or main has a text of its own, most
   of the page's text without links.  Containers are scored by the text of their blocks without links: the nearest container gets all of it, outer ones ever less.
2. The best container's generalised path (tags with classes and ids, digits made alike) is the page's vote;
   Spark counts the votes of every host.
3. Every page is extracted again with its host's winning paths: the first that it has; a page that has none of
   them uses its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialize

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img ins kbd label mark object q ruby rb rp rt s samp select small span strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle".split()
)
_NOISE_TAGS = frozenset("head nav header footer aside form dialog menu audio video canvas map frameset fieldset".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs pagination pager sidebar aside rail footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended recommendations widget widgets search form copyright disclaimer skip hidden".split()
)
#: Words that make a name say how something is set out, not what it holds: no-sidebar, comments-open.
_STATES = frozenset("no not has have with without is open opened closed enabled disabled".split())
_CONTAINERS = frozenset("article main section div body td content center html".split())
_IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_BLOCKS_END_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_LEVELS = 8  # of a path, innermost ones
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Page:
    """Elements (parent, tag, path, noise, and whether only a class word makes it so) and blocks (element, text, characters in links) in page order."""

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: [""])
    paths: list[str] = field(default_factory=lambda: [""])
    noise: list[bool] = field(default_factory=lambda: [False])
    worded: list[bool] = field(default_factory=lambda: [False])
    headed: list[bool] = field(default_factory=lambda: [False])  # in an article's own header
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def parse(source: str) -> Page:
    page = Page()
    stack, texts, linked, at = [0], [], 0, 0
    links = 0

    def end_block() -> None:
        nonlocal texts, linked
        if texts:
            if text := " ".join(html.unescape("".join(texts)).split()):
                block = next(i for i in reversed(stack) if page.tags[i] not in _INLINE)
                page.blocks.append((block, text, linked))
            texts, linked = [], 0

    def pop(to: int) -> None:
        nonlocal links
        for i in stack[to:]:
            links -= page.tags[i] == "a"
        del stack[to:]

    def push(tag: str, attributes: str) -> None:
        nonlocal links
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes else {}
        names = found.get("class", "").split()
        parent = stack[-1]
        header = tag == "header" and any(page.tags[i] == "article" for i in stack)
        odd = tag in _NOISE_TAGS and not header or found.get("role", "").lower() in _NOISE_ROLES
        worded = not odd and tag not in ("html", "body", "article", "main") and any(map(_noise_name, (*names, found.get("id", ""))))
        label = tag + "".join(f".{re.sub(r'[0-9]+', '0', n)}" for n in sorted(names)) + (f"#{re.sub(r'[0-9]+', '0', found['id'])}" if found.get("id") else "")
        page.parents.append(parent)
        page.tags.append(tag)
        page.paths.append(">".join([*page.paths[parent].split(">")[1 - _LEVELS :], label]))
        page.noise.append(page.noise[parent] or odd)
        page.worded.append(worded)
        page.headed.append(page.headed[parent] or header)
        stack.append(len(page.tags) - 1)
        links += tag == "a"

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            piece = source[at : m.start()]
            texts.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing = tag.lower(), m[2] or m[5]
        if tag not in _INLINE:
            end_block()
        if closing:
            where = next((k for k in range(len(stack) - 1, 0, -1) if page.tags[stack[k]] == tag), 0)
            # an inline end tag doesn't close a block that was opened inside it
            if where and not (tag in _INLINE and any(page.tags[i] not in _INLINE for i in stack[where + 1 :])):
                pop(where)
            continue
        if tag in _VOID:
            continue
        if tag in _BLOCKS_END_P or tag in _IMPLIED:
            ends = _IMPLIED.get(tag, set()) | ({"p"} if tag in _BLOCKS_END_P else set())
            for k in range(len(stack) - 1, 0, -1):
                own = page.tags[stack[k]]
                if own in ends:
                    pop(k)
                elif own in _SCOPES.get(tag, ()) or own not in _INLINE and own not in ("p", "td", "th", "li", "dd", "dt"):
                    break
        push(tag, m[4] or m[7] or "")
    if at < len(source):
        texts.append(source[at:])
        linked += len(source) - at if links else 0
    end_block()
    _silence(page)
    return page


def _noise_name(name: str) -> bool:
    """Whether the first or the last part of a class name or id is a noise word."""
    parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    return bool(parts) and not _STATES.intersection(parts) and (parts[0] in _NOISE_WORDS or parts[-1] in _NOISE_WORDS)


def _silence(page: Page) -> None:
    """Noise by class words, for elements that hold none of the page's main parts."""
    if not any(page.worded):
        return
    n = len(page.tags)
    weight, main = [0] * n, [not page.noise[i] and page.tags[i] in ("article", "main", "h1") for i in range(n)]
    for element, text, linked in page.blocks:
        if not page.noise[element]:
            weight[element] += max(0, len(text) - linked)
    own = weight.copy()
    for i in range(n - 1, 0, -1):
        weight[page.parents[i]] += weight[i]
        main[page.parents[i]] |= main[i]
    inside, said = [False] * n, [False] * n  # an article or main; what a class word would silence, or a heading
    for i in range(1, n):
        inside[i] = inside[page.parents[i]] or page.tags[i] in ("article", "main")
        said[i] = said[page.parents[i]] or page.worded[i] and not main[i] or page.tags[i] in _HEADINGS
    marked = any(own[i] and inside[i] and not said[i] for i in range(n))
    for i in range(1, n):
        most = not marked and 2 * weight[i] > weight[0]
        page.noise[i] = page.noise[i] or page.noise[page.parents[i]] or page.worded[i] and not main[i] and not most


def _useful(page: Page, element: int) -> bool:
    if page.noise[element]:
        return False
    while page.headed[element]:  # of an article's own header its headings only
        if page.tags[element] in _HEADINGS:
            return True
        if page.tags[element] == "header":
            return False
        element = page.parents[element]
    return True


def best_container(page: Page) -> int:
    """The element with the highest score (the outermost of equals); the root if no block counts."""
    scores: dict[int, float] = {}
    for element, text, linked in page.blocks:
        weight = len(text) - 2 * linked
        if weight <= 0 or not _useful(page, element):
            continue
        share = 1.0
        while element >= 0 and share > 0.001:
            tag = page.tags[element]
            if tag in _CONTAINERS or element == 0:
                scores[element] = scores.get(element, 0.0) + weight * share * (1.25 if tag in ("article", "main") else 1.0)
                share /= 2
            element = page.parents[element]
    return min(scores, key=lambda i: (-scores[i], i)) if scores else 0


def main_text(page: Page, paths: list[str]) -> str:
    """Blocks inside the elements of the first of these paths that the page has, else inside its best container."""
    there: dict[str, list[int]] = {}
    for i, p in enumerate(page.paths):
        if not page.noise[i]:
            there.setdefault(p, []).append(i)
    roots = set(next((there[p] for p in paths if p in there), None) or [best_container(page)])
    inside = [i in roots for i in range(len(page.tags))]
    for i, parent in enumerate(page.parents):
        if parent >= 0 and inside[parent]:
            inside[i] = True
    return "\n".join(text for element, text, _ in page.blocks if inside[element] and _useful(page, element))


BROADCAST_HOSTS = 200_000


def host_paths(pages: DataFrame, url_col: str, html_col: str, keep: int = 3) -> DataFrame:
    """(host, paths): each host's most voted container paths, best first; pages without text don't vote."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = []
            for source in batch.column(1).to_pylist():
                page = parse(source)
                best = best_container(page)
                votes.append(page.paths[best] if best else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string())], names=["host", "path"])

    bound_batches(pages.sparkSession)
    rows = pages.select(_host(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    votes = rows.mapInArrow(vote, "host string, path string").dropna().groupBy("host", "path").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    return votes.withColumn("r", rank).filter(F.col("r") <= keep).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("r", "path")))["path"].alias("paths"))


def _host(url_col: str):
    rest = F.regexp_extract(F.coalesce(url_col, F.lit("")), r"://([^/?#]*)", 1)
    return F.lower(rest)


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, then text: the main text of every page ('' if it has none), and path (the host's winner).

    A null page is an empty one; pages whose url is null or has no host share an empty host.  Repeated rows vote
    each and are extracted each.  Other columns are not read; an empty table gives an empty result.  The
    winners (a row for each host) are broadcast up to BROADCAST_HOSTS hosts and joined by shuffle beyond.
    """
    winners = host_paths(pages, url_col, html_col)
    winners = materialize(winners, "op2-paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    rows = pages.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], _host(url_col).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    joined = rows.join(winners, "host", "left").drop("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, paths = batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist()
            texts = [main_text(parse(s), p or []) for s, p in zip(sources, paths, strict=True)]
            first = [p[0] if p else None for p in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(first, pa.string())], names=[*batch.schema.names[:-2], "text", "path"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in joined.schema.fields[: len(keep)])
    out = joined.mapInArrow(run, schema + "text string, path string")
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "text", "path")

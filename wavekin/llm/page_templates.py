"""Main text of web pages by template deduction over the pages of a host.

Tokens are the block elements of a page, named by their place (the signatures of the
elements around them), and whole texts of elements at their place. A token's occurrence vector
says how often each page of the host has it. Tokens with one vector form an equivalence
class. A class is valid if its tokens stand in one order on all its pages, and if on all of
them it lies in the same gap of the same class around it; valid classes nest into the
host's template. What the template's tokens leave between them are its slots.

The article is the slot, or the element around several slots, that holds the text: an
article element of the template, or else what is reached from the page by always going
into the element with most of the text. Texts that belong to the class of the element
they stand in are the template's own and left out of it; so is page furniture.

A vector is one 64-bit value, the xor of a hash of each page with its count, so vectors
are aggregations with map-side combining and no task holds a host's pages. Tokens of a template
stand on a fifth of the pages or more, so a template is at most five times as large as a page.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, release, small_batches, stage, table
from .markup import HEADINGS, Page, role_of
from .urls import host_of

#: Different pages of a host from which on their vectors are compared, and the share of them that a template's token stands on.
LEAST_PAGES, SHARE = 3, 0.2
#: Bytes of templates that are broadcast, at most; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Parts over which the pages of a host are spread for that shuffle.
SALTS = 16
#: Share of an element's text from which on the element inside it that has it is the article.
MOST = 0.5
#: Share of a page's text from which on an article element is the article.
ARTICLE = 0.3

TEXT, CONTAINER, ARTICLE_KIND, HEADING, HIDDEN = 1, 2, 4, 8, 16
CONTAINERS = frozenset("body center div html main article section table tbody tr td".split())
_ROOT = role_of("#page")

_TOKENS = "host string, digest long, roles array<long>, parents array<long>, counts array<int>, firsts array<int>, lasts array<int>, chars array<long>, kinds array<int>"


@dataclass
class Token:
    parent: int
    kind: int
    count: int = 0
    first: int = 1 << 30
    last: int = 0
    chars: int = 0


def tokens_of(page: Page) -> dict[int, Token]:
    """Role -> its token: how often and where the page has it, and the text inside it that is neither hidden nor linked."""
    out: dict[int, Token] = {}
    own = page.own_texts()
    for e, block in enumerate(page.block):
        if block != e:
            continue
        tag, role, above = page.tag[e], page.role[e], page.role[page.block[page.parent[e]]] if e else 0
        kind = (CONTAINER if tag in CONTAINERS else 0) | (ARTICLE_KIND if page.article[e] else 0) | (HEADING if tag in HEADINGS else 0) | (HIDDEN if page.hidden[e] else 0)
        token = out.setdefault(role, Token(above, kind))
        token.kind |= kind & HIDDEN
        token.count += 1
        token.first, token.last = min(token.first, page.open[e]), max(token.last, page.close[e])
        token.chars += page.chars[e] - page.linked[e]
        if e in own:
            text = out.setdefault(role_of(role, own[e]), Token(role, TEXT))
            text.count += 1
            text.first, text.last = min(text.first, page.open[e]), max(text.last, page.open[e])
    return out


def article_role(tokens: dict[int, Token], single: set[int]) -> int:
    """The role of the element that holds the article, among the ``single`` roles, those of elements that stand once on a page."""
    root = tokens[_ROOT]
    named = [(t.chars, r) for r, t in tokens.items() if r in single and t.kind & ARTICLE_KIND and not t.kind & HIDDEN and t.chars >= ARTICLE * max(1, root.chars)]
    if named:
        # the innermost of elements with the same text
        return max(named, key=lambda c: (c[0], _depth(tokens, c[1]), -c[1]))[1]
    inside: dict[int, list[int]] = {}
    for r, t in tokens.items():
        if r != _ROOT and not t.kind & (TEXT | HIDDEN):
            inside.setdefault(t.parent, []).append(r)
    at = _ROOT
    while True:
        below = inside.get(at, [])
        if any(tokens[r].kind & HEADING and tokens[r].chars for r in below):
            return at
        into = [(tokens[r].chars, -r) for r in below if tokens[r].kind & CONTAINER and r in single]
        if not into or max(into)[0] < MOST * max(1, tokens[at].chars):
            return at
        at = -max(into)[1]


def _depth(tokens: dict[int, Token], role: int) -> int:
    n = 0
    while role in tokens and role != _ROOT and n < 1000:
        role, n = tokens[role].parent, n + 1
    return n


def page_tokens(pages: DataFrame) -> DataFrame:
    """(host, digest, roles ... kinds) of (host, html): the tokens of every page; digest names its html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [tokens_of(Page(html)) for html in pdf["html"]]
            of = lambda name: [[getattr(t, name) for t in f.values()] for f in found]  # noqa: B023, E731
            yield pd.DataFrame({
                "host": pdf["host"], "digest": pdf["digest"], "roles": [list(f) for f in found], "parents": of("parent"), "counts": of("count"),
                "firsts": of("first"), "lasts": of("last"), "chars": of("chars"), "kinds": of("kind"),
            })
        release()

    return pages.select("host", F.xxhash64("html").alias("digest"), "html").mapInPandas(run, _TOKENS)


def occurrence_vectors(tokens: DataFrame) -> DataFrame:
    """(host, pages, role, parent, kind, vector, support, total, chars) of the tokens that a template may have.

    ``tokens`` has each different page once. Hosts with fewer pages than LEAST_PAGES have no rows.
    """
    each = tokens.select("host", "digest", F.explode(F.arrays_zip("roles", "parents", "counts", "chars", "kinds")).alias("t"))
    seen = each.groupBy("host", F.col("t.roles").alias("role")).agg(
        F.min("t.parents").alias("parent"), F.bit_or("t.kinds").alias("kind"), F.bit_xor(F.xxhash64("digest", "t.counts")).alias("vector"),
        F.count("*").alias("support"), F.sum("t.counts").alias("total"), F.sum("t.chars").alias("chars"),
    )
    seen = stage(seen.where(F.col("support") >= LEAST_PAGES), "vectors")
    # every page has the root
    pages = seen.where(F.col("role") == _ROOT).select("host", F.col("support").alias("pages"))
    pages = F.broadcast(pages) if pages.count() <= 500_000 else pages
    return seen.join(pages, "host").where(F.col("support") >= SHARE * F.col("pages"))


@dataclass
class Site:
    """The candidate tokens of a host's template; ``classes`` maps a class to its roles."""

    tokens: dict[int, Token]
    vector: dict[int, int]
    single: set[int]
    classes: dict[int, set[int]] = field(default_factory=dict)

    @staticmethod
    def of(rows) -> Site:
        tokens, vector, single = {}, {}, set()
        for r in rows:
            tokens[r["role"]] = Token(r["parent"], r["kind"], r["total"], chars=r["chars"])
            vector[r["role"]] = r["vector"]
            if r["total"] == r["support"]:
                single.add(r["role"])
        site = Site(tokens, vector, single)
        for role, v in vector.items():
            site.classes.setdefault(v, set()).add(role)
        # an element is two tokens, its tags, a text one: lone texts are no class
        site.classes = {v: roles for v, roles in site.classes.items() if len(roles) > 1 or not tokens[next(iter(roles))].kind & TEXT}
        return site


_CLASSES = "host string, vector long, order long, around long, gap int"


def class_places(site: Site, roles: list[int], firsts: list[int], lasts: list[int]) -> list[tuple[int, int, int, int]]:
    """(class, its tokens' order, class around it, gap of that class) on one page. The class around is the one of the narrowest gap; 0 and -1 without one."""
    at: dict[int, list[tuple[int, int, int]]] = {}
    for role, first, last in zip(roles, firsts, lasts, strict=True):
        v = site.vector.get(role)
        if v is not None and v in site.classes:
            at.setdefault(v, []).append((first, last, role))
    # the tags of elements that stand once on a page cut it into gaps
    edges = {v: sorted({p for f, l, r in spots if r in site.single and not site.tokens[r].kind & TEXT for p in (f, l)}) for v, spots in at.items()}
    out = []
    for v, spots in at.items():
        spots.sort()
        low, high = spots[0][0], max(s[1] for s in spots)
        around = (0, -1, 1 << 40)
        for other, cuts in edges.items():
            if other == v or len(cuts) < 2:
                continue
            gap = bisect_right(cuts, low)
            if 0 < gap < len(cuts) and high <= cuts[gap] and cuts[gap] - cuts[gap - 1] < around[2]:
                around = (other, gap, cuts[gap] - cuts[gap - 1])
        out.append((v, role_of(*(s[2] for s in spots)), around[0], around[1]))
    return out


def _beside(pages: DataFrame, sites: DataFrame, size: int, salt: F.Column) -> DataFrame:
    """``pages`` with their host's row of ``sites``, or nulls: by broadcast up to BROADCAST_BYTES, else joined with the pages of a host spread over SALTS parts."""
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(sites), "host", "left")
    copies = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(copies, ["host", "_salt"], "left").drop("_salt")


def valid_classes(tokens: DataFrame, sites: DataFrame, size: int) -> DataFrame:
    """(host, vectors): the valid classes of each host's template."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Site] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.host not in held:
                    held = {r.host: Site.of(r.known), **dict(list(held.items())[:15])}
                out += [(r.host, *place) for place in class_places(held[r.host], r.roles, r.firsts, r.lasts)]
            yield pd.DataFrame(out, columns=["host", "vector", "order", "around", "gap"])
        release()

    both = _beside(tokens.select("host", "digest", "roles", "firsts", "lasts"), sites, size, F.col("digest")).where("known is not null")
    places = both.mapInPandas(run, _CLASSES).groupBy("host", "vector")
    spot = F.struct("around", "gap")
    same = places.agg((F.min("order") == F.max("order")).alias("ordered"), (F.min(spot) == F.max(spot)).alias("nested"))
    return same.where("ordered and nested").groupBy("host").agg(F.collect_list("vector").alias("vectors"))


def deduce(tokens: DataFrame) -> DataFrame:
    """(host, article, texts): for each host with a template the role of the element with the article and the texts that are the template's own. Staged."""
    known = F.struct("role", "parent", "kind", "vector", "support", "total", "chars")
    sites = stage(occurrence_vectors(tokens).groupBy("host").agg(F.collect_list(known).alias("known")), "sites")
    size = 64 * (sites.agg(F.sum(F.size("known"))).first()[0] or 0)
    both = sites.join(valid_classes(tokens, sites, size), "host")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                site, valid = Site.of(r.known), set(r.vectors)
                kept = {role: t for role, t in site.tokens.items() if role == _ROOT or (site.vector[role] in valid and site.vector[role] in site.classes)}
                own = [role for role, t in kept.items() if t.kind & TEXT and t.parent in kept and site.vector[t.parent] == site.vector[role] and kept[t.parent].kind & CONTAINER]
                out.append((r.host, article_role(kept, site.single & set(kept)), own))
            yield pd.DataFrame(out, columns=["host", "article", "texts"])

    return stage(both.mapInPandas(run, "host string, article long, texts array<long>"), "templates")


def main_text(page: Page, article: int | None, texts: set[int]) -> tuple[str, bool]:
    """(text of the article, whether the template tells it). A page that lacks the element, or has no text there, is read by its own tree."""
    if article is not None:
        roots = {e for e, r in enumerate(page.role) if r == article and page.block[e] == e}
        if roots and article != _ROOT or article == _ROOT:
            left_out = {b for b, own in page.own_texts().items() if role_of(page.role[b], own) in texts} if texts else frozenset()
            if text := page.text_of(roots, left_out):
                return text, True
    tokens = tokens_of(page)
    role = article_role(tokens, {r for r, t in tokens.items() if t.count == 1})
    return page.text_of({e for e, r in enumerate(page.role) if r == role and page.block[e] == e}), False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, by_template) of every row: the main text of its html, and whether a template deduced from its host told it.

    A null or empty html has an empty text. Pages whose url is null or has no host form one host
    of their own. Rows that repeat a page are read one by one, and count once in the deduction, as do equal pages under other
    ids. Hosts of fewer than three different pages have no template; their pages are read by their own trees.
    Other columns of the input are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html)
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            none = [None] * len(pdf)
            got = [main_text(Page(h), None if pd.isna(a) else int(a), set() if t is None else set(t)) for h, a, t in zip(pdf["html"], pdf.get("article", none), pdf.get("texts", none), strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": [g[0] for g in got], "n_chars": [len(g[0]) for g in got], "by_template": [g[1] for g in got]})
        release()

    with passing(spark) as keep:
        tokens = stage(page_tokens(rows), "tokens").dropDuplicates(["host", "digest"])
        templates = keep(deduce(tokens))
    size = templates.agg(F.sum(F.size("texts") * 8 + 64)).first()[0] or 0
    both = _beside(rows, templates, size, F.xxhash64("html"))
    return both.select("page_id", "url", "html", "article", "texts").mapInPandas(run, "page_id long, url string, text string, n_chars long, by_template boolean")


def op11_html_templates(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

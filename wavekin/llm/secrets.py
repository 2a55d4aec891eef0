"""Secret scans: fixed patterns plus sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

# Fixed values of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings for the entropy method: runs of the base64 and URL-safe alphabets.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Bits per character that a window of a class must reach. A random window of 20
#: hexadecimal digits has 3.3 to 3.6 bits, one of base64 characters 3.9 to 4.3. Of those of
#: base32 and base36, letters of one case with digits, 98 and 99 in a hundred have 3.4.
THRESHOLDS = {"hex": 3.1, "base32": 3.4, "base36": 3.4, "base62": 3.75, "mixed": 3.85}
#: Alphabets of the classes, the first that fits counts; all else is mixed.
CLASSES = {"hex": r"^[0-9a-fA-F]+$", "base32": r"^(?:[A-Z2-7]+|[a-z2-7]+)$", "base36": r"^(?:[A-Z0-9]+|[a-z0-9]+)$", "base62": r"^[A-Za-z0-9]+$"}
#: Candidates never reported by entropy: words, numbers, joined words, UUIDs, documentation keys.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z]+([-_/+][A-Za-z]+)*[-_/+]?$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"EXAMPLE",
)

_HIT = "struct<start:int,kind:int,end:int,hit:string>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end, hit) of the pattern's leftmost non-overlapping matches, in code points.

    The gaps between matches come from ``split`` with the same pattern, so start
    positions are running sums of lengths. Sums run over blocks of as many matches as there are
    blocks, so the work on n matches grows as n * sqrt(n) at most. Texts without a match pay for one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))
    empty = F.array().cast(f"array<{_HIT}>")

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("hit")))
        return F.struct(end.alias("at"), (F.concat(acc["out"], F.when(keep(pair["hit"]), span).otherwise(empty)) if keep else F.concat(acc["out"], span)).alias("out"))

    def by_blocks(all_):
        side = F.ceil(F.sqrt(F.size(all_))).cast("int")
        part = lambda b: F.slice(all_, b * side + 1, side)
        count = F.ceil(F.size(all_) / side).cast("int")
        sizes = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.aggregate(part(b), F.lit(0), lambda acc, p: acc + F.length(p["gap"]) + F.length(p["hit"])))
        bases = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        walk = lambda base, b: F.aggregate(part(b), F.struct(base.alias("at"), empty.alias("out")), step)["out"]
        return _bound(bases, lambda held: F.flatten(F.transform(F.slice(held, 1, count), walk)))

    return F.when(text.rlike(pattern), _bound(pairs, by_blocks)).otherwise(empty)


def _weight(n: Column) -> Column:
    """n * log2(n), 0 for n <= 1."""
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _entropy_part(hit: Column) -> Column:
    """(first, last) of the windows of a candidate that reach their class's threshold; null if none.

    The counts of the window's characters are kept: a step changes those of the leaving and the
    entering character, and the sum of n*log2(n) with them.
    """
    return _bound(F.split(hit, ""), lambda chars: _bound(F.array_distinct(chars), lambda kinds: _hot_windows(hit, F.transform(chars, lambda c: F.array_position(kinds, c).cast("int")), kinds)))


def _hot_windows(hit: Column, numbered: Column, kinds: Column) -> Column:
    """``numbered``: the candidate's characters as places, from 1, in ``kinds``, its different characters."""
    limit = F.coalesce(*[F.when(hit.rlike(p), F.lit(THRESHOLDS[c])) for c, p in CLASSES.items()], F.lit(THRESHOLDS["mixed"]))
    bits = lambda s: F.lit(log2(WINDOW)) - s / WINDOW
    none = F.lit(None).cast("int")

    def run(chars):
        head = F.slice(chars, 1, WINDOW)
        counts = F.transform(kinds, lambda _, k: F.size(F.filter(head, lambda x: x == k + 1)))

        def step(acc, i):
            out, new = F.element_at(chars, i), F.element_at(chars, i + WINDOW)
            n_out, n_new = F.element_at(acc["counts"], out), F.element_at(acc["counts"], new)
            moved = out != new
            s = F.when(moved, acc["s"] - _weight(n_out) + _weight(n_out - 1) - _weight(n_new) + _weight(n_new + 1)).otherwise(acc["s"])
            kept = F.when(moved, F.transform(acc["counts"], lambda n, k: n - (k + 1 == out).cast("int") + (k + 1 == new).cast("int"))).otherwise(acc["counts"])
            hot = bits(s) >= acc["limit"]
            return F.struct(kept.alias("counts"), s.alias("s"), acc["limit"].alias("limit"), F.when(hot, F.coalesce(acc["first"], i)).otherwise(acc["first"]).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"))

        def from_head(held):
            total = F.aggregate(held, F.lit(0.0), lambda acc, n: acc + _weight(n))
            hot0 = F.when(bits(total) >= limit, F.lit(0)).otherwise(none)
            start = F.struct(held.alias("counts"), total.alias("s"), limit.alias("limit"), hot0.alias("first"), hot0.alias("last"))
            steps = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, start, step)

        return _bound(counts, from_head)

    return _bound(numbered, run)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Find secrets in every whole text.

    Returns (doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans). Spans are kind:start:end in code
    points, end exclusive, by start, then kind. The entropy method adds the part of a
    candidate string covered by windows over the threshold, unless the candidate is on
    the allow list or overlaps a pattern's match. A null text counts as empty: no spans.
    Rows are judged one by one, so repeated rows and ids give repeated results. Other
    columns of the input are ignored. An empty table gives no rows.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    value_long = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    rows = rows.select("doc_id", "_text", F.array_sort(F.concat(*[F.transform(s, bare) for s in (_spans(text, ASSIGN, 0, value_long), _spans(text, ACCESS, 1), _spans(text, HEX, 2))])).alias("_base"))

    allowed = lambda hit: F.array_contains(F.array(*[hit.rlike(p) for p in allow]), True) if allow else F.lit(False)
    candidates = _spans(text, CANDIDATE, 3, lambda hit: ~allowed(hit))
    scored = F.transform(candidates, lambda s: F.struct(s["start"].alias("at"), _entropy_part(s["hit"]).alias("w")))
    hot = F.filter(scored, lambda s: s["w"]["first"].isNotNull())
    spans = F.transform(hot, lambda s: F.struct((s["at"] + s["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (s["at"] + s["w"]["last"] + WINDOW).alias("end")))
    fresh = F.filter(spans, lambda s: ~F.exists(F.col("_base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.select("doc_id", "_base", F.when(F.size(F.col("_base")) >= 0, fresh).alias("_more"))

    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda arr: F.array_join(F.transform(arr, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    number = lambda arr, k: F.size(F.filter(arr, lambda s: s["kind"] == k)).cast("long")
    base = F.col("_base")
    return rows.select(
        "doc_id",
        number(base, 0).alias("n_assign"),
        number(base, 1).alias("n_access"),
        number(base, 2).alias("n_hex"),
        F.size("_more").cast("long").alias("n_entropy"),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat(base, F.col("_more")))).alias("spans"),
    )


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))

"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

A validated value is ranked within its format, the rank is split into a pair (a, b)
with a < A and b < B, and a keyed Feistel network permutes the pairs: each round adds
a keyed hash of one half to the other, modulo that half's size. A round can be undone,
so the whole is a permutation of the format's values: equal values get equal
pseudonyms in every document, different values different ones, and the result is a
valid value of the same format with the same separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty

ROUNDS = 8
KINDS = ("email", "ipv4", "date", "phone", "ssn", "card")

# Every pattern stands alone and is a part of the common alternation, in this order.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:(?:1[89]|2[01])[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.])(?:0[1-9]|[12][0-9]|3[01])\2(?:1[89]|2[01])[0-9]{2})(?![0-9]|[./-][0-9])"
#: Area and exchange of 200-999 in any layout, or any digits where the layout alone tells: +1, brackets, or two dashes or dots.
_ASSIGNABLE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
_LAID_OUT = r"(?<![0-9])(?<![0-9][.-])(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|(?:1[ .-])?(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}))(?![.-]?[0-9])"
PHONE = f"(?:{_ASSIGNABLE}|{_LAID_OUT})"
SSN = r"(?<![0-9-])(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])"
_DATES = "|".join(DATE.replace(r"([-/.])", sep).replace(r"\1", sep).replace(r"\2", sep) for sep in ("-", "/", r"\."))
#: A run of groups of digits up to where a value of another kind begins; ``_cards`` finds the cards in it.
CARD = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{EMAIL}|{IPV4}|{_DATES}|{PHONE}|{SSN})[0-9]++)*+"
#: Digits of each group of cards as they are usually printed.
LAYOUTS = r"^(?:4-4-4-4|4-4-4-4-3|4-6-5|4-6-4|4-3-3-3)$"
#: The date pattern has the only groups, so its back references hold here too.
ANY = "|".join((EMAIL, IPV4, DATE, PHONE, SSN, CARD))

#: Of the 146097 days of a whole Gregorian cycle of 400 years from the first day, 57600 = 240 * 240 lie in the first EARLY days of a month, the other 88497 = 9 * 9833 do not.
FIRST_DAY, EARLY = "1800-01-01", 12
EARLY_A, EARLY_B, LATE_A, LATE_B, MONTHS = 240, 240, 9, 9833, 4800


def feistel(a: Column, b: Column, size_a, size_b, key: str, tag: str) -> Column:
    """struct(a, b): the keyed permutation of pairs with a < size_a and b < size_b."""
    size_a, size_b = (s.cast("long") if isinstance(s, Column) else F.lit(s).cast("long") for s in (size_a, size_b))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(acc, i):
        digest = lambda half: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")
        left = F.pmod(acc["a"] + F.pmod(digest(acc["b"]), size_a), size_a)
        turned = F.struct(left.alias("a"), acc["b"].alias("b"))
        right = F.pmod(acc["b"] + F.pmod(digest(acc["a"]), size_b), size_b)
        return F.when(i % 2 == 0, turned).otherwise(F.struct(acc["a"].alias("a"), right.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _refill(hit: Column, digits: Column) -> Column:
    """The match with its digits replaced in order, all else in place."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc, ch):
        is_digit = ch.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["n"] + 1, F.lit(1))).otherwise(ch)).alias("out"), (acc["n"] + is_digit.cast("int")).alias("n"))

    return F.aggregate(F.split(hit, ""), start, step)["out"]


def _pad(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    from_right = F.reverse(F.split(digits, ""))
    value = lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.filter(from_right, lambda d: d != ""), lambda d, i: value(d.cast("int"), i)), F.lit(0), lambda x, y: x + y)


def _cards(run: Column) -> Column:
    """Array of (rank, less, at, n): the cards in a run, each the n groups of digits from group ``at`` on, none in two cards.

    Groups are a card if they have 13 to 19 digits, pass the Luhn check and are one unbroken number (rank 0), are
    printed in a usual layout (1), or are the most that 19 digits allow from their first group on (2). Of cards that
    overlap the lower rank goes first, then the one of more digits, then the earlier.
    """
    # bound to a variable, so the steps do not split the run again
    return F.transform(F.array(F.split(run, "[ -]")), _cards_of)[0]


def _cards_of(groups: Column) -> Column:
    def from_group(at):
        joined = lambda n: F.array_join(F.slice(groups, at + 1, n), "")
        some = F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - at)), lambda n: F.struct(n.alias("n"), joined(n).alias("digits")))
        fit = F.filter(some, lambda w: F.length(w["digits"]).between(13, 19))
        layout = lambda n: F.array_join(F.transform(F.slice(groups, at + 1, n), lambda g: F.length(g).cast("string")), "-")

        def judged(fit):
            rank = lambda w: F.when(w["n"] == 1, 0).when(layout(w["n"]).rlike(LAYOUTS), 1).when(w["n"] == F.array_max(F.transform(fit, lambda x: x["n"])), 2)
            good = F.filter(fit, lambda w: luhn_sum(w["digits"]) % 10 == 0)
            return F.filter(F.transform(good, lambda w: F.struct(rank(w).alias("rank"), (-F.length(w["digits"])).alias("less"), at.alias("at"), w["n"].alias("n"))), lambda c: c["rank"].isNotNull())

        return F.transform(F.array(fit), judged)[0]

    found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), from_group)))
    free = lambda acc, c: ~F.exists(acc, lambda x: (x["at"] < c["at"] + c["n"]) & (c["at"] < x["at"] + x["n"]))
    none = F.array().cast(_CARDS)
    return F.aggregate(found, none, lambda acc, c: F.when(free(acc, c), F.concat(acc, F.array(c))).otherwise(acc))


_CARDS = "array<struct<rank:int,less:int,at:int,n:int>>"


def _card_run(run: Column, cards: Column, key: str) -> Column:
    """The run with its cards replaced."""

    def walk(pieces):
        some = lambda at, n: F.array_join(F.slice(pieces, at + 1, n), "")
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda acc, c: F.struct(F.concat(acc["out"], some(acc["at"], c["at"] - acc["at"]), _card(some(c["at"], c["n"]), key)).alias("out"), (c["at"] + c["n"]).alias("at"))
        return F.aggregate(F.array_sort(cards, lambda x, y: x["at"] - y["at"]), start, step, lambda acc: F.concat(acc["out"], some(acc["at"], F.size(pieces) - acc["at"])))

    # every group with the separator behind it
    return F.transform(F.array(F.split(run, "(?<=[ -])")), walk)[0]


def _card(hit: Column, key: str) -> Column:
    """First digit kept, the middle permuted, the check digit recomputed."""
    digits = _digits(hit)
    n = F.length(digits)
    half = ((n - 2) / 2).cast("int")
    rest = n - 2 - half
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = feistel(F.substring(digits, F.lit(2), half).cast("long"), F.substring(digits, half + 2, rest).cast("long"), power(half), power(rest), key, "card")
    body = F.concat(F.substring(digits, 1, 1), _pad(out["a"], half), _pad(out["b"], rest))
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    return _refill(hit, F.concat(body, check.cast("string")))


def _phone(hit: Column, key: str) -> Column:
    """A country code 1 stays. Numbers whose area and exchange are both of 200-999 are permuted among themselves, all others likewise.

    The others' 360,000 pairs of area and exchange are ranked: areas under 200 with any
    exchange, then areas from 200 with exchanges under 200.
    """
    all_digits = _digits(hit)
    lead = F.substring(all_digits, F.lit(1), F.length(all_digits) - 10)
    d = F.substring(all_digits, F.length(all_digits) - 9, F.lit(10))
    area, exchange, line = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    out = feistel(area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000, key, "phone")
    b = out["b"]
    assignable = F.concat((out["a"] + 200).cast("string"), (F.floor(b / 10000) + 200).cast("string"), _pad(b % 10000, 4))
    rank = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    out = feistel(F.floor(rank / 600), rank % 600 * 10000 + line, 600, 6_000_000, key, "phone of any digits")
    new = out["a"] * 600 + F.floor(out["b"] / 10000)
    low, high = F.concat(_pad(F.floor(new / 1000), 3), _pad(new % 1000, 3)), F.concat(_pad(F.floor((new - 200_000) / 200) + 200, 3), _pad((new - 200_000) % 200, 3))
    other = F.concat(F.when(new < 200_000, low).otherwise(high), _pad(out["b"] % 10000, 4))
    return _refill(hit, F.concat(lead, F.when((area >= 200) & (exchange >= 200), assignable).otherwise(other)))


def _ssn(hit: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    d = _digits(hit)
    area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    out = feistel(area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new = out["a"] + 1
    b = out["b"]
    return _refill(hit, F.concat(_pad(new + (new >= 666).cast("long"), 3), _pad(F.floor(b / 9999) + 1, 2), _pad(b % 9999 + 1, 4)))


def _date_parts(hit: Column) -> tuple[Column, Column, Column]:
    """(date or null, year first, month before day) of a date match."""
    d = _digits(hit)
    iso = hit.rlike("^[0-9]{4}")
    date = lambda y, m, day: F.try_to_date(F.concat_ws("-", y, m, day))
    y_m_d = date(F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
    d_m_y = date(F.substring(d, 5, 4), F.substring(d, 3, 2), F.substring(d, 1, 2))
    m_d_y = date(F.substring(d, 5, 4), F.substring(d, 1, 2), F.substring(d, 3, 2))
    return F.when(iso, y_m_d).otherwise(F.coalesce(d_m_y, m_d_y)), iso, ~iso & d_m_y.isNull()


def _first_of(month: Column) -> Column:
    """First day of a month counted from the first day's."""
    return F.make_date((F.floor(month / 12) + 1800).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))


def _late_before(month: Column) -> Column:
    """Days after the EARLY ones in all months before this one."""
    return F.datediff(_first_of(month), F.lit(FIRST_DAY).cast("date")).cast("long") - EARLY * month


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def permuted_day(day: Column, key: str) -> Column:
    """The pseudonym of a day of the years 1800-2199, a permutation of these days in which the first 12 days of months stay among themselves."""

    def late_day(place: Column) -> Column:
        # months have 16 to 19 late days, evenly enough for a guess that is at most one off
        guess = F.least(F.floor(place * MONTHS / (LATE_A * LATE_B)), F.lit(MONTHS - 1))
        right = lambda g: F.filter(F.array(F.least(g + 1, F.lit(MONTHS - 1)), g, F.greatest(g - 1, F.lit(0))), lambda m: _late_before(m) <= place)[0]
        return _let(_let(guess, right), lambda m: F.date_add(_first_of(m), (place - _late_before(m) + EARLY).cast("int")))

    def moved(d: Column) -> Column:
        early = d["nth"] < EARLY
        rank = F.when(early, d["month"] * EARLY + d["nth"]).otherwise(_late_before(d["month"]) + d["nth"] - EARLY)
        sizes = F.when(early, F.lit(EARLY_A)).otherwise(F.lit(LATE_A)), F.when(early, F.lit(EARLY_B)).otherwise(F.lit(LATE_B))
        pair = _let(rank, lambda r: feistel(F.floor(r / sizes[1]), r % sizes[1], *sizes, key, "date"))
        place = _let(pair, lambda out: out["a"] * sizes[1] + out["b"])
        return _let(place, lambda x: F.when(early, F.date_add(_first_of(F.floor(x / EARLY)), (x % EARLY).cast("int"))).otherwise(late_day(x)))

    month = (F.year(day).cast("long") - 1800) * 12 + F.month(day) - 1
    return _let(F.struct(month.alias("month"), (F.dayofmonth(day).cast("long") - 1).alias("nth")), moved)


def _date(hit: Column, key: str) -> Column:
    """A day of the years 1800-2199; ambiguous dates are read day first.

    The order of day, month and year is kept. Only days after the 12th can be told to stand behind
    their month, and these are permuted among themselves, so a pseudonym reads as
    the value did: one day has one pseudonym in all orders, and two values never share one.
    """
    day, iso, month_first = _date_parts(hit)
    shown = lambda new: F.when(iso, F.date_format(new, "yyyyMMdd")).when(month_first, F.date_format(new, "MMddyyyy")).otherwise(F.date_format(new, "ddMMyyyy"))
    return _refill(hit, _let(permuted_day(day, key), shown))


def _ipv4(hit: Column, key: str) -> Column:
    part = lambda i: F.split_part(hit, F.lit("."), F.lit(i)).cast("long")
    out = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ipv4")
    octets = [F.floor(out[h] / 256) if hi else out[h] % 256 for h in ("a", "b") for hi in (True, False)]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def _email(hit: Column, key: str) -> Column:
    """Addresses have no ranked format: a keyed 12-digit name at a reserved domain, permuted likewise."""
    seed = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(hit)), 256), 1, 14), 16, 10).cast("long")
    out = feistel(F.floor(seed / 1_000_000) % 1_000_000, seed % 1_000_000, 1_000_000, 1_000_000, key, "email")
    return F.concat(F.lit("user"), _pad(out["a"], 6), _pad(out["b"], 6), F.lit("@example.invalid"))


def _kind(hit: Column) -> Column:
    """Index into KINDS of a match, or null for a match that validation refuses. A run of digits may still hold no card."""
    digits = F.length(_digits(hit))
    whole = lambda p: hit.rlike(f"^(?:{p})$")
    return (
        F.when(hit.contains("@"), F.lit(0))
        .when(whole(IPV4), F.lit(1))
        .when(whole(DATE), F.when(_date_parts(hit)[0].isNotNull(), F.lit(2)))
        .when(whole(PHONE), F.lit(3))
        .when(whole(SSN), F.lit(4))
        .when(hit.rlike("^[0-9 -]+$") & (digits >= 13), F.lit(5))
    )


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal data in every whole text by keyed pseudonyms of the same format.

    Returns (doc_id, n_email, n_ipv4, n_date, n_phone, n_ssn, n_card, text). Card numbers must pass the
    Luhn check, dates must exist, social security numbers must be assignable, and so must
    phone numbers unless +1, brackets or two dashes or dots mark them; other digit strings stay. A null text stays null with no findings, an empty one
    empty. Rows are treated one by one, so repeated rows give repeated results. Only the id and the text are read, other
    columns may have any names. An empty table gives no rows.
    """
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    hits = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    kinds = F.transform(hits, lambda h: F.struct(h.alias("hit"), _kind(h).alias("kind")))
    kinds = F.transform(kinds, lambda h: F.struct(h["hit"].alias("hit"), h["kind"].alias("kind"), F.when(h["kind"] == 5, _cards(h["hit"])).alias("cards")))
    none = F.array().cast(f"array<struct<hit:string,kind:int,cards:{_CARDS}>>")
    # every pattern needs a digit or an @, which is cheaper to look for
    found = text.rlike("[0-9@]") & text.rlike(ANY)
    rows = rows.select("doc_id", "_text", F.when(found, kinds).otherwise(none).alias("_hits"))

    def replace(h):
        hit, kind = h["hit"], h["kind"]
        out = F.when(kind.isNull(), hit)
        for n, f in enumerate((_email, _ipv4, _date, _phone, _ssn)):
            out = out.when(kind == n, f(hit, key))
        return out.otherwise(_card_run(hit, h["cards"], key))

    gaps = F.split(text, ANY, -1)
    new = F.concat(F.transform(F.col("_hits"), replace), F.array(F.lit("")))
    clean = F.array_join(F.zip_with(gaps, new, lambda g, h: F.concat(g, h)), "")
    def number(k):
        if KINDS[k] == "card":
            return F.aggregate("_hits", F.lit(0).cast("long"), lambda acc, h: acc + F.when(h["kind"] == k, F.size(h["cards"])).otherwise(0))
        return F.size(F.filter(F.col("_hits"), lambda h: h["kind"] == k)).cast("long")

    return rows.select("doc_id", *[number(n).alias(f"n_{k}") for n, k in enumerate(KINDS)], F.when(F.size("_hits") > 0, clean).otherwise(text).alias("text"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), key="op9 demonstration key")

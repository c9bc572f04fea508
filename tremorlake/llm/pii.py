"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only DataFrame functions are used; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Account numbers' length by country, from the public registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"

# Kinds in their order, with patterns. Each starts where the plain pattern could start
# first (at the end of the last match, or where no longer match begins further left) and takes its
# runs whole, so that a search is linear in the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: A character without which a text has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
# Score of a kind before its context, and words that raise it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact|write)\b",
    "ip": r"\b(ip|host|server|address|login|logged)\b",
    "card": r"\b(card|visa|mastercard|amex|credit|debit|pay|payment)\b",
    "phone": r"\b(phone|tel|telephone|call|mobile|fax|whatsapp|contact)\b",
    "iban": r"\b(iban|bank|account|transfer|konto)\b",
}
LOWERS = {"email": None, "ip": r"\b(version|release|section|chapter)\b", "card": r"\b(isbn|order|tracking|serial)\b", "phone": None, "iban": None}
CONTEXT_CHARS = 40
CONTEXT_STEP = 0.2
#: Least score of a span that is redacted.
MIN_SCORE = 0.4
#: Values of a block of running sums, and characters of a piece of a text.
BLOCK = 256
PIECE = 1024

SPAN = "struct<start:int,ord:int,kind:string,stop:int,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 by 97, its first four characters moved to the end."""
    moved = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")

    def step(r: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (r * 100 + v - 55) % 97).otherwise((r * 10 + v - 48) % 97)

    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & F.coalesce(F.concat(F.lit("0"), plain(p)).try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    return F.lit(True)


def before_each(values: Column, add: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value what the values before it add up to, in blocks of ``BLOCK`` values: the sum of each block,
    the sums before the blocks, then the values of each block, so that the work is linear in the array."""
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int"))
    of = lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    whole = F.transform(blocks, lambda b: F.aggregate(of(b), zero, add))

    def scan(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    starts = scan(whole, zero)
    return F.when(F.size(values) <= BLOCK, scan(values, zero)).otherwise(F.flatten(F.zip_with(blocks, starts, lambda b, start: scan(of(b), start))))


def _spans(found: Column, between: Column, kind: str) -> Column:
    """Spans of the valid matches ``found``: their places follow from the lengths of what lies between."""
    order = list(PATTERNS).index(kind)
    steps = F.zip_with(between, found, lambda gap, m: F.length(gap) + F.length(m))
    pairs = F.zip_with(F.zip_with(found, between, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"))), before_each(steps, lambda a, b: a + b, F.lit(0)), lambda x, at: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), (at + F.length(x["gap"])).alias("start")))

    def span(x: Column) -> Column:
        before = F.lower(F.right(x["gap"], F.lit(CONTEXT_CHARS)))
        score = F.lit(SCORES[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_STEP).otherwise(0.0)
        if LOWERS[kind]:
            score = score - F.when(before.rlike(LOWERS[kind]), CONTEXT_STEP).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["m"])).alias("stop"), F.least(score, F.lit(1.0)).alias("score"))

    return F.when(F.size(found) > 0, F.transform(F.filter(pairs, lambda x: _valid(kind, x["m"])), span)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(df: DataFrame, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``df`` with the array of all confirmed spans, sorted by start and then kind; a span has its kind,
    its start and stop in code points (stop exclusive) and its score.

    Matches are leftmost and do not overlap within a kind; those that fail their check are dropped
    and not retried: octets over 255, cards of other than 14 to 19 digits or against Luhn, phones
    of other than 10 to 15 digits, account numbers against mod 97. Words of up to 40 characters
    before a span, back to the last match of its kind, raise or lower its score by 0.2. Null and empty texts have no spans. All rows
    and columns stay; columns that begin with ``_pii_`` or bear the name ``out`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cols = [c for c in df.columns if c != out and not c.startswith("_pii_")]
    row = df.select(*cols)
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
        row = row.withColumn(f"_pii_{kind}", found)
    for kind, pattern in PATTERNS.items():
        m = F.col(f"_pii_{kind}")
        gaps = F.split(text, pattern, -1)  # one more than matches
        row = row.withColumn(f"_pii_{kind}_gaps", F.when(F.size(m) > 0, gaps).otherwise(F.array().cast("array<string>")))
    for kind in PATTERNS:
        gaps = F.col(f"_pii_{kind}_gaps")
        row = row.withColumn(f"_pii_{kind}_gaps", F.slice(gaps, F.lit(1), F.size(f"_pii_{kind}")))
    for kind in PATTERNS:
        row = row.withColumn(f"_pii_{kind}_spans", _spans(F.col(f"_pii_{kind}"), F.col(f"_pii_{kind}_gaps"), kind))
    return row.select(*cols, F.array_sort(F.concat(*(F.col(f"_pii_{k}_spans") for k in PATTERNS))).alias(out))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, counts by kind, the spans as text, their SHA-256 for the base kinds, and
    the highest score. Null and empty texts have no spans, the hash of the empty string and the score 0; repeated
    rows give repeated rows, an empty table none; other columns are not read."""
    src = with_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "spans")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return src.select(
        F.col("id").alias(id_col),
        *(of(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(said(base), 256).alias("base_sha256"),
        said("spans").alias("spans"),
        of("iban").alias("n_iban"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


def redact(df: DataFrame, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``df`` with each stretch covered by spans replaced by its first kind in brackets; null texts stay null.
    Spans whose context lowers their score below ``min_score`` stay as they are, such as version numbers
    that look like addresses. Columns keep their order; other columns are carried along, but for those that
    begin with ``_pii_``; repeated rows give repeated rows, an empty table none."""
    row = with_spans(df, text_col, "_pii_all")
    text = F.col(text_col)
    spans = F.filter("_pii_all", lambda s: s["score"] >= min_score)
    row = row.withColumn("_pii_all", spans)
    # the text in pieces of equal length: a stretch is read from its pieces, not from the text's start
    pieces = F.when(F.size("_pii_all") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    ends = before_each(F.transform("_pii_all", lambda s: s["stop"]), lambda a, b: F.greatest(a, b), F.lit(0))  # how far spans reach before each
    row = row.select("*", pieces.alias("_pii_pieces"), ends.alias("_pii_ends"), F.length(text).alias("_pii_length"))

    def stretch(a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        some = F.slice("_pii_pieces", first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * PIECE + 1, b - a)).otherwise("")

    marked = F.zip_with("_pii_all", "_pii_ends", lambda s, at: F.when(s["start"] >= at, F.concat(stretch(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
    last = F.greatest(F.element_at("_pii_ends", -1), F.element_at("_pii_all", -1)["stop"])
    clean = F.concat(F.array_join(marked, ""), stretch(last, F.col("_pii_length")))
    return row.select(*(F.when(F.size("_pii_all") > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(c) for c in df.columns if not c.startswith("_pii_")))

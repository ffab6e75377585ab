"""Secret scans with DataFrame functions only.

Three kinds follow fixed patterns.  A fourth, ``entropy``, slides a window over each character class's tokens inside candidate strings
and keeps the candidates where one token reaches the entropy limit of its class, whatever stands around it.  The sum of c * log2(c)
over a window's counts changes by two terms per character; tokens are read in blocks, up to the first window over the limit, and those with too few different characters not at all.
An allow-list suppresses tokens that are known to be harmless.  A match's place comes from the lengths of what lies between matches, so positions are characters, ends exclusive.

Patterns never try a text in two ways (their repeated groups are possessive), and running sums are taken in two levels, so the work of a text follows its length.

Defined results: a null text counts as empty and has no span; ties of start are ordered by kind as listed; repeated rows are scanned
each for itself; a null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the three base kinds and the lengths they need (of group 2, or of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LENGTH = 8
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
WINDOW = 20
#: Windows that are read before the limit is looked at; numbers that are summed before the sums are.
BLOCK, PART = 64, 256
#: Entropy in bits per character that a window of a class has to reach; log2(20) = 4.32 is the most a window can have.
CLASS_LIMITS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.8}
#: The tokens of each class inside a candidate.  Hex digits may stand in groups; base64 and paths look alike, so its token is the candidate.
TOKENS = (
    ("hex", r"[0-9a-f]{4,}+(?:[-_][0-9a-f]{4,}+)*+"),
    ("hex", r"[0-9A-F]{4,}+(?:[-_][0-9A-F]{4,}+)*+"),
    ("alphanumeric", rf"[A-Za-z0-9]{{{WINDOW},}}"),
    ("base64", rf"[A-Za-z0-9+/_-]{{{WINDOW},}}"),
)
#: Candidates and tokens that match one of these are no secrets: identifiers in groups, one repeated character, words joined, keys of manuals.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.)\1++$",
    r"^[-_/+]*+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[-_/+]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+[-_/+]*+$",
    r"[A-Za-z0-9]EXAMPLE(KEY)?$",
)
#: Parts of a candidate that are taken out before its tokens are read: identifiers in groups, and words that stand for a value.  What
#: stands beside them is judged for itself.
TAKEN_OUT = (
    r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",
    r"(?i)(?<![a-z0-9])[a-z0-9]*(example|sample|placeholder|changeme)[a-z0-9]*",
)


def let(expr: Column, use: Callable[[Column], Column]) -> Column:
    """``use(expr)`` with ``expr`` evaluated once."""
    return F.get(F.transform(F.array(expr), use), F.lit(0))


def sums_before(numbers: Column) -> Column:
    """The sum of all earlier numbers, for each of ``numbers``: inside parts of PART, then over the parts."""
    start = F.array(F.lit(0).cast("long"))
    running = lambda part: F.aggregate(part, start, lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))

    def of_parts(parts: Column) -> Column:
        totals = running(F.transform(parts, lambda p: F.element_at(p, -1)))
        moved = F.zip_with(parts, F.slice(totals, 1, F.size(parts)), lambda p, t: F.transform(F.slice(p, 1, F.size(p) - 1), lambda n: n + t))
        return F.flatten(moved)

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(PART)), lambda i: running(F.slice(all_, i + 1, PART)))
    return let(numbers, lambda all_: let(cut(all_), of_parts))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost matches of ``pattern`` that don't overlap."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs: Column) -> Column:
        before = sums_before(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"])))

        def span(pair: Column, at: Column) -> Column:
            begin = (at + F.length(pair["gap"])).cast("int")
            return F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + F.length(pair["value"])).alias("end"), pair["value"].alias("value"))

        return F.zip_with(pairs, before, span)

    pairs = let(values, lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))))
    return let(pairs, placed)


def reaches(value: Column, limit: Column, window: int = WINDOW) -> Column:
    """Whether the Shannon entropy (bits per character) of any ``window`` characters in a row of ``value`` is ``limit`` or more.

    The entropy of a window is log2(window) - s / window with s = sum of c * log2(c) over the counts c of its characters; one character in
    and one out change two terms of s.  Windows are read in blocks of BLOCK, until one reaches the limit.
    """
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    count = lambda codes, x: F.size(F.filter(codes, lambda y: y == x))
    full = F.log2(F.lit(float(window)))

    def in_block(codes: Column, first: Column) -> Column:
        # before the first window: s of its characters, each adding what its count grows by
        begun = F.aggregate(
            F.sequence(F.lit(1), F.lit(window)), F.lit(0.0),
            lambda s, j: let(count(F.slice(codes, first, j), F.element_at(codes, first + j - 1)), lambda c: s + term(c) - term(c - 1)),
        )
        start = F.struct(begun.alias("s"), begun.alias("least"))

        def step(state: Column, at: Column) -> Column:
            # the window from ``at``: the one before it loses its first character, and gains one
            kept, out, new = F.slice(codes, at, window - 1), F.element_at(codes, at - 1), F.element_at(codes, at + window - 1)
            lost = count(kept, out)
            gained = count(kept, new)
            s = state["s"] - term(lost + 1) + term(lost) + term(gained + 1) - term(gained)
            return let(s, lambda s: F.struct(s.alias("s"), F.least(s, state["least"]).alias("least")))

        last = F.least(first + (BLOCK - 1), F.size(codes) - (window - 1))
        others = F.filter(F.sequence(first, last), lambda i: i > first)
        return full - F.aggregate(others, start, step, lambda s: s["least"]) / window

    def in_codes(codes: Column) -> Column:
        enough = (F.size(codes) >= window) & (F.log2(F.size(F.array_distinct(codes)).cast("double")) >= limit)
        blocks = F.sequence(F.lit(1), F.greatest(F.size(codes) - (window - 1), F.lit(1)), F.lit(BLOCK))
        return F.when(enough, F.exists(blocks, lambda first: in_block(codes, first) >= limit)).otherwise(F.lit(False))

    return let(F.transform(F.split(value, ""), F.ascii), in_codes)


def harmless(value: Column) -> Column:
    return value.rlike("|".join(f"(?:{a})" for a in ALLOWED))


def tokens(value: Column) -> Column:
    """array<struct<value, limit>>: the tokens of each class in a candidate, hex groups without what joins them."""
    rest = value
    for part in TAKEN_OUT:
        rest = F.regexp_replace(rest, part, "/")
    found = []
    for kind, pattern in TOKENS:
        each = F.filter(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)), lambda t: ~harmless(t))
        if kind == "hex":  # groups of digits or of letters alone are numbers and words
            each = F.filter(each, lambda t: ~t.rlike("[-_]") | t.rlike("(?i)[0-9][a-f]|[a-f][0-9]"))
            each = F.transform(each, lambda t: F.translate(t, "-_", ""))
        found.append(F.transform(each, lambda t: F.struct(t.alias("value"), F.lit(CLASS_LIMITS[kind]).alias("limit"))))
    return F.filter(F.concat(*found), lambda t: F.length(t["value"]) >= WINDOW)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found): array<struct<start, kind, end>> of all spans, ordered by start, then kind (numbers as in ``KINDS``)."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    text = F.col("text")
    given = lambda test, spans: F.when(test, spans).otherwise(none)
    assign = given(text.rlike(r"(?i)passw|secret|token|api_?key"), F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LENGTH))
    access = given(text.contains("AKIA"), spans_of(text, ACCESS, 1))
    digits = given(text.rlike(HEX), spans_of(text, HEX, 2))
    secret = lambda v: F.exists(tokens(v), lambda t: reaches(t["value"], t["limit"]))
    entropy = given(text.rlike(CANDIDATE), F.filter(F.filter(spans_of(text, CANDIDATE, 3), lambda s: ~harmless(s["value"])), lambda s: secret(s["value"])))
    found = F.array_sort(F.transform(F.concat(assign, access, digits, entropy), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", found.alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as text, one row per document."""
    found = F.col("found")
    of_kind = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    return scan(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(listed(F.filter(found, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        listed(found).alias("spans"),
        of_kind(3).alias("n_entropy"),
    )

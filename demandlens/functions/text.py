"""Text and number helpers that give the same answer as the ECMAScript built-ins the rules were written against."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# the ECMAScript whitespace class; Java's \s stops at ASCII, and listing the code points one by one is three times slower
WHITESPACE = r"[\s\x0B\p{Z}\uFEFF]"
# a run of whitespace, but for a single space, which stays as it is
WHITESPACE_RUN = f" ?(?! ){WHITESPACE}{WHITESPACE}*|  {WHITESPACE}*"
TOKEN_BREAK = r"(?i)[^a-z0-9\u0B80-\u0BFF\u0900-\u097F]+"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def norm(c: Column) -> Column:
    """Lower-case, collapse whitespace runs, trim.  NULL becomes ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), WHITESPACE_RUN, " "))


def computed_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """``withColumn`` whose result is really a column from here on.

    The optimizer pushes filters below a projection by copying its expressions into them; with several filters on a regex result
    the regex would run once for each.  A one-element generator is not copied.
    """
    return df.withColumn(name, F.explode(F.array(expr)))


def let(expr: Column, use) -> Column:
    """``use(expr)`` with ``expr`` evaluated once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(expr), use), F.lit(0))


def filled(sentence: str, value: Column | None) -> Column:
    """``sentence`` with ``value`` in the place of its {}."""
    before, _, after = sentence.partition("{}")
    return F.lit(sentence) if value is None else F.concat(F.lit(before), value, F.lit(after))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITESPACE}+|{WHITESPACE}+\\z", "")


def tokens(c: Column) -> Column:
    """Runs of Latin letters, digits, Tamil or Devanagari."""
    return F.filter(F.split(c, TOKEN_BREAK), lambda t: t != "")


def word_pattern(alternation: str, ignore_case: bool = False) -> str:
    r"""``\b(...)\b`` with an ASCII notion of a word character, which Java's Unicode ``\b`` is not.

    ``\b`` inside the alternation is rewritten as well.  Where all words of the alternation begin with a letter, places that begin with none of
    these are passed over at once.
    """
    body = alternation.replace(r"\b", f"(?:(?<=[A-Za-z0-9_]){WORD_END}|{WORD_START}(?=[A-Za-z0-9_]))")
    return ("(?i)" if ignore_case else "") + f"{_first_letters(alternation)}{WORD_START}(?:{body}){WORD_END}"


def _first_letters(alternation: str) -> str:
    """A look-ahead for the letters that the words of an alternation begin with; '' if one may begin with something else."""
    words, depth = [""], 0
    for c in alternation:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            words.append("")
        else:
            words[-1] += c
    plain = all(re.match(r"[a-z](?![?*{])", w) for w in words)
    return f"(?=[{''.join(sorted({w[0] for w in words}))}])" if plain else ""


ASCII_BOUNDARY = f"(?:(?<=[A-Za-z0-9_]){WORD_END}|{WORD_START}(?=[A-Za-z0-9_]))"


def any_word_pattern(words: list[str]) -> str:
    """Any of the literal words between word boundaries, whatever characters they start and end with; ignores case."""
    return f"(?i){ASCII_BOUNDARY}(?:{quote_words(words)}){ASCII_BOUNDARY}"


def quote_words(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def js_round(c: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(c + F.lit(0.5))


def to_fixed(c: Column, places: int) -> Column:
    """Round to ``places`` decimals by the exact binary value, halves away from zero.

    ``round`` goes by the shortest decimal text: it makes 1.58 of the double next below 1.575.  Here the error of ``x * 2 * 10^places`` is
    computed exactly (splitting the factor), and decides when the product looks like a half.
    """
    unit = float(10**places)

    def exact(x: Column) -> Column:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        low = x - high
        product = x * F.lit(2 * unit)
        error = (high * F.lit(2 * unit) - product) + low * F.lit(2 * unit)
        just_below = (F.floor(product) == product) & (F.pmod(product, F.lit(2.0)) == 1) & (error < 0)
        return (F.floor((product + 1) / 2) - F.when(just_below, 1).otherwise(0)) / F.lit(unit)

    return let(F.abs(c), exact) * F.signum(c)


def js_number(c: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def uri_component(c: Column) -> Column:
    """Percent-encode everything but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.url_encode(c)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def csv_safe(c: Column) -> Column:
    """Disarm a cell that a spreadsheet would run as a formula; ``+91 98`` stays as it is."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^(=|@|[+-][^0-9\s(])"), F.concat(F.lit("'"), text)).otherwise(text)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))

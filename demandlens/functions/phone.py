"""Phone normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens.functions import text


def norm_phone(raw: Column, cc: str = "91") -> Column:
    """``struct(wa, type)``: digits with the country code and mobile / landline / unknown / invalid."""
    written = F.coalesce(raw, F.lit(""))
    return text.let(F.regexp_replace(written, "[^0-9]", ""), lambda digits: _classify(digits, written.rlike(r"^\s*\+"), cc))


def _classify(digits: Column, plus: Column, cc: str) -> Column:
    after_00 = F.substr(digits, F.lit(3))

    def result(wa, kind):
        wa = wa if isinstance(wa, Column) else F.lit(wa)
        kind = kind if isinstance(kind, Column) else F.lit(kind)
        return F.struct(wa.alias("wa"), kind.alias("type"))

    def by_first_digit(national):
        return F.when(national.rlike("^[6-9]"), "mobile").otherwise("landline")

    invalid = result("", "invalid")

    def with_country(d):
        if cc != "91":
            return result(d, "unknown")
        national = F.substr(d, F.lit(3))
        return F.when(F.length(national) != 10, invalid).otherwise(result(d, by_first_digit(national)))

    if cc == "91":
        national = F.when(digits.startswith("91") & (F.length(digits) == 12), F.substr(digits, F.lit(3))).otherwise(
            F.regexp_replace(digits, "^0+", "")
        )
        local = F.when(F.length(national) != 10, invalid).otherwise(
            result(F.concat(F.lit("91"), national), by_first_digit(national))
        )
        international_00 = F.when(after_00.startswith(cc), with_country(after_00)).otherwise(result(after_00, "unknown"))
    else:
        local = result(
            F.when(digits.startswith(cc), digits).otherwise(F.concat(F.lit(cc), F.regexp_replace(digits, "^0+", ""))),
            "unknown",
        )
        international_00 = with_country(after_00)
    return (
        F.when(digits == "", invalid)
        .when(digits.startswith("00"), international_00)
        .when(plus & digits.startswith(cc), with_country(digits))
        .when(plus, result(digits, "unknown"))
        .otherwise(local)
    )

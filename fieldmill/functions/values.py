"""Comparing field values: emptiness, numbers in free text, day-first dates, and their cascade."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, let, normalize_string, strip

# Signs that go from numbers, the shape of dates, tolerances.
CURRENCY = "[€$£¥%]"
DATE = r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}$"
TOLERANCE, FUZZY = 0.001, 0.96
_FLOAT = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def is_empty(c: Column) -> Column:
    """Null, blank, or the exact words null and None."""
    return F.coalesce(strip(c).isin("", "null", "None"), F.lit(True))


def looks_like_date(c: Column) -> Column:
    return F.coalesce(ascii_digits(strip(c)).rlike(DATE), F.lit(False))


def looks_like_number(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), r"(?U)[€$£¥%\s\x1c-\x1f]", "")
    return F.coalesce(ascii_digits(bare).rlike(r"^-?[0-9.,]+$"), F.lit(False))


def _decimal_point(c: Column) -> Column:
    """Decides which of comma and point is the decimal sign: the later one; a lone comma with at
    most two digits behind it; a point otherwise."""
    comma, point = F.contains(c, F.lit(",")), F.contains(c, F.lit("."))
    last_comma, last_point = F.instr(F.reverse(c), ","), F.instr(F.reverse(c), ".")
    commas = F.length(c) - F.length(F.replace(c, F.lit(","), F.lit("")))
    to_point = F.replace(c, F.lit(","), F.lit("."))
    without = F.replace(c, F.lit(","), F.lit(""))
    both = F.when(last_comma < last_point, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(without)
    alone = F.when((commas == 1) & (last_comma <= 3), to_point).otherwise(without)
    return F.when(comma & point, both).when(comma, alone).otherwise(c)


def extract_number(c: Column) -> Column:
    """The number that a text tells, null if none: currency signs and blanks go, the decimal sign is
    found, and what then isn't a number as a whole gives its first run of digits."""

    def read(plain: Column) -> Column:
        lower = F.lower(plain)
        whole = F.when(plain.rlike(_FLOAT), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))
        special = F.when(lower.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(lower.rlike(r"^\+?(inf|infinity)$"), F.lit(float("inf"))).when(lower.rlike(r"^-(inf|infinity)$"), F.lit(float("-inf")))
        part = F.nullif(F.regexp_extract(plain, r"(-?[0-9]+\.?[0-9]*)", 1), F.lit(""))
        return F.coalesce(whole, special, part.try_cast("double"))

    bare = strip(F.regexp_replace(strip(ascii_digits(c)), CURRENCY, ""))
    return let(let(F.regexp_replace(bare, r"[ \u00a0]", ""), _decimal_point), read)


def near(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether two numbers are equal, or nearer than tolerance relative to a (absolutely where a is 0)."""
    close = F.when(a == b, True).when(a != 0, F.abs(a - b) / F.abs(F.nullif(a, F.lit(0.0))) < tolerance).otherwise(F.abs(b) < tolerance)
    return F.coalesce(close & ~(F.isnan(a) | F.isnan(b)), F.lit(False))


def numbers_match(gt: Column, pred: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether the numbers that two texts tell are near."""
    return let(F.struct(extract_number(gt).alias("a"), extract_number(pred).alias("b")), lambda x: near(x["a"], x["b"], tolerance))


def parse_date(c: Column) -> Column:
    """struct(day, month, year) of a day-first date at the front of a text, null if none. Years of
    two digits below 50 are of the 2000s; a four-digit year out of 1900..2100 is read as two digits."""

    def read(parts: Column) -> Column:
        day, month, digits = (F.get(parts, F.lit(i)) for i in range(3))

        def with_year(year: Column) -> Column:
            return F.struct(day.cast("int").alias("day"), month.cast("int").alias("month"), F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year).alias("year"))

        def fitting(d: Column) -> Column:
            return F.when(d["day"].between(1, 31) & d["month"].between(1, 12) & d["year"].between(1900, 2100), d)

        whole = F.when(F.length(digits) == 4, let(with_year(digits.cast("int")), fitting))
        return F.coalesce(whole, let(with_year(F.substring(digits, 1, 2).cast("int")), fitting))

    front = F.regexp_extract(ascii_digits(strip(c)), r"^[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.](?:[0-9]{4}|[0-9]{2})", 0)
    return let(front, lambda t: F.when(t != "", let(F.split(t, r"[/\-.]"), read)))


def dates_match(gt: Column, pred: Column) -> Column:
    return F.coalesce(parse_date(gt) == parse_date(pred), F.lit(False))


def verdict(matched: bool | Column, kind: str) -> Column:
    return F.struct((matched if isinstance(matched, Column) else F.lit(matched)).alias("matched"), F.lit(kind).alias("match_type"))


def cascade(x: Column) -> Column:
    """struct(matched, match_type) of two values: empty, date, number, exact, normalized, fuzzy. A
    failed date or number test decides nothing.

    x is a struct of their texts a and b (null for missing), their numbers an and bn (only for values
    that are no strings), same (whether their normal forms are equal) and likeness (null: too unlike).
    """
    a, b, strings = x["a"], x["b"], x["an"].isNull() & x["bn"].isNull()
    numeric = x["an"].isNotNull() | x["bn"].isNotNull() | looks_like_number(a) | looks_like_number(b)
    return (
        F.when(is_empty(a) & is_empty(b), verdict(True, "normalized"))
        .when(is_empty(a) | is_empty(b), verdict(False, "mismatch"))
        .when((looks_like_date(a) | looks_like_date(b)) & dates_match(a, b), verdict(True, "date"))
        .when(numeric & let(F.struct(F.coalesce(x["an"], extract_number(a)).alias("a"), F.coalesce(x["bn"], extract_number(b)).alias("b")), lambda n: near(n["a"], n["b"])), verdict(True, "numeric"))
        .when(strings & (strip(a) == strip(b)), verdict(True, "exact"))
        .when(F.coalesce(x["same"], F.lit(False)), verdict(True, "normalized"))
        .when(x["likeness"] >= FUZZY, verdict(True, "fuzzy"))
        .otherwise(verdict(False, "mismatch"))
    )


def compare_texts(gt: Column, pred: Column, similarity: Column | None = None) -> Column:
    """The cascade's struct(matched, match_type) of two texts, null being missing; fuzzy matches only
    where a similarity is given."""
    none = F.lit(None).cast("double")
    likeness = none if similarity is None else similarity
    return let(F.struct(gt.alias("a"), pred.alias("b"), none.alias("an"), none.alias("bn"), (normalize_string(gt) == normalize_string(pred)).alias("same"), likeness.alias("likeness")), cascade)


def legacy_value(c: Column) -> Column:
    """The older normal form of a value: stripped, lower case, without currency signs and blanks."""
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)[€$£¥\s\x1c-\x1f]", "")

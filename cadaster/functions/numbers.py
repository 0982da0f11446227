"""Number, date and period parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadaster.functions.text import let


def french(value: Column) -> Column:
    """Two digits at most, a comma before them, spaces between thousands, trailing noughts trimmed."""
    # whole cents below a million, as most amounts are, need no decimal arithmetic
    c = F.when((value >= 0) & (value < 1_000_000), F.rint(value * 100).cast("int"))
    units, rest = F.floor(c / 100).cast("int"), c % 100
    grouped = F.when(units < 1000, units.cast("string")).otherwise(F.concat_ws(" ", F.floor(units / 1000).cast("int").cast("string"), F.substring((units % 1000 + 1000).cast("string"), 2, 3)))
    digits = F.rtrim(F.substring((rest + 100).cast("string"), 2, 2), F.lit("0"))
    # the other way is behind let(), so that a row's code stays small enough to be compiled
    return F.when(c / 100 == value, F.when(rest == 0, grouped).otherwise(F.concat_ws(",", grouped, digits))).otherwise(let(value, _french))


def _french(value: Column) -> Column:
    rounded = F.round(value, 2)
    whole = F.abs(rounded - F.round(rounded)) < 1e-9
    plain = F.translate(F.format_number(F.round(rounded).cast("long"), 0), ",", " ")
    text = F.translate(F.format_number(rounded, 2), ",.", " ,")
    return F.when(whole, plain).otherwise(F.regexp_replace(text, "0$", ""))


SPACES = "[\\s\u00a0\u202f]"


def amount(text: Column) -> Column:
    """A report's number: spaces, euro and percent signs, a comma for the point."""
    return F.translate(F.regexp_replace(text, "[\\s\u00a0\u202f€%]", ""), ",", ".").try_cast("double")


def plain_amount(text: Column) -> Column:
    """A number with spaces but no comma decimals."""
    return F.regexp_replace(text, SPACES, "").try_cast("double")


def signed_amount(text: Column) -> Column:
    """A statement's number, in brackets if negative; null for what is no number."""
    t = F.regexp_replace(F.regexp_replace(text, SPACES, ""), "[€$£%]", "")
    n = F.translate(F.regexp_replace(t, "[()]", ""), ",", ".").try_cast("double")
    return F.when(F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")), -n).otherwise(n)


def statement_amount(text: Column) -> Column:
    """The number that a cell of a statement is: groups of digits, one decimal mark, in brackets if negative; null for all else, an amount with its currency too."""
    # most cells are words: what does not begin as a number is not looked at further
    starts = F.rlike(text, F.lit(rf"^{SPACES}*\(?-?\d"))
    return F.when(starts, let(F.trim(F.regexp_replace(text, f"{SPACES}+", " ")), _statement_number))


def _statement_number(t: Column) -> Column:
    n = F.translate(F.translate(t, "() ", ""), ",", ".").try_cast("double")
    return F.when(F.rlike(t, F.lit(r"^\(?-?\d[\d ]*([.,]\d+)?\)?$")), F.when(F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")), -n).otherwise(n))


def priced(text: Column) -> Column:
    """A price in a text: the later of comma and point is the decimal mark; one alone is, if two digits at most follow."""
    t = F.regexp_replace(F.regexp_extract(text, r"\d[\d\s\u00a0\u202f.,]*", 0), r"[^\d.,]", "")
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    comma_last = F.rlike(t, F.lit(r",[^.]*$"))
    one = lambda mark: F.rlike(t, F.lit(rf"^[^{mark}]*[{mark}]\d{{0,2}}$"))
    clean = (
        F.when(both & comma_last, F.translate(F.regexp_replace(t, r"\.", ""), ",", "."))
        .when(both, F.regexp_replace(t, ",", ""))
        .when(F.contains(t, F.lit(",")), F.when(one(","), F.translate(t, ",", ".")).otherwise(F.regexp_replace(t, ",", "")))
        .when(F.contains(t, F.lit(".")), F.when(one("."), t).otherwise(F.regexp_replace(t, r"\.", "")))
        .otherwise(t)
    )
    return clean.try_cast("double")


def amounts(text: Column, decimals: bool = True) -> Column:
    """(before, value, after) of each number of a text: what stands between it and the number before, and between it and the next.

    Digits may stand in groups; decimals: whether a comma or point and more digits belong to a number.
    """
    number = r"\d[\d\s\u00a0\u202f]*" + (r"(?:[.,]\d+)?" if decimals else "")
    between = F.split(text, number)
    value = lambda x: F.translate(F.regexp_replace(x, SPACES, ""), ",", ".").try_cast("double")
    return F.transform(F.regexp_extract_all(text, F.lit(f"({number})"), 1), lambda x, i: F.struct(F.get(between, i).alias("before"), value(x).alias("value"), F.get(between, i + 1).alias("after")))


def spaced(value: Column) -> Column:
    """Spaces between thousands, two digits at most, trailing noughts trimmed."""
    text = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
    return F.translate(text, ",", " ")


def day(text: Column) -> Column:
    """An ISO or d/m/y date at the start of a text."""
    head = F.substring(text, 1, 10)
    return F.to_date(F.coalesce(F.try_to_timestamp(F.when(F.rlike(head, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$")), head), F.lit("yyyy-M-d")), F.try_to_timestamp(F.when(F.rlike(head, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")), head), F.lit("d/M/yyyy"))))


def days_in(text: Column) -> Column:
    """All dd/mm/yy or dd-mm-yyyy dates of a text, two-digit years from 70 on being of the last century."""
    found = F.regexp_extract_all(text, F.lit(r"\b(\d{2}[/-]\d{2}[/-]\d{2,4})\b"), 1)

    def one(d):
        parts = F.split(d, "[/-]")
        y = F.get(parts, 2).cast("int")
        year = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.get(parts, 1), F.get(parts, 0)), F.lit("yyyy-MM-dd")))

    return F.array_compact(F.transform(found, one))


def birth(text: Column) -> Column:
    """(day, month) of a birth date given as a day or only a month, ISO or French."""
    t = F.trim(text)
    iso = F.regexp_replace(F.regexp_replace(t, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1"), r"^(\d{2})/(\d{4})$", "$2-$1")
    full = F.rlike(iso, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    return F.struct(F.when(full, iso).alias("day"), F.when(full | F.rlike(iso, F.lit(r"^\d{4}-\d{2}$")), F.substring(iso, 1, 7)).alias("month"))


def latest_year(name: Column, path: Column) -> Column:
    """The largest year in a file's name, else in its path."""
    years = lambda t: F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"\b(19\d{2}|20\d{2}|21\d{2})\b"), 1), lambda y: y.cast("int")))
    return F.coalesce(years(name), years(path))


def suspicious(value: Column) -> Column:
    """Ten digits or more before the point."""
    return F.coalesce(F.abs(value) >= 1_000_000_000, F.lit(False))


def half_up(value: Column, digits: int = 2) -> Column:
    """Rounded half up on the double as it is, as any SQL engine does it with floor()."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def cents(value: Column) -> Column:
    """An amount in whole cents, so that sums and medians are exact whatever the order of rows."""
    return F.floor(value * 100 + 0.5).cast("long")


def mean(value: Column) -> Column:
    """Mean of amounts, to the cent."""
    return F.floor(F.sum(cents(value)) / F.count(value) + 0.5) / 100


def median(value: Column) -> Column:
    """Median of amounts (the mean of the middle two), to the cent."""
    return F.floor(F.percentile(cents(value), 0.5) + 0.5) / 100

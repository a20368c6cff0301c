"""Scalar expressions with the rounding, parsing and text rules of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQUARE_METRES_PER_ACRE = 4046.86


def round_even(x: Column, digits: int) -> Column:
    """Round half to even on the scaled double, as array libraries do."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def round_up(x: Column, digits: int) -> Column:
    """Round half up, as browsers do."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def truncate(x: Column) -> Column:
    """Toward zero, as an integer cast does."""
    return x.cast("long")


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def number_or_null(text: Column) -> Column:
    """A numeric text as double; null, blank and other texts as null."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def normalise_address(address: Column) -> Column:
    """Upper case; only A-Z, 0-9 and blanks; trimmed; inner blanks stay."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(address, F.lit(""))), "[^A-Z0-9 ]", ""))


def parse_price(price: Column, strict: bool = False) -> Column:
    """Digits and points of a price as double, null if there are none.

    ``strict`` raises on texts such as 1.2.3; otherwise they give null.
    """
    digits = F.nullif(F.regexp_replace(F.coalesce(price, F.lit("")), "[^0-9.]", ""), F.lit(""))
    return digits.cast("double") if strict else digits.try_cast("double")


def year_of(date_text: Column) -> Column:
    """The first four characters of a date."""
    return F.substring(date_text.cast("string"), 1, 4)


def tile_name(lat: Column, lon: Column) -> Column:
    """Name of the one-degree tile whose south-west corner is (lat, lon)."""
    return F.format_string("n%02dw%03d", (lat + 1).cast("int"), F.abs(lon).cast("int"))


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing in [0, 360) from east and north offsets."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def acres(square_metres: Column) -> Column:
    return square_metres / SQUARE_METRES_PER_ACRE


def feet(metres: Column) -> Column:
    return metres * 3.28084


def snap_down(x: Column, step: float) -> Column:
    return F.floor(x / step) * step


def snap_up(x: Column, step: float) -> Column:
    return F.ceil(x / step) * step


def clamp_index(x: Column, n: int | Column) -> Column:
    """Floor of ``x`` within [0, n - 2]: the lower cell of an interpolation."""
    top = (n if isinstance(n, Column) else F.lit(n)) - 2
    return F.greatest(F.lit(0), F.least(top, F.floor(x))).cast("int")


def money(x: Column) -> Column:
    return F.when(x.isNull() | (x == 0), F.lit("-")).otherwise(F.concat(F.lit("$"), F.format_number(round_up(x, 0), 0)))


def metres_label(x: Column) -> Column:
    return F.when(x <= 15, F.lit("waterfront")).otherwise(F.concat(round_up(x, 0).cast("long").cast("string"), F.lit(" m")))


def acres_label(x: Column) -> Column:
    """Null for null, as for the labels below."""
    return F.concat(F.when(x < 10, F.format_string("%.2f", x)).when(x >= 10, F.format_string("%.1f", x)), F.lit(" ac"))


def minutes_label(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.format_string("%.1f", x), F.lit(" min")))


def millisteradians_label(x: Column) -> Column:
    """Three significant digits of thousandths."""
    v = x * 1000
    digits = F.greatest(F.lit(0), F.lit(2) - F.floor(F.log10(F.abs(v)))).cast("int")
    choices = F.coalesce(*[F.when(digits == d, F.format_string(f"%.{d}f", v)) for d in range(12)])
    return F.concat(F.when(v == 0, F.lit("0.00")).otherwise(choices), F.lit(" msr"))

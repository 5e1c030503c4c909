"""Typed columns out of text feeds. A value that does not parse becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from millrace.functions import codes


def to_int(text: Column) -> Column:
    """Whole number; a fraction is rounded half away from zero ('12.5' -> 13)."""
    return F.coalesce(text.try_cast("int"), F.round(text.try_cast("decimal(38,6)")).try_cast("int"))


def to_decimal(text: Column, precision: int, scale: int) -> Column:
    return text.try_cast(f"decimal({precision},{scale})")


def to_number(text: Column) -> Column:
    """A number type without precision keeps no fraction."""
    return to_decimal(text, 38, 0)


def to_date(text: Column) -> Column:
    # The cast alone would also take '2024' or '2024-1-5'; with the shape checked it beats a format parser.
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), text.try_cast("date"))


def to_timestamp(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def day_of(text: Column) -> Column:
    """The date in the first ten characters of an ISO date-time text."""
    return to_date(F.left(text, F.lit(10)))


def padded_key(prefix: str, number: Column, width: int, cut_keys: bool = False) -> Column:
    """Prefix and zero-padded number. Longer numbers stay whole; ``cut_keys`` cuts them to ``width``, so keys may clash."""
    to = F.lit(width) if cut_keys else F.greatest(F.lit(width), F.length(number))
    return F.concat(F.lit(prefix), F.lpad(number, to, F.lit("0")))


def sku_key(item_number: Column, cut_keys: bool = False) -> Column:
    return padded_key(codes.SKU, item_number, 5, cut_keys)


def number_key(prefix: str, source_id: Column, width: int, cut_keys: bool = False) -> Column:
    """Prefix and the number that ends a source id, without its leading zeros but at least ``width`` digits.

    An id without such a number stays whole. ``cut_keys`` takes the last ``width`` characters instead.
    """
    if cut_keys:
        return prefixed(prefix, F.right(source_id, F.lit(width)))
    number = F.ltrim(F.regexp_extract(source_id, "[0-9]+$", 0), F.lit("0"))
    return padded_key(prefix, F.coalesce(F.nullif(number, F.lit("")), source_id), width)


def prefixed(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value)


def order_customer_key(account: Column) -> Column:
    return prefixed(codes.CUSTOMER, F.replace(account, F.lit(codes.ORDER_ACCOUNT_PREFIX), F.lit("")))


def crm_customer_key(account: Column) -> Column:
    number = F.replace(account, F.lit(codes.CRM_ACCOUNT_PREFIX), F.lit(codes.CRM_CUSTOMER_PREFIX))
    return prefixed(codes.CUSTOMER, number)


def map_code(code: Column, table: Mapping[str, str], default: Column | str | None = None) -> Column:
    """Look a code up in a short fixed table. ``default`` is a constant, a column, or NULL when left out."""
    out = None
    for key, value in table.items():
        hit = code == key
        out = F.when(hit, value) if out is None else out.when(hit, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def title_case(text: Column) -> Column:
    """First letter of every word in upper case; punctuation starts a word as well as a space does."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{codes.WORD_BREAKS}]+|[^{codes.WORD_BREAKS}]+"), F.lit(0))
    words = F.transform(pieces, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, 2, 2**30))))
    plain_words = ~text.rlike("[^A-Za-z0-9 ]")
    return F.when(plain_words, F.initcap(text)).otherwise(F.array_join(words, ""))


def strip_suffix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def month_period(text: Column) -> Column:
    """'APR-2025' -> '2025-04'; NULL for an unknown month."""
    month = map_code(F.left(text, F.lit(3)), codes.MONTH)
    return F.concat(F.right(text, F.lit(4)), F.lit("-"), month)


def brand_of(manufacturer: Column) -> Column:
    """Brand by the first name rule that hits, else the first word of the manufacturer."""
    out = None
    for needle, brand in codes.BRAND_RULES:
        hit = manufacturer.ilike(f"%{needle}%")
        out = F.when(hit, brand) if out is None else out.when(hit, brand)
    return out.otherwise(F.split_part(manufacturer, F.lit(" "), F.lit(1)))


def pounds(weight: Column, unit: Column) -> Column:
    value = to_decimal(weight, 8, 2)
    in_pounds = F.when(unit == "KG", value * F.lit(codes.KG_TO_LBS).cast("decimal(6,5)")).otherwise(value)
    return in_pounds.cast("decimal(14,7)")

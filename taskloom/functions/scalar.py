"""Scalar functions: sizes, units, bit sets, enumerations."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.schema import DRIVER

# Units of sizes and times.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
TIME_UNITS = ("ns", "us", "ms", "s")


def parse_size(text: Column) -> Column:
    """A struct (amount, unit, status) of sizes like 1024, 2GB, 64 k or 50%.

    Units are powers of 1024, percents are cut to integers; status is ok, format, range or overflow.
    """
    t = F.ltrim(text)
    percent = F.regexp_extract(t, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)?\s*%", 1)
    is_percent = F.contains(t, F.lit("%"))
    p_ok = F.regexp_like(t, F.lit(r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)?\s*%"))
    p = F.when(percent == "", F.lit("0")).otherwise(percent).try_cast("double")
    digits = F.regexp_extract(t, r"^(\d*)", 1)
    unit = F.upper(F.regexp_extract(t, r"^\d*\s*([KMGTBkmgtb]?)", 1))
    a_ok = F.regexp_like(t, F.lit(r"^\d*\s*$")) | F.regexp_like(t, F.lit(r"^\d*\s*[KMGTBkmgtb]([Bb]?$|[Bb]\s|\s)"))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    factor = F.pow(F.lit(1024.0), power).cast("decimal(20,0)")
    amount = F.when(digits == "", F.lit("0")).otherwise(digits).try_cast("decimal(38,0)")
    fits = amount.isNotNull() & (amount <= F.floor(F.lit("18446744073709551615").cast("decimal(20,0)") / factor))
    status = F.when(t.isNull() | (t == ""), "format").when(is_percent, F.when(~p_ok, "format").when((p < 0) | (p > 100), "range").otherwise("ok")).when(~a_ok, "format").when(~fits, "overflow").otherwise("ok")
    value = F.when(status == "ok", F.when(is_percent, F.floor(p).cast("decimal(38,0)")).otherwise((amount * factor).cast("decimal(38,0)")))
    return F.struct(value.alias("amount"), F.when(status == "ok", F.when(is_percent, "relative").otherwise("absolute")).alias("unit"), status.alias("status"))


def size_of(amount: Column, unit: Column, capacity: Column) -> Column:
    """Bytes of a parsed size: percents are of the capacity."""
    return F.when(unit == "relative", F.floor(capacity * amount / 100)).otherwise(amount)


def _format(x: Column, step: int, units: tuple[str, ...], after: str) -> Column:
    """Two decimals of the binary value, divided once a unit, half to even: as C's ``%.2f`` writes it."""
    size, out = x.cast("double"), None
    for unit in units:
        text = F.concat(F.call_function("format_number", size, F.lit("0.00")), F.lit(f"{unit}{after}"))
        small = size < step
        out = F.when(small, text) if out is None else out.when(small, text) if unit != units[-1] else out.otherwise(text)
        size = size / float(step)
    return out


def format_bytes(x: Column, units: tuple[str, ...] = BYTE_UNITS) -> Column:
    return _format(x, 1024, units, "")


def format_time(ns: Column) -> Column:
    return _format(ns, 1000, TIME_UNITS, "")


def format_bandwidth(x: Column, units: tuple[str, ...] = BYTE_UNITS) -> Column:
    return _format(x, 1024, units, "/s")


def parse_drivers(df: DataFrame, text: str) -> DataFrame:
    """Rows (name, threads, driver) of lists like ``cuda,2;host,4``; driver is its number, null if unknown."""
    part = df.select(*[c for c in df.columns if c != text], F.explode(F.split(text, ";")).alias("_p")).where("_p <> ''")
    name = F.trim(F.split_part("_p", F.lit(","), F.lit(1)))
    rest = [c for c in df.columns if c != text]
    return part.select(*rest, name.alias("name"), F.split_part("_p", F.lit(","), F.lit(2)).cast("int").alias("threads"), driver_id(name).alias("driver"))


def driver_id(name: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for n, i in DRIVER.items()))
    return F.try_element_at(names, F.upper(name))


def driver_name(number: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(i), F.lit(n.lower())) for n, i in DRIVER.items()))
    return F.try_element_at(names, number)


def mode_name(mode: Column) -> Column:
    return F.when(mode == 4, "V").when(mode == 1, "R").when(mode == 2, "W").when(mode == 3, "RW")


def tiles(n: Column, t: Column) -> Column:
    return F.floor((n + t - 1) / t)


def popcount(mask: Column) -> Column:
    return F.bit_count(mask)


def first_set(mask: Column) -> Column:
    """1 + the lowest bit that is set, 0 for none."""
    return F.when(mask == 0, 0).otherwise(F.bit_count(mask.bitwiseAND(-mask) - 1) + 1)


def next_power_of_two(v: Column) -> Column:
    """The least power of 2 at or above v."""
    v = v.cast("long")
    bits = F.length(F.bin(v - 1))
    return F.when(v <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def buddy_order(size: Column, least: int = 256) -> Column:
    """How many times the least block is doubled to hold a size."""
    p = next_power_of_two(F.greatest(size.cast("long"), F.lit(least)))
    return (F.length(F.bin(p)) - 1 - (least.bit_length() - 1)).cast("int")


def page_floor(x: Column, page: int) -> Column:
    return x - F.pmod(x, F.lit(page))


def page_ceil(x: Column, page: int) -> Column:
    return x + F.pmod(F.lit(page) - F.pmod(x, F.lit(page)), F.lit(page))

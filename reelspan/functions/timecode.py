"""Clock strings of media offsets as Column functions; the engine's unit is the whole millisecond."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros to ``width``; longer numbers stay whole (``lpad`` alone would cut them)."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def strict_ms(ts: Column) -> Column:
    """The strict reading: 1 to 3 whole fields, milliseconds after a dot or as the last three digits of a long last field.

    Seconds and minutes of 60 and more carry over. Null is an error: no text, more than three fields, fields that are no whole
    numbers, negative values, a comma for the dot. Milliseconds that are no number count as 0.
    """
    t = F.replace(F.regexp_replace(ts, r"^\s+|\s+$", ""), F.lit(" "), F.lit(""))
    dotted = F.contains(t, F.lit("."))
    last = F.regexp_extract(t, r":([^:]*)$", 1)
    long_last = ~dotted & F.rlike(last, F.lit("^[0-9]{3,}$"))
    short = F.regexp_replace(t, r"[0-9]{3}$", "")
    main = F.when(dotted, F.regexp_replace(t, r"\.[^.]*$", "")).when(long_last, F.regexp_replace(short, ":$", "")).otherwise(t)
    ms_text = F.when(dotted, F.rpad(F.regexp_extract(t, r"\.([^.]*)$", 1), 3, "0")).when(long_last, F.right(last, F.lit(3)))
    ms = F.coalesce(F.round(ms_text.try_cast("double")), F.lit(0.0))
    fields = F.split(main, ":")
    n = F.size(fields)
    number = lambda i: F.when(F.rlike(F.get(fields, i), F.lit("^[+-]?[0-9]+$")), F.get(fields, i).try_cast("int")).cast("long")
    none = F.lit(0).cast("long")
    h = F.when(n == 3, number(F.lit(0))).otherwise(none)
    m = F.when(n == 3, number(F.lit(1))).when(n == 2, number(F.lit(0))).otherwise(none)
    s = F.when((n == 1) & (main == ""), none).when(n <= 3, number(n - 1))
    m1 = F.when(s >= 60, m + F.floor(s / 60)).otherwise(m)
    s1 = F.when(s >= 60, s % 60).otherwise(s)
    h1 = F.when(m1 >= 60, h + F.floor(m1 / 60)).otherwise(h)
    m2 = F.when(m1 >= 60, m1 % 60).otherwise(m1)
    good = (t != "") & (n <= 3) & (h1 >= 0) & (m2 >= 0) & (s1 >= 0) & (ms < 1000)
    return F.when(good, ((h1 * 3600 + m2 * 60 + s1) * 1000 + ms).cast("long"))


def _leading_number(field: Column) -> Column:
    return F.regexp_extract(field, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def lenient_ms(ts: Column) -> Column:
    """The lenient reading: three or two fields, else the whole text, each by its leading number; null if one has none."""
    fields = F.split(ts, ":")
    part = lambda i: _leading_number(F.get(fields, F.lit(i)))
    seconds = F.when(F.size(fields) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(fields) == 2, part(0) * 60 + part(1)).otherwise(_leading_number(ts))
    return F.round(seconds * 1000).cast("long")


def clock(ms: Column) -> Column:
    """[HH:]MM:SS.mmm, hours only if there are any; null for negative times."""
    whole = F.floor(ms / 1000)
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    tail = F.concat(padded(m, 2), F.lit(":"), padded(s, 2), F.lit("."), padded(ms % 1000, 3))
    return F.when(ms >= 0, F.when(h > 0, F.concat(padded(h, 2), F.lit(":"), tail)).otherwise(tail))


def minutes_clock(ms: Column) -> Column:
    """MM:SS.mmm with as many minutes as there are; null for negative times."""
    whole = F.floor(ms / 1000)
    return F.when(ms >= 0, F.concat(padded(F.floor(whole / 60), 2), F.lit(":"), padded(whole % 60, 2), F.lit("."), padded(ms % 1000, 3)))


def subtitle_clock(ts: Column, separator: str) -> Column:
    """HH:MM:SS and milliseconds after ``separator``, from the text of a clock: fields are padded, not carried."""
    split = F.split(ts, "[.,]")
    base, ms = F.get(split, F.lit(0)), F.get(split, F.lit(1))
    ms = F.rpad(F.when(ms.isNull() | (ms == ""), F.lit("000")).otherwise(ms), 3, "0")
    fields = F.split(base, ":")
    n = F.size(fields)
    at = lambda back: padded(F.get(fields, n - back), 2)
    h = F.when(n >= 3, at(3)).otherwise("00")
    m = F.when(n >= 2, at(2)).otherwise("00")
    return F.concat(h, F.lit(":"), m, F.lit(":"), at(1), F.lit(separator), ms)

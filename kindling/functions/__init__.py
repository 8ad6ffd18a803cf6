"""Column functions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(text: Column) -> Column:
    """Lower-case text cut at what is no letter or digit of any script; the first and last part may be empty."""
    return F.split(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script; null text has none."""
    return F.array_remove(parts(text), "")


def spaced(text: Column) -> Column:
    """The :func:`tokens` as one text, a space between them and perhaps at its ends."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", " ")


def per(part: Column, whole: Column) -> Column:
    """``part`` / ``whole``; null where ``whole`` is 0."""
    return part.cast("double") / F.nullif(whole, F.lit(0))


def id_list(ids: Column) -> Column:
    """An array as text, comma-joined: nested results in a flat column."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def micros(ts: Column) -> Column:
    """A timestamp without zone as microseconds since 1970, whatever the session's time zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

"""Text expressions: rename patterns, shutter and focal texts, metadata keys, prefix rewrites."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def rename(pattern: str, name: Column, index: Column, taken: Column, details: dict[str, Column]) -> Column:
    """A file name by a pattern of ``{yyyy} {mm} {dd} {index:n} {orig} {ext}`` and the named details; missing values are empty."""
    base, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    fields = {"yyyy": F.date_format(taken, "yyyy"), "mm": F.date_format(taken, "MM"), "dd": F.date_format(taken, "dd"), "orig": base, "ext": ext}
    fields |= {k: v.cast("string") for k, v in details.items()}
    parts = []
    for text, key, width in re.findall(r"([^{]+)|\{(\w+)(?::(\d+))?\}", pattern):
        if text:
            parts.append(F.lit(text))
        elif key == "index":
            n = index.cast("string")
            parts.append(F.when(F.length(n) >= int(width or 1), n).otherwise(F.lpad(n, int(width or 1), "0")))
        else:
            parts.append(F.coalesce(fields.get(key, F.lit("")), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def shutter_seconds(text: Column) -> Column:
    """Seconds of ``1/250``, ``0.5`` or ``2s``; null for other texts."""
    t = F.regexp_replace(F.trim(text), r"\s*s(ec)?$", "")
    top, bottom = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)", 1), F.regexp_extract(t, r"^\d+(?:\.\d+)?\s*/\s*(\d+(?:\.\d+)?)$", 1)
    whole = F.when(t.rlike(r"^\d+(\.\d+)?$"), F.expr("1.0D"))
    return F.when(bottom != "", F.try_divide(top.try_cast("double"), bottom.try_cast("double"))).otherwise(F.when(whole.isNotNull(), t.try_cast("double")))


def focal_range(text: Column) -> Column:
    """``low, high`` of ``24-70mm`` or ``50 mm``; null for other texts."""
    p = r"^\s*(\d+(?:\.\d+)?)(?:\s*-\s*(\d+(?:\.\d+)?))?\s*mm\s*$"
    low, high = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)
    return F.when(text.rlike(p), F.struct(low.cast("double").alias("low"), F.when(high != "", high).otherwise(low).cast("double").alias("high")))


def folded_key(key: Column) -> Column:
    """A metadata key without case and without anything but letters and digits."""
    return F.regexp_replace(F.lower(key), "[^a-z0-9]", "")


def first_present(doc: Column, keys: Sequence[str]) -> Column:
    """The first of several keys of a map that holds more than white space."""
    found = [F.when(F.trim(doc[k]) != "", doc[k]) for k in keys]
    return F.coalesce(*found)


def to_boolean(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "on", "1"), True).when(t.isin("false", "no", "off", "0"), False)


def replace_prefix(path: Column, old: str, new: str) -> Column:
    """Paths below a folder moved to another; the folder itself too, names that only begin alike not."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when((path == old) | F.startswith(path, F.lit(old + "/")), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)

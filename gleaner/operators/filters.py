"""Predicates and pages over item tables. All are Column expressions or plain joins, so filters reach the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def live(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not softly deleted."""
    return df.where(F.col(deleted).isNull())


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob of ``*``, ``?`` and ``[...]``; other characters stand for themselves."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def name_matches(name: Column, query: str) -> Column:
    """A glob where the query has one of ``* ? [``, else a contained text; both without regard to case."""
    if re.search(r"[*?\[]", query):
        return F.lower(name).rlike(glob_regex(query.lower()))
    return F.contains(F.lower(name), F.lit(query.lower()))


def contains_literal(name: Column, query: str) -> Column:
    """LIKE with the query's own wildcards escaped."""
    escaped = re.sub(r"([\\%_])", r"\\\1", query)
    return name.ilike(f"%{escaped}%")


def between(value: Column, low=None, high=None) -> Column:
    """A closed range with either end open; no bound at all accepts what is not null."""
    cond = value.isNotNull()
    if low is not None:
        cond &= value >= low
    if high is not None:
        cond &= value <= high
    return cond


def half_open(value: Column, start=None, stop=None) -> Column:
    """``start <= value < stop`` with either end open."""
    cond = F.lit(True)
    if start is not None:
        cond &= value >= F.lit(start)
    if stop is not None:
        cond &= value < F.lit(stop)
    return cond


def in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is null or is not among ``keys`` (a NOT IN that keeps null keys and ignores a null in the list)."""
    return df.join(keys.select(on), on, "left_anti")


def at_month(ts: Column, month: int) -> Column:
    return F.month(ts) == month


def at_hour(ts: Column, hour: int) -> Column:
    return F.hour(ts) == hour


def json_contains(doc: Column, path: str, query: str) -> Column:
    """The value at a JSON path has the text in it, without regard to case."""
    return F.contains(F.lower(F.get_json_object(doc, path)), F.lit(query.lower()))


def equals_any(df: DataFrame, values: dict[str, str], allowed: Sequence[str]) -> DataFrame:
    """Rows where every named column has its value; only ``allowed`` columns may be named."""
    for name, value in values.items():
        if name not in allowed:
            raise ValueError(f"{name} is not a filter column")
        df = df.where(F.col(name) == value)
    return df


def trusted(origin: Column, confirmed: Column, confidence: Column, least: float = 0.55) -> Column:
    """A link counts if it was set by hand, confirmed, or sure enough."""
    return (origin == "manual") | confirmed | (confidence >= least)


def raw_format(fmt: Column, name: Column, formats: Iterable[str]) -> Column:
    """A raw format by its name or by the file's suffix."""
    formats = sorted(f.lower() for f in formats)
    return F.lower(fmt).isin(formats) | F.lower(name).rlike(rf"\.({'|'.join(formats)})$")


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page; ``order`` must end in a key, so that pages do not overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def after(df: DataFrame, value: str, key: str, last_value, last_key, limit: int) -> DataFrame:
    """The next rows of a listing by (value, key) downwards, one more than a page so that its end shows."""
    ahead = (F.col(value) < F.lit(last_value)) | ((F.col(value) == F.lit(last_value)) & (F.col(key) < last_key))
    return df.where(ahead).orderBy(F.desc(value), F.desc(key)).limit(limit + 1)


def count_up_to(df: DataFrame, limit: int) -> DataFrame:
    """How many rows there are, counting no further than ``limit``: tasks stop at the limit."""
    return df.limit(limit).agg(F.count("*").alias("n"))


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows that look random and are the same each time: the lowest seeded MD5 of their keys."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def not_shown(df: DataFrame, shown: DataFrame, on: str, limit: int, order: Sequence[Column]) -> DataFrame:
    """The next page of a frozen ranking, without rows that earlier pages had."""
    return df.join(shown.select(on), on, "left_anti").orderBy(*order).limit(limit)

"""Smart collections: stored rules compiled to conditions over items and their tags."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.operators.filters import between, raw_format

# The raw formats that "raw" means, and the words that stored rules use.
RAW_FORMATS = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "orf", "rw2", "raf", "pef", "rwl", "3fr", "raw")
SAME_DAY_LAST_YEAR, LAST_7_DAYS, LAST_30_DAYS, THIS_YEAR = "去年今日", "最近7天", "最近30天", "今年"
EQUALS, CONTAINS, ANY, ALL, RANGE = "等于", "包含", "包含任一", "包含全部", "范围"
TEXTS = {"cameraModel": "camera", "lensModel": "lens"}
NUMBERS = {"focalLength": "focal", "aperture": "aperture", "iso": "iso"}


def preset_range(preset: str, now: datetime) -> tuple[datetime, datetime] | None:
    """First and last moment of a preset, both inclusive; None for one that is not known. All but the day of last year end now."""
    if preset == SAME_DAY_LAST_YEAR:
        # 29 February of a year without one is 1 March
        day = datetime(now.year - 1, now.month, 1) + timedelta(days=now.day - 1)
        return day, day + timedelta(days=1) - timedelta(milliseconds=1)
    if preset in (LAST_7_DAYS, LAST_30_DAYS):
        return now - timedelta(days=7 if preset == LAST_7_DAYS else 30), now
    return (datetime(now.year, 1, 1), now) if preset == THIS_YEAR else None


def problems(rules: str | dict) -> list[str]:
    """What is wrong with a rule document as a whole; empty if it can be evaluated. A rule of unknown type is no fault: it matches nothing."""
    try:
        doc = json.loads(rules) if isinstance(rules, str) else rules
    except ValueError:
        return ["not JSON"]
    if not isinstance(doc, dict) or not isinstance(doc.get("rules"), list):
        return ["rules must be a list"]
    return []


def condition(rule: dict, now: datetime) -> Column:
    """The condition of one rule, other than of tags, on ``taken_at, camera, lens, focal, aperture, iso, format, name``."""
    kind, nothing = rule.get("type"), F.lit(False)
    if kind == "dateRange":
        ms = F.unix_millis(F.col("taken_at").cast("timestamp"))
        if (known := preset_range(rule.get("preset"), now)) is not None:
            first, last = (F.unix_millis(F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")) for t in known)
            return between(ms, first, last)
        if "dateFrom" in rule or "dateTo" in rule:
            end = F.lit(rule["dateTo"]) if "dateTo" in rule else F.unix_millis(F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp"))
            return between(ms, F.lit(rule.get("dateFrom", 0)), end)
        return nothing
    if kind in TEXTS:
        text, value = F.col(TEXTS[kind]), rule["value"]
        return text == value if rule.get("operator") == EQUALS else text.ilike("%" + value.replace("\\", "\\\\") + "%")
    if kind in NUMBERS:
        number, value = F.col(NUMBERS[kind]), rule["value"]
        if rule.get("operator") == ">=":
            return number >= value
        return number <= value if rule.get("operator") == "<=" else between(number, value, rule.get("max", value))
    if kind == "fileFormat":
        fmt, name, value = F.coalesce("format", F.lit("")), F.coalesce("name", F.lit("")), rule["value"]
        if value.lower() == "raw":
            return raw_format(fmt, name, RAW_FORMATS)
        return (fmt == value) | F.endswith(F.lower(name), F.lit("." + value.lower()))
    return nothing


def evaluate(items: DataFrame, links: DataFrame, tags: DataFrame, rules: str | dict, now: datetime) -> DataFrame:
    """Items for which every rule holds. ``links``: ``item, tag``; ``tags``: ``tag, name``. Raises on an unsound document; no rules match nothing.

    A tags rule for all counts only the tags that exist: unknown names are dropped; if none is left, nothing matches. A null value matches no rule.
    """
    if found := problems(rules):
        raise ValueError("; ".join(found))
    listed = (json.loads(rules) if isinstance(rules, str) else rules)["rules"]
    cond = F.lit(bool(listed))
    for r in listed:
        if r.get("type") != "tags":
            cond &= condition(r, now)
    out = items.where(cond)
    for r in (r for r in listed if r.get("type") == "tags"):
        wanted = tags.where(F.col("name").isin(list(r["value"]))).select("tag").distinct()
        hit = links.join(wanted, "tag").groupBy("item").agg(F.count_distinct("tag").alias("got"))
        if r.get("operator") == ALL:
            need = wanted.agg(F.count("*").alias("need"))
            hit = hit.crossJoin(F.broadcast(need)).where("got >= need")
        out = out.join(hit.select("item"), "item", "left_semi")
    return out


def validate(items: DataFrame, links: DataFrame, tags: DataFrame, rules: str | dict, now: datetime) -> tuple[bool, int, list[str]]:
    """Whether a rule document is sound, how many items it matches (0 if not), and what is wrong with it."""
    if found := problems(rules):
        return False, 0, found
    return True, evaluate(items, links, tags, rules, now).count(), []

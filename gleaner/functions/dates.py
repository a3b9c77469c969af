"""Phrases for dates, read against a given moment; half-open ranges of days."""

from __future__ import annotations

import re
from datetime import date, timedelta

SEASONS = {"spring": (3, 5), "summer": (6, 8), "autumn": (9, 11), "fall": (9, 11), "winter": (12, 1)}
YEARS = {"last": -1, "this": 0, "next": 1}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
UNITS = {"day": 1, "week": 7, "month": 30, "year": 365}
PHRASES = {"today": (0, 0), "yesterday": (1, 1), "this week": (6, 0), "last week": (7, 0), "last month": (30, 0), "last year": (365, 0)}


def month_end(year: int, month: int) -> date:
    return date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)


def day_range(phrase: str, today: date) -> tuple[date, date] | None:
    """First and last day that a phrase means, or None. "Last week" is the seven days up to now; winter is December and the January after.

    A season without a year is the latest one that has begun; with "last", "this" or "next" it is that of the year before, this one or the one after. Months have a year, with
    or without a day.
    """
    p = phrase.strip().lower()
    if p in PHRASES:
        back, end = PHRASES[p]
        return today - timedelta(days=back), today - timedelta(days=end)
    if m := re.fullmatch(r"(?:last |past )?(\d+) (day|week|month|year)s?(?: ago)?", p):
        days = int(m[1]) * UNITS[m[2]]
        return (today - timedelta(days=days), today - timedelta(days=days)) if p.endswith("ago") else (today - timedelta(days=days), today)
    if m := re.fullmatch(r"(?:(\w+) (?:of )?)?(\d{4})", p):
        year = int(m[2])
        if m[1] is None:
            return date(year, 1, 1), date(year, 12, 31)
        if m[1] in SEASONS:
            low, high = SEASONS[m[1]]
            return date(year, low, 1), month_end(year + (high < low), high)
    if m := re.fullmatch(r"(?:(last|this|next) )?(\w+)", p):
        if m[2] in SEASONS:
            low, high = SEASONS[m[2]]
            year = today.year + YEARS[m[1]] if m[1] else today.year - (today.month < low)
            return date(year, low, 1), month_end(year + (high < low), high)
    if (m := re.fullmatch(r"([a-z]+)(?: (\d{1,2}),?)? (\d{4})", p)) and m[1] in MONTHS:
        year, month, day = int(m[3]), MONTHS.index(m[1]) + 1, int(m[2] or 0)
        if day == 0:
            return date(year, month, 1), month_end(year, month)
        return (date(year, month, day),) * 2 if day <= month_end(year, month).day else None
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})(?:-(\d{1,2}))?", p):
        year, month = int(m[1]), int(m[2])
        return (date(year, month, 1), month_end(year, month)) if m[3] is None else (date(year, month, int(m[3])),) * 2
    return None


def split_query(query: str, today: date) -> tuple[str, tuple[date, date] | None]:
    """The text of a query without its date phrase, and the range of that; the longest phrase that means one wins."""
    words = query.split()
    for size in range(min(4, len(words)), 0, -1):
        for i in range(len(words) - size + 1):
            if found := day_range(" ".join(words[i : i + size]), today):
                return " ".join(words[:i] + words[i + size :]), found
    return query, None

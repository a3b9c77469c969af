"""Raw metadata maps brought to common fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions.text import folded_key

# Names under which devices store the same thing.
CAPTURE_TIME, FRACTION = ("DateTimeOriginal",), ("SubSecTimeOriginal",)
FRAME_NUMBER = ("SequenceNumber", "SequenceImageNumber", "SequenceFileNumber")
BURST = ("BurstUUID", "BurstIdentifier", "BurstGroupID", "BurstGroupId")
DRIVE = ("DriveMode", "ContinuousDrive", "ReleaseMode")
CONTINUOUS = "(?i)continuous|burst|high[ -]?speed"
DATE = r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?$"


def folded(raw: Column) -> Column:
    """A map with keys without group prefix, case and signs; of keys that fall together the first with a value stays. Blank values go."""
    pairs = F.transform(F.map_entries(raw), lambda e: F.struct(folded_key(F.regexp_replace(e["key"], "^.*:", "")).alias("key"), F.trim(e["value"]).alias("value")))
    pairs = F.filter(pairs, lambda e: e["value"].isNotNull() & (e["value"] != ""))
    first = F.aggregate(
        pairs,
        F.expr("cast(array() as array<struct<key:string,value:string>>)"),
        lambda out, e: F.when(F.exists(out, lambda o: o["key"] == e["key"]), out).otherwise(F.array_append(out, e)),
    )
    return F.map_from_entries(first)


def pick(index: Column, names: tuple[str, ...]) -> Column:
    """The first of several names that a folded map has."""
    return F.coalesce(*(F.try_element_at(index, folded_key(F.lit(n))) for n in names))


def capture(raw: Column) -> Column:
    """``captured_ms, frame, burst, continuous`` of a raw map. A time counts only with a fraction of a second, from the text or beside it."""
    index = folded(raw)
    when = pick(index, CAPTURE_TIME)
    fraction = F.coalesce(F.nullif(F.regexp_extract(when, DATE, 7), F.lit("")), pick(index, FRACTION))
    whole = F.try_to_timestamp(F.concat_ws(" ", F.concat_ws("-", *(F.regexp_extract(when, DATE, i) for i in (1, 2, 3))), F.concat_ws(":", *(F.regexp_extract(when, DATE, i) for i in (4, 5, 6)))), F.lit("yyyy-MM-dd HH:mm:ss"))
    ms = F.unix_millis(whole) + F.rpad(F.substring(fraction, 1, 3), 3, "0").try_cast("int")
    number = pick(index, FRAME_NUMBER)
    frame = number.try_cast("long")
    frame = F.when(number.rlike("^[0-9]+$") & (frame > 0) & (frame < 1 << 53), frame)
    drive = pick(index, DRIVE)
    return F.struct(
        F.when(when.rlike(DATE) & fraction.rlike("^[0-9]+$"), ms).alias("captured_ms"),
        frame.alias("frame"),
        pick(index, BURST).alias("burst"),
        F.coalesce(drive.rlike(CONTINUOUS), F.lit(False)).alias("continuous"),
    )

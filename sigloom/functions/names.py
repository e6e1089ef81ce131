"""Version numbers, coordinates and class names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a version as not final (found anywhere, in any case).
PRERELEASE = r"(?i)(alpha|beta|rc|snapshot|dev|preview|-m\d|eap)"
#: Prefixes of library classes, marks of generated and of removed classes.
LIBRARY_PREFIXES = [
    "android.", "androidx.", "com.google.", "kotlin.", "kotlinx.",
    "java.", "javax.", "org.jetbrains.", "dagger.", "okhttp3.", "okio.",
    "retrofit2.", "com.squareup.", "io.reactivex.", "org.apache.",
]
SYNTHETIC_MARKS = ["$$ExternalSynthetic", "$$Lambda$"]
REMOVED_MARK = "R8$$REMOVED"


def ver_key(version: Column) -> Column:
    """The leading dotted number as an array, which orders as versions do; [0] if none."""
    lead = F.regexp_extract(version, r"^\d+(\.\d+)*", 0)
    return F.when(lead == "", F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.split(lead, r"\."), lambda x: x.cast("long")))


def is_prerelease(version: Column) -> Column:
    return F.rlike(version, F.lit(PRERELEASE))


def coord_path(coord: Column) -> Column:
    """group.name:artifact as group/name/artifact."""
    return F.concat(F.replace(F.split_part(coord, F.lit(":"), F.lit(1)), F.lit("."), F.lit("/")), F.lit("/"), F.split_part(coord, F.lit(":"), F.lit(2)))


def coord_dir(coord: Column) -> Column:
    """The cache folder's name of a coordinate."""
    return F.replace(coord_path(coord), F.lit("/"), F.lit("__"))


def sigs_file(coord: Column, version: Column) -> Column:
    return F.concat(F.split_part(coord, F.lit(":"), F.lit(2)), F.lit("-"), version, F.lit(".sigs.json"))


def fqcn(package: Column, name: Column) -> Column:
    return F.when(F.coalesce(package, F.lit("")) != "", F.concat_ws(".", package, name)).otherwise(name)


def is_library(name: Column, prefixes: list[str] = LIBRARY_PREFIXES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(name, F.lit(p))
    return out


def is_synthetic(name: Column) -> Column:
    out = F.lit(False)
    for mark in SYNTHETIC_MARKS:
        out = out | F.contains(name, F.lit(mark))
    return out


def library_root(name: Column) -> Column:
    """The first three parts of a class name, or all of a shorter one."""
    return F.substring_index(name, ".", 3)


def range_label(coord: Column, ranges: Column, payload_id: Column) -> Column:
    """library:<coord>@<ranges>; ``?`` without ranges; by number without metadata."""
    named = F.concat(F.lit("library:"), coord, F.lit("@"), F.when(F.size(ranges) > 0, F.array_join(ranges, ",")).otherwise("?"))
    return F.coalesce(named, F.concat(F.lit("library:payload/"), payload_id.cast("string")))


def iso_utc(ts: Column) -> Column:
    """ISO 8601 to the second; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")

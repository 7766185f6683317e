"""Text functions with Python's semantics, as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET = 120
SHOWN = 200


def pattern(regex: str, ignore_case: bool = False) -> str:
    """A Java pattern for a Python one: only \\n ends a line, classes are Unicode's."""
    inline = regex.startswith("(?i)")
    return f"(?dU{'iu' if ignore_case or inline else ''})" + regex.removeprefix("(?i)")


def strip(text: Column) -> Column:
    """Without white space at both ends; unlike trim(), all Unicode white space counts, as do U+001C to U+001F."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def snippet(line: Column) -> Column:
    return F.substring(strip(line), 1, SNIPPET)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """All up to the last slash; empty without one."""
    return F.regexp_extract(path, r"^(?s)(.*)/", 1)


def suffix(name: Column) -> Column:
    """The last dot and what follows it; empty for names that begin or end with their only dot."""
    return F.regexp_extract(name, r"^(?s).+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.when(suffix(name) == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name))))


def sanitise(text: Column) -> Column:
    """Without control characters and U+FFFD, stripped, at most SHOWN characters; null becomes empty."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f�]", "")
    return F.substring(strip(clean), 1, SHOWN)


def shorten(text: Column) -> Column:
    """At most SHOWN characters, with dots in place of the rest."""
    return F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN), F.lit("..."))).otherwise(text)


def shorten_list(items: Column, most: int = 10) -> Column:
    """The first items, and a note of how many were left out."""
    note = F.format_string("... (+%d)", F.size(items) - most)
    return F.when(F.size(items) > most, F.concat(F.slice(items, 1, most), F.array(note))).otherwise(items)


def public_keys(fields: Column) -> Column:
    """A map without the keys that begin with an underscore."""
    return F.map_filter(fields, lambda k, v: ~F.startswith(k, F.lit("_")))


def hash12(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)

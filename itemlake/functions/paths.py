"""Column functions over dotted paths and their hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.split(path, r"\.")


def parent(path: Column) -> Column:
    """All but the last segment; empty for a path of one."""
    return F.when(F.contains(path, F.lit(".")), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(F.lit(""))


def last_segment(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def ancestors(path: Column) -> Column:
    """The path and all its prefixes, shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(segments(path))), lambda n: F.array_join(F.slice(segments(path), F.lit(1), n), "."))


def le8(n: Column) -> Column:
    """A long as eight little-endian bytes."""
    return F.unhex(F.regexp_replace(F.lpad(F.hex(n.cast("long")), 16, "0"), "(..)" * 8, "$8$7$6$5$4$3$2$1"))


def leaf_hash(object_id: Column, version: Column, content_hash: Column) -> Column:
    """SHA-256 of id, version and content hash, parted by |; time is left out."""
    bar = F.lit(bytearray(b"|"))
    return F.sha2(F.concat(F.encode(object_id, "UTF-8"), bar, le8(version), bar, F.unhex(content_hash)), 256)


def interior_hash(children: Column) -> Column:
    """SHA-256 over an array of children (segment, hash), in the order of segments."""
    joined = F.array_join(F.transform(F.array_sort(children), lambda c: F.concat(F.hex(F.encode(F.concat(c["segment"], F.lit(":")), "UTF-8")), c["hash"], F.lit("3B"))), "")
    return F.sha2(F.unhex(joined), 256)

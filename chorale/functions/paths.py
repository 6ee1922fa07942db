"""Recording code, stem and audio type of a file path, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AUDIO_TYPES


def isrc_of(path: Column) -> Column:
    """Name of the parent folder; empty if there is none."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def joined(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def stem_of(path: Column) -> Column:
    """Lower-cased name without its last suffix; a leading or trailing dot is no suffix."""
    return F.lower(F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1))


def audio_type_of(path: Column, strict: bool = False) -> Column:
    """Audio version that the stem names; any other stem is 'regular', in strict mode 'unknown'."""
    stem = stem_of(path)
    out = None
    for name, kind in AUDIO_TYPES.items():
        out = F.when(stem == name, kind) if out is None else out.when(stem == name, kind)
    return out.otherwise("unknown" if strict else "regular")

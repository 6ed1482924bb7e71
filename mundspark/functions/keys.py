"""Keys hidden in messy ids and paths, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sixteen hexadecimal digits, with anything but letters and digits between them, bounded by the same.
_HEX16 = r"(?<![0-9a-z])[0-9a-f](?:[^0-9a-z]*[0-9a-f]){15}(?![0-9a-z])"


def speaker_key(client_id: Column) -> Column:
    """The 16 hexadecimal digits of a speaker id, whatever stands before, around or between them. Where there are no
    such digits, the trimmed lower-case id itself; NULL for a missing id."""
    c = F.lower(F.trim(client_id))
    # most ids are the bare digits: they need no search
    digits = F.regexp_replace(F.regexp_extract(c, _HEX16, 0), "[^0-9a-f]", "")
    return F.when(c.rlike(r"^[0-9a-f]{16}$"), c).when(c.isin("", "nan", "none", "null", "unknown", "?"), None).otherwise(F.coalesce(F.nullif(digits, F.lit("")), c))


def file_key(path: Column) -> Column:
    """File name without folder, type and case; NULL for a missing path. Both slashes separate folders."""
    name = F.substring_index(F.substring_index(F.lower(F.trim(path)), "/", -1), "\\", -1)
    stem = F.when(name.rlike(r".\.[a-z0-9]{1,5}$"), F.regexp_replace(name, r"\.[a-z0-9]{1,5}$", "")).otherwise(name)
    return F.when(stem.isin("", "nan", "none", "null"), None).otherwise(stem)

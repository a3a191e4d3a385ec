"""Canonical forms of identifiers and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that are cut from both ends of an identifier.
OUTER_BLANKS = r"^\s+|\s+$"


def identifier(c: Column) -> Column:
    """Lower case without outer blanks; null stays null."""
    return F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))


def digest(c: Column) -> Column:
    """A declared SHA-256 as bare lower-case hex: an algorithm prefix (`sha256:`, `sha-256=`), 0x and outer blanks are cut."""
    return F.regexp_replace(identifier(c), r"^(?:sha-?256\s*[:=]\s*)?(?:0x)?", "")


def instant_micros(c: Column) -> Column:
    """Microseconds since the epoch of an ISO 8601 instant in any usual spelling; null where it isn't one.

    Upper or lower case, `T` or a blank between date and time, dashes and colons or none, up to nine fraction digits (cut
    to six), `Z`, an offset or no zone (taken as UTC).
    """
    s = F.upper(F.regexp_replace(c, OUTER_BLANKS, ""))
    s = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?=[T ])", "$1-$2-$3")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    s = F.regexp_replace(s, r",(\d+)", ".$1")
    s = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    s = F.regexp_replace(s, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    s = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d*)?)?$"), F.concat(s, F.lit("Z"))).otherwise(s)
    # Most instants are written plainly and need no rewriting.
    plain = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"), c.try_cast("timestamp"))
    return F.unix_micros(F.coalesce(plain, s.try_cast("timestamp")))

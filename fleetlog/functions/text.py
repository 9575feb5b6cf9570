"""String expressions of the listing clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# Replacements for processor names, in the order in which they apply.
CPU_NAME_RULES = [
    (r"^\d\dth Gen ", ""),
    (r"^AMD", ""),
    (r"Threadripper", "TR"),
    (r"Processor$", ""),
    (r"-Core", "C"),
    (r" with Radeon Graphics", ""),
]

# Characters that count as white space at the ends of a string.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Country names that stand where a code is expected.
COUNTRY_NAMES = {"Sweden": "SE"}
# ---- end of fixed values ----------------------------------------------------


def strip(x: Column) -> Column:
    """Cut white space of any kind from both ends.

    Blanks go first, by the fast built-in; the full set is tried only where a value
    still begins or ends with one of its characters.
    """
    plain = F.trim(x.cast("string"))
    ends = F.lit(WHITE_SPACE).contains(F.substring(plain, 1, 1)) | F.lit(WHITE_SPACE).contains(F.substring(plain, -1, 1))
    return F.when((F.length(plain) > 0) & ends, F.trim(plain, F.lit(WHITE_SPACE))).otherwise(plain)


def replace_in_order(x: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        x = F.regexp_replace(x, pattern, replacement)
    return x


def clean_cpu_name(x: Column) -> Column:
    return replace_in_order(x, CPU_NAME_RULES)


def last_part(x: Column, separator: str = ",") -> Column:
    """Text after the last separator, stripped."""
    return strip(F.substring_index(x, separator, -1))


def country_from_place(place: Column) -> Column:
    """Country code at the end of a free-text place such as 'City, XX'."""
    part = last_part(place)
    for name, code in COUNTRY_NAMES.items():
        part = F.when(part == name, F.lit(code)).otherwise(part)
    return part


def country(located: Column, place: Column) -> Column:
    """Located country, else the end of the place text."""
    return F.coalesce(located, country_from_place(place))


def map_codes(x: Column, codes: dict[str, int]) -> Column:
    """Look a name up in a small fixed code table; unknown names give null."""
    out = F.lit(None).cast("long")
    for name, code in codes.items():
        out = F.when(x == name, F.lit(code).cast("long")).otherwise(out)
    return out


def share_label(part: Column, whole: Column) -> Column:
    """'[part/whole]'."""
    return F.concat(F.lit("["), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit("]"))

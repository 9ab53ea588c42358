"""Text helpers with Unicode-aware whitespace."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as a Java character class; use it under the (?U) flag. The four separator controls
# are not Unicode White_Space but do count as blank when text is stripped.
SPACE = r"[\s\x1c-\x1f]"

# The look-behind lets a run of blanks be tried once, not once per blank, so the pattern stays
# linear on long runs.
_EDGES = rf"(?U)\A{SPACE}+|(?<!{SPACE}){SPACE}+\z"


def strip(c: Column) -> Column:
    """Cut blanks of any kind from both ends."""
    return F.regexp_replace(c, _EDGES, "")


def absent_to_null(c: Column) -> Column:
    """Stripped text; blank and the word "nan" in any case become null."""
    s = strip(c)
    return F.when(~F.lower(s).isin("", "nan"), s)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used. Otherwise the
    optimizer writes out the expression behind it at every place."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(words) -> str:
    """A Java alternation of quoted words."""
    return "|".join(re.escape(w) for w in words)


def ends_with_domain(host: Column, domains) -> Column:
    """Host equals one of the domains or lies under it."""
    return host.rlike(rf"(?:\A|\.)(?:{any_of(domains)})\z")

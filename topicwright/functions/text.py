"""Column functions on names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# Words that a topic's canonical form leaves out.
STOP_WORDS = ("the", "of", "using", "algorithm", "algo", "method", "problem", "technique", "approach")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def canonical(c: Column) -> Column:
    """The form under which spellings of a topic meet: lower case, without possessives, marks and stop words, plurals cut.

    Stop words go before plurals are cut, so "algorithms" stays as "algorithm".
    """
    low = F.regexp_replace(F.lower(c), "[’']s(?![A-Za-z0-9_])", "")
    kept = F.regexp_replace(F.regexp_replace(low, "[-_/]", " "), f"[^a-z0-9+#{SPACE}]", "")
    words = F.filter(F.split(kept, f"[{SPACE}]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    single = F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_join(single, " ")


def label_order(c: Column) -> Column:
    """Sorts labels as people do: runs of digits by value, letters by the Unicode collation."""
    padded = F.regexp_replace(c, r"(\d+)", "0" * 20 + "$1")
    return F.collate(F.regexp_replace(padded, r"\d*(\d{20})(?!\d)", "$1"), "UNICODE")


def half_up(c: Column) -> Column:
    """Nearest whole number, halves upwards (also below zero)."""
    return F.floor(c + 0.5)

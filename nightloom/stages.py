"""The closed stage vocabulary: spellings, codes and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code of every accepted spelling (upper case, trimmed). Codes
# mean the same in each vocabulary except that SLEEP, of the two-stage one,
# shares 1 with N1, and NREM and LIGHT share 2 with N2.
CODES = {
    "W": 0, "WAKE": 0, "0": 0,
    "S": 1, "SLEEP": 1, "N1": 1, "S1": 1, "1": 1,
    "N2": 2, "S2": 2, "NREM": 2, "LIGHT": 2, "2": 2,
    "N3": 3, "S3": 3, "S4": 3, "DEEP": 3, "3": 3,
    "R": 4, "REM": 4, "4": 4,
    "ART": -1, "MT": -1, "-1": -1,
    "UNS": -2, "ND": -2, "-2": -2,
}

# Canonical labels and their codes by number of stages.
LABELS = {
    2: {"WAKE": 0, "SLEEP": 1, "ART": -1, "UNS": -2},
    3: {"WAKE": 0, "NREM": 2, "REM": 4, "ART": -1, "UNS": -2},
    4: {"WAKE": 0, "LIGHT": 2, "DEEP": 3, "REM": 4, "ART": -1, "UNS": -2},
    5: {"WAKE": 0, "N1": 1, "N2": 2, "N3": 3, "REM": 4, "ART": -1, "UNS": -2},
}


def spellings(n_stages: int) -> list[str]:
    """Accepted spellings of a vocabulary: its labels, their short and older forms, and its integers."""
    own = LABELS[n_stages]
    words = {k for k, v in CODES.items() if v in own.values() and (k.lstrip("-").isdigit() or k in ("W", "R", "MT", "ND", *own))}
    return sorted(words | ({"S"} if n_stages == 2 else set()) | ({"S1", "S2", "S3", "S4"} if n_stages == 5 else set()) - ({"R"} if "REM" not in own else set()))


# White space around a spelling (ASCII's, and Unicode's separators).
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def tidy(spelling: Column) -> Column:
    """Upper case without surrounding white space; blank becomes null."""
    return F.nullif(F.upper(F.btrim(spelling, F.lit(BLANKS))), F.lit(""))


def code_of(spelling: Column) -> Column:
    """Stage code of a spelling; null for null, blank and unknown ones."""
    table = F.create_map(*[x for k, v in CODES.items() for x in (F.lit(k), F.lit(v))])
    # trimming blanks alone is quick, and nearly always enough
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(spelling))), F.try_element_at(table, tidy(spelling)))


def label_of(code: Column, n_stages: Column | int) -> Column:
    """Canonical label of a code in a vocabulary of ``n_stages``; null where it has none."""
    size = F.lit(n_stages) if isinstance(n_stages, int) else n_stages
    out = F.lit(None).cast("string")
    for n, labels in LABELS.items():
        table = F.create_map(*[x for k, v in labels.items() for x in (F.lit(v), F.lit(k))])
        out = F.when(size == n, F.try_element_at(table, code.cast("int"))).otherwise(out)
    return out

"""What several operators compare records by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.sequence import canonical

#: Sequence types without a second strand.
ONE_STRAND = {"protein", "unlimit"}


def record_key(by: str, ignore_case: bool = False, both_strands: bool = False, column=F.col) -> Column:
    if by not in ("id", "name", "seq"):
        raise ValueError("by is id, name or seq")
    key = column(by)
    key = F.upper(key) if ignore_case and by == "seq" else F.lower(key) if ignore_case else key
    return canonical(key) if by == "seq" and both_strands else key


def group_key(by: str, ignore_case: bool = False, both_strands: bool = False) -> Column:
    """What records are grouped and joined by: the id or name itself, or 256 bits for a sequence, so that no whole sequence is a shuffle key.

    SHA-256 stands for the sequence; no two different texts with the same value are known.
    """
    key = record_key(by, ignore_case, both_strands)
    return F.unhex(F.sha2(key, 256)) if by == "seq" else key

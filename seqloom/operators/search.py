"""Searching sequences and headers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import codes
from seqloom.functions import sequence as S
from seqloom.operators.keys import ONE_STRAND

#: More patterns than this are joined or searched in blocks, not written into one expression.
INLINE = 1000


def _listed(patterns: list[str] | DataFrame) -> list[str]:
    """Distinct patterns as a list, all of them."""
    if isinstance(patterns, DataFrame):
        patterns = [r[0] for r in patterns.select("pattern").distinct().collect()]
    if not patterns or any(not p for p in patterns):
        raise ValueError("patterns are needed, none of them empty")
    return list(dict.fromkeys(patterns))


def _blocks(items: list) -> list[list]:
    return [items[i : i + INLINE] for i in range(0, len(items), INLINE)]


def _check_letters(patterns: list[str]) -> None:
    for p in patterns:
        if set(p) - set(codes.LETTERS["protein"] + codes.GAPS):
            raise ValueError(f"illegal letters in pattern {p!r}")


def _regexp(p: str, mode: str, ignore_case: bool) -> str:
    p = codes.degenerate_to_regex(p) if mode == "degenerate" else p
    return f"(?i){p}" if ignore_case else p


def _hits(patterns: list[str], by: str, mode: str, max_mismatch: int, region: str | None, circular: bool, both_strands: bool, ignore_case: bool) -> list[Column]:
    """One condition per pattern."""
    if by != "seq":
        target = F.col(by)
        if mode == "regexp":
            return [target.rlike(_regexp(p, mode, ignore_case)) for p in patterns]
        return [(F.lower(target) == p.lower()) if ignore_case else (target == p) for p in patterns]
    target = F.col("seq")
    if region:
        target = S.region(target, *S.parse_span(region))
    elif circular:
        target = F.concat(target, target)
    strands = [target, S.revcomp(target)] if both_strands else [target]

    def hit(t: Column, p: str) -> Column:
        if max_mismatch:
            t, p = (F.lower(t), p.lower()) if ignore_case else (t, p)
            return F.size(S.near(t, p, max_mismatch)) > 0
        if mode != "exact":
            return t.rlike(_regexp(p, mode, ignore_case))
        return F.lower(t).contains(p.lower()) if ignore_case else t.contains(p)

    out = []
    for p in patterns:
        found = hit(strands[0], p)
        for t in strands[1:]:
            found = found | hit(t, p)
        out.append(found)
    return out


def grep(
    df: DataFrame, patterns: list[str] | DataFrame, *, by: str = "id", mode: str = "exact", max_mismatch: int = 0, region: str | None = None, circular: bool = False,
    both_strands: bool = True, ignore_case: bool = False, invert: bool = False, first_per_pattern: bool = False, seq_type: str = "auto",
) -> DataFrame:
    """Records that match a pattern (or none, with `invert`).

    by id or name: the whole of it, or a regexp. by seq: anywhere, on both strands unless the type has one; degenerate patterns, mismatches and a region search
    sequences whatever `by` says. first_per_pattern keeps only the first record of each pattern, and is ignored with `invert` or mismatches.
    patterns: a list, or a DataFrame with a column `pattern`; exact ids and names are then joined, however many there are. Other searches
    hold all patterns on the driver and read the records once for each block of INLINE; ordinals must then differ.
    """
    if mode not in ("exact", "regexp", "degenerate"):
        raise ValueError("mode is exact, regexp or degenerate")
    if mode == "degenerate" or max_mismatch or region:
        by = "seq"
    if by not in ("id", "name", "seq"):
        raise ValueError("by is id, name or seq")
    if max_mismatch and mode != "exact":
        raise ValueError("mismatches go with exact patterns only")
    if by != "seq" and mode == "exact" and not (isinstance(patterns, list) and len(patterns) <= INLINE):
        return _joined(df, patterns, by, ignore_case, invert, first_per_pattern)
    patterns = _listed(patterns)
    if by == "seq" and mode == "exact":
        _check_letters(patterns)
        if max_mismatch > min(map(len, patterns)):
            raise ValueError("more mismatches than letters in a pattern")
    blocks = [_hits(b, by, mode, max_mismatch, region, circular, both_strands and seq_type not in ONE_STRAND, ignore_case) for b in _blocks(patterns)]
    if first_per_pattern and not invert and not max_mismatch:
        # each pattern's smallest matching ordinal: one aggregate a block, then a join with as many rows as patterns at most
        firsts = [df.agg(*[F.min(F.when(h, F.col("ordinal"))).alias(f"f{i}") for i, h in enumerate(b)]).select(F.explode(F.array(*[f"f{i}" for i in range(len(b))])).alias("ordinal")) for b in blocks]
        return df.join(reduce(DataFrame.union, firsts).where("ordinal is not null").distinct(), "ordinal", "left_semi")
    founds = [reduce(Column.__or__, b, F.lit(False)) for b in blocks]
    if len(founds) == 1:
        return df.where(~founds[0] if invert else founds[0])
    # a null condition is neither a hit nor the lack of one
    marked = [df.where(F.coalesce(f, F.lit(invert))).select("ordinal") for f in founds]
    return df.join(reduce(DataFrame.union, marked).distinct(), "ordinal", "left_anti" if invert else "left_semi")


def _joined(df: DataFrame, patterns: list[str] | DataFrame, by: str, ignore_case: bool, invert: bool, first: bool) -> DataFrame:
    if isinstance(patterns, list):
        patterns = df.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    wanted = patterns.select((F.lower("pattern") if ignore_case else F.col("pattern")).alias("__p")).distinct()
    key = F.lower(by) if ignore_case else F.col(by)
    out = df.join(wanted, key == F.col("__p"), "left_anti" if invert else "left_semi")
    if first and not invert:
        firsts = out.groupBy(key.alias("__p")).agg(F.min("ordinal").alias("ordinal")).select("ordinal")
        out = out.join(firsts, "ordinal", "left_semi")
    return out


def grep_count(df: DataFrame, patterns: list[str] | DataFrame, **options) -> DataFrame:
    """n: the number of records that grep() gives."""
    return grep(df, patterns, **options).agg(F.count("*").alias("n"))


def locate(
    df: DataFrame, patterns: dict[str, str] | list[str] | DataFrame, *, mode: str = "literal", max_mismatch: int = 0, non_greedy: bool = False, circular: bool = False,
    both_strands: bool = True, ignore_case: bool = False, use_fmi: bool = False, hide_matched: bool = False, seq_type: str = "auto",
) -> DataFrame:
    """One row per place where a pattern matches: seq_id, pattern_name, pattern, strand, start, end, matched.

    Positions count from 1, the end is inclusive, on the plus strand also for hits on the minus strand. Hits may overlap; with non_greedy the next
    one begins behind the last, one base skipped. Regular expressions report no hit that lies within an earlier one. circular: the end may
    lie beyond the sequence. patterns: name -> pattern, a list, or FASTA records (id, seq, and ordinal if they have it): the last one of an id
    counts, and every id is searched, INLINE at a time. use_fmi is a hint without effect.
    """
    if isinstance(patterns, DataFrame):
        ordered = patterns.orderBy("ordinal") if "ordinal" in patterns.columns else patterns
        patterns = {r["id"]: r["seq"] for r in ordered.select("id", "seq").collect()}
    elif not isinstance(patterns, dict):
        patterns = {p: p for p in patterns}
    _listed(list(patterns.values()))
    if mode not in ("literal", "regexp", "degenerate") or (max_mismatch and mode != "literal") or (use_fmi and mode != "literal"):
        raise ValueError("mode is literal, regexp or degenerate; mismatches and the index go with literal patterns")
    found = [_located(df, dict(b), mode, max_mismatch, non_greedy, circular, both_strands and seq_type not in ONE_STRAND, ignore_case, hide_matched) for b in _blocks(list(patterns.items()))]
    return reduce(DataFrame.union, found)


def _located(df: DataFrame, patterns: dict[str, str], mode: str, max_mismatch: int, non_greedy: bool, circular: bool, both_strands: bool, ignore_case: bool, hide_matched: bool) -> DataFrame:
    """locate() for one block of patterns."""
    length = F.length("seq")
    strands = [("+", F.col("seq"))] + ([("-", S.revcomp(F.col("seq")))] if both_strands else [])
    rows = []
    for strand, text in strands:
        doubled = F.concat(text, text) if circular else text
        for name, p in patterns.items():
            spans = _searched(doubled, p, mode, max_mismatch, ignore_case, length if circular else None)
            if mode != "literal":
                spans = _outermost(spans)
            if non_greedy:
                spans = _apart(spans)
            rows.append(_labelled(spans, name, p, strand))
    out = df.select("id", length.alias("__len"), F.explode(F.concat(*rows)).alias("x"))
    wrapped = F.when(F.col("x.e") > F.col("__len"), F.col("__len")).otherwise(0)
    plus = F.col("x.s") == "+"
    start = F.when(plus, F.col("x.b")).otherwise(F.col("__len") - F.col("x.e") + 1 + wrapped)
    end = F.when(plus, F.col("x.e")).otherwise(F.col("__len") - F.col("x.b") + 1 + wrapped)
    columns = [F.col("id").alias("seq_id"), F.col("x.n").alias("pattern_name"), F.col("x.p").alias("pattern"), F.col("x.s").alias("strand"), start.cast("long").alias("start"), end.cast("long").alias("end")]
    return out.select(*columns, *([] if hide_matched else [F.col("x.t").alias("matched")]))


def _searched(text: Column, *options) -> Column:
    return S.let(text, lambda t: _spans(t, *options))


def _labelled(spans: Column, name: str, p: str, strand: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(name).alias("n"), F.lit(p).alias("p"), F.lit(strand).alias("s"), x["b"].alias("b"), x["e"].alias("e"), x["t"].alias("t")))


def _spans(text: Column, p: str, mode: str, most: int, ignore_case: bool, length: Column | None) -> Column:
    """Arrays of (b, e, t): begin, end, matched text, in order of begin."""
    if mode == "literal":
        searched, wanted = (F.lower(text), p.lower()) if ignore_case else (text, p)
        begins = S.near(searched, wanted, most) if most else S.match_starts(searched, re.escape(wanted))
        spans = F.transform(begins, lambda b: F.struct(b.alias("b"), (b + (len(p) - 1)).alias("e"), F.substring(text, b, len(p)).alias("t")))
    else:
        regexp = _regexp(p, mode, ignore_case)
        # what matches at each of these places, in the same order, in one more pass
        matched = F.regexp_extract_all(text, F.lit(f"(?=({regexp}))"), F.lit(1))
        spans = F.zip_with(S.match_starts(text, regexp), matched, lambda b, t: F.struct(b.alias("b"), (b + F.length(t) - 1).alias("e"), t.alias("t")))
    return spans if length is None else F.filter(spans, lambda x: x["b"] <= length)


def _empty() -> Column:
    return F.array().cast("array<struct<b:int,e:int,t:string>>")


def _outermost(spans: Column) -> Column:
    """Without hits inside an earlier one. Begins grow, so it is enough to know the largest end so far."""
    zero = F.struct(F.lit(0).alias("most"), _empty().alias("kept"))
    step = lambda a, x: F.when(x["e"] > a["most"], F.struct(x["e"].alias("most"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return F.aggregate(spans, zero, step, lambda a: a["kept"])


def _apart(spans: Column) -> Column:
    """The first hit, then each one that begins at least two letters behind the end of the last one taken."""
    zero = F.struct(F.lit(-1).alias("most"), _empty().alias("kept"))
    step = lambda a, x: F.when(x["b"] >= a["most"] + 2, F.struct(x["e"].alias("most"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return F.aggregate(spans, zero, step, lambda a: a["kept"])

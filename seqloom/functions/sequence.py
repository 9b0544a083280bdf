"""Pure Column expressions: no Python runs on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import codes

DEFAULT_ID = r"^(\S+)\s?"
NCBI_ID = r"\|([^\|]+)\| "


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def complement(seq: Column, rna: bool = False) -> Column:
    return F.translate(seq, *((codes.RNA_FROM, codes.RNA_TO) if rna else (codes.DNA_FROM, codes.DNA_TO)))


def revcomp(seq: Column, rna: bool = False) -> Column:
    return F.reverse(complement(seq, rna))


def canonical(seq: Column) -> Column:
    """The same value for a sequence and its reverse complement."""
    return F.least(seq, revcomp(seq))


def check_region(start: int, end: int) -> None:
    if start == 0 or end == 0:
        raise ValueError("positions count from 1, or from -1 backwards: 0 is none")
    if start < 0 < end:
        raise ValueError("a region that begins from the end must end from the end too")


def parse_span(region: str) -> tuple[int, int]:
    """`a:b`, positions from 1, negative from the end."""
    found = re.fullmatch(r"(-?\d+):(-?\d+)", region)
    if not found:
        raise ValueError(f"invalid region: {region}")
    start, end = int(found[1]), int(found[2])
    check_region(start, end)
    return start, end


def sub_location(length: Column, start: int | Column, end: int | Column) -> tuple[Column, Column]:
    """1-based inclusive limits within a sequence; the first is above the second where nothing is left."""
    s, e = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    return F.when(s < 0, F.greatest(length + s + 1, F.lit(1))).otherwise(s), F.when(e < 0, length + e + 1).otherwise(F.least(e, length))


def cut(seq: Column, begin: Column, end: Column) -> Column:
    """Letters begin to end, inclusive; empty if there are none."""
    return F.when(seq.isNull(), None).when(begin <= end, F.substring(seq, begin.cast("int"), (end - begin + 1).cast("int"))).otherwise(F.lit(""))


def region(seq: Column, start: int, end: int, length: Column | None = None) -> Column:
    check_region(start, end)
    return cut(seq, *sub_location(F.length(seq) if length is None else length, start, end))


def wrap(seq: Column, width: int) -> Column:
    return seq if width < 1 else F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def count_letters(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def letter_class(letters: str) -> str:
    """A regular expression class of literal letters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]"


def mean_quality(qual: Column, base: int = 33) -> Column:
    """-10 log10 of the mean error probability; null for an empty quality."""

    def errors(c: Column) -> Column:
        """Of all letters that equal c."""
        return F.pow(F.lit(10.0), (F.lit(base) - F.ascii(c)) / F.lit(10.0)) * (F.length(qual) - F.length(F.replace(qual, c, F.lit(""))))

    total = F.aggregate(F.array_sort(F.array_distinct(F.split(qual, ""))), F.lit(0.0), lambda a, c: a + errors(c))
    return F.when(F.length(qual) > 0, F.lit(-10.0) * F.log10(total / F.length(qual)))


def parse_header(name: Column, id_regexp: str | None = None, ncbi: bool = False) -> tuple[Column, Column]:
    """(id, description) of a header without its marker."""
    if ncbi:
        id_regexp = NCBI_ID
    if id_regexp is None or id_regexp == DEFAULT_ID:
        # the first space wins if it isn't in front; else the first tab
        pattern = r"(?s)\A([^ ]+) [ \t]*(.*)\z"
        tab = r"(?s)\A([^\t]+)\t[ \t]*(.*)\z"
        split = lambda i: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, i)).when(name.rlike(tab), F.regexp_extract(name, tab, i))
        return split(1).otherwise(name), split(2).otherwise(F.lit(""))
    if re.compile(id_regexp).groups < 1:
        raise ValueError("the id regexp must contain a capture group")
    return F.when(name.rlike(id_regexp), F.regexp_extract(name, id_regexp, 1)).otherwise(name), F.lit("")


def _no_zeros(digits: Column) -> Column:
    return F.regexp_replace(digits, r"\A0+(?=\d)", "")


def natural_key(text: Column) -> Column:
    """Sort key by which runs of digits compare as numbers."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda p: F.when(p.rlike(r"\A\d+\z"), F.concat(F.lpad(F.length(_no_zeros(p)).cast("string"), 6, "0"), _no_zeros(p)))
    return F.transform(parts, lambda p: F.struct(number(p).isNull().alias("is_text"), F.coalesce(number(p), p).alias("part"), F.length(p).alias("digits")))


def shared_words(descr: Column, first: Column) -> Column:
    """Number of leading words (split at spaces and tabs) that two descriptions share."""
    words = lambda d: F.filter(F.split(d, "[ \t]"), lambda w: w != "")
    return let(words(descr), lambda a: let(words(first), lambda b: let(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: F.when(F.array_position(e, False) > 0, F.array_position(e, False) - 1).otherwise(F.size(e).cast("long")))))


def mismatches(window: Column, pattern: str) -> Column:
    """Hamming distance between a window and a pattern of its length."""
    out = F.lit(0)
    for i, c in enumerate(pattern, 1):
        out = out + (F.substring(window, i, 1) != c).cast("int")
    return out


def near(seq: Column, pattern: str, most: int) -> Column:
    """Start positions (from 1) of windows within `most` mismatches of the pattern, in order.

    With at most m mismatches one of m + 1 pieces of the pattern is exact: the places of the pieces are found first, and only
    the windows around them are compared. A pattern with fewer letters than pieces has all windows compared.
    """
    k = len(pattern)
    edges = [i * k // (most + 1) for i in range(most + 2)]
    none = F.array().cast("array<int>")

    def around(text: Column, a: int, b: int) -> Column:
        if a == b:
            return F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)).otherwise(none)
        return F.transform(match_starts(text, re.escape(pattern[a:b])), lambda i: i - a)

    def found(text: Column) -> Column:
        spots = F.array_sort(F.array_distinct(F.concat(*[around(text, a, b) for a, b in zip(edges, edges[1:])])))
        inside = F.filter(spots, lambda i: (i >= 1) & (i <= F.length(text) - k + 1))
        return F.filter(inside, lambda i: let(F.substring(text, i, k), lambda w: mismatches(w, pattern)) <= most)

    return let(seq, found)


def match_starts(seq: Column, regexp: str) -> Column:
    """Start positions (from 1) of all matches, overlapping ones too, in one pass: the lengths of the pieces between them."""
    return let(seq, lambda text: _match_starts(text, regexp))


def _match_starts(seq: Column, regexp: str) -> Column:
    none = F.array().cast("array<int>")
    first = F.when(seq.rlike(f"\\A(?:{regexp})"), F.array(F.lit(1))).otherwise(none)
    lengths = F.transform(F.split(seq, f"(?={regexp})"), lambda p: F.length(p))
    rest = let(lengths, lambda p: F.when(F.size(p) > 1, running_sums(F.slice(p, 1, F.size(p) - 1), 1)).otherwise(none))
    return F.when(seq.rlike(regexp), F.concat(first, rest)).otherwise(none)


def running_sums(values: Column, start: int, block: int = 256) -> Column:
    """start + v1, start + v1 + v2, ... Sums are taken within blocks and over blocks, for an array grows by copying."""

    def sums(part: Column, before: Column) -> Column:
        zero = F.struct(before.cast("int").alias("at"), F.array().cast("array<int>").alias("found"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["found"], F.array(a["at"] + n)).alias("found"))
        return F.aggregate(part, zero, step, lambda a: a["found"])

    def over(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, F.lit(block)).cast("int"))
        blocks = F.transform(cuts, lambda i: F.slice(v, i * block + 1, block))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, n: a + n))
        before = F.concat(F.array(F.lit(start)), sums(totals, F.lit(start)))
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(before) - 1), sums))

    return let(values, lambda v: F.when(F.size(v) > block, over(v)).otherwise(sums(v, F.lit(start))))


def translate(seq: Column, frame: int = 1, table: int = 1, allow_unknown: bool = False, init_as_m: bool = False, clean: bool = False, trim: bool = False) -> Column:
    """The protein of one frame (1, 2, 3, -1, -2, -3). Degenerate codons are read where all their readings agree."""
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError("frame is 1, 2, 3, -1, -2 or -3")
    masks = "ACMGRSVTWYHKDBN"
    known = codes.degenerate_codons(table)
    letters = ["?"] * 4096
    for codon, aa in known.items():
        letters[sum((masks.index(b) + 1) * 16 ** (2 - i) for i, b in enumerate(codon))] = aa
    lookup = F.split(F.lit("".join(letters)), "")
    strand = F.translate(F.upper(seq), "U", "T")
    strand = revcomp(strand) if frame < 0 else strand
    strand = F.substring(strand, abs(frame), 1 << 30)
    place = lambda c, i: F.call_function("locate", F.substring(c, i, 1), F.lit(masks))
    one = lambda c: F.element_at(lookup, place(c, 1) * 256 + place(c, 2) * 16 + place(c, 3) + 1)
    found = F.regexp_extract_all(strand, F.lit("..."), F.lit(0))
    protein = F.array_join(F.transform(found, one), "")
    if init_as_m:
        begins = F.substring(strand, 1, 3).isin(codes.starts(table))
        protein = let(protein, lambda p: F.when(begins & (F.length(p) > 0), F.concat(F.lit("M"), F.substring(p, 2, 1 << 30))).otherwise(p))
    if allow_unknown:
        protein = F.translate(protein, "?", "X")
    else:
        protein = let(protein, lambda p: F.when(F.locate("?", p) > 0, F.raise_error(F.lit("a codon without a reading; allow_unknown=True gives X for it")).cast("string")).otherwise(p))
    if clean:
        protein = F.translate(protein, "*", "X")
    return F.regexp_replace(protein, r"[X*]+\z", "") if trim else protein


def guess_type(seq: Column) -> Column:
    """dna, rna, protein or unlimit, by the letters of a sequence."""
    text = F.translate(seq, codes.GAPS, "")
    fits = lambda kind: ~text.rlike(f"[^{codes.LETTERS[kind].replace('*', chr(92) + '*')}]")
    return F.when(fits("dna"), "dna").when(fits("rna"), "rna").when(fits("protein"), "protein").otherwise("unlimit")

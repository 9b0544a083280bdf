"""Operators: functions from record DataFrames to DataFrames, usable with DataFrame.transform."""

from seqloom.operators.group import faidx_index, rename, rmdup, rmdup_counts, rmdup_removed, stats
from seqloom.operators.join import common, concat, fa2fq, faidx_query, pair, pick, subseq_features, unpaired
from seqloom.operators.order import head, head_genome, record_range, sample, shuffle, sort, union
from seqloom.operators.search import grep, grep_count, locate
from seqloom.operators.transform import duplicate, fq2fa, genetic_codes, replace, seq, seq_type, subseq, translate

__all__ = [
    "common", "concat", "duplicate", "fa2fq", "faidx_index", "faidx_query", "fq2fa", "genetic_codes", "grep", "grep_count", "head",
    "head_genome", "locate", "pair", "pick", "record_range", "rename", "replace", "rmdup", "rmdup_counts", "rmdup_removed", "sample", "seq", "seq_type",
    "shuffle", "sort", "stats", "subseq", "subseq_features", "translate", "union", "unpaired",
]

"""Commands by name: how each takes its inputs, its options, and what it gives.

Several inputs: most commands run on each and unite the results; `joined` ones unite first; `each` gives a row per input;
`one` takes a single input; `several` takes two or more together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import operators as O
from seqloom.sources import fastx, sinks, tables


@dataclass(frozen=True)
class Command:
    run: Callable
    inputs: str = "per"
    output: str = "records"
    #: option -> type; bool options are flags, list options may be given several times.
    options: dict = field(default_factory=dict)


def _type(o: dict) -> str:
    return o.get("seq_type") or "auto"


def _patterns(spark: SparkSession, o: dict):
    return tables.read_patterns(spark, o["pattern_file"]) if o.get("pattern_file") else o.get("pattern") or []


def _grep(spark, dfs, o):
    mode = "degenerate" if o.get("degenerate") else "regexp" if o.get("use_regexp") else "exact"
    keep = {k: o[k] for k in ("max_mismatch", "region", "circular", "ignore_case") if o.get(k)}
    by = "seq" if o.get("by_seq") else "name" if o.get("by_name") else "id"
    common = {"by": by, "mode": mode, "both_strands": not o.get("only_positive_strand"), "invert": bool(o.get("invert_match")), "first_per_pattern": bool(o.get("delete_matched")), "seq_type": _type(o)}
    return (O.grep_count if o.get("count") else O.grep)(dfs[0], _patterns(spark, o), **common, **keep)


def _locate(spark, dfs, o):
    mode = "degenerate" if o.get("degenerate") else "regexp" if o.get("use_regexp") else "literal"
    patterns = fastx.read_fasta(spark, o["pattern_file"]) if o.get("pattern_file") else o.get("pattern") or []
    keep = {k: o[k] for k in ("max_mismatch", "non_greedy", "circular", "ignore_case", "use_fmi") if o.get(k)}
    found = O.locate(dfs[0], patterns, mode=mode, both_strands=not o.get("only_positive_strand"), seq_type=_type(o), **keep)
    if o.get("bed"):
        return found.select(sinks.bed_text().alias("value"))
    if o.get("gtf"):
        return found.select(sinks.gtf_text().alias("value"))
    columns = ["seq_id", "pattern_name", "pattern", "strand", "start", "end", *([] if o.get("hide_matched") else ["matched"])]
    return found.select(F.concat_ws("\t", *columns).alias("value"))


def _subseq(spark, dfs, o):
    if o.get("region"):
        if o.get("up_stream") or o.get("down_stream") or o.get("only_flank"):
            raise ValueError("flanks don't go with a region")
        return O.subseq(dfs[0], o["region"])
    if o.get("gtf"):
        spots = tables.read_gtf(spark, o["gtf"], o.get("chr"), o.get("feature"))
    elif o.get("bed"):
        if o.get("feature"):
            raise ValueError("BED features have no types")
        spots = tables.read_bed(spark, o["bed"], o.get("chr"))
    else:
        raise ValueError("a region, a GTF or a BED file is needed")
    return O.subseq_features(dfs[0], spots, up=o.get("up_stream") or 0, down=o.get("down_stream") or 0, only_flank=bool(o.get("only_flank")), tag=o.get("gtf_tag") or "gene_id")


def _seq(spark, dfs, o):
    if o.get("lower_case") and o.get("upper_case"):
        raise ValueError("lower and upper case exclude each other")
    only = "name+seq" if o.get("name") and o.get("seq") else "name" if o.get("name") else "seq" if o.get("seq") else "qual" if o.get("qual") else "record"
    case = "lower" if o.get("lower_case") else "upper" if o.get("upper_case") else None
    to = "rna" if o.get("dna2rna") else "dna" if o.get("rna2dna") else None
    keep = {k: o[k] for k in ("reverse", "complement", "only_id", "remove_gaps", "gap_letters", "min_len", "max_len", "min_qual", "max_qual", "seq_type") if o.get(k)}
    keep |= {k: o[n] for n, k in (("validate_seq_length", "validate_len"), ("qual_ascii_base", "qual_base")) if o.get(n) is not None}
    return O.seq(dfs[0], only=only, case=case, to=to, validate=bool(o.get("validate_seq")), **keep)


def _replace(spark, dfs, o):
    kv = tables.read_key_values(spark, o["kv_file"]) if o.get("kv_file") else None
    on_miss = "untouched" if o.get("keep_untouch") else "keep_key" if o.get("keep_key") else "replace"
    return O.replace(dfs[0], o.get("pattern") or "", o.get("replacement") or "", by_seq=bool(o.get("by_seq")), ignore_case=bool(o.get("ignore_case")), nr_width=o.get("nr_width") or 1, kv=kv, key_idx=o.get("key_capt_idx") or 1, on_miss=on_miss, miss_text=o.get("key_miss_repl") or "")


def _by(o: dict) -> str:
    if o.get("by_seq") and o.get("by_name"):
        raise ValueError("by name and by sequence exclude each other")
    return "seq" if o.get("by_seq") else "name" if o.get("by_name") else "id"


def _keyed(o: dict) -> dict:
    if o.get("only_positive_strand") and not o.get("by_seq"):
        raise ValueError("strands matter to sequences only")
    return {"by": _by(o), "ignore_case": bool(o.get("ignore_case")), "both_strands": not o.get("only_positive_strand"), "seq_type": _type(o)}


def _sort(spark, dfs, o):
    chosen = [n for n in ("length", "bases", "name", "seq") if o.get(f"by_{n}")]
    if len(set(chosen) - {"bases"}) > 1 and chosen != ["length", "bases"]:
        raise ValueError("sort by one of length, name and sequence")
    by = "bases" if "bases" in chosen else chosen[0] if chosen else "id"
    return O.sort(dfs[0], by=by, natural=bool(o.get("natural_order")), reverse=bool(o.get("reverse")), ignore_case=bool(o.get("ignore_case")), prefix=10_000 if o.get("seq_prefix_length") is None else o["seq_prefix_length"])


def _translate(spark, dfs, o):
    if o.get("list_transl_table") is not None:
        return O.genetic_codes(spark, o["list_transl_table"]).select(F.concat_ws("\t", "*").alias("value"))
    if o.get("list_transl_table_with_amb_codons") is not None:
        return O.genetic_codes(spark, o["list_transl_table_with_amb_codons"], ambiguous=True).select(F.concat_ws("\t", "*").alias("value"))
    frames = tuple(int(x) for f in o.get("frame") or ["1"] for x in f.split(","))
    return O.translate(dfs[0], table=o.get("transl_table") or 1, frames=frames, trim=bool(o.get("trim")), clean=bool(o.get("clean")), allow_unknown=bool(o.get("allow_unknown_codon")), init_as_m=bool(o.get("init_codon_as_M")), append_frame=bool(o.get("append_frame")), seq_type=_type(o))


def _faidx(spark, dfs, o):
    regions = [*(tables.read_regions(spark, o["region_file"]) if o.get("region_file") else []), *(o.get("region") or [])]
    if not regions:
        return O.faidx_index(dfs[0], full_head=bool(o.get("full_head"))).select(F.concat_ws("\t", "name", "length", "offset", "line_bases", "line_width", "qual_offset").alias("value"), F.col("offset").alias("ordinal"))
    found = O.faidx_query(dfs[0], regions, use_regexp=bool(o.get("use_regexp")), ignore_case=bool(o.get("ignore_case")), full_head=bool(o.get("full_head")))
    return found.select("ordinal", F.col("head").alias("id"), F.col("head").alias("name"), F.lit("").alias("descr"), "seq", F.lit(None).cast("string").alias("qual"))


def _needed(o: dict, option: str) -> str:
    if not o.get(option):
        raise ValueError(f"--{option.replace('_', '-')} is needed")
    return o[option]


def _concat(spark, dfs, o):
    out = dfs[0]
    for other in dfs[1:]:
        out = O.concat(out, other, full=bool(o.get("full")), separator=o.get("separator") or "|").drop("ordinal_b")
    return out


_STRANDS = {"by_name": bool, "by_seq": bool, "ignore_case": bool, "only_positive_strand": bool, "seq_type": str}
_SEARCH = {"pattern": list, "pattern_file": str, "use_regexp": bool, "degenerate": bool, "ignore_case": bool, "only_positive_strand": bool, "circular": bool, "max_mismatch": int, "seq_type": str}

COMMANDS: dict[str, Command] = {
    "common": Command(lambda s, d, o: O.common(*d, **_keyed(o)), "several", options=_STRANDS),
    "concat": Command(_concat, "several", options={"full": bool, "separator": str}),
    "duplicate": Command(lambda s, d, o: O.duplicate(d[0], 1 if o.get("times") is None else o["times"]), options={"times": int}),
    "fa2fq": Command(lambda s, d, o: O.fa2fq(d[0], fastx.read_fasta(s, _needed(o, "fasta_file")), both_strands=not o.get("only_positive_strand")), options={"fasta_file": str, "only_positive_strand": bool}),
    "faidx": Command(_faidx, "one", "auto", {"region": list, "region_file": str, "use_regexp": bool, "ignore_case": bool, "full_head": bool}),
    "fq2fa": Command(lambda s, d, o: O.fq2fa(d[0])),
    "grep": Command(_grep, "joined", "auto", _SEARCH | {"by_name": bool, "by_seq": bool, "delete_matched": bool, "invert_match": bool, "count": bool, "region": str}),
    "head": Command(lambda s, d, o: O.head(d[0], 10 if o.get("number") is None else o["number"]), options={"number": int}),
    "head-genome": Command(lambda s, d, o: O.head_genome(d[0], o.get("mini_common_words") or 1), options={"mini_common_words": int}),
    "locate": Command(_locate, "joined", "lines", _SEARCH | {"use_fmi": bool, "non_greedy": bool, "gtf": bool, "bed": bool, "hide_matched": bool}),
    "pair": Command(lambda s, d, o: O.pair(*d), "two", "pairs", {"save_unpaired": bool, "force": bool}),
    "range": Command(lambda s, d, o: O.record_range(d[0], _needed(o, "range")), options={"range": str}),
    "rename": Command(lambda s, d, o: O.rename(d[0], by="name" if o.get("by_name") else "id"), options={"by_name": bool}),
    "replace": Command(_replace, options={"pattern": str, "replacement": str, "nr_width": int, "by_seq": bool, "ignore_case": bool, "kv_file": str, "keep_untouch": bool, "keep_key": bool, "key_capt_idx": int, "key_miss_repl": str}),
    "rmdup": Command(lambda s, d, o: O.rmdup(d[0], **_keyed(o)), "joined", options=_STRANDS | {"dup_seqs_file": str, "dup_num_file": str}),
    "sample": Command(lambda s, d, o: O.sample(d[0], proportion=o.get("proportion"), number=o.get("number"), seed=11 if o.get("seed") is None else o["seed"]), "one", options={"proportion": float, "number": int, "seed": int}),
    "seq": Command(_seq, "per", "auto", {k: bool for k in ("reverse", "complement", "name", "seq", "qual", "only_id", "remove_gaps", "lower_case", "upper_case", "dna2rna", "rna2dna", "validate_seq")} | {"gap_letters": str, "min_len": int, "max_len": int, "min_qual": float, "max_qual": float, "seq_type": str, "validate_seq_length": int, "qual_ascii_base": int}),
    "shuffle": Command(lambda s, d, o: O.shuffle(d[0], 23 if o.get("seed") is None else o["seed"]), options={"seed": int}),
    "sort": Command(_sort, "joined", options={"natural_order": bool, "by_seq": bool, "by_name": bool, "by_length": bool, "by_bases": bool, "reverse": bool, "ignore_case": bool, "seq_prefix_length": int}),
    "stats": Command(lambda s, d, o: O.stats(d[0], all=bool(o.get("all")), gap_letters=o.get("gap_letters") or "- .", encoding=o.get("fq_encoding") or "sanger", label=o["label"]), "each", "table", {"all": bool, "tabular": bool, "gap_letters": str, "fq_encoding": str}),
    "subseq": Command(_subseq, options={"region": str, "gtf": str, "bed": str, "chr": list, "feature": list, "up_stream": int, "down_stream": int, "only_flank": bool, "gtf_tag": str}),
    "translate": Command(_translate, "per", "auto", {"transl_table": int, "frame": list, "trim": bool, "clean": bool, "allow_unknown_codon": bool, "init_codon_as_M": bool, "append_frame": bool, "seq_type": str, "list_transl_table": int, "list_transl_table_with_amb_codons": int}),
}
#: The usual short names of options; an upper-case or doubled meaning depends on the command.
_KEYED = {"by_name": "n", "by_seq": "s", "ignore_case": "i", "only_positive_strand": "P"}
_FOUND = {"pattern": "p", "pattern_file": "f", "use_regexp": "r", "degenerate": "d", "ignore_case": "i", "only_positive_strand": "P", "max_mismatch": "m", "circular": "c"}
SHORT: dict[str, dict[str, str]] = {
    "common": _KEYED,
    "concat": {"full": "f", "separator": "s"},
    "duplicate": {"times": "n"},
    "fa2fq": {"fasta_file": "f", "only_positive_strand": "P"},
    "faidx": {"use_regexp": "r", "ignore_case": "i", "full_head": "f", "region_file": "l"},
    "grep": _FOUND | _KEYED | {"invert_match": "v", "region": "R", "count": "C"},
    "head": {"number": "n"},
    "head-genome": {"mini_common_words": "m"},
    "locate": _FOUND | {"use_fmi": "F", "non_greedy": "G", "hide_matched": "M"},
    "pair": {"save_unpaired": "u", "force": "f"},
    "range": {"range": "r"},
    "rename": {"by_name": "n"},
    "replace": {"pattern": "p", "replacement": "r", "by_seq": "s", "ignore_case": "i", "kv_file": "k", "keep_untouch": "U", "keep_key": "K", "key_capt_idx": "I", "key_miss_repl": "m"},
    "rmdup": _KEYED | {"dup_seqs_file": "d", "dup_num_file": "D"},
    "sample": {"seed": "s", "number": "n", "proportion": "p"},
    "seq": {"reverse": "r", "complement": "p", "name": "n", "seq": "s", "qual": "q", "only_id": "i", "remove_gaps": "g", "gap_letters": "G", "lower_case": "l", "upper_case": "u", "validate_seq": "v",
            "validate_seq_length": "V", "min_len": "m", "max_len": "M", "qual_ascii_base": "b", "min_qual": "Q", "max_qual": "R"},
    "shuffle": {"seed": "s"},
    "sort": {"natural_order": "N", "by_name": "n", "by_seq": "s", "by_length": "l", "by_bases": "b", "reverse": "r", "ignore_case": "i", "seq_prefix_length": "L"},
    "stats": {"tabular": "T", "gap_letters": "G", "all": "a", "fq_encoding": "E"},
    "subseq": {"region": "r", "up_stream": "u", "down_stream": "d", "only_flank": "f"},
    "translate": {"transl_table": "T", "frame": "f", "allow_unknown_codon": "x", "init_codon_as_M": "M", "list_transl_table": "l", "list_transl_table_with_amb_codons": "L", "append_frame": "F"},
}
#: Long names that mean the same.
LONG = {"seed": ["--rand-seed"]}
ALIASES = {"concate": "concat", "dup": "duplicate"}


def run(spark: SparkSession, name: str, inputs: list[DataFrame], options: dict, labels: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """One command over its inputs."""
    command = COMMANDS[ALIASES.get(name, name)]
    unknown = set(options) - set(command.options)
    if unknown:
        raise TypeError(f"{name} has no option {sorted(unknown)}")
    if command.inputs == "one" and len(inputs) != 1:
        raise ValueError(f"{name} takes one input")
    if command.inputs == "two" and len(inputs) != 2:
        raise ValueError(f"{name} takes two inputs")
    if command.inputs == "several" and len(inputs) < 2:
        raise ValueError(f"{name} takes two inputs or more")
    if command.inputs in ("one", "two", "several"):
        return command.run(spark, inputs, options)
    if command.inputs == "joined":
        return command.run(spark, [O.union(*inputs, ordered=len(inputs) > 1) if len(inputs) > 1 else inputs[0]], options)
    results = [command.run(spark, [df], options | ({"label": label} if command.inputs == "each" else {})) for df, label in zip(inputs, labels or ["-"] * len(inputs))]
    return results[0] if len(results) == 1 else O.union(*results, ordered=ordered and command.output == "records" and command.inputs == "per")


def run_pipe(spark: SparkSession, node: dict, read: Callable[[str], DataFrame], parse: Callable[[list[str]], tuple[str, list[str], dict]]) -> DataFrame:
    """A tree {"pipe": [children], "cmd": [argv]}: the children's results are the inputs of their parent, before files that argv names."""
    name, files, options = parse(node["cmd"])
    inputs = [run_pipe(spark, child, read, parse) for child in node.get("pipe") or []] + [read(f) for f in files]
    return run(spark, name, inputs, options)

"""Command line: `python -m seqloom COMMAND [options] FILE...`."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import operators as O
from seqloom.plans.commands import ALIASES, COMMANDS, LONG, SHORT, Command, run, run_pipe
from seqloom.sources import fastx, sinks


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-o", "--out-file")
    common.add_argument("-w", "--line-width", type=int, default=60)
    common.add_argument("--id-regexp")
    common.add_argument("--id-ncbi", action="store_true")
    common.add_argument("--infile-list")
    common.add_argument("--merge", action="store_true", help="one file instead of a folder of parts")
    common.add_argument("--partitions", type=int, default=0)
    common.add_argument("--order", action="store_true", help="keep the order of the inputs")
    common.add_argument("--alphabet-guess-seq-length", type=int, default=10_000, help="letters of the first record that tell the sequence type; 0: all")
    common.add_argument("--quiet", action="store_true")
    common.add_argument("--multi-line", action="store_true", help="FASTQ records may span lines")
    top = argparse.ArgumentParser(prog="seqloom")
    subs = top.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        sub = subs.add_parser(name, parents=[common], aliases=[a for a, n in ALIASES.items() if n == name])
        for option, kind in command.options.items():
            flags = ["--" + option.replace("_", "-"), *LONG.get(option, ())]
            if short := SHORT.get(name, {}).get(option):
                flags.insert(0, "-" + short)
            if option == "seq_type":
                sub.add_argument("-t", *flags, dest="opt_seq_type", choices=["auto", "dna", "rna", "protein", "unlimit"])
            elif kind is bool:
                sub.add_argument(*flags, dest=f"opt_{option}", action="store_true", default=None)
            elif kind is list:
                sub.add_argument(*flags, dest=f"opt_{option}", action="append")
            else:
                sub.add_argument(*flags, dest=f"opt_{option}", type=kind)
        sub.add_argument("files", nargs="*")
    pipe = subs.add_parser("pipe", parents=[common])
    pipe.add_argument("job", help="a JSON tree of commands")
    return top


def options_of(args: argparse.Namespace) -> dict:
    return {k[4:]: v for k, v in vars(args).items() if k.startswith("opt_") and v is not None}


def out_path(args: argparse.Namespace, files: list[str]) -> str:
    """-o, else <input>-out, else $SEQLOOM_JOB_NAME-out."""
    if args.out_file:
        return args.out_file
    if len(files) == 1:
        return files[0].rstrip("/") + "-out"
    if os.environ.get("SEQLOOM_JOB_NAME"):
        return os.environ["SEQLOOM_JOB_NAME"] + "-out"
    raise SystemExit("an output is needed: -o")


def store(df: DataFrame, path: str, args: argparse.Namespace, kind: str = "auto") -> None:
    order = "ordinal" if "ordinal" in df.columns else None
    if {"name", "seq", "qual"} <= set(df.columns):
        value = sinks.fastx_text(args.line_width)
    elif "value" in df.columns:
        value = F.col("value")
    else:
        value = F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])
    sinks.write_text(df, value, path, order, args.merge, args.partitions or None)


def stats_table(df: DataFrame, tabular: bool) -> str:
    """The rows as text: tab-separated, or in columns with thousands separators. One row per input."""
    rows = df.collect()
    cells = [[c.replace("Q20", "Q20(%)").replace("Q30", "Q30(%)") for c in df.columns if c != "L50"]]
    for r in rows:
        cells.append([str(r[c]) if tabular or isinstance(r[c], str) else f"{r[c]:,}" for c in df.columns if c != "L50"])
    if tabular:
        return "\n".join("\t".join(row) for row in cells)
    widths = [max(len(row[i]) for row in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(x.ljust(w) if i < 3 else x.rjust(w) for i, (x, w) in enumerate(zip(row, widths))).rstrip() for row in cells)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.appName("seqloom").getOrCreate()

    def read(path: str) -> DataFrame:
        options = {"id_regexp": args.id_regexp, "ncbi": args.id_ncbi}
        if path.rstrip("/").endswith(".parquet"):
            return spark.read.parquet(path)
        if fastx.sniff(spark, path) == "fasta":
            return fastx.read_fasta(spark, path, **options, with_raw=args.command == "faidx")
        return fastx.read_fastq(spark, path, **options, multi_line=args.multi_line, with_raw=args.command == "faidx" and not args.multi_line)

    if args.command == "pipe":
        def parse(cmd: list[str]) -> tuple[str, list[str], dict]:
            a = top.parse_args(cmd)
            return a.command, a.files, options_of(a)

        job = "\n".join(r.value for r in spark.read.text(args.job, wholetext=True).collect())
        store(run_pipe(spark, json.loads(job), read, parse), out_path(args, []), args)
        return
    command, options = COMMANDS[ALIASES.get(args.command, args.command)], options_of(args)
    files = [*args.files, *(fastx.read_list(spark, args.infile_list) if args.infile_list else [])]
    if command.output == "table" and not files:
        raise SystemExit("an input is needed")
    listing = any(k.startswith("list_transl") for k in options)
    regions = files[1:] if args.command == "faidx" else []
    if regions:
        files, options = files[:1], options | {"region": [*options.get("region", []), *regions]}
    inputs = [None] if listing else [read(f) for f in files]
    if "seq_type" in command.options and options.get("seq_type", "auto") == "auto" and not listing and args.command != "seq":
        options["seq_type"] = O.seq_type(inputs[0], args.alphabet_guess_seq_length)
    several = any(options.get(k) for k in ("save_unpaired", "dup_seqs_file", "dup_num_file"))
    if several:  # more than one output: the inputs are read once
        inputs = [df.persist() for df in inputs]
    try:
        _put(spark, args, command, inputs, options, files)
    finally:
        for df in inputs if several else ():
            df.unpersist()


def _put(spark: SparkSession, args: argparse.Namespace, command: Command, inputs: list[DataFrame], options: dict, files: list[str]) -> None:
    """Runs a command and stores or prints what it gives, side files included."""
    result = run(spark, args.command, inputs, options, files, args.order)
    if command.output == "table":
        print(stats_table(result, bool(options.get("tabular"))))
    elif command.output == "pairs":
        left = O.unpaired(*inputs) if options.get("save_unpaired") else None
        sinks.write_pairs(result, left, out_path(args, []), args.line_width, bool(options.get("force")))
    else:
        store(result, out_path(args, files), args)
        keyed = {"by": "seq" if options.get("by_seq") else "name" if options.get("by_name") else "id", "ignore_case": bool(options.get("ignore_case")), "both_strands": not options.get("only_positive_strand"), "seq_type": options.get("seq_type", "auto")}
        whole = inputs[0] if len(inputs) == 1 else O.union(*inputs, ordered=True) if args.command == "rmdup" else None
        if options.get("dup_seqs_file"):
            store(O.rmdup_removed(whole, **keyed), options["dup_seqs_file"], args)
        if options.get("dup_num_file"):
            store(O.rmdup_counts(whole, **keyed).select(F.concat_ws("\t", F.col("n").cast("string"), "ids").alias("value")), options["dup_num_file"], args)

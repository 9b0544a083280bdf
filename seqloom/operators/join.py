"""Operators on two or more inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators.keys import ONE_STRAND, group_key
from seqloom.sources.tables import parse_region


#: Features of one chromosome that travel together.
FEATURES = 10_000
#: Records of an id, and bytes of their sequences and qualities, that a cell of concat has of either input; pairs that are one task's work.
CELL, CELL_BYTES, TASK_PAIRS, MOST_TASKS = 1024, 32 << 20, 1 << 20, 50_000


def common(first: DataFrame, *others: DataFrame, by: str = "id", ignore_case: bool = False, both_strands: bool = True, seq_type: str = "auto") -> DataFrame:
    """Records of the first input whose key is in all others, repeated ones too."""
    if not others:
        raise ValueError("at least two inputs are needed")
    key = group_key(by, ignore_case, both_strands and seq_type not in ONE_STRAND)
    out = first.withColumn("__key", key)
    for other in others:
        out = out.join(other.select(key.alias("__key")).distinct(), "__key", "left_semi")
    return out.drop("__key")


def _cells(df: DataFrame, side: str) -> DataFrame:
    """Ids whose records don't fit one cell, and the number of parts that they go in."""
    letters = F.sum(F.coalesce(F.octet_length("seq"), F.lit(0)) + F.coalesce(F.octet_length("qual"), F.lit(0)))
    return df.groupBy("id").agg(F.ceil(F.greatest(F.count("*") / CELL, letters / CELL_BYTES)).cast("int").alias(f"__parts_{side}")).where(F.col(f"__parts_{side}") > 1)


def concat(a: DataFrame, b: DataFrame, *, full: bool = False, separator: str = "|") -> DataFrame:
    """For each id all pairs of records: sequences and qualities appended, descriptions joined by the separator.

    full keeps records without a partner. ordinal: that of the first input, else of the second; ordinal_b: of the second.

    The pairs of a frequent id are a grid of cells with a bounded part of the records of either input, and the number of tasks
    follows that of the pairs: no task holds all records of an id or writes all its pairs.
    """
    fields = ("ordinal", "name", "descr", "seq", "qual")
    counts = [df.groupBy("id").agg(F.count("*").alias(n)) for df, n in ((a, "__m"), (b, "__n"))]
    pairs = counts[0].join(counts[1], "id").agg(F.sum(F.col("__m") * F.col("__n"))).first()[0] or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-pairs // TASK_PAIRS), MOST_TASKS))
    cells = _cells(a, "a"), _cells(b, "b")
    number = lambda x: F.coalesce(F.col(f"__parts_{x}"), F.lit(1))
    sides = []
    for df, x, y in ((a, "a", "b"), (b, "b", "a")):
        df = df.select("id", *fields).join(cells[0], "id", "left").join(cells[1], "id", "left")
        df = df.withColumn(f"__{x}", F.pmod(F.xxhash64("ordinal"), number(x)).cast("int")).withColumn(f"__{y}", F.explode(F.sequence(F.lit(0), number(y) - 1)))
        df = df.select("id", "__a", "__b", (number(y) > 1).alias(f"__paired_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in fields])
        sides.append(df.repartition(tasks, "id", "__a", "__b"))
    rows = sides[0].join(sides[1], ["id", "__a", "__b"], "full" if full else "inner")
    has_a, has_b = F.col("__paired_a").isNotNull(), F.col("__paired_b").isNotNull()
    if full:
        # an id of which the other input fills several cells has partners, though one of those cells may be empty
        rows = rows.where((has_a | ~F.col("__paired_b")) & (has_b | ~F.col("__paired_a")))
    both = has_a & has_b
    merged = lambda c, *between: F.when(both, F.concat(f"{c}_a", *between, f"{c}_b")).otherwise(F.coalesce(f"{c}_a", f"{c}_b"))
    descr = merged("descr", F.lit(separator))
    return rows.select(
        F.coalesce("ordinal_a", "ordinal_b").alias("ordinal"), "ordinal_b", "id", F.when(both, F.concat("id", F.lit(" "), descr)).otherwise(F.coalesce("name_a", "name_b")).alias("name"),
        descr.alias("descr"), merged("seq").alias("seq"), merged("qual").alias("qual"),
    )


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy("ordinal")))


def pair(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """ordinal, id, r1, r2: the k-th record of an id in one input with the k-th in the other."""
    fields = ("ordinal", "id", "name", "descr", "seq", "qual")
    left = _numbered(r1).select("id", "__k", F.struct(*fields).alias("r1"))
    right = _numbered(r2).select("id", "__k", F.struct(*fields).alias("r2"))
    return left.join(right, ["id", "__k"]).select(F.col("r1.ordinal").alias("ordinal"), "id", "r1", "r2")


def pick(pairs: DataFrame, side: int) -> DataFrame:
    """The records of one side, 0 or 1."""
    return pairs.select("r1.*" if side == 0 else "r2.*")


def unpaired(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """side (1 or 2) and the records that pair() leaves out."""
    one, two = _numbered(r1), _numbered(r2)
    out = [x.join(y.select("id", "__k"), ["id", "__k"], "left_anti").drop("__k").select(F.lit(side).alias("side"), "*") for side, x, y in ((1, one, two), (2, two, one))]
    return out[0].unionByName(out[1], allowMissingColumns=True)


def fa2fq(fq: DataFrame, fa: DataFrame, *, both_strands: bool = True) -> DataFrame:
    """The part of each FASTQ record that equals the FASTA sequence of its id, else the part of its reverse complement. Header: the id."""
    parts = fa.groupBy("id").agg(F.max_by("seq", "ordinal").alias("__part")) if "ordinal" in fa.columns else fa.select("id", F.col("seq").alias("__part"))
    rows = fq.join(parts, "id")
    rows = rows.withColumn("qual", F.when(F.col("qual").isNull(), F.raise_error(F.lit("records need qualities here")).cast("string")).otherwise(F.col("qual")))
    size = F.length("__part")
    found = F.when(F.contains("seq", "__part"), F.struct(F.col("seq").alias("s"), F.col("qual").alias("q"), F.lit("+").alias("strand")))
    if both_strands:
        turned = S.revcomp(F.col("seq"))
        found = found.when(F.contains(turned, F.col("__part")), F.struct(turned.alias("s"), F.reverse("qual").alias("q"), F.lit("-").alias("strand")))
    rows = rows.withColumn("__hit", found).where(F.col("__hit").isNotNull())
    at = F.when(size == 0, 1).otherwise(F.call_function("locate", F.col("__part"), F.col("__hit.s")))
    return rows.select("ordinal", "id", F.col("id").alias("name"), F.lit("").alias("descr"), F.substring(F.col("__hit.s"), at, size).alias("seq"), F.substring(F.col("__hit.q"), at, size).alias("qual"))


def subseq_features(
    df: DataFrame, features: DataFrame, *, up: int = 0, down: int = 0, only_flank: bool = False, chrs: list[str] | None = None, feature_types: list[str] | None = None,
    tag: str = "gene_id",
) -> DataFrame:
    """The sequence of every feature (chr, s, e, strand, and feat or type and attributes), on its strand, with or without flanks.

    Limits are kept within the sequence; where nothing is left the sequence is empty. Name: `id_s-e:strand` with `_us:`, `_ds:`, `_usf:` or `_dsf:`
    for flanks, then the feature's name or tag. Chromosome names are compared without case.
    """
    if only_flank and (up > 0) == (down > 0):
        raise ValueError("only_flank needs one of up and down")
    if feature_types and "type" not in features.columns:
        raise ValueError("BED features have no types")
    if feature_types:
        features = features.where(F.lower("type").isin([t.lower() for t in feature_types]))
    if chrs:
        features = features.where(F.lower("chr").isin([c.lower() for c in chrs]))
    label = F.coalesce(F.try_element_at("attributes", F.lit(tag)), F.lit("")) if "attributes" in features.columns else F.coalesce("feat", F.lit(""))
    spots = features.select(F.lower("chr").alias("__chr"), F.col("s").alias("__s"), F.col("e").alias("__e"), F.coalesce("strand", F.lit(".")).alias("__strand"), label.alias("__label"))
    # features of a chromosome come in arrays of about FEATURES: its sequence is sent once for each array, and cut where it is
    many = spots.groupBy("__chr").agg(F.ceil(F.count("*") / FEATURES).cast("int").alias("__arrays"))
    packed = spots.join(many, "__chr").groupBy("__chr", F.pmod(F.xxhash64("__s", "__e", "__strand", "__label"), F.col("__arrays")).alias("__array"))
    packed = packed.agg(F.collect_list(F.struct("__s", "__e", "__strand", "__label")).alias("__spots")).drop("__array")
    rows = df.join(packed, F.lower("id") == F.col("__chr")).withColumn("__spot", F.explode("__spots")).select(*df.columns, "__spot.*")
    s, e, minus = F.col("__s"), F.col("__e"), F.col("__strand") == "-"
    if only_flank and up > 0:
        begin, end = F.when(minus, e + 1).otherwise(s - up), F.when(minus, e + up).otherwise(s - 1)
    elif only_flank:
        begin, end = F.when(minus, s - down).otherwise(e + 1), F.when(minus, s - 1).otherwise(e + down)
    else:
        begin, end = F.when(minus, s - down).otherwise(s - up), F.when(minus, e + up).otherwise(e + down)
    begin, end = F.greatest(begin, F.lit(1)), F.least(end, F.length("seq"))
    flank = f"_usf:{up}" if only_flank and up else f"_dsf:{down}" if only_flank else (f"_us:{up}" if up else "") + (f"_ds:{down}" if down else "")
    name = F.concat("id", F.lit("_"), s.cast("string"), F.lit("-"), e.cast("string"), F.lit(":"), F.col("__strand"), F.lit(flank), F.lit(" "), F.col("__label"))
    part = lambda c: S.cut(F.col(c), begin, end)
    rows = rows.withColumns({"name": name, "__seq": part("seq"), "__qual": part("qual")})
    return rows.select("ordinal", F.col("name").alias("id"), "name", F.lit("").alias("descr"), F.when(minus, S.revcomp(F.col("__seq"))).otherwise(F.col("__seq")).alias("seq"), F.when(minus, F.reverse("__qual")).otherwise(F.col("__qual")).alias("qual"))


def faidx_query(df: DataFrame, regions: list[str], *, use_regexp: bool = False, ignore_case: bool = False, full_head: bool = False) -> DataFrame:
    """For each region and record it names: ordinal, region, head, seq.

    A whole record or `b-` with a negative end: the head alone; else `head:b-e`. With b above e the reverse complement of e to b. Regions without letters give nothing.
    """
    if not regions:
        raise ValueError("regions are needed")
    parsed = [(r, *parse_region(r)) for r in regions]
    rows = df.sparkSession.createDataFrame(parsed, "region string, __id string, __b long, __e long")
    target = F.col("name" if full_head else "id")
    wanted = F.col("__id")
    if use_regexp:
        fits = F.rlike(target, F.concat(F.lit("(?i)" if ignore_case else ""), wanted))
    else:
        fits = F.lower(target) == F.lower(wanted) if ignore_case else target == wanted
    found = df.join(rows, fits)
    b, e, length = F.col("__b"), F.col("__e"), F.length("seq")
    whole = (b > 0) & (e < 0)
    turned = ~whole & (b > e)
    low, high = F.when(turned, e).otherwise(b), F.when(turned, b).otherwise(e)
    begin, end = S.sub_location(length, low, high)
    part = S.cut(F.col("seq"), begin, end)
    head = F.when(whole, target).otherwise(F.concat(target, F.lit(":"), b.cast("string"), F.lit("-"), e.cast("string")))
    return found.where(begin <= end).select("ordinal", "region", head.alias("head"), F.when(turned, S.revcomp(part)).otherwise(part).alias("seq"))

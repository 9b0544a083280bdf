"""URL filter: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpointed, hash_sample

#: Of features that split equally well a tree takes the first: what labels say of names goes before lengths and counts.
FEATURES = (
    "suffix_odds", "domain_odds", "suffix_share", "domain_share", "url_length", "host_length", "path_length", "host_depth",
    "path_depth", "digit_ratio", "host_digit_ratio", "entropy", "n_params", "n_hyphens",
)


@dataclass(frozen=True)
class Rule:
    """`net/` or `example.net/en/`: fits the host before the first slash and its subdomains, and paths that start with the rest."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """`rule` or `verdict` of the longest rule that fits (of equally long ones the first by text), else null.

    The rules are a parameter of the query and become one expression; meant for up to some thousands of them.
    """
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), [-ord(c) for c in r.rule])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, what))).otherwise(found)
    return found


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits per character, over the distinct characters."""
    size = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    bits = F.aggregate(each, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.when(size > 0, bits).otherwise(F.lit(0.0))


def domain_of(labels: Column) -> Column:
    """The last two labels of a host."""
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def lexical(urls: DataFrame, url_col: str) -> DataFrame:
    """Adds host, path and the lexical features (named __f_...) that need no statistics, and the suffix and domain."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    out = urls.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    labels = F.split("host", r"\.")
    out = out.withColumns({"__suffix": F.element_at(labels, -1), "__domain": domain_of(labels)})
    query = F.regexp_extract(url, r"(?s)\A[^?#]*\?([^#]*)", 1)
    values = {
        "url_length": F.length(url),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "host_depth": F.size(labels),
        "path_depth": F.regexp_count("path", F.lit("/[^/]")),
        "digit_ratio": _ratio(digits(url), F.length(url)),
        "host_digit_ratio": _ratio(digits(F.col("host")), F.length("host")),
        "entropy": _entropy(url),
        "n_params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("[&;]")) + 1),
        "n_hyphens": F.regexp_count("host", F.lit("[-_]")),
    }
    return out.withColumns({f"__f_{k}": v.cast("double") for k, v in values.items()})


@dataclass(frozen=True)
class UrlModel:
    """trees: the fitted model, or None where the labels had one class only, which `constant` then gives.

    suffixes, domains: tables of name, share and odds over all labelled urls; names without a row have 0 for both.
    """

    trees: GBTClassificationModel | None
    constant: float
    suffixes: DataFrame | None
    domains: DataFrame | None

    def vector(self, rows: DataFrame) -> DataFrame:
        for name, known in (("suffix", self.suffixes), ("domain", self.domains)):
            known = known.select(F.col("name").alias(f"__{name}_name"), F.col("share").alias(f"__f_{name}_share"), F.col("odds").alias(f"__f_{name}_odds"))
            rows = rows.join(known, F.col(f"__{name}") == F.col(f"__{name}_name"), "left").drop(f"__{name}_name")
        rows = rows.fillna(0.0, [f"__f_{n}_{k}" for n in ("suffix", "domain") for k in ("share", "odds")])
        return VectorAssembler(inputCols=[f"__f_{f}" for f in FEATURES], outputCol="__features").transform(rows)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most_rows: int = 10_000, rounds: int = 10, depth: int = 3, seed: int = 7) -> UrlModel:
    """Fits the trees on labelled urls; label 1 means block.

    Suffix and domain statistics (share of the rows, smoothed log odds of block) are counted over all labelled rows and kept as
    tables. The trees see at most `most_rows` different pairs of url and label, those with the smallest hash: a bounded sample,
    a parameter. Rows with a null label or url are left out.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull())
    rows = rows.select(F.col(url_col).cast("string").alias("__url"), F.col(label_col).cast("double").alias("__label"))
    total, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0.0))).first()
    if not 0 < blocked < total:
        return UrlModel(None, 1.0 if total and blocked == total else 0.0, None, None)

    def known(names: DataFrame) -> DataFrame:
        counts = names.groupBy("name").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        odds = F.log((F.col("b") + 0.5) / (F.col("n") - F.col("b") + 0.5))
        return checkpointed(counts.select("name", (F.col("n") / F.lit(total)).alias("share"), odds.alias("odds")))

    labels = F.split(host_of(F.col("__url")), r"\.")
    domains = rows.select(domain_of(labels).alias("name"), F.col("__label").alias("b"), F.lit(1).alias("n"))
    domains = checkpointed(domains.groupBy("name").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    suffix = F.element_at(F.split("name", r"\."), -1)
    model = UrlModel(None, blocked / total, known(domains.withColumn("name", suffix)), known(domains))
    sample = lexical(hash_sample(rows, F.concat_ws(" ", "__url", F.col("__label").cast("string")), most_rows, seed), "__url")
    fit = GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=rounds, maxDepth=depth, seed=seed, checkpointInterval=-1)
    # one partition: a bounded sample, and the same trees whatever the partitioning
    trees = fit.fit(model.vector(sample).select("__features", "__label").repartition(1).sortWithinPartitions(F.xxhash64(vector_to_array("__features")), "__label"))
    return UrlModel(trees, model.constant, model.suffixes, model.domains)


def judge(urls: DataFrame, rules: list[Rule], model: UrlModel, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score (the model's probability of block) and verdict (`allow` or `block`).

    The verdict is the rule's where one fits, else block from `threshold` on. Input columns with the added names are replaced.
    Null, empty and malformed urls have empty host and path and are judged by the model like any other; repeated rows
    are judged alike; an empty table gives an empty table.
    """
    added = {"host", "path", "rule", "score", "verdict"}
    kept = [c for c in urls.columns if c not in added]
    rows = lexical(urls.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(kept)], F.col(url_col).cast("string").alias("__url")), "__url")
    rows = rows.withColumns({w: match_rule(F.col("host"), F.col("path"), rules, w) for w in ("rule", "verdict")})
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(float(model.constant)))
    else:
        rows = model.trees.transform(model.vector(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    verdict = F.coalesce(F.col("verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return rows.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", "score", verdict.alias("verdict"))

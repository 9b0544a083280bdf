"""One query per operator, over the whole of its table, and DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import small_batches, table, text_or_empty

#: The rules of the URL query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.sharding import shard

    placed = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    return placed.select(
        "doc_id",
        (F.octet_length(text_or_empty("text")) + 16).cast("long").alias("size"),
        F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.token_output import token_digest

    return token_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.token_counts import count_tokens

    small_batches(spark)
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.substring_dedup import remove_repeats

    small_batches(spark)
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), k=13, columns=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.url_filter import Rule, host_of, judge, match_rule, path_of, train

    rules = [Rule(*r) for r in RULES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    by_rule = match_rule(host_of(F.col("url")), path_of(F.col("url")), rules, "verdict")
    labelled = pages.select("url", by_rule.alias("said")).where("said is not null").select("url", (F.col("said") == "block").cast("int").alias("label"))
    return judge(pages, rules, train(labelled)).select("page_id", "host", "path", "rule", "verdict")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=80)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.decontam import find_contaminated

    return find_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.langid import identify, train

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.llm.exact_dedup import exact_dedup, normalised

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(normalised(), 256).alias("text_sha256"))
    return exact_dedup(docs, carry=("text_sha256",))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_sharding, op3_token_output, op4_token_counts, op5_substring_dedup, op6_url_filter, op7_near_dedup, op8_decontamination, op9_language_id, op10_exact_dedup)}

_WORDS = r"'[^\x20\x09-\x0D]+'"
_SPACES = r"'[\x20\x09-\x0D]+'"

SQL = {
    "op1_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
         md5(coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(length(text) || ':' || text, '-')) AS h FROM documents),
b AS (SELECT *, CASE WHEN size < 32 THEN size ELSE (length(bin(size)) - 5) * 32 + (size >> (length(bin(size)) - 5)::BIGINT) END AS bin FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM w),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
t AS (SELECT *, least(cap, coalesce(first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
              OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, cap)) AS target FROM f),
r AS (SELECT b.doc_id, b.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             CAST('0x' || substr(md5('11:' || coalesce(b.source, chr(0) || 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
             row_number() OVER (PARTITION BY b.source ORDER BY b.bin, substr(b.h, 1, 2), b.size, b.h) AS k
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(u + rate * k) - floor(u + rate * (k - 1))) * size AS BIGINT) AS taken FROM r
""",
    "op5_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
k AS (SELECT doc_id, i, list_aggregate(ws[i:i+12], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (s) WHERE first < doc_id),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
g AS (SELECT doc_id, count(*) FILTER (c.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.p) FILTER (c.p IS NULL) AS kept
      FROM t LEFT JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
""",
    "op7_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i+3], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id, least(n.doc_id, coalesce(m.b, n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN m ON m.a = n.doc_id
""",
    "op8_decontamination": rf"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), {_WORDS}) AS ws FROM documents),
v AS (SELECT item_id AS id, regexp_extract_all(lower(coalesce(text, '')), {_WORDS}) AS ws FROM benchmark),
l AS (SELECT DISTINCT least(len(ws), 5) AS n FROM v WHERE len(ws) > 0),
ds AS (SELECT DISTINCT id, n, list_aggregate(ws[i:i+n-1], 'string_agg', ' ') AS s FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w JOIN l ON len(ws) >= n)),
bs AS (SELECT DISTINCT id, n, list_aggregate(ws[i:i+n-1], 'string_agg', ' ') AS s FROM (SELECT id, ws, least(len(ws), 5) AS n, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM v WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS n_shared, max(n.n) AS n_item, count(*) / max(n.n) AS containment
FROM ds JOIN bs ON ds.s = bs.s AND ds.n = bs.n JOIN n ON n.id = bs.id GROUP BY ds.id, bs.id HAVING count(*) / max(n.n) >= 0.8
""",
    "op10_exact_dedup": rf"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), {_SPACES}, ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
}

"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes.

Method: each distinct url is expanded into the expressions (last L labels of the host) + (first P characters of
the path) for the shapes (L, P) that rules have. An expression meets a rule when the first 8 hex digits of their
SHA-256 are equal (equi-join) and then the full digests are; the longest rule that fits decides.

Defined cases: a null url, one without ``://`` and an empty url have an empty host and path and the default
verdict. Repeated rows are all kept. An empty table gives an empty result. Columns of the input that are named like
a result column are replaced. Rules of equal length: the longer host wins, then ``block``. Equal rules with both
verdicts block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH_PREFIX = 8

#: The rules that the query's contract states: verdict, host, path.
QUERY_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. rules: verdict, host, path.

    The shapes of rules (labels of the host, length of the path) come to the driver: DNS allows 127 labels and the
    distinct path lengths of a rule list are few, so this doesn't grow with pages. Rules join by plain equality;
    Spark broadcasts them only below its own size threshold.
    """
    rules = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
        .select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
    )
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("l"), F.length("path").alias("p")).distinct().collect()
    labels = F.split("__host", r"\.", -1)
    expressions = [
        F.when(
            (F.size(labels) >= s["l"]) & (F.length("__path") >= s["p"]),
            F.concat(F.array_join(F.slice(labels, -s["l"], s["l"]), "."), F.substring("__path", 1, s["p"])),
        )
        for s in sorted(shapes)
    ] or [F.lit(None).cast("string")]
    urls = pages.select(F.col(url).alias("__url")).where(F.col("__url").contains("://")).distinct()
    expanded = (
        urls.withColumns({"__host": url_host(F.col("__url")), "__path": url_path(F.col("__url"))})
        .select("__url", F.explode(F.array_compact(F.array(*expressions))).alias("__expr"))
        .withColumn("__digest", F.sha2("__expr", 256))
        .select("__url", "__digest", F.substring("__digest", 1, HASH_PREFIX).alias("__prefix"))
    )
    digested = rules.select(
        F.concat("host", "path").alias("__rule"), "verdict", F.length("host").alias("__hl"), F.sha2(F.concat("host", "path"), 256).alias("__rd")
    ).withColumn("__prefix", F.substring("__rd", 1, HASH_PREFIX))
    best = (
        expanded.join(digested, "__prefix")
        .where(F.col("__digest") == F.col("__rd"))
        .groupBy("__url")
        .agg(F.max(F.struct(F.length("__rule").alias("n"), "__hl", (F.col("verdict") == "block").alias("b"), "__rule")).alias("__best"))
        .select("__url", F.col("__best.__rule").alias("__rule"), F.when(F.col("__best.b"), "block").otherwise("allow").alias("__verdict"))
    )
    out = pages.withColumns({"__h": url_host(F.col(url)), "__p": url_path(F.col(url)), "__u": F.col(url)})
    out = out.join(best, out["__u"] == best["__url"], "left")
    return out.withColumns(
        {"host": F.col("__h"), "path": F.col("__p"), "rule": F.col("__rule"), "verdict": F.coalesce("__verdict", F.lit(default))}
    ).drop("__h", "__p", "__u", "__url", "__rule", "__verdict")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_table(spark, QUERY_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM q
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

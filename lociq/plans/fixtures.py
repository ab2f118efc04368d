"""Deterministic genome-like relations over the general tables.

Each is stated once, as SQL that Spark and DuckDB both run, apart from the sequences, whose text functions differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "ivl": """
SELECT concat('chr', CAST(l_suppkey % 8 AS STRING)) AS seqid,
       (l_orderkey*100003 + l_partkey*389 + l_linenumber*7) % 20000003 AS start0,
       (l_orderkey*100003 + l_partkey*389 + l_linenumber*7) % 20000003 + CAST(l_quantity AS BIGINT)*20 AS end0,
       l_linenumber AS line, CAST(l_extendedprice AS BIGINT) AS weight FROM lineitem""",
    "uivl": """
SELECT o_orderkey AS id, concat('chr', CAST(o_custkey % 8 AS STRING)) AS seqid, (o_orderkey*100003) % 20000003 AS start0,
       (o_orderkey*100003) % 20000003 + 200 + CAST(floor(o_totalprice/400) AS BIGINT) AS end0,
       o_orderpriority AS family, CAST(floor(o_totalprice) AS BIGINT) AS weight,
       CASE WHEN o_custkey % 3 = 0 THEN '+' WHEN o_custkey % 3 = 1 THEN '-' ELSE '.' END AS strand FROM orders""",
    "feature": """
SELECT concat('chr', CAST(user_id % 8 AS STRING)) AS seqid, (event_id*37) % 100003 AS start0,
       (event_id*37) % 100003 + 1 + CAST(floor(abs(value)) AS BIGINT) AS end0, event_type AS name, event_id AS ord FROM events""",
    "block": """
SELECT l_orderkey AS okey, l_linenumber AS line, concat('A_chr', CAST(l_suppkey % 5 AS STRING)) AS seq1, l_partkey*100 AS s1,
       l_partkey*100 + CAST(l_quantity AS BIGINT)*100 AS e1, concat('B_chr', CAST(o_custkey % 5 AS STRING)) AS seq2,
       o_custkey*120 AS s2, o_custkey*120 + CAST(l_quantity AS BIGINT)*90 AS e2,
       CASE WHEN l_linestatus='F' THEN '-' ELSE '+' END AS strand FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "member": """SELECT concat('fam', CAST(label AS STRING)) AS rep, vec_id AS member FROM embeddings""",
}

_SEQUENCE = "SELECT doc_id, translate(regexp_replace(lower(text),'[^a-z]',''{g}),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents"
DUCK = VIEWS | {"dna": _SEQUENCE.format(g=",'g'")}
SPARK = VIEWS | {"dna": _SEQUENCE.format(g="")}
TABLES = ["lineitem", "orders", "events", "embeddings", "documents", "customer", "part", "supplier", "nation", "region"]


def pieces(length: int, step: int = 1, block: int = 999, source: str = "dna") -> str:
    """SQL of (doc_id, i, piece): the strings of ``length`` letters that begin at 1, 1 + step, … of each sequence.

    Long sequences are cut into blocks first, since the text functions count letters from a text's start.
    """
    b = block - block % step
    blocks = f"SELECT doc_id, b, substr(seq, CAST(b * {b} + 1 AS INTEGER), {b + length - step}) AS s FROM (SELECT doc_id, seq, unnest(range((length(seq) + {b - 1}) // {b})) AS b FROM {source})"
    at = f"SELECT doc_id, b, s, unnest(range(1, length(s) - {length} + 2, {step})) AS i FROM ({blocks}) WHERE length(s) >= {length}"
    return f"SELECT doc_id, b * {b} + i AS i, substr(s, CAST(i AS INTEGER), {length}) AS piece FROM ({at})"


def with_views(sql: str) -> str:
    """The SQL with the views it names as common table expressions."""
    used = [v for v in DUCK if re.search(rf"\b{v}\b", sql)]
    views = ",\n".join(f"{v} AS ({DUCK[v]})" for v in used)
    sql = sql.strip()
    if not used:
        return sql
    return f"WITH {views},\n{sql[4:].lstrip()}" if sql.upper().startswith("WITH ") and not sql.upper().startswith("WITH RECURSIVE") else f"WITH {'RECURSIVE ' if sql.upper().startswith('WITH RECURSIVE') else ''}{views}" + (f",\n{sql[14:].lstrip()}" if sql.upper().startswith("WITH RECURSIVE") else f"\n{sql}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; its tables are bound as views of this call alone."""
    sql, bound = SPARK[name], {}
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            sql = re.sub(rf"\b{t}\b", f"{{{t}}}", sql)
            bound[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return spark.sql(sql, **bound)

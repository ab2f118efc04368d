"""Queries of the remaining steps: tandem and gene filters, element hits, loops over rounds, sampling, phasing."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions import stats as st
from ..operators import interval as iv
from ..operators import relational as rl
from .fixtures import pieces, view
from .registry import query

UNION = """{n} AS (SELECT id, sum(e - s) AS bp FROM (SELECT id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
 SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {t})) GROUP BY id, g) GROUP BY id)"""
INSIDE = "c AS (SELECT u.id, greatest(u.start0, i.start0) AS s, least(u.end0, i.end0) AS e FROM uivl u JOIN ivl i ON u.seqid = i.seqid AND u.start0 < i.end0 AND i.start0 < u.end0)"


def _inside(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").select("id", "seqid", "start0", "end0")
    return iv.covered_within(u, view(spark, sf_dir, "ivl"), "id", "seqid").withColumn("share", F.col("covered") / F.col("length"))


@query("a03_tandem_share", f"WITH {INSIDE}, {UNION.format(n='b', t='c')} SELECT u.id, round(coalesce(bp, 0) / (end0 - start0), 9) AS share FROM uivl u LEFT JOIN b USING (id)")
def tandem_share(spark, sf_dir):
    """i19 as well."""
    return _inside(spark, sf_dir).select("id", F.round("share", 9).alias("share"))


@query("f12_tandem_filter", f"WITH {INSIDE}, {UNION.format(n='b', t='c')} SELECT u.id, CASE WHEN coalesce(bp, 0) / (end0 - start0) >= 0.5 THEN 'tandem' ELSE 'kept' END AS reason FROM uivl u LEFT JOIN b USING (id)")
def tandem_filter(spark, sf_dir):
    """f11 as well: a fraction gate, what can't be judged is kept."""
    return _inside(spark, sf_dir).select("id", F.when(F.col("share") >= 0.5, "tandem").otherwise("kept").alias("reason"))


@query("f04_low_complexity", "SELECT doc_id, length(seq) - length(replace(seq, 'A', '')) AS a FROM dna WHERE length(seq) >= 100 AND (length(seq) - length(replace(seq, 'A', ''))) / length(seq) <= 0.35")
def low_complexity(spark, sf_dir):
    a = F.length("seq") - F.length(F.replace("seq", F.lit("A"), F.lit("")))
    return view(spark, sf_dir, "dna").where("length(seq) >= 100").where(a / F.length("seq") <= 0.35).select("doc_id", a.cast("bigint").alias("a"))


@query("f13_copy_counts", "WITH c AS (SELECT o_custkey AS og, o_orderstatus AS species, count(*) AS n FROM orders GROUP BY ALL), r(species, low, high) AS (VALUES ('F', 1, 3), ('O', 2, NULL), ('P', 0, 1)) SELECT og FROM (SELECT DISTINCT og FROM c) x CROSS JOIN r LEFT JOIN c USING (og, species) GROUP BY og HAVING bool_and(coalesce(n, 0) >= low AND (high IS NULL OR coalesce(n, 0) <= high))")
def copy_counts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("og")).agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])
    return c.where("F between 1 and 3 and O >= 2 and P <= 1").select("og")


@query("f14_chain_constraint", "WITH g AS (SELECT o_custkey AS og, o_orderstatus AS species, o_orderkey // 500 AS blk FROM orders) SELECT DISTINCT a.og FROM g a JOIN g b ON a.og = b.og AND a.species = 'F' AND b.species = 'O' AND a.blk = b.blk")
def chain_constraint(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("og"), "o_orderstatus", F.floor(F.col("o_orderkey") / 500).alias("blk"))
    a, b = (g.where(F.col("o_orderstatus") == s).select("og", "blk").distinct() for s in "FO")
    return a.join(b, ["og", "blk"], "left_semi").select("og").distinct()


@query("f15_range_filter", "SELECT id FROM uivl WHERE weight >= 10000 AND weight <= 200000")
def range_filter(spark, sf_dir):
    return view(spark, sf_dir, "uivl").where("weight >= 10000 and weight <= 200000").select("id")


@query("f17_block_length", "SELECT okey, line, s1 FROM block WHERE e1 - s1 >= 1000 AND e2 - s2 >= 1000 AND seq1 <> 'A_chr0'")
def block_length(spark, sf_dir):
    return view(spark, sf_dir, "block").where("e1 - s1 >= 1000 and e2 - s2 >= 1000 and seq1 <> 'A_chr0'").select("okey", "line", "s1")


@query("f22_header_cap", "SELECT min(c_custkey) AS first FROM customer WHERE length('>' || c_name || c_custkey) > 14")
def header_cap(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(F.length(F.concat(F.lit(">"), "c_name", "c_custkey")) > 14).agg(F.min("c_custkey").alias("first"))


@query("a16_element_hits", """
WITH k AS (SELECT doc_id, piece AS kmer FROM (""" + pieces(9) + """)),
s AS (SELECT kmer, CAST(doc_id % 2 AS BIGINT) AS sub FROM k GROUP BY kmer, doc_id % 2 HAVING count(*) >= 20 QUALIFY count(*) OVER (PARTITION BY kmer) = 1)
SELECT doc_id, sub, count(*) AS hits FROM k JOIN s USING (kmer) GROUP BY ALL""")
def element_hits(spark, sf_dir):
    """Markers of a subgenome are k-mers that are frequent in it and not in the other."""
    d = view(spark, sf_dir, "dna").select("doc_id", "seq", (F.col("doc_id") % 2).alias("sub"))
    frequent = sq.kmer_counts(d, "sub", "seq", 9).where("n >= 20").groupBy("kmer").agg(F.min("sub").alias("sub"), F.count("*").alias("subs")).where("subs = 1").drop("subs")
    # there are 4 ** 9 k-mers, so those of a text meet the frequent ones where they are counted
    return sq.counted_kmers(d, "doc_id", "seq", 9).join(F.broadcast(frequent), "kmer").groupBy("doc_id", "sub").agg(F.sum("n").alias("hits"))


@query("a31_fraction_gate", "SELECT round(avg(CASE WHEN p_size > 40 THEN 1.0 ELSE 0.0 END), 9) AS fraction, avg(CASE WHEN p_size > 40 THEN 1.0 ELSE 0.0 END) <= 0.25 AS pass FROM part")
def fraction_gate(spark, sf_dir):
    f = F.avg((F.col("p_size") > 40).cast("double"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.round(f, 9).alias("fraction"), (f <= 0.25).alias("pass"))


@query("a34_cluster_means", "SELECT rep, round(avg(member), 6) AS mean FROM member GROUP BY 1")
def cluster_means(spark, sf_dir):
    return view(spark, sf_dir, "member").groupBy("rep").agg(F.round(F.avg("member"), 6).alias("mean"))


@query("a24_bootstrap_median")
def bootstrap_median(spark, sf_dir):
    """Bounds of the medians of seeded Poisson resamples, one weighted pass; the draw is a hash, so it repeats."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20))))
    u = F.pmod(F.xxhash64("o_orderkey", "draw"), F.lit(1_000_000)) / 1_000_000
    n = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).otherwise(4)
    m = o.withColumn("n", n).where("n > 0").groupBy("o_orderpriority", "draw").agg(F.percentile("o_totalprice", 0.5, F.col("n")).alias("m"))
    return m.groupBy("o_orderpriority").agg(F.round(F.percentile("m", 0.025), 2).alias("low"), F.round(F.percentile("m", 0.975), 2).alias("high"))


@query("i14_collapsed_genes", """
WITH f AS (SELECT *, CASE WHEN start0 < max(end0) OVER (PARTITION BY seqid, strand ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM uivl),
g AS (SELECT *, sum(f) OVER (PARTITION BY seqid, strand ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT seqid, strand, min(start0) AS start0, max(end0) AS end0, arg_min(id, (start0, id)) AS name, count(*) AS n FROM g GROUP BY seqid, strand, g""")
def collapsed_genes(spark, sf_dir):
    """i13 as well: overlapping reads by strand, with their depth."""
    rows = iv.islands(view(spark, sf_dir, "uivl"), ["seqid", "strand"])
    return rows.groupBy("seqid", "strand", "island").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"), F.min_by("id", F.struct("start0", "id")).alias("name"), F.count("*").alias("n")).drop("island")


@query("s19_lifted_hits", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN c_custkey * 1000 + 10 ELSE c_custkey * 1000 + 990 - 50 END AS start0 FROM orders JOIN customer ON o_custkey = c_custkey")
def lifted_hits(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "c_custkey")
    at = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 1000 + 10).otherwise(F.col("c_custkey") * 1000 + 990 - 50)
    return o.join(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey").select("o_orderkey", at.alias("start0"))


@query("s26_distance_map", "SELECT o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS k2p FROM orders GROUP BY 1")
def distance_map(spark, sf_dir):
    """s32 as well: the last line of a key wins."""
    return rl.last_of(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("k2p"), "o_orderkey"), ["key"], ["o_orderkey"]).drop("o_orderkey")


@query("s14_finder_text", types={"similarity": "DOUBLE"}, sql="SELECT 'c' || (id % 5) AS seqid, start0 AS s, end0 AS e, CAST(id % 5 AS BIGINT) AS seq_nr, round(CASE WHEN id % 2 = 0 THEN 95.0 ELSE 90.0 END, 2) AS similarity FROM uivl")
def finder_text(spark, sf_dir):
    """A finder's rows below their > headers; similarities up to 1 are fractions."""
    u = view(spark, sf_dir, "uivl").withColumn("file", (F.col("id") % 50).cast("string"))
    head = u.select("file", F.col("id") % 5).distinct().toDF("file", "c").select("file", F.col("c").cast("bigint").alias("a"), F.lit(-1).cast("bigint").alias("b"), F.concat(F.lit(">c"), "c").alias("value"))
    body = u.select("file", (F.col("id") % 5).alias("a"), F.col("id").alias("b"), F.concat_ws("\t", F.concat(F.lit("["), "id", F.lit("]")), F.concat("start0", F.lit("-"), "end0"), F.when(F.col("id") % 2 == 0, "0.95").otherwise("90")).alias("value"))
    w = W.partitionBy("file").orderBy("a", "b").rowsBetween(W.unboundedPreceding, 0)
    rows = head.unionByName(body).withColumn("seqid", F.last(F.when(F.col("value").startswith(">"), F.substring("value", 2, 100)), ignorenulls=True).over(w))
    p = F.split("value", "\t")
    sim = F.get(p, 2).cast("double")
    rows = rows.where(F.col("value").startswith("["))
    return rows.select("seqid", F.regexp_extract(F.get(p, 1), r"^(\d+)-", 1).cast("bigint").alias("s"), F.regexp_extract(F.get(p, 1), r"-(\d+)$", 1).cast("bigint").alias("e"), F.regexp_extract("seqid", r"(\d+)", 1).cast("bigint").alias("seq_nr"), F.round(F.when(sim <= 1, sim * 100).otherwise(sim), 2).alias("similarity"))


@query("w06_letter_collisions", """
WITH x AS (SELECT s_nationkey AS n, s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 1 END AS letter FROM supplier), k AS (SELECT *, letter IS NOT NULL AND row_number() OVER (PARTITION BY n, letter ORDER BY id) = 1 AS keeps FROM x),
u AS (SELECT n, list(letter) AS used FROM k WHERE keeps GROUP BY n), r AS (SELECT k.*, row_number() OVER (PARTITION BY k.n ORDER BY letter IS NULL, id) AS r FROM k WHERE NOT keeps)
SELECT n, id, letter AS place FROM k WHERE keeps UNION ALL SELECT r.n, id, list_filter(range(r + len(coalesce(used, []))), lambda i: NOT list_contains(coalesce(used, []), i))[r] FROM r LEFT JOIN u USING (n)""")
def letter_collisions(spark, sf_dir):
    """The first of a letter keeps it; collisions, then those without one, take the next free letters."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x = s.select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, 0).when(F.col("s_suppkey") % 3 == 1, 1).alias("letter"))
    k = x.withColumn("keeps", F.col("letter").isNotNull() & (F.row_number().over(W.partitionBy("n", "letter").orderBy("id")) == 1))
    used = k.where("keeps").groupBy("n").agg(F.collect_set("letter").alias("used"))  # 26 letters at most
    rest = k.where("not keeps").withColumn("r", F.row_number().over(W.partitionBy("n").orderBy(F.col("letter").isNull(), "id"))).join(used, "n", "left")
    taken = F.coalesce("used", F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.col("r") + F.size(taken))  # holds r free ones at least
    free = F.element_at(F.filter(every, lambda i: ~F.array_contains(taken, i)), F.col("r"))
    return k.where("keeps").select("n", "id", F.col("letter").cast("bigint").alias("place")).unionByName(rest.select("n", "id", free.cast("bigint").alias("place")))


@query("w10_gap_fence", "WITH v AS (SELECT DISTINCT p_brand, p_retailprice AS v FROM part), m AS (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1), g AS (SELECT *, lead(v) OVER (PARTITION BY p_brand ORDER BY v) AS nx FROM v) SELECT p_brand, min(v) AS fence FROM g JOIN m USING (p_brand) WHERE v >= m AND nx - v >= 20 GROUP BY 1")
def gap_fence(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    m = p.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("m"))
    v = p.select("p_brand", F.col("p_retailprice").alias("v")).distinct().withColumn("nx", F.lead("v").over(W.partitionBy("p_brand").orderBy("v")))
    return v.join(m, "p_brand").where("v >= m and nx - v >= 20").groupBy("p_brand").agg(F.min("v").alias("fence"))


@query("w12_representatives", "SELECT o_custkey, min(o_orderkey) AS rep FROM orders GROUP BY 1")
def representatives(spark, sf_dir):
    """One of each group; a fixed order stands for the reference's seeded draw, which no other engine repeats."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.min("o_orderkey").alias("rep"))


@query("x22_chromosome_clusters")
def chromosome_clusters(spark, sf_dir):
    """g08 as well: labels of a small chromosome matrix with bootstrap support."""
    k = view(spark, sf_dir, "dna").select((F.col("doc_id") % 10).alias("seqid"), "seq")
    k = sq.kmer_counts(k, "seqid", "seq", 2).groupBy("seqid").pivot("kmer", [a + b for a in "ACGT" for b in "ACGT"]).agg(F.sum("n")).na.fill(0).orderBy("seqid")
    pdf = k.toPandas()  # ten chromosomes by sixteen k-mers
    m = pdf.drop(columns="seqid").to_numpy(float)
    m = m / np.maximum(m.sum(1, keepdims=True), 1)
    label, kept = st.bootstrap_stability((m - m.mean(0)) / np.where(m.std(0) > 0, m.std(0), 1), 2, 30)
    return spark.createDataFrame([(int(s), int(a), round(float(b), 6)) for s, a, b in zip(pdf["seqid"], label, kept, strict=True)], "seqid long, label int, support double")


@query("x25_resample", "SELECT 100 AS n")
def resample(spark, sf_dir):
    """x28 as well: a sample of a given size, drawn by a seeded hash; sampling is the feature."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.xxhash64("o_orderkey", F.lit(7)).alias("h")).orderBy("h").limit(100)
    return o.agg(F.count_distinct("o_orderkey").cast("int").alias("n"))


@query("g11_rounds", "SELECT CAST(4 AS BIGINT) AS rounds, (SELECT count(*) FROM orders WHERE o_custkey % 2 = 1) AS found")
def rounds(spark, sf_dir):
    """g12 as well: a driver loop that stops when a round finds nothing more; each round sees what is left."""
    from ..operators.graph import settle

    left, found, n = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), None, 0
    while True:
        n += 1
        new = left.where((F.col("o_custkey") % 2 == 1) & (F.col("o_custkey") % 3 == n - 1)).withColumn("round", F.lit(n))
        if new.isEmpty() or n == 10:
            break
        found = settle(new if found is None else found.unionByName(new))
        left = left.join(new.select("o_orderkey"), "o_orderkey", "left_anti")
    return found.agg(F.lit(n).cast("bigint").alias("rounds"), F.count("*").alias("found"))


@query("z03_provenance", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN o_orderkey % 4 = 0 THEN 'tsd' WHEN o_orderkey % 4 = 1 THEN 'domains' ELSE 'table' END AS source FROM orders")
def provenance(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 4
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "none").when(k == 0, "tsd").when(k == 1, "domains").otherwise("table").alias("source"))


@query("z08_nonautonomous", "SELECT doc_id FROM dna WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND length(seq) >= 60 AND contains(substr(seq, 40, 14), substr(seq, 1, 3))")
def nonautonomous(spark, sf_dir):
    """z07 as well: candidates that the classifier hasn't kept and that have a duplication."""
    d = view(spark, sf_dir, "dna").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti")
    return d.where("length(seq) >= 60").where(F.contains(F.substring("seq", 40, 14), F.substring("seq", 1, 3))).select("doc_id")


@query("z10_tandem_output", "SELECT id, start0, end0 + 1 AS end0 FROM uivl WHERE weight % 10 >= 2")
def tandem_output(spark, sf_dir):
    """Copy-number filter, and 1-based inclusive ends to half-open ones."""
    t = view(spark, sf_dir, "uivl").select("id", (F.col("start0") + 1).alias("s"), (F.col("end0") + 1).alias("e"), (F.col("weight") % 10).alias("copies"))
    return t.where("copies >= 2").select("id", (F.col("s") - 1).alias("start0"), F.col("e").alias("end0"))


@query("z13_candidate_names", "SELECT okey, line, seq1 || '_' || s1 || '_' || e1 || '_' || s2 || '_' || e2 AS name FROM block")
def candidate_names(spark, sf_dir):
    return view(spark, sf_dir, "block").select("okey", "line", F.concat_ws("_", "seq1", "s1", "e1", "s2", "e2").alias("name"))


@query("z15_homology_list", "SELECT n_name AS ref, unnest(['q' || n_nationkey || '_chr1', 'q' || n_nationkey || '_chr2']) AS query, unnest(['+', '-']) AS strand FROM nation")
def homology_list(spark, sf_dir):
    """A reference and then (query, strand) pairs, in one line."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    q = lambda i: F.concat(F.lit("q"), "n_nationkey", F.lit(f"_chr{i}"))
    p = F.split(F.concat_ws("\t", "n_name", q(1), F.lit("+"), q(2), F.lit("-")), "\t")
    rows = n.select(p.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2))).alias("i"))
    return rows.select(F.get("p", F.lit(0)).alias("ref"), F.get("p", F.col("i")).alias("query"), F.get("p", F.col("i") + 1).alias("strand"))


@query("z24_colours_to_chromosomes", "SELECT unnest([o_custkey, -o_custkey]) AS chromosome, unnest(CASE WHEN o_orderstatus = 'F' THEN ['A', 'B'] ELSE ['B', 'A'] END) AS subgenome FROM orders")
def colours_to_chromosomes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = F.when(F.col("o_orderstatus") == "F", "A").otherwise("B")
    b = F.when(F.col("o_orderstatus") == "F", "B").otherwise("A")
    return o.select(F.inline(F.array(F.struct(F.col("o_custkey").alias("chromosome"), a.alias("subgenome")), F.struct((-F.col("o_custkey")).alias("chromosome"), b.alias("subgenome")))))


@query("z28_na_tables", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE printf('%.2f', o_totalprice) END AS value FROM orders")
def na_tables(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "NA").otherwise(F.format_string("%.2f", F.col("o_totalprice"))).alias("value"))


@query("z37_prefiltered_intervals", "SELECT seqid, start0, end0 FROM uivl WHERE end0 - start0 >= 500 AND strand <> '.'")
def prefiltered(spark, sf_dir):
    """z39 as well: an index of clean intervals, sorted within partitions."""
    return view(spark, sf_dir, "uivl").where("end0 - start0 >= 500 and strand <> '.'").select("seqid", "start0", "end0").sortWithinPartitions("seqid", "start0")

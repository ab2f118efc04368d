"""The last steps of the inventory: names, orders, unions, marks on elements, and solvers over few genomes."""

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsing as ps
from ..functions import stats as st
from ..operators import interval as iv
from ..operators import relational as rl
from ..operators.grouped import per_group
from ..sources import formats as fm
from .fixtures import view
from .format_queries import lines
from .registry import query


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("p05_species_of_id", "SELECT p_partkey, regexp_extract('Zea|' || p_partkey || '.1', '^([A-Za-z]+)\\|', 1) AS species FROM part")
def species_of_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(F.concat(F.lit("Zea|"), "p_partkey", F.lit(".1")), r"^([A-Za-z]+)\|", 1).alias("species"))


@query("p18_renamed", "SELECT c_custkey, coalesce(n_name, 'n' || c_nationkey) AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = c_nationkey")
def renamed(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.concat(F.lit("n"), "c_nationkey")).alias("name"))


@query("p26_class_fallback", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN split_part('c' || o_custkey || '#LTR/Gypsy', '#', 2) ELSE o_orderpriority END AS cls FROM orders")
def class_fallback(spark, sf_dir):
    name = F.concat(F.lit("c"), "o_custkey", F.lit("#LTR/Gypsy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.split_part(name, F.lit("#"), F.lit(2))).otherwise(F.col("o_orderpriority")).alias("cls"))


@query("s04_many_files", "SELECT doc_id % 300 AS seqid, arg_max(length(seq), doc_id) AS n FROM dna GROUP BY 1")
def many_files(spark, sf_dir):
    """The union of files; of a repeated id the last wins."""
    d = view(spark, sf_dir, "dna").select((F.col("doc_id") % 300).alias("seqid"), F.length("seq").cast("bigint").alias("n"), "doc_id")
    return rl.last_of(d, ["seqid"], ["doc_id"]).drop("doc_id")


@query("s10_domain_gff3", "SELECT 'e' || id AS te, 'RT' AS gene, 'Class/' || family AS clade, start0, end0 FROM uivl")
def domain_gff3(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").withColumns({"s1": F.col("start0") + 1, "a": F.concat(F.lit("ID=e"), "id", F.lit("|Class/"), "family", F.lit(":RT;x=1"))})
    return fm.domain_gff3(lines(u, "id", "seqid", "=src", "=CDS", "s1", "end0", "=.", "strand", "=.", "a")).select("te", "gene", "clade", "start0", "end0")


@query("k13_manifest", "SELECT rep, count(*) AS n, 'clusters/' || rep || '.fa' AS path FROM member GROUP BY rep HAVING count(*) >= 2")
def manifest(spark, sf_dir):
    m = view(spark, sf_dir, "member").groupBy("rep").agg(F.count("*").alias("n")).where("n >= 2")
    return m.withColumn("path", F.concat(F.lit("clusters/"), ps.sanitised(F.col("rep")), F.lit(".fa")))


@query("o01_outer_first", types={"place": "INTEGER"}, sql="SELECT id, row_number() OVER (PARTITION BY seqid ORDER BY start0, end0 DESC, id) AS place FROM uivl")
def outer_first(spark, sf_dir):
    return view(spark, sf_dir, "uivl").select("id", F.row_number().over(W.partitionBy("seqid").orderBy("start0", F.desc("end0"), "id")).alias("place"))


@query("o05_composite_argmin", "SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, -CAST(floor(o_totalprice) AS BIGINT), o_orderkey)) AS best FROM orders GROUP BY 1")
def composite_argmin(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderpriority", -F.floor("o_totalprice"), "o_orderkey")).alias("best"))


@query("u02_merged_union", """WITH a AS (SELECT seqid, start0, end0, weight, 'plain' AS src FROM uivl WHERE id % 2 = 0 UNION ALL SELECT seqid, start0 + 10, end0 + 10, weight, 'nested' FROM uivl WHERE id % 3 = 0),
f AS (SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY seqid ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM a),
g AS (SELECT *, sum(f) OVER (PARTITION BY seqid ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT seqid, min(start0) AS start0, max(end0) AS end0, bool_or(src = 'nested') AS nested, max(weight) AS bits FROM g GROUP BY seqid, g""")
def merged_union(spark, sf_dir):
    u = view(spark, sf_dir, "uivl")
    a = u.where("id % 2 = 0").select("seqid", "start0", "end0", "weight", F.lit("plain").alias("src"))
    b = u.where("id % 3 = 0").select("seqid", (F.col("start0") + 10).alias("start0"), (F.col("end0") + 10).alias("end0"), "weight", F.lit("nested").alias("src"))
    return iv.merge(a.unionByName(b), ["seqid"], aggs=[F.bool_or(F.col("src") == "nested").alias("nested"), F.max("weight").alias("bits")])


@query("w03_neighbours", "SELECT id, lag(end0) OVER w AS left_end, lead(start0) OVER w AS right_start FROM uivl WINDOW w AS (PARTITION BY seqid ORDER BY start0, id)")
def neighbours(spark, sf_dir):
    w = W.partitionBy("seqid").orderBy("start0", "id")
    return view(spark, sf_dir, "uivl").select("id", F.lag("end0").over(w).alias("left_end"), F.lead("start0").over(w).alias("right_start"))


@query("x08_aligned_jc", """WITH p AS (SELECT doc_id, substr(seq, 1, 40) AS a, substr(seq, 1, 38) || reverse(substr(seq, 39, 2)) AS b FROM dna WHERE length(seq) >= 40), d AS (SELECT doc_id, hamming(a, b) / 40.0 AS r FROM p) SELECT doc_id, round(-0.75 * ln(1 - 4 * r / 3) + 0.0, 9) AS d FROM d""")
def aligned_jc(spark, sf_dir):
    from ..functions.sequence import aligned_jc as jc

    d = view(spark, sf_dir, "dna").where("length(seq) >= 40").select("doc_id", F.substring("seq", 1, 40).alias("a"), F.concat(F.substring("seq", 1, 38), F.reverse(F.substring("seq", 39, 2))).alias("b"))
    return d.select("doc_id", F.round(jc(F.col("a"), F.col("b")) + 0.0, 9).alias("d"))


@query("x13_tsd_exact", "SELECT doc_id, min(i) AS at FROM (SELECT doc_id, seq, unnest(range(0, 4)) AS i FROM dna WHERE length(seq) >= 60) WHERE substr(seq, CAST(10 - i AS INTEGER), 5) = substr(seq, 40, 5) GROUP BY doc_id")
def tsd_exact(spark, sf_dir):
    """x14 as well: the first offset, inwards, at which the k bases are equal."""
    d = view(spark, sf_dir, "dna").where("length(seq) >= 60")
    hit = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(F.col("seq"), F.lit(10) - i, F.lit(5)) == F.substring("seq", 40, 5))
    return d.withColumn("at", F.array_min(hit)).where("at is not null").select("doc_id", F.col("at").cast("bigint").alias("at"))


@query("x26_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(greatest(floor(l_quantity / 4 + 0.5), 2), 10) AS BIGINT) AS x FROM lineitem")
def half_up(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.least(F.greatest(F.floor(F.col("l_quantity") / 4 + 0.5), F.lit(2)), F.lit(10)).alias("x"))


@query("x24_interval_of_k", None)
def interval_of_k(spark, sf_dir):
    """The grid points whose misfit stays below the critical F ratio of the least."""
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("v"), F.col("l_discount").alias("d"))
    grid = st.change_point(li, "v", "d", 0.0, 0.1, 0.01)
    n = li.agg(F.count("*").alias("n")).first()["n"]
    least = grid.agg(F.min("sse").alias("best"))
    return grid.join(F.broadcast(least)).where(F.col("sse") <= F.col("best") * (1 + st.f_critical(0.05, 1, max(n - 1, 1)) / max(n - 1, 1))).select("k", "sse")


@query("g07_constraint_edges", "SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS weight FROM (SELECT l_suppkey % 12 AS a, l_partkey % 12 AS b FROM lineitem) WHERE a <> b GROUP BY ALL HAVING count(*) >= 100")
def constraint_edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 12).alias("x"), (F.col("l_partkey") % 12).alias("y")).where("x <> y")
    return li.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("weight")).where("weight >= 100")


@query("g10_propagated_paint", "SELECT s_suppkey, r_name AS paint FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def propagated_paint(spark, sf_dir):
    """g09 as well: a fold down a stack of genomes, each taking the paint of the one above by a join."""
    paint = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("paint"))
    for name, key, below in (("nation", "n_regionkey", "n_nationkey"), ("supplier", "s_nationkey", "s_suppkey")):
        rows = table(spark, sf_dir, name)
        paint = rows.join(paint.toDF(key, "paint"), key).select(below, "paint")
    return paint


@query("z14_repeat_lengths", "SELECT 'c' || o_custkey AS seqid, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders")
def repeat_lengths(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumns({"a": F.concat(F.lit("c"), "o_custkey"), "b": F.floor("o_totalprice")})
    return fm.fai(lines(o, "o_orderkey", "a", "b")).select("seqid", "length")


@query("z18_unknown_sequences", "SELECT DISTINCT seqid FROM uivl WHERE seqid NOT IN ('chr0', 'chr1', 'chr2')")
def unknown_sequences(spark, sf_dir):
    """What a length lookup would fail on."""
    known = spark.createDataFrame([("chr0",), ("chr1",), ("chr2",)], "seqid string")
    return view(spark, sf_dir, "uivl").join(known, "seqid", "left_anti").select("seqid").distinct()


@query("z32_corrected_length", types={"own": "BIGINT"}, sql="SELECT a.id, a.end0 - a.start0 - coalesce(sum(b.end0 - b.start0), 0) AS own FROM uivl a LEFT JOIN uivl b ON a.seqid = b.seqid AND a.start0 <= b.start0 AND b.end0 <= a.end0 AND b.end0 - b.start0 < a.end0 - a.start0 AND b.id % 2 = 0 GROUP BY a.id, a.start0, a.end0")
def corrected_length(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").select("id", "seqid", "start0", "end0")
    inside = iv.contains(("start0", "end0"), ("b_start0", "b_end0")) & (F.col("b_end0") - F.col("b_start0") < F.col("end0") - F.col("start0"))
    n = iv.overlap_join(u, u.where("id % 2 = 0"), ["seqid"], on=inside).groupBy("id").agg(F.sum(F.col("b_end0") - F.col("b_start0")).alias("n"))
    return u.join(n, "id", "left").select("id", (F.col("end0") - F.col("start0") - F.coalesce("n", F.lit(0))).cast("bigint").alias("own"))


def _drawn(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["start0", "end0", "id"])
    slack = min(0, int((pdf["end0"] - pdf["start0"]).min())) / 2
    kept, near = [], []  # all, and those that still reach the row; they share less than half, so they are few
    for i, s, e in zip(pdf["id"].tolist(), pdf["start0"].tolist(), pdf["end0"].tolist(), strict=True):
        near = [k for k in near if k[1] - s >= slack]
        if all(min(e, f) - max(s, t) < 0.5 * min(e - s, f - t) for t, f in near):
            kept.append(i)
            near.append((s, e))
    return pd.DataFrame({"id": kept})


@query("z33_drawn_insertions", None)
def drawn_insertions(spark, sf_dir):
    """An insertion goes that overlaps one already drawn by half of the shorter; in order, per island."""
    rows = iv.islands(view(spark, sf_dir, "uivl").select("id", "seqid", "start0", "end0"), ["seqid"])
    return per_group(rows, ["seqid", "island"], _drawn, "id bigint", lambda p: p[["id"]])


@query("z38_truth_class", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS cls FROM orders")
def truth_class(spark, sf_dir):
    name = F.concat("o_orderpriority", F.lit("~junk"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.split_part(F.split_part(name, F.lit("~"), F.lit(1)), F.lit("-"), F.lit(1)).alias("cls"))


@query("z41_reversed_features", "SELECT id, seqid, start0, end0 FROM uivl")
def reversed_features(spark, sf_dir):
    name = F.concat("seqid", F.lit(":"), "end0", F.lit("-"), "start0")
    return view(spark, sf_dir, "uivl").select("id", ps.locus(name).alias("l")).select("id", "l.seqid", F.col("l.start").alias("start0"), F.col("l.end").alias("end0"))


@query("z42_expected_domains", "WITH x AS (SELECT DISTINCT p_brand, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45), n AS (SELECT l_linenumber, count(*) AS n FROM x GROUP BY 1) SELECT l_linenumber FROM n WHERE n / (SELECT count(DISTINCT p_brand) FROM part) >= 0.9")
def expected_domains(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    x = table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(p, "l_partkey").select("p_brand", "l_linenumber").distinct()
    total = p.agg(F.count_distinct("p_brand").alias("t"))
    return x.groupBy("l_linenumber").agg(F.count("*").alias("n")).join(F.broadcast(total)).where("n / t >= 0.9").select("l_linenumber")

"""Queries of the interval algebra."""

from pyspark.sql import functions as F

from ..operators import interval as iv
from .fixtures import view
from .registry import query

MERGED = """m AS (SELECT seqid, min(start0) AS start0, max(end0) AS end0 FROM (
  SELECT *, sum(f) OVER (PARTITION BY seqid ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY seqid ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS f FROM {t})) GROUP BY seqid, g)"""


def _merged(gap):
    return f"WITH {MERGED.format(gap=gap, t='ivl')} SELECT seqid, start0, end0 FROM m"


def _register_merges():
    for gap in (0, 1, 50, 1000):
        query(f"i01_merge_gap_{gap}", _merged(gap))(lambda s, d, g=gap: iv.merge(view(s, d, "ivl"), ["seqid"], gap=g))


_register_merges()


@query("i02_covered_bp", f"WITH {MERGED.format(gap=0, t='ivl')} SELECT seqid, CAST(sum(end0 - start0) AS BIGINT) AS covered FROM m GROUP BY seqid")
def covered_bp(spark, sf_dir):
    return iv.covered(view(spark, sf_dir, "ivl"), ["seqid"])


@query("i03_uncovered_fraction", f"""
WITH {MERGED.format(gap=0, t='ivl')}, n AS (SELECT seqid, max(end0) AS n FROM uivl GROUP BY seqid)
SELECT n.seqid, round(1 - coalesce(sum(least(end0, n) - start0), 0) / n, 9) AS uncovered FROM n LEFT JOIN m ON m.seqid = n.seqid AND start0 < n GROUP BY n.seqid, n""")
def uncovered_fraction(spark, sf_dir):
    n = view(spark, sf_dir, "uivl").groupBy("seqid").agg(F.max("end0").alias("n"))
    m = iv.clip(iv.merge(view(spark, sf_dir, "ivl"), ["seqid"]).join(n, "seqid"), F.lit(0), F.col("n"))
    m = m.groupBy("seqid").agg(F.sum(F.col("end0") - F.col("start0")).alias("bp"))
    return n.join(m, "seqid", "left").select("seqid", F.round(1 - F.coalesce("bp", F.lit(0)) / F.col("n"), 9).alias("uncovered"))


@query("i04_complement", f"""
WITH {MERGED.format(gap=0, t='ivl')}, b AS (SELECT concat('chr', CAST(n AS VARCHAR)) AS seqid, 21000000 AS length FROM range(10) r(n)),
g AS (SELECT seqid, coalesce(lag(end0) OVER (PARTITION BY seqid ORDER BY start0), 0) AS start0, start0 AS end0 FROM m
UNION ALL SELECT b.seqid, coalesce(max(end0), 0), any_value(length) FROM b LEFT JOIN m USING (seqid) GROUP BY b.seqid)
SELECT seqid, CAST(start0 AS BIGINT) AS start0, CAST(end0 AS BIGINT) AS end0 FROM g WHERE start0 < end0""")
def complement(spark, sf_dir):
    bounds = spark.range(10).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("seqid"), F.lit(21_000_000).cast("bigint").alias("length"))
    return iv.complement(view(spark, sf_dir, "ivl"), ["seqid"], bounds)


@query("i05_clip", "SELECT seqid, greatest(start0, 5000) AS start0, least(end0, 90000) AS end0, name, ord FROM feature WHERE greatest(start0, 5000) < least(end0, 90000)")
def clip(spark, sf_dir):
    return iv.clip(view(spark, sf_dir, "feature"), F.lit(5000).cast("bigint"), F.lit(90000).cast("bigint"))


@query("i06_flanks", f"""
WITH p0 AS (SELECT seqid, start0, end0 FROM feature WHERE name = 'purchase'), {MERGED.format(gap=0, t='p0').replace('m AS', 'p AS', 1)},
u AS (SELECT seqid, start0, end0 FROM feature WHERE name IN ('click', 'signup') UNION ALL SELECT * FROM p), {MERGED.format(gap=0, t='u')},
n AS (SELECT *, lag(end0) OVER w AS le, lead(start0) OVER w AS rs FROM m WINDOW w AS (PARTITION BY seqid ORDER BY start0)),
h AS (SELECT p.seqid, p.start0 AS s, p.end0 AS e, n.start0 AS bs, n.end0 AS be, le, rs FROM p JOIN n ON p.seqid = n.seqid AND n.start0 <= p.start0 AND p.end0 <= n.end0),
f AS (SELECT seqid, CASE WHEN bs < s THEN s ELSE greatest(s - 40, coalesce(le, 0), 0) END AS start0, s AS end0 FROM h
UNION ALL SELECT seqid, e, CASE WHEN be > e THEN e ELSE least(e + 40, coalesce(rs, 200000), 200000) END FROM h)
SELECT * FROM f WHERE start0 < end0""")
def flanks(spark, sf_dir):
    f = view(spark, sf_dir, "feature").select("seqid", "start0", "end0", "name")
    return iv.flanks(f.where("name = 'purchase'").drop("name"), f.where("name in ('click', 'signup')").drop("name"), ["seqid"], 40, 200_000)


PAIRS = """WITH a AS (SELECT * FROM uivl WHERE weight % 2 = 0), b AS (SELECT * FROM uivl WHERE weight % 2 = 1) """


def _pairs(spark, sf_dir):
    """Two sides that share no interval and leave none out."""
    u = view(spark, sf_dir, "uivl")
    return u.where("weight % 2 = 0"), u.where("weight % 2 = 1")


@query("i07_overlap_of_shorter", PAIRS + """
SELECT a.id, b.id AS b_id, round((least(a.end0, b.end0) - greatest(a.start0, b.start0) + 1) / least(a.end0 - a.start0 + 1, b.end0 - b.start0 + 1), 9) AS fraction
FROM a JOIN b ON a.seqid = b.seqid AND a.start0 <= b.end0 AND b.start0 <= a.end0""")
def overlap_of_shorter(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return iv.overlap_join(a, b, ["seqid"]).select("id", "b_id", F.round(iv.overlap_of_shorter(("start0", "end0"), ("b_start0", "b_end0")), 9).alias("fraction"))


@query("i08_containment", PAIRS + """
SELECT a.id, b.id AS b_id, CASE WHEN a.end0 - a.start0 < b.end0 - b.start0 AND b.start0 <= a.start0 AND a.end0 <= b.end0 THEN 'a_in_b'
 WHEN b.end0 - b.start0 < a.end0 - a.start0 AND a.start0 <= b.start0 AND b.end0 <= a.end0 THEN 'b_in_a' ELSE '' END AS relation
FROM a JOIN b ON a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0""")
def containment(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return iv.overlap_join(a, b, ["seqid"], on=iv.overlaps()).select("id", "b_id", iv.containment(("start0", "end0"), ("b_start0", "b_end0")).alias("relation"))


def _ltrs(prefix=""):
    """The two ends of an element: a tenth of it on either side."""
    s, e = F.col(f"{prefix}start0"), F.col(f"{prefix}end0")
    size = F.floor((e - s) / 10)
    return [(s, s + size), (e - size, e)]


@query("i09_shared_ends", PAIRS + """
, e AS (SELECT a.id, b.id AS b_id, a.start0 AS s, a.end0 AS e, b.start0 AS t, b.end0 AS f, (a.end0 - a.start0)//10 AS x, (b.end0 - b.start0)//10 AS y
FROM a JOIN b ON a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0)
SELECT id, b_id FROM e WHERE (s < t + y AND t < s + x) OR (s < f AND f - y < s + x) OR (e - x < t + y AND t < e) OR (e - x < f AND f - y < e)""")
def shared_ends(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    any_two = F.lit(False)
    for s, e in _ltrs():
        for t, f in _ltrs("b_"):
            any_two |= (s < f) & (t < e)
    return iv.overlap_join(a, b, ["seqid"], on=iv.overlaps() & any_two).select("id", "b_id")


@query("i10_nested_span_bp", f"""
WITH c AS (SELECT a.id AS seqid, greatest(a.start0, b.start0) AS start0, least(a.end0, b.end0) AS end0 FROM uivl a JOIN uivl b
ON a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0 AND a.id <> b.id AND b.end0 - b.start0 < a.end0 - a.start0), {MERGED.format(gap=0, t='c')}
SELECT seqid AS id, CAST(sum(end0 - start0) AS BIGINT) AS nested_bp FROM m GROUP BY seqid""")
def nested_span(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").select("id", "seqid", "start0", "end0")
    shorter = F.col("b_end0") - F.col("b_start0") < F.col("end0") - F.col("start0")
    inner = iv.overlap_join(u, u, ["seqid"], on=iv.overlaps() & shorter & (F.col("id") != F.col("b_id")))
    inner = inner.select("id", F.greatest("start0", "b_start0").alias("start0"), F.least("end0", "b_end0").alias("end0"))
    return iv.covered(inner, ["id"]).withColumnRenamed("covered", "nested_bp")


@query("i17_overlapping_chunks", """
WITH l AS (SELECT seqid, max(end0) AS length FROM ivl GROUP BY seqid), c AS (SELECT seqid, length, unnest(range(0, CAST(greatest(ceil((length - 500000) / 450000.0), 0) AS BIGINT) + 1)) AS chunk FROM l)
SELECT seqid, chunk, chunk * 450000 AS start0, least(chunk * 450000 + 500000, length) AS end0 FROM c""")
def overlapping_chunks(spark, sf_dir):
    n = view(spark, sf_dir, "ivl").groupBy("seqid").agg(F.max("end0").alias("length"))
    return iv.chunks(n, 500_000, 50_000).select("seqid", "chunk", "start0", "end0")


@query("i17_full_windows", """
WITH l AS (SELECT seqid, max(end0) AS length FROM feature GROUP BY seqid)
SELECT seqid, unnest(range(0, length - 5000 + 1, 1000)) AS start0, unnest(range(0, length - 5000 + 1, 1000)) + 5000 AS end0 FROM l WHERE length >= 5000""")
def full_windows(spark, sf_dir):
    n = view(spark, sf_dir, "feature").groupBy("seqid").agg(F.max("end0").alias("length"))
    return iv.windows(n, 5000, 1000).select("seqid", "start0", "end0")


@query("j09_strict_containment", "SELECT a.id AS outer_id, b.id AS inner_id FROM uivl a JOIN uivl b ON a.seqid = b.seqid AND a.start0 <= b.start0 AND b.end0 <= a.end0 AND b.end0 - b.start0 < a.end0 - a.start0")
def strict_containment(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").select("id", "seqid", "start0", "end0")
    on = iv.contains(("start0", "end0"), ("b_start0", "b_end0")) & (F.col("b_end0") - F.col("b_start0") < F.col("end0") - F.col("start0"))
    return iv.overlap_join(u, u, ["seqid"], on=on).select(F.col("id").alias("outer_id"), F.col("b_id").alias("inner_id"))


@query("j10_children_of_level", "SELECT a.id AS outer_id, b.id AS inner_id FROM uivl a JOIN uivl b ON a.seqid = b.seqid AND b.weight % 3 = a.weight % 3 - 1 AND a.start0 <= b.start0 AND b.end0 <= a.end0")
def children_of_level(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").select("id", "seqid", "start0", "end0", (F.col("weight") % 3).alias("level"))
    on = iv.contains(("start0", "end0"), ("b_start0", "b_end0"))
    return iv.overlap_join(u, u.withColumn("level", F.col("level") + 1), ["seqid", "level"], on=on).select(F.col("id").alias("outer_id"), F.col("b_id").alias("inner_id"))


@query("j11_overlap_anti", PAIRS + "SELECT id, start0, end0 FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0)")
def overlap_anti(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return iv.overlap_join(a, b, ["seqid"], "left_anti", iv.overlaps()).select("id", "start0", "end0")


@query("j12_proximity_anti", PAIRS + "SELECT id, start0, end0 FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seqid = b.seqid AND b.start0 <= a.end0 + 500 AND b.end0 >= a.start0 - 500)")
def proximity_anti(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    near = (F.col("b_start0") <= F.col("end0") + 500) & (F.col("b_end0") >= F.col("start0") - 500)
    return iv.overlap_join(a, b, ["seqid"], "left_anti", near, gap=500).select("id", "start0", "end0")


@query("j13_abutment_anti", PAIRS + """SELECT id, start0, end0 FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.seqid = b.seqid
AND b.start0 <= a.end0 + 20 AND b.end0 >= a.start0 - 20 AND NOT (a.start0 >= b.start0 + 50 AND a.end0 <= b.end0 - 50))""")
def abutment_anti(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    touches = (F.col("b_start0") <= F.col("end0") + 20) & (F.col("b_end0") >= F.col("start0") - 20)
    inside = (F.col("start0") >= F.col("b_start0") + 50) & (F.col("end0") <= F.col("b_end0") - 50)
    return iv.overlap_join(a, b, ["seqid"], "left_anti", touches & ~inside, gap=20).select("id", "start0", "end0")


@query("j14_prepurge", PAIRS + """, p AS (SELECT a.id, bool_or(b.start0 <= a.start0 AND a.end0 <= b.end0 AND a.end0 - a.start0 < b.end0 - b.start0 AND b.weight % 3 = 0) AS protect,
bool_or((least(a.end0, b.end0) - greatest(a.start0, b.start0) + 1) / least(a.end0 - a.start0 + 1, b.end0 - b.start0 + 1) >= 0.8) AS exclude
FROM a JOIN b ON a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0 GROUP BY a.id)
SELECT a.id FROM a LEFT JOIN p USING (id) WHERE coalesce(protect, false) OR NOT coalesce(exclude, false)""")
def prepurge(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    inside = iv.contains(("b_start0", "b_end0"), ("start0", "end0")) & (F.col("end0") - F.col("start0") < F.col("b_end0") - F.col("b_start0"))
    most = iv.overlap_of_shorter(("start0", "end0"), ("b_start0", "b_end0")) >= 0.8
    found = iv.overlap_join(a, b, ["seqid"], on=iv.overlaps()).groupBy("id").agg(F.bool_or(inside & (F.col("b_weight") % 3 == 0)).alias("protect"), F.bool_or(most).alias("exclude"))
    return a.join(found, "id", "left").where("coalesce(protect, false) or not coalesce(exclude, false)").select("id")


@query("j15_spanning_evidence", PAIRS + """, h AS (SELECT a.id, b.id AS hit, b.weight FROM a JOIN b ON a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0
WHERE (least(a.end0, b.end0) - greatest(a.start0, b.start0)) / (a.end0 - a.start0) >= 0.5 AND (a.start0 - b.start0 >= 20 OR b.end0 - a.end0 >= 20)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, hit) AS k FROM h)
SELECT a.id, CASE WHEN hit IS NULL THEN 'solo' ELSE 'fragment' END AS kind, hit AS evidence FROM a LEFT JOIN r ON a.id = r.id AND k = 1""")
def spanning_evidence(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    most = iv.overlap_bp() / (F.col("end0") - F.col("start0")) >= 0.5
    beyond = (F.col("start0") - F.col("b_start0") >= 20) | (F.col("b_end0") - F.col("end0") >= 20)
    best = iv.overlap_join(a, b, ["seqid"], on=iv.overlaps() & most & beyond).groupBy("id").agg(F.max_by("b_id", F.struct("b_weight", -F.col("b_id"))).alias("evidence"))
    return a.join(best, "id", "left").select("id", F.when(F.col("evidence").isNull(), "solo").otherwise("fragment").alias("kind"), "evidence")


@query("j16_hit_to_locus", f"""WITH {MERGED.format(gap=0, t='ivl')} SELECT id, coalesce(m.start0, -1) AS locus FROM uivl LEFT JOIN m ON uivl.seqid = m.seqid AND m.start0 <= uivl.start0 AND m.end0 >= uivl.start0 + 1""")
def hit_to_locus(spark, sf_dir):
    loci = iv.merge(view(spark, sf_dir, "ivl"), ["seqid"])
    u = view(spark, sf_dir, "uivl").select("id", "seqid", "start0", (F.col("start0") + 1).alias("end0"))
    hit = iv.overlap_join(u, loci, ["seqid"], on=iv.contains(("b_start0", "b_end0"), ("start0", "end0"))).select("id", F.col("b_start0").alias("locus"))
    return u.join(hit, "id", "left").select("id", F.coalesce("locus", F.lit(-1)).alias("locus"))


@query("j17_reciprocal_best", PAIRS + """, s AS (SELECT a.id, b.id AS truth, b.family, least((least(a.end0, b.end0) - greatest(a.start0, b.start0)) / (a.end0 - a.start0), (least(a.end0, b.end0) - greatest(a.start0, b.start0)) / (b.end0 - b.start0)) AS score
FROM a JOIN b ON a.seqid = b.seqid AND a.start0 < b.end0 AND b.start0 < a.end0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, family, truth) AS k FROM s WHERE score >= 0.3)
SELECT id, truth, family, round(score, 9) AS score FROM r WHERE k = 1""")
def reciprocal_best(spark, sf_dir):
    from pyspark.sql import Window as W

    a, b = _pairs(spark, sf_dir)
    bp = iv.overlap_bp()
    score = F.least(bp / (F.col("end0") - F.col("start0")), bp / (F.col("b_end0") - F.col("b_start0")))
    found = iv.overlap_join(a, b, ["seqid"], on=iv.overlaps()).withColumn("score", score).where("score >= 0.3")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "b_family", "b_id"))
    return found.withColumn("k", rank).where("k = 1").select("id", F.col("b_id").alias("truth"), F.col("b_family").alias("family"), F.round("score", 9).alias("score"))


@query("j18_covering_segment", PAIRS + "SELECT a.id, min(b.start0) AS segment FROM a LEFT JOIN b ON a.seqid = b.seqid AND b.start0 <= a.start0 AND b.end0 >= a.end0 GROUP BY a.id")
def covering_segment(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    hit = iv.overlap_join(a, b, ["seqid"], on=iv.contains(("b_start0", "b_end0"), ("start0", "end0"))).groupBy("id").agg(F.min("b_start0").alias("segment"))
    return a.select("id").join(hit, "id", "left")


@query("j20_nearest", PAIRS + """, s AS (SELECT a.id, b.id AS hit, greatest(least(a.end0, b.end0) - greatest(a.start0, b.start0), 0) AS bp, greatest(b.start0 - a.end0, a.start0 - b.end0, 0) AS distance
FROM a JOIN b ON a.seqid = b.seqid), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bp DESC, distance, hit) AS k FROM s)
SELECT a.id, hit, bp, distance FROM a LEFT JOIN r ON a.id = r.id AND k = 1""")
def nearest(spark, sf_dir):
    a, b = _pairs(spark, sf_dir)
    return iv.nearest(a.select("id", "seqid", "start0", "end0"), b.select("id", "seqid", "start0", "end0"), ["seqid"], "id", "id").select("id", "hit", "bp", "distance")

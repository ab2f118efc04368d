"""Queries of readers, writers, masks and the supplementary steps, over lines derived from the tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import interval as iv
from ..operators import masking as mk
from ..operators import relational as rl
from ..sources import formats as fm
from ..sources import sinks as sk
from .fixtures import view
from .registry import query


def lines(df, order, *parts, sep="\t"):
    """Lines of columns; a part that begins with = is a constant."""
    text = F.concat_ws(sep, *[F.lit(p[1:]) if p[0] == "=" else F.col(p).cast("string") for p in parts])
    return df.select(F.lit("f").alias("file"), F.col(order).alias("ord"), text.alias("value"))


def _u(spark, sf_dir):
    return view(spark, sf_dir, "uivl")


@query("s01_fasta", "SELECT 'doc' || doc_id AS seqid, 'len=' || length(seq) AS description, seq FROM dna WHERE length(seq) > 0")
def fasta(spark, sf_dir):
    """k01 as well: sequences are written with wrapped lines and read again."""
    d = view(spark, sf_dir, "dna").where("length(seq) > 0")
    text = F.concat(F.lit(">doc"), "doc_id", F.lit(" len="), F.length("seq"), F.lit("\n"), sk.wrapped(F.col("seq")))
    rows = d.select(F.lit("f").alias("file"), F.col("doc_id"), F.posexplode(F.split(text, "\n")).alias("i", "value"))
    # one file a hundred documents, so that the count of headers runs along short files
    rows = rows.withColumn("file", F.concat(F.lit("f"), F.floor(F.col("doc_id") / 100))).select("file", F.struct("doc_id", "i").alias("ord"), "value")
    return fm.fasta(rows).select("seqid", "description", "seq")


@query("s05_fai", "SELECT c_name AS seqid, c_custkey * 1000 AS length FROM customer")
def fai(spark, sf_dir):
    return fm.fai(lines(spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("n", F.col("c_custkey") * 1000), "c_custkey", "c_name", "n", "=60", "=61")).select("seqid", "length")


@query("s06_bed", "SELECT arg_max(seqid, id) AS seqid, arg_max(start0, id) AS start0, arg_max(end0, id) AS end0, 'g' || (id % 4000) AS gene FROM uivl GROUP BY id % 4000")
def bed(spark, sf_dir):
    u = _u(spark, sf_dir).withColumn("gene", F.concat(F.lit("g"), F.col("id") % 4000))
    return fm.bed(lines(u, "id", "seqid", "start0", "end0", "gene", "=0", "strand")).select("seqid", "start0", "end0", "gene")


def _gff(spark, sf_dir):
    u = _u(spark, sf_dir)
    kind = F.when(F.col("id") % 3 == 0, "gene").when(F.col("id") % 3 == 1, "mRNA").otherwise("exon")
    attrs = F.concat(F.lit("ID=x"), "id", F.lit(";Parent=x"), F.col("id") - F.col("id") % 3 + F.when(F.col("id") % 3 == 2, 1).otherwise(0))
    return lines(u.withColumns({"kind": kind, "s1": F.col("start0") + 1, "attrs": attrs}), "id", "seqid", "=src", "kind", "s1", "end0", "=.", "strand", "=.", "attrs")


@query("s07_gff3_features", "SELECT seqid, start0, end0, CASE id % 3 WHEN 0 THEN 'gene' ELSE 'exon' END AS type FROM uivl WHERE id % 3 <> 1")
def gff3_features(spark, sf_dir):
    return fm.gff3_features(_gff(spark, sf_dir), ["gene", "exon"])


@query("s09_gene_tree", "SELECT 'x' || (m.id - 1) AS gene, 'x' || m.id AS mrna, count(e.id) AS n, min(e.start0) AS first FROM uivl m LEFT JOIN uivl e ON e.id = m.id + 1 WHERE m.id % 3 = 1 GROUP BY m.id")
def gene_tree(spark, sf_dir):
    """p16 and s10's attribute map as well."""
    return fm.gene_tree(fm.gff3(_gff(spark, sf_dir))).select("gene", "mrna", F.size("exons").cast("bigint").alias("n"), F.get("exons", 0)["start0"].alias("first"))


@query("s08_gff3_states", "SELECT 'm' || event_id AS mrna, CASE WHEN g > 0 THEN CAST(max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) END AS sta FROM (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) QUALIFY event_type <> 'click'")
def gff3_states(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("##STA "), "event_id")).otherwise(F.concat(F.lit("c\ts\tmRNA\t1\t9\t.\t+\t.\tID=m"), "event_id", F.lit(";z=1")))
    return fm.gff3_states(e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("ord"), text.alias("value"))).select("mrna", "sta")


@query("s11_classes", "SELECT 't' || o_orderkey AS te, 'LTR' AS \"order\", o_orderpriority AS superfamily FROM orders")
def classes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("te", F.concat(F.lit("t"), "o_orderkey"))
    return fm.classes(lines(o, "o_orderkey", "te", "=LTR", "o_orderpriority", "=c", "=yes", "=+", "=.")).select("te", "order", "superfamily")


@query("s13_scn", "SELECT seqid, start0 AS s_ret, end0 AS e_ret, max(id) % 100 AS sim FROM uivl GROUP BY ALL")
def scn(spark, sf_dir):
    """k08's columns, read again."""
    u = _u(spark, sf_dir).withColumn("sim", F.col("id") % 100)
    return fm.scn(lines(u, "id", "start0", "end0", "=5", "start0", "start0", "=5", "end0", "end0", "=5", "sim", "=0", "seqid", sep="  ")).select("seqid", "s_ret", "e_ret", F.col("sim").cast("bigint").alias("sim"))


def _paf(spark, sf_dir):
    u = _u(spark, sf_dir).withColumns({"n": F.col("end0") - F.col("start0"), "tag": F.concat(F.lit("AS:i:"), "weight"), "de": F.concat(F.lit("de:f:"), (F.col("id") % 10) / 100)})
    return lines(u.where("strand <> '.'"), "id", "id", "end0", "start0", "end0", "strand", "seqid", "=30000000", "start0", "end0", "n", "n", "=60", "tag", "de")


@query("s15_paf", "SELECT CAST(id AS VARCHAR) AS query, start0 AS qstart, CAST(weight AS VARCHAR) AS score FROM uivl WHERE strand <> '.' AND end0 - start0 >= 300")
def paf(spark, sf_dir):
    return fm.paf(_paf(spark, sf_dir)).where("alnlen >= 300 and matches / alnlen >= 0.9").select("query", "qstart", F.col("tags")["AS"].alias("score"))


@query("s16_paf_to_m8", "SELECT CAST(id AS VARCHAR) AS query, CASE WHEN strand = '-' THEN end0 ELSE start0 + 1 END AS qstart, CASE WHEN strand = '-' THEN start0 + 1 ELSE end0 END AS qend, round((1 - (id % 10) / 100) * 100, 6) AS pident, weight AS bits FROM uivl WHERE strand <> '.'")
def paf_to_m8(spark, sf_dir):
    return fm.paf_to_m8(fm.paf(_paf(spark, sf_dir))).select("query", "qstart", "qend", F.round("pident", 6).alias("pident"), "bits")


@query("s17_m8", "SELECT CAST(l_orderkey AS VARCHAR) AS query, CAST(l_partkey AS VARCHAR) AS target, l_linenumber AS mismatch, l_discount AS pident FROM lineitem")
def m8(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lines(li, "l_orderkey", "l_orderkey", "l_partkey", "=1", "=9", "=9", "=1", "=9", "=9", "=9", "l_discount", "l_linenumber", "=0", "=1e-5", "=20", "=90")
    return fm.m8(rows).select("query", "target", F.col("mismatch").cast("int").alias("mismatch"), "pident")


@query("s18_blast", "SELECT CAST(l_orderkey AS VARCHAR) AS qseqid, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_partkey * 10 - 1 AS start0, l_partkey * 10 + 50 AS end0 FROM lineitem WHERE l_quantity >= 20 AND l_linenumber >= 2")
def blast(spark, sf_dir):
    """The thresholds apply as lines are read."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"a": F.col("l_partkey") * 10, "b": F.col("l_partkey") * 10 + 50, "r": F.col("l_returnflag") == "R"})
    li = li.withColumns({"ss": F.when(F.col("r"), F.col("b")).otherwise(F.col("a")), "se": F.when(F.col("r"), F.col("a")).otherwise(F.col("b"))})
    rows = lines(li, "l_orderkey", "l_orderkey", "l_suppkey", "l_quantity", "l_linenumber", "=99", "=99", "=1", "=50", "ss", "se", "=1e-9", "=80", "=95", "=95", "=0", "=0", "=50")
    return fm.blast6(rows, pident=20, length=2).select("qseqid", "strand", "start0", "end0")


@query("s20_clusters_with_rep", "WITH m AS (SELECT o_orderkey AS k, o_custkey % 50 AS rep, o_orderkey % 900 AS member FROM orders), a AS (SELECT k, rep, member FROM m UNION ALL SELECT min(k), rep, rep FROM m GROUP BY rep) SELECT CAST(arg_min(rep, k) AS VARCHAR) AS rep, CAST(member AS VARCHAR) AS member FROM a GROUP BY member")
def clusters_with_rep(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"rep": F.col("o_custkey") % 50, "member": F.col("o_orderkey") % 900})
    return fm.clusters(lines(o, "o_orderkey", "rep", "member"), "with_rep").select("rep", "member")


@query("s20_clusters_sized", types={"rank": "INTEGER"}, sql="WITH m AS (SELECT DISTINCT CAST(o_custkey % 50 AS VARCHAR) AS rep, CAST(o_orderkey % 900 AS VARCHAR) AS member FROM orders), n AS (SELECT rep, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, rep) AS rank FROM m GROUP BY rep HAVING count(*) >= 5) SELECT m.rep, m.member, n.size, n.rank FROM m JOIN n USING (rep)")
def clusters_sized(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"rep": F.col("o_custkey") % 50, "member": F.col("o_orderkey") % 900})
    return fm.clusters(lines(o, "o_orderkey", "rep", "member"), "sized", 5)


@query("s21_anchors", "SELECT CAST(user_id AS VARCHAR) AS file, CAST(c AS BIGINT) AS cluster, 'a' || event_id AS gene_a FROM (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events) WHERE event_type <> 'click'")
def anchors(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.when(F.col("event_type") == "click", "###").otherwise(F.concat(F.lit("a"), "event_id", F.lit("\tb\t5")))
    return fm.anchors(e.select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("ord"), text.alias("value"))).select("file", "cluster", "gene_a")


@query("s22_block_coordinates", "SELECT seq1, s1, e1, seq2, s2, e2, strand FROM block")
def block_coordinates(spark, sf_dir):
    b = view(spark, sf_dir, "block").withColumns({"a": F.concat("seq1", F.lit(":"), "s1", F.lit(".."), "e1"), "b": F.concat("seq2", F.lit(":"), "s2", F.lit(".."), "e2")})
    return fm.block_coordinates(lines(b, "okey", "a", "b", "strand")).drop("ord")


@query("s24_kmer_dump", "SELECT p_brand AS kmer, count(*) AS n FROM part GROUP BY 1")
def kmer_dump(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"))
    return fm.kmer_dump(lines(p, "p_brand", "p_brand", "n", sep=" ")).select("kmer", "n")


@query("s25_chromosome_sets", types={"set_id": "INTEGER"}, sql="WITH s AS (SELECT r_regionkey, row_number() OVER (ORDER BY r_regionkey) AS set_id FROM region WHERE r_regionkey <> 2) SELECT set_id, unnest(['chr' || r_regionkey, 'B', 'C']) AS seqid FROM s")
def chromosome_sets(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    text = F.when(F.col("r_regionkey") == 2, "single # one name is no set").otherwise(F.concat(F.lit("chr"), "r_regionkey", F.lit(" B,C # note")))
    return fm.chromosome_sets(r.select(F.col("r_regionkey").alias("ord"), text.alias("value")))


@query("s27_copy_rules", "SELECT n_name AS species, CASE WHEN n_nationkey % 3 = 2 THEN 0 ELSE n_nationkey END AS low, CASE WHEN n_nationkey % 3 <> 1 THEN n_nationkey END AS high FROM nation")
def copy_rules(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sign = F.when(F.col("n_nationkey") % 3 == 1, "+").when(F.col("n_nationkey") % 3 == 2, "-").otherwise("")
    return fm.copy_rules(n.select(F.concat("n_name", F.lit("\t"), "n_nationkey", sign).alias("value")))


@query("s28_internal_intervals", "SELECT CAST(l_orderkey AS VARCHAR) AS name, min(l_partkey * 10 + 5) + 1 AS start1, max(l_partkey * 10) - 1 AS end1 FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2")
def internal_intervals(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumns({"s": F.col("l_partkey") * 10, "e": F.col("l_partkey") * 10 + 5})
    return fm.internal_intervals(lines(li, "l_orderkey", "l_orderkey", "s", "e"))


@query("s29_truth", "SELECT seqid, start0, end0, 'f' || id || CASE WHEN id % 3 = 0 THEN '_SOLO' ELSE '' END AS feature, 'CUT_BY:' || id AS extras, CASE WHEN id % 3 = 0 THEN 'solo' ELSE 'intact' END AS kind FROM uivl")
def truth(spark, sf_dir):
    u = _u(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), "id", F.when(F.col("id") % 3 == 0, "_SOLO").otherwise(""), F.lit(";CUT_BY:"), "id"))
    return fm.truth(lines(u, "id", "seqid", "start0", "end0", "name", "=TSD", "strand")).select("seqid", "start0", "end0", "feature", "extras", "kind")


@query("s31_best_links", "SELECT o_custkey AS query, arg_min(o_orderpriority, (-CAST(floor(o_totalprice / 1000) AS BIGINT), o_orderkey)) AS target FROM orders GROUP BY 1")
def best_links(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("strand"), F.floor(F.col("o_totalprice") / 1000).alias("score"))
    return fm.best_links(o).select("query", "target")


# sinks


def _blocks(spark, sf_dir):
    u = _u(spark, sf_dir)
    d = F.expr("array(named_struct('gene', 'RT', 'clade', family, 'start', start0 + 50, 'end', start0 + 60), named_struct('gene', 'RT', 'clade', '.', 'start', start0 + 70, 'end', start0 + 90))")
    return u.select(F.concat(F.lit("e"), F.lpad("id", 9, "0")).alias("block"), "seqid", (F.col("start0") + 1).alias("start1"), F.col("end0").alias("end1"), (F.col("start0") + 20).alias("l_end"), (F.col("end0") - 20).alias("r_start"), "strand", d.alias("domains"))


@query("k02_gff3_blocks", """
WITH u AS (SELECT *, 'e' || lpad(CAST(id AS VARCHAR), 9, '0') AS b FROM uivl),
p AS (SELECT b, seqid, strand, 0 AS part, start0 + 1 AS s, end0 AS e, 'repeat_region' AS t, 'ID=' || b AS a, start0 FROM u
 UNION ALL SELECT b, seqid, strand, 1, start0 + 1, start0 + 20, 'long_terminal_repeat', 'ID=' || b || '_5;Parent=' || b, start0 FROM u
 UNION ALL SELECT b, seqid, strand, 2, end0 - 20, end0, 'long_terminal_repeat', 'ID=' || b || '_3;Parent=' || b, start0 FROM u
 UNION ALL SELECT b, seqid, strand, 3, start0 + 50, start0 + 60, 'protein_match', 'ID=' || b || '_RT1;Parent=' || b || ';Name=RT;clade=' || family, start0 FROM u
 UNION ALL SELECT b, seqid, strand, 4, start0 + 70, start0 + 90, 'protein_match', 'ID=' || b || '_RT2;Parent=' || b || ';Name=RT', start0 FROM u)
SELECT b AS block, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN part > 0 THEN 1 ELSE 0 END, s, -e, part) AS line_no,
 concat_ws(chr(9), seqid, 'lociq', t, s, e, '.', strand, '.', a) AS line FROM p UNION ALL SELECT b, 1048576, '###' FROM u""")
def gff3_blocks(spark, sf_dir):
    """k03, k04 and z06 as well."""
    e = _blocks(spark, sf_dir)
    ranks = e.select("seqid").distinct().withColumn("rank", F.row_number().over(W.orderBy("seqid")))
    return sk.gff3_lines(sk.element_features(e), ranks).select("block", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("k05_inserted_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority AS strand, CAST(o_custkey % 7 AS VARCHAR) AS family, o_custkey FROM orders")
def inserted_columns(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.lit("old").alias("family"), "o_custkey", "o_orderpriority")
    o = o.withColumns({"strand": F.col("o_orderpriority"), "family": (F.col("o_custkey") % 7).cast("string")})
    return o.select(*sk.inserted_columns([c for c in o.columns if c != "o_orderpriority"], ["strand", "family"], "o_orderstatus"))


@query("k06_solo_names", "SELECT seqid, start0, end0, format('solo_{:04d}', row_number() OVER (ORDER BY seqid, start0, end0)) AS name FROM uivl")
def solo_names(spark, sf_dir):
    return sk.solo_names(_u(spark, sf_dir).select("seqid", "start0", "end0"))


@query("k07_bed6", "SELECT id, concat_ws(chr(9), seqid, start0, end0, family || '|' || id, CAST(least(greatest(round_even(weight / 300, 0), 0), 1000) AS BIGINT), strand) AS line FROM uivl")
def bed6(spark, sf_dir):
    u = _u(spark, sf_dir)
    return sk.bed6_lines(u, F.concat("family", F.lit("|"), "id"), F.col("weight") / 300).select("id", "line")


@query("k10_partitions", "SELECT c_mktsegment AS gene, 'DNA, ' || c_mktsegment || ' = ' || CAST(sum(count(*)) OVER (ORDER BY c_mktsegment) - count(*) + 1 AS BIGINT) || '-' || CAST(sum(count(*)) OVER (ORDER BY c_mktsegment) AS BIGINT) AS line FROM customer GROUP BY 1")
def partitions(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("gene")).agg(F.count("*").alias("length"))
    return sk.partition_lines(g).select("gene", "line")


@query("k09_report", "SELECT id, CASE WHEN end0 - start0 < 400 THEN 'too_short' WHEN end0 - start0 > 900 THEN 'too_long' ELSE 'kept' END AS reason FROM uivl")
def report(spark, sf_dir):
    n = F.col("end0") - F.col("start0")
    return _u(spark, sf_dir).select("id", F.when(n < 400, "too_short").when(n > 900, "too_long").otherwise("kept").alias("reason"))


# masks


def _masked_input(spark, sf_dir):
    d = view(spark, sf_dir, "dna").select(F.col("doc_id").alias("seqid"), "seq")
    spans = d.select("seqid", F.explode(F.array(F.struct((F.col("seqid") % 50).alias("s"), F.lit(30).alias("n"), F.lit(0).alias("d")), F.struct((F.col("seqid") % 70 + 60).alias("s"), F.lit(25).alias("n"), F.lit(1).alias("d")))).alias("x"))
    return d, spans.select("seqid", F.col("x.s").alias("start0"), (F.col("x.s") + F.col("x.n")).alias("end0"), F.col("x.d").alias("depth"))


#: The spans end before letter 200, so what is behind it needs no look at single letters.
MASK = "SELECT doc_id AS seqid, string_agg(CASE WHEN {hit} THEN {letter} ELSE substr(head, CAST(i + 1 AS INTEGER), 1) END, '' ORDER BY i) || any_value(rest) AS seq FROM (SELECT doc_id, substr(seq, 1, 200) AS head, {rest} AS rest, unnest(range(least(length(seq), 200))) AS i FROM dna WHERE length(seq) > 0) GROUP BY doc_id"
REST = "substr(seq, 201)"
FIRST, SECOND = "(i >= doc_id % 50 AND i < doc_id % 50 + 30)", "(i >= doc_id % 70 + 60 AND i < doc_id % 70 + 85)"


@query("m01_hard_mask", MASK.format(hit=f"{FIRST} OR {SECOND}", letter="'N'", rest=REST))
def hard_mask(spark, sf_dir):
    """m04 as well."""
    d, spans = _masked_input(spark, sf_dir)
    return mk.hard_mask(d.where("length(seq) > 0"), spans)


@query("m02_tri_state", MASK.format(hit=f"NOT ((i >= doc_id % 50 - 20 AND i < doc_id % 50 + 50) OR (i >= doc_id % 70 + 40 AND i < doc_id % 70 + 105)) OR {FIRST} OR {SECOND}", letter=f"CASE WHEN {FIRST} OR {SECOND} THEN 'N' ELSE 'V' END", rest="repeat('V', greatest(length(seq) - 200, 0))"))
def tri_state(spark, sf_dir):
    d, spans = _masked_input(spark, sf_dir)
    return mk.tri_state_mask(d.where("length(seq) > 0"), spans)


@query("m03_depth_paint", MASK.format(hit=f"{FIRST} OR {SECOND}", letter=f"CASE WHEN {SECOND} THEN 'R' ELSE 'N' END", rest=REST))
def depth_paint(spark, sf_dir):
    d, spans = _masked_input(spark, sf_dir)
    return mk.depth_paint(d.where("length(seq) > 0"), spans)


@query("m06_turned", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ref' ELSE 'r' || doc_id END AS name, CASE WHEN doc_id % 2 = 0 THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS seq FROM dna")
def turned(spark, sf_dir):
    """z16 as well: the reference copied, queries renamed and turned."""
    odd = F.col("doc_id") % 2 == 1
    return view(spark, sf_dir, "dna").select("doc_id", F.when(odd, F.concat(F.lit("r"), "doc_id")).otherwise("ref").alias("name"), F.when(odd, sq.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


@query("m07_excised", MASK.format(hit=f"{FIRST} OR {SECOND}", letter="''", rest=REST))
def excised(spark, sf_dir):
    d, spans = _masked_input(spark, sf_dir)
    return mk.excised(d.where("length(seq) > 0"), spans)


@query("i18_extracted", "SELECT doc_id AS seqid, substr(seq, CAST(doc_id % 50 + 1 AS INTEGER), 30) AS seq FROM dna WHERE length(seq) >= 100")
def extracted(spark, sf_dir):
    d, spans = _masked_input(spark, sf_dir)
    return mk.extracted(d.where("length(seq) >= 100"), spans.where("depth = 0")).select("seqid", "seq")


@query("i18_extracted_from_chunks", "SELECT doc_id AS id, substr(seq, CAST(doc_id % 50 + 1 AS INTEGER), 30) AS seq FROM dna WHERE length(seq) >= 100")
def extracted_from_chunks(spark, sf_dir):
    d, spans = _masked_input(spark, sf_dir)
    d = d.where("length(seq) >= 100")
    spans = spans.where("depth = 0").join(d.select("seqid"), "seqid", "left_semi").withColumn("id", F.col("seqid"))
    return mk.extracted_from_chunks(mk.chunked(d, 32), spans, 32)


# supplementary steps


@query("z01_strand_union", "SELECT o_custkey AS key, coalesce(arg_max(s, o_orderkey) FILTER (WHERE s <> '?'), '?') AS strand, count(DISTINCT s) FILTER (WHERE s <> '?') > 1 AS conflict FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '?' END AS s FROM orders) GROUP BY 1")
def strand_union(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise("?")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("s", s).withColumn("known", F.col("s") != "?")
    g = o.groupBy(F.col("o_custkey").alias("key")).agg(F.max_by("s", F.struct("known", "o_orderkey")).alias("strand"), F.count_distinct(F.when(F.col("known"), F.col("s"))).alias("n"))
    return g.select("key", "strand", (F.col("n") > 1).alias("conflict"))


@query("z02_first_key_wins", "SELECT o_custkey AS key, min(o_orderkey) AS first FROM orders GROUP BY 1")
def first_key_wins(spark, sf_dir):
    """z35 as well."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("first"))
    return rl.first_of(o, ["key"], ["first"])


@query("z04_seqid_rank", "WITH k AS (SELECT n_name AS seqid, n_nationkey + 1 AS rank FROM nation WHERE n_nationkey < 10), u AS (SELECT s_nationkey, min(s_suppkey) AS f FROM supplier WHERE s_nationkey >= 10 GROUP BY 1) SELECT seqid, CAST(rank AS BIGINT) AS rank FROM k UNION ALL SELECT n_name, 10 + row_number() OVER (ORDER BY f) FROM u JOIN nation ON s_nationkey = n_nationkey")
def seqid_rank(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    known = n.where("n_nationkey < 10").select(F.col("n_name").alias("seqid"), (F.col("n_nationkey") + 1).cast("bigint").alias("rank"))
    rest = s.join(n.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").join(known, F.col("n_name") == F.col("seqid"), "left_anti").groupBy("n_name").agg(F.min("s_suppkey").alias("f"))
    return known.unionByName(rest.select(F.col("n_name").alias("seqid"), (F.row_number().over(W.orderBy("f")) + 10).cast("bigint").alias("rank")))


@query("z05_lengths", "SELECT doc_id AS seqid, length(seq) AS n FROM dna")
def lengths(spark, sf_dir):
    return view(spark, sf_dir, "dna").select(F.col("doc_id").alias("seqid"), F.length("seq").alias("n").cast("bigint"))


@query("z11_mask_sources", """WITH s AS (SELECT seqid, start0, end0 FROM feature WHERE name = 'click' UNION ALL SELECT seqid, start0, end0 FROM feature WHERE name = 'view'),
f AS (SELECT *, CASE WHEN start0 <= max(end0) OVER (PARTITION BY seqid ORDER BY start0, end0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS f FROM s),
g AS (SELECT *, sum(f) OVER (PARTITION BY seqid ORDER BY start0, end0 ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT seqid, min(start0) AS start0, max(end0) AS end0 FROM g GROUP BY seqid, g""")
def mask_sources(spark, sf_dir):
    f = view(spark, sf_dir, "feature").select("seqid", "start0", "end0", "name")
    both = f.where("name = 'click'").unionByName(f.where("name = 'view'")).drop("name")
    return iv.merge(both, ["seqid"], gap=1)


@query("z12_mask_letters", "SELECT doc_id, length(t) - length(replace(t, 'n', '')) AS lower_n, length(t) - length(replace(t, 'N', '')) AS upper_n FROM (SELECT doc_id, text AS t FROM documents)")
def mask_letters(spark, sf_dir):
    t = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.length(F.regexp_replace(t, "[^n]", "")).alias("lower_n").cast("bigint"), F.length(F.regexp_replace(t, "[^N]", "")).alias("upper_n").cast("bigint"))


@query("z20_numbered_groups", "SELECT 'OG' || lpad(CAST(row_number() OVER (ORDER BY rep) AS VARCHAR), 5, '0') AS og, rep, count(*) AS n FROM member GROUP BY rep")
def numbered_groups(spark, sf_dir):
    g = view(spark, sf_dir, "member").groupBy("rep").agg(F.count("*").alias("n"))
    return g.select(F.concat(F.lit("OG"), F.lpad(F.row_number().over(W.orderBy("rep")).cast("string"), 5, "0")).alias("og"), "rep", "n")


@query("z22_plot_coordinates", "WITH l AS (SELECT seqid, max(end0) AS n FROM uivl GROUP BY 1), o AS (SELECT seqid, n, sum(n) OVER (ORDER BY seqid) - n + 100 * (row_number() OVER (ORDER BY seqid) - 1) AS off FROM l) SELECT id, CAST(off + CASE WHEN strand = '-' THEN n - start0 ELSE start0 END AS BIGINT) AS x FROM uivl JOIN o USING (seqid)")
def plot_coordinates(spark, sf_dir):
    u = _u(spark, sf_dir)
    n = u.groupBy("seqid").agg(F.max("end0").alias("n"))
    w = W.orderBy("seqid")
    n = n.withColumn("off", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") + 100 * (F.row_number().over(w) - 1))
    return u.join(n, "seqid").select("id", (F.col("off") + F.when(F.col("strand") == "-", F.col("n") - F.col("start0")).otherwise(F.col("start0"))).alias("x"))


@query("z23_constraint_accounting", "SELECT o_custkey % 20 AS node, count(*) AS incident, count(*) FILTER (WHERE o_orderstatus = 'F') AS satisfied, count(*) FILTER (WHERE o_orderstatus <> 'F') AS conflicting, round(avg(o_shippriority_), 6) AS weight FROM (SELECT *, o_orderkey % 9 AS o_shippriority_ FROM orders) GROUP BY 1")
def constraint_accounting(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ok = F.col("o_orderstatus") == "F"
    return o.groupBy((F.col("o_custkey") % 20).alias("node")).agg(F.count("*").alias("incident"), F.count_if(ok).alias("satisfied"), F.count_if(~ok).alias("conflicting"), F.round(F.avg(F.col("o_orderkey") % 9), 6).alias("weight"))


@query("z25_sweep", "WITH r AS (SELECT l_linenumber AS run, count(DISTINCT l_suppkey) AS used FROM lineitem GROUP BY 1) SELECT arg_max(run, (used, -run)) AS run, max(used) AS used FROM r")
def sweep(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("run")).agg(F.count_distinct("l_suppkey").alias("used"))
    return r.agg(F.max_by("run", F.struct("used", -F.col("run"))).alias("run"), F.max("used").alias("used"))


@query("z26_inferred_lengths", "SELECT seqid, max(end0) AS length FROM ivl GROUP BY 1")
def inferred_lengths(spark, sf_dir):
    return view(spark, sf_dir, "ivl").groupBy("seqid").agg(F.max("end0").alias("length"))


@query("z27_categories", "SELECT id, CASE WHEN weight < 20000 THEN 'post_polyploid' WHEN weight > 200000 THEN 'pre_polyploid' ELSE 'ambiguous' END AS category FROM uivl")
def categories(spark, sf_dir):
    return _u(spark, sf_dir).select("id", F.when(F.col("weight") < 20_000, "post_polyploid").when(F.col("weight") > 200_000, "pre_polyploid").otherwise("ambiguous").alias("category"))


@query("z30_off_axis", "SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 9) AS fraction FROM orders GROUP BY 1")
def off_axis(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(F.round(F.avg((F.col("o_totalprice") > 200_000).cast("double")), 9).alias("fraction"))


@query("z31_family_pages", "WITH n AS (SELECT o_custkey AS rep, count(*) AS n, quantile_cont(o_totalprice, 0.95) AS axis FROM orders GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'singletons' ELSE CAST(rep AS VARCHAR) END AS page, CAST(sum(n) AS BIGINT) AS n, round(greatest(max(axis), 0.05), 4) AS axis FROM n WHERE n = 1 OR n >= 3 GROUP BY 1")
def family_pages(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("rep")).agg(F.count("*").alias("n"), F.percentile("o_totalprice", 0.95).alias("axis"))
    page = F.when(F.col("n") == 1, "singletons").otherwise(F.col("rep").cast("string"))
    return n.where("n = 1 or n >= 3").groupBy(page.alias("page")).agg(F.sum("n").alias("n"), F.round(F.greatest(F.max("axis"), F.lit(0.05)), 4).alias("axis"))


@query("z34_widest_hit", "SELECT l_orderkey, l_linenumber, arg_max(l_partkey, (l_quantity, -l_partkey)) AS hit FROM lineitem GROUP BY ALL")
def widest_hit(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_partkey"))).alias("hit"))


@query("z36_dubious", "SELECT p_partkey, len(list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda x: x IN ('mixture', 'unknown', 'green'))) > 0 AS dubious FROM part")
def dubious(spark, sf_dir):
    tokens = F.split(F.lower("p_name"), "[^a-z]+", -1)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.exists(tokens, lambda t: t.isin("mixture", "unknown", "green")).alias("dubious"))


@query("z43_viewer_json", "SELECT id, '{\"id\":' || id || ',\"seqid\":\"' || seqid || '\",\"spans\":[' || start0 || ',' || end0 || ']}' AS json FROM uivl")
def viewer_json(spark, sf_dir):
    """k11: what a viewer needs, as JSON; drawing stays outside."""
    return _u(spark, sf_dir).select("id", F.to_json(F.struct("id", "seqid", F.array("start0", "end0").alias("spans"))).alias("json"))

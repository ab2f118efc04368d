"""Queries of the parsers, sequence functions and predicates."""

from pyspark.sql import functions as F

from ..functions import parsing as ps
from ..functions import sequence as sq
from .fixtures import pieces, view
from .registry import query

NAMES = "(SELECT id, concat(seqid, ':', CAST(end0 AS VARCHAR), '-', CAST(start0 AS VARCHAR), '#LTR/', CASE WHEN id % 3 = 0 THEN 'Copia/Ale' WHEN id % 3 = 1 THEN 'Gypsy' ELSE '' END) AS name FROM uivl)"


def _names(spark, sf_dir):
    kind = F.when(F.col("id") % 3 == 0, "Copia/Ale").when(F.col("id") % 3 == 1, "Gypsy").otherwise("")
    return view(spark, sf_dir, "uivl").select("id", F.concat("seqid", F.lit(":"), F.col("end0"), F.lit("-"), F.col("start0"), F.lit("#LTR/"), kind).alias("name"))


@query("p01_locus", "SELECT id, seqid, start0 AS \"start\", end0 AS \"end\" FROM uivl")
def locus(spark, sf_dir):
    return _names(spark, sf_dir).select("id", ps.locus(F.col("name")).alias("l")).select("id", "l.seqid", "l.start", "l.end")


@query("p02_classification", "SELECT id, 'LTR' AS \"order\", CASE WHEN id % 3 = 0 THEN 'Copia' WHEN id % 3 = 1 THEN 'Gypsy' ELSE 'unknown' END AS superfamily, CASE WHEN id % 3 = 0 THEN 'Ale' ELSE 'unknown' END AS clade FROM uivl")
def classification(spark, sf_dir):
    return _names(spark, sf_dir).select("id", ps.classification(ps.locus(F.col("name"))["cls"]).alias("c")).select("id", "c.*")


@query("p03_accession", "SELECT DISTINCT seq1, split_part(seq1, '_', 1) AS first, regexp_replace(seq1, '_[^_]*$', '') AS last FROM block")
def accession(spark, sf_dir):
    return view(spark, sf_dir, "block").select("seq1", ps.accession(F.col("seq1")).alias("first"), ps.accession(F.col("seq1"), True).alias("last")).distinct()


@query("p04_gene_token", "SELECT p_partkey, 'Zm' AS species, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS number, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS copy FROM part")
def gene_token(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    token = F.concat(F.lit("Zm"), F.lpad("p_partkey", 6, "0"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), "p_size")).otherwise(""))
    return part.select("p_partkey", ps.gene_token(token).alias("g")).select("p_partkey", "g.*")


@query("p06_species", "SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'Bdact' WHEN 1 THEN 'Cdact' ELSE 'Etef' END AS species FROM orders")
def species(spark, sf_dir):
    name = F.element_at(F.array(F.lit("Bdact_chr"), F.lit("Cdact"), F.lit("Etef_sca")), (F.col("o_custkey") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ps.species(F.concat(name, "o_orderkey")).alias("species"))


@query("p07_chromosome", """
SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN CAST(o_orderkey % 30 AS VARCHAR) WHEN 1 THEN 'X' WHEN 2 THEN CAST(o_orderkey % 30 AS VARCHAR) WHEN 3 THEN CAST(o_orderkey % 30 AS VARCHAR) END AS number,
CASE o_custkey % 5 WHEN 2 THEN 'B' WHEN 3 THEN 'AA' END AS letter FROM orders""")
def chromosome(spark, sf_dir):
    """Headers >Chrom 3, >chrX, >Chr-02b, >CHR 04Aa, and >scaffold_5, which names none."""
    n = (F.col("o_orderkey") % 30).cast("string")
    forms = [F.concat(F.lit(">Chrom "), n), F.lit(">chrX"), F.concat(F.lit(">Chr-0"), n, F.lit("b")), F.concat(F.lit(">CHR 00"), n, F.lit("Aa first")), F.concat(F.lit(">scaffold_"), n)]
    header = F.element_at(F.array(*forms), (F.col("o_custkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ps.chromosome(header).alias("c")).select("o_orderkey", "c.*")


@query("p08_signature", "SELECT regexp_replace(c_name, '[0-9]+', '#', 'g') AS signature, count(*) AS n FROM customer GROUP BY 1")
def signature(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(ps.signature(F.col("c_name")).alias("signature")).agg(F.count("*").alias("n"))


@query("p09_natural_order", types={"place": "INTEGER"}, sql="SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")
def natural_order(spark, sf_dir):
    from pyspark.sql import Window as W

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("chr"), "c_custkey").alias("name"))
    return c.select("c_custkey", F.row_number().over(W.orderBy(ps.natural_key(F.col("name")))).alias("place"))


@query("p10_letters", """
WITH RECURSIVE l AS (SELECT p_partkey, p_partkey * 7 AS rest, '' AS letters FROM part
 UNION ALL SELECT p_partkey, (rest - 1) // 26, chr(CAST(65 + (rest - 1) % 26 AS INTEGER)) || letters FROM l WHERE rest > 0)
SELECT p_partkey, nullif(letters, '') AS letters FROM l WHERE rest = 0""")
def letters(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", ps.letters(F.col("p_partkey") * 7).alias("letters"))


def _cells(spark, sf_dir):
    cell = F.concat(F.lit("aRNase H|Ale@"), "start0", F.lit("-"), "end0", F.when(F.col("id") % 5 == 0, ";broken").otherwise(""), F.lit(";RT|"), "family", F.lit("@"), "end0", F.lit("-"), "start0")
    return view(spark, sf_dir, "uivl").select("id", cell.alias("cell"))


@query("p11_domains_strict", "SELECT id, CASE WHEN id % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN id % 5 <> 0 THEN end0 END AS second FROM uivl")
def domains_strict(spark, sf_dir):
    return _cells(spark, sf_dir).withColumn("d", ps.domains(F.col("cell"))).select("id", F.size("d").alias("n"), F.get("d", 1)["start"].alias("second"))


@query("p11_domains_lenient", "SELECT id, 2 AS n, 'ARH' AS gene, start0 AS second, family AS clade FROM uivl")
def domains_lenient(spark, sf_dir):
    d = _cells(spark, sf_dir).withColumn("d", ps.domains(F.col("cell"), "lenient"))
    return d.select("id", F.size("d").alias("n"), F.get("d", 0)["gene"].alias("gene"), F.get("d", 1)["start"].alias("second"), F.get("d", 1)["clade"].alias("clade"))


@query("p12_nests", "SELECT id, CASE WHEN id % 2 = 0 THEN seqid || ':' || start0 || '-' || end0 END AS outer_key, CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS n FROM uivl")
def nests(spark, sf_dir):
    key = F.concat("seqid", F.lit(":"), "start0", F.lit("-"), "end0")
    u = view(spark, sf_dir, "uivl").withColumn("cell", F.when(F.col("id") % 2 == 0, F.concat(F.lit("nest-outer:"), key, F.lit(";nest-inner:chr1:5-9"))).otherwise("."))
    return u.select("id", F.get(ps.nests(F.col("cell"), "outer"), 0)["key"].alias("outer_key"), F.size(ps.nests(F.col("cell"))).alias("n"))


PROTEIN_NAMES = [("ap", "AP"), ("Reverse-transcriptase", "REVERSETRANSCRIPTASE"), ("aRNase H", "ARH"), ("RNase-H", "RH"), ("chdcr", "CHDCR"), (" integrase", "INT"), ("Protease", "PROT")]


@query("p13_proteins", "SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(PROTEIN_NAMES)) + " END AS protein FROM events")
def proteins(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(raw) for raw, _ in PROTEIN_NAMES]), (F.col("event_id") % 7 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ps.protein(name).alias("protein"))


CLADE_PATHS = [
    ("Class_I/LTR/Ty1_copia/Ale", "LTR", "Copia"), ("Class_I/LTR/Ty3_gypsy/chromovirus", "LTR", "Gypsy"), ("Class_I/LTR/Retrovirus", "LTR", "Retrovirus"), ("Class_I/LINE", "LINE", "unknown"),
    ("Class_I/SINE/tRNA", "SINE", "tRNA"), ("Class_II/Subclass_1/TIR/hAT", "TIR", "hAT"), ("Class_II/Subclass_2", "unknown", "unknown"), ("NA_x", "LTR", "Retrovirus"), ("Ale", "unknown", "unknown"),
]


@query("p14_clade_path", "SELECT o_orderkey, " + ", ".join(f"CASE o_orderkey % 9 {' '.join(f'WHEN {i} THEN {chr(39)}{p[k]}{chr(39)}' for i, p in enumerate(CLADE_PATHS))} END AS \"{n}\"" for k, n in ((1, "order"), (2, "superfamily"))) + " FROM orders")
def clade_path(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(p[0]) for p in CLADE_PATHS]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ps.clade_path(path).alias("c")).select("o_orderkey", "c.*")


@query("p15_sanitised", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE regexp_replace(trim(c_mktsegment), '[^A-Za-z0-9._-]+', '_', 'g') || '_' || regexp_replace(c_name, '[^A-Za-z0-9._-]+', '_', 'g') END AS name FROM customer")
def sanitised(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, "/ _ /").otherwise(F.concat(F.lit("_ "), "c_mktsegment", F.lit(" / "), "c_name", F.lit("_ ")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", ps.sanitised(name).alias("name"))


@query("p16_attributes", "SELECT o_orderkey, o_orderpriority AS Name FROM orders")
def attributes(spark, sf_dir):
    a = F.concat(F.lit("ID=x"), "o_orderkey", F.lit(";Name="), "o_orderpriority", F.lit(";Note=z"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", ps.attribute(a, "Name").alias("Name"))


@query("p17_pair_lengths", "SELECT okey, line, greatest(e1 - s1, 0) AS \"left\", greatest(e2 - s2, 0) AS \"right\" FROM block")
def pair_lengths(spark, sf_dir):
    return view(spark, sf_dir, "block").select("okey", "line", ps.lengths_of_pair(*map(F.col, ("s1", "e1", "s2", "e2"))).alias("l")).select("okey", "line", "l.*")


@query("p20_amino_to_genome", "SELECT id, CASE WHEN strand = '-' THEN 5000 - (((weight % 300) + 50) * 3 + id % 3) + 1 ELSE (weight % 300) * 3 + id % 3 + 1 END AS \"start\", CASE WHEN strand = '-' THEN 5000 - ((weight % 300) * 3 + id % 3 + 1) + 1 ELSE ((weight % 300) + 50) * 3 + id % 3 END AS \"end\" FROM uivl")
def amino_to_genome(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").withColumn("s", F.col("weight") % 300 + 1).withColumn("e", F.col("weight") % 300 + 50)
    return u.select("id", ps.amino_to_genome(F.col("s"), F.col("e"), F.col("id") % 3, F.lit(5000), F.col("strand")).alias("x")).select("id", "x.*")


@query("p21_flipped", "SELECT id, CASE WHEN strand = '-' THEN 900 - (weight % 100 + 50) + 1 ELSE weight % 100 END AS \"start\", CASE WHEN strand = '-' THEN 900 - weight % 100 + 1 ELSE weight % 100 + 50 END AS \"end\" FROM uivl")
def flipped(spark, sf_dir):
    return view(spark, sf_dir, "uivl").select("id", ps.flipped(F.col("weight") % 100, F.col("weight") % 100 + 50, F.lit(900), F.col("strand")).alias("x")).select("id", "x.*")


@query("p22_collapsed", "SELECT id, start0 - greatest(least(start0, 5000000) - 1000000, 0) - greatest(least(start0, 9500000) - 9000000, 0) AS position FROM uivl")
def collapsed(spark, sf_dir):
    cuts = F.expr("array(named_struct('start', 1000000L, 'end', 5000000L), named_struct('start', 9000000L, 'end', 9500000L))")
    return view(spark, sf_dir, "uivl").select("id", ps.collapsed(F.col("start0"), cuts).alias("position"))


@query("p23_chunk_lift", "SELECT id, seqid, start0, end0 FROM uivl")
def chunk_lift(spark, sf_dir):
    """z09 as well: chunk ids are parsed, and chunk-local ends lifted."""
    u = view(spark, sf_dir, "uivl")
    at = F.floor(F.col("start0") / 500_000) * 500_000
    u = u.select("id", F.format_string("%s__chunk%d__%d-%d", "seqid", (at / 500_000).cast("bigint"), at, at + 500_000).alias("chunk"), (F.col("start0") - at).alias("s"), (F.col("end0") - at).alias("e"))
    pattern = r"^(.+)__chunk(\d+)__(\d+)-(\d+)$"
    base = F.regexp_extract("chunk", pattern, 3).cast("bigint")
    return u.select("id", F.regexp_extract("chunk", pattern, 1).alias("seqid"), (F.col("s") + base).alias("start0"), (F.col("e") + base).alias("end0"))


@query("p24_strand_bounds", "SELECT id, start0 AS qlo, end0 AS qhi FROM uivl")
def strand_bounds(spark, sf_dir):
    u = view(spark, sf_dir, "uivl").withColumn("a", F.when(F.col("strand") == "-", F.col("end0")).otherwise(F.col("start0"))).withColumn("b", F.when(F.col("strand") == "-", F.col("start0")).otherwise(F.col("end0")))
    return u.select("id", F.least("a", "b").alias("qlo"), F.greatest("a", "b").alias("qhi"))


@query("p25_percent_scale", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 100, 6) AS pident FROM lineitem")
def percent_scale(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    most = li.agg(F.max("l_discount").alias("most"))
    return li.join(F.broadcast(most)).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.when(F.col("most") <= 1, F.col("l_discount") * 100).otherwise(F.col("l_discount")), 6).alias("pident"))


@query("p19_pair_to_scn", "SELECT okey, line, least(s1, s2) AS s, greatest(e1, e2) AS e, CASE WHEN (s1, e1) <= (s2, e2) THEN e1 - s1 ELSE e2 - s2 END AS left_length FROM block")
def pair_to_scn(spark, sf_dir):
    a, b = F.struct(F.col("s1").alias("s"), F.col("e1").alias("e")), F.struct(F.col("s2").alias("s"), F.col("e2").alias("e"))
    rows = view(spark, sf_dir, "block").withColumns({"left": F.least(a, b), "right": F.greatest(a, b)})
    return rows.select("okey", "line", F.col("left.s").alias("s"), F.greatest("left.e", "right.e").alias("e"), (F.col("left.e") - F.col("left.s")).alias("left_length"))


# sequences


@query("x01_reverse_complement", "SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM dna")
def reverse_complement(spark, sf_dir):
    return view(spark, sf_dir, "dna").select("doc_id", sq.reverse_complement(F.col("seq")).alias("rc"))


@query("a13_kmer_counts", """
WITH k AS (SELECT doc_id % 10 AS seqid, piece AS kmer FROM (""" + pieces(7) + """)),
c AS (SELECT seqid, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM k)
SELECT seqid, kmer, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 3""")
def kmer_counts(spark, sf_dir):
    d = view(spark, sf_dir, "dna").select((F.col("doc_id") % 10).alias("seqid"), "seq")
    return sq.kmer_counts(d, "seqid", "seq", 7, canonical=True).where("n >= 3")


@query("x02_canonical", "SELECT doc_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT doc_id, substr(seq, 1, 21) AS k FROM dna)")
def canonical(spark, sf_dir):
    """The string or its reverse complement, of a sequence's first 21-mer."""
    return view(spark, sf_dir, "dna").select("doc_id", sq.canonical(F.substring("seq", 1, 21)).alias("kmer"))


@query("a14_kmer_totals", "SELECT doc_id % 10 AS seqid, CAST(sum(greatest(length(seq) - 6, 0)) AS BIGINT) AS total FROM dna GROUP BY 1")
def kmer_totals(spark, sf_dir):
    return view(spark, sf_dir, "dna").groupBy((F.col("doc_id") % 10).alias("seqid")).agg(F.sum(F.greatest(F.length("seq") - 6, F.lit(0))).alias("total"))


@query("x06_distances", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS p, l_tax * 100 AS q, 400.0 AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((p + q) / n, 9) AS raw, round(-0.75 * ln(1 - 4 * (p + q) / n / 3), 9) AS jc69,
round(-0.5 * ln((1 - 2 * p / n - q / n) * sqrt(1 - 2 * q / n)), 9) AS k2p FROM d""")
def distances(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = sq.distances(F.col("l_quantity"), F.col("l_tax") * 100, F.lit(400.0))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(x[c], 9).alias(c) for c in ("raw", "jc69", "k2p")])


@query("x07_btop", types={"transitions": "BIGINT", "transversions": "BIGINT"}, sql="SELECT o_orderkey, o_custkey % 100 + 7 AS matches, 2 AS transitions, 1 AS transversions FROM orders")
def btop(spark, sf_dir):
    b = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("AG5-AN-CT2GC"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", sq.btop_counts(b).alias("c")).select("o_orderkey", "c.*")


@query("x09_gap_compressed_identity", "SELECT o_orderkey, round((o_custkey % 100 + 10) / (o_custkey % 100 + 10 + 3 + 2), 9) AS identity FROM orders")
def gap_identity(spark, sf_dir):
    c = F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("=3X10I4=2D6="))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(sq.gap_compressed_identity(c), 9).alias("identity"))


FLANKS = "f AS (SELECT doc_id, substr(seq, 1, 14) AS l, substr(seq, 40, 14) AS r FROM dna WHERE length(seq) >= 60)"


@query("x11_tsd", f"""
WITH {FLANKS}, s AS (SELECT doc_id, r, k, i, substr(l, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS s FROM (SELECT *, unnest(range(1, 16 - k)) AS i FROM (SELECT *, unnest(range(5, 15)) AS k FROM f))),
b AS (SELECT doc_id, arg_min(s, (-k, i)) AS tsd FROM s WHERE contains(r, s) AND len(list_distinct(string_split(s, ''))) >= 2 GROUP BY doc_id)
SELECT doc_id, tsd FROM f LEFT JOIN b USING (doc_id)""")
def tsd(spark, sf_dir):
    d = view(spark, sf_dir, "dna").where("length(seq) >= 60")
    return d.select("doc_id", sq.shared_substring(F.substring("seq", 1, 14), F.substring("seq", 40, 14)).alias("tsd"))


@query("x12_tsd_jitter", types={"tsd_length": "INTEGER", "tsd_subs": "INTEGER", "tsd_jitter": "INTEGER"}, sql=f"""
WITH {FLANKS}, g AS (SELECT * FROM f, range(4, 7) n(n), range(0, 3) i(i), range(0, 3) j(j)),
p AS (SELECT *, substr(l, CAST(15 - i - n AS INTEGER), CAST(n AS INTEGER)) AS p, substr(r, CAST(j + 1 AS INTEGER), CAST(n AS INTEGER)) AS q FROM g),
d AS (SELECT *, hamming(p, q) AS d FROM p WHERE len(list_distinct(string_split(p, ''))) >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, d, i + j, p DESC) AS k FROM d WHERE d <= 1)
SELECT f.doc_id, n AS tsd_length, d AS tsd_subs, i + j AS tsd_jitter, p AS tsd FROM f LEFT JOIN b ON f.doc_id = b.doc_id AND k = 1""")
def tsd_jitter(spark, sf_dir):
    d = view(spark, sf_dir, "dna").where("length(seq) >= 60").select("doc_id", F.substring("seq", 1, 14).alias("l"), F.substring("seq", 40, 14).alias("r"))
    return sq.tsd_search(d, "l", "r").drop("l", "r")


@query("x15_motif", "SELECT doc_id, CASE WHEN length(seq) < 2 THEN 'NA' ELSE upper(substr(seq, 1, 2)) || '…' || upper(right(seq, 2)) END AS motif FROM dna")
def motif(spark, sf_dir):
    return view(spark, sf_dir, "dna").select("doc_id", sq.motif(F.lower("seq")).alias("motif"))


@query("x16_hamming", types={"d": "INTEGER"}, sql="SELECT doc_id, hamming(substr(seq, 1, 30), substr(seq, 31, 30)) AS d FROM dna WHERE length(seq) >= 60")
def hamming(spark, sf_dir):
    return view(spark, sf_dir, "dna").where("length(seq) >= 60").select("doc_id", sq.hamming(F.substring("seq", 1, 30), F.substring("seq", 31, 30)).alias("d"))


PLACES = " + ".join(f"{w} * (strpos('TCAG', substr(piece, {j}, 1)) - 1)" for j, w in ((1, 16), (2, 4), (3, 1)))


@query("x17_translate", f"SELECT doc_id, coalesce(pep, '') AS pep FROM dna LEFT JOIN (SELECT doc_id, string_agg(substr('{sq.AMINO}', CAST({PLACES} + 1 AS INTEGER), 1), '' ORDER BY i) AS pep FROM ({pieces(3, 3)}) GROUP BY doc_id) USING (doc_id)")
def translate(spark, sf_dir):
    return sq.translate_codons(view(spark, sf_dir, "dna"), "seq").select("doc_id", "pep")


@query("x18_clean_lifted", "SELECT doc_id, replace(regexp_replace(regexp_replace(text || '~12~-aB', '~[0-9]+~', '', 'g'), '[a-z]', '', 'g'), '-', '') AS t FROM documents")
def clean_lifted(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", sq.clean_lifted(F.concat("text", F.lit("~12~-aB"))).alias("t"))


@query("x19_masked_fraction", types={"bp": "INTEGER"}, sql="SELECT doc_id, length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS bp, round(1 - length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) / length(text), 9) AS masked FROM documents WHERE length(text) > 0")
def masked_fraction(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 0")
    return d.select("doc_id", sq.acgt_bp(F.col("text")).alias("bp"), F.round(sq.masked_fraction(F.col("text")), 9).alias("masked"))


@query("x20_age", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount / 6e-8, 3) AS age FROM lineitem")
def age(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.round(sq.age(F.col("l_discount")), 3).alias("age"))


@query("m05_strip_non_acgt", "SELECT doc_id, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS seq FROM documents")
def strip(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", sq.strip_non_acgt(F.col("text")).alias("seq"))


# predicates


@query("f01_size_filter", "SELECT count(*) FILTER (WHERE end0 - start0 < 400) AS too_short, count(*) FILTER (WHERE end0 - start0 > 900) AS too_long, count(*) FILTER (WHERE end0 - start0 BETWEEN 400 AND 900) AS kept FROM uivl")
def size_filter(spark, sf_dir):
    n = F.col("end0") - F.col("start0")
    return view(spark, sf_dir, "uivl").agg(F.count_if(n < 400).alias("too_short"), F.count_if(n > 900).alias("too_long"), F.count_if(n.between(400, 900)).alias("kept"))


@query("f02_quality_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity * 10 >= 100 AND l_extendedprice >= 90 AND least(l_quantity, 30) / greatest(l_quantity, 30) >= 0.65 AND l_quantity * 100 >= 300")
def quality_filter(spark, sf_dir):
    q = F.col("l_quantity")
    ratio = F.least(q, F.lit(30.0)) / F.greatest(q, F.lit(30.0))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where((q * 10 >= 100) & (F.col("l_extendedprice") >= 90) & (ratio >= 0.65) & (q * 100 >= 300)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f03_alignment_filter", "SELECT okey, line, s1 FROM block WHERE (e1 - s1) >= 500 AND (e2 - s2) / (e1 - s1) >= 0.9")
def alignment_filter(spark, sf_dir):
    return view(spark, sf_dir, "block").where("e1 - s1 >= 500 and (e2 - s2) / (e1 - s1) >= 0.9").select("okey", "line", "s1")


@query("f05_pass_geometry", "SELECT DISTINCT seq1, s1, e1, strand FROM block WHERE strand = '+' AND e1 > s1 AND s2 < e2")
def pass_geometry(spark, sf_dir):
    return view(spark, sf_dir, "block").where("strand = '+' and e1 > s1 and s2 < e2").select("seq1", "s1", "e1", "strand").distinct()


@query("f06_no_mixture", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)\\b(license|mixture)\\b')")
def no_mixture(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(~F.col("text").rlike(r"(?i)\b(license|mixture)\b")).select("doc_id")


@query("f07_end_rule", "SELECT id FROM uivl WHERE start0 % 1000 <= 1 + 200 AND start0 % 1000 + (end0 - start0) >= 1000 - 200")
def end_rule(spark, sf_dir):
    lo = F.col("start0") % 1000
    return view(spark, sf_dir, "uivl").where((lo <= 201) & (lo + F.col("end0") - F.col("start0") >= 800)).select("id")


@query("f08_hsp_thresholds", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount >= 0.05 AND l_quantity >= 20 AND l_tax <= 0.04")
def hsp_thresholds(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_discount >= 0.05 and l_quantity >= 20 and l_tax <= 0.04").select("l_orderkey", "l_linenumber", "l_partkey")


@query("f09_run_signature", "SELECT doc_id FROM dna WHERE regexp_matches(seq, 'C{1,}A{1,}G{1,}A{1,}C{1,}')")
def run_signature(spark, sf_dir):
    return view(spark, sf_dir, "dna").where(F.col("seq").rlike(sq.run_signature("G", "AC", 1, 1))).select("doc_id")


@query("f10_no_runs", "SELECT doc_id FROM dna WHERE NOT regexp_matches(seq, 'A{6,}')")
def no_runs(spark, sf_dir):
    return view(spark, sf_dir, "dna").where(~F.col("seq").rlike("A{6,}")).select("doc_id")


@query("f16_by_pattern", "SELECT DISTINCT seqid FROM ivl WHERE regexp_matches(seqid, '^chr[0-4]$')")
def by_pattern(spark, sf_dir):
    return view(spark, sf_dir, "ivl").select("seqid").distinct().where(F.col("seqid").rlike("^chr[0-4]$"))


@query("f18_non_ltr", "SELECT event_type, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, '(?i)CLICK') GROUP BY 1")
def non_ltr(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(~F.col("event_type").rlike("(?i)CLICK")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("f20_flag_filter", "SELECT event_id FROM events WHERE (user_id & 2308) = 0 AND value >= 5")
def flag_filter(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where((F.col("user_id").bitwiseAND(F.lit(0x904).cast("bigint")) == 0) & (F.col("value") >= 5)).select("event_id")


@query("f21_shared_names", "SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def shared_names(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.count_distinct("l_returnflag").alias("n")).where("n > 1").select("l_suppkey")

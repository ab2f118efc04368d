"""Readers. Each format is a parser over lines (value, ord) and so works on files and on tables of lines alike.

``read_lines`` keeps the order of a file: its splits by their offset, the lines of a split in turn. Coordinates become
0-based half-open on the way in where a format says what it has. Rows that don't parse are kept apart: ``rejects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, value: ord sorts as the file does. Compressed files are known by their suffix."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"))
    rows = rows.withColumn("__i", F.monotonically_increasing_id())
    return rows.select("file", F.struct("__at", "__i").alias("ord"), "value")


def fields(lines: DataFrame, names: str, sep: str = "\t", comment: str = "#", least: int | None = None) -> DataFrame:
    """Columns of the DDL ``names`` from separated lines; short lines and comments go; the rest is cast."""
    columns = [n.strip().split(" ") for n in names.split(",")]
    part = F.split("value", sep)
    rows = lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment) & (F.size(part) >= (least or len(columns))))
    keep = [c for c in lines.columns if c != "value"]
    kept = [F.col(c) for c in keep]
    return rows.select(*kept, *[F.nullif(F.get(part, i), F.lit(".")).try_cast(t).alias(n) if t != "string" else F.get(part, i).alias(n) for i, (n, t) in enumerate(columns)])


def rejects(lines: DataFrame, least: int, sep: str = "\t", comment: str = "#") -> DataFrame:
    """Lines that aren't comments and have too few fields."""
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith(comment) & (F.size(F.split("value", sep)) < least))


def fasta(lines: DataFrame, by: str | None = "file") -> DataFrame:
    """seqid, description, ord, seq. The id is the header's first word; its lines are joined.

    Headers are counted along the file; where a file is one long sequence, read it with ``read_fasta``, whose splits
    begin at headers.
    """
    keys = [by] if by else []
    w = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("rec", F.sum(F.col("value").startswith(">").cast("int")).over(w)).where("rec > 0")
    header = F.max(F.when(F.col("value").startswith(">"), F.substring("value", 2, 1 << 30)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("ord", F.trim("value").alias("v"))))), lambda x: x["v"]), "")
    out = rows.groupBy(*keys, "rec").agg(header.alias("h"), body.alias("seq"))
    return out.select(*keys, F.col("rec").alias("ord"), F.split_part(F.regexp_replace("h", r"\s+", " "), F.lit(" "), F.lit(1)).alias("seqid"), F.regexp_replace("h", r"^\S*\s*", "").alias("description"), "seq")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, seqid, description, seq: records are split at line starts with >, so nothing is gathered."""
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"))
    rows = rows.withColumn("ord", F.struct("__at", F.monotonically_increasing_id())).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.trim("value") != "")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", "")
    return rows.select("file", "ord", F.split_part(F.regexp_replace(head, r"\s+", " "), F.lit(" "), F.lit(1)).alias("seqid"), F.regexp_replace(head, r"^\S*\s*", "").alias("description"), seq.alias("seq"))


def headers_only(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).where(F.col("value").startswith(">")).select("file", "ord", F.regexp_extract("value", r"^>(\S*)", 1).alias("seqid"))


def fai(lines: DataFrame) -> DataFrame:
    return fields(lines, "seqid string, length bigint", least=2)


def bed(lines: DataFrame) -> DataFrame:
    """BED with gene ids; of repeated ids the last line wins."""
    from ..operators.relational import last_of

    rows = fields(lines.where(~F.col("value").rlike("^(track|browser)")), "seqid string, start0 bigint, end0 bigint, gene string", least=4)
    return last_of(rows, ["gene"], ["ord"])


def gff3(lines: DataFrame) -> DataFrame:
    """seqid, source, type, start0, end0, score, strand, phase, attributes (map)."""
    rows = fields(lines, "seqid string, source string, type string, start1 bigint, end0 bigint, score double, strand string, phase int, attrs string")
    return rows.withColumn("start0", F.col("start1") - 1).withColumn("attributes", F.str_to_map("attrs", F.lit(";"), F.lit("="))).drop("start1", "attrs")


def gff3_features(lines: DataFrame, types: list[str]) -> DataFrame:
    return gff3(lines).where(F.col("type").isin(*types)).select("seqid", "start0", "end0", "type")


def gff3_states(lines: DataFrame) -> DataFrame:
    """mRNA rows with the ##STA and ##ATN comments that stand before them. lines: file, ord, value."""
    w = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    last = lambda tag: F.last(F.when(F.col("value").startswith(f"##{tag}"), F.regexp_replace("value", rf"^##{tag}\s*", "")), ignorenulls=True).over(w)
    rows = lines.withColumns({"sta": last("STA"), "atn": last("ATN")}).where(F.col("value").rlike(r"^[^#][^\t]*\t[^\t]*\tmRNA\t"))
    return rows.select("file", "ord", "sta", "atn", F.regexp_extract("value", r"ID=([^;]+)", 1).alias("mrna"))


def gene_tree(features: DataFrame) -> DataFrame:
    """gene, mrna, exons: from ``gff3`` rows by ID and Parent."""
    a = F.col("attributes")
    m = features.where("type = 'mRNA'").select(a["ID"].alias("mrna"), a["Parent"].alias("gene"))
    e = features.where("type in ('exon', 'CDS')").select(a["Parent"].alias("mrna"), F.struct("start0", "end0", "type").alias("exon"))
    return m.join(e, "mrna", "left").groupBy("gene", "mrna").agg(F.array_sort(F.collect_list("exon")).alias("exons"))


def scn(lines: DataFrame) -> DataFrame:
    """Repeat-pair candidates; the sequence is the last field; of equal keys the last line wins."""
    from ..operators.relational import last_of

    p = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(p) >= 12) & F.trim("value").rlike(r"^\d+\s+\d+"))
    names = ["s_ret", "e_ret", "l_ret", "s_lltr", "e_lltr", "l_lltr", "s_rltr", "e_rltr", "l_rltr"]
    rows = rows.select("ord", *[F.get(p, i).cast("bigint").alias(n) for i, n in enumerate(names)], F.get(p, 9).cast("double").alias("sim"), F.get(p, 10).cast("bigint").alias("seq_nr"), F.element_at(p, -1).alias("seqid"))
    return last_of(rows, ["seqid", "s_ret", "e_ret"], ["ord"])


TAG = r"^([A-Za-z][A-Za-z0-9]):[AifZHB]:(.*)$"


def paf(lines: DataFrame) -> DataFrame:
    """The twelve columns and the tags as a map."""
    names = "query string, qlen bigint, qstart bigint, qend bigint, strand string, target string, tlen bigint, tstart bigint, tend bigint, matches bigint, alnlen bigint, mapq int"
    p = F.split("value", "\t")
    tags = F.filter(F.slice(p, 13, 1000), lambda t: t.rlike(TAG))
    rows = lines.withColumn("tags", F.map_from_entries(F.transform(tags, lambda t: F.struct(F.regexp_extract(t, TAG, 1), F.regexp_extract(t, TAG, 2)))))
    return fields(rows, names)


def paf_to_m8(rows: DataFrame) -> DataFrame:
    """query, target, 1-based ends with the query's turned round on the minus strand, identity, bits from AS."""
    s, e = F.col("qstart") + 1, F.col("qend")
    minus = F.col("strand") == "-"
    identity = F.coalesce(1 - F.coalesce(F.col("tags")["de"], F.col("tags")["dv"]).cast("double"), F.col("matches") / F.col("alnlen"))
    return rows.select("query", "target", F.when(minus, e).otherwise(s).alias("qstart"), F.when(minus, s).otherwise(e).alias("qend"), "qlen", (F.col("tstart") + 1).alias("tstart"), "tend", "tlen", "alnlen", (identity * 100).alias("pident"), F.col("tags")["AS"].cast("bigint").alias("bits"))


M8 = "query string, target string, qstart bigint, qend bigint, qlen bigint, tstart bigint, tend bigint, tlen bigint, alnlen bigint, pident double, mismatch bigint, gapopen bigint, evalue double, bits double, qcov double"


def m8(lines: DataFrame) -> DataFrame:
    """Hits, with or without a header line."""
    return fields(lines.where(~F.col("value").startswith("query\ttarget")), M8)


BLAST6 = "qseqid string, sseqid string, pident double, length bigint, qlen bigint, slen bigint, qstart bigint, qend bigint, sstart bigint, send bigint, evalue double, bitscore double, qcovs double, qcovhsp double, mismatch bigint, gapopen bigint, btop string"


def blast6(lines: DataFrame, pident: float = 0, qcov: float = 0, length: int = 0, evalue: float = 10) -> DataFrame:
    """HSPs above the thresholds, which apply as lines are read; minus where the subject's ends are reversed."""
    rows = fields(lines, BLAST6).where((F.col("pident") >= pident) & (F.col("qcovs") >= qcov) & (F.col("length") >= length) & (F.col("evalue") <= evalue))
    return rows.withColumns({"strand": F.when(F.col("sstart") > F.col("send"), "-").otherwise("+"), "start0": F.least("sstart", "send") - 1, "end0": F.greatest("sstart", "send")})


def clusters(lines: DataFrame, mode: str = "raw", least: int = 1) -> DataFrame:
    """rep, member. raw: as they are. with_rep: the rep is a member, and a member's first rep wins. sized: distinct,
    of at least ``least`` members, with the rank by size."""
    from ..operators.relational import first_of

    rows = fields(lines, "rep string, member string", least=2)
    if mode == "raw":
        return rows
    if mode == "with_rep":
        own = rows.groupBy("rep").agg(F.min("ord").alias("ord")).select("ord", "rep", F.col("rep").alias("member"))
        return first_of(rows.select("ord", "rep", "member").unionByName(own), ["member"], ["ord"])
    rows = rows.select("rep", "member").distinct()
    n = rows.groupBy("rep").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return rows.join(n.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size"), "rep"))), "rep")


def anchors(lines: DataFrame) -> DataFrame:
    """file, cluster, ord, gene_a, gene_b: a cluster is what stands between ### lines."""
    w = W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("cluster", F.sum(F.col("value").startswith("###").cast("int")).over(w))
    p = F.split("value", "\t")
    return rows.where(~F.col("value").startswith("#") & (F.size(p) >= 2)).select("file", "cluster", "ord", F.get(p, 0).alias("gene_a"), F.get(p, 1).alias("gene_b"))


def block_coordinates(lines: DataFrame) -> DataFrame:
    """seq1, s1, e1, seq2, s2, e2, strand of ``seq:s..e`` pairs."""
    at = r"^(.+):(\d+)\.\.(\d+)$"
    p = F.split("value", "\t")
    x = lambda i, g: F.regexp_extract(F.get(p, i), at, g)
    rows = lines.where((F.size(p) >= 3) & F.get(p, 0).rlike(at) & F.get(p, 1).rlike(at))
    return rows.select("ord", x(0, 1).alias("seq1"), x(0, 2).cast("bigint").alias("s1"), x(0, 3).cast("bigint").alias("e1"), x(1, 1).alias("seq2"), x(1, 2).cast("bigint").alias("s2"), x(1, 3).cast("bigint").alias("e2"), F.get(p, 2).alias("strand"))


def kmer_dump(lines: DataFrame) -> DataFrame:
    return fields(lines, "kmer string, n bigint", sep=" ")


def chromosome_sets(lines: DataFrame) -> DataFrame:
    """set_id, seqid: ragged sets, one a line, of two or more names; comments go."""
    p = F.filter(F.split(F.regexp_replace("value", "#.*$", ""), r"[\s,]+"), lambda x: x != "")
    rows = lines.withColumn("p", p).where("size(p) >= 2").withColumn("set_id", F.row_number().over(W.orderBy("ord")))
    return rows.select("set_id", F.explode("p").alias("seqid"))


def copy_rules(lines: DataFrame) -> DataFrame:
    """species, low, high of ``N``, ``N+`` and ``N-``."""
    r = r"^(\S+)\s+(\d+)([+-]?)\s*$"
    n, sign = F.regexp_extract("value", r, 2).cast("int"), F.regexp_extract("value", r, 3)
    return lines.where(F.col("value").rlike(r)).select(F.regexp_extract("value", r, 1).alias("species"), F.when(sign == "-", 0).otherwise(n).alias("low"), F.when(sign != "+", n).alias("high"))


def internal_intervals(lines: DataFrame) -> DataFrame:
    """name, start1, end1 between the two repeats; names without exactly two rows go."""
    rows = fields(lines, "name string, s bigint, e bigint")
    g = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("s").alias("b")).where("n = 2")
    return g.select("name", (F.col("a") + 1).alias("start1"), (F.col("b") - 1).alias("end1"))


def truth(lines: DataFrame) -> DataFrame:
    """seqid, start0, end0, feature, extras, tsd, strand, kind."""
    rows = fields(lines, "seqid string, start0 bigint, end0 bigint, name string, tsd string, strand string", least=4)
    kind = F.when(F.col("name").contains("_SOLO"), "solo").when(F.col("name").contains("_FRAG"), "fragment").otherwise("intact")
    return rows.select("seqid", "start0", "end0", F.split_part("name", F.lit(";"), F.lit(1)).alias("feature"), F.regexp_replace("name", "^[^;]*;?", "").alias("extras"), "tsd", "strand", kind.alias("kind"))


def classes(lines: DataFrame) -> DataFrame:
    """te, order, superfamily, clade, complete, strand, domains; a header line goes."""
    return fields(lines.where(~F.lower("value").rlike("^#?te\t")), "te string, order string, superfamily string, clade string, complete string, strand string, domains string")


def domain_gff3(lines: DataFrame) -> DataFrame:
    """te, gene, clade, start0, end0 of rows whose ID is ``te|cladepath:gene``."""
    i = F.col("attributes")["ID"]
    return gff3(lines).where(i.rlike(r"^.+\|.*:[^:]+$")).select(F.regexp_extract(i, r"^(.+)\|", 1).alias("te"), F.regexp_extract(i, r":([^:]+)$", 1).alias("gene"), F.regexp_extract(i, r"\|(.*):[^:]+$", 1).alias("clade"), "start0", "end0", "strand")


def best_links(rows: DataFrame) -> DataFrame:
    """query, target, strand of the best score; the first line of equal scores. rows: ord, query, target, strand, score."""
    return rows.groupBy("query").agg(F.min_by(F.struct("target", "strand"), F.struct(-F.col("score"), F.col("ord"))).alias("v")).select("query", "v.*")


def element_tables(spark: SparkSession, paths: dict[int, tuple[str | None, str | None]]) -> DataFrame:
    """Lines of element tables by depth. paths: depth -> (clean, raw). Where any clean table is there, clean ones alone
    are read: a depth that lacks one isn't filled from the raw ones. The first of equal keys wins."""
    from ..operators.relational import first_of

    clean = any(c for c, _ in paths.values())
    out = None
    for depth, (c, r) in sorted(paths.items()):
        if path := c if clean else r:
            rows = read_lines(spark, path).where(~F.col("value").startswith("#")).select("value", F.lit(depth).alias("depth"), "ord", F.split_part("value", F.lit("\t"), F.lit(1)).alias("key"))
            out = rows if out is None else out.unionByName(rows)
    return first_of(out, ["key"], ["depth", "ord"])

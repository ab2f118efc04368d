"""Writers: a line per row with the keys that put it in its place; ``write_lines`` keeps that order in the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Text files that read in order, from the first to the last."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def wrapped(seq: Column, width: int = 60) -> Column:
    return seq if width <= 0 else F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def fasta_lines(df: DataFrame, seqid: str = "seqid", seq: str = "seq", width: int = 60) -> DataFrame:
    return df.withColumn("line", F.concat(F.lit(">"), seqid, F.lit("\n"), wrapped(F.col(seq), width)))


def escaped(value: Column) -> Column:
    """Percent escapes of the characters that mean something in GFF3 (fixed values)."""
    for raw, code in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A")):
        value = F.replace(value, F.lit(raw), F.lit(code))
    return value


def attributes(pairs: dict[str, Column]) -> Column:
    """key=value;… without those that are empty, null or a dot."""
    part = lambda k, v: F.when(v.isNotNull() & ~v.isin("", "."), F.concat(F.lit(f"{k}="), escaped(v)))
    return F.concat_ws(";", *[part(k, v.cast("string")) for k, v in pairs.items()])


def gff3_lines(features: DataFrame, ranks: DataFrame) -> DataFrame:
    """block, line_no, line, start, end: features of a block stand together, the parent first, ### behind.

    features: block, part (0 for the parent), seqid, type, start1, end1, strand, attrs. ranks: seqid, rank. Blocks
    sort by (rank, start, longer first, id).
    """
    parent = features.where("part = 0").select("block", "seqid", F.col("start1").alias("bs"), F.col("end1").alias("be")).join(ranks, "seqid")
    rows = features.join(parent.drop("seqid"), "block")
    text = F.concat_ws("\t", "seqid", F.lit("lociq"), "type", F.col("start1").cast("string"), F.col("end1").cast("string"), F.lit("."), "strand", F.lit("."), "attrs")
    inner = F.struct((F.col("part") > 0).cast("int").alias("a"), F.col("start1").alias("b"), (-F.col("end1")).alias("c"), F.col("part").alias("d"))
    body = rows.select("rank", "bs", (-F.col("be")).alias("nbe"), "block", F.row_number().over(W.partitionBy("block").orderBy(inner)).alias("line_no"), text.alias("line"))
    ends = parent.select("rank", "bs", (-F.col("be")).alias("nbe"), "block", F.lit(1 << 20).alias("line_no"), F.lit("###").alias("line"))
    return body.unionByName(ends)


GFF3_ORDER = ["rank", "bs", "nbe", "block", "line_no"]


def element_features(elements: DataFrame) -> DataFrame:
    """A feature row for each element, its two repeats and its domains, these numbered by gene.

    elements: block, seqid, start1, end1, l_end, r_start, strand, domains (array<struct<gene, clade, start, end>>).
    """
    part = lambda n, t, s, e, a: F.struct(F.lit(n).alias("part"), F.lit(t).alias("type"), s.cast("bigint").alias("start1"), e.cast("bigint").alias("end1"), a.alias("attrs"))
    c = F.col
    fixed = F.array(
        part(0, "repeat_region", c("start1"), c("end1"), attributes({"ID": c("block")})),
        part(1, "long_terminal_repeat", c("start1"), c("l_end"), attributes({"ID": F.concat(c("block"), F.lit("_5")), "Parent": c("block")})),
        part(2, "long_terminal_repeat", c("r_start"), c("end1"), attributes({"ID": F.concat(c("block"), F.lit("_3")), "Parent": c("block")})),
    )
    own = elements.select("block", "seqid", "strand", F.inline(fixed))
    d = elements.select("block", "seqid", "strand", F.posexplode("domains").alias("i", "d"))
    number = F.row_number().over(W.partitionBy("block", "d.gene").orderBy("d.start", "i"))
    rows = d.withColumn("k", number).select("block", "seqid", "strand", (F.col("i") + 3).alias("part"), F.lit("protein_match").alias("type"), F.col("d.start").alias("start1"), F.col("d.end").alias("end1"), attributes({"ID": F.concat("block", F.lit("_"), "d.gene", "k"), "Parent": c("block"), "Name": c("d.gene"), "clade": c("d.clade")}).alias("attrs"))
    return own.unionByName(rows)


def tsv_lines(df: DataFrame, columns: list[str], missing: str = ".") -> DataFrame:
    return df.withColumn("line", F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns]))


def inserted_columns(columns: list[str], new: list[str], after: str) -> list[str]:
    """The columns with ``new`` behind ``after``; old ones of the same name go, so a second run changes nothing."""
    kept = [c for c in columns if c not in new]
    at = kept.index(after) + 1
    return kept[:at] + new + kept[at:]


def solo_names(loci: DataFrame, prefix: str = "solo") -> DataFrame:
    """With name: numbered in (seqid, start, end) order. The number is a rank of sorted ranges: it is counted in groups
    of the sort first, so no task sees all loci."""
    rows = loci.withColumn("__g", F.floor(F.col("start0") / (1 << 20)))
    n = rows.groupBy("seqid", "__g").agg(F.count("*").alias("__n"))
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("seqid", "__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(W.partitionBy("seqid", "__g").orderBy("start0", "end0"))
    rows = rows.withColumn("__r", rank).join(n, ["seqid", "__g"])
    return rows.withColumn("name", F.format_string(f"{prefix}_%04d", F.col("__before") + F.col("__r"))).drop("__g", "__r", "__before")


def bed6_lines(df: DataFrame, name: Column, bits: Column) -> DataFrame:
    """Scores are rounded, halves to the even neighbour, and held in 0 to 1000."""
    score = F.least(F.greatest(F.bround(bits), F.lit(0)), F.lit(1000)).cast("int")
    return df.withColumn("line", F.concat_ws("\t", "seqid", "start0", "end0", name, score, "strand"))


def scn_lines(df: DataFrame) -> DataFrame:
    names = ["s_ret", "e_ret", "l_ret", "s_lltr", "e_lltr", "l_lltr", "s_rltr", "e_rltr", "l_rltr"]
    return df.withColumn("line", F.concat_ws(" ", *names, F.format_number("sim", "0.00"), "seq_nr", "seqid"))


def partition_lines(df: DataFrame) -> DataFrame:
    """DNA, gene = s-e lines of a supermatrix, 1-based. df: gene, length."""
    end = F.sum("length").over(W.orderBy("gene").rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("end", end).withColumn("line", F.concat(F.lit("DNA, "), "gene", F.lit(" = "), F.col("end") - F.col("length") + 1, F.lit("-"), "end"))

"""Golden cases and brute-force comparisons of the operators that SQL doesn't check, and of files."""

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociq.functions import parsing, sequence, stats
from lociq.operators import elements, graph, interval, masking, relational, synteny
from lociq.sources import formats, sinks

B = synteny.BLOCK


def blocks(spark, rows):
    return spark.createDataFrame([("A", a, b, "B", c, d, s, i) for i, (a, b, c, d, s) in enumerate(rows)], B)


def got(df):
    return sorted((r.s1, r.e1, r.s2, r.e2, r.strand) for r in df.collect())


def test_identical_blocks_remove_each_other(spark):
    same = (0, 10, 0, 10, "+")
    assert got(synteny.drop_contained(blocks(spark, [same, same, (20, 30, 20, 30, "+")]))) == [(20, 30, 20, 30, "+")]
    assert got(synteny.drop_contained(blocks(spark, [same, same, same]))) == []
    assert got(synteny.drop_contained(blocks(spark, [(0, 100, 0, 100, "+"), (5, 9, 5, 9, "+"), (5, 9, 5, 9, "-")]))) == [(0, 100, 0, 100, "+"), (5, 9, 5, 9, "-")]


def test_trim_chain(spark):
    rows = [(0, 10, 0, 10, "+"), (5, 20, 5, 20, "+"), (15, 30, 15, 30, "+")]
    assert got(synteny.trim_staggered(blocks(spark, rows))) == [(0, 10, 0, 10, "+"), (10, 20, 10, 20, "+"), (20, 30, 20, 30, "+")]
    assert got(synteny.trim_staggered(blocks(spark, rows[::-1]))) == [(0, 10, 0, 10, "+"), (10, 20, 10, 20, "+"), (20, 30, 20, 30, "+")]


def test_absorb_short_blocks(spark):
    rows = [(0, 5, 0, 5, "+"), (5, 105, 5, 105, "+"), (105, 205, 105, 205, "+")]
    # the short block joins the first long one, which stays apart from the other: both count as long
    assert got(synteny.absorb_short(blocks(spark, rows), 50)) == [(0, 105, 0, 105, "+"), (105, 205, 105, 205, "+")]


def test_stitch_guards(spark):
    rows = [(0, 10, 0, 10, "+"), (20, 30, 20, 30, "+")]
    assert (10, 20, 10, 20, "+") in got(synteny.stitch(blocks(spark, rows)))
    assert len(got(synteny.stitch(blocks(spark, [*rows, (12, 15, 12, 15, "-")])))) == 3
    assert len(got(synteny.stitch(blocks(spark, [*rows, (40, 50, 12, 15, "+")])))) == 3


def test_merge_and_joins_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, f"c{rng.randrange(2)}", s, s + rng.choice([0, 1, 5, 700, 40_000, 3_000_000])) for i in range(250) for s in [rng.randrange(5_000_000)]]
    df = spark.createDataFrame(rows, "id long, seqid string, start0 long, end0 long")
    for gap in (0, 3, 5000):
        want = []
        for c in ("c0", "c1"):
            out = []
            for s, e in sorted((r[2], r[3]) for r in rows if r[1] == c):
                if out and s <= out[-1][1] + gap:
                    out[-1][1] = max(out[-1][1], e)
                else:
                    out.append([s, e])
            want += [(c, s, e) for s, e in out]
        assert sorted(tuple(r) for r in interval.merge(df, ["seqid"], gap=gap, bin_width=10_000).collect()) == sorted(want)
    pairs = sorted((r.id, r.b_id) for r in interval.overlap_join(df, df, ["seqid"], on=interval.overlaps()).collect())
    assert pairs == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    anti = sorted(r.id for r in interval.overlap_join(df, df, ["seqid"], "left_anti", interval.overlaps() & (F.col("id") != F.col("b_id"))).collect())
    assert anti == sorted(a[0] for a in rows if not any(a[1] == b[1] and a[0] != b[0] and a[2] < b[3] and b[2] < a[3] for b in rows))
    merged = interval.merge(df, ["seqid"])
    assert sorted(interval.merge(merged, ["seqid"]).collect()) == sorted(merged.collect())
    n = spark.createDataFrame([("c0", 9_000_000), ("c1", 9_000_000)], "seqid string, length long")
    total = interval.covered(df, ["seqid"]).agg(F.sum("covered")).first()[0] + interval.covered(interval.complement(df, ["seqid"], n), ["seqid"]).agg(F.sum("covered")).first()[0]
    assert total == 18_000_000


def element(key, s, e, aln=100, p=0.1, tsd=None, ltr=10, seqid="c"):
    return (key, seqid, s, e, s + ltr, e - ltr, aln, p, tsd)


ELEMENT = "key string, seqid string, start1 long, end1 long, l_end long, r_start long, aln long, p double, tsd string"


def survivors(spark, rows):
    return {r.key: r.nest_status for r in elements.deduplicated(spark.createDataFrame(rows, ELEMENT)).collect()}


def test_dedup_layers(spark):
    assert survivors(spark, [element("a", 1, 100)]) == {"a": "."}
    assert set(survivors(spark, [element("a", 1, 100), element("b", 2, 101, tsd="ACGT")])) == {"b"}
    assert survivors(spark, [element("out", 1, 500), element("in", 100, 300, tsd="ACGT")]) == {"out": "nest-outer:in", "in": "nest-inner:out"}
    # more matching bases win, unless the distance is out of proportion
    assert set(survivors(spark, [element("a", 1, 100, 100, 0.02), element("b", 2, 101, 90, 0.02)])) == {"a"}
    assert set(survivors(spark, [element("a", 1, 100, 100, 0.10), element("b", 2, 101, 90, 0.02)])) == {"b"}
    assert set(survivors(spark, [element("a", 1, 100), element("b", 500, 600), element("c", 1, 100, seqid="d")])) == {"a", "b", "c"}


def test_reconciled_depth(spark):
    rows = [element("a", 1, 1000), element("b", 100, 900), element("c", 200, 300), element("c2", 200, 302, 50)]
    kept, children = elements.reconciled(spark.createDataFrame(rows, ELEMENT))
    assert {r.key: r.depth for r in kept.collect()} == {"a": 2, "b": 1, "c": 0}
    assert sorted(tuple(r) for r in children.collect()) == [("a", "b"), ("b", "c")]


def test_two_colour(spark):
    rows = [(1, 2, False, 1.0), (2, 3, False, 1.0), (1, 3, False, 1.0), (7, 8, True, 1.0), (8, 9, False, 1.0)]
    r = {x.node: x for x in graph.two_colour(spark.createDataFrame(rows, "a long, b long, same boolean, weight double")).collect()}
    assert r[1].conflicts == 2 and r[7].colour == r[8].colour != r[9].colour and r[9].conflicts == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = graph.components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in root], "node long"))
    assert {r.node: r.root for r in out.collect()} == {n: find(n) for n in root}


def test_overlap_policies(spark):
    rows = [(1, 1, 10, 0.5), (2, 1, 10, 0.1), (3, 1, 5, 0.9), (4, 4, 1, 0.1)]
    df = spark.createDataFrame(rows, "id long, root long, length long, divergence double")
    none = spark.createDataFrame([], "id long")
    keep = lambda policy, p=none: sorted(r.id for r in graph.overlap_groups(df, p, policy).collect())
    assert keep("longest") == [1, 2, 4] and keep("lowest") == [2, 4] and keep("drop") == [4] and keep("retain") == [1, 2, 3, 4]
    assert keep("drop", spark.createDataFrame([(3,)], "id long")) == [3, 4]


def test_majority_and_percentages(spark):
    rows = [(1, "LTR", "Copia", "a"), (1, "LTR", "Gypsy", "b"), (2, "LTR", "Copia", "a"), (2, "LINE", "x", "y"), (3, "LTR", "Copia", "q")]
    out = relational.majority_class(spark.createDataFrame(rows, "k int, o string, s string, c string"), ["k"], "o", "s", "c")
    assert {r.k: (r.o, r.s, r.c) for r in out.collect()} == {1: ("LTR", "mixture", "mixture"), 2: ("mixture", "mixture", "mixture"), 3: ("LTR", "Copia", "q")}
    v = spark.createDataFrame([(1, "a")] * 399 + [(1, "b")], "k int, v string")
    assert [(r.v, r.percent) for r in relational.percent_half_up(v, ["k"], "v").collect()] == [("a", 100)]


def test_fisher_against_enumeration():
    for a, b, c, d in ((3, 1, 1, 3), (0, 5, 5, 0), (10, 2, 3, 15), (0, 0, 0, 0), (7, 0, 0, 7)):
        n, r1, c1 = a + b + c + d, a + b, a + c
        want = sum(math.comb(c1, x) * math.comb(n - c1, r1 - x) for x in range(a, min(r1, c1) + 1)) / math.comb(n, r1) if n else 1.0
        assert stats.fisher_greater(a, b, c, d) == pytest.approx(want)
    assert stats.t_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-6) and stats.t_tail(-2.0, 10) == pytest.approx(0.963306, abs=1e-6)
    assert stats.f_critical(0.05, 1, 10) == pytest.approx(4.9646, abs=1e-3)


def test_clusters_of_rows():
    rng = np.random.default_rng(1)
    m = np.vstack((rng.normal(0, 0.1, (5, 40)), rng.normal(3, 0.1, (6, 40))))
    label, kept = stats.bootstrap_stability(m, 2, 20)
    assert len(set(label[:5])) == 1 and len(set(label[5:])) == 1 and label[0] != label[-1] and kept.min() == 1


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ATGGCCTAAnn", "5AG2A-TC1", "ACGTTGCA")], "cds string, btop string, x string")
    r = sequence.translate_codons(df).select("pep", sequence.btop_k2p(F.col("btop")).alias("k"), sequence.btop_k2p(F.lit("9")).alias("z"), sequence.btop_k2p(F.lit("AGAGAGAG")).alias("na"), sequence.shared_substring(F.lit("GGACGTAC"), F.lit("TTACGTAA"), 4).alias("t"), sequence.shared_substring(F.lit("AAAAAAA"), F.lit("AAAAAAA")).alias("none")).first()
    assert r.pep == "MA*" and r.z == "0.0000" and r.na == "NA" and r.k not in ("NA", "0.0000") and r.t == "ACGTA" and r.none is None
    f = sequence.repaired_frames(spark.createDataFrame([("ATGaGCCTAA", "MA"), ("CCATGGCC", "MA"), ("TTTTTTTTTTT", "MA")], "cds string, pep string")).collect()
    assert [x.codons for x in f] == ["ATGGCC", "ATGGCC", None]
    j = spark.range(1).select(sequence.aligned_jc(F.lit("ACGT-A"), F.lit("ACGA-N")).alias("d"), sequence.aligned_jc(F.lit("AAAA"), F.lit("CCCC")).alias("cap")).first()
    assert j.d == pytest.approx(-0.75 * math.log(1 - 1 / 3)) and j.cap == 3.0


def test_run_signature_against_a_scan():
    import re

    rng = random.Random(4)
    pattern = re.compile(sequence.run_signature("N", "RD", 2, 1))

    def scan(s):
        for i in range(len(s)):
            for k in range(2, len(s) - i + 1):
                if set(s[i : i + k]) == {"N"} and s[:i].rstrip("R") != s[:i] and s[i + k :].lstrip("R") != s[i + k :]:
                    if s[:i].rstrip("R").endswith("D") and s[i + k :].lstrip("R").startswith("D"):
                        return True
        return False

    for _ in range(3000):
        s = "".join(rng.choice("NRDA") for _ in range(rng.randrange(12)))
        assert bool(pattern.search(s)) == scan(s), s


def test_masks(spark):
    seqs = spark.createDataFrame([("c", "ACGTACGTAC"), ("d", "ACGT")], "seqid string, seq string")
    spans = spark.createDataFrame([("c", -3, 2, 0), ("c", 4, 6, 1), ("c", 5, 99, 12)], "seqid string, start0 long, end0 long, depth long")
    out = lambda df: {r.seqid: r.seq for r in df.collect()}
    assert out(masking.hard_mask(seqs, spans)) == {"c": "NNGTNNNNNN", "d": "ACGT"}
    assert out(masking.depth_paint(seqs, spans)) == {"c": "NNGTRXXXXX", "d": "ACGT"}
    assert out(masking.excised(seqs, spans)) == {"c": "GT", "d": "ACGT"}
    assert out(masking.tri_state_mask(seqs, spans.where("depth = 1"), keep=1)) == {"c": "VVVTNNGVVV", "d": "VVVV"}


def test_fasta_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC\n>s2\n\nGG\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">s3 x\nTTTT\n")
    files = [str(tmp_path / "a.fa"), str(tmp_path / "b.fa.gz")]
    want = [("s1", "first one", "ACGTAC"), ("s2", "", "GG"), ("s3", "x", "TTTT")]
    assert sorted((r.seqid, r.description, r.seq) for r in formats.read_fasta(spark, files).collect()) == want
    assert sorted((r.seqid, r.description, r.seq) for r in formats.fasta(formats.read_lines(spark, files)).collect()) == want
    assert sorted(r.seqid for r in formats.headers_only(spark, files[0]).collect()) == ["s1", "s2"]
    sinks.write_lines(sinks.fasta_lines(formats.read_fasta(spark, files), width=4).withColumn("k", F.col("seqid")), f"{tmp_path}/out", ["k"])
    assert sorted((r.seqid, r.seq) for r in formats.read_fasta(spark, f"{tmp_path}/out").collect()) == [("s1", "ACGTAC"), ("s2", "GG"), ("s3", "TTTT")]


def test_element_tables_are_not_mixed(spark, tmp_path):
    for n, text in (("c0", "#h\nx\t1\n"), ("r0", "x\t9\ny\t9\n"), ("r1", "z\t9\n")):
        (tmp_path / n).write_text(text)
    p = lambda n: str(tmp_path / n)
    read = lambda paths: sorted(r.value for r in formats.element_tables(spark, paths).collect())
    assert read({0: (p("c0"), p("r0"))}) == ["x\t1"]
    assert read({0: (None, p("r0")), 1: (None, p("r1"))}) == ["x\t9", "y\t9", "z\t9"]


def test_parsers(spark):
    r = spark.range(1).select(
        parsing.locus(F.lit("a:b:9..4#LTR/x")).alias("l"), parsing.locus(F.lit("none")).alias("n"), parsing.letters(F.lit(703)).alias("aaa"), parsing.letters(F.lit(702)).alias("zz"),
        parsing.domains(F.lit("RT|A@5-9;bad")).alias("strict"), parsing.domains(F.lit("RT|A@9-5;bad"), "lenient").alias("lenient"), sinks.attributes({"a": F.lit("x;y"), "b": F.lit("."), "c": F.lit(None)}).alias("attrs"),
    ).first()
    assert tuple(r.l) == ("a:b", 4, 9, "LTR/x") and r.n is None and (r.zz, r.aaa) == ("ZZ", "AAA") and r.strict == [] and len(r.lenient) == 1 and r.attrs == "a=x%3By"


def test_registry():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_strand_chains(spark):
    df = spark.createDataFrame([("a", "+"), ("b", None), ("c", None), ("d", None), ("e", None)], "id string, strand string")
    links = spark.createDataFrame([("b", "a", "-"), ("c", "b", "-"), ("d", "c", "+"), ("e", "e", "+")], "query string, target string, orientation string")
    assert {r.id: r.strand for r in relational.propagate_strand(df, links).collect()} == {"a": "+", "b": "-", "c": "+", "d": "+", "e": None}


def test_triage_takes_one_rescuer(spark):
    rows = [("A", 0, 100, "B", 0, 100, "+", 0), ("A", 200, 300, "B", 200, 210, "+", 1), ("A", 200, 300, "B", 200, 209, "+", 2)]
    df = spark.createDataFrame(rows, B).withColumns({"ga": F.lit("x"), "gb": F.lit("y")})
    assert {r.ord: r.state for r in synteny.triage(df, 2.0, 0.5).collect()} == {0: "clean", 1: "rescued", 2: "dropped"}




def each(spark, expression, values):
    """The expression's value for each of the values, in turn."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names_as_the_tools_read_them(spark):
    assert each(spark, lambda v: parsing.letters(v.cast("long")), ["1", "26", "27", "18954", "9223372036854775807", "0"]) == ["A", "Z", "AA", "AAZZ", "CRPXNLSKVLJFHG", None]
    assert [tuple(x) for x in each(spark, parsing.gene_token, ["Bdact016340", "Etef739571_2", "nothing"])] == [("Bdact", "016340", None), ("Etef", "739571", "2"), (None, None, None)]
    assert each(spark, parsing.species, ["Bdact_chr2", "Etef_sca12", "Bdact12", "7"]) == ["Bdact", "Etef", "Bdact", None]
    headers = {">Chr01a": ("1", "A"), ">chrX": ("X", None), ">Chr-02b": ("2", "B"), ">Chrom 3": ("3", None), ">Chr1AA": ("1", "AA"), ">CHROMOSOME_: 010": ("10", None), ">Chr00": ("0", None), ">scaffold_1": (None, None)}
    assert [tuple(x) for x in each(spark, parsing.chromosome, list(headers))] == list(headers.values())
    names = {"CHDCR": "CHDCR", "AP": "AP", "Reverse-transcriptase": "REVERSETRANSCRIPTASE", "aRNase H": "ARH", "arh": "ARH", "RNase_H": "RH", " integrase ": "INT", "PROTEASE": "PROT", "gag": "GAG"}
    assert each(spark, parsing.protein, list(names)) == list(names.values())
    paths = {"Class_II/Subclass_1/TIR/hAT": ("TIR", "hAT"), "Class_I/SINE": ("SINE", "unknown"), "NA_x": ("LTR", "Retrovirus"), "Class_I/LTR/Retrovirus": ("LTR", "Retrovirus"), "Class_I/LTR/Ty1_copia/Ale": ("LTR", "Copia"), "Class_I/LTR/Ty3_gypsy": ("LTR", "Gypsy"), "Class_II/x": ("unknown", "unknown"), "TIR": ("unknown", "unknown")}
    assert [tuple(x) for x in each(spark, parsing.clade_path, list(paths))] == list(paths.values())
    assert each(spark, parsing.sanitised, ["_a b_", "a//b", "", "__", "x.y-z"]) == ["a_b", "a_b", "NA", "NA", "x.y-z"]
    assert each(spark, sequence.motif, ["tgaaca", "t", "", "tg"]) == ["TG…CA", "NA", "NA", "TG…TG"]
    assert each(spark, lambda v: sequence.aligned_jc(v, F.lit("--NN")), ["ACGT"]) == [0.0]
    lenient = each(spark, lambda v: parsing.domains(v, "lenient"), ["aRNase H|Ale@9-5;bad; RT|@1-2", "."])
    assert [[tuple(d) for d in x] for x in lenient] == [[("ARH", "Ale", 5, 9), ("RT", "", 1, 2)], []]
    assert [len(x) for x in each(spark, parsing.domains, ["RT|A@1-2; INT|B@3-4", "RT|A@1-2;;INT|B@3-4", ".", ""])] == [2, 0, 0, 0]

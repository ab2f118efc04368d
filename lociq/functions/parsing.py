"""Scalar parsers of names, tokens and cells; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCUS = r"^(.+):(\d+)(?:-|\.\.)(\d+)(?:#(.*))?$"


def locus(name: Column) -> Column:
    """struct<seqid, start, end, cls> of ``chrom:s-e[#cls]`` or ``chrom:s..e``; ends in order; null where it is neither."""
    part = lambda i: F.regexp_extract(name, LOCUS, i)
    s, e = part(2).cast("bigint"), part(3).cast("bigint")
    return F.when(name.rlike(LOCUS), F.struct(part(1).alias("seqid"), F.least(s, e).alias("start"), F.greatest(s, e).alias("end"), F.nullif(part(4), F.lit("")).alias("cls")))


def classification(cls: Column) -> Column:
    """struct<order, superfamily, clade> of ``Order/Superfamily/Clade``; what is missing is unknown."""
    parts = F.split(F.coalesce(cls, F.lit("")), "/")
    at = lambda i: F.coalesce(F.nullif(F.get(parts, i), F.lit("")), F.lit("unknown"))
    return F.struct(at(0).alias("order"), at(1).alias("superfamily"), at(2).alias("clade"))


def accession(name: Column, last: bool = False) -> Column:
    """What stands before the first (or last) underscore."""
    return F.regexp_replace(name, "_[^_]*$", "") if last else F.split_part(name, F.lit("_"), F.lit(1))


def gene_token(token: Column) -> Column:
    """struct<species, number, copy> of letters, digits and an optional _copy; all are text, so zeros in front stay."""
    pattern = r"^([A-Za-z]+)(\d+)(?:_(\d+))?$"
    part = lambda i: F.regexp_extract(token, pattern, i)
    return F.struct(F.nullif(part(1), F.lit("")).alias("species"), F.nullif(part(2), F.lit("")).alias("number"), F.nullif(part(3), F.lit("")).alias("copy"))


def species(name: Column) -> Column:
    """The letters before _chr or _sca, else the leading letters; null where there are none."""
    return F.nullif(F.regexp_extract(name, r"^([A-Za-z]+)", 1), F.lit(""))


#: How a header may spell the word, and the chromosomes that have a letter for a number (fixed values).
CHROMOSOME = r"(?:[Cc]hr(?:o(?:m(?:osome)?)?)?|CHR(?:O(?:M(?:OSOME)?)?)?)[ _-]*:? ?(\d+|[XYZW])([A-Za-z]+)?"


def chromosome(header: Column) -> Column:
    """struct<number, letter> of a header such as ``Chr01a``: text without zeros in front, or X, Y, Z, W; letters behind
    it in upper case. Nulls where the header names no chromosome."""
    number = F.regexp_replace(F.regexp_extract(header, CHROMOSOME, 1), r"^0+(?=\d)", "")
    letter = F.upper(F.regexp_extract(header, CHROMOSOME, 2))
    return F.struct(F.nullif(number, F.lit("")).alias("number"), F.nullif(letter, F.lit("")).alias("letter"))


def signature(header: Column) -> Column:
    """Digit runs as #."""
    return F.regexp_replace(header, r"\d+", "#")


def natural_key(name: Column, width: int = 20) -> Column:
    """A string that sorts as the name does when digit runs count as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def code_point(number: Column) -> Column:
    """The character of a code point, also beyond 255, where ``char`` would begin anew."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("bigint")), 8, "0")), "UTF-32")


def letters(index: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, …, for any long; null below 1."""

    def longer(state: Column, _: Column) -> Column:
        rest = state["rest"] - 1
        more = F.struct(F.call_function("div", rest, F.lit(26)).alias("rest"), F.concat(F.char(rest % 26 + 65), state["text"]).alias("text"))
        return F.when(state["rest"] > 0, more).otherwise(state)

    start = F.struct(index.cast("bigint").alias("rest"), F.lit("").alias("text"))
    # 26 ** 14 exceeds a long
    return F.nullif(F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, longer)["text"], F.lit(""))


DOMAIN = r"^([^|@]+)\|([^@]*)@(\d+)-(\d+)$"


def domains(cell: Column, mode: str = "strict") -> Column:
    """array<struct<gene, clade, start, end>> of ``GENE|Clade@s-e;…`` or ``.``.

    strict: a bad token empties the list. lenient: bad tokens are skipped, reversed ends swapped, genes normalised.
    """
    cell = F.nullif(F.coalesce(cell, F.lit(".")), F.lit("."))
    tokens = F.when(cell != "", F.transform(F.split(cell, ";"), lambda t: F.trim(t))).otherwise(F.array().cast("array<string>"))
    good = F.filter(tokens, lambda t: t.rlike(DOMAIN))

    def parse(t: Column) -> Column:
        gene, s, e = F.regexp_extract(t, DOMAIN, 1), F.regexp_extract(t, DOMAIN, 3).cast("bigint"), F.regexp_extract(t, DOMAIN, 4).cast("bigint")
        if mode == "lenient":
            gene, s, e = protein(gene), F.least(s, e), F.greatest(s, e)
        return F.struct(gene.alias("gene"), F.regexp_extract(t, DOMAIN, 2).alias("clade"), s.alias("start"), e.alias("end"))

    parsed = F.transform(good, parse)
    if mode == "lenient":
        return parsed
    return F.when(F.size(good) == F.size(tokens), parsed).otherwise(F.slice(parsed, 1, 0))


def nests(cell: Column, role: str | None = None) -> Column:
    """array<struct<role, key>> of ``nest-outer:chrom:s-e;nest-inner:…`` or ``.``; one role only where asked."""
    pattern = r"^(nest-outer|nest-inner):(.+:\d+-\d+)$"
    tokens = F.filter(F.split(F.coalesce(cell, F.lit(".")), ";"), lambda t: t.rlike(pattern))
    parsed = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, pattern, 1).alias("role"), F.regexp_extract(t, pattern, 2).alias("key")))
    return parsed if role is None else F.filter(parsed, lambda p: p["role"] == f"nest-{role}")


#: Protein names and what they are short for (fixed values); all others stay.
PROTEINS = {"INTEGRASE": "INT", "PROTEASE": "PROT", "RNASEH": "RH", "ARNASEH": "ARH"}


def protein(name: Column) -> Column:
    """Upper-case letters and digits only, long names shortened."""
    key = F.regexp_replace(F.upper(name), "[^A-Z0-9]+", "")
    short = F.create_map(*[F.lit(x) for pair in PROTEINS.items() for x in pair])
    return F.coalesce(short[key], key)


def clade_path(path: Column) -> Column:
    """struct<order, superfamily> of a path such as Class_I/LTR/Ty1_copia/Ale; unknown where it tells nothing.

    Class_I: order and superfamily are the second and third parts, but Ty1_copia… is Copia and Ty3_gypsy… Gypsy.
    Class_II: the third and fourth. A path that begins with NA is a retrovirus of the order LTR.
    """
    parts = F.split(path, "/")
    at = lambda i: F.coalesce(F.get(parts, i), F.lit("unknown"))
    pair = lambda order, superfamily: F.struct(order.alias("order"), superfamily.alias("superfamily"))
    retro = F.when(path.startswith("Class_I/LTR/Ty1_copia"), "Copia").when(path.startswith("Class_I/LTR/Ty3_gypsy"), "Gypsy").otherwise(at(2))
    return (
        F.when(path.startswith("Class_I/"), pair(at(1), retro))
        .when(path.startswith("Class_II/"), pair(at(2), at(3)))
        .when(path.startswith("NA"), pair(F.lit("LTR"), F.lit("Retrovirus")))
        .otherwise(pair(F.lit("unknown"), F.lit("unknown")))
    )


def sanitised(name: Column) -> Column:
    """Runs of other characters than letters, digits, dot, underscore and hyphen become an underscore, none of which
    stays at either end; NA where nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit("NA"))


def attribute(attrs: Column, key: str) -> Column:
    """A value of a GFF3 attribute column."""
    return F.element_at(F.str_to_map(attrs, F.lit(";"), F.lit("=")), key)


def lengths_of_pair(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    zero = F.lit(0)
    return F.struct(F.greatest(e1 - s1, zero).alias("left"), F.greatest(e2 - s2, zero).alias("right"))


def amino_to_genome(start: Column, end: Column, frame: Column, length: Column, strand: Column) -> Column:
    """struct<start, end>: 1-based nucleotides of a 1-based amino-acid envelope in frame 0 to 2 of either strand."""
    s, e = (start - 1) * 3 + frame + 1, end * 3 + frame
    return F.struct(F.when(strand == "-", length - e + 1).otherwise(s).alias("start"), F.when(strand == "-", length - s + 1).otherwise(e).alias("end"))


def flipped(start: Column, end: Column, length: Column, strand: Column) -> Column:
    """struct<start, end> relative to an element, mirrored on the minus strand."""
    return F.struct(F.when(strand == "-", length - end + 1).otherwise(start).alias("start"), F.when(strand == "-", length - start + 1).otherwise(end).alias("end"))


def collapsed(position: Column, cuts: Column) -> Column:
    """A position after the half-open spans in ``cuts`` (array<struct<start, end>>, merged) are excised."""
    return F.aggregate(cuts, position, lambda p, c: p - F.greatest(F.least(position, c["end"]) - c["start"], F.lit(0)))

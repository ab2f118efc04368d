"""Sequence functions. Those with built-in forms are expressions; the rest are Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The genetic code in TCAG order (fixed values).
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def reverse_complement(seq: Column, alphabet: str = "plain") -> Column:
    """plain: ACGT in either case, others kept. strict: others become N."""
    out = F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))
    return F.regexp_replace(out, "[^ACGTNacgtn]", "N") if alphabet == "strict" else out


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


#: Letters that a batch of k-mers is counted from: some dozen arrays of them are held at once.
PIECE = 1 << 19


def counted_kmers(df: DataFrame, key: str, seq: str, k: int, canonical: bool = False) -> DataFrame:
    """key, kmer, n, counted in pieces: a key and k-mer can have several rows. As ``kmer_counts``, which adds them up."""
    return _counted(df, key, seq, k, canonical)


def kmer_counts(df: DataFrame, key: str, seq: str, k: int, canonical: bool = False) -> DataFrame:
    """key, kmer, n: how often each string of k letters A, C, G, T occurs in a key's sequences; k from 1 to 31.

    Strings with another letter, or over two sequences, don't count. canonical: a string counts with its reverse
    complement, under the lesser of both. Letters are numbers of two bits, counted in each batch before the shuffle.
    """
    return _counted(df, key, seq, k, canonical).groupBy(key, "kmer").agg(F.sum("n").alias("n"))


def _counted(df: DataFrame, key: str, seq: str, k: int, canonical: bool) -> DataFrame:
    if not 1 <= k <= 31:
        raise ValueError("k must be from 1 to 31")
    base = np.full(256, 4, np.uint8)
    base[np.frombuffer(b"ACGT", np.uint8)] = range(4)

    def count(owner: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(letters) - k + 1
        code, turned = np.zeros(max(n, 0), np.int64), np.zeros(max(n, 0), np.int64)
        wrong = np.concatenate(([0], np.cumsum(letters > 3)))
        for j in range(k if n > 0 else 0):
            part = letters[j : j + n].astype(np.int64)
            code = code << 2 | part & 3
            if canonical:
                turned |= (3 - part & 3) << 2 * j
        good = wrong[k:] == wrong[: max(n, 0)] if n > 0 else np.zeros(0, bool)
        code, owner = (np.minimum(code, turned) if canonical else code)[good], owner[: max(n, 0)][good]
        order = np.lexsort((code, owner))
        code, owner = code[order], owner[order]
        new = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))) if len(code) else np.zeros(0, np.int64)
        return owner[new], code[new], np.diff(np.append(new, len(code)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, held, size = batch.column(0), [], 0
            texts = batch.column(1)
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows:
                    raw = (texts[i].as_py() or "").encode("ascii", "replace")
                    held.append((i, raw))
                    size += len(raw) + 1
                if held and (size >= PIECE or i == batch.num_rows):
                    letters = base[np.frombuffer(b"\n".join(r for _, r in held) + b"\n", np.uint8)]
                    # equal keys of a piece are counted together
                    group = pd.factorize(pd.Series([keys[j].as_py() for j, _ in held]), use_na_sentinel=False)[0]
                    first = {g: j for g, (j, _) in reversed(list(zip(group.tolist(), held, strict=True)))}
                    owner, code, n = count(np.repeat(group, [len(r) + 1 for _, r in held]), letters)
                    shifts = np.arange(2 * (k - 1), -1, -2)
                    text = np.frombuffer(b"ACGT", np.uint8)[code[:, None] >> shifts & 3]
                    spelled = pa.array(text.reshape(-1, k).copy().view(f"S{k}").ravel().astype(str) if len(code) else [], pa.string())
                    at = pa.array(np.array([first[g] for g in owner.tolist()], np.int64))
                    yield pa.RecordBatch.from_arrays([keys.take(at), spelled, pa.array(n, pa.int64())], names=[key, "kmer", "n"])
                    held, size = [], 0

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, seq).mapInArrow(run, f"{key} {kind}, kmer string, n bigint")


def acgt_bp(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^ACGTacgt]", ""))


def masked_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, 1 - acgt_bp(seq) / F.length(seq))


def strip_non_acgt(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGTacgt]", "")


def motif(seq: Column, first: Column | None = None, last: Column | None = None) -> Column:
    """The terminal dinucleotides, in upper case, of the element from ``first`` to ``last`` (1-based; the whole sequence
    where not given); NA where the sequence doesn't hold them."""
    first, last = F.lit(1) if first is None else first, F.length(seq) if last is None else last
    held = (first > 0) & (last > 1) & (first + 1 <= F.length(seq))
    left, right = F.substring(seq, first.cast("int"), F.lit(2)), F.substring(seq, last.cast("int") - 1, F.lit(2))
    return F.when(held, F.concat(F.upper(left), F.lit("…"), F.upper(right))).otherwise("NA")


def hamming(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x)


def age(distance: Column, rate: float = 3e-8) -> Column:
    return distance / (2 * rate)


def distances(p: Column, q: Column, n: Column) -> Column:
    """struct<raw, jc69, k2p> of transitions, transversions and compared columns; null where a log has no value."""
    t, v, raw = p / n, q / n, (p + q) / n
    jc = F.when(1 - 4 * raw / 3 > 0, -0.75 * F.log(1 - 4 * raw / 3))
    k2p = F.when((1 - 2 * t - v > 0) & (1 - 2 * v > 0), -0.5 * F.log((1 - 2 * t - v) * F.sqrt(1 - 2 * v)))
    return F.struct(raw.alias("raw"), jc.alias("jc69"), k2p.alias("k2p"))


def _is_transition(pair: Column) -> Column:
    return pair.isin("AG", "GA", "CT", "TC")


def btop_counts(btop: Column) -> Column:
    """struct<matches, transitions, transversions> of a BTOP string; gaps and ambiguous bases don't count."""
    tokens = F.regexp_extract_all(F.upper(btop), F.lit(r"(\d+|\D\D)"), F.lit(1))
    numbers = F.filter(tokens, lambda t: t.rlike(r"^\d+$"))
    pairs = F.filter(tokens, lambda t: t.rlike("^[ACGT]{2}$"))
    return F.struct(
        F.aggregate(numbers, F.lit(0).cast("bigint"), lambda n, t: n + t.cast("bigint")).alias("matches"),
        F.size(F.filter(pairs, _is_transition)).cast("bigint").alias("transitions"),
        F.size(F.filter(pairs, lambda t: ~_is_transition(t) & (F.substring(t, 1, 1) != F.substring(t, 2, 1)))).cast("bigint").alias("transversions"),
    )


def btop_k2p(btop: Column) -> Column:
    """Four decimals, 0.0000 for equal, NA where it is saturated or nothing was compared."""
    c = btop_counts(btop)
    n = c["matches"] + c["transitions"] + c["transversions"]
    k2p = distances(c["transitions"], c["transversions"], n)["k2p"]
    return F.when(n == 0, "NA").when(k2p.isNull(), "NA").otherwise(F.format_string("%.4f", F.abs(k2p)))


def cigar_counts(cigar: Column) -> Column:
    """struct<matches, mismatches, gap_bases, gaps> of an =/X/I/D string (M counts as a match)."""
    tokens = F.regexp_extract_all(cigar, F.lit(r"(\d+[=XMID])"), F.lit(1))
    total = lambda ops: F.aggregate(F.filter(tokens, lambda t: F.right(t, F.lit(1)).isin(*ops)), F.lit(0).cast("bigint"), lambda n, t: n + F.regexp_extract(t, r"^(\d+)", 1).cast("bigint"))
    return F.struct(total("=M").alias("matches"), total("X").alias("mismatches"), total("ID").alias("gap_bases"), F.size(F.filter(tokens, lambda t: F.right(t, F.lit(1)).isin("I", "D"))).cast("bigint").alias("gaps"))


def gap_compressed_identity(cigar: Column) -> Column:
    """matches / (matches + mismatches + gaps), each gap counted once."""
    c = cigar_counts(cigar)
    n = c["matches"] + c["mismatches"] + c["gaps"]
    return F.when(n > 0, c["matches"] / n)


def aligned_jc(a: Column, b: Column, cap: float = 3.0) -> Column:
    """JC distance over columns where both hold a base; the cap from a difference of 3/4 on, 0 without such a column."""
    both = F.filter(F.arrays_zip(F.split(F.upper(a), "").alias("x"), F.split(F.upper(b), "").alias("y")), lambda p: p["x"].isin(*"ACGT") & p["y"].isin(*"ACGT"))
    n, d = F.size(both), F.size(F.filter(both, lambda p: p["x"] != p["y"]))
    raw = d / n
    return F.when(n == 0, 0.0).when(raw >= 0.75, cap).otherwise(-0.75 * F.log(1 - 4 * raw / 3))


def shared_substring(left: Column, right: Column, least: int = 5, bases: int = 2) -> Column:
    """The longest exact string of both flanks with at least ``bases`` distinct bases; the leftmost of equal length."""
    n = F.length(left)
    starts = F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1)))

    def of(i: Column) -> Column:
        return F.transform(F.sequence(F.lit(least), F.greatest(n - i + 1, F.lit(least))), lambda k: F.struct((-k).alias("k"), i.alias("i"), F.substring(left, i, k).alias("s")))

    every = F.flatten(F.transform(starts, of))
    good = F.filter(every, lambda x: (F.length(x["s"]) == -x["k"]) & F.contains(right, x["s"]) & x["s"].rlike("^[ACGT]+$") & (F.size(F.array_distinct(F.split(x["s"], ""))) >= bases))
    return F.array_min(good)["s"]


def clean_lifted(seq: Column) -> Column:
    """Frame marks, gaps and lower-case letters go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(seq, r"~\d+~", ""), "-", ""), "[a-z]", "")


def run_signature(inner: str, ring: str, base: int, flank: int) -> str:
    """A pattern for a run of ``inner`` (base or more) between runs of ``ring`` (flank or more each side, outwards)."""
    left = "".join(f"{c}{{{flank},}}" for c in reversed(ring))
    return f"{left}{inner}{{{base},}}{''.join(f'{c}{{{flank},}}' for c in ring)}"


def translate_codons(df: DataFrame, cds: str = "cds", out: str = "pep") -> DataFrame:
    """The protein of each coding sequence; X for codons with other letters; a rest of one or two bases is dropped."""
    place = np.full(256, 64, np.uint8)
    place[np.frombuffer(b"TCAGtcag", np.uint8)] = [*range(4), *range(4)]
    amino = np.frombuffer((AMINO + "X" * 192).encode(), np.uint8)

    @F.pandas_udf("string")
    def translate(seqs: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            at = place[np.frombuffer(s[: len(s) // 3 * 3].encode("ascii", "replace"), np.uint8).reshape(-1, 3)].astype(np.int64)
            return amino[np.minimum(at[:, 0] * 16 + at[:, 1] * 4 + at[:, 2] + 64 * (at > 3).any(axis=1), 255)].tobytes().decode()

        return seqs.map(one)

    return df.withColumn(out, translate(cds))


def tsd_search(df: DataFrame, left: str, right: str, low: int = 4, high: int = 6, jitter: int = 2, subs: int = 1) -> DataFrame:
    """Target-site duplication with jitter and substitutions: the longest wins, then fewer substitutions, then less jitter.

    left ends at the element's start, right begins behind its end. Adds tsd_length, tsd_subs, tsd_jitter, tsd.
    """
    @F.pandas_udf("tsd_length int, tsd_subs int, tsd_jitter int, tsd string")
    def search(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            best = None
            for n in range(high, low - 1, -1):
                for i in range(jitter + 1):
                    for j in range(jitter + 1):
                        end = len(x) - i
                        p, q = x[max(0, end - n) : end], y[j : j + n]
                        if len(p) == n and len(q) == n and set(p + q) <= set("ACGT") and len(set(p)) > 1:
                            d = sum(c != e for c, e in zip(p, q, strict=True))
                            if d <= subs:
                                key = (n, -d, -(i + j))
                                best = max(best, (key, p)) if best and best[0] == key else (key, p) if best is None or key > best[0] else best
                if best:
                    break
            out.append((best[0][0], -best[0][1], -best[0][2], best[1]) if best else (None, None, None, None))
        return pd.DataFrame(out, columns=["tsd_length", "tsd_subs", "tsd_jitter", "tsd"])

    return df.withColumn("__t", search(left, right)).select(*df.columns, "__t.*")


def repaired_frames(df: DataFrame, cds: str = "cds", pep: str = "pep") -> DataFrame:
    """With codons: the coding sequence cut to the codons of the peptide.

    Bases that fit no residue are skipped: one or two first, then three or four where the residue behind fits too; an
    X in the peptide fits any codon. Null where a residue can't be placed.
    """
    code = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}

    def place(seq: str, protein: str) -> str | None:
        fits = lambda at, r: at + 3 <= len(seq) and (r == "X" or code.get(seq[at : at + 3], "X") in (r, "X"))
        at, out = 0, []
        for n, residue in enumerate(protein):
            following = protein[n + 1] if n + 1 < len(protein) else None
            for skip in (0, 1, 2, 3, 4):
                if fits(at + skip, residue) and (skip < 3 or following is None or fits(at + skip + 3, following)):
                    out.append(seq[at + skip : at + skip + 3])
                    at += skip + 3
                    break
            else:
                return None
        return "".join(out)

    @F.pandas_udf("string")
    def repair(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([place((x or "").upper(), (y or "").rstrip("*")) for x, y in zip(a, b, strict=True)])

    return df.withColumn("codons", repair(cds, pep))

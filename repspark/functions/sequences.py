"""Column expressions over nucleotide and amino-acid strings, gene calls and identifiers; native but for translation."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from repspark.kernels.codons import translate
from repspark.runtime import ship


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(seq: Column | str) -> Column:
    """Reverse complement in upper case; other letters stay."""
    return F.reverse(F.translate(F.upper(col(seq)), "ACGT", "TGCA"))


def translate_nt(seq: Column | str) -> Column:
    """Amino acids of the whole codons; an unknown codon is X, a stop is *. A batch is translated at once, over Arrow."""
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def aa(s: pa.Array) -> pa.Array:
        return translate(s)

    return aa(col(seq))


def cdr3_nt(junction: Column | str) -> Column:
    """The junction without its first and last codon; empty if nothing is left."""
    j = col(junction)
    return F.when(F.length(j) > 6, F.substring(j, F.lit(4), F.length(j) - 6)).when(j.isNotNull(), "")


def cdr3_aa(junction_aa: Column | str) -> Column:
    j = col(junction_aa)
    return F.when(F.length(j) > 2, F.substring(j, F.lit(2), F.length(j) - 2)).when(j.isNotNull(), "")


def junction_from(vdj: Column | str, arch: Column) -> Column:
    """The CDR3 with three bases on either side, cut from the sequence by its region lengths."""
    s, before = col(vdj), _sum(arch, 5)
    return F.substring(s, F.greatest(F.lit(1), before - 2), arch[5] + 6)


def _sum(arch: Column, n: int) -> Column:
    return reduce(lambda a, b: a + b, [arch[i] for i in range(n)])


def matches(a: Column | str, b: Column | str) -> Column:
    """Positions at which two strings agree."""
    x, y = F.split(col(a), ""), F.split(col(b), "")
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v)


def identity(a: Column | str, b: Column | str) -> Column:
    """Share of agreeing positions of two strings of equal length; null if lengths differ or are 0."""
    a, b = col(a), col(b)
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), matches(a, b) / F.length(a))


def v_identity(seq: Column | str, germline: Column | str, length: Column | str) -> Column:
    """Percent identity over the first ``length`` positions."""
    n = col(length)
    return F.when(n > 0, matches(F.substring(col(seq), F.lit(1), n), F.substring(col(germline), F.lit(1), n)) * 100.0 / n)


def v_genes(v_call: Column | str) -> Column:
    """Sorted distinct genes of a call list: the part before '/', no allele, trimmed, in upper case; '' and NA are none."""
    parts = F.split(F.substring_index(col(v_call), "/", 1), ",")
    genes = F.transform(parts, lambda g: F.upper(F.trim(F.regexp_replace(g, r"\*\d+", ""))))
    return F.array_sort(F.array_distinct(F.filter(genes, lambda g: ~g.isin("", "NA"))))


def compose_vdj(v: Column | str, d: Column | str, j: Column | str) -> Column:
    """V/D/J with '/' inside a call written as '-' and a missing D ('' or NA too) left out."""
    clean = lambda c: F.when(~F.trim(col(c)).isin("", "NA"), F.regexp_replace(col(c), "/", "-"))
    return F.concat_ws("/", F.coalesce(clean(v), F.lit("")), clean(d), F.coalesce(clean(j), F.lit("")))


def locus(gene: Column | str) -> Column:
    return F.upper(F.substring(col(gene), 1, 3))


def barcode(contig_id: Column | str, sample: Column | str | None = None) -> Column:
    """The contig id up to its first '_', with the sample if given."""
    b = F.substring_index(col(contig_id), "_", 1)
    return b if sample is None else F.concat_ws("_", b, col(sample))


def read_count(sequence_id: Column | str) -> Column:
    """The number after '=', null where there is none."""
    return F.try_element_at(F.split(col(sequence_id), "="), F.lit(2)).try_cast("bigint")


def as_bool(c: Column | str) -> Column:
    """T or TRUE, F or FALSE, in any case; anything else is null."""
    u = F.upper(F.trim(col(c).cast("string")))
    return F.when(u.isin("T", "TRUE"), True).when(u.isin("F", "FALSE"), False)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def sorted_join(c: Column | str, sep: str = "-") -> Column:
    """Aggregate: the group's strings sorted and joined."""
    return F.array_join(F.array_sort(F.collect_list(col(c))), sep)


def region_bounds(arch: Column) -> list[tuple[str, Column, Column]]:
    """(region, start, end) of the seven regions, from 1, from their lengths."""
    names = ["fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
    out, start = [], F.lit(1)
    for i, n in enumerate(names):
        end = start + arch[i] - 1
        out.append((n, start, end))
        start = end + 1
    return out


def slice_string(s: Column | str, start: Column, end: Column) -> Column:
    """Characters start..end, from 1; empty if end is before start."""
    return F.when(end < start, F.lit("")).otherwise(F.substring(col(s), start.cast("int"), (end - start + 1).cast("int")))


def r110(vdj: Column | str, seq: Column | str) -> Column:
    """'[R110]' if the first V gene is IGLV3-21 and the sequence ends with C, else ''."""
    gene = F.upper(F.regexp_replace(F.substring_index(F.substring_index(col(vdj), "/", 1), "*", 1), " ", ""))
    return F.when((gene == "IGLV3-21") & col(seq).endswith("C"), "[R110]").otherwise("")


def glycosylation_sites(functional: Column, vdj: Column | str, arch: Column, aa: Column | str, germline_aa: Column | str) -> Column:
    """'[CDR-AGS (NGT:CDR1;...)]' of acquired sites N, not P, S or T in productive heavy chains, else ''.

    A site is acquired if the germline differs in its three residues. A site belongs to a framework if it
    ends in it, to a CDR if it begins in it. The two translations are looked into at each residue, so they should
    be columns already, not expressions.
    """
    s, g = col(aa), F.coalesce(col(germline_aa), F.lit(""))
    ends = []
    total = F.lit(0)
    for i in range(6):
        total = total + F.floor(arch[i] / 3).cast("int")
        ends.append(total)
    at = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))),
        lambda i: F.substring(s, i, F.lit(3)).rlike("^N[^P][TS]$") & (F.substring(s, i, F.lit(3)) != F.substring(g, i, F.lit(3))),
    )

    def region(i: Column) -> Column:
        return (
            F.when(i + 2 <= ends[0], "FR1").when(i <= ends[1], "CDR1").when(i + 2 <= ends[2], "FR2").when(i <= ends[3], "CDR2").when(i + 2 <= ends[4], "FR3").when(i <= ends[5], "CDR3").otherwise("FR4")
        )

    sites = F.transform(at, lambda i: F.concat(F.substring(s, i, F.lit(3)), F.lit(":"), region(i)))
    heavy = F.forall(v_genes(vdj), lambda x: x.contains("IGH"))
    text = F.concat(F.lit("["), F.when(F.exists(sites, lambda x: x.contains(":CDR")), "CDR-AGS").otherwise("FR-AGS"), F.lit(" ("), F.array_join(sites, ";"), F.lit(")]"))
    return F.when(functional & heavy & (F.length(s) > 2) & (F.size(sites) > 0), text).otherwise("")

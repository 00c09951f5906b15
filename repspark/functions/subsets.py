"""Stereotyped receptor subsets of heavy-chain CDR3, as an ordered table of rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from repspark.functions.sequences import cdr3_aa, col, v_genes


class Rule(NamedTuple):
    label: str
    v: str  # pattern of a gene
    shortest: int
    longest: int
    motifs: tuple[tuple[str, int, int], ...]  # (pattern, first, last residue it is sought in; 0, 0: all)


def _major(label: str, v: str, length: int, motif: str) -> Rule:
    return Rule(label, v, length, length, ((motif, 0, 0),))


def _near(label: str, v: str, shortest: int, longest: int, *motifs: tuple[str, int, int]) -> Rule:
    return Rule(label, v, shortest, longest, motifs)


#: The published subset definitions, first match wins.
MAJOR = (
    _major("CLL#1", "IGHV[157]", 13, "^AR.QWL....FDY$"),
    _major("CLL#2", "^IGHV3-21$", 9, "^A.[DE]...MDV$"),
    _major("CLL#4", "^IGHV4-34$", 20, "^[AV]RG.......[RK]RYYYYGMDV$"),
    _major("CLL#5", "^IGHV1-69$", 20, "^AR....GV[IV]...YYYY[GY]MDV$"),
    _major("CLL#6", "^IGHV1-69$", 21, "^ARGG.YDY[VI]WGSYR.NDAFDI$"),
    _major("CLL#8", "^IGHV4-39$", 19, "^A[RST]...YSSSWY...NWFDP$"),
    _major("CLL#8B", "^IGHV4-39$", 18, "^A[RST]...YSSSWY...WFDP$"),
    _major("CLL#10", "^IGHV4-39$", 22, "^AR[HD]R.GYCSSTSCYYYYYGMDV$"),
    _major("CLL#12", "IGHV1-(2|46)$", 19, "^ARD..YYDSSGYY[ST]..FDY$"),
    _major("CLL#14", "IGHV[246]", 10, "^[AV]RGG.W.FD.$"),
    _major("CLL#16", "^IGHV4-34$", 24, "^A.RFYCSG..C....YYYYYG[LM]D[VA]$"),
    _major("CLL#31", "^IGHV3-48$", 21, "^AR[DE].DFWSGYY.YYYYY[GY]MDV$"),
    _major("CLL#59", "IGHV1-(58|69)$", 12, "^A...DFWSGY..$"),
    _major("CLL#64B", "IGHV3", 21, "^A[KR][DE][ST][PL]LVV[PV][AT]AI[FY]YYYYGMDV$"),
    _major("CLL#73", "IGHV3", 12, "^A[KR]D....[WY]..DY$"),
    _major("CLL#77", "IGHV4-(4|59)$", 14, "^[AV]RG[PA][DN].[ST]GW..[FL].Y$"),
    _major("CLL#99", "IGHV[157]", 14, "^AR.QWL.....FDY$"),
    _major("CLL#111", "^IGHV1-18$", 10, "^AR.SGG..[DE].$"),
    _major("CLL#169", "^IGHV3-48$", 9, "^AR[DE]......$"),
    _major("CLL#188", "^IGHV3-72$", 17, "^[AV]R..YC[ST][SG][TG][TS]CR..[FL]D.$"),
    _major("CLL#201", "^IGHV4-34$", 17, "^ARR...W.....D[AG]FD.$"),
    _major("CLL#252", "^IGHV3-30$", 19, "^AK[VI]...G.F....YYGMD[VA]$"),
    _major("CLL#148B", "^IGHV2-5$", 17, "^AHR......W..G.FDY$"),
    _major("CLL#28A", "^IGHV1-2$", 17, "^AR.[YL]SGSYYYYYYGMDV$"),
    _major("CLL#3C2", "^IGHV1-69$", 22, "^A...DIVVVPAA..YYYYGMDV$"),
    _major("CLL#3C3", "^IGHV1-69$", 22, "^AR..PDIVVVPAAI.[YR]YYGMDV$"),
    _major("CLL#7C2", "^IGHV1-69$", 23, "^A[RST]....DFWSGYYPNYYYYGMDV$"),
    _major("CLL#7D3", "^IGHV1-69$", 24, "^A.....[YGD]DFWSGYYPNYYYY[GY]MDV$"),
    _major("CLL#202", "IGHV3", 14, "^ARG..GDY...FD[YIV]$"),
)

#: The satellite definitions, tried where no major one fits.
SATELLITE = (
    _near("Satellite#1/99", "IGHV[157]", 11, 16, ("QWL", 2, 8)),
    _near("Satellite#2/169", "IGHV3", 7, 11, ("[DE]", 1, 5)),
    _near("Satellite#4", "^IGHV4-34$", 18, 22, ("KR|RR", 9, 18)),
    _near("Satellite#5", "IGHV[157]", 18, 22, ("GVV|GVI", 5, 11)),
    _near("Satellite#6", "IGHV[157]", 19, 23, ("WGSYK|WGSYR", 8, 16)),
    _near("Satellite#8/8B", "IGHV[246]", 16, 21, ("YSSSWY", 4, 13)),
    _near("Satellite#10", "IGHV[246]", 20, 24, ("GYCSSTSC", 4, 15)),
    _near("Satellite#12", "IGHV[157]", 17, 21, ("YYDSSGYY", 4, 15)),
    _near("Satellite#14", "IGHV[246]", 8, 12, ("RGG", 1, 6)),
    _near("Satellite#16", "IGHV[246]", 22, 26, ("FYCS", 2, 9)),
    _near("Satellite#31", "IGHV3", 19, 23, ("FWSGY", 4, 12)),
    _near("Satellite#59", "IGHV[157]", 10, 14, ("FWSGY", 4, 11)),
    _near("Satellite#64B", "IGHV3", 19, 23, ("LVV", 4, 10)),
    _near("Satellite#73", "IGHV3", 10, 14, ("KD|RD", 1, 5), ("DY", 9, 13)),
    _near("Satellite#77", "IGHV[246]", 12, 16, ("GW", 6, 11)),
    _near("Satellite#111", "IGHV[157]", 8, 12, ("SGG", 2, 8)),
    _near("Satellite#188", "IGHV3", 15, 19, ("YC|FC", 3, 8), ("CR|CY", 9, 14)),
    _near("Satellite#201", "IGHV[246]", 15, 19, ("ARR", 1, 5), ("W", 5, 9)),
    _near("Satellite#252", "IGHV3", 17, 21, ("G", 5, 9), ("F", 7, 11)),
    _near("Satellite#148B", "IGHV[246]", 15, 19, ("HR", 1, 5), ("W", 8, 12)),
    _near("Satellite#28A", "IGHV[157]", 15, 19, ("SGS", 3, 9)),
    _near("Satellite#3C2/3C3", "IGHV[157]", 20, 24, ("DIVVVPAA", 3, 15)),
    _near("Satellite#7C2/7D3", "IGHV[157]", 21, 26, ("DFWSGY", 5, 15)),
    _near("Satellite#202", "IGHV3", 12, 16, ("GDY", 4, 10)),
)


def stereotype_subset(functional: Column, vdj: Column | str, junction_aa: Column | str, satellites: bool = True) -> Column:
    """Label of the first rule that fits; 'Unassigned' if none does; 'NA' if the row is no productive heavy chain with a CDR3."""
    j = col(junction_aa)
    cdr3, genes = cdr3_aa(j), v_genes(vdj)
    n = F.length(cdr3)
    out = None
    for r in MAJOR + (SATELLITE if satellites else ()):
        fits = n.between(r.shortest, r.longest) & _any(genes, r.v)
        for motif, first, last in r.motifs:
            fits = fits & (cdr3 if last == 0 else F.substring(cdr3, first, last - first + 1)).rlike(motif)
        out = F.when(fits, r.label) if out is None else out.when(fits, r.label)
    eligible = F.coalesce(functional, F.lit(False)) & (F.size(genes) > 0) & F.forall(genes, lambda g: g.contains("IGH")) & (F.coalesce(j, F.lit("")) != "")
    return F.when(eligible, out.otherwise("Unassigned")).otherwise("NA")


def _any(genes: Column, pattern: str) -> Column:
    return F.exists(genes, lambda g: g.rlike(pattern))

"""Consensus CDR3 and germline of clonotypes, subset labels, acquired sites, gap correction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.sequences import glycosylation_sites, r110, translate_nt, v_genes
from repspark.functions.subsets import stereotype_subset
from repspark.kernels.codons import agreeing, agreement, translate
from repspark.kernels.indels import correct, match_consensus
from repspark.kernels.subset_labels import labels
from repspark.runtime import map_groups, ship

#: A clonotype's distinct CDR3 are counted in so many parts.
PARTS = 16
#: Cells whose chains are worked on at once.
CELLS = 1000
_FIXED = pa.struct([("seq", pa.string()), ("germ", pa.string()), ("arch", pa.list_(pa.int32())), ("indel", pa.string())])
_MATCHED = pa.struct([("seq", pa.string()), ("indel", pa.string())])


def correct_indels(df: DataFrame) -> DataFrame:
    """Rows with VDJseq, germline_alignment and arch without inner gaps, and the events as ``indel`` (null if none).

    One pass: only rows with a gap between bases are sent to Python, of the others a null.
    """
    ship(df.sparkSession)
    gap = "[ACTG]-+[ACTG]"
    flagged = F.col("VDJseq").rlike(gap) | F.col("germline_alignment").rlike(gap)
    sent = lambda c: F.when(flagged, c)

    @F.arrow_udf("struct<seq: string, germ: string, arch: array<int>, indel: string>")
    def fix(seq: pa.Array, germ: pa.Array, arch: pa.Array) -> pa.Array:
        rows = [None] * len(seq)
        for i in np.flatnonzero(seq.is_valid().to_numpy(zero_copy_only=False)).tolist():
            rows[i] = dict(zip(("seq", "germ", "arch", "indel"), correct(seq[i].as_py(), germ[i].as_py(), arch[i].as_py())))
        return pa.array(rows, _FIXED)

    df = df.withColumn("arch", F.col("arch").cast("array<int>"))
    df = df.withColumn("_f", fix(sent(F.col("VDJseq")), sent(F.col("germline_alignment")), sent(F.col("arch"))))
    new = {"VDJseq": "seq", "germline_alignment": "germ", "arch": "arch"}
    return df.withColumns({c: F.when(F.col("_f").isNotNull(), F.col(f"_f.{f}")).otherwise(F.col(c)) for c, f in new.items()} | {"indel": F.col("_f.indel")}).drop("_f")


def consensus_cdr3(df: DataFrame, keys: list[str], cdr3: str) -> DataFrame:
    """(keys, consensus): per column the most frequent letter among CDR3 of modal length (ties: the smallest), tied letters as a sorted [class].

    Equal CDR3 of a key are counted first; a key with one CDR3 of modal length has that. Of the others the letters of each place
    are counted within a part of the key's CDR3 (over Arrow, so a hot clonotype is spread over tasks), and only one counter per
    place and letter of a part meets the others.
    """
    n = df.where(F.length(cdr3) > 0).groupBy(*keys, F.col(cdr3).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    by_len = n.groupBy(*keys, F.length("_s").alias("_len")).agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_d"), F.min("_s").alias("_s"))
    modal = by_len.groupBy(*keys).agg(F.max_by(F.struct("_len", "_d", "_s"), F.struct("_t", -F.col("_len"))).alias("_m")).select(*keys, "_m.*")
    alone = modal.where("_d = 1").select(*keys, F.col("_s").alias("consensus"))
    modal = modal.where("_d > 1").select(*keys, "_len")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def letters(g: dict[str, list]) -> list[tuple]:
        key = [g[k][0] for k in keys]
        counts: dict[tuple[int, str], int] = {}
        for s, n in zip(g["_s"], g["_n"]):
            for place, c in enumerate(s):
                counts[place, c] = counts.get((place, c), 0) + n
        return [(*key, p, c, n) for (p, c), n in counts.items()]

    def join(g: dict[str, list]) -> list[tuple]:
        best: dict[int, tuple[int, str]] = {}
        for p, c, n in sorted(zip(g["_p"], g["_c"], g["_n"])):
            most, chars = best.get(p, (0, ""))
            best[p] = (n, c) if n > most else (most, chars + c) if n == most else (most, chars)
        text = "".join(f"[{cs}]" if len(cs) > 1 else cs for _, (_, cs) in sorted(best.items()))
        return [(*[g[k][0] for k in keys], text)]

    parts = n.join(modal, keys).where(F.length("_s") == F.col("_len")).select(*keys, "_s", "_n", F.pmod(F.xxhash64("_s"), F.lit(PARTS)).cast("int").alias("_part"))
    counted = map_groups(parts, [*keys, "_part"], letters, f"{kinds}, _p int, _c string, _n bigint")
    return alone.unionByName(map_groups(counted.groupBy(*keys, "_p", "_c").agg(F.sum("_n").alias("_n")), keys, join, f"{kinds}, consensus string"))


def possible_cdr3(consensus: Column | str) -> Column:
    """All strings that a consensus with [classes] stands for."""
    c = F.col(consensus) if isinstance(consensus, str) else consensus
    tokens = F.regexp_extract_all(c, F.lit(r"(\[[^\]]*\]|.)"), F.lit(1))
    return F.aggregate(
        tokens,
        F.array(F.lit("")),
        lambda acc, t: F.flatten(F.transform(acc, lambda a: F.transform(F.filter(F.split(F.regexp_replace(t, r"[\[\]]", ""), ""), lambda x: x != ""), lambda x: F.concat(a, x)))),
    )


def clonotype_subset(functional: Column, vdj: Column | str, consensus: Column | str, satellites: bool = True) -> Column:
    """Distinct subset labels of all CDR3 that the consensus stands for, sorted and joined by ','; 'NA' where no row could have one, null without a consensus.

    A (genes, consensus) is looked at once per worker, and its CDR3 aren't spelled out (``kernels.subset_labels``).
    """
    ship(SparkSession.active())

    @F.arrow_udf("string")
    def find(ok: pa.Array, genes: pa.Array, text: pa.Array) -> pa.Array:
        rows = zip(ok.to_pylist(), genes.to_pylist(), text.to_pylist())
        heavy = lambda g: bool(g) and all("IGH" in x for x in g)
        return pa.array([None if t is None else ",".join(labels(tuple(g), t, satellites)) if o and heavy(g) and t else "NA" for o, g, t in rows], pa.string())

    return find(functional, v_genes(vdj), F.col(consensus) if isinstance(consensus, str) else consensus)


def _compare(spark: SparkSession):
    """The function that tells how far a germline agrees with a sequence, and fills it."""
    ship(spark)

    @F.arrow_udf("struct<agree: double, missing: bigint, filled: string>")
    def compare(s: pa.Array, g: pa.Array) -> pa.Array:
        share, missing, filled = agreement(s, g)
        return pa.StructArray.from_arrays([pa.array(share), pa.array(missing), filled], names=["agree", "missing", "filled"])

    return compare


def consensus_germline(df: DataFrame, keys: list[str], seq: str, germline: str, cdr3: str, order: str) -> DataFrame:
    """(keys, consensus_germline, modal_cdr3): germline of the row of modal CDR3 length that agrees best with it, its N replaced by the row's bases, and that length.

    Agreement ignores germline N; then fewest N, then the smallest ``order``. Equal pairs of a key are compared once.
    """
    base = df.where(F.col(germline).isNotNull() & F.col(seq).isNotNull())
    pairs = base.groupBy(*keys, F.length(cdr3).alias("_len"), F.col(seq).alias("_s"), F.col(germline).alias("_g")).agg(F.count(F.lit(1)).alias("_t"), F.min(order).alias("_o"))
    modal = pairs.groupBy(*keys, "_len").agg(F.sum("_t").alias("_t")).groupBy(*keys).agg(F.max_by("_len", F.struct("_t", -F.col("_len"))).alias("modal_cdr3"))

    rows = pairs.join(modal, keys).where(F.col("_len") == F.col("modal_cdr3")).withColumn("_x", _compare(df.sparkSession)("_s", "_g"))
    best = F.min_by("_x.filled", F.struct(-F.col("_x.agree"), F.col("_x.missing"), F.col("_o"), F.col("_x.filled")))
    return rows.groupBy(*keys).agg(best.alias("consensus_germline"), F.max("modal_cdr3").alias("modal_cdr3"))


def correct_cdr3_length(df: DataFrame, seq: str, germline: str, consensus: str, differs: Column) -> DataFrame:
    """Rows with VDJseq_correctedCDR3, and in indel_CDR3 the events that led to it: where ``differs`` holds, the sequence brought to the clonotype's consensus germline.

    One pass: only rows that differ are sent to Python, of the others a null.
    """
    ship(df.sparkSession)
    wrong = differs & F.col(seq).isNotNull() & F.col(germline).isNotNull() & F.col(consensus).isNotNull()
    sent = lambda c: F.when(wrong, F.col(c))

    @F.arrow_udf("struct<seq: string, indel: string>")
    def fix(s: pa.Array, g: pa.Array, c: pa.Array) -> pa.Array:
        rows = [None] * len(s)
        for i in np.flatnonzero(s.is_valid().to_numpy(zero_copy_only=False)).tolist():
            new, _, events = match_consensus(s[i].as_py(), g[i].as_py(), c[i].as_py())
            rows[i] = {"seq": new, "indel": events}
        return pa.array(rows, _MATCHED)

    df = df.withColumn("_f", fix(sent(seq), sent(germline), sent(consensus)))
    return df.withColumns({"VDJseq_correctedCDR3": F.when(F.col("_f").isNotNull(), F.col("_f.seq")).otherwise(F.col(seq)), "indel_CDR3": F.col("_f.indel")}).drop("_f")


def best_germline(rows: DataFrame, keys: list[str], seq: str, germline: str, order: str) -> DataFrame:
    """(keys, consensus_germline) as ``consensus_germline``, of rows of modal CDR3 length with sequence and germline. No row is shuffled by ``keys``, but the best of each task."""
    best = F.min_by("_x.filled", F.struct(-F.col("_x.agree"), F.col("_x.missing"), F.col(order), F.col("_x.filled")))
    return rows.withColumn("_x", _compare(rows.sparkSession)(seq, germline)).groupBy(*keys).agg(best.alias("consensus_germline"))


def chain_sequences(chains: Column) -> Column:
    """Of an array of (seq, germ, cons, differs, own, n) an array of (seq, indel, aa, cons, cons_aa, identity): each sequence as ``correct_cdr3_length`` leaves it, the events, its amino acids, and ``cons`` and its amino acids. Where ``own`` holds, ``cons`` is the row's germline with each N replaced by the row's base. ``identity`` is as ``v_identity`` has it, over the first ``n`` bases. A batch is done in slices of ``CELLS``, to bound memory."""
    ship(SparkSession.active())

    def part(x: pa.Array) -> pa.Array:
        seq, germ, cons, differs, own, n = x.flatten().flatten()
        cons, own = cons.cast(pa.string()), pc.fill_null(own, False)
        if pc.any(own).as_py():
            cons = pc.replace_with_mask(cons, own, agreement(seq.filter(own), germ.filter(own))[2])
        upto = pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.and_(pc.greater(pa.array(upto), 0), pc.and_(seq.is_valid(), cons.is_valid()))
        identity = pc.if_else(known, pa.array(agreeing(seq, cons, upto) * 100.0 / np.maximum(upto, 1)), pa.scalar(None, pa.float64()))
        wrong = pc.and_(pc.fill_null(differs, False), pc.and_(seq.is_valid(), pc.and_(germ.is_valid(), cons.is_valid())))
        at = np.flatnonzero(wrong.to_numpy(zero_copy_only=False)).tolist()
        events: list[str | None] = [None] * len(seq)
        if at:
            new = seq.to_pylist()
            for i in at:
                new[i], _, events[i] = match_consensus(new[i], germ[i].as_py(), cons[i].as_py())
            seq = pa.array(new, pa.string())
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int32)
        values = pa.StructArray.from_arrays([seq.cast(pa.string()), pa.array(events, pa.string()), translate(seq), cons, translate(cons), identity], names=["seq", "indel", "aa", "cons", "cons_aa", "identity"])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    @F.arrow_udf("array<struct<seq: string, indel: string, aa: string, cons: string, cons_aa: string, identity: double>>")
    def fix(x: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(x.slice(i, CELLS)) for i in range(0, max(1, len(x)), CELLS)])

    return fix.asNondeterministic()(chains)  # else the optimizer puts it into the expressions that use it, where Python can't run


def joined_events(own: Column | str, more: Column | str) -> Column:
    """Gap events, each once, in order; null if there are none."""
    each = lambda c: F.coalesce(F.split(c, ","), F.array().cast("array<string>"))
    return F.nullif(F.array_join(F.filter(F.array_union(each(own), each(more)), lambda x: x != ""), ","), F.lit(""))


def annotate_features(df: DataFrame, subsets: bool = True, satellites: bool = True, ags: bool = True) -> DataFrame:
    """Rows with IGHsubset (if ``subsets``; kept where it is there already), and the marks of R110 (too) and of acquired glycosylation sites appended to VDJ."""
    ok = F.col("productive") == "productive"
    marks = []
    if subsets:
        df = df if "IGHsubset" in df.columns else df.withColumn("IGHsubset", stereotype_subset(ok, "VDJ", "junction_aa", satellites))
        marks.append(r110("VDJ", "VDJseq"))
    if ags:
        df = df.withColumns({"_aa": translate_nt("VDJseq"), "_germline_aa": translate_nt("germline_alignment")})
        marks.append(F.coalesce(glycosylation_sites(ok, "VDJ", F.col("arch"), "_aa", "_germline_aa"), F.lit("")))
    return df.withColumn("VDJ", F.concat("VDJ", *marks)).drop("_aa", "_germline_aa") if marks else df

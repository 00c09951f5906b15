"""Queries of the row-level operators: reads, filters, composition, translation, identities, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.sequences import as_bool, barcode, cdr3_aa, cdr3_nt, compose_vdj, glycosylation_sites, identity, junction_from, locus, matches, r110, read_count, revcomp, translate_nt, v_genes, v_identity
from repspark.functions.subsets import MAJOR, SATELLITE, stereotype_subset
from repspark.operators.reads import collapse, long_enough, numbered_reads
from repspark.operators.report import clonality, flag_rates, locus_counts, scores_long
from repspark.operators.tidy import PRIMERS, REGIONS, modal_length, primer_complete, tidy, unique_sequences, with_read_counts
from repspark.plans.base import ALIGNED_SQL, CONTIGS_SQL, GENES_SQL, aligned, latest_contigs

_KEY = ["sample", "sequence_id"]


def revcomp_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir, ["junction"]).select(*_KEY, revcomp("junction").alias("rc"))


def collapse_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_contigs(spark, sf_dir, ["junction"]).select("sample", F.col("junction").alias("sequence"))
    return numbered_reads(collapse(rows)).select("sample", "sequence_id", "sequence", "n")


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_enough(latest_contigs(spark, sf_dir, ["junction"]).withColumn("sequence", F.col("junction")), 45).select(*_KEY, F.length("sequence").alias("len"))


def _primer(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aligned(spark, sf_dir).where(primer_complete(mode)).select(*_KEY)

    return run


def tidy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(aligned(spark, sf_dir)).select(*_KEY, "VDJ", F.array_join(F.col("arch").cast("array<string>"), "-").alias("arch"), "len_no_CDR3", "len_yes_CDR3", "productive")


def vdj_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir).select(*_KEY, compose_vdj("v_call", "d_call", "j_call").alias("VDJ"))


def gene_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir).where(F.col("v_call").isNotNull())
    return df.select(*_KEY, F.array_join(v_genes("v_call"), ",").alias("genes"), locus(F.trim("v_call")).alias("chain"), barcode("sequence_id", "sample").alias("barcode"))


def booleans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir).groupBy("locus", as_bool("productive").alias("productive"), as_bool("complete_vdj").alias("complete")).agg(F.count(F.lit(1)).alias("n"))


def read_count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir).where(read_count("sequence_id").isNotNull()).select(*_KEY, read_count("sequence_id").alias("n"))


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir, ["junction", "v_call"]).where(read_count("sequence_id").isNotNull() & F.col("junction").isNotNull()).select("sample", "sequence_id", "junction", "v_call")


def unique_sequences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_read_counts(_bulk(spark, sf_dir), ["sample"])
    return unique_sequences(rows, ["sample"], ["junction"], 2).select("sample", "junction", "sequence_id", F.col("total_reads_unique_seq").alias("reads"))


def modal_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir).where(F.col("junction").isNotNull() & F.col("v_call").isNotNull()).withColumn("g", F.try_element_at(v_genes("v_call"), F.lit(1)))
    return modal_length(df, ["sample", "g"], "junction").select(*_KEY, "g", F.length("junction").alias("len"))


def translate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir, ["junction"]).where(F.col("junction").isNotNull()).select("junction").distinct().select("junction", translate_nt("junction").alias("aa"))


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tidy(aligned(spark, sf_dir))
    return df.select(*_KEY, junction_from("VDJseq", F.col("arch")).alias("cut"), cdr3_nt("junction").alias("cdr3"), cdr3_aa("junction_aa").alias("cdr3_aa"))


def v_identity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tidy(aligned(spark, sf_dir))
    return df.select(*_KEY, F.round(v_identity("VDJseq", "germline_alignment", "len_no_CDR3"), 9).alias("v_identity"))


def pairwise_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tidy(aligned(spark, sf_dir))
    return df.select(*_KEY, F.round(identity("VDJseq", "germline_alignment"), 9).alias("identity"))


def stereotype_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir)
    return df.select(*_KEY, stereotype_subset(as_bool("productive"), "v_call", "junction_aa").alias("subset"))


def r110_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir).where(F.col("v_call").isNotNull() & F.col("junction").isNotNull())
    return df.select(*_KEY, r110("v_call", "junction").alias("mark"))


def ags_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tidy(aligned(spark, sf_dir)).where(F.col("v_call").startswith("IGH"))
    df = df.withColumns({"aa": translate_nt("VDJseq"), "germline_aa": translate_nt("germline_alignment")})
    mark = glycosylation_sites(F.col("productive") == "productive", "v_call", F.col("arch"), "aa", "germline_aa")
    return df.select(*_KEY, mark.alias("mark"))


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligner rows with the flags and scores of the report: bases that agree less those that don't, over V, D (CDR3) and J (FR4)."""
    df = aligned(spark, sf_dir).withColumn("stop_codon", F.when(F.col("junction_aa").contains("*"), "T").otherwise("F")).withColumn("v_frameshift", F.when(F.length("junction") % 3 != 0, "T").otherwise("F"))
    n = sum((F.length(r) for r in REGIONS[1:5]), F.length("fwr1"))
    same = matches(F.substring(F.col("sequence_alignment"), F.lit(1), n), F.substring(F.col("germline_alignment"), F.lit(1), n))
    return df.withColumns({"v_score": (2 * same - n).cast("double"), "d_score": F.when(F.length("cdr3") > 0, F.length("cdr3") / 3), "j_score": F.length("fwr4").cast("double"), "cdr3_aa": cdr3_aa("junction_aa")})


def qc_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_rates(_report_rows(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


def qc_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locus_counts(latest_contigs(spark, sf_dir))


def qc_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores_long(_report_rows(spark, sf_dir), keys=[*_KEY, "locus"])
    return got.withColumn("score", F.round("score", 9))


def qc_clonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clonal groups and their dictionary."""
    return clonality(_report_rows(spark, sf_dir)).withColumn("percent", F.round("percent", 9))


QUERIES = {
    "revcomp": revcomp_query, "collapse_reads": collapse_reads, "length_filter": length_filter, **{f"tidy_filter_{m}": _primer(m) for m in PRIMERS}, "tidy_rows": tidy_rows, "vdj_compose": vdj_compose, "gene_lists": gene_lists,
    "booleans": booleans, "read_count_parse": read_count_parse, "unique_sequences": unique_sequences_query, "modal_length_filter": modal_length_filter, "translate_nt": translate_query, "junction": junctions,
    "v_identity": v_identity_query, "pairwise_identity": pairwise_identity, "stereotype_rules": stereotype_rules, "r110": r110_query, "ags": ags_query, "qc_rates": qc_rates, "qc_locus": qc_locus, "qc_scores_long": qc_scores_long, "qc_clonality": qc_clonality,
}

_ALL = " AND ".join(f"{r} <> ''" for r in ("fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"))
_REST = " AND ".join(f"{r} <> ''" for r in ("fwr2", "cdr2", "fwr3", "cdr3", "fwr4"))
TIDY_SQL = f"{ALIGNED_SQL}, tidy AS (SELECT *, length(fwr1 || cdr1 || fwr2 || cdr2 || fwr3) AS v_len, length(fwr1 || cdr1 || fwr2 || cdr2 || fwr3 || cdr3) AS v_cdr3_len FROM aligned WHERE whole AND {_ALL} AND upper(productive) IN ('T', 'TRUE'))"
CALL_SQL = {c: f"CASE WHEN trim({c}) NOT IN ('', 'NA') THEN replace({c}, '/', '-') END" for c in ("v_call", "d_call", "j_call")}
VDJ_SQL = f"array_to_string(list_filter([coalesce({CALL_SQL['v_call']}, ''), {CALL_SQL['d_call']}, coalesce({CALL_SQL['j_call']}, '')], lambda x: x IS NOT NULL), '/')"
_BASES = "TCAG"
CODONS_SQL = "MAP {" + ", ".join(f"'{a}{b}{c}': '{'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[16 * i + 4 * j + k]}'" for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)) + "}"


def aa_sql(s: str) -> str:
    return f"array_to_string(list_transform(range(1, length({s}) // 3 + 1), lambda i: coalesce(codons[upper(substr({s}, i * 3 - 2, 3))], 'X')), '')"


def rules_sql(cdr3: str = "c", genes: str = "genes") -> str:
    """The WHEN branches of the subset rules over a CDR3 and a list of genes."""
    out = []
    for r in MAJOR + SATELLITE:
        conds = [f"length({cdr3}) BETWEEN {r.shortest} AND {r.longest}", f"len(list_filter({genes}, lambda g: regexp_matches(g, '{r.v}'))) > 0"]
        conds += [f"regexp_matches({cdr3 if not b else f'substr({cdr3}, {a}, {b - a + 1})'}, '{m}')" for m, a, b in r.motifs]
        out.append(f"WHEN {' AND '.join(conds)} THEN '{r.label}'")
    return " ".join(out)


_REPORT = f"{ALIGNED_SQL}, rep AS (SELECT *, coalesce(upper(productive) IN ('T', 'TRUE'), false) AS ok, coalesce(contains(junction_aa, '*'), false) AS stop, length(junction) % 3 <> 0 AS shift FROM aligned)"

ORACLE = {
    "revcomp": f"WITH {CONTIGS_SQL} SELECT sample, sequence_id, reverse(translate(upper(junction), 'ACGT', 'TGCA')) AS rc FROM contigs",
    "collapse_reads": f"""WITH {CONTIGS_SQL}, n AS (SELECT sample, upper(junction) AS sequence, count(*) AS n FROM contigs WHERE length(junction) > 0 GROUP BY 1, 2)
SELECT sample, 'read' || row_number() OVER (PARTITION BY sample ORDER BY n DESC, sequence) || '_n=' || n AS sequence_id, sequence, n FROM n""",
    "length_filter": f"WITH {CONTIGS_SQL} SELECT sample, sequence_id, CAST(length(junction) AS INT) AS len FROM contigs WHERE length(junction) >= 45",
    "tidy_filter_full_length": f"WITH {ALIGNED_SQL} SELECT sample, sequence_id FROM aligned WHERE whole AND {_ALL}",
    "tidy_filter_fr1": f"WITH {ALIGNED_SQL} SELECT sample, sequence_id FROM aligned WHERE NOT whole AND {_ALL}",
    "tidy_filter_fr2": f"WITH {ALIGNED_SQL} SELECT sample, sequence_id FROM aligned WHERE NOT whole AND fwr1 = '' AND cdr1 = '' AND {_REST}",
    "tidy_filter_fr3": f"WITH {ALIGNED_SQL} SELECT sample, sequence_id FROM aligned WHERE NOT whole AND fwr1 = '' AND cdr1 = '' AND fwr2 = '' AND cdr2 = '' AND fwr3 <> '' AND cdr3 <> '' AND fwr4 <> ''",
    "tidy_filter_missionbio": f"WITH {ALIGNED_SQL} SELECT sample, sequence_id FROM aligned WHERE trim(coalesce(v_call, '')) <> '' OR cdr3 <> ''",
    "tidy_rows": f"""WITH {TIDY_SQL} SELECT sample, sequence_id, {VDJ_SQL} AS VDJ,
array_to_string([length(fwr1), length(cdr1), length(fwr2), length(cdr2), length(fwr3), length(cdr3), length(seq) - v_cdr3_len], '-') AS arch, CAST(v_len AS INT) AS len_no_CDR3, CAST(v_cdr3_len AS INT) AS len_yes_CDR3, 'productive' AS productive FROM tidy""",
    "vdj_compose": f"WITH {CONTIGS_SQL} SELECT sample, sequence_id, {VDJ_SQL} AS VDJ FROM contigs",
    "gene_lists": f"WITH {CONTIGS_SQL} SELECT sample, sequence_id, array_to_string({GENES_SQL}, ',') AS genes, upper(substr(trim(v_call), 1, 3)) AS chain, split_part(sequence_id, '_', 1) || '_' || sample AS barcode FROM contigs WHERE v_call IS NOT NULL",
    "booleans": f"WITH {CONTIGS_SQL} SELECT locus, upper(trim(productive)) IN ('T', 'TRUE') AS productive, upper(trim(complete_vdj)) IN ('T', 'TRUE') AS complete, count(*) AS n FROM contigs GROUP BY 1, 2, 3",
    "read_count_parse": f"WITH {CONTIGS_SQL} SELECT sample, sequence_id, TRY_CAST(string_split(sequence_id, '=')[2] AS BIGINT) AS n FROM contigs WHERE TRY_CAST(string_split(sequence_id, '=')[2] AS BIGINT) IS NOT NULL",
    "unique_sequences": f"""WITH {CONTIGS_SQL}, b AS (SELECT sample, sequence_id, junction, TRY_CAST(string_split(sequence_id, '=')[2] AS BIGINT) AS n FROM contigs WHERE junction IS NOT NULL)
SELECT sample, junction, min(sequence_id) AS sequence_id, CAST(sum(n) AS BIGINT) AS reads FROM b WHERE n IS NOT NULL GROUP BY 1, 2 HAVING sum(n) >= 2""",
    "modal_length_filter": f"""WITH {CONTIGS_SQL}, b AS (SELECT sample, sequence_id, {GENES_SQL}[1] AS g, CAST(length(junction) AS INT) AS len FROM contigs WHERE junction IS NOT NULL AND v_call IS NOT NULL),
m AS (SELECT sample, g, len, row_number() OVER (PARTITION BY sample, g ORDER BY count(*) DESC, len) AS k FROM b GROUP BY 1, 2, 3)
SELECT b.* FROM b JOIN m ON b.sample = m.sample AND b.g IS NOT DISTINCT FROM m.g AND b.len = m.len WHERE k = 1""",
    "translate_nt": f"WITH {CONTIGS_SQL}, c AS (SELECT DISTINCT junction, {CODONS_SQL} AS codons FROM contigs WHERE junction IS NOT NULL) SELECT junction, {aa_sql('junction')} AS aa FROM c",
    "junction": f"WITH {TIDY_SQL} SELECT sample, sequence_id, substr(seq, v_len - 2, length(cdr3) + 6) AS cut, cdr3, substr(junction_aa, 2, greatest(0, length(junction_aa) - 2)) AS cdr3_aa FROM tidy",
    "v_identity": f"WITH {TIDY_SQL} SELECT sample, sequence_id, round((v_len - hamming(substr(seq, 1, v_len), substr(germline, 1, v_len))) * 100.0 / v_len, 9) AS v_identity FROM tidy",
    "pairwise_identity": f"WITH {TIDY_SQL} SELECT sample, sequence_id, round((length(seq) - hamming(seq, germline)) / length(seq), 9) AS identity FROM tidy",
    "stereotype_rules": f"""WITH {CONTIGS_SQL}, b AS (SELECT sample, sequence_id, {GENES_SQL} AS genes, junction_aa, upper(trim(productive)) IN ('T', 'TRUE') AS ok, CASE WHEN length(junction_aa) > 2 THEN substr(junction_aa, 2, length(junction_aa) - 2) ELSE '' END AS c FROM contigs)
SELECT sample, sequence_id, CASE WHEN NOT coalesce(ok, false) OR coalesce(len(genes), 0) = 0 OR len(list_filter(genes, lambda g: NOT contains(g, 'IGH'))) > 0 OR coalesce(junction_aa, '') = '' THEN 'NA' {rules_sql()} ELSE 'Unassigned' END AS subset FROM b""",
    "r110": f"WITH {CONTIGS_SQL} SELECT sample, sequence_id, CASE WHEN upper(replace(string_split(string_split(v_call, '/')[1], '*')[1], ' ', '')) = 'IGLV3-21' AND ends_with(junction, 'C') THEN '[R110]' ELSE '' END AS mark FROM contigs WHERE v_call IS NOT NULL AND junction IS NOT NULL",
    "ags": f"""WITH {TIDY_SQL}, h AS (SELECT *, {CODONS_SQL} AS codons FROM tidy WHERE v_call LIKE 'IGH%'),
a AS (SELECT sample, sequence_id, {GENES_SQL} AS genes, {aa_sql('seq')} AS s, {aa_sql('germline')} AS q, length(fwr1) // 3 AS e1, length(fwr1) // 3 + length(cdr1) // 3 AS e2, length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 AS e3,
  length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 + length(cdr2) // 3 AS e4, length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 + length(cdr2) // 3 + length(fwr3) // 3 AS e5,
  length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 + length(cdr2) // 3 + length(fwr3) // 3 + length(cdr3) // 3 AS e6 FROM h),
p AS (SELECT *, list_filter(range(1, length(s) - 1), lambda i: regexp_matches(substr(s, i, 3), '^N[^P][TS]$') AND substr(s, i, 3) <> substr(q, i, 3)) AS hits FROM a),
t AS (SELECT *, list_transform(hits, lambda i: substr(s, i, 3) || ':' || CASE WHEN i + 2 <= e1 THEN 'FR1' WHEN i <= e2 THEN 'CDR1' WHEN i + 2 <= e3 THEN 'FR2' WHEN i <= e4 THEN 'CDR2' WHEN i + 2 <= e5 THEN 'FR3' WHEN i <= e6 THEN 'CDR3' ELSE 'FR4' END) AS sites FROM p)
SELECT sample, sequence_id, CASE WHEN len(sites) > 0 AND len(list_filter(genes, lambda g: NOT contains(g, 'IGH'))) = 0 THEN '[' || CASE WHEN contains(array_to_string(sites, ';'), ':CDR') THEN 'CDR-AGS' ELSE 'FR-AGS' END || ' (' || array_to_string(sites, ';') || ')]' ELSE '' END AS mark FROM t""",
    "qc_rates": f"""WITH {_REPORT}, l AS (SELECT 'productive' AS flag, locus, ok AS sound FROM rep UNION ALL SELECT 'complete_vdj', locus, whole FROM rep UNION ALL SELECT 'stop_codon', locus, NOT stop FROM rep UNION ALL SELECT 'v_frameshift', locus, NOT shift FROM rep)
SELECT flag, locus, sound, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY flag, locus), 9) AS percent FROM l WHERE locus IN ('IGH', 'IGK', 'IGL') GROUP BY 1, 2, 3""",
    "qc_locus": f"WITH {CONTIGS_SQL} SELECT locus, count(*) AS n FROM contigs GROUP BY 1",
    "qc_scores_long": f"""WITH {_REPORT}, s AS (SELECT *, length(fwr1 || cdr1 || fwr2 || cdr2 || fwr3) AS v_len FROM rep)
SELECT sample, sequence_id, locus, 'v_score' AS gene, CAST(v_len - 2 * hamming(substr(seq, 1, v_len), substr(germline, 1, v_len)) AS DOUBLE) AS score FROM s UNION ALL SELECT sample, sequence_id, locus, 'd_score', round(length(cdr3) / 3, 9) FROM s WHERE length(cdr3) > 0 AND locus = 'IGH' UNION ALL SELECT sample, sequence_id, locus, 'j_score', CAST(length(fwr4) AS DOUBLE) FROM s""",
    "qc_clonality": f"""WITH {_REPORT}, n AS (SELECT locus, array_to_string({GENES_SQL}, ',') || '_' || CASE WHEN length(junction_aa) > 2 THEN substr(junction_aa, 2, length(junction_aa) - 2) ELSE '' END AS g, count(*) AS n FROM rep WHERE ok AND whole AND NOT stop AND NOT shift AND v_call IS NOT NULL AND junction_aa IS NOT NULL GROUP BY 1, 2),
p AS (SELECT locus, CASE WHEN n = 1 THEN 'Unique_' || coalesce(locus, 'NA') ELSE g END AS clonal_group, n = 1 AS single, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY 1, 2, 3)
SELECT locus, clonal_group, CASE WHEN single THEN clonal_group ELSE coalesce(locus, 'NA') || '.' || row_number() OVER (PARTITION BY locus, single ORDER BY n DESC, clonal_group) END AS clonal_id, n, round(n * 100.0 / (SELECT sum(n) FROM p), 9) AS percent FROM p""",
}

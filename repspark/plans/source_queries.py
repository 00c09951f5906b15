"""Queries of sources and sinks: the tables written in a format, read again by its reader; and of paired reads and tree inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.sequences import revcomp
from repspark.operators.airr import to_airr
from repspark.operators.reads import concat_pairs, merge_pairs
from repspark.operators.trees import fasta_text, tree_rows
from repspark.operators.wide import cells_wide
from repspark.plans.after_queries import NUMBERED_SQL, numbered_contigs
from repspark.plans.base import ALIGNED_SQL, CONTIGS_SQL, aligned, latest_contigs
from repspark.plans.domain_queries import BULKANN_SQL, SC_SQL, bulk_annotated, public_bulk, single_cell
from repspark.plans.domain_queries import ORACLE as DOMAIN_SQL
from repspark.plans.workflow import mission_bio_cells
from repspark.runtime import file_system, scratch
from repspark.sources.aligner import PATTERN, read_aligned, write_airr, write_annotated, write_missionbio
from repspark.sources.raw import read_fasta, read_fastq, read_table, write_fasta

KEY = ["sample", "sequence_id"]


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_contigs(spark, sf_dir, ["junction", "v_call", "locus", "n_reads"]).where(F.col("junction").isNotNull())


def _texts(df: DataFrame, value: Column, name: str) -> str:
    """Written as text files, a folder ``sample=<name>`` each."""
    path = scratch(df.sparkSession, name)
    df.select("sample", value.alias("value")).repartition("sample").write.partitionBy("sample").text(path)
    return path


def source_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA with a '>' inside headers, wrapped lines, and CRLF in a part of the records."""
    df = _contigs(spark, sf_dir)
    end = F.when(F.length("sequence_id") % 2 == 0, "\r\n").otherwise("\n")
    wrapped = F.regexp_replace("junction", "(.{20})", F.concat(F.lit("$1"), end))
    path = _texts(df, F.concat(F.lit(">"), "sequence_id", F.lit(" a > b"), end, wrapped), "fasta")
    got = read_fasta(spark, f"{path}/*")
    return got.select("sample", F.substring_index("sequence_id", " ", 1).alias("sequence_id"), F.col("sequence_id").endswith(" a > b").alias("whole_header"), "sequence")


def sink_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "fasta")
    write_fasta(_contigs(spark, sf_dir).select(*KEY, F.col("junction").alias("sequence")).repartition("sample"), path)
    return read_fasta(spark, f"{path}/*")


def source_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ whose third line repeats the id in a part of the records."""
    third = F.when(F.length("sequence_id") % 2 == 0, F.concat(F.lit("+"), F.col("sequence_id"))).otherwise("+")
    value = F.concat_ws("\n", F.concat(F.lit("@"), "sequence_id"), "junction", third, F.translate("junction", "ACGT", "@+I#"))
    return read_fastq(spark, f"{_texts(_contigs(spark, sf_dir), value, 'fastq')}/*")


def _table(df: DataFrame, sep: str, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.repartition("sample").write.partitionBy("sample").options(header=True, sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return f"{path}/*"


def source_mixcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clone tables with numeric ids, sequences with commas, counts as decimals; bulk."""
    df = _contigs(spark, sf_dir).where(F.col("n_reads").isNotNull() & F.col("v_call").isNotNull())
    number = F.regexp_extract("sequence_id", "^read([0-9]+)", 1)
    ident = F.when(number != "", number).otherwise(F.col("sequence_id"))
    rows = df.select("sample", ident.alias("cloneId"), F.col("n_reads").cast("double").alias("cloneCount"), F.regexp_replace("junction", "(.{10})", "$1,").alias("targetSequences"), F.concat(F.trim("v_call"), F.lit("(99)")).alias("allVHitsWithScore"))
    return read_table(spark, _table(rows, "\t", "mixcr"), "mixcr", "bulk")


def source_airr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rearrangement tables: rows of other loci are left out, bulk ids get their count."""
    df = _contigs(spark, sf_dir).select("sample", "sequence_id", F.col("junction").alias("sequence"), F.when(F.length("junction") % 7 == 0, "TRB").otherwise(F.col("locus")).alias("locus"), F.coalesce("n_reads", F.lit(1)).alias("consensus_count"))
    path = _table(df, "\t", "airr")
    return read_table(spark, path, "AIRR", "bulk").withColumn("kind", F.lit("bulk")).unionByName(read_table(spark, path, "trust4").withColumn("kind", F.lit("single_cell")))


def source_10x_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig tables whose sequence stands in seven region columns, some of them empty."""
    names = ["fwr1_nt", "cdr1_nt", "fwr2_nt", "cdr2_nt", "fwr3_nt", "cdr3_nt", "fwr4_nt"]
    parts = [F.substring("junction", 1 + 5 * i, 5).alias(n) for i, n in enumerate(names[:6])] + [F.substring("junction", 31, 10_000).alias("fwr4_nt")]
    df = _contigs(spark, sf_dir).select("sample", F.col("sequence_id").alias("contig_id"), *parts)
    return read_table(spark, _table(df, ",", "csv"), "10xbcr_csv")


def source_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligner files of one sample each, read alone (unit = sample) and jointly (unit = case)."""
    df = aligned(spark, sf_dir).drop("unit", "locus")
    path = scratch(spark, "aligned")
    df.withColumn("c_call", F.col("c_call")).repartition("sample").write.partitionBy("sample").option("header", True).option("sep", "\t").csv(path)
    fs, folder = file_system(spark, path)
    _, flat = file_system(spark, f"{path}-flat")
    fs.mkdirs(flat)
    names = []
    for d in fs.listStatus(folder):
        if d.isDirectory():
            sample = d.getPath().getName().split("=", 1)[1]
            names.append(sample)
            for f in fs.listStatus(d.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), file_system(spark, f"{path}-flat/{sample}{PATTERN}")[1])
    alone = read_aligned(spark, f"{path}-flat")
    joint = read_aligned(spark, f"{path}-flat", cases={s: s[:3] for s in names})
    show = [*KEY, "unit", "cdr3", "germline_alignment", "junction_aa_length"]
    return alone.select(*show, F.lit("single").alias("mode")).unionByName(joint.select(*show, F.lit("joint").alias("mode")))


def sink_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated table as TSV, a folder per sample."""
    path = scratch(spark, "annotated")
    df = single_cell(spark, sf_dir).select("SampleID", "record_id", "ClonotypeID", "VDJ_genes", "Junction_aa")
    write_annotated(df.repartition("SampleID"), path, "tsv")
    return spark.read.option("header", True).option("sep", "\t").schema("record_id bigint, ClonotypeID string, VDJ_genes string, Junction_aa string, SampleID string").csv(path)


def sink_airr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rearrangement table as TSV: a few of its fields as they are read again."""
    path = scratch(spark, "airr-tsv")
    write_airr(to_airr(public_bulk(spark, sf_dir)), path)
    got = spark.read.option("header", True).option("sep", "\t").csv(path)
    return got.select("sequence_id", "sample_id", "sequence_alignment", "cdr3", F.col("cdr3_start").cast("int").alias("cdr3_start"), F.col("duplicate_count").cast("bigint").alias("duplicate_count"))


def sink_missionbio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-barcode table as TSV: unsupported cells are rows without chains."""
    contigs = numbered_contigs(spark, sf_dir)
    path = scratch(spark, "per-barcode")
    write_missionbio(mission_bio_cells(contigs, contigs.select("SampleID", "barcode").distinct()), path)
    got = spark.read.option("header", True).option("sep", "\t").csv(path)
    return got.select("SampleID", "barcode", "completeBCR", "IGH1_ClonotypeID", "IGH2_ClonotypeID", "IGL1_ClonotypeID", "IGL2_ClonotypeID")


def reads_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _contigs(spark, sf_dir)
    one = df.select(*KEY, F.substring("junction", 1, 12).alias("sequence"))
    two = df.select(*KEY, revcomp(F.substring(F.col("junction"), F.lit(16), F.lit(10_000))).alias("sequence"))
    return concat_pairs(one, two, KEY).select(*KEY, "sequence")


def reads_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that overlap by 12 bases; those of shorter sequences stay apart."""
    df = _contigs(spark, sf_dir).where(F.length("junction") >= 15)
    cut = F.floor(F.length("junction") / 2).cast("int")
    one = df.select(*KEY, F.substring(F.col("junction"), F.lit(1), F.least(cut + 12, F.length("junction"))).alias("sequence"))
    two = df.select(*KEY, revcomp(F.substring(F.col("junction"), cut + 1, F.lit(10_000))).alias("sequence"))
    got = merge_pairs(one, two, KEY, 12, 12, 0.0)
    return got.select(*KEY, "sequence", "merged")


def _tree_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with chain slots; the CDR3 stands for the sequence, and the V gene's name for the germline."""
    rows = numbered_contigs(spark, sf_dir)
    text = single_cell(spark, sf_dir).select("record_id", F.coalesce("Junction_aa", F.lit("X")).alias("VDJ_sequence_correctedCDR3"), F.substring(F.coalesce("VDJ_genes", F.lit("X")), 1, 8).alias("Consensus_Germline"))
    full = rows.join(text, "record_id")
    slots = cells_wide(full, ["SubcloneID", "VDJ_sequence_correctedCDR3", "Consensus_Germline"], ["SampleID", "barcode"])
    own = rows.select("SampleID", "barcode", "completeBCR", "igClonotypeID_num", "igSubcloneID_in_Clonotype_num").distinct()
    return own.join(slots, ["SampleID", "barcode"])


def _tree(chain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tree_rows(_tree_cells(spark, sf_dir), "single_cell", chain)

    return run


def tree_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bulk_annotated(spark, sf_dir).select("SampleID", "ClonotypeID", F.col("SubcloneID").alias("SubcloneID_in_Clonotype"), F.concat("SubcloneID", F.lit("_1")).alias("contig_id"), "Subclone_nReads", F.coalesce("Junction_aa", F.lit("X")).alias("VDJ_sequence_correctedCDR3"), F.substring(F.coalesce("VDJ_genes", F.lit("X")), 1, 8).alias("Consensus_Germline"))
    return tree_rows(df, "bulk")


def tree_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records of every clone's tree."""
    return _tree("HL")(spark, sf_dir).select("SampleID", "clone", "subclone", fasta_text(F.col("subclone"), F.coalesce("sequence", F.lit(""))).alias("record"))


QUERIES = {
    "source_fasta": source_fasta, "sink_fasta": sink_fasta, "source_fastq": source_fastq, "source_mixcr": source_mixcr, "source_airr": source_airr, "source_10x_csv": source_10x_csv, "source_aligned": source_aligned, "sink_annotated": sink_annotated, "sink_airr": sink_airr,
    "sink_missionbio": sink_missionbio, "reads_concatenated": reads_concatenated, "reads_merged": reads_merged, "tree_hl": _tree("HL"), "tree_h": _tree("H"), "tree_l": _tree("L"), "tree_bulk": tree_bulk, "tree_fasta": tree_fasta,
}

_ALL = f"WITH {CONTIGS_SQL}, c AS (SELECT sample, sequence_id, junction, v_call, locus, n_reads FROM contigs WHERE junction IS NOT NULL)"
_SLOT = lambda s, c: f"max({c}) FILTER (slot = '{s}') AS {s}_{c}"
_CELLS = f"""WITH RECURSIVE {NUMBERED_SQL}, t0 AS (SELECT nc.*, coalesce(Junction_aa, 'X') AS q, substr(coalesce(VDJ_genes, 'X'), 1, 8) AS g, CASE WHEN substr(cid, 1, 3) = 'IGH' THEN 'IGH' WHEN substr(cid, 1, 3) IN ('IGK', 'IGL') THEN 'IGL' END AS kind FROM nc JOIN sc USING (record_id)),
t1 AS (SELECT *, kind || row_number() OVER (PARTITION BY unit, barcode, kind ORDER BY cid) AS slot FROM t0),
wide AS (SELECT unit, barcode, max(completeBCR) AS completeBCR, max(n1) AS n1, max(n4) AS n4, {', '.join(_SLOT(s, c) for s in ('IGH1', 'IGH2', 'IGL1', 'IGL2') for c in ('sub', 'q', 'g', 'cid'))} FROM t1 GROUP BY 1, 2)"""


def _tree_sql(chain: str) -> str:
    slots = {"HL": ["IGH1", "IGH2", "IGL1", "IGL2"], "H": ["IGH1", "IGH2"], "L": ["IGL1", "IGL2"]}[chain]
    name = "n4" if chain == "HL" else f"nullif(concat_ws('_', {', '.join(s + '_sub' for s in slots)}), '')"
    both = lambda c: " || ".join(f"coalesce({s}_{c}, '')" for s in slots)
    shown = "name" if chain == "HL" else "regexp_replace(name, '\\.CV[0-9]+\\.S[0-9]+', '', 'g') || '.' || row_number() OVER (PARTITION BY unit, clone ORDER BY name)"
    return f"""{_CELLS}, t AS (SELECT unit, n1 AS clone, {name} AS name, barcode, {both('q')} AS q, {both('g')} AS g FROM wide WHERE n1 IS NOT NULL AND completeBCR IN ({"'Yes'" if chain == 'HL' else "'Yes', 'Yes_rescue'"})),
s AS (SELECT unit, clone, name, count(*) AS n, string_agg(barcode, ':' ORDER BY barcode) AS members, arg_min(q, (barcode, q)) AS q FROM t WHERE name IS NOT NULL GROUP BY 1, 2, 3),
cl AS (SELECT unit, clone, min(g) AS germline, count(*) AS n FROM t WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
tree AS (SELECT s.unit AS SampleID, s.clone, {shown.replace('unit', 's.unit').replace('clone', 's.clone')} AS subclone, s.n AS abundance, members, q AS sequence, germline FROM s JOIN cl ON cl.unit = s.unit AND cl.clone = s.clone UNION ALL SELECT unit, clone, 'GL', 0, '', germline, germline FROM cl)"""


ORACLE = {
    "source_fasta": f"{_ALL} SELECT sample, sequence_id, true AS whole_header, junction AS sequence FROM c",
    "sink_fasta": f"{_ALL} SELECT sample, sequence_id, junction AS sequence FROM c",
    "source_fastq": f"{_ALL} SELECT sample, sequence_id, junction AS sequence FROM c",
    "source_mixcr": f"""{_ALL} SELECT sample, CASE WHEN regexp_extract(sequence_id, '^read([0-9]+)', 1) <> '' THEN sample || substr(trim(v_call) || '(99)', 1, 3) || '_' || regexp_extract(sequence_id, '^read([0-9]+)', 1) ELSE sequence_id END || '=' || n_reads AS sequence_id, junction AS sequence FROM c WHERE n_reads IS NOT NULL AND v_call IS NOT NULL""",
    "source_airr": f"{_ALL} SELECT sample, sequence_id || '=' || coalesce(n_reads, 1) AS sequence_id, junction AS sequence, 'bulk' AS kind FROM c WHERE length(junction) % 7 <> 0 AND locus IN ('IGH', 'IGK', 'IGL') UNION ALL SELECT sample, sequence_id, junction, 'single_cell' FROM c WHERE length(junction) % 7 <> 0 AND locus IN ('IGH', 'IGK', 'IGL')",
    "source_10x_csv": f"{_ALL} SELECT sample, sequence_id, junction AS sequence FROM c",
    "source_aligned": f"""WITH {ALIGNED_SQL} SELECT sample, sequence_id, CASE mode WHEN 'joint' THEN substr(sample, 1, 3) ELSE sample END AS unit, cdr3, germline AS germline_alignment, junction_aa_length, mode FROM aligned, (VALUES ('single'), ('joint')) m (mode)""",
    "sink_annotated": f"WITH {SC_SQL} SELECT SampleID, record_id, ClonotypeID, nullif(VDJ_genes, '') AS VDJ_genes, nullif(Junction_aa, '') AS Junction_aa FROM sc",
    "sink_airr": f"SELECT sequence_id, sample_id, sequence_alignment, cdr3, cdr3_start, duplicate_count FROM ({DOMAIN_SQL['airr_export']})",
    "sink_missionbio": f"{_CELLS} SELECT unit AS SampleID, barcode, completeBCR, {', '.join(f'''CASE WHEN completeBCR <> 'Not_supported' THEN {s}_cid END AS {s}_ClonotypeID''' for s in ('IGH1', 'IGH2', 'IGL1', 'IGL2'))} FROM wide",
    "reads_concatenated": f"{_ALL} SELECT sample, sequence_id, upper(substr(junction, 1, 12)) || upper(substr(junction, 16)) AS sequence FROM c",
    "reads_merged": f"""{_ALL}, p AS (SELECT sample, sequence_id, junction AS j, length(junction) // 2 AS k FROM c WHERE length(junction) >= 15) SELECT sample, sequence_id, CASE WHEN length(j) - k >= 12 THEN j ELSE j END AS sequence, length(j) - k >= 12 AS merged FROM p""",
    "tree_hl": f"{_tree_sql('HL')} SELECT * FROM tree", "tree_h": f"{_tree_sql('H')} SELECT * FROM tree", "tree_l": f"{_tree_sql('L')} SELECT * FROM tree",
    "tree_bulk": f"""WITH {BULKANN_SQL}, cl AS (SELECT SampleID, ClonotypeID, min(substr(coalesce(VDJ_genes, 'X'), 1, 8)) AS germline FROM rws GROUP BY 1, 2 HAVING count(*) > 1),
s AS (SELECT SampleID, ClonotypeID, SubcloneID, CAST(sum(r) AS BIGINT) AS n, string_agg(SubcloneID, ':') AS members, min(coalesce(Junction_aa, 'X')) AS q FROM rws GROUP BY 1, 2, 3)
SELECT SampleID, ClonotypeID AS clone, SubcloneID AS subclone, n AS abundance, members, q AS sequence, germline FROM s JOIN cl USING (SampleID, ClonotypeID) UNION ALL SELECT SampleID, ClonotypeID, 'GL', 0, '', germline, germline FROM cl""",
    "tree_fasta": f"{_tree_sql('HL')} SELECT SampleID, clone, subclone, '>' || CASE WHEN length(subclone) < 9 THEN rpad(subclone, 9, ' ') ELSE subclone END || chr(10) || coalesce(sequence, '') AS record FROM tree",
}

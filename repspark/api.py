"""The public operations in one place."""

from repspark.config import AnnotateConfig
from repspark.operators.airr import to_airr
from repspark.operators.contamination import flag_bulk, flag_cells, flag_tags, keep_passed
from repspark.operators.recalc import recalculate_bulk, recalculate_cells, recalculate_numbers, rescue_single_chains
from repspark.operators.report import clonality, flag_rates, locus_counts, scores_long
from repspark.operators.trees import write_bundle
from repspark.plans.annotate import annotate
from repspark.plans.workflow import annotate_folder, combine, full_workflow, mission_bio_cells, recalculate, remove_contaminated_cells, remove_contamination, rescue_contigs
from repspark.sources.aligner import read_aligned, run_aligner, split_by_sample, write_airr, write_annotated
from repspark.sources.raw import read_fasta, read_fastq, read_table, write_fasta

__all__ = [
    "AnnotateConfig", "annotate", "annotate_folder", "clonality", "combine", "flag_bulk", "flag_cells", "flag_rates", "flag_tags", "full_workflow", "keep_passed", "locus_counts", "mission_bio_cells", "read_aligned", "read_fasta", "read_fastq",
    "read_table", "recalculate", "recalculate_bulk", "recalculate_cells", "recalculate_numbers", "remove_contaminated_cells", "remove_contamination", "rescue_contigs", "rescue_single_chains", "run_aligner", "scores_long", "split_by_sample", "to_airr", "write_airr", "write_annotated", "write_bundle", "write_fasta",
]

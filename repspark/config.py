"""Parameters of the annotation, with their domains."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnnotateConfig:
    analysis_mode: str = "single"
    material_type: str = "rna"
    v_primer: str = "full_length"
    data_type: str = "single_cell"
    min_reads: int = 2
    hc_similarity_cutoff: float | str = 0.2
    hc_mode: str = "average"
    cdr3_mode: str = "nt"
    cdr3_InDel_correction_mode: str = "soft_filter"
    annotate_CLL_immGen: bool = False
    annotate_satellite_subsets: bool = True
    annotate_ags: bool = False
    rescue_single_chain: bool = False
    relaxed_rescue: bool = False
    #: Bulk rows of equal sequence are one within the unit, or (in joint mode) within each sample of it.
    dedupe_scope: str = "unit"

    def __post_init__(self) -> None:
        for name, allowed in (
            ("analysis_mode", ("single", "joint")), ("material_type", ("dna", "rna")), ("v_primer", ("full_length", "fr1", "fr2", "fr3", "missionbio")), ("data_type", ("single_cell", "bulk", "missionbio")),
            ("hc_mode", ("average", "complete", "single")), ("cdr3_mode", ("nt", "aa")), ("cdr3_InDel_correction_mode", ("soft_filter", "hard_filter", "no")),
            ("dedupe_scope", ("unit", "sample")),
        ):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        c = self.hc_similarity_cutoff
        if c != "automatic" and not (isinstance(c, (int, float)) and c <= 1):
            raise ValueError("hc_similarity_cutoff is a number up to 1 or 'automatic'")

    @property
    def primer(self) -> str:
        return {"single_cell": "full_length", "missionbio": "missionbio"}.get(self.data_type, self.v_primer)

"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, packing (see sourceloom/llm/pipeline.py)."""

from sourceloom.llm.pipeline import ORACLE_SQL, STAGES, decontaminated, near_dedup, packed, quality, run

__all__ = ["ORACLE_SQL", "STAGES", "decontaminated", "near_dedup", "packed", "quality", "run"]

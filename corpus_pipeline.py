"""The training-data pipeline over the table documents; its stages are in plait.llm.pipeline."""

from plait.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""The corpus pipeline: see STAGES. Part of the subpackage textatlas.llm."""

from textatlas.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

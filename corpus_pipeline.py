"""The corpus pipeline: STAGES, run() and ORACLE_SQL."""

from docmill.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

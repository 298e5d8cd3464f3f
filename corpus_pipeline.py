"""The corpus pipeline's stages, its SQL and ``run``; they live in ``lodestone.llm.pipeline``."""

from lodestone.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""The corpus pipeline's entry: ``STAGES``, ``run`` and ``ORACLE_SQL`` of ``tessera.llm.pipeline``."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

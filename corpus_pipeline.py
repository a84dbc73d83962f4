"""The corpus pipeline: five stages from raw documents to packed training sequences (``meterflow.llm.pipeline``)."""

from meterflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of documents.

The stages are in ``memlake.llm.stages``; each takes (spark, docs, sf_dir), is
written as Parquet and read again as the next one's docs.
"""

from memlake.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL cannot express the language model, SimHash windows or seeded draws; tests hold the stages against plain Python.
ORACLE_SQL = None

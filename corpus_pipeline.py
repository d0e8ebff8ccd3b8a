"""Corpus pipeline: toxicity, near duplicates, personal data, source mix, packing; each stage works on what the one before it kept."""

from __future__ import annotations

from inkwell.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL can express neither the trained classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None

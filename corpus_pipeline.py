"""A training corpus from raw documents: each stage works on all that the stage before it kept, written as Parquet and reread.

Defined results: documents that are NULL, empty or without a letter go with the first stage; rows with a NULL doc_id are
judged by their own text (language, benchmark passages) and neither lose lines nor count as copies; rows that repeat a
doc_id stay or go together in near dedup; an empty table gives an empty table; columns beside those of documents pass
through, whatever their names (without backticks), but for `text`, `ids`, `n_tokens` and `round_trip`, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.bpe import encoding_stage
from panelwright.llm.common import stored, table
from panelwright.llm.decontaminate import decontamination_stage
from panelwright.llm.langid import language_stage
from panelwright.llm.linededup import line_stage
from panelwright.llm.minhash import dedup_stage

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL expresses none of the stages on whole tables; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

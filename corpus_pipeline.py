"""A training corpus from the documents table: toxic documents go, one document of each near-duplicate
group stays, secrets are taken out of the texts, the sources are mixed to target weights, and what is
left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
the columns of the documents table. Nulls, empty tables and extra columns pass as each operator's
module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftsum.llm.bpe import stage_bpe
from driftsum.llm.minhash import stage_near_duplicates
from driftsum.llm.mixing import stage_mixing
from driftsum.llm.secrets import stage_secrets
from driftsum.llm.toxicity import stage_toxicity
from driftsum.session import materialize, table

STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("mixing", stage_mixing),
    ("bpe", stage_bpe),
]

#: The classifier of the first stage and the tokenizer of the last have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

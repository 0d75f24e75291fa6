"""Queries and SQL of this subpackage, as the entry module registers them."""

from __future__ import annotations

from driftsum.llm import licences, mixing, warc
from driftsum.llm.bpe import op9_bpe
from driftsum.llm.media import op7_media
from driftsum.llm.minhash import op1_minhash
from driftsum.llm.secrets import op3_secrets
from driftsum.llm.substring import op10_substring
from driftsum.llm.toxicity import op4_toxicity
from driftsum.llm.vectors import op8_vectors

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_warc": warc.op2_warc,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_licences": licences.op6_licences,
    "op7_media": op7_media,
    "op8_vectors": op8_vectors,
    "op9_bpe": op9_bpe,
    "op10_substring": op10_substring,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op5_mixing": mixing.SQL,
    "op6_licences": licences.oracle(),
}

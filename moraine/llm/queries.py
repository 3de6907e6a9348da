"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from .bpe import op6_bpe
from .embedding_dedup import op1_embedding_dedup
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import op9_exact_dedup
from .langid import op5_language_id
from .minhash import op3_minhash_dedup
from .mixing import op8_mixing
from .pii import op7_pii
from .token_counts import op2_token_counts
from .token_output import op10_token_output
from .url_filter import SQL as URL_SQL
from .url_filter import op4_url_filter

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_output": op10_token_output,
}
#: The others are beyond SQL (classifier, tokenizers, clustering) or tested against brute force in tests/llm.
ORACLE_SQL = {"op4_url_filter": URL_SQL, "op9_exact_dedup": EXACT_SQL}

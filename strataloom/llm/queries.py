"""The queries of this subpackage, by name."""

from __future__ import annotations

from .chunked_bpe import op4_bpe_round_trip
from .embedding_dedup import ORACLE as DEDUP_SQL
from .embedding_dedup import op1_embedding_dedup
from .heap_counts import op8_token_counts
from .language_filter import op10_language_id
from .order_minhash import op2_near_duplicates
from .packing import op3_packing
from .segment_topk import ORACLE as TOPK_SQL
from .segment_topk import op5_exact_topk
from .subword_quality import op9_quality
from .tiered_shards import op7_sharding
from .toxicity import op6_toxicity

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_exact_topk": op5_exact_topk,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
}

#: Most of these cannot be told in SQL: they are learned, tokenized, hashed or packed. Their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": DEDUP_SQL, "op5_exact_topk": TOPK_SQL}

"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe_codec import op4_bpe_codec
from .hnsw import op5_hnsw
from .language_id import op8_language_id
from .licenses import op7_license_scan
from .media import op2_media_columns
from .packing import op9_best_fit_packing
from .simhash import op10_simhash
from .token_counts import op6_token_counts
from .toxicity import op3_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_media_columns,
        op3_toxicity,
        op4_bpe_codec,
        op5_hnsw,
        op6_token_counts,
        op7_license_scan,
        op8_language_id,
        op9_best_fit_packing,
        op10_simhash,
    )
}
SQL: dict[str, str] = {"op1_warc": OP1_SQL}

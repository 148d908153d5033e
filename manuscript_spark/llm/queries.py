"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import licences, warc
from .bpe import op4_bpe
from .mixing import op6_mixing
from .neighbours import op9_neighbours
from .pii import op3_pii
from .quality import op7_quality
from .simhash import op8_simhash
from .token_counts import op2_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_warc": warc.op5_warc,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_neighbours": op9_neighbours,
    "op10_licences": licences.op10_licences,
}
SQL: dict[str, str] = {"op5_warc": warc.SQL, "op10_licences": licences.SQL}

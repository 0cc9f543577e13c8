"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .ann import op2_ann
from .chat_format import OP10_SQL, op10_chat_format
from .html_extract import op3_html_extract
from .media import op9_media_columns
from .minhash_dedup import op1_minhash_dedup
from .mixing import op6_mixing
from .packing import op5_packing
from .secrets import op4_secret_scan
from .sharding import op8_sharding
from .toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_minhash_dedup, op2_ann, op3_html_extract, op4_secret_scan, op5_packing, op6_mixing, op7_toxicity, op8_sharding, op9_media_columns, op10_chat_format)
}
ORACLE_SQL = {"op10_chat_format": OP10_SQL}

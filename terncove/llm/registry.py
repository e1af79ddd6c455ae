"""The subpackage's queries and their SQL."""

from .bpe import op4_bpe
from .chat_format import OP13_SQL, op13_chat_format
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .fill_middle import OP12_SQL, op12_fill_middle
from .filter_audit import OP11_SQL, op11_filter_audit
from .html_text import op9_html
from .mixing import op7_mixing
from .nearest import OP1_SQL, op1_nearest
from .sharding import op3_sharding
from .simhash import op2_simhash
from .token_counts import op5_token_counts
from .toxicity import op6_toxicity
from .window_index import OP10_SQL, op10_window_dedup

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_bpe": op4_bpe,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html": op9_html,
    "op10_window_dedup": op10_window_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_middle": op12_fill_middle,
    "op13_chat_format": op13_chat_format,
}
ORACLE_SQL = {
    "op1_nearest": OP1_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_window_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}

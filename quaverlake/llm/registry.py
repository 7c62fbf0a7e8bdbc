"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from .bpe_automaton import op7_bpe_automaton
from .bradley_terry import op3_bradley_terry
from .fm_index import OP12_SQL, op12_fm_index
from .minhash import op4_circulant_minhash
from .pfair import OP9_SQL, op9_pfair
from .rp_forest import op8_rp_forest
from .source_divergence import OP13_SQL, op13_divergence
from .substring_dedup import op5_substring_dedup
from .surrogates import op2_surrogates
from .tool_calls import op1_tool_calls
from .warc import op10_warc_salvage
from .webp import op6_lossless_webp
from .whitening import op11_whitening

QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_surrogates": op2_surrogates,
    "op3_bradley_terry": op3_bradley_terry,
    "op4_circulant_minhash": op4_circulant_minhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_lossless_webp": op6_lossless_webp,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_rp_forest": op8_rp_forest,
    "op9_pfair": op9_pfair,
    "op10_warc_salvage": op10_warc_salvage,
    "op11_whitening": op11_whitening,
    "op12_fm_index": op12_fm_index,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op9_pfair": OP9_SQL,
    "op12_fm_index": OP12_SQL,
    "op13_divergence": OP13_SQL,
}

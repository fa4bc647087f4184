"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .decision_list import op2_decision_list
from .divergence import OP13_SQL, op13_divergence
from .fingerprint import op11_fingerprint
from .line_dedup import OP6_SQL, op6_line_dedup
from .minhash import op8_minhash
from .mining import OP12_SQL, op12_hard_negatives
from .packing import op10_packing
from .rule_ensemble import op1_rule_ensemble
from .spherical import op9_spherical
from .unigram import op5_count_viterbi, op7_streaming_viterbi
from .url_equivalence import OP4_SQL, op4_url_equivalence
from .warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_rule_ensemble, op2_decision_list, op3_warc, op4_url_equivalence, op5_count_viterbi, op6_line_dedup,
        op7_streaming_viterbi, op8_minhash, op9_spherical, op10_packing, op11_fingerprint, op12_hard_negatives, op13_divergence,
    )
}
ORACLES = {"op3_warc": OP3_SQL, "op4_url_equivalence": OP4_SQL, "op6_line_dedup": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_divergence": OP13_SQL}

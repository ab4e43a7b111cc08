"""The queries of this subpackage and, where SQL can say it, what DuckDB must return."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroid_clusters
from .conversations import op13_conversation_repair
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .licenses import op8_license_scan
from .line_dedup import OP4_SQL, op4_line_dedup
from .masked_lm import op3_masked_likelihood
from .minhash import OP10_SQL, op10_minhash_near_dedup
from .mixing import OP5_SQL, op5_source_mixing
from .neighbours import op7_neighbours
from .packing import op9_packing
from .quality_rules import op12_quality_rules
from .secrets import OP2_SQL, op2_secret_ownership
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_masked_likelihood": op3_masked_likelihood,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL = {
    "op2_secret_ownership": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op11_centroid_clusters": OP11_SQL,
}

"""The queries of this folder's operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import neardup, secrets, topk
from .ann import op8_ann
from .bpe import op2_bpe
from .extract import op6_extract
from .licenses import op7_licenses
from .mixing import op10_mixing
from .pseudo import op4_pseudo_likelihood
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_neardup": neardup.op3_neardup,
    "op4_pseudo_likelihood": op4_pseudo_likelihood,
    "op5_secrets": secrets.op5_secrets,
    "op6_extract": op6_extract,
    "op7_licenses": op7_licenses,
    "op8_ann": op8_ann,
    "op9_topk": topk.op9_topk,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_neardup": neardup.SQL, "op5_secrets": secrets.SQL, "op9_topk": topk.SQL}

"""The corpus operators' queries, one for each operator, over their whole tables."""

from __future__ import annotations

from .decontaminate import op10_qgram_bands
from .html_extract import op8_html_blocks
from .mixing import op7_mix_schedule
from .pii import op2_pii_skip_chain
from .quality_prior import op9_quality_bayes
from .quality_rules import OP5_SQL, op5_quality_ledger
from .quoting import OP6_SQL, op6_quotation_links
from .simhash import op4_simhash_pigeonring
from .token_output import op1_token_files
from .toxicity import op3_toxicity_counterfactual

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_pii_skip_chain": op2_pii_skip_chain,
    "op3_toxicity_counterfactual": op3_toxicity_counterfactual,
    "op4_simhash_pigeonring": op4_simhash_pigeonring,
    "op5_quality_ledger": op5_quality_ledger,
    "op6_quotation_links": op6_quotation_links,
    "op7_mix_schedule": op7_mix_schedule,
    "op8_html_blocks": op8_html_blocks,
    "op9_quality_bayes": op9_quality_bayes,
    "op10_qgram_bands": op10_qgram_bands,
}

ORACLES: dict[str, str] = {
    "op5_quality_ledger": OP5_SQL,
    "op6_quotation_links": OP6_SQL,
}

"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from tracewell.llm import chat, divergence, lexical, url_templates
from tracewell.llm.ann import op8_ann
from tracewell.llm.decontam import op2_decontamination
from tracewell.llm.divergence import op11_source_divergence
from tracewell.llm.lexical import op13_lexical_search
from tracewell.llm.mixing import op1_mixing
from tracewell.llm.quality import op5_quality
from tracewell.llm.secrets import op7_secret_scan
from tracewell.llm.sharding import op9_sharding
from tracewell.llm.simhash_dedup import op10_simhash_dedup
from tracewell.llm.suffix_dedup import op6_suffix_dedup
from tracewell.llm.token_output import op12_token_output

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": chat.op3_chat_format,
    "op4_url_filter": url_templates.op4_url_filter,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_ann": op8_ann,
    "op9_sharding": op9_sharding,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_token_output": op12_token_output,
    "op13_lexical_search": op13_lexical_search,
}
#: DuckDB SQL where it can express the operator; the others are tested against brute force.
ORACLES: dict[str, str] = {"op3_chat_format": chat.oracle(), "op4_url_filter": url_templates.oracle(), "op11_source_divergence": divergence.oracle(), "op13_lexical_search": lexical.oracle()}

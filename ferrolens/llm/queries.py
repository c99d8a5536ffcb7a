"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from ferrolens.llm.bpe import op8_bpe
from ferrolens.llm.decontamination import op1_decontamination
from ferrolens.llm.infill import op13_infill
from ferrolens.llm.jaccardjoin import op2_jaccardjoin
from ferrolens.llm.licenses import op10_licenses
from ferrolens.llm.media import op7_media
from ferrolens.llm.oracles import SQL
from ferrolens.llm.pages import op4_pages
from ferrolens.llm.quality import op6_quality
from ferrolens.llm.suffixdedup import op3_suffixdedup
from ferrolens.llm.suffixtree import op9_suffixtree
from ferrolens.llm.tokencounts import op12_counts
from ferrolens.llm.toxicity import op5_toxicity
from ferrolens.llm.vectorcodes import op11_vectorcodes

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_jaccardjoin": op2_jaccardjoin,
    "op3_suffixdedup": op3_suffixdedup,
    "op4_pages": op4_pages,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_media": op7_media,
    "op8_bpe": op8_bpe,
    "op9_suffixtree": op9_suffixtree,
    "op10_licenses": op10_licenses,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_counts": op12_counts,
    "op13_infill": op13_infill,
}

__all__ = ["QUERIES", "SQL"]

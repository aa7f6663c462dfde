"""The operators' queries and their check SQL."""

from __future__ import annotations

from reelgrid.llm.alignment import op11_alignment
from reelgrid.llm.language_model import op7_language_model
from reelgrid.llm.merkle import OP13_SQL, op13_merkle_manifest
from reelgrid.llm.neighbours import op9_neighbours
from reelgrid.llm.packing import op5_packing
from reelgrid.llm.quality import op4_quality
from reelgrid.llm.sentencepieces import op1_sentencepiece
from reelgrid.llm.simhash import op2_simhash
from reelgrid.llm.token_counts import op6_token_counts
from reelgrid.llm.topk import OP8_SQL, op8_exact_topk
from reelgrid.llm.toxicity import op10_toxicity
from reelgrid.llm.urls import OP3_SQL, op3_url_filter
from reelgrid.llm.warc import OP12_SQL, op12_warc

QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_simhash, op3_url_filter, op4_quality, op5_packing, op6_token_counts,
    op7_language_model, op8_exact_topk, op9_neighbours, op10_toxicity,
    op11_alignment, op12_warc, op13_merkle_manifest)}
SQL = {"op3_url_filter": OP3_SQL, "op8_exact_topk": OP8_SQL,
       "op12_warc": OP12_SQL, "op13_merkle_manifest": OP13_SQL}

"""The queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from gridloom.llm import eliasfano, packing, pieces, pii, quality, simhash, topk, toxicity, urlfilter, warc

QUERIES = {
    "op1_curve_packing": packing.op1,
    "op2_elias_fano_ids": eliasfano.op2,
    "op3_impact_topk": topk.op3,
    "op4_batched_viterbi": pieces.op4,
    "op5_dictionary_warc": warc.op5,
    "op6_simhash_blocks": simhash.op6,
    "op7_toxicity_compression": toxicity.op7,
    "op8_semi_markov_pii": pii.op8,
    "op9_url_filters": urlfilter.op9,
    "op10_quality_outliers": quality.op10,
}

ORACLE_SQL: dict[str, str] = {"op3_impact_topk": topk.OP3_SQL, "op5_dictionary_warc": warc.OP5_SQL, "op9_url_filters": urlfilter.OP9_SQL}

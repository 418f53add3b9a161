"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ctw, decontaminate, fingerprint, jaccard, langid, mixing, records, repeats, ring, search, simhash, toxicity

QUERIES = {
    "op1_mix": mixing.op1,
    "op2_language": langid.op2,
    "op3_context_tree": ctw.op3,
    "op4_token_records": records.op4,
    "op5_fingerprint": fingerprint.op5,
    "op6_toxicity": toxicity.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_shard": ring.op8,
    "op9_simhash": simhash.op9,
    "op10_token_lengths": records.op10,
    "op11_search": search.op11,
    "op12_periodic_runs": repeats.op12,
    "op13_jaccard_join": jaccard.op13,
}

ORACLES: dict[str, str] = {"op1_mix": mixing.OP1_SQL, "op11_search": search.OP11_SQL, "op12_periodic_runs": repeats.OP12_SQL, "op13_jaccard_join": jaccard.OP13_SQL}

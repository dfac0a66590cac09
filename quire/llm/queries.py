"""Registered queries of the corpus operators and their SQL."""
from __future__ import annotations

from . import (dedup, langid, licenses, maxent, merkle, packing, pii, quality, ranked, secrets, sentencepiece_fst,
               simhash, toxicity)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_sentencepiece_fst": sentencepiece_fst.op3_sentencepiece_fst,
    "op4_exact_dedup": dedup.op4_exact_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_language_id": langid.op8_language_id,
    "op9_pii": pii.op9_pii,
    "op10_lm_scoring": maxent.op10_lm_scoring,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_ranked_search": ranked.op13_ranked_search,
}
SQL = {"op4_exact_dedup": dedup.OP4_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op13_ranked_search": ranked.OP13_SQL}

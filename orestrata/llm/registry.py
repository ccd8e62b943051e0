"""Queries of the training-data operators and the SQL that restates them."""

from __future__ import annotations

from orestrata.llm import alignment, ann, conversations, htmltext, langid, licenses, mixing, packing, quality, repeats, simhash, toxicity, urls


def queries():
    return {
        "op1_sainte_lague_mix": mixing.op1_sainte_lague_mix,
        "op2_simhash_bk_tree": simhash.op2_simhash_bk_tree,
        "op3_line_frequency": quality.op3_line_frequency,
        "op4_anisotropic_search": ann.op4_anisotropic_search,
        "op5_toxicity_lexicon": toxicity.op5_toxicity_lexicon,
        "op6_language_ecoc": langid.op6_language_ecoc,
        "op7_exact_complement_packing": packing.op7_exact_complement_packing,
        "op8_dom_boosted_trees": htmltext.op8_dom_boosted_trees,
        "op9_host_reputation": urls.op9_host_reputation,
        "op10_license_digest": licenses.op10_license_digest,
        "op11_relational_alignment": alignment.op11_relational_alignment,
        "op12_suffix_array_dedup": repeats.op12_suffix_array_dedup,
        "op13_retained_subsequence_repair": conversations.op13_retained_subsequence_repair,
    }


def oracle_sql():
    """Only where SQL can restate the operator; the others are held against brute force in the tests."""
    return {
        "op1_sainte_lague_mix": mixing.OP1_SQL,
        "op3_line_frequency": quality.OP3_SQL,
        "op9_host_reputation": urls.OP9_SQL,
        "op10_license_digest": licenses.OP10_SQL,
        "op12_suffix_array_dedup": repeats.OP12_SQL,
    }

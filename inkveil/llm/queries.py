"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

from __future__ import annotations

from inkveil.llm import bitsliced, divergence, formatting, jaccard, kmtree, langid, licenses, mixing, pii, repair, secret_scan
from inkveil.llm.bpe import encoding_of_documents
from inkveil.llm.quality import quality_of_documents

QUERIES = {
    "op1_quality": quality_of_documents,
    "op2_topk": bitsliced.topk_of_embeddings,
    "op3_licenses": licenses.licenses_of_documents,
    "op4_mixing": mixing.mix_of_documents,
    "op5_ann": kmtree.neighbours_of_embeddings,
    "op6_langid": langid.languages_of_documents,
    "op7_secrets": secret_scan.secrets_of_documents,
    "op8_bpe": encoding_of_documents,
    "op9_jaccard": jaccard.components_of_documents,
    "op10_pii": pii.private_data_of_documents,
    "op11_divergence": divergence.divergence_of_documents,
    "op12_repair": repair.repair_of_conversations,
    "op13_formatting": formatting.formats_of_conversations,
}

ORACLES: dict[str, str] = {
    "op2_topk": bitsliced.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op9_jaccard": jaccard.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op12_repair": repair.ORACLE,
    "op13_formatting": formatting.ORACLE,
}

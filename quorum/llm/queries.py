"""The registered queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from quorum.llm import alignment, bpe, conversation_repair, exact_dedup, html_extract, id_files, lm, minhash, packing, pii, quality, secret_scan, sharding

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_sharding": sharding.op2_sharding,
    "op3_lm_score": lm.op3_lm_score,
    "op4_bpe": bpe.op4_bpe,
    "op5_id_files": id_files.op5_id_files,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_html": html_extract.op8_html,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_minhash": minhash.op10_minhash,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_minhash": minhash.ORACLE,
}

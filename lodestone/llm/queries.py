"""The queries and SQL of this subpackage, as __spark_entry__.py registers them."""

from __future__ import annotations

from lodestone.llm import bottom_k, bpe_automaton, html_diff, lattice, mixing, quality, repeats, secret_scan, sharding, toxicity

QUERIES = {
    "op1_html_diff": html_diff.op1,
    "op2_quality_llr": quality.op2,
    "op3_toxicity_gru": toxicity.op3,
    "op4_pfair_mix": mixing.op4,
    "op5_shard_table": sharding.op5,
    "op6_bpe_automaton": bpe_automaton.op6,
    "op7_secret_entropy": secret_scan.op7,
    "op8_repeat_tree": repeats.op8,
    "op9_bottom_k": bottom_k.op9,
    "op10_lattice": lattice.op10,
}
ORACLES: dict[str, str] = {
    "op4_pfair_mix": mixing.ORACLE,
    "op5_shard_table": sharding.ORACLE,
}

"""The subpackage's queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tilework.llm import bitplanes, density, fixity, hilbert, manifest, minhash, mixing, paragraphs, quality, spans, toxicity, transport, variants

QUERIES = {
    "op1_line_quality": quality.query,
    "op2_deobfuscated_toxicity": toxicity.query,
    "op3_pareto_mix": mixing.query,
    "op4_tensored_minhash": minhash.query,
    "op5_transport_streams": transport.query,
    "op6_bit_planes": bitplanes.query,
    "op7_piece_offsets": spans.query,
    "op8_merkle_fixity": fixity.query,
    "op9_paragraph_banding": paragraphs.query,
    "op10_text_density": density.query,
    "op11_spelling_variants": variants.query,
    "op12_merkle_manifest": manifest.query,
    "op13_hilbert_shards": hilbert.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_line_quality": quality.ORACLE,
    "op3_pareto_mix": mixing.ORACLE,
    "op4_tensored_minhash": minhash.ORACLE,
    "op11_spelling_variants": variants.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_hilbert_shards": hilbert.ORACLE,
}

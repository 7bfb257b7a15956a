"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import bpe, interaction, mincut, pii, quality, rangecoder, repair, secrets, simhash, suffixes, toxicity, warc, winnowing

QUERIES = {
    "op1_range_coder": rangecoder.op1,
    "op2_credential_linking": secrets.op2,
    "op3_bpe": bpe.op3,
    "op4_minimum_cut": mincut.op4,
    "op5_simhash": simhash.op5,
    "op6_winnowing": winnowing.op6,
    "op7_suffix_family": suffixes.op7,
    "op8_quality_rules": quality.op8,
    "op9_surrogates": pii.op9,
    "op10_warc_archive": warc.op10,
    "op11_interaction": interaction.op11,
    "op12_earley_repair": repair.op12,
    "op13_toxic_segments": toxicity.op13,
}
ORACLE_SQL = {
    "op6_winnowing": winnowing.SQL,
    "op7_suffix_family": suffixes.SQL,
    "op8_quality_rules": quality.SQL,
    "op10_warc_archive": warc.SQL,
    "op11_interaction": interaction.SQL,
    "op12_earley_repair": repair.SQL,
}

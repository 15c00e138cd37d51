"""Queries of the numbered operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from bidlens.llm import alignment, archives, bpe, exact, mixing, pii, quality, secrets, sharding, simhash, substrings, vectors, whitening


def queries() -> dict[str, Callable]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_pii_skip_chain": pii.op2_pii_skip_chain,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_mixing": mixing.op4_mixing,
        "op5_substring_dedup": substrings.op5_substring_dedup,
        "op6_simhash": simhash.op6_simhash,
        "op7_warc": archives.op7_warc,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_sharding": sharding.op9_sharding,
        "op10_embedding_graph": vectors.op10_embedding_graph,
        "op11_alignment": alignment.op11_alignment,
        "op12_exact_dedup": exact.op12_exact_dedup,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": mixing.OP4_SQL,
        "op5_substring_dedup": substrings.OP5_SQL,
        "op7_warc": archives.OP7_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op10_embedding_graph": vectors.OP10_SQL,
        "op12_exact_dedup": exact.OP12_SQL,
    }

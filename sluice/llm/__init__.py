"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sluice.llm import exact_dedup, fingerprints, lm, mixing, packing, secret_scan, sharding, token_store, toxicity, trie_join

    return {
        "op1_kneser_ney": lm.query,
        "op2_token_store": token_store.query,
        "op3_subsequence_kernel": toxicity.query,
        "op4_secret_forest": secret_scan.query,
        "op5_trie_join": trie_join.query,
        "op6_prefix_hashes": fingerprints.query,
        "op7_rendezvous_shards": sharding.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_best_fit_packing": packing.query,
        "op10_raked_mixture": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    from sluice.llm import exact_dedup, mixing, trie_join

    return {"op8_exact_dedup": exact_dedup.ORACLE, "op10_raked_mixture": mixing.oracle(), "op5_trie_join": trie_join.ORACLE}

"""The queries of this package and their DuckDB equivalents."""

from __future__ import annotations

from quarrylens.llm import (
    alignment,
    decontamination,
    merkle,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    sharding,
    simhash,
    substring_automata,
    suffix_array,
    surrogates,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_shard_slots": sharding.op1_shard_slots,
        "op2_rule_ledger": quality_rules.op2_rule_ledger,
        "op3_winnowing": decontamination.op3_winnowing,
        "op4_pareto_mix": mixing.op4_pareto_mix,
        "op5_toxic_lexicon": toxicity.op5_toxic_lexicon,
        "op6_suffix_columns": suffix_array.op6_suffix_columns,
        "op7_suffix_automata": substring_automata.op7_suffix_automata,
        "op8_secret_owners": secret_scan.op8_secret_owners,
        "op9_simhash_golay": simhash.op9_simhash_golay,
        "op10_surrogates": surrogates.op10_surrogates,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_best_fit_packing": packing.op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_rule_ledger": quality_rules.OP2_SQL,
        "op3_winnowing": decontamination.OP3_SQL,
        "op4_pareto_mix": mixing.OP4_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
    }

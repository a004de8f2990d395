"""One query for each operator of the subpackage, over its whole table, and two summaries of operator 3.

Operators 2, 4, 6 and 10 to 13 have SQL twins; the tests hold the others against brute force, a round trip or held-out
labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phylomill.llm import automaton_dedup, decontaminate, embedding_forest, importance, line_dedup, near_dedup, oracles, quality_classifier, quality_rules, sentencepieces, spelling, suffix_dedup, surrogates, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_token_counts": token_counts.op3_token_counts,
        "token_limits": token_counts.context_limits,
        "token_quantiles": token_counts.length_quantiles,
        "op4_automaton_dedup": automaton_dedup.op4_automaton_dedup,
        "op5_surrogates": surrogates.op5_surrogates,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_quality_classifier": quality_classifier.op7_quality_classifier,
        "op8_sentencepiece": sentencepieces.op8_sentencepiece,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_embedding_near_dedup": embedding_forest.op11_embedding_near_dedup,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_importance_resampling": importance.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": oracles.OP2, "op4_automaton_dedup": oracles.OP4, "op6_near_dedup": oracles.OP6, "op10_quality_rules": oracles.OP10, "op11_embedding_near_dedup": oracles.OP11, "op12_spelling_variants": oracles.OP12, "op13_importance_resampling": oracles.OP13}

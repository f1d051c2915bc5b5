"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heliospark.llm import centroids, cover_tree, decontaminate, hard_negatives, jaccard_join, kneser_ney, lm_score, oracles, packing, pii, quality_rules, secrets, token_counts, url_filter
from heliospark.llm.shared import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": lambda s, d: jaccard_join.report(table(s, d, "documents")),
        "op2_secrets": lambda s, d: secrets.report(table(s, d, "documents")),
        "op3_url_filter": lambda s, d: url_filter.report(table(s, d, "pages"), table(s, d, "labels")),
        "op4_decontaminate": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op5_token_counts": lambda s, d: token_counts.count_tokens(table(s, d, "documents"), public_tokenizers.path("piece_bpe_32k.model")),
        "op6_lm_score": lambda s, d: lm_score.score(table(s, d, "documents")),
        "op7_quality_rules": lambda s, d: quality_rules.report(table(s, d, "documents")),
        "op8_pack": lambda s, d: packing.pack(table(s, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")),
        "op9_kneser_ney": lambda s, d: kneser_ney.report(table(s, d, "documents"), table(s, d, "labels")),
        "op10_pii": lambda s, d: pii.report(table(s, d, "documents")),
        "op11_centroids": lambda s, d: centroids.report(table(s, d, "embeddings")),
        "op12_cover_tree": lambda s, d: cover_tree.report(table(s, d, "embeddings")),
        "op13_hard_negatives": lambda s, d: hard_negatives.report(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    """The other queries hold fitted models, spans of a lexer or a field, or a packing."""
    return {"op1_jaccard_join": oracles.OP1, "op3_url_filter": oracles.OP3, "op4_decontaminate": oracles.OP4, "op7_quality_rules": oracles.OP7, "op11_centroids": oracles.OP11, "op12_cover_tree": oracles.OP12, "op13_hard_negatives": oracles.OP13}

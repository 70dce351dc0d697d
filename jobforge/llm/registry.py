"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from jobforge.llm import bpe, history, near_dup, packing, pii, quantile_sketch, toxicity


def queries() -> dict:
    return {
        "p1_found": history.found,
        "p3_percentiles": quantile_sketch.percentiles, "p3_merged": quantile_sketch.merged_and_deleted,
        "p4_found": pii.found, "p4_redacted": pii.redact,
        "p6_found": near_dup.found, "p6_groups": near_dup.links,
        "p8_ids": bpe.ids,
        "p9_containers": packing.assigned, "p9_fill": packing.summary,
        "p10_found": toxicity.found, "p10_scores": toxicity.scored, "p10_rates": toxicity.rates,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_merged": quantile_sketch.MERGED_SQL}

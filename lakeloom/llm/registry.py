"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lakeloom.llm import (
    binout, centroids, hardneg, licenses, linededup, logbilinear, mixing, neardup, neighbours, oracles, packing, pii, quality, urlfilter
)


def queries() -> dict:
    return {
        "op1_pack": packing.op1_pack,
        "op2_url_filter": urlfilter.op2_url_filter,
        "op3_neighbours": neighbours.op3_neighbours,
        "op4_near_dedup": neardup.op4_near_dedup,
        "op5_personal_data": pii.op5_personal_data,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_token_files": binout.op7_token_files,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_line_dedup": linededup.op10_line_dedup,
        "op11_centroids": centroids.op11_centroids,
        "op12_hard_negatives": hardneg.op12_hard_negatives,
        "op13_lm_scores": logbilinear.op13_lm_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": urlfilter.ORACLE_OP2,
        "op4_near_dedup": oracles.NEAR_DEDUP,
        "op6_mix_sources": oracles.MIX_SOURCES,
        "op8_license_scan": oracles.license_scan(),
        "op10_line_dedup": oracles.LINE_DEDUP,
        "op11_centroids": centroids.oracle(),
        "op12_hard_negatives": hardneg.ORACLE,
    }

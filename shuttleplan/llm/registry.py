"""The queries of this subpackage."""

from __future__ import annotations

from shuttleplan.llm import bytebpe, decontaminate, hardneg, language, merkle, neardup, oracles, packing, privacy, quality, repetition, substrings, templates, urlfilter


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_substring_dedup": substrings.op1_substring_dedup,
        "op2_jaccard_join": neardup.op2_jaccard_join,
        "op3_repetition": repetition.op3_repetition,
        "op4_packing": packing.op4_packing,
        "op5_language": language.op5_language,
        "op6_line_dedup": templates.op6_line_dedup,
        "op7_personal_data": privacy.op7_personal_data,
        "op8_quality": quality.op8_quality,
        "op9_url_filter": urlfilter.op9_url_filter,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_hard_negatives": hardneg.op11_hard_negatives,
        "op12_byte_bpe": bytebpe.op12_byte_bpe,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)

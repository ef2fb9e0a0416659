"""The corpus queries, one for each operator, and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, langid, language_model, lines, near, pii, quality, resample, secrets, sharding, spelling, warc


def queries():
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_personal_data": pii.op2_personal_data,
        "op3_sharding": sharding.op3_sharding,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_language_model": language_model.op5_language_model,
        "op6_secrets": secrets.op6_secrets,
        "op7_near_duplicates": near.op7_near_duplicates,
        "op8_bpe": bpe.op8_bpe,
        "op9_quality": quality.op9_quality,
        "op10_language_id": langid.op10_language_id,
        "op11_spelling": spelling.op11_spelling,
        "op12_resampling": resample.op12_resampling,
        "op13_archive": warc.op13_archive,
    }


def oracle_sql():
    return {
        "op1_decontaminate": decontaminate.OP1_SQL,
        "op4_line_dedup": lines.OP4_SQL,
        "op11_spelling": spelling.OP11_SQL,
        "op12_resampling": resample.OP12_SQL,
        "op13_archive": warc.OP13_SQL,
    }

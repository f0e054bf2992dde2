"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewords.llm import bpe, infill, jpeg, language, lm, mixing, quality, rules, runs, secrets, sharding, simhash, tokenfiles

QUERIES = {
    "op1_media": jpeg.op1_media,
    "op2_simhash": simhash.op2_simhash,
    "op3_language": language.op3_language,
    "op4_mixing": mixing.op4_mixing,
    "op5_secrets": secrets.op5_secrets,
    "op6_bpe": bpe.op6_bpe,
    "op7_lm": lm.op7_lm,
    "op8_rules": rules.op8_rules,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_token_files": tokenfiles.op11_token_files,
    "op12_infill": infill.op12_infill,
    "op13_runs": runs.op13_runs,
}
ORACLES = {"op4_mixing": mixing.OP4_SQL, "op5_secrets": secrets.OP5_SQL, "op7_lm": lm.OP7_SQL, "op12_infill": infill.OP12_SQL, "op13_runs": runs.OP13_SQL}

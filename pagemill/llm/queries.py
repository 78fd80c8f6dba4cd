"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pagemill.llm import alignment, decontaminate, jaccard, language, periodic, pieces, pitman_yor, quality, secrets, sharding, substring, url_rules, warc

QUERIES = {
    "op1_pieces": pieces.op1_pieces,
    "op2_substring": substring.op2_substring,
    "op3_shards": sharding.op3_shards,
    "op4_warc": warc.op4_warc,
    "op5_language": language.op5_language,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality": quality.op7_quality,
    "op8_urls": url_rules.op8_urls,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_secrets": secrets.op10_secrets,
    "op11_alignment": alignment.op11_alignment,
    "op12_pitman_yor": pitman_yor.op12_pitman_yor,
    "op13_runs": periodic.op13_runs,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op4_warc": warc.OP4_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_urls": url_rules.OP8_SQL,
}

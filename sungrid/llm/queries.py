"""Queries of this package, and the SQL of those that SQL can express."""

from . import ann_partitions, attention_lm, conversation_repair, decontaminate, exact_dedup, langid, license_scan, mixing, periodic_runs, simhash, toxicity, url_filter, warc_zip

QUERIES = {
    "op1_warc_zip": warc_zip.op1_warc_zip,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_attention_lm": attention_lm.op5_attention_lm,
    "op6_temperature_mixing": mixing.op6_temperature_mixing,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_learned_partitions": ann_partitions.op12_learned_partitions,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op2_url_filters": url_filter.SQL,
    "op6_temperature_mixing": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
}

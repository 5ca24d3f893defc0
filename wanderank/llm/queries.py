"""Registry of the training-data queries and of the SQL that checks them."""

from . import decontaminate, html_extract, mixing, pii, secret_scan, sharding, simhash, stream_dedup, token_count, toxicity

QUERIES = {
    "op1_token_counts": token_count.query,
    "op2_toxic_spans": toxicity.query,
    "op3_uniform_shards": sharding.query,
    "op4_stream_dedup": stream_dedup.query,
    "op5_mix_sources": mixing.query,
    "op6_secret_scan": secret_scan.query,
    "op7_personal_data": pii.query,
    "op8_simhash_near_dedup": simhash.query,
    "op9_winnow_benchmark": decontaminate.query,
    "op10_main_text": html_extract.query,
}

ORACLES = {
    "op4_stream_dedup": stream_dedup.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op9_winnow_benchmark": decontaminate.ORACLE,
}

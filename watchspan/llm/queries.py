"""The operators as queries over whole tables, and the same results in SQL where SQL can say it."""

from __future__ import annotations

from watchspan.llm import chat, decontaminate, fim, idfile, packing, quality, repair, secret_scan, sharding, simhash, suffixes, toxicity, url_trees

QUERIES = {f.__name__: f for f in (chat.op1_chat_formatting, quality.op2_quality_rules, toxicity.op3_toxicity, url_trees.op4_url_filters,
                                 sharding.op5_histogram_sort_shards, secret_scan.op6_secret_scans, simhash.op7_simhash_near_dedup,
                                 idfile.op8_token_id_files, packing.op9_best_fit_packing,
                                 decontaminate.op10_benchmark_decontamination, fim.op11_fill_in_middle,
                                 suffixes.op12_suffix_dedup, repair.op13_conversation_repair)}
SQL = {"op1_chat_formatting": chat.SQL, "op6_secret_scans": secret_scan.SQL, "op11_fill_in_middle": fim.SQL}

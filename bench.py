"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

python bench.py [--all] [name-fragment ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "prf1_profile_columns prf2_describe_all prf4_missing_counts prf5_missing_correlation prf6_missing_pattern prf9_table_info "
    "prf11_top_values cln4_fill_mean cln5_fill_median cln6_fill_mode cln8_remove_outliers_iqr cln11_merge_similar_categories "
    "cln16_scale_standard cln18_one_hot cln19_label_encode anm1_summary_iqr anm3_isolation_forest stt1_t_test stt3_chi_square "
    "cor1_correlation_matrix viz1_histogram viz2_kde viz4_box_stats viz8_hierarchy_counts sql1_run_sql sql6_join_inner "
    "sql12_windows sql17_check_constraints ts3_resample_d ts6_fill_linear ts8_rolling_stats ts14_acf ts16_adf_test "
    "ts17_seasonal_decompose fc3_forecast_holt_winters fc4_forecast_arima ml6_linear ml8_random_forest ml11_knn "
    "ml18_classification_metrics tx2_text_stats tx4_word_frequency tx5_top_ngrams_2 tx7_sentiment tx11_tfidf tx14_summarize "
    "tx16_cluster_vectors img2_image_stats img3_image_histogram"
).split()


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from lumenframe.catalog import QUERIES
    from lumenframe.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = [a for a in sys.argv[1:] if not a.startswith("--")]
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    if wanted:
        names = [n for n in QUERIES if any(w in n for w in wanted)]
    spark = local_session(app="bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

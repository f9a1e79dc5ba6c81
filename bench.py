"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run once
to warm up and then timed to full materialisation of its result.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import workload  # noqa: E402
from millrace.session import drop_stages, local_session  # noqa: E402

HEADLINE = [
    "impute_mean", "impute_median", "impute_mode", "drop_outliers_iqr", "drop_outliers_zscore", "correlation_matrix",
    "standard_scale", "minmax_scale", "robust_scale", "one_hot_encode", "encode_classes", "encode_many_classes",
    "oversample", "pca_reduce", "run_sequence", "numeric_summary", "categorical_summary", "table_summary_all",
    "histogram", "density", "box_stats", "plot_sample", "train_test_split", "stratified_split", "lineage",
    "classification_metrics", "roc_auc", "roc_auc_multi", "regression_metrics", "confusion_matrix", "silhouette",
    "train_logistic_regression", "train_linear_regression", "train_random_forest_classifier", "kmeans",
    "quality_report", "sample_copula", "compare_experiments", "import_csv",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", tempfile.mkdtemp(prefix="bench-"))
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        for _ in range(2):
            start = time.perf_counter()
            workload.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()

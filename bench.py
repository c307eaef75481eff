"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON. Each time is the least of
two runs of a freshly built DataFrame, written to nowhere, so every row and column is computed."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["evoked_average", "epochs_covariance", "epochs_from_events", "find_events_increasing_onset", "annotations_per_epoch", "define_target_events", "apply_inverse_kernel", "set_eeg_reference_average", "f_oneway", "permutation_t_test", "fdr_correction_indep", "filter_bandpass", "psd_welch", "tfr_morlet", "sliding_estimator"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from neurolattice.plans import registry

    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

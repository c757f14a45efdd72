"""Time the headline jobs on one scale factor and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is run
once to warm up the JVM and then BENCH_RUNS times; the median counts. A query's
time covers everything from building it to having its last row. The tables are dealt to several files first, outside
the timing, as one file would be read by one task.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from creditmill.catalog import QUERIES  # noqa: E402
from creditmill.catalog.samples import Samples  # noqa: E402
from creditmill.plans.feature_table import run_features  # noqa: E402
from creditmill.plans.load import load_features  # noqa: E402
from creditmill.session import build_session, stage  # noqa: E402
from creditmill.sources.store import LoanStore  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = (
    "clean_loans",
    "risk_baseline",
    "feature_table",
    "feature_summary",
    "summary_counts",
    "coerce_applicant",
    "load_dedup",
    "load_new_rows",
    "load_counters",
    "dq_rules",
    "dq_orphan_prediction_applicants",
    "lookup_applicant_predictions",
    "join_applicant_predictions",
    "join_explanation_documents",
    "classification_metrics",
    "roc_auc",
    "cohen_kappa",
    "tfidf_topk",
    "vector_topk",
    "train_naive_bayes",
    "train_decision_tree",
    "train_logistic_regression",
    "batch_scores",
    "near_duplicate_chunks",
    "vector_topk_set",
)


TABLES = ("customer", "documents", "embeddings", "labels", "lineitem", "orders", "supplier")


def deal(spark, folder: str) -> str:
    """The tables in as many files as there are cores."""
    for name in TABLES:
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").repartition(int(CPUS)).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="bench-")
    samples = Samples(spark, deal(spark, f"{scratch}/tables"))

    def run(query):
        return lambda: query(samples).write.format("noop").mode("overwrite").save()

    # The two whole jobs, from files to files.
    raw_csv = f"{scratch}/raw"
    samples.loan_raw().drop("row_no").write.csv(raw_csv, header=True)
    batch = stage(samples.loan_batch(), "bench-batch")
    counter = iter(range(1_000_000))
    jobs = {
        "job_csv_to_features": lambda: run_features(spark, raw_csv, f"{scratch}/f{next(counter)}"),
        "job_load_batch": lambda: load_features(
            batch, LoanStore(spark, f"{scratch}/store{next(counter)}"), batch_id="bench"
        ),
    }
    jobs.update({name: run(QUERIES[name]) for name in HEADLINE})

    seconds = {}
    for name, job in jobs.items():
        job()
        spent = []
        for _ in range(RUNS):
            start = time.perf_counter()
            job()
            spent.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(spent), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()

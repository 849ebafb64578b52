"""Headline timings: one JSON line.

Inputs are derived from the tables at ``$BENCH_SF_DIR`` and written once to a
scratch folder before anything is timed; each query then runs over the whole
of its input into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from auditlake.operators import batch, inventory, report, review, scan  # noqa: E402
from auditlake.plans.repair import repair_plans  # noqa: E402
from auditlake.registry import corpus  # noqa: E402
from auditlake.session import build_session, written  # noqa: E402
from auditlake.sources import snapshots  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = tempfile.mkdtemp(prefix="bench-")

    def stored(df, name):
        df.repartition(int(CPUS)).write.parquet(f"{scratch}/{name}")
        return spark.read.parquet(f"{scratch}/{name}")

    files = stored(corpus.code_files(spark, SF_DIR), "files")
    base = stored(corpus.code_files(spark, SF_DIR, "base"), "base")
    diffs = stored(corpus.code_diffs(spark, SF_DIR), "diffs")
    plans = stored(corpus.event_plans(spark, SF_DIR), "plans")
    verdicts = stored(corpus.verdicts_for(plans), "verdicts")
    documents = stored(corpus.table(spark, SF_DIR, "documents").select("doc_id", "text"), "documents")
    sources = inventory.source_files(files)
    python = sources.filter(F.col("language") == "python")
    log = stored(batch.edit_log(files, plans, verdicts), "log")

    def whole_run():
        scanned = written(scan.scan_files(sources), "scanned")
        made = written(repair_plans(scan.findings(scanned)), "plans")
        edits = batch.edit_log(files, made, corpus.verdicts_for(made))
        return report.run_report(scanned, review.outcome_reports(batch.outcomes_with_diff(edits)))

    queries = {
        "line_rules": lambda: scan.findings(
            scan.scan_files(sources.filter(F.col("language") != "python"))
        ),
        "python_facts": lambda: scan.syntax_facts(python),
        "findings": lambda: scan.findings(scan.scan_files(sources)),
        "scan_summary": lambda: scan.scan_summary(scan.scan_files(sources)),
        "text_line_checks": lambda: review.added_text_comments(documents, "doc_id"),
        "file_metrics": lambda: inventory.file_metrics(
            documents.withColumnRenamed("text", "content"), "doc_id"
        ),
        "incremental_set": lambda: snapshots.incremental_scan_set(files, base),
        "edit_log": lambda: batch.edit_log(files, plans, verdicts),
        "file_versions": lambda: batch.file_versions(log),
        "unified_diffs": lambda: batch.outcomes_with_diff(log),
        "review_reports": lambda: review.review_reports(diffs),
        "run_report": whole_run,
    }

    def run(build) -> float:
        start = time.time()
        build().write.format("noop").mode("overwrite").save()
        return time.time() - start

    # Untimed passes start the Python workers and warm the JVM up.
    for build in [*queries.values(), *queries.values()]:
        run(build)
    seconds = {name: round(min(run(build), run(build)), 3) for name, build in queries.items()}

    def total(df, column) -> int:
        return df.agg(F.sum(column)).first()[0]

    code = sources.filter(F.col("language") != "python")
    sizes = {
        "line_rules": ("lines", total(code, F.size(F.split("content", "\n")))),
        "python_facts": ("files", python.count()),
        "text_line_checks": ("lines", total(documents, F.size(F.split("text", "\n")))),
        "edit_log": ("edits", plans.count()),
        "unified_diffs": ("diffs", plans.count()),
        "review_reports": ("diffs", diffs.count()),
    }
    rates = {f"{n}_{unit}_per_sec": round(size / seconds[n]) for n, (unit, size) in sizes.items()}
    print(
        json.dumps(
            {
                "metric": "headline audit queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rates": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

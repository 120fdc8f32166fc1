"""Headline queries on one machine: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (threads). Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "condition_era", "condition_era_strict", "drug_era", "observation_period", "latest_year", "first_seen", "payer_plan_periods",
    "concept_map", "lookup_codes", "unmapped_frequency", "assign_ids", "skew_join", "export_decision_all", "steward_queue",
    "consent_filter", "transition", "download_gate", "extract_slides", "silver_samples", "gold_join", "pk_violations", "fk_orphans", "copy_into",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from medweave.bindings import load
    from medweave.bindings.common import Tables
    from medweave.bindings.feeds import given
    from medweave.plans.claims import claims_to_cdm
    from medweave.session import get_session

    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    tables = Tables(spark, folder)

    def run(name: str) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    def flow() -> None:
        out = claims_to_cdm(given(tables))
        for df in out.tables.values():
            df.write.format("noop").mode("overwrite").save()

    def timed(job) -> float:
        begin = time.perf_counter()
        job()
        return round(time.perf_counter() - begin, 3)

    run("row_counts")  # start-up is not part of any query
    seconds = {name: timed(lambda name=name: run(name)) for name in HEADLINE}
    seconds["claims_to_cdm"] = timed(flow)
    persons = tables.customer.where("c_acctbal >= 0").count()
    line = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "persons_per_second": round(persons / seconds["claims_to_cdm"], 1),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()

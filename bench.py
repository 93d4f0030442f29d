"""Time the headline queries warm and print one JSON line.

``$BENCH_SF_DIR`` names the tables, ``$BENCH_CPUS`` the local cores,
``$BENCH_QUERIES`` other queries (a comma list, or ``all``). Each query is
planned and fully computed twice; the second time counts. The sum of the first
times is reported as ``cold``.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybook.session import build_session  # noqa: E402


HEADLINE = """
file_summary collate_ledgers recode_suppliers unique_suppliers enrich_ledger valid_extract
ledger_totals missing_indicator threshold_split standard_supplier_counts extract_totals
sector_split sector_pivot_by_body nth_supplier_share gp_share_by_body flag_profile_vcse
supplier_crosstab_report spending_crosstab_report shared_subset legal_form_report
vcse_suppliers spend_bands vcse_body_counts spend_split_by_body per_capita_spend successor_rank
profile_vcse_spend profile_supplier_count_rank successor_supplier_counts
""".split()


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        extra={
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not wanted else list(queries) if wanted == "all" else wanted.split(",")
    cold = {name: run(queries[name], spark, sf_dir) for name in names}
    warm = {name: run(queries[name], spark, sf_dir) for name in names}
    result = {
        "metric": f"warm seconds over {len(names)} queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": {name: round(seconds, 3) for name, seconds in warm.items()},
        "cold": round(sum(cold.values()), 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

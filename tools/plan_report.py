"""Summarise the physical plans of every registered query, those of the tables it writes included.

usage: python tools/plan_report.py [--sf DIR]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql.readwriter import DataFrameWriter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNT = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "Window", "WindowGroupLimit", "HashAggregate", "FileScan parquet", "Scan ExistingRDD")


def summarise(plan: str) -> dict:
    out = {}
    for w in COUNT:
        if w == "Exchange":
            n = len(re.findall(r"(?<!Broadcast)Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition|"
                               r"ENSURE|REPARTITION)", plan)) or len(re.findall(r"(?<![A-Za-z])Exchange ", plan))
        else:
            n = len(re.findall(re.escape(w) + r"(?![A-Za-z])", plan))
        out[w] = n
    out["joins"] = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin) \[[^\]]*\], \[[^\]]*\], "
                                         r"(\w+)", plan)))
    out["pushed"] = sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan)))[:3]
    return out


def jobs(fn, spark, sf) -> list[str]:
    """Final plans of everything a query runs: the tables it writes while its frame is built, and its result."""
    plans = []
    write = DataFrameWriter.parquet

    def noted(writer, path, *args, **kwargs):
        write(writer, path, *args, **kwargs)
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())

    DataFrameWriter.parquet = noted
    try:
        df = fn(spark, sf)
    finally:
        DataFrameWriter.parquet = write
    df.write.format("noop").mode("overwrite").save()
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    return [p.split("== Initial Plan ==")[0] for p in plans]


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    a = ap.parse_args()
    from hitweave.plans.registry import QUERIES
    from hitweave.session import build_session
    spark = build_session("local[8]", 16)
    print("# Physical plans (executed at", os.path.basename(a.sf) + ")\n")
    print("Counts of operators in the plans of each query: the tables it writes while its frame is built (`tables`: fixtures,")
    print("numbering passes, fits, tables at rest) and its result, together; of written tables the plan before the write is run is")
    print("counted, of the result the final AQE plan.  `top-k limit` counts `WindowGroupLimit` nodes (k rows kept per task before the")
    print("shuffle).  Jobs of streams are not in it.\n")
    print("| key | tables | shuffles | broadcasts | BHJ | SMJ | windows | top-k limit | aggs | parquet scans | joins of the result |")
    print("|---|---|---|---|---|---|---|---|---|---|---|")
    for k, fn in QUERIES.items():
        plans = jobs(fn, spark, a.sf)
        parts = [summarise(p) for p in plans]
        n = {w: sum(p[w] for p in parts) for w in COUNT}
        joins = ", ".join(f"{j} {t}" for j, t in parts[-1]["joins"])
        print(f"| {k} | {len(plans) - 1} | {n['Exchange']} | {n['BroadcastExchange']} | {n['BroadcastHashJoin']} | {n['SortMergeJoin']} | "
              f"{n['Window']} | {n['WindowGroupLimit']} | {n['HashAggregate']} | {n['FileScan parquet']} | {joins} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

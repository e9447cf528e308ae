"""Command line for the staged jobs, for spark-submit.

    spark-submit --py-files tallymart.zip jobs.py pipeline --root hdfs:///sales
    spark-submit --py-files tallymart.zip jobs.py silver --input ... --output ...

Cluster address, memory and the like come from spark-submit, not from here.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tallymart import (
    EXACT,
    FLOAT,
    Layout,
    run_bronze,
    run_dq_report,
    run_gold,
    run_pipeline,
    run_reports,
    run_silver,
    synth_sales,
    write_raw_csv,
)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description="Sales cleaning and reporting marts")
    jobs = top.add_subparsers(dest="job", required=True)

    bronze = jobs.add_parser("bronze", help="raw CSV to typed Parquet")
    silver = jobs.add_parser("silver", help="bronze to deduplicated, cleaned Parquet")
    for job in (bronze, silver):
        job.add_argument("--input", required=True)
        job.add_argument("--output", required=True)
        job.add_argument("--files", type=int, help="number of output files")

    gold = jobs.add_parser("gold", help="silver to the sales cube and the three marts")
    gold.add_argument("--input", required=True)
    gold.add_argument("--daily-output", required=True)
    gold.add_argument("--category-output", required=True)
    gold.add_argument("--city-output", required=True)
    gold.add_argument("--cube-output", required=True)

    reports = jobs.add_parser("reports", help="the stored cube to the report tables")
    quality = jobs.add_parser("dq-report", help="bronze to the data quality report")
    for job in (reports, quality):
        job.add_argument("--input", required=True)
        job.add_argument("--output", required=True)

    pipeline = jobs.add_parser("pipeline", help="all three stages")
    pipeline.add_argument("--root", required=True, help="folder of the layers")
    pipeline.add_argument("--raw", help="raw CSV, if not in its usual place under root")
    pipeline.add_argument("--bronze-files", type=int)
    pipeline.add_argument("--silver-files", type=int)
    for job in (bronze, pipeline):
        job.add_argument(
            "--by-position",
            action="store_true",
            help="load columns by position, whatever the header says",
        )
    for job in (silver, pipeline):
        job.add_argument("--order-by", nargs="+", help="columns that pick the copy to keep")
    for job in (gold, pipeline):
        job.add_argument("--mode", choices=[EXACT, FLOAT], default=EXACT)

    generate = jobs.add_parser("generate", help="write generated dirty sales as CSV")
    generate.add_argument("--output", required=True)
    generate.add_argument("--rows", type=int, default=4_000_000)
    generate.add_argument("--seed", type=int, default=0)
    generate.add_argument("--files", type=int, help="number of files; follows --rows without it")
    generate.add_argument(
        "--ingestion-date", type=dt.date.fromisoformat, default=dt.date.today()
    )
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"tallymart-{args.job}").getOrCreate()
    result = run(spark, args)
    print(json.dumps({"job": args.job, **(result or {})}))


def run(spark: SparkSession, args: argparse.Namespace) -> dict | None:
    if args.job == "bronze":
        return run_bronze(spark, args.input, args.output, args.files, not args.by_position)
    if args.job == "silver":
        return run_silver(spark, args.input, args.output, args.files, args.order_by)
    if args.job == "gold":
        return run_gold(
            spark,
            args.input,
            args.daily_output,
            args.category_output,
            args.city_output,
            args.cube_output,
            args.mode,
        )
    if args.job == "pipeline":
        layout = Layout.under(args.root, args.raw)
        return run_pipeline(
            spark,
            layout,
            args.bronze_files,
            args.silver_files,
            args.mode,
            args.order_by,
            not args.by_position,
        )
    if args.job == "reports":
        return {"reports": run_reports(spark, args.input, args.output)}
    if args.job == "dq-report":
        return run_dq_report(spark, args.input, args.output)
    sales = synth_sales(spark, args.rows, args.ingestion_date, args.seed, args.files)
    write_raw_csv(sales, args.output)
    return {"rows": args.rows}


if __name__ == "__main__":
    main()

"""Sales cleaning and reporting marts on Spark."""

from tallymart.functions.money import EXACT, FLOAT
from tallymart.operators.dedup import dedup, duplicate_keys
from tallymart.operators.marts import (
    category_mart,
    city_mart,
    daily_mart,
    facts,
    roll_up,
    sales_cube,
    with_total_amount,
)
from tallymart.operators.rules import SALES_RULES, Rule, apply_rules, dq_report
from tallymart.plans.pipeline import (
    Layout,
    run_bronze,
    run_dq_report,
    run_gold,
    run_pipeline,
    run_reports,
    run_silver,
)
from tallymart.plans.silver import clean
from tallymart.schema import RAW_SCHEMA, assert_schema
from tallymart.sources.csv_feed import read_raw_csv, write_raw_csv
from tallymart.sources.layers import read_layer, write_layer
from tallymart.sources.synthetic import synth_sales

__all__ = [
    "EXACT",
    "FLOAT",
    "Layout",
    "RAW_SCHEMA",
    "Rule",
    "SALES_RULES",
    "apply_rules",
    "assert_schema",
    "category_mart",
    "city_mart",
    "clean",
    "daily_mart",
    "dedup",
    "dq_report",
    "duplicate_keys",
    "facts",
    "read_layer",
    "read_raw_csv",
    "roll_up",
    "run_bronze",
    "run_dq_report",
    "run_reports",
    "run_gold",
    "run_pipeline",
    "run_silver",
    "sales_cube",
    "synth_sales",
    "with_total_amount",
    "write_layer",
    "write_raw_csv",
]

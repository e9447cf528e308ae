"""The same queries as SQL over the star tables, written for DuckDB."""

from __future__ import annotations

from tallymart.functions.draws import DRAW_SPAN, DRAW_STEP, HIGH_STEP, ROUNDS, SEED_STEP
from tallymart.operators.rollups import REPORTS
from tallymart.schema import RAW_COLUMNS
from tallymart.sources.synthetic import (
    AGE,
    CATEGORY_PRICES,
    CUSTOMER_PREFIX,
    CUSTOMERS,
    DISCOUNT,
    DRAWS,
    FIRST_DAY,
    GENDERS,
    HIGH_AGE,
    HIGH_DISCOUNT,
    LAST_DAY,
    LOW_AGE,
    LOW_QUANTITY,
    PAYMENTS,
    PLACES,
    PRODUCT_PREFIX,
    PRODUCTS,
    QUANTITY,
    REFUND,
    SHIP_LAG,
    STATUSES,
)

RAW_LIST = ", ".join(RAW_COLUMNS)

FEED = """
keyed AS (
  SELECT *, l_orderkey * 31 + l_linenumber * 17 + l_partkey * 13 + l_suppkey * 7 AS k
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
),
feed AS (
  SELECT
    'T' || l_orderkey || '-' || l_linenumber AS transaction_id,
    CAST(o_orderdate AS DATE) AS order_date,
    CAST(l_shipdate AS DATE) AS ship_date,
    'CUST' || c_custkey AS customer_id,
    CAST(CASE k % 4 WHEN 0 THEN 18 + k % 53 WHEN 1 THEN -10 + k % 21
                    WHEN 2 THEN 120 + k % 81 END AS INTEGER) AS customer_age,
    CASE k % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN ' male'
               WHEN 3 THEN 'Female' END AS gender,
    'PROD' || p_partkey AS product_id,
    p_type AS product_category,
    CAST(CASE k % 3 WHEN 0 THEN l_quantity WHEN 1 THEN 0 ELSE -1 - k % 5 END AS INTEGER)
      AS quantity,
    CAST(CASE k % 7 WHEN 0 THEN -p_retailprice WHEN 1 THEN NULL
                    WHEN 3 THEN p_retailprice + CAST(0.005 AS DOUBLE)
                    ELSE p_retailprice END AS FLOAT) AS unit_price,
    CAST(CASE k % 11 WHEN 0 THEN CAST(60 + k % 91 AS DOUBLE) WHEN 1 THEN NULL
                     WHEN 2 THEN -1.0 WHEN 3 THEN l_discount * 100 + CAST(0.345 AS DOUBLE)
                     ELSE l_discount * 100 END AS FLOAT) AS discount_pct,
    n_name AS city,
    r_name AS state,
    CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN 'Card' WHEN 1 THEN 'UPI'
      WHEN 2 THEN 'COD' WHEN 3 THEN 'Crypto' WHEN 4 THEN 'card' END AS payment_type,
    CASE l_returnflag WHEN 'A' THEN 'Delivered' WHEN 'N' THEN 'Cancelled'
                      WHEN 'R' THEN 'Returned' END AS order_status,
    DATE '2026-01-01' AS ingestion_date,
    l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  FROM keyed
)"""

LINE_ORDER = "order_date, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
FULL_ORDER = ", ".join(c for c in RAW_COLUMNS if c != "transaction_id")

RULES = {
    "ship_date": "CASE WHEN ship_date < order_date THEN NULL ELSE ship_date END",
    "unit_price": "CASE WHEN unit_price <= 0 THEN NULL ELSE unit_price END",
    "discount_pct": "CASE WHEN discount_pct < 0 OR discount_pct > 100 THEN NULL"
    " ELSE discount_pct END",
    "customer_age": "CASE WHEN customer_age < 15 OR customer_age > 100 THEN NULL"
    " ELSE customer_age END",
    "gender": "CASE WHEN upper(trim(gender)) = 'MALE' THEN 'M'"
    " WHEN upper(trim(gender)) = 'FEMALE' THEN 'F'"
    " WHEN gender IN ('M', 'F') THEN gender END",
    "payment_type": "CASE WHEN payment_type IN ('Card', 'UPI', 'COD') THEN payment_type END",
}


def survivors(order: str) -> str:
    ordering = ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in order.split(","))
    return f"""
survivors AS (
  SELECT * FROM feed
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY {ordering}) = 1
)"""


SILVER = f"""
silver AS (
  SELECT {", ".join(f"{RULES[c]} AS {c}" if c in RULES else c for c in RAW_COLUMNS)}
  FROM survivors WHERE quantity > 0
)"""

# In whole units of 1e-7: quantity * price * (100 - discount) is an integer, cents are
# that by 1e14, half up.
EXACT_AMOUNT = """CAST(0.01 * CAST((
    2 * CAST(quantity AS HUGEINT)
      * CAST(CAST(CAST(unit_price AS VARCHAR) AS DECIMAL(18,7)) * 10000000 AS HUGEINT)
      * (1000000000 - CAST(CAST(CAST(discount_pct AS VARCHAR) AS DECIMAL(18,7)) * 10000000 AS HUGEINT))
    + 100000000000000) // 200000000000000 AS DECIMAL(26,0)) AS DECIMAL(28,2))"""

# Rounding goes through the shortest decimal text of the double, half up.
FLOAT_AMOUNT = """CAST(round(CAST(CAST(
    CAST(CAST(quantity AS FLOAT) * unit_price AS DOUBLE)
    * (1 - CAST(discount_pct AS DOUBLE) / 100) AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE)"""

AMOUNTS = f"""
amounts AS (SELECT *, {EXACT_AMOUNT} AS total_amount FROM silver)"""
FLOAT_AMOUNTS = f"""
amounts AS (SELECT *, CAST({FLOAT_AMOUNT} AS DECIMAL(28,2)) AS total_amount FROM silver)"""


def average(total: str, count: str) -> str:
    """Exact half-up average of a non-negative amount, to the cent."""
    cents = f"CAST({total} * 100 AS HUGEINT)"
    return (
        f"CASE WHEN {count} > 0 THEN"
        f" CAST((2 * {cents} + {count}) // (2 * {count}) AS DOUBLE) / 100 END"
    )


def facts(name: str, keys: str) -> str:
    selected, grouped = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"""
{name} AS (
  SELECT {selected}sum(total_amount) AS amount, count(total_amount) AS priced_orders,
    count(*) FILTER (WHERE total_amount IS NULL AND quantity IS NOT NULL
      AND unit_price IS NOT NULL AND discount_pct IS NOT NULL) AS unpriceable,
    count(transaction_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units
  FROM amounts{grouped}
)"""


DAILY = f"""
daily AS (
  SELECT order_date, CAST(amount AS DOUBLE) AS daily_total_revenue,
    orders AS daily_total_orders,
    {average("amount", "priced_orders")} AS daily_avg_order_value
  FROM by_day
)"""
CATEGORY = """
category AS (
  SELECT product_category, CAST(amount AS DOUBLE) AS category_revenue,
    units AS total_units_sold, orders AS order_count
  FROM by_category
)"""
CITY = f"""
city_mart AS (
  SELECT city, state, CAST(amount AS DOUBLE) AS city_revenue, orders AS order_count,
    {average("amount", "priced_orders")} AS avg_order_value
  FROM by_city
)"""

TO_SILVER = [FEED, survivors(LINE_ORDER), SILVER]
TO_AMOUNTS = [*TO_SILVER, AMOUNTS]
BY_DAY = facts("by_day", "order_date")
BY_CATEGORY = facts("by_category", "product_category")
BY_CITY = facts("by_city", "city, state")
TO_DAY = [*TO_AMOUNTS, BY_DAY]
TO_CATEGORY = [*TO_AMOUNTS, BY_CATEGORY]
TO_CITY = [*TO_AMOUNTS, BY_CITY]


def query(ctes: list[str], select: str) -> str:
    return "WITH" + ",".join(ctes) + "\n" + select


def rule_alone(name: str, column: str) -> str:
    columns = list(dict.fromkeys(["transaction_id", "order_date", column]))
    if column == "quantity":
        return query([FEED], f"SELECT {', '.join(columns)} FROM feed WHERE quantity > 0")
    listed = ", ".join(f"{RULES[c]} AS {c}" if c == column else c for c in columns)
    return query([FEED], f"SELECT {listed} FROM feed")


def dq_line(name: str, column: str, action: str, violating: str) -> str:
    return f"""
SELECT '{name}' AS rule, '{column}' AS column_name, '{action}' AS action,
  count(*) AS rows_checked, CAST({violating} AS BIGINT) AS rows_violating,
  count(*) - count({column}) AS rows_null
FROM feed"""


def changed(column: str) -> str:
    return f"count(*) FILTER (WHERE {column} IS DISTINCT FROM {RULES[column]})"


DQ = " UNION ALL ".join(
    [
        dq_line(
            "duplicate_key",
            "transaction_id",
            "drop_row",
            "count(*) - count(DISTINCT transaction_id)"
            " - max(CASE WHEN transaction_id IS NULL THEN 1 ELSE 0 END)",
        ),
        dq_line("ship_date", "ship_date", "null_out", changed("ship_date")),
        dq_line(
            "quantity",
            "quantity",
            "drop_row",
            "count(*) FILTER (WHERE quantity IS NULL OR quantity <= 0)",
        ),
        dq_line("unit_price", "unit_price", "null_out", changed("unit_price")),
        dq_line("discount", "discount_pct", "null_out", changed("discount_pct")),
        dq_line("customer_age", "customer_age", "null_out", changed("customer_age")),
        dq_line("gender", "gender", "standardise", changed("gender")),
        dq_line("payment_type", "payment_type", "null_out", changed("payment_type")),
    ]
)


def synth() -> str:
    """The generator, from the same fixed values: draws are a few integer operations on the row key."""
    key = "l_orderkey * 8 + l_linenumber"
    start = f"(k % {DRAW_SPAN} + k // {DRAW_SPAN} % {DRAW_SPAN} * {HIGH_STEP} + {{start}}) % {DRAW_SPAN}"
    steps = [f"x0 AS (SELECT {key} AS k FROM lineitem)"]
    values = {
        name: start.format(start=(SEED_STEP + (n + 1) * DRAW_STEP * 65537) % DRAW_SPAN)
        for n, name in enumerate(DRAWS)
    }
    for at, (factor, shift) in enumerate(ROUNDS):
        scaled = ", ".join(
            f"(({v}) * {factor} + {n + 1}) % {DRAW_SPAN} AS d_{name}" for n, (name, v) in enumerate(values.items())
        )
        folded = ", ".join(f"xor(d_{name}, d_{name} >> {shift}) % {DRAW_SPAN} AS d_{name}" for name in DRAWS)
        steps += [f"m{at} AS (SELECT {scaled} FROM x{at})", f"x{at + 1} AS (SELECT {folded} FROM m{at})"]
        values = {name: f"d_{name}" for name in DRAWS}

    def literal(value) -> str:
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    def pick(draw: str, values: list) -> str:
        whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
        return f"CASE {draw} % {len(values)} {whens} END"

    def between(draw: str, span: tuple[int, int]) -> str:
        return f"{draw} % {span[1] - span[0] + 1} + {span[0]}"

    def chosen(draw: str, values: list) -> str:
        return pick(draw, [literal(v) for v in values])

    low = chosen("d_category", [low * 100 for low, _ in CATEGORY_PRICES.values()])
    span = chosen("d_category", [(high - low) * 100 + 1 for low, high in CATEGORY_PRICES.values()])
    ages = [between("d_age", s) for s in (AGE, LOW_AGE, HIGH_AGE)]
    discounts = [
        f"CAST({between('d_discount', (lo * 100, hi * 100))} AS DOUBLE) / 100" for lo, hi in (DISCOUNT, HIGH_DISCOUNT)
    ]
    refund = f"CAST(-{REFUND[0]} AS DOUBLE) - CAST({REFUND[1] - REFUND[0]} AS DOUBLE) * CAST(d_price AS DOUBLE) / CAST({DRAW_SPAN} AS DOUBLE)"
    quantities = [between("d_quantity", QUANTITY), "0", between("d_quantity", LOW_QUANTITY)]
    days = (LAST_DAY - FIRST_DAY).days
    return f"""
WITH {", ".join(steps)},
dated AS (
  SELECT *, DATE '{FIRST_DAY}' + CAST({between("d_order_date", (0, days))} AS INTEGER) AS day FROM x{len(ROUNDS)}
)
SELECT
  CAST((d_id_high * {DRAW_SPAN} + d_id_low)
    % greatest((SELECT count(*) // 2 FROM lineitem), 1) + 1 AS VARCHAR) AS transaction_id,
  day AS order_date,
  day + CAST({between("d_ship_lag", SHIP_LAG)} AS INTEGER) AS ship_date,
  '{CUSTOMER_PREFIX}' || ({between("d_customer", (1, CUSTOMERS))}) AS customer_id,
  CAST({pick("d_age_kind", [*ages, "NULL"])} AS INTEGER) AS customer_age,
  {chosen("d_gender", GENDERS)} AS gender,
  '{PRODUCT_PREFIX}' || ({between("d_product", (1, PRODUCTS))}) AS product_id,
  {chosen("d_category", list(CATEGORY_PRICES))} AS product_category,
  CAST({pick("d_quantity_kind", quantities)} AS INTEGER) AS quantity,
  CAST({pick("d_price_kind", [f"CAST({low} + d_price % {span} AS DOUBLE) / 100", refund, "NULL"])} AS FLOAT)
    AS unit_price,
  CAST({pick("d_discount_kind", [*discounts, "NULL"])} AS FLOAT) AS discount_pct,
  {chosen("d_place", [city for city, _ in PLACES])} AS city,
  {chosen("d_place", [state for _, state in PLACES])} AS state,
  {chosen("d_payment", PAYMENTS)} AS payment_type,
  {chosen("d_status", STATUSES)} AS order_status,
  DATE '2026-01-01' AS ingestion_date
FROM dated"""


def registered() -> dict[str, str]:
    pipeline = query(
        [
            FEED,
            survivors(FULL_ORDER),
            SILVER,
            AMOUNTS,
            BY_DAY,
            BY_CATEGORY,
            BY_CITY,
            DAILY,
            CATEGORY,
            CITY,
        ],
        """
SELECT 'daily' AS mart, CAST(order_date AS VARCHAR) AS group_key,
  daily_total_revenue AS revenue, daily_total_orders AS orders,
  daily_avg_order_value AS avg_order_value, CAST(NULL AS BIGINT) AS units FROM daily
UNION ALL
SELECT 'category', product_category, category_revenue, order_count,
  CAST(NULL AS DOUBLE), total_units_sold FROM category
UNION ALL
SELECT 'city', city || '|' || state, city_revenue, order_count, avg_order_value,
  CAST(NULL AS BIGINT) FROM city_mart""",
    )
    rules = {
        "ship_date": "ship_date",
        "quantity": "quantity",
        "unit_price": "unit_price",
        "discount": "discount_pct",
        "customer_age": "customer_age",
        "gender": "gender",
        "payment_type": "payment_type",
    }
    float_amounts = [*TO_SILVER, FLOAT_AMOUNTS]
    amount_columns = "transaction_id, quantity, unit_price, discount_pct"
    found = {
        "bronze_ingest": query([FEED], f"SELECT {RAW_LIST} FROM feed"),
        "layer_row_counts": query(
            TO_SILVER,
            """
SELECT (SELECT count(*) FROM feed) AS bronze_rows,
  (SELECT count(*) FROM survivors) AS deduplicated_rows,
  (SELECT count(*) FROM silver) AS silver_rows""",
        ),
        "pipeline_end_to_end": pipeline,
        "synth_source": synth(),
        "duplicate_keys": query(
            [FEED],
            "SELECT transaction_id, count(*) AS copies FROM feed"
            " GROUP BY transaction_id HAVING count(*) > 1",
        ),
        "dedup_transactions": query(
            [FEED, survivors(LINE_ORDER)], f"SELECT {RAW_LIST} FROM survivors"
        ),
        **{f"rule_{n}": rule_alone(n, c) for n, c in rules.items()},
        "silver_clean": query(TO_SILVER, "SELECT * FROM silver"),
        "dq_report": query([FEED], DQ),
        "total_amount": query(
            TO_AMOUNTS,
            f"SELECT {amount_columns}, CAST(total_amount AS DOUBLE) AS total_amount"
            " FROM amounts",
        ),
        "total_amount_float": query(
            TO_SILVER,
            f"SELECT {amount_columns}, {FLOAT_AMOUNT} AS total_amount FROM silver",
        ),
        "daily_sales_metrics": query([*TO_DAY, DAILY], "SELECT * FROM daily"),
        "product_category_performance": query(
            [*TO_CATEGORY, CATEGORY], "SELECT * FROM category"
        ),
        "city_revenue_metrics": query([*TO_CITY, CITY], "SELECT * FROM city_mart"),
        "daily_sales_metrics_float": query([*float_amounts, BY_DAY, DAILY], "SELECT * FROM daily"),
        "product_category_performance_float": query(
            [*float_amounts, BY_CATEGORY, CATEGORY], "SELECT * FROM category"
        ),
        "city_revenue_metrics_float": query([*float_amounts, BY_CITY, CITY], "SELECT * FROM city_mart"),
        "sales_cube": query(
            [*TO_AMOUNTS, facts("cube", "order_date, product_category, city, state")],
            "SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM cube",
        ),
        "kpi_category_totals": query(
            TO_CATEGORY,
            """
SELECT CAST(sum(amount) AS DOUBLE) AS category_revenue,
  CAST(sum(orders) AS BIGINT) AS total_orders,
  CAST(sum(units) AS BIGINT) AS total_sold_units FROM by_category""",
        ),
        "category_order_share": query(
            TO_CATEGORY,
            """
SELECT product_category, orders AS order_count,
  CAST(orders AS DOUBLE) / CAST(sum(orders) OVER () AS DOUBLE) AS order_share
FROM by_category""",
        ),
        "category_revenue_rank": query(
            TO_CATEGORY,
            """
SELECT product_category, CAST(amount AS DOUBLE) AS category_revenue,
  rank() OVER (ORDER BY amount DESC NULLS LAST) AS revenue_rank FROM by_category""",
        ),
        "category_units_revenue": query(
            TO_CATEGORY,
            """
SELECT product_category, units AS total_units_sold,
  CAST(amount AS DOUBLE) AS category_revenue FROM by_category""",
        ),
        "category_revenue_ratio": query(
            TO_CATEGORY,
            """
SELECT CAST(max(amount) AS DOUBLE) AS top_revenue,
  CAST(min(amount) AS DOUBLE) AS bottom_revenue,
  CAST(max(amount) AS DOUBLE) / nullif(CAST(min(amount) AS DOUBLE), 0) AS revenue_ratio
FROM by_category""",
        ),
        "monthly_orders": query(
            TO_DAY,
            """
SELECT CAST(month(order_date) AS INTEGER) AS month,
  CAST(sum(orders) AS BIGINT) AS total_orders FROM by_day GROUP BY 1""",
        ),
        "monthly_revenue": query(
            TO_DAY,
            """
SELECT CAST(month(order_date) AS INTEGER) AS month,
  CAST(sum(amount) AS DOUBLE) AS total_revenue FROM by_day GROUP BY 1""",
        ),
        "calendar_month_trend": query(
            TO_DAY,
            """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start,
  CAST(sum(orders) AS BIGINT) AS total_orders,
  CAST(sum(amount) AS DOUBLE) AS total_revenue FROM by_day GROUP BY 1""",
        ),
        "kpi_daily": query(
            [
                *TO_DAY,
                f"""
averaged AS (
  SELECT *, CAST({average("amount", "priced_orders")} AS DECIMAL(28,2)) AS aov FROM by_day
),
totals AS (
  SELECT CAST(sum(orders) AS BIGINT) AS total_orders, sum(aov) AS aov_sum,
    sum(amount) AS amount, count(amount) AS days FROM averaged
)""",
            ],
            f"""
SELECT total_orders, CAST(aov_sum AS DOUBLE) AS sum_of_daily_avg_order_value,
  {average("amount", "days")} AS mean_daily_revenue FROM totals""",
        ),
        "state_metrics": query(
            [
                *TO_CITY,
                """
by_state AS (
  SELECT state, sum(amount) AS amount, CAST(sum(priced_orders) AS BIGINT) AS priced_orders,
    CAST(sum(orders) AS BIGINT) AS order_count, count(*) AS city_count
  FROM by_city GROUP BY state
)""",
            ],
            f"""
SELECT state, CAST(amount AS DOUBLE) AS state_revenue, order_count, city_count,
  {average("amount", "priced_orders")} AS avg_order_value FROM by_state""",
        ),
        "kpi_states": query(
            [
                *TO_CITY,
                """
by_state AS (SELECT state, sum(amount) AS amount FROM by_city GROUP BY state),
city_total AS (SELECT sum(amount) AS amount, count(amount) AS n FROM by_city),
state_total AS (
  SELECT sum(amount) AS amount, count(amount) AS n, count(state) AS states FROM by_state
)""",
            ],
            f"""
SELECT (SELECT states FROM state_total) AS total_states,
  (SELECT {average("amount", "n")} FROM city_total) AS avg_revenue_per_city_row,
  (SELECT {average("amount", "n")} FROM state_total) AS avg_revenue_per_state""",
        ),
        "city_revenue_bubble": query(
            TO_CITY,
            "SELECT city, state, CAST(amount AS DOUBLE) AS city_revenue FROM by_city",
        ),
    }
    return found | {f"cube_{report.__name__}": found[report.__name__] for report in REPORTS}

"""Hand-written boundary rows of the feed with their known results."""

from __future__ import annotations

import datetime as dt
import math

HEADER = (
    "transaction_id,order_date,ship_date,customer_id,customer_age,gender,product_id,"
    "product_category,quantity,unit_price,discount_pct,city,state,payment_type,"
    "order_status,ingestion_date"
)

# id, order_date, ship_date, age, gender, category, qty, price, disc, city, state, payment, status
BOUNDARY = [
    "e01,2024-01-10,2024-01-09,15,M,Sports,1,10.00,0,Dallas,TX,Card,Delivered",
    "e02,2024-01-10,2024-01-10,14,F,Sports,2,0.01,100,Dallas,TX,UPI,Cancelled",
    "e03,2024-01-10,,100,Male,Sports,3,0,50,Dallas,TX,COD,Returned",
    "e04,,2024-01-10,101, female ,Grocery,4,-5.5,-0.01,Dallas,TX,card,Delivered",
    "e05,2024-02-30,2024-01-10,-3,m,Grocery,5,19.99,100.01,Phoenix,AZ,Crypto,Delivered",
    "e06,2024-01-11,2024-01-12,,M ,Grocery,0,19.99,10,Phoenix,AZ,,Delivered",
    "e07,2024-01-11,2024-01-12,abc,FEMALE,Fashion,-1,19.99,10,Phoenix,AZ,Card ,Delivered",
    "e08,2024-01-11,2024-01-12,30,x,Fashion,,19.99,10,Phoenix,AZ,Card,Delivered",
    "e09,2024-01-11,2024-01-12,30,M,Fashion,1.5,19.99,10,Phoenix,AZ,Card,Delivered",
    "e10,2024-01-11,2024-01-12,30,M,Fashion,3,19.99,10.5,Phoenix,AZ,Card,Delivered",
    "e11,2024-01-11,2024-01-12,30,M,Fashion,7,NaN,NaN,Phoenix,AZ,Card,Delivered",
    "e12,2024-01-11,2024-01-12,30,M,Fashion,2,,33.33,Phoenix,AZ,Card,Delivered",
    ",2024-01-12,2024-01-12,30,M,Fashion,1,20,,Phoenix,AZ,Card,Delivered",
    ",2024-01-12,2024-01-12,30,M,Fashion,1,20,0,Phoenix,AZ,Card,Delivered",
]


# The order under which the results below hold: of the two rows without an id,
# the one without a discount comes first.
ORDER = HEADER.split(",")


def csv_line(row: str) -> str:
    tid, order, ship, age, gender, category, *rest = row.split(",")
    quantity, price, discount, city, state, payment, status = rest
    return ",".join(
        [tid, order, ship, "C1", age, gender, "P1", category, quantity, price, discount]
        + [city, state, payment, status, "2026-01-01"]
    )


def write_csv(folder, header: str = HEADER, rows=None) -> str:
    lines = [header, *(rows if rows is not None else map(csv_line, BOUNDARY))]
    path = folder / "sales.csv"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


D9, D10, D11, D12 = (dt.date(2024, 1, d) for d in (9, 10, 11, 12))
NAN = math.nan

# id -> order_date, ship_date, age, gender, quantity, price, discount, payment, exact amount
SILVER = {
    None: (D12, D12, 30, "M", 1, 20.0, None, "Card", None),
    "e01": (D10, None, 15, "M", 1, 10.0, 0.0, "Card", "10.00"),
    "e02": (D10, D10, None, "F", 2, 0.01, 100.0, "UPI", "0.00"),
    "e03": (D10, None, 100, "M", 3, None, 50.0, "COD", None),
    "e04": (None, D10, None, "F", 4, None, None, None, None),
    "e05": (None, D10, None, None, 5, 19.99, None, None, None),
    "e10": (D11, D12, 30, "M", 3, 19.99, 10.5, "Card", "53.67"),
    "e11": (D11, D12, 30, "M", 7, NAN, None, "Card", None),
    "e12": (D11, D12, 30, "M", 2, None, 33.33, "Card", None),
}
DAILY = {
    None: (None, 2, None),
    D10: (10.0, 3, 5.0),
    D11: (53.67, 3, 53.67),
    D12: (None, 0, None),
}
CATEGORY = {
    "Fashion": (53.67, 13, 3),
    "Grocery": (None, 9, 2),
    "Sports": (10.0, 6, 3),
}
CITY = {
    ("Dallas", "TX"): (10.0, 4, 5.0),
    ("Phoenix", "AZ"): (53.67, 4, 53.67),
}

"""Event-sourced order sessions: signed quantities and the ten analytics over them.

An event log row has session_id, op, order_id, customer_id, product_id, qty, unit_price, and for changes
old_qty and new_qty.  The same functions serve batch tables and, up to the aggregation, streams.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values at or below this are nothing.
EPS = 1e-9
ADDS, TAKES = ("place_order", "add_item"), ("remove_item", "return_item")


def signed(events: DataFrame) -> DataFrame:
    """``events`` with ``signed_qty`` and ``amount``.

    Orders and additions count up, removals and returns down, changes by new minus old; a confirmed
    payment has no quantity and its price as amount; other operations (stock corrections) are 0.
    """
    op = F.col("op")
    qty = F.when(op.isin(*ADDS), F.col("qty")).when(op.isin(*TAKES), -F.col("qty")).when(op == "modify_item", F.col("new_qty") - F.col("old_qty")).otherwise(F.lit(0.0))
    amount = F.when(op == "confirm_payment", F.col("unit_price")).otherwise(F.col("signed_qty") * F.col("unit_price"))
    return events.withColumn("signed_qty", qty).withColumn("amount", F.coalesce(amount, F.lit(0.0)))


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum("signed_qty"), 2).alias("quantity"), F.round(F.sum("amount"), 2).alias("revenue"))


def by_product(events: DataFrame) -> DataFrame:
    """Quantity and revenue of each product; payments name none and don't count."""
    return _sums(events.filter(F.col("product_id").isNotNull()), ["product_id"])


def by_customer(events: DataFrame, compat: bool = True) -> DataFrame:
    """Quantity and spend of each customer, payments included, as stored answers have it; without ``compat`` payments,
    which pay for what was ordered, aren't counted beside it."""
    return _sums(events if compat else events.filter("op <> 'confirm_payment'"), ["customer_id"])


def top(totals: DataFrame, value: str, n: int, key: str = "product_id") -> DataFrame:
    """The ``n`` largest positive values with ``rank``; ties go by key."""
    best = totals.filter(F.col(value) > EPS).orderBy(F.desc(value), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), key)))


def overall(events: DataFrame) -> DataFrame:
    """Total revenue and quantity: one row."""
    return events.filter(F.col("product_id").isNotNull()).agg(F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("total_revenue"), F.round(F.coalesce(F.sum("signed_qty"), F.lit(0.0)), 2).alias("total_quantity"))


def by_category(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Revenue of each catalog category; products that the catalog lacks are ``Other``."""
    named = events.filter(F.col("product_id").isNotNull()).groupBy("product_id").agg(F.sum("amount").alias("amount"))
    return named.join(catalog.select("product_id", "category"), "product_id", "left").groupBy(F.coalesce("category", F.lit("Other")).alias("category")).agg(F.round(F.sum("amount"), 2).alias("revenue"))


def average_order(events: DataFrame) -> DataFrame:
    """Spend of each customer over their distinct orders (one at least)."""
    orders = F.greatest(F.count_distinct(F.when(F.col("signed_qty") != 0, F.col("order_id"))), F.lit(1))
    spent = events.groupBy("customer_id").agg(F.sum("amount").alias("spend"), orders.alias("orders"))
    return spent.filter(F.col("spend") > EPS).select("customer_id", F.round(F.col("spend") / F.col("orders"), 2).alias("aov"))


def transcript_line() -> Column:
    """One line of prose for an event."""
    op = F.col("op")
    who, what = F.col("customer_id").cast("string"), F.col("product_id").cast("string")
    number = F.format_string("%.2f", F.col("qty"))
    return (
        F.when(op.isin(*ADDS), F.concat_ws(" ", who, F.lit("takes"), number, F.lit("of"), what))
        .when(op.isin(*TAKES), F.concat_ws(" ", who, F.lit("gives back"), number, F.lit("of"), what))
        .when(op == "modify_item", F.concat_ws(" ", who, F.lit("changes"), what, F.lit("from"), F.format_string("%.2f", F.col("old_qty")), F.lit("to"), F.format_string("%.2f", F.col("new_qty"))))
        .when(op == "confirm_payment", F.concat_ws(" ", who, F.lit("pays"), F.format_string("%.2f", F.col("unit_price"))))
        .otherwise(F.concat_ws(" ", F.lit("stock of"), what, F.lit("is corrected")))
    )


def answers(events: DataFrame, catalog: DataFrame) -> dict[str, DataFrame]:
    """The ten analytics of a log, by question."""
    log = signed(events)
    products, customers = by_product(log), by_customer(log)
    total = overall(log)
    return {
        "Q1": products.filter(F.col("quantity") > EPS).select("product_id", "quantity"),
        "Q2": products.filter(F.col("revenue") > EPS).select("product_id", "revenue"),
        "Q3": customers.filter(F.col("quantity") > EPS).select("customer_id", "quantity"),
        "Q4": customers.filter(F.col("revenue") > EPS).select("customer_id", "revenue"),
        "Q5": top(products, "revenue", 5).select("rank", "product_id", "revenue"),
        "Q6": top(products, "quantity", 5).select("rank", "product_id", "quantity"),
        "Q7": total.select("total_revenue"),
        "Q8": total.select("total_quantity"),
        "Q9": by_category(log, catalog).filter(F.col("revenue") > EPS),
        "Q10": average_order(log),
    }


EVENTS = "session_id string, time_idx int, op string, order_id string, customer_id string, product_id string, qty double, old_qty double, new_qty double, unit_price double"


def simulate(catalog: DataFrame, sessions: int, turns: int, customers: int = 5, seed: int = 42, p_modify: float = 0.15, p_return: float = 0.1, p_adjust: float = 0.05, most_items: int = 3) -> DataFrame:
    """Made-up event logs: a row an event, the same for the same seed, whatever the partitions.

    ``catalog`` has product_id and price and must be small enough for one Python list (10,000 rows).
    A customer orders, changes or returns what they have; stock corrections name no customer."""
    products = [(r.product_id, float(r.price)) for r in catalog.select("product_id", "price").orderBy("product_id").limit(10_001).collect()]
    if not 0 < len(products) <= 10_000:
        raise ValueError("the catalog needs 1 to 10000 products")
    names = [f.split()[0] for f in EVENTS.split(", ")]

    def one(session: str) -> list[tuple]:
        rng, rows, held = random.Random(f"{seed}|{session}"), [], {}
        for turn in range(turns):
            who, draw = f"C{rng.randrange(customers) + 1}", rng.random()
            mine = sorted(k for k, q in held.items() if k[0] == who and q > 0)
            product, price = products[rng.randrange(len(products))]
            if draw < p_adjust:
                rows.append((session, len(rows), "inventory_adjustment", None, None, product, float(rng.randrange(1, 20)), None, None, price))
            elif draw < p_adjust + p_modify and mine:
                key = mine[rng.randrange(len(mine))]
                old, new = held[key], float(rng.randrange(1, 9))
                held[key] = new
                rows.append((session, len(rows), "modify_item", key[2], who, key[1], None, old, new, dict(products)[key[1]]))
            elif draw < p_adjust + p_modify + p_return and mine:
                key = mine[rng.randrange(len(mine))]
                back = float(rng.randrange(1, int(held[key]) + 1))
                held[key] -= back
                rows.append((session, len(rows), "return_item", key[2], who, key[1], back, None, None, dict(products)[key[1]]))
            else:
                order = f"{session}-O{turn}"
                for n in range(rng.randrange(1, most_items + 1)):
                    product, price = products[rng.randrange(len(products))]
                    qty = float(rng.randrange(1, 6))
                    held[who, product, order] = held.get((who, product, order), 0.0) + qty
                    rows.append((session, len(rows), "add_item" if n else "place_order", order, who, product, qty, None, None, price))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                columns = list(zip(*one(f"session_{i + 1:03d}"), strict=True))
                kinds = [pa.string(), pa.int32(), *[pa.string()] * 4, *[pa.float64()] * 4]
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return catalog.sparkSession.range(sessions).mapInArrow(run, EVENTS)

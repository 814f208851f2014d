"""Time Q11 two ways at one scale factor: per-product pre-aggregates (ours)
versus the literal five-table fan-out join the reference sends.

usage: python scripts/q11_fanout.py [sf_dir]
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shopfront.operators import kpis  # noqa: E402
from shopfront.session import local_session  # noqa: E402
from shopfront.sources.fixtures import Shop  # noqa: E402


def literal_fan_out(s: Shop):
    p, oi, o, r, w = s.products, s.order_items, s.orders, s.reviews, s.wishlist
    j = (p.alias("p").join(oi.alias("oi"), F.col("p.id") == F.col("oi.product_id"), "left")
         .join(o.alias("o"), F.col("oi.order_id") == F.col("o.id"), "left")
         .join(r.alias("r"), F.col("p.id") == F.col("r.product_id"), "left")
         .join(w.alias("w"), F.col("p.id") == F.col("w.product_id"), "left"))
    return j.groupBy("p.id", "p.name", "p.price").agg(
        F.count_distinct("o.id").alias("total_orders"),
        F.sum("oi.quantity").alias("total_units_sold"),
        F.sum(F.col("oi.quantity") * F.col("oi.price_at_time")).alias("total_revenue"),
        F.coalesce(F.avg("r.rating"), F.lit(0.0)).alias("average_rating"),
        F.count_distinct("r.id").alias("review_count"),
        F.count_distinct("w.id").alias("wishlist_count"))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8)
    s = Shop.of(spark, sf)
    plans = {
        "pre_aggregated": lambda: kpis.product_performance(s.products, s.order_items, s.reviews, s.wishlist,
                                                           as_written=True, sort=False),
        "literal_fan_out": lambda: literal_fan_out(s),
    }
    for name, build in plans.items():
        best = None
        for _ in range(3):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - t0)
        print(f"{name}: {best:.2f}s")


if __name__ == "__main__":
    main()

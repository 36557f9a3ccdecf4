"""Entity folds as set operations: cart totals as of each add, greedy refund admission, order status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cart_timeline(adds: DataFrame) -> DataFrame:
    """adds(cart_id, product_id, position, quantity, unit_price) -> (cart_id, seq, subtotal as of that add).

    A later add of a product replaces its line; the change of each line, summed up along the cart, is the subtotal.
    """
    numbered = adds.withColumn("seq", F.row_number().over(W.partitionBy("cart_id").orderBy("position"))).withColumn("line_total", F.col("quantity") * F.col("unit_price"))
    line = F.lag("line_total").over(W.partitionBy("cart_id", "product_id").orderBy("seq"))
    change = numbered.withColumn("change", F.col("line_total") - F.coalesce(line, F.lit(0)))
    return change.select("cart_id", "seq", F.sum("change").over(W.partitionBy("cart_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)).alias("subtotal"))


def admit_refunds(refunds: DataFrame, orders: DataFrame) -> DataFrame:
    """refunds(order_id, seq, amount), orders(order_id, paid) -> (order_id, seq, amount, admitted).

    In order of seq a refund is admitted if it and those admitted before it don't exceed what was paid; a rejected one
    uses up nothing. A fold over each order's few refunds; refunds without an order are rejected.
    """
    money = "decimal(28,2)"
    step = lambda acc, r: F.when(
        acc["total"] + r["amount"] <= F.col("paid"),
        F.struct((acc["total"] + r["amount"]).cast(money).alias("total"), F.concat(acc["admitted"], F.array(r["seq"])).alias("admitted")),
    ).otherwise(acc)
    start = F.struct(F.lit(0).cast(money).alias("total"), F.array().cast("array<int>").alias("admitted"))
    folded = (
        refunds.groupBy("order_id").agg(F.array_sort(F.collect_list(F.struct("seq", "amount"))).alias("all"))
        .join(orders, "order_id", "left")
        .withColumn("fold", F.aggregate("all", start, step))
    )
    return folded.select("order_id", F.explode("all").alias("r"), "fold").select("order_id", "r.seq", "r.amount", F.array_contains("fold.admitted", F.col("r.seq")).alias("admitted"))


def order_status(orders: DataFrame, admitted: DataFrame) -> DataFrame:
    """(order_id, refunded, status): paid, partially_refunded or refunded by what was admitted."""
    total = admitted.where("admitted").groupBy("order_id").agg(F.sum("amount").cast("decimal(28,2)").alias("refunded"))
    refunded = F.coalesce("refunded", F.lit(0).cast("decimal(28,2)"))
    return orders.join(total, "order_id", "left").select(
        "order_id", refunded.alias("refunded"), F.when(refunded == 0, "paid").when(refunded == F.col("paid"), "refunded").otherwise("partially_refunded").alias("status")
    )


def refund_frequency(refunds: DataFrame, days: int, least: int) -> DataFrame:
    """Per customer: refunds, the most within ``days`` up to one of them, and how many had at least ``least``."""
    recent = W.partitionBy("customer_id").orderBy(F.unix_seconds("requested_at")).rangeBetween(-days * 86_400, 0)
    counted = refunds.withColumn("requested_at", F.col("requested_at").cast("timestamp")).withColumn("recent", F.count("*").over(recent))
    return counted.groupBy("customer_id").agg(F.count("*").alias("refunds"), F.max("recent").alias("most_recent"), F.count_if(F.col("recent") >= least).alias("abusive"))

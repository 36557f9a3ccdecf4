"""Admission of entities in order of arrival: sessions, views, cart states, orders and payments, each judged by what came before.

A row's ``seq`` is its place in arrival order; a parent counts if its own seq is smaller. Every input row has one row
in the result, with its outcome; null keys have no parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .history import first_registration

MONEY = "decimal(28,2)"


def with_parent(rows: DataFrame, parents: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the boolean ``name``: whether a parent of the same key arrived before. Parents are reduced to their first arrival."""
    first = parents.groupBy(F.col(key).alias("__key")).agg(F.min("seq").alias("__first"))
    joined = rows.join(first, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(name, F.coalesce(F.col("__first") < F.col("seq"), F.lit(False))).drop("__key", "__first")


def admit_sessions(sessions: DataFrame, customers: DataFrame, identity: list[str]) -> DataFrame:
    """sessions(session_id, customer_id, seq, identity...), customers(customer_id, seq) -> sessions with outcome.

    missing_customer without an earlier customer; of the others the first of a session_id is registered, a later one is
    repeated if its identity (null equals null) agrees, else conflict. Rows that are equal throughout are all the first.
    """
    judged = with_parent(sessions, customers, "customer_id", "__parent")
    known = first_registration(judged.where("__parent and session_id is not null").drop("__parent"), "session_id", ["seq"], ["customer_id", *identity])
    orphans = judged.where("not __parent").drop("__parent").withColumn("outcome", F.lit("missing_customer"))
    unnamed = judged.where("__parent and session_id is null").drop("__parent").withColumn("outcome", F.lit("conflict"))
    return known.select(*sessions.columns, "outcome").unionByName(orphans).unionByName(unnamed)


def admit_views(views: DataFrame, customers: DataFrame, sessions: DataFrame) -> DataFrame:
    """views(customer_id, session_id, seq, ...) -> views with outcome missing_customer, missing_session or recorded.

    sessions are the registered ones; only their existence is asked, not whose they are. Views are appended: repeats stay.
    """
    judged = with_parent(with_parent(views, customers, "customer_id", "__customer"), sessions, "session_id", "__session")
    outcome = F.when(~F.col("__customer"), "missing_customer").when(~F.col("__session"), "missing_session").otherwise("recorded")
    return judged.select(*views.columns, outcome.alias("outcome"))


def cart_states(adds: DataFrame, marks: DataFrame) -> DataFrame:
    """The state of a cart as of each add and mark: (cart_id, seq, kind, lines, subtotal, item_count, discount, total, status).

    adds(cart_id, product_id, seq, quantity, unit_price): a later add of a product replaces its line. marks(cart_id, seq,
    kind, discount): ``checkout`` starts the checkout and sets the discount, ``order`` closes the cart, any other kind
    changes nothing and only reads the state. Totals follow adds after a checkout too. seq is unique within a cart;
    a cart without adds has no lines and totals of zero. Two shuffles, by (cart, product) and by cart.
    """
    same = W.partitionBy("cart_id", "product_id").orderBy("seq")
    before = lambda column: F.coalesce(F.lag(column).over(same), F.lit(0))
    added = adds.withColumn("__total", F.col("quantity") * F.col("unit_price")).select(
        "cart_id", "seq", F.lit("add").alias("kind"), F.lit(None).cast(MONEY).alias("discount"), F.when(F.row_number().over(same) == 1, 1).otherwise(0).alias("__lines"),
        (F.col("__total") - before("__total")).cast(MONEY).alias("__change"), (F.col("quantity") - before("quantity")).cast("long").alias("__units"),
    )
    marked = marks.select(
        "cart_id", "seq", "kind", F.when(F.col("kind") == "checkout", F.col("discount")).cast(MONEY).alias("discount"),
        F.lit(0).alias("__lines"), F.lit(0).cast(MONEY).alias("__change"), F.lit(0).cast("long").alias("__units"),
    )
    so_far = W.partitionBy("cart_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    subtotal, discount = F.sum("__change").over(so_far).cast(MONEY), F.coalesce(F.last("discount", ignorenulls=True).over(so_far), F.lit(0)).cast(MONEY)
    seen = lambda kind: F.max(F.col("kind") == kind).over(so_far)
    return added.unionByName(marked).select(
        "cart_id", "seq", "kind", F.sum("__lines").over(so_far).alias("lines"), subtotal.alias("subtotal"), F.sum("__units").over(so_far).alias("item_count"), discount.alias("discount"),
        (subtotal - discount).cast(MONEY).alias("total"), F.when(seen("order"), "ordered").when(seen("checkout"), "checkout_started").otherwise("active").alias("status"),
    )


def _first_sound(rows: DataFrame, key: str, fault: Column) -> DataFrame:
    """rows with outcome: their fault, or admitted for the first faultless row of a key and conflict for those after it.

    Faulty rows count in a group of their own, so that they take no place from a later sound one.
    """
    faulted = rows.withColumn("__fault", fault)
    sound = F.col("__fault").isNull()
    place = F.row_number().over(W.partitionBy(key, sound, F.when(~sound, F.col("seq"))).orderBy("seq"))
    outcome = F.coalesce("__fault", F.when(place == 1, "admitted").otherwise("conflict"))
    return faulted.withColumn("outcome", outcome).drop("__fault")


def admit_orders(orders: DataFrame, adds: DataFrame, checkouts: DataFrame, owners: DataFrame) -> DataFrame:
    """orders(order_id, cart_id, seq, customer_id, currency, subtotal, discount, total, item_count) with outcome.

    missing_cart: no add before; contradicted: owner (owners(cart_id, customer_id, currency)), totals, discount or
    item_count differ from the cart's state as of the order, or nothing was checked out; conflict: its order_id was
    admitted before; else admitted. A null that should be compared contradicts.
    """
    states = cart_states(adds, checkouts.unionByName(orders.select("cart_id", "seq", F.lit("claim").alias("kind"), F.lit(None).cast(MONEY).alias("discount"))))
    there = states.where("kind = 'claim'").drop("kind").alias("s")
    o, w = orders.alias("o"), owners.alias("w")
    met = o.join(there, (F.col("o.cart_id") == F.col("s.cart_id")) & (F.col("o.seq") == F.col("s.seq")), "left").join(w, F.col("o.cart_id") == F.col("w.cart_id"), "left")
    equal = F.col("s.status") == "checkout_started"
    for column in ("subtotal", "discount", "total", "item_count"):
        equal &= F.col(f"o.{column}") == F.col(f"s.{column}")
    for column in ("customer_id", "currency"):
        equal &= F.col(f"o.{column}") == F.col(f"w.{column}")
    fault = F.when(F.coalesce(F.col("s.lines"), F.lit(0)) == 0, "missing_cart").when(~F.coalesce(equal, F.lit(False)), "contradicted")
    return _first_sound(met.select("o.*", fault.alias("__why")), "order_id", F.col("__why")).drop("__why")


def admit_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """payments(payment_id, order_id, seq, customer_id, amount, currency, status) with outcome.

    orders(order_id, seq, customer_id, total, currency), one row an order. missing_order: none arrived before;
    contradicted: customer, amount or currency differ (a null differs); conflict: its payment_id was admitted before.
    """
    p, o = payments.alias("p"), orders.alias("o")
    met = p.join(o, F.col("p.order_id") == F.col("o.order_id"), "left")
    equal = (F.col("p.customer_id") == F.col("o.customer_id")) & (F.col("p.amount") == F.col("o.total")) & (F.col("p.currency") == F.col("o.currency"))
    fault = F.when(~F.coalesce(F.col("o.seq") < F.col("p.seq"), F.lit(False)), "missing_order").when(~F.coalesce(equal, F.lit(False)), "contradicted")
    return _first_sound(met.select("p.*", fault.alias("__why")), "payment_id", F.col("__why")).drop("__why")


def paid_orders(orders: DataFrame, admitted: DataFrame) -> DataFrame:
    """(order_id, status): paid if a completed payment of it was admitted, else pending."""
    done = admitted.where("outcome = 'admitted' and status = 'completed'").select(F.col("order_id").alias("__paid")).distinct()
    return orders.join(done, F.col("order_id") == F.col("__paid"), "left").select("order_id", F.when(F.col("__paid").isNull(), "pending").otherwise("paid").alias("status"))


def recent_count(rows: DataFrame, key: str, at: str, days: int, cap: int, name: str) -> DataFrame:
    """rows with ``name``: how many rows of the key lie in [at - days, at], itself included, at most cap (the feature's limit)."""
    recent = W.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-days * 86_400_000_000, 0)
    return rows.withColumn(name, F.least(F.count("*").over(recent), F.lit(cap)))

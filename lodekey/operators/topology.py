"""Routing of keys to partitions, splits, and what a request touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodekey.functions.hashing import bucket
from lodekey.functions.partition_ids import range_name
from lodekey.schema import SPLIT_SLACK
from lodekey.sources.written import written

READY, FORWARD, OVER_SIZE, OUT_OF_RANGE = "ok", "forward", "reject_over_size", "reject_out_of_range"


def root_of(hk: Column, roots: int) -> Column:
    return bucket(hk, 0, roots)


def route_hash(items: DataFrame, roots: int, fan_out: int, split: DataFrame | None = None) -> DataFrame:
    """Adds ``partition``, the name of each row's hash leaf.

    ``split`` lists names of partitions that have split (``name``); a row
    goes down while the one that it is in has.  One join a level, as many as
    the deepest of them has.
    """
    out = items.withColumn("partition", F.concat(F.lit("h."), root_of(F.col("hk"), roots).cast("string")))
    if split is not None:
        names = split.select(F.col("name").alias("_split")).distinct()
        deepest = names.agg(F.max(F.size(F.split("_split", r"\."))).alias("n")).first()["n"] or 1
        for d in range(deepest - 1):
            out = out.join(names, F.col("partition") == F.col("_split"), "left").withColumn("partition", F.when(F.col("_split").isNotNull(), F.concat("partition", F.lit("."), bucket(F.col("hk"), d + 1, fan_out).cast("string"))).otherwise(F.col("partition"))).drop("_split")
    return out


def route(items: DataFrame, roots: int, fan_out: int, split: DataFrame, promoted: DataFrame, leaves: DataFrame, table: str) -> DataFrame:
    """Adds ``partition``: of promoted keys their range leaf, of all others their hash leaf.

    ``promoted`` has ``hk`` and ``status``; from ``promoting`` on a key's rows
    are in its range tree, whose slices ``leaves`` has (``hk``, ``start``,
    ``end``; no bytes: open).
    """
    moved = promoted.filter(F.col("status").isin("promoting", "promoted")).select("hk").distinct()
    known = moved.join(leaves.select("hk", "start", "end"), "hk", "left").select("hk", F.coalesce("start", F.lit(b"")).alias("start"), F.coalesce("end", F.lit(b"")).alias("end"))
    bound = lambda c: F.when(F.octet_length(c) > 0, F.col(c))
    named = known.withColumn("child", range_name(table, F.col("hk"), bound("start"), bound("end")))
    ranged = route_range(items, named).withColumn("partition", F.col("child")).drop("child", "start", "end")
    hashed = route_hash(items.join(moved, "hk", "left_anti"), roots, fan_out, split)
    return hashed.withColumn("partition", F.concat(F.lit(f"{table}."), "partition")).select(ranged.columns).unionByName(ranged)


def route_range(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each row with the leaf of its key whose slice [start, end) holds it."""
    owned = leaves.select(F.col("hk").alias("l_hk"), "child", "start", "end")
    inside = (F.col("sk") >= F.col("start")) & ((F.octet_length("end") == 0) | (F.col("sk") < F.col("end")))
    return rows.join(owned, (F.col("hk") == F.col("l_hk")) & inside).drop("l_hk")


def deepest_slice(probes: DataFrame, slices: DataFrame) -> DataFrame:
    """For each probe the deepest known slice that holds it, if any."""
    s = slices.select(F.col("hk").alias("s_hk"), "sk_start_boundary", "sk_end_boundary", "depth")
    inside = (F.col("sk") >= F.col("sk_start_boundary")) & ((F.octet_length("sk_end_boundary") == 0) | (F.col("sk") < F.col("sk_end_boundary")))
    m = probes.join(s, (F.col("hk") == F.col("s_hk")) & inside)
    best = m.groupBy("hk", "sk").agg(F.max_by(F.struct("sk_start_boundary", "sk_end_boundary", "depth"), "depth").alias("b")).select("hk", "sk", "b.*")
    return probes.join(best, ["hk", "sk"], "left")


def partition_stats(routed: DataFrame) -> DataFrame:
    return routed.groupBy("partition").agg(F.count("*").alias("n_items"), F.countDistinct("hk").alias("n_keys"), F.sum("est_row_bytes").alias("bytes"))


def admission(stats: DataFrame, max_bytes: int, write: bool = True) -> DataFrame:
    """What a partition does with a request.

    ``stats`` has ``bytes``, ``split`` (has children) and ``in_range``.
    """
    return stats.withColumn(
        "admission",
        F.when(~F.col("in_range"), OUT_OF_RANGE).when(F.col("split"), FORWARD).when(F.lit(write) & (F.col("bytes") > max_bytes * SPLIT_SLACK), OVER_SIZE).otherwise(READY),
    )


def split_decisions(stats: DataFrame, max_bytes: int, promoting: DataFrame | None = None) -> DataFrame:
    """Partitions over their size, unless a promotion in them is under way."""
    over = stats.withColumn("over", F.col("bytes") > max_bytes)
    if promoting is None:
        return over.select("partition", "bytes", F.col("over").alias("split"))
    busy = promoting.select(F.col("partition").alias("b_partition")).distinct()
    m = over.join(busy, F.col("partition") == F.col("b_partition"), "left")
    return m.select("partition", "bytes", (F.col("over") & F.col("b_partition").isNull()).alias("split"))


def split_progress(acks: DataFrame, fan_out: int) -> DataFrame:
    """State of each split from its children's acknowledgements; repeats don't count."""
    n = acks.groupBy("partition").agg(F.countDistinct(F.when(F.col("acked"), F.col("child"))).alias("done"))
    return n.withColumn("state", F.when(F.col("done") == 0, "queued").when(F.col("done") < fan_out, "started").otherwise("completed"))


def owned_by_child(items: DataFrame, depth: int, fan_out: int, child: int) -> DataFrame:
    """Rows that a hash split gives to one child."""
    return items.filter(bucket(F.col("hk"), depth + 1, fan_out) == child)


def promotions(heavy: DataFrame, promoted: DataFrame, locks: DataFrame) -> DataFrame:
    """Heavy keys that can change over now: not promoted yet and without locks."""
    fresh = heavy.join(promoted.filter("status = 'promoted'").select("hk"), "hk", "left_anti")
    return fresh.join(locks.select("hk"), "hk", "left_anti")


def insert_promotions(promoted: DataFrame, new: DataFrame, now_ms: int) -> DataFrame:
    """``promoted`` with those of ``new`` (``hk``, ``status``) whose key it hasn't; a key that is there stays as it is."""
    fresh = new.groupBy("hk").agg(F.min("status").alias("status")).join(promoted.select("hk"), "hk", "left_anti")
    return promoted.unionByName(fresh.select("hk", "status", F.lit(now_ms).cast("long").alias("updated_at"), F.lit(False).alias("gc_done")))


def guarded_transition(promoted: DataFrame, changes: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Sets ``status`` to ``to_status`` only where it is ``from_status``; ``updated`` says where."""
    m = promoted.join(changes.select("hk", "from_status", "to_status"), "hk", "left")
    m = m.withColumn("updated", F.coalesce(F.col("status") == F.col("from_status"), F.lit(False)))
    if now_ms is not None:
        m = m.withColumn("updated_at", F.when(F.col("updated"), F.lit(now_ms).cast("long")).otherwise(F.col("updated_at")))
    return m.withColumn("status", F.when(F.col("updated"), F.col("to_status")).otherwise(F.col("status"))).drop("from_status", "to_status")


def in_flight(promoted: DataFrame) -> DataFrame:
    return promoted.filter(F.col("status").isin("queued", "promoting"))


def needing_gc(promoted: DataFrame, most: int | None = None) -> DataFrame:
    """Promoted keys whose rows are still in their old partition too."""
    left = promoted.filter("status = 'promoted' and not gc_done").select("hk")
    return left if most is None else left.orderBy("hk").limit(most)


def mark_gc_done(promoted: DataFrame, done: DataFrame) -> DataFrame:
    hit = done.select("hk", F.lit(True).alias("_done")).distinct()
    return promoted.join(hit, "hk", "left").withColumn("gc_done", F.col("gc_done") | F.coalesce("_done", F.lit(False))).drop("_done")


def promoted_page(promoted: DataFrame, n: int, after: bytes | None = None) -> DataFrame:
    rows = promoted if after is None else promoted.filter(F.col("hk") > F.lit(after))
    return rows.select("hk", "status").orderBy("hk").limit(n)


def learn_slices(hierarchy: DataFrame, new: DataFrame) -> DataFrame:
    """``hierarchy`` with the slices that it doesn't know yet."""
    key = ["hk", "depth", "sk_start_boundary", "sk_end_boundary"]
    return hierarchy.select(key).unionByName(new.select(key).distinct().join(hierarchy.select(key), key, "left_anti"))


def ancestors_above(hierarchy: DataFrame, leaves: DataFrame) -> DataFrame:
    """For each leaf (``hk``, ``leaf_depth``) the known slices above it, with ``nth`` from the root."""
    m = leaves.select("hk", "leaf_depth").join(hierarchy, "hk").filter(F.col("depth") < F.col("leaf_depth"))
    order = Window.partitionBy("hk", "leaf_depth").orderBy("depth", "sk_start_boundary")
    return m.withColumn("nth", F.row_number().over(order))


def select_ancestors(hierarchy: DataFrame, from_root: int, from_leaf: int, key: str = "leaf") -> DataFrame:
    """Of each leaf's ancestors the shallowest and the deepest few, by depth.

    The slice at depth 0 isn't one of them.
    """
    up, down = Window.partitionBy(key).orderBy("depth"), Window.partitionBy(key).orderBy(F.desc("depth"))
    ranked = hierarchy.filter("depth > 0").dropDuplicates([key, "depth"]).withColumns({"_a": F.row_number().over(up), "_d": F.row_number().over(down)})
    return ranked.filter((F.col("_a") <= from_root) | (F.col("_d") <= from_leaf)).drop("_a", "_d")


def is_strict_slice(start: Column, end: Column, p_start: Column, p_end: Column) -> Column:
    """Whether [start, end) is inside the parent's slice and isn't all of it."""
    inside = (start >= p_start) & ((F.octet_length(p_end) == 0) | ((F.octet_length(end) > 0) & (end <= p_end)))
    return inside & ~((start == p_start) & (end == p_end))


def destroy_order(partitions: DataFrame) -> DataFrame:
    """``step`` of each partition in a removal of children before parents.

    ``partitions`` has ``name``, ``parent`` (null for roots) and ``status``;
    queued promotions have made nothing yet.  Each round doubles how far up a
    row has looked, so rounds grow with the logarithm of the depth, and ends
    with a written table.  Partitions under none that is there are left out.
    """
    made = partitions.filter("status <> 'queued'").dropDuplicates(["name"])
    rows = written(made.select("name", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("level")), "levels")
    rounds = rows.count().bit_length() + 1
    while not rows.filter("up is not null").isEmpty():
        if not rounds:
            raise ValueError("partitions are their own ancestors")
        rounds -= 1
        above = rows.select(F.col("name").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        done = rows.filter("up is null")
        rows = written(done.unionByName(rows.join(above, "up").select("name", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))), "levels")
    deepest = rows.agg(F.max("level").alias("n")).first()["n"]
    return rows.select("name", "level", (F.lit(deepest) - F.col("level")).alias("step"))

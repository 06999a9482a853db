"""Coordinators of transactions: their table, and the steps that they may take.

A row of the table is a transaction with its state; ``participants`` has a
row per transaction and partition with that partition's ``vote`` (null: none
yet) and whether it is ``done``.  A step changes a state only from one that
may come before it, so steps can be repeated and can come late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.plans.conditions import request_fingerprint
from lodekey.schema import REASONS

# What may come after each state.
STEPS = {
    "CREATED": ("PREPARING",),
    "PREPARING": ("PREPARED", "CANCELLING"),
    "PREPARED": ("COMMITTING",),
    "COMMITTING": ("COMMITTED",),
    "CANCELLING": ("CANCELLED",),
    "COMMITTED": (),
    "CANCELLED": (),
}
MOST_ATTEMPTS = 10
TRANSIENT = REASONS[-1]


def create(transactions: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """``transactions`` with a row for each of ``requests`` that it hasn't."""
    new = requests.groupBy("transaction_id").agg(F.max("transaction_ts").alias("transaction_ts")).join(request_fingerprint(requests), "transaction_id")
    fresh = new.join(transactions.select("transaction_id"), "transaction_id", "left_anti")
    return transactions.unionByName(fresh.select("transaction_id", "transaction_ts", "operations_hash", F.lit("CREATED").alias("state"), F.lit(None).cast("string").alias("reason"), F.lit(now_ms).cast("long").alias("created_at")))


def participants(requests: DataFrame) -> DataFrame:
    """The partitions of each transaction, with their number of items."""
    return requests.groupBy("transaction_id", "partition_id").agg(F.count("*").alias("items"))


def advance(transactions: DataFrame, changes: DataFrame) -> DataFrame:
    """States after ``changes`` (``transaction_id``, ``to_state``, ``reason``); ``moved`` says which held."""
    allowed = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.array(*map(F.lit, v)).cast("array<string>")) for k, v in STEPS.items()]))
    m = transactions.join(changes.select("transaction_id", "to_state", F.col("reason").alias("new_reason")), "transaction_id", "left")
    m = m.withColumn("moved", F.coalesce(F.array_contains(allowed[F.col("state")], F.col("to_state")), F.lit(False)))
    return m.withColumns({"state": F.when(F.col("moved"), F.col("to_state")).otherwise(F.col("state")), "reason": F.when(F.col("moved"), F.coalesce("reason", "new_reason")).otherwise(F.col("reason"))}).drop("to_state", "new_reason")


def record_votes(voters: DataFrame, cast: DataFrame) -> DataFrame:
    """First votes stay; one of ``transient_error`` counts as none until its last attempt.

    ``cast`` has ``vote`` (yes, or a reason) and ``attempt``, from 1.
    """
    new = cast.select("transaction_id", "partition_id", F.when((F.col("vote") == TRANSIENT) & (F.col("attempt") < MOST_ATTEMPTS), F.lit(None)).otherwise(F.col("vote")).alias("new_vote"))
    return voters.join(new, ["transaction_id", "partition_id"], "left").withColumn("vote", F.coalesce("vote", "new_vote")).drop("new_vote")


def next_steps(transactions: DataFrame, voters: DataFrame) -> DataFrame:
    """The step that each transaction is due: changes for ``advance``.

    All yes: prepared, then committing; any reason: cancelling, with that of
    the first partition by name; all done: at its end.
    """
    no = F.col("vote").isNotNull() & (F.col("vote") != "yes")
    sums = voters.groupBy("transaction_id").agg(
        F.bool_and(F.coalesce(F.col("vote") == "yes", F.lit(False))).alias("all_yes"),
        F.min_by("vote", F.when(no, F.col("partition_id"))).alias("no"),
        F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"),
    )
    m = transactions.join(sums, "transaction_id")
    to = (
        F.when(F.col("state") == "CREATED", "PREPARING")
        .when((F.col("state") == "PREPARING") & F.col("no").isNotNull(), "CANCELLING")
        .when((F.col("state") == "PREPARING") & F.col("all_yes"), "PREPARED")
        .when(F.col("state") == "PREPARED", "COMMITTING")
        .when((F.col("state") == "COMMITTING") & F.col("all_done"), "COMMITTED")
        .when((F.col("state") == "CANCELLING") & F.col("all_done"), "CANCELLED")
    )
    return m.select("transaction_id", to.alias("to_state"), F.when(to == "CANCELLING", F.col("no")).alias("reason")).filter("to_state is not null")

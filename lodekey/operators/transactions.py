"""Multi-item transactions by timestamp order, on sets of transactions.

Requests are rows of ``schema.TX_ITEM``: an item of a transaction each, with
the partition that it lives in and its place in the request.  Items carry
``v`` and ``last_transaction_ts``, locks are rows of ``schema.PENDING``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodekey.functions import sizes
from lodekey.plans.conditions import first_failing, request_fingerprint
from lodekey.schema import MAX_CLOCK_SKEW_MS, STALE_LOCK_MS

TERMINAL = ("COMMITTED", "CANCELLED")


def prepare_items(requests: DataFrame, items: DataFrame, locks: DataFrame, watermarks: DataFrame, now_ms: int) -> DataFrame:
    """``reason`` why each item can't be prepared; null if it can.

    In this order: a lock of the same transaction ends the checks; another's
    conflicts; then conditions; then the item's time, or for an absent item
    the partition's deletion watermark, must be below the transaction's.  A
    time too far ahead of the clock goes before all.
    """
    now = items.select("hk", "sk", "v", "last_transaction_ts")
    held = locks.groupBy("hk", "sk").agg(F.collect_set("transaction_id").alias("holders"))
    m = requests.join(now, ["hk", "sk"], "left").join(held, ["hk", "sk"], "left").join(watermarks.select("partition_id", "max_deleted_ts"), "partition_id", "left")
    ts = F.col("transaction_ts")
    own = F.coalesce(F.array_contains("holders", F.col("transaction_id")), F.lit(False))
    reason = (
        F.when(ts > now_ms + MAX_CLOCK_SKEW_MS, "clock_skew")
        .when(own, F.lit(None))
        .when(F.col("holders").isNotNull(), "pending_conflict")
        .when(first_failing(F.col("conditions"), F.col("v")).isNotNull(), "condition_failed")
        .when(F.col("v").isNotNull() & (ts <= F.col("last_transaction_ts")), "timestamp_conflict")
        .when(F.col("v").isNull() & (ts <= F.col("max_deleted_ts")), "timestamp_conflict")
    )
    return m.withColumns({"reason": reason, "already_locked": own}).drop("holders")


def votes(prepared: DataFrame) -> DataFrame:
    """Each participant's vote: the reason of its first failing item, or null."""
    return prepared.groupBy("transaction_id", "partition_id").agg(F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("ordinal"))).alias("reason"))


def decide(cast: DataFrame) -> DataFrame:
    """Commit if no participant rejects; else the first one's reason, by its name."""
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("partition_id")))
    return cast.groupBy("transaction_id").agg(first.alias("reason"), F.count("*").alias("participants")).withColumn("outcome", F.when(F.col("reason").isNull(), "committed").otherwise("cancelled"))


def new_locks(prepared: DataFrame, decisions: DataFrame, now_ms: int) -> DataFrame:
    """Locks that committed decisions take; a check takes one too."""
    won = decisions.filter("outcome = 'committed'").select("transaction_id")
    fresh = prepared.filter(~F.col("already_locked")).join(won, "transaction_id", "left_semi")
    return fresh.select("hk", "sk", "transaction_id", "transaction_ts", F.lit(now_ms).cast("long").alias("created_at"), "operation", "data_kind", "data_bin", "data_text")


def independent(requests: DataFrame) -> DataFrame:
    """The requests whose keys no earlier transaction of the batch has.

    Transactions with keys in common are worth one wave each: apply these,
    then call again with the rest.  Order is (transaction_ts, transaction_id).
    """
    first = requests.groupBy("hk", "sk").agg(F.min(F.struct("transaction_ts", "transaction_id")).alias("head"))
    beaten = requests.join(first, ["hk", "sk"]).filter(F.struct("transaction_ts", "transaction_id") > F.col("head")).select("transaction_id").distinct()
    return requests.join(beaten, "transaction_id", "left_anti")


def apply_commits(items: DataFrame, requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """The table after committed transactions whose keys are disjoint.

    A put clears the time to live, and a check moves the item's time only.
    """
    won = requests.join(decisions.filter("outcome = 'committed'").select("transaction_id"), "transaction_id", "left_semi")
    won = won.select("hk", "sk", "operation", F.col("transaction_ts").alias("ts"), F.col("data_kind").alias("n_kind"), F.col("data_bin").alias("n_bin"), F.col("data_text").alias("n_text"))
    m = items.join(won, ["hk", "sk"], "full_outer").filter("operation is null or operation = 'put' or (operation = 'check' and v is not null)")
    put = F.coalesce(F.col("operation") == "put", F.lit(False))
    out = m.select(
        "hk",
        "sk",
        F.when(put, F.col("n_kind")).otherwise(F.col("data_kind")).alias("data_kind"),
        F.when(put, F.coalesce("v", F.lit(0)) + 1).otherwise(F.col("v")).alias("v"),
        F.greatest("last_transaction_ts", "ts").alias("last_transaction_ts"),
        F.when(~put, F.col("ttl_epoch_utc_seconds")).alias("ttl_epoch_utc_seconds"),
        F.when(put, F.col("n_bin")).otherwise(F.col("data_bin")).alias("data_bin"),
        F.when(put, F.col("n_text")).otherwise(F.col("data_text")).alias("data_text"),
    )
    return out.withColumn("est_row_bytes", sizes.row_bytes(F.col("hk"), F.col("sk"), F.col("data_bin"), F.col("data_text")))


def moved_watermarks(watermarks: DataFrame, requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Deletion watermarks after commits; a transactional delete always counts."""
    won = requests.filter("operation = 'delete'").join(decisions.filter("outcome = 'committed'").select("transaction_id"), "transaction_id", "left_semi")
    both = watermarks.select("partition_id", "max_deleted_ts").unionByName(won.select("partition_id", F.col("transaction_ts").alias("max_deleted_ts")))
    return both.groupBy("partition_id").agg(F.max("max_deleted_ts").alias("max_deleted_ts"))


def locks_match(locks: DataFrame, requests: DataFrame) -> DataFrame:
    """Transactions whose locks aren't the keys of their request, either way."""
    a, b = requests.select("transaction_id", "hk", "sk"), locks.select("transaction_id", "hk", "sk")
    on = ["transaction_id", "hk", "sk"]
    return a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti")).select("transaction_id").distinct()


def two_phase_read(requests: DataFrame, first: DataFrame, second: DataFrame, locks: DataFrame) -> DataFrame:
    """Items of a read request by ``ordinal``, with the read's ``outcome``.

    ``requests`` has ``read_id``, ``ordinal``, ``hk``, ``sk``; duplicates stay.
    A lock in the way aborts a read, as does an item that differs between the
    two phases.
    """
    a = first.select("hk", "sk", F.col("v").alias("v1"), F.col("last_transaction_ts").alias("t1"), "data_text")
    b = second.select("hk", "sk", F.col("v").alias("v2"), F.col("last_transaction_ts").alias("t2"))
    held = locks.select("hk", "sk", F.lit(True).alias("locked")).distinct()
    m = requests.join(a, ["hk", "sk"], "left").join(b, ["hk", "sk"], "left").join(held, ["hk", "sk"], "left")
    absent = lambda c: F.coalesce(F.col(c), F.lit(0))  # noqa: E731  an absent item's time is 0
    moved = ~F.col("v1").eqNullSafe(F.col("v2")) | (absent("t1") != absent("t2"))
    verdict = m.groupBy("read_id").agg(F.bool_or(F.coalesce("locked", F.lit(False))).alias("pending"), F.bool_or(moved).alias("moved"))
    verdict = verdict.select("read_id", F.when(F.col("pending"), "pending_write").when(F.col("moved"), "read_conflict").otherwise("committed").alias("outcome"))
    ok = F.col("outcome") == "committed"
    return m.join(verdict, "read_id").select("read_id", "ordinal", "hk", "sk", "outcome", F.when(ok, F.col("v1").isNotNull()).alias("found"), F.when(ok, F.col("v1")).alias("v"), F.when(ok, F.col("data_text")).alias("data_text"))


def resolve_tokens(requests: DataFrame, known: DataFrame) -> DataFrame:
    """What becomes of requests with an idempotency token.

    ``requests`` are transaction items with ``token``; ``known`` has ``token``,
    ``transaction_id``, ``operations_hash`` and ``state``.  The same token with
    other operations is rejected, with the same ones it is resumed.
    """
    tokens = requests.select("transaction_id", "token").distinct()
    hashes = tokens.join(request_fingerprint(requests), "transaction_id").select("token", F.col("operations_hash").alias("new_hash"))
    m = hashes.join(known, "token", "left")
    return m.select("token", "transaction_id", F.when(F.col("operations_hash").isNull(), "created").when(F.col("operations_hash") != F.col("new_hash"), "rejected").otherwise("resumed").alias("decision"), "state")


def response_of(state):
    """The outcome that a state stands for; PREPARED already is committed."""
    return F.when(state.isin("PREPARED", "COMMITTING", "COMMITTED"), "committed").when(state.isin("CANCELLING", "CANCELLED"), "cancelled").otherwise("in_progress")


def pending_counts(locks: DataFrame) -> DataFrame:
    """Locks of each hash key and of how many transactions they are."""
    return locks.groupBy("hk").agg(F.count("*").alias("locks"), F.countDistinct("transaction_id").alias("transactions"))


def pending_page(locks: DataFrame, n: int, after: tuple[bytes, bytes, str] | None = None) -> DataFrame:
    """The next ``n`` locks in the order of key and transaction."""
    if after is not None:
        locks = locks.filter(F.struct("hk", "sk", "transaction_id") > F.struct(*[F.lit(x) for x in after]))
    return locks.orderBy("hk", "sk", "transaction_id").limit(n)


def locks_on(locks: DataFrame, keys: DataFrame) -> DataFrame:
    """Each of ``keys`` with the transaction that holds it (the least, if several; null: none)."""
    held = locks.join(keys.select("hk", "sk").distinct(), ["hk", "sk"]).groupBy("hk", "sk").agg(F.min("transaction_id").alias("holder"))
    return keys.join(held, ["hk", "sk"], "left")


def locks_of(locks: DataFrame, transactions: DataFrame) -> DataFrame:
    """The locked items of some transactions, with what each will do."""
    return locks.join(transactions.select("transaction_id").distinct(), "transaction_id", "left_semi")


def lock_counts(locks: DataFrame) -> DataFrame:
    """Locks of each transaction."""
    return locks.groupBy("transaction_id").agg(F.count("*").alias("locks"))


def any_locks(locks: DataFrame) -> bool:
    """Reads one row, however many there are."""
    return not locks.select("transaction_id").isEmpty()


def release(locks: DataFrame, done: DataFrame) -> DataFrame:
    """The locks that are left after transactions ended."""
    return locks.join(done.select("transaction_id").distinct(), "transaction_id", "left_anti")


def stale_transactions(locks: DataFrame, now_ms: int, most: int | None = None) -> DataFrame:
    """Transactions with a lock older than allowed."""
    old = locks.filter(F.col("created_at") < now_ms - STALE_LOCK_MS).select("transaction_id").distinct()
    return old if most is None else old.limit(most)


def recover(stale: DataFrame, transactions: DataFrame) -> DataFrame:
    """What to do with stale locks: as their transaction decided; unknown ones are cancelled."""
    m = stale.join(transactions.select("transaction_id", "state"), "transaction_id", "left")
    return m.select("transaction_id", F.when(F.col("state").isNull(), "cancel").when(response_of(F.col("state")) == "committed", "commit").when(response_of(F.col("state")) == "cancelled", "cancel").otherwise("wait").alias("action"))


def unfinished(transactions: DataFrame, now_ms: int, most: int = 100) -> DataFrame:
    """Transactions to drive on: not at their end, and old enough."""
    return transactions.filter(~F.col("state").isin(*TERMINAL) & (F.col("created_at") <= now_ms - STALE_LOCK_MS)).orderBy("created_at", "transaction_id").limit(most)

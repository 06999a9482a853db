"""Ordered multi-range queries, for a page and for whole tables of requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodekey.functions import sizes
from lodekey.functions.keys import encode_key
from lodekey.plans.intervals import Condition, Interval, before_cursor, boundary_cursor, clip, intersects_column, interval_of
from lodekey.plans.pages import Cursor, PageBudget, fingerprint
from lodekey.schema import MAX_PAGE_VISITS, PAGE_ROW_OVERHEAD

MAX_BYTES_OF_ALL = 1 << 62
REQUEST = "qi int, hk binary, low binary, low_in boolean, high binary, high_in boolean, forward boolean"


@dataclass(frozen=True)
class SubQuery:
    hash_key: str | bytes
    condition: Condition | None = None
    forward: bool = True


def range_query(items: DataFrame, requests: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of each request with ``rk``, their rank in its direction, up to ``limit``.

    The key is joined by equality with the bounds beside it, so the join is
    broadcast or shuffled by the requests' size, never a nested loop.  With a
    limit each task keeps only so many items of a request before they meet.
    """
    r = requests.withColumnRenamed("hk", "r_hk")
    sk = F.col("sk")
    inside = (F.col("low").isNull() | (sk > F.col("low")) | (F.col("low_in") & (sk == F.col("low")))) & (F.col("high").isNull() | (sk < F.col("high")) | (F.col("high_in") & (sk == F.col("high"))))
    m = items.join(r, (F.col("hk") == F.col("r_hk")) & inside).drop("r_hk")
    # a request has one direction, so one of the two keys is null in all of its rows
    order = Window.partitionBy("qi", "hk").orderBy(F.when(F.col("forward"), sk).asc(), F.when(~F.col("forward"), sk).desc())
    m = m.withColumn("rk", F.row_number().over(order))
    if limit is not None:
        m = m.filter(F.col("rk") <= limit)
    return m.withColumn("rk", F.col("rk").cast("long")).drop("low", "low_in", "high", "high_in", "forward")


def top_per_key(items: DataFrame, k: int, forward: bool = True) -> DataFrame:
    """The first ``k`` items of every hash key."""
    order = F.col("sk").asc() if forward else F.col("sk").desc()
    return items.withColumn("rk", F.row_number().over(Window.partitionBy("hk").orderBy(order))).filter(F.col("rk") <= k)


@dataclass
class Page:
    """A page: ``rows`` in order by ``pos``, and the cursor of the next.

    ``scanned`` has the rows that were read for it, at most one more of a
    sub-query than the page can hold.  ``stop`` is where leaf visits ran out,
    and ``visits`` counts those made (None: the table's leaves weren't given).
    """

    rows: DataFrame
    parts: list
    budget: PageBudget
    scanned: DataFrame
    visited: list[int]
    stop: Cursor | None = None
    visits: int | None = None

    def _end(self) -> tuple[dict, dict]:
        """The last row of the page, and the number of rows read for each sub-query."""
        last = self.rows.orderBy(F.col("pos").desc()).limit(1).collect()
        return (last[0] if last else None), {r["qi"]: r["n"] for r in self.scanned.groupBy("qi").agg(F.count("*").alias("n")).collect()}  # a row per sub-query

    def _following(self, qi: int, mark: str) -> Cursor | None:
        """Begin of the next sub-query that some key can meet."""
        i = next((i for i in range(qi + 1, len(self.parts)) if self.parts[i][1] is not None), None)
        return None if i is None else Cursor(i, self.parts[i][2], mark)

    def next_cursor(self) -> Cursor | None:
        """None at the end.  Reads the page's last row and a few counts.

        Where a budget is spent on the last row of a sub-query, the cursor is
        at the begin of the next, even if nothing follows.  Where leaf visits
        are spent, it is at the bound of the next leaf.
        """
        last, read = self._end()
        mark = fingerprint(self.parts)
        if last is not None and last["pos"] < sum(read.values()):
            more = last["rk"] < read[last["qi"]]
            return Cursor(last["qi"], self.parts[last["qi"]][2], mark, bytes(last["sk"])) if more else self._following(last["qi"], mark)
        if self.stop is not None:
            return self.stop
        if last is None:
            return None
        left = PageBudget(self.budget.items, self.budget.bytes)
        left.spend(items=last["pos"], bytes=last["so_far"])
        if not left.exhausted:
            return None
        if self.budget.items is not None and last["pos"] >= self.budget.items:
            return Cursor(last["qi"], self.parts[last["qi"]][2], mark, bytes(last["sk"]))
        return self._following(last["qi"], mark)

    def metrics(self) -> dict[str, int | None]:
        """Rows read and returned, sub-queries and leaves visited."""
        _, read = self._end()
        return {"rows_read": sum(read.values()), "rows_returned": self.rows.count(), "sub_queries": len(self.visited), "partitions_visited": self.visits}


def _resumed(i: Interval, cursor: Cursor) -> Interval:
    """The cursor takes the place of the bound that the scan came from."""
    if cursor.after is None:
        return i
    if cursor.forward:
        return Interval(cursor.after, cursor.included, i.high, i.high_in)
    return Interval(i.low, i.low_in, cursor.after, cursor.included)


def _visited(leaves: DataFrame, asked: list, parts: list, visits: int) -> tuple[list, Cursor | None, int]:
    """Sub-queries cut to the leaves that a page may visit, where it stops, and the visits made.

    A sub-query costs a visit for each leaf that its interval meets, one at
    least.  Leaves (``hk``, ``start``, ``end``; no bytes: open) of a hash key
    tile its range; a key without leaves is one.
    """
    out, left, mark = [], visits, fingerprint(parts)
    for qi, hk, i, forward in asked:
        if left <= 0:
            return out, Cursor(qi, forward, mark), visits
        met = leaves.filter((F.col("hk") == F.lit(hk)) & intersects_column(F.col("start"), F.col("end"), F.lit(i.low).cast("binary"), F.lit(i.high).cast("binary"), F.lit(i.high_in)))
        some = met.orderBy(F.col("start").asc() if forward else F.col("start").desc()).limit(left + 1).collect()  # at most a page's visits
        some = [(bytes(r["start"]) or None, bytes(r["end"]) or None) for r in some]
        low, high = i.low or b"", i.high
        some = [s for s in some if not (before_cursor(*s, low, True) if forward else high is not None and not i.high_in and before_cursor(*s, high, False))]
        if len(some) > left:
            near, far = (some[0], some[left - 1]) if forward else (some[left - 1], some[0])
            out.append((qi, hk, clip(near[0], far[1], i), forward))
            after, included = boundary_cursor(*some[left - 1], forward)
            return out, Cursor(qi, forward, mark, after, included), visits
        out.append((qi, hk, i, forward))
        left -= max(1, len(some))
    return out, None, visits - left


def query_items(
    items: DataFrame, queries: list[SubQuery], limit: int | None = None, max_bytes: int | None = None, cursor: str | None = None, leaves: DataFrame | None = None, max_visits: int = MAX_PAGE_VISITS
) -> Page:
    """Groups of items in the order of the sub-queries, each in its direction.

    Sub-queries that no key can meet are passed over.  A page ends with its
    item limit, or before the item that would exceed its byte budget, but the
    first item of a sub-query that begins with budget left is always in.
    With ``leaves`` it also ends after ``max_visits`` of them.
    """
    if not queries:
        raise ValueError("no sub-queries")
    if limit is not None and limit <= 0:
        raise ValueError("a limit is positive")
    spark = items.sparkSession
    parts = [(encode_key(q.hash_key), interval_of(q.condition), q.forward) for q in queries]
    at, first = None, 0
    if cursor is not None:
        at = Cursor.decode(cursor)
        at.check(parts)
        first = at.index
    asked = [(qi, hk, _resumed(i, at) if at is not None and qi == first else i, forward) for qi, (hk, i, forward) in enumerate(parts) if i is not None and qi >= first]
    stop, visits = None, None
    if leaves is not None:
        asked, stop, visits = _visited(leaves, asked, parts, max_visits)
    rows = [(qi, hk, i.low, i.low_in, i.high, i.high_in, forward) for qi, hk, i, forward in asked]
    keys = [hk for _, hk, _, _ in asked]
    wanted = items.filter(F.col("hk").isin(keys)) if len(keys) <= 1000 else items
    if len(rows) == 1:
        wanted = wanted.filter(Interval(*rows[0][2:6]).column(F.col("sk")))
    budget = PageBudget(limit, MAX_BYTES_OF_ALL if max_bytes is None else PageBudget.of(limit, max_bytes).bytes)
    held = min(limit if limit is not None else MAX_BYTES_OF_ALL, budget.bytes // PAGE_ROW_OVERHEAD + 1)
    bounded = limit is not None or max_bytes is not None
    m = range_query(wanted, spark.createDataFrame(rows, REQUEST), held + 1 if bounded else None)
    m = m.withColumn("page_bytes", sizes.page_bytes(F.col("hk"), F.col("sk"), F.col("data_bin"), F.col("data_text")))
    # sub-queries are few: their totals come first, so no window spans them
    totals = m.groupBy("qi").agg(F.count("*").alias("n"), F.sum("page_bytes").alias("b"))
    before = Window.orderBy("qi").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("qi").alias("t_qi"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b_before"))
    m = m.join(F.broadcast(totals), F.col("qi") == F.col("t_qi")).drop("t_qi")  # a row per sub-query
    own = F.sum("page_bytes").over(Window.partitionBy("qi").orderBy("rk"))
    m = m.withColumns({"pos": F.col("n_before") + F.col("rk"), "so_far": F.col("b_before") + own})
    page = m if limit is None else m.filter(F.col("pos") <= limit)
    if max_bytes is not None:
        page = page.filter((F.col("so_far") <= budget.bytes) | ((F.col("rk") == 1) & (F.col("b_before") < budget.bytes)))
    return Page(page.drop("n_before", "b_before"), parts, budget, m, [qi for qi, *_ in asked], stop, visits)


def visited_leaves(leaves: DataFrame, requests: DataFrame, most: int = MAX_PAGE_VISITS) -> DataFrame:
    """Leaves that a page visits: those that meet each request, up to the cap.

    A leaf without rows costs a visit too, so leaves are ranked by their
    bounds and not by what they hold.
    """
    r = requests.withColumnRenamed("hk", "r_hk")
    met = leaves.join(r, (F.col("hk") == F.col("r_hk")) & intersects_column(F.col("start"), F.col("end"), F.col("low"), F.col("high"), F.coalesce("high_in", F.lit(False)))).drop("r_hk")
    order = Window.partitionBy("qi", "hk").orderBy(F.when(F.col("forward"), F.col("start")).asc(), F.when(~F.col("forward"), F.col("start")).desc())
    ranked = met.withColumn("visit", F.row_number().over(order)).filter(F.col("visit") <= most)
    return ranked.drop("low", "low_in", "high", "high_in", "forward")

"""K-d tree partitioning of a table into shards of near equal bytes.

Splitting ends when leaves have the target's bytes: a number of shards sets
the target, or a target the number of shards.  A node of ``m`` times the
target is cut in two, for ``m // 2`` and the rest, where the bytes below the
cut come nearest to that share.  It is cut along its widest dimension (bytes,
characters, language, source): the one whose values spread furthest in
relation to the whole table's.  Languages and sources lie on a line in the
order of their bytes.  Cuts of all nodes of a level are found together by
counting bytes in finer and finer bins of the node's values, each round one
aggregation that returns at most ``BINS`` rows a node, until a bin holds one
value or few rows.  Rows of one value are cut further by the next key, a
hash of the row, then by ``doc_id`` and last by the row's number; so even
rows that are equal in all can be cut anywhere.  The tree is small, and rows
are routed through it by expressions.

Defined results: null text has no bytes and still a row's overhead; null
metadata is a value of its own, below all others; repeated rows are dealt like
any others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodekey.llm import staging
from lodekey.llm.packing import number_within

SHARDS = 24
OVERHEAD = 8
BINS = 1024
FEW = 4000  # rows in question that are fetched and not counted in bins
DIMENSIONS = ("n_bytes", "n_letters", "lang_code", "source_code")
TIES = ("tie", "id_key", "row")
_ABOVE = (1 << 63) - 1


@dataclass
class Node:
    """Gives shards ``first`` and on; ``cut`` is the last key of its left child."""

    first: int
    shards: int
    dim: str | None = None
    cut: tuple[int, ...] | None = None
    children: list[Node] = field(default_factory=list)


def _code(c: Column) -> Column:
    """A place on a line for a word: its first seven bytes as a number."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long") + F.when(c.isNull(), -1).otherwise(0)


def metadata(docs: DataFrame) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_letters"),
        F.col("lang"),
        F.col("source"),
    )
    return d.select(
        "doc_id",
        "n_bytes",
        "text_crc32",
        (F.col("n_bytes") + OVERHEAD).alias("size"),
        "n_letters",
        _code(F.col("lang")).alias("lang_code"),
        _code(F.col("source")).alias("source_code"),
        F.shiftright(F.xxhash64("doc_id", "text_crc32"), 4).alias("tie"),
        F.coalesce("doc_id", F.lit(-(2**60))).alias("id_key"),
        F.monotonically_increasing_id().alias("row"),
    )


def _lookup(by_node: dict, c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) if not isinstance(x, Column) else x for kv in by_node.items() for x in kv]), c)


def _bounds(values: tuple[int, ...]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(values)])


def _keys(dims: dict[int, str]) -> Column:
    """The keys by which a row of each node is cut: its dimension, then the ties."""
    wide = F.coalesce(*[F.when(F.col("node").isin([n for n, d in dims.items() if d == dim]), F.col(dim)) for dim in sorted(set(dims.values()))])
    return F.struct(wide.alias("k0"), *[F.col(t).alias(f"k{i + 1}") for i, t in enumerate(TIES)])


def _step(rows: DataFrame, cut: list[Node]) -> DataFrame:
    """Moves rows of the nodes just cut to their children."""
    right = _keys({n.first: n.dim for n in cut}) > _lookup({n.first: _bounds(n.cut) for n in cut}, F.col("node"))
    half = _lookup({n.first: n.shards // 2 for n in cut}, F.col("node"))
    return rows.withColumn("node", F.col("node") + F.when(right, half).otherwise(0))


def _find_cuts(rows: DataFrame, nodes: list[Node], targets: dict[int, float], extents: dict[str, tuple[int, int]], counts: dict[int, int]) -> None:
    """Sets ``cut`` of all nodes, in rounds that they go through together."""
    dims = {n.first: n.dim for n in nodes}
    state = {f: {"key": 0, "lo": [extents[k][0] for k in (d, *TIES)], "hi": [extents[k][1] for k in (d, *TIES)], "before": 0, "few": counts[f] <= FEW} for f, d in dims.items()}
    cuts: dict[int, tuple[int, ...]] = {}
    while state:
        lo = _lookup({f: _bounds(s["lo"]) for f, s in state.items()}, F.col("node"))
        hi = _lookup({f: _bounds(s["hi"]) for f, s in state.items()}, F.col("node"))
        asked = rows.filter(F.col("node").isin(list(state))).select("node", "size", _keys({f: dims[f] for f in state}).alias("k")).filter((F.col("k") >= lo) & (F.col("k") <= hi))
        few = [f for f, s in state.items() if s["few"]]
        if few:
            found: dict[int, list] = {f: [] for f in few}
            for r in asked.filter(F.col("node").isin(few)).collect():  # at most FEW rows a node
                found[r["node"]].append((tuple(r["k"]), r["size"]))
            for f in few:
                s = state.pop(f)
                running, rest, k = s["before"], sorted(found[f]), s["key"]
                cuts[f] = rest[-1][0]
                # below all rows in question, above those before
                last = (*s["lo"][:k], s["lo"][k] - 1, *[_ABOVE] * (len(TIES) - k))
                for key, w in rest:
                    running += w
                    if running >= targets[f]:
                        nearer = running > w and targets[f] - (running - w) < running - targets[f]
                        cuts[f] = last if nearer else key
                        break
                    last = key
        if not state:
            break
        asked = asked.filter(F.col("node").isin(list(state)))
        key = F.coalesce(*[F.when(F.col("node").isin([f for f, s in state.items() if s["key"] == i]), F.col(f"k.k{i}")) for i in sorted({s["key"] for s in state.values()})])
        low = _lookup({f: s["lo"][s["key"]] for f, s in state.items()}, F.col("node"))
        step = _lookup({f: (s["hi"][s["key"]] - s["lo"][s["key"]]) // BINS + 1 for f, s in state.items()}, F.col("node"))
        bins: dict[int, list] = {f: [] for f in state}
        for r in asked.withColumn("bin", F.call_function("div", key - low, step)).groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect():  # at most BINS rows a node
            bins[r["node"]].append((r["bin"], r["w"], r["n"]))
        for f, s in list(state.items()):
            k, running = s["key"], s["before"]
            width = (s["hi"][k] - s["lo"][k]) // BINS + 1
            chosen = sorted(bins[f])[-1]
            for b in sorted(bins[f]):
                if running + b[1] >= targets[f]:
                    chosen = b
                    break
                running += b[1]
            else:
                running -= chosen[1]
            s["before"], s["few"] = running, chosen[2] <= FEW
            s["lo"][k] += chosen[0] * width
            s["hi"][k] = min(s["lo"][k] + width - 1, s["hi"][k])
            if width == 1 and not s["few"]:
                s["key"] += 1
                if s["key"] > len(TIES):
                    cuts[f] = tuple(s["lo"])
                    del state[f]
    for n in nodes:
        n.cut = cuts[n.first]


def cut_table(meta: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> tuple[Node, DataFrame]:
    """The tree, and the rows of ``meta`` with their leaf as ``node``.

    After each level the rows are written with their new node, so that the
    rounds of the next level read columns only: expressions of one level inside
    those of the next would grow with a power of the depth.
    """
    rows = staging.stage(meta, "shard-rows")
    names = (*DIMENSIONS, *TIES)
    r = rows.agg(F.sum("size").alias("size"), *[F.min(d).alias(f"lo_{d}") for d in names], *[F.max(d).alias(f"hi_{d}") for d in names]).first()
    if target_bytes is not None:
        shards = max(1, -(-(r["size"] or 0) // target_bytes))
    extents = {d: (r[f"lo_{d}"] or 0, r[f"hi_{d}"] or 0) for d in names}
    root = Node(0, shards)
    rows = rows.withColumn("node", F.lit(root.first))  # a constant until the first cut
    level = [root] if shards > 1 else []
    while level:
        aggs = [F.sum("size").alias("w"), F.count("*").alias("n")]
        aggs += [f(F.col(d)).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in rows.filter(F.col("node").isin([n.first for n in level])).groupBy("node").agg(*aggs).collect()}
        live = [n for n in level if n.first in stats and stats[n.first]["n"] > 1]
        if not live:
            break
        targets = {}
        for n in live:
            r = stats[n.first]
            n.dim = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, extents[d][1] - extents[d][0]))
            targets[n.first] = r["w"] * (n.shards // 2) / n.shards
        _find_cuts(rows, live, targets, extents, {f: r["n"] for f, r in stats.items()})
        level = []
        for n in live:
            half = n.shards // 2
            n.children = [Node(n.first, half), Node(n.first + half, n.shards - half)]
            level += [c for c in n.children if c.shards > 1]
        rows = staging.stage(_step(rows, live), "shard-rows")
    return root, rows


def shard_documents(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """Every row with its shard and a place in it."""
    _, rows = cut_table(metadata(docs), shards, target_bytes)
    placed = rows.select("doc_id", "size", "text_crc32", "row", F.col("node").cast("int").alias("shard"))
    return number_within(placed, "shard", ["doc_id", "row"], "slot").drop("row")

"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, each the majority of that bit in the XXH64 values
of a text's word shingles.  Equal fingerprints are one class.  To find
classes within ``distance`` bits, a fingerprint is cut into segments: two
that differ in few bits agree, in at least one segment, up to
``distance // segments`` bits.  Each class is put into one table per segment
under the segment's value, and looked up under every value in the small
Hamming ball round its own; the complete distance is checked inside that
join, so only links come out of it.  Classes are then joined to components.

Texts that share most of their shingles may differ in more bits than such
balls reach.  ``one_per_component`` joins them by the same tables with more
segments of few bits, balls of radius one, and a wider complete distance; as
so short segments are alike by chance, a table's place is a segment's value
together with the least of the text's shingles in two orders of the table's
own.  What it finds is compared by whole shingle sets; across components only
pairs whose sets can be similar enough, by the rarest shingles that they share.

By calculation, two texts with a Jaccard similarity of 0.8 share both least
shingles of a table with a chance of 0.64 and differ in 15 % of their bits, so
a segment is in the other's ball with 0.81, and any of twelve tables finds them
with 0.9998; they differ in at most 18 of 64 bits with 0.998.

Defined results: null and blank texts have fingerprint zero and are linked
like any others; texts of fewer words than a shingle are one shingle;
repeated rows are in one class; a component's id is its smallest non-null
``doc_id`` (null if it has none); extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodekey.llm import files, similar, staging
from lodekey.llm.archives import ROW_BITS, archive, by_archive, texts_at
from lodekey.llm.components import components
from lodekey.llm.rolling import mix
from lodekey.llm.shingles import shingle_hashes

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3

def simhash(hashes: list[int] | np.ndarray) -> int:
    """Bit i is 1 if it is in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(np.array(hashes[i : i + (1 << 15)], "<u8").view(np.uint8), bitorder="little")
        votes += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs``, and ``_fp``, the fingerprint as a signed long."""
    keep = keep or ["doc_id"]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([simhash(shingle_hashes(t or "", width)) for t in b.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(got.view(np.int64))], names=[*keep, "_fp"])

    chosen = docs.select(*keep) if at < len(keep) else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return chosen.mapInArrow(run, f"{types}, _fp long")


def _segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of each segment."""
    return [(64 * i // n, 64 * (i + 1) // n - 64 * i // n) for i in range(n)]


def _ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``bits`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << i) for m in masks for i in range(bits)}
    return sorted(masks)


def links(classes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Pairs u < v of different ``fp`` within ``distance`` bits (some twice)."""
    radius = distance // segments

    def value(at: int, bits: int) -> Column:
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))

    def row(i: int, v: Column) -> Column:  # the segment's number in the key's upper bits
        return v.bitwiseOR(F.lit(i << 56))

    cut = _segments(segments)
    stored = classes.select(F.col("fp").alias("u"), F.explode(F.array(*[row(i, value(at, bits)) for i, (at, bits) in enumerate(cut)])).alias("key"))

    def near(i: int, at: int, bits: int) -> Column:
        return F.transform(F.lit(_ball(bits, radius)).cast("array<bigint>"), lambda m: row(i, value(at, bits).bitwiseXOR(m)))

    probes = F.concat(*[near(i, at, bits) for i, (at, bits) in enumerate(cut)])
    asked = classes.select(F.col("fp").alias("v"), F.explode(probes).alias("key"))
    return stored.join(asked.hint("merge"), (stored.key == asked.key) & (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)).select("u", "v")


def class_labels(rows: DataFrame, distance: int, segments: int) -> DataFrame:
    """``fp``, ``first_id`` and the ``label`` of its component of each class."""
    classes = staging.stage(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("first_id")), "classes")
    labels = components(links(classes.select("fp"), distance, segments))
    return classes.join(labels, classes.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    staging.ship(docs.sparkSession)
    got = staging.stage(fingerprints(docs, width), "fingerprints")
    labels = class_labels(got, distance, segments)
    ids = labels.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = labels.join(ids, "label").select("fp", "component_id")
    return got.join(named, got["_fp"] == named["fp"]).select("doc_id", "fp", "component_id")


# ------------------------------------------------- similarity of whole shingle sets

SIMILAR_WIDTH = 5
SIMILAR = 0.8
SIMILAR_DISTANCE = 18
SIMILAR_SEGMENTS = 12
_TIMES, _PLUS = np.random.default_rng(5).integers(0, 1 << 64, (2, 128), np.uint64)
_TIMES |= np.uint64(1)


def least_shingles(s: np.ndarray, n: int) -> np.ndarray:
    """``n`` numbers, each for the two least of a set's hashes in two orders."""
    least = np.full(2 * n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        least = np.minimum(least, (s[i : i + 4096, None] * _TIMES[: 2 * n] + _PLUS[: 2 * n]).min(0))
    return mix(mix(least[:n]) + least[n:])


def sketches(docs: DataFrame, folder: str, width: int, segments: int) -> DataFrame:
    """``kept``, the row without its text, the text's place, a digest of its shingle set, fingerprint and least shingles.

    ``packed`` is null for a null text.
    """
    kept = F.struct(F.col("doc_id"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    chosen = docs.select(kept.alias("kept"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([chosen.schema["kept"], *T.StructType.fromDDL("rid long, at long, packed long, set binary, fp long, mins array<long>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, row, at, pack = TaskContext.get().taskAttemptId(), 0, 0, zstandard.ZstdCompressor(level=1)
        with files.replacing(archive(folder, task)) as out:
            for b in batches:
                got = []
                for t in b.column(1):
                    text = t.as_py()
                    z = pack.compress((text or "").encode())
                    out.write(z)
                    s = similar.shingles(text, width)
                    got.append((at, len(z) if text is not None else None, xxhash.xxh3_128_digest(s.tobytes()), simhash(s), least_shingles(s, segments).view(np.int64)))
                    at += len(z)
                place, size, digest, fp, mins = zip(*got, strict=True) if got else ((),) * 5
                fp = np.array(fp, np.uint64).view(np.int64)
                columns = [pa.array(np.arange(row, row + len(got)) + (task << ROW_BITS)), pa.array(place, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(fp), pa.array(mins, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)
                row += len(got)

    return chosen.mapInArrow(run, schema)


def _with_texts(rows: DataFrame, folder: str) -> DataFrame:
    """``kept`` and ``text`` of rows, read from their archives."""
    schema = T.StructType([rows.schema["kept"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = list(zip(*(b.column(c).to_pylist() for c in ("rid", "at", "packed")), strict=True))
            read = texts_at(folder, (p for p in places if p[2] is not None))
            out, start, size = [], 0, 0
            for i, p in enumerate(places):
                out.append(None if p[2] is None else next(read).decode())
                size += len(out[-1] or "")
                if size > 1 << 20 or i + 1 == len(places):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(out)), pa.array(out, pa.string())], names=["kept", "text"])
                    out, start, size = [], i + 1, 0

    return by_archive(rows).select("kept", "rid", "at", "packed").mapInArrow(run, schema)


def _tables(classes: DataFrame, segments: int) -> DataFrame:
    """A row for each class and segment, where its least shingles are another class's too."""
    each = classes.select("node", "fp", F.posexplode("mins").alias("i", "m"))
    values = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in _segments(segments)]
    each = each.select("node", "fp", "i", F.xxhash64("i", "m").alias("table"), F.array(*values)[F.col("i")].alias("value"))
    return each.join(each.groupBy("table").agg(F.count("*").alias("n")).filter("n > 1").select("table"), "table")


def _stored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("place", F.xxhash64("table", "value"))


def _met(stored: DataFrame, asked: DataFrame, distance: int) -> DataFrame:
    """Pairs ``a``, ``b`` of one table place within ``distance`` bits."""
    near = F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= distance
    hashed = lambda d: d.withColumn("h", F.hash("place"))  # noqa: E731  has both sides dealt anew, so that Spark can split a frequent place
    return hashed(stored).join(hashed(asked), ["place", "h"]).filter(near & (F.col("a") != F.col("b")))


def _rarest(sets: DataFrame, least: float) -> DataFrame:
    """Each set's rarest shingles ``t``, so many that two similar sets of different components share one.

    ``sets`` has ``node``, its component ``c``, ``size`` and ``set``.  All sets
    have one order: shingles of one component first, as no pair across
    components shares them, then by the number of sets that hold them.  A
    similar set shares ``least`` of the set's shingles at least, so one of them
    is among the first of the others and one more.  ``room`` is how many
    shingles there are from ``t`` on.
    """
    each = sets.select("node", "c", F.explode("set").alias("t"))
    shared = each.groupBy("t").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("t", "n")
    dealt = lambda d: d.withColumn("h", F.hash("t"))
    held = dealt(each).join(dealt(shared), ["t", "h"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("held"))
    asked = F.col("size") - F.ceil(F.col("size") * least - 1e-6) + 1 - (F.col("size") - F.size("held"))
    first = sets.select("node", "c", "size").join(held, "node").withColumn("asked", asked.cast("int")).filter("asked > 0")
    each = first.select("node", "c", "size", F.size("held").alias("room"), F.posexplode(F.slice("held", F.lit(1), F.col("asked"))).alias("at", "s"))
    return each.select("node", "c", "size", F.col("s.t").alias("t"), (F.col("room") - F.col("at")).alias("room"))


def _near(asked: DataFrame, rows: DataFrame, least: float, distance: int, segments: int) -> DataFrame:
    """Pairs ``u`` < ``v`` of one ``t`` and different components that meet in a table and can be similar enough.

    They meet if they are within ``distance`` bits, and have the least shingles
    of a table in common and its segment in each other's ball.  If ``t`` is the
    rarest shingle that two sets share, they share no more than either has room
    for.
    """
    hashed = lambda d: d.withColumn("h", F.hash("t"))
    named = lambda d, x: hashed(d).select("t", "h", *[F.col(k).alias(f"{x}_{k}") for k in ("c", "size", "room", "fp", "mins")], F.col("node").alias(x))
    bits, meet = F.col("a_fp").bitwiseXOR(F.col("b_fp")), F.lit(False)
    for i, (at, width) in enumerate(_segments(segments)):
        ball = F.bit_count(F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))) <= 1
        meet = meet | (ball & (F.col("a_mins")[i] == F.col("b_mins")[i]))
    room = F.least("a_room", "b_room") >= (F.col("a_size") + F.col("b_size")) * (least / (1 + least)) - 1e-6
    found = named(asked, "a").join(named(rows, "b"), ["t", "h"]).filter((F.col("a_c") != F.col("b_c")) & room & (F.bit_count(bits) <= distance) & meet)
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _central(rows: DataFrame) -> DataFrame:
    """Of each ``t`` the row with the fewest rarer shingles for its size."""
    head = F.max(F.struct(F.col("room") / F.col("size"), "node", "c", "size", "room", "fp", "mins")).alias("head")
    return rows.groupBy("t").agg(head).select("t", *[f"head.{c}" for c in ("node", "c", "size", "room", "fp", "mins")])


def _minor(rows: DataFrame) -> DataFrame:
    """Rows that aren't of the largest component of their ``t``."""
    counts = rows.groupBy("t", "c").agg(F.count("*").alias("n")).groupBy("t").agg(F.max(F.struct("n", "c")).alias("main"), F.count("*").alias("m"))
    hashed = lambda d: d.withColumn("h", F.hash("t"))
    return hashed(rows).join(hashed(counts.filter("m > 1").select("t", F.col("main.c").alias("main"))), ["t", "h"]).filter("c <> main").drop("main", "h")


def similar_links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], least: float, distance: int, segments: int) -> DataFrame:
    """Links that join all classes that some chain of similar pairs joins.

    ``classes`` has ``node``, ``fp`` and ``mins``; ``sets`` gives ``size`` and
    ``set``, the shingles, of each ``node``; ``verified`` keeps the pairs
    ``u`` < ``v`` that are similar.  First each class is compared with the
    first of every place that it is stored at.  What these links join needs no
    further pair, so from then on pairs across components only are looked up,
    by the rarest shingles that similar sets share: first with one text of
    each shingle, then all that are left, where the largest component of a
    shingle is looked up by the others only.
    """
    rows = staging.stage(_tables(classes, segments), "tables")
    ordered = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    own = _stored(rows).select("place", "node", "fp")
    heads = own.groupBy("place").agg(F.min(F.struct("node", "fp")).alias("head")).select("place", F.col("head.node").alias("a"), F.col("head.fp").alias("a_fp"))
    led = staging.stage(_met(heads, own.withColumnsRenamed({"node": "b", "fp": "b_fp"}), distance).select(*ordered).distinct(), "led")
    first = staging.stage(verified(led), "first-links")
    named = rows.select("node", "table").join(components(first), "node", "left").withColumn("c", F.coalesce("label", "node")).drop("label")
    several = named.groupBy("table").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("table")
    open_ = staging.stage(named.join(several, "table").select("node", "c").distinct(), "open")
    whole = staging.stage(sets(open_.select("node")).join(open_, "node"), "open-sets")
    rows = staging.stage(_rarest(whole, least).join(classes.select("node", "fp", "mins"), "node"), "rarest")
    near = lambda asked: staging.stage(_near(asked, rows, least, distance, segments).join(led, ["u", "v"], "left_anti"), "near")
    second = staging.stage(verified(near(_central(rows))), "second-links")
    of = lambda x: open_.select(F.col("node").alias(x), F.col("c").alias(f"{x}_c"))
    joined = components(second.join(of("u"), "u").join(of("v"), "v").select(F.col("u_c").alias("u"), F.col("v_c").alias("v")))
    rows = staging.stage(rows.join(joined, rows.c == joined.node, "left").select(rows.node, F.coalesce("label", "c").alias("c"), "size", "t", "room", "fp", "mins"), "rarest")
    return first.unionByName(second).unionByName(verified(near(_minor(rows))))


def one_per_component(docs: DataFrame, width: int = SIMILAR_WIDTH, least: float = SIMILAR, distance: int = SIMILAR_DISTANCE, segments: int = SIMILAR_SEGMENTS) -> DataFrame:
    """One row of each group of similar texts, unchanged: that of the smallest ``doc_id``."""
    spark = docs.sparkSession
    staging.ship(spark)
    folder = staging.new_path(spark, "similar-texts")
    files.make_folder(folder)
    got = staging.stage(sketches(docs, folder, width, segments), "sketches")
    first = F.min(F.struct(F.col("kept.doc_id").isNull().alias("no_id"), F.col("kept.doc_id").alias("id"), "rid", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("packed", F.lit(-1)).alias("packed"), "fp", "mins"))
    classes = got.groupBy("set").agg(first.alias("k"))
    classes = staging.stage(classes.select(F.struct("k.no_id", "k.id", "k.rid").alias("k"), F.col("k.rid").alias("node"), "k.at", "k.packed", "k.fp", "k.mins"), "classes")
    places = classes.select("node", "at", "packed")
    labels = components(similar_links(classes.select("node", "fp", "mins"), lambda nodes: similar.sets(nodes, places, folder, width), lambda pairs: similar.verified(pairs, places, folder, least, width), least, distance, segments))
    chosen = classes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("k").alias("k"))
    left = got.select("kept", "rid", "at", "packed").join(chosen.select(F.col("k.rid").alias("rid")), "rid", "left_semi")
    back = _with_texts(left, folder)
    return back.select(*[F.col("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])

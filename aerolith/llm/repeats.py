"""Finding passages of at least `length` units (bytes or words) that start more than once in a corpus.

Shared by the suffix-array and the FM-index operator. Neither could hold one index over all the text, so the text is
dealt out by content: of each window of `length` units the `gram`-unit stretch with the least hash (the last of several) is its
anchor (winnowing). Equal windows have equal anchors at equal offsets, so whatever equals a window lies around an equal
anchor. Anchors that occur once are dropped before any text moves; of each of the others the windows whose anchor it is
(its context) go to the shard of the anchor's hash, where an index compares contexts.

An anchor that occurs more than `hot` times is dealt to several shards by document and place (so that a single long text, or
the texts without an id, make no large shard). Each finds the repeats among its own part; the windows that are first there are then compared across parts by a 128-bit fingerprint, whose minimum is
taken on the map side. So no group of equal windows meets in one task, however large.

Rows of equal text are one text, held by the smallest doc_id (its owner). Positions are longs: the text's number among
those of its doc_id (0, where ids are unique) in the upper bits, the unit's offset in the lower 32. Rows that share a
doc_id are one document, so a text later in it (by SHA-256) comes after an earlier one. A null doc_id sorts last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerolith.llm import textnum as tn
from aerolith.llm.common import LAST_ID, bounded_batches, cut, drop, order_id

#: Bytes of text handled at a time.
AT_ONCE = 1 << 20
SHIFT, OFFSET = 32, (1 << 32) - 1

NO_SPANS = "cast(array() as array<struct<start: bigint, end: bigint>>)"
CONTEXT = "h long, salt int, hot boolean, doc_id long, pos long, off int, body binary"
FOUND = "kind byte, doc_id long, start long, end long, f1 long, f2 long"


@dataclass(frozen=True)
class Unit:
    """What is counted: `bytes` or `words`; windows of `length` units, anchors of `gram`; `within`: a document's own earlier windows count as well as other documents'. `hot`: contexts of one anchor that go to one shard; `indexed`: contexts in one index, at least."""

    words: bool
    length: int
    gram: int
    within: bool
    hot: int = 8192
    indexed: int = 8192

    def units(self, buf: np.ndarray, bounds: np.ndarray):
        """Codes of the units, the documents' n + 1 bounds in them, and where each unit starts and ends in buf."""
        if not self.words:
            return tn.BYTE_CODE[buf], bounds, None, None
        starts, ends, by_doc = tn.words(buf, bounds)
        return tn.Rolling(tn.BYTE_CODE[buf]).spans(starts, ends) | tn.U64(1), by_doc, starts, ends


def with_owner(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's SHA-256), v (the text's number in its doc_id), owner (smallest doc_id with the text).

    What is joined by hash or by id is a table each, so that a text or an id (a null one) of many rows is split.
    """
    bounded_batches(docs.sparkSession)
    rows = cut(keyed(docs).select("doc_id", "th").distinct(), "texts")
    owners = cut(rows.groupBy("th").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "owners")
    # ids of several texts: numbers go by stretches of the hash, so that no task numbers all texts of an id
    several = rows.groupBy("doc_id").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("doc_id")
    several = cut(several, "several")
    shared = cut(rows.join(several, "doc_id").withColumn("stretch", F.substring("th", 1, 2)), "shared-ids")
    before = Window.partitionBy("doc_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(shared.groupBy("doc_id", "stretch").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "stretches")
    place = F.row_number().over(Window.partitionBy("doc_id", "stretch").orderBy("th")) - 1
    numbers = shared.withColumn("place", place).join(starts, ["doc_id", "stretch"])
    numbers = cut(numbers.select("doc_id", "th", (F.col("before") + F.col("place")).cast("int").alias("v")), "numbers")
    owned = rows.join(owners, "th", "left").join(numbers, ["doc_id", "th"], "left")
    out = cut(owned.select("doc_id", "th", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("owner", "doc_id").alias("owner")), "owned")
    drop(rows, owners, several, shared, starts, numbers)
    return out


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(order_id().alias("doc_id"), text.alias("text"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("th"), *more)


def with_spans(docs: DataFrame, owners: DataFrame, found: DataFrame, carry: list[str]) -> DataFrame:
    """row (the columns to carry but the text, as c0, c1, ...), text, copy (another document owns the text), spans."""
    row = F.struct(F.lit(0).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry) if c != "text"]).alias("row")
    texts = keyed(docs, row).join(owners, ["doc_id", "th"]).join(spans_by_text(found), ["doc_id", "v"], "left")
    return texts.select("row", "text", (F.col("doc_id") != F.col("owner")).alias("copy"), F.coalesce("spans", F.expr(NO_SPANS)).alias("spans"))


def carried(carry: list[str]) -> list:
    return [F.col("text") if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)]


def contexts(docs: DataFrame, owners: DataFrame, unit: Unit) -> DataFrame:
    """CONTEXT rows of all anchors that occur again, dealt to shards and in order of h and salt there."""
    texts = keyed(docs).join(owners.where("doc_id = owner"), ["doc_id", "th"]).select("doc_id", "v", "text")

    def anchored(batches):
        for batch in _once(batches):
            yield from _anchors(batch, unit)

    anchors = cut(texts.mapInArrow(anchored, "h long, doc_id long, pos long, reach int"), "anchors")
    counted = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    # a table of its own, so that the join below is one of two plain shuffles, whose hot parts Spark can split
    shared = cut(counted.where("n > 1" if unit.within else "a < b").select("h", "n"), "shared")
    wanted = (
        anchors.join(shared, "h")
        .groupBy("doc_id", F.shiftright("pos", SHIFT).cast("int").alias("v"))
        .agg(F.collect_list(F.struct((F.col("pos").bitwiseAND(OFFSET)).alias("at"), "h", "n", "reach")).alias("anchors"))
    )
    wanted = cut(wanted, "wanted")
    drop(anchors, shared)

    def cut_out(batches):
        for batch in _once(batches):
            yield from _contexts(batch, unit)

    out = texts.join(wanted, ["doc_id", "v"]).mapInArrow(cut_out, CONTEXT).repartition("h", "salt").sortWithinPartitions("h", "salt")
    out.reads = wanted
    return out


def find(docs: DataFrame, owners: DataFrame, unit: Unit, solve: Callable) -> DataFrame:
    """doc_id, start, end (packed positions): what `solve` finds to be covered by windows that start earlier."""

    def solved(batches):
        for part in shards(batches, unit.indexed):
            yield from solve(part, unit)

    rows = contexts(docs, owners, unit)
    found = cut(rows.mapInArrow(solved, FOUND), "found")
    drop(rows.reads)
    # windows of hot anchors, each the first of its part: all but the first of all go
    split = found.where("kind = 1").select("f1", "f2", "doc_id", "start", "end")
    place = F.struct("doc_id", *(["start"] if unit.within else []))
    first = split.groupBy("f1", "f2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = split.join(first, ["f1", "f2"]).where(place > F.col("first"))
    return found.where("kind = 0").select("doc_id", "start", "end").unionByName(later.select("doc_id", "start", "end"))


def spans_by_text(found: DataFrame) -> DataFrame:
    """doc_id, v, spans: of each text that has any. A text has one span for each of its anchors at most."""
    low = F.col("start").bitwiseAND(OFFSET)
    span = F.struct(low.alias("start"), (F.col("end") - F.col("start") + low).alias("end"))
    return found.groupBy("doc_id", F.shiftright("start", SHIFT).cast("int").alias("v")).agg(F.collect_list(span).alias("spans"))


def _once(batches):
    """Without a row's repetitions, where the join has left them together (elsewhere they cost time only)."""
    last = None
    for batch in batches:
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "v")]
        new = np.ones(batch.num_rows, bool)
        new[1:] = (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])
        if batch.num_rows:
            new[0] = (ids[0][0], ids[1][0]) != last
            last = (ids[0][-1], ids[1][-1])
        yield batch if new.all() else batch.filter(pa.array(new))


def _packed(batch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, starts, ends = tn.utf8(batch.column(name))
    for a, b in tn.runs(ends - starts, AT_ONCE):
        yield a, b, *tn.joined(data, starts[a:b], ends[a:b])


def _anchors(batch, unit: Unit):
    doc, v = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "v"))
    for a, _, buf, bounds in _packed(batch):
        codes, by_doc, _, _ = unit.units(buf, bounds)
        h = tn.Rolling(codes).windows(unit.gram)
        windows = tn.spread(by_doc[:-1], np.maximum(np.diff(by_doc) - unit.length + 1, 0))
        at, first, last = tn.winnow(h, unit.length - unit.gram + 1, windows)
        of = np.searchsorted(by_doc, at, "right") - 1
        reach = ((at - first) << 16 | (last - first)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(doc[a + of]), pa.array((v[a + of] << SHIFT) | (at - by_doc[of])), pa.array(reach)], ["h", "doc_id", "pos", "reach"])


def _contexts(batch, unit: Unit):
    doc, v = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "v"))
    lists = batch.column("anchors")
    heads = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
    fields = lists.values
    at_all, h_all, n_all, reach_all = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    for a, b, buf, bounds in _packed(batch):
        _, by_doc, starts, ends = unit.units(buf, bounds) if unit.words else (None, bounds, None, None)
        of = np.repeat(np.arange(b - a), np.diff(heads[a : b + 1]))
        for i in range(0, len(of), 1 << 15):
            part = of[i : i + (1 << 15)]
            pick = slice(heads[a] + i, heads[a] + i + len(part))
            at, h, n, reach = at_all[pick], h_all[pick], n_all[pick], reach_all[pick].astype(np.int64)
            lo = at - (reach >> 16)
            hi = lo + (reach & 0xFFFF) + unit.length
            x, y = by_doc[part] + lo, by_doc[part] + hi
            if unit.words:
                x, y = starts[x], ends[y - 1]
            body = buf[tn.spread(x, y - x)]
            offsets = np.concatenate([[0], np.cumsum(y - x)]).astype(np.int32)
            who = doc[a + part]
            hot = n > unit.hot
            place = (v[a + part] << SHIFT) | at
            salt = np.where(hot, tn.mix(tn.mix(who.view(np.uint64)) + place.view(np.uint64)) % ((n + unit.hot - 1) // unit.hot).astype(np.uint64), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(salt), pa.array(hot), pa.array(who), pa.array(place), pa.array((at - lo).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(body)])],
                ["h", "salt", "hot", "doc_id", "pos", "off", "body"],
            )


def shards(batches, most: int) -> Iterator[pa.Table]:
    """Contexts of whole anchors (or whole parts of hot ones), `most` or a few more at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows > most:
            t = pa.Table.from_batches(held).combine_chunks()
            h, salt = t.column("h").to_numpy(), t.column("salt").to_numpy()
            ends = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            i = np.searchsorted(ends, most)
            if i == len(ends):
                break
            yield t.slice(0, ends[i])
            rows -= int(ends[i])
            held = t.slice(ends[i]).to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def result(kind: int, doc, start, end, f1=None, f2=None):
    n = len(doc)
    zero = np.zeros(n, np.int64)
    f1, f2 = (zero if f is None else f.view(np.int64) for f in (f1, f2))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *(pa.array(np.asarray(x, np.int64)) for x in (doc, start, end, f1, f2))], ["kind", "doc_id", "start", "end", "f1", "f2"])


def covered(spans, a: int, b: int, bounds: np.ndarray, copy: np.ndarray, length: int) -> np.ndarray:
    """Which units of rows [a, b) of a batch are in its column of spans; copies lose all, if they have a window."""
    heads = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset + a : spans.offset + b + 1]
    start, end = (spans.values.field(i).to_numpy(zero_copy_only=False)[heads[0] : heads[-1]] for i in range(2))
    of = np.repeat(bounds[:-1], np.diff(heads))
    size = np.diff(bounds)
    whole = np.flatnonzero(copy[a:b] & (size >= length))
    n = int(bounds[-1]) + 1
    begun = np.bincount(np.concatenate([of + start, bounds[:-1][whole]]), minlength=n)
    ended = np.bincount(np.concatenate([of + end, bounds[1:][whole]]), minlength=n)
    return np.cumsum(begun - ended)[:-1] > 0

"""Exact substring removal by maximal repeat groups of an enhanced suffix array (operator 6).

In each shard (see repeats.py) the suffixes that start at anchors are sorted, with the lengths of their common
prefixes; a stack scan of those turns them into the tree of common-prefix intervals. The left sides are sorted in the
same way from the anchor leftwards. A level of the tree is the set of intervals that agree on the next L - a bytes; where
members also agree on a bytes to the left, they form a group of equal windows of L bytes, and where they don't, the
left extension is diverse and the group splits there. As `a` grows from level to level, a group that stays the same
grows by a byte on the left; where its members change, on either side, it is a maximal repeat: it is put out with all its
occurrences. The earliest of those stays, and what every other one covers goes. A repeat that reaches past its anchor's
context goes on in the next anchor's, and repeats() joins such pieces.

Null and empty texts have no bytes; texts of under `length` bytes lose none. Equal rows get equal results; for rows that
share a doc_id see repeats.py. Columns other than doc_id and text are not read (dedup() hands them on).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aerolith.llm import repeats as R
from aerolith.llm import textnum as tn
from aerolith.llm.common import apart, back, cut, original_id

LENGTH, GRAM = 100, 32


def interval_tree(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of the suffix array whose members agree on `least` symbols or more, by a scan with a stack.

    lcp[i]: symbols that suffix i has in common with suffix i - 1 (lcp[0] is not read). Of each interval: first and
    last member, depth (common symbols of all), and its parent's depth.
    """
    out: list[tuple[int, int, int, int]] = []
    stack: list[tuple[int, int]] = []  # depth, first member
    values = lcp.tolist()
    values.append(0)
    for i in range(1, len(values)):
        depth, first = values[i], i - 1
        if depth < least:
            depth = 0
        while stack and stack[-1][0] > depth:
            own, first = stack.pop()
            out.append((first, i - 1, own, max(depth, stack[-1][0] if stack else 0)))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    cols = np.array(out, np.int64).reshape(-1, 4)
    return cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3]


def _sorted(side: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes, and the bytes each has in common with the one before it."""
    rows = np.ascontiguousarray(side)
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 1 << 14):
        differ = rows[order[i : i + (1 << 14)]] != rows[order[i - 1 : i - 1 + len(order[i : i + (1 << 14)])]]
        lcp[i : i + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


class Shard:
    """The contexts of a shard, ranked by place, and their groups of equal windows."""

    def __init__(self, shard: pa.Table, unit: R.Unit):
        self.unit = unit
        self.doc, self.pos, self.off, self.hot = (shard.column(c).to_numpy() for c in ("doc_id", "pos", "off", "hot"))
        off = self.off.astype(np.int64)
        self.buf, bounds = tn.joined(*tn.utf8(shard.column("body")))
        self.m, self.reach = len(self.doc), unit.length - unit.gram
        self.right_n, self.left_n = np.minimum(np.diff(bounds) - off, unit.length), np.minimum(off, self.reach)
        self.middle = bounds[:-1] + off
        self.rank = np.empty(self.m, np.int64)
        self.rank[np.lexsort((self.pos, self.doc))] = np.arange(self.m)
        self.by_rank = np.empty(self.m, np.int64)
        self.by_rank[self.rank] = np.arange(self.m)
        place = np.stack([self.doc, self.pos], 1)[self.by_rank]
        tied = np.concatenate([[False], (place[1:] == place[:-1]).all(1)])  # repeated rows: neither is earlier
        self.rank_of_place = (np.cumsum(~tied) - 1)[self.rank]

    def windows(self):
        """For each a: a, the contexts whose windows that start a bytes before the anchor occur again, in order of group and place; where groups begin."""
        unit, m, reach = self.unit, self.m, self.reach
        right, left = np.zeros((m, unit.length), np.uint8), np.zeros((m, reach), np.uint8)
        right[np.arange(unit.length) < self.right_n[:, None]] = self.buf[tn.spread(self.middle, self.right_n)]
        left[:, ::-1][np.arange(reach)[::-1] < self.left_n[:, None]] = self.buf[tn.spread(self.middle - self.left_n, self.left_n)]
        # left[i, 0] is the byte before the anchor
        order, lcp = _sorted(right, unit.length)
        left_order, left_lcp = _sorted(left, reach)
        first, last, depth, parent = interval_tree(lcp, unit.gram)
        left_class = np.empty(m, np.int64)
        for a in range(reach + 1):
            take = (depth >= unit.length - a) & (parent < unit.length - a)
            sizes = (last - first + 1)[take]
            own = order[tn.spread(first[take], sizes)]
            node = np.repeat(np.arange(len(sizes)), sizes)
            fits = (self.left_n[own] >= a) & (self.right_n[own] >= unit.length - a)
            own, node = own[fits], node[fits]
            left_class[left_order] = np.cumsum(left_lcp < a) if a else 0
            key = np.sort((node * (m + 1) + left_class[own]) * m + self.rank[own])
            group = key // m
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([begins, [len(key)]]))
            several = sizes > 1
            who = self.by_rank[key[np.repeat(several, sizes)] % m]
            sizes = sizes[several]
            yield a, who, np.cumsum(sizes) - sizes

    def maximal(self, seen=None):
        """The maximal repeats: their contexts in order of group and place, where groups begin, and the least and largest a of each group's windows.

        seen(a, contexts, groups' begins) is told of each level.
        """
        m = self.m
        mixed = tn.mix(self.rank.astype(np.uint64) + tn.U64(1))
        none = np.zeros(0, np.int64)
        since, before = np.zeros(m, np.int64), np.zeros(m, np.uint64)
        last = none, none, none, before[:0]
        for a, who, begins in [*self.windows(), (self.reach + 1, none, none)]:
            if seen and a <= self.reach:
                seen(a, who, begins)
            leads = who[begins]
            sums = np.add.reduceat(mixed[who], begins) if len(begins) else before[:0]
            now = np.zeros(m, np.uint64)
            now[leads] = sums
            # what the level before had and this one has not, or has with other members, was maximal
            old, old_begins, old_leads, old_sums = last
            ended = now[old_leads] != old_sums
            if ended.any():
                sizes = np.diff(np.concatenate([old_begins, [len(old)]]))
                own = old[np.repeat(ended, sizes)]
                sizes = sizes[ended]
                yield own, np.cumsum(sizes) - sizes, since[old_leads[ended]], a - 1
            fresh = leads[before[leads] != sums]
            since[fresh] = a
            before, last = now, (who, begins, leads, sums)


def solve(shard: pa.Table, unit: R.Unit):
    """Bytes covered by a repeat that starts earlier, one span for each context; and each hot context's first windows."""
    s = Shard(shard, unit)
    if s.m < 2 and not s.hot.any():  # a hot context alone in its part is still compared across parts
        return
    near, far = np.full(s.m, unit.length), np.full(s.m, -1)  # the offsets at which a window is covered: least, largest
    firsts: list[tuple[int, np.ndarray]] = []

    def note_firsts(a, who, begins):
        later = np.zeros(s.m, bool)
        sizes = np.diff(np.concatenate([begins, [len(who)]]))
        later[who] = s.rank_of_place[who] > np.repeat(s.rank_of_place[who[begins]], sizes)
        firsts.append((a, np.flatnonzero(s.hot & ~later & (s.left_n >= a) & (s.right_n >= unit.length - a))))

    for who, begins, least, most in s.maximal(note_firsts if s.hot.any() else None):
        sizes = np.diff(np.concatenate([begins, [len(who)]]))
        later = s.rank_of_place[who] > np.repeat(s.rank_of_place[who[begins]], sizes)
        gone, least = who[later], np.repeat(least, sizes)[later]
        near[gone] = np.minimum(near[gone], least)
        far[gone] = np.maximum(far[gone], most)
    for a, own in firsts:
        yield from _first_windows(own, a, s.buf, s.middle, s.doc, s.pos, unit)
    got = np.flatnonzero(far >= 0)
    yield R.result(0, s.doc[got], s.pos[got] - far[got], s.pos[got] - near[got] + unit.length)


GROUPS = "doc_id long, start long, end long, members long, occurrences array<struct<doc_id: bigint, start: bigint>>"


def _grouped(shard: pa.Table, unit: R.Unit):
    """Each maximal repeat of a shard: its first place, a hash of its occurrences relative to that, and all of them."""
    s = Shard(shard, unit)
    for who, begins, least, most in s.maximal():
        sizes = np.diff(np.concatenate([begins, [len(who)]]))
        lead = np.repeat(who[begins], sizes)
        relative = tn.mix(tn.mix(s.doc[who].view(np.uint64)) + (s.pos[who] - s.pos[lead]).view(np.uint64))
        members = np.add.reduceat(relative, begins).view(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([begins, [len(who)]]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(s.doc[who]), pa.array(s.pos[who] - most)], ["doc_id", "start"])
        )
        first = who[begins]
        yield pa.RecordBatch.from_arrays([pa.array(s.doc[first]), pa.array(s.pos[first] - most), pa.array(s.pos[first] - least + unit.length), pa.array(members), lists], ["doc_id", "start", "end", "members", "occurrences"])


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **sizes: int) -> DataFrame:
    """Maximal repeats of `length` bytes or more: group_doc, group_start (the first occurrence), n_bytes, doc_id, start: a row for each occurrence.

    A group's occurrences are all that are equal over n_bytes and are not all extended alike, neither to the left nor to the
    right. Of documents with equal texts only the owner is named. Texts of one doc_id follow each other by hash. Occurrences of
    a hot anchor's strings are grouped within each of its parts (dedup() compares those across parts by fingerprint).
    """
    unit = R.Unit(words=False, length=length, gram=gram, within=True, **sizes)

    def solved(batches):
        for part in R.shards(batches, unit.indexed):
            yield from _grouped(part, unit)

    pieces = cut(R.contexts(docs, R.with_owner(docs), unit).mapInArrow(solved, GROUPS), "groups")
    # pieces of one repeat, from neighbouring anchors: the same occurrences, windows without a gap
    order = Window.partitionBy("doc_id", "members").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces.withColumn("begins", F.coalesce(F.col("start") > reach - (length - 1), F.lit(True)).cast("int"))
    rows = rows.withColumn("number", F.sum("begins").over(order))
    whole = rows.groupBy("doc_id", "members", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("occurrences", "start").alias("occurrences"))
    out = whole.select(F.col("doc_id").alias("group_doc"), F.col("start").alias("group_start"), (F.col("end") - F.col("start")).alias("n_bytes"), F.explode("occurrences").alias("at"))
    return out.select(original_id("group_doc"), F.col("group_start").bitwiseAND(R.OFFSET).alias("group_start"), "n_bytes", F.col("at.doc_id").alias("doc_id"), F.col("at.start").bitwiseAND(R.OFFSET).alias("start")).withColumn("doc_id", original_id())


def _first_windows(own, a, buf, middle, doc, pos, unit):
    """Windows that start `a` bytes before the anchor, with two hashes of 64 bits."""
    for i in range(0, len(own), 1 << 13):
        part = own[i : i + (1 << 13)]
        rows = buf[(middle[part] - a)[:, None] + np.arange(unit.length)]
        up, _ = tn.powers(unit.length)
        f1 = tn.mix((tn.BYTE_CODE[rows] * up).sum(axis=1, dtype=np.uint64))
        f2 = tn.mix((tn.mix(tn.BYTE_CODE)[rows] * (up ^ tn.U64(0x5851F42D4C957F2C))).sum(axis=1, dtype=np.uint64))
        yield R.result(1, doc[part], pos[part] - a, pos[part] - a + unit.length, f1, f2)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, whole: bool = False, carry: list[str] | None = None, **sizes: int) -> DataFrame:
    """docs with all its columns (or those to carry), then bytes_kept (binary), bytes_in, bytes_removed, spans_removed and spans (start, end in bytes).

    Every byte that lies in a string of `length` bytes which also starts earlier (in a smaller doc_id, or earlier in the
    same document) is removed; with `whole`, only characters all of whose bytes do, so that what is left is UTF-8.
    """
    unit = R.Unit(words=False, length=length, gram=gram, within=True, **sizes)
    owners = R.with_owner(docs)
    carry = docs.columns if carry is None else carry
    texts = R.with_spans(docs, owners, R.find(docs, owners, unit, solve), carry)
    with_text = ["text"] if "text" in carry else []
    added = [T.StructField("bytes_kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("bytes_in", "bytes_removed", "spans_removed"))]
    added.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    schema = T.StructType([texts.schema["row"], *[texts.schema[c] for c in with_text], *added])

    def apply(batches):
        for batch in batches:
            yield from _removed(batch, length, whole, with_text)

    done = texts.mapInArrow(apply, schema)
    return done.select(*R.carried(carry), *[f.name for f in added])


def _removed(batch, length: int, whole: bool, with_text: list[str]):
    copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for a, b, buf, bounds in R._packed(batch):
        gone = R.covered(batch.column("spans"), a, b, bounds, copy, length)
        if whole and len(buf):
            char = np.cumsum((buf & 0xC0) != 0x80) - 1
            gone = (np.bincount(char, ~gone) == 0)[char]
        edge = np.zeros(len(buf) + 1, bool)
        edge[bounds] = True
        before, after = np.concatenate([[False], gone]) & ~edge, np.concatenate([gone, [False]]) & ~edge
        first, last = np.flatnonzero(gone & ~before[:-1]), np.flatnonzero(gone & ~after[1:]) + 1
        n_first, n_kept = np.searchsorted(first, bounds), np.concatenate([[0], np.cumsum(~gone)])[bounds]
        kept = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(n_kept.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[~gone]))])
        base = np.repeat(bounds[:-1], np.diff(n_first))
        spans = pa.ListArray.from_arrays(pa.array(n_first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "end"])).cast(kind)
        size = np.diff(bounds)
        yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ["row", *with_text]] + [kept, pa.array(size), pa.array(size - np.diff(n_kept)), pa.array(np.diff(n_first)), spans], ["row", *with_text, "bytes_kept", "bytes_in", "bytes_removed", "spans_removed", "spans"])


def query(docs: DataFrame, **sizes: int) -> DataFrame:
    out = dedup(docs, carry=["doc_id"], **sizes)
    return out.select("doc_id", F.col("bytes_in").alias("n_bytes"), F.col("bytes_removed").alias("n_removed"), F.col("spans_removed").alias("n_spans"), F.sha2("bytes_kept", 256).alias("kept_sha256"))


def stage(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without repeated passages, n_chars anew; only whole characters go, and texts of which nothing is left."""
    out = dedup(apart(docs), length, whole=True).withColumn("text", F.when((F.col("bytes_removed") > 0) & F.col("text").isNotNull(), F.col("bytes_kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("bytes_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out.where("bytes_removed = 0 or length(bytes_kept) > 0"), docs.columns)

"""Near-duplicate documents by fast similarity sketching, banding and exact verification (operator 8).

A sketch has T coordinates. In round i each shingle is hashed to one coordinate (from round T on: all to coordinate
i - T) with a value in [i, i + 1), and a coordinate keeps its least value; the rounds end when every coordinate has
one. A long document needs a few rounds, so a sketch costs O(n + T log T) and not O(n T), and the share of equal
coordinates of two documents is as concentrated about their similarity as with independent hashes.

Documents with equal shingle sets form one class. The sketches of classes are cut into bands; classes that share a band
are candidates. At similarity 0.75, 32 bands of 4 coordinates all differ with probability 5e-6. A band's classes are not
paired off: in each of some rounds they are compared with one class of theirs (the hub), links are confirmed on the
full shingle sets, and components contracted, so most of a large group is one component after a round or two. What
is then left in bands of several components is compared across components: by sketch first (a pair whose sketches agree
by five standard deviations less than 0.75 is passed over), then by sets, the likeliest first, until a class is linked with
a component. A pair that shares several bands is compared in the first. A band that is left with more than a block of
BLOCK classes (or SHINGLES shingles) holds texts that are alike but mostly under the threshold; its classes are dealt
anew by their rarest shingles, of which two linked sets share one among the first quarter (an exact prefix filter), so the
pairs of a large band are not all compared. Groups of that deal over a block go in cells, a block with another in each.

A null text, or one without words, has no shingles and no links. Rows that repeat a doc_id are each a row of the
result; a null doc_id sorts last and is kept only if its component has no other id. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerolith.llm import textnum as tn
from aerolith.llm.common import LAST_ID, apart, back, bounded_batches, cut, drop, order_id, original_id

WORDS, T, BAND, PERCENT, AT_ONCE = 5, 128, 4, 75, 1 << 20
#: Sketches of a pair at the threshold agree in fewer coordinates than this once in three million times.
AGREE = int(T * (PERCENT / 100 - 5 * (0.75 * 0.25 / T) ** 0.5))
#: Rounds of hubs; classes and shingles (8 bytes each) in a block of the last comparison.
HUB_ROUNDS, BLOCK, SHINGLES = 2, 2048, 8 << 20


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For some texts at a time: first text, n + 1 bounds, hashes of each text's distinct shingles in order."""
    for a, b in tn.runs(ends - starts, AT_ONCE):
        buf, bounds = tn.joined(data, starts[a:b], ends[a:b])
        x, y, by_doc = tn.words(buf, bounds)
        codes = tn.Rolling(tn.BYTE_CODE[tn.LOWER[buf]]).spans(x, y) | tn.U64(1)
        rolling = tn.Rolling(codes)
        sizes = np.diff(by_doc)
        n = np.where(sizes >= WORDS, sizes - WORDS + 1, (sizes > 0).astype(np.int64))
        of = np.repeat(np.arange(b - a), n)
        at = tn.spread(by_doc[:-1], n)
        h = rolling.spans(at, np.minimum(at + WORDS, by_doc[1:][of]))
        order = np.lexsort((h, of))
        h = h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
        yield a, np.searchsorted(of, np.arange(b - a + 1)), h


def sketches(bounds: np.ndarray, shingles: np.ndarray, t: int = T) -> np.ndarray:
    """A row of t coordinates for each set; the sets must not be empty."""
    n = len(bounds) - 1
    out = np.full(n * t, tn.NONE, np.uint64)
    x, of = shingles, np.repeat(np.arange(n), np.diff(bounds))
    shift = tn.U64(64 - (t - 1).bit_length())
    for i in range(2 * t):
        z = tn.mix(x + tn.U64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = of * t + (((z >> shift) % tn.U64(t)).astype(np.int64) if i < t else i - t)
        np.minimum.at(out, at, (tn.U64(i) << tn.U64(48)) | (tn.mix(z) >> tn.U64(16)))
        open_ = (out.reshape(n, t) == tn.NONE).any(axis=1)
        if not open_.any():
            break
        left = open_[of]
        x, of = x[left], of[left]
    return out.reshape(n, t)


def _set_keys(bounds: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """64 bits that tell sets apart (0 for the empty one)."""
    n = np.diff(bounds)
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(tn.mix(shingles + tn.U64(7)), out=sums[1:])
    mixed = tn.mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ (n.astype(np.uint64) << tn.U64(40))) | tn.U64(1)
    return np.where(n > 0, mixed, tn.U64(0)).view(np.int64)


def _sketched(batches):
    for batch in batches:
        ids, hashes = batch.column("doc_id"), batch.column("th")
        data, starts, ends = tn.utf8(batch.column("text"))
        for a, bounds, shingles in shingle_sets(data, starts, ends):
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            rows = sketches(np.concatenate([[0], np.cumsum(n[full])]), shingles) if len(full) else np.zeros((0, T), np.uint64)
            short = (tn.mix(rows) & tn.U64(0xFFFFFFFF)).astype(np.uint32)
            offsets = np.concatenate([[0], np.cumsum((n > 0) * 4 * T)]).astype(np.int32)
            sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(short))])
            yield pa.RecordBatch.from_arrays([ids.slice(a, len(n)), hashes.slice(a, len(n)), pa.array(n), pa.array(_set_keys(bounds, shingles)), sketch], ["doc_id", "th", "n", "cls", "sketch"])


def _banded(batches):
    """A row for each band of each sketch: the band's hash, its number, the class."""
    for batch in batches:
        data, starts, ends = tn.utf8(batch.column("sketch"))
        buf, _ = tn.joined(data, starts, ends)
        rows = np.frombuffer(buf.tobytes(), np.uint32).reshape(-1, T // BAND, BAND).astype(np.uint64)
        key = np.broadcast_to(np.arange(T // BAND, dtype=np.uint64) + tn.U64(1), rows.shape[:2])
        for j in range(BAND):
            key = tn.mix(key * tn.U64(0x9E3779B97F4A7C15) + rows[:, :, j])
        cls = np.repeat(batch.column("cls").to_numpy(), T // BAND)
        band = np.tile(np.arange(T // BAND, dtype=np.int16), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(band), pa.array(cls)], ["key", "band", "cls"])


def _with_sets(batches):
    for batch in batches:
        want = batch.column("cls").to_numpy()
        data, starts, ends = tn.utf8(batch.column("text"))
        for a, bounds, shingles in shingle_sets(data, starts, ends):
            own = np.flatnonzero(_set_keys(bounds, shingles) == want[a : a + len(bounds) - 1])
            sizes = np.diff(bounds)[own]
            values = shingles[tn.spread(bounds[:-1][own], sizes)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(want[a + own]), lists], ["cls", "shingles"])


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    heads = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return heads, column.values.to_numpy(zero_copy_only=False).view(np.uint64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted, as unsigned numbers) are at the threshold or over it."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < PERCENT * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirmed(batches):
    """The pairs that are similar enough, by their full sets."""
    for batch in batches:
        (ha, va), (hb, vb) = _values(batch.column("sa")), _values(batch.column("sb"))
        ok = pa.array([similar(va[ha[i] : ha[i + 1]], vb[hb[i] : hb[i + 1]]) for i in range(batch.num_rows)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: classes) that the sets confirm."""
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_confirmed, "a long, b long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp: the least node of each node's component; edges: a, b. nodes: node, comp so far.

    Each step gives every component the least label next to it, then follows labels to their own labels, so that chains
    halve; steps go on until no edge joins two labels.
    """
    labels = nodes
    while True:
        a, b = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        left = cut(edges.join(a, "a").join(b, "b").where("ca <> cb").select(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).distinct(), "across")
        if not left.take(1):
            drop(left)
            return labels
        while True:
            # stars: all that a label's neighbours know is hung on the least of them
            down = left.groupBy("hi").agg(F.min("lo").alias("least"))
            star = left.join(down, "hi").select(F.col("least").alias("x"), F.col("lo").alias("y")).where("x <> y")
            more = star.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
            nxt = cut(down.select(F.col("least").alias("lo"), "hi").unionByName(more).distinct(), "stars")
            drop(left)
            left = nxt
            if not left.groupBy("hi").count().where("count > 1").take(1):
                break
        # a forest now: each label points at one smaller one
        forest, table = left.select(F.col("hi").alias("comp"), F.col("lo").alias("to")), left
        while True:
            up = forest.select(F.col("comp").alias("to"), F.col("to").alias("further"))
            jumped = cut(forest.join(up, "to", "left").select("comp", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "forest")
            drop(table)
            forest, table = jumped.select("comp", "to"), jumped
            if not jumped.where("moved").take(1):
                break
        nxt = cut(labels.join(forest, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        drop(labels, table)
        labels = nxt


def _across(batches):
    """Links between a block of a band's classes that ask and a block of those it holds, one for each pair of components."""

    def pairs(block):
        t = pa.Table.from_batches(block).combine_chunks()
        cls, comp, band = (t.column(c).to_numpy() for c in ("cls", "comp", "band"))
        asks, here = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("asks", "held"))
        rows = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint32).reshape(-1, T)
        heads, values = _values(t.column("shingles").chunk(0))
        own = {int(c): int(c) for c in np.unique(comp)}

        def find(c: int) -> int:
            while own[c] != c:
                own[c] = c = own[own[c]]
            return c

        found = []
        those = rows[here]
        for i in asks:
            equal = those == rows[i]
            agree = equal.sum(axis=1)
            near = np.flatnonzero((agree >= AGREE) & (comp[here] != comp[i]))
            if band[i] >= 0:  # a pair that shares several bands is compared in the first
                near = near[equal[near].reshape(-1, T // BAND, BAND).all(axis=2).argmax(axis=1) == band[i]]
            for j in here[near[np.argsort(-agree[near], kind="stable")]]:
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and similar(values[heads[i] : heads[i + 1]], values[heads[j] : heads[j + 1]]):
                    own[max(x, y)] = min(x, y)
                    found.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    held, last = [], None
    for batch in batches:
        key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        if not len(key):
            continue
        ends = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1), len(key)]
        for x, y in zip(ends, ends[1:], strict=False):
            if held and (key[x], part[x]) != last:
                yield from pairs(held)
                held = []
            held.append(batch.slice(x, y - x))
            last = (key[x], part[x])
    if held:
        yield from pairs(held)


def _split(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, main (its largest component), and into how many blocks those beside it (across) and all (down) are dealt, of keys with several components.

    placed: key, band, cls, comp; sizes: cls, n (shingles). A block has BLOCK classes and SHINGLES shingles, or a few more.
    """
    each = placed.join(sizes, "cls").groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("shingles"))
    total = [F.sum("n").alias("all"), F.sum("shingles").alias("all_sh"), F.count("*").alias("comps")]
    keys = each.groupBy("key").agg(F.max(F.struct("n", "comp", "shingles")).alias("most"), *total).where("comps > 1")
    blocks = lambda n, sh: F.ceil(F.greatest(n / BLOCK, sh / SHINGLES)).cast("long")
    across = blocks(F.col("all") - F.col("most.n"), F.col("all_sh") - F.col("most.shingles"))
    return keys.select("key", F.col("most.comp").alias("main"), across.alias("across"), blocks(F.col("all"), F.col("all_sh")).alias("down"))


def _cells(placed: DataFrame, split: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of a key: a cell for each block that asks with each block that is held, so that no task holds more than two."""
    left = placed.join(split, "key").withColumn("asking", F.col("comp") != F.col("main"))
    left = left.withColumns({"i": F.pmod(F.xxhash64("cls"), "across"), "j": F.pmod(F.xxhash64("cls", F.lit(1)), "down")})
    asked = F.when(F.col("asking"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("down") - 1), lambda j: F.col("i") * F.col("down") + j)).otherwise(F.array().cast("array<long>"))
    held = F.transform(F.sequence(F.lit(0).cast("long"), F.col("across") - 1), lambda i: i * F.col("down") + F.col("j"))
    cells = left.select("*", F.explode(F.array_union(asked, held)).alias("part"))
    asks = F.col("asking") & (F.expr("part div down") == F.col("i"))
    cells = cells.select("key", "part", "band", "cls", "comp", asks.alias("asks"), (F.col("part") % F.col("down") == F.col("j")).alias("held"))
    parts = cells.join(wanted.select("cls", "sketch"), "cls").join(sets, "cls").select("key", "part", "band", "cls", "comp", "sketch", "shingles", "asks", "held")
    return cut(parts.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_across, "a long, b long").distinct(), "links")


def _rare(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """key (a shingle), band (-1), cls, comp: of each class the rarest shingles, as many as it cannot lack all of in a set it is linked with.

    Two sets at the threshold share at least that share of the larger one, so their shingles in any common order share one
    among the first n - ceil(share n) + 1 of each; in the order of rarity few sets share those. Exact, whatever the sketches.
    """
    rows = cut(classes.join(sets, "cls").select("cls", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("key")), "shingles")
    often = cut(rows.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"), "often")
    order = Window.partitionBy("cls").orderBy("often", "key")
    ranked = rows.join(often, "key", "left").withColumn("often", F.coalesce("often", F.lit(1))).withColumn("at", F.row_number().over(order))
    first = ranked.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1).where("often > 1")
    out = cut(first.select("key", F.lit(-1).cast("short").alias("band"), "cls", "comp"), "rare")
    drop(rows, often)
    return out


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, cls of every row of docs; labels: node, comp of the classes that have a candidate)."""
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    texts = docs.select(order_id().alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = cut(texts.mapInArrow(_sketched, "doc_id long, th long, n long, cls long, sketch binary"), "sketches")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    banded = classes.select("cls", "sketch").mapInArrow(_banded, "key long, band short, cls long")
    full = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
    # what is joined by a band or a class is a table, so that a hot one's join can be split
    full = cut(full, "full")
    members = cut(banded.join(full, "key"), "members")
    drop(full)
    wanted = cut(members.select("cls").distinct().join(classes, "cls"), "wanted")
    # by id and text: an id (a null one) of many rows meets only its own text's classes
    owners = texts.join(wanted.select("cls", "at.doc_id", "at.th"), ["doc_id", "th"]).select("cls", "text")
    sets = cut(owners.mapInArrow(_with_sets, "cls long, shingles array<long>").dropDuplicates(["cls"]), "sets")
    labels = wanted.select(F.col("cls").alias("node"), F.col("cls").alias("comp"))
    for turn in range(HUB_ROUNDS):
        placed = members.join(labels, members.cls == labels.node).select("key", "cls", "comp")
        # the first hub is the least class, the same in all of a group's bands; later each band has its own
        place = F.col("cls") if not turn else F.xxhash64("cls", "key", F.lit(turn))
        hubs = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(place.alias("p"), "cls", "comp")).alias("hub")).where("lo < hi")
        hubs = cut(hubs, "hubs")
        pairs = placed.join(hubs, "key").where("comp <> hub.comp").select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b")).distinct()
        links = cut(_links(pairs, sets), "links")
        found = links.take(1)
        if found:
            labels = components(labels, links)
        drop(links, hubs)
        if not found:
            break
    sizes = wanted.select("cls", "n")
    placed = members.join(labels, members.cls == labels.node).select("key", "band", "cls", "comp")
    split = cut(_split(placed, sizes), "split")
    found = [_cells(placed, split.where("across * down <= 1"), wanted, sets)]
    if split.where("across * down > 1").take(1):
        # what is left of a large band is alike but mostly under the threshold: its classes meet by their rarest shingles instead
        classes = placed.join(split.where("across * down > 1").select("key"), "key").select("cls", "comp").distinct()
        rare = _rare(classes, sets)
        again = cut(_split(rare, sizes), "split")
        found.append(_cells(rare, again, wanted, sets))
        drop(rare, again)
    links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if links.take(1):
        labels = components(labels, links)
    drop(split, members, sets, *found)
    linked = rows.select("doc_id", "n", "cls")
    linked.reads = rows, wanted
    return linked, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    rows, labels = link(docs)
    own = rows.groupBy("cls").agg(F.min("doc_id").alias("least")).where("cls <> 0")
    comp = own.join(labels, own.cls == labels.node, "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "least")
    least = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = cut(comp.join(least, "comp").select("cls", "component_id"), "of")
    out = rows.join(of, "cls", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(original_id(), F.col("n").alias("n_shingles"), original_id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def stage(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id (a null one comes last), then the least text hash.

    Rows are told apart by a number of their own, so repeated and null ids count as the rows they are. Of rows that repeat
    an id and a text without words one stays; those of null ids have no group and stay.
    """
    names, found = docs.columns, apart(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.xxhash64(*[F.col(c).cast("string") for c in ("lang", "source", "n_chars") if c in names])
    rank = F.struct(order_id().alias("id"), F.sha2(text, 256).alias("th"), rest.alias("rest"))
    rows = cut(found.select("*", rank.alias("__rank"), F.monotonically_increasing_id().alias("__row")), "rows")
    linked, labels = link(rows.select(F.col("__row").alias("doc_id"), "text"))
    ranked = linked.select(F.col("doc_id").alias("__row"), "n", "cls").join(rows.select("__row", "__rank"), "__row")
    first = F.min(F.struct("__rank", "__row")).alias("first")
    classes = ranked.where("n > 0").groupBy("cls").agg(first)
    groups = classes.join(labels, classes.cls == labels.node, "left").groupBy(F.coalesce("comp", "cls").alias("comp")).agg(F.min("first").alias("first"))
    alone = ranked.where("n = 0")
    # a null id names no document: its rows are grouped by themselves
    single = alone.groupBy("__rank.id", "__rank.th", F.when(F.col("__rank.id") == LAST_ID, F.col("__row")).alias("own")).agg(first)
    keep = cut(groups.select("first.__row").unionByName(single.select("first.__row")), "keep")
    drop(labels, *linked.reads)
    return back(rows.join(keep, "__row"), names)

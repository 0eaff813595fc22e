"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search (operator 4).

The tree is fitted on a bounded sample of unit vectors: k-means with BRANCH centres, again within each cluster. Every
vector is then put in the leaf that it reaches by the nearest centre at each level. A query visits leaves best bin first: a
priority queue holds the branches passed by, by their centres' distance, and the nearest is opened next. How many
leaves that takes is calibrated on the sample: visits widen until the nearest of a set of sample queries are found
with the recall asked for.

The sample does not grow with the data, but a leaf's vectors do. A leaf of over PART vectors gets a subtree, fitted in a task on a
bounded sample of the leaf's own (SUB_SAMPLE) and calibrated there; subtrees go by shuffle to the leaf's vectors and to the
queries that visit it, which visit its bins best bin first again. So a query's work hangs on bins of some PART vectors
until there are some hundred times as many leaves.

Equal vectors are indexed once, with their K + 1 smallest ids (no query needs more); equal queries are searched once. A
bin's vectors are dealt to parts of PART, each held by one task, past which the queries that visit the bin stream in
blocks. Scores are cosines of the original vectors in double precision; ties go to the smaller id.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than most.
Rows that repeat a vec_id are one candidate for each different vector, and one query each. With fewer than K candidates
a query gets all, with none no row. Other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from aerolith.llm.common import cut

K, EVERY, BRANCH, PART, BLOCK = 5, 50, 8, 4096, 512
#: Vectors of a large leaf that its subtree is fitted on, bins of all subtrees' numbers, how many times the calibrated visits are made there.
SUB_SAMPLE, BINS, SUB_WIDER = 8192, 1 << 20, 1.5
#: Floats in the sample at most, vectors in it, vectors of it in a leaf, calibration queries, recall asked for there.
SAMPLE_FLOATS, SAMPLE, LEAF, ASKED, RECALL = 8_000_000, 20_000, 48, 256, 0.98


class Tree:
    """Centres of all nodes (row 0: the root), each node's children, and each leaf's number."""

    def __init__(self, vectors: np.ndarray, branch: int = BRANCH, leaf: int = LEAF):
        self.centres, self.children = [vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])], [[]]
        todo, rng = [(0, np.arange(len(vectors)))], np.random.default_rng(1)
        while todo:
            node, own = todo.pop(0)
            if len(own) <= leaf:
                continue
            centres, label = _kmeans(vectors[own], branch, rng)
            if len(np.unique(label)) < 2:
                continue
            for i in range(len(centres)):
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own[label == i]))
                self.centres.append(centres[i])
                self.children.append([])
        self.centres = np.array(self.centres)
        self.leaves = [i for i, c in enumerate(self.children) if not c]
        self.leaf_of = {node: i for i, node in enumerate(self.leaves)}

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, own = todo.pop()
            if not self.children[node]:
                out[own] = self.leaf_of[node]
            elif len(own):
                label = _nearest(vectors[own], self.centres[self.children[node]])
                todo += [(child, own[label == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, distances: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of best bin first; distances: of a query to all nodes."""
        out: list[int] = []
        queue, far = [(0.0, 0)], distances.tolist()
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                best = min(self.children[node], key=far.__getitem__)
                for child in self.children[node]:
                    if child != best:
                        heapq.heappush(queue, (far[child], child))
                node = best
            out.append(self.leaf_of[node])
        return out

    def distances(self, queries: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1) - 2.0 * queries @ self.centres.T


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2.0 * vectors @ centres.T).argmin(axis=1)


def _kmeans(vectors: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), min(k, len(vectors)), replace=False)]
    for _ in range(8):
        label = _nearest(vectors, centres)
        n = np.bincount(label, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, vectors)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    label = _nearest(vectors, centres)
    used, label = np.unique(label, return_inverse=True)
    return centres[used], label


def calibrate(tree: Tree, sample: np.ndarray, recall: float = RECALL) -> int:
    """Leaves to visit so that the sample's queries find that share of their nearest."""
    if len(sample) < 2:
        return 1
    asked = sample[:: max(1, len(sample) // ASKED)]
    own = tree.assign(sample)
    scores = asked @ sample.T
    nearest = np.argsort(-scores, axis=1)[:, : K + 1]
    far = tree.distances(asked)
    needed = []
    for i in range(len(asked)):
        turn = {leaf: j for j, leaf in enumerate(tree.visits(far[i], len(tree.leaves)))}
        needed += [turn[int(leaf)] + 1 for leaf in own[nearest[i, 1:]]]
    return int(np.sort(needed)[int(np.ceil(recall * len(needed))) - 1])


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _subtrees(members: DataFrame, large: DataFrame, most: int) -> DataFrame:
    """leaf, tree (pickled: a Tree and the bins to visit) of the large leaves (leaf, n), each from a sample of its vectors."""

    def built(batches):
        def tree(leaf, n, vectors):
            vectors = _unit(np.concatenate(vectors))
            made = Tree(vectors, leaf=max(16, int(len(vectors) * most / (2 * n))))
            visits = min(len(made.leaves), int(np.ceil(SUB_WIDER * calibrate(made, vectors))))
            return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int32()), pa.array([pickle.dumps((made, visits))], pa.binary())], ["leaf", "tree"])

        last, held = None, []
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            ends = np.flatnonzero(leaf[1:] != leaf[:-1]) + 1
            for x, y in zip([0, *ends], [*ends, len(leaf)], strict=True):
                if x == y:
                    continue
                if held and leaf[x] != last[0]:
                    yield tree(*last, held)
                    held = []
                last = int(leaf[x]), batch.column("n")[x].as_py()
                held.append(_matrix(batch.column("embedding").slice(x, y - x)))
        if held:
            yield tree(*last, held)

    few = members.join(F.broadcast(large), "leaf").where(F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n") / SUB_SAMPLE)) == 0)  # at most the tree's leaves
    return cut(few.select("leaf", "n", "embedding").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(built, "leaf int, tree binary"), "subtrees")


def _refined(rows: DataFrame, trees: DataFrame, parts: DataFrame, each_visit: bool) -> DataFrame:
    """rows (key, embedding, leaf and more) of large leaves with bin: the one that holds the vector, or with each_visit a row for each that a query visits.

    A leaf's rows are dealt to parts (leaf, parts), and each part gets the leaf's subtree first.
    """
    names = [c for c in rows.columns if c != "leaf"]
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names]
    ahead = trees.join(parts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "tree", *none)
    then = rows.join(F.broadcast(parts), "leaf").select("leaf", F.pmod("key", "parts").cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), *names)
    dealt = ahead.unionByName(then).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind")

    def placed(batches):
        tree, visits = None, 1
        for batch in batches:
            leaf, kind, part = (batch.column(c).to_numpy() for c in ("leaf", "kind", "part"))
            ends = np.flatnonzero((leaf[1:] != leaf[:-1]) | (kind[1:] != kind[:-1]) | (part[1:] != part[:-1])) + 1
            for x, y in zip([0, *ends], [*ends, len(leaf)], strict=True):
                if x == y:
                    continue
                if not kind[x]:
                    tree, visits = pickle.loads(batch.column("tree")[x].as_py())
                    continue
                own = batch.slice(x, y - x)
                unit = _unit(_matrix(own.column("embedding")))
                if each_visit:
                    found = [tree.visits(far, visits) for far in tree.distances(unit)]
                    of, bins = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.array([b for f in found for b in f], np.int64)
                else:
                    of, bins = np.arange(len(own)), tree.assign(unit)
                at = pa.array(of.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[own.column(c).take(at) for c in names], pa.array(int(leaf[x]) * BINS + bins)], [*names, "bin"])

    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("bin", T.LongType())])
    return dealt.mapInArrow(placed, schema)


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score; vectors: vec_id, embedding. is_query: a condition on vec_id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null").where(sound)
    rows = cut(rows.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("key")), "vectors")
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = common[0]["dim"] if common else 0
    rows = rows.where(F.col("dim") == dim).drop("dim")
    # each task hands on at most k + 1 rows of a vector
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("place", first).where(F.col("place") <= k + 1)
    index = few.groupBy("key").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    most = max(1, min(SAMPLE, SAMPLE_FLOATS // max(dim, 1)))
    sample = index.select("embedding", "key").orderBy(F.xxhash64("key"), "key").limit(most).toPandas()
    known = _unit(np.array(sample["embedding"].tolist(), np.float64).reshape(len(sample), -1)) if len(sample) else np.zeros((0, max(dim, 1)))
    tree = Tree(known)
    visits = calibrate(tree, known)

    def placed(batches):
        for batch in batches:
            leaf = tree.assign(_unit(_matrix(batch.column("embedding")))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("embedding"), batch.column("ids"), pa.array(leaf.astype(np.int32))], ["key", "embedding", "ids", "leaf"])

    kind = rows.schema["embedding"].dataType.simpleString()
    members = cut(index.select("key", "embedding", "ids").mapInArrow(placed, f"key long, embedding {kind}, ids array<long>, leaf int"), "members")
    sizes = members.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > PART).collect()  # leaves of the tree: bounded with the sample
    whole = lambda df, *more: df.select("key", "embedding", *more, (F.col("leaf").cast("long") * BINS).alias("bin"))
    if sizes:
        large = vectors.sparkSession.createDataFrame([(r["leaf"], r["n"]) for r in sizes], "leaf int, n long").coalesce(1)
        trees = _subtrees(members, large, PART)
        streams_of = large.select("leaf", F.ceil(F.col("n") / (8 * PART)).cast("int").alias("parts"))
        small = members.join(F.broadcast(large), "leaf", "left_anti")
        deep = _refined(members.join(F.broadcast(large.select("leaf")), "leaf", "left_semi"), trees, streams_of, False)
        binned = cut(whole(small, "ids").unionByName(deep.select("key", "embedding", "ids", "bin")), "binned")
    else:
        binned = whole(members, "ids")
    parts = binned.groupBy("bin").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    asking = rows.where(is_query)

    def visited(batches):
        for batch in batches:
            far = tree.distances(_unit(_matrix(batch.column("embedding")))) if batch.num_rows else np.zeros((0, 1))
            leaves = [tree.visits(x, visits) for x in far]
            of = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
            flat = np.array([y for x in leaves for y in x], np.int32)
            at = pa.array(of.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("embedding").take(at), pa.array(flat)], ["key", "embedding", "leaf"])

    asked = members.join(asking.select("key").distinct(), "key", "left_semi").select("key", "embedding")
    bins = asked.repartition("key").mapInArrow(visited, f"key long, embedding {kind}, leaf int")
    if sizes:
        bins = cut(bins, "visits")
        deep = _refined(bins.join(F.broadcast(large.select("leaf")), "leaf", "left_semi"), trees, streams_of, True)
        bins = whole(bins.join(F.broadcast(large), "leaf", "left_anti")).unionByName(deep.select("key", "embedding", "bin"))
    else:
        bins = whole(bins)
    ids = F.expr("cast(null as array<bigint>)").alias("ids")
    streams = bins.join(parts, "bin").select("bin", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks"), "key", "embedding", ids)
    held = binned.join(parts, "bin").select("bin", F.pmod("key", "parts").cast("int").alias("part"), F.lit(0).alias("asks"), "key", "embedding", "ids")
    dealt = held.unionByName(streams).repartition("bin", "part").sortWithinPartitions("bin", "part", "asks")

    def compared(batches):
        here, part, index_ = None, [], None
        for batch in batches:
            leaf, piece, asks = (batch.column(c).to_numpy() for c in ("bin", "part", "asks"))
            edge = np.flatnonzero((leaf[1:] != leaf[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1])) + 1
            for x, y in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                if x == y:
                    continue
                if (leaf[x], piece[x]) != here:
                    here, part, index_ = (leaf[x], piece[x]), [], None
                block = batch.slice(x, y - x)
                if not asks[x]:
                    part.append(block)
                    continue
                if not part:
                    continue
                if index_ is None:
                    t = pa.Table.from_batches(part).combine_chunks()
                    v = _matrix(t.column("embedding").chunk(0))
                    index_ = v, np.linalg.norm(v, axis=1), t.column("ids").to_pylist()
                v, norms, its = index_
                for i in range(0, len(block), BLOCK):
                    few_ = block.slice(i, BLOCK)
                    q = _matrix(few_.column("embedding"))
                    scores = q @ v.T / (np.linalg.norm(q, axis=1)[:, None] * norms)
                    n = min(k + 1, scores.shape[1])
                    kth = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
                    out = []
                    for j, key in enumerate(few_.column("key").to_pylist()):
                        # all that tie with the last place, as ids decide there
                        best = np.flatnonzero(scores[j] >= kth[j])
                        pairs = sorted((-scores[j, b], u) for b in best for u in its[b])[: k + 1]
                        out += [(key, u, -s) for s, u in pairs]
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["key", "vec_id", "score"])

    found = dealt.mapInArrow(compared, "key long, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    top = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("top"))
    out = asking.select(F.col("vec_id").alias("query_id"), "key").join(top, "key")
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("rank", "it"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("it.vec_id").alias("vec_id"), (-F.col("it.less")).alias("score"))


def query(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % EVERY == 0)

"""Packing token sequences by best fit, longest first (operator 9).

Documents are tokenised whole (plus an end token), cut into full windows of `size` tokens and a remainder; a full window
is a sequence of its own. Remainders are dealt to blocks of about BLOCK documents by hash, so that any number of blocks
pack side by side; in a block they come longest first, and each goes to the open sequence that it leaves least room in,
found in a segment tree indexed by remaining capacity. A sequence's id holds its block's number in the upper bits.

A null or empty text is the end token alone. Rows that repeat a doc_id are packed each. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerolith.llm import textnum as tn
from aerolith.llm.common import bounded_batches, cut

SIZE, END, BLOCK, AT_ONCE = 4096, 2, 50_000, 1 << 20
VOCABULARY = "word_bpe_49k.json"


@functools.cache
def _cache(vocabulary: str) -> tn.WordCache:
    """This vocabulary drops white space, so that words can be cut apart; strings of added tokens within a word become those tokens, as in the whole text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(vocabulary)
    return tn.WordCache(lambda words: [x.ids for x in model.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)])


def tokenised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: the first, n + 1 bounds, and the ids of all, each text's with the end token."""
    cache = _cache(vocabulary)
    for a, b in tn.runs(np.maximum(ends - starts, 32), AT_ONCE):
        buf, bounds = tn.joined(data, starts[a:b], ends[a:b])
        x, y, by_doc = tn.words(buf, bounds)
        codes = tn.Rolling(tn.BYTE_CODE[buf]).spans(x, y)
        distinct, index, inverse = np.unique(codes, return_index=True, return_inverse=True)
        raw, x, y = buf.tobytes(), x[index].tolist(), y[index].tolist()
        at, n, known = cache.of(distinct, lambda i: raw[x[i] : y[i]])
        size = n[inverse]
        ids = known[tn.spread(at[inverse], size)]
        before = np.concatenate([[0], np.cumsum(size)])[by_doc]
        out = np.full(len(ids) + b - a, END, np.uint32)
        out[tn.spread(before[:-1] + np.arange(b - a), np.diff(before))] = ids
        yield a, before + np.arange(b - a + 1), out


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, and columns of docs to carry) of each document's full windows and remainder."""
    bounded_batches(docs.sparkSession)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def apply(batches):
        for batch in batches:
            doc = batch.column("doc_id")
            for a, bounds, ids in tokenised(*tn.utf8(batch.column("text")), vocabulary):
                total = np.diff(bounds)
                n = (total + size - 1) // size
                of = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(total[of] - start, size)
                at = bounds[of] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
                cols = [doc.take(pa.array(a + of)), pa.array(start), pa.array(length), pa.array(crc), pa.array(total[of])]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([at, bounds[-1:]]).astype(np.int32)), pa.array(ids.view(np.int32))))
                cols += [batch.column(c).take(pa.array(a + of)) for c in carry]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []), *carry]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *carry).mapInArrow(apply, schema)


class OpenSequences:
    """Open sequences by remaining capacity, in a segment tree whose nodes count those below them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least `need`, which is then no longer open, and its room."""
        i, tree = need + self.leaves, self.tree
        if not tree[i]:
            # up to the first right-hand neighbour that holds any, then down to its first
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not tree[i]:
                    i += 1
        room = i - self.leaves
        self._add(room, -1)
        return self.at[room].pop(), room


def pack(parts: DataFrame, size: int = SIZE, blocks: int = 1) -> DataFrame:
    """parts with sequence_id and offset; packed are the pieces of a block, which is a column of parts or their hash."""
    names = [c for c in parts.columns if c != "block"]

    def apply(batches):
        block, open_, opened = None, None, 0
        for batch in batches:
            sequence, offset = [], []
            for own, length in zip(batch.column("block").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if own != block:
                    block, open_, opened = own, OpenSequences(size), 0
                found = open_.take(length) if length < size else None
                at, room = found or (opened, size)
                opened += found is None
                sequence.append(block << 40 | at)
                offset.append(size - room)
                if room > length:
                    open_.put(room - length, at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    dealt = parts if "block" in parts.columns else parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    dealt = dealt.repartition("block").sortWithinPartitions("block", F.desc("length"), "doc_id", "start", "ids_crc32")
    like = parts.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.mapInArrow(apply, like.schema)


def packed(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    blocks = max(1, -(-docs.count() // BLOCK))
    return pack(pieces(docs, size, vocabulary, with_ids), size, blocks)


def query(docs: DataFrame) -> DataFrame:
    return packed(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text with __file and __row, by which rows stand in the order in which they were written (files of one table, by name and row)."""
    try:
        at = docs.metadataColumn("_metadata")
        places = at["file_path"].alias("__file"), at["row_index"].alias("__row")
        rows = docs.select("doc_id", "text", *places)
        rows.schema  # noqa: B018  fails here if the rows are of no file
    except AnalysisException:
        rows = docs.select("doc_id", "text", F.lit("").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    return rows


def stage(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, stretch: int = BLOCK) -> DataFrame:
    """The documents' pieces, each in its place of a sequence, with position: the place of its document in training order.

    docs come in training order. Packed together are only documents of a stretch of that order (of at most `stretch` rows, in
    one file), and sequence ids ascend from stretch to stretch, so that a curriculum stays one.
    """
    parts = pieces(in_order(docs), size, vocabulary, carry=("__file", "__row"))
    parts = cut(parts.withColumn("__stretch", F.expr(f"__row div {stretch}")), "pieces")
    # one row for each stretch
    order = Window.orderBy(F.length("__file"), "__file", "__stretch")
    number = parts.select("__file", "__stretch").distinct().withColumn("block", (F.row_number().over(order) - 1).cast("long"))
    rows = parts.join(number, ["__file", "__stretch"]).withColumn("position", F.col("block") * (1 << 36) + F.col("__row") % stretch)
    return pack(rows.drop("__file", "__row", "__stretch"), size)

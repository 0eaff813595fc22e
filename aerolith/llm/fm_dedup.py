"""Removal of long word passages by compressed FM-indexes (operator 7).

Each shard (see repeats.py) builds an FM-index over the words of its distinct contexts: the Burrows-Wheeler transform in
a wavelet tree (as a matrix of bit-packed levels with counts, 1.1 bits a symbol and level). Documents' contexts are
then streamed through it from their last word to their first, all in step: a backward step narrows the interval of the
suffix array by one more word on the left; where it would empty, the match gives up words on the right, by way of the
parent interval. The match's length at each word is its matching statistic. Where it reaches `length` words, the interval
is that of the window, the same for every occurrence; as all that is indexed is streamed, each occurrence brings its doc_id
to its interval, and the smallest is known. So the index locates nothing and holds no suffix array, sampled or whole:
packed bits, a byte for each common prefix, and links to parent intervals (8 bytes a symbol).

A null text has no words. Texts of under `length` words lose none. Repeated rows get equal results, rows that share a
doc_id are one document. Columns other than doc_id and text are handed on unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm import repeats as R
from aerolith.llm import textnum as tn

LENGTH, GRAM = 50, 8


class WaveletTree:
    """Counts of a symbol in prefixes of a sequence, as a matrix: one row of bits for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            packed = np.zeros((len(s) >> 6) + 1 << 3, np.uint8)
            rows = np.packbits(bit, bitorder="little")
            packed[: len(rows)] = rows
            packed = packed.view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]))
            self.zeros.append(len(s) - int(bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])
        self.base = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = i >> 6
            below = self.bits[k][word] & ((tn.U64(1) << (i & 63).astype(np.uint64)) - tn.U64(1))
            ones = self.counts[k][word] + np.bitwise_count(below)
            i = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first i."""
        return self._walk(symbol, i) - self.base[symbol]


class FMIndex:
    """Of a text of symbols (0: a separator, which no pattern holds); order and intervals are good for patterns of up to `most`."""

    def __init__(self, text: np.ndarray, n_symbols: int, most: int):
        n = self.n = len(text)
        self.most = most
        rank, ranks, k = text.astype(np.int32), [], 1
        while True:
            ranks.append(rank)
            if k > most:
                break
            key = rank.astype(np.int64) * (max(n, n_symbols) + 2)
            key[:-k] += rank[k:] + 1
            order = np.argsort(key)
            key = key[order]
            new = np.empty(n, np.int32)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank, k = new, k * 2
        sa = np.argsort(rank, kind="stable").astype(np.int32)
        self.tree = WaveletTree(text[sa - 1], n_symbols)  # text[-1] is a separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        # common prefixes of neighbours, up to `most`, from the ranks by powers of two
        x, y = sa[1:].copy(), sa[:-1].copy()
        common = np.zeros(n - 1, np.int32)
        for j in range(len(ranks) - 1, -1, -1):
            same = (x < n) & (y < n)
            same[same] = ranks[j][x[same]] == ranks[j][y[same]]
            step = same.astype(np.int32) << j
            common += step
            x += step
            y += step
        # one more than the common symbols, 0 at the ends
        self.lcp = np.concatenate([[0], np.minimum(common, most) + 1, [0]]).astype(np.uint8 if most < 255 else np.int32)
        self.smaller = _smaller(self.lcp, -1), _smaller(self.lcp, 1)

    def classes(self, length: int) -> np.ndarray:
        """Which suffixes agree on `length` symbols: a number for each place in the suffix array."""
        return np.cumsum(self.lcp[:-1] <= length, dtype=np.int32) - 1

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half-open intervals of patterns with one more symbol on the left."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        start = self.before[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger intervals, and the symbols their members have in common."""
        at = np.where(self.lcp[lo] >= self.lcp[hi], lo, hi)
        return self.smaller[0][at], self.smaller[1][at], np.maximum(self.lcp[at].astype(np.int64) - 1, 0)


def _smaller(values: np.ndarray, step: int) -> np.ndarray:
    """The nearest place before (-1) or after (1) each with a smaller value, by jumps over jumps; the ends hold the least."""
    n = len(values)
    out = np.arange(n, dtype=np.int32) + np.int32(step)
    out[0], out[-1] = 0, n - 1
    todo = np.arange(1, n - 1, dtype=np.int32)
    while len(todo):
        todo = todo[values[out[todo]] >= values[todo]]
        todo = todo[(out[todo] > 0) & (out[todo] < n - 1)]
        out[todo] = out[out[todo]]
    return out


def matching_statistics(index: FMIndex, streams: np.ndarray, sizes: np.ndarray, length: int):
    """Yields, for one word of every stream after another from its end: streams, offsets, the places in the suffix array at
    which their matches begin, where `length` words from the offset match. streams: padded rows; -1: a word the index lacks."""
    m = len(streams)
    at = sizes - 1
    lo, hi, q = np.zeros(m, np.int64), np.full(m, index.n), np.zeros(m, np.int64)
    shorter = index.classes(length - 1)
    heads = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1], [True]]))
    live = np.flatnonzero(at >= 0)
    while len(live):
        symbol = streams[live, at[live]]
        x, y = index.extend(np.maximum(symbol, 0), lo[live], hi[live])
        ok = (x < y) & (symbol >= 0)
        on, off = live[ok], live[~ok]
        lo[on], hi[on] = x[ok], y[ok]
        q[on] += 1
        full = on[q[on] >= length]
        yield full, at[full], lo[full]
        # one word less on the right: the next match of `length` begins with these
        block = shorter[lo[full]]
        lo[full], hi[full], q[full] = heads[block], heads[block + 1], length - 1
        at[on] -= 1
        root = (q[off] == 0) | (streams[off, at[off]] < 0)
        skip, up = off[root], off[~root]
        lo[skip], hi[skip], q[skip] = 0, index.n, 0
        at[skip] -= 1
        lo[up], hi[up], q[up] = index.parent(lo[up], hi[up])
        live = live[at[live] >= 0]


def solve(shard: pa.Table, unit: R.Unit):
    doc, pos, off, hot = (shard.column(c).to_numpy() for c in ("doc_id", "pos", "off", "hot"))
    buf, bounds = tn.joined(*tn.utf8(shard.column("body")))
    codes, by_context, _, _ = unit.units(buf, bounds)
    sizes = np.diff(by_context)
    length, m = unit.length, len(doc)
    rolling = tn.Rolling(codes)
    # equal contexts are indexed and streamed once, for the smallest doc_id
    same = rolling.spans(by_context[:-1], by_context[1:]) ^ tn.mix(off.astype(np.uint64))
    order = np.lexsort((doc, same))
    head = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    lead = np.empty(m, np.int64)
    lead[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    own = np.flatnonzero(lead == np.arange(m))
    _, symbols = np.unique(codes, return_inverse=True)
    width, k = int(sizes.max()), len(own)
    rows = np.full((k, width + 1), -1, np.int64)
    inside = np.arange(width + 1) < sizes[own][:, None]
    rows[inside] = symbols[tn.spread(by_context[own], sizes[own])] + 1
    text_at = np.arange(width + 1) <= sizes[own][:, None]
    index = FMIndex(np.maximum(rows, 0)[text_at], int(symbols.max()) + 2, length)
    classes = index.classes(length)
    near, far = np.full(k, width), np.full(k, -1)  # window starts that go: least, largest
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    matches = [(who.astype(np.int32), at.astype(np.int32), classes[place]) for who, at, place in matching_statistics(index, rows, sizes[own], length)]
    first_doc = np.full(int(classes[-1]) + 1, R.LAST_ID)
    for who, _, place in matches:
        np.minimum.at(first_doc, place, doc[own][who])
    for who, at, place in matches:
        gone = first_doc[place] < doc[own][who]
        x, where = who[gone], at[gone]
        near[x], far[x] = np.minimum(near[x], where), np.maximum(far[x], where)
        if hot.any():
            kept.append((own[who[~gone]], at[~gone]))
    # the others of equal contexts: a later document loses them all
    mine = np.empty(m, np.int64)
    mine[own] = np.arange(k)
    near, far = near[mine[lead]], far[mine[lead]]
    later = doc > doc[lead]
    near[later], far[later] = 0, sizes[later] - length
    got = np.flatnonzero(far >= 0)
    base = pos - off
    yield R.result(0, doc[got], base[got] + near[got], base[got] + far[got] + length)
    if kept:
        who, at = np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])
        who, at = who[hot[who]], at[hot[who]]
        # the same document's other contexts like a streamed one ask at their own places
        again = np.flatnonzero(hot & ~later & (lead != np.arange(m)))
        order = np.argsort(who, kind="stable")
        x, y = (np.searchsorted(who[order], lead[again], side) for side in ("left", "right"))
        at = np.concatenate([at, at[order][tn.spread(x, y - x)]])
        who = np.concatenate([who, np.repeat(again, y - x)])
        second = tn.Rolling(tn.mix(codes) | tn.U64(1))
        for i in range(0, len(who), 1 << 15):
            w, a = who[i : i + (1 << 15)], at[i : i + (1 << 15)]
            x = by_context[w] + a
            yield R.result(1, doc[w], base[w] + a, base[w] + a + length, rolling.spans(x, x + length), second.spans(x, x + length))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: list[str] | None = None, **sizes: int) -> DataFrame:
    """docs with all its columns (or those to carry), then text_kept (words kept, joined by a space), words_in, words_removed.

    Removed is every word covered by a window of `length` consecutive words whose sequence also starts in a document
    with a smaller doc_id.
    """
    unit = R.Unit(words=True, length=length, gram=gram, within=False, **sizes)
    owners = R.with_owner(docs)
    carry = docs.columns if carry is None else carry
    texts = R.with_spans(docs, owners, R.find(docs, owners, unit, solve), carry)
    with_text = ["text"] if "text" in carry else []
    schema = T.StructType([texts.schema["row"], *[texts.schema[c] for c in with_text], T.StructField("text_kept", T.BinaryType()), T.StructField("words_in", T.LongType()), T.StructField("words_removed", T.LongType())])

    def apply(batches):
        for batch in batches:
            yield from _removed(batch, length, with_text)

    done = texts.mapInArrow(apply, schema)
    return done.select(*R.carried(carry), F.col("text_kept").cast("string").alias("text_kept"), "words_in", "words_removed")


def _removed(batch, length: int, with_text: list[str]):
    copy = batch.column("copy").to_numpy(zero_copy_only=False).astype(bool)
    for a, b, buf, bounds in R._packed(batch):
        starts, ends, by_doc = tn.words(buf, bounds)
        sizes = np.diff(by_doc)
        kept = ~R.covered(batch.column("spans"), a, b, by_doc, copy, length)
        n_kept = np.concatenate([[0], np.cumsum(kept)])[by_doc]
        own = np.flatnonzero(kept)
        # the byte after each kept word but a document's last becomes the space
        last = np.zeros(len(own), bool)
        last[n_kept[1:][n_kept[1:] > n_kept[:-1]] - 1] = True
        x, y = starts[own], ends[own] + ~last
        spaced = np.where(tn.SPACE[buf], np.uint8(0x20), buf)
        out = spaced[tn.spread(x, y - x)]
        offsets = np.concatenate([[0], np.cumsum(y - x)])[n_kept].astype(np.int32)
        text = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([batch.column(c).slice(a, b - a) for c in ["row", *with_text]] + [text, pa.array(sizes), pa.array(sizes - np.diff(n_kept))], ["row", *with_text, "text_kept", "words_in", "words_removed"])


def query(docs: DataFrame, **sizes: int) -> DataFrame:
    out = dedup(docs, carry=["doc_id"], **sizes)
    return out.select("doc_id", F.col("words_in").alias("n_words"), F.col("words_removed").alias("n_removed"), F.sha2("text_kept", 256).alias("kept_sha256"))

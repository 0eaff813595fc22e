"""Quality rules by tokeniser fertility (operator 3).

A public vocabulary with byte fallback cuts each word into pieces. Of each document: characters per token, the share of
tokens that are bytes, and the entropy of its tokens. Text that the vocabulary fits badly (encoded data, wrong encodings,
noise) has few characters per token and many bytes; repetition has little entropy, random strings have much. What is
usual depends on the language (the script, where the language is null) and on the length, so bands are taken from the
corpus: the quartiles over all documents of a language and a doubling of the token count, widened by WIDE interquartile
ranges (at least by SLACK of the quartile, for groups that are nearly all alike). Where those are under LEAST documents,
the band is that of the first wider group that has as many: neighbouring doublings, then (characters and bytes, which hang
on the language more than on the length) all lengths, then the script, then the corpus; for the entropy, which hangs on the
length, the script at that length comes before the language at all lengths (see WIDER and NEAREST). Only a corpus of under LEAST documents in all has no bands. A document outside a band is rejected. Words are cut
apart from each other; white space makes no token.

A null text has no words and is base_failed. Rows that repeat a doc_id are judged each by its text. Other columns but
lang are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm import textnum as tn
from aerolith.llm.common import bounded_batches, cut

AT_ONCE, CACHED = 1 << 20, 150_000
WIDE, SLACK, LEAST = 3.0, 0.02, 50
CELL = ["group", "script", "size"]
#: Groups that a band can be taken from, the closest first: whose documents, and how many doublings of the token count to either side (None: all).
WIDER = [("group", 0), ("group", 1), ("group", 2), ("script", 0), ("script", 1), ("script", 2), ("corpus", 0), ("corpus", 1), ("corpus", 2), ("group", None), ("script", None), ("corpus", None)]
#: For each measure the order in which groups are asked (by their place in WIDER).
_BY_LANGUAGE = [0, 1, 2, 9, 3, 4, 5, 10, 6, 7, 8, 11]
NEAREST = {"chars_per_token": _BY_LANGUAGE, "byte_share": _BY_LANGUAGE, "token_entropy": list(range(12))}
#: Bands that are broadcast at most (some 100 bytes each).
MOST_BANDS = 20_000
VOCABULARY = "piece_bpe_32k.model"
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: First code points of scripts' blocks, and their names.
SCRIPT_AT = np.array([0x00, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x3040, 0x3100, 0xAC00, 0xD7B0])
SCRIPTS = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "indic", "other", "kana", "han", "hangul", "other"]
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Pieces of words, of which the latest are remembered."""

    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.model.IsByte(i) for i in range(self.model.GetPieceSize())])
        self.known: dict[int, np.ndarray] = {}

    def of(self, codes: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many pieces each word has, and all of them."""
        if len(self.known) > CACHED:
            self.known = {}
        keys = codes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            for i, ids in zip(new, self.model.encode([words[i].decode("utf-8", "replace") for i in new], num_threads=1), strict=True):
                self.known[keys[i]] = np.array(ids, np.int32)
        found = [self.known[k] for k in keys]
        return np.array([len(x) for x in found], np.int64), np.concatenate(found) if found else np.zeros(0, np.int32)


@functools.cache
def _pieces(vocabulary: str) -> Pieces:
    return Pieces(vocabulary)


def _first_of_group(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (of, h) together, and which in it begins a group."""
    key = tn.mix(h + of.astype(np.uint64) * tn.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    return order, np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]


def measures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: str):
    """For some texts at a time: the first, and a dict of columns."""
    pieces = _pieces(vocabulary)
    for a, b in tn.runs(np.maximum(ends - starts, 32), AT_ONCE):
        wide, buf, bounds = tn.code_points(*tn.joined(data, starts[a:b], ends[a:b]))
        n = b - a
        x, y, by_doc = tn.words(buf, bounds)
        sizes = np.diff(by_doc)
        of = np.repeat(np.arange(n), sizes)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        rolling = tn.Rolling(tn.BYTE_CODE[buf])
        codes = rolling.spans(x, y)
        out = {"n_words": sizes, "word_chars": np.bincount(of, chars[y] - chars[x], minlength=n).astype(np.int64)}
        out["n_symbols"] = np.diff(np.concatenate([[0], np.cumsum(SYMBOL[buf])])[bounds])
        # lines with a word that repeat an earlier one
        breaks = np.flatnonzero(buf == 0x0A)
        line_at = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
        line_doc = np.searchsorted(bounds, line_at, "right") - 1
        line_doc = np.minimum(line_doc, n - 1)
        line_end = np.minimum(np.concatenate([line_at[1:] - 1, bounds[-1:]]), bounds[1:][line_doc])
        nl = np.concatenate([buf, [0]])[np.minimum(line_end, len(buf))] != 0x0A
        line_end = np.where(nl, np.minimum(np.concatenate([line_at[1:], bounds[-1:]]), bounds[1:][line_doc]), line_end)
        line_end = np.maximum(line_end, line_at)
        has = np.searchsorted(x, line_end) > np.searchsorted(x, line_at)
        line_at, line_end, line_doc = line_at[has], line_end[has], line_doc[has]
        order, head = _first_of_group(line_doc, rolling.spans(line_at, line_end))
        out["n_dup_lines"] = np.bincount(line_doc[order[~head]], minlength=n)
        # words in windows of five that occur twice
        h = tn.Rolling(codes | tn.U64(1)).windows(5)
        own = tn.spread(by_doc[:-1], np.maximum(sizes - 4, 0))
        order, head = _first_of_group(of[own], h[own])
        group = np.cumsum(head) - 1
        twice = own[order[np.bincount(group)[group] > 1]] if len(own) else own
        change = np.bincount(twice, minlength=len(x) + 1) - np.bincount(np.minimum(twice + 5, len(x)), minlength=len(x) + 1)
        out["n_repeat_words"] = np.bincount(of[np.cumsum(change)[:-1] > 0], minlength=n)
        # pieces
        _, index, inverse = np.unique(codes, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        counts, flat = pieces.of(codes[index], [raw[x[i] : y[i]] for i in index])
        at = np.concatenate([[0], np.cumsum(counts)])
        tokens = flat[tn.spread(at[inverse], counts[inverse])]
        token_doc = np.repeat(of, counts[inverse])
        n_tokens = np.bincount(token_doc, minlength=n)
        key = np.sort(token_doc << 20 | tokens)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        c = np.diff(np.concatenate([new, [len(key)]]))
        least = np.maximum(n_tokens, 1)
        out["n_tokens"] = n_tokens
        out["chars_per_token"] = out["word_chars"] / least
        out["byte_share"] = np.bincount(token_doc, pieces.is_byte[tokens], minlength=n) / least
        out["token_entropy"] = np.maximum(np.log2(least) - np.bincount(key[new] >> 20, c * np.log2(c), minlength=n) / least, 0.0)
        # the script of most letters beyond ASCII, or latin
        wide_doc = np.searchsorted(chars[bounds], np.flatnonzero(wide >= 0x370), "right") - 1
        script = np.searchsorted(SCRIPT_AT, wide[wide >= 0x370], "right") - 1
        table = np.zeros((n, len(SCRIPTS)), np.int64)
        np.add.at(table, (np.minimum(wide_doc, n - 1), script), 1)
        most = table.argmax(axis=1)
        out["script"] = np.where(table.max(axis=1) * 2 > np.diff(chars[bounds]), most, 0)
        yield a, out


def measured(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with all its columns but text, then the counts and measures of each text."""
    bounded_batches(docs.sparkSession)
    vocabulary = vocabulary or path(VOCABULARY)
    names = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(0).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    texts = docs.select(row, F.col("text").cast("string").alias("text"))
    longs = (*BASE, "n_tokens")

    def apply(batches):
        for batch in batches:
            for a, out in measures(*tn.utf8(batch.column("text")), vocabulary):
                n = len(out["n_words"])
                cols = [pa.array(np.asarray(out[c], np.int64)) for c in longs] + [pa.array(np.asarray(out[c], np.float64)) for c in MEASURES]
                script = pa.array(np.array(SCRIPTS, object)[out["script"]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, n), *cols, script], ["row", *longs, *MEASURES, "script"])

    like = texts.select("row", *[F.lit(0).cast("long").alias(c) for c in longs], *[F.lit(0.0).alias(c) for c in MEASURES], F.lit("").alias("script"))
    return texts.mapInArrow(apply, like.schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *longs, *MEASURES, "script")


def _places(held: bool):
    """Of a cell: level, of and near of the groups that hold it, or (one a level) that it asks."""
    out = []
    for level, (of, reach) in enumerate(WIDER):
        key = F.lit("") if of == "corpus" else F.col(of)
        steps = range(-reach, reach + 1) if held and reach else [0]
        for step in steps:
            near = F.lit(-1) if reach is None else F.col("size") + step
            out.append(F.struct(F.lit(level).alias("level"), key.alias("of"), near.cast("int").alias("near")))
    return F.array(*out)


def judged(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, the counts and measures of each row of docs, base_failed, kept."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = cut(measured(docs.select("doc_id", "text", lang.alias("lang")), vocabulary), "fertility")
    group = F.coalesce(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("script:"), "script"))
    rows = rows.withColumn("group", group).withColumn("size", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"))
    cells = cut(rows.groupBy(*CELL).count().select(*CELL), "cells")
    # the quartiles of all groups come from one table of how often each rounded value occurs
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.round(c, 4).alias("value")) for c in MEASURES]))
    values = cut(rows.select(*CELL, value.alias("m")).select(*CELL, "m.*").groupBy(*CELL, "measure", "value").count(), "values")
    held = values.select(F.explode(_places(True)).alias("at"), "measure", "value", "count").select("at.*", "measure", "value", "count")
    quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("count"))
    bands = held.groupBy("level", "of", "near", "measure").agg(F.sum("count").alias("n"), quartiles.alias("q")).where(F.col("n") >= LEAST)
    asked = cells.select(*CELL, F.explode(_places(False)).alias("at")).select(*CELL, "at.*")
    turn = lambda c: F.array(*[F.lit(NEAREST[c].index(i)) for i in range(len(WIDER))])[F.col("level")].alias("turn")
    nearest = asked.join(bands, ["level", "of", "near"]).groupBy(*CELL).agg(*[F.min(F.when(F.col("measure") == c, F.struct(turn(c), "q"))).alias(f"{c}_q") for c in MEASURES])
    bands = cut(nearest, "bands")
    # most documents are of one language: with few bands the rows need not meet by language
    out, inside = rows.join(F.broadcast(bands) if bands.count() <= MOST_BANDS else bands, CELL, "left"), F.lit(True)
    for c in MEASURES:
        low, high = F.col(f"{c}_q.q")[0], F.col(f"{c}_q.q")[1]
        room = F.greatest(WIDE * (high - low), SLACK * high)
        within = F.col(c).between(low - room - 1e-9, high + room + F.lit(0.05 if c == "byte_share" else 1e-9))
        inside = inside & F.coalesce(within, F.lit(True))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "n_tokens", *MEASURES)


def query(docs: DataFrame) -> DataFrame:
    return judged(docs)

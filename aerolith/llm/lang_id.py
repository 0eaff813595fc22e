"""Language identification by rank-order profiles (operator 2).

A profile lists the most frequent character n-grams (1 to 3 letters, words padded with blanks) of a language's training
texts, most frequent first. A document's own most frequent n-grams are compared with each profile by the out-of-place
distance: how far each n-gram stands from its place in the profile, or the list's length where the profile lacks it.

Profiles count every training document: those with a language whose crc32(doc_id) is not divisible by 5. A text that is
null or has no letter is `und` with score 0. Otherwise the score is 1 less the distance's share of the largest possible;
of equal distances the language first in order wins. Rows that repeat a doc_id are judged each by its text; a null doc_id
is not held out. Without any training document all texts are `und`. Other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aerolith.llm import textnum as tn
from aerolith.llm.common import apart, back, bounded_batches

PLACES, AT_ONCE, MOST_LANGUAGES = 300, 1 << 19, 1000
#: Score under which a text is in none of the languages: letters at random and other languages score up to 0.27, prose from 0.4.
LEAST = 0.3
GRAM = (1 << 40) - 1


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else the code of its lower case, from 2 on."""
    out = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low[0]) + 2
    return out


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For some texts at a time: the first, how many, and for each different n-gram of each text the text, a 40-bit hash, the count."""
    for a, b in tn.runs(np.maximum(ends - starts, 32), AT_ONCE):
        buf, bounds = tn.joined(data, starts[a:b], ends[a:b])
        n = b - a
        points, buf, bounds = tn.code_points(buf, bounds)
        by_char = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[bounds]
        letters = _letters()[points]
        # one blank (1) before each word and one at each text's end, nothing else between
        is_letter = letters > 0
        head = is_letter.copy()
        head[1:] &= ~is_letter[:-1]
        at = by_char[:-1][by_char[1:] > by_char[:-1]]
        head[at] = is_letter[at]
        tail = is_letter.copy()
        tail[:-1] &= ~is_letter[1:]
        at = by_char[1:][by_char[1:] > by_char[:-1]] - 1
        tail[at] = is_letter[at]
        x, y = np.flatnonzero(head), np.flatnonzero(tail) + 1
        if not len(x):
            yield a, n, *(np.zeros(0, np.int64) for _ in range(3))
            continue
        size = y - x + 2
        word_at = np.concatenate([[0], np.cumsum(size)])
        s = np.ones(word_at[-1], np.int64)
        inner = tn.spread(word_at[:-1] + 1, y - x)
        s[inner] = letters[tn.spread(x, y - x)]
        doc = np.repeat(np.searchsorted(by_char, x, "right") - 1, size)
        end = np.zeros(len(s), bool)
        end[word_at[1:] - 1] = True
        found = []
        two = ~end[:-1]
        three = two[:-1] & ~end[1:-1]
        for key, of in ((s[inner], doc[inner]), ((s[:-1] | s[1:] << 21)[two], doc[:-1][two]), ((s[:-2] | s[1:-1] << 21 | s[2:] << 42)[three], doc[:-2][three])):
            found.append(of << 40 | (tn.mix(key.view(np.uint64)) >> tn.U64(24)).astype(np.int64))
        both = np.sort(np.concatenate(found))
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        yield a, n, both[new] >> 40, both[new] & GRAM, np.diff(np.concatenate([new, [len(both)]]))


def _ranked(doc: np.ndarray, gram: np.ndarray, count: np.ndarray, places: int):
    """Each text's most frequent n-grams with their places, from 0."""
    if len(count) and count.max() >> 19:  # too many for the packed key
        order = np.lexsort((gram & 0xFFFFFF, -count, doc))
    else:
        order = np.argsort(doc << 43 | ((1 << 19) - 1 - count) << 24 | gram & 0xFFFFFF)
    doc, gram = doc[order], gram[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.concatenate([first, [len(doc)]])))
    keep = place < places
    return doc[keep], gram[keep], place[keep]


def train(labelled: DataFrame, places: int = PLACES) -> dict[str, list[int]]:
    """A profile of each lang from the rows' text: hashes of n-grams, the most frequent first."""
    bounded_batches(labelled.sparkSession)

    def counted(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, index = langs.dictionary, langs.indices.to_numpy()
            for a, n, doc, gram, count in grams(*tn.utf8(batch.column("text"))):
                key = index[a : a + n].astype(np.int64)[doc] << 40 | gram
                order = np.argsort(key)
                key = key[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                total = np.add.reduceat(count[order], new) if len(key) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(key[new] >> 40)), pa.array(key[new] & GRAM), pa.array(total)], ["lang", "gram", "n"])

    counts = labelled.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(counted, "lang string, gram long, n long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("place", place).where(F.col("place") <= places)
    rows = top.select("lang", "gram", "place").limit(places * MOST_LANGUAGES + 1).collect()
    if len(rows) > places * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def predict(docs: DataFrame, profiles: dict[str, list[int]], places: int = PLACES) -> DataFrame:
    """docs with all its columns, then lang_pred and score."""
    bounded_batches(docs.sparkSession)
    langs = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p] or [0], np.int64))
    place_of = np.full((len(langs), len(known)), -1, np.int64)
    for i, name in enumerate(langs):
        place_of[i, np.searchsorted(known, profiles[name])] = np.arange(len(profiles[name]))
    names = docs.columns
    row = F.struct(F.lit(0).alias("any"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    texts = docs.select(row, F.col("text").cast("string").alias("text"))

    def judged(batches):
        for batch in batches:
            for a, n, doc, gram, count in grams(*tn.utf8(batch.column("text"))):
                doc, gram, place = _ranked(doc, gram, count, places)
                at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                hit = known[at] == gram
                size = np.bincount(doc, minlength=n)
                far = np.empty((max(len(langs), 1), n))
                far[:] = 1.0
                for i in range(len(langs)):
                    its = np.where(hit, place_of[i, at], -1)
                    far[i] = np.bincount(doc, np.where(its < 0, places, np.abs(its - place)), minlength=n) / np.maximum(size * places, 1)
                best = far.argmin(axis=0)
                sure = (size > 0) & bool(langs)
                pred = np.where(sure, np.array(langs or ["und"], object)[best], "und")
                score = np.where(sure, 1.0 - far[best, np.arange(n)], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, n), pa.array(pred, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    schema = texts.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return texts.mapInArrow(judged, schema).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], "lang_pred", "score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    profiles = train(docs.where(F.col("lang").isNotNull() & ~held_out()))
    ids = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(ids, profiles).select("doc_id", "held_out", "lang_pred", "score")


def stage(docs: DataFrame, wanted: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """The documents in a wanted language (None: any learned one), by prediction; lang becomes the predicted one.

    Rejected are texts without a letter, texts whose score is under `least` (they are in no language learned), and those in
    another language than the wanted. Without any training document, none is left.
    """
    names = docs.columns
    profiles = train(docs.where(F.col("lang").isNotNull() & ~held_out()))
    rows = predict(apart(docs), profiles).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    if wanted is not None:
        rows = rows.where(F.col("lang_pred").isin(list(wanted)))
    return back(rows.withColumn("lang", F.col("lang_pred").cast(docs.schema["lang"].dataType)), names)

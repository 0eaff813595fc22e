"""Each operator against a plain version on small tables, and on awkward ones."""

import gzip
import io
import random
import zlib

import numpy as np
import pytest

from aerolith.llm import ann, common, fertility, fm_dedup, lang_id, minhash, mixing, packing, queries, repeats, suffix_dedup, url_filter, warc
from aerolith.llm import textnum as tn
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, near copies, shared passages, periods, odd bytes, nulls and empties."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    texts = []
    for _ in range(60):
        w = words(rng, rng.choice([3, 20, 90, 300]))
        kind = rng.randrange(7)
        if kind == 0 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind == 1 and texts:
            w = (rng.choice(texts) or "").split() or w
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "changed"
        text = " ".join(w)
        if kind == 2:
            text = f"{text}\n{passage}\t{' '.join(words(rng, 30))}"
        if kind == 3:
            text = "éß " * rng.randrange(10, 200) + text
        if kind == 4:
            text = text.upper() + "\x00\x0b日本語 😀 " + text[:150]
        texts.append(text)
    return [*enumerate(texts), (1000, None), (1001, ""), (1002, " \n\t"), (1003, "x" * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows], DOCS)


def as_dict(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("sizes", [{}, {"hot": 2, "indexed": 20}])
def test_suffix_dedup(spark, rows, sizes):
    assert as_dict(suffix_dedup.query(frame(spark, rows), **sizes)) == brute.suffix_dedup(rows)


@pytest.mark.parametrize("operator", ["suffix_dedup", "fm_dedup"])
def test_single_contexts_of_hot_anchors(spark, rows, operator):
    module = {"suffix_dedup": suffix_dedup, "fm_dedup": fm_dedup}[operator]
    assert as_dict(module.query(frame(spark, rows), hot=1, indexed=1)) == getattr(brute, operator)(rows)


@pytest.mark.parametrize("sizes", [{}, {"hot": 2, "indexed": 20}])
def test_fm_dedup(spark, rows, sizes):
    assert as_dict(fm_dedup.query(frame(spark, rows), **sizes)) == brute.fm_dedup(rows)


def test_near_duplicates(spark, rows):
    assert as_dict(minhash.query(frame(spark, rows))) == brute.near_dups(rows)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(14)
    a, b, c, d, e = (" ".join(words(rng, 60, 5000)) for _ in range(5))
    near = a + " more"
    texts = [(1, a), (1, a), (None, near), (None, a), (None, b), (None, b), (2, c), (2, d), (3, d), (4, ""), (4, ""), (None, ""), (None, None), (5, e), (None, e)]
    out = minhash.stage(frame(spark, texts)).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, a), (None, b), (2, c), (2, d), (4, ""), (None, ""), (None, None), (5, e)], key=str)


def test_near_copies_of_one_text(spark):
    rng = random.Random(2)
    base = words(rng, 120, 5000)
    rows = []
    for d in range(80):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((d, " ".join(w)))
    assert as_dict(minhash.query(frame(spark, rows))) == brute.near_dups(rows)


def test_blocks_of_a_band(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(4)
    base = words(rng, 100, 5000)
    near = [(2000 + d, " ".join(base[:at] + [f"x{d}"] + base[at + 1 :])) for d, at in enumerate(rng.randrange(100) for _ in range(25))]
    assert as_dict(minhash.query(frame(spark, rows + near))) == brute.near_dups(rows + near)


@pytest.mark.parametrize("sizes", [{}, {"indexed": 20}])
def test_maximal_repeats(spark, rows, sizes):
    texts = {t: d for d, t in reversed(rows) if t and "éß" not in t and t != "x" * 5000}
    texts = [(d, t) for t, d in texts.items()]
    texts += [(3000, "begin " + texts[0][1] + " " + texts[1][1][:180]), (3001, texts[1][1][20:150] + " end")]
    groups = {}
    for r in suffix_dedup.repeats(frame(spark, texts), **sizes).collect():
        groups.setdefault((r.group_doc, r.group_start, r.n_bytes), []).append((r.doc_id, r.start))
    found = {(n, tuple(sorted(at))) for (doc, start, n), at in groups.items() if min(at) == (doc, start)}
    assert len(found) == len(groups) and found == brute.maximal_repeats(texts)


def test_interval_tree():
    first, last, depth, parent = suffix_dedup.interval_tree(np.array([0, 3, 5, 5, 2, 0, 4]), 2)
    assert sorted(zip(first, last, depth, parent, strict=True)) == [(0, 3, 3, 2), (0, 4, 2, 0), (1, 3, 5, 3), (5, 6, 4, 0)]


def test_whole_characters_stay(spark):
    text = "é" * 120
    out = suffix_dedup.stage(frame(spark, [(1, text + "a"), (2, text + "b"), (3, text + "a")])).collect()
    assert {r.doc_id for r in out} == {1, 2}
    assert all(r.text.encode().decode() == r.text and r.n_chars == len(r.text) for r in out)


def test_fm_index_counts_and_statistics():
    rng = np.random.default_rng(0)
    text = np.concatenate([rng.integers(1, 5, 300), [0]])
    index = fm_dedup.FMIndex(text, 6, 8)
    plain = text.tolist()
    stream = np.concatenate([text[40:70], [5], rng.integers(1, 5, 60)])
    rows = np.full((1, len(stream) + 1), -1)
    rows[0, :-1] = stream
    got = {int(a[0]) for _, a, _ in fm_dedup.matching_statistics(index, rows, np.array([len(stream)]), 6) if len(a)}
    grams = {tuple(plain[i : i + 6]) for i in range(len(plain) - 5)}
    assert got == {i for i in range(len(stream) - 5) if tuple(stream[i : i + 6].tolist()) in grams}
    tree = fm_dedup.WaveletTree(text, 6)
    at = rng.integers(0, len(text) + 1, 50)
    for s in range(6):
        assert tree.rank(np.full(50, s), at).tolist() == [plain[:i].count(s) for i in at]


def test_winnow_takes_the_last_least():
    h = np.array([5, 3, 9, 3, 7, 8, 9], np.uint64) << np.uint64(40)
    at, first, last = tn.winnow(h, 3, np.arange(5))
    assert list(zip(at.tolist(), first.tolist(), last.tolist(), strict=True)) == [(1, 0, 0), (3, 1, 3), (4, 4, 4)]


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    common, a, b = (tn.mix(rng.integers(0, 2**62, n).astype(np.uint64)) for n in (300, 100, 100))
    both = np.concatenate([common, a, common, b])
    x, y = minhash.sketches(np.array([0, 400, 800]), both, 1024)
    assert abs((x == y).mean() - 300 / 500) < 0.06
    one = minhash.sketches(np.array([0, 1]), both[:1])
    assert (one != tn.NONE).all()


def test_language(spark):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "th", "wh", "er"], "fr": ["eau", "ç", "oui", "é", "elle"], "de": ["sch", "ung", "ß", "ei", "der"]}
    rows = []
    for d in range(150):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(30))
        rows.append((d, text, lang, "s", 0))
    rows += [(200, None, "en", "s", 0), (201, "12 34 !!", "en", "s", 0), (202, "The THING", None, None, None)]
    out = {r.doc_id: r for r in lang_id.query(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(out[d].lang_pred == lang for d, _, lang, _, _ in rows[:150])
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 for d, r in out.items())
    assert [out[d].lang_pred for d in (200, 201)] == ["und", "und"] and out[202].lang_pred == "en"
    kept = {r.doc_id for r in lang_id.stage(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == set(out) - {200, 201}


def test_language_against_plain_profiles(spark, rows):
    rng = random.Random(15)
    syllables = {"aa": ["the", "ing", "er", "wh", "Ou"], "bb": ["eau", "ç", "oui", "é", "er"], "cc": ["sch", "ung", "ß", "ei", "der"]}
    prose = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 5))) for _ in range(n))
    texts = [(5000 + i, prose(lang, rng.randrange(1, 200)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    texts += [(d, t, None) for d, t in rows] + [(7000, "Ünï1cöde_word 12 ... ΑΒΓ", None)]
    train = [(t, lang) for d, t, lang in texts if lang and zlib.crc32(str(d).encode()) % 5]
    want = dict(zip([d for d, *_ in texts], brute.language(train, [t for _, t, _ in texts]), strict=True))
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.query(spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in texts], DOCS)).collect()}
    assert out.keys() == want.keys() and len({p for p, _ in want.values()}) == 4
    for d, (pred, score) in want.items():
        assert out[d][0] == pred and abs(out[d][1] - score) < 1e-9, d


def test_language_stage_goes_by_prediction(spark):
    rng = random.Random(16)
    parts = {"en": ["the", "ing", "th", "wh", "er"], "fr": ["eau", "ç", "oui", "é", "elle"]}
    text = lambda lang, n=40: " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(d, text(lang), lang, "s", 0) for d, lang in enumerate(["en", "fr"] * 40)]
    rows += [(100, text("en"), "fr", "s", 0), (101, "".join(rng.choices("bdjkmpqvxz  ", k=300)), None, "s", 0), (102, "Все люди рождаются свободными", None, "s", 0), (103, text("fr"), None, "s", 0)]
    out = {r.doc_id: r.lang for r in lang_id.stage(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(out) == {*range(80), 100, 103} and out[100] == "en" and out[103] == "fr"
    only = {r.doc_id for r in lang_id.stage(spark.createDataFrame(rows, DOCS), ["fr"]).collect()}
    assert only == {d for d, lang in out.items() if lang == "fr"}


def test_frequent_grams_rank_by_count():
    doc, gram, place = lang_id._ranked(np.array([0, 0, 0, 1]), np.array([1, 2, 3, 1]), np.array([2**19, 2**20, 2**21, 5]), 2)
    assert list(zip(doc.tolist(), gram.tolist(), place.tolist(), strict=True)) == [(0, 3, 0), (0, 2, 1), (1, 1, 0)]


def base_rules(text):
    w = brute.WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if brute.WORD.search(line):
            again += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered), failed


def test_quality_base(spark, rows):
    extra = [(2000, "a b\na b\n\nc #*\n \n \na b"), (2001, "\n"), (2002, "<p>&amp;</p>\n" * 4)]
    out = {r.doc_id: r for r in fertility.query(frame(spark, [*rows, *extra])).collect()}
    for d, text in [*rows, *extra]:
        r = out[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_rules(text), d
        assert not (r.base_failed and r.kept)


def test_quality_rejects_what_the_vocabulary_does_not_fit(spark):
    rng = random.Random(4)
    vocabulary = ["water", "house", "people", "garden", "river", "letter", "morning", "window", "summer", "paper", "music", "yellow"]
    rows = [(d, " ".join(rng.choices(vocabulary, k=200))) for d in range(120)]
    noise = "".join(chr(rng.randrange(0x1F300, 0x1F600)) for _ in range(300))
    out = as_dict(fertility.query(frame(spark, [*rows, (999, " ".join(noise[i : i + 8] for i in range(0, 300, 8)))])).select("doc_id", "base_failed", "kept", "byte_share"))
    assert out[999][:2] == (False, False) or out[999][1] is False
    assert all(out[d][1] or out[d][0] for d in range(120))
    assert out[999][2] > 0.5


def prose(rng, n):
    return ["".join(rng.choices(["the", "ing", "er", "on", "st", "an", "re", "ly"], k=rng.randrange(1, 4))) for _ in range(n)]


def test_quality_rejects_symbol_junk(spark):
    rng = random.Random(12)
    rows = [(d, " ".join(prose(rng, rng.randrange(200, 400))), "en", "s", 0) for d in range(200)]
    junk = [(1000 + d, " ".join(w + rng.choice("#*$&|<>%") for w in prose(rng, 150)), "en", "s", 0) for d in range(3)]
    out = as_dict(fertility.query(spark.createDataFrame(rows + junk, DOCS)).select("doc_id", "base_failed", "kept"))
    assert all(out[d] == (False, False) for d in (1000, 1001, 1002))
    assert sum(kept for d, (_, kept) in out.items() if d < 200) >= 196


def test_quality_rejects_what_is_no_text_in_any_language(spark):
    """Encoded, wrongly decoded, enciphered and random text, one of each beside 80 documents of its language."""
    import base64

    rng = random.Random(20)
    syllables = {"en": ["the", "ing", "er", "on", "st", "an"], "fr": ["eau", "ç", "oui", "é", "elle", "ai"], "de": ["sch", "ung", "ß", "ei", "der", "ä"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(n))
    rows = [(d, text(lang, rng.randrange(200, 400)), lang, "s", 0) for d, lang in enumerate(["en", "fr", "de"] * 80)]
    junk = []
    for lang in syllables:
        t = text(lang, 300)
        coded = base64.b64encode(t.encode()).decode()
        junk += [" ".join(coded[i : i + 60] for i in range(0, len(coded), 60)), " ".join(t.encode().hex()[i : i + 30] for i in range(0, 3000, 30)), "".join(chr((ord(c) - 97 + 13) % 26 + 97) if "a" <= c <= "z" else c for c in t)]
        junk += [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ0123456789", k=rng.randrange(3, 12))) for _ in range(300))]
        junk += [t.encode().decode("latin-1")] if lang != "en" else []
        rows += [(1000 + len(rows) + i, x, lang, "s", 0) for i, x in enumerate(junk)]
        junk = []
    out = as_dict(fertility.query(spark.createDataFrame(rows, DOCS)).select("doc_id", "base_failed", "kept"))
    assert not [d for d, (_, kept) in out.items() if d >= 1000 and kept]
    assert sum(kept for d, (_, kept) in out.items() if d < 1000) >= 232


def plain_verdicts(rows):
    """kept of rows (doc_id, n_tokens, group, script, measures ..., base_failed) by bands taken from lists of all values."""
    level = lambda r: max(r["n_tokens"], 1).bit_length() - 1
    out = {}
    for r in rows:
        ok = not r["base_failed"]
        for c in fertility.MEASURES:
            for i in fertility.NEAREST[c]:
                of, reach = fertility.WIDER[i]
                near = [x[c] for x in rows if (of == "corpus" or x[of] == r[of]) and (reach is None or abs(level(x) - level(r)) <= reach)]
                if len(near) >= fertility.LEAST:
                    low, high = np.percentile(np.round(near, 4), [25, 75])
                    room = max(fertility.WIDE * (high - low), fertility.SLACK * high)
                    ok = ok and low - room - 1e-9 <= r[c] <= high + room + (0.05 if c == "byte_share" else 1e-9)
                    break
        out[r["doc_id"]] = ok
    return out


def test_quality_verdicts_against_plain_bands(spark):
    rng = random.Random(21)
    rows = [(d, " ".join(prose(rng, int(2 ** rng.uniform(3, 10)))) + rng.choice(["", "", "", " #*$" * rng.randrange(40), " 日本" * rng.randrange(30)]), rng.choice(["en", "en", "xx", None]), "s", 0) for d in range(260)]
    docs = spark.createDataFrame(rows, DOCS)
    seen = [r.asDict() for r in fertility.measured(docs.select("doc_id", "text", "lang")).collect()]
    for r in seen:
        w, _, _, _, _, failed = base_rules(rows[r["doc_id"]][1])
        r |= {"base_failed": failed, "group": f"lang:{r['lang']}" if r["lang"] else f"script:{r['script']}"}
        assert r["n_words"] == w
    want = plain_verdicts(seen)
    assert {r.doc_id: r.kept for r in fertility.query(docs).collect()} == want and len(set(want.values())) == 2


def test_quality_judges_small_groups(spark):
    rng = random.Random(13)
    rows = [(d, " ".join(prose(rng, rng.randrange(200, 400))), "en", "s", 0) for d in range(120)]
    rows += [(500 + d, " ".join(prose(rng, 250)), "xx", "s", 0) for d in range(3)]
    noise = ["".join(chr(rng.randrange(0x1F300, 0x1F600)) for _ in range(8)) for _ in range(40)]
    odd = [(1000, " ".join(noise), "xx", "s", 0), (1001, " ".join(f"{w}#*{i}$%" for i, w in enumerate(prose(rng, 4000))), "en", "s", 0)]
    out = as_dict(fertility.query(spark.createDataFrame(rows + odd, DOCS)).select("doc_id", "base_failed", "kept"))
    assert out[1000] == out[1001] == (False, False)
    assert all(out[500 + d] == (False, True) for d in range(3))


def test_nearest(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 12))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, v[50].tolist()) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [0.0] * 12), (2100, [float("nan")] * 12), (2150, [None] * 12), (2200, [float("inf")] + [1.0] * 11)]
    out = ann.query(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    ids = np.array([i for i, x in rows if i < 2000])
    u = np.array([x for i, x in rows if i < 2000], np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:5]
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        hits += len({int(ids[i]) for i in order} & {r.vec_id for r in mine})
        total += 5
        if q == 50:
            assert [r.vec_id for r in mine] == [1000, 1001, 1002, 1003, 1004]
    assert hits / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.query(few).collect()] == [(0, 1, 7)]


def test_large_leaves_get_subtrees(spark, monkeypatch):
    """Leaves of over PART vectors, so that most bins are a subtree's: the same answers as by brute force, in at least 0.9 of places."""
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(ann, "SAMPLE", 300)
    monkeypatch.setattr(ann, "SUB_SAMPLE", 200)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 10))
    v = np.concatenate([centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 10)), rng.normal(size=(500, 10))]).astype(np.float32)
    out = ann.query(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    asked = range(0, len(v), 50)
    for q in asked:
        s = u @ u[q]
        s[q] = -2
        mine = {r.vec_id: r.score for r in out if r.query_id == q}
        assert len(mine) == 5 and all(abs(x - s[i]) < 1e-9 for i, x in mine.items())
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(mine))
    assert hits / (5 * len(asked)) >= 0.9


def test_mix(spark):
    rng = random.Random(7)
    rows = [(d, " ".join(words(rng, rng.randrange(0, 60))), "en", rng.choice(["a", "a", "a", "B", "é", None]), 0) for d in range(200)]
    rows += [(500, None, None, "zero", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.query(docs).collect()
    assert len(out) == len(rows)
    size = {d: len(brute.WORD.findall(t or "")) for d, t, *_ in rows}
    totals = {}
    for d, _, _, s, _ in rows:
        totals[s] = totals.get(s, 0) + size[d]
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    goal, open_ = {}, {s: i % 3 + 1 for i, s in enumerate(names)}
    rest = sum(totals.values())
    while True:
        over = [s for s, w in open_.items() if rest * w / sum(open_.values()) >= 3 * totals[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3 * totals[s]
        rest = sum(totals.values()) - sum(goal.values())
        open_ = {s: w for s, w in open_.items() if s not in over}
    goal |= {s: rest * w / sum(open_.values()) for s, w in open_.items()}
    source = {d: s for d, _, _, s, _ in rows}
    taken = dict.fromkeys(totals, 0)
    for r in out:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in totals)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.query(docs.repartition(7)).collect()), key=str)
    mixed = mixing.mix(docs).collect()
    assert [r["__position"] for r in mixed] == sorted(r["__position"] for r in mixed) and all(0 <= r["__position"] <= 1 for r in mixed)
    staged = mixing.stage(docs).collect()
    assert sum(len(brute.WORD.findall(r.text)) for r in staged) == sum(taken.values())


def test_schedules():
    u = [i / 50 for i in range(51)]
    for rates in ((1.5, 0.5), (1.0, 1.0), (0.0, 2.0, 1.0, 0.0), (3.0, 0.0, 0.0, 1.0)):
        parts = mixing.integrated(rates)
        n = len(parts)

        def due(t, parts=parts, n=n):  # the demand up to t
            i = min(int(t * n), n - 1)
            before, rate, slope = parts[i]
            w = t * n - i
            return before + rate * w + slope * w * w / 2

        assert abs(due(1.0) - 1) < 1e-12 and all(due(a) <= due(b) + 1e-12 for a, b in zip(u, u[1:], strict=False))
    with pytest.raises(ValueError, match="schedule"):
        mixing.integrated((0.0, 0.0))


def test_positions_follow_the_schedule(spark):
    rng = random.Random(18)
    docs = spark.createDataFrame([(d, " ".join(words(rng, 20)), "en", "ab"[d % 2], 0) for d in range(400)], DOCS)
    late = {"a": (0.0, 0.0, 1.0), "b": (1.0, 0.0)}
    out = mixing.mix(docs, late).collect()
    assert [r["__position"] for r in out] == sorted(r["__position"] for r in out)
    a, b = ([r["__position"] for r in out if r.source == s] for s in "ab")
    assert min(a) >= 0.5 and abs(sum(b) / len(b) - 1 / 3) < 0.03 and abs(sum(a) / len(a) - 5 / 6) < 0.03
    at = [r.first_position for r in mixing.query(docs, late).collect()]
    assert at == sorted(at, key=lambda p: (p is None, p)) and {p is None for p in at} == {True, False}


def test_packing(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    extra = [(3000, " ".join(words(random.Random(1), 9000)))]
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.packed(frame(spark, [*rows, *extra]), with_ids=True).collect()
    for d, text in [*rows, *extra]:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in out if r.doc_id == d), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own), d
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in own)
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_added_tokens_are_as_in_the_whole_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"{a}{token}{b}" for token in ("<|startoftext|>", "<|endoftext|>") for a in ("", "hello ", "hello", "<|") for b in ("", " end", "end", "|>", token)]
    texts += ["<|endoftext|>" * 3, "<|ENDOFTEXT|>", "<|end oftext|>", "hello world <|endoftext|> end"]
    out = {r.doc_id: r.ids for r in packing.packed(frame(spark, list(enumerate(texts))), with_ids=True).collect()}
    assert all(out[d] == [*model.encode(t, add_special_tokens=False).ids, 2] for d, t in enumerate(texts))
    assert out[len(texts) - 1] == [3306, 1002, 49407, 806, 2]


def test_packing_keeps_training_order(spark, tmp_path):
    rng = random.Random(17)
    order = rng.sample(range(300), 300)
    docs = frame(spark, [(d, " ".join(words(rng, rng.randrange(40, 900)))) for d in order]).coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (spark.read.parquet(str(tmp_path / "docs")), docs):
        out = packing.stage(table, stretch=60).collect()
        place = {d: i for i, d in enumerate(order)}
        assert all(r.sequence_id >> 40 == place[r.doc_id] // 60 for r in out)
        assert [r.doc_id for r in sorted(out, key=lambda r: (r.position, r.start)) if r.start == 0] == order
        assert {r.doc_id for r in out} == set(order)


def test_best_fit():
    rng = random.Random(8)
    open_, plain = packing.OpenSequences(64), []
    for n in range(500):
        need = rng.randrange(1, 64)
        found = open_.take(need)
        best = min((room for room in plain if room >= need), default=None)
        assert (found and found[1]) == best
        if best is not None:
            plain.remove(best)
        room = (best or 64) - need
        if room:
            open_.put(room, n)
            plain.append(room)


def test_warc(spark, tmp_path):
    rng = random.Random(9)
    body = [None, "", "same", "same", "日本", *("".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(4000))) for _ in range(40))]
    rows = [(i, f"http://h/{i}\r\nx" if i % 2 else None, b) for i, b in enumerate(body)] + [(99, "u", "same"), (2, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {}
    for r in warc.query(pages).collect():
        out.setdefault(r.page_id, r)
    for i, b in enumerate(body):
        data = (b or "").encode()
        r = out[i]
        first = min(j for j, x in enumerate(body) if (x or "") == (b or ""))
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), warc.digest(data), "response" if first == i else "revisit", None if first == i else first)
    path = str(tmp_path / "a")
    warc.write(warc.plan(pages), path)
    whole = warc.read(spark, path).count()
    assert whole == len(rows) == warc.read(spark, path, size=777).count()
    for file in (tmp_path / "a").glob("part-*"):
        assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") >= 0


def test_scan_finds_members_in_any_range():
    content = [b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + bytes([0x1F, 0x8B, 8]) * 50 + bytes([i]) for i in range(30)]
    raw = b"junk\x1f\x8b\x08" + b"".join(gzip.compress(c, 0) for c in content)
    for size in (17, 100, 5000):
        found = [c for a in range(0, len(raw), size) for c in warc.scan(io.BytesIO(raw), a, min(a + size, len(raw)))]
        assert found == content


def test_url_filter(spark):
    urls = {
        1: "HTTP://A.Example.COM/en/x?y#z", 2: "https://www.example.com/en/1", 3: "https://x.www.example.com/en/", 4: "http://b.net/es/1", 5: "http://b.net/de/", 6: "http://bnet/es/",
        7: "no scheme", 8: None, 9: "http://example.com", 10: "http://u@h.org:80/p", 11: "http://b.net/fr", 12: "x://net/fr/?q",
    }
    pages = spark.createDataFrame([*urls.items(), *((100 + i, f"http://bad.org/{i}") for i in range(60))], "page_id long, url string")
    outcomes = spark.createDataFrame([(100 + i, True) for i in range(60)], "page_id long, bad boolean")
    out = {r.page_id: tuple(r)[1:] for r in url_filter.judged(pages, outcomes, url_filter.rule_table(pages)).collect()}
    assert out[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert out[2][2:] == ("www.example.com/en/", "allow") and out[3][2:] == ("www.example.com/en/", "allow")
    assert out[4][2:] == ("net/es/", "block") and out[5][2] is None and out[6][2] is None
    assert out[7][:3] == ("", "", None) == out[8][:3] and out[9][:3] == ("example.com", "", None)
    assert out[10][:2] == ("u@h.org:80", "/p") and out[11][2] is None and out[12][2] == "net/fr/"
    assert out[100][3] == "block"


CLASH = ["h", "row", "v", "th", "key", "cls", "size", "group", "target", "weight", "bucket", "spans", "copy", "owner", "score", "block", "c0", "open", "rest", "total"]
ON_DOCS = {
    "lang_id": lang_id.stage, "lang_id query": lang_id.query, "fertility": fertility.query, "mixing": mixing.query, "mixing stage": mixing.stage, "suffix": suffix_dedup.query, "suffix stage": suffix_dedup.stage,
    "fm": fm_dedup.query, "fm all": fm_dedup.dedup, "minhash": minhash.query, "minhash stage": minhash.stage, "packing": packing.query,
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_awkward_tables(spark, name):
    schema = DOCS + "".join(f", {c} string" for c in CLASH)
    f = ON_DOCS[name]
    assert f(spark.createDataFrame([], schema)).collect() == []
    more = ["?"] * len(CLASH)
    text = "some words that are long enough to be told apart " * 30
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, text, None, None, None), (None, None, None, None, None), (2, "", "en", "", 0), (2, "other " + text, "fr", "a", 1), (3, "é", "fr", "b", 1)]
    out = f(spark.createDataFrame([(*r, *more) for r in rows], schema)).collect()
    if "stage" in name:
        assert all(len(r) == 5 + len(CLASH) for r in out)
    elif name not in ("lang_id", "packing"):
        assert len(out) == len(rows)


def test_awkward_values(spark):
    """The same rows (repeated, without an id, null, empty) against what the operators' docstrings say."""
    text = "some words that are long enough to be told apart " * 30
    rows = [(1, text), (1, text), (None, text), (None, None), (2, ""), (2, "other " + text), (3, "é")]
    docs = frame(spark, rows)
    last = 2**63 - 1
    got = lambda df, *cols: sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    plain = brute.suffix_dedup([(1, text), (2, "other " + text), (3, "é"), (last, text)])
    want = [(d, *plain[last if d is None else d][:3]) if t else (d, 0, 0, 0) for d, t in rows]
    assert got(suffix_dedup.query(docs), "doc_id", "n_bytes", "n_removed", "n_spans") == sorted(want, key=str)
    want = [(1, 300, 0), (1, 300, 0), (None, 300, 300), (None, 0, 0), (2, 0, 0), (2, 301, 300), (3, 1, 0)]
    assert got(fm_dedup.query(docs), "doc_id", "n_words", "n_removed") == sorted(want, key=str)
    want = [(1, 10, 1, True), (1, 10, 1, True), (None, 10, 1, False), (None, 0, None, True), (2, 0, 2, True), (2, 11, 1, False), (3, 1, 3, True)]
    assert got(minhash.query(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)
    assert got(fertility.query(docs), "doc_id", "n_words", "base_failed", "kept") == sorted([(d, len((t or "").split()), True, False) for d, t in rows], key=str)
    assert got(lang_id.query(docs), "doc_id", "lang_pred") == sorted([(d, "en" if t else "und") for d, t in rows], key=str)
    sizes = got(mixing.query(docs), "doc_id", "size")
    assert sizes == sorted([(d, len((t or "").split())) for d, t in rows], key=str)
    tokens = packing.query(docs).collect()
    assert len(tokens) == 7 and sum(r.length for r in tokens) == sum(r.doc_tokens for r in tokens) and min(r.doc_tokens for r in tokens) == 1


def test_mix_agrees_on_reruns_without_ids(spark):
    rng = random.Random(22)
    rows = [(None, " ".join(words(rng, 10)), "en", "ab"[i % 2] if i % 5 else "c", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    runs = [sorted((r.text, r.source) for r in mixing.stage(x).collect()) for x in (docs, docs.repartition(5), docs.orderBy("text"))]
    assert runs[0] == runs[1] == runs[2]


def test_awkward_pages_and_vectors(spark):
    pages = "page_id long, url string, html string, key string, first string, host string"
    assert warc.query(spark.createDataFrame([], pages)).collect() == []
    rows = [(None, None, None, "?", "?", "?"), (1, None, None, "?", "?", "?"), (1, "u", "", "?", "?", "?")]
    assert sorted(r.record_type for r in warc.query(spark.createDataFrame(rows, pages)).collect()) == ["response", "response", "revisit"]
    none = spark.createDataFrame([], "page_id long, bad boolean")
    for data in ([], rows):
        table = spark.createDataFrame(data, pages)
        assert url_filter.judged(table, none, url_filter.rule_table(table)).count() == len(data)
    # a page that several rows and labels have: each row is judged, each label counts
    outcomes = spark.createDataFrame([(1, True), (1, True), (1, None), (None, True)], "page_id long, bad boolean")
    twice = spark.createDataFrame([(1, "http://h.a/x", None, "?", "?", "?")] * 2 + [(None, "http://h.a/y", None, "?", "?", "?")], pages)
    assert [tuple(r)[:3] for r in url_filter.judged(twice, outcomes, url_filter.rule_table(twice)).orderBy("path").collect()] == [(1, "h.a", "/x"), (1, "h.a", "/x"), (None, "h.a", "/y")]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.query(empty).collect() == []
    clash = "vec_id long, embedding array<float>, key string, leaf string, bin string, ids string, asks string, rank string, score string"
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], *["?"] * 7) for i in range(0, 200, 10)]
    wide, bare = spark.createDataFrame(rows, clash), spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ann.query(wide).collect())) == sorted(map(tuple, ann.query(bare).collect())) and ann.query(wide).count() == 20


def test_tables_go_with_their_session(spark, rows):
    import os

    shared = common.shared_dir(spark)
    before = set(os.listdir(shared))
    made = common.settled(spark, lambda: minhash.stage(frame(spark, rows[:30])), "kept")
    assert set(os.listdir(shared)) - before == {made.cut_path.rsplit("/", 1)[-1]}
    common.drop(made)
    assert set(os.listdir(shared)) <= before
    warc.query(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")).count()
    assert not [x for x in set(os.listdir(shared)) - before if x.startswith("warc")]


def test_tables_go_with_their_results(spark, rows):
    import gc
    import os
    import time

    shared = common.shared_dir(spark)
    kept = minhash.query(frame(spark, rows[:20])).where("kept")
    gone = {r for r in os.listdir(shared)}
    count = kept.count()
    suffix_dedup.query(frame(spark, rows[:20])).count()
    for _ in range(20):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        common.swept(spark)
        if not [x for x in set(os.listdir(shared)) - gone if x.startswith(("found", "owned"))]:
            break
    else:
        raise AssertionError("tables of a result that is gone are still there")
    assert kept.count() == count  # a result that is held keeps its tables


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Other:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Other(), {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_long_texts_are_handled_whole(spark):
    """Texts over the stretch that is handled at a time."""
    rng = random.Random(19)
    long = words(rng, 260_000, 3000)
    passage = " ".join(words(rng, 70, 100_000))
    rows = [(1, " ".join(long)), (2, "start " + " ".join(long[200_000:200_200]) + " " + passage), (3, passage + " " + " ".join(long)), (4, " ".join(long) + " more")]
    assert all(len(t) > 1 << 20 for d, t in rows if d != 2)
    docs = frame(spark, rows)
    assert as_dict(fm_dedup.query(docs)) == brute.fm_dedup(rows)
    assert as_dict(minhash.query(docs)) == brute.near_dups(rows)
    out = {r.doc_id: r for r in fertility.query(docs).collect()}
    w = brute.WORD.findall(rows[3][1])
    assert (out[4].n_words, out[4].word_chars) == (len(w), sum(map(len, w)))
    sizes = {r.doc_id: r.size for r in mixing.query(docs).collect()}
    assert sizes == {d: len(t.split()) for d, t in rows}
    assert {r.lang_pred for r in lang_id.query(docs).collect()} == {"en"}


@pytest.mark.parametrize("name", ["op1_warc", "op5_curriculum_mix", "op10_url_filter"])
def test_sql_gives_the_same_rows(spark, name):
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{sf}/{t}')")
    got = queries.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


def test_domains(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk", "co.uk", "b.com", "10.0.0.1", "10.0.0.1:80", "[::1]", "u@x.y.com.au:8080", "com", "", "a.b.c.org.")], "host string")
    out = {r.host: (r.domain, r.suffix) for r in url_filter.levels(hosts).collect()}
    assert out["a.b.co.uk"] == ("b.co.uk", "co.uk") and out["co.uk"] == ("co.uk", "co.uk") and out["b.com"] == ("b.com", "com")
    assert out["10.0.0.1"] == out["10.0.0.1:80"] == ("10.0.0.1", "") and out["[::1]"][1] == ""
    assert out["u@x.y.com.au:8080"] == ("y.com.au", "com.au") and out["com"] == ("com", "com") and out["a.b.c.org."] == ("c.org", "org")


def test_many_texts_of_one_id(spark):
    """Texts of one id (a null one) are numbered in their hash's order, whatever stretch of it they are in."""
    rows = [(None, f"text {i % 300}") for i in range(600)] + [(7, "text 1"), (7, "b"), (8, "c"), (9, "c")]
    found = repeats.with_owner(frame(spark, rows)).collect()
    none = sorted((bytes(r.th), r.v) for r in found if r.doc_id > 9)
    assert [v for _, v in none] == list(range(300))
    assert sorted(r.v for r in found if r.doc_id == 7) == [0, 1]
    assert {(r.doc_id, r.v, r.owner) for r in found if r.doc_id in (8, 9)} == {(8, 0, 8), (9, 0, 8)}
    assert sum(r.owner == 7 for r in found if r.doc_id > 9) == 1

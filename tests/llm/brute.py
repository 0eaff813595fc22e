"""Plain versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\x01" * length
            else:
                seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, _sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def fm_dedup(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    """doc_id -> n_words, n_removed, kept_sha256."""
    first: dict[tuple, int] = {}
    texts = [(doc, WORD.findall(text or "")) for doc, text in sorted(rows)]
    for doc, words in texts:
        for i in range(len(words) - length + 1):
            first.setdefault(tuple(words[i : i + length]), doc)
    out = {}
    for doc, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if first[tuple(words[i : i + length])] < doc:
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[doc] = (len(words), sum(gone), _sha(" ".join(kept).encode()))
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = WORD.findall(lowered)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_dups(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> n_shingles, component_id, kept; compares all documents that share a shingle."""
    sets = {doc: shingles(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders: dict[tuple, list[int]] = {}
    for doc, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(doc)
    tried = set()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                if (b, a) not in tried:
                    tried.add((b, a))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {doc: (len(s), find(doc), find(doc) == doc) for doc, s in sets.items()}


def maximal_repeats(rows: list[tuple[int, str | None]], length: int = 100) -> set[tuple]:
    """(n_bytes, all occurrences): strings of `length` bytes or more that occur again and are longest for their occurrences."""
    windows: dict[bytes, list] = {}
    texts = {doc: (text or "").encode() for doc, text in rows}
    for doc, data in sorted(texts.items()):
        for i in range(len(data) - length + 1):
            windows.setdefault(data[i : i + length], []).append((doc, i))
    out = set()
    for places in windows.values():
        if len(places) < 2:
            continue
        n, at = length, list(places)
        while at[0][1] > 0 and len({texts[d][i - 1 : i] if i else None for d, i in at}) == 1 and len(windows[texts[at[0][0]][at[0][1] - 1 : at[0][1] - 1 + length]]) == len(at):
            at, n = [(d, i - 1) for d, i in at], n + 1
        while len({texts[d][i + n : i + n + 1] for d, i in at}) == 1 and at[0][1] + n < len(texts[at[0][0]]) and len(windows[texts[at[0][0]][at[0][1] + n + 1 - length : at[0][1] + n + 1]]) == len(at):
            n += 1
        out.add((n, tuple(at)))
    return out


def _scrambled(x: int) -> int:
    """The 40 bits that stand for an n-gram, by which equally frequent ones are ordered."""
    m = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return (x ^ x >> 31) >> 24


def language(train: list[tuple[str, str]], texts: list[str | None], places: int = 300) -> list[tuple[str, float]]:
    """Language and score of each text by profiles of (text, lang)."""

    def counts(text):
        out: dict[int, int] = {}
        for word in re.findall(r"[^\W\d_]+", text or ""):
            padded = [1, *(ord(c.lower()[0]) + 2 for c in word), 1]
            for g in [*([c] for c in padded[1:-1]), *(padded[i : i + k] for k in (2, 3) for i in range(len(padded) - k + 1))]:
                key = _scrambled(sum(c << 21 * i for i, c in enumerate(g)))
                out[key] = out.get(key, 0) + 1
        return out

    total: dict[str, dict[int, int]] = {}
    for text, lang in train:
        own = total.setdefault(lang, {})
        for g, n in counts(text).items():
            own[g] = own.get(g, 0) + n
    profiles = {lang: {g: i for i, g in enumerate(sorted(c, key=lambda g: (-c[g], g))[:places])} for lang, c in total.items()}
    out = []
    for text in texts:
        count = counts(text)
        grams = sorted(count, key=lambda g: (-count[g], g & 0xFFFFFF))[:places]
        if not grams or not profiles:
            out.append(("und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else places for i, g in enumerate(grams)) / (len(grams) * places) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((best, 1 - far[best]))
    return out

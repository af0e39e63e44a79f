"""Plain one-machine versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring(docs: list[tuple[int, str | None]], k: int = 20) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        words = WORD.findall(text or "")
        gone, own = [False] * len(words), set()
        for i in range(len(words) - k + 1):
            window = tuple(words[i:i + k])
            if window in seen or window in own:
                gone[i:i + k] = [True] * k
            own.add(window)
        seen |= own
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text: str | None, k: int = 5) -> set:
    words = [w.translate(_LOWER) for w in WORD.findall(text or "")]
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


_LOWER = {c: c + 32 for c in range(65, 91)}


def near_duplicates(docs: list[tuple[int, str | None]], k: int = 5, percent: int = 80) -> dict[int, tuple]:
    sets = {doc: shingles(text, k) for doc, text in docs}
    where, parent = {}, {d: d for d in sets}
    for doc, grams in sets.items():
        for gram in grams:
            where.setdefault(gram, []).append(doc)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for doc, grams in sets.items():
        shared = {}
        for gram in grams:
            for other in where[gram]:
                if other < doc:
                    shared[other] = shared.get(other, 0) + 1
        for other, same in shared.items():
            if 100 * same >= percent * (len(grams) + len(sets[other]) - same):
                a, b = sorted((find(doc), find(other)))
                parent[b] = a
    return {doc: (len(grams), find(doc)) for doc, grams in sets.items()}


def suffixes(docs: list[tuple[int, str | None]], k: int = 50) -> dict[int, tuple]:
    first = {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - k + 1):
            first.setdefault(raw[i:i + k], doc)
    out = {}
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - k + 1):
            if first[raw[i:i + k]] < doc:
                gone[i:i + k] = b"\x01" * k
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


TOKEN = re.compile(r"[^\W_]+")


def alignment(item: list[str], words: list[str]) -> int:
    row, best = [0] * (len(words) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(words):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, max(new))
    return best


def contaminated(docs, items, threshold: float = 0.4) -> set[tuple[int, int]]:
    """Pairs by aligning every item with every whole document (no seeds)."""
    out = set()
    for item, item_text in items:
        wanted = TOKEN.findall((item_text or "").lower())
        for doc, text in docs:
            words = TOKEN.findall((text or "").lower())
            if len(wanted) >= 2 and set(wanted) & set(words) and alignment(wanted, words) >= threshold * 2 * len(wanted):
                out.add((doc, item))
    return out

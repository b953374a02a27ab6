"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from xxhash import xxh64_intdigest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = sorted((self.find(x), self.find(y)))
        self.up[b] = a


def fingerprint(text: str | None) -> int:
    words = WORDS.findall(lower(text or ""))
    if not words:
        return 0
    listed = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = np.array([xxh64_intdigest(s.encode(), 42) for s in listed], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def simhash(rows: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component) of (doc_id, text), all pairs compared."""
    prints = [fingerprint(t) for _, t in rows]
    values, parts = np.array(prints, np.uint64), Union(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            parts.join(i, i + 1 + int(j))
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[parts.find(i)] = min(doc, least.get(parts.find(i), doc))
    return [(doc, f"{p:016x}", least.get(parts.find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))]


def exact(rows: list[tuple]) -> dict[int, list[bool]]:
    """Whether each row (doc_id, text) stays, by row."""
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    kept = {min(g)[3] for g in groups.values()}
    return [i in kept for i in range(len(rows))]


def base_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def licences(text: str | None, phrases: dict[str, str]) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    places, labels = [], set()
    for phrase, label in phrases.items():
        split = phrase.split(" ")
        for i in range(len(words) - len(split) + 1):
            if words[i : i + len(split)] == split:
                places.append(i)
                labels.add(label)
    ends = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(labels)))


def dropped_lines(rows: list[tuple], size: int = 8, similar: float = 0.8) -> list[list[int]]:
    """Line numbers that go, for each row (doc_id, text); lines of all rows compared by exact Jaccard similarity."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    listed = [
        (i, n, lower(line.strip(" \t\n\x0b\x0c\r")))
        for i in order
        for n, line in enumerate((rows[i][1] or "").split("\n"))
        if line.strip(" \t\n\x0b\x0c\r")
    ]
    unique = list(dict.fromkeys(line for _, _, line in listed))
    sets = [{u[i : i + size] for i in range(max(1, len(u) - size + 1))} for u in unique]
    parts, holders = Union(len(unique)), defaultdict(list)
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s])
        for s in own:
            holders[s].append(i)
        for j, n in shared.items():
            if n >= similar * (len(own) + len(sets[j]) - n) - 1e-9:
                parts.join(i, j)
    number = {u: i for i, u in enumerate(unique)}
    seen, out = set(), [[] for _ in rows]
    for i, n, line in listed:
        root = parts.find(number[line])
        if root in seen:
            out[i].append(n)
        seen.add(root)
    return [sorted(x) for x in out]


def main_text(html_text: str) -> str:
    """For the test pages only: what stands in the article, cut at paragraphs."""
    import html

    inside = re.search(r"<article>(.*?)</article>", html_text, re.S)[1]
    inside = re.sub(r"<br>", "\n", re.sub(r"</?b>", "", inside))
    blocks = (" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)

"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    if len(w) < size:
        return frozenset([("whole", *w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(nodes, linked) -> dict:
    """Smallest reachable node of each, by trying all pairs."""
    label = {n: n for n in nodes}
    moved = True
    pairs = [(a, b) for a in nodes for b in nodes if a < b and linked(a, b)]
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def repeats(texts: list[bytes], length: int = 100) -> list[list[bool]]:
    """Which bytes are covered by a string that also starts earlier; texts in their order."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        out.append(gone)
    return out


def repeat_row(text: bytes, gone: list[bool]) -> tuple:
    kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
    spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
    return len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def water_fill(sizes: dict, weights: dict, most: int) -> dict:
    """Shares by weight, limited to most * size, the excess shared again until none is above."""
    total, full = sum(sizes.values()), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in full}
        left = total - sum(full.values())
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: float(most * sizes[s]) for s in rest if share[s] > most * sizes[s]}
        if not over:
            return full | share
        full |= over


def apriori(transactions: list[tuple[set, bool]], support: float, confidence: float) -> dict:
    """Rules to confidence, for few tokens."""
    from itertools import combinations

    n, times, bad = len(transactions), defaultdict(int), defaultdict(int)
    for tokens, is_bad in transactions:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                times[c] += 1
                bad[c] += is_bad
    need = -(-support * n // 1)
    found = {c: bad[c] / times[c] for c in times
             if bad[c] >= max(need, 1) and bad[c] / times[c] >= confidence}
    return {c: v for c, v in found.items()
            if not any(found.get(tuple(x for x in c if x != t), -1) >= v for t in c)}


def greedy_tiles(pattern: list, text: list, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling by its definition: the longest unmarked match each time."""
    p_free, t_free, laid = [bool(x) for x in pattern], [bool(x) for x in text], []
    while True:
        best = None
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while (p + k < len(pattern) and t + k < len(text) and p_free[p + k] and t_free[t + k]
                       and pattern[p + k] == text[t + k]):
                    k += 1
                if k >= shortest and (best is None or (-k, p, t) < best):
                    best = (-k, p, t)
        if best is None:
            return laid
        k, p, t = -best[0], best[1], best[2]
        p_free[p : p + k] = t_free[t : t + k] = [False] * k
        laid.append((p, t, k))


def statistics(text: str | None) -> list[float]:
    """The statistics of quality.STATISTICS, each by its definition."""
    data, w = (text or "").encode(), words(text)
    n, pairs = max(len(data), 1), list(zip(w, w[1:]))
    share = lambda keep: sum(map(keep, data)) / n
    blanks = sum(b == 32 or 9 <= b <= 13 for b in data)
    lines = data.count(b"\n") + 1
    return [
        len(data), len(w), lines, (len(data) - blanks) / max(len(w), 1),
        share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57),
        share(lambda b: chr(b) in ".,;:?'\"-()"), share(lambda b: chr(b) in "#$%&*+/<=>@[\\]^_`{}~"),
        share(lambda b: b == 33), share(lambda b: b == 124), blanks / n, share(lambda b: b >= 128),
        len(set(w)) / max(len(w), 1), len(set(pairs)) / max(len(w) - 1, 1),
        sum(a == b for a, b in pairs) / max(len(w) - 1, 1), len(data) / lines,
    ]


def rule_score(intercept: float, rules, stats: list[float]) -> float:
    total = intercept
    for rule, weight in rules:
        if all(stats[i] <= v if op == "<=" else stats[i] > v for i, op, v in rule):
            total += weight
    return 1 / (1 + math.exp(-total))


def cut_whole(text: str, gone: list[bool]) -> str:
    """A text without the characters all of whose bytes go."""
    out, at = [], 0
    for c in text:
        size = len(c.encode())
        if not all(gone[at : at + size]):
            out.append(c)
        at += size
    return "".join(out)


def leaked(text: str | None, item: str, shortest: int = 5, least: float = 0.6) -> bool:
    """Whether a text holds so much of an item in tiles; words are runs of letters and digits."""
    t, p = (re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
            for x in (text, item))
    grams = lambda w: {tuple(w[i : i + shortest]) for i in range(len(w) - shortest + 1)}
    if not grams(p) & grams(t):
        return False
    return sum(k for _, _, k in greedy_tiles(p, t, shortest)) >= least * len(p)


def copies(rows: list[tuple[int, int, str]], most: int = 3) -> dict[int, int]:
    """Copies of ``doc_id, size, source`` by systematic sampling in the order of size and hash."""
    digits = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:13], 16)
    sources = sorted({s for _, _, s in rows})
    sizes = {s: sum(n for _, n, x in rows if x == s) for s in sources}
    goal = water_fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}, most)
    out = {}
    for s in sources:
        step, unit = goal[s] / sizes[s] if sizes[s] else 0.0, digits(f"mix offset {s}") / 16**13
        ordered = sorted((n, digits(f"mix{i}"), i) for i, n, x in rows if x == s)
        for k, (_, _, i) in enumerate(ordered, 1):
            out[i] = math.floor(unit + k * step) - math.floor(unit + (k - 1) * step)
    return out

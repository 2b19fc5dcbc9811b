"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
from collections import Counter

WS = r"[\x20\x09-\x0D]"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        q = int(c) * (1 + i % 2)
        total += q - 9 if q > 9 else q
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(_digits(m[0])) <= 19 and luhn(_digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(_digits(m[0])) <= 15),
)
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def spans(text: str, rules) -> list[tuple[int, int, str, int]]:
    """(start, kind number, kind, end)"""
    return [(m.start(), o, k, m.end()) for o, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text, re.A) if ok(m)]


def repeats(texts: list[bytes], length: int = 200) -> list[list[bool]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def shingles(text: str) -> frozenset:
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(texts: list[str], similarity: float = 0.8) -> tuple[list[int], list[int]]:
    """Links of each text and the smallest index that links lead to."""
    sets = [shingles(t) for t in texts]
    n, label = len(sets), list(range(len(sets)))
    links = [0] * n
    edges = []
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    for _ in range(n):
        moved = False
        for i, j in edges:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
        if not moved:
            break
    return links, label


def targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free, weight = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else free * w[s] / weight for s in names}
        more = {s for s in names if out[s] > most * sizes[s] + 1e-9}
        if not more:
            return out
        full |= more


def ftrl(rows: list[tuple[list[int], int]], epochs: int, alpha=0.5, beta=1.0, l1=4.0, l2=0.1) -> tuple[float, dict[int, float]]:
    """FTRL-proximal, coordinate by coordinate; the bias is the coordinate None, without L1."""
    import math
    import numpy as np

    z: dict = {}
    n: dict = {}

    def weight(i) -> float:
        zi, bound = z.get(i, 0.0), 0.0 if i is None else l1
        if abs(zi) <= bound:
            return 0.0
        return -(zi - math.copysign(bound, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            features, y = rows[k]
            w = {i: weight(i) for i in [*features, None]}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = p - y
            for i in w:
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return weight(None), {i: w for i in z if i is not None and (w := weight(i))}

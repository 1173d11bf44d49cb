"""Plain versions of the corpus operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from hashlib import sha256

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def removals(rows, window):
    cut = [SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in cut for k in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, cut, strict=True):
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out.append((key, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def shingles(text, size=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def link_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in holders[g])
        for j, k in met.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def license_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def license_rows(rows, base, templates, min_match=3, min_cover=0.75, max_gap=8):
    """Base places, labels and score by looking every run of words up in every template."""
    every = [(license_words(t), label) for t, label in [*base.items(), *templates.items()]]
    places = defaultdict(list)
    for k, (t, _) in enumerate(every):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                places[tuple(t[i:j])].append((k, i))
    out = []
    for key, text in rows:
        w = license_words(text)
        found = [(i, label) for i in range(len(w)) for p, label in base.items() if w[i : i + len(p.split())] == p.split()]
        longest = [0] * (len(w) + 1)
        for end in range(1, len(w) + 1):
            n = longest[end - 1] + 1
            while n and tuple(w[end - n : end]) not in places:
                n -= 1
            longest[end] = n
        matches = set()
        for end in range(1, len(w) + 1):
            n = longest[end]
            if n and (end == len(w) or longest[end + 1] != n + 1):
                matches |= {(end - n, at, -n, k) for k, at in places[tuple(w[end - n : end])] if n >= min(min_match, len(every[k][0]))}
        best, labels = 0.0, {label for _, label in found}
        for k, (t, label) in enumerate(every):
            chains = []
            for start, at, n, _ in sorted(m for m in matches if m[3] == k):
                fits = [c for c in chains if start - c["end"] <= max_gap and c["at"] <= at and c["end"] <= start]
                if fits:
                    c = max(fits, key=lambda c: c["n"])
                else:
                    chains.append(c := {"n": 0})
                c |= {"at": at - n, "end": start - n, "n": c["n"] - n}
            covers = [c["n"] / len(t) for c in chains]
            best = max([best, *covers])
            if any(c >= min_cover for c in covers):
                labels.add(label)
        starts = [i for i, _ in found]
        out.append((key, len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), min(1.0, best)))
    return out

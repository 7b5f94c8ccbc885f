"""Plain Python versions of the operators, slow and simple, for small inputs."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import regex


def find(parent: dict, x):
    while parent[x] != x:
        x = parent[x]
    return x


def shingle_set(text: str | None) -> frozenset:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", lower)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_classes(docs: list[tuple]) -> dict:
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def contained(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    out = set()
    for i, t in docs:
        have = grams(plain_words(t))
        for j, x in items:
            want = grams(plain_words(x))
            if want and 100 * len(have & want) >= 80 * len(want):
                out.add((i, j, len(have & want), len(want)))
    return out


def cut_runs(docs: list[tuple], n: int = 50) -> dict:
    """The texts without any run of lines of n words or more that equals an earlier one: every diagonal of every two texts."""
    words = lambda x: re.findall(r"[^ \t\x0b\f\r]+", x.lower())
    split = {i: [(k, words(x), len(words(x))) for k, x in enumerate((t or "").split("\n")) if words(x)] for i, t in docs}
    at = defaultdict(list)
    for i, x in split.items():
        for p, (_, line, _) in enumerate(x):
            at[tuple(line)].append((i, p))
    gone = defaultdict(set)
    for places in at.values():
        for b, j in places:
            for a, i in places:
                # each run is taken up where it begins
                if (a, i) < (b, j) and not (i and j and split[a][i - 1][1] == split[b][j - 1][1]):
                    m = 0
                    while i + m < len(split[a]) and j + m < len(split[b]) and split[a][i + m][1] == split[b][j + m][1]:
                        m += 1
                    if sum(w for _, _, w in split[b][j : j + m]) >= n:
                        gone[b] |= set(range(split[b][j][0], split[b][j + m - 1][0] + 1))
    return {i: (t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in docs}


def disclosed_terms(docs: list[tuple], base) -> set[str]:
    """The terms over the thresholds of docs (doc_id, text). base: text -> base spans (kind, start, end)."""
    from tracewright.llm import pii

    letters = lambda t: set(regex.findall(r"[\p{L}\p{M}]+", (t or "").lower()))
    docs = set(docs)
    held = {d: letters(d[1]) for d in docs}
    both, contexts, having = defaultdict(set), defaultdict(set), defaultdict(set)
    for d in docs:
        t, spans = d[1] or "", base(d[1])
        for kind, s, e in spans:
            # contexts reach from one match of the kind to the next, whether the matches count or not
            edges = [(m.start(), m.end()) for m in re.finditer(pii_patterns()[kind], t)]
            before, after = t[max((y for _, y in edges if y <= s), default=0) : s], t[e : min((x for x, _ in edges if x >= e), default=len(t))]
            near, entity = before.split("\n")[-1] + " " + after.split("\n")[0], (kind, t[s:e].lower())
            having[entity].add(d)
            for w in letters(near):
                both[w, entity].add(d)
                contexts[w, entity].add(near)
    out = set()
    for (w, entity), x in both.items():
        n = sum(w in h for h in held.values())
        if len(contexts[w, entity]) >= pii.LEAST_CONTEXTS and len(x) >= pii.LEAST_SHARE * n and math.log2(len(x) * len(docs) / (n * len(having[entity]))) >= pii.LEAST_BITS:
            out.add(w)
    return out


def pii_patterns() -> dict[str, str]:
    """The base patterns as they are given."""
    return {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

"""Kneser-Ney by the definitions, with dictionaries of tuples."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict


def tokens(text, order):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", text) + ["</s>"]


def discounts(counts):
    t = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    if min(t) > 0:
        y = t[0] / (t[0] + 2 * t[1])
        d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]]
        if all(0 < x <= i for i, x in enumerate(d, 1)):
            return d
    return [0.5, 1.0, 1.5]


def scores(train, texts, order):
    """(log10 p, base score, tokens, known) of each text."""
    counts = [Counter() for _ in range(order + 1)]
    seen = Counter()
    for text in train:
        t = tokens(text, order)
        for i in range(order - 1, len(t)):
            seen[t[i]] += 1
            counts[order][tuple(t[i - order + 1 : i + 1])] += 1
    for m in range(order - 1, 0, -1):
        for gram in counts[m + 1]:
            counts[m][gram[1:]] += 1
    d = [None] + [discounts(list(c.values())) for c in counts[1:]]
    contexts = [defaultdict(list) for _ in range(order + 1)]
    for m in range(1, order + 1):
        for gram, c in counts[m].items():
            contexts[m][gram[:-1]].append(c)

    def cut(m, c):
        return 0 if c == 0 else d[m][min(c, 3) - 1]

    def p(gram):
        m = len(gram)
        if m == 0:
            return 1 / (len(seen) + 1)
        lower = p(gram[1:])
        own = contexts[m].get(gram[:-1])
        if not own:
            return lower
        c = counts[m][gram]
        return (c - cut(m, c) + sum(cut(m, x) for x in own) * lower) / sum(own)

    n, v = sum(seen.values()), len(seen)
    out = []
    for text in texts:
        t = tokens(text, order)
        at = range(order - 1, len(t))
        out.append((sum(math.log10(p(tuple(t[i - order + 1 : i + 1]))) for i in at),
                    sum(math.log10((seen[t[i]] + 1) / (n + v + 1)) for i in at), len(at), sum(seen[t[i]] > 0 for i in at)))
    return out

"""The text operators by their definitions, one document after the other."""

from __future__ import annotations

import re
from collections import Counter

from ridestats.llm.quality import BOILERPLATE, SEPARATORS, Rules

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def repeat_words(w, size=8):
    runs = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
    seen = Counter(runs)
    return len({j for i, r in enumerate(runs) if seen[r] > 1 for j in range(i, i + size)})


def fails(line, rules=Rules()):
    w, n = words(line), len(words(line))
    upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
    last = w[-1][-1]
    plain = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return (
        len(re.findall(r"[#*$%&|<>]", line)) >= rules.symbols * n
        or line.count("!") >= rules.shouts * n + 1
        or (n >= 5 and upper > rules.capitals * max(upper + lower, 1))
        or sum(x in SEPARATORS for x in w) >= rules.separators * n + 1
        or (n < rules.short_line and not (ord(last) > 127 or last in ".!?:;\"')]}"))
        or (n >= 5 and sum(a == b for a, b in zip(w, w[1:])) >= rules.echoes * n)
        or (n <= rules.boilerplate_words and any(p in plain for p in BOILERPLATE))
    )


def judged(text, rules=Rules()):
    """(words, chars in words, symbols, equal lines, repeated words, base failed, kept, cleaned text)."""
    w, rep = words(text), repeat_words(words(text))
    lines = [x for x in (text or "").split("\n") if words(x)]
    bad = [x for x in lines if fails(x, rules)]
    lost = sum(len(words(x)) for x in bad)
    failed = len(w) < 20 or 100 * rep > 30 * len(w)
    kept = not failed and lost <= rules.lost * len(w) and len(w) - lost >= rules.left
    cleaned = (text or "") if not bad else "\n".join(x for x in lines if not fails(x, rules))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, failed, kept, cleaned)


def removed_lines(docs, min_words=50):
    """For each (id, text): places of lines in later copies of runs of ``min_words`` words, by trying all runs."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    seen: dict = {}
    gone = [set() for _ in docs]
    found = []
    for i in order:
        lines = [(p, x, len(words(x))) for p, x in enumerate((docs[i][1] or "").split("\n")) if words(x)]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += lines[b][2]
                if total >= min_words:
                    found.append((i, tuple(x for _, x, _ in lines[a : b + 1]), [p for p, _, _ in lines[a : b + 1]]))
    for i, run, places in found:
        if seen.setdefault(run, (i, places[0])) != (i, places[0]):
            gone[i].update(places)
    return [sorted(g) for g in gone]

"""Plain versions of the operators, for small tables."""

from collections import Counter

from tests.llm.fixtures import lowered, tokens


class Ties:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def near_duplicates(rows, words=5, percent=80):
    """Per row: set size and smallest linked id. ``rows``: (doc_id, text), ids not null, equal ids equal texts."""
    sets = {}
    for i, text in rows:
        w = tokens(lowered(text))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    ties, holders = Ties(sets), {}
    for i, own in sets.items():
        counts = Counter(j for g in own for j in holders.get(g, ()))
        for j, n in counts.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                ties.join(i, j)
        for g in own:
            holders.setdefault(g, []).append(i)
    return {i: (len(s), ties.root(i)) for i, s in sets.items()}


def sentences(text):
    import re

    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, now = [], []
    for k, (word, _, end) in enumerate(found):
        now.append(k)
        if word[-1] in ".!?" or k + 1 == len(found) or "\n" in text[end : found[k + 1][1]]:
            out.append(now)
            now = []
    return found, out


def spans(rows, run=2, least=15):
    """Per id: sentences, removed sentences, text that is left."""
    held, parts = {}, {}
    for i, text in dict(rows).items():
        found, own = sentences(text)
        runs = []
        plain = lambda s, found=found: tuple(lowered(found[k][0]) for k in s)
        for k in range(len(own)):
            n = run
            while sum(map(len, own[k : k + n])) < least and k + n <= len(own):
                n += 1
            if k + n <= len(own):
                runs.append((k, n, tuple(map(plain, own[k : k + n]))))
            if len(own[k]) >= least:
                runs.append((k, 1, (plain(own[k]),)))
        parts[i] = (text, found, own, runs)
        for k, _, what in runs:
            held.setdefault(what, []).append((i, k))
    out = {}
    for i, (text, found, own, runs) in parts.items():
        gone = {j for k, n, what in runs if min(held[what]) != (i, k) for j in range(k, k + n)}
        if gone:
            starts = [found[s[0]][1] for s in own] + [len(text)]
            text = text[: starts[0]] + "".join(text[starts[k] : starts[k + 1]] for k in range(len(own)) if k not in gone)
        out[i] = (len(own), len(gone), text)
    return out

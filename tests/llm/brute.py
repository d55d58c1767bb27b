"""Plain versions of operators, for small frames."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def words(text):
    return WORD.findall(text.encode())


def brute_groups(rows, size, least):
    sets = {}
    for doc, text in rows:
        w = [x.lower() for x in words(text)]
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= least * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def brute_removed(rows, size=50):
    first = {}
    for doc, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), doc)
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < doc:
                gone |= set(range(i, i + size))
        out[doc] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out

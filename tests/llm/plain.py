"""Plain versions of the operators, for comparison on small tables."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text):
    return [w.translate(LOW) for w in WORD.findall(text or "")]


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1)))


def components(docs, percent=75):
    """{id: (number of shingles, smallest id reachable)} of {id: text}, comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(sorted(docs), 2):
        x, y = sets[i], sets[j]
        same = len(x & y)
        if same and 100 * same >= percent * (len(x) + len(y) - same):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: (len(sets[i]), root(i)) for i in docs}

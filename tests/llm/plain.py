"""Plain versions of the operators, to hold results against; and small corpora."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def runs(gone):
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def cut_windows(docs, size):
    """doc_id: (n_words, n_removed, digest) after removing words of windows that start earlier somewhere."""
    seen, out = set(), {}
    for d in sorted(docs):
        words = WORD.findall(docs[d] or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            if w in seen:
                gone[i : i + size] = [True] * size
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def cut_bytes(docs, size):
    """doc_id: (n_bytes, n_removed, n_spans, digest) after removing bytes of strings that also start elsewhere."""
    raw = {d: (t or "").encode() for d, t in docs.items()}
    count = Counter(t[i : i + size] for t in raw.values() for i in range(len(t) - size + 1))
    out = {}
    for d, t in raw.items():
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[d] = (len(t), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_documents(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    pairs = {(a, b) for ds in where.values() for a in ds for b in ds if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(docs, links).items()}


def corpus(n=60, seed=5):
    """Texts with exact and near copies, shared passages, repeats inside, odd and empty ones."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    shared = [say(45) for _ in range(4)]
    docs = {}
    for d in range(n):
        kind = d % 6
        text = say(rnd.randint(30, 200))
        if kind == 1 and d > 6:
            text = docs[rnd.randrange(d)] or text
        elif kind == 2 and d > 6:
            words = (docs[rnd.randrange(d)] or text).split()
            for _ in range(max(1, len(words) // rnd.choice((15, 40, 90)))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            text = " ".join(words)
        elif kind == 3:
            text = say(20) + ". " + rnd.choice(shared) + "\n" + say(30)
        elif kind == 4:
            text = (rnd.choice(vocabulary) + " ") * rnd.randint(30, 90) + say(10).upper()
        docs[d] = text
    docs |= {1000: None, 1001: "", 1002: " \n\t ", 1003: "one two", 1004: "One two", 1005: "x", 1006: "long " * 3000}
    return docs

"""Plain versions of the operators, for small inputs. Documents are rows (doc_id, text); results are lists of one tuple a row, doc_id first.
A null doc_id comes after all others."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def known(i):
    return LAST if i is None else i


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def similar(docs):
    """The root row of each row, rows by their order of doc_id."""
    sets = [frozenset(shingles(t)) for _, t in docs]
    where, edges = defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                edges.add((i, j))
    return sets, roots(range(len(docs)), edges)


def ngram_join(docs):
    sets, root = similar(docs)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root[i]] = min(least.get(root[i], LAST), known(d))
    return [(d, len(sets[i]), None if least[root[i]] == LAST else least[root[i]]) for i, (d, _) in enumerate(docs)]


def items_hits(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {}
    for item, text in items:
        w = tuple(word.findall(lower(text or "")))
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if w and item is not None else ():
            phrases.setdefault(w[i : i + k], set()).add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        w = tuple(word.findall(lower(text or "")))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if p := phrases.get(w[i : i + k]):
                    hit.update(range(i, i + k))
                    found |= p
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def pii(text):
    """Base spans by the plain patterns."""
    text = text or ""

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    out = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def word_repeats(docs, window=13):
    split = [WORD.findall(t or "") for _, t in docs]
    first, out = {}, []
    for (d, _), w in zip(docs, split, strict=True):
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, LAST), known(d))
    for (d, _), w in zip(docs, split, strict=True):
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < known(d):
                gone.update(range(j, j + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def byte_repeats(docs, window=100):
    raw = [(t or "").encode() for _, t in docs]
    first, out = {}, []
    for (d, _), t in zip(docs, raw, strict=True):
        for j in range(len(t) - window + 1):
            k = t[j : j + window]
            first[k] = min(first.get(k, (LAST, LAST)), (known(d), j))
    for (d, _), t in zip(docs, raw, strict=True):
        gone = bytearray(len(t))
        upto = 0
        for j in range(len(t) - window + 1):
            if first[t[j : j + window]] < (known(d), j):
                for k in range(max(j, upto), j + window):
                    gone[k] = 1
                upto = j + window
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((d, len(t), sum(gone), spans, sha(bytes(c for k, c in enumerate(t) if not gone[k]))))
    return out

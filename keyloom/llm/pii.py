"""Personal data: candidate spans, judged by boosted trees.

Base patterns are exact rules and always kept. Beside them, generators of high recall propose overlapping spans: digit groups that may
be telephone or card numbers (every sequence of neighbouring groups with a fitting number of digits, as lines may hold several numbers
side by side), addresses that are spelled out, colon-separated hexadecimal groups. Gradient-boosted trees score each
candidate from its format and its context; a threshold for each kind, set on held-out examples to a precision of PRECISION but not under
LEAST_SCORE, selects.
No table labels spans, so the trees are trained here on EXAMPLES examples made by rule, with a fixed seed.

All scans are linear in the text: patterns are anchored where a match must start, or at the sign that a match must hold.

Defined cases: null text is empty; texts without spans have counts 0 and the hash of the empty string; spans count code points, end
exclusive; repeated rows and rows without doc_id are judged each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.text import identified
from keyloom.sources.tables import read_table

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 8000
PRECISION = 0.98
LEAST_SCORE = 0.2
CONTEXT = 40
BLOCK = 10_000

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANY_SIGN = re.compile(r"[0-9@]")
SPELLED = re.compile(r"(?:[ ]?[(\[]at[)\]][ ]?| at )[A-Za-z0-9-]{1,63}(?:[ ]?[(\[]dot[)\]][ ]?| dot |\.)[A-Za-z]{2,10}", re.ASCII)
DIGITS = re.compile(r"(?<![0-9])\(?[0-9](?:[ ()./_-]{0,3}[0-9])*")
GROUP = re.compile(r"[0-9]+")
JOINED_BEFORE = re.compile(r"[0-9]([ ()./_-]{0,3})\Z")
JOINED_AFTER = re.compile(r"([ ()./_-]{0,3})[0-9]")
DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2})(?![0-9])")
HEX = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])")
SHAPE = str.maketrans("123456789", "0" * 9)
WORDS_NEAR = {
    "email": re.compile(r"mail|contact|write|reach", re.I), "phone": re.compile(r"phone|tel|call|fax|mobile|cell|dial|\bring|my number|number is", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment", re.I), "ip": re.compile(r"\bip|host|address|server|login|ping", re.I),
    "other": re.compile(r"order|invoice|item|isbn|version|page|serial|ticket|total|date|figure|no\.|number", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping within a kind; matches that fail are dropped."""
    out = []
    if not ANY_SIGN.search(text):
        return out
    last = 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            s = at
            while s > last and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append((s, m.end(), "email"))
                last = m.end()
                at = text.find("@", last)
                continue
        last = at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return out


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans that may be personal data, overlapping and with several kinds."""
    for m in SPELLED.finditer(text):
        s = m.start()
        while s > max(0, m.start() - 64) and text[s - 1] in LOCAL:
            s -= 1
        if s < m.start():
            yield s, m.end(), "email"
    if not ANY_SIGN.search(text):
        return
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 7:
            recent: deque = deque(maxlen=19)
            for g in GROUP.finditer(text, m.start(), m.end()):
                recent.append(g.span())
                n = 0
                for s, e in reversed(recent):
                    n += e - s
                    if n > 19:
                        break
                    if 7 <= n <= 15:
                        yield s - (s > m.start() and text[s - 1] == "("), g.end(), "phone"
                    if n >= 12:
                        yield s, g.end(), "card"
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "ip"


@lru_cache(64)
def context_before(text: str, start: int) -> tuple:
    """The sign before, what joins digits before (none if nothing does), and which telling words are near."""
    before = text[max(0, start - CONTEXT) : start]
    m = JOINED_BEFORE.search(before)
    return before[-1:], m and m[1].strip("()"), [float(bool(p.search(before))) for p in WORDS_NEAR.values()]


def describe(text: str, start: int, end: int, kind: str) -> list[float]:
    """Format and context of a candidate."""
    s, digits = text[start:end], only_digits(text[start:end])
    prev, join_before, near = context_before(text, start)
    nxt, join_after = text[end : end + 1], JOINED_AFTER.match(text, end)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    shape = s.translate(SHAPE)
    seps, joins = re.findall(r"[^0-9()]+", s), (join_before, join_after and join_after[1].strip("()"))
    return [
        float(KINDS.index(kind)), len(digits), len(groups), max(sizes), min(sizes), float(luhn(digits)) if digits else 0.0, float("(" in s or "[" in s), s.count("-"), s.count("."), s.count("/"), s.count(" "), s.count(":"),
        float(prev.isalnum() or prev in ("_", "$", "#", "€")), float(nxt.isalnum() or nxt in ("_", "%")), float(sizes[0] == 4 and digits[:2] in ("19", "20")), float(s[:1] in "345(0"),
        *near, float("dot" in s.lower()), float(s.count("::") > 0), float(digits[:1] == "0") + float(digits[:2] == "00"), float(len(set(sizes)) == 1), float(bool(re.search("[A-Fa-f]", s))),
        # digits that a separator joins to the candidate (without or with a space), and whether the candidate has that separator within
        *[0.0 if j is None else 1.0 + (" " in j) for j in joins], *[float(j is not None and j in seps) for j in joins],
        sizes[0], sizes[-1], len(set(seps)), max(map(len, seps), default=0), float(bool(DATE.search(s))),
        # whether a thing of the same shape stands beside it
        *[float(shape in side.translate(SHAPE)) for side in (text[max(0, start - len(s) - 3) : start], text[end : end + len(s) + 3])],
    ]


class Boosted:
    """Gradient-boosted trees of DEPTH levels for logistic loss; splits are found over counts of binned values."""

    DEPTH = 3
    BINS = 17

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.25):
        self.trees, self.base = [], float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        n, m = x.shape
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS)[:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v) + j * self.BINS for j, (c, v) in enumerate(zip(cuts, x.T, strict=True))], axis=1)
        f = np.full(n, self.base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
            """A leaf's value, or (feature, cut, below, above)."""
            if depth and len(rows) > 1:
                at = codes[rows].ravel()
                sums = (np.bincount(at, np.repeat(v[rows], m), m * self.BINS).reshape(m, -1).cumsum(axis=1) for v in (g, h))
                (left_g, left_h), (all_g, all_h) = sums, (g[rows].sum(), h[rows].sum())
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1)
                j, k = np.unravel_index(gain.argmax(), gain.shape)
                low = codes[rows, j] <= j * self.BINS + k
                if low.any() and not low.all():
                    return int(j), float(cuts[j][k]), grow(rows[low], g, h, depth - 1), grow(rows[~low], g, h, depth - 1)
            value = float(rate * g[rows].sum() / (h[rows].sum() + 1))
            f[rows] += value
            return value

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            self.trees.append(grow(np.arange(n), y - p, p * (1 - p), self.DEPTH))

    def score(self, x: np.ndarray) -> np.ndarray:
        def value(tree):
            if isinstance(tree, float):
                return tree
            j, cut, below, above = tree
            return np.where(x[:, j] <= cut, value(below), value(above))

        f = np.full(len(x), self.base)
        for tree in self.trees:
            f += value(tree)
        return 1 / (1 + np.exp(-f))


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with one thing in them or two side by side, and the spans of those that are personal data: formats by kind, with and without telling
    context."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    pick = lambda *x: x[int(r.integers(0, len(x)))]
    word = lambda: pick("river", "stone", "marta", "lee", "green", "anton", "sky", "mira")

    def grouped(n: int, sep: str) -> str:
        """n digits in groups of one size, the last one larger where a single digit would be left."""
        size, body = pick(2, 3, 4, n), d(n)
        at = [i for i in range(0, n, size) if not i or n - i > 1]
        return sep.join(body[i:j] for i, j in zip(at, [*at[1:], n], strict=True))

    def trunk() -> str:
        sep, area = pick(" ", "-", "."), f"0{pick(*'123456789')}{d(pick(0, 1, 1, 2, 2, 3))}"
        if pick(0, 0, 0, 1):
            area = f"({area})" + pick(" ", "")
        else:
            area += pick(sep, sep, "/", " / ", "-", " ")
        return area + grouped(pick(6, 7, 7, 8, 8), sep)

    def phone() -> str:
        sep, first = pick(" ", " ", "-", "."), pick("-", ".", " ", "/", "-")
        area = pick(f"({d(3)}) {d(3)}{pick('-', ' ')}{d(4)}", f"{d(3)}{first}{d(3)}{pick('-', first)}{d(4)}", f"1{pick('-', ' ')}{d(3)}-{d(3)}-{d(4)}", f"1 {d(3)} {d(3)} {d(4)}")
        abroad = sep.join([f"00{pick(*'123456789')}{d(1)}", d(pick(1, 2, 3)), grouped(pick(6, 7, 8), sep)])
        return pick(area, area, trunk(), trunk(), abroad)

    def number() -> str:
        """Digit groups that only the context tells to be a telephone number."""
        return pick(*"123456789") + grouped(pick(6, 7, 8, 9, 10), pick(" ", "-", "."))

    def user() -> str:
        return pick(f"{word()}{d(2)}", word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()[0]}.{word()}", f"{word()}-{word()}")

    def date() -> str:
        return pick(f"{pick('19', '20')}{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{pick('19', '20')}{d(2)}", f"{pick('19', '20')}{d(2)}-{pick('19', '20')}{d(2)}", f"{pick('19', '20')}{d(2)}.{d(2)}.{d(2)}")

    def card(*seps: str) -> str:
        body = pick("4", "5", "37", "6011") + d(16)
        body = body[: pick(14, 15)]
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = pick(*(seps or (".", "/", "_", "  ")))
        return sep.join(body[i : i + 4] for i in range(0, len(body), 4))

    good = [
        lambda: (pick("call me at ", "phone: ", "tel. ", "mobile ", "my number is ", "fax ", ""), phone()),
        lambda: (pick("call ", "phone: ", "tel. ", "my mobile is ", "my number is ", "fax "), number()),
        lambda: (pick("card number ", "pay with visa ", "credit card: ", "debit card "), card()),
        lambda: (pick("mail ", "contact ", "write to ", ""), f"{user()}{pick(pick(' at ', ' (at) ', '[at]', ' [at] ') + word() + pick(' dot ', ' (dot) ', '[dot]', ' [dot] '), pick('(at)', ' (at) ', '[at]') + word() + '.')}{pick('com', 'org', 'net', 'de', 'info')}"),
        lambda: (pick("server ip ", "host ", "login from ", "address "), ":".join(f"{int(x):x}" for x in r.integers(256, 65536, 8))),
    ]
    bad = [
        lambda: (pick("order ", "invoice no. ", "serial ", "ticket ", "", "item "), pick(d(7), d(8), d(9), d(12), d(14), f"{d(4)}-{d(5)}", f"{d(5)}-{d(6)}")),
        lambda: (pick("order ", "invoice no. ", "serial ", "tracking number ", "total ", "item "), pick("", "", "0", "00") + number()),
        lambda: (pick("on ", "date ", "", "from "), date()),
        lambda: (pick("isbn ", "page ", "figure "), pick(f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)} {d(3)} {d(3)}")),
        lambda: (pick("total ", "", "sum of "), pick(f"{d(3)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(3)} {d(2)}", f"{d(3)}.{d(3)}.{d(3)}")),
        lambda: (pick("we met ", "look ", "stay ", f"{word()} "), f"at {word()}.{pick('then', 'the', 'com', 'it', 'she', 'a')}"),
        lambda: (pick("at ", "", "time "), ":".join(d(2) for _ in range(4))),
    ]
    beside = [
        lambda: (pick("call me at ", "phone: ", "tel. ", "my number is ", "fax ", "", "", ""), [(phone(), 1), (phone(), 1)]),
        lambda: (pick("call me at ", "phone: ", "tel. ", ""), [(phone(), 1), (date(), 0)]),
        lambda: (pick("on ", "date ", ""), [(date(), 0), (phone(), 1)]),
        lambda: (pick("card number ", "pay with visa ", "credit card: ", ""), [(card(" ", "-", ".", ""), 1), (f"{pick('0', '1')}{d(1)}{pick('/', '-')}{pick('', '20')}{d(2)}", 0)]),
        lambda: (pick("card number ", "credit cards: ", ""), [(card(" ", "-", ".", ""), 1), (card(" ", "-", ".", ""), 1)]),
        lambda: (pick("from ", "dates ", ""), [(date(), 0), (date(), 0)]),
        lambda: (pick("order ", "items ", "", "page "), [(pick(d(4), d(7), d(9)), 0), (pick(d(5), d(8), date()), 0)]),
    ]
    out = []
    for i in range(n):
        context, things = pick(*(beside if i % 4 >= 2 else good if i % 2 else bad))()
        text, spans = f"{word()} {word()} {context}", []
        for j, (thing, right) in enumerate(things if isinstance(things, list) else [(things, i % 2)]):
            text += pick(" ", " / ", "/", " - ", "  ") if j else ""
            spans += [(len(text), len(text) + len(thing))] * right
            text += thing
        out.append((f"{text}{pick('', '.', ' and', ',')} {word()}", spans))
    return out


@lru_cache(1)
def trained() -> tuple[Boosted, dict[str, float]]:
    """The trees and the thresholds of the kinds."""
    x, y = [], []
    for text, spans in examples():
        base = base_spans(text)
        for s, e, kind in candidates(text):
            if not any(a < e and s < b for a, b, _ in base):
                # a card-like number is a card only if the digits check, and a telephone number only if not a card
                right = (s, e) in spans and (kind != "card" or luhn(only_digits(text[s:e]))) and (kind != "phone" or len(only_digits(text[s:e])) <= 14)
                x.append(describe(text, s, e, kind))
                y.append(float(right))
    x, y = np.array(x), np.array(y)
    test = np.arange(len(y)) % 3 == 0
    model = Boosted(x[~test], y[~test])
    p, limits = model.score(x[test]), {}
    for i, kind in enumerate(KINDS):
        own = x[test][:, 0] == i
        order = np.argsort(-p[own])
        right = np.cumsum(y[test][own][order]) / np.arange(1, own.sum() + 1) if own.any() else np.zeros(0)
        fine = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(LEAST_SCORE, float(p[own][order][fine[-1]])) if len(fine) else 1.1
    return model, limits


def find_spans(text: str, model: Boosted, limits: dict[str, float]) -> tuple[list, list]:
    """Base spans, and all spans: base ones and selected candidates that do not overlap them, best first."""
    base = base_spans(text)
    taken = sorted((s, e) for s, e, _ in base)
    starts, ends = [s for s, _ in taken], np.maximum.accumulate([0, *[e for _, e in taken]]).tolist()
    fine, added = [], []
    for free in batched((c for c in candidates(text) if ends[bisect_left(starts, c[1])] <= c[0]), BLOCK):
        p = model.score(np.array([describe(text, *c) for c in free]))
        fine += [(x, c) for x, c in zip(p.tolist(), free, strict=True) if x >= limits[c[2]]]
    busy: list[tuple[int, int]] = []  # in order, none overlaps another
    for _, (s, e, kind) in sorted(fine, key=lambda x: -x[0]):
        at = bisect_left(busy, (e,))
        if not at or busy[at - 1][1] <= s:
            busy.insert(at, (s, e))
            added.append((s, e, kind))
    key = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=key), sorted(base + added, key=key)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in spans:
        if e > at:
            out += [text[at : max(s, at)], f"[{kind}]"] if s >= at else []
            at = e
    return "".join(out) + text[at:]


def detect(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), and the redacted text if `with_text`."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = shared.value
        for b in batches:
            rows = []
            for text in b.column("text"):
                text = text.as_py() or ""
                base, spans = find_spans(text, model, limits)
                kinds = [k for _, _, k in base]
                row = [*[kinds.count(k) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                rows.append([*row, redact(text, spans)] if with_text else row)
            names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", *(["redacted"] if with_text else [])]
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.record_batch([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)]], names=["doc_id", *names])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * with_text
    return identified(docs).mapInArrow(run, schema)


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read_table(spark, sf_dir, "documents"))

"""Personal data by a skip-chain conditional random field over each document.

Base patterns find email, ip, card and phone spans. The field then labels words: every word with a digit or an `@` is a
variable with the labels O, email, ip, card, phone; all other words are O (they enter as context only, so the chain
falls into parts that are solved exactly alike). Potentials: word features (shape and neighbours), transitions between
variables that are neighbouring words, and skip edges from each word to the next one in the document with the same key
(equal lower-case text without edge punctuation, equal digits, or equal last seven digits, also of the digits of neighbouring
words together), so distant mentions share evidence. Loopy sum-product message passing runs over all documents of a slice at once. Words labelled other than O with
enough probability add spans; base spans stay.

Fitting: weights come from about `sample` documents with variables (twice as many at most, and the first SAMPLE_WORDS
variables of each: documented bounds), chosen by a hash of doc_id and text, whose words are labelled by the base patterns. A
word outside all base spans that a skip edge links to one inside counts as unknown, not as O, and is left out; the skip weight
is the smoothed log odds of linked known words agreeing.

Distribution: two maps over whole texts without a shuffle; skip edges link each word to one later word per key, so their
number is linear in the words. Texts are inferred in groups of at most TOGETHER characters, or one text; an edge takes
about 300 bytes, since its potentials are two shared 5 x 5 tables.

Defined results: null or empty text has no spans; repeated rows are treated alike; a very long text is one graph, inferred
whole; of labels with equal probability the first of O, email, ip, card, phone wins; an empty table gives an empty result;
with no labelled word in the sample only base spans are returned; extra columns are ignored, whatever their names. Spans are
counted in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import cut, small_batches

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", re.ASCII)
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]++")
EDGE = ".,;:!?\"'()[]{}<>"
SAMPLE = 3000
SAMPLE_WORDS = 4096
SAMPLE_VARIABLES = 1 << 19
TOGETHER = 1 << 19
NEEDED = 0.8
ROUNDS = 8
N_FEATURES = 64


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > last and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if not MARK.search(text):
        return out
    out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = only_digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(only_digits(m[0])) <= 15]
    return out


def variables(text: str) -> list[tuple[int, int, int, str, str]]:
    """(word number, start, end, previous word, next word) of each word with a digit or @, edge punctuation trimmed."""
    out, before, words = [], "", list(WORD.finditer(text))
    for i, m in enumerate(words):
        w = m[0]
        if MARK.search(w):
            core = w.strip(EDGE)
            if core:
                a = m.start() + w.index(core)
                out.append((i, a, a + len(core), before, words[i + 1][0] if i + 1 < len(words) else ""))
        before = w
    return out


def word_features(core: str, before: str, after: str) -> list[int]:
    """Numbers of the binary features that hold."""
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    f = [0, 1 + min(digits, 20), 22 + min(letters, 4), 27 + min(core.count("."), 4)]
    f += [32 + j for j, c in enumerate("@+-(/:%#") if c in core]
    f += [40] * (digits == len(core)) + [41] * (len(core) > 25) + [42] * core.startswith("+")
    f += [43] * ("@" in core and "." in core.rpartition("@")[2])
    f += [44] * all(p.isdigit() and len(p) <= 3 for p in core.split("."))
    if 13 <= digits <= 19 and letters == 0:
        f.append(45 + luhn(only_digits(core)))
    for j, w in enumerate((before, after)):
        w = w.strip(EDGE).lower()
        f.append(47 + 8 * j + (0 if not w else 1 + (sum(map(ord, w)) * 31 + len(w)) % 5 if w.isalpha() else 6 if w.isdigit() else 7))
    return f


def keys(core: str, run: str) -> set[str]:
    """Keys of a word; `run` are its digits after those of the number words just before it."""
    d = only_digits(core)
    return {"w" + core.lower()} | ({"d" + d, "s" + d[-7:]} if len(d) >= 7 else set()) | ({"s" + run[-7:]} if len(run) >= 7 else set())


class Graph:
    """Variables, features and edges of the documents of a slice."""

    def __init__(self) -> None:
        self.doc, self.span, self.feat, self.chain, self.skip = [], [], [], [], []

    def add(self, doc: int, text: str) -> None:
        last: dict[str, int] = {}
        previous, run = None, ""
        for i, a, b, before, after in variables(text):
            v = len(self.doc)
            core = text[a:b]
            self.doc.append(doc)
            self.span.append((a, b))
            self.feat.append(word_features(core, before, after))
            beside = previous is not None and previous[0] == i - 1
            if beside:
                self.chain.append((previous[1], v))
            previous = (i, v)
            number = not any(c.isalpha() or c == "@" for c in core)
            run = ((run if beside else "") + only_digits(core))[-19:] if number else ""
            links = set()
            for k in keys(core, run):
                if k in last:
                    links.add(last[k])
                last[k] = v
            self.skip += [(u, v) for u in links]

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.feat), N_FEATURES), np.float32)
        for i, f in enumerate(self.feat):
            x[i, f] = 1
        return x


def touched(spans: list[tuple[int, int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words x kinds: whether a span of the kind meets each word. Spans of a kind do not overlap, so both their ends ascend."""
    out = np.zeros((len(start), len(KINDS)), bool)
    for k in range(len(KINDS)):
        own = np.array(sorted((a, b) for a, b, kind in spans if kind == k), np.int64).reshape(-1, 2)
        if len(own):
            i = np.searchsorted(own[:, 1], start, "right")
            out[:, k] = (i < len(own)) & (own[np.minimum(i, len(own) - 1), 0] < end)
    return out


def by_document(graph: Graph) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, its variables, their starts and ends)."""
    doc, span = np.array(graph.doc, np.int64), np.array(graph.span, np.int64).reshape(-1, 2)
    parts = np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []
    return [(int(doc[i[0]]), i, span[i, 0], span[i, 1]) for i in parts]


def weak_labels(graph: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """0 for O, 1 + kind for words inside or around a base span (the first in KINDS wins)."""
    y = np.zeros(len(graph.doc), np.int64)
    for d, own, start, end in by_document(graph):
        hit = touched(spans[d], start, end)
        y[own] = np.where(hit.any(1), 1 + hit.argmax(1), 0)
    return y


def sent(pot: np.ndarray, belief: np.ndarray) -> np.ndarray:
    """Messages to the neighbours of edges whose near ends have `belief` without the neighbour's own message."""
    new = np.empty_like(belief)
    for label in range(pot.shape[1]):
        z = belief + pot[:, label]
        top = z.max(1)
        new[:, label] = top + np.log(np.exp(z - top[:, None]).sum(1))
    return new - new.max(1, keepdims=True)


def infer(graph: Graph, model: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Variables x 5 marginals by damped loopy sum-product; a table of potentials for chain edges and one for skip edges."""
    unary = (graph.matrix() @ model["w"]).astype(np.float64)
    kinds = [(np.array(e, np.int64), pot) for e, pot in ((graph.chain, model["chain"]), (graph.skip, model["skip"])) if len(e)]
    forth = [np.zeros((len(e), 5)) for e, _ in kinds]  # messages from an edge's first end to its second one
    back = [np.zeros((len(e), 5)) for e, _ in kinds]

    def beliefs() -> np.ndarray:
        out = unary.copy()
        for (e, _), f, b in zip(kinds, forth, back, strict=True):
            for k in range(5):
                out[:, k] += np.bincount(e[:, 1], f[:, k], len(out)) + np.bincount(e[:, 0], b[:, k], len(out))
        return out

    for _ in range(rounds if kinds else 0):
        belief = beliefs()
        for i, (e, pot) in enumerate(kinds):
            f, b = sent(pot, belief[e[:, 0]] - back[i]), sent(pot.T, belief[e[:, 1]] - forth[i])
            forth[i] = 0.5 * forth[i] + 0.5 * f
            back[i] = 0.5 * back[i] + 0.5 * b
    belief = beliefs()
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(graph: Graph, y: np.ndarray, rounds: int = 300) -> dict | None:
    """Word weights by regularised multinomial regression, edge weights by smoothed log ratios."""
    if not len(y) or not (y > 0).any():
        return None
    unknown = np.zeros(len(y), bool)
    for a, b in graph.skip:
        unknown[a] |= y[a] == 0 and y[b] > 0
        unknown[b] |= y[b] == 0 and y[a] > 0
    x, hot = graph.matrix(), np.eye(5, dtype=np.float32)[y]
    hot[unknown] = x[unknown] = 0
    w = v = np.zeros((N_FEATURES, 5), np.float32)
    step = 4.0 / np.maximum((x * x).sum(1).max(), 1)
    for i in range(rounds):
        z = x @ v
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        nxt = v - step * (x.T @ (p - hot) / len(y) + 1e-4 * v)  # unknown words have no features here
        v = nxt + (i / (i + 3)) * (nxt - w)
        w = nxt
    base = np.bincount(y[~unknown], minlength=5) + 1.0
    base /= base.sum()
    chain = np.full((5, 5), 0.5)
    for a, b in graph.chain:
        chain[y[a], y[b]] += not (unknown[a] or unknown[b])
    chain = np.clip(np.log(chain / chain.sum() / (base[:, None] * base[None])), -1.5, 1.5)
    known = [y[a] == y[b] for a, b in graph.skip if not (unknown[a] or unknown[b])]
    agree = float(np.clip(np.log((sum(known) + 1) / (len(known) - sum(known) + 1)), 0.5, 3.0))
    return {"w": w, "chain": chain, "skip": np.eye(5) * agree}


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    marked = docs.where(F.col("text").rlike("[0-9@]"))
    n = marked.count()
    share = min(1.0, sample / max(n, 1))
    at = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(11))
    picked = marked.select("doc_id", "text", at.alias("at")).where(F.pmod("at", F.lit(1 << 20)) < F.lit(share * (1 << 20)))

    def run(batches):
        for b in batches:
            for text, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                g = Graph()
                g.add(0, text)
                if g.doc:
                    y, n = weak_labels(g, [base_spans(text)]), SAMPLE_WORDS
                    cols = [[at], [g.feat[:n]], *([[list(x) for x in e if max(x) < n]] for e in (g.chain, g.skip)), [y[:n].tolist()]]
                    kinds = [pa.int64()] + [pa.list_(pa.list_(pa.int32()))] * 3 + [pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["at", "feat", "chain", "skip", "y"])

    made = picked.mapInArrow(run, "at long, feat array<array<int>>, chain array<array<int>>, skip array<array<int>>, y array<int>")
    made = cut(made)
    words = made.agg(F.sum(F.size("y")).alias("n")).first()["n"] or 0
    less = min(1.0, SAMPLE_VARIABLES / max(words, 1))
    rows = made.where(F.pmod(F.xxhash64("at"), F.lit(1 << 20)) < F.lit(less * (1 << 20))).orderBy("at").limit(2 * sample).collect()  # about SAMPLE_VARIABLES words at most
    g, y = Graph(), []
    for r in sorted(rows, key=lambda r: (len(r["y"]), r["feat"])):
        at = len(y)
        g.feat += r["feat"]
        g.chain += [(a + at, b + at) for a, b in r["chain"]]
        g.skip += [(a + at, b + at) for a, b in r["skip"]]
        y += r["y"]
    g.doc = [0] * len(y)
    return fit(g, np.array(y, np.int64))


def groups(texts: list[str | None], together: int = TOGETHER) -> list[tuple[int, int]]:
    """Ranges of texts with at most `together` characters, or one text."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > together and i > lo:
            out.append((lo, i))
            lo, size = i, len(t or "")
    return [*out, (lo, len(texts))] if texts else out


def find_spans(texts: list[str | None], model: dict | None, needed: float = NEEDED) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    graph = Graph()
    for i, t in enumerate(texts):
        if t and model and MARK.search(t):
            graph.add(i, t)
    if graph.doc:
        p = infer(graph, model)
        label = p.argmax(1)
        met = np.zeros(len(label), bool)
        for d, own, start, end in by_document(graph):
            met[own] = touched(base[d], start, end).any(1)
        for i in np.flatnonzero((label > 0) & (p.max(1) >= needed)):
            (a, b), d = graph.span[i], graph.doc[i]
            if not met[i]:
                if added[d] and added[d][-1][2] == label[i] - 1 and (graph.doc[i - 1], graph.span[i - 1][1]) == (d, added[d][-1][1]) and not texts[d][added[d][-1][1] : a].strip(" ().-"):
                    a = added[d].pop()[0]
                added[d].append((a, b, int(label[i]) - 1))
    return list(zip(base, added, strict=True))


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def find(docs: DataFrame, sample: int = SAMPLE, needed: float = NEEDED) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    small_batches(docs.sparkSession)
    model = train(docs, sample)

    def run(batches):
        for b in batches:
            rows = []
            texts = b.column(1).to_pylist()
            for lo, hi in groups(texts):
                for base, added in find_spans(texts[lo:hi], model, needed):
                    n = Counter(k for _, _, k in base)
                    rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

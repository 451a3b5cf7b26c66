"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np

from matchloom.llm import langid

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                up[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        least[find(a)].append(i)
    return [(i, len(s), min(least[find(a)])) for a, (i, s) in enumerate(sets)]


def repeated(rows, length):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)] by counting every string."""
    seen, data = defaultdict(int), [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for j in range(len(b) - length + 1):
            seen[b[j : j + length]] += 1
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def align(a, b):
    """Best Smith-Waterman score of two word lists: match 2, mismatch -1, gap -1."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, row[j] - 1))
        best, last = max(best, *row), row
    return best


def line_dedup(rows, ratio=0.05, doubt=1.5):
    """{id: (text, lines, dropped)} of (id, host, text) rows."""
    hosts = {}
    for _, host, text in rows:
        if text is not None:
            hosts.setdefault(host, set()).add(text)
    key = lambda line: line.strip(" \t\n\x0b\f\r")
    gone = set()
    for host, pages in hosts.items():
        seen = {}
        for page in pages:
            for k in {key(line) for line in page.split("\n")} - {""}:
                seen[k] = seen.get(k, 0) + 1
        gone |= {(host, k) for k, n in seen.items() if n - doubt * math.sqrt(n) > ratio * len(pages)}
    out = {}
    for i, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [line for line in lines if (host, key(line)) not in gone]
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def language_counts(text):
    """Bigram and trigram counts of one text, byte by byte, as langid numbers them."""
    raw, out = (text or "").encode(), np.zeros(langid.DIM)
    x = [b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in raw]
    for i in range(1, len(raw)):
        if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E:
            x[i] += 32
    for i in range(len(x)):
        for k, m in ((2, (0x9E37, 0x85EB)), (3, (0x9E37, 0x85EB, 0xC2B3))):
            if i + k <= len(x):
                out[(sum(a * b for a, b in zip(x[i : i + k], m, strict=True)) * 0x2545F491 >> 7) % langid.DIM] += 1
    out = np.sqrt(out)
    return out / max(np.sqrt((out * out).sum()), 1e-9)


def language_probabilities(text, model):
    """Probability of each language of a model by loss-weighted decoding."""
    margin = language_counts(text) @ model["w"][:-1] + model["w"][-1]
    loss = [sum(w * math.log1p(math.exp(-m * b)) for m, b, w in zip(margin, bits, own, strict=True)) * len(bits) for bits, own in zip(model["code"], model["acc"], strict=True)]
    p = np.exp(-np.array(loss))
    return p / p.sum()

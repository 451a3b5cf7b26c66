"""Exact token counts of every prefix of a text, for byte-level merge tokenizers.

For each prefix of a word the last token of its encoding is the one token that ends there and may follow the last token of the
prefix before it: two tokens may be neighbours if merging their joined bytes in rank order gives them back, worked out from the
merges at their common edge, latest first. So one pass from left to right gives the last token and the number of
tokens of every prefix, count[e] = count[e - size of the last token] + 1. What a text costs, where it must be cut for a
budget and what a cut text costs are then looked up, nothing is encoded again.

Texts fall into words by the tokenizer's own pattern, on arrays: runs of letters, digits, other signs and white space, a space before
a run, English endings after an apostrophe, the last white space of a run apart. Classes of characters are asked of the
library, each once a task. A prefix may end inside white space or an ending, where the pattern reads it otherwise than
the whole text; these places are counted as the library counts the cut text. Added tokens written out in a text count 1, as is the
library's default; a prefix that ends within one reads it as plain text.

Words not met before in the task are cut where no token holds the two bytes side by side; parts of one length advance together.
A part above LONG bytes is cut into chunks that advance together as if each began a word; then each chunk's first bytes are done again
with the chunk before as context. Where last tokens agree for as many bytes as the longest token has, they agree from there on, so
only chunks that never agree are done one after the other.

Distribution: a map over whole texts, without a shuffle; the vocabulary is read on the driver and has a fixed size. `path` is a parameter.

Defined results: null and empty texts have 0 tokens and bytes; a very long text is counted whole; repeated rows are counted alike;
ties do not occur (one token fits at each place); an empty table gives an empty result; extra columns are ignored unless named in
`keep`, whatever their names.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import small_batches
from matchloom.llm._text import mix, powers, prefix_hash, ragged, range_hash, spread, text_slices

FILE = "byte_bpe_50k.json"
LIMIT = 512
LONG = 4096
CHUNK = 1024
CELLS = 1 << 20
LETTER, DIGIT, SIGN, SPACE, UNKNOWN = range(5)
FAR = np.int64(1 << 62)
U64 = np.uint64
TABLE = spread(256, 5)


def byte_of() -> dict[str, int]:
    """The byte that each letter of such a vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def merged(raw: bytes, rank: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        r, i = min((rank.get((parts[i], parts[i + 1]), FAR), i) for i in range(len(parts) - 1))
        if r == FAR:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Vocabulary:
    """Tokens that encode to themselves, as arrays in the order of their hashes: sizes, merge ranks and halves."""

    def __init__(self, merges: list[tuple[bytes, bytes]], added: list[str]) -> None:
        rank = {m: r for r, m in enumerate(merges)}
        single = [bytes([b]) for b in range(256)]
        tokens = single + [a + b for a, b in merges if merged(a + b, rank) == [a + b]]
        last = {a + b: (r, a, b) for r, (a, b) in reversed(list(enumerate(merges)))}
        size = np.array([len(t) for t in tokens], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(tokens), np.uint8)
        sums = prefix_hash(data, TABLE)
        keys = range_hash(sums, ends[:-1], ends[1:])
        order = np.argsort(keys)
        self.keys, self.size = keys[order], size[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two tokens have one hash")
        _, down = powers(len(data) + 1)
        self.sums = ((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]])[order]
        number = {tokens[j]: i for i, j in enumerate(order)}
        made = [last.get(tokens[j]) if size[j] > 1 else None for j in order]
        self.rank = np.array([m[0] if m else -1 for m in made], np.int64)
        self.left, self.right = (np.array([number.get(m[h], -1) if m else -1 for m in made], np.int64) for h in (1, 2))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True
        self.lengths = np.unique(size)
        self.longest = int(size.max())
        self.beside = np.zeros((256, 256), bool)
        inner = np.setdiff1d(np.arange(len(data) - 1), ends[1:-1] - 1)
        self.beside[data[inner], data[inner + 1]] = True
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the token with each hash, -1 if there is none."""
        out = np.full(hashes.shape, -1, np.int64)
        at = self.maybe[(hashes >> U64(44)).astype(np.int64)]
        h = hashes[at]
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out[at] = np.where(self.keys[i] == h, i, -1)
        return out

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the tokens of each pair stay apart: no merge across their edge comes before the merges that make them."""
        up, _ = powers(2 * self.longest + 1)
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        limit = np.full(len(left), FAR)
        while len(live):
            size = self.size[left] + self.size[right]
            joined = self.find(mix(self.sums[left] + self.sums[right] * up[self.size[left]] + size.astype(U64) * U64(0xD6E8FEB86659FD93)))
            across = np.where((joined >= 0) & (self.left[joined] == left) & (self.right[joined] == right), self.rank[joined], FAR)
            stay = across >= limit
            ok[live[~stay]] = False
            a, b = self.rank[left], self.rank[right]
            stay &= (a >= 0) | (b >= 0)
            live, left, right, a, b = live[stay], left[stay], right[stay], a[stay], b[stay]
            back = a > b  # the left token was made later, so its merge is undone first
            limit = np.where(back, a, b + 1)
            left, right = np.where(back, self.right[left], left), np.where(back, right, self.left[right])
        return ok


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split = told["pre_tokenizer"]
    plain = not any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or told["normalizer"] or told["model"]["ignore_merges"] or not plain:
        raise ValueError("a byte-level merge tokenizer without a normalizer and with plain added tokens is needed")
    code = byte_of()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
    return Vocabulary([tuple(bytes(code[c] for c in half) for half in m) for m in pairs], [t["content"] for t in told["added_tokens"]])


def fill(words: np.ndarray, voc: Vocabulary, found: np.ndarray, count: np.ndarray, first: int) -> None:
    """Last tokens and counts of the prefixes longer than `first` of rows of bytes (n x L); found and count are n x (L + 1). A row
    begins a word where found[0] is -1; else its first bytes are context."""
    n, size = words.shape
    lens = voc.lengths[voc.lengths <= size]
    up, down = powers(size + 1)
    prefix = np.zeros((n, size + 1), U64)
    np.cumsum(TABLE[words] * up[:-1], axis=1, out=prefix[:, 1:])
    rows = np.arange(n)
    block = max(1, CELLS // (n * len(lens)))
    salt = lens.astype(U64) * U64(0xD6E8FEB86659FD93)
    for e0 in range(first + 1, size + 1, block):
        ends = np.arange(e0, min(e0 + block, size + 1))
        s = ends[:, None] - lens[None]
        at = np.maximum(s, 0)
        own = voc.find(mix((prefix[:, ends][:, :, None] - prefix[:, at]) * down[at] + salt))
        own[:, s < 0] = -1
        for j, e in enumerate(ends):
            r, k = np.nonzero(own[:, j] >= 0)
            token, before = own[r, j, k], found[r, s[j, k]]
            fits = before == -1
            ask = before >= 0
            fits[ask] = voc.neighbours(before[ask], token[ask])
            r, k, token = r[fits], k[fits], token[fits]
            found[r, e] = token
            count[r, e] = count[r, s[j, k]] + 1


def fresh(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.full((n, size + 1), -2, np.int64)  # -2: not known; -1: a word begins here
    found[:, 0] = -1
    return found, np.zeros((n, size + 1), np.int32)


def long_counts(word: np.ndarray, voc: Vocabulary, chunk: int = CHUNK) -> np.ndarray:
    """Counts of all prefixes of one long word."""
    far = voc.longest
    chunk = max(chunk, 4 * far)
    n = -(-len(word) // chunk)
    padded = np.zeros(n * chunk, np.uint8)
    padded[: len(word)] = word
    parts = padded.reshape(n, chunk)
    found, count = fresh(n, chunk)
    step = max(1, CELLS // (chunk * 8))
    for i in range(0, n, step):
        fill(parts[i : i + step], voc, found[i : i + step], count[i : i + step], 0)
    overlap = 3 * far
    tails = found[:, chunk - far :], count[:, chunk - far :]
    f, c = np.full((n - 1, far + overlap + 1), -2, np.int64), np.zeros((n - 1, far + overlap + 1), np.int32)
    f[:, : far + 1], c[:, : far + 1] = tails[0][:-1], tails[1][:-1]
    again = np.concatenate([parts[:-1, chunk - far :], parts[1:, :overlap]], axis=1)
    for i in range(0, n - 1, step):
        fill(again[i : i + step], voc, f[i : i + step], c[i : i + step], far)
    shift = c[:, far + 1 :] - count[1:, 1 : overlap + 1]
    agree = (f[:, -far:] == found[1:, overlap - far + 1 : overlap + 1]).all(1) & (shift[:, -far:] == shift[:, -1:]).all(1)
    out, tail = [count[0]], tails[0][0]
    for i in range(1, n):
        moved = out[-1][chunk - far :] - tails[1][i - 1]
        if agree[i - 1] and (moved == moved[0]).all() and np.array_equal(tail, tails[0][i - 1]):
            own = count[i] + shift[i - 1, -1] + moved[0]
            own[: overlap + 1] = c[i - 1, far:] + moved[0]
            tail = tails[0][i]
        else:
            g, own = np.full((1, far + chunk + 1), -2, np.int64), np.zeros((1, far + chunk + 1), np.int32)
            g[0, : far + 1], own[0, : far + 1] = tail, out[-1][chunk - far :]
            fill(np.concatenate([parts[i - 1, chunk - far :], parts[i]])[None], voc, g, own, far)
            own, tail = own[0, far:], g[0, chunk:]
        out.append(own)
    return np.concatenate([x[1:] for x in out])[: len(word)]


class Store:
    """Counts of all prefixes of the words met in a task, and the classes of the characters met; emptied when it holds more than `most` bytes."""

    def __init__(self, voc: Vocabulary, most: int = 1 << 25) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.voc, self.most, self.library = voc, most, ByteLevel(add_prefix_space=False)
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.counts = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def classes(self, cps: np.ndarray) -> np.ndarray:
        kind = self.kinds[cps]
        if (kind == UNKNOWN).any():
            for c in np.unique(cps[kind == UNKNOWN]).tolist():
                joins = [len(self.library.pre_tokenize_str(x + chr(c))) == 1 for x in "a1!"]
                self.kinds[c] = joins.index(True) if any(joins) else SPACE
            kind = self.kinds[cps]
        return kind

    def look_up(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where the counts of each distinct word begin in `counts`, after adding those that are new."""
        if len(self.counts) > self.most:
            self.clear()
        i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[i] != key if len(self.keys) else np.ones(len(key), bool)
        out = self.start[i] if len(self.keys) else np.zeros(len(key), np.int64)
        if new.any():
            flat, at = word_counts(data, start[new], size[new], self.voc)
            out[new] = at + len(self.counts)
            self.counts = np.concatenate([self.counts, flat])
            keys, begin = np.concatenate([self.keys, key[new]]), np.concatenate([self.start, out[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.start = keys[order], begin[order]
        return out


def word_counts(data: np.ndarray, start: np.ndarray, size: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the prefixes 0..size of every word, one word after the other; where each word's begin)."""
    raw = data[ragged(start, size)]
    ends = np.cumsum(size)
    edge = np.ones(len(raw), bool)  # a part begins
    edge[1:] = ~voc.beside[raw[:-1], raw[1:]]
    edge[(ends - size)[size > 0]] = True
    first = np.flatnonzero(edge)
    long = np.diff(np.append(first, len(raw)))
    sums = prefix_hash(raw, TABLE)
    _, one, inverse = np.unique(range_hash(sums, first, first + long), return_index=True, return_inverse=True)
    at = np.cumsum(long[one]) - long[one]
    counts = np.zeros(int(long[one].sum()) if len(one) else 0, np.int32)  # of prefixes 1.. of each distinct part
    order = np.argsort(long[one], kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(long[one][order])) + 1) if len(order) else []:
        n = int(long[one[group[0]]])
        if n > LONG:
            for g in group:
                counts[at[g] : at[g] + n] = long_counts(raw[first[one[g]] : first[one[g]] + n], voc)
            continue
        step = max(1, CELLS // (n * int((voc.lengths <= n).sum())))
        for lo in range(0, len(group), step):
            own = group[lo : lo + step]
            found, count = fresh(len(own), n)
            fill(raw[first[one[own]][:, None] + np.arange(n)], voc, found, count, 0)
            counts[at[own][:, None] + np.arange(n)] = count[:, 1:]
    each = counts[ragged(at[inverse], long)]
    last = each[first + long - 1] if len(first) else each
    before = np.cumsum(last) - last  # tokens in all parts before, in all words
    total = each + np.repeat(before, long)
    word = np.repeat(np.arange(len(size)), size)
    base = np.zeros(len(size), np.int64)
    full = np.flatnonzero(size > 0)
    base[full] = before[np.searchsorted(first, (ends - size)[full])]
    begin = ends - size + np.arange(len(size))
    flat = np.zeros(len(raw) + len(size), np.int32)
    flat[np.arange(len(raw)) + word + 1] = total - base[word]
    return flat, begin


def words_of(cps: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, first place answered, prefix that counts, whether a two-letter ending) of the words, by place. A word answers for
    the prefixes of the text that end after its first place; `prefix` characters of it are its tokens in the whole text."""
    n = len(cps)
    head = np.zeros(n + 1, bool)
    head[doc] = True
    new = head[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    a = np.flatnonzero(new)
    b = np.append(a[1:], n)
    k = kind[a]
    follows = ~head[b]  # another run of the same text comes next
    gap = k == SPACE
    tail = gap & follows
    taken = tail & (cps[b - 1] == 32)
    shift = np.zeros(len(a), bool)
    shift[1:] = taken[:-1]
    at = lambda i: np.where(i < n, cps[np.minimum(i, n - 1)], 0)
    lone = (k == SIGN) & (b - a == 1) & (cps[a] == 39) & ~shift & follows
    lone[:-1] &= k[1:] == LETTER
    room = np.append(np.diff(np.append(a, n))[1:], 0)  # letters of the next run
    x, y = at(a + 1), at(a + 2)
    eat = np.where(lone & np.isin(x, [115, 116, 109, 100]), 1, 0)
    eat[lone & (room >= 2) & (((y == 101) & np.isin(x, [114, 118])) | ((x == 108) & (y == 108)))] = 2
    eaten = np.zeros(len(a), np.int64)
    eaten[1:] = eat[:-1]
    start = a - shift + eaten
    end = b + eat
    answers = a + eaten
    prefix = np.where(tail, b - 1 - a, end - start)
    keep = start < end
    own = np.flatnonzero(tail & ~taken)  # the last white space of a run, by itself
    order = np.concatenate([2 * np.flatnonzero(keep), 2 * own + 1])
    col = lambda u, v: np.concatenate([u[keep], v])[np.argsort(order, kind="stable")]
    return col(start, b[own] - 1), col(end, b[own]), col(answers, b[own]), col(prefix, np.ones(len(own), np.int64)), col(eat == 2, np.zeros(len(own), bool))


def plain_counts(texts: list[str], store: Store) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the prefixes 1..n of every text, offsets), added tokens read as plain text."""
    size = np.array([len(t) for t in texts], np.int64)
    doc = np.concatenate([[0], np.cumsum(size)])
    whole = "".join(texts)
    if not whole:
        return np.zeros(0, np.int32), doc
    cps = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
    byte = np.concatenate([[0], np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF).astype(np.int64) + (cps > 0xFFFF))])
    start, end, answers, prefix, ending = words_of(cps, store.classes(cps), doc)
    key = range_hash(prefix_hash(data, TABLE), byte[start], byte[end])
    key, one, inverse = np.unique(key, return_index=True, return_inverse=True)
    at = store.look_up(key, data, byte[start[one]], (byte[end] - byte[start])[one])[inverse]
    adds = store.counts[at + byte[start + prefix] - byte[start]]
    base = np.cumsum(adds) - adds
    first = np.searchsorted(start, doc[:-1])  # words of a text before
    before = np.append(base, base[-1] + adds[-1])[first]
    word = np.repeat(np.arange(len(start)), end - answers)
    place = ragged(answers, end - answers) + 1
    out = np.zeros(len(cps), np.int64)
    out[place - 1] = base[word] + store.counts[at[word] + byte[place] - byte[start[word]]]
    out[start[ending] + 1] = base[ending] + 2
    return (out - np.repeat(before, size)).astype(np.int32), doc


def prefix_counts(texts: list[str], store: Store) -> tuple[np.ndarray, np.ndarray]:
    """(counts of the prefixes 1..n of every text, offsets)."""
    added = store.voc.added
    special = [i for i, t in enumerate(texts) if added and added.search(t)]
    if not special:
        return plain_counts(texts, store)
    pieces, plan = [], []
    for i, t in enumerate(texts):
        if i not in set(special):
            plan.append([len(pieces)])
            pieces.append(t)
            continue
        parts, at = [], 0
        for m in added.finditer(t):
            parts.append((len(pieces), m.start() - at, len(m[0])))
            pieces.append(t[at : m.end() - 1])  # the token without its end reads as plain text
            pieces.append(t[at : m.start()])
            at = m.end()
        parts.append((len(pieces), len(t) - at, 0))
        pieces.append(t[at:])
        plan.append(parts)
    flat, doc = plain_counts(pieces, store)
    out = []
    for p in plan:
        if isinstance(p[0], int):
            out.append(flat[doc[p[0]] : doc[p[0] + 1]])
            continue
        base = 0
        for piece, size, extra in p:
            own = flat[doc[piece + bool(extra)] : doc[piece + bool(extra) + 1]]
            out.append(own + base)
            if extra:
                out.append(flat[doc[piece] + size : doc[piece + 1]] + base)
                base += (int(own[-1]) if size else 0) + 1
                out.append(np.array([base], np.int32))
    return np.concatenate(out), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def counted(docs: DataFrame, keep: list[str], path: str, text: str = "text", limit: int = LIMIT, table: bool = False) -> DataFrame:
    """`keep` columns with n_bytes, n_tokens, over_limit (more than `limit` tokens), keep_chars (characters of the longest prefix
    of at most `limit` tokens) and, with `table`, counts: the token counts of the prefixes of 0, 1, .. characters."""
    small_batches(docs.sparkSession)
    voc = load(path)

    def run(batches):
        store = Store(voc)
        for b in batches:
            for lo, hi, data, offs in text_slices(b, text):
                raw = data.tobytes()
                texts = [raw[x:y].decode("utf-8") for x, y in zip(offs[:-1], offs[1:], strict=True)]
                flat, at = prefix_counts(texts, store)
                size = np.diff(at)
                n = np.where(size > 0, flat[np.maximum(at[1:] - 1, 0)] if len(flat) else 0, 0).astype(np.int64)
                fits = np.where(flat <= limit, np.arange(1, len(flat) + 1), 0)
                best = np.zeros(hi - lo, np.int64)
                full = np.flatnonzero(size)
                if len(full):
                    best[full] = np.maximum(np.maximum.reduceat(fits, at[full]) - at[full], 0)
                out = [b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep] + [pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit), pa.array(best)]
                if table:
                    with_zero = np.insert(flat, at[:-1], 0)
                    out.append(pa.ListArray.from_arrays(pa.array((at + np.arange(len(at))).astype(np.int32)), pa.array(with_zero)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*keep, "n_bytes", "n_tokens", "over_limit", "keep_chars", *(["counts"] if table else [])]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, n_tokens long, over_limit boolean, keep_chars long", *(["counts array<int>"] if table else [])])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def tokens_within(counts: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters."""
    return F.get(counts, F.least(chars, F.size(counts) - 1))


def longest_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most `budget` tokens."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))

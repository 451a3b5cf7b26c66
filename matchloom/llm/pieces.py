"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text gets a leading space, spaces become the space piece, and it falls into words at the start of each run of spaces
(no piece has that character after another one, which is checked, so no piece crosses words and a text's segmentation
is that of its words). Words not met before in the task are grouped by length; those of one length advance together:
hashes of all their substrings up to the longest piece probe the sorted hashes of the pieces, and a maximum over piece
lengths at each position stores the backpointer. A character without a piece becomes its UTF-8 byte pieces.

A unigram model maximises the sum of piece scores. A model of type BPE (its scores are whole merge ranks) scores a
candidate 1 if it may follow the best piece before it and 0 otherwise; two pieces may be neighbours if merging their
joined text in rank order gives them back, which is worked out from the merges at their common edge, latest first. Just
one candidate passes at each position, so the backpointers give the merge order's own segmentation, the library's ids.

A word above WHOLE characters is cut where no piece holds the two characters side by side, so a text without spaces falls into parts that
advance together too. With merge ranks a part above LONG is cut into chunks that advance as if each began a word; each chunk's
first characters are done again with the chunk before as context, and where the pieces found agree for as many characters as the
longest piece has, they agree from there on. Only chunks that never agree are done one after the other. In a unigram model such a part
is one row, in steps of one character.

Decoding is the exact inverse for every text: a space character of the model that stands in the text itself is written
in byte pieces (the library would turn it into a space).

Distribution: a map over whole texts, without a shuffle; the model is read on the driver and has a fixed size. Its path is a
parameter, or the session's setting spark.matchloom.tokenizer, or MODEL.

Defined results: null and empty texts have no tokens (decoding gives an empty text); a very long text is encoded whole, words
of one length in tables of at most CELLS cells; of segmentations with equal scores the one with the shorter last piece counts
(with merge ranks there are none); repeated rows are encoded alike; an empty table gives an empty result; extra columns are
ignored unless named in `keep`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm._spark import small_batches
from matchloom.llm._text import mix, ragged, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
LITERAL = 0x110000  # stands for a SPACE that the text itself has; beyond Unicode
SLICE = 1 << 20
CELLS = 1 << 20
WHOLE = 64
LONG = 4096
CHUNK = 1024
U64 = np.uint64


FAR = np.int64(1 << 62)


def merge(text: str, rank: dict[str, int]) -> list[tuple[str, str, str]]:
    """Symbols left after merging in rank order, leftmost first among equals, each with the halves of its last merge."""
    parts = [(c, "", "") for c in text]
    while len(parts) > 1:
        r, i = min((rank.get(parts[i][0] + parts[i + 1][0], FAR), i) for i in range(len(parts) - 1))
        if r == FAR:
            break
        x, y = parts[i][0], parts[i + 1][0]
        parts[i : i + 2] = [(x + y, x, y)]
    return parts


class Model:
    """Piece tables as arrays: hashes in order, ids, scores, merge ranks and halves, and the bytes of each piece."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], special: set[int]) -> None:
        normal = [i for i in range(len(pieces)) if i not in special and pieces[i]]
        if any(chr(SPACE) in pieces[i].lstrip(chr(SPACE)) for i in normal):
            raise ValueError("a piece has a space after another character")
        self.bpe = all(float(scores[i]).is_integer() for i in normal)
        level = {x: r for r, x in enumerate(sorted({-scores[i] for i in normal}))}
        self.rank_of = {pieces[i]: level[-scores[i]] for i in normal}
        halves = {}
        if self.bpe:
            halves = {i: m[0] for i in normal if len(m := merge(pieces[i], self.rank_of)) == 1}
            normal = list(halves)  # a piece that no merge makes is never used
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        hashes = np.array([self.string_hash(pieces[i]) for i in normal], U64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> U64(44)).astype(np.int64)] = True
        self.ids = np.array(normal, np.int32)[order]
        self.scores = np.array([scores[i] for i in normal])[order]
        self.unknown = float(self.scores.min() - 10) if normal else -10.0
        own = [pieces[i] for i in self.ids]
        number = {p: k for k, p in enumerate(own)}
        self.rank = np.array([self.rank_of[p] if len(p) > 1 else -1 for p in own], np.int64)
        self.left, self.right = (np.array([number.get(halves[i][h], -1) if i in halves and halves[i][h] else -1 for i in self.ids], np.int64) for h in (1, 2))
        self.sums = np.array([self.string_sum(p) for p in own], U64)
        self.chars = np.array([len(p) for p in own], np.int64)
        self.ups = ups(2 * self.longest + 1)
        self.beside = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[:-1] << 32 | c[1:] for c in (np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.int64) for p in own)]]))
        self.bytes = np.array([byte_ids[b] for b in range(256)], np.int32)
        raw = [b""] * len(pieces)
        for i in normal:
            raw[i] = pieces[i].replace(chr(SPACE), " ").encode()
        for b, i in byte_ids.items():
            raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 if there is none; a bitmap of hash prefixes spares most binary searches."""
        out = np.full(hashes.shape, -1, np.int64)
        at = self.maybe[(hashes >> U64(44)).astype(np.int64)]
        h = hashes[at]
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        out[at] = np.where(self.keys[i] == h, i, -1)
        return out

    def neighbours(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays apart: no merge across their edge comes before the merges that make them."""
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        limit = np.full(len(left), FAR)
        while len(live):
            size = self.chars[left] + self.chars[right]
            joined = self.find(mix(self.sums[left] + self.sums[right] * self.ups[self.chars[left]] + size.astype(U64)))
            across = np.where(joined >= 0, self.rank[joined], FAR)
            stay = across >= limit
            ok[live[~stay]] = False
            a, b = self.rank[left], self.rank[right]
            stay &= (a >= 0) | (b >= 0)
            live, left, right, a, b = live[stay], left[stay], right[stay], a[stay], b[stay]
            back = a > b  # the left piece was made later, so its merge is undone first
            limit = np.where(back, a, b + 1)
            left, right = np.where(back, self.right[left], left), np.where(back, right, self.left[right])
        return ok

    def apart(self, cps: np.ndarray) -> np.ndarray:
        """Where no piece holds a character and the next one side by side."""
        pair = cps[:-1].astype(np.int64) << 32 | cps[1:]
        i = np.minimum(np.searchsorted(self.beside, pair), max(len(self.beside) - 1, 0))
        return self.beside[i] != pair if len(self.beside) else np.ones(len(pair), bool)

    @staticmethod
    def code_values(cps: np.ndarray) -> np.ndarray:
        return mix(cps.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1)) | U64(1)

    @classmethod
    def string_sum(cls, s: str) -> int:
        return int((cls.code_values(np.frombuffer(s.encode("utf-32-le"), np.uint32)) * ups(len(s))).sum(dtype=U64))

    @classmethod
    def string_hash(cls, s: str) -> int:
        return int(mix(np.array([cls.string_sum(s)], U64) + U64(len(s)))[0])


def ups(n: int) -> np.ndarray:
    p = np.full(max(n, 1), 0xD1342543DE82EF95, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)[:n]


def downs(n: int) -> np.ndarray:
    p = np.full(max(n, 1), pow(0xD1342543DE82EF95, -1, 1 << 64), dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)[:n]


def load(path: str = MODEL) -> Model:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
    special = {i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
    return Model(pieces, [m.get_score(i) for i in range(n)], byte_ids, special)


def advance(words: np.ndarray, model: Model, best: np.ndarray, back: np.ndarray, found: np.ndarray, first: int = 0) -> None:
    """Best score, backpointer and last piece of the prefixes longer than `first` of rows of code points."""
    n, size = words.shape
    most = min(model.longest, size)
    up, down = ups(size), downs(size + 1)
    prefix = np.zeros((n, size + 1), U64)
    np.cumsum(Model.code_values(words) * up, axis=1, out=prefix[:, 1:])
    rows = np.arange(n)
    block = max(1, CELLS // (n * most))
    for e0 in range(first + 1, size + 1, block):
        ends = np.arange(e0, min(e0 + block, size + 1))
        lens = np.arange(1, most + 1)
        s = ends[:, None] - lens[None]
        at = np.maximum(s, 0)
        piece = np.full((n, len(ends), most), -1, np.int64)
        inside = s >= 0
        piece[:, inside] = model.find(mix((prefix[:, ends][:, :, None] - prefix[:, at])[:, inside] * down[at[inside]] + np.broadcast_to(lens, s.shape)[inside].astype(U64)))
        for j, e in enumerate(ends):
            own = piece[:, j]
            if model.bpe:
                score = np.where(own >= 0, lens / 100, -np.inf)
                before = found[:, at[j]]
                ask = (own >= 0) & (before >= 0) & (s[j] > 0)
                score[ask] += model.neighbours(before[ask], own[ask]) - 1.0
                total = score
            else:
                total = best[:, at[j]] + np.where(own >= 0, model.scores[own], -np.inf)
            lone = own[:, 0] < 0
            total[lone, 0] = (0.0 if model.bpe else best[lone, e - 1] + model.unknown)
            k = total.argmax(1)
            best[:, e] = total[rows, k]
            back[:, e] = k + 1
            found[:, e] = own[rows, k]


def tables(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    return best, np.zeros((n, size + 1), np.int16), np.full((n, size + 1), -1, np.int64)


def in_chunks(word: np.ndarray, model: Model, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of one long word under merge ranks, from chunks."""
    far = model.longest
    chunk = max(chunk, 4 * far)
    n = -(-len(word) // chunk)
    parts = np.zeros((n, chunk), word.dtype)
    parts.ravel()[: len(word)] = word
    local = tables(n, chunk)
    step = max(1, CELLS // (chunk * 8))
    for i in range(0, n, step):
        advance(parts[i : i + step], model, *(t[i : i + step] for t in local))
    over = 3 * far

    def redo(found: np.ndarray, before: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same pieces after a context of `far` characters whose last pieces are `found`."""
        again = tables(len(own), far + own.shape[1])
        again[2][:, : far + 1] = found
        advance(np.concatenate([before, own], axis=1), model, *again, first=far)
        return tuple(t[:, far:] for t in again)

    start = redo(local[2][:-1, chunk - far :], parts[:-1, chunk - far :], parts[1:, :over])
    agree = (start[2][:, over - far + 1 :] == local[2][1:, over - far + 1 : over + 1]).all(1)
    out = [[t[0] for t in local]]
    for i in range(1, n):
        if agree[i - 1] and np.array_equal(out[-1][2][chunk - far :], local[2][i - 1, chunk - far :]):
            out.append([np.concatenate([s[i - 1], t[i, over + 1 :]]) for s, t in zip(start, local, strict=True)])
        else:
            out.append([t[0] for t in redo(out[-1][2][None, chunk - far :], parts[i - 1 : i, chunk - far :], parts[i : i + 1])])
    return tuple(np.concatenate([out[0][k][:1], *[o[k][1:] for o in out]])[None, : len(word) + 1] for k in range(3))


def viterbi(words: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """words: n x L code points. Returns n x L piece ids, right-aligned, and counts; an unknown code point c is -c - 1."""
    n, size = words.shape
    if n == 1 and size > LONG and model.bpe:
        best, back, found = in_chunks(words[0], model)
    else:
        best, back, found = tables(n, size)
        advance(words, model, best, back, found)
    out = np.zeros((n, size), np.int64)
    counts = np.zeros(n, np.int64)
    pos = np.full(n, size)
    live = np.arange(n)
    while len(live):
        p = pos[live]
        ids = found[live, p]
        unknown = ids < 0
        ids = model.ids[ids].astype(np.int64)
        ids[unknown] = -words[live[unknown], p[unknown] - 1].astype(np.int64) - 1
        counts[live] += 1
        out[live, size - counts[live]] = ids
        pos[live] = p - back[live, p]
        live = live[pos[live] > 0]
    return out, counts


def encode_words(cps: np.ndarray, start: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words one after the other, and each word's count."""
    if not (size > WHOLE).any():
        return encode_parts(cps, start, size, model)
    firsts = [np.concatenate([[0], np.flatnonzero(model.apart(cps[a : a + n])) + 1]) if n > WHOLE else np.zeros(1, np.int64) for a, n in zip(start, size, strict=True)]
    many = np.array([len(f) for f in firsts])
    at = np.concatenate(firsts) + np.repeat(start, many)
    ends = np.append(at[1:], 0)
    last = np.cumsum(many) - 1
    ends[last] = start + size
    ids, counts = encode_parts(cps, at, ends - at, model)
    return ids, np.add.reduceat(counts, last - many + 1)


def encode_parts(cps: np.ndarray, start: np.ndarray, size: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """encode_words for parts that no piece crosses."""
    counts = np.zeros(len(start), np.int64)
    parts, owners = [], []
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        long = int(size[group[0]])
        step = max(1, CELLS // (long * min(model.longest, long))) if long <= LONG or not model.bpe else 1
        for lo in range(0, len(group), step):
            own = group[lo : lo + step]
            out, n = viterbi(cps[start[own][:, None] + np.arange(long)], model)
            flat = out[np.arange(long)[None] >= long - n[:, None]]
            who = np.repeat(own, n)
            bad = np.flatnonzero(flat < 0)
            if len(bad):
                chars = [chr(SPACE if (c := int(-flat[i] - 1)) == LITERAL else c).encode("utf-8", "surrogatepass") for i in bad]
                grow = np.ones(len(flat), np.int64)
                grow[bad] = [len(c) for c in chars]
                first = (np.cumsum(grow) - grow)[bad]
                flat, who = np.repeat(flat, grow), np.repeat(who, grow)
                flat[ragged(first, grow[bad])] = model.bytes[np.frombuffer(b"".join(chars), np.uint8)]
            parts.append(flat.astype(np.int32))
            owners.append(who)
    if not parts:
        return np.zeros(0, np.int32), counts
    flat, who = np.concatenate(parts), np.concatenate(owners)
    counts += np.bincount(who, minlength=len(start))
    at = np.argsort(who, kind="stable")
    return flat[at], counts


class Store:
    """Ids of the words met in a task; emptied when it holds more than `most` words."""

    def __init__(self, model: Model, most: int = 1 << 20) -> None:
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.where = np.zeros(0, U64), np.zeros(0, np.int64)
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, key: np.ndarray, cps: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers in the store of distinct words given by their keys, encoding those that are new."""
        if len(self.keys) > self.most:
            self.clear()
        i = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[i] != key if len(self.keys) else np.ones(len(key), bool)
        out = self.where[i] if len(self.keys) else np.zeros(len(key), np.int64)
        if new.any():
            ids, counts = encode_words(cps, start[new], size[new], self.model)
            out[new] = len(self.start) + np.arange(len(counts))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
            self.count = np.concatenate([self.count, counts])
            self.ids = np.concatenate([self.ids, ids])
            keys, where = np.concatenate([self.keys, key[new]]), np.concatenate([self.where, out[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.where = keys[order], where[order]
        return out


def encode_texts(data: np.ndarray, offs: np.ndarray, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the rows of UTF-8 bytes."""
    n = len(offs) - 1
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8") for a, b in zip(offs[:-1], offs[1:], strict=True)]
    lens = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    cps = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    if not len(cps):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    cps[cps == SPACE] = LITERAL
    cps[cps == 32] = SPACE
    doc = np.concatenate([[0], np.cumsum(lens)])
    gap = cps == SPACE
    new = gap.copy()
    new[1:] &= ~gap[:-1]
    new[doc[:-1][lens > 0]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(cps)))
    prefix = np.zeros(len(cps) + 1, U64)
    np.cumsum(Model.code_values(cps) * ups(len(cps)), out=prefix[1:])
    key = mix((prefix[start + size] - prefix[start]) * downs(len(cps))[start] + size.astype(U64))
    key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    word = store.look_up(key, cps, start[first], size[first])[inverse]
    count = store.count[word]
    total = np.concatenate([[0], np.cumsum(count)])
    return store.ids[ragged(store.start[word], count)], total[np.searchsorted(start, doc)]


def decode_ids(ids: np.ndarray, offs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each row of ids; the leading space is taken off. Control pieces have no bytes."""
    size = model.size[ids]
    data = model.blob[ragged(model.start[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[offs]
    keep = np.ones(len(data), bool)
    lead = ends[:-1][(np.diff(ends) > 0)]
    lead = lead[data[lead] == 32]
    keep[lead] = False
    return data[keep], ends - np.searchsorted(lead, ends)


def session_model(docs: DataFrame, path: str | None) -> Model:
    """The model at `path`, or where the session says, or at MODEL."""
    return load(path or docs.sparkSession.conf.get("spark.matchloom.tokenizer", MODEL))


def encode(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """`keep` columns with n_tokens, ids, round_trip (whether decoding gives the text's bytes back)."""
    small_batches(docs.sparkSession)
    model = session_model(docs, path)

    def run(batches):
        store = Store(model)
        for b in batches:
            for lo, hi, data, offs in text_slices(b, limit=SLICE):
                ids, at = encode_texts(data, offs, store)
                back, ends = decode_ids(ids, at, model)
                whole = np.array_equal(back, data) and np.array_equal(ends, offs)
                same = np.ones(hi - lo, bool) if whole else np.array([np.array_equal(back[ends[i] : ends[i + 1]], data[offs[i] : offs[i + 1]]) for i in range(hi - lo)], bool)
                out = [b.column(b.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same)], names=[*keep, "n_tokens", "ids", "round_trip"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, ids array<int>, round_trip boolean"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def decode(tokens: DataFrame, keep: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """`keep` columns with the decoded text; null ids give an empty text, bytes that are no UTF-8 become U+FFFD."""
    small_batches(tokens.sparkSession)
    model = session_model(tokens, path)

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(ids))
            rows = [np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in col]
            at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            data, ends = decode_ids(np.concatenate([np.zeros(0, np.int64), *rows]), at, model)
            raw = data.tobytes()
            text = [raw[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(text, pa.string())], names=[*keep, "text"])

    kinds = {f.name: f.dataType.simpleString() for f in tokens.schema}
    return tokens.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"]))

"""Language ID by error-correcting output codes.

Each language has a codeword of +1/-1 bits; a binary classifier over hashed byte bigrams and trigrams predicts each bit.
Up to seven languages get the exhaustive code (2**(L-1) - 1 bits); more get the best of seeded random codes. A text is
decoded to the codeword with the least weighted logistic loss, each bit weighted by its classifier's accuracy on that
language (loss-weighted decoding), measured on every fourth sampled row with classifiers fitted on the others. The decision is
ambiguous if the two nearest codewords are closer than `gap` in probability.

Fitting: about `per_language` labelled rows of each language, chosen by a hash of doc_id and text (a documented bound; the
features have a fixed size, so the driver gets at most languages x 2 x per_language x DIM half floats, whatever the ids).
Prediction is one map over whole texts with a model of DIM x bits weights, a size set by parameters.

Defined results: a null text or one without a letter is `und` with score 0 and is not ambiguous; with no labelled rows
every text is `und`; with one language that one is predicted; of equally near languages the first in order of name is
predicted; a very long text is read whole, as one row of counts; repeated rows are predicted alike; an empty table gives an
empty result; extra columns are ignored unless named in `keep`, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm._spark import small_batches
from matchloom.llm._text import text_slices

DIM = 4096
SLICE = 1 << 18  # bytes of texts whose counts are held at once
MOST_ROWS = 10_000  # of all languages, some 160 MB; twice as many at most
PER_LANGUAGE = 400
GAP = 0.2
ROUNDS = 150


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def letter_table() -> np.ndarray:
    """Lower-cases A-Z, keeps letters and non-ASCII bytes, makes the rest a space."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows x DIM: square roots of hashed bigram and trigram counts, scaled to length one."""
    n = len(offs) - 1
    x = letter_table()[data].astype(np.int64)
    if len(x):
        upper = np.zeros(len(x), bool)
        upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        x[upper] += 32
    row = np.repeat(np.arange(n), np.diff(offs)) * DIM
    counts = np.zeros(n * DIM, np.float32)
    for k, m in ((2, (0x9E37, 0x85EB)), (3, (0x9E37, 0x85EB, 0xC2B3))):
        if len(x) < k:
            continue
        size = len(x) - k + 1
        g = np.zeros(size, np.int64)
        for j in range(k):
            g += x[j : j + size] * m[j]
        g = (g * 0x2545F491) >> 7 & (DIM - 1)
        ok = row[:size] == row[k - 1 :]
        counts += np.bincount((row[:size] + g)[ok], minlength=n * DIM)
    counts = np.sqrt(counts.reshape(n, DIM))
    norm = np.sqrt((counts * counts).sum(1, keepdims=True))
    return counts / np.maximum(norm, 1e-9)


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128), out=letter[1:])
    out = letter[offs[1:]] > letter[offs[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1; no two bits are equal or opposite where the exhaustive code is used."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        return np.array([[1] * n, *([1, *c] for c in itertools.product((1, -1), repeat=n - 1) if -1 in c)][1:], np.float32).T
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (n, 8 * int(np.ceil(np.log2(n)))))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = code.shape[1] - code @ code.T
        np.fill_diagonal(apart, 1e9)
        if apart.min() > most:
            best, most = code, apart.min()
    return best


def weights(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(DIM + 1) x bits logistic weights by accelerated gradient steps, rows weighted so that languages count alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = (1 / np.bincount(y, minlength=len(code)).clip(1))[y][:, None].astype(np.float32) / len(code)
    target = code[y]
    w = v = np.zeros((x.shape[1], code.shape[1]), np.float32)
    for i in range(rounds):
        z = (x @ v) * target
        grad = -(x.T @ (target * weight / (1 + np.exp(np.clip(z, -30, 30))))) + 1e-6 * v
        nxt = v - 2.0 * grad
        v = nxt + (i / (i + 3)) * (nxt - w)
        w = nxt
    return w


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from all rows; and each language's bit weights, from every fourth row by weights of the others."""
    held = np.arange(len(x)) % 4 == 3
    acc = np.ones(code.shape, np.float32)
    if held.any():
        w = weights(x[~held], y[~held], code, rounds // 3)
        right = (np.sign(x[held] @ w[:-1] + w[-1]) == code[y[held]]).astype(np.float32)
        for c in range(len(code)):
            mine = right[y[held] == c]
            acc[c] = (mine.sum(0) + 1) / (len(mine) + 1)
    return weights(x, y, code, rounds), acc / acc.sum(1, keepdims=True)


def decode(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows x languages probabilities from the weighted logistic losses."""
    loss = np.stack([(np.logaddexp(0, -margins * code[c]) * weights[c]).sum(1) for c in range(len(code))], 1) * code.shape[1]
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """Fits on a bounded sample of the rows of `docs` (text, lang, doc_id) that have both; held-out rows must be gone already."""
    small_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs = sorted(counts)
    if not langs:
        return {"langs": [], "code": None}
    per_language = max(1, min(per_language, MOST_ROWS // len(langs)))
    code = codewords(len(langs))
    if len(langs) == 1:
        return {"langs": langs, "code": code, "w": np.zeros((DIM + 1, 1), np.float32), "acc": np.ones((1, 1), np.float32)}
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, per_language / counts[k]))])
    rows = rows.withColumn("at", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(5)))
    picked = rows.where(F.pmod("at", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("at", "text", "lang")

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in text_slices(b, limit=SLICE):
                f = features(data, offs).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in f], pa.binary())], names=["at", "lang", "f"])

    made = picked.mapInArrow(run, "at long, lang string, f binary")
    got = made.orderBy("at").limit(2 * per_language * len(langs)).collect()  # bounded, should many rows have one hash
    x = np.frombuffer(b"".join(r["f"] for r in got), np.float16).reshape(-1, DIM).astype(np.float32)
    y = np.array([langs.index(r["lang"]) for r in got])
    w, acc = fit(x, y, code)
    return {"langs": langs, "code": code, "w": w, "acc": acc}


def predict(docs: DataFrame, model: dict, keep: list[str], gap: float = GAP, text: str = "text") -> DataFrame:
    """`keep` columns of every row with lang_pred, score, ambiguous."""
    langs, code = np.array(model["langs"] or ["und"], object), model["code"]

    def run(batches):
        for b in batches:
            for lo, hi, data, offs in text_slices(b, text, SLICE):
                n = hi - lo
                ok = has_letter(data, offs)
                if code is None:
                    ok[:] = False
                    best, score, vague = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
                elif len(langs) == 1:
                    best, score, vague = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
                else:
                    p = decode(features(data, offs) @ model["w"][:-1] + model["w"][-1], code, model["acc"])
                    best = p.argmax(1)
                    top = np.sort(p, 1)
                    score, vague = top[:, -1].astype(float), top[:, -1] - top[:, -2] < gap
                lang = np.where(ok, langs[best], "und")
                out = [b.column(b.schema.get_field_index(c)).slice(lo, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*out, pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(vague & ok)], names=[*keep, "lang_pred", "score", "ambiguous"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, ambiguous boolean"])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, gap: float = GAP) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learns from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))), per_language)
    return predict(docs, model, ["doc_id"], gap).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")

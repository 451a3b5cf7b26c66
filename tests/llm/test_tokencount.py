import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import tokencount

PATH = public_tokenizers.path(tokencount.FILE)
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def voc():
    return tokencount.load(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


ALPHABET = st.sampled_from([*"abdeinorstThLN.,;()=\n\t\r\x1c\x85 \"'17", " ", "  ", "     ", "é", "中", "😀", "ing", "tion", "'s", "'re", "'ll", "'d", " 've", " ", "　", "٣", "՘", "Ᲊ", SPECIAL, "<|endof", "|>"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=5))
def test_every_prefix_costs_what_the_library_says(voc, library, texts):
    flat, at = tokencount.prefix_counts(texts, tokencount.Store(voc))
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == [library(t[:j]) for j in range(1, len(t) + 1)]


@pytest.mark.parametrize("kind", ["letters", "one letter", "period", "words", "signs", "scripts"])
def test_long_words_are_exact_and_quick(voc, library, kind):
    rng = random.Random(kind)
    text = {
        "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDE") for _ in range(100_000)),
        "one letter": "a" * 30_000,
        "period": "abcde" * 6_000,
        "words": "".join(rng.choice(["hello", "world", "inter", "nation", "al"]) for _ in range(12_000)),
        "signs": "=" * 9001 + "-" * 8192,
        "scripts": "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(30_000)),
    }[kind]
    began = time.time()
    flat, _ = tokencount.prefix_counts([text], tokencount.Store(voc))
    assert time.time() - began < 30
    places = [1, 1023, 1024, 1025, 1400, 2048, 2049, 4097, len(text) - 1, len(text), *(rng.randint(1, len(text)) for _ in range(6))]
    assert [int(flat[p - 1]) for p in places] == [library(text[:p]) for p in places]


def test_texts_with_clashing_columns_nulls_and_questions_about_budgets(spark, texts, library):
    rows = [(1, None), (2, ""), (3, "It's the  end\n\n of   the world"), (3, "It's the  end\n\n of   the world"), (None, f"a{SPECIAL} b{SPECIAL}"), (5, "word " * 900), (6, " \n" * 700)]
    got = tokencount.counted(texts(rows), ["doc_id"], PATH, table=True).withColumns({"at9": tokencount.tokens_within(F.col("counts"), F.lit(9)), "fits": tokencount.longest_within(F.col("counts"), F.lit(4))}).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_bytes"])), sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode()))), strict=True):
        t = t or ""
        want = [library(t[:j]) for j in range(len(t) + 1)]
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (i, len(t.encode()), want[-1], want[-1] > 512)
        assert list(r["counts"]) == want
        assert r["keep_chars"] == max(j for j, n in enumerate(want) if n <= 512)
        assert r["at9"] == want[min(9, len(t))] and r["fits"] == max(j for j, n in enumerate(want) if n <= 4)


def test_empty_tables(spark):
    assert tokencount.counted(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], PATH).count() == 0


def test_part_cuts_change_nothing(voc):
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 105, 30).astype(np.uint8)) for _ in range(50)]
    data = np.frombuffer(b"".join(words), np.uint8)
    start = np.arange(50) * 30
    flat, at = tokencount.word_counts(data, start, np.full(50, 30), voc)
    whole = [tokencount.fresh(1, 30) for _ in words]
    for i, w in enumerate(words):
        tokencount.fill(np.frombuffer(w, np.uint8)[None], voc, *whole[i], 0)
        assert flat[at[i] : at[i] + 31].tolist() == whole[i][1][0].tolist()

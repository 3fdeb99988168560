import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidepanel.llm import byte_bpe

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe._ranks(byte_bpe.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_and_exact_round_trip(spark, library):
    rng = random.Random(3)
    letters = "ab's'tredvlm  \n\t'19é!?’ 　世Ⅷ\x1c\r."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", None, "'s", "''s", " 's", "\n's", "'lls", "don't've", "x  'd", " ", "  ", "end \n ", "a" * 20_000, "<|endoftext|>", "é" * 999]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for r in byte_bpe.decode(byte_bpe.encode(df, stretch=5000)).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text), text
        assert bytes(r.decoded) == text.encode()
        assert [text[a:b] for a, b in zip(r.piece_offsets, r.piece_offsets[1:] + [len(text)])] == [
            x for x in pieces(text)
        ]


def pieces(text):
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


def test_scan_equals_stepwise_automaton():
    rng = np.random.default_rng(0)
    of_class, product, from_start, _ = byte_bpe._automaton()
    kinds = rng.integers(0, 2 * byte_bpe.FRESH, 5000)
    state, want = byte_bpe.DONE, []
    for k in kinds:
        state = byte_bpe._step(state, int(k))[0]
        want.append(state)
    assert from_start[byte_bpe._scan(of_class[kinds], product)].tolist() == want


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", ""), (1, "a b", ""), (1, "a b", ""), (2, None, "")], SCHEMA)
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df))).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2, 2, 2]
    assert byte_bpe.encode(spark.createDataFrame([], SCHEMA)).collect() == []

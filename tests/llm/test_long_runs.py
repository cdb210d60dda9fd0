"""Very long runs of one kind of character, and characters whose class changed between Unicode versions, against the library."""

import zlib

import numpy as np
import pytest

from lodeseek.llm import bpe_count, packing, token_files
from lodeseek.llm.queries import tokenizer

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
RUNS = [" " * 2_000_000, "\n" * 2_000_000, "x" + " \n\t" * 500_000 + "y", "ab" * 1_000_000]
RARE = ["Ω౜", "р֋", "Ñ₏", "࡜₝", "꭬롇", "Ᲊx", "a͸b", "\U0001e6c0 \U00010d40"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(RUNS + RARE)), "doc_id long, text string").repartition(4)


@pytest.fixture(scope="module")
def ids():
    lib = tokenizers.Tokenizer.from_file(BYTE)
    return [lib.encode(t, add_special_tokens=False).ids for t in RUNS + RARE]


def test_packing(docs, ids):
    got = packing.pack(docs, BYTE).collect()
    for i, own in enumerate(ids):
        own = np.array([*own, 1], "<u4")
        mine = sorted((x.start, x.length, x.ids_crc32) for x in got if x.doc_id == i)
        assert mine == [(k, len(p), zlib.crc32(p.tobytes())) for k in range(0, len(own), 2048) for p in [own[k : k + 2048]]]


def test_token_files(docs, ids):
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in token_files.round_trip(docs, BYTE).collect()}
    assert got == {i: (len(own) + 1, zlib.crc32(np.array([*own, 2], "<u4").tobytes())) for i, own in enumerate(ids)}


def test_token_counts(docs):
    lib = tokenizers.Tokenizer.from_file(WORD)
    got = {x.doc_id: x.n_tokens for x in bpe_count.token_counts(docs, WORD).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(RUNS + RARE)}


def test_counts_of_all_code_points():
    own, lib = bpe_count.counter(WORD), tokenizers.Tokenizer.from_file(WORD)
    for base in range(0, 0x110000, 128):
        if 0xD800 <= base < 0xE000:
            continue
        text = "".join(f"a{chr(x)}{chr(x)}b {chr(x)}1" for x in range(base, base + 128))
        assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids), hex(base)

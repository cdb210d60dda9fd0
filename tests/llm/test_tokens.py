import random
import zlib

import numpy as np
import pytest

from lodeseek.llm import bpe_count, packing, token_files
from lodeseek.llm.queries import tokenizer
from lodeseek.llm.succinct import WaveletMatrix
from lodeseek.llm.tokens import byte_bpe

tokenizers = pytest.importorskip("tokenizers")
BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
TEXTS = [
    "The cat sat on the mat.\nIt's  what we'd say, isn't it?",
    "",
    None,
    " ",
    "Übergröße ça va, ¿qué tal? ½ ²³ 12345",
    "a <|endoftext|> b <|startoftext|>c",
    "中文 and ελληνικΣ ΣΟΦΟΣ İstanbul é   \x85x\x1cy",
    "x" * 5000,
    "long words " * 3000,
    "🙂🙃 fi ﬁ\x00\x0b\x0c",
]


def fuzz(n):
    r = random.Random(n)
    chars = [chr(i) for i in [9, 10, 13, *range(32, 127), *range(0xA0, 0x180), 0x2013, 0x2019, 0x201C, 0x2026, 0x85, 0x3000, 0x4E2D, 0x301, 0x3A3, 0x1F600]]
    return ["".join(r.choices(chars, k=r.randrange(50))) for _ in range(n)]


def ids(path, text):
    return tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def rows():
    out = [(i, t) for i, t in enumerate(TEXTS)]
    return out + [(3, " "), (None, "no id"), *((100 + i, t) for i, t in enumerate(fuzz(40)))]


def frame(spark, data):
    return spark.createDataFrame([(d, t, "p", "r") for d, t in data], "doc_id long, text string, part string, length string").repartition(3)


def test_encode_equals_library():
    own, lib = byte_bpe(BYTE), tokenizers.Tokenizer.from_file(BYTE)
    assert own.fast is not None
    for t in [*(x or "" for x in TEXTS), *fuzz(1500)]:
        assert own.encode(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_count_equals_library():
    own, lib = bpe_count.counter(WORD), tokenizers.Tokenizer.from_file(WORD)
    for t in [*(x or "" for x in TEXTS), *fuzz(1500)]:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids)


def test_token_counts(spark):
    data = rows()
    got = sorted((tuple(x) for x in bpe_count.token_counts(frame(spark, data), WORD).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(ids(WORD, t)), n > 2048) for d, t in data]
    assert got == sorted(want, key=str)
    assert bpe_count.token_counts(frame(spark, []), WORD).count() == 0


def test_shortest_pack_first():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 64): r.randint(1, 30) for _ in range(r.randint(0, 40))}
        packs = packing.shortest_pack_first(counts, 64)
        placed = {}
        for n, pattern in packs:
            assert n > 0 and sum(pattern) <= 64
            for k in pattern:
                placed[k] = placed.get(k, 0) + n
        assert placed == counts


def test_pack(spark):
    data = rows()
    got = packing.pack(frame(spark, data), BYTE, with_ids=True).collect()
    docs = {}
    for x in got:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        docs.setdefault((x.doc_id, x.doc_tokens), []).append((x.start, list(x.ids)))
    want = {}
    for d, t in data:
        own = [*ids(BYTE, t), 1]
        want.setdefault((d, len(own)), []).append(own)
    assert docs.keys() == want.keys()
    for k, lists in want.items():
        assert [i for s, p in sorted(docs[k]) for i in p] == [i for own in lists for i in own] or len(lists) > 1
    seqs = {}
    for x in got:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_wavelet_matrix():
    r = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 1000):
        v = r.integers(0, 50, n).astype(np.uint16)
        m = WaveletMatrix.of(v, 6)
        assert m.decode(np.uint16).tolist() == v.tolist()
        at = np.arange(n)
        assert m.access(at).tolist() == v.tolist()
        for s in (0, 7, 49):
            assert m.rank(np.full(n + 1, s), np.arange(n + 1)).tolist() == np.append(0, np.cumsum(v == s)).tolist()
            where = np.flatnonzero(v == s)
            assert m.select(s, np.arange(len(where))).tolist() == where.tolist() if len(where) else True


def test_token_files(spark, tmp_path):
    data = rows()
    path = str(tmp_path / "files")
    token_files.write(frame(spark, data), path, BYTE, shard_ids=300)
    got = sorted(token_files.documents(spark, path, with_ids=True).collect(), key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted((d for d, _ in data), key=lambda d: -1 if d is None else d)
    at = 0
    for x in got:
        assert x.start == at and x.n_tokens == len(x.ids)
        at += x.n_tokens
    want = sorted((str(d), [*ids(BYTE, t), 2]) for d, t in data)
    assert sorted((str(x.doc_id), list(x.ids)) for x in got) == want
    assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in got)
    everything = [i for x in got for i in x.ids]
    base = 0
    for row in token_files.shards(spark, path).orderBy("part", "shard").collect():
        one = token_files.Shard(row.asDict())
        own = everything[base : base + one.size]
        assert one.access(np.arange(one.size)).tolist() == own
        assert one.count(2) == own.count(2) and one.occurrences(2).tolist() == [i for i, x in enumerate(own) if x == 2]
        assert one.count(999_999) == 0
        base += one.size
    assert base == len(everything)


def test_token_files_empty(spark):
    assert token_files.round_trip(frame(spark, []), BYTE).count() == 0

"""Token counts by heap-and-linked-list byte-pair merging: a count is the number of symbols less the merges; no ids are made."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseek.llm.common import per_batch, text_column
from lodeseek.llm.tokens import byte_symbols

LIMIT = 2048
#: Words whose counts a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 400_000
#: Latin-1 texts without odd white space, for which the standard library lowers and splits as the tokenizer file says.
LATIN = re.compile("[\t\n\r -~¡-ÿ]*")
LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t\n\r0-9a-zª²³µ¹º¼-¾ß-öø-ÿ]+")


class MergeCounter(dict):
    """word -> number of tokens, for a BPE file with byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in reversed(list(enumerate(pairs)))}
        self.symbols = byte_symbols()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The short cut holds for this normalizer and these classes only; other files take the general way.
        self.latin = [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and split.startswith("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|")
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        special = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None

    def __missing__(self, word: str) -> int:
        """The count of a word given as its bytes' symbols."""
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.merged(list(word))
        return n

    def merged(self, symbols: list[str]) -> int:
        """How many symbols are left when the lowest-ranked adjacent pair, leftmost first, has been merged until none is left."""
        n = len(symbols)
        symbols[-1] += self.suffix
        if n == 1:
            return 1
        rank = self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or rank.get((symbols[i], symbols[j])) != r:
                continue  # one of the two has been merged away since
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings. Letters' classes and the split are the library's own, but for Latin-1."""
        if self.latin and LATIN.fullmatch(text):
            words = LATIN_SPLIT.findall(text.lower())
            if not text.isascii():
                words = [w if w.isascii() else "".join(map(self.symbols.__getitem__, w.encode())) for w in words]
        else:
            words = [w for w, _ in self.cut(self.normalize(text))]
        return sum(map(self.__getitem__, words))

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text, ...).

    Null counts as empty: no bytes, no tokens. Repeated rows keep their rows, a null doc_id stays null,
    extra columns are not read, and an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        one = counter(tokenizer)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        n = [one.count(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return per_batch(text_column(docs.select("doc_id", "text")), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

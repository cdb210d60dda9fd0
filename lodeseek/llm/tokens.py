"""Token ids of a tokenizer file, encoded inside tasks; the file's path is a parameter and is opened once per worker."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: How byte-level BPE splits text before merging, and the class of characters for which this
#: module has been checked against the tokenizers library (tests/llm/test_tokens.py).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r -~¡-ſ–—‘’“”…]*")
#: The split backtracks over white space, one stack frame a character, so a run of so many goes to the library.
LONG_SPACE = re.compile(r"\s{4096}")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """Byte-level BPE of a tokenizers file.

    Ids are those of the tokenizers library with add_special_tokens=False, special strings in a text being
    special, which is its default. Where the file is plain byte-level BPE whose ids follow its merges, and a
    text has only characters of PLAIN, no LONG_SPACE and no special string, tiktoken merges with the ranks
    read from the same file: equal ids for a fifth of the CPU time. Every other text goes to the library.
    Texts may be of any length and hold runs of any length.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not spec["normalizer"] and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain:
            return None
        import tiktoken

        own = {c: b for b, c in enumerate(byte_symbols())}
        special = set(self.special)
        ranks = {bytes(own[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
            return None
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or not PLAIN.fullmatch(text) or LONG_SPACE.search(text) or any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@functools.lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)

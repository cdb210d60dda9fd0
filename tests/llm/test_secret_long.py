"""Candidates in very long runs: time grows with the text, and overlapping findings are settled without comparing all."""

import time

import numpy as np
import pytest

from lodeseek.llm import secret_scan

LONG = {
    "assignments": "abc=" * 250_000, "long assignments": "abcdefgh1=" * 100_000, "one URL": "https://example.com/" + "a1B/" * 250_000, "base64": "QUJDa2x4" * 125_000,
    "query": "https://example.com/?" + "token=a1b2c3d4e5&" * 60_000, "colons": "key: " * 200_000, "letters": "a" * 1_000_000,
}


@pytest.mark.parametrize("name", list(LONG))
def test_a_megabyte_takes_seconds(name):
    began = time.process_time()
    found = secret_scan.candidates(LONG[name])
    assert time.process_time() - began < 20
    assert all(0 <= a < b <= len(LONG[name]) for a, b, _ in found)


def test_values_inside_a_long_run():
    """Every assignment of a run gives its value, however many stand before it."""
    text = "".join(f"key{i}=value{i:05}x;" if i % 2 else f"key{i}=value{i:05}x=" for i in range(400))
    names = {n for _, _, n in secret_scan.candidates(text)}
    assert names >= {f"key{i}" for i in range(400)}


def test_many_overlapping_findings():
    n = 60_000
    start = np.concatenate([[0], np.arange(n) * 10])
    end = np.concatenate([[10 * n], np.arange(n) * 10 + 9])
    opens = np.zeros(n + 1, bool)
    opens[0] = True
    began = time.process_time()
    inner = secret_scan._best(opens, start, end, np.concatenate([[0.1], np.full(n, 0.5)]))
    outer = secret_scan._best(opens, start, end, np.concatenate([[0.9], np.full(n, 0.5)]))
    assert time.process_time() - began < 20
    assert inner.tolist() == list(range(1, n + 1)) and outer.tolist() == [0]

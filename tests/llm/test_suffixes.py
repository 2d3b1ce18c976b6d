"""Induced sorting against plain sorting, in memory and with everything spilled."""
import random

import numpy as np
import pytest

from featurespark.llm import suffixes


def check(b: bytes, limit: int) -> None:
    blocks = list(suffixes.descending(np.frombuffer(b, np.uint8), limit))
    order = np.concatenate([o for o, _ in blocks]).tolist()
    common = np.concatenate([c for _, c in blocks]).tolist()
    depth = suffixes.DEPTH
    assert sorted(order) == list(range(len(b)))
    for i in range(1, len(order)):
        p, q = b[order[i - 1]:], b[order[i]:]
        assert p[:depth] >= q[:depth]
        k = 0
        while k < min(len(p), len(q), depth) and p[k] == q[k]:
            k += 1
        assert common[i] == k


@pytest.mark.parametrize("limit", [10 ** 9, 200])      # 200 bytes: recursion and scratch files
def test_random_and_repetitive_bytes(limit):
    rng = random.Random(1)
    for trial in range(150):
        letters = rng.choice([b"ab", b"abc", b"abcdefgh", bytes(range(255))])
        s = bytes(rng.choice(letters) for _ in range(rng.randint(1, 120)))
        if trial % 3 == 0:
            s = (s[:rng.randint(1, 20)] * 30)[:400]
        if trial % 3 == 1:
            s = s + b"\xff" + s[5:60] + b"\xff" + s
        check(s, limit)


def test_order_of_a_string_beyond_one_step(monkeypatch):
    monkeypatch.setattr(suffixes, "STEP", 64)
    rng = random.Random(2)
    check(bytes(rng.choice(b"abcd") for _ in range(1500)), 4000)

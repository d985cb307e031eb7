import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlake.llm import induced


def check(data: bytes):
    s = np.frombuffer(data, np.uint8).astype(np.int16)
    order = induced.suffix_array(s, 256)
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert order.tolist() == want
    room = len(data) - np.arange(len(data))
    plcp, before = induced.permuted_lcp(s, order, room)
    for k in range(1, len(want)):
        a, b = data[want[k] :], data[want[k - 1] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert plcp[want[k]] == n and before[want[k]] == want[k - 1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 255]), min_size=1, max_size=80).map(bytes))
def test_small_alphabets(data):
    check(data)


@pytest.mark.parametrize("data", [b"a", b"aaaa", b"banana" * 20, bytes(range(256)) * 2, b"mississippi", b"ab" * 50, b"zyxw"])
def test_shapes(data):
    check(data)


def test_large():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 104, rng.integers(1, 9)).astype(np.uint8)) for _ in range(50)]
    check(b" ".join(words[k] for k in rng.integers(0, 50, 800)))

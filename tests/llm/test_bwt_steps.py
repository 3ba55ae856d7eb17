"""The extension on the transform takes few steps."""

import sys

import numpy as np

from corpuslab.llm import bwt


def test_borders_take_steps_that_double():
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 5, 3000).astype(np.uint16)
    text = np.concatenate([passage, rng.integers(1, 5, 500).astype(np.uint16), passage, np.zeros(1, np.uint16)])
    for length in (1, 2, 3, 100, 1000):
        order = bwt.sort_suffixes(text, length)
        calls = []
        sys.setprofile(lambda frame, event, what: calls.append(event) if event.endswith("call") else None)
        found = bwt.borders(text, order, length)
        sys.setprofile(None)
        assert len(calls) < 400
        strings = [text[i : i + length].tobytes() for i in order.tolist()]
        assert found.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]

"""A document's score doesn't depend on its neighbours in the block."""

import numpy as np
import pyarrow as pa

from corpuslab.llm import toxicity
from corpuslab.llm.textbatch import blocks


def test_a_word_is_not_said_over_across_documents():
    _, _, data, offsets = next(blocks(pa.array(["scum"])))
    lowered, starts, ends, _ = toxicity.tokens(data, offsets)
    hashes = np.unique(np.concatenate([h for _, h in toxicity.features(lowered, starts, ends)]))
    model = toxicity.Model(hashes, np.full(len(hashes), 5.0))

    def found(texts):
        _, _, data, offsets = next(blocks(pa.array(texts)))
        return {d: toxicity.excess_of(f) for d, _, f in toxicity.passages(model, model.sieve(), data, offsets)}

    alone = found(["scum"])[0]
    assert found(["scum", "scum", "", "scum", "x scum", "scum x"]).keys() == {0, 1, 3, 4, 5}
    assert all(x == alone for d, x in found(["scum", "scum", "", "scum"]).items())
    assert found(["scum scum"])[0] < found(["scum x scum"])[0]  # inside a document it still counts once
    assert found(["", ""]) == {}

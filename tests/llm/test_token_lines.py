"""New pre-tokens go to the tokenizers library many at once (op6, op9)."""

import numpy as np

from corpuslab.llm import tokens

TEXTS = ["it's 12 o''re we'll 'x'\n\n  a\tb c\n", "", "\n", "  x　 y\r\nñandú 漢字漢", "᠎a​ b", "<|endoftext|> #$ a'", "'s", " ".join(f"w{i}z" for i in range(2000))]


def test_lines_of_pretokens_give_the_librarys_ids():
    encode = tokens.Encoder(tokens.default_path())
    calls = []
    inner = encode._encoded
    encode._encoded = lambda pieces: calls.append(len(pieces)) or inner(pieces)
    raw = [t.encode() for t in TEXTS]
    for _ in range(2):
        ids, of = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
        for k, t in enumerate(TEXTS):
            assert ids[of[k] : of[k + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids
    # over 2,000 pre-tokens were a string each; the second time nothing is new
    assert sum(calls) < 40 and len(calls) == 2

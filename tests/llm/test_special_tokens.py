"""Texts that hold a special token literally get the ids that the library gives."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import tokens


@pytest.mark.parametrize("name, drops_space", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_those_of_the_library(name, drops_space):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    special = [t.content for t in plain.get_added_tokens_decoder().values()]
    assert special
    texts = ["", "plain words here", *special]
    for s in special:
        texts += [f"before {s} after", f"{s}{s}\n{s} x", s.upper(), f"Of {s.upper()} and {s}", s[:-1], f"a{s}b\n\nfew   spaces"]
    encoder = tokens.Encoder(path, drops_space)
    for _ in range(2):  # also from a filled memo
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
            kind = np.uint16 if encoder.code == "H" else np.uint32
            assert np.frombuffer(ids, kind).tolist() == plain.encode(text, add_special_tokens=False).ids, text

"""Ids of words by the merges alone and by the whole tokenizer."""

import random
from array import array

import public_tokenizers
import pytest

from tracewell.llm import tokens

FILES = [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)]
WORDS = ["plain", "Plain,", "ÉCOLE", "straße.", "don't", "it's.", "x'll", "a1b2", "2024", "...", "?!", "(so)", "naïve-", "well-known", "Ελλάδα", "слово,", "東京", "مرحبا",
         "été", "µm", "ª", "İs", "🙂", "\x01", "a\x01b", "­", "'s", "s'", "_x_", "A" * 300, "ÿ)", "É;"]


def wanted(encode, text):
    encode.tokenizer.encode_special_tokens = False
    try:
        return array(encode.code, encode.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    finally:
        encode.tokenizer.encode_special_tokens = True


@pytest.mark.parametrize(("name", "drops_space"), FILES)
def test_ids_are_those_of_the_whole_tokenizer(name, drops_space, monkeypatch):
    draw = random.Random(7)
    gaps = [" "] * 12 + ["\n"] * 3 + ["  ", "\t", "\r\n", "\xa0", "\x85", "\x1c", " \n", "\n\n", "\f"]
    texts = ["".join(draw.choice(WORDS) + draw.choice(gaps[:15] if i % 3 else gaps) for _ in range(draw.randint(0, 40))) + draw.choice(WORDS) for i in range(400)]
    texts += ["", " ", "\n", "a", "\na", "a\n", "a <|endoftext|> b", "end", "a\nb c\nd"] + WORDS
    encode = tokens.Encoder(public_tokenizers.path(name), drops_space)
    want = [wanted(encode, t) for t in texts]
    assert list(encode.encode([t.encode() for t in texts])) == want
    # neither memos that start anew nor short runs of texts change a result
    monkeypatch.setattr(tokens, "MEMO_WORDS", 20)
    monkeypatch.setattr(tokens, "TEXTS", 7)
    encode.memo.clear()
    assert list(encode.encode([t.encode() for t in texts])) == want and list(encode.encode([])) == []


@pytest.mark.parametrize(("name", "drops_space"), FILES)
def test_plain_words_do_not_pass_through_the_whole_tokenizer(name, drops_space):
    encode, seen = tokens.Encoder(public_tokenizers.path(name), drops_space), []
    whole = encode._whole
    encode._whole = lambda texts: seen.extend(texts) or whole(texts)
    list(encode.encode(["One plain, école\nof words.".encode(), b"again (one) plain"]))
    assert {t.strip() for t in seen} <= {"", "(one)"}

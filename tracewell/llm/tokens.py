"""Token ids of whole texts by a public tokenizer file, with a bounded memo of the words that come again."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of one worker's memo (about 200 bytes each); beyond it the memo starts anew, which costs time but no result.
MEMO_WORDS = 1_000_000
#: Texts, and bytes of them, whose words are told apart at once.
TEXTS, TEXT_BYTES = 2560, 1 << 23
#: Letters of the first two Latin blocks with marks behind them: the rules of both files cut such a word between the two alone.
PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)\-]*)")
#: The rules under which that holds, as the library states them.
GPT2 = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
CASELESS = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
LOWER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
#: White space outside ASCII: a text that holds any is encoded as a whole.
OTHER_SPACE = "\x1c-\x1f\x85\xa0  -     　"
RARE_SPACE = re.compile(rf"[\t\r\v\f{OTHER_SPACE}]")


def uneven(text: str) -> bool:
    """Whether a text can't be cut at each single space and line end between two visible characters."""
    if not text or text[0] in " \n" or text[-1] in " \n" or any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")):
        return True
    if text.isascii():
        return any(c in text for c in "\t\r\v\f\x1c\x1d\x1e\x1f")
    return RARE_SPACE.search(text) is not None


_open: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _state(part: object) -> dict | None:
    return None if part is None else json.loads(part.__getstate__())


class Encoder:
    """Encodes texts exactly as the tokenizer does, word by word where its rules allow.

    ``drops_space`` says that the tokenizer drops white space and case (then ASCII white space always parts words and A-Z
    may be lowered before), otherwise that it is byte-level with a leading space joined to its word. The different words of
    many texts are found by Arrow, and each is encoded once: plain ones by the file's merges alone, the others by the whole tokenizer.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a word is never a special token; texts that hold one go whole
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops_space = drops_space
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.model = self.tokenizer.model
        rules = _state(self.tokenizer.normalizer), _state(self.tokenizer.pre_tokenizer)
        self.by_merges = rules == ((LOWER, CASELESS) if drops_space else (None, GPT2))
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # letters and marks of plain words

    @property
    def width(self) -> int:
        return array(self.code).itemsize

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, text: str) -> bytes:
        """Ids of a text that the tokenizer's rules leave in one piece."""
        if text.isascii():  # letters, marks, a space or a line end
            letters = text.replace(" ", BYTE_LETTERS[32]).replace("\n", BYTE_LETTERS[10])
        else:
            letters = text.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        if len(self.parts) >= MEMO_WORDS // 2:
            self.parts.clear()
        self.parts[text] = ids
        return ids

    def _learn(self, new: list[str]) -> None:
        """Put words into the memo; one with a line end before it starts a line, the others stand behind a space."""
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
        other, memo, known, plain, caseless = [], self.memo, self.parts.get, PLAIN.fullmatch, self.drops_space
        if not self.by_merges:
            new, other = [], new
        for word in new:
            if word.isascii() and word.isalpha():
                line, letters, marks = "", word, ""
            elif cut := plain(word):
                line, letters, marks = cut.groups()
            else:
                other.append(word)
                continue
            letters = letters.lower() if caseless else letters if line else " " + letters
            ids = known(letters) or self._part(letters)
            if marks:
                ids += known(marks) or self._part(marks)
            memo[word] = self._part("\n") + ids if line else ids
        for at in range(0, len(other), 8192):
            some = other[at:at + 8192]
            memo.update(zip(some, self._whole(some if caseless else [w if w.startswith("\n") else " " + w for w in some])))

    def _joined(self, words: pa.ListArray, skip: int = 0) -> Iterable[bytes]:
        """Ids of the words of each text one after another, without the first ``skip`` bytes."""
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for at in range(0, len(distinct), MEMO_WORDS):
            some = distinct[at:at + MEMO_WORDS]
            missing = [w for w in some if w not in self.memo]
            if len(self.memo) + len(missing) > MEMO_WORDS:
                missing = some
            self._learn(missing)
            found = list(map(self.memo.__getitem__, some))
            ids = found if at == 0 else ids + found
        if not distinct:
            ids = []
        flat = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)[np.asarray(words.offsets)]
        data = flat.buffers()[2] or pa.py_buffer(b"")
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            yield data[start + skip:end].to_pybytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes, special tokens as the library gives them."""
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if len(part) == TEXTS or size > TEXT_BYTES:
                yield from self._encode(part)
                part, size = [], 0
        if part:
            yield from self._encode(part)

    def _encode(self, part: list[bytes]) -> Iterator[bytes]:
        literal = [any(s in t for s in self.special) for t in part]
        rest = [t for t, whole in zip(part, literal) if not whole]
        done = iter(self._caseless(rest) if self.drops_space else self._spaced([t.decode() for t in rest]))
        for t, whole in zip(part, literal):
            yield self._with_special(t.decode()) if whole else next(done)

    def _with_special(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return self._whole([text])[0]
        finally:
            self.tokenizer.encode_special_tokens = True

    def _caseless(self, texts: list[bytes]) -> Iterable[bytes]:
        return self._joined(pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string())))

    def _spaced(self, texts: list[str]) -> Iterable[bytes]:
        """Each space between two visible characters goes with the word after it, each line end stands alone."""
        odd = [uneven(t) for t in texts]
        lines = pa.array(["\n" + t.replace("\n", " \n") for t, whole in zip(texts, odd) if not whole], pa.large_string())
        done = iter(self._joined(pc.split_pattern(lines, " "), len(self._whole(["\n"])[0])))
        for text, whole in zip(texts, odd):
            yield self._whole([text])[0] if whole else next(done)


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's encoder of a file; it lives as long as the worker."""
    if (path, drops_space) not in _open:
        _open[path, drops_space] = Encoder(path, drops_space)
    return _open[path, drops_space]

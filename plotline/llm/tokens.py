"""Whole texts to token ids with the tokenizers library, each distinct chunk encoded once per worker.

Both vocabularies split a text into pre-tokens before merging, and neither merges across white space, so a text may
be cut there and the ids of its chunks joined. Chunks repeat far more often than texts: a worker remembers their ids.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

from plotline.llm.common import remembered

#: Chunks that a worker remembers in each of two generations (about 140 bytes each), and the length beyond which it does not.
CACHE_CHUNKS, CACHE_CHARS = 250_000, 64
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers")
#: Chunks of one Latin word, with a mark after it or not: two pre-tokens at most, which every normaliser here leaves as they are but for case.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
#: Byte-level models name a printable byte by its own character and the others by the next free characters from 256.
_PRINTABLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
_CUT = re.compile(r"(?<=\S)(?= \S)")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def vocabulary_size(path: str) -> int:
    return _tokenizer(path).get_vocab_size(with_added_tokens=True)


def word_chunks(text: str) -> list[str]:
    """For vocabularies that drop white space: cut at spaces and line feeds."""
    return [x for x in text.replace("\n", " ").split(" ") if x]


def space_chunks(text: str) -> list[str]:
    """For vocabularies that join one space to the following word: cut before each single space between words."""
    if not text:
        return []
    out = []
    for i, line in enumerate(text.split("\n")) if "\r" not in text and "\n\n" not in text else [(0, text)]:
        if i:
            out.append("\n")
        if not line:
            continue
        parts = line.split(" ")
        if line.split() != parts:  # a space next to other white space, or at an end, may belong to either side
            return _CUT.split(text)
        out.append(parts[0])
        out += [" " + x for x in parts[1:]]
    return out


class ChunkEncoder(dict):
    """Ids of texts as little-endian unsigned 32-bit integers; itself the memory of chunks.

    Plain words go to the library's model as they are, a mark after them apart; other chunks through the whole tokenizer.
    Chunks not seen for two generations of the memory are forgotten.
    """

    def __init__(self, path: str, cut):
        super().__init__()
        self.cut, self.tokenizer, self.older, self.marks = cut, _tokenizer(path), {}, {}
        self.lower = cut is word_chunks
        self.model = self.tokenizer.model

    def _ids(self, piece: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            if m := _PLAIN.fullmatch(chunk):
                word, mark = m.groups()
                if self.lower:
                    word = word.lower()
                if word != chunk:
                    found = self[word]
                else:  # the space is the only byte of these letters in ASCII that has another character
                    found = self._ids(word.replace(" ", _BYTE_CHARS[32]) if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS))
                if mark:
                    if mark not in self.marks:
                        self.marks[mark] = self._ids(mark)
                    found += self.marks[mark]
            else:
                found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.cut(t))) for t in texts]


def encoder(path: str, cut) -> ChunkEncoder:
    """The worker's encoder for this vocabulary."""
    return remembered(("tokens", path, cut.__name__), lambda: ChunkEncoder(path, cut))


def slices(sizes: list[int], most: int = 2_000_000):
    """Ranges of rows of about ``most`` characters each."""
    start = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)

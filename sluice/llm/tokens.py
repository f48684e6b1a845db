"""Fast exact encoding with a byte-level BPE of the ``tokenizers`` library.

A byte-level BPE never merges across the start of a pre-token.  A space before
a non-space always starts one, and a line feed between two non-spaces is one by
itself.  So a text may be cut there and its parts encoded by themselves;
frequent parts are then looked up instead of encoded again, and of many texts
together each different part once.  Texts that hold an added token's string are
encoded whole, since the library cuts these out before anything else.
"""

from __future__ import annotations

import os
import string
from array import array
from codecs import charmap_decode
from itertools import islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts kept per process, how many of the first stay when there are more, and the longest that is kept; they bound memory only.
CACHED_PARTS, FIRST_PARTS, CACHED_CHARS = 600_000, 250_000, 32

#: Parts put in order at a time.
BLOCK = 1 << 18
#: Marks that end a word without being part of a pre-token of its letters; an apostrophe may be.
MARKS = string.punctuation.replace("'", "")

_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Parts(dict):
    """Ids of parts: ``"ab"`` stands for a space and ab, ``"\\nab"`` for a line feed and ab."""

    def __init__(self, tokenizer, code: str):
        super().__init__()
        self.model, self.code = tokenizer.model, code
        self.whole = tokenizer.encode
        # a byte-level BPE spells the printable bytes as themselves and the others from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spelling = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.spelling = "".join(spelling.get(b, chr(b)) for b in range(256))
        self.space, self.marks, self.id = spelling[0x20], {"": b""}, attrgetter("id")
        self.newline = self.pack("\n")

    def pack(self, text: str) -> bytes:
        return array(self.code, self.whole(text, add_special_tokens=False).ids).tobytes()

    def mark(self, marks: str) -> bytes:
        value = self.marks.get(marks)
        if value is None:
            value = self.pack(marks)
            if len(marks) <= 3:
                self.marks[marks] = value
        return value

    def __missing__(self, part: str) -> bytes:
        # letters alone, or letters and marks, are one or two pre-tokens
        line = part[:1] == "\n"
        word = part[1:] if line else part
        letters = word if word.isalpha() else word.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or max(letters) < "ɐ"):
            spelt = letters if letters.isascii() else charmap_decode(letters.encode(), "strict", self.spelling)[0]
            value = array(self.code, map(self.id, self.model.tokenize(spelt if line else self.space + spelt))).tobytes()
            if len(letters) < len(word):
                value += self.mark(word[len(letters) :])
            value = self.newline + value if line else value
        else:
            value = self.pack(part if line else " " + part)
        if len(part) <= CACHED_CHARS:
            self[part] = value
        return value


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = _Parts(self.tokenizer, "H" if self.dtype.itemsize == 2 else "I")

    def encode(self, text: str | None) -> bytes:
        """The text's ids as packed little-endian integers of ``dtype``; null is empty."""
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.parts.pack(text)
        self._bound()
        parts = text.replace("\n", " \n").split(" ") if _plain(text) else _cut(text)
        return self._head(parts[0]) + b"".join(map(self.parts.__getitem__, parts[1:]))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """What :meth:`encode` gives for each text; a part that occurs often in them is looked up once."""
        self._bound()
        out, rows, heads, rests = [b""] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if text and " " in text and not any(a in text for a in self.added) and _plain(text):
                line = text.replace("\n", " \n")
                at = line.index(" ")
                rows.append(i)
                heads.append(self._head(line[:at]))
                rests.append(line[at:])
            else:
                out[i] = self.encode(text)
        if not rows:
            return out
        # each rest begins with a space, so before the first one stands an empty part
        parts = pc.split_pattern(pa.array(["".join(rests)], type=pa.large_string()), " ").flatten().slice(1).dictionary_encode()
        every = pa.LargeListArray.from_arrays([0, len(parts.dictionary)], parts.dictionary)
        found = list(map(self.parts.__getitem__, pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")))
        size, place = self.dtype.itemsize, parts.indices.to_numpy()
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // size
        first, known, ids = np.cumsum(length) - length, np.frombuffer(b"".join(found), dtype=self.dtype), []
        for lo in range(0, len(place), BLOCK):
            own = place[lo : lo + BLOCK]
            n = length[own]
            stop = np.cumsum(n)
            ids.append(known[np.repeat(first[own] - (stop - n), n) + np.arange(int(stop[-1]))].tobytes())
        ids, stop = b"".join(ids), np.cumsum(length[place])
        ends = (stop[np.cumsum([rest.count(" ") for rest in rests]) - 1] * size).tolist()
        for i, head, a, b in zip(rows, heads, [0, *ends[:-1]], ends, strict=True):
            out[i] = head + ids[a:b]
        return out

    def _bound(self) -> None:
        if len(self.parts) > CACHED_PARTS:
            # frequent parts are among the first that were met
            for part in list(islice(self.parts, FIRST_PARTS, None)):
                del self.parts[part]

    def _head(self, part: str) -> bytes:
        """The first part has nothing before it."""
        return self.parts["\n" + part][len(self.parts.newline) :] if part.isalpha() else self.parts.pack(part)


def _plain(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between words."""
    words = text.split()
    return len(" ".join(words)) == len(text) and text.count(" ") + text.count("\n") == len(words) - 1


def _cut(text: str) -> list[str]:
    """Parts of a text with other white space; what starts with white space stays with the part before."""
    out = [""]
    for line in _between(text, "\n", strict=True):
        first, *others = _between(line, " ", strict=False)
        out += ["\n" + first, *others]
    return [out[1][1:], *out[2:]]


def _between(text: str, mark: str, strict: bool) -> list[str]:
    """``text`` cut at each ``mark`` that stands before a non-space and, if ``strict``, after one too."""
    pieces = text.split(mark)
    out = pieces[:1]
    for p in pieces[1:]:
        if not p or p[0].isspace() or (strict and (not out[-1] or out[-1][-1].isspace())):
            out[-1] += mark + p
        else:
            out.append(p)
    return out


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file, which every node holds at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

"""Token ids of whole texts, by a public tokenizer, one encoding for each distinct word.

Both vocabularies split a text at blanks before they merge anything, so the ids of a text
are those of its words one after the other. The words of many texts are dictionary-encoded by
Arrow; different ones come from a table of bounded size, only new ones go through the
tokenizer, and the ids of all texts are gathered at once. A text in which a word boundary is
not plain (runs of blanks, other white space), or with a string that may be a special token,
is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from listsieve.llm.words import chunks

#: Words kept a Python worker; then the table starts anew.
CACHED_WORDS = 1_000_000
ID = np.dtype("<u4")
#: Characters split into words at a time.
CHUNK_CHARS = 1 << 21

#: A blank that both vocabularies surely split at.
_PLAIN_BLANK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

#: Marks that never join what stands before them.
_MARKS = ".,;:!?"
#: Strings of special tokens start so.
_SPECIAL = "<|"
#: Stands before a text's first word, where others have the blank or line end before them.
_START = b"\0"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else
    the next one above 255."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()
_BLANK = _BYTE_LETTERS[0x20]


def _parts(text: str) -> Iterator[str]:
    """A very long text in parts whose ids are those of the whole one after the other."""
    start = 0
    while len(text) - start > CHUNK_CHARS and (cut := _PLAIN_BLANK.search(text, start + CHUNK_CHARS)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes.

    ``blank_led``: a word carries the blank before it (byte-level vocabularies); else white
    space is dropped. Strings of special tokens in a text have the ids that the library gives them.
    """

    def __init__(self, path: str, blank_led: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blank_led = blank_led
        self._forget()
        self.merges = self.tokenizer.model
        self.normalize = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        self.mark_ids: dict[str, bytes] = {}
        self.newline = self.plain(["\n"])[0]

    def _forget(self) -> None:
        """An empty table: each word, with what stands before it, has a place; the words' ids
        follow each other. ``unsure``: the ids depend on what is beside the word."""
        self.known: dict[bytes, int] = {}
        self.ids = np.empty(0, ID)
        self.starts = self.sizes = np.empty(0, np.int64)
        self.unsure = np.empty(0, bool)

    def plain(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's own ids of each text."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _learn(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of new words; None where they depend on what is beside. One of letters alone, or
        followed by plain marks, is one or two stretches of the vocabulary's splitting, so the
        merges apply to it at once."""
        out: list[bytes | None] = []
        rest: list[tuple[int, str, bytes]] = []
        for led in words:
            word = led[1:].decode()
            lead = " " if self.blank_led and led[0] == 0x20 else ""
            before = self.newline if self.blank_led and led[0] == 0x0A else b""
            core = word.rstrip(_MARKS)
            if core.isalpha() and (ids := self._stretch(lead, core)) is not None:
                out.append(before + ids if core is word else before + ids + self._marks(word[len(core) :]))
            elif led == _START:
                out.append(b"")
            elif _SPECIAL in word:
                out.append(None)
            elif self.blank_led and (not word or word[0].isspace() or word[-1].isspace() or not word.isprintable()):
                out.append(None)
            else:
                rest.append((len(out), lead + word, before))
                out.append(None)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for (place, _, before), ids in zip(some, self.plain([word for _, word, _ in some]), strict=True):
                out[place] = before + ids
        return out

    def _stretch(self, lead: str, letters: str) -> bytes | None:
        """Ids of one stretch of letters (and the blank before it), straight from the merges."""
        if letters.isascii():
            mapped = _BLANK + letters if lead else letters if self.blank_led else letters.lower()
        else:
            if not self.blank_led:
                letters = self.normalize(letters)
                if not letters.isalpha():
                    return None
            mapped = (lead + letters).encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = [token.id for token in self.merges.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _marks(self, marks: str) -> bytes:
        if marks not in self.mark_ids:
            self.mark_ids[marks] = self.plain([marks])[0]
        return self.mark_ids[marks]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, none for a null; words are held for a bounded chunk at a time."""
        out: list[bytes] = []
        for a, b in chunks(texts, CHUNK_CHARS):
            if b == a + 1 and len(texts[a] or "") > CHUNK_CHARS:
                out.append(b"".join(self._chunk([part])[0] for part in _parts(texts[a])))
            else:
                out.extend(self._chunk([t or "" for t in texts[a:b]]))
        return out

    def _places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table, learnt where it is new."""
        if len(self.known) + len(words) > CACHED_WORDS:
            self._forget()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            ids = self._learn(new)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.unsure = np.append(self.unsure, np.array([i is None for i in ids]))
            sizes = np.array([len(i or b"") >> 2 for i in ids])
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, np.frombuffer(b"".join(i or b"" for i in ids), ID))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _chunk(self, texts: list[str]) -> list[bytes]:
        blobs = [t.encode() for t in texts]
        data = _START + _START.join(blobs)
        raw = np.frombuffer(data, np.uint8)
        lengths = np.array([len(b) for b in blobs])
        starts = np.cumsum(lengths + 1) - lengths - 1
        leads = (raw == 0x20) | (raw == 0x0A)
        leads[starts] = True
        bounds = np.append(np.flatnonzero(leads), len(data)).astype(np.int32)
        buffers = [None, pa.py_buffer(bounds), pa.py_buffer(data)]
        found = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, buffers).dictionary_encode()
        _, ends, letters = found.dictionary.buffers()
        ends = np.frombuffer(ends, np.int32)[: len(found.dictionary) + 1].tolist()
        letters = letters.to_pybytes()
        words = [letters[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        codes = self._places(words)[found.indices.to_numpy()]

        first = np.searchsorted(bounds, starts)  # each text's first word
        unsure = self.unsure[codes]
        if self.blank_led and _START in self.known:  # a text that starts with white space
            unsure[first] |= (codes[first] == self.known[_START]) & (lengths > 0)
        n = self.sizes[codes]
        ends = np.cumsum(n)
        whole = self.ids[np.repeat(self.starts[codes] - (ends - n), n) + np.arange(ends[-1])]
        cuts = [*(ends - n)[first].tolist(), int(ends[-1])]
        out = [whole[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        odd = np.flatnonzero(np.logical_or.reduceat(unsure, first)).tolist()
        for i, own in zip(odd, self.plain([texts[i] for i in odd]), strict=True):
            out[i] = own
        return out


@lru_cache(maxsize=4)
def encoder(path: str, blank_led: bool) -> Encoder:
    """One encoder a Python worker, so that its words last from task to task."""
    return Encoder(path, blank_led)


def public_path(name: str) -> Callable[[], str]:
    """Where a public vocabulary lies, looked up on the executor that needs it."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path

"""Token ids by a tokenizer file of the tokenizers library, with a cache of text chunks.

The byte-level pattern never lets a token pass from a character that isn't white space into a following blank or line
feed, so a text may be cut there and the parts encoded apart. Parts repeat (they are mostly words), so each distinct
one is encoded once while it stays in the cache: words by the library's model, everything else by its whole encoder.
A cut is made only behind characters that are certainly no white space for the library (printable ASCII and U+00C0 to
U+00FF); tests hold all this against the library's encoding of whole texts.

Added tokens of the file (such as <|endoftext|>) that stand in a text get their own id, as the library has it by default;
with special_as_text the special ones are ordinary text.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import utf8

_CUT = re.compile("(?<=[!-~À-ÿ])(?=[ \n])")
#: Within a chunk a token also ends between a letter and ASCII punctuation other than the apostrophe, and a single line
#: feed between a visible character and a letter is a token of its own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_FINER = re.compile(f"(?<=[{_LETTERS}])(?=[!-&(-/:-@\\[-`{{-~])|(?<=[!-&(-/:-@\\[-`{{-~])(?=[{_LETTERS}])|(?<=[!-~À-ÿ])(?=\n[{_LETTERS}])|(?<=[!-~À-ÿ]\n)(?=[{_LETTERS}])")
#: A pre-token for certain: Latin letters with one blank before them at most. The model takes it as it is.
_WORD = re.compile(f" ?[{_LETTERS}]+")
#: Punctuation that never shares a token with letters before it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Entries of one generation of the cache, some 40 MB; there are two at most.
GENERATION = 200_000

_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards in order."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return {b: chr(b) if b in same else chr(next(other)) for b in range(256)}


class ChunkEncoder:
    """encode(texts): for each text the bytes of its ids as little-endian unsigned 32-bit integers."""

    _of: dict[tuple[str, int | None, bool], ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str, generation: int | None = None, special_as_text: bool = False) -> ChunkEncoder:
        """One for each worker process, file, size of the cache and way with special tokens."""
        key = (path, generation, special_as_text)
        if key not in cls._of:
            cls._of[key] = cls(*key)
        return cls._of[key]

    def __init__(self, path: str, generation: int | None = None, special_as_text: bool = False):
        self.generation = generation
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        added = {t.content: (k, t) for k, t in self.library.get_added_tokens_decoder().items() if not (special_as_text and t.special)}
        #: Added tokens and their ids; with flags that move their edges, a text that holds one goes to the library whole.
        self.added = {name: struct.pack("<I", k) for name, (k, t) in added.items()}
        self.edged = any(t.lstrip or t.rstrip or t.single_word or t.normalized for _, t in added.values())
        self.at_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self.vocabulary = self.library.get_vocab_size()
        self.model, self.letters = self.library.model, _byte_letters()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunk: str) -> bytes:
        """The ids of a chunk that isn't in the current generation, by its parts."""
        got = self.old.get(chunk) if self.old else None
        if got is None:
            body = chunk.rstrip(_MARKS)
            if body.isascii() and body[body[:1] == " " :].isalpha():
                if len(body) == len(chunk):
                    ids = [t.id for t in self.model.tokenize("Ġ" + chunk[1:] if chunk[0] == " " else chunk)]
                    got = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)
                else:
                    marks = chunk[len(body) :]
                    got = (self.known.get(body) or self._learn(body)) + (self.known.get(marks) or self._learn(marks))
            elif _WORD.fullmatch(chunk):
                ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
                got = struct.pack(f"<{len(ids)}I", *ids)
            else:
                parts = _FINER.split(chunk)
                if len(parts) > 1:
                    get = self.known.get
                    got = b"".join([get(x) or self._learn(x) for x in parts])
                else:
                    ids = self.library.encode(chunk, add_special_tokens=False).ids
                    got = struct.pack(f"<{len(ids)}I", *ids)
        self.known[chunk] = got
        return got

    def _whole(self, text: str) -> bytes:
        get = self.known.get
        if self.at_added is not None and self.at_added.search(text):
            if self.edged:
                ids = self.library.encode(text, add_special_tokens=False).ids
                return struct.pack(f"<{len(ids)}I", *ids)
            return b"".join([self.added[x] if x in self.added else self._whole(x) for x in self.at_added.split(text)])
        return b"".join([get(x) or self._learn(x) for x in _CUT.split(text) if x])

    def encode_rows(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another (nulls are empty), each text with `end` behind it, and n + 1 offsets.

        A batch's distinct chunks are found by the column library, looked up once, and laid out by gathers.
        """
        if len(self.known) > (self.generation or GENERATION):
            self.old, self.known = self.known, {}
        texts = texts.cast(pa.large_string()).fill_null("")
        # a blank before each word: split off with the word behind it
        rows = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        at = rows.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(rows.values.slice(at[0], at[-1] - at[0]))
        which, at = coded.indices.to_numpy(), at - at[0]
        chunks = coded.dictionary
        raw, where = utf8(chunks)
        # a chunk that doesn't end safely may not be cut off there, unless its text ends with it
        full = where[1:] > where[:-1]
        last = np.where(full, raw[np.maximum(where[1:] - 1, 0)] if len(raw) else 0, 0)
        before = np.where(where[1:] - where[:-1] > 1, raw[np.maximum(where[1:] - 2, 0)] if len(raw) else 0, 0)
        safe = full & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (before == 0xC3)))
        risky = ~safe[which]
        risky[at[1:] - 1] = False
        slow = set((np.searchsorted(at, np.flatnonzero(risky), side="right") - 1).tolist())
        for mark in ("\0", *self.added):
            slow.update(np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)).tolist())
        names = chunks.to_pylist()
        got = list(map(self.known.get, names))
        wanted = np.ones(len(names), bool)
        if slow:
            wanted[:] = False
            fast = np.ones(len(texts), bool)
            fast[list(slow)] = False
            wanted[which[np.repeat(fast, np.diff(at))]] = True
        for k, x in enumerate(got):
            if x is None:
                got[k] = self._learn(names[k]) if wanted[k] and names[k] else b""
        sizes = np.fromiter(map(len, got), np.int64, len(got)) >> 2
        values, begin = np.frombuffer(b"".join(got), "<u4"), np.cumsum(sizes) - sizes
        each = sizes[which]
        stop = np.cumsum(each)
        total = int(stop[-1]) if len(stop) else 0
        ids = values[np.repeat(begin[which] - (stop - each), each) + np.arange(total)] if total else np.zeros(0, "<u4")
        offsets = np.concatenate([[0], stop])[at]
        if slow:
            parts = [np.frombuffer(self._whole(texts[k].as_py()), "<u4") if k in slow else ids[offsets[k] : offsets[k + 1]] for k in range(len(texts))]
            ids = np.concatenate([np.zeros(0, "<u4"), *parts])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
        if end is not None:
            ids = np.insert(ids, offsets[1:], end)
            offsets = offsets + np.arange(len(offsets))
        return ids, offsets

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode_rows(pa.array(texts, pa.large_string()))
        return [ids[a:z].tobytes() for a, z in zip(at[:-1], at[1:])]

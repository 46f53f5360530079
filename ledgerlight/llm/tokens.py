"""Encoding whole texts with a public tokenizer inside Spark tasks.

``Encoder`` gives exactly the ids of ``Tokenizer.encode(text,
add_special_tokens=False)``. Where the tokenizer drops white space and never
joins characters across it, a text is the concatenation of its words. The
distinct words of a call are found and put back by Arrow; those of letters,
with marks behind or not, are looked up by their lower-cased letters, others by
themselves. What is new is encoded once and remembered; a memory is emptied
when it is full (``MOST_WORDS``, ``MOST_PIECES``). Any other tokenizer encodes each text as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

# The normalizer and the splitting pattern for which white space separates independent words.
SEPARABLE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SEPARABLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# Words of printable ASCII and Latin letters: they are composed already, and lower-case one by one.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
MARKS = ".,:;!?"
MOST_WORDS = 100_000
MOST_PIECES = 400_000


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.separable = separable(path) and not any(len(s.split()) != 1 for s in self.special)
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.as_bytes = {c: as_bytes(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.words, self.pieces = Memory(self._word), Memory(self._piece)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``; null is empty."""
        if not self.separable:
            return self._whole([(t or b"").decode() for t in texts])
        for memory, most in ((self.words, MOST_WORDS), (self.pieces, MOST_PIECES)):
            if len(memory) > most:
                memory.clear()
        split = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        _, ends, data = self._distinct(words.dictionary).take(words.indices).buffers()
        cuts = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        ids = data.to_pybytes() if data is not None else b""
        return [ids[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]

    def _distinct(self, words: pa.Array) -> pa.Array:
        """The ids of each word."""
        core = pc.utf8_rtrim(words, MARKS)
        plain = pc.match_substring_regex(core, LETTERS + "$")
        letters = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        marks = pc.replace_substring_regex(words.filter(plain), LETTERS, "").dictionary_encode()
        found = [self._pieces(x.dictionary).take(x.indices) for x in (letters, marks)]
        found = pc.binary_join_element_wise(*found, pa.scalar(b"", pa.large_binary()))
        other = pa.array([self.words[w] for w in words.filter(pc.invert(plain)).to_pylist()], pa.large_binary())
        place = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        order = np.empty(len(words), np.int64)
        order[place] = np.arange(len(words))
        return pa.concat_arrays([found, other]).take(pa.array(order))

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        return pa.array([self.pieces[p] for p in pieces.to_pylist()], pa.large_binary())

    def forget(self) -> None:
        """Give the memory back; a task does so at its end, since its worker lives on."""
        self.words.clear()
        self.pieces.clear()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            return b"".join([self.pieces[p] for p in PLAIN_PIECE.findall(word.lower())])
        return self._whole([word])[0]

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))
        return array(self.dtype.char, [t.id for t in found]).tobytes()


class Memory(dict):
    """Values by key, made by ``make`` when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


def separable(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec.get("normalizer") or {}).get("normalizers") or []
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [p["type"] for p in parts] == SEPARABLE_NORMALIZERS
        and parts[1]["content"] == " " and parts[1]["pattern"] == {"Regex": r"\s+"}
        and split.get("pattern") == {"Regex": SEPARABLE_PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and spec["model"]["type"] == "BPE"
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``most`` bytes in column ``name``."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)

"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A text is cut by the byte-level pattern into words. Of each word the current
parts and the ranks of adjacent pairs lie in two plain lists: the smallest rank
is found by a scan, its right part deleted and the ranks on both sides looked up
anew. Words beyond ``LONG_WORD`` bytes, where repeated scans would be quadratic,
take their merges from a heap in the same order (rank, then place).

Python keeps the words it has met, at most ``CACHE_WORDS`` of them per worker;
beyond that it starts over, which changes the time and not the result. Nothing
is shuffled: a document is encoded where it is read.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import map_texts

LONG_WORD = 96
CACHE_WORDS = 300_000

# How byte-level BPE cuts a text, and Unicode White_Space (without 1C-1F, which some libraries add).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# The same classes among the first 256 code points, for the faster ``re``.
LATIN_LETTER = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF"
LATIN_NUMBER = r"0-9\xB2\xB3\xB9\xBC-\xBE"
LATIN_SPACE = r"\x09-\x0D\x20\x85\xA0"

NO_PAIR = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """A byte-level tokenizer read from the text of its JSON file."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, letters = spec["model"], byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            known = all(c in to_byte for c in token)
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if known else token.encode()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.letter_id = [vocab[c] for c in letters]
        self.pairs: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = rank
            self.merged.append(vocab[a + b])
        # The library looks for the longest of several special tokens at a place.
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words = regex.compile(PATTERN.format(letter=r"\p{L}", number=r"\p{N}", space=SPACE)).findall
        self.latin_words = re.compile(
            PATTERN.format(letter=LATIN_LETTER, number=LATIN_NUMBER, space=LATIN_SPACE)).findall
        self.cache = _Words(self)

    def short(self, parts: list[int]) -> list[int]:
        get, merged = self.pairs.get, self.merged
        ranks = [get(pair, NO_PAIR) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_PAIR:
                break
            i = ranks.index(low)
            new = parts[i] = merged[low]
            del parts[i + 1]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((new, parts[i + 1]), NO_PAIR)
            if i:
                ranks[i - 1] = get((parts[i - 1], new), NO_PAIR)
        return parts

    def long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pairs.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((parts[i], parts[i + 1]), NO_PAIR)) != NO_PAIR]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # A pair that has changed since it was pushed has been pushed anew.
            if parts[i] < 0 or j >= n or get((parts[i], parts[j]), NO_PAIR) != rank:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    rank = get((parts[a], parts[after[a]]), NO_PAIR)
                    if rank != NO_PAIR:
                        heapq.heappush(heap, (rank, a))
        return [p for p in parts if p >= 0]

    def cut_words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(text)
        return self.latin_words(text)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            pieces = [text]
        else:
            pieces = self.cut.split(text)
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            else:
                out += map(self.cache.__getitem__, self.cut_words(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become the replacement sign."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


class _Words(dict):
    """Packed ids by word; starts over when it is full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        bpe = self.bpe
        parts = list(map(bpe.letter_id.__getitem__, word.encode("utf-8")))
        ids = bpe.short(parts) if len(parts) <= LONG_WORD else bpe.long(parts)
        packed = np.array(ids, "<u4").tobytes()
        if len(parts) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed


_loaded: dict[int, Bpe] = {}


def _bpe(definition) -> Bpe:
    """One tokenizer per worker process."""
    key = definition.id if hasattr(definition, "id") else hash(definition)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(definition.value if hasattr(definition, "value") else definition)
    return _loaded[key]


def encode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, ids, decoded``: packed token ids of each whole text and the text they decode to.

    ``tokenizer`` is the path of a byte-level BPE file; the driver reads it (its
    size is that of the vocabulary) and broadcasts it. ``ids`` holds
    little-endian unsigned 32-bit integers, so four bytes per token. Null and
    empty texts have no tokens and decode to the empty text; special tokens in a
    text become their own id. One row per row: repeated rows, null ids and
    columns of other names change nothing.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        bpe = _bpe(definition)
        ids = [bpe.encode(t) if t else b"" for t in texts]
        return ids, [bpe.decode(x) for x in ids]

    return map_texts(docs, id_column, text_column, {"ids": pa.binary(), "decoded": pa.string()}, run)


def digests(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of encoded rows."""
    return encoded.select(
        id_column, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

"""Scores of texts under a hierarchical Pitman-Yor model, learned by Gibbs sampling.

A text is its words and one end. A word is drawn in the restaurant of the word
before it (the end, for the first); all of these share one parent, the restaurant
of words without context, with a dish per word of the training texts; all other
words are one more outcome, that of a new dish which is no known word. The words'
base is a model of spelling: restaurants for the bytes after zero to three bytes of
context (the third folded to ``FOLD`` classes), where restaurants of longer contexts
share the one of the shorter context as parent, down to a uniform base.

    p(dish) = (customers - d tables + (a + d all tables) p_parent(dish)) / (a + all customers)

with the discount d of word pairs and of words from the numbers of dishes met once
and twice, n1 / (n1 + 2 n2).

Every table sends one customer to the parent. A sweep seats all customers anew,
dish by dish (a dish's tables depend on the rest only by the total of its
restaurant, taken from the sweep before; before the first sweep over pairs it is what so many customers
open on average), pairs and words in parallel over Spark, bytes level by level. Random
numbers are made from the dish, the sweep and the step, so a repeated task seats
as before, wherever it runs. After ``PAIR_SWEEPS`` sweeps over the pairs the words are the customers that
these send, and their predictive probabilities are averaged over the sweeps after
``BURN``; scores are sums of logarithms.

Texts are cut into chunks of documents (``CHUNK_TOKENS``), each with a dictionary of
its words and its distinct pairs. Only these meet those of other chunks, in buckets of equal
ranges of hashes: a bucket holds a word or pair at most once per chunk, however frequent it
is. What a bucket finds goes back to the chunks in the same order, as numbers; tokens
stay local numbers. Pairs are told apart by 64 bits of hash, words by themselves. A pair
is counted for its context and its word by the first chunk that has it. The
driver receives counts of spellings: at most 2^16 * FOLD contexts of 257 signs.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from itertools import chain
from math import gamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clienttrace.llm.common import written

CHUNK_TOKENS = 1 << 21
CHUNK_WORDS = 500_000
#: Words of chunks, and tokens, that a bucket of words or pairs is made for.
BUCKET_WORDS = 1 << 19
BUCKET_TOKENS = 1 << 22
#: Bytes of texts split at a time.
PIECE = 1 << 20
#: Words whose spelling is worked on at a time.
SLICE = 1 << 16
CONTEXT_STRENGTH = 1.0
STRENGTH = 10.0
SPELL_DISCOUNT = 0.5
SPELL_STRENGTH = 1.0
PAIR_SWEEPS = 2
SWEEPS = 3
#: Sweeps over words before the first one over pairs.
FIRST_SWEEPS = 2
BURN = 1
FOLD = 16
OFTEN = 30.0
RARE = 4.0
SIGNS = 257  # bytes and the end of a word


def uniforms(dish: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """A number in (0, 1) for each dish, by mixing bits (splitmix64)."""
    x = dish.astype(np.uint64) + np.uint64((sweep * 1_000_003 + step) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 1e-17


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, dish: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers have sat down one after another.

    ``opening`` is the weight of a new table. Up to the 32nd (the 8th, where new
    tables are rare) each customer decides by itself; after that the next customer to open a table is drawn at
    once from the product of the chances that those before it did not. Dishes
    with ``opening`` above ``OFTEN`` seat a fiftieth more at a time, with a
    normal number of new tables, so that steps grow with the logarithm of the customers.
    """
    tables = np.minimum(customers, 1).astype(float)
    left, calm = np.flatnonzero(customers > 1), np.zeros(0, np.int64)
    for n in range(1, 32):
        if not len(left):
            break
        if n == 8:
            # For these the product below is near enough: within a hundredth of the chance of the next customer.
            rare = opening[left] <= RARE
            calm, left = left[rare], left[~rare]
        new = uniforms(dish[left], sweep, n) * (n - discount * tables[left] + opening[left]) < opening[left]
        tables[left[new]] += 1
        left = left[customers[left] > n + 1]
    at, step = np.repeat([8.0, 32.0], [len(calm), len(left)]), 32
    left = np.concatenate([calm, left])
    while len(left):
        taken, open_ = discount * tables[left], opening[left]
        u = uniforms(dish[left], sweep, step)
        # Where tables open often, as many customers as add a fiftieth sit down together.
        many = np.floor((at + open_) / 50)
        block = (open_ > OFTEN) & (many >= 8)
        with np.errstate(over="ignore"):
            # The product of j / (j + a) over k numbers from x is about ((x + m) / (x + m + k)) ** a, m = (a - 1) / 2.
            from_ = at - taken + (open_ - 1) / 2
            one = np.floor(at + from_ * (u ** (-1 / np.maximum(open_, 1e-12)) - 1))
        many = np.minimum(many, customers[left] - at)
        mean = open_ * np.log1p(many / (at - taken + open_))
        normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniforms(dish[left], sweep, -step))
        new = np.clip(np.round(mean + np.sqrt(mean * np.maximum(1 - mean / np.maximum(many, 1), 0)) * normal), 0, many)
        # ``one`` customers sit; the next one opens a table, if there is one.
        going = np.where(block, at + many, one) < customers[left]
        tables[left] += np.where(block, new, going)
        at = np.where(block, at + many, one + 1)
        left, at, step = left[going], at[going], step + 1
    return tables


class Level:
    """The restaurants of one context length: cells (context and sign), customers, tables."""

    def __init__(self, cells: np.ndarray, customers: np.ndarray, tables: np.ndarray):
        self.cells, self.customers, self.tables = cells, customers, tables
        contexts, self.of = np.unique(cells // SIGNS, return_inverse=True)
        self.contexts = contexts
        self.all_customers = np.bincount(self.of, weights=customers, minlength=len(contexts))
        self.all_tables = np.bincount(self.of, weights=tables, minlength=len(contexts))
        self.kept = (customers - SPELL_DISCOUNT * tables) / (SPELL_STRENGTH + self.all_customers[self.of])
        self.passed = (SPELL_STRENGTH + SPELL_DISCOUNT * self.all_tables) / (SPELL_STRENGTH + self.all_customers)

    def __getstate__(self) -> dict:
        """What predictions need; the rest stays on the driver."""
        return {k: getattr(self, k) for k in ("cells", "kept", "contexts", "passed")}

    def predict(self, cells: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return _look(self.cells, self.kept, cells, 0.0) + _look(self.contexts, self.passed, cells // SIGNS, 1.0) * parent


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _parent(cells: np.ndarray, length: int) -> np.ndarray:
    """Cells of the context that is one byte shorter than ``length``."""
    context, sign = cells // SIGNS, cells % SIGNS
    return context % (1 << 8 * (length - 1)) * SIGNS + sign


class Spelling:
    """The hierarchy of byte restaurants; ``previous`` gives the parents' probabilities of the sweep before."""

    def __init__(self, cells: np.ndarray, customers: np.ndarray, sweep: int, previous: Spelling | None):
        self.levels: list[Level] = []
        for length in (3, 2, 1, 0):
            if previous is None:
                tables = np.minimum(customers, 1).astype(float)
            else:
                up = _parent(cells, length) if length else cells
                base = previous.probability(up, length - 1) if length else np.full(len(cells), 1 / SIGNS)
                total = _look(previous.levels[length].contexts, previous.levels[length].all_tables, cells // SIGNS, 0.0)
                tables = seat(customers, (SPELL_STRENGTH + SPELL_DISCOUNT * total) * base, SPELL_DISCOUNT,
                              cells + (length << 40), sweep)
            self.levels.insert(0, Level(cells, customers, tables))
            if length:
                cells, at = np.unique(_parent(cells, length), return_inverse=True)
                customers = np.bincount(at, weights=tables, minlength=len(cells))
        # The whole probability of every cell that occurs, so that most are found by one search.
        self.known = self._climb(self.levels[3].cells, 3)

    def probability(self, cells: np.ndarray, length: int) -> np.ndarray:
        if length < 3:
            return self._climb(cells, length)
        p = _look(self.levels[3].cells, self.known, cells, -1.0)
        rest = p < 0
        p[rest] = self._climb(cells[rest], 3)
        return p

    def _climb(self, cells: np.ndarray, length: int) -> np.ndarray:
        parent = self._climb(_parent(cells, length), length - 1) if length else np.full(len(cells), 1 / SIGNS)
        return self.levels[length].predict(cells, parent)


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all bytes and ends of the words, where each word starts, and a number for each word."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], "<i8")[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets) + 1
    n = len(data) + len(words)
    sign = np.full(n, SIGNS - 1, np.int32)
    starts = offsets[:-1] - offsets[0] + np.arange(len(words))
    body = np.ones(n, bool)
    body[starts + sizes - 1] = False
    sign[body] = data
    # The sign before, that before it and the one before that; zero where the word starts later.
    before = [sign]
    for _ in range(3):
        before.append(np.empty_like(sign))
        before[-1][1:] = before[-2][:-1]
        before[-1][starts] = 0
    fold = (np.arange(SIGNS) * 0x9E37 >> 4) % FOLD << 16
    cells = (before[1] + (before[2] << 8) + fold.astype(np.int32)[before[3]]) * SIGNS + sign
    place = np.arange(n) - np.repeat(starts, sizes)
    odd = (np.arange(sizes.max(initial=0), dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
    mixed = (cells.astype(np.uint64) + np.uint64(1)) * (odd * np.uint64(0x9E3779B97F4A7C15))[place]
    mixed ^= mixed >> np.uint64(29)
    return cells, starts, np.add.reduceat(mixed, starts) if n else mixed


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different cells, in no order, and the place of each cell among them."""
    coded = pc.dictionary_encode(pa.array(cells))
    return coded.dictionary.to_numpy().astype(np.int64), coded.indices.to_numpy()


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes before all second ones."""
    values = np.ascontiguousarray(values)
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_words(words: list[bytes] | pa.Array) -> bytes:
    # No word holds a blank; the end is the empty word.
    if isinstance(words, list):
        return zstandard.compress(b" ".join(words), 1)
    return zstandard.compress(pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py(), 1)


def _unpack_words(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split(b" ")


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _pair_keys(context: np.ndarray, dish: np.ndarray) -> np.ndarray:
    """64 bits for each pair of hashes, order counts."""
    x = context * np.uint64(0x9E3779B97F4A7C15) + (dish ^ (dish >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _buckets(keys: np.ndarray, order: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The places, in the order of the keys, of each bucket that has any."""
    bucket = (keys[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    used, starts = np.unique(bucket, return_index=True)
    return [(int(b), slice(s, e)) for b, s, e in zip(used, starts, [*starts[1:], len(keys)])]


def average_tables(customers: np.ndarray, discount: float) -> np.ndarray:
    """About how many tables so many customers open in the restaurant of a context whose dishes are all different."""
    x = CONTEXT_STRENGTH + customers + (discount - 1) / 2
    n = CONTEXT_STRENGTH / discount * (gamma(CONTEXT_STRENGTH) / gamma(CONTEXT_STRENGTH + discount) * x**discount - 1)
    return np.clip(np.rint(n), np.minimum(customers, 1), customers).astype(np.int64)


def _in_arrow(schema: str):
    return to_arrow_schema(StructType.fromDDL(schema))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, ``PIECE`` bytes of text at a time or one text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def _tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All tokens of texts, and the number of each text's.

    These are the words of ``raw`` and one end, which is the empty word that stands after the blank added.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.binary_join_element_wise(texts.fill_null(""), "", " ")))
    words, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    # A text that starts with a blank has an empty word before it, too.
    more = (pc.binary_length(words.take(pa.array(starts))).to_numpy() == 0) & (sizes > 1)
    if more.any():
        words = words.take(pa.array(np.delete(np.arange(len(words)), starts[more])))
    return words.cast(pa.binary()).dictionary_encode(), sizes - more


def _joined(tokens: list[pa.DictionaryArray]) -> pa.DictionaryArray:
    parts = pa.chunked_array(tokens).unify_dictionaries().chunks
    return pa.DictionaryArray.from_arrays(np.concatenate([p.indices.to_numpy() for p in parts]), parts[0].dictionary)


def _chunks(docs: DataFrame, train: Column, id_column: str, text_column: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), (~train).alias("held"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        ids, held, lengths, tokens, size, distinct = [], [], [], [], 0, 0

        def chunk() -> pa.RecordBatch:
            whole = _joined(tokens)
            words, every, taught = whole.dictionary, whole.indices.to_numpy(), np.repeat(~np.array(held), lengths)
            counts = np.bincount(every[taught], minlength=len(words)).astype("<i8")
            pairs, pair_counts = _counted(_keys(every, np.array(lengths), words.index(b"").as_py()), taught)
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([_pack(every)], pa.binary()),
                pa.array([_pack_words(words)], pa.binary()), pa.array([_pack(counts)], pa.binary()),
                pa.array([_pack(np.diff(pairs, prepend=0))], pa.binary()),
                pa.array([_pack(pair_counts)], pa.binary()),
                pa.array([len(every)], pa.int64()), pa.array([len(words)], pa.int64())],
                ["chunk", "ids", "held", "lengths", "tokens", "words", "counts", "pairs", "pair_counts", "n_tokens", "n_words"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for piece in _pieces(batch):
                coded, sizes = _tokens(piece.column(1))
                some_ids, some_held, ends, low = piece.column(0).to_pylist(), piece.column(2).to_pylist(), np.cumsum(sizes), 0
                while low < len(sizes):
                    start = int(ends[low] - sizes[low])
                    # To the text that fills the chunk.
                    high = min(int(np.searchsorted(ends, start + CHUNK_TOKENS - size)) + 1, len(sizes))
                    part = coded.slice(start, int(ends[high - 1]) - start)
                    if len(part) < len(coded):
                        part = part.dictionary_decode().dictionary_encode()  # no words but its own
                    ids += some_ids[low:high]
                    held += some_held[low:high]
                    lengths += sizes[low:high].tolist()
                    tokens.append(part)
                    size, distinct, low = size + len(part), distinct + len(part.dictionary), high
                    if distinct >= CHUNK_WORDS:
                        tokens = [_joined(tokens)]
                        distinct = len(tokens[0].dictionary)
                    if size >= CHUNK_TOKENS or distinct >= CHUNK_WORDS:
                        yield chunk()
                        ids, held, lengths, tokens, size, distinct, made = [], [], [], [], 0, 0, made + 1
        if ids:
            yield chunk()

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, lengths array<bigint>, "
                                "tokens binary, words binary, counts binary, pairs binary, pair_counts binary, "
                                "n_tokens long, n_words long")


def _keys(tokens: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """For each token of texts its pair, context before dish."""
    before = np.roll(tokens, 1).astype(np.int64)
    before[np.cumsum(lengths) - lengths] = end
    return before << 32 | tokens


def _counted(keys: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in rising order, and how often each is taught."""
    every = np.sort(keys << 1 | taught)
    first = np.flatnonzero(np.diff(every >> 1, prepend=-1))
    return every[first] >> 1, np.add.reduceat(every & 1, first).astype("<i4")


class Chunk:
    """The words of a chunk and its distinct pairs, by context and dish."""

    def __init__(self, row: dict):
        self.words = _unpack_words(row["words"])
        pairs = np.cumsum(_unpack(row["pairs"], "<i8"))
        self.context, self.dish = pairs >> 32, pairs & 0xFFFFFFFF
        self.hashes = _hashes(self.words)
        self.keys = _pair_keys(self.hashes[self.context], self.hashes[self.dish])


CHUNK_COLUMNS = ("chunk", "words", "pairs")


class Answers:
    """What buckets say of a chunk's pairs (kind 0) and words (kind 1), in the chunk's own order."""

    def __init__(self, rows: list[dict], chunk: Chunk):
        self.rows = sorted(rows, key=lambda r: (r["kind"], r["bucket"]))
        # Pairs of equal keys have equal answers; words of equal hashes do not.
        self.orders = [np.argsort(chunk.keys), np.argsort(chunk.hashes, kind="stable")]
        told = self.get(0, "a", "<i8")
        self.total, self.mine = told >> 1, (told & 1).astype(bool)
        self.counts, self.tables, self.parent = self.get(1, "a", "<i8"), self.get(1, "b", "<i8"), self.get(1, "c", "<f4")

    def get(self, kind: int, column: str, dtype: str) -> np.ndarray:
        out = np.empty(len(self.orders[kind]), dtype)
        out[self.orders[kind]] = np.concatenate([_unpack(r[column], dtype) for r in self.rows if r["kind"] == kind])
        return out


def _pair_totals(chunks: DataFrame, buckets: int) -> DataFrame:
    """``chunk, bucket, a, once, twice``: twice the training count of each pair of a chunk, odd where the chunk is its first."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                n = _unpack(row["pair_counts"], "<i4").astype("<i8")
                order = np.argsort(chunk.keys)
                found = _buckets(chunk.keys, order, buckets)
                for bucket, s in found:
                    steps = np.diff(chunk.keys[order[s]], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_pylist([{"bucket": bucket, "chunk": row["chunk"], "steps": _pack(steps),
                                                       "n": _pack(n[order[s]])}], part)

    def combine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(_unpack(r["steps"], "<u8"), dtype=np.uint64) for r in rows]
        n = np.concatenate([_unpack(r["n"], "<i8") for r in rows])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=n).astype("<i8")
        taught, first = np.flatnonzero(n), np.full(len(total), len(n))
        np.minimum.at(first, at[taught], taught)
        told = total[at] * 2
        told[first[total > 0]] += 1
        told = np.split(told, np.cumsum([len(k) for k in keys])[:-1])
        once, twice = int((total == 1).sum()), int((total == 2).sum())
        return pa.Table.from_pylist([
            {"chunk": r["chunk"], "bucket": r["bucket"], "a": _pack(t), "once": 0 if i else once, "twice": 0 if i else twice}
            for i, (r, t) in enumerate(zip(rows, told))], out)

    part, out = _in_arrow("bucket int, chunk long, steps binary, n binary"), _in_arrow(
        "chunk long, bucket int, a binary, once long, twice long")
    return chunks.select(*CHUNK_COLUMNS, "pair_counts").mapInArrow(parts, "bucket int, chunk long, steps binary, n binary").groupBy(
        "bucket").applyInArrow(combine, "chunk long, bucket int, a binary, once long, twice long")


#: A bucket of the vocabulary: its words, their training counts, tables as contexts and customers as dishes, the
#: chunks that have any of them and which; and totals of the customers.
VOCABULARY = ("bucket int, words binary, counts binary, tables binary, customers binary, chunks array<bigint>, "
              "places array<binary>, n long, known long, once long, twice long")


def _totals(customers: np.ndarray) -> dict:
    return {"customers": _pack(customers), "n": int(customers.sum()), "known": int((customers > 0).sum()),
            "once": int((customers == 1).sum()), "twice": int((customers == 2).sum())}


def _vocabulary(chunks: DataFrame, buckets: int) -> DataFrame:
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _unpack_words(row["words"]), _unpack(row["counts"], "<i8")
                hashes = _hashes(words)
                order = np.argsort(hashes, kind="stable")
                found = _buckets(hashes, order, buckets)
                for bucket, s in found:
                    yield pa.RecordBatch.from_pylist([{
                        "bucket": bucket, "chunk": row["chunk"], "words": _pack_words([words[i] for i in order[s].tolist()]),
                        "counts": _pack(counts[order[s]])}], part)

    def combine(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        words = [_unpack_words(r["words"]) for r in rows]
        coded = pc.dictionary_encode(pa.array(chain.from_iterable(words), pa.binary()))
        at = coded.indices.to_numpy().astype("<i4")
        n = np.bincount(at, weights=np.concatenate([_unpack(r["counts"], "<i8") for r in rows])).astype("<i8")
        places = np.split(at, np.cumsum([len(w) for w in words])[:-1])
        return pa.Table.from_pylist([{
            "bucket": rows[0]["bucket"], "words": _pack_words(coded.dictionary), "counts": _pack(n), "tables": None,
            "chunks": [r["chunk"] for r in rows], "places": list(map(_pack, places)), **_totals(n)}], out)

    part, out = _in_arrow("bucket int, chunk long, words binary, counts binary"), _in_arrow(VOCABULARY)
    return chunks.select("chunk", "words", "counts").mapInArrow(
        parts, "bucket int, chunk long, words binary, counts binary").groupBy("bucket").applyInArrow(combine, VOCABULARY)


class Model:
    """What a task needs: totals and the spellings of all sweeps."""

    def __init__(self, customers: int, discount: float, sweeps: int):
        self.customers, self.discount, self.sweeps, self.tables, self.spellings = customers, discount, sweeps, [], []
        #: By sweep, what the spelling gives to all known words together.
        self.known_share: list[float] = []

    def told(self, *sweeps: int) -> Model:
        """The model with the spellings of these sweeps alone."""
        out = copy(self)
        out.spellings = [s if i in sweeps else None for i, s in enumerate(self.spellings)]
        return out

    def base(self, found: np.ndarray, at: np.ndarray, starts: np.ndarray, sweep: int) -> np.ndarray:
        """Of words whose cells are ``found[at]``; each different cell is looked up once."""
        return np.exp(np.add.reduceat(np.log(self.spellings[sweep].probability(found, 3))[at], starts))

    def sit(self, count: np.ndarray, dish: np.ndarray, base: np.ndarray, sweep: int) -> np.ndarray:
        opening = (STRENGTH + self.discount * self.tables[sweep - 1]) * base
        return seat(count, opening, self.discount, dish, sweep)

    def predictive(self, words: pa.Array, count: np.ndarray) -> np.ndarray:
        cells, starts, dish = spell(words)
        found, at = _distinct(cells)
        total = np.zeros(len(count))
        base = self.base(found, at, starts, BURN)
        for sweep in range(BURN + 1, self.sweeps + 1):
            tables = self.sit(count, dish, base, sweep)
            base = self.base(found, at, starts, sweep)
            outcome = np.where(count > 0, base, max(1 - self.known_share[sweep], 1e-9))
            new = (STRENGTH + self.discount * self.tables[sweep]) * outcome
            total += (count - self.discount * tables + new) / (STRENGTH + self.customers)
        return total / (self.sweeps - BURN)


def _sliced(row: dict) -> Iterator[tuple[pa.Array, np.ndarray]]:
    words, customers = _unpack_words(row["words"]), _unpack(row["customers"], "<i8").astype(float)
    for s in range(0, len(words), SLICE):
        yield pa.array(words[s:s + SLICE], pa.binary()), customers[s:s + SLICE]


def _sweep(vocabulary: DataFrame, model: Model, sweep: int) -> None:
    """Seats all words and appends their number of tables and the spellings of these to the model.

    The pass after the last sweep only adds up what the last spelling gives to known words.
    """
    shared, last = vocabulary.sparkSession.sparkContext.broadcast(model.told(sweep - 1)), sweep > model.sweeps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen, tables, share = shared.value, [np.zeros((0, 2))], 0.0, 0.0
        for words, count in (x for batch in batches for row in batch.to_pylist() for x in _sliced(row)):
            cells, starts, dish = spell(words)
            found, at = _distinct(cells)
            base = m.base(found, at, starts, sweep - 1) if sweep else np.zeros(len(count))
            share += base[count > 0].sum()
            if last:
                continue
            t = m.sit(count, dish, base, sweep) if sweep else np.minimum(count, 1)
            tables += t.sum()
            seen.append(np.column_stack([found, np.bincount(at, weights=np.repeat(t, np.diff(np.r_[starts, len(cells)])))]))
            if len(seen) > 16:
                seen = [_merge(seen)]
        found = _merge(seen)
        found = found[found[:, 1] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, found[:, 0]].astype(np.int64)),
                                          pa.array(np.r_[share, tables, found[:, 1]])], ["cell", "n"])

    found = vocabulary.select("words", "customers").mapInArrow(run, "cell long, n double").groupBy("cell").agg(
        F.sum("n").alias("n")).orderBy("cell").toPandas()
    shared.destroy()
    if sweep:
        model.known_share.append(float(found.loc[found["cell"] == -2, "n"].sum()))
    if last:
        return
    spelled = found[found["cell"] >= 0]
    model.tables.append(float(found.loc[found["cell"] == -1, "n"].sum()))
    model.spellings.append(Spelling(spelled["cell"].to_numpy(), spelled["n"].to_numpy(), sweep,
                                    model.spellings[-1] if sweep else None))


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    every = np.concatenate(parts)
    cells, at = np.unique(every[:, 0], return_inverse=True)
    return np.column_stack([cells, np.bincount(at, weights=every[:, 1], minlength=len(cells))])


def _discount(once: int, twice: int) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.05), 0.95)


def _fit(vocabulary: DataFrame, sweeps: int, before: Model | None = None) -> tuple[Model, int, int]:
    """The model of the words, and the numbers of customers and of known words.

    A fit starts from one table per known word; so does that ``before`` over the same words, whose start is taken.
    """
    n, known, once, twice = vocabulary.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "known", "once", "twice"))).first()
    model = Model(n, _discount(once, twice), sweeps)
    if before:
        model.tables, model.spellings = before.tables[:1], before.spellings[:1]
    # One more than is averaged tells what the last spelling gives to known words.
    for sweep in range(len(model.tables), sweeps + 2):
        _sweep(vocabulary, model, sweep)
    return model, n, known


ANSWERS = "chunk long, kind int, bucket int, a binary, b binary, c binary"


def _of_words(vocabulary: DataFrame, model: Model, discount: float, first: bool) -> tuple[DataFrame, Broadcast]:
    """To every chunk, of its words: training count, tables as a context and probability; and the model shared for it."""
    shared, out = vocabulary.sparkSession.sparkContext.broadcast(model.told(*range(BURN, model.sweeps + 1))), _in_arrow(ANSWERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = _unpack(row["counts"], "<i8")
                tables = average_tables(counts, discount) if first else _unpack(row["tables"], "<i8")
                p = np.concatenate([shared.value.predictive(w, n) for w, n in _sliced(row)]).astype("<f4")
                for chunk, packed in zip(row["chunks"], row["places"]):
                    at = _unpack(packed, "<i4")
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk, "kind": 1, "bucket": row["bucket"], "a": _pack(counts[at]),
                                                       "b": _pack(tables[at]), "c": _pack(p[at])}], out)

    return vocabulary.mapInArrow(run, ANSWERS), shared


def _seated(chunks: DataFrame, answers: DataFrame, buckets: int, discount: float, sweep: int) -> DataFrame:
    """Tables of all pairs of a chunk (kind 2), and their sums by context and by dish for each bucket of words (kind 1)."""
    def sit(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        chunk = Chunk(row)
        told = Answers(right.to_pylist(), chunk)
        opening = (CONTEXT_STRENGTH + discount * told.tables[chunk.context]) * told.parent[chunk.dish].astype(float)
        t = seat(told.total.astype(float), opening, discount, chunk.keys, sweep).astype("<i8")
        mine, n = told.mine, len(chunk.words)
        sums = [np.bincount(x[mine], weights=t[mine], minlength=n).astype("<i8") for x in (chunk.context, chunk.dish)]
        order = told.orders[1]
        found = _buckets(chunk.hashes, order, buckets)
        rows = [{"chunk": row["chunk"], "kind": 1, "bucket": b, "a": _pack(sums[0][order[s]]), "b": _pack(sums[1][order[s]])}
                for b, s in found]
        return pa.Table.from_pylist([*rows, {"chunk": row["chunk"], "kind": 2, "bucket": 0, "a": _pack(t)}], out)

    out = _in_arrow(ANSWERS)
    return chunks.select(*CHUNK_COLUMNS).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sit, ANSWERS)


def _reseated(vocabulary: DataFrame, sums: DataFrame) -> DataFrame:
    """The vocabulary with the tables and customers of a sweep over the pairs."""
    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        places = dict(zip(row["chunks"], row["places"]))
        size = len(_unpack(row["counts"], "<i8"))
        tables, customers = np.zeros(size, "<i8"), np.zeros(size, "<i8")
        for r in right.to_pylist():
            at = _unpack(places[r["chunk"]], "<i4")
            tables[at] += _unpack(r["a"], "<i8")
            customers[at] += _unpack(r["b"], "<i8")
        return pa.Table.from_pylist([row | {"tables": _pack(tables)} | _totals(customers)], out)

    out = _in_arrow(VOCABULARY)
    return vocabulary.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(add, VOCABULARY)


def score(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.

    Learns from rows where ``train`` holds. ``n_known`` counts tokens that occur
    in training, ``base_score`` is the smoothed unigram score, ``score`` the
    model's; both are log10 probabilities. Null and empty texts are one end.
    Without training rows nothing is known and any word is the one unknown outcome. Rows are
    scored one by one, repeated ones and those with null ids too; an empty table gives no rows.
    """
    chunks = written(_chunks(docs, train, id_column, text_column), "chunks")
    words, tokens = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens"))).first()
    buckets = max(1, -(-words // BUCKET_WORDS))
    vocabulary = written(_vocabulary(chunks, buckets), "vocabulary")
    totals = written(_pair_totals(chunks, max(1, -(-tokens // BUCKET_TOKENS))), "pairs")
    discount = _discount(*totals.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("once", "twice"))).first())
    none = F.lit(None).cast("binary")
    pairs = totals.select("chunk", F.lit(0).alias("kind"), "bucket", "a", none.alias("b"), none.alias("c"))
    model, n, known = _fit(vocabulary, FIRST_SWEEPS)
    answers, shared = _of_words(vocabulary, model, discount, first=True)
    for sweep in range(1, PAIR_SWEEPS + 1):
        seats = written(_seated(chunks, pairs.unionByName(answers), buckets, discount, sweep), "seats")
        shared.destroy()
        vocabulary = written(_reseated(vocabulary, seats.where("kind = 1")), "vocabulary")
        model, _, _ = _fit(vocabulary, SWEEPS, model)
        answers, shared = _of_words(vocabulary, model, discount, first=False)
    whole = np.log10(n + 0.1 * (known + 1))
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, row = right.to_pylist(), left.drop_columns("ids").to_pylist()[0]
        chunk = Chunk(row)
        of, lengths = _unpack(row["tokens"], "<i4"), np.array(row["lengths"], np.int64)
        _, at = np.unique(_keys(of, lengths, chunk.words.index(b"")), return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        told = Answers([r for r in rows if r["kind"] < 2], chunk)
        tables = _unpack(next(r["a"] for r in rows if r["kind"] == 2), "<i8")
        passed = (CONTEXT_STRENGTH + discount * told.tables[chunk.context]) * told.parent[chunk.dish].astype(float)
        p = (told.total - discount * tables + passed) / (CONTEXT_STRENGTH + told.counts[chunk.context])
        c = told.counts
        return pa.table({
            "id": left.column("ids").combine_chunks().flatten(), "held_out": np.array(row["held"], bool), "n_tokens": lengths,
            "n_known": np.add.reduceat((c > 0).astype(np.int64)[of], starts), "train_tokens": np.full(len(starts), n),
            "base_score": np.add.reduceat((np.log10(c + 0.1) - whole)[of], starts),
            "score": np.add.reduceat(np.log10(p)[at], starts)})

    return chunks.select("ids", "held", "lengths", "tokens", *CHUNK_COLUMNS).groupBy("chunk").cogroup(
        pairs.unionByName(answers).unionByName(seats.where("kind = 2")).groupBy("chunk")).applyInArrow(
        add, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
             "score double").withColumnRenamed("id", id_column)

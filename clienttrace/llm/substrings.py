"""Removal of repeated word sequences by suffix automata of reference shards.

A window is ``length`` consecutive words. Every window is tied to the smallest
hash among its ``GRAM``-word grams, its anchor; consecutive windows with the
same anchor occurrence are a stretch. Equal windows have equal anchors, so
windows are only looked for among stretches of one anchor. All of this is done on
numbers first; texts are met again only where words are needed.

Equal stretches (one anchor, one digest) are one passage, combined before the
shuffle: all windows of its later places start earlier, at its first place. The
first places of anchors with several passages go to reference shards by anchor,
with about ``shard_words`` words each. A shard is one task's suffix automaton
over words: passages stream past it in the order of their places for matching
statistics, that is the longest match ending at each word. A match of ``length``
words or more is a window that starts earlier. Then the passage joins the
reference. The corpus is its own reference here and grows with the input, so
shards are met by key and not broadcast whole to every task.

An anchor with more than ``crowd`` passages (a phrase in ever other
surroundings) would outgrow a shard. Its windows become passages of one window
each and are spread by their digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clienttrace.llm.common import columns, written

LENGTH = 20
GRAM = 5
CROWD = 4_000
SHARD_WORDS = 150_000
#: Odd factors of the hashes.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MIX_INVERSE = np.uint64(pow(int(MIX), -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    """Unchanged words, cut at blanks and 09-0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def stretches(words: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and digests of a document's stretches; the first window of each and one past the last."""
    windows = len(words) - length + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * FACTOR + hashes[i:len(words) - GRAM + 1 + i]
    grams ^= grams >> np.uint64(31)
    grams *= MIX
    grams ^= grams >> np.uint64(29)
    width = length - GRAM + 1
    at = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    bounds = np.r_[first, windows]
    # The words of a stretch as a polynomial, by differences of running sums; its factor is odd and can be divided by.
    powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(words), MIX)])
    sums = np.r_[np.uint64(0), np.add.accumulate((hashes ^ (hashes >> np.uint64(32))) * powers[:-1])]
    inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(first[-1]), MIX_INVERSE)])
    digests = (sums[bounds[1:] + length - 1] - sums[first]) * inverse[first] + (bounds[1:] - first).astype(np.uint64)
    return grams[at[first]].view(np.int64), digests.view(np.int64), bounds


def _rows(columns_of: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_of, kinds)], names)


def _stretches(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, print, anchors, digests, starts`` of every document long enough for a window; starts end with the windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(words_of(t), length) for t in batch.column(2).to_pylist()]
            lists = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int64()))]
            starts = pa.array([f[2].astype(np.int32) for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, starts],
                                             ["doc_id", "print", "anchors", "digests", "starts"]).filter(
                pa.array([len(f[0]) > 0 for f in found], pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, print long, anchors array<long>, digests array<long>, starts array<int>")


def _passages(docs: DataFrame, length: int) -> DataFrame:
    """The picked stretches (``2 * number``, plus 1 where the anchor is crowded) of documents: whole, or each window.

    A window's ``anchor`` is null, its digest stands for its words.
    """
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "print", "start", "anchor", "h1", "h2", "words"]
    kinds = [to_arrow_type(kind), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, text, picks in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                anchors, _, bounds = stretches(words, length)
                for pick in picks:
                    i, low, high = pick >> 1, int(bounds[pick >> 1]), int(bounds[(pick >> 1) + 1])
                    if not pick & 1:
                        passage = b" ".join(words[low:high + length - 1]).decode("utf-8", "replace")
                        out.append((doc, mark, low, int(anchors[i]), None, None, passage))
                        continue
                    for start in range(low, high):
                        digest = xxhash.xxh3_128_digest(b" ".join(words[start:start + length]))
                        h1, h2 = (int.from_bytes(digest[k:k + 8], "little", signed=True) for k in (0, 8))
                        out.append((doc, mark, start, None, h1, h2, None))
                if len(out) > 20_000:
                    yield _rows(list(zip(*out)), kinds, names)
                    out = []
            if out:
                yield _rows(list(zip(*out)), kinds, names)

    return docs.mapInArrow(run, f"doc_id {kind.simpleString()}, print long, start int, anchor long, h1 long, h2 long, words string")


class Automaton:
    """A suffix automaton over words, to which passages are added one after the other."""

    def __init__(self) -> None:
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]

    def matches(self, words: list[str], length: int) -> int:
        """Bits of the windows of ``length`` words that occur in the passages so far."""
        steps, link, size = self.steps, self.link, self.size
        state = long = bits = 0
        for end, word in enumerate(words, 1 - length):
            step = steps[state]
            while word not in step and state:
                state = link[state]
                long, step = size[state], steps[state]
            if word in step:
                state, long = step[word], long + 1
                if long >= length:
                    bits |= 1 << end
        return bits

    def _split(self, state: int, word: str, to: int) -> int:
        """A state for the shorter matches of ``to``."""
        steps, link, size = self.steps, self.link, self.size
        steps.append(dict(steps[to]))
        link.append(link[to])
        size.append(size[state] + 1)
        new = len(size) - 1
        while state >= 0 and steps[state].get(word) == to:
            steps[state][word] = new
            state = link[state]
        link[to] = new
        return new

    def add(self, words: list[str]) -> None:
        steps, link, size, last = self.steps, self.link, self.size, 0
        for word in words:
            to = steps[last].get(word)
            if to is not None:
                last = to if size[to] == size[last] + 1 else self._split(last, word, to)
                continue
            steps.append({})
            size.append(size[last] + 1)
            link.append(0)
            new, state = len(size) - 1, last
            while state >= 0 and word not in steps[state]:
                steps[state][word] = new
                state = link[state]
            if state >= 0:
                to = steps[state][word]
                link[new] = to if size[to] == size[state] + 1 else self._split(state, word, to)
            last = new


def _matched(passages: DataFrame, length: int) -> DataFrame:
    """``doc_id, print, start, bits`` of passages (with ``shard``): their windows that start earlier."""
    kind = passages.schema["doc_id"].dataType

    def run(table: pa.Table) -> pa.Table:
        docs, prints, starts, texts = (table.column(n).to_pylist() for n in ("doc_id", "print", "start", "words"))
        # Nulls first, as Spark orders places.
        order = sorted(range(len(docs)), key=lambda i: (docs[i] is not None, 0 if docs[i] is None else docs[i], prints[i], starts[i]))
        reference, bits, before = Automaton(), [0] * len(docs), None
        for i in order:
            if before is not None and (docs[i], prints[i], starts[i]) == (docs[before], prints[before], starts[before]):
                bits[i] = bits[before]  # a repeated row
                continue
            words = texts[i].split(" ")
            bits[i], before = reference.matches(words, length), i
            reference.add(words)
        return table.select(["doc_id", "print", "start"]).append_column("bits", pa.array(bits, pa.int64()))

    return passages.select("shard", "doc_id", "print", "start", "words").groupBy("shard").applyInArrow(
        run, f"doc_id {kind.simpleString()}, print long, start int, bits long").where("bits != 0")


def repeated(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, print, found``: per document the words to remove, as pairs of first word and one past the last.

    ``docs`` has ``doc_id, print, text``; ``print`` tells apart texts of one id.
    """
    if not GRAM < length < GRAM + 63:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 62}")
    laid = written(_stretches(docs, length), "stretches")
    places = laid.select("doc_id", "print", "starts", F.posexplode(F.arrays_zip("anchors", "digests")).alias("at", "s")).select(
        "doc_id", "print", "at", "s.*", F.col("starts")[F.col("at")].alias("start"),
        (F.col("starts")[F.col("at") + 1] - F.col("starts")[F.col("at")]).alias("windows"))
    passages = written(places.groupBy("anchors", "digests").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "print", "at")).alias("first")), "passages")
    # Anchors with several passages; one alone has nothing to match.
    contested = written(passages.groupBy("anchors").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "anchors", (F.col("n") > crowd).cast("int").alias("crowded")), "contested")
    picks = written(passages.join(contested, "anchors").groupBy(F.col("first.doc_id").alias("of_id"), F.col("first.print").alias("of_print")).agg(
        F.collect_set(F.col("first.at") * 2 + F.col("crowded")).alias("picks")), "picks")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print"))
    met = written(_passages(docs.join(picks, same).select("doc_id", "print", "text", "picks"), length), "met")
    whole, single = met.where("anchor is not null"), met.where("anchor is null")
    total = whole.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 0
    matched = _matched(whole.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(total // shard_words + 1))), length)

    def later(rows: DataFrame, earliest: DataFrame, keys: list[str], place: str, bits: str) -> DataFrame:
        """Rows of a passage that do not lie at its earliest place."""
        known = earliest.select(*(F.col(k).alias(f"_{k}") for k in keys), "first")
        here = F.struct("doc_id", "print", F.col(place).cast("int").alias(place))
        return rows.join(known, [F.col(k) == F.col(f"_{k}") for k in keys]).where(~here.eqNullSafe(F.col("first"))).select(
            "doc_id", "print", "start", F.expr(bits).alias("bits"))

    copies = later(places, passages.where("copies > 1"), ["anchors", "digests"], "at", "shiftleft(1L, windows) - 1")
    windows = single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "print", "start")).alias("first"))
    crowded = later(single, windows.where("copies > 1"), ["h1", "h2"], "start", "1L")
    found = matched.unionByName(copies).unionByName(crowded).groupBy("doc_id", "print").agg(
        F.collect_set(F.struct("start", "bits")).alias("found"))
    return found.select("doc_id", "print", _spans(length)("found").alias("found"))


def _spans(length: int):
    @F.arrow_udf("array<int>")
    def spans(found: pa.Array) -> pa.Array:
        out = []
        for list_of in found.to_pylist():
            starts = np.array([f["start"] for f in list_of], np.int64)
            bits = np.unpackbits(np.array([f["bits"] for f in list_of], "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, k = np.nonzero(bits)
            windows = np.unique(starts[at] + k)
            cut = np.flatnonzero(np.diff(windows) > length)
            out.append(np.stack([windows[np.r_[0, cut + 1]], windows[np.r_[cut, len(windows) - 1]] + length], 1).ravel().tolist())
        return pa.array(out, pa.list_(pa.int32()))
    return spans


def kept(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, shard_words: int = SHARD_WORDS,
         id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` per row: its words, how many go, and the text left, joined by one blank.

    Places are ordered by id, null ids first; texts of one id by a hash of the
    text. Repeated rows (equal id and text) are one document and fare alike.
    Null and empty texts have no words; texts shorter than a window stay as they
    are; an empty table gives no rows; other columns are not read.
    """
    rows = columns(docs, id_column, text_column).toDF("doc_id", "text").withColumn("print", F.xxhash64("text")).select("doc_id", "print", "text")
    found = written(repeated(rows, length, crowd, shard_words).select(
        F.col("doc_id").alias("of_id"), F.col("print").alias("of_print"), "found"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("print") == F.col("of_print"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, left = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text)
                total.append(len(words))
                if spans:
                    ends = [0, *spans, len(words)]
                    words = [w for low, high in zip(ends[::2], ends[1::2]) for w in words[low:high]]
                gone.append(total[-1] - len(words))
                left.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.join(found, same, "left").select("doc_id", "text", "found").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept string")
    return made.withColumnRenamed("doc_id", id_column)


def digests(left: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The texts of ``kept`` by their SHA-256."""
    return left.select(id_column, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

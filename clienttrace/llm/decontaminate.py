"""Benchmark passages in documents, by TF-IDF retrieval and an ordered comparison.

1. Documents are read once: every word that occurs in a benchmark item becomes
   its term number, any other -1. Only these numbers are kept (written to the
   shared folder) and used from then on. A sign of a script without blanks
   (``SIGNS``) is a word.
2. Passages are blocks of ``BLOCK`` words; a term's weight is its inverse
   passage frequency over all of them.
3. Every passage of two blocks (overlapping by one) is compared with all item
   passages by the share of the item passage's weight that it holds. It does not
   depend on the other words of either, and stays below that of a changed copy at the
   worst alignment (``LEAST_SHARE``). For each term the largest share it has in any
   item is known; passages which with these cannot reach it are passed over.
   ``cosine`` is the TF-IDF cosine of the best of them.
4. Of a candidate the longest common subsequence of item and surroundings is
   found. It counts as contaminated if it covers ``COPY`` of the item's words;
   or ``PARAPHRASE`` of them while its answer (the last quarter) is covered by ``ANSWER``.
5. An item of fewer than ``LEAST_WORDS`` words is no passage; it is contained where
   its words stand consecutively. Below ``LEAST_BYTES`` letters, where this could
   be any phrase of the language, the document must consist of nothing else.

Passages of a document stay in its task: after the statistics nothing is
shuffled. The benchmark is the stated query set; it is taken in blocks of about
``ITEM_WORDS`` words, each held by every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clienttrace.llm.common import columns, map_texts, written

BLOCK = 8
#: Words of the items in a block; bounds the terms.
ITEM_WORDS = 10_000
LEAST_WORDS = 8
#: UTF-8 bytes of a short item's words together, from which it is looked for inside documents.
LEAST_BYTES = 16
COPY = 0.7
PARAPHRASE = 0.55
ANSWER = 0.8
#: Of an item passage's weight. PARAPHRASE of the words at the worst alignment, 12 of 16, is 0.41
#: on average; the rest is for words of unequal weight.
LEAST_SHARE = 0.25
#: Words summed at a time, a multiple of a passage; bounds the memory of a task.
SLICE = 1 << 18

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Thai, Lao, Burmese, Khmer, kana, ideographs and wide forms: as characters, and as UTF-8.
SIGNS = r"\x{E00}-\x{EFF}\x{1000}-\x{10BF}\x{1780}-\x{17FF}\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFFF}\x{20000}-\x{33FFF}"
_SIGN = re.compile(rb"(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|[\xe3-\xe9][\x80-\xbf]|\xef[\xa4-\xab\xbc-\xbf])[\x80-\xbf]"
                   rb"|\xf0[\xa0-\xb3][\x80-\xbf]{2}")
_NO_LEAD = bytes(sorted(set(range(256)) - {0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0}))


def split_words(text: str | None) -> list[bytes]:
    """The words of a whole text: runs of letters and digits, A-Z in lower case, and single signs."""
    folded = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES) if text else b""
    # Most texts have none of the first bytes of a sign.
    if folded.translate(None, _NO_LEAD):
        folded = _SIGN.sub(rb" \g<0> ", folded)
    return folded.split()


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; bit-parallel over ``a``. -1 matches nothing."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    where.pop(-1, None)
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if m := where.get(x):
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class Benchmark:
    """One block of items: their terms, and later the weights."""

    def __init__(self, items: list[tuple[int, str]]):
        found = [(i, w) for i, w in ((i, split_words(t)) for i, t in items) if w]
        self.ids = [i for i, _ in found]
        self.number = {w: n for n, w in enumerate(sorted({w for _, words in found for w in words}))}
        self.terms = len(self.number)
        self.items = [self.numbers(words) for _, words in found]
        #: Items that are looked for word by word, and whether a document may hold other words too.
        self.short = {k: sum(map(len, words)) >= LEAST_BYTES for k, (_, words) in enumerate(found) if len(words) < LEAST_WORDS}
        #: Item passages: (item, its terms); long items are cut like documents.
        self.passages = [(k, item[s:s + 2 * BLOCK]) for k, item in enumerate(self.items) if k not in self.short
                         for s in range(0, max(1, len(item) - BLOCK), BLOCK)]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The term number of each word, -1 for words of no item."""
        number = self.number
        return np.fromiter((number.get(w, -1) for w in words), "<i4", len(words))

    def weigh(self, df: np.ndarray, n: int) -> None:
        # A short item is looked for at the places of its rarest term.
        self.rarest: dict[int, list[tuple[int, int]]] = {}
        self.opens = np.zeros(self.terms + 1, bool)
        for k in self.short:
            at = int(np.argmin(df[self.items[k]]))
            self.rarest.setdefault(int(self.items[k][at]), []).append((k, at))
            self.opens[self.items[k][at]] = True
        self.idf = np.log((1 + n) / (1 + df))
        rows = np.zeros((len(self.passages), self.terms))
        for r, (_, t) in enumerate(self.passages):
            np.add.at(rows[r], t, self.idf[t])
        self.norms = np.maximum(np.linalg.norm(rows, axis=1), 1e-12)
        # At the last place stands what is no term (-1): it lengthens a passage and meets no item.
        self.squares = np.append(self.idf, np.median(self.idf) if self.terms else 1.0) ** 2
        # What each word of a term adds to the share of the item passages that have the term.
        shares = (rows * self.idf / self.norms[:, None] ** 2).T
        self.most = np.append(shares.max(axis=1, initial=0.0), 0.0)
        term, self.at = np.nonzero(shares)
        self.adds = shares[term, self.at]
        self.first = np.searchsorted(term, np.arange(self.terms + 1))


def _tokens(docs: DataFrame, bench, id_column: str, text_column: str) -> DataFrame:
    return map_texts(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")),
                     "id", "text", {"terms": pa.binary()},
                     lambda texts: [[bench.value.numbers(split_words(t)).tobytes() for t in texts]])


def _blocks(batch: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Known terms of a batch, the double block each is in, and the number of those; some ``SLICE`` words at a time."""
    size, held = 0, []

    def joined():
        lengths = np.array([len(h) for h in held])
        n = -(-lengths // (2 * BLOCK))
        first = np.concatenate([[0], np.cumsum(n)])
        terms = np.concatenate(held)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block = np.repeat(first[:-1], lengths) + place // (2 * BLOCK)
        return terms[terms >= 0], block[terms >= 0], int(first[-1])

    for packed in batch:
        terms = np.frombuffer(packed, "<i4")
        for start in range(0, len(terms), SLICE):
            held.append(terms[start:start + SLICE])
            size += len(held[-1])
            if size >= SLICE:
                yield joined()
                size, held = 0, []
    if held:
        yield joined()


def _frequencies(tokens: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, passages = np.zeros(terms, np.int64), 0
        for batch in batches:
            for t, block, n in _blocks(batch["terms"]):
                passages += n
                df += np.bincount(np.unique(block * terms + t) % max(terms, 1), minlength=terms)[:terms]
        used = np.flatnonzero(df)
        yield pd.DataFrame({"term": [-1, *used], "n": [passages, *df[used]]})

    found = tokens.select("terms").mapInPandas(run, "term int, n long").groupBy("term").agg(
        F.sum("n").alias("n")).toPandas()
    df = np.zeros(terms + 1)
    df[found["term"]] = found["n"]
    return df[:terms], int(df[terms])


def candidates(terms: np.ndarray, b: Benchmark) -> list[tuple[int, int, int, float]]:
    """``(first word, end, item, cosine)`` of the passages of a document that are near an item passage."""
    if not len(terms) or not b.ids:
        return []
    starts = np.arange(0, len(terms), BLOCK)

    def by_passage(values: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(values[terms], starts, axis=0)
        sums[:-1] += sums[1:]
        return sums

    norms = np.sqrt(by_passage(b.squares))
    # A hair less, for the order in which numbers are added up.
    wanted = np.flatnonzero(by_passage(b.most) >= LEAST_SHARE - 1e-9)
    found, width = [], len(b.passages)
    # A slice at a time keeps the sums few.
    for s in range(0, len(wanted), 256):
        w = wanted[s:s + 256]
        inside = (w * BLOCK)[:, None] + np.arange(2 * BLOCK)[None, :]
        t = np.where(inside < len(terms), terms[np.minimum(inside, len(terms) - 1)], -1)
        own = np.nonzero(t >= 0)[0]
        t = t[t >= 0]
        n = b.first[t + 1] - b.first[t]
        spot = np.repeat(b.first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shares = np.bincount(np.repeat(own, n) * width + b.at[spot], b.adds[spot], len(w) * width)
        for hit in np.flatnonzero(shares >= LEAST_SHARE).tolist():
            i, q = divmod(hit, width)
            found.append((int(w[i]) * BLOCK, (int(w[i]) + 2) * BLOCK, b.passages[q][0],
                          float(shares[hit] * b.norms[q] / norms[w[i]])))
    return found


def short_items(terms: np.ndarray, b: Benchmark) -> list[tuple[int, float, float, float, int]]:
    """The short items whose words stand consecutively in a document, with the first such place."""
    out = []
    for term in np.unique(terms[b.opens[terms]]).tolist():
        places = np.flatnonzero(terms == term)
        for k, at in b.rarest[term]:
            item, start = b.items[k], places - at
            start = start[(start >= 0) & (start + len(item) <= len(terms))]
            for j, t in enumerate(item.tolist()):
                start = start[terms[start + j] == t]
            if len(start) and (b.short[k] or len(terms) == len(item)):
                out.append((k, 1.0, 1.0, 1.0, int(start[0])))
    return out


def _verify(terms: np.ndarray, b: Benchmark) -> list[tuple[int, float, float, float, int]]:
    """``(item, cosine, share, answer share, first word)`` of the items a document contains."""
    spans: dict[int, list[list]] = {}
    for start, end, item, near in candidates(terms, b):
        room = len(b.items[item])
        lo, hi = max(0, start - room), min(len(terms), end + room)
        runs = spans.setdefault(item, [])
        # Overlapping surroundings of one item are compared once, but never grow beyond a few items' length.
        if runs and lo <= runs[-1][0] + room:
            runs[-1][1], runs[-1][2] = max(runs[-1][1], hi), max(runs[-1][2], near)
        else:
            runs.append([lo, hi, near])
    out = short_items(terms, b)
    for item, runs in spans.items():
        words, best = b.items[item], None
        tail = words[-max(1, len(words) // 4):]
        for lo, hi, near in runs:
            around = terms[lo:hi]
            share = common_length(words, around) / len(words)
            answer = common_length(tail, around) / len(tail) if share >= PARAPHRASE else 0.0
            if share >= COPY or share >= PARAPHRASE and answer >= ANSWER:
                if best is None or (share, near) > (best[2], best[1]):
                    best = (item, min(near, 1.0), share, answer, lo)
        if best:
            out.append(best)
    return out


def _prepare(docs: DataFrame, items: list[tuple[int, str]], id_column: str, text_column: str):
    """The broadcast benchmark with its weights, and the documents' term numbers."""
    context, b = docs.sparkSession.sparkContext, Benchmark(items)
    tokens = written(_tokens(docs, context.broadcast(b), id_column, text_column), "terms")
    b.weigh(*_frequencies(tokens, b.terms))
    return context.broadcast(b), tokens


def _item_blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of about ``ITEM_WORDS`` words."""
    rows = columns(benchmark, item_column, text_column).toDF("item", "text").where(
        "item is not null and text is not null").distinct()
    signs = F.length(F.regexp_replace("text", f"[^{SIGNS}]", ""))
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")) + signs)).first()[0] or 0
    blocks = max(1, -(-words // ITEM_WORDS))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text")
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``id, item_id, cosine, share, answer_share, first_word``: a row for each item a document contains.

    ``share`` is the part of the item's words found in order, ``first_word``
    where the compared surroundings begin. Documents without a copy, null or
    empty texts and tables give no rows; repeated rows are repeated. Items
    without id, text or any word match nothing. Short items have all three
    measures 1 and ``first_word`` is where they stand.
    """
    kinds = (docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString())
    found = None
    for items in _item_blocks(benchmark, item_column, item_text_column):
        bench, tokens = _prepare(docs, items, id_column, text_column)

        def run(batches: Iterator[pa.RecordBatch], bench=bench) -> Iterator[pa.RecordBatch]:
            b = bench.value
            for batch in batches:
                found = [(row, b.ids[m[0]], *m[1:]) for row, packed in enumerate(batch.column(1).to_pylist())
                         for m in _verify(np.frombuffer(packed, "<i4"), b)]
                if found:
                    rows, *made = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, made)], [
                        "id", "item", "cosine", "share", "answer_share", "first_word"])

        part = tokens.mapInArrow(run, f"id {kinds[0]}, item {kinds[1]}, cosine double, share double, "
                                      "answer_share double, first_word long")
        found = part if found is None else found.unionByName(part)
    return found.withColumnsRenamed({"id": id_column, "item": item_column})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, in all columns, whose id has no benchmark passage; rows without an id stay."""
    bad = contaminated(docs, benchmark, id_column, text_column).select(id_column).where(
        F.col(id_column).isNotNull()).distinct()
    return docs.join(written(bad, "contaminated"), id_column, "left_anti").select(*(f"`{c}`" for c in docs.columns))

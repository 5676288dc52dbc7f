"""Operators on single texts against the library, brute force or held-out labels."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clienttrace.llm import bpe, language, licenses, pitman_yor, queries, toxicity
from clienttrace.llm.common import fold as fold_column

from .conftest import fold, words


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(queries.TOKENIZER)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_library(frame, odd_texts, tokenizer):
    texts = odd_texts + [(20, "a<|endoftext|>b <|endoftext|>"), (21, "don't  we'll   \n\n x\u2028 \x1c\x85"), (22, "ab" * 3_000)]
    got = bpe.digests(bpe.encode(frame(texts), queries.TOKENIZER)).collect()
    want = []
    for i, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_short_and_long_words_agree():
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        b = bpe.Bpe(f.read())
    for seed in range(200):
        letters = words(seed, 1, ("a", "th", "in", "er", "zz", "é")).encode() * 3
        parts = [b.letter_id[x] for x in letters]
        assert b.short(list(parts)) == b.long(list(parts))


def test_bpe_empty_table(frame):
    assert bpe.digests(bpe.encode(frame([]), queries.TOKENIZER)).count() == 0


def test_language_held_out(frame):
    stems = {"aa": ("ba", "ke", "lo"), "bb": ("xi", "wu", "zo"), "cc": ("é", "ñu", "ça")}
    rows = [(i, words(i, 25, stems["abc"[i % 3] * 2])) for i in range(240)]
    docs = frame(rows, {i: "abc"[i % 3] * 2 for i, _ in rows})
    model = language.fit(docs, fold_column("doc_id", 4) != 2)
    got = language.predict(docs, model).collect()
    assert all(r["lang_pred"] == "abc"[r["doc_id"] % 3] * 2 for r in got if fold(r["doc_id"], 4) == 2)
    assert all(0.5 < r["score"] <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.5  # sparse


def test_language_odd_rows(frame, odd_texts):
    docs = frame(odd_texts, {6: "aa", 10: "bb", 11: None})
    got = language.predict(docs, language.fit(docs, fold_column("doc_id", 4) != 2)).collect()
    assert len(got) == len(odd_texts)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert {1, 2, 3, 4} <= und and not und & {6, 10, 11, 12}
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {0.0}
    empty = frame([])
    assert language.predict(empty, language.fit(empty, fold_column("doc_id", 4) != 2)).count() == 0
    kept = language.keep_known(docs, language.fit(docs, fold_column("doc_id", 4) != 2))
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & {1, 2, 3, 4}


def test_language_grams_do_not_depend_on_slices(monkeypatch):
    text = words(9, 400)
    whole = language.grams(text)
    monkeypatch.setattr(language, "SLICE", 37)
    cut = language.grams(text)
    assert all((a == b).all() for a, b in zip(whole, cut))


def _toxic_rows():
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, words(i, 40) + (" fool of zorgs" if bad else " fool" if i % 5 == 1 else " zorgs" if i % 5 == 2 else "")))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_pairs(spark, frame):
    """A word that is harmless alone and one that is, too, are toxic together."""
    rows, labels = _toxic_rows()
    labels += [(0, None, None), (None, 1, 1), (9_999, 0, 1), (3, 1, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(frame(rows), known, fold_column("doc_id", 5) != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(rows), machine).collect()}
    held = [i for i, _ in rows if fold(i, 5) == 0]
    right = [(got[i] >= 0.5) == (i % 5 == 0) for i in held]
    assert sum(right) / len(right) >= 0.9


@pytest.mark.parametrize("length", [8, 150])
def test_toxicity_pairs_without_effect_alone(spark, frame, length):
    """Two words, each toxic at the rate of all documents, that are toxic together and never alone."""
    rng, rows, labels, kinds = np.random.default_rng(length), [], [], {}
    for i in range(4_000):
        kind = "pair" if i < 100 else "one" if i < 400 else "two" if i < 700 else "insult" if rng.random() < 0.27 else "none"
        extra = {"pair": ["moth", "lamp"], "one": ["moth"], "two": ["lamp"], "insult": ["insult"], "none": []}[kind]
        rows.append((i, " ".join([*(f"w{j}" for j in rng.zipf(1.3, length) % 3_000), *extra])))
        labels.append((i, 1, int(kind in ("pair", "insult"))))
        kinds[i] = kind
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    machine = toxicity.fit(frame(rows), known, fold_column("doc_id", 5) != 0)
    share = np.mean([y for i, _, y in labels if fold(i, 5)])
    for word in ("moth", "lamp"):
        with_word = [y for (i, t), (_, _, y) in zip(rows, labels) if word in t.split() and fold(i, 5)]
        assert abs(np.mean(with_word) - share) < 0.05
    found = {k: [0, 0] for k in set(kinds.values())}
    for r in toxicity.score(frame(rows), machine).collect():
        if fold(r["doc_id"], 5) == 0:
            found[kinds[r["doc_id"]]][r["score"] >= 0.5] += 1
    assert found["pair"][1] >= 0.9 * sum(found["pair"]) and sum(found["pair"]) > 10
    assert found["insult"][1] >= 0.99 * sum(found["insult"])
    assert found["one"][1] == found["two"][1] == found["none"][1] == 0


def test_toxicity_sample_keeps_the_prior(spark, frame):
    """Far more rows than are fitted: where terms say nothing, the score stays the toxic share."""
    rows = [(i, "plain words") for i in range(8_000)]
    known = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    machine = toxicity.fit(frame(rows), known, fold_column("doc_id", 5) != 9, fit_rows=80)
    assert 0.06 < machine.score("plain words") < 0.2


def test_toxicity_pair_term_is_learned():
    """With single weights alone this cannot be told: one of two terms is fine, both are not."""
    a, b = np.array([1], "<i4"), np.array([2], "<i4")
    rows = [(np.array([1, 2], "<i4"), 1, 1.0), (a, 0, 1.0), (b, 0, 1.0)] * 200
    toxic, other = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)
    toxic[[1, 2]], other[[1, 2]] = 200, 200
    toxic[3:5], other[3:5] = 0, 100
    m = toxicity.train(rows, toxic, other, -0.7, (200.0, 800.0), epochs=30)
    x = toxicity.ratios(toxic, other, 200.0, 800.0)
    assert m.margin(np.array([1, 2]), x[[1, 2]]) > 0 > max(m.margin(a, x[[1]]), m.margin(b, x[[2]]))


def test_toxicity_odd_rows(spark, frame, odd_texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(6, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame(odd_texts)
    for labels in (none, one):
        machine = toxicity.fit(docs, labels, fold_column("doc_id", 5) != 99)
        got = toxicity.score(docs, machine).collect()
        assert len(got) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in got)
        assert toxicity.keep_clean(docs, machine).columns == docs.columns
    assert toxicity.score(frame([]), toxicity.fit(frame([]), none, fold_column("doc_id", 5) != 0)).count() == 0


def _licence_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if ord(c) > 127 or c.isalnum() and ord(c) < 128:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def test_license_base_is_brute_force(frame, odd_texts):
    texts = odd_texts + [
        (30, "MIT License, mit-license; the MIT\tlicense MIT"), (31, "GNU General Public License CC BY CC-BY 4.0"),
        (32, "mit licenses amit license mitélicense"), (33, "apache license apache License"),
        (34, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nMIT License"),
        (35, "SPDX-License-Identifier: MIT OR"), (36, "spdx-license-identifier: GPL-3.0-or-later")]
    got = {}
    for r in licenses.summary(licenses.scan(frame(texts))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, text in texts:
        w = _licence_words(text)
        at = [(s, label) for phrase, label in licenses.BASE.items() for s in range(len(w))
              if w[s:s + phrase.count(" ") + 1] == phrase.split()]
        for r in got[i]:
            if i is None:
                continue
            assert (r["n_words"], r["n_base"]) == (len(w), len(at))
            assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
            assert r["base_labels"] == ",".join(sorted({label for _, label in at}))
            assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1
    assert got[34][0]["labels"] == "apache,gpl,mit" and got[34][0]["permissive"]
    assert got[35][0]["labels"] == "" and not got[36][0]["permissive"] and got[36][0]["labels"] == "gpl"


@pytest.mark.parametrize("expression, permissive", [
    ("MIT", True), ("GPL-2.0", False), ("MIT OR GPL-2.0", True), ("MIT AND GPL-2.0", False),
    ("MIT OR GPL-2.0 AND GPL-3.0", True), ("(MIT OR GPL-2.0) AND GPL-3.0", False),
    ("GPL-2.0 WITH Classpath-exception-2.0", False), ("MIT AND (BSD-3-Clause OR GPL-2.0-only)", True)])
def test_license_expressions(expression, permissive):
    assert licenses.evaluate(expression)["permissive"] is permissive


@pytest.mark.parametrize("expression", ["", "MIT AND", "OR MIT", "(MIT", "MIT)", "MIT GPL-2.0", "()"])
def test_license_no_expressions(expression):
    assert licenses.evaluate(expression)["valid"] is False


@pytest.mark.parametrize("line, labels", [
    ("<!-- SPDX-License-Identifier: MIT -->", "mit"), ("// SPDX-License-Identifier: MIT. See LICENSE", "mit"),
    ("/* SPDX-License-Identifier: MIT, BSD-2-Clause */", "bsd,mit"), ("# SPDX-License-Identifier: MIT, see LICENSE", "mit"),
    ("é\u00a0日本 SPDX-License-Identifier:Apache-2.0\r\nSPDX-License-Identifier: (GPL-2.0+ OR MIT) # both", "apache,gpl,mit"),
    ("SPDX-License-Identifier MIT", ""), ("SPDX-License-Identifier: MIT OR -->", ""), ("SPDX-License-Identifier:", ""),
    ("spdx license identifier : LicenseRef-Own.", "licenseref-own"), ("SPDX-License-Identifier: (MIT", "")])
def test_license_tags_in_comments(line, labels):
    _, spans, expressions = licenses.scan_text(f"code {line}\nrest", licenses.automaton())
    assert ",".join(sorted({x for e in expressions if e["valid"] for x in e["labels"]})) == labels
    assert [s["kind"] for s in spans][:1] == ["tag"]


def test_license_empty_table(frame):
    assert licenses.summary(licenses.scan(frame([]))).collect() == []


def test_pitman_yor_counts_and_order(spark, frame, odd_texts):
    texts = odd_texts + [(100 + i, words(i, 80)) for i in range(60)]
    got = pitman_yor.score(frame(texts), fold_column("doc_id", 10) != 0).collect()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts if i is not None}
    c = Counter()
    for i, t in texts:
        if fold(i, 10):
            c.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is None:
            continue
        t = tokens[r["doc_id"]]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["held_out"] is (fold(r["doc_id"], 10) == 0)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["score"] < 0


def test_pitman_yor_chunks_change_nothing(frame, monkeypatch):
    texts = [(i, words(i, 50)) for i in range(40)]
    run = lambda: sorted(map(tuple, pitman_yor.score(frame(texts), fold_column("doc_id", 10) != 0).collect()))
    one = run()
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 100)
    for a, b in zip(one, run()):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-6)


def test_pitman_yor_pairs_are_seated_again_from_the_tables_found(frame, monkeypatch):
    """The first sweep starts from the tables that the prior expects; only a later one sees those of a sweep."""
    seated, sweeps = pitman_yor._seated, []
    monkeypatch.setattr(pitman_yor, "_seated", lambda *args: sweeps.append(args[-1]) or seated(*args))
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 30))) for i in range(20)]
    got = pitman_yor.score(frame(rows), F.col("doc_id") < 100).collect()
    assert len(got) == 20 and all(r["score"] < 0 for r in got)
    assert sweeps == list(range(1, len(sweeps) + 1)) and len(sweeps) > 1


def test_pitman_yor_shares_only_what_a_pass_needs(spark, frame, monkeypatch):
    """A pass over the words gets one spelling, and what is shared for it goes when it ends."""
    shared, share = [], type(spark.sparkContext).broadcast

    def broadcast(context, model):
        shared.append((share(context, model), sum(s is not None for s in model.spellings)))
        return shared[-1][0]

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    assert pitman_yor.score(frame([(i, words(i, 30)) for i in range(10)]), F.col("doc_id") < 8).count() == 10
    many = [n for _, n in shared if n > 1]
    assert len(many) == 1 + pitman_yor.PAIR_SWEEPS and max(many) <= pitman_yor.SWEEPS
    # The last one is for the rows returned.
    assert not [b for b, _ in shared[:-1] if os.path.exists(b._path)]


def test_pitman_yor_tokens_and_chunks(frame, odd_texts, monkeypatch):
    """Words as Arrow splits them; texts cut into chunks keep their order, and a chunk has no words but its own."""
    texts = [(None, "  a  B\tc\x0b\x0c\r\n"), (50, "\x00 \x1c\x85 Ä x"), (51, " lead"), (52, "trail "), *odd_texts]
    want = {(i, t): [*(t or "").encode().lower().split(), b""] for i, t in texts}
    monkeypatch.setattr(pitman_yor, "PIECE", 300)
    for tokens, distinct in ((1 << 21, 500_000), (100, 500_000), (1 << 21, 60)):
        monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", tokens)
        monkeypatch.setattr(pitman_yor, "CHUNK_WORDS", distinct)
        got = []
        for row in pitman_yor._chunks(frame(texts), F.lit(True), "doc_id", "text").collect():
            row, words = row.asDict(), pitman_yor._unpack_words(row["words"])
            codes, lengths = pitman_yor._unpack(row["tokens"], "<i4"), row["lengths"]
            assert len(set(words)) == len(words) == row["n_words"] and set(codes.tolist()) == set(range(len(words)))
            parts = np.split(codes, np.cumsum(lengths)[:-1])
            got += [(i, [words[c] for c in part]) for i, part in zip(row["ids"], parts)]
            pairs = Counter((u, w) for _, t in got[-len(parts):] for u, w in zip([b"", *t], t))
            chunk, counts = pitman_yor.Chunk(row), pitman_yor._unpack(row["pair_counts"], "<i4")
            assert pairs == {(words[u], words[w]): n for u, w, n in zip(chunk.context, chunk.dish, counts)}
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted(((i, want[i, t]) for i, t in texts), key=key)


def test_pitman_yor_contexts_by_brute_force(frame):
    # No pair of words stands twice in the training texts, so every customer of a context has a table of its own.
    texts = ["a b c d a", "b d c", "c a d b a c b", "e d e b e"]
    pairs = [p for t in texts for p in zip(["", *t.split()], [*t.split(), ""])]
    assert len(pairs) == len(set(pairs))
    single = {"": "", **{w: w for w in "abcde"}}
    tries = ["a b c d", "d c b a", "c d x a e", "e e", "x x"]
    rows = list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(single.values())] + [(200 + i, t) for i, t in enumerate(tries)]
    rows += [(300, "x")]
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(frame(rows), F.col("doc_id") < 100).collect()}
    c, follow = Counter(u for u, _ in pairs), Counter(pairs)
    d, a = 0.95, pitman_yor.CONTEXT_STRENGTH

    def p(u, w, parent):
        return (follow[u, w] * (1 - d) + (a + d * c[u]) * parent) / (a + c[u])

    # What the words' restaurant gives is read off texts of one word; the rest must follow.
    def parent_of(w, first, second):
        """The parent's probability of ``w`` from p(w | end) p(end | w)."""
        whole = 10 ** first / p(w, "", second)
        return (whole * (a + c[""]) - follow["", w] * (1 - d)) / (a + d * c[""])

    parent = {"": (10 ** got[100] * (a + c[""]) - follow["", ""] * (1 - d)) / (a + d * c[""])}
    for i, w in enumerate(list(single)[1:], 101):
        parent[w] = parent_of(w, got[i], parent[""])
    parent["x"] = parent_of("x", got[300], parent[""])
    assert all(0 < v < 1 for v in parent.values()) and sum(parent.values()) == pytest.approx(1, abs=0.02)
    for i, t in enumerate(texts + tries):
        want = sum(math.log10(p(u, w, parent[w])) for u, w in zip(["", *t.split()], [*t.split(), ""]))
        assert got[i if i < len(texts) else 200 + i - len(texts)] == pytest.approx(want, abs=1e-4)


def test_pitman_yor_word_order_counts(frame):
    # Each word tells the next one but for a tenth; without contexts all are equally likely.
    import random

    stems = ["an", "be", "co", "du", "el", "fi", "go", "hu"]

    def text(i):
        rng, out = random.Random(i), []
        for _ in range(60):
            out.append(stems[(stems.index(out[-1]) + 3) % 8] if out and rng.random() < 0.9 else rng.choice(stems))
        return out

    rows = [(i, " ".join(text(i))) for i in range(200)] + [(1_000 + i, " ".join(sorted(text(i)))) for i in range(20)]
    got = {r["doc_id"]: r for r in pitman_yor.score(frame(rows), (fold_column("doc_id", 10) != 0) & (F.col("doc_id") < 1_000)).collect()}
    held = [r for i, r in got.items() if i < 1_000 and r["held_out"]]
    # log10 per token: 0.9 at the base, below 0.3 in context.
    assert sum(r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) < -0.85
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -0.3
    assert all(got[1_000 + i]["score"] < got[i]["score"] - 30 for i in range(20))


def test_pitman_yor_packs():
    for values in (np.array([], "<i8"), np.arange(300, dtype="<i4"), np.array([-1, 2**40], "<i8"), np.array([0.5], "<f4")):
        assert pitman_yor._unpack(pitman_yor._pack(values), values.dtype.str).tolist() == values.tolist()
    for w in ([b""], [b"", b"a"], [b"a", b"", b"c"]):
        assert pitman_yor._unpack_words(pitman_yor._pack_words(w)) == w
    n = np.array([0, 1, 2, 100, 10**6])
    t = pitman_yor.average_tables(n, 0.7)
    assert t[:2].tolist() == [0, 1] and (t <= n).all() and (np.diff(t) > 0).all()


def test_pitman_yor_seats():
    rng = np.arange(2_000)
    t = pitman_yor.seat(np.full(2_000, 500.0), np.full(2_000, 1.0), 0.5, rng, 1)
    one = []
    sit = np.random.default_rng(1)
    for _ in range(2_000):
        tables = 1
        for n in range(1, 500):
            tables += sit.random() < 1.0 / (n - 0.5 * tables + 1.0)
        one.append(tables)
    assert t.mean() == pytest.approx(np.mean(one), rel=0.03)
    assert pitman_yor.seat(np.array([0.0, 1, 2]), np.ones(3), 0.5, rng[:3], 1)[:2].tolist() == [0, 1]


def test_pitman_yor_empty(frame):
    assert pitman_yor.score(frame([]), fold_column("doc_id", 10) != 0).count() == 0
    got = pitman_yor.score(frame([(1, "a b"), (2, None)]), fold_column("doc_id", 10) > 99).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in got} == {(0, 0)}

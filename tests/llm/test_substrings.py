"""Removal of repeated word sequences against brute force."""

import hashlib
import random

import pytest

from clienttrace.llm import substrings

from .conftest import words


def _brute(rows, length):
    """The contract over all windows in the order of their places."""
    import xxhash
    key = lambda i: (i is not None, i or 0)
    docs = sorted({(key(i), i, t) for i, t in rows}, key=lambda r: (r[0], _print(r[2], xxhash)))
    seen, out = set(), {}
    for _, i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            window = tuple(w[s:s + length])
            if window in seen:
                gone[s:s + length] = [True] * length
            seen.add(window)
        out[i, t] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return sorted(((i, *out[i, t]) for i, t in rows), key=str)


def _print(text, xxhash):
    n = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), seed=42)
    return n - 2**64 if n >= 2**63 else n


def _got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


def _planted(seed, docs):
    rng = random.Random(seed)
    shared = [words(900 + k, 90) for k in range(4)]
    rows = []
    for i in range(docs):
        own = words(seed * 1000 + i, rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared).split()
            a = rng.randint(0, 60)
            at = rng.randint(0, len(own))
            own[at:at] = passage[a:a + rng.randint(5, 60)]
        rows.append((i * 7 % docs, " ".join(own)))
    rows += [(1_000 + i, rows[i % 5][1]) for i in range(20)]
    rows += [(2_000, " ".join(["a"] * 70)), (2_001, " ".join(["b", "a", "c"] * 30)), (2_002, " ".join(["a"] * 25))]
    return rows


@pytest.mark.parametrize("crowd", [substrings.CROWD, 3, 0])
@pytest.mark.parametrize("shard_words", [substrings.SHARD_WORDS, 400])
def test_repeated_windows_against_brute_force(frame, odd_texts, crowd, shard_words):
    rows = odd_texts + _planted(5, 120)
    got = _got(substrings.kept(frame(rows), crowd=crowd, shard_words=shard_words))
    assert got == _brute(rows, 20)
    assert sum(r[2] for r in got) > 2_000


def test_other_lengths_same_ids_and_digests(frame):
    rows = _planted(6, 40) + [(3, words(77, 60)), (3, "x " + words(77, 60)), (None, words(77, 50))]
    assert _got(substrings.kept(frame(rows), length=7)) == _brute(rows, 7)
    left = {(r["doc_id"], r["n_words"]): r["kept_sha256"] for r in substrings.digests(substrings.kept(frame(rows))).collect()}
    assert left == {(i, n): hashlib.sha256(k.encode()).hexdigest() for i, n, _, k in _brute(rows, 20)}
    with pytest.raises(ValueError):
        substrings.kept(frame(rows), length=5)


def test_no_documents(frame):
    assert substrings.kept(frame([])).collect() == []


def test_automaton_against_search():
    rng = random.Random(8)
    for _ in range(200):
        reference, passages = substrings.Automaton(), []
        for _ in range(6):
            w = [rng.choice("abc") for _ in range(rng.randint(0, 25))]
            bits = reference.matches(w, 4)
            text = ["".join(p) for p in passages]
            assert bits == sum(1 << s for s in range(len(w) - 3) if any("".join(w[s:s + 4]) in t for t in text))
            reference.add(w)
            passages.append(w)

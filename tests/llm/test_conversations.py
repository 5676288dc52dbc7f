"""Conversation operators against brute force."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from clienttrace.llm import queries, repair, trie

BLANKS = " \t\n\x0b\x0c\r"


def _brute_repair(rows):
    """Cheapest edits of (role, text, fault) rows, by plain recursion over whole suffixes: cost, audit, repaired."""
    turn = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "", ()), "a": (0, "", ()), "u": (2, "I", (("assistant", ""),)),
            "s": (4, "II", (("user", ""), ("assistant", "")))}
    for role, text, fault in reversed(rows):
        after, best = best, {}
        for state in ("", "s", "u", "a"):
            options = [(after[state][0] + 3, "D" + after[state][1], after[state][2])]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                nxt = turn[state]
                cost, audit, out = after[nxt[0]]
                options.append((cost + 2 + extra, "R" + audit, ((nxt, text), *out)))
                if role[:1] == nxt[0]:
                    options.append((cost + extra, "K" + audit, ((role, text), *out)))
                if role[:1] == "s" and state == "":
                    cost, audit, out = after["s"]
                    options.append((cost + extra, "K" + audit, ((role, text), *out)))
            best[state] = min(options)
        for _ in range(3):
            for state in ("", "s", "u", "a"):
                cost, audit, out = best[turn[state][0]]
                best[state] = min(best[state], (cost + 2, "I" + audit, ((turn[state], ""), *out)))
    return best[""]


def _brute(turns):
    """The contract, conversation by conversation."""
    shown = lambda x: " " if x is None else str(x)
    convs = {c: [] for c, *_ in turns}
    for c, t, role, text in turns:
        kind = zlib.crc32(f"{shown(c)}:{shown(t)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[c] += [(t, role, text)] * (2 if kind == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            ink = text.rstrip(BLANKS)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else
                          "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, *_ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, repaired = _brute_repair([(r, x, f) for (_, r, x), f in zip(rows, faults)])
        text = "\n".join(f"{r}:{x}" for r, x in repaired)
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _turns(spark, rows):
    return spark.createDataFrame([(t, r, c, x, 1, "a", 2) for c, t, r, x in rows],
                                 "turn long, role string, conv_id long, text string, cost int, audit string, part int").repartition(5)


def _random_turns(seed, convs, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "tool", "", None, "U"]),
                         rng.choice(["Yes.", "No", "ok!  ", " \t", "", None, "Why? é ", f"{t}.", "a\n", "日本。", "x" * 500])))
    rows += rows[:15] + [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, None, None),
                         (10**15, 5, "system", "Be good."), (-3, 10**12, "assistant", "z")]
    return rows


@pytest.mark.parametrize("piece", [repair.ROWS, 3])
def test_repairs_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "ROWS", piece)
    rows = _random_turns(1, 300, 9)
    got = [tuple(r[f] for f in FIELDS) for r in repair.repairs(_turns(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(_brute(rows), key=str)


def test_repairs_of_the_table(spark, sf_dir):
    turns = queries.table(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op12_repair"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(_brute(rows))


def test_repairs_hot_conversation_and_empty_table(spark):
    rows = [(7, t, ("user", "assistant")[t % 2] if t % 97 else "tool", f"turn {t}." if t % 50 else "same")
            for t in range(20_000)] + [(c, 0, "user", "Hi.") for c in range(200)]
    got = [tuple(r[f] for f in FIELDS) for r in repair.repairs(_turns(spark, rows)).collect()]
    assert sorted(got) == sorted(_brute(rows))
    assert repair.repairs(_turns(spark, [])).collect() == []


def test_repair_stretches_and_powers_change_nothing():
    rng = random.Random(2)
    names = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}
    for _ in range(300):
        symbols = bytes(s for s in (4 * rng.randrange(4) + rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(rng.randrange(6)))
                        for _ in range(rng.choice((1, 1, 2, 7, 33))))
        cost, audit, _ = _brute_repair([("sua?"[s >> 2], "x", names[s & 3]) for s in symbols])
        assert repair.repair(symbols) == repair.repair(symbols, stretch=4) == (cost, audit)


def _brute_trie(turns):
    """The contract over whole prefixes."""
    convs = {}
    for c, t, role, text in turns:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest() + len(r[2].encode()).to_bytes(4)
    for c, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        convs[c] = [r[1:] for r in rows]
    members = {}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = c - c % 5 if c >= 0 else c + (-c) % 5
        rebuilt[c] = tuple(convs.get(rest, [])[:h]) + tuple(own[h:])
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(rebuilt[c][:d], []).append(c)
    children, leaves, saved = {n: 0 for n in members}, {n: 0 for n in members}, {n: 0 for n in members}
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return [(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
             hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == n).encode()).hexdigest())
            for n, m in members.items()]


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _tree(df):
    return sorted((tuple(r[f] for f in NODE) for r in df.collect()), key=str)


@pytest.mark.parametrize("stretch", [trie.STRETCH, 1])
def test_trie_against_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rng = random.Random(4)
    rows = _random_turns(3, 150, 12)
    shared = [("user", "Hello."), ("assistant", "Hi, é."), ("user", "a"), ("assistant", "b")] * 8
    for c in range(1_000, 1_200):
        rows += [(c, t, r, x if rng.random() < 0.97 else f"{x}{c % 3}") for t, (r, x) in enumerate(shared[:rng.randint(0, 32)])]
    assert _tree(trie.prefix_trie(_turns(spark, rows))) == sorted(_brute_trie(rows), key=str)


def test_trie_long_conversation_copies_and_empty_table(spark):
    rows = [(5, t, "user", f"turn {t % 300}") for t in range(600)] + [(10, t, "user", f"turn {t % 300}") for t in range(400)]
    rows += [(c, t, "user", "the same") for c in range(100, 700) for t in range(2)]
    assert _tree(trie.prefix_trie(_turns(spark, rows))) == sorted(_brute_trie(rows), key=str)
    assert trie.prefix_trie(_turns(spark, [])).collect() == []
    assert trie.prefix_trie(_turns(spark, [(None, 1, "user", "x")])).collect() == []

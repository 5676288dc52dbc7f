"""Operators on many rows against brute force."""

import base64
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clienttrace.llm import decontaminate, neighbours, queries, simhash, urls, warc

from .conftest import words


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    """Smallest reachable node by brute force over pairs."""
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_simhash_against_pairs(frame, odd_texts, monkeypatch):
    rng = np.random.default_rng(3)
    rows = list(odd_texts)
    for i in range(150):
        w = words(50 + i % 10, 300).split()
        for k in rng.integers(0, 300, i // 30):
            w[k] = f"new{i}"
        rows.append((1000 + i, " ".join(w)))
    monkeypatch.setattr(simhash, "SLICE", 1000)
    got = simhash.groups(frame(rows)).collect()
    prints = [_fingerprint(t) for _, t in rows]
    root = _components(prints)
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = [(i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(rows, prints, root)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("dense", [10**6, 12, 0])
def test_simhash_dense_segments_lose_no_link(spark, dense):
    rng = np.random.default_rng(4)
    prints = set()
    for base in rng.integers(0, 2**62, 3):
        for _ in range(60):
            p = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                p ^= 1 << int(b)
            prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, dense).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    root = {p: p for p in prints}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {p: min(x, y) if r in (x, y) else r for p, r in root.items()}
    want = _components(prints)
    assert len({(root[p], r) for p, r in zip(prints, want)}) == len(set(root.values())) == len(set(want))


def test_simhash_keys_are_never_broadcast(spark):
    """Spark sizes the rows of 32 left-out bits like the segments they come from: small ones were broadcast whole."""
    prints = spark.range(300).select(F.xxhash64("id").alias("fp"))
    near = prints.unionByName(prints.select((F.col("fp").bitwiseXOR(F.lit(1))).alias("fp")))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    for dense in (1 << 20, 1):
        found = simhash.links(near, dense)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert found.distinct().count() == 300


def test_deduplicate(frame, odd_texts):
    docs = frame(odd_texts)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({
        r["component_id"] for r in simhash.groups(docs.where("doc_id is not null")).collect()})
    assert ids.count(None) == 2
    assert simhash.deduplicate(frame([])).count() == 0
    assert simhash.groups(frame([])).count() == 0


def _vectors(spark, rows):
    return spark.createDataFrame([(e, i, "x", 1) for i, e in rows], "embedding array<float>, vec_id long, score string, rank int")


def _nearest(rows, k):
    fine = {i: np.array(e, float) for i, e in rows if i is not None and e and all(
        x is not None and math.isfinite(x) for x in e) and any(e)}
    out = set()
    for q in fine:
        if q % 50 == 0:
            near = sorted((-round(float(fine[q] @ v / np.linalg.norm(fine[q]) / np.linalg.norm(v)), 9), i)
                          for i, v in fine.items() if i != q)
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("shard_rows", [20_000, 70])
def test_neighbours_exact_at_factor_one(spark, shard_rows):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + 0.3 * rng.normal(size=8)]) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)]  # copies: ties by id
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8), (None, rows[0][1]), (2200, [])]
    rows.append(rows[7])
    got = neighbours.nearest(_vectors(spark, rows), lambda i: i % 50 == 0, factor=1.0, shard_rows=shard_rows).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == _nearest(rows, 5)
    assert all(-1 - 1e-9 <= r["score"] <= 1 + 1e-9 for r in got)


def test_neighbours_recall_and_small_tables(spark, sf_dir):
    table = queries.table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    got = {(r["query_id"], r["vec_id"]) for r in queries.QUERIES["op2_neighbours"](spark, sf_dir).collect()}
    want = {(q, i) for q, _, i in _nearest(rows, 5)}
    assert len(got & want) >= 0.9 * len(want)
    nearest = lambda rows: neighbours.nearest(_vectors(spark, rows), lambda i: i % 50 == 0).collect()
    assert nearest([]) == [] and nearest([(0, [1.0, 0.0])]) == []
    assert [(r["vec_id"], r["score"]) for r in nearest([(0, [1.0, 0.0]), (1, [0.0, 2.0])])] == [(1, 0.0)]


def _pages(spark, rows):
    return spark.createDataFrame([(h, u, i, "x", "y") for i, u, h in rows],
                                 "html string, url string, page_id long, payload string, record_type string").repartition(2)


def _archived(spark, rows, least_bytes=0):
    whole, slim = warc.archive(_pages(spark, rows), least_bytes=least_bytes)
    return warc.read_archives(spark, whole, True).collect(), warc.read_archives(spark, slim, True).collect()


def test_warc_round_trip(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz"
    rows = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "u\r\nWARC-Type: x", tricky),
            (2, "", None), (4, "x", ""), (None, "n", "same"), (None, "m", None), (7, "é", "日本 " * 20_000), (7, "é", "日本 " * 20_000)]
    whole, slim = _archived(spark, rows)
    assert sorted((r["id"], r["payload"]) for r in whole if r["id"]) == sorted((str(i), h or "") for i, _, h in rows if i)
    assert len(slim) == len(rows)
    for r in slim:
        full = next(h or "" for i, _, h in rows if str(i) == str(r["id"])) if r["id"] else None
        if full is not None:
            assert r["payload_bytes"] == len(full.encode())
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(full.encode()).digest()).decode()
            assert r["payload"] == (full if r["record_type"] == "response" else "")
    kinds = {(r["id"], r["record_type"], r["refers_to"]) for r in slim}
    assert {("3", "response", None), ("5", "revisit", "3"), ("9", "revisit", "3"), (None, "revisit", "3"), ("1", "response", None),
            ("2", "response", None), ("4", "revisit", "2"), (None, "revisit", "2"), ("7", "response", None), ("7", "revisit", "7")} == kinds
    assert all(r["record_type"] == "response" for r in _archived(spark, rows, 10**6)[1])
    assert _archived(spark, []) == ([], [])


def test_warc_archives_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (100, 1_000))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5_000)
    sizes = [0, 1, 100, 101, 1_000, 1_001, 20_000]
    rows = [(i, "u", chr(97 + i % 3) * sizes[i % 7]) for i in range(420)] + [(1_000, "u", None)]
    whole, slim = warc.archive(_pages(spark, rows))
    for path, texts in ((whole, True), (slim, False)):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "part-*").load(path).collect()
        held = [[b for _, b in warc._records(f["content"])] for f in files]
        assert sum(map(len, held)) == len(rows)
        assert not texts or all(len(h) == 1 or sum(len(b) - b.index(b"\r\n\r\n") - 4 for b in h) <= 5_000 for h in held)
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    got = warc.read_archives(spark, slim, False).collect()
    assert {(r["id"], r["refers_to"]) for r in got} == {
        (str(i), None if first[h or ""] == i else str(first[h or ""])) for i, _, h in rows}


def test_warc_archives_are_read_record_by_record():
    import gzip
    import random
    import tracemalloc

    def one(block: bytes) -> bytes:
        return b"WARC/1.1\r\nA: b\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    # Line ends at every place of the border between records, and blocks of none.
    rng = random.Random(3)
    blocks = [b"".join(rng.choice([b"\r\n", b"\r\n\r\n", b"WARC/1.1\r\n", b"x"]) for _ in range(rng.randrange(6))) for _ in range(300)]
    plain = b"".join(map(one, blocks))
    for content in (plain, gzip.compress(plain), b"".join(gzip.compress(one(b)) for b in blocks), plain[:-4]):
        assert [b for _, b in warc._records(content)] == blocks
    for cut in (plain[:-5] if blocks[-1] else plain[:-9], gzip.compress(plain)[:-20], b"no archive\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc._records(cut))
    assert list(warc._records(b"")) == []
    # 8,192 pages of 200 KB are 1.6 GB; a task holds a piece of them.
    page = one(rng.randbytes(1_000) * 200)
    packer = zlib.compressobj(wbits=31)
    content = b"".join(packer.compress(page) for _ in range(500)) + packer.flush()
    tracemalloc.start()
    assert sum(len(b) for _, b in warc._records(content)) == 500 * 200_000
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("url, host, path", [
    ("http://A.Com/x/Y?q#f", "a.com", "/x/Y"), ("http://a.com?x/y", "a.com", ""), ("no scheme", "", ""), (None, "", ""),
    ("x://u://v/w", "u:", "//v/w"), ("://é.ORG#/a", "é.org", ""), ("http://", "", "")])
def test_url_parts(spark, url, host, path):
    got = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string"), queries.RULES).first()
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, None, "allow")


def test_url_rules(spark):
    cases = {"http://example.org/es/1": ("example.org/es/", "block"), "http://a.example.org/en/12": ("example.org/en/1", "block"),
             "http://example.org/en/2": ("org/", "allow"), "http://badexample.org/es/": ("org/", "allow"),
             "http://x.com/fr/": ("com/fr/", "allow"), "http://x.com/de/1": ("com/de/", "block"), "http://com/de/": ("com/de/", "block"),
             "http://org": (None, None), "http://xorg/": (None, None)}
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    for r, (rule, verdict) in zip(urls.judge(pages, queries.RULES).orderBy("page_id").collect(), cases.values()):
        assert r["rule"] == rule and (verdict is None or r["verdict"] == verdict)


def _chances(taught, order=4):
    """Blended probabilities by the definition, over strings."""
    seen = {}
    for text in taught:
        text = "\u0002" * (order - 1) + text + "\u0003"
        for i in range(order - 1, len(text)):
            for k in range(order):
                seen.setdefault(text[i - k:i], []).append(text[i])

    def p(context, sign):
        base = p(context[1:], sign) if context else 1 / 256
        s = seen.get(context)
        return (s.count(sign) + len(set(s)) * base) / (len(s) + len(set(s))) if s else base
    return p


def test_url_model_against_brute_force(spark):
    import zlib

    rows = [(i, f"http://{'good' if i % 2 else 'spam'}{i % 7}.{'org' if i % 2 else 'com'}/{'en' if i % 2 else 'de'}/{i}?x") for i in range(60)]
    rows += [(100 + i, f"http://{'good' if i % 2 else 'spam'}{i}.net/z/{i}") for i in range(10)] + [(200, None), (201, ""), (100, rows[0][1])]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.RULES).collect()
    assert len(got) == len(rows)
    text = lambda u: (u or "").split("://", 1)[1] if "://" in (u or "") else ""
    taught = {c: [text(u) for i, u in rows if u and zlib.crc32(u.encode()) % 5 and (".org/" in u or ".com/" in u)
                  and (".org/" in u) == c] for c in (True, False)}
    p, q = _chances(taught[True]), _chances(taught[False])
    for r in got:
        u = next((u for i, u in rows if i == r["page_id"] and text(u).startswith(r["host"] + r["path"])), None)
        t = "\u0002" * 3 + text(u) + "\u0003"
        want = np.mean([math.log(p(t[i - 3:i], t[i]) / q(t[i - 3:i], t[i])) for i in range(3, len(t))])
        assert r["score"] == pytest.approx(want, abs=1e-9)
        if r["rule"] is None:
            assert r["verdict"] == ("allow" if r["score"] >= r["threshold"] else "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), queries.RULES).count() == 0


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y and x >= 0 else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = rng.integers(-1, 6, rng.integers(1, 30)), rng.integers(-1, 6, rng.integers(0, 40))
        assert decontaminate.common_length(a, b) == _common(a.tolist(), b.tolist())


def test_decontaminate_plants(spark, frame, odd_texts):
    stems = tuple("ba ke lo xi wu zo ra ti mu ne po sy".split())
    items = [(k, words(900 + k, 12 + 6 * k, stems)) for k in range(12)]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "too short"), (None, items[0][1]), items[3]],
                                  "item_id long, text string")
    rows, want = list(odd_texts), set()
    for i in range(60):
        body, k = words(i, 150, stems).split(), i % 12
        item = items[k][1].split()
        if i % 3 == 0:  # a copy, in other case and with other signs
            body[70:70] = [w.upper() + "," for w in item]
            want.add((2000 + i, k))
        elif i % 3 == 1:  # a tenth of the words changed
            body[40:40] = ["changed" if j % 10 == 9 else w for j, w in enumerate(item)]
            want.add((2000 + i, k))
        rows.append((2000 + i, " ".join(body)))
    got = decontaminate.contaminated(frame(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(0 < r["cosine"] <= 1 and r["share"] >= decontaminate.PARAPHRASE for r in got)
    docs = frame(rows)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(
        str(i) for i, _ in rows if i not in {d for d, _ in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.contaminated(frame([]), bench).count() == 0


def _common_words(item, copy):
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    return _common([number[w] for w in item], [number.get(w, -1) for w in copy]) / len(item)


def test_decontaminate_changed_copies_at_every_offset(spark, frame):
    """Whatever the ordered comparison accepts is retrieved: 20 to 40% of the words changed, all alignments."""
    stems = tuple("ba ke lo xi wu zo ra ti mu ne po sy".split())
    rng = np.random.default_rng(12)
    items = [(k, words(1_900 + k, 15 + 4 * k, stems)) for k in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for rate in (0.2, 0.3, 0.35, 0.4):
        for k, text in items:
            for offset in range(8):
                item, i = text.split(), 3_000 + len(rows)
                copy = [f"other{j}" if rng.random() < rate else w for j, w in enumerate(item)]
                share = _common_words(item, copy)
                answer = _common_words(item[-max(1, len(item) // 4):], copy)
                body = words(5_000 + len(rows), 100, ("qui", "vor", "zel", "tam")).split()
                rows.append((i, " ".join(body[:40 + offset] + copy + body[40 + offset:])))
                if share >= 0.7 or share >= 0.55 and answer >= 0.8:
                    want.add((i, k))
    assert len(want) > 150
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(rows), bench).collect()}
    assert got == want


def test_decontaminate_blocks_of_items_change_nothing(spark, frame, monkeypatch):
    items = [(k, words(900 + k, 40)) for k in range(6)]
    rows = [(i, words(i, 60) + " " + items[i % 6][1]) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(rows), bench).collect()}
    one = run()
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 80)
    assert run() == one == {(i, i % 6) for i in range(12)}


def test_decontaminate_short_items(spark, frame):
    """Items of few words are found as consecutive words, tiny ones as whole documents only, by brute force."""
    items = [(0, "Too short item of seven words here"), (1, "yes"), (2, "internationalisation"), (3, "of the"), (4, "!?"),
             (5, "the the the the end, overall")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["x too SHORT item, of seven words here y", "too short item of seven words", "here too short item of seven words here",
             "words here of seven item short too", "Yes!", "oh yes", "an internationalisation", "internationalisations", "of the",
             "one of the many", "!?", "", None, "the the the the the end overall " * 3, "the the the end overall",
             "the the the the end overal", "yes", "too short item of seven words her"]
    cut = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = set()
    for d, text in enumerate(texts):
        for i, item in items:
            a, b = cut(item), cut(text)
            inside = any(b[k:k + len(a)] == a for k in range(len(b))) if a else False
            if inside and (sum(map(len, a)) >= decontaminate.LEAST_BYTES or a == b):
                want.add((d, i))
    rows = decontaminate.contaminated(frame(list(enumerate(texts))), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want) and (0, 0) in want and (5, 1) not in want
    assert {r["first_word"] for r in rows if r["doc_id"] in (0, 13)} == {1}
    kept = decontaminate.drop_contaminated(frame(list(enumerate(texts))), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontaminate_scripts_without_blanks(spark, frame):
    """Passages and changed copies inside one long run of signs; other texts in the same signs stay."""
    rng = np.random.default_rng(4)
    sign = lambda n, first=0x4E00, range_=2_000: "".join(map(chr, rng.integers(first, first + range_, n)))
    long, short, thai = sign(60), sign(6) + "。", "".join(map(chr, rng.integers(0xE01, 0xE2E, 40)))
    bench = spark.createDataFrame([(0, long), (1, short), (2, thai)], "item_id long, text string")
    changed = long[:20] + "的" + long[21:45] + long[47:]
    rows = [(0, sign(500) + long + sign(300)), (1, sign(77) + changed + sign(5)), (2, sign(900)), (3, sign(30) + short + sign(30)),
            (4, "mixed words " + thai + " end"), (5, sign(30, 0xE01, 45) * 20), (6, short[:-2] + sign(20)), (7, long[::-1])]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(rows), bench).collect()}
    assert got == {(0, 0), (1, 0), (3, 1), (4, 2)}
    assert decontaminate.split_words("Aé日本x") == ["aé".encode(), "日".encode(), "本".encode(), b"x"]


def test_decontaminate_words_are_not_hashed():
    """Every word has a number of its own; words of no item have none."""
    b = decontaminate.Benchmark([(0, " ".join(f"w{i}" for i in range(20_000)))])
    assert b.terms == 20_000 and b.numbers([b"w7", b"w20000", b"W7"]).tolist() == [b.number[b"w7"], -1, -1]

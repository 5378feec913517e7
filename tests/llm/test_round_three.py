"""Collocations, exact top products and vector codes against brute force, with the odd rows that their docstrings define."""

import collections
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haulspark.llm import collocations as c
from haulspark.llm.perfect_hash import BytesTable, NumberTable, PerfectHash
from haulspark.llm.top_products import scored, top_products
from haulspark.llm.vector_codes import Heaps, nearest, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def vectors(n, d=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(v) for v in rng.normal(size=d).astype(np.float32)], int(i) % 3 or None, "x") for i in rng.permutation(n)]
    odd = [(5000, None, 1, "x"), (5001, [math.nan] * d, 1, "x"), (5002, [None] + [0.5] * (d - 1), 1, "x"), (5003, [math.inf] * d, 1, "x"), (7, [0.25] * d, 1, "x"), (7, [0.25] * d, 1, "x"), (None, [1.0] * d, 2, "x"), (40, [0.0] * d, None, "x"), (60, [1.0], 2, "x"), (80, [2.0, -1.0][:1], 2, "x"), (5004, [], 2, "x")]
    return rows + odd


def kept(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def test_perfect_hash_gives_every_key_a_slot_of_its_own():
    keys = np.random.default_rng(1).integers(0, 1 << 62, 20000)
    h = PerfectHash(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys))) and sum(len(w) for _, w, _ in h.levels) * 64 < 6 * len(keys)
    t = NumberTable(keys)
    assert (t.keys[t.find(keys)] == keys).all() and (t.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all() and (NumberTable(keys[:0]).find(keys) == -1).all()


def test_strings_with_equal_hashes_are_told_apart():
    values = pa.array([b"a", b"b", b"", b"d"], pa.large_binary())
    same = np.array([5, 5, 5, 9], np.uint64)
    t = BytesTable(values, same)
    assert [t.values[i].as_py() for i in t.find(values, same)] == [b"a", b"b", b"", b"d"]
    assert t.find(pa.array([b"x", b"d"], pa.large_binary()), np.array([5, 9], np.uint64)).tolist()[0] == -1


def brute_phrases(rows, longest, least, covered, most):
    count, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for size in range(1, longest + 1):
                count.update((lang, *w[i : i + size]) for i in range(len(w) - size + 1))
    cand = {p: n for p, n in count.items() if len(p) > 2 and n >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in cand.items():
        score, k = min((2_000_000 * a // (count[lang, *w[:k]] + count[lang, *w[k:]]), k) for k in range(1, len(w)))
        inside = any(q[0] == lang and len(q) - 1 > len(w) and 100 * b >= covered * a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, b in cand.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1))


def texts():
    rng = np.random.default_rng(5)
    words = ["new", "york", "The", "CITY", "ÉTÉ", "été", "of", "a", "b c", "x", "of"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))) + rng.choice([".", "\n", "\t,", "!"]) + "New  York\tcity the", [None, "en", "de"][i % 3]) for i in range(300)]
    return rows + [(None, "en"), ("", None), ("a a a a a a a a", "en"), ("word", "xx"), ("york; new, york. new", "en"), ("new york city " * 3000, "de")] + [("same old text here", "en")] * 30


@pytest.mark.parametrize("bounds", [{}, {"most_keys": 3}, {"most_keys": 20}, {"most_bytes": 5}])
def test_collocations(spark, bounds):
    """By slots, and by plain shuffles where words or phrases are more than may be sent out."""
    rows = texts()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, phrase int, a int").repartition(5)
    got = sorted(tuple(r) for r in c.collocations(df, least=12, most=25, **bounds).collect())
    assert got == brute_phrases(rows, 4, 12, 80, 25) and len(got) > 30
    assert c.collocations(df.limit(0)).count() == 0


def test_scores_pass_64_bits():
    a, other = np.array([1 << 61, 3]), np.array([1 << 61, 4])
    assert c.cut_scores(a, other, other).tolist() == [1_000_000, 750_000]


def test_tasks_give_keys_away_when_they_hold_many(spark, monkeypatch):
    codes = np.arange(1000, dtype=np.int32) % 50
    monkeypatch.setattr(c, "HELD_KEYS", 8)

    class Sent:
        value = []

    batch = pa.RecordBatch.from_arrays([pa.array([codes.tobytes()] * 3, pa.binary())], names=["codes"])
    told = collections.Counter()
    for b in c._screen(Sent)(iter([batch])):
        told.update(dict(zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert len(told) == 50 and sum(told.values()) == 3 * 999


def brute_top(rows, k, scale):
    told, out = kept(rows, scale), []
    for at, (q, v, _) in enumerate(told):
        if q is not None and q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0) for other, (i, w, _) in enumerate(told) if other != at and len(w) == len(v))
            out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("d", [6, 16])
def test_top_products(spark, monkeypatch, d):
    from haulspark.llm import top_products as module

    for name, n in (("RANGE_ROWS", 40), ("BLOCK_ROWS", 16), ("QUERY_ROWS", 4), ("SHARED_BLOCKS", 2)):
        monkeypatch.setattr(module, name, n)
    rows = vectors(500, d) + [(20, [0.5] * d, 1, "x"), (20, [0.5] * d, 2, "x"), (100, [-3.0] * d, 1, "x")]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("code", "score").repartition(3)
    got = sorted((tuple(r) for r in top_products(df, F.col("vec_id") % 20 == 0, k=7).collect()), key=str)
    assert got == brute_top(rows, 7, 64)
    assert top_products(df.limit(0), F.lit(True)).count() == 0 and top_products(df, F.lit(None).cast("boolean")).count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(2)
    held = np.floor(64 * rng.normal(size=(200, 16)) * np.linspace(3, 0.1, 200)[:, None])
    held = held[np.argsort(-(held**2).sum(axis=1), kind="stable")]
    asked = np.floor(64 * rng.normal(size=(30, 16)))
    asked[3] = 0
    full = asked @ held.T
    least = np.sort(full, axis=1)[:, -5]
    least[4] = -np.inf
    q, k, s = scored(asked, least, held, np.linalg.svd(held.T @ held)[0])
    assert (full[q, k] == s).all() and {(a, b) for a, b in zip(*np.nonzero(full >= least[:, None]), strict=True)} <= set(zip(q.tolist(), k.tolist(), strict=True))
    assert len(q) < full.size * 0.7


def brute_codes(rows, entries, rounds, scale, parts=4):
    told = sorted(((i is None, i or 0, np.array(v, np.int32).tobytes()), i, v, label) for i, v, label in kept(rows, scale))
    length = len(told[0][2])
    width = -(-length // parts)
    cut = lambda v: [[*v, *[0] * (width * parts - length)][p * width : (p + 1) * width] for p in range(parts)]
    same = [(i, cut(v), label) for _, i, v, label in told if len(v) == length]
    books = [[cut(v)[p] for _, _, v, _ in told[:entries] if len(v) == length] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e, p=p, x=x: (far(x[p], books[p][e]), e)) for p in range(parts)] for _, x, _ in same]
        if k < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x[p] for (_, x, _), code in zip(same, codes, strict=True) if code[p] == e]
                    if mine:
                        books[p][e] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    errors = [sum(far(x[p], books[p][code[p]]) for p in range(parts)) for (_, x, _), code in zip(same, codes, strict=True)]
    labels = collections.Counter()
    for (_, _, label), e in zip(same, errors, strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for e in code), err, labels[label], digest) for (i, _, label), code, err in zip(same, codes, errors, strict=True)]
    return sorted(out + [(i, None, None, None, digest) for _, i, v, _ in told if len(v) != length], key=str)


@pytest.mark.parametrize(("n", "d", "entries"), [(400, 8, 32), (60, 6, 256), (300, 4, 16)])
def test_vector_codes(spark, n, d, entries):
    rows = [r for r in vectors(n, d)]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted((tuple(r) for r in vector_codes(df, entries=entries).collect()), key=str)
    assert got == brute_codes(rows, entries, 4, 1024)
    assert vector_codes(df.limit(0)).count() == 0


def test_heaps_pop_what_is_violated_and_nothing_else():
    rng = np.random.default_rng(9)
    slots, keys = rng.integers(0, 12, 500), rng.normal(size=500)
    heaps = Heaps.of(slots, keys, np.arange(500), 12)
    for _ in range(4):
        drift = rng.normal(size=12) * 0.7
        where = np.repeat(np.arange(12), heaps.sizes)
        places, old = heaps.violated(drift)
        assert sorted(places) == np.flatnonzero(heaps.keys <= drift[where]).tolist() and (where[places] == old).all()
        heaps = heaps.moved(places, old, rng.integers(0, 12, len(old)), rng.normal(size=len(old)) + 1)
        assert sorted(heaps.rows) == list(range(500))
        for s in range(12):
            heap = heaps.keys[heaps.starts[s] : heaps.starts[s + 1]]
            assert all(heap[(i - 1) // 2] <= heap[i] for i in range(1, len(heap)))
    best, near, second = nearest(np.array([[1.0, 1.0]]), np.array([[2.0, 1.0], [0.0, 1.0]]))
    assert (best.tolist(), near.tolist(), second.tolist()) == ([0], [1.0], [1.0])


def test_more_phrases_than_may_be_sent_are_counted_by_slots(spark, monkeypatch):
    """Words that may be sent out, phrases that may not: these were shuffled as text, from the texts on, after all else was done."""
    monkeypatch.setattr(c, "_plainly", lambda *_: pytest.fail("phrases are shuffled as text"))
    df = spark.createDataFrame(texts(), "text string, lang string").repartition(5)
    of = lambda **bounds: sorted(tuple(r) for r in c.collocations(df, least=12, most=25, **bounds).collect())
    told = of()
    for most_keys in (40, 100):  # beyond at two words, and at more
        assert of(most_keys=most_keys) == told

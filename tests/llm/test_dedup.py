"""Exact dedup, MinHash near-dedup and passage removal against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from haulspark.llm.components import connected_components
from haulspark.llm.common import Scratch
from haulspark.llm.exact_dedup import RadixTrie, exact_dedup
from haulspark.llm.fm_index import FmIndex, WaveletMatrix
from haulspark.llm.near_dedup import CHUNKS, ERRORS, GUARANTEED, SYMBOLS, chunk_keys, near_dedup
from haulspark.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string"
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "o n e"), (7, "x" * 50_000), (8, "x" * 50_000), (8, "x" * 50_000), (None, "one"), (None, None), (9, "é é\x0bé")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clash(df):
    """Extra columns whose names the operators use within."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("row", "id", "owner", "class", "rep", "key", "component", "keep_id", "kept", "anchor", "spans", "text_key", "sha", "size")})


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_trie_parts_labels_and_keeps_the_first_payload():
    trie = RadixTrie()
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcdef", b"abcdeg"]
    assert [trie.insert(w, i) for i, w in enumerate(words)] == list(range(len(words)))
    assert [trie.insert(w, 99) for w in reversed(words)] == list(reversed(range(len(words))))


@pytest.mark.parametrize("trie_bytes", [1, 1 << 26])
def test_exact_dedup_is_brute_force(spark, trie_bytes):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 5)))) for i in range(400)] + [(1000 + i, "hot copy" + " " * (i % 3)) for i in range(300)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), trie_bytes=trie_bytes).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(squeeze(t), []).append((-len(t), i))
    for i, t in rows:
        best = min(groups[squeeze(t)])[1]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (best, len(groups[squeeze(t)]), i == best, hashlib.sha256(squeeze(t).encode()).hexdigest())


def test_exact_dedup_edges(spark):
    rows = exact_dedup(clash(spark.createDataFrame(EDGES, SCHEMA))).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and len({r.keep_id for r in g}) == 1 and g[0].group_size == len(g) for g in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert len(empty) == 4 and empty[0].keep_id == 3  # the longest original
    assert by[hashlib.sha256(b"one").hexdigest()][0].keep_id == 6
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def sets_of(rows, width):
    return {i: shingles(t, width) for i, t in rows}


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_rows(seed, groups=25, members=12):
    """Groups of copies edited more and more, so that many pairs are on either side of the threshold."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 8, 40, 120, 400]))]
        for _ in range(members):
            copy = list(base)
            for _ in range(int(len(base) * rng.random() * 0.12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(w.upper() if rng.random() < 0.05 else w for w in copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "width"), [(3, 2), (4, 2), (5, 5), (6, 3)])
def test_near_dedup_is_brute_force(spark, seed, width):
    rows = near_rows(seed)
    sets = sets_of(rows, width)
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components_of(sets, linked)
    got = near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), width=width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_edges(spark):
    rows = near_dedup(clash(spark.createDataFrame(EDGES, SCHEMA)), width=2).collect()
    assert len(rows) == len(EDGES)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 7, 9)] == [0, 0, 0, 1, 1, 1]
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 8)] == [1, 2, 3, 4, 4, 6, 7, 7]
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chunk_keys_find_all_signatures_within_the_guaranteed_distance():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (200, CHUNKS * SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(CHUNKS * SYMBOLS, GUARANTEED, replace=False)] ^= 1
    assert CHUNKS * (ERRORS + 1) == GUARANTEED + 1
    assert ((chunk_keys(a)[:, :, None] == chunk_keys(b)[:, None, :]).any(axis=(1, 2))).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def brute_passages(rows, window):
    first, words = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        words.setdefault(i, []).append(w)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, texts in words.items():
        for w in texts:
            gone = set()
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone.update(range(k, k + window))
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def passage_rows(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(rng.choice([49, 50, 51, 80, 200])) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 90))
        if rng.random() < 0.15:
            parts += ["und"] * rng.randint(30, 400)
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(30)]
    return rows


@pytest.mark.parametrize(("shard_words", "most_words"), [(300, 1 << 23), (1 << 19, 1 << 23), (1 << 19, 200)])
def test_passages_are_brute_force(spark, shard_words, most_words):
    rows = passage_rows(9)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_words=shard_words, most_words=most_words, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_passages(rows, 50)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.kept_text is not None)


def test_passages_edges(spark):
    long = " ".join(f"a{i}" for i in range(70))
    rows = [*EDGES, (20, long), (20, long), (21, long + " more"), (None, long)]
    got = substring_dedup(clash(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[20] == [(70, 0), (70, 0)] and by[21] == [(71, 70)] and sorted(by[None]) == [(0, 0), (1, 0), (70, 0)]
    assert [by[i] for i in (1, 2, 3, 4, 9)] == [[(0, 0)], [(0, 0)], [(0, 0)], [(1, 0)], [(3, 0)]]
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 13, 500)
    w = WaveletMatrix(symbols, 13)
    for c in range(13):
        at = np.arange(501)
        assert (w.rank(np.full(501, c), at) == np.concatenate([[0], np.cumsum(symbols == c)])).all()


def test_fm_index_owners_are_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 6, 300).astype(np.uint64)
    seqs, owners = [], []
    for i in range(30):
        a = int(rng.integers(0, 220))
        seqs.append(base[a : a + int(rng.integers(50, 80))])
        owners.append(100 - i)
    bounds = np.cumsum([0, *map(len, seqs)])
    got = FmIndex(np.concatenate(seqs), bounds, np.array(owners), 50).smallest_owners()
    for s, g in zip(seqs, got, strict=True):
        want = [min(o for t, o in zip(seqs, owners, strict=True) if any((t[j : j + 50] == s[k : k + 50]).all() for j in range(len(t) - 49))) for k in range(len(s) - 49)]
        assert g.tolist() == want

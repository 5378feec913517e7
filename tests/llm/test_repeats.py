"""Ids repeated under other contents, forced spills and splits, extreme values: each against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulspark.llm import substring_dedup as passages
from haulspark.llm.embedding_dedup import embedding_dedup
from haulspark.llm.exact_dedup import Owner, RadixTrie, exact_dedup
from haulspark.llm.mixing import mix_sources
from haulspark.llm.near_dedup import near_dedup
from haulspark.llm.substring_dedup import substring_dedup
from tests.llm.test_dedup import SCHEMA, brute_passages, near_rows, passage_rows, shingles
from tests.llm.test_operators import DOCS, VECTORS, targets_of


def brute_all(rows, window):
    """(id, words, removed) of every row; ``brute_passages`` holds one row an id."""
    first = {}
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            seq = tuple(w[k : k + window])
            first[seq] = min(i, first.get(seq, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone)))
    return sorted(out)


def test_passages_of_repeated_ids(spark):
    a, y = " ".join(f"a{i}" for i in range(60)), " ".join(f"y{i}" for i in range(100))
    rows = [(1, a), (2, a + " x"), (2, y), (3, y), (2, a + " x"), (4, y + " " + a)]
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == brute_all(rows, 50)


@pytest.mark.parametrize("window", [2, 3, 20, 32, 64, 100])
def test_passages_of_any_window(spark, window):
    rows = passage_rows(5)
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(2), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_passages(rows, window)


def test_a_passage_in_very_many_texts_is_dealt_anew(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(500)}"
    common = [word() for _ in range(60)]
    rows = [(i, " ".join([word() for _ in range(rng.randint(0, 40))] + common + [word() for _ in range(rng.randint(0, 40))])) for i in range(80)]
    cuts = []
    monkeypatch.setattr(passages, "_cut_again", lambda window, level, f=passages._cut_again: (cuts.append(level), f(window, level))[1])
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(2), shard_words=200, most_words=2000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_passages(rows, 50)
    assert len(cuts) > 1


def test_vectors_of_repeated_ids_and_extreme_sizes(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = []
    for k in range(90):
        v = base[rng.integers(6)] + rng.normal(size=8) * 0.02
        rows.append((int(rng.integers(0, 30)), (v * 10.0 ** rng.choice([-300, -170, 0, 200, 300])).tolist(), int(rng.integers(0, 2))))
    rows += rows[:5]
    got = embedding_dedup(spark.createDataFrame(rows, VECTORS.replace("float", "double")).repartition(3)).collect()
    x = np.array([r[1] for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    ids = np.array([r[0] for r in rows])
    low = ids.copy()
    while True:
        after = np.minimum(low, np.where(linked, low[None, :], low.max() + 1).min(axis=1))
        if (after == low).all():
            break
        low = after
    want = sorted(zip(ids.tolist(), linked.sum(axis=1).tolist(), low.tolist(), strict=True))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_a_trie_shares_prefixes_and_spills_by_subtree():
    trie = RadixTrie()
    words = [b"inter", b"internal", b"internet", b"interval", b"other", b"", b"internet"]
    for i, w in enumerate(words):
        fresh = Owner((1, 1, -i, -i), i, 1, i)
        owner = trie.insert(w, fresh)
        if owner is not fresh:
            owner.merge(fresh.best, i, 1, i)
    top = trie.root[1][ord("i")]
    assert top[0] == b"inter" and sorted(c[0] for c in top[1].values()) == [b"n", b"val"] and sorted(c[0] for c in top[1][ord("n")][1].values()) == [b"al", b"et"]
    assert trie.heaviest() == ord("i")
    cut = dict(trie.cut(trie.heaviest()))
    assert sorted(cut) == sorted(set(words[:4])) and (cut[b"internet"].rows, cut[b"internet"].smallest, cut[b"internet"].members) == (2, 2, [2, 6])
    assert dict(trie.drain()).keys() == {b"other", b""} and trie.held() == 0


@pytest.mark.parametrize("trie_bytes", [1, 3000])
def test_spilled_subtrees_are_merged(spark, trie_bytes):
    rng = random.Random(4)
    stem = "the same beginning of every one of these texts, longer than a stem of eight or of sixty-four bytes "
    texts = [stem + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(300)] + [stem[:k] for k in range(0, 100, 7)] * 3
    rows = [(rng.randint(0, 50), t + " " * rng.randint(0, 2)) for t in texts]
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(6), trie_bytes=trie_bytes).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    want = sorted((i, min(g := groups[t.replace(" ", "")])[1], len(g), min(x[1] for x in g)) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.smallest_id) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_rates_are_tilted_within_a_source_and_meet_the_constraint(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 9, 40, 700])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(2500)]
    rows += [(9000, "w " * 50, "b")] * 400 + [(None, "w w w", "c")] * 300
    df = spark.createDataFrame(rows, DOCS)
    got = mix_sources(df.repartition(4)).collect()
    assert len(got) == len(rows)
    again = mix_sources(df.repartition(9)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in got) == sorted((str(r.doc_id), r.copies) for r in again)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets_of(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        words = sum(r.rate * r["size"] for r in mine)
        assert abs(words - want[s]) <= 1e-9 * want[s]
        by_size = {r["size"]: r.rate for r in mine if r["size"]}
        if want[s] < 3 * sizes[s] - 1e-6:
            # the dual: log rate is one multiplier times the size, below the limit
            slopes = {round(float(np.log(v)) / n, 9) for n, v in by_size.items() if v < 3}
            assert len({round(v, 6) for v in by_size.values()}) > 1 and len(slopes) == 1
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(2, 0.002 * want[s])
        assert all(0 <= r.copies <= 3 for r in mine)


def test_one_text_held_by_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    got = mix_sources(df).groupBy("copies").count().collect()
    assert [(r.copies, r["count"]) for r in got] == [(1, 3000)]


def test_near_copies_of_repeated_ids(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(40), t) for _, t in near_rows(8, groups=10, members=10)]
    rows += rows[:6]
    sets = [shingles(t, 2) for _, t in rows]
    low = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if low[a] != low[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    got = near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, low, strict=True))


def test_long_texts_without_spaces_are_the_library(spark, monkeypatch):
    import sentencepiece

    from haulspark.llm import sentencepiece_codec as codec

    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    rng = random.Random(9)
    rows = [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(30_000)),
        "".join(rng.choice("日本語字の文中国人一二三thein") for _ in range(20_000)),
        "thein" * 3000, "x" * 9000, "short", "",
    ]
    monkeypatch.setattr(codec, "STRIP", 1000)
    v = codec.Vocabulary.read(codec.MODEL)
    ids, bounds = codec.Encoder(v).encode(rows)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode(rows)
    assert len(codec.part_long(v, rows[0])) > 100 and "".join(codec.part_long(v, rows[1])) == rows[1]


def test_edges_are_sorted_by_position():
    from haulspark.llm import sentencepiece_codec as codec

    v = codec.Vocabulary.read(codec.MODEL).prepare()
    text = "▁the\0▁internationalisation\0"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    got = [(int(p), int(s), v.pieces[i]) for place, size, piece in codec.occurrences(v, points) for p, s, i in zip(place, size, piece, strict=True)]
    want = sorted((p, len(x), x) for i, x in enumerate(v.pieces) if v.kinds[i] == 1 for p in range(len(text)) if text.startswith(x, p))
    assert got == want


def test_decoding_is_the_library(spark):
    import sentencepiece

    from haulspark.llm import sentencepiece_codec as codec

    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    rng = random.Random(10)
    n = library.get_piece_size()
    lists = [[rng.randrange(n) for _ in range(rng.randint(0, 12))] for _ in range(200)] + library.encode(["a b", " é日本", "", "😀 x"])
    rows = [(i, x) for i, x in enumerate(lists)] + [(900, None), (901, [None, 5, 10**6]), (902, [])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("clash"))
    got = {r.doc_id: r.text for r in codec.decode_ids(df.repartition(2)).collect()}
    skip = {i for i, x in enumerate(lists) if any(library.is_byte(t) or library.is_unknown(t) for t in x)}
    assert all(got[i] == library.decode(x) for i, x in enumerate(lists) if i not in skip or i >= 200)
    assert got[900] is None and got[902] == "" and got[901] == codec.decode(codec.Vocabulary.read(codec.MODEL), [5])
    assert codec.decode_ids(df.limit(0)).count() == 0


@pytest.mark.parametrize("most_bytes", [60, 64 << 20])
def test_rules_dealt_to_several_cascades(spark, most_bytes):
    from haulspark.llm.url_filter import filter_urls
    from tests.llm.test_operators import PAGES, judge

    rng = random.Random(11)
    rules = [(rng.choice(["block", "allow"]), f"{h}/{p}") for h in ("com", "a.com", "b.a.com", "org") for p in ("", "x", "x/y", "z/") if rng.random() < 0.8]
    rules += [("block", "a.com/x"), ("allow", "a.com/x")]
    urls = [f"http://{rng.choice(['com', 'a.com', 'b.a.com', 'q.org', 'net'])}/{rng.choice(['', 'x', 'x/y', 'x/yz', 'z', 'z/1'])}" for _ in range(300)]
    got = filter_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], PAGES), rules, most_bytes=most_bytes)
    blocked = {r for v, r in rules if v == "block"}
    clear = [(v, r) for v, r in rules if v == "block" or r not in blocked]
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *judge(u, clear, smallest=True)) for i, u in enumerate(urls))


def test_keys_that_no_filter_can_tell_apart(spark):
    from haulspark.llm.common import Scratch
    from haulspark.llm.url_filter import build_cascade

    df = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    cascade = build_cascade(df(["a", "b"]), df(["a", "b", "c", "d"]), 4, Scratch(spark, "t"), "x", most_levels=1)
    assert cascade.levels and not cascade.unclear  # one level suffices unless hashes are equal

"""Mixing, URL rules, embeddings, quality, SentencePiece, personal data, archives and the pipeline."""

import base64
import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from haulspark.llm import pii
from haulspark.llm.common import Scratch
from haulspark.llm.embedding_dedup import embedding_dedup, hadamard
from haulspark.llm.mixing import mix_sources
from haulspark.llm.quality import fit_ranking, score_quality, train_quality
from haulspark.llm.sentencepiece_codec import MODEL, Encoder, Vocabulary, decode, encode
from haulspark.llm.url_filter import build_cascade, filter_urls
from haulspark.llm.warc import DICTIONARY_FRAME, read_warc, write_warc

from tests.llm.test_dedup import shingles

DOCS = "doc_id long, text string, source string"


def targets_of(sizes, weights=(5, 2, 1), limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = {}
    while True:
        left = sum(sizes.values()) - sum(full.values())
        free = sum(w[s] for s in names if s not in full)
        share = {s: left * w[s] / free for s in names if s not in full}
        above = {s: limit * sizes[s] for s in share if share[s] > limit * sizes[s]}
        if not above:
            return {**full, **share}
        full |= above


def test_mixing_meets_its_targets(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 6 + ["b", "a", "Ä", None, "tiny"] if i % 40 else ["tiny"])
        if source == "tiny" and i % 40:
            source = "b"
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 300]))), source))
    df = spark.createDataFrame(rows, DOCS)
    got = mix_sources(df.repartition(4)).collect()
    again = {(r.doc_id, r.copies) for r in mix_sources(df.repartition(7)).collect()}
    assert {(r.doc_id, r.copies) for r in got} == again
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets_of(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and abs(mine[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(2, 0.002 * want[s])
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in mine)


def test_mixing_edges(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, "a"), (None, "x y", None), (2, "", "b"), (3, "one two", "a"), (3, "one two", "a")]
    got = mix_sources(spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(9) for c in ("size", "target", "weight", "copies", "block", "n")})).collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 6
    only_empty = mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", "b")], DOCS)).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]


PAGES = "page_id long, url string, html string"


def judge(url, rules, smallest=False):
    """The longest rule that fits; of equally long ones the smallest by code point, or, where there are none, any."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in rules for h, p in [(r.partition("/")[0], r[len(r.partition("/")[0]) :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min((f for f in fits if f[0] == max(fits)[0]), key=lambda f: f[1]) if smallest and fits else max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_rules_are_brute_force(spark):
    rng = random.Random(2)
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("block", "a.b.org/"), ("allow", "x.a.b.org/es/1")]
    hosts = ["example.com", "EXAMPLE.com", "com", "xcom", "a.example.net", "example.net", "b.org", "a.b.org", "x.a.b.org", "", "net:80"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/'])}{rng.choice(['en', 'de', 'es', ''])}{rng.choice(['/', ''])}{rng.choice(['7', '8', '81', '1', ''])}{rng.choice(['?q=://x/', '#en/', ''])}" for _ in range(600)]
    rows = [*enumerate(urls), (9001, None), (9002, ""), (9003, "no scheme/en/"), (9004, "a://b://com/en/"), (9004, "a://b://com/en/"), (None, "http://com/en/" + "x" * 5000)]
    df = spark.createDataFrame([(i, u, None) for i, u in rows], PAGES).withColumns({c: F.lit("clash") for c in ("host", "rule", "key", "keys", "verdict")})
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules).collect()), key=str)
    assert got == sorted(((i, *judge(u, rules)) for i, u in rows), key=str)
    assert filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_a_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(500).select(F.concat(F.lit("k"), (F.col("id") * 7).cast("string")).alias("key"))
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    cascade = build_cascade(listed, universe, 20_000, Scratch(spark, "t"), "x")
    assert len(cascade.levels) > 2 and sum(f.n_bits for f in cascade.levels) < 500 * 40
    rows = universe.select("key", F.xxhash64("key").alias("one"), F.xxhash64(F.lit("second"), "key").alias("two")).toPandas()
    got = cascade.holds(rows.one.to_numpy().view(np.uint64), rows.two.to_numpy().view(np.uint64), pa.array(rows.key))
    want = rows.key.isin([f"k{7 * i}" for i in range(500)]).to_numpy()
    assert (got == want).all()


VECTORS = "vec_id long, embedding array<float>, label int"


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for _ in range(60):
        base = rng.normal(size=24)
        for _ in range(8):
            rows.append((i, (base + rng.normal(size=24) * rng.random() * 0.45).astype(np.float32).tolist(), int(rng.integers(0, 3))))
            i += 1
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(20)]
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, VECTORS).repartition(3), block_rows=8).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == [r[2] for r in rows])
    np.fill_diagonal(linked, False)
    want, have = linked.sum(axis=1), np.array([got[r[0]].n_links for r in rows])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    assert all(got[1000 + k].component_id == got[0].component_id and got[1000 + k].n_links >= 20 for k in range(20))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.0], 1), (9, [2.0, 0.0], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [5.0], 1), (None, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("c") for c in ("rep", "links", "keys", "key", "copies", "unit", "n_links")})
    got = embedding_dedup(df).collect()
    assert len(got) == len(rows)
    links = {r.vec_id: r.n_links for r in got if r.vec_id is not None}
    assert links == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 2, 9: 2, 10: 0, 11: 0, 12: 0}
    assert {r.vec_id: r.component_id for r in got}[9] == 8
    assert embedding_dedup(spark.createDataFrame([], VECTORS)).count() == 0


def test_hadamard_keeps_norms():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(hadamard(hadamard(x)), x)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ranking = train_quality(docs, labels)
    rows = score_quality(docs, ranking).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
    again = score_quality(docs.drop("lang", "source").repartition(5), train_quality(docs.repartition(3), labels.repartition(2))).collect()
    first = {r.doc_id: round(r.score, 9) for r in score_quality(docs, ranking).collect()}
    assert all(first[r.doc_id] == round(r.score, 9) for r in again)


def test_quality_edges(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "x" * 100_000), (3, "x" * 100_000)], "doc_id long, text string").withColumns({"score": F.lit(1), "held_out": F.lit(1), "features": F.lit(1)})
    for rows in ([], [(1, 1, 0)], [(1, None, None), (None, 0, 0)]):
        ranking = train_quality(docs, spark.createDataFrame(rows, labels))
        assert ranking is None
        assert [r.predicted for r in score_quality(docs, ranking).collect()] == [1] * 5
    assert score_quality(docs.limit(0), None).count() == 0
    g = np.random.default_rng(1)
    ranking = fit_ranking(g.normal(1, 1, (50, 16)), g.normal(-1, 1, (20, 16)), 0.3)
    assert ranking.scores(np.full((1, 16), 2.0))[0] > 0.9 > 0.1 > ranking.scores(np.full((1, 16), -2.0))[0]


def texts():
    rng = random.Random(3)
    fixed = ["", " ", " a", "a  b   c", "\n\nx", "日本語 テキスト 😀", " " * 40 + "hello", "x" * 3000, "ab" * 400, "tab\tsep\r\n", "\0nul\0", "▁"]
    return fixed + ["".join(rng.choice("abc defghi  éñ日\n.,Theing") for _ in range(rng.randint(1, 300))) for _ in range(200)]


def test_bpe_is_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    v = Vocabulary.read(MODEL)
    rows = texts()
    ids, bounds = Encoder(v, most_chunks=50).encode(rows)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode(rows)
    assert all(decode(v, x) == library.decode(x) for x in library.encode(rows))
    df = spark.createDataFrame([*enumerate(rows), (None, None)], "doc_id long, text string").withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "order by": F.lit(2)})
    got = encode(df, most_bytes=500).collect()
    want = {i: library.encode(t) for i, t in enumerate(rows)}
    assert all(list(r.ids) == want.get(r.doc_id, []) and r.n_tokens == len(r.ids) for r in got)
    assert all(r.round_trip for r in got if r.doc_id is None or "▁" not in rows[r.doc_id])
    assert encode(df.limit(0)).count() == 0


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_model(pieces):
    """A small model file written by hand: pieces of (text, score, kind)."""
    field = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k)) for p, s, k in pieces)
    return body + field(2, b"\x18\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")


def test_unigram_is_the_library():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), *[(c, -6.0 - i / 7, 1) for i, c in enumerate("abcdeth")], ("▁the", -2.1, 1), ("the", -4.3, 1), ("ab", -5.5, 1), ("abc", -6.25, 1), ("bcd", -5.75, 1), ("▁a", -3.5, 1), ("cde", -6.5, 1)]
    data = unigram_model(pieces)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    v = Vocabulary.parse(data)
    rng = random.Random(4)
    rows = ["".join(rng.choice("abcdeth the") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    ids, bounds = Encoder(v).encode(rows)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == library.encode(rows)


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def test_pseudonyms_keep_their_format(spark):
    cards = ["4845168114407329", "4417744280351547", "4929348385146306", "4550997810720808", "4845 1681 1440 7329"]
    values = [*cards, "+1 (706) 555-3138", "97.51.17.173", "a.b12@mail7.example.com", "1985-02-28", "31/12/2000", "01.03.1996", "123-45-6789", "GB82WEST12345698765432", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    left = ["9807915762804490", "300.1.1.1", "31.02.2000", "666-45-6789", "version 3.0.", "CC BY-NC 4.0.", "GB82WEST12345698765433", "12:30", "a@b"]
    rows = [(i, f"before {v} and {v}!! after") for i, v in enumerate(values)] + [(100 + i, f"x {v} y") for i, v in enumerate(left)]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "corpus").collect()}
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "9", s))
    new = {}
    for i, v in enumerate(values):
        a, b = re.fullmatch(r"before (.*) and (.*)!! after", out[i].text).groups()
        assert a == b != v and len(out[i].pii_kinds) == 2
        new[v] = a
        if "." not in v or "@" in v:
            assert len(a) == len(v)
    for c in cards:
        assert luhn(re.sub(" ", "", new[c])) and shape(new[c]) == shape(c)
    assert new[cards[0]] == new[cards[4]].replace(" ", "") and len({new[c] for c in cards[:4]}) == 4
    assert new["+1 (706) 555-3138"].startswith("+1 (") and all(int(o) < 256 for o in new["97.51.17.173"].split("."))
    assert new["a.b12@mail7.example.com"].endswith("@mail7.example.com")
    for i, v in enumerate(left):
        assert out[100 + i].text == f"x {v} y" and out[100 + i].pii_kinds == []


def test_pseudonyms_are_permutations(spark):
    n = 700
    days = spark.range(n).select(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    codes = spark.range(n).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("v"))
    assert days.select(pii.pseudonym(F.col("v"), "k").alias("p")).distinct().count() == n
    assert codes.select(pii.feistel(F.col("v"), "k").alias("p")).distinct().count() == n
    assert codes.select(pii.feistel(F.col("v"), "k").alias("p")).subtract(codes.select(pii.feistel(F.col("v"), "other").alias("p"))).count() > n / 2


def test_pii_edges(spark):
    long = "word " * 40_000 + "4845168114407329"
    rows = [(1, None), (2, ""), (3, "4845168114407329"), (3, "4845168114407329"), (None, "4845168114407329 4845168114407329"), (4, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pii_kinds": F.lit(1), "found": F.lit(2)})
    out = pii.pseudonymise(df, "corpus").collect()
    assert out[0].text is None and out[0].pii_kinds == [] and out[1].text == "" and out[2].text == out[3].text != "4845168114407329"
    assert out[4].text == f"{out[2].text} {out[2].text}" and out[5].text == "word " * 40_000 + out[2].text and out[0].found == 2
    assert pii.pseudonymise(df.limit(0), "corpus").count() == 0


def archive_folder(spark):
    folder = f"{Scratch(spark, 'archives').path}/out"
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    return folder, fs, root


def test_archives_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, f"http://h{i}.org/é?{i}", "<html>" + rng.choice(["same", "same too", f"own {i} " * 60]) + "</html>") for i in range(300)]
    rows += [(400, None, None), (401, "a\r\nb", ""), (402, "", "x" * 200_000), (402, "", "x" * 200_000), (None, "u", "<html>same</html>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("c") for c in ("sha1", "size", "latest", "file", "refers_to")})
    folder, fs, root = archive_folder(spark)
    files = write_warc(df.repartition(3), folder, most_bytes=20_000)
    got = read_warc(spark, folder, files).collect()
    assert len(got) == len(rows) == files.agg(F.sum("records")).first()[0] and files.count() > 3
    payload = {i: (h or "").encode() for i, _, h in rows if i is not None}
    last = {}
    for i, p in payload.items():
        last[p] = max(i, last.get(p, -1))
    for r in got:
        if r.page_id is None:
            assert r.record_type == "response" and r.payload == b"<html>same</html>"
            continue
        p = payload[r.page_id]
        assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if last[p] == r.page_id else ("revisit", last[p]))
        assert r.payload == (p if r.record_type == "response" else None)
    name = files.first().file
    raw = fs.open_input_stream(f"{root}/{name}", compression=None).read()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == DICTIONARY_FRAME
    first = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj().decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_archives_of_nothing_and_of_small_payloads(spark):
    folder, *_ = archive_folder(spark)
    empty = spark.createDataFrame([], PAGES)
    assert read_warc(spark, folder, write_warc(empty, folder)).count() == 0
    folder, *_ = archive_folder(spark)
    files = write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], PAGES), folder, least_bytes=3)
    assert [r.record_type for r in read_warc(spark, folder, files).collect()] == ["response"] * 2


def test_queries_match_their_sql(spark):
    from haulspark.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        cols = sorted(df.columns)
        want = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, want)), name


def test_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src0", 0), (9003, "The of and to in is that. Was for on with.", "en", None, 1)], docs.schema)
    docs = docs.union(extra).union(docs.limit(3))
    good = cp.quality(spark, docs, sf)
    ranking = train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in score_quality(docs, ranking).collect() if r.predicted == 1}
    rows = good.collect()
    assert {r.doc_id for r in rows} == kept and good.columns == cp.COLUMNS
    one = cp.exact(spark, good, sf).collect()
    classes = {}
    for r in rows:
        classes.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in one) == sorted(min(c)[1] for c in classes.values())
    exact = spark.createDataFrame(one, docs.schema)
    near = cp.near(spark, exact, sf)
    sets = {r.doc_id: shingles(r.text, 5) for r in one}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {i: new if r == old else r for i, r in root.items()}
                    changed = True
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, r in root.items() if i == r)
    near = spark.createDataFrame(near.collect(), docs.schema)
    mixed = cp.mix(spark, near, sf).collect()
    copies = {r.doc_id: r.copies for r in mix_sources(near).collect()}
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, c in copies.items() for _ in range(c))
    out = cp.tokens(spark, spark.createDataFrame(mixed, docs.schema), sf).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = {r.doc_id: r.text or "" for r in mixed}
    assert len(out) == len(mixed) and all(list(r.ids) == library.encode(text[r.doc_id]) and r.round_trip for r in out)


@pytest.mark.parametrize("name", ["documents", "labels"])
def test_pipeline_of_empty_tables(spark, tmp_path, name):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        (df.limit(0) if t == name else df.limit(30)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert (cp.run(spark, str(tmp_path)).count() == 0) == (name == "documents")

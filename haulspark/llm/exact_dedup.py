"""Exact dedup by Patricia tries whose terminals own the copies of a text (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.common import Scratch, lean, text_bytes

SPACES = b" \t\n\x0b\x0c\r"
#: What a node and its terminal weigh beside their bytes.
_NODE_BYTES = 400


class Owner:
    """A terminal of a trie: what is known of the rows whose text ends there.

    ``best`` is the greatest (code points, has an id, -id, -row) of them and so names the row that stays; ``smallest``
    is the smallest identifier; ``members`` are the owners of earlier tries that were merged into this one.
    """

    __slots__ = ("best", "members", "rows", "smallest")

    def __init__(self, best: tuple, smallest: int | None, rows: int, member: int):
        self.best, self.smallest, self.rows, self.members = best, smallest, rows, [member]

    def merge(self, best: tuple, smallest: int | None, rows: int, member: int | None) -> None:
        self.best = max(self.best, best)
        if smallest is not None and (self.smallest is None or smallest < self.smallest):
            self.smallest = smallest
        self.rows += rows
        if member is not None:
            self.members.append(member)


class RadixTrie:
    """A Patricia trie over byte strings. A node is [label, children by first byte, terminal or None].

    Labels hold whole runs of bytes, so a string costs one node, or two where it parts from another. ``weight`` counts
    the bytes held below each first byte of the root, the subtrees in which the trie is spilled.
    """

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.weight: dict[int, int] = {}

    def insert(self, key: bytes, fresh):
        """The terminal of ``key``: ``fresh`` if nothing ended there before."""
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node[2] is None:
                    node[2] = fresh
                    self._grow(key, 0)
                return node[2]
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, fresh]
                self._grow(key, len(key) - at)
                return fresh
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            node[1][key[at]] = middle = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node, at = middle, at + same

    def _grow(self, key: bytes, n: int) -> None:
        first = key[0] if key else -1
        self.weight[first] = self.weight.get(first, 0) + n + _NODE_BYTES

    def held(self) -> int:
        return sum(self.weight.values())

    def heaviest(self) -> int:
        return max(self.weight, key=self.weight.__getitem__)

    def cut(self, first: int) -> Iterator[tuple[bytes, object]]:
        """Takes out the subtree below the root's byte ``first`` (-1: the empty string) and gives its (key, terminal)."""
        self.weight.pop(first, None)
        if first < 0:
            terminal, self.root[2] = self.root[2], None
            if terminal is not None:
                yield b"", terminal
            return
        child = self.root[1].pop(first, None)
        if child is not None:
            yield from _walk(child)

    def drain(self) -> Iterator[tuple[bytes, object]]:
        for first in list(self.weight):
            yield from self.cut(first)


def _walk(top: list) -> Iterator[tuple[bytes, object]]:
    todo = [(top, b"")]
    while todo:
        node, before = todo.pop()
        key = before + node[0]
        if node[2] is not None:
            yield key, node[2]
        todo += [(child, key) for child in node[1].values()]


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, which differ within it, by halving."""
    lo, hi = 0, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == key[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Out:
    """Rows of one schema, given out in batches of about 8 MB."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.cols, self.held = schema, [[] for _ in schema], 0

    def add(self, row: tuple, n_bytes: int) -> Iterator[pa.RecordBatch]:
        for out, v in zip(self.cols, row, strict=True):
            out.append(v)
        self.held += n_bytes + 60
        if self.held > 1 << 23:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema, strict=True)], schema=self.schema)
        self.cols, self.held = [[] for _ in self.schema], 0


_BEST = [("points", pa.int64()), ("known", pa.int64()), ("not_id", pa.int64()), ("minus_row", pa.int64())]
_LOCAL = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("owner", pa.int64()), ("sha", pa.binary()), ("text_key", pa.int64()), ("bytes", pa.binary()), *_BEST, ("smallest", pa.int64()), ("rows", pa.int64())])
_LOCAL_DDL = "row long, id long, owner long, sha binary, text_key long, bytes binary, points long, known long, not_id long, minus_row long, smallest long, rows long"


def _rank(points: int, doc: int | None, row: int) -> tuple[int, int, int, int]:
    return points, int(doc is not None), ~doc if doc is not None else 0, -row


def _local_owners(trie_bytes: int):
    """Inserts a task's rows in one trie; gives each row with the number of its owner, and each owner with its bytes.

    An owner's number is that of its first row. When the trie holds more than ``trie_bytes``, its heaviest subtree is
    written out and cut; a text met again after that gets a second owner, which the next step merges with the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = RadixTrie(), _Out(_LOCAL)

        def give(terminals) -> Iterator[pa.RecordBatch]:
            for data, t in terminals:
                yield from out.add((None, None, t.members[0], hashlib.sha256(data).digest(), None, data, *t.best, t.smallest, t.rows), len(data))

        for batch in batches:
            for row, doc, points, text_key, text in zip(*(batch.column(c) for c in ("row", "id", "points", "text_key", "text")), strict=True):
                row, doc, data = row.as_py(), doc.as_py(), (text.as_py() or b"").translate(None, SPACES)
                best = _rank(points.as_py(), doc, row)
                fresh = Owner(best, doc, 1, row)
                owner = trie.insert(data, fresh)
                if owner is not fresh:
                    owner.merge(best, doc, 1, None)
                yield from out.add((row, doc, owner.members[0], hashlib.sha256(data).digest(), text_key.as_py(), None, *[None] * 6), 100)
                if owner is fresh and trie.held() > trie_bytes:
                    yield from give(trie.cut(trie.heaviest()))
        yield from give(trie.drain())
        yield from out.flush()

    return run


_MERGED = pa.schema([("members", pa.list_(pa.int64())), ("bytes", pa.binary()), *_BEST, ("smallest", pa.int64()), ("rows", pa.int64()), ("settled", pa.bool_()), ("size", pa.int64()), ("head", pa.int64())])
_MERGED_DDL = "members array<long>, bytes binary, points long, known long, not_id long, minus_row long, smallest long, rows long, settled boolean, size long, head long"


def _merge_owners(trie_bytes: int, stem: int):
    """Merges owners of many lengths and hashes in one trie a task; they come sorted by their text's first ``stem`` bytes.

    Once the stem changes, the subtrees before it are complete. When the trie holds more than ``trie_bytes`` they are
    written out, settled, and cut. If one stem alone holds more, its subtree is written out as it is, not settled,
    and the next pass, which sorts by longer stems, merges the parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = RadixTrie(), _Out(_MERGED)
        now, spilled, here = None, False, 0

        def give(terminals, unsettled: bytes | None) -> Iterator[pa.RecordBatch]:
            for data, t in terminals:
                open_ = unsettled is not None and data[:stem] == unsettled
                head = int.from_bytes(hashlib.sha256(data).digest()[:8], "big", signed=True) if open_ else None
                yield from out.add((t.members, data if open_ else None, *t.best, t.smallest, t.rows, not open_, len(data), head), (len(data) if open_ else 0) + 8 * len(t.members))

        for batch in batches:
            for members, data, points, known, not_id, minus_row, smallest, rows in zip(*(batch.column(c) for c in _MERGED.names[:8]), strict=True):
                data, members = data.as_py(), members.as_py()
                if data[:stem] != now:
                    if spilled or trie.held() > trie_bytes:
                        yield from give(trie.drain(), now if spilled else None)
                    now, spilled, here = data[:stem], False, 0
                best = (points.as_py(), known.as_py(), not_id.as_py(), minus_row.as_py())
                fresh = Owner(best, smallest.as_py(), rows.as_py(), members[0])
                owner = trie.insert(data, fresh)
                if owner is fresh:
                    here += len(data) + _NODE_BYTES
                    owner.members += members[1:]
                else:
                    owner.merge(best, smallest.as_py(), rows.as_py(), members[0])
                    owner.members += members[1:]
                if here > trie_bytes and len(data) > stem:
                    yield from give(trie.drain(), now)
                    spilled, here = True, 0
        yield from give(trie.drain(), now if spilled else None)
        yield from out.flush()

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 1 << 26) -> DataFrame:
    """Classes of rows whose texts are identical after deleting ``[\\x20\\x09-\\x0D]``.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, smallest_id`` and ``text_key``, a
    hash of the original text that tells rows of a repeated id apart. Of a class the row with the most code points in
    the original text stays, then the smallest id (null last), then one of the repeated rows. A null text is an
    empty one, and all empty texts are one class. No other column of ``docs`` is read. No rows give no rows.

    Every task inserts its texts in a radix trie whose terminals hold the smallest identifier, the best row and the
    number of rows; a group of copies thus costs one terminal a task however large it is. Terminals are dealt by length
    and content hash and merged, whole, in one trie a partition. A trie above ``trie_bytes`` is spilled by subtree, and
    subtrees that were spilled in parts are merged in further passes over those parts alone. Rows find what their
    owner's terminal came to by the owner's number, which at most one task's rows share.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.length(F.col(text_col)), F.lit(0)).cast("long").alias("points"),
        F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("text_key"),
        text_bytes(text_col).alias("text"),
    )
    local = scratch.save(rows.mapInArrow(lean(_local_owners(trie_bytes)), _LOCAL_DDL), "local")
    state = ["points", "known", "not_id", "minus_row", "smallest", "rows"]
    head = F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long")
    open_ = local.where("bytes is not null").select(F.array("owner").alias("members"), "bytes", *state, F.octet_length("bytes").cast("long").alias("size"), head.alias("head"))
    settled, stem, k = [], 8, 0
    while True:
        dealt = open_.withColumn("stem", F.substring("bytes", 1, stem)).repartition("size", "head").sortWithinPartitions("stem").drop("stem")
        merged = scratch.save(dealt.select("members", "bytes", *state).mapInArrow(lean(_merge_owners(trie_bytes, stem)), _MERGED_DDL), f"merged-{k}")
        settled.append(merged.where("settled"))
        open_ = merged.where("not settled").select("members", "bytes", *state, "size", "head")
        if open_.isEmpty():
            break
        stem, k = stem * 8, k + 1
    classes = settled[0]
    for more in settled[1:]:
        classes = classes.unionByName(more)
    owned = classes.select(F.explode("members").alias("owner"), "rows", "not_id", "known", "minus_row", "smallest")
    return local.where("row is not null").select("row", "id", "owner", "sha", "text_key").join(owned, "owner").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("known") == 1, F.bitwise_not("not_id")).alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == -F.col("minus_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("smallest").alias("smallest_id"),
        "text_key",
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "smallest_id")


OP8_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents
), r as (
  select doc_id, n,
         first_value(doc_id) over (partition by n order by length(t) desc, doc_id) as keep_id,
         count(*) over (partition by n) as group_size
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from r
"""

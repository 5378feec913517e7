"""URL rules by Bloom filter cascades (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulspark.llm.bloom import BloomFilter, fill
from haulspark.llm.common import Scratch

_U = np.uint64
#: (verdict, rule): a rule is a host and a path start, written together.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Bytes of filters that are sent to the executors at once; more rules are dealt by hash to several cascades.
MOST_BYTES = 64 << 20
#: Bits a listed key takes in the first filter, at most, and in all others together.
BITS_A_KEY = 60


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Every rule that could fit, longest first: the last 1 to ``labels`` labels of the host, each with the path's starts of ``lengths``."""
    parts = F.split(host, r"\.")
    names = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))])
    keys = F.flatten(F.transform(names, lambda name: F.transform(F.filter(starts, lambda s: s.isNotNull()), lambda s: F.concat(name, s))))
    ranked = F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    return F.transform(ranked, lambda x: x["key"])


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]


@dataclass
class Cascade:
    """Filters that hold, in turn, listed keys and the unlisted keys that all filters before let through.

    A key of the universe is listed if the first filter that refuses it has an odd number, or if none does and
    their number is odd: exact for every key of the universe that the cascade was built over. ``listed`` holds, by
    name, the listed keys of the few that no filter can tell from others, as all 128 bits of their hashes are equal.
    """

    levels: list[BloomFilter] = field(default_factory=list)
    unclear: frozenset[tuple[int, int]] = frozenset()
    listed: frozenset[str] = frozenset()

    def holds(self, one: np.ndarray, two: np.ndarray, keys: pa.Array) -> np.ndarray:
        verdict = np.zeros(len(one), bool)
        left = np.arange(len(one))
        for level in self.levels:
            left = left[level.holds(one[left], two[left])]
            verdict[left] = level.number % 2 == 0
        if self.unclear:
            for i in left.tolist():
                if (int(one[i]), int(two[i])) in self.unclear:
                    verdict[i] = keys[i].as_py() in self.listed
        return verdict


def _passing(keys: DataFrame, level: BloomFilter) -> DataFrame:
    """Rows (key, one, two) that ``level`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).to_numpy().view(_U) for c in ("one", "two"))
            yield batch.filter(pa.array(level.holds(one, two)))

    return keys.mapInArrow(run, keys.schema)


def _fill(keys: DataFrame, number: int, n_keys: int, rate: float) -> BloomFilter:
    n_bits = max(64, math.ceil(n_keys * -math.log(rate) / math.log(2) ** 2))
    return fill(keys, n_bits, max(1, round(-math.log2(rate))), number)


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int, scratch: Scratch, name: str, most_levels: int = 64) -> Cascade:
    """The cascade that tells ``listed`` (key) from all other keys of ``universe`` (key); both may repeat keys.

    The first filter's rate is such that about as many unlisted keys pass as are listed, so the size of all
    filters follows the listed keys and the logarithm of ``n_universe``.
    """
    one, two = _hashes(F.col("key"))
    hashed = lambda df: df.select("key", one.alias("one"), two.alias("two"))
    inside = scratch.save(hashed(listed.where("key is not null").distinct()), f"{name}-listed")
    n = inside.count()
    cascade = Cascade()
    if not n:
        return cascade
    level = _fill(inside, 0, n, min(0.5, max(n / math.sqrt(2) / max(n_universe, 1), 1e-9)))
    cascade.levels.append(level)
    outside = scratch.save(_passing(hashed(universe), level).distinct().join(inside.select("key"), "key", "left_anti"), f"{name}-0")
    for number in range(1, most_levels):
        rest, other = (outside, inside) if number % 2 else (inside, outside)
        n = rest.count()
        if not n:
            return cascade
        level = _fill(rest, number, n, 0.5)
        cascade.levels.append(level)
        other = scratch.save(_passing(other, level), f"{name}-{number}")
        inside, outside = (other, outside) if number % 2 else (inside, other)
    # what is left after so many levels, each of which lets half of the others through, has equal hashes
    both = inside.alias("a").join(outside.alias("b"), (F.col("a.one") == F.col("b.one")) & (F.col("a.two") == F.col("b.two")))
    rows = both.select("a.key", "a.one", "a.two").distinct().collect()
    cascade.unclear = frozenset((r["one"] % (1 << 64), r["two"] % (1 << 64)) for r in rows)
    cascade.listed = frozenset(r["key"] for r in rows)
    return cascade


def _judge(cascades: Broadcast, split: int, n_splits: int):
    """Looks up the keys that are dealt to ``split`` and keeps the longest hit of these and of the splits before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            owner = pa.compute.list_parent_indices(keys).to_numpy()
            values = pa.array(keys.flatten())
            one, two = (pa.array(batch.column(c).flatten()).to_numpy().view(_U) for c in ("ones", "twos"))
            mine = np.flatnonzero(one % _U(n_splits) == split)
            texts = values.take(pa.array(mine))
            block, allow = (np.zeros(len(one), bool) for _ in range(2))
            for out, verdict in ((block, "block"), (allow, "allow")):
                out[mine] = cascades.value[verdict].holds(one[mine], two[mine], texts)
            hit = np.flatnonzero(block | allow)
            first = np.full(len(batch), -1)
            first[owner[hit][::-1]] = hit[::-1]  # the longest of a row comes first
            row = np.arange(len(batch))
            head = np.searchsorted(owner, row)  # where each row's keys begin
            place = np.where(first >= 0, first - head, np.iinfo(np.int32).max)
            before = batch.column("place").to_numpy()
            better = place < before
            at = np.where(better, first, 0)
            rule = pa.compute.if_else(pa.array(better), values.take(pa.array(np.where(better, at, None), pa.int64())), batch.column("rule")) if len(values) else batch.column("rule")
            verdict = pa.compute.if_else(pa.array(better), pa.array(np.where(block[at], "block", "allow").tolist(), pa.string()), batch.column("verdict")) if len(values) else batch.column("verdict")
            columns = {"rule": rule, "verdict": verdict, "place": pa.array(np.minimum(place, before).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row by the longest rule that fits; no rule: ``default``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes
    from there to ``?``, ``#`` or the end. A null url, or one without ``://``, has neither and gets ``default``. A
    rule fits its host and all subdomains if the path starts with the rule's. Of equally long rules the smallest
    by code point holds, of a rule listed both ways block. Repeated rows are judged alike; no rows give no rows; no other column is read.

    One cascade holds the blocked rules and one the allowed, each exact over all rules that could fit any url
    of ``pages``, so that judging a url is a look at filters in memory, without a join. ``rules`` is a list on the
    driver. Rules whose filters could take more than ``most_bytes`` together are dealt by hash to several pairs of
    cascades, which the rows pass one after another, so that no executor holds more than one pair.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "url-filter")
    labels = max((rule.partition("/")[0].count(".") + 1 for _, rule in rules), default=1)
    lengths = {len(rule) - len(rule.partition("/")[0]) for _, rule in rules} or {0}
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = scratch.save(rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths)), "keyed")
    universe = keyed.select(F.explode("keys").alias("key"))
    n_universe = universe.count()
    blocked = {r for v, r in rules if v == "block"}
    listed = [("block", r) for r in sorted(blocked)] + [("allow", r) for r in sorted({r for v, r in rules if v == "allow"} - blocked)]
    n_splits = max(1, -(-len(listed) * BITS_A_KEY // (8 * most_bytes)))
    named = scratch.save(spark.createDataFrame(listed, "verdict string, key string"), "rules") if listed else spark.createDataFrame([], "verdict string, key string")
    of_split = lambda df, k: df.where(F.expr(f"cast(conv(hex(xxhash64(key)), 16, 10) as decimal(20,0)) % {n_splits} = {k}")) if n_splits > 1 else df
    judged = keyed.withColumns({
        "ones": F.transform("keys", lambda k: _hashes(k)[0]), "twos": F.transform("keys", lambda k: _hashes(k)[1]),
        "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string"), "place": F.lit(2**31 - 1),
    })
    for k in range(n_splits):
        cascades = {v: build_cascade(of_split(named.where(F.col("verdict") == v).select("key"), k), of_split(universe, k), n_universe, scratch, f"{v}-{k}") for v in ("block", "allow")}
        judged = judged.mapInArrow(_judge(spark.sparkContext.broadcast(cascades), k, n_splits), judged.schema)
        if k + 1 < n_splits:
            judged = scratch.save(judged, f"judged-{k}")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP3_SQL = r"""
with rules(verdict, host, path) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), p as (
  select page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), best as (
  select p.page_id, p.host, p.path, r.host || r.path as rule, r.verdict,
         row_number() over (partition by p.page_id order by length(r.host || r.path) desc nulls last) as rn
  from p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best where rn = 1
"""

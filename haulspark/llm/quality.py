"""Quality classifier: Bradley-Terry ranking from preference pairs (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulspark.llm.common import Scratch, few_rows_a_batch, lean, text_bytes
from haulspark.llm.tokens import Words, mix, runs_of_texts
from haulspark.sources.shipping import ship_package

#: Score at which a text is predicted good; the learned quantile of utilities is put there.
THRESHOLD = 0.7
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = np.zeros(256, bool)
_MARKS[list(b"$%&#*@^~=+<>_\\{}[]")] = True
N_SHAPES = 16
#: Buckets of hashed words, of pairs of words, and of runs of three bytes.
BUCKETS = 256
N_FEATURES = N_SHAPES + 3 * BUCKETS
#: Pairs a text is in, at least, and the ridge on the weights.
PAIRS_EACH, PENALTY = 16, 5.0
#: Texts of the commoner label in a block, and of the rarer one at least.
BLOCK, LEAST = 512, 64
#: Tasks whose sums come to the driver, labelled ids that are sent to every task, and bins of a search for a quantile.
TASKS, MOST_SENT, BINS = 32, 500_000, 4096


def _hashed(words: Words, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, kind, shares by bucket) of each text's words, word pairs and byte triples, one vector at a time."""
    hashes = words.hashes()
    low = words.data.astype(np.uint32)
    triple = ((low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(20)) % np.uint32(BUCKETS) if len(low) > 2 else low[:0]
    word = (hashes >> np.uint64(40)).astype(np.int64) % BUCKETS
    pair = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> np.uint64(40)).astype(np.int64) % BUCKETS if len(hashes) > 1 else np.zeros(0, np.int64)
    for i in range(len(offsets) - 1):
        lo, hi = words.first_word[i], words.first_word[i + 1]
        for k, part in enumerate((word[lo:hi], pair[lo : max(lo, hi - 1)], triple[offsets[i] : max(offsets[i], offsets[i + 1] - 2)])):
            if len(part):
                yield i, k, np.sqrt(np.bincount(part, minlength=BUCKETS) / len(part))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row a text: its shape, and the shares of its words, word pairs and byte triples in each hash bucket."""
    out = np.zeros((len(offsets) - 1, N_FEATURES), np.float32)
    out[:, :N_SHAPES] = _shapes(data, offsets)
    for i, k, shares in _hashed(Words(data, offsets, lower=True), offsets):
        out[i, N_SHAPES + k * BUCKETS : N_SHAPES + (k + 1) * BUCKETS] = shares
    return out


def _shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of shape figures a text; every figure is bounded or logarithmic, and zeros stand for no words."""
    words = Words(data, offsets, lower=False)
    hashes = words.hashes()
    last = data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    size = (words.ends - words.starts).astype(float)
    flags = np.stack([_MARKS[last], last == 33, last == 124, (last == 46) | (last == 63), last == 44], 1) if len(last) else np.zeros((0, 5), bool)
    out = np.zeros((len(offsets) - 1, N_SHAPES))
    for i in range(len(offsets) - 1):
        lo, hi = words.first_word[i], words.first_word[i + 1]
        n = hi - lo
        if not n:
            continue
        text = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        letters = text[_UPPER].sum() + text[_LOWER].sum() + text[128:].sum()
        counts = np.unique(hashes[lo:hi], return_counts=True)[1]
        mean = size[lo:hi].mean()
        shares = flags[lo:hi].mean(axis=0)
        same = (hashes[lo + 1 : hi] == hashes[lo : hi - 1]).mean() if n > 1 else 0.0
        out[i] = (
            np.log1p(n), np.log1p(mean), np.log1p(np.sqrt(size[lo:hi].var())),
            *np.sqrt(shares), np.sqrt(text[_UPPER].sum() / max(letters, 1)), np.sqrt(text[_DIGIT].sum() / text.sum()),
            np.log(len(counts)) / np.log(n) if n > 1 else 1.0, counts.max() / n, np.sqrt(same), text[128:].sum() / text.sum(),
            np.sqrt(text[10] / n), np.sqrt(text[_MARKS].sum() / text.sum()),
        )
    return out


@dataclass
class Ranking:
    """Utility of a text is ``weights`` times its standardised features; ``cut`` is the learned quantile."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self._of(((rows - self.mean) / self.scale) @ self.weights)

    def text_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of texts; weights are gathered text by text, so no matrix of texts and features is made."""
        w = self.weights / self.scale
        u = _shapes(data, offsets) @ w[:N_SHAPES] - self.mean @ w
        for i, k, shares in _hashed(Words(data, offsets, lower=True), offsets):
            u[i] += shares @ w[N_SHAPES + k * BUCKETS : N_SHAPES + (k + 1) * BUCKETS]
        return self._of(u)

    def _of(self, utilities: np.ndarray) -> np.ndarray:
        x = np.log(THRESHOLD / (1 - THRESHOLD)) + (utilities - self.cut)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def preferences(n_good: int, n_bad: int, pairs_each: int) -> tuple[np.ndarray, np.ndarray]:
    """(good, bad) numbers of the pairs: each text meets ``pairs_each`` of the other class in a fixed rotation."""
    step = np.arange(max(n_good, n_bad))
    return np.concatenate([step % n_good] * pairs_each), np.concatenate([(step * 7 + r * 101 + r) % n_bad for r in range(pairs_each)])


def _sums(x: np.ndarray, n_good: int, w: np.ndarray, pairs_each: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss of the pairs of a block of standardised rows, good ones first, its gradient and its second derivatives.

    No difference is ever stored: sums over pairs are sums over texts and over a matrix of good by bad ones.
    """
    n_bad = len(x) - n_good
    one, two = preferences(n_good, n_bad, pairs_each)
    u = x @ w
    apart = u[one] - u[n_good + two]
    p = 1 / (1 + np.exp(-np.clip(apart, -30, 30)))
    gradient = x.T @ np.concatenate([np.bincount(one, p - 1, n_good), -np.bincount(two, p - 1, n_bad)])
    met = np.bincount(one * n_bad + two, p * (1 - p), n_good * n_bad).reshape(n_good, n_bad).astype(np.float32)
    low = x.astype(np.float32)  # curvature only sets the way, the gradient where it ends
    good, bad = low[:n_good], low[n_good:]
    turned = np.concatenate([met.sum(axis=1)[:, None] * good - met @ bad, met.sum(axis=0)[:, None] * bad - met.T @ good])
    return float(np.logaddexp(0, -apart).sum()), gradient, low.T @ turned


def _newton(sums, n: int, penalty: float) -> np.ndarray:
    """Weights where the loss that ``sums`` gives with its derivatives, and the ridge of ``penalty``, is least; a step that makes it larger is halved."""
    w = before = np.zeros(n)
    least, move = np.inf, np.zeros(n)
    for _ in range(50):
        loss, gradient, curvature = sums(w)
        loss += penalty / 2 * (w @ w)
        if loss > least + 1e-9 * abs(least):
            move = move / 2
            w = before - move
            continue
        least, before = loss, w
        move = np.linalg.solve(curvature.astype(np.float64) + penalty * np.eye(n), gradient + penalty * w)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_ranking(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs_each: int = PAIRS_EACH, penalty: float = PENALTY) -> Ranking:
    """Bradley-Terry utilities by the logistic loss of feature differences of (good, bad) pairs, with a ridge of ``penalty``: of one block of rows in memory.

    The cut is the utility quantile at the share of bad texts among all labels, halfway between the
    texts on either side of it.
    """
    x = np.concatenate([good, bad]).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x -= mean
    x /= scale
    w = _newton(lambda w: _sums(x, len(good), w, pairs_each), x.shape[1], penalty)
    u = x @ w
    weight = np.concatenate([np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))])
    order = np.argsort(u, kind="stable")
    at = min(int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-12)), len(u) - 2)
    return Ranking(mean, scale, w, float((u[order[at]] + u[order[at + 1]]) / 2))


_FEATURES = pa.schema([("id", pa.string()), ("quality", pa.int32()), ("size", pa.int32()), ("features", pa.binary())])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in runs_of_texts(batch.column("text")):
            told = pa.array([row.tobytes() for row in features(data, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in ("id", "quality")), pa.array(np.diff(offsets), pa.int32()), told], schema=_FEATURES)


_BLOCKS = pa.schema([("n_good", pa.int32()), ("rows", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block, its good texts first; rows come sorted by block and id, of those that repeat an id the longest stays."""

    def packed(held: dict) -> Iterator[pa.RecordBatch]:
        good, bad = ([f for q, _, f in held.values() if q == k] for k in (1, 0))
        if good and bad:
            yield pa.RecordBatch.from_arrays([pa.array([len(good)], pa.int32()), pa.array([b"".join(good + bad)], pa.binary())], schema=_BLOCKS)

    now, held = None, {}
    for batch in batches:
        for block, i, quality, size, told in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "quality", "size", "features")), strict=True):
            if block != now:
                yield from packed(held)
                now, held = block, {}
            if i not in held or (size, told) > held[i][1:]:
                held[i] = (quality, size, told)
    yield from packed(held)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of good rows, rows) of each block."""
    for batch in batches:
        for n_good, rows in zip(batch.column("n_good"), batch.column("rows"), strict=True):
            yield n_good.as_py(), np.frombuffer(rows.as_buffer(), np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _each_task(blocks: DataFrame, run) -> list[list[np.ndarray]]:
    """What ``run`` makes of the blocks of each task, a few arrays of float64 or float32."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = run(_blocks_of(batches))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(a, a.dtype).tobytes()], pa.binary()) for a in out], names=[f"a{i}" for i in range(3)])

    return [list(r) for r in blocks.mapInArrow(lean(told), "a0 binary, a1 binary, a2 binary").collect()]


def _moments(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of good and bad rows, and mean and standard deviation of each feature."""

    def run(each):
        n, mean, squares = np.zeros(2), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for n_good, rows in each:
            n, mean, squares = _joined((n, mean, squares), (np.array([n_good, len(rows) - n_good], float), rows.mean(axis=0), rows.var(axis=0) * len(rows)))
        return (n, mean, squares) if n.any() else None

    n, mean, squares = reduce(_joined, [tuple(np.frombuffer(a) for a in t) for t in _each_task(blocks, run)])
    return n, mean, np.sqrt(squares / n.sum())


def _joined(a: tuple, b: tuple) -> tuple:
    """Counts, means and sums of squares about them, of two sets together."""
    na, nb = a[0].sum(), b[0].sum()
    apart = b[1] - a[1]
    return a[0] + b[0], a[1] + apart * nb / (na + nb), a[2] + b[2] + apart**2 * na * nb / (na + nb)


def _cut(told: DataFrame, n: np.ndarray, share_bad: float) -> float:
    """The utility quantile of ``fit_ranking`` over a table of utilities ``u`` and marks ``good``.

    The values between which it lies are cut in ``BINS`` until one value is left, so only counts come to the driver.
    """
    good, bad = (1 - share_bad) / n[0], share_bad / n[1]
    weight = lambda r: r["g"] * good + r["b"] * bad
    sums = (F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"), F.min("u").alias("lo"), F.max("u").alias("hi"))
    here = told.agg(*sums).first()
    seen, before, after = (0, 0), None, None
    while here["lo"] < here["hi"]:
        lo, hi = F.lit(here["lo"]), F.lit(here["hi"])
        bins = told.where(F.col("u").between(lo, hi)).groupBy(F.floor((F.col("u") - lo) / (hi - lo) * BINS).alias("bin")).agg(*sums).orderBy("bin").collect()
        for at, here in enumerate(bins):  # noqa: B007, B020
            if seen[0] * good + seen[1] * bad + weight(here) >= share_bad - 1e-12 or at == len(bins) - 1:
                break
            seen = (seen[0] + here["g"], seen[1] + here["b"])
        before = bins[at - 1]["hi"] if at else before
        after = bins[at + 1]["lo"] if at + 1 < len(bins) else after
    u, last = here["lo"], bad if here["b"] else good
    inside = seen[0] * good + seen[1] * bad + weight(here) - last >= share_bad - 1e-12
    if after is None:  # the last value of all
        return u if here["g"] + here["b"] > 1 else (before + u) / 2
    return u if inside else (u + after) / 2


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Ranking | None:
    """A ranking from all labelled rows that are not held out; None if one of the two labels is missing.

    Texts are dealt by a hash of their id in blocks of about ``BLOCK`` of the commoner label, and every text meets ``PAIRS_EACH`` or more of the other
    label in its block. Where the rarer label has fewer than ``LEAST`` texts a block, each is copied into several blocks. The loss is the sum over all blocks;
    a Newton step is one pass over the blocks, of which at most ``TASKS`` sums come to the driver. The share of bad labels is that
    of all labelled ids. An id that is labelled more than once counts once, and not at all if its labels differ. Of documents
    that repeat an id the longest is learned from.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)").where(~held_out("id"))
    known = known.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    known = scratch.save(known, "known")
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).where(~held_out("id"))
    each = lambda rows: {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    counts = each(known)
    few = F.broadcast(known) if sum(counts.values()) <= MOST_SENT else known
    found = each(known.join(texts.select("id"), "id", "left_semi"))
    if len(found) < 2:
        return None
    n_blocks = -(-max(found.values()) // BLOCK)
    copies = F.when(F.col("quality") == 1, min(n_blocks, -(-LEAST * n_blocks // found[1]))).otherwise(min(n_blocks, -(-LEAST * n_blocks // found[0])))
    told = texts.join(few, "id").select(F.col("id").cast("string").alias("id"), "quality", "text").mapInArrow(lean(_featurise), "id string, quality int, size int, features binary")
    dealt = told.withColumn("block", F.explode(F.sequence(F.lit(0), copies - 1))).withColumn("block", (F.pmod(F.xxhash64("id"), F.lit(n_blocks)) + F.col("block")) % n_blocks)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    with few_rows_a_batch(spark, BLOCK):
        dealt = dealt.repartition(parts, "block").sortWithinPartitions("block", "id")
        blocks = scratch.save(dealt.mapInArrow(lean(_pack), "n_good int, rows binary"), "blocks")
    with few_rows_a_batch(spark, 1):
        ranking = _fit_blocks(blocks.coalesce(TASKS), scratch, counts[0] / (counts[0] + counts[1]))
    scratch.drop("known", "blocks", "utilities")
    return ranking


def _fit_blocks(blocks: DataFrame, scratch: Scratch, share_bad: float) -> Ranking:
    n, mean, scale = _moments(blocks)
    scale = scale + 1e-6
    upper = np.triu_indices(N_FEATURES)

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(each):
            out = None
            for n_good, rows in each:
                told = _sums((rows - mean) / scale, n_good, w, PAIRS_EACH)
                out = told if out is None else tuple(a + b for a, b in zip(out, told, strict=True))
            return out and (np.array([out[0]]), out[1], out[2][upper])

        loss, gradient, curvature = 0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))
        for a, b, c in _each_task(blocks, run):
            loss += np.frombuffer(a)[0]
            gradient += np.frombuffer(b)
            curvature[upper] += np.frombuffer(c, np.float32)
        return loss, gradient, curvature + np.triu(curvature, 1).T

    w = _newton(sums, N_FEATURES, PENALTY)

    def utilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n_good, rows in _blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(((rows - mean) / scale) @ w), pa.array(np.arange(len(rows)) < n_good).cast(pa.int32())], names=["u", "good"])

    told = scratch.save(blocks.mapInArrow(lean(utilities), "u double, good int"), "utilities")
    return Ranking(mean, scale, w, _cut(told, n, share_bad))


def score_quality(docs: DataFrame, ranking: Ranking | None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the columns ``keep`` of every row; with nothing learned every score is the threshold.

    Scores depend on the text alone; a null text is an empty one, which has a score like any other. Of ``docs``,
    columns not named are dropped.
    """
    ship_package(docs.sparkSession)
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    # a text that is kept is sent once
    sent = next((f"keep_{i}" for i, c in enumerate(keep) if c == text_col), None) if dict(docs.dtypes).get(text_col) == "string" else None
    ready = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), *kept, *([] if sent else [text_bytes(text_col).alias("bytes")]))
    names = [c for c in ready.columns if c != "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("bytes") if sent is None else batch.column(sent).cast(pa.binary())
            for lo, hi, data, offsets in runs_of_texts(texts):
                scores = ranking.text_scores(data, offsets) if ranking else np.full(hi - lo, THRESHOLD)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[lo:hi] for c in names), pa.array(scores)], names=[*names, "score"])

    scored = ready.mapInArrow(lean(run), T.StructType([*(f for f in ready.schema.fields if f.name != "bytes"), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranking = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, ranking)

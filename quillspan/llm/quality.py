"""Quality classifier: supervised subword embeddings.

A document's features are its words, its pairs of words in a row, the byte 3- and 4-grams of its words
(a gram may hold the space before or after a word, not one inside) and, for each word, how far back it
stood last (as a power of two: repetition is a sign of quality that no list of words holds), each hashed to
a row of a table of learned vectors. The vectors are averaged over each kind of feature and then over the kinds, so that words
weigh as much as the more frequent byte grams, and a softmax layer is put on the average; all is learned by
stochastic gradient descent in numpy, on at most ``sample`` labelled rows (those whose digest of doc_id is
least). That bounded sample is fitted inside one task, which a lost executor starts again; only the model, of
fixed size, comes to the driver.

For a score of two classes, the dot product of each vector with the difference of the output rows is all
that is needed, so scoring sums one number a feature over the whole text, in batches of Arrow rows.

Null and empty texts have no features: their score is the softmax of the biases. Equal texts have equal
scores. Without labelled rows of both classes the score is the share of label 1 (0.5 if none). Tables
without rows give none. Labels join on doc_id; repeated labels of a document count once (the greatest). Rows
without a doc_id are never learned from and count as held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import small_batches
from quillspan.llm.tokens import Hashes, U, mix, pieces, solid

BITS = 18
_WHITE = np.array([32, *range(9, 14)], dtype=np.uint8)
DIM = 8


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null doc_id has no label to learn."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how many are before each row and after the last) for each kind of feature."""
    starts, ends, first = solid(data, offsets)
    h = Hashes(data).of(starts, ends)
    top = U(64 - BITS)
    yield (mix(h ^ U(1)) >> top).astype(np.int32), first
    pair = mix(h[1:] * U(3) + h[:-1]) >> top
    per = np.maximum(np.diff(first) - 1, 0)
    before = np.concatenate([[0], np.cumsum(per)])
    row = np.repeat(np.arange(len(per)), per)
    yield pair[first[row] + np.arange(before[-1]) - before[row]].astype(np.int32), before
    yield (mix(_back(h, first).astype(np.uint64) + U(4000)) >> top).astype(np.int32), first
    white = np.isin(data, _WHITE)
    wide = np.where(white, 32, data).astype(np.uint32)
    for n in (3, 4):
        if len(data) < n:
            yield np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
            continue
        g = np.zeros(len(data) - n + 1, dtype=np.uint32)
        for k in range(n):
            g = g * np.uint32(257) + wide[k : len(data) - n + 1 + k]
        g *= np.uint32(2654435761)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(2246822519) + np.uint32(n)
        g >>= np.uint32(32 - BITS)
        inside = np.ones(len(g), dtype=bool)
        for k in range(1, n):  # grams that would cross into the next row
            at = offsets[1:-1] - k
            inside[at[(at >= 0) & (at < len(g))]] = False
        for k in range(1, n - 1):  # and those that reach from one word into another
            inside &= ~white[k : len(data) - n + 1 + k]
        before = np.concatenate([[0], np.cumsum(inside)])[np.minimum(offsets, len(g))]
        yield g[inside].astype(np.int32), before


def _back(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the binary logarithm of the words since it stood last in its row; 40 if it didn't."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = h ^ mix(row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    far = np.full(len(h), 40, dtype=np.int64)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    far[order[same + 1]] = np.log2(order[same + 1] - order[same]).astype(np.int64)
    return far


def rowsums(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[before[1:]] - sums[before[:-1]]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, buckets, weights) of each row: its distinct features and their shares."""
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in pieces(batch.column("text")):
            kinds = list(features(data, offsets))
            ids, shares = [], []
            for i in range(hi - lo):
                own = [x[b[i] : b[i + 1]] for x, b in kinds]
                f, back = np.unique(np.concatenate(own), return_inverse=True)
                share = np.concatenate([np.full(len(x), 1 / (len(kinds) * max(1, len(x)))) for x in own])
                ids.append(f.astype("<i4").tobytes())
                shares.append(np.bincount(back, share, len(f)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels[lo:hi], pa.int32()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["label", "ids", "shares"])


def fit(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, epochs: int = 3, least_steps: int = 600, batch: int = 16, rate: float = 0.3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learn vectors and a softmax layer; returns each feature's number and the bias of label 1 over 0."""
    n = len(labels)
    share = float(labels.mean()) if n else 0.5
    if n == 0 or share in (0.0, 1.0):
        edge = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(1 << BITS, dtype=np.float32), float(np.log(edge / (1 - edge)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    output = ((rng.random((DIM, 2)) - 0.5) / DIM).astype(np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], dtype=np.float32)
    seen = np.full(1 << BITS, 1e-8, dtype=np.float32)  # squared steps so far: rare features step further
    seen_out = 1e-8
    steps = max(epochs * -(-n // batch), least_steps)
    order = np.concatenate([rng.permutation(n) for _ in range(-(-steps * batch // n))])
    for s in range(steps):
        rows = order[s * batch : (s + 1) * batch]
        f = np.concatenate([ids[r] for r in rows])
        w = np.concatenate([shares[r] for r in rows])
        where = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
        x = np.zeros((len(rows), DIM), dtype=np.float32)
        np.add.at(x, where, vectors[f] * w[:, None])
        z = x @ output + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), labels[rows]] -= 1
        decay = rate * (1 - s / steps)
        back = (p @ output.T)[where] * w[:, None]
        np.add.at(seen, f, (back**2).mean(axis=1))
        np.add.at(vectors, f, -decay * back / np.sqrt(seen[f])[:, None])
        g = x.T @ p
        seen_out += float((g**2).mean())
        output -= decay * g / np.sqrt(seen_out)
        bias -= 0.1 * decay * p.mean(axis=0)
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows of ``docs`` that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = rows.mapInArrow(counted, "label int, ids binary, shares binary").repartition(1).mapInArrow(_fitted, "number binary, bias double").first()
    return np.frombuffer(got["number"], dtype=np.float32), got["bias"]


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all rows of the sample, in the same order whatever the partitions; of no row too."""
    own: list[tuple[bytes, int, np.ndarray, np.ndarray]] = []
    for batch in batches:
        for label, ids, shares in zip(batch.column("label").to_pylist(), batch.column("ids").to_pylist(), batch.column("shares").to_pylist(), strict=True):
            own.append((hash_of(ids, shares), label, np.frombuffer(ids, dtype="<i4"), np.frombuffer(shares, dtype="<f4")))
    own.sort(key=lambda x: x[:2])
    number, bias = fit([x[2] for x in own], [x[3] for x in own], np.array([x[1] for x in own], dtype=np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([number.tobytes()], pa.binary()), pa.array([bias])], names=["number", "bias"])


def hash_of(*parts: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(b"|".join(parts), digest_size=16).digest()


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` columns of every row, its score (0 to 1) and predicted (1 if the score reaches the threshold)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 1 MiB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bias = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in pieces(batch.column("__text")):
                kinds = list(features(data, offsets))
                out[lo:hi] = sum(rowsums(number[f], b) / np.maximum(np.diff(b), 1) for f, b in kinds) / len(kinds) + bias
            p = 1 / (1 + np.exp(-np.clip(out, -700, 700)))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    fields = [docs.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double, predicted int"
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text")).mapInArrow(run, schema)

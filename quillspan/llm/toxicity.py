"""Toxicity: maximum-scoring segment search over token log-odds with Dirichlet priors.

Every labelled row that isn't held out counts, with its own label and the weight 1 / n, where n rows are copies of
it (rows that agree in two minima of their five-word hashes: exact and most near copies). In how many rows
a token (a lower-cased word's 32-bit hash) stands is counted for both labels; a Dirichlet prior of ``PRIOR`` rows,
dealt to the tokens in proportion to their share of all labelled rows, is added to both. The log-odds that are ``SURE``
standard errors from 0 are kept, less these errors, with their sign: at most ``most_tokens``, the surest. All other
tokens share one log-odds, that of their common mass, which is under 0 as toxic rows spend words on toxic tokens.

One linear scan of each whole text finds every maximal-scoring segment (those that no extension or part
betters). A token counts at each of its places, but for repeats within ``NEAR`` words, which are one piece of evidence. Segments'
scores are put on the scale of the greatest chance segment in clean text of that length (a Gumbel law: lambda from
the token scores' distribution in clean rows, K from clean rows' best segments), and those that are significant are summed. A
logistic curve over this sum, fitted on at most ``sample`` labelled rows, gives the score.

Null and empty texts have no segments and score as the cleanest texts do. Equal texts have equal scores.
Without labelled rows of both classes no token is toxic and the score is the share of label 1, under a
half. Tables without rows give none. Repeated labels of a document count once (the greatest). Rows without a doc_id
teach nothing and are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.quality import held_out
from quillspan.llm.scratch import IdFilter, Scratch, small_batches
from quillspan.llm.tokens import U, grams, mix, pieces, word_hashes

PRIOR = 100.0  # rows
SURE = 3.0  # standard errors
LEAST = 0.5  # log-odds that are surely at least this far from 0 count
NEAR = 50  # words
SALTS = 32


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, first = word_hashes(data, offsets)
    return (h >> U(32)).astype(np.uint32), first


def _sketched(labelled: IdFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows that may be labelled: the distinct tokens, and a name that copies and most near copies share."""
        for batch in batches:
            batch = batch.filter(pa.array(labelled(batch.column("h").to_numpy())))
            for lo, hi, data, offsets in pieces(batch.column("text")):
                h, first = word_hashes(data, offsets)
                t = (h >> U(32)).astype("<u4")
                g, before = grams(h, first, 5)
                other = mix(g ^ U(0x5851F42D4C957F2D))
                own, keys = [], []
                for i in range(hi - lo):
                    own.append(np.unique(t[first[i] : first[i + 1]]).tobytes())
                    a, b = before[i], before[i + 1]
                    keys.append(int(mix(g[a:b].min(keepdims=True) + mix(other[a:b].min(keepdims=True)))[0] >> U(1)) if b > a else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(keys, pa.int64()), pa.array(own, pa.binary())], names=["doc_id", "key", "tokens"])

    return run


def _tally(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(token, toxic, clean): the weight of the rows in which a token stands, by task, in parts of bounded size."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, back = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return t, *(np.bincount(back, np.concatenate([x[k] for x in held]), len(t)) for k in (1, 2))

    for batch in batches:
        for label, weight, own in zip(batch.column("label").to_pylist(), batch.column("weight").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
            t = np.frombuffer(own, dtype="<u4")
            w = np.full(len(t), weight)
            held.append((t, w, np.zeros(len(t))) if label > 0 else (t, np.zeros(len(t)), w))
            size += len(t)
        if size > 2 * most:
            held = [added()]
            size = len(held[0][0])
            if size > most:
                yield _counts(*held[0])
                held, size = [], 0
    if held:
        yield _counts(*added())


def _counts(t: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(t.view("<i4")), pa.array(toxic.astype("<f4")), pa.array(clean.astype("<f4"))], names=["token", "toxic", "clean"])


def log_odds(counts: DataFrame, toxic: float, clean: float) -> DataFrame:
    """Tokens with their surely kept log-odds (0 if there are none) and how many standard errors they have."""
    a = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(toxic + clean)
    t, c = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(t / F.greatest(F.lit(toxic + PRIOR) - t, F.lit(0.5))) - F.log(c / F.greatest(F.lit(clean + PRIOR) - c, F.lit(0.5)))
    error = F.sqrt(1 / t + 1 / c)
    low = F.greatest(F.abs(odds) - SURE * error, F.lit(0.0))
    return counts.select("token", "toxic", "clean", F.when(low > LEAST, F.signum(odds) * low).otherwise(0.0).alias("score"), (F.abs(odds) / error).alias("sure"))


def segments(score: np.ndarray, tokens: np.ndarray) -> list[float]:
    """Scores of all maximal-scoring segments, in one pass over the positive tokens.

    Between them the running sum only falls, so the scan needs the sums just before and just after each. A token
    that stood less than ``NEAR`` words before costs and gains nothing.
    """
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    order = up[np.argsort(tokens[up], kind="stable")]
    again = order[1:][(tokens[order[1:]] == tokens[order[:-1]]) & (np.diff(order) < NEAR)]
    if len(again):
        score = score.copy()
        score[again] = 0
        up = np.setdiff1d(up, again, assume_unique=True)
    sums = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    found: list[list[float]] = []  # [sum before, sum after] of candidates
    for left, right in zip(sums[up].tolist(), sums[up + 1].tolist(), strict=True):
        new = [left, right]
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= new[0]:
                k -= 1
            if k < 0 or found[k][1] >= new[1]:
                found.append(new)
                break
            new = [found[k][0], new[1]]
            del found[k:]
    return [r - l for l, r in found]


class Model:
    """Tokens that have a score of their own, the score of all others, lambda and K of the chance law, and the logistic curve."""

    def __init__(self, tokens: np.ndarray, scores: np.ndarray, drift: float):
        order = np.argsort(tokens)
        self.tokens, self.scores, self.drift = tokens[order], scores[order].astype(np.float32), drift
        self.lam, self.k, self.slope, self.base = 1.0, 1.0, 0.0, 0.0

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's score."""
        if not len(self.tokens):
            return np.full(len(tokens), self.drift, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.scores[at], np.float32(self.drift))

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """Words of each row, and its segments' scores times lambda."""
        t, first = tokens_of(data, offsets)
        s = self.of(t)
        above = np.concatenate([[0], np.cumsum(s > 0)])[first]
        out: list[list[float]] = [[] for _ in range(len(first) - 1)]
        for i in np.flatnonzero(np.diff(above)):
            own = slice(int(first[i]), int(first[i + 1]))
            out[i] = [self.lam * x for x in segments(s[own], t[own])]
        return np.diff(first), out

    def evidence(self, size: np.ndarray, found: list[list[float]]) -> np.ndarray:
        """Sum of the significant segments' calibrated scores of each row."""
        return np.array([sum(max(0.0, x - float(np.log(max(1.0, self.k * n)))) for x in own) for n, own in zip(size.tolist(), found, strict=True)])

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.base, -700, 700)))


def chance_lambda(scores: np.ndarray, weight: np.ndarray) -> float:
    """The root of sum(weight * exp(lambda * score)) = 1 over clean text."""
    p = weight / max(weight.sum(), 1e-12)
    low, high = 1e-4, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        if float((p * np.exp(np.minimum(mid * scores, 500))).sum()) > 1:
            high = mid
        else:
            low = mid
    return low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and base of the likeliest curve over log(1 + x), with a weak prior on the slope.

    Newton's steps are halved until the likelihood rises, so rows that a line parts don't make them diverge.
    """
    a = np.stack([np.log1p(x), np.ones(len(x))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.005 * w[0] ** 2)

    w = np.array([0.0, np.log(max(y.mean(), 1e-3) / max(1 - y.mean(), 1e-3))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2 * w[0], 0.0]))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 6000, most_tokens: int = 200_000) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.filter("doc_id is not null").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"), F.xxhash64("doc_id").alias("h"))
    sketches = scratch.keep(texts.mapInArrow(_sketched(IdFilter(known, "doc_id")), f"doc_id {kind}, key long, tokens binary"), "sketches")
    # copies' weight: what is joined are ids and names; a hot name's rows are salted
    named = sketches.select("doc_id", "key").join(known, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = named.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1 and key is not null").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    weighed = scratch.keep(named.join(copies, ["key", "salt"], "left").select("doc_id", "label", (1 / F.coalesce("n", F.lit(1))).alias("weight")).distinct(), "weights")
    rows = weighed.agg(F.sum(F.when(F.col("label") > 0, F.col("weight"))), F.sum(F.when(F.col("label") <= 0, F.col("weight")))).first()
    toxic, clean = (float(x or 0.0) for x in rows)
    if not toxic or not clean:
        model = Model(np.zeros(0, dtype=np.uint32), np.zeros(0), -0.01)
        share = min(max(toxic / max(1.0, toxic + clean), 1e-3), 0.49)
        model.base = float(np.log(share / (1 - share)))
        return model
    counts = sketches.join(weighed, "doc_id").select("label", "weight", "tokens").mapInArrow(_tally, "token int, toxic float, clean float")
    judged = scratch.keep(log_odds(counts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), toxic, clean), "tokens")
    own = judged.filter("score <> 0").orderBy(F.desc("sure"), "token").limit(most_tokens).select("token", "score", "clean").toPandas()
    mass = judged.agg(F.sum("toxic"), F.sum("clean"), F.sum(F.when(F.col("score") == 0, F.col("toxic"))), F.sum(F.when(F.col("score") == 0, F.col("clean")))).first()
    t_all, c_all, t_rest, c_rest = (max(float(x or 0.0), 1e-9) for x in mass)
    model = Model(own["token"].to_numpy(dtype=np.int32).view(np.uint32), own["score"].to_numpy(dtype=float), min(float(np.log(t_rest / t_all) - np.log(c_rest / c_all)), -0.005))
    if not len(own) or not (own["score"] > 0).any():
        model.base = float(np.log(toxic / (toxic + clean) / 2))
        return model
    model.lam = chance_lambda(np.append(own["score"].to_numpy(dtype=float), model.drift), np.append(own["clean"].to_numpy(dtype=float) + 0.5 * (own["score"] > 0), c_rest))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    few = texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                size, found = model.found(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array(size), pa.array(found, pa.list_(pa.float64()))], names=["label", "n", "found"])

    seen = few.mapInArrow(measured, "label int, n long, found array<double>").toPandas()
    found = [[] if f is None else list(f) for f in seen["found"]]
    best = np.array([max(x, default=0.0) for x in found])
    y, size = (seen["label"].to_numpy(dtype=float) > 0).astype(float), np.maximum(seen["n"].to_numpy(dtype=float), 1)
    # chance law P(best < x) = exp(-K n e^-x): the likelihood's K over clean rows that have a segment or none
    calm = y == 0
    k = float(((best[calm] > 0).sum() + 0.5) / np.maximum((size[calm] * np.exp(-best[calm])).sum(), 1.0)) if calm.any() else 1.0
    model.k = min(max(k, 1e-6), 1.0)
    model.slope, model.base = logistic(model.evidence(size, found), y)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns of every row, its score (0 to 1) and predicted (1 if the score reaches the threshold)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a token, of which ``most_tokens`` at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in pieces(batch.column("__text")):
                p[lo:hi] = shared.value.probability(shared.value.evidence(*shared.value.found(data, offsets)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"
    return docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("__text")).mapInArrow(run, schema)

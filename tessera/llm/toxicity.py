"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. Of the labelled rows, at most ``max_examples`` of either class (those with
   the smallest hash of the id) become examples; that bound does not grow with
   the corpus.  Words and word beginnings of 3 to 7 characters that are
   markedly commoner in one class than the other, at most ``max_features``,
   are the dimensions.
2. Their document frequencies are counted over the whole corpus.
3. The examples' TF-IDF vectors form an inverted index in blocks of examples;
   for each feature and block the largest weight is kept.  The index is bounded by
   examples x features and is broadcast.
4. Each document's neighbours are found exactly: blocks are visited by
   descending upper bound, the sum of the query's weights times the blocks'
   largest ones, until no bound exceeds the k-th best similarity.  The
   neighbours vote with their similarity, classes weighted back to their share of
   the labelled rows; a logistic curve fitted on the examples, each without
   itself, turns votes into probabilities.

Learning and scoring are narrow passes over whole texts with one small
aggregation each; texts are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import ALNUM, column, slices
from tessera.plans.staging import Staging

PREFIXES = range(3, 8)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode().translate(ALNUM).split()


def features_of(word: bytes) -> list[str]:
    """The word, and its beginnings marked with ^."""
    text = word.decode("utf-8", "replace")
    return [text, *("^" + text[:k] for k in PREFIXES if len(text) > k)]


class KnownFeatures(dict):
    """Numbers of the chosen features of a word; forgets all words when there are very many."""

    def __init__(self, names: list[str]):
        self.number = {f: i for i, f in enumerate(names)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        found = self[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return found

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The feature numbers of a text, ascending, and how often each occurs."""
        found = [i for f in map(self.__getitem__, words_of(text)) if f for i in f]
        return np.unique(np.array(found, np.int64), return_counts=True)


@dataclass
class Index:
    """Examples by feature, cut into blocks of consecutive examples."""

    names: list[str]
    idf: np.ndarray
    ids: list
    label: np.ndarray
    weight: np.ndarray  # of each example's vote: its class's labelled rows per example
    block: int
    start: np.ndarray  # features x (blocks + 1): where each block's postings begin
    example: np.ndarray
    value: np.ndarray
    largest: np.ndarray  # features x blocks
    k: int
    prior: float
    strength: float
    curve: tuple[float, float]

    def vector(self, feats: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[feats]
        length = np.sqrt((v * v).sum())
        return v / length if length else v

    def nearest(self, feats: np.ndarray, counts: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of the largest positive cosine (ties: smaller number first), and those cosines."""
        q = self.vector(feats, counts)
        bound = q @ self.largest[feats]
        best_n, best_s = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 0 or len(best_s) == self.k and bound[b] * (1 + 1e-9) < best_s[-1]:
                break
            scores = np.zeros(self.block)
            for f, w in zip(feats, q, strict=True):
                lo, hi = self.start[f, b], self.start[f, b + 1]
                scores[self.example[lo:hi] - b * self.block] += w * self.value[lo:hi]
            if b * self.block <= skip < (b + 1) * self.block:
                scores[skip - b * self.block] = 0
            at = np.flatnonzero(scores > 0)
            n, s = np.concatenate((best_n, at + b * self.block)), np.concatenate((best_s, scores[at]))
            order = np.lexsort((n, -s))[: self.k]
            best_n, best_s = n[order], s[order]
        return best_n, best_s

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * self.weight[near]
        return float(((w * self.label[near]).sum() + self.strength * self.prior) / (w.sum() + self.strength))

    def score(self, feats: np.ndarray, counts: np.ndarray, skip: int = -1, raw: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        near, cosine = self.nearest(feats, counts, skip) if len(feats) else (np.empty(0, np.int64), np.empty(0))
        v = self.vote(near, cosine)
        if raw or not len(near):
            return v, near, cosine
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b)))), near, cosine


def _platt(votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the log-odds of the votes; (1, 0) if one class is missing."""
    if len(set(label)) < 2:
        return 1.0, 0.0
    x = np.stack((np.log(votes / (1 - votes)), np.ones(len(votes))), 1)
    theta, weight = np.array([1.0, 0.0]), weight / weight.mean()
    for _ in range(50):  # Newton steps with a small ridge towards the votes themselves
        p = 1 / (1 + np.exp(-x @ theta))
        grad = x.T @ (weight * (p - label)) + 1.0 * (theta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(2)
        theta = theta - np.linalg.solve(hess, grad)
    return (float(theta[0]), float(theta[1])) if np.isfinite(theta).all() and theta[0] > 0 else (1.0, 0.0)


def choose_features(counts: DataFrame, n_toxic: int, n_clean: int, max_features: int, least: int, ratio: float, significance: float) -> pd.DataFrame:
    """The features whose share of the examples differs most between the classes, at most ``max_features``."""
    a, b = (F.col("toxic") + 0.5) / (n_toxic + 1), (F.col("clean") + 0.5) / (n_clean + 1)
    odds = F.abs(F.log(a / b))
    seen = F.greatest("toxic", "clean")
    ranked = counts.where((F.col("toxic") + F.col("clean")) >= least).withColumn("rank", odds * F.sqrt(seen)).where((odds >= float(np.log(ratio))) & (F.col("rank") >= significance))
    return ranked.orderBy(F.desc("rank"), "feature").limit(max_features).select("feature").toPandas()


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = 4096,
    max_features: int = 4096,
    least: int = 5,
    ratio: float = 5.0,
    significance: float = 7.0,
    k: int = 15,
    block: int = 64,
    strength: float = 0.05,
) -> Index | None:
    """The index of the labelled examples, or None if there is no labelled document.

    ``labels`` has (id, label 0/1); null ids and labels do not count, and a document
    with several labels counts as toxic if one says so.
    """
    staging = Staging(docs.sparkSession, "toxicity")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    share = {int(r["_y"]): int(r["n"]) for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_examples) for y in (0, 1)]
    chosen = staging.keep(parts[0].union(parts[1]), "chosen")  # 2 * max_examples rows at most
    texts = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(chosen), "_id")
    texts = staging.keep(texts, "examples")
    have = {int(r["_y"]): int(r["n"]) for r in texts.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not have:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(column(batch, "_text").to_pylist(), column(batch, "_y").to_pylist(), strict=True):
                seen[y].update({f for w in set(words_of(text)) for f in features_of(w)})
            both = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([seen[y][f] for f in both], pa.int64()) for y in (1, 0))], ["feature", "toxic", "clean"])

    tally = texts.mapInArrow(count, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    names = list(choose_features(tally, have.get(1, 0), have.get(0, 0), max_features, least, ratio, significance)["feature"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_features, df, n = KnownFeatures(names), np.zeros(len(names) + 1, np.int64), 0
        for batch in slices(batches, "_text"):
            for text in column(batch, "_text").to_pylist():
                feats, _ = known_features.counts(text)
                df[feats] += 1
            n += batch.num_rows
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], ["f", "n"])

    found = docs.select(docs[text_col].alias("_text")).mapInArrow(frequencies, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(names) + 1)
    df[found["f"].to_numpy(np.int64)] = found["n"].to_numpy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1e-6

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_features = KnownFeatures(names)
        for batch in slices(batches, "_text"):
            rows = [known_features.counts(t) for t in column(batch, "_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), column(batch, "_y"), *(pa.array([r[j].tolist() for r in rows], pa.list_(pa.int64())) for j in (0, 1))], ["_id", "_y", "f", "n"])

    kind = texts.schema["_id"].dataType.simpleString()
    made = texts.mapInArrow(vectors, f"_id {kind}, _y int, f array<bigint>, n array<bigint>").toPandas()
    # Like examples side by side, so that blocks have telling bounds.
    made["first"] = [int(f[np.argmax(idf[f])]) if len(f) else -1 for f in made["f"]]
    made = made.sort_values(["first", "_y", "_id"], ignore_index=True)
    return build_index(made, names, idf, share, have, k, block, strength)


def build_index(made: pd.DataFrame, names: list[str], idf: np.ndarray, share: dict, have: dict, k: int, block: int, strength: float) -> Index:
    """The index over examples (_id, _y, f, n); its size is bounded by the examples and features."""
    label = made["_y"].to_numpy(np.float64)
    per = {y: share[y] / have[y] for y in have}
    weight = np.array([per[y] for y in made["_y"]])
    weight /= weight.min()
    blocks = -(-len(made) // block)
    index = Index(names, idf, list(made["_id"]), label, weight, block, np.zeros((len(names), blocks + 1), np.int64), np.empty(0, np.int64), np.empty(0), np.zeros((len(names), blocks)), k, 0.0, strength, (1.0, 0.0))
    feats = [np.asarray(f, np.int64) for f in made["f"]]
    counts = [np.asarray(n, np.float64) for n in made["n"]]
    sizes = [len(f) for f in feats]
    flat = np.concatenate(feats) if sum(sizes) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(made)), sizes)
    value = np.concatenate([index.vector(f, n) for f, n in zip(feats, counts, strict=True)]) if sum(sizes) else np.empty(0)
    order = np.lexsort((owner, flat))
    flat, index.example, index.value = flat[order], owner[order], value[order]
    key = flat * (blocks + 1) + index.example // block
    index.start = np.searchsorted(key, np.arange(len(names))[:, None] * (blocks + 1) + np.arange(blocks + 1)[None, :])
    np.maximum.at(index.largest, (flat, index.example // block), index.value)
    bare = np.array([s == 0 for s in sizes])
    clip = lambda p: float(min(max(p, 1e-4), 1 - 1e-4))
    index.prior = clip(((weight * label)[bare].sum() + 0.5 * label.mean()) / (weight[bare].sum() + 0.5)) if bare.any() else clip((weight * label).sum() / weight.sum())
    held = np.flatnonzero(~bare)
    votes = np.array([index.score(feats[i], counts[i], skip=i, raw=True)[0] for i in held])
    if len(held):
        index.curve = _platt(votes, label[held], weight[held])
    return index


def score(df: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence) of each row: the probability of a toxic label and the nearest examples.

    ``evidence`` lists (id, cosine, label) of the neighbours, nearest first.  A
    text that shares no feature with any example, a null or empty one among
    them, has no evidence and the share of toxic rows among such examples.
    Without an index every score is 0.  Repeated rows score alike; a row's own
    example counts as a neighbour.  Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, score double, evidence array<struct<id:{kind},cosine:double,label:int>>"
    rows = df.select(df[id_col].alias("_id"), df[text_col].alias("_text"))
    if index is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(0.0).alias("score"), F.from_json(F.lit("[]"), f"array<struct<id:{kind},cosine:double,label:int>>").alias("evidence"))
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        known_features = KnownFeatures(ix.names)
        for batch in slices(batches, "_text"):
            id_type = column(batch, "_id").type
            scores, evidence = [], []
            for text in column(batch, "_text").to_pylist():
                feats, counts = known_features.counts(text)
                s, near, cosine = ix.score(feats, counts)
                scores.append(s)
                evidence.append([{"id": ix.ids[n], "cosine": float(min(c, 1.0)), "label": int(ix.label[n])} for n, c in zip(near, cosine, strict=True)])
            proof = pa.list_(pa.struct([("id", id_type), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([column(batch, "_id"), pa.array(scores, pa.float64()), pa.array(evidence, proof)], ["_id", "score", "evidence"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)

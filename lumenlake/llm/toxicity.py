"""Toxicity by nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

Terms are words and their leading letters, as insults are inflected. The vocabulary
keeps the terms that tell the classes apart, learnt from labelled documents; texts
become normalised TF-IDF vectors over it. Examples with one and the same vector are
one entry with its numbers of labels. The index lists, for each term and each block
of entries, the block's largest weight: their sum bounds every cosine in a block,
and blocks are opened from the best bound down until none can enter the nearest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import discard, stored

WORD = re.compile(r"\w+")
# Lengths of the leading letters that are terms beside the word.
LEADING = (4, 5)
# The model is fitted on about so many labelled documents at most, chosen by a hash of their ids.
EXAMPLES = 20_000
# Terms in the vocabulary at most, the most telling first.
TERMS = 4096
# A term must be this many times more frequent in one class, in at least so many documents, and have at least
# this likelihood-ratio statistic. Chosen on a fold of the training rows (crc32 of the id modulo 5 is 1).
RATIO, LEAST, G2 = 4.0, 3, 15.0
BLOCK = 64
NEAREST = 15
# An example at distance d votes 1 / (d + SOFT); PRIOR votes go to the rate of examples without any term.
SOFT, PRIOR = 0.05, 1.0
SEED = 11


def terms(text: str) -> Counter[str]:
    """Terms of a text with their counts."""
    found: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        found[word] += n
        for length in LEADING:
            if len(word) > length:
                found[word[:length] + "*"] += n
    return found


@dataclass
class Model:
    """Vocabulary (term to place and inverse document frequency), entries and their block-max lists."""

    vocabulary: dict[str, tuple[int, float]]
    # Per entry: labelled documents, toxic ones among them, one of their ids.
    total: np.ndarray
    toxic: np.ndarray
    example: np.ndarray
    # Per term: entry numbers (ascending) and weights; block numbers and their largest weights.
    entries: list[np.ndarray]
    weights: list[np.ndarray]
    blocks: list[np.ndarray]
    most: list[np.ndarray]
    base: float

    def vector(self, text: str) -> tuple[list[int], list[float]]:
        """Places of the text's terms in the vocabulary and their normalised weights."""
        known, length, found = self.vocabulary, len, {}
        for word, n in Counter(WORD.findall(text.lower())).items():
            for term in (word, *(word[:k] + "*" for k in LEADING if length(word) > k)):
                if term in known:
                    found[term] = found.get(term, 0) + n
        places, weights = [], []
        for term, n in sorted(found.items(), key=lambda x: known[x[0]][0]):
            place, idf = known[term]
            places.append(place)
            weights.append((1 + math.log(n)) * idf)
        norm = math.sqrt(sum(w * w for w in weights))
        return places, [w / norm for w in weights]

    def nearest(self, places: list[int], weights: list[float], k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """The k entries of the largest cosine above 0 and these, exact; of equals the lower number first."""
        n_blocks = (len(self.total) + BLOCK - 1) // BLOCK
        bounds = np.zeros(n_blocks)
        for t, w in zip(places, weights):
            bounds[self.blocks[t]] += w * self.most[t]
        order = np.argsort(-bounds, kind="stable")
        best, entry, worst = np.empty(0), np.empty(0, np.int64), 0.0
        for at in range(0, n_blocks, 4):
            opened = order[at:at + 4]
            # A bound is a sum of rounded products, so blocks within rounding of the last place are opened too.
            if bounds[opened[0]] <= 0 or (len(best) == k and bounds[opened[0]] < worst - 1e-9):
                break
            for b in opened:
                scores = np.zeros(BLOCK)
                for t, w in zip(places, weights):
                    low, high = np.searchsorted(self.entries[t], (b * BLOCK, (b + 1) * BLOCK))
                    if low < high:
                        scores[self.entries[t][low:high] - b * BLOCK] += w * self.weights[t][low:high]
                hit = np.flatnonzero(scores > 0)
                best = np.concatenate((best, scores[hit]))
                entry = np.concatenate((entry, hit + b * BLOCK))
            keep = np.lexsort((entry, -best))[:k]
            best, entry = best[keep], entry[keep]
            worst = best[-1] if len(best) else 0.0
        return entry, best

    def score(self, text: str) -> tuple[float, list[int]]:
        """Probability of the label and the ids of the examples that speak for it or against it."""
        places, weights = self.vector(text)
        if not places:
            return self.base, []
        entry, cosine = self.nearest(places, weights)
        vote = 1 / (np.maximum(0.0, 1 - cosine) + SOFT)
        up = float((vote * self.toxic[entry]).sum()) + PRIOR * self.base
        return up / (float((vote * self.total[entry]).sum()) + PRIOR), self.example[entry].tolist()


def _g2(a: float, b: float, n_a: float, n_b: float) -> float:
    """Likelihood-ratio statistic of a term in a of n_a and b of n_b documents."""
    total = 0.0
    for seen, rest, n in ((a, n_a - a, n_a), (b, n_b - b, n_b)):
        for count, share in ((seen, (a + b) / (n_a + n_b)), (rest, 1 - (a + b) / (n_a + n_b))):
            if count > 0:
                total += 2 * count * math.log(count / (n * share))
    return total


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic) once per document."""
    for batch in batches:
        names, toxic = [], []
        for text, share in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            found = terms(text)
            names.extend(found)
            toxic.extend([share] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.float64())], names=["term", "toxic"])


def labelled_sample(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, text, toxic): about `examples` labelled documents outside the held-out fold, all if there are fewer."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    usable = labels.where(F.col("toxic").isNotNull() & (fold != 0)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("toxic"))
    share = min(1.0, examples / max(1, usable.count()))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000_000)) < int(share * 1_000_000_000)
    # About `examples` rows of two numbers: bounded by the parameter.
    chosen = F.broadcast(usable.where(drawn))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, n_terms: int = TERMS) -> Model:
    """Vocabulary and index from labelled documents; the model's size is bounded by the two parameters."""
    spark = docs.sparkSession
    scratch: list[str] = []
    sample = stored(labelled_sample(docs, labels, examples), scratch)
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    counted = sample.select("text", "toxic").mapInArrow(_document_terms, "term string, toxic double").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    p, q = (F.col("a") + 0.5) / (n_toxic + 1), (F.col("b") + 0.5) / (n - n_toxic + 1)
    telling = counted.where(((F.col("a") >= LEAST) & (p >= RATIO * q)) | ((F.col("b") >= LEAST) & (q >= RATIO * p)))
    # Most telling by a statistic that rises with G2; the exact test follows on the few left.
    ranked = telling.withColumn("gap", F.abs(F.col("a") / max(n_toxic, 1) - F.col("b") / max(n - n_toxic, 1))).orderBy(
        F.desc("gap"), "term").limit(n_terms).collect()
    kept = [r for r in ranked if _g2(r["a"], r["b"], n_toxic, n - n_toxic) >= G2]
    vocabulary = {r["term"]: (i, math.log((1 + n) / (1 + r["a"] + r["b"])) + 1) for i, r in enumerate(kept)}
    blank = Model(vocabulary, *(np.empty(0) for _ in range(3)), [], [], [], [], 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blank.vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["doc_id", "toxic", "places", "weights"])

    merged = sample.mapInArrow(vectors, "doc_id long, toxic double, places array<int>, weights array<double>").groupBy(
        "places", "weights").agg(F.count(F.lit(1)).alias("total"), F.sum("toxic").alias("toxic"), F.min("doc_id").alias("example"))
    rows = merged.collect()
    discard(spark, scratch)
    bare = [r for r in rows if not r["places"]]
    base = (sum(r["toxic"] for r in bare) + 0.5) / (sum(r["total"] for r in bare) + 1) if bare or not rows else n_toxic / n
    # Entries with the same leading terms lie side by side, so that block bounds are tight.
    rows = sorted((r for r in rows if r["places"]), key=lambda r: (r["places"], r["weights"]))
    lists: list[list[tuple[int, float]]] = [[] for _ in vocabulary]
    for entry, r in enumerate(rows):
        for t, w in zip(r["places"], r["weights"]):
            lists[t].append((entry, w))
    entries = [np.array([e for e, _ in part], np.int64) for part in lists]
    weights = [np.array([w for _, w in part]) for part in lists]
    blocks, most = [], []
    for e, w in zip(entries, weights):
        names, first = np.unique(e // BLOCK, return_index=True)
        blocks.append(names)
        most.append(np.maximum.reduceat(w, first) if len(w) else np.empty(0))
    return Model(vocabulary, np.array([r["total"] for r in rows], float), np.array([r["toxic"] for r in rows], float),
                 np.array([r["example"] for r in rows], np.int64), entries, weights, blocks, most, float(base))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of each whole text.

    `held_out` marks the fold that no label was learnt from (crc32 of the id as text
    divisible by 5; a null id is not in it). Only the text enters the score; a null or
    empty text, like one without a term of the vocabulary, has the rate of labelled
    documents without any. `evidence` lists ids of the nearest labelled examples. Rows
    stay as they are; other columns are ignored. Without labels every score is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            found = [fitted.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()),
                pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, evidence array<long>")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")

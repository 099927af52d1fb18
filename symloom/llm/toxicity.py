"""Toxicity from subword bags: hashed character n-gram vectors, averaged, into a linear softmax.

A word is the mean of the vectors of its character n-grams (with marks at either end), a document the mean of its
words, where n-grams count less the more frequent they are.  Vectors and softmax are trained together by gradient descent in numpy on a bounded sample of labelled
documents.  Misspellings that were never seen share most n-grams with the words that were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.blocks import ALNUM, U64, blocks, lower_ascii, prefix_hashes, span_hashes, text_bytes, word_spans

BUCKET_BITS = 18
SIZES = (3, 4, 5, 6)
#: labelled documents that the classifier is fitted on, of each class
SAMPLE = 1000
DIMS = 2
STEPS = 100
#: an n-gram of frequency p counts RARE / (RARE + p)
RARE = 2e-4
RATE = 0.2


def subwords(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the row of each word, the number of its distinct word, and the bucket, distinct word and weight of
    each n-gram; weights of a word sum to 1."""
    lowered = lower_ascii(raw)
    first, after, row = word_spans(lowered, starts, ALNUM)
    hashed = span_hashes(prefix_hashes(lowered), first, after)
    _, one, number = np.unique(hashed, return_index=True, return_inverse=True)
    size = (after - first)[one]
    # distinct words one after the other, each between < and >
    length = size + 2
    ends = np.cumsum(length)
    begin = ends - length
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(begin, length)
    word = np.repeat(np.arange(len(one)), length)
    source = np.repeat(first[one] - 1, length) + place
    chars = np.where(place == 0, 0x3C, np.where(place == length[word] - 1, 0x3E, 0)).astype(np.uint8)
    inner = chars == 0
    chars[inner] = lowered[source[inner]]
    sums = prefix_hashes(chars)
    buckets, owners = [], []
    left = length[word] - place
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        buckets.append((span_hashes(sums, at, at + n) >> U64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(word[at])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    count = np.bincount(owner, minlength=len(one))
    return row, number, bucket, owner, 1.0 / np.maximum(count, 1)[owner]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, ends = text_bytes(batch.column("text"))
        for row, after, raw, starts in blocks(data, ends, 1 << 16):
            word_row, number, bucket, owner, weight = subwords(raw, starts)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(int(number.max(initial=-1)) + 2))
            keys, values = [], []
            for i in range(after - row):
                own, times = np.unique(number[word_row == i], return_counts=True)
                total = np.zeros(0, np.int32)
                if len(own):
                    take = np.concatenate([order[cut[w] : cut[w + 1]] for w in own])
                    spread = np.repeat(times / times.sum(), [cut[w + 1] - cut[w] for w in own])
                    total, place = np.unique(bucket[take], return_inverse=True)
                    value = np.bincount(place, weight[take] * spread)
                keys.append(total.astype("<i4").tobytes())
                values.append((value if len(own) else np.zeros(0)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").slice(row, after - row), pa.array(keys, pa.binary()), pa.array(values, pa.binary())],
                names=["label", "buckets", "weights"],
            )


class Model:
    """A number for each bucket (its vector's effect on the difference of the two classes) and an offset."""

    def __init__(self, effect: np.ndarray, offset: float):
        self.effect, self.offset = effect, offset

    @classmethod
    def fit(cls, bags: list[tuple[int, np.ndarray, np.ndarray]], share: float) -> Model:
        """Vectors and softmax together on the sample; ``share`` is the share of label 1 among all labelled rows.  Every
        n-gram of the sample has a vector, however few documents hold it."""
        effect = np.zeros(1 << BUCKET_BITS, np.float32)
        label = np.array([b[0] for b in bags], float)
        prior = np.log((share + 1e-6) / (1 - share + 1e-6))
        if not len(label) or label.min() == label.max():
            return cls(effect, prior)
        used = np.unique(np.concatenate([b[1] for b in bags]))
        if not len(used):
            return cls(effect, prior)
        place = np.full(len(effect), -1)
        place[used] = np.arange(len(used))
        column, value, rows = [], [], []
        for i, (_, bucket, weight) in enumerate(bags):
            at = place[bucket]
            column.append(at[at >= 0])
            value.append(weight[at >= 0])
            rows.append(np.full(int((at >= 0).sum()), i))
        column, value, rows = np.concatenate(column), np.concatenate(value).astype(float), np.concatenate(rows)
        common = np.bincount(column, value, len(used)) / len(bags)
        rare = RARE / (RARE + common)
        rare *= len(bags) / (value * rare[column]).sum()  # averages of the order of 1
        value *= rare[column]
        draw = np.random.default_rng(7)
        kept = draw.random(len(label)) >= 0.15  # the rest says when to stop
        vectors = draw.normal(0, 0.05, (DIMS, len(used)))
        softmax = draw.normal(0, 0.5, (DIMS, 2))
        bias = np.zeros(2)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
        best, result, waited = np.inf, None, 0
        for step in range(1, STEPS + 1):
            hidden = np.stack([np.bincount(rows, value * v[column], len(label)) for v in vectors], axis=1)
            logit = hidden @ softmax + bias
            top = logit - logit.max(axis=1, keepdims=True)
            chance = np.exp(top)
            chance /= chance.sum(axis=1, keepdims=True)
            loss = -np.log(np.maximum(chance[np.arange(len(label)), label.astype(int)], 1e-12))
            watch = loss[~kept].mean() if (~kept).any() else loss.mean()
            if watch < best:
                best, waited = watch, 0
                result = ((softmax[:, 1] - softmax[:, 0]) @ vectors, bias[1] - bias[0])
            else:
                waited += 1
                if waited > 15:
                    break
            wrong = chance.copy()
            wrong[np.arange(len(label)), label.astype(int)] -= 1
            wrong[~kept] = 0
            wrong /= kept.sum()
            back = wrong @ softmax.T
            grads = (
                np.stack([np.bincount(column, value * back[rows, k], len(used)) for k in range(DIMS)]) + 1e-5 * vectors,
                hidden.T @ wrong + 1e-4 * softmax,
                wrong.sum(axis=0),
            )
            for p, g, (m, v) in zip((vectors, softmax, bias), grads, state, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        effect[used] = result[0] * rare
        mixed = label.mean()
        return cls(effect, float(result[1] + prior - np.log(mixed / (1 - mixed))))


def train(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``SAMPLE`` labelled rows of each class, those whose ids hash lowest, of the rows that are not held
    out.  The share of label 1 is that of all such rows.  Rows without label or with a label other than 0 and 1 are left
    out, as are labels of ids that do not occur; a document with several labels counts with each."""
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1)).filter(~held_out("__id"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        own = marks.filter(F.col("label") == label).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
        chosen = own if chosen is None else chosen.unionByName(own)
    # at most 2 * SAMPLE ids
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("i") == F.col("__id")).select("label", "text")
    bags = [
        (r["label"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["weights"], "<f4"))
        for r in rows.mapInArrow(_bags, "label int, buckets binary, weights binary").toLocalIterator()
    ]
    total = sum(counts.values())
    return Model.fit(bags, counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and score (0 to 1, the chance of label 1).

    Null and texts without words get the score of the offset alone, as does every text if the model has seen only one
    class.  Each row is scored by itself; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for row, after, raw, starts in blocks(data, ends):
                word_row, number, bucket, owner, weight = subwords(raw, starts)
                words = np.bincount(owner, weight * fitted.effect[bucket], int(number.max(initial=-1)) + 1)
                count = np.bincount(word_row, minlength=after - row)
                out[row:after] = np.bincount(word_row, words[number], after - row) / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(1.0 / (1.0 + np.exp(-np.clip(out + fitted.offset, -60, 60))))], names=["id", "score"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scores, f"id {kind}, score double").withColumnRenamed("id", id_col)

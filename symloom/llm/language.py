"""Language identification as a mixture: how much of a document comes from each language.

Each language is a distribution over hashed byte trigrams of its labelled documents.  The trigrams of a document
are taken as draws from an unknown mixture of these; expectation-maximisation finds the shares.  Languages enter
the document's set in order of their share as long as the likelihood, maximised over the set, rises by more than the
penalty of one more share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.blocks import blocks, released, text_bytes

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
UNKNOWN = "und"
ROUNDS = 30
#: pseudo-count of each bucket
SMOOTH = 0.2
#: neighbouring trigrams share two letters, so a draw counts as this much of an independent one
DEPENDENCE = 3.0

_KINDS = np.full(256, 0x20, np.uint8)
_KINDS[0x61:0x7B] = np.arange(0x61, 0x7B)
_KINDS[0x80:] = np.arange(0x80, 0x100)


def padded(text: Column) -> Column:
    """Lower-cased, a space at either end; null is empty."""
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letters and single gaps, and its row."""
    plain = _KINDS[data]
    gap = plain == 0x20
    keep = np.ones(len(plain), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[starts[:-1][starts[:-1] < len(plain)]] = True
    at = np.flatnonzero(keep)
    if len(at) < 3:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    row = np.searchsorted(starts[1:], at, "right")
    kept = plain[at].astype(np.uint32)
    code = (kept[:-2] << np.uint32(16)) | (kept[1:-1] << np.uint32(8)) | kept[2:]
    inside = row[:-2] == row[2:]
    code = code[inside] * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return (code >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16), row[:-2][inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        data, ends = text_bytes(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, after, raw, starts in blocks(data, ends):
            code, own = trigrams(raw, starts)
            for lang in set(langs[row:after]):
                here = np.isin(own, np.flatnonzero(langs[row:after] == lang))
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(code[here], minlength=BUCKETS)
    for lang, total in sums.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(total[used], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def trigram_counts(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) over the whole texts of all rows with a language."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), padded(F.col(text_col)).alias("text"))
    found = rows.filter(F.col("lang").isNotNull() & (F.col("lang") != "")).mapInArrow(released(_count), "lang string, bucket int, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by bucket and language: at most 65,536 numbers for each language, whatever the corpus."""

    def __init__(self, langs: list[str], logs: np.ndarray):
        self.langs, self.logs = langs, logs

    @classmethod
    def fit(cls, counts: DataFrame) -> Model:
        frame = counts.toPandas()
        langs = sorted(frame["lang"].unique())
        table = np.full((BUCKETS, len(langs)), SMOOTH)
        place = {lang: i for i, lang in enumerate(langs)}
        table[frame["bucket"].to_numpy(int), frame["lang"].map(place).to_numpy(int)] += frame["n"].to_numpy(float)
        return cls(langs, np.log(table / table.sum(axis=0)) if langs else table)

    def shares(self, code: np.ndarray, penalty: float = 1.0) -> list[tuple[int, float]]:
        """The language set of one document with shares, largest first."""
        ordered = np.sort(code)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        weight = np.diff(np.append(first, len(ordered))) / DEPENDENCE
        logs = self.logs[ordered[first]]
        top = logs.max(axis=1, keepdims=True)
        seen = np.exp(logs - top)
        total = weight.sum()
        single = weight @ (logs - top)
        share = _maximise(seen, weight, total, np.full(len(self.langs), 1.0 / len(self.langs)))
        order = [int(i) for i in np.argsort(-share, kind="stable") if share[i] > 1e-4]
        best, chosen = single[order[0]], [(order[0], 1.0)]
        # the best single language is always among the candidates
        alone = int(np.argmax(single))
        if single[alone] > best:
            best, chosen = single[alone], [(alone, 1.0)]
            order.remove(alone) if alone in order else None
            order.insert(0, alone)
        for size in range(2, len(order) + 1):
            own = order[:size]
            start = share[own] + 1e-9
            part = _maximise(seen[:, own], weight, total, start / start.sum())
            value = weight @ np.log(seen[:, own] @ part) - penalty * (size - 1) * 0.5 * np.log(total + 1.0)
            if value <= best:
                break
            best = value
            chosen = sorted(((o, float(p)) for o, p in zip(own, part, strict=True)), key=lambda x: (-x[1], x[0]))
        return chosen


def _maximise(seen: np.ndarray, weight: np.ndarray, total: float, share: np.ndarray) -> np.ndarray:
    for _ in range(ROUNDS):
        new = share * ((weight / (seen @ share)) @ seen) / total
        if np.abs(new - share).max() < 1e-3:
            return new
        share = new
    return share


def _identify(model, penalty: float):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted: Model = model.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            letter = batch.column("letter").to_pylist()
            best, score, sets = [], [], []
            for row, after, raw, starts in blocks(data, ends):
                code, own = trigrams(raw, starts)
                cut = np.searchsorted(own, np.arange(after - row + 1))
                for i in range(after - row):
                    if not letter[row + i] or not fitted.langs or cut[i] == cut[i + 1]:
                        best.append(UNKNOWN)
                        score.append(0.0)
                        sets.append([])
                        continue
                    found = fitted.shares(code[cut[i] : cut[i + 1]], penalty)
                    best.append(fitted.langs[found[0][0]])
                    score.append(min(1.0, found[0][1]))
                    sets.append([{"lang": fitted.langs[k], "share": p} for k, p in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)],
                names=["row", "best", "score", "set"],
            )

    return identify


def _identified(docs: DataFrame, model: Model, text_col: str, penalty: float) -> DataFrame:
    """(row, best, score, set); all columns of ``docs`` travel inside ``row``, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col(f"`{text_col}`")
    row = F.struct("*")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(row.alias("row"), padded(text).alias("text"), letter.alias("letter"))
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    kinds = {"row": rows.schema["row"].dataType, "best": T.StringType(), "score": T.DoubleType(), "set": T.ArrayType(share)}
    return rows.mapInArrow(released(_identify(shared, penalty)), T.StructType([T.StructField(n, k) for n, k in kinds.items()]))


def identify(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = 1.0) -> DataFrame:
    """All rows and columns, with __best (the language of the largest share, ``und`` for null and for texts without a
    letter), __score (its share, 0 to 1) and __set (the chosen languages with their shares); columns of these names are replaced.

    Ties between languages go to the one first in alphabetical order.  A model without languages answers ``und``.
    Rows are handled one by one: repeated rows get the same answer, an empty table gives an empty result.
    """
    new = {"__best": "best", "__score": "score", "__set": "set"}
    found = _identified(docs, model, text_col, penalty)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[F.col(c).alias(n) for n, c in new.items()])


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
    return F.coalesce(rest == part, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all rows with a language whose id's crc32 modulo 5 is not 0."""
    return Model.fit(trigram_counts(docs.filter(~held_out(id_col, 5, 0)), text_col, lang_col))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents in which a language is found, all columns as they were, whatever their names.

    Null texts, empty ones and texts without a letter go; rows that repeat are answered alike, an empty table stays empty.
    """
    found = _identified(docs, train(docs, id_col, text_col, lang_col), text_col, 1.0)
    return found.filter(F.col("best") != UNKNOWN).select("row.*")

"""Language-model scores from a lattice of subwords: all segmentations of a text count.

The vocabulary is that of a published tokenizer and is not trained.  Its pieces get unigram scores from the training
documents: how often the tokenizer cuts each out of their distinct words, apart for pieces that open a word and for
those that go on.  A word's probability is the sum over all ways to spell it with pieces, worked out by a forward
recursion in log space, plus an arc that spans the whole word with its own frequency in the training documents; every
byte is a piece, so no word is impossible.  Words are cut points of every segmentation, so a text's marginal
probability is the product of those of its words and of its end.

The training documents' languages are marginalised too: each has its own word frequencies, smoothed by those of
all, and a text's probability is the sum over languages of the language's share times the text's probability in it.
The language of a text that is scored is never looked at.

Words are counted over all training documents.  The most frequent ones, at most ``HEAD``, go to all tasks; the rest
are looked up by a join on the word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.blocks import U64, VISIBLE, blocks, lower_ascii, mix, prefix_hashes, span_hashes, text_bytes, word_spans
from symloom.session import stage

#: bytes of word scores that are sent to all tasks
HEAD_BYTES = 32 << 20
#: languages with frequencies of their own; all others share one
LANGUAGES = 15
#: blocks whose words a task counts together
TOGETHER = 24
#: pseudo-count of each piece
SMOOTH = 0.1
_MARK = "▁"


def _distinct(raw: np.ndarray, starts: np.ndarray):
    lowered = lower_ascii(raw)
    first, after, row = word_spans(lowered, starts, VISIBLE)
    hashed = span_hashes(prefix_hashes(lowered), first, after)
    keys, one, number, count = np.unique(hashed, return_index=True, return_inverse=True, return_counts=True)
    return lowered, first, after, row, keys, one, number, count


def spans_array(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> pa.Array:
    """The spans of the bytes as strings; bytes that are not UTF-8 cannot occur in a Spark string."""
    size = after - first
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
    flat = data[at] if len(at) else np.zeros(0, np.uint8)
    wide = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
    return wide.cast(pa.binary())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def joined() -> pa.RecordBatch:
        _, one, number = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        count = np.bincount(number, np.concatenate([h[2] for h in held]), len(one)).astype(np.int64)
        group = np.concatenate([h[1] for h in held])[one]
        words = pa.concat_arrays([h[3] for h in held]).take(pa.array(one))
        held.clear()
        return pa.RecordBatch.from_arrays([words, pa.array(group), pa.array(count)], names=["word", "group", "c"])

    for batch in batches:
        data, ends = text_bytes(batch.column("text"))
        groups = batch.column("group").to_numpy().astype(np.int64)
        for at, to, raw, starts in blocks(data, ends):
            lowered = lower_ascii(raw)
            first, after, row = word_spans(lowered, starts, VISIBLE)
            group = groups[at:to][row]
            keys = mix(span_hashes(prefix_hashes(lowered), first, after) + group.astype(U64) * U64(0xD6E8FEB86659FD93))
            keys, one, count = np.unique(keys, return_index=True, return_counts=True)
            held.append((keys, group[one], count, spans_array(lowered, first[one], after[one])))
            if len(held) == TOGETHER:
                yield joined()
    if held:
        yield joined()


def word_counts(docs: DataFrame, groups: int) -> DataFrame:
    """(word, c, c0, c1 ...): the words of all texts, as bytes, with how often they occur, in all and by group."""
    found = docs.select("text", "group").mapInArrow(_count, "word binary, group long, c long")
    by_group = [F.sum(F.when(F.col("group") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(groups)]
    return found.groupBy("word").agg(F.sum("c").alias("c"), *by_group)


def _piece_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(model.get_piece_size(), np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for at in range(0, len(words), 20000):
                for ids in model.encode(words[at : at + 20000], num_threads=1):
                    np.add.at(total, ids, 1) if len(ids) > 30 else _add(total, ids)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["piece", "n"])

    return count


def _add(total: np.ndarray, ids: list[int]) -> None:
    for i in ids:
        total[i] += 1


class Pieces:
    """Log-probabilities of the pieces that open a word, of those that go on, and of a word's end."""

    def __init__(self, path: str, counts: dict[int, int]):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        opening: dict[bytes, float] = {}
        going: dict[bytes, float] = {bytes([b]): SMOOTH for b in range(256)}
        alone = SMOOTH
        for number in range(model.get_piece_size()):
            if model.is_control(number) or model.is_unknown(number):
                continue
            n = counts.get(number, 0) + SMOOTH
            if model.is_byte(number):
                going[bytes([int(model.id_to_piece(number)[1:-1], 16)])] += n
                continue
            text = model.id_to_piece(number)
            if text == _MARK:
                alone = n
            elif text.startswith(_MARK) and _MARK not in text[1:]:
                opening[text[1:].encode()] = n
            elif _MARK not in text:
                going[text.encode()] = going.get(text.encode(), 0.0) + n
        words = sum(opening.values()) + alone
        further = sum(going.values())
        self.end = math.log(words / (words + further))
        on = math.log(further / (words + further))
        texts = sorted(set(opening) | set(going))
        self.longest = max(map(len, texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        after = np.cumsum([len(t) for t in texts])
        keys = span_hashes(prefix_hashes(data), after - [len(t) for t in texts], after)
        go = np.array([math.log(going[t] / further) if t in going else -np.inf for t in texts])
        first = np.array([math.log(opening[t] / words) if t in opening else -np.inf for t in texts])
        # a word may also open with the bare mark
        first = np.logaddexp(first, math.log(alone / words) + go)
        order = np.argsort(keys)
        self.keys, self.first, self.go = keys[order], first[order], (go + on)[order]

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        out = np.zeros(len(words))
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):
            # words of like length together: at most 2^17 bytes after padding, or one word
            to = at + 1
            while to < len(order) and (to - at + 1) * length[order[to]] <= 1 << 17:
                to += 1
            own = order[at:to]
            out[own] = self._forward([words[i] for i in own], length[own])
            at = to
        return out

    def _forward(self, words: list[bytes], length: np.ndarray) -> np.ndarray:
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        sums = prefix_hashes(data)
        most = int(length.max())
        alpha = np.full((len(words), most + 1), -np.inf)
        alpha[:, 0] = 0.0
        for end in range(1, most + 1):
            live = np.searchsorted(length, end, "left")  # words are sorted by length
            if live == len(words):
                break
            best = np.full(len(words) - live, -np.inf)
            for size in range(1, min(end, self.longest) + 1):
                start = begin[live:] + end - size
                key = span_hashes(sums, start, start + size)
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                table = self.first if size == end else self.go
                weight = np.where(self.keys[place] == key, table[place], -np.inf)
                best = np.logaddexp(best, alpha[live:, end - size] + weight)
            alpha[live:, end] = best
        return alpha[np.arange(len(words)), length] + self.end


class Scores:
    """What all tasks need: totals, piece scores and the log10 scores of the frequent words, found by their hash.

    ``groups`` has, for each language, its documents, word tokens and distinct words.
    """

    def __init__(self, pieces: Pieces, tokens: int, words: int, docs: int, groups: np.ndarray):
        self.pieces, self.tokens, self.words, self.docs, self.groups = pieces, tokens, words, docs, groups
        self.distinct = words + (1 if docs else 0)
        self.whole = tokens + words + 2
        own = groups.sum(axis=1).astype(float)
        self.own = np.maximum(own, 1.0)
        #: what a language leaves to the frequencies of all
        self.rest = np.where(own > 0, (groups[:, 2] + 1) / (own + 1), 1.0)
        self.keys = np.zeros(0, U64)
        self.counts = np.zeros(0, np.int64)
        self.logs = np.zeros((0, len(groups)))

    def base(self, count):
        return np.log10((count + 1.0) / (self.tokens + self.distinct + 1.0))

    def mixed(self, log_all: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 for each language from the natural log over all and the counts by language."""
        with np.errstate(divide="ignore"):
            own = np.log((1 - self.rest) * counts / np.maximum(self.groups[:, 0] + self.groups[:, 1], 1))
        return np.logaddexp(own, np.log(self.rest) + log_all[:, None]) / math.log(10)

    @property
    def end_logs(self) -> np.ndarray:
        return self.mixed(np.array([math.log((self.docs + 1) / self.whole)]), self.groups[None, :, 0])[0]

    @property
    def shares(self) -> np.ndarray:
        return np.log10((self.groups[:, 0] + 1) / (self.groups[:, 0].sum() + len(self.groups)))

    def model(self, words: list[bytes], count: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's probability in each language: its own arc and all spellings."""
        spelled = self.pieces.log_probability(words) + math.log((self.words + 1) / self.whole)
        with np.errstate(divide="ignore"):
            return self.mixed(np.logaddexp(np.log(count / self.whole), spelled), counts)


def _model_columns(logs: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(logs[:, k])) for k in range(logs.shape[1])]


def _word_scores(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: Scores = shared.value
        several = len(scores.groups)
        for batch in batches:
            words = batch.column("word").to_pylist()
            data = np.frombuffer(b"".join(words), np.uint8)
            size = np.array([len(w) for w in words], np.int64)
            after = np.cumsum(size)
            keys = span_hashes(prefix_hashes(data), after - size, after)
            counts = np.stack([batch.column(f"c{k}").to_numpy() for k in range(several)], axis=1)
            logs = scores.model(words, batch.column("c").to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("c"), pa.array(keys.view(np.int64)), *_model_columns(logs)],
                names=["word", "c", "key", *[f"m{k}" for k in range(several)]],
            )

    return rows


def _unseen(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: Scores = shared.value
        several = len(scores.groups)
        for batch in batches:
            words = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy()
            logs = scores.model(words, np.zeros(len(words)), np.zeros((len(words), several))) * n[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(np.zeros(len(words), np.int64)), pa.array(n * scores.base(0)), *_model_columns(logs)],
                names=["rid", "known", "base", *[f"m{k}" for k in range(several)]],
            )

    return rows


def _sum(shared):
    tail_kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: Scores = shared.value
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            for row, after_row, raw, starts in blocks(data, ends):
                rows = after_row - row
                lowered, first, after, own, keys, one, number, _ = _distinct(raw, starts)
                place = np.minimum(np.searchsorted(scores.keys, keys), max(len(scores.keys) - 1, 0))
                found = scores.keys[place] == keys if len(scores.keys) else np.zeros(len(keys), bool)
                several = len(scores.groups)
                base = np.zeros(len(keys))
                model = np.zeros((len(keys), several))
                base[found] = scores.base(scores.counts[place[found]])
                model[found] = scores.logs[place[found]]
                sums = np.stack([np.bincount(own, model[:, k][number], rows) for k in range(several)], axis=1) + scores.end_logs
                seen = found[number]
                # words that are looked up by the join: once for each document
                pair, times = np.unique(own[~seen] * max(len(keys), 1) + number[~seen], return_counts=True)
                rare_row, rare = pair // max(len(keys), 1), pair % max(len(keys), 1)
                words = spans_array(lowered, first[one[rare]], after[one[rare]])
                cut = np.searchsorted(rare_row, np.arange(rows + 1)).astype(np.int32)
                tail = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([words, pa.array(times.astype(np.int64))], ["word", "n"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(row, rows),
                        pa.array(np.bincount(own, minlength=rows).astype(np.int64) + 1),
                        pa.array(np.bincount(own[seen], minlength=rows).astype(np.int64) + (1 if scores.docs else 0)),
                        pa.array(np.bincount(own, base[number], rows) + scores.base(scores.docs)),
                        tail.cast(tail_kind),
                        *_model_columns(sums),
                    ],
                    names=["id", "n_tokens", "known", "base", "tail", *[f"m{k}" for k in range(several)]],
                )

    return rows


def lattice_scores(
    docs: DataFrame, training: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None
) -> DataFrame:
    """One row per document of ``docs``: the id, n_tokens, n_known, train_tokens, base_score and score.

    A-Z are lower-cased; tokens are runs of characters other than space and \\t to \\r, then one end.  ``base_score`` is the
    add-one unigram's, ``score`` the lattice's log10 probability of the whole text.  Null is empty: its only token is the
    end.  Without training documents nothing is known and the pieces are equally likely.  ``lang_col`` names the column
    of ``training`` by which frequencies are kept apart; null is a language of its own.  Repeated rows are scored each by
    itself; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    texts = training.select(F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    # at most LANGUAGES names leave the cluster
    names = [r["lang"] for r in texts.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(LANGUAGES).collect()]
    number = F.lit(len(names))
    for k, name in enumerate(names):
        number = F.when(F.col("lang") == name, k).otherwise(number)
    texts = texts.withColumn("group", number.cast("long"))
    several = len(names) + 1
    models = [f"m{k}" for k in range(several)]
    doubles = ", ".join(f"{m} double" for m in models)

    counted = stage(word_counts(texts, several), "lm-words")
    in_group = {r["group"]: r["count"] for r in texts.groupBy("group").count().collect()}
    n_docs = sum(in_group.values())
    totals = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"),
        F.count("*").alias("words"),
        *[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"t{k}") for k in range(several)],
        *[F.count(F.when(F.col(f"c{k}") > 0, 1)).alias(f"d{k}") for k in range(several)],
    ).first()
    groups = np.array([[in_group.get(k, 0), totals[f"t{k}"], totals[f"d{k}"]] for k in range(several)], np.int64)
    pieces = counted.select("word").mapInArrow(_piece_counter(pieces_path), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    fitted = Pieces(pieces_path, {r["piece"]: r["n"] for r in pieces.collect()})
    plain = (fitted, totals["tokens"] + n_docs, totals["words"], n_docs, groups)
    scores = Scores(*plain)
    shared = spark.sparkContext.broadcast(scores)
    scored = stage(counted.mapInArrow(_word_scores(shared), f"word binary, c long, key long, {doubles}"), "lm-scores")

    # the least count of as many words as fit, from how many words have each count
    left, least = HEAD_BYTES // (16 + 8 * several), None
    for r in scored.groupBy("c").count().orderBy(F.col("c").desc()).toLocalIterator():
        left -= r["count"]
        if left < 0:
            break
        least = r["c"]
    full = Scores(*plain)
    if least is not None:
        head = scored.filter(F.col("c") >= least).select("key", "c", *models).toArrow()
        keys = head.column("key").to_numpy().view(U64)
        order = np.argsort(keys)
        full.keys, full.counts = keys[order], head.column("c").to_numpy()[order]
        full.logs = np.stack([head.column(m).to_numpy()[order] for m in models], axis=1)
        del head
    tail_words = scored if least is None else scored.filter(F.col("c") < least)
    whole = spark.sparkContext.broadcast(full)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sums = rows.mapInArrow(
        _sum(whole), f"id {kind}, n_tokens long, known long, base double, tail array<struct<word: binary, n: long>>, {doubles}"
    )
    sums = stage(sums.withColumn("rid", F.monotonically_increasing_id()), "lm-sums")
    tail = sums.select("rid", F.explode("tail").alias("t")).select("rid", F.col("t.word").alias("word"), F.col("t.n").alias("n"))
    tail = stage(tail.join(tail_words.select("word", "c", *models), "word", "left"), "lm-tail")
    base = F.log10((F.col("c") + 1.0) / (scores.tokens + scores.distinct + 1.0))
    known = tail.filter("c is not null").select(
        "rid", F.col("n").alias("known"), (F.col("n") * base).alias("base"), *[(F.col("n") * F.col(m)).alias(m) for m in models]
    )
    new = tail.filter("c is null").select("rid", "word", "n").mapInArrow(_unseen(shared), f"rid long, known long, base double, {doubles}")
    more = known.unionByName(new).groupBy("rid").agg(*[F.sum(c).alias(f"{c}_more") for c in ("known", "base", *models)])
    both = sums.drop("tail").join(more, "rid", "left")
    add = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_more"), F.lit(0))
    # sum over languages of share times probability, from the largest term
    terms = F.array(*[add(m) + F.lit(float(share)) for m, share in zip(models, scores.shares, strict=True)])
    top = F.array_max("__terms")
    total = F.aggregate("__terms", F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - top))
    return both.withColumn("__terms", terms).select(
        F.col("id").alias(id_col),
        "n_tokens",
        add("known").alias("n_known"),
        F.lit(scores.tokens).cast("long").alias("train_tokens"),
        add("base").alias("base_score"),
        (top + F.log10(total)).alias("score"),
    )

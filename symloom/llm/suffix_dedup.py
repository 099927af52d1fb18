"""Repeated byte strings across and within documents, by a distributed difference-cover suffix sort.

A string of ``LENGTH`` bytes that starts at two places is removed at both.  The steps:

1. Texts that occur several times as a whole are settled by digest, and one of each is kept for comparison.
2. Winnowing names places that any repeated string must share: of every LENGTH - GRAM + 1 neighbouring GRAM-byte
   strings the one of the least hash.  Text away from repeated places cannot hold a repeat and is left out.
3. Of the rest the suffixes at a difference cover modulo ``MODULUS`` are sampled: for any two places there is a shift
   below the modulus that takes both into the sample.  Samples are named by a prefix that every repeat agrees on
   (names are 64-bit fingerprints, put together from those of shorter tuples; the recursion ends at LENGTH, as deeper
   order is never asked for) and sorted by name over the cluster; neighbours in that order are compared.
4. Samples whose names repeat are sorted again by the whole stretch around them.  If that repeats, so does every
   suffix that the sample stands for.
5. The remaining suffixes, those near the ends of repeats, are merged in by a last sort on their LENGTH-byte prefixes,
   and neighbours are compared again.

Sorts are by (name, document, place) over ranges, so equal names may spread over many tasks; only the two outer
rows of each range meet on the driver.  Bytes outside ranges never move, and each text is looked at whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.blocks import BLOCK, U64, blocks, mix, powers, prefix_hashes, span_hashes, text_bytes
from symloom.session import stage

LENGTH = 400
GRAM = 64
MODULUS = 73
#: a text with more than one row in so many is told by a broadcast; there are fewer such texts than this
COMMON = 1000


#: fixed values: a perfect difference set modulo 73, every residue but 0 is a difference exactly once
PERFECT_73 = (0, 1, 3, 7, 15, 31, 36, 54, 63)


def difference_cover(modulus: int) -> list[int]:
    """Residues among whose differences every residue occurs."""
    if modulus == 73:
        return list(PERFECT_73)
    cover, found = [0], {0}
    while len(found) < modulus:
        def fresh(c: int) -> set[int]:
            return {(c - x) % modulus for x in cover} | {(x - c) % modulus for x in cover}

        best = max((c for c in range(modulus) if c not in cover), key=lambda c: (len(fresh(c) - found), -c))
        found |= fresh(best)
        cover.append(best)
    return sorted(cover)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbouring values."""
    out, span = values, 1
    while 2 * span <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (size - span)], out[size - span :]) if size > span else out


def anchors(raw: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every gram that is the least of some window within one row.

    The value ordered by is a rolling product hash; ties go to all places of the value, so the choice in a window
    depends on its bytes alone.
    """
    if len(raw) < length:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    up, _ = powers(gram + 1)
    # hashes of doubled lengths: h(2k) at i is h(k) at i * base^k + h(k) at i + k
    hashed, span = mix_bytes(raw), 1
    while span < gram:
        hashed = hashed[:-span] * up[span] + hashed[span:]
        span *= 2
    hashed = mix(hashed)
    window = length - gram + 1
    least = _least(hashed, window)
    row_end = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    inside = np.arange(len(least)) + length <= row_end
    # a gram is an anchor if a window over it has it as least
    value = np.where(inside, least, U64(0))
    # the largest least value among the windows over a gram equals its hash if and only if it is least in one
    padded = np.concatenate((np.zeros(window - 1, U64), value, np.zeros(window - 1, U64)))
    most = ~_least(~padded, window)
    at = np.flatnonzero(most[: len(hashed)] == hashed)
    return hashed[at], at


_BYTES = mix(np.arange(1, 257, dtype=U64))


def mix_bytes(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


def _anchor_rows(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            marks = batch.column("mark").to_numpy()
            for row, after, raw, starts in blocks(data, ends, BLOCK >> 2):
                value, at = anchors(raw, starts, length, gram)
                own = np.searchsorted(starts[1:], at, "right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(np.zeros(len(at), np.int64)), pa.array(marks[row:after][own]), pa.array(at - starts[own])],
                    names=["name", "around", "mark", "at"],
                )

    return rows


OPEN, SETTLED, LIKE = 0, 1, 2
_ROW = "kind int, mark long, at long, name long, around long, first boolean, last boolean, twice boolean, settled boolean"


def _rows(kind, mark, at, name=None, around=None, first=None, last=None, twice=None, settled=None) -> pa.RecordBatch:
    n = len(mark)
    number = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64())
    flag = lambda x: pa.nulls(n, pa.bool_()) if x is None else pa.array(x, pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), number(mark), number(at), number(name), number(around), *map(flag, (first, last, twice, settled))],
        names=["kind", "mark", "at", "name", "around", "first", "last", "twice", "settled"],
    )


def _compare(batches: Iterator[pa.RecordBatch], runs: bool) -> Iterator[pa.RecordBatch]:
    """Neighbours of rows sorted by (name, around, mark, at); equal rows count once.

    A row whose name a neighbour shares is SETTLED if it shares ``around`` too (0 is none), else OPEN.  The first row of
    each run of one ``around`` in a name with several is also told as LIKE if ``runs``: it stands for its run.  A row without
    ``around`` is a run of its own.  The outer rows of the range come with kind null and what is known of them.
    """
    held = None  # last row: name, around, mark, at, whether it shares its name and around with the row before, first of the range
    pending = None  # first row of the current name, while only one run of it was seen
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("name", "around", "mark", "at")]
        if held is not None:
            columns = [np.concatenate(([h], c)) for h, c in zip(held[:4], columns, strict=True)]
        if len(columns[0]) > 1:
            fresh = np.ones(len(columns[0]), bool)
            fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            columns = [c[fresh] for c in columns]
        name, around, mark, at = columns
        if len(name) < 2 and held is not None or not len(name):
            continue
        same = np.zeros(len(name) + 1, bool)
        same[1:-1] = name[1:] == name[:-1]
        alike = same.copy()
        alike[1:-1] &= (around[1:] == around[:-1]) & (around[1:] != 0)
        outer = np.zeros(len(name), bool)
        if held is None:
            outer[0] = True
        else:
            same[0], alike[0], outer[0] = held[4], held[5], held[6]
        twice, settled = same[:-1] | same[1:], alike[:-1] | alike[1:]
        told = np.arange(len(name) - 1)
        plain = told[~outer[told] & twice[told]]
        yield _rows(np.where(settled[plain], SETTLED, OPEN), mark[plain], at[plain])
        for i in told[outer[told]].tolist():
            yield _rows([None], [mark[i]], [at[i]], [name[i]], [around[i]], [True], [False], [twice[i]], [settled[i]])
        # runs of one stretch; row 0 was looked at with the batch before
        begin = 0 if held is None else 1
        run = np.flatnonzero(~alike[begin : len(name)]) + begin
        if runs and len(run):
            joins = same[run]
            if pending is not None and joins[0]:
                yield _rows([LIKE], [pending[0]], [pending[1]])
            opens = np.flatnonzero(~joins)
            followed = np.zeros(len(run), bool)
            followed[:-1] = joins[1:]
            take = run[joins | followed]
            yield _rows(np.full(len(take), LIKE), mark[take], at[take])
            if len(opens) and opens[-1] == len(run) - 1:
                pending = (int(mark[run[-1]]), int(at[run[-1]]))
            else:
                pending = None
        held = (name[-1], around[-1], mark[-1], at[-1], bool(same[-2]), bool(alike[-2]), bool(outer[-1]))
    if held is not None:
        yield _rows([None], [held[2]], [held[3]], [held[0]], [held[1]], [held[6]], [True], [held[4]], [held[5]])


def compared(rows: DataFrame, label: str, runs: bool = True) -> DataFrame:
    """(kind, mark, at) of the rows (name, around, mark, at) that share their name, by a sort over the cluster; LIKE rows
    only with ``runs``."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["name", "around", "mark", "at"]
    ordered = rows.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stage(ordered.mapInArrow(lambda batches: _compare(batches, runs), _ROW).withColumn("range", F.spark_partition_id()), label)
    # at most two rows of each range
    ends = found.filter("kind is null").collect()
    ends.sort(key=lambda r: (r["range"], bool(r["last"]) and not r["first"]))
    flags = [[bool(r["twice"]), bool(r["settled"]), False] for r in ends]
    for k in range(1, len(ends)):
        a, b = ends[k - 1], ends[k]
        if a["range"] != b["range"] and a["name"] == b["name"]:
            for i in (k - 1, k):
                flags[i][0] = flags[i][2] = True
                flags[i][1] |= a["around"] == b["around"] != 0
    more = [(SETTLED if s else OPEN, r["mark"], r["at"]) for r, (t, s, _) in zip(ends, flags, strict=True) if t]
    more += [(LIKE, r["mark"], r["at"]) for r, (_, _, l) in zip(ends, flags, strict=True) if l and runs]
    kept = found.filter("kind is not null").select("kind", "mark", "at")
    return kept.unionByName(spark.createDataFrame(more, "kind int, mark long, at long")) if more else kept


def _covered(raw: np.ndarray, starts: np.ndarray, lists: list, before: int, after: int) -> np.ndarray:
    """Which bytes lie within [place - before, place + after) of a listed place of their row."""
    change = np.zeros(len(raw) + 1, np.int32)
    for begin, end, places in zip(starts[:-1].tolist(), starts[1:].tolist(), lists, strict=True):
        if len(places):
            at = begin + np.asarray(places, np.int64)
            np.add.at(change, np.maximum(at - before, begin), 1)
            np.add.at(change, np.minimum(at + after, end), -1)
    return np.cumsum(change[:-1]) > 0


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    empty = np.zeros(0, np.int64)
    return [values[a:b] if ok else empty for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]


def _samples(length: int, gram: int, modulus: int):
    cover = np.zeros(modulus, bool)
    cover[difference_cover(modulus)] = True
    depth = length - modulus + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            marks, lists = batch.column("mark").to_numpy(), _lists(batch, "anchors")
            for row, after, raw, starts in blocks(data, ends):
                near = _covered(raw, starts, lists[row:after], length - gram, length)
                at = np.flatnonzero(near)
                own = np.searchsorted(starts[1:], at, "right")
                place = at - starts[own]
                pick = cover[place % modulus] & (at + depth <= starts[own + 1])
                at, own, place = at[pick], own[pick], place[pick]
                sums = prefix_hashes(raw)
                whole = (place >= modulus - 1) & (at + length <= starts[own + 1])
                around = np.zeros(len(at), U64)
                around[whole] = span_hashes(sums, at[whole] - (modulus - 1), at[whole] + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hashes(sums, at, at + depth).view(np.int64)),
                        pa.array(around.view(np.int64)),
                        pa.array(marks[row:after][own]),
                        pa.array(place),
                    ],
                    names=["name", "around", "mark", "at"],
                )

    return rows


def _open_windows(length: int, modulus: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            marks = batch.column("mark").to_numpy()
            unsure, settled, like = (_lists(batch, c) for c in ("open", "settled", "like"))
            for row, after, raw, starts in blocks(data, ends):
                # suffixes that a sample stands for and that no settled sample has told; and those to compare with
                asked = _covered(raw, starts, unsure[row:after], modulus - 1, 1)
                asked &= ~_covered(raw, starts, settled[row:after], modulus - 1, 1)
                asked |= _covered(raw, starts, like[row:after], modulus - 1, 1)
                at = np.flatnonzero(asked)
                own = np.searchsorted(starts[1:], at, "right")
                fits = at + length <= starts[own + 1]
                at, own = at[fits], own[fits]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hashes(prefix_hashes(raw), at, at + length).view(np.int64)),
                        pa.array(np.zeros(len(at), np.int64)),
                        pa.array(marks[row:after][own]),
                        pa.array(at - starts[own]),
                    ],
                    names=["name", "around", "mark", "at"],
                )

    return rows


def _spans(length: int, modulus: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            settled, single = _lists(batch, "settled"), _lists(batch, "windows")
            spans, digests, removed = [], [], []
            for row, after, raw, starts in blocks(data, ends):
                gone = _covered(raw, starts, settled[row:after], modulus - 1, length)
                gone |= _covered(raw, starts, single[row:after], 0, length)
                for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = np.concatenate(([0], gone[begin:end].astype(np.int8), [0]))
                    turn = np.flatnonzero(np.diff(own))
                    spans.append([{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                    removed.append(int(gone[begin:end].sum()))
                    digests.append(hashlib.sha256(raw[begin:end][~gone[begin:end]].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("mark"), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(digests, pa.string())],
                names=["mark", "removed", "spans", "kept"],
            )

    return rows


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, modulus: int = MODULUS
) -> DataFrame:
    """One row per input row: the id, n_bytes, n_removed, spans (maximal removed runs, start and end in bytes) and
    kept_sha256 of the bytes that stay.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same document or in
    another; overlaps count, strings never cross documents, and the input decides, not what is left.  Null is
    empty; texts shorter than ``length`` stay whole.  A text that several rows have (same id or not) goes whole if it
    has ``length`` bytes.  An empty table gives an empty result.  Other columns are not read.
    """
    if gram & (gram - 1) or not 2 * modulus < length or gram > length - modulus:
        raise ValueError("gram is a power of two and, like the modulus, well below the length")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("mark"))
    digests = rows.select("id", "mark", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2("text", 256)).alias("sha"))
    digests = stage(digests, "repeat-digests")
    long = rows.filter(F.octet_length("text") >= length)

    found = compared(long.select("mark", "text").mapInArrow(_anchor_rows(length, gram), "name long, around long, mark long, at long"), "repeat-anchors", False)
    places = found.groupBy("mark").agg(F.collect_list("at").alias("anchors"))
    # one row for each text that shares an anchor; no other can hold a repeat.  Copies go before the texts are shuffled
    texts = long.select("mark", "text").dropDuplicates(["mark"]).join(places.hint("shuffle_hash"), "mark")
    texts = stage(texts, "repeat-texts")

    samples = compared(texts.mapInArrow(_samples(length, gram, modulus), "name long, around long, mark long, at long"), "repeat-samples")
    listed = [F.collect_list(F.when(F.col("kind") == k, F.col("at"))).alias(c) for k, c in ((OPEN, "open"), (SETTLED, "settled"), (LIKE, "like"))]
    texts = stage(texts.drop("anchors").join(samples.groupBy("mark").agg(*listed), "mark"), "repeat-likely")

    windows = compared(texts.mapInArrow(_open_windows(length, modulus), "name long, around long, mark long, at long"), "repeat-windows", False)
    texts = texts.join(windows.groupBy("mark").agg(F.collect_list("at").alias("windows")), "mark", "left")
    spans = texts.select("mark", "text", "settled", "windows").mapInArrow(
        _spans(length, modulus), "mark long, removed long, spans array<struct<start: long, end: long>>, kept string"
    )
    spans = stage(spans.filter("removed > 0"), "repeat-spans")

    several = stage(digests.groupBy("mark").agg(F.count("*").alias("rows")).filter("rows > 1").withColumn("copied", F.lit(True)), "repeat-copies")
    # rows of a common text go whole or stay whole and need no spans, so they are not dealt by their text
    common = F.broadcast(several.filter(F.col("rows") * COMMON > digests.count()).select("mark"))
    rare = digests.join(common, "mark", "left_anti").join(spans, "mark", "left").join(several.drop("rows"), "mark", "left")
    both = rare.unionByName(digests.join(common, "mark", "left_semi").withColumn("copied", F.lit(True)), allowMissingColumns=True)
    whole = F.coalesce("copied", F.lit(False)) & (F.col("n") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return both.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, all_of_it).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )

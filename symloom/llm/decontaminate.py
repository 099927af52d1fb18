"""Benchmark decontamination with suffix arrays of the training text.

The corpus is cut into shards of about a megabyte of whole documents.  A shard's suffix array lists, in word
order, the positions that begin with words of the benchmark; all other suffixes cannot start a match and are left
out.  Word order is that of the benchmark's vocabulary, so test and training suffixes sort alike.  Every suffix of
every test item is looked up by binary search; the first window of words that must agree decides membership, and a
found pair is followed word by word to its longest verbatim match.  Documents never leave their task and
nothing is shuffled.  The test items come as a broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symloom.llm.blocks import ALNUM, blocks, lower_ascii, prefix_hashes, released, span_hashes, text_bytes, word_spans

WINDOW = 10
#: characters of test items that are broadcast at once; one longer item makes a block of its own
BLOCK_CHARS = 16 << 20


class TestSet:
    """The items of one block as word numbers: 0 is no benchmark word, the vocabulary counts from 1."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        data, ends = text_bytes(pa.array(texts, pa.string()))
        lowered = lower_ascii(data)
        first, after, row = word_spans(lowered, ends, ALNUM)
        hashed = span_hashes(prefix_hashes(lowered), first, after)
        self.vocabulary, self.words = np.unique(hashed, return_inverse=True)
        self.words = self.words + 1
        self.row = row
        self.ids = ids
        self.window = window
        count = np.bincount(row, minlength=len(ids)) if len(ids) else np.zeros(0, int)
        self.ends = np.cumsum(count)
        # every suffix of an item that is as long as its window
        size = np.minimum(count, window)
        self.at: dict[int, np.ndarray] = {}
        left = self.ends[row] - np.arange(len(row))
        for length in np.unique(size[size > 0]).tolist():
            self.at[length] = np.flatnonzero((size[row] == length) & (left >= length))

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashed), np.int64)
        at = np.searchsorted(self.vocabulary, hashed)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashed, at + 1, 0)


def prefix_order(words: np.ndarray, room: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of the first ``length`` words of the suffixes at ``at``: equal for equal words, in word order.

    Ranks of doubled prefixes are made from pairs of ranks; a prefix of any length is two overlapping ones.
    ``room`` is the number of words from a position to the end of its text; only suffixes with enough are given.
    """
    rank = words.astype(np.int64)
    size = 1
    spread = np.zeros(len(words), np.int64)
    while size < length:
        step = min(size, length - size)
        here = at if size + step == length else np.flatnonzero(room >= size + step)
        pair = rank[here] * (int(rank.max()) + 1) + rank[here + step]
        named = np.unique(pair, return_inverse=True)[1] + 1
        spread = np.zeros(len(words), np.int64)
        spread[here] = named
        rank, size = spread, size + step
    return rank[at]


class Shard:
    """Suffix array of one block of documents over the benchmark's words."""

    def __init__(self, tests: TestSet, raw: np.ndarray, starts: np.ndarray):
        lowered = lower_ascii(raw)
        first, after, self.row = word_spans(lowered, starts, ALNUM)
        self.count = np.bincount(self.row, minlength=len(starts) - 1)
        words = tests.numbers(span_hashes(prefix_hashes(lowered), first, after))
        self.begin = np.cumsum(self.count) - self.count
        self.words = words
        # words up to the next foreign word or the end of the document
        stop = np.flatnonzero(np.concatenate((words == 0, [True])) | np.concatenate(([False], self.row[1:] != self.row[:-1], [True])))
        bounds = np.unique(np.concatenate((stop, np.cumsum(self.count))))
        place = np.arange(len(words))
        after_here = np.searchsorted(bounds, place, "right")
        self.room = np.where(words > 0, bounds[np.minimum(after_here, len(bounds) - 1)] - place, 0)

    def matches(self, tests: TestSet) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        """For each window length: positions in the shard where a window stands, the number of that window, the length, the
        test suffixes ordered by window, and where each window's begin (with the end appended).

        Every distinct test window is searched in the suffix array once; however many items share it, a position is told once.
        """
        for length, suffixes in tests.at.items():
            here = np.flatnonzero(self.room >= length)
            if not len(here):
                continue
            joint = np.concatenate((tests.words, self.words))
            left = np.concatenate((tests.ends[tests.row] - np.arange(len(tests.row)), self.room))
            here_joint = here + len(tests.words)
            rank = prefix_order(joint, left, np.concatenate((suffixes, here_joint)), length)
            wanted, have = rank[: len(suffixes)], rank[len(suffixes) :]
            array = np.argsort(have, kind="stable")
            order = np.argsort(wanted, kind="stable")
            windows, begin = np.unique(wanted[order], return_index=True)
            low = np.searchsorted(have[array], windows, "left")
            size = np.searchsorted(have[array], windows, "right") - low
            if not size.sum():
                continue
            take = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
            yield here[array[take]], np.repeat(np.arange(len(windows)), size), length, suffixes[order], np.append(begin, len(order))

    def longest(self, tests: TestSet, at: np.ndarray, test: np.ndarray, length: int) -> np.ndarray:
        """Words from the two positions on that agree."""
        most = np.minimum(self.room[at], tests.ends[tests.row[test]] - test)
        reach = np.full(len(at), length, np.int64)
        going = np.flatnonzero(reach < most)
        while len(going):
            same = self.words[at[going] + reach[going]] == tests.words[test[going] + reach[going]]
            going = going[same]
            reach[going] += 1
            going = going[reach[going] < most[going]]
        return reach


FOUND = ("words", "hit", "bits", "items", "matches")
_MATCH = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())]))


def _expanded(which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the groups ``which``: the place in ``which`` and the place of the member."""
    size = bounds[which + 1] - bounds[which]
    owner = np.repeat(np.arange(len(which)), size)
    return owner, np.repeat(bounds[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _search(shared, first_block: bool, with_matches: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestSet = shared.value
        width = len(tests.words) + 1
        item_begin = np.concatenate(([0], tests.ends[:-1])).astype(np.int64)
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            earlier = None if first_block else [batch.column(c).to_pylist() for c in ("bits", "items", "matches")]
            counts, hits, bits, items, spans = [], [], [], [], []
            for row, after, raw, starts in blocks(data, ends):
                shard = Shard(tests, raw, starts)
                rows = after - row
                cover = np.zeros(len(shard.words) + 1, np.int64)
                found: list[set] = [set() for _ in range(rows)]
                places: list[list] = [[] for _ in range(rows)]
                for at, window, length, suffixes, bounds in shard.matches(tests):
                    # a window is followed to its longest match by one of the test suffixes that begin with it; what another
                    # of them has more is covered by the windows after this one
                    reach = shard.longest(tests, at, suffixes[bounds[window]], length)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + reach, -1)
                    # items are looked up once for each document and window
                    seen = np.unique(shard.row[at] * len(bounds) + window)
                    owner, member = _expanded(seen % len(bounds), bounds)
                    for pair in np.unique((seen // len(bounds))[owner] * width + tests.row[suffixes[member]]).tolist():
                        found[pair // width].add(tests.ids[pair % width])
                    if with_matches:
                        owner, member = _expanded(window, bounds)
                        at, test = at[owner], suffixes[member]
                        reach = shard.longest(tests, at, test, length)
                        # a match that is the rest of the one a word before is told by that one
                        pair = at * width + test
                        told = np.flatnonzero(~np.isin(pair, pair + width + 1))
                        for a, t, n in zip(at[told].tolist(), test[told].tolist(), reach[told].tolist(), strict=True):
                            own, item = int(shard.row[a]), int(tests.row[t])
                            place = {"start": a - int(shard.begin[own]), "length": n, "item": tests.ids[item], "item_start": t - int(item_begin[item])}
                            places[own].append(place)
                hit = np.cumsum(cover[:-1]) > 0
                for i in range(rows):
                    n, begin = int(shard.count[i]), int(shard.begin[i])
                    own = hit[begin : begin + n]
                    if earlier is not None:
                        own = own | np.unpackbits(np.frombuffer(earlier[0][row + i], np.uint8), count=n).astype(bool)
                        found[i].update(earlier[1][row + i])
                        places[i].extend(earlier[2][row + i])
                    counts.append(n)
                    hits.append(int(own.sum()))
                    bits.append(np.packbits(own).tobytes())
                    items.append(sorted(found[i], key=lambda x: (x is None, x)))
                    spans.append(sorted(places[i], key=lambda x: (x["start"], x["item"] or "", x["item_start"])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array(bits, pa.binary()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, _MATCH),
                ],
                names=["row", *FOUND],
            )

    return search


def _blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Items in blocks whose texts have at most ``BLOCK_CHARS`` characters."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        if ids and size + len(row[1] or "") > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
    yield ids, texts


def _found(
    docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_id_col: str, item_text_col: str, with_matches: bool
) -> DataFrame:
    """(row, words, hit, bits, items, matches); all columns of ``docs`` travel inside ``row``, whatever their names."""
    row = F.struct("*")
    out = docs.select(row.alias("row"))
    match = T.StructType.fromDDL("start long, length long, item string, item_start long")
    kinds = {"words": T.LongType(), "hit": T.LongType(), "bits": T.BinaryType(), "items": T.ArrayType(T.StringType()), "matches": T.ArrayType(match)}
    schema = T.StructType([T.StructField("row", out.schema["row"].dataType), *[T.StructField(n, kinds[n]) for n in FOUND]])
    for number, (ids, texts) in enumerate(_blocks_of(benchmark, item_id_col, item_text_col)):
        shared = docs.sparkSession.sparkContext.broadcast(TestSet(ids, texts, window))
        rows = out.withColumn("text", F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))
        out = rows.mapInArrow(released(_search(shared, number == 0, with_matches)), schema)
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    with_matches: bool = True,
) -> DataFrame:
    """All rows and columns of ``docs`` with __words, __hit (words inside any occurrence of a window), __bits (a bit for
    each word: hit or not), __items (ids, as strings, of the items with occurring windows) and __matches (longest
    verbatim matches: start and length in words, item, item_start; empty unless ``with_matches``).

    A-Z are lower-cased; words are runs of digits, letters and non-ASCII characters.  A window is ``window`` consecutive
    words of an item, or the whole item if it has fewer; items without words have none.  Null has no words.  Repeated
    items are all named.  With an empty benchmark nothing is hit; an empty table gives an empty result.  Columns of
    ``docs`` that have the names of the new ones are replaced.

    Items come in blocks of 16 million characters; a document passes one search for each block.
    """
    found = _found(docs, benchmark, window, text_col, item_id_col, item_text_col, with_matches)
    new = {f"__{n}": n for n in FOUND}
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in new], *[F.col(c).alias(n) for n, c in new.items()])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The documents that hold no window of the benchmark, all columns as they were, whatever their names.

    Documents without words and null texts stay; rows that repeat are answered alike, an empty table stays empty.
    """
    return _found(docs, benchmark, window, text_col, "item_id", "text", False).filter("hit = 0").select("row.*")

"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

A document of n tokens is cut at the binary digits of n: as many pieces of the full length as fit, then one
piece for each 1 digit of the rest, from long to short.  Every piece is a sequence of its own whose length is a
power of two; equal lengths make a bucket, from which batches without padding can be drawn.  Documents are
handled one by one inside their partition, so nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm.blocks import U64, blocks, prefix_hashes, released, span_hashes, text_bytes

FULL = 2048
#: words whose token ids a task remembers, and how many ids
REMEMBERED = 500_000
REMEMBERED_IDS = 2_000_000
#: characters below this are known to be unchanged by NFC and to have one-character lower cases, but for U+0130
_PLAIN = 0x250
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    import unicodedata

    kinds = np.full(_PLAIN, _OTHER, np.uint8)
    for code in range(_PLAIN):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            kinds[code] = _LETTER
        elif category[0] == "N":
            kinds[code] = _DIGIT
        elif chr(code).isspace() and code not in (0x1C, 0x1D, 0x1E, 0x1F):
            kinds[code] = _SPACE
    return kinds


class WordTokens:
    """Token ids of whole texts; ids of words seen before come from memory.

    The vocabulary splits a text into words first and then each word by itself, so the ids of a text are those of its
    words in a row.  Texts that hold special tokens or characters beyond the Latin blocks go to the
    tokenizer as a whole.  Memory is bounded by ``REMEMBERED`` words.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.normalizers import Sequence

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words that are normalised and cut out already
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.closes[number] = token.endswith("</w>")
        self.kinds = _classes()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: str) -> bool:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.all_plain(text, codes)

    def all_plain(self, text: str, codes: np.ndarray) -> bool:
        if len(codes) and (codes.max() >= _PLAIN or (codes == 0x130).any()):
            return False
        return not any(t in text for t in self.special)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        lines = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
        found = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint32)
        last = np.flatnonzero(self.closes[ids])
        if len(last) != len(words):
            # some token closes a word within it, or none does: word by word
            parts = [self.model.encode(w, add_special_tokens=False).ids for w in words]
            ids = np.array([i for p in parts for i in p], np.uint32)
            last = np.cumsum([len(p) for p in parts]) - 1
        first = np.concatenate(([0], last[:-1] + 1))
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.at = np.insert(self.at, at, first + len(self.ids))
        self.size = np.insert(self.size, at, last + 1 - first)
        self.ids = np.concatenate((self.ids, ids))

    def words(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the words of lower-cased texts, given as code points: runs of letters or of other visible
        characters, single digits, and contractions where an apostrophe opens a match."""
        kinds = self.kinds[codes]
        n = len(codes)
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        edge[n] = True
        change = np.ones(n + 1, bool)
        change[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        change |= edge
        bounds = np.flatnonzero(change)
        first, after = bounds[:-1], bounds[1:]
        seen = kinds[first] != _SPACE
        first, after = first[seen], after[seen]
        quote = np.flatnonzero((codes[first] == 39) & (after - first == 1))
        if len(quote):
            padded = np.concatenate((codes, np.zeros(2, codes.dtype)))
            joined = np.zeros(len(first), np.int64)
            # a following run of letters that the same text continues with
            quote = quote[quote + 1 < len(first)]
            quote = quote[(first[quote + 1] == after[quote]) & (kinds[after[quote]] == _LETTER) & ~edge[after[quote]]]
            one, two = padded[after[quote]], padded[after[quote] + 1]
            room = after[quote + 1] - first[quote + 1]
            short = np.isin(one, [ord(c) for c in "stmd"])
            pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            take = np.where(short, 1, np.where(pairs & (room >= 2), 2, 0))
            joined[quote] = take
            after = after + joined
            first = first.copy()
            first[1:] += joined[:-1]
            left = after > first
            first, after = first[left], after[left]
        return first, after

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (with the end appended)."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        plain, kept = [True] * len(texts), texts
        lowered = joined
        if not self.all_plain(joined, codes):
            plain = [self.plain(t) for t in texts]
            kept = [t if p else "" for t, p in zip(texts, plain, strict=True)]
            lowered = "".join(kept)
        lowered = lowered.lower()
        codes = np.frombuffer(lowered.encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(t) for t in kept]))).astype(np.int64)
        counts = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(codes):
            first, after = self.words(codes, starts[:-1][starts[:-1] < len(codes)])
            hashed = span_hashes(prefix_hashes(codes), first, after)
            keys, one, number = np.unique(hashed, return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == keys[inside]
            if not known.all():
                if len(self.keys) + int((~known).sum()) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
                    self.forget()
                    known[:] = False
                new = one[~known]
                spans = zip(first[new].tolist(), after[new].tolist(), strict=True)
                self.learn(keys[~known], [lowered[a:b] for a, b in spans])
                place = np.searchsorted(self.keys, keys)
            size = self.size[place][number]
            at = self.at[place][number]
            stop = np.cumsum(size)
            shift = np.repeat(at - (stop - size), size)
            ids = self.ids[shift + np.arange(len(shift))]
            row = np.searchsorted(starts[1:], first, "right")
            counts = np.bincount(row, size, len(texts)).astype(np.int64)
        if all(plain):
            return ids, np.concatenate(([0], np.cumsum(counts)))
        cut = np.concatenate(([0], np.cumsum(counts)))
        parts = [ids[cut[i] : cut[i + 1]] if p else self.whole(t) for i, (t, p) in enumerate(zip(texts, plain, strict=True))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def binary_pieces(n: int, full: int = FULL) -> list[int]:
    """Lengths of the pieces of n tokens, from long to short: full ones, then the binary digits of the rest."""
    out = [full] * (n // full)
    rest = n % full
    out.extend(1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1)
    return out


def _packer(path: str, end_id: int, full: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            numbers = batch.column("id").to_pylist()
            for row, after, raw, starts in blocks(data, ends):
                body = raw.tobytes()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                ids, cut = tokens.encode(texts)
                docs, begins, sizes, totals, parts = [], [], [], [], []
                for i in range(after - row):
                    own = np.concatenate((ids[cut[i] : cut[i + 1]], end)).astype("<u4").tobytes()
                    total, begin = len(own) // 4, 0
                    for size in binary_pieces(total, full):
                        docs.append(numbers[row + i])
                        begins.append(begin)
                        sizes.append(size)
                        totals.append(total)
                        parts.append(own[4 * begin : 4 * (begin + size)])
                        begin += size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(parts, pa.binary())],
                    names=["id", "start", "length", "doc_tokens", "ids"],
                )

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, full: int = FULL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: the id, start, length (a power of two, the bucket), doc_tokens, sequence_id, offset (0)
    and ids (the token ids, little-endian unsigned 32 bits).

    Sequences are numbered bucket by bucket: the numbers of a longer length come after all of a shorter one.

    A text's ids are followed by ``end_id``; a null or empty text is that id alone.  Repeated rows and ids are
    packed each by itself.  ``tokenizer_path`` has to be readable on all executors.  An empty table gives an empty
    result; other columns are not read.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("full is a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(
        released(_packer(tokenizer_path, end_id, full)), "id long, start long, length long, doc_tokens long, ids binary"
    )
    bucket = F.length(F.bin("length")) - 1
    return pieces.select(
        F.col("id").alias(id_col),
        "start",
        "length",
        "doc_tokens",
        # a bucket's own numbers are below 2^56 up to eight million partitions
        (F.shiftleft(bucket.cast("long"), 56) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        "ids",
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet, one folder per length, so that a batch is read from one bucket; an empty table writes no bucket."""
    pieces.write.partitionBy("length").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length, all of it ids without padding; other buckets are not read.  No row for a length without sequences."""
    kinds = "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary, length long"
    return spark.read.schema(kinds).parquet(path).filter(F.col("length") == length)

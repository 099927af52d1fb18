"""Byte-pair encoding and decoding by batched merge rounds.

The words of many texts lie one after the other in one flat array of symbols.  In a round every word merges its
pair of lowest rank, wherever it stands in the word; ranks of all neighbouring pairs are found at once by binary
search over the sorted pair keys of the merge table.  A round leaves fewer symbols, words without a pair are set
aside, and the rounds end when none is left.  Merging all places of a pair in one round is the same as merging one place
at a time, because no pair that a merge makes ranks before that merge (checked when a table is read).

The vocabulary's file says how texts become words: special tokens are cut out, the rest is normalised (NFC, white space to one
space, lower case), split at white space and by the file's pattern, and taken as bytes.  Each distinct stretch between white
space is merged once per task and remembered; what is remembered is bounded in entries and in characters.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from symloom.llm.blocks import blocks, text_bytes

#: what a task remembers at most: distinct stretches, and their characters
REMEMBERED = 400_000
REMEMBERED_CHARS = 16_000_000
_NONE = np.iinfo(np.int64).max


def byte_characters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, all other
    bytes in order from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [other.get(b, chr(b)) for b in range(256)]


class MergeTable:
    """Merges of a vocabulary as sorted pair keys with rank and product."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str = ""):
        self.size = max(vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # the first rank that uses a symbol must come after every rank that makes it
        first = np.full(self.size, _NONE)
        np.minimum.at(first, np.concatenate((left, right)), np.tile(np.arange(len(pairs)), 2))
        if (first[made] < np.arange(len(pairs))).any():
            raise ValueError("a merge makes a pair that ranks before it; rounds would not equal single merges")
        signs = byte_characters()
        self.inner = np.array([vocabulary[c] for c in signs], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in signs], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number beyond all ranks."""
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word begins (with the end appended)."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes)
        filled = sizes > 0
        symbols[ends[filled] - 1] = self.last[raw[ends[filled] - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done = []
        while len(symbols):
            joint = owner[1:] == owner[:-1]
            ranks = np.full(len(symbols), _NONE)
            at = np.flatnonzero(joint)
            ranks[at] = self.pair_ranks(symbols[at], symbols[at + 1])
            begins = np.flatnonzero(np.concatenate(([True], ~joint)))
            lowest = np.minimum.reduceat(ranks, begins)
            spread = np.repeat(lowest, np.diff(np.append(begins, len(symbols))))
            rest = spread == _NONE
            if rest.any():
                done.append((owner[rest], symbols[rest]))
                live = ~rest
                symbols, owner, ranks, spread = symbols[live], owner[live], ranks[live], spread[live]
            place = np.flatnonzero(ranks == spread)
            if not len(place):
                break
            # a pair of twice the same symbol overlaps itself: of touching places every second one is taken, from the left
            fresh = np.concatenate(([True], np.diff(place) != 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - run) % 2 == 0]
            symbols[place] = self.made[ranks[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        owner, symbols = (np.concatenate(parts) for parts in zip(*done, strict=True))
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(words))
        return symbols[order], np.concatenate(([0], np.cumsum(counts)))


class Codec:
    """Encoder and decoder of one vocabulary file; made anew in each task."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        cut, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            model["type"] == "BPE"
            and [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": "\\s+"}, " ")
            and (cut["type"], cut["behavior"], cut["invert"]) == ("Split", "Removed", True)
            and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
            and not (spec["decoder"] or spec["post_processor"] or model["dropout"] or model["ignore_merges"])
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError(f"{path}: not a lower-casing word vocabulary with byte-level symbols")
        self.path = path
        self.table = MergeTable(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.pattern = regex.compile(cut["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = dict(sorted((number, token) for token, number in (model["vocab"] | self.special).items()))
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.cuts = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._library = self._assigned = None
        self.forget()

    def forget(self) -> None:
        # specials are kept under bytes, which no stretch of a text equals
        self.place = {t.encode(): k for k, t in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int64)
        self.starts = np.arange(len(self.special) + 1)
        self.chars = 0

    def library(self):
        """The tokenizer's own normaliser and splitter, for code points that Python's tables do not know yet."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def assigned(self, text: str) -> bool:
        """Whether Python's character tables know all code points; the first unassigned one is U+0378."""
        if text.isascii():
            return True
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if codes.max() < 0x378:
            return True
        if self._assigned is None:
            self._assigned = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)])
        return bool(self._assigned[codes].all())

    def stretches(self, text: str) -> list[str]:
        """The text normalised and cut at white space."""
        if not self.assigned(text):
            return self.space.split(self.library().normalizer.normalize_str(text))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # \x1c to \x1f split in Python but are no white space to the pattern
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.space.split(text)
        return text.split()

    def words(self, stretch: str) -> list[bytes]:
        if self.assigned(stretch):
            return [w.encode() for w in self.pattern.findall(stretch)]
        found = self.library().pre_tokenizer.pre_tokenize_str(stretch)
        return [bytes(self.bytes_of[c] for c in word) for word, _ in found]

    def learn(self, fresh: list[str]) -> None:
        words = [self.words(s) for s in fresh]
        ids, bounds = self.table.merge([w for own in words for w in own])
        counts = np.cumsum([len(own) for own in words])
        for number, stretch in enumerate(fresh, len(self.place)):
            self.place[stretch] = number
        self.starts = np.concatenate((self.starts, bounds[counts] + len(self.ids)))
        self.ids = np.concatenate((self.ids, ids))
        self.chars += sum(map(len, fresh))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (with the end appended)."""
        parts, sizes = [], []
        for text in texts:
            before, at = len(parts), 0
            for found in self.cuts.finditer(text):
                parts.extend(self.stretches(text[at : found.start()]))
                parts.append(found.group().encode())
                at = found.end()
            parts.extend(self.stretches(text[at:] if at else text))
            sizes.append(len(parts) - before)
        fresh = set(parts) - self.place.keys()
        if fresh and (len(self.place) + len(fresh) > REMEMBERED or self.chars > REMEMBERED_CHARS):
            self.forget()
            fresh = set(parts) - self.place.keys()
        if fresh:
            self.learn(list(fresh))
        number = np.fromiter(map(self.place.__getitem__, parts), np.int64, len(parts))
        begin, length = self.starts[number], self.starts[number + 1] - self.starts[number]
        stop = np.cumsum(length)
        ids = self.ids[np.repeat(begin - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        return ids, np.concatenate(([0], stop))[bounds]

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids with a space between; numbers that name no token are left out."""
        names = self.names
        try:
            return " ".join([names[i] for i in ids])
        except KeyError:
            return " ".join([names[i] for i in ids if i in names])


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            for row, after, raw, starts in blocks(data, ends):
                body = raw.tobytes()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                ids, bounds = codec.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, after - row), lists], names=["row", "ids"])

    return run


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            lists = batch.column("ids")
            for at in range(0, len(batch), 256):
                own = lists.slice(at, 256)
                texts = [codec.decode(ids or []) for ids in own.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, 256), own, pa.array(texts, pa.string())], names=["row", "ids", "decoded"])

    return run


def _carrying(row: StructType, *more: StructField) -> StructType:
    return StructType([StructField("row", row), StructField("ids", ArrayType(IntegerType())), *more])


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row and ``ids`` (array of int), the ids of its whole text without added special tokens.

    Strings of special tokens inside a text are those tokens.  A null or empty text has no ids (an empty array).
    Repeated rows are encoded each by itself, an empty table gives an empty result; columns not in ``keep`` are not read,
    whatever their names.  ``path`` (a vocabulary file) has to be readable on all executors.  Nothing is shuffled; a task holds a block
    of about a megabyte, or one longer text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    rows = docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_encoder(path), _carrying(rows.schema["row"].dataType))
    return out.select("row.*", "ids")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the tokens of ``ids_col`` with a space between, special ones included.

    A null or empty array, and numbers that name no token, give no text.  A column named ``decoded`` is replaced.
    """
    kept = [c for c in encoded.columns if c not in (ids_col, "decoded")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    rows = encoded.select(row.alias("row"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    out = rows.mapInArrow(_decoder(path), _carrying(rows.schema["row"].dataType, StructField("decoded", StringType())))
    return out.select(*[F.col(f"row.`{c}`") for c in kept], F.col("ids").alias(ids_col), "decoded")

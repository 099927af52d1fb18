"""Alignment of two tokenizers over the same bytes by an associative fragment monoid.

A text's bytes are covered by the tokens of a byte-level vocabulary (A) and of a piece vocabulary (B).  Offsets where tokens of both end
cut them into groups; a token of A and one of B whose byte ranges overlap are linked.

``Fragment`` is what a byte range of a document says about its groups: the tokens up to its first common end (open prefix), the
groups between its first and last common end (closed), and the tokens after that (open suffix).  Fragments of neighbouring
ranges compose: the suffix of one and the prefix of the next close one more group.  Composition is associative, so ranges are
tokenised by different tasks, and a tree of rounds over (document, range) makes one fragment per document.

* A text of up to ``RANGE`` bytes is one range and never shuffled.
* A longer one is cut at blanks between visible characters, where neither vocabulary has a token across; each task tokenises its
  stretches, cuts the tokens into exact byte ranges (mostly in the middle of a word) and sends fragments.

How often two ids are linked is counted per block of texts first.  Totals return to each block once per pair that occurs in it,
so no table of all pairs is broadcast and nothing is tokenised twice.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.llm.blocks import blocks, released, text_bytes
from symloom.llm.bpe_codec import byte_characters
from symloom.session import stage

#: bytes of a range, and of the texts that are counted together
RANGE = 1 << 16
BLOCK = 1 << 21
#: ranges that one round composes; three rounds take more than any cell holds
FAN = 64
ROUNDS = 3
#: what a task remembers at most: distinct words, and their bytes
REMEMBERED = 250_000
REMEMBERED_BYTES = 16_000_000
#: words that are tokenised as one text
LINE = 256
#: words that are learned at once
AT_ONCE = 1 << 15
#: a blank between visible characters, neither of which is white space beyond ASCII
_WIDE = rb"\xc2[\x85\xa0]", rb"\xe1\x9a\x80", rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", rb"\xe2\x81\x9f", rb"\xe3\x80\x80"
BLANK = re.compile(
    b"(?<=[!-~\x80-\xff])" + b"".join(b"(?<!%s)" % w for w in _WIDE) + b" (?=[!-~\x80-\xff])(?!" + b"|".join(_WIDE) + b")"
)
_REGULAR = re.compile(b"[!-~\x80-\xff](?:.*[!-~\x80-\xff])?", re.DOTALL)

Tokens = list[tuple[int, int]]


def group_text(a: Tokens, b: Tokens) -> str:
    return ",".join(str(t) for t, _ in a) + "|" + ",".join(str(t) for t, _ in b)


def group_links(a: Tokens, b: Tokens) -> list[int]:
    """Pair keys of the links of one group; both sides begin at one byte and end at one."""
    out, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        out.append(a[i][0] << 32 | b[k][0])
        one, two = a[i][1], b[k][1]
        i += one <= two
        k += two <= one
    return out


def split_groups(a: Tokens, b: Tokens) -> tuple[list[tuple[Tokens, Tokens]], tuple[Tokens, Tokens]]:
    """The tokens up to each common end, and those after the last one."""
    out, i, k, from_a, from_b = [], 0, 0, 0, 0
    while i < len(a) and k < len(b):
        one, two = a[i][1], b[k][1]
        i += one <= two
        k += two <= one
        if one == two:
            out.append((a[from_a:i], b[from_b:k]))
            from_a, from_b = i, k
    return out, (a[from_a:], b[from_b:])


@dataclass
class Fragment:
    """Tokens are pairs of id and end; ``cut`` says whether the range holds a common end.  Without one all is prefix."""

    cut: bool = False
    ok: bool = True
    pre_a: Tokens = field(default_factory=list)
    pre_b: Tokens = field(default_factory=list)
    suf_a: Tokens = field(default_factory=list)
    suf_b: Tokens = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    links: list[np.ndarray] = field(default_factory=list)

    def add_group(self, a: Tokens, b: Tokens) -> None:
        self.groups.append(group_text(a, b))
        self.links.append(np.array(group_links(a, b), np.int64))
        self.n_a, self.n_b, self.n_groups = self.n_a + len(a), self.n_b + len(b), self.n_groups + 1

    def then(self, right: Fragment) -> Fragment:
        """The fragment of this range and the one after it."""
        ok = self.ok and right.ok
        if not self.cut:
            return Fragment(
                right.cut, ok, self.pre_a + right.pre_a, self.pre_b + right.pre_b, right.suf_a, right.suf_b,
                right.groups, right.n_a, right.n_b, right.n_groups, right.links,
            )
        out = Fragment(True, ok, self.pre_a, self.pre_b, groups=list(self.groups), n_a=self.n_a, n_b=self.n_b, n_groups=self.n_groups, links=list(self.links))
        if not right.cut:
            out.suf_a, out.suf_b = self.suf_a + right.pre_a, self.suf_b + right.pre_b
            return out
        out.add_group(self.suf_a + right.pre_a, self.suf_b + right.pre_b)
        out.groups += right.groups
        out.links += right.links
        out.n_a, out.n_b, out.n_groups = out.n_a + right.n_a, out.n_b + right.n_b, out.n_groups + right.n_groups
        out.suf_a, out.suf_b = right.suf_a, right.suf_b
        return out

    @staticmethod
    def of(a: Tokens, b: Tokens) -> Fragment:
        """The fragment of tokens in a row."""
        closed, rest = split_groups(a, b)
        if not closed:
            return Fragment(False, True, list(a), list(b))
        out = Fragment(True, True, *closed[0], *rest)
        for own in closed[1:]:
            out.add_group(*own)
        return out

    def closed(self) -> Fragment:
        """The fragment of a whole document with its first group closed; it ends at a common end, so no suffix is left."""
        whole = self.ok and self.cut and not (self.suf_a or self.suf_b)
        if not whole:
            return Fragment(True, False)
        out = Fragment(True)
        out.add_group(self.pre_a, self.pre_b)
        out.groups += self.groups
        out.links += self.links
        out.n_a, out.n_b, out.n_groups = out.n_a + self.n_a, out.n_b + self.n_b, out.n_groups + self.n_groups
        return out


class Aligner:
    """Both vocabularies, and the alignment of words met before; made anew in each task."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as file:
            names = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = {number: bytes(byte_of[c] for c in name) for name, number in names.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = {}
        for number in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(number)
            self.b_bytes[number] = bytes([int(piece[1:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()
        self.a_names, self.b_names = ([known.get(i, b"") for i in range(max(known) + 2)] for known in (self.a_bytes, self.b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(n) for n in names], np.int64) for names in (self.a_names, self.b_names))
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.groups: list[str] = []
        #: per word: whether bytes are kept, tokens of A and B, groups, links
        self.facts = np.zeros((0, 5), np.int64)
        self.links = self.begins = np.zeros(0, np.int64)
        self.pairs: dict[int, int] = {}
        self.bytes = 0

    def whole(self, word: bytes) -> tuple[Tokens, Tokens] | None:
        """Tokens with byte ends of a blank and the word; None where their bytes differ from these."""
        text = word.decode("utf-8", "replace")
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        out = []
        for ids, known in ((a, self.a_bytes), (b, self.b_bytes)):
            parts = [known.get(i, b"") for i in ids]
            if b"".join(parts) != b" " + word or not all(parts):
                return None
            out.append(list(zip(ids, np.cumsum([len(p) for p in parts]).tolist(), strict=True)))
        return out[0], out[1]

    def lines(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
        """Words that begin and end visibly, many to a text, as neither vocabulary has a token across the blanks between them.

        Returns those words, the ids of A and of B one after the other, and the words that could not be had so.
        """
        parts = [words[at : at + LINE] for at in range(0, len(words), LINE)]
        whole = [b" ".join(part) for part in parts]
        texts = [w.decode("utf-8", "replace") for w in whole]
        found_a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        found_b = self.b.encode(texts, num_threads=1)
        kept, odd, a, b = [], [], [], []
        for part, line, one, two in zip(parts, whole, found_a, found_b, strict=True):
            one = one.ids
            if all(b"".join(map(names.__getitem__, ids)) == b" " + line for names, ids in ((self.a_names, one), (self.b_names, two))):
                kept += part
                a += one
                b += two
            else:
                odd += part
        return kept, np.array(a, np.int64), np.array(b, np.int64), odd

    def learn(self, words: list[bytes]) -> None:
        regular = [w for w in words if _REGULAR.fullmatch(w)]
        kept, a, b, odd = self.lines(regular)
        if kept:
            odd += self.learn_line(kept, a, b)
        facts, links = [], []
        plain = set(regular)
        for word in [*odd, *(w for w in words if w not in plain)]:
            tokens = self.whole(word)
            self.place[word] = len(self.groups)
            if tokens is None:
                self.groups.append("")
                facts.append((0, 0, 0, 0, 0))
                continue
            closed, _ = split_groups(*tokens)
            self.groups.append(";".join([group_text(*own) for own in closed]))
            own = [self.pairs.setdefault(p, len(self.pairs)) for g in closed for p in group_links(*g)]
            facts.append((1, len(tokens[0]), len(tokens[1]), len(closed), len(own)))
            links += own
        self.added(facts, links)
        self.bytes += sum(map(len, words))

    def added(self, facts, links) -> None:
        if len(facts):
            self.facts = np.concatenate((self.facts, np.asarray(facts, np.int64)))
            self.links = np.concatenate((self.links, np.asarray(links, np.int64)))
            self.begins = np.cumsum(self.facts[:, 4]) - self.facts[:, 4]

    def learn_line(self, words: list[bytes], a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """Groups and links of many words at once, from the ends of the tokens of one long line.

        Words are handed back if an end of one is no common end, which the choice of blanks rules out.
        """
        stops = np.cumsum([len(w) + 1 for w in words])
        size_a, size_b = self.a_sizes[a], self.b_sizes[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        at = np.searchsorted(common, stops)
        if not (common[np.minimum(at, len(common) - 1)] == stops).all():
            return words
        word_of = np.searchsorted(stops, common)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        # tokens of B that begin before a token of A ends, from the first that ends after it begins
        low = np.searchsorted(end_b, end_a - size_a, "right")
        each = np.searchsorted(end_b - size_b, end_a, "left") - low
        left = np.repeat(np.arange(len(a)), each)
        right = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(len(left))
        keys, number = np.unique(a[left] << 32 | b[right], return_inverse=True)
        known = np.array([self.pairs.setdefault(k, len(self.pairs)) for k in keys.tolist()], np.int64)
        count = lambda owner: np.bincount(owner, minlength=len(words))
        facts = np.stack([np.ones(len(words), np.int64), count(word_of[group_a]), count(word_of[group_b]), count(word_of), count(word_of[group_a[left]])], axis=1)
        # ids in the order of the text: group by group, A before B, and what stands after each
        group = np.concatenate((group_a, group_b))
        side = np.concatenate((np.zeros(len(a), np.int8), np.ones(len(b), np.int8)))
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        after = np.zeros(len(order), np.int64)
        after[:-1] = np.where(group[1:] == group[:-1], np.where(side[1:] == side[:-1], 0, 1), np.where(word_of[group[1:]] == word_of[group[:-1]], 2, 3))
        after[-1] = 3
        signs = np.array([",", "|", ";", "\n"], object)[after]
        text = "".join([x for pair in zip(map(str, np.concatenate((a, b))[order].tolist()), signs.tolist(), strict=True) for x in pair])
        for place, word in enumerate(words, len(self.groups)):
            self.place[word] = place
        self.groups += text[:-1].split("\n")
        self.added(facts, known[number])
        return []

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Places of the words in memory; what was there before may be forgotten."""
        fresh = set(words) - self.place.keys()
        if fresh and (len(self.place) + len(fresh) > REMEMBERED or self.bytes > REMEMBERED_BYTES):
            self.forget()
            fresh = set(words)
        fresh = list(fresh)
        for at in range(0, len(fresh), AT_ONCE):
            self.learn(fresh[at : at + AT_ONCE])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """Links of the words one after the other, as places in ``pairs``."""
        length = self.facts[numbers, 4]
        stop = np.cumsum(length)
        at = np.repeat(self.begins[numbers] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)
        return self.links[at]

    def pair_keys(self) -> np.ndarray:
        return np.fromiter(self.pairs, np.int64, len(self.pairs))


_BLOCK = "block long, ids array<long>, facts array<long>, groups array<string>, sizes array<int>, slots binary, times binary, keys array<long>, totals array<long>"
_NAMES = ["block", "ids", "facts", "groups", "sizes", "slots", "times", "keys", "totals"]


def _block_row(block: int, ids: list, facts: np.ndarray, groups: list[str], owner: np.ndarray, keys: np.ndarray, places: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row of texts: four facts a text, and how often each pair (a place in ``keys``) is linked in each text."""
    totals = np.zeros(len(keys), np.int64)
    np.add.at(totals, places, times)
    sizes = np.bincount(owner, minlength=len(ids)).astype(np.int32)
    pack = lambda v: zlib.compress(v.astype("<u4").tobytes(), 1)
    row = [block, ids, facts.ravel().tolist(), groups, sizes.tolist(), pack(places), pack(times), keys.tolist(), totals.tolist()]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=_NAMES)


def _short_texts(path_a: str, path_b: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            names = batch.column("id").to_pylist()
            for row, after, raw, starts in blocks(data, ends, BLOCK):
                body = raw.tobytes()
                words, counts = [], []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = BLANK.split(body[a:b]) if b > a else []
                    words += own
                    counts.append(len(own))
                place = aligner.numbers(words)
                text = np.repeat(np.arange(after - row), counts)
                lost = np.zeros(after - row, bool)
                lost[text[aligner.facts[place, 0] == 0]] = True
                bounds = np.concatenate(([0], np.cumsum(counts))).tolist()
                listed = list(map(aligner.groups.__getitem__, place.tolist()))
                groups = ["" if gone else ";".join(listed[bounds[k] : bounds[k + 1]]) for k, gone in enumerate(lost.tolist())]
                kept = ~lost[text]
                place, text = place[kept], text[kept]
                facts = np.zeros((after - row, 4), np.int64)
                np.add.at(facts, text, aligner.facts[place, 1:])
                links = aligner.links_of(place)
                owner = np.repeat(text, aligner.facts[place, 4])
                seen = np.bincount(links, minlength=len(aligner.pairs))
                used = np.flatnonzero(seen)
                slot = np.zeros(len(seen), np.int64)
                slot[used] = np.arange(len(used))
                cells, times = np.unique(owner * max(len(used), 1) + slot[links], return_counts=True)
                owner, slots = np.divmod(cells, max(len(used), 1))
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield _block_row(number, names[row:after], facts, groups, owner, aligner.pair_keys()[used], slots, times)
                number += 1

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long texts cut at the first blank of each range that is cut safely; offsets count the blank before the text."""
    for batch in batches:
        data, ends = text_bytes(batch.column("text"))
        raw = data.tobytes()
        for k, (uid, own) in enumerate(zip(batch.column("uid").to_pylist(), batch.column("id").to_pylist(), strict=True)):
            begin, close = int(ends[k]), int(ends[k + 1])
            at = begin
            while at < close:
                # the next range that begins after this stretch does
                goal = begin + ((at - begin) // RANGE + 1) * RANGE
                found = BLANK.search(raw, goal, close) if goal < close else None
                stop = found.start() if found else close
                # the stretch without the blank before it, which stands at offset ``at`` of blank and text
                values = ([uid], pa.int64()), ([own], pa.int64()), ([at - begin], pa.int64()), ([raw[at:stop]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(*v) for v in values], names=["uid", "id", "at", "part"])
                at = stop + 1


_FRAGMENT = (
    "uid long, id long, range long, at long, cut boolean, ok boolean, pre_a array<long>, pre_b array<long>, suf_a array<long>, suf_b array<long>, "
    "groups string, n_a long, n_b long, n_groups long, keys array<long>, times array<long>"
)


def _flat(tokens: Tokens) -> list[int]:
    return [x for token in tokens for x in token]


def _fragment_row(uid: int, own: int | None, number: int, at: int, f: Fragment, times: np.ndarray | None = None) -> dict:
    keys = np.concatenate(f.links) if f.links else np.zeros(0, np.int64)
    if times is None:
        keys, times = np.unique(keys, return_counts=True)
    return {
        "uid": uid, "id": own, "range": number, "at": at, "cut": f.cut, "ok": f.ok,
        "pre_a": _flat(f.pre_a), "pre_b": _flat(f.pre_b), "suf_a": _flat(f.suf_a), "suf_b": _flat(f.suf_b),
        "groups": ";".join(f.groups), "n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "keys": keys.tolist(), "times": times.tolist(),
    }


def _read_fragment(row: dict) -> Fragment:
    pairs = lambda flat: list(zip(flat[::2], flat[1::2], strict=True))
    return Fragment(
        row["cut"], row["ok"], pairs(row["pre_a"]), pairs(row["pre_b"]), pairs(row["suf_a"]), pairs(row["suf_b"]),
        [row["groups"]] if row["groups"] else [], row["n_a"], row["n_b"], row["n_groups"],
    )


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in _FRAGMENT.split(", "))])


def range_fragments(aligner: Aligner, at: int, part: bytes) -> Iterator[tuple[int, int, Fragment]]:
    """Fragments of a stretch (a blank at offset ``at``, then ``part``): range, offset, fragment, in their order.

    A range has one of its whole words and one of each word that reaches over an end.  A token belongs to the range that holds its last byte, so a range may begin and end inside words and tokens.
    """
    words = BLANK.split(part)
    places = aligner.numbers(words)
    ends = at + np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    low, high = starts // RANGE, (ends - 1) // RANGE
    k = 0
    while k < len(words):
        number = int(low[k])
        # words that end in this range, then what a word over its end leaves in each range it touches
        whole = int(np.searchsorted(high, number, "right"))
        if whole > k:
            yield number, int(starts[k]), _word_run(aligner, words[k], places[k:whole], int(starts[k]))
            k = whole
            continue
        if not aligner.facts[places[k], 0]:
            yield number, int(starts[k]), Fragment(ok=False)
        else:
            sides = shifted(aligner.whole(words[k]), int(starts[k]))
            for r in range(number, int(high[k]) + 1):
                yield r, int(starts[k]), Fragment.of(*[[t for t in side if (t[1] - 1) // RANGE == r] for side in sides])
        k += 1


def shifted(sides: tuple[Tokens, Tokens], by: int) -> list[Tokens]:
    return [[(token, end + by) for token, end in side] for side in sides]


def _word_run(aligner: Aligner, word: bytes, places: np.ndarray, start: int) -> Fragment:
    """The fragment of whole words: the first word's first group is its open prefix, the last word ends it."""
    facts = aligner.facts[places]
    if not facts[:, 0].all():
        return Fragment(ok=False)
    out = Fragment.of(*shifted(aligner.whole(word), start))
    rest = places[1:]
    counts = facts[1:].sum(axis=0)
    out.groups += [aligner.groups[p] for p in rest.tolist()]
    out.links.append(aligner.pair_keys()[aligner.links_of(rest)])
    out.n_a, out.n_b, out.n_groups = out.n_a + int(counts[1]), out.n_b + int(counts[2]), out.n_groups + int(counts[3])
    return out


def _fragments(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, schema = Aligner(path_a, path_b), _arrow_schema()
        for batch in batches:
            for row in batch.to_pylist():
                made = range_fragments(aligner, row["at"], row["part"])
                yield pa.RecordBatch.from_pylist([_fragment_row(row["uid"], row["id"], number, at, f) for number, at, f in made], schema)

    return run


def compose_rows(rows: list[dict]) -> dict:
    """One row of the fragments of neighbouring ranges, composed in their order as a balanced tree."""
    rows = sorted(rows, key=lambda r: (r["range"], r["at"]))
    level = [_read_fragment(r) for r in rows]
    while len(level) > 1:
        level = [level[k].then(level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    out = level[0]
    keys = np.concatenate([np.array(r["keys"], np.int64) for r in rows] + out.links)
    times = np.concatenate([np.array(r["times"], np.int64) for r in rows] + [np.ones(sum(map(len, out.links)), np.int64)])
    out.links, back = (lambda u, i: ([u], i))(*np.unique(keys, return_inverse=True))
    sums = np.zeros(len(out.links[0]), np.int64)
    np.add.at(sums, back, times)
    return _fragment_row(rows[0]["uid"], rows[0]["id"], rows[0]["range"] // FAN, rows[0]["at"], out, sums)


def _compose(table: pa.Table) -> pa.Table:
    return pa.Table.from_pylist([compose_rows(table.to_pylist())], _arrow_schema())


def _long_texts(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = _read_fragment(row)
                whole = part.closed()
                groups, facts = ";".join(whole.groups), (whole.n_a, whole.n_b, whole.n_groups)
                keys, times = np.array(row["keys"], np.int64), np.array(row["times"], np.int64)
                if whole.ok and whole.links:
                    keys = np.concatenate((keys, whole.links[0]))
                    times = np.concatenate((times, np.ones(len(whole.links[0]), np.int64)))
                if not whole.ok:
                    groups, facts, keys, times = "", (0, 0, 0), keys[:0], times[:0]
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                keys, back = np.unique(keys, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, back, times)
                yield _block_row(-1 - row["uid"], [row["id"]], np.array([[*facts, sums.sum()]]), [groups], np.zeros(len(keys), np.int64), keys, np.arange(len(keys)), sums)

    return run


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            unpack = lambda v: np.frombuffer(zlib.decompress(v), "<u4").astype(np.int64)
            slots, times = unpack(row["slots"]), unpack(row["times"])
            count = np.zeros(len(row["keys"]), np.int64)
            best = np.zeros(len(row["keys"]), bool)
            for found in row["reply"] or []:
                count[found["slot"]], best[found["slot"]] = found["total"], found["best"]
            stops = np.concatenate(([0], np.cumsum(row["sizes"]))).astype(np.int64)
            added = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[stops])
            facts = np.array(row["facts"], np.int64).reshape(-1, 4)
            columns = [row["ids"], *facts.T, added(times * best[slots]), added(times * count[slots])]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(row["groups"], pa.string())],
                names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
            )


def align_blocks(docs: DataFrame, path_a: str, path_b: str, digest: bool, id_col: str, text_col: str) -> DataFrame:
    """All texts aligned, in rows of a block of texts, written to the shared folder."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    short = rows.filter(F.octet_length("text") <= RANGE).select("id", "text").mapInArrow(released(_short_texts(path_a, path_b, digest)), _BLOCK)
    long = rows.filter(F.octet_length("text") > RANGE)
    parts = long.mapInArrow(_stretches, "uid long, id long, at long, part binary").repartition(F.col("uid"), F.col("at"))
    level = parts.mapInArrow(released(_fragments(path_a, path_b)), _FRAGMENT)
    for _ in range(ROUNDS):
        level = level.withColumn("over", F.floor(F.col("range") / FAN)).groupBy("uid", "over").applyInArrow(lambda table: _compose(table.drop_columns("over")), _FRAGMENT)
    whole = level.mapInArrow(_long_texts(digest), _BLOCK)
    return stage(short.unionByName(whole), "token-alignment")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How often each id of A and id of B are linked in all blocks, and whether no id of A has more links with that id of B."""
    each = aligned.select(F.explode(F.arrays_zip("keys", "totals")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.totals").alias("n"))
    total = each.groupBy("key").agg(F.sum("n").alias("total"))
    total = total.withColumn("a", F.shiftright("key", 32)).withColumn("b", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)))
    # an id of B has at most as many rows as A has ids
    return total.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    A blank and the text are tokenised by ``path_a`` (byte-level) as they are, the text by ``path_b`` (pieces), which puts the
    blank before it; strings of special tokens are plain text.  ``groups`` lists the groups in order as ``a1,a2|b1;a3|b2,b3``, or the sha256
    of that text where ``digest``.  A link's count is that of its pair of ids over all of ``docs``; n_best counts the links whose count is
    the highest of their id of B (ties included), count_sum adds the counts up.

    Texts that are null or empty, or whose tokens of either kind are other bytes, have no tokens: all zero, groups empty.  Rows that
    repeat count each by themselves, a null id stays null, an empty table gives an empty result; other columns are not read.  Both files
    have to be readable on all executors.  A document's groups have to fit into one cell.
    """
    aligned = align_blocks(docs, path_a, path_b, digest, id_col, text_col)
    counts = pair_counts(aligned).select("key", "total", "best")
    asked = aligned.select("block", F.posexplode("keys").alias("slot", "key"))
    reply = asked.join(counts, "key").groupBy("block").agg(F.collect_list(F.struct("slot", "total", "best")).alias("reply"))
    found = aligned.drop("totals").join(reply, "block", "left").mapInArrow(
        released(_results), "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    )
    return found.withColumnRenamed("id", id_col)

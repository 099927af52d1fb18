"""Fill-in-middle: texts cut into prefix, middle and suffix at two ranks, found in indexable skip lists.

The boundaries between the units of a text are the nodes of its skip list.  Every link of a lane carries two widths: how
many units it passes and how many code points.  A cut rank is reached from the top lane down by taking each link that does not pass it;
the code-point widths taken add up to where the text is to be cut, without a table of all offsets.  Lanes are built from
below, each from sums of the widths of the lane under it, with about every fourth node going up.  The lists of a block of texts lie
in flat arrays and all cuts of the block descend together.

Which ranks are cut, and which form a text takes, follow from a hash of its id, so a rerun of a lost task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from symloom.llm.blocks import U64, blocks, mix, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")
#: every node goes to the next lane with a chance of one in four
_UP = U64(3)
_STEP = 1 << 20


class SkipLists:
    """The skip lists of many texts, given the code points of each unit and the units of each text."""

    def __init__(self, widths: np.ndarray, counts: np.ndarray):
        nodes = counts + 1
        ends = np.cumsum(nodes)
        begins = ends - nodes
        total = int(ends[-1]) if len(ends) else 0
        points = np.broadcast_to(np.int8(1), total) if widths is None else np.insert(widths, np.cumsum(counts), 0)
        units = np.broadcast_to(np.int8(1), total)
        #: per lane: unit widths, code-point widths, where each node stands in the lane below, first and last node of each text
        self.lanes = [(units, points, None, begins, ends)]
        salt = 1
        while total and (ends - begins).max() > 4:
            up = np.empty(total, bool)
            for at in range(0, total, _STEP):
                own = np.arange(at, min(at + _STEP, total), dtype=U64)
                up[at : at + _STEP] = mix(own + U64(salt << 40)) & _UP == 0
            up[begins] = True
            down = np.flatnonzero(up)
            sums = [np.add.reduceat(w, down, dtype=np.int64) for w in (units, points)]
            units, points = sums
            begins = np.searchsorted(down, begins)
            ends = np.append(begins[1:], len(down))
            total = len(down)
            self.lanes.append((units, points, down, begins, ends))
            salt += 1

    def points_before(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points in the first ``rank`` units of each asked text."""
        at = self.lanes[-1][3][text].copy()
        passed, points = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for units, widths, down, _, ends in reversed(self.lanes):
            moving = np.arange(len(text))
            while len(moving):
                moving = moving[at[moving] + 1 < ends[text[moving]]]
                moving = moving[passed[moving] + units[at[moving]] <= rank[moving]]
                passed[moving] += units[at[moving]]
                points[moving] += widths[at[moving]]
                at[moving] += 1
            if down is not None:
                at = down[at]
        return points


def unit_widths(texts: list[str], unit: str) -> tuple[np.ndarray | None, np.ndarray]:
    """Code points of each unit of all texts (None where all are one) and the units of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if unit == "char":
        return None, sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    opens = np.zeros(len(codes) + 1, bool)
    opens[1:-1] = space[:-1] & ~space[1:] if unit == "word" else codes[:-1] == 10
    starts = np.cumsum(sizes) - sizes
    opens[starts[sizes > 0]] = True
    opens = opens[:-1]
    first = np.flatnonzero(opens)
    owner = np.searchsorted(np.cumsum(sizes), first, "right")
    return np.diff(np.append(first, len(codes))), np.bincount(owner, minlength=len(texts)).astype(np.int64)


_RESULT = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]


def _cutter(unit: str, marks: tuple[str, str, str], plain_percent: int, spm_percent: int):
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = text_bytes(batch.column("text"))
            hashes = [np.asarray(batch.column(f"h{k}"), np.int64) for k in (1, 2, 3, 4)]
            for row, after, raw, starts in blocks(data, ends):
                body = raw.tobytes()
                texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                h1, h2, h3, h4 = (h[row:after] for h in hashes)
                widths, counts = unit_widths(texts, unit)
                lists = SkipLists(widths, counts)
                one, two = h1 % (counts + 1), h2 % (counts + 1)
                number = np.arange(len(texts))
                begin = lists.points_before(number, np.minimum(one, two)).tolist()
                close = lists.points_before(number, np.maximum(one, two)).tolist()
                spm, plain = (h4 % 100 < spm_percent).tolist(), (h3 % 100 >= 100 - plain_percent).tolist()
                forms, out, before, inside = [], [], [], []
                for k, text in enumerate(texts):
                    if plain[k] or not text or p in text or s in text or m in text:
                        forms.append("plain")
                        out.append(text)
                        before.append(None)
                        inside.append(None)
                        continue
                    a, b = begin[k], close[k]
                    forms.append("spm" if spm[k] else "psm")
                    out.append(f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}" if spm[k] else f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}")
                    before.append(a)
                    inside.append(b - a)
                columns = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(row, after - row), *columns], names=["row", *(f.name for f in _RESULT)])

    return run


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks that cannot be mistaken: none empty, none inside another, no end of one that begins one."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            overlap = any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j)))
            if not a or (i != j and a in b) or overlap:
                raise ValueError("marks are three different strings that do not overlap")


def fill_in_middle(
    docs: DataFrame,
    unit: str = "char",
    seed: str = "1:",
    plain_percent: int = 10,
    spm_percent: int = 20,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, n (units of the text), form, prefix_chars, middle_chars (code points) and output.

    Units are code points (``char``), words with the white space after them (``word``; white space that opens a
    text is a unit) or lines with their ends (``line``).  Of the sha256 of ``seed`` and the id, the first two groups of eight digits
    give the cut ranks, the third makes ``plain_percent`` of the texts plain, and the fourth gives ``spm_percent`` of the others the form
    that begins with the suffix.  ``psm`` is prefix, suffix, middle, each after its mark.  A text that is null, empty or holds a mark
    is plain: its output is the text itself (null: empty) and its cuts are null.  A null id counts as an empty string.  Rows
    that repeat give equal rows, an empty table an empty result; other columns are not read.  Nothing is shuffled.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    _checked(marks)
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    group = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.struct(F.col(f"`{id_col}`").alias("id")).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), *group)
    schema = StructType([StructField("row", rows.schema["row"].dataType), *_RESULT])
    found = rows.mapInArrow(_cutter(unit, marks, plain_percent, spm_percent), schema)
    return found.select(F.col("row.id").alias(id_col), *[f.name for f in _RESULT])


def restored(output: str | Column = "output", form: str | Column = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output of this form was made of; null where either is null."""
    _checked(marks)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (F.lit(x) for x in marks)
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    # psm: P prefix S suffix M middle; spm: S suffix P prefix M middle
    psm = F.concat(part(part(output, s, 1), p, 2), part(output, m, 2), part(part(output, s, 2), m, 1))
    spm = F.concat(part(part(output, p, 2), m, 1), part(output, m, 2), part(part(output, p, 1), s, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)

"""Text of code units: escaping, lines, occurrences, content sniffing.

Offsets count code points from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\\r\\n|\\n|\\r"

# Image signatures (hex) and the sniffing rule for binary content.
IMAGE_SIGNATURES = {
    "png": "89504E470D0A1A0A",
    "jpeg": "FFD8FF",
    "gif": "47494638",
    "bmp": "424D",
}
RIFF, WEBP = "52494646", "57454250"
CONTROL_SHARE = 20


def trim_text(s: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(s, "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", "")


def quote(literal: str) -> str:
    """A pattern that matches the literal and nothing else."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def pattern_of(query: str, ignore_case: bool, regex: bool) -> str:
    body = query if regex else quote(query)
    return ("(?iu)" if ignore_case and not regex else "(?i)" if ignore_case else "") + body


def _numeric_refs(s: Column, codes: list[int]) -> Column:
    for code in codes:
        s = F.replace(s, F.lit(chr(code)), F.lit(f"&#{code};"))
    return s


def _markup(s: Column) -> Column:
    s = F.replace(s, F.lit("&"), F.lit("&amp;"))
    s = F.replace(s, F.lit("<"), F.lit("&lt;"))
    return F.replace(s, F.lit(">"), F.lit("&gt;"))


_PLAIN_BREAKS = (9, 10, 13)


def escape_text(s: Column) -> Column:
    """Markup characters become entities, control characters numeric references."""
    controls = [c for c in range(32) if c not in _PLAIN_BREAKS]
    clean = _numeric_refs(_markup(s), controls)
    # nearly all text has no control character: test once instead of replacing 29 times
    return F.when(s.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), clean).otherwise(_markup(s))


def escape_attr(s: Column) -> Column:
    """As escape_text, and quotes and line breaks as well."""
    quoted = F.replace(escape_text(s), F.lit('"'), F.lit("&quot;"))
    return _numeric_refs(quoted, [10, 13, 9])


def line_of(code: Column, off: Column) -> Column:
    """1 + the line feeds strictly before the offset."""
    head = F.substring(code, F.lit(1), off.cast("int"))
    return (1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("int")


def occurrences(code: Column, needle: str | Column) -> Column:
    """How often the needle starts anywhere in the text, overlaps included."""
    if isinstance(needle, str):
        pattern = F.lit(f"(?={quote(needle)})")
    else:
        safe = F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        pattern = F.concat(F.lit("(?=\\Q"), safe, F.lit("\\E)"))
    return F.regexp_count(code, pattern)


def classify_content(content: Column, sniff_bytes: int | None = None) -> Column:
    """image, text or hex from leading bytes and the share of control characters.

    The share is that of the whole content; ``sniff_bytes`` asks for that of so many leading bytes.
    """
    head = F.hex(F.substring(content, 1, 12))
    image = F.lit(False)
    for signature in IMAGE_SIGNATURES.values():
        image = image | head.startswith(signature)
    image = image | (head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP))
    start = content if sniff_bytes is None else F.substring(content, 1, sniff_bytes)
    chars = F.decode(start, "ISO-8859-1")
    odd = F.length(chars) - F.length(
        F.regexp_replace(chars, "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    )
    textual = (F.length(content) == 0) | (
        ~F.contains(chars, F.lit("\x00")) & (odd * CONTROL_SHARE < F.length(start))
    )
    return F.when(image, "image").when(textual, "text").otherwise("hex")


def ancestors(path: Column, separator: str) -> Column:
    """Every prefix of a separated path, shortest first, the path itself last."""
    parts = F.split(path, quote(separator))
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator),
    )


def running_sums(sizes: Column) -> Column:
    """Of an array of whole numbers, the sums up to and with each of its items, in the task that holds the array."""

    def summed(arrays):
        import numpy as np
        import pyarrow as pa

        lengths = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        upto = np.concatenate([[0], np.cumsum(arrays.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        sums = upto[1:] - np.repeat(upto[ends[:-1]], lengths)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums, pa.int64()), mask=arrays.is_null())

    return F.arrow_udf(summed, "array<bigint>")(sizes.cast("array<bigint>"))

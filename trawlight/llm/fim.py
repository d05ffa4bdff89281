"""Fill-in-middle examples: a middle span of each text is moved to the end, behind markers.

Texts stay UTF-8 bytes. A batch has one sparse exception index: the places of its multibyte
characters and the bytes that they take beyond one each. Between two exceptions a code point is a
byte, so a cut given in code points becomes a cut in bytes, and the other way round, by one
``searchsorted`` into that list and an addition; a text of ASCII characters has no entry at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlight.llm.common import doc_text

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKERS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
_BLOCK_BYTES = 8 << 20

UNITS = ("line", "char")


@dataclass(frozen=True)
class ExceptionIndex:
    """The multibyte characters of a run of UTF-8 bytes: where they stand and what they add up to.

    ``at_byte`` and ``at_char`` are the places of their first bytes, counted in bytes and in code
    points; ``excess`` has one more entry and holds the extra bytes of all exceptions before each.
    """

    at_byte: np.ndarray
    at_char: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> ExceptionIndex:
        """The index of UTF-8 ``data``; only lead bytes of two, three and four bytes are exceptions."""
        at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[at_byte]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.concatenate([[0], np.cumsum(extra)])
        return cls(at_byte, at_byte - excess[:-1], excess)

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Code points before each cut; cuts are byte offsets between characters."""
        return cuts - self.excess[np.searchsorted(self.at_byte, cuts, side="left")]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before each cut; cuts are counted in code points."""
        return cuts + self.excess[np.searchsorted(self.at_char, cuts, side="left")]


def _line_ends(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lines of all texts as byte offsets, and where each text's ends begin.

    A line ends after its newline, the last one at the latest with its text.
    """
    breaks = np.flatnonzero(data == 0x0A) + 1
    starts, ends = bounds[:-1], bounds[1:]
    closed = np.zeros(len(starts), bool)
    filled = ends > starts
    closed[filled] = data[ends[filled] - 1] == 0x0A
    own = np.searchsorted(breaks, ends, side="right") - np.searchsorted(breaks, starts, side="right")
    counts = own + (filled & ~closed)
    first = np.concatenate([[0], np.cumsum(counts)])
    lines = np.empty(first[-1], np.int64)
    open_ended = np.flatnonzero(filled & ~closed)
    last = np.zeros(len(lines), bool)
    last[first[open_ended + 1] - 1] = True
    lines[last] = ends[open_ended]
    lines[~last] = breaks
    return lines, first


def _block(texts: pa.Array, low: np.ndarray, high: np.ndarray, unit: str):
    """``(units, prefix end, middle end)`` in code points and, for the two ends, in bytes.

    ``low`` and ``high`` are draws that are taken modulo the number of units plus one.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    index = ExceptionIndex.of(data)
    starts, chars = bounds[:-1], index.chars(bounds)
    if unit == "line":
        lines, first = _line_ends(data, bounds)
        units = np.diff(first)
    else:
        units = np.diff(chars)
    one, two = low % (units + 1), high % (units + 1)
    cuts = []
    for cut in (np.minimum(one, two), np.maximum(one, two)):
        if unit == "line":
            at = np.where(cut > 0, lines[first[:-1] + cut - 1], starts) if len(lines) else starts
        else:
            at = index.bytes(chars[:-1] + cut)
        cuts.append(at)
    return units, [index.chars(at) - chars[:-1] for at in cuts], [at - starts for at in cuts]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the SHA-256 of ``seed:doc_id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7
) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    Each whole text is cut into ``n`` units, lines with their newline or code points. Two draws from
    the hash of seed and ``doc_id`` give the ends of prefix and middle. ``rate`` in a hundred texts are
    rewritten: ``spm`` in a hundred of these with the suffix first, the others with the prefix first. The rest, empty texts and
    texts that hold a marker stay ``plain``: ``output`` is the text and the numbers of code points are null.

    A null text is empty; rows with equal ``doc_id`` are cut by the same draws, null ids like one id
    ``null``. Texts are never shortened: one longer than a block of some megabytes is a block of its own. Other
    columns play no part, whatever their names. An empty table stays empty. No row is moved.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    rows = doc_text(docs)
    drawn = rows.select("doc_id", "text", *[draw.alias(f"h{i}") for i, draw in enumerate(_draws(F.col("doc_id"), seed), 1)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            draws = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            first = 0
            while first < len(texts):
                limit = (ends[first - 1] if first else 0) + _BLOCK_BYTES
                last = max(first + 1, int(np.searchsorted(ends, limit, side="right")))
                span = slice(first, last)
                yield one_block(batch.column(0)[first:last], texts[first:last], [draw[span] for draw in draws])
                first = last

    def one_block(doc_ids: pa.Array, texts: pa.Array, draws: list[np.ndarray]) -> pa.RecordBatch:
        units, chars, cuts = _block(texts, draws[0], draws[1], unit)
        marked = pc.match_substring_regex(texts, _MARKERS).to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        plain = empty | marked | (draws[2] % 100 >= rate)
        suffix_first = draws[3] % 100 < spm
        outputs = []
        for i, text in enumerate(texts):
            whole = text.as_buffer().to_pybytes()
            if not plain[i]:
                a, b = cuts[0][i], cuts[1][i]
                before, middle, after = whole[:a], whole[a:b], whole[b:]
                head = (
                    (SUFFIX.encode(), after, PREFIX.encode(), before)
                    if suffix_first[i]
                    else (PREFIX.encode(), before, SUFFIX.encode(), after)
                )
                whole = b"".join((*head, MIDDLE.encode(), middle))
            outputs.append(whole)
        form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
        return pa.RecordBatch.from_arrays(
            [
                doc_ids.cast(pa.int64()),
                pa.array(units, pa.int64()),
                pa.array(form.tolist(), pa.string()),
                pa.array(chars[0], pa.int64(), mask=plain),
                pa.array(chars[1] - chars[0], pa.int64(), mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return drawn.mapInArrow(rewrite, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, _MARKERS, -1)
    before, after = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(before, parts[3], after))

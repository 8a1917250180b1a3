"""Fill-in-the-middle: a text is cut in three, and the middle goes to the end behind sentinels.

A text is seen as UTF-8 blocks of a fixed size. A Fenwick tree over the blocks
holds how many units start in each and how many code points; a descent by powers
of two finds the block of a cut, and only that block is searched for the boundary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM = 90  # of 100: from here on a document stays as it is
SPM_BELOW = 20  # of 100: below, the suffix comes first
UNITS = ("code_point", "word")
_SPACES = np.zeros(256, bool)
_SPACES[list(b" \t\n\v\f\r")] = True


def _code_points(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _words(data: np.ndarray) -> np.ndarray:
    """A unit is a word with the white space behind it; white space at the start of a text belongs to the first."""
    space = _SPACES[data]
    first = np.zeros(len(data), bool)
    first[1:] = space[:-1] & ~space[1:]
    if len(data):
        lead = int(np.argmin(space)) if not space.all() else 0
        first[:lead + 1] = False
        first[0] = True
    return first


class Blocks:
    """Unit and code-point counts of the blocks of one text, as a Fenwick tree."""

    def __init__(self, text: bytes, unit: str = "code_point", block: int = BLOCK) -> None:
        self.size, self.block = len(text), block
        data = np.frombuffer(text, np.uint8)
        points = _code_points(data)
        self.starts = points if unit == "code_point" else _words(data)
        self.points = points
        edges = np.arange(0, self.size, block)
        counts = [np.add.reduceat(marks, edges, dtype=np.int64).tolist() if self.size else [] for marks in (self.starts, points)]
        self.n, self.chars = sum(counts[0]), sum(counts[1])
        self.tree = [[0, *c] for c in counts]
        for at in range(1, len(edges) + 1):
            above = at + (at & -at)
            if above <= len(edges):
                for tree in self.tree:
                    tree[above] += tree[at]

    def cut(self, units: int) -> tuple[int, int]:
        """(bytes, code points) before the boundary behind the first ``units`` units."""
        if units >= self.n:
            return self.size, self.chars
        by_unit, by_point = self.tree
        at = left = chars = 0
        step = 1 << (len(by_unit) - 1).bit_length()
        while step:  # as many whole blocks as hold no more than ``units`` starts
            ahead = at + step
            if ahead < len(by_unit) and left + by_unit[ahead] <= units:
                at, left, chars = ahead, left + by_unit[ahead], chars + by_point[ahead]
            step >>= 1
        begin = at * self.block
        inside = int(np.flatnonzero(self.starts[begin:begin + self.block])[units - left])
        return begin + inside, chars + int(np.count_nonzero(self.points[begin:begin + inside]))


def arranged(doc_id, text: bytes, seed: int = 1, unit: str = "code_point", block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix and middle in code points, output) of one text."""
    key = hashlib.sha256(b"%d:%s" % (seed, b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    h = [int(key[8 * k:8 * k + 8], 16) for k in range(4)]
    blocks = Blocks(text, unit, block)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= PLAIN_FROM:
        return blocks.n, "plain", None, None, text
    (a, a_chars), (b, b_chars) = (blocks.cut(k) for k in sorted(x % (blocks.n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < SPM_BELOW:
        return blocks.n, "spm", a_chars, b_chars - a_chars, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return blocks.n, "psm", a_chars, b_chars - a_chars, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   unit: str = "code_point", block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the units of the whole text, code points or words. The hash of
    ``seed`` and id chooses both cuts among the n + 1 boundaries, and the form:
    ``psm`` is prefix, suffix, middle behind their sentinels, ``spm`` has the suffix
    first, ``plain`` is the text itself, for a text that is empty or holds a
    sentinel and for a tenth of all others. The parts are given in code points, null
    for plain ones; each may be empty.

    A null text counts as empty, and a null id as an id without digits. Rows alike
    in id and text tie and get equal results; texts of any length are cut whole, in
    the task that reads them. An empty table gives no rows; other columns are
    ignored.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done = [arranged(i, t, seed, unit, block) for i, t in zip(ids, texts)]
            columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(
                (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns],
                                             names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = rows.mapInArrow(cut, f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text behind an output: a text that was cut holds no sentinel, so each stands in the output once."""
    parts = F.split(F.col(output), "|".join(s.decode() for s in (PREFIX, SUFFIX, MIDDLE)), -1)

    def joined(*order: int) -> Column:
        return F.concat(*[F.get(parts, F.lit(k)) for k in order])

    return F.when(F.col(form) == "psm", joined(1, 3, 2)).when(F.col(form) == "spm", joined(2, 3, 1)).otherwise(F.col(output))

"""Best-two-fit packing of tokenised documents into sequences of one size.

Pieces of one length are alike for packing, so the plan is made from how many
pieces each length has: at most ``size`` counters, whatever the corpus holds.
Spark counts them, numbers the pieces of each length and looks up their places.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.worker_table import worker_table
from tallymark.session import materialize

SIZE = 2048
END = 0  # the id after each document
ROWS_IN_BUCKET = 100_000
_WORDS_KEPT = 800_000
_LATIN = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")
_STEM_AND_TAIL = re.compile(rb"([a-z0-9]+)([-.,!?;:%$#&*]+)")


# The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
_ALPHABET = {byte: 256 + n for n, byte in enumerate(
    byte for byte in range(256) if not (0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or 0xAE <= byte <= 0xFF))}


class _WordIds(dict):
    """Word in UTF-8, ASCII letters in lower case, -> number; its ids lie in ``flat`` from ``start`` on.

    The tokenizer drops white space and lowers letters, and no token of it spans
    white space or a letter and a sign after it, so a text's ids are those of its
    parts in order. When it is full, the words that were seen least often go.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.path = path
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()}) if special else []
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in added)) if added else None
        self.tokenizer.encode_special_tokens = True  # the words of other texts hold none of their strings
        self.model = self.tokenizer.model
        (self.bar,) = self._encoded(["|"])[0]
        self.flat = np.empty(0, np.uint32)
        self.start, self.length, self.seen = np.zeros((3, 0), np.int64)

    @cached_property
    def untouched(self):
        """The tokenizer as it is loaded, for texts that hold an added token; most workers meet none."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self, room: int) -> None:
        least = 2
        while np.count_nonzero(self.seen >= least) > max(0, _WORDS_KEPT // 2 - room):
            least *= 2
        kept = self.seen >= least
        words = list(compress(self, kept))  # a word stands in the dictionary at its number
        start, length, counts = self.start[kept], self.length[kept], self.seen[kept]
        ends = np.cumsum(length)
        flat = self.flat[np.repeat(start - (ends - length), length) + np.arange(length.sum())]
        self.clear()
        self.flat, self.start, self.length, self.seen = flat, ends - length, length, counts
        self.update(zip(words, range(len(words))))

    def _enter(self, words: list[bytes], ids: list, counts: np.ndarray) -> None:
        first = len(self)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.seen = np.concatenate([self.seen, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
        self.update(zip(words, range(first, first + len(words))))

    def _ids(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of words: letter by letter from the model where a word is small Latin letters, else as the tokenizer has it."""
        out, other = {}, []
        for word in words:
            if _LATIN.fullmatch(text := word.decode()):
                spelt = text if text.isascii() else word.decode("latin-1").translate(_ALPHABET)
                out[word] = [token.id for token in self.model.tokenize(spelt)]
            else:
                other.append(word)
        barred = [w for w in other if b"|" in w]
        plain = [w for w in other if b"|" not in w]
        out.update(zip(barred, self._encoded([w.decode() for w in barred])))
        if plain:  # one text with bars between the words costs less than many small ones
            ids = np.array(self._encoded([" | ".join(w.decode() for w in plain)])[0], np.int64)
            cuts = np.flatnonzero(ids == self.bar)
            for w, a, b in zip(plain, [0, *(cuts + 1)], [*cuts, len(ids)], strict=True):
                out[w] = ids[a:b].tolist()
        return out

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + 2 * len(new) > _WORDS_KEPT and self:
            self._forget(2 * len(new))
            new = [w for w in words if w not in self]
        split = {w: m.groups() for w in new if (m := _STEM_AND_TAIL.fullmatch(w))}
        parts = {part for pair in split.values() for part in pair if part not in self}
        ids = self._ids([*parts, *(w for w in new if w not in split and w not in parts)])

        def part_ids(part: bytes):
            return ids[part] if part in ids else self.flat[self.start[n := self[part]]:self.start[n] + self.length[n]].tolist()

        ids.update([(w, part_ids(stem) + part_ids(tail)) for w, (stem, tail) in split.items()])
        self._enter(list(ids), list(ids.values()), np.zeros(len(ids), np.int64))

    def documents(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text in UTF-8. One that holds an added token goes whole through the tokenizer as it was loaded."""
        whole = [self.added is not None and self.added.search(t) is not None for t in texts]
        out = iter(self.encoded([t.lower().split() for t, w in zip(texts, whole) if not w]) if not all(whole) else [])
        return [np.array(self.untouched.encode(t.decode(), add_special_tokens=False).ids, np.uint32) if w else next(out)
                for t, w in zip(texts, whole)]

    def encoded(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The ids of each text, given as words, in one array for all of them."""
        self.learn(set(chain.from_iterable(texts)))
        n_words = np.fromiter(map(len, texts), np.int64, len(texts))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(n_words.sum()))
        self.seen += np.bincount(numbers, minlength=len(self.seen))
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.start[numbers] - (ends - lengths), lengths)
        flat = self.flat[shift + np.arange(len(shift))]
        cuts = np.concatenate([[0], ends])[np.cumsum(n_words)]
        return np.split(flat, cuts[:-1])


def _table(path: str, special: bool) -> _WordIds:
    """The words of a worker process, which outlives its tasks: the file is loaded and a word is met once for all of them."""
    return worker_table(_WordIds, path, special)


def _pieces(tokenizer: str, size: int, with_ids: bool, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(tokenizer, special)
        for batch in batches:
            docs, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for at, own in enumerate(known.documents(texts)):
                own = np.append(own, np.uint32(END)).astype("<u4")
                for k, start in enumerate(range(0, len(own), size)):
                    part = own[start:start + size]
                    docs.append(at)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(len(part))
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = {"doc_id": batch.column("doc_id").take(pa.array(docs, pa.int64())), "piece": pa.array(pieces, pa.int32()),
                       "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()),
                       "ids_crc32": pa.array(crcs, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)
    return run


def tokenised(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False,
              id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of at most ``size`` ids. ``special`` as in ``best_fit``."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return texts.mapInArrow(_pieces(tokenizer, size, with_ids, special), schema + (", ids array<long>" if with_ids else ""))


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how often), from ``counts`` by length.

    A bin starts with the largest length left and is filled greedily with the
    largest that fits. Then its smallest document gives way to two others, if two
    unpacked ones fill the gap that it leaves more tightly. The bin is repeated as
    long as the counts allow, which uses up a length each time.
    """
    left, bins = counts.astype(np.int64).copy(), []
    while (lengths := np.flatnonzero(left)).size:
        used = np.zeros(size + 1, np.int64)
        gap = size
        while gap and (fits := lengths[:np.searchsorted(lengths, gap, "right")]).size:
            fits = fits[left[fits] > used[fits]]
            if not fits.size:
                break
            take = int(fits[-1])
            n = 1 if gap == size else min(gap // take, left[take] - used[take])
            used[take] += n
            gap -= take * n
        smallest = int(np.flatnonzero(used)[0])
        if gap and used.sum() > 1:
            wide = gap + smallest
            free = left - used
            some = np.flatnonzero(free[:wide])
            if some.size:
                other = np.searchsorted(some, np.minimum(some, wide - some), "right") - 1
                other -= (other >= 0) & (some[other] == some) & (free[some] < 2)
                sums = np.where(other >= 0, some + some[other], 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    used[smallest] -= 1
                    used[some[best]] += 1
                    used[some[other[best]]] += 1
        held = np.flatnonzero(used)
        times = int((left[held] // used[held]).min())
        left[held] -= used[held] * times
        bins.append((np.repeat(held, used[held])[::-1].tolist(), times))
    return bins


def _places(bins: list[tuple[list[int], int]], size: int) -> dict[str, np.ndarray]:
    """Per length and first rank: the first sequence and the offset. Later ranks of a slot go to later sequences."""
    slots, ranks, first = [], np.zeros(size + 1, np.int64), 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            slots.append((length, ranks[length], first, offset))
            ranks[length] += times
            offset += length
        first += times
    table = np.array(sorted(slots) or np.empty((0, 4)), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(table["key"], (length << 48) + rank, "right") - 1
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(table["sequence"][at] + rank - table["rank"][at]),
                 pa.array(table["offset"][at])], names=[*kept, "sequence_id", "offset"])
    return run


def pack(pieces: DataFrame, size: int = SIZE, rows_in_bucket: int = ROWS_IN_BUCKET) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each lies; sequences are gapless from 0.

    ``pieces`` needs a column ``length`` from 1 to ``size``; others pass through,
    but ``rank``, ``sequence_id`` and ``offset`` are the operator's own. Pieces of
    one length tie, and any of them may take any place; repeated rows are pieces
    of their own. No rows give no rows.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("rank", "sequence_id", "offset")
    rows = materialize(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    buckets = -(-rows.count() // rows_in_bucket) or 1
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__row"), F.lit(buckets)))
    counts = materialize(rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n")), "counts")
    histogram = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("__n")).toLocalIterator():
        histogram[length] = n
    places = spark.sparkContext.broadcast(_places(plan(histogram, size), size))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")),
                         "starts")
    own = Window.partitionBy("length", "__bucket").orderBy("__row")
    numbered = rows.withColumn("__own", F.row_number().over(own) - 1).join(starts, ["length", "__bucket"])
    numbered = numbered.select(*pieces.columns, (F.col("__start") + F.col("__own")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(_placed(places), schema + ", sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, size: int = SIZE, with_ids: bool = False,
             id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """All documents as token pieces, packed into as few sequences as the method finds.

    A document is its ids and then id 0; only one longer than ``size`` is cut. A
    null or empty text, or one without a token, is the single id 0. A null id is
    kept. Repeated rows are documents of their own; other columns are ignored. With
    ``special`` the strings of the file's added tokens stand for those tokens, as in
    the tokenizer as it is loaded; else they are ordinary text.
    """
    return pack(tokenised(docs, tokenizer, size, with_ids, id_col, text_col, special), size)

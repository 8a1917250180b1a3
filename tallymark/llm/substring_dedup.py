"""Repeated byte strings, found by suffix arrays over shards.

Every string of 200 bytes chooses an anchor, the 64-byte gram in it with the
smallest hash (the last of equal ones). Equal strings choose equal anchors, so a
string can only repeat if its anchor does, and only the surroundings of repeated
anchors are looked at: the context of an anchor is all strings of 200 bytes that
chose it, side by side. Equal contexts are one context with a count.

Contexts go to shards by anchor, so equal strings meet. Each shard sorts its
suffixes and reads the repeats off the common prefixes of neighbours. An anchor
with more context than a shard holds is dealt over several; their sorted distinct
strings are then merged by binary search, in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.suffix_array import common_prefixes, suffix_array
from tallymark.session import materialize, release

LENGTH = 200
GRAM = 64
SHARD_BYTES = 2 << 20
FAN = 64  # runs merged in one task
_BLOCK_BITS = 20
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_SPANS = "array<struct<start:int,end:int>>"


def _combined(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every run of ``width`` values, by doubling; ``join(left, right, step)``."""
    n, step = 1, 0
    while 2 * n <= width:
        values = join(values[:-n], values[n:], step)
        n, step = 2 * n, step + 1
    return join(values[:-(width - n)], values[width - n:], step) if width > n else values


def _hashes(text: np.ndarray, width: int) -> np.ndarray:
    def join(left, right, step):
        return left * _FACTOR[step] + (right ^ (right >> np.uint64(29)))

    h = _combined(_BYTE[text], width, join)
    return (h ^ (h >> np.uint64(31))) * _FACTOR[-1]


def _block_anchors(text: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Per string start of the block: the hash and the place of its anchor."""
    low = np.uint64((1 << _BLOCK_BITS) - 1)
    h = _hashes(text, gram)
    keyed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last is smallest
    least = _combined(keyed, length - gram + 1, lambda left, right, _: np.minimum(left, right))
    place = (low - (least & low)).astype(np.int64)
    return h[place].view(np.int64), place


def anchors(texts: list[bytes], gram: int = GRAM, length: int = LENGTH):
    """(text number, start, end, anchor): the contexts of all anchors, in blocks that bound the memory."""
    most = 1 << _BLOCK_BITS
    waiting: list[tuple[int, int, bytes]] = []
    held = 0

    def contexts(parts):
        block = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        if len(block) < length:
            return
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        part = np.repeat(np.arange(len(parts)), sizes)[:len(block) - length + 1]
        start = np.arange(len(part))
        anchor, place = _block_anchors(block, gram, length)
        inside = start + length <= ends[part]
        part, start, anchor, place = part[inside], start[inside], anchor[inside], place[inside]
        if not len(part):
            return
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
        last = np.append(first[1:], len(part)) - 1
        number = np.array([n for n, _, _ in parts])[part[first]]
        shift = np.array([at for _, at, _ in parts])[part[first]] - (ends - sizes)[part[first]]
        yield number, start[first] + shift, start[last] + shift + length, anchor[first]

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), most - length + 1):
            piece = text[at:at + most]
            if held + len(piece) > most:
                yield from contexts(waiting)
                waiting, held = [], 0
            waiting.append((number, at, piece))
            held += len(piece)
    yield from contexts(waiting)


def _find_anchors(batches: Iterator[pa.RecordBatch], gram: int, length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for number, start, end, anchor in anchors(texts, gram, length):
            rows = pa.array(number)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(rows), batch.column("text_hash").take(rows), pa.array(anchor),
                 pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
                names=["doc", "text_hash", "anchor", "start", "end"])


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per context; its bytes come with the first of equal ones in the task."""
    seen: set[bytes] = set()
    for batch in batches:
        places = batch.column("places")
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        flat = places.flatten()
        start, end = (flat.field(name).to_numpy() for name in ("start", "end"))
        number = np.repeat(np.arange(len(texts)), places.value_lengths().to_numpy())
        ids, found = [], []
        for k, a, b in zip(number.tolist(), start.tolist(), end.tolist()):
            context = texts[k][a:b]
            ids.append(own := xxhash.xxh3_128_digest(context))
            found.append(None if own in seen else context)
            if len(seen) > 500_000:
                seen.clear()
            seen.add(own)
        rows = pa.array(number)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(rows), batch.column("text_hash").take(rows), flat.field("anchor"), flat.field("start"),
             pa.array(ids, pa.binary()), pa.array(found, pa.binary())],
            names=["doc", "text_hash", "anchor", "start", "context_id", "context"])


def _shard_windows(contexts: list[bytes], counts: np.ndarray, length: int):
    """Of a shard: per string start whether it is one, its context and offset; the group of equal strings and their number."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    which = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = offset + length <= sizes[which]
    order = suffix_array(text)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common_prefixes(text, order) < length)
    times = np.bincount(group, weights=np.where(whole, counts[which], 0))[group]
    return whole, which, offset, group, times


def _runs(flags: np.ndarray, which: np.ndarray, offset: np.ndarray, ids: list[bytes], length: int) -> pa.RecordBatch:
    """Flagged string starts as covered spans by context."""
    at = np.flatnonzero(flags)
    first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(which[at]) != 0)]) if len(at) else np.empty(0, bool)
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    owner = which[at[begin]]
    return pa.RecordBatch.from_arrays(
        [pa.array([ids[k] for k in owner.tolist()], pa.binary()), pa.array(offset[at[begin]].astype(np.int32)),
         pa.array((offset[at[last]] + length).astype(np.int32))], names=["context_id", "start", "end"]) if len(at) else _NO_SPANS


_NO_SPANS = pa.RecordBatch.from_arrays(
    [pa.array([], pa.binary()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["context_id", "start", "end"])


def _search_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("context_id").to_pylist()
        counts = table.column("n").to_numpy()
        whole, which, offset, _, times = _shard_windows(table.column("context").to_pylist(), counts, length)
        return pa.Table.from_batches([_runs(whole & (times > 1), which, offset, ids, length)])
    return run


def _shard_run(length: int):
    """Of a shard of a divided anchor: the spans that repeat in it, and a row per distinct string, with its place if there is only one."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("context_id").to_pylist()
        contexts = table.column("context").to_pylist()
        whole, which, offset, group, times = _shard_windows(contexts, table.column("n").to_numpy(), length)
        at = np.flatnonzero(whole)
        heads = at[np.unique(group[at], return_index=True)[1]]
        strings = [xxhash.xxh3_128_hexdigest(contexts[which[k]][offset[k]:offset[k] + length]) for k in heads.tolist()]
        single = times[heads] == 1
        return pa.concat_tables([
            _span_rows(pa.Table.from_batches([_runs(whole & (times > 1), which, offset, ids, length)])),
            _string_rows(table.column("run")[0].as_py(), pa.array(strings, pa.string()),
                         pa.array([ids[k] for k in which[heads].tolist()], pa.binary(), mask=~single),
                         pa.array(offset[heads].astype(np.int32), mask=~single))])
    return run


_RUN_ROWS = "run long, string string, context_id binary, start int, end int"


def _span_rows(spans: pa.Table) -> pa.Table:
    nothing = [pa.nulls(spans.num_rows, kind) for kind in (pa.int64(), pa.string())]
    return pa.table([*nothing, spans["context_id"], spans["start"], spans["end"]], names=["run", "string", "context_id", "start", "end"])


def _string_rows(run: int, strings, context_id, start) -> pa.Table:
    n = len(strings)
    return pa.table([pa.array(np.full(n, run, np.int64)), strings, context_id, start, pa.nulls(n, pa.int32())],
                    names=["run", "string", "context_id", "start", "end"])


def _merged(left, right, single: np.ndarray):
    """Two sorted runs (strings, their rows) as one, and the rows of single places whose string is in both."""
    (a, rows_a), (b, rows_b) = left, right
    at = np.searchsorted(a, b)
    there = np.minimum(at, len(a) - 1)
    both = a[there] == b
    met = np.concatenate([rows_a[there[both]], rows_b[both]])
    found = met[single[met]]
    single[met] = False
    new = ~both
    return (np.insert(a, at[new], b[new]), np.insert(rows_a, at[new], rows_b[new])), found


def _merge_runs(length: int, fan: int, last: bool):
    """Merges the sorted runs of a group two by two; a string repeats if binary search finds it in another run."""
    def run(table: pa.Table) -> pa.Table:
        number = table.column("run").to_numpy()
        keys = np.array(table.column("string").to_pylist(), "S32")  # hexadecimal, so no byte is lost
        single = np.array(table.column("context_id").is_valid())
        order = np.lexsort((keys, number))
        runs = [(keys[rows], rows) for rows in np.split(order, np.flatnonzero(np.diff(number[order])) + 1)]
        hits = [np.empty(0, np.int64)]
        while len(runs) > 1:
            pairs = []
            for left, right in zip(runs[::2], runs[1::2]):
                both, found = _merged(left, right, single)
                pairs.append(both)
                hits.append(found)
            runs = pairs + runs[len(pairs) * 2:]
        found = table.select(["context_id", "start"]).take(pa.array(np.concatenate(hits)))
        start = found["start"].to_numpy().astype(np.int32)
        spans = _span_rows(pa.table({"context_id": found["context_id"], "start": pa.array(start), "end": pa.array(start + np.int32(length))}))
        if last:
            return spans
        kept = runs[0][1]
        left = table.take(pa.array(kept)).combine_chunks()
        gone = pa.array(~single[kept])
        return pa.concat_tables([spans, _string_rows(
            int(number[0]) // fan, left["string"], *(pc.if_else(gone, None, left[name]) for name in ("context_id", "start")))])
    return run


def _divided_repeats(divided: DataFrame, runs: int, parts: int, length: int, fan: int) -> DataFrame:
    """Spans of the anchors that are dealt over several shards (``run``, up to ``runs`` of them for an anchor).

    A shard sends one row per distinct string, however often it stands there, so
    a passage that a third of all rows share is one row per shard. Up to ``fan`` runs are
    merged in a task and leave one run, until each string is in one run only.
    """
    spans = "context_id binary, start int, end int"
    out = divided.sparkSession.createDataFrame([], spans)
    found = divided.groupBy("anchor", "run").applyInArrow(_shard_run(length), _RUN_ROWS)
    while True:
        level = materialize(found, "runs")
        out = out.union(level.filter("string is null").select("context_id", "start", "end"))
        if runs == 1:
            return out
        runs = -(-runs // fan)
        found = level.filter("string is not null").withColumn("part", F.pmod(F.xxhash64("string"), F.lit(parts))) \
            .groupBy("part", F.expr(f"run div {fan}")).applyInArrow(_merge_runs(length, fan, runs == 1), _RUN_ROWS)


def _repeats(contexts: DataFrame, length: int, shard_bytes: int, fan: int) -> DataFrame:
    """Spans (context_id, start, end) of the repeated strings in ``contexts`` (anchor, context_id, context, n)."""
    size = F.length("context")
    total = contexts.agg(F.sum(size)).first()[0] or 0
    shards = total // shard_bytes + 1
    large = materialize(contexts.groupBy("anchor").agg(F.sum(size).alias("bytes"))
                        .filter(F.col("bytes") > shard_bytes), "large_anchors")
    rest = contexts.join(large, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = rest.groupBy("shard").applyInArrow(_search_shard(length), "context_id binary, start int, end int")
    most = large.agg(F.max("bytes")).first()[0]
    if most is None:
        return found
    divided = contexts.join(large, "anchor").withColumn(
        "run", F.pmod(F.xxhash64("context_id"), F.expr(f"bytes div {shard_bytes} + 1"))).drop("bytes")
    return found.union(_divided_repeats(divided, most // shard_bytes + 1, 4 * shards, length, fan))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        rest, n_bytes, n_removed, n_spans, digests = [], [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            text, kept, at, runs = text or b"", [], 0, 0
            covered = -1
            for span in sorted((s["start"], s["end"]) for s in spans or ()):
                if span[0] > covered:
                    runs += 1
                    kept.append(text[at:span[0]])
                covered = at = max(covered, span[1])
            kept.append(text[at:])
            left = b"".join(kept)
            rest.append(left)
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(left))
            n_spans.append(runs)
            digests.append(sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
             pa.array(digests), pa.array(rest, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` bytes.

    A byte goes if it lies in a string of ``length`` bytes of the text in UTF-8
    that also starts anywhere else, in this or another row; overlaps count, and
    all is judged on the input. ``n_spans`` counts the maximal removed runs. A
    null text counts as empty; shorter texts lose nothing. Rows alike in id and
    text are two documents that repeat each other. A null id is kept. Other
    columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc"].dataType.simpleString()
    key = ["doc", "text_hash"]
    found = materialize(texts.filter(F.octet_length("text") >= length).mapInArrow(
        partial(_find_anchors, gram=gram, length=length),
        f"doc {id_type}, text_hash long, anchor long, start int, end int"), "anchors")
    repeated = materialize(found.groupBy("anchor").count().filter("count > 1").drop("count"), "repeated")
    # Rows alike in id and text have the same places; their number keeps them apart.
    places = found.join(repeated, "anchor", "left_semi").groupBy(*key).agg(
        F.collect_set(F.struct("anchor", "start", "end")).alias("places"))
    places = materialize(places, "places")
    release(found, repeated)
    places = places.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), "places")
    placed = texts.join(places, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    cut = materialize(placed.select(*key, "text", "places").mapInArrow(
        _cut_contexts, f"doc {id_type}, text_hash long, anchor long, start int, context_id binary, context binary"), "contexts")
    release(places)
    counts = cut.groupBy("context_id").agg(F.count("*").alias("n"))
    distinct = cut.filter("context is not null").dropDuplicates(["context_id"]).select("anchor", "context_id", "context")
    contexts = materialize(distinct.join(counts, "context_id"), "distinct_contexts")
    spans = materialize(_repeats(contexts, length, shard_bytes, fan), "repeats").withColumnRenamed("start", "from")
    release(contexts)
    covered = cut.select(*key, "start", "context_id").join(spans, "context_id").groupBy(*key).agg(F.collect_set(F.struct(
        (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("end")).alias("end"))).alias("spans"))
    covered = materialize(covered, "covered")
    release(cut, spans)
    covered = covered.select(F.col("doc").alias("d"), F.col("text_hash").alias("h"), "spans")
    joined = texts.join(covered, F.col("doc").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    return joined.select("doc", "text", "spans").mapInArrow(
        _cut_texts, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

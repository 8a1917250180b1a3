"""Near duplicates by SimHash fingerprints, found with pigeonring chains.

The 64 bits lie on a ring of 16 segments of four bits. If two fingerprints differ
in at most 3 bits, some segment starts a chain around the ring in which the first
l segments hold at most 3 l / 16 differences, for every l. With whole differences
that means: none in the first 20 bits of the chain, one at most in the first 40,
two at most in the first 60. So the 20 bits behind the exact run hold one
difference at most, and one half of them none: a chain is looked up by 30 equal
bits, in 16 x 2 tables, and the other budgets strike out candidates before all 64
bits are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import components
from tallymark.session import materialize

SHINGLE = 3
SEED = 42
BITS = 3  # differing bits of a link
SEGMENTS = 16
_WIDTH = 64 // SEGMENTS
_BUDGETS = [BITS * length // SEGMENTS for length in range(SEGMENTS + 1)]  # by the number of segments in a chain
# A budget matters at the longest chain that has it: (bits of the chain, differences allowed).
CHAIN = [(_WIDTH * k, _BUDGETS[k]) for k in range(1, SEGMENTS + 1) if k == SEGMENTS or _BUDGETS[k + 1] > _BUDGETS[k]]
_EXACT, _NEXT = CHAIN[0][0], CHAIN[1][0] - CHAIN[0][0]  # 20 equal bits, 20 more with one difference
_HALF = _NEXT // 2
_KEY = _EXACT + _HALF
STAR_ROUNDS = 3
# An entry with more fingerprints outside its largest component is split by more equal bits before it is compared.
WIDE = 64
LEVELS = 5
_PART = 1 << 14


def fingerprint(text: bytes | None) -> int:
    """64 bits, each set if it is set in over half of the shingle hashes; 0 without words.

    ``bytes`` methods lower only A-Z and split at exactly the six white-space bytes.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    width = min(SHINGLE, len(words))
    spans = zip(starts, ends[width - 1:].tolist())
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        part = hashes[at:at + _PART].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def _turned(x: str, by: str) -> str:
    """SQL: ``x`` turned left, so that the chain starts at the highest bit."""
    return f"(shiftleft({x}, {by}) | shiftrightunsigned({x}, 64 - {by}))"


def _ones(x: str, bits: int) -> str:
    return f"bit_count(shiftrightunsigned({x}, {64 - bits}))" if bits < 64 else f"bit_count({x})"


def _linked() -> Column:
    """Condition on (a, b, start): the chain keeps its budgets, then the whole fingerprints differ in 3 bits at most."""
    turned = _turned("(a ^ b)", f"{_WIDTH} * start")
    return F.expr(" AND ".join(f"{_ones(turned, bits)} <= {most}" for bits, most in CHAIN))


def _table_keys(fps: DataFrame) -> DataFrame:
    """(fp, key): per start and half the table's number above its 30 equal bits."""
    keys = []
    for start in range(SEGMENTS):
        turned = _turned("fp", str(_WIDTH * start))
        for half in range(2):
            low = f"(shiftrightunsigned({turned}, {64 - _EXACT - _HALF * (half + 1)}) & {(1 << _HALF) - 1})"
            keys.append(f"shiftleft({2 * start + half}L, {_KEY}) | shiftleft(shiftrightunsigned({turned}, {64 - _EXACT}), {_HALF}) | {low}")
    return fps.select("fp", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key"))


def _known(start: int, half: int) -> int:
    """The bits that all fingerprints of a table's entry have in common, as a signed number."""
    chain = ((1 << _EXACT) - 1) << (64 - _EXACT) | ((1 << _HALF) - 1) << (64 - _EXACT - _HALF * (half + 1))
    by = _WIDTH * start
    bits = (chain >> by | chain << (64 - by)) & (2**64 - 1)
    return bits - 2**64 if bits >= 2**63 else bits


def _quarter(level: int, part: int) -> int:
    """One of four parts of the 64 bits, dealt differently on each level."""
    def at(bit: int) -> int:
        return (bit, bit // 4, bit // 16, bit + bit // 4, bit // 4 + bit // 16)[level % 5] % 4

    bits = sum(1 << bit for bit in range(64) if at(bit) == part)
    return bits - 2**64 if bits >= 2**63 else bits


def _placed(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return entries.withColumn("component", F.col("fp"))
    return entries.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def _across(placed: DataFrame, wide: int) -> list[DataFrame]:
    """Links (a, b) between different components of an entry.

    Whatever is outside the largest component of an entry is held against all of
    it, which is ``wide`` times the entry at most: an entry with more outside is
    divided first. Of four parts of the bits one must be equal, so a fingerprint
    goes to four longer keys, until the entry is narrow or few bits are left open.
    """
    entry = ["start", "known", "value"]
    masks = F.array(*[F.lit(_known(s, h)) for s in range(SEGMENTS) for h in range(2)])
    rows = placed.withColumn("table", F.shiftright("key", _KEY).cast("int")).select(
        (F.col("table") / 2).cast("int").alias("start"), F.get(masks, "table").alias("known"), "fp", "component")
    rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("known")))
    found = []
    for level in range(LEVELS + 1):
        parts = rows.groupBy(*entry, "component").agg(F.count("*").alias("size"))
        mixed = materialize(
            parts.groupBy(*entry).agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("k"))
            .filter("k > 1").select(*entry, F.col("main.component").alias("main"),
                                    (F.col("all") - F.col("main.size")).alias("outside")), "mixed")
        narrow = mixed if level == LEVELS else mixed.filter(F.col("outside") <= wide)
        inside = materialize(rows.join(narrow.drop("outside"), entry), "narrow")
        outside = inside.filter("component <> main").select(*entry, F.col("fp").alias("a"), F.col("component").alias("other"))
        once = "component <> other AND (component = main OR a < b)"
        pairs = outside.join(inside.withColumnRenamed("fp", "b"), entry).filter(F.expr(once) & _linked())
        found.append(materialize(pairs.select("a", "b").distinct(), "across"))
        large = mixed.filter(F.col("outside") > wide)
        if level == LEVELS or large.isEmpty():
            return found
        quarters = F.array(*[F.lit(_quarter(level, p)) for p in range(4)])
        longer = rows.join(large.select(*entry), entry, "left_semi").select(
            "start", "fp", "component", F.explode(F.transform(quarters, lambda q: F.col("known").bitwiseOR(q))).alias("known"))
        rows = materialize(longer.withColumn("value", F.col("fp").bitwiseAND(F.col("known"))).distinct(), "longer")


def linked_components(fps: DataFrame, wide: int = WIDE) -> DataFrame:
    """(node, component) for the fingerprints in ``fps`` (distinct ``fp``) that link with another one."""
    keys = _table_keys(fps)
    shared = keys.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("key")
    entries = materialize(keys.join(shared, "key", "left_semi"), "entries")
    links, labels = None, None
    for turn in range(STAR_ROUNDS):  # all of an entry against one of its fingerprints
        placed = _placed(entries, labels)
        order = F.struct((F.col("fp") if turn == 0 else F.xxhash64(F.lit(turn), "fp")).alias("order"), F.col("fp").alias("a"),
                         F.col("component").alias("other"))
        heads = placed.groupBy("key").agg(F.min(order).alias("head"), F.min("component").alias("low"), F.max("component").alias("high")) \
            .filter("low < high").select("key", "head.a", "head.other")
        start = F.shiftright("key", _KEY + 1).cast("int").alias("start")
        near = placed.join(heads, "key").filter("component <> other").select(F.col("fp").alias("b"), "a", start).filter(_linked())
        found = materialize(near.select("a", "b").distinct(), "near")
        if turn and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links)
    for more in _across(materialize(_placed(entries, labels), "placed"), wide):
        links = links.union(more)
    return components(links)


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs without white space, with A-Z in lower case; every run of three
    words counts, repeats included, and a shorter text is one run. A text that is
    null, empty or without words has fingerprint zero and is linked like any other.
    Documents whose fingerprints differ in at most 3 bits are linked; a component is
    what links reach, and its id the smallest document id in it. A null id names no
    component, unless all ids in it are null. Repeated rows stay, with equal
    results; an empty table gives no rows; other columns are ignored.

    Equal fingerprints are one node. Each entry of the tables is held against one of
    its nodes for a few rounds, which joins dense groups in linear work; only what
    is then still apart within an entry is compared further, see ``_across``.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    marked = materialize(texts.mapInArrow(_fingerprints, f"doc_id {id_type}, fp long"), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    labels = linked_components(nodes.select("fp"))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = materialize(named.join(least, "component").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of 16 sub-keys, each of three minhashes, are computed per
document; a table key combines one sub-key of either collection. That gives 256
tables of six minhashes each from 96 minhashes instead of 1536. Documents of
similarity s share a key with probability (1 - (1 - s^3)^16)^2: 0.9997 at 0.75
and 0.99998 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.components import components
from tallymark.llm.sieve import sieve
from tallymark.llm.worker_table import drop_table
from tallymark.session import materialize, release

SHINGLE = 5
SIDE, ROWS = 16, 3  # sub-keys in a collection, minhashes in a sub-key
IN_KEYS = 2 * SIDE * ROWS
HASHES = 2 * IN_KEYS  # the sketch has four bits of each, fifteen to a number
# Documents of similarity 0.75 agree in 147 of 192 minhashes on average, four bits
# being equal by chance in one of sixteen; the deviation is 5.9, and fewer than
# 122 agreements have a chance of one in 10^5.
LEAST_AGREEMENTS = 122
_LANES = 15
_NUMBERS = -(-HASHES // _LANES)
STAR_ROUNDS = 2
# Sets of up to so many shingles travel as 16-bit prints into the pair-wise join. A common shingle is hidden
# only by prints that coincide in both sets, so no more are than the set with fewer such prints has.
SMALL = 256
_PART = 4096
# Hashes of so many words of at most so many bytes are kept in a task; a word is hashed about as fast as it is found.
_WORDS_KEPT, _LONGEST_KEPT = 20_000, 64

_rng = np.random.default_rng(20240229)
_POSITION, _FACTOR, _SHIFT, _ROW = (_rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
                                    for n in (SHINGLE, HASHES, HASHES, ROWS))


_LANE = np.arange(0, 4 * _LANES, 4, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= _LONGEST_KEPT:
            if len(self) >= _WORDS_KEPT:
                self.clear()
            self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text in UTF-8.

    ``bytes`` methods lower only A-Z and split at exactly the six white-space bytes.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += known[k:k + n] * _POSITION[k]
    return np.unique(_mixed(total))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), _PART):
        values = shingles[at:at + _PART, None] * _FACTOR + _SHIFT
        np.minimum(least, values.min(axis=0), out=least)
    return _mixed(least)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_table()
    hashes = _WordHashes()
    for batch in batches:
        n, digests, keys, sketches, prints = [], [], [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            shingles = shingle_set(text, hashes)
            least = minhashes(shingles)
            n.append(len(shingles))
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            keys.append(_mixed((least[:IN_KEYS].reshape(-1, ROWS) * _ROW).sum(axis=1, dtype=np.uint64)) if n[-1] else least[:0])
            prints.append(np.unique(shingles.astype(np.uint16).view(np.int16)) if 0 < n[-1] <= SMALL else None)
            bits = np.zeros(_NUMBERS * _LANES, np.uint64)
            bits[:HASHES] = least >> np.uint64(60)
            sketches.append((bits.reshape(_NUMBERS, _LANES) << _LANE).sum(axis=1, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), batch.column("row"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
             _lists(keys), _lists(sketches), pa.array(prints, pa.list_(pa.int16()))],
            names=["doc_id", "text_hash", "row", "n", "digest", "subkeys", "sketch", "prints"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_table()
    hashes = _WordHashes()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), _lists([shingle_set(t, hashes) for t in texts])], names=["node", "shingles"])


def _agreements(a: str, b: str) -> Column:
    """Minhashes in which two sketches agree. Written out number by number, so that it is compiled."""
    rest, top = F.lit(0x0777777777777777), F.lit(0x0888888888888888)

    def differing(k: int) -> Column:  # the top bit of each four is set if any bit differs
        diff = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        return F.bit_count((diff.bitwiseAND(rest) + rest).bitwiseOR(diff).bitwiseAND(top))

    return HASHES - sum((differing(k) for k in range(1, _NUMBERS)), differing(0))


def _may_link(n: str, m: str, a: str, b: str) -> Column:
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * 75
    return sizes & (_agreements(a, b) >= LEAST_AGREEMENTS)


def _table_keys(nodes: DataFrame) -> DataFrame:
    """(node, key, i, j) with the numbers of the sub-keys in ``key``.

    A pair of sub-keys can repeat only if both do, so single ones go before they are combined.
    """
    subkeys = nodes.select("node", F.posexplode("subkeys").alias("slot", "h"))
    repeated = materialize(subkeys.groupBy("slot", "h").count().filter("count > 1").drop("count"), "repeated")
    some = subkeys.filter(sieve(repeated, "slot", "h")("slot", "h"))
    live = some.join(repeated, ["slot", "h"], "left_semi").groupBy("node").agg(
        F.collect_list(F.struct("slot", "h")).alias("live"))
    keys = F.flatten(F.transform(
        F.filter("live", lambda x: x["slot"] < SIDE),
        lambda x: F.transform(F.filter("live", lambda y: y["slot"] >= SIDE), lambda y: F.struct(
            F.xxhash64(x, y).alias("key"), x["slot"].alias("i"), y["slot"].alias("j")))))
    return live.select("node", F.explode(keys).alias("k")).select("node", "k.*")


def _members(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes that share a table key with another one."""
    named = materialize(keys.select("node").distinct(), "named")
    return materialize(nodes.filter(sieve(named, "node")("node")).join(named, "node", "left_semi"), "members")


def _shingle_sets(nodes: DataFrame, texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, shingles), one row per node. Only the texts of the nodes move, once, for this.

    Where several rows are alike in id and text (``repeated``), one of their texts is taken on the map side.
    The sieve and the shingles each need a Python process; a shuffle between them, which a merge join has
    at any size, keeps a task at one.
    """
    wanted = nodes.select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = texts.filter(sieve(nodes, "text_hash")("text_hash"))
    alike = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    several = materialize(wanted.join(repeated, alike, "left_semi"), "several")
    one = materialize(wanted.join(several.select("node"), "node", "left_anti"), "single")
    found = texts.join(one.hint("merge"), alike).select("node", "text").union(
        texts.join(several, alike).groupBy("node").agg(F.first("text").alias("text")))
    return materialize(found.mapInArrow(_sets, "node long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    pairs = materialize(pairs, "pairs")
    left, right = (sets.filter(sieve(pairs, end)("node")).withColumnRenamed("node", end) for end in ("a", "b"))
    both = pairs.join(right.withColumnRenamed("shingles", "y"), "b").join(left.withColumnRenamed("shingles", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    found = materialize(both.filter(shared * 100 >= (F.size("x") + F.size("y") - shared) * 75).select("a", "b"), "confirmed")
    release(pairs)
    return found


def _links(nodes: DataFrame, texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links between different shingle sets, enough of them for the components.

    An entry is what shares a table key. In each round every entry is held against
    one of its documents, which is linear in its size, and components are joined;
    entries within one component are done. Only what then still lies in different
    components of an entry is compared pair by pair.
    """
    every = materialize(_table_keys(nodes), "keys")
    keys = materialize(every.join(every.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
                                  .filter("a < b").select("key"), "key", "left_semi"), "entries")
    members = _members(nodes, keys)
    release(every, nodes)
    nodes, sets = members, _shingle_sets(members, texts, repeated)
    links = labels = None
    for turn in range(STAR_ROUNDS):
        if labels is None:
            placed = keys.withColumn("component", F.col("node"))
        else:
            placed = keys.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # The same order of the documents in every entry, so that a group meets few different heads.
        order = F.struct((F.col("node") if turn == 0 else F.xxhash64(F.lit(turn), "node")).alias("order"), "node", "component")
        heads = placed.groupBy("key").agg(F.min(order).alias("head"), F.min("component").alias("low"),
                                          F.max("component").alias("high")).filter("low < high")
        heads = materialize(heads.select("key", F.col("head.node").alias("a"), F.col("head.component").alias("other")), "heads")
        near = placed.join(heads, "key").filter("component <> other").select(
            F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct()
        found = _confirmed(_likely(near, nodes), sets)
        release(heads)
        if turn and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links)
    links = links.union(_confirmed(_across(keys, labels, nodes), sets))
    release(keys, nodes, sets)
    return links


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""
    right = nodes.select(F.col("node").alias("b"), "n", "sketch")
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    return pairs.join(right, "b").join(left, "a").filter(_may_link("n", "m", "sketch", "t")).select("a", "b")


def _across(keys: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of different components of an entry, each pair once."""
    placed = keys.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("main"), F.count("*").alias("k")) \
        .filter("k > 1").select("key", F.col("main.component").alias("main"))
    placed = placed.join(materialize(mixed, "mixed"), "key").join(nodes.select("node", "n", "sketch", "subkeys", "prints"), "node")
    placed = materialize(placed, "mixed_entries")
    # Everything outside the largest component of an entry, against all of the entry.
    outside = placed.filter("component <> main").select(
        "key", F.col("node").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("t"),
        F.col("component").alias("other"), F.col("subkeys").alias("own"), F.col("prints").alias("marks"))
    inside = placed.select("key", F.col("node").alias("b"), "n", "sketch", "component", "main", "subkeys", "i", "j", "prints")
    # A pair that shares several keys counts in the one of its first common sub-keys.
    def first_common(slots: range) -> Column:
        return F.coalesce(*[F.when(F.get("own", F.lit(k)) == F.get("subkeys", F.lit(k)), k) for k in slots])

    once = (first_common(range(SIDE)) == F.col("i")) & (first_common(range(SIDE, 2 * SIDE)) == F.col("j"))
    new = (F.col("component") == F.col("main")) | (F.col("a") < F.col("b"))
    hidden = F.least(F.col("m") - F.size("marks"), F.col("n") - F.size("prints"))
    common = F.size(F.array_intersect("marks", "prints")) + hidden
    near = F.col("marks").isNull() | F.col("prints").isNull() | (common * 100 >= (F.col("n") + F.col("m") - common) * 75)
    pairs = outside.join(inside, "key").filter(
        (F.col("component") != F.col("other")) & new & once & _may_link("n", "m", "sketch", "t") & near)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept, and with ``row_col`` also row.

    Words are runs without white space, with A-Z in lower case. A set holds the
    distinct runs of five words; with one to four words, all of them as one; none
    without words, and then the document is linked with nothing. Documents link
    from a similarity of 0.75 (equality counts). ``component_id`` is the smallest
    id that can be reached; the row with it is kept. Rows alike in id and set tie,
    and exactly one row of a component is kept. A null id comes last, and names a
    component only where no other id is in it. A null text counts as empty; an
    empty table gives no rows; other columns are ignored. ``row_col`` names a column
    of distinct numbers by which the rows can be told apart; it is returned as ``row``.

    Equal sets become one node. Nodes that share a table key are candidates; the
    sizes and the minhash sketch strike out hopeless ones, and the rest are
    confirmed on their full sets.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    numbered = texts.withColumn("row", F.monotonically_increasing_id()) if row_col is None else docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"),
        F.col(row_col).cast("long").alias("row"))
    rows = materialize(numbered.mapInArrow(
        _sketches, f"doc_id {id_type}, text_hash long, row long, n long, digest binary, subkeys array<long>, "
                   "sketch array<long>, prints array<short>"), "sketches")
    some = rows.filter("n > 0")
    shared = materialize(some.groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("k"))
                         .filter("k > 1").drop("k"), "copies")
    copied = sieve(shared, "digest")("digest")
    columns = F.col("row").alias("node"), "doc_id", "text_hash", "n", "subkeys", "sketch", "prints"
    heads = some.filter(copied).join(shared.withColumnRenamed("node", "head"), "digest", "left").filter("head is null or head = row")
    nodes = materialize(some.filter(~copied).select(*columns).union(heads.select(*columns)), "nodes")
    repeated = materialize(some.groupBy("doc_id", "text_hash").count().filter("count > 1").drop("count"), "repeated_rows")
    sketches, rows = rows, materialize(rows.select("row", "doc_id", "text_hash", "n", "digest"), "rows")
    release(sketches)
    labels = materialize(components(_links(nodes, texts, repeated)), "components")
    placed = rows.join(shared, "digest", "left") \
        .withColumn("grouped", F.col("node").isNotNull() & (F.col("n") > 0)) \
        .withColumn("node", F.when(F.col("grouped"), F.col("node")).otherwise(F.col("row")))
    placed = placed.join(labels, "node", "left").select(
        "row", "doc_id", "text_hash", "n", F.coalesce("component", "node").alias("component"),
        (F.col("grouped") | F.col("component").isNotNull()).alias("grouped"))
    placed = materialize(placed, "placed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = materialize(placed.filter("grouped").groupBy("component").agg(best.alias("best")).select(
        "component", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best")), "groups")
    out = placed.join(groups, "component", "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"),
                      F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      (~F.col("grouped") | (F.col("row") == F.col("best"))).alias("kept"), *(["row"] if row_col else []))

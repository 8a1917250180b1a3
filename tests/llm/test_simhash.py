"""SimHash and its pigeonring lookup against all pairs, and the defined results at the edges."""

from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm.queries import op12_simhash_near_dedup
from tallymark.llm.simhash import BITS, CHAIN, SEED, fingerprint, linked_components, simhash_duplicates

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, SEED) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{id: (fingerprint, smallest id that links reach)} by holding all pairs."""
    rows = [(k, f) for k, f in prints]
    reach = list(range(len(rows)))

    def root(i):
        while reach[i] != i:
            i = reach[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= BITS:
                a, b = root(i), root(j)
                reach[a] = b
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    return {k: (f"{f:016x}", min(groups[root(i)])) for i, (k, f) in enumerate(rows)}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_query_equals_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op12_simhash_near_dedup(spark, FOLDER).collect()}
    assert got == plain_components([(k, plain_fingerprint(t)) for k, t in docs])


def test_fingerprints(spark):
    texts = ["", " \t\n\v\f\r", "One", "one TWO", "a b c", "a b c d", "ÀB ßC É x y", "w " * 70_000, "x y z " * 9, " lead and trail "]
    assert [fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert fingerprint(None) == fingerprint(b"") == 0 and fingerprint(b"a B c") == fingerprint(b"A b C")
    same = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert signed(fingerprint(b"a b c")) == same  # the hash that Spark has as well


def test_chain_of_budgets():
    assert CHAIN == [(20, 0), (40, 1), (60, 2), (64, 3)]
    rng = random.Random(4)
    for _ in range(2000):  # every difference of three bits has a start from which all budgets are kept
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        turned = [(x << 4 * s | x >> (64 - 4 * s)) & (2**64 - 1) for s in range(16)]
        assert any(all((t >> (64 - bits)).bit_count() <= most for bits, most in CHAIN) for t in turned)


def families(seed, many, size, flips):
    """Fingerprints around a few centres, so that entries are full of near ones."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(30)}
    for _ in range(many):
        centre = rng.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(size)}
    return sorted(out)


@pytest.mark.parametrize("wide", [64, 0])
def test_components_of_fingerprints(spark, wide):
    """``wide`` 0 divides every entry to the last level; the links stay the same."""
    prints = families(wide, 6, 50, 9)
    table = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.node: r.component for r in linked_components(table, wide).collect()}
    plain = plain_components([(signed(p), p) for p in prints])
    assert {signed(p): got.get(signed(p), signed(p)) for p in prints} == {k: c for k, (_, c) in plain.items()}


def test_edges(spark):
    rows = [(5, None), (4, ""), (9, " \n"), (3, "a b c d e"), (3, "a b c d e"), (None, "A B C D E"), (None, "only here"), (None, "only here")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("fp", "key", "component", "low", "node", "start")})
    got = sorted(map(str, simhash_duplicates(table).collect()))
    zero, five, here = ("0" * 16, *(f"{plain_fingerprint(t):016x}" for t in ("a b c d e", "only here")))
    assert got == sorted(f"Row(doc_id={k}, fingerprint={f!r}, component_id={c})" for k, f, c in [
        (5, zero, 4), (4, zero, 4), (9, zero, 4), (3, five, 3), (3, five, 3), (None, five, 3), (None, here, None), (None, here, None)])
    assert simhash_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_near_copies_of_long_texts(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    changed = list(base)
    changed[30_000] = "changed"
    rows = [(2, " ".join(base)), (1, " ".join(changed)), (3, " ".join(reversed(base)))]
    got = {r.doc_id: r.component_id for r in simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}

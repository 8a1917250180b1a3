"""Each operator against plain versions, and its defined results at the edges."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import random
import re
import weakref
import zipfile
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, exact_dedup, licenses, line_dedup, minhash, packing, pii, quality, substring_dedup, warc, worker_table
from tallymark.llm.components import components
from tallymark.llm.queries import ORACLE_SQL, QUERIES
from tallymark.llm.sieve import sieve
from tallymark.llm.suffix_array import common_prefixes, suffix_array
from tallymark.session import materialize, shared_root
from tests.llm.compare import differences

FOLDER = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# An extra column set with names that operators use inside.
CLASHING = "doc_id long, text string, n_lines int, kept string, node string, key string, rank string, row string, doc string"


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return table(spark, [(k, t, 9, "x", "x", "x", "x", "x", "x") for k, t in rows], CLASHING)


def words(seed: int, n: int, size: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, FOLDER, QUERIES[name], ORACLE_SQL[name]) is None


def plain_lines(rows):
    first, out = {}, {}
    places = sorted((k, t) for k, t in rows if t is not None)
    for k, t in places:
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p:p + 3]), (k, p))
    for k, t in places:
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - 2):
            d, q = first[tuple(lines[p:p + 3])]
            if (d, q) != (k, p):
                gone |= set(range(max(p, q + 3) if d == k else p, p + 3))
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    rows = [(k, "\n".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))) for k in range(60)] + [(90, ""), (91, "a\na\na\na\na")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == plain_lines(rows)


def test_line_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "a\nb"), (None, "x\ny\nz"), (4, "x\ny\nz"), (4, "x\ny\nz"), (5, "q\nx\ny\nz\nr")]
    got = line_dedup.line_dedup(clashing(spark, rows))
    assert "kept" in got.columns and got.columns.count("n_lines") == 1
    assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in got.collect()) == sorted([
        ("1", "None", 0), ("2", "", 0), ("3", "a\nb", 0), ("None", "", 3), ("4", "x\ny\nz", 0), ("4", "x\ny\nz", 0), ("5", "q\nr", 3)])
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


def test_exact_groups(spark):
    long = words(1, 30_000)
    rows = [(1, "a b"), (2, "ab "), (3, "a\tb  "), (4, None), (5, " \n"), (6, long), (7, long + " "), (8, long[:-1] + "~"),
            (None, "ab"), (9, "é"), (9, "é")]
    got = exact_dedup.exact_groups(clashing(spark, rows)).collect()
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id not in (9, None)}
    assert by == {1: (3, 4, False), 2: (3, 4, False), 3: (3, 4, True), 4: (5, 2, False), 5: (5, 2, True),
                  6: (7, 2, False), 7: (7, 2, True), 8: (8, 1, True)}
    assert sorted(r.kept for r in got if r.doc_id == 9) == [False, True]
    assert {r.text_sha256 for r in got if r.doc_id in (1, 2, 3)} == {hashlib.sha256(b"ab").hexdigest()}
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_identifiers_that_clash_are_replaced(spark):
    def weak(chunk, seed):
        return F.struct(F.length(chunk).alias("a")) if seed == 0 else F.struct(F.xxhash64(chunk).alias("a"))

    got = exact_dedup.exact_groups(table(spark, [(1, "abc"), (2, "abd"), (3, "a bc")]), identify=weak).collect()
    assert {r.doc_id: r.keep_id for r in got} == {1: 3, 2: 2, 3: 3}


def near_rows():
    rng = random.Random(5)
    rows, k = [], 0
    for group in range(12):
        base = words(100 + group, 120, 5000).split()
        for _ in range(rng.randrange(2, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 7)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            rows.append((k, " ".join(own)))
            k += 1
    return rows + [(900, None), (901, " \n"), (902, "One two"), (903, "one TWO"), (904, "one two three"), (905, rows[0][1].upper())]


def plain_components(rows):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates(spark):
    rows = near_rows()
    got = minhash.near_duplicates(clashing(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    text = words(7, 50)
    got = minhash.near_duplicates(table(spark, [(3, text), (3, text), (None, text), (8, "x"), (None, None)])).collect()
    assert Counter((r.component_id, r.kept) for r in got) == {(3, True): 1, (3, False): 2, (8, True): 1, (None, True): 1}


def test_repeated_rows_do_not_multiply(spark, monkeypatch):
    """Hundreds of rows alike in id and text are one set and one link, with a null id as well."""
    one, other = words(7, 60), words(7, 60) + " more"
    rows = [(1, one)] * 200 + [(2, other)] * 200 + [(None, one + " again")] * 50 + [(5, words(8, 60))]
    sizes = []

    def counted(function):
        def run(*args):
            out = function(*args)
            sizes.append((function.__name__, out.count(), out.distinct().count()))
            return out
        return run

    for name in ("_shingle_sets", "_confirmed"):
        monkeypatch.setattr(minhash, name, counted(getattr(minhash, name)))
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == {
        (1, 1, True): 1, (1, 1, False): 199, (2, 1, False): 200, (None, 1, False): 50, (5, 5, True): 1}
    assert sizes[0] == ("_shingle_sets", 3, 3) and all(n == different <= 3 for _, n, different in sizes)


def test_pairs_across_components_are_each_made_once(spark):
    """With no star round but the first, the pair-wise step has to find what the heads miss."""
    rows = near_rows()
    rounds, minhash.STAR_ROUNDS = minhash.STAR_ROUNDS, 1
    try:
        got = minhash.near_duplicates(table(spark, rows)).collect()
    finally:
        minhash.STAR_ROUNDS = rounds
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)]
    root = {n: n for e in links for n in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    got = {r.node: r.component for r in components(table(spark, links, "a long, b long")).collect()}
    assert got == {n: root[n] for n in linked}


def plain_repeats(rows, length):
    counts = Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for k, t in rows:
        covered = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                covered[i:i + length] = True
        runs = int(np.count_nonzero(covered[1:] & ~covered[:-1]) + (len(t) > 0 and covered[0]))
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out.append((str(k), len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [substring_dedup.SHARD_BYTES, 300])
def test_repeated_substrings(spark, shard_bytes):
    rng = random.Random(11)
    shared = [words(k, 20) for k in range(4)]
    rows = [(k, " ".join(rng.choice(shared) if rng.random() < 0.3 else words(rng.random(), rng.randrange(30)) for _ in range(6)))
            for k in range(40)]
    rows += [(100, "ä" * 300), (101, "a" * 700), (102, None), (103, ""), (None, rows[0][1]), (104, rows[1][1]), (104, rows[1][1])]
    got = substring_dedup.remove_repeats(clashing(spark, rows), shard_bytes=shard_bytes).collect()
    plain = plain_repeats([(k, (t or "").encode()) for k, t in rows], 200)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain


def test_a_hot_passage_is_one_row_per_string_and_shard(spark):
    """A passage with other surroundings in each text is dealt over many shards; runs are merged in rounds and agree with the plain search."""
    hot = words(5, 60)
    rows = [(k, words(k, 30, 10**6) + f" {k} " + hot[(k * 7) % 30:] + words(k + 1000, 20, 10**6)) for k in range(60)]
    rows += [(k, words(k, 60, 10**6)) for k in range(100, 130)] + [(200, words(7, 40)), (201, words(7, 40)), (202, hot[:199])]
    plain = plain_repeats([(k, t.encode()) for k, t in rows], 200)
    for fan in (2, 5, 64):
        got = substring_dedup.remove_repeats(table(spark, rows).repartition(3), shard_bytes=600, fan=fan).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain

    contexts = [hot[k:].encode() + str(k).encode() * 3 for k in range(20)]
    rows = substring_dedup._shard_run(200)(pa.table({
        "run": [3] * 20, "context_id": [bytes([k]) for k in range(20)], "context": contexts, "n": [1] * 20})).to_pylist()
    strings = Counter(c[k:k + 200] for c in contexts for k in range(len(c) - 199))
    sent = [r for r in rows if r["string"]]
    assert len(sent) == len({r["string"] for r in sent}) == len(strings)
    assert sum(r["context_id"] is not None for r in sent) == sum(n == 1 for n in strings.values())


def test_repeated_substrings_of_nothing(spark):
    assert substring_dedup.remove_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 6, 500, 4000])
def test_suffix_array(n):
    text = np.random.default_rng(n).integers(97, 99, n).astype(np.uint8)
    text[n // 2:] = text[:n - n // 2]
    order, data = suffix_array(text), text.tobytes()
    assert order.tolist() == sorted(range(n), key=lambda i: data[i:])
    plain = [0]
    for a, b in zip(order[:-1], order[1:]):
        plain.append(next((k for k in range(n) if max(a, b) + k >= n or data[a + k] != data[b + k]), n))
    assert common_prefixes(text, order).tolist() == plain


TEXTS = ["Hello WORLD, it's  l'été… 12.5%!", "don't 'S x's|y || a|b <|endoftext|>", "", "\x1c\x85 áe ́b", "日本語 テスト。", words(4, 5000), None]


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (50, "twin"), (50, "twin")] + [(100 + k, words(k, k * 7)) for k in range(60)]
    got = packing.best_fit(clashing(spark, rows), TOKENIZER, with_ids=True).collect()
    held, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        held[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
    for k, t in rows:
        if k == 50:
            continue
        pieces = sorted(held[k], key=lambda r: r.piece)
        assert [i for p in pieces for i in p.ids] == tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        assert [p.start for p in pieces] == [2048 * i for i in range(len(pieces))]
    assert len(held[50]) == 2
    total = 0
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
        total += end
    assert len(sequences) <= -(-total // 2048) + 1
    assert packing.best_fit(table(spark, []), TOKENIZER).count() == 0


def test_packing_over_many_buckets(spark):
    lengths = [(1 + k % 7,) for k in range(500)]
    got = packing.pack(table(spark, lengths, "length long"), size=10, rows_in_bucket=9).collect()
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.length for r in got) == Counter(n for n, in lengths)
    for places in ends.values():
        places.sort()
        assert all(b[0] == a[0] + a[1] for a, b in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 10


def test_two_documents_replace_the_smallest():
    """6 takes the 3 greedily and leaves a gap of 1; 2 + 2 fill the 4 that 3 and the gap make."""
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]
    bins = packing.plan(counts, 10)
    assert bins[0] == ([6, 2, 2], 1) and bins[1] == ([3], 1)
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 65)
    counts[0] = 0
    used = np.zeros(65, np.int64)
    for lengths, times in packing.plan(counts, 64):
        assert sum(lengths) <= 64
        np.add.at(used, lengths, times)
    assert (used == counts).all()


def test_archives(spark, tmp_path):
    big, small = "ü" * 600, "s" * 999
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", small), (5, "u5", small), (6, "a\r\nb", None), (7, "u7", "x" * 1000),
            (None, "n", big), (8, "u8", "twin" * 300), (8, "u8", "twin" * 300)]
    pages = table(spark, [(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    packages = warc.write_archives(pages, f"file://{tmp_path}/a", most=500)
    got = warc.read_archives(packages, with_payload=True, most=700).collect()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    digest = {k: hashlib.sha1((t or "").encode()).hexdigest() for k, _, t in rows}
    assert by[1] == [(1200, digest[1], "revisit", 3)] and by[2] == [(1200, digest[1], "revisit", 3)] and by[None] == by[1]
    assert by[3] == [(1200, digest[1], "response", None)]
    assert by[4] == [(999, digest[4], "response", None)] and by[6] == [(0, digest[6], "response", None)]
    assert by[8] == [(1200, digest[8], "response", None)] * 2
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response" and r.page_id in (3, 4, 7)} == {
        3: big, 4: small, 7: "x" * 1000}
    empty = warc.write_archives(table(spark, [], pages.schema), f"file://{tmp_path}/b")
    assert warc.read_archives(empty).count() == 0


def _warc_record(kind, head, block, version="WARC/1.0", **fields):
    lines = [version, f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items()), *head, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("zipped_index", [False, True])
@pytest.mark.parametrize("most", [1, 200, 1 << 20])
def test_archives_of_other_writers(spark, tmp_path, zipped_index, most):
    """Two archives, one not compressed, an index by URL that repeats and leaves out records, other types and digests."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunks = http.replace(b"Content-Type", b"Transfer-Encoding: chunked\r\nContent-Type") + b"5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    body = b"a body\r\n\r\nwith an empty line" * 40
    in_32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    records = {
        "info": ("one.warc.gz", _warc_record("warcinfo", ["Content-Type: application/warc-fields"], b"software: other\r\n")),
        "z": ("one.warc.gz", _warc_record("response", ["Content-Type: application/http; msgtype=response"], http + body,
                                          WARC_Record_ID="<urn:z>", WARC_Target_URI="http://z/", WARC_Payload_Digest=f"sha1:{in_32}")),
        "request": ("one.warc.gz", _warc_record("request", ["Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\n\r\n")),
        "unlisted": ("one.warc.gz", _warc_record("response", [], http + b"not in the index", WARC_Target_URI="http://unlisted/")),
        "again": ("one.warc.gz", _warc_record("revisit", ["Content-Type: application/http"], http, WARC_Target_URI="http://m/",
                                              WARC_Payload_Digest=f"sha1:{in_32.lower()}")),
        "chunked": ("two.warc", _warc_record("response", ["Content-Type: application/http"], chunks, WARC_Target_URI="http://b/",
                                             WARC_Payload_Digest="sha256:" + hashlib.sha256(b"hello world").hexdigest())),
        "dns": ("two.warc", _warc_record("response", ["Content-Type: text/dns"], b"20200101\r\n\r\n1.2.3.4", WARC_Target_URI="dns:a")),
        "lost": ("two.warc", _warc_record("revisit", [], b"", WARC_Target_URI="http://c/", WARC_Payload_Digest="md5:" + "AB" * 16)),
        "meta": ("two.warc", _warc_record("metadata", [], b"x: y\r\n")),
    }
    archives, lines = {"one.warc.gz": b"", "two.warc": b""}, ["!meta 0 {\"format\": \"cdxj-gzip-1.0\"}", ""]
    for name, (archive, data) in records.items():
        data = gzip.compress(data) if archive.endswith(".gz") else data
        if name != "unlisted":
            place = {"url": name, "filename": archive, "offset": str(len(archives[archive])), "length": len(data)}
            lines += [f"{name[::-1]})/{{x}} 20200101000000 {json.dumps(place)}"] * (2 if name == "z" else 1)
        archives[archive] += data
    index = "\n".join(sorted(lines)).encode()

    def package(name, index, method=zipfile.ZIP_STORED):
        with zipfile.ZipFile(tmp_path / name, "w", method) as out:
            for archive, data in archives.items():
                out.writestr(f"archive/{archive}", data)
            out.writestr("indexes/index.cdx.gz" if zipped_index else "indexes/other.cdxj", gzip.compress(index) if zipped_index else index)
            out.writestr("pages/pages.jsonl", b"{}")
        return table(spark, [(f"file://{tmp_path}/{name}",)], "uri string")

    got = warc.read_archives(package("a.wacz", index), with_payload=True, most=most).collect()
    sha = hashlib.sha1(body).hexdigest()
    assert sorted((r.url, r.record_type, r.payload_bytes, r.payload_digest, bytes(r.payload)) for r in got) == [
        ("dns:a", "response", 19, hashlib.sha1(b"20200101\r\n\r\n1.2.3.4").hexdigest(), b"20200101\r\n\r\n1.2.3.4"),
        ("http://b/", "response", 11, hashlib.sha1(b"hello world").hexdigest(), b"hello world"),
        ("http://c/", "revisit", None, "md5:" + "ab" * 16, b""),
        ("http://m/", "revisit", len(body), sha, b""),
        ("http://z/", "response", len(body), sha, body)]
    assert all(r.page_id is None and r.refers_to is None for r in got) and "<urn:z>" in {r.record_id for r in got}
    if most == 200 and not zipped_index:
        for name, bad in (("b", b"com,x)/ 2020 text/html 200 1 2 one.warc.gz"), ("c", b'k 2020 {"filename": "no", "offset": 0, "length": 1}'),
                          ("d", b'k 2020 {"filename": "two.warc", "offset": 0, "length": 99999999}')):
            with pytest.raises(Exception, match="NotAnArchive"):
                warc.read_archives(package(f"{name}.wacz", bad)).count()
        with pytest.raises(Exception, match="not a stored member"):
            warc.read_archives(package("e.wacz", index, zipfile.ZIP_DEFLATED)).count()


def test_index_keys():
    keys = {"http://www.Example.com/a b?q=1": "com,example,www)/a%20b?q=1", "https://[bad": "-", None: "-", "plain": "-", "http://x": "x)/"}
    assert {url: warc._sort_key(url) for url in keys} == keys


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide, monkeypatch):
    if wide:  # every size and place goes to the ZIP64 records
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = _File()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as package:
        package.comment = b"a comment with PK\5\6 inside"
        for name, body in (("a.txt", b"first member"), ("é/b", b"x" * 3000)):
            package.writestr(name, body)
    members = warc.directory(data)
    assert {n: data.getvalue()[at:at + size] for n, (_, at, size) in members.items()} == {"a.txt": b"first member", "é/b": b"x" * 3000}
    with pytest.raises(warc.NotAnArchive):
        warc.directory(_File(b"no package at all" * 10))


def test_names_of_several_words(spark):
    """A name of any number of words fills one slot, in small and capital readings, and signs divide names."""
    ask = "In the morning, {} has {} apples and {} gives away 3 more, so how many apples does {} have now in total?"
    names = [("Tom", "Anna"), ("Maria Lopez", "Peter Smith"), ("Ann", "Juan Maria Souza"), ("Jean Luc Picard", "Li")]
    rows = [(k, "filler words here first. " + ask.format(a, 5 + k, b, a) + " and some others after it") for k, (a, b) in enumerate(names)]
    rows += [(10, ask.format("Maria Lopez", 9, "Peter Smith", "Peter Smith")), (11, ask.format("tom", 5, "anna", "tom")),
             (12, ask.format("Maria Lopez", 9, "Maria Lopez", "Peter Smith")), (13, "IN CAPITALS " + ask.format("Tom", 5, "Anna", "Tom").upper())]
    for a, b in names:
        bench = table(spark, [(1, ask.format(a, 5, b, a)), (2, "What do Tom, Anna Smith and (Eve Brown) buy at the market today with 4 coins?")],
                      "item_id long, text string")
        got = {r.doc_id for r in decontaminate.leaks(table(spark, rows), bench).collect() if r.item_id == 1}
        assert {0, 1, 2, 3} <= got and not {10, 12} & got
    swapped = [(1, "we ask what do Maria Luz Lopez, Bob and (Joe) buy at the market today with 17 coins?"),
               (2, "we ask what do Tom Anna Smith and (Eve Brown) buy at the market today with 4 coins?")]
    got = decontaminate.leaks(table(spark, swapped), bench).collect()
    assert (1, 2, False) in {(r.doc_id, r.item_id, r.same_values) for r in got}


def test_leaks(spark):
    items = [(1, "Tom has 5 apples and Anna gives him 3 more apples, how many apples does Tom have now in total?"),
             (2, "The train travels 120 km in 2 hours at constant speed, what is the speed of the train?"), (3, None), (4, "")]
    rows = [(1, "xx " + items[0][1] + " zz"), (2, "so Bob has 17 apples and Eve gives him 4 more apples, how many apples does Bob have now in total?"),
            (3, "so Bob has 17 apples and Eve gives him 17 more apples, how many apples does Eve have now in total?"),
            (4, "the train travels 300 km in 7 hours at constant speed, what is the speed of the train"), (5, "Nothing of it here, 5 km away."),
            (6, None), (7, ""), (None, items[1][1]), (8, words(1, 20_000) + " " + items[1][1])]
    bench = table(spark, items, "item_id long, text string")
    for parts in (1, 7):
        got = decontaminate.leaks(clashing(spark, rows).repartition(parts), bench.repartition(parts)).collect()
        assert {(r.doc_id, r.item_id, r.same_values) for r in got} == {
            (1, 1, True), (2, 1, False), (4, 2, False), (None, 2, True), (8, 2, True)}
    clean = decontaminate.decontaminate(clashing(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {3, 5, 6, 7} and clean.columns == clashing(spark, rows).columns
    assert decontaminate.leaks(table(spark, []), bench).count() == 0
    assert decontaminate.leaks(table(spark, rows), table(spark, [], "item_id long, text string")).count() == 0


def test_leaks_asked_again_with_other_values(spark):
    """Items with other numbers and names: caught if and only if the values correspond one to one, as by comparing all slots in turn.

    Joined with the windows sent to all tasks, and with both sides shuffled; one item's text is held by a third of the rows.
    """
    rng = random.Random(3)
    people = ["Tom", "Anna", "Maria", "Peter", "Eve", "Juan"]

    def asked(k, slots):
        r = random.Random(k)
        verbs = [f"v{k}x{r.randrange(50)}" for _ in range(6)]
        a, b, n, m = slots
        return f"then {a} {verbs[0]} with {n} {verbs[1]} and {b} {verbs[2]} another {m} {verbs[3]} so that {a} {verbs[4]} what {b} {verbs[5]}"

    def other():
        return (*rng.sample(people, 2), *map(str, rng.sample(range(2, 99), 2)))

    items = [(k, asked(k, other())) for k in range(12)]
    rows, right = [], set()
    for doc in range(150):
        k = 0 if doc % 3 == 0 else rng.randrange(12)
        text = asked(k, other()) if doc % 5 else asked(k, (*["Eve"] * 2, *other()[2:]))  # one name for two people
        if doc % 7 == 0:
            text = " ".join(text.split()[:9])
        elif doc % 5:
            right.add((doc, k))
        rows.append((doc, words(doc, 40) + " " + text + " " + words(doc + 1, 40)))
    bench = table(spark, items, "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(spark, rows), bench).collect()} == right
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_windows_of_a_long_document_come_in_bounded_rows(spark, monkeypatch):
    text = words(1, 3000, 10**6)
    monkeypatch.setattr(decontaminate, "ROW_WINDOWS", 500)
    batch = pa.RecordBatch.from_pylist([{"doc_id": 1, "text_hash": 5, "text": text}, {"doc_id": 2, "text_hash": 6, "text": None}])
    got = [r for b in decontaminate._document_windows(iter([batch]), [5, 2]) for r in b.to_pylist()]
    raw = text.split()
    assert {r["doc_id"] for r in got} == {1} and max(len(r["hashes"]) for r in got) == 500
    flat = [h for r in got for h in r["hashes"]]
    assert len(flat) == len(set(flat)) == len({tuple(raw[k:k + n]) for n in (5, 2) for k in range(len(raw) - n + 1)})


def test_leaks_against_whole_passages(spark):
    """On the given table, where items are copied word for word: the same documents as a plain search for the passages."""
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_benchmark_decontamination"](spark, FOLDER).collect()}
    items = [(r.item_id, " ".join(r.text.lower().split())) for r in bench.collect()]
    plain = {(r.doc_id, k) for r in docs.collect() for k, t in items if t in " ".join((r.text or "").lower().split())}
    assert plain <= got and len(got) <= len(plain) + 1


def test_classifier_on_held_out_documents(spark):
    """Fitted on half of the ratings of the next larger table, held against the other half."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    model = quality.train(docs, rated.filter("doc_id % 2 = 0"), quality.GRADES)
    assert (np.diff(model.thresholds) > 0).all()
    scored = quality.classify(docs.join(rated.filter("doc_id % 2 = 1"), "doc_id"), model, quality.GOOD)
    right = {r.grade: r.n / r.total for r in scored.groupBy("grade").agg(
        F.sum((F.col("kept") == (F.col("grade") == 2)).cast("int")).alias("n"), F.count("*").alias("total")).collect()}
    assert right[2] > 0.99 and right[1] > 0.9 and right[0] > 0.85


def test_classifier_edges(spark):
    none = table(spark, [], "doc_id long, grade int")
    rows = [(1, None), (2, ""), (2, ""), (None, "good words"), (3, words(1, 30_000))]
    docs = clashing(spark, rows)
    got = quality.classify(docs, quality.train(docs, none, 3), 2)
    assert got.count() == 5 and all(r.kept for r in got.collect()) and got.columns.count("kept") == 1
    ratings = table(spark, [(1, 2), (1, 0), (2, None), (None, 1), (3, 2)], "doc_id long, grade int")
    model = quality.train(docs, ratings, 3)
    assert quality.classify(docs, model, 2).count() == 5
    assert quality.classify(table(spark, []), model, 2).count() == 0


PRIVATE = ["card 4465758382889437 4465758382889437, 4465-7583-8288-9437", "tel +1 (663) 555-6869 or +16635556869", "ip 233.233.171.252",
           "iban DE89 3704 0044 0532 0130 00", "born 1987-03-31, 31.03.1987 and 31/03/1987", "ssn 123-45-6789", "to a.b9@mail2.example.com!"]
INVALID = ["card 4465758382889438", "ip 1.2.3.999", "iban DE88370400440532013000", "on 1987-02-30", "ssn 000-12-3456"]


def test_pseudonyms(spark):
    rows = list(enumerate(PRIVATE + INVALID + [None, "", "plain text 12 of 34", "x" * 50_000]))
    out = pii.pseudonymise(clashing(spark, rows), "key").orderBy("doc_id").collect()
    new = [r.text for r in out]
    for old, got in zip(PRIVATE, new):
        assert len(old.split()) == len(got.split()) and not set(old.split()[1:]) & set(got.split()[1:]) - {"or", "and", "+1"}
    first, second, third = new[0].split()[1:]
    assert first + "," == second and third.replace("-", "") == first  # linked in whatever format
    digits = [int(c) for c in reversed(first)]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    iban = new[3].replace("iban ", "").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    a, b, c = (x.strip(",") for x in new[4].replace("born ", "").replace("and ", "").split())
    assert a.split("-") == b.split(".")[::-1] == c.split("/")[::-1]
    assert new[len(PRIVATE):] == [t for _, t in rows[len(PRIVATE):]]
    assert [r.n_invalid for r in out[len(PRIVATE):len(PRIVATE + INVALID)]] == [1] * len(INVALID)
    back = pii.pseudonymise(table(spark, [(r.doc_id, r.text) for r in out]), "key", undo=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == [t for _, t in rows]
    other = pii.pseudonymise(table(spark, rows), "another key").orderBy("doc_id").collect()
    assert other[0].text != new[0]
    assert pii.pseudonymise(table(spark, []), "key").count() == 0


def test_pseudonyms_are_permutations(spark):
    n = 898
    some = spark.range(n).select(pii.permuted_number(F.col("id"), 2, n // 2, "k", "t").alias("x"))
    assert sorted(r.x for r in some.collect()) == list(range(n))
    text = F.lpad(F.col("id").cast("string"), 3, "0")
    assert spark.range(1000).select(pii.permuted_text(text, "k", "t").alias("x")).distinct().count() == 1000


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("a/LICENSE", mit), ("a/b/COPYING.txt", apache), ("a/b/x.py", "code"), ("a/b/y.py", f"# {mit}\ncode"), ("a/c/d/z.py", None),
            ("q/LICENSE", "all rights reserved"), ("q/x.py", ""), (None, apache), (None, "x"), ("LICENSE", None), ("a/b/x.py", "code")]
    files = table(spark, [(*r, "z") for r in rows], "path string, text string, license string")
    got = licenses.scan(files)
    assert got.columns.count("license") == 1
    assert sorted((str(r.path), r.license, r.license_origin, r.license_dir) for r in got.collect() if r.path) == sorted([
        ("a/LICENSE", "MIT", "file", None), ("a/b/COPYING.txt", "Apache-2.0", "file", None), ("a/b/x.py", "Apache-2.0", "inherited", "a/b/"),
        ("a/b/x.py", "Apache-2.0", "inherited", "a/b/"), ("a/b/y.py", "MIT", "header", None), ("a/c/d/z.py", "MIT", "inherited", "a/"),
        ("q/LICENSE", None, "none", None), ("q/x.py", None, "none", None), ("LICENSE", None, "none", None)])
    assert sorted(r.license_origin for r in got.collect() if r.path is None) == ["header", "none"]
    assert licenses.scan(table(spark, [], files.schema)).count() == 0


def test_ordinary_words_do_not_hide_a_notice(spark):
    """Every word weighs by the files that hold it, also one that is in no template."""
    rows = [(f"a/{k}.txt", "it is all under the sun") for k in range(200)] + [("b/x.py", "It is all released under the MIT License.")]
    got = licenses.scan(table(spark, rows, "path string, text string")).filter("license is not null").collect()
    assert [(r.path, r.license, r.license_origin) for r in got] == [("b/x.py", "MIT", "header")] and got[0].license_score > 0.95


GPL_HEADER = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_standard_headers_and_titles(spark):
    """Standard notices wrapped over comment lines, directly before code, and the titles of licence files."""
    def commented(text, sign):
        return "\n".join(f"{sign} {line}" for line in text.split("\n"))

    rows = [("a/x.py", commented(GPL_HEADER.format(3), "#") + "\nimport os", "GPL-3.0"),
            ("a/y.c", "/*\n" + commented(GPL_HEADER.format(2), " *") + "\n */\nint main;", "GPL-2.0"),
            ("a/z.c", "/* " + MIT_GRANT + " */\nint x;", "MIT"), ("b/x.js", "/*\n" + commented(MIT_GRANT, " *") + "\n */", "MIT"),
            ("c/LICENSE", "   GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright", "GPL-3.0"),
            ("d/LICENSE", "MIT License\n\nCopyright (c) 2020", "MIT"), ("e/LICENSE", "Apache License\nVersion 2.0, January 2004\n", "Apache-2.0"),
            ("f/x.lua", "-- This program is licensed under the GNU General\n-- Public License, version 3.\nlocal x", "GPL-3.0"),
            ("g/x.txt", "MIT", None), ("h/x.txt", "version 2", None)]
    files = table(spark, [r[:2] for r in rows] + [(f"z/{k}.txt", "the software of this program is in a file or a copy") for k in range(50)],
                  "path string, text string")
    got = {r.path: r.license for r in licenses.scan(files).filter("path not like 'z/%'").collect()}
    assert got == {p: name for p, _, name in rows}


def test_short_items_inside_documents(spark):
    """Items of fewer than five template words are found inside a text, and numbers may be spelt out."""
    items = [(1, "What is 12 + 7?"), (2, "Tom has three apples and Anna has twenty more apples"), (3, "12 7"), (4, "capital of France"), (5, "4")]
    rows = [(1, "A quiz says: what is 12 + 7? Nobody answered it."), (2, "A quiz says: what is 30 + 9? Nobody answered it."),
            (3, "so Tom has 5 apples and Anna has 9 more apples at home"), (4, "the codes 12 7 are printed on every single box"),
            (5, "the codes 13 8 are printed on every single box"), (6, "what is 12"), (7, "it is the capital of France indeed"),
            (8, "so Tom has three apples and Anna has twenty more apples at home"), (9, "so Tom has 3 apples and Anna has 20 more apples at home")]
    got = decontaminate.leaks(table(spark, rows), table(spark, items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.same_values) for r in got} == {
        (1, 1, True), (1, 3, True), (2, 1, False), (3, 2, False), (4, 3, True), (7, 4, True), (8, 2, True), (9, 2, True)}


def test_packing_with_the_tokenizer_as_loaded(spark):
    """The strings of added tokens stand for those tokens, also in the registered query's way."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|startoftext|>Hello", "x<|endoftext|>y <|ENDOFTEXT|>", "<|EndOfText|>", "no such <|end", *TEXTS, words(9, 3000) + "<|endoftext|>"]
    got = packing.best_fit(table(spark, list(enumerate(texts))), TOKENIZER, with_ids=True, special=True).collect()
    held = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        held[r.doc_id] += r.ids
    assert held[0] == [320, 49407, 321, 0]
    assert dict(held) == {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}


def test_prints_that_coincide_hide_no_pair(spark):
    """Two sets of 100 shingles with 90 in common, of which ten hide behind the prints of others."""
    subkeys, sketch = list(range(2 * minhash.SIDE)), [0] * minhash._NUMBERS
    nodes = table(spark, [(1, 100, sketch, subkeys, list(range(90))), (2, 100, sketch, subkeys, [*range(80), *range(200, 210)])],
                  "node long, n long, sketch array<long>, subkeys array<long>, prints array<short>")
    keys = table(spark, [(1, 5, 0, 16), (2, 5, 0, 16)], "node long, key long, i int, j int")
    labels = table(spark, [], "node long, component long")
    assert [tuple(r) for r in minhash._across(keys, labels, nodes).collect()] == [(1, 2)]


@pytest.mark.parametrize("first,last", [(0x61, 0x7A), (0x430, 0x44F), (0x4E00, 0x9FA4), (0x3041, 0x3096), (0xAC00, 0xD7A2), (0x1F300, 0x1F5FF)])
def test_cuts_of_every_script_move_with_the_text(spark, first, last):
    """One inserted character changes the chunk that holds it, and no later one."""
    rng = random.Random(first)
    text = "".join(chr(rng.randint(first, last)) for _ in range(20_000))
    a, b = (r.c for r in table(spark, [(1, text), (2, text[:9000] + "Z" + text[9000:])]).select(
        exact_dedup.chunks(F.col("text")).alias("c")).collect())
    assert "".join(a) == text and len(a) > 10 and len(set(a) - set(b)) <= 2 and a[-1] == b[-1]
    assert all(256 <= len(x) <= 4096 for x in a[:-1])


# Those that hold thousands of values take time for each of them and repeat less often; 2,000 turns used to end the process.
ENDLESS = ["x@a" + ".b" * 100_000, "x" * 100_000 + "@a.bc", "x@" + "a" * 100_000, "x@a." + "b" * 100_000, "4" * 100_000, "@" * 100_000,
           "DE89" + " 3704" * 4000, "1.2." * 4000, "+49" + " 123" * 4000, "1234 " * 4000, "123-45-" * 4000, "2020-01-02-" * 4000,
           "+1(" * 4000, "a.b@c-d." * 4000]


def test_pseudonyms_in_endless_repeats(spark):
    got = pii.pseudonymise(table(spark, list(enumerate(ENDLESS))).repartition(8), key="k").collect()
    assert len(got) == len(ENDLESS) and all(len(r.text) == len(ENDLESS[r.doc_id]) for r in got if r.doc_id < 6)


def test_words_outlive_a_task():
    assert packing._table(TOKENIZER, True) is packing._table(TOKENIZER, True)
    assert packing._table(TOKENIZER, True) is not packing._table(TOKENIZER, False)


def test_a_worker_holds_one_table():
    """The words of one operator go when another begins, as all share Spark's worker processes."""
    words_of_packing = weakref.ref(packing._table(TOKENIZER, True))
    words_of_items = weakref.ref(decontaminate._lexicon())
    assert words_of_packing() is None and words_of_items() is decontaminate._lexicon()
    for begin in (minhash._sketches, minhash._sets, quality._featurised):
        decontaminate._lexicon()
        assert list(begin(iter([]))) == [] and not worker_table._held


def test_forgetting_words_keeps_the_ids_of_the_rest(monkeypatch):
    texts = [words(k, 400, 3000).encode() for k in range(40)]
    whole = packing._WordIds(TOKENIZER).documents(texts)
    monkeypatch.setattr(packing, "_WORDS_KEPT", 2000)
    few = packing._WordIds(TOKENIZER)
    for turn in range(2):
        for text, ids in zip(texts, whole):
            assert few.documents([text])[0].tolist() == ids.tolist()
            assert len(few) == len(few.start) == len(few.length) == len(few.seen) <= 2000 and list(few.values()) == list(range(len(few)))


def test_the_word_hashes_of_a_task_stay_small():
    hashes = minhash._WordHashes()
    for k in range(0, 100_000, 1000):
        text = b" ".join(b"w%d %s%d" % (n, b"x" * 1000, n) for n in range(k, k + 1000))
        assert minhash.shingle_set(text, hashes).tolist() == minhash.shingle_set(text, minhash._WordHashes()).tolist()
    assert len(hashes) <= 20_000 and sum(map(len, hashes)) < 2_000_000


def test_a_task_of_the_shingle_sets_has_one_python_process(spark, monkeypatch):
    """However small the tables are, a shuffle lies between the sieve and the shingles."""
    plans = {}

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, label)

    monkeypatch.setattr(minhash, "materialize", noted)
    minhash.near_duplicates(table(spark, near_rows()[:30])).collect()
    counts, above = [], []  # of the Python steps from a node up to the next shuffle; above: (depth, count) of its ancestors
    for line in plans["sets"].splitlines():
        depth = re.search(r"[A-Z]|$", line).start()
        above = [(d, n) for d, n in above if d < depth]
        step = "Exchange" not in line.split("[")[0]
        counts.append(step * ((above or [(0, 0)])[-1][1] + bool(re.search("MapInArrow|ArrowEvalPython", line))))
        above.append((depth, counts[-1]))
    assert max(counts) == 1 and counts.count(1) > 3


def test_items_with_one_id_are_the_largest_text(spark):
    """The longer text first, the shorter one first, in one partition and in several."""
    long, short = "zebra " + words(1, 30), "apple pear plum"
    docs = table(spark, [(1, "before " + long + " after"), (2, words(9, 40))])
    for rows in ([(7, long), (7, short)], [(7, short), (7, long)], [(7, long), (7, long), (8, None), (None, long)]):
        for parts in (1, 3):
            found = decontaminate.leaks(docs, table(spark, rows, "item_id long, text string").repartition(parts)).collect()
            assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)]


def test_a_repeated_id_stays_within_the_sample(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(quality, "fit", lambda rows, grades: taken.append(len(rows)))
    docs = table(spark, [(1, f"text number {k}") for k in range(3000)] + [(k, "another") for k in range(2, 30)])
    ratings = table(spark, [(k, k % 3) for k in range(1, 30)], "doc_id long, grade int")
    quality.train(docs, ratings, 3, sample=10)
    quality.train(docs, ratings.filter("doc_id = 1"), 3, sample=10)
    assert taken == [10, 1]


def test_sieve(spark):
    """Every key passes, of the rest few do, and a null is a value; a table without keys lets nothing pass."""
    keys = spark.range(0, 90_000, 3).withColumn("t", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")))
    rows = spark.range(90_000).withColumn("t", F.when(F.col("id") % 2 == 0, F.col("id").cast("string")))
    passed = {r.id for r in rows.filter(sieve(keys, "id", "t")("id", "t")).collect()}
    assert passed >= set(range(0, 90_000, 3)) and len(passed) < 36_000
    assert rows.filter(sieve(keys.filter("id < 0"), "id")("id")).isEmpty()


def test_near_duplicates_leave_no_wide_table(spark):
    """Sketches, entries and shingle sets go once they are read."""
    def held():
        return {p.name for p in Path(shared_root(spark).removeprefix("file:")).iterdir()}

    before = held()
    minhash.near_duplicates(table(spark, near_rows()[:30])).collect()
    assert not {name.partition("-")[0] for name in held() - before} & {"sketches", "nodes", "members", "keys", "entries", "sets"}

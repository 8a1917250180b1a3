"""Benchmark decontamination by canonical templates and consistent slots.

Words become a template: numbers, units and names are typed placeholders, all
else is lower case without punctuation. Five-word windows of the templates are
joined with those of the benchmark. A document that holds enough of an item's
windows in one stretch is checked for its slots: each value of the item must
stand for one value of the document throughout, and the other way round. So a
question asked again with other numbers or names is caught, and a text that only
shares the pattern by accident is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.worker_table import worker_table
from tallymark.session import materialize

WINDOW = 5
PERCENT = 75  # of an item's windows; an item of fewer than five template words is one window of its own width
ROW_WINDOWS = 1 << 16  # of a document in one row
TOGETHER = 1 << 18  # characters of documents whose templates are made at once
# Units by their usual signs, for the typed placeholder.
UNITS = frozenset("""
mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms mph kmh km/h kwh w kw v a hz khz mhz ghz b kb mb gb
tb usd eur gbp dollar dollars euro euros pound pounds cent cents percent meter meters metre metres kilometer kilometers
kilometre kilometres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres second seconds
minute minutes hour hours day days week weeks month months year years celsius fahrenheit degree degrees
""".split())
# Spelt-out numbers; one that is joined by a hyphen is taken apart below.
NUMBER_WORDS = dict(zip("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
""".split(), range(20))) | dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10))) | {
    "hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9}
_EDGE = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*%?[$€£]?")
_NUMBER_WITH_UNIT = re.compile(r"([$€£]?\d+(?:[.,]\d+)*)([a-zµ°/]+|%)")
_SENTENCE_END = re.compile(r"[.!?:;]['\")\]]*$")
_AFTER_END = frozenset(".!?:;'\")]")
_SIGNS = ".,!?;:&*#|"
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


def _spelt(low: str) -> str | None:
    """The digits of a spelt-out number: of ``three``, ``twenty`` or ``twenty-three``."""
    if low in NUMBER_WORDS:
        return str(NUMBER_WORDS[low])
    tens, hyphen, ones = low.partition("-")
    if hyphen and 20 <= NUMBER_WORDS.get(tens, 0) < 100 and 0 < NUMBER_WORDS.get(ones, 0) < 10:
        return str(NUMBER_WORDS[tens] + NUMBER_WORDS[ones])
    return None


def _parts(word: str) -> tuple[list[tuple[str, str]], bool]:
    """[(kind, lower-case value)] of a raw word, and whether a capital starts it. Kinds: a placeholder or '' for a plain word."""
    bare = _EDGE.sub("", word)
    low = bare.lower()
    if not bare:
        return [], False
    if _NUMBER.fullmatch(bare):
        return [(NUM, low)], False
    if (digits := _spelt(low)) is not None:
        return [(NUM, digits)], False
    if (m := _NUMBER_WITH_UNIT.fullmatch(low)) and (m[2] in UNITS or m[2] == "%"):
        return [(NUM, m[1]), (UNIT, m[2])], False
    return [("", low)], bare[0].isupper()


class _Lexicon(dict):
    """Number of each raw word; arrays by that number hold what the template needs."""

    MOST = 400_000

    def __init__(self) -> None:
        self._arrays(self.MOST)

    def _arrays(self, n: int) -> None:
        self.most = n
        self.codes = np.zeros((n, 2), np.uint64)
        self.size = np.zeros(n, np.int64)  # template words
        self.first, self.unit, self.capital, self.ends, self.open_left, self.open_right = np.zeros((6, n), bool)

    def learn(self, raw: list[str]) -> None:
        """Enters the words of a text; starts anew when there is no room for them."""
        new = set(filterfalse(self.__contains__, set(raw)))
        if len(self) + len(new) > self.most:
            self.clear()
            new = set(raw)
            self._arrays(max(self.MOST, len(new)))
        if not new:
            return
        # Most words are letters and perhaps signs behind them; the rest goes the general way.
        bare = [word.rstrip(_SIGNS) for word in new]
        low = [word.lower() for word in bare]
        simple = [b.isalpha() and k not in NUMBER_WORDS for b, k in zip(bare, low)]
        here = slice(len(self), len(self) + len(new))
        self.codes[here, 0] = np.fromiter(map(xxhash.xxh64_intdigest, low), np.uint64, len(new))
        self.codes[here, 1], self.size[here], self.first[here] = 0, 1, False
        self.unit[here] = [k in UNITS for k in low]
        self.capital[here] = [b[:1].isupper() for b in bare]
        self.ends[here] = [word[-1] in _AFTER_END and _SENTENCE_END.search(word) is not None for word in new]
        self.open_left[here] = [word[0].isalnum() for word in new]
        self.open_right[here] = [word[-1].isalnum() for word in new]
        for k, (word, plain) in enumerate(zip(new, simple), here.start):
            if not plain:
                parts, self.capital[k] = _parts(word)
                self.codes[k] = ([xxhash.xxh64_intdigest(kind or value) for kind, value in parts] + [0, 0])[:2]
                self.size[k], self.first[k] = len(parts), bool(parts) and parts[0][0] == NUM
                self.unit[k] = bool(parts) and parts[-1][1] in UNITS
        self.update(zip(new, range(here.start, here.stop)))


def _lexicon() -> _Lexicon:
    """The words of a worker process, kept from task to task; it starts anew when it is full."""
    return worker_table(_Lexicon)


def _template(raw: list[str], known: _Lexicon, names: bool | None = None, inside: bool = False, sizes: list[int] | None = None):
    """Template codes of the raw words; of each its raw word, if it is the second of that, its raw words, if it is a slot, and its text.

    A name is a run of capitalised words inside a sentence of a text that is written
    mostly in small letters; after a sentence end a capital says nothing, and signs
    divide runs. ``names`` and ``inside`` (the text starts inside a sentence) override that.
    The words may be those of several texts in a row, ``sizes`` of each; then ``inside`` has to be false.
    """
    known.learn(raw)
    bounds = np.concatenate([[0], np.cumsum(sizes if sizes is not None else [len(raw)], dtype=np.int64)])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    numbers = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
    size, capital = known.size[numbers], known.capital[numbers]
    inner = np.ones(len(raw), bool)
    inner[1:] = ~known.ends[numbers[:-1]]
    inner[bounds[:-1][np.diff(bounds) > 0]] = inside
    if names is None:
        some = inner & (size > 0)
        held, capitals = (np.diff(np.concatenate([[0], np.cumsum(kind)])[bounds]) for kind in (some, capital & some))
        names = (3 * capitals < held)[text]
    name = capital & inner & names
    # The words of a name behind its first are no template words of their own.
    more = np.zeros(len(raw), bool)
    more[1:] = name[1:] & name[:-1] & known.open_right[numbers[:-1]] & known.open_left[numbers[1:]]
    heads = np.flatnonzero(~more)
    length = np.ones(len(raw), np.int64)
    length[heads] = np.diff(heads, append=len(raw))
    at = np.repeat(np.arange(len(raw)), np.where(more, 0, size))
    second = np.concatenate([[False], at[1:] == at[:-1]]) if len(at) else np.empty(0, bool)
    word = numbers[at]
    codes = np.where(second, known.codes[word, 1], known.codes[word, 0])
    number = np.where(second, False, known.first[word])
    ended = np.zeros(len(at), bool)
    ended[1:] = number[:-1] & (text[at[1:]] == text[at[:-1]])
    unit = second | (known.unit[word] & ended & ~number)
    codes = np.where(unit, _UNIT_CODE, np.where(name[at] & ~second, _NAME_CODE, codes))
    return codes, at, second, length[at], number | unit | (name[at] & ~second), text[at]


_UNIT_CODE, _NAME_CODE = (np.uint64(xxhash.xxh64_intdigest(k)) for k in (UNIT, NAME))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` template words."""
    n = len(codes) - width + 1
    if not width or n < 1:
        return np.empty(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n]
        total ^= total >> np.uint64(29)
    return total


def _values(raw: list[str], at: np.ndarray, second: np.ndarray, length: np.ndarray) -> list[str]:
    return [_parts(raw[k])[0][int(two)][1] if n == 1 else " ".join(_parts(word)[0][0][1] for word in raw[k:k + n])
            for k, two, n in zip(at.tolist(), second.tolist(), length.tolist())]


def _readings(raw: list[str], known: _Lexicon):
    """(template, window hashes) of an item under every reading of its capitals that differs from the others.

    An item may stand inside a sentence of a document, and the document as a whole may use capitals in another way.
    """
    seen = set()
    for names in (True, False):
        for inside in (True, False):
            template = _template(raw, known, names, inside)
            own = window_hashes(template[0], min(WINDOW, len(template[0])))
            if len(own) and template[0].tobytes() not in seen:
                seen.add(template[0].tobytes())
                yield template, own


@lru_cache(maxsize=4096)
def _item(body: str) -> list[tuple[list[int], list[str]]]:
    """(window hashes, values) of each reading; kept from document to document, as many hold the same item."""
    raw = body.split()
    return [(own.tolist(), _values(raw, at, second, length)) for (_, at, second, length, *_), own in _readings(raw, _lexicon())]


class _Items:
    """Templates of some items in all their readings, by window hash."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.item, self.values, self.n = [], [], []  # by reading
        entries = []
        for item, body in rows:
            for own, values in _item(body):
                entries += [(h, len(self.item), place) for place, h in enumerate(own)]
                self.item.append(item)
                self.values.append(values)
                self.n.append(len(own))
        entries.sort()
        self.widths = sorted({min(WINDOW, len(v)) for v in self.values})
        self.hashes = np.array([h for h, _, _ in entries], np.uint64)
        self.owners = np.array([reading for _, reading, _ in entries], np.int64)
        self.places = np.array([place for _, _, place in entries], np.int64)

    def hits(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, window of the document)"""
        low, high = (np.searchsorted(self.hashes, own, side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(np.arange(len(own)), n)
        return np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at], at


def _matches(items: _Items, raw: list[str], known: _Lexicon, percent: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(item, hit windows, its windows, first template word, last one, same values) for each item that the text holds."""
    codes, at_raw, second, length, slot, _ = _template(raw, known)
    own = [window_hashes(codes, width) for width in items.widths]
    if not own:
        return []
    starts = np.concatenate([np.arange(len(h)) for h in own])
    entry, at = items.hits(np.concatenate(own))
    if not len(entry):
        return []
    at = starts[at]
    reading, n = np.unique(items.owners[entry], return_counts=True)
    needed = np.array([items.n[k] for k in reading.tolist()])
    likely = reading[100 * n >= percent * needed]
    if not len(likely):
        return []
    values = _values(raw, at_raw, second, length)
    best = {}
    for own in likely.tolist():
        mine = items.owners[entry] == own
        place, window = items.places[entry[mine]], at[mine]
        width = min(WINDOW, len(items.values[own]))
        # Windows of one copy lie on one diagonal, or on near ones where words were put in or left out.
        zone = (window - place) // (2 * WINDOW)
        for z in np.unique(zone).tolist():
            near = (zone == z) | (zone == z + 1)
            there, back, hit, kept = {}, {}, set(), []
            for w, p in sorted(set(zip(window[near].tolist(), place[near].tolist()))):
                pairs = [(items.values[own][p + k], values[w + k]) for k in range(width) if slot[w + k]]
                if width < WINDOW and len(pairs) == width and any(a != b for a, b in pairs):
                    continue  # other values throughout and no plain word: nothing is shared but the kinds
                if all(there.get(a, b) == b and back.get(b, a) == a for a, b in pairs) and len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    there.update(pairs)
                    back.update((b, a) for a, b in pairs)
                    hit.add(p)
                    kept.append(w)
            if hit and 100 * len(hit) >= percent * items.n[own]:
                found = (len(hit), -min(kept), max(kept) + width - 1, all(a == b for a, b in there.items()), items.n[own])
                item = items.item[own]
                best[item] = max(best[item], found) if item in best else found
    return [(item, hits, n, -first, last, same) for item, (hits, first, last, same, n) in best.items()]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per reading of an item and distinct window: its hash, and how many windows of the reading have it."""
    known = _lexicon()
    for batch in batches:
        rows = []
        for item, body in zip(batch.column("item").to_pylist(), batch.column("body").to_pylist()):
            for reading, ((codes, *_), own) in enumerate(_readings(body.split(), known)):
                hashes, places = np.unique(own.view(np.int64), return_counts=True)
                rows += [(h, item, reading, len(own), min(WINDOW, len(codes)), n) for h, n in zip(hashes.tolist(), places.tolist())]
        columns = zip(*rows) if rows else ((),) * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["hash", "item", "reading", "n_windows", "width", "places"])


def _together(texts: list[str | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """(first text, words of each) of texts that are taken together, about ``TOGETHER`` characters."""
    start, held, raw = 0, 0, []
    for at, text in enumerate(texts):
        raw.append((text or "").split())
        held += len(text or "")
        if held >= TOGETHER:
            yield start, raw
            start, held, raw = at + 1, 0, []
    if raw:
        yield start, raw


def _distinct_windows(raw: list[list[str]], known: _Lexicon, widths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct windows of several texts, in the order of the texts."""
    codes, *_, text = _template(list(chain.from_iterable(raw)), known, sizes=[len(words) for words in raw])
    found = []
    for width in widths:
        first, last = text[:max(len(text) - width + 1, 0)], text[width - 1:]
        found.append((first[first == last], window_hashes(codes, width)[first == last]))
    owner, hashes = (np.concatenate(column) for column in zip(*found))
    if len(widths) > 1:
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    bounds = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], hashes[new].view(np.int64)


def _document_windows(batches: Iterator[pa.RecordBatch], widths: list[int]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each document, in rows of at most ``ROW_WINDOWS``."""
    known = _lexicon()
    for batch in batches:
        for start, raw in _together(batch.column("text").to_pylist()):
            owner, hashes = _distinct_windows(raw, known, widths)
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            heads = np.flatnonzero(place % ROW_WINDOWS == 0)
            taken = pa.array(start + owner[heads])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(taken), batch.column("text_hash").take(taken),
                 pa.ListArray.from_arrays(pa.array(np.append(heads, len(owner)), pa.int32()), pa.array(hashes))],
                names=["doc_id", "text_hash", "hashes"])


def _check_slots(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The items that a document holds, of those that it shares enough windows with."""
    known = _lexicon()
    for batch in batches:
        rows, found = [], []
        for at, (text, items) in enumerate(zip(batch.column("text").to_pylist(), batch.column("items").to_pylist())):
            for match in _matches(_Items([(i["item"], i["body"]) for i in items]), text.split(), known, percent):
                rows.append(at)
                found.append(match)
        item, hit, windows, first, last, same = zip(*found) if found else ((),) * 6
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(taken), batch.column("text_hash").take(taken),
             pa.array(item, pa.int64()), pa.array(hit, pa.int64()), pa.array(windows, pa.int64()),
             pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(same, pa.bool_())],
            names=["doc_id", "text_hash", "item_id", "n_hit", "n_windows", "first_word", "last_word", "same_values"])


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_hit, n_windows, first_word, last_word, same_values) per document and item it holds.

    An item is held from ``percent`` of its template windows on, in one stretch
    and with consistent slots; ``same_values`` is false where it was asked again
    with other numbers, units or names; a name is one or several capitalised words in a row. An item of fewer than five template words is
    held where all of them stand in a row, and one that is nothing but numbers, units
    and names only with its own values. A spelt-out number counts as its digits, word
    by word: ``two hundred`` is two numbers. Item ids are whole numbers. The words count the template words of the
    whole text from 0. Of several stretches the one with most windows counts, then
    the first. Null and empty texts or items match nothing. Rows alike in id and
    text give equal rows; items with one id are one item, of which the largest text
    counts. Other columns are ignored; empty tables give no rows.

    The windows of items and documents are joined by hash; Spark sends the items' to all
    tasks where their table is small and shuffles both sides where it is not. Documents
    that share ``percent`` of an item's windows meet its text, and their slots are checked.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    key = f"doc_id {id_type}, text_hash long"
    items = materialize(benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull())
                        .groupBy(F.col(item_col).cast("long").alias("item")).agg(F.max(item_text_col).alias("body")), "items")
    windows = materialize(items.mapInArrow(
        _item_windows, "hash long, item long, reading long, n_windows long, width long, places long"), "item_windows")
    widths = [r.width for r in windows.select("width").distinct().collect()]  # at most WINDOW of them
    held = texts.filter(F.lit(bool(widths))).mapInArrow(partial(_document_windows, widths=widths), f"{key}, hashes array<long>") \
        .select("doc_id", "text_hash", F.explode("hashes").alias("hash")) \
        .join(windows.drop("width"), "hash").groupBy("doc_id", "text_hash", "item", "reading", "n_windows") \
        .agg(F.sum("places").alias("n")).filter(F.col("n") * 100 >= F.col("n_windows") * percent)
    likely = materialize(held.select("doc_id", "text_hash", "item").distinct().join(items, "item")
                         .groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
                         .agg(F.collect_list(F.struct("item", "body")).alias("items")), "likely")
    return texts.join(likely, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))) \
        .select("doc_id", "text_hash", "text", "items").mapInArrow(
            partial(_check_slots, percent=percent),
            f"{key}, item_id long, n_hit long, n_windows long, first_word long, last_word long, same_values boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark; all columns stay as they are."""
    held = materialize(leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options)
                       .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct(), "leaks")
    return docs.join(held, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")

"""Benchmark decontamination: windows of benchmark words are found in training texts and taken out.

The benchmark's windows are cut into blocks of bounded size, and each block is broadcast as a
hash set: a number for each word that occurs in it, and the hashes of its windows in order. A task
turns its texts into word numbers, hashes every window that holds none but known words, looks the
hashes up and compares the words of what it finds. A benchmark of any size thus needs no shuffle
of the texts, only one reading of them for each block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import filed, located, quoted, small_batches
from clustercat.storage import keep

WINDOW = 10
BLOCK_BYTES = 32 << 20
# Words beyond this length are known by their digest, so that a window's size is bounded.
LONG_WORD = 64
STRETCH = 1 << 18

# A word is a run of a to z, 0 to 9 and all bytes of signs beyond ASCII; A to Z are lowered.
_letters = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
_gap = re.compile(rb" ")
_MARK = b"\x01"  # between texts; no word holds it


def _words(lowered: bytes) -> list[bytes]:
    words = lowered.split()
    if max(map(len, words), default=0) > LONG_WORD:
        words = [w if len(w) <= LONG_WORD else b"\x02" + hashlib.sha256(w).hexdigest().encode() for w in words]
    return words


def _blocks(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists from about ``size`` bytes each."""
    start = 0
    while start < len(text):
        lowered = text[start : start + size].translate(_letters)
        stop = start + size
        if stop < len(text):
            # A word cut by the block's end is read to its end.
            parts = [lowered]
            while (more := text[stop : stop + size].translate(_letters)) and not (gap := _gap.search(more)):
                parts.append(more)
                stop += size
            if more:
                parts.append(more[: gap.start()])
                stop += gap.start()
            lowered = b"".join(parts)
        yield _words(lowered)
        start = stop


def benchmark_windows(benchmark: DataFrame, item_column: str, text_column: str, window: int) -> DataFrame:
    """``item, words``: the windows of each item, its words joined by blanks; repeats once an item.

    An item of fewer words is one window; one of no words has none.
    """
    small_batches(benchmark)
    source = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("binary").alias("text"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item", pa.string()), ("words", pa.binary())])
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                before: list[bytes] = []
                whole = False
                for words in _blocks(text or b""):
                    words = before + words
                    found = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
                    whole = whole or bool(found)
                    before = words[max(len(words) - window + 1, 0) :]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], schema=schema)
                if before and not whole:
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(before)], pa.binary())], schema=schema)

    return source.mapInArrow(convert, "item string, words binary").distinct()


class WindowSet:
    """A block of windows as a hash set over word numbers, and the items of each."""

    def __init__(self, rows: list[tuple[str | None, bytes]]):
        windows = sorted({words for _, words in rows})
        at = {words: k for k, words in enumerate(windows)}
        split = [words.split() for words in windows]
        # 0 is any word that is in no window, 1 the mark between texts.
        names = sorted({w for words in split for w in words})
        self.number = {w: k for k, w in enumerate(names, 2)} | {_MARK: 1}
        items = sorted({item for item, _ in rows if item is not None})
        name = {item: k for k, item in enumerate(items)}
        links = np.array([(at[words], name[item]) for item, words in rows if item is not None], np.int64).reshape(-1, 2)
        links = links[np.argsort(links[:, 0], kind="stable")]
        self.items, self.item_of = np.array(items, object), links[:, 1]
        self.starts = np.searchsorted(links[:, 0], np.arange(len(windows) + 1))
        # Windows of each length: their hashes in order, word numbers and places in ``windows``.
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for k, words in enumerate(split):
            by_size.setdefault(len(words), []).append(k)
        for size, places in by_size.items():
            numbers = np.array([[self.number[w] for w in split[k]] for k in places], np.int64)
            hashes = self.hashes(numbers.ravel(), size)[::size]
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = hashes[order], numbers[order], np.array(places, np.int64)[order]

    @staticmethod
    def hashes(numbers: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit polynomial hash of each run of ``size`` numbers."""
        n = len(numbers) - size + 1
        mixed = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros(max(n, 0), np.uint64)
        for k in range(size if n > 0 else 0):
            out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and window of each occurrence in a sequence of word numbers."""
        found = [(np.zeros(0, np.int64),) * 3]
        for size, (hashes, windows, places) in self.sizes.items():
            for start in range(0, len(numbers), STRETCH):
                part = numbers[start : start + STRETCH + size - 1]
                if len(part) < size:
                    break
                # Only runs of known words are hashed: those with no other word up to their end.
                strange = np.concatenate([[0], np.cumsum(part < 2)])
                begins = np.flatnonzero(strange[size:] == strange[:-size])
                if not len(begins):
                    continue
                keys = self.hashes(part, size)[begins]
                at = np.searchsorted(hashes, keys)
                # Equal hashes stand together; each of them is compared word by word.
                while len(begins):
                    close = at < len(hashes)
                    close[close] = hashes[at[close]] == keys[close]
                    begins, keys, at = begins[close], keys[close], at[close]
                    same = (part[begins[:, None] + np.arange(size)] == windows[at]).all(axis=1)
                    found.append((start + begins[same], np.full(same.sum(), size), places[at[same]]))
                    begins, keys, at = begins[~same], keys[~same], at[~same] + 1
        return tuple(np.concatenate(c) for c in zip(*found))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The union of the runs, as (first word, word behind the last) in order."""
    spans: list[list[int]] = []
    for start, stop in sorted(zip(starts.tolist(), (starts + lengths).tolist())):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    return [tuple(s) for s in spans]


def scan_texts(windows: WindowSet, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Number of words, spans of hit words and item names of each text, all texts in one sequence."""
    numbers, counts = [], []
    mark = np.array([1], np.int32)
    for text in texts:
        count = 0
        for words in _blocks(text or b""):
            numbers.append(windows.numbers(words))
            count += len(words)
        numbers.append(mark)
        counts.append(count)
    line = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
    starts, lengths, places = windows.find(line)
    begins = np.cumsum([0, *(c + 1 for c in counts)])
    order = np.argsort(starts, kind="stable")
    starts, lengths, places = starts[order], lengths[order], places[order]
    cuts = np.searchsorted(starts, begins)
    rows = []
    for k, count in enumerate(counts):
        i, j = cuts[k], cuts[k + 1]
        if i == j:
            rows.append((count, [], []))
            continue
        used = np.unique(places[i:j])
        names = np.unique(np.concatenate([windows.item_of[windows.starts[w] : windows.starts[w + 1]] for w in used]))
        rows.append((count, _spans(starts[i:j] - begins[k], lengths[i:j]), windows.items[names].tolist()))
    return rows


def _window_blocks(benchmark: DataFrame, item_column: str, text_column: str, window: int, block_bytes: int):
    """The benchmark's windows as sets of about ``block_bytes`` each, one at a time; one empty set if there are none."""
    windows = keep(benchmark_windows(benchmark, item_column, text_column, window), "windows")
    size = F.length("words") + F.coalesce(F.length("item"), F.lit(0)) + 16
    total = windows.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == block)
        yield WindowSet([(r["item"], bytes(r["words"])) for r in part.collect()])  # bounded by block_bytes


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``_cc_file, _cc_row, id, n_words, spans, items``, one row per row of ``docs``.

    ``spans`` are the runs ``(first, stop)`` of words that lie in an occurrence of a window, in order
    and apart; ``items`` the names of the items whose windows occur, as strings in order. Null and
    empty texts have no words. An item of fewer than ``window`` words is one window, one of none has
    none; items that share an id are one item, and those without an id hit words but are not
    named. Repeated rows and ids are texts of their own; a null id stays null; an empty table gives no rows, an
    empty benchmark no hits; other columns are ignored. A block of windows, about ``block_bytes``
    of them, is on the driver and in a task at a time.
    """
    docs = filed(docs)
    small_batches(docs)
    source = located(docs).select("_cc_file", "_cc_row", F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"_cc_file long, _cc_row long, id {kind}, n_words long, spans array<struct<first:long,stop:long>>, items array<string>"
    context = docs.sparkSession.sparkContext
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))

    def scanned(shared, first: bool) -> DataFrame:
        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = scan_texts(shared.value, batch.column(3).to_pylist())
                # All rows once, and only those with hits from further blocks.
                kept = [k for k, r in enumerate(rows) if first or r[1]]
                out = batch.take(pa.array(kept, pa.int64()))
                columns = [
                    pa.array([rows[k][0] for k in kept], pa.int64()),
                    pa.array([[{"first": i, "stop": j} for i, j in rows[k][1]] for k in kept], span_type),
                    pa.array([rows[k][2] for k in kept], pa.list_(pa.string())),
                ]
                names = ["_cc_file", "_cc_row", "id", "n_words", "spans", "items"]
                yield pa.RecordBatch.from_arrays([*out.columns[:3], *columns], names)

        return source.mapInArrow(convert, schema)

    found = None
    for windows in _window_blocks(benchmark, item_column, item_text_column, window, block_bytes):
        shared = context.broadcast(windows)
        part = keep(scanned(shared, found is None), "contamination")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return part if found is part else _merged(found, schema, span_type)


def _merged(found: DataFrame, schema: str, span_type: pa.DataType) -> DataFrame:
    """One row per text from the rows that the blocks found."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = [], []
            for runs, names in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                runs = np.array([(s["first"], s["stop"]) for part in runs for s in part], np.int64).reshape(-1, 2)
                spans.append([{"first": i, "stop": j} for i, j in _spans(runs[:, 0], runs[:, 1] - runs[:, 0])])
                items.append(sorted({name for part in names for name in part}))
            columns = [*batch.columns[:4], pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    rows = found.groupBy("_cc_file", "_cc_row").agg(
        F.first("id").alias("id"), F.max("n_words").alias("n_words"),
        F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"),
    )
    return rows.mapInArrow(merge, schema)


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans; what stands between them and other words stays."""
    signs = np.frombuffer(text.translate(_letters), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(signs, prepend=False, append=False))
    parts, at = [], 0
    for s in spans:
        parts.append(text[at : edges[2 * s["first"]]])
        at = int(edges[2 * s["stop"] - 1])
    return b"".join([*parts, text[at:]])


def remove_contamination(docs: DataFrame, found: DataFrame, text_column: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` without the words that :func:`find_contamination` found, or, if ``whole``, without the texts that hold any.

    All columns stay, in their order; texts without hits are returned as they are.
    """
    docs = filed(docs)
    place = ["_cc_file", "_cc_row"]
    hits = keep(found.filter(F.size("spans") > 0).select(*place, F.col("spans").alias("_cc_spans")), "hits")
    rows = located(docs)
    clean = rows.join(hits.select(*place), place, "left_anti").select(*quoted(docs.columns))
    if whole:
        return clean
    small_batches(docs)
    hit = rows.join(hits, place).select(*quoted(docs.columns), "_cc_spans")
    at = docs.columns.index(text_column)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(at).to_pylist(), batch.column(len(batch.columns) - 1).to_pylist())
            columns = batch.columns[:-1]
            columns[at] = pa.array([cut_words(text.encode(), spans).decode() for text, spans in texts], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return clean.unionByName(hit.mapInArrow(cut, docs.schema))

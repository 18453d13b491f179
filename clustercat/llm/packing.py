"""Packing token sequences by minimum bin slack over their lengths.

What has to be decided depends on the lengths alone, of which there are at most
``capacity`` different ones however many texts there are. So the texts are cut and
counted by length in Spark; the bins' patterns are found on that histogram; and each
piece finds its bin from its number among the pieces of its length.

One bin: the longest length left is taken, and a bitset of reachable sums over the
other lengths gives the fullest combination with it. The pattern is applied as
often as the counts allow, then removed.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import positions, small_batches, word_blocks
from clustercat.storage import keep

CAPACITY = 2048
REMEMBERED_WORDS = 1_000_000


_ascii_parts = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


def _parts(word: bytes) -> list[str]:
    """Parts of a word that the tokenizer codes one by one; the whole word where that isn't certain.

    Apostrophes make contractions and ``<|`` may open a special token. Outside ASCII,
    normalisation may join letters, so there only closing marks behind a letter are taken off.
    """
    if b"'" in word or b"<|" in word:
        return [word.decode()]
    if word.isascii():
        return _ascii_parts.findall(word.lower().decode())
    text = word.decode()
    core = text.rstrip(".,;:!?")
    return [core, text[len(core) :]] if core != text and core.lower()[-1:].isalpha() else [text]


class WordTokens:
    """Ids of texts by a tokenizer that never joins across white space, a word at a time.

    The vocabulary's pre-tokenizer takes runs of letters, single digits and runs of other
    characters apart and writes all in lower case, so a word is put together from the ids of such
    parts where it surely falls apart that way (see :func:`_parts`). Ids are kept as the bytes of
    little-endian 32-bit numbers. Words and parts are remembered, up to ``remembered`` each;
    then the memory starts anew.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _code_runs(self, runs: list[str]) -> None:
        """Remember the ids of new runs of a to z, coded together as each is one word with one end."""
        for at in range(0, len(runs), 10_000):
            part = runs[at : at + 10_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.parts.update(zip(part, (data[i:j] for i, j in zip([0, *stops], stops))))

    def _code_others(self, parts: list[str]) -> None:
        for at in range(0, len(parts), 10_000):
            part = parts[at : at + 10_000]
            for name, coded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.parts[name] = np.array(coded.ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        plain = [w for w in words if w.isalpha()]  # of bytes: a to z in either case
        names = [w.lower().decode() for w in plain]
        mixed = [w for w in words if not w.isalpha()]
        split = [_parts(w) for w in mixed]
        pieces = {p for parts in split for p in parts}
        runs = {p for p in pieces if p.isascii() and p.isalpha()}
        self._code_runs(list(runs.union(names).difference(self.parts)))
        self._code_others(list((pieces - runs).difference(self.parts)))
        known = self.parts
        self.words.update(zip(plain, map(known.__getitem__, names)))
        for word, parts in zip(mixed, split):
            self.words[word] = b"".join([known[p] for p in parts])

    def encode(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text in order, as pieces of bounded size of their bytes."""
        if text.isascii() and b"<|" not in text:
            text = text.lower()
        for words in word_blocks(text):
            if max(len(self.words), len(self.parts)) > self.remembered:
                self.words, self.parts = {}, {}
            if new := set(words).difference(self.words):
                self._learn(new)
            yield b"".join(map(self.words.__getitem__, words))


_tokens: dict[str, WordTokens] = {}


def tokens_of(path: str, remembered: int) -> WordTokens:
    """The worker's tokenizer for a vocabulary file, made once."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path, remembered)
    return _tokens[path]


def pieces(
    docs: DataFrame, id_column: str, text_column: str, tokenizer: str, capacity: int, remembered: int, end_id: int = 0
) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: each text's ids and ``end_id``, cut at multiples of ``capacity``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer, remembered)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for row, text in enumerate(batch.column(1)):
                piece, room, crc = 0, 4 * capacity, 0
                for ids in chain(tokens.encode((text.as_py() or "").encode()), [end]):
                    at = 0
                    while at < len(ids):
                        if not room:
                            _add(rows, row, piece, capacity, capacity, crc)
                            piece, room, crc = piece + 1, 4 * capacity, 0
                        part = ids[at : at + room]
                        crc = zlib.crc32(part, crc)
                        at, room = at + len(part), room - len(part)
                _add(rows, row, piece, capacity, capacity - room // 4, crc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    pa.array(rows[1], pa.int32()),
                    pa.array(rows[2], pa.int64()),
                    pa.array(rows[3], pa.int64()),
                    pa.array(rows[4], pa.int64()),
                ],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    small_batches(docs)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(convert, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _add(rows: list[list], row: int, piece: int, capacity: int, length: int, crc: int) -> None:
    for column, value in zip(rows, (row, piece, piece * capacity, length, crc)):
        column.append(value)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Length to number: a combination of the available lengths with the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:  # multiplicities by doubling parts
            take = min(step, left)
            layers.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(layers):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns ``(repeats, {length: number in each bin})`` that use up the histogram, fullest bins first."""
    left, found = dict(histogram), []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        pattern = fullest(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(left[length] // n for length, n in pattern.items())
        for length, n in pattern.items():
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
        found.append((repeats, pattern))
    return found


def _places(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows ``length, first number, first bin, pieces a bin, offset in the bin``, sorted."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for repeats, pattern in patterns:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length, used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + n * repeats
            offset += n * length
        bins += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    remembered: int = REMEMBERED_WORDS,
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the path of a vocabulary file that every worker has, whose pre-tokenizer
    separates at white space; a worker remembers the ids of ``remembered`` words. Null texts are empty: one piece with the end id alone. Texts of more
    than ``capacity`` ids are cut, and only those. Repeated rows and ids are texts of their
    own; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    cut = keep(pieces(docs, id_column, text_column, tokenizer, capacity, remembered), "pieces")
    # One row for each length: at most ``capacity`` rows, whatever the corpus.
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = _places(bin_patterns(histogram, capacity))
    numbered = positions(cut, ["length"], ["id", "piece", "ids_crc32"])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = places[:, 0] << 48 | places[:, 1]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = places[np.searchsorted(order, length << 48 | number, side="right") - 1]
            inside = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 2] + inside // row[:, 3]), pa.array(row[:, 4] + inside % row[:, 3] * length)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    schema = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return numbered.select("id", "piece", "start", "length", "ids_crc32", "_pos").mapInArrow(convert, schema)

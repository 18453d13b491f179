"""Alignment of two tokenizers' tokens over the same texts, and how strongly ids are linked.

Both token sequences of a text are arrays of byte offsets at which tokens end. Where tokens
of both end together a group ends. The arrays are compared along a diagonal, ``b``'s index less
``a``'s: steps that double find how long the ends stay equal, so a stretch of groups of
one token each is jumped over in few comparisons. Where the ends part, the group is walked to the
next common end, and the diagonal shifts by the difference of its token numbers.

Links of a text are kept as distinct id pairs with their number. The corpus' count of each
pair is a grouped sum; it comes back to the texts by two joins: the most frequent pairs, a
bounded number of them, are sent to all tasks, the rest are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustercat.llm.common import filed, located, small_batches
from clustercat.storage import keep

SEGMENT_CHARS = 1 << 18
TOGETHER_CHARS = 1 << 20
REMEMBERED_UNITS = 300_000
HEAD_PAIRS = 1_000_000

# White space and what follows it, up to the next blank or line feed that stands behind other signs.
_unit = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_seam = re.compile(r"(?<=\S)[ \n]")


def _byte_of_sign() -> dict[str, int]:
    """The byte each sign of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


# How a byte-level vocabulary of this kind takes texts apart before joining bytes (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenPair:
    """Ids and token bytes of a byte-level BPE (``a``) and a sentence-piece model (``b``).

    The first is read from its file into the faster of the coders installed here, which needs ids in
    the order of the merges and ``PATTERN``; both are checked. Texts are coded in units that
    neither side joins with what stands before: a unit starts at a blank or line feed behind a sign
    that is not white space. ``a`` never joins white space to an earlier sign, ``b`` has no piece with a
    blank behind another sign or with a line feed, which is checked too. Units are remembered, up
    to ``remembered``; then the memory starts anew.
    """

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED_UNITS):
        import sentencepiece
        import tiktoken

        self.remembered = remembered
        with open(path_a, encoding="utf-8") as file:
            written = json.load(file)
        signs, model, form = _byte_of_sign(), written["model"], written["pre_tokenizer"] or {}
        plain = form.get("type") == "ByteLevel" and form.get("use_regex", True) and not form.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or written["normalizer"]:
            raise ValueError("the first vocabulary is not a plain byte-level one")
        vocabulary = model["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(signs[c] for c in token)
        joins = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        if any(vocabulary[token] != 256 + n for n, token in enumerate(joins)):
            raise ValueError("ids of the first vocabulary are not in the order of its merges")
        ranks = {x: i for i, x in enumerate(self.bytes_a)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or (len(p) > 1 and "\n" in p) for p in pieces):
            raise ValueError("a piece of the second vocabulary joins a blank or line feed to other signs")
        self.bytes_b = [self._piece_bytes(i) for i in range(len(pieces))]
        self.lengths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        sides = ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";"))
        self.names = [f"{i}{mark}" for ids, mark in sides for i in range(len(ids))]
        self.blank = self.b.piece_to_id("▁")
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes | None] = {}

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _units_a(self, units: list[str], data: list[bytes]) -> list[bytes]:
        """Ids of units that may stand behind each other: coded as one text, cut where units end."""
        ids = np.array(self.a.encode_ordinary("".join(units)), "<u4")
        ends = np.cumsum(self.lengths_a[ids])
        stops = (np.searchsorted(ends, np.cumsum([len(x) for x in data])) + 1).tolist()
        coded = ids.tobytes()
        return [coded[4 * i : 4 * j] for i, j in zip([0, *stops], stops)]

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit. The model puts a blank before what it codes, so one is taken away on one side."""
        coded = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, unit in enumerate(units):
            if unit == " ":
                coded[k] = [self.blank]
            elif unit[0] != " ":
                coded[k] = coded[k][1:] if coded[k][:1] == [self.blank] else []
        return coded

    def _learn(self, units: list[str]) -> None:
        units.sort(key=lambda u: u[-1].isspace())  # a unit that ends in white space stands at the end of a text
        last = next((k for k, u in enumerate(units) if u[-1].isspace()), len(units))
        data = [u.encode() for u in units]
        a = self._units_a(units[:last], data[:last])
        a += [array("I", self.a.encode_ordinary(u)).tobytes() for u in units[last:]]
        self.known_a.update(zip(units, a))
        for unit, text, ids_b in zip(units, data, self._ids_b(units)):
            spelt = b"".join(map(self.bytes_b.__getitem__, ids_b)) == text
            self.known_b[unit] = array("I", ids_b).tobytes() if spelt else None

    def encode(self, parts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for parts of texts that start units; None where ``b``'s pieces don't spell one, as ``a``'s always do."""
        units = list(map(_unit.findall, parts))
        if len(self.known_a) > self.remembered:
            self.known_a, self.known_b = {}, {}
        if new := set(chain.from_iterable(units)).difference(self.known_a):
            self._learn(list(new))
        for found in units:
            b = list(map(self.known_b.__getitem__, found))
            if None in b:
                yield None
            else:
                a = b"".join(map(self.known_a.__getitem__, found))
                yield np.frombuffer(a, "<u4"), np.frombuffer(b"".join(b), "<u4")


_pairs: dict[tuple, TokenPair] = {}


def token_pair(path_a: str, path_b: str, remembered: int) -> TokenPair:
    """The worker's tokenizers, made once."""
    key = (path_a, path_b, remembered)
    if key not in _pairs:
        _pairs[key] = TokenPair(*key)
    return _pairs[key]


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """A blank and the text, cut into parts of about ``size`` characters where units start.

    A text without such a place is one part, however long.
    """
    text, start = " " + text, 0
    while start < len(text):
        seam = _seam.search(text, start + size)
        stop = seam.start() if seam else len(text)
        yield text[start:stop]
        start = stop


def irregular_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """``(a, b, c, d)``: groups from tokens a and b on up to before c and d that are not one token each.

    What lies between them is groups of one token each, jumped over along the diagonal. Both
    sequences end together.
    """
    i, shift, n = 0, 0, len(ends_a)
    groups = []
    while i < n:
        j = i + shift
        x, y = ends_a[i], ends_b[j]
        if x == y:
            i, j, step = i + 1, j + 1, 1
            while (part := ends_a[i : i + step]) and part == ends_b[j : j + step]:
                i, j, step = i + step, j + step, 2 * step
            while step > 1:
                step //= 2
                if ends_a[i : i + step] == ends_b[j : j + step]:
                    i, j = i + step, j + step
            continue
        first = i
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        i, j = i + 1, j + 1
        groups.append((first, first + shift, i, j))
        shift = j - i
    return groups


def _stops(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index behind each group's last token: behind all tokens but those inside irregular groups."""
    inside = np.bincount(starts, minlength=n + 1) - np.bincount(ends - 1, minlength=n + 1)
    return np.flatnonzero(np.cumsum(inside[:n]) == 0) + 1


@dataclass
class Part:
    """One part of a text: ids, index behind each group's last token, the distinct links and their numbers."""

    a: np.ndarray
    b: np.ndarray
    stops_a: np.ndarray
    stops_b: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    tokens: np.ndarray
    names: list[str]

    def written(self) -> str:
        """``a1,a2|b1;a3|b2,b3``: the groups in order."""
        return "".join(map(self.names.__getitem__, self.tokens.tolist()))[:-1]


def aligned(pair: TokenPair, coded: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[Part]:
    """The parts in order. As both sides end together at the end of each, they are aligned as one sequence."""
    if not coded:
        return
    a, b = (np.concatenate([c[side] for c in coded]).astype(np.int64) for side in (0, 1))
    ends_a, ends_b = np.cumsum(pair.lengths_a[a]), np.cumsum(pair.lengths_b[b])
    groups = np.array(irregular_groups(ends_a.tolist(), ends_b.tolist()), np.int64).reshape(-1, 4)
    stops_a, stops_b = _stops(len(a), groups[:, 0], groups[:, 2]), _stops(len(b), groups[:, 1], groups[:, 3])
    # Where parts start among tokens, groups and links.
    at_a, at_b = (np.cumsum([0, *(len(c[side]) for c in coded)]) for side in (0, 1))
    at_group = np.searchsorted(stops_a, at_a, side="right")
    # Each stretch between neighbouring ends of either side is a link of the two tokens it belongs to.
    ends = np.union1d(ends_a, ends_b)
    link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    part = np.searchsorted(at_a, link_a, side="right") - 1
    n_a, n_b = len(pair.bytes_a), len(pair.bytes_b)
    keys, times = np.unique((part * n_a + a[link_a]) * n_b + b[link_b], return_counts=True)
    part, keys = np.divmod(keys, n_a * n_b)
    pairs = keys // n_b << 32 | keys % n_b
    at_pair = np.searchsorted(part, np.arange(len(coded) + 1))
    # Names of all ids in the order they are written, with what follows each.
    name_a, name_b = a.copy(), b + 2 * n_a
    name_a[stops_a - 1] += n_a
    name_b[stops_b - 1] += n_b
    tokens = np.empty(len(a) + len(b), np.int64)
    sizes_a, sizes_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
    tokens[np.arange(len(a)) + np.repeat(stops_b - sizes_b, sizes_a)] = name_a
    tokens[np.arange(len(b)) + np.repeat(stops_a, sizes_b)] = name_b
    cuts = zip(*(zip(at.tolist(), at[1:].tolist()) for at in (at_a, at_b, at_group, at_pair, at_a + at_b)))
    for (i, j), (k, m), (g, h), (p, q), (t, u) in cuts:
        yield Part(a[i:j], b[k:m], stops_a[g:h] - i, stops_b[g:h] - k, pairs[p:q], times[p:q], tokens[t:u], pair.names)


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
GROUPS = "a_ids array<int>, b_ids array<int>, a_stops array<int>, b_stops array<int>"


class DigestRow:
    """The columns of ``DIGEST`` of one text, whose parts are added in order; None is a part without tokens."""

    def __init__(self):
        self.spelt, self.counts, self.digest = True, [0, 0, 0, 0], hashlib.sha256()
        self.pairs = self.times = np.zeros(0, np.int64)

    def add(self, part: Part | None) -> None:
        self.spelt = self.spelt and part is not None
        if not self.spelt:
            return
        if not self.counts[0]:
            self.pairs, self.times = part.pairs, part.times
        else:
            self.digest.update(b";")
            times = np.concatenate([self.times, part.times])
            self.pairs, at = np.unique(np.concatenate([self.pairs, part.pairs]), return_inverse=True)
            self.times = np.bincount(at, times, len(self.pairs)).astype(np.int64)
        self.digest.update(part.written().encode())
        for k, n in enumerate((len(part.a), len(part.b), len(part.stops_a), int(part.times.sum()))):
            self.counts[k] += n

    def row(self) -> tuple:
        if not (self.spelt and self.counts[0]):
            return 0, 0, 0, 0, "", [], []
        return *self.counts, self.digest.hexdigest(), self.pairs, self.times


class GroupRow:
    """The columns of ``GROUPS`` of one text, as above."""

    def __init__(self):
        self.spelt, self.columns, self.at = True, ([], [], [], []), (0, 0)

    def add(self, part: Part | None) -> None:
        self.spelt = self.spelt and part is not None
        if self.spelt:
            for column, values in zip(self.columns, (part.a, part.b, part.stops_a + self.at[0], part.stops_b + self.at[1])):
                column.append(values)
            self.at = (self.at[0] + len(part.a), self.at[1] + len(part.b))

    def row(self) -> tuple:
        return tuple(np.concatenate(c) if self.spelt and c else [] for c in self.columns)


def text_rows(pair: TokenPair, texts: list[str | None], kind: type) -> list[tuple]:
    """A row of ``kind`` for each text. Parts are coded and aligned many at a time."""
    rows, waiting, size = [kind() for _ in texts], [], 0

    def code():
        coded = list(pair.encode([part for _, part in waiting]))
        parts = aligned(pair, [c for c in coded if c is not None])
        for (row, _), c in zip(waiting, coded):
            rows[row].add(None if c is None else next(parts))
        waiting.clear()

    for row, text in enumerate(texts):
        for part in segments(text) if text else ():
            waiting.append((row, part))
            size += len(part)
            if size >= TOGETHER_CHARS:
                code()
                size = 0
    code()
    return [row.row() for row in rows]


def _mapped(docs: DataFrame, row: type, schema: str, paths: tuple[str, str], id_column: str, text_column: str, remembered: int):
    """``docs``' locator and id with the columns that ``row`` makes of each text."""
    small_batches(docs)
    source = located(docs).select("_cc_file", "_cc_row", F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(*paths, remembered)
        for batch in batches:
            rows = text_rows(pair, batch.column(3).to_pylist(), row)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["_cc_file", "_cc_row", "id", *names])

    return source.mapInArrow(convert, f"_cc_file long, _cc_row long, id {kind}, {schema}")


def align(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    remembered: int = REMEMBERED_UNITS,
) -> DataFrame:
    """``id, a_ids, b_ids, a_stops, b_stops``: both token sequences and where each group stops, one row per row.

    Group n holds the ids from the stops of group n - 1 to its own. See :func:`link_counts` for odd rows.
    """
    rows = _mapped(filed(docs), GroupRow, GROUPS, (path_a, path_b), id_column, text_column, remembered)
    return rows.drop("_cc_file", "_cc_row")


def pair_counts(digests: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each id pair in the corpus, and whether no pair of its ``b`` id has more.

    Summed in each task first, so a pair of every text is a row a task. Of a ``b`` id no more pairs
    are compared than ``a`` has ids.
    """
    links = digests.select(F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    sums = keep(links.groupBy(F.col("l.pairs").alias("pair")).agg(F.sum("l.times").alias("n")), "pairs")
    side_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    most = sums.groupBy(side_b.alias("b")).agg(F.max("n").alias("most"))
    return keep(
        sums.withColumn("b", side_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
        "pair-counts",
    )


def link_counts(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    remembered: int = REMEMBERED_UNITS,
    head_pairs: int = HEAD_PAIRS,
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per row of ``docs``.

    A link is a token of each side whose bytes overlap; its count is the number of links of the
    corpus with the same two ids; ``n_best`` are links whose count is the highest of their ``b`` id,
    ties included; ``count_sum`` adds the counts of all links. Texts that are null or empty, or
    that either side's tokens don't spell, have no tokens: zeros and an empty digest. Repeated
    rows and ids are texts of their own; a null id stays null; an empty table gives no rows; other
    columns are ignored. A text is held in parts of about ``SEGMENT_CHARS`` characters, cut at
    blanks or line feeds; one without any is held whole.
    """
    digests = keep(_mapped(filed(docs), DigestRow, DIGEST, (path_a, path_b), id_column, text_column, remembered), "aligned")
    counts = pair_counts(digests)
    # Pairs by the power of two of their count: at most 64 rows. The head is all powers that fit its bound.
    power = F.floor(F.log2("n")).cast("int")
    sizes = counts.groupBy(power.alias("power")).count().collect()
    least, held = 64, 0
    for power_of, number in sorted(((r["power"], r["count"]) for r in sizes), reverse=True):
        if held + number > head_pairs:
            break
        least, held = power_of, held + number
    head, tail = counts.filter(power >= least), counts.filter(power < least)
    links = digests.select("_cc_file", "_cc_row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "_cc_file", "_cc_row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times")
    )
    place = ["_cc_file", "_cc_row"]
    sums = [
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    ]
    found = links.join(F.broadcast(head), "pair").groupBy(*place).agg(*sums)
    if held < sum(r["count"] for r in sizes):
        rest = links.join(F.broadcast(head.select("pair")), "pair", "left_anti").join(tail.hint("shuffle_merge"), "pair")
        found = found.unionByName(rest.groupBy(*place).agg(*sums))
        found = found.groupBy(*place).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    whole = digests.drop("pairs", "times").join(found, place, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select("id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

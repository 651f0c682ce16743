"""Packing of token sequences by first-fit decreasing in randomised groups.

Documents are tokenized and cut into whole sequences and one rest each, and dealt by a hash
to groups of about ``docs_per_group`` documents. In each group the pieces are placed, largest first, into the
first sequence with room, found in a tournament tree over the room left. Then
the sequences that are not full are closed: the emptiest gives its tokens to
the gaps of the others, and the last one is cut at powers of two, so that no
padding is left.

Defined results: a null or empty text still has its final id; repeated
documents are packed as often as they occur; an empty table gives no pieces;
other columns are not read. Rows are numbered in file order to be dealt, so
documents must be a stable input (files or a written table).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.batches import map_batches, record_batch

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


# Fixed value: the word pattern of the vocabulary, in the form that the library reads fastest.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
HOT_UNITS, SEEN_UNITS = 200_000, 400_000


class LibraryEncoder:
    """Ids of whole texts, by the library for units (a blank and what follows up to the next) that are rare, looked up for frequent ones.

    ``encode`` takes one text, whose rare units go to the library in one call. ``encode_all`` takes a batch: Arrow cuts its texts
    and finds their distinct units, so a unit is looked up once a batch.
    """

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.whole = bpe.Encoder(vocabulary)  # white space and letters that need more care
        self.labels = vocabulary.tokens
        made = [w for _, _, w in vocabulary.merges]
        self.line_end = vocabulary.tokens.index(b"\n") if b"\n" in vocabulary.tokens else -1
        # the library takes ids for ranks; a line end must be a token
        self.usable = made == sorted(set(made)) and self.line_end >= 0
        ranks = {label: i for i, label in enumerate(vocabulary.tokens) if label and i not in vocabulary.added.values()}
        self.native = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary if self.usable else None
        self.hot: dict[str, bytes] = {}
        self.seen: set[str] = set()
        self.cuttable = self.usable and not any(c.isspace() for label in vocabulary.added for c in label)
        self.small = np.uint16 if len(vocabulary.tokens) <= 1 << 16 else np.uint32
        self.units: dict[str, bytes] = {}  # those of batches, in small ids
        self.seen_units: set[str] = set()

    def _ids(self, text: str) -> bytes:
        return array("I", self.native(text)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text or not self.usable or self.whole.needs_care(text):
            return self.whole.encode(text)
        pieces = text.split(" ")
        found = list(map(self.hot.get, pieces))
        found[0] = self._ids(pieces[0])
        rare = [i for i, ids in enumerate(found) if ids is None]
        simple = [i for i in rare if (p := pieces[i]) and not p[0].isspace() and "\n" not in p]
        if len(simple) < len(rare):
            for i in set(rare).difference(simple):
                found[i] = self._ids(" " + pieces[i])
        if simple:
            # one call for all of them: a line end before a blank is a word, and here a token, of its own
            ids = np.array(self.native(" " + "\n ".join([pieces[i] for i in simple])), np.uint32)
            cuts = (np.flatnonzero(ids == self.line_end) * 4).tolist()
            raw = ids.tobytes()
            for i, low, high in zip(simple, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)]):
                found[i] = raw[low:high]
            if len(self.hot) < HOT_UNITS:
                self._learn([(pieces[i], found[i]) for i in simple])
        return np.frombuffer(b"".join(found), np.uint32)

    def _learn(self, units: list[tuple[str, bytes]]) -> None:
        """A unit is frequent from the second time on; the first ones fill the table."""
        if len(self.seen) >= SEEN_UNITS:
            self.seen.clear()
        for unit, ids in units:
            if unit not in self.seen:
                self.seen.add(unit)
            elif len(unit) <= 64 and len(self.hot) < HOT_UNITS:
                self.hot[unit] = ids

    def _careful(self, units: list[str]) -> np.ndarray:
        """Whether a text with the unit needs a look at more than its units: white space beside a cut, unsettled letters, added tokens."""
        joined = " ".join(units)
        every = f" {joined} "
        if not (
            bpe.has_odd_blanks(every) or any(c + blank[0] in every for c in " \n" for blank in bpe.ODD_BLANKS if blank[0] != "\n")
            or not (joined.isascii() or bpe.SETTLED.fullmatch(joined)) or any(label in joined for label in self.whole.added)
        ):
            return np.zeros(len(units), bool)
        return np.array([
            not u or u[-1].isspace() or u[u[0] == "\n"].isspace() or not (u.isascii() or bpe.SETTLED.fullmatch(u)) or any(label in u for label in self.whole.added)
            for u in units
        ])

    def _in_one_call(self, units: list[str]) -> pa.Array:
        """Ids of units that begin with a line end or follow a blank. In the call a line end, a word and token of its own, stands before each of them."""
        ids = np.array(self.native(f" {' '.join(units)}".replace(" ", "\n ").replace("\n \n", "\n")), self.small)
        line = np.array([u[0] == "\n" for u in units], bool)
        begins = np.flatnonzero(ids == self.line_end)
        lengths = np.diff(begins, append=len(ids)) - ~line
        ends = np.append(0, np.cumsum(lengths)) * ids.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(ends), pa.py_buffer(np.delete(ids, begins[~line]))])

    def _units(self, units: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, the row of each of the distinct units among them, and which units need care."""
        known = list(map(self.units.get, units))
        rows, careful = np.zeros(len(units), np.int64), np.zeros(len(units), bool)
        rare = np.array([i for i, ids in enumerate(known) if ids is None], np.int64)
        if not len(rare):
            return pa.array(known, pa.large_binary()), np.arange(len(units)), careful
        careful[rare] = self._careful([units[i] for i in rare])
        rare = rare[~careful[rare]]
        named = [units[i] for i in rare]
        known = [ids for ids in known if ids is not None]
        found = self._in_one_call(named) if named else pa.array([], pa.large_binary())
        often = ~careful
        often[rare] = False
        rows[often], rows[rare] = np.arange(len(known)), len(known) + np.arange(len(rare))
        if len(self.units) < HOT_UNITS:
            if len(self.seen_units) >= SEEN_UNITS:
                self.seen_units.clear()
            again = [i for i, unit in enumerate(named) if unit in self.seen_units and len(unit) <= 64][: HOT_UNITS - len(self.units)]
            self.units.update(zip([named[i] for i in again], found.take(pa.array(again, pa.int64())).to_pylist()))
            self.seen_units.update(named)
        return pa.concat_arrays([pa.array(known, pa.large_binary()), found]), rows, careful

    def encode_all(self, texts: pa.Array, final_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each text's followed by ``final_id``, and where each text starts (and the last one ends).

        Texts are cut before blanks and before line ends, none of which has white space beside it; other texts go to ``encode``.
        While cutting, a line end stands before each text; its id makes room for the final one of the text before.
        """
        n = len(texts)
        if not n or not self.cuttable:
            whole = [np.append(self.encode(t), np.uint32(final_id)) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, self.small), *whole]).astype(self.small), np.cumsum([0, *map(len, whole)])
        lines = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), lines, pa.scalar("", pa.large_string())), " ")
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        all_units = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        found, rows, careful = self._units(pc.binary_join(all_units, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "))
        units = coded.indices.to_numpy()
        numbers = rows[units]
        if careful.any():
            text_of = np.repeat(np.arange(n), np.diff(starts, append=len(units)))
            odd = np.unique(text_of[careful[units]])
            alone = [np.append(np.uint32(self.line_end), self.encode(t)).astype(self.small).tobytes() for t in texts.take(pa.array(odd)).to_pylist()]
            numbers[np.isin(text_of, odd)] = len(found) + len(odd)
            numbers[starts[odd]] = len(found) + np.arange(len(odd))
            found = pa.concat_arrays([found, pa.array([*alone, b""], pa.large_binary())])
        joined = found.take(pa.array(numbers))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(numbers) + 1, 8 * joined.offset) // self.small().itemsize
        first = int(ends[0])
        starts = np.append(ends[starts], ends[-1]) - first
        ids = np.frombuffer(joined.buffers()[2], self.small, int(starts[-1]) + first)[first:].copy()
        ids[starts[1:-1]] = final_id
        return np.append(ids[1:], self.small(final_id)), starts


class Piece(NamedTuple):
    row: int  # of the document's rest or block in the group
    start: int  # within it
    length: int


class RoomTree:
    """Tournament tree of the room left in each of ``n`` sequences."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first sequence with room for ``size``, whose room shrinks by it."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    full = [[i] for i in order if lengths[i] == capacity]
    rest = [i for i in order if lengths[i] < capacity]
    tree = RoomTree(max(1, len(rest)), capacity)
    bins: list[list[int]] = []
    for i in rest:
        k = tree.place(lengths[i])
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
    return full + bins


def close(bins: list[list[Piece]], capacity: int) -> list[list[Piece]]:
    """Fill the gaps from the emptiest sequences, and cut the last one at powers of two."""
    fill = [sum(p.length for p in b) for b in bins]
    done = [b for b, n in zip(bins, fill) if n == capacity]
    short = sorted(((n, b) for b, n in zip(bins, fill) if n < capacity), key=lambda x: x[0])
    low, high = 0, len(short) - 1
    while low < high:
        n, target = short[high]
        while n < capacity and low < high:
            m, donor = short[low]
            piece = donor.pop()
            taken = min(piece.length, capacity - n)
            target.append(piece._replace(length=taken))
            if taken < piece.length:
                donor.append(Piece(piece.row, piece.start + taken, piece.length - taken))
            n, m = n + taken, m - taken
            short[low] = (m, donor)
            low += m == 0
        short[high] = (n, target)
        if n == capacity:
            done.append(target)
            high -= 1
    for n, b in short[low : high + 1]:
        while n:
            size = 1 << (n.bit_length() - 1)
            n -= size
            part: list[Piece] = []
            while size:
                piece = b.pop()
                taken = min(piece.length, size)
                part.append(piece._replace(length=taken))
                if taken < piece.length:
                    b.append(Piece(piece.row, piece.start + taken, piece.length - taken))
                size -= taken
            done.append(part)
    return done


def _cut(shared, capacity: int, final_id: int):
    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = bpe.encoder_of(shared, LibraryEncoder)
        ids, starts = encoder.encode_all(batch.column("text"), final_id)
        lengths = np.diff(starts)
        cuts = -(-lengths // capacity)
        text = np.repeat(np.arange(len(lengths)), cuts)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
        ends = np.append(starts[text] + start, len(ids)) * ids.itemsize
        yield {
            "group": batch.column("group").take(pa.array(text)), "doc_id": batch.column("id").take(pa.array(text)), "start": start,
            "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary()),
            "width": np.full(len(text), ids.itemsize, np.int32), "doc_tokens": lengths[text],
        }

    return cut


def _pack(capacity: int):
    def pack(key: tuple, group: pa.Table) -> pa.Table:
        columns = {c: group[c].to_pylist() for c in ("doc_id", "start", "ids", "width", "doc_tokens")}
        ids = [np.frombuffer(b, np.uint16 if w == 2 else np.uint32) for b, w in zip(columns["ids"], columns["width"])]
        # the order in which rows arrive must not matter
        order = sorted(range(len(ids)), key=lambda i: (columns["doc_id"][i] is None, columns["doc_id"][i] or 0, columns["start"][i]))
        bins = first_fit_decreasing([len(ids[i]) for i in order], capacity)
        placed = close([[Piece(order[i], 0, len(ids[order[i]])) for i in b] for b in bins], capacity)
        out: dict[str, list] = {c: [] for c in PACKED.names}
        for number, pieces in enumerate(placed):
            offset = 0
            for row, start, length in pieces:
                values = (
                    columns["doc_id"][row], columns["start"][row] + start, length, ids[row][start : start + length].astype("<u4").tobytes(),
                    columns["doc_tokens"][row], (key[0].as_py() << 32) + number, offset,
                )
                for name, value in zip(PACKED.names, values):
                    out[name].append(value)
                offset += length
        return pa.Table.from_batches([record_batch(out, PACKED)])

    return pack


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, final_id: int = 0,
    docs_per_group: int = 512, seed: int = 17,
) -> DataFrame:
    """Pieces with their ids (``binary``, unsigned 32-bit little-endian), sequence and offset: one shuffle, of 16-bit ids where they fit."""
    groups = max(1, -(-docs.count() // docs_per_group))
    dealt = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).alias("group"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
    )
    pieces = map_batches(
        dealt, _cut(bpe.share(docs, tokenizer_path), capacity, final_id), "group long, doc_id long, start long, ids binary, width int, doc_tokens long"
    )
    return pieces.groupBy("group").applyInArrow(_pack(capacity), PIECE)

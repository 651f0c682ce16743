"""Byte-level BPE by an automaton over tokens.

The automaton accepts exactly the token sequences that merging yields. It
starts as one state with an arc for each byte; every merge ``u + v -> w``, in
order of rank, adds a gadget:

* the state behind ``u`` loses its arc ``v`` (this pair is no longer a result),
* arc ``w`` is added beside ``u`` wherever ``u`` leaves at that time,
* the state behind ``w`` is a copy of the state behind ``v`` at that time.

States are copied on write: a copy is stored as its origin and the rank at
which it was made, so that 50,000 gadgets take a few arrays. ``step`` resolves
an arc of a state through both chains of origins and keeps the answer in a
table; it is deterministic, as each state has at most one target per arc. As
the automaton accepts one segmentation of every byte string, exactly one token
ends the segmentation of each prefix of a word: encoding runs over the word
once, following the arcs whose labels (bytes) match. Decoding emits the
labels.

Texts are split into words first, by the pattern of the vocabulary's family
or, faster and to the same result, at blanks that follow other than white
space; units seen before are looked up. Caches are bounded and emptied when full.

Defined results: a null or empty text has no ids and decodes to an empty text;
strings of added tokens become their ids; ids may be null or repeated; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from millrace.llm.batches import map_batches

# Fixed value: the pattern that splits texts before merging.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANK = regex.compile(r"(?<=\S)(?= )")
ODD_BLANKS = [chr(c) + " " for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
# Letters and numbers on which all Unicode versions since 2012 agree; the rest is split by the library itself.
SETTLED = regex.compile(r"[\x00-\u0527\u1E00-\u1FFF\u2000-\u206F\u20A0-\u20B9\u3040-\u30FF\u4E00-\u9FCC\uAC00-\uD7A3]*+")
LIBRARY_SPLIT = pre_tokenizers.ByteLevel(add_prefix_space=False)
START = -1
NEVER = 1 << 40
CACHED_UNITS, CACHED_STEPS = 250_000, 1_000_000


class Vocabulary(NamedTuple):
    """Tokens and merges of a tokenizer file; its size is that of the vocabulary."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    added: dict[str, int]


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files: printable bytes for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    letters = byte_letters()
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max([*model["vocab"].values(), *added.values()]))
    for token, i in model["vocab"].items():
        tokens[i] = bytes(letters[c] for c in token)
    for token, i in added.items():
        tokens[i] = token.encode()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
    return Vocabulary(tokens, merges, added)


class Automaton:
    """States and arcs are named by tokens: state ``t`` is the one behind arc ``t``."""

    def __init__(self, vocabulary: Vocabulary):
        n = len(vocabulary.tokens)
        self.labels = vocabulary.tokens
        self.copied_from, self.beside, self.made = [START] * n, [START] * n, [NEVER] * n
        self.removed: dict[int, int] = {}
        self.size = n
        for rank, (u, v, w) in enumerate(vocabulary.merges):
            self.add_gadget(rank, u, v, w)
        self.arcs: list[dict[int, int]] = [{}]  # a tree of labels: node x byte -> node
        self.ends: list[int] = [START]
        merged = {w for _, _, w in vocabulary.merges}
        for token, label in enumerate(self.labels):
            if len(label) == 1 or token in merged:
                self._add_label(label, token)
        self.table: dict[int, bool] = {}

    def add_gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if self.made[w] != NEVER:
            return  # the token exists; a second way to it is never a result
        self.removed.setdefault(u * self.size + v, rank)
        self.copied_from[w], self.beside[w], self.made[w] = v, u, rank

    def _add_label(self, label: bytes, token: int) -> None:
        node = 0
        for b in label:
            node = self.arcs[node].setdefault(b, len(self.arcs))
            if node == len(self.arcs):
                self.arcs.append({})
                self.ends.append(START)
        self.ends[node] = token

    def step(self, state: int, arc: int) -> bool:
        """Whether ``arc`` leaves ``state``: no origin of the state had lost an origin of the arc when both were still the same."""
        key = state * self.size + arc
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CACHED_STEPS:
                self.table.clear()
            known = self.table[key] = self._resolve(state, arc)
        return known

    def _resolve(self, state: int, arc: int) -> bool:
        origin, copied = state, NEVER
        while origin != START:
            part, joined = arc, NEVER
            while part != START:
                lost = self.removed.get(origin * self.size + part)
                # the leftmost of equal merges comes first: it takes part of the arc, but not of the state
                if lost is not None and lost < copied and lost <= joined:
                    return False
                joined, part = self.made[part], self.beside[part]
            copied, origin = self.made[origin], self.copied_from[origin]
        return True

    def encode(self, word: bytes) -> list[int]:
        """The one accepted segmentation of a word: long arcs are tried first, a place that led nowhere is not tried again.

        Whatever path reaches a place is the segmentation of the word up to there, so one visit is enough.
        """
        n = len(word)
        visited = bytearray(n + 1)
        arcs, ends, size, known = self.arcs, self.ends, self.size, self.table
        stack = [(0, START, None)]
        while stack:
            here = stack.pop()
            i, token, came = here
            if visited[i]:
                continue
            if i:
                before = came[1]
                if before != START:
                    allowed = known.get(before * size + token)
                    if not (self.step(before, token) if allowed is None else allowed):
                        continue
                if i == n:
                    break
            visited[i] = 1
            node = 0
            for j in range(i, n):
                node = arcs[node].get(word[j])
                if node is None:
                    break
                if ends[node] != START:
                    stack.append((j + 1, ends[node], here))
        else:
            if n:
                raise ValueError(f"the vocabulary has no segmentation of {word!r}")
            return []
        ids = []
        while here[2] is not None:
            ids.append(here[1])
            here = here[2]
        return ids[::-1]


def has_odd_blanks(text: str) -> bool:
    return any(x in text for x in (ODD_BLANKS[:6] if text.isascii() else ODD_BLANKS))


def words_of(unit: str) -> list[str]:
    if unit.isascii() or SETTLED.fullmatch(unit):
        return WORDS.findall(unit)
    return [unit[a:b] for _, (a, b) in LIBRARY_SPLIT.pre_tokenize_str(unit)]


class Encoder:
    """Encodes and decodes whole texts in one worker process."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = Automaton(vocabulary)
        self.labels = vocabulary.tokens
        self.decimals = [str(i) for i in range(len(self.labels))]
        self.added = vocabulary.added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        parts = []
        for word in words_of(unit):
            known = self.words.get(word) or self.old_words.get(word)
            if known is None:
                if len(self.words) >= CACHED_UNITS:
                    self.old_words, self.words = self.words, {}
                known = array("I", self.automaton.encode(word.encode())).tobytes()
                if len(word) <= 64:
                    self.words[word] = known
            parts.append(known)
        return b"".join(parts)

    def _plain(self, text: str) -> bytes:
        if has_odd_blanks(text):
            return b"".join([self._unit(u) for u in BLANK.split(text)])
        pieces = text.split(" ")
        units = self.units
        found = list(map(units.get, pieces))
        found[0] = self._unit(pieces[0])
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._new_unit(pieces[i])
        return b"".join(found)

    def _new_unit(self, piece: str) -> bytes:
        ids = self.units.get(piece) or self.old_units.get(piece) or self._unit(" " + piece)
        if len(piece) <= 64:
            if len(self.units) >= CACHED_UNITS:  # what is used again comes back from the older generation
                self.old_units = dict(self.units)
                self.units.clear()
            self.units[piece] = ids
        return ids

    def needs_care(self, text: str) -> bool:
        """Whether a text has more than single blanks between words, unsettled letters, or strings of added tokens."""
        return has_odd_blanks(text) or not (text.isascii() or SETTLED.fullmatch(text)) or any(t in text for t in self.added)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.split_added is None or not any(t in text for t in self.added):
            return np.frombuffer(self._plain(text), np.uint32)
        parts = []
        for part in self.split_added.split(text):
            if part in self.added:
                parts.append(np.array([self.added[part]], np.uint32).tobytes())
            elif part:
                parts.append(self._plain(part))
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


ENCODERS: dict[tuple, object] = {}


def encoder_of(shared: SharedVocabulary, kind: Callable[[Vocabulary], object] = Encoder):
    """The encoder of a broadcast vocabulary, made once per worker process."""
    key = (shared.id, kind.__name__)
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = kind(shared.value)
    return ENCODERS[key]


class SharedVocabulary(NamedTuple):
    id: str
    broadcast: object

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def share(docs: DataFrame, tokenizer_path: str) -> SharedVocabulary:
    """The vocabulary as a broadcast value: its size is fixed by its file, whatever the data."""
    vocabulary = read_vocabulary(tokenizer_path)
    digest = hashlib.sha256(repr((vocabulary.merges, vocabulary.added)).encode()).hexdigest()
    return SharedVocabulary(digest, docs.sparkSession.sparkContext.broadcast(vocabulary))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (array of int) of every text; no shuffle."""
    shared = share(docs, tokenizer_path)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        one = encoder_of(shared)
        yield {"id": batch.column("id"), "ids": [one.encode(t).astype(np.int32) for t in batch.column("text").to_pylist()]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``text`` of id sequences; bytes that are no UTF-8 become replacement characters."""
    shared = share(encoded, tokenizer_path)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        one = encoder_of(shared)
        yield {"id": batch.column("id"), "text": [one.decode(i or []) for i in batch.column("ids").to_pylist()]}

    return map_batches(encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")), run, "id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of every text in one pass, of which only count and digests leave the task."""
    shared = share(docs, tokenizer_path)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        one = encoder_of(shared)
        counts, digests, texts = [], [], []
        for text in batch.column("text").to_pylist():
            ids = one.encode(text).tolist()
            counts.append(len(ids))
            digests.append(hashlib.sha256(",".join(map(one.decimals.__getitem__, ids)).encode()).hexdigest())
            texts.append(hashlib.sha256(one.decode(ids).encode()).hexdigest())
        yield {"id": batch.column("id"), "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": texts}

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(picked, run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

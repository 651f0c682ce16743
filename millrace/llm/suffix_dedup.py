"""Removal of passages that an earlier document has, by a logarithmic family of suffix arrays.

A byte is removed if a string of 50 bytes that covers it also starts in a
document with a smaller id. Every 50-byte string (window) has an anchor: the
16-byte gram with the smallest hash among its grams, so equal windows have equal
anchors. Anchors divide all suffixes among families that can be searched
independently.

1. Texts are written as compressed blocks to the shared folder; each block
   sends the short hashes of its anchors, about one for 18 bytes, to buckets.
2. Each bucket answers which of them occur in more than one document.
3. For those anchors only, blocks send the bytes around them (each content once, with the
   smallest id that has it) to the family of the anchor.
4. A family takes its contents in order of document id, in batches. A batch gets a
   suffix array (its windows in sorted order), is merge-scanned against the
   suffix arrays of all levels to find windows seen before, and becomes the lowest level; two levels of
   like size are merged, so there are logarithmically many.
5. Blocks join the removed intervals and cut the texts. Blocks of ``without_repeats`` hold whole rows, so no text
   is shuffled to be joined with what is left of it.

Texts that equal an earlier text as a whole are removed as a whole, if of 50
bytes or more, and take no part in 3 to 5.

Defined results: a null or empty text has no bytes and nothing removed; rows
with a null id neither lose nor cause anything; rows with equal ids do not
affect each other; all rows are returned; other columns are not read. Blocks
are read by the path that was written; a repeated task writes new ones, and only those of the task that counts are named.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.batches import map_task, record_batch, to_schema
from millrace.operators.skew import spread_join
from millrace.session import cut_lineage, scratch_path
from millrace.sources.writers import open_uri

GRAM = 16
BLOCK_BYTES = 8 << 20
SEGMENT = 1 << 19
LOW = np.uint64((1 << 22) - 1)
BATCH_WINDOWS = 1 << 16
ANCHORS_PER_BUCKET = 1 << 20
BYTES_PER_TASK = 32 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

BLOCK_ROWS = (
    "block string, doc int, id long, n_bytes long, sha string, bucket long, hashes binary, repeated binary"
)
INTERVALS = "block string, docs binary, starts binary, ends binary"


# --- anchors

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    x = data.astype(np.uint64)
    for step in (1, 2, 4, 8):
        x = x[:-step] * np.uint64(0x9E3779B97F4A7C15) + x[step:] + np.uint64(step)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc, first, last, gram``: for each run of windows of one document with one anchor, its window starts (in ``data``) and the anchor's hash."""
    ends = np.cumsum(lengths)
    found: list[tuple] = []
    for a in range(0, len(data) - length + 1, SEGMENT):
        piece = data[a : a + SEGMENT + length - 1]
        hashes = gram_hashes(piece)
        keyed = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        place = (window_minima(keyed, length - GRAM + 1) & LOW).astype(np.int64)
        starts = a + np.arange(len(place))
        doc = np.searchsorted(ends, [a, starts[-1]], side="right")
        doc = doc[0] + np.repeat(np.arange(doc[1] - doc[0] + 1), np.diff(np.concatenate([[a], np.minimum(ends[doc[0] : doc[1]], starts[-1] + 1), [starts[-1] + 1]])))
        inside = ends[doc] - starts >= length
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0) | (np.diff(inside) != 0)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(place)]]) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        found.append((doc[first], a + first, a + last, hashes[place[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


# --- blocks in the shared folder

def write_block(folder: str, rows: pa.Table) -> str:
    system, base = open_uri(folder)
    name = f"{uuid.uuid4().hex}.arrow"
    with system.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return f"{folder}/{name}"


def block_rows(path: str, columns: list[int] | None = None) -> pa.Table:
    system, place = open_uri(path)
    with system.open_input_file(place) as source:
        return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=columns or [])).read_all()


def read_block(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (-1 and a flag for null ones are not needed: see callers), lengths and all bytes of a block."""
    table = block_rows(path, [0, 1])
    texts = [t or b"" for t in table["text"].to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return table["id"].to_pylist(), lengths, np.frombuffer(b"".join(texts), np.uint8)


def short_hash(gram: np.ndarray, bits: int) -> np.ndarray:
    """Bucket and 32 more bits of each hash."""
    return gram >> np.uint64(32 - bits)


def _blocks(folder: str, bits: int, length: int):
    def flush(parts: list[pa.RecordBatch]) -> Iterator[dict]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        path = write_block(folder, rows)
        ids, texts = rows["id"].to_pylist(), [t or b"" for t in rows["text"].to_pylist()]
        n = len(ids)
        yield {
            "block": [path] * n, "doc": list(range(n)), "id": ids, "n_bytes": list(map(len, texts)), "sha": [hashlib.sha256(t).hexdigest() for t in texts],
            "bucket": [None] * n, "hashes": [None] * n, "repeated": [None] * n,
        }
        doc, _, _, gram = anchors(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, n), length)
        known = np.array([i is not None for i in ids], bool)[doc]
        short, doc = short_hash(gram[known], bits), doc[known]
        order = np.lexsort((doc, short))
        short, doc = short[order], doc[order]
        fresh = np.concatenate([[True], (np.diff(short) != 0) | (np.diff(doc) != 0)]) if len(short) else np.zeros(0, bool)
        unique, counts = np.unique(short[fresh], return_counts=True)
        bucket = (unique >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        parts = [p for p in np.split(np.arange(len(unique)), cuts) if len(p)]
        m = len(parts)
        yield {
            "block": [path] * m, "doc": [None] * m, "id": [None] * m, "n_bytes": [None] * m, "sha": [None] * m, "bucket": [int(bucket[p[0]]) for p in parts],
            "hashes": [unique[p].astype(np.uint32).tobytes() for p in parts], "repeated": [np.packbits(counts[p] > 1).tobytes() for p in parts],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            start, beside = 0, 64 + (batch.nbytes - batch.column("text").nbytes) // max(1, batch.num_rows)
            for k, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
                size += (n or 0) + beside
                if size >= BLOCK_BYTES:
                    yield from flush([*held, batch.slice(start, k + 1 - start)])
                    held, size, start = [], 0, k + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield from flush(held)

    return run


# --- which anchors do several documents have

def _shared(key: tuple, group: pa.Table) -> pa.Table:
    blocks = group["block"].to_pylist()
    hashes = [np.frombuffer(b, np.uint32) for b in group["hashes"].to_pylist()]
    repeated = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(h)).astype(bool) for b, h in zip(group["repeated"].to_pylist(), hashes)]
    every = np.sort(np.concatenate([*hashes, *[h[r] for h, r in zip(hashes, repeated)]]))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    bucket = np.uint64(key[0].as_py()) << np.uint64(32)
    out: dict[str, list] = {"block": [], "shared": []}
    for block, h in zip(blocks, hashes):
        mine = h[np.isin(h, shared, assume_unique=True)]
        if len(mine):
            out["block"].append(block)
            out["shared"].append((mine.astype(np.uint64) | bucket).tobytes())
    return pa.table({"block": pa.array(out["block"], pa.string()), "shared": pa.array(out["shared"], pa.binary())})


# --- contents around shared anchors

def _contents(bits: int, families: int, length: int):
    """Per block and family: the distinct contents, each with the smallest id that has it, and where they occur."""
    kind = to_schema(CONTENTS)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        path = key[0].as_py()
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(b, np.uint64) for b in group["shared"].to_pylist() if b is not None]]))
        copies = [d for d in group["copy"].to_pylist() if d is not None]
        ids, lengths, data = read_block(path)
        idle = np.array([i is None for i in ids], bool)
        idle[copies] = True
        numbers = np.array([i or 0 for i in ids], np.int64)
        offsets = np.cumsum(lengths) - lengths
        doc, first, last, gram = anchors(data, lengths, length)
        short = short_hash(gram, bits)
        at = np.minimum(np.searchsorted(shared, short), max(0, len(shared) - 1))
        asked = ~idle[doc] & (shared[at] == short) if len(shared) else np.zeros(len(doc), bool)
        doc, first, last, gram = doc[asked], first[asked], last[asked], gram[asked]
        family = (gram % np.uint64(families)).astype(np.int64)
        order = np.lexsort((numbers[doc], family))
        doc, first, last, family = doc[order], first[order], last[order], family[order]
        rows: dict[str, list] = {f.name: [] for f in schema}
        whole = data.tobytes()
        cuts = np.flatnonzero(np.diff(family)) + 1
        for part in np.split(np.arange(len(doc)), cuts):
            if not len(part):
                continue
            places: dict[bytes, int] = {}
            span, least = [], []
            for k in part.tolist():  # in order of id: the first to have a content has the smallest id
                content = whole[first[k] : last[k] + length]
                place = places.setdefault(content, len(places))
                if place == len(least):
                    least.append(numbers[doc[k]])
                span.append(place)
            sizes = np.fromiter(map(len, places), np.int32, len(places))
            values = (
                int(family[part[0]]), path, b"".join(places), sizes.tobytes(), np.array(least, np.int64).tobytes(), np.array(span, np.int32).tobytes(),
                doc[part].astype(np.int32).tobytes(), numbers[doc[part]].tobytes(), (first[part] - offsets[doc[part]]).tobytes(),
            )
            for name, value in zip(rows, values):
                rows[name].append(value)
        return pa.Table.from_batches([record_batch(rows, schema)])

    return run


CONTENTS = "family long, block string, bytes binary, sizes binary, least binary, span binary, doc binary, doc_id binary, start binary"


# --- the index family

class SuffixArrays:
    """Levels of sorted windows, each with the id that had it first."""

    def __init__(self, length: int):
        self.kind = f"S{length}"
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def first_ids(self, windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Smallest id that has each window, in this batch or before; batches and their rows come in order of id."""
        order = np.argsort(windows, kind="stable")  # the batch's suffix array; equal windows stay in order of id
        ranked = windows[order]
        head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        unique, firsts = ranked[head], ids[order][head]
        new = np.ones(len(unique), bool)
        for level, known in self.levels:
            at = np.minimum(np.searchsorted(level, unique), len(level) - 1)  # both are sorted: a merge scan
            same = level[at] == unique
            firsts[same] = known[at[same]]
            new &= ~same
        out = np.empty(len(windows), np.int64)
        out[order] = firsts[np.cumsum(head) - 1]
        self._push(unique[new], firsts[new])
        return out

    def _push(self, windows: np.ndarray, ids: np.ndarray) -> None:
        if not len(windows):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(windows):
            other, other_ids = self.levels.pop()
            merged = np.concatenate([other, windows])
            order = np.argsort(merged, kind="stable")
            windows, ids = merged[order], np.concatenate([other_ids, ids])[order]
        self.levels.append((windows, ids))


def _match(length: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        payloads = []
        for row in group.select(["block", "bytes", "sizes", "least", "span", "doc", "doc_id", "start"]).to_pylist():
            kinds = {"sizes": np.int32, "least": np.int64, "span": np.int32, "doc": np.int32, "doc_id": np.int64, "start": np.int64}
            payloads.append(row | {k: np.frombuffer(row[k], t) for k, t in kinds.items()})
        sizes = np.concatenate([p["sizes"] for p in payloads]).astype(np.int64)
        least = np.concatenate([p["least"] for p in payloads])
        data = np.frombuffer(b"".join(p["bytes"] for p in payloads), np.uint8)
        begins = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        slots = np.cumsum(counts) - counts  # of each content's windows
        firsts = np.empty(int(counts.sum()), np.int64)
        views = np.lib.stride_tricks.sliding_window_view(data, length)
        index = SuffixArrays(length)
        order = np.argsort(least, kind="stable")
        # batches end where the id changes, so that a document never meets itself in an earlier batch with another id
        held = np.cumsum(counts[order])
        low = 0
        while low < len(order):
            high = int(np.searchsorted(held, (held[low - 1] if low else 0) + BATCH_WINDOWS)) + 1
            batch = order[low:high]
            n = counts[batch]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            windows = np.ascontiguousarray(views[np.repeat(begins[batch], n) + inner]).view(index.kind).ravel()
            firsts[np.repeat(slots[batch], n) + inner] = index.first_ids(windows, np.repeat(least[batch], n))
            low = high
        out: dict[str, list] = {"block": [], "docs": [], "starts": [], "ends": []}
        base = 0
        for p in payloads:
            span = p["span"].astype(np.int64) + base
            base += len(p["sizes"])
            n = counts[span]
            row = np.repeat(np.arange(len(span)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            seen = firsts[np.repeat(slots[span], n) + inner] < np.repeat(p["doc_id"], n)
            row, inner = row[seen], inner[seen]
            if not len(row):
                continue
            cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(inner) != 1)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(row)]]) - 1
            begin = p["start"][row[first]]
            out["block"].append(p["block"])
            out["docs"].append(p["doc"][row[first]].tobytes())
            out["starts"].append((begin + inner[first]).tobytes())
            out["ends"].append((begin + inner[last] + length).tobytes())
        return pa.table({"block": pa.array(out["block"], pa.string()), **{c: pa.array(out[c], pa.binary()) for c in ("docs", "starts", "ends")}})

    return run


# --- cutting

def merged(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each document with the lows and highs of its maximal removed runs."""
    order = np.lexsort((ends, starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    for part in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(docs)) + 1):
        if len(part):
            reach = np.maximum.accumulate(ends[part])
            cut = np.flatnonzero(starts[part][1:] > reach[:-1]) + 1
            yield int(docs[part[0]]), starts[part][np.concatenate([[0], cut])], reach[np.concatenate([cut, [len(part)]]) - 1]


def intervals(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *[np.frombuffer(b, t) for b in group[c].to_pylist() if b is not None]]) for c, t in (("docs", np.int32), ("starts", np.int64), ("ends", np.int64)))


def without(text: bytes, lows: np.ndarray, highs: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *highs.tolist()], [*lows.tolist(), len(text)]))


def _cut(with_text: bool):
    names = ["block", "doc", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        path = key[0].as_py()
        _, lengths, data = read_block(path)
        offsets = np.cumsum(lengths) - lengths
        out: dict[str, list] = {n: [] for n in names}
        for doc, lows, highs in merged(*intervals(group)):
            kept = without(data[offsets[doc] : offsets[doc] + lengths[doc]].tobytes(), lows, highs)
            for name, value in zip(names, (path, doc, int((highs - lows).sum()), len(lows), hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                out[name].append(value)
        return pa.table({n: pa.array(out[n], k) for n, k in zip(names, kinds)})

    return run


def _cut_rows(kind: T.StructType):
    """All rows of a block, with what is left of their texts; ``changed`` tells which of them lost something."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        rows = block_rows(key[0].as_py())
        texts = rows["text"].to_pylist()
        changed = [False] * len(texts)
        copies = [d for d in group["copy"].to_pylist() if d is not None]
        for doc, lows, highs in merged(*intervals(group)):
            texts[doc], changed[doc] = without(texts[doc], lows, highs).decode("utf-8", "ignore").encode(), True
        for doc in copies:
            texts[doc], changed[doc] = b"", True
        own = {"text": pa.array(texts, schema.field("text").type), "changed": pa.array(changed, pa.bool_())}
        return pa.Table.from_arrays([own[f.name] if f.name in own else rows[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _search(picked: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Blocks of the rows of ``picked`` (``id`` and ``text`` first, and what else is to be kept with them): a row per document, the
    documents that copy an earlier one, the removed intervals of all others, and the number of tasks that blocks are dealt to."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(total / 18 / ANCHORS_PER_BUCKET).bit_length())
    families = 4 << bits
    # what a block is sent is little beside what its task reads and makes of it, so its size must not decide
    tasks = max(2 * picked.sparkSession.sparkContext.defaultParallelism, total // BYTES_PER_TASK)
    folder = scratch_path(picked.sparkSession, "blocks")
    system, base = open_uri(folder)
    system.create_dir(base, recursive=True)
    rows = cut_lineage(map_task(picked, _blocks(folder, bits, length), BLOCK_ROWS))
    docs_seen = rows.where("bucket IS NULL").select("block", "doc", "id", "n_bytes", "sha")
    shared = rows.where("bucket IS NOT NULL").select("bucket", "block", "hashes", "repeated").groupBy("bucket").applyInArrow(_shared, "block string, shared binary")
    # whole copies of an earlier text
    originals = docs_seen.where(F.col("id").isNotNull() & (F.col("n_bytes") >= length)).groupBy("sha").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = cut_lineage(spread_join(docs_seen, originals.select("sha", "first_id"), ["sha"], ["id"]).where("id > first_id").select("block", "doc"))
    asked = shared.select("block", "shared", F.lit(None).cast("int").alias("copy")).union(
        copies.select("block", F.lit(None).cast("binary"), F.col("doc"))
    )
    contents = asked.repartition(tasks, "block").groupBy("block").applyInArrow(_contents(bits, families, length), CONTENTS)
    return docs_seen, copies, contents.groupBy("family").applyInArrow(_match(length), INTERVALS), tasks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = False) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row, and with ``with_text`` what is left as ``kept`` (binary, null where nothing changed)."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    docs_seen, copies, found, tasks = _search(picked, length)
    cut = found.repartition(tasks, "block").groupBy("block").applyInArrow(_cut(with_text), "block string, doc int, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = copies.withColumn("copy", F.lit(True))
    empty = F.lit(b"") if with_text else F.lit(None).cast("binary")
    out = docs_seen.join(whole, ["block", "doc"], "left").join(cut_lineage(cut), ["block", "doc"], "left")
    return out.select(
        "id", "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), empty).otherwise(F.col("kept")).alias("kept"), "block", "doc",
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = 50) -> DataFrame:
    """All rows of ``docs`` with the repeated passages cut out of their texts, and ``length_col`` counted anew.

    Texts of rows with a null id stay as they are. A character of which a byte was cut goes as a whole.
    """
    # columns travel by number, so that none of their names meets one of these
    others = {c: f"c{k}" for k, c in enumerate(docs.columns) if c != text_col}
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in others.items()])
    docs_seen, copies, found, tasks = _search(picked, length)
    none = F.lit(None).cast("binary")
    found = cut_lineage(found).select("block", "docs", "starts", "ends", F.lit(None).cast("int").alias("copy"))
    whole = copies.select("block", none, none, none, "doc")
    every = docs_seen.where("doc = 0").select("block", none, none, none, F.lit(None).cast("int"))
    kind = T.StructType([*[picked.schema[n] for n in others.values()], T.StructField("text", T.BinaryType()), T.StructField("changed", T.BooleanType())])
    rows = found.union(whole).union(every).repartition(tasks, "block").groupBy("block").applyInArrow(_cut_rows(kind), kind)
    text = F.col("text").cast(docs.schema[text_col].dataType)
    out = {c: text if c == text_col else F.col(others[c]) for c in docs.columns}
    if length_col:
        out[length_col] = F.when(F.col("changed"), F.char_length(text).cast(docs.schema[length_col].dataType)).otherwise(out[length_col])
    return rows.select(*[c.alias(name) for name, c in out.items()])

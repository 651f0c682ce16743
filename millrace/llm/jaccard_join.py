"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, and their components.

1. Of texts with equal sets, only the one with the smallest id goes on.
2. All shingles are counted in a sketch of fixed size; tokens are ordered by
   the level of their count, then by hash, so frequent ones come last.
3. Adaptive multi-match prefixes: a set of ``s`` tokens that needs ``T =
   ceil(0.8 s)`` common ones has, for every ``l``, at least ``l`` of them among the first
   ``s - T + l`` tokens of both. Each document takes the ``l`` with the least estimated cost (rows read
   plus candidates to verify), not below a least one that grows with ``s``; pairs need ``min(l, l')`` common prefix tokens.
4. Documents that share prefix tokens meet through the smallest of them (its hub), so a list
   of n documents gives n candidates. Verified hub links leave few documents
   unlinked; these are compared with the other documents of their hub in blocks. Pairs across
   hubs are found between groups: lists of groups, not of documents, are joined, and
   a group meets the documents of all smaller ones in blocks.
5. Verification compares whole sets, block against block in numpy, and
   returns a forest of links: no list of all pairs is ever made.

The links found have the same components as all links with similarity of the
threshold or more.

Defined results: a null or blank text has an empty set, links with nothing
and is its own component; rows with equal id are one document; a null id links
with nothing and has no component; all rows are returned; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import map_task, record_batch
from millrace.llm.components import connected_components, forest
from millrace.llm.shingles import WordHashes, shingle_set
from millrace.operators.skew import spread_join
from millrace.session import cut_lineage

SKETCH_BITS, SKETCH_BLOCKS = 21, 16
FILTER_BITS, FILTER_BLOCKS = 26, 128
LEAST_MATCHES, SIZE_A_MATCH, MORE_MATCHES = 32, 16, 8
VERIFY_COST = 20.0
BLOCK = 256
TASK_ROWS = 4000
PACKED_TOKENS = 1_000_000
TOKENS_A_BUCKET = 1 << 19
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))


def least_common(size: np.ndarray | int, percent: int):
    """Common tokens that a set of this size needs with any similar set."""
    return -(-size * percent // 100)


def least_matches(size):
    """The least number of common prefix tokens that a set of this size requires: it never falls as sizes grow."""
    return np.minimum(1 + size // SIZE_A_MATCH, LEAST_MATCHES)


# --- signatures and the sketch: first pass over the texts

def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, signs = [], []
            pending, held = [], 0
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, hashes, words)
                sizes.append(len(tokens))
                signs.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                pending.append(tokens)
                held += len(tokens)
                if held > 1_000_000:
                    _add(counts, pending)
                    pending, held = [], 0
            _add(counts, pending)
            n = len(sizes)
            yield {"id": batch.column("id"), "size": sizes, "sign": signs, "block": [None] * n, "counts": [None] * n}
        blocks = range(SKETCH_BLOCKS) if counts.any() else []
        yield {
            "id": [None] * len(blocks), "size": [None] * len(blocks), "sign": [None] * len(blocks), "block": list(blocks),
            "counts": [zlib.compress(counts.reshape(SKETCH_BLOCKS, -1)[b].tobytes(), 1) for b in blocks],
        }

    return run


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _add(counts: np.ndarray, sets: list[np.ndarray]) -> None:
    if sets:
        counts += np.bincount(_slots(np.concatenate(sets)), minlength=len(counts)).astype(np.uint32)


def _sum_block(key: tuple, group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(b), np.uint32).astype(np.int64) for b in group["counts"].to_pylist())
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<u4").tobytes()], pa.binary())})


def sketch_levels(rows: DataFrame) -> np.ndarray:
    """Level of every slot of the sketch: 0 up to four times the mean count, then one more for each doubling. Its size is fixed (2 MB)."""
    parts = rows.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_sum_block, "block int, counts binary").collect()
    counts = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS))
    for r in parts:
        counts[r.block] = np.frombuffer(r.counts, "<u4")
    ratio = counts.ravel() / (4 * counts.mean() + 16)
    return np.where(ratio < 1, 0, 1 + np.log2(np.maximum(ratio, 1))).astype(np.uint8)


# --- prefixes: second pass

def choose_matches(levels: np.ndarray, base: int, most: int) -> int:
    """How many common prefix tokens to require: the number with the least estimated cost, up to ``MORE_MATCHES`` over the least.

    ``levels`` are those of the set's tokens in order. The lists of the first ``base + l - 1`` tokens are read, and
    at most a ``1/l`` of their rows are documents with ``l`` matches, each of which must be verified.
    """
    least = int(least_matches(len(levels)))
    most = max(1, min(most, least + MORE_MATCHES, len(levels) - base + 1))
    least = min(least, most)
    rows = np.cumsum(np.exp2(levels[: base + most - 1].astype(float)))[base + least - 2 :]
    l = np.arange(least, most + 1)  # noqa: E741
    return int(l[np.argmin(rows * (1 + VERIFY_COST / l))])


def _pack(sets: list[np.ndarray], node: list[int], size: list[int], matches: list[int], bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Per bucket, the prefix tokens of a block of documents, sorted, with the documents they belong to."""
    tokens = np.concatenate(sets) >> np.uint64(32 - bits)
    owner = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    bucket = (tokens >> np.uint64(32)).astype(np.int64)
    table = [np.array(node, np.int64), np.array(size, np.int32), np.array(matches, np.uint8)]
    for part in np.split(np.arange(len(tokens)), np.flatnonzero(np.diff(bucket)) + 1):
        used, place = np.unique(owner[part], return_inverse=True)
        small = tokens[part].astype(np.uint32)
        arrays = [np.diff(small, prepend=np.uint32(0)), place.astype(np.uint32), *[t[used] for t in table]]
        # deltas of sorted hashes and small numbers: a third of the size of plain rows
        raw = np.array([len(part), len(used)], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)
        yield int(bucket[part[0]]), len(raw), pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes, full: int) -> list[np.ndarray]:
    raw = pa.decompress(blob, full, "zstd", asbytes=True)
    tokens, nodes = np.frombuffer(raw, np.int64, 2).tolist()
    out, at = [], 16
    for kind, n in ((np.uint32, tokens), (np.uint32, tokens), (np.int64, nodes), (np.int32, nodes), (np.uint8, nodes)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    place = out[1]
    return [np.cumsum(out[0], dtype=np.uint32), *[x[place].astype(np.int64) for x in out[2:]]]


def _prefixes(shared_levels, words: int, percent: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, levels = WordHashes(), shared_levels.value
        held: tuple[list, list, list, list] = ([], [], [], [])

        def flush() -> dict:
            packed = list(_pack(*held, bits)) if held[0] else []
            for part in held:
                part.clear()
            return {"bucket": [p[0] for p in packed], "full": [p[1] for p in packed], "packed": [p[2] for p in packed]}

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                tokens = shingle_set(text, hashes, words)
                if not len(tokens) or doc_id is None:
                    continue
                level = levels[_slots(tokens)]
                order = np.lexsort((tokens, level)) if level.any() else np.arange(len(tokens))
                need = int(least_common(len(tokens), percent))
                matches = choose_matches(level[order], len(tokens) - need + 1, need)
                for part, value in zip(held, (tokens[order[: len(tokens) - need + matches]], doc_id, len(tokens), matches)):
                    part.append(value)
            if sum(map(len, held[0])) > PACKED_TOKENS:
                yield flush()
        yield flush()

    return run


# --- candidates

def _lists(key: tuple, group: pa.Table) -> pa.Table:
    """Tokens of a bucket that several nodes have, each with the smallest node as its hub."""
    parts = [_unpack(b, n) for b, n in zip(group["packed"].to_pylist(), group["full"].to_pylist())]
    token, node, size, matches = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((node, token))
    token, node, size, matches = (x[order] for x in (token, node, size, matches))
    fresh = np.concatenate([[True], token[1:] != token[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), 0))
    several = np.bincount(head, weights=node != node[head], minlength=len(token))[head] > 0
    keep, head = np.flatnonzero(several), head[several]
    whole = (key[0].as_py() << 32) + token[keep].astype(np.int64)
    return pa.table({
        "token": whole, "node": node[keep], "size": size[keep], "matches": matches[keep], "hub": node[head], "hub_size": size[head], "hub_matches": matches[head],
    })


def cold_rows(per_token: DataFrame, percent: int) -> DataFrame:
    """``per_token`` without the tokens with the longest lists of each group, with ``matches`` and ``spare`` of the group.

    All sets similar to one of ``s`` tokens have ``t = ceil(0.8 s)`` or more, so such pairs have at least
    ``least_matches(t)`` common prefix tokens: of the ``spare`` = one less with the longest lists, none is needed. Lengths are
    rounded to steps, so a group has few of them, and ties are left out together or not at all.
    """
    step = F.when(F.col("length") < 64, F.col("length")).otherwise(F.floor(8 * F.log2("length")) + 16).cast("long")
    rows = per_token.withColumn("step", step)
    smallest = F.least(1 + F.floor(F.ceil(F.col("least_size") * percent / 100) / SIZE_A_MATCH), F.lit(LEAST_MATCHES))
    steps = rows.groupBy("group", "step").agg(F.count("*").alias("n"), F.min("matches").alias("matches"), F.min("low").alias("low"))
    above = Window.partitionBy("group").orderBy(F.desc("step"))
    whole = Window.partitionBy("group")
    limits = (
        steps.withColumn("least_size", F.min("low").over(whole)).withColumn("least", F.min("matches").over(whole))
        .withColumn("spare", F.greatest(F.least(smallest, "least") - 1, F.lit(0)))
        .withColumn("after", F.sum("n").over(above)).where("after > spare")
        .groupBy("group").agg(F.max("step").alias("limit"), F.min("spare").alias("spare"), F.min("least").alias("matches"))
    )
    return rows.drop("matches").join(limits, "group").where(F.col("step") <= F.col("limit")).drop("step", "limit", "length")


def hubs_and_groups(shared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hub candidates ``(hub, node)``, groups ``(group, node)``, and pairs of groups ``(g1, g2)`` that may hold a link."""
    similar = (100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")) & (F.col("hub") != F.col("node"))
    met = (
        shared.where(similar).groupBy("hub", "node")
        .agg(F.count("*").alias("n"), F.min(F.least("matches", "hub_matches")).alias("need"), F.min("size").alias("size"))
    )
    candidates = cut_lineage(met.where("n >= need"))
    # a node belongs to the group of the hub it shares most with, if that is much; hubs belong to their own group too
    strong = candidates.where(F.col("n") * 500 >= F.col("size") * (100 - percent)).groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("group"))
    strong = cut_lineage(strong)
    members = strong.union(strong.select(F.col("group").alias("node"), "group")).distinct()
    grouped = shared.join(strong, "node", "left").select("token", F.coalesce("group", "node").alias("group"), "size", "matches")
    # written before it is used twice: the join of all lists with their groups is the widest step here
    per_token = cut_lineage(grouped.groupBy("token", "group").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("matches").alias("matches")))
    length = per_token.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    per_token = cut_lineage(per_token.join(length, "token"))
    x, y = (cold_rows(per_token, percent).alias(side) for side in "xy")
    close = (percent * F.col("x.low") <= 100 * F.col("y.high")) & (percent * F.col("y.low") <= 100 * F.col("x.high"))
    pairs = (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.group") < F.col("y.group")) & close)
        .groupBy(F.col("x.group").alias("g1"), F.col("y.group").alias("g2"))
        # of the common tokens, sorted by length, each side leaves out the first ``spare`` at most
        .agg(F.count("*").alias("n"), F.min(F.least("x.matches", "y.matches") - F.greatest("x.spare", "y.spare")).alias("need"))
        .where("n >= need").select("g1", "g2")
    )
    return candidates.select("hub", "node"), cut_lineage(members), cut_lineage(pairs)


# --- whole texts of the candidates: third pass

def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hashed id, in a filter of fixed size (8 MB); more ids only make it less selective."""
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    width = (1 << FILTER_BITS) // FILTER_BLOCKS

    def bits(key: tuple, group: pa.Table) -> pa.Table:
        block = np.zeros(width, bool)
        block[group["slot"].to_numpy() % width] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(block).tobytes()], pa.binary())})

    slots = ids.select(slot.alias("slot")).distinct().withColumn("block", F.floor(F.col("slot") / width).cast("long"))
    out = np.zeros((FILTER_BLOCKS, width // 8), np.uint8)
    for r in slots.groupBy("block").applyInArrow(bits, "block long, bits binary").collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def pack_text(text: bytes | None) -> bytes:
    """A text in lower case, compressed, behind its length: a third of the size of its hashed shingles."""
    text = (text or b"").lower()
    return len(text).to_bytes(8, "little") + (pa.compress(text, "zstd", asbytes=True) if text else b"")


def unpack_text(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b""


def _texts(shared_filter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = shared_filter.value
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            asked = np.flatnonzero((bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1)
            picked = batch.take(pa.array(asked))
            yield {"node": picked.column("id"), "text": [pack_text(t) for t in picked.column("text").to_pylist()]}

    return run


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of token sets, one of either side, that are similar enough."""
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right)]
    if len(left) > len(right):
        b, a = similar_pairs(right, left, percent)
        return a, b
    flat = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), sizes[1])
    if len(left) <= 4:
        common = np.zeros((len(left), len(right)))
        for i, tokens in enumerate(left):
            at = np.minimum(np.searchsorted(tokens, flat), len(tokens) - 1)
            common[i] = np.bincount(owner[tokens[at] == flat], minlength=len(right))
    else:
        mine = np.concatenate(left)
        vocabulary = np.intersect1d(mine, flat)
        my_owner = np.repeat(np.arange(len(left)), sizes[0])
        common = np.zeros((len(left), len(right)), np.float32)
        places = [np.searchsorted(vocabulary, t) for t in (mine, flat)]
        inside = [(p < len(vocabulary)) & (vocabulary[np.minimum(p, len(vocabulary) - 1)] == t) if len(vocabulary) else p < 0 for p, t in zip(places, (mine, flat))]
        for low in range(0, len(vocabulary), 4096):
            parts = []
            for p, ok, who, n in zip(places, inside, (my_owner, owner), (len(left), len(right))):
                here = ok & (p >= low) & (p < low + 4096)
                part = np.zeros((n, 4096), np.float32)
                part[who[here], p[here] - low] = 1
                parts.append(part)
            common += parts[0] @ parts[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return np.nonzero(100 * common >= percent * union)


def _verify(percent: int, words: int):
    def verify(key: tuple, group: pa.Table) -> pa.Table:
        hashes = WordHashes()
        tasks, sides = group["task"].to_numpy(), group["side"].to_numpy()
        nodes = group["node"].to_numpy()
        blobs = group["text"].to_pylist()
        sets = {b: shingle_set(unpack_text(b), hashes, words) for b in set(blobs)}  # a text may be in several tasks of a bin
        tokens = [sets[b] for b in blobs]
        highs, lows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.lexsort((nodes, sides, tasks))
        order = order[[len(tokens[k]) > 0 for k in order]]  # an id that occurs again may have an empty text
        cuts = np.flatnonzero(np.diff(tasks[order])) + 1
        for part in np.split(order, cuts):
            left, right = part[sides[part] == 0], part[sides[part] == 1]
            if not len(left) or not len(right):
                continue
            i, j = similar_pairs([tokens[k] for k in left], [tokens[k] for k in right], percent)
            a, b = nodes[left[i]], nodes[right[j]]
            high, low = forest(np.maximum(a, b)[a != b], np.minimum(a, b)[a != b])
            highs.append(high), lows.append(low)
        return pa.Table.from_batches([record_batch({"a": pa.array(np.concatenate(highs)), "b": pa.array(np.concatenate(lows))}, LINK)])

    return verify


def verified_links(tasks: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links inside the tasks: each compares the sets of its nodes of side 0 with those of side 1."""
    tasks = cut_lineage(tasks)
    bins = max(1, -(-tasks.count() // TASK_ROWS))
    dealt = tasks.join(texts, "node").withColumn("bin", F.pmod("task", F.lit(bins)))
    return cut_lineage(dealt.groupBy("bin").applyInArrow(_verify(percent, words), "a long, b long"))


def block_tasks(left: DataFrame, right: DataFrame, seed: int) -> DataFrame:
    """Tasks of at most about ``BLOCK`` nodes a side that compare all nodes of ``left`` with all of ``right``, per ``key``."""
    def blocks(side: DataFrame) -> DataFrame:
        return side.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))

    shape = blocks(left).withColumnRenamed("blocks", "rows").join(blocks(right).withColumnRenamed("blocks", "cols"), "key")
    task = F.xxhash64("key", "row", "col", F.lit(seed)).alias("task")
    number = lambda n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1).cast("array<long>"))
    rows = left.join(shape, "key").withColumn("row", number("rows")).withColumn("col", each("cols")).select(task, F.lit(0).alias("side"), "node")
    cols = right.join(shape, "key").withColumn("col", number("cols")).withColumn("row", each("rows")).select(task, F.lit(1).alias("side"), "node")
    return rows.union(cols)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: ``id, size, sign`` of each row, and links between ids that have the components of all links."""
    picked = _picked(docs, id_col, text_col)
    spark = docs.sparkSession
    first = cut_lineage(map_task(picked, _signatures(words), "id long, size long, sign binary, block int, counts binary"))
    rows = first.where("block IS NULL").select("id", "size", "sign")
    # of texts with equal sets only the one with the smallest id is a node
    equal = rows.where("id IS NOT NULL AND sign IS NOT NULL")
    firsts = equal.groupBy("sign").agg(F.min("id").alias("node"), F.count("*").alias("n")).where("n > 1")
    copies = cut_lineage(spread_join(equal, firsts, ["sign"], ["id"]).where("id > node").select("id", "node"))
    levels = spark.sparkContext.broadcast(sketch_levels(first))
    total = rows.agg(F.sum("size")).first()[0] or 0
    bits = max(5, int(total * (100 - percent) / 100 / TOKENS_A_BUCKET).bit_length())
    repeated = equal.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")  # such an id may have other texts too
    single = picked.where("id IS NOT NULL").join(cut_lineage(copies.select("id").join(repeated, "id", "left_anti")), "id", "left_anti")
    packed = map_task(single, _prefixes(levels, words, percent, bits), "bucket long, full long, packed binary")
    lists = packed.groupBy("bucket").applyInArrow(_lists, "token long, node long, size long, matches long, hub long, hub_size long, hub_matches long")
    candidates, members, pairs = hubs_and_groups(cut_lineage(lists), percent)
    in_pairs = pairs.select(F.col("g1").alias("group")).union(pairs.select(F.col("g2").alias("group"))).distinct()
    # a node without a group is one of its own
    asked = candidates.select(F.col("hub").alias("id")).union(candidates.select("node")).union(in_pairs.select("group")).union(members.select("node")).distinct()
    wanted = spark.sparkContext.broadcast(id_filter(asked))
    slot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)).alias("slot")
    # the few that pass the filter by chance meet no task
    texts = cut_lineage(map_task(picked.where("id IS NOT NULL").select("id", "text", slot), _texts(wanted), "node long, text binary"))

    stars = block_tasks(candidates.select(F.col("hub").alias("key"), F.col("hub").alias("node")).distinct(), candidates.select(F.col("hub").alias("key"), "node"), 1)
    links = verified_links(stars, texts, percent, words)
    label = connected_components(links).withColumnRenamed("component", "label")
    labelled = cut_lineage(
        members.union(in_pairs.join(members, "group", "left_anti").select(F.col("group").alias("node"), "group"))
        .join(label, "node", "left").select("group", "node", F.coalesce("label", "node").alias("label"))
    )
    # against all nodes of a group: those of its nodes that are not linked with its hub
    hub_label = labelled.where("group = node").select("group", F.col("label").alias("hub_label"))
    apart = labelled.join(hub_label, "group").where("label <> hub_label").select(F.col("group").alias("key"), "node")
    # and the nodes of all smaller groups that may have a link into it, unless both are one component already
    shape = labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"))
    side = lambda g: shape.select(F.col("group").alias(g), *[F.col(c).alias(f"{c}_{g}") for c in ("low", "high", "n")])
    open_pairs = (
        pairs.join(side("g1"), "g1").join(side("g2"), "g2").where("low_g1 <> high_g2 OR low_g1 <> high_g1 OR low_g2 <> high_g2")
        .select(F.expr("if(n_g1 >= n_g2, g1, g2)").alias("key"), F.expr("if(n_g1 >= n_g2, g2, g1)").alias("group"))
    )
    left = cut_lineage(apart.union(open_pairs.join(labelled.select("group", "node"), "group").select("key", "node")).distinct())
    right = labelled.select(F.col("group").alias("key"), "node").join(left.select("key").distinct(), "key", "left_semi")
    more = verified_links(block_tasks(left, right, 2), texts, percent, words)
    return rows, links.union(more).union(copies.select(F.col("id").alias("a"), F.col("node").alias("b")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """``id, n_shingles, component_id`` of every row."""
    rows, links = jaccard_links(docs, id_col, text_col, percent, words)
    components = connected_components(links)
    return rows.select("id", "size").join(components.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "id", F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their columns: the smallest id, once; rows with a null id stay."""
    components = jaccard_components(docs, id_col, text_col, percent, words)
    others = cut_lineage(components.where("id <> component_id").select(F.col("id").alias(id_col)).distinct())
    repeated = cut_lineage(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(id_col)).count().where("count > 1").select(id_col))
    kept = docs.join(others, id_col, "left_anti")
    once = kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
    return kept.join(repeated, id_col, "left_anti").select(*docs.columns).union(once.select(*docs.columns))

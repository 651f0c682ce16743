"""Personal data in texts: patterns, and a skip-chain conditional random field for the mentions that patterns miss.

Base spans come from four patterns with their checks. The nodes of a
document's field are its base spans, whose labels are known, and the open mentions: other
runs of digits (seven or more, or four groups) and words that equal the local part of an
address in the document. Labels are ``none`` and the four kinds. Neighbours in the
text are joined by chain edges; mentions with equal digits, groups or local parts, however far
apart, by skip edges, and those that agree in their last seven digits by skip edges of another
sort. Each sort of edge has one table of potentials shared by all documents, so a number that is a card
in one place makes the same number in another form a card elsewhere. Loopy message passing over all
documents of a batch at once gives a probability per node; open
mentions with ``least_score`` or more for a kind become spans.

Training maximises the likelihood under the same message passing, drawn towards stated first weights. Its
texts are a sample of at most about ``max_training_docs`` documents with 500 nodes
or fewer: their own base mentions are written again in forms that the patterns miss
(labelled with their kind), beside made-up numbers in such forms (labelled none). Everything
else reads every whole text.

Occurrences of a key are joined one to the next, so edges grow with the text,
never with the square of a key's occurrences; patterns run in linear time.

Defined results: a null or empty text has no spans; rows are kept as they are,
with null and repeated ids; other columns are not read. Without any document to learn from the first weights hold.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
EDGES = ("chain", "same", "similar")
SCHEMA = "id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# possessive, and only at the start of a run of digits: the same matches in linear time
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ .()/-]{0,3}+[0-9])++")
WORD = re.compile(r"[A-Za-z0-9._%+-]++")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")

LEAST_DIGITS, TAIL, NEAR, CONTEXT = 7, 7, 60, 256
STEPS, DAMPING = 12, 0.3
TRAINING_NODES = 500

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_BEFORE.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and then by kind as listed."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in emails(text)]
    if DIGITS.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field of a document

class Field:
    """Nodes and edges of one document, numbered from 0."""

    __slots__ = ("spans", "known", "features", "edges")

    def __init__(self, text: str, base: list[Span]):
        spans: list[tuple[int, int, int]] = [(a, b, LABELS.index(kind)) for a, b, kind in base]
        spans += [(a, b, -1) for a, b in open_mentions(text, base)]
        spans.sort()
        self.spans = [(a, b) for a, b, _ in spans]
        self.known = [k for _, _, k in spans]
        keys = [mention_keys(text[a:b], k) for a, b, k in spans]
        self.features = [node_features(text, a, b, k) for a, b, k in spans]
        self.edges: list[tuple[int, int, int]] = [
            (i, i + 1, 0) for i in range(len(spans) - 1) if 0 <= spans[i + 1][0] - spans[i][1] <= NEAR
        ]
        last: dict[str, int] = {}
        for i, (same, similar) in enumerate(keys):
            partners: set[int] = set()
            for sort, group in ((1, same), (2, similar)):
                for key in group:
                    before = last.get(key)
                    if before is not None and before not in partners:
                        partners.add(before)
                        self.edges.append((before, i, sort))
                    last[key] = i


def open_mentions(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs of digits and local parts of known addresses that touch no base span."""
    ends: list[int] = []  # merged base spans
    starts: list[int] = []
    for a, b, _ in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    taken = set()
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if b - a < LEAST_DIGITS or a and (text[a - 1].isalnum() or text[a - 1] == "@") or text[b : b + 1].isalnum():
            continue
        groups = DIGITS.findall(m[0])
        if (sum(map(len, groups)) >= LEAST_DIGITS or len(groups) == 4) and free(a, b):
            taken.add(a)
            yield a, b
    locals_ = {text[a:b].partition("@")[0].lower() for a, b, kind in base if kind == "email"}
    locals_ = {x for x in locals_ if len(x) >= 5}
    if locals_:
        for m in WORD.finditer(text):
            if m[0].lower() in locals_ and m.start() not in taken and free(m.start(), m.end()):
                yield m.span()


def mention_keys(mention: str, known: int) -> tuple[list[str], list[str]]:
    """Keys of equal and of similar mentions."""
    if "@" in mention or NOT_LOCAL.search(mention) is None and not mention.replace(".", "").replace("-", "").isdigit():
        return [f"l{mention.partition('@')[0].lower()}"], []
    groups = DIGITS.findall(mention)
    digits = "".join(groups)
    same = [f"d{digits}"] if len(digits) >= LEAST_DIGITS else []
    if len(groups) == 4 and all(len(g) <= 3 for g in groups):
        same.append("g" + ".".join(groups))
    return same, [f"s{digits[-TAIL:]}"] if len(digits) >= LEAST_DIGITS and not same[1:] else []


SIZES = [7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20]
SHAPES = 40


def node_features(text: str, a: int, b: int, known: int) -> list[int]:
    """Numbers of the node's features: its shape, and the words before and behind it. Base spans need none."""
    if known >= 0:
        return [0]
    mention = text[a:b]
    groups = DIGITS.findall(mention)
    wordy = any(c.isalpha() for c in mention)
    found = [1 if wordy else 2]
    if not wordy:
        digits = "".join(groups)
        found += [3 + bisect_left(SIZES, len(digits)), 16 + min(len(groups), 6)]
        found += [23 + k for k, c in enumerate(" .-(/") if c in mention]
        if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
            found.append(28)
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(29)
        if a and text[a - 1] in "+(":
            found.append(30)
    before, behind = text[max(0, a - 24) : a].split(), text[b : b + 24].split()
    found.append(SHAPES + crc32(before[-1].lower().encode()) % CONTEXT if before else 31)
    found.append(SHAPES + CONTEXT + crc32(behind[0].lower().encode()) % CONTEXT if behind else 32)
    return found


FEATURES = SHAPES + 2 * CONTEXT


class Graph:
    """The fields of several documents side by side, as arrays."""

    def __init__(self, fields: list[Field]):
        sizes = [len(f.spans) for f in fields]
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.first = first
        self.known = np.array([k for f in fields for k in f.known], np.int64)
        lists = [x for f in fields for x in f.features]
        self.feature = np.array([x for one in lists for x in one], np.int64)
        self.owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        edges = np.array([(a + o, b + o, t) for f, o in zip(fields, first.tolist()) for a, b, t in f.edges], np.int64).reshape(-1, 3)
        self.a, self.b, self.sort = edges.T


def spread(graph: Graph, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every node's labels, and of every edge's label pairs, after loopy message passing."""
    n, labels = len(graph.known), len(LABELS)
    unary = np.stack([np.bincount(graph.owner, weights=w[graph.feature], minlength=n) for w in weights.T], axis=1)
    fixed = np.flatnonzero(graph.known >= 0)
    unary[fixed] = -30.0
    unary[fixed, graph.known[fixed]] = 0.0
    e = len(graph.a)
    source, target = np.concatenate([graph.a, graph.b]), np.concatenate([graph.b, graph.a])
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    table = np.concatenate([pairs[graph.sort], pairs[graph.sort].transpose(0, 2, 1)])
    messages = np.zeros((2 * e, labels))

    def beliefs() -> np.ndarray:
        return unary + np.stack([np.bincount(target, weights=m, minlength=n) for m in messages.T], axis=1) if e else unary

    for _ in range(STEPS if e else 0):
        cavity = beliefs()[source] - messages[back]
        joint = cavity[:, :, None] + table
        top = joint.max(axis=1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(axis=1))
        new -= new.max(axis=1, keepdims=True)
        messages = DAMPING * messages + (1 - DAMPING) * new
    last = beliefs()
    nodes = np.exp(last - last.max(axis=1, keepdims=True))
    nodes /= nodes.sum(axis=1, keepdims=True)
    joint = (last[graph.a] - messages[e:])[:, :, None] + (last[graph.b] - messages[:e])[:, None, :] + pairs[graph.sort]
    both = np.exp(joint - joint.max(axis=(1, 2), keepdims=True)) if e else joint
    return nodes, both / both.sum(axis=(1, 2), keepdims=True) if e else both


class Model:
    """Weights of node features and potentials of the three sorts of edges; its size is fixed."""

    def __init__(self) -> None:
        labels = len(LABELS)
        self.weights = np.zeros((FEATURES, labels))
        self.weights[[1, 2], 0] = 4.0  # an open mention is nothing, unless edges say otherwise
        self.pairs = np.zeros((len(EDGES), labels, labels))
        kinds = np.diag([0.0, *[1.0] * len(KINDS)])
        self.pairs[1], self.pairs[2] = 8.0 * kinds, 3.0 * kinds
        self.weights[29, 1 + KINDS.index("card")] = 1.0

    def fit(self, graph: Graph, truth: np.ndarray, rounds: int = 120, rate: float = 0.1, variance: float = 1.0) -> Model:
        """Gradient steps (Adam) on the likelihood of ``truth``; the first weights are the mean of a Gaussian prior with this variance."""
        params, first = [self.weights, self.pairs], [self.weights.copy(), self.pairs.copy()]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        open_nodes = graph.known < 0
        one = np.eye(len(LABELS))[truth]
        for step in range(1, rounds + 1):
            nodes, both = spread(graph, self.weights, self.pairs)
            slope = np.where(open_nodes[:, None], one - nodes, 0.0)
            of_weights = np.zeros_like(self.weights)
            np.add.at(of_weights, graph.feature, slope[graph.owner])
            of_pairs = np.zeros_like(self.pairs)
            wanted = one[graph.a][:, :, None] * one[graph.b][:, None, :]
            np.add.at(of_pairs, graph.sort, wanted - both)
            of_pairs[1:] = (of_pairs[1:] + of_pairs[1:].transpose(0, 2, 1)) / 2  # skip edges have no direction
            for p, p0, g, (m, v) in zip(params, first, (of_weights, of_pairs), moments):
                g = g - (p - p0) / variance
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


# --- training texts

def rewritten(mention: str, kind: str, rng: random.Random) -> tuple[str, int, int]:
    """The mention in a form that its pattern misses, and where the mention stands therein."""
    digits = "".join(DIGITS.findall(mention))
    if kind == "email":
        local, _, host = mention.partition("@")
        return f"{local} {rng.choice(['at', '(at)', '[at]', 'AT'])} {host}", 0, len(local)
    if kind == "ip":
        out = mention.replace(".", rng.choice(["-", " . ", "/"]))
    elif kind == "card":
        out = rng.choice([".", "/", " - "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    else:
        tail = digits[-10:] if rng.random() < 0.5 else digits
        out = rng.choice([f"{tail[:-7]} {tail[-7:-4]} {tail[-4:]}", f"{tail[:-7]}/{tail[-7:-4]}-{tail[-4:]}", tail])
    return out, 0, len(out)


def made_up(mention: str, rng: random.Random) -> str:
    return "".join(rng.choice("0123456789") if c.isdigit() else c for c in mention)


def training_text(text: str) -> tuple[str, list[Span]]:
    """The text with rewritten mentions of its own, and made-up ones, after some of its words; and where those with a kind stand."""
    rng = random.Random(crc32(text.encode()))
    places = [m.end() for m in re.finditer(r"[^\W\d_]{2,}(?=\s)", text)] or [len(text)]
    added: list[tuple[int, str, Span | None]] = []
    for a, b, kind in base_spans(text):
        new, low, high = rewritten(text[a:b], kind, rng)
        added.append((rng.choice(places), new, (low, high, kind)))
        decoy = made_up(rewritten(text[a:b], kind, rng)[0], rng)
        if kind == "email":
            decoy = text[a:b].partition("@")[0]
        added.append((rng.choice(places), decoy, None))
    parts, truth, done, size = [], [], 0, 0
    for place, new, span in sorted(added, key=lambda x: x[0]):
        parts += [text[done:place], " "]
        size += place - done + 1
        if span:
            truth.append((size + span[0], size + span[1], span[2]))
        parts.append(new)
        size += len(new)
        done = place
    return "".join(parts) + text[done:], truth


def labelled_field(text: str) -> tuple[Field, list[int]]:
    """The field of a training text, and the label of each node."""
    text, truth = training_text(text)
    field = Field(text, base_spans(text))
    labels = []
    for (a, b), known in zip(field.spans, field.known):
        over = next((kind for low, high, kind in truth if low < b and a < high), "none")
        labels.append(known if known >= 0 else LABELS.index(over))
    return field, labels


def _training_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    out: dict[str, list] = {"known": [], "truth": [], "features": [], "edges": []}
    for text in batch.column("text").to_pylist():
        if "@" in text or DIGITS.search(text):
            field, truth = labelled_field(text)
            if 0 < len(field.spans) <= TRAINING_NODES:
                out["known"].append(field.known)
                out["truth"].append(truth)
                out["features"].append(field.features)
                out["edges"].append([list(e) for e in field.edges])
    yield out


def train(docs: DataFrame, text_col: str = "text", max_training_docs: int = 10_000) -> Model:
    """Fit the field on at most about ``max_training_docs`` documents, chosen at random with a fixed seed."""
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    # by row, not by text: copies of one text may be a third of all rows
    picked = texts.where(F.rand(11) < max_training_docs / max(1, texts.count()))
    schema = "known array<int>, truth array<int>, features array<array<int>>, edges array<array<int>>"
    rows = map_batches(picked, _training_batch, schema).toArrow().to_pylist()
    model = Model()
    if not rows:
        return model
    fields = []
    for r in rows:
        field = Field.__new__(Field)
        field.spans, field.known, field.features, field.edges = r["known"], r["known"], r["features"], [tuple(e) for e in r["edges"]]
        fields.append(field)
    return model.fit(Graph(fields), np.array([x for r in rows for x in r["truth"]], np.int64))


# --- prediction

def find_in(texts: list[str | None], model: Model, least_score: float = 0.9) -> list[list[dict]]:
    """All spans of each text: the base ones, and open mentions that the field gives a kind."""
    out, fields, places = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text and ("@" in text or DIGITS.search(text)) else []
        out.append([{"kind": kind, "start": a, "end": b, "base": True, "score": 1.0} for a, b, kind in base])
        # a document without base spans may still have mentions; those in documents with them have skip edges too
        if text and (base or NUMBER.search(text)):
            field = Field(text, base)
            if any(k < 0 for k in field.known):
                fields.append(field), places.append(i)
    if fields:
        graph = Graph(fields)
        nodes, _ = spread(graph, model.weights, model.pairs)
        best = nodes[:, 1:].argmax(axis=1) + 1
        score = nodes[np.arange(len(nodes)), best]
        for node in np.flatnonzero((graph.known < 0) & (score >= least_score)).tolist():
            f = int(np.searchsorted(graph.first, node, side="right")) - 1
            a, b = fields[f].spans[node - int(graph.first[f])]
            out[places[f]].append({"kind": LABELS[best[node]], "start": a, "end": b, "base": False, "score": round(float(score[node]), 6)})
    return [sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for spans in out]


def find_personal(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.9) -> DataFrame:
    """``id, spans`` of every document; spans have kind, place in code points, whether a pattern found them, and a probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"id": batch.column("id"), "spans": find_in(batch.column("text").to_pylist(), shared.value, least_score)}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, SCHEMA)

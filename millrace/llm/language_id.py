"""Language identification of mixed-language texts.

A model of hashed byte n-grams per language is counted on labelled texts.
To predict, each word gets one score per language; the script of its first
letter leaves only the languages seen with that script. A Viterbi pass over
the words, where each change of language costs ``switch_penalty``, labels spans. The
language of a text is the one whose spans hold most letters.

Training reads about ``max_training_docs`` labelled documents at most, chosen
at random with a fixed seed; prediction reads every whole text.

Defined results: null or letterless text gives ``und`` with score 0 and no
spans; ties go to the language that sorts first; without any labelled row
everything is ``und``; ids may be null or repeated; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import beside_rows, map_batches

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
BUCKETS = 1 << 16
CACHE = 200_000
WORDS_AT_ONCE = 400_000
LONG_TEXT = 1000

# First and last code point of the letter ranges of scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


def script_of(word: str) -> str:
    at = ord(word[0])
    if at <= 0x024F:
        return "latin"
    return next((name for name, low, high in SCRIPTS if low <= at <= high), "other")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of two to four bytes of the lower-case words with their ends, and the number of each gram's word."""
    parts = [f"^{w.lower()}$".encode() for w in words]
    text = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(text))  # bytes up to the word's end
    hashes, owners = [], []
    for k in (2, 3, 4):
        code = np.zeros(max(0, len(text) - k + 1), np.int64)
        for j in range(k):
            code = code * 257 + text[j : j + len(code)] + 1
        inside = left[: len(code)] >= k
        hashes.append((code * 0x9E3779B1 + k >> 7)[inside] % BUCKETS)
        owners.append(owner[: len(code)][inside])
    return np.concatenate(hashes), np.concatenate(owners)


def _count_features(batch: pa.RecordBatch) -> Iterator[dict]:
    found: dict[str, dict[str, int]] = {}
    for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
        words = found.setdefault(lang, {})
        for w in WORD.findall(text):
            words[w] = words.get(w, 0) + 1
    for lang, words in found.items():
        scripts: dict[str, int] = {}
        for w, n in words.items():
            scripts[s] = scripts.get(s := script_of(w), 0) + n
        hashes, owners = grams(list(words))
        counts = np.bincount(hashes, weights=np.fromiter(words.values(), np.int64, len(words))[owners], minlength=BUCKETS).astype(np.int64)
        used = np.flatnonzero(counts)
        yield {
            "lang": [lang] * (len(used) + len(scripts)), "script": [None] * len(used) + list(scripts),
            "bucket": [*used.tolist(), *[None] * len(scripts)], "n": [*counts[used].tolist(), *scripts.values()],
        }


class Model:
    """Word scores per language and the languages of each script; its size depends on the number of languages alone."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray]):
        self.langs = langs
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)  # bucket x language
        self.scripts = scripts

    def score(self, words: list[str]) -> np.ndarray:
        """Log-likelihood per word and language, a third as n-grams overlap; languages without the word's script are far below."""
        hashes, owners = grams(words)
        every = np.ones(len(self.langs), bool)
        allowed = np.array([self.scripts.get(script_of(w), every) for w in words])
        rows = np.stack([np.bincount(owners, weights=logs[hashes], minlength=len(words)) for logs in self.logs.T], axis=1) / 3
        return np.where(allowed, rows, rows.min(axis=1, keepdims=True) - 100.0).astype(np.float32)


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_training_docs: int = 20_000, min_script_share: float = 0.001,
) -> Model:
    """Count the n-grams of at most about ``max_training_docs`` texts whose language is known."""
    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # by row, not by text: copies of one text may be a third of all rows
    sample = known.where(F.rand(11) < max_training_docs / max(1, known.count()))
    rows = (
        map_batches(sample, _count_features, "lang string, script string, bucket int, n long")
        .groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    langs = sorted(set(rows["lang"].to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    counts, scripts = np.zeros((BUCKETS, len(langs))), {}
    for lang, script, bucket, n in zip(*(rows[c].to_pylist() for c in ("lang", "script", "bucket", "n"))):
        if script is None:
            counts[bucket, place[lang]] = n
        else:
            scripts.setdefault(script, np.zeros(len(langs)))[place[lang]] = n
    words = sum(scripts.values()) if scripts else np.zeros(len(langs))
    allowed = {s: n >= min_script_share * words for s, n in scripts.items()}
    return Model(langs, counts, {s: a for s, a in allowed.items() if a.any()})


def one_language(sums: np.ndarray, penalty: float) -> int:
    """The language of the whole text, if no other path can be better; else -1.

    ``sums`` holds running score sums per language. A path that comes back to the language pays the
    penalty for each foreign span at least, and gains the span's score difference at most. A path of
    foreign spans only pays one penalty less: its first and last span must not gain more than one together.
    """
    best = int(sums[-1].argmax())
    lead = sums - sums[:, best : best + 1]
    gain = lead - np.minimum(np.minimum.accumulate(lead, axis=0), 0.0)
    ends = lead[:-1].max(initial=0.0) + (lead[-1] - lead[:-1]).max(initial=0.0)
    return best if max(gain.max(), ends) <= penalty else -1


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each row of ``scores``; the texts are rows ``starts[i]`` up to ``ends[i]``, stepped side by side."""
    order = np.argsort(starts - ends, kind="stable")
    starts, lengths = starts[order], (ends - starts)[order]
    back = np.full(scores.shape, -1, np.int16)
    path = np.zeros(len(scores), np.int16)
    level = scores[starts].astype(np.float64)
    last = np.zeros((len(starts), scores.shape[1]))
    active = len(starts)
    for t in range(1, int(lengths[0]) + 1):
        still = int(np.searchsorted(-lengths, -t, side="left"))  # texts longer than t
        last[still:active] = level[still:active]
        active = still
        if not active:
            break
        level = level[:active]
        from_best = level.argmax(axis=1)
        change = level[np.arange(active), from_best] - penalty
        rows = starts[:active] + t
        moved = change[:, None] > level
        back[rows] = np.where(moved, from_best[:, None], -1)
        level = np.where(moved, change[:, None], level) + scores[rows]
    state = last.argmax(axis=1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        rows = starts[:n] + t
        path[rows] = state[:n]
        came = back[rows, state[:n]]
        state[:n] = np.where(came >= 0, came, state[:n])
    return path


def viterbi_one(scores: np.ndarray, penalty: float) -> np.ndarray:
    """As ``viterbi`` for one long text, where stepping alone is faster in plain Python."""
    rows = scores.tolist()
    level, back = rows[0], []
    for row in rows[1:]:
        best = max(level)
        change = best - penalty
        if min(level) < change:
            top = level.index(best)
            back.append((top, [x < change for x in level]))
            level = [(change if x < change else x) + s for x, s in zip(level, row)]
        else:
            back.append(None)
            level = [x + s for x, s in zip(level, row)]
    state = level.index(max(level))
    path = np.empty(len(rows), np.int16)
    for t in range(len(rows) - 1, 0, -1):
        path[t] = state
        step = back[t - 1]
        if step is not None and step[1][state]:
            state = step[0]
    path[0] = state
    return path


class Labeller:
    """Labels the words of texts; keeps the scores of words seen before."""

    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.places: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        if len(self.places) > CACHE:
            self.places, self.table = {}, self.table[:0]
        if new := list(set(words).difference(self.places)):
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new))))
            self.table = np.concatenate([self.table, self.model.score(new)])
        return self.table[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of every word of every text."""
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        scores = self.word_scores([w for t in texts for w in t])
        out: list[np.ndarray] = []
        mixed = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            one = one_language(np.cumsum(scores[a:b], axis=0, dtype=np.float64), self.penalty) if b > a else 0
            out.append(np.full(b - a, max(one, 0), np.int16))
            if one < 0:
                mixed.append(i)
        for i in mixed:
            if ends[i] - starts[i] > LONG_TEXT:
                out[i] = viterbi_one(scores[starts[i] : ends[i]], self.penalty)
        if mixed := [i for i in mixed if ends[i] - starts[i] <= LONG_TEXT]:
            path = viterbi(scores, starts[mixed], ends[mixed], self.penalty)
            for i in mixed:
                out[i] = path[starts[i] : ends[i]]
        return out


def _groups(texts: list[str | None], found) -> Iterator[list[list[str]]]:
    group, size = [], 0
    for t in texts:
        group.append(found(t) if t else [])
        size += len(group[-1])
        if size >= WORDS_AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _spans(text: str, path: np.ndarray, langs: list[str]) -> list[dict]:
    places = [m.span() for m in WORD.finditer(text)]
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return [{"begin": places[a][0], "end": places[b - 1][1], "lang": langs[path[a]]} for a, b in zip(cuts, cuts[1:])]


def _predictor(shared, penalty: float, with_spans: bool):
    kept: dict[str, Labeller] = {}

    def predict(texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
        worker = kept.setdefault("one", Labeller(shared.value, penalty))
        langs = worker.model.langs
        preds, shares, spans = [], [], []
        for group in _groups(texts, WORD.findall):
            for words, path in zip(group, worker.label(group) if langs else [None] * len(group)):
                if not words or path is None:
                    preds.append("und"), shares.append(0.0), spans.append([])
                    continue
                weight = np.bincount(path, weights=np.fromiter(map(len, words), np.int64, len(words)), minlength=len(langs))
                top = int(weight.argmax())
                preds.append(langs[top]), shares.append(float(weight[top] / weight.sum()))
                spans.append(_spans(texts[len(preds) - 1], path, langs) if with_spans else [])
        return preds, shares, spans

    return predict


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch_penalty: float = 12.0, with_spans: bool = True,
) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (share of letters in that language) and, if asked for, ``spans`` by code points."""
    predict = _predictor(docs.sparkSession.sparkContext.broadcast(model), switch_penalty, with_spans)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        preds, shares, spans = predict(batch.column("text").to_pylist())
        yield {"id": batch.column("id"), "lang_pred": preds, "score": shares, "spans": spans}

    schema = "id long, lang_pred string, score double" + (", spans array<struct<begin:int,end:int,lang:string>>" if with_spans else "")
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, schema)


def with_language(docs: DataFrame, model: Model, text_col: str = "text", switch_penalty: float = 12.0) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, beside ``lang_pred`` and ``score``; each text crosses to its task once."""
    predict = _predictor(docs.sparkSession.sparkContext.broadcast(model), switch_penalty, False)

    def found(texts: pa.Array) -> dict:
        preds, shares, _ = predict(texts.to_pylist())
        return {"lang_pred": preds, "score": shares}

    return beside_rows(docs, [text_col], found, "lang_pred string, score double")

"""Quality rules with certified thresholds.

Each document gets scores of a few rules (share of symbols, capitals, marks,
repeated lines and words, word length). Labelled documents are divided by a
hash into a design part and a holdout. The design part proposes one cutoff per
stratum and rule that gains something, and an order of steps: all stricter
cutoffs of these rules and then they themselves, those that reject fewer good
documents first. The holdout tests the steps in this order until one fails
(fixed-sequence testing): a step holds if the exact (Clopper-Pearson) upper
bound of the share of good documents that it or any step before rejects is at
most ``max_false_rejection``. As the order is fixed before the holdout is read, each
stratum is tested at ``delta`` over the number of strata with proposals, whatever the number of
rules and cutoffs, and all bounds hold together with probability ``1 - delta``.
The population of a bound are the good documents of its stratum that pass the base
rules, one trial for each labelled id, however often its row occurs.

Defined results: a null or empty text has no words and fails the base rules;
a null stratum is a stratum of its own, named ``NULL_STRATUM`` (a name that begins with that character gets another one in
front); a null id is never labelled; repeated
ids keep their rows, and the first of them by stratum and scores is their trial; several labels of one id count as good only if all are
good; null labels count as absent; a stratum with too few labels rejects
nothing. Columns other than the named ones are not read, so clashing names do
not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.llm.batches import beside_rows, map_batches
from millrace.session import cut_lineage

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"!?=@_~^"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long"
COUNT_NAMES = [x.split()[0] for x in COUNTS.split(", ")]
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
CUTOFFS = 32
NULL_STRATUM = "\0"
CUTOFF = pa.schema([("stratum", pa.string()), ("rule", pa.int64()), ("cutoff", pa.float64()), ("good_rejected", pa.int64()), ("good", pa.int64())])
PROPOSAL = pa.schema([("stratum", pa.string()), ("rule", pa.int64()), ("cutoffs", pa.list_(pa.float64())), ("lost", pa.list_(pa.int64()))])
STEPS = pa.schema([("stratum", pa.string()), ("steps", pa.list_(pa.struct([("rule", pa.int64()), ("cutoff", pa.float64())])))])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has more than once."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    equal = ranked[1:] == ranked[:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The columns of ``COUNTS`` for one text in UTF-8."""
    if not text:
        return (0,) * 8
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    less = lambda drop: len(text) - len(text.translate(None, drop))
    return (
        len(words), len(text) - less(CONTINUATION) - less(SPACES), less(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), less(CAPITALS), less(MARKS),
    )


def _counts(texts: pa.Array) -> dict:
    rows = [counts_of(t.as_py()) for t in texts.cast(pa.binary())]
    return dict(zip(COUNT_NAMES, zip(*rows))) if rows else {n: [] for n in COUNT_NAMES}


def _count_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    yield {"id": batch.column("id"), "stratum": batch.column("stratum"), **_counts(batch.column("text"))}


def stratum_key(stratum_col: str | None) -> Column:
    if stratum_col is None:
        return F.lit("all")
    name = F.col(f"`{stratum_col}`").cast("string")
    return F.when(name.isNull(), NULL_STRATUM).when(name.startswith(NULL_STRATUM), F.concat(F.lit(NULL_STRATUM), name)).otherwise(name)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """``id``, ``stratum`` and the counts of each text; rows stay as they are, in one pass without a shuffle."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), stratum_key(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    return map_batches(picked, _count_batch, f"id long, stratum string, {COUNTS}")


def scores() -> Column:
    """One score per rule, in the order of ``RULES``; more is worse."""
    return F.array(*[F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) for a, b in RULES.values()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rejection_bound_holds(k: int, n: int, rate: float, delta: float) -> bool:
    """Whether the exact upper bound of a binomial rate, at confidence ``1 - delta``, is at most ``rate``.

    It is exactly when ``k`` or fewer of ``n`` have probability ``delta`` at most under ``rate``.
    """
    if n == 0 or k > rate * n:
        return False
    step = math.log(rate) - math.log1p(-rate)
    at = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    total, most = 0.0, at
    for j in range(k, -1, -1):
        total += math.exp(at - most)
        if j and at - most < -40:
            break
        if j:
            at += math.log(j) - math.log(n - j + 1) - step
    return most + math.log(total) <= math.log(delta)


def _propose(rate: float, false_cost: float):
    """Of one stratum and rule: the cutoff that gains most on the design part, after all stricter ones, and the good documents each rejects."""

    def propose(key: tuple, group: pa.Table) -> pa.Table:
        stratum, rule = (k.as_py() for k in key)
        grid = group["grid"][0].as_py()
        cells = group.select(["good", "cell", "n"]).to_pandas()

        def at_or_above(part) -> np.ndarray:
            per_cell = np.bincount(part["cell"], weights=part["n"], minlength=len(grid) + 1)
            return per_cell[::-1].cumsum()[::-1][1:]

        lost = at_or_above(cells[cells["good"]])
        gain = at_or_above(cells[~cells["good"]]) - false_cost * lost
        gain[lost > rate * cells["n"][cells["good"]].sum()] = 0.0
        best = max(range(len(grid)), key=lambda j: (gain[j], j))
        if gain[best] <= 0:
            return PROPOSAL.empty_table()
        return pa.table({"stratum": [stratum], "rule": [rule], "cutoffs": [grid[best:][::-1]], "lost": [lost[best:][::-1].astype(np.int64).tolist()]}, schema=PROPOSAL)

    return propose


def _order(false_cost: float):
    """Of one stratum: the steps of the proposed rules; a rule that gains nothing beyond the others goes."""

    def order(key: tuple, group: pa.Table) -> pa.Table:
        proposals = {p["rule"]: p for p in group["proposals"][0].as_py()}
        rows = [(set(r["reached"]), r["n"] if not r["good"] else -false_cost * r["n"]) for r in group.select(["reached", "good", "n"]).to_pylist()]
        rank: dict[int, int] = {}
        while left := [r for r in proposals if r not in rank]:
            gains = {r: sum(n for reached, n in rows if r in reached and reached.isdisjoint(rank)) for r in left}
            best = max(left, key=lambda r: (gains[r], -r))
            if gains[best] <= 0:
                break
            rank[best] = len(rank)
        steps = sorted((lost, rank[r], -cutoff, r) for r in rank for cutoff, lost in zip(proposals[r]["cutoffs"], proposals[r]["lost"]))
        return pa.table({"stratum": [key[0].as_py()], "steps": [[{"rule": r, "cutoff": -c} for _, _, c, r in steps]]}, schema=STEPS)

    return order


def _certify(rate: float, delta: float):
    """Of one stratum: the loosest cutoff per rule up to the first step whose rejections, with those before it, are not certified."""

    def certify(key: tuple, group: pa.Table) -> pa.Table:
        steps = group["steps"][0].as_py()
        per_step = np.bincount(group["first"].to_numpy(), weights=group["n"].to_numpy(), minlength=len(steps) + 1).astype(np.int64)
        total, rejected = int(per_step.sum()), per_step[1:].cumsum()
        used = {}
        for step, k in zip(steps, rejected.tolist()):
            if not rejection_bound_holds(k, total, rate, delta):
                break
            used[step["rule"]] = (step["cutoff"], k)
        return pa.table({
            "stratum": [key[0].as_py()] * len(used), "rule": list(used), "cutoff": [c for c, _ in used.values()],
            "good_rejected": [k for _, k in used.values()], "good": [total] * len(used),
        }, schema=CUTOFF)

    return certify


def certified_cutoffs(
    counts: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality",
    max_false_rejection: float = 0.02, delta: float = 0.05, false_cost: float = 10.0,
) -> DataFrame:
    """``stratum, rule, cutoff, good_rejected, good``: at most one cutoff per stratum and rule.

    ``good_rejected`` of the ``good`` documents in the holdout are rejected by the rule's last step or one before it.
    """
    good = (
        labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(label_id).cast("long").alias("id")).agg((F.min(F.col(label_col)) > 0).alias("good"))
    )
    trials = (
        counts.where(~base_failed()).select("id", "stratum", scores().alias("scores")).join(good, "id")
        .groupBy("id").agg(F.min(F.struct("stratum", "scores")).alias("first"), F.min("good").alias("good"))
    )
    rows = cut_lineage(
        trials.select("first.stratum", "good", (F.crc32(F.col("id").cast("string").cast("binary")) % 4 > 0).alias("holdout"), "first.scores")
    )
    design = rows.where(~F.col("holdout"))
    long = design.select("stratum", "good", F.posexplode("scores").alias("rule_no", "score"))
    quantiles = F.array(*[F.lit(i / CUTOFFS) for i in range(CUTOFFS + 1)])
    grids = (
        long.where(~F.col("good")).groupBy("stratum", "rule_no")
        .agg(F.array_sort(F.array_distinct(F.percentile_approx("score", quantiles, 10000))).alias("grid"))
    )
    cells = (
        long.join(cut_lineage(grids), ["stratum", "rule_no"])
        .groupBy("stratum", "rule_no", "grid", "good", F.size(F.filter("grid", lambda g: g <= F.col("score"))).alias("cell"))
        .agg(F.count("*").alias("n"))
    )
    proposed = cells.groupBy("stratum", "rule_no").applyInArrow(_propose(max_false_rejection, false_cost), from_arrow_schema(PROPOSAL))
    proposals = cut_lineage(proposed.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("rule", "cutoffs", "lost"))).alias("proposals")))
    score = lambda rule: F.get(F.col("scores"), rule.cast("int"))
    reached = F.transform(F.filter("proposals", lambda p: score(p["rule"]) >= F.element_at(p["cutoffs"], -1)), lambda p: p["rule"])
    together = design.join(proposals, "stratum").groupBy("stratum", "proposals", "good", reached.alias("reached")).agg(F.count("*").alias("n"))
    steps = cut_lineage(together.groupBy("stratum").applyInArrow(_order(false_cost), from_arrow_schema(STEPS)))
    first = F.array_position(F.transform("steps", lambda s: score(s["rule"]) >= s["cutoff"]), True)
    hits = rows.where(F.col("holdout") & F.col("good")).join(steps, "stratum").groupBy("stratum", "steps", first.alias("first")).agg(F.count("*").alias("n"))
    picked = hits.groupBy("stratum").applyInArrow(_certify(max_false_rejection, delta / max(1, steps.count())), from_arrow_schema(CUTOFF))
    names = F.array(*[F.lit(r) for r in RULES])
    return picked.select("stratum", F.get(names, F.col("rule").cast("int")).alias("rule"), "cutoff", "good_rejected", "good")


def judge(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed``, ``rejected_by`` (rules whose cutoff is reached) and ``kept``."""
    per_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    names = F.array(*[F.lit(r) for r in RULES])
    reached = F.filter(
        F.zip_with(names, scores(), lambda r, s: F.when(s >= F.try_element_at(F.col("cutoffs"), r), r)), lambda r: r.isNotNull()
    )
    return (
        counts.join(per_stratum, "stratum", "left")
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.coalesce(reached, F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("cutoffs")
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", **limits: float
) -> DataFrame:
    """Counts, base verdict and certified verdict of each document: the texts are read once, the counts written once."""
    counts = cut_lineage(text_counts(docs, id_col, text_col, stratum_col))
    return judge(counts, cut_lineage(certified_cutoffs(counts, labels, **limits)))


def keep_passing(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", **limits: float
) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    Texts are counted twice, for the cutoffs and for the verdicts, so no second copy of them is written; verdicts follow from counts and
    stratum, and no row is joined by its id.
    """
    cutoffs = cut_lineage(certified_cutoffs(cut_lineage(text_counts(docs, id_col, text_col, stratum_col)), labels, **limits))
    stratum = stratum_key(f"row`.`{stratum_col}" if stratum_col else None).alias("stratum")
    return judge(beside_rows(docs, [text_col], _counts, COUNTS).select("row", stratum, *COUNT_NAMES), cutoffs).where("kept").select("row.*")

"""Personal data: patterns against plain regular expressions, message passing against enumeration, rewritten mentions in unseen texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from odd_rows import make_docs

from millrace.llm import personal_data as pd_
from millrace.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def plain_base(text):
    out = []
    if not re.search("[0-9@]", text):
        return out  # the address pattern is quadratic on long words
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PATTERNS).index(kind), f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def test_base_spans_as_plain_expressions():
    rng = random.Random(5)
    for alphabet in ("ab12.@@-+ ()9", "0123456789 -", "+123456789() .-", "12.345 25.", "é1٣@.a中 "):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert [(a, list(PATTERNS).index(k), f"{k}:{a}:{b}", k) for a, b, k in pd_.base_spans(text)] == plain_base(text)


def test_long_texts_take_linear_time():
    for part in ("x", "1", "1.", "a@", "@a.", "+1", "1 ", "+1 (", "a@b.c ", "4111 1111 1111 1111 "):
        pd_.find_in([part * (200_000 // len(part))], pd_.Model())


def exact(graph, weights, pairs):
    """Node probabilities by enumeration of all labellings."""
    n = len(graph.known)
    out = np.zeros((n, 5))
    unary = np.zeros((n, 5))
    np.add.at(unary, graph.owner, weights[graph.feature])
    for labels in itertools.product(range(5), repeat=n):
        if any(k >= 0 and k != x for k, x in zip(graph.known, labels)):
            continue
        score = sum(unary[i, x] for i, x in enumerate(labels) if graph.known[i] < 0)
        score += sum(pairs[t, labels[a], labels[b]] for a, b, t in zip(graph.a, graph.b, graph.sort))
        for i, x in enumerate(labels):
            out[i, x] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_without_loops_and_near_with_them():
    rng = np.random.default_rng(2)
    text = "card 4111 1111 1111 1111 and far away " + "word " * 30 + "4111.1111.1111.1111 or " + "word " * 30 + "123/4567"
    field = pd_.Field(text, pd_.base_spans(text))
    assert [k for k in field.known] == [3, -1, -1] and (0, 1, 1) in field.edges
    weights, pairs = rng.normal(size=(pd_.FEATURES, 5)), rng.normal(size=(3, 5, 5))
    graph = pd_.Graph([field])
    assert np.allclose(pd_.spread(graph, weights, pairs)[0], exact(graph, weights, pairs), atol=1e-5)
    text = "4111.1111.1111.1111 or 4111/1111/1111/1111 and 1.4111 1111 1111 1111 and 4111.1111.1111.1111"
    graph = pd_.Graph([pd_.Field(text, pd_.base_spans(text))])
    assert len(graph.a) >= len(graph.known)  # a loop
    assert np.abs(pd_.spread(graph, 0.5 * weights, 0.3 * pairs)[0] - exact(graph, 0.5 * weights, 0.3 * pairs)).max() < 0.1


def test_fields_side_by_side_do_not_touch():
    texts = ["4111 1111 1111 1111 x 4111.1111.1111.1111", "4111.1111.1111.1111", "no digits"]
    model = pd_.Model()
    together = pd_.find_in(texts, model)
    assert together == [pd_.find_in([t], model)[0] for t in texts]
    assert [s["base"] for s in together[0]] == [True, False] and together[1] == [] and together[2] == []


def test_mentions_of_unseen_texts(spark):
    """Learnt on half of the documents: rewritten mentions of the other half are found, made-up numbers are not."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pd_.train(docs.where("doc_id % 2 = 0"))
    caught = missed = wrong = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        text, truth = pd_.training_text(r.text or "")
        found = {(s["start"], s["end"], s["kind"]) for s in pd_.find_in([text], model)[0] if not s["base"]}
        hits = sum(any(a < y and x < b and k == kind for x, y, kind in found) for a, b, k in truth)
        caught, missed = caught + hits, missed + len(truth) - hits
        wrong += sum(not any(a < y and x < b and k == kind for a, b, k in truth) for x, y, kind in found)
    print(caught, missed, wrong)
    assert caught + missed > 100 and caught >= 0.75 * (caught + missed) and wrong <= 0.05 * (caught + missed)


def test_rows_of_the_query(spark, odd, tmp_path):
    number = "4111 1111 1111 1111"
    rows = odd + [(50, f"{number} é {number.replace(' ', '.')} {'word ' * 100} 4111/1111/1111/1111"), (51, "a.b@c.d 1.2.3.4 +1 (017) 555-7713"), (51, "1" * 5000)]
    make_docs(spark, rows, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_personal_data"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        base = plain_base(text or "")
        row = next(r for r in got if r.doc_id == doc_id and r.base_sha256 == hashlib.sha256(",".join(b[2] for b in base).encode()).hexdigest())
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(b[3] == k for b in base) for k in PATTERNS]
        assert {b[2] for b in base} <= set(row.spans.split(",") if row.spans else [])
    first = pd_.find_personal(make_docs(spark, rows[-3:-2]), pd_.Model()).first()
    assert [(s.kind, s.start, s.end, s.base) for s in first.spans] == [("card", 0, 19, True), ("card", 22, 41, False), ("card", 543, 562, False)]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "only words here")]])
def test_nothing_to_learn_from(spark, rows):
    docs = make_docs(spark, rows)
    assert [r.spans for r in pd_.find_personal(docs, pd_.train(docs)).collect()] == [[] for _ in rows]

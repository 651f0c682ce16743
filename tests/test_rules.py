"""Rules written again in plain Python, and random rows against the Spark result."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as fx
from millrace.functions.json_leaves import checked, leaves
from millrace.functions.jsons import beautified_json, canonical_json, canonical_or_raw, json_depth, pretty_json
from millrace.operators import config, keyed, objects, ranking, status

LETTERS = "ab#= \n"


def words(rng, n=12, letters=LETTERS):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(n)))


def column(spark, values, expression):
    """One text column in, the expression's values out, in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens_between_delimiters(spark):
    rng = random.Random(1)
    texts = [words(rng, 20) for _ in range(300)] + ["a #x# b #y# c #"]

    def rule(text):
        marks = [i for i, c in enumerate(text) if c == "#"]
        return [text[a + 1:b] for a, b in zip(marks[::2], marks[1::2])]

    assert column(spark, texts, fx.extract_tokens) == [rule(t) for t in texts]
    dollars = [t.replace("#", "$") for t in texts]
    assert column(spark, dollars, lambda c: fx.extract_tokens(c, "$")) == [rule(t) for t in texts]


def test_render_stops_when_no_mark_is_left(spark):
    rng = random.Random(2)
    pairs = [("#a#", "#b#"), ("#b#", "b"), ("b", "!"), ("a#", "x#")]
    texts = [words(rng, 25) for _ in range(300)] + ["#a# b", "#b# b", "b\n#a#b"]

    def rule(text):
        out = []
        for line in text.splitlines(keepends=True):
            for k, v in pairs:
                if "#" in line:
                    line = line.replace(k, v)
            out.append(line)
        return "".join(out)

    variables = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs])
    assert column(spark, texts, lambda c: fx.render_text(c, variables)) == [rule(t) for t in texts]


def test_sample_render(spark):
    """The two variables of the shipped sample, and a value that is not set."""
    variables = F.array(
        F.struct(F.lit("#yo#").alias("k"), F.lit("Goofy").alias("v")),
        F.struct(F.lit("#bro#").alias("k"), F.lit(None).cast("string").alias("v")),
    )
    assert column(spark, ["hi #yo#, #bro#\n"], lambda c: fx.render_text(c, variables)) == ["hi Goofy, None\n"]


def test_property_render(spark):
    rng = random.Random(3)
    lookup = {"a": "1", "ab": "22", "b": ""}
    texts = [words(rng, 15, 'ab#"') for _ in range(300)]

    def rule(text):
        if "#" not in text:
            return text.replace('"', "")
        marks = [i for i, c in enumerate(text) if c == "#"]
        new = text
        for a, b in zip(marks[::2], marks[1::2]):
            token = text[a + 1:b]
            if token not in lookup:
                return None
            new = new.replace(token, lookup[token])
        return new.replace("#", "").replace('"', "")

    known = F.create_map(*[F.lit(x) for pair in lookup.items() for x in pair])
    assert column(spark, texts, lambda c: fx.render_property(c, known)) == [rule(t) for t in texts]
    with pytest.raises(Exception, match="unknown token: zz"):
        column(spark, ["#zz#"], lambda c: fx.render_property(c, known, strict=True))


def test_property_template_as_a_file(spark):
    known = F.create_map(F.lit("a"), F.lit("1"))
    texts = ['# top\n\nk = "#a#"\nplain="a"\n', "k=#b#\nx=1\n"]
    got = column(spark, texts, lambda c: fx.render_property_text(c, known))
    assert got == ["\n\n#  top\nk=1\nplain=a\n", None]


@pytest.mark.parametrize("sub", ["a", "aa", "ab", "aba"])
def test_replace_last(spark, sub):
    rng = random.Random(4)
    texts = [words(rng, 10, "ab") for _ in range(200)] + ["", "aaa", "ababa"]

    def rule(text):
        at = text.rfind(sub)
        return text if at < 0 else text[:at] + "-" + text[at + len(sub):]

    assert column(spark, texts, lambda c: fx.replace_last(c, sub, "-")) == [rule(t) for t in texts]
    assert column(spark, ["x"], lambda c: fx.replace_last(c, "", "-")) == ["x"]


def test_line_edits_keep_line_ends(spark):
    rng = random.Random(5)
    texts = [words(rng, 25) for _ in range(200)] + ["", "a\nb", "b\na\n", "\n\n"]

    def without(text):
        return "".join(line for line in text.splitlines(keepends=True) if "a" not in line)

    def prepended(text):
        return text if any("a" in line for line in text.splitlines()) else "a\n" + text

    assert column(spark, texts, lambda c: fx.without_lines_with(c, "a")) == [without(t) for t in texts]
    assert column(spark, texts, lambda c: fx.with_first_line(c, "a")) == [prepended(t) for t in texts]
    assert column(spark, texts, lambda c: fx.has_line_with(c, "a")) == ["a" in t for t in texts]


def test_env_value_is_cut_at_the_second_sign(spark):
    def lookup(text, name, rest=False):
        return column(spark, [text], lambda c: fx.env_value(F.split(c, "\n"), name, rest))[0]

    text = "A\nB=1=2=3\nB=4\nC="
    assert lookup(text, "B") == "1"
    assert lookup(text, "B", rest=True) == "1=2=3"
    assert lookup(text, "C") == ""
    assert lookup(text, "A") is None


def test_property_lines(spark):
    lines = [
        "k=v", " k = v w", "# note", "!x", "a=b=c", "k:v", "key value", "bare", "a=x\ry", r"k\:x\ y=1", r"a=A\t\\b", r"e=😀!", "k \t= v ", "=v", "a=", "q r=1",
    ]
    got = column(spark, lines, fx.parse_property)
    assert [tuple(r) for r in got] == [
        ("k", "v", False), ("k", "v w", False), (None, "note", True), (None, "x", True), ("a", "b=c", False), ("k", "v", False), ("key", "value", False),
        ("bare", "", False), ("a", "x\ry", False), ("k:x y", "1", False), ("a", "A\t\\b", False), ("e", "😀!", False), ("k", "v ", False), ("", "v", False), ("a", "", False),
        ("q r", "1", False),
    ]


def properties_by_hand(text):
    """Entries of a properties text, a character at a time."""
    import re

    out, pending = [], None
    for line in re.split(r"\r\n|\n|\r", text):
        if pending is not None:
            line = pending + line.lstrip(" \t\f")
            pending = None
        elif not line.strip():
            continue
        elif line.lstrip(" \t\f")[:1] in ("#", "!"):
            out.append((None, line.lstrip(" \t\f")[1:].strip(), True))
            continue
        if (len(line) - len(line.rstrip("\\"))) % 2:
            pending = line[:-1]
            continue
        out.append(line)
    if pending is not None:
        out.append(pending + "\\")
    parsed = []
    for line in out:
        if isinstance(line, tuple):
            parsed.append(line)
            continue
        if not line.strip():
            continue
        if line.lstrip(" \t\f")[0] in "#!":  # joined lines are judged as one
            parsed.append((None, line.lstrip(" \t\f")[1:].strip(), True))
            continue
        line, key, at = line.lstrip(" \t\f"), "", 0
        while at < len(line) and line[at] not in "=: \t\f":
            step = 2 if line[at] == "\\" else 1
            key, at = key + line[at : at + step], at + step
        rest = line[at:].lstrip(" \t\f")
        if rest[:1] in ("=", ":") :
            rest = rest[1:].lstrip(" \t\f")
        plain = lambda t: re.sub(r"\\(.)", r"\1", t)
        parsed.append((plain(key), plain(rest), False))
    return parsed


def test_property_texts(spark):
    rng = random.Random(12)
    parts = ["a", "b c", "=", ":", " ", "\n", "\r\n", "\n\n", "\t", "\\\n", "\\\\", "\\=", "\\:", "#", "\n#x", "\n ! y", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) + "z" for _ in range(500)] + ["a=1\r\n\r\nb=2\n\t\n  ", "# c\\\nk=1"]
    got = column(spark, texts, lambda c: F.transform(fx.property_lines(c), fx.parse_property))
    for text, entries in zip(texts, got):
        mine = [(r.key, r.value.rstrip() if r.is_comment else r.value, r.is_comment) for r in entries]
        assert mine == [(k, v.rstrip() if c else v, c) for k, v, c in properties_by_hand(text)], text
    assert column(spark, ["a=1\r\n\r\nb=2\n\t\n  "], lambda c: fx.append_property_text(F.lit(""), c)) == ["a=1\nb=2\n"]


def test_action_lines(spark):
    lines = [
        "a: 1", "plain", "b:", "c:d", "  e :  f g ", "", "# x: y", "s: 'true'", 's: "a\\tb"', "a: b: c", "x: y # note", "x: y#z", "n: null", "t: ~", "q: 'it''s' # n",
        "{a: 1, b: 2}", "{a: 'x, y', b: }", "'k k': v", "- a: b", "u: http://h:80/p", "a: #c",
    ]
    got = column(spark, lines, fx.action_entries)
    assert [[tuple(e) for e in r] for r in got] == [
        [("a", "1")], [], [("b", None)], [], [("e", "f g")], [], [], [("s", "true")], [("s", "a\tb")], [], [("x", "y")], [("x", "y#z")], [("n", None)], [("t", None)], [("q", "it's")],
        [("a", "1"), ("b", "2")], [("a", "x, y"), ("b", None)], [("k k", "v")], [], [("u", "http://h:80/p")], [("a", None)],
    ]


def test_json_columns(spark):
    docs = ['{"b": 1, "a": {"é": [1, {"x": "}{"}]}}', "[]", '"s"', "not json", '{"a": "\\"["}', "3"]
    canonical = column(spark, docs, canonical_json)
    for text, got in zip(docs, canonical):
        if text == "not json":
            assert got is None
        else:
            assert json.loads(got) == json.loads(text)
    assert column(spark, docs, canonical_or_raw)[3] == "not json"
    odd = ['{"a":1} x', '{"a":1,"a":2}', "9" * 45, "[" * 50_000 + "]" * 50_000, "[" * 900 + "]" * 900, '"' + "x" * 2_000_000 + '"', '{"b":[1.5,-0],"a":null}', ""]
    assert column(spark, odd, canonical_json) == [None, '{"a":2}', "9" * 45, None, odd[4], odd[5], '{"a":null,"b":[1.5,0]}', None]
    assert column(spark, odd, pretty_json)[3] == odd[3]
    pretty = column(spark, docs, pretty_json)
    assert pretty[0] == json.dumps(json.loads(docs[0]), indent=4, sort_keys=True)
    assert pretty[3] == "not json"
    assert column(spark, docs, beautified_json)[0] == json.dumps(json.loads(docs[0]), indent=4, ensure_ascii=False)
    assert column(spark, docs, json_depth) == [4, 1, 0, 0, 1, 0]
    assert column(spark, ['{"k": "' + "x" * 100_000 + '{"}'], json_depth) == [1]


def random_json(rng, depth=4):
    kind = rng.randrange(8 if depth else 5)
    if kind == 0:
        return rng.randrange(100)
    if kind == 1:
        return rng.choice(["", "a", 'q"{', "x.y"])
    if kind == 2:
        return rng.random() < 0.5
    if kind == 3:
        return None
    if kind <= 5:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(3))] if depth else 0
    return {rng.choice("abcd"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}


def leaves_of(value, path=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            k = '"' + k.replace("\\", "\\\\").replace('"', '\\"') + '"' if k == "" or set(k) & set('."[') else k
            yield from leaves_of(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves_of(v, f"{path}[{i}]")
    else:
        kinds = {dict: "tree", list: "list", bool: "bool", str: "string", int: "number", type(None): "null"}
        kind = "number" if isinstance(value, Written) else kinds[type(value)]
        yield path, kind, value if isinstance(value, str) else getattr(value, "text", None) or json.dumps(value)


def test_config_flatten(spark):
    rng = random.Random(6)
    docs = [random_json(rng) for _ in range(150)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, body string")
    got = sorted(tuple(r) for r in config.config_flatten(rows, "body").collect())
    assert got == sorted((i, *leaf) for i, d in enumerate(docs) for leaf in leaves_of(d))


def test_walk_agrees_with_a_parser():
    rng = random.Random(11)
    for _ in range(3000):
        text = json.dumps(random_json(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        for _ in range(rng.randrange(3)):  # some broken ones
            k = rng.randrange(len(text) + 1)
            text = text[:k] + rng.choice(['"', ",", "]", "}", "1", " ", "\\", ":", "\n", "e", "-", "0"]) + text[k + rng.randrange(2) :]
        try:
            want = sorted(leaves_of(json.loads(text, parse_float=lambda t: (_ for _ in ()).throw(OverflowError), parse_int=lambda t: Written(t))))
        except OverflowError:
            continue
        except ValueError:
            want = []
            assert checked(text) is None, text
        assert sorted(leaves(text)) == want, text


class Written(int):
    """A whole number that is shown as it was written."""

    def __new__(cls, text):
        self = int.__new__(cls, text)
        self.text = text
        return self


def test_flatten_takes_any_document(spark):
    deep = '{"a":' * 50_000 + "[7]" + "}" * 50_000
    docs = [
        (1, deep), (2, '"' + "x" * 5_000_000 + '"'), (3, '{"a":1,"b":{"c":1,"c":[2,3]},"a":{"z":9}}'), (4, "[" * 60), (5, "[1,]"), (6, None), (7, "1.50"), (8, '["\\ud800"]'),
        (9, "[" + ",".join(["[]"] * 200_000) + "]"), (10, ""), (11, '{"a" 1}'), (12, "NaN"),
    ]
    rows = spark.createDataFrame(docs, "path_ int, body string").selectExpr("path_ AS id", "body", "'kept' AS other")
    flat = config.config_flatten(rows, "body")
    assert flat.columns == ["id", "other", "path", "type", "value"]
    got = flat.where("id NOT IN (1, 2, 9)").select("id", "path", "type", "value").collect()
    assert sorted(tuple(r) for r in got) == [
        (3, "a.z", "number", "9"), (3, "b.c[0]", "number", "2"), (3, "b.c[1]", "number", "3"), (7, "", "number", "1.50"), (8, "[0]", "string", "\ufffd"),
    ]
    one = flat.where("id = 1").collect()
    assert len(one) == 1 and one[0].path == ".".join(["a"] * 50_000) + "[0]" and one[0].value == "7"
    assert flat.where("id = 2").select(F.length("value")).first()[0] == 5_000_000
    assert flat.where("id = 9 AND type = 'list'").select("path").distinct().count() == 200_000
    assert {r.id for r in config.malformed_documents(rows, "body").collect()} == {4, 5, 10, 11, 12}
    assert exchange_free(flat)


def exchange_free(df):
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_layers_merge_like_a_tree(spark):
    """Replay the writes in order on a nested dict and compare its leaves."""
    rng = random.Random(7)
    for trial in range(6):
        rows = []
        for layer in range(4):
            for seq in range(rng.randrange(1, 12)):
                path = ".".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))
                rows.append((layer, seq, path, rng.choice([None, str(rng.randrange(100))])))
        tree: dict = {}
        for _, _, path, value in sorted(rows, key=lambda r: r[:2]):
            if value is None:
                continue
            node, *rest = tree, *path.split(".")
            for name in rest[:-1]:
                if not isinstance(node.get(name), dict):
                    node[name] = {}
                node = node[name]
            node[rest[-1]] = value

        def flat(node, path=()):
            for k, v in node.items():
                if isinstance(v, dict):
                    yield from flat(v, (*path, k))
                else:
                    yield ".".join((*path, k)), v

        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "layer int, seq int, path string, value string")
        got = {r.path: r.value for r in config.layered_resolve(frame).collect()}
        assert got == dict(flat(tree)), trial


def test_layers_files_below_injection_below_arguments(spark):
    rows = [(0, 0, "a", "first"), (1, 0, "a", "last"), (1, 0, "b", "last"), (2, 0, "b", "injected"), (3, 0, "b", None)]
    frame = spark.createDataFrame(rows, "layer int, seq int, path string, value string")
    assert {r.path: r.value for r in config.layered_resolve(frame).collect()} == {"a": "last", "b": "injected"}


def test_appended_lists(spark):
    rows = [
        (0, 0, "x", ["1", "2"], "set"), (1, 0, "x", ["3"], "append"), (0, 0, "y", ["1"], "append"),
        (0, 0, "z", ["1"], "append"), (1, 0, "z", ["2"], "set"), (1, 1, "z", ["3"], "append"),
    ]
    frame = spark.createDataFrame(rows, "layer int, seq int, path string, values array<string>, op string")
    got = config.layered_lists(frame).orderBy("path", "layer", "seq", "pos").collect()
    assert [(r.path, r.value) for r in got] == [("x", "1"), ("x", "2"), ("x", "3"), ("y", "1"), ("z", "2"), ("z", "3")]


def test_substitutions(spark):
    tree = {
        "zone": "us", "index": "1", "name": "${zone}-${index}", "arn": "arn:${zone}:${name}/${name}",
        "gone": "${nowhere}", "after": "x${gone}", "maybe": "[${?nowhere}]", "loop": "${pool}", "pool": "${loop}",
        "self": "${self}", "hang": "${loop}!", "plain": "$ {x}", "null": None,
    }
    frame = spark.createDataFrame(list(tree.items()), "path string, value string")
    got = {r.path: (r.value, r.status) for r in config.substitution_resolve(frame).collect()}
    assert got == {
        "zone": ("us", "resolved"), "index": ("1", "resolved"), "name": ("us-1", "resolved"),
        "arn": ("arn:us:us-1/us-1", "resolved"), "gone": (None, "missing"), "after": (None, "missing"),
        "maybe": ("[]", "resolved"), "loop": (None, "cycle"), "pool": (None, "cycle"), "self": (None, "cycle"),
        "hang": (None, "cycle"), "plain": ("$ {x}", "resolved"), "null": (None, "resolved"),
    }


def test_variables(spark):
    frame = spark.createDataFrame([('{"z":1,"a":{"q":2}}',)], "body string")
    got = config.variables_from_config(frame, "body").orderBy("pos").collect()
    assert [(r.k, r.v) for r in got] == [("#z#", "1"), ("#a#", '{"q":2}')]
    plain = config.variables_from_config(frame, "body", template=False).orderBy("pos").collect()
    assert [r.k for r in plain] == ["z", "a"]
    packed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("a", "1"), ("b", "2"), ("a", "3"))])
    row = spark.range(1).select(
        config.variable_named(packed, "a").alias("hit"), config.variable_named(packed, "c").alias("miss")
    ).first()
    assert (row.hit.v, row.miss) == ("1", None)


def test_walk_prunes_whole_subtrees(spark):
    rng = random.Random(8)
    names = ["a", "b", ".git", "x.egg-info", "target"]
    paths = {
        "/".join([*(rng.choice(names) for _ in range(rng.randrange(4))), rng.choice(["f.py", "g.pyc", ".env"])])
        for _ in range(300)
    }

    def rule(path):
        *dirs, name = path.split("/")
        bad = any(d.endswith(".egg-info") or d[0] == "." or d == "target" for d in dirs)
        return not bad and not name.endswith(".pyc")

    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    walked = objects.filtered_walk(frame, ["target"], [".pyc"])
    assert {r.path for r in walked.collect()} == {p for p in paths if rule(p)}
    own = objects.filtered_walk(frame, dir_test=lambda d: d != "a", file_test=lambda f: f.startswith("f"))
    assert {r.path for r in own.collect()} == {
        p for p in paths if "a" not in p.split("/")[:-1] and p.split("/")[-1].startswith("f")
    }
    depths = [r.depth for r in walked.orderBy("depth").collect()]
    assert depths == sorted(depths)


def test_templates_below_an_ignored_directory_are_still_listed(spark):
    frame = spark.createDataFrame([("plan/a.tmpl",), ("plan/x/b.tmpl",), ("c.tmpl",), ("d.txt",)], "path string")
    listed = {r.path for r in objects.template_listing(frame).collect()}
    assert listed == {"plan/x/b.tmpl", "c.tmpl"}
    kept = objects.remove_non_templates(
        spark.createDataFrame([("plan/a.json",), ("x/b.json",), ("x/c.yaml",), ("x/d.tmpl",)], "path string")
    )
    assert {r.path for r in kept.collect()} == {"plan/a.json", "x/d.tmpl"}


def test_upsert_last_write_wins(spark):
    rng = random.Random(9)
    base = [(k, 0, 0, f"b{k}") for k in range(50)]
    updates = [(rng.randrange(80), rng.randrange(-2, 5), n, f"u{n}") for n in range(400)]
    want: dict = {}
    for row in sorted(base + updates, key=lambda r: (r[1], r[2])):
        want[row[0]] = row
    schema = "k int, write_ts int, seq int, v string"
    merged = keyed.upsert_by_key(
        spark.createDataFrame(base, schema), spark.createDataFrame(updates, schema), ["k"], ["write_ts", "seq"]
    )
    assert {r.k: tuple(r) for r in merged.collect()} == want


def test_batches_hold_the_size_asked_for_and_the_tail(spark):
    frame = spark.range(25).withColumn("w", F.lit("one"))
    sizes = keyed.assign_batches(frame, 10, "id", ["w"]).groupBy("batch_no").count().collect()
    assert sorted((r.batch_no, r["count"]) for r in sizes) == [(0, 10), (1, 10), (2, 5)]


@pytest.mark.parametrize("descending", [False, True])
def test_row_numbers_over_slices(spark, descending):
    rng = random.Random(10)
    rows = [(rng.choice([None, "x", "y"]), n) for n in rng.sample(range(-500, 500), 300)]
    frame = spark.createDataFrame(rows, "g string, n int")
    got = ranking.numbered(frame, ["g"], "n", "place", descending=descending).collect()
    for g in (None, "x", "y"):
        order = sorted((n for h, n in rows if h == g), reverse=descending)
        assert {r.n: r.place for r in got if r.g == g} == {n: i for i, n in enumerate(order, 1)}
    total = ranking.numbered(frame, [], "n", "place", start=0).collect()
    assert {r.n: r.place for r in total} == {n: i for i, n in enumerate(sorted(n for _, n in rows))}


def test_set_ready(spark):
    rng = random.Random(11)
    rows = [tuple(rng.choice([None, 1, 2, 20, 30]) for _ in range(4)) for _ in range(400)]

    def rule(replicas, current, updated, ready):
        actual = current if current is not None else updated
        if actual is None or replicas is None:
            return False
        if actual == replicas:
            return ready == actual
        return actual == 20

    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, replicas int, current int, updated int, ready int"
    )
    verdict = status.set_ready(F.col("replicas"), F.col("current"), F.col("updated"), F.col("ready"))
    got = [r.v for r in frame.select("i", verdict.alias("v")).orderBy("i").collect()]
    assert got == [rule(*r) for r in rows]


def wait_rule(start, ready_at, timeout, interval, timeout_first):
    elapsed = 0
    while True:
        if timeout_first and elapsed > timeout:
            return "TIMEOUT", elapsed
        if ready_at is not None and start + elapsed >= ready_at:
            return "READY", elapsed
        if not timeout_first and elapsed > timeout:
            return "TIMEOUT", elapsed
        elapsed += interval


@pytest.mark.parametrize("timeout_first", [False, True])
def test_waits_like_the_poll_loop(spark, timeout_first):
    rng = random.Random(12)
    cases = [(rng.randrange(50), rng.choice([None, rng.randrange(60), rng.randrange(390, 420)])) for _ in range(300)]
    cases += [(0, n) for n in (0, 5, 400, 401, 404, 405, 406)]
    rows = [(i, start, False) for i, (start, _) in enumerate(cases)]
    rows += [(i, start + after, True) for i, (start, after) in enumerate(cases) if after is not None]
    frame = spark.createDataFrame(rows, "resource int, at long, ready boolean")
    got = status.wait_until_ready(frame, unit=1, timeout_first=timeout_first).collect()
    for r in got:
        start, after = cases[r.resource]
        ready_at = None if after is None else start + after
        assert (r.verdict, r.waited) == wait_rule(start, ready_at, 400, 5, timeout_first), cases[r.resource]


def test_value_waits_like_the_poll_loop(spark):
    rng = random.Random(13)
    waits, actions = [], []
    for pod in range(60):
        start = rng.randrange(20)
        waits.append((pod, "job", "ok", start))
        actions += [
            (pod, rng.choice(["job", "other"]), rng.choice(["ok", "no"]), rng.randrange(100), n)
            for n in range(rng.randrange(12))
        ]

    def rule(pod, start):
        for poll in range(10):
            seen = [(at, seq, v) for p, name, v, at, seq in actions if p == pod and name == "job" and at <= start + 5 * poll]
            if seen and max(seen)[2] == "ok":
                return poll
        return None

    got = status.wait_for_value(
        spark.createDataFrame(actions, "pod int, name string, value string, at long, seq long"),
        spark.createDataFrame(waits, "pod int, name string, expected string, start long"),
        unit=1,
    ).collect()
    assert {r.pod: r.poll for r in got} == {pod: rule(pod, start) for pod, _, _, start in waits}
    assert all(r.matched == (r.poll is not None) for r in got)


def test_file_waits_sleep_before_the_first_look(spark):
    expected = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 10)], "path string, start long")
    arrivals = spark.createDataFrame([("a", 0), ("b", 250), ("c", 251), ("e", 3), ("e", 90)], "path string, at long")
    got = {r.path: (r.status, r.attempt) for r in status.wait_for_file(expected, arrivals, unit=1).collect()}
    assert got == {
        "a": ("FOUND", 1), "b": ("FOUND", 50), "c": ("TIMEOUT", None), "d": ("TIMEOUT", None), "e": ("FOUND", 1),
    }


def test_steps_time_out(spark):
    rows = [("x", 0, "RUNNING"), ("x", 1, "RUNNING"), ("y", 0, "RUNNING"), ("y", 1, "COMPLETED"),
            ("z", 0, "COMPLETED"), ("z", 0, "FAILED"), ("w", 0, "PENDING"), ("v", 5, "RUNNING"), ("v", 6, "COMPLETED")]
    history = spark.createDataFrame(rows, "job string, poll int, state string")
    got = {r.job: (r.poll, r.verdict) for r in status.await_steps(history, max_wait=2).collect()}
    assert got == {"x": (None, "TIMEOUT"), "y": (1, "COMPLETE"), "z": (0, "FAILED"), "w": (None, "PENDING"), "v": (None, "TIMEOUT")}
    late = status.step_rollup(history.drop("poll"), polls=50)
    assert {r.job: r.verdict for r in late.where("job <> 'v'").collect()} == {"x": "TIMEOUT", "y": "TIMEOUT", "z": "FAILED", "w": "TIMEOUT"}


def test_batches_are_ordered_as_text(spark):
    items = spark.createDataFrame(
        [("10", "a", 0), ("2", "b", 0), ("2", "c", 1), ("1", "d", 0)], "batch_key string, item string, pos int"
    )
    up = {r.item: (r.batch_no, r.step_no) for r in status.batch_order(items, "pos").collect()}
    down = {r.item: (r.batch_no, r.step_no) for r in status.batch_order(items, "pos", delete=True).collect()}
    assert up == {"d": (1, 1), "a": (2, 1), "b": (3, 1), "c": (3, 2)}
    assert down == {"c": (1, 1), "b": (1, 2), "a": (2, 1), "d": (3, 1)}


def test_status_apostrophes_survive(spark):
    docs = spark.createDataFrame(
        [(1, '{"items":[{"name":"it\'s"},{"name":"b"}]}'), (2, "{'items':[]}"), (3, '{"items":[]}')], "i int, body string"
    )
    got = status.status_items(docs, "body", "struct<name: string>").collect()
    assert [(r.i, r.ordinal, r.item.name) for r in got] == [(1, 0, "it's"), (1, 1, "b")]


def test_artifact_actions(spark):
    rows = [(f"{l}{r}", l, r) for l in (0, 1) for r in (0, 1)]
    wanted = spark.createDataFrame([(a,) for a, _, _ in rows], "artifact string")
    local = spark.createDataFrame([(a,) for a, l, _ in rows if l] + [("extra",)], "artifact string")
    remote = spark.createDataFrame([(a,) for a, _, r in rows if r], "artifact string")

    def actions(env, push=True):
        return {x.artifact: x.action for x in objects.reconcile_artifacts(wanted, local, remote, env, push).collect()}

    assert actions("aws") == {"00": "build+push", "01": "download", "10": "push", "11": "none"}
    assert actions("aws", push=False) == {"00": "build", "01": "download", "10": "none", "11": "none"}
    assert actions("local") == {"00": "build", "01": "build", "10": "none", "11": "none"}


def test_sync_prefix_is_a_directory(spark):
    schema = "key string, size long, mtime long"
    source = spark.createDataFrame([("a/x", 1, 5), ("a/y", 1, 5), ("a/z", 1, 5), ("ab/x", 1, 1)], schema)
    dest = spark.createDataFrame([("b/x", 1, 9), ("b/y", 2, 9), ("b/q", 1, 1)], schema)
    plan = {(r.src_key, r.dest_key, r.reason) for r in objects.sync_plan(source, dest, "a", "b").collect()}
    assert plan == {("a/y", "b/y", "size"), ("a/z", "b/z", "missing")}
    same = objects.sync_plan(source, dest, "a").select("dest_key").collect()
    assert {r.dest_key for r in same} == {"a/x", "a/y", "a/z"}
    many = objects.sync_many(
        source.withColumn("key", F.concat(F.lit("r/"), "key")), dest, "r", "n", ["a", "ab"]
    )
    assert {r.dest_key for r in many.collect()} == {"n/a/x", "n/a/y", "n/a/z", "n/ab/x"}


def test_sync_of_pairs_inside_each_other(spark):
    schema = "key string, size long, mtime long"
    source = spark.createDataFrame([("a/x", 1, 5), ("a/b/y", 1, 5), ("a/b/c/z", 1, 5), ("top", 1, 1)], schema)
    dest = spark.createDataFrame([("n/b/y", 1, 9), ("m/c/z", 2, 9)], schema)
    pairs = [("a", "n"), ("a/b/", "m"), ("a/b", "m"), ("a/b", None), ("q", "r")]
    frame = spark.createDataFrame(pairs, "src_prefix string, dest_prefix string")
    want = set()
    for src, to in {(s.rstrip("/"), t) for s, t in pairs}:
        want |= {(r.src_key, r.dest_key, r.reason) for r in objects.sync_plan(source, dest, src, to).collect()}
    got = objects.sync_pairs(source, dest, frame).collect()
    assert {(r.src_key, r.dest_key, r.reason) for r in got} == want
    deepest = {(r.src_key, r.dest_key) for r in objects.sync_pairs(source, dest, frame, longest=True).collect()}
    assert deepest == {("a/x", "n/x"), ("a/b/y", "m/y"), ("a/b/y", "a/b/y"), ("a/b/c/z", "m/c/z"), ("a/b/c/z", "a/b/c/z")} - {("a/b/y", "a/b/y"), ("a/b/c/z", "a/b/c/z")} | {
        (k, k) for k in ("a/b/y", "a/b/c/z")
    }


def test_sync_copies_a_key_once_by_its_newest_version(spark):
    schema = "key string, size long, mtime long"
    source = spark.createDataFrame([("a/x", 1, 5), ("a/x", 2, 6), ("a/y", 3, 5), ("a/y", 3, 9), ("a/z", 4, 1), ("a/z", 9, 1)], schema)
    dest = spark.createDataFrame([("b/x", 1, 5), ("b/x", 2, 6), ("b/y", 3, 5), ("b/y", 3, 4)], schema)
    want = [("a/y", "b/y", 3, "newer"), ("a/z", "b/z", 9, "missing")]
    assert sorted(map(tuple, objects.sync_plan(source, dest, "a", "b").collect())) == want
    pairs = spark.createDataFrame([("a", "b")], "src_prefix string, dest_prefix string")
    got = objects.sync_pairs(source, dest, pairs).select("src_key", "dest_key", "size", "reason").collect()
    assert sorted(map(tuple, got)) == want


def test_unknown_states_complete_nothing(spark):
    steps = spark.createDataFrame([("j", "COMPLETED"), ("j", None), ("n", None), ("f", None), ("f", "FAILED"), ("c", "COMPLETED")], "job string, state string")
    assert {r.job: r.verdict for r in status.step_rollup(steps).collect()} == {"j": "PENDING", "n": "PENDING", "f": "FAILED", "c": "COMPLETE"}
    assert {r.job: r.active for r in status.jobs_active(steps).collect()} == {"j": False, "n": False, "f": False, "c": False}
    history = steps.withColumn("poll", F.lit(0))
    assert {r.job: r.verdict for r in status.await_steps(history).collect()}["j"] == "PENDING"


def test_special_characters_are_literal(spark):
    texts = ["a.b$c.b$", "x\\y\\y", "(p)(p)", ""]
    assert column(spark, texts, lambda c: fx.replace_last(c, "b$", "$1\\")) == ["a.b$c.$1\\", "x\\y\\y", "(p)(p)", ""]
    assert column(spark, texts, lambda c: fx.replace_last(c, "\\y", "")) == ["a.b$c.b$", "x\\y", "(p)(p)", ""]
    assert column(spark, ["(p)\nq\n"], lambda c: fx.without_lines_with(c, "(p)")) == ["q\n"]
    assert column(spark, ["a\nb\n"], lambda c: fx.without_lines_with(c, "a\n")) == ["b\n"]


def test_render_of_marked_names_in_one_piece(spark):
    variables = F.array(
        F.struct(F.lit("#a#").alias("k"), F.lit("#b#").alias("v")), F.struct(F.lit("#b#").alias("k"), F.lit("B").alias("v"))
    )
    assert column(spark, ["#a# #b#\nb\n#c#", ""], lambda c: fx.render_text(c, variables)) == ["B B\nb\n#c#", ""]

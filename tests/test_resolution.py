"""References against plain recursion; layers, lists, subtrees and own earlier values resolved together."""

from __future__ import annotations

import random
import re

from millrace.operators import resolution

REF = re.compile(r"\$\{(\??)([^}]*)\}")


def plain(tree):
    """Status and value of each path by recursion: a cycle counts before what is missing."""

    def look(path, seen):
        if path in seen:
            return None, "cycle"
        found = [look(ref, {*seen, path}) for opt, ref in REF.findall(tree[path] or "") if ref in tree]
        if any(s == "cycle" for _, s in found):
            return None, "cycle"
        if any(s == "missing" for _, s in found) or any(not opt and ref not in tree for opt, ref in REF.findall(tree[path] or "")):
            return None, "missing"
        return REF.sub(lambda m: (look(m[2], {*seen, path})[0] or "") if m[2] in tree else "", tree[path]) if tree[path] is not None else None, "resolved"

    return {p: look(p, set()) for p in tree}


def test_values_as_by_recursion(spark):
    rng = random.Random(3)
    tree = {}
    for n in range(24):  # small graphs side by side, with loops, branches and dead ends
        names = [f"t{n}.{k}" for k in range(rng.randint(1, 7))]
        for p in names:
            refs = [rng.choice([*names, *names, f"t{n}.no"]) for _ in range(rng.choice([0, 0, 1, 1, 2]))]
            tree[p] = rng.choice(["", "a"]) + "".join("${" + rng.choice(["", "", "?"]) + r + "}" + rng.choice(["", "-", "$"]) for r in refs)
    tree["null"] = None
    frame = spark.createDataFrame(list(tree.items()), "path string, value string")
    got = {r.path: (r.value, r.status) for r in resolution.resolve_values(frame).collect()}
    assert got == plain(tree)
    assert {s for _, s in got.values()} == {"resolved", "missing", "cycle"}


def test_a_chain_of_a_thousand_links_takes_few_rounds(spark, monkeypatch):
    written = []
    cut = resolution.cut_lineage
    monkeypatch.setattr(resolution, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    n = 1000
    rows = [(f"c{i}", f".${{c{i + 1}}}" if i < n else "end") for i in range(n + 1)] + [(f"l{i}", f"${{l{(i + 1) % 7}}}") for i in range(7)]
    got = {r.path: (r.value, r.status) for r in resolution.resolve_values(spark.createDataFrame(rows, "path string, value string")).collect()}
    assert all(got[f"c{i}"] == ("." * (n - i) + "end", "resolved") for i in range(n + 1))
    assert {got[f"l{i}"] for i in range(7)} == {(None, "cycle")}
    assert sum("items" in c and "refs" not in c for c in written) <= 11 + 1  # texts: the start, and a round for each doubling


def test_only_nodes_that_others_need_take_part_in_rounds(spark, monkeypatch):
    sizes = []
    run = {f: getattr(resolution, f) for f in ("endings", "filled")}
    for name in run:
        monkeypatch.setattr(resolution, name, lambda nodes, f=run[name]: sizes.append(nodes.count()) or f(nodes))
    tree = {"base": "${top}!", "top": "${none}${?no}", "loop": "${loop}", "ok": "${okay}.", "okay": "${end}", "end": "${?no}e"}
    tree |= {f"n{i}": "<" + "${" + ("base", "ok", "loop", "gone", "?gone")[i % 5] + "}${ok}>" for i in range(100)}
    got = {r.path: (r.value, r.status) for r in resolution.resolve_values(spark.createDataFrame(list(tree.items()), "path string, value string")).collect()}
    assert got == plain(tree)
    assert max(sizes) <= 6


def test_layers_lists_subtrees_and_own_values(spark):
    entries = [
        (0, 1, "a.x", "set", "1"), (0, 2, "a.y", "set", "${b}!"), (0, 3, "b", "set", "B"),
        # a subtree taken over: leaves set later win, also those of a copy of the copy, the others stay
        (0, 4, "c", "set", "${a}"), (1, 1, "c.x", "set", "2"), (0, 5, "c.z", "set", "z"), (0, 6, "al", "set", "${c}"),
        # own earlier values
        (0, 7, "p", "set", "/bin"), (1, 2, "p", "set", "${p}:/usr"), (2, 1, "p", "set", "${?p}:/opt"), (2, 2, "n", "set", "${?n}first"), (2, 3, "m", "set", "${m}x"),
        # lists: appended over layers, copied, started anew, empty
        (0, 8, "l", "clear", None), (0, 9, "l", "append", "e1"), (0, 10, "l", "append", "${b}"), (1, 3, "l", "append", "e3"),
        (0, 11, "k", "set", "${l}"), (1, 4, "k", "append", "k1"), (0, 12, "e", "clear", None), (0, 13, "f", "set", "${e}"),
        (0, 14, "d", "append", "gone"), (1, 5, "d", "clear", None), (1, 6, "d", "append", "new"),
        # what does not resolve, each named
        (0, 15, "loop.a", "set", "${loop.b}"), (0, 16, "loop.b", "set", "x${loop.a}"), (0, 17, "gone", "set", "${no.where}"),
        (0, 18, "self.tree.inner", "set", "${self.tree}"), (0, 19, "self.tree.v", "set", "1"), (0, 20, "mix", "set", "<${l}>"), (0, 21, "mixed", "set", "<${e}>"),
        (0, 22, "u.one", "set", "${v}"), (0, 23, "v.two", "set", "${u}"), (0, 24, "v.three", "set", "3"),
        # null is unset; a later scalar replaces a subtree
        (0, 25, "nul", "set", None), (1, 7, "sc", "set", "s"), (0, 26, "sc.sub", "set", "dropped"), (0, 27, "deep", "set", "${al.y}${p}"),
    ]
    got = resolution.ordered_resolve(spark.createDataFrame(entries, "layer int, seq long, path string, op string, value string")).collect()
    scalars = {r.path: (r.value, r.status) for r in got if r.element is None}
    assert scalars == {
        "a.x": ("1", "resolved"), "a.y": ("B!", "resolved"), "b": ("B", "resolved"),
        "c.x": ("2", "resolved"), "c.y": ("B!", "resolved"), "c.z": ("z", "resolved"), "al.x": ("2", "resolved"), "al.y": ("B!", "resolved"), "al.z": ("z", "resolved"),
        "p": ("/bin:/usr:/opt", "resolved"), "n": ("first", "resolved"), "m": (None, "missing"), "e": (None, "resolved"), "f": (None, "resolved"),
        "loop.a": (None, "cycle"), "loop.b": (None, "cycle"), "gone": (None, "missing"), "self.tree.inner": (None, "cycle"), "self.tree.v": ("1", "resolved"),
        "mix": (None, "missing"), "mixed": (None, "missing"), "u.one": (None, "cycle"), "v.two": (None, "cycle"), "v.three": ("3", "resolved"),
        "sc": ("s", "resolved"), "deep": ("B!/bin:/usr:/opt", "resolved"),
    }
    lists = {}
    for r in sorted((r for r in got if r.element is not None), key=lambda r: (r.path, r.element)):
        lists.setdefault(r.path, []).append(r.value)
    assert lists == {"l": ["e1", "B", "e3"], "k": ["e1", "B", "e3", "k1"], "d": ["new"]}


def test_own_values_over_many_layers(spark):
    n = 300
    entries = [(i, 0, "p", "set", "s" if i == 0 else f"${{p}}.{i}") for i in range(n)]
    row = resolution.ordered_resolve(spark.createDataFrame(entries, "layer int, seq long, path string, op string, value string")).first()
    assert (row.path, row.value) == ("p", "s" + "".join(f".{i}" for i in range(1, n)))


def test_no_entries(spark):
    assert resolution.ordered_resolve(spark.createDataFrame([], "layer int, seq long, path string, op string, value string")).count() == 0

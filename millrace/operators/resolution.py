"""Resolution of references: ``${path}`` in values, whole subtrees, and a path's own earlier layer.

Rounds halve chains instead of taking their links one by one. Which references ever end is
found on paths alone, so nothing grows in a cycle; texts are filled only where they end, each round
putting into a value what the values it refers to hold by then. A chain of 1,000
links takes ten rounds of either kind. Nodes that no other one needs take no part in rounds. What a round finds is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.layers import layered_latest, prefixes, unshadowed
from millrace.operators.ranking import numbered
from millrace.session import cut_lineage

REFERENCE = "\\$\\{([^}]*)\\}"
WHOLE = "^\\$\\{\\??([^}]*)\\}$"
MARK = "\x00"  # between a path and the version of it that a later layer builds on
EMPTY = MARK + "[]"  # the value of a list without elements, until the end


def endings(nodes: DataFrame) -> DataFrame:
    """Which nodes of a graph of references end: ``path, lost`` of those that do; the others lead into a cycle.

    ``nodes`` (a written table) holds ``path, refs array<string>, lost``: the nodes a node needs, all of them in the table, and
    whether it needs something that is nowhere; ``lost`` of the result is that of any node it needs. Each round a
    reference to a node that has ended goes, and one to a node with a single reference left goes
    on to where that leads, so chains halve. References are never more than at the start. If nothing
    ends for as many rounds as the longest chain can take, nothing will.
    """
    state = nodes.select("path", F.array_distinct("refs").alias("refs"), "lost")
    is_open = F.size("refs") > 0
    ended, waiting = [state.where(~is_open).select("path", "lost")], state.where(is_open)
    n_open, idle = waiting.count(), 0
    while n_open and idle <= ceil(log2(n_open)) + 1:
        one = F.when(F.size("refs") == 1, F.get("refs", F.lit(0)))
        known = reduce(DataFrame.unionByName, [
            waiting.select(F.col("path").alias("ref"), one.alias("next"), F.col("lost").alias("next_lost"), F.lit(False).alias("over")),
            *[e.select(F.col("path").alias("ref"), F.lit(None).cast("string").alias("next"), F.col("lost").alias("next_lost"), F.lit(True).alias("over")) for e in ended],
        ])
        passed = F.col("over") | F.col("next").isNotNull()
        moved = (
            waiting.select("path", "lost", F.explode("refs").alias("ref")).join(known, "ref").groupBy("path")
            .agg(
                F.max(F.col("lost") | (passed & F.col("next_lost"))).alias("lost"),
                F.collect_set(F.when(~F.col("over"), F.coalesce("next", "ref"))).alias("refs"),
                F.max(F.when(~F.col("over") & (F.coalesce("next", "ref") != F.col("ref")), True).otherwise(F.col("over"))).alias("changed"),
            )
        )
        state = cut_lineage(moved)
        newly = state.where(~is_open).select("path", "lost")
        waiting = state.where(is_open).select("path", "refs", "lost")
        left = state.agg(F.count(F.when(is_open, 1)), F.max("changed")).first()
        if not left[1]:
            break
        idle = idle + 1 if left[0] == n_open else 0
        if left[0] < n_open:
            ended.append(newly)
        n_open = left[0]
    return reduce(DataFrame.unionByName, ended)


def filled(nodes: DataFrame) -> DataFrame:
    """``path, value`` of nodes whose references all end: ``items`` are texts and references in order."""
    state = cut_lineage(nodes.select("path", "items"))
    has_refs = F.exists("items", lambda i: i["ref"].isNotNull())
    done, waiting = [state.where(~has_refs)], state.where(has_refs)
    while not waiting.isEmpty():
        known = reduce(DataFrame.unionByName, [*done, waiting]).select(F.col("path").alias("ref"), F.col("items").alias("found"))
        asked = waiting.select("path", F.posexplode("items").alias("pos", "item")).where("item.ref IS NOT NULL").select("path", "pos", F.col("item.ref").alias("ref"))
        answers = asked.join(known, "ref").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("pos", "found"))).alias("answers"))
        state = cut_lineage(
            waiting.join(answers, "path").select(
                "path", F.flatten(F.transform("items", lambda x, i: F.coalesce(F.try_element_at("answers", i), F.array(x)))).alias("items")
            )
        )
        done.append(state.where(~has_refs))
        waiting = state.where(has_refs)
    return reduce(DataFrame.unionByName, done).select("path", F.array_join(F.transform("items", lambda i: i["text"]), "").alias("value"))


def _items(rows: DataFrame) -> DataFrame:
    """``path, n, pos, text, ref, optional``: the texts and the references of each value in order."""
    names = F.regexp_extract_all("value", F.lit(REFERENCE), F.lit(1))
    texts = F.split("value", REFERENCE, -1)
    return rows.select("path", F.posexplode(F.arrays_zip(texts.alias("text"), names.alias("name"))).alias("pos", "part")).select(
        "path", "pos", "part.text", F.regexp_replace("part.name", "^\\?", "").alias("ref"), F.coalesce(F.col("part.name").startswith("?"), F.lit(False)).alias("optional")
    )


def resolve_values(rows: DataFrame) -> DataFrame:
    """``path, value, status`` of ``rows`` (path, value): every ``${path}`` in a value replaced by the value there.

    ``${?path}`` stands for nothing where there is no such path. Status is resolved; cycle, if a reference
    never ends; missing, if one leads nowhere, at once or further on. Only resolved rows carry a value.
    """
    refers = F.coalesce(F.col("value").rlike(REFERENCE), F.lit(False))
    plain, open_rows = rows.where(~refers), rows.where(refers)
    # references to plain values, the most frequent ones, are filled here already
    target = rows.select(F.col("path").alias("ref"), F.when(~refers, F.coalesce("value", F.lit(""))).alias("ready"), F.lit(True).alias("there"))
    parts = _items(open_rows).join(target, "ref", "left")
    still = F.col("ref").isNotNull() & F.col("there").isNotNull() & F.col("ready").isNull()
    piece = F.struct(
        "pos", F.array(F.struct(F.col("text"), F.lit(None).cast("string").alias("ref")), F.struct(F.coalesce("ready", F.lit("")).alias("text"), F.when(still, F.col("ref")).alias("ref"))).alias("items")
    )
    nodes = cut_lineage(
        parts.groupBy("path").agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["items"])).alias("items"),
            F.collect_set(F.when(still, F.col("ref"))).alias("refs"),
            F.max(F.col("ref").isNotNull() & F.col("there").isNull() & ~F.col("optional")).alias("lost"),
        )
    )
    # rounds are for nodes that others need; the rest, mostly many more, needs their results once
    needed = nodes.select(F.explode("refs").alias("path")).distinct()
    inner = cut_lineage(nodes.join(needed, "path", "left_semi"))
    ended = endings(inner.select("path", "refs", "lost"))
    texts = filled(inner.join(ended.where(~F.col("lost")).select("path"), "path", "left_semi"))
    found = cut_lineage(
        inner.select("path").join(ended, "path", "left").join(texts, "path", "left")
        .select("path", "value", F.when(F.col("lost").isNull(), "cycle").when(F.col("lost"), "missing").otherwise("resolved").alias("status"))
    )
    outer = nodes.join(found, "path", "left_anti")
    answers = (
        outer.select("path", F.explode("refs").alias("ref")).join(found.withColumnRenamed("path", "ref"), "ref").groupBy("path")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("ref", "value"))).alias("answers"),
            F.max(F.col("status") == "cycle").alias("endless"), F.max(F.col("status") == "missing").alias("nowhere"),
        )
    )
    status = F.when(F.col("endless"), "cycle").when(F.col("lost") | F.coalesce("nowhere", F.lit(False)), "missing").otherwise("resolved")
    text = F.array_join(F.transform("items", lambda i: F.coalesce(F.try_element_at("answers", i["ref"]), i["text"])), "")
    last = outer.join(answers, "path", "left").select("path", text.alias("value"), status.alias("status"))
    return reduce(DataFrame.unionByName, [
        plain.select("path", "value", F.lit("resolved").alias("status")),
        found,
        last.select("path", F.when(F.col("status") == "resolved", F.col("value")).alias("value"), "status"),
    ])


# -- layers, lists, subtrees ------------------------------------------------------------

def _order_key(layer: Column, seq: Column) -> Column:
    """A name of a list element; names sort as (layer, seq) do."""
    digits = lambda c, n: F.lpad((c.cast("decimal(38,0)") + F.lit(str(10 ** (n - 1))).cast("decimal(38,0)")).cast("string"), n, "0")
    return F.concat(digits(layer, 11), F.lit("-"), digits(seq, 20))


def element_path(path: Column, layer: Column, seq: Column, separator: str = ".") -> Column:
    return F.concat(path, F.lit(separator + "["), _order_key(layer, seq), F.lit("]"))


def _grafts(leaves: DataFrame, separator: str) -> DataFrame:
    """``path, target, at`` of leaves that point to a subtree, by one reference as a whole or by a row of them."""
    whole = leaves.where(F.col("value").rlike(WHOLE)).select("path", F.regexp_extract("value", WHOLE, 1).alias("target"), "at")
    trees = cut_lineage(leaves.select(F.explode(prefixes(F.col("path"), separator)).alias("target")).distinct())
    # a path with leaves of its own is where a chain ends
    state = cut_lineage(
        whole.where("path <> target").withColumn("moved", F.lit(False))
        .join(trees.select(F.col("target").alias("path"), F.lit(True).alias("own")), "path", "left")
    )
    # halved like any chain; the targets of a cycle move for ever, and are no subtree
    most = state.count()
    for _ in range(ceil(log2(most)) + 1 if most else 0):
        further = state.where("own IS NULL").select(F.col("path").alias("target"), F.col("target").alias("next"))
        state = cut_lineage(state.join(further, "target", "left").select("path", F.coalesce("next", "target").alias("target"), "at", F.col("next").isNotNull().alias("moved"), "own"))
        if state.where("moved").isEmpty():
            break
    return cut_lineage(state.drop("moved", "own").join(trees, "target", "left_semi"))


def _grafted(leaves: DataFrame, separator: str) -> tuple[DataFrame, DataFrame]:
    """``(leaves, endless)``: leaves that point to a subtree give way to leaves that point to its leaves; ``endless`` hold themselves."""
    endless = [leaves.select("path").limit(0)]
    grafts = _grafts(leaves, separator)
    while True:
        marked = leaves.join(grafts.select("path", F.lit(True).alias("grafts")), "path", "left")
        leaves = cut_lineage(unshadowed(marked, separator, F.col("grafts").isNull()))
        grafts = leaves.where("grafts").select("path").join(grafts, "path")
        scalars = leaves.where("grafts IS NULL").select(F.col("path").alias("target"))
        grafts = cut_lineage(grafts.join(scalars, "target", "left_anti"))
        leaves = leaves.drop("grafts")
        if grafts.isEmpty():
            return leaves, reduce(DataFrame.unionByName, endless)
        inside = grafts.select(F.col("path").alias("ref"), F.explode(prefixes(F.concat("path", F.lit(separator + "x")), separator)).alias("target"))
        # what lies at or below a target is copied into it first
        needs = cut_lineage(grafts.join(inside, "target", "left").groupBy("path").agg(F.collect_set("ref").alias("refs")).withColumn("lost", F.lit(False)))
        looping = cut_lineage(grafts.join(endings(needs), "path", "left_anti").select("path"))
        endless.append(looping)
        ready = needs.where(F.size("refs") == 0).select("path")
        grafts = grafts.join(ready, "path", "left_semi")
        below = leaves.join(looping, "path", "left_anti").select(
            F.col("path").alias("leaf"), F.col("value").alias("leaf_value"), F.explode(prefixes(F.col("path"), separator)).alias("target")
        )
        rest = F.expr("substring(leaf, length(target) + 1)")
        # elements of a copied list come where the copy was made
        copied_rest = F.when(
            rest.startswith(separator + "["),
            F.concat(F.lit(separator + "["), _order_key(F.col("at.layer"), F.col("at.seq")), F.lit("|"), F.expr(f"substring(leaf, length(target) + {len(separator) + 2})")),
        ).otherwise(rest)
        points = F.concat(F.lit("${"), "leaf", F.lit("}"))
        copies = below.join(grafts, "target").select(
            F.concat("path", copied_rest).alias("path"), F.when(F.col("leaf_value").rlike(WHOLE), F.col("leaf_value")).otherwise(points).alias("value"), "at"
        )
        gone = grafts.select("path").unionByName(looping)
        leaves = cut_lineage(layered_latest(leaves.join(gone, "path", "left_anti").unionByName(copies)))
        grafts = _grafts(leaves, separator)


def ordered_resolve(entries: DataFrame, separator: str = ".") -> DataFrame:
    """Layers merged, lists put together and references resolved, in one: ``path, element, value, status``.

    ``entries`` holds ``(layer, seq, path, op, value)``, later (layer, seq) wins. Op ``set`` sets a value; ``clear``
    starts a list anew; ``append`` adds an element to it. A value may refer to

    - a value: ``${path}`` anywhere in its text, ``${?path}`` for nothing where there is none;
    - a subtree or list, as a whole: ``${path}`` alone; leaves set below it win if they are later, and stay beside it if not;
    - its own path: the value that the path had before, in an earlier entry.

    A null value to set counts as unset. ``element`` is NULL, or orders the elements of a list; a list without elements has one
    row with neither. ``status`` is as in ``resolve_values``; a subtree that holds itself is a cycle, and one inside of a longer text is missing.
    """
    at = F.struct("layer", "seq")
    op = F.coalesce("op", F.lit("set"))
    rows = entries.where(F.col("value").isNotNull() | (op == "clear")).select(
        F.when(op == "append", element_path(F.col("path"), F.col("layer"), F.col("seq"), separator)).otherwise(F.col("path")).alias("path"),
        F.when(op == "clear", F.lit(None)).otherwise(F.col("value")).alias("value"), at.alias("at"), (op == "clear").alias("cleared"),
    )
    latest = layered_latest(rows.withColumn("value", F.struct("value", "cleared")))
    leaves = cut_lineage(latest.select("path", F.when(F.col("value.cleared"), EMPTY).otherwise(F.col("value.value")).alias("value"), "at"))

    # a path's own earlier values become nodes of their own, each named by the number of its entry
    own = F.concat(F.lit("${"), "path", F.lit("}")), F.concat(F.lit("${?"), "path", F.lit("}"))
    refers_to_itself = F.contains("value", own[0]) | F.contains("value", own[1])
    building = rows.where(refers_to_itself & ~F.col("cleared")).select("path").distinct()
    history = rows.where("NOT cleared").join(building, "path", "left_semi").select("path", "value", F.col("at.layer").alias("layer"), F.col("at.seq").alias("seq"))
    placed = cut_lineage(numbered(history.withColumn("at", F.struct("layer", "seq")), ["path"], "at", "n"))
    last = placed.groupBy("path").agg(F.max("n").alias("last"))
    before = F.concat("path", F.lit(MARK), (F.col("n") - 1).cast("string"))
    versioned = placed.join(last, "path").select(
        F.when(F.col("n") == F.col("last"), F.col("path")).otherwise(F.concat("path", F.lit(MARK), F.col("n").cast("string"))).alias("path"),
        F.replace(F.replace("value", own[0], F.concat(F.lit("${"), before, F.lit("}"))), own[1], F.concat(F.lit("${?"), before, F.lit("}"))).alias("value"),
        (F.col("n") == F.col("last")).alias("is_last"),
    )
    leaves = cut_lineage(
        leaves.join(versioned.where("is_last").select("path", F.col("value").alias("new")), "path", "left").select("path", F.coalesce("new", "value").alias("value"), "at")
    )
    leaves, endless = _grafted(leaves, separator)
    nodes = leaves.select("path", "value").unionByName(versioned.where("NOT is_last").select("path", "value"))
    resolved = resolve_values(cut_lineage(nodes)).where(~F.contains("path", F.lit(MARK)))
    everything = resolved.unionByName(endless.select("path", F.lit(None).cast("string").alias("value"), F.lit("cycle").alias("status")))
    in_list = F.regexp_extract("path", "^(.*)" + "\\Q" + separator + "\\E" + "\\[([0-9|-]*)\\]$", 2)
    return everything.select(
        F.when(in_list != "", F.col("path").substr(F.lit(1), F.length("path") - F.length(in_list) - 2 - len(separator))).otherwise(F.col("path")).alias("path"),
        F.when(in_list != "", in_list).alias("element"), F.when(~F.contains("value", F.lit(MARK)), F.col("value")).alias("value"),
        # a list inside of a longer text is no text
        F.when(F.contains("value", F.lit(MARK)) & (F.col("value") != EMPTY), "missing").otherwise(F.col("status")).alias("status"),
    )

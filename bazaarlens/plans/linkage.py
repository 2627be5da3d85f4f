"""Greedy decisions over large graphs in rounds: complete linkage by edge order, and choice by node order.

Both give what one pass over everything in order would give. In a round, tasks take bounded blocks of the graph and
decide in order what nothing outside their block can come before; what is decided contracts the graph, and the next
round takes the rest. Blocks follow components, so a graph of small components is done in one round; a component
that is larger than a block takes a few.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .storage import materialize

#: Rows that a task holds, about.
BLOCK = 200_000


def merged_in_order(rows: Iterable[tuple]) -> dict[str, str]:
    """``{old: new}`` of the merges of one block, both for merged groups and for the groups they are merged into.

    ``rows``: (node, other, ahead, score, a, b), for each edge of a node of the block; an edge between two of them comes
    twice. ``ahead``: whether the node is the end that the edge's a belongs to. Edges are taken by falling score, then a
    and b. Two groups merge if each other group is a neighbour of both or of neither from then on; the one of the a's end
    keeps its name. An edge to a node of another block leaves its group, and all that it could merge with, undecided.
    """
    rows = list(rows)
    near: dict[str, set] = defaultdict(set)
    for node, other, *_ in rows:
        near[node].add(other)
    inside, up, waits = set(near), {}, set()

    def top(x: str) -> str:
        while x in up:
            x = up[x]
        return x

    for node, other, ahead, *_ in sorted(rows, key=lambda r: (-r[3], r[4], r[5])):
        g = top(node)
        if other not in inside:
            if other in near[g]:
                waits.add(g)
            continue
        h = top(other)
        if not ahead or g == h or h not in near[g]:
            continue
        if g in waits or h in waits:
            waits |= {g, h}
            continue
        both = near[g] & near[h]
        for x in near[g] | near[h]:
            if x in near:  # nodes of other blocks have no list here
                near[x].discard(h)
                if x not in both:
                    near[x].discard(g)
        near[g] = both
        del near[h]
        up[h] = g
    return {x: top(x) for x in {*up, *map(top, up)}}


def _contracted(live: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges between groups after ``merged`` (old, new). Two groups stay neighbours if all their parts were."""
    merged = merged.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("new")))
    for end in ("g", "h"):
        moved = merged.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"), F.col("n").alias(f"n_{end}"))
        live = live.join(moved, end, "left")
    g, h = F.coalesce("new_g", "g"), F.coalesce("new_h", "h")
    rows = live.where(g != h).select("component", F.struct((-F.col("score")).alias("down"), "a", "b", g.alias("g"), h.alias("h")).alias("best"), F.least(g, h).alias("x"), F.greatest(g, h).alias("y"), (F.coalesce("n_g", F.lit(1)) * F.coalesce("n_h", F.lit(1))).alias("parts"))
    kept = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"), F.min("best").alias("best"), F.min("component").alias("component")).where("n = parts")
    return materialize(kept.select("component", "best.g", "best.h", (-F.col("best.down")).alias("score"), "best.a", "best.b"), "linkage")


def complete_linkage(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(node, label)`` for each node with an edge: greedy complete linkage.

    ``edges``: (g, h, score, a, b), one for each pair of nodes that may be in one group; a and b order edges of equal
    score, and a belongs to g. Edges are taken by falling score, then a, then b; two groups merge if all pairs between
    them are edges. The label is the node that the group grew from, at the a's end of each merge.
    """
    found = materialize(connected_components(edges, "g", "h"), "linked")
    live = materialize(edges.join(found.select(F.col("node").alias("g"), "component"), "g").select("component", "g", "h", "score", "a", "b"), "linkage")
    labels = found.select("node", F.col("node").alias("label"))
    pair = "old string, new string"

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        rows = pd.concat(parts).itertuples(index=False, name=None) if parts else ()
        yield pd.DataFrame(merged_in_order(rows).items(), columns=["old", "new"], dtype=object)

    while n := live.count():
        ends = [live.select("component", F.col(x).alias("node"), F.col(y).alias("other"), F.lit(x == "g").alias("ahead"), "score", "a", "b") for x, y in ("gh", "hg")]
        # all edges of a node are in one block
        dealt = ends[0].unionByName(ends[1]).repartitionByRange(-(-2 * n // block), "component", "node").drop("component")
        merged = materialize(dealt.mapInPandas(decide, pair), "merged")
        live, labels = _contracted(live, merged), _relabelled(labels, merged)
        if not live.isEmpty():
            # edges that are the first of both their ends, so that edges between blocks are decided too
            order = F.struct((-F.col("score")).alias("down"), "a", "b")
            first = live.select(F.col("g").alias("node"), order.alias("o")).unionAll(live.select("h", order)).groupBy("node").agg(F.min("o").alias("o"))
            mutual = live.withColumn("o", order).join(first.select(F.col("node").alias("g"), "o"), ["g", "o"], "left_semi").join(first.select(F.col("node").alias("h"), "o"), ["h", "o"], "left_semi")
            merged = materialize(mutual.select(F.col("g").alias("old"), F.col("g").alias("new")).unionAll(mutual.select("h", "g")), "merged")
            live, labels = _contracted(live, merged), _relabelled(labels, merged)
    return labels


def _relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    moved = labels.join(merged.where("old <> new").withColumnRenamed("old", "label"), "label", "left")
    return materialize(moved.select("node", F.coalesce("new", "label").alias("label")), "labels")


def linked_by_kinds(offers: Iterable[tuple], edges: Iterable[tuple]) -> list[tuple]:
    """``(offer, label)`` of one component: complete linkage of all edges of offers, by falling score, then a and b.

    ``offers``: (offer, merchant, kind); ``edges``: (ka, kb, score): offers a of ka and b of kb, a < b, of different merchants
    are an edge. Groups hold their merchants, and their offers by kind in order, and two groups that can't merge never
    can later. So at each score a group is held against others once for each of its kinds, from its first offer of that
    kind, by the other groups' first offers after it; there is no step for a pair of offers.
    """
    score_of: dict = {}
    levels: dict = defaultdict(lambda: defaultdict(list))
    for ka, kb, score in edges:
        score_of[ka, kb] = score
        levels[score][ka].append(kb)
    names, shops, members, of_kind = [], [], [], defaultdict(set)
    for g, (offer, merchant, kind) in enumerate(offers):
        names.append(offer)
        shops.append({merchant})
        members.append({kind: [offer]})
        of_kind[kind].add(g)
    up = list(range(len(names)))

    def top(g: int) -> int:
        while up[g] != g:
            up[g] = up[up[g]]
            g = up[g]
        return g

    def fit(g: int, h: int) -> bool:
        if not shops[g].isdisjoint(shops[h]):
            return False
        for k, x in members[g].items():
            for m, y in members[h].items():
                if (x[0] < y[-1] and (k, m) not in score_of) or (y[0] < x[-1] and (m, k) not in score_of):
                    return False
        return True

    def merge(g: int, h: int) -> None:
        up[h] = g
        shops[g] |= shops[h]
        for k, y in members[h].items():
            x = members[g].setdefault(k, [])
            after = not x or x[-1] < y[0]
            x.extend(y)
            if not after:
                x.sort()
            of_kind[k].discard(h)
            of_kind[k].add(g)
        shops[h] = members[h] = None

    for score in sorted(levels, reverse=True):
        ends = levels[score]
        held: dict = defaultdict(set)
        for a, g, ka in sorted((members[g][ka][0], g, ka) for ka in ends for g in of_kind[ka]):
            g = top(g)
            if ka in held[g]:
                continue
            held[g].add(ka)
            first: dict = {}
            for kb in ends[ka]:
                for h in of_kind[kb]:
                    y = members[h][kb]
                    if h != g and y[-1] > a:
                        b = y[0] if y[0] > a else y[bisect_right(y, a)]
                        if h not in first or b < first[h]:
                            first[h] = b
            for h in sorted(first, key=first.get):
                if fit(g, h):
                    merge(g, h)
                    held[g] |= held.pop(h, set())
    return [(offer, names[top(g)]) for g, offer in enumerate(list(names))]


def chosen_in_order(rows: Iterable[tuple]) -> Iterator[str]:
    """Names of the chosen of one block. ``rows``: (name, keys, before), in order, where ``before`` says for each key how
    many come earlier in the whole order; a row is chosen if none of its keys is taken and all that come earlier at its
    keys are in the block and decided."""
    seen: dict = defaultdict(int)
    taken, waits = set(), set()
    for name, keys, before in rows:
        lost = not taken.isdisjoint(keys)
        if not lost and any(seen[k] < n or k in waits for k, n in zip(keys, before)):
            waits.update(keys)
        elif not lost:
            taken.update(keys)
            yield name
        for k in keys:
            seen[k] += 1


def first_disjoint(claims: DataFrame, order: list, block: int = BLOCK) -> DataFrame:
    """``(name)`` of the rows chosen in order so that no two share a key.

    ``claims``: (name, key, columns of ``order``), one for each key of a name, which has the same columns in all. ``order``
    holds expressions that tell all names apart."""
    names = [f"_{k}" for k in range(len(order))]
    claims = materialize(claims.select("name", "key", *[o.alias(n) for o, n in zip(order, names)]).distinct(), "claims")
    first = Window.partitionBy("key")
    shared = claims.withColumn("first", F.min("name").over(first)).where("first <> name")
    found = connected_components(shared.select("first", "name").distinct(), "first", "name").select(F.col("node").alias("name"), "component")
    left = materialize(claims.join(found, "name", "left").withColumn("component", F.coalesce("component", "name")), "claims")
    chosen = []

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["name"], b["keys"], b["before"]))
        found: list[str] = []
        for name in chosen_in_order(rows):
            found.append(name)
            if len(found) == 10_000:
                yield pd.DataFrame({"name": found})
                found = []
        yield pd.DataFrame({"name": found}, dtype=object)

    while n := left.count():
        ranked = left.withColumn("before", F.row_number().over(first.orderBy(*names)) - 1)
        rows = ranked.groupBy("component", "name", *names).agg(F.collect_list("key").alias("keys"), F.collect_list("before").alias("before"))
        dealt = rows.repartitionByRange(-(-n // block), "component", *names).sortWithinPartitions("component", *names)
        won = materialize(dealt.select("name", "keys", "before").mapInPandas(decide, "name string"), "chosen")
        chosen.append(won)
        gone = left.join(won, "name", "left_semi").select("key").distinct()
        lost = left.join(gone, "key", "left_semi").select("name").distinct()
        left = materialize(left.join(lost, "name", "left_anti"), "claims")
    out = claims.select("name").limit(0)
    for won in chosen:
        out = out.unionAll(won)
    return out

"""Graph analytics on an edge table (src, dst), with nodes as strings or numbers.

Loops are over distances or rounds, never over rows; each step is a join of the
frontier with the edges, and its result is checkpointed to the shared folder, so plans
don't grow and a lost executor costs a step.  Algorithms whose number of rounds grows
with the graph's depth (components, layers) run in one task while the edge list has at
most ``ONE_TASK`` rows, and as distributed rounds beyond it; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import cut

ONE_TASK = 1_000_000


def edges_of(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def k_hop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of the start nodes (a column ``node``), each with its least depth; the plan is unrolled."""
    e = edges_of(edges).distinct()
    found = frontier = start.select("node").distinct().withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        frontier = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(k))
        found = found.unionByName(frontier)
    return found.groupBy("node").agg(F.min("depth").cast("long").alias("depth")).filter("depth > 0")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes that the start nodes reach, with their depth (the start nodes themselves are left out)."""
    e = edges_of(edges).distinct()
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    frontier, k = seen, 0
    while True:
        k += 1
        step = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(k).cast("long")))
        if frontier.isEmpty():
            return seen.filter("depth > 0")
        seen = cut(seen.unionByName(frontier))


def impact(edges: DataFrame, node) -> DataFrame:
    """Both closures of a node: node, direction (upstream: what reaches it; downstream: what it reaches), depth."""
    start = edges.sparkSession.createDataFrame([(node,)], edges_of(edges).select(F.col("src").alias("node")).schema)
    up = closure(reverse(edges_of(edges)), start).withColumn("direction", F.lit("upstream"))
    return up.unionByName(closure(edges, start).withColumn("direction", F.lit("downstream"))).select("node", "direction", "depth")


def degree_classes(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, in_degree, out_degree, kind: isolated, entry (nothing calls it), leaf (it calls nothing) or inner.  Parallel edges are one."""
    e = edges_of(edges).distinct()
    all_ = nodes.select("node").distinct() if nodes is not None else nodes_of(e)
    each = all_.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")).unionAll(e.select(F.col("dst"), F.lit(1), F.lit(0))).unionAll(e.select(F.col("src"), F.lit(0), F.lit(1)))
    d = each.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    i, o = F.col("in_degree"), F.col("out_degree")
    return d.withColumn("kind", F.when((i == 0) & (o == 0), "isolated").when(i == 0, "entry").when(o == 0, "leaf").otherwise("inner"))


# -- strongly connected components and layers -------------------------------------


def _tarjan(src: list, dst: list) -> dict:
    """node -> least node of its component, without recursion."""
    out: dict = {}
    for a, b in zip(src, dst):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, on, order, root = {}, {}, set(), [], {}
    for first in out:
        if first in index:
            continue
        work = [(first, iter(out[first]))]
        index[first] = low[first] = len(index)
        order.append(first)
        on.add(first)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    order.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = order.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    least = min(members)
                    for m in members:
                        root[m] = least
    return root


def scc(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component: the least node of its strongly connected component."""
    e = cut(edges_of(edges).distinct())
    kind = dict(e.dtypes)["src"]
    if e.count() <= one_task:

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = list(batches)
            if got:
                root = _tarjan(*(pd.concat(got)[c].tolist() for c in ("src", "dst")))
                yield pd.DataFrame({"node": list(root), "component": list(root.values())})

        return e.repartition(1).mapInPandas(solve, f"node {kind}, component {kind}")
    done, rest, nodes = None, e, cut(nodes_of(e))
    while True:
        # the least node that reaches each one, then, among those of one colour, what reaches the colour's own node
        colour = _least_reaching(nodes, rest)
        inner = cut(rest.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst"))
        back = closure(reverse(inner), colour.select(F.col("colour").alias("node")).distinct()).select("node").union(colour.select(F.col("colour").alias("node"))).distinct()
        found = cut(colour.join(back, "node").select("node", F.col("colour").alias("component")))
        done = found if done is None else cut(done.unionByName(found))
        nodes = cut(nodes.join(found, "node", "left_anti"))
        if nodes.isEmpty():
            return _relabel(done)
        keep = nodes.select(F.col("node").alias("src"))
        rest = cut(rest.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))


def _relabel(found: DataFrame) -> DataFrame:
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    now = cut(nodes.select("node", F.col("node").alias("colour")))
    while True:
        came = edges.join(now, edges["src"] == now["node"]).select(F.col("dst").alias("node"), "colour")
        new = cut(now.unionByName(came).groupBy("node").agg(F.min("colour").alias("colour")))
        if new.exceptAll(now).isEmpty():
            return new
        now = new


def layers(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, component, layer: 0 for what depends on nothing further; each component lies above all that it uses (longest path)."""
    comp = cut(scc(edges, one_task))
    e = edges_of(edges)
    dag = e.join(comp.toDF("src", "a"), "src").join(comp.toDF("dst", "b"), "dst").filter("a <> b").select("a", "b").distinct()
    dag = cut(dag)
    kind = dict(comp.dtypes)["component"]
    parts = comp.select("component").distinct()
    if dag.count() <= one_task:

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = list(batches)
            if not got:
                return
            rows = pd.concat(got)
            used: dict = {}
            waits: dict = {}
            for a, b in zip(rows["a"], rows["b"]):
                used.setdefault(b, []).append(a)
                waits[a] = waits.get(a, 0) + 1
            level = {b: 0 for b in used if b not in waits}
            todo = list(level)
            while todo:
                b = todo.pop()
                for a in used.get(b, ()):
                    level[a] = max(level.get(a, 0), level[b] + 1)
                    waits[a] -= 1
                    if not waits[a]:
                        todo.append(a)
            yield pd.DataFrame({"component": list(level), "layer": list(level.values())})

        level = dag.repartition(1).mapInPandas(solve, f"component {kind}, layer long")
    else:
        level = cut(parts.withColumn("layer", F.lit(0).cast("long")))
        while True:
            up = dag.join(level, dag["b"] == level["component"]).select(F.col("a").alias("component"), (F.col("layer") + 1).alias("layer"))
            new = cut(level.unionByName(up).groupBy("component").agg(F.max("layer").alias("layer")))
            if new.exceptAll(level).isEmpty():
                break
            level = new
    return comp.join(level, "component", "left").select("node", "component", F.coalesce("layer", F.lit(0)).cast("long").alias("layer"))


def merge_small_layers(found: DataFrame, least: int = 3) -> DataFrame:
    """From the bottom up, a layer of fewer nodes than ``least`` joins the next; layers are numbered anew.  Two layers or fewer stay."""
    sizes = sorted((r["layer"], r["n"]) for r in found.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each layer
    groups: list[list[int]] = []
    if len(sizes) <= 2:
        groups = [[k] for k, _ in sizes]
    else:
        held, n = [], 0
        for k, m in sizes:
            held, n = [*held, k], n + m
            if n >= least or k == sizes[-1][0]:
                groups.append(held)
                held, n = [], 0
    number = {k: i for i, g in enumerate(groups) for k in g}
    if not number:
        return found
    pairs = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    return found.withColumn("layer", F.element_at(pairs, F.col("layer").cast("int")).cast("long"))


LAYER_WORDS = {
    "foundation": "base config constant error exception helper mixin setting util",
    "data": "dao database entity model orm repository schema table",
    "service": "calculator engine handler manager processor service",
    "api": "api controller endpoint middleware route view",
    "entry": "app entrypoint main run server start",
}


def layer_types(found: DataFrame) -> DataFrame:
    """layer, layer_type, n_nodes: by words in the nodes' names, foundation first; the lowest layer is foundation by position."""
    low = F.lower(F.col("node").cast("string"))
    flags = [F.max(low.rlike("|".join(w.split())).cast("int")).alias(f"_{t}") for t, w in LAYER_WORDS.items()]
    g = found.groupBy("layer").agg(F.count(F.lit(1)).alias("n_nodes"), *flags)
    kind = F.when(F.lit(False), "")
    for t in LAYER_WORDS:
        kind = kind.when(F.col(f"_{t}") == 1, t)
    return g.select("layer", kind.when(F.col("layer") == 0, "foundation").otherwise("unknown").alias("layer_type"), "n_nodes")


#: What a search for each purpose looks at, as layers below and above the node's own.
SCOPES = {"symbol_definition": (0, 0), "implementation": (-1, 0), "debugging": (-1, 1), "refactoring": (-1, 1), "impact_analysis": (0, 2), "architecture": (-(10**6), 10**6)}


def scope_nodes(found: DataFrame, node, purpose: str) -> DataFrame:
    """The nodes in a search's scope, with how many layers they are away; an unknown node's scope is everything."""
    low, high = SCOPES.get(purpose, (0, 0))
    own = found.filter(F.col("node") == node).agg(F.max("layer").alias("_own"))
    gap = F.col("layer") - F.col("_own")
    return found.join(F.broadcast(own)).filter(F.col("_own").isNull() | gap.between(low, high)).select("node", "layer", F.abs(F.coalesce(gap, F.lit(0))).alias("gap"))


def relevance(scope: DataFrame, edges: DataFrame, node) -> DataFrame:
    """exp(-gap / 2), doubled for callers of the node, times 1.8 for what it calls."""
    e = edges_of(edges).distinct()
    callers = e.filter(F.col("dst") == node).select(F.col("src").alias("node"), F.lit(2.0).alias("_up"))
    callees = e.filter(F.col("src") == node).select(F.col("dst").alias("node"), F.lit(1.8).alias("_down"))
    s = scope.join(callers, "node", "left").join(callees, "node", "left")
    return s.select("node", "layer", F.round(F.exp(-0.5 * F.col("gap")) * F.coalesce("_up", "_down", F.lit(1.0)), 6).alias("score"))


def cycles_members(edges: DataFrame) -> DataFrame:
    """node, component, size of the components in which something depends on itself through others."""
    c = scc(edges)
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return c.join(n, "component").select("node", "component", "size")


def cycles(edges: DataFrame, longest: int = 6) -> DataFrame:
    """Simple cycles of 2 to ``longest`` nodes, each once, from its least node on: path (array), length."""
    inside = scc(edges)
    e = edges_of(edges).filter("src <> dst").distinct()
    e = e.join(inside.toDF("src", "_a"), "src").join(inside.toDF("dst", "_b"), "dst").filter("_a = _b").select("src", "dst")
    e = cut(e)
    paths, found = e.filter("src < dst").select(F.array("src", "dst").alias("path")), None
    for n in range(2, longest + 1):
        last = F.element_at("path", -1)
        back = paths.join(e, (last == F.col("src")) & (F.element_at("path", 1) == F.col("dst")), "left_semi").select("path", F.lit(n).alias("length"))
        found = back if found is None else found.unionByName(back)
        if n < longest:
            more = paths.join(e, last == F.col("src")).filter(F.col("dst") > F.element_at("path", 1)).filter(~F.array_contains("path", F.col("dst")))
            paths = cut(more.select(F.concat("path", F.array("dst")).alias("path")))
    return found


def layer_of(found: DataFrame, node: str) -> DataFrame:
    """A node's layer; of an unknown name that of the least node that ends in it, else contains it."""
    kind = F.when(F.col("node") == node, 0).when(F.col("node").endswith("." + node), 1).when(F.col("node").contains(node), 2)
    return found.select("node", "layer", kind.alias("_k")).filter("_k IS NOT NULL").orderBy("_k", "node").limit(1).select("node", "layer")


def layer_nodes(found: DataFrame, layer: int) -> DataFrame:
    return found.filter(F.col("layer") == layer).select("node")


def layer_info(found: DataFrame) -> DataFrame:
    """layer, layer_type, name, n_nodes."""
    return layer_types(found).select("layer", "layer_type", F.concat(F.initcap("layer_type"), F.lit(" layer "), F.col("layer").cast("string")).alias("name"), "n_nodes")


# -- communities ------------------------------------------------------------------


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, community after synchronous rounds on the undirected graph: the commonest label among the neighbours and the node itself, the least on ties."""
    e = edges_of(edges).filter("src <> dst")
    both = cut(e.unionByName(reverse(e)).distinct())
    now = nodes_of(both).withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(now, both["dst"] == now["node"]).select(F.col("src").alias("node"), "community").unionByName(now)
        n = votes.groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        best = n.groupBy("node").agg(F.max("n").alias("most"))
        now = cut(n.join(best, "node").filter("n = most").groupBy("node").agg(F.min("community").alias("community")))
    return now


def _move_nodes(src: list, dst: list, rounds: int = 20) -> dict:
    """Greedy modularity: nodes move to the neighbouring community of most gain, in order, then communities are nodes; undirected, edges of weight 1."""
    weight: dict = {}
    for a, b in {(min(a, b), max(a, b)) for a, b in zip(src, dst) if a != b}:
        weight.setdefault(a, {})[b] = weight.setdefault(b, {})[a] = 1.0
    label = {n: n for n in weight}
    now = weight
    while True:
        total = sum(sum(v.values()) for v in now.values())
        own = {n: n for n in now}
        degree = {n: sum(v.values()) for n, v in now.items()}
        held = dict(degree)
        moved = False
        for _ in range(rounds):
            still = True
            for n in sorted(now):
                to: dict = {}
                for m, w in now[n].items():
                    if m != n:
                        to[own[m]] = to.get(own[m], 0.0) + w
                held[own[n]] -= degree[n]
                gain = lambda c: to.get(c, 0.0) - held[c] * degree[n] / total  # noqa: B023, E731
                best = max(sorted({*to, own[n]}), key=lambda c: (gain(c), c == own[n]))  # noqa: B023
                held[best] += degree[n]
                if best != own[n]:
                    own[n], still, moved = best, False, True
            if still:
                break
        if not moved:
            break
        label = {n: own[c] for n, c in label.items()}
        merged: dict = {}
        for n, v in now.items():
            for m, w in v.items():
                row = merged.setdefault(own[n], {})
                row[own[m]] = row.get(own[m], 0.0) + w
        now = merged
    least: dict = {}
    for n, c in label.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in label.items()}


def communities(edges: DataFrame, nodes: DataFrame | None = None, method: str = "modularity", one_task: int = ONE_TASK) -> DataFrame:
    """node, community (its least node).  Nodes without edges are communities of their own; fewer than two nodes have none.

    ``modularity`` merges greedily in one task and takes at most ``one_task`` edges;
    ``labels`` propagates labels in distributed rounds, at any size.
    """
    e = cut(edges_of(edges).filter("src <> dst").distinct())
    kind = dict(e.dtypes)["src"]
    if method == "labels":
        found = label_propagation(e)
    elif e.count() > one_task:
        raise ValueError(f"modularity takes at most {one_task} edges; use method='labels'")
    else:

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = list(batches)
            if got:
                own = _move_nodes(*(pd.concat(got)[c].tolist() for c in ("src", "dst")))
                yield pd.DataFrame({"node": list(own), "community": list(own.values())})

        found = e.repartition(1).mapInPandas(solve, f"node {kind}, community {kind}")
    if nodes is not None:
        found = cut(found)
        lone = nodes.select("node").distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("community"))
        found = found.unionByName(lone)
    found = cut(found)
    return found if found.limit(2).count() == 2 else found.limit(0)


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, n_members, internal_edges, cohesion = internal / n (n - 1).  ``members``: node, community."""
    e = edges_of(edges).distinct()
    m = members.select("node", "community")
    inner = e.join(m.toDF("src", "c1"), "src").join(m.toDF("dst", "c2"), "dst").filter("c1 = c2").groupBy(F.col("c1").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    n = m.groupBy("community").agg(F.count(F.lit(1)).alias("n_members"))
    k, i = F.col("n_members"), F.coalesce("internal_edges", F.lit(0))
    return n.join(inner, "community", "left").select("community", "n_members", i.alias("internal_edges"), F.round(F.when(k > 1, i / (k * (k - 1))).otherwise(0.0), 6).alias("cohesion"))


def coupling(edges: DataFrame, members: DataFrame, threshold: float = 0.0) -> DataFrame:
    """community, other, edges, coupling: the share of a community's outgoing edges that goes to each other one."""
    e = edges_of(edges).distinct()
    m = members.select("node", "community")
    out = e.join(m.toDF("src", "community"), "src").join(m.toDF("dst", "other"), "dst").filter("community <> other").groupBy("community", "other").agg(F.count(F.lit(1)).alias("edges"))
    share = F.col("edges") / F.sum("edges").over(Window.partitionBy("community"))
    return out.withColumn("coupling", F.round(share, 6)).filter(F.col("coupling") >= threshold)


def god_nodes(edges: DataFrame, members: DataFrame, most: int = 3) -> DataFrame:
    """The nodes of highest total degree in each community: community, node, degree, rank."""
    d = degree_classes(edges, members).select("node", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    return members.select("node", "community").join(d, "node").withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)


def community_entries(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Members without a caller in their own community."""
    m = members.select("node", "community")
    inner = edges_of(edges).join(m.toDF("src", "c1"), "src").join(m.toDF("dst", "c2"), "dst").filter("c1 = c2").select(F.col("dst").alias("node")).distinct()
    return m.join(inner, "node", "left_anti")


def community_of(members: DataFrame, name: str) -> DataFrame:
    """A symbol's community; if the name is unknown, that of the least symbol that ends in it, else contains it."""
    kind = F.when(F.col("node") == name, 0).when(F.col("node").endswith("." + name), 1).when(F.col("node").contains(name), 2)
    return members.select("node", "community", kind.alias("_k")).filter("_k IS NOT NULL").orderBy("_k", "node").limit(1).select("node", "community")


def search_communities(members: DataFrame, pattern: str) -> DataFrame:
    """Communities with a member whose name contains the pattern, each once."""
    return members.filter(F.lower("node").contains(pattern.lower())).select("community").distinct()


CROSS_CUTTING, LAYERED = "config|error|exception|helper|log|middleware|util", "api|controller|dao|handler|model|repository|route|schema|service"


def community_types(members: DataFrame) -> DataFrame:
    low = F.lower(F.col("node").cast("string"))
    g = members.groupBy("community").agg(F.max(low.rlike(CROSS_CUTTING)).alias("x"), F.max(low.rlike(LAYERED)).alias("l"))
    return g.select("community", F.when(F.col("x"), "cross_cutting").when(F.col("l"), "layer").otherwise("functional").alias("community_type"))


# -- names ---------------------------------------------------------------------------


def resolve_names(calls: DataFrame, nodes: DataFrame, name: str = "name") -> DataFrame:
    """Each called name's node: the exact one, else one of that simple name, else one that ends in it; the least of several; null if none.

    All three are found through one equi-join on the last segment.
    """
    seg = F.element_at(F.split(F.col("_n"), r"\."), -1)
    known = nodes.select(F.col("node").cast("string").alias("_n")).distinct().withColumn("_seg", seg)
    wanted = calls.select(F.col(name).cast("string").alias("_w")).distinct().withColumn("_seg", F.element_at(F.split("_w", r"\."), -1))
    kind = F.when(F.col("_n") == F.col("_w"), 0).when(~F.col("_w").contains("."), 1).when(F.expr("endswith(_n, concat('.', _w))"), 2)
    hits = wanted.join(known, "_seg").withColumn("_k", kind).filter("_k IS NOT NULL").groupBy("_w").agg(F.min(F.struct("_k", "_n")).alias("_b"))
    return wanted.join(hits, "_w", "left").select(F.col("_w").alias("name"), F.col("_b._n").alias("resolved"), F.element_at(F.create_map(F.lit(0), F.lit("exact"), F.lit(1), F.lit("simple"), F.lit(2), F.lit("suffix")), F.col("_b._k")).alias("how"))


def fuzzy(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose name ends in ``.text``; if there are none, those that contain it."""
    n = nodes.select("node").distinct().withColumn("_s", F.col("node").endswith("." + text)).filter(F.col("_s") | F.col("node").contains(text))
    some = n.agg(F.max("_s").alias("_any"))
    return n.join(F.broadcast(some)).filter(F.col("_s") | ~F.col("_any")).select("node")

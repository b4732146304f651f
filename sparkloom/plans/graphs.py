"""Graph analytics over the succession of links on pages, and over suppliers and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.sources.tables import cut, table

from .base import query

START = "/the"

_LINKS_SQL = """
links AS (SELECT DISTINCT src, dst FROM (
  SELECT h[i] AS src, h[i + 1] AS dst FROM (SELECT h, unnest(range(1, len(h))) AS i FROM (SELECT regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS h FROM pages) WHERE len(h) > 1)) WHERE src IS NOT NULL AND dst IS NOT NULL)"""
_NODES_SQL = "nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links)"


def links(spark: SparkSession, d: str) -> DataFrame:
    """Each link on a page points to the next one on it."""
    h = table(spark, d, "pages").select(F.expr("regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)").alias("h")).filter("size(h) > 1")
    pairs = h.select(F.explode(F.arrays_zip(F.expr("slice(h, 1, size(h) - 1)").alias("src"), F.expr("slice(h, 2, size(h) - 1)").alias("dst"))).alias("p"))
    return pairs.select("p.src", "p.dst").distinct()


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(START,)], "node string")


def _hop_sql(depth: int, back: bool) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""WITH RECURSIVE {_LINKS_SQL},
r(node, depth) AS (SELECT '{START}', 0 UNION SELECT l.{b}, depth + 1 FROM r JOIN links l ON l.{a} = r.node WHERE depth < {depth})
SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node HAVING min(depth) > 0"""


@query("callees_k", _hop_sql(2, False))
def callees_k(spark: SparkSession, d: str) -> DataFrame:
    return G.k_hop(links(spark, d), _start(spark), 2)


@query("callers_k", _hop_sql(2, True))
def callers_k(spark: SparkSession, d: str) -> DataFrame:
    return G.k_hop(G.reverse(links(spark, d)), _start(spark), 2)


IMPACT_SQL = f"""WITH RECURSIVE {_LINKS_SQL},
down(node, depth) AS (SELECT '{START}', 0 UNION SELECT l.dst, depth + 1 FROM down JOIN links l ON l.src = down.node WHERE depth < 40),
up(node, depth) AS (SELECT '{START}', 0 UNION SELECT l.src, depth + 1 FROM up JOIN links l ON l.dst = up.node WHERE depth < 40),
both_ AS (SELECT node, 'upstream' AS direction, min(depth)::BIGINT AS depth FROM up GROUP BY node UNION ALL SELECT node, 'downstream', min(depth)::BIGINT FROM down GROUP BY node)
"""


@query("impact_closure", IMPACT_SQL + "SELECT * FROM both_ WHERE depth > 0")
def impact_closure(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(links(spark, d), START)


@query("impact_summary", IMPACT_SQL + "SELECT direction, count(*)::BIGINT AS symbols, max(depth)::BIGINT AS deepest FROM both_ WHERE depth > 0 GROUP BY direction")
def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.impact(links(spark, d), START).groupBy("direction").agg(F.countDistinct("node").alias("symbols"), F.max("depth").alias("deepest"))


@query(
    "impact_files",
    IMPACT_SQL + """, f AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS node FROM pages)
SELECT url, count(DISTINCT node)::BIGINT AS affected FROM f JOIN both_ USING (node) WHERE direction = 'upstream' AND depth = 1 GROUP BY url""",
)
def impact_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages that hold a direct caller of the node."""
    near = G.k_hop(G.reverse(links(spark, d)), _start(spark), 1).select("node")
    on = table(spark, d, "pages").select("url", F.explode(F.expr("regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)")).alias("node"))
    return on.join(near, "node", "left_semi").groupBy("url").agg(F.countDistinct("node").alias("affected"))


@query(
    "graph_degree_classes",
    f"""WITH {_LINKS_SQL}, {_NODES_SQL}, i AS (SELECT dst AS node, count(*) AS n FROM links GROUP BY dst), o AS (SELECT src AS node, count(*) AS n FROM links GROUP BY src),
g AS (SELECT node, coalesce(i.n, 0)::BIGINT AS in_degree, coalesce(o.n, 0)::BIGINT AS out_degree FROM nodes LEFT JOIN i USING (node) LEFT JOIN o USING (node))
SELECT *, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'isolated' WHEN in_degree = 0 THEN 'entry' WHEN out_degree = 0 THEN 'leaf' ELSE 'inner' END AS kind FROM g""",
)
def graph_degree_classes(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_classes(links(spark, d))


@query(
    "supplier_part_degrees",
    """WITH e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), n AS (SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part),
g AS (SELECT node, (SELECT count(*) FROM e WHERE dst = node) AS i, (SELECT count(*) FROM e WHERE src = node) AS o FROM n)
SELECT CASE WHEN i = 0 AND o = 0 THEN 'isolated' WHEN i = 0 THEN 'entry' WHEN o = 0 THEN 'leaf' ELSE 'inner' END AS kind, count(*)::BIGINT AS nodes, sum(i + o)::BIGINT AS degree FROM g GROUP BY 1""",
)
def supplier_part_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    nodes = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).union(table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey")))
    return G.degree_classes(e, nodes).groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("in_degree") + F.col("out_degree")).alias("degree"))


@query("graph_stats", f"WITH {_LINKS_SQL}, {_NODES_SQL} SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM links)::BIGINT AS edges, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT dst FROM links))::BIGINT AS entries, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT src FROM links))::BIGINT AS leaves")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d))
    c = G.degree_classes(e).agg(F.count(F.lit(1)).alias("nodes"), F.sum((F.col("kind") == "entry").cast("long")).alias("entries"), F.sum((F.col("kind") == "leaf").cast("long")).alias("leaves"))
    return c.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges")))).select("nodes", "edges", "entries", "leaves")


_REACH_SQL = f"""WITH RECURSIVE {_LINKS_SQL}, {_NODES_SQL}, reach(a, b) AS (SELECT src, dst FROM links UNION SELECT r.a, l.dst FROM reach r JOIN links l ON l.src = r.b),
comp AS (SELECT n.node, least(n.node, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = n.node), n.node)) AS component FROM nodes n)"""


@query("scc_members", _REACH_SQL + " SELECT * FROM comp")
def scc_members(spark: SparkSession, d: str) -> DataFrame:
    return G.scc(links(spark, d))


@query("circular_dependencies", _REACH_SQL + ", n AS (SELECT component, count(*)::BIGINT AS size FROM comp GROUP BY component HAVING count(*) > 1) SELECT node, component, size FROM comp JOIN n USING (component)")
def circular_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return G.cycles_members(links(spark, d))


_LAYER_SQL = _REACH_SQL + """, dag AS (SELECT DISTINCT p.component AS a, q.component AS b FROM links JOIN comp p ON p.node = src JOIN comp q ON q.node = dst WHERE p.component <> q.component),
lv(component, layer) AS (SELECT DISTINCT component, 0::BIGINT FROM comp UNION SELECT a, layer + 1 FROM lv JOIN dag ON b = lv.component),
layers AS (SELECT node, comp.component, (SELECT max(layer) FROM lv WHERE lv.component = comp.component) AS layer FROM comp)"""


@query("dep_layers", _LAYER_SQL + " SELECT * FROM layers")
def dep_layers(spark: SparkSession, d: str) -> DataFrame:
    return G.layers(links(spark, d))


_WORDED = " ".join(f"WHEN bool_or(regexp_matches(lower(node), '{'|'.join(w.split())}')) THEN '{t}'" for t, w in G.LAYER_WORDS.items())


@query(
    "layer_types",
    _LAYER_SQL + f""", sz AS (SELECT layer, count(*)::BIGINT AS m, row_number() OVER (ORDER BY layer) AS i FROM layers GROUP BY layer),
g(i, grp, n) AS (SELECT i, 0::BIGINT, m FROM sz WHERE i = 1 UNION ALL SELECT s.i, CASE WHEN g.n >= 3 THEN g.grp + 1 ELSE g.grp END, CASE WHEN g.n >= 3 THEN s.m ELSE g.n + s.m END FROM g JOIN sz s ON s.i = g.i + 1),
merged AS (SELECT node, CASE WHEN (SELECT count(*) FROM sz) <= 2 THEN sz.i - 1 ELSE g.grp END AS layer FROM layers JOIN sz USING (layer) JOIN g USING (i))
SELECT layer, CASE {_WORDED} WHEN layer = 0 THEN 'foundation' ELSE 'unknown' END AS layer_type, count(*)::BIGINT AS n_nodes FROM merged GROUP BY layer""",
)
def layer_types(spark: SparkSession, d: str) -> DataFrame:
    return G.layer_types(G.merge_small_layers(cut(G.layers(links(spark, d)))))


_OWN_SQL = _LAYER_SQL + f", own AS (SELECT layer AS o FROM layers WHERE node = '{START}')"


@query("layer_scope", _OWN_SQL + " SELECT node, layer, abs(layer - o)::BIGINT AS gap FROM layers, own WHERE layer - o BETWEEN -1 AND 1")
def layer_scope(spark: SparkSession, d: str) -> DataFrame:
    return G.scope_nodes(cut(G.layers(links(spark, d))), START, "debugging")


@query(
    "scope_relevance",
    _OWN_SQL + f""", s AS (SELECT node, layer, abs(layer - o) AS gap FROM layers, own WHERE layer - o BETWEEN -1 AND 1)
SELECT node, layer, round(exp(-0.5 * gap) * CASE WHEN node IN (SELECT src FROM links WHERE dst = '{START}') THEN 2.0 WHEN node IN (SELECT dst FROM links WHERE src = '{START}') THEN 1.8 ELSE 1.0 END, 6) AS score FROM s ORDER BY score DESC, node LIMIT 50""",
)
def scope_relevance(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d))
    scope = G.scope_nodes(cut(G.layers(e)), START, "debugging")
    return G.relevance(scope, e, START).orderBy(F.desc("score"), "node").limit(50)


def _lpa_sql(rounds: int) -> str:
    out = f"WITH {_LINKS_SQL}, {_NODES_SQL}, both_ AS (SELECT src AS a, dst AS b FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst), r0 AS (SELECT DISTINCT a AS node, a AS community FROM both_)"
    for k in range(rounds):
        out += f""", v{k} AS (SELECT a AS node, community, count(*) AS n FROM (SELECT a, community FROM both_ JOIN r{k} ON r{k}.node = b UNION ALL SELECT node, community FROM r{k}) GROUP BY ALL),
r{k + 1} AS (SELECT node, community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS x FROM v{k}) WHERE x = 1)"""
    return out + f" SELECT * FROM r{rounds}"


@query("lpa_communities", _lpa_sql(4))
def lpa_communities(spark: SparkSession, d: str) -> DataFrame:
    return G.label_propagation(links(spark, d), 4)


_MEMBERS_SQL = f"WITH {_LINKS_SQL}, {_NODES_SQL}, m AS (SELECT node, substr(lower(node), 2, 1) AS community FROM nodes)"


def _members(e: DataFrame) -> DataFrame:
    """A given membership: the initial of a path."""
    return G.nodes_of(e).withColumn("community", F.substring(F.lower("node"), 2, 1))


@query(
    "cohesion",
    _MEMBERS_SQL + """, i AS (SELECT a.community, count(*) AS n FROM links JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.community = b.community GROUP BY 1), s AS (SELECT community, count(*) AS k FROM m GROUP BY 1)
SELECT community, k::BIGINT AS n_members, coalesce(n, 0)::BIGINT AS internal_edges, round(CASE WHEN k > 1 THEN coalesce(n, 0)::DOUBLE / (k * (k - 1)) ELSE 0.0 END, 6)::DOUBLE AS cohesion FROM s LEFT JOIN i USING (community)""",
)
def cohesion(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d))
    return G.cohesion(e, _members(e))


@query(
    "coupling",
    _MEMBERS_SQL + """, x AS (SELECT a.community, b.community AS other, count(*) AS n FROM links JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.community <> b.community GROUP BY ALL)
SELECT * FROM (SELECT community, other, n::BIGINT AS edges, round(n::DOUBLE / sum(n) OVER (PARTITION BY community), 6) AS coupling FROM x) WHERE coupling >= 0.05""",
)
def coupling(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d))
    return G.coupling(e, _members(e), 0.05)


@query(
    "god_nodes",
    _MEMBERS_SQL + """, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) GROUP BY node)
SELECT * FROM (SELECT community, node, degree::BIGINT AS degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS rank FROM m JOIN g USING (node)) WHERE rank <= 3""",
)
def god_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d))
    return G.god_nodes(e, _members(e)).select("community", "node", "degree", "rank")


@query("community_entries", _MEMBERS_SQL + " SELECT node, community FROM m WHERE node NOT IN (SELECT dst FROM links JOIN m a ON a.node = src JOIN m b ON b.node = dst WHERE a.community = b.community)")
def community_entries(spark: SparkSession, d: str) -> DataFrame:
    e = cut(links(spark, d))
    return G.community_entries(e, _members(e))


@query("community_types", _MEMBERS_SQL + f" SELECT community, CASE WHEN bool_or(regexp_matches(lower(node), '{G.CROSS_CUTTING}')) THEN 'cross_cutting' WHEN bool_or(regexp_matches(lower(node), '{G.LAYERED}')) THEN 'layer' ELSE 'functional' END AS community_type FROM m GROUP BY community")
def community_types(spark: SparkSession, d: str) -> DataFrame:
    return G.community_types(_members(links(spark, d)))


_NAMES_SQL = """k AS (SELECT DISTINCT n, list_last(string_split(n, '.')) AS seg FROM (SELECT r_name || '.' || n_name AS n FROM nation JOIN region ON r_regionkey = n_regionkey)),
w AS (SELECT DISTINCT w, list_last(string_split(w, '.')) AS seg FROM (SELECT n_name AS w FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT r_name || '.' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'none.' || n_name FROM nation WHERE n_nationkey % 3 = 2))"""


@query(
    "name_resolution",
    f"""WITH {_NAMES_SQL}, h AS (SELECT w, n, CASE WHEN n = w THEN 0 WHEN NOT contains(w, '.') THEN 1 WHEN ends_with(n, '.' || w) THEN 2 END AS how FROM w JOIN k USING (seg)),
b AS (SELECT w, min((how, n)) AS b FROM h WHERE how IS NOT NULL GROUP BY w)
SELECT w.w AS name, b.b[2] AS resolved, CASE b.b[1] WHEN 0 THEN 'exact' WHEN 1 THEN 'simple' WHEN 2 THEN 'suffix' END AS how FROM w LEFT JOIN b USING (w)""",
)
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    full = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", F.concat_ws(".", "r_name", "n_name").alias("node"))
    third = F.col("n_nationkey") % 3
    calls = full.select(F.when(third == 0, F.col("n_name")).when(third == 1, F.col("node")).otherwise(F.concat(F.lit("none."), "n_name")).alias("name"))
    return G.resolve_names(calls, full)


@query("fuzzy_match", f"WITH {_LINKS_SQL}, {_NODES_SQL} SELECT node FROM nodes WHERE contains(node, 'tion') AND NOT EXISTS (SELECT 1 FROM nodes WHERE ends_with(node, '.tion')) OR ends_with(node, '.tion')")
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    return G.fuzzy(G.nodes_of(links(spark, d)), "tion")


@query(
    "graph_cycles",
    f"""WITH {_LINKS_SQL}, e AS (SELECT * FROM links WHERE src <> dst)
SELECT a.src || ' > ' || a.dst AS path, 2::INT AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || ' > ' || a.dst || ' > ' || b.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""",
)
def graph_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Circular dependencies of two and three nodes, listed."""
    return G.cycles(links(spark, d), 3).select(F.array_join("path", " > ").alias("path"), "length")


@query(
    "scoped_layer",
    "SELECT layer, count(*)::BIGINT AS nodes FROM (SELECT node, len(node) AS layer FROM (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS node FROM pages)) WHERE layer = (SELECT len(node) FROM (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS node FROM pages) WHERE contains(node, 'the') ORDER BY (CASE WHEN node = 'the' THEN 0 WHEN ends_with(node, '.the') THEN 1 ELSE 2 END), node LIMIT 1) GROUP BY layer",
)
def scoped_layer(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the layer that a name is in, found by part of it (layers are given: the lengths of names)."""
    found = G.nodes_of(links(spark, d)).unionByName(table(spark, d, "pages").select(F.explode(F.expr("regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)")).alias("node"))).distinct().withColumn("layer", F.length("node").cast("long"))
    own = G.layer_of(found, "the").select(F.col("layer").alias("own"))
    return found.join(F.broadcast(own), F.col("layer") == F.col("own")).groupBy("layer").agg(F.count(F.lit(1)).alias("nodes"))  # one row

"""Context assembly for a language model: token budgets and composed sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import graph as G
from sparkloom.sources.tables import cut

RATIOS = {"definition": 0.25, "dependency": 0.20, "relations": 0.25, "dataflow": 0.15, "community": 0.15}


@dataclass(frozen=True)
class Budget:
    total: int = 128_000
    reserve: int = 8_000
    margin: float = 0.1

    @property
    def available(self) -> int:
        return max(0, int((self.total - self.reserve) * (1 - self.margin)))

    def allocate(self, ratios: dict[str, float] = RATIOS) -> dict[str, int]:
        """Shares of what is available, largest ratio first; the last takes the remainder."""
        order = sorted(ratios.items(), key=lambda kv: -kv[1])
        out, left = {}, self.available
        for k, (name, r) in enumerate(order):
            out[name] = left if k == len(order) - 1 else min(left, int(self.available * r))
            left -= out[name]
        return out


def fit(rows: DataFrame, size: str, budget: int, order: list) -> DataFrame:
    """The rows, in order, that start within the budget, with what was left before each: running sums within ranges of the order, on top of the ranges before."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    parts = cut(rows.repartitionByRange(int(n), *order).withColumn("_part", F.spark_partition_id()))
    past = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_part").agg(F.sum(size).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(past.orderBy("_part")), F.lit(0)))  # a row a partition
    near = parts.join(F.broadcast(sums.filter(F.col("_base") < budget).select("_part", "_base")), "_part")
    before = F.col("_base") + F.coalesce(F.sum(size).over(past.partitionBy("_part").orderBy(*order)), F.lit(0))
    return near.withColumn("left_before", (budget - before).cast("long")).filter("left_before > 0").drop("_part", "_base")


def _names(df: DataFrame, most: int, title: str) -> DataFrame:
    top = df.orderBy("depth", "node").limit(most)
    text = F.concat(F.lit(title + " ("), F.count(F.lit(1)).cast("string"), F.lit("):\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: F.concat(F.lit("- "), x["node"])), "\n"))
    return top.agg(F.when(F.count(F.lit(1)) > 0, text).alias("text"))


def impact_context(edges: DataFrame, node: str, files: DataFrame | None = None, most: int = 10) -> DataFrame:
    """One row: what a change of the node may reach, as text.  ``files``: node, file_path."""
    found = G.impact(edges, node)
    up, down = found.filter("direction = 'upstream'"), found.filter("direction = 'downstream'")
    parts = [_names(up, most, "Upstream"), _names(down, most, "Downstream")]
    if files is not None:
        hit = files.join(found.select("node").distinct(), "node", "left_semi").select(F.col("file_path").alias("node"), F.lit(0).alias("depth")).distinct()
        parts.append(_names(hit, 1000, "Files"))
    out = parts[0].withColumnRenamed("text", "t0")
    for k, p in enumerate(parts[1:], 1):
        out = out.join(F.broadcast(p.withColumnRenamed("text", f"t{k}")))  # one row each
    return out.select(F.lit(node).alias("symbol"), F.concat_ws("\n\n", F.lit(f"# Impact of {node}"), *[f"t{k}" for k in range(len(parts))]).alias("context"))


def search_context(results: DataFrame, tokens: int, snippet: int = 500) -> DataFrame:
    """One row: results in rank order, as many as the budget holds (a token is four characters).  ``results``: rank, symbol_name, file_path, line_number, content."""
    block = F.concat(F.lit("## "), F.coalesce("symbol_name", F.lit("?")), F.lit(" ("), "file_path", F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("0")), F.lit(")\n"), F.substring(F.coalesce("content", F.lit("")), 1, snippet))
    rows = results.select("rank", block.alias("block")).withColumn("size", F.ceil(F.length("block") / 4))
    kept = fit(rows, "size", tokens, ["rank"])
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("results"))


def structured_context(symbol: str, symbols: DataFrame, edges: DataFrame, flows: DataFrame | None = None, members: DataFrame | None = None, budget: Budget | None = None, scope: DataFrame | None = None) -> DataFrame:
    """section, tokens, text: definition, dependencies, relations, data flow and community of a symbol.

    ``scope`` (node, layer, gap) is the layers that the purpose looks at; without it the
    dependencies are what the symbol uses.  Names in a section are as many as its share of
    the budget holds, at 30 tokens each (relations: 40).
    """
    share = (budget or Budget()).allocate()
    spark = symbols.sparkSession
    one = symbols.filter((F.col("qualified_name") == symbol) | (F.col("name") == symbol)).orderBy("qualified_name").limit(1)
    definition = one.agg(F.first(F.concat_ws("\n", F.concat_ws(" ", "symbol_type", "qualified_name"), "signature", F.concat_ws(":", "file_path", "line_number"))).alias("text"))
    start = spark.createDataFrame([(symbol,)], "node string")
    callees, callers = G.k_hop(edges, start, 1), G.k_hop(G.reverse(G.edges_of(edges)), start, 1)
    near = scope.filter(F.col("node") != symbol).select("node", F.col("gap").alias("depth")) if scope is not None else callees
    both = callers.select("node", F.lit(0).alias("depth")).unionByName(callees.select("node", F.lit(1).alias("depth")).join(callers.select("node"), "node", "left_anti")) if scope is not None else callers
    sections = {"definition": definition, "dependency": _names(near, max(5, share["dependency"] // 30), "Layers" if scope is not None else "Uses"), "relations": _names(both, max(5, share["relations"] // 40), "Calls" if scope is not None else "Used by")}
    if flows is not None:
        rows = flows.filter(F.col("sink").contains(symbol) | F.col("source").contains(symbol)).select(F.concat_ws(" -> ", "source", "sink").alias("node"), F.lit(0).alias("depth")).distinct()
        sections["dataflow"] = _names(rows, 8, "Data flow")
    if members is not None:
        own = members.filter(F.col("node") == symbol).select("community")
        sections["community"] = _names(members.join(own, "community", "left_semi").select("node", F.lit(0).alias("depth")), 6, "Community")
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.lit(share[name]).alias("tokens"), F.coalesce("text", F.lit("")).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out

"""Heuristic data flow in Python sources: parameters, outside inputs, validation, sanitising.

Texts are read once: those without any rule's word are passed over whole, the lines of the
others are exploded, and what a rule may take is written for the joins that follow.  Rules are
a small fixed table of substrings, so each line meets them as a chain of literals rather than
in a join, and patterns only run where a substring was found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import contains_any
from sparkloom.sources.tables import cut

_KINDS = "cli_args:sys.argv env_vars:environ.get,os.environ,os.getenv http_request:request user_input:input"
INPUTS = {p: k for k, ps in (x.split(":") for x in _KINDS.split()) for p in ps.split(",")}
FULL = ["marshmallow", "pydantic", "validator", ".validate"]
CLEANERS = ["bleach", "encode", "escape", "sanitize"]
OUTSIDE = sorted(set(INPUTS.values()))
TYPED = ["isinstance", "type(", "assert "]


def lines(files: DataFrame) -> DataFrame:
    """path, line_number, line (trimmed) of Python files."""
    py = files.filter(F.lower("path").rlike(r"\.pyi?$"))
    return py.select("path", F.posexplode(F.split("content", r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line_number"), F.trim("col").alias("line"))


def assign_target(line: Column) -> Column:
    """The first name before the first ``=``; null where it isn't one."""
    t = F.trim(F.substring_index(F.trim(F.substring_index(F.trim(F.substring_index(line, "=", 1)), ",", 1)), ":", 1))
    return F.when(line.contains("=") & t.rlike(r"^[\p{L}_]"), t)


def validated(line: Column) -> Column:
    """The variable that a line validates: in isinstance(x, ...), type(x) or x.validate...; null if none."""
    inst, kind, method = F.regexp_extract(line, r"isinstance\(([^,]*),", 1), F.regexp_extract(line, r"type\(([^)]*)\)", 1), F.regexp_extract(line, r"(\S+)\s*\.validate", 1)
    return F.when(F.trim(inst) != "", F.trim(inst)).when(F.trim(kind) != "", F.trim(kind)).when(method != "", method)


def level(line: Column) -> Column:
    return F.when(contains_any(line, FULL), "full").when(contains_any(line, TYPED), "type_check")


def marked(files: DataFrame) -> DataFrame:
    """The lines that a rule may take: path, line_number, target (of an assignment), kinds of input in it, washes, var and level (of a validation)."""
    line = F.col("line")
    some = lines(files.filter(contains_any(F.col("content"), [*INPUTS, *FULL, *TYPED, *CLEANERS])))
    kinds = F.array_distinct(F.filter(F.array(*[F.when(line.contains(p), F.lit(t)) for p, t in INPUTS.items()]), lambda x: x.isNotNull()))
    moves = line.contains("=") & contains_any(line, [*INPUTS, *CLEANERS])
    some = some.filter(moves | level(line).isNotNull())
    return some.select("path", "line_number", F.when(moves, assign_target(line)).alias("target"), kinds.alias("kinds"), contains_any(line, CLEANERS).alias("washes"), F.when(level(line).isNotNull(), validated(line)).alias("var"), level(line).alias("level"))


def nullable(annotation: Column) -> Column:
    a = F.coalesce(annotation, F.lit(""))
    return (a == "") | a.contains("None") | a.contains("Optional") | a.contains("?")


def flows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges source -> sink with transform, nullable, validation_level (of the last line that validates a variable in either) and sanitized."""
    f = symbols.filter("symbol_type = 'function'").select("qualified_name", "file_path", "line_number", "return_type", F.explode("parameters").alias("p"))
    params = f.select(
        F.concat_ws(".", "qualified_name", "p.name").alias("source"), F.col("qualified_name").alias("sink"), F.lit("pass_through").alias("transform"), "file_path", "line_number",
        F.coalesce("p.type_annotation", F.lit("")).alias("type_at_source"), F.coalesce("return_type", F.lit("")).alias("type_at_sink"), nullable(F.col("p.type_annotation")).alias("nullable"),
    )
    ln = cut(marked(files))
    ins = ln.filter("target IS NOT NULL").select("path", "line_number", "target", F.explode("kinds").alias("source"))
    inputs = ins.select("source", F.concat_ws(":", "path", "target").alias("sink"), F.lit("input").alias("transform"), F.col("path").alias("file_path"), "line_number", F.lit("").alias("type_at_source"), F.lit("").alias("type_at_sink"), F.lit(True).alias("nullable"))
    edges = params.unionByName(inputs).withColumn("line_number", F.col("line_number").cast("int"))
    checks = ln.filter("var IS NOT NULL AND level IS NOT NULL").select("path", "line_number", "var", "level")
    washes = ln.filter("washes AND target IS NOT NULL").select("path", F.col("target").alias("var")).distinct()
    hit = F.contains(F.col("e.sink"), F.col("c.var")) | F.contains(F.col("e.source"), F.col("c.var"))
    on = lambda c: (F.col("e.file_path") == F.col("c.path")) & hit  # noqa: E731, ARG005
    keys = ["source", "sink", "transform", "file_path", "line_number"]
    e = edges.alias("e")
    best = e.join(checks.alias("c"), on(None)).groupBy(*[F.col(f"e.{k}").alias(k) for k in keys]).agg(F.max_by("c.level", "c.line_number").alias("validation_level"))
    clean = e.join(washes.alias("c"), on(None)).select(*[F.col(f"e.{k}").alias(k) for k in keys]).distinct().withColumn("sanitized", F.lit(True))
    out = edges.join(best, keys, "left").join(clean, keys, "left")
    return out.withColumn("validation_level", F.coalesce("validation_level", F.lit("none"))).withColumn("sanitized", F.coalesce("sanitized", F.lit(False)))


def trace_source(edges: DataFrame, sink: str) -> DataFrame:
    return edges.filter(F.col("sink").contains(sink))


def trace_sink(edges: DataFrame, source: str) -> DataFrame:
    return edges.filter(F.col("source").contains(source))


def unvalidated_inputs(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("source").isin(*OUTSIDE) & (F.col("validation_level") == "none"))


def nullable_flows(edges: DataFrame) -> DataFrame:
    return edges.filter("nullable")

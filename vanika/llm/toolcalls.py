"""Chat formatting: tool calls linked with their results, ordered, checked and written as canonical JSON.

All of it is DataFrame operations. Calls and results meet by identifier in one hash join, each row on its own: no
conversation is ever gathered, so a very long one costs no task more than others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanika.llm.common import cut

#: Per tool, its fields: JSON type (string, integer, number, boolean), required, least value (of a string: least length).
SCHEMAS: dict[str, dict[str, tuple[str, bool, int | None]]] = {
    "ask": {"text": ("string", True, 1), "turn": ("integer", True, 0), "chars": ("integer", True, 0)},
    "configure": {"text": ("string", True, 1), "turn": ("integer", True, 0), "chars": ("integer", False, 0)},
}

_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN"}


def levels(calls: DataFrame, after: DataFrame) -> DataFrame:
    """call_id, level of every call: 0 without a predecessor, else one more than its highest predecessor's; null on or behind a cycle.

    after: call_id, before; a predecessor that is no call is ignored, as are nulls. Where no call has two predecessors, each round
    doubles how far every call has looked back; else calls are taken away level by level.
    """
    known = calls.select("call_id").filter("call_id IS NOT NULL").distinct()
    edges = after.select("call_id", "before").filter("call_id IS NOT NULL").distinct()
    edges = cut(edges.join(known.withColumnRenamed("call_id", "before"), "before", "left_semi").select("call_id", "before"), "call_edges")
    count = edges.agg(F.count("*").alias("n"), F.countDistinct("call_id").alias("k")).first()
    if not count["n"]:
        return known.withColumn("level", F.lit(0).cast("long"))
    state = _doubled(edges, count["n"]) if count["n"] == count["k"] else _peeled(known, edges)
    # A call without a row in state has no predecessor.
    return known.join(state.withColumn("found", F.lit(True)), "call_id", "left").select("call_id", F.when(F.col("found"), F.col("level")).otherwise(0).cast("long").alias("level"))


def _doubled(edges: DataFrame, n: int) -> DataFrame:
    state = edges.select("call_id", F.col("before").alias("at"), F.lit(1).cast("long").alias("level"))
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        back = state.select(F.col("call_id").alias("at"), F.col("at").alias("further"), F.col("level").alias("more"))
        state = cut(state.join(back, "at", "left").select("call_id", F.col("further").alias("at"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "call_levels")
        if state.filter("at IS NOT NULL").isEmpty():
            break
    return state.select("call_id", F.when(F.col("at").isNull(), F.col("level")).alias("level"))


def _peeled(known: DataFrame, edges: DataFrame) -> DataFrame:
    done = cut(known.join(edges, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")), "call_levels")
    while True:
        left = edges.join(done.select("call_id"), "call_id", "left_anti")
        tried = left.join(done.withColumnRenamed("call_id", "before"), "before", "left").groupBy("call_id").agg(F.max("level").alias("level"), F.count("*").alias("n"), F.count("level").alias("k"))
        new = cut(tried.filter("n = k").select("call_id", F.col("level") + 1), "call_levels").toDF("call_id", "level")
        if new.isEmpty():
            return done.unionByName(left.select("call_id").distinct().withColumn("level", F.lit(None).cast("long"))).join(edges, "call_id", "left_semi")
        done = cut(done.union(new), "call_levels")


def violations(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool, int | None]]]) -> Column:
    """What in a call's arguments (JSON text) its tool's schema doesn't allow, as sorted texts; none: an empty array."""
    parsed = F.try_parse_json(arguments)
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        found = []
        for key, (kind, required, least) in sorted(fields.items()):
            path = f"$.{key}"
            there = F.array_contains(keys, key)
            kind_ok = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).rlike(f"^{_TYPES[kind]}$")
            wrong = F.when(~there, F.lit(f"missing {key}") if required else None).when(~kind_ok, F.lit(f"type {key}"))
            if least is not None:
                size = F.length(F.try_variant_get(parsed, path, "string")) if kind == "string" else F.try_variant_get(parsed, path, "double")
                wrong = wrong.when(size < least, F.lit(f"range {key}"))
            found.append(wrong)
        unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, fields))), lambda k: F.concat(F.lit("unknown "), k))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), unknown)).otherwise(out)
    return F.array_sort(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), out).otherwise(F.array(F.lit("not an object"))))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool, int | None]]] = SCHEMAS) -> DataFrame:
    """A row per call and per orphan result: call_id, name, status, n_calls, n_results, level, valid, errors, message.

    calls: call_id, name, arguments (JSON text), after (call_ids that come before it); results: call_id, content. status: linked,
    pending (no result), orphan (a result whose call_id no call has, nulls too). Of several calls or results of one identifier the
    least by content is taken; n_calls and n_results count them all. level orders calls so that predecessors come first.
    errors joins what the arguments violate by ';'. message is canonical JSON: keys sorted at every depth, no blanks, nulls written. Other
    columns are ignored.
    """
    one = calls.filter("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("name", "arguments", "after")).alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls")
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.count("*").alias("n_results")).withColumn("answered", F.lit(True))
    one = cut(one, "calls")
    order = levels(one, one.select("call_id", F.explode("after").alias("before")))
    both = one.withColumn("called", F.lit(True)).join(order, "call_id", "left").join(answers, "call_id", "full_outer")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered"), "linked").otherwise("pending")
    errors = F.when(F.col("called"), F.array_join(violations(F.col("name"), F.col("arguments"), schemas), ";"))
    both = both.withColumn("status", status).withColumn("errors", errors).withColumn("valid", F.col("errors") == "")
    arguments = F.try_parse_json("arguments")
    message = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), "level", "name", F.col("content").alias("result"), "status"), {"ignoreNullFields": "false"})
    return both.select("call_id", "name", "status", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "level", "valid", "errors", message.alias("message"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    An assistant's turn is the result of the call with its turn's predecessor as identifier; any other turn is a call: of
    configure if its role is system, else of ask. A call comes after the later of the two turns before it that is a call. A null text is empty;
    a null conv_id or turn is written as null in identifiers.
    """
    def ident(k: int) -> Column:
        return F.concat_ws("-", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.coalesce((F.col("turn") - k).cast("string"), F.lit("null")))

    text = F.coalesce("text", F.lit(""))
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    results = turns.filter(assistant).select(ident(1).alias("call_id"), text.alias("content"))
    arguments = F.to_json(F.struct(F.length(text).cast("long").alias("chars"), text.alias("text"), F.col("turn").cast("long").alias("turn")), {"ignoreNullFields": "false"})
    name = F.when(F.col("role") == "system", "configure").otherwise("ask")
    calls = turns.filter(~assistant).select(ident(0).alias("call_id"), name.alias("name"), arguments.alias("arguments"), ident(1).alias("p1"), ident(2).alias("p2"))
    # A turn before the last is a predecessor only where the last is no call.
    is_call = calls.select(F.col("call_id").alias("p1")).distinct().withColumn("last", F.lit(True))
    return calls.join(is_call, "p1", "left").select("call_id", "name", "arguments", F.array(F.when(F.col("last"), F.col("p1")).otherwise(F.col("p2"))).alias("after")), results


def link_conversations(turns: DataFrame) -> DataFrame:
    """link() of from_conversations()."""
    return link(*from_conversations(turns))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT coalesce(conv_id::VARCHAR, 'null') || '-' || coalesce(turn::VARCHAR, 'null') AS id,
         coalesce(conv_id::VARCHAR, 'null') || '-' || coalesce((turn - 1)::VARCHAR, 'null') AS p1,
         coalesce(conv_id::VARCHAR, 'null') || '-' || coalesce((turn - 2)::VARCHAR, 'null') AS p2,
         turn, coalesce(role = 'assistant', false) AS answers, CASE WHEN role = 'system' THEN 'configure' ELSE 'ask' END AS name,
         coalesce(text, '') AS text FROM conversations),
calls AS (
  SELECT id, p1, p2, min(struct_pack(name := name,
    arguments := '{"chars":' || length(text) || ',"text":' || to_json(text)::VARCHAR || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}',
    empty := text = '')) AS c, count(*) AS m FROM t WHERE NOT answers GROUP BY 1, 2, 3),
results AS (SELECT p1 AS id, min(text) AS content, count(*) AS n FROM t WHERE answers GROUP BY 1),
edges AS (
  SELECT c.id, CASE WHEN a.id IS NOT NULL THEN a.id ELSE b.id END AS before
  FROM calls c LEFT JOIN calls a ON a.id = c.p1 LEFT JOIN calls b ON b.id = c.p2),
walk AS (
  SELECT id, 0 AS level FROM edges WHERE before IS NULL
  UNION ALL SELECT e.id, w.level + 1 FROM edges e JOIN walk w ON e.before = w.id),
j AS (
  SELECT coalesce(c.id, r.id) AS call_id, c.c.name AS name, c.c.arguments AS arguments, c.c.empty AS empty, c.id IS NOT NULL AS called, coalesce(c.m, 0) AS n_calls,
         w.level AS level, r.content AS content, coalesce(r.n, 0) AS n_results,
         CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NOT NULL THEN 'linked' ELSE 'pending' END AS status
  FROM calls c FULL OUTER JOIN results r ON c.id = r.id LEFT JOIN walk w ON w.id = c.id)
SELECT call_id, name, status, n_calls::BIGINT AS n_calls, n_results::BIGINT AS n_results, level::BIGINT AS level,
  CASE WHEN called THEN NOT empty END AS valid, CASE WHEN called THEN CASE WHEN empty THEN 'range text' ELSE '' END END AS errors,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(call_id)::VARCHAR || ',"level":' || coalesce(level::VARCHAR, 'null')
  || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS message
FROM j
"""

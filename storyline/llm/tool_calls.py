"""Tool calls joined to their results, put in order, validated and written as canonical JSON (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.session import cut_lineage

#: Schema type → kinds that a parsed value may have.
_KINDS = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN",
    "array": "ARRAY<.*", "object": "OBJECT<.*", "null": "VOID",
}


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping]) -> Column:
    """What is wrong with parsed ``arguments`` (a variant; null where they did not parse), as an array of texts.

    ``schemas`` maps a tool to ``properties`` (each with ``type`` and, if wanted, ``enum``, ``minimum``, ``maximum``,
    ``minLength``, ``maxLength``, ``pattern``), ``required`` and ``additionalProperties``. They become one expression.
    """
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    for tool, schema in schemas.items():
        out = F.when(name == tool, _tool_errors(arguments, schema)).otherwise(out)
    bad = F.when(arguments.isNull(), "arguments are no JSON").when(
        ~F.schema_of_variant(arguments).like("OBJECT%"), "arguments are no object"
    )
    return F.when(bad.isNotNull(), F.array(bad)).otherwise(out)


def _tool_errors(arguments: Column, schema: Mapping) -> Column:
    found = []
    fields = schema.get("properties", {})
    for field in schema.get("required", ()):
        found.append(F.when(F.try_variant_get(arguments, f"$['{field}']", "variant").isNull(), f"{field}: missing"))
    for field, rule in fields.items():
        value = F.try_variant_get(arguments, f"$['{field}']", "variant")
        text = F.try_variant_get(arguments, f"$['{field}']", "string")
        number = F.try_variant_get(arguments, f"$['{field}']", "double")
        kind = F.schema_of_variant(value)
        wrong = None
        if "type" in rule:
            wrong = F.when(~kind.rlike(f"^({_KINDS[rule['type']]})$"), f"{field}: no {rule['type']}")
        tests = []
        if "enum" in rule:
            tests.append((~text.isin(list(rule["enum"])), "not among the values"))
        if "minimum" in rule:
            tests.append((number < rule["minimum"], f"below {rule['minimum']}"))
        if "maximum" in rule:
            tests.append((number > rule["maximum"], f"above {rule['maximum']}"))
        if "minLength" in rule:
            tests.append((F.length(text) < rule["minLength"], f"shorter than {rule['minLength']}"))
        if "maxLength" in rule:
            tests.append((F.length(text) > rule["maxLength"], f"longer than {rule['maxLength']}"))
        if "pattern" in rule:
            tests.append((~text.rlike(rule["pattern"]), "not of the pattern"))
        for test, words in tests:
            said = F.lit(f"{field}: {words}")
            wrong = F.when(test, said) if wrong is None else F.coalesce(wrong, F.when(test, said))
        if wrong is not None:
            found.append(F.when(value.isNotNull(), wrong))
    errors = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if not schema.get("additionalProperties", True):
        names = F.map_keys(F.try_variant_get(arguments, "$", "map<string,variant>"))
        others = F.array_sort(F.filter(names, lambda k: ~k.isin(list(fields))))
        errors = F.concat(errors, F.transform(others, lambda k: F.concat(k, F.lit(": not in the schema"))))
    return errors


def call_levels(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, level, cyclic): by (level, place), a call comes after all calls in its ``after``.

    A conversation whose log has every call after what it needs keeps its log: its level is ``place``. In the others, the
    level is the length of the longest chain of needs. Calls with one need jump along their chains, twice as far each
    round, to the nearest call with none or several; only calls with several needs then take turns, in as many rounds as
    their own longest chain. Calls on a cycle, or after one, have a null level. Ids that no call of the conversation has
    are skipped.
    """
    ids = calls.groupBy("conv_id", "call_id").agg(F.min("place").alias("place"), F.flatten(F.collect_set("after")).alias("after"))
    ids = cut_lineage(ids)
    needs = ids.select("conv_id", "call_id", "place", F.explode("after").alias("need"))
    known = ids.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("need_place"))
    edges = cut_lineage(needs.join(known, ["conv_id", "need"]).distinct())
    odd = edges.filter("need_place >= place").select("conv_id").distinct()
    kept = ids.join(odd, "conv_id", "left_anti").select("conv_id", "call_id", F.col("place").cast("long").alias("level"))
    edges = edges.join(odd, "conv_id", "left_semi").select("conv_id", "call_id", "need")
    degrees = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("k"), F.max("need").alias("up"))
    nodes = cut_lineage(
        ids.join(odd, "conv_id", "left_semi").select("conv_id", "call_id").join(degrees, ["conv_id", "call_id"], "left")
        .withColumn("k", F.coalesce("k", F.lit(0)))
    )
    anchors = _jump(nodes)
    solved = nodes.filter("k = 0").select("conv_id", "call_id", F.lit(0).cast("long").alias("level"))
    several = nodes.filter("k > 1").select("conv_id", "call_id")
    waiting = cut_lineage(
        edges.join(several, ["conv_id", "call_id"], "left_semi").join(
            anchors.select("conv_id", F.col("call_id").alias("need"), "anchor", "far"), ["conv_id", "need"]
        )
    )
    while not waiting.isEmpty():
        reached = waiting.join(solved.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"], "left")
        ready = reached.groupBy("conv_id", "call_id").agg(
            F.max(F.col("level") + F.col("far") + 1).alias("level"), F.count("level").alias("n"), F.count("*").alias("of")
        )
        ready = cut_lineage(ready.filter("n = of").select("conv_id", "call_id", "level"))
        if ready.isEmpty():
            break
        solved = cut_lineage(solved.unionByName(ready))
        waiting = cut_lineage(waiting.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    levels = anchors.join(solved.withColumnRenamed("call_id", "anchor"), ["conv_id", "anchor"], "left").select(
        "conv_id", "call_id", (F.col("level") + F.col("far")).alias("level")
    )
    return kept.unionByName(levels).withColumn("cyclic", F.col("level").isNull())


def _jump(nodes: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, anchor, far): the nearest call up the chain that has not exactly one need, and its distance.

    ``nodes`` has the number of needs k and, for k = 1, the need ``up``. The anchor of a cycle is null.
    """
    ends = nodes.filter("k <> 1").select("conv_id", "call_id", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("far"))
    done, open_ = ends, nodes.filter("k = 1").select("conv_id", "call_id", "up", F.lit(1).cast("long").alias("far"))
    left = None
    while (n := open_.count()) and n != left:
        left = n
        settled = done.select("conv_id", F.col("call_id").alias("up"), "anchor", F.col("far").alias("rest"))
        further = open_.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("far").alias("rest"))
        near = cut_lineage(open_.join(settled, ["conv_id", "up"]).select("conv_id", "call_id", "anchor", (F.col("far") + F.col("rest")).alias("far")))
        open_ = cut_lineage(
            open_.join(further, ["conv_id", "up"]).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("far") + F.col("rest")).alias("far"))
        )
        done = cut_lineage(done.unionByName(near))
    rest = open_.select("conv_id", "call_id", F.lit(None).cast("string").alias("anchor"), "far")
    return done.unionByName(rest)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call, and one per result identifier that no call has.

    ``calls``: conv_id, call_id, name, arguments (JSON), after (array of call ids), place (in the log).
    ``results``: conv_id, call_id, content, place. Other columns are ignored.

    Returned: conv_id, call_id, level (see ``call_levels``), status (``linked``, ``open`` without a result, ``orphan``
    without a call), n_results, errors (array) and json: the call with its first result in one line, keys sorted, no
    spaces, nulls written. Of several results with one identifier the first in the log is linked and all are counted, so
    repeated calls and results never multiply; a repeated call repeats its row. A null conversation or identifier links
    with nothing: its call is open, its result an orphan. Empty tables give no rows.
    """
    first = results.groupBy("conv_id", "call_id").agg(
        F.min_by("content", F.struct("place", "content")).alias("content"), F.count("*").alias("n_results")
    )
    calls = calls.select("conv_id", "call_id", "name", "arguments", "after", "place")
    known = calls.select("conv_id", "call_id").distinct()
    orphans = first.join(known, ["conv_id", "call_id"], "left_anti")
    named = calls.filter("conv_id is not null and call_id is not null").withColumn(
        "after", F.coalesce("after", F.array().cast("array<string>"))
    )
    levels = call_levels(named)
    linked = calls.join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(
        levels, ["conv_id", "call_id"], "left"
    )
    parsed = F.try_parse_json("arguments")
    errors = argument_errors(F.col("name"), parsed, schemas)
    errors = F.concat(errors, F.when(F.col("cyclic"), F.array(F.lit("needs itself"))).otherwise(F.array().cast("array<string>")))
    line = F.to_json(
        F.struct(
            parsed.alias("arguments"), F.col("call_id").alias("call_id"), F.col("name").alias("name"),
            F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    status = F.when(F.col("n_results").isNull(), "open").otherwise("linked")
    of_calls = linked.select(
        "conv_id", "call_id", "level", status.alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        errors.alias("errors"), line.alias("json"),
    )
    line = F.to_json(
        F.struct(
            F.lit(None).cast("string").alias("arguments"), F.col("call_id").alias("call_id"),
            F.lit(None).cast("string").alias("name"), F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return of_calls.unionByName(orphans.select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("level"), F.lit("orphan").alias("status"), "n_results",
        F.array(F.lit("no such call")).alias("errors"), line.alias("json"),
    ))

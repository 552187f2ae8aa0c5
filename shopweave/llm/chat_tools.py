"""Tool calls in conversations: linked to their results, ordered, validated and written as canonical JSON.

A message of role `assistant` may hold {"tool_calls": [{"id", "name", "arguments": {...}, "after": [ids]}, ...]}; one of
role `tool` holds {"tool_call_id", "content"}. Calls and results are joined by conversation and identifier (a shuffled
hash join on both keys). A call's level is nought if it waits for no other call, else one more than the highest level
it waits for, found by rounds of joins that double the ways they follow. Arguments are checked against a table of
parameters (name, parameter, type, required, most). JSON is canonical: no spaces, keys in order, no null members.

All of it is column expressions and joins; nothing is gathered by conversation, so a conversation of any length is no hot
task. Defined cases: a call without result is `unanswered`, a result without call `orphan`; of calls or results that
share an identifier the first by turn and place (of equal rows any single one) is linked, the others are `repeated`; those
without conv_id or identifier are `unidentified`; ids waited for that do not exist
are a problem, those in a circle get no level; text that is no JSON, null or empty holds no calls. Very long texts are parsed like any other, in one row. Empty tables give
no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import saved, shared_dir

CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: What schema_of_variant says of values of each type of a parameter.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def calls_of(turns: DataFrame) -> DataFrame:
    """(conv_id, id, name, arguments, after, turn, place) of the calls in the messages."""
    parsed = turns.filter(F.col("role") == "assistant").filter(F.col("text").contains("tool_calls"))
    parsed = parsed.select("conv_id", "turn", F.posexplode(F.from_json("text", CALLS)["tool_calls"]).alias("place", "c"))
    return parsed.select("conv_id", "c.id", "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"), "turn", "place")


def results_of(turns: DataFrame) -> DataFrame:
    """(conv_id, id, content, turn) of the results in the messages."""
    parsed = turns.filter(F.col("role") == "tool").filter(F.expr("left(to_json(try_parse_json(text)), 1) = '{'"))
    parsed = parsed.select("conv_id", "turn", F.from_json("text", RESULT).alias("r"))
    return parsed.select("conv_id", F.col("r.tool_call_id").alias("id"), F.col("r.content").alias("content"), "turn")


def first_of(rows: DataFrame, folder: str, *order: str) -> DataFrame:
    """A written table of rows with column first: whether it is the first of its (conv_id, id), of equal ones any single one."""
    rest = [c for c in rows.columns if c not in ("conv_id", "id")]
    # Numbers are written before they are compared, so that both sides of the join have the same ones.
    rows = saved(rows.withColumn("_row", F.monotonically_increasing_id()), f"{folder}-numbered")
    by = F.struct(*order, "_row")
    least = rows.groupBy("conv_id", "id").agg(F.min(by).alias("_least"))
    return saved(rows.join(least, ["conv_id", "id"]).select("conv_id", "id", *rest, (by == F.col("_least")).alias("first")), folder)


def levels_of(calls: DataFrame, folder: str) -> DataFrame:
    """(conv_id, id, level) of calls (conv_id, id, after, distinct); level is null in and behind a circle.

    Every call holds pointers to calls it waits for, with the longest way to each, and the longest way known to a call that
    waits for none. A round replaces each pointer by what the call it points to holds, so ways double: rounds grow as the
    logarithm of the longest chain. Pointers left when ways are longer than there are calls run in circles. A round holds
    a row for each call and each ancestor as far away as the round reaches: as many as calls where calls wait for one other
    each, at most calls times the widest level of their conversation.
    """
    known = calls.select("conv_id", F.col("id").alias("dep"))
    way = calls.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("dep")).join(known, ["conv_id", "dep"])
    way = saved(way.select("conv_id", "id", "dep", F.lit(1).cast("long").alias("w")), f"{folder}/way-0")
    free = calls.select("conv_id", "id").join(way.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
    level = saved(free.withColumn("level", F.lit(0).cast("long")), f"{folder}/level-0")
    k, n = 0, calls.count()
    while not way.isEmpty() and 2**k <= 2 * n:
        k += 1
        reached = way.join(level.withColumnRenamed("id", "dep"), ["conv_id", "dep"]).select("conv_id", "id", (F.col("w") + F.col("level")).alias("level"))
        on = way.select("conv_id", F.col("id").alias("dep"), F.col("dep").alias("to"), F.col("w").alias("more"))
        far = way.join(on, ["conv_id", "dep"]).groupBy("conv_id", "id", F.col("to").alias("dep")).agg(F.max(F.col("w") + F.col("more")).alias("w"))
        level = saved(level.union(reached).groupBy("conv_id", "id").agg(F.max("level").alias("level")), f"{folder}/level-{k}")
        way = saved(far, f"{folder}/way-{k}")
    return level.join(way.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.col("level").cast("int"))


def problems_of(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """(conv_id, id, problems): what is wrong with the arguments, sorted; only calls with problems."""
    given = calls.withColumn("v", F.expr("try_parse_json(arguments)")).withColumn("object", F.expr("coalesce(startswith(schema_of_variant(v), 'OBJECT'), false)"))
    bad = given.filter("not object").select("conv_id", "id", F.lit("arguments: no object").alias("problem"))
    good = given.filter("object").select("conv_id", "id", "name", "v")
    tools = parameters.select(F.col("name").alias("tool")).distinct()
    unknown = calls.join(F.broadcast(tools), F.col("name").eqNullSafe(F.col("tool")), "left_anti").select("conv_id", "id", F.lit("name: unknown").alias("problem"))
    pairs = calls.sparkSession.sql(
        """select conv_id, id, name, e.key as parameter, schema_of_variant(e.value) as kind, to_json(e.value) as shown
        from {good}, lateral variant_explode(v) as e""",
        good=good,
    )
    # The table of parameters is what a program offers as tools: its size is checked.
    listed = parameters.select("name", "parameter", "type", "required", "most")
    if listed.count() <= 100_000:
        listed = F.broadcast(listed)
    matched = pairs.join(listed, ["name", "parameter"], "left")
    fits = " or ".join(f"(type = '{t}' and ({' or '.join(f"startswith(kind, '{k}')" for k in kinds)}))" for t, kinds in TYPES.items())
    # A number is whole by its value: canonical JSON writes 1.0 as 1.
    fits += " or (type = 'integer' and startswith(kind, 'DECIMAL') and try_cast(shown as decimal(38,9)) = floor(try_cast(shown as decimal(38,9))))"
    wrong = matched.select("conv_id", "id", F.expr(f"""case when type is null then concat(parameter, ': unknown')
        when not ({fits}) then concat(parameter, ': not ', type)
        when most is not null and try_cast(shown as double) > most then concat(parameter, ': too large') end""").alias("problem"))
    asked = good.select("conv_id", "id", "name").join(listed.filter("required").select("name", "parameter"), "name")
    missing = asked.join(pairs.filter("kind <> 'VOID'").select("conv_id", "id", "parameter"), ["conv_id", "id", "parameter"], "left_anti")
    missing = missing.select("conv_id", "id", F.concat("parameter", F.lit(": missing")).alias("problem"))
    known = calls.select("conv_id", F.col("id").alias("dep"))
    lost = calls.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("dep")).join(known, ["conv_id", "dep"], "left_anti")
    lost = lost.select("conv_id", "id", F.concat(F.lit("after: "), F.coalesce("dep", F.lit("null"))).alias("problem"))
    every = bad.union(unknown).union(wrong.filter("problem is not null")).union(missing).union(lost)
    return every.groupBy("conv_id", "id").agg(F.array_join(F.array_sort(F.collect_set("problem")), "; ").alias("problems"))


def link(calls: DataFrame, results: DataFrame, parameters: DataFrame) -> DataFrame:
    """(conv_id, call_id, name, turn, level, status, valid, problems, record) of every call and every unlinked result."""
    folder = shared_dir(calls.sparkSession)
    nameless = lambda rows: rows.filter("conv_id is null or id is null").select("conv_id", "id", "turn")
    lost = nameless(calls).union(nameless(results))
    calls = first_of(calls.dropna(subset=["conv_id", "id"]), f"{folder}/calls", "turn", "place")
    results = first_of(results.dropna(subset=["conv_id", "id"]), f"{folder}/results", "turn")
    one = calls.filter("first").drop("first")
    answers = results.filter("first").select("conv_id", "id", "content", F.col("turn").alias("answered"))
    rows = one.join(answers.hint("shuffle_hash"), ["conv_id", "id"], "left")
    rows = rows.join(levels_of(one, folder), ["conv_id", "id"], "left").join(problems_of(one, parameters), ["conv_id", "id"], "left")
    record = F.to_json(F.struct(F.expr("try_parse_json(arguments)").alias("arguments"), "id", "name", F.col("content").alias("result")))
    linked = rows.select(
        "conv_id", F.col("id").alias("call_id"), "name", "turn", "level",
        F.when(F.col("answered").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("problems").isNull().alias("valid"), F.coalesce("problems", F.lit("")).alias("problems"), record.alias("record"),
    )

    def other(rows: DataFrame, status: str) -> DataFrame:
        null = lambda kind: F.lit(None).cast(kind)
        return rows.select("conv_id", F.col("id").alias("call_id"), null("string").alias("name"), "turn", null("int").alias("level"), F.lit(status).alias("status"), F.lit(False).alias("valid"), F.lit("").alias("problems"), null("string").alias("record"))

    orphans = results.filter("first").join(one.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    repeated = calls.filter("not first").select("conv_id", "id", "turn").union(results.filter("not first").select("conv_id", "id", "turn"))
    return linked.union(other(orphans, "orphan")).union(other(repeated, "repeated")).union(other(lost, "unidentified"))


def link_messages(turns: DataFrame, parameters: DataFrame) -> DataFrame:
    """The calls and results in messages (conv_id, turn, role, text), linked."""
    turns = turns.select("conv_id", "turn", "role", "text")
    return link(calls_of(turns), results_of(turns), parameters)


#: Parameters of the tool that op4 reads conversations as calls of: name, parameter, type, required, most.
PARAMETERS = (("answer", "text", "string", True, None), ("answer", "words", "integer", True, 60.0))


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool use: a user's turn becomes a call of `answer` that waits for the user's turn two before it,
    an assistant's turn the result of the call one turn before."""
    turns = conversations.select("conv_id", "turn", "role", "text").dropna(subset=["conv_id", "turn"])
    name = lambda back: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    words = F.size(F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " "), ""))
    call = F.struct(
        name(0).alias("id"), F.lit("answer").alias("name"), F.struct(words.alias("words"), "text").alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(2))).alias("after"),
    )
    result = F.struct(name(1).alias("tool_call_id"), F.col("text").alias("content"))
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    told = turns.filter("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(result).alias("text"))
    return asked.union(told)


def op4_tool_links(spark, sf_dir: str) -> DataFrame:
    """All conversations, read as tool use."""
    parameters = spark.createDataFrame(list(PARAMETERS), "name string, parameter string, type string, required boolean, most double")
    return link_messages(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), parameters)


ORACLE = r"""
WITH RECURSIVE calls AS (
    SELECT conv_id, turn, conv_id || '-' || turn AS call_id, conv_id || '-' || (turn - 2) AS dep, text,
        len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS words
    FROM conversations WHERE role = 'user'
), results AS (
    SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
), levels(conv_id, turn, call_id, level) AS (
    SELECT conv_id, turn, call_id, 0 FROM calls c
    WHERE turn < 2 OR NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = c.conv_id AND d.call_id = c.dep)
    UNION ALL
    SELECT c.conv_id, c.turn, c.call_id, l.level + 1 FROM levels l JOIN calls c ON c.conv_id = l.conv_id AND c.dep = l.call_id AND c.turn >= 2
), judged AS (
    SELECT c.*, l.level, r.content, r.turn AS answered, concat_ws('; ',
        CASE WHEN c.turn >= 2 AND d.call_id IS NULL THEN 'after: ' || c.dep END,
        CASE WHEN c.words > 60 THEN 'words: too large' END) AS problems
    FROM calls c JOIN levels l USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id)
    LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.call_id = c.dep
)
SELECT conv_id, call_id, 'answer' AS name, turn, level::INTEGER AS level,
    CASE WHEN answered IS NULL THEN 'unanswered' ELSE 'linked' END AS status, problems = '' AS valid, problems,
    '{"arguments":{"text":' || to_json(text)::VARCHAR || ',"words":' || words || '},"id":"' || call_id || '","name":"answer"'
        || CASE WHEN answered IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || '}' AS record
FROM judged
UNION ALL
SELECT r.conv_id, r.call_id, NULL, r.turn, NULL, 'orphan', false, '', NULL
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
"""

"""Chat formatting with linked tool calls (native: DataFrame functions only).

Messages carry tool calls and tool results as JSON. Calls are joined with results by identifier,
ordered so that every call follows the calls whose results it cites and precedes its own result,
checked against the schemas of their tools, and written as canonical JSON: no white space, and the
keys of every object of arguments in alphabetical order. Nothing is lost: arguments that have no
such form are kept as they were written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelsieve.llm.common import Scratch

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>"
RESULT = "tool_call_id string, content string"

#: A schema says, for each tool, which arguments it takes: name, type (string, integer, number,
#: boolean, array, object) and whether it is required.
SCHEMA = "tool string, argument string, kind string, required boolean"

#: Calls of one turn that cite each other are ordered in one row up to so many citations, beyond by rounds of joins.
GROUPED_CITATIONS = 4_000

# The form of JSON values by type name.
FORMS = {
    "string": r'^".*"\z',
    "integer": r"^-?(0|[1-9][0-9]*)\z",
    "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z",
    "boolean": r"^(true|false)\z",
    "array": r"^\[(?s:.*)\]\z",
    "object": r"^\{(?s:.*)\}\z",
}


def _tokens(json: Column) -> Column:
    """Sorted tokens of a JSON text, its strings left empty. No pattern repeats a group, so long strings don't nest."""
    bare = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), r'"[^"]*"', '""')
    return F.array_sort(F.regexp_extract_all(bare, F.lit(r"[-+.0-9eE]+|\S"), F.lit(0)))


def canonical_object(json: Column) -> Column:
    """A JSON object with the keys of all objects sorted and without white space; null where it has no such form.

    That is what isn't JSON or no object, an object with a key twice at any depth, with text after it, or with a
    number that isn't kept digit by digit (exponents, over 38 digits, zeros at the end of a fraction).
    """
    made = F.to_json(F.try_parse_json(json))
    return F.when(F.ltrim(json).startswith("{") & (_tokens(json) == _tokens(made)), made)


def quoted(text: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def extract_calls(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, tool, arguments, after: one row for each call of an assistant's JSON."""
    called = messages.where("role = 'assistant' AND text LIKE '{%tool_calls%'").select("conv_id", "turn", F.from_json("text", CALLS).alias("m"))
    return called.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))


def extract_results(messages: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, content: one row for each tool message."""
    told = messages.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", RESULT).alias("m"))
    return told.select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), F.coalesce("m.content", F.lit("")).alias("content"))


def check_arguments(calls: DataFrame, schemas: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds canonical (the arguments) and errors: what they have against the tool's schema, as a sorted array.

    A tool without a schema is one error; so are arguments that are no object or have no canonical
    form, a missing required argument, one that the schema doesn't know and one of another type.
    """
    fields = F.collect_set(F.struct("argument", "kind", "required"))  # a schema: bounded
    # a written table: where it is small the engine broadcasts it
    per_tool = scratch.write(schemas.groupBy("tool").agg(fields.alias("fields")), "schemas")
    joined = calls.withColumn("canonical", canonical_object(F.col("arguments"))).join(per_tool, "tool", "left")
    joined = joined.withColumn("given", F.from_json("canonical", "map<string,variant>"))
    value = lambda f: F.coalesce(F.to_json(F.try_element_at("given", f["argument"])), F.lit("null"))
    wrong = lambda f: ~F.coalesce(_has_form(value(f), f["kind"]), F.lit(False))
    known = F.transform("fields", lambda f: f["argument"])
    missing = F.transform(F.filter("fields", lambda f: f["required"] & ~F.map_contains_key("given", f["argument"])), lambda f: F.concat(F.lit("missing "), f["argument"]))
    unknown = F.transform(F.array_except(F.map_keys("given"), known), lambda k: F.concat(F.lit("unknown "), k))
    other = F.transform(F.filter("fields", lambda f: F.map_contains_key("given", f["argument"]) & wrong(f)), lambda f: F.concat(f["argument"], F.lit(" is no "), f["kind"]))
    errors = F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool")))
    shape = F.when(F.col("arguments").rlike(r"^\s*\{") & F.try_parse_json("arguments").isNotNull(), "arguments have no canonical form").otherwise("arguments are no object")
    errors = errors.when(F.col("given").isNull(), F.array(shape)).otherwise(F.array_sort(F.concat(missing, unknown, other)))
    return joined.withColumn("errors", errors).drop("given", "fields")


def _has_form(json: Column, kind: Column) -> Column:
    form = F.lit(False)
    for name, pattern in FORMS.items():
        form = F.when(kind == name, json.rlike(pattern)).otherwise(form)
    return form


def order_calls(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds order_turn, depth and cyclic: sorted by (order_turn, depth), a call follows all it cites.

    order_turn is the latest turn among the call and all it cites, directly or not. Citations of earlier turns,
    however long their chain, are settled by that alone; it takes a round of joins for each link of a chain of
    citations of *later* turns. What is left are citations within an order_turn, as a rule of one
    message: depth is the longest chain of them, found in one row for a group, or by rounds for a
    group of over GROUPED_CITATIONS. Calls that lead to a cycle of them are cyclic, depth null.
    Identifiers that no call of the conversation has are passed by.
    """
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(F.min("turn").alias("order_turn")).where("order_turn IS NOT NULL")
    turns = scratch.write(known, "turns-0")
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("cited")).distinct()
    edges = edges.join(turns.select("conv_id", F.col("call_id").alias("cited")), ["conv_id", "cited"], "left_semi").join(turns.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    edges = scratch.write(edges, "citations")

    def placed(turns: DataFrame) -> DataFrame:
        """The citations with both order turns: own, then."""
        cited = turns.select("conv_id", F.col("call_id").alias("cited"), F.col("order_turn").alias("then"))
        return edges.join(cited, ["conv_id", "cited"]).join(turns.withColumnRenamed("order_turn", "own"), ["conv_id", "call_id"])

    rounds = 0
    while True:
        late = placed(turns).where("then > own").groupBy("conv_id", "call_id").agg(F.max("then").alias("then"))
        late = scratch.write(late, f"late-{rounds}")
        if not late.limit(1).count():
            break
        rounds += 1
        turns = scratch.write(turns.join(late, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("order_turn", "then").alias("order_turn")), f"turns-{rounds}")

    inner = scratch.write(placed(turns).where("own = then").select("conv_id", "own", "call_id", "cited"), "inner")
    sizes = scratch.write(inner.groupBy("conv_id", "own").agg(F.count("*").alias("n")), "inner-sizes")
    few = inner.join(sizes.where(F.col("n") <= GROUPED_CITATIONS), ["conv_id", "own"], "left_semi")
    many = inner.join(sizes.where(F.col("n") > GROUPED_CITATIONS), ["conv_id", "own"], "left_semi")
    depths = _grouped_depths(few)
    if sizes.where(F.col("n") > GROUPED_CITATIONS).limit(1).count():
        depths = depths.unionByName(_settled_depths(scratch.write(many, "many"), scratch))
    depths = scratch.write(depths, "depths")
    joined = calls.join(turns, ["conv_id", "call_id"], "left").join(depths, ["conv_id", "call_id"], "left")
    return joined.withColumn("cyclic", F.coalesce("cyclic", F.lit(False))).withColumn("depth", F.when(~F.col("cyclic"), F.coalesce("depth", F.lit(0))))


def _grouped_depths(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, depth, cyclic of citations (conv_id, own, call_id, cited), a row for each group.

    A call's depth is the longest walk from it along citations; after as many steps as there are calls only
    those that lead to a cycle have walks so long.
    """
    pairs = edges.groupBy("conv_id", "own").agg(F.collect_list(F.struct("call_id", "cited")).alias("e"))  # GROUPED_CITATIONS at most
    pairs = pairs.withColumn("names", F.array_sort(F.array_distinct(F.flatten(F.transform("e", lambda x: F.array(x["call_id"], x["cited"]))))))
    cites = F.transform("names", lambda name: F.transform(F.filter("e", lambda x: x["call_id"] == name), lambda x: F.array_position("names", x["cited"]).cast("int") - 1))
    pairs = pairs.withColumn("cites", cites)
    step = lambda walk, _: F.transform("cites", lambda c: F.coalesce(F.array_max(F.transform(c, lambda j: F.get(walk, j))) + 1, F.lit(0)))
    walks = F.aggregate(F.sequence(F.lit(1), F.size("names")), F.transform("names", lambda _: F.lit(0)), step)
    found = pairs.select("conv_id", F.size("names").alias("n"), F.inline(F.arrays_zip("names", walks.alias("depth"))))
    return found.toDF("conv_id", "n", "call_id", "depth").select("conv_id", "call_id", "depth", (F.col("depth") >= F.col("n")).alias("cyclic"))


def _settled_depths(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by rounds: each settles the calls whose cited calls are settled; those never settled are cyclic."""
    names = edges.select("conv_id", F.explode(F.array("call_id", "cited")).alias("call_id")).distinct()
    settled, turn = scratch.write(names.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)), "settled-0"), 0
    while True:
        turn += 1
        ready = edges.join(settled.select("conv_id", F.col("call_id").alias("cited"), "depth"), ["conv_id", "cited"], "left")
        ready = ready.groupBy("conv_id", "call_id").agg(F.max("depth").alias("d"), F.count_if(F.col("depth").isNull()).alias("open"))
        ready = ready.where("open = 0").join(settled, ["conv_id", "call_id"], "left_anti")
        new = scratch.write(ready.select("conv_id", "call_id", (F.col("d") + 1).alias("depth")), f"new-{turn}")
        if not new.limit(1).count():
            break
        settled = scratch.write(settled.unionByName(new), f"settled-{turn}")
    return names.join(settled, ["conv_id", "call_id"], "left").withColumn("cyclic", F.col("depth").isNull())


def link_tool_calls(messages: DataFrame, schemas: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each call, each result and each other message of (conv_id, turn, role, text).

    Returns conv_id, turn, kind (call, result, message), call_id, status, order_turn, depth,
    n_errors, json. A call is ``linked`` to the first result with its identifier in its
    conversation at a later turn, else ``unanswered``; a result is ``linked``, ``repeated`` (its
    call has an earlier one) or ``orphan``. Sorted by (conv_id, order_turn, depth, kind) calls
    stand after all that they cite and before their results. json is canonical; arguments without
    a canonical form are null there and kept as they were written as arguments_text. Calls without
    identifier are unanswered and results without one orphans; null texts are empty messages; an
    assistant's or a tool's text that isn't the JSON of calls or results is a message (a tool's:
    an orphan); calls that repeat an identifier share its result; rows with a null conv_id or turn
    link with nothing; other columns are ignored; an empty table gives no rows.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    calls = scratch.write(order_calls(check_arguments(extract_calls(messages), schemas, scratch), scratch), "calls")
    results = extract_results(messages)

    # the first result of each identifier; both sides keep their rows apart in the joins
    asked = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("asked"), F.min("order_turn").alias("order_turn"), F.min("depth").alias("depth"))
    answers = results.join(asked, ["conv_id", "call_id"], "left").withColumn("follows", F.coalesce(F.col("turn") > F.col("asked"), F.lit(False)))
    firsts = answers.where("follows").groupBy("conv_id", "call_id").agg(F.min("turn").alias("answered"))

    args = F.coalesce("canonical", F.concat(F.lit('null,"arguments_text":'), _text("arguments")))
    n_errors = F.size("errors").cast("long")
    call_rows = calls.join(firsts, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id",
        F.when(F.col("cyclic"), "cyclic").when(F.col("answered").isNotNull(), "linked").otherwise("unanswered").alias("status"),
        F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("depth"), n_errors.alias("n_errors"),
        _json(arguments=args, errors=F.concat(F.lit("["), F.array_join(F.transform("errors", quoted), ","), F.lit("]")), id=_text("call_id"), name=_text("tool"), type=F.lit('"call"')).alias("json"),
    )
    status = F.when(~F.col("follows"), "orphan").when(F.col("turn") == F.col("answered"), "linked").otherwise("repeated")
    result_rows = answers.join(firsts, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", status.alias("status"),
        F.greatest("turn", "order_turn").alias("order_turn"), (F.coalesce("depth", F.lit(-1)) + 1).alias("depth"), F.lit(0).cast("long").alias("n_errors"),
        _json(content=_text("content"), id=_text("call_id"), type=F.lit('"result"')).alias("json"),
    )
    is_call = (F.col("role") == "assistant") & F.col("text").like("{%tool_calls%") & (F.size(F.from_json("text", CALLS)["tool_calls"]) > 0)
    plain = messages.where(~F.coalesce(is_call | (F.col("role") == "tool"), F.lit(False))).select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit("message").alias("status"),
        F.col("turn").alias("order_turn"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("n_errors"),
        _json(content=_text("text"), role=_text("role"), type=F.lit('"message"')).alias("json"),
    )
    return call_rows.unionByName(result_rows).unionByName(plain)


def _text(column: str) -> Column:
    return F.coalesce(quoted(F.col(column)), F.lit("null"))


def _json(**fields: Column) -> Column:
    """An object of JSON values, in the order given."""
    parts = [F.concat(F.lit(f'{"," if i else ""}"{k}":'), v) for i, (k, v) in enumerate(fields.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def turns_as_tool_messages(turns: DataFrame) -> DataFrame:
    """Reads a plain conversation as tool use: a user's turn asks, the turn after it answers.

    A user turn becomes an assistant's message of two calls. ``reply`` takes the text and its length:
    a text of less than 60 characters stands for arguments that are no JSON, one of several lines gives its
    length as a string, and one without a comma gives a tone instead. ``check``, which has no
    schema where the text has several lines (it is ``audit`` then), cites the reply of its turn. A reply
    cites the one of the user turn before, or, without a comma, the one of the user turn after it, and
    its own check where the text says its first word again. An assistant turn becomes the result of the reply
    before it; one of several lines also that of its check, and one that says its first word again also
    that of the reply before. Other turns stay.
    """
    text = F.coalesce("text", F.lit(""))
    own = lambda back, kind="": F.concat_ws(":", "conv_id", (F.col("turn") - back).cast("string"), *([F.lit(kind)] if kind else []))
    first = F.substring_index(text, " ", 1)
    lines, comma = F.contains(text, F.lit("\n")), F.contains(text, F.lit(","))
    again = F.contains(F.substr(text, F.length(first) + 1), first) & (first != "")
    n = F.length(text)
    prompt = {"prompt": text}
    given = lambda **more: F.to_json(F.struct(*[c.alias(k) for k, c in (prompt | more).items()]))
    arguments = F.when(n < 60, F.col("text")).when(lines, given(length=n.cast("string"))).when(~comma, given(tone=F.lit("plain"))).otherwise(given(length=n))
    after = F.concat(F.array(F.when(comma, own(2)).otherwise(own(-2))), F.when(again, F.array(own(0, "check"))).otherwise(F.array().cast("array<string>")))
    call = lambda i, name, a, cited: F.struct(i.alias("id"), name.alias("name"), a.alias("arguments"), cited.alias("after"))
    check = call(own(0, "check"), F.when(lines, "audit").otherwise("check"), F.to_json(F.struct(own(0).alias("of"))), F.array(own(0)))
    calls = F.array(F.to_json(F.struct(F.array(call(own(0), F.lit("reply"), arguments, after), check).alias("tool_calls"))))
    result = lambda i, content: F.to_json(F.struct(i.alias("tool_call_id"), content.alias("content")))
    results = F.array(result(own(1), F.col("text")), F.when(lines, result(own(1, "check"), F.lit("ok"))), F.when(again, result(own(3), F.lit("again"))))
    role = F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role"))
    texts = F.when(F.col("role") == "user", calls).when(F.col("role") == "assistant", F.array_compact(results)).otherwise(F.array("text"))
    return turns.select("conv_id", "turn", role.alias("role"), F.explode(texts).alias("text"))

"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

A message with calls is an assistant's JSON text ``{"tool_calls": [{"id", "name",
"arguments"}]}``, one with a result is a tool's ``{"tool_call_id", "content"}``;
all other texts are plain messages. Arguments may use earlier results as
``{"$ref": id}``. Messages are rows throughout: conversations of any length are
joined on (conversation, identifier) and never gathered in one place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise

DEPTH = 1_000  # an object nested deeper is plain text, in a message and in a string of arguments alike

_TYPES = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
    "null": type(None),
}
_PARSED = (
    "conv_id bigint, turn bigint, kind string, result_of string, json string, row bigint, "
    "calls array<struct<id:string,name:string,error:string,refs:array<string>>>"
)


def canonical(value) -> str:
    """JSON with sorted keys and without blanks; equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value, schema: Mapping, at: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema of types, required keys, properties, items, enum and bounds."""
    kind = schema.get("type")
    if kind is not None and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind != "boolean"):
        return [f"{at}: not {kind}"]
    found = [f"{at}: not one of the values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        found += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{key}: missing" for key in schema.get("required", ()) if key not in value]
        for key in sorted(value):
            if key in known:
                found += violations(value[key], known[key], f"{at}.{key}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{key}: unknown")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            found += violations(item, schema["items"], f"{at}[{k}]")
    return found


def _resolved(value, refs: list[str]):
    """Collect the ids that arguments refer to, without recursion limits of deep JSON: a reference stands for any type."""
    todo = [value]
    while todo:
        here = todo.pop()
        if isinstance(here, dict):
            if set(here) == {"$ref"} and isinstance(here["$ref"], str):
                refs.append(here["$ref"])
            todo.extend(here.values())
        elif isinstance(here, list):
            todo.extend(here)
    return sorted(set(refs))


def _depth(text: str) -> int:
    """How deep the brackets of a JSON text are nested."""
    most = now = 0
    for bracket in re.findall(r"[\[\]{}]", re.sub(r'"(?:[^"\\]|\\.)*"', "", text, flags=re.S)):
        now += 1 if bracket in "[{" else -1
        most = max(most, now)
    return most


def _object(text: str):
    if not text.lstrip()[:1] == "{" or _depth(text) > DEPTH:
        return None
    try:
        value = json.loads(text, parse_constant=lambda name: name)
        canonical(value).encode()  # infinite numbers and lone surrogates have no canonical form
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def parse(role: str | None, text: str | None, tools: Mapping[str, Mapping]) -> tuple[str, str | None, dict, list[dict]]:
    """Kind of a message, the call it answers, its canonical content and its calls."""
    value = _object(text or "")
    plain = {"role": role, "content": text}
    if value is None:
        return "message", None, plain, []
    if isinstance(value.get("tool_calls"), list) and role == "assistant":
        calls = []
        for call in value["tool_calls"]:
            call = call if isinstance(call, dict) else {}
            name, arguments = call.get("name"), call.get("arguments")
            if isinstance(arguments, str):  # arguments are often JSON inside a string
                arguments = _object(arguments)
            call_id = call.get("id") if isinstance(call.get("id"), str) else None
            if call_id is None:
                error = "no id"
            elif not isinstance(name, str) or name not in tools:
                error = "unknown tool"
            else:
                error = "; ".join(violations(arguments, tools[name])) or None
            calls.append({
                "id": call_id, "name": name if isinstance(name, str) else None, "error": error,
                "refs": _resolved(arguments, []), "arguments": arguments,
            })
        shown = [{"id": c["id"], "name": c["name"], "arguments": c["arguments"]} for c in calls]
        return "call", None, {"role": role, "tool_calls": shown}, calls
    if isinstance(value.get("tool_call_id"), str) and role == "tool":
        return "result", value["tool_call_id"], {
            "role": role, "tool_call_id": value["tool_call_id"], "content": value.get("content"),
        }, []
    return "message", None, plain, []


def _parser(tools: Mapping[str, Mapping]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("kind", "result_of", "json", "calls")}
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                kind, result_of, content, calls = parse(role, text, tools)
                out["kind"].append(kind)
                out["result_of"].append(result_of)
                out["json"].append(canonical(content))
                out["calls"].append([{k: c[k] for k in ("id", "name", "error", "refs")} for c in calls])
            call = pa.struct([
                ("id", pa.string()), ("name", pa.string()), ("error", pa.string()), ("refs", pa.list_(pa.string())),
            ])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), pa.array(out["kind"], pa.string()),
                    pa.array(out["result_of"], pa.string()), pa.array(out["json"], pa.string()), batch.column("row"),
                    pa.array(out["calls"], pa.list_(call)),
                ],
                names=["conv_id", "turn", "kind", "result_of", "json", "row", "calls"],
            )

    return run


def _ordered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, id, at, depth) of every call: it comes after the results that it refers to.

    References go to calls of earlier turns, so there are no cycles; only calls
    that are logged before a result which they use move, and every round moves
    those one step further behind.
    """
    answered = results.groupBy("conv_id", F.col("result_of").alias("id")).agg(F.max("turn").alias("answer"))
    state = calls.join(answered, ["conv_id", "id"], "left").select(
        "conv_id", "id", "turn", "answer", F.struct(F.col("turn").alias("at"), F.lit(0).alias("depth")).alias("key")
    )
    state = materialise(state, "chat-order")
    refs = materialise(
        calls.select("conv_id", "turn", F.col("id").alias("user"), F.explode("refs").alias("id"))
        .join(state.select("conv_id", "id", F.col("turn").alias("of")), ["conv_id", "id"])
        .where("of < turn").select("conv_id", "user", "id"),
        "chat-refs",
    )
    while True:
        # A result stands behind its call and not before its own turn.
        own = F.struct(F.col("answer").alias("at"), F.lit(0).alias("depth"))
        behind = F.struct(F.col("key.at").alias("at"), (F.col("key.depth") + 1).alias("depth"))
        after = refs.join(state.withColumn("end", F.greatest(own, behind)), ["conv_id", "id"]).groupBy(
            "conv_id", F.col("user").alias("id")
        ).agg(F.max(F.struct(F.col("end.at").alias("at"), (F.col("end.depth") + 1).alias("depth"))).alias("least"))
        moved = state.join(after, ["conv_id", "id"], "left").select(
            "conv_id", "id", "turn", "answer", F.greatest("key", "least").alias("key"),
            F.coalesce(F.col("least") > F.col("key"), F.lit(False)).alias("moves"),
        )
        state = materialise(moved, "chat-order")
        if not state.where("moves").limit(1).count():
            return state.select("conv_id", "id", F.col("key.at").alias("at"), F.col("key.depth").alias("depth"))


def format_chat(messages: DataFrame, tools: Mapping[str, Mapping]) -> DataFrame:
    """One row for every row of ``messages`` (conv_id, turn, role, text).

    Result: conv_id, turn, at, depth, kind (message, call, result), n_calls,
    n_linked (calls with a result, or 1 for a result with its call), errors and
    the message as canonical JSON. Sorted by conv_id, at, depth and turn,
    messages are in topological order: results behind their calls, calls behind
    the results that they use.

    Of calls that share an id in a conversation the earliest turn counts and the
    others are errors, as are results without call, calls without result,
    references that do not go to an earlier call, unknown tools and arguments
    that break their tool's schema. Null conv_id or turn link with nothing and
    have a null place; null texts are messages with null content; repeated rows
    come back each; ties keep their turn. Other columns are not read.
    """
    source = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text",
        F.xxhash64("role", "text").alias("row"),
    )
    parsed = materialise(source.mapInArrow(_parser(tools), _PARSED), "chat-parsed")
    named = parsed.where("conv_id is not null and turn is not null")
    calls = named.select("conv_id", "turn", "row", F.posexplode("calls").alias("place", "c")).select(
        "conv_id", "turn", "row", "place", "c.id", "c.error", "c.refs"
    )
    calls = materialise(calls, "chat-calls")
    results = named.where("result_of is not null").select("conv_id", "turn", "row", "result_of")
    firsts = calls.where("id is not null").groupBy("conv_id", "id").agg(
        F.min(F.struct("turn", "row", "place", "refs")).alias("first")
    ).select("conv_id", "id", F.col("first.turn").alias("turn"), F.col("first.row").alias("row"),
             F.col("first.place").alias("place"), F.col("first.refs").alias("refs"))
    firsts = materialise(firsts, "chat-firsts")
    order = _ordered(firsts, results)

    answered = results.select("conv_id", F.col("result_of").alias("id")).distinct().withColumn("answered", F.lit(True))
    owner = firsts.select(
        "conv_id", "id", F.col("turn").alias("first_turn"), F.col("row").alias("first_row"),
        F.col("place").alias("first_place"),
    )
    # References that go to no earlier call.
    wild = (
        calls.select("conv_id", "turn", "row", "place", F.explode("refs").alias("id"))
        .join(owner.select("conv_id", "id", "first_turn"), ["conv_id", "id"], "left")
        .where("first_turn is null or first_turn >= turn")
        .select("conv_id", "turn", "row", "place").distinct().withColumn("wild", F.lit(True))
    )
    judged = (
        calls.join(owner, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left")
        .join(order, ["conv_id", "id"], "left").join(wild, ["conv_id", "turn", "row", "place"], "left")
    )
    first = (F.col("turn") == F.col("first_turn")) & (F.col("row") == F.col("first_row")) & (
        F.col("place") == F.col("first_place"))
    linked = F.coalesce(first & F.col("answered"), F.lit(False))
    error = F.concat_ws(
        "; ", "error",
        F.when(F.col("id").isNotNull() & ~first, "repeated id"),
        F.when(F.col("id").isNotNull() & first & F.col("answered").isNull(), "no result"),
        F.when(F.col("wild"), "reference to no earlier call"),
    )
    of_calls = judged.groupBy("conv_id", "turn", "row").agg(
        F.count_distinct("place").alias("n_calls"), F.count_distinct(F.when(linked, F.col("place"))).alias("n_linked"),
        F.max(F.when(first, F.struct("at", "depth"))).alias("key"),
        F.array_join(F.array_sort(F.collect_set(F.when(error != "", F.concat_ws(": ", F.col("place").cast("string"), error)))), "; ")
        .alias("errors"),
    )
    of_results = results.distinct().join(
        owner.join(order, ["conv_id", "id"]).withColumnRenamed("id", "result_of"), ["conv_id", "result_of"], "left"
    ).select(
        "conv_id", "turn", "row", F.lit(0).alias("n_calls"), F.col("first_turn").isNotNull().cast("int").alias("n_linked"),
        F.when(F.col("at") >= F.col("turn"), F.struct("at", (F.col("depth") + 1).alias("depth"))).alias("key"),
        F.when(F.col("first_turn").isNull(), "no call").otherwise("").alias("errors"),
    )
    notes = of_calls.unionByName(of_results)
    return parsed.join(notes, ["conv_id", "turn", "row"], "left").select(
        "conv_id", "turn", F.coalesce("key.at", "turn").alias("at"),
        F.when(F.col("turn").isNotNull(), F.coalesce(F.col("key.depth"), F.lit(0))).alias("depth"), "kind",
        F.coalesce("n_calls", F.size("calls")).cast("bigint").alias("n_calls"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), F.coalesce("errors", F.lit("")).alias("errors"),
        "json",
    )

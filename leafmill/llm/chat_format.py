"""Chat formatting: tool-call linking, ordering, argument checks and canonical JSON.

Messages are rows (conv_id, turn, role, text). A message whose text is a JSON object may carry
`tool_calls` ([{"id", "name", "arguments"}], name and arguments also in a `function`), and one with a `tool_call_id`
is a result. Fields of messages and calls that aren't named here are written through under `extra`. Calls and results are hash-joined by (conversation, identifier); a result is placed
directly after the message of its call, even if it was stored before it; a message with calls whose
arguments quote the identifier of another call (`"$ref:<id>"`) comes after that call's results, over
chains of any length. Arguments are checked against the tool's schema, nested objects and lists
included. Each message is written as canonical JSON: keys sorted by code point, no spaces, UTF-8,
every string escaped by the one writer `canonical`.

The order is a sortable key per message, so the messages of a conversation are never gathered in one
task; a writer that sorts by (conv_id, order_key) gets the transcript. The references of a
conversation (pairs of hashes and turns, no texts) are ranked in one task if they are at most
`TASK_REFERENCES`; those of larger ones are ranked by the same steps as joins over all executors.

Edge cases: null text is the empty string, a null role is `unknown`; text that isn't a JSON object,
or holds NaN, an infinite number, half a surrogate pair or more than `NESTING` levels, is plain
content, and arguments given as such a string stay a string (a fault);
a result without call is kept at its own place with status `orphan`; a call
without result is `unanswered`, one without identifier `unlinked`; results that share an identifier keep the order of their turns,
messages of one turn are ordered by a hash of the row; the first of several calls with one identifier
is linked, the others are `duplicate`; rows equal in all columns share a place and a status; references
within a cycle, or on a way from one cycle to another, don't count, so such
calls keep the order of turns, while messages outside still come after the calls they quote; a result
that has calls with references itself stands where these allow; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, read, small_batches

TYPES = {"string": str, "number": (int, float), "integer": int, "boolean": bool, "object": dict, "array": list, "null": type(None)}
NESTING, TASK_REFERENCES = 100, 500_000

MESSAGE = "conv_id long, turn long, role string, content string, calls array<struct<id:string,name:string,refs:array<string>,faults:array<string>,json:string>>, result_of string, parts array<string>"


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _refuse(_: str):
    raise ValueError("no JSON number")


def _finite(digits: str) -> float:
    x = float(digits)
    return x if math.isfinite(x) else _refuse(digits)


def load(text: str):
    """The value of a JSON text; ValueError if it is none, or none that can be written again."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
    except RecursionError:
        raise ValueError("too deep") from None
    level = [value]
    for _ in range(NESTING):
        strings = [v for v in level if isinstance(v, str)] + [k for v in level if isinstance(v, dict) for k in v]
        if any("\ud800" <= c <= "\udfff" for v in strings for c in v):
            raise ValueError("half a surrogate pair")
        level = [w for v in level if isinstance(v, dict | list) for w in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return value
    raise ValueError("too deep")


def _is(value, kind: str) -> bool:
    return isinstance(value, TYPES.get(kind, object)) and not (isinstance(value, bool) and kind in ("number", "integer"))


def _faults(value, schema: dict, path: str) -> list[str]:
    """Keywords of a schema that are null count as absent."""
    if isinstance(value, str) and value.startswith("$ref:"):
        return []  # known only when the quoted call is answered
    schema = {k: v for k, v in schema.items() if v is not None}
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"type of {path}"]
    found = []
    if "enum" in schema and not any(type(v) is type(value) and v == value for v in schema["enum"]):
        found.append(f"value of {path}")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        found.append(f"length of {path}")
    if _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        found.append(f"range of {path}")
    if isinstance(value, dict) and ("properties" in schema or "required" in schema):
        props = schema.get("properties", {})
        at = f"{path}." if path else ""
        found += [f"missing {at}{k}" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            found += _faults(v, props[k] or {}, f"{at}{k}") if k in props else [f"unknown {at}{k}"]
    if isinstance(value, list) and "items" in schema:
        found += [f for i, v in enumerate(value) for f in _faults(v, schema["items"], f"{path}[{i}]")]
    return found


def argument_faults(arguments, schema: dict | None) -> list[str]:
    """What is wrong with a call's arguments, sorted."""
    if schema is None:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    return sorted(_faults(arguments, {"properties": {}} | {k: v for k, v in schema.items() if v is not None}, ""))


def _refs(value) -> list[str]:
    if isinstance(value, str):
        return [value[5:]] if value.startswith("$ref:") else []
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for v in parts for r in _refs(v)]


def parse_call(call: dict, schemas: dict[str, dict]) -> dict:
    """A call with its JSON; name and arguments may stand in `function`, and what isn't named goes to `extra`."""
    call = dict(call)
    inner = call["function"] if isinstance(call.get("function"), dict) else {}
    inner = dict(inner)
    name, arguments = ((call if k in call else inner).pop(k, default) for k, default in (("name", ""), ("arguments", {})))
    own = call.pop("id", None)
    if isinstance(call.get("function"), dict):
        call["function"] = inner
        if not inner:
            del call["function"]
    if isinstance(arguments, str):
        try:
            arguments = load(arguments)
        except ValueError:
            pass
    name, own = _name(name), _name(own) if own is not None else None
    shown = {"arguments": arguments, "name": name} | ({"id": own} if own is not None else {}) | ({"extra": call} if call else {})
    return {"id": own, "name": canonical(name), "refs": sorted(set(_refs(arguments))), "faults": argument_faults(arguments, schemas.get(name)), "json": canonical(shown)}


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, str, list[dict], str | None, dict]:
    """(role, content, calls, identifier that it answers, fields that aren't named)."""
    role, text = role if role is not None else "unknown", text or ""
    try:
        body = load(text) if text.lstrip().startswith("{") else None
    except ValueError:
        body = None
    if not isinstance(body, dict):
        return role, text, [], None, {}
    said = body.pop("tool_calls", None)
    listed = said if isinstance(said, list) else []
    calls = [parse_call(c, schemas) for c in listed if isinstance(c, dict)]
    of = body.pop("tool_call_id", None)
    if not calls and of is None:
        return role, text, [], None, {}
    odd = [c for c in listed if not isinstance(c, dict)] if isinstance(said, list) else said
    if odd:
        body["tool_calls"] = odd
    content = body.pop("content", "")
    return role, content if isinstance(content, str) else canonical(content), calls, _name(of) if of is not None else None, body


def _name(value) -> str:
    return value if isinstance(value, str) else canonical(value)


def _parts(role: str, content: str, calls: list[dict], of: str | None, extra: dict) -> list[str | None]:
    """The message's JSON before and after the name of the tool it answers, which only the join tells."""
    head = ['"calls":[' + ",".join(c["json"] for c in calls) + "]"] if calls else []
    more = ['"extra":' + canonical(extra)] if extra else []
    tail = ['"role":' + canonical(role)] + (['"tool_call_id":' + canonical(of)] if of is not None else [])
    return [",".join([*head, '"content":' + canonical(content), *more]), ",".join(tail)]


def parse(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows of MESSAGE."""
    small_batches(messages.sparkSession)

    def run(batches):
        kinds = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("refs", pa.list_(pa.string())), ("faults", pa.list_(pa.string())), ("json", pa.string())]))
        for b in batches:
            got = [parse_message(r, t, schemas) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            role, content, calls, of, _ = zip(*got, strict=True) if got else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(role, pa.string()), pa.array(content, pa.string()), pa.array(calls, kinds), pa.array(of, pa.string()), pa.array([_parts(*g) for g in got], pa.list_(pa.string()))], names=["conv_id", "turn", "role", "content", "calls", "result_of", "parts"])

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, MESSAGE)


def link(messages: DataFrame, schemas: dict[str, dict], in_task: int = TASK_REFERENCES) -> DataFrame:
    """(conv_id, turn, role, order_key, status, n_calls, n_faults, json), one row for each message.

    status: plain, call, unanswered (a call of it has no result), duplicate (else, a call of it repeats
    an identifier), unlinked (else, a call of it has no identifier), linked (a result), orphan.
    order_key: the last turn it must not come before, its rank among what it refers to, its own turn.
    """
    node = F.xxhash64("turn", "role", "content", "calls", "result_of")
    rows = materialize(parse(messages, schemas), "messages").select("*", F.coalesce("conv_id", F.lit(-(2**63))).alias("conv"), node.alias("node"), F.coalesce("turn", F.lit(-1)).alias("own"))
    calls = rows.select("conv", "node", "own", F.posexplode("calls").alias("k", "c")).filter("c.id IS NOT NULL").select("conv", "node", "own", "k", F.col("c.id").alias("id"), F.col("c.name").alias("name"), F.col("c.refs").alias("refs"))
    first = calls.groupBy("conv", "id").agg(F.min(F.struct("own", "node", "k", "name")).alias("first"))
    first = materialize(first.select("conv", "id", F.col("first.node").alias("call_node"), F.col("first.own").alias("call_turn"), F.col("first.k").alias("call_k"), F.col("first.name").alias("call_name")), "calls")
    ranks = _ranks(rows, calls, first, in_task)
    # results by (conversation, identifier)
    joined = rows.join(first.drop("call_k").withColumnRenamed("id", "result_of"), ["conv", "result_of"], "left")
    answered = rows.filter("result_of IS NOT NULL").select("conv", F.col("result_of").alias("id")).distinct().withColumn("answered", F.lit(True))
    linked = first.join(answered, ["conv", "id"], "left")
    told = calls.join(linked, ["conv", "id"]).withColumn("is_first", (F.col("node") == F.col("call_node")) & (F.col("k") == F.col("call_k")))
    told = told.groupBy("conv", "node").agg(F.count(F.when(F.col("is_first") & F.col("answered").isNull(), 1)).alias("n_open"), F.count(F.when(~F.col("is_first"), 1)).alias("n_again"))
    joined = joined.join(told, ["conv", "node"], "left")
    # a message stands with its own calls, a result with its call's message unless its own calls quote others
    is_linked = F.col("call_turn").isNotNull()
    after = is_linked & ~F.exists("calls", lambda c: F.size(c["refs"]) > 0)
    joined = joined.withColumns({"place": F.when(after, F.col("call_node")).otherwise(F.col("node")), "base": F.when(after, F.col("call_turn")).otherwise(F.col("own"))})
    if ranks is not None:
        joined = joined.join(ranks.withColumnRenamed("node", "place"), ["conv", "place"], "left")
    else:
        joined = joined.withColumns({"at": F.lit(None).cast("long"), "rank": F.lit(None).cast("long")})
    joined = joined.withColumn("order_key", F.struct(F.coalesce("at", "base").alias("at"), F.coalesce("rank", F.lit(0)).alias("rank"), F.col("base").alias("turn"), after.cast("int").alias("after"), F.col("own").alias("own"), F.col("node").alias("row")))
    status = (
        F.when(is_linked, "linked").when(F.col("result_of").isNotNull(), "orphan")
        .when(F.size("calls") == 0, "plain").when(F.col("n_open") > 0, "unanswered").when(F.col("n_again") > 0, "duplicate")
        .when(F.exists("calls", lambda c: c["id"].isNull()), "unlinked").otherwise("call")
    )
    n_faults = F.aggregate("calls", F.lit(0).cast("long"), lambda a, c: a + F.size(c["faults"]))
    told = joined.select("conv_id", "turn", "role", "order_key", status.alias("status"), F.size("calls").cast("long").alias("n_calls"), n_faults.alias("n_faults"), _json().alias("json"))
    return told


def rank_references(turns: dict[int, int], needs: dict[int, set[int]]) -> dict[int, tuple[int, int]]:
    """node: (last turn among it and all it needs, length of the longest chain of needs).

    Nodes are taken off once all they need is. What can't be taken off so, and is needed by others of
    its kind, lies in cycles or between them: needs among these don't count.
    """
    left = {v: set(needs.get(v, ())) for v in turns}
    users: dict[int, list[int]] = {v: [] for v in turns}
    for v, ws in left.items():
        for w in ws:
            users[w].append(v)
    out: dict[int, tuple[int, int]] = {}

    def peel(ready: list[int]) -> None:
        while ready:
            v = ready.pop()
            done = [out[w] for w in needs.get(v, ()) if w in out]
            out[v] = max([turns[v], *(d[0] for d in done)]), max([0, *(d[1] + 1 for d in done)])
            for u in users[v]:
                left[u].discard(v)
                if not left[u] and u not in out:
                    ready.append(u)

    peel([v for v, ws in left.items() if not ws])
    core = set(turns) - set(out)
    n_users = {v: sum(u in core for u in users[v]) for v in core}
    free = [v for v, n in n_users.items() if not n]
    while free:
        v = free.pop()
        core.discard(v)
        for w in left[v]:
            n_users[w] -= 1
            if not n_users[w]:
                free.append(w)
    for v in core:
        done = [out[w] for w in needs[v] if w not in core]
        out[v] = max([turns[v], *(d[0] for d in done)]), max([0, *(d[1] + 1 for d in done)])
    for v in core:
        for u in users[v]:
            left[u].discard(v)
    peel([v for v, ws in left.items() if not ws and v not in out])
    return out


def _rank_by_joins(edges: DataFrame) -> DataFrame:
    """rank_references for all conversations of edges at once; a round of joins for each link of the longest chain."""
    own = edges.select("conv", "node", "own").unionByName(edges.select("conv", F.col("need").alias("node"), F.col("need_turn").alias("own")))
    nodes = materialize(own.groupBy("conv", "node").agg(F.min("own").alias("own")), "nodes")
    known = nodes.limit(0).select("conv", "node", F.col("own").alias("at"), F.lit(0).cast("long").alias("rank"))
    key = ["conv", "node"]
    edges = edges.select("conv", "node", "need")

    def taken(which: DataFrame, known: DataFrame) -> DataFrame:
        """at and rank of nodes by what they need and is known."""
        of = edges.join(which.select(*key), key, "left_semi").join(known.withColumnRenamed("node", "need"), ["conv", "need"])
        got = of.groupBy(*key).agg(F.max("at").alias("a"), F.max("rank").alias("r"))
        return which.join(got, key, "left").select(*key, F.greatest("own", "a").alias("at"), F.coalesce(F.col("r") + 1, F.lit(0)).cast("long").alias("rank"))

    def peel(known: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
        while True:
            waits = edges.join(open_.select("conv", F.col("node").alias("need")), ["conv", "need"], "left_semi").select(*key).distinct()
            ready = materialize(open_.join(waits, key, "left_anti"), "ready")
            if ready.isEmpty():
                return known, open_
            known = materialize(known.unionByName(taken(ready, known)), "ranked")
            open_ = materialize(open_.join(ready, key, "left_anti"), "open")

    known, rest = peel(known, nodes)
    core = rest
    while True:
        used = edges.join(core, key, "left_semi").select("conv", F.col("need").alias("node")).distinct()
        fewer = materialize(core.join(used, key, "left_semi"), "core")
        if fewer.count() == core.count():
            break
        core = fewer
    if not core.isEmpty():
        known = materialize(known.unionByName(taken(core, known)), "ranked")
        known, _ = peel(known, rest.join(core, key, "left_anti"))
    return known


def _ranks(rows: DataFrame, calls: DataFrame, first: DataFrame, in_task: int) -> DataFrame | None:
    """(conv, node, at, rank) of the messages that take part in references, if there are any."""
    target = first.select("conv", F.col("id").alias("ref"), F.col("call_node").alias("need"), F.col("call_turn").alias("need_turn"))
    quotes = calls.select("conv", "node", "own", F.explode("refs").alias("ref"))
    replies = rows.filter("result_of IS NOT NULL AND size(calls) > 0").select("conv", "node", "own", F.col("result_of").alias("ref"))
    edges = quotes.unionByName(replies).join(target, ["conv", "ref"]).filter("node <> need").select("conv", "node", "own", "need", "need_turn").distinct()
    edges = materialize(edges, "references")
    large = materialize(edges.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > in_task), "large")
    if edges.isEmpty():
        return None

    def run(batches):
        for b in batches:
            convs, nodes, ats, ranks = [], [], [], []
            for conv, group in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                turns, needs = {}, {}
                for e in group:
                    turns[e["node"]], turns[e["need"]] = e["own"], e["need_turn"]
                    needs.setdefault(e["node"], set()).add(e["need"])
                for node, (at, rank) in rank_references(turns, needs).items():
                    convs.append(conv)
                    nodes.append(node)
                    ats.append(at)
                    ranks.append(rank)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (convs, nodes, ats, ranks)], names=["conv", "node", "at", "rank"])

    few = edges.join(large, "conv", "left_anti").groupBy("conv").agg(F.collect_list(F.struct("node", "own", "need", "need_turn")).alias("e"))
    few = few.mapInArrow(run, "conv long, node long, at long, rank long")
    if not large.isEmpty():
        few = few.unionByName(_rank_by_joins(materialize(edges.join(large, "conv", "left_semi"), "references")))
    return materialize(few, "ranks")


def _json():
    """Canonical JSON of a message, keys in order: calls, content, extra, name, role, tool_call_id."""
    name = F.when(F.col("call_name").isNotNull(), F.concat(F.lit('"name":'), F.col("call_name")))
    return F.concat(F.lit("{"), F.concat_ws(",", F.get("parts", 0), name, F.get("parts", 1)), F.lit("}"))


#: The tool of the query below.
REPLY = {
    "reply": {
        "properties": {"conversation": {"type": "integer"}, "turn": {"type": "integer"}, "text": {"type": "string", "minLength": 1, "maxLength": 500}, "follows": {"type": "object"}},
        "required": ["conversation", "text", "turn"],
    }
}


def as_tool_traffic(conversations: DataFrame) -> DataFrame:
    """Dialogues as tool traffic: an assistant turn is a call, a user turn the result of the turn before it.

    Of sixteen turns the 1st, 7th and 9th quote the call two turns on, the 5th and 11th the one two
    turns back (the 9th and 11th quote each other); a system turn makes the call of the turn two on, whose own is then a duplicate.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    turn = F.col("turn")
    name = lambda step: F.concat(conv, F.lit(":"), (turn + step).cast("string"))
    of = F.pmod(turn, F.lit(16))
    quoted = F.when(of.isin(1, 7, 9), name(2)).when(of.isin(5, 11), name(-2))
    arguments = F.struct(F.col("conv_id").alias("conversation"), "turn", "text", F.when(F.col("role") == "assistant", F.concat(F.lit("$ref:"), quoted)).alias("follows"))
    own = F.when(F.col("role") == "system", name(2)).otherwise(name(0))
    call = F.to_json(F.struct(F.array(F.struct(own.alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(-1).alias("tool_call_id"), F.coalesce("text", F.lit("")).alias("content")))
    return conversations.withColumn("text", F.when(F.col("role").isin("assistant", "system"), call).when((F.col("role") == "user") & (turn > 0), result).otherwise(F.col("text")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered by (conv_id, at, rank, base, after, turn), the rows are the formatted transcripts."""
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = link(as_tool_traffic(chats), REPLY)
    key = [F.col(f"order_key.{k}").alias(k if k != "turn" else "base") for k in ("at", "rank", "turn", "after")]
    return out.select("conv_id", "turn", "role", *key, "status", "n_calls", "n_faults", "json")

"""Operation histories: validation, real-time order, linearizability, minimisation.

An operation: history_id, id, client, kind (PUT, DELETE, GET), key, value, invoke,
complete, outcome (OK, FAILED, INCOMPLETE), found, result, err.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Incomplete writes of which all subsets are tried; of more, only none and all.
MOST_OPTIONAL = 12
#: Search steps of one history.
BUDGET = 200_000
#: Histories of a batch that a worker holds as Python objects at once.
SOME = 64


def completed(ops: DataFrame) -> DataFrame:
    return ops.where("outcome = 'OK'")


def successful_writes(ops: DataFrame) -> DataFrame:
    return ops.where("outcome = 'OK' and kind <> 'GET'")


def validate(ops: DataFrame) -> DataFrame:
    """Operations that break a rule: history_id, id, problem (the first that holds)."""
    twice = F.count("*").over(Window.partitionBy("history_id", "id")) > 1
    rule = (
        F.when(twice, "duplicate id")
        .when(~F.coalesce(F.col("kind").isin("PUT", "DELETE", "GET"), F.lit(False)), "unknown kind")
        .when((F.col("outcome") == "INCOMPLETE") & (F.col("err") != ""), "incomplete with error")
        .when((F.col("outcome") != "INCOMPLETE") & (F.col("complete") <= F.col("invoke")), "completes before it begins")
        .when((F.col("outcome") == "FAILED") & (F.col("err") == ""), "failed without error")
        .when((F.col("outcome") == "OK") & (F.col("err") != ""), "ok with error")
        .when((F.col("kind") == "GET") & ~F.col("found") & (F.col("result") != ""), "result without found")
        .when((F.col("kind") != "GET") & F.col("found"), "found on a write")
    )
    return ops.withColumn("problem", rule).where("problem is not null").select("history_id", "id", "problem")


def precedence(ops: DataFrame) -> DataFrame:
    """(history_id, before_id, after_id): the first is OK and completes before the second is invoked."""
    a = completed(ops).select("history_id", F.col("id").alias("before_id"), F.col("complete").alias("_complete"))
    b = ops.where("outcome <> 'FAILED'").select("history_id", F.col("id").alias("after_id"), "invoke")
    return a.join(b, "history_id").where("before_id <> after_id and _complete < invoke").select("history_id", "before_id", "after_id")


def optional_subsets(k: int) -> list[int]:
    """Bit sets of the optional writes that are taken to have happened, none first."""
    return list(range(1 << k)) if k <= MOST_OPTIONAL else [0, (1 << k) - 1]


def subsets(numbers: DataFrame, k: str = "k") -> DataFrame:
    """numbers with a row for each of their ``optional_subsets``: subset."""
    table = {n: optional_subsets(n) for n in range(MOST_OPTIONAL + 1)}
    made = numbers.sparkSession.createDataFrame(list(table.items()), "_k int, _s array<long>")  # 2 ** 13 numbers in all
    some = numbers.join(F.broadcast(made), F.col(k) == F.col("_k"), "left")
    every = F.pow(F.lit(2), F.col(k)).cast("long") - 1
    return some.withColumn("subset", F.explode(F.coalesce("_s", F.array(F.lit(0).cast("long"), every)))).drop("_k", "_s")


def by_invoke(ops: DataFrame) -> DataFrame:
    """Operations of each history in the order in which they began."""
    return ops.orderBy("history_id", "invoke", "id")


def stale_gets(ops: DataFrame) -> DataFrame:
    """Gets that miss the latest write of their key that completed before they began.

    A write counts as overwritten only by one that began after it completed, so
    this reports no get that some order of overlapping writes explains.
    """
    gets = completed(ops).where("kind = 'GET'").select("history_id", "key", F.col("id").alias("get_id"), F.col("invoke").alias("_g0"), F.col("complete").alias("_g1"), "found", "result")
    w = ops.where("kind <> 'GET' and outcome <> 'FAILED'").select("history_id", "key", "kind", "value", F.col("invoke").alias("_w0"), F.when(F.col("outcome") == "OK", F.col("complete")).alias("_w1"))
    last = gets.join(w, ["history_id", "key"], "left").withColumn("_done", F.col("_w1") < F.col("_g0"))
    floor = F.max(F.when(F.col("_done"), F.col("_w0"))).over(Window.partitionBy("history_id", "get_id"))
    seen = last.withColumn("_floor", floor)
    # any write that may be the last: not completed before the latest finished one began, and begun before the get ended
    may = F.col("_w0").isNotNull() & (F.col("_w0") < F.col("_g1")) & (F.col("_floor").isNull() | F.col("_w1").isNull() | (F.col("_w1") >= F.col("_floor")))
    fits = F.when(F.col("kind") == "PUT", F.col("found") & (F.col("result") == F.col("value"))).otherwise(~F.col("found"))
    per = seen.groupBy("history_id", "get_id").agg(F.max(F.coalesce(may & fits, F.lit(False))).alias("_some"), F.max(F.col("_floor").isNotNull()).alias("_any"), F.first("found").alias("found"))
    return per.where(~F.col("_some") & ~(~F.col("_any") & ~F.col("found"))).select("history_id", "get_id")


def check(ops: list[dict], budget: int = BUDGET) -> dict:
    """The verdict on one history against a map of keys to values, with what led to it.

    verdict: VALID, VIOLATION or INCONCLUSIVE; states: search steps; witness: ids in
    an order that is right, or the longest that was found; failing: the get that
    could not follow it, with what the map held then (expected_found, expected_value).
    """
    required = sorted((o for o in ops if o["outcome"] == "OK"), key=lambda o: (o["invoke"], o["id"]))
    optional = sorted((o for o in ops if o["outcome"] == "INCOMPLETE" and o["kind"] != "GET"), key=lambda o: (o["invoke"], o["id"]))
    left, spent = budget, False
    best: dict = {"witness": [], "failing": None, "expected_found": None, "expected_value": None}

    def told(verdict: str, **more) -> dict:
        return {"verdict": verdict, "n_completed": len(required), "states": budget - left, **best, **more}

    for chosen in optional_subsets(len(optional)):
        todo = required + [o for i, o in enumerate(optional) if chosen >> i & 1]
        waits = [0] * len(todo)
        for i, o in enumerate(todo):
            for j, p in enumerate(todo):
                if i != j and p["outcome"] == "OK" and p["complete"] < o["invoke"]:
                    waits[i] |= 1 << j
        whole = (1 << len(todo)) - 1
        tried, stack = set(), [(0, (), ())]
        while stack:
            done, state, order = stack.pop()
            if done == whole:
                return told("VALID", witness=[todo[i]["id"] for i in order], failing=None, expected_found=None, expected_value=None)
            if (done, state) in tried:
                continue
            if left == 0:
                spent = True
                break
            left -= 1
            tried.add((done, state))
            values = dict(state)
            for i in reversed(range(len(todo))):
                o = todo[i]
                if done >> i & 1 or waits[i] & ~done:
                    continue
                if o["kind"] == "GET":
                    if (o["key"] in values) != bool(o["found"]) or (o["found"] and values[o["key"]] != o["result"]):
                        if best["failing"] is None or len(order) >= len(best["witness"]):
                            best = {"witness": [todo[x]["id"] for x in order], "failing": o["id"], "expected_found": o["key"] in values, "expected_value": values.get(o["key"])}
                        continue
                    stack.append((done | 1 << i, state, (*order, i)))
                else:
                    after = {k: v for k, v in values.items() if k != o["key"]}
                    if o["kind"] == "PUT":
                        after[o["key"]] = o["value"]
                    stack.append((done | 1 << i, tuple(sorted(after.items())), (*order, i)))
        if spent:
            break
    return told("INCONCLUSIVE" if spent else "VIOLATION")


def check_one(ops: list[dict], budget: int = BUDGET) -> str:
    return check(ops, budget)["verdict"]


_TOLD = "n_ops long, verdict string, n_completed long, states long, budget long, witness array<long>, failing long, expected_found boolean, expected_value string"


def _some(batches):
    """Batches cut into few histories each: as Python objects these take many times their bytes in Arrow."""
    for b in batches:
        for at in range(0, b.num_rows, SOME):
            yield b.slice(at, SOME)


def _searched(ops: DataFrame, ddl: str, budget: int, row) -> DataFrame:
    """A row per history by ``row(operations, what the search told)``; a history is one row of one task's work, bounded by the budget."""
    whole = ops.groupBy("history_id").agg(F.collect_list(F.struct(*[c for c in ops.columns if c != "history_id"])).alias("_ops"))
    schema = T.StructType([whole.schema["history_id"], *T.StructType.fromDDL(ddl).fields])

    def run(batches):
        for b in _some(batches):
            rows = [row(own, check(own, budget)) for own in b.column(1).to_pylist()]
            made = pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(T.StructType(schema.fields[1:])))
            yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], names=schema.names)

    return whole.mapInArrow(run, schema)


def verdicts(ops: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Of each history: n_ops, verdict, n_completed, states (search steps), budget, witness, failing, expected_found, expected_value."""
    return _searched(ops, _TOLD, budget, lambda own, told: {"n_ops": len(own), "budget": budget, **told})


def minimize_one(ops: list[dict], passes: int = 8, budget: int = BUDGET) -> list[dict]:
    """Operations whose greedy removal would end the violation; the input if there is none."""
    return _shrunk(ops, passes, budget) if check_one(ops, budget) == "VIOLATION" else ops


def _shrunk(ops: list[dict], passes: int, budget: int) -> list[dict]:
    for _ in range(passes):
        before = len(ops)
        for o in list(ops):
            rest = [x for x in ops if x is not o]
            if check_one(rest, budget) == "VIOLATION":
                ops = rest
        if len(ops) == before:
            break
    return ops


def minimized(ops: DataFrame, passes: int = 8, budget: int = BUDGET) -> DataFrame:
    """Histories that are violations, cut down to few operations; tried for removal in order of invoke and id."""
    whole = ops.groupBy("history_id").agg(F.collect_list(F.struct(*ops.columns)).alias("_ops"))

    def run(batches):
        for b in _some(batches):
            schema = pa.schema(list(b.schema.field(1).type.value_type))
            rows = []
            for own in b.column(1).to_pylist():
                if check_one(own, budget) == "VIOLATION":
                    rows += _shrunk(sorted(own, key=lambda o: (o["invoke"], o["id"])), passes, budget)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return whole.mapInArrow(run, ops.schema)


def report(ops: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Of each history its verdict and a text that explains it: counts, operations, the order found, what could not follow it."""
    return _searched(ops, "verdict string, report string", budget, lambda own, told: {"verdict": told["verdict"], "report": _text(own, told, budget)})


def line(o: dict) -> str:
    """An operation in words; ``functions.text.describe`` is the same as a column."""
    value = f' value="{o["value"]}"' if o["kind"] == "PUT" else ""
    if o["outcome"] == "INCOMPLETE":
        end, outcome = "?", "INCOMPLETE"
    else:
        end = o["complete"]
        got = f' found="{o["result"]}"' if o["found"] else " not found"
        outcome = f"FAILED: {o['err']}" if o["outcome"] == "FAILED" else "OK" + (got if o["kind"] == "GET" else "")
    return f'{o["id"]}: client {o["client"]} {o["kind"]}("{o["key"]}"){value} from {o["invoke"]} to {end}, {outcome}'


def _text(ops: list[dict], told: dict, budget: int) -> str:
    by_id = {o["id"]: o for o in ops}
    out = [f"verdict: {told['verdict']}", f"operations: {len(ops)}, completed: {told['n_completed']}", f"states explored: {told['states']} of {budget}", "history:"]
    out += ["  " + line(o) for o in sorted(ops, key=lambda o: (o["invoke"], o["id"]))]
    order = " ".join(map(str, told["witness"])) or "none"
    if told["verdict"] == "VALID":
        out.append(f"order that explains it: {order}")
    elif told["verdict"] == "INCONCLUSIVE":
        out.append("the budget was spent before a verdict; this is no violation")
    else:
        out.append(f"longest order found: {order}")
        if told["failing"] is not None:
            o = by_id[told["failing"]]
            held = f'"{told["expected_value"]}"' if told["expected_found"] else "nothing"
            seen = f'"{o["result"]}"' if o["found"] else "nothing"
            out += [f"cannot follow: {line(o)}", f'key "{o["key"]}" held {held} then, the get saw {seen}']
    return "\n".join(out)


def brute_force(ops: list[dict]) -> bool:
    """Is some order right?  For tests: tries all orders of all subsets."""
    from itertools import permutations

    required = [o for o in ops if o["outcome"] == "OK"]
    optional = [o for o in ops if o["outcome"] == "INCOMPLETE" and o["kind"] != "GET"]
    for n in range(len(optional) + 1):
        for extra in combinations(optional, n):
            for order in permutations(required + list(extra)):
                place = {id(o): i for i, o in enumerate(order)}
                if any(p["outcome"] == "OK" and p["complete"] < o["invoke"] and place[id(p)] > place[id(o)] for p in order for o in order if p is not o):
                    continue
                state: dict = {}
                for o in order:
                    if o["kind"] == "PUT":
                        state[o["key"]] = o["value"]
                    elif o["kind"] == "DELETE":
                        state.pop(o["key"], None)
                    elif (o["key"] in state) != bool(o["found"]) or (o["found"] and state[o["key"]] != o["result"]):
                        break
                else:
                    return True
    return False

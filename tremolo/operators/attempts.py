"""Generating variants: how a reply becomes a payload, asking again what was not accepted, and calls within a rate.

Fields of a payload are ARRAY<STRUCT<name, value>> in their order. A strategy
says which of them a reply replaces; a reply that is blank or "none" fails, and
leaves the payload as it was. All of that is expressions; only the calls
themselves are Python.

ask_until_accepted() goes in rounds: a round asks only the cells whose last
attempt was not accepted, and is written before the next one begins, so calls
that came to an end are not made again by a run that starts over, and attempts
that nobody needs are not made at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.levels import temperature
from ..functions.text import _t, let, let2
from ..sources import results
from .evaluate import attempt as tried

STRATEGIES = ("per_field", "append", "wrap", "task", "source", "measure", "decision", "delimited", "json")


def fields_of(**columns: Column) -> Column:
    """Fields of a payload: trimmed values by name, those that mean nothing left out."""
    every = F.array(*(F.struct(F.lit(k).alias("name"), F.trim(F.coalesce(v.cast("string"), F.lit(""))).alias("value")) for k, v in columns.items()))
    return F.filter(every, lambda f: ~f["value"].isin("", "nan", "NaN"))


def values(fields: Column) -> Column:
    return F.transform(fields, lambda f: f["value"])


def text_of(fields: Column) -> Column:
    """The values, joined by spaces."""
    return F.array_join(values(fields), " ")


def lines_of(fields: Column) -> Column:
    """`[FIELD] value` lines."""
    return F.array_join(F.transform(fields, lambda f: F.concat(F.lit("["), F.upper(f["name"]), F.lit("] "), f["value"])), "\n")


def _telling(reply: Column) -> Column:
    """A reply without outer white space; null if it says nothing."""
    bare = F.regexp_replace(_t(reply), r"(?U)^\s+|\s+$", "")
    return let(bare, lambda r: F.when((r != "") & (F.lower(r) != "none"), r))


def _at(fields: Column, place: str, new: Callable[[Column], Column], others: Callable[[Column], Column] = lambda v: v) -> Column:
    """Fields with the first or last value replaced."""
    chosen = (lambda i: i == 0) if place == "first" else (lambda i: i == F.size(fields) - 1)
    return F.transform(fields, lambda f, i: F.struct(f["name"].alias("name"), F.when(chosen(i), new(f["value"])).otherwise(others(f["value"])).alias("value")))


def _delimited(reply: Column, fields: Column) -> Column:
    """Values behind [FIELD_1], [FIELD_2], ... of a reply; a missing or blank one keeps the original."""

    def value(f: Column, i: Column) -> Column:
        mark = F.concat(F.lit("[FIELD_"), (i + 1).cast("string"), F.lit("]"))
        at = F.position(mark, reply)
        rest = F.substring(reply, at + F.length(mark), F.length(reply))
        behind = F.when(at > 0, F.get(F.split(rest, r"\[FIELD_\d+\]"), F.lit(0)))
        return F.struct(f["name"].alias("name"), F.coalesce(_telling(behind), f["value"]).alias("value"))

    return F.transform(fields, value)


def _json(reply: Column, fields: Column) -> Column:
    """Values of the keys field_1, field_2, ... of a JSON reply; null if it is none."""
    parsed = F.from_json(reply, "map<string,string>")
    own = lambda p: F.transform(fields, lambda f, i: F.struct(f["name"].alias("name"), F.coalesce(F.trim(F.try_element_at(p, F.concat(F.lit("field_"), (i + 1).cast("string")))), f["value"]).alias("value")))
    return let(parsed, lambda p: F.when(p.isNotNull(), own(p)))


def payload(strategy: str, fields: Column, reply: Column) -> Column:
    """STRUCT<ok, fields, c>: whether the reply is of use, the new fields, and the text they make.

    reply: a text; of per_field an array with one for each field; of measure it is not read.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    made = lambda ok, f, text=text_of: let2(ok, f, lambda o, x: F.struct(o.alias("ok"), x.alias("fields"), text(x).alias("c")))
    if strategy == "measure":
        return made(F.lit(True), fields)
    if strategy == "per_field":
        each = F.transform(fields, lambda f, i: F.struct(f["name"].alias("name"), F.coalesce(_telling(F.get(reply, i)), f["value"]).alias("value")))
        return made(reply.isNotNull(), each)
    if strategy == "delimited":
        return made(reply.isNotNull(), F.when(reply.isNotNull(), _delimited(reply, fields)).otherwise(fields))
    if strategy == "json":
        # a reply that is no JSON stands for every field
        whole = F.transform(fields, lambda f: F.struct(f["name"].alias("name"), F.trim(reply).alias("value")))
        return F.when(reply.isNull(), made(F.lit(False), fields)).otherwise(let(_json(reply, fields), lambda p: F.when(p.isNotNull(), made(F.lit(True), p)).otherwise(F.struct(F.lit(True).alias("ok"), whole.alias("fields"), F.trim(reply).alias("c")))))

    def use(r: Column) -> Column:
        new = {
            "append": lambda: _at(fields, "last", lambda v: F.concat(v, F.lit("\n"), r)),
            "wrap": lambda: _at(fields, "last", lambda v: r),
            "source": lambda: _at(fields, "last", lambda v: r),
            "task": lambda: _at(fields, "first", lambda v: F.concat(r, F.lit("\n\nSource:\n"), v)),
            "decision": lambda: _at(fields, "last", lambda v: r, lambda v: F.lit("")),
        }[strategy]()
        text = {"task": lines_of, "decision": lambda f: r}.get(strategy, text_of)
        return F.when(r.isNotNull(), made(F.lit(True), new, text)).otherwise(made(F.lit(False), fields))

    return let(_telling(reply), use)


def filled(template: Column, hint: Column | None = None, **parts: Column) -> Column:
    """A prompt: {name} of a template replaced by its part, and the style hint of the attempt."""
    for k, v in parts.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template if hint is None else F.concat(template, F.when(_t(hint) != "", F.concat(F.lit("\nStyle guidance: "), hint)).otherwise(""))


def accepted() -> Column:
    return F.coalesce(F.col("gate") & F.col("level_gate"), F.lit(False))


def ask_until_accepted(cells: DataFrame, respond: Callable[[DataFrame], DataFrame], path: str, attempts: int = 2) -> DataFrame:
    """All attempts of all cells, each cell's up to the first one with gate and level_gate.

    cells: any columns, base_temperature if it is to rise; respond: adds what came of an attempt, with
    gate and level_gate among it, to a frame of cells with attempt and temperature. Rounds are at most
    `attempts` jobs; those in the folder already are read.
    """
    spark, rounds = cells.sparkSession, []
    for n in range(1, attempts + 1):
        frontier = cells if n == 1 else rounds[-1].where(~accepted()).select(*cells.columns)
        if n > 1 and frontier.isEmpty():
            break
        frontier = frontier.withColumn("attempt", F.lit(n))
        if "base_temperature" in cells.columns:
            frontier = frontier.withColumn("temperature", temperature(F.col("base_temperature"), F.col("attempt")))
        rounds.append(results.once(spark, path, n, lambda frontier=frontier: respond(frontier)))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def paced(df: DataFrame, call: Callable[[dict], object], names: tuple[str, str, str, str], path: str, per_minute: float = 30, parallel: int = 8, blocks: int = 8, key: str = "call_id", **how) -> DataFrame:
    """df with each row's reply, status, milliseconds and tries under the given names, and the call's id under `key`.

    Calls are made by `parallel` tasks at a time at most, each with an equal share of the budget of
    calls a minute (tries count as calls). The rows are written first, so that ids stay. They are dealt to blocks by a hash of their values; a block's
    replies are written before they are used, and a block that is in the folder is not asked again. Of a
    block that an executor is lost in, the calls that had not been written are made again with the same
    id, by which a system can tell them. how: tries, pause, most of evaluate.attempt().
    """
    spark = df.sparkSession
    rows = df.withColumn(key, F.sha2(F.to_json(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256))
    own = results.once(spark, f"{path}/plan", 0, lambda: rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))))
    gap = 60.0 * parallel / per_minute
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(own.drop("_block").schema)])  # any name of a column will do
    columns, answers = [*df.columns, key], [f"r{i}" for i in range(4)]
    schema = StructType([*plain.fields, *(StructField(a, StringType() if i < 2 else LongType()) for i, a in enumerate(answers))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        due = 0.0

        def in_time(row):
            nonlocal due
            time.sleep(max(0.0, due - time.monotonic()))
            due = max(due, time.monotonic()) + gap
            return call(row)

        for b in batches:
            rows = b.set_axis(columns, axis=1).to_dict("records")
            got = [tried(lambda row=row: in_time(row), **how) for row in rows]
            yield b.assign(**{n: pd.Series([g[i] for g in got], index=b.index, dtype=object if i < 2 else "int64") for i, n in enumerate(answers)})

    out = None
    for n in range(blocks):
        part = own.where(F.col("_block") == n).drop("_block").toDF(*plain.names).repartition(parallel, plain.names[-1])
        done = results.once(spark, path, n, lambda part=part: part.mapInPandas(run, schema)).toDF(*columns, *names)
        out = done if out is None else out.unionByName(done)
    return out

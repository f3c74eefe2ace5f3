"""User code: routing by pattern, handlers, group aggregators."""

from __future__ import annotations

from asyncio import CancelledError
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a handler may report besides success.
ERRORS = ("failed", "skip_retry", "revoke", "timeout", "cancelled")

# What a handler that ran out of time, and one that was cancelled, report.
STOPPED = (("timeout", "context deadline exceeded"), ("cancelled", "context canceled"))


class Mux:
    """Patterns, each with a handler; a type goes to the longest pattern that it begins with."""

    def __init__(self) -> None:
        self.handlers: dict[str, Callable[[str | None], bytes | str | None]] = {}

    def handle(self, pattern: str, handler: Callable[[str | None], bytes | str | None]) -> None:
        if not pattern.strip() or pattern in self.handlers:
            raise ValueError(f"pattern {pattern!r} is blank or taken")
        self.handlers[pattern] = handler

    def find(self, kind: str) -> str | None:
        return max((p for p in self.handlers if kind.startswith(p)), key=len, default=None)

    def run(self, tasks: DataFrame, middleware: tuple[Callable, ...] = ()) -> DataFrame:
        """``tasks`` with ok, error, message and result of the handler of each; unhandled types fail with 'not found'."""
        mux = self

        @F.pandas_udf("ok boolean, error string, message string, result string")
        def call(kinds: pd.Series, payloads: pd.Series) -> pd.DataFrame:
            out = []
            for kind, payload in zip(kinds, payloads):
                pattern = mux.find(kind)
                if pattern is None:
                    out.append((False, "failed", f"handler not found for {kind}", None))
                    continue
                handler = mux.handlers[pattern]
                for wrap in reversed(middleware):
                    handler = wrap(handler)
                try:
                    result = handler(payload)
                    out.append((True, None, None, None if result is None else str(result)))
                except (TimeoutError, CancelledError) as e:
                    out.append((False, *STOPPED[isinstance(e, CancelledError)], None))
                except Exception as e:  # noqa: BLE001  user code may raise anything
                    kind_of = getattr(e, "kind", "failed")
                    out.append((False, kind_of if kind_of in ERRORS else "failed", str(e), None))
            return pd.DataFrame(out, columns=["ok", "error", "message", "result"])

        return tasks.withColumn("_out", call("type", "payload")).select("*", "_out.*").drop("_out")


class TaskError(Exception):
    """A failure of a given kind: ``skip_retry`` archives at once, ``revoke`` drops the task."""

    def __init__(self, message: str, kind: str = "failed"):
        super().__init__(message)
        self.kind = kind


def route(tasks: DataFrame, patterns: DataFrame) -> DataFrame:
    """``tasks`` with pattern: the longest of ``patterns`` (pattern) that the type begins with, or null.

    The distinct types are matched, not the tasks. Patterns are joined on their
    own text with the prefixes of each type.
    """
    kinds = tasks.select("type").distinct()
    prefixes = kinds.select("type", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("type"), F.lit(1))), lambda i: F.substring("type", F.lit(1), i))).alias("pattern"))
    best = prefixes.join(patterns, "pattern").groupBy("type").agg(F.max_by("pattern", F.length("pattern")).alias("pattern"))
    return tasks.join(best, "type", "left")


def aggregate_sets(sets: DataFrame, aggregator: Callable[[str, str, int, list[str]], str]) -> DataFrame:
    """queue, group_key, set_no, payload: user code over the payloads of each set, in order, with its queue, group and number; a set has at most the flush size."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, aggregator(*key, list(rows.sort_values("rn")["payload"])))], columns=["queue", "group_key", "set_no", "payload"])

    return sets.groupBy("queue", "group_key", "set_no").applyInPandas(run, "queue string, group_key string, set_no long, payload string")


def aggregate_groups(members: DataFrame, aggregator: Callable[[str, list[str]], str]) -> DataFrame:
    """One payload for each flushed set (queue, group_key), by user code over its members in order; sets have a bounded size."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        payload = aggregator(key[1], list(rows.sort_values("rn")["payload"]))
        return pd.DataFrame({"queue": [key[0]], "group_key": [key[1]], "payload": [payload]})

    return members.groupBy("queue", "group_key").applyInPandas(run, "queue string, group_key string, payload string")


#: What a handler may know of its task besides the payload.
CONTEXT = ("id", "queue", "type", "retried", "retry", "deadline")


class TypedMux:
    """Types, each with a payload schema and a handler of columns, which runs where the rows are, without Python workers.

    A handler takes the decoded payload and the context, both structs, and returns
    its result, and its error (null: none; else one of ``ERRORS``, or any text for ``failed``).
    """

    def __init__(self) -> None:
        self.handlers: dict[str, tuple[str, Callable[[Column, Column], tuple[Column, Column]]]] = {}

    def handle(self, kind: str, schema: str, handler: Callable[[Column, Column], tuple[Column, Column]]) -> None:
        """``schema`` is DDL of the JSON payload; fields of other names are passed over."""
        if not kind.strip() or kind in self.handlers:
            raise ValueError(f"type {kind!r} is blank or taken")
        self.handlers[kind] = (schema, handler)

    def run(self, tasks: DataFrame) -> DataFrame:
        """``tasks`` (type, payload and columns of the context) with ok, error, message, result, each task decoded by its type's schema.

        A payload that isn't JSON of the schema fails with 'failed to decode typed payload', a type without handler with
        'handler not found'; neither reaches a handler. A null payload is an empty object.
        """
        context = F.struct(*(F.col(c) for c in CONTEXT if c in tasks.columns))
        outcome = F.struct(F.lit("failed").alias("error"), F.concat(F.lit("handler not found for "), "type").alias("message"), F.lit(None).cast("string").alias("result"))
        for kind, (schema, handler) in self.handlers.items():
            text = F.coalesce(F.col("payload").cast("string"), F.lit("{}"))
            decoded = F.from_json(text, f"{schema}, _wrong string", {"columnNameOfCorruptRecord": "_wrong"})
            result, error = handler(decoded, context)
            wrong = decoded["_wrong"].isNotNull() | decoded.isNull()
            named = F.when(error.isNull(), F.lit(None).cast("string")).when(error.isin(*ERRORS), error).otherwise("failed")
            fine = F.struct(named.alias("error"), error.cast("string").alias("message"), F.when(error.isNull(), result.cast("string")).alias("result"))
            bad = F.struct(F.lit("failed").alias("error"), F.concat(F.lit("failed to decode typed payload for "), "type").alias("message"), F.lit(None).cast("string").alias("result"))
            outcome = F.when(F.col("type") == kind, F.when(wrong, bad).otherwise(fine)).otherwise(outcome)
        out = tasks.withColumn("_out", outcome)
        return out.select(*tasks.columns, F.col("_out.error").isNull().alias("ok"), "_out.error", "_out.message", "_out.result")


def failures(handled: DataFrame, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The error side of handled tasks: what an error hook is given, and makes of it."""
    failed = handled.where("not ok")
    return failed if hook is None else hook(failed)

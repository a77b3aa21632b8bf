"""Places of regular expression matches, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<start:int,order:int,end:int,kind:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


#: Running sums are taken in chunks of so many values, so that a text with very many matches costs no square of them.
CHUNK = 256


def running_sums(values: Column) -> Column:
    """For an array of ints: the sum of the values before each one."""

    def within(a):
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before"))
        step = lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")
        )
        return F.aggregate(a, zero, step)

    def chunked(a):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK)), lambda k: within(F.slice(a, (k * CHUNK + 1).cast("int"), CHUNK)))
        return let(
            chunks,
            lambda c: F.flatten(
                F.zip_with(c, within(F.transform(c, lambda x: x["sum"]))["before"], lambda x, o: F.transform(x["before"], lambda y: y + o))
            ),
        )

    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(chunked(a)))


def matches(text: Column, pattern: str, empty: Column, body) -> Column:
    """``body(starts, found, between)`` of all leftmost, non-overlapping matches: their places, texts and the text before each; ``empty`` if none."""

    def located(parts, found):
        between = F.slice(parts, 1, F.size(found))
        return let(
            between,
            lambda b: let(
                F.zip_with(
                    running_sums(F.zip_with(b, found, lambda p, m: F.length(p) + F.length(m))), b, lambda at, p: at + F.length(p)
                ),
                lambda starts: body(starts, found, b),
            ),
        )

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) == 0, empty).otherwise(let(F.split(text, pattern, -1), lambda parts: located(parts, m))),
    )


def find_spans(text: Column, pattern: str, kind: str, order: int, accept, guard: Column) -> Column:
    """Spans of all leftmost, non-overlapping matches of ``pattern`` that ``accept`` takes, by start.

    Places count code points, end exclusive. They are the lengths of the pieces
    that the pattern splits the text into and of the matches between them. Only
    texts that pass ``guard``, which must hold for every text with an accepted
    match, are split at all.
    """

    def spans(starts, found, _):
        each = F.zip_with(
            starts,
            found,
            lambda at, m: F.when(
                accept(m),
                F.struct(
                    at.alias("start"), F.lit(order).alias("order"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind")
                ),
            ),
        )
        return F.filter(each, lambda s: s.isNotNull())

    return F.when(guard, matches(text, pattern, no_spans(), spans)).otherwise(no_spans())


def spans_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

"""Personal data: base patterns, and bootstrapped contextual extraction from them.

The base patterns give seed entities. The one or two words before a token on
its line, or a cue inside it (``id=``, ``tel:``), are its lexical pattern; the
tokens behind a pattern are its instances. Tokens with a digit or an at sign
are instances behind any words, tokens of letters behind or around a cue (``:``, ``=``,
``#``). The graph of patterns and instances is scored in rounds:

- a pattern's confidence is the share of its distinct instances that are
  trusted, smoothed by PRIOR; it counts from MIN_SEEDS trusted instances and
  from LEAST on;
- an instance is trusted if a base pattern knows it, or if its patterns that
  count are confident enough together: 1 - prod(1 - confidence) >= CONFIDENT.

What becomes trusted in a round supports patterns in the next, until nothing
new does. Trust only grows, so that ends. Trusted instances behind patterns
that count, where no base span stands, are added as spans of kind ``context``.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, scratch
from .spans import count_kind, find_spans, matches, spans_text

BASE = ("email", "ip", "card", "phone")
#: The base patterns, written so that each is linear on long runs.
#: A match can only begin where its run does, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
CARD_GUARD = r"(?:[0-9][\x20-]?){13}[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit, an at sign or a cue inside it, or any token behind a cue and one blank.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@:=#]*+(?:[0-9@]|[:=#](?=[^\x20\x09-\x0D]))[^\x20\x09-\x0D]*+|(?<=[:=#][\x20\x09])[^\x20\x09-\x0D]++"
TOKEN_GUARD = r"[0-9@:=#]"
#: What stands in a token before its identifier.
INNER_CUE = r"^[^0-9@]*[:=#](?=.)"

MIN_SEEDS = 5
LEAST = 0.5
CONFIDENT = 0.8
PRIOR = 1.0
#: An instance has so many characters at least.
MIN_CHARS = 4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Luhn's check of a string of digits."""

    def total(d):
        n = F.length(d)
        each = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: let(
                F.substring(d, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
                lambda x: F.when(x > 9, x - 9).otherwise(x),
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(number, total)


def _card(m: Column) -> Column:
    return let(_digits(m), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))


def _ip(m: Column) -> Column:
    part = lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False))
    return F.forall(F.split(m, r"\."), part)


def find_personal(text: Column) -> Column:
    """Base spans of one text, by start and then kind."""
    return F.array_sort(
        F.concat(
            find_spans(text, EMAIL, "email", 0, lambda m: F.lit(True), F.contains(text, F.lit("@"))),
            find_spans(text, IP, "ip", 1, _ip, text.rlike(r"[0-9]\.[0-9]")),
            find_spans(text, CARD, "card", 2, _card, text.rlike(CARD_GUARD)),
            find_spans(text, PHONE, "phone", 3, lambda m: F.length(_digits(m)).between(10, 15), text.rlike(r"\+[0-9]")),
        )
    )


def _candidates(text: Column) -> Column:
    """Tokens that may be identifiers: start, end, instance, pattern, both lowered.

    Every step is linear in the text: words are cut off from the right by their
    delimiters, not searched for.
    """
    none = F.array().cast("array<struct<start:int,end:int,instance:string,pattern:string>>")

    def words_before(between):
        line = F.translate(F.substring_index(between, "\n", -1), "\t\x0b\x0c\r", "    ")
        return F.trim(F.substring_index(F.regexp_replace(F.trim(line), "\x20{2,}+", " "), " ", -2))

    def one(start, m, between):
        return let(
            F.struct(words_before(between).alias("words"), F.regexp_extract(m, INNER_CUE, 0).alias("cue")),
            lambda c: let(
                F.substring(m, F.length(c["cue"]) + 1, F.length(m)),
                lambda rest: let(
                    F.length(F.regexp_extract(rest, r"^[(\[<{\"']*+", 0)),
                    lambda head: let(
                        F.regexp_replace(rest, r"^[(\[<{\"']++|[)\]>}\"',.;:!?]++$", ""),
                        lambda core: F.struct(
                            (start + F.length(c["cue"]) + head).alias("start"),
                            (start + F.length(c["cue"]) + head + F.length(core)).alias("end"),
                            F.lower(core).alias("instance"),
                            F.lower(
                                F.when(c["cue"] == "", c["words"]).otherwise(
                                    F.trim(F.concat(F.substring_index(c["words"], " ", -1), F.lit(" "), c["cue"]))
                                )
                            ).alias("pattern"),
                        ),
                    ),
                ),
            ),
        )

    def body(starts, found, between):
        each = F.zip_with(F.arrays_zip(starts.alias("at"), between.alias("b")), found, lambda x, m: one(x["at"], m, x["b"]))
        return F.filter(each, lambda x: (x["pattern"] != "") & (F.length(x["instance"]) >= MIN_CHARS))

    return F.when(text.rlike(TOKEN_GUARD), matches(text, TOKEN, none, body)).otherwise(none)


def scored(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patterns that count, trusted instances) of distinct ``edges`` (pattern, instance, seed).

    patterns: pattern, n, trusted, confidence; instances: instance, round (0 for seeds).
    """
    seeds = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    trusted = materialize(seeds.where("seed = 1").select("instance", F.lit(0).alias("round")), "pii-trusted")
    turn = 0
    while True:
        turn += 1
        held = edges.select("pattern", "instance").join(trusted, "instance", "left")
        patterns = held.groupBy("pattern").agg(F.count("*").alias("n"), F.count("round").alias("trusted"))
        patterns = patterns.withColumn("confidence", F.col("trusted") / (F.col("n") + PRIOR))
        patterns = patterns.where((F.col("trusted") >= MIN_SEEDS) & (F.col("confidence") >= LEAST))
        patterns = materialize(patterns, "pii-patterns")
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        sure = edges.join(patterns, "pattern").groupBy("instance").agg((1 - doubt).alias("score")).where(F.col("score") >= CONFIDENT)
        new = materialize(sure.join(trusted, "instance", "left_anti").select("instance", F.lit(turn).alias("round")), "pii-new")
        if new.isEmpty():
            return patterns, trusted
        trusted = materialize(trusted.unionByName(new), "pii-trusted")


@scratch
def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): base spans and those that confident patterns add, by start and then kind.

    One row per row of ``docs``; a null text is empty and has no spans; rows
    that share a doc_id are searched one by one; an empty table gives an empty
    result. Other columns are not read. The
    text is scanned once; what the graph needs is written to the shared folder.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        find_personal(text).alias("spans"),
        _candidates(text).alias("candidates"),
    )
    found = materialize(found, "pii-found")
    at = found.where(F.size("candidates") > 0).select("row", "spans", F.explode("candidates").alias("c"))
    overlaps = F.exists("spans", lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))
    at = materialize(at.select("row", "c.*", overlaps.cast("int").alias("seed")), "pii-occurrences")
    edges = materialize(at.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    patterns, trusted = scored(edges)
    more = at.where("seed = 0").join(patterns.select("pattern"), "pattern", "left_semi").join(trusted, "instance", "left_semi")
    more = more.groupBy("row").agg(
        F.collect_list(
            F.struct("start", F.lit(len(BASE)).alias("order"), "end", F.lit("context").alias("kind"))
        ).alias("more")
    )
    out = found.select("row", "doc_id", "spans").join(more, "row", "left")
    return out.select(
        "doc_id", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "more"))).alias("spans")
    )


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )

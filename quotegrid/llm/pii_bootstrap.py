r"""Personal data by regular expressions and bootstrapped contextual extraction, with DataFrame functions only.

Base spans: e-mail, IP, payment card and phone expressions, leftmost and without overlap per kind; a match that fails
its check (parts up to 255, Luhn, number of digits) is dropped. The expressions are written so that no text makes
them quadratic: runs are possessive and start only where a run starts.

Bootstrapping: the two words before a span are its lexical pattern. Patterns and instances (the found strings, and
other tokens with digits or ``@``, and runs of digit groups joined by single spaces) form a graph with occurrence counts. Seeds are the base spans. In each round a
pattern's confidence is the share of its occurrences whose instance is believed, an instance's belief is the noisy-or
of the confident patterns it occurs with. Tokens that a confident pattern precedes, that are believed and have the
shape of the pattern's kind become added spans of that kind. Edges are counted before anything is joined, every round
is a written table.

Text positions are code points, end exclusive. Defined cases: a null text is empty; contexts of fewer than two words are as long as they are, an empty
context is no pattern; long contexts are compared by their hash; very long texts are read whole; added spans never overlap base spans; rows
that repeat id and text get the same spans; an empty table gives an empty result; other columns stay as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotegrid.llm.common import stage

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# Equal to the plain expressions, without their backtracking: \G stands for "right after the match before".
FORM = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of this has no valid span of the kind; saves the work of finding none.
HINT = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
}
_GROUP = r"(?=[,;:!?]*+(?:\s|\z))"  # a digit group ends where its white-space delimited word does, but for punctuation
# digit groups joined by single spaces, or what white space delimits that has a digit or @
TOKEN = (
    rf"(?<!\S)(?:[()./+-]*+[0-9][0-9()./+-]*+{_GROUP}(?:\x20[()./+-]*+[0-9][()./-]*+[0-9][0-9()./-]*+{_GROUP})++[,;:!?]*+"
    r"|[^\s0-9@]*+[0-9@]\S*+)"
)
LONG_CONTEXT = 80  # characters from which on a context goes by its hash


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    # every second digit from the right is doubled, 9 is taken off above 9
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when((n - i) % 2 == 0, F.substr(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substr(digits, i, F.lit(1)).cast("int") * 2
            - F.when(F.substr(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # leading zeros may make a part long; compare as decimals, longer runs are too large anyway
        return F.forall(
            F.split(s, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\z")
        )
    n = F.length(_digits(s))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(s))).otherwise(False)
    return (n >= 10) & (n <= 15)


MATCH = "array<struct<start:bigint,stop:bigint,found:string,context:string>>"


def _context(before: Column) -> Column:
    """The last two words, A-Z lower-cased."""
    flat = F.rtrim(F.translate(before, "\n\t\r", "   "))
    words = F.lower(F.ltrim(F.substring_index(flat, " ", -2)))
    return F.when(F.length(words) <= LONG_CONTEXT, words).otherwise(F.sha2(words, 256))


CHUNK = 1000  # matches placed at a time: positions take time in proportion to the matches, not to their square
PLACES = "array<struct<start:bigint,stop:bigint>>"


def _pieces(text: Column, form: str, wanted: Column) -> tuple[Column, Column]:
    """The matches and the pieces of text between them; both empty where ``wanted`` is false."""
    none = F.array().cast("array<string>")
    found = F.when(wanted, F.regexp_extract_all(text, F.lit(form), F.lit(0))).otherwise(none)
    between = F.when(wanted, F.split(text, form, -1)).otherwise(none)
    return found, between


def _matches(found: Column, between: Column) -> Column:
    """Start, end, string and context of every match: the pieces between matches give the positions."""

    def place(done: Column, i: Column) -> Column:
        last = F.element_at(done, -1)["stop"]
        start = last + F.length(F.get(between, i))
        one = F.struct(start.alias("start"), (start + F.length(F.get(found, i))).alias("stop"))
        return F.concat(done, F.array(one))

    def place_chunk(done: Column, c: Column) -> Column:
        # a chunk starts with where the one before has ended
        end = F.coalesce(F.element_at(F.try_element_at(done, F.lit(-1)), -1)["stop"], F.lit(0).cast("bigint"))
        first = F.array(F.struct(end.alias("start"), end.alias("stop")))
        inside = F.sequence(c * CHUNK, F.least((c + 1) * CHUNK, F.size(found)) - 1)
        return F.concat(done, F.array(F.aggregate(inside, first, place)))

    chunks = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), F.array().cast(f"array<{PLACES}>"), place_chunk
    )
    places = F.flatten(F.transform(chunks, lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))))
    part = lambda a, i: F.coalesce(F.get(a, i), F.lit(""))
    # two words before a match may reach into the two matches before it
    before = lambda i: F.concat(part(found, i - 2), part(between, i - 1), part(found, i - 1), part(between, i))
    out = F.transform(
        places,
        lambda p, i: F.struct(
            p["start"].alias("start"), p["stop"].alias("stop"), F.get(found, i).alias("found"), _context(before(i)).alias("context")
        ),
    )
    return F.when(F.size(found) > 0, out).otherwise(F.array().cast(MATCH))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, one array of matches per kind, and the other tokens with digits or ``@``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    # columns of their own: inside a lambda they would be made again for every match
    pieces = {k: _pieces(F.col("text"), FORM[k], F.col("text").rlike(HINT[k])) for k in KINDS}
    pieces["tokens"] = _pieces(F.col("text"), TOKEN, F.col("text").rlike("[0-9@]"))
    split = rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        *[c.alias(f"__{part}_{k}") for k, pair in pieces.items() for part, c in zip(("found", "between"), pair)],
    )
    placed = split.select(
        "doc_id", "text_hash", *[_matches(F.col(f"__found_{k}"), F.col(f"__between_{k}")).alias(k) for k in pieces]
    )
    return placed.select("doc_id", "text_hash", *[_checked(k).alias(k) for k in KINDS], "tokens")


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda m: _valid(kind, m["found"]))


def _tagged(kind: str) -> Column:
    return F.transform(
        kind,
        lambda m: F.struct(
            m["start"].alias("start"), m["stop"].alias("stop"), m["found"].alias("found"),
            m["context"].alias("context"), F.lit(kind).alias("kind"),
        ),
    )


def occurrences(spans: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, stop, instance, context, kind: seeds have a kind, other tokens have null.

    Punctuation around a token is not part of it. Tokens that overlap a base span are left out.
    """
    seeds = F.concat(*[_tagged(k) for k in KINDS])
    lead = r"^(?:(?!\([0-9]{1,9}\))[^\p{L}\p{N}+])*+"  # a bracket around an area code stays
    core = lambda s: F.regexp_replace(F.regexp_replace(s, lead, ""), r"[^\p{L}\p{N}]+\z", "")

    def trimmed(m: Column) -> Column:
        skip = F.length(m["found"]) - F.length(F.regexp_replace(m["found"], lead, ""))
        return F.struct(
            (m["start"] + skip).alias("start"),
            (m["start"] + skip + F.length(core(m["found"]))).alias("stop"),
            core(m["found"]).alias("found"),
            m["context"].alias("context"),
            F.lit(None).cast("string").alias("kind"),
        )

    free = lambda m: ~F.exists("seeds", lambda s: (s["start"] < m["stop"]) & (m["start"] < s["stop"]))
    other = F.filter(F.transform("tokens", trimmed), lambda m: (m["stop"] > m["start"]) & free(m))
    return (
        spans.withColumn("seeds", seeds)
        .select("doc_id", "text_hash", F.explode(F.concat("seeds", other)).alias("o"))
        .select("doc_id", "text_hash", "o.start", "o.stop", F.lower("o.found").alias("instance"), "o.context", "o.kind")
        .where(F.col("context") != "")
    )


def _shape(kind: Column, s: Column) -> Column:
    """Whether a token looks like an identifier of the kind, more loosely than the base expressions."""
    n = F.length(_digits(s))
    return (
        F.when(kind == "email", s.rlike(r"^[^@\s]+@[^@\s]+\z"))
        .when(kind == "ip", s.rlike(r"^[0-9a-f]*(?:[.:]+[0-9a-f]+){3,7}\z"))
        .when(kind == "card", (n >= 12) & s.rlike(r"^[0-9 ./-]+\z"))
        .otherwise((n >= 7) & (n <= 15) & s.rlike(r"^[0-9 ()./+-]+\z"))
    )


def bootstrap(
    found: DataFrame, rounds: int = 3, min_seeds: int = 3, min_confidence: float = 0.6, min_belief: float = 0.8
) -> DataFrame:
    """Accepted (context, kind, instance) of tokens that are no seeds.

    A pattern needs ``min_seeds`` different believed instances and ``min_confidence``.
    """
    edges = stage(
        found.groupBy("context", "instance", "kind").agg(F.count("*").alias("n")), "edges"
    )
    totals = stage(edges.groupBy("context").agg(F.sum("n").alias("total")), "contexts")
    seeds = edges.where("kind is not null").select("context", "kind", "instance", "n", F.lit(1.0).alias("belief"))
    others = edges.where("kind is null").select("context", "instance", "n")
    believed = stage(seeds, "believed")
    for turn in range(rounds):
        patterns = (
            believed.groupBy("context", "kind")
            .agg(F.sum(F.col("n") * F.col("belief")).alias("hits"), F.count_distinct("instance").alias("instances"))
            .where(F.col("instances") >= min_seeds)
            .join(totals, "context")
            .withColumn("confidence", F.col("hits") / F.col("total"))
            .where(F.col("confidence") >= min_confidence)
            .select("context", "kind", F.least("confidence", F.lit(0.999)).alias("confidence"))
        )
        patterns = stage(patterns, "patterns")
        reached = others.join(patterns, "context").where(_shape(F.col("kind"), F.col("instance")))
        belief = (
            reached.groupBy("kind", "instance")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("belief"))
            .where(F.col("belief") >= min_belief)
        )
        grown = reached.join(belief, ["kind", "instance"]).select("context", "kind", "instance", "n", "belief")
        if turn == rounds - 1:
            return stage(grown.select("context", "kind", "instance").distinct(), "accepted")
        believed = stage(seeds.unionByName(grown), "believed")
    return believed.select("context", "kind", "instance").limit(0)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap_options) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base and added (arrays of start, stop, kind in order)."""
    spans = stage(base_spans(docs, id_col, text_col), "spans")
    found = stage(occurrences(spans), "occurrences")
    accepted = bootstrap(found, **bootstrap_options)
    rank = {k: i for i, k in enumerate(KINDS)}
    place = lambda kind: F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), kind)
    added = (
        found.where("kind is null")
        .drop("kind")
        .join(accepted, ["context", "instance"])
        .groupBy("doc_id", "text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("start", place(F.col("kind")).alias("rank"), "stop"))).alias("added"))
    )
    span = lambda k: F.transform(
        k, lambda m: F.struct(m["start"].alias("start"), F.lit(rank[k]).alias("rank"), m["stop"].alias("stop"))
    )
    one = spans.select("doc_id", "text_hash", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
                       F.sort_array(F.concat(*[span(k) for k in KINDS])).alias("base"))
    other = added.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "added")
    return one.join(
        other, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left"
    ).select(
        "doc_id", "text_hash", *[f"n_{k}" for k in KINDS], "base",
        F.coalesce("added", F.array().cast("array<struct<start:bigint,rank:int,stop:bigint>>")).alias("added"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bootstrap_options) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; overlapping spans by the first one's.

    All columns, also of rows without spans, stay as they are; a null text stays null.
    """
    found = (
        find(docs, id_col, text_col, **bootstrap_options)
        .select(
            F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
            F.sort_array(F.concat("base", "added")).alias("__spans"),
        )
        .where(F.size("__spans") > 0)
        .dropDuplicates(["__id", "__hash"])
    )
    # the row is one column, so that its names cannot clash
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc").getField(text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    masked = F.aggregate(
        "__spans",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["stop"].alias("at"),
                F.concat(
                    acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.get(names, s["rank"]),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    joined = packed.join(
        found,
        F.col("doc").getField(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col("__hash")),
        "left",
    )
    return joined.select(
        *[F.when(F.col("__spans").isNull(), text).otherwise(masked).alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns]
    )

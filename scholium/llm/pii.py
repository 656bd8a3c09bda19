"""Personal data found by pattern, and terms that disclose it found by information.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers,
leftmost and non-overlapping for each kind, with their validity checks.

The sanitiser then protects each such value as an entity. What a term tells of
an entity c is their pointwise mutual information, and c is as good as stated when
that comes near its information content IC(c) = log2(N / n(c)). Over the lines
of the corpus PMI(c; t) / IC(c) is the disclosure of c by t: a term of ``REMOVE`` or
more is removed, one of ``GENERALISE`` or more replaced by a general placeholder,
throughout every document that holds an entity which the term discloses. Documents without
that entity have nothing that the term could give away, and are left alone.
Every entity and every word beside one is rated, however
seldom they are seen, and the same line of different documents counts in each
of them (lines repeated within a row count once). Words within entities do not count. What
chance explains tells nothing: if words fell on lines at random, a pair would meet so often with a
probability of at most exp(-n_c KL(n_ct / n_c, n_t / N)) (Hoeffding), and that
must not be above ``CHANCE``. So a contact line copied into a few documents
counts, and a pair met once does in corpora of 1 / CHANCE lines or more, but in
smaller ones not.

All of it is DataFrame expressions: spans come from the parts between matches
(split) and the matches (regexp_extract_all), whose lengths add up to offsets.
The patterns are possessive, and start only where no earlier start could have
matched, so a long text costs time in proportion to its length; n matches in it cost sums of some n^1.5 small numbers. A row's own list of terms is one pattern,
tried at every word of that row.

Scale: the rows with an entity are written once, and only their lines and words are exploded; all
counts are partly aggregated before their shuffle, so a line that a third of all documents share is
one row of each task. Corpus counts of terms are taken for candidate terms, which are broadcast while they
are at most ``BROADCAST`` and else joined to the counts of all words. The terms
of each document are found by joining its words to the disclosing pairs, under the same check, and its entities to those.

Defined results: a null text counts as empty; rows with a null doc_id are
reported like others; repeated rows give a row each; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table, written

REMOVE = 0.9
GENERALISE = 0.75
CHANCE = 1e-6  # most probability of a pair under independence
BROADCAST = 200_000  # most terms (some 4 MB) that are sent to every executor; more are joined by a shuffle
KINDS = ["email", "ip", "card", "phone"]
TERM = "term"

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
GENERAL = "[TERM]"
LETTER = r"[\p{L}\p{M}\p{N}]"
WORD = rf"{LETTER}+"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?+[0-9]){11}")


_SPAN = "array<struct<start:int,rank:int,stop:int,found:string>>"
CUT = 1024  # characters of the blocks that a text is read in


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, combine) -> Column:
    """What ``combine`` makes of 0 and all numbers before each, and after the last; null for null.

    A fold copies what it has gathered at every step, so folds carry a number only: first those of
    blocks as long as there are blocks, then those within each."""

    def fold(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), combine)

    def scan(all_values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(all_values) - 1) / width).cast("int")), lambda b: F.slice(all_values, b * width + 1, width))
        return _let(blocks, lambda parts: _let(F.transform(parts, fold), lambda totals: F.flatten(F.transform(parts, lambda part, b: within(part, fold(F.slice(totals, 1, b)))))))

    def within(part: Column, base: Column) -> Column:
        return _let(base, lambda begin: F.transform(part, lambda _, i: combine(begin, fold(F.slice(part, 1, i)))))

    return _let(F.concat(values, F.array(F.lit(0))), lambda all_values: F.when(F.size(all_values) > 0, scan(all_values)))


def _spans(parts: Column, matches: Column, kind: str, rank: int) -> Column:
    """Spans of the matches, whose places follow from the lengths of all before them."""

    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda p: F.length(p["part"]) + F.coalesce(F.length(p["found"]), F.lit(0)))
        return _let(_before(lengths, lambda a, b: a + b), lambda starts: F.transform(pairs, lambda p, i: span(p, F.get(starts, i) + F.length(p["part"]))))

    def span(p: Column, begin: Column) -> Column:
        return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + F.length(p["found"])).alias("stop"), p["found"].alias("found"))

    every = _let(F.arrays_zip(parts.alias("part"), matches.alias("found")), placed)
    return F.coalesce(F.filter(every, lambda s: s["found"].isNotNull() & _valid(kind, s["found"])).cast(_SPAN), F.array().cast(_SPAN))


def _blocks(text: Column) -> Column:
    """A text in blocks of ``CUT`` characters, so that a place in it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def _between(blocks: Column, start: Column, stop: Column) -> Column:
    """The characters from ``start`` to ``stop`` of a text in ``blocks``."""
    first, last = (start / CUT).cast("int"), (stop / CUT).cast("int")
    head = F.substring(F.get(blocks, first), start % CUT + 1, F.least(stop - start, F.lit(CUT)))
    tail = F.substring(F.coalesce(F.get(blocks, last), F.lit("")), F.lit(1), stop % CUT)
    spread = F.concat(head, F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail)
    return F.when(stop <= start, "").when(first == last, head).otherwise(spread)


def _replaced(text: Column, spans: Column, mark) -> Column:
    """``text`` with ``mark(span)`` for each span, in start order; one that begins within an earlier one has no mark of its own."""

    def joined(blocks: Column, all_spans: Column, stops: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            return F.when(s["start"] >= F.get(stops, i), F.concat(_between(blocks, F.get(stops, i), s["start"]), mark(s)))

        rest = _between(blocks, F.element_at(stops, -1), F.length(text))
        return F.concat(F.array_join(F.transform(all_spans, piece), ""), rest)

    def reached(all_spans: Column) -> Column:
        return _before(F.transform(all_spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))

    return _let(_blocks(text), lambda blocks: _let(spans, lambda all_spans: _let(reached(all_spans), lambda stops: joined(blocks, all_spans, stops))))


def with_spans(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the base spans of ``text`` in start order, ties in the order of the kinds."""
    names = {k: fresh(rows, f"{k}_parts", f"{k}_matches") for k in KINDS}
    kept = [F.col(f"`{c}`") for c in rows.columns]
    found = rows.select(*kept, *(_may_have(k, F.col(text)).alias(names[k][0]) for k in KINDS))
    columns = []
    for k in KINDS:
        may = F.col(names[k][0])
        columns.append(F.when(may, F.split(F.col(text), PATTERNS[k], -1)).alias(names[k][0]))
        columns.append(F.when(may, F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0))).alias(names[k][1]))
    found = found.select(*kept, *columns)
    spans = [_spans(F.col(names[k][0]), F.col(names[k][1]), k, i) for i, k in enumerate(KINDS)]
    return found.select(*kept, F.array_sort(F.concat(*spans)).alias(out))


def _lines(body: Column) -> Column:
    """The different lines of a text."""
    return F.array_distinct(F.split(body, "\n"))


def _entities(spans: Column) -> Column:
    """The different entities of spans, as kind:value."""
    return F.array_distinct(F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), F.lit(":"), s["found"])))


def _words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def holders(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h_key, body, entities) of the rows that have entities, as a written table."""
    body = docs.select(F.col(f"`{key}`").alias("h_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    return written(with_spans(body, "body", "spans").where(F.size("spans") > 0).select("h_key", "body", _entities(F.col("spans")).alias("entities")), "pii-holders")[0]


def contexts(held: DataFrame) -> DataFrame:
    """(entities, terms, inside, cut) of every line that has entities: these, the different words beside them, those found
    within them only, and those beside them that are no words of the line, as what follows a card number in a hex digest."""
    lines = held.select(F.explode(_lines(F.col("body"))).alias("line"))
    found = with_spans(lines, "line", "spans").where(F.size("spans") > 0)
    rest = _replaced(F.col("line"), F.col("spans"), lambda s: F.lit(" "))
    found = found.select(_entities(F.col("spans")).alias("entities"), _words(rest).alias("terms"), _words(F.col("line")).alias("every"))
    return found.select("entities", "terms", F.array_except("every", "terms").alias("inside"), F.array_except("terms", "every").alias("cut"))


def line_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term): the different words of each line of the corpus."""
    lines = docs.select(F.explode(_lines(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("line"))
    return lines.select(F.explode(_words(F.col("line"))).alias("term"))


def _few(terms: DataFrame) -> DataFrame | None:
    """``terms`` for a broadcast, if they are few enough for one."""
    return F.broadcast(terms) if terms.count() <= BROADCAST else None


def disclosing(docs: DataFrame, key: str = "doc_id", text: str = "text", remove: float = REMOVE, generalise: float = GENERALISE, chance: float = CHANCE, held: DataFrame | None = None) -> DataFrame:
    """(entity, term, disclosure, removed): the terms that tell too much of an entity."""
    found, _ = written(contexts(holders(docs, key, text) if held is None else held), "pii-contexts")
    single = found.select(F.explode("entities").alias("entity"), "terms")
    entities = single.groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = single.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_ct"))
    pairs, _ = written(pairs.join(entities, "entity"), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"), F.lit(False).alias("removed"))
    candidates, _ = written(pairs.select("term").distinct(), "pii-candidates")
    seen = line_words(docs, text)
    few = _few(candidates)
    seen = (seen.join(few, "term") if few is not None else seen).select("term", F.lit(1).alias("by"))
    # lines with entities count with the words beside these, so a pair's term is in as many lines as the pair or more
    moved = [found.select(F.explode(c).alias("term"), F.lit(by).alias("by")) for c, by in (("inside", -1), ("cut", 1))]
    counted = seen.unionByName(moved[0]).unionByName(moved[1]).groupBy("term").agg(F.sum("by").alias("n_t"))
    counted = counted if few is not None else counted.join(candidates, "term")
    size = docs.agg(F.sum(F.size(_lines(F.coalesce(F.col(f"`{text}`"), F.lit(""))))).cast("double").alias("n"))
    rated = pairs.join(counted, "term").crossJoin(F.broadcast(size))
    content = F.log2(F.col("n") / F.col("n_c"))
    information = F.log2(F.col("n") * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    apart, absent = F.col("n_c") - F.col("n_ct"), 1 - F.col("n_t") / F.col("n")
    evidence = F.col("n_ct") * information * math.log(2) + F.when(apart > 0, apart * F.ln(apart / F.col("n_c") / absent)).otherwise(0.0)
    rated = rated.where((information > 0) & (evidence >= -math.log(chance)))
    rated = rated.select("entity", "term", F.when(content > 0, information / content).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= generalise)
    return written(rated.withColumn("removed", F.col("disclosure") >= remove), "pii-terms")[0]


def _term_spans(rows: DataFrame, text: str, terms: str, out: str, rank: int) -> DataFrame:
    """Adds spans of each row's own list of terms, as whole words in any case."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    parts, matches = fresh(rows, "t_parts", "t_matches")
    pattern = F.concat(F.lit(rf"(?iu)(?<!{LETTER})(?:"), F.array_join(terms, "|"), F.lit(rf")(?!{LETTER})"))
    some = F.size(F.coalesce(F.col(terms), F.array().cast("array<string>"))) > 0
    rows = rows.select(*kept, F.when(some, F.split(F.col(text), pattern, -1)).alias(parts), F.when(some, F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias(matches))
    return rows.select(*kept, _spans(F.col(parts), F.col(matches), TERM, rank).alias(out))


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with columns of base spans, term spans and removed terms; see ``names``."""
    base, more, gone, body, every, d_key = names(docs)
    held = holders(docs, key, text)
    told = disclosing(docs, key, text, held=held)
    rows = with_spans(docs.withColumn(body, F.coalesce(F.col(f"`{text}`"), F.lit(""))), body, base)
    if told.isEmpty():
        return rows.withColumns({more: F.array().cast(_SPAN), gone: F.array().cast("array<string>")})
    few = _few(told)
    words = held.select("h_key", F.explode(_words(F.col("body"))).alias("term")).join(told if few is None else few, "term")
    there = held.select(F.col("h_key").alias("e_key"), F.explode("entities").alias("e_entity")).distinct()
    own = words.join(there, F.col("h_key").eqNullSafe(F.col("e_key")) & (F.col("entity") == F.col("e_entity")), "left_semi")
    own = own.groupBy(F.col("h_key").alias(d_key)).agg(F.sort_array(F.collect_set("term")).alias(every), F.sort_array(F.collect_set(F.when(F.col("removed"), F.col("term")))).alias(gone))
    own, _ = written(own, "pii-own")
    rows = rows.join(own.hint("merge"), F.col(f"`{key}`").eqNullSafe(F.col(d_key)), "left").drop(d_key)
    return _term_spans(rows, body, every, more, len(KINDS)).drop(every)


def names(docs: DataFrame) -> list[str]:
    """The columns that ``sanitised`` adds: base spans, term spans, removed terms, body; and two it uses."""
    return fresh(docs, "base", "more", "gone", "body", "every", "d_key")


def _labelled(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, [*KINDS, TERM]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["stop"])), ",")


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans of every row."""
    base, more, *_ = names(docs)
    rows = sanitised(docs, key, text)
    counts = [F.size(F.filter(base, _of_rank(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(
        F.col(f"`{key}`").alias("doc_id"), *counts, F.sha2(_labelled(F.col(base)), 256).alias("base_sha256"), _labelled(F.array_sort(F.concat(base, more))).alias("spans"), F.size(more).cast("long").alias("n_term")
    )


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with its columns, personal data replaced, disclosing terms generalised or removed, ``length`` recounted."""
    base, more, gone, body, *_ = names(docs)
    rows = sanitised(docs, key, text)
    changed = F.size(base) + F.size(more) > 0
    marks = F.array(*(F.lit(PLACEHOLDERS[k]) for k in KINDS))

    def mark(s: Column) -> Column:
        return F.when(s["rank"] < len(KINDS), F.get(marks, s["rank"])).when(F.array_contains(gone, F.lower(s["found"])), "").otherwise(GENERAL)

    whole = _replaced(F.col(body), F.array_sort(F.concat(base, more)), mark)
    new = {text: F.when(changed, whole).otherwise(F.col(f"`{text}`"))}
    rows = rows.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
    if length in docs.columns:
        rows = rows.withColumn(length, F.when(F.col(f"`{text}`").isNull(), F.col(length)).otherwise(F.length(F.col(f"`{text}`")).cast(docs.schema[length].dataType)))
    return rows


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Keywords by token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no keywords.
STOP_WORDS = """
the and or but in on at to for of with by from up about into through during before after above below between among
this that these those i you he she it we they is are was were be been being have has had do does did will would could
should may might must can shall a an some any all both each every no not only also just even still yet already here
there where when why how what which who whom whose
""".split()
#: Most keys of more than one row that are sent to every executor; more are joined by a shuffle.
BROADCAST = 200_000
TOKEN = r"(?<![\p{L}\p{N}_])[a-zA-Z]{4,}(?![\p{L}\p{N}_])"


def _words(text: str) -> Column:
    """The words of four letters or more of a text that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word) of the words of four letters or more that are no stop words."""
    return docs.select(key, F.posexplode(_words(text)).alias("pos", "word"))


def counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n, first_pos). The texts are dealt by key once, which their counts and ranks then need no more."""
    return tokens(docs.select(key, text).repartition(F.col(key)), key, text).groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _most_frequent(words: Column, most: int) -> Column:
    """(n, word) of the most frequent of an array of words. Sorted with their places, equal words are a run, which begins with the first place."""

    def ranked(placed: Column, begins: Column) -> Column:
        def run(begin: Column, i: Column) -> Column:
            n = F.coalesce(F.get(begins, i + 1), F.size(placed)) - begin
            first = F.get(placed, begin)
            return F.struct((-n).alias("less"), first["pos"].alias("pos"), first["word"].alias("word"))

        best = F.slice(F.sort_array(F.transform(begins, run)), 1, most)
        return F.transform(best, lambda r: F.struct((-r["less"]).cast("long").alias("n"), r["word"].alias("word")))

    def begins(placed: Column) -> Column:
        return F.array_compact(F.transform(placed, lambda p, i: F.when((i == 0) | (p["word"] != F.get(placed, i - 1)["word"]), i)))

    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    return _let(placed, lambda all_placed: _let(begins(all_placed), lambda all_begins: ranked(all_placed, all_begins)))


def top(docs: DataFrame, key: str = "paper_id", text: str = "abstract", most: int = 10) -> DataFrame:
    """(key, rank, word, n): the most frequent words of each text, the earlier first among equals.

    Each row is counted by itself, so a task holds one text's words, whatever the table's size, and no text is shuffled. Only rows
    that share their key are dealt by it and counted together."""
    rows = docs.select(key, text)
    shared = rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(F.col(key).alias("s_key"))
    many = shared.count()
    alone, together = rows, None
    if many:
        shared = F.broadcast(shared) if many <= BROADCAST else shared
        same = F.col(key).eqNullSafe(F.col("s_key"))
        alone, together = rows.join(shared, same, "left_anti"), rows.join(shared, same, "left_semi")
    best = alone.select(key, F.posexplode(_most_frequent(_words(text), most)).alias("at", "best"))
    best = best.select(key, (F.col("at") + 1).alias("rank"), "best.word", "best.n")
    if together is None:
        return best
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first_pos")
    return best.unionByName(counts(together, key, text).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(key, "rank", "word", "n"))


def keyword_lists(docs: DataFrame, key: str = "paper_id", text: str = "abstract", most: int = 10) -> DataFrame:
    """(key, keywords) for every row; a text without keywords has an empty list."""
    ranked = top(docs, key, text, most).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("ranked"))
    words = F.transform(F.coalesce("ranked", F.array().cast("array<struct<rank:int,word:string>>")), lambda r: r["word"])
    return docs.select(key).join(ranked, key, "left").select(key, words.alias("keywords"))


def corpus_counts(docs: DataFrame, text: str = "abstract") -> DataFrame:
    """(word, n) over all texts, partly counted before the shuffle."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return docs.select(F.explode(found).alias("word")).where(~F.col("word").isin(STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))

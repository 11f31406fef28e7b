"""Benchmark decontamination by a positional inverted index; DataFrame functions only.

Test texts become windows of consecutive words. The corpus frequency of every test term is counted over all documents, and each window
is searched through its two rarest words. The postings (term, document, position) of these are stored, each with the words about it.
Shifted by the term's place in the test text, the postings of two terms of one occurrence give the same start, so lists are intersected
by (document, item, start); a window counts where all its words agree. Proximity comes from the same postings.

Test terms are broadcast only up to BROADCAST_TERMS of them; beyond it they are joined by a shuffle.

Defined cases: null texts and texts without words have no words and no hit; an item with fewer words than a window is one
window, one without words none; rows of a repeated doc_id are judged each by its own text; rows of a repeated item_id are
items of one name, counted once; null item_id is left out; extra columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.tables import cut_lineage, read_table, scratch_path

WINDOW = 13
BROADCAST_TERMS = 200_000
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in their own case; letters are lowered word by word, where it matters."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def sized_hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def test_items(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, words, n): one row for each test text that has words; `item` names the row."""
    w = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), words_of(lowered(F.col(text))).alias("words")).distinct()
    return w.withColumn("n", F.size("words")).filter("n > 0").withColumn("item", F.xxhash64("item_id", "words"))


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int, text: str = "text") -> DataFrame:
    """(term, df): how often each test term is in the corpus. `term` is folded by lower(), which only widens the search."""
    each = docs.select(F.explode(words_of(F.col(text))).alias("w")).select(F.lower("w").alias("term"))
    return each.join(sized_hint(terms, n_terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def plans(items: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, s, a1, t1, a2, t2): for each window of each item, by its first word s, the places and terms of its two rarest words; no second for
    windows of one word. Windows with a term that is not in the corpus are left out."""
    w = items.select("item", "n", F.posexplode("words").alias("at", "word")).withColumn("term", F.lower("word")).join(counts, "term", "left")
    width = F.least(F.lit(window), F.col("n"))
    spread = w.withColumn("s", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - width + 1), F.least(F.col("at"), F.col("n") - width))))
    rare = spread.groupBy("item", "s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "term"))).alias("r"))  # of a window's words
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return rare.filter(first["df"] > 0).select("item", "s", first["at"].alias("a1"), first["term"].alias("t1"), second["at"].alias("a2"), second["term"].alias("t2"))


def postings(docs: DataFrame, terms: DataFrame, n_terms: int, window: int = WINDOW, text: str = "text") -> DataFrame:
    """The positional index of the training texts for `terms`: (term, doc_id, row, pos, low, around). `around` are the words from place `low` to a
    window's length beyond `pos`."""
    w = docs.select("doc_id", F.xxhash64(text).alias("row"), words_of(F.col(text)).alias("words"))
    low = F.greatest(F.lit(0), F.col("pos") - window + 1)
    around = F.slice("words", low + 1, F.col("pos") - low + window)
    if n_terms <= BROADCAST_TERMS:
        each = w.select("doc_id", "row", "words", F.posexplode("words").alias("pos", "w")).withColumn("term", F.lower("w"))
        return each.join(F.broadcast(terms), "term").select("term", "doc_id", "row", "pos", low.alias("low"), around.alias("around"))
    # before a shuffle each word carries its neighbours alone, not the whole text
    cut = F.transform("words", lambda x, i: F.struct(x.alias("w"), i.alias("pos"), F.slice(F.col("words"), F.greatest(F.lit(0), i - window + 1) + 1, F.least(i, F.lit(window - 1)) + window).alias("around")))
    each = w.select("doc_id", "row", F.explode(cut).alias("x")).select(F.lower("x.w").alias("term"), "doc_id", "row", "x.pos", F.greatest(F.lit(0), F.col("x.pos") - window + 1).alias("low"), "x.around")
    return each.join(terms, "term").select("term", "doc_id", "row", "pos", "low", "around")


def phrase_hits(index: DataFrame, items: DataFrame, planned: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, item_id, places, near): for each alignment of an item with a document the document's words inside occurrences of windows,
    and whether two rarest words of a window are near each other.

    The lists of a window's two rarest terms are shifted by the terms' places in the item and intersected by (document, item, start); what
    is left is compared word by word.
    """
    size = F.count(F.lit(1))
    first = planned.groupBy(F.col("t1").alias("term"), "item", F.col("a1").alias("at")).agg(F.collect_set("t2").alias("partners"))
    second = planned.filter("a2 is not null").select(F.col("t2").alias("term"), "item", F.col("a2").alias("at")).distinct()
    lists = cut_lineage(first.unionByName(second, allowMissingColumns=True))
    hit = index.join(sized_hint(lists, lists.count()), "term")
    near = F.coalesce(F.arrays_overlap(F.transform("around", lambda x: F.lower(x)), "partners"), F.lit(False))
    hit = hit.select("doc_id", "row", "item", (F.col("pos") - F.col("at")).alias("start"), near.alias("near"), F.struct("at", "low", "around").alias("hit"))
    at = hit.groupBy("doc_id", "row", "item", "start").agg(F.collect_set("hit").alias("hits"), F.max("near").alias("near"))
    windows = planned.groupBy("item").agg(F.collect_list(F.struct("s", "a1", "a2")).alias("windows"), size.alias("m"))
    whole = cut_lineage(items.join(windows, "item").select("item", "item_id", "words", "n", "windows", "m"))
    both = at.join(sized_hint(whole.drop("m"), whole.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]), "item")
    width, start = F.least(F.lit(window), F.col("n")), F.col("start")

    def same(w: Column, h: Column) -> Column:
        begin = start + w["s"] - h["low"]
        there = F.slice(h["around"], F.greatest(begin, F.lit(0)) + 1, width)
        return (h["at"] == w["a1"]) & (begin >= 0) & (F.transform(there, lowered) == F.slice(F.col("words"), w["s"] + 1, width))

    listed = F.transform("hits", lambda h: h["at"])
    # both lists have the alignment (a window of one word has one list); then all words agree
    met = both.withColumn("windows", F.filter("windows", lambda w: F.array_contains(listed, w["a1"]) & (w["a2"].isNull() | F.array_contains(listed, w["a2"]))))
    met = met.filter((F.size("windows") > 0) | F.col("near"))
    found = F.filter("windows", lambda w: F.exists("hits", lambda h: same(w, h)))
    places = F.array_distinct(F.flatten(F.transform(found, lambda w: F.sequence(start + w["s"], start + w["s"] + width - 1))))
    return met.select("doc_id", "row", "item_id", places.alias("places"), "near")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, n_hit, item_ids, n_near) of the documents that are hit or near; `row` is xxhash64 of the text."""
    spark = docs.sparkSession
    t = cut_lineage(test_items(items))
    terms = t.select(F.explode("words").alias("w")).select(F.lower("w").alias("term")).distinct()
    planned = cut_lineage(plans(t, term_counts(docs, terms, terms.count()), window))
    wanted = cut_lineage(planned.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null").distinct())
    at = scratch_path(spark, "postings")
    postings(docs, wanted, wanted.count(), window).sortWithinPartitions("term").write.option("compression", "zstd").parquet(at)
    hits = phrase_hits(spark.read.parquet(at), t, planned, window)
    per = hits.groupBy("doc_id", "row", "item_id").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    one = per.withColumn("is_hit", F.size("places") > 0)
    items_of = one.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(F.when(F.col("is_hit"), F.col("item_id")))).alias("item_ids"), F.count(F.lit(1)).alias("n_near"))
    words = one.filter("is_hit").select("doc_id", "row", F.explode("places").alias("pos")).distinct().groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n_hit"))
    words = words.select(F.col("doc_id").alias("__d"), F.col("row").alias("__r"), "n_hit")
    both = items_of.join(words, items_of["doc_id"].eqNullSafe(F.col("__d")) & (F.col("row") == F.col("__r")), "left")
    return both.select("doc_id", "row", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "item_ids", "n_near")


def proximity(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, pos) of each posting of the first term that has all the others at most `within` words away."""
    lists = docs.select("doc_id", F.posexplode(words_of(F.col("text"))).alias("pos", "w")).select("doc_id", "pos", lowered(F.col("w")).alias("term")).filter(F.col("term").isin(terms))
    out = lists.filter(F.col("term") == terms[0]).select("doc_id", "pos").distinct()
    for t in terms[1:]:
        # blocks of positions make it an equi-join: a near posting is in the same block or one beside it
        other = lists.filter(F.col("term") == t).select("doc_id", F.col("pos").alias("p2"), F.explode(F.array(*[F.floor(F.col("pos") / within) + i for i in (-1, 0, 1)])).alias("block"))
        out = out.withColumn("block", F.floor(F.col("pos") / within)).join(other, ["doc_id", "block"]).filter(F.abs(F.col("pos") - F.col("p2")) <= within).select("doc_id", "pos").distinct()
    return out


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Every document with n_words, n_hit, n_items, items_sha256, contaminated and n_near, besides its own columns. `n_near` counts the items of
    which a window occurs, or has its two rarest words less than a window apart."""
    clash = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "__row"]
    hit = contamination(docs.select("doc_id", "text"), items, window)
    hit = hit.select(F.col("doc_id").alias("__doc"), F.col("row").alias("__hit_row"), F.col("n_hit").alias("__n_hit"), F.col("item_ids").alias("__item_ids"), F.col("n_near").alias("__n_near"))
    own = docs.drop(*clash).withColumn("__row", F.xxhash64("text"))
    counted = own.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))
    both = counted.join(hit, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__hit_row")), "left")
    n_hit, ids = F.coalesce("__n_hit", F.lit(0)), F.coalesce("__item_ids", F.array().cast("array<string>"))
    return both.select(
        *own.drop("__row").columns, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), F.coalesce("__n_near", F.lit(0)).alias("n_near"),
    )


def op10_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, read_table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")

"""Benchmark decontamination by winnowing, with DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item (all words of a shorter item). Both sides hash every run of ``K`` words and
keep, for each window, the leftmost smallest hash. Equal windows keep the same run at the same place, so meeting at the kept hashes misses no
shared window.

The fingerprints are joined: a document's ``(run, place)`` with the items' ``(run, place in the window)``, a few numbers each. A pair that meets names one window of the
document by its start; the words of these windows are then compared with the items' in full. Spark broadcasts the items' side where its bytes allow
that, and shuffles numbers, not texts, where they do not. Windows are joined by their words before items come in, so a phrase that many items share does not
multiply hits.

Defined results: null text has no words and no hits; an item without words has no window. A repeated row gets its result
each time; rows are told apart by id and text. Empty tables give empty results or no hits. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

WINDOW = 10
K = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A kept run is one number: its hash above, its place in the text below.
PLACE = 31


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _kept_runs(w: str, window: int) -> Column:
    """The runs kept for windows of ``window`` words of the array ``w``, as numbers, each once."""
    k = min(K, window)
    run = ", ".join(f"{w}[i + {j}]" for j in range(k))
    runs = f"transform(sequence(0, size({w}) - {k}), i -> shiftleft(hash({run}) & 4294967295L, {PLACE}) + i)"
    if k == window:
        kept = runs
    else:
        m = window - k + 1
        kept = (f"array_distinct(flatten(transform(array({runs}), r -> "
                f"transform(sequence(1, size(r) - {m - 1}), i -> array_min(slice(r, i, {m}))))))")
    return F.expr(f"CASE WHEN size({w}) >= {window} THEN {kept} ELSE cast(array() AS array<bigint>) END")


def _hash(run: Column) -> Column:
    return F.shiftright(run, PLACE)


def _place(run: Column) -> Column:
    return run.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, n, window, run, at)``: each window's size and words, the hash it keeps and that run's place in it."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(window)))
    each = w.select("item_id", "n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> slice(w, i, n))")).alias("v"))
    # one window keeps one run
    run = F.coalesce(*[F.when(F.col("n") == n, F.get(_kept_runs("v", n), 0)) for n in range(1, window + 1)])
    return each.select("item_id", "n", F.array_join("v", " ").alias("window"), _hash(run).alias("run"), _place(run).alias("at")).distinct()


def search(docs: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` against ``kept`` as from ``item_windows``, which is stored. Returns
    ``(doc_id, version, n_words)`` of every row, and ``(doc_id, version, start, n, window)`` for every place of an
    item's window, once for each text under an id; ``version`` tells such texts apart. Runs jobs."""
    sizes = [r.n for r in kept.select("n").distinct().orderBy("n").collect()]  # at most as many as a window has words
    texts = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    w = texts.select("doc_id", "version", words(F.col("text")).alias("w"))
    runs = F.array(*[F.struct(F.lit(n).alias("n"), _kept_runs("w", n).alias("runs")) for n in sizes]).cast("array<struct<n: int, runs: array<bigint>>>")
    each = cut(w.select("doc_id", "version", F.size("w").cast("long").alias("n_words"), runs.alias("of_size")))
    spots = (each.select("doc_id", "version", "n_words", F.explode("of_size").alias("x")).select("doc_id", "version", "n_words", "x.n", F.explode("x.runs").alias("r"))
             .select("doc_id", "version", "n_words", "n", _hash(F.col("r")).alias("run"), _place(F.col("r")).alias("place")))
    # a run has few places in a window, so a phrase that very many items share does not multiply rows
    narrow = cut(kept.select("n", "run", "at").distinct())
    met = spots.join(narrow, ["n", "run"]).withColumn("start", F.col("place") - F.col("at")).filter("start >= 0 AND start + n <= n_words")
    listed = cut(met.groupBy("doc_id", "version").agg(F.collect_set(F.struct("n", "start")).alias("spots")))  # of one text
    listed = listed.withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    found = texts.join(listed, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["version"] == F.col("_version")))
    found = found.select("doc_id", "version", words(F.col("text")).alias("w"), "spots").select("doc_id", "version", F.explode(F.transform("spots", lambda s: F.struct(
        s["n"].alias("n"), s["start"].alias("start"), F.array_join(F.slice("w", s["start"] + 1, s["n"]), " ").alias("window")))).alias("x"))
    places = found.select("doc_id", "version", "x.*").distinct()
    return each.drop("of_size"), places.join(kept.select("n", "window").distinct(), ["n", "window"], "left_semi")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, version, start, n, window)``: every place where a window of an item stands in a document."""
    return search(docs, cut(item_windows(items, window)))[1]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, version, n_words, n_hit, item_ids, contaminated)`` for every row of ``docs(doc_id, text)`` against ``items(item_id, text)``:
    words, words inside any shared window, and the ids of the items whose windows occur, sorted as text."""
    kept = cut(item_windows(items, window))
    all_docs, found = search(docs, kept)
    found = cut(found)
    key = ["doc_id", "version"]
    before = Window.partitionBy(*key).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(before), F.lit(0))
    words_hit = (found.select(*key, F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", reach)).alias("new"))
                 .groupBy(*key).agg(F.sum("new").alias("n_hit")))
    belongs = kept.select("n", "window", "item_id").distinct()
    of_items = (found.select(*key, "n", "window").distinct().join(belongs, ["n", "window"])
                .select(*key, F.col("item_id").cast("string").alias("item")).distinct()
                .groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("item_ids")))
    summary = words_hit.join(of_items, words_hit.doc_id.eqNullSafe(of_items.doc_id) & (words_hit.version == of_items.version), "left").select(
        words_hit.doc_id, words_hit.version, "n_hit", "item_ids")
    joined = all_docs.join(summary, all_docs.doc_id.eqNullSafe(summary.doc_id) & (all_docs.version == summary.version), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(all_docs.doc_id, all_docs.version, "n_words", n_hit.alias("n_hit"),
                         F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    bad = contamination(docs.select("doc_id", "text"), items, window).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    return docs.join(cut(bad), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_version")), "left_anti")

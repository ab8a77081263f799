"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

One pass over the documents cuts their words and stores the index: a posting
(document, term, place) of every word that the benchmark has, and one row for
each document with its number of words. All that follows reads the stored index.
Every window of WINDOW words of an item has its terms ordered by their number of
postings. The list of its rarest term, moved by the term's offset, gives the
places where the window may start; the lists of the other terms, each moved by
its own offset, are intersected with them, the next rarest one first, so that
the long lists of common words meet only what is left.

Cases: a null or empty text has no words, no hits and no items; an item without
words has no window, one of fewer than WINDOW words is one window; repeated rows
of a document have the same result each, also where a doc_id is null or has
several texts; items with the same words all count; terms with equally many
postings are taken in the order of their ids, which changes no result; empty
tables give no rows or no hits; columns other than doc_id and text (item_id and
text) play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislecraft.llm.common import small_enough, stored

WINDOW = 10
#: Bytes of a table up to which it is broadcast; beyond, it is shuffled.
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII characters that part words.
BREAKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """Lower-case words; none for null."""
    plain = F.translate(text.cast("string"), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and win (array of words) for every window of every item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("win")).distinct()


def numbered(terms: DataFrame) -> DataFrame:
    """term and its id, from 1, for the distinct `terms` (term)."""
    return stored(terms.select("term").distinct().withColumn("id", F.monotonically_increasing_id() + 1), "terms")


def text_key(text: Column) -> Column:
    """What tells texts apart: two hashes, as one would do for a table of any size but no proof."""
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("c"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index, stored: doc (a number for each row of `docs`), id and pos (from 0) of every word that is one of `terms` (term, id).

    A row of id 0 for each document has its number of words as pos, its doc_id and text_key.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("text_key"), words_of(F.col("text")).alias("words"))
    # an empty word stands behind the last one, so that its place is the number of words
    each = rows.select("doc", "doc_id", "text_key", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "term"))
    known = terms.select("term", "id").union(terms.sparkSession.sql("SELECT '' AS term, 0L AS id"))
    if small_enough(terms, BROADCAST_BYTES, F.octet_length("term") + 48):
        known = F.broadcast(known)
    last = F.col("id") == 0
    found = each.join(known, "term").select("doc", "id", "pos", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("text_key")).alias("text_key"))
    return stored(found, "index")


def documents_of(index: DataFrame) -> DataFrame:
    """doc, doc_id, text_key and n_words of every document of the index."""
    return index.where("id = 0").select("doc", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))


def ordered_terms(wins: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """win_id, size and order (id and off of each of its terms, the rarest first) of the windows (win_id, win) whose terms all occur."""
    lists = index.where("id > 0").groupBy("id").agg(F.count(F.lit(1)).alias("n"))  # as many rows as the benchmark has words
    counted = terms.join(lists, "id", "left").select("term", "id", F.coalesce("n", F.lit(0)).alias("n"))
    if small_enough(terms, BROADCAST_BYTES, F.octet_length("term") + 48):
        counted = F.broadcast(counted)
    each = wins.select("win_id", F.posexplode("win").alias("off", "term")).join(counted, "term")
    order = each.groupBy("win_id").agg(F.sort_array(F.collect_list(F.struct("n", "id", "off"))).alias("o"))  # at most WINDOW of them
    return order.where(F.col("o")[0]["n"] > 0).select("win_id", F.size("o").alias("size"), F.transform("o", lambda x: F.struct(x["id"].alias("id"), x["off"].alias("off"))).alias("order"))


def phrase_matches(index: DataFrame, plan: DataFrame) -> DataFrame:
    """Places where windows stand, from the intersection of posting lists: doc, win_id, size, start (from 0). `plan`: see ordered_terms."""
    plan = stored(plan, "plan")
    small = small_enough(plan, BROADCAST_BYTES, F.col("size") * 16 + 64)
    hint = F.broadcast if small else (lambda df: df)
    lists = index.where("id > 0").select("doc", "id", F.col("pos").cast("long").alias("pos"))
    term = lambda k, x: F.get("order", F.lit(k))[x]
    start = (F.col("pos") - F.col("off")).alias("start")
    # the rarest terms' lists
    first = plan.select("win_id", "size", term(0, "id").alias("id"), term(0, "off").alias("off"), term(1, "id").alias("id2"), term(1, "off").alias("off2"))
    begun = lists.join(hint(first), "id").select("doc", "win_id", "size", start, "id2", "off2").where("start >= 0")
    # of the next rarest terms only the postings that some window needs
    second = lists.join(hint(plan.where("size > 1").select(term(1, "id").alias("id")).distinct()), "id", "left_semi")
    met = begun.where("size > 1").select("doc", "win_id", "size", "start", F.col("id2").alias("id"), (F.col("start") + F.col("off2")).alias("pos")).join(second, ["doc", "id", "pos"])
    left = stored(begun.where("size = 1").select("doc", "win_id", "size", "start").union(met.select("doc", "win_id", "size", "start")), "places")
    # the long lists: of the documents that are left only
    more = left.where("size > 2")
    docs = stored(more.select("doc").distinct(), "left")
    of_docs = lists.join(F.broadcast(docs) if small_enough(docs, BROADCAST_BYTES, F.lit(48)) else docs, "doc", "left_semi")
    needed = more.join(hint(plan.select("win_id", "order")), "win_id").select("doc", "win_id", "size", "start", F.explode(F.slice("order", 3, F.col("size") - 2)).alias("t"))
    needed = needed.select("doc", "win_id", "size", "start", F.col("t.id").alias("id"), (F.col("start") + F.col("t.off")).alias("pos"))
    whole = needed.join(of_docs, ["doc", "id", "pos"]).groupBy("doc", "win_id", "size", "start").agg(F.count(F.lit(1)).alias("n")).where("n = size - 2")
    return stored(left.where("size <= 2").union(whole.select("doc", "win_id", "size", "start")), "matches")


def proximity_matches(index: DataFrame, pairs: DataFrame, distance: int) -> DataFrame:
    """Places where the terms id and id2 of `pairs` stand at most `distance` words apart: doc, id, id2, pos, pos2.

    The lists meet in stretches of `distance` words, the first one's postings in their own and in the two beside it.
    """
    lists = index.where("id > 0").select("doc", "id", "pos")
    stretch = F.floor(F.col("pos") / F.lit(distance))
    left = lists.join(pairs, "id").withColumn("at", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    right = lists.select("doc", F.col("id").alias("id2"), F.col("pos").alias("pos2"), F.floor(F.col("pos") / F.lit(distance)).alias("at"))
    return left.join(right, ["doc", "id2", "at"]).where((F.abs(F.col("pos") - F.col("pos2")) <= distance) & (F.col("pos") != F.col("pos2"))).select("doc", "id", "id2", "pos", "pos2")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The index of `docs`, and doc, starts (set of start and size) and items (set) of every document that has a window of the benchmark."""
    named = stored(windows(benchmark, size), "windows")
    wins = stored(named.select("win").distinct().withColumn("win_id", F.monotonically_increasing_id()), "distinct")
    terms = numbered(wins.select(F.explode("win").alias("term")))
    index = postings(docs, terms)
    found = phrase_matches(index, ordered_terms(wins, terms, index))
    items = named.join(wins, "win").select("win_id", "item_id")
    if small_enough(items, BROADCAST_BYTES, F.octet_length("item_id") + 48):
        items = F.broadcast(items)
    return index, found.join(items, "win_id").groupBy("doc").agg(F.collect_set(F.struct("start", "size")).alias("starts"), F.sort_array(F.collect_set("item_id")).alias("items"))


def covered() -> Column:
    """How many words the windows in `starts` cover together."""
    return F.size(F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))))


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    index, found = hits(docs, benchmark, size)
    n_hit = F.when(F.col("starts").isNull(), 0).otherwise(covered()).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return documents_of(index).join(found, "doc", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, most: float = 0.0, size: int = WINDOW) -> DataFrame:
    """The rows of `docs` of which at most the share `most` of the words stands in windows of the benchmark; nulls stay.

    What a row holds depends on its text alone, so that rows are told by their texts.
    """
    index, found = hits(docs, benchmark, size)
    bad = documents_of(index).join(found, "doc").where(covered() > F.lit(most) * F.col("n_words")).select("text_key").distinct()
    return docs.join(bad, text_key(docs["text"].cast("string")) == bad["text_key"], "left_anti")

"""Benchmark decontamination: size-partitioned MinHash containment search with exact confirmation.

An item is found in a document that holds at least three quarters of the item's distinct five-word shingles. Jaccard
similarity of a short item and a long document is near 0, so the search is asymmetric. Items are partitioned by the
size of their sets (powers of two). Each partition has a bottom-k MinHash sketch whose k follows from its upper bound:
an item of n shingles may lack m = n - ceil(3n/4) of them, so of its k least hashes at least k - m are in any document
that contains it. Documents look up their shingles in the sketches of those partitions that they are large enough for;
pairs with k - m hits are candidates, which loses no pair. Candidates are confirmed on the shingles themselves.

Everything is DataFrame functions. The sketch table is written and read again, so that Spark knows its size and
broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``; a larger benchmark joins by shuffle.

Null and empty texts contain nothing; very long ones are searched whole. An item of fewer than five words is one shingle of its words, sought among the
windows of as many words; an item without words is found nowhere. Rows without an id are ignored. Rows that repeat an
id count as one document (or item) with all their shingles. Columns other than ids and texts are not read, so their
names can't clash. An empty table on either side gives no row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelmill.llm.shared import Scratch

SHINGLE = 5


def words(text: Column) -> Column:
    """The lower-cased (A-Z) words of a text; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def windows(w: Column, size: int, key) -> Column:
    """``key`` of each window of ``size`` words."""
    last = F.size(w) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: key(*[F.get(w, i + k) for k in range(size)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>" if key is F.xxhash64 else "array<string>"))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def item_shingles(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item_id, n, length, shingle, hash): the distinct shingles of each item; n counts them."""
    w = items.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("item_id"), words(F.col(text)).alias("w")).where("size(w) > 0")
    size = F.least(F.size("w"), F.lit(SHINGLE))
    zipped = lambda k: F.arrays_zip(windows(F.col("w"), k, _joined).alias("shingle"), windows(F.col("w"), k, F.xxhash64).alias("hash"))
    by_size = [F.when(size == k, F.transform(zipped(k), lambda x: F.struct(x["shingle"].alias("shingle"), x["hash"].alias("hash")))) for k in range(1, SHINGLE + 1)]
    each = w.select("item_id", size.alias("length"), F.explode_outer(F.coalesce(*by_size)).alias("s")).select("item_id", "length", "s.shingle", "s.hash").distinct()
    return each.withColumn("n", F.count("*").over(Window.partitionBy("item_id")).cast("int"))


def sketches(shingles: DataFrame) -> DataFrame:
    """(item_id, part, least, hits, hash): each item's bottom-k sketch under the k of its size partition."""
    need = F.ceil(F.col("n") * 3 / 4)
    part = F.floor(F.log2("n"))
    k = F.least(F.col("n"), F.floor(F.pow(F.lit(2), part + 1) / 4) + 1)
    order = Window.partitionBy("item_id").orderBy(F.xxhash64("hash"), "hash")
    ranked = shingles.withColumns({"place": F.row_number().over(order), "part": part.cast("int"), "least": need.cast("int"), "k": k})
    hits = F.greatest(F.lit(1), F.col("k") - (F.col("n") - F.col("least")))
    return ranked.where("place <= k").select("item_id", "part", "least", hits.cast("int").alias("hits"), "hash")


def contained(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for each item that a document contains to three quarters or more."""
    scratch = Scratch(docs.sparkSession, "contained")
    full = scratch.write(item_shingles(items, item_id, item_text), "items")
    lengths = [r.length for r in full.select("length").distinct().collect()]  # five rows at most
    sketch = scratch.write(sketches(full), "sketch")
    source = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def windowed(rows: DataFrame, key, *more: str) -> DataFrame:
        """All windows of each row's text as one array, ``all``."""
        w = rows.select("doc_id", *more, words(F.col("text")).alias("w"))
        return w.select("doc_id", *more, F.concat(*[windows(F.col("w"), k, key) for k in lengths or [SHINGLE]]).alias("all"))

    # explode would put a filter on the array below the projection that makes it, and so split the text again for every
    # window; explode_outer doesn't, and the join drops its nulls
    found = windowed(source, F.xxhash64).select("doc_id", F.explode_outer("all").alias("hash")).join(sketch, "hash")
    candidates = found.groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("seen"), F.max("hits").alias("hits")).where("seen >= hits")
    candidates = scratch.write(candidates.select("doc_id", "item_id"), "candidates")
    # the items that were found, each with its shingles in a row; a document meets its own candidates by id, so no
    # shingle is a key, however common
    wanted = full.join(candidates.select("item_id").distinct(), "item_id", "left_semi").groupBy("item_id").agg(F.collect_list("shingle").alias("shingles"))
    wanted = scratch.write(wanted, "wanted")
    scratch.keep_only("candidates", "wanted")
    pairs = windowed(source.join(candidates, "doc_id"), _joined, "item_id").join(wanted, "item_id")
    shared = pairs.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), F.explode(F.array_intersect("all", "shingles")).alias("shingle"))
    exact = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"), F.max("n_item").alias("n_item"))
    return exact.where("100 * n_shared >= 75 * n_item")


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain an item; rows without an id stay."""
    dirty = contained(docs, items, id, text).select(F.col("doc_id").alias("_dirty")).distinct()
    return docs.join(dirty, docs[id] == dirty["_dirty"], "left_anti")


ORACLE_SQL = r"""
with dw as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents where doc_id is not null),
iw as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark where item_id is not null),
il as (select item_id, w, least(len(w), 5) as k from iw where len(w) > 0),
ish as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as s from il),
isn as (select item_id, k, s, count(*) over (partition by item_id) as n from ish),
ks as (select distinct k from il),
dsh as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as s from dw, ks where len(w) >= k)
select doc_id, item_id, count(distinct isn.s) as n_shared, max(n) as n_item
from dsh join isn on dsh.s = isn.s
group by doc_id, item_id
having 100 * count(distinct isn.s) >= 75 * max(n)
"""

"""Ranked lexical search of a set of items over all documents, with hashed max-sketches as bounds and exact scores for what they leave.

Terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A term's impact in a document is
(1000000000 * tf) div (1000 * tf + 20 * m) with m = 50 + (50 * n * N) div L, its weight floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and a
document's score for an item sums weight * impact over the item's distinct terms.

1. Items go in blocks of about BLOCK_ITEMS items and BLOCK_TERMS terms, whose vocabulary is broadcast. Each block reads the documents once and
   writes for each the number of its terms and those of the vocabulary with their tf; N, L and df are summed from that.
2. A document's impacts are folded into a sketch: coordinate h holds the greatest impact of the terms hashed to h. With the items' weights
   summed by coordinate, one matrix product bounds the scores of a batch of documents for all items from above.
3. A task goes through each item's candidates by falling bound, in rounds, and scores them exactly until the bound is below the item's
   threshold: its k-th best score so far, and no less than the k-th best in one of EVERY documents, which are searched first. These
   only set where the search may stop; every document is bounded, and none that could be among the k best is left out. About
   k * EVERY rows an item pass the threshold, however many documents there are.
4. Tasks hand on at most k rows an item; Spark ranks those.

Bounds, weights and scores are whole numbers below 2**53, so that the products in floating point are exact. Terms are told by 64-bit
hashes. Null texts have no terms; documents and items without terms score nothing. Rows that share an item_id are one item, a null
item_id is one too. Rows that share a doc_id are ranked each for itself; of equal scores the least doc_id (a whole number; null last) comes
first. Bytes that aren't UTF-8 are parts of terms. Other columns are ignored. An item is held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.decontaminate import normalised
from millrace.llm.shared import discard, lean, materialise
from millrace.llm.words import text_batches, word_hashes

BLOCK_ITEMS, BLOCK_TERMS = 1024, 1 << 20
#: Coordinates of a sketch; documents that are bounded together; candidates of an item in the first round.
WIDTH, TOGETHER, FIRST = 1024, 2048, 64
#: One of so many documents is searched first, for the thresholds.
EVERY = 64


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, "text"):
        h, bounds = word_hashes([normalised(t) for t in texts])
        yield pa.record_batch([batch.column("item_id").take(pa.array(np.repeat(np.arange(len(texts)), np.diff(bounds)))), pa.array(h.view(np.int64))], ["item_id", "h"])


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch, texts in text_batches(batches, "text"):
            h, bounds = word_hashes([normalised(t) for t in texts])
            n = np.diff(bounds)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            here = np.flatnonzero(vocabulary[at] == h)
            key, tf = np.unique((np.repeat(np.arange(len(texts)), n)[here] << 32) + at[here], return_counts=True)
            cut = np.searchsorted(key, np.arange(len(texts) + 1) << 32).astype(np.int32)
            terms = pa.ListArray.from_arrays(pa.array(cut), pa.array((key & 0xFFFFFFFF).astype(np.int32)))
            times = pa.ListArray.from_arrays(pa.array(cut), pa.array(tf.astype(np.int32)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), terms, times], ["doc_id", "n", "terms", "tf"])

    return run


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each term, summed in the task."""
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        some = np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(total))
        some[: len(total)] += total
        total = some
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])


class Items:
    """A block of items: each one's terms (places in the vocabulary) and their weights, and the weights summed by sketch coordinate."""

    def __init__(self, terms: np.ndarray, bounds: np.ndarray, weight: np.ndarray, n: int, length: int, width: int = WIDTH):
        self.terms, self.bounds, self.weight, self.n, self.length, self.width = terms, bounds, weight, n, length, width
        # places in the sorted vocabulary of hashes, spread over the coordinates
        self.coordinate = (np.arange(len(weight), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % width
        self.lookup = np.zeros((width, len(self)))
        np.add.at(self.lookup, (self.coordinate[terms], np.repeat(np.arange(len(self)), np.diff(bounds))), weight[terms])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.n) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)

    def bounds_of(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
        """Upper bounds (rows, items) of the scores, from the sketches of the rows."""
        sketch = np.zeros((rows, self.width))
        np.maximum.at(sketch, (row, self.coordinate[term]), impact.astype(np.float64))
        return sketch @ self.lookup

    def scores(self, key: np.ndarray, impact: np.ndarray, row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact scores of (row, item) pairs; key (row * 2**32 + term) is sorted and has the impacts."""
        size = self.bounds[item + 1] - self.bounds[item]
        first = np.cumsum(size) - size
        term = self.terms[np.repeat(self.bounds[item] - first, size) + np.arange(int(size.sum()))]
        wanted = (np.repeat(row, size) << 32) + term
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        part = np.where(key[at] == wanted, impact[at] * self.weight[term], 0)
        return np.add.reduceat(part, first) if len(part) else np.zeros(0, dtype=np.int64)  # no item is without terms


class Best:
    """The k best rows of each item so far, and the score below which nothing more is wanted."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least = k, np.maximum(least, 1)
        self.item, self.score, self.doc, self.null = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        wanted = score >= self.least[item]
        if not wanted.any():
            return
        merged = [np.concatenate((old, new[wanted])) for old, new in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null))]
        order = np.lexsort((merged[2], merged[3], -merged[1], merged[0]))
        item = merged[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[rank < self.k]
        self.item, self.score, self.doc, self.null = (x[kept] for x in merged)
        last = order[rank == self.k - 1]
        self.least[merged[0][last]] = np.maximum(self.least[merged[0][last]], merged[1][last])


def _search(shared, k: int, together: int = TOGETHER):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, least = shared.value
        best = Best(len(x), k, least)
        for batch in batches:
            for begin in range(0, batch.num_rows, together):
                _search_rows(x, best, batch.slice(begin, together))
        yield pa.record_batch([pa.array(best.item.astype(np.int32)), pa.array(best.score), pa.array(best.doc, mask=best.null.astype(bool))], ["item", "score", "doc_id"])

    return run


def _search_rows(x: Items, best: Best, batch: pa.RecordBatch) -> tuple[int, int]:
    """Bound all rows for all items, and score by falling bound until the threshold; pairs that have a term in common, and pairs scored."""
    terms = batch.column("terms")
    size = np.diff(terms.offsets.to_numpy())
    term, tf = terms.flatten().to_numpy().astype(np.int64), batch.column("tf").flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), size)
    if not len(row):
        return 0, 0
    impact = x.impacts(batch.column("n").to_numpy()[row], tf)
    key = (row << 32) + term
    bound = x.bounds_of(row, term, impact, batch.num_rows)
    at, item = np.nonzero(bound >= best.least)
    met, scored = int((bound > 0).sum()), 0
    bound = bound[at, item]
    order = np.lexsort((-bound, item))
    at, item, bound = at[order], item[order], bound[order]
    doc = batch.column("doc_id")
    null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = doc.fill_null(0).to_numpy()
    take = FIRST
    while len(at):
        now = np.arange(len(at)) - np.searchsorted(item, item) < take
        r, q = at[now], item[now]
        scored += len(r)
        for i in range(0, len(r), 1 << 15):  # memory for the terms of so many pairs
            some = slice(i, i + (1 << 15))
            best.add(q[some], x.scores(key, impact, r[some], q[some]), doc[r[some]], null[r[some]])
        left = ~now & (bound >= best.least[item])
        at, item, bound = at[left], item[left], bound[left]
        take *= 2
    return met, scored


def _k_best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, queries: pa.Table, k: int, width: int, every: int) -> DataFrame:
    """Search with one block of items: item (place in the block), h."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    vocabulary, term = np.unique(queries["h"].to_numpy().view(np.uint64), return_inverse=True)
    item = queries["item"].to_numpy()
    order = np.lexsort((term, item))
    item, term = item[order], term[order]
    bounds = np.searchsorted(item, np.arange(int(item[-1]) + 2))
    words = sc.broadcast(vocabulary)
    postings = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_postings(words)), "doc_id long, n long, terms array<int>, tf array<int>").where("n > 0"), "postings")
    words.destroy()
    n, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), dtype=np.int64)
    holding = postings.select("terms").mapInArrow(lean(_holding), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block
    df[holding["term"].to_numpy()] = holding["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    x = Items(term, bounds, weight, n, max(length, 1), width)
    least = np.zeros(len(x), dtype=np.int64)
    columns = "item int, score long, doc_id long"
    some = postings.where("size(terms) > 0")
    if n > 2 * k * every:
        first = sc.broadcast((x, least))
        found = _k_best(some.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(lean(_search(first, k)), columns), k).where(F.col("rank") == k)
        for r in found.collect():  # at most a row an item
            least[r["item"]] = r["score"]
        first.destroy()
    held = sc.broadcast((x, least))
    return _k_best(some.mapInArrow(lean(_search(held, k)), columns), k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, width: int = WIDTH, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS, every: int = EVERY) -> DataFrame:
    """docs (doc_id, text) and items (item_id, text) to item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    terms = materialise(items.select("item_id", "text").mapInArrow(lean(_item_terms), f"item_id {kind}, h long").dropDuplicates(), "terms")
    sizes = terms.groupBy("item_id").agg(F.count("*").alias("terms")).agg(F.count("*"), F.coalesce(F.sum("terms"), F.lit(0))).first()
    blocks = max(1, -(-sizes[0] // block_items), -(-sizes[1] // block_terms))
    out = None
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not mine.num_rows:
            continue
        names = mine["item_id"].combine_chunks()
        names = names.dictionary_encode(null_encoding="encode")
        number = names.indices.to_numpy()
        ids = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(names.dictionary)), pa.int32()), "item_id": names.dictionary}))
        found = _block(docs, pa.table({"item": number, "h": mine["h"]}), k, width, every).join(F.broadcast(ids), "item")  # a row for each item of the block
        found = found.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
        if blocks > 1:
            found = materialise(found, "found")
        out = found if out is None else out.unionByName(found)
    discard(terms)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
n as (select r, doc_id, len(w) as n from d where len(w) > 0),
s as (select count(*) as total, cast(sum(n) as bigint) as length from n),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as w from benchmark),
p as (select r, w, count(*) as tf from (select r, unnest(w) as w from d) where w in (select w from i) group by r, w),
v as (select w, cast(floor(1000 * ln(cast(2 * total + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as weight from p, s group by w, total),
x as (select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * total) // length)))) as bigint) as score
      from i join p using (w) join v using (w) join n using (r), s group by item_id, r, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from x where score > 0) where rank <= 50
"""

"""Removal of word sequences that stood earlier in the corpus, with a log-structured index of window fingerprints.

A window is `window` (20) consecutive words. Rather than every window's hash the index holds that of its *anchor*: of
the `gram`-word grams inside the window the one with the least hash, the leftmost among equals. Equal windows have
equal anchors at equal places, so no repeat is missed, and neighbouring windows share an anchor, so that one row stands
for about six windows.

For each batch of documents:

1. Its anchors' hashes are counted and written as an immutable run, bucketed and sorted by hash.
2. The run is merge-joined, bucket by bucket, with the runs of earlier batches; a hash met twice is a candidate.
3. Candidates are verified on the texts, which are read again: the *span* of an anchor is a second, independent hash of the words of
   all windows that it stands for. Equal (anchor, span) pairs mean equal windows, of which all but the earliest go. Where one anchor
   has several spans (at the ends of copied passages), the spans' windows are compared one by one, by anchor and window hash.
4. Once there are more than `max_runs` runs, they are compacted into one, and the old ones removed.

What "earlier" means: smaller doc_id, or the same document and an earlier start. doc_id is a number (one that isn't, or a text that
holds none, counts as null); a null doc_id counts as the largest. Words are bytes: those that aren't UTF-8 are kept as they are.
Rows that share a doc_id are ordered by a hash of their text; wholly equal rows are judged as one document each, not
against each other. Null or empty texts have no words; texts of fewer than `window` words have no window. Columns other
than doc_id and text are ignored. Hashes are of 64 bits for the anchor and 64 independent bits for the span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import BloomFilter, bucketed, discard, lean, materialise
from millrace.llm.words import gram_hashes, mix, text_batches, word_hashes

LAST = (1 << 63) - 1


def anchors(texts: list[bytes], window: int, gram: int) -> dict[str, np.ndarray]:
    """The anchors of the texts: doc (index in texts), start (of its first window, in words), n (windows), g (the
    anchor's hash), off (of the anchor from start), w (hash of each window, of all words of all texts) and at (of start in w)."""
    h, bounds = word_hashes(texts)
    g, w = gram_hashes(h, gram), gram_hashes(h, window)
    width = window - gram + 1
    least, size = g, 1
    while size < width:  # sliding minimum by doubling
        step = min(size, width - size)
        least, size = np.minimum(least[: len(least) - step], least[step:]), size + step
    least = least[: len(w)]
    place = np.zeros(len(w), dtype=np.int64)
    base = np.arange(len(w))
    for j in range(width - 1, -1, -1):
        place = np.where(g[j : j + len(w)] == least, base + j, place)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[: len(w)]
    ok = np.flatnonzero(base + window <= bounds[1:][doc]) if len(w) else base
    doc, place = doc[ok], place[ok]
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])))) if len(ok) else ok
    at = ok[new]
    return {"doc": doc[new], "start": at - bounds[doc[new]], "n": np.diff(np.append(new, len(ok))), "g": g[place[new]], "off": place[new] - at, "w": w, "at": at}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text"):
            g, n = np.unique(anchors(texts, window, gram)["g"], return_counts=True)
            yield pa.record_batch([_signed(g), pa.array(n)], ["g", "n"])

    return run


def _spans(window: int, gram: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            a = anchors(texts, window, gram)
            hit = np.flatnonzero(bloom.value.hits(a["g"]))
            doc, n, at, w = a["doc"][hit], a["n"][hit], a["at"][hit], a["w"]
            # an anchor's first and last window overlap or touch, so that the two hashes hold every word of the span
            span = mix(w[at] ^ mix(w[at + n - 1] + (n * 64 + a["off"][hit]).astype(np.uint64)))
            each = np.repeat(at, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            windows = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), _signed(w[each]))
            of = pa.array(doc)
            yield pa.record_batch([_signed(a["g"][hit]), _signed(span), *(batch.column(c).take(of) for c in ("doc", "tkey", "new")), pa.array(a["start"][hit].astype(np.int32)), pa.array(n.astype(np.int32)), windows], ["g", "span", "doc", "tkey", "new", "start", "n", "windows"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted disjoint ranges of removed words from lists of (first window, windows)."""
    for batch in batches:
        out = []
        for ranges in batch.column("ranges"):
            r = sorted((x["start"], x["end"]) for x in ranges.as_py())
            flat: list[int] = []
            for s, e in r:
                if flat and s <= flat[-1]:
                    flat[-1] = max(flat[-1], e)
                else:
                    flat += [s, e]
            out.append(flat)
        yield pa.record_batch([batch.column("doc"), batch.column("tkey"), pa.array(out, pa.list_(pa.int32()))], ["doc", "tkey", "removed"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").try_cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("tkey"))


class FingerprintIndex:
    """The index and the texts behind it. Runs are tables (g, n) in the shared folder, bucketed and sorted by g."""

    def __init__(self, spark: SparkSession, window: int = 20, gram: int = 8, max_runs: int = 2):
        self.spark, self.window, self.gram, self.max_runs = spark, window, gram, max_runs
        self.runs: list[DataFrame] = []
        self.history: list[DataFrame] = []
        self.compactions = 0

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in documents (doc_id, text), later than all before, and return (doc, tkey, removed), written: for each that loses
        words the removed ranges, as a flat list of begin and end."""
        batch = keyed(batch)
        prints = batch.select("text").mapInArrow(lean(_fingerprints(self.window, self.gram)), "g long, n long")
        run = bucketed(prints.groupBy("g").agg(F.sum("n").alias("n")), "g", "run")
        repeated = run.where("n > 1").select("g")
        for old in self.runs:
            repeated = repeated.unionByName(run.hint("merge").join(old.select("g"), "g", "left_semi").select("g"))
        bloom = self.spark.sparkContext.broadcast(BloomFilter.build(repeated, "g"))
        texts = batch.withColumn("new", F.lit(True))
        for old in self.history:
            texts = texts.unionByName(old.withColumn("new", F.lit(False)))
        schema = "g long, span long, doc long, tkey long, new boolean, start int, n int, windows array<long>"
        spans = materialise(texts.drop("doc_id").mapInArrow(lean(_spans(self.window, self.gram, bloom)), schema), "spans")
        bloom.destroy()
        self.runs.append(run)
        self.history.append(batch)
        if len(self.runs) > self.max_runs:
            self.compact()
        removed = self._verified(spans)
        discard(spans)
        return removed

    def compact(self) -> None:
        """Merge all runs into one."""
        whole = self.runs[0]
        for run in self.runs[1:]:
            whole = whole.unionByName(run)
        merged = bucketed(whole.groupBy("g").agg(F.sum("n").alias("n")), "g", "run")
        discard(*self.runs)
        self.runs, self.compactions = [merged], self.compactions + 1

    def _verified(self, spans: DataFrame) -> DataFrame:
        place = F.struct("doc", "tkey", "start")
        firsts = materialise(spans.groupBy("g", "span").agg(F.min(place).alias("first")), "firsts")
        held = spans.select("g", "span", "new", "n", place.alias("place")).join(firsts, ["g", "span"])
        later = held.where("new and place != first").select("place.*", F.expr("place.start + n + %d" % (self.window - 1)).alias("end"))
        several = firsts.groupBy("g").agg(F.count("*").alias("spans")).where("spans > 1").select("g")
        mixed = firsts.join(several, "g", "left_semi").select("g", "span", F.col("first.doc").alias("doc"), F.col("first.tkey").alias("tkey"), F.col("first.start").alias("start"))
        windows = spans.join(mixed, ["g", "span", "doc", "tkey", "start"], "left_semi").select("g", "doc", "tkey", "new", F.posexplode("windows").alias("i", "w"), "start")
        windows = materialise(windows.select("g", "doc", "tkey", "new", (F.col("start") + F.col("i")).alias("start"), "w"), "windows")
        earliest = windows.groupBy("g", "w").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
        lone = windows.where("new").select("g", "w", place.alias("place")).join(earliest, ["g", "w"]).where("place != first").select("place.*", F.expr("place.start + %d" % self.window).alias("end"))
        ranges = later.unionByName(lone).groupBy("doc", "tkey").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
        removed = materialise(ranges.mapInArrow(lean(_merged), "doc long, tkey long, removed array<int>"), "removed")
        discard(firsts, windows)
        return removed


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_batches(batches, "text"):
        n_words, n_removed, kept = [], [], []
        for text, removed in zip(texts, batch.column("removed").to_pylist(), strict=True):
            words = text.split()
            n_words.append(len(words))
            if removed:
                left, at = [], 0
                for s, e in zip(removed[::2], removed[1::2], strict=True):
                    left += words[at:s]
                    at = e
                words = left + words[at:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.record_batch([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _hash_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        digest = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept")]
        yield pa.record_batch([*batch.columns[:3], pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


#: Removed ranges up to this many bytes are broadcast to the texts; more are joined by a shuffle of the texts.
BROADCAST_BYTES = 32 << 20


def dedup(batches: list[DataFrame], index: FingerprintIndex, digest: bool = False) -> DataFrame:
    """Feed the batches to the index in order and return (doc_id, n_words, n_removed, kept), one row per row of the
    batches; kept is the remaining words joined by one space, or with digest kept_sha256 is its SHA-256."""
    out = None
    for batch in batches:
        removed = index.add(batch)
        size = removed.agg(F.count("*") * 48 + F.coalesce(F.sum(F.size("removed")), F.lit(0)) * 4).first()[0]
        side = F.broadcast(removed) if size <= BROADCAST_BYTES else removed
        joined = keyed(batch).join(side, ["doc", "tkey"], "left").select("doc_id", "text", "removed")
        run, last = (_hash_kept, "kept_sha256") if digest else (_cut, "kept")
        schema = T.StructType([batch.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])
        part = joined.mapInArrow(lean(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def by_doc_id(docs: DataFrame, n: int) -> list[DataFrame]:
    """Split the documents into n batches of rising doc_id, of about equal counts; a null doc_id goes to the last."""
    docs = docs.select("doc_id", "text")
    key = F.col("doc_id").try_cast("long")
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)])).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    out = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        part = docs
        if hi is not None:
            part = part.where(key <= hi)
        if lo is not None:
            part = part.where((key > lo) | key.isNull())
        out.append(part)
    return out


#: Batches of the query: more than the index has runs, so that the last is joined with a compacted run.
BATCHES = 4


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(by_doc_id(docs, BATCHES), FingerprintIndex(spark), digest=True)


SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 18)) as pos, w from d where len(w) >= 20),
r as (select doc_id, pos, row_number() over (partition by array_to_string(list_slice(w, pos, pos + 19), ' ') order by doc_id, pos) as nth from s),
gone as (select distinct doc_id, pos + o as pos from r, range(0, 20) t(o) where nth > 1),
each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as t from each anti join gone using (doc_id, pos) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
"""

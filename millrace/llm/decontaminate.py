"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The automaton holds every run of words of every
item. A task streams a document's words through it and carries the length of the longest match that ends at each word;
a length of `n` (13) or more means that the last n words are a window of some item. An item of fewer than n words is one
window as a whole. Words inside any window are hit; a document is contaminated when it has a hit word and the hit
share is at least the coverage limit.

Items, each text of one once, are dealt to blocks of about `block_chars` characters; an item longer than a piece of PIECE_WORDS words is cut in pieces that
overlap by n - 1 words and so have the same windows. Each block gets an automaton of its own, and one is held at a time: the
blocks but the last each scan the documents in a job of their own, which writes the hits found by the text's hash; the last block's
scan starts from the hits of all others. The driver and each task so hold one block's automaton, however large the benchmark.

Null or empty texts have no words and no hits. A null item_id takes part in the hits but is not listed; rows that share
an item_id are one item. Repeated document rows are judged each for itself. Bytes that aren't UTF-8 are parts of words, as all bytes
from 0x80. Documents' other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import discard, lean, materialise
from millrace.llm.words import text_batches, word_hashes

#: Words of the pieces that long items are cut in.
PIECE_WORDS = 20_000
#: Texts with hits in the other blocks up to this number of bytes are broadcast to the last scan; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> bytes:
    """Lower-case, with a space in place of every byte that is not part of a word."""
    return text.translate(_TABLE)


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items whose windows each state stands for."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], n: int = 13):
        self.n, self.next, self.link, self.length = n, [{}], [-1], [0]
        number: dict[bytes, int] = {}
        coded = [(item, [number.setdefault(w, len(number)) for w in words]) for item, words in items if words]
        self.least = min([n, *(len(c) for _, c in coded)])
        for _, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        #: of a state: the state on its chain of suffix links that holds its n-word suffixes, or -1
        self.window = [-1] * len(self.next)
        self.ids: dict[int, set[str]] = {}
        self.short: dict[int, int] = {}
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= n:
                self.window[v] = v if self.length[self.link[v]] < n else self.window[self.link[v]]
        for item, code in coded:
            v = 0
            for i, c in enumerate(code):
                v = self.next[v][c]
                if i >= n - 1:
                    self.ids.setdefault(self.window[v], set()).update([item] if item is not None else [])
            if len(code) < n:
                self.short[v] = len(code)
                self.ids.setdefault(v, set()).update([item] if item is not None else [])
        #: of a state: the first on its chain of suffix links, itself included, that is a whole short item, or the root
        self.near = [0] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[v] = v if v in self.short else self.near[self.link[v]]
        hashed = word_hashes(list(number))[0] if number else np.zeros(0, dtype=np.uint64)
        order = np.argsort(hashed)
        self.vocabulary, self.number = hashed[order], order

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def scan(self, code: list[int], begin: int, spans: list[tuple[int, int]], ids: set[str]) -> None:
        """Stream word numbers through the automaton; add the hit spans (in words, shifted by begin) and the items met."""
        v = size = 0
        nxt, link, length, n = self.next, self.link, self.length, self.n
        for i, c in enumerate(code, begin + 1):
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                size += 1
                if size >= n:
                    spans.append((i - n, i))
                    ids |= self.ids[self.window[v]]
                # short items that end here: at most n - 1, as each is shorter than the one before
                u = self.near[v]
                while u:
                    if (m := self.short[u]) <= size:
                        spans.append((i - m, i))
                        ids |= self.ids[u]
                    u = self.near[link[u]]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS, _ITEMS = T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())


def _pieces(n: int):
    """Item and words, joined by one space, of the pieces of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), texts, strict=True):
                words = normalised(text).split()
                begins = range(0, max(1, len(words) - n + 1), PIECE_WORDS)
                pieces = [b" ".join(words[i : i + PIECE_WORDS + n - 1]) for i in begins]
                yield pa.record_batch([pa.array([item] * len(pieces), pa.string()), pa.array(pieces, pa.binary())], ["item", "words"])

    return run


def _scan(shared, kept: tuple[str, ...]):
    """Add n_words, spans and items to the kept columns; spans and items go on from those of the input, if it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: SuffixAutomaton = shared.value
        for batch, texts in text_batches(batches, "text"):
            h, bounds = word_hashes([normalised(t) for t in texts])
            spans: list[list[tuple[int, int]]] = [[] for _ in texts]
            ids: list[set[str]] = [set() for _ in texts]
            if "before" in batch.schema.names:
                for i, x in enumerate(batch.column("before").to_pylist()):
                    if x is not None:
                        spans[i] = [(s, e) for flat in x["spans"] for s, e in zip(flat[::2], flat[1::2], strict=True)]
                        ids[i] = {item for some in x["items"] for item in some}
            if len(m.vocabulary) and len(h):
                at = np.minimum(np.searchsorted(m.vocabulary, h), len(m.vocabulary) - 1)
                code = np.where(m.vocabulary[at] == h, m.number[at], -1)
                # only a stretch of known words as long as the shortest window can hold one
                cut = np.union1d(np.flatnonzero(np.diff(code >= 0)) + 1, bounds)
                for s, e in pairwise(cut[cut <= len(code)].tolist()):
                    if e - s >= m.least and code[s] >= 0:
                        doc = int(np.searchsorted(bounds, s, side="right")) - 1
                        m.scan(code[s:e].tolist(), s - int(bounds[doc]), spans[doc], ids[doc])
            flat = [[x for span in united(d) for x in span] for d in spans]
            made = [pa.array(np.diff(bounds)), pa.array(flat, pa.list_(pa.int32())), pa.array([sorted(x) for x in ids], pa.list_(pa.string()))]
            yield pa.record_batch([*(batch.column(c) for c in kept), *made], [*kept, "n_words", "spans", "items"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_chars: int = 1_000_000) -> DataFrame:
    """docs (any columns, `text` among them) to (row: struct of all its columns, text, n_words, spans, items): the united hit
    spans as a flat list of begin and end in words, and the ids of the items met, as strings."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = materialise(items.mapInArrow(_pieces(n), "item string, words binary").dropDuplicates(), "pieces")
    blocks = max(1, -(-(pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block_chars))

    def automaton(block: int):
        part = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block).collect()
        return sc.broadcast(SuffixAutomaton([(r["item"], bytes(r["words"]).split()) for r in part], n))

    held = docs.select(F.struct("*").alias("row"), "text")
    fields = [T.StructField("row", held.schema["row"].dataType), T.StructField("text", T.StringType())]
    made = [T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", _ITEMS)]
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("again"), "text").alias("k2")]
    hits = None
    for block in range(blocks - 1):
        model = automaton(block)
        scanned = docs.select("text", *key).mapInArrow(lean(_scan(model, ("k1", "k2"))), T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), *made]))
        found = materialise(scanned.where(F.size("spans") > 0).select("k1", "k2", "spans", "items"), "hits")
        model.destroy()
        hits = found if hits is None else hits.unionByName(found)
    if hits is not None:
        before = materialise(hits.groupBy("k1", "k2").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items")), "before")
        before = before.select("k1", "k2", F.struct("spans", "items").alias("before"))
        size = before.agg(F.sum(F.expr("32 + 4 * size(flatten(before.spans)) + 40 * size(flatten(before.items))"))).first()[0] or 0
        held = held.select("row", "text", *key).join(F.broadcast(before) if size <= BROADCAST_BYTES else before, ["k1", "k2"], "left").drop("k1", "k2")
    last = automaton(blocks - 1)
    discard(pieces)
    return held.mapInArrow(lean(_scan(last, ("row", "text"))), T.StructType([*fields, *made]))


N_HIT = "cast(aggregate(transform(sequence(0, size(spans) div 2 - 1), i -> if(size(spans) = 0, 0, spans[2 * i + 1] - spans[2 * i])), 0, (a, x) -> a + x) as long)"


def judged(found: DataFrame, per: int = 20) -> DataFrame:
    """Add n_hit (hit words) and contaminated: some hit word, and per * n_hit >= n_words."""
    hit = F.expr(f"case when size(spans) = 0 then 0L else {N_HIT} end")
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.expr(f"n_hit > 0 and {per} * n_hit >= n_words"))


def _cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, spans in zip(batch.column("text").cast(pa.large_binary()), batch.column("spans").to_pylist(), strict=True):
            text = raw.as_buffer().to_pybytes().decode(errors="replace") if raw.is_valid else None
            if spans:
                at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
                kept, done = [], 0
                for s, e in zip(spans[::2], spans[1::2], strict=True):
                    kept.append(text[done : at[s][0]])
                    done = at[e - 1][1]
                text = "".join(kept) + text[done:]
            out.append(text)
        yield pa.record_batch([batch.column("row"), pa.array(out, pa.string())], ["row", "clean_text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, per: int = 20, cut: bool = False) -> DataFrame:
    """Documents that are not contaminated, with their own columns. With cut, the hit spans below the coverage limit are
    taken out of their texts as well, returned as column clean_text."""
    found = judged(find_contamination(docs, benchmark, n), per).where("not contaminated")
    if not cut:
        return found.select("row.*")
    schema = T.StructType([T.StructField("row", found.schema["row"].dataType), T.StructField("clean_text", T.StringType())])
    return found.select("row", "text", "spans").mapInArrow(_cut_spans, schema).select("row.*", "clean_text")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = judged(find_contamination(docs.select("doc_id", "text"), bench))
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


SQL = r"""
with i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, least(13, len(w)) as n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as pos, w from i where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') as k from iw),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as pos, w from d, (select distinct n from windows) where len(w) >= n),
hits as (select doc_id, pos, dw.n, item_id from dw join windows on windows.n = dw.n and windows.k = array_to_string(list_slice(w, pos, pos + dw.n - 1), ' ')),
covered as (select doc_id, count(distinct pos + o) as n_hit from (select doc_id, pos, unnest(range(0, n)) as o from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

"""Near-duplicate classes: all links of n-gram Jaccard similarity of at least 0.8, with count-vector R-trees.

A document's set holds the distinct `shingle`-word (5) shingles of its text, A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`; of
fewer words, the whole sequence; of none, nothing. Sets are of 64-bit hashes. Equal sets are one *node*.

Each set's shingles are hashed to GROUPS groups; the numbers in each group are the node's point. The sum of the smaller
coordinates of two points bounds the sets' overlap from above, and so does that of the upper corners of two boxes, which is
what the R-tree prunes with: J >= 0.8 needs an overlap of 4/9 of the two sizes' sum.

One R-tree over a whole corpus can neither be held by one task nor be cut in parts by few coordinates, so:

1. Sets with J >= 0.8 share one of the first n - ceil(0.8 n) + 1 shingles in any common order (prefix filter; exact). The order
   puts shingles that are met again last: a first count, over the prefixes by hash alone, tells them (the most frequent, at most
   MOST_FREQUENT; the others keep their place, which changes the work only). The second count is over the prefixes in that order.
   A Bloom filter of bounded size keeps what is met once from being shuffled twice. (With the first count over 50,000 documents only,
   too few frequent shingles are known on larger tables, and clusters grow together.)
2. Nodes that share such a shingle form a block; shingles with the same nodes are one block. In blocks of at most SMALL nodes
   an R-tree finds the pairs that the bound lets pass; larger blocks pass whole. What passes is glued into clusters.
3. Each cluster gets an R-tree over its points, which is joined with itself from the root down. Pairs that pass are verified exactly
   on the sets, best bound first, unless links found before connect them already, so a group of copies costs about one check for
   each copy. A cluster of more than CHUNK_BYTES of sets is dealt to tiles, one for each pair of its chunks, so that no task holds all of
   it. Its chunks are of sets of one size band each, a factor of 1.25 wide: only chunks of the same or neighbouring bands meet.
4. Components of the links give the class of each node, and so of each document.

No candidate is dropped anywhere. Null or empty texts have an empty set, linked with nothing. A null doc_id keeps its set
and takes its class's least id. Rows that share a doc_id are judged by their texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import connected_components
from millrace.llm.shared import BloomFilter, discard, lean, lean_frame, materialise
from millrace.llm.words import gram_hashes, mix, text_batches, word_hashes

if TYPE_CHECKING:  # else only tasks that use it load pandas
    import pandas as pd

GROUPS, LEAF, FAN, SMALL, CHUNK_BYTES = 128, 8, 8, 64, 8 << 20
#: Rows of a table of clustered nodes (64 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows that go from a table, as ids of 8 bytes, up to this number are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
_RID = "__rid"
#: Repeated shingles that are told apart in the common order (16 bytes each in every worker).
MOST_FREQUENT = 1_000_000


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, bounds = word_hashes(texts, lower=True)
    g = gram_hashes(h, shingle)
    out = []
    for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(g[b : e - shingle + 1]) if e - b >= shingle else gram_hashes(h[b:e], e - b) if e > b else g[:0])
    return out


def prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of the set in the common order: the frequent last, by rank, the others by hash."""
    n = len(s)
    k = n - (4 * n + 4) // 5 + 1
    if not len(frequent):
        return s[:k]
    for upto in (k + k // 8 + 4, n):  # mostly the first few tell
        part = s[:upto]
        at = np.minimum(np.searchsorted(frequent, part), len(frequent) - 1)
        known = frequent[at] == part
        plain = part[~known]
        if len(plain) >= k:
            return plain[:k]
    return np.concatenate([plain, part[known][np.argsort(rank[at[known]], kind="stable")]])[:k]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, _signed(np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)))


def _counted(parts: list[np.ndarray]) -> pa.RecordBatch:
    t, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    return pa.record_batch([_signed(t), pa.array(c)], ["token", "c"])


def _key(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    a = mix(s)
    return int(a.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))


def _prefixes(shingle: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text"):
            distinct = {(len(s), _key(s)): s for s in shingle_sets(texts, shingle)}
            yield _counted([prefix(s, *order.value) for s in distinct.values() if len(s)])

    return run


def _points_of(sets: list[np.ndarray]) -> pa.Array:
    out = []
    for s in sets:
        counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
        out.append(counts.astype("<u2" if len(s) < 1 << 16 else "<u4").tobytes())
    return pa.array(out, pa.binary())


def _described(shingle: int, order, bloom):
    """For each document its set's size and key, and its prefix shingles that the filter knows; its point too if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.uint64)
        for batch, texts in text_batches(batches, "text"):
            sets = shingle_sets(texts, shingle)
            prefixes = [prefix(s, *order.value) if len(s) else none for s in sets]
            hit = bloom.value.hits(np.concatenate(prefixes) if prefixes else none)
            ends = np.cumsum([len(p) for p in prefixes])
            tokens = [p[hit[e - len(p) : e]] for p, e in zip(prefixes, ends.tolist(), strict=True)]
            keys = [_key(s) for s in sets]
            points = _points_of([s if len(t) else none for s, t in zip(sets, tokens, strict=True)])
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), *(_signed(np.array([k[i] for k in keys], dtype=np.uint64)) for i in (0, 1)), _lists(tokens), points], ["doc_id", "rid", "n", "node", "check", "tokens", "point"])

    return run


def _fetched(shingle: int, wanted):
    """Key, point and set of the rows that the filter knows; of wholly equal rows in a task the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            hits = [i for i in np.flatnonzero(wanted.value.hits(rid.view(np.uint64))).tolist() if rid[i] not in seen and not seen.add(rid[i])]
            for part, texts in text_batches(iter([batch.take(pa.array(hits, pa.int64()))]), "text"):
                sets = shingle_sets(texts, shingle)
                keys = [_signed(np.array([k[i] for k in map(_key, sets)], dtype=np.uint64)) for i in (0, 1)]
                yield pa.record_batch([part.column("rid"), *keys, pa.array([len(s) for s in sets], pa.int64()), _points_of(sets), _lists(sets)], ["rid", "node", "check", "n", "point", "shingles"])

    return run


# ---- the R-tree


def _packed(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order of the points in which near ones stand together: halved again and again along what varies most, down to leaves."""
    spread = np.concatenate([points, (sizes / np.sqrt(GROUPS))[:, None]], 1, dtype=np.float32)
    done, todo = [], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            done.append(part)
            continue
        own = spread[part]
        by = np.argsort(own[:, own.var(0).argmax()], kind="stable")
        half = LEAF * max(1, len(part) // LEAF // 2)
        todo += [part[by[half:]], part[by[:half]]]
    return np.concatenate(done)


class RTree:
    """Points packed in leaves of LEAF, and levels of nodes of FAN nodes below a single root. A node's box is the upper corner of its
    points with their least and greatest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = _packed(points, sizes)
        # levels[0] are the points themselves, the last is the root; of each: upper corners, least and greatest sizes
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        self.fans, self.tested, self.passed = [], 0, 0
        while len(self.levels[-1][0]) > 1:
            fan = FAN if self.fans else LEAF
            upper, least, most = self.levels[-1]
            at = np.arange(0, len(upper), fan)
            self.levels.append((np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))
            self.fans.append(fan)

    def _below(self, level: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, one level down, of pairs of nodes, p <= q; of a node with itself each pair once."""
        fan, n = self.fans[level - 1], len(self.levels[level - 1][0])
        i = (p[:, None, None] * fan + np.arange(fan)[None, :, None]).repeat(fan, 2).ravel()
        j = (q[:, None, None] * fan + np.arange(fan)[None, None, :]).repeat(fan, 1).ravel()
        ok = (i < n) & (j < n) & ((i < j) if level == 1 else (i <= j))
        return i[ok], j[ok]

    def _may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs of a level's nodes the bound lets pass, and the bounds of all."""
        upper, least, most = self.levels[level]
        bound = np.concatenate([np.minimum(upper[i[at : at + 8192]], upper[j[at : at + 8192]]).sum(1) for at in range(0, len(i), 8192)]) if len(i) else np.zeros(0, dtype=np.int64)
        ok = (9 * bound >= 4 * (least[i] + least[j])) & (5 * most[i] >= 4 * least[j]) & (5 * most[j] >= 4 * least[i])
        self.tested += len(ok)
        self.passed += int(ok.sum())
        return ok, bound

    def pairs(self, links: "Links", side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j) of the pairs that may link and that the links given don't connect yet, in batches, each best bound first; with side,
        only pairs of different sides."""
        todo = [(len(self.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))] if self.fans else []
        while todo:
            level, p, q = todo.pop()
            if len(p) > 512:  # the rest waits, so that few pairs are held at once
                todo.append((level, p[512:], q[512:]))
                p, q = p[:512], q[:512]
            i, j = self._below(level, p, q)
            if level > 1:
                ok, _ = self._may_link(level - 1, i, j)
                if ok.any():
                    todo.append((level - 1, i[ok], j[ok]))
                continue
            a, b = self.order[i], self.order[j]
            new = links.label[a] != links.label[b]
            if side is not None:
                new &= side[a] != side[b]
            i, j, a, b = i[new], j[new], a[new], b[new]
            ok, bound = self._may_link(0, i, j)
            if ok.any():
                sizes = self.levels[0][1]
                best = np.argsort(-(bound[ok] / (sizes[i[ok]] + sizes[j[ok]])), kind="stable")
                yield a[ok][best], b[ok][best]


class Links:
    """Components of positions, by labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def connected(self, a: int, b: int) -> bool:
        return self.label[a] == self.label[b]

    def join(self, a: int, b: int) -> None:
        self.label[self.label == self.label[b]] = self.label[a]


def _points(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(p, dtype="<u2" if len(p) == 2 * GROUPS else "<u4").astype(np.int32) for p in column])


def _passing(f: pd.DataFrame) -> pd.DataFrame:
    """Of blocks of few nodes, the edges that glue what the bound lets pass."""
    import pandas as pd

    out = []
    for _, block in f.groupby("block", sort=False):
        node, links = block["id"].to_numpy(), Links(len(block))
        for i, j in RTree(_points(block["point"]), block["n"].to_numpy()).pairs(links):
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                if not links.connected(a, b):
                    links.join(a, b)
                    out.append((node[a], node[b]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _verified(f: pd.DataFrame) -> pd.DataFrame:
    """Links that connect what is linked, from the nodes of one or more tiles with their sets."""
    import pandas as pd

    out = []
    for (_, i0, j0), tile in f.groupby(["cluster", "i", "j"], sort=False):
        tile = tile.drop_duplicates("id")
        if len(tile) < 2:
            continue
        node, links = tile["id"].to_numpy(), Links(len(tile))
        sets = [np.asarray(s) for s in tile["shingles"]]
        side = tile["chunk"].to_numpy() if i0 != j0 else None
        for ii, jj in RTree(_points(tile["point"]), tile["n"].to_numpy()).pairs(links, side):
            for a, b in zip(ii.tolist(), jj.tolist(), strict=True):
                if not links.connected(a, b):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        links.join(a, b)
                        out.append((node[a], node[b]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


# ---- the join


def _with_rid(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of both that names a row; wholly equal rows share it."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def _repeated(texts: DataFrame, shingle: int, order) -> DataFrame:
    """(token, c) of the prefix shingles that are met more than once."""
    counts = texts.mapInArrow(lean(_prefixes(shingle, order)), "token long, c long")
    return counts.groupBy("token").agg(F.sum("c").alias("c")).where("c > 1")


def _common_order(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated shingles, sorted, and their counts: all that are met at least so often that MOST_FREQUENT are not exceeded. The bound is
    read off a histogram of the counts (rounded down to two digits), so no task sorts what all others have found."""
    none = docs.sparkSession.sparkContext.broadcast((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    unit = F.pow(F.lit(10), F.greatest(F.floor(F.log10("c")) - 1, F.lit(0))).cast("long")
    counts = materialise(_repeated(docs.select("text"), shingle, none).withColumn("level", F.col("c") - F.col("c") % unit), "counts")
    none.destroy()
    total, least = 0, None
    for level, n in sorted(counts.groupBy("level").agg(F.count("*")).collect(), reverse=True):
        total += n
        if total > MOST_FREQUENT:
            break
        least = level
    top = counts.where(F.lit(False) if least is None else F.col("level") >= least).select("token", "c").toArrow()
    discard(counts)
    frequent, rank = (top.column(c).to_numpy() for c in ("token", "c"))
    by = np.argsort(frequent.view(np.uint64))
    return frequent.view(np.uint64)[by], rank[by]


def _described_docs(docs: DataFrame, shingle: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    order = sc.broadcast(_common_order(docs, shingle))
    bloom = sc.broadcast(BloomFilter.build(_repeated(docs.select("text"), shingle, order).select("token"), "token"))
    longs = [T.StructField(c, T.LongType()) for c in ("rid", "n", "node", "check")]
    schema = T.StructType([docs.schema["doc_id"], *longs, T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("point", T.BinaryType())])
    out = materialise(_with_rid(docs).mapInArrow(lean(_described(shingle, order, bloom)), schema), "described")
    order.destroy()
    bloom.destroy()
    return out


def _parts(rows: int, row_bytes: int) -> int:
    """Groups that rows of about this size are dealt to, of about half of CHUNK_BYTES each where there are many."""
    return max(512, 2 * rows * row_bytes // CHUNK_BYTES)


def _clusters(nodes: DataFrame) -> DataFrame:
    """(id, n, tokens, point) of distinct nodes to (id, cluster): every pair that may link is in one cluster."""
    tokens = nodes.select(F.explode("tokens").alias("token"), "id")
    blocks = tokens.groupBy("token").agg(F.count("*").alias("c"), F.min("id").alias("lead"), F.expr("sum(cast(xxhash64(id) as decimal(20, 0)))").alias("sign")).where("c > 1")
    blocks = materialise(blocks.groupBy("c", "lead", "sign").agg(F.min("token").alias("block")), "blocks")
    members = tokens.join(blocks.select(F.col("block").alias("token"), "c", "lead"), "token")
    large = members.where((F.col("c") > SMALL) & (F.col("id") != F.col("lead"))).select(F.col("id").alias("a"), F.col("lead").alias("b"))
    small = members.where(F.col("c") <= SMALL).select("id", F.col("token").alias("block")).join(nodes.select("id", "n", "point"), "id")
    parts = _parts(blocks.where(F.col("c") <= SMALL).agg(F.sum("c")).first()[0] or 0, 4 * GROUPS)
    glued = small.groupBy(F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part")).applyInPandas(lean_frame(_passing), "a long, b long")
    out = materialise(connected_components(glued.unionByName(large)).select(F.col("node").alias("id"), F.col("component").alias("cluster")), "clusters")
    discard(blocks)
    return out


def distinct_sets(described: DataFrame) -> DataFrame:
    """Nodes: (id, node, check, n, rid, tokens, point) of the distinct sets with tokens, each with a number of its own and one of its rows."""
    nodes = described.where("size(tokens) > 0").select("node", "check", "n", "rid", "tokens", "point").dropDuplicates(["node", "check", "n"])
    return materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")


def _places() -> tuple[Column, Column]:
    """A node's chunk in its cluster, and the chunks that it meets: all of its band and of the two beside it; a small cluster is one chunk."""
    of = lambda step: F.coalesce(F.try_element_at("chunks", F.col("band") + step), F.lit(0))
    number = lambda band, i: (band.cast("long") * F.lit(1 << 20) + i).alias("chunk")
    met = lambda step: F.when(of(step) > 0, F.transform(F.sequence(F.lit(0), F.greatest(of(step) - 1, F.lit(0))), lambda i: number(F.col("band") + step, i))).otherwise(F.array().cast("array<bigint>"))
    small = F.col("whole") <= CHUNK_BYTES
    chunk = F.when(small, F.lit(0).cast("long")).otherwise(number(F.col("band"), F.pmod(F.xxhash64("id"), F.greatest(of(0), F.lit(1)))))
    return chunk.alias("chunk"), F.when(small, F.array(F.lit(0).cast("long"))).otherwise(F.concat(met(-1), met(0), met(1))).alias("others")


def links(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """Edges (a, b) between the numbers of nodes that connect all that is linked."""
    clusters = _clusters(nodes.select("id", "n", "tokens", "point"))
    of_node = clusters.join(nodes.select("id", "node", "check", "rid", "n", "point"), "id")
    of_node = of_node.withColumns({"bytes": F.col("n") * 8 + F.octet_length("point"), "band": F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")})
    bands = of_node.groupBy("cluster", "band").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("m"))
    chunks = F.struct("band", F.ceil(F.col("bytes") / CHUNK_BYTES).cast("int").alias("chunks"))
    size = bands.groupBy("cluster").agg(F.sum("bytes").alias("whole"), F.sum("m").alias("m"), F.map_from_entries(F.collect_list(chunks)).alias("chunks")).where("m > 1")
    placed = materialise(of_node.join(size, "cluster").select("cluster", "id", "node", "check", "rid", "whole", *_places()), "placed")
    n, total = placed.count(), (size.where(F.col("whole") <= CHUNK_BYTES).agg(F.sum("whole")).first()[0] or 0)
    wanted = docs.sparkSession.sparkContext.broadcast(BloomFilter.build(placed, "rid"))
    fetched = _with_rid(docs).mapInArrow(lean(_fetched(shingle, wanted)), "rid long, node long, check long, n long, point binary, shingles array<long>")
    members = fetched.join(F.broadcast(placed) if n <= BROADCAST_ROWS else placed, ["rid", "node", "check"])
    tiles = members.withColumn("other", F.explode("others"))
    tiles = tiles.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    # clusters in one piece are small: many of them make a group; a tile of a large one is a group of its own
    part = F.when(F.col("whole") <= CHUNK_BYTES, F.pmod(F.xxhash64("cluster"), F.lit(_parts(1, total)))).otherwise(F.xxhash64("cluster", "i", "j"))
    tiles = tiles.select("cluster", "id", "n", "point", "shingles", "chunk", "i", "j", part.alias("part"))
    out = materialise(tiles.groupBy("part").applyInPandas(lean_frame(_verified), "a long, b long"), "links")
    wanted.destroy()
    discard(clusters, placed)
    return out


def classified(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, text) to (doc_id, rid, n, node, check, component), written, one row per row: rid names the row (wholly equal rows share
    it), n is the set's size, node and check its key, and component the class of linked sets, null for a set without links."""
    key = ["node", "check", "n"]
    described = _described_docs(docs, shingle)
    nodes = distinct_sets(described)
    linked = links(docs, nodes, shingle)
    found = connected_components(linked).join(nodes.select(F.col("id").alias("node"), F.col("node").alias("h"), "check", "n"), "node")
    found = materialise(found.select(F.col("h").alias("node"), "check", "n", "component"), "found")
    size = found.count()
    out = materialise(described.select("doc_id", "rid", *key).join(F.broadcast(found) if size <= BROADCAST_ROWS else found, key, "left"), "classified")
    discard(described, nodes, linked, found)
    return out


def _with_class(rows: DataFrame) -> DataFrame:
    """Add the class of rows that have a set: (linked, a, b), the component or else the key of the set."""
    alone = F.col("component").isNull()
    return rows.where("n > 0").withColumns({"linked": ~alone, "a": F.coalesce("component", "node"), "b": F.when(alone, F.col("check")).otherwise(F.lit(0))})


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), one row per row."""
    rows = classified(docs, shingle)
    whole = _with_class(rows).groupBy("linked", "a", "b").agg(F.min("doc_id").alias("component_id"))
    keyed = rows.withColumns({"linked": F.col("component").isNotNull(), "a": F.coalesce("component", "node"), "b": F.when(F.col("component").isNull(), F.col("check")).otherwise(F.lit(0))})
    # rows without a set have a key of their own, that is in no class
    keyed = keyed.withColumn("a", F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("rid"))).withColumn("linked", F.when(F.col("n") > 0, F.col("linked")))
    joined = keyed.join(whole, ["linked", "a", "b"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_class(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs (any columns, doc_id and text among them) with one row of each class of near duplicates: that of the least doc_id, null being
    the largest, and of the least hash among equals. Rows without words are in no class, and all stay."""
    rows = classified(docs.select("doc_id", "text"), shingle)
    of_class = _with_class(rows)
    first = of_class.groupBy("linked", "a", "b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))["rid"].alias("first"), F.count("*").alias("n")).where("n > 1")
    several = of_class.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, ["linked", "a", "b"])
    # of a class of several rows only its first one stays, once
    gone = materialise(several.groupBy("rid").agg(F.max(F.col("rid") == F.col("first")).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "gone")
    discard(rows)
    few = gone.count() <= BROADCAST_IDS
    held = docs.withColumn(_RID, F.xxhash64("doc_id", "text"))
    side = lambda df: F.broadcast(df) if few else df
    lone = held.join(side(gone.select(F.col("rid").alias(_RID))), _RID, "left_anti")
    again = held.join(side(gone.where("kept").select(F.col("rid").alias(_RID))), _RID, "left_semi").dropDuplicates([_RID])
    return lone.unionByName(again).select([f"`{c.replace('`', '``')}`" for c in docs.columns])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) as pos from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
reach as (select doc_id as node, doc_id as other from d union select reach.node, e.b from reach join e on reach.other = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from d left join n using (doc_id) join (select node as doc_id, min(other) as component_id from reach group by node) c using (doc_id)
"""

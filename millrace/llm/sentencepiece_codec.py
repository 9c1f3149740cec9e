"""SentencePiece encoding and decoding with a max-plus parallel scan over the chunks of giant documents.

A text's best segmentation is the best path over its places. A document longer than `chunk` characters is split into
chunks, each a row of its own. The *state* at a chunk's border is how many characters past the border the piece reaches
that crosses it (0: a piece ends at the border). Then:

1. Each chunk, alone, yields its transfer matrix: the best score from each state at its left border to each at its right.
2. Matrices are combined in the (max, +) semiring, first within groups of `fan` chunks, then over groups; the product is
   associative, so groups are independent tasks. That gives the scores of the states at each left border.
3. With these, each chunk knows for each right state the left state that its best path comes from; these maps are
   composed in the same two levels, from the document's end, which fixes both border states of every chunk.
4. Each chunk is backtraced alone between its border states, and the ids are put together in order.

In matrices only the stretches at the two borders are worked out where no piece can reach across a place inside the
chunk (such as before a space): all paths pass through that place. A chunk without such a place gets the full matrix,
one pass for each left state.

Short documents are encoded in the scan itself, many at a time: their distinct stretches between such places go through the same
max-plus steps together.

Null or empty texts have no ids. Rows that share doc_id and text get the same ids, one output row each. Other columns
are ignored. `decode` joins the pieces' text; it gives back the text exactly, except that U+2581, which stands for a space
in pieces, comes back as a space. Bytes that aren't UTF-8 are read as U+FFFD.

That chunks give the ids of the whole text rests on exact sums: scores are float32 numbers as files hold them, added as float64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import lean, materialise
from millrace.llm.stretches import Trie, segmented, take_ranges
from millrace.llm.unigram import SPACE, Vocabulary, default_model, vocabulary
from millrace.llm.words import text_batches

if TYPE_CHECKING:  # else only tasks that use it load pandas
    import pandas as pd

NONE = float("-inf")


class Stretches:
    """Ids of texts by way of their stretches, which no piece reaches across; each distinct stretch of a call is worked out once."""

    def __init__(self, v: Vocabulary):
        self.v, self.trie = v, Trie(v)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (one place more than texts)."""
        find, found, bounds = self.v.segment.findall, [], [0]
        for t in texts:
            found += find(t)
            bounds.append(len(found))
        d = pa.array(found, pa.large_string()).dictionary_encode()
        ids, begins = segmented(self.trie, d.dictionary.to_pylist())
        taken, count = take_ranges(ids, begins, d.indices.to_numpy())
        return taken, np.concatenate(([0], np.cumsum(count)))[bounds]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0].astype("<i4").tobytes()


@lru_cache(maxsize=4)
def stretches_of(model_file: str) -> Stretches:
    return Stretches(vocabulary(model_file))


def _encode_short(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = stretches_of(model_file)
        for part, texts in text_batches(batches, "text", 2 << 20):
            ids, ends = stretches.encode_all([stretches.v.normalise(t.decode(errors="replace")) for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([part.column("doc_id"), part.column("tkey"), lists], ["doc_id", "tkey", "ids"])

    return run


# ---- giant documents


def _split(model_file: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        for batch in batches:
            for key, tkey, text in zip(batch.column("doc_id"), batch.column("tkey"), batch.column("text"), strict=True):
                s = v.normalise(text.as_buffer().to_pybytes().decode(errors="replace"))
                for no, at in enumerate(range(0, len(s), chunk)):
                    yield pa.record_batch([pa.array([x], t) for x, t in ((key.as_py(), key.type), (tkey.as_py(), tkey.type), (no, pa.int32()), (at + chunk >= len(s), pa.bool_()), (min(chunk, len(s) - at), pa.int32()), (s[at : at + chunk + v.longest - 1], pa.string()))], ["doc_id", "tkey", "no", "last", "size", "s"])

    return run


def borders(v: Vocabulary, s: str, size: int) -> tuple[int, int] | None:
    """The first and the last place in [0, size] of a chunk that no piece reaches across, or None."""
    if not v.cuts:
        return None
    cuts = lambda i: i < len(s) and s[i] == SPACE and s[i - 1] != SPACE
    first = next((i for i in range(1, size) if cuts(i)), None)
    return None if first is None else (first, next(i for i in range(min(size, len(s) - 1), 0, -1) if cuts(i)))


def reach(v: Vocabulary, s: str, entries: list[float], begin: int, stop: int, size: int) -> tuple[list[float], list]:
    """Best scores of all places, from entry scores at begin, begin + 1, ..., over pieces that start in [begin, stop)."""
    best, back = [NONE] * (len(s) + 1), [None] * (len(s) + 1)
    for i, x in enumerate(entries):
        if begin + i < len(best):
            best[begin + i] = x
    v.forward(s, best, back, begin, stop)
    return best, back


def right_states(best: list[float], size: int, states: int) -> list[float]:
    return [best[size + j] if size + j < len(best) else NONE for j in range(states)]


def transfer(v: Vocabulary, s: str, size: int) -> np.ndarray:
    """The chunk's matrix [left state, right state]. With a cut inside it is head[left] + tail[right]; the constant between the
    two cuts changes no choice and is left out."""
    states = v.longest
    unit = lambda i: [NONE] * i + [0.0]
    if (cut := borders(v, s, size)) is not None:
        first, last = cut
        head = [reach(v, s[:first], unit(i), 0, first, size)[0][first] if i <= first else NONE for i in range(states)]
        tail = right_states(reach(v, s, [0.0], last, size, size)[0], size, states) if last <= size else [NONE] * states
        return np.array(head)[:, None] + np.array(tail)[None, :]
    return np.array([right_states(reach(v, s, unit(i), 0, size, size)[0], size, states) if i <= size else [0.0 if j == i - size else NONE for j in range(states)] for i in range(states)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus matrix product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def came_from(v: Vocabulary, s: str, size: int, left: np.ndarray) -> np.ndarray:
    """For each right state the left state that the best path to it comes from, given the scores of the left states; -1: no path."""
    states, out = v.longest, np.full(v.longest, -1, dtype=np.int32)
    cut = borders(v, s, size)
    if cut is not None and cut[1] <= size:
        first, last = cut
        best, back = reach(v, s[:first], list(left), 0, first, size)
        at = first
        while back[at] is not None:
            at = back[at][0]
        tail = right_states(reach(v, s, [0.0], last, size, size)[0], size, states)
        return np.where(np.array(tail) > NONE, at, -1).astype(np.int32)
    best, back = reach(v, s, list(left), 0, size, size)
    for j in range(states):
        at = size + j
        if at < len(best) and best[at] > NONE:
            while back[at] is not None:
                at = back[at][0]
            out[j] = at if at < size or size < states else -1
    return out


def _matrices(model_file: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_file)
        for f in frames:
            f["m"] = [transfer(v, s, n).tobytes() for s, n in zip(f["s"], f["size"], strict=True)]
            yield f[["doc_id", "tkey", "no", "m"]]

    return run


def _matrix(m: bytes) -> np.ndarray:
    n = round((len(m) // 8) ** 0.5)
    return np.frombuffer(m).reshape(n, n)


def _combine(f: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    f = f.sort_values("no")
    total = _matrix(f["m"].iloc[0])
    for m in f["m"].iloc[1:]:
        total = product(total, _matrix(m))
    return pd.DataFrame({"doc_id": f["doc_id"].iloc[:1], "tkey": f["tkey"].iloc[:1], "grp": f["grp"].iloc[:1], "m": [total.tobytes()]})


def _prefixes(order: str):
    """Scores of the left states of each row's chunk or group, in order, from the row's `left` if it has one, else from the document's start."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order)
        states = len(_matrix(f["m"].iloc[0]))
        at = np.frombuffer(f["left"].iloc[0]) if "left" in f else np.array([0.0] + [NONE] * (states - 1))
        out = []
        for m in f["m"]:
            out.append(at.tobytes())
            at = np.max(at[:, None] + _matrix(m), axis=0)
            at = at - at.max()
        return f[["doc_id", "tkey", order]].assign(left=out)

    return run


def _origins(model_file: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_file)
        for f in frames:
            f["origin"] = [came_from(v, s, n, np.frombuffer(x)).tobytes() for s, n, x in zip(f["s"], f["size"], f["left"], strict=True)]
            yield f[["doc_id", "tkey", "no", "grp", "left", "origin"]]

    return run


def _compose(f: pd.DataFrame) -> pd.DataFrame:
    """The group's map from its last chunk's right state to its first chunk's left state."""
    import pandas as pd

    f = f.sort_values("no", ascending=False)
    total = None
    for x in f["origin"]:
        m = np.frombuffer(x, dtype=np.int32)
        total = m if total is None else np.where(total >= 0, m[np.maximum(total, 0)], -1).astype(np.int32)
    return pd.DataFrame({"doc_id": f["doc_id"].iloc[:1], "tkey": f["tkey"].iloc[:1], "grp": f["grp"].iloc[:1], "origin": [total.tobytes()]})


def _suffixes(order: str):
    """The right state of each row's chunk or group, from the last to the first, from `right` of the rows, else from state 0 at the document's end."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, ascending=False)
        at = int(f["right"].iloc[0]) if "right" in f else 0
        out = []
        for x in f["origin"]:
            out.append(at)
            at = int(np.frombuffer(x, dtype=np.int32)[at])
        return f[["doc_id", "tkey", order]].assign(right=np.array(out, dtype=np.int32))

    return run


def _backtrace(model_file: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretches = stretches_of(model_file)
        v = stretches.v
        for f in (f.iloc[at : at + 64] for f in frames for at in range(0, len(f), 64)):
            ends, inner = [], []
            for s, size, left, right in zip(f["s"], f["size"], f["left"], f["right"], strict=True):
                cut, entries = borders(v, s, size), list(np.frombuffer(left))
                if cut is not None and cut[1] <= size:
                    first, last = cut
                    _, back = reach(v, s[:first], entries, 0, first, size)
                    _, end = reach(v, s, [0.0], last, size, size)
                    ends.append((v.ids_back(s, back, first)[0], v.ids_back(s, end, size + right, last)[0]))
                    inner.append(s[first:last])
                else:
                    _, back = reach(v, s, entries, 0, size, size)
                    ends.append((v.ids_back(s, back, size + right)[0], []))
                    inner.append("")
            ids, at = stretches.encode_all(inner)
            out = [np.concatenate([np.array(a, dtype="<i4"), ids[at[i] : at[i + 1]], np.array(b, dtype="<i4")]) for i, (a, b) in enumerate(ends)]
            yield f[["doc_id", "tkey", "no"]].assign(ids=out)

    return run


def _encode_giant(docs: DataFrame, model_file: str, chunk: int, fan: int) -> DataFrame:
    key = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey long"
    on = ["doc_id", "tkey"]
    chunks = docs.dropDuplicates(on).mapInArrow(_split(model_file, chunk), f"{key}, no int, last boolean, size int, s string")
    chunks = materialise(chunks.withColumn("grp", F.expr(f"no div {fan}").cast("int")), "chunks").repartition(F.xxhash64("doc_id", "tkey", "no"))

    def same(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        cond = [a[c].eqNullSafe(b[c]) for c in [*on, *more]]
        return a.join(b, cond).select(a["*"], *(b[c] for c in b.columns if c not in [*on, *more]))

    matrices = materialise(chunks.mapInPandas(_matrices(model_file), f"{key}, no int, m binary").withColumn("grp", F.expr(f"no div {fan}").cast("int")), "matrices")
    groups = matrices.groupBy(*on, "grp").applyInPandas(_combine, f"{key}, grp int, m binary")
    starts = groups.groupBy(*on).applyInPandas(_prefixes("grp"), f"{key}, grp int, left binary")
    lefts = same(matrices, starts, "grp").groupBy(*on, "grp").applyInPandas(_prefixes("no"), f"{key}, no int, left binary")
    origins = materialise(same(chunks, lefts, "no").mapInPandas(_origins(model_file), f"{key}, no int, grp int, left binary, origin binary"), "origins")
    ends = origins.groupBy(*on, "grp").applyInPandas(_compose, f"{key}, grp int, origin binary").groupBy(*on).applyInPandas(_suffixes("grp"), f"{key}, grp int, right int")
    rights = same(origins, ends, "grp").groupBy(*on, "grp").applyInPandas(_suffixes("no"), f"{key}, no int, right int")
    traced = same(same(chunks, origins.select(*on, "no", "left"), "no"), rights, "no").mapInPandas(_backtrace(model_file), f"{key}, no int, ids array<int>")
    return traced.groupBy(*on).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` ids each."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _decode(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = pa.array(vocabulary(model_file).spelt, pa.large_binary())
        for part in _slices(batches):
            # the taken pieces lie one after the other in one buffer, so a text is a range of it
            lists = part.column("ids")
            taken = spelt.take(lists.flatten())
            _, offsets, data = taken.buffers()
            joined, place = data.to_pybytes() if data else b"", np.frombuffer(offsets, dtype="<i8")
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = place[np.concatenate(([0], np.cumsum(count))).astype(np.int64)].tolist()
            texts = [joined[a:b].removeprefix(b" ").decode(errors="replace") for a, b in zip(ends, ends[1:])]
            yield pa.record_batch([*(part.column(c) for c in ("doc_id", "tkey", "ids")), pa.array(texts, pa.string())], ["doc_id", "tkey", "ids", "text"])

    return run


def _giant(chunk: int) -> Column:
    """Whether a text has more than chunk characters; only texts of more than chunk bytes are counted."""
    return (F.octet_length("text") > chunk) & (F.length("text") > chunk)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))


def _schema(docs: DataFrame, more: str = "") -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey long, ids array<int>{more}"


def _giant_rows(docs: DataFrame, model_file: str, chunk: int, fan: int) -> DataFrame:
    """doc_id, tkey and ids of the rows with texts of more than chunk characters."""
    giant = materialise(docs.where(_giant(chunk)), "giant")
    done = _encode_giant(giant, model_file, chunk, fan)
    joined = giant.select("doc_id", "tkey").alias("r").join(done.alias("d"), F.expr("r.doc_id <=> d.doc_id and r.tkey = d.tkey"))
    return joined.select("r.doc_id", "r.tkey", "d.ids")


def encode(docs: DataFrame, model_file: str | None = None, chunk: int = 32_768, fan: int = 64) -> DataFrame:
    """(doc_id, text) to (doc_id, tkey, ids), one row per row; tkey is the text's xxhash64."""
    model_file, docs = model_file or default_model(), _keyed(docs)
    short = docs.where(~_giant(chunk)).mapInArrow(lean(_encode_short(model_file)), _schema(docs))
    return short.unionByName(_giant_rows(docs, model_file, chunk, fan))


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, tkey, ids) to the same with text."""
    encoded = encoded.select("doc_id", "tkey", "ids")
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, tkey long, ids array<int>, text string"
    return encoded.mapInArrow(lean(_decode(model_file or default_model())), schema)


def _both(model_file: str):
    """Encoding and decoding of a short document in one Python worker."""
    encoder, decoder = _encode_short(model_file), _decode(model_file)
    return lambda batches: decoder(encoder(batches))


def encoded_and_decoded(docs: DataFrame, model_file: str | None = None, chunk: int = 32_768, fan: int = 64) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, and round_trip: whether the ids decode to the text (U+2581 as a space)."""
    # tkey travels with the ids: the decoded text must hash to it, unless the text itself holds U+2581
    model_file = model_file or default_model()
    docs = _keyed(docs.select("doc_id", F.replace(F.col("text"), F.lit(SPACE), F.lit(" ")).alias("text")))
    short = docs.where(~_giant(chunk)).mapInArrow(lean(_both(model_file)), _schema(docs, ", text string"))
    out = short.unionByName(decode(_giant_rows(docs, model_file, chunk, fan), model_file))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.xxhash64("text") == F.col("tkey")).alias("round_trip"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_decoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))

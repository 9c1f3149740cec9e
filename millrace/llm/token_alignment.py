"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the ids that stand for the same stretch.

Each text is encoded, after one space, by a byte-level BPE (A) and by a SentencePiece model (B), which adds that space itself; strings of
special tokens are plain text. The byte offsets where tokens of both end cut the tokens into groups, and each A token of a group is linked
with each B token of it.

Merging the two sorted lists of token ends is divided by merge paths: binary searches along evenly spaced diagonals of the grid (A ends, B ends)
find where the merge crosses them, so that every piece between two diagonals takes the same number of steps and none waits for another. A
piece emits the overlaps of A and B tokens in its part; where two pieces meet inside one token's end, their last and first overlap are
one, and stitching them tells which ends are shared, that is, the groups.

Texts are cut where no token of either vocabulary can reach across: before a space that follows no white space, if no piece of B holds a
space after another character. Such a stretch is encoded and aligned once as long as a task keeps it. A vocabulary without that
property works on whole texts.

1. Each text is aligned once and written with its distinct pairs and their links.
2. Tasks count the texts of each pair; Spark sums the counts and buckets them by pair.
3. At most KNOWN of the most frequent pairs are broadcast with their counts and added up for each text; its other pairs meet the table in a join.

Null and empty texts have no tokens; neither have texts whose joined bytes of A or B differ from the space and the text (say, with U+2581 in
them, which B spells as a space). Rows that share a doc_id are aligned, and counted as texts, each for itself. Bytes that aren't UTF-8 are read
as U+FFFD. Other columns are ignored. Memory: a text, its tokens, and the distinct pairs of one group.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import bucketed, discard, lean, least_of_most_frequent, materialise
from millrace.llm.words import text_batches

#: Most pairs that are broadcast with their counts.
KNOWN = 1 << 20
#: Steps of a merge between two diagonals.
STEPS = 4096
#: Stretches, and their characters, that a task keeps; distinct pairs that it counts before it hands them on.
KEPT, KEPT_CHARS, COUNTED = 400_000, 16_000_000, 1 << 20
#: Groups with more links than this are first reduced to their distinct ids.
LARGE_GROUP = 256
# Fixed value: how byte-level BPE splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STRETCH = re.compile(r" \s*\S+(?:[^\S ]\s*\S+)*(?:\s+\Z)?|\s+\Z")


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as themselves and the others, in order, as the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A: a tokenizers file with a byte-level BPE model. Where ids follow the order of merges, its vocabulary serves as ranks of the faster
    library; else the tokenizers library encodes."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        table, model = byte_of_character(), spec["model"]
        self.spelt: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.spelt[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        for t in spec["added_tokens"]:
            self.spelt[t["id"]] = t["content"].encode()
        special = {t["content"] for t in spec["added_tokens"]}
        ordinary = {self.spelt[i]: i for token, i in model["vocab"].items() if token not in special}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        pre = spec["pre_tokenizer"] or {}
        self.separable = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        in_order = [model["vocab"].get(m) for m in merges] == list(range(256, 256 + len(merges))) and sorted(i for t, i in ordinary.items() if len(t) == 1) == list(range(256))
        if self.separable and in_order and not model.get("ignore_merges"):
            import tiktoken

            self.encode = tiktoken.Encoding("A", pat_str=SPLIT, mergeable_ranks=ordinary, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(file)
            library.encode_special_tokens = True
            self.encode = lambda s: library.encode(s, add_special_tokens=False).ids


class Pieces:
    """B: a SentencePiece model."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.spelt = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        ordinary = [p for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        # pieces that hold no space after another character, and a model that leaves spaces and characters as they are
        self.separable = not any("▁" in p.lstrip("▁") for p in ordinary) and all(self.joined(t) == f" {t}".encode() for t in ("a", " a  b ", "ﬁ\n\tx", "  "))

    def joined(self, text: str) -> bytes:
        return b"".join(self.spelt[i] for i in self.model.encode(text))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that each begin with a space, which the model adds itself."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@lru_cache(maxsize=2)
def vocabularies(a_file: str, b_file: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_file), Pieces(b_file)


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of a's values are among the first d of the merge of a and b, for each diagonal d; of equal values a's comes first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        x, y = np.minimum(mid, max(len(a) - 1, 0)), np.clip(diagonals - 1 - mid, 0, max(len(b) - 1, 0))
        ahead = open_ & (a[x] <= b[y])
        low, high = np.where(ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece's merge of the ends a (tokens i and on) and b (tokens j and on): end of each overlap, its A token, its B token, and whether
    both tokens end there."""
    end = np.empty(len(a) + len(b), dtype=np.int64)
    end[np.arange(len(a)) + np.searchsorted(b, a, side="left")] = a
    end[np.arange(len(b)) + np.searchsorted(a, b, side="right")] = b
    end = end[np.append(True, end[1:] != end[:-1])] if len(end) else end
    a_at, b_at = np.searchsorted(a, end, side="left"), np.searchsorted(b, end, side="left")
    both = (np.searchsorted(a, end, side="right") > a_at) & (np.searchsorted(b, end, side="right") > b_at)
    return end, i + a_at, j + b_at, both


def groups(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each A token and of each B token, and the number of groups, from the tokens' ends (rising; the last ones equal)."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, steps), total)
    i = crossings(a, b, diagonals)
    j = diagonals - i
    parts = [overlaps(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]], int(i[p]), int(j[p])) for p in range(len(diagonals) - 1)]
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    end, a_at, b_at, both = (np.concatenate(x) for x in zip(*parts, strict=True))
    # a piece that ends between two equal ends hands the second to the next: the two overlaps are one, in which both tokens end. The
    # piece after it counts the A token as done, so the first of the two names the tokens.
    same = np.flatnonzero(end[1:] == end[:-1])
    both[same] = True
    keep = np.ones(len(end), dtype=bool)
    keep[same + 1] = False
    a_at, b_at, both = a_at[keep], b_at[keep], both[keep]
    number = np.cumsum(both) - both
    of_a, of_b = np.empty(len(a), dtype=np.int64), np.empty(len(b), dtype=np.int64)
    of_a[a_at], of_b[b_at] = number, number
    return of_a, of_b, int(both.sum())


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.cumsum([0, *map(len, lists)])
    return np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(bounds[-1])), bounds


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def linked(ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair (A id * 2**32 + B id) and number of links of all pairs of the groups; a pair may come more than once. The groups'
    tokens stand together."""
    p, q = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    begin_a, begin_b = np.cumsum(p) - p, np.cumsum(q) - q
    small = p * q <= LARGE_GROUP
    one = np.flatnonzero(small)
    # every A token of a small group next to the run of the group's B tokens
    a_rows = _spread(begin_a[one], p[one])
    g = of_a[a_rows]
    b_rows = _spread(begin_b[g], q[g])
    parts = [(np.repeat(g, q[g]), (np.repeat(ids_a[a_rows], q[g]) << 32) + ids_b[b_rows], np.ones(len(b_rows), dtype=np.int64))]
    for g in np.flatnonzero(~small):
        a, times_a = np.unique(ids_a[begin_a[g] : begin_a[g] + p[g]], return_counts=True)
        b, times_b = np.unique(ids_b[begin_b[g] : begin_b[g] + q[g]], return_counts=True)
        parts.append((np.full(len(a) * len(b), g), ((a << 32)[:, None] + b).ravel(), np.outer(times_a, times_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Codes(dict):
    """Numbers for strings, in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, s: str) -> int:
        n = self[s] = len(self)
        self.new.append(s)
        return n


class Stretches:
    """The stretches that a task has aligned, with what texts add up: tokens, groups and links, the groups' text, and the pairs."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = vocabularies(a_file, b_file)
        self.split = _STRETCH.findall if self.a.separable and self.b.separable else lambda s: [s]
        self.size_a, self.size_b = (np.array([len(x) for x in t.spelt]) for t in (self.a, self.b))
        # ids as text, followed by a comma or by what ends a group's A tokens and its B tokens
        self.told_a, self.told_b = (np.array([[f"{i},", f"{i}{end}"] for i in range(len(t.spelt))], dtype=object) for t, end in ((self.a, "|"), (self.b, ";")))
        self.clear()

    def clear(self) -> None:
        self.code, self.chars, self.text = _Codes(), 0, []
        #: columns: is right, n_a, n_b, n_groups, n_links
        self.sums = np.zeros((0, 5), dtype=np.int64)
        self.pair, self.times, self.bounds = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def full(self) -> bool:
        return len(self.code) > KEPT or self.chars > KEPT_CHARS

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the stretches of the texts, and the texts' bounds among them; new stretches are aligned."""
        parts = [self.split(f" {t}") if t else [] for t in texts]
        bounds = np.cumsum([0, *map(len, parts)])
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(parts)), dtype=np.int64, count=int(bounds[-1]))
        if self.code.new:
            self._align(self.code.new)
            self.code.new = []
        return codes, bounds

    def _align(self, new: list[str]) -> None:
        self.chars += sum(map(len, new))
        in_a, in_b = [self.a.encode(s) for s in new], self.b.encode(new)
        a, bounds_a = _flat(in_a)
        b, bounds_b = _flat(in_b)
        spelt = [s.encode() for s in new]
        right = np.ones(len(new), dtype=bool)
        ends = np.cumsum([0, *map(len, spelt)])
        same = all(
            np.array_equal(np.concatenate(([0], np.cumsum(size[ids])))[bounds], ends) and b"".join(map(t.spelt.__getitem__, ids.tolist())) == b"".join(spelt)
            for t, size, ids, bounds in ((self.a, self.size_a, a, bounds_a), (self.b, self.size_b, b, bounds_b))
        )
        if not same:  # some stretch is spelt otherwise: told one by one
            right = np.array([b"".join(map(self.a.spelt.__getitem__, x)) == s and b"".join(map(self.b.spelt.__getitem__, y)) == s for s, x, y in zip(spelt, in_a, in_b, strict=True)], dtype=bool)
            (a, bounds_a), (b, bounds_b) = (_flat([x if ok else [] for x, ok in zip(ids, right, strict=True)]) for ids in (in_a, in_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        of_a, of_b, n = groups(ends_a, ends_b)
        n_a, n_b = np.diff(bounds_a), np.diff(bounds_b)
        p, q = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        # a stretch ends where both tokens end, so groups don't reach across stretches
        last = np.zeros(len(new) + 1, dtype=np.int64)
        some = np.flatnonzero(right & (n_a > 0))
        last[1:][some] = of_a[bounds_a[some + 1] - 1] + 1
        last = np.maximum.accumulate(last)
        owner = np.repeat(np.arange(len(new)), np.diff(last))
        group, pair, times = linked(a, of_a, b, of_b, n)
        # pairs of a stretch once each
        order = np.lexsort((pair, owner[group]))
        at, pair, times = owner[group][order], pair[order], times[order]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
        at, pair, times = at[first], pair[first], np.add.reduceat(times, first) if len(first) else times
        links = np.bincount(owner, p * q, len(new)).astype(np.int64)
        self.sums = np.concatenate((self.sums, np.stack((right, n_a, n_b, np.diff(last), links), axis=1)))
        self.pair, self.times = np.concatenate((self.pair, pair)), np.concatenate((self.times, times))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(np.bincount(at, minlength=len(new)))))
        # the groups' text: of each group its A tokens, then its B tokens, each with what follows it
        before = np.concatenate(([0], np.cumsum(p + q)))
        place_a = before[of_a] + np.arange(len(a)) - (np.cumsum(p) - p)[of_a]
        place_b = before[of_b] + p[of_b] + np.arange(len(b)) - (np.cumsum(q) - q)[of_b]
        told = np.empty(len(a) + len(b), dtype=object)
        told[place_a] = self.told_a[a, np.append(of_a[1:] != of_a[:-1], True).astype(int)[: len(a)]]
        told[place_b] = self.told_b[b, np.append(of_b[1:] != of_b[:-1], True).astype(int)[: len(b)]]
        told, cut = told.tolist(), before[last].tolist()
        self.text += ["".join(told[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def right(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts have all their stretches spelt as they are, and some."""
        n = np.diff(bounds)
        wrong = np.bincount(np.repeat(np.arange(len(n)), n), 1 - self.sums[codes, 0], len(n))
        return (n > 0) & (wrong == 0)

    def pairs(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, pair and links of the pairs that the owners' stretches keep, once for each owner and pair."""
        both, many = np.unique((owner << 32) + codes, return_counts=True)
        owner, codes = both >> 32, both & 0xFFFFFFFF
        size = self.bounds[codes + 1] - self.bounds[codes]
        rows = _spread(self.bounds[codes], size)
        number, pair = np.repeat(owner, size), self.pair[rows]
        times = self.times[rows] * np.repeat(many, size)
        order = np.argsort(pair, kind="stable")
        order = order[np.argsort(number[order], kind="stable")]
        number, pair, times = number[order], pair[order], times[order]
        first = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
        return number[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def _texts(raw: list[bytes]) -> list[str]:
    return [t.decode(errors="replace") for t in raw]


_SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def _measure(a_file: str, b_file: str):
    """uid, doc_id, the sums, the digest of the groups, and the distinct pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Stretches(a_file, b_file)
        for batch, raw in text_batches(batches, "text"):
            codes, bounds = s.codes(_texts(raw))
            right = s.right(codes, bounds)
            owner = np.repeat(np.arange(len(raw)), np.diff(bounds))
            mine = right[owner]
            codes, owner = codes[mine], owner[mine]
            sums = [pa.array(x) for x in np.ascontiguousarray(_sums(s.sums[codes, 1:], owner, len(raw)).T)]
            cut = np.searchsorted(owner, np.arange(len(raw) + 1)).tolist()
            text, number = s.text, codes.tolist()
            digests = [hashlib.sha256("".join([text[c] for c in number[b:e]])[:-1].encode()).hexdigest() if ok else "" for ok, b, e in zip(right.tolist(), cut[:-1], cut[1:], strict=True)]
            of, pair, times = s.pairs(codes, owner)
            offsets = pa.array(np.searchsorted(of, np.arange(len(raw) + 1)).astype(np.int32))
            pairs, links = pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times))
            yield pa.record_batch([batch.column("uid"), batch.column("doc_id"), *sums, pa.array(digests, pa.string()), pairs, links], ["uid", "doc_id", *_SUMS, "groups_sha256", "pairs", "links"])
            if s.full():
                s.clear()

    return run


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of whole numbers by owner (rising)."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), dtype=np.int64), np.cumsum(values, axis=0)))
    cut = np.searchsorted(owner, np.arange(n + 1))
    return total[cut[1:]] - total[cut[:-1]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def united(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def rows(parts):
        keys, n = united(parts)
        return pa.record_batch([pa.array(keys), pa.array(n)], ["pair", "n"])

    for batch in batches:
        held.append(np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True))
        size += len(held[-1][0])
        if size > 2 * COUNTED:
            held = [united(held)]
            size = len(held[0][0])
            if size > COUNTED:
                yield rows(held)
                held, size = [], 0
    if held:
        yield rows(held)


def count_pairs(measured: DataFrame) -> DataFrame:
    """Texts' distinct pairs to the bucketed table of (pair, n: texts that hold it, best: whether n is the highest of its A id)."""
    counted = materialise(measured.select("pairs").mapInArrow(lean(_count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    a = F.shiftright("pair", 32)
    # a row for each id of A: bounded by its vocabulary
    highest = counted.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    table = counted.withColumn("a", a).join(F.broadcast(highest), "a")
    return bucketed(table.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")).repartition("pair"), "pair", "pairs")


def _add(shared):
    """Add what the broadcast pairs come to for each text, and keep the others to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pair, times = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy()
            n = batch.num_rows
            owner = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
            where = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[where] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            at, links = where[known], times[known]
            sums = [pa.array(_sums(links * x[at], owner[known], n)) for x in (best, count)]
            offsets = pa.array(np.searchsorted(owner[~known], np.arange(n + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (pair, times)]
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", *_SUMS, "groups_sha256")), *sums, *rest], ["uid", "doc_id", *_SUMS, "groups_sha256", "n_best", "count_sum", "tail", "links"])

    return run


def _list_groups(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Stretches(a_file, b_file)
        for batch, raw in text_batches(batches, "text"):
            codes, bounds = s.codes(_texts(raw))
            out = []
            for ok, b, e in zip(s.right(codes, bounds), bounds[:-1], bounds[1:], strict=True):
                rows = "".join([s.text[c] for c in codes[b:e]])[:-1].split(";") if ok else []
                out.append([dict(zip("ab", ([int(x) for x in side.split(",")] for side in g.split("|")), strict=True)) for g in rows])
            kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "groups"])
            if s.full():
                s.clear()

    return run


def aligned_groups(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(doc_id, text) to (doc_id, groups): the groups in order, each with its A ids and its B ids; none for texts without tokens."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(lean(_list_groups(a_file, b_file)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups array<struct<a: array<int>, b: array<int>>>")


def align_tokens(docs: DataFrame, a_file: str, b_file: str, known: int = KNOWN) -> DataFrame:
    """(doc_id, text) to doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of its A id), count_sum (over
    links) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`). A pair's count is the number of texts that hold it linked."""
    docs = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    fixed = f"uid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in _SUMS)}, groups_sha256 string"
    measured = materialise(docs.mapInArrow(lean(_measure(a_file, b_file)), f"{fixed}, pairs array<long>, links array<long>"), "aligned")
    table = count_pairs(measured)
    least = least_of_most_frequent(table, "n", known)
    top = table.where(F.col("n") >= least).select("pair", "n", "best").toArrow()  # at most `known` rows
    keys = top["pair"].to_numpy()
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], top["best"].to_numpy(zero_copy_only=False).astype(np.int64)[order]))
    added = materialise(measured.mapInArrow(lean(_add(shared)), f"{fixed}, n_best long, count_sum long, tail array<long>, links array<long>"), "added")
    shared.destroy()
    discard(measured)
    rest = added.select("uid", F.explode(F.arrays_zip("tail", "links")).alias("t")).select("uid", F.col("t.tail").alias("pair"), F.col("t.links").alias("links"))
    rest = rest.join(table, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return added.join(rest, "uid", "left").select("doc_id", *_SUMS, plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


@lru_cache(maxsize=1)
def public_files() -> tuple[str, str]:
    """The public tokenizer files of this box; the operators take any other paths."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), *public_files())

"""A hidden Markov language model over whole corpora: Baum-Welch by partitions, exact likelihoods by the scaled forward recursion.

Tokens are the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and one end for each text. A latent state emits a token's class, and the class
emits the token, so that P(token | state) = P(class | state) * P(token | class). Each of the most frequent training words (at most
OWN) and the end have a class of their own; all other words, whether seen or not, share a class with those of their shape
(length, first and last byte). In a shared class of N_c tokens and V_c distinct words in training a word seen c times has (c + 1) / (N_c + V_c + 1), and
what was never seen has 1 / (N_c + V_c + 1). The states' parameters are therefore of bounded size, while the words' counts are a
table that grows with the corpus and is joined, never collected.

1. Words of all texts are counted, in tasks first, by 64-bit hash; the table is bucketed by the hash.
2. Each text is written once as a sequence of classes. At most KNOWN frequent words are broadcast with their counts; the others of a
   text are kept as (hash, times) and meet the table in one join.
3. Each round of Baum-Welch reads the training sequences; tasks add up expected counts of starts, moves and emissions, and Spark sums them.
4. Scores are the forward recursion's over the classes plus the words' parts within their classes.

Texts are worked on together, one place of all of them at a time. A text of more than PIECE tokens is cut in pieces; the transfer
matrices of its pieces, all computed at once, give the exact messages at the pieces' ends, so that nothing is approximated and no step waits
for a whole long text. A null text is empty, and an empty text has the end only. Rows that share a doc_id are scored each for itself; a null
doc_id counts as not held out. Without training texts all words are unknown. Bytes that aren't UTF-8 are parts of words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import bucketed, lean, least_of_most_frequent, materialise
from millrace.llm.words import text_batches, word_hashes

#: Most words with a class of their own, and most words that are broadcast with their counts.
OWN, KNOWN = 1 << 15, 1 << 18
#: Tokens of a piece, and tokens that a task works on together.
PIECE, TOGETHER = 4096, 1 << 18
#: Places between two scalings of a recursion.
EVERY = 8
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 19
#: Weight of the classes' overall shares in each state's emissions.
PRIOR = 200.0
END = np.uint64(0x9E6C63D0876A9A47)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: kind of a byte: digit, a-m, n-z, outside ASCII, other
_KIND = np.array([0 if 48 <= b <= 57 else 1 if 97 <= (b | 32) <= 109 else 2 if 110 <= (b | 32) <= 122 else 3 if b >= 128 else 4 for b in range(256)], dtype=np.int64)
_LENGTHS = np.array([4, 7, 11])
SHAPES = 5 * 5 * (len(_LENGTHS) + 1)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each word of the texts, and where each text's words begin (n + 1 offsets)."""
    h, bounds = word_hashes(texts, lower=True)
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    first, last = edge[0::2] + 1, edge[1::2]
    shape = (np.searchsorted(_LENGTHS, last - first + 1, side="right") * 5 + _KIND[data[first]]) * 5 + _KIND[data[last]]
    return h, shape, bounds


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, shape, train, every = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, at, where = np.unique(h, return_index=True, return_inverse=True)
    return keys, shape[at], np.bincount(where, train, len(keys)).astype(np.int64), np.bincount(where, every, len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def rows(parts):
        h, shape, train, every = _merged(parts)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(shape.astype(np.int32)), pa.array(train), pa.array(every)], ["h", "shape", "n", "n_all"])

    for batch, texts in text_batches(batches, "text"):
        h, shape, bounds = tokens(texts)
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        h, shape = np.append(h, END), np.append(shape, -1)  # the ends of all texts together
        weight = np.append(np.repeat(train, np.diff(bounds)), train.sum()).astype(np.int64)
        every = np.append(np.ones(len(h) - 1, dtype=np.int64), len(texts))
        held.append(_merged([(h, shape, weight, every)]))
        size += len(held[-1][0])
        if size > 2 * COUNTED:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > COUNTED:
                yield rows(held)
                held, size = [], 0
    if held:
        yield rows(held)


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def count_words(docs: DataFrame) -> DataFrame:
    """(text, held_out) to the bucketed table of (h, shape, n: times in training texts, n_all: times in all), the end among its rows."""
    counted = docs.select("held_out", "text").mapInArrow(lean(_count), "h long, shape int, n long, n_all long")
    return bucketed(counted.groupBy("h").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"), F.sum("n_all").alias("n_all")), "h", "words")


class Lexicon:
    """What is broadcast of the counts: the frequent words with their counts and classes, and the totals of the shared classes.
    Class 0 is the end, then come the words with a class of their own, then the shapes."""

    def __init__(self, counts: DataFrame, own: int = OWN, known: int = KNOWN):
        t_own, t_all = least_of_most_frequent(counts, "n", own), least_of_most_frequent(counts, "n_all", known)
        top = counts.where(((F.col("n") >= t_own) | (F.col("n_all") >= t_all)) & (F.col("shape") >= 0)).select("h", "shape", "n").toArrow()
        h = top["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        shape, self.hash, self.n = top["shape"].to_numpy()[order], h[order], top["n"].to_numpy()[order]
        mine = self.n >= t_own
        self.own = int(mine.sum())
        self.shared = self.own + 1
        self.classes = self.shared + SHAPES
        self.klass = np.where(mine, np.cumsum(mine), self.shared + shape)
        sums = counts.groupBy().agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.sum(F.when(F.col("shape") < 0, F.col("n"))).alias("ends")).first()
        self.total, self.distinct = int(sums["n"] or 0), int(sums["v"] or 0)
        size = np.zeros(self.classes)
        self.ends = int(sums["ends"] or 0)
        size[0] = self.ends
        size[self.klass[mine]] = self.n[mine]
        self.room = np.ones(SHAPES)  # N_c + V_c + 1 of the shared classes
        rest = counts.where((F.col("shape") >= 0) & (F.col("n") > 0) & (F.col("n") < t_own)).groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
        for r in rest.collect():  # at most SHAPES rows
            size[self.shared + r["shape"]] = r["n"]
            self.room[r["shape"]] += r["n"] + r["v"]
        self.share = (size + 1) / (size.sum() + self.classes)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the lexicon of each hash, and whether it is there."""
        if not len(self.hash):
            return np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=bool)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return at, self.hash[at] == h


def _by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between the bounds."""
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), values, len(bounds) - 1).astype(np.float64)


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Lexicon = shared.value
        end = np.log10(1.0 + x.ends)
        for batch, texts in text_batches(batches, "text"):
            h, shape, bounds = tokens(texts)
            some, where = np.unique(h, return_inverse=True)
            at, found = x.find(some)
            at, found = at[where], found[where]
            klass = np.where(found, x.klass[at] if len(x.klass) else 0, x.shared + shape)
            times = np.where(found, x.n[at] if len(x.n) else 0, 0)
            log_c = np.log10(1.0 + times)
            n = np.diff(bounds)
            # the end follows each text's words
            codes = np.insert(klass, bounds[1:], 0).astype("<u2" if x.classes <= 1 << 16 else "<u4")
            cut = bounds + np.arange(len(bounds))
            raw = codes.tobytes()
            width = codes.itemsize
            sequences = [raw[s * width : e * width] for s, e in zip(cut[:-1], cut[1:], strict=True)]
            rest = np.flatnonzero(~found)
            marks = np.searchsorted(rest, bounds)
            tails = [np.unique(h[rest[s:e]].view(np.int64), return_counts=True) for s, e in zip(marks[:-1], marks[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(t[0]) for t in tails]), pa.int32()), pa.array(np.concatenate([t[0] for t in tails]) if tails else [], pa.int64()))
            many = pa.ListArray.from_arrays(lists.offsets, pa.array(np.concatenate([t[1] for t in tails]) if tails else [], pa.int64()))
            made = [
                pa.array(n + 1, pa.int64()),
                pa.array((_by_text(times > 0, bounds) + (x.ends > 0)).astype(np.int64)),
                pa.array(_by_text(log_c, bounds) + end),
                pa.array(_by_text(np.where(klass >= x.shared, log_c, 0.0), bounds)),
                pa.array(sequences, pa.binary()),
                lists,
                many,
            ]
            yield pa.record_batch([*(batch.column(c) for c in ("uid", "doc_id", "held_out")), *made], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "log_shared", "codes", "tail", "times"])

    return run


class Model:
    """Start, moves (from, to) and emissions (class, state) of the latent states, the emissions also over the greatest of their class.

    With start and moves of at least 1e-13 (training adds one to each count) a step over these relative emissions shrinks a distribution's
    sum to no less than 1e-13 of it, so that EVERY steps may pass between two scalings.
    """

    def __init__(self, start: np.ndarray, moves: np.ndarray, emits: np.ndarray):
        self.start, self.moves, self.emits = start, moves, emits
        most = emits.max(1)
        self.relative, self.log_most = emits / most[:, None], np.log(most)

    @classmethod
    def initial(cls, share: np.ndarray, states: int, seed: int = 11) -> "Model":
        random = np.random.default_rng(seed)
        emits = share[:, None] * random.uniform(0.2, 1.8, (len(share), states))
        moves = 0.85 * np.eye(states) + 0.15 * random.dirichlet(np.full(states, 5.0), states)
        return cls(random.dirichlet(np.full(states, 5.0)), moves, emits / emits.sum(0))


class _Pieces:
    """The pieces that sequences are cut in. codes lie between the bounds, at least one for each sequence."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, piece: int):
        n = np.diff(bounds)
        self.each = np.maximum(1, -(-n // piece))
        self.doc = np.repeat(np.arange(len(n)), self.each)
        self.nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.each) - self.each, self.each)
        self.begin = bounds[self.doc] + self.nth * piece
        self.size = np.minimum(bounds[self.doc + 1], self.begin + piece) - self.begin
        self.codes = codes
        self.long = self.each[self.doc] > 1


class _Sweep:
    """Some pieces side by side, longest first: place t of all that have one lies in row cut[t] to cut[t + 1] of every array."""

    def __init__(self, m: Model, p: _Pieces, some: np.ndarray):
        self.m, self.order = m, some[np.argsort(-p.size[some], kind="stable")]
        size = p.size[self.order]
        self.longest = int(size[0]) if len(size) else 0
        self.alive = len(size) - np.searchsorted(size[::-1], np.arange(self.longest), side="right")
        self.cut = np.concatenate(([0], np.cumsum(self.alive)))
        self.place = np.repeat(np.arange(self.longest), self.alive)
        self.row = np.arange(self.cut[-1]) - self.cut[self.place]
        self.codes = np.take(p.codes, np.take(p.begin[self.order], self.row) + self.place)
        self.emits = np.take(m.relative, self.codes, axis=0)
        self.last = self.cut[size - 1] + np.arange(len(size))  # of each piece

    def forward(self, into: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward recursion from the distributions `into` of the first states: all rows' values, the factor that each row was divided by,
        and the log of each piece's likelihood (in sweep order)."""
        a, scale = np.empty_like(self.emits), np.ones(len(self.emits))
        before = into
        for t in range(self.longest):
            here = slice(self.cut[t], self.cut[t + 1])
            now = a[here]
            if t:
                np.matmul(before[: self.alive[t]], self.m.moves, out=now)
                now *= self.emits[here]
            else:
                np.multiply(into, self.emits[here], out=now)
            if t % EVERY == 0:
                s = now @ _ones(now)
                now /= s[:, None]
                scale[here] = s
            before = now
        log = np.log(a[self.last] @ _ones(a)) + np.bincount(self.row, np.log(scale) + self.m.log_most[self.codes], len(self.order))
        return a, scale, log

    def backward(self, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the likelihood, up to a factor, of what follows it, and of what begins with it, for each state of the row; out has the
        former for the pieces' last rows, in sweep order."""
        b, w = np.empty_like(self.emits), np.empty_like(self.emits)
        done = 0
        for t in range(self.longest - 1, -1, -1):
            here = slice(self.cut[t], self.cut[t + 1])
            now = b[here]
            if t < self.longest - 1:
                np.matmul(w[self.cut[t + 1] : self.cut[t + 2]], self.m.moves.T, out=now[:done])
            now[done:] = out[done : self.alive[t]]
            done = self.alive[t]
            if t % EVERY == 0:
                now /= (now @ _ones(now))[:, None]
            np.multiply(now, self.emits[here], out=w[here])
        return b, w


def _ones(a: np.ndarray) -> np.ndarray:
    return np.ones(a.shape[1])


def _messages(m: Model, p: _Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the distribution of its first state given what is before, and the likelihood, up to a factor, of all that follows
    the piece for each state of its last token. Pieces of long texts get both from the product of their transfer matrices."""
    k = len(m.start)
    into, out = np.tile(m.start, (len(p.doc), 1)), np.ones((len(p.doc), k))
    some = np.flatnonzero(p.long)
    if len(some):
        matrix = np.empty((len(p.doc), k, k))
        most = max(1, TOGETHER // (k * int(p.size[some].max())))
        for i in range(0, len(some), most):
            part = some[i : i + most]
            sweep = _Sweep(m, p, np.repeat(part, k))
            a, _, log = sweep.forward(np.tile(np.eye(k), (len(part), 1)))
            last, log = a[sweep.last].reshape(-1, k, k), log.reshape(-1, k)  # the k rows of a piece stay together: the order is stable
            last /= last.sum(2, keepdims=True)
            matrix[sweep.order[::k]] = last * np.exp(log - log.max(1, keepdims=True))[:, :, None]
        for i in np.flatnonzero(p.long & (p.nth > 0)):
            v = into[i - 1] @ matrix[i - 1] @ m.moves
            into[i] = v / v.sum()
        for i in np.flatnonzero(p.long)[::-1]:
            if p.nth[i] < p.each[p.doc[i]] - 1:
                v = m.moves @ (matrix[i + 1] @ out[i + 1])
                out[i] = v / v.sum()
    return into, out


def log_likelihoods(m: Model, codes: np.ndarray, bounds: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Natural log of each sequence's exact likelihood; codes lie between the bounds, at least one for each sequence."""
    p = _Pieces(codes, bounds, piece)
    into, _ = _messages(m, p)
    sweep = _Sweep(m, p, np.arange(len(p.doc)))
    # pieces go on from the exact distribution before them, so their logs add up
    return np.bincount(p.doc[sweep.order], sweep.forward(into[sweep.order])[2], len(bounds) - 1)


class Expected:
    """Expected counts: starts, moves before they are weighed by the model's moves, emissions by class; and the log likelihood."""

    def __init__(self, classes: int, states: int):
        self.start, self.moves, self.emits, self.log = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states)), 0.0

    def add(self, m: Model, codes: np.ndarray, bounds: np.ndarray, piece: int = PIECE) -> None:
        p = _Pieces(codes, bounds, piece)
        into, out = _messages(m, p)
        sweep = _Sweep(m, p, np.arange(len(p.doc)))
        a, scale, log = sweep.forward(into[sweep.order])
        b, w = sweep.backward(out[sweep.order])
        self.log += float(log.sum())
        ones = _ones(a)
        b *= a
        z = b @ ones
        b /= z[:, None]  # the states' shares of each token
        # a row before its division is what its predecessor moves to, so z * scale is the sum over both states
        w /= (z * scale)[:, None]
        first = int(sweep.cut[1]) if sweep.longest else 0
        self.moves += np.take(a, sweep.cut[sweep.place[first:] - 1] + sweep.row[first:], axis=0).T @ w[first:]
        at = np.empty(len(p.doc), dtype=np.int64)
        at[sweep.order] = np.arange(len(p.doc))  # rows of the pieces' first tokens
        later = np.flatnonzero(p.nth > 0)
        if len(later):  # moves from a piece's last token to the next piece's first
            before, ahead = a[sweep.last[at[later - 1]]], w[at[later]]
            self.moves += before.T @ (ahead / ((before @ m.moves) * ahead).sum(1)[:, None])
        self.start += b[at[p.nth == 0]].sum(0)
        for s, share in enumerate(np.ascontiguousarray(b.T)):
            self.emits[:, s] += np.bincount(sweep.codes, share, len(self.emits))


def _sequences(batches: Iterator[pa.RecordBatch], wide: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about TOGETHER tokens, their codes and bounds."""
    kind = np.dtype("<u4" if wide else "<u2")
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column("codes").cast(pa.large_binary()).buffers()[1], dtype=np.int64)[batch.column("codes").offset :][: batch.num_rows + 1]) // kind.itemsize
        total = np.concatenate(([0], np.cumsum(sizes)))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + TOGETHER, side="right")) - 1)
            part = batch.slice(begin, end - begin)
            raw = b"".join(x.as_buffer().to_pybytes() for x in part.column("codes"))
            yield part, np.frombuffer(raw, dtype=kind).astype(np.int64), total[begin : end + 1] - total[begin]
            begin = end


def _expect(shared, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        k = len(m.start)
        e = Expected(len(m.emits), k)
        for _, codes, bounds in _sequences(batches, wide):
            e.add(m, codes, bounds)
        some = np.flatnonzero(e.emits.sum(1))
        # rows: emissions by class, then -1 starts, -2 the log likelihood, -3 and below the moves from each state
        at = np.concatenate((some, [-1, -2], -3 - np.arange(k)))
        values = np.concatenate((e.emits[some], e.start[None], np.full((1, k), e.log), e.moves))
        yield pa.record_batch([pa.array(at, pa.int64()), *(pa.array(np.ascontiguousarray(values[:, s])) for s in range(k))], ["at", *(f"s{s}" for s in range(k))])

    return run


def baum_welch(coded: DataFrame, x: Lexicon, states: int, rounds: int) -> tuple[Model, list[float]]:
    """Train on the rows of coded that aren't held out; also the natural log likelihood of the training texts' classes before each round."""
    sc, train, logs = coded.sparkSession.sparkContext, coded.where("not held_out").select("codes"), []
    m = Model.initial(x.share, states)
    names = [f"s{s}" for s in range(states)]
    for _ in range(rounds):
        model = sc.broadcast(m)
        sums = train.mapInArrow(lean(_expect(model, x.classes > 1 << 16)), f"at long, {', '.join(f'{c} double' for c in names)}").groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        model.destroy()
        at, values = sums["at"].to_numpy(), np.stack([sums[c].to_numpy() for c in names], axis=1) if sums.num_rows else np.zeros((0, states))
        if not (at == -1).any():  # no training texts
            break
        start, moves, emits = np.full(states, 1.0), np.full((states, states), 1.0), PRIOR * np.repeat(x.share[:, None], states, axis=1)
        logs.append(float(values[at == -2][0, 0]))
        start += values[at == -1][0]
        moves[-3 - at[at <= -3]] += values[at <= -3] * m.moves[-3 - at[at <= -3]]
        emits[at[at >= 0]] += values[at >= 0]
        m = Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
    return m, logs


def _score(shared, wide: bool):
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "log_c", "log_shared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, room, first = shared.value
        cost = np.concatenate((np.zeros(first), np.log10(room)))
        for part, codes, bounds in _sequences(batches, wide):
            log = log_likelihoods(m, codes, bounds) / np.log(10.0) - _by_text(cost[codes], bounds)
            yield pa.record_batch([*(part.column(c) for c in names), pa.array(log)], [*names, "log_classes"])

    return run


def score_texts(docs: DataFrame, states: int = 8, rounds: int = 4, own: int = OWN, known: int = KNOWN) -> DataFrame:
    """docs (doc_id, text, held_out) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram with one added to each
    count) and score (hidden Markov model), both log10 of the whole text's probability. Learns from the rows that aren't held out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "held_out", "text")
    counts = count_words(docs)
    x = Lexicon(counts, own, known)
    lexicon = sc.broadcast(x)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_c double, log_shared double, codes binary, tail array<long>, times array<long>"
    coded = docs.select(F.monotonically_increasing_id().alias("uid"), "*").mapInArrow(lean(_code(lexicon)), schema)
    coded = materialise(coded.sortWithinPartitions(F.length("codes")), "coded")  # texts of like length work side by side
    lexicon.destroy()
    m, _ = baum_welch(coded, x, states, rounds)
    # words that aren't broadcast; those never seen add nothing
    tails = coded.select("uid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("uid", F.col("t.tail").alias("h"), F.col("t.times").alias("times"))
    seen = tails.join(counts.where("n > 0").select("h", "n"), "h").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_c"), F.sum("times").alias("tail_known"))
    model = sc.broadcast((m, x.room, x.shared))
    scored = coded.drop("tail", "times").mapInArrow(lean(_score(model, x.classes > 1 << 16)), f"uid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, log_c double, log_shared double, log_classes double")
    tail_c = F.coalesce("tail_c", F.lit(0.0))
    return scored.join(seen, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(x.total).cast("long").alias("train_tokens"),
        (F.col("log_c") + tail_c - F.col("n_tokens") * F.lit(float(np.log10(x.total + x.distinct + 1)))).alias("base_score"),
        (F.col("log_classes") + F.col("log_shared") + tail_c).alias("score"),
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")))

"""Secret scanning: pattern findings, and a character convolutional network over every other candidate in its context.

Base findings (always kept), leftmost non-overlapping for each kind: `assign`, `access` and `hex`, as in PATTERNS. A
*candidate* is every stretch of at least 16 characters outside the base findings of a maximal run of [A-Za-z0-9+/_=-]. The network, in
numpy, reads 48 characters of the candidate with the 24 characters before them and the 8 after the candidate; it reads a longer
candidate at every STEP characters to its end, and the largest score counts. It has one-hot characters, 24 filters of width 5, maximum and mean over places, and a dense layer. It is trained when first needed on labelled findings that
a seeded generator makes (LABELLED of them; no table is read), with its score calibrated by Platt scaling on a held-out part.
The threshold is the highest that keeps RECALL of the held-out secrets. Candidates at or above it become findings of kind `model`.

Offsets are in code points, end exclusive. Null or empty texts have no findings. Whole texts are read, of any length; equal
texts get equal findings, one output row for each row. Bytes that aren't UTF-8 are read as U+FFFD. Documents' other columns, whatever
their names, pass unchanged in a struct.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import lean

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
BEFORE, BODY, AFTER = 24, 48, 8
WIDTH = BEFORE + BODY + AFTER
#: Distance of the places at which long candidates are read.
STEP = 8
LABELLED, RECALL = 5000, 0.98
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:;,\"' <>()[]{}@#$%&*|\n"
CODE = np.full(256, len(ALPHABET) + 1, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = _i + 1
SYMBOLS = len(ALPHABET) + 2
_RUN = np.zeros(256, dtype=bool)
_RUN[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"]] = True


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    out = []
    if KEYWORDS.search(text):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Stretches of runs outside the base findings, which are by start."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][2] <= s:
            k += 1
        at = k
        while at < len(base) and base[at][1] < e:
            if base[at][1] - s >= LEAST:
                out.append((s, base[at][1]))
            s, at = max(s, base[at][2]), at + 1
        if e - s >= LEAST:
            out.append((s, e))
    return out


def places(start: int, end: int) -> range:
    """Where a candidate is read: at its start and, if it is longer than the body, every STEP characters while LEAST are left."""
    return range(start, end - LEAST + 1 if end - start > BODY else start + 1, STEP)


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of the candidate in its context; 0 where there is nothing."""
    out = np.zeros(WIDTH, dtype=np.int64)
    for at, part in ((BEFORE - min(BEFORE, start), text[max(0, start - BEFORE) : start]), (BEFORE, text[start : min(end, start + BODY)]), (BEFORE + BODY, text[end : end + AFTER])):
        if part:
            out[at : at + len(part)] = CODE[np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8)]
    return out


# ---- labelled findings


def labelled(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """n generated (text, start, end, 1 for a secret else 0): tokens of many forms, in prose and code of several forms."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    chars = lambda a, k: "".join(a[i] for i in rng.integers(0, len(a), k))
    syllables = ["th", "on", "er", "tion", "ing", "ea", "ver", "lich", "ment", "ci", "do", "qu", "st", "re", "en", "ung", "eau", "mos", "ar", "le", "sch", "keit", "heit", "ber", "pf", "ach", "ble", "nd", "ou", "wh", "sh", "qua", "ez", "lles", "aux", "oi", "ge", "zu"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    secrets = [
        lambda: chars(lower + upper + digits + "+/", int(rng.integers(20, 64))) + pick(["", "=", "=="]),
        lambda: pick(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_", "npm_"]) + chars(lower + upper + digits, int(rng.integers(20, 48))),
        lambda: "ey" + chars(lower + upper + digits + "_-", int(rng.integers(30, 90))),
        lambda: "AIza" + chars(lower + upper + digits + "_-", 35),
        lambda: chars(digits + "ABCDEF", int(rng.integers(32, 65))),
        lambda: chars(lower + digits, int(rng.integers(24, 44))),
        lambda: "-".join(chars(lower + upper + digits, int(rng.integers(6, 12))) for _ in range(4)),
    ]
    plain = [
        lambda: "".join(pick(syllables) for _ in range(int(rng.integers(7, 16))))[:60].ljust(16, "e"),
        lambda: "".join(pick(syllables) for _ in range(int(rng.integers(7, 14)))).upper().ljust(16, "E"),
        lambda: chars(digits, int(rng.integers(16, 20))),
        lambda: chars(digits, 16),
        lambda: ("".join(pick(syllables) for _ in range(int(rng.integers(5, 12)))) + pick(syllables) * 8)[: int(rng.integers(16, 30))],
        lambda: ("".join(pick(syllables) for _ in range(int(rng.integers(5, 12)))) + pick(syllables) * 8).title()[: int(rng.integers(16, 24))],
        lambda: "-".join(word() for _ in range(int(rng.integers(3, 8)))).ljust(16, "a"),
        lambda: "_".join(word() for _ in range(int(rng.integers(3, 8)))).ljust(16, "a"),
        lambda: "/".join(["", *(word() for _ in range(int(rng.integers(3, 8))))]).ljust(16, "a"),
        lambda: pick("-=_") * int(rng.integers(16, 70)),
        lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}-{rng.integers(0, 60):02d}",
        lambda: "".join(word().title() for _ in range(int(rng.integers(4, 8)))).ljust(16, "a"),
        lambda: word().title() + "-" + chars(digits, int(rng.integers(8, 13))) + "-" + word(),
        lambda: "/" + word() + "/" + chars(digits, 6) + "/" + word() + "/" + word(),
        lambda: word() * int(rng.integers(6, 12)) + "aaaaaaaaaaaaaaaa",
    ]
    hints = ["key = ", "credential: ", "Authorization: Bearer ", "auth=", "private_key: \"", "client id ", "pwd ", "access key ", "export KEY="]
    out = []
    for _ in range(n):
        secret = int(rng.random() < 0.3)
        body = pick(secrets if secret else plain)()
        before = prose(int(rng.integers(0, 8)))
        lead = pick(hints) if rng.random() < (0.5 if secret else 0.1) else pick([" ", " ", ". ", "\n", "(", " \""])
        head = before + lead
        out.append((head + body + pick([" ", ".", ", ", "\n", "\"", ")"]) + prose(3), len(head), len(head) + len(body), secret))
    return out


# ---- the network


class Network:
    FILTERS, SPAN = 24, 5

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        f, k = self.FILTERS, self.SPAN
        self.p = {"w": rng.normal(0, 0.15, (k, SYMBOLS, f)), "b": np.zeros(f), "v": rng.normal(0, 0.15, 2 * f + 2), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = x.shape[1] - self.SPAN + 1
        z = sum(self.p["w"][o][x[:, o : o + places]] for o in range(self.SPAN)) + self.p["b"]
        a = np.maximum(z, 0)
        body = x[:, BEFORE : BEFORE + BODY]
        extra = np.stack([(body > 0).mean(1), ((body >= 53) & (body <= 62)).sum(1) / np.maximum(1, (body > 0).sum(1))], 1)
        return a, np.concatenate([a.max(1), a.mean(1), extra], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.features(x[i : i + 512])[1] @ self.p["v"] + self.p["c"] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 5) -> None:
        rng, moments, step, f = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0, self.FILTERS
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                xb, (a, h) = x[i], self.features(x[i])
                d = (1 / (1 + np.exp(-np.clip(h @ self.p["v"] + self.p["c"], -40, 40))) - y[i]) / len(i)
                dh = d[:, None] * self.p["v"]
                da = np.repeat(dh[:, None, f : 2 * f] / a.shape[1], a.shape[1], 1)
                top = a.argmax(1)
                np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dh[:, None, :f], 1)
                da *= a > 0
                grad = {"v": h.T @ d, "c": d.sum(keepdims=True), "b": da.sum((0, 1)), "w": np.zeros_like(self.p["w"])}
                for o in range(self.SPAN):
                    np.add.at(grad["w"][o], xb[:, o : o + a.shape[1]].ravel(), da.reshape(-1, f))
                step += 1
                for k, g in grad.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] = self.p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps, then the highest threshold that keeps the recall."""
        z, t = self.logits(x), np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            w, g = p * (1 - p) + 1e-9, p - t
            h = np.array([[w @ (z * z) + 1e-3, w @ z], [w @ z, w.sum() + 1e-3]])
            step = np.linalg.solve(h, [g @ z, g.sum()])
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(a), float(b)
        positive = np.sort(self.probability(x)[y > 0])
        self.threshold = float(positive[int(np.floor((1 - recall) * len(positive)))])


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    found = labelled(n, seed)
    return np.stack([window(t, s, e) for t, s, e, _ in found]), np.array([y for *_, y in found], dtype=float)


@lru_cache(maxsize=2)
def trained(n: int = LABELLED, recall: float = RECALL, seed: int = 11) -> Network:
    net = Network(seed)
    net.fit(*examples(n, seed))
    net.calibrate(*examples(n // 2, seed + 1), recall)
    return net


# ---- the scan


def _worth_reading(texts: list[bytes]) -> list[bool]:
    """Which texts hold a run of 16 characters of the candidate class, or a keyword: no other text can have a finding (hex and access findings are such runs)."""
    out = []
    for t in texts:
        inside = np.concatenate(([False], _RUN[np.frombuffer(t, dtype=np.uint8)], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        out.append(bool(len(edge)) and bool((edge[1::2] - edge[0::2]).max() >= 16))
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text").cast(pa.large_binary())]
                found: list[list[tuple[str, int, int]]] = []
                held: list[tuple[int, str, list[tuple[int, int]]]] = []
                for i, (t, runs) in enumerate(zip(raw, _worth_reading(raw), strict=True)):
                    if not runs and not KEYWORDS.search(text := t.decode(errors="replace")):
                        found.append([])
                        continue
                    text = t.decode(errors="replace")
                    base = base_findings(text)
                    found.append(base)
                    if runs:
                        held.append((i, text, candidates(text, base)))
                secret: set[tuple[int, int, int]] = set()
                reads = ((i, text, s, e, at) for i, text, spans in held for s, e in spans for at in places(s, e) if (i, s, e) not in secret)
                while some := list(islice(reads, 2048)):
                    p = net.probability(np.stack([window(text, at, e) for _, text, _, e, at in some]))
                    secret |= {(i, s, e) for (i, _, s, e, _), q in zip(some, p, strict=True) if q >= net.threshold}
                for i, s, e in sorted(secret):
                    found[i] = [*found[i], ("model", s, e)]
                kind = pa.array([k for f in found for k, _, _ in f], pa.string())
                spans = pa.StructArray.from_arrays([kind, *(pa.array([x[j] for f in found for x in f], pa.int32()) for j in (1, 2))], ["kind", "start", "end"])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32))
                yield pa.record_batch([part.column("row"), part.column("text"), pa.ListArray.from_arrays(offsets, spans)], ["row", "text", "findings"])

    return run


_FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _rows(docs: DataFrame) -> tuple[DataFrame, list[T.StructField]]:
    """docs as (row: struct of all its columns, text), and these two fields; none of the columns' names is ever parsed."""
    held = docs.select(F.struct("*").alias("row"), "text")
    return held, [T.StructField("row", held.schema["row"].dataType), T.StructField("text", T.StringType())]


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs to (row: struct of all its columns, text, findings: array of (kind, start, end), base ones first, by start)."""
    held, fields = _rows(docs)
    return held.mapInArrow(lean(_scan(docs.sparkSession.sparkContext.broadcast(trained()))), T.StructType([*fields, T.StructField("findings", _FINDINGS)]))


def _redact(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, findings in zip(batch.column("text").cast(pa.large_binary()), batch.column("findings").to_pylist(), strict=True):
            text = raw.as_buffer().to_pybytes().decode(errors="replace") if raw.is_valid else None
            for_text, end = [], 0
            for s, e in sorted((f["start"], f["end"]) for f in findings):
                if s >= end:
                    for_text += [text[end:s], mark]
                end = max(end, e)
            out.append("".join([*for_text, text[end:]]) if findings else text)
        yield pa.record_batch([batch.column("row"), pa.array(out, pa.string())], ["row", "text"])


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced by the mark; columns as they were, n_chars (if there) as of the new text."""
    held, fields = _rows(docs)
    scan = _scan(docs.sparkSession.sparkContext.broadcast(trained()))
    # one Python step for both, so that a task needs one worker
    held = held.mapInArrow(lean(lambda batches: _redact(scan(batches), mark)), T.StructType(fields))
    columns = []
    for f in docs.schema.fields:
        c = F.col("row").getField(f.name)
        if f.name == "text":
            c = F.col("text")
        elif f.name == "n_chars":
            c = F.when(F.col("text").eqNullSafe(F.col("row.text")), c).otherwise(F.length("text").cast(f.dataType))
        columns.append(c.alias(f.name))
    return held.select(columns)


_TEXT = "concat(f.kind, ':', f.start, ':', f.end)"
_RANK = "case f.kind when 'assign' then 0 when 'access' then 1 when 'hex' then 2 else 3 end"


def _joined(array: str) -> str:
    return f"concat_ws(',', transform(array_sort(transform({array}, f -> struct(f.start as s, {_RANK} as k, {_TEXT} as t))), x -> x.t))"


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(findings, f -> f.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = f"sha2({_joined('''filter(findings, f -> f.kind != 'model')''')}, 256)"
    return found.select("row.doc_id", *counts, F.expr(base).alias("base_sha256"), F.expr(_joined("findings")).alias("spans"))

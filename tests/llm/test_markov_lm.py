"""The hidden Markov language model: likelihoods and expected counts by brute force, base figures by counting, held-out texts."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import markov_lm as M

DIR = "/root/testdata/sf0.001"


def by_paths(m, seq):
    """Likelihood and expected counts of one sequence, from all paths of states."""
    k, c = len(m.start), len(m.emits)
    total, start, moves, emits = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emits[seq[0], path[0]]
        for i in range(1, len(seq)):
            p *= m.moves[path[i - 1], path[i]] * m.emits[seq[i], path[i]]
        total += p
        start[path[0]] += p
        for i, s in enumerate(path):
            emits[seq[i], s] += p
            if i:
                moves[path[i - 1], s] += p
    return total, start / total, moves / total, emits / total


@pytest.mark.parametrize("piece", [1, 2, 3, 100])
def test_recursions_against_all_paths(piece):
    rng = np.random.default_rng(3)
    m = M.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T)
    seqs = [rng.integers(0, 5, n) for n in (1, 2, 5, 7, 6)]
    codes, bounds = np.concatenate(seqs), np.cumsum([0] + [len(s) for s in seqs])
    want = [by_paths(m, s) for s in seqs]
    assert np.allclose(M.log_likelihoods(m, codes, bounds, piece), [math.log(w[0]) for w in want], atol=1e-12)
    e = M.Expected(5, 3)
    e.add(m, codes, bounds, piece)
    assert np.allclose(e.start, sum(w[1] for w in want)) and np.allclose(e.moves * m.moves, sum(w[2] for w in want)) and np.allclose(e.emits, sum(w[3] for w in want))


def test_long_sequences_in_pieces_and_without_underflow():
    rng = np.random.default_rng(4)
    m = M.Model(rng.dirichlet(np.ones(4)), np.eye(4) * (1 - 4e-13) + 1e-13, rng.dirichlet(np.full(50, 0.01), 4).T + 1e-24)
    codes = rng.integers(0, 50, 5000)
    bounds = np.array([0, 1, 4800, 5000])
    whole = M.log_likelihoods(m, codes, bounds, 10_000)
    assert np.isfinite(whole).all() and np.allclose(M.log_likelihoods(m, codes, bounds, 64), whole, rtol=1e-9)


def test_probabilities_of_all_texts_sum_to_at_most_one():
    # one class a token: all texts of up to six tokens that end
    rng = np.random.default_rng(5)
    m = M.Model(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(3), 2).T)
    texts = [np.array([*t, 0]) for n in range(6) for t in itertools.product((1, 2), repeat=n)]
    logs = M.log_likelihoods(m, np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]))
    assert 0.8 < np.exp(logs).sum() <= 1


def words(text):
    return re.findall(r"[^ \t-\r]+", re.sub("[A-Z]+", lambda x: x.group().lower(), text or ""))


def brute_base(docs):
    """doc_id to held out, tokens, known tokens and base score; and the number of training tokens."""
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in docs}
    c = Counter()
    for d, t in docs:
        if not out[d]:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    rows = Counter()
    for d, t in docs:
        toks = [*words(t), None]
        rows[(d, out[d], len(toks), sum(c[x] > 0 for x in toks), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks), 6))] += 1
    return rows


@pytest.mark.parametrize("known", [M.KNOWN, 20])
def test_base_against_counting_and_score_does_not_hang_on_the_broadcast(spark, known):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", M.held_out(F.col("doc_id")).alias("held_out"))
    got = M.score_texts(docs, rounds=1, own=20, known=known).collect()
    held = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base(held)
    scores = sorted((r["doc_id"], round(r["score"], 6)) for r in got)
    if known == 20:
        again = M.score_texts(docs, rounds=1, own=20).collect()
        assert scores == sorted((r["doc_id"], round(r["score"], 6)) for r in again)


def test_training_raises_the_likelihood_and_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", M.held_out(F.col("doc_id")).alias("held_out"))
    logs = []
    trained = M.baum_welch
    try:
        M.baum_welch = lambda *a: logs.append(trained(*a)) or logs[0]
        r = M.score_texts(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    finally:
        M.baum_welch = trained
    rising = logs[0][1]
    assert rising == sorted(rising) and len(rising) == 4
    assert (r[0] - r[1]) / r[2] > 0.15  # log10 a token


def test_edges(spark):
    odd = [(1, None, "x"), (2, "", None), (3, "one two One", "x"), (3, "one two One", "x"), (None, "one", "y"), (5, "w" * 5000, None), (6, " \t\n ", "z"), (7, "é " * 9000, "long")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, codes string").withColumn("held_out", M.held_out(F.col("doc_id")))
    got = M.score_texts(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == brute_base([x[:2] for x in odd])
    assert all(r["score"] < 0 for r in got) and len({r["score"] for r in got if r["n_tokens"] == 1}) == 1
    assert M.score_texts(docs.where("false")).count() == 0
    # nothing to learn from: every word is unknown, and one token is as good as certain for the base
    untrained = M.score_texts(docs.withColumn("held_out", F.lit(True))).collect()
    assert len(untrained) == len(odd) and all(r["n_known"] == r["train_tokens"] == r["base_score"] == 0 and np.isfinite(r["score"]) for r in untrained)

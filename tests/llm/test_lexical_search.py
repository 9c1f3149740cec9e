"""Lexical search against scores of all documents for all items, and its sketches against the exact scores that they bound."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lexical_search as S

DIR = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(w for _, c, _ in held for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ws in wanted.items():
        rows = []
        for d, c, size in held:
            m = 100 - 50 + (50 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in ws if w in c)
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{"k": 3, "width": 7, "every": 8}, {"block_items": 15, "block_terms": 400}])
def test_against_all_scores(spark, options):
    docs, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], options.get("k", 50))
    assert got(S.search(docs, items, **options)) == want


def test_edges(spark):
    docs = [(1, None, "x"), (2, "", "x"), (3, "--- \t", "x"), (4, "Alpha beta", "x"), (4, "Alpha beta", "x"), (None, "alpha beta", "x"), (0, "ALPHA beta", "y"), (7, "é日本 " * 4000 + "alpha", "z"), (9, "gamma", "z"), (9, "gamma gamma", "z")]
    items = [("a", "alpha?", 1), ("a", "Gamma", 2), (None, "beta BETA", 3), ("b", None, 4), ("c", "", 5), ("d", "nowhere", 6), ("e", "É日本 é日本", 7)]
    d, i = spark.createDataFrame(docs, "doc_id int, text string, score string"), spark.createDataFrame(items, "item_id string, text string, rank int")
    assert got(S.search(d, i)) == brute([x[:2] for x in docs], [x[:2] for x in items], 50)
    assert got(S.search(d, i, k=2)) == brute([x[:2] for x in docs], [x[:2] for x in items], 2)
    assert S.search(d.where("false"), i).count() == S.search(d, i.where("false")).count() == S.search(d, i.where("item_id = 'b'")).count() == 0


def test_sketches_bound_and_prune():
    rng = np.random.default_rng(1)
    rows, vocabulary, k = 4000, 800, 5
    weight = rng.integers(1, 9000, vocabulary)
    lists = [np.sort(rng.choice(vocabulary, size, replace=False)) for size in rng.integers(5, 40, 30)]
    x = S.Items(np.concatenate(lists), np.cumsum([0, *map(len, lists)]), weight, rows, rows * 60, 512)
    held = [np.sort(rng.choice(vocabulary, 30, replace=False)).astype(np.int32) for _ in range(rows)]
    tf = [rng.integers(1, 5, 30).astype(np.int32) for _ in range(rows)]
    batch = pa.record_batch([pa.array(np.arange(rows)), pa.array(rng.integers(30, 90, rows)), pa.array(held, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tf"])
    row, term = np.repeat(np.arange(rows), 30), np.concatenate(held).astype(np.int64)
    impact = x.impacts(batch.column("n").to_numpy()[row], np.concatenate(tf).astype(np.int64))
    at, item = (a.ravel() for a in np.meshgrid(np.arange(rows), np.arange(30), indexing="ij"))
    exact = x.scores((row << 32) + term, impact, at, item).reshape(rows, 30)
    assert (x.bounds_of(row, term, impact, rows) >= exact).all()
    best, met, scored = S.Best(30, k, np.zeros(30, dtype=np.int64)), 0, 0
    for begin in range(0, rows, 500):
        a, b = S._search_rows(x, best, batch.slice(begin, 500))
        met, scored = met + a, scored + b
    assert scored < met / 4
    for q in range(30):
        order = np.lexsort((np.arange(rows), -exact[:, q]))[:k]
        assert best.doc[best.item == q].tolist() == order.tolist() and best.score[best.item == q].tolist() == exact[order, q].tolist()


def test_copies_of_one_score(spark):
    """A third of the rows share one text: ties go by doc_id and no row is lost."""
    docs = [(k, "alpha beta gamma") for k in range(3000)] + [(k, f"alpha {k} delta") for k in range(3000, 9000)]
    items = [(1, "gamma alpha"), (2, "delta"), (3, "8999 4000")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")
    assert got(S.search(d, i, every=20)) == brute(docs, items, 50)

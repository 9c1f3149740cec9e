"""Token alignment against the tokenizers' own encodings of whole texts and a plain merge of their ends."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import token_alignment as T

DIR = "/root/testdata/sf0.001"
A_FILE, B_FILE = T.public_files()
ODD = ["a", " a  b ", "one two\n three  \n\t four", "don't  stop\r\n", "<|endoftext|> <s> </s><unk>", "a▁b", "▁", " ", "   ", "\n", "日本語 テキスト", "🙂🙂 é é", "x\0y", "   z", "1234567 89", "aaaa" * 300, "a b" * 700, "ab\x1c cd", "﻿ x", "=" * 999]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def by_library(libraries, text):
    """Groups of a text: lists of A ids and of B ids, from whole-text encodings."""
    a, b = libraries
    want = f" {text}".encode()
    table = T.byte_of_character()
    in_a = a.encode(f" {text}", add_special_tokens=False)
    spelt_a = [bytes(table[c] for c in t) for t in in_a.tokens]
    ids_b = b.encode(text)
    spelt_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    if not text or b"".join(spelt_a) != want or b"".join(spelt_b) != want:
        return []
    ends_a, ends_b = (np.cumsum([len(x) for x in s]).tolist() for s in (spelt_a, spelt_b))
    out, i, j = [], 0, 0
    after_a, after_b = ({end: n for n, end in enumerate(ends, 1)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        p, q = after_a[end], after_b[end]
        out.append((in_a.ids[i:p], ids_b[j:q]))
        i, j = p, q
    return out


def brute(libraries, texts):
    held = [by_library(libraries, t or "") for t in texts]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in held]
    counts = Counter(p for x in links for p in x)
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    rows = []
    for g, x in zip(held, links, strict=True):
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        digest = hashlib.sha256(told.encode()).hexdigest() if g else ""
        rows.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(x.values()), sum(n for p, n in x.items() if counts[p] == highest[p[0]]), sum(n * counts[p] for p, n in x.items()), digest))
    return rows


def got(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


def wanted(libraries, docs):
    return sorted((d is None, d or 0, *row) for (d, _), row in zip(docs, brute(libraries, [t for _, t in docs]), strict=True))


@pytest.fixture(scope="module")
def documents(spark, libraries):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    return docs, wanted(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("known", [300, 0])
def test_documents_against_the_libraries(documents, known):
    docs, want = documents
    assert got(T.align_tokens(docs, A_FILE, B_FILE, known)) == want


def test_odd_texts(spark, libraries):
    docs = [(None, None), (1, None), (2, ""), *enumerate(ODD, 3), (3, ODD[0]), (None, ODD[1]), (99, " ".join(random.Random(1).choices(ODD, k=300)).replace("▁", ""))]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tail int")
    assert got(T.align_tokens(df, A_FILE, B_FILE)) == wanted(libraries, docs)
    groups = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in T.aligned_groups(df.where("doc_id > 3 and doc_id < 99"), A_FILE, B_FILE).collect()}
    assert groups == {d: by_library(libraries, t) for d, t in docs if d and 3 < d < 99}
    assert T.align_tokens(df.where("false"), A_FILE, B_FILE).count() == 0


def test_a_task_may_forget(spark, libraries, monkeypatch):
    s = T.Stretches(A_FILE, B_FILE)
    for text in ODD * 2:
        codes, bounds = s.codes([text])
        rows = s.right(codes, bounds)
        assert bool(rows[0]) == bool(by_library(libraries, text))
        if len(s.code) > 3:
            s.clear()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t'sé1,.日 \x1c")), max_size=40))
def test_stretches_equal_whole_texts(libraries_once, text):
    s = libraries_once[2]
    codes, _ = s.codes([text])
    told = "".join(s.text[c] for c in codes)[:-1]
    assert told == ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in by_library(libraries_once[:2], text))


@pytest.fixture(scope="module")
def libraries_once(libraries):
    return (*libraries, T.Stretches(A_FILE, B_FILE))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40), st.integers(1, 9))
def test_pieces_of_a_merge_equal_the_whole(a, b, steps):
    a, b = np.cumsum(a), np.cumsum(b)
    if a[-1] < b[-1]:
        a = np.append(a, b[-1])
    elif b[-1] < a[-1]:
        b = np.append(b, a[-1])
    shared = np.intersect1d(a, b)
    of_a, of_b, n = T.groups(a, b, steps)
    assert n == len(shared) and (of_a == np.searchsorted(shared, a)).all() and (of_b == np.searchsorted(shared, b)).all()


def test_diagonals_cut_equal_work():
    a, b = np.arange(1, 10_001), np.arange(3, 30_003, 3)
    d = np.arange(0, len(a) + len(b), 100)
    i = T.crossings(a, b, d)
    assert (np.diff(i) + np.diff(d - i) == 100).all()


def test_large_groups(spark, libraries, monkeypatch):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("abcé", k=400))) for k in range(20)]
    monkeypatch.setattr(T, "LARGE_GROUP", 2)
    s = T.Stretches(A_FILE, B_FILE)
    codes, bounds = s.codes([t for _, t in texts])
    _, pair, times = s.pairs(codes, np.repeat(np.arange(20), np.diff(bounds)))
    want = [Counter((a, b) for x, y in by_library(libraries, t) for a in x for b in y) for _, t in texts]
    assert sum(times) == sum(sum(w.values()) for w in want) and len(pair) == sum(map(len, want))

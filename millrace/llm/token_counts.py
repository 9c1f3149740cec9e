"""Token counts of a unigram vocabulary without the tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates all pieces in a stretch of text; dynamic programming carries the best score and
its number of pieces at each place. Ties go to the longest piece (see millrace.llm.unigram). Texts are cut where no
piece can reach across, and the counts of stretches met before are kept in a bounded table per task.

Null counts as empty; an empty text has no tokens. Very long texts need memory for the text and its longest uncut
stretch only. Repeated rows are counted each; other columns are ignored. Bytes that aren't UTF-8 are read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.unigram import Vocabulary, default_model, vocabulary

KEPT = 250_000


def counter(v: Vocabulary):
    """A function from a stretch of text to its number of tokens."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece in v.id:
        automaton.add_word(piece, (len(piece), v.score[piece]))
    automaton.make_automaton()
    unknown, none = v.unknown, float("-inf")

    def count(s: str) -> int:
        n = len(s)
        best, pieces = [0.0] + [none] * n, [0] * (n + 1)
        single, done = -1, 0

        def unknowns(upto: int, single: int) -> None:
            # places no piece ends at, or whose last character is no piece, can end in an unknown
            for e in range(done + 1, upto + 1):
                if e != single and best[e - 1] + unknown > best[e]:
                    best[e] = best[e - 1] + unknown
                    pieces[e] = pieces[e - 1] + (len(s[e - 1].encode()) if v.bytes else 1)

        for last, (size, score) in automaton.iter(s):
            end = last + 1
            if end - 1 > done:
                unknowns(end - 1, single)
                done = end - 1
            start = end - size
            if best[start] + score > best[end]:
                best[end] = best[start] + score
                pieces[end] = pieces[start] + 1
            if size == 1:
                single = end
        unknowns(n, single)
        return pieces[n]

    return count


def _count(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_file)
        count, kept = counter(v), {}
        find, get = v.segment.findall, kept.get
        for batch in batches:
            out = []
            for text in batch.column("text"):
                total = 0
                for s in find(v.normalise(text.as_buffer().to_pybytes().decode(errors="replace") if text.is_valid else "")):
                    c = get(s)
                    if c is None:
                        c = count(s)
                        if len(s) < 64:
                            kept[s] = c
                    total += c
                out.append(total)
                if len(kept) > KEPT:
                    kept.clear()
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, text) to (doc_id, n_tokens)."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_count(model_file or default_model()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))

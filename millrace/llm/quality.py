"""Quality rules as a short-circuit cascade of native expressions.

A rule is a rejection test over named text metrics. Metrics are columns built by DataFrame expressions only. Each rule's
cost and rejection rate are estimated on a sample of about SAMPLE_ROWS documents, taken by a hash of their places all over the table,
and the rules are ordered by rejections per second; a document then pays only for the metrics up to the first rule that rejects it.
The order changes the work, never the verdict: a document is rejected when any rule rejects it. A rule's cost is the least time of
REPEATS runs over the sample less that of an empty test; costs that a job's time can't tell (below FLOOR seconds) count as equal.

Words are `[^\\x20\\x09-\\x0D]+`. Null texts count as empty: no words, all counts 0 (and rejected as too short). Repeated
rows are judged each for itself; a document's other columns pass unchanged whatever their names (they travel in a struct).
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import discard, materialise


def _let(value: str, name: str, body: str) -> str:
    """SQL that works out value once and names it in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


_WORDS = r"array_remove(split(translate(text, '\t\n\u000B\u000C\r', '     '), ' '), '')"
_LINES = r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
# a hash of each 3 words; where some hash comes twice, the places of those are found by sorting (hash, place), and the words
# that their windows cover are summed over the places in order
_COVERED = """aggregate(
  sort_array(filter(transform(placed, (x, j) -> if((j > 0 and placed[greatest(j - 1, 0)].g = x.g) or (j + 1 < size(placed) and placed[least(j + 1, size(placed) - 1)].g = x.g), x.i, -1)), p -> p >= 0)),
  struct(0L as n, 0 as upto), (a, p) -> struct(a.n + p + 3 - greatest(a.upto, p) as n, p + 3 as upto), a -> a.n)"""
_PLACED = _let("sort_array(transform(grams, (g, i) -> struct(g as g, i as i)))", "placed", _COVERED)
_GRAMS = "if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, greatest(size(words) - 3, 0)), i -> xxhash64(words[i], words[i + 1], words[i + 2])))"
_REPEATS = _let(_GRAMS, "grams", f"if(size(array_distinct(grams)) = size(grams), 0L, {_PLACED})")

#: SQL over `text`, never null.
METRICS = {
    "n_words": f"cast(size({_WORDS}) as long)",
    "word_chars": r"cast(length(translate(text, ' \t\n\u000B\u000C\r', '')) as long)",
    "n_symbols": "cast(length(text) - length(translate(text, '#*$%&|<>', '')) as long)",
    "n_exclaim": "cast(length(text) - length(replace(text, '!', '')) as long)",
    "n_upper": "cast(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as long)",
    "n_lines": f"cast(size({_LINES}) as long)",
    "n_dup_lines": _let(_LINES, "lines", "cast(size(lines) - size(array_distinct(lines)) as long)"),
    "n_repeat_words": _let(_WORDS, "words", _REPEATS),
}
#: Metrics that share a step, worked out together where all are wanted.
_TOGETHER = {
    "of_words": _let(_WORDS, "words", f"struct(cast(size(words) as long) as n_words, {_REPEATS} as n_repeat_words)"),
    "of_lines": _let(_LINES, "lines", "struct(cast(size(lines) as long) as n_lines, cast(size(lines) - size(array_distinct(lines)) as long) as n_dup_lines)"),
}


#: Metrics of each shared step.
_OF = {"of_words": ("n_words", "n_repeat_words"), "of_lines": ("n_lines", "n_dup_lines")}

SAMPLE_ROWS, REPEATS, FLOOR = 1000, 3, 0.01


@dataclass(frozen=True)
class Rule:
    name: str
    metrics: tuple[str, ...]
    rejects: str


#: The contract's base rules.
BASE = (Rule("too_few_words", ("n_words",), "n_words < 50"), Rule("repeated_windows", ("n_words", "n_repeat_words"), "100 * n_repeat_words > 50 * n_words"))
#: Further rules, far from what well-formed prose and lists reach.
MORE = (
    Rule("symbols", ("n_words", "n_symbols"), "10 * n_symbols > 3 * n_words"),
    Rule("exclamations", ("n_words", "n_exclaim"), "2 * n_exclaim > n_words"),
    Rule("capitals", ("word_chars", "n_upper"), "2 * n_upper > word_chars"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), "2 * n_dup_lines > n_lines"),
)
RULES = BASE + MORE


def _held(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of about `rows` of the documents, or of all if there are fewer, written once; equal texts are taken or left each for itself."""
    every = max(1, docs.count() // rows)
    place = F.xxhash64(F.monotonically_increasing_id())
    return materialise(docs.select(F.coalesce("text", F.lit("")).alias("text"), place.alias("h")).where(F.pmod("h", F.lit(every)) == 0).select("text"), "sample")


def _seconds(sample: DataFrame, metrics: tuple[str, ...], test: str) -> tuple[float, int]:
    """Least time of a job that applies the test to every text of the sample, and how many pass it."""
    times, n = [], 0
    for _ in range(REPEATS):
        began = time.perf_counter()
        n = sample.select(*(F.expr(METRICS[m]).alias(m) for m in metrics), "text").agg(F.expr(f"count_if({test})")).first()[0]
        times.append(time.perf_counter() - began)
    return min(times), n


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejections per second of work, most first; ties by name."""
    sample, rank = sampled(docs), {}
    empty, _ = _seconds(sample, (), "length(text) < 0")
    for rule in rules:
        took, rejected = _seconds(sample, rule.metrics, rule.rejects)
        rank[rule.name] = rejected / max(took - empty, FLOOR)
    discard(sample)
    return sorted(rules, key=lambda r: (-rank[r.name], r.name))


def cascade(docs: DataFrame, rules: list[Rule], always: tuple[str, ...] = ()) -> DataFrame:
    """docs to (row: struct of all its columns, metrics: struct of those that the rules or the caller ask for, failed: the first of
    the rules, in the order given, that rejects it, or null). A metric is null where an earlier rule had rejected the document and
    it was not worked out; those in `always` are worked out for every document."""
    df, have = _held(docs), []
    for step, metrics in _OF.items():
        if set(metrics) <= set(always):
            df, have = df.select("*", F.expr(_TOGETHER[step]).alias(step)).select("*", f"{step}.*").drop(step), [*have, *metrics]
    alone = [m for m in always if m not in have]
    df, have = df.withColumns({m: F.expr(METRICS[m]) for m in alone}) if alone else df, [*have, *alone]
    df = df.withColumn("failed", F.lit(None).cast("string"))
    for rule in rules:
        for m in rule.metrics:
            if m not in have:
                df = df.withColumn(m, F.expr(f"case when failed is null then {METRICS[m]} end"))
                have.append(m)
        df = df.withColumn("failed", F.expr(f"case when failed is not null then failed when {rule.rejects} then '{rule.name}' end"))
    # explode keeps a later filter on `failed` from being worked out apart from the column
    metrics = F.struct(*have) if have else F.struct(F.lit(None).cast("long").alias("none"))
    return df.select("row", metrics.alias("metrics"), F.explode(F.array("failed")).alias("failed"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    return cascade(docs, ordered(docs, rules)).where("failed is null").select("row.*")


#: The metrics that a report has for every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, metrics, failed, base_failed) of every document: the REPORTED metrics in full, the rest, and the verdict, by the cascade."""
    base = " or ".join(f"({r.rejects})" for r in BASE)
    for m in {m for r in BASE for m in r.metrics}:
        base = re.sub(rf"\b{m}\b", f"metrics.{m}", base)
    return cascade(docs, ordered(docs, rules), REPORTED).withColumn("base_failed", F.expr(base))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    of = [f"metrics.{m}" for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return report(docs).select("row.doc_id", *of, "base_failed", F.expr("failed is null").alias("kept"))


SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
m as (select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars, words,
      cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
      cast(length(regexp_replace(t, '[^!]', '', 'g')) as bigint) as n_exclaim,
      cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as bigint) as n_upper, cast(len(lines) as bigint) as n_lines,
      cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines from w),
g as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from m where len(words) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as c from g),
r as (select doc_id, count(distinct i + k) as n_repeat_words from h, (values (0), (1), (2)) v(k) where c > 1 group by doc_id),
a as (select m.*, cast(coalesce(r.n_repeat_words, 0) as bigint) as n_repeat_words from m left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > 3 * n_words or 2 * n_exclaim > n_words or 2 * n_upper > word_chars or 2 * n_dup_lines > n_lines) as kept
from b
"""

"""Joins, rankings and caps: relationships between tables and names, best matches, top-k."""

from __future__ import annotations

import difflib
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.sources.scratch import kept


def count_related(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, child_id: str, name: str) -> DataFrame:
    """Children for each parent, zero included: children are counted before the join, so no group is moved whole."""
    counts = child.groupBy(child_key).agg(F.count(child_id).alias(name))
    return parent.join(counts, parent[parent_key] == counts[child_key], "left").select(parent["*"], F.coalesce(name, F.lit(0)).cast("long").alias(name))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by order. Only that row of each task is shuffled."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is in right."""
    return left.join(right, left[left_key] == right[right_key], "left_semi")


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of left whose key is not in right."""
    return left.join(right, left[left_key] == right[right_key], "left_anti")


def row_index(df: DataFrame, keys: list[str], order: list[str], name: str = "idx") -> DataFrame:
    """Number the rows of each key from 0, in an explicit order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def common_values(a: DataFrame, a_column: str, b: DataFrame, b_column: str, name: str) -> DataFrame:
    """Distinct values that both columns have."""
    return a.select(F.col(a_column).alias(name)).intersect(b.select(F.col(b_column).alias(name)))


def values_only_in(a: DataFrame, a_column: str, b: DataFrame, b_column: str, name: str) -> DataFrame:
    """Values of the first column less those of the second, each as often as it is there more often."""
    return a.select(F.col(a_column).alias(name)).exceptAll(b.select(F.col(b_column).alias(name)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def capped(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a frame, and in a column `truncated` whether there were more: n + 1 rows are taken once, and the flag is
    told from their number within the one task that holds them."""
    held = df.limit(n + 1).withColumn("__n", F.monotonically_increasing_id())
    counted = held.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > n).withColumn("__n", F.row_number().over(Window.orderBy("__n")))
    return counted.where(F.col("__n") <= n).drop("__n")


# Most rows that each chart shows.
CHART_LIMITS = {"pie": 50, "radar": 30, "funnel": 40, "gauge": 1, "sankey": 100, "treemap": 200, "sunburst": 200, "bar": 100, "line": 500, "heatmap": 500, "candlestick": 500, "scatter": 1000}


def chart_rows(df: DataFrame, chart: str, by: str, *ties: str) -> DataFrame:
    """The rows that a chart of this kind shows: the greatest by one column."""
    return df.orderBy(F.desc(by), *ties).limit(CHART_LIMITS.get(chart, 100))


def chart_counts(df: DataFrame, chart: str) -> DataFrame:
    """How many rows there are, how many of them a chart of this kind shows, and whether that is fewer."""
    most = CHART_LIMITS.get(chart, 100)
    return df.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(most).cast("long")).alias("displayed"), (F.col("total") > most).alias("limited"))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


def tier(entity: Column, file: Column) -> Column:
    """Similarity of the cheap kinds, else NULL: equal 1.0, entity in file 0.9, file in entity 0.8."""
    return F.when(entity == file, 1.0).when(file.contains(entity), 0.9).when(entity.contains(file), 0.8)


def similarity(entity: Column, file: Column) -> Column:
    """Name similarity in [0, 1]; only what the cheap kinds leave open goes to Python."""
    a, b = F.split(entity, "_"), F.split(file, "_")
    words = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(tier(entity, file), F.least(F.lit(1.0), F.pandas_udf(_ratio, "double")(entity, file) + 0.3 * words))


#: Names of one side that a block holds: a character that many names share is dealt to blocks of names of either side.
BLOCK_NAMES = 2_000
#: Fixed value: names match above this score.
MATCH_ABOVE = 0.3


def _characters(name: Column) -> Column:
    """The characters of a name, each with how often it came before: as many of these are shared by two names as their multisets share."""
    each = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(name, i, F.lit(1)))
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i), lambda x: x == c)).cast("string")))


def _indexed(names: DataFrame, rarity: DataFrame) -> DataFrame:
    """(name) to its tokens, rarest first, and how many of them, `kept`, must be indexed so that no pair above MATCH_ABOVE by its characters
    is missed: a ratio 2 m / (la + lb) above r needs m > r / (2 - r) * la shared characters, however long the other name is."""
    tokens = names.select("name", F.explode(_characters(F.col("name"))).alias("token")).join(rarity, "token")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    share = MATCH_ABOVE / (2 - MATCH_ABOVE)
    sized = tokens.groupBy("name").agg(listed.alias("tokens"))
    # a shared word counts as well, so words are tokens of an index of their own, which all names are in
    words = F.transform(F.array_distinct(F.split("name", "_")), lambda w: F.concat(F.lit("_"), w))
    return sized.select("name", "tokens", (F.size("tokens") - F.floor(F.size("tokens") * share)).cast("int").alias("kept"), words.alias("words"))


def _met(a: DataFrame, b: DataFrame, left: Column, right: Column, first: Column) -> DataFrame:
    """Pairs of a and b that share an entry of the two lists, once each: where the shared entry is the first one. An entry's names
    are dealt to blocks, and each block of one side meets each of the other in a task of its own."""
    a, b = a.withColumn("token", F.explode(left)), b.withColumn("token", F.explode(right))
    many = lambda df, n: df.groupBy("token").agg(F.ceil(F.count("*") / BLOCK_NAMES).cast("int").alias(n))
    blocks = many(a, "na").join(many(b, "nb"), "token")
    dealt = lambda df, mine, other, i, j: df.join(blocks, "token").withColumn(i, F.pmod(F.xxhash64("name"), mine).cast("int")).withColumn(j, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("na", "nb")
    x = dealt(a, F.col("na"), "nb", "i", "j").select(*(F.col(c).alias(f"{c}_a") for c in ("name", "tokens", "kept", "words")), "token", "i", "j")
    y = dealt(b, F.col("nb"), "na", "j", "i").select(*(F.col(c).alias(f"{c}_b") for c in ("name", "tokens", "kept", "words")), "token", "i", "j")
    return x.join(y.hint("shuffle_hash"), ["token", "i", "j"]).where(F.col("token") == first)


def name_candidates(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(entity) and (file) to the pairs (entity, file) of distinct names whose score can be above MATCH_ABOVE: those that share enough characters or a word for the bound
    min(1, 2 * shared characters / lengths + 0.3 * shared words), or of which one holds the other. Found by an inverted
    index on characters, rarest first, and on words; no pair is looked at that shares none of either."""
    a, b = (df.select(F.col(c).alias("name")).where("name is not null and name != ''").distinct() for df, c in ((entities, "entity"), (files, "file")))
    counts = a.unionByName(b).select(F.explode(_characters(F.col("name"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    counts = kept(counts, "tokens")
    a, b = kept(_indexed(a, counts), "names"), kept(_indexed(b, counts), "names")  # each is read by four joins
    prefix = lambda side="": F.slice(F.col(f"tokens{side}"), F.lit(1), F.col(f"kept{side}"))
    common = lambda x, y: F.array_intersect(x, y)[0]
    in_prefix = F.arrays_overlap(prefix("_a"), prefix("_b"))
    by_character = _met(a, b, prefix(), prefix(), common(prefix("_a"), prefix("_b")))
    by_word = _met(a, b, F.col("words"), F.col("words"), common(F.col("words_a"), F.col("words_b"))).where(~in_prefix)
    # what is held whole shares all its characters, its rarest among them, wherever that stands in the longer name
    rarest = lambda side="": F.slice(F.col(f"tokens{side}"), 1, 1)
    new = ~in_prefix & ~F.arrays_overlap("words_a", "words_b")
    inside = _met(a, b, rarest(), F.col("tokens"), F.col("tokens_a")[0]).where(new & F.contains("name_b", "name_a"))
    around = _met(a, b, F.col("tokens"), rarest(), F.col("tokens_b")[0]).where(new & F.contains("name_a", "name_b") & (F.col("name_a") != F.col("name_b")))
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    words = F.size(F.array_intersect("words_a", "words_b")) / F.greatest(F.size("words_a"), F.size("words_b"))
    bound = 2 * shared / (F.size("tokens_a") + F.size("tokens_b")) + 0.3 * words
    held = F.contains("name_a", "name_b") | F.contains("name_b", "name_a")
    met = by_character.unionByName(by_word).unionByName(inside).unionByName(around)
    return met.where((bound > MATCH_ABOVE - 1e-9) | held).select(F.col("name_a").alias("entity"), F.col("name_b").alias("file"))


def name_matches(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(entity) and (file) to (entity, file, score): all pairs of distinct names that score above MATCH_ABOVE. Python scores only what the
    exact bound of name_candidates leaves and the cheap kinds don't settle. A null name matches nothing; an empty one is in every name."""
    pairs = name_candidates(entities, files)
    a, b = entities.select("entity").where("entity is not null").distinct(), files.select("file").where("file is not null").distinct()
    empty_a, empty_b = a.where("entity = ''"), b.where("file = ''")  # a row each at most
    pairs = pairs.unionByName(b.join(F.broadcast(empty_a)).select("entity", "file")).unionByName(a.where("entity != ''").join(F.broadcast(empty_b)).select("entity", "file"))
    cheap = pairs.withColumn("score", tier(F.col("entity"), F.col("file")))
    rest = cheap.where("score is null").select("entity", "file", similarity(F.col("entity"), F.col("file")).alias("score"))
    return cheap.where("score is not null").unionByName(rest).where(F.col("score") > MATCH_ABOVE)


# A file name's additions to an entity's name, and what looks like a date in it.
EXPORT_FORMS = ("{}_data", "{}_export", "{}_dump", "data_{}", "export_{}", "{}_table", "table_{}")
DATE_FORMS = r"\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4}|\d{8}|\d{6}"


def pattern_score(entity: Column, file: Column) -> Column:
    """0.7 where the file's name holds the entity's in an export's form, else 0.4 where it holds a date, else 0."""
    e, f = F.lower(entity), F.lower(file)
    form = [F.contains(f, F.concat(F.lit(x.split("{}")[0]), e, F.lit(x.split("{}")[1]))) for x in EXPORT_FORMS]
    return F.when(F.coalesce(reduce(or_, form), F.lit(False)), 0.7).when(f.rlike(DATE_FORMS), 0.4).otherwise(0.0)


def match_entities(entities: DataFrame, files: DataFrame) -> DataFrame:
    """(entity) and (file) names as they are to (entity, file, score) of the pairs that score above MATCH_ABOVE, best first for each entity: the
    greatest of the similarities of all the entity's spellings and 0.6 of the pattern score. Every pair is scored."""
    names = entities.where("entity is not null").distinct().select("entity", F.explode(F.array_union(F.array(F.lower("entity")), C.alternative_names(F.col("entity")))).alias("spelling"))
    names = names.select("entity", C.normalised_name(F.col("spelling")).alias("name")).where("name != ''").distinct()
    clean = files.where("file is not null").distinct().select("file", C.normalised_name(F.col("file")).alias("clean")).where("clean != ''")
    similar = name_matches(names.select(F.col("name").alias("entity")), clean.select(F.col("clean").alias("file"))).select(F.col("entity").alias("name"), F.col("file").alias("clean"), "score")
    by_name = names.join(similar, "name").join(clean, "clean").select("entity", "file", "score")
    # a pattern alone scores 0.42 at most, so only names in an export's form can pass by it: those that hold the entity's name
    whole = F.lower("entity").alias("name")
    held = _containing(entities.where("entity is not null").select("entity", whole).distinct(), files.where("file is not null").select("file").distinct())
    by_form = held.select("entity", "file", (0.6 * pattern_score(F.col("entity"), F.col("file"))).alias("score")).where(F.col("score") > MATCH_ABOVE)
    return by_name.unionByName(by_form).groupBy("entity", "file").agg(F.max("score").alias("score")).orderBy("entity", F.desc("score"), "file")


def _containing(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Pairs in which the file's name holds the entity's next to a `_`, by an equi join of the stretches of the file's name."""
    low = F.lower("file")
    ends = F.filter(F.sequence(F.lit(0), F.length(low) + 1), lambda i: (i == 0) | (i == F.length(low) + 1) | (F.substr(low, i, F.lit(1)) == "_"))
    after = F.flatten(F.transform(ends, lambda a: F.transform(F.sequence(F.lit(1), F.length(low)), lambda k: F.substr(low, a + 1, k))))
    before = F.flatten(F.transform(ends, lambda b: F.transform(F.sequence(F.lit(1), F.length(low)), lambda k: F.substr(low, k, F.greatest(b - k, F.lit(0))))))
    stretches = files.where(F.length("file") > 0).select("file", F.explode(F.array_distinct(F.concat(after, before))).alias("name"))
    return entities.join(stretches, "name").select("entity", "file").distinct()


def common_columns(catalog: DataFrame, keys: DataFrame | None = None, both_ways: bool = False) -> DataFrame:
    """Pairs of tables that share a column name, with a confidence from type, name and distinct counts; of each pair the one way by
    table name, or both. With keys (table_name, primary_key), a column that is the key of both tables makes no pair. The pairs of a
    name that many tables share grow with their square: shared_names has such names in a row each."""
    from millrace.operators.metadata import LINK_WORDS, relation_type

    c = catalog.withColumn("name", F.lower("column_name"))
    c = c.withColumn("is_key", F.lit(False)) if keys is None else c.join(keys.select("table_name", "primary_key"), "table_name", "left").withColumn("is_key", F.coalesce(F.col("primary_key") == F.col("column_name"), F.lit(False)))
    a, b = c.alias("a"), c.alias("b")
    pairs = a.join(b, F.expr(f"a.name = b.name and a.table_name {'!=' if both_ways else '<'} b.table_name")).where("not (a.is_key and b.is_key)")
    n, m = F.col("a.distinct_count"), F.col("b.distinct_count")
    some = (n > 0) & (m > 0)
    likely = reduce(or_, (F.col("a.name").contains(w) for w in LINK_WORDS))
    part = lambda when, x: F.when(when, x).otherwise(0.0)
    score = F.lit(0.4) + part(F.col("a.data_type") == F.col("b.data_type"), 0.3) + part(likely, 0.2) + part(some & (F.greatest(n, m) / F.least(n, m) > 2), 0.1)
    lone = lambda t: (F.col(f"{t}.distinct_count") == F.col(f"{t}.total")) & (F.col(f"{t}.null_count") == 0)
    kind = relation_type(n, m, lone("a"), lone("b"))
    return pairs.select(F.col("a.table_name").alias("from_table"), F.col("b.table_name").alias("to_table"), F.col("a.column_name").alias("column_name"), F.col("b.column_name").alias("to_column"), F.round(score, 2).alias("confidence"), kind.alias("relation"))


def shared_names(catalog: DataFrame) -> DataFrame:
    """Column names that several tables have, with their number."""
    return catalog.groupBy(F.lower("column_name").alias("column_name")).agg(F.count_distinct("table_name").alias("tables")).where("tables > 1")


def key_candidates(catalog: DataFrame) -> DataFrame:
    """Columns that may be a primary key: named like a key, or nearly all distinct and never NULL; ranked id, *_id, *id*, others. A name is
    enough, whatever the values: uniqueness (distinct values by rows) lets a caller ask for more."""
    from millrace.operators.metadata import KEY_WORDS

    low = F.lower("column_name")
    unique = (F.col("distinct_count") > 0.95 * F.col("total")) & (F.col("null_count") == 0)
    rank = F.when(low == "id", 0).when(low.endswith("_id"), 1).when(low.contains("id"), 2).otherwise(3)
    w = Window.partitionBy("table_name").orderBy("kind", "ordinal")
    named = reduce(or_, (low.contains(w) for w in KEY_WORDS))
    share = F.round(F.when(F.col("total") > 0, F.col("distinct_count") / F.col("total")).otherwise(0.0), 4).alias("uniqueness")
    return catalog.where(named | unique).select("table_name", "column_name", "ordinal", share, rank.alias("kind")).withColumn("rank", F.row_number().over(w)).drop("ordinal")


def column_definitions(catalog: DataFrame, keys: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Name, type, whether NULLs occur and values are unique; with keys also is_key, with samples (table_name, column_name, rank, value)
    the first three, joined by a comma."""
    c = catalog.select("table_name", "column_name", "data_type", (F.col("null_count") > 0).alias("nullable"), ((F.col("distinct_count") == F.col("total")) & (F.col("null_count") == 0)).alias("is_unique"))
    if keys is not None:
        c = c.join(keys.select("table_name", "primary_key"), "table_name", "left").withColumn("is_key", F.coalesce(F.col("primary_key") == F.col("column_name"), F.lit(False))).drop("primary_key")
    if samples is not None:
        three = F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"])
        c = c.join(samples.where("rank <= 3").groupBy("table_name", "column_name").agg(F.array_join(three, ",").alias("samples")), ["table_name", "column_name"], "left")
    return c


def compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """Column by column what changed between two catalogs of (column_name, data_type, nullable)."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.expr("o.column_name = n.column_name"), "full")
    kind = F.expr("case when n.column_name is null and not o.nullable then 'missing_required' when n.column_name is null then 'missing_optional' when o.column_name is null then 'extra' when o.data_type != n.data_type then 'type_mismatch' else 'same' end")
    return j.select(F.coalesce("o.column_name", "n.column_name").alias("column_name"), kind.alias("change"))

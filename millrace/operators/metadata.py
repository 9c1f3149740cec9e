"""Names, classes, tags and notes for tables and columns, and comparison of catalogs.

All work on catalogs (`profile.column_catalog`): table_name, column_name, ordinal, data_type, total, null_count, distinct_count.
A catalog has a row for each column, so these never touch the data again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell what a table holds, in order of precedence.
ENTITIES = {
    "customer": ("customer", "client", "user", "account", "buyer", "person"),
    "order": ("order", "purchase", "transaction", "sale"),
    "product": ("product", "item", "sku", "inventory", "catalog"),
    "invoice": ("invoice", "bill", "receipt", "payment"),
    "employee": ("employee", "staff", "worker", "personnel"),
    "vendor": ("vendor", "supplier", "partner"),
    "location": ("location", "address", "store", "branch", "region"),
    "category": ("category", "type", "classification", "group"),
    "event": ("event", "log", "activity", "action"),
}
# Words of key columns and names of measures.
KEY_WORDS = ("id", "_id", "key", "_key", "code", "_code", "num", "number")
MEASURES = ("amount", "quantity", "count", "total", "sum", "value", "price", "cost")
# Words that give a column a business tag.
TAGS = {
    "PII": ("email", "phone", "ssn", "social_security", "passport", "license", "address", "name", "first_name", "last_name"),
    "Financial": ("amount", "price", "cost", "revenue", "profit", "salary", "wage", "payment", "balance", "credit", "debit"),
    "Temporal": ("date", "time", "created", "updated", "modified", "timestamp", "year", "month", "day"),
    "Contact": ("email", "phone", "mobile", "telephone", "fax", "contact", "address", "zip", "postal"),
    "Identifier": ("id", "key", "code", "number", "reference", "uuid", "guid"),
    "Location": ("address", "city", "state", "country", "zip", "postal", "region", "location", "latitude", "longitude"),
    "Measurement": ("quantity", "count", "total", "sum", "average", "min", "max", "length", "width", "height", "weight"),
    "Status": ("status", "state", "active", "inactive", "enabled", "disabled", "valid", "flag"),
    "Audit": ("created_by", "updated_by", "modified_by", "created_at", "updated_at", "modified_at", "version"),
    "Categorical": ("category", "type", "class", "group", "classification", "genre", "kind"),
}
# What tables of a known kind stand for, and SQL types of inferred types.
ENTITY_TEXTS = {
    "customer": "Represents customers or clients of the business",
    "order": "Represents sales orders or purchase transactions",
    "product": "Represents products or items in the catalog",
    "invoice": "Represents billing documents and payment records",
    "employee": "Represents staff members and personnel",
    "vendor": "Represents suppliers and business partners",
    "location": "Represents physical locations and addresses",
    "category": "Represents classification and grouping data",
    "event": "Represents events, activities, or log entries",
}
SQL_TYPES = {"integer": "INTEGER", "float": "DECIMAL", "string": "VARCHAR(255)", "datetime": "TIMESTAMP", "boolean": "BOOLEAN", "identifier": "VARCHAR(50)", "unknown": "VARCHAR(255)"}
# Words of a column's name, or else its tags, and the purpose that they tell, in order of precedence.
PURPOSES = (
    (("email",), "Email address"),
    (("phone",), "Phone number"),
    (("name",), "Name identifier"),
    (("address",), "Address information"),
    (("amount", "price"), "Monetary amount"),
    (("date",), "Date value"),
    (("status",), "Status indicator"),
    (("count", "quantity"), "Quantity measurement"),
)
TAG_PURPOSES = (("PII", "Personal information"), ("Financial", "Financial data"), ("Contact", "Contact information"), ("Location", "Location data"))
# Relationship types, and the name parts of columns that may link tables.
RELATION_TYPES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
LINK_WORDS = ("id", "key", "code", "num", "ref")
NUMERIC = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
TIME = r"^(date|timestamp|timestamp_ntz)$"


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, (c.contains(w) for w in words))


def numeric() -> Column:
    return F.col("data_type").rlike(NUMERIC)


def temporal() -> Column:
    return F.col("data_type").rlike(TIME)


def unique() -> Column:
    return (F.col("distinct_count") == F.col("total")) & (F.col("null_count") == 0)


def entity_names(catalog: DataFrame) -> DataFrame:
    """A table's entity: by its own name, else by the words that its columns hold most, else the table's name made readable."""
    low, column = F.lower("table_name"), F.lower("column_name")
    hits = {k: F.sum(reduce(lambda a, b: a + b, (column.contains(w).cast("int") for w in words))).alias(k) for k, words in ENTITIES.items()}
    scored = catalog.groupBy("table_name").agg(*hits.values())
    by_name = F.coalesce(*(F.when(_any(low, words), k.title()) for k, words in ENTITIES.items()))
    best = F.greatest(*(F.col(k) for k in ENTITIES))
    by_columns = F.when(best > 0, F.coalesce(*(F.when(F.col(k) == best, k.title()) for k in ENTITIES)))
    plain = F.initcap(F.replace(F.regexp_replace(low, r"\.(csv|xlsx?)|data_|_data|export_|_export", ""), F.lit("_"), F.lit(" ")))
    return scored.select("table_name", F.coalesce(by_name, by_columns, plain).alias("entity"))


def entity_types(catalog: DataFrame) -> DataFrame:
    """Whether a table is a fact or a dimension, by its measures, keys and dates."""
    low = F.lower("column_name")
    flags = catalog.groupBy("table_name").agg(
        F.avg(numeric().cast("int")).alias("share"), F.max(low.isin(*MEASURES)).alias("measured"), F.max(temporal()).alias("dated"), F.count_if(_any(low, KEY_WORDS) & (low != "id")).alias("keys")
    )
    fact = ((F.col("share") > 0.3) & F.col("measured")) | (F.col("keys") > 2) | (F.col("dated") & (F.col("keys") > 0))
    return flags.select("table_name", F.when(fact, "fact").otherwise("dimension").alias("entity_type"))


def column_tags(catalog: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Sorted tags of each column, by the words in its name, its type, and whether it is unique or (with keys, as of primary_keys) the table's key."""
    low = F.lower("column_name")
    if keys is not None:
        catalog = catalog.join(keys.where("not generated").select("table_name", F.col("primary_key").alias("column_name"), F.lit(True).alias("is_key")), ["table_name", "column_name"], "left")
    key = F.coalesce("is_key", F.lit(False)) if keys is not None else F.lit(False)
    more = {"Temporal": temporal(), "Identifier": unique() | key}
    tags = F.array(*(F.when(_any(low, words) | more.get(tag, F.lit(False)), tag) for tag, words in TAGS.items()))
    return catalog.select("table_name", "column_name", F.concat_ws(",", F.sort_array(F.array_compact(tags))).alias("tags"))


def tag_distribution(tags: DataFrame) -> DataFrame:
    """(table_name, column_name, tags) to (tag, columns, coverage): columns with each tag, and the share in percent of columns with any."""
    split = tags.select(F.filter(F.split("tags", ","), lambda x: x != "").alias("each"))
    coverage = split.agg(F.round(F.avg((F.size("each") > 0).cast("double")) * 100, 2).alias("coverage"))
    return split.select(F.explode("each").alias("tag")).groupBy("tag").agg(F.count("*").alias("columns")).join(F.broadcast(coverage))  # one row


def merged_tags(tags: DataFrame, given: DataFrame) -> DataFrame:
    """The distinct tags of both lists of each column, sorted; a column of either side is in the result."""
    both = tags.select("table_name", "column_name", "tags").join(given.select("table_name", "column_name", F.col("tags").alias("more")), ["table_name", "column_name"], "full")
    lists = F.array_union(F.split(F.coalesce("tags", F.lit("")), ","), F.split(F.coalesce("more", F.lit("")), ","))
    return both.select("table_name", "column_name", F.array_join(F.sort_array(F.filter(lists, lambda x: x != "")), ",").alias("tags"))


def column_context(catalog: DataFrame) -> DataFrame:
    """What a column's gaps, number of values and name say about its use."""
    gap = F.when(F.col("total") > 0, F.col("null_count") * 100.0 / F.col("total")).otherwise(0.0)
    # The phrases
    gaps = F.when(gap > 50, "High null rate - may indicate optional or incomplete data").when(gap == 0, "Complete data - no missing values")
    values = F.when(F.col("distinct_count") == 1, "Single value across all records").when(F.col("distinct_count") < 10, "Limited set of values - likely categorical")
    joins = F.when(F.lower("column_name").contains("id"), "Can be used for joining with related tables")
    text = F.concat_ws(". ", gaps, values, joins)
    return catalog.select("table_name", "column_name", F.when(text != "", text).otherwise("Standard data field").alias("context"))


def column_purpose(name: Column, tags: Column) -> Column:
    """What a column is for, by its name, else by its tags (a text, separated by commas)."""
    low, listed = F.lower(name), F.split(tags, ",")
    by_name = [F.when(_any(low, words), text) for words, text in PURPOSES]
    reference = F.when(low.endswith("_id"), F.concat(F.lit("Reference to "), F.replace(F.replace(low, F.lit("_id"), F.lit("")), F.lit("_"), F.lit(" "))))
    by_tag = [F.when(F.array_contains(listed, tag), text) for tag, text in TAG_PURPOSES]
    return F.coalesce(*by_name, reference, *by_tag, F.concat(F.lit("Data field for "), F.lower(F.replace(name, F.lit("_"), F.lit(" ")))))


def column_descriptions(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """A line on each column: key or purpose, kind of type, and whether it is required (holds no NULL)."""
    df = catalog.join(column_tags(catalog, keys), ["table_name", "column_name"]).join(keys.select("table_name", "primary_key"), "table_name", "left")
    lead = F.when(F.col("column_name") == F.col("primary_key"), "Primary key identifier").when(F.array_contains(F.split("tags", ","), "Identifier"), "Unique identifier").otherwise(column_purpose(F.col("column_name"), F.col("tags")))
    kind = F.when(temporal(), "(timestamp)").when(F.col("data_type") == "string", "(text)").when(numeric(), "(numeric)")
    return df.select("table_name", "column_name", F.concat_ws(" ", lead, kind, F.when(F.col("null_count") == 0, "- Required field")).alias("description"))


def column_roles(catalog: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """numeric, time or categorical, and the plain type that a result's schema names. With first (table_name, column_name, value: a
    first value as text), a text column whose value looks like a date or a year and month is a time."""
    role = F.when(temporal(), "time").when(numeric(), "numeric")
    if first is not None:
        catalog = catalog.join(first.select("table_name", "column_name", "value"), ["table_name", "column_name"], "left")
        role = role.when(F.col("value").rlike(r"^\d{4}-\d{2}(-\d{2}([T ].*)?)?$"), "time")
    plain = F.when(numeric(), "number").when(F.col("data_type") == "string", "string").otherwise("unknown")
    return catalog.select("table_name", "column_name", role.otherwise("categorical").alias("role"), plain.alias("plain_type"))


def metadata_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What to do with each table of two catalogs: create, remove, update (a column or type differs) or leave unchanged."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.expr("o.table_name = n.table_name and o.column_name = n.column_name"), "full")
    name = F.coalesce("o.table_name", "n.table_name").alias("table_name")
    counts = both.groupBy(name).agg(F.count("o.table_name").alias("had"), F.count("n.table_name").alias("has"), F.count_if(F.expr("o.data_type = n.data_type")).alias("same"))
    action = F.when(F.col("had") == 0, "create").when(F.col("has") == 0, "remove").when((F.col("same") == F.col("had")) & (F.col("same") == F.col("has")), "unchanged").otherwise("update")
    return counts.select("table_name", action.alias("action"))


def valid_relationships(proposed: DataFrame, catalog: DataFrame, floor: float = 0.4) -> DataFrame:
    """Proposals (from_table, from_column, to_table, to_column, confidence) whose both ends are in the catalog, at least at the floor."""
    known = catalog.select("table_name", "column_name").distinct()
    for end in ("from", "to"):
        proposed = proposed.join(known.toDF(f"{end}_table", f"{end}_column"), [f"{end}_table", f"{end}_column"], "left_semi")
    return proposed.select("from_table", "from_column", "to_table", "to_column", F.greatest("confidence", F.lit(floor)).alias("confidence"))


def relationships_of(relationships: DataFrame, table: str) -> DataFrame:
    return relationships.where((F.col("from_table") == table) | (F.col("to_table") == table))


def write_snapshot(parts: dict[str, DataFrame], path: str, job: str, run: str) -> DataFrame:
    """Write each kind of a run's metadata (entities, columns, relationships, lineage) below path, partitioned by job and run, and return
    how many records of each kind that run has now. A run that is written again replaces its records."""
    counts = []
    for kind, df in parts.items():
        df.withColumns({"job": F.lit(job), "run": F.lit(run)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", "run").parquet(f"{path}/{kind}")
        written = df.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, job string, run string").parquet(f"{path}/{kind}")
        counts.append(written.where((F.col("job") == job) & (F.col("run") == run)).agg(F.count("*").alias("records")).select(F.lit(kind).alias("kind"), "records"))
    return reduce(DataFrame.unionByName, counts)


def nearest_columns(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(table_name, word) to the table's column of least edit distance; of equals the first by name."""
    pairs = asked.join(catalog.select("table_name", "column_name"), "table_name")
    near = F.min(F.struct(F.levenshtein(F.lower("word"), F.lower("column_name")).alias("d"), "column_name"))
    return pairs.groupBy("table_name", "word").agg(near.alias("m")).select("table_name", "word", F.col("m.column_name").alias("column_name"), F.col("m.d").alias("distance"))


def audit_queries(log: DataFrame, known: DataFrame, catalog: str = "spark_catalog", schema: str = "default") -> DataFrame:
    """(query_id, sql) and (table_name) to whether each query only reads, the tables it names that are unknown, and the columns that it
    groups by but doesn't select, each list sorted. Names of one, two or three parts are told apart: what is missing is the given
    catalog and schema, on both sides. Words in text literals and comments don't count.

    A cheap screen of a log by patterns, over any number of queries; `plans.intent` runs a query only after Spark has parsed it."""
    bare = F.regexp_replace(F.regexp_replace(F.lower("sql"), r"(?s)--[^\n]*|/\*.*?\*/", " "), r"'(?:[^']|'')*'", "''")
    log = log.select("query_id", bare.alias("text"))
    reads = F.col("text").rlike(r"^\s*(select|with)\b") & ~F.col("text").rlike(r"\b(insert|update|delete|drop|create|alter|truncate|merge)\b")

    def whole(name: Column) -> Column:
        parts = F.size(F.split(name, r"\."))
        return F.when(parts == 1, F.concat(F.lit(f"{catalog}.{schema}."), name)).when(parts == 2, F.concat(F.lit(f"{catalog}."), name)).otherwise(name)

    named = F.array_distinct(F.expr(r"regexp_extract_all(text, '\\b(?:from|join)\\s+([a-z_][a-z0-9_.]*)', 1)"))
    made = F.expr(r"regexp_extract_all(text, '(?:\\bwith|,)\\s*([a-z_][a-z0-9_]*)\\s+as\\s*\\(', 1)")
    tables = log.select("query_id", F.explode(F.array_except(named, made)).alias("table_name")).withColumn("whole", whole(F.col("table_name")))
    there = known.select(whole(F.lower("table_name")).alias("whole")).distinct()
    unknown = tables.join(there, "whole", "left_anti").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("table_name")), ",").alias("unknown"))
    grouped = F.regexp_extract("text", r"(?s)\bgroup\s+by\s+(.+?)(?:\border\s+by\b|\bhaving\b|\blimit\b|$)", 1)
    shown = F.regexp_extract("text", r"(?s)\bselect\s+(.+?)\s+from\b", 1)
    columns = F.transform(F.split(grouped, ","), lambda c: F.element_at(F.split(F.trim(c), r"\."), -1))
    absent = F.filter(columns, lambda c: (c != "") & ~F.contains(shown, c))
    missing = F.when((grouped != "") & (shown != ""), F.array_join(F.sort_array(F.array_distinct(absent)), ",")).otherwise("")
    out = log.select("query_id", F.coalesce(reads, F.lit(False)).alias("read_only"), F.coalesce(missing, F.lit("")).alias("not_selected")).join(unknown, "query_id", "left")
    return out.select("query_id", "read_only", F.coalesce("unknown", F.lit("")).alias("unknown_tables"), "not_selected")


def relation_types(relationships: DataFrame, catalog: DataFrame) -> DataFrame:
    """Type of each relationship (from_table, from_column, to_table, to_column), by relation_type."""
    ends = catalog.select("table_name", "column_name", "distinct_count", unique().alias("u"))
    out = relationships.join(ends.toDF("from_table", "from_column", "n", "nu"), ["from_table", "from_column"]).join(ends.toDF("to_table", "to_column", "m", "mu"), ["to_table", "to_column"])
    kind = relation_type(F.col("n"), F.col("m"), F.col("nu"), F.col("mu"))
    return out.select("from_table", "from_column", "to_table", "to_column", kind.alias("relation"))


def relation_type(n: Column, m: Column, unique_from: Column, unique_to: Column) -> Column:
    """By the distinct counts of two columns, where neither is empty: over twice as many on one side make it the many; else one unique side is
    `one` in the name's first place for the first column, in its last for the second; two unique sides, or none, are many to many."""
    some = (n > 0) & (m > 0)
    by_count = F.when(some & (n > 2 * m), "many_to_one").when(some & (2 * n < m), "one_to_many")
    return by_count.when(unique_from & ~unique_to, "one_to_many").when(unique_to & ~unique_from, "many_to_one").otherwise("many_to_many")


def entity_descriptions(catalog: DataFrame) -> DataFrame:
    """A line for each table: what its kind of entity stands for, else whether it is a fact or a dimension."""
    e = entity_names(catalog).join(entity_types(catalog), "table_name")
    known = [F.when(F.lower("entity").contains(kind), text) for kind, text in ENTITY_TEXTS.items()]
    # The two phrases
    other = F.when(F.col("entity_type") == "fact", F.concat(F.lit("Fact table containing transactional data related to "), "entity")).otherwise(F.concat(F.lit("Dimension table containing descriptive information about "), "entity"))
    return e.select("table_name", F.coalesce(*known, other).alias("description"))


def relationship_descriptions(relationships: DataFrame) -> DataFrame:
    """(from_table, from_column, to_table, to_column, relation) with a sentence on each."""
    a, b, via = F.col("from_table"), F.col("to_table"), F.col("from_column")
    # The phrases
    text = F.when(F.col("relation") == "many_to_one", F.format_string("Each %s belongs to one %s (via %s)", a, b, via))
    text = text.when(F.col("relation") == "one_to_many", F.format_string("Each %s can have multiple %s records", b, a))
    text = text.when(F.col("relation") == "one_to_one", F.format_string("One-to-one relationship between %s and %s", a, b))
    return relationships.select("from_table", "from_column", "to_table", "to_column", text.otherwise(F.format_string("Relationship between %s and %s", a, b)).alias("description"))


# ---- keys and relationships


def primary_keys(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """(table_name, column_name, rank), as of relate.key_candidates, to each table's key: the first candidate, else an `id` to be generated."""
    best = candidates.where("rank = 1").select("table_name", F.col("column_name").alias("primary_key"))
    tables = catalog.select("table_name").distinct().join(best, "table_name", "left")
    return tables.select("table_name", F.coalesce("primary_key", F.lit("id")).alias("primary_key"), F.col("primary_key").isNull().alias("generated"))


def name_variations(name: Column) -> Column:
    """Spellings of a table's name that may stand in a column's: as it is, without a plural s, with underscores, and its first four letters."""
    low = F.lower(name)
    singular = F.when(low.endswith("s"), low.substr(F.lit(1), F.length(low) - 1))
    return F.array_distinct(F.array_compact(F.array(low, singular, F.replace(low, F.lit(" "), F.lit("_")), F.when(F.length(low) > 4, F.substring(low, 1, 4)))))


def _parts(text: Column) -> Column:
    """All distinct substrings of a short text."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(text, i, k)))))


def foreign_keys(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns whose names hold a spelling of another table's name, as (from_table, from_column, to_table, to_column, relation,
    confidence): 0.4 for `id` in the name, 0.3 for the type of the other table's key, 0.3 for that table's full name; above 0.

    An equi join of the columns' substrings with the spellings: catalogs are as large as the schema, and no pair is looked at that
    doesn't match."""
    c = catalog.where("column_name != ''").select("table_name", "column_name", "data_type", F.explode(_parts(F.lower("column_name"))).alias("spelling"))
    to = keys.select(F.col("table_name").alias("to_table"), "primary_key", F.explode(name_variations(F.col("table_name"))).alias("spelling"))
    types = catalog.select(F.col("table_name").alias("to_table"), F.col("column_name").alias("primary_key"), F.col("data_type").alias("key_type"))
    found = c.join(to, "spelling").where("table_name != to_table").drop("spelling").distinct().join(types, ["to_table", "primary_key"], "left")
    low = F.lower("column_name")
    part = lambda when, x: F.when(when, x).otherwise(0.0)
    score = part(low.contains("id"), 0.4) + part(F.col("key_type") == F.col("data_type"), 0.3) + part(F.contains(low, F.lower("to_table")), 0.3)
    out = found.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "to_table", F.col("primary_key").alias("to_column"), F.lit("many_to_one").alias("relation"), F.round(score, 2).alias("confidence"))
    return out.where("confidence > 0")


def deduplicated(relationships: DataFrame, above: float = 0.3) -> DataFrame:
    """Of relationships with (from_table, to_table, from_column) the one of the highest confidence, the least `seq` among equals; those
    above the floor stay."""
    best = F.row_number().over(Window.partitionBy("from_table", "to_table", "from_column").orderBy(F.desc("confidence"), "seq"))
    return relationships.withColumn("__n", best).where((F.col("__n") == 1) & (F.col("confidence") > above)).drop("__n")


def discovered_relationships(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    """Relationships of all pairs of tables by foreign-key names and by equal column names, the best for each column and table.
    Foreign keys go first among equals."""
    from millrace.operators.relate import common_columns

    by_name = foreign_keys(catalog, keys).withColumn("seq", F.lit(0))
    shared = common_columns(catalog, keys, both_ways=True).select("from_table", F.col("column_name").alias("from_column"), "to_table", F.col("to_column"), "relation", "confidence", F.lit(1).alias("seq"))
    return deduplicated(by_name.unionByName(shared)).drop("seq")


def discovery_metrics(catalog: DataFrame, relationships: DataFrame) -> DataFrame:
    """Tables, relationships, and tables that have any, in one row."""
    ends = relationships.select(F.explode(F.array("from_table", "to_table")).alias("t")).agg((F.count("*") / 2).cast("long").alias("relationships"), F.count_distinct("t").alias("related_tables"))
    return catalog.agg(F.count_distinct("table_name").alias("tables")).join(F.broadcast(ends))  # one row by one row


def related(relationships: DataFrame, edges: DataFrame) -> DataFrame:
    """Which of the asked edges (a, b) exist between two tables, in either direction."""
    ways = relationships.select(F.col("from_table").alias("a"), F.col("to_table").alias("b")).unionByName(relationships.select(F.col("to_table").alias("a"), F.col("from_table").alias("b"))).distinct()
    found = edges.join(ways.withColumn("exists", F.lit(True)), ["a", "b"], "left")
    return found.select("a", "b", F.coalesce("exists", F.lit(False)).alias("exists"))


# ---- one job over a catalog


def discovered_tables(catalog: DataFrame) -> DataFrame:
    """All that discovery tells of each table: entity, class, description, key, columns, rows, relationships that start there, and
    the tags of its columns, sorted. The catalog should be written once; nothing here reads data again."""
    from millrace.operators.relate import key_candidates

    keys = primary_keys(key_candidates(catalog), catalog)
    links = discovered_relationships(catalog, keys).groupBy(F.col("from_table").alias("table_name")).agg(F.count("*").alias("relationships"))
    sizes = catalog.groupBy("table_name").agg(F.count("*").alias("columns"), F.max("total").alias("n_rows"))
    listed = F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("tags", ","), lambda x: x != ""))))
    tags = column_tags(catalog, keys).groupBy("table_name").agg(F.array_join(F.sort_array(listed), ",").alias("tags"))
    out = keys.select("table_name", "primary_key")
    for part in (entity_names(catalog), entity_types(catalog), entity_descriptions(catalog), sizes, tags):
        out = out.join(part, "table_name")
    out = out.join(links, "table_name", "left")
    return out.select("table_name", "entity", "entity_type", "description", "primary_key", "columns", "n_rows", F.coalesce("relationships", F.lit(0)).alias("relationships"), "tags")


def discovered_columns(catalog: DataFrame, samples: DataFrame, numbers: DataFrame) -> DataFrame:
    """All that discovery tells of each column: definition with its first values (samples, as of profile.column_samples, with table_name), tags,
    description and context, and what numbers (table_name, column_name, ...) adds for numeric ones."""
    from millrace.operators.relate import column_definitions, key_candidates

    keys = primary_keys(key_candidates(catalog), catalog)
    out = column_definitions(catalog, keys, samples)
    for part in (column_tags(catalog, keys), column_descriptions(catalog, keys), column_context(catalog)):
        out = out.join(part, ["table_name", "column_name"])
    return out.join(numbers, ["table_name", "column_name"], "left")


# ---- schema documents


def schema_summary(catalog: DataFrame) -> DataFrame:
    """For each table its columns, those that hold NULLs, the others, and how many there are of each type, sorted by type."""
    kinds = catalog.groupBy("table_name", "data_type").agg(F.count("*").alias("n"), F.count_if(F.col("null_count") > 0).alias("nullable"))
    types = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("data_type", "n"))), lambda x: F.concat_ws(":", x["data_type"], x["n"].cast("string"))), ",")
    return kinds.groupBy("table_name").agg(F.sum("n").alias("columns"), F.sum("nullable").alias("nullable"), (F.sum("n") - F.sum("nullable")).alias("required"), types.alias("types"))


def schema_text(catalog: DataFrame, descriptions: DataFrame) -> DataFrame:
    """For each table its name and a line for each column in order: name, type and, where there is one, description."""
    c = catalog.join(descriptions, ["table_name", "column_name"], "left")
    line = F.concat(F.lit("  - "), "column_name", F.lit(" ("), "data_type", F.lit(")"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), "description")).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return c.groupBy("table_name").agg(F.array_join(lines, "\n").alias("lines")).select("table_name", F.concat_ws("\n", F.concat(F.lit("Table: "), "table_name"), F.lit("Columns:"), "lines").alias("text"))


def catalog_search(catalog: DataFrame, words: str, n: int = 10) -> DataFrame:
    """The first n tables whose name, or the name or description of whose columns, holds the words in any letter case: those with a hit in their name
    first, then by the number of columns hit, then by name."""
    hit = lambda c: F.coalesce(F.col(c).contains(words.lower()), F.lit(False))
    low = catalog.select("table_name", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"), F.lower(F.col("description") if "description" in catalog.columns else F.lit("")).alias("d"))
    found = low.groupBy("table_name").agg(F.max(hit("t")).alias("in_name"), F.count_if(hit("c") | hit("d")).alias("columns_hit"))
    return found.where("in_name or columns_hit > 0").orderBy(F.desc("in_name"), F.desc("columns_hit"), "table_name").limit(n)


def schema_violations(documents: DataFrame) -> DataFrame:
    """(document_id, document: a JSON text with entities, relationships and businessTags) to rows (document_id, place, violation) of all
    that is wrong with each: every violation, not only the first."""
    column = "struct<name:string,data_type:string>"
    entity = f"struct<name:string,column_details:array<{column}>>"
    relation = "struct<`from`:string,`to`:string,from_column:string,to_column:string,foreign_key:string,`references`:string,relationship_type:string,`type`:string>"
    schema = f"struct<entities:array<{entity}>,relationships:array<{relation}>,businessTags:map<string,string>>"
    doc = documents.select("document_id", F.from_json("document", schema).alias("d"))
    doc = doc.select("document_id", "d", F.coalesce(F.transform("d.entities", lambda e: e["name"]), F.array().cast("array<string>")).alias("names"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = [doc.where("d is null or d.entities is null or size(d.entities) = 0").select("document_id", F.lit("entities").alias("place"), F.lit("at least one entity is required").alias("violation"))]

    def said(df: DataFrame, place: Column, *found: Column) -> DataFrame:
        return df.select("document_id", place.alias("place"), F.explode(F.array_compact(F.array(*found))).alias("violation"))

    entities = doc.select("document_id", F.posexplode("d.entities").alias("i", "e"))
    rows.append(said(entities, F.format_string("entity %d", "i"), F.when(blank(F.col("e.name")), "no name")))
    columns = entities.select("document_id", "i", F.posexplode("e.column_details").alias("j", "c"))
    rows.append(said(columns, F.format_string("entity %d column %d", "i", "j"), F.when(blank(F.col("c.name")), "no name"), F.when(blank(F.col("c.data_type")), "no data_type")))
    links = doc.select("document_id", "names", F.posexplode("d.relationships").alias("i", "r"))
    kind = F.coalesce("r.relationship_type", "r.type")
    ended = (F.col("r.from_column").isNotNull() & F.col("r.to_column").isNotNull()) | (F.col("r.foreign_key").isNotNull() & F.col("r.references").isNotNull())
    unknown = [F.when(F.col(f"r.{end}").isNotNull() & ~F.array_contains("names", F.col(f"r.{end}")), F.concat(F.lit(f"unknown {end} entity "), F.col(f"r.{end}"))) for end in ("from", "to")]
    absent = F.when(F.col("r.from").isNull() | F.col("r.to").isNull(), "no from or to")
    rows.append(said(links, F.format_string("relationship %d", "i"), absent, F.when(~ended, "no columns"), F.when(blank(kind), "no type"), F.when(~blank(kind) & ~kind.isin(*RELATION_TYPES), F.concat(F.lit("invalid type "), kind)), *unknown))
    tags = doc.select("document_id", F.explode("d.businessTags").alias("tag", "value"))
    rows.append(said(tags, F.concat(F.lit("tag "), "tag"), F.when(~F.coalesce(F.col("value").rlike(r"^\s*\["), F.lit(False)), "no list")))
    return reduce(DataFrame.unionByName, rows)

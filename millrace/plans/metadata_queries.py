"""Queries over the catalog of the tables, and over shapes of results for charts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import charts as H
from millrace.operators import metadata as M
from millrace.operators import profile as P
from millrace.operators import relate as R
from millrace.operators import reports as O
from millrace.plans import intent as I
from millrace.plans.registry import TABLES, Tables, query
from millrace.plans.schemas import COLUMNS, catalog_sql, plain
from millrace.sources import files as S
from millrace.sources.scratch import kept, scratch

_SIMPLE = "case when data_type in ('timestamp', 'timestamp_ntz', 'date') then 'time' when data_type in ('int', 'bigint', 'double') then 'numeric' else 'categorical' end"
_UNIQUE = "distinct_count = total and null_count = 0"


def _plain(t: Tables, name: str) -> DataFrame:
    df = getattr(t, name)
    return df.withColumnsRenamed({c: plain(c) for c in df.columns})


def _catalog(t: Tables) -> DataFrame:
    """Every column of all tables, with exact distinct counts as the SQL has them; written once, so that what follows works on its few rows."""
    return kept(P.column_catalog({k: _plain(t, k) for k in TABLES}, exact=True), "catalog")


_SQL = f"with c as ({catalog_sql()}) "


def _like(name: str, words) -> str:
    return "(" + " or ".join(f"contains({name}, '{w}')" for w in words) + ")"


_KEY_RANK = f"k as (select table_name, column_name, ordinal, data_type, case when column_name = 'id' then 0 when column_name like '%\\_id' escape '\\' then 1 when contains(column_name, 'id') then 2 else 3 end as kind from c where {_like('column_name', M.KEY_WORDS)} or (distinct_count > 0.95 * total and null_count = 0)), r as (select *, row_number() over (partition by table_name order by kind, ordinal) as rank from k), pk as (select t.table_name, coalesce(r.column_name, 'id') as primary_key, r.column_name is null as generated, r.data_type as key_type from (select distinct table_name from c) t left join r on r.table_name = t.table_name and r.rank = 1)"


def _keys(c: DataFrame) -> DataFrame:
    return M.primary_keys(R.key_candidates(c), c)


_SCORES = ", ".join("sum(" + " + ".join(f"contains(column_name, '{w}')::int" for w in words) + f") as s{i}" for i, words in enumerate(M.ENTITIES.values()))
_BEST = "greatest(" + ", ".join(f"s{i}" for i in range(len(M.ENTITIES))) + ")"
_NAMED = " ".join(f"when {_like('table_name', words)} then '{k.title()}'" for k, words in M.ENTITIES.items())
_SCORED = " ".join(f"when {_BEST} > 0 and s{i} = {_BEST} then '{k.title()}'" for i, k in enumerate(M.ENTITIES))


@query(_SQL + f", s as (select table_name, {_SCORES} from c group by table_name) select table_name, case {_NAMED} {_SCORED} else upper(table_name[1]) || table_name[2:] end as entity from s")
def entity_names(t):
    return M.entity_names(_catalog(t))


@query(_SQL + f", f as (select table_name, avg(({_SIMPLE} = 'numeric')::int) as share, bool_or(column_name in {M.MEASURES}) as measured, bool_or({_SIMPLE} = 'time') as dated, count(*) filter (where {_like('column_name', M.KEY_WORDS)} and column_name <> 'id') as keys from c group by table_name) select table_name, case when (share > 0.3 and measured) or keys > 2 or (dated and keys > 0) then 'fact' else 'dimension' end as entity_type from f")
def entity_types(t):
    return M.entity_types(_catalog(t))


_NAMES_CTE = f"n as (select table_name, {_SCORES} from c group by table_name), e as (select table_name, case {_NAMED} {_SCORED} else upper(table_name[1]) || table_name[2:] end as entity from n)"
_TYPES_CTE = f"ft as (select table_name, avg(({_SIMPLE} = 'numeric')::int) as share, bool_or(column_name in {M.MEASURES}) as measured, bool_or({_SIMPLE} = 'time') as dated, count(*) filter (where {_like('column_name', M.KEY_WORDS)} and column_name <> 'id') as keys from c group by table_name), et as (select table_name, case when (share > 0.3 and measured) or keys > 2 or (dated and keys > 0) then 'fact' else 'dimension' end as entity_type from ft)"


@query(catalog_sql())
def column_catalog(t):
    return _catalog(t)


@query(_SQL + "select table_name, column_name, data_type, true as nullable, case when column_name = 'mktsegment' then 'market segment' else '' end as comment from c")
def column_comments(t):
    tables = {k: _plain(t, k) for k in TABLES}
    tables["customer"] = tables["customer"].withMetadata("mktsegment", {"comment": "market segment"})
    return P.column_catalog(tables, comments=True).select("table_name", "column_name", "data_type", "nullable", "comment")


@query("select 'orders' as table_name, count(distinct o_orderpriority)::integer as files, cast(sum(strlen(o_orderkey || ';' || o_orderstatus) + 1) as bigint) as bytes from orders union all select 'part', count(distinct p_brand)::integer, cast(sum(strlen(p_name) + 1) as bigint) from part")
def table_bytes(t):
    """Files and bytes of two tables' folders, each written as text with a file for each priority or brand."""
    paths = {x: scratch(t.spark, x) for x in ("orders", "part")}
    t.orders.select("o_orderpriority", F.concat_ws(";", "o_orderkey", "o_orderstatus").alias("value")).repartition("o_orderpriority").write.partitionBy("o_orderpriority").text(paths["orders"])
    t.part.select("p_brand", F.col("p_name").alias("value")).repartition("p_brand").write.partitionBy("p_brand").text(paths["part"])
    return S.folder_bytes(t.spark, paths).select("table_name", F.col("files").cast("int").alias("files"), "bytes")


@query(_SQL + ", " + _KEY_RANK + " select table_name, column_name, round(distinct_count / total, 4) as uniqueness, cast(kind as integer) as kind, cast(rank as integer) as rank from r join c using (table_name, column_name)")
def pk_candidates(t):
    return R.key_candidates(_catalog(t))


#: What the rows of each table are ordered by, for its first values.
_ORDERED = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"]}
_FIRST = "sa as (" + " union all ".join(f"select '{x}' as table_name, '{plain(c)}' as column_name, array_to_string((list({c}::varchar order by {', '.join(_ORDERED[x])}) filter (where {c} is not null))[1:3], ',') as samples from {x}" for x, columns in COLUMNS.items() for c in columns) + ")"


def _samples(t: Tables) -> DataFrame:
    """The first three values of every column of all tables."""
    named = lambda x: P.column_samples(getattr(t, x), list(COLUMNS[x]), _ORDERED[x], 3).withColumn("column_name", F.regexp_replace("column_name", "^._", "")).withColumn("table_name", F.lit(x))
    return reduce(DataFrame.unionByName, map(named, TABLES))


@query(_SQL + ", " + _KEY_RANK + f", {_FIRST} select table_name, column_name, data_type, null_count > 0 as nullable, {_UNIQUE} as is_unique, column_name = primary_key as is_key, samples from c join pk using (table_name) join sa using (table_name, column_name)")
def column_definitions(t):
    c = _catalog(t)
    return R.column_definitions(c, _keys(c), _samples(t))


@query(_SQL + "select table_name, column_name, case data_type when 'bigint' then 'bigint' when 'int' then 'int' when 'double' then 'double' when 'string' then 'string' else 'timestamp' end as engine_type from c")
def map_types(t):
    declared = F.when(F.col("data_type") == "bigint", "LONG").when(F.col("data_type") == "int", "Integer").when(F.col("data_type") == "double", "float").when(F.col("data_type") == "string", "VARCHAR(255)").otherwise("datetime")
    return _catalog(t).select("table_name", "column_name", C.engine_type_column(declared).alias("engine_type"))


_MORE = {"Temporal": f" or {_SIMPLE} = 'time'", "Identifier": f" or ({_UNIQUE}) or coalesce(column_name = primary_key and not generated, false)"}
_TAG_CTE = "t as (select c.table_name, c.column_name, concat_ws(',', " + ", ".join(f"case when {_like('column_name', M.TAGS[k])}{_MORE.get(k, '')} then '{k}' end" for k in sorted(M.TAGS)) + ") as tags from c left join pk using (table_name))"
_TAGS_CTE = _KEY_RANK + ", " + _TAG_CTE


@query(_SQL + ", " + _TAGS_CTE + " select table_name, column_name, tags from t")
def column_tags(t):
    c = _catalog(t)
    return M.column_tags(c, _keys(c))


@query(_SQL + ", " + _TAGS_CTE + " select tag, count(*) as columns, (select round(avg((tags <> '')::int) * 100, 2) from t) as coverage from (select unnest(string_split(tags, ',')) as tag from t where tags <> '') group by tag")
def tag_distribution(t):
    c = _catalog(t)
    return M.tag_distribution(M.column_tags(c, _keys(c)))


@query(_SQL + ", " + _TAGS_CTE + " select table_name, column_name, array_to_string(list_sort(list_distinct(list_filter(string_split(tags, ',') || ['Reviewed', 'Identifier'], lambda x: x <> ''))), ',') as tags from t")
def merge_tags(t):
    c = _catalog(t)
    given = c.select("table_name", "column_name", F.lit("Reviewed,Identifier").alias("tags"))
    return M.merged_tags(M.column_tags(c, _keys(c)), given)


@query(_SQL + "select table_name, column_name, case when x = '' then 'Standard data field' else x end as context from (select table_name, column_name, concat_ws('. ', case when null_count * 100.0 / total > 50 then 'High null rate - may indicate optional or incomplete data' when null_count = 0 then 'Complete data - no missing values' end, case when distinct_count = 1 then 'Single value across all records' when distinct_count < 10 then 'Limited set of values - likely categorical' end, case when contains(column_name, 'id') then 'Can be used for joining with related tables' end) as x from c)")
def column_context(t):
    return M.column_context(_catalog(t))


_PURPOSE = "coalesce(" + ", ".join(f"case when {_like('column_name', words)} then '{text}' end" for words, text in M.PURPOSES) + r", case when column_name like '%\_id' escape '\' then 'Reference to ' || replace(replace(column_name, '_id', ''), '_', ' ') end, " + ", ".join(f"case when list_contains(string_split(tags, ','), '{tag}') then '{text}' end" for tag, text in M.TAG_PURPOSES) + ", 'Data field for ' || replace(column_name, '_', ' '))"
_DESCRIBED = f", ds as (select c.table_name, c.column_name, concat_ws(' ', case when column_name = primary_key then 'Primary key identifier' when list_contains(string_split(tags, ','), 'Identifier') then 'Unique identifier' else {_PURPOSE} end, case {_SIMPLE} when 'time' then '(timestamp)' when 'numeric' then '(numeric)' else '(text)' end, case when null_count = 0 then '- Required field' end) as description from c join t using (table_name, column_name) join pk using (table_name))"


@query(_SQL + ", " + _TAGS_CTE + _DESCRIBED + " select * from ds")
def column_descriptions(t):
    c = _catalog(t)
    return M.column_descriptions(c, _keys(c))


@query(_SQL + ", " + _TAGS_CTE + _DESCRIBED + " select table_name, 'Table: ' || table_name || chr(10) || 'Columns:' || chr(10) || string_agg('  - ' || column_name || ' (' || data_type || ') - ' || description, chr(10) order by ordinal) as text from c join ds using (table_name, column_name) group by table_name")
def schema_text(t):
    c = _catalog(t)
    return M.schema_text(c, M.column_descriptions(c, _keys(c)))


@query(_SQL + "select table_name, cast(count(*) as bigint) as columns, count(*) filter (where null_count > 0) as nullable, count(*) filter (where null_count = 0) as required, (select string_agg(data_type || ':' || n, ',' order by data_type) from (select data_type, count(*) as n from c x where x.table_name = c.table_name group by data_type)) as types from c group by table_name")
def schema_summary(t):
    return M.schema_summary(_catalog(t))


@query(_SQL + ", h as (select table_name, contains(table_name, 'part') as in_name, count(*) filter (where contains(column_name, 'part')) as columns_hit from c group by table_name) select * from h where in_name or columns_hit > 0 order by in_name desc, columns_hit desc, table_name limit 10")
def catalog_search(t):
    return M.catalog_search(_catalog(t), "Part")


@query(_SQL + ", " + _KEY_RANK + " select table_name, primary_key, generated from pk")
def primary_keys(t):
    return _keys(_catalog(t))


_SCORE = "round(0.4 + case when a.data_type = b.data_type then 0.3 else 0 end + case when " + _like("a.column_name", M.LINK_WORDS) + " then 0.2 else 0 end + case when greatest(a.distinct_count, b.distinct_count) / least(a.distinct_count, b.distinct_count) > 2 then 0.1 else 0 end, 2)::double"
_KIND = "case when a.distinct_count / b.distinct_count > 2 then 'many_to_one' when a.distinct_count / b.distinct_count < 0.5 then 'one_to_many' when a.distinct_count = a.total and a.null_count = 0 and not (b.distinct_count = b.total and b.null_count = 0) then 'one_to_many' when b.distinct_count = b.total and b.null_count = 0 and not (a.distinct_count = a.total and a.null_count = 0) then 'many_to_one' else 'many_to_many' end"
_SHARED = f"cc as (select a.table_name as from_table, a.column_name as from_column, b.table_name as to_table, b.column_name as to_column, {_KIND} as relation, {_SCORE} as confidence, 1 as seq from c a join c b on a.column_name = b.column_name and a.table_name <> b.table_name join pk p on p.table_name = a.table_name join pk q on q.table_name = b.table_name where not (p.primary_key = a.column_name and q.primary_key = b.column_name))"
_VARIED = "va as (select table_name as to_table, primary_key, key_type, unnest(list_distinct(list_filter([table_name, case when table_name like '%s' then table_name[:-2] end, case when length(table_name) > 4 then table_name[:4] end], lambda x: x is not null))) as spelling from pk)"
_FOREIGN = f"{_VARIED}, fk as (select distinct c.table_name as from_table, c.column_name as from_column, to_table, primary_key as to_column, 'many_to_one' as relation, round(case when contains(column_name, 'id') then 0.4 else 0 end + case when coalesce(key_type = c.data_type, false) then 0.3 else 0 end + case when contains(column_name, to_table) then 0.3 else 0 end, 2)::double as confidence, 0 as seq from c join va on contains(c.column_name, spelling) and c.table_name <> to_table)"
_FOUND = f", {_KEY_RANK}, {_SHARED}, {_FOREIGN}, found as (select * exclude (seq) from (select * from fk where confidence > 0 union all select * from cc) qualify row_number() over (partition by from_table, to_table, from_column order by confidence desc, seq) = 1 and confidence > 0.3)"


@query(_SQL + f", {_KEY_RANK}, {_SHARED} select from_table, to_table, from_column as column_name, to_column, confidence, relation from cc where from_table < to_table")
def rel_common_columns(t):
    c = _catalog(t)
    return R.common_columns(c, _keys(c))


@query(_SQL + "select column_name, count(distinct table_name) as tables from c group by column_name having count(distinct table_name) > 1")
def shared_names(t):
    return R.shared_names(_catalog(t))


@query(_SQL + f", {_KEY_RANK}, {_FOREIGN} select * exclude (seq) from fk where confidence > 0")
def rel_fk_pattern(t):
    c = _catalog(t)
    return M.foreign_keys(c, _keys(c))


@query("with p as (select 'lineitem' as from_table, case l_linenumber % 2 when 0 then 'part' else 'supplier' end as to_table, l_returnflag as from_column, round(l_discount * 5, 2) as confidence, l_orderkey * 10 + l_linenumber as seq from lineitem) select from_table, to_table, from_column, confidence, seq from p qualify row_number() over (partition by from_table, to_table, from_column order by confidence desc, seq) = 1 and confidence > 0.3")
def dedupe_relationships(t):
    to = F.when(F.col("l_linenumber") % 2 == 0, "part").otherwise("supplier")
    proposed = t.lineitem.select(F.lit("lineitem").alias("from_table"), to.alias("to_table"), F.col("l_returnflag").alias("from_column"), F.round(F.col("l_discount") * 5, 2).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return M.deduplicated(proposed)


@query(_SQL + _FOUND + " select * from found")
def discover_relationships(t):
    c = _catalog(t)
    return M.discovered_relationships(c, _keys(c))


@query(_SQL + _FOUND + " select (select count(distinct table_name) from c) as tables, (select count(*) from found) as relationships, (select count(distinct x) from (select from_table as x from found union all select to_table from found)) as related_tables")
def discovery_metrics(t):
    c = _catalog(t)
    return M.discovery_metrics(c, M.discovered_relationships(c, _keys(c)))


_ENTITY_TEXT = " ".join(f"when contains(lower(entity), '{k}') then '{text}'" for k, text in M.ENTITY_TEXTS.items())
_TOLD = f"case {_ENTITY_TEXT} when entity_type = 'fact' then 'Fact table containing transactional data related to ' || entity else 'Dimension table containing descriptive information about ' || entity end"
_TAG_LIST = "(select array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(tags, ','), lambda x: x <> ''))))), ',') from t where t.table_name = pk.table_name)"


@query(_SQL + _FOUND + f", {_TAG_CTE}, {_NAMES_CTE}, {_TYPES_CTE} select table_name, entity, entity_type, {_TOLD} as description, primary_key, (select count(*) from c x where x.table_name = pk.table_name) as columns, (select max(total) from c x where x.table_name = pk.table_name) as n_rows, (select count(*) from found where from_table = pk.table_name) as relationships, {_TAG_LIST} as tags from pk join e using (table_name) join et using (table_name)")
def discover_job(t):
    """Profile, name, class, description, key, relationships and tags of every table, over a catalog that is written once."""
    return M.discovered_tables(_catalog(t))


_NUMBERS = "nu as (" + " union all ".join(f"select '{x}' as table_name, '{plain(c)}' as column_name, round(min({c})::double, 4) as min_value, round(max({c})::double, 4) as max_value, round(avg({c})::double, 4) as mean_value from {x}" for x, columns in COLUMNS.items() for c, k in columns.items() if k in ("int", "bigint", "double")) + ")"
_CONTEXT = "(select table_name, column_name, case when x = '' then 'Standard data field' else x end as context from (select table_name, column_name, concat_ws('. ', case when null_count * 100.0 / total > 50 then 'High null rate - may indicate optional or incomplete data' when null_count = 0 then 'Complete data - no missing values' end, case when distinct_count = 1 then 'Single value across all records' when distinct_count < 10 then 'Limited set of values - likely categorical' end, case when contains(column_name, 'id') then 'Can be used for joining with related tables' end) as x from c))"


@query(_SQL + ", " + _TAGS_CTE + _DESCRIBED + f", {_FIRST}, {_NUMBERS} select table_name, column_name, data_type, null_count > 0 as nullable, {_UNIQUE} as is_unique, column_name = primary_key as is_key, samples, tags, description, context, min_value, max_value, mean_value from c join pk using (table_name) join t using (table_name, column_name) join ds using (table_name, column_name) join {_CONTEXT} x using (table_name, column_name) join sa using (table_name, column_name) left join nu using (table_name, column_name)")
def discover_columns(t):
    """The same job's columns: definition with samples, tags, description, context, and range and mean of numbers."""
    numbers = reduce(DataFrame.unionByName, [P.profile_numeric(_plain(t, x)).withColumn("table_name", F.lit(x)) for x in TABLES])
    numbers = numbers.select("table_name", "column_name", *(F.round(c, 4).alias(c) for c in ("min_value", "max_value", "mean_value")))
    return M.discovered_columns(_catalog(t), _samples(t), numbers)


@query(_SQL + _FOUND + " select from_table, from_column, to_table, to_column, case relation when 'many_to_one' then 'Each ' || from_table || ' belongs to one ' || to_table || ' (via ' || from_column || ')' when 'one_to_many' then 'Each ' || to_table || ' can have multiple ' || from_table || ' records' else 'Relationship between ' || from_table || ' and ' || to_table end as description from found")
def rel_descriptions(t):
    c = _catalog(t)
    return M.relationship_descriptions(M.discovered_relationships(c, _keys(c)))


@query(_SQL + _FOUND + ", asked as (select a.table_name as a, b.table_name as b from pk a join pk b on a.table_name <= b.table_name) select a, b, exists (select 1 from found where (from_table = a and to_table = b) or (from_table = b and to_table = a)) as exists from asked")
def related_tables(t):
    c = _catalog(t)
    names = c.select("table_name").distinct()
    asked = names.select(F.col("table_name").alias("a")).join(names.select(F.col("table_name").alias("b")), F.expr("a <= b"))
    return M.related(M.discovered_relationships(c, _keys(c)), asked)


@query("select n_nationkey as document_id, 'relationship 0' as place, case when n_nationkey % 3 = 1 then 'invalid type ' || n_name else 'unknown to entity ' || n_name end as violation from nation where n_nationkey % 3 > 0 union all select n_nationkey, 'entities', 'at least one entity is required' from nation where n_nationkey % 5 = 4 union all select n_nationkey, 'relationship 0', 'unknown from entity a' from nation where n_nationkey % 5 = 4 union all select n_nationkey, 'relationship 0', 'unknown to entity b' from nation where n_nationkey % 5 = 4 and n_nationkey % 3 <> 2 union all select n_nationkey, 'entity 0 column 0', 'no data_type' from nation where n_nationkey % 5 = 3 union all select n_nationkey, 'tag x', 'no list' from nation where n_nationkey % 5 = 2")
def schema_doc_violations(t):
    k, name = F.col("n_nationkey"), F.col("n_name")
    kind = F.when(k % 5 == 3, "").otherwise("int")
    column = F.when(kind == "", '{"name": "id"}').otherwise('{"name": "id", "data_type": "int"}')
    entities = F.when(k % 5 == 4, "[]").otherwise(F.concat(F.lit('[{"name": "a", "column_details": ['), column, F.lit(']}, {"name": "b"}]')))
    link = F.concat(F.lit('{"from": "a", "to": "'), F.when(k % 3 == 2, name).otherwise("b"), F.lit('", "foreign_key": "b_id", "references": "id", "type": "'), F.when(k % 3 == 1, name).otherwise("many_to_one"), F.lit('"}'))
    tags = F.when(k % 5 == 2, '"x"').otherwise('["x"]')
    document = F.concat(F.lit('{"entities": '), entities, F.lit(', "relationships": ['), link, F.lit('], "businessTags": {"x": '), tags, F.lit("}}"))
    return M.schema_violations(t.nation.select(k.alias("document_id"), document.alias("document")))


@query("select n_nationkey, n_name as from_entity, 'k' || n_regionkey as from_column, case when n_nationkey % 2 = 0 then 'region' else '' end as to_entity, '' as to_column, case when n_nationkey % 3 = 0 then 'many-to-one' else 'one-to-many' end as relationship_type, '' as description from nation")
def normalize_relationships(t):
    k = F.col("n_nationkey")
    document = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit('{"from_entity": "", "fromEntity": "'), "n_name", F.lit('", "to": "region"'))).otherwise(F.concat(F.lit('{"from": "'), "n_name", F.lit('"'))),
        F.lit(', "foreign_key": "k'), F.col("n_regionkey").cast("string"), F.lit('"'), F.when(k % 3 == 0, ', "type": "many-to-one"}').otherwise("}"),
    )
    return t.nation.select(k, document.alias("document")).select("n_nationkey", *(c.alias(n) for n, c in C.relation_fields(F.col("document")).items()))


@query(_SQL + f"select table_name, column_name, case when column_name = 'props' and table_name = 'events' then 'time' else {_SIMPLE} end as role, case when {_SIMPLE} = 'numeric' then 'number' when data_type = 'string' then 'string' else 'unknown' end as plain_type from c")
def column_roles(t):
    # a text column whose first value is a date is a time: here the events' props, with their day in place of them
    first = t.events.agg(F.min(F.date_format("ts", "yyyy-MM-dd")).alias("value")).select(F.lit("events").alias("table_name"), F.lit("props").alias("column_name"), "value")
    return M.column_roles(_catalog(t), first)


@query(_SQL + ", o as (select * from c where table_name <> 'part'), n as (select table_name, column_name, case when table_name = 'supplier' and column_name = 'nationkey' then 'bigint' else data_type end as data_type from c where table_name <> 'orders') select coalesce(o.table_name, n.table_name) as table_name, case when count(o.table_name) = 0 then 'create' when count(n.table_name) = 0 then 'remove' when count(*) filter (where o.data_type = n.data_type) = count(*) then 'unchanged' else 'update' end as action from o full join n on o.table_name = n.table_name and o.column_name = n.column_name group by 1")
def metadata_diff(t):
    c = _catalog(t)
    changed = F.when(F.expr("table_name = 'supplier' and column_name = 'nationkey'"), "bigint").otherwise(F.col("data_type"))
    return M.metadata_diff(c.where("table_name <> 'part'"), c.where("table_name <> 'orders'").withColumn("data_type", changed))


@query(_SQL + ", o as (select column_name, data_type, null_count > 0 as nullable from c where table_name = 'customer'), n as (select column_name, data_type from c where table_name = 'supplier') select coalesce(o.column_name, n.column_name) as column_name, case when n.column_name is null then case when o.nullable then 'missing_optional' else 'missing_required' end when o.column_name is null then 'extra' when o.data_type <> n.data_type then 'type_mismatch' else 'same' end as change from o full join n on o.column_name = n.column_name")
def schema_compatibility(t):
    c = _catalog(t).withColumn("nullable", F.col("null_count") > 0)
    return R.compatibility(c.where("table_name = 'customer'"), c.where("table_name = 'supplier'"))


_PAIRS = ", p as (select a.table_name as from_table, a.column_name as from_column, b.table_name as to_table, b.column_name as to_column, 0.3 + 0.1 * (a.data_type = b.data_type)::int + 0.2 * contains(a.column_name, 'key')::int as confidence from c a join c b on a.column_name = b.column_name and a.table_name < b.table_name)"


def _proposals(c: DataFrame) -> DataFrame:
    """Equally named columns, and for each a proposal that names no column."""
    a, b = c.alias("a"), c.alias("b")
    score = F.lit(0.3) + 0.1 * F.expr("a.data_type = b.data_type").cast("int") + 0.2 * F.expr("contains(a.column_name, 'key')").cast("int")
    right = a.join(b, F.expr("a.column_name = b.column_name and a.table_name < b.table_name")).select(F.col("a.table_name").alias("from_table"), F.col("a.column_name").alias("from_column"), F.col("b.table_name").alias("to_table"), F.col("b.column_name").alias("to_column"), score.alias("confidence"))
    return right.unionByName(right.withColumn("to_column", F.concat("to_column", F.lit("_old"))))


@query(_SQL + _PAIRS + " select from_table, from_column, to_table, to_column, round(greatest(confidence, 0.4), 2)::double as confidence from p")
def validate_proposals(t):
    c = _catalog(t)
    return M.valid_relationships(_proposals(c), c).withColumn("confidence", F.round("confidence", 2))


@query(_SQL + _PAIRS + " select from_table, from_column, to_table, to_column from p where from_table = 'orders' or to_table = 'orders'")
def relationships_of(t):
    c = _catalog(t)
    return M.relationships_of(M.valid_relationships(_proposals(c), c), "orders").drop("confidence")


# ---- shapes for charts: each is an aggregate of the whole table, then the pairs or arrays of its few rows


@query("select concat_ws(' ', o_orderstatus, o_orderpriority) as name, count(*) as value from orders group by 1")
def pie_pairs(t):
    return t.orders.groupBy(O.category_label(["o_orderstatus", "o_orderpriority"]).alias("name")).agg(F.count("*").alias("value"))


@query("select p_brand, round(avg(p_retailprice), 2) as x, round(max(p_retailprice), 2) as y from part group by p_brand")
def scatter_pairs(t):
    return t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 2).alias("x"), F.round(F.max("p_retailprice"), 2).alias("y"))


@query("with r as (select year(o_orderdate) as y, count(*) as orders, count(distinct o_custkey) as customers from orders group by 1) select 'orders' as series, string_agg(orders::varchar, ',' order by y) as points from r union all select 'customers', string_agg(customers::varchar, ',' order by y) from r")
def chart_series(t):
    by_year = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return O.series(by_year, "y", ["orders", "customers"])


_ROLES = f", r as (select table_name as result, max(total) as n_rows, count(*) as n_columns, count(*) filter (where {_SIMPLE} = 'numeric') as n_numeric, count(*) filter (where {_SIMPLE} = 'categorical') as n_categorical, count(*) filter (where {_SIMPLE} = 'time') as n_time from c group by table_name)"


@query(_SQL + _ROLES + ", w as (select result, n_rows, case when (n_time > 0 or result = 'part') and n_numeric > 0 then 'line' when result = 'customer' then 'pie' when n_categorical = 1 and n_numeric > 0 then 'bar' when n_categorical = 0 and n_numeric > 1 then 'scatter' when n_columns > 5 or n_rows > 100 then 'table' else 'bar' end as chart, cast(case when (n_time > 0 or result = 'part') and n_numeric > 0 then 0.9 when result = 'customer' then 0.85 when n_categorical = 1 and n_numeric > 0 then 0.85 when n_categorical = 0 and n_numeric > 1 then 0.8 when n_columns > 5 or n_rows > 100 then 0.7 else 0.6 end as double) as confidence from r) select result, chart, confidence, case when chart = 'pie' then 8 when chart = 'table' then 16 when chart = 'scatter' then 12 when n_rows <= 5 then 8 when n_rows <= 12 then 12 when n_rows <= 30 then 16 else 24 end as width, case when chart = 'pie' then 6 when chart in ('table', 'scatter') then 8 when n_rows <= 12 then 6 else 8 end as height from w")
def chart_advice(t):
    c = _catalog(t)
    roles = M.column_roles(c).join(c.select("table_name", "column_name", "total"), ["table_name", "column_name"])
    results = roles.groupBy(F.col("table_name").alias("result")).agg(F.max("total").alias("n_rows"), F.count("*").alias("n_columns"), *(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("numeric", "categorical", "time")))
    return H.chart_advice(results.withColumns({"hint": F.when(F.col("result") == "customer", "pie"), "wanted": F.lit(None).cast("string"), "time_dimension": F.when(F.col("result") == "part", "month")}))


@query("select c_custkey, 'Balance, Orders by ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || case when c_nationkey % 2 = 0 then ' - Year ' || c_nationkey else '' end as title from customer")
def chart_titles(t):
    filters = F.create_map(F.when(F.col("c_nationkey") % 2 == 0, "year").otherwise("nation"), F.col("c_nationkey").cast("string"))
    title = H.chart_title(F.array(F.lit("balance"), F.lit("orders")), F.array(F.col("c_mktsegment")), filters, F.lit("bar"))
    return t.customer.select("c_custkey", title.alias("title"))


@query(_SQL + ", a as (select table_name, column_name[2:] as word from c), d as (select a.table_name, word, c.column_name, levenshtein(word, c.column_name) as distance from a join c using (table_name)) select table_name, word, column_name, cast(distance as integer) as distance from d qualify row_number() over (partition by table_name, word order by distance, column_name) = 1")
def nearest_columns(t):
    c = _catalog(t)
    return M.nearest_columns(c.select("table_name", F.expr("substring(column_name, 2)").alias("word")), c)


@query("select event_id as query_id, user_id % 4 <> 0 as read_only, case when event_type in ('click', 'view') then event_type || 's' else '' end as unknown_tables, case when user_id % 4 <> 0 and event_id % 2 = 0 then 'k' || event_id % 10 else '' end as not_selected from events")
def query_log_audit(t):
    # a log of texts that differ by the event's values: deletes, reads of tables that are and aren't there, in one to three parts
    table = F.when(F.col("event_type").isin("click", "view"), F.concat("event_type", F.lit("s"))).when(F.col("event_id") % 3 == 0, "default.Events").otherwise("spark_catalog.default.orders")
    key = F.concat(F.lit("k"), (F.col("event_id") % 10).cast("string"))
    grouped = F.format_string("select 'delete' as x, %s, count(*) as n from %s w group by w.%s order by 1", F.when(F.col("event_id") % 2 == 0, "y").otherwise(key), table, key)
    text = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("DELETE FROM "), table)).otherwise(grouped)
    known = t.spark.createDataFrame([(x,) for x in TABLES], "table_name string")
    return M.audit_queries(t.events.select(F.col("event_id").alias("query_id"), text.alias("sql")), known)


def _archive(t: Tables) -> DataFrame:
    folder = F.concat_ws("_", "user_id", "event_type")
    return t.events.select("event_id", "user_id", "event_type", "ts", folder.alias("folder"), F.concat_ws("/", F.lit("archived_jobs"), folder, F.concat("event_id", F.lit(".csv"))).alias("path"), (F.col("event_id") % 1000).alias("size"))


@query("select count(*) as files, cast(sum(event_id % 1000) as bigint) as bytes, count(distinct user_id) as jobs, count(distinct user_id || '_' || event_type) as runs from events")
def archive_stats(t):
    return O.archive_statistics(_archive(t), "path", "size")


@query("with r as (select user_id, event_type, max(ts) as seen from events group by 1, 2) select user_id::varchar as job, string_agg(event_type, ',' order by seen, event_type) as runs, count(*) as total_runs from r group by user_id")
def archived_jobs(t):
    return O.archived_jobs(_archive(t), "folder", "ts").withColumn("runs", F.array_join("runs", ","))


@query("select user_id, event_type, 'jobs/' || user_id || '/in/' || event_id || '.csv' as path, 'archived_jobs/' || user_id || '_' || event_type || '/in/' || event_id || '.csv' as archive_path from events")
def archive_manifest(t):
    path = F.concat(F.lit("jobs/"), F.col("user_id").cast("string"), F.lit("/in/"), F.col("event_id").cast("string"), F.lit(".csv"))
    return O.archive_manifest(t.events.select("user_id", "event_type", path.alias("path")), "user_id", "event_type", "path")


@query("select user_id::varchar as job, event_type as run, 'archived_jobs/' || user_id || '_' || event_type || '/in/' || event_id || '.csv' as archive_path, 'jobs/' || user_id || '/in/' || event_id || '.csv' as path from events")
def restore_manifest(t):
    """Where each archived file came from, told from the archive's paths, which also hold manifests and folders."""
    archived = archive_manifest(t).select("archive_path")
    more = archived.select(F.regexp_replace("archive_path", "/in/.*$", "/in/x_manifest.json").alias("archive_path")).union(archived.select(F.regexp_replace("archive_path", "/in/.*$", "/in/").alias("archive_path")))
    return O.restore_manifest(archived.union(more), "archive_path")


@query("select user_id as job, event_type as run, count(*) as files, min('archived_jobs/' || user_id || '_' || event_type || '/in/' || event_id || '.csv') as first, max('archived_jobs/' || user_id || '_' || event_type || '/in/' || event_id || '.csv') as last from events group by 1, 2")
def archive_files_of_jobs(t):
    return O.files_of_jobs(archive_manifest(t), "user_id", "event_type")


@query("select user_id as job, event_type as run, count(*) as records, max(ts) as latest from events group by 1, 2 order by latest desc, job, run limit 7")
def order_latest(t):
    """The seven latest runs, newest first."""
    return O.stored_jobs(t.events, "user_id", "event_type", "ts").limit(7)


@query("select user_id as job, event_type as run, count(*) as records, max(ts) as latest from events group by 1, 2")
def stored_jobs(t):
    return O.stored_jobs(t.events, "user_id", "event_type", "ts")


@query(_SQL + _PAIRS + " select 'entities' as kind, count(distinct table_name) as records from c union all select 'columns', count(*) from c union all select 'relationships', count(*) from p union all select 'lineage', count(distinct table_name) from c")
def metadata_snapshot(t):
    c = _catalog(t)
    lineage = c.select(F.col("table_name").alias("entity"), F.concat(F.lit(f"{t.dir}/"), "table_name", F.lit(".parquet")).alias("source")).distinct()
    parts = {"entities": M.entity_names(c), "columns": c, "relationships": M.valid_relationships(_proposals(c), c), "lineage": lineage}
    return M.write_snapshot(parts, scratch(t.spark, "snapshot"), "job_1", "run_1")


@query(_SQL + _PAIRS + ", q as (select p.*, case when a.distinct_count > 0 and b.distinct_count > 0 then a.distinct_count / b.distinct_count end as ratio, a.distinct_count = a.total and a.null_count = 0 as nu, b.distinct_count = b.total and b.null_count = 0 as mu from p join c a on a.table_name = from_table and a.column_name = from_column join c b on b.table_name = to_table and b.column_name = to_column) select from_table, from_column, to_table, to_column, case when ratio > 2 then 'many_to_one' when ratio < 0.5 then 'one_to_many' when nu and not mu then 'one_to_many' when mu and not nu then 'many_to_one' else 'many_to_many' end as relation from q")
def rel_types(t):
    c = _catalog(t)
    return M.relation_types(M.valid_relationships(_proposals(c), c), c)


@query(_SQL + f", {_NAMES_CTE}, {_TYPES_CTE} select table_name, {_TOLD} as description from e join et using (table_name)")
def entity_descriptions(t):
    return M.entity_descriptions(_catalog(t))


@query("select 'all_parts' as query_name, 'success' as status, least(count(*), 1000) as n_rows, count(*) > 1000 as truncated, true as timed, false as has_error from part union all select 'by_brand', 'success', count(distinct p_brand), false, true, false from part union all select 'literal', 'success', least(count(*), 1000), count(*) > 1000, true, false from part union all select 'broken', 'error', 0, false, true, true union all select 'unsafe', 'error', 0, false, true, true")
def refresh_saved_queries(t):
    saved = {"all_parts": "select * from {part}", "broken": "select no_such_column from {part}", "unsafe": "drop table part", "by_brand": "select p_brand, count(*) as n from {part} group by p_brand", "literal": "select 'delete me; update' as note, p_partkey from {part}"}
    log = I.refresh_saved(t.spark, saved, {"part": t.part})
    return log.select("query_name", "status", "n_rows", "truncated", (F.col("seconds") >= 0).alias("timed"), F.col("error").isNotNull().alias("has_error"))

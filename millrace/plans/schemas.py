"""The columns of the tables that the queries read, as Spark names their types, for the SQL that the catalog queries are held against."""

from __future__ import annotations

COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
}


def plain(column: str) -> str:
    """A column's name without the table's one-letter prefix."""
    return column[2:] if column[1:2] == "_" else column


def catalog_sql() -> str:
    """The column catalog in SQL."""
    return " union all ".join(
        f"select '{t}' as table_name, '{plain(c)}' as column_name, {i} as ordinal, '{kind}' as data_type, count(*) as total, count(*) - count({c}) as null_count, count(distinct {c}) as distinct_count from {t}"
        for t, columns in COLUMNS.items()
        for i, (c, kind) in enumerate(columns.items())
    )

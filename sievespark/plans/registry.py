"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named subqueries of the SQL side; each may use the ones above it.
VIEWS = {
    "obs": """
        select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                           l_shipdate, l_quantity, l_extendedprice) - 1 as id,
               l_partkey as entity, p_name as b1, p_brand as b2, p_type as b3, l_returnflag as grp,
               case when l_quantity >= 45 and l_discount >= 0.095 then 1 else 0 end as label
        from lineitem join part on l_partkey = p_partkey""",
    "dict": """
        select row_number() over (order by value) - 1 as idx, value
        from (select b1 as value from obs union select b2 from obs union select b3 from obs)""",
    "ent": """
        select o.entity as entity_id, min(d1.idx) as b1_idx, min(d2.idx) as b2_idx, min(d3.idx) as b3_idx,
               max(case when grp = 'A' then label else 0 end) = 1 as label_a,
               max(case when grp = 'N' then label else 0 end) = 1 as label_n,
               max(case when grp = 'R' then label else 0 end) = 1 as label_r
        from obs o join dict d1 on b1 = d1.value join dict d2 on b2 = d2.value join dict d3 on b3 = d3.value
        group by o.entity""",
    "held": """
        select idx from dict order by md5(idx::varchar || '|253')
        limit (select ceil(0.1 * count(*))::bigint from dict)""",
    "tagged": """
        select *, case when b1_idx in (from held) or b2_idx in (from held) or b3_idx in (from held)
                       then 'val' else 'train' end as split
        from ent""",
    "scored": """
        select doc_id as id, lang as grp, toxic as split_group, quality as label,
               (n_chars % 50) / 50.0::double as score
        from documents join labels using (doc_id)""",
}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the subqueries its SQL uses."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            needed = views.split()
            heads = ", ".join(f"{v} as ({VIEWS[v]})" for v in VIEWS if v in needed)
            ORACLES[name] = f"with {heads} {sql}" if heads else sql
        return fn

    return register

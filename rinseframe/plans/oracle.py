"""Standard SQL with the same result as each query, over the same tables."""

from __future__ import annotations

GAPS = """gaps as (
  select o_orderkey, o_orderstatus,
         case when o_orderstatus <> 'P' then o_totalprice end as o_totalprice,
         case when o_orderstatus <> 'P' then o_custkey end as o_custkey,
         case when o_orderpriority <> '4-NOT SPECIFIED' then o_orderpriority end as o_orderpriority,
         o_orderdate
  from orders)"""


def columns(alias: str, table: str, names: str) -> str:
    return ", ".join(f'{alias}.{n} as "{table}.{n}"' for n in names.split())


ORDERS = "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"
GAP_ORDERS = "o_orderkey o_orderstatus o_totalprice o_custkey o_orderpriority o_orderdate"
CUSTOMER = "c_custkey c_name c_nationkey c_acctbal c_mktsegment"
NATION = "n_nationkey n_name n_regionkey"
REGION = "r_regionkey r_name"
SUPPLIER = "s_suppkey s_name s_nationkey s_acctbal"
PART = "p_partkey p_name p_brand p_type p_size p_retailprice"
LINEITEM = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
)


def equal_width(values: str, bins: int) -> str:
    """CTE text: edges (i, e) of equal-width bins over ``values`` (column x)."""
    return f"""bounds as (select min(x) as lo, max(x) as hi from {values}),
  edges as (
    select i, case when i = 0 then lo - (hi - lo) * 0.001 when i = {bins} then hi
                   else i * ((hi - lo) / {bins}) + lo end as e
    from bounds, range(0, {bins} + 1) as r(i))"""


# label text rounds halves to the even neighbour
LABEL = "'(' || round_even(a.e, 3) || ', ' || round_even(b.e, 3) || ']'"
LOWEST_LABEL = """'(' || (case when a.i = 0 then round_even(a.e, 3) - 0.001 else round_even(a.e, 3) end) || ', '
                 || round_even(b.e, 3) || ']'"""


def similar(table: str, column: str, position: str, k: int) -> str:
    """CTE text: values (v, n, f) and pairs (a, b, na, nb, d), earlier first."""
    return f"""vals as (select {column} as v, count(*) as n, min({position}) as f from {table} group by 1),
  pairs as (
    select a.v as a, b.v as b, a.n as na, b.n as nb, levenshtein(a.v, b.v)::int as d
    from vals a, vals b
    where (a.f < b.f or (a.f = b.f and a.v < b.v)) and levenshtein(a.v, b.v) <= {k})"""


def ranked(table: str, column: str, position: str, k: int) -> str:
    return similar(table, column, position, k) + """,
  directed as (
    select a as value, b as candidate, na as n, d * nb as w from pairs
    union all select b, a, nb, d * nb from pairs),
  strings as (
    select value as v, n * (count(*) + 1) as weight, sum(w) as dist_sum from directed group by value, n),
  links as (
    select value, candidate from directed union all select v, v from strings),
  candidates as (
    select value, candidate,
           row_number() over (partition by value order by weight desc, dist_sum, candidate desc)::int as rank
    from links join strings on candidate = v)"""


NAME_CASE = {
    "red bolt": "blue bolt",
    "blue bolt": "small bolt",
    "small ring": "red ring",
    "red ring": "small ring",
    "red widget": "widget",
}
CHAIN_CASE = {"red bolt": "small bolt", "blue bolt": "small bolt", "red widget": "widget"}


def renamed(mapping: dict[str, str]) -> str:
    whens = " ".join(f"when '{old}' then '{new}'" for old, new in mapping.items())
    return f"""select p_partkey, case p_name {whens} else p_name end as p_name,
      p_brand, p_type, p_size, p_retailprice from part"""


def normalized(column: str) -> str:
    return (
        f"({column} - min({column}) over ()) / nullif(max({column}) over () - min({column}) over (), 0) as {column}"
    )


LINE_NUMBERS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()
WITHIN = " and ".join(
    f"abs({c} - (select avg({c}) from lineitem)) <= 1.6 * (select stddev_samp({c}) from lineitem)" for c in LINE_NUMBERS
)
LOG = "log as (select conv_id as data_id, turn as version, text as description from conversations)"
SORTED_GAPS = "order by o_orderpriority desc nulls first, o_totalprice nulls last, o_orderkey"

SALES = f"""sales as (
    select {columns("o", "orders", ORDERS)}, {columns("c", "customer", CUSTOMER)}
    from orders o full join customer c on o.o_custkey = c.c_custkey),
  kept as (
    select * from sales
    where abs("orders.o_totalprice" - (select avg("orders.o_totalprice") from sales))
          <= 1.5 * (select stddev_samp("orders.o_totalprice") from sales)),
  scaled as (
    select * replace (
      ("orders.o_totalprice" - min("orders.o_totalprice") over ())
      / nullif(max("orders.o_totalprice") over () - min("orders.o_totalprice") over (), 0) as "orders.o_totalprice")
    from kept)"""

ORACLE: dict[str, str] = {
    # ---- sources and sinks
    "scan": "select * from orders",
    "scan_renamed": "select s_suppkey as id, s_name, s_nationkey, s_acctbal as balance from supplier",
    "scan_csv": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer",
    "scan_csv_empty": f"with {GAPS} select * replace (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate) from gaps",
    "scan_csv_texts": "select * from documents",
    "csv_round_trip": """select * replace ('  ' || text || ' ' || chr(9) as text, chr(10) || ' ' || lang as lang,
      source || ' ' || chr(10) as source) from documents""",
    "write_csv": "select concat_ws('|', "
    + ", ".join(c if c != "l_shipdate" else f"strftime({c}, '%Y-%m-%d %H:%M:%S')" for c in LINEITEM.split())
    + ") as line from lineitem",
    "scan_zip": "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part",
    "scan_zip_members": "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part",
    "join_hot_key": """with l as (select case when l_linenumber = 1 then 0 else l_orderkey end as k, l_quantity from lineitem),
      o as (select case when o_orderkey <= 40 then 0 when o_orderpriority < '3' then -1 else o_orderkey end as k, o_orderkey from orders)
      select l.k as l_k, o.k as o_k, o_orderkey as o_o_orderkey, count(*) as n, sum(l_quantity) as quantity
      from l full join o on l.k = o.k group by all""",
    "one_hot_sparse": """with c as (select distinct 0 as k, p_brand as v from part union all select distinct 1, p_name from part),
      d as (select k, v, row_number() over (order by k, v) - 1 as i from c where v is not null)
      select p_partkey, (select count(*) from d)::int as size, concat_ws(',', b.i, n.i) as indices
      from part left join d b on b.k = 0 and b.v = p_brand left join d n on n.k = 1 and n.v = p_name""",
    "snapshots_left": """select 'o_orderkey' as first_column, count(*) as n from orders where not o_totalprice < 100000
      union all select 'c_custkey', count(*) from customer""",
    "csv_count": "select count(*) as n from customer",
    "csv_stray_quotes": """select p_partkey, p_size || '"' as inches, p_name || ' of "5"' as name,
      p_brand || ', 7"' || chr(10) || p_type as place from part""",
    "scan_sql_dump": "select page_id, url, html from pages",
    "scan_sql_dump_comments": """select 'supplier' as kind, s_suppkey as id, s_name || '; it''s -- /* #' as name, s_acctbal as balance
      from supplier union all select 'part', p_partkey, p_name, null from part""",
    "load_path_sql": "select p_partkey, p_name from part",
    "load_path": "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part",
    "ctas": "select l_orderkey, l_linenumber, l_quantity from lineitem",
    "copy_table": "select * from part",
    "replace_table": "select * from customer",
    # ---- projections
    "select_column": "select l_shipdate from lineitem",
    "drop_column": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
    # ---- row deletion
    "delete_eq": f"with {GAPS} select * from gaps where not coalesce(o_orderpriority = '5-LOW', false)",
    "delete_lt_or": f"""with {GAPS} select * from gaps
      where not coalesce(o_totalprice < 100000 or o_totalprice > 400000.5, false)""",
    "delete_contains_and_not": f"""with {GAPS} select * from gaps
      where not coalesce(contains(o_orderpriority, 'IUM') and not o_totalprice > 250000, false)""",
    "delete_columns_compared": """select * from lineitem
      where not coalesce(l_discount > l_tax or l_returnflag = l_linestatus, false)""",
    # ---- find and replace, filling
    "find_replace": """select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
      case when o_orderpriority = '5-LOW' then 'LOW' else o_orderpriority end as o_orderpriority from orders""",
    "find_replace_number": """select * replace (
      (case l_quantity when 1 then 2 when 2 then 1 when 50 then 0 else l_quantity end)::double as l_quantity)
      from lineitem""",
    "find_replace_regex": r"""select c_custkey, regexp_replace(c_name, 'Customer#0*([0-9]+)', 'C<\1>', 'g') as c_name,
      c_nationkey, c_acctbal, c_mktsegment from customer""",
    "find_replace_regex_texts": """select * replace (regexp_replace(text, '[0-9]+([.,][0-9]+)?', '#', 'g') as text)
      from documents""",
    "find_replace_regex_named": r"""select * replace (
      regexp_replace(c_name, '([A-Z][a-z]+)#0{0,9}([0-9]*)', '\2 \1', 'g') as c_name) from customer""",
    "find_replace_fraction": """select * replace (
      (case p_size when 1 then 1.5 when 2 then 2.25 when 50 then 0 else p_size end)::double as p_size) from part""",
    "fill_value_fraction": f"with {GAPS} select * replace (coalesce(o_custkey::double, 0.5::double) as o_custkey) from gaps",
    "find_replace_all": """select * replace (
      case l_returnflag when 'F' then 'final' when 'O' then 'open' else l_returnflag end as l_returnflag,
      case l_linestatus when 'F' then 'final' when 'O' then 'open' else l_linestatus end as l_linestatus)
      from lineitem""",
    "fill_mean": f"""with {GAPS} select * replace (
      round(coalesce(o_totalprice, (select avg(o_totalprice) from gaps)), 4) as o_totalprice) from gaps""",
    "fill_median": f"""with {GAPS} select * replace (
      coalesce(o_totalprice, (select median(o_totalprice) from gaps)) as o_totalprice) from gaps""",
    "fill_value": f"""with {GAPS} select * replace (
      coalesce(o_totalprice, 0) as o_totalprice, coalesce(o_orderpriority, 'none') as o_orderpriority) from gaps""",
    "fill_value_text": f"""with {GAPS} select * replace (
      coalesce(o_custkey::varchar, 'unknown') as o_custkey) from gaps""",
    "fill_all_mean": f"""with {GAPS} select o_orderkey::double as o_orderkey, o_orderstatus,
      round(coalesce(o_totalprice, (select avg(o_totalprice) from gaps)), 4) as o_totalprice,
      round(coalesce(o_custkey::double, (select avg(o_custkey) from gaps)), 4) as o_custkey, o_orderpriority,
      o_orderdate from gaps""",
    "fill_all_median": f"""with {GAPS} select o_orderkey::double as o_orderkey, o_orderstatus,
      coalesce(o_totalprice, (select median(o_totalprice) from gaps)) as o_totalprice,
      coalesce(o_custkey::double, (select median(o_custkey) from gaps)) as o_custkey, o_orderpriority,
      o_orderdate from gaps""",
    # ---- scaling, outliers
    "normalize": f"select * replace ({normalized('l_extendedprice')}) from lineitem",
    "normalize_all": f"""select {normalized('p_partkey')}, p_name, p_brand, p_type,
      {normalized('p_size')}, {normalized('p_retailprice')} from part""",
    "remove_outliers": """select * from orders
      where abs(o_totalprice - (select avg(o_totalprice) from orders))
            <= 1.5 * (select stddev_samp(o_totalprice) from orders)""",
    "remove_outliers_with_gaps": f"""with {GAPS} select * from gaps
      where abs(o_totalprice - (select avg(o_totalprice) from gaps))
            <= 1.2 * (select stddev_samp(o_totalprice) from gaps)""",
    "remove_all_outliers": f"select * from lineitem where {WITHIN}",
    # ---- bins, one-hot
    "bin_equiwidth": f"""with v as (select o_totalprice as x from orders), {equal_width("v", 4)}
      select o_orderkey, o_custkey, o_orderstatus, {LABEL} as o_totalprice, o_orderdate, o_orderpriority,
             b.i::int as bin
      from orders join edges a on o_totalprice > a.e join edges b on b.i = a.i + 1 and o_totalprice <= b.e""",
    "bin_equifreq": f"""with found as (select quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from orders),
      edges as (select i, q[i + 1] as e from found, range(0, 6) as r(i))
      select o_orderkey, o_custkey, o_orderstatus,
             {LOWEST_LABEL} as o_totalprice,
             o_orderdate, o_orderpriority, b.i::int as bin
      from orders join edges a on o_totalprice > a.e or (a.i = 0 and o_totalprice = a.e)
                  join edges b on b.i = a.i + 1 and o_totalprice <= b.e""",
    "bin_ranges": f"""with ranges as (
        select min(l_quantity) - (max(l_quantity) - min(l_quantity)) / 1000 as e from lineitem
        union all select 10.0::double union all select 25.5 union all select 40
        union all select max(l_quantity) from lineitem),
      edges as (select row_number() over (order by e) - 1 as i, e from ranges)
      select lineitem.* replace ({LABEL} as l_quantity), b.i::int as bin
      from lineitem join edges a on l_quantity > a.e join edges b on b.i = a.i + 1 and l_quantity <= b.e""",
    "one_hot_prefixed": """select o_orderkey, o_custkey, (o_orderstatus = 'F')::int as "o_orderstatus_F",
      (o_orderstatus = 'O')::int as "o_orderstatus_O", (o_orderstatus = 'P')::int as "o_orderstatus_P",
      o_totalprice, o_orderdate, o_orderpriority from orders""",
    "one_hot_plain": f"""with {GAPS} select o_orderkey, o_orderstatus, o_totalprice, o_custkey,
      coalesce(o_orderpriority = '1-URGENT', false)::int as "1-URGENT",
      coalesce(o_orderpriority = '2-HIGH', false)::int as "2-HIGH",
      coalesce(o_orderpriority = '3-MEDIUM', false)::int as "3-MEDIUM",
      coalesce(o_orderpriority = '5-LOW', false)::int as "5-LOW", o_orderdate from gaps""",
    # ---- types, dates
    "to_string": "select * replace (l_extendedprice::varchar as l_extendedprice) from lineitem",
    "to_int": "select * replace (round_even(l_extendedprice, 0)::bigint as l_extendedprice) from lineitem",
    "to_float": f"with {GAPS} select * from gaps",
    "to_datetime": "select * replace (date_trunc('second', ts)::timestamp as ts) from events",
    "to_datetime_from_number": "select * from events",
    "extract_year": "select * replace (year(ts)::int as ts) from events",
    "extract_month": "select * replace (month(ts)::int as ts) from events",
    "extract_week": "select * replace (week(ts)::int as ts) from events",
    "extract_day": "select * replace (day(ts)::int as ts) from events",
    "extract_weekday": "select * replace (dayname(ts) as ts) from events",
    # ---- aggregates
    "column_stats": " union all ".join(
        f"""select '{c}' as "column", count({c}) as "count", min({c})::double as min, max({c})::double as max,
        round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std from lineitem"""
        for c in LINE_NUMBERS
    ),
    "quantiles": " union all ".join(
        f"""select '{c}' as "column", {p}::double as p, round(quantile_cont({c}::double, {p}), 4) as value from lineitem"""
        for c in ["l_extendedprice", "l_quantity", "l_partkey"]
        for p in [0.0, 0.1, 0.5, 0.75, 1.0]
    ),
    "row_count": "select count(*) as n from lineitem",
    "categories": f"with {GAPS} select distinct o_orderpriority from gaps where o_orderpriority is not null",
    "value_counts": "select p_name, count(*) as n from part group by p_name",
    "profile_histogram": "with "
    + ", ".join(
        f"""v_{c} as (select {c}::double as x from orders),
        h_{c} as (
          with {equal_width(f"v_{c}", 15)}
          select b.i as bin, count(x) as n
          from edges a join edges b on b.i = a.i + 1 left join v_{c} on x > a.e and x <= b.e group by b.i)"""
        for c in ["o_orderkey", "o_custkey", "o_totalprice"]
    )
    + " "
    + " union all ".join(
        [
            f"""select '{c}' as "column", row_number() over (order by n desc, bin)::int as position, n from h_{c}"""
            for c in ["o_orderkey", "o_custkey", "o_totalprice"]
        ]
        + [
            f"""select '{c}' as "column", i::int as position, 1::bigint as n from range(1, 16) as r(i)"""
            for c in ["o_orderstatus", "o_orderdate", "o_orderpriority"]
        ]
    ),
    # ---- joins
    "join_full": f"""select {columns("c", "customer", CUSTOMER)}, {columns("o", "orders", ORDERS)}
      from customer c full join orders o on c.c_custkey = o.o_custkey""",
    "join_full_gaps": f"""with {GAPS} select {columns("o", "o", GAP_ORDERS)}, {columns("c", "c", CUSTOMER)}
      from gaps o full join customer c on c.c_custkey = o.o_custkey""",
    "join_full_multikey": f"""select {columns("o", "o", ORDERS)}, {columns("l", "l", LINEITEM)}
      from orders o full join lineitem l on o.o_orderkey = l.l_orderkey and o.o_orderstatus = l.l_linestatus""",
    "join_chain": f"""select {columns("r", "region", REGION)}, {columns("n", "nation", NATION)},
        {columns("c", "customer", CUSTOMER)}
      from region r full join nation n on r.r_regionkey = n.n_regionkey
                    full join customer c on n.n_nationkey = c.c_nationkey""",
    "join_chain_same_key": f"""select {columns("p", "p", PART)}, {columns("s", "s", SUPPLIER)},
        {columns("c", "c", CUSTOMER)}
      from part p full join supplier s on p.p_partkey = s.s_suppkey
                  full join customer c on s.s_suppkey = c.c_custkey""",
    "join_chain_partial": f"""select {columns("r", "region", REGION)}, {columns("n", "nation", NATION)},
        {columns("s", "supplier", SUPPLIER)}
      from region r full join nation n on r.r_regionkey = n.n_regionkey full join supplier s on 1 = 1""",
    "join_unconditional": f"""select {columns("s", "supplier", SUPPLIER)}, {columns("r", "region", REGION)}
      from supplier s full join region r on 1 = 1""",
    "join_named": f"""select {columns("s", "supplier", SUPPLIER)}, {columns("n", "nation", NATION)}
      from supplier s full join nation n on s.s_nationkey = n.n_nationkey""",
    "semi_join_exists": """select * from customer
      where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""",
    "semi_join_in": """select lineitem.*, orders.* from lineitem join orders on l_orderkey = o_orderkey
      where o_orderkey in (select user_id from events)""",
    # ---- near-duplicates
    "similar_pairs": f"with {similar('part', 'p_name', 'p_partkey', 3)} select a, b, d as distance from pairs",
    "similar_pairs_names": f"with {similar('customer', 'c_name', 'c_custkey', 1)} select a, b, d as distance from pairs",
    "similar_pairs_urls": f"with {similar('pages', 'url', 'page_id', 2)} select a, b, d as distance from pairs",
    "dedupe_candidates": f"with {ranked('part', 'p_name', 'p_partkey', 3)} select value, candidate, rank from candidates",
    "dedupe_candidates_names": f"""with {ranked('customer', 'c_name', 'c_name', 1)}
      select value, candidate, rank from candidates""",
    "dedupe_lists": f"""with {ranked('part', 'p_name', 'p_partkey', 3)}
      select value, string_agg(candidate, '|' order by rank) as candidates from candidates group by value""",
    "replace_map": renamed(NAME_CASE),
    "replace_map_chain": renamed(CHAIN_CASE),
    "replace_map_table": f"""with {ranked('part', 'p_name', 'p_partkey', 3)}
      select p_partkey, coalesce(candidate, p_name) as p_name, p_brand, p_type, p_size, p_retailprice
      from part left join candidates on p_name = value and rank = 1""",
    "replace_map_table_chain": """with recursive links as (
        select c.c_name as old, p.c_name as new from customer c join customer p on p.c_custkey = c.c_custkey // 2
        where c.c_name <> p.c_name),
      steps as (
        select old, new from links
        union all select s.old, l.new from steps s join links l on s.new = l.old),
      ends as (select old, new from steps where new not in (select old from links))
      select c_custkey, coalesce(new, c_name) as c_name, c_nationkey, c_acctbal, c_mktsegment
      from customer left join ends on c_name = old""",
    # ---- order and pages
    "order_multi": f"with {GAPS} select * from gaps {SORTED_GAPS}",
    "page": f"with {GAPS} select * from gaps {SORTED_GAPS} limit 10 offset 20",
    "page_last": f"""select * from lineitem
      order by l_extendedprice, {", ".join(LINEITEM.split())}
      limit 10 offset (select count(*) - 5 from lineitem)""",
    # ---- versions
    "latest_version": f"with {LOG} select data_id, max(version) as version from log group by data_id",
    "next_version": f"""with {LOG} select doc_id as data_id, coalesce(max(version) + 1, 1) as version
      from documents left join log on doc_id = data_id group by doc_id""",
    "history": f"""with {LOG}, numbered as (
        select data_id, row_number() over (partition by data_id order by version desc)::int as position,
               version, description from log)
      select * from numbered where position <= 5""",
    "undo": f"""with {LOG} select data_id, version, description from log
      qualify version < max(version) over (partition by data_id) or count(*) over (partition by data_id) = 1""",
    "versions_ordered": f"with {LOG} select * from log order by data_id, version",
    "drop_snapshot": f"""with {LOG} select data_id, version, description from log
      qualify version < max(version) over (partition by data_id)""",
    "cleaning_pipeline": f"""with {SALES},
      found as (select quantile_cont("customer.c_acctbal", [0, 0.25, 0.5, 0.75, 1.0]) as q from scaled),
      edges as (select i, q[i + 1] as e from found, range(0, 5) as r(i))
      select "orders.o_orderkey", "orders.o_custkey",
             ("orders.o_orderstatus" = 'F')::int as "orders.o_orderstatus_F",
             ("orders.o_orderstatus" = 'O')::int as "orders.o_orderstatus_O",
             ("orders.o_orderstatus" = 'P')::int as "orders.o_orderstatus_P",
             "orders.o_totalprice", dayname("orders.o_orderdate") as "orders.o_orderdate", "orders.o_orderpriority",
             "customer.c_custkey", "customer.c_name", "customer.c_nationkey",
             {LOWEST_LABEL} as "customer.c_acctbal",
             "customer.c_mktsegment"
      from scaled join edges a on "customer.c_acctbal" > a.e or (a.i = 0 and "customer.c_acctbal" = a.e)
                  join edges b on b.i = a.i + 1 and "customer.c_acctbal" <= b.e""",
    "pipeline_undone": f"with {SALES} select * from scaled",
    "pipeline_saved": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders",
    "session_undone": "select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority from orders",
    "page_envelope": f"""with {GAPS} select 7 as draw, (select count(*) from gaps) as records_total,
      (select count(*) from gaps) as records_filtered, * from gaps {SORTED_GAPS} limit 15 offset 20""",
    "stream_events": """select * replace (case event_type when 'click' then 'CLICK' else event_type end as event_type,
      dayname(ts) as ts) from events where not user_id < 10""",
}

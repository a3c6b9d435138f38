"""DuckDB SQL for every query, on the same tables."""

from __future__ import annotations

from keyloom.queries import SOURCE, TARGET

ORD = "select distinct s, t from (select o_custkey s, lead(o_custkey) over (order by o_orderkey) t from orders) where t is not null and s <> t"
ORDPART = "select distinct l_orderkey s, l_partkey t from lineitem where l_orderkey <> l_partkey"
EVT = "select distinct s, t from (select user_id s, lead(user_id) over (order by event_id) t from events) where t is not null and s <> t"
HASHED = "select l_suppkey k, (l_orderkey * 1000003) % 4294967296 v from lineitem"


def tree(graph: str, mark: bool = False) -> str:
    """Common table expressions down to b(v, d, p): vertex, depth, parent."""
    stop = f" where v <> {SOURCE}" if mark else ""
    return f"""with recursive e as ({graph}),
f(v, d) as (select distinct t, 1 from e where s = {SOURCE} union select e.t, f.d + 1 from f join e on e.s = f.v where f.d < 15),
lv as (select v, min(d) d from f{stop} group by v),
fr as (select {SOURCE} v, 0 d union all select v, d from lv),
b as (select lv.v, lv.d, min(fr.v) p from lv join e on e.t = lv.v join fr on fr.v = e.s and fr.d = lv.d - 1 group by 1, 2)"""


def path(graph: str, mark: bool) -> str:
    return f"""{tree(graph, mark)},
w(v, d, p) as (select v, d, p from b where v = {TARGET} union all select b.v, b.d, b.p from w join b on b.v = w.p and b.d = w.d - 1)
select d::int as hop, v as vertex from w union all select 0, {SOURCE}::bigint where exists (select 1 from w)"""


def rank(graph: str) -> str:
    return f"""with e as ({graph}), n as (select max(s) + 1 v from e), dg as (select s, count(*) f from e group by 1),
m as (select t, sum((1.0::double / (select v from n)) / f) x from e join dg using (s) group by 1),
v as (select unnest(range(0, (select v from n))) id),
j as (select id, 1.0::double / n.v old, x, 0.15::double / n.v + 0.85::double * x fin from v cross join n left join m on t = id)"""


def ranks(graph: str, steps: int, gated: bool) -> str:
    """State s<i> after each step: value, and (gated) whether it stored."""
    sql = f"with e as materialized ({graph}), n as materialized (select max(s) + 1 v from e), dg as materialized (select s, count(*) f from e group by 1), "
    sql += "s0 as materialized (select unnest(range(0, (select v from n))) id, 1.0::double / (select v from n) val, true act)"
    for i in range(steps):
        fin = "0.15::double / (select v from n) + 0.85::double * x"
        stores = f"x is not null and act and abs(val - ({fin})) >= 1e-4" if gated else "x is not null"
        sql += f""", m{i} as (select t, sum(val / f) x from e join dg using (s) join s{i} on id = s group by 1),
s{i + 1} as materialized (select id, case when {stores} then {fin} else val end val, coalesce({stores}, false) act from s{i} left join m{i} on t = id)"""
    return sql + f" select id, round(val, 9) as rank{', act as active' if gated else ''} from s{steps}"


LCG = "(x * 1103515245 + 12345) % 2147483648"
RMAT = f"""with recursive g(id, i, x, s, t) as (
select i, 0, (i * 2654435 + 1) % 2147483648, 0::bigint, 0::bigint from range(256) r(i)
union all
select id, i + 1, y, s * 2 + (q >= 777)::bigint, t * 2 + ((q >= 583 and q < 777) or q >= 971)::bigint
from (select *, (y >> 16) % 1024 q from (select *, {LCG} y from g where i < 8))),
r as (select id, s as src, t as dst from g where i = 8)"""

KMERS = """with w as (select substr(text, i::bigint, 4) kmer, substr(text, (i + 4)::bigint, 1) nxt
from (select text, unnest(range(1, length(text) - 3)) i from documents))"""

ORACLES: dict[str, str] = {
    "histogram_masked": "select l_partkey & 1048575 as key, count(*) as value from lineitem group by 1",
    "histogram_count": "select l_partkey as key, count(l_orderkey) as value from lineitem group by 1",
    "histogram_clamped": "select l_suppkey as key, least(count(*), 500)::bigint as value from lineitem group by 1",
    "reduce_sum": "select o_custkey as key, sum(o_orderkey)::bigint as value from orders group by 1",
    "reduce_min": "select l_suppkey as key, min(l_orderkey) as value from lineitem group by 1",
    "reduce_max": "select l_suppkey as key, max(l_orderkey) as value from lineitem group by 1",
    "reduce_first_min": "select o_custkey as key, min(o_orderdate) as value from orders group by 1",
    "reduce_float_sum": "select l_suppkey as key, round(sum(l_quantity), 4) as value from lineitem group by 1",
    "reduce_sum_u32_wrap": f"select k as key, (sum(v) % 4294967296)::bigint as value from ({HASHED}) group by 1",
    "reduce_sum_u64_wrap": f"select k as key, (sum(v::hugeint * 4294967291) % 18446744073709551616)::varchar as value from ({HASHED}) group by 1",
    "reduce_packed16": f"select k as key, ((sum((v >> 16) & 65535) % 65536) * 65536 + sum(v & 65535) % 65536)::bigint as value from ({HASHED}) group by 1",
    "reduce_custom_max": "select o_custkey as key, max(o_orderkey) as value from orders group by 1",
    "reduce_count4_vector": "select l_suppkey as key, " + ", ".join(f"count(*) filter (where l_linenumber % 4 = {i}) as n_{c}" for i, c in enumerate("acgt")) + " from lineitem group by 1",
    "reduce_wide_key": "select printf('%016x%016x', l_suppkey, l_partkey) as key, count(*) as value from lineitem group by 1",
    "multi_endpoint_union": "select k as key, count(*) as value from (select l_orderkey k from lineitem union all select o_orderkey from orders) group by 1",
    "golden_compare": """with r as (select l_orderkey k, count(*) v from lineitem group by 1), g as (select o_orderkey k, o_orderkey % 7 v from orders)
select count(*) filter (where r.k = g.k and r.v = g.v) as correct, count(*) filter (where r.k = g.k and r.v <> g.v) as mismatch,
count(*) filter (where g.k is null) as nonexist, count(*) filter (where r.k is null) as left_over from r full join g on r.k = g.k""",
    "reduce_summary": "select count(*) as n_keys, sum(c)::bigint as total, max(k) as max_key from (select l_partkey k, count(*) c from lineitem group by 1)",
    "distinct_keys": "select count(distinct l_partkey) as different_items from lineitem",
    "edges_sort": "select l_orderkey as src, l_partkey as dst from lineitem",
    "edges_merge_sorted": f"select l_orderkey as src, l_partkey as dst from lineitem union all select s, t from ({EVT})",
    "edges_dedup": "select distinct l_orderkey as src, l_partkey as dst from lineitem",
    "edges_no_self_loops": "select l_orderkey as src, l_partkey as dst from lineitem where l_orderkey <> l_partkey",
    "edges_to_text": f"select printf('%10d\t%10d', s, t) as line from ({EVT})",
    "edge_stats": f"select max(greatest(s, t)) as max_node, count(*) as n_edges from ({ORDPART})",
    "monotone_src_filter": "select o_orderkey, o_custkey as src from (select *, max(o_custkey) over (order by o_orderkey rows between unbounded preceding and 1 preceding) m from orders) where m is null or o_custkey >= m",
    "monotone_dst_filter": "select o_custkey, o_orderkey, x::int as dst from (select *, max(x) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) m from (select *, date_diff('day', date '1990-01-01', o_orderdate::date) x from orders)) where m is null or x >= m",
    "check_sorted": "select o_orderkey as pos, p as last, o_custkey as key, o_orderkey * 12 as \"offset\" from (select *, lag(o_custkey) over (order by o_orderkey) p from orders) where o_custkey < p",
    "check_strictly_sorted": "select event_id as pos, p as last, user_id as key from (select *, lag(user_id, 1, 0) over (order by event_id) p from events) where user_id <= p",
    "sorted_warning": "select o_orderkey as pos, o_custkey as src, o_orderkey as dst from (select *, lag(o_custkey) over (order by o_orderkey) p from orders) where o_custkey < p order by o_orderkey limit 1",
    "graph_vertex_count": f"select max(s) + 1 as vertices from ({ORDPART})",
    "out_degree": f"select s as src, count(*) as fanout from ({ORDPART}) group by 1",
    "isolated_nodes": f"select coalesce(sum(greatest(s - p - 1, 0)), 0)::bigint as isolated from (select s, lag(s, 1, 0) over (order by s) p from (select distinct s from ({ORDPART})))",
    "csr_index": f"""with e as ({ORDPART}), n as (select max(s) + 1 v from e), v as (select unnest(range(0, (select v from n) + 1)) id), dg as (select s, count(*) d from e group by 1)
select id, (4 * coalesce(sum(coalesce(d, 0)) over (order by id rows between unbounded preceding and 1 preceding), 0))::bigint as off from v left join dg on s = id""",
    "csr_matrix": f"select s as src, t as dst from ({ORD})",
    "frontier_expand": f"select t as dst, s * 4 as msg from ({ORD}) where s < 100",
    "vertex_state_merge": f"""with m as (select t, min(s) x from ({EVT}) where s < 50 group by 1)
select id, (case when x is null then 0 else 2 end)::int as iteration, x as val, x is not null as active from (select unnest(range((select max(greatest(s, t)) + 1 from ({EVT})))) id) left join m on t = id""",
    "bfs_unvisited_anti": f"select distinct t as id from ({EVT}) where t >= 40",
    "bfs_levels": f"{tree(ORDPART)} select v as vertex, d::int as depth from lv",
    "bfs_parents": f"{tree(ORD)} select v as vertex, d::int as depth, p as parent from b",
    "bfs_level_sizes": f"{tree(ORD)} select d::int as depth, count(*) as vertices from lv group by d",
    "bfs_frontier_stats": f"{tree(EVT)} select d::int as depth, count(*) as vertices, count(*) as total, 1.0::double as ratio, count(distinct (v * 8) >> 13) as pages from lv group by d",
    "bfs_point_to_point": path(ORD, True),
    "bfs_backtrace_path": path(EVT, False),
    "pagerank_1iter": f"{rank(ORDPART)} select id, round(case when abs(old - fin) >= 1e-4 then fin else old end, 9) as rank from j",
    "pagerank_raw": f"{rank(ORD)} select id, round(case when abs(old - fin) >= 1e-4 then x else old end, 9) as rank from j",
    "pagerank_active": f"{rank(ORD)} select id, coalesce(abs(old - fin) >= 1e-4, false) as active from j",
    "pagerank_2iter": ranks(ORD, 2, True),
    "pagerank_10iter": ranks(ORD, 10, False),
    "bc_merge_flip_level": f"{tree(EVT)} select p as key, case when d = 1 then 5 else 1 end::bigint as value from b union all select v, 5 from b where d = 1",
    "bc_leaf_counts": f"""{tree(ORD)},
leaf as (select b.* from b where not exists (select 1 from b c where c.p = b.v and c.d = b.d + 1)),
w(a, d) as (select p, d - 1 from leaf union all select b.p, b.d - 1 from w join b on b.v = w.a and b.d = w.d where w.d > 0)
select a as vertex, count(*) as leaves from w group by 1""",
    "gather_by_index": "select event_id as pos, user_id as idx, p_brand as value from events join part on p_partkey = user_id",
    "rmat_generate": f"{RMAT} select id, src, dst from r",
    "rmat_quadrants": f"{RMAT} select (src >= 128)::int as down, (dst >= 128)::int as \"right\", count(*) as n from r group by 1, 2",
    "kmer_text_lines": f"""{KMERS}, c as (select kmer, count(*) filter (where nxt = 'a') a, count(*) filter (where nxt = 'e') e, count(*) filter (where nxt = 'i') i, count(*) filter (where nxt = 'o') o from w group by kmer)
select {" || ".join(f"case substr(kmer, {j}, 1) when 'e' then '01' when 'i' then '10' when 'o' then '11' else '00' end" for j in (1, 2, 3, 4))} || ' ' || a || ' ' || e || ' ' || i || ' ' || o as line from c""",
    "random_updates_reduce": "select ((((i * 2654435 + 1) % 2147483648 * 1103515245 + 12345) % 2147483648) * 1103515245 + 12345) % 2147483648 & 4095 as key, count(*) as value from range(10000) r(i) group by 1",
    "result_file": "select l_partkey as key, count(*) as value from lineitem group by 1",
    "text_edges_round_trip": f"select s as src, t as dst from ({EVT})",
    "packed_edges_round_trip": f"select s as src, t as dst from ({EVT})",
    "csr_files_round_trip": f"""with e as ({EVT}), n as (select max(s) + 1 v from e), v as (select unnest(range(0, (select v from n) + 1)) id), dg as (select s, count(*) d from e group by 1),
i as (select (4 * coalesce(sum(coalesce(d, 0)) over (order by id rows between unbounded preceding and 1 preceding), 0))::bigint as off from v left join dg on s = id)
select 'index' as file, off as value, count(*) as n from i group by off union all select 'matrix', t, count(*) from e group by t""",
    "fastq_round_trip": "select translate(md5(c_custkey::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq, count(*) as n from customer group by 1",
    "stream_reduce": "select l_suppkey as key, sum(l_orderkey)::bigint as value from lineitem group by 1",
    "kmer_count": f"{KMERS} select kmer, count(*) as n from w group by kmer",
    "kmer_next_char": f"{KMERS} select kmer, " + ", ".join(f"count(*) filter (where nxt = '{c}') as n_{c}" for c in "aeio") + " from w group by kmer",
}

"""SQL for the registered queries: shared table expressions, and a final selection for each query."""

from __future__ import annotations

import math

from ..functions.scalar import KEY_FACTORS, LAST_ROUNDS, MODULUS, ROUND
from ..operators.resample import SEED

R, P = "0.0004931", "0.07225"


def _distance(s1: str, e1: str, s2: str, e2: str, size: str, same: str) -> str:
    return (
        f"case when {same} then {e1} - {s1} + 1 when {s1} <= {s2} then least({e2} - {s1} + 1, {size} - {s2} + {e1} + 1)"
        f" else least({e1} - {s2} + 1, {size} - {s1} + {e2} + 1) end"
    )


def _posterior(e: str = "log_exp", u: str = "log_uni") -> str:
    nom, uni = f"{P} * exp({e})", f"(1 - {P}) * exp({u})"
    return f"case when {nom} + {uni} = 0 then (ln({P}) + {e} > ln(1 - {P}) + {u})::int::double else {nom} / ({nom} + {uni}) end"


def _sums(weight: str) -> str:
    return (
        f"sum({weight} * exp_prob) log_exp, sum({weight} * occurrences * log_uni_prob) log_uni, sum(occurrences)::bigint occurrences, sum(fusions)::bigint fusions,"
        " sum(n_genes1)::bigint n_genes1, sum(n_genes2)::bigint n_genes2, count(*) n_organisms"
    )


def _zeta(rows: str, key: str, rate: str, phi: str) -> str:
    return (
        f"(select *, ee / (ee + uu) zeta from (select *, case when e0 > 0 then e0 else min(case when e0 > 0 then e0 end) over (partition by {key}) end ee"
        f" from (select *, {phi} * {rate} * exp(-{rate} * distance) e0, (1 - {phi}) / half uu from {rows})))"
    )


def _step(key: str, rows: str) -> str:
    return f"select {key}, sum(n * zeta) / sum(n * zeta * distance) rate, sum(n * zeta) / sum(n) phi, sum(n * ln(ee + uu)) log_likelihood, sum(n)::bigint n_pairs from {_zeta(rows, key, R, P)} group by {key}"


def _mixed(h: str, *keys: str) -> str:
    """scalar.mixed in SQL."""
    a, b, c = KEY_FACTORS
    turn = lambda h, factor, mask: f"(xor({h}, {mask}) * {factor} % {MODULUS})"
    h = f"{h}::bigint"
    for key in keys:
        h = turn(f"(({h} * {a} + ({key})::bigint * {b} + {c}) % {MODULUS})", *ROUND)
    for last in LAST_ROUNDS:
        h = turn(h, *last)
    return h


def _count(number: str) -> str:
    """scalar.poisson_count in SQL: limits by the sum of the shares e^-1 / k!."""
    limits = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * MODULUS) for k in range(12)]
    return "(" + " + ".join(f"({number} >= {x})::int" for x in limits) + ")"


def _resamples(weight: str) -> str:
    return (
        f"with drawn as materialized (select sample, rate, phi, {weight}::double * {_count('number')} k from (select s.*, weight, sample, {_mixed(str(SEED), 'sample', 'organism_id')} number"
        " from sound s join (select organism_id, weight from closure where subclade_id = 0) using (organism_id), range(300) r(sample))),"
        " means as (select sample, sum(k * rate) / nullif(sum(k), 0) rate, sum(k * phi) / nullif(sum(k), 0) phi from drawn group by sample)"
        " select sample, 'rate' parameter, round(rate, 8) mean from means union all select sample, 'phi', round(phi, 8) from means"
    )


def _permutations(weight: str) -> str:
    far = _distance("g1.gene_start", "g1.gene_end", "g2.gene_start", "g2.gene_end", "g1.size", "g1.gene_idx = g2.gene_idx")
    return f"""with members as materialized (select subclade_id, organism_id, weight, row_number() over (partition by subclade_id order by organism_id) - 1 place from closure),
      sizes as (select subclade_id, count(*) n from members group by subclade_id),
      drawn as (
        select subclade_id, bin, perm, ({_mixed(str(SEED), 'subclade_id', 'bin', 'perm', 'j')} * n) // {MODULUS} place
        from (select subclade_id, bin, n, perm, unnest(range(bin)) j from bins join sizes using (subclade_id), range(2) p(perm))),
      counted as materialized (select subclade_id, bin, perm, place, count(*) m from drawn group by all),
      firsts as (
        select subclade_id, bin, perm, place first_place from counted
        qualify row_number() over (partition by subclade_id, bin, perm order by {_mixed(str(SEED + 1), 'subclade_id', 'bin', 'perm', 'place')}, place) = 1),
      top as (select max(greatest(distance, 0)) t from leaf_dist),
      placed as materialized (
        select c.*, a.organism_id, a.weight, c.place = f.first_place is_first,
          case when c.place = f.first_place then 1.0::double / m else (1 - (greatest(d.distance, 0) / t * (1 - 1e-4::double) + 1e-4::double)) / m end stays
        from counted c join firsts f using (subclade_id, bin, perm) join members a on a.subclade_id = c.subclade_id and a.place = c.place join members b on b.subclade_id = c.subclade_id and b.place = f.first_place
        left join leaf_dist d on d.organism1 = least(a.organism_id, b.organism_id) and d.organism2 = greatest(a.organism_id, b.organism_id), top),
      hashed as (select *, {_mixed(str(SEED + 2), 'subclade_id', 'bin', 'perm', 'place')} h, unnest(range(m)) k from placed),
      chosen as (select *, {_mixed('h', 'k')} draw from hashed),
      genes_of as (select organism_id, count(*) n_genes from pool group by organism_id),
      picked as materialized (
        select c.*, draw::double / {MODULUS} >= stays and not (is_first and k = 0) moved, ({_mixed('draw', '1')} * n_genes) // {MODULUS} i1, ({_mixed('draw', '2')} * n_genes) // {MODULUS} i2
        from chosen c join genes_of using (organism_id)),
      far as (
        select p.*, case when moved then {far} else g1.gene_end - g1.gene_start + g2.gene_end - g2.gene_start + 2 end d
        from picked p join pool g1 on g1.organism_id = p.organism_id and g1.gene_idx = i1 join pool g2 on g2.organism_id = p.organism_id and g2.gene_idx = i2),
      sums as (
        select subclade_id, bin, perm, sum({weight} * (ln({R}) - {R} * d)) log_exp, sum({weight} * log_uni_prob) log_uni, sum(moved::int)::double / count(*) moved
        from far join uniform using (organism_id) group by all)
      select subclade_id, bin, perm, round(log_exp, 3) log_exp, round(log_uni, 3) log_uni, round(moved, 6) moved, round({_posterior()}, 6) prob from sums"""


CTES = f"""
genes as (
  select o_custkey organism_id, case when o_orderkey % 5 = 0 then 'plasmid' else 'chr' end molecule_id, o_orderkey gene_id,
    (o_orderkey % 4) * 4000 + date_diff('day', date '1995-01-01', cast(o_orderdate as date)) gene_start,
    (o_orderkey % 4) * 4000 + date_diff('day', date '1995-01-01', cast(o_orderdate as date)) + 300 + (o_orderkey * 37) % 900 gene_end
  from orders),
molecules as (
  select distinct organism_id, molecule_id, (case when molecule_id = 'chr' then 36000 + 100 * (organism_id % 100) else 35000 end)::bigint length from genes),
main as (
  select organism_id, molecule_id, length from molecules qualify row_number() over (partition by organism_id order by length desc, molecule_id) = 1),
hits as (
  select g.organism_id, g.gene_id, p_size domain_id, (51 - l_quantity) * (case when p_size % 4 = l_orderkey % 4 then 1 else 10 end) / 40000.0 evalue,
    row_number() over (partition by g.gene_id order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_shipdate) line_no
  from lineitem join genes g on g.gene_id = l_orderkey join part on p_partkey = l_partkey),
clans as (select distinct p_size domain_id, p_size % 20 clan_id from part where p_size % 5 <> 0),
dom as (select distinct p_size domain_id from part),
go_domain as (select domain_id % 12 go_id, domain_id from dom union select domain_id * 7 % 12, domain_id from dom),
go_terms as (
  select distinct go_id, 'term ' || go_id as name, case when go_id % 3 = 0 then 'molecular_function' else 'biological_process' end namespace,
    case when go_id % 4 = 1 then '"OBSOLETE. t"' else '"t"' end def from go_domain),
bp as (select * from go_terms where namespace = 'biological_process' and def not like '"OBSOLETE.%'),
process as (select * from go_domain where go_id in (select go_id from bp)),
filtered as (
  select h.*, g.gene_start, g.gene_end, m.length size from hits h join genes g using (organism_id, gene_id) join main m using (organism_id, molecule_id) where evalue < 0.001),
kept as (
  select f.*, clan_id from filtered f left join clans using (domain_id)
  qualify clan_id is null or row_number() over (partition by organism_id, gene_id, clan_id order by evalue, line_no desc) = 1),
gd as (select distinct organism_id, domain_id, gene_id, gene_start, gene_end, size from kept),
counts as (select organism_id, domain_id, count(distinct gene_id) n_genes from kept group by all),
dists as (
  select a.organism_id, a.domain_id domain1, b.domain_id domain2, a.gene_id gene1, b.gene_id gene2,
    case when a.gene_id <= b.gene_id then {_distance('a.gene_start', 'a.gene_end', 'b.gene_start', 'b.gene_end', 'a.size', 'a.gene_id = b.gene_id')}
      else {_distance('b.gene_start', 'b.gene_end', 'a.gene_start', 'a.gene_end', 'a.size', 'false')} end distance,
    a.gene_id = b.gene_id fused
  from gd a join gd b on a.organism_id = b.organism_id and a.domain_id < b.domain_id),
marked as (
  select *, bool_or(fused) over (partition by organism_id, domain1, domain2, gene1) f1, bool_or(fused) over (partition by organism_id, domain1, domain2, gene2) f2 from dists),
closest as (
  select organism_id, domain1, domain2, gene1, gene2, distance, fused from (
    select *, row_number() over (partition by organism_id, domain1, domain2, gene1 order by distance, gene2) r1,
      row_number() over (partition by organism_id, domain1, domain2, gene2 order by distance, gene1) r2
    from marked where fused or (not f1 and not f2))
  where fused or r1 = 1 or r2 = 1),
organism as (
  select s.*, x.n_genes n_genes1, y.n_genes n_genes2 from (
    select organism_id, domain1, domain2, sum(ln({R}) - {R} * distance) exp_prob, count(*) occurrences, sum(fused::int)::bigint fusions from closest group by all) s
  join counts x on x.organism_id = s.organism_id and x.domain_id = domain1 join counts y on y.organism_id = s.organism_id and y.domain_id = domain2),
uniform as (select organism_id, case when length / 2.0 >= 100 then ln(1 / (length / 2.0)) else ln(1e-20) end log_uni_prob from main),
joined as (select o.*, log_uni_prob from organism o join uniform using (organism_id)),
pair_index as (select domain1, domain2, row_number() over (order by domain1, domain2) - 1 pair_id from (select distinct domain1, domain2 from organism)),
entries as (
  select distinct organism_id, go_id, gene_id, domain_id from (
    select organism_id, go_id, gene_id, domain_id, count(*) over (partition by organism_id, go_id) k from kept join process using (domain_id)) where k > 1),
go_pairs as (
  select distinct a.organism_id, a.gene_id gene1, b.gene_id gene2 from entries a join entries b on a.organism_id = b.organism_id and a.go_id = b.go_id and a.gene_id <= b.gene_id),
pos as (select distinct organism_id, gene_id, gene_start, gene_end, size from gd),
go_dist as (
  select p.organism_id, gene1, gene2, {_distance('a.gene_start', 'a.gene_end', 'b.gene_start', 'b.gene_end', 'a.size', 'gene1 = gene2')} distance
  from go_pairs p join pos a on a.organism_id = p.organism_id and a.gene_id = gene1 join pos b on b.organism_id = p.organism_id and b.gene_id = gene2),
lineage as (
  select organism_id, n_nationkey nation, n_regionkey region, (c_acctbal + 1000) / 1000 leaf_dist, 5 + 0.1::double * n_nationkey nation_dist, 10.0::double + n_regionkey region_dist
  from (select distinct organism_id from kept) join customer on c_custkey = organism_id join nation on n_nationkey = c_nationkey),
nodes as (
  select 0 depth, null::int region, null::int nation, null::bigint organism_id, 0.0::double dist where (select count(*) from lineage) > 0
  union all select distinct 1, region, null::int, null::bigint, region_dist from lineage
  union all select distinct 2, region, nation, null::bigint, nation_dist from lineage
  union all select 3, region, nation, organism_id, leaf_dist from lineage),
numbered as (
  select *, row_number() over (order by depth, coalesce(region, -1), coalesce(nation, -1), coalesce(organism_id, -1)) - 1 bfs_idx, count(*) over () total from nodes),
tree as (select *, case when bfs_idx = 0 then 0 else total - bfs_idx end node_id from numbered),
linked as (
  select t.node_id, p.node_id parent_id, t.dist, t.organism_id, t.depth = 3 is_leaf, t.depth, t.bfs_idx, t.region, t.nation from tree t left join tree p
  on p.depth = t.depth - 1 and (t.depth < 2 or p.region = t.region) and (t.depth < 3 or p.nation = t.nation)),
s3 as (select t.node_id, t.organism_id, case when t.dist = 0 then 2.2250738585072014e-308 else t.dist end score, t.region, t.nation from tree t where depth = 3),
s2 as (select n.node_id, s.organism_id, s.score, s.region, s.nation, n.dist from s3 s join tree n on n.depth = 2 and n.region = s.region and n.nation = s.nation),
s1 as (
  select n.node_id, s.organism_id, s.score + s.dist * s.score / sum(s.score) over (partition by s.node_id) score, s.region, n.dist
  from s2 s join tree n on n.depth = 1 and n.region = s.region),
s0 as (select 0 node_id, organism_id, score + dist * score / sum(score) over (partition by node_id) score from s1),
scores as (select node_id, organism_id, score from s3 union all select node_id, organism_id, score from s2 union all select node_id, organism_id, score from s1 union all select node_id, organism_id, score from s0),
closure as (
  select node_id subclade_id, organism_id, score,
    case when n = 1 or hi - lo < 1e-6 then 1.0 else (score - lo) / (hi - lo) * (1 - 1.0::double / n) + 1.0::double / n end weight, score / total * n mean_one
  from (select *, count(*) over w n, min(score) over w lo, max(score) over w hi, sum(score) over w total from scores window w as (partition by node_id))),
sub0 as (select subclade_id, domain1, domain2, {_sums('1.0::double')} from joined join closure using (organism_id) group by all),
sub as materialized (select *, {_posterior()} prob from sub0),
maxima as (
  select t.parent_id subclade_id, domain1, domain2, max(occurrences) child_max from sub join linked t on t.node_id = subclade_id where t.parent_id is not null group by all),
flags as (
  select s.subclade_id, s.domain1, s.domain2, coalesce(child_max, 0) <> s.occurrences is_split from sub s join linked t on t.node_id = s.subclade_id and not t.is_leaf
  left join maxima m on m.subclade_id = s.subclade_id and m.domain1 = s.domain1 and m.domain2 = s.domain2),
above as (
  select a.node_id, b.node_id ancestor_id, b.depth ancestor_depth from tree a join tree b
  on b.depth <= a.depth and (b.depth < 1 or b.region = a.region) and (b.depth < 2 or b.nation = a.nation) and (b.depth < 3 or b.organism_id = a.organism_id)),
split_prob as (select s.* from sub s join flags f on f.is_split and f.subclade_id = s.subclade_id and f.domain1 = s.domain1 and f.domain2 = s.domain2),
pruned as (
  select s.* replace (a.prob as prob) from sub s join (
    select v.node_id, p.domain1, p.domain2, arg_max(p.prob, v.ancestor_depth) prob from above v join split_prob p on p.subclade_id = v.ancestor_id group by all) a
  on a.node_id = s.subclade_id and a.domain1 = s.domain1 and a.domain2 = s.domain2 join linked t on t.node_id = s.subclade_id and not t.is_leaf
  union all select s.* from sub s join linked t on t.node_id = s.subclade_id and t.is_leaf),
pairs_binned as (
  select *, unnest(list_filter([b, case when occurrences >= 5 * b then 5 * b end, case when b >= 10 then b // 2 end], lambda x: x is not null)) bin
  from (select *, pow(10, floor(log10(occurrences) + 1e-12))::bigint b from sub where occurrences > 0)),
bins as (select subclade_id, bin, count(*) n_pairs, avg(prob) mean_prob from pairs_binned group by all),
pool as (
  select organism_id, row_number() over (partition by organism_id order by gene_id) - 1 gene_idx, gene_id, gene_start, gene_end, size, n_domains / sum(n_domains) over (partition by organism_id) weight
  from (select organism_id, gene_id, gene_start, gene_end, size, count(*)::double n_domains from kept group by all)),
org_hist as (select organism_id, distance, count(*) n, any_value(length / 2.0) half from go_dist join main using (organism_id) group by all),
nation_hist as (select nation, distance, count(*) n, 20000.0::double half from go_dist join lineage using (organism_id) group by all),
nation_step as ({_step('nation', 'nation_hist')}),
org_step as ({_step('organism_id', 'org_hist')}),
leaf_dist as (
  select a.organism_id organism1, b.organism_id organism2, greatest(a.leaf_dist, 0) + greatest(b.leaf_dist, 0)
    + case when a.nation <> b.nation then greatest(a.nation_dist, 0) + greatest(b.nation_dist, 0) else 0 end
    + case when a.region <> b.region then greatest(a.region_dist, 0) + greatest(b.region_dist, 0) else 0 end distance
  from lineage a join lineage b on a.organism_id < b.organism_id),
own_rows as (select h.*, rate, phi from org_hist h join org_step using (organism_id) where rate > 0),
mean_rows as (select h.*, p.rate, p.phi from org_hist h, (select avg(rate) rate, avg(phi) phi from org_step) p),
own_z as (select organism_id, distance, zeta own from {_zeta('own_rows', 'organism_id', 'rate', 'phi')}),
mean_z as (select organism_id, distance, zeta mean from {_zeta('mean_rows', 'organism_id', 'rate', 'phi')}),
agreement as (
  select organism_id, sum((own > 0.5)::int)::bigint n_own, sum((mean > 0.5 and own > 0.5)::int)::double / nullif(sum((own > 0.5)::int), 0) tpr,
    sum((mean > 0.5 and own <= 0.5)::int)::double / nullif(sum((own > 0.5)::int), 0) fpr, case when count(*) > 1 then corr(own, mean) end corr
  from own_z join mean_z using (organism_id, distance) group by organism_id),
below as (select v.ancestor_id node_id, greatest(t.dist, 0) d from above v join tree t on t.node_id = v.node_id where v.node_id <> v.ancestor_id),
branch as (select node_id, sum(d) branch_length from below group by node_id),
sound as (select * from org_step where rate > 0 and not isnan(rate)),
own_values as (select 'rate' parameter, rate v from sound union all select 'phi', phi from sound),
coded as (select subclade_id, bin, floor(round(prob, 9) * 1000) code from pairs_binned),
observed as (
  select subclade_id, bin, count(*) n, max(code) / 1000 e_4, max(case when place = 10 then code end) / 1000 e_3, avg(code) / 1000 mean, quantile_cont(code, 0.5) / 1000 median,
    (count(*) filter (code > 500) + 1) / (count(*) + 1) pct_above, sum(case when code > 500 then code else 0 end) / count(*) statistic, count(*) filter (code > 500) / count(*) fraction
  from (select *, row_number() over (partition by subclade_id, bin order by code desc) place from coded) group by all)
"""

_CONS = "domain1, domain2, occurrences, fusions, n_genes1, n_genes2, n_organisms, round(log_exp, 4) log_exp, round(log_uni, 4) log_uni, round(prob, 6) prob"

FINAL = {
    "main_molecule": "select * from main",
    "hits_filtered": "select organism_id, gene_id, domain_id, round(evalue, 6) evalue, line_no from filtered",
    "clan_resolved": "select organism_id, gene_id, domain_id, clan_id, line_no from kept",
    "domain_gene_counts": "select * from counts",
    "domain_pairs": "select a.organism_id, a.domain_id domain1, b.domain_id domain2 from counts a join counts b on a.organism_id = b.organism_id and a.domain_id < b.domain_id",
    "gene_pair_distances": "select * from dists",
    "overlapping_genes": "select a.organism_id, a.gene_id gene1, b.gene_id gene2 from pos a join pos b on a.organism_id = b.organism_id and a.gene_id < b.gene_id where least(a.gene_end, b.gene_end) - greatest(a.gene_start, b.gene_start) > 0",
    "fusions": "select organism_id, domain1, domain2, count(*) fusions from dists where fused group by all",
    "closest_pairs": "select * from closest",
    "organism_pair_likelihood": "select organism_id, domain1, domain2, round(exp_prob, 5) exp_prob, occurrences, fusions, n_genes1, n_genes2 from organism",
    "uniform_prob": "select organism_id, round(log_uni_prob, 6) log_uni_prob from uniform",
    "conserved_root": f"select {_CONS} from (select *, {_posterior()} prob from (select domain1, domain2, {_sums('1.0::double')} from joined group by all))",
    "prob_code": "select gene_id, line_no, p, code::smallint code, round(case when code >= 0 then code / 1000.0 else pow(10.0, code) end, 9) decoded from (select *, case when p = 0 then 0 when p = 1 then 1000 when floor(log10(p)) >= -3 then trunc(p * 1000)::int else floor(log10(p))::int end code from (select gene_id, line_no, least(round(evalue * 40000 / 500, 4), 1.0) p from hits))",
    "pair_index": "select * from pair_index",
    "pair_lookup": "select organism_id, pair_id, occurrences from organism join pair_index using (domain1, domain2)",
    "pair_keys": "select domain1, domain2, lpad(domain1::varchar, 5, '0') || '_' || lpad(domain2::varchar, 5, '0') pair_key from pair_index",
    "go_terms_bp": "select * from bp",
    "go_semi_join": "select * from process",
    "go_domain_lists": "select go_id, string_agg(domain_id::varchar, ',' order by domain_id) members from process group by go_id",
    "go_gene_pairs": "select * from go_pairs",
    "go_pair_annotations": "select organism_id, gene1, gene2, array_to_string(list_sort(list_distinct(list(go_id))), ',') go_ids, array_to_string(list_sort(list_distinct(list_concat(list(d1), list(d2)))), ',') domain_ids from (select a.organism_id, a.gene_id gene1, b.gene_id gene2, a.go_id, a.domain_id d1, b.domain_id d2 from entries a join entries b on a.organism_id = b.organism_id and a.go_id = b.go_id and a.gene_id <= b.gene_id) group by organism_id, gene1, gene2",
    "non_go_pairs": "select a.organism_id, a.gene_id gene1, b.gene_id gene2 from pos a join pos b on a.organism_id = b.organism_id and a.gene_id <= b.gene_id except select organism_id, gene1, gene2 from go_pairs",
    "non_go_distance_histogram": f"select organism_id, distance, count(*) n from (select a.organism_id, {_distance('a.gene_start', 'a.gene_end', 'b.gene_start', 'b.gene_end', 'a.size', 'a.gene_id = b.gene_id')} distance from pos a join pos b on a.organism_id = b.organism_id and a.gene_id <= b.gene_id anti join go_pairs g on g.organism_id = a.organism_id and g.gene1 = a.gene_id and g.gene2 = b.gene_id) group by all",
    "go_distance_histogram": "select organism_id, distance, count(*) n from go_dist group by all",
    "distance_bins": "select bin, n, round(n / (sum(n) over () * 900.0::double), 10) density from (select distance // 900 bin, count(*) n from go_dist group by all)",
    "em_one_step": "select nation, round(rate, 9) rate, round(phi, 6) phi, round(log_likelihood, 3) log_likelihood, n_pairs from nation_step",
    "em_rounds": f"""with recursive em(organism_id, i, rate, phi, ll, live) as (
        select organism_id, 0, {R}::double, {P}::double, null::double, true from (select distinct organism_id from org_hist)
        union all
        select organism_id, i + 1, case when settled then rate else mass / greatest(reach, 1e-300) end, case when settled then phi else mass / pairs end, now, not settled from (
          select *, coalesce(abs(now - ll) <= 1e-8::double * greatest(abs(now), abs(ll)), false) settled from (
            select organism_id, i, rate, phi, ll, sum(n * ln(ee + uu)) now, sum(n * ee / (ee + uu)) mass, sum(n * distance * ee / (ee + uu)) reach, sum(n) pairs from (
              select *, case when e0 > 0 then e0 else coalesce(min(case when e0 > 0 then e0 end) over (partition by organism_id), 1e-300) end ee from (
                select em.*, distance, n, em.phi * em.rate * exp(-em.rate * distance) e0, (1 - em.phi) / half uu from em join org_hist using (organism_id) where live and i < 25))
            group by organism_id, i, rate, phi, ll)))
      select organism_id, round(rate, 8) rate, round(phi, 6) phi, round(ll, 4) log_likelihood, i rounds from em qualify row_number() over (partition by organism_id order by i desc) = 1""",
    "zetas": f"select organism_id, distance, n, round(zeta, 6) zeta from {_zeta('org_hist', 'organism_id', R, P)}",
    "sensitivity_rates": "select organism_id, n_own, round(tpr, 6) tpr, round(fpr, 6) fpr from agreement",
    "zeta_corr": "select organism_id, case when not isnan(corr) then round(corr, 4) end corr from agreement",
    "genes_in_either": "select organism_id, domain1, domain2, count(distinct gene)::bigint n_genes from (select organism_id, domain1, domain2, gene1 gene from dists union select organism_id, domain1, domain2, gene2 from dists) group by all",
    "pruning_counts": "select subclade_id, count(*) n_before, count(p.domain1) n_kept, count(*) - count(p.domain1) n_deleted from sub s left join pruned p using (subclade_id, domain1, domain2) group by subclade_id",
    "domain_go_lists": "select domain_id, string_agg(go_id::varchar, ',' order by go_id) members from process group by domain_id",
    "unmatched_hits": "select organism_id, gene_id, domain_id, line_no from hits where gene_id % 7 = 0",
    "conserved_sum_check": f"select 0::bigint subclade_id, {_CONS} from (select *, {_posterior()} prob from (select domain1, domain2, {_sums('1.0::double')} from joined group by all))",
    "weighted_param_mean": "select round(sum(weight * rate) / sum(weight), 9) rate, round(sum(weight * phi) / sum(weight), 6) phi from closure left join org_step using (organism_id) where subclade_id = 0",
    "param_resamples": _resamples("1"),
    "param_resamples_weighted": _resamples("weight"),
    "permutation_probs": _permutations("1"),
    "permutation_probs_weighted": _permutations("weight"),
    "param_spread": "select parameter, round(avg(v), 9) mean, round(stddev_pop(v), 9) sd, round(quantile_cont(v, 0.025), 9) p2_5, round(quantile_cont(v, 0.975), 9) p97_5 from own_values group by parameter",
    "param_histogram": "select parameter, bin, round(lo + bin * (hi - lo) / 50, 9) low, count(*) n, round(count(*) / (total * ((hi - lo) / 50)), 3) density from (select *, least(floor((v - lo) / ((hi - lo) / 50)), 49)::bigint bin from (select *, min(v) over w lo, max(v) over w hi, count(*) over w total from own_values window w as (partition by parameter))) group by parameter, bin, lo, hi, total",
    "fitted_density": "select organism_id, point::int point, round(half * point / 999, 3) distance, round(phi * rate * exp(-rate * (half * point / 999)) + (1 - phi) / half, 10) density from (select s.*, length / 2.0::double half from sound s join main using (organism_id)), range(1000) r(point)",
    "observed_bins": "select subclade_id, bin, n, round(e_4, 6) e_4, round(e_3, 6) e_3, round(mean, 6) mean, round(median, 6) median, round(pct_above, 6) pct_above, round(statistic, 6) statistic, round(fraction, 6) fraction from observed",
    "observed_heatmap": "select n_members, " + ", ".join(f'round(avg(case when bin = {b} then pct_above end), 6) "{b}"' for b in (1, 5, 10, 50, 100, 500, 1000, 5000, 10_000, 50_000, 100_000)) + " from observed join (select subclade_id, count(*) n_members from closure group by subclade_id) using (subclade_id) group by n_members",
    "occurrence_slice": "select subclade_id, domain1, domain2, occurrences, fusions, n_genes1, n_genes2, n_organisms, round(prob, 6) prob from sub where occurrences in (1, 5, 10)",
    "tree_nodes": "select node_id, parent_id, round(dist, 6) dist, organism_id, is_leaf, depth from linked",
    "subclade_ids": "select node_id subclade_id, region, nation, bfs_idx from linked where not is_leaf",
    "closure": "select subclade_id, organism_id from closure",
    "gsc_weights": "select subclade_id, organism_id, round(score, 6) score, round(weight, 6) weight from closure",
    "gsc_mean_one": "select subclade_id, organism_id, round(mean_one, 6) mean_one from closure",
    "conserved_weighted": f"select {_CONS} from (select *, {_posterior()} prob from (select domain1, domain2, {_sums('weight')} from joined join closure using (organism_id) where subclade_id = 0 group by all))",
    "conserved_subclades": f"select subclade_id, {_CONS} from sub",
    "conserved_subclades_weighted": f"select subclade_id, {_CONS} from (select *, {_posterior()} prob from (select subclade_id, domain1, domain2, {_sums('weight')} from joined join closure using (organism_id) group by all))",
    "pair_split": "with leaf as materialized (select region, nation, organism_id, domain1, domain2, count(*) o from closest join lineage using (organism_id) group by all),"
    " nation_ as materialized (select region, nation, domain1, domain2, sum(o) o, max(o) most from leaf group by all),"
    " region_ as materialized (select region, domain1, domain2, sum(o) o, max(o) most from nation_ group by all), root_ as (select domain1, domain2, sum(o) o, max(o) most from region_ group by all)"
    " select node_id subclade_id, domain1, domain2, o <> most is_split from nation_ n join tree t on t.depth = 2 and t.nation = n.nation"
    " union all select node_id, domain1, domain2, o <> most from region_ n join tree t on t.depth = 1 and t.region = n.region union all select 0, domain1, domain2, o <> most from root_",
    "pruned_subclades": "select subclade_id, domain1, domain2, occurrences, fusions, n_genes1, n_genes2, n_organisms, round(prob, 6) prob from pruned",
    "occurrence_bins": "select domain1, domain2, occurrences, case when occurrences >= 5 * b then 5 * b else b end single_bin, array_to_string(list_filter([b, case when occurrences >= 5 * b then 5 * b end, case when b >= 10 then b // 2 end], lambda x: x is not null), ',') bins from (select *, pow(10, floor(log10(occurrences) + 1e-12))::bigint b from (select domain1, domain2, sum(occurrences)::bigint occurrences from organism group by all))",
    "bin_pairs": "select subclade_id, bin, n_pairs, round(mean_prob, 5) mean_prob from bins",
    "leaf_distances": "select organism1, organism2, round(distance, 6) distance from leaf_dist",
    "leaf_distances_normalised": "select organism1, organism2, round(greatest(distance, 0) / (select max(greatest(distance, 0)) from leaf_dist) * (1 - 1e-4) + 1e-4, 6) norm_distance from leaf_dist",
    "gene_pool": "select organism_id, gene_idx, gene_id, gene_start, gene_end, size, round(weight, 6) weight from pool",
    "branch_length_sum": "select node_id, round(branch_length, 6) branch_length, round((branch_length - (select min(branch_length) from branch)) / nullif((select max(branch_length) - min(branch_length) from branch), 0), 5) scaled from branch",
    "missing_inputs": "select distinct organism_id from molecules where organism_id not in (select organism_id from filtered)",
    "incremental_todo": "select distinct organism_id from organism where organism_id not in (select organism_id from lineage where region < 2)",
}


def _whole(final: str) -> str:
    if not final.startswith("with "):
        return f"with {CTES.strip()}\n{final}"
    word = "with recursive" if final.startswith("with recursive") else "with"
    return f"{word} {CTES.strip()},{final.removeprefix(word)}"


SQL = {name: _whole(final) for name, final in FINAL.items()}

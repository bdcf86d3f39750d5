"""SQL with the results of the queries that SQL can express, over the same whole tables.

Not here: jump hashing (64-bit wrapping products), token packing, SentencePiece and page
extraction; the tests hold those against plain Python.
"""

from __future__ import annotations

from rinseframe.llm.quality import COUNT_OF, MEASURES, TWO_SIDED, Rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
WORDS = f"""d as (select doc_id, lang, source, coalesce(text, '') as text, {SPLIT} as w from documents),
t as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d)"""


def reached(nodes: str, node: str, links: str) -> str:
    """``root``: the smallest node reachable over ``links(a, b)``."""
    return f"""both_ways as (select a, b from {links} union all select b, a from {links}),
reach as (select {node} as a, {node} as b from {nodes} union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a),
root as (select a, min(b) as component_id from reach group by a)"""


leads = ", ".join(f"lead(word, {k}) over w13" for k in range(1, 13))
SUBSTRINGS = f"""with {WORDS},
g as (select doc_id, i, concat_ws(' ', word, {leads}) as k, lead(word, 12) over w13 as last
      from t window w13 as (partition by doc_id order by i)),
m as (select k, min(doc_id) as f from g where last is not null group by k),
r as (select g.doc_id, g.i from g join m using (k) where last is not null and f < g.doc_id),
c as (select distinct doc_id, i + o as i from (select doc_id, i, unnest(range(13)) as o from r)),
s as (select t.doc_id, string_agg(word, ' ' order by t.i) filter (c.i is null) as kept, count(c.i) as removed
      from t left join c on t.doc_id = c.doc_id and t.i = c.i group by t.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s on d.doc_id = s.doc_id"""

NEAR = f"""with recursive {WORDS},
low as (select doc_id, translate(word, '{UPPER}', '{LOWER}') as word, i from t),
g as (select doc_id, word, lead(word, 1) over x as w2, lead(word, 2) over x as w3, i from low window x as (partition by doc_id order by i)),
s as (select distinct doc_id, concat_ws(' ', word, w2, w3) as k from g where w3 is not null or i = 1),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.k = y.k and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
{reached("d", "doc_id", "links")}
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n on d.doc_id = n.doc_id join root on d.doc_id = root.a"""

VECTORS = f"""with recursive e as (select vec_id, embedding::double[] as v from embeddings),
good as (select vec_id, v, sqrt(list_dot_product(v, v)) as norm from e
         where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select x.vec_id as a, y.vec_id as b from good x join good y on x.vec_id < y.vec_id and len(x.v) = len(y.v)
          where list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.95),
{reached("e", "vec_id", "links")},
n as (select a, count(*) as n from both_ways group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from e left join n on n.a = e.vec_id join root on root.a = e.vec_id"""

URLS = f"""with p as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
hits as (select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc) as n
         from q join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select q.page_id, host, path, rule, coalesce(v, 'allow') as verdict from q left join hits on q.page_id = hits.page_id and n = 1"""

PREFERENCES = """with t as (
  select conv_id, conv_id >> 1 as pair_id, case when conv_id % 2 = 0 then 'c' else 'r' end as side, role, text,
         row_number() over (partition by conv_id order by turn, role, text) as n
  from conversations where conv_id is not null),
p as (select distinct pair_id from t),
equal as (select a.pair_id, a.n, row_number() over (partition by a.pair_id order by a.n) as k
          from t a join t b on a.pair_id = b.pair_id and a.side = 'c' and b.side = 'r' and a.n = b.n and a.role = b.role and a.text = b.text),
common as (select p.pair_id, count(n) as c from p left join equal on p.pair_id = equal.pair_id and n = k group by p.pair_id),
piece as (select t.*, c, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as piece from t join common using (pair_id)),
rest as (select *, sum(length(piece)) over (partition by conv_id order by n) as stop from piece where n > c),
span as (select *, (stop - length(piece) + length(role) + 5)::bigint || '-' || stop::bigint as span from rest),
one as (select pair_id,
  string_agg(piece, '' order by n) filter (side = 'c') as chosen, string_agg(piece, '' order by n) filter (side = 'r') as rejected,
  string_agg(span, ',' order by n) filter (side = 'c' and role = 'assistant') as chosen_mask,
  string_agg(span, ',' order by n) filter (side = 'r' and role = 'assistant') as rejected_mask
  from span group by pair_id),
prompt as (select pair_id, string_agg(piece, '' order by n) as prompt from piece where side = 'c' and n <= c group by pair_id)
select common.pair_id, 2 * common.pair_id as chosen_id, 2 * common.pair_id + 1 as rejected_id, c::int as common_turns,
  coalesce(prompt, '') as prompt, coalesce(chosen, '') as chosen, coalesce(rejected, '') as rejected,
  coalesce(chosen_mask, '') as chosen_mask, coalesce(rejected_mask, '') as rejected_mask
from common left join one using (pair_id) left join prompt using (pair_id)"""


def quality_sql(rules: Rules) -> str:
    values = {m: e.replace("1000L", "1000").replace(" div ", " // ") for m, e in MEASURES.items()}
    stacked = " union all ".join(f"select lang, source, '{m}' as measure, {e} as v from base where not base_failed" for m, e in values.items())

    def fence(by: str, name: str) -> str:
        most = [f"max(high + {rules.reach} * greatest(high - middle, 1)) filter (measure = '{m}') as {m}_most" for m in MEASURES]
        least = [f"max(low - {rules.reach} * greatest(middle - low, 1)) filter (measure = '{m}') as {m}_least" for m in TWO_SIDED]
        tails = ", ".join(f"min(bucket) filter (10 * upto >= {tenths} * total) as {t}" for t, tenths in (("low", 1), ("middle", 5), ("high", 9)))
        return f"""{name}_run as (select {by}, measure, bucket, sum(n) over (partition by {by}, measure order by bucket) as upto,
          sum(n) over (partition by {by}, measure) as total from (select {by}, measure, bucket, sum(n) as n from sketch group by {by}, measure, bucket)),
{name}_tails as (select {by}, measure, max(total) as total, {tails} from {name}_run group by {by}, measure),
{name} as (select {by}, max(total) as documents, {", ".join(most + least)} from {name}_tails group by {by})"""

    names = [f"{m}_most" for m in MEASURES] + [f"{m}_least" for m in TWO_SIDED]
    chosen = ", ".join(
        f"case when g.documents >= {rules.least} then g.{c} when l.documents >= {rules.least} then l.{c} else e.{c} end as {c}" for c in names
    )
    few = {m: f" or {COUNT_OF[m]} <= {rules.few[m]}" if m in COUNT_OF else "" for m in MEASURES}
    in_bucket = {m: f"(({e}) >> greatest(length(bin({e})) - 7, 0)) << greatest(length(bin({e})) - 7, 0)" for m, e in values.items()}
    inside = " and ".join([f"(({e}) <= {m}_most{few[m]})" for m, e in in_bucket.items()] + [f"({in_bucket[m]}) >= {m}_least" for m in TWO_SIDED])
    return f"""with {WORDS},
g3 as (select doc_id, i, word, lead(word, 1) over x as w2, lead(word, 2) over x as w3 from t window x as (partition by doc_id order by i)),
often as (select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as c from g3 where w3 is not null),
repeated as (select doc_id, count(*) as n from (select distinct doc_id, i + o as i from (select doc_id, i, unnest(range(3)) as o from often where c > 1)) group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as l from d),
counts as (select d.doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(repeated.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines
  from d join lines using (doc_id) left join repeated using (doc_id)),
base as (select *, n_words < {rules.least_words} or 100 * n_repeat_words > {rules.most_repeats_percent} * n_words as base_failed from counts),
sketch as (select lang, source, 0 as every, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) as bucket, count(*) as n
  from ({stacked}) group by all),
{fence("lang, source", "per_group")}, {fence("lang", "per_lang")}, {fence("every", "per_all")},
limits as (select g.lang, g.source, {chosen} from per_group g join per_lang l on g.lang is not distinct from l.lang cross join per_all e)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  not base_failed and coalesce({inside}, false) as kept
from base left join limits on base.lang is not distinct from limits.lang and base.source is not distinct from limits.source"""


ORACLE = {
    "op3_substring_dedup": SUBSTRINGS,
    "op4_preference_format": PREFERENCES,
    "op7_adaptive_quality": quality_sql(Rules()),
    "op8_bloom_url_rules": URLS,
    "op9_tensored_minhash": NEAR,
    "op10_metric_range_join": VECTORS,
}

"""The contracts that SQL can say, for DuckDB."""

from heliospark.llm import quality_rules as Q
from heliospark.llm import url_filter as U

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"
ITEM_WORDS = rf"list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1 = f"""with recursive w as (select doc_id, {WORDS} as w from documents),
  s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [concat(len(w), ' words: ', array_to_string(w, ' '))] else [] end) as g from w),
  n as (select doc_id, count(*) as n from s group by doc_id),
  rare as (select g from s group by g having count(*) > 1),
  o as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a semi join rare r on a.g = r.g join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
  e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
  c as (select doc_id as d, doc_id as c from documents union select e.b, c.c from c join e on e.a = c.d)
  select d.doc_id, coalesce(n.n, 0) as n_shingles, min(c.c) as component_id from documents d left join n using (doc_id) join c on c.d = d.doc_id group by d.doc_id, n.n"""

OP4 = f"""with i as (select item_id, {ITEM_WORDS} as w from benchmark),
  x as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: w[k:k + 9])) as win from i where len(w) > 0),
  d as (select doc_id, {ITEM_WORDS} as w from documents),
  s as (select distinct len(win) as n from x),
  p as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as k, w from d, s where len(w) >= n),
  h as (select doc_id, k, n, item_id from p join x on w[k:k + n - 1] = win),
  hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from h) group by doc_id),
  its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by doc_id)
  select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from d left join hit using (doc_id) left join its using (doc_id)"""

HOST = LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1)"
RULES = "(values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) r(verdict, h, p)"
BARE = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
LABELS = lambda n: f"regexp_extract(bare, '([^.]*\\.){{0,{n - 1}}}[^.]*$')"
NUMBER = r"regexp_matches(bare, '^([0-9.]+|\[.*\])$')"
TWO = f"{LABELS(2)} in ({', '.join(repr(x) for x in U.SUFFIXES)})"


def level(name: str, rows: str, keys: str) -> str:
    """The likelihood of each strength, the likeliest, and the rates that it gives."""
    like = "lgamma(k + s * up) + lgamma(n - k + s * (1 - up)) - lgamma(n + s) + lgamma(s) - lgamma(s * up) - lgamma(s * (1 - up))"
    fit = f"select s from (select s, coalesce(round(sum({like}) filter (n > 0), 6), 0) as l from (select unnest([{', '.join(map(str, U.GRID))}]::double[]) as s) left join {name}_in on true group by s) order by l desc, s desc limit 1"
    return f"{name}_in as ({rows}), {name} as (select {keys}, n, k, up, s, (k + s * up) / (n + s) as rate from {name}_in, ({fit}))"


SERIES = f"exp(lgamma(a + b) - lgamma(a + 1) - lgamma(b) - (a + b) * ln(2)) * (1 + list_sum(list_transform(range(0, {U.TERMS}), lambda i: exp(lgamma(a + 1) + lgamma(a + b + i + 1) - lgamma(a + i + 2) - lgamma(a + b) - (i + 1) * ln(2)))))"
OP3 = f"""with p as (select page_id, {HOST} as host, {PATH} as path from pages), q as (select *, {BARE} as bare from p),
  x as (select *, case when {NUMBER} then bare when {TWO} then {LABELS(3)} else {LABELS(2)} end as domain, case when {NUMBER} then '' when {TWO} then {LABELS(2)} else {LABELS(1)} end as suffix from q),
  l as (select doc_id as page_id, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as k from labels where doc_id is not null group by doc_id),
  h0 as (select bare, domain, suffix, coalesce(sum(n), 0)::double as n, coalesce(sum(k), 0)::double as k from x left join l using (page_id) group by all),
  d0 as (select domain, suffix, sum(n) as n, sum(k) as k from h0 group by all), s0 as (select suffix, sum(n) as n, sum(k) as k from d0 group by all),
  {level("sx", "select *, (select (sum(k) + 1) / (sum(n) + 2) from s0) as up from s0", "suffix")},
  {level("dx", "select d0.*, sx.rate as up from d0 join sx using (suffix)", "domain, suffix")},
  {level("hx", "select h0.*, dx.rate as up from h0 join dx using (domain, suffix)", "bare")},
  post as (select bare, k + s * up as a, n - k + s * (1 - up) as b from hx),
  bad as (select bare, a > b and case when a + b <= {U.EXACT} then {SERIES} <= {1 - U.SURE} else a / (a + b) - {U.Z}::double * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5 end as bad from post),
  f as (select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as v from p, {RULES} where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
  select page_id, x.host, path, rule, coalesce(v, case when bad.bad then 'block' else 'allow' end) as verdict from x join bad using (bare) left join f using (page_id)"""


def op7() -> str:
    """Metrics, votes and expectation-maximisation as a recursive query whose one row holds the model."""
    rules, believed = Q.RULES, (f"{Q.PRIOR * Q.BAD_IN_GOOD}", f"{Q.PRIOR * Q.BAD_IN_BAD}")
    vote = lambda name, bad, good: f"case when ({bad}) and {'true' if name == 'length' else f'n_words >= {Q.FEW}'} then -1 when ({good}) and n_words >= {Q.FEW} then 1 else 0 end"
    odds = "ln(share / (1 - share))" + "".join(f" + case v[{i}] when -1 then ln(g{i} / b{i}) when 1 then ln((1 - g{i}) / (1 - b{i})) else 0 end" for i in range(1, len(rules) + 1))
    rate = lambda i, p, c, k: f"(sum(case when v[{i}] < 0 then {p} else 0 end) + {believed[k]}) / (sum(case when v[{i}] <> 0 then {p} else 0 end) + {Q.PRIOR}) as {c}{i}"
    steps = ", ".join(f"{rate(i, 'n * p', 'g', 0)}, {rate(i, 'n * (1 - p)', 'b', 1)}" for i in range(1, len(rules) + 1))
    first = ", ".join(f"{Q.BAD_IN_GOOD}::double as g{i}, {Q.BAD_IN_BAD}::double as b{i}" for i in range(1, len(rules) + 1))
    return rf"""with recursive t as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
  w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
  win as (select rid, unnest(range(1, len(w) - 1)) as k, w from w), dup as (select rid, unnest(list(k)) as k from (select rid, k, array_to_string(w[k:k + 2], ' ') as g from win) group by rid, g having count(*) > 1),
  rep as (select rid, count(distinct pos) as r from (select rid, unnest(range(k, k + 3)) as pos from dup) group by rid),
  m as (select rid, doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(r, 0) as n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) as n_capitals, length(regexp_replace(t, '[\p{{L}}\p{{N}}\x20\x09-\x0D]+', '', 'g')) as n_marks,
    len(list_filter(w, lambda x: not regexp_matches(x, '[\p{{L}}\p{{N}}]'))) as n_wordless, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_stutters, len(ls) as n_lines from w left join rep using (rid)),
  votes as (select *, [{", ".join(vote(*r) for r in rules)}] as v from m), pat as (select v, count(*) as n from votes group by v),
  em as (select 0 as k, {Q.GOOD}::double as share, {first} union all
    select k + 1, (sum(n * p) + {Q.PRIOR * Q.GOOD}) / (sum(n) + {Q.PRIOR}) as share, {steps} from (select em.*, v, n, 1 / (1 + exp(-({odds}))) as p from em, pat where k < {Q.ROUNDS}) group by k),
  j as (select votes.*, 1 / (1 + exp(-({odds}))) as p, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from votes, em where k = {Q.ROUNDS})
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and p >= {Q.KEEP_FROM} as kept, round(p, 6) as p_good from j"""


OP7 = op7()


def floored(factor: int) -> str:
    return f"list_transform(embedding, lambda x: floor({factor} * x::double)::bigint)"


FIT = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def op11(k: int = 8, rounds: int = 10) -> str:
    """Each assignment and each update as a table of its own."""
    step = "a{r} as materialized (select vec_id, v, arg_min(c, (d, c)) as c, min(d) as d from (select vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::bigint as d from kept, m{r}) group by vec_id, v)"
    move = "m{n} as materialized (select m{r}.c, coalesce(x.m, m{r}.m) as m from m{r} left join (select c, list(floor(s / n)::bigint order by p) as m from (select c, p, sum(x) as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as p from a{r}) group by c, p) group by c) x using (c))"
    tables = [step.format(r=0)] + [t for r in range(rounds) for t in (move.format(r=r, n=r + 1), step.format(r=r + 1))]
    return f"""with kept as materialized (select vec_id, {floored(1024)} as v from embeddings where len(embedding) = 64 and {FIT}),
  m0 as materialized (select row_number() over (order by h) - 1 as c, v as m from (select sha256('3:' || vec_id) as h, v from kept order by h limit {k})), {", ".join(tables)}
  select vec_id, c::int as cluster, d as distance, sum(d) over (partition by c)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256 from a{rounds} join m{rounds} using (c)"""


OP11 = op11()

OP12 = f"""with e as (select vec_id, {floored(256)}::double[] as v from embeddings where vec_id is not null and {FIT}),
  s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score from e q join e d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id)
  select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5"""

OP13 = f"""with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {floored(256)}::double[] as v from embeddings where vec_id is not null and label is not null and {FIT}),
  s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
  p as (select * from (select *, row_number() over (partition by a order by score desc, b) as k from s where same) where k <= 5),
  n as (select p.a as anchor_id, p.b as positive_id, s.b as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.a, p.b order by s.score desc, s.b)::int as rank from p join s using (a) where not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
  select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3"""

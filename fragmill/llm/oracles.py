"""DuckDB SQL for the queries that SQL can express: the substring operators by listing every window, the join by counting all shared shingles."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

PHRASES = rf"""with d as materialized (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
    windows as materialized (select doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
    first as (select h, min(doc_id) as first from windows group by h),
    gone as (select distinct doc_id, i + j as pos from (select doc_id, i from windows join first using (h) where first < doc_id), range(50) t(j)),
    kept as (select doc_id, string_agg(x, ' ' order by pos) as text, count(*) as n from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as pos from d) anti join gone using (doc_id, pos) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept using (doc_id)"""

SUFFIXES = """with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as t from documents),
    n as (select doc_id, t, len(t) // 2 as n from d),
    windows as materialized (select doc_id, i, substr(t, 2 * i + 1, 100) as h from (select doc_id, t, unnest(range(n - 49)) as i from n)),
    first as (select h, min(doc_id) as first from windows group by h having count(distinct doc_id) > 1),
    hits as (select doc_id, i from windows join first using (h) where first < doc_id),
    runs as (select doc_id, run, min(i) as a, max(i) + 50 as b from (select *, sum(new) over (partition by doc_id order by i) as run
        from (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from hits)) group by all),
    edges as (select doc_id, b as a, lead(a) over (partition by doc_id order by a, b) as b from (select doc_id, a, b from runs union all select doc_id, 0, 0 from n)),
    kept as (select doc_id, string_agg(substr(t, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' order by a) as t from edges join n using (doc_id) group by doc_id),
    lost as (select doc_id, sum(b - a) as removed, count(*) as spans from runs group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, sha256(unhex(kept.t)) as kept_sha256 from n join kept using (doc_id) left join lost using (doc_id)"""

SHINGLES = rf"""with recursive d as materialized (select doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} as w from documents),
    shingles as materialized (select distinct doc_id, md5(array_to_string(w[i : i + 4], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from shingles group by doc_id),
    links as materialized (select x.a, x.b from (select p.doc_id as a, q.doc_id as b, count(*) as c from shingles p join shingles q using (h) where p.doc_id <> q.doc_id group by all) x
        join n p on p.doc_id = x.a join n q on q.doc_id = x.b where 100 * c >= 75 * (p.n + q.n - c)),
    reach as (select doc_id as a, doc_id as b from d union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from d join (select a as doc_id, min(b) as component_id from reach group by a) using (doc_id) left join n using (doc_id)"""

"""SQL of the operators that exact comparison in DuckDB can express."""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
OP8 = f"""
with d as (select doc_id, {WORDS} as w from documents),
p as (select doc_id, generate_subscripts(w, 1) as i, unnest(w) as word, w, len(w) as n from d),
win as (select doc_id, i, word, n, case when i + 34 <= n then array_to_string(w[i:i + 34], ' ') end as s from p),
c as (select *, s is not null and count(*) over (partition by s) > 1 as twice from win),
r as (select *, coalesce(max(case when twice then i end) over (partition by doc_id order by i) >= i - 34, false) as gone from c),
k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as kept from r group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""

OP6 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, length(h) // 2 as n, unnest(range(1, length(h) // 2 + 1)) as i from d),
win as (select doc_id, i, n, substr(h, (2 * i - 1)::int, 2) as b, case when i + 199 <= n then md5_number(substr(h, (2 * i - 1)::int, 400)) end as s from p),
c as (select *, s is not null and count(*) over (partition by s) > 1 as twice from win),
r as (select *, coalesce(max(case when twice then i end) over (partition by doc_id order by i) >= i - 199, false) as gone from c),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from r),
k as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (starts) as n_spans, string_agg(b, '' order by i) filter (not gone) as kept from e group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join k using (doc_id)
"""

OP10 = f"""
with recursive d as (select doc_id, {WORDS} as w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as e from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (e) where a.doc_id <> b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where c >= 0.8 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join l on l.a = r.b)
select a as doc_id, min(b) as class_id, count(*) as class_size from reach group by a
"""

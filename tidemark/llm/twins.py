"""SQL that gives the rows of those queries that SQL can express, for DuckDB on the small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
with w as (select doc_id, {_WORDS} as words from documents),
g as (select doc_id, i, array_to_string(words[i:i+12], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13) t),
m as (select k, min(doc_id) as first_id from g group by k),
c as (select distinct g.doc_id, g.i + o.o as p from g join m on g.k = m.k and m.first_id < g.doc_id, (select unnest(range(0, 13)) as o) o),
t as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as p from w),
k as (select t.doc_id, count(*) as n, string_agg(word, ' ' order by t.p) as kept from t left join c on c.doc_id = t.doc_id and c.p = t.p where c.p is null group by t.doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k on k.doc_id = w.doc_id
"""

SUFFIX = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
g as (select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as k from (select doc_id, h, unnest(range(0, n - 399)) as i from d where n >= 400) t),
r as (select doc_id, i from g where k in (select k from g group by k having count(*) > 1)),
s as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end as fresh from r),
u as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as span from s),
v as (select doc_id, span, min(i) as a, max(i) + 400 as b from u group by doc_id, span),
p as (select v.doc_id, v.a, v.b, coalesce(lag(b) over (partition by v.doc_id order by a), 0) as before, row_number() over (partition by v.doc_id order by a desc) as back from v),
k as (select p.doc_id, count(*) as spans, sum(b - a) as gone, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || case when back = 1 then substr(h, 2 * b + 1) else '' end, '' order by a) as kept from p join d on d.doc_id = p.doc_id group by p.doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, d.h))) as kept_sha256 from d left join k on k.doc_id = d.doc_id
"""

_COMPONENTS = "e as (select a, b from links union all select b, a from links), r as (select a as id, a as root from (select distinct a from e) s union select e.b, r.root from r join e on r.id = e.a), c as (select id, min(root) as component from r group by id)"

MINHASH = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i:i+4], ' ') as k from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5) t union all select doc_id, '!' || array_to_string(words, ' ') from w where len(words) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
j as (select x.doc_id as a, y.doc_id as b, count(*) as both_ from s x join s y on x.k = y.k and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
links as (select a, b from j join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * both_ >= 75 * (na.n + nb.n - both_)),
{_COMPONENTS}
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component, w.doc_id) as component_id, coalesce(component, w.doc_id) = w.doc_id as kept from w left join n on n.doc_id = w.doc_id left join c on c.id = w.doc_id
"""

LATTICE = f"""
with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings),
links as (select p.vec_id as a, q.vec_id as b from v p join v q on p.vec_id < q.vec_id where list_dot_product(p.x, q.x) >= 0.95e0 * sqrt(list_dot_product(p.x, p.x)) * sqrt(list_dot_product(q.x, q.x))),
{_COMPONENTS},
d as (select id, count(*) as n from (select a as id from links union all select b from links) t group by id)
select v.vec_id, cast(coalesce(n, 0) as bigint) as n_links, coalesce(component, v.vec_id) as component_id, coalesce(component, v.vec_id) = v.vec_id as kept from v left join d on d.id = v.vec_id left join c on c.id = v.vec_id
"""

MIXING = f"""
with z as (select doc_id, source, coalesce('=' || source, '') as sk, cast(len({_WORDS}) as bigint) as size, ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 4))::bigint % 64 as stripe from documents),
y as (select *, case when size = 0 then -1 else 2 * length(bin(size)) + case when size * size >= 1::bigint << (2 * length(bin(size)) - 1)::bigint then 1 else 0 end end as band from z),
s as (select sk, min(source) as source, sum(size)::bigint as total from y group by sk),
q as (select sk, total, (row_number() over (order by source nulls last) - 1) % 3 + 1.0e0 as weight from s),
o as (select *, total * 3.0e0 as cap, sum(total) over () as everything, row_number() over (order by total / weight, sk) as place from q),
t as (select *, (everything - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by place rows between current row and unbounded following) as share from o),
f as (select arg_min(share, place) as share from t where share * weight <= cap),
a as (select sk, total, least(cap, weight * f.share) as target from t, f),
x as (select y.*, a.total, a.target, row_number() over (partition by y.sk order by case when size = 0 then 1 else 0 end, band, stripe, size, doc_id) as at_, coalesce(a.target / nullif(a.total, 0), 0) as rate, ('0x' || substr(md5('mix-1' || y.sk), 1, 8))::bigint / 4294967296.0e0 as off_ from y join a on a.sk = y.sk)
select doc_id, size, total as source_size, target, cast(case when size > 0 then (floor(rate * at_ + off_) - floor(rate * (at_ - 1) + off_)) * size else 0 end as bigint) as taken from x
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING = rf"""
with recursive t as (select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t),
r as (select doc_id, unnest(regexp_extract_all({_LOW}, '[a-zÀ-ÿ]+')) as run from documents),
c as (select doc_id, run, count(*) as k, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from r where length(run) >= 7 group by doc_id, run),
h as (select run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x), 2), lambda i: cast('0x' || substr(x, i + 1, 2) as bigint))), lambda s, y: xor(s >> 8, t.t[1 + (xor(s, y) & 255)])), 4294967295) as h from c, t),
w as (select case when h % 31 = 0 then substr(run, 1, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2) else run end as word, k from h),
v as (select word, cast(sum(k) as bigint) as n from w where length(word) >= 7 group by word having sum(k) >= 2),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
p as (select a.word, b.word as other, b.n as m from d a join d b on a.i = b.i and a.cut = b.cut and a.word <> b.word union select d.word, v.word, v.n from d join v on v.word = d.cut union select v.word, d.word, d.n from d join v on v.word = d.cut),
b as (select word, count(*) as near, max(m) as m, arg_min(other, (-m, other)) as other from p group by word),
f as (select v.word, v.n, coalesce(near, 0) as n_near, case when m >= 10 * v.n then other end as form, case when m >= 10 * v.n then m end as form_n from v left join b on b.word = v.word),
g as (select word, word as root from f where form is null union all select f.word, g.root from f join g on f.form = g.word)
select f.word, f.form, g.root, f.n, f.n_near, f.form_n from f join g on g.word = f.word
"""

RANKED = rf"""
with d as (select doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
a as (select count(*) as n_all, sum(len(terms))::bigint as l_all from d where len(terms) > 0),
f as (select doc_id, len(terms) as n, unnest(terms) as term from d),
t as (select doc_id, term, any_value(n) as n, count(*) as tf from f group by doc_id, term),
i as (select distinct item_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select term, cast(floor(1000 * ln(cast(2 * any_value(n_all) + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from t, a group by term),
s as (select i.item_id, t.doc_id, cast(sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + ((50 * t.n * n_all) // l_all))))) as bigint) as score from i join t on t.term = i.term join w on w.term = t.term, a group by i.item_id, t.doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 50
"""

_CONTROL = r"\\|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\]"

CHATS = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, role = 'assistant' as learnt, length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) as size from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256, cast(sum(case when learnt then length(text) else 0 end) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (learnt), '')) as loss_sha256, cast(3 + sum(size + 13 + case when learnt then 4 else 13 end) as bigint) as formatted_chars from e group by conv_id
"""

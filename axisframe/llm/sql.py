"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
with b as (select item_id, {_WORDS.format('text')} w from benchmark where text is not null and item_id is not null),
bw as (select item_id, least(10, len(w)) n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0),
grams as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') g from bw),
d as (select doc_id, coalesce({_WORDS.format('text')}, []) w from documents),
sizes as (select distinct n from grams),
dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n),
hits as (select distinct doc_id, i, dw.n, item_id from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') g from dw) dw join grams using (n, g)),
covered as (select doc_id, count(distinct p) n_hit from (select distinct doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
who as (select doc_id, count(*) n_items, string_agg(k, ',' order by k) ids from (select distinct doc_id, cast(item_id as varchar) k from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join who using (doc_id)
"""

OP4 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
p as (select doc_id, i, substr(x, 2 * i + 1, 100) w from (select doc_id, x, unnest(range(0, len(x) // 2 - 49)) i from d where len(x) >= 100)),
least as (select w, min(doc_id) m from p group by w),
hit as (select distinct doc_id, i from p join least using (w) where m < doc_id),
edge as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end e from hit),
island as (select doc_id, min(i) a, max(i) + 50 b from (select *, sum(e) over (partition by doc_id order by i rows unbounded preceding) k from edge) group by doc_id, k),
piece as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) z from island),
kept as (select doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' order by a) h, max(b) b, sum(b - a) n_removed, count(*) n_spans
  from piece join d using (doc_id) group by doc_id)
select doc_id, cast(len(x) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans,
  sha256(unhex(case when kept.doc_id is null then x else h || substr(x, 2 * kept.b + 1) end)) kept_sha256
from d left join kept using (doc_id)
"""

OP7 = """
with p as (select page_id, encode(coalesce(html, '')) body from pages),
f as (select body, max(page_id) first_id from p where octet_length(body) >= 1000 group by body)
select page_id, cast(octet_length(p.body) as bigint) payload_bytes, sha1(p.body) payload_digest,
  case when page_id < first_id then 'revisit' else 'response' end record_type,
  case when page_id < first_id then first_id end refers_to
from p left join f on p.body = f.body
"""

OP9 = """
with v as (select vec_id, [floor(256 * x::double) for x in embedding] e from embeddings
  where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_dot_product(q.e, c.e) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

OP12 = r"""
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
s as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') raw from u),
t as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') path from s),
fit as (select page_id, host, path, max(struct_pack(n := length(h || p), r := h || p, v := v)) best
  from t left join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p) group by all)
select page_id, host, path, best.r as rule,
  coalesce(best.v, case when regexp_matches('.' || host, '\.(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.') then 'block' else 'allow' end) verdict
from fit
"""

OP13 = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from p),
n as (select lang, cast(sum(len(w)) as bigint) n from w group by lang),
o as (select lang, k, w, unnest(range(1, len(w) - k + 2)) i from w, (values (1), (2), (3)) t(k) where len(w) >= k),
f as (select lang, k, w[i : i + k - 1] g, count(*) f from o group by all),
c as (select lang, k, g, f a from f where k > 1 and f >= 10),
cut as (select c.lang, c.k, g, a, unnest(range(1, c.k)) j from c),
scored as (select cut.lang, cut.k, cut.g, a, j, x.f l, y.f r, cast(1000000::hugeint * a * a // (x.f::hugeint * y.f) as bigint) score
  from cut join f x on x.lang = cut.lang and x.g = cut.g[1 : j] join f y on y.lang = cut.lang and y.g = cut.g[j + 1 : cut.k]),
least as (select lang, k, g, a, min(struct_pack(score := score, j := j, l := l, r := r)) m from scored group by all),
above as (select lang, part, max(a) most from (select lang, a, unnest([g[1 : 2], g[2 : 3]]) part from c where k = 3) group by all),
kept as (select least.lang, array_to_string(g, ' ') phrase, a, m.l l, m.r r, m.score score
  from least left join above on k = 2 and above.lang = least.lang and above.part = g where most is null or 100 * most < 50 * a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select r.lang, rank, phrase, a, l, r.r as r, n, score from r join n on n.lang = r.lang where rank <= 2000
"""

ORACLES = {
    "op13_collocations": OP13,
    "op12_url_filter": OP12,
    "op4_repeated_spans": OP4,
    "op7_warc": OP7,
    "op9_top_k": OP9,
    "op5_decontaminate": OP5,
}

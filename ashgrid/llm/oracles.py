"""DuckDB SQL of the operators that SQL can express, over the whole tables.

Operators 3 (rounds of overflow), 1 and 4 (match positions and surrogates), 7 (byte windows of
UTF-8), 8 (an HTML parser), 9 (a fit), 10 (raking to convergence) and 12 (runs of every period of long
texts) have no plain SQL; the tests hold them against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

TOP_K = """with v as (
  select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, q.v as query, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id, query order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5"""

DECONTAMINATION = rf"""with w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (
  select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
win as (
  select distinct item_id, array_to_string(words[s + 1:s + 10], ' ') as phrase, least(len(words), 10) as n
  from (select item_id, words, unnest(range(0, greatest(len(words) - 9, 1))) as s from b where len(words) > 0)),
hit as (
  select distinct d.doc_id, d.s, d.n, win.item_id from (
    select doc_id, n, s, array_to_string(words[s + 1:s + n], ' ') as phrase from (
      select doc_id, words, n, unnest(range(0, greatest(len(words) - n + 1, 0))) as s from w, (select distinct n from win))) d
  join win on win.phrase = d.phrase and win.n = d.n),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
ids as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as listed
  from (select distinct doc_id, cast(item_id as varchar) as id from hit) group by doc_id)
select w.doc_id, cast(len(w.words) as bigint) as n_words, coalesce(covered.n_hit, 0) as n_hit, coalesce(ids.n_items, 0) as n_items,
  sha256(coalesce(ids.listed, '')) as items_sha256, coalesce(covered.n_hit, 0) > 0 as contaminated
from w left join covered on covered.doc_id = w.doc_id left join ids on ids.doc_id = w.doc_id"""

NEAR_DUPLICATES = rf"""with recursive w as (
  select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as words from documents),
sh as (
  select distinct doc_id, array_to_string(words[s + 1:s + 5], ' ') as shingle
  from (select doc_id, words, unnest(range(0, greatest(len(words) - 4, 1))) as s from w where len(words) > 0)),
size as (select doc_id, count(*) as n from sh group by doc_id),
link as (
  select a.doc_id as a, b.doc_id as b from sh a join sh b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  join size x on x.doc_id = a.doc_id join size y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(doc_id, seen) as (
  select doc_id, doc_id from documents union select reach.doc_id, link.b from reach join link on link.a = reach.seen)
select w.doc_id, coalesce(size.n, 0) as n_shingles, min(reach.seen) as component_id
from w left join size on size.doc_id = w.doc_id join reach on reach.doc_id = w.doc_id group by w.doc_id, size.n"""


# crc32 of the decimal conv_id by its table of 256 steps; the path of a node is the list of its turns
PREFIX_TRIE = r"""with recursive tab(i, k, c) as (
  select i, 0, i from (select unnest(range(0, 256)) as i) union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from tab where k < 8),
step as (select i, c as x from tab where k = 8),
ids as (select distinct conv_id, cast(conv_id as varchar) as s from conversations where conv_id is not null),
crc(conv_id, s, pos, c) as (
  select conv_id, s, 0, cast(4294967295 as bigint) from ids union all
  select conv_id, s, pos + 1, xor(c >> 8, x) from crc join step on i = xor(c, ascii(substr(s, pos + 1, 1))) & 255 where pos < length(s)),
h as (select conv_id, xor(c, 4294967295) % 4 as h from crc where pos = length(s)),
t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as turn,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
head as (select h.conv_id, t.k as d, t.turn, t.words from h join t on t.conv_id = h.conv_id - h.conv_id % 20 and t.k <= h.h),
taken as (select h.conv_id, count(head.d) as n from h left join head on head.conv_id = h.conv_id group by h.conv_id),
rebuilt as (
  select * from head union all
  select t.conv_id, taken.n + t.k - h.h, t.turn, t.words from t join h on h.conv_id = t.conv_id and t.k > h.h join taken on taken.conv_id = t.conv_id),
whole as (
  select h.conv_id, coalesce(r.turns, []) as turns, coalesce(r.counts, []) as counts from h left join (
    select conv_id, list(turn order by d) as turns, list(words order by d) as counts from rebuilt group by conv_id) r on r.conv_id = h.conv_id),
prefix as (
  select conv_id, len(turns) as size, d, turns[1:d] as path, case when d = 0 then 0 else counts[d] end as words
  from (select *, unnest(range(0, len(turns) + 1)) as d from whole)),
node as (
  select path, any_value(d) as d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (size = d), '') as ends from prefix group by path),
child as (select path[1:d - 1] as path, count(*) as n from node where d > 0 group by 1),
full_node as (select node.*, coalesce(child.n, 0) as n_children from node left join child on child.path = node.path),
above as (
  select path[1:e] as path, sum(saved) as saved, count(*) filter (n_children = 0) as leaves
  from (select *, unnest(range(0, d + 1)) as e from full_node) group by 1)
select f.conv_id, cast(f.d as bigint) as depth, up.conv_id as parent_conv_id, f.n_convs, f.n_children, above.leaves as n_leaves,
  cast(above.saved as bigint) as saved_tokens, sha256(f.ends) as ends_sha256
from full_node f join above on above.path = f.path left join node up on f.d > 0 and up.path = f.path[1:f.d - 1]"""


def _url_filter() -> str:
    """The five rules, the six models (accepted and rejected; without fold 0, without fold 1, whole) from the
    shortest to the longest context, the calibrated threshold and the verdicts."""
    cols = [f"{c}_{m}" for c in "ar" for m in ("0", "1", "all")]
    each = lambda form: ", ".join(form.format(c=c) for c in cols)
    rules = [("com", "/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("example.com", "/en/", "block"),
             ("www.example.com", "/en/", "allow")]
    pick = lambda v: "case " + " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{(h + p, w)[v]}'" for h, p, w in rules[::-1]) + " end"
    inside = lambda v, m: f"verdict = '{v}'" + ("" if m == "all" else f" and fold <> {m}")
    count = ", ".join(f"sum(case when {inside(v, m)} then n else 0 end) as {c}_{m}"
                      for c, v in (("a", "allow"), ("r", "block")) for m in ("0", "1", "all"))
    parts = [
        "rest as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages)",
        "row_ as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, "
        "regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)",
        f"url_ as (select host, path, count(*) as n, {pick(0)} as rule, {pick(1)} as verdict, ascii(md5(host)) % 2 as fold "
        "from row_ group by host, path)",
        "gram_ as (select host, path, n, verdict, fold, substr(chr(2) || chr(2) || chr(2) || chr(2) || host || path, i, 5) as gram from ("
        "select *, unnest(range(1, length(host || path) + 1)) as i from url_))",
        f"l4 as (select gram, {count} from gram_ group by gram)"]
    for k in range(3, -1, -1):
        parts.append(f"l{k} as (select substr(gram, 2, {k + 1}) as gram, {each('sum({c}) as {c}')} from l{k + 1} group by 1)")
    for k in range(5):
        parts.append(f"s{k} as (select substr(gram, 1, {k}) as context, {each('sum({c}) as n_{c}')}, "
                     f"{each('count(*) filter ({c} > 0) as t_{c}')} from l{k} group by 1)")
        short = "cast(1.0 as double) / 256" if k == 0 else "b.p_{c}"
        mixed = ", ".join("case when n_{c} = 0 then {s} else (cast({c} as double) + cast(t_{c} as double) * {s}) / cast(n_{c} + t_{c} as double) end as p_{c}".format(
            c=c, s=short.format(c=c)) for c in cols)
        met = "" if k == 0 else f" join p{k - 1} b on b.gram = substr(a.gram, 2, {k})"
        parts.append(f"p{k} as (select a.gram, {mixed} from l{k} a join s{k} s on s.context = substr(a.gram, 1, {k}){met})")
    ratio = ", ".join(f"cast(round((ln(p_a_{m}) - ln(p_r_{m})) * 1000000) as bigint) as x_{m}" for m in ("0", "1", "all"))
    parts += [
        f"ratio as (select gram, {ratio} from p4)",
        "score as (select host, path, any_value(n) as n, any_value(verdict) as verdict, "
        "cast(floor(cast(sum(case when verdict is null then x_all when fold = 0 then x_0 else x_1 end) as double) / count(*)) as bigint) as score "
        "from gram_ join ratio using (gram) group by host, path)",
        "known as (select cast(least(greatest(floor(score / 10000.0), -601), 600) as bigint) as c, n, verdict from score where verdict is not null)",
        "total as (select coalesce(sum(n) filter (verdict = 'allow'), 0) as good, coalesce(sum(n) filter (verdict = 'block'), 0) as bad from known)",
        "cut as (select c, coalesce((select sum(n) from known where verdict = 'allow' and known.c < t.c), 0) as lost, "
        "coalesce((select sum(n) from known where verdict = 'block' and known.c >= t.c), 0) as kept from (select unnest(range(-600, 601)) as c) t)",
        "least_ as (select case when good = 0 or bad = 0 then 0 else 10000 * (select c from cut order by lost * bad + kept * good, abs(c), c limit 1) "
        "end as least from total)"]
    return "with " + ",\n".join(parts) + """
select row_.page_id, row_.host, row_.path, url_.rule, coalesce(url_.verdict, case when coalesce(score.score, 0) >= least then 'allow' else 'block' end) as verdict,
  case when url_.rule is null then coalesce(score.score, 0) / 1000000.0 end as score
from row_ join url_ on url_.host = row_.host and url_.path = row_.path left join score on score.host = row_.host and score.path = row_.path cross join least_"""


URL_FILTER = _url_filter()

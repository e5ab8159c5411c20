"""SQL that gives the rows of the opN_ queries where SQL can express them."""

from __future__ import annotations

from . import quality, secrets

#: Words of a text; \\x20 and \\x09-\\x0D separate.
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_UUID = "'<urn:uuid:' || substr(lpad(hex({0}), 16, '0'), 1, 8) || '-' || substr(lpad(hex({0}), 16, '0'), 9, 4) || '-8000-8000-00000000' || substr(lpad(hex({0}), 16, '0'), 13, 4) || '>'"
OP3 = f"""with p as (select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, chr(13) || chr(10) as e from pages),
l as (select html, max(page_id) as last from p group by 1),
r as (select p.*, sha1(p.html) as d, n >= 1000 and page_id <> last as again, last from p join l on p.html = l.html),
h as (select *, 'HTTP/1.1 200 OK' || e || 'Content-Type: text/html; charset=UTF-8' || e || 'Content-Length: ' || n || e || e as http from r)
select page_id, n::bigint as payload_bytes, d as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then last end as refers_to,
 sha1('WARC/1.1' || e || 'WARC-Type: ' || case when again then 'revisit' else 'response' end || e || 'WARC-Record-ID: ' || {_UUID.format("page_id")} || e || 'WARC-Date: 2026-01-01T00:00:00Z' || e
  || coalesce('WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', '%0A', 'g') || e, '') || 'WARC-Payload-Digest: sha1:' || d || e
  || case when again then 'WARC-Refers-To: ' || {_UUID.format("last")} || e || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e else '' end
  || 'Content-Type: application/http;msgtype=response' || e || 'Content-Length: ' || (length(http) + case when again then 0 else n end) || e || e || http || case when again then '' else html end || e || e) as record_sha1 from h"""


def _kind(name: str, pattern: str, group: int, least: int) -> str:
    """Table of (doc_id, kind, rank, start, end) of one rule's matches: what lies between them gives the places."""
    p = pattern.replace("'", "''")
    rank = secrets.KINDS.index(name)
    return f"""select doc_id, {rank} as rank, a as s, a + len(m[i]) as e from (select doc_id, m, g, unnest(range(1, len(m) + 1)) as i,
 coalesce(list_sum(list_transform(b[1:unnest(range(1, len(m) + 1))], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m[1:unnest(range(1, len(m) + 1)) - 1], lambda x: length(x))), 0)::bigint as a
 from (select doc_id, regexp_extract_all(t, '{p}') as m, regexp_extract_all(t, '{p}', {group}) as g, string_split_regex(t, '{p}') as b from d) where len(m) > 0) where length(g[i]) >= {least}"""


def op5() -> str:
    rules = [*secrets.BASE, *[(n, p, 0, 1) for n, p, _ in secrets.ADDED]]
    found = "\n union all ".join(_kind(*r) for r in rules)
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    spell = f"[{names}][rank + 1] || ':' || s || ':' || e"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), f as ({found})
select d.doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access, count(*) filter (where rank = 2) as n_hex,
 sha256(coalesce(string_agg({spell}, ',' order by s, rank) filter (where rank < 3), '')) as base_sha256, coalesce(string_agg({spell}, ',' order by s, rank, e), '') as spans, any_value(scan)::int as scan
 from (select *, 1 + min(doc_id % 2) over (partition by t) as scan from d) d left join f on d.doc_id = f.doc_id group by 1"""


def op8() -> str:
    ends = ", ".join("'" + m.replace("'", "''") + "'" for m in quality.END_MARKS)
    phrase = r"\b(?:" + "|".join(quality.BOILERPLATE) + r")s?\b"
    said = f"(length(l) <= {quality.SHORT_LINE} and {quality.LEAST_SHARE} * list_sum(list_transform(regexp_extract_all(lower(l), '{phrase}'), lambda v: length(v))) >= length(l))"
    count = lambda text, chars: f"(length({text}) - length(regexp_replace({text}, '[{chars.replace('|', chr(92) + '|')}]', '', 'g')))"
    return rf"""with d as (select doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w, string_split(coalesce(text, ''), chr(10)) as ls from documents),
e as (select doc_id, t, w, list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
x as (select doc_id, i, w[i:i+7] as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from e)),
r as (select doc_id, count(distinct i + j) as n from (select doc_id, i from x qualify count(*) over (partition by doc_id, k) > 1), range(8) t(j) group by 1),
g as (select doc_id, sum(length(l))::bigint as lost from (select doc_id, unnest(ls) as l from e)
 where not (right(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), 1) in ({ends}) or regexp_matches(l, '{quality.INNER_END}')) or 10 * {count("l", quality.SYMBOLS)} > length(l) or {count("l", quality.SEPARATORS)} >= 2 or 12 * {count("l", "!")} > length(l) or coalesce({said}, false) group by 1),
q as (select e.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::bigint as word_chars, {count("t", quality.SYMBOLS)}::bigint as n_symbols,
 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(lost, 0) as lost, length(t) as chars from e left join r on e.doc_id = r.doc_id left join g on e.doc_id = g.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
 not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * lost <= {quality.MAX_LOST_PERCENT} * chars as kept from q"""


OP1 = rf"""with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
x as (select doc_id, i, w[i:i+12] as k from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
f as (select k, min(doc_id) as first from x group by 1),
gone as (select distinct doc_id, i + j as p from (select x.doc_id, i from x join f on x.k = f.k where first < x.doc_id), range(13) t(j)),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
kept as (select p.doc_id, string_agg(p.w[p.i], ' ' order by p.i) as text, count(*) as n from p anti join gone on p.doc_id = gone.doc_id and p.i = gone.p group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256 from d left join kept on d.doc_id = kept.doc_id"""

OP7 = rf"""with recursive d as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, case when len(w) >= 5 then w[i:i+4] else w end as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as c from s group by 1),
o as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 75 * (a.c + b.c - i)),
e as (select x, y from l union all select y, x from l),
r(doc_id, c) as (select doc_id, doc_id from d union select e.y, r.c from r join e on e.x = r.doc_id)
select r.doc_id, coalesce(max(n.c), 0)::bigint as n_shingles, min(r.c) as component_id from r left join n on n.doc_id = r.doc_id group by 1"""

OP11 = r"""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, ls[i] as x, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
f as (select k, max(doc_id) as last from (select distinct doc_id, k from l where length(k) >= 20) group by 1 having count(*) >= 3),
j as (select l.doc_id, i, x, last is not null and l.doc_id < last as gone from l left join f on l.k = f.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(x, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from j group by 1"""

OP12 = r"""with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select r, lang, generate_subscripts(ps, 1) as i, unnest(ps) as p from (select r, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') as ps from d)),
w as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, k, array_to_string(ws[i:i+k-1], ' ') as x, ws[i:i+k-1] as v, count(*) as f from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, 4) t(k)) group by 1, 2, 3, 4),
n as (select lang, sum(f)::bigint as n from g where k = 1 group by 1),
c as (select lang, k, x, v, f as a from g where k > 1 and f >= 10),
u as (select c.lang, c.k, c.x, c.a, j, l.f as l, r.f as r, ((1000000::hugeint * a * a) // (l.f::hugeint * r.f))::bigint as score from (select *, unnest(range(1, k)) as j from c) c
 join g l on l.lang = c.lang and l.x = array_to_string(c.v[1:j], ' ') join g r on r.lang = c.lang and r.x = array_to_string(c.v[j+1:c.k], ' ')),
b as (select * from u qualify row_number() over (partition by lang, x order by score, j) = 1),
gone as (select distinct c.lang, c.x from c join c t on t.lang = c.lang and c.k = 2 and t.k = 3 and (array_to_string(t.v[1:2], ' ') = c.x or array_to_string(t.v[2:3], ' ') = c.x) and 100 * t.a >= 50 * c.a)
select lang, row_number() over (partition by lang order by score desc, a desc, x) as rank, x as phrase, a, l, r, n, score from b anti join gone on b.lang = gone.lang and b.x = gone.x join n using (lang) qualify rank <= 2000"""

OP13 = r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select r, lang, source, unnest(string_split_regex(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term from w where term <> '' group by 1, 2 having count(distinct r) >= 3),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by 1, 2, 3),
v as (select lang, count(*)::hugeint as v from k group by 1),
s as (select lang, source, sum(n)::hugeint as n from c group by 1, 2),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) as p
 from g join k on g.lang = k.lang join v on g.lang = v.lang left join s on s.lang = g.lang and s.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select c.lang, c.term, 1 + (1000000000::hugeint * (sum(c.n) + 1)) // (any_value(t.n) + any_value(v.v)) as q from c join v on c.lang = v.lang join (select lang, sum(n) as n from s group by 1) t on t.lang = c.lang group by 1, 2),
x as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
y as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(x.f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source
 union all select p.lang, source, 'term', p.term, (((p - q) * (p - q)) // q)::bigint from p join q on p.lang = q.lang and p.term = q.term where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from y qualify part = 'pair' or rank <= 200"""

ORACLES = {"op12_collocations": OP12, "op13_source_audit": OP13, "op11_line_dedup": OP11, "op7_jaccard_join": OP7, "op1_substring_dedup": OP1, "op3_warc": OP3, "op5_secret_scan": op5(), "op8_quality_rules": op8()}

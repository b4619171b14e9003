"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from . import licenses, quality, sharding, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
parts as (select rid, string_split(text, chr(10)) as l from docs),
lines as (select rid, i, l[i] as line, translate(trim(l[i], {_SPACES}), '{UPPER}', '{LOWER}') as k from (select rid, l, unnest(range(1, len(l) + 1)) as i from parts)),
hot as (select k from lines where length(k) >= 1 group by k having count(distinct rid) >= 10),
marked as (select rid, i, line, k in (select k from hot) as gone from lines),
kept as (select rid, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as text from marked group by rid)
select doc_id, n_lines, n_dropped, sha256(kept.text) as kept_sha256 from docs join kept using (rid)"""


def quality_sql(spread: float = 8.0, prior: int = 100) -> str:
    p = quality.P
    measures = {m: e.replace(p, "") for m, e in quality.MEASURES.items()}
    values = " union all ".join(f"select lang, source, '{m}' as measure, ({e})::DOUBLE as v from counted where not base_failed" for m, e in measures.items())

    def fences(name: str, group: str) -> str:
        by = f"{group}, " if group else ""
        return f"""{name}_r as (select {by}measure, bucket, sum(n) over (partition by {by}measure) as total, sum(n) over (partition by {by}measure order by bucket) as below from (select {by}measure, bucket, count(*) as n from sketched group by {by}measure, bucket)),
{name} as (select {by}measure, max(total) as total, min(bucket) filter (below >= 0.5 * total) as b2, min(bucket) filter (below >= 0.75 * total) as b3 from {name}_r group by {by}measure)"""

    drawn = lambda x, q, to: f"(({x}.total::DOUBLE * {x}.total * {x}.{q}::DOUBLE + {prior**2}::DOUBLE * {to}) / ({x}.total::DOUBLE * {x}.total + {prior**2}::DOUBLE))"
    b2, b3 = (drawn("o", q, drawn("l", q, f"a.{q}::DOUBLE")) for q in ("b2", "b3"))
    within = " and ".join(f"coalesce({e} <= max(f.fence) filter (f.measure = '{m}'), true)" for m, e in measures.items())
    return f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, lang, source from documents),
words as (select rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs),
wins as (select rid, i, count(*) over (partition by rid, w[i:i + 4]) as n from (select rid, w, unnest(range(1, len(w) - 3)) as i from words)),
reps as (select rid, count(distinct i + j) as n_repeat_words from wins, range(0, 5) r(j) where n > 1 group by rid),
lines as (select rid, unnest(string_split(text, chr(10))) as line from docs),
dups as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid),
base as (select d.rid, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals, length(text) - length(regexp_replace(text, '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g')) as n_marks, coalesce(n_lines, 0) as n_lines,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from docs d join words using (rid) left join reps using (rid) left join dups using (rid)),
counted as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from base),
valued as ({values}),
sketched as (select *, ceil(ln(v) / ln({quality.GAMMA}::DOUBLE))::INT as bucket from valued where v > 0),
{fences('own', 'lang, source')}, {fences('ofl', 'lang')}, {fences('ofa', '')},
fences as (select o.lang, o.source, o.measure, pow({quality.GAMMA}::DOUBLE, {b3} + {spread}::DOUBLE * greatest({b3} - {b2}, 1::DOUBLE)) as fence
    from own o join ofl l on o.lang is not distinct from l.lang and o.measure = l.measure join ofa a on a.measure = o.measure)
select doc_id, n_words::BIGINT as n_words, word_chars::BIGINT as word_chars, n_symbols::BIGINT as n_symbols, n_dup_lines::BIGINT as n_dup_lines, n_repeat_words::BIGINT as n_repeat_words, base_failed,
    not base_failed and {within} as kept
from counted c left join fences f on c.lang is not distinct from f.lang and c.source is not distinct from f.source
group by c.rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_marks, n_lines, base_failed"""


def licenses_sql(threshold: float = 0.8) -> str:
    """Every block against every template."""
    phrases = " union all ".join(f"select '{label}' as label, {len(p.split())} as k, [{', '.join(repr(w) for w in p.split())}] as p" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in found)}])" for label, found in licenses.template_sets())
    n = licenses.STRIDE
    return f"""with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
phrases as ({phrases}),
places as (select rid, i - 1 as place, label from (select rid, w, unnest(range(1, len(w) + 1)) as i from docs), phrases where w[i:i + k - 1] = p),
base as (select rid, count(*) as n_base, min(place) as first_word, max(place) as last_word, list(distinct label) as labels from places group by rid),
templates(label, t) as (values {templates}),
blocks as (select rid, list_distinct(w[b * {n} + 1:b * {n} + {2 * n}]) as held from (select rid, w, unnest(range(0, (len(w) + {n - 1}) // {n})) as b from docs)),
parts as (select rid, label, len(list_intersect(held, t)) / len(t)::DOUBLE as part, len(list_intersect(held, t)) >= ceil(round({threshold}::DOUBLE * len(t), 9)) as meets from blocks, templates),
more as (select rid, list(distinct label) as labels, max(part) as part from parts where meets group by rid)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word::BIGINT as first_word, last_word::BIGINT as last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') as labels, case when n_base > 0 then 1::DOUBLE else coalesce(part, 0::DOUBLE) end as score
from docs left join base using (rid) left join more using (rid)"""


#: The 256 steps of CRC-32 as a one-row table.
CRC_STEPS = "(select list(list_reduce([i] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as steps from range(256) r(i))"


def _crc32(hex_: str) -> str:
    """CRC-32 of bytes given in hexadecimal, by the column ``steps``."""
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all({hex_}, '..'), lambda p: ('0x' || p)::BIGINT)), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


def shards_sql(n: int = 16) -> str:
    """Equal-depth cells of language and source and the cell of the size, along the Hilbert curve, cut into runs of equal counts."""
    cells = ", ".join(f"""{c}_c as (select v, floor((upto - n) * {1 << sharding.BITS} / total)::BIGINT as cell from (select v, n, sum(n) over (order by v nulls first) as upto, sum(n) over () as total from (select {c} as v, count(*) as n from documents group by {c})))""" for c in ("lang", "source"))
    sizes = " + ".join(f"(size >= {x})::INT" for x in sharding.SIZE_STEPS)
    sql, known = f"(select d.*, l.cell as c0, s.cell as c1, {sizes} as c2 from docs d join lang_c l on l.v is not distinct from d.lang join source_c s on s.v is not distinct from d.source)", set()
    for step in sharding.hilbert_steps(["c0", "c1", "c2"], sharding.BITS):
        new = ", ".join(f"{e} as {k}" for k, e in step.items() if k not in known)
        old = ", ".join(f"{e} as {k}" for k, e in step.items() if k in known)
        sql, known = f"(select *{f' replace ({old})' if old else ''}{', ' + new if new else ''} from {sql})", known | set(step)
    return f"""with docs as (select doc_id, lang, source, coalesce(octet_length(encode(text)), 0) + 1 as size, {_crc32("hex(encode(coalesce(text, '')))")} as crc from documents, {CRC_STEPS}), {cells},
ranked as (select *, row_number() over (order by h, crc, size, doc_id) - 1 as r, count(*) over () as total from {sql}),
cut as (select *, (r * {n}) // total as shard from ranked)
select doc_id, size::BIGINT as size, crc::BIGINT as text_crc32, 'rows' as law, shard::INT as shard, (r - (shard * total + {n - 1}) // {n})::BIGINT as slot, null::INT as grown_shard, h as hilbert from cut"""


def revisits_sql() -> str:
    """The captures that the query makes of pages, and the latest earlier response by an as-of join."""
    tracking = ", ".join(f"'{t}'" for t in warc.TRACKING)
    return f"""with bare as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as b from pages),
parts as (select *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^(www|m)\\.', ''), ':(80|443)$', '') as host, regexp_extract(b, '^[^/?]*([^?]*)', 1) as path,
    list_sort(list_filter(string_split(regexp_extract(b, '\\?(.*)$', 1), '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({tracking}))) as args from bare),
caps as (select page_id, 1700000000 + page_id * 60 as t, '"' || md5(coalesce(html, '')) || '"' as etag, html, page_id % 5 as k,
    host || case when path = '/' then '' else regexp_replace(path, '/$', '') end || case when len(args) > 0 then '?' || array_to_string(args, '&') else '' end as url_key from parts),
found as (select v.page_id, v.t + 7200 as again, v.k, v.url_key, v.etag as own, r.page_id as source, r.t as source_t, r.etag, r.html from caps v left join lateral
    (select * from caps r where r.url_key = v.url_key and r.t < v.t + 7200 order by r.t desc, 'r' || r.page_id desc limit 1) r on true),
judged as (select *, case when source is null then 'orphan' when k = 1 then 'unchecked' when k = 2 then case when 1700000000 + page_id * 60 = source_t then 'resolved' else 'changed' end
    when k = 0 then 'changed' when own = etag then 'resolved' else 'changed' end as status from found),
kept as (select *, status in ('resolved', 'unchecked') as takes from judged)
select 'v' || page_id as record_id, url_key, again as captured_at, status, case when takes then 'r' || source end as source_id,
    case when takes then 'cache-control=max-age=60; content-type=text/html; date=' || again || '; etag=' || case when k in (1, 2) then etag else 'W/' || own end || '; last-modified=' || (source_t - 3600) end as headers,
    case when takes then octet_length(encode(html)) end as body_bytes, case when takes then md5(html) end as body_md5 from kept"""


RANKED = f"""with docs as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
items as (select row_number() over () as qid, item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from benchmark),
asked as (select qid, item_id, t, count(*) as c from (select qid, item_id, unnest(w) as t from items) group by qid, item_id, t),
size_ as (select count(*) as nn, sum(len(w))::BIGINT as ll from docs where len(w) > 0),
tfs as (select rid, doc_id, n, t, count(*) as tf from (select rid, doc_id, len(w) as n, unnest(w) as t from docs) where t in (select t from asked) group by rid, doc_id, n, t),
dfs as (select t, count(*) as df from tfs group by t),
weights as (select t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT as w from dfs, size_),
parts as (select qid, item_id, rid, doc_id, c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) as s from asked join weights using (t) join tfs using (t), size_),
scores as (select qid, item_id, rid, doc_id, sum(s)::BIGINT as score from parts group by qid, item_id, rid, doc_id)
select item_id, rank::INT as rank, doc_id, score from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scores where score > 0) where rank <= 10"""


def manifest_sql(levels: int = 7, fan: int = 8) -> str:
    """The tree level by level, for at most ``fan`` to the power ``levels`` rows of a group and as many groups. A tree of one node stays as it is."""

    def field(text: str = "text") -> str:
        one = lambda s: f"coalesce(octet_length(encode({s})) || ':' || {s}, '-')"
        return "sha256(" + " || ".join(one(f) for f in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [f"""rows_ as (select doc_id, lang, {field()} as leaf, case when {_crc32("hex(encode(doc_id::varchar))")} % 3 = 0 then {field(lower)} else {field()} end as given from documents, {CRC_STEPS})""",
        "trees as (select *, row_number() over (order by lang nulls first) - 1 as tree from (select distinct lang from rows_))",
        "n0 as (select r.*, t.tree as g, row_number() over (partition by t.tree order by doc_id nulls first, leaf, given) - 1 as pos, '' as proof, leaf as node, given as fold from rows_ r join trees t on t.lang is not distinct from r.lang)"]

    def climb(name: str, before: str, of: str) -> None:
        """From each leaf's node and place to its parent's; ``of`` is the tree that a leaf climbs in."""
        ctes.append(f"{name}_d as (select distinct {of} as tr, pos, node from {before})")
        ctes.append(f"{name}_r as (select tr, pos // {fan} as up, list(node order by pos) as kids, max(count(*)) over (partition by tr) as most, count(*) over (partition by tr) as runs from {name}_d group by tr, pos // {fan})")
        ctes.append(f"""{name} as (select b.* exclude (pos, proof, node, fold), case when stays then pos else up end as pos, case when stays then proof else proof || array_to_string(list_concat(kids[1:ix], kids[ix + 2:len(kids)]), '') end as proof,
            case when stays then node else sha256(array_to_string(kids, '')) end as node, case when stays then fold else sha256(array_to_string(kids[1:ix], '') || fold || array_to_string(kids[ix + 2:len(kids)], '')) end as fold
            from (select b.*, r.kids, r.up, (b.pos % {fan})::INT as ix, most = 1 and runs = 1 as stays from {before} b join {name}_r r on r.tr = {of} and r.up = b.pos // {fan}) b)""".replace("b.* exclude (pos, proof, node, fold)", "doc_id, leaf, g" + (", subroot" if of == "0" else "")))

    for i in range(levels):
        climb(f"n{i + 1}", f"n{i}", "g")
    ctes.append(f"s0 as (select doc_id, leaf, g, node as subroot, g as pos, proof, node, fold from n{levels})")
    for i in range(levels):
        climb(f"s{i + 1}", f"s{i}", "0")
    return "with " + ", ".join(ctes) + f" select doc_id, leaf, subroot, node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = node as verified from s{levels}"


ORACLE_SQL = {"op2_line_dedup": LINE_DEDUP, "op4_quality_rules": quality_sql(), "op5_warc_revisits": revisits_sql(), "op7_license_scan": licenses_sql(), "op9_hilbert_shards": shards_sql(), "op11_ranked_search": RANKED, "op12_merkle_manifest": manifest_sql()}

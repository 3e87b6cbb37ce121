"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from gridmill.llm import disclosure

EXACT_DEDUP = """
    with texts as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id,
           max(doc_id) over (partition by text) as keep_id,
           count(*) over (partition by text) as group_size,
           row_number() over (partition by text order by doc_id desc nulls last) = 1 as kept,
           sha256(text) as text_sha256
    from texts
"""

# All pairs that share an n-gram, without bands.
NEAR_JOIN = r"""
    with recursive docs as (select doc_id, coalesce(text, '') as text from documents),
    classes as (
        select row_number() over (order by text) as c, text, min(doc_id) as first_doc, count(*) as copies,
               regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as words
        from docs group by text),
    sets as (
        select c, list_distinct([array_to_string(words[i : i + 4], ' ')
                                 for i in range(1, greatest(len(words) - 4, 1) + 1)]) as g
        from classes where len(words) > 0),
    grams as (select c, unnest(g) as gram from sets),
    shared as (
        select a.c as a, b.c as b, count(*) as n
        from grams a join grams b on a.gram = b.gram and a.c < b.c group by 1, 2),
    near as (
        select a, b from shared join sets x on x.c = a join sets y on y.c = b
        where n >= 0.8 * (len(x.g) + len(y.g) - n)),
    links as (select a, b from near union all select b, a from near),
    reach as (select c, c as r from classes union select reach.c, b from reach join links on a = r),
    groups as (
        select reach.c, min(classes.first_doc) as class_id
        from reach join classes on classes.c = r group by 1),
    degree as (select a as c, count(*) as n_links from links group by 1)
    select doc_id, class_id, coalesce(n_links, 0) as n_links, first_doc as text_class, copies,
           cast(coalesce(len(g), 0) as int) as n_grams
    from docs join classes using (text) join groups using (c)
         left join degree using (c) left join sets using (c)
"""


def _spans(kind: str, pattern: str, valid: str) -> str:
    """Places from what was matched and what lies between. ``m`` is a match, ``d`` its digits."""
    return f"""
    {kind}_parts as (
        select row, regexp_extract_all(text, '{pattern}') as found,
               string_split_regex(text, '{pattern}') as gaps from docs),
    {kind}_all as (
        select row, i, found[i] as m, regexp_replace(found[i], '[^0-9]', '', 'g') as d,
               cast(list_sum([length(x) for x in gaps[1 : i]])
                    + coalesce(list_sum([length(x) for x in found[1 : i - 1]]), 0) as int) as start
        from (select *, unnest(range(1, len(found) + 1)) as i from {kind}_parts)),
    {kind}_spans as (
        select row, '{kind}' as kind, start, cast(start + length(m) as int) as stop,
               '{kind}:' || {"d" if kind in ("card", "phone") else "lower(m)"} as entity
        from {kind}_all where {valid})"""


_LUHN = """length(d) between 13 and 19 and list_sum([
        case when i % 2 = 0 then cast(d[length(d) - i] as int)
             when cast(d[length(d) - i] as int) > 4 then cast(d[length(d) - i] as int) * 2 - 9
             else cast(d[length(d) - i] as int) * 2 end
        for i in range(0, length(d))]) % 10 = 0"""
_IP = """len([p for p in string_split(m, '.') if length(ltrim(p, '0')) > 3
             or coalesce(try_cast(ltrim(p, '0') as int), 0) > 255]) = 0"""

PERSONAL_DATA = rf"""
    with docs as (
        select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
    {_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")},
    {_spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", _IP)},
    {_spans("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN)},
    {_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15")},
    spans as (
        select 1 as place, * from email_spans union all select 2, * from ip_spans
        union all select 3, * from card_spans union all select 4, * from phone_spans),
    sides as (
        select row, entity, greatest(0, start - {disclosure.WINDOW}) as origin,
               substring(text, greatest(0, start - {disclosure.WINDOW}) + 1,
                         start - greatest(0, start - {disclosure.WINDOW})) as part,
               start > {disclosure.WINDOW} as cut_left, false as cut_right
        from spans join docs using (row)
        union all
        select row, entity, stop, substring(text, stop + 1, {disclosure.WINDOW}), false,
               length(text) > stop + {disclosure.WINDOW}
        from spans join docs using (row)),
    words as (
        select *, regexp_extract_all(part, '[\p{{L}}\p{{N}}_]+') as found,
               string_split_regex(part, '[\p{{L}}\p{{N}}_]+') as gaps from sides),
    placed as (
        select row, entity, part, cut_left, cut_right, origin, found[i] as word,
               cast(list_sum([length(x) for x in gaps[1 : i]])
                    + coalesce(list_sum([length(x) for x in found[1 : i - 1]]), 0) as int) as first
        from (select *, unnest(range(1, len(found) + 1)) as i from words)),
    mentions as (
        select row, entity, part, lower(word) as term, origin + first as start, origin + first + length(word) as stop
        from placed
        where not (cut_left and first = 0) and not (cut_right and first + length(word) = length(part))
          and length(word) >= {disclosure.TERM_LENGTH}
          and not exists (select 1 from spans s where s.row = placed.row
                          and s.start < origin + first + length(word) and s.stop > origin + first)),
    pairs as (
        select entity, term, count(distinct row) as together from mentions group by 1, 2
        having count(distinct part) >= {disclosure.SUPPORT}),
    with_term as (
        select term, count(*) as with_term
        from (select unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) as term from docs)
        group by 1),
    with_entity as (select entity, count(distinct row) as with_entity from spans group by 1),
    measured as (
        select entity, term, together, with_term, with_entity, (select count(*) from docs) as n
        from pairs join with_term using (term) join with_entity using (entity)),
    disclosing as (
        select entity, term from measured
        where case when n > with_entity
                   then ln(together * n / (with_term * with_entity)) / ln(n / with_entity)
                   else 0 end >= {disclosure.GENERALISE}),
    terms as (
        select distinct 5 as place, row, 'term' as kind, start, stop
        from mentions join disclosing using (entity, term)),
    listed as (
        select place, row, kind || ':' || start || ':' || stop as span, start from spans
        union all select place, row, kind || ':' || start || ':' || stop, start from terms),
    joined as (
        select row, count(*) filter (where place = 1) as n_email, count(*) filter (where place = 2) as n_ip,
               count(*) filter (where place = 3) as n_card, count(*) filter (where place = 4) as n_phone,
               count(*) filter (where place = 5) as n_terms,
               string_agg(span, ',' order by place, start) filter (where place < 5) as base,
               string_agg(span, ',' order by place, start) as spans
        from listed group by 1)
    select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip,
           coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
           coalesce(n_terms, 0) as n_terms
    from docs left join joined using (row)
"""

FILTER_AUDIT = r"""
    with docs as (
        select row_number() over () as row, doc_id, coalesce(source, '') as part, coalesce(text, '') as text
        from documents),
    words as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from docs),
    marks as (
        select doc_id, max(case when quality = 1 then 1 else 0 end) as good,
               max(case when toxic = 1 then 1 else 0 end) as toxic
        from labels where doc_id is not null group by 1),
    judged as (
        select row, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
               {'A': len(words) < 50,
                'B': 100 * len(list_distinct(words)) < 65 * len(words),
                'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
                'D': regexp_matches(text, '[#$%&*|]'),
                'E': coalesce(doc_id > min(doc_id) over (partition by text), false)} as f
        from words left join marks using (doc_id)),
    failed as (
        select row, part, good, toxic,
               (case when f.A then 'A' else '' end) || (case when f.B then 'B' else '' end)
               || (case when f.C then 'C' else '' end) || (case when f.D then 'D' else '' end)
               || (case when f.E then 'E' else '' end) as fails
        from judged),
    sets as (
        select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by 1, 2),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
    orders as (
        select a.l || b.l || c.l || d.l || e.l as filter_order
        from letters a, letters b, letters c, letters d, letters e
        where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    steps as (
        select filter_order, step, filter_order[step] as own, filter_order[1 : step - 1] as earlier
        from orders, (select unnest(range(1, 6)) as step)),
    placed as (
        select part, filter_order, step, own, fails, n, good, toxic, contains(fails, own) as mine,
               length(translate(fails, earlier, '')) < length(fails) as gone
        from sets, steps),
    each as (
        select part, filter_order, cast(step as int) as step, own,
               sum(case when not mine and not gone then n else 0 end) as kept,
               sum(case when mine and not gone then n else 0 end) as removed,
               sum(case when mine and gone then n else 0 end) as redundant,
               sum(case when fails = own then n else 0 end) as unique_fails,
               sum(case when mine and not gone then good else 0 end) as good_lost,
               sum(case when mine and not gone then toxic else 0 end) as toxic_lost
        from placed group by 1, 2, 3, 4)
    select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
           cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
           cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
           cast(sum(removed) over (partition by part, own) as bigint) as shapley
    from each
"""

_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
DIVERGENCE = rf"""
    with docs as (
        select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
        from documents),
    found as (select row, lang, source, unnest(regexp_extract_all(text, '{_TERM}')) as term from docs),
    kept as (select lang, term, count(*) as n from found group by 1, 2 having count(distinct row) >= 3),
    sizes as (select lang, count(*) as v, sum(n) as n from kept group by 1),
    groups as (select distinct lang, source from docs),
    counts as (select lang, source, term, count(*) as n from found group by 1, 2, 3),
    grid as (
        select g.lang, g.source, k.term, coalesce(c.n, 0) as n
        from groups g join kept k using (lang)
             left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
    totals as (select lang, source, sum(n) as total from grid group by 1, 2),
    p as (
        select lang, source, term, grid.n,
               1 + (cast(1000000000 as hugeint) * (grid.n + 1)) // (cast(total as hugeint) + v) as p
        from grid join totals using (lang, source) join sizes using (lang)),
    q as (
        select lang, term, 1 + (cast(1000000000 as hugeint) * (kept.n + 1)) // (cast(sizes.n as hugeint) + v) as q
        from kept join sizes using (lang)),
    sums as (
        select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
        from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    pairs as (
        select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
             left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source),
    terms as (
        select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value
        from p join q using (lang, term) where n > 0 and p > q),
    ranked as (
        select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
        from (select * from pairs union all select * from terms))
    select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank
    from ranked where part = 'pair' or rank <= 200
"""

SUBSTRING_DEDUP = r"""
    with docs as (
        select row_number() over () as row, doc_id,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
    places as (select row, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from docs),
    windows as (
        select row, i, array_to_string(words[i : i + 34], ' ') as w
        from (select row, words, unnest(range(1, len(words) - 33)) as i from docs)),
    repeated as (select row, i from (select row, i, count(*) over (partition by w) as n from windows) where n > 1),
    covered as (
        select row, i, word,
               coalesce(max(r.first) over (partition by row order by i) >= i - 34, false) as gone
        from places left join (select row, i, i as first from repeated) r using (row, i)),
    kept as (
        select row, count(*) filter (where gone) as n_removed,
               string_agg(word, ' ' order by i) filter (where not gone) as text
        from covered group by 1)
    select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed,
           sha256(coalesce(text, '')) as kept_sha256
    from docs left join kept using (row)
"""

ORACLES = {
    "op4_exact_dedup": EXACT_DEDUP,
    "op5_personal_data": PERSONAL_DATA,
    "op8_near_join": NEAR_JOIN,
    "op11_substring_dedup": SUBSTRING_DEDUP,
    "op12_divergence": DIVERGENCE,
    "op13_filter_audit": FILTER_AUDIT,
}

"""The catalogue's queries in DuckDB's SQL."""

from __future__ import annotations

from .. import config


def _any(column: str, words: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    return f"len(list_filter([{quoted}], lambda w: contains({column}, w))) > 0"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _collapse(x: str) -> str:
    return rf"regexp_replace({_strip(x)}, '\s+', ' ', 'g')"


def _sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({_strip(x)}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({_strip(x)}, '\s+'), lambda w: w <> '')"


def _tokens(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def _clauses(x: str) -> str:
    tidy = lambda p: f"list_filter(list_transform({p}, lambda q: {_strip('q')}), lambda q: q <> '')"
    mark = "chr(31)"
    conj = "|".join(config.CLAUSE_CONJUNCTIONS)
    ways = [
        tidy(rf"string_split(regexp_replace({x}, '\s+(?:{conj})\s+', {mark}, 'gi'), {mark})"),
        tidy(rf"string_split(regexp_replace({x}, ';\s+', {mark}, 'g'), {mark})"),
        tidy(rf"string_split(regexp_replace({x}, '\s*—\s+', {mark}, 'g'), {mark})"),
        tidy(rf"string_split(regexp_replace({x}, '\s*\(([^)]+)\)', {mark} || '\1' || {mark}, 'g'), {mark})"),
    ]
    cases = " ".join(f"when len({w}) > 1 then {w}" for w in ways)
    return f"case when len({_words(x)}) < 10 then [{x}] {cases} else [{x}] end"


# A unit separator in a text would be taken for one of the marks above: none of the tables has one.

SECTIONS = rf"""
sec0 as (select item_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as toks from benchmark where item_id < 13),
sec1 as (select item_id as ord, 's' || item_id as section_id, substr(text, 1, 40) as title, item_id <> 2 as required, text as description,
                list_filter(toks, lambda x, i: list_position(toks, x) = i)[1:8] as hints from sec0),
sec as (select *, {_tokens("title || ' ' || description || ' ' || array_to_string(hints, ' ')")} as tok,
        {_tokens("title || chr(10) || array_to_string(hints, chr(10))")} as chunk_tok,
        {_tokens("title || '. ' || description || '. Keywords: ' || array_to_string(hints, ' ')")} as line_tok from sec1)
"""
DOC_SENTENCES = f"""
split as (select doc_id as job_id, {_sentences('text')} as p from documents),
sent as (select job_id, i - 1 as sent_idx, s as text, ((job_id * 7 + (i - 1) * 13) % 21) / 20.0::double as audio from split, unnest(p) with ordinality as u(s, i))
"""
TURNS = """
sent as (select conv_id as job_id, turn as sent_idx, text, ((conv_id * 7 + turn * 13) % 21) / 20.0::double as audio from conversations)
"""


def _scored(threshold: float) -> str:
    return rf"""
tok as (select *, {_tokens('text')} as tok from sent),
base as (select t.job_id, t.sent_idx, t.text, t.audio, s.ord, s.section_id, s.title, s.required, s.hints,
                len(list_intersect(t.tok, s.tok)) as common_n, len(t.tok) + len(s.tok) as sizes from tok t cross join sec s),
sim as (select *, case when sizes - common_n = 0 then 0.0::double else common_n::double / (sizes - common_n) end as base from base),
ctx as (select *, coalesce(sum(base) over w, 0) as s, count(*) over w as n from sim
        window w as (partition by job_id, ord order by sent_idx rows between 3 preceding and 3 following exclude current row)),
scored as (select *, case when n = 0 then 0.0::double else s / n end as context,
                  least(0.3::double, len(list_filter(hints, lambda h: contains(lower(text), h))) * 0.05::double) as boost from ctx),
full_score as (select *, 0.7::double * base + 0.3::double * context + boost as combined from scored),
ranked as (select *, row_number() over (partition by job_id, sent_idx order by round(combined, 9) desc, ord) as rn from full_score where {_strip('text')} <> ''),
prim as (select * from ranked where rn = 1),
sec2 as (select r.job_id, r.sent_idx, string_agg(r.section_id, '|' order by r.rn) as secondary from ranked r
         join prim p on r.job_id = p.job_id and r.sent_idx = p.sent_idx
         where r.rn in (2, 3) and (p.combined < {threshold} or r.combined >= 0.6 * {threshold}::double) group by all)
"""


SCORED = _scored(0.10)
EVIDENCE = "[" + ", ".join(f"'{k}'" for k in config.EVIDENCE_KEYWORDS) + "]"
ROUTED = rf"""
flags as (select p.*, {_any('lower(text)', config.IMPLEMENTATION_INDICATORS)} or contains(text, '`') or contains(text, '->') as impl,
                 {_any('lower(title)', config.CONCEPTUAL_SECTIONS)} as conceptual,
                 regexp_matches(lower(text), '{config.CAUSAL_PATTERN}') as causal,
                 list_filter({EVIDENCE}, lambda k: contains(lower(text), k)) as evidence,
                 regexp_matches(lower(text), '{"|".join(config.REFERENTIAL_PATTERNS)}') as refers from prim p),
routed as (select *, case when combined < 0.12 or (impl and conceptual) then 'review' else 'accepted' end as route from flags),
final as (select *, route = 'accepted' and causal and len(evidence) = 0 as is_inferred from routed)
"""
COVERAGE = f"""
every as (select d.job_id, s.ord, s.section_id, s.required from (select distinct doc_id as job_id from documents) d cross join sec s),
counts as (select job_id, section_id, count(distinct lower({_collapse('text')})) as n, round(avg(audio), 9) as c from prim group by all),
cover0 as (select e.*, coalesce(n, 0) as sentence_count, coalesce(c, 0.0::double) as confidence from every e left join counts c on e.job_id = c.job_id and e.section_id = c.section_id),
cover1 as (select *, case when sentence_count = 0 then 'missing' when sentence_count <= 1 then 'weak' else 'covered' end as status from cover0),
cover as (select *, case status when 'missing' then case when required then 1.0::double else 0.5 end when 'weak' then case when required then 0.6 else 0.2 end
                 else case when confidence > 0.7 then 0.0 else 0.1 end end as risk_score from cover1)
"""
PLACED = rf"""
rt as (select *, {_tokens('text')} as toks, max(sent_idx) over (partition by job_id, section_id order by sent_idx rows between unbounded preceding and 1 preceding) as same from final),
ante as (select a.job_id, a.sent_idx, coalesce(any_value(a.same), max(b.sent_idx)) as ante from rt a
         left join rt b on a.same is null and a.job_id = b.job_id and b.sent_idx < a.sent_idx
              and len(list_intersect(a.toks, b.toks)) >= greatest(1, least(5, cast(floor(0.3::double * len(a.toks)) as bigint)))
         where a.refers group by a.job_id, a.sent_idx),
kinds as (select r.*, a.ante, case when r.route = 'review' then 'review' when a.ante is not null then 'reference' else 'placed' end as kind
          from rt r left join ante a on r.job_id = a.job_id and r.sent_idx = a.sent_idx),
firsts as (select *, min(sent_idx) over (partition by job_id, kind, case when kind = 'placed' then section_id end,
                  case when kind = 'placed' then lower({_collapse('text')}) else {_strip('text')} end) as f from kinds),
placed as (select *, case when kind in ('placed', 'review') and f < sent_idx then case kind when 'placed' then 'duplicate' else 'duplicate_review' end else kind end as destination,
                  case when kind in ('placed', 'review') and f < sent_idx then f else ante end as to_idx from firsts)
"""
BUCKETS = " ".join(f"when {_any('lower(title)', w)} or {_any('section_id', w)} then {i}" for i, (_, w) in enumerate(config.FLOW_BUCKETS))
NAMES = "[" + ", ".join(f"'{n}'" for n, _ in config.FLOW_BUCKETS) + "]"
CONTENT = f"""
content as (select job_id, section_id, title, count(*) as sentence_count, sum(cast(round(audio * 1000000) as bigint)) / count(audio) / 1000000 as confidence, min(sent_idx) as appearance,
                   list(text order by sent_idx) as texts from placed where destination = 'placed' group by all),
flow as (select *, case {BUCKETS} end as b0, coalesce(case {BUCKETS} end, {len(config.FLOW_BUCKETS) - 1}) as bucket from content)
"""
CHUNKS = f"""
cw as (select doc_id as job_id, {_words('text')} as w from documents),
chunk as (select job_id, k as chunk_idx, array_to_string(w[k * 120 + 1 : k * 120 + 120], ' ') as chunk from cw, unnest(range(0, cast(ceil(len(w) / 120.0) as bigint))) as u(k))
"""
BEST = rf"""
ct as (select *, {_tokens('chunk')} as tok from chunk),
cs as (select c.job_id, c.chunk_idx, c.chunk, s.ord, s.section_id, len(list_filter(s.hints, lambda h: contains(lower(c.chunk), h))) > 0 as has_hint,
              len(list_intersect(c.tok, s.chunk_tok))::double / nullif(len(c.tok) + len(s.chunk_tok) - len(list_intersect(c.tok, s.chunk_tok)), 0) as score from ct c cross join sec s),
cr as (select *, row_number() over (partition by job_id, chunk_idx order by has_hint desc, round(score, 9) desc, ord) as rn from cs where has_hint or score > 0.04::double),
best as (select * from cr where rn = 1)
"""
ANALYSIS = """
every as (select d.job_id, s.ord, s.section_id, s.required from (select distinct doc_id as job_id from documents) d cross join sec s),
counts as (select job_id, section_id, count(*) as n, max(score) as c from best group by all),
analysis as (select e.*, coalesce(n, 0) as chunk_count, least(1.0, coalesce(c, 0.0::double)) as confidence,
                    case when n is null then 'missing' when n < 2 then 'partial' else 'covered' end as status
             from every e left join counts k on e.job_id = k.job_id and e.section_id = k.section_id)
"""
LINES = rf"""
lines as (select conv_id as job_id, turn as line_id, text from conversations),
parts as (select *, {_clauses('text')} as p from lines),
pu as (select job_id, line_id, text, i as k, c as part, len(p) as n, {_tokens('c')} as tok from parts, unnest(p) with ordinality as u(c, i)),
ps as (select u.*, s.ord, s.section_id, len(list_intersect(u.tok, s.line_tok))::double / nullif(len(u.tok) + len(s.line_tok) - len(list_intersect(u.tok, s.line_tok)), 0) as sim from pu u cross join sec s),
pb as (select * from (select *, row_number() over (partition by job_id, line_id, k order by round(coalesce(sim, 0), 9) desc, ord) as rn from ps) where rn = 1),
pd as (select job_id, line_id, max(n) > 1 and count(distinct section_id) > 1 as is_split from pb group by all),
units0 as (select b.job_id, b.line_id, cast(b.line_id as varchar) || '_clause_' || (k - 1) as unit_id, k - 1 as clause_idx, part as text, true as is_split, text as line, section_id, coalesce(sim, 0) as sim
           from pb b join pd d using (job_id, line_id) where d.is_split),
whole as (select l.job_id, l.line_id, l.text, s.ord, s.section_id, len(list_intersect({_tokens('l.text')}, s.line_tok)) as common_n, len({_tokens('l.text')}) + len(s.line_tok) as sizes
          from lines l join pd d using (job_id, line_id) cross join sec s where not d.is_split),
wb as (select * from (select *, row_number() over (partition by job_id, line_id order by round(common_n::double / (sizes - common_n), 9) desc, ord) as rn from whole) where rn = 1),
units1 as (select * from units0 union all
           select job_id, line_id, cast(line_id as varchar), 0, text, false, text, section_id, common_n::double / (sizes - common_n) from wb),
units as (select job_id, line_id, unit_id, clause_idx, text, is_split, instr(line, text) - 1 as start_char, case when sim >= 0.05 then section_id end as section_id, sim as similarity,
                 case when sim >= 0.05 then greatest(0.0, least(1.0, (sim + 1) / 2)) end as confidence,
                 sim >= 0.05 and row_number() over (partition by job_id, unit_id order by line_id, clause_idx) = 1 as registered from units1)
"""
CONNECTOR = "case " + " ".join(f"when regexp_matches(text, '{p}', 'i') then '{w}'" for p, w in config.CONNECTORS) + f" else '{config.OTHER_CONNECTOR}' end"
PARAGRAPHS = rf"""
pl as (select *, lag(text) over (partition by job_id, section_id order by line_id, clause_idx) as before from units where registered),
pn as (select *, case when before is not null then len(list_intersect({_tokens('text')}, {_tokens('before')}))::double
              / (len({_tokens('text')}) + len({_tokens('before')}) - len(list_intersect({_tokens('text')}, {_tokens('before')}))) end as near from pl),
pj as (select *, case when before is null then text when near < 0.5 then ' ' || {CONNECTOR} || ' ' || text else ' ' || text end as piece from pn),
pt as (select job_id, section_id, string_agg(piece, '' order by line_id, clause_idx) as t, coalesce(avg(near), 1.0) as coherence_score, count(*) as unit_count from pj group by all),
pc as (select *, regexp_replace(list_reduce(list_prepend('', list_transform(string_split_regex(t, '\.[ ]+'), lambda p, i: case when i > 1 then '. ' else '' end ||
              case when i > 1 and regexp_matches(p, '^[a-z]') then upper(p[1]) || p[2:] else p end)), lambda a, b: a || b), ' +', ' ', 'g') as r from pt),
paragraph as (select job_id, section_id, case when r <> '' and right(r, 1) not in ('.', '!', '?') then r || '.' else r end as paragraph, coherence_score, unit_count from pc)
"""
CORRECTIONS = """
corr as (select doc_id as job_id, 0 as sent_idx, 's' || (doc_id % 13) as original_section, 's' || ((doc_id + quality + 1) % 13) as corrected_section, 0.01::double as boost, doc_id as stamp from labels)
"""


def _fix_grammar(x: str) -> str:
    t = _strip(x)
    capital = f"(upper({t}[1]) || {t}[2:])"
    return rf"regexp_replace(case when {capital} <> '' and right({capital}, 1) not in ('.', '!', '?') then {capital} || '.' else {capital} end, '\s+', ' ', 'g')"


def _corrected(x: str) -> str:
    for pattern, good in config.PHRASE_PATTERNS:
        x = f"regexp_replace({x}, '{pattern}', '{good}', 'gi')"
    return x


def _glossary_phrases(x: str) -> str:
    for bad, good in sorted(config.GLOSSARY_PHRASES, key=lambda p: -len(p[0])):
        x = f"regexp_replace({x}, '{bad}', '{good}', 'gi')"
    return x


def _phrase_steps() -> str:
    """A step for each pattern: it is counted, and applied as often as it matched."""
    steps = ["c0 as materialized (select conv_id as job_id, turn as seg_idx, text as original, text as t, cast(0 as bigint) as phrases from conversations)"]
    for i, (pattern, good) in enumerate(config.PHRASE_PATTERNS):
        once = f"regexp_replace(t, '{pattern}', '{good}', 'gi')"
        again = f"list_reduce(list_prepend({once}, list_transform(range(1, n), lambda i: '')), lambda a, b: regexp_replace(a, '{pattern}', '{good}', 'gi'))"
        steps.append(f"n{i} as materialized (select *, len(regexp_extract_all(t, '{pattern}', 0, 'i')) as n from c{i})")
        steps.append(f"c{i + 1} as materialized (select job_id, seg_idx, original, case when n = 0 then t when n = 1 then {once} else {again} end as t, phrases + n as phrases from n{i})")
    return ",\n".join(steps)


WORD_MAP = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in config.WORD_CORRECTIONS) + "}"
ACCURACY = dict(config.MODEL_ACCURACY)["small"]

GLOSSARY_MAP = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in {config.GLOSSARY_TERMS[0].lower(): config.GLOSSARY_TERMS[0], **dict(config.GLOSSARY_ACRONYMS)}.items()) + "}"


def _context_steps() -> str:
    steps, pairs = [], [(trigger, bad, good) for trigger, rules in config.CONTEXT_RULES for bad, good in rules]
    for i, (trigger, bad, good) in enumerate(pairs):
        hit = f"regexp_matches(concat_ws(' ', before, text, after), '{trigger}', 'i') and regexp_matches(text, '{bad}', 'i')"
        steps.append(f"x{i + 1} as materialized (select * exclude (text, contexts), case when {hit} then regexp_replace(text, '{bad}', '{good}', 'gi') else text end as text, contexts + case when {hit} then 1 else 0 end as contexts from x{i})")
    return ",\n".join([*steps, f"corrected as (select * from x{len(pairs)})"])


CORRECTED = rf"""
{_phrase_steps()},
w0 as materialized (select *, list_transform({_words('t')}, lambda x: struct_pack(w := x, bare := regexp_replace(x, '[.,!?;:]+$', ''))) as ws from c{len(config.PHRASE_PATTERNS)}),
x0 as materialized (select job_id, seg_idx, original, phrases, len(list_filter(ws, lambda x: {WORD_MAP}[lower(x.bare)] is not null)) as words, cast(0 as bigint) as contexts,
       {_collapse(f"array_to_string(list_transform(ws, lambda x: coalesce({WORD_MAP}[lower(x.bare)] || substr(x.w, length(x.bare) + 1), x.w)), ' ')")} as text,
       coalesce(lag(original) over (partition by job_id order by seg_idx), '') as before, coalesce(lead(original) over (partition by job_id order by seg_idx), '') as after from w0),
{_context_steps()}
"""
FIELDS = rf"""
fields as (select section_id, 'f' || ord || '_' || k as field_id, {_tokens("array_to_string(hints[k * 4 + 1 : k * 4 + 4], ' ') || ' f' || ord || '_' || k")} as known from sec, unnest([0, 1]) as u(k)),
ft as (select *, {_tokens('chunk')} as own from best),
fc as (select b.job_id, b.chunk_idx, b.chunk, b.section_id, f.field_id, len(list_intersect(b.own, f.known))::double / (len(b.own) + len(f.known) - len(list_intersect(b.own, f.known))) as score from ft b join fields f using (section_id)),
fr as (select *, row_number() over (partition by job_id, section_id, field_id order by round(score, 9) desc, chunk_idx) as place from fc)
"""

ORACLES: dict[str, str] = {
    "sentence_split": f"with {DOC_SENTENCES} select job_id, sent_idx, text from sent",
    "long_sentence_pack": rf"""
with {DOC_SENTENCES},
p0 as (select job_id, sent_idx, text, list_filter(list_transform(string_split(text, ','), lambda q: {_strip('q')}), lambda q: q <> '') as parts from sent),
p1 as (select job_id, sent_idx, case when length(text) <= 240 then [text]
       when len(parts) >= 2 then string_split(list_reduce(parts, lambda a, p: case when length(split_part(a, chr(31), -1)) + length(p) + 2 <= 240 then a || ' ' || p else a || chr(31) || p end), chr(31))
       else list_transform(range(0, cast(ceil(length(text) / 240.0) as bigint)), lambda i: substr(text, i * 240 + 1, 240)) end as parts from p0)
select job_id, sent_idx, i - 1 as part_idx, s as text from p1, unnest(parts) with ordinality as u(s, i)""",
    "segment_align": rf"""
with seg as (select conv_id as job_id, turn as seg_idx, text, turn * 5.0::double as s, turn * 5.0::double + 5 as e, role,
             greatest(0.0, least(1.0, (-((conv_id * 7 + turn * 13) % 21) / 10.0::double + 2) / 2)) as conf,
             coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as a from conversations),
jobs as (select job_id, string_agg(text, ' ' order by seg_idx) as whole from seg group by job_id),
pieces as (select job_id, i, p, sum(length(p)) over (partition by job_id order by i) - length(p) as pos0
           from jobs, unnest(string_split(regexp_replace(whole, '([.!?])(\s+)', '\1' || chr(31) || '\2', 'g'), chr(31))) with ordinality as u(p, i)),
found as (select job_id, i, {_strip('p')} as raw, pos0 + length(p) - length(regexp_replace(p, '^\s+', '')) as a from pieces where {_strip('p')} <> ''),
sent as (select *, a + length(raw) as b from found),
hit as (select s.job_id, s.i, g.* exclude (job_id) from sent s join seg g on s.job_id = g.job_id and g.a < s.b and g.a + length(g.text) > s.a),
facts as (select job_id, i, arg_min(s, seg_idx) as start, arg_max(e, seg_idx) as stop, case when count(distinct role) = 1 then max(role) end as speaker, round(avg(conf), 6) as audio_confidence,
                 string_agg(cast(seg_idx as varchar), '|' order by seg_idx) as segment_ids from hit group by job_id, i),
p0 as (select job_id, i, raw, list_filter(list_transform(string_split(raw, ','), lambda q: {_strip('q')}), lambda q: q <> '') as parts from sent),
p1 as (select job_id, i, case when length(raw) <= 240 then [raw]
       when len(parts) >= 2 then string_split(list_reduce(parts, lambda a, p: case when length(split_part(a, chr(31), -1)) + length(p) + 2 <= 240 then a || ' ' || p else a || chr(31) || p end), chr(31))
       else list_transform(range(0, cast(ceil(length(raw) / 240.0) as bigint)), lambda k: substr(raw, k * 240 + 1, 240)) end as parts from p0),
p2 as (select job_id, i, row_number() over (partition by job_id order by i, k) - 1 as sent_idx, q from p1, unnest(parts) with ordinality as u(q, k))
select job_id, sent_idx, {_collapse('q')} as text, start, stop as "end", speaker, audio_confidence, segment_ids from p2 join facts using (job_id, i)""",
    "chunk_text": f"with {CHUNKS} select job_id, chunk_idx, chunk from chunk",
    "clause_split": f"with {DOC_SENTENCES} select job_id, sent_idx, i - 1 as clause_idx, c as clause from (select *, {_clauses('text')} as p from sent), unnest(p) with ordinality as u(c, i)",
    "url_assets": """
with u as (select page_id as job_id, unnest([regexp_extract(url, 'https?://[^\\s]+'), 'https://grafana.example/d/1']) as content from pages)
select job_id, content, case """.replace("\\\\s", "\\s") + " ".join(f"when regexp_matches(content, '{p}', 'i') then '{n}'" for n, p in config.COMPONENT_PATTERNS) + " end as detected_component from u where content <> ''",
    "text_predicates": rf"""
with {DOC_SENTENCES}
select job_id, sent_idx, regexp_matches(lower(text), '{config.CAUSAL_PATTERN}') as is_causal, {_any('lower(text)', config.PROTECTED_KEYWORDS)} as is_protected,
       regexp_matches(lower(text), '{"|".join(config.REFERENTIAL_PATTERNS)}') as is_referential,
       {_any('lower(text)', config.IMPLEMENTATION_INDICATORS)} or contains(text, '`') or contains(text, '->') as is_implementation,
       coalesce(array_to_string(list_filter({EVIDENCE}, lambda k: contains(lower(text), k)), '|'), '') as evidence from sent""",
    "token_jaccard": f"with {SECTIONS}, {TURNS}, {SCORED} select job_id, sent_idx, ord as section_ord, round(base, 6) as base from sim",
    "context_scores": f"with {SECTIONS}, {TURNS}, {SCORED} select job_id, sent_idx, ord as section_ord, round(context, 6) as context, round(boost, 6) as boost, round(combined, 6) as combined from full_score",
    "classify_topk": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED.partition('prim as')[0].rstrip().rstrip(',')},
best as (select job_id, sent_idx, max(section_id) filter (where rn = 1) as section_id, max(combined) filter (where rn = 1) as first, list(struct_pack(rn := rn, id := section_id, c := combined)) filter (where rn in (2, 3)) as rest
         from ranked where rn <= 3 group by all)
select s.job_id, s.sent_idx, b.section_id, round(b.first, 6) as confidence,
       coalesce(array_to_string(list_transform(list_filter(list_sort(b.rest), lambda x: b.first < 0.10 or x.c >= 0.6 * 0.10::double), lambda x: x.id), '|'), '') as secondary
from sent s left join best b using (job_id, sent_idx)""",
    "policy_route": f"with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED} select job_id, sent_idx, section_id, route, is_inferred from final",
    "explainability_log": f"""with {SECTIONS}, {TURNS}, {SCORED},
log as (select *, row_number() over (partition by job_id order by sent_idx) as place from prim)
select l.job_id, l.sent_idx as sentence_id, l.section_id, round(l.combined, 6) as confidence, coalesce(x.secondary, '') as alternatives
from log l left join sec2 x using (job_id, sent_idx) where place <= 50""",
    "transcript_quality": rf"""
with q as (select doc_id, text, {_sentences('text')} as s, {_words('text')} as w,
           len(list_filter(['kubernetes', 'docker', 'aws', 'jenkins', 'terraform'], lambda t: contains(lower(text), t))) as terms, not regexp_matches(text, '\p{{L}}') as wordless from documents),
f as (select *, len(s) > 0 and len(list_filter(s, lambda x: len({_words('x')}) < 3)) > len(s) * 0.3 as fragments, length(text) < 100 as brief from q),
c as (select *, case when wordless then 0 else greatest(0, 80 - case when brief then 20 else 0 end - case when fragments then 10 else 0 end + case when terms > 0 then 15 else 0 end) end as score from f)
select doc_id, length(text) as total_length, len(w) as word_count,
       array_to_string(list_filter([case when brief then 'transcript_too_short' end, case when wordless then 'no_valid_text' end, case when not wordless and fragments then 'excessive_fragments' end], lambda x: x is not null), '|') as issues,
       cast(score as bigint) as confidence_score,
       case when wordless then null when score > 85 then 'excellent' when score > 70 then 'good' when score > 50 then 'fair' else 'poor' end as status from c""",
    "transcription_accuracy": rf"""
with q as (select doc_id, length(text) as n, len(string_split_regex(text, '[.!?]+')) as parts, length(regexp_replace(text, '[\x20-\x7E]', '', 'g'))::double / greatest(1, length(text)) as special from documents)
select doc_id, round(least(0.99, {ACCURACY}::double * (0.8 + ((case when n > 5000 then 1.0 when n > 2000 then 0.8 when n > 500 then 0.5 else 0.2 end
  + case when parts > 20 then 1.0 when parts > 10 then 0.8 when parts > 5 then 0.5 else 0.2 end)::double + greatest(0.0, 1.0 - special * 5)) / 3 * 0.2)), 6) as accuracy from q""",
    "sentence_quality": f"""
with {DOC_SENTENCES}, q as (select job_id, sent_idx, {_words('text')} as w from sent),
m as (select *, len(w) as n, coalesce(list_sum(list_transform(w, lambda x: length(x)))::double / nullif(len(w), 0), 0.0) as mean from q),
i as (select *, list_filter([case when n < 3 then 'too_short' end, case when n > 100 then 'too_long' end, case when mean > 20 then 'unusual_word_length' end], lambda x: x is not null) as issues from m)
select job_id, sent_idx, cast(greatest(0, 100 - 10 * len(issues)) as bigint) as quality_score, n as word_count, round(mean, 6) as avg_word_length, array_to_string(issues, '|') as issues,
       case when 100 - 10 * len(issues) > 70 then 'acceptable' when 100 - 10 * len(issues) > 40 then 'warning' else 'review_needed' end as status from i""",
    "vector_top3": """
with parts as (select label, i, avg(x::double) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all),
cent as (select label as section, list(m order by i) as v from parts group by label),
s as (select e.vec_id, c.section, list_dot_product(e.embedding::double[], c.v) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(c.v, c.v)) + 1e-9) as sim from embeddings e cross join cent c),
r as (select *, round(sim, 9) as q, row_number() over (partition by vec_id order by round(sim, 9) desc, section) as rn from s)
select vec_id, cast(max(case when rn = 1 then section end) as bigint) as section, round(max(case when rn = 1 then q end), 6) as confidence,
       coalesce(string_agg(cast(section as varchar), '|' order by rn) filter (where rn in (2, 3) and q > 0.52), '') as alternatives, max(case when rn = 1 then q end) < 0.65 as requires_review from r group by vec_id""",
    "section_coverage": f"with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {COVERAGE} select job_id, section_id, required, sentence_count, round(confidence, 6) as confidence, status, risk_score from cover",
    "job_overview": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {COVERAGE}
select job_id, round(avg(case when status <> 'missing' then 1.0::double else 0 end) * 100, 6) as overall_coverage_percent, round(avg(risk_score), 6) as overall_risk_score,
       cast(floor(avg(case when status <> 'missing' then 1.0::double else 0 end) * 100) as integer) as progress,
       coalesce(string_agg(section_id, '|' order by ord) filter (where required and status = 'missing'), '') as missing_required_sections from cover group by job_id""",
    "coverage_endpoint": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {COVERAGE}
select job_id, round(count(*) filter (where status <> 'missing') * 100.0::double / count(*), 6) as coverage_percent, count(*) filter (where required and status = 'missing') as missing_required,
       count(*) filter (where required and status = 'missing') > 0 as requires_attention from cover group by job_id""",
    "sentence_placement": f"with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED} select job_id, sent_idx, destination, to_idx from placed",
    "cross_references": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED}
select p.job_id, p.sent_idx as from_index, p.to_idx as to_index, p.section_id, case p.destination when 'reference' then 'referential_link' else 'duplicate_reference' end as note, p.text as from_sentence, t.text as to_sentence
from placed p left join placed t on p.job_id = t.job_id and p.to_idx = t.sent_idx where p.destination in ('reference', 'duplicate')""",
    "section_content": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED}, {CONTENT}
select job_id, section_id, sentence_count, round(confidence, 6) as confidence, appearance, {NAMES}[bucket + 1] as bucket_name,
       row_number() over (partition by job_id order by bucket, b0 is null, appearance) as position, array_to_string(list_transform(texts[1:5], lambda t: substr(t, 1, 100)), '|') as preview from flow""",
    "flow_coherence": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED}, {CONTENT},
o as (select *, lag(bucket) over (partition by job_id order by appearance) as before from flow)
select job_id, round(avg(case when bucket < before then 0.0::double else 1 end), 6) as flow_coherence_score, count(*) filter (where bucket < before) as issues from o group by job_id""",
    "ordered_markdown": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED}, {CONTENT},
blocks as (select job_id, coalesce(b0, {len(config.FLOW_BUCKETS)}) as g, {NAMES}[bucket + 1] as name, appearance, '### ' || title || chr(10) || array_to_string(list_transform(texts, lambda t: '- ' || t), chr(10)) || chr(10) as block from flow),
groups as (select job_id, g, '## ' || name || chr(10) || string_agg(block, chr(10) order by appearance) as body from blocks group by job_id, g, name)
select job_id, '# KT Report - ' || job_id || chr(10) || chr(10) || string_agg(body, chr(10) order by g) as ordered_markdown from groups group by job_id""",
    "review_list": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED}
select job_id, sent_idx, text from (select *, row_number() over (partition by job_id order by sent_idx) as place from placed where destination = 'review') where place <= 5""",
    "multi_section": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED},
f as (select *, row_number() over (partition by job_id, section_id order by sent_idx) as place from prim)
select job_id, substr(text, 1, 50) as text_key, string_agg(distinct section_id, '|' order by section_id) as sections from f where place <= 3 group by all having count(distinct section_id) > 1""",
    "correct_segments": f"""with {CORRECTED}
select job_id, seg_idx, text, phrases + words + contexts as corrections,
       round(case when original = '' then 0.5::double else greatest(0.0, 1 - 0.5::double * (phrases + words + contexts) / greatest(len({_words('original')}), 1)) end, 6) as confidence from corrected""",
    "correction_stats": f"""with {CORRECTED}
select job_id, count(*) as segments, count(*) filter (where phrases + words + contexts > 0) as segments_corrected, cast(sum(phrases + words + contexts) as bigint) as total_corrections,
       cast(sum(phrases) as bigint) as phrase_corrections, cast(sum(words) as bigint) as word_corrections, cast(sum(contexts) as bigint) as context_corrections from corrected group by job_id""",
    "glossary_warnings": rf"""
with t as (select conv_id as job_id, turn as sent_idx, regexp_extract_all(lower('The API near a customer. ' || text), '[\p{{L}}\p{{N}}_]+') as toks from conversations),
w as (select *, list_transform(toks, lambda x, i: case when x in ('api', 'the') then
        'Glossary term ' || chr(39) || case x when 'api' then 'API' else 'The' end || chr(39) || ' appears near ambiguous word ' || chr(39) ||
        list_filter([{', '.join(f"'{a}'" for a in config.AMBIGUOUS_NEARBY)}], lambda a: list_contains(toks[greatest(i - 3, 1) : i + 3], a))[1] || chr(39) end) as said from t),
f as (select *, list_filter(said, lambda x: x is not null) as found from w)
select job_id, sent_idx, coalesce(array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), '|'), '') as warnings from f""",
    "repair_text": rf"""
with {TURNS},
g as (select *, text <> '' and (right(text, 1) not in ('.', '!', '?') or contains(text, '  ') or (lower(text[1]) = text[1] and upper(text[1]) <> text[1] and length(text) > 10)) as issue,
             {_any('lower(text)', config.PROTECTED_KEYWORDS)} as protected, {_collapse(_fix_grammar('text'))} as fixed from sent),
p as (select *, case when audio < 0.6 then {_glossary_phrases('fixed')} else fixed end as phrased from g),
c as (select *, {_collapse("array_to_string(list_transform(string_split_regex(phrased, '[[:space:]]+'), lambda w: coalesce(" + GLOSSARY_MAP + "[lower(w)], w)), ' ')")} as improved from p),
e as (select *, case when (audio < 0.4 or issue) and not protected then improved else text end as enhanced from c)
select job_id, sent_idx, enhanced as enhanced_text, enhanced <> text as repaired from e""",
    "coverage_merge": f"""with {SECTIONS}, {TURNS}, {SCORED},
every as (select j.job_id, s.ord, s.section_id, s.required, k.k as half from (select distinct job_id from sent) j cross join sec s cross join (values (0), (1)) k(k)),
counts as (select job_id, section_id, sent_idx % 2 as half, count(distinct lower({_collapse('text')})) as n, round(avg(audio), 9) as c from prim group by all),
c0 as (select e.*, coalesce(n, 0) as sentence_count, coalesce(c, 0.0::double) as confidence from every e left join counts c on e.job_id = c.job_id and e.section_id = c.section_id and e.half = c.half),
c1 as (select *, case when sentence_count = 0 then 'missing' when sentence_count <= 1 then 'weak' else 'covered' end as status from c0),
c2 as (select *, case status when 'missing' then case when required then 1.0::double else 0.5 end when 'weak' then case when required then 0.6 else 0.2 end else case when confidence > 0.7 then 0.0 else 0.1 end end as risk_score from c1),
m as (select p.job_id, p.section_id, k.status = 'covered' or (k.status = 'weak' and p.status = 'missing') as up, p as a, k as b from c2 p join c2 k on p.job_id = k.job_id and p.section_id = k.section_id and p.half = 0 and k.half = 1)
select job_id, section_id, case when up then b.status else a.status end as status, case when up then b.sentence_count else a.sentence_count end as sentence_count,
       round(case when up then b.confidence else a.confidence end, 6) as confidence, case when up then b.risk_score else a.risk_score end as risk_score, up as from_child from m""",
    "review_apply": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {CORRECTIONS},
latest as (select job_id, sent_idx, max_by(corrected_section, struct_pack(a := stamp, b := corrected_section)) as corrected_section from corr group by all),
every as (select d.job_id, s.ord, s.section_id, s.required from (select distinct doc_id as job_id from documents) d cross join sec s),
r0 as (select s.job_id, s.sent_idx, s.audio, coalesce(l.corrected_section, f.section_id) as section_id, case when l.corrected_section is not null then 'accepted' else f.route end as route
       from sent s left join final f using (job_id, sent_idx) left join latest l using (job_id, sent_idx)),
counts as (select job_id, section_id, count(*) as n, round(avg(audio), 9) as c from r0 where route = 'accepted' group by all),
c0 as (select e.*, coalesce(n, 0) as sentence_count, coalesce(c, 0.0::double) as confidence from every e left join counts c on e.job_id = c.job_id and e.section_id = c.section_id),
c1 as (select *, case when sentence_count = 0 then 'missing' when sentence_count <= 1 then 'weak' else 'covered' end as status from c0)
select job_id, section_id, status, sentence_count, round(confidence + 1e-9::double, 6) as confidence,
       case status when 'missing' then case when required then 1.0::double else 0.5 end when 'weak' then case when required then 0.6 else 0.2 end else case when confidence > 0.7 then 0.0 else 0.1 end end as risk_score from c1""",
    "feedback_placement": f"""with {SECTIONS}, {CORRECTIONS},
fx as (select original_section as section_id, 1 - boost as f from corr union all select corrected_section, 1 + boost from corr), fs as (select section_id, product(f) as factor from fx group by section_id),
l as (select conv_id as job_id, turn as line_id, {_tokens('text')} as tok from conversations),
p as (select l.job_id, l.line_id, s.ord, s.section_id, len(list_intersect(l.tok, s.line_tok))::double / (len(l.tok) + len(s.line_tok) - len(list_intersect(l.tok, s.line_tok))) * coalesce(f.factor, 1.0) as sim
      from l cross join sec s left join fs f on f.section_id = s.section_id),
b as (select *, row_number() over (partition by job_id, line_id order by round(sim, 9) desc, ord) as rn from p where sim > 0)
select l.job_id, l.line_id, b.section_id, round(b.sim, 6) as similarity from l left join b on l.job_id = b.job_id and l.line_id = b.line_id and b.rn = 1 and b.sim >= 0.05""",
    "field_mapping": f"with {SECTIONS}, {CHUNKS}, {BEST}, {FIELDS} select job_id, section_id, field_id, chunk_idx as source_chunk_index, round(score, 6) as confidence, chunk as value from fr where place = 1 and score >= 0.01",
    "field_mapping_scaled": f"""with {SECTIONS}, {CHUNKS}, {BEST}, {FIELDS},
fm as (select *, (score - min(score) over w) / (max(score) over w - min(score) over w + 1e-9::double) as scaled from fr window w as (partition by job_id, section_id, field_id))
select job_id, section_id, field_id, chunk_idx as source_chunk_index, round(scaled, 6) as confidence from fm where place = 1 and scaled >= 0.25""",
    "accumulated_analysis": f"""with {SECTIONS}, {CHUNKS}, {BEST}, {ANALYSIS} select job_id, section_id, chunk_count, round(confidence, 6) as confidence, status from analysis""",
    "report": f"""with {SECTIONS}, {CHUNKS}, {BEST}, {ANALYSIS},
s as (select job_id, sum(case status when 'covered' then 1.0::double when 'partial' then 0.5 else 0 end) / count(*) as cov, count(*) filter (where status = 'missing') as gone, count(*) as n from analysis where required group by job_id),
h as (select job_id, string_agg(section_id || '=' || printf('%.3f', round(case status when 'covered' then confidence when 'partial' then 0.5 * confidence else 0.0 end, 3)), '|' order by ord) as heatmap from analysis group by job_id)
select job_id, 'tenant' as tenant, 'project' as project, 'team' as team, round(cov, 6) as coverage_percentage, round(greatest(0.0, least(1.0, 1 - cov + gone / n * 0.5::double)), 6) as risk_score,
       case when gone > 0 then 'Completed with Risk' else 'Pending Review' end as recommended_state, heatmap from s join h using (job_id)""",
    "quality_report": f"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {COVERAGE},
a as (select job_id, round(avg(case when status <> 'missing' then 1.0::double else 0 end) * 100, 6) as coverage_percent from cover group by job_id),
m as (select s.job_id, avg(coalesce(p.combined, 0.5::double)) as mean from sent s left join prim p using (job_id, sent_idx) group by s.job_id)
select job_id, coverage_percent, round(coalesce(mean, 0.5) + 1e-9::double, 6) as average_confidence, 0.0::double as duplicate_rate from a left join m using (job_id)""",
    "reviews_of_job": f"with {SECTIONS}, {TURNS}, {SCORED}, {ROUTED}, {PLACED} select job_id, sent_idx, text from placed where destination = 'review' and job_id = 7",
    "find_sentence": rf"""
with c as (select conv_id as job_id, turn as sent_idx, lower({_strip('text')}) as k from conversations),
q as (select conv_id as job_id, turn as asked, case when conv_id % 2 = 1 then turn + 2 end as i, lower({_strip('text')}) as k from conversations)
select q.job_id, q.asked, coalesce(max(a.sent_idx), min(b.sent_idx)) as sent_idx from q left join c a on a.job_id = q.job_id and a.sent_idx = q.i left join c b on b.job_id = q.job_id and b.k = q.k group by q.job_id, q.asked""",
    "form": f"""with {SECTIONS}, {TURNS}, {SCORED}, {ROUTED}, {PLACED}, {CONTENT},
j as (select c.job_id, c.section_id, array_to_string(c.texts, chr(10)) as t, s.hints from content c join sec s using (section_id)),
o as (select *, list_filter(hints, lambda h: contains(lower(t), lower(h))) as chosen from j)
select job_id, section_id, section_id || '_' || k as field_id, case k when 'boolean' then 'true' when 'single_select' then chosen[1] when 'multi_select' then '[' || coalesce(array_to_string(list_transform(chosen, lambda x: '"' || x || '"'), ','), '') || ']' else t end as value
from o, unnest(['boolean', 'single_select', 'multi_select', 'text']) as u(k)""",
    "job_states": """select user_id as job_id, max(event_id % 103) as progress, case when max(case when event_id % 997 = 0 then 1 else 0 end) = 1 then 'failed' when max(event_id % 103) >= 100 then 'completed' else 'processing' end as status from events group by user_id""",
    "feedback_counts": f"""with {CORRECTIONS} select d.doc_id as job_id, count(c.job_id) as feedback_count, coalesce(string_agg(c.corrected_section, '|' order by c.stamp, c.corrected_section), '') as corrected
from (select doc_id from documents) d left join corr c on c.job_id = d.doc_id group by d.doc_id""",
    "merged_transcripts": """with f as (select conv_id, text from conversations where turn = 0)
select a.conv_id as parent_job_id, b.conv_id as child_job_id, a.text || chr(10) || chr(10) || '[SESSION 2]' || chr(10) || b.text as transcript from f a join f b on b.conv_id = a.conv_id + 1""",
    "ingested_segments": """select conv_id as job_id, cast(turn as integer) as seg_idx, case when turn % 3 <> 0 then text else '' end as text, 0.0::double as start, case when turn % 2 = 0 then turn * 5.0::double + 5 else 0 end as end,
       -1.0::double as avg_logprob, 0.5::double as audio_confidence, cast(null as varchar) as speaker from conversations""",
    "recommended_models": "select doc_id, case when n_chars <= 1800 then 'base' else 'small' end as model from documents",
    "model_info": "select * from (values " + ", ".join(f"('{m}', {a}::double)" for m, a in config.MODEL_ACCURACY) + ") as m(model, accuracy)",
    "vector_classify": """with k as (select vec_id as section, embedding::double[] as v from embeddings where vec_id < 5), e as (select vec_id, embedding::double[] as u from embeddings)
select e.vec_id, cast(row_number() over (partition by e.vec_id order by k.section) - 1 as integer) as section, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-9), 6) as score from e cross join k""",
    "classification_reasons": f"""with {SECTIONS}, {TURNS}, {SCORED}
select s.job_id, s.sent_idx, case when p.section_id is not null then 'Matched ' || chr(39) || substr(s.text, 1, 60) || chr(39) || ' to ' || chr(39) || p.title || chr(39) end as reason,
       case when p.section_id is not null then 'Semantic, Context, Keywords, Combined' end as detail from sent s left join prim p using (job_id, sent_idx)""",
    "chunk_best_section": f"""with {SECTIONS}, {CHUNKS}, {BEST} select c.job_id, c.chunk_idx, b.section_id, round(b.score, 6) as score, b.has_hint from chunk c left join best b using (job_id, chunk_idx)""",
    "chunk_dedup": f"""with {SECTIONS}, {CHUNKS}, {BEST}
select job_id, chunk_idx, section_id from (select *, row_number() over (partition by job_id, substr(lower({_strip('chunk')}), 1, 100) order by ord, chunk_idx) as place from best) where place = 1""",
    "section_analysis": f"with {SECTIONS}, {CHUNKS}, {BEST}, {ANALYSIS} select job_id, section_id, chunk_count, round(confidence, 6) as confidence, status from analysis",
    "required_summary": f"""with {SECTIONS}, {CHUNKS}, {BEST}, {ANALYSIS},
s as (select job_id, sum(case status when 'covered' then 1.0::double when 'partial' then 0.5 else 0 end) / count(*) as cov, avg(confidence) as conf, count(*) filter (where status = 'missing') as gone, count(*) as n,
      coalesce(string_agg(section_id, '|' order by ord) filter (where status = 'missing'), '') as missing from analysis where required group by job_id)
select job_id, round(cov, 6) as coverage_percentage, round(conf, 6) as confidence_score, round(greatest(0.0, least(1.0, 1 - cov + gone / n * 0.5::double)), 6) as risk_score, missing as missing_required_sections,
       case when gone > 0 then 'Completed with Risk' else 'Pending Review' end as recommended_state from s""",
    "heatmap": f"with {SECTIONS}, {CHUNKS}, {BEST}, {ANALYSIS} select job_id, section_id, round(case status when 'covered' then confidence when 'partial' then 0.5 * confidence else 0.0 end, 6) as heat from analysis",
    "explainability": f"""with {SECTIONS}, {CHUNKS}, {BEST}, {ANALYSIS}
select a.job_id, a.section_id, a.status, case when a.status = 'missing' then array_to_string(list_sort(s.hints), '|') end as expected_hints,
       case when a.status <> 'missing' then a.chunk_count end as matched_count, case when a.status <> 'missing' then round(a.confidence, 6) end as top_score from analysis a join sec s using (section_id)""",
    "clause_placement": f"with {SECTIONS}, {LINES} select job_id, unit_id, text, is_split, start_char, section_id, round(similarity, 6) as similarity, round(confidence, 6) as confidence from units",
    "paragraphs": f"with {SECTIONS}, {LINES}, {PARAGRAPHS} select job_id, section_id, paragraph, round(coherence_score, 6) as coherence_score, unit_count from paragraph",
    "quality_metrics": f"""with {SECTIONS}, {LINES}, {PARAGRAPHS},
u as (select job_id, count(distinct line_id) as total_sentences, count(*) filter (where registered) as assigned_sentences, count(*) filter (where not registered) as unclassified_sentences,
      count(*) filter (where section_id is not null and not registered) as duplicate_count, coalesce(avg(confidence) filter (where registered), 0.0) as a, coalesce(min(confidence) filter (where registered), 0.0) as lo,
      coalesce(max(confidence) filter (where registered), 0.0) as hi, count(distinct line_id) filter (where is_split) as split_sentences from units group by job_id),
p as (select job_id, avg(coherence_score) as c, string_agg(section_id || '=' || unit_count, '|' order by section_id) as section_coverage from paragraph group by job_id)
select job_id, total_sentences, assigned_sentences, unclassified_sentences, duplicate_count, round(a, 6) as avg_confidence, round(lo, 6) as min_confidence, round(hi, 6) as max_confidence, split_sentences, round(coalesce(c, 0.0), 6) as coherence_score,
       round(case when assigned_sentences > 0 then duplicate_count::double / assigned_sentences else 0 end, 6) as duplicate_rate, p.section_coverage
from u left join p using (job_id)""",
    "feedback_factors": f"""with {CORRECTIONS}, x as (select original_section as section_id, 1 - boost as f from corr union all select corrected_section, 1 + boost from corr)
select section_id, round(product(f), 6) as factor from x group by section_id""",
    "training_stats": f"with {CORRECTIONS} select count(*) as total_corrections, string_agg(distinct corrected_section, '|' order by corrected_section) as sections_corrected, max(stamp) as last_correction from corr",
    "session_merge": """
with s as (select conv_id as job_id, turn as sent_idx, text, turn * 5.0::double as start, turn * 5.0::double + 5 as e from conversations),
m as (select job_id, max(e) as shift, max(sent_idx) + 1 as n from s where sent_idx % 2 = 0 group by job_id)
select job_id, cast(sent_idx as integer) as sent_idx, 1 as session, start, e as "end", text from s where sent_idx % 2 = 0
union all select job_id, cast(sent_idx + coalesce(n, 0) as integer), 2, start + coalesce(shift, 0), e + coalesce(shift, 0), text from s left join m using (job_id) where sent_idx % 2 = 1""",
    "jobs_recent": "select doc_id as job_id, 'completed' as status, substr(text, 1, 200) as transcript_preview from documents order by doc_id desc limit 20",
    "transcript_lines": f"select doc_id as job_id, i - 1 as line_id, {_strip('l')} as text from documents, unnest(string_split(text, chr(10))) with ordinality as u(l, i) where {_strip('l')} <> ''",
    "job_activity": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n, round(sum(value), 6) as value from events group by all",
    "audit_tail": "select event_id, user_id, event_type, props from events order by ts desc, event_id desc limit 200",
}

ORACLES["feedback_as_of"] = f"""with {SECTIONS}, {CORRECTIONS},
boosts as (select *, case when stamp % 91 = 0 then 2.0::double when stamp % 401 = 0 then 1.0 else 0.01 end as b from corr),
fx as (select original_section as section_id, stamp, 1 - b as f from boosts union all select corrected_section, stamp, 1 + b from boosts),
l as (select conv_id as job_id, cast(turn as integer) as line_id, {_tokens('text')} as tok, (conv_id * 37 + turn * 101) % (select max(doc_id) from documents) as stamp from conversations),
f as (select t.stamp, x.section_id, product(x.f) as factor from (select distinct stamp from l) t join fx x on x.stamp < t.stamp group by all),
p as (select l.job_id, l.line_id, s.ord, s.section_id, len(list_intersect(l.tok, s.line_tok))::double / (len(l.tok) + len(s.line_tok) - len(list_intersect(l.tok, s.line_tok))) as score,
             coalesce(f.factor, 1.0) as factor
      from l cross join sec s left join f on f.section_id = s.section_id and f.stamp = l.stamp),
b as (select *, score * factor as sim, row_number() over (partition by job_id, line_id order by round(score * factor, 9) desc, ord) as rn from p where score > 0)
select l.job_id, l.line_id, b.section_id, round(b.sim, 6) as similarity from l left join b on l.job_id = b.job_id and l.line_id = b.line_id and b.rn = 1 and b.sim >= 0.05"""
ORACLES["feedback_as_of_stream"] = ORACLES["feedback_as_of"]

ORACLES["registry_increments"] = "select user_id, event_type, min(event_id) as seq, count(*) - 1 as rejected from events group by all"
_COUNTS = "[1.0::double" + "".join(f", (length(text) - length(replace(text, '{x}', '')))::double" for x in "etaoinshrd") + "]"
ORACLES["embedding_classify"] = f"""with k as (select item_id as section, {_COUNTS} as v from benchmark where item_id < 13), e as (select conv_id as job_id, turn as sent_idx, {_COUNTS} as u from conversations),
x as (select job_id, cast(sent_idx as integer) as sent_idx, section, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-9), 6) as score from e cross join k)
select job_id, sent_idx, cast(section as integer) as section, score from (select *, row_number() over (partition by job_id, sent_idx order by score desc, section) as rn from x) where rn = 1"""
_cut = "array_to_string(list_transform(list_filter([{}], lambda x: x is not null and x <> ''), lambda x: substr(x, 1, 12)), '/')"
_near = "[lag(text, 2) over w, lag(text) over w, lead(text) over w, lead(text, 2) over w]"
ORACLES["repair_with_context"] = ORACLES["repair_text"].rpartition("select job_id, sent_idx, enhanced")[0] + f""",
near as (select job_id, sent_idx, text, {_cut.format("lag(text, 2) over w, lag(text) over w")} as b, {_cut.format("lead(text) over w, lead(text, 2) over w")} as a,
                length(array_to_string(list_filter({_near}, lambda x: x is not null and x <> ''), ' ')) as n from sent window w as (partition by job_id order by sent_idx)),
h as (select e.job_id, e.sent_idx, e.text, case when e.audio < 0.3 and not e.protected then n.b || ' < ' || e.text || ' > ' || n.a || ' (' || n.n || ')' else e.enhanced end as enhanced from e join near n using (job_id, sent_idx))
select job_id, sent_idx, enhanced as enhanced_text, case when enhanced <> text then 0.85::double end as confidence from h"""
ORACLES["vector_top3_sections"] = """with v as (select vec_id, embedding::double[] as u from embeddings),
x as (select a.vec_id, b.vec_id as section, round(list_dot_product(a.u, b.u) / (sqrt(list_dot_product(a.u, a.u)) * sqrt(list_dot_product(b.u, b.u)) + 1e-9), 9) as c from v a join v b on b.vec_id % 5 = 0),
t as (select *, row_number() over (partition by vec_id order by c desc, section) as rn from x)
select vec_id, max(section) filter (where rn = 1) as section, round(max(c) filter (where rn = 1), 6) as confidence,
       coalesce(string_agg(section, '|' order by rn) filter (where rn in (2, 3) and c > 0.65::double * 0.8), '') as alternatives, max(c) filter (where rn = 1) < 0.65 as requires_review from t where rn <= 3 group by vec_id"""
ORACLES["model_info"] = "with m(model, accuracy) as (values " + ", ".join(f"('{m}', {a}::double)" for m, a in config.MODEL_ACCURACY) + """),
d as (select case when n_chars <= 1800 then 'base' else 'small' end as model, count(*) as n from documents group by all)
select m.model, accuracy, coalesce(n, 0) as documents from m left join d on d.model = m.model"""
ORACLES["context_inference"] = """with v as (select vec_id, vec_id // 20 as job_id, cast(vec_id % 20 as integer) as sent_idx, embedding::double[] as u from embeddings),
near as (select *, list_filter([lag(u) over w, lead(u) over w, lag(u, 2) over w, lead(u, 2) over w], lambda x: x is not null) as near from v window w as (partition by job_id order by sent_idx)),
blend as (select *, case when len(near) = 0 then u else list_transform(u, lambda x, i: 0.6::double * x + 0.4::double * (list_sum(list_transform(near, lambda n: n[i])) / len(near))) end as b from near),
s as (select a.job_id, a.sent_idx, k.vec_id as k, list_dot_product(a.b, k.u) / (sqrt(list_dot_product(a.b, a.b)) * sqrt(list_dot_product(k.u, k.u)) + 1e-9) as c from blend a join v k on k.vec_id < 5)
select job_id, sent_idx, case when c > 0.25 then 's' || k end as section_id, round(c, 6) as similarity from (select *, row_number() over (partition by job_id, sent_idx order by c desc, k) as rn from s) where rn = 1"""


def _machine() -> str:
    """A step at a time: the least event that could follow the last accepted one."""
    ctes = [
        """e as (select event_id // 10 as job_id, epoch_us(ts) as us, event_id, event_id % 97 = 0 as failed, ([0, 10, 30, 85, 100])[1 + (event_id + case when user_id % 11 = 0 then 1 else 0 end) % 5] as p from events)""",
        "t0 as (select job_id, arg_min(us, (us, event_id)) as us, arg_min(event_id, (us, event_id)) as id, 0 as progress, 'processing' as status, 'step' as reason, 1 as steps from e where p = 0 and not failed group by job_id)",
    ]
    for k, step in enumerate((10, 30, 85, 100)):
        ctes += [
            f"""n{k} as (select e.job_id, min((e.us, e.event_id, e.failed)) as m from e join t{k} t on e.job_id = t.job_id
  where t.status = 'processing' and t.progress = {(0, 10, 30, 85)[k]} and (e.us, e.event_id) > (t.us, t.id) and e.us < t.us + 300000000 and (e.failed or e.p = {step}) group by e.job_id)""",
            f"""t{k + 1} as (select t.job_id, coalesce(m[1], us) as us, coalesce(m[2], id) as id, case when m[3] = false then {step} else progress end as progress,
  case when m is null then status when m[3] then 'failed' else '{"completed" if step == 100 else "processing"}' end as status,
  case when m is null then reason when m[3] then 'failure' else 'step' end as reason, steps + case when m is null then 0 else 1 end as steps from t{k} t left join n{k} n on t.job_id = n.job_id)""",
        ]
    return f"""with {', '.join(ctes)},
f as (select *, status = 'processing' and us + 300000000 <= (select max(us) from e) as out from t4)
select job_id, case when out then 'failed' else status end as status, cast(progress as integer) as progress,
       strftime(make_timestamp(case when out then us + 300000000 else us end), '%Y-%m-%d %H:%M:%S.%f') as at, case when out then 'timeout' else reason end as reason, cast(steps as bigint) as steps from f"""


ORACLES["job_state_machine"] = ORACLES["job_state_stream"] = _machine()



def _component(x: str) -> str:
    return "case " + " ".join(f"when regexp_matches({x}, '{p}', 'i') then '{n}'" for n, p in config.COMPONENT_PATTERNS) + " end"


def _six(x: str) -> str:
    return f"printf('%.6f', round({x}, 6))"


ORACLES["nested_documents"] = rf"""with {SECTIONS}, {DOC_SENTENCES}, {SCORED}, {ROUTED}, {PLACED}, {CONTENT}, {COVERAGE.replace("counts as", "counts_c as").replace("join counts c", "join counts_c c")}, {CORRECTIONS},
numbers as (select s.job_id, count(*) as sentence_count, count(p.job_id) filter (where p.destination = 'review') as unassigned_count, count(p.job_id) as logs from sent s left join placed p using (job_id, sent_idx) group by s.job_id),
cov as (select c.job_id, count(*) filter (where c.status <> 'missing') * 100.0::double / count(*) as percent, avg(c.risk_score) as risk,
  coalesce(string_agg(c.section_id, '|' order by c.ord) filter (where c.required and c.status = 'missing'), '') as missing,
  list_sort(list(c.section_id || ':' || s.title || ':' || c.status || ':' || c.required || ':' || coalesce(k.sentence_count, c.sentence_count) || ':' || {_six("c.confidence")} || ':' || {_six("c.risk_score")})) as parts
  from cover c join sec s using (section_id) left join content k using (job_id, section_id) group by c.job_id),
pos as (select *, row_number() over (partition by job_id order by bucket, b0 is null, appearance) as position, list_transform(texts, lambda t: substr(t, 1, 100)) as cut from flow),
idx as (select job_id, section_id, string_agg(sent_idx, '/' order by sent_idx) as ids from placed where destination = 'placed' group by all),
secs as (select job_id, count(*) as n, list_sort(list(section_id || ':' || section_id || ':' || title || ':' || sentence_count || ':' || {_six("confidence")} || ':' || array_to_string(cut[1:3], '/'))) as parts,
  string_agg(section_id || ':' || title || ':' || sentence_count || ':' || array_to_string(cut[1:5], '/') || ':' || ids, '|' order by position) as ordered from pos join idx using (job_id, section_id) group by job_id),
fold as (select job_id, lower({_collapse('text')}) as k, min(sent_idx) as at_first, max_by(text, sent_idx) as text from placed where destination = 'review' group by all),
una as (select job_id, string_agg(text, '|' order by at_first) as texts from (select *, row_number() over (partition by job_id order by at_first) as rn from fold) where rn <= 5 group by job_id),
rev0 as (select job_id, text, row_number() over (partition by job_id order by sent_idx) - 1 as k from placed where destination = 'review'),
rev as (select r.job_id, string_agg(r.text || ':' || coalesce(p.section_id, '-') || ':' || case when p.section_id is null then '-' else {_six("p.combined")} end, '|' order by r.k) as texts
  from rev0 r left join placed p on p.job_id = r.job_id and p.sent_idx = r.k group by r.job_id),
evi as (select s.job_id, string_agg(s.text || ':' || coalesce(array_to_string(list_filter({EVIDENCE}, lambda k: contains(lower(s.text), k)), '/'), ''), '|' order by s.sent_idx) as texts from sent s where s.sent_idx < 10 group by s.job_id),
ass0 as (select s.job_id, s.sent_idx, u.i, u.url from sent s, unnest(regexp_extract_all(s.text, 'https?://[^\s]+')) with ordinality as u(url, i)),
ass as (select job_id, max(n) as n, string_agg('url:' || url || ':' || coalesce({_component("url")}, '-'), '|' order by sent_idx, i) filter (where rn <= 10) as texts
  from (select *, row_number() over (partition by job_id order by sent_idx, i) as rn, count(*) over (partition by job_id) as n from ass0) group by job_id),
lg as (select job_id, string_agg(section_id || ':' || {_six("combined")} || ':Matched ' || chr(39) || substr(text, 1, 60) || chr(39) || ' to ' || chr(39) || title || chr(39) || case when is_inferred then ' [INFERRED]' else '' end, '|' order by sent_idx) as texts
  from (select *, row_number() over (partition by job_id order by sent_idx) as nth from placed) where nth <= 5 group by job_id),
fl0 as (select *, lag(bucket) over (partition by job_id order by appearance) as before from flow),
fl as (select job_id, avg(case when bucket < before then 0.0::double else 1 end) as score,
  coalesce(string_agg('Section ' || chr(39) || section_id || chr(39) || ' appears out of flow (bucket ' || bucket || ' < prev ' || before || ')', '|' order by appearance) filter (where bucket < before), '') as issues from fl0 group by job_id),
blocks as (select job_id, coalesce(b0, {len(config.FLOW_BUCKETS)}) as g, {NAMES}[bucket + 1] as name, appearance, '### ' || title || chr(10) || array_to_string(list_transform(texts, lambda t: '- ' || t), chr(10)) || chr(10) as block from flow),
grp as (select job_id, g, '## ' || name || chr(10) || string_agg(block, chr(10) order by appearance) as body from blocks group by job_id, g, name),
md as (select job_id, string_agg(body, chr(10) order by g) as body from grp group by job_id),
xr as (select p.job_id, string_agg(p.sent_idx || ':' || p.text || ':' || p.section_id || ':' || t.text || ':' || case p.destination when 'reference' then 'referential_link' else 'duplicate_reference' end, '|' order by p.sent_idx) as texts
  from placed p join placed t on p.job_id = t.job_id and p.to_idx = t.sent_idx where p.destination in ('reference', 'duplicate') group by p.job_id),
fb as (select job_id, count(*) as n from corr group by job_id)
select d.doc_id as job_id, case when d.doc_id % 10 = 9 then d.doc_id - 1 end as parent_job_id, d.lang as timestamp, md5(d.text) as transcript, round(cov.percent, 6) as overall_coverage_percent, round(cov.risk, 6) as overall_risk_score,
  cov.missing as missing_required_sections, coalesce(secs.n, 0) as section_count, coalesce(numbers.sentence_count, 0) as sentence_count, coalesce(numbers.unassigned_count, 0) as unassigned_count, coalesce(ass.n, 0) as asset_count,
  coalesce(numbers.logs, 0) as explainability_logs_count, coalesce(fb.n, 0) as human_feedback_count, array_to_string(cov.parts, '|') as coverage, coalesce(array_to_string(secs.parts, '|'), '') as section_content,
  coalesce(secs.ordered, '') as ordered_section_content, coalesce(una.texts, '') as unassigned_sentences, coalesce(rev.texts, '') as review_required_sentences, coalesce(evi.texts, '') as evidence, coalesce(ass.texts, '') as assets,
  coalesce(lg.texts, '') as top_explainability_logs, round(coalesce(fl.score, 1.0), 6) as flow_coherence_score, coalesce(fl.issues, '') as flow_issues,
  md5('# KT Report - ' || d.doc_id || chr(10) || chr(10) || coalesce(md.body, '')) as ordered_markdown, coalesce(xr.texts, '') as cross_references
from documents d left join numbers on numbers.job_id = d.doc_id left join cov on cov.job_id = d.doc_id left join secs on secs.job_id = d.doc_id left join una on una.job_id = d.doc_id left join rev on rev.job_id = d.doc_id
left join evi on evi.job_id = d.doc_id left join ass on ass.job_id = d.doc_id left join lg on lg.job_id = d.doc_id left join fl on fl.job_id = d.doc_id left join md on md.job_id = d.doc_id left join xr on xr.job_id = d.doc_id left join fb on fb.job_id = d.doc_id"""

#: Streams have the rows of the batch query over the same tables.
ORACLES["coverage_merge_stream"] = ORACLES["coverage_merge"]

"""SQL for the queries that SQL can express, on tables read by a plain engine."""

from quayside.llm.license_texts import BASE, SENTENCES, TEXTS

OP1_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key),
judged as (select k.doc_id, k.line, k.pos, coalesce(k.doc_id > o.owner, false) as gone from keyed k left join owners o using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP6_SQL = """
with texts as (select doc_id, coalesce(text, '') as body from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(body) as text_sha256
from texts window w as (partition by body)
"""

_PHRASES = [(p, x, True) for p, x in BASE.items()] + [(p, x, False) for p, x in {**SENTENCES, **TEXTS}.items()]
_TEMPLATES = ", ".join("({}, '{}', {}, '{}')".format(i, x, b, " ".join(p.split()).replace("'", "''")) for i, (p, x, b) in enumerate(_PHRASES))

# Base phrases stand word for word. Other templates are searched by word pairs, by four words from
# twelve words on; a span may drift a word for eight of its template, eight at most; 84 % of the
# pairs, or 66 % of the runs of four, have to stand in order. The longest run in order is found by
# lengthening runs by one later match at a time.
OP4_SQL = rf"""
with recursive templates as (
  select template, label, is_base, words, case when len(words) >= 12 and not is_base then 4 else 2 end as gram,
         case when is_base then 0 else least(len(words) // 8, 8) end as shift,
         case when is_base then 1.0 when len(words) >= 12 then 0.66 else 0.84 end as needed
  from (select *, regexp_extract_all(translate(said, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
        from (values {_TEMPLATES}) t(template, label, is_base, said))),
grams as (select template, gram, shift, len(words) - gram + 1 as grams, i."at", array_to_string(words[i."at" + 1:i."at" + gram], ' ') as said
          from templates, lateral (select unnest(range(len(words) - gram + 1)) as "at") i),
texts as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
rolled as (select doc_id, gram, i.pos, array_to_string(words[i.pos + 1:i.pos + gram], ' ') as said
           from texts, (values (2), (4)) g(gram), lateral (select unnest(range(len(words) - gram + 1)) as pos) i),
votes as (select doc_id, template, shift, grams, pos, "at", pos - "at" as diagonal from rolled join grams using (gram, said)),
spans as (select v.doc_id, v.template, v.grams, s.diagonal as opened, v.pos, v."at"
          from (select distinct doc_id, template, diagonal from votes) s
          join votes v on v.doc_id = s.doc_id and v.template = s.template and v.diagonal between s.diagonal and s.diagonal + v.shift),
runs(doc_id, template, grams, opened, pos, "at", n) as (
  select *, 1 from spans
  union select v.*, r.n + 1 from runs r join spans v on v.doc_id = r.doc_id and v.template = r.template and v.opened = r.opened
        and v.pos > r.pos and v."at" > r."at"),
scored as (select doc_id, template, opened, min(pos) as first_word, max(n) / any_value(grams) as score from runs group by all),
judged as (select doc_id, label, is_base, first_word, score, score >= needed as verified from scored join templates using (template)),
found as (select doc_id, count(*) filter (is_base and verified) as n_base, min(first_word) filter (is_base and verified) as first_word,
                 max(first_word) filter (is_base and verified) as last_word,
                 string_agg(distinct label, ',' order by label) filter (is_base and verified) as base_labels,
                 string_agg(distinct label, ',' order by label) filter (verified) as labels, max(score) as score
          from judged group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from texts left join found using (doc_id)
"""

OP12_SQL = r"""
with terms as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
lengths as (select doc_id, count(*) as n from terms group by doc_id),
corpus as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
postings as (select doc_id, term, count(*) as tf from terms group by all),
weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
            from postings, corpus group by term),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::bigint as score
  from wanted join postings using (term) join weights using (term) join lengths using (doc_id), corpus group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""

OP13_SQL = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (select doc_id, i.i  as pos, array_to_string(words[i.i:i.i + 19], ' ') as said
            from texts, lateral (select unnest(range(1, greatest(len(words) - 18, 1))) as i) i),
repeats as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by said order by doc_id, pos) as k from windows) where k > 1),
covered as (select distinct doc_id, pos + o as pos from repeats, unnest(range(0, 20)) as offsets(o)),
kept as (select w.doc_id, w.pos, w.word, c.doc_id is not null as gone
         from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as pos from texts) w
         left join covered c on c.doc_id = w.doc_id and c.pos = w.pos)
select t.doc_id, len(words) as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from texts t left join (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as rest
                        from kept group by doc_id) k on t.doc_id = k.doc_id
"""

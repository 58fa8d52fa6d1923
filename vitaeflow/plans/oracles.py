"""The registered queries in SQL, for comparison on the same tables."""

from __future__ import annotations

from vitaeflow.fixed_values import (
    EXTRACTION_PROMPT,
    FIELD_DEFAULT,
    LINK_MISSING,
    LINK_PREFIX,
    LINK_SUFFIX,
    MAX_TOKENS,
    RECORD_FIELDS,
    RECORD_KEY,
    SUMMARY_PROMPT,
    SYSTEM_PROMPT,
    TEMPERATURE,
    TOP_P,
    WHITESPACE,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BLANK = _text(WHITESPACE)
_NONE = _text(FIELD_DEFAULT)


def _key(number: str) -> str:
    digits = f"lpad(cast({number} as varchar), 9, '0')"
    return f"substr({digits},1,3)||'.'||substr({digits},4,3)||'.'||substr({digits},7,3)||'-K'"


_TYPED = f"""
  select c_custkey, case c_mktsegment
    when 'BUILDING' then ' '||{_key('c_custkey')}||' '||chr(10)
    when 'MACHINERY' then '  No Especificado'||chr(9)
    when 'FURNITURE' then '   '
    when 'HOUSEHOLD' then {_key('c_custkey')} end as run
  from customer"""


def _record(**cells: str) -> str:
    names = {"nombre": "Nombre", "ciudad": "Ciudad", "carrera": "Carrera", "resumen": "Resumen del Postulante",
             "run": RECORD_KEY}
    given = {names[k]: v for k, v in cells.items()}
    return ", ".join(f'{given.get(f, _NONE)} as "{f}"' for f in RECORD_FIELDS)


_HELD = f"""
  select {_record(nombre='c_name', ciudad='cast(c_nationkey as varchar)', carrera='c_mktsegment', run=_key('c_custkey'))},
    c_name||'.pdf' as pdf_name from customer
  union all
  select {_record(nombre='p_name', ciudad='p_brand', carrera='p_type', run="'P'||" + _key('p_partkey'))},
    p_name||'.pdf' from part"""

_STAGED = f"""
  select {_record(nombre='o_orderpriority', ciudad='o_orderstatus', resumen='cast(o_orderkey as varchar)', run=_key('o_custkey'))},
    'order-'||o_orderkey||'.pdf' as pdf_name, cast(o_orderdate as timestamp) as ingest_ts from orders
  union all
  select {_record(nombre='s_name', ciudad='cast(s_nationkey as varchar)', run="'S'||" + _key('s_suppkey'))},
    s_name||'.pdf', timestamp '1970-01-01' from supplier"""

_VALUES = [f for f in [*RECORD_FIELDS, "pdf_name"] if f != RECORD_KEY]

_MERGED = f"""
  select coalesce(t."{RECORD_KEY}", s."{RECORD_KEY}") as "{RECORD_KEY}",
    {", ".join(f'case when s."{RECORD_KEY}" is not null then s."{f}" else t."{f}" end as "{f}"' for f in _VALUES)},
    case when t."{RECORD_KEY}" is null then 'NEW' when s."{RECORD_KEY}" is not null then 'UPDATED' else 'KEPT' end as action
  from ({_HELD}) t full outer join (
    select * from ({_STAGED})
    qualify row_number() over (partition by "{RECORD_KEY}" order by ingest_ts desc, pdf_name desc) = 1
  ) s on t."{RECORD_KEY}" = s."{RECORD_KEY}\""""


def _chunks(size: int, key: str = "doc_id") -> str:
    return f"""
  select {key}, cast(start // {size} as integer) as chunk_no, substring(text, start + 1, {size}) as text
  from (select doc_id as {key}, text, cast(unnest(range(0, length(text), {size})) as bigint) as start from documents)"""


_PIECES = _chunks(1000, "RUN")

_CHAT = """
  select event_id, user_id,
    case when event_type = 'click' then null else event_type end as content,
    case when event_type = 'error' then null else cast(props->>'$.k' as bigint) end as total_tokens,
    case when event_type = 'click' then 'reply has no content'
      when event_type = 'error' then 'reply has no token usage' end as error
  from events"""


def _top_k(k: int) -> str:
    return f"""
  select q.vec_id as query_id, c.vec_id,
    round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as raw,
    cast(row_number() over (partition by q.vec_id order by raw desc, c.vec_id) as integer) as rank
  from embeddings q, embeddings c
  qualify rank <= {k}"""


def _payload(prompt: str) -> str:
    def message(role: str, text: str) -> str:
        return f"{{role: '{role}', content: [{{type: 'text', text: {text}}}]}}"

    return (
        f"to_json({{messages: [{message('system', _text(SYSTEM_PROMPT))}, {message('user', prompt)}], "
        f"temperature: {TEMPERATURE}::double, top_p: {TOP_P}::double, max_tokens: {MAX_TOKENS}}})::varchar"
    )


_LETTERS = "['" + "','".join("abcdefghijklmnopqrstuvwxyz") + "']"


def _letter_counts(text: str) -> str:
    return f"list_transform({_LETTERS}, lambda x: cast(length({text}) - length(replace({text}, x, '')) as double))"


def _indexed(text: str) -> str:
    """What the chunk table has of a text: number of chunks, digest, letters weighed by their place."""
    weighed = f"list_sum(list_transform({_letter_counts(text)}, lambda x, i: x * i))"
    return f"ceil(length({text}) / 1000.0)::bigint as n_chunks, md5({text}) as text_digest, cast({weighed} as bigint) as letters"


_STUB_RECORDS = f"""
  select doc_id, text, 'd'||doc_id||'.pdf' as pdf_name, length(prompt) as n, md5(prompt) as digest, md5(prompt)[1] as first
  from (select *, {_text(EXTRACTION_PROMPT)}||text as prompt from documents)"""

_STORED = f"""
  select {_key('d.doc_id')} as run, replace(replace({_key('d.doc_id')}, '.', ''), '-', '') as run_norm,
    case when quality = 0 and toxic = 1 then '' else text end as text
  from documents d join labels using (doc_id)"""

_SUBMITTED = f"""select o_orderkey, case when o_orderpriority = '1-URGENT' then 'URGENT' else {_key('o_custkey')} end as run from orders"""
_HELD_KEYS = f"""select {_key('c_custkey')} as held_key, c_name from customer where c_mktsegment = 'BUILDING'
  union all select 'URGENT', r_name from region where r_regionkey = 0"""
_LISTED = f"select doc_id, case when lang <> 'en' then {_key('doc_id')} end as run from documents"


def _field_checks() -> str:
    kinds = [f"""case when json_type(j, '$."{f}"') is not null and json_type(j, '$."{f}"') <> 'VARCHAR'
      then {_text(f)} end""" for f in RECORD_FIELDS]
    return f"list_filter([{', '.join(kinds)}], lambda x: x is not null)"


ORACLES: dict[str, str] = {
    "doc_assemble": """
  select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn)||chr(10) as text, count(*) as n_pages
  from conversations group by conv_id""",
    "document_files": """
  select conv_id, true as named, cast(strlen(string_agg(text, chr(12) order by turn)) + 1 as bigint) as length,
    cast(count(*) as integer) as n_pages, string_agg(text, chr(10) order by turn)||chr(10) as text,
    cast(null as varchar) as error
  from conversations group by conv_id""",
    "doc_pages": """
  select doc_id, cast(unnest(range(0, len(parts))) as integer) as page_no, unnest(parts) as text
  from (select doc_id, string_split(text, chr(10)) as parts from documents)""",
    "doc_nonblank": f"""
  select doc_id, case when trim(case when lang = 'en' then regexp_replace(text, '\\S+', '', 'g') else text end, {_BLANK}) = ''
    then 'document has no text' end as reject_reason
  from documents""",
    "chunk_fixed": _chunks(1000),
    "chunk_pages": _chunks(1000).replace("from documents", "from (select doc_id, text||chr(10) as text from documents)"),
    "folder_listing": """
  select lang||'/'||source||'/doc '||doc_id||'.pdf' as name, 'doc '||doc_id||'.pdf' as pdf_name,
    cast(strlen(text) as bigint) as length, md5(text) as digest
  from documents where text <> ''""",
    "chunk_whole": "select doc_id, cast(0 as integer) as chunk_no, text from documents where length(text) > 0",
    "reply_clean_json": f"""
  select *, cast(json_text->>'$.k' as bigint) as k
  from (select *, regexp_extract(cleaned, '(?s)\\{{.*\\}}', 0) as json_text
    from (select event_id, trim(replace(trim('``note ```json'||chr(10)||props||chr(10)||'``` end`', '`'), 'json', ''), {_BLANK}) as cleaned
      from events))""",
    "reply_clean_fence": """
  select event_id, '{"kind":"json '||event_type||'"}' as json_text from events""",
    "record_validate": f"""
  with made as (select c_custkey, case c_mktsegment
      when 'BUILDING' then '```json'||chr(10)||'{{"Nombre":"'||c_name||'","Ciudad":"'||c_nationkey
        ||'","País":"Chile","Fecha de Nacimiento":"1990","Carrera":"'||c_mktsegment
        ||'","Número de Teléfono":"+56","Entidad Donde Estudió":"","RUN del postulante":"'||{_key('c_custkey')}
        ||'","otro":1}}'||chr(10)||'```'
      when 'MACHINERY' then '{{"Nombre":'||c_custkey||',"Correo":["a"]}}'
      when 'FURNITURE' then 'Respuesta: {{"Nombre":"'||c_name||'","País":null}} fin'
      when 'HOUSEHOLD' then 'no hay datos de '||c_name
      else '{{"Nombre":"'||c_name||'"}} resto {{"b":1}}' end as reply
    from customer),
  sliced as (select c_custkey, regexp_extract(replace(trim(reply, '`'), 'json', ''), '(?s)\\{{.*\\}}', 0) as s from made),
  parsed as (select c_custkey, s, case when json_valid(s) then s::json end as j from sliced),
  judged as (select c_custkey, j, case when s = '' then 'no JSON object in reply' when j is null then 'invalid JSON'
      when len({_field_checks()}) > 0 then 'not text: '||array_to_string({_field_checks()}, ', ') end as error
    from parsed)
  select c_custkey, {", ".join(f'''case when error is null then coalesce(j->>'$."{f}"', {_NONE}) end as "{f}"''' for f in RECORD_FIELDS)}, error
  from judged""",
    "reply_parse": f"select event_id, content, total_tokens, error from ({_CHAT})",
    "token_usage": f"select user_id, cast(sum(total_tokens) as bigint) as tokens_used from ({_CHAT}) group by user_id",
    "embedding_reply_parse": """
  select vec_id, cast(unnest(range(0, len(embedding))) as integer) as position,
    unnest(list_transform(embedding, lambda x: round(x::double, 6))) as cell
  from embeddings""",
    "request_payload": f"""
  select cast(doc_id as varchar) as request_id, {_payload(_text(EXTRACTION_PROMPT) + "||text")} as payload from documents""",
    "embedding_payload": """
  select cast(doc_id as varchar) as request_id, to_json({input: text})::varchar as payload from documents""",
    "replies_joined": """
  select cast(d.doc_id as varchar) as request_id, md5(d.text) as payload_digest, 't'||l.toxic as body
  from documents d left join labels l using (doc_id)""",
    "extract_records": f"""
  select pdf_name, case when first > '5' then 'n'||substr(digest, 1, 8) end as "Nombre",
    case when first > '5' then {_NONE} end as "Ciudad",
    case when first > '5' then digest end as run,
    case when first in ('0', '1') then 'no JSON object in reply'
      when first in ('2', '3') then 'not text: Nombre'
      when first in ('4', '5') then 'no JSON object in reply' end as error
  from ({_STUB_RECORDS})""",
    "key_normalize": f"""
  select c_custkey, run, replace(replace(replace(run, '.', ''), '-', ''), ' ', '') as run_norm from ({_TYPED})""",
    "valid_split": f"""
  select c_custkey, run, case when coalesce(lower(trim(run, {_BLANK})) not in ('', 'no especificado'), false)
    then 'valid' else 'invalid' end as side from ({_TYPED})""",
    "corrections_overlay": """
  with last as (select * from orders
    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
  select c_custkey,
    case when o_orderpriority = '1-URGENT' then 'corrected '||o_custkey else c_name end as c_name,
    coalesce(o_orderpriority, c_mktsegment) as c_mktsegment
  from customer left join last on o_custkey = c_custkey""",
    "grid_filter_sort": """
  select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING'
  order by c_acctbal desc, c_custkey limit 20""",
    "grid_sort_all": "select * from customer order by c_mktsegment, c_acctbal desc, c_custkey",
    "seek_pages": """
  with numbered as (select *, row_number() over (order by c_mktsegment, c_acctbal desc, c_custkey) - 1 as n, count(*) over () as total
    from customer)
  select cast(n // ((total + 6) // 7) as integer) as page, c_mktsegment, c_acctbal, c_custkey from numbered""",
    "grid_rows": "select count(*) as n_rows from customer",
    "merge_candidates": _MERGED,
    "changed_keys": f"""
  select distinct "{RECORD_KEY}" as "RUN", action from ({_MERGED}) where action in ('NEW', 'UPDATED')""",
    "inserted_keys": f"""select distinct "{RECORD_KEY}" as "RUN" from ({_MERGED}) where action = 'NEW'""",
    "updated_keys": f"""select distinct "{RECORD_KEY}" as "RUN" from ({_MERGED}) where action = 'UPDATED'""",
    "merge_only_changed": f"""
  select "{RECORD_KEY}" as "RUN", case when "Carrera" = 'BUILDING' then "Nombre"||' bis' else "Nombre" end as "Nombre",
    case when "Carrera" = 'BUILDING' then 'UPDATED' else 'KEPT' end as action
  from ({_HELD})""",
    "candidate_scan": "select * from customer",
    "changed_sources": f"""
  select "{RECORD_KEY}" as "RUN", pdf_name from ({_STAGED})
  where "{RECORD_KEY}" in (select "{RECORD_KEY}" from ({_MERGED}) where action = 'UPDATED')""",
    "load_records": f"""
  with submitted as (select {_key('doc_id')} as "RUN", lang, source, doc_id, text from documents where lang <> 'en'),
  pieces as (select "RUN", {_indexed('text')} from submitted where length(text) > 0)
  select coalesce(t."{RECORD_KEY}", s."RUN") as "RUN",
    coalesce(lang, "Nombre") as "Nombre", coalesce(source, "Ciudad") as "Ciudad",
    coalesce('d'||doc_id||'.pdf', pdf_name) as pdf_name,
    case when s."RUN" is null then null when t."{RECORD_KEY}" is null then 'NEW' else 'UPDATED' end as action,
    n_chunks, text_digest, letters, cast(0 as integer) as n_staged
  from ({_HELD}) t full outer join submitted s on t."{RECORD_KEY}" = s."RUN"
  left join pieces p on p."RUN" = s."RUN\"""",
    "same_name_files": f"""
  with c as (select conv_id, string_agg(text, chr(10) order by turn)||chr(10)||chr(10) as text from conversations group by conv_id),
  r as (select *, md5({_text(EXTRACTION_PROMPT)}||text) as digest from c)
  select digest as "RUN", ceil(length(text) / 1000.0)::bigint as n_chunks, md5(text) as text_digest,
    'inbox/'||conv_id||'/cv.pdf' as path, md5(text[:-2]) as content_digest
  from r where digest[1] > '5'""",
    "list_keys": 'select distinct doc_id as "RUN" from documents where length(text) > 0',
    "list_keys_limit": 'select distinct source as "RUN" from documents order by source limit 5',
    "rows_of_key": "select doc_id, source from documents where lang = 'fr'",
    "vector_delete": f'select * from ({_PIECES}) where "RUN" not in (select doc_id from labels)',
    "vector_refresh": f"""
  select * from ({_PIECES}) where "RUN" not in (select doc_id from labels)
  union all
  select * from ({_chunks(300, "RUN")}) where "RUN" in (select doc_id from labels)""",
    "table_delete": """
  select doc_id, lang, source, n_chars, text from documents where doc_id not in (select doc_id from labels)""",
    "table_reload": "select doc_id, lang, lang||'/'||source as source, n_chars, text from documents",
    "table_recreate": """
  select cast(0 as integer) as step, 'doc_id bigint,text string,lang string' as columns, count(*) as n_rows, false as still_there from documents
  union all
  select cast(1 as integer), 'doc_id bigint,source string,n_chars bigint', count(*), false from documents""",
    "index_documents": f"""
  select "RUN", chunk_no, cast(unnest(range(0, 26)) as integer) as letter,
    unnest(list_transform({_letter_counts('text')}, lambda x: cast(x as bigint))) as n
  from ({_PIECES})""",
    "embed_hash": f"""
  with words as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) as w from documents),
  counts as (select doc_id, ('0x'||substr(md5(w), 1, 8))::bigint % 256 as place, count(*) as n from words group by all),
  sizes as (select doc_id, sqrt(sum(n * n)) as size from counts group by doc_id),
  places as (select doc_id, unnest(range(0, 256)) as place from documents)
  select p.doc_id, cast(p.place as integer) as place, round(coalesce(cast(n / size as float), 0)::double, 5) as cell
  from places p left join counts using (doc_id, place) left join sizes on sizes.doc_id = p.doc_id""",
    "embed_once": f"""
  with p as (select d.lang = 'en' as own, p.text, {_letter_counts('p.text')} as counts from ({_chunks(1000)}) p join documents d on d.doc_id = p.doc_id),
  sums as (select own, text, list_sum(counts) as letters from p)
  select cast(0 as integer) as round, count(*) as n_chunks, cast(coalesce(sum(letters), 0) as bigint) as letters, count(distinct text) as n_asked
  from sums where own
  union all
  select 1, count(*), cast(coalesce(sum(letters), 0) as bigint), count(distinct text) - count(distinct text) filter (own) from sums
  union all
  select 2, count(*), cast(coalesce(sum(letters), 0) as bigint), 0 from sums""",
    "replies_once": f"""
  with r as (select first, text from ({_STUB_RECORDS}))
  select cast(n as integer) as round, count(*) as n_documents, count(*) filter (first > '5') as n_records,
    case when n = 0 then count(distinct text) else 0 end as n_asked
  from r, range(2) s(n) group by n""",
    "knn_cells": f"select query_id, vec_id, round(raw, 6) as score, rank from ({_top_k(10)})",
    "knn_top2": f"select query_id, vec_id, round(raw, 6) as score, rank from ({_top_k(2)})",
    "knn_tiles": f"select query_id, vec_id, round(raw, 6) as score, rank from ({_top_k(2)})",
    "knn_near_copies": """
  with held as (select vec_id, cast(copy as integer) as copy,
      list_concat([embedding[1]::double + shift], embedding[2:]::double[]) as vector
    from embeddings, (values (0, 0.0::double), (1, 0.001::double), (2, 0.01::double)) s(copy, shift)),
  scored as (select q.vec_id as query_id, h.vec_id, h.copy,
      round(list_cosine_similarity(q.embedding::double[], h.vector), 9) as raw
    from embeddings q, held h)
  select query_id, vec_id, copy, round(raw, 6) as score,
    cast(row_number() over (partition by query_id order by raw desc, vec_id, copy) as integer) as rank
  from scored qualify rank <= 3""",
    "knn_lsh": """
  select vec_id as query_id, cast(2 as bigint) as n_hits, true as scores_hold, true as none_beyond, true as recall_holds
  from embeddings""",
    "knn_top10": f"select query_id, vec_id, round(raw, 6) as score, rank from ({_top_k(10)})",
    "knn_per_candidate": """
  with best as (select q.vec_id as query_id, c.label, c.vec_id,
      round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as raw
    from embeddings q, embeddings c
    qualify row_number() over (partition by q.vec_id, c.label order by raw desc, c.vec_id) = 1)
  select query_id, label, vec_id, round(raw, 6) as score,
    cast(row_number() over (partition by query_id order by raw desc, label, vec_id) as integer) as rank
  from best qualify rank <= 2""",
    "cosine_score": """
  select e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], h.head::double[]), 6) as score
  from embeddings e join (select label, arg_min(embedding, vec_id) as head from embeddings group by label) h using (label)""",
    "answer_concat": f"""
  select query_id, string_agg(text||chr(10), chr(10) order by rank) as answer_text
  from ({_top_k(2)}) k join documents d on d.doc_id = k.vec_id group by query_id""",
    "answer_questions": f"""
  with every as (select conv_id||'-'||turn as query_id, text, {_letter_counts('text')} as v from conversations),
  q as (select query_id, v from every where length(text) % 7 > 0),
  c as (select doc_id, text, {_letter_counts('text')} as v from documents),
  hits as (select query_id, doc_id, text, round(list_cosine_similarity(q.v, c.v), 9) as score,
      row_number() over (partition by query_id order by score desc, doc_id) as rank
    from q, c where list_sum(q.v) > 0 and list_sum(c.v) > 0 qualify rank <= 2)
  select query_id, string_agg('resumen '||md5({_text(SUMMARY_PROMPT[0])}||text||{_text(SUMMARY_PROMPT[1])})||chr(10), chr(10) order by rank)
    as answer_text, cast(0 as bigint) as failed_hits, null as error
  from hits group by query_id
  union all
  select query_id, null, null, 'model call failed: refused' from every where length(text) % 7 = 0""",
    "chat_replay": "select conv_id, turn, role, text from conversations order by conv_id, turn",
    "chat_append": """
  with size as (select conv_id, max(turn) as last, cast(count(*) as varchar) as n from conversations group by conv_id)
  select conv_id, turn, role, text from conversations
  union all select conv_id, last + 1, 'user', n from size
  union all select conv_id, last + 2, 'assistant', n from size""",
    "chat_clear": "select conv_id, turn, role, text from conversations where role <> 'system'",
    "doc_link": f"""
  select doc_id, l.run, case when s.text <> '' then {_text(LINK_PREFIX)}||base64(encode(s.text))||{_text(LINK_SUFFIX)}
    else {_text(LINK_MISSING)} end as link
  from ({_LISTED}) l left join ({_STORED}) s on s.run = l.run""",
    "doc_link_path": f"""
  select doc_id, l.run, case when s.text <> '' then 'curriculums/'||run_norm||'.pdf' else {_text(LINK_MISSING)} end as link
  from ({_LISTED}) l left join ({_STORED}) s on s.run = l.run""",
    "colocated_listing": f"""
  select doc_id, l.run, case when s.text <> '' then 'curriculums/'||run_norm||'.pdf' else {_text(LINK_MISSING)} end as link
  from ({_LISTED}) l left join ({_STORED}) s on s.run = l.run""",
    "colocated_submissions": f"""
  with submitted as ({_SUBMITTED}), held as ({_HELD_KEYS})
  select o_orderkey, run as "RUN", c_name from submitted left join held on run = held_key""",
    "colocated_keys": f"""
  with submitted as ({_SUBMITTED}), held as ({_HELD_KEYS})
  select held_key, c_name, held_key in (select run from submitted) as submitted from held""",
    "doc_fetch": f"""
  select doc_id, replace(replace(l.run, '.', ''), '-', '') as run_norm, md5(s.text) as digest
  from ({_LISTED}) l left join ({_STORED}) s on s.run = l.run""",
    "doc_fetch_long": f"""
  select run_norm, md5(text) as digest from ({_STORED})
  where run_norm in (select replace(replace({_key('o_custkey')}, '.', ''), '-', '') from orders group by o_custkey having count(*) > 1)""",
    "doc_put": f"""
  select replace(replace({_key('conv_id')}, '.', ''), '-', '') as run_norm, max(turn) as turn, md5(arg_max(text, turn)) as digest
  from conversations group by conv_id""",
    "content_store": f"""
  with conv as (select conv_id, string_agg(text, chr(10) order by turn)||chr(10) as text from conversations group by conv_id),
  kept as (select coalesce(conv_id, doc_id) as n, case when conv_id is not null then '1-'||conv_id else '0-'||doc_id end||'.pdf' as path,
      coalesce(c.text, d.text) as text
    from documents d full outer join conv c on c.conv_id = d.doc_id),
  gone as (select text from documents except select text from kept)
  select replace(replace({_key('n')}, '.', ''), '-', '') as run_norm, path, cast(strlen(text) as bigint) as length, md5(text) as digest,
    (select count(distinct text) from kept) as n_contents, (select count(*) from gone) as n_gone
  from kept""",
    "document_store": f"""
  with conv as (select conv_id, string_agg(text, chr(10) order by turn)||chr(10) as text from conversations group by conv_id),
  kept as (select coalesce(conv_id, doc_id) as n, case when conv_id is not null then '1-'||conv_id else '0-'||doc_id end||'.pdf' as path,
      coalesce(c.text, d.text) as text
    from documents d full outer join conv c on c.conv_id = d.doc_id)
  select replace(replace({_key('n')}, '.', ''), '-', '') as run_norm, path, cast(strlen(text) as bigint) as length, md5(text) as digest
  from kept""",
    "stream_intake": f"""
  with pieces as (select digest as "RUN", {_indexed('text')} from ({_STUB_RECORDS})
    where first > '5' and length(text) > 0 qualify row_number() over (partition by digest order by pdf_name desc) = 1)
  select r.digest as "RUN", 'n'||substr(r.digest, 1, 8) as "Nombre", max(pdf_name) as pdf_name,
    any_value(n_chunks) as n_chunks, any_value(text_digest) as text_digest, any_value(letters) as letters, null as error
  from ({_STUB_RECORDS}) r left join pieces p on p."RUN" = r.digest where first > '5' group by r.digest
  union all
  select null, null, pdf_name, null, null, null, case when first in ('2', '3') then 'not text: Nombre' else 'no JSON object in reply' end
  from ({_STUB_RECORDS}) where first <= '5'""",
    "replaced_files": f"""
  with conv as (select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn)||chr(10) as body from conversations group by conv_id),
  read as (select conv_id, {_key('conv_id')} as key, {_key('conv_id')}||chr(10)||if(conv_id % 3 = 0, 'x', '')||body||chr(10) as text from conv)
  select key as "RUN", 'n'||substr(md5({_text(EXTRACTION_PROMPT)}||text), 1, 8) as "Nombre", conv_id||'.pdf' as pdf_name, {_indexed('text')}
  from read
  union all
  select 'run '||run, null, null, (select count(*) from conv where run = 0 or run = 1 and conv_id % 3 = 0), null, null
  from (select unnest([0, 1, 2]) as run)""",
}

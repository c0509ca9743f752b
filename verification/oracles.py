"""The registered queries in DuckDB SQL.

Common table expressions are written once and chained; every query takes those it needs.
The packing of chunks keeps whole buffer counts, as the operator is usually described,
and so checks the engine's shorter state.
"""

from __future__ import annotations

from pagewright.functions import prompts
from pagewright.functions.routing import TYPOS
from pagewright.functions.text import WHITESPACE
from pagewright.operators import admission
from verification import fixtures as fx

SPACES = "'" + WHITESPACE + "'"
T, O = fx.CFG.chunk_size, fx.CFG.chunk_overlap


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {SPACES})"


def words_apart(x: str) -> str:
    """The words of a text with one space between them."""
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strlist(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


# --- building blocks ---------------------------------------------------------------


def normalized(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    x = f"replace({x}, chr(9), ' ')"
    # Without look-around one pass misses every second of adjoining matches.
    for _ in range(2):
        x = rf"regexp_replace({x}, '([a-z])-\n([a-z])', '\1\2', 'g')"
    x = (
        f"array_to_string(list_transform(string_split({x}, chr(10)), "
        f"lambda l: {strip(_collapse('l'))}), chr(10))"
    )
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(x)


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, ' +', ' ', 'g')"


def heading(h: str) -> str:
    words = rf"string_split_regex({h}, '\s+')"
    alpha = rf"list_filter({words}, lambda x: regexp_matches(x, '\p{{L}}'))"
    titled = rf"list_filter({alpha}, lambda x: regexp_matches(x, '^\p{{Lu}}'))"
    return (
        f"case when {h} = '' or length({h}) > 140 or right({h}, 1) in ('.', '!', '?') then false "
        rf"when regexp_matches({h}, '^\s*\d+(?:\.\d+)*[\)\].:\-]?\s+\S+') then true "
        rf"when regexp_matches({h}, '\p{{L}}') and upper({h}) = {h} then true "
        f"else len({words}) <= 12 and len({alpha}) >= 2 and len({titled}) >= 0.75 * len({alpha}) end"
    )


def sentence_list(p: str) -> str:
    marked = (
        rf"regexp_replace({p}, '([.!?])\s+([\"“”''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')".replace('\\"', '"')
    )
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')}), lambda s: s <> '')"
    )


def tokens(x: str) -> str:
    return f"greatest(1, cast(ceil(length({x}) / 4.0) as int))"


def truncated(x: str, limit: str) -> str:
    words = rf"string_split_regex({strip(x)}, '\s+')"
    return (
        f"case when {strip(x)} = '' then '' when len({words}) <= {limit} then array_to_string({words}, ' ') "
        f"else array_to_string(({words})[1:{limit}], ' ') || ' …' end"
    )


def millionths(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: cast(round(cast(x as double) * 1e6) as bigint)), ',')"


def filename(number: str) -> str:
    return f"'doc_' || lpad(cast({number} as varchar), 12, '0') || '.pdf'"


PAGES = f"""
raw_pages as (
  select doc_id // 5 as doc_no, cast(doc_id % 5 + 1 as int) as page_number,
    case when doc_id % 7 = 6 then '' else
      (case when doc_id % 3 = 0 then '2.1 Scope and Terms' || chr(10) else '' end) ||
      replace(replace(replace(replace(text,
        '.' || chr(10), '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'KEY FINDINGS' || chr(10)),
        'tion ', 'ti-' || chr(10) || 'on '),
        ' the ', chr(9) || 'the   '),
        ', ', ',' || chr(7) || ' ') end as text
  from documents),
ids as (
  select doc_no, sha256(string_agg(sha256(text), '|' order by page_number)) as document_id
  from raw_pages group by doc_no),
pages as (
  select doc_no as upload_id, document_id, {filename("doc_no")} as filename, page_number, text
  from raw_pages join ids using (doc_no))"""

SINGLE = f"""
pages as (
  select doc_id as upload_id, sha256(text) as document_id, {filename("doc_id")} as filename,
    1 as page_number, text
  from documents)"""

FIRST_COPIES = f"""
pages as (
  select doc_id as upload_id, sha256(text) as document_id, {filename("doc_id")} as filename,
    1 as page_number, text
  from documents
  qualify row_number() over (partition by sha256(text) order by doc_id) = 1)"""

NORMAL = f"norm as (select * exclude (text), text as raw, {normalized('text')} as text from pages)"


def units(target: int) -> str:
    return rf"""
blocks as (
  select document_id, page_number, unnest(bl) as block, generate_subscripts(bl, 1) as block_no
  from (select *, list_filter(list_transform(string_split_regex(text, '\n\s*\n+'),
    lambda b: {strip("b")}), lambda b: b <> '') as bl from norm)),
lined as (
  select *, list_filter(list_transform(string_split(block, chr(10)), lambda l: {strip("l")}), lambda l: l <> '') as ls
  from blocks),
headed as (select *, {heading("ls[1]")} as heading from lined where len(ls) > 0),
sents as (
  select document_id, page_number, block_no, unnest(sl) as s, generate_subscripts(sl, 1) as sent_no
  from (select *, {sentence_list("para")} as sl
    from (select *, array_to_string(case when heading then ls[2:] else ls end, ' ') as para from headed)
    where para <> '')),
parts as (
  select document_id, page_number, block_no, sent_no, i as part_no,
    case when len(w) <= {target} then 'sentence' else 'word' end as kind,
    w[i * {target} + 1 : (i + 1) * {target}] as w
  from (select *, unnest(range((len(w) + {target} - 1) // {target})) as i
    from (select *, string_split_regex(s, '\s+') as w from sents))),
units as (
  select document_id, page_number, kind, len(w) as n, array_to_string(w, ' ') as text,
    row_number() over (partition by document_id, page_number order by block_no, sent_no, part_no) - 1 as unit_no,
    row_number() over (partition by document_id order by page_number, block_no, sent_no, part_no) as u
  from (
    select document_id, page_number, block_no, 0 as sent_no, 0 as part_no, 'section' as kind,
      string_split_regex(ls[1], '\s+') as w
    from headed where heading
    union all
    select document_id, page_number, block_no, sent_no, part_no, kind, w from parts))"""


def packed(target: int, overlap: int) -> str:
    flush = f"""{{'c': least({overlap}, a.c), 'real': false, 'w': a.w, 's': a.w - least({overlap}, a.c),
      'fu': a.i + 1, 'i': a.i, 'ov': least({overlap}, a.c) > 0, 'op': a.lp, 'lp': a.lp,
      'out': list_append(a.out, {{'s': a.s, 'e': a.w, 'fu': a.fu, 'lu': a.i, 'ov': a.ov, 'op': a.op}})}}"""
    append = """{'c': a.c + x.n, 'real': true, 'w': a.w + x.n, 's': a.s, 'fu': a.fu, 'i': a.i + 1,
      'ov': a.ov, 'op': a.op, 'lp': x.p, 'out': a.out}"""
    start = """{'c': 0::bigint, 'real': false, 'w': 0::bigint, 's': 0::bigint, 'fu': 1::bigint, 'i': 0::bigint,
      'ov': false, 'op': 0::bigint, 'lp': 0::bigint,
      'out': []::struct(s bigint, e bigint, fu bigint, lu bigint, ov boolean, op bigint)[]}"""
    return f"""
steps as (
  select document_id, list({{'t': t, 'n': n, 'k': kind, 'p': p}} order by u, t) as st
  from (select document_id, u, n::bigint as n, kind, page_number::bigint as p, unnest([1, 2, 3]) as t from units
    union all
    select document_id, max(u) + 1, 0, '', 0, 4 from units group by document_id)
  group by document_id),
docs as (
  select document_id, string_split(string_agg(text, ' ' order by u), ' ') as words,
    list(kind order by u) as kinds, list(page_number order by u) as ups
  from units group by document_id),
totals as (
  select document_id, min(filename) as filename, count(*) as page_total from norm group by document_id),
spans as (
  select document_id, unnest(out) as c, generate_subscripts(out, 1) as sequence
  from (select document_id, list_reduce(st, lambda a, x:
      case when x.t = 1 and a.real and (x.k = 'section' or a.c + x.n > {target}) then {flush}
        when x.t = 2 then {append}
        when x.t = 3 and a.c >= {target} then {flush}
        when x.t = 4 and a.real then {flush}
        else a end, {start}).out as out
    from steps)),
bodies as (
  select document_id, filename, sequence, page_total,
    array_to_string(words[c.s + 1 : c.e], ' ') as text, c.e - c.s as word_count,
    case when c.ov then least(c.op, ups[c.fu]) else ups[c.fu] end as start_page, ups[c.lu] as end_page,
    array_to_string(list_reduce(
      case when c.ov then ['overlap'] else []::varchar[] end || kinds[c.fu : c.lu],
      lambda a, x: case when list_contains(a, x) then a else list_append(a, x) end, []::varchar[]), '|')
      as source_boundaries
  from spans join docs using (document_id) join totals using (document_id)),
chunks as (
  select 'chunk_' || substr(sha256(concat_ws('|', document_id, sequence, start_page, end_page, text)), 1, 32) as chunk_id,
    document_id as document_fingerprint, filename, text, start_page, end_page, sequence, word_count,
    source_boundaries, page_total as document_page_count
  from bodies)"""


def chain(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


CHUNKS = (PAGES, NORMAL, units(T), packed(T, O))

LISTING = """
summaries as (
  select document_fingerprint as document_id, arg_min(filename, sequence) as filename,
    count(*) as chunk_count, greatest(max(end_page), max(document_page_count)) as page_count
  from chunks group by document_fingerprint)"""


def hashed(name: str, source: str, key: str, text: str) -> str:
    """Vectors of 128 floats for ``key`` and ``text`` of ``source``."""
    return f"""
{name}_tokens as (
  select {key} as k, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as tok from {source}),
{name}_buckets as (
  select tok, list_reduce(list_transform(string_split(tok, ''), lambda ch: ascii(ch)::bigint),
    lambda h, ch: (h * 31 + ch) % 128, 0::bigint) as b
  from (select distinct tok from {name}_tokens)),
{name}_counts as (
  select k, b, count(*) as n from {name}_tokens join {name}_buckets using (tok) group by k, b),
{name} as (
  select s.k, list(cast(case when z.norm = 0 then 0 else coalesce(c.n, 0) / z.norm end as float) order by r.b) as v
  from (select {key} as k from {source}) s
  join (select ks.k, sqrt(coalesce(sum(c.n * c.n), 0)) as norm
    from (select {key} as k from {source}) ks left join {name}_counts c using (k) group by ks.k) z using (k)
  cross join (select unnest(range(128)) as b) r
  left join {name}_counts c on c.k = s.k and c.b = r.b
  group by s.k)"""


TEMPLATES = strlist(t for t, _ in fx.TEMPLATES)
ROUTES = "[" + ", ".join(str(r).lower() for _, r in fx.TEMPLATES) + "]"
QUESTIONS = f"""
questions as (
  select item_id as question_id, text as question, false as expected from benchmark
  union all
  select conv_id * 1000 + turn + 1000000000, text, false from conversations
  union all
  select conv_id * 1000 + turn + 2000000000, ({TEMPLATES})[(conv_id * 7 + turn) % {len(fx.TEMPLATES)} + 1],
    ({ROUTES})[(conv_id * 7 + turn) % {len(fx.TEMPLATES)} + 1]
  from conversations)"""

VECTORS = """
vectors as (
  select vec_id as question_id, 'v' || vec_id as chunk_id, 'd' || (vec_id % 20) as document_fingerprint,
    vec_id // 20 + 1 as sequence, embedding, label from embeddings)"""


def distance(metric: str, a: str, b: str) -> str:
    a, b = f"cast({a} as double[])", f"cast({b} as double[])"
    dot = f"list_inner_product({a}, {b})"
    if metric == "ip":
        return f"1 - {dot}"
    if metric == "l2":
        return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)"
    scale = f"(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
    return f"case when {scale} = 0 then 1 else 1 - {dot} / {scale} end"


def ranked_vectors(metric: str) -> str:
    return f"""
scored as (
  select q.question_id, c.chunk_id, c.document_fingerprint, c.sequence, c.label, q.label as asked,
    {distance(metric, "q.embedding", "c.embedding")} as distance
  from vectors q join vectors c on q.question_id <> c.question_id),
cut as (
  select * from scored
  qualify row_number() over (
    partition by question_id order by distance, document_fingerprint, sequence, chunk_id) <= {fx.CFG.top_k}),
candidates as (
  select *, row_number() over (
    partition by question_id order by distance, sequence, document_fingerprint, chunk_id) as rank,
    document_fingerprint || ':' || chunk_id as source_id
  from cut)"""


SIX = "floor(distance * 1e6 + 0.5) / 1e6"


def knn(metric: str) -> str:
    return chain(VECTORS, ranked_vectors(metric)) + (
        f"select question_id, rank, chunk_id, source_id, {SIX} as distance from candidates"
    )


def retrieved(questions: str = "questions") -> str:
    return f"""
{hashed("cv", "chunks", "chunk_id", "text").strip()},
{hashed("qv", questions, "question_id", "question").strip()},
scored as (
  select q.k as question_id, c.chunk_id, c.document_fingerprint, c.filename, c.text, c.start_page, c.end_page,
    c.sequence, {distance("cosine", "q.v", "e.v")} as distance
  from qv q cross join cv e join chunks c on c.chunk_id = e.k),
cut as (
  select * from scored
  qualify row_number() over (
    partition by question_id order by distance, document_fingerprint, sequence, chunk_id) <= {fx.CFG.top_k}),
candidates as (
  select *, row_number() over (
    partition by question_id order by distance, sequence, document_fingerprint, chunk_id) as rank
  from cut)"""


def contexts(max_tokens: int) -> str:
    return f"""
accepted as (
  select *, {tokens("text")} as tokens from candidates where distance <= {fx.CFG.relevance_threshold}),
budgets as (
  select question_id, count(*) as accepted_count,
    list_reduce(list({{'r': rank, 't': tokens}} order by rank), lambda a, x:
      case when a.total + x.t <= {max_tokens}
        then {{'total': a.total + x.t, 'kept': list_append(a.kept, x.r)}} else a end,
      {{'total': 0::bigint, 'kept': []::bigint[]}}) as b
  from accepted group by question_id),
placed_blocks as (
  select a.*, row_number() over (
    partition by question_id order by filename, start_page, sequence, rank) as block_no
  from accepted a join budgets using (question_id) where list_contains(b.kept, rank)),
contexts as (
  select question_id, any_value(accepted_count) as accepted_count, any_value(b.total) as estimated_tokens,
    coalesce(string_agg(chunk_id, ',' order by block_no), '') as block_chunks,
    coalesce(string_agg(chunk_id, ',' order by rank), '') as source_chunks,
    coalesce(string_agg(cast(rank as varchar), ',' order by rank), '') as source_ranks,
    coalesce(string_agg(concat_ws(chr(10), '[SOURCE ' || block_no || ']',
      'source_id: ' || document_fingerprint || ':' || chunk_id, 'filename: ' || filename,
      'pages: ' || start_page || '-' || end_page, 'chunk_id: ' || chunk_id, 'sequence: ' || sequence,
      'distance: ' || printf('%.6f', distance), 'text:', '<document_chunk>', text, '</document_chunk>'),
      chr(10) || chr(10) order by block_no), '') as rendered
  from budgets left join placed_blocks using (question_id) group by question_id)"""


def positions(total: str, limit: str) -> str:
    return (
        f"case when {total} <= {limit} then range({total}) else "
        f"list_transform(range({limit}), lambda i: cast(round_even(cast(i as double) * ({total} - 1) / ({limit} - 1), 0) as bigint)) end"
    )


W, M = fx.CFG.overview_excerpt_words, fx.CFG.overview_max_chunks_per_document
OVERVIEW = f"""
{LISTING.strip()},
shown as (
  select *, row_number() over (order by lower(filename), document_id) as doc_index,
    (select count(*) from summaries) as total_documents
  from summaries order by lower(filename), document_id limit {fx.CFG.overview_max_documents}),
budgeted as (
  select *, greatest(400, {fx.CFG.max_context_tokens} // (select count(*) from shown)) as token_budget,
    greatest(3, least({M}, {2 * M} // (select count(*) from shown))) as chunk_limit
  from shown),
placed as (
  select *, row_number() over (partition by document_fingerprint order by sequence) - 1 as position
  from chunks),
sampled as (
  select b.*, p.position, p.chunk_id, p.sequence, p.start_page, p.end_page,
    {truncated("p.text", f"(case when p.position = 0 then {2 * W} else {W} end)")} as text
  from (select *, {positions("chunk_count", "chunk_limit")} as picks from budgeted) b
  join placed p on p.document_fingerprint = b.document_id and list_contains(b.picks, p.position)),
weighed as (select *, {tokens("text")} as tokens from sampled),
trimmed as (
  select document_id, list_reduce(range({M}), lambda a, i:
      case when len(a) > 2 and list_sum(list_transform(a, lambda e: e.t)) > any_budget
        then a[1 : len(a) // 2] || a[len(a) // 2 + 2 :] else a end, items) as kept
  from (select document_id, any_value(token_budget) as any_budget,
      list({{'p': position, 't': tokens}} order by position) as items
    from weighed group by document_id)),
excerpts as (
  select w.*, row_number() over (order by doc_index, position) as rank
  from weighed w join trimmed t using (document_id)
  where list_contains(list_transform(t.kept, lambda e: e.p), w.position)),
view as (
  select
    (select sum(tokens)::bigint from excerpts) as estimated_tokens,
    (select count(*) from excerpts) as shown_excerpts,
    any_value(total_documents) as total_documents,
    concat_ws(chr(10), '<document_profile>', 'indexed_documents_total: ' || any_value(total_documents),
      case when any_value(total_documents) > count(*) then
        'documents_shown_below: ' || count(*) || ' (the rest are omitted for length)' end,
      string_agg('document ' || doc_index || ': filename=' || filename || ' | total_pages=' ||
        case when page_count <> 0 then cast(page_count as varchar) else 'unknown' end ||
        ' | indexed_sections=' || chunk_count || ' | excerpts_shown=' ||
        (select count(*) from excerpts e where e.document_id = s.document_id), chr(10) order by doc_index),
      '</document_profile>') || chr(10) || chr(10) ||
    (select string_agg(concat_ws(chr(10), '[EXCERPT document ' || doc_index || ': ' || filename || ']',
      'pages: ' || start_page || '-' || end_page, 'position: section ' || (position + 1) || ' of ' || chunk_count,
      '<document_chunk>', text, '</document_chunk>'), chr(10) || chr(10) order by rank) from excerpts) as rendered
  from shown s)"""


def answer_sql(max_tokens: int, fallback: bool) -> str:
    first_line = f"{lit(prompts.ECHO_PREFIX)} || (regexp_split_to_array({strip('question')}, '\\r\\n|\\r|\\n'))[1]"
    overview_columns = (
        f"{first_line} as answer, 'answered' as status, 'document_overview' as mode, "
        "v.shown_excerpts as candidate_count, v.shown_excerpts as accepted_count, v.shown_excerpts as top_k, "
        "v.estimated_tokens as context_token_estimate, "
        "(select string_agg(chunk_id, ',' order by rank) from excerpts) as source_chunks, "
        "(select string_agg(cast(rank as varchar), ',' order by rank) from excerpts) as source_ranks"
    )
    top = f"least({fx.CFG.top_k}, found)"
    abstain = f"{lit(prompts.ABSTENTION_MESSAGE)} as answer, 'abstained' as status, 'retrieval' as mode"
    unanswered = (
        f"select question_id, {overview_columns} from state cross join view v where not expected and accepted_count = 0"
        if fallback
        else f"select question_id, {abstain}, found, 0, {top}, 0, '', '' from state "
        "where not expected and accepted_count = 0"
    )
    return (
        chain(*CHUNKS, QUESTIONS, retrieved(), contexts(max_tokens), OVERVIEW)
        + f""",
found as (select question_id, count(*) as found from candidates group by question_id),
state as (
  select q.*, f.found, coalesce(c.accepted_count, 0) as accepted_count, c.estimated_tokens, c.block_chunks,
    c.source_chunks, c.source_ranks
  from questions q join found f using (question_id) left join contexts c using (question_id)),
everything as (
  select question_id, {overview_columns} from state cross join view v where expected
  union all {unanswered}
  union all
  select question_id, {abstain}, found, accepted_count, {top}, 0, '', ''
  from state where not expected and accepted_count > 0 and block_chunks = ''
  union all
  select question_id, {first_line}, 'answered', 'retrieval', found, accepted_count, {top}, estimated_tokens,
    source_chunks, source_ranks
  from state where not expected and accepted_count > 0 and block_chunks <> '')
select *, cast({fx.CFG.relevance_threshold} as double) as relevance_threshold from everything"""
    )


CHUNK_SELECT = "select * from chunks"

DAMAGED = """
damaged as (
  select * exclude (embedding), case question_id % 6 when 0 then null when 1 then []::float[]
    when 2 then list_append(embedding, 'nan'::float) when 3 then list_append(embedding, 'inf'::float)
    when 4 then list_append(embedding, 0.5::float) else embedding end as embedding
  from vectors),
judged as (
  select *, embedding is null or len(embedding) = 0
    or len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 as invalid
  from damaged)"""

RAW_QUESTIONS = """
raw_questions as (
  select conv_id * 1000 + turn as question_id,
    case (conv_id * 3 + turn) % 7 when 0 then null when 1 then '' when 2 then ' ' || chr(10) || chr(9) || ' '
      when 3 then '  ' || text || chr(10)
      when 4 then repeat(text || '?', cast(floor(10000 / length(text)) as int) + 1) else text end as question
  from conversations)"""

_KIND = "doc_id % 13"
FILES = f"""
files as (
  select doc_id,
    case {_KIND} when 6 then '  ' when 7 then ' C:\\in\\Report ' || doc_id || '.PDF ' when 8 then doc_id || '.txt'
      when 9 then 'folder/' || doc_id || '/' else 'up/' || doc_id || '.pdf' end as filename,
    case {_KIND} when 10 then 'Application/PDF; charset=binary' when 11 then 'text/plain'
      when 12 then ' application/octet-stream ' when 7 then '' else 'application/pdf' end as content_type,
    case {_KIND} when 0 then null when 1 then '' when 2 then text
      when 3 then repeat('x', 900) || '%PDF-1.7 ' || text when 4 then repeat('x', 1030) || '%PDF-1.7 ' || text
      when 5 then '%PDF-1.4 ' || repeat(text, 12) else '%PDF-1.4' || chr(10) || text end as content
  from documents),
named as (
  select *, {strip(f"regexp_replace(replace({strip('filename')}, chr(92), '/'), '^.*/', '')")} as clean,
    case when {strip("content_type")} <> '' then
      {strip(f"string_split(lower({strip('content_type')}), ';')[1]")} end as bare
  from files)"""

_CODE_CASE = "case when pick < {n} then ({codes})[pick + 1] end"
ERRORS = f"""
errors as (
  select event_id, {_CODE_CASE.format(n=len(fx.ERROR_CODES), codes=strlist(fx.ERROR_CODES))} as error_code,
    ({fx.ERROR_STATUSES})[event_id // {len(fx.ERROR_CODES) + 1} % {len(fx.ERROR_STATUSES)} + 1] as http_status,
    case when event_type = 'error' then 'TimeoutError' end as error_name,
    case when event_type = 'view' then 'Server says no.' else '' end as said
  from (select *, event_id % {len(fx.ERROR_CODES) + 1} as pick from events)),
kinds as (
  select *, coalesce(error_code, 'NETWORK_ERROR') as code,
    case when error_code is null and http_status in (502, 503, 504) then 'waking'
      when http_status = 413 then 'large' when error_name = 'TimeoutError' or http_status = 0 then 'silent' end as first,
    case when error_code in ({", ".join(lit(c) for c in admission.FILE_CODES)}) then 'file-validation'
      when error_code in ({", ".join(lit(c) for c in admission.EXTRACTION_CODES)}) then 'document-extraction'
      when error_code in ({", ".join(lit(c) for c in admission.RATE_CODES)}) then 'rate-limited'
      when starts_with(error_code, 'EMBEDDING_') or error_code in ('NO_CHUNKS_CREATED', 'INDEXING_FAILED')
        or starts_with(error_code, 'INDEX_') then 'document-ingestion'
      when error_code in ('NO_DOCUMENTS_INDEXED', 'INVALID_RETRIEVAL_DISTANCE')
        or starts_with(error_code, 'RETRIEVAL_') then 'retrieval-unavailable'
      when starts_with(error_code, 'GENERATION_') then 'generation-unavailable' else 'unknown' end as family
  from errors),
triaged as (
  select event_id,
    case first when 'waking' then 'backend-unavailable' when 'silent' then 'backend-unavailable'
      when 'large' then 'file-validation' else family end as category,
    case first when 'waking' then 'HTTP_' || http_status when 'large' then 'FILE_TOO_LARGE' else code end as shown_code,
    case when first is null and said <> '' then said else
      map {{{", ".join(f"{lit(k)}: {lit(v)}" for k, v in admission.MESSAGES.items())}}}[coalesce(first, family)] end
      as shown_message,
    coalesce(first, family) not in ('large', 'file-validation', 'document-extraction') as retryable
  from kinds)"""

LOG = f"""
log as (
  select *, map {{{", ".join(f"{lit(k)}: {lit(v)}" for k, v in fx.EVENT_NAMES.items())}}}[event_type] as event,
    case when event_type = 'error' then 'WARNING' else 'INFO' end as level
  from events),
stages as (
  select event, unnest(['validation_ms', 'retrieval_ms', 'generation_ms', 'total_ms']) as stage,
    unnest([value, round(value * 2, 2), round(value * 3, 2), round(value * 6, 2)]) as ms
  from log where event_type <> 'signup')"""

_DONE = "event_type in ('view', 'purchase', 'error')"

_ALLOWED = ", ".join(lit(t) for t in admission.ALLOWED_CONTENT_TYPES)
_STATUSES = "map {" + ", ".join(f"{lit(k)}: {v}" for k, v in admission.STATUS_OF.items()) + "}"
_TYPO_MAP = "map {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in TYPOS.items()) + "}"


ORACLES: dict[str, str] = {
    "normalized_pages": chain(PAGES, NORMAL)
    + f"select document_id, page_number, text, {strip('raw')} = '' as empty, text = '' as blank from norm",
    "scanned_pages": chain(PAGES, NORMAL)
    + f"select document_id, page_number, text, {strip('raw')} = '' as empty, text = '' as blank from norm",
    "page_text_units": chain(PAGES, NORMAL, units(T))
    + "select document_id, page_number, unit_no, kind, n, text from units",
    "headings": chain(PAGES, NORMAL)
    + f", lines as (select unnest(list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), "
    f"lambda l: l <> '')) as line from norm) "
    f"select line, {heading('line')} as heading, count(*) as lines from lines group by all",
    "text_scalars": "select doc_id, sha256(text) as fingerprint, "
    rf"{tokens('text')} as tokens, len(string_split_regex({strip('text')}, '\s+')) as words, "
    f"len({sentence_list('text')}) as sentences, {truncated('text', '40')} as excerpt from documents",
    "document_chunks": chain(*CHUNKS) + CHUNK_SELECT,
    "long_document_chunks": chain(*CHUNKS) + CHUNK_SELECT,
    "single_page_chunks": chain(FIRST_COPIES, NORMAL, units(500), packed(500, 50)) + CHUNK_SELECT,
    "long_page_chunks": chain(FIRST_COPIES, NORMAL, units(500), packed(500, 50)) + CHUNK_SELECT,
    "page_labels": chain(*CHUNKS)
    + "select chunk_id, case when start_page = end_page then 'p. ' || start_page "
    "else 'pp. ' || start_page || '–' || end_page end as label, "
    "document_fingerprint || ':' || chunk_id as source_id from chunks",
    "document_gate": chain(PAGES, NORMAL)
    + f"select document_id, min(filename) as filename, count(*) as page_count, "
    f"count(*) filter ({strip('raw')} = '') as empty_page_count, "
    "case when bool_or(text <> '') then '' else 'NO_EXTRACTABLE_TEXT' end as error_code from norm group by document_id",
    "page_gate": chain(PAGES, NORMAL)
    + f"select document_id || '#' || page_number as document_id, case when {strip('raw')} = '' then 1 else 0 end "
    "as empty_page_count, case when text <> '' then '' else 'NO_EXTRACTABLE_TEXT' end as error_code, "
    "case when text <> '' then 0 else 422 end as error_status from norm",
    "file_admission": chain(FILES)
    + f"""select doc_id, clean as clean_filename, coalesce(bare, '') as bare_type, coalesce(code, '') as error_code,
      coalesce({_STATUSES}[code], 0) as error_status
    from (select *, case when content is null then 'MISSING_FILE' when content = '' then 'EMPTY_FILE'
        when strlen(content) > {fx.FILE_CFG.max_upload_size_bytes} then 'FILE_TOO_LARGE'
        when clean = '' then 'MISSING_FILENAME' when not ends_with(lower(clean), '.pdf') then 'INVALID_FILENAME'
        when bare is not null and bare not in ({_ALLOWED}) then 'INVALID_CONTENT_TYPE'
        when not contains(content[1:1024], '%PDF-') then 'INVALID_PDF_SIGNATURE' end as code from named)""",
    "question_validation": chain(RAW_QUESTIONS)
    + f"""select question_id, coalesce({strip("question")}, '') as cleaned,
      case when detail <> '' then 'VALIDATION_ERROR' when {strip("question")} = '' then 'EMPTY_QUESTION' else '' end
        as error_code,
      case when detail <> '' then 422 when {strip("question")} = '' then 400 else 0 end as error_status, detail
    from (select *, case when question is null then 'missing' when question = '' then 'string_too_short'
      when length(question) > 10000 then 'string_too_long' else '' end as detail from raw_questions)""",
    "engine_question_validation": chain(RAW_QUESTIONS)
    + f"""select error_code, {_STATUSES}[error_code] as error_status, count(*) as questions
    from (select case when question is null then 'QUESTION_REQUIRED' when {strip("question")} = '' then 'EMPTY_QUESTION'
      when length({strip("question")}) > 10000 then 'QUESTION_TOO_LONG' else 'NO_DOCUMENTS_INDEXED' end as error_code
      from raw_questions) group by error_code""",
    "question_requests": "select conv_id * 1000 + turn as question_id, "
    "case when (conv_id + turn) % 5 = 0 then text else '' end as question, "
    "case (conv_id + turn) % 5 when 0 then 'string' when 1 then 'other' else 'missing' end as question_type "
    "from conversations",
    "error_triage": chain(ERRORS) + "select * from triaged",
    "error_summary": chain(ERRORS)
    + "select category, retryable, count(*) as errors from triaged group by category, retryable",
    "hash_embedding": chain(SINGLE, hashed("e", "pages", "upload_id", "text"))
    + f"select k as upload_id, {millionths('v')} as vector from e",
    "unit_vectors": chain(VECTORS)
    + f"""select chunk_id, {millionths("list_transform(h, lambda x: cast(x / norm as float))")} as vector
    from (select *, sqrt(list_inner_product(cast(h as double[]), cast(h as double[]))) as norm
      from (select *, list_transform(embedding, lambda x, i: cast(x * ((i - 1) % 3) as float)) as h from vectors))""",
    "vector_validity": chain(VECTORS, DAMAGED)
    + """select chunk_id, case when invalid then 'EMBEDDING_INVALID_VALUE'
      when len(embedding) <> 64 then 'INDEX_EMBEDDING_DIMENSION_CONFLICT' else '' end as error_code,
      case when invalid then 502 when len(embedding) <> 64 then 409 else 0 end as error_status from judged""",
    "dimension_check": chain(VECTORS, DAMAGED)
    + """select document_fingerprint, count(*) as vectors, count(*) filter (invalid) as invalid_vectors,
      case when bool_or(invalid) then 'EMBEDDING_INVALID_VALUE'
        when min(len(embedding)) <> max(len(embedding)) then 'INDEX_EMBEDDING_DIMENSION_MISMATCH'
        when min(len(embedding)) <> 64 then 'INDEX_EMBEDDING_DIMENSION_CONFLICT' else '' end as error_code
    from judged group by document_fingerprint""",
    "vector_pairing": chain(VECTORS)
    + """select document_fingerprint, count(*) as chunks, count(*) filter (embedding[1] > 0) as vectors,
      count(distinct label > 7) filter (embedding[1] > 0) > 1 as mixed
    from vectors group by document_fingerprint having chunks <> vectors""",
    "knn_cosine": knn("cosine"),
    "knn_l2": knn("l2"),
    "knn_ip": knn("ip"),
    "knn_grid": knn("cosine"),
    "relevance_accept": chain(VECTORS, ranked_vectors("cosine"))
    + f"select question_id, rank, chunk_id, {SIX} as distance from candidates where distance <= 0.6",
    "threshold_sweep": chain(VECTORS, ranked_vectors("cosine"))
    + f"""select threshold, count(*) as pairs, count(*) filter (distance <= threshold) as accepted,
      count(*) filter (distance <= threshold and label = asked) as accepted_relevant,
      round(count(*) filter (distance <= threshold) / count(*), 6) as acceptance_rate,
      coalesce(round(count(*) filter (distance <= threshold and label = asked)
        / nullif(count(*) filter (distance <= threshold), 0), 6), -1) as "precision",
      round(count(*) filter (distance <= threshold and label = asked) / count(*) filter (label = asked), 6) as recall
    from candidates cross join (select unnest({fx.THRESHOLDS}::double[]) as threshold) group by threshold""",
    "document_summaries": chain(*CHUNKS, LISTING)
    + "select *, (select sum(chunk_count)::bigint from summaries) as total_chunks from summaries",
    "corpus_summary": chain(*CHUNKS, LISTING)
    + """select count(*) as documents, sum(chunk_count)::bigint as chunks, sum(page_count)::bigint as pages,
      case count(*) when 0 then 'None indexed' when 1 then min(filename) else count(*) || ' documents' end as label
    from summaries""",
    "corpus_signature": """with bins as (
      select substr(sha256(id), 1, 4) as bin, count(*) as n, sha256(string_agg(id, '|' order by id)) as digest
      from (select distinct sha256(text) as id from documents) group by bin)
    select sum(n)::bigint as documents, sha256(string_agg(digest, '|' order by bin)) as signature from bins""",
    "store_dimension": "select count(*) as chunks, max(len(embedding)) as dimension from embeddings",
    "ingest_dedup": chain(FIRST_COPIES, NORMAL, units(T), packed(T, O))
    + f""", counts as (select document_fingerprint as document_id, max(sequence) as n from chunks group by all)
    select upload_id, document_id, filename, 1 as page_count, case when {strip("text")} = '' then 1 else 0 end
      as empty_page_count, n as chunk_count, n as indexed_count, case when first then 'indexed' else 'already_indexed' end
      as status, case when first then 'Document ingestion completed successfully. 1 pages processed, ' || n ||
        ' chunks created, ' || n || ' vectors indexed.' else
        'This document is already indexed. No duplicate embedding or indexing was performed.' end as message,
      '' as error_code
    from (select doc_id as upload_id, sha256(text) as document_id, {filename("doc_id")} as filename, text,
        row_number() over (partition by sha256(text) order by doc_id) = 1 as first from documents)
    join counts using (document_id)""",
    "ingest_files": chain(FIRST_COPIES, NORMAL, units(T), packed(T, O), FILES)
    + f""", judged as (
      select *, 'in/' || doc_id as upload_id, case when content is null then 'MISSING_FILE' when content = '' then 'EMPTY_FILE'
        when strlen(content) > {fx.UPLOAD_CFG.max_upload_size_bytes} then 'FILE_TOO_LARGE'
        when clean = '' then 'MISSING_FILENAME' when not ends_with(lower(clean), '.pdf') then 'INVALID_FILENAME'
        when bare is not null and bare not in ({_ALLOWED}) then 'INVALID_CONTENT_TYPE'
        when not contains(content[1:1024], '%PDF-') then 'INVALID_PDF_SIGNATURE' when doc_id % 10 = 3 then 'NO_EXTRACTABLE_TEXT'
        end as code from named),
    counts as (select document_fingerprint as text_id, max(sequence) as n from chunks group by all),
    known as (
      select j.*, coalesce(case when code is null or code = 'NO_EXTRACTABLE_TEXT' then sha256(content) end, '') as document_id,
        code is null and coalesce(n, 0) = 0 as blank, coalesce(n, 0) as n
      from judged j join documents using (doc_id) left join counts on text_id = sha256(text)),
    placed as (
      select *, code is null and not blank
        and row_number() over (partition by document_id, code is null and not blank order by upload_id) = 1 as first from known)
    select upload_id, document_id, clean as filename, case when code is null then 1 else 0 end as page_count,
      case when code is null then n else 0 end::int as chunk_count, case when code is null then n else 0 end::int as indexed_count,
      case when code is not null or blank then 'rejected' when first then 'indexed' else 'already_indexed' end as status,
      case when code is not null then code when blank then 'NO_EXTRACTABLE_TEXT' when first then
        'Document ingestion completed successfully. 1 pages processed, ' || n || ' chunks created, ' || n || ' vectors indexed.'
        else 'This document is already indexed. No duplicate embedding or indexing was performed.' end as message,
      case when code is not null then code when blank then 'NO_EXTRACTABLE_TEXT' else '' end as error_code
    from placed""",
    "embedder_faults": f"""with asked as (
      select doc_id, length({strip("text")}) as n, {strip("text")} = '' or doc_id % 17 = 0 as blank from documents
    ), judged as (
      select doc_id, n, case when blank then 'EMPTY_EMBEDDING_INPUT' when n % 11 = 0 then 'EMBEDDING_PROVIDER_ERROR'
        when n % 11 = 1 then 'EMBEDDING_TIMEOUT' when n % 11 = 2 then 'EMBEDDING_COUNT_MISMATCH'
        when n % 11 = 3 then 'EMBEDDING_INVALID_VALUE' when n % 11 = 4 then 'EMBEDDING_DIMENSION_MISMATCH' else '' end as error_code
      from asked)
    select doc_id, error_code, case error_code when '' then 0 when 'EMPTY_EMBEDDING_INPUT' then 400 else 502 end as error_status,
      case when error_code = '' then n else -1 end::int as first from judged""",
    "uploads_chosen": """select sha256(text) as document_id, min(doc_id) as upload_id from documents
    group by sha256(text) having not bool_or(lang = 'fr')""",
    "store_round_trip": chain(VECTORS)
    + f"""select chunk_id, document_fingerprint || '-' || label as document_fingerprint, sequence,
      {millionths("embedding")} as vector from vectors where label not in (2, 7)""",
    "store_append_twice": chain(*CHUNKS) + CHUNK_SELECT,
    "refused_appends": chain(VECTORS)
    + """select distinct document_fingerprint, 'DOCUMENT_ALREADY_INDEXED' as error_code from vectors
    where sequence % 2 = 0 and document_fingerprint < 'd15'""",
    "question_vectors": chain(VECTORS, DAMAGED)
    + f"""select question_id, case when invalid or len(embedding) <> 64 then 0
        else least({fx.CFG.top_k}, (select count(*) from vectors)) end::int as neighbours,
      case when invalid then 'EMBEDDING_INVALID_VALUE'
        when len(embedding) <> 64 then 'INDEX_EMBEDDING_DIMENSION_CONFLICT' else '' end as error_code,
      case when invalid then 502 when len(embedding) <> 64 then 409 else 0 end as error_status from judged""",
    "index_with_vectors": """with placed as (
      select vec_id, vec_id // 7 as unit, vec_id // 7 % 9 as kind, vec_id % 7 as place, embedding from embeddings
    ), chunks as (
      select unit, 'v' || vec_id as chunk_id, case when kind = 6 and place = 0 then 'other'
        when kind = 8 then 'u' || (unit - 8) else 'u' || unit end as doc from placed where kind <> 5
    ), vectors as (
      select unit, case when kind = 4 and place = 0 then 'stranger' else '' end || 'v' || vec_id as chunk_id, embedding,
        kind = 2 and place = 0 as bad, vec_id from placed where kind <> 3 or place <> 0
      union all select unit, 'v' || vec_id, embedding, false, vec_id from placed where kind = 7 and place = 1
    ), sizes as (
      select unit, (select count(*) from chunks c where c.unit = p.unit) as chunk_count,
        (select count(*) from vectors v where v.unit = p.unit) as vector_count,
        (select count(distinct doc) from chunks c where c.unit = p.unit) as docs,
        (select min(doc) from chunks c where c.unit = p.unit) as doc,
        (select count(*) from chunks c join vectors v using (unit, chunk_id) where c.unit = p.unit) as pairs,
        (select bool_or(bad) from vectors v where v.unit = p.unit) as bad,
        (select sum(cast(round(cast(embedding[1] as double) * 1e6) as bigint) * vec_id) from vectors v where v.unit = p.unit) as total
      from (select distinct unit from placed) p
    ), checked as (
      select *, case when chunk_count = 0 then 'NO_CHUNKS_TO_INDEX'
        when not (chunk_count = vector_count and pairs = chunk_count) then 'CHUNK_EMBEDDING_COUNT_MISMATCH'
        when docs > 1 then 'MIXED_DOCUMENT_CHUNKS' else '' end as pairing from sizes
    ), judged as (
      select *, case when pairing <> '' then pairing
        when row_number() over (partition by doc, pairing = '' order by unit) > 1 then 'DOCUMENT_ALREADY_INDEXED'
        when bad then 'EMBEDDING_INVALID_VALUE' else '' end as error_code from checked
    )
    select unit as batch_id, chunk_count, vector_count, case when error_code = '' then chunk_count else 0 end as indexed_count,
      error_code, case error_code when '' then 0 when 'NO_CHUNKS_TO_INDEX' then 422 when 'DOCUMENT_ALREADY_INDEXED' then 409
        when 'EMBEDDING_INVALID_VALUE' then 502 else 500 end as error_status,
      case when error_code = '' then total::bigint else 0 end as checksum from judged""",
    "document_lookup": chain(*CHUNKS, LISTING)
    + """select chunk_id, document_fingerprint, sequence, text, chunk_count, page_count
    from chunks join summaries on document_id = document_fingerprint
    where substr(document_fingerprint, 3, 1) < '5' and substr(document_fingerprint, 2, 1) not in ('2', '3')""",
    "store_reset": chain(VECTORS)
    + """select document_fingerprint as document_id, document_fingerprint || '.pdf' as filename, count(*)::int as chunk_count,
      1 as page_count, sum(count(*)) over ()::bigint as total_chunks
    from vectors where document_fingerprint < 'd15' group by document_fingerprint""",
    "store_overview": chain(*CHUNKS, OVERVIEW)
    + "select total_documents, estimated_tokens, rendered from view",
    "absent_inserts": chain(VECTORS)
    + "select chunk_id, document_fingerprint, sequence from vectors where label > 3 and not label < 6",
    "count_verification": chain(VECTORS)
    + """select document_fingerprint, count(*) as expected, count(*) filter (label <> 3) as actual,
      'INDEX_COUNT_MISMATCH' as error_code
    from vectors group by document_fingerprint having expected <> actual""",
    "diagnostics": chain(*CHUNKS, QUESTIONS, retrieved())
    + f"""select question_id, any_value(length(question)) as question_length, count(*) as candidate_count,
      count(*) filter (ok) as accepted_count, {fx.CFG.relevance_threshold}::double as threshold,
      string_agg(cast(cast(floor(distance * 1e6 + 0.5) as bigint) as varchar), ',' order by rank) as distances,
      coalesce(string_agg(cast(rank as varchar), ',' order by rank) filter (ok), '') as accepted_ranks,
      coalesce(string_agg(chunk_id, ',' order by rank) filter (ok), '') as accepted_chunk_ids
    from (select *, distance <= {fx.CFG.relevance_threshold} as ok from candidates) join questions using (question_id)
    group by question_id""",
    "context_budget": chain(*CHUNKS, QUESTIONS, retrieved(), contexts(fx.CFG.max_context_tokens))
    + "select question_id, accepted_count, estimated_tokens, block_chunks, source_chunks, source_ranks from contexts",
    "context_rendered": chain(*CHUNKS, QUESTIONS, retrieved(), contexts(fx.CFG.max_context_tokens))
    + "select question_id, rendered from contexts",
    "retrieval_quality": chain(*CHUNKS, QUESTIONS, retrieved())
    + f""", results as (
      select distinct question_id, document_fingerprint from candidates
      where distance <= {fx.CFG.relevance_threshold}),
    spaced as (select distinct document_fingerprint, ' ' || {words_apart("text")} || ' ' as said from chunks),
    passages as (select distinct question, ' ' || {words_apart("question")} || ' ' as said from questions
      where {words_apart("question")} <> ''),
    held as (select distinct p.question, s.document_fingerprint from passages p join spaced s on contains(s.said, p.said)),
    asked as (
      select question_id, case when question_id < 1000000000 then 'passage' when question_id < 2000000000 then 'turn'
        else 'template' end as scenario, question from questions),
    judged as (
      select scenario,
        (select count(*) from held h where h.question = a.question) as wanted,
        (select count(*) from results r where r.question_id = a.question_id) as retrieved,
        (select count(*) from results r join held h using (document_fingerprint)
          where r.question_id = a.question_id and h.question = a.question) as good
      from asked a)
    select scenario, count(*) as questions,
      count(*) filter (case when wanted > 0 then good > 0 else retrieved = 0 end) as hits,
      round(count(*) filter (case when wanted > 0 then good > 0 else retrieved = 0 end) / count(*), 6) as hit_rate,
      coalesce(round(sum(good) / nullif(sum(retrieved), 0), 6), -1) as precision_at_k
    from judged group by scenario""",
    "overview_positions": chain(*CHUNKS, LISTING)
    + f"select document_id, chunk_count, array_to_string({positions('chunk_count', '4')}, ',') as positions from summaries",
    "overview_excerpts": chain(*CHUNKS, OVERVIEW)
    + "select doc_index, document_id, token_budget, total_documents, position, chunk_id, text, tokens from excerpts",
    "overview_sources": chain(*CHUNKS, OVERVIEW)
    + "select rank, document_id || ':' || chunk_id as source_id, filename, chunk_id, start_page, end_page, sequence, "
    "0.0::double as distance from excerpts",
    "overview_rendered": chain(*CHUNKS, OVERVIEW)
    + "select total_documents, estimated_tokens, rendered from view",
    "question_folding": chain(QUESTIONS)
    + rf""", plain as (
      select question_id, {strip(r"regexp_replace(regexp_replace(translate(lower(nfc_normalize(question)), '’`‘', ''''''''), '[*_#>~|]+', ' ', 'g'), '\s+', ' ', 'g')")} as t
      from questions)
    select question_id, coalesce(array_to_string(list_transform(regexp_extract_all(t, '[a-z'']+|[^a-z'']+'),
      lambda w: coalesce({_TYPO_MAP}[w], w)), ''), '') as folded from plain""",
    "grounded_prompts": f"""select conv_id, turn,
      sha256({lit(prompts.GROUNDING_SYSTEM_PROMPT)} || '<user_question>' || chr(10) || text || chr(10) ||
        '</user_question>' || chr(10) || chr(10) || '<document_evidence>' || chr(10) || {lit(prompts.EVIDENCE_NOTE)} ||
        text || chr(10) || '</document_evidence>' || chr(10) || chr(10) || {lit(prompts.EVIDENCE_REQUEST)}) as grounded,
      sha256({lit(prompts.DOCUMENT_LEVEL_SYSTEM_PROMPT)} || case when turn % 2 = 0 then chr(10) ||
        {lit(prompts.DOCUMENT_LEVEL_FALLBACK_RULE)} else '' end || '<user_question>' || chr(10) || text || chr(10) ||
        '</user_question>' || chr(10) || chr(10) || '<document_overview>' || chr(10) || {lit(prompts.EVIDENCE_NOTE)} ||
        text || chr(10) || '</document_overview>' || chr(10) || chr(10) || {lit(prompts.OVERVIEW_REQUEST)})
        as document_level,
      {lit(prompts.ECHO_PREFIX)} || (regexp_split_to_array(text, '\\r\\n|\\r|\\n'))[1] as answer,
      turn % 2 = 0 as abstained
    from conversations""",
    "answers": answer_sql(fx.CFG.max_context_tokens, True),
    "answer_json": answer_sql(fx.CFG.max_context_tokens, True),
    # The route of every question is known beforehand.
    "question_route": chain(QUESTIONS)
    + "select question_id, expected as document_level, true as as_expected from questions",
    "answers_without_fallback": answer_sql(fx.NO_FALLBACK.max_context_tokens, False),
    "stage_timings": chain(LOG)
    + """select event, stage, count(*) as events, round(avg(ms), 4) as mean_ms, quantile_disc(ms, 0.5) as p50_ms,
      quantile_disc(ms, 0.95) as p95_ms, max(ms) as max_ms from stages group by event, stage""",
    "query_outcomes": chain(LOG)
    + f"""select count(*) as questions, count(*) filter (event_type = 'error') as abstained,
      round(count(*) filter (event_type = 'error') / count(*), 6) as abstention_rate,
      round(sum(round(value * 2, 2)), 2) as retrieval_ms, round(sum(round(value * 3, 2)), 2) as generation_ms
    from log where {_DONE}""",
    "event_counts": chain(LOG)
    + """select event, level, count(*) as events,
      coalesce(round(avg(case when event_type = 'signup' then value end), 4), -1) as mean_latency_ms
    from log group by event, level""",
    "scanned_log": chain(LOG)
    + """select event, level, count(*) as events,
      coalesce(round(avg(case when event_type = 'signup' then value end), 4), -1) as mean_latency_ms
    from log group by event, level""",
    "stream_ingest": chain(*CHUNKS) + CHUNK_SELECT,
    "stream_split_documents": chain(*CHUNKS) + CHUNK_SELECT,
    "stream_two_sources": chain(*CHUNKS) + CHUNK_SELECT,
    "stream_answers": answer_sql(fx.CFG.max_context_tokens, True),
}

"""Pieces of DuckDB SQL that state the library's steps over the driver's tables."""

from __future__ import annotations

PATH = "case when doc_id % 10 = 0 then 'tests/' else '' end || source || '/doc_' || cast(doc_id as varchar) || '.py'"
FILES = f"files as (select 'docs' as corpus_id, {PATH} as file_path, text from documents)"


def tokens(text: str) -> str:
    """List of tokens of an ASCII or accented text."""
    camel = r"regexp_replace(regexp_replace(t, '(.)([A-Z][a-z]+)', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    parts = f"list_filter(string_split_regex(lower({camel}), '[_ ]+'), lambda p: p <> '')"
    return (
        f"flatten(list_transform(regexp_extract_all({text}, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+'), lambda t: "
        f"case when regexp_matches(t, '^[0-9]') then [t] when trim(t, '_') = '' then [] "
        f"else list_distinct(list_concat([lower(trim(t, '_'))], {parts})) end))"
    )


def chunks(size: int, overlap: int, source: str = "files") -> str:
    step = size - overlap
    return f"""
lines_{size} as (select corpus_id, file_path, case when ls[-1] = '' then ls[:-2] else ls end as l
  from (select *, string_split(text, chr(10)) as ls from {source})),
starts_{size} as (select *, unnest(range(0, greatest(len(l) - {overlap} - 1, 0) + 1, {step})) as spot from lines_{size} where len(l) > 0),
chunks_{size} as (select corpus_id, file_path, cast(spot // {step} as int) as chunk_no, cast(spot + 1 as int) as start_line,
  cast(least(spot + {size}, len(l)) as int) as end_line, array_to_string(l[spot + 1:spot + {size}], chr(10)) as text from starts_{size})"""


def field(name: str, bags: str, queries: str) -> str:
    """Score of one field for each query and chunk; bags(file_path, chunk_no, toks), queries(query_id, query)."""
    return f"""
{name}_post as (select file_path, chunk_no, term, count(*) as tf from (select file_path, chunk_no, unnest(toks) as term from {bags}) group by all),
{name}_len as (select file_path, chunk_no, len(toks) as dl from {bags}),
{name}_size as (select count(*) as n, avg(dl) as avgdl from {name}_len),
{name}_df as (select term, count(*) as df from {name}_post group by 1),
{name}_raw as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as r from {name}_df, {name}_size),
{name}_idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from {name}_raw) else r end as idf from {name}_raw),
{name}_q as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens('query')}) as term from {queries}) group by all),
{name}_score as (select query_id, file_path, chunk_no, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from {name}_q join {name}_idf using (term) join {name}_post using (term) join {name}_len using (file_path, chunk_no), {name}_size group by all)"""


TEST_PATH = "(starts_with(lower(file_path), 'tests/') or contains(lower(file_path), '/tests/'))"
QUERIES = "queries as (select item_id as query_id, text as query from benchmark)"
CASES = f"""cases as (select doc_id as query_id, text as query, p1, p2,
  case when doc_id % 150 = 50 then ['absent/doc_' || doc_id || '.py'] when doc_id % 100 = 0 then [p1, p2, p1] else [p1, p2] end as relevant
  from (select *, {PATH} as p1, {PATH.replace('doc_id', '(doc_id + 1)')} as p2 from documents where doc_id % 50 = 0))"""


def corpus(size: int = 4, overlap: int = 1) -> str:
    """files, chunks and the token bags of both fields."""
    key = "lower(file_path)"
    module = f"replace(regexp_replace({key}, '\\.py$', ''), '/', '.')"
    folders = f"array_to_string(string_split({key}, '/')[:-2], ' ')"
    about = f"{key} || ' ' || translate({key}, '/.', '  ') || ' module ' || {module} || ' filetree ' || {folders} || ' symbols imports calls'"
    named = r"array_to_string(regexp_extract_all(text, '(?m)^\s*(class|def|async\s+def)\s+([A-Za-z_][A-Za-z_0-9]*)', 2), ' ')"
    return f"""{FILES}, {chunks(size, overlap)},
content_bag as (select file_path, chunk_no, {tokens("file_path || chr(10) || text")} as toks from chunks_{size}),
meta_bag as (select file_path, chunk_no, {tokens(f"{about} || ' ' || {named}")} as toks from chunks_{size})"""


def hybrid(queries: str, size: int = 4, overlap: int = 1) -> str:
    """scored(query_id, file_path, chunk_no, start_line, end_line, text, score) for prose, which has no code structure."""
    return f"""{corpus(size, overlap)}, {field('c', 'content_bag', queries)}, {field('m', 'meta_bag', queries)},
shared as (select query_id, file_path, chunk_no, count(distinct term) as shared from (
    select query_id, file_path, chunk_no, term from c_q join c_post using (term)
    union all select query_id, file_path, chunk_no, term from m_q join m_post using (term)) group by all),
asked as (select query_id, count(*) as n_terms, bool_or(term in ('test', 'tests', 'testing', 'unittest', 'pytest')) as tests from c_q group by 1),
joined as (select query_id, file_path, chunk_no, coalesce(c.score, 0) as c, coalesce(m.score, 0) as m, shared
  from shared left join c_score c using (query_id, file_path, chunk_no) left join m_score m using (query_id, file_path, chunk_no)),
tops as (select query_id, max(c) as tc, max(m) as tm from joined group by 1),
scored as (select query_id, file_path, chunk_no, start_line, end_line, text,
    (0.5 * case when tc <= 0 then 0 else c / tc end + 0.3 * case when tm <= 0 then 0 else m / tm end + 0.1 * shared / n_terms)
    * case when {TEST_PATH} then case when tests then 1.05 else 0.85 end else 1.0 end as score
  from joined join tops using (query_id) join asked using (query_id) join chunks_{size} using (file_path, chunk_no))"""


ORDER = "round(score, 9) desc, string_split(file_path, '/'), start_line"


def seeds(k: int = 5) -> str:
    return f"""in_file as (select *, row_number() over (partition by query_id, lower(file_path) order by {ORDER}) as again from scored),
seeds as (select * from (select *, cast(row_number() over (partition by query_id order by again > 1, {ORDER}) as int) as rank from in_file) where rank <= {k})"""


def recalled(window: int = 2, limit: int = 25, size: int = 4) -> str:
    """recalled(query_id, ..., score, source, position) by the same rule, with the last expanded seed found per query."""
    return f"""reached as (select s.query_id, c.file_path, c.chunk_no, c.start_line, c.end_line, c.text, s.rank as seed, o.o as off
    from seeds s, (select unnest(range(-{window}, {window + 1})) as o) o join chunks_{size} c on c.file_path = s.file_path and c.chunk_no = s.chunk_no + o.o),
first_at as (select query_id, file_path, chunk_no, start_line, end_line, text, min((seed, off)) as spot from reached group by all),
placed as (select *, spot[1] as seed, spot[2] as off from first_at),
counted as (select *, count(*) over (partition by query_id order by seed range unbounded preceding) as so_far from placed),
limited as (select *, min(case when so_far >= {limit} then seed end) over (partition by query_id) as last from counted),
kept as (select *, row_number() over (partition by query_id order by seed, off) as position from limited where last is null or seed <= last),
recalled as (select k.query_id, k.file_path, k.chunk_no, k.start_line, k.end_line, k.text, cast(k.position as int) as position,
    case when own.rank is not null and (last is null or own.rank <= last) then own.score else giver.score end as score,
    case when own.rank is not null and (last is null or own.rank <= last) then 'hybrid'
      else 'recall:seed-' || k.seed || case when k.off >= 0 then '+' else '' end || k.off end as source
  from kept k join seeds giver on giver.query_id = k.query_id and giver.rank = k.seed
    left join seeds own on own.query_id = k.query_id and own.file_path = k.file_path and own.chunk_no = k.chunk_no where k.position <= {limit})"""


def final(k: int = 5) -> str:
    return f"""rescored as (select r.* exclude (score), coalesce(s.score, 0) as score from recalled r left join scored s using (query_id, file_path, chunk_no)),
final as (select * from (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, source = 'hybrid' desc, position) as int) as rank
  from rescored where score >= 0) where rank <= {k})"""


BLOCKS = """ordered as (select *, max(end_line) over w as reached, row_number() over (partition by query_id, file_path order by start_line, end_line, rank) as spot from final
    window w as (partition by query_id, file_path order by start_line, end_line, rank rows between unbounded preceding and 1 preceding)),
numbered as (select *, sum(case when reached is null or start_line > reached + 1 then 1 else 0 end)
    over (partition by query_id, file_path order by spot) as block from ordered),
fresh as (select *, case when reached is null or start_line > reached + 1 then string_split(text, chr(10))
    else string_split(text, chr(10))[greatest(reached - start_line + 1, 0) + 1:] end as new_lines from numbered),
blocks as (select query_id, file_path, min(start_line) as start_line, max(end_line) as end_line,
    array_to_string(flatten(list(new_lines order by spot)), chr(10)) as text, max(score) as score,
    array_to_string(list_distinct(list(source)), ',') as any_sources, list(source order by spot) as all_sources,
    cast(count(*) as int) as chunk_count, min(rank) - 1 as first_rank from fresh group by query_id, file_path, block)"""


def retrieval(queries: str, k: int = 5, window: int = 2, size: int = 4, overlap: int = 1) -> str:
    limit = max(20, k * (2 * window + 1))
    return f"{hybrid(queries, size, overlap)}, {seeds(k)}, {recalled(window, limit, size)}, {final(k)}, {BLOCKS}"


HITS = """gold as (select query_id, unnest(relevant) as path, generate_subscripts(relevant, 1) - 1 as gi from cases),
best_gold as (select query_id, lower(path) as form, min(gi) as gi from gold group by all),
all_hits as (select 'seed' as stage, s.query_id, s.rank as spot, s.file_path, g.gi from seeds s left join best_gold g on g.query_id = s.query_id and g.form = lower(s.file_path)
  union all select 'recall', s.query_id, s.position, s.file_path, g.gi from recalled s left join best_gold g on g.query_id = s.query_id and g.form = lower(s.file_path)
  union all select 'final', s.query_id, s.rank, s.file_path, g.gi from final s left join best_gold g on g.query_id = s.query_id and g.form = lower(s.file_path))"""


def flags(k: int = 5) -> str:
    any_of = lambda stage, more: f"coalesce(bool_or(stage = '{stage}' and gi is not null{more}), false)"
    return f"""flags as (select c.query_id, {any_of('seed', f' and spot <= {k}')} as seed_hit, {any_of('recall', f' and spot <= {k}')} as recall_top_k_hit,
    {any_of('recall', '')} as recall_hit, {any_of('final', f' and spot <= {k}')} as final_hit from cases c left join all_hits h using (query_id) group by 1),
diagnosed as (select *, case when final_hit then 'hit_final_top_k' when not seed_hit then 'missing_in_initial_search' when not recall_hit then 'lost_during_recall_review'
    when not recall_top_k_hit then 'recall_review_pushed_below_top_k' else 'filtered_after_recall_review' end as diagnosis from flags),
metrics as (select c.query_id, coalesce(1.0 / min(spot), 0) as rr, count(distinct gi) / len(any_value(relevant)) as recall_at_k, cast(count(distinct gi) as int) as hit_count
  from cases c left join (select * from all_hits where stage = 'final' and gi is not null and spot <= {k}) h using (query_id) group by 1)"""

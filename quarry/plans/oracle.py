"""The same queries in SQL for DuckDB."""

from __future__ import annotations

from quarry.functions.answers import STOP_MARKERS
from quarry.functions.text import STRIP
from quarry.operators import gates, prompts


def _text(value: str | None) -> str:
    """A SQL literal; line breaks by chr(10)."""
    if value is None:
        return "NULL"
    return "(" + "||chr(10)||".join("'" + part.replace("'", "''") + "'" for part in value.split("\n")) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _paragraphs(separator: str) -> str:
    return f"""paras AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, {_text(separator)}), lambda p: {_strip('p')}), lambda p: p <> '') AS ps
  FROM documents)"""


_WINDOWS = f"""CASE WHEN length(p) <= 800 THEN [p] ELSE list_filter(list_transform(
    range(0, CAST(ceil((length(p) - 800) / 700.0) AS BIGINT) + 1), lambda i: {_strip('substring(p, CAST(i * 700 + 1 AS BIGINT), 800)')}),
    lambda x: x <> '') END"""


def _chunks(separator: str) -> str:
    return f"""{_paragraphs(separator)},
pieces AS (SELECT doc_id, flatten(list_transform(ps, lambda p: {_WINDOWS})) AS xs FROM paras),
folded AS (
  SELECT doc_id, list_reduce(list_transform(xs, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x}}),
    lambda a, b: CASE WHEN length(a.cur) + 2 + length(b.cur) <= 800
      THEN {{'done': a.done, 'cur': a.cur || chr(10) || chr(10) || b.cur}}
      ELSE {{'done': list_append(a.done, a.cur), 'cur': b.cur}} END) AS f
  FROM pieces WHERE len(xs) > 0),
listed AS (SELECT CAST(doc_id AS VARCHAR) AS doc_name, list_append(f.done, f.cur) AS cs FROM folded),
numbered AS (SELECT doc_name, unnest(range(0, len(cs))) AS chunk_num, unnest(cs) AS text FROM listed),
chunks AS (
  SELECT doc_name || '_chunk_' || printf('%04d', chunk_num) || '_' || substring(sha1(doc_name || chr(10) || text), 1, 20) AS id,
         doc_name, chunk_num, text FROM numbered)"""


def _gate(x: str) -> str:
    plain = _strip(f"lower({x})")
    count = lambda p: f"(length({plain}) - length(replace({plain}, '{p}', ''))) / {len(p)}"
    marks = " ".join(f"AND NOT contains({plain}, '{m}')" for m in gates.PASSAGE_MARKS)
    return f"(length({plain}) >= 120 {marks} AND {count('|')} <= 12 AND {count('http')} < 2)"


_STATS = f"""tok AS (SELECT doc_id, {_tokens('text')} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
raw AS (
  SELECT term, count(*) AS df, ln((SELECT CAST(count(*) AS DOUBLE) FROM tok) - count(*) + CAST(0.5 AS DOUBLE)) - ln(count(*) + CAST(0.5 AS DOUBLE)) AS r
  FROM tf GROUP BY term),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN CAST(0.25 AS DOUBLE) * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""

_BM25 = f"""{_STATS},
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
dl AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS dl FROM tok),
hits AS (
  SELECT q.qid, tf.doc_id, sum(q.qtf * stats.idf * tf.tf * CAST(2.5 AS DOUBLE)
    / (tf.tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl.dl / (SELECT avg(dl) FROM dl)))) AS s
  FROM q JOIN tf USING (term) JOIN stats USING (term) JOIN dl USING (doc_id) GROUP BY ALL),
scored AS (
  SELECT b.item_id AS qid, d.doc_id, round(coalesce(h.s, 0), 9) AS s
  FROM benchmark b CROSS JOIN documents d LEFT JOIN hits h ON h.qid = b.item_id AND h.doc_id = d.doc_id),
kw AS (
  SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS bm25_rank, round(s, 6) AS score FROM scored
  QUALIFY bm25_rank <= 4)"""


def _embedded(name: str, source: str, key: str) -> str:
    """Dense unit vectors of 64 signed buckets, as lists."""
    return f"""{name}_w AS (
  SELECT {key} AS k, CAST(concat('0x', substring(md5(term), 1, 8)) AS BIGINT) % 64 AS bucket,
         sum(CASE WHEN CAST(concat('0x', substring(md5(term), 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w
  FROM (SELECT {key}, unnest({_tokens('text')}) AS term FROM {source}) GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(w * w)) AS n FROM {name}_w GROUP BY k),
{name} AS (
  SELECT s.{key} AS k, list(CASE WHEN n.n > 0 THEN coalesce(w.w, 0) / n.n ELSE 0 END ORDER BY r.i)::DOUBLE[] AS v
  FROM {source} s CROSS JOIN (SELECT unnest(range(64)) AS i) r
  LEFT JOIN {name}_w w ON w.k = s.{key} AND w.bucket = r.i LEFT JOIN {name}_n n ON n.k = s.{key} GROUP BY s.{key})"""


_HYBRID = f"""{_BM25},
{_embedded('qe', 'benchmark', 'item_id')},
{_embedded('de', 'documents', 'doc_id')},
near AS (
  SELECT qe.k AS qid, de.k AS doc_id,
         row_number() OVER (PARTITION BY qe.k ORDER BY round(power(list_distance(qe.v, de.v), 2), 9), de.k) AS sem_rank
  FROM qe CROSS JOIN de QUALIFY sem_rank <= 4),
fused AS (
  SELECT qid, doc_id, sem_rank, bm25_rank,
         coalesce(CAST(1 AS DOUBLE) / (60 + sem_rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + bm25_rank), 0) AS s
  FROM near FULL JOIN kw USING (qid, doc_id)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, sem_rank ASC NULLS LAST, bm25_rank) AS rank FROM fused)"""

_BLOCK = "'[S' || rank || '] pdf=' || d.source || ' chunk_id=' || d.doc_id || chr(10) || d.text"
_SOURCES = f"""{_HYBRID},
sources AS (
  SELECT qid, string_agg({_BLOCK}, {_text(prompts.RULE)} ORDER BY rank) AS s
  FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 4 GROUP BY qid)"""

_DRAWS = f"""pool AS (SELECT doc_id, source, text FROM documents WHERE {_gate('text')}),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM pool),
draws AS (
  SELECT i AS draw, CAST('0x' || substring(md5('42:' || i), 1, 12) AS BIGINT) % (SELECT count(*) FROM pool) AS place
  FROM (SELECT unnest(range(150)) AS i)),
drawn AS (SELECT draw, doc_id FROM draws JOIN placed USING (place))"""

_OTHERS = f"""{_DRAWS},
sizes AS (SELECT source, count(*) AS own FROM pool GROUP BY source),
others AS (
  SELECT w.draw, o.doc_id AS oracle_id, p.doc_id,
         row_number() OVER (PARTITION BY w.draw ORDER BY md5('42:' || p.doc_id) < md5('42:start:' || w.draw), md5('42:' || p.doc_id), p.doc_id) AS n
  FROM drawn w JOIN pool o USING (doc_id) JOIN sizes z ON z.source = o.source CROSS JOIN pool p
  WHERE CASE WHEN (SELECT count(*) FROM pool) - z.own < 3 THEN p.doc_id <> o.doc_id ELSE p.source <> o.source END
  QUALIFY n <= 3)"""

_QUOTES = prompts.QUOTES
_RAFT = f"""{_OTHERS},
texts AS (
  SELECT draw, any_value(o.text) AS oracle, list(p.text ORDER BY n) AS ps
  FROM others JOIN pool p ON p.doc_id = others.doc_id JOIN pool o ON o.doc_id = others.oracle_id GROUP BY draw),
raft AS (
  SELECT draw, (SELECT list(text ORDER BY item_id) FROM benchmark)[draw % (SELECT count(*) FROM benchmark) + 1] AS instruction,
    {_text(prompts.ORACLE_MARK + chr(10))} || oracle || {_text(chr(10) * 2 + prompts.DISTRACTOR_MARK + chr(10))}
      || array_to_string(ps, {_text(prompts.RULE)}) AS input,
    oracle AS output,
    {_text(prompts.GENERATE_HEAD + 'ORACLE:' + chr(10) + _QUOTES)} || oracle || {_text(_QUOTES + chr(10) * 2 + 'DISTRACTORS:' + chr(10))}
      || '1)' || chr(10) || '{_QUOTES}' || ps[1] || '{_QUOTES}' || chr(10) || chr(10)
      || '2)' || chr(10) || '{_QUOTES}' || ps[2] || '{_QUOTES}' || chr(10) || chr(10)
      || '3)' || chr(10) || '{_QUOTES}' || ps[3] || '{_QUOTES}' || chr(10) AS prompt
  FROM texts),
halves AS (
  SELECT draw, instruction, output,
    {_strip(f"replace(split_part({_strip('input')}, '{prompts.DISTRACTOR_MARK}', 1), '{prompts.ORACLE_MARK}', '')")} AS oracle,
    list_filter(list_transform(string_split(substr({_strip('input')}, strpos({_strip('input')}, '{prompts.DISTRACTOR_MARK}') + {len(prompts.DISTRACTOR_MARK)}),
      {_text(prompts.RULE)}), lambda p: {_strip('p')}), lambda p: p <> '') AS others
  FROM raft)"""

_PLAIN = r"""regexp_replace(text, '["\\\x00-\x1f]+', ' ', 'g')"""
_GOOD = f"""('{{"question": "' || {_PLAIN} || '", "final_answer": " ' || substring({_PLAIN}, 1, 40) || ' "}}')"""
_REPLIES = f"""replies AS (
  SELECT item_id, CASE item_id % 8
    WHEN 1 THEN '```json' || chr(10) || {_GOOD} || chr(10) || '```'
    WHEN 2 THEN ' ```' || chr(10) || {_GOOD} || chr(10) || '``` ' || chr(10)
    WHEN 3 THEN replace({_GOOD}, '"', chr(39))
    WHEN 4 THEN {_GOOD} || ' as asked'
    WHEN 5 THEN '{{"question": 5, "final_answer": null, "n": ' || item_id || '}}'
    WHEN 6 THEN '{{"question": "' || {_PLAIN} || '"}}'
    WHEN 7 THEN '[' || {_GOOD} || ']'
    ELSE {_GOOD} END AS reply
  FROM benchmark),
opened AS (
  SELECT item_id, {_strip('reply')} AS w,
    CASE WHEN starts_with(w, '```json') THEN {_strip("substring(w, 8)")}
         WHEN starts_with(w, '```') THEN {_strip("substring(w, 4)")} ELSE w END AS body
  FROM replies),
cleaned AS (
  SELECT item_id, CASE WHEN ends_with(body, '```') THEN {_strip("substring(body, 1, length(body) - 3)")} ELSE body END AS cleaned FROM opened)"""


def _field(name: str) -> str:
    return f"""CASE WHEN json_type(cleaned) <> 'OBJECT' THEN NULL
      WHEN json_type(cleaned, '$.{name}') IS NULL THEN ''
      WHEN json_type(cleaned, '$.{name}') = 'VARCHAR' THEN {_strip(f"json_extract_string(cleaned, '$.{name}')")} END AS {name}"""


_LINES = rf"""lines AS (
  SELECT item_id + 1 AS line_no, CASE WHEN item_id % 11 = 10 THEN '  '
    WHEN item_id % 5 = 4 THEN regexp_replace(text, '\s+', ' ', 'g')
    ELSE ' ' || (item_id % 17) || ' . ' || regexp_replace(text, '\s+', ' ', 'g') || ' ' END AS value
  FROM benchmark),
stripped AS (SELECT line_no, {_strip('value')} AS t FROM lines),
numbered AS (
  SELECT line_no, t, CASE WHEN regexp_extract(t, '^\s*(\d+)\s*\.(.*)$', 1) <> '' THEN CAST(regexp_extract(t, '^\s*(\d+)\s*\.(.*)$', 1) AS INTEGER) END AS number,
         {_strip(r"regexp_extract(t, '^\s*(\d+)\s*\.(.*)$', 2)")} AS rest
  FROM stripped WHERE t <> '')"""

_FROZEN = f"""{_BM25},
asked AS (
  SELECT qid, bm25_rank AS pos, CAST(doc_id AS VARCHAR) AS chunk_id FROM kw WHERE bm25_rank <= 2
  UNION ALL SELECT item_id, 0, 'unknown_' || item_id FROM benchmark WHERE item_id % 3 = 0),
known AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source, text FROM documents)"""

_RENDERED = f"""rendered AS (
  SELECT conv_id, turn, chr(10) || '=== ANSWER ===' || chr(10) || text || chr(10) || chr(10) || '=== SOURCES USED ===' || chr(10)
    || '[S1] pdf=turn ' || turn || ' chunk_id=c ' || conv_id || ' :: ' || substring(replace(text, chr(10), ' '), 1, 220) || '...' || chr(10)
    || repeat('=', 80) || chr(10) AS text
  FROM conversations WHERE role = 'assistant')"""


def _truncated(x: str) -> str:
    for marker in STOP_MARKERS:
        x = f"split_part({x}, {_text(marker)}, 1)"
    return _strip(x)


def _entity_free(x: str) -> str:
    for pattern, to in (
        (r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", ""),
        (r"(?is)<!--.*?-->|<!doctype[^>]*>", ""),
        (r"(?i)<(h[1-6]|title)\b[^>]*>", "\n\n# "),
        (r"(?i)<li\b[^>]*>", "\n- "),
        (r"(?i)<(p|div|ul|ol|table|tr|section|article|nav|header|footer|br|/h[1-6]|/title|/p|/div)\b[^>]*>", "\n\n"),
        (r"<[^>]*>", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', {_text(to)}, 'g')"
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', {_text(character)})"
    x = rf"regexp_replace({x}, '[ \t\r\f]+', ' ', 'g')"
    return _strip(rf"regexp_replace({x}, ' ?\n[ \n]*\n ?| ?\n ?', chr(10), 'g')")


def _prompts() -> str:
    made = ", ".join(
        f"{_text(prompts.HEADS[k] + 'QUESTION:' + chr(10))} || b.text || {_text(chr(10) * 2 + 'SOURCES:' + chr(10))} || s.s || chr(10) AS prompt_{k}"
        for k in ("ui", "cli", "local", "hosted")
    )
    return f"WITH {_SOURCES} SELECT s.qid, {made} FROM sources s JOIN benchmark b ON b.item_id = s.qid"


def _training() -> str:
    cited = f"CASE WHEN contains({_strip('output')}, '[S1]') THEN {_strip('output')} ELSE {_strip('output')} || ' [S1]' END"
    others = "".join(
        f" || CASE WHEN len(others) >= {n} THEN {_text(prompts.RULE)} || '[S{n + 1}] pdf=distractor_doc chunk_id=distractor_chunk_{n}' || chr(10) || others[{n}] ELSE '' END"
        for n in (1, 2, 3)
    )
    return f"""WITH {_RAFT} SELECT draw, {_text(prompts.HEADS['training'] + 'QUESTION:' + chr(10))} || {_strip('instruction')}
  || {_text(chr(10) * 2 + 'SOURCES:' + chr(10) + '[S1] pdf=oracle_doc chunk_id=oracle_chunk' + chr(10))} || oracle{others}
  || {_text(chr(10) * 2 + 'ANSWER:' + chr(10))} || {cited} || {_text(chr(10) + prompts.END)} AS text FROM halves"""


def _pair() -> str:
    q = _strip("lower(q)")
    a = _strip("lower(a)")
    bad = " ".join(f"AND NOT contains({q}, '{m}')" for m in gates.QUESTION_MARKS)
    bad += " " + " ".join(f"AND NOT contains({a}, '{m}')" for m in gates.ANSWER_MARKS)
    return f"""WITH pairs AS (
  SELECT item_id, CASE item_id % 5 WHEN 1 THEN ' Who published it? ' WHEN 2 THEN 'Who chaired ' || text ELSE text END AS q,
         CASE item_id % 5 WHEN 3 THEN '  short  ' WHEN 4 THEN 'See Recommendation ' || text ELSE substring(text, 1, 60) END AS a
  FROM benchmark) SELECT item_id, (length({q}) >= 20 AND length({a}) >= 12 {bad}) AS good FROM pairs"""


def _manifest() -> str:
    return f"""SELECT coalesce(o, '') AS source_org, count(*) AS n_files, count(x) AS n_notes,
  count(*) FILTER (WHERE n <> {_strip('n')}) AS n_padded, CAST(sum(length(t)) AS BIGINT) AS n_title_chars, min(d) AS first_accessed
  FROM (SELECT CASE WHEN page_id % 7 = 3 THEN ' ' ELSE '' END || 'page ' || page_id || CASE WHEN page_id % 5 = 1 THEN ' ' ELSE '' END AS n,
    CASE WHEN page_id % 4 <> 2 THEN nullif(regexp_extract(url, '://([^/:?#]*)', 1), '') END AS o, 'Page "' || page_id || '", kept' AS t,
    DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS d, CASE WHEN page_id % 3 = 0 THEN url END AS x FROM pages) GROUP BY coalesce(o, '')"""


def _extracted() -> str:
    """The sentence of a question's sources that shares most tokens with it."""
    cut = "string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10))"
    return f"""WITH {_HYBRID},
qt AS (SELECT item_id AS qid, list_distinct({_tokens('text')}) AS asked FROM benchmark WHERE {_strip("coalesce(text, '')")} <> ''),
cut AS (SELECT qid, rank, {cut} AS ss FROM ranked JOIN documents USING (doc_id) WHERE rank <= 4),
pieces AS (SELECT qid, rank, unnest(ss) AS s, unnest(range(0, len(ss))) AS place FROM cut),
counted AS (SELECT qid, rank, place, s, len(list_intersect(list_distinct({_tokens('s')}), asked)) AS shared FROM pieces JOIN qt USING (qid)),
best AS (SELECT * FROM counted WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY shared DESC, rank, place) = 1)
SELECT qid, 'extractive' AS model, coalesce({_strip('s')} || ' [S' || rank || ']', {_text(prompts.UNKNOWN)}) AS answer FROM qt LEFT JOIN best USING (qid)"""


_SOURCE = r"^\[(S\d+)\]\s+pdf=(.*?)\s+chunk_id=(.*?)\s+::\s+(.*)$"


def oracle_sql() -> dict[str, str]:
    parsed = ", ".join(f"CASE WHEN n_sources > 0 THEN regexp_extract(line, '{_SOURCE}', {n}) END AS {c}" for n, c in ((1, "label"), (3, "chunk_id"), (2, "pdf_name"), (4, "snippet")))
    return {
        "tokenize": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
        "paragraphs": f"WITH {_paragraphs(chr(10))} SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS paragraph FROM paras",
        "paragraph_windows": f"""WITH {_paragraphs(chr(10))},
  one AS (SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS p FROM paras),
  w AS (SELECT doc_id, pos, {_WINDOWS} AS xs FROM one)
  SELECT doc_id, pos, unnest(range(0, len(xs))) AS win, unnest(xs) AS piece FROM w""",
        "chunk_pack": f"WITH {_chunks(chr(10))} SELECT doc_name, chunk_num, text FROM chunks",
        "chunk_ids": f"WITH {_chunks(chr(10) * 2)} SELECT id, doc_name, chunk_num, text FROM chunks",
        "scan_chunks": f"WITH {_chunks(chr(10) * 2)} SELECT id, doc_name AS pdf_name, text FROM chunks",
        "corpus_profile": f"""WITH {_chunks(chr(10))} SELECT count(*) AS n_chunks, count(*) FILTER (WHERE {_gate('text')}) AS n_usable,
  CAST(sum(length(text)) AS BIGINT) AS n_chars, max(length(text)) AS longest, count(DISTINCT doc_name) AS n_docs FROM chunks""",
        "term_freq": f"WITH {_STATS} SELECT doc_id, term, tf FROM tf",
        "term_stats": f"WITH {_STATS} SELECT term, df, round(idf, 6) AS idf FROM stats",
        **dict.fromkeys(("bm25_topk", "index_topk", "index_segments"), f"WITH {_BM25} SELECT qid, doc_id, bm25_rank, score FROM kw"),
        "vector_topk": """SELECT q.vec_id AS qid, v.vec_id,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(power(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2), 9), v.vec_id) AS sem_rank,
  round(power(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 2), 5) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 QUALIFY sem_rank <= 4""",
        "hash_embed": f"""WITH {_embedded('qe', 'benchmark', 'item_id')}
  SELECT w.k AS qid, w.bucket, round(w.w / n.n, 6) AS weight FROM qe_w w JOIN qe_n n USING (k) WHERE w.w <> 0""",
        "rrf_fuse": f"WITH {_HYBRID} SELECT qid, doc_id, sem_rank, bm25_rank, round(s, 9) AS score, rank FROM ranked",
        "hybrid_topk": f"WITH {_HYBRID} SELECT qid, rank, doc_id, round(s, 9) AS score, text FROM ranked JOIN documents USING (doc_id) WHERE rank <= 4",
        "build_prompt": _prompts(),
        "oracle_gate": f"SELECT doc_id, {_gate('text')} AS good FROM documents",
        "oracle_sample": f"WITH {_DRAWS} SELECT draw, doc_id FROM drawn",
        "distractor_sample": f"WITH {_OTHERS} SELECT draw, oracle_id, n, doc_id FROM others",
        "raft_records": f"WITH {_RAFT} SELECT draw, instruction, input, output, prompt FROM raft",
        "raft_split": f"""WITH {_RAFT} SELECT draw, oracle, len(others) AS n_others,
  array_to_string(others, {_text(chr(10) + '|' + chr(10))}) AS others FROM halves""",
        "sft_format": _training(),
        "clean_json": f"WITH {_REPLIES} SELECT item_id, cleaned FROM cleaned",
        "parse_qa_json": f"""WITH {_REPLIES}, valid AS (SELECT item_id, CASE WHEN json_valid(cleaned) THEN cleaned ELSE '[]' END AS cleaned FROM cleaned)
  SELECT item_id, {_field('question')}, {_field('final_answer')} FROM valid""",
        "qa_gate": _pair(),
        "parse_questions_strict": f"WITH {_LINES} SELECT number AS qid, arg_max(rest, line_no) AS question FROM numbered WHERE number IS NOT NULL GROUP BY number",
        "parse_questions_lenient": f"""WITH {_LINES}, placed AS (SELECT *, row_number() OVER (ORDER BY line_no) AS pos FROM numbered)
  SELECT pos, coalesce(number, pos) AS qid, CASE WHEN number IS NULL THEN t ELSE rest END AS question FROM placed""",
        "dedupe_last": "SELECT item_id % 10 AS k, arg_max(text, item_id) AS text FROM benchmark GROUP BY 1",
        "frozen_contexts": f"""WITH {_FROZEN}, found AS (
    SELECT qid, a.chunk_id, k.source, k.text, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM asked a JOIN known k USING (chunk_id))
  SELECT b.item_id AS qid, any_value(b.text) AS question, count(f.qid) AS n_sources,
    coalesce(string_agg('[S' || n || '] pdf=' || f.source || ' chunk_id=' || f.chunk_id || chr(10) || f.text, {_text(prompts.RULE)} ORDER BY n), '') AS sources
  FROM benchmark b LEFT JOIN found f ON f.qid = b.item_id GROUP BY b.item_id""",
        "missing_chunks": f"WITH {_FROZEN} SELECT qid, chunk_id FROM asked WHERE chunk_id NOT IN (SELECT chunk_id FROM known)",
        "write_contexts": f"""WITH {_FROZEN}, found AS (
    SELECT qid, a.chunk_id, k.source, k.text, row_number() OVER (PARTITION BY qid ORDER BY pos) AS n FROM asked a JOIN known k USING (chunk_id))
  SELECT b.item_id AS qid, any_value(b.text) AS question, count(f.qid) AS n_sources,
    coalesce(string_agg('[S' || n || '] pdf=' || f.source || ' chunk_id=' || f.chunk_id || chr(10) || f.text, {_text(prompts.RULE)} ORDER BY n), '') AS sources,
    (SELECT count(*) FROM asked WHERE chunk_id NOT IN (SELECT chunk_id FROM known)) AS n_missing
  FROM benchmark b LEFT JOIN found f ON f.qid = b.item_id GROUP BY b.item_id""",
        **dict.fromkeys(("answers_extractive", "answers_resumable"), _extracted()),
        "questions_asked": """SELECT item_id AS qid, text AS question FROM benchmark
  WHERE item_id % 7 <> 2 AND item_id % 3 <> 1 AND regexp_replace(text, '\\s', '', 'g') <> ''""",
        "scan_questions": f"""WITH {_LINES}, placed AS (SELECT *, row_number() OVER (ORDER BY line_no) AS pos FROM numbered)
  SELECT pos, coalesce(number, pos) AS qid, CASE WHEN number IS NULL THEN t ELSE rest END AS question FROM placed""",
        "scan_tolerant": "SELECT CAST(item_id AS INTEGER) AS qid, regexp_replace(text, '\\s+', ' ', 'g') AS answer FROM benchmark WHERE item_id % 7 <> 3",
        "scan_raft": f"WITH {_RAFT} SELECT instruction, input, output FROM raft",
        "resume_rows": "SELECT doc_id, lang, source FROM documents",
        "vector_table": "SELECT vec_id AS id, label, len(embedding) AS dims FROM embeddings",
        "markdown_files": f"""SELECT row_number() OVER (ORDER BY 'page ' || page_id || '.md') - 1 AS doc_no, 'page ' || page_id AS doc_name, {_entity_free('html')} AS text
  FROM pages""",
        "scan_transcript": f"""WITH {_RENDERED},
  blocks AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, repeat('=', 80)), lambda b: {_strip('b')}), lambda b: contains(b, '=== ANSWER ===')) AS bs FROM rendered),
  one AS (SELECT conv_id, turn, unnest(bs) AS block FROM blocks),
  cut AS (SELECT conv_id, turn, {_strip("split_part(split_part(block, '=== ANSWER ===', 2), '=== SOURCES USED ===', 1)")} AS answer,
    {_strip("split_part(block, '=== SOURCES USED ===', 2)")} AS line FROM one),
  counted AS (SELECT *, CASE WHEN regexp_matches(line, '{_SOURCE}') THEN 1 ELSE 0 END AS n_sources FROM cut)
  SELECT row_number() OVER (ORDER BY conv_id, turn) AS block_no, answer, n_sources, {parsed} FROM counted""",
        "render_transcript": f"WITH {_RENDERED} SELECT conv_id, turn, text FROM rendered",
        "parse_transcript": f"""WITH {_RENDERED},
  blocks AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, repeat('=', 80)), lambda b: {_strip('b')}), lambda b: contains(b, '=== ANSWER ===')) AS bs FROM rendered),
  one AS (SELECT conv_id, turn, unnest(bs) AS block FROM blocks),
  cut AS (SELECT conv_id, turn, {_strip("split_part(split_part(block, '=== ANSWER ===', 2), '=== SOURCES USED ===', 1)")} AS answer,
    {_strip("split_part(block, '=== SOURCES USED ===', 2)")} AS line FROM one),
  counted AS (SELECT *, CASE WHEN regexp_matches(line, '{_SOURCE}') THEN 1 ELSE 0 END AS n_sources FROM cut)
  SELECT conv_id, turn AS qid, 'turn ' || turn AS question, answer, n_sources, {parsed} FROM counted""",
        "truncate_answer": f"""SELECT conv_id, turn, {_truncated("(' ' || text || CASE WHEN turn % 2 = 0 THEN chr(10) || '[S2] more <END_ANSWER> rest' ELSE ' ' || chr(10) || '--- rest' END)")} AS answer
  FROM conversations""",
        "score_rubric": """SELECT source, CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS points, count(*) AS out_of
  FROM labels JOIN documents USING (doc_id) GROUP BY source""",
        "manifest_profile": _manifest(),
        "ingest_pages": f"SELECT page_id, url, {_entity_free('html')} AS text FROM pages",
    }

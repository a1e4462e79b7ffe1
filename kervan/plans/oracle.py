"""DuckDB SQL that gives the same rows as each registered query, over the same tables."""

from __future__ import annotations

from kervan.functions import guard
from kervan.functions.text import QUANTITY_UNITS, UNIT_ALIASES
from kervan.schema import SECTION_FIELDS, SECTIONS

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_KINDS = {f: k for _, f, k in reversed(SECTIONS)}


def fold(c: str) -> str:
    return _FOLD.format(c)


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SP}+', ''), '{_SP}+$', '')"


def opt(c: str) -> str:
    return f"nullif({strip(c)}, '')"


_UPPER = "translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_SAME = f"{fold('a.medicine_name')} = {fold('b.medicine_name')} AND a.source_name IS NOT DISTINCT FROM b.source_name AND a.source_reference IS NOT DISTINCT FROM b.source_reference"

_UPSERT = f"""
WITH m AS (SELECT medicine_id, medicine_name, warnings, source_name, source_reference, {fold('medicine_name')} AS k FROM medicines),
up AS (SELECT k, source_name, source_reference, 'yeni ' || coalesce(arg_max(coalesce(warnings, ''), medicine_id), '') AS warnings, min(medicine_id) AS target
       FROM m GROUP BY k, source_name, source_reference),
changed AS (SELECT m.medicine_id, m.medicine_name, CASE WHEN up.target = m.medicine_id THEN up.warnings ELSE m.warnings END AS warnings, m.source_name, m.source_reference
       FROM m JOIN up ON m.k = up.k AND m.source_name IS NOT DISTINCT FROM up.source_name AND m.source_reference IS NOT DISTINCT FROM up.source_reference),
fresh AS (SELECT 'Q ' || arg_min(medicine_name, medicine_id) AS medicine_name, arg_max(w, medicine_id)[1] AS warnings, source_name, source_reference, max(medicine_id) AS ord
       FROM (SELECT *, [warnings] AS w FROM m) GROUP BY k, source_name, source_reference)
SELECT * FROM changed
UNION ALL
SELECT (SELECT max(medicine_id) FROM medicines) + row_number() OVER (ORDER BY ord), medicine_name, warnings, source_name, source_reference FROM fresh
"""

_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_V = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"

_UNITS = rf"""
src AS (SELECT doc_id, {strip("coalesce(text, '')")} AS t FROM documents),
par AS (SELECT doc_id, t, unnest(CASE WHEN length(t) <= 1200 THEN [t] ELSE regexp_split_to_array(t, '\n{_SP}*\n') END) AS p,
        generate_subscripts(CASE WHEN length(t) <= 1200 THEN [t] ELSE regexp_split_to_array(t, '\n{_SP}*\n') END, 1) AS i FROM src WHERE t <> ''),
par2 AS (SELECT doc_id, i, {strip('p')} AS p FROM par),
lin AS (SELECT doc_id, i, unnest(l) AS l, generate_subscripts(l, 1) AS j FROM
        (SELECT doc_id, i, CASE WHEN length(p) <= 1200 THEN [p] ELSE regexp_split_to_array(p, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') END AS l FROM par2 WHERE p <> '')),
lin2 AS (SELECT doc_id, i, j, {strip('l')} AS l FROM lin),
sen AS (SELECT doc_id, i, j, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM
        (SELECT doc_id, i, j, CASE WHEN length(l) <= 1200 THEN [l] ELSE
         string_split(regexp_replace(l, '([.!?]){_SP}+([A-ZÇĞİÖŞÜ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS s FROM lin2 WHERE l <> '')),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS pos, u FROM
        (SELECT doc_id, i, j, k, {strip('s')} AS u FROM sen) WHERE u <> '')
""".replace("'\\1' || chr(1) || '\\2'", "'\\1\x01\\2'")

_PACK = """
packed AS (SELECT doc_id, list_reduce(
    list_prepend({'done': []::VARCHAR[], 'cur': ''}, [{'done': []::VARCHAR[], 'cur': u} FOR u IN us]),
    lambda a, b: CASE
        WHEN a.cur = '' THEN {'done': a.done, 'cur': b.cur}
        WHEN length(a.cur) + length(b.cur) + (CASE WHEN contains(a.cur, chr(10)) OR contains(b.cur, chr(10)) THEN 2 ELSE 1 END) > 1200 THEN {'done': list_append(a.done, a.cur), 'cur': b.cur}
        ELSE {'done': a.done, 'cur': a.cur || (CASE WHEN contains(a.cur, chr(10)) OR contains(b.cur, chr(10)) THEN chr(10) || chr(10) ELSE ' ' END) || b.cur} END) AS r
    FROM (SELECT doc_id, list(u ORDER BY pos) AS us FROM units GROUP BY doc_id)),
chunks AS (SELECT doc_id, unnest(list_append(r.done, r.cur)) AS c, generate_subscripts(list_append(r.done, r.cur), 1) - 1 AS pos FROM packed)
"""

_W = r"[\p{L}\p{N}\p{M}\p{Pc}]"
_NW = r"[^\p{L}\p{N}\p{M}\p{Pc}]"


def _marked(c: str) -> str:
    return f"regexp_replace({c}, '({_W}+)', '\x01\\1\x01', 'g')"


def _quantities(c: str) -> str:
    """List of 'number unit' with every word marked off by U+0001, which stands in for a word boundary."""
    pattern = f"\x01(\\p{{Nd}}+(?:\x01[.,]\x01\\p{{Nd}}+)?)(?:\x01\\s*\x01)?({'|'.join((*QUANTITY_UNITS, chr(0x3BC) + 'g'))})\x01"
    alias = "CASE u " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in UNIT_ALIASES.items()) + " ELSE u END"
    n = "coalesce(nullif(ltrim(replace(replace(n, '\x01', ''), ',', '.'), '0'), ''), '0')"
    m = _marked(c)
    zipped = f"list_zip(regexp_extract_all({m}, '{pattern}', 1), regexp_extract_all({m}, '{pattern}', 2))"
    return f"list_transform({zipped}, lambda z: {n.replace('(n,', '(z[1],')} || ' ' || {alias.replace('CASE u', 'CASE z[2]').replace('ELSE u', 'ELSE z[2]')})"


def _bounded(pattern: str) -> str:
    """A Python pattern with word boundaries as one over marked text is not needed: boundaries become explicit classes."""
    p = pattern.replace(r"\b.*\b", "\x02").replace(r"\s", _SP)
    if p.startswith(r"\b"):
        p = f"(?:^|{_NW})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + f"(?:$|{_NW})"
    p = p.replace("\x02", f"{_NW}(?:.*{_NW})?")
    assert r"\b" not in p
    return p


_PERSONAL = " OR ".join(f"regexp_matches(lower(content), '(?i){_bounded(p)}')" for p in guard.PERSONAL_PATTERNS)


def _urgent(c: str) -> str:
    return f"regexp_matches({c}, '(?i){_bounded(guard.CRITICAL_PATTERN)}')"



def casefold(c: str) -> str:
    """Lower case, with the letters that folding changes further and that the tables may hold."""
    return f"replace(replace(replace(lower(replace({c}, 'İ', 'i' || chr(775))), 'ß', 'ss'), 'ς', 'σ'), 'µ', 'μ')"


_LETTERS = "list_prepend(1.0::DOUBLE, list_transform(range(97, 123), lambda i: (length({0}) - length(replace({0}, chr(i::INT), '')))::DOUBLE))"
_QUESTIONS = f"questions AS (SELECT arg_min(conv_id * 1000 + turn, (conv_id, turn)) AS query_id, content FROM chat_messages WHERE role = 'user' AND {strip('content')} <> '' GROUP BY content)"
_HITS = f"""{_QUESTIONS},
    qv AS (SELECT query_id, {_LETTERS.format('t')} AS e FROM (SELECT query_id, {strip('content')} AS t FROM questions)),
    cv AS (SELECT chunk_id, medicine_id, chunk_type, chunk_text, {_LETTERS.format('chunk_text')} AS e FROM document_chunks WHERE medicine_id IN (SELECT medicine_id FROM medicines)),
    sims AS (SELECT query_id, chunk_id, round(list_cosine_similarity(qv.e, cv.e), 12) AS s FROM qv, cv),
    best AS (SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM sims WHERE s >= 0.8),
    hits AS (SELECT query_id, rank, chunk_id, s, m.medicine_name, c.chunk_type, c.chunk_text, m.source_name FROM best JOIN document_chunks c USING (chunk_id) JOIN medicines m USING (medicine_id) WHERE rank <= 5)"""


def _shown(c: str) -> str:
    return f"coalesce(nullif({c}, ''), '{guard.UNSTATED}')"


_BLOCK = f"'[KAYNAK ' || rank || ']' || chr(10) || 'İlaç: ' || {_shown('medicine_name')} || chr(10) || 'Kategori: ' || {_shown('chunk_type')} || chr(10) || 'Metin: ' || coalesce(chunk_text, '') || chr(10) || 'Kaynak: ' || {_shown('source_name')}"

_BODY = r"regexp_replace(coalesce(chunk_text, ''), '\A(?:(?i:ilaç:|i\x{307}laç:|İlaç:|kategori:)[^\n]*(?:\n|\z))+', '')"
_CRITICAL = f"(chunk_type = 'serious_side_effects' OR (chunk_type = 'warnings' AND {_urgent('chunk_text')}))"
_GENERAL = ", ".join(f"'{t}'" for t in guard.GENERAL_TYPES)
_PER = f"""per AS (SELECT query_id, bool_or(coalesce({_CRITICAL}, false)) AS critical, arg_min(chunk_text, rank) AS first,
        count(*) > count(DISTINCT ({casefold("coalesce(medicine_name, '')")}, {casefold("coalesce(chunk_type, '')")})) AS overlap,
        string_agg({_BODY}, chr(10) ORDER BY rank) AS bodies,
        coalesce(array_to_string(list_slice(list(chunk_text ORDER BY rank) FILTER (chunk_type IN ({_GENERAL})), 1, 2), '{{0}}'), '') AS general FROM hits GROUP BY query_id),
    src AS (SELECT query_id, string_agg(s, ', ' ORDER BY r) AS sources FROM (SELECT query_id, {_shown('source_name')} AS s, min(rank) AS r FROM hits GROUP BY 1, 2) GROUP BY 1)"""
_REFUSED = f"""CASE WHEN critical THEN '{guard.WARNING_PREFIX}' || chr(10) || chr(10) ELSE '' END || '{guard.REFUSAL}' || chr(10) || chr(10)
        || CASE WHEN general <> '' THEN '{guard.GENERAL_INTRO}' || chr(10) || general ELSE '{guard.NOT_FOUND}' END"""
_TWO = "' || chr(10) || chr(10) || '"
_MARKER = guard.MARKER.replace("\n\n", _TWO)


def _finished(answer: str, sources: str) -> str:
    return f"{strip(answer)} || '{_MARKER}' || {sources} || '{_TWO}{guard.DISCLAIMER}'"


_ANSWERS = f"""WITH {_HITS}, {_PER.replace('{0}', _TWO)},
    a AS (SELECT q.query_id, ({_PERSONAL.replace('lower(content)', casefold('content'))}) AS personal, p.query_id IS NOT NULL AS has, critical, overlap, general, bodies, coalesce({strip('first')}, '') AS reply, coalesce(sources, '{guard.NO_SOURCES}') AS sources
          FROM questions q LEFT JOIN per p USING (query_id) LEFT JOIN src USING (query_id)),
    o AS (SELECT *, CASE WHEN NOT has THEN 'no_hits' WHEN personal THEN 'refused' WHEN reply = '' THEN 'no_reply'
          WHEN len(list_filter({_quantities(casefold('reply'))}, lambda x: NOT list_contains({_quantities(casefold('bodies'))}, x))) > 0 THEN 'rejected' ELSE 'answered' END AS outcome FROM a),
    b AS (SELECT *, CASE outcome WHEN 'refused' THEN {_REFUSED} WHEN 'answered' THEN reply ELSE '{guard.NOT_FOUND}' END AS base FROM o),
    f AS (SELECT *, CASE WHEN outcome IN ('answered', 'rejected', 'no_reply') AND critical AND NOT {_urgent('base')} THEN '{guard.WARNING_PREFIX}' || chr(10) || chr(10) || base ELSE base END AS final FROM b)
    SELECT query_id, outcome, md5({_finished('final', 'sources')}) AS digest FROM f"""

# JSON values as text, as the ingestion states it: strings stripped, lists one filled item a line, objects with spaces after the marks.
_SCALAR = "CASE json_type({0}) WHEN 'VARCHAR' THEN {1} WHEN 'BOOLEAN' THEN CASE WHEN CAST({0} AS VARCHAR) = 'true' THEN 'True' ELSE 'False' END WHEN 'NULL' THEN {2} ELSE CAST({0} AS VARCHAR) END"


def _as_text(path: str) -> str:
    v = f"json_extract(rec, '$.{path}')"
    item = _SCALAR.format("x", strip("(x->>'$')"), "'None'")
    listed = f"array_to_string(list_filter(list_transform(CAST({v} AS JSON[]), lambda x: {item}), lambda x: x <> ''), chr(10))"
    pair = f"to_json(k)::VARCHAR || ': ' || CAST(json_extract({v}, '$.\"' || k || '\"') AS VARCHAR)"
    object_ = f"'{{' || array_to_string(list_transform(json_keys({v}), lambda k: {pair}), ', ') || '}}'"
    return f"coalesce(CASE json_type({v}) WHEN 'ARRAY' THEN {listed} WHEN 'OBJECT' THEN {object_} ELSE {_SCALAR.format(v, strip(f'({v}->>chr(36))'), chr(39) * 2)} END, '')"


_TEXTS = ", ".join(f"{_as_text(k)} AS t_{k}" for k in ("medicine_name", *(k for k, _, _ in SECTIONS), "source_name", "source_reference"))
_RECORDS = f"""parsed AS (SELECT record_id, file_path, CASE WHEN json_valid(ltrim(record_json, chr(65279))) THEN ltrim(record_json, chr(65279))::JSON END AS doc FROM raw_records),
    fine AS (SELECT record_id, CASE WHEN json_type(doc) = 'ARRAY' THEN CAST(doc AS JSON[]) ELSE [doc] END AS items FROM parsed WHERE json_type(doc) IN ('ARRAY', 'OBJECT')),
    good AS (SELECT * FROM fine WHERE len(list_filter(items, lambda x: json_type(x) <> 'OBJECT')) = 0),
    recs AS (SELECT record_id, unnest(items) AS rec, (generate_subscripts(items, 1) - 1)::INT AS pos FROM good),
    texts AS (SELECT record_id, pos, {_TEXTS},
        CASE json_type(json_extract(rec, '$.source')) WHEN 'OBJECT' THEN {_as_text('source.name')} ELSE {_as_text('source')} END AS t_object,
        CASE json_type(json_extract(rec, '$.source')) WHEN 'OBJECT' THEN CASE WHEN {_as_text('source.reference')} <> '' THEN {_as_text('source.reference')} ELSE {_as_text('source.url')} END ELSE '' END AS t_object_reference
        FROM recs WHERE NOT coalesce(json_type(json_extract(rec, '$.is_example')) = 'BOOLEAN' AND CAST(json_extract(rec, '$.is_example') AS VARCHAR) = 'true', false)),
    named AS (SELECT * FROM texts WHERE t_medicine_name <> '')"""


def _alias(field: str) -> str:
    return f"coalesce({', '.join(f'nullif(t_{k}, {chr(39) * 2})' for k, f, _ in SECTIONS if f == field)})"


_RECORD_COLUMNS = ", ".join(f"{_alias(f)} AS {f}" for f in SECTION_FIELDS)
_SECTION_ROWS = " UNION ALL ".join(
    f"SELECT record_id, pos AS record_pos, {i} AS ordinal, '{kind}' AS kind, t_medicine_name AS name, t_{k} AS text FROM named WHERE t_{k} <> ''" + "".join(f" AND t_{e} = ''" for e, f, _ in SECTIONS[:i] if f == field)
    for i, (k, field, kind) in enumerate(SECTIONS)
)
_CHUNKS = f"""WITH {_RECORDS}, sections AS (SELECT *, row_number() OVER (ORDER BY record_id, record_pos, ordinal) AS doc_id FROM ({_SECTION_ROWS})),
    {_UNITS.replace('FROM documents', 'FROM sections')}, {_PACK},
    made AS (SELECT record_id, record_pos, (row_number() OVER (PARTITION BY record_id, record_pos ORDER BY ordinal, chunks.pos) - 1)::INT AS pos, kind AS chunk_type,
        'İlaç: ' || name || chr(10) || 'Kategori: ' || kind || chr(10) || c AS full_text FROM chunks JOIN sections USING (doc_id))
    SELECT record_id, record_pos, pos, chunk_type, length(full_text)::INT AS n, md5(full_text) AS digest FROM made"""

_GENERIC = ", ".join(f"'{w}'" for w in ("ampul", "film", "flakon", "kapsul", "kapsül", "mg", "ml", "saşe", "surup", "şurup", "tablet"))


_NARROW = "".join(map(chr, range(0x30, 0x3A))) + "".join(map(chr, range(0x61, 0x7B)))
_WIDE = "".join(chr(ord(x) + 0xFEE0) for x in _NARROW)


def _match_key(c: str) -> str:
    """Words of a text without case and marks, joined by a blank; of the compatibility forms, which DuckDB lacks, those that the tables hold."""
    plain = f"replace(replace(translate({casefold(c)}, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), '㎎', 'mg')"
    flat = f"regexp_replace(strip_accents({plain}), '\\p{{M}}', '', 'g')"
    return f"array_to_string(regexp_extract_all({flat}, '[\\p{{L}}\\p{{N}}_]+'), ' ')"


_NAMED = f"""WITH {_QUESTIONS}, q AS (SELECT query_id, {_match_key('content')} AS q FROM questions),
    r AS (SELECT medicine_id, n, list_filter(string_split(n, ' '), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '\\p{{Nd}}+') AND w NOT IN ({_GENERIC}))[1] AS brand
          FROM (SELECT medicine_id, {_match_key('medicine_name')} AS n FROM medicines) WHERE n <> '')
    SELECT query_id, medicine_id FROM q, r WHERE contains(' ' || q || ' ', ' ' || n || ' ') OR coalesce(list_contains(string_split(q, ' '), brand), false)"""

ORACLE: dict[str, str] = {
    "name_match_chat": _NAMED,
    "stats_counts": "SELECT (SELECT count(*) FROM medicines) AS medicines, (SELECT count(*) FROM document_chunks) AS document_chunks",
    "chunk_parent_join": "SELECT chunk_id, medicine_id, medicine_name, source_name, source_reference, chunk_type, length(chunk_text)::INT AS n_chars, embedding_model FROM document_chunks JOIN medicines USING (medicine_id)",
    "filter_optional": "SELECT chunk_id, medicine_id, chunk_type FROM document_chunks WHERE medicine_id = 1 AND chunk_type = 'warnings'",
    "filter_no_terms": "SELECT chunk_type, count(*) AS n FROM document_chunks GROUP BY chunk_type",
    "lookup_nocase": f"SELECT medicine_id, medicine_name, source_name FROM medicines WHERE {fold('medicine_name')} = 'lepebikes 500 mg film tablet' ORDER BY medicine_id LIMIT 1",
    "nullsafe_upsert_match": f"SELECT a.medicine_id, min(b.medicine_id) AS target_id FROM medicines a LEFT JOIN medicines b ON {_SAME} GROUP BY a.medicine_id",
    "upsert_merge": _UPSERT,
    "replace_children": """WITH new AS (SELECT chunk_id + 1000000000 AS chunk_id, medicine_id, chunk_type, length(chunk_text)::INT + 1 AS n FROM document_chunks WHERE chunk_type = 'warnings')
        SELECT chunk_id, medicine_id, chunk_type, length(chunk_text)::INT AS n FROM document_chunks WHERE medicine_id NOT IN (SELECT medicine_id FROM new) UNION ALL SELECT * FROM new""",
    "cascade_delete": "SELECT chunk_id, medicine_id FROM document_chunks WHERE medicine_id IN (SELECT medicine_id FROM medicines WHERE source_name IS NOT NULL)",
    "assign_ids": "SELECT p_partkey, p_brand, 1000 + row_number() OVER (ORDER BY p_brand, p_partkey) AS new_id FROM part",
    "alias_coalesce": f"SELECT medicine_id, coalesce({opt('dosage_information')}, {opt('frequency_information')}, {opt('usage_information')}) AS dosage, coalesce({opt('source_name')}, '-') AS source FROM medicines",
    "section_unpivot": " UNION ALL ".join(f"SELECT medicine_id, {i}::INT AS ordinal, '{_KINDS[f]}' AS chunk_type, md5({strip(f)}) AS digest FROM medicines WHERE {opt(f)} IS NOT NULL" for i, f in enumerate(SECTION_FIELDS)),
    "text_split_units": f"WITH {_UNITS} SELECT doc_id, pos::INT AS pos, length(u)::INT AS n, md5(u) AS digest FROM units",
    "text_pack_chunks": f"WITH {_UNITS}, {_PACK} SELECT doc_id, pos::INT AS pos, length(c)::INT AS n, md5(c) AS digest FROM chunks",
    "change_detect": "SELECT medicine_id, bool_and(NOT contains(chunk_text, '1.25 g') AND coalesce(len(embedding) > 0, false) AND coalesce(embedding_model = 'leaflet-embed-2', false)) AS is_current FROM document_chunks GROUP BY medicine_id",
    "vector_validity": f"""SELECT chunk_id, coalesce(len(embedding), -1)::INT AS n, ({_VALID}) AS is_valid,
        ({_VALID}) AND coalesce(embedding_model = 'leaflet-embed-2', false) AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS is_usable FROM document_chunks""",
    "embed_json_roundtrip": f"SELECT chunk_id, len(embedding)::INT AS n, round(list_sum(embedding), 6) AS total, round(embedding[1], 6) AS head FROM document_chunks WHERE {_VALID}",
    "embed_json_invalid": f"""SELECT 'event' AS kind, event_id AS id, coalesce(json_type(props) = 'ARRAY', false) AS is_vector FROM events
        UNION ALL SELECT 'chunk', chunk_id, {_VALID} FROM document_chunks""",
    "cosine_pairs": f"WITH v AS ({_V}) SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS sim FROM v q, v c WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(q.e, c.e) >= 0.35",
    "topk_batch": f"""WITH v AS ({_V}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 12) AS s FROM v q, v c WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, chunk_id, round(s, 6) AS sim FROM r WHERE rank <= 5""",
    "topk_boosted": f"""WITH v AS ({_V}), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 12) AS s, CASE WHEN q.label = c.label THEN 0.12 ELSE 0 END AS b FROM v q, v c WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s + b DESC, s DESC, chunk_id) AS rank FROM s WHERE s >= 0) SELECT query_id, rank::INT AS rank, chunk_id, round(s, 6) AS sim, round(s + b, 6) AS score FROM r WHERE rank <= 5""",
    "stale_filter_trace": """SELECT count(*) AS chunks, count(embedding) AS embedded, count(*) FILTER (embedding IS NOT NULL AND coalesce(embedding_model, '') NOT IN ('', 'leaflet-embed-2')) AS stale,
        count(*) FILTER (embedding IS NOT NULL AND coalesce(embedding_model, '') IN ('', 'leaflet-embed-2')) AS candidates FROM document_chunks JOIN medicines USING (medicine_id)""",
    "embedding_dims": "SELECT coalesce(embedding_model, '') AS model, count(DISTINCT len(embedding)) AS n_dims, count(*) AS n FROM document_chunks WHERE embedding IS NOT NULL GROUP BY 1",
    "name_match": """WITH q AS (SELECT split_part(p_name, ' ', 1) AS w, min(p_partkey) AS query_id FROM part GROUP BY 1)
        SELECT q.query_id, p.p_partkey FROM part p JOIN q ON split_part(p.p_name, ' ', 1) = q.w""",
    "quantity_extract": f"SELECT doc_id, quantity, count(*) AS n FROM (SELECT doc_id, unnest({_quantities(casefold('text'))}) AS quantity FROM documents) GROUP BY doc_id, quantity",
    "quantity_unsupported": f"""WITH c AS (SELECT conv_id, turn, role, min(content) AS content FROM chat_messages GROUP BY ALL),
        f AS (SELECT DISTINCT conv_id, turn, role, unnest({_quantities(casefold('content'))}) AS quantity FROM c)
        SELECT conv_id, turn, quantity FROM f WHERE role = 'assistant' EXCEPT SELECT conv_id, turn + 1, quantity FROM f WHERE role = 'user'""",
    "guard_classify": f"SELECT conv_id, turn, received_at, coalesce({_PERSONAL.replace('lower(content)', casefold('content'))}, false) AS personal, coalesce({_urgent('content')}, false) AS urgent FROM chat_messages",
    "critical_flag": f"SELECT medicine_id, bool_or(chunk_type = 'serious_side_effects' OR (chunk_type = 'warnings' AND {_urgent('chunk_text')})) AS critical FROM document_chunks GROUP BY medicine_id",
    "overlap_flag": f"WITH {_HITS}, {_PER} SELECT query_id, overlap FROM per",
    "source_distinct": f"WITH {_HITS}, {_PER} SELECT query_id, sources FROM src",
    "context_render": f"WITH {_HITS} SELECT query_id, md5(string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rank)) AS digest FROM hits GROUP BY query_id",
    "safety_notes": f"""WITH {_HITS}, {_PER} SELECT query_id, '{guard.NOTE_CRITICAL}' || CASE WHEN critical THEN '{guard.YES}' ELSE '{guard.NO}' END || '.' || chr(10) || '{guard.NOTE_OVERLAP}'
        || CASE WHEN overlap THEN '{guard.YES}' ELSE '{guard.NO}' END || '. {guard.NOTE_CONFLICT}' AS notes FROM per""",
    "general_first2": f"WITH {_HITS}, {_PER.replace('{0}', '|')} SELECT query_id, md5(general) AS digest FROM per",
    "personal_answers": f"WITH {_HITS}, {_PER.replace('{0}', _TWO)} SELECT query_id, md5({_REFUSED}) AS digest FROM per",
    "finalised": f"WITH {_HITS}, {_PER} SELECT query_id, md5({_finished('first', 'sources')}) AS digest FROM per JOIN src USING (query_id)",
    "answer_pipeline": _ANSWERS,
    "retrieve_chunks": f"WITH {_HITS} SELECT query_id, rank::INT AS rank, chunk_id, medicine_name, chunk_type, source_name, md5(chunk_text) AS digest, round(s, 6) AS sim FROM hits",
    "retrieve_unnamed": f"""WITH v AS (SELECT chunk_id, embedding AS e, embedding_model AS m FROM document_chunks WHERE {_VALID} AND medicine_id IN (SELECT medicine_id FROM medicines)
            AND coalesce(embedding_model, '') IN ('', 'leaflet-embed-2') AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.chunk_id AS query_id, v.chunk_id, round(list_cosine_similarity(q.e, v.e), 12) AS s FROM v q, v WHERE q.chunk_id % 50 = 0 AND q.m = 'leaflet-embed-2'),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM s WHERE s >= 0.35) SELECT query_id, rank::INT AS rank, chunk_id, round(s, 6) AS sim FROM r WHERE rank <= 5""",
    "ordered_scan": """SELECT chunk_id, medicine_id, md5(chunk_text) AS digest, chunk_type, coalesce(len(embedding), -1)::INT AS n, embedding_model, medicine_name, source_name, source_reference
        FROM document_chunks JOIN medicines USING (medicine_id) ORDER BY chunk_id""",
    "ingest_records": f"""WITH {_RECORDS} SELECT record_id, pos, t_medicine_name AS medicine_name, {_RECORD_COLUMNS},
        coalesce(nullif(t_source_name, ''), nullif(t_object, '')) AS source_name, coalesce(nullif(t_source_reference, ''), nullif(t_object_reference, '')) AS source_reference FROM named""",
    "ingest_bad_documents": f"WITH {_RECORDS} SELECT record_id, file_path FROM parsed WHERE record_id NOT IN (SELECT record_id FROM good)",
    "ingest_chunks": _CHUNKS,
    "response_split": f"""SELECT doc_id, md5({strip('text')}) AS digest, CASE WHEN lang IS NULL THEN '{guard.UNSTATED}' ELSE source END AS sources,
        CASE WHEN lang IS NULL THEN '-' ELSE 'Uyarı.' END AS disclaimer FROM documents WHERE text IS NOT NULL""",
}

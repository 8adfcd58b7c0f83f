"""The same results in DuckDB's SQL, written from the rules and not from the Spark plans."""

from __future__ import annotations

from folioflow.functions.text import LABEL_MAX_CHARS, NUMBER_WORDS
from folioflow.operators.chapters import EXCLUDED_LABELS, EXCLUDED_TYPES, KEPT_TYPES, NOTE_LIST_TYPES

WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CLOSERS = r"[\"'')\]”’]"


def _list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _pieces(source: str, key: str) -> str:
    """CTEs: ``sents`` (key, pos, s) of a source (key, text). DuckDB's patterns have no lookbehind: the stop of an initial is
    hidden behind chr(2) first, twice, as two initials share the blank between them."""
    initial = r"(^|[^\p{L}\p{N}_\p{M}])([A-Z])\."
    hide = f"regexp_replace(regexp_replace({_strip('text')}, '{initial}', '\\1\\2' || chr(2), 'g'), '{initial}', '\\1\\2' || chr(2), 'g')"
    mark = f"regexp_replace({hide}, '([!?;:.]{CLOSERS}*)({WS}|$)', '\\1' || chr(1) || '\\2', 'g')"
    # an initial's own stop never ends a sentence, but the marks after it may have been taken with it
    return f"""
sents AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, s FROM (
    SELECT {key}, i, {_strip("replace(parts[i], chr(2), '.')")} AS s
    FROM (SELECT {key}, string_split({mark}, chr(1)) AS parts FROM {source}) p, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
  ) x WHERE s <> ''
)"""


def _clips(source: str, key: str) -> str:
    cut = (
        "CASE WHEN length(regexp_extract(substr(rest, 1, 125), '(?s)^(.*[,;])', 1)) > 0 THEN length(regexp_extract(substr(rest, 1, 125), '(?s)^(.*[,;])', 1))"
        " WHEN length(regexp_extract(substr(rest, 1, 126), '(?s)^(.*) ', 1)) > 0 THEN length(regexp_extract(substr(rest, 1, 126), '(?s)^(.*) ', 1)) ELSE 125 END"
    )
    return f"""{_pieces(source, key)},
cuts AS (
  SELECT {key}, pos, 0 AS n, CASE WHEN length(s) <= 125 THEN s END AS part, CASE WHEN length(s) <= 125 THEN '' ELSE s END AS rest FROM sents
  UNION ALL
  SELECT {key}, pos, n + 1, CASE WHEN length(rest) <= 125 THEN rest ELSE {_strip(f"substr(rest, 1, {cut})")} END,
    CASE WHEN length(rest) <= 125 THEN '' ELSE {_strip(f"substr(rest, ({cut}) + 1)")} END
  FROM cuts WHERE rest <> ''
),
parts AS (SELECT {key}, list(part ORDER BY pos, n) AS p FROM cuts WHERE part IS NOT NULL AND regexp_matches(part, '[\\p{{L}}\\p{{N}}]') GROUP BY {key}),
clips AS (
  SELECT {key}, list_reduce(p, lambda a, x: CASE WHEN len(a) > 0 AND length(a[-1]) + 1 + length(x[1]) <= 125 THEN list_concat(a[:-2], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END, []::VARCHAR[]) AS c
  FROM (SELECT {key}, list_transform(p, lambda x: [x]) AS p FROM parts)
)"""


PARAS = "paras AS (SELECT DISTINCT para_id, book_id, doc_pos, para_pos, kind, text FROM paragraphs)"
BOOKS = "bk AS (SELECT book_id, max_by({'t': title, 'a': author}, {'l': loaded_at, 't': title, 'a': author}) AS b FROM books GROUP BY book_id), bks AS (SELECT book_id, b.t AS title, b.a AS author FROM bk)"
SENTS = "st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY text) AS rn FROM sentences) WHERE rn = 1)"
USES = f"{SENTS}, uses AS (SELECT substr(sha256(text), 1, 32) AS key, min(text) AS text, count(*) AS uses, arg_min(sent_id, {{'b': book_id, 'c': chapter_idx, 's': sent_idx, 'i': sent_id}}) AS first_use FROM st WHERE text IS NOT NULL GROUP BY 1)"
HAVE = "have AS (SELECT DISTINCT clip_key AS key FROM sentences WHERE clip_key IS NOT NULL)"
RANKED = f"{USES}, ranked AS (SELECT key, text, (row_number() OVER (ORDER BY length(text) DESC, key) - 1) // 64 AS batch FROM uses)"
LAST = f"right(regexp_replace(regexp_replace(text, '{WS}+$', ''), '{CLOSERS}+$', ''), 1)"
GAPS = f"""{SENTS}, gaps AS (
  SELECT *, CASE WHEN kind = 'heading' OR nxt IS NULL THEN 0.8 WHEN coalesce(np <> para_id, false) THEN 0.4 WHEN {LAST} IN (',', ';', ':', '') THEN 0.1 ELSE 0.25 END::DOUBLE AS gap
  FROM (SELECT *, lead(sent_id) OVER w AS nxt, lead(para_id) OVER w AS np FROM st WHERE text IS NOT NULL WINDOW w AS (PARTITION BY book_id, chapter_idx ORDER BY sent_idx, sent_id))
), placed AS (
  SELECT *, coalesce(sum(n_samples + trunc(gap * 24000)::BIGINT) OVER b, 0)::BIGINT AS start_sample
  FROM (SELECT *, trunc(greatest(0.2::DOUBLE, length(text) / 15.0::DOUBLE) * 24000)::BIGINT AS n_samples FROM gaps)
  WINDOW b AS (PARTITION BY book_id, chapter_idx ORDER BY sent_idx, sent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""
TIMELINE = f"""{GAPS}, lens AS (
  SELECT c.book_id, c.chapter_idx, coalesce(l.samples, 2400)::BIGINT AS samples FROM (SELECT DISTINCT book_id, chapter_idx FROM chapters) c
  LEFT JOIN (SELECT book_id, chapter_idx, sum(n_samples + trunc(gap * 24000)::BIGINT) AS samples FROM placed GROUP BY ALL) l USING (book_id, chapter_idx)
), tl AS (
  SELECT book_id, chapter_idx, samples, coalesce(sum(samples) OVER b, 0)::BIGINT AS book_start, coalesce(sum(ms) OVER b, 0)::BIGINT AS mark_start, (coalesce(sum(ms) OVER b, 0) + ms)::BIGINT AS mark_end
  FROM (SELECT *, round_even(samples / 24000.0::DOUBLE * 1000, 0)::BIGINT AS ms FROM lens)
  WINDOW b AS (PARTITION BY book_id ORDER BY chapter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def _stamp(samples: str) -> str:
    ms = f"round_even(({samples}) / 24000.0::DOUBLE * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


CUES = f"""{TIMELINE}, cue AS (
  SELECT p.book_id, p.chapter_idx, sent_idx, sent_id, {_stamp('book_start + start_sample')} || ' --> ' || {_stamp('book_start + start_sample + n_samples')} || chr(10) || text AS cue
  FROM placed p JOIN tl USING (book_id, chapter_idx)
)"""
ESCAPE = r"regexp_replace({}, '([=;#\\\n])', '\\\1', 'g')"
KEY = f"trim(regexp_replace(regexp_replace(replace(lower({{}}), 'ß', 'ss'), '[^\\p{{{{L}}}}\\p{{{{M}}}}\\p{{{{Nd}}}}\\p{{{{Pc}}}}\\p{{{{Nl}}}}\\x{{{{24B6}}}}-\\x{{{{24E9}}}}\\x{{{{200C}}}}\\x{{{{200D}}}}{WS[1:].replace('{', '{{{{').replace('}', '}}}}')}', '', 'g'), '{WS.replace('{', '{{{{').replace('}', '}}}}')}+', ' ', 'g'))".replace("{{{{", "{{").replace("}}}}", "}}")
BARE = r"'^(?i:\d{{1,3}}|[ivxlcdm]{{1,7}})\s*[.:)]?$'".replace("{{", "{").replace("}}", "}")
NORM = r"regexp_replace(regexp_replace(regexp_replace({}, '#.*$', '', 's'), '^(\.\./)+', ''), '^/+', '')"
BODY = "body AS (SELECT book_id, doc_pos, sum(CASE WHEN kind IS DISTINCT FROM 'heading' THEN coalesce(length(text), 0) ELSE 0 END)::BIGINT AS body_chars FROM paras GROUP BY ALL)"
TARGETS = f"""places AS (SELECT book_id, doc_pos, {NORM.format('href')} AS path FROM spine_docs),
entries AS (SELECT book_id, toc_pos, title, {NORM.format('href')} AS path FROM toc WHERE depth <= 1),
targets AS (
  SELECT e.book_id, e.toc_pos, e.title, coalesce(x.p, n.p) AS doc_pos FROM entries e
  LEFT JOIN (SELECT book_id, path, max(doc_pos) AS p FROM places GROUP BY ALL) x USING (book_id, path)
  LEFT JOIN (SELECT book_id, regexp_extract(path, '[^/]*$') AS name, min(doc_pos) AS p FROM places GROUP BY ALL) n ON n.book_id = e.book_id AND n.name = regexp_extract(e.path, '[^/]*$')
  WHERE coalesce(x.p, n.p) IS NOT NULL
),
mono AS (SELECT * EXCLUDE before FROM (SELECT *, max(doc_pos) OVER (PARTITION BY book_id ORDER BY toc_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM targets) WHERE before IS NULL OR doc_pos > before)"""
TAKES = f"""{USES}, takes AS (
  SELECT key, text, attempt, length(text) * ((length(text) + attempt * 3) % 7 + 1) * 0.0235::DOUBLE AS seconds, length(text) % 5 = 0 AS capped FROM uses, (VALUES (0), (1), (2)) a(attempt)
), missed AS (
  SELECT *, 2.0::DOUBLE + 0.1::DOUBLE * length(text) AS long_s, CASE WHEN length(text) < 20 THEN 0 ELSE 0.045::DOUBLE * length(text) END AS short_s,
    CASE WHEN capped AND seconds > 2.0::DOUBLE + 0.1::DOUBLE * length(text) THEN 'inf'::DOUBLE
      ELSE greatest(CASE WHEN length(text) < 20 THEN 0 ELSE 0.045::DOUBLE * length(text) END - seconds, seconds - (2.0::DOUBLE + 0.1::DOUBLE * length(text)), 0) END AS miss
  FROM takes
)"""

SQL: dict[str, str] = {
    "document_report": f"WITH RECURSIVE split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), lines AS (SELECT doc_id, doc_id * 1000000 + i AS line_id, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split)), {_clips('lines', 'line_id')} SELECT doc_id, count(*) AS clips, sum(length(x))::BIGINT AS chars FROM (SELECT line_id, unnest(c) AS x FROM clips) JOIN lines USING (line_id) GROUP BY doc_id",
    "sentence_split": f"WITH {PARAS}, {_pieces('paras', 'para_id')} SELECT para_id, pos AS piece_pos, s AS piece FROM sents",
    "clip_fill": f"WITH RECURSIVE {PARAS}, {_clips('paras', 'para_id')} SELECT para_id, unnest(range(0, len(c))) AS clip_pos, unnest(c) AS clip FROM clips",
    "clip_keys": f"WITH {USES} SELECT key, uses, first_use FROM uses",
    "pending": f"WITH {USES}, {HAVE} SELECT key, uses, first_use FROM uses ANTI JOIN have USING (key)",
    "chapter_counts": f"WITH {SENTS}, {HAVE}, k AS (SELECT DISTINCT book_id, chapter_idx, substr(sha256(text), 1, 32) AS key FROM st WHERE text IS NOT NULL) SELECT book_id, chapter_idx, count(h.key) AS cached, count(*) - count(h.key) AS missing FROM k LEFT JOIN have h USING (key) GROUP BY ALL",
    "batch_assign": f"WITH {RANKED} SELECT key, batch FROM ranked",
    "token_caps": f"WITH {RANKED} SELECT batch, count(*) AS clips, max(length(text)) AS most_chars, ceil((2.0::DOUBLE + 0.1::DOUBLE * max(length(text))) * 1.25 * 12.5)::BIGINT AS new_tokens FROM ranked GROUP BY batch",
    "sentence_gaps": f"WITH {GAPS} SELECT sent_id, gap FROM gaps",
    "silence_timeline": f"WITH {GAPS} SELECT sent_id, n_samples, start_sample FROM placed",
    "book_timeline": f"WITH {TIMELINE} SELECT book_id, chapter_idx, samples, book_start, mark_start, mark_end FROM tl",
    "vtt_cues": f"WITH {CUES} SELECT sent_id, cue FROM cue",
    "vtt_files": f"WITH {CUES} SELECT book_id, md5('WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) || chr(10) ORDER BY chapter_idx, sent_idx, sent_id) || chr(10)) AS digest FROM cue GROUP BY book_id",
    "metadata_files": f"""WITH {TIMELINE}, {BOOKS}, m AS (
  SELECT book_id, string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || mark_start || chr(10) || 'END=' || mark_end || chr(10) || 'title=' || {ESCAPE.format("coalesce(c.title, '')")} || chr(10), '' ORDER BY chapter_idx) AS blocks
  FROM tl JOIN chapters c USING (book_id, chapter_idx) GROUP BY book_id)
SELECT book_id, ';FFMETADATA1' || chr(10) || 'title=' || t || chr(10) || CASE WHEN trim(coalesce(author, ''), ' ') <> '' THEN 'artist=' || {ESCAPE.format('author')} || chr(10) ELSE '' END || 'album=' || t || chr(10) || coalesce(blocks, '') AS metadata
FROM (SELECT *, {ESCAPE.format("coalesce(title, '')")} AS t FROM bks) LEFT JOIN m USING (book_id)""",
    "chapter_report": f"""WITH {PARAS}, ids AS (SELECT DISTINCT book_id, chapter_idx, unnest(source_ids) AS doc_id FROM chapters),
sums AS (SELECT i.book_id, i.chapter_idx, count(*) AS paras, sum(coalesce(length(text), 0))::BIGINT AS chars FROM ids i JOIN spine_docs USING (book_id, doc_id) JOIN paras p USING (book_id, doc_pos) GROUP BY ALL)
SELECT c.book_id, c.chapter_idx, CASE WHEN length(title) > 50 THEN substr(title, 1, 49) || '…' ELSE title END AS title, len(source_ids)::INT AS docs, coalesce(paras, 0) AS paras, coalesce(chars, 0) AS chars
FROM chapters c LEFT JOIN sums USING (book_id, chapter_idx)""",
    "guard_window": f"WITH {TAKES} SELECT key, attempt, round(long_s, 4) AS long_s, round(short_s, 4) AS short_s, CASE WHEN miss = 'inf'::DOUBLE THEN -1 ELSE round(miss, 4) END AS miss FROM missed",
    "retry_best": f"""WITH {TAKES}, best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY miss, attempt) AS rn, max(attempt) OVER (PARTITION BY key) AS attempts FROM missed)
SELECT key, attempt, CASE WHEN attempts = 0 THEN NULL WHEN miss = 0 THEN 'recovered at attempt ' || attempt ELSE 'kept attempt ' || attempt || ' of ' || attempts END AS note FROM best WHERE rn = 1""",
    "doc_exclusion": f"""WITH {PARAS}, {BODY}, d AS (SELECT s.*, coalesce(b.body_chars, 0) AS body_chars FROM spine_docs s LEFT JOIN body b USING (book_id, doc_pos))
SELECT book_id, doc_pos, body_chars FROM d WHERE NOT (coalesce(list_has_any(epub_types, [{_list(NOTE_LIST_TYPES)}]), false) AND body_chars = 0)
  AND NOT (coalesce(list_has_any(epub_types, [{_list(EXCLUDED_TYPES)}]), false) AND NOT coalesce(list_has_any(epub_types, [{_list(KEPT_TYPES)}]), false))""",
    "running_headers": f"""WITH {PARAS}, {BOOKS}, h AS (SELECT book_id, doc_pos, min(para_pos) AS heading_pos, arg_min(coalesce(text, ''), para_pos) AS heading FROM paras WHERE kind = 'heading' GROUP BY ALL),
hits AS (SELECT h.* FROM h JOIN spine_docs USING (book_id, doc_pos) JOIN bks USING (book_id) WHERE title <> '' AND {KEY.format('heading')} = {KEY.format('title')})
SELECT book_id, doc_pos, heading_pos FROM hits QUALIFY count(*) OVER (PARTITION BY book_id) >= 3 AND row_number() OVER (PARTITION BY book_id ORDER BY doc_pos) > 1""",
    "toc_targets": f"WITH {TARGETS} SELECT book_id, toc_pos, doc_pos FROM targets",
    "toc_monotone": f"WITH {TARGETS} SELECT book_id, toc_pos, doc_pos FROM mono",
    "section_fold": f"""WITH {TARGETS}, l AS (SELECT *, regexp_matches(coalesce(title, ''), {BARE}) OR coalesce(title, '') LIKE '%...' AS label FROM mono),
n AS (SELECT *, last_value(CASE WHEN NOT label THEN lower(coalesce(title, '')) END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY doc_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS named FROM l)
SELECT book_id, toc_pos, doc_pos, title FROM n WHERE NOT (label AND named IS NOT NULL AND named NOT IN ({_list(EXCLUDED_LABELS)}))""",
    "chapter_mode": f"WITH {PARAS}, {BODY}, {TARGETS}, x AS (SELECT book_id, doc_pos FROM body JOIN spine_docs USING (book_id, doc_pos) WHERE body_chars > 0) SELECT x.book_id, count(m.doc_pos) / count(*) >= 0.3 AS by_contents FROM x LEFT JOIN (SELECT DISTINCT book_id, doc_pos FROM mono) m USING (book_id, doc_pos) GROUP BY x.book_id",
    "heading_islands": f"WITH {PARAS} SELECT para_id, sum(CASE WHEN kind = 'heading' AND (length({KEY.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) >= 3 OR regexp_matches(coalesce(text, ''), {BARE})) THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY doc_pos, para_pos)::BIGINT AS island FROM paras",
    "dump_text": f"WITH {PARAS}, ids AS (SELECT book_id, chapter_idx, unnest(source_ids) AS doc_id FROM chapters) SELECT book_id, chapter_idx, doc_pos, para_pos, CASE WHEN kind = 'heading' THEN '# ' ELSE '' END || text AS line FROM ids JOIN spine_docs USING (book_id, doc_id) JOIN paras p USING (book_id, doc_pos) WHERE text IS NOT NULL",
    "label_promotion": f"WITH {PARAS} SELECT para_id, CASE WHEN length(text) <= {LABEL_MAX_CHARS} AND regexp_matches(lower(text), '^(chapter|part|book)[\\s\\x{{00A0}}]+(\\d{{1,3}}|[ivxlcdm]{{1,7}}|({NUMBER_WORDS})([- ]({NUMBER_WORDS}))?)([^a-z0-9]|$)') THEN 'heading' ELSE 'body' END AS kind FROM paras WHERE kind = 'body' AND text IS NOT NULL",
    "title_keys": f"""WITH {BOOKS}, t AS (SELECT book_id, coalesce(title, '') AS t FROM bks)
SELECT book_id, coalesce(nullif(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'book') AS slug, {KEY.format('t')} AS key, {ESCAPE.format('t')} AS escaped, CASE WHEN length(t) > 20 THEN substr(t, 1, 19) || '…' ELSE t END AS short FROM t""",
    "collapsed": f"WITH {PARAS} SELECT para_id, trim(regexp_replace(regexp_replace(text, '{WS}*\\[\\d{{1,3}}\\]', '', 'g'), '{WS}+', ' ', 'g'), ' ') AS text FROM paras WHERE text IS NOT NULL",
}

_LEAD, _VOICE, _TRAIL = "(length(text) * 13 % 1900)", "(length(text) * 29 % 4000)", "(length(text) * 7 % 1500)"
_COLLAPSED = f"trim(regexp_replace(regexp_replace(text, '{WS}*\\[\\d{{1,3}}\\]', '', 'g'), '{WS}+', ' ', 'g'), ' ')"
_LABELLED = f"length(t) <= {LABEL_MAX_CHARS} AND regexp_matches(lower(t), '^(chapter|part|book)[\\s\\x{{00A0}}]+(\\d{{1,3}}|[ivxlcdm]{{1,7}}|({NUMBER_WORDS})([- ]({NUMBER_WORDS}))?)([^a-z0-9]|$)')"

SQL |= {
    "title_bytes": f"""WITH {BOOKS}, t AS (SELECT book_id, coalesce(title, '') AS t FROM bks),
c AS (SELECT *, substr(t, 1, list_max(list_filter(range(0, length(t) + 1), lambda i: strlen(substr(t, 1, i)) <= 21))) AS c FROM t)
SELECT book_id, CASE WHEN strlen(t) <= 24 THEN t ELSE regexp_replace(CASE WHEN contains(c, ' ') THEN regexp_extract(c, '(?s)^(.*) ', 1) ELSE c END, '[ ,;:]+$', '') || '…' END AS cut FROM c""",
    "running_headers_planted": f"""WITH {PARAS}, {BOOKS}, planted AS (SELECT book_id, doc_pos, para_pos, kind, text FROM paras UNION ALL SELECT s.book_id, doc_pos, -1, 'heading', upper(title) FROM spine_docs s JOIN bks USING (book_id) WHERE doc_pos % 2 = 1 AND title IS NOT NULL),
h AS (SELECT book_id, doc_pos, min(para_pos) AS heading_pos, arg_min(coalesce(text, ''), para_pos) AS heading FROM planted WHERE kind = 'heading' GROUP BY ALL),
hits AS (SELECT h.* FROM h JOIN spine_docs USING (book_id, doc_pos) JOIN bks USING (book_id) WHERE title <> '' AND {KEY.format('heading')} = {KEY.format('title')})
SELECT book_id, doc_pos, heading_pos FROM hits QUALIFY count(*) OVER (PARTITION BY book_id) >= 3 AND row_number() OVER (PARTITION BY book_id ORDER BY doc_pos) > 1""",
    "retry_rounds": f"""WITH {TAKES}, have AS (SELECT key, min(miss) AS miss, max(attempt) AS attempts FROM missed WHERE attempt <= length(text) % 3 GROUP BY key)
SELECT key, attempts + 1 AS attempt, attempts < 2 AS capped FROM have WHERE miss > 0 AND (attempts < 2 OR miss = 'inf'::DOUBLE)""",
    "retry_settled": f"""WITH {USES}, takes AS (
  SELECT key, text, attempt, attempt < 3 AS capped, length(text) * ((length(text) + attempt * 3) % 7 + 1) * 0.0235::DOUBLE AS seconds, 2.0::DOUBLE + 0.1::DOUBLE * length(text) AS most,
    CASE WHEN length(text) < 20 THEN 0 ELSE 0.045::DOUBLE * length(text) END AS least FROM uses, (VALUES (0), (1), (2), (3)) a(attempt)
), missed AS (SELECT *, CASE WHEN capped AND seconds > most THEN 'inf'::DOUBLE ELSE greatest(least - seconds, seconds - most, 0) END AS miss FROM takes),
ends AS (SELECT key, coalesce(min(attempt) FILTER (miss = 0 AND attempt < 3), CASE WHEN min(miss) FILTER (attempt < 3) = 'inf'::DOUBLE THEN 3 ELSE 2 END) AS attempts FROM missed GROUP BY key),
best AS (SELECT m.*, attempts, row_number() OVER (PARTITION BY m.key ORDER BY miss, attempt) AS rn FROM missed m JOIN ends USING (key) WHERE attempt <= attempts)
SELECT key, attempt, CASE WHEN attempts = 0 THEN NULL WHEN miss = 0 THEN 'recovered at attempt ' || attempt ELSE 'kept attempt ' || attempt || ' of ' || attempts END AS note FROM best WHERE rn = 1""",
    "chapter_plans": f"""WITH {GAPS} SELECT book_id, chapter_idx, count(*)::INT AS clips, md5(string_agg(substr(sha256(text), 1, 32), ' ' ORDER BY sent_idx, sent_id)) AS keys,
  md5(string_agg(round(gap * 100)::INT::VARCHAR, ' ' ORDER BY sent_idx, sent_id)) AS gaps FROM gaps GROUP BY ALL""",
    "stale_chapters": f"WITH {SENTS}, voiced AS (SELECT DISTINCT sent_id FROM sentences WHERE clip_key IS NOT NULL) SELECT DISTINCT book_id, chapter_idx FROM st ANTI JOIN voiced USING (sent_id) WHERE text IS NOT NULL",
    "engine_chars": "SELECT engine, greatest(1, floor((max_sentence / 4.0::DOUBLE - 2.0::DOUBLE) / 0.1::DOUBLE))::BIGINT AS chars FROM engine_limits",
    "trimmed_samples": f"""WITH {USES}, clip AS (SELECT key, {_LEAD}::BIGINT AS lead, {_VOICE}::BIGINT AS voice, {_TRAIL}::BIGINT AS trail FROM uses)
SELECT key, CASE WHEN voice = 0 OR lead + voice + trail < 80 THEN lead + voice + trail
  ELSE least(lead + voice + trail, (lead + voice + 79) // 80 * 80 + 400) - greatest(0, lead // 80 * 80 - 400) END AS samples FROM clip""",
    "epub_round_trip": f"""WITH {PARAS}, c AS (SELECT para_id, kind, {_COLLAPSED} AS t FROM paras WHERE text IS NOT NULL)
SELECT para_id, 'Book ' || para_id AS title, 'Writer ' || para_id % 7 AS author, 'picture ' || para_id AS cover, 'd' || para_id % 5 AS doc_id, 'a ' || para_id || '.xhtml' AS href, 'Entry ' || para_id AS entry,
  'a ' || para_id || '.xhtml#x' AS target, 2 AS depth, CASE WHEN kind = 'row' THEN 'row' WHEN kind = 'heading' OR {_LABELLED} THEN 'heading' ELSE 'body' END AS kind, t AS text FROM c WHERE t <> ''""",
    "book_lengths": f"WITH {TIMELINE}, w AS (SELECT book_id, floor(sum(samples) / 24000.0::DOUBLE)::BIGINT AS s FROM lens GROUP BY book_id) SELECT book_id, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS length FROM w",
    "concat_files": r"""WITH c AS (SELECT DISTINCT book_id, chapter_idx, '/it''s here/' || book_id || '-' || chapter_idx || '.wav' AS path FROM chapters)
SELECT book_id, md5('ffconcat version 1.0' || chr(10) || string_agg('file ' || chr(39) || replace(path, chr(39), chr(39) || '\' || chr(39) || chr(39)) || chr(39) || chr(10), '' ORDER BY chapter_idx)) AS digest FROM c GROUP BY book_id""",
}

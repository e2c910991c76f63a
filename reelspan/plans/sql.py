"""The transcript queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from ..functions.text import FALLBACK_MODELS, KEYED_HOST, LANGUAGES, MEDIA_EXTENSIONS
from ..sources.files import DEFAULT_SETTINGS


def _pad(n: str, width: int) -> str:
    return f"(CASE WHEN length(CAST({n} AS VARCHAR)) < {width} THEN lpad(CAST({n} AS VARCHAR), {width}, '0') ELSE CAST({n} AS VARCHAR) END)"


def _clock(ms: str) -> str:
    tail = f"{_pad(f'(({ms}) // 60000 % 60)', 2)} || ':' || {_pad(f'(({ms}) // 1000 % 60)', 2)} || '.' || {_pad(f'(({ms}) % 1000)', 3)}"
    return f"(CASE WHEN ({ms}) >= 3600000 THEN {_pad(f'(({ms}) // 3600000)', 2)} || ':' ELSE '' END || {tail})"


SEG = """seg AS (
  SELECT media_id, seg_idx, end_ms - dur AS start_ms, end_ms, speaker, text FROM (
    SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS seg_idx, role AS speaker, text, (500 + 60 * length(text))::BIGINT AS dur,
      (sum((turn % 3) * 400 + 500 + 60 * length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS end_ms
    FROM conversations))"""
CLK = SEG + f""", clk AS (
  SELECT media_id, seg_idx, {_clock('start_ms')} AS start, {_clock('end_ms')} AS "end", speaker, text FROM seg)"""
PICK = SEG + ", pick AS (SELECT media_id, seg_idx FROM seg WHERE seg_idx % 3 <> 1 AND seg_idx <= 4)"
TRANS = SEG + ", trans AS (SELECT media_id, seg_idx, start_ms, end_ms, speaker, '~ ' || text AS text FROM seg WHERE media_id % 2 = 0)"
STEPS = SEG + """, rng AS (SELECT * FROM seg WHERE seg_idx % 3 <> 1), steps AS (
  SELECT media_id, seg_idx, min_time, start_ms - min_time AS "offset", start_ms, end_ms FROM (
    SELECT *, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS min_time FROM rng))"""
SIL = """marks AS (
  SELECT user_id::BIGINT AS media_id, event_id::BIGINT AS ord, CASE event_type WHEN 'click' THEN 'S' ELSE 'E' END AS kind, (event_id * 1000)::BIGINT AS value
  FROM events WHERE event_type IN ('click', 'error')
), sil AS (
  SELECT media_id, ord, start_ms, value AS end_ms, value - start_ms AS duration_ms FROM (
    SELECT *, lag(kind) OVER w AS before, lag(value) OVER w AS start_ms FROM marks WINDOW w AS (PARTITION BY media_id ORDER BY ord))
  WHERE kind = 'E' AND before = 'S'
), media AS (
  SELECT user_id::BIGINT AS media_id, CASE WHEN user_id % 5 <> 0 THEN (max(event_id) * 1000 + 5000)::BIGINT END AS duration_ms FROM events GROUP BY user_id)"""


def _keep(source: str) -> str:
    return f"""gaps AS (
  SELECT media_id, ord, 0 AS tail, lag(end_ms, 1, 0) OVER (PARTITION BY media_id ORDER BY ord) AS start_ms, start_ms AS end_ms FROM {source}
), tails AS (
  SELECT l.media_id, l.ord, 1 AS tail, l.last_end AS start_ms, coalesce(m.duration_ms, l.last_end + 3600000) AS end_ms
  FROM (SELECT media_id, max(ord) AS ord, arg_max(end_ms, ord) AS last_end FROM {source} GROUP BY media_id) l LEFT JOIN media m USING (media_id)
), kept AS (
  SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY ord, tail) - 1)::BIGINT AS pos, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms
  FROM (SELECT * FROM gaps UNION ALL SELECT * FROM tails) WHERE end_ms > start_ms)"""


CLIPS = f"""raw AS (
  SELECT c_nationkey::BIGINT AS media_id, c_custkey::BIGINT AS clip_idx, c_name || ' / é! ' || (c_custkey % 7) AS title, c_custkey % 4 AS k, c_custkey % 900 AS t FROM customer
), norm AS (
  SELECT media_id, clip_idx, title, CASE k WHEN 1 THEN [[t, t + 30]] WHEN 2 THEN [[t, t + 20], [t + 40, t + 55]] WHEN 3 THEN [] ELSE [[t, t + 15]] END AS spans FROM raw)"""


def _filename(idx: str, label: str) -> str:
    clean = f"regexp_replace({label}, '[^\\p{{L}}\\p{{N}}_-]', '', 'g')"
    return f"'clip_' || {_pad(f'({idx} + 1)', 3)} || CASE WHEN {clean} <> '' THEN '_' || {clean} ELSE '' END || '.mp4'"


SHAPES = ["' 00:0' || (x % 10) || ':' || (x % 95)", "(x % 90) || ':' || (x % 70) || '.' || (x % 1200)", "'.' || x", "x || ':' || x || ':' || x || ':1'", "'00:0' || (x % 6) || ':0' || (x % 10) || '500'", "'-' || x || ':00'", "(x % 7) || ',5'", "'1:' || (x % 5) || ':' || (x % 60) || '.5'", "''", "'+' || x"]
STAMPS = "stamps AS (SELECT event_id AS x, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {s.replace('x', 'event_id')}" for i, s in enumerate(SHAPES)) + " END AS ts FROM events)"


def _int(e: str) -> str:
    return f"CASE WHEN regexp_full_match({e}, '[+-]?[0-9]+') THEN try_cast({e} AS INTEGER) END"


def _lead(e: str) -> str:
    return f"try_cast(nullif(regexp_extract({e}, '^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE)"


def _fields(sep: str) -> str:
    return f"""CASE WHEN len(f) >= 3 THEN {_pad('f[-3]', 2)} ELSE '00' END || ':' || CASE WHEN len(f) >= 2 THEN {_pad('f[-2]', 2)} ELSE '00' END || ':' || {_pad('f[-1]', 2)} || '{sep}' || rpad(ms, 3, '0')[1:3]"""


VOCAB = r"""lines AS (
  SELECT p_partkey % 4 AS vocab_id, p_partkey AS line_no, CASE WHEN p_partkey % 50 = 7 THEN ['<blk>', (p_partkey % 300)::VARCHAR]
    WHEN p_partkey % 9 = 0 THEN ['short'] ELSE [regexp_replace(p_name, '\s', '_', 'g'), (p_partkey % 300)::VARCHAR] END AS f FROM part
), entries AS (SELECT vocab_id::BIGINT AS vocab_id, line_no, f[1] AS token, f[2]::BIGINT AS token_id FROM lines WHERE len(f) >= 2)
, vocab AS (SELECT vocab_id, token_id, arg_max(token, line_no) AS token FROM entries GROUP BY ALL)"""
MERGE = """SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY grp) - 1)::BIGINT AS seg_idx, start_ms, end_ms, speaker, text FROM (
  SELECT media_id, grp, arg_min(start_ms, seg_idx) AS start_ms, arg_max(end_ms, seg_idx) AS end_ms, arg_min(speaker, seg_idx) AS speaker, string_agg(text, ' ' ORDER BY seg_idx) AS text
  FROM marked GROUP BY media_id, grp)"""
REPLIES = r"""said AS (
  SELECT conv_id::BIGINT AS media_id, turn::BIGINT AS turn, turn % 5 AS k, regexp_replace(text, '["\\\[\]\x00-\x1F\x7F]', ' ', 'g') AS t FROM conversations)"""

ORACLES: dict[str, str] = {
    "segments": f"WITH {SEG} SELECT * FROM seg",
    "distinct_speakers": f"WITH {SEG} SELECT DISTINCT media_id, speaker FROM seg",
    "speaker_lists": f"WITH {SEG} SELECT media_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM seg GROUP BY media_id",
    "rename_speaker": f"WITH {SEG} SELECT media_id, seg_idx, CASE WHEN speaker = 'user' THEN 'Host' ELSE speaker END AS speaker FROM seg",
    "speaker_exists": f"WITH {SEG} SELECT DISTINCT media_id FROM seg WHERE speaker = 'assistant'",
    "delete_selected": f"WITH {PICK} SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1)::BIGINT AS seg_idx, start_ms, end_ms, speaker, text FROM seg ANTI JOIN pick USING (media_id, seg_idx)",
    "save_edit": f"WITH {SEG} SELECT media_id, seg_idx, start_ms, end_ms + CASE WHEN seg_idx = 1 THEN 7 ELSE 0 END AS end_ms, speaker, CASE WHEN seg_idx = 1 THEN 'edited ' || text ELSE text END AS text FROM seg",
    "merge_down": f"WITH {SEG}, marked AS (SELECT *, CASE WHEN seg_idx = 2 THEN 1 ELSE seg_idx END AS grp FROM seg) {MERGE}",
    "merge_selected": f"""WITH {PICK}, few AS (SELECT media_id, min(seg_idx) AS first, count(*) AS n FROM pick GROUP BY media_id), marked AS (
  SELECT seg.*, CASE WHEN pick.seg_idx IS NOT NULL AND few.n >= 2 THEN few.first ELSE seg.seg_idx END AS grp
  FROM seg LEFT JOIN pick ON pick.media_id = seg.media_id AND pick.seg_idx = seg.seg_idx LEFT JOIN few ON few.media_id = seg.media_id) {MERGE}""",
    "language_view": f"WITH {TRANS} SELECT * FROM trans UNION ALL SELECT * FROM seg WHERE media_id NOT IN (SELECT media_id FROM trans)",
    "translation_pending": f"WITH {TRANS} SELECT media_id, seg_idx, text FROM seg WHERE media_id NOT IN (SELECT media_id FROM trans)",
    "silence_pairs": f"WITH {SIL} SELECT * FROM sil",
    "silence_totals": f"WITH {SIL} SELECT media_id, count(*) AS n, sum(duration_ms)::BIGINT AS silent_ms FROM sil GROUP BY media_id",
    "keep_ranges": f"WITH {SIL}, {_keep('sil')} SELECT * FROM kept",
    "offset_map": f'WITH {STEPS} SELECT media_id, min_time, "offset" FROM steps',
    "silence_removal": f"""WITH {SIL}, long AS (SELECT * FROM sil WHERE duration_ms >= 2000000), {_keep('long')}, o AS (
  SELECT media_id, start_ms, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS min_time FROM kept)
SELECT media_id, min_time, start_ms - min_time AS "offset" FROM o UNION ALL SELECT media_id, 0::BIGINT, 0::BIGINT FROM media WHERE media_id NOT IN (SELECT media_id FROM long)""",
    "timeline_remap": f"""WITH {STEPS} SELECT s.media_id, s.seg_idx,
  s.start_ms + coalesce((SELECT arg_max(x."offset", x.min_time) FROM steps x WHERE x.media_id = s.media_id AND x.min_time <= s.start_ms), 0) AS new_start_ms,
  s.end_ms + coalesce((SELECT arg_max(x."offset", x.min_time) FROM steps x WHERE x.media_id = s.media_id AND x.min_time <= s.end_ms), 0) AS new_end_ms FROM seg s""",
    "timeline_remap_exclusive": f"WITH {STEPS} SELECT media_id, seg_idx, start_ms AS new_start_ms, end_ms AS new_end_ms FROM steps",
    "remap_points": f"""WITH {STEPS}, p AS (SELECT media_id, seg_idx AS pid, seg_idx * 1500 AS t FROM seg)
SELECT media_id, pid, t, t + coalesce((SELECT arg_max(x."offset", x.min_time) FROM steps x WHERE x.media_id = p.media_id AND x.min_time <= p.t), 0) AS new_t FROM p""",
    "point_lookup": f"""WITH {STEPS}, p AS (SELECT media_id, seg_idx AS pid, seg_idx * 2500 AS t FROM seg), j AS (
  SELECT p.media_id, p.pid, p.t, min(CASE WHEN t >= start_ms AND t < end_ms THEN seg_idx END) AS seg_idx, min(CASE WHEN start_ms > t THEN start_ms END) AS nxt, arg_max(end_ms, seg_idx) AS last_end
  FROM p LEFT JOIN rng ON rng.media_id = p.media_id GROUP BY ALL)
SELECT media_id, pid, t, seg_idx::VARCHAR AS seg_idx, CASE WHEN seg_idx IS NULL THEN nxt END::VARCHAR AS next_start, coalesce(seg_idx IS NULL AND nxt IS NULL AND t > last_end, false) AS stop FROM j""",
    "clock_format": f"SELECT event_id, {_clock('event_id * 7919')} AS clock, {_pad('(event_id * 7919 // 60000)', 2)} || ':' || {_pad('(event_id * 7919 // 1000 % 60)', 2)} || '.' || {_pad('(event_id * 7919 % 1000)', 3)} AS minutes FROM events",
    "parse_timestamp": f"""WITH {STAMPS}, a AS (
  SELECT x, ts, replace(trim(ts), ' ', '') AS t, string_split(ts, ':') AS lf FROM stamps
), b AS (
  SELECT *, contains(t, '.') AS dotted, regexp_extract(t, ':([^:]*)$', 1) AS last FROM a
), c AS (
  SELECT *, NOT dotted AND regexp_full_match(last, '[0-9]{{3,}}') AS long FROM b
), d AS (
  SELECT *, CASE WHEN dotted THEN regexp_replace(t, '\\.[^.]*$', '') WHEN long THEN regexp_replace(regexp_replace(t, '[0-9]{{3}}$', ''), ':$', '') ELSE t END AS main,
    coalesce(try_cast(CASE WHEN dotted THEN rpad(regexp_extract(t, '\\.([^.]*)$', 1), 3, '0')[1:3] WHEN long THEN last[-3:] END AS DOUBLE), 0) AS ms FROM c
), e AS (SELECT *, string_split(main, ':') AS f FROM d
), g AS (
  SELECT *, CASE WHEN len(f) = 3 THEN {_int('f[1]')} ELSE 0 END AS h, CASE len(f) WHEN 3 THEN {_int('f[2]')} WHEN 2 THEN {_int('f[1]')} ELSE 0 END AS m,
    CASE WHEN len(f) = 1 AND main = '' THEN 0 WHEN len(f) <= 3 THEN {_int('f[-1]')} END AS s FROM e
), k AS (SELECT *, CASE WHEN s >= 60 THEN m + s // 60 ELSE m END AS m1, CASE WHEN s >= 60 THEN s % 60 ELSE s END AS s1 FROM g
), n AS (SELECT *, CASE WHEN m1 >= 60 THEN h + m1 // 60 ELSE h END AS h1, CASE WHEN m1 >= 60 THEN m1 % 60 ELSE m1 END AS m2 FROM k)
SELECT x AS event_id, ts, (CASE WHEN t <> '' AND len(f) <= 3 AND h1 >= 0 AND m2 >= 0 AND s1 >= 0 AND ms < 1000 THEN ((h1 * 3600 + m2 * 60 + s1) * 1000 + round(ms))::BIGINT END)::VARCHAR AS strict_ms,
  (round(1000 * CASE len(lf) WHEN 3 THEN {_lead('lf[1]')} * 3600 + {_lead('lf[2]')} * 60 + {_lead('lf[3]')} WHEN 2 THEN {_lead('lf[1]')} * 60 + {_lead('lf[2]')} ELSE {_lead('ts')} END)::BIGINT)::VARCHAR AS lenient_ms FROM n""",
    "subtitle_clocks": f"""WITH {STAMPS}, a AS (SELECT x, string_split_regex(ts, '[.,]') AS p FROM stamps), b AS (
  SELECT x, string_split(p[1], ':') AS f, CASE WHEN coalesce(p[2], '') = '' THEN '000' ELSE p[2] END AS ms FROM a)
SELECT x AS event_id, {_fields(',')} AS srt, {_fields('.')} AS vtt FROM b""",
    "subtitle_srt": f"""WITH {CLK}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS n FROM clk)
SELECT media_id, string_agg(n || chr(10) || CASE WHEN length(start) < 10 THEN '00:' ELSE '' END || replace(start, '.', ',') || ' --> ' || CASE WHEN length("end") < 10 THEN '00:' ELSE '' END || replace("end", '.', ',') || chr(10) || speaker || ': ' || text || chr(10), chr(10) ORDER BY seg_idx) AS content FROM n GROUP BY media_id""",
    "subtitle_vtt": f"""WITH {CLK} SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(CASE WHEN length(start) < 10 THEN '00:' ELSE '' END || start || ' --> ' || CASE WHEN length("end") < 10 THEN '00:' ELSE '' END || "end" || chr(10) || '<v ' || speaker || '>' || text, chr(10) || chr(10) ORDER BY seg_idx) AS content FROM clk GROUP BY media_id""",
    "subtitle_txt": f"""WITH {CLK} SELECT media_id, string_agg('[' || start || ' - ' || "end" || '] ' || speaker || ': ' || text, chr(10) ORDER BY seg_idx) AS content FROM clk GROUP BY media_id""",
    "transcript_lines": f"""WITH {CLK} SELECT media_id, string_agg('[' || start || '-' || "end" || '] ' || speaker || ': ' || text, chr(10) ORDER BY seg_idx) AS transcript FROM clk GROUP BY media_id""",
    "filter_graph": f"""WITH {CLK}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) - 1 AS n FROM clk)
SELECT media_id, string_agg('[0:v]trim=start=' || start || ':end=' || "end" || ',setpts=PTS-STARTPTS[v' || n || '];[0:a]atrim=start=' || start || ':end=' || "end" || ',asetpts=PTS-STARTPTS[a' || n || '];', '' ORDER BY n) || string_agg('[v' || n || '][a' || n || ']', '' ORDER BY n) || 'concat=n=' || count(*) || ':v=1:a=1[v][a]' AS graph FROM n GROUP BY media_id""",
    "audio_filter_graph": f"""WITH {SIL}, {_keep('sil')} SELECT media_id, string_agg('[0:a]atrim=start=' || (start_ms // 1000) || ':end=' || (end_ms // 1000) || ',asetpts=PTS-STARTPTS[a' || pos || '];', '' ORDER BY pos) || string_agg('[a' || pos || ']', '' ORDER BY pos) || 'concat=n=' || count(*) || ':v=0:a=1[outa]' AS graph FROM kept GROUP BY media_id""",
    "edit_list": f"WITH {SEG} SELECT media_id, seg_idx, start_ms, end_ms, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY media_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_ms FROM seg",
    "paths": f"""WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '/a.b/' ELSE '/ab/' END || s_name AS stem, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.mp4' ELSE '.tar' END AS mid, CASE s_suppkey % 3 WHEN 2 THEN '.Gz' ELSE '' END AS tail FROM supplier),
q AS (SELECT id, CASE WHEN mid = '.tar' THEN stem || mid ELSE stem END AS base, CASE WHEN mid = '.mp4' THEN mid ELSE tail END AS ext FROM p)
SELECT id, ltrim(ext, '.') IN ({', '.join(f"'{e}'" for e in MEDIA_EXTENSIONS)}) AS is_media, base || CASE WHEN id % 2 = 0 THEN '.French' ELSE '' END || '.srt' AS subtitle, base || '_cut' || ext AS cut, base || '_clips' AS clips, base || '.ogg' AS audio, base || '_nosilence.ogg' AS nosilence FROM q""",
    "clip_filenames": f"SELECT doc_id, {_filename('doc_id', 'text')} AS filename FROM documents",
    "clip_normalise": f"""WITH {CLIPS} SELECT media_id, clip_idx, len(spans)::BIGINT AS n_ranges, {_clock('spans[1][1] * 1000')} AS start, {_clock('spans[-1][2] * 1000')} AS "end" FROM norm""",
    "clip_plan": f"""WITH {CLIPS} SELECT media_id, clip_idx, {_filename('clip_idx', 'title')} AS filename, CASE WHEN len(spans) = 1 THEN 'single' ELSE 'concat' END AS mode, title, {_clock('spans[1][2] * 1000')} AS first_end FROM norm""",
    "best_clips": f"""WITH {CLIPS}, l AS (SELECT media_id, clip_idx, coalesce(list_sum(list_transform(spans, lambda s: s[2] - s[1])), 0)::BIGINT * 1000 AS length_ms FROM norm), r AS (
  SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY clip_idx) AS rank FROM l WHERE length_ms BETWEEN 10000 AND 32000)
SELECT media_id, clip_idx, rank, length_ms FROM r WHERE rank <= 3""",
    "json_extract": f"""WITH {REPLIES} SELECT media_id, turn, k IN (0, 3, 4) AS bracketed, CASE WHEN k IN (0, 3) THEN '2' END AS n_rows, k = 0 AS complete, CASE WHEN k IN (0, 3) THEN '00:0' || (turn + 2) END AS first_end FROM said""",
    "saved_transcripts": f"WITH {CLK} SELECT media_id, seg_idx, start, \"end\", speaker, text, CASE WHEN media_id % 2 <> 0 THEN 'about ' || media_id END AS context FROM clk",
    "chunk20": "SELECT lang, doc_id, p AS pos, p // 20 AS chunk FROM (SELECT lang, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::BIGINT AS p FROM documents)",
    "audio_windows": """WITH n AS (SELECT doc_id, n_chars * 1000 AS n_samples FROM documents WHERE n_chars > 0), w AS (
  SELECT doc_id, n_samples, unnest(range(0, greatest(0, (n_samples - 480000 + 431999) // 432000) + 1)) AS "window" FROM n)
SELECT doc_id, n_samples, "window", "window" * 432000 AS start_sample, least("window" * 432000 + 480000, n_samples) AS end_sample FROM w""",
    "downmix": """SELECT o_orderkey AS id, f AS frame, ((o_orderkey * (2 * f + 3)) % 17 + (o_orderkey * (2 * f + 4)) % 17) / 2.0::DOUBLE AS value FROM orders, range(4) r(f)""",
    "word_jaccard": r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS s FROM conversations WHERE turn < 2)
SELECT a.conv_id, CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE END AS similarity FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1""",
    "argmax": """WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 32 = 1 THEN [] ELSE list_transform(range(7), lambda i: CASE WHEN (o_orderkey + i) % 11 = 0 THEN -1.0 ELSE ((o_orderkey * (i * 5 + 2)) % 13)::DOUBLE END) END AS x FROM orders)
SELECT id, CASE WHEN len(x) = 0 THEN 0 ELSE list_position(x, list_max(x)) - 1 END::BIGINT AS index, CASE WHEN len(x) > 0 THEN list_max(x) END AS value FROM v""",
    "detokenise": """WITH t AS (SELECT l_orderkey AS stream_id, l_linenumber AS n, CASE WHEN l_partkey % 3 = 0 THEN chr(1) || 'W' || (l_partkey % 40) ELSE 'w' || (l_partkey % 40) END AS t, l_linenumber % 5 = 4 AS unk FROM lineitem), s AS (
  SELECT stream_id, coalesce(string_agg(t, '' ORDER BY n, t) FILTER (NOT unk), '') AS s FROM t GROUP BY stream_id)
SELECT stream_id, array_to_string(list_filter(string_split(s, chr(1)), lambda w: w <> ''), ' ') AS text FROM s""",
    "vocabulary": f"WITH {VOCAB} SELECT * FROM vocab",
    "vocabulary_facts": f"WITH {VOCAB} SELECT vocab_id, count(DISTINCT token_id) AS vocab_size, (arg_max(token_id, line_no) FILTER (token IN ('<blk>', '<blank>')))::VARCHAR AS blank_id FROM entries GROUP BY vocab_id",
    "token_lookup": f"WITH {VOCAB} SELECT vocab_id, token_id, l_orderkey AS stream_id, l_linenumber::BIGINT AS pos, token FROM lineitem JOIN vocab ON vocab_id = l_partkey % 4 AND token_id = l_partkey % 300",
    "media_durations": "SELECT user_id AS media_id, arg_min((event_id % 9) * 3600000 + (event_id % 60) * 60000 + (event_id % 59) * 1000 + 250, event_id)::BIGINT AS duration_ms FROM events WHERE event_id % 3 = 0 GROUP BY user_id",
    "base_urls": f"""WITH u AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 1 THEN 'http://' ELSE 'https://' END || lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '.{KEYED_HOST}' ELSE '/x' END AS url FROM nation) SELECT id::BIGINT AS id, url, id % 2 = 0 AS keyed FROM u""",
    "model_listing": f"""SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ',b' ELSE CASE WHEN n_nationkey % 3 = 0 THEN '{','.join(FALLBACK_MODELS[True])}' ELSE '{','.join(FALLBACK_MODELS[False])}' END END AS models FROM nation""",
    "base64_text": "SELECT doc_id, to_base64(encode(text)) AS base64 FROM documents",
    "media_sizes": "SELECT doc_id, round(n_chars * 1024 / 1048576.0 * 100)::BIGINT AS hundredths FROM documents",
    "without_fillers": r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace('Um, ' || regexp_replace(text, '[^ -~]', 'x', 'g') || ' uh... hmm so ERM yes', '(?i)\b(?:um+|uh+|erm?|hmm+|mhm)\b[,.]?\s*', '', 'g'), ' {2,}', ' ', 'g')) AS text FROM conversations""",
    "transcript_counts": f"WITH {SEG} SELECT media_id, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers, max(end_ms) AS length_ms FROM seg GROUP BY media_id",
    "translate": f"WITH {CLK} SELECT media_id, seg_idx, start, \"end\", speaker, '~ ' || text AS text FROM clk",
    "analyse": f"""WITH {SEG} SELECT DISTINCT media_id, 0::BIGINT AS seg_idx, '00:00' AS start, '00:' || {_pad('(media_id % 50 + 1)', 2)} AS "end", 'Speaker 1' AS speaker, 'media ' || media_id AS text FROM seg""",
    "suggest_clips": f"""WITH {CLK} SELECT media_id, 0::BIGINT AS clip_idx, '[{{"start":"' || arg_min(start, seg_idx) || '","end":"' || arg_min("end", seg_idx) || '"}}]' AS ranges, 'first' AS reason, 'Clip of ' || (1 + length(t) - length(replace(t, chr(10), ''))) || ' lines' AS title FROM (SELECT *, string_agg('x' || text, chr(10)) OVER (PARTITION BY media_id) AS t FROM clk) GROUP BY media_id, t""",
    "feature_transpose": "SELECT o_orderkey AS id, '[' || array_to_string(list_transform(range(5), lambda f: '[' || array_to_string(list_transform(range(4), lambda t: (o_orderkey * (t + 2) + f) % 19), ',') || ']'), ',') || ']' AS features FROM orders",
    "languages": f"SELECT unnest([{', '.join(f"'{x}'" for x in LANGUAGES)}]) AS language",
    "settings": f"""SELECT n_nationkey::BIGINT AS id, '{DEFAULT_SETTINGS['baseUrl']}' AS "baseUrl", CASE WHEN n_nationkey % 4 = 2 THEN 'k' ELSE '' END AS "apiKey",
  CASE WHEN n_nationkey % 4 = 0 THEN 'm' || n_nationkey ELSE '{DEFAULT_SETTINGS['model']}' END AS model, CASE WHEN n_nationkey % 4 = 0 THEN 'a, b' ELSE '' END AS glossary FROM nation""",
    "text_documents": "SELECT n_nationkey::BIGINT AS media_id, n_name || chr(10) || n_regionkey || chr(10) AS content FROM nation",
    "tool_logs": """WITH l AS (SELECT n_nationkey AS id, unnest([n_name, n_regionkey::VARCHAR, '']) AS line, unnest([0, 1, 2]) AS ord FROM nation) SELECT ord::BIGINT AS ord, line, count(DISTINCT id) AS n FROM l GROUP BY ALL""",
    "audio": """SELECT n_nationkey::BIGINT AS id, f AS sample, ((n_nationkey * 131 + 34 * f) % 2000 - 1000 + (n_nationkey * 131 + 34 * f + 17) % 2000 - 1000)::BIGINT AS value FROM nation, range(100) r(f) WHERE f < 50 + n_nationkey""",
    "silence_stream": f"WITH {SIL} SELECT * FROM sil",
    "greedy_decode": """WITH RECURSIVE s AS (
  SELECT c_custkey AS id, c_custkey % 200 AS n, 0::BIGINT AS frame, 0 AS taken, 0::BIGINT AS last, []::BIGINT[] AS out FROM customer
  UNION ALL
  SELECT id, n, CASE WHEN tok = 0 OR taken = 9 THEN frame + 1 ELSE frame + greatest(1, bins) END, CASE WHEN tok = 0 OR taken = 9 THEN 0 ELSE taken + 1 END,
    CASE WHEN tok = 0 THEN last ELSE tok END, CASE WHEN tok = 0 THEN out ELSE list_append(out, tok) END
  FROM (SELECT *, (id * 7 + frame * 5 + last) % 6 AS tok, (id + frame) % 4 AS bins FROM s WHERE frame < n AND len(out) < 4096))
SELECT id AS stream_id, array_to_string(out, ' ') AS tokens FROM s WHERE frame >= n OR len(out) >= 4096""",
    "local_transcript": """WITH n AS (SELECT doc_id, n_chars * 1000 AS n FROM documents WHERE n_chars > 0), w AS (SELECT doc_id, n, unnest(range(0, greatest(0, (n - 480000 + 431999) // 432000) + 1)) AS i FROM n)
SELECT doc_id AS media_id, i AS seg_idx, i * 27000 AS start_ms, i * 27000 + (least(480000, n - i * 432000) // 16)::BIGINT + CASE WHEN least(480000, n - i * 432000) % 16 >= 8 THEN 1 ELSE 0 END AS end_ms, 'Local' AS speaker, 'media ' || doc_id || ' from ' || (i * 432000) AS text FROM w""",
}

"""DuckDB SQL for the queries; number queries compute the expected words from the numeric column, not from a pattern."""

from __future__ import annotations

from lipika.functions import numbers as N
from lipika.functions import postprocess as P

LEX = "[" + ", ".join(f"'{w}'" for w in N.ONES) + "]"
WS = r"[\s\x{85}\x{A0}\x{1C}-\x{1F}\p{Z}]"


def words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda w: w <> '')"


def trim(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{WS}+', ''), '{WS}+$', '')"


def stype(t: str) -> str:
    return f"CASE WHEN {trim(t)} LIKE '%?' THEN 'question' WHEN {trim(t)} LIKE '%!' THEN 'exclamation' ELSE 'statement' END"


def said(n: str) -> str:
    lex = lambda i: f"{LEX}[CAST({i} AS INT) + 1]"
    return f"""CASE WHEN ({n}) >= 100000 THEN NULL WHEN ({n}) < 100 THEN {lex(n)} ELSE concat_ws(' ',
      CASE WHEN ({n}) >= 1000 THEN {lex(f"({n}) // 1000")} || ' {N.THOUSAND}' END,
      CASE WHEN ({n}) % 1000 = 100 THEN '{N.HUNDRED}' WHEN ({n}) % 1000 > 100 THEN {lex(f"(({n}) % 1000) // 100")} || '{N.HUNDREDS}' END,
      CASE WHEN ({n}) % 100 > 0 THEN {lex(f"({n}) % 100")} END) END"""


def decimal(whole: str, digit: str) -> str:
    """Words of whole.digit for a one-digit fraction."""
    halves = "[" + ", ".join(f"'{w}'" for w in N.HALVES) + "]"
    return f"""CASE WHEN ({digit}) = 5 AND ({whole}) < 3 THEN {halves}[CAST({whole} AS INT) + 1]
      WHEN ({digit}) = 5 AND ({whole}) < 100 THEN '{N.HALF}' || {LEX}[CAST({whole} AS INT) + 1]
      ELSE {said(whole)} || ' {N.POINT} ' || {LEX}[CAST({digit} AS INT) + 1] END"""


LINES = """lines AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CAST(floor(l_quantity) AS BIGINT) AS whole FROM lineitem)"""
GROUPED = "format('{:,}', price)"
DEV = "'0123456789', '०१२३४५६७८९'"
SIGN = "CASE l_linenumber % 4 WHEN 0 THEN '₹' WHEN 1 THEN {gap} WHEN 2 THEN '$' ELSE '' END"
DOCS = f"docs AS (SELECT doc_id, length(text) AS chars, len({words('text')}) AS words, {stype('text')} AS sentence_type FROM documents)"
MARKED = "marked AS (SELECT *, replace(text, ', ', ' [pause] ') AS marked, (length(text) - length(replace(text, ', ', ''))) // 2 AS pauses FROM conversations)"
TURNS = """turns AS (SELECT conv_id, turn, text AS ref, answer AS hyp FROM
  (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS answerer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND answerer = 'assistant')"""


def distance(ref: str, hyp: str) -> str:
    """Edit distance of two word lists: one list_reduce per reference word over a row of costs."""
    return f"""list_reduce(list_prepend([x::BIGINT for x in range(0, len({hyp}) + 1)], [[j::BIGINT] for j in range(1, len({ref}) + 1)]),
      lambda prev, i: list_reduce(list_prepend([i[1]], [[j::BIGINT] for j in range(1, len({hyp}) + 1)]),
        lambda acc, j: list_append(acc, least(prev[j[1]] + CASE WHEN {hyp}[j[1]] = {ref}[i[1]] THEN 0 ELSE 1 END, prev[j[1] + 1] + 1, acc[-1] + 1))))[-1]"""


WORDED = f"{TURNS}, w AS (SELECT conv_id, turn, {words('ref')} AS r, {words('hyp')} AS h FROM turns)"

#: The transcript lacks the reference's first word.
REPORT = f"""w AS (SELECT *, {words('text')} AS r, list_prepend('so', {words('text')}[1:greatest(len({words('text')}) - 2, 0)]) AS h FROM conversations),
  report AS (SELECT conv_id, turn, text AS reference, CASE WHEN turn % 4 <> 3 THEN array_to_string(r[2:], ' ') END AS transcribed, CASE WHEN turn % 4 = 3 THEN 'no audio' END AS error,
    {distance('r', 'h')}::DOUBLE / len(r) AS normalized_wer, CASE WHEN turn % 4 <> 3 THEN 1.0::DOUBLE / len(r) END AS wer FROM w)"""

SQL = {
    "corpus_profile": f"WITH {DOCS} SELECT sentence_type, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words, round(avg(words), 6) AS mean_words FROM docs GROUP BY 1",
    "sentence_types_by_key": f"WITH {DOCS} SELECT sentence_type, count(*) AS n FROM docs GROUP BY 1",
    "languages_by_count": "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "null_dup_distinct": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(*) - count(DISTINCT {c}) - CAST(count(*) > count({c}) AS BIGINT) AS duplicate_count, count(DISTINCT {c}) AS distinct_count FROM documents"
        for c in ("text", "lang", "source")
    ),
    "length_describe": f"WITH {DOCS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM docs"
        for c in ("chars", "words")
    ),
    "length_hist30": f"""WITH {DOCS}, s AS (SELECT min(chars)::DOUBLE AS lo, max(chars)::DOUBLE AS hi FROM docs),
      c AS (SELECT least(CAST(floor((chars - lo) * 30 / (hi - lo)) AS BIGINT), 29) AS bin, count(*) AS n FROM docs, s GROUP BY 1)
      SELECT b.range AS bin, round(lo + b.range * ((hi - lo) / 30), 6) AS bin_from, round(lo + (b.range + 1) * ((hi - lo) / 30), 6) AS bin_to, coalesce(n, 0) AS n
      FROM range(0, 30) b CROSS JOIN s LEFT JOIN c ON c.bin = b.range""",
    "pause_hist": f"WITH {MARKED}, c AS (SELECT pauses, count(*) AS n FROM marked GROUP BY 1) SELECT v.range AS value, coalesce(n, 0) AS n FROM range(0, (SELECT max(pauses) + 1 FROM marked)) v LEFT JOIN c ON c.pauses = v.range",
    "pause_counts": f"WITH {MARKED} SELECT pauses, count(*) AS n FROM marked GROUP BY 1",
    "pause_coverage": f"WITH {MARKED} SELECT count(*) AS n, count(*) FILTER (pauses = 0) AS without, round(avg(CASE WHEN pauses = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_without, max(pauses) AS most FROM marked",
    "corpus_features": f"""WITH {MARKED} SELECT conv_id * 1000 + turn AS row_id, length(text) AS input_chars, length(marked) AS output_chars, len({words('text')}) AS input_words, len({words('marked')}) AS output_words,
      len(regexp_extract_all(marked, '\\[pause\\]')) AS pause_count, {stype('text')} AS sentence_type, regexp_matches(text, '[A-Za-z]') AS input_has_latin, regexp_matches(replace(marked, '[pause]', ''), '[A-Za-z]') AS output_has_latin FROM marked""",
    "instruction_constant": "SELECT 'instruction' AS column_name, count(*) AS row_count, 0::BIGINT AS null_count, count(*) - 1 AS duplicate_count, 1::BIGINT AS distinct_count FROM conversations",
    "latin_coverage": "SELECT count(*) FILTER (regexp_matches(text, '[A-Za-z]')) AS latin_count, round(avg(CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 1.0::DOUBLE ELSE 0 END), 6) AS latin_fraction FROM documents",
    "latin_leak": f"WITH {MARKED} SELECT conv_id * 1000 + turn AS row_id, text AS input, marked AS output FROM marked WHERE regexp_matches(text, '[A-Za-z]') AND regexp_matches(replace(marked, '[pause]', ''), '[A-Za-z]') ORDER BY row_id LIMIT 10",
    "shortest5": f"WITH {DOCS} SELECT doc_id, chars, words FROM docs ORDER BY words, doc_id LIMIT 5",
    "longest5": f"WITH {DOCS} SELECT doc_id, chars, words FROM docs ORDER BY words DESC, doc_id LIMIT 5",
    "head_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5",
    "head_all": "SELECT doc_id, lang FROM documents",
    "int_words": f"WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders) SELECT o_orderkey, n, {said('n % 100000')} AS said FROM o",
    "int_words_overflow": f"WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders) SELECT o_orderkey, {GROUPED} AS t, CASE WHEN price < 1000 OR price >= 100000 THEN {GROUPED} ELSE {said('price')} END AS said, price >= 100000 AS overflow FROM o",
    "comma_int_expand": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {SIGN.format(gap="'₹ '")} || CASE WHEN price < 1000 OR price >= 100000 THEN {GROUPED} ELSE {said('price')} END || ' आहे' AS said FROM lines",
    "comma_int_devanagari": f"WITH {LINES} SELECT l_orderkey, l_linenumber, CASE WHEN price < 1000 OR price >= 100000 THEN translate({GROUPED}, {DEV}) ELSE {said('price')} END AS said FROM lines",
    "decimal_expand": f"WITH {LINES} SELECT l_orderkey, l_linenumber, 'साधारण ' || {decimal('whole', 'l_linenumber')} || ' आहे' AS said FROM lines",
    "decimal_half": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {decimal('whole - 1', '5')} || ' km' AS said FROM lines",
    "decimal_devanagari": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {decimal('whole', 'l_linenumber')} AS said FROM lines",
    "currency_guard": f"WITH {LINES} SELECT l_orderkey, l_linenumber, {SIGN.format(gap="'₹'")} || CASE WHEN l_linenumber % 4 = 3 THEN {decimal('whole', 'l_linenumber')} ELSE whole || '.' || l_linenumber END AS said FROM lines",
    "boundary_guard": f"WITH {LINES} SELECT l_orderkey, l_linenumber, CASE l_suppkey % 4 WHEN 0 THEN {decimal('whole', 'l_linenumber')} || ' kg' WHEN 1 THEN whole || '.' || l_linenumber || 'kg' WHEN 2 THEN {decimal('whole', 'l_linenumber')} || '%' ELSE {decimal('whole', 'l_linenumber')} || '°C' END AS said FROM lines",
    # The decimal pass takes the last group; what is left of a grouping has no full group any more.
    "preprocess_chain": f"""WITH {LINES} SELECT l_orderkey, l_linenumber, CASE WHEN price < 1000 THEN '' WHEN price < 1000000 THEN (price // 1000) || ',' END || {decimal('price % 1000', 'l_linenumber')} || ' व ' ||
      CASE WHEN price < 1000 OR price >= 100000 THEN {GROUPED} ELSE {said('price')} END AS said FROM lines""",
    "prompt_build": f"SELECT conv_id, turn, '### Instruction:' || chr(10) || '{P.INSTRUCTION}' || chr(10) || chr(10) || '### Input:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt FROM conversations",
    "stop_marker_cut": "SELECT conv_id, turn, text || chr(10) AS said FROM conversations",
    "sentence_end_count": f"SELECT doc_id, len(regexp_extract_all(text, '[.!?]({WS}|$)')) AS ends FROM documents",
    "runaway_cut": "SELECT conv_id, turn, text AS said FROM conversations WHERE regexp_matches(text, '[.!?]$')",
    "restart_cut": f"""WITH o AS (SELECT conv_id, turn, concat_ws(' ', 'w' || conv_id || 'x' || turn, 'zq zr', {trim("regexp_replace(text, '[.,!?\\s]+', ' ', 'g')")}) AS said FROM conversations) SELECT * FROM o WHERE len({words('said')}) >= 6""",
    "apply_pauses": f"WITH {MARKED} SELECT conv_id, turn, {trim(f"regexp_replace(regexp_replace(marked, '{WS}*\\[pause\\]{WS}*', ', ', 'g'), '([,.!?]){WS}*,', '\\1', 'g')")} AS said FROM marked",
    "pair_wer": f"WITH {WORDED} SELECT conv_id, turn, {distance('r', 'h')} AS distance, round({distance('r', 'h')}::DOUBLE / len(r), 6) AS wer FROM w",
    "pair_wer_macro": f"WITH {WORDED} SELECT count(*) AS n, round(avg({distance('r', 'h')}::DOUBLE / len(r)), 6) AS wer FROM w",
    # The hypothesis holds every reference word and one word more.
    "strip_artifacts_wer": f"WITH {TURNS} SELECT conv_id, turn, array_to_string({words('ref')}, ' ') || ' ' || array_to_string({words('ref')}, ' ') || ' x' AS kept, round(1.0::DOUBLE / (2 * len({words('ref')})), 6) AS wer FROM turns",
    "eval_report": f"""WITH {REPORT} SELECT conv_id, turn, reference, transcribed, error, round(normalized_wer, 6) AS normalized_wer, round(wer, 6) AS wer FROM report""",
    "eval_summary": f"WITH {REPORT} SELECT count(*) AS eval_rows, count(wer) AS scored, count(*) - count(wer) AS errored, round(avg(normalized_wer), 6) AS normalizer_wer, round(avg(wer), 6) AS round_trip_wer FROM report",
    # Two words more in every reference than in what comes back.
    "eval_stub_round_trip": f"""WITH s AS (SELECT text AS input, text || ' and on' AS reference, {trim('text')} AS said FROM conversations)
      SELECT input, reference, said AS normalized, round(2.0::DOUBLE / len({words('reference')}), 6) AS normalized_wer, said AS transcribed, round(2.0::DOUBLE / len({words('reference')}), 6) AS wer, CAST(NULL AS VARCHAR) AS error FROM s""",
    "speak_requests": f"""WITH q AS (SELECT text, CASE WHEN doc_id % 3 = 0 THEN 'stub_wav' ELSE lang END AS engine, length({trim("coalesce(text, '')")}) AS n FROM documents)
      SELECT text, engine, CASE WHEN n BETWEEN 1 AND 500 THEN 200 ELSE 400 END::BIGINT AS status, CASE WHEN n = 0 THEN 'Text must not be empty.' WHEN n > 500 THEN 'Text must be at most 500 characters.' END AS detail,
        CASE WHEN n BETWEEN 1 AND 500 THEN left(sha256(text), 16) || CASE engine WHEN 'stub_wav' THEN '.wav' ELSE '.mp3' END END AS name,
        CASE WHEN n BETWEEN 1 AND 500 THEN CASE engine WHEN 'stub_wav' THEN 'audio/wav' ELSE 'audio/mpeg' END END AS mime FROM q""",
    # Batches are merged as long as what is there falls short of the target.
    "grow_corpus": """WITH d AS (SELECT DISTINCT text AS input FROM documents WHERE text <> ''), n AS (SELECT count(*) AS n FROM d),
      b AS (SELECT item_id % 4 AS batch, count(*) AS k FROM benchmark GROUP BY 1), upto AS (SELECT batch, coalesce(sum(k) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
      every AS (SELECT input FROM d UNION SELECT 'bench ' || item_id FROM benchmark JOIN upto ON item_id % 4 = batch WHERE before < 10)
      SELECT input FROM every ORDER BY input LIMIT (SELECT n + 10 FROM n)""",
    "audio_name": "SELECT doc_id, left(sha256(text), 16) || '.mp3' AS name FROM documents",
    "data_url": "SELECT conv_id, turn, 'data:' || CASE turn % 2 WHEN 0 THEN 'audio/wav' ELSE 'audio/mpeg' END || ';base64,' || to_base64(encode(text)) AS url FROM conversations",
    "validate_requests": f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 400 WHEN doc_id % 7 = 1 THEN 200 WHEN length({trim('text')}) BETWEEN 1 AND 500 THEN 200 ELSE 400 END::BIGINT AS status,
      CASE WHEN doc_id % 7 = 0 THEN 'Text must not be empty.' WHEN doc_id % 7 = 1 THEN NULL WHEN length({trim('text')}) = 0 THEN 'Text must not be empty.' WHEN length({trim('text')}) > 500 THEN 'Text must be at most 500 characters.' END AS detail FROM documents""",
    "json_roundtrip": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.k'), 'none') AS again FROM events",
    "reply_sentences": "SELECT unnest(string_split(text, '. ')) AS sentence FROM conversations WHERE turn % 2 = 0",
    "reply_default": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END AS output FROM conversations",
    "merge_unique": f"SELECT text FROM benchmark UNION SELECT {trim('text')} FROM documents WHERE {trim('text')} <> ''",
    "resume_todo": "SELECT doc_id, text FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 3 = 0 AND b.text = a.text)",
    "resume_stream_run": "SELECT DISTINCT text AS input, text || '!' AS output FROM documents",
}

"""DuckDB oracle SQL for every registered query (same column names).

Shared building blocks are CTE snippets; each query is ``WITH ... SELECT``.
"""

from __future__ import annotations

# clean_text: tags, white-space runs (Python's Unicode \s), control chars, trim
CLEAN = ("trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), "
         "'[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'), "
         "'[\\x{{00}}-\\x{{08}}\\x{{0b}}\\x{{0c}}\\x{{0e}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}]', '', 'g'))")


def clean(x: str) -> str:
    return CLEAN.format(x=x)


def md5key(x: str) -> str:
    return f"substr(md5({x}), 1, 16)"


TAIL = ("text || ' $N(SH' || lpad(CAST(length(text) % 97 AS VARCHAR), 6, '0') || ')$' || "
        "CASE WHEN length(text) % 3 = 0 THEN ' 600519.SH' ELSE '' END")

SYMBOLS = """list_sort(list_distinct(list_filter(flatten([
  list_transform(regexp_extract_all({t}, '(?i)\\$([A-Z]{{1,5}})\\$', 1), lambda x: upper(x)),
  list_transform(regexp_extract_all({t}, '(?i)SH(\\d{{6}})', 1), lambda x: upper(x)),
  list_transform(regexp_extract_all({t}, '(?i)SZ(\\d{{6}})', 1), lambda x: upper(x)),
  list_transform(regexp_extract_all({t}, '(?i)HK(\\d{{5}})', 1), lambda x: upper(x)),
  list_transform(regexp_extract_all({t}, '(?i)\\d{{6}}\\.(?:SH|SZ|HK)'), lambda m: replace(upper(m), '.', '')),
  list_transform(regexp_extract_all({t}, '(?i)\\$[A-Z\\d]{{1,6}}\\([A-Z]{{2}}\\d+\\)\\$'), lambda m: upper(regexp_replace(m, '[$()]', '', 'g'))),
  list_transform(regexp_extract_all({t}, '\\$[^\\$]+\\(([A-Z]{{2}}\\d+)\\)\\$', 1), lambda x: upper(x))
]), lambda x: length(x) >= 2)))"""


def symbols(t: str) -> str:
    return SYMBOLS.format(t=t)


# raw posts → cleaned → keyed → first wins per id (tab_rank, doc order)
POSTS_CTE = f"""
raw AS (
  SELECT doc_id AS ingest_seq, source AS tab, CAST(substr(source, 4) AS INTEGER) AS tab_rank,
         lang, {TAIL} AS raw_text
  FROM documents),
cand AS (
  SELECT ingest_seq, tab, tab_rank, lang, {clean('raw_text')} AS text
  FROM raw WHERE length(raw_text) >= 5),
keyed AS (
  SELECT *, {md5key('text')} AS id FROM cand
  WHERE length(text) > 0 AND length(trim(regexp_replace(text, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) > 0),
posts AS (
  SELECT *, {symbols('text')} AS symbols
  FROM keyed QUALIFY row_number() OVER (PARTITION BY id ORDER BY tab_rank, ingest_seq) = 1)
"""

# labelled summaries (one per labelled document) and the latest per post
SUMM_CTE = f"""
lab AS (
  SELECT r.ingest_seq, r.tab, r.tab_rank, r.lang, {clean('r.raw_text')} AS text, l.quality, l.toxic
  FROM raw r JOIN labels l ON r.ingest_seq = l.doc_id),
summ AS (
  SELECT {md5key('text')} AS post_id, tab, tab_rank, ingest_seq, lang, text,
         CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment,
         ['Co-' || upper(lang), 'Co-' || tab] AS companies,
         {symbols('text')} AS tickers
  FROM lab),
last_summ AS (
  SELECT * FROM summ QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY tab_rank DESC, ingest_seq DESC) = 1)
"""

ORACLE: dict[str, str] = {}

ORACLE["stock_mentions"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE},
ps AS (
  SELECT p.id, p.tab_rank, p.ingest_seq, p.symbols,
         CASE WHEN s.sentiment IN ('positive', 'negative') THEN s.sentiment ELSE 'neutral' END AS cls
  FROM posts p LEFT JOIN last_summ s ON p.id = s.post_id),
ex AS (SELECT unnest(symbols) AS symbol, cls, tab_rank, ingest_seq FROM ps),
agg AS (
  SELECT symbol, count(*) AS mention_count,
         CAST(sum(CASE WHEN cls = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive_mentions,
         CAST(sum(CASE WHEN cls = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral_mentions,
         CAST(sum(CASE WHEN cls = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative_mentions,
         min({{'r': tab_rank, 's': ingest_seq}}) AS first_pos
  FROM ex GROUP BY symbol)
SELECT CAST(row_number() OVER (ORDER BY mention_count DESC, first_pos, symbol) AS BIGINT) AS rank,
       symbol, mention_count, positive_mentions, neutral_mentions, negative_mentions,
       CASE WHEN positive_mentions > negative_mentions * 1.5 THEN 'positive'
            WHEN negative_mentions > positive_mentions * 1.5 THEN 'negative' ELSE 'neutral' END AS overall_sentiment,
       round(CASE WHEN positive_mentions + negative_mentions = 0 THEN 0.5
                  ELSE positive_mentions / (positive_mentions + negative_mentions) END, 6) AS sentiment_ratio
FROM agg ORDER BY rank LIMIT 20
"""


# ------------------------------------------------------------------ helpers
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hits_sql(text: str, words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "0"
    return " + ".join(f"(CASE WHEN contains({text}, {_q(w)}) THEN 1 ELSE 0 END)" for w in words)


def sentiment_sql(text: str, lexicon: dict) -> dict:
    t = f"lower({text})"
    p = hits_sql(t, lexicon.get("positive", []))
    n = hits_sql(t, lexicon.get("negative", []))
    u = hits_sql(t, lexicon.get("neutral", []))
    return {"p": f"({p})", "n": f"({n})", "u": f"({u})"}


def label_sql(p: str, n: str, u: str) -> tuple[str, str]:
    tot = f"({p} + {n} + {u})"
    label = (f"CASE WHEN {tot} = 0 THEN 'neutral' WHEN {p} > {n} * 1.5 THEN 'positive' "
             f"WHEN {n} > {p} * 1.5 THEN 'negative' ELSE 'neutral' END")
    score = (f"CASE WHEN {tot} = 0 THEN 0.5 WHEN {p} > {n} * 1.5 THEN least(0.9, 0.5 + ({p} - {n}) / ({tot} * 2.0)) "
             f"WHEN {n} > {p} * 1.5 THEN least(0.9, 0.5 + ({n} - {p}) / ({tot} * 2.0)) ELSE 0.5 END")
    return label, score


def sectors_sql(text: str, sector_keywords) -> str:
    items = []
    for name, kws in sector_keywords:
        cond = " OR ".join(f"contains({text}, {_q(k)})" for k in kws)
        items.append(f"CASE WHEN {cond} THEN {_q(name)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def truncate_sql(t: str, n: int, suffix: str = "...") -> str:
    keep = n - len(suffix)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE substr({t}, 1, {keep}) || {_q(suffix)} END"


def joined(lst: str) -> str:
    return f"array_to_string({lst}, '|')"


from ..functions.lexicons import (SECTOR_KEYWORDS, SENTIMENT_KEYWORDS, SYSTEM_PROMPT,  # noqa: E402
                                  TEST_SECTOR_KEYWORDS, TEST_SENTIMENT_KEYWORDS, USER_PROMPT_PREFIX)

URL_SQL = ("list_sort(list_distinct(regexp_extract_all({t}, "
           "'https?://[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}<>\"{{}}|\\\\^`\\[\\]]+')))")

ORACLE["clean_text"] = f"""
SELECT doc_id, md5({clean('text')}) AS text_md5, CAST(length({clean('text')}) AS BIGINT) AS n
FROM documents WHERE length(text) >= 5"""

ORACLE["clean_pages"] = f"""
SELECT page_id, md5({clean('html')}) AS text_md5, CAST(length({clean('html')}) AS BIGINT) AS n FROM pages"""

ORACLE["content_key"] = f"""
SELECT doc_id, {md5key("concat_ws(':', " + clean('text') + ", nullif(source, ''))")} AS key FROM documents"""

ORACLE["content_hash"] = f"""
SELECT doc_id, {md5key(clean('text') + " || ':' || '' || ':' || coalesce(source, '')")} AS key FROM documents"""

ORACLE["symbols"] = f"""
WITH r AS (SELECT doc_id, {TAIL} AS raw_text FROM documents)
SELECT doc_id, {joined(symbols('raw_text'))} AS symbols, CAST(len({symbols('raw_text')}) AS BIGINT) AS n_symbols FROM r"""

# canonical: 600519SH → SH600519; bare code dropped when a prefixed twin exists
ORACLE["symbols_canonical"] = f"""
WITH r AS (SELECT doc_id, {TAIL} AS raw_text FROM documents),
s AS (SELECT doc_id, list_transform({symbols('raw_text')},
        lambda x: regexp_replace(x, '^(\\d{{5,6}})(SH|SZ|HK)$', '\\2\\1')) AS norm FROM r)
SELECT doc_id, {joined("list_sort(list_distinct(list_filter(norm, lambda x: NOT (regexp_full_match(x, '\\d{5,6}') AND (list_contains(norm, 'SH' || x) OR list_contains(norm, 'SZ' || x) OR list_contains(norm, 'HK' || x))))))")} AS symbols
FROM s"""

ORACLE["urls"] = f"""
WITH p AS (SELECT page_id, 'see ' || url || ' and ' || html AS t FROM pages)
SELECT page_id, {joined(URL_SQL.format(t='t'))} AS urls, CAST(len({URL_SQL.format(t='t')}) AS BIGINT) AS n_urls FROM p"""

_S = sentiment_sql("t", TEST_SENTIMENT_KEYWORDS)
_L, _SC = label_sql("p", "n", "u")
ORACLE["keyword_sentiment"] = f"""
WITH d AS (SELECT doc_id, {clean('text')} AS t FROM documents),
h AS (SELECT doc_id, {_S['p']} AS p, {_S['n']} AS n, {_S['u']} AS u FROM d)
SELECT doc_id, {_L} AS label, round({_SC}, 6) AS score,
       CAST(p AS BIGINT) AS pos_hits, CAST(n AS BIGINT) AS neg_hits, CAST(u AS BIGINT) AS neu_hits FROM h"""
ORACLE["keyword_sentiment_join"] = ORACLE["keyword_sentiment"]

ORACLE["lexicon_hits"] = f"""
WITH w AS (SELECT DISTINCT keyword FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS keyword FROM benchmark
           UNION ALL SELECT lower(p_name) FROM part UNION ALL SELECT lower(n_name) FROM nation) WHERE length(keyword) BETWEEN 2 AND 30),
d AS (SELECT doc_id, lower({clean('text')}) AS t FROM documents)
SELECT keyword, count(DISTINCT doc_id) AS documents FROM w JOIN d ON contains(t, keyword) GROUP BY keyword"""

ORACLE["sectors"] = f"""
WITH d AS (SELECT doc_id, {clean('text')} AS t FROM documents)
SELECT doc_id, {joined(sectors_sql('t', TEST_SECTOR_KEYWORDS))} AS sectors FROM d"""

ORACLE["truncate"] = f"""
WITH d AS (SELECT doc_id, {clean('text')} AS t FROM documents)
SELECT doc_id, {truncate_sql('t', 200)} AS preview, {truncate_sql('t', 100)} AS short FROM d"""

_F = "'%Y-%m-%d %H:%M:%S'"
ORACLE["parse_timestamp"] = f"""
SELECT event_id,
  strftime(ts, {_F}) AS f_iso_frac, strftime(ts, {_F}) AS f_iso, strftime(ts, {_F}) AS f_space,
  strftime(date_trunc('day', ts), {_F}) AS f_date,
  strftime(make_timestamp(CAST(epoch(date_trunc('second', ts)) * 1000000 AS BIGINT)), {_F}) AS f_epoch_s,
  strftime(make_timestamp(CAST(epoch(date_trunc('second', ts)) * 1000000 AS BIGINT)), {_F}) AS f_epoch_ms,
  CAST(NULL AS VARCHAR) AS f_bad
FROM events"""

ORACLE["progress"] = """
SELECT user_id, round(CASE WHEN count(*) <= 0 THEN 0.0
  ELSE least(100.0, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*) * 100.0) END, 6) AS progress
FROM events GROUP BY user_id"""

ORACLE["format_number"] = """
SELECT event_type, format('{:,}', count(*)) AS n_fmt,
       format('{:,}', CAST(sum(round(value * 1000)) AS BIGINT)) AS v_fmt
FROM events GROUP BY event_type"""

ORACLE["sentiment_icon"] = """
WITH l AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Negative' WHEN quality = 1 THEN 'POSITIVE'
                               WHEN doc_id % 2 = 0 THEN 'neutral' ELSE 'meh' END AS label FROM labels)
SELECT doc_id, label, CASE lower(label) WHEN 'positive' THEN '📈' WHEN 'negative' THEN '📉'
  WHEN 'neutral' THEN '➡️' WHEN 'unknown' THEN '❓' ELSE '❓' END AS icon FROM l"""

ORACLE["valid_split"] = f"""
WITH d AS (SELECT doc_id, source, n_chars, {clean('text')} AS t FROM documents),
r AS (SELECT doc_id,
   CASE WHEN doc_id % 50 = 0 THEN '' ELSE md5(t) END AS id,
   CASE WHEN doc_id % 45 = 0 THEN ' ' || chr(9) || ' ' ELSE t END AS text,
   CASE WHEN doc_id % 60 = 0 THEN NULL ELSE source END AS tab,
   CAST(CASE WHEN doc_id % 40 = 0 THEN -1 ELSE n_chars END AS BIGINT) AS like_count FROM d)
SELECT doc_id,
  coalesce(length(id) > 0, false) AND coalesce(length(text) > 0, false)
    AND coalesce(length(trim(regexp_replace(text, '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))) > 0, false)
    AND coalesce(length(tab) > 0, false) AS valid,
  array_to_string(list_filter([
     CASE WHEN id IS NULL THEN 'missing_id' END, CASE WHEN text IS NULL THEN 'missing_text' END,
     CASE WHEN tab IS NULL THEN 'missing_tab' END, CASE WHEN like_count < 0 THEN 'negative_like_count' END],
     lambda x: x IS NOT NULL), '|') AS reasons
FROM r"""

# ------------------------------------------------------------- enrichment
from ..functions.lexicons import DEFAULT_MODEL_NAME  # noqa: E402


def fallback_cols(text: str, symbols_col: str, lexicon: dict, sector_kw) -> str:
    s = sentiment_sql(text, lexicon)
    lab, sc = label_sql(s["p"], s["n"], s["u"])
    return (f"{truncate_sql(text, 100)} || ' (Auto-generated)' AS fb_summary, ({lab}) AS fb_label, "
            f"CASE WHEN ({lab}) = 'positive' THEN ({sc}) ELSE -({sc}) END AS fb_score, "
            f"{sectors_sql(text, sector_kw)} AS fb_sectors, {symbols_col} AS fb_tickers")


ORACLE["fallback_summary"] = f"""
WITH {POSTS_CTE},
f AS (SELECT id, text, {fallback_cols('text', 'symbols', TEST_SENTIMENT_KEYWORDS, TEST_SECTOR_KEYWORDS)} FROM posts)
SELECT id AS post_id, fb_summary AS summary, fb_label AS sentiment, round(fb_score, 6) AS sentiment_score,
       {joined('fb_sectors')} AS sectors, {joined('fb_tickers')} AS tickers,
       {truncate_sql('text', 200)} AS original_text_preview, 'fallback' AS model_used
FROM f"""

_SEQ = "ingest_seq"
RESP_CTE = f"""
resp AS (
  SELECT id, tab, text, symbols, ingest_seq, tab_rank, {_SEQ} % 10 AS k,
    CASE WHEN {_SEQ} % 10 = 3 THEN 'bullish' WHEN {_SEQ} % 10 = 5 THEN 'Positive' WHEN {_SEQ} % 10 = 8 THEN 'unknown'
         WHEN {_SEQ} % 3 = 0 THEN 'positive' WHEN {_SEQ} % 3 = 1 THEN 'negative' ELSE 'neutral' END AS label,
    CASE WHEN {_SEQ} % 10 = 2 THEN '7' WHEN {_SEQ} % 10 = 5 THEN '"0.5"'
         ELSE printf('%.2f', (({_SEQ} % 21) - 10) / 10.0) END AS score_txt,
    CASE WHEN {_SEQ} % 10 = 4 THEN NULL ELSE CAST(length(text) % 1000 + 100 AS BIGINT) END AS total_tokens
  FROM posts),
resp2 AS (
  SELECT *,
    CASE WHEN k = 0 AND {_SEQ} % 20 = 0 THEN '{{"summary": "cut off'
         WHEN k = 0 THEN '[1, 2]'
         WHEN k = 1 THEN '{{"summary": "only a summary"}}'
         WHEN k = 4 THEN NULL
         WHEN k = 9 THEN ''
         ELSE '{{"summary": ' || CASE WHEN k = 6 THEN 'null' ELSE '"Post from ' || tab || '"' END
           || ', "key_points": ["first point", "second point"], "tickers": '
           || CASE WHEN k = 7 THEN '[1]' ELSE '["SH' || lpad(CAST({_SEQ} % 89 AS VARCHAR), 6, '0') || '"]' END
           || ', "companies": ["Co-' || tab || '"]'
           || ', "themes": ["Theme-' || CAST({_SEQ} % 7 AS VARCHAR) || '"]'
           || ', "sectors": ["Finance"], "sentiment": "' || label || '"'
           || ', "sentiment_score": ' || score_txt
           || ', "sentiment_reasoning": "generated"}}' END AS response
  FROM resp),
chk AS (
  SELECT *, CASE WHEN json_valid(response) THEN response END AS vj,
         coalesce(length(response) > 0, false) AS content
  FROM resp2),
chk2 AS (
  SELECT *, content AND vj IS NOT NULL AS decoded,
    coalesce(json_type(vj) = 'OBJECT', false)
    AND coalesce(json_type(vj, '$.summary') = 'VARCHAR', json_type(vj, '$.summary') IS NULL)
    AND coalesce(json_type(vj, '$.sentiment') = 'VARCHAR', json_type(vj, '$.sentiment') IS NULL)
    AND coalesce(json_type(vj, '$.sentiment_reasoning') IN ('VARCHAR', 'NULL'), json_type(vj, '$.sentiment_reasoning') IS NULL)
    {''.join(f"AND (json_type(vj, '$.{a}') IS NULL OR (coalesce(json_type(vj, '$.{a}') = 'ARRAY', false) AND coalesce(list_bool_and(list_transform(json_extract(vj, '$.{a}[*]'), lambda e: json_type(e) = 'VARCHAR')), true))) " for a in ['key_points', 'tickers', 'companies', 'themes', 'sectors'])}
    AND (json_type(vj, '$.sentiment_score') IS NULL OR (json_type(vj, '$.sentiment_score') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR', 'BOOLEAN')
         AND coalesce(TRY_CAST(json_extract_string(vj, '$.sentiment_score') AS DOUBLE) BETWEEN -1 AND 1, false)))
    AS fields_ok
  FROM chk),
parsed AS (
  SELECT *, decoded AND fields_ok AS ok,
    response IS NULL OR (decoded AND NOT fields_ok) AS failed,
    {fallback_cols('text', 'symbols', SENTIMENT_KEYWORDS, SECTOR_KEYWORDS)}
  FROM chk2),
summ_out AS (
  SELECT id AS post_id, tab, ok, failed, content, response, total_tokens,
    CASE WHEN ok THEN {_q(DEFAULT_MODEL_NAME)} ELSE 'fallback' END AS model_used,
    CASE WHEN ok THEN (CASE WHEN lower(coalesce(json_extract_string(vj, '$.sentiment'), 'neutral')) IN ('positive', 'neutral', 'negative', 'unknown')
                            THEN lower(coalesce(json_extract_string(vj, '$.sentiment'), 'neutral')) ELSE 'neutral' END)
         ELSE fb_label END AS sentiment,
    CASE WHEN ok THEN coalesce(TRY_CAST(json_extract_string(vj, '$.sentiment_score') AS DOUBLE), 0.0) ELSE fb_score END AS sentiment_score,
    CASE WHEN ok THEN list_concat(coalesce(json_extract_string(vj, '$.tickers[*]'), []), symbols) ELSE fb_tickers END AS tickers,
    CASE WHEN ok THEN coalesce(json_extract_string(vj, '$.summary'), '') ELSE fb_summary END AS summary,
    CASE WHEN ok THEN list_concat(coalesce(json_extract_string(vj, '$.themes[*]'), []), coalesce(json_extract_string(vj, '$.sectors[*]'), []))
         ELSE fb_sectors END AS topics,
    CASE WHEN ok THEN coalesce(json_extract_string(vj, '$.companies[*]'), []) ELSE [] END AS companies,
    CASE WHEN ok THEN json_extract_string(vj, '$.sentiment_reasoning') ELSE 'Basic keyword-based analysis' END AS sentiment_reasoning
  FROM parsed)
"""

ORACLE["parse_responses"] = f"""
WITH {POSTS_CTE}, {RESP_CTE}
SELECT post_id, model_used, sentiment, round(sentiment_score, 6) AS sentiment_score, {joined('tickers')} AS tickers,
       summary, {joined('topics')} AS topics, {joined('companies')} AS companies, sentiment_reasoning
FROM summ_out"""

ORACLE["enrich_stats"] = f"""
WITH {POSTS_CTE}, {RESP_CTE}
SELECT tab, CAST(count(response) AS BIGINT) AS total_requests,
  CAST(sum(CASE WHEN content THEN 1 ELSE 0 END) AS BIGINT) AS successful_requests,
  CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failed_requests,
  CAST(coalesce(sum(CASE WHEN content THEN total_tokens END), 0) AS BIGINT) AS total_tokens,
  CAST(sum(CASE WHEN model_used = 'fallback' THEN 1 ELSE 0 END) AS BIGINT) AS fallback_summaries,
  count(*) AS summaries
FROM summ_out GROUP BY tab"""

ORACLE["prompt"] = f"""
WITH {POSTS_CTE}
SELECT id AS post_id, md5('Post content:' || chr(10) || chr(10) || text) AS prompt_md5,
       CAST({len(SYSTEM_PROMPT)} + length('Post content:' || chr(10) || chr(10) || text) AS BIGINT) AS prompt_len
FROM posts"""

A1_CTE = """
ps AS (
  SELECT p.id, p.tab, p.tab_rank, p.ingest_seq, p.symbols,
         CASE WHEN s.sentiment IN ('positive', 'negative') THEN s.sentiment ELSE 'neutral' END AS cls
  FROM posts p LEFT JOIN last_summ s ON p.id = s.post_id),
ex AS (SELECT unnest(symbols) AS symbol, cls, tab_rank, ingest_seq, id, tab FROM ps),
agg AS (
  SELECT symbol, count(*) AS mention_count,
         CAST(sum(CASE WHEN cls = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive_mentions,
         CAST(sum(CASE WHEN cls = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral_mentions,
         CAST(sum(CASE WHEN cls = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative_mentions,
         min({'r': tab_rank, 's': ingest_seq}) AS first_pos
  FROM ex GROUP BY symbol)
"""

ORACLE["bars"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {A1_CTE}
SELECT symbol,
  CASE WHEN mention_count > 0 THEN repeat('█', CAST(floor(positive_mentions / mention_count * 20) AS INTEGER)) END AS bull_bar,
  CASE WHEN mention_count > 0 THEN repeat('█', CAST(floor(negative_mentions / mention_count * 20) AS INTEGER)) END AS bear_bar,
  CASE WHEN mention_count > 0 THEN repeat('█', CAST(floor(neutral_mentions / mention_count * 20) AS INTEGER)) END AS neutral_bar,
  round(CASE WHEN positive_mentions + negative_mentions = 0 THEN 0.5
             ELSE positive_mentions / (positive_mentions + negative_mentions) END * 100, 6) AS ratio_pct
FROM agg"""

# ------------------------------------------------ de-dup, caps, selection
ORACLE["first_wins"] = f"""
WITH {POSTS_CTE}
SELECT id, tab, ingest_seq FROM posts"""

ORACLE["last_summary"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}
SELECT post_id, tab, ingest_seq, sentiment FROM last_summ"""

ORACLE["tab_cap"] = f"""
WITH {POSTS_CTE},
c AS (SELECT tab, ingest_seq, row_number() OVER (PARTITION BY tab ORDER BY ingest_seq) AS rn FROM posts)
SELECT tab, ingest_seq AS doc_id, CAST(rn AS BIGINT) AS rn FROM c WHERE rn <= 10"""



def capture_cap(cap: int) -> str:
    """The capture loop itself: one step for each tab, with all ids that the tabs before it took."""
    return f"""
WITH RECURSIVE {POSTS_CTE},
tabs AS (SELECT tab, tab_rank, row_number() OVER (ORDER BY tab_rank, tab) AS t FROM (SELECT DISTINCT tab, tab_rank FROM keyed)),
c AS (SELECT id, t, min(ingest_seq) AS seq FROM keyed JOIN tabs USING (tab, tab_rank) GROUP BY ALL),
run AS (SELECT 0::BIGINT AS t, []::VARCHAR[] AS ids, []::STRUCT(id VARCHAR, t BIGINT, seq BIGINT)[] AS got
        UNION ALL
        SELECT t + 1, list_concat(ids, coalesce(list(id) FILTER (rn <= {cap}), [])), list_concat(got, coalesce(list({{'id': id, 't': t + 1, 'seq': seq}}) FILTER (rn <= {cap}), []))
        FROM (SELECT run.t, run.ids, run.got, c.id, c.seq, CASE WHEN c.id IS NULL THEN {cap} + 1 ELSE row_number() OVER (ORDER BY c.seq) END AS rn
              FROM run LEFT JOIN c ON c.t = run.t + 1 AND NOT list_contains(run.ids, c.id) WHERE run.t < (SELECT max(t) FROM tabs))
        GROUP BY t, ids, got)
SELECT g.id, tab, g.seq AS doc_id FROM (SELECT unnest(got) AS g FROM run WHERE t = (SELECT max(t) FROM tabs)) JOIN tabs ON tabs.t = g.t"""


ORACLE["capture_cap_10"] = capture_cap(10)
ORACLE["capture_cap_100"] = capture_cap(100)

ORACLE["tab_select"] = f"""
WITH {POSTS_CTE}
SELECT tab, count(*) AS n FROM posts WHERE tab IN ('src1', 'src3') GROUP BY tab"""

POSTS_HASH_CTE = f"""{POSTS_CTE},
ph AS (SELECT *, {md5key("text || ':' || '' || ':' || tab")} AS content_hash FROM posts),
stored AS (SELECT DISTINCT content_hash FROM ph WHERE lang = 'en')
"""

ORACLE["dedup_new"] = f"""
WITH {POSTS_HASH_CTE},
firsts AS (SELECT * FROM ph QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ingest_seq) = 1)
SELECT ingest_seq AS doc_id, content_hash FROM firsts
WHERE content_hash NOT IN (SELECT content_hash FROM stored)"""

ORACLE["dup_flag"] = f"""
WITH {POSTS_HASH_CTE}
SELECT ingest_seq AS doc_id, content_hash IN (SELECT content_hash FROM stored) AS is_duplicate FROM ph"""

ORACLE["new_summaries"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE},
st AS (SELECT DISTINCT post_id, tab FROM summ WHERE ingest_seq IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT post_id, ingest_seq AS doc_id FROM summ WHERE (post_id, tab) NOT IN (SELECT (post_id, tab) FROM st)"""

# ------------------------------------------------------------ aggregates
ORACLE["stock_names"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE},
pc AS (SELECT p.id, p.tab_rank, p.ingest_seq, p.symbols, s.companies
       FROM posts p JOIN last_summ s ON p.id = s.post_id WHERE len(s.companies) > 0),
e1 AS (SELECT unnest(symbols) AS symbol, companies, tab_rank, ingest_seq FROM pc),
e2 AS (SELECT symbol, unnest(companies) AS company, unnest(range(len(companies))) AS cpos, tab_rank, ingest_seq FROM e1),
c AS (SELECT symbol, company, count(*) AS n, min({{'r': tab_rank, 's': ingest_seq, 'c': cpos}}) AS first FROM e2 GROUP BY ALL)
SELECT symbol, company AS name FROM c
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, first) = 1"""

ORACLE["stock_samples"] = f"""
WITH {POSTS_CTE},
e AS (SELECT unnest(symbols) AS symbol, id, tab_rank, ingest_seq FROM posts),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY tab_rank, ingest_seq) AS rn FROM e)
SELECT symbol, string_agg(id, '|' ORDER BY rn) AS sample_post_ids FROM r WHERE rn <= 5 GROUP BY symbol"""

THEME_CTE = f"""
summ_t AS (
  SELECT tab_rank, ingest_seq, sentiment, tickers, {truncate_sql('text', 200)} AS preview,
         list_concat([lang], {sectors_sql('text', TEST_SECTOR_KEYWORDS)}) AS topics
  FROM summ),
tr AS (SELECT unnest(topics) AS theme, unnest(range(len(topics))) AS tpos, tab_rank, ingest_seq, tickers, preview,
              CASE WHEN sentiment IN ('positive', 'negative') THEN sentiment ELSE 'neutral' END AS cls
       FROM summ_t)
"""

ORACLE["themes"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {THEME_CTE},
agg AS (SELECT theme, count(*) AS mention_count,
   CAST(sum(CASE WHEN cls = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive,
   CAST(sum(CASE WHEN cls = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral,
   CAST(sum(CASE WHEN cls = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative,
   min({{'r': tab_rank, 's': ingest_seq, 't': tpos}}) AS first_pos
   FROM tr GROUP BY theme)
SELECT CAST(row_number() OVER (ORDER BY mention_count DESC, first_pos, theme) AS BIGINT) AS rank,
  theme, mention_count, positive, neutral, negative,
  CASE WHEN positive > negative * 1.5 THEN 'up' WHEN negative > positive * 1.5 THEN 'down' ELSE 'stable' END AS trend
FROM agg"""

ORACLE["theme_stocks"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {THEME_CTE}
SELECT DISTINCT theme, ticker FROM (SELECT theme, unnest(tickers) AS ticker FROM tr)"""

ORACLE["theme_quotes"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {THEME_CTE},
r AS (SELECT theme, preview, row_number() OVER (PARTITION BY theme ORDER BY tab_rank, ingest_seq, tpos) AS rn FROM tr)
SELECT theme, count(*) AS n_quotes, md5(string_agg(preview, '|' ORDER BY rn)) AS quotes_md5
FROM r WHERE rn <= 3 GROUP BY theme"""

OVERALL = """
SELECT CAST(coalesce(sum(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END), 0) AS BIGINT) AS positive,
       CAST(coalesce(sum(CASE WHEN sentiment NOT IN ('positive', 'negative') OR sentiment IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS neutral,
       CAST(coalesce(sum(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END), 0) AS BIGINT) AS negative
FROM summ"""

ORACLE["overall_sentiment"] = f"WITH {POSTS_CTE}, {SUMM_CTE} {OVERALL}"

ORACLE["market_mood"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, o AS ({OVERALL}), t AS (SELECT *, positive + neutral + negative AS tot FROM o)
SELECT CASE WHEN tot = 0 THEN NULL WHEN positive > negative THEN 'bullish' WHEN negative > positive THEN 'bearish' ELSE 'mixed' END AS mood,
  round(CASE WHEN tot = 0 THEN NULL ELSE positive / tot * 100.0 END, 6) AS pos_pct,
  round(CASE WHEN tot = 0 THEN NULL ELSE negative / tot * 100.0 END, 6) AS neg_pct,
  round(CASE WHEN tot = 0 THEN NULL ELSE neutral / tot * 100.0 END, 6) AS neu_pct
FROM t"""

ORACLE["job_totals"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}
SELECT (SELECT count(*) FROM posts) AS total_posts_collected,
       (SELECT count(DISTINCT {md5key("text || ':' || '' || ':' || tab")}) FROM posts) AS total_unique_posts,
       (SELECT count(*) FROM summ) AS total_posts_summarized"""

ENGAGE_CTE = """
eng AS (SELECT user_id,
   count(*) FILTER (WHERE event_type = 'click') AS like_count,
   count(*) FILTER (WHERE event_type = 'signup') AS comment_count,
   count(*) FILTER (WHERE event_type = 'purchase') AS retweet_count,
   count(*) FILTER (WHERE event_type = 'view') AS view_count,
   min(ts) AS created_at
   FROM events GROUP BY user_id),
pe AS (SELECT p.*, coalesce(e.like_count, 0) AS like_count, coalesce(e.comment_count, 0) AS comment_count,
              coalesce(e.retweet_count, 0) AS retweet_count, coalesce(e.view_count, 0) AS view_count, e.created_at
       FROM posts p LEFT JOIN eng e ON p.ingest_seq % (SELECT coalesce(max(user_id) + 1, 1) FROM events) = e.user_id)
"""

ORACLE["top_discussions"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {ENGAGE_CTE},
sc AS (SELECT *, CAST(like_count + comment_count * 2 + retweet_count * 3 AS BIGINT) AS engagement FROM pe),
top AS (SELECT *, row_number() OVER (ORDER BY engagement DESC, tab_rank, ingest_seq) AS rank FROM sc QUALIFY rank <= 10)
SELECT CAST(t.rank AS BIGINT) AS rank, t.id, t.tab, t.engagement, t.like_count, t.comment_count, t.retweet_count,
       s.sentiment, CASE WHEN s.post_id IS NULL THEN NULL ELSE 'Labelled ' || s.lang || ' post' END AS summary
FROM top t LEFT JOIN last_summ s ON t.id = s.post_id"""

# ------------------------------------------------------ tabs and pages
TABS_CTE = """tabs AS (
  SELECT 'src' || CAST(i AS VARCHAR) AS tab, CAST(i AS INTEGER) AS tab_rank, 'source ' || i AS description FROM range(24) t(i)
  UNION ALL SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER), source FROM documents
  WHERE source NOT IN (SELECT 'src' || CAST(i AS VARCHAR) FROM range(24) t(i)))"""
LOG_CTE = """log AS (SELECT 'src' || CAST(user_id % 20 AS VARCHAR) AS tab, ts AS seen_at, event_type = 'error' AS error FROM events),
lg AS (SELECT tab, date_diff('microsecond', min(seen_at), max(seen_at)) / 1e6 AS secs, count(*) FILTER (WHERE error) AS errors FROM log GROUP BY tab)"""

ORACLE["tab_dimension"] = f"""WITH {TABS_CTE} SELECT tab, tab_rank, description FROM tabs"""

ORACLE["tab_stats"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {ENGAGE_CTE},
{TABS_CTE},
rc AS (SELECT source AS tab, count(*) AS total_posts FROM documents GROUP BY source),
ca AS (SELECT tab, count(*) AS candidates FROM cand WHERE length(text) > 0 GROUP BY tab),
{LOG_CTE},
th AS (SELECT tab, lang AS theme FROM summ UNION ALL SELECT tab, unnest({sectors_sql('text', TEST_SECTOR_KEYWORDS)}) FROM summ),
tc AS (SELECT tab, theme, count(*) AS n FROM th GROUP BY ALL),
tt AS (SELECT tab, string_agg(theme, '|' ORDER BY rk) AS top_themes FROM
        (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY n DESC, theme) AS rk FROM tc) WHERE rk <= 3 GROUP BY tab),
j AS (SELECT pe.*, CASE WHEN s.sentiment IN ('positive', 'negative') THEN s.sentiment ELSE 'neutral' END AS cls
      FROM pe LEFT JOIN last_summ s ON pe.id = s.post_id),
k AS (SELECT tab, count(*) AS valid_posts,
        sum(CASE WHEN cls = 'positive' THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN cls = 'neutral' THEN 1 ELSE 0 END) AS neu,
        sum(CASE WHEN cls = 'negative' THEN 1 ELSE 0 END) AS neg, min(created_at) AS e, max(created_at) AS l
      FROM j GROUP BY tab),
sy AS (SELECT tab, unnest(symbols) AS symbol FROM posts),
sc AS (SELECT tab, symbol, count(*) AS n FROM sy GROUP BY ALL),
tp AS (SELECT tab, string_agg(symbol, '|' ORDER BY rk) AS top_stocks FROM
        (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY n DESC, symbol) AS rk FROM sc) WHERE rk <= 3 GROUP BY tab)
SELECT t.tab, coalesce(rc.total_posts, 0) AS total_posts, coalesce(k.valid_posts, 0) AS valid_posts,
  coalesce(rc.total_posts, 0) - coalesce(k.valid_posts, 0) AS dropped_posts,
  coalesce(ca.candidates, 0) - coalesce(k.valid_posts, 0) AS duplicate_posts,
  CAST(coalesce(k.pos, 0) AS BIGINT) AS positive_posts, CAST(coalesce(k.neu, 0) AS BIGINT) AS neutral_posts,
  CAST(coalesce(k.neg, 0) AS BIGINT) AS negative_posts, coalesce(tp.top_stocks, '') AS top_stocks,
  coalesce(tt.top_themes, '') AS top_themes,
  strftime(k.e, '%Y-%m-%d %H:%M:%S') AS earliest_post, strftime(k.l, '%Y-%m-%d %H:%M:%S') AS latest_post,
  round(coalesce(lg.secs, 0.0), 6) AS crawl_duration_seconds, coalesce(lg.errors, 0) AS errors_count
FROM tabs t LEFT JOIN ca ON t.tab = ca.tab LEFT JOIN tt ON t.tab = tt.tab LEFT JOIN lg ON t.tab = lg.tab LEFT JOIN rc ON t.tab = rc.tab LEFT JOIN k ON t.tab = k.tab LEFT JOIN tp ON t.tab = tp.tab"""

ORACLE["tab_counts"] = f"""
WITH {POSTS_CTE}
SELECT tab, count(*) AS n FROM posts GROUP BY ROLLUP (tab)"""

ORACLE["run_summary"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {TABS_CTE}, {LOG_CTE}
SELECT (SELECT count(*) FROM posts) AS total_posts, (SELECT count(*) FROM summ) AS total_summaries,
       (SELECT count(*) FROM tabs) AS tabs_crawled,
       (SELECT round(date_diff('microsecond', min(seen_at), max(seen_at)) / 1e6, 6) FROM log) AS duration_seconds,
       (SELECT count(*) FROM log WHERE error) AS errors"""

_TAG = r"(?i)</?(?:p|h1|li)(?:\s[^>]*)?>"
ORACLE["page_posts"] = f"""
WITH b0 AS (SELECT page_id, regexp_extract(url, '/([a-z]{{2}})/', 1) AS tab,
                   regexp_split_to_array(coalesce(html, ''), {_q(_TAG)}) AS runs, regexp_extract_all(coalesce(html, ''), {_q(_TAG)}) AS marks FROM pages),
b1 AS (SELECT page_id, tab, unnest(runs) AS run, unnest(range(len(runs))) AS pos, marks FROM b0),
b2 AS (SELECT page_id, tab, pos, run, sum(CASE WHEN pos = 0 THEN 0 WHEN marks[pos] LIKE '</%' THEN -1 ELSE 1 END)
         OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM b1),
b3 AS (SELECT page_id, tab, pos, regexp_replace(run, '<[^>]+>', '', 'g') AS raw_text FROM b2 WHERE depth > 0),
c AS (SELECT page_id, tab, pos, page_id * 2147483648 + pos AS ingest_seq, {clean('raw_text')} AS text
      FROM b3 WHERE length(raw_text) >= 5),
k AS (SELECT *, {md5key('text')} AS id FROM c
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq) = 1)
SELECT page_id, pos, id, tab, text, {joined(URL_SQL.format(t='text'))} AS urls FROM k WHERE length(text) > 0 AND length(tab) > 0"""


def _blocks_sql(chosen: str) -> str:
    """S5 by a recursion over the tags of a page: the list of open elements after each tag. An
    element ends at the tag after the last one that it is open at. ``chosen``: a condition on tag and cls."""
    from ..sources import blocks as B

    def names(x):
        return ", ".join(_q(n) for n in sorted(x))

    def last(st, test):  # place of the last open element, 0 if there is none
        return f"coalesce(list_max(list_transform(range(1, len({st}) + 1), lambda i: CASE WHEN {st}[i].n {test} THEN i ELSE 0 END)), 0)"
    ended = " ".join(f"WHEN tag = {_q(t)} AND {last('s1', f'IN ({names(e)})')} > {last('s1', f'IN ({names(b)})')} THEN list_slice(s1, 1, {last('s1', f'IN ({names(e)})')} - 1)"
                     for t, (e, b) in B.IMPLIED.items())
    return rf"""
h AS (SELECT page_id, url, regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)', '', 'g') AS x FROM pages),
s AS (SELECT page_id, url, regexp_split_to_array(x, '<(?:/?)[a-zA-Z][a-zA-Z0-9:-]*[^<>]*>') AS runs, regexp_extract_all(x, '<(?:/?)[a-zA-Z][a-zA-Z0-9:-]*[^<>]*>') AS marks FROM h),
t0 AS (SELECT page_id, url, unnest(marks) AS m, unnest(runs[2:]) AS run, unnest(range(len(marks)))::BIGINT AS k FROM s),
t AS (SELECT page_id, url, k, run, m LIKE '</%' AS closing, lower(regexp_extract(m, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS tag,
             coalesce(nullif(regexp_extract(m, '(?i)\sclass\s*=\s*"([^"]*)"', 1), ''), nullif(regexp_extract(m, '(?i)\sclass\s*=\s*''([^'']*)''', 1), ''),
                      regexp_extract(m, '(?i)\sclass\s*=\s*([^\s"''>]+)', 1)) AS cls FROM t0),
o AS (SELECT page_id, -1::BIGINT AS k, []::STRUCT(n VARCHAR, k BIGINT)[] AS st FROM pages GROUP BY 1
      UNION ALL
      SELECT page_id, k, CASE
        WHEN NOT closing THEN CASE WHEN tag IN ({names(B.VOID)}) THEN s2 ELSE list_append(s2, {{'n': tag, 'k': k}}) END
        WHEN own = 0 THEN s2
        WHEN tag IN ({names(B.FORMATTING)}) THEN list_concat(list_slice(s2, 1, own - 1), list_slice(s2, own + 1, len(s2)))
        WHEN tag IN ({names(B.BLOCK)}) OR own > {last('s2', f'IN ({names(B.BLOCK)})')} THEN list_slice(s2, 1, own - 1)
        ELSE s2 END
      FROM (SELECT *, {last('s2', '= tag')} AS own FROM (SELECT *, CASE WHEN closing THEN s1 {ended} ELSE s1 END AS s2 FROM (
        SELECT t.page_id, t.k, t.tag, t.closing, CASE WHEN NOT t.closing AND t.tag IN ({names(B.ENDS_P)})
            AND {last('o.st', "= 'p'")} > {last('o.st', f'IN ({names(B.P_SCOPE)})')} THEN list_slice(o.st, 1, {last('o.st', "= 'p'")} - 1) ELSE o.st END AS s1
        FROM o JOIN t ON t.page_id = o.page_id AND t.k = o.k + 1)))),
e AS (SELECT page_id, x.k AS k, max(seen) AS z FROM (SELECT page_id, k AS seen, unnest(st) AS x FROM o) GROUP BY ALL),
c AS (SELECT e.page_id, t.url, e.k, e.z, t.tag FROM e JOIN t ON e.page_id = t.page_id AND e.k = t.k WHERE {chosen}),
blocks AS (SELECT c.page_id, any_value(c.url) AS url, c.k AS pos, any_value(c.tag) AS tag, trim(string_agg(
             CASE WHEN t.k > c.k AND (t.tag = 'br' OR t.tag IN ({names(B.BLOCK)})) THEN chr(10) ELSE '' END || t.run, '' ORDER BY t.k), ' ' || chr(9) || chr(10) || chr(12) || chr(13)) AS raw_text
           FROM c JOIN t ON t.page_id = c.page_id AND t.k BETWEEN c.k AND c.z GROUP BY c.page_id, c.k)"""


_CLASSES = "regexp_split_to_array(trim(cls), '[ ]+')"
ORACLE["selected_blocks"] = f"""
WITH RECURSIVE {_blocks_sql(f"tag IN ('article', 'nav', 'li', 'p', 'b') OR list_contains({_CLASSES}, 'ad') OR tag = 'div' AND contains(cls, 'item__')")}
SELECT page_id, pos, tag, {clean('raw_text')} AS text FROM blocks WHERE length(raw_text) >= 5"""

_POST_ITEMS = f"""tag = 'article' OR list_has_any({_CLASSES}, ['timeline__item', 'status-item'])
  OR tag = 'div' AND (list_has_any({_CLASSES}, ['flow-item', 'feed-item']) OR regexp_matches(cls, 'AnonymousHome|timeline-live|TimelineItem_item_|item__'))"""
ORACLE["selected_posts"] = f"""
WITH RECURSIVE {_blocks_sql(_POST_ITEMS)},
c2 AS (SELECT page_id, pos, regexp_extract(url, '/([a-z]{{2}})/', 1) AS tab, {clean('raw_text')} AS text FROM blocks WHERE length(raw_text) >= 5),
k2 AS (SELECT *, {md5key('text')} AS id FROM c2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id, pos) = 1)
SELECT page_id, pos, id, tab, text, {joined(URL_SQL.format(t='text'))} AS urls FROM k2 WHERE length(text) > 0 AND length(tab) > 0"""

# ------------------------------------------------------------- report
def _static_sql(section, lines, item=0):
    return " UNION ALL ".join(
        f"SELECT {section} AS section_no, CAST({item} AS BIGINT) AS item_no, CAST({i} AS BIGINT) AS line_no, {_q(l)} AS line"
        for i, l in enumerate(lines))


ORACLE["report_stocks"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {A1_CTE},
top AS (SELECT *, row_number() OVER (ORDER BY mention_count DESC, first_pos, symbol) AS rank FROM agg QUALIFY rank <= 20)
{_static_sql(4, ["## Most Discussed Stocks", "", "| Rank | Symbol | Mentions | Sentiment | Bullish | Bearish | Neutral |", "|------|--------|----------|-----------|---------|---------|---------|"])}
UNION ALL
SELECT 4, CAST(rank AS BIGINT), CAST(0 AS BIGINT),
  '| ' || rank || ' | ' || symbol || ' | ' || mention_count || ' | ' ||
  CASE WHEN positive_mentions > negative_mentions * 1.5 THEN '📈' WHEN negative_mentions > positive_mentions * 1.5 THEN '📉' ELSE '➡️' END
  || ' | ' || positive_mentions || ' | ' || negative_mentions || ' | ' || neutral_mentions || ' |'
FROM top
UNION ALL {_static_sql(4, [""], 1000000)}"""

ORACLE["report_sentiment"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, o AS ({OVERALL})
SELECT 5 AS section_no, CAST(0 AS BIGINT) AS item_no, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT 0 AS line_no, '## Sentiment Distribution' AS line UNION ALL SELECT 1, ''
  UNION ALL SELECT 2, '📈 **Positive:** ' || positive || ' posts' FROM o
  UNION ALL SELECT 3, '➡️ **Neutral:** ' || neutral || ' posts' FROM o
  UNION ALL SELECT 4, '📉 **Negative:** ' || negative || ' posts' FROM o
  UNION ALL SELECT 5, '')"""

def _row_sql(section: int, item: str, exprs: list[str], source: str) -> str:
    """Lines of each row of ``source``; NULL lines are left out."""
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT {section} AS section_no, CAST({item} AS BIGINT) AS item_no, CAST({i} AS BIGINT) AS line_no, {e} AS line FROM {source}) "
        f"WHERE line IS NOT NULL" for i, e in enumerate(exprs))


STATS_CTE = f"""{TABS_CTE}, {LOG_CTE}, vp AS (SELECT tab, count(*) AS n FROM posts GROUP BY tab),
stats AS (SELECT t.tab, t.tab_rank, coalesce(vp.n, 0) AS n, coalesce(lg.secs, 0.0) AS secs, coalesce(lg.errors, 0) AS errors
  FROM tabs t LEFT JOIN vp ON t.tab = vp.tab LEFT JOIN lg ON t.tab = lg.tab)"""
_R8 = f"""{_static_sql(8, ["## Data Collection Statistics", "", "| Tab | Posts | Duration (s) | Errors |", "|-----|-------|--------------|--------|"])}
UNION ALL {_row_sql(8, 'tab_rank + 1', ["'| ' || tab || ' | ' || n || ' | ' || printf('%.1f', secs) || ' | ' || errors || ' |'"], 'stats')}
UNION ALL {_static_sql(8, [""], 1000000)}"""
ORACLE["report_tabs"] = f"WITH {POSTS_CTE}, {STATS_CTE} {_R8}"

_ICON = "CASE {x} WHEN 'positive' THEN '📈' WHEN 'negative' THEN '📉' ELSE '➡️' END"
_TREND = "CASE WHEN positive > negative * 1.5 THEN 'up' WHEN negative > positive * 1.5 THEN 'down' ELSE 'stable' END"
from ..functions.lexicons import REPORT_FOOTER, REPORT_SOURCE_LINE, REPORT_TITLE, TREND_ICONS  # noqa: E402


def _slot(template: str, value: str) -> str:
    head, _, rest = template.partition("{")
    return f"{_q(head)} || {value} || {_q(rest.partition('}')[2])}"


_BAR = "repeat('█', CAST(floor({x} / mention_count * 20) AS INTEGER))"
_DISC = "t.like_count, t.comment_count, t.retweet_count"
_REPORT = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {A1_CTE}, {THEME_CTE}, {ENGAGE_CTE}, {STATS_CTE}, o AS ({OVERALL}),
o2 AS (SELECT *, positive + neutral + negative AS tot FROM o),
fin AS (SELECT max(ts) AS e FROM events),
totals AS (SELECT (SELECT count(*) FROM posts) AS a, (SELECT count(DISTINCT {md5key("text || ':' || '' || ':' || tab")}) FROM posts) AS b,
                  (SELECT count(*) FROM summ) AS c, strftime(e, '%Y-%m-%d %H:%M:%S') AS shown, strftime(e, 'run_%Y%m%d_%H%M%S') AS job FROM fin),
tha AS (SELECT theme, count(*) AS n, sum(CASE WHEN cls = 'positive' THEN 1 ELSE 0 END) AS positive,
   sum(CASE WHEN cls = 'neutral' THEN 1 ELSE 0 END) AS neutral, sum(CASE WHEN cls = 'negative' THEN 1 ELSE 0 END) AS negative,
   min({{'r': tab_rank, 's': ingest_seq, 't': tpos}}) AS first_pos FROM tr GROUP BY theme),
thr AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_pos, theme) AS rank, {_TREND} AS trend FROM tha QUALIFY rank <= 15),
q1 AS (SELECT theme, preview FROM tr QUALIFY row_number() OVER (PARTITION BY theme ORDER BY tab_rank, ingest_seq, tpos) = 1),
rel AS (SELECT theme, string_agg(ticker, ', ' ORDER BY ticker) AS stocks FROM (
   SELECT theme, ticker, row_number() OVER (PARTITION BY theme ORDER BY ticker) AS rn FROM (
     SELECT DISTINCT theme, ticker FROM (SELECT theme, unnest(tickers) AS ticker FROM tr))) WHERE rn <= 5 GROUP BY theme),
tq AS (SELECT thr.*, q1.preview, rel.stocks FROM thr LEFT JOIN q1 USING (theme) LEFT JOIN rel USING (theme)),
st AS (SELECT *, row_number() OVER (ORDER BY mention_count DESC, first_pos, symbol) AS rank,
   CASE WHEN positive_mentions > negative_mentions * 1.5 THEN 'positive' WHEN negative_mentions > positive_mentions * 1.5 THEN 'negative' ELSE 'neutral' END AS mood,
   CASE WHEN positive_mentions + negative_mentions = 0 THEN 0.5 ELSE positive_mentions / (positive_mentions + negative_mentions) END AS ratio
   FROM agg QUALIFY rank <= 20),
sc AS (SELECT *, CAST(like_count + comment_count * 2 + retweet_count * 3 AS BIGINT) AS engagement FROM pe),
td AS (SELECT *, row_number() OVER (ORDER BY engagement DESC, tab_rank, ingest_seq) AS rank FROM sc QUALIFY rank <= 10),
disc AS (SELECT t.*, s.sentiment FROM td t LEFT JOIN last_summ s ON t.id = s.post_id),
lines AS (
{_row_sql(1, '0', [_slot(REPORT_TITLE, 'job'), "''", "'**Generated:** ' || shown", "'**Total Posts Collected:** ' || format('{:,}', a)",
                   "'**Unique Posts:** ' || format('{:,}', b)", "'**Posts Summarized:** ' || format('{:,}', c)", "''"], 'totals')}
UNION ALL {_row_sql(2, '0', ["'## Executive Summary'", "''",
    "CASE WHEN tot > 0 THEN 'Overall market sentiment is **' || CASE WHEN positive > negative THEN 'bullish' WHEN negative > positive THEN 'bearish' ELSE 'mixed' END || '** with ' "
    "|| printf('%.1f', positive / tot * 100.0) || '% positive, ' || printf('%.1f', negative / tot * 100.0) || '% negative, and ' || printf('%.1f', neutral / tot * 100.0) || '% neutral discussions.' END",
    "''"], 'o2')}
UNION ALL {_static_sql(3, ["## Key Discussion Points", ""])}
UNION ALL {_row_sql(3, 'rank', ["rank || '. **' || theme || '** (' || n || ' mentions) ' || " + _ICON.format(x="CASE trend WHEN 'up' THEN 'positive' WHEN 'down' THEN 'negative' ELSE 'neutral' END"),
    "'   - *\"' || (" + truncate_sql('preview', 100) + ") || '\"*'"], '(SELECT * FROM tq WHERE rank <= 10)')}
UNION ALL {_static_sql(3, [""], 1000000)}
UNION ALL {_static_sql(4, ["## Most Discussed Stocks", "", "| Rank | Symbol | Mentions | Sentiment | Bullish | Bearish | Neutral |", "|------|--------|----------|-----------|---------|---------|---------|"])}
UNION ALL {_row_sql(4, 'rank', ["'| ' || rank || ' | ' || symbol || ' | ' || mention_count || ' | ' || " + _ICON.format(x='mood') + " || ' | ' || positive_mentions || ' | ' || negative_mentions || ' | ' || neutral_mentions || ' |'"], 'st')}
UNION ALL {_static_sql(4, [""], 1000000)}
UNION ALL {_row_sql(5, '0', ["'## Sentiment Distribution'", "''", "'📈 **Positive:** ' || positive || ' posts'", "'➡️ **Neutral:** ' || neutral || ' posts'", "'📉 **Negative:** ' || negative || ' posts'", "''"], 'o')}
UNION ALL {_static_sql(6, ["## Investment Themes & Sectors", ""])}
UNION ALL {_row_sql(6, 'rank', ["'### ' || theme || ' ' || CASE trend WHEN 'up' THEN " + _q(TREND_ICONS['up']) + " WHEN 'down' THEN " + _q(TREND_ICONS['down']) + " ELSE " + _q(TREND_ICONS['stable']) + " END",
    "'- **Mentions:** ' || n", "'- **Related Stocks:** ' || stocks", "'- **Sentiment:** Positive ' || positive || ', Negative ' || negative || ', Neutral ' || neutral", "''"], 'tq')}
UNION ALL {_static_sql(7, ["## Representative Discussions (Verbatim Quotes)", ""])}
UNION ALL {_row_sql(7, 'rank', ["'### Discussion #' || rank", "'**Tab:** ' || tab || ' | **Author:** None'", "CASE WHEN len(symbols) > 0 THEN '**Stocks Mentioned:** ' || array_to_string(symbols, ', ') END",
    "'**Sentiment:** ' || sentiment", "''", "'> ' || text", "''", "'*👍 ' || like_count || ' | 💬 ' || comment_count || ' | 🔄 ' || retweet_count || '*'", "NULL", "''", "'---'", "''"], 'disc')}
UNION ALL {_R8}
UNION ALL {_static_sql(9, ["## Detailed Stock Analysis", ""])}
UNION ALL {_row_sql(9, 'rank', ["'### ' || symbol", "'**Total Mentions:** ' || mention_count", "'**Sentiment Ratio:** ' || printf('%.1f', ratio * 100.0) || '% bullish'", "''", "'```'",
    "'Bullish:  ' || " + _BAR.format(x='positive_mentions') + " || ' (' || positive_mentions || ')'", "'Bearish:  ' || " + _BAR.format(x='negative_mentions') + " || ' (' || negative_mentions || ')'",
    "'Neutral:  ' || " + _BAR.format(x='neutral_mentions') + " || ' (' || neutral_mentions || ')'", "'```'", "''"], '(SELECT * FROM st WHERE rank <= 10)')}
UNION ALL {_row_sql(10, '0', ["'---'", "''", _q(REPORT_FOOTER), _slot(REPORT_SOURCE_LINE, 'shown')], 'totals')})
"""
ORACLE["report_lines"] = _REPORT + "SELECT section_no, item_no, line_no, line FROM lines"
ORACLE["report_file"] = _REPORT + """SELECT CAST(row_number() OVER (ORDER BY section_no, item_no, line_no) - 1 AS BIGINT) AS line_no, line FROM lines"""

ORACLE["timestamps_shown"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, 'run_%Y%m%d_%H%M%S') AS job FROM events"""

ORACLE["discussions_json"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {ENGAGE_CTE},
sc AS (SELECT *, CAST(like_count + comment_count * 2 + retweet_count * 3 AS BIGINT) AS engagement FROM pe),
top AS (SELECT *, row_number() OVER (ORDER BY engagement DESC, tab_rank, ingest_seq) AS rank FROM sc QUALIFY rank <= 10)
SELECT CAST(t.rank AS BIGINT) AS rank, CAST(CASE WHEN s.post_id IS NULL
    THEN to_json({{'id': t.id, 'tab': t.tab, 'text': t.text, 'symbols': t.symbols, 'engagement': {{'likes': t.like_count, 'comments': t.comment_count, 'retweets': t.retweet_count}}}})
    ELSE to_json({{'id': t.id, 'tab': t.tab, 'text': t.text, 'symbols': t.symbols, 'engagement': {{'likes': t.like_count, 'comments': t.comment_count, 'retweets': t.retweet_count}},
                   'sentiment': s.sentiment, 'summary': 'Labelled ' || s.lang || ' post'}}) END AS VARCHAR) AS record
FROM top t LEFT JOIN last_summ s ON t.id = s.post_id"""

ORACLE["enrich_udf"] = f"""
WITH {POSTS_CTE}, n AS (SELECT id, text, length('Post content:' || chr(10) || chr(10) || text) AS n FROM posts),
f AS (SELECT id, n, {fallback_cols('text', '[]', SENTIMENT_KEYWORDS, SECTOR_KEYWORDS)} FROM n)
SELECT id AS post_id, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN 'fallback' ELSE {_q(DEFAULT_MODEL_NAME)} END AS model_used,
  CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN fb_label WHEN n % 3 = 0 THEN 'positive' WHEN n % 3 = 1 THEN 'negative' ELSE 'neutral' END AS sentiment
FROM f"""

ORACLE["envelope_import"] = f"""
WITH d AS (SELECT doc_id, source AS tab, {TAIL} AS text, doc_id % 11 AS k FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
ok AS (SELECT * FROM d WHERE k NOT IN (1, 2, 3, 4, 5, 9, 10)),
st AS (SELECT tab, text FROM ok GROUP BY ALL),
sy AS (SELECT unnest({symbols('text')}) AS symbol FROM st)
SELECT 'valid' AS kind, tab AS key, count(*) AS n FROM ok GROUP BY tab
UNION ALL SELECT 'stored', tab, count(*) FROM st GROUP BY tab
UNION ALL SELECT 'rejected', CASE k WHEN 3 THEN 'negative_like_count' WHEN 4 THEN 'missing_text' WHEN 9 THEN 'wrong_type_tab'
  WHEN 5 THEN 'wrong_type_symbols' WHEN 10 THEN 'wrong_type_symbols' ELSE 'wrong_type_like_count' END AS r, count(*)
  FROM d WHERE k IN (1, 2, 3, 4, 5, 9, 10) GROUP BY r
UNION ALL SELECT 'symbol', symbol, count(*) FROM sy GROUP BY symbol"""

# ---------------------------------------------------- store and streams
ORACLE["roundtrip_store"] = f"""
WITH {POSTS_CTE}
SELECT tab, count(*) AS rows, count(*) AS new_first, CAST(0 AS BIGINT) AS new_second, CAST(2 AS BIGINT) AS saves,
  count(*) AS total_rows FROM posts GROUP BY tab"""

ORACLE["roundtrip_summaries"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}
SELECT tab, count(*) AS rows, count(*) AS rows_overwritten FROM summ GROUP BY tab"""

ORACLE["roundtrip_json"] = f"""
WITH {POSTS_CTE}
SELECT tab, count(*) AS rows, count(DISTINCT {md5key("text || ':' || '' || ':' || tab")}) AS hashes FROM posts GROUP BY tab"""

ORACLE["stream_dedup"] = f"""
WITH {POSTS_CTE}
SELECT id, CAST(1 AS BIGINT) AS rows FROM posts"""

ORACLE["stream_summaries"] = f"""
WITH {POSTS_CTE}
SELECT id AS post_id, CAST(1 AS BIGINT) AS rows FROM posts"""

ORACLE["stream_two_sources"] = f"""
WITH {POSTS_CTE}
SELECT (SELECT count(DISTINCT id) FROM keyed) AS stored_ids,
  CAST((SELECT count(DISTINCT id) FROM keyed WHERE lang = 'en') + (SELECT count(DISTINCT id) FROM keyed WHERE lang <> 'en') AS BIGINT) AS seen"""


ORACLE["report_json"] = f"""
WITH {POSTS_CTE}, {SUMM_CTE}, {THEME_CTE}, {TABS_CTE}
SELECT (SELECT count(*) FROM posts) AS total_posts_collected,
       (SELECT count(DISTINCT {md5key("text || ':' || '' || ':' || tab")}) FROM posts) AS total_unique_posts,
       (SELECT count(*) FROM summ) AS total_posts_summarized,
       CAST(least(10, (SELECT count(*) FROM posts)) AS BIGINT) AS discussions,
       (SELECT count(*) FROM tabs) AS tabs,
       (SELECT count(DISTINCT s) FROM (SELECT unnest(symbols) AS s FROM posts)) AS stock_records,
       (SELECT count(DISTINCT theme) FROM tr) AS theme_records,
       (SELECT count(DISTINCT (theme, ticker)) FROM (SELECT theme, unnest(tickers) AS ticker FROM tr)) AS related_stocks"""

ORACLE["conversation_posts"] = f"""
WITH c AS (SELECT role AS tab, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS tab_rank,
                  conv_id * 2147483648 + turn AS ingest_seq, {clean('text')} AS text
           FROM conversations WHERE length(text) >= 5),
k AS (SELECT *, {md5key('text')} AS id FROM c
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY tab_rank, ingest_seq) = 1)
SELECT tab, count(*) AS posts, CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(sum(len({URL_SQL.format(t='text')})) AS BIGINT) AS urls
FROM k WHERE length(text) > 0 AND length(tab) > 0 GROUP BY tab"""

# T4 in capture order is the batch result; T7 ends with every id stored once
ORACLE["stream_first_wins"] = ORACLE["first_wins"]
ORACLE["stream_isolated_tabs"] = ORACLE["stream_dedup"]

ORACLE["sketched_totals"] = f"""
WITH {POSTS_HASH_CTE}
SELECT coalesce(tab, '(all)') AS tab, count(DISTINCT content_hash) AS exact, true AS close FROM ph GROUP BY ROLLUP (tab)"""

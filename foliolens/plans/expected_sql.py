"""What each query must return, as SQL over the same tables.

Pages that the queries derive from documents are not rebuilt here: the SQL states
the fields straight from the documents, so it checks rendering and extraction
together.
"""

from __future__ import annotations

from foliolens import fixed_values as V

WS, ZERO_WIDTH = V.WS, V.ZERO_WIDTH
NOW = "TIMESTAMP '2024-03-31'"
SCRAPED_AT = "'2024-03-31T00:00:00.000Z'"


def trim_ws(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def clean(e: str) -> str:
    spaced = f"trim(regexp_replace(coalesce({e}, ''), '{WS}+', ' ', 'g'))"
    return f"trim(regexp_replace({spaced}, '{ZERO_WIDTH}', '', 'g'))"


def words(e: str) -> str:
    return f"len(list_filter(string_split_regex(coalesce({e}, ''), '{WS}+'), lambda w: w <> ''))"


def minutes(e: str) -> str:
    return f"CAST(ceil({words(e)} / 200.0) AS BIGINT)"


def iso(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def decode(e: str) -> str:
    for entity, char in V.HTML_ENTITIES:
        e = f"replace({e}, {quoted(entity)}, {quoted(char)})"
    return e


def escape(e: str) -> str:
    e = f"coalesce({e}, '')"
    for char, entity in V.HTML_ESCAPES:
        e = f"replace({e}, {quoted(char)}, {quoted(entity)})"
    return e


def strip(e: str, separator: str = "") -> str:
    return decode(f"regexp_replace({e}, '<[^>]*>', '{separator}', 'g')")


def percent(part: str, total: str) -> str:
    return (
        f"CAST(CASE WHEN {total} = 0 THEN 0 ELSE sign({part}) * ((20000 * abs({part}) + {total}) "
        f"// (2 * {total})) END AS DOUBLE) / 100"
    )


def listed(e: str, separator: str = "|") -> str:
    return f"array_to_string({e}, '{separator}')"


PUBLISHED = "CASE WHEN doc_id % 97 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) END"
CLAPS = "(doc_id * 7919) % 1000"
RESPONSES = "(doc_id * 104729) % 50"
URL = "'https://example.com/@' || source || '/p/' || doc_id"

ARTICLES = f"""articles AS (
  SELECT doc_id AS article_id, source AS author, {URL} AS url, split_part(text, chr(10), 1) AS title,
         [lang, source] AS tags, {CLAPS} AS claps, {RESPONSES} AS responses,
         coalesce(l.toxic, 0) = 1 AS is_premium, {PUBLISHED} AS published_at, text, lang
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
WORDED = f"""worded AS (SELECT *, {words('text')} AS word_count, {minutes('text')} AS read_time FROM articles)"""
LISTING = f"""listing AS (
  SELECT doc_id AS "index", source AS author, {URL} AS url,
         unnest(CASE WHEN doc_id % 11 = 0 THEN [doc_id % 5, doc_id % 5 + 1] ELSE [doc_id % 5] END) AS batch
  FROM documents)"""
FIRSTS = """firsts AS (
  SELECT * FROM listing QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch, "index") = 1)"""
LINES = f"""lines AS (
  SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {trim_ws('x')}),
         lambda x: x <> '') AS ls
  FROM documents)"""
LINE = """line AS (
  SELECT doc_id, source, lang, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS i FROM lines)"""
PG = r"""pg AS (
  SELECT page_id, url, regexp_replace(html,
    '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g') AS h FROM pages),
art AS (SELECT *, regexp_extract(h, '(?is)<article>.*?</article>', 0) AS a FROM pg)"""
PAGE_PARAGRAPHS = f"""list_transform(string_split_regex(a, '<p>')[2:],
    lambda x: {trim_ws(strip("regexp_extract(x, '(?is)^(.*?)(?:</p>|<p>|</article>|$)', 1)"))})"""
BRIEF = f"article_id, author, url, {iso('published_at')} AS published_at"
LATEST = "ORDER BY published_at DESC NULLS LAST, article_id"
COMMENT_COUNTS = "cc AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)"
BLOCK_TEXT = f"""btext AS (
  SELECT l.doc_id, any_value(l.source) AS source, any_value(l.lang) AS lang, {clean('''coalesce(string_agg(
      CASE i % 6 WHEN 1 THEN line || ' ' || b.source WHEN 4 THEN line || ' ' || b.lang ELSE line END, ' ' ORDER BY i), '')''')} AS t,
    count(*) FILTER (i % 6 = 0) AS n_p
  FROM lines l LEFT JOIN line b USING (doc_id) GROUP BY 1)"""
COUNTER_NAMES = {
    "articles_scraped": "view", "errors": "error", "warnings": "signup", "retries": "click",
    "paywall_hits": "purchase", "proxy_changes": "switch",
}
COUNTERS = ", ".join(f"count(*) FILTER (event_type = '{kind}') AS {name}" for name, kind in COUNTER_NAMES.items())
SUCCESS = percent("(articles_scraped - errors)", "articles_scraped") + " AS success_rate"
SESSIONS = f"""marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked),
sessions AS (
  SELECT user_id, s, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts,
         epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS session_duration, count(*) AS events, {COUNTERS}
  FROM numbered GROUP BY 1, 2)"""
MICROS = "'%Y-%m-%d %H:%M:%S.%f'"
SESSION_ROWS = f"""SELECT user_id, strftime(first_ts, {MICROS}) AS session_start, strftime(end_ts, {MICROS}) AS session_end,
  session_duration, events, {', '.join(COUNTER_NAMES)}, {SUCCESS} FROM sessions"""
RATES = """SELECT user_id, strftime(m, '%Y-%m-%d %H:%M') AS minute, requests, requests > 1 AS over_limit
  FROM (SELECT user_id, date_trunc('minute', ts) AS m, count(*) AS requests FROM events GROUP BY 1, 2)"""
KEYWORDS = f"""found AS (
  SELECT doc_id, list_filter(string_split_regex(
      regexp_replace(lower(coalesce(text, '')), '[^0-9A-Za-z_]', ' ', 'g'), ' +'),
      lambda w: len(w) > 2 AND NOT list_contains([{', '.join(quoted(w) for w in V.STOP_WORDS)}], w)) AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM found),
counted AS (
  SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM word GROUP BY 1, 2),
ranked AS (
  SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS first_rank FROM counted)"""

_NO_STATE = "doc_id % 10 IN (3, 7)"


def _article_fields(kind: str) -> str:
    """Article columns as the embedded state, or the markup, of a derived page gives them."""
    if kind == "state":
        return f"""doc_id AS page_id, {clean("' ' || split_part(text, chr(10), 1)")} AS title, 'In ' || lang AS subtitle,
  'N ' || source AS author, 'https://medium.com/@' || source AS author_url, {iso(PUBLISHED)} AS published_at,
  (doc_id % 30) / CAST(2 AS DOUBLE) AS read_time, {CLAPS} AS claps, {RESPONSES} AS responses,
  lang || '|' || source AS tags, CASE WHEN doc_id % 4 = 0 THEN 'C ' || source ELSE '' END AS publication_name,
  CASE WHEN doc_id % 4 = 0 THEN 'https://medium.com/c' ELSE '' END AS publication_url,
  CASE WHEN doc_id % 5 = 0 THEN 'https://miro.medium.com/pre.png' ELSE '' END AS main_image,
  doc_id % 6 = 0 OR doc_id % 7 = 0 AS is_premium, {URL} AS url,
  CASE WHEN doc_id % 8 = 0 THEN 'Seq' END AS series_name,
  CASE WHEN doc_id % 8 = 0 THEN 'https://medium.com/sequence/sq' END AS series_url,
  CASE WHEN doc_id % 8 = 0 THEN CASE WHEN doc_id % 9 = 0 THEN '' ELSE CAST(doc_id % 9 AS VARCHAR) END END AS series_part"""
    image = "''"
    if kind == "blocks":
        image = """coalesce((SELECT 'https://example.com/i/' || min(i) || '.png' FROM line b
      WHERE b.doc_id = lines.doc_id AND i % 6 = 5 AND contains(line, 'post')), '')"""
    return f"""doc_id AS page_id, {clean('split_part(text, chr(10), 1)')} AS title, 'In ' || lang AS subtitle,
  source AS author, 'https://example.com/@' || source AS author_url,
  {iso(f"date_trunc('day', {PUBLISHED})")} AS published_at, CAST(doc_id % 30 AS DOUBLE) AS read_time,
  {CLAPS} * 10 AS claps, {RESPONSES} AS responses, lang || '|' || source AS tags,
  CASE WHEN doc_id % 4 = 0 THEN 'Pub ' || source ELSE '' END AS publication_name,
  CASE WHEN doc_id % 4 = 0 THEN 'https://example.com/pub' ELSE '' END AS publication_url,
  {image} AS main_image, doc_id % 6 = 0 AS is_premium, {URL} AS url,
  CASE WHEN doc_id % 8 = 0 THEN 'Series ' || source END AS series_name,
  CASE WHEN doc_id % 8 = 0 THEN 'https://example.com/series' END AS series_url,
  CASE WHEN doc_id % 8 = 0 THEN 'Part ' || doc_id % 9 END AS series_part"""


def _per_kind(kind: int, shown: str) -> str:
    """One text per document from the lines that became one kind of block."""
    return f"""WITH {LINES}, {LINE} SELECT l.doc_id AS page_id,
  coalesce(string_agg({shown}, '|' ORDER BY i), '') AS found
  FROM lines l LEFT JOIN line b ON b.doc_id = l.doc_id AND b.i % 6 = {kind} GROUP BY 1"""


def _barriers(compat: bool) -> str:
    cue = {
        "premium": "doc_id % 7 = 2" if compat else "doc_id % 7 IN (1, 2)",
        "member_only": "doc_id % 7 = 2" if compat else "doc_id % 7 IN (1, 2, 6)",
        "subscription_prompt": "doc_id % 7 = 3" if compat else "doc_id % 7 IN (3, 5)",
        "content_truncation": "length(coalesce(text, '')) < 500",
        "login_required": "false" if compat else "doc_id % 7 = 4",
    }
    untyped = "CASE WHEN doc_id % 7 = 1 THEN 'unknown' END, " if compat else ""
    active = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in cue.items())
    kinds = ", ".join(f"CASE WHEN list_contains(active, '{name}') THEN '{name}' END" for name in V.BARRIER_TYPES)
    return f"""cued AS (
  SELECT doc_id AS page_id, list_filter([{untyped}{active}], lambda x: x IS NOT NULL) AS active FROM documents),
typed AS (SELECT *, coalesce({kinds}, CASE WHEN len(active) > 0 THEN 'unknown' END) AS barrier_type FROM cued)"""


BARRIER_ROWS = f"""SELECT page_id, barrier_type IS NOT NULL AS has_barrier, barrier_type,
  {listed('active')} AS indicators, CAST(least(len(active) * 0.25, 1) AS DOUBLE) AS confidence FROM typed"""

PAGE_LINKS = """list_transform(regexp_extract_all(h, '(?is)<a [^>]*>.*?</a>'), lambda x: {shown})"""
PAGE_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"
LINK_URL = f"{PAGE_ORIGIN} || " + decode("""regexp_extract(x, 'href="([^"]*)"', 1)""")
LINK_TEXT = trim_ws(strip("x"))

NAMES = V.EXPORT_COLUMNS


def _export_rows(
    source: str, words_: str, minutes_: str, preview: str, extra: str = "", text: bool = False,
    keywords: str = "''", hashtags: str = "''", mentions: str = "''", comments: str = "0",
) -> str:
    values = (
        "title", "''", "url", "author", "''", f"coalesce({iso('published_at')}, '')", minutes_, "claps", "responses",
        listed("tags", "; "), "''", "''", "''", "CASE WHEN is_premium THEN 'Yes' ELSE 'No' END", "''", "''", words_,
        keywords, hashtags, mentions, preview, comments, "'none'", SCRAPED_AT,
    )
    cast = "CAST({} AS VARCHAR)" if text else "{}"
    shown = ", ".join(f'{cast.format(value)} AS "{name}"' for value, name in zip(values, NAMES))
    return f"SELECT {extra}{shown} FROM {source}"


PREVIEW = "CASE WHEN coalesce(text, '') = '' THEN '' ELSE substring(text, 1, 200) || '...' END"
SUMMARY = f"""totals AS (
  SELECT count(*) AS n, count(*) FILTER (is_premium) AS hits, epoch_us(max(published_at)) // 1000 - epoch_us(min(published_at)) // 1000 AS ms
  FROM articles),
told AS (SELECT *, 'Total Articles: ' || n || ', Success Rate: ' || printf('%.2f', {percent('(n - hits)', 'n')})
  || '%, Paywall Rate: ' || printf('%.2f', {percent('hits', 'n')}) || '%' AS summary FROM totals)"""


def _summary_row() -> str:
    filled = {
        "Article Title": "'STATISTICS'", "Author Name": "'All'", "Word Count": "CAST(n AS VARCHAR)",
        "Content Summary": "summary", "Comments Count": "'0'", "Paywall Type": "'Session Duration: ' || ms || 'ms'",
        "Scraped At": SCRAPED_AT,
    }
    return "SELECT 1 AS row_kind, " + ", ".join(f"""{filled.get(name, "''")} AS "{name}\"""" for name in NAMES) + " FROM told"


def _csv_line() -> str:
    bare = {
        "Reading Time (minutes)", "Claps", "Responses", "Is Premium", "Word Count", "Comments Count", "Paywall Type",
    }
    cells = [
        f'CAST("{name}" AS VARCHAR)' if name in bare else f"""'"' || replace("{name}", '"', '""') || '"'""" for name in NAMES
    ]
    rows = _export_rows("worded", "word_count", "read_time", PREVIEW, "article_id, ")
    return f"WITH {ARTICLES}, {WORDED} SELECT article_id, concat_ws(',', {', '.join(cells)}) AS line FROM ({rows})"


RUN_HOST = "lower(source) || '.example.com'"
RUN_TEXT = clean(listed("ls", " "))


def _run_barrier() -> str:
    """Cues, type and outcome of the pages of a run, one row per document."""
    badge = "doc_id % 6 = 0 OR doc_id % 7 = 2"
    cue = {
        "premium": f"doc_id % 7 = 1 OR {badge}",
        "member_only": f"doc_id % 7 IN (1, 6) OR {badge}",
        "subscription_prompt": "doc_id % 7 IN (3, 5)",
        "login_required": "doc_id % 7 = 4",
        "content_truncation": f"length({listed('ls', '')}) < 500",
    }
    kinds = " ".join(f"WHEN {test} THEN '{name}'" for name, test in cue.items())
    return f"""run AS (SELECT *, {clean('split_part(text, chr(10), 1)')} AS title, {RUN_TEXT} AS t,
  {RUN_HOST} AS host, CASE {kinds} END AS barrier_type FROM lines)"""


def _run_rows() -> str:
    """The 24 columns of the articles of a run."""
    word_list = "list_filter(string_split_regex(regexp_replace(lower(t), '[^0-9A-Za-z_]', ' ', 'g'), ' +'), lambda w: len(w) > 2 AND NOT list_contains([" + ", ".join(
        quoted(word) for word in V.STOP_WORDS) + "], w))"
    by_eight = lambda shown: f"CASE WHEN doc_id % 8 = 0 THEN {shown} ELSE '' END"
    by_four = lambda shown: f"CASE WHEN doc_id % 4 = 0 THEN {shown} ELSE '' END"
    values = (
        "title", "'In ' || lang", "'https://' || source || '.example.com/p/' || doc_id", "source",
        "'https://' || source || '.example.com/@' || source", f"coalesce({iso(DATED)}, '')", "CAST(doc_id % 30 AS DOUBLE)",
        f"{CLAPS} * 10", RESPONSES, "lang || '; ' || source", by_four("'Pub ' || source"),
        by_four("'https://' || source || '.example.com/pub'"), "''", "CASE WHEN doc_id % 6 = 0 OR doc_id % 7 = 2 THEN 'Yes' ELSE 'No' END",
        by_eight("'Series ' || source"), by_eight("'Part ' || doc_id % 9"), words("t"), "coalesce(kw, '')",
        listed(HASHTAGS.format("t"), "; "), listed(MENTIONS.replace("text", "t"), "; "),
        "substring(t, 1, 200) || '...'", "doc_id % 5", "coalesce(barrier_type, 'none')", SCRAPED_AT,
    )
    shown = ", ".join(f'{value} AS "{name}"' for value, name in zip(values, NAMES))
    return f"""w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {word_list} AS ws FROM run)),
  n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS p FROM w GROUP BY 1, 2),
  k AS (SELECT doc_id, string_agg(word, '; ' ORDER BY n DESC, p) AS kw FROM (SELECT * FROM n
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) <= 10) GROUP BY 1),
  rows_of AS (SELECT {shown} FROM run LEFT JOIN k USING (doc_id) WHERE title <> '' AND t <> '')"""


def _run_csv() -> str:
    bare = {
        "Reading Time (minutes)", "Claps", "Responses", "Is Premium", "Word Count", "Comments Count", "Paywall Type",
    }
    cells = [
        f'CAST("{name}" AS VARCHAR)' if name in bare else f"""'"' || replace("{name}", '"', '""') || '"'""" for name in NAMES
    ]
    told = f"""'"Total Articles: ' || n || ', Success Rate: ' || printf('%.2f', {percent('ok', 'n')}) || '%, Paywall Rate: '
      || printf('%.2f', {percent('hits', 'n')}) || '%"'"""
    filled = {
        "Article Title": "'STATISTICS'", "Author Name": "'\"All\"'", "Author URL": "'\"\"'", "Word Count": "n", "Content Summary": told,
        "Comments Count": "(n - ok)", "Paywall Type": "'\"Session Duration: ' || ms || 'ms\"'", "Scraped At": f"'\"' || {SCRAPED_AT} || '\"'",
    }
    closing = " || ',' || ".join(filled.get(name, "''") for name in NAMES)
    return f"""WITH {LINES}, {_run_barrier()}, {_run_rows()},
      totals AS (SELECT count(*) AS n, count(*) FILTER (title <> '' AND t <> '') AS ok, count(barrier_type) AS hits,
        (max(doc_id) - min(doc_id)) * 1000 AS ms FROM run)
      SELECT CAST(0 AS BIGINT) AS part, '{','.join(NAMES)}' AS line UNION ALL
      SELECT 1, concat_ws(',', {', '.join(cells)}) FROM rows_of UNION ALL SELECT 2, {closing} FROM totals"""


def _report() -> str:
    title = "Medium Articles - All"
    head = (
        f'<html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>',
        f"<p><strong>Scraped At:</strong> {SCRAPED_AT[1:-1]}</p>",
    )
    headings = ("Title", "Author", "Date", "Reading Time", "Claps", "Responses", "Tags", "Publication", "Premium", "Word Count", "URL")
    table = "<table><thead><tr>" + "".join(f"<th>{name}</th>" for name in headings) + "</tr></thead><tbody>"
    shown = {
        "Total Articles": "n", "Success Rate": f"printf('%.2f', {percent('(n - hits)', 'n')}) || '%'",
        "Paywall Rate": f"printf('%.2f', {percent('hits', 'n')}) || '%'",
    }
    told = " UNION ALL ".join(f"SELECT 0, '<p><strong>{name}:</strong> ' || {value} || '</p>' FROM totals" for name, value in shown.items())
    return f"""WITH {ARTICLES}, {WORDED}, totals AS (SELECT count(*) AS n, count(*) FILTER (is_premium) AS hits FROM articles)
      SELECT CAST(0 AS BIGINT) AS part, {quoted(head[0])} AS line UNION ALL SELECT 0, {quoted(head[1])} UNION ALL {told}
      UNION ALL SELECT 0, {quoted(table)} UNION ALL SELECT 1, '<tr><td>' || array_to_string([{escape('title')}, {escape('author')},
      {escape(iso('published_at'))}, CAST(read_time AS VARCHAR), CAST(claps AS VARCHAR), CAST(responses AS VARCHAR),
      {escape(listed('tags', ', '))}, '', CASE WHEN is_premium THEN 'Yes' ELSE 'No' END, CAST(word_count AS VARCHAR), {escape('url')}],
      '</td><td>') || '</td></tr>' FROM worded UNION ALL SELECT 2, '</tbody></table></body></html>'"""


DATED = f"date_trunc('day', {PUBLISHED})"


def _dates(whole: str) -> str:
    return f"""SELECT doc_id, {iso(f'''CASE WHEN doc_id % 8 < 4 THEN {DATED} WHEN doc_id % 8 = 4 THEN {whole}
  WHEN doc_id % 8 = 5 THEN {NOW} - to_days(CAST(doc_id % 400 AS INTEGER))
  WHEN doc_id % 8 = 6 THEN {NOW} - to_months(CAST(doc_id % 400 AS INTEGER)) END''')} AS parsed FROM documents"""


HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^(.*?)www\.', '\1')"
SENTENCES = "regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]+')"
SUMMARY_TEXT = f"""CASE WHEN len({SENTENCES}) <= 3 THEN {trim_ws("coalesce(text, '')")}
  ELSE {trim_ws(listed(SENTENCES + '[1:3]', ' '))} END"""
SLUG = (
    "CASE WHEN coalesce(text, '') = '' THEN 'untitled' ELSE lower(substring(regexp_replace(regexp_replace(regexp_replace(text, "
    "'[<>:\"/\\\\|?*]', '', 'g'), '" + WS + "+', '_', 'g'), '^\\.+|\\.+$', '', 'g'), 1, 255)) END"
)
MENTIONS = "list_transform(regexp_extract_all(coalesce(text, ''), '@[0-9A-Za-z_]+'), lambda x: lower(x))"
HASHTAGS = "list_transform(regexp_extract_all(coalesce({0}, ''), '#[0-9A-Za-z_]+'), lambda x: lower(x))"
TRUNCATED = "CASE WHEN length(coalesce(text, '')) <= {0} THEN coalesce(text, '') ELSE substring(text, 1, {1}) || '...' END"


def expected_sql() -> dict[str, str]:
    page_short = f"length({strip('a')}) < 500"
    sql = {
        # sources
        "scan_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
        "scan_results": f"""WITH {ARTICLES} SELECT 'article' AS kind, article_id, author FROM articles WHERE article_id % 7 <> 0
            UNION ALL SELECT 'author', article_id, author FROM (SELECT * FROM articles WHERE article_id % 7 = 0
            ORDER BY '{{"article_id":' || article_id || ',"author":"' || author || '","claps":' || claps || '}}' LIMIT 1)""",
        "scan_requests": """SELECT url AS author_url, page_id % 1200 AS max_posts, CASE WHEN page_id % 3 = 0 THEN true END AS include_content,
            CASE page_id % 5 WHEN 0 THEN ' AI |' WHEN 1 THEN 'Data' END AS tags, (page_id % 70) / CAST(10 AS DOUBLE) AS requests_per_second,
            ['json', 'csv', 'xlsx', 'xml'][page_id % 4 + 1] AS output_format,
            ['2024-01-01', '2024-06-01', 'soon'][page_id % 3 + 1] AS range_start, ['2024-03-01', 'never'][page_id % 2 + 1] AS range_end,
            ['latest', 'popular', 'oldest', 'random'][page_id % 4 + 1] AS sort_by FROM pages""",
        "scan_events": f"SELECT event_id, strftime(ts, {MICROS}) AS ts, user_id, event_type, value, props FROM events",
        "paginate": f"WITH {ARTICLES} SELECT {BRIEF} FROM articles ORDER BY articles.published_at DESC NULLS LAST, article_id LIMIT 20 OFFSET 40",
        # exports
        "sink_append": f"""WITH {ARTICLES} SELECT 'article' AS type, article_id, claps, {SCRAPED_AT} AS scraped_at FROM articles
            UNION ALL SELECT 'comment', conv_id, (conv_id * 31 + turn) % 17, {SCRAPED_AT} FROM conversations""",
        "sink_json": f"WITH {ARTICLES} SELECT article_id, title, {listed('tags')} AS tags, is_premium, {iso('published_at')} AS published_at FROM articles",
        "export_rows": f"""WITH {ARTICLES}, {WORDED}, {KEYWORDS},
            top AS (SELECT doc_id, string_agg(word, '; ' ORDER BY n DESC, first_rank) AS kw FROM (SELECT * FROM ranked
              QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_rank) <= 10) GROUP BY 1), {COMMENT_COUNTS}
            {_export_rows('worded LEFT JOIN top ON top.doc_id = article_id LEFT JOIN cc ON cc.conv_id = article_id', 'word_count', 'read_time',
                          PREVIEW, keywords="coalesce(kw, '')", hashtags=listed(HASHTAGS.format('text'), '; '),
                          mentions=listed(MENTIONS, '; '), comments='coalesce(cc.n, 0)')}""",
        "export_with_summary": f"""WITH {ARTICLES}, {WORDED}, {SUMMARY}
            {_export_rows('worded', 'word_count', 'read_time', PREVIEW, '0 AS row_kind, ', True)} UNION ALL {_summary_row()}""",
        "rows_plus_summary": f"""WITH {ARTICLES}, {SUMMARY}
            SELECT 0 AS row_kind, count(*) AS n, '0' AS last_words, '' AS last_summary FROM articles
            UNION ALL SELECT 1, 1, CAST(n AS VARCHAR), summary FROM told""",
        "sink_csv": _csv_line(),
        "html_report_rows": f"""WITH {ARTICLES}, {WORDED} SELECT article_id, '<tr><td>' || array_to_string([{escape('title')}, {escape('author')},
            {escape(iso('published_at'))}, CAST(read_time AS VARCHAR), CAST(claps AS VARCHAR), CAST(responses AS VARCHAR),
            {escape(listed('tags', ', '))}, '', CASE WHEN is_premium THEN 'Yes' ELSE 'No' END, CAST(word_count AS VARCHAR), {escape('url')}],
            '</td><td>') || '</td></tr>' AS row FROM worded""",
        "public_shape": f"""WITH {ARTICLES}, {WORDED} SELECT title, author, '' AS publication, url, {clean('text')} AS content, word_count,
            read_time || ' min' AS read_time, is_premium, {listed('tags')} AS tags, {SCRAPED_AT} AS scraped_at FROM worded""",
        "public_comments": """SELECT conv_id AS article_id, turn // 1000 AS comments_part,
            string_agg(concat_ws('~', role, text, CAST((conv_id * 31 + turn) % 17 AS VARCHAR)), '|' ORDER BY turn) AS comments
            FROM conversations GROUP BY 1, 2""",
        "public_stats": """SELECT (SELECT count(*) FROM documents) AS total_articles_scraped,
            (SELECT count(*) FROM conversations) AS total_comments_scraped, '0 seconds' AS time_taken""",
        "export_slug": f"""SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'unknown-author' ELSE source || '_ab_' || lang END || '-' ||
            regexp_replace(coalesce({iso(PUBLISHED)}, {SCRAPED_AT}), '[:.]', '-', 'g') AS stem,
            CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'xlsx' ELSE 'json' END AS format FROM documents""",
        "sink_by_author": f"WITH {ARTICLES} SELECT article_id, author, claps, lower(author) AS author_slug FROM articles",
        "metric_value": f"""WITH c AS (SELECT user_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS session_duration, {COUNTERS} FROM events GROUP BY 1),
            s AS (SELECT *, {SUCCESS} FROM c) """ + " UNION ALL ".join(
                f"SELECT user_id, '{title}' AS metric, CAST({name} AS DOUBLE) AS value FROM s"
                for title, name in zip(
                    V.METRIC_NAMES, ("session_duration", *COUNTER_NAMES, "success_rate"), strict=True
                )
            ),
        # extraction
        "embedded_state": "SELECT doc_id AS page_id, doc_id % 10 <> 7 AS has_state, doc_id % 10 NOT IN (3, 7) AS is_valid FROM documents",
        "state_ref_lookup": f"SELECT doc_id AS page_id, 'Post:' || doc_id AS post_key FROM documents WHERE NOT {_NO_STATE}",
        "state_article": f"SELECT {_article_fields('state')} FROM documents WHERE NOT {_NO_STATE}",
        "markup_article": f"WITH {LINES}, {LINE} SELECT {_article_fields('blocks')} FROM lines",
        "article_info": f"""SELECT {_article_fields('state')} FROM documents WHERE NOT {_NO_STATE}
            UNION ALL SELECT {_article_fields('head')} FROM documents WHERE {_NO_STATE}""",
        "state_blocks": f"""WITH {LINES}, {LINE} SELECT doc_id AS page_id, i AS position,
            ['paragraph', 'heading', 'quote', 'code', 'list', 'image'][i % 6 + 1] AS type,
            CASE WHEN i % 6 = 1 THEN CAST(3 AS BIGINT) END AS level, CASE WHEN i % 6 < 3 THEN line ELSE '' END AS text,
            CASE WHEN i % 6 = 3 THEN CASE WHEN i % 12 = 3 THEN lang ELSE 'unknown' END END AS language,
            CASE WHEN i % 6 = 3 THEN line END AS code, CASE WHEN i % 6 = 5 THEN 'https://miro.medium.com/im.png' END AS src,
            CASE WHEN i % 6 = 5 THEN lang END AS alt, CASE WHEN i % 6 = 4 THEN 'ul' END AS list_type,
            CASE WHEN i % 6 = 4 THEN line END AS items FROM line WHERE NOT {_NO_STATE}""",
        "state_content": f"""WITH {LINES}, {LINE} SELECT page_id, text_content, headings, paragraphs, quotes, code_blocks, images, n_lists,
            {words('text_content')} AS word_count FROM (SELECT l.doc_id AS page_id,
            {clean("string_agg(line, ' ' ORDER BY i) FILTER (i % 6 < 3)")} AS text_content,
            coalesce(string_agg('3~' || line, '|' ORDER BY i) FILTER (i % 6 = 1), '') AS headings,
            coalesce(string_agg(line, '|' ORDER BY i) FILTER (i % 6 = 0), '') AS paragraphs,
            coalesce(string_agg(line || '~', '|' ORDER BY i) FILTER (i % 6 = 2), '') AS quotes,
            coalesce(string_agg(CASE WHEN i % 12 = 3 THEN b.lang ELSE 'unknown' END || '~' || line, '|' ORDER BY i) FILTER (i % 6 = 3), '') AS code_blocks,
            coalesce(string_agg('https://miro.medium.com/im.png~' || b.lang, '|' ORDER BY i) FILTER (i % 6 = 5), '') AS images,
            count(*) FILTER (i % 6 = 4) AS n_lists
            FROM lines l LEFT JOIN line b USING (doc_id) WHERE NOT {_NO_STATE} GROUP BY 1)""",
        "headings": _per_kind(3, "'3~' || line"),
        "page_headings": f"WITH {PG} SELECT page_id, '1~' || {trim_ws(strip('''regexp_extract(a, '(?is)<h1>.*?</h1>', 0)'''))} AS found FROM art",
        "paragraphs": f"""WITH {PG}, p AS (SELECT page_id, list_filter({PAGE_PARAGRAPHS}, lambda x: x <> '') AS ps FROM art)
            SELECT page_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS position, unnest(ps) AS paragraph FROM p""",
        "lists": _per_kind(4, "'ul:' || line || '~' || b.lang"),
        "page_lists": f"""WITH {PG} SELECT page_id, 'ul:' || {listed(f'''list_transform(regexp_extract_all(h, '(?is)<li>.*?</li>'), lambda x: {LINK_TEXT})''', '~')}
            AS found FROM pg""",
        "quotes": _per_kind(1, "line || b.source || '~' || b.source"),
        "code_blocks": _per_kind(2, "b.lang || '~' || line"),
        "images": _per_kind(5, "'/i/' || i || '.png~' || line || '~' || b.source"),
        "links": _per_kind(5, "line || '~https://example.com/l/' || i || '~' || b.lang"),
        "page_links": f"WITH {PG} SELECT page_id, {listed(PAGE_LINKS.format(shown=f'''{LINK_TEXT} || '~' || {LINK_URL} || '~' '''))} AS found FROM pg",
        "markup_content": f"""WITH {PG} SELECT page_id, CAST(0 AS BIGINT) AS container, CAST(1 AS BIGINT) AS n_containers,
            '1~' || {trim_ws(strip('''regexp_extract(a, '(?is)<h1>.*?</h1>', 0)'''))} AS headings,
            len(list_filter({PAGE_PARAGRAPHS}, lambda x: x <> '')) AS n_paragraphs, len(regexp_extract_all(a, '<a [^>]*href')) AS n_links,
            {words(strip('a', ' '))} AS word_count FROM art""",
        "flatten_content": f"""WITH {PG} SELECT page_id, {clean(strip('a', ' '))} AS text_content,
            {listed(f"list_filter({PAGE_PARAGRAPHS}, lambda x: x <> '')")} AS paragraphs, {words(clean(strip('a', ' ')))} AS word_count FROM art""",
        "concat_fragments": f"""WITH {LINES} SELECT doc_id AS page_id, len(ls) AS n_paragraphs, {clean(listed('ls', ' '))} AS text_content,
            {words(clean(listed('ls', ' ')))} AS word_count FROM lines""",
        "comments": f"""WITH l AS (SELECT conv_id * 1000 + turn AS page_id, role, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
              lambda x: {trim_ws('x')}), lambda x: x <> '') AS ls FROM conversations),
            c AS (SELECT page_id, role, unnest(ls) AS content, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS i FROM l)
            SELECT page_id, role AS author, 'https://example.com/@' || role AS author_url, content, (i + 1) || ' days ago' AS date,
            (page_id + i) * 13 AS claps, i AS "index" FROM c WHERE page_id % 9 <> 0""",
        "publication": """SELECT doc_id AS page_id, CASE WHEN doc_id % 4 = 0 THEN 'Pub ' || source END AS name,
            CASE WHEN doc_id % 4 = 0 THEN 'https://example.com/pub' END AS url,
            CASE WHEN doc_id % 4 = 0 THEN 'https://example.com/logo.png' END AS logo, CASE WHEN doc_id % 4 = 0 THEN '' END AS description,
            CASE WHEN doc_id % 4 = 0 THEN doc_id * 37 END AS followers FROM documents""",
        "author_profile": f"""SELECT doc_id AS page_id, source || ' X' AS name, {clean('split_part(text, chr(10), 1)')} AS bio, doc_id * 37 AS followers,
            doc_id % 500 AS following, 'https://example.com/me.png' AS avatar, '@' || source AS username, 'https://example.com/@' || source AS url
            FROM documents""",
        "author_links": """SELECT doc_id AS page_id,
            CASE WHEN doc_id % 2 = 0 THEN 'Site~https://s.example.org/' ELSE 'Blog~https://example.com/u' END AS social_links,
            CASE WHEN doc_id % 3 = 0 THEN 'One editor~https://example.com/p1~editor' ELSE 'Two~https://example.com/publications/2~writer' END
            AS publications FROM documents""",
        "listing": f"""WITH {LINES}, {LINE} SELECT doc_id AS page_id, i AS "index", line AS title, lang AS subtitle,
            'https://example.com/@' || source || '/' || i AS url, 'Jan ' || (i % 28 + 1) AS date, (i + 1) || ' min' AS read_time FROM line""",
        "page_census": f"""WITH {PG} SELECT page_id, {trim_ws(strip('''regexp_extract(h, '(?is)<title>.*?</title>', 0)'''))} AS title, url,
            len(regexp_extract_all(h, '<article>')) AS article_count, len(regexp_extract_all(h, '<a [^>]*href="[^"]*/@')) AS author_link_count,
            len(regexp_extract_all(h, 'data-testid="[^"]*(post|article)')) AS post_count, len(regexp_extract_all(h, '<h2')) AS h2_count,
            len(regexp_extract_all(h, '<h3')) AS h3_count, len(regexp_extract_all(h, 'data-testid')) AS testid_count,
            len(regexp_extract_all(h, '<a ')) AS link_count,
            {listed(PAGE_LINKS.format(shown=f'{LINK_URL} || chr(126) || substring({LINK_TEXT}, 1, 50)') + '[1:10]')} AS first_links FROM pg""",
        "body_text_cascade": f"""WITH {PG}, j AS (SELECT page_id, {listed(f'list_filter({PAGE_PARAGRAPHS}, lambda x: length(x) > 10)', 'SEP')} AS t FROM art)
            SELECT page_id, CASE WHEN length(t) > 50 THEN t END AS body_text FROM j""".replace("'SEP'", "chr(10) || chr(10)"),
        "assemble_article": f"""WITH {LINES}, {LINE}, {BLOCK_TEXT}, stated AS (
              SELECT l.doc_id, {clean("string_agg(line, ' ' ORDER BY i) FILTER (i % 6 < 3)")} AS t, count(*) FILTER (i % 6 = 0) AS n_p
              FROM lines l LEFT JOIN line b USING (doc_id) GROUP BY 1),
            pages_of AS (
              SELECT doc_id * 2 AS page_id, doc_id, {CLAPS} * 10 AS claps, {words('t')} AS word_count, n_p FROM btext
              UNION ALL SELECT doc_id * 2 + 1, doc_id, {CLAPS}, {words('t')}, n_p FROM stated WHERE NOT {_NO_STATE}
              UNION ALL SELECT doc_id * 2 + 1, doc_id, {CLAPS} * 10, {words("split_part(text, chr(10), 1)")} + 14
                + CASE WHEN doc_id % 97 <> 0 THEN 1 ELSE -1 END + CASE WHEN doc_id % 4 = 0 THEN 4 ELSE 0 END
                + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 8 = 0 THEN 4 ELSE 0 END, 0
              FROM documents WHERE {_NO_STATE})
            SELECT page_id, {clean("split_part(text, chr(10), 1)")} AS title, claps, word_count, n_p AS n_paragraphs, CAST(0 AS BIGINT) AS n_comments,
            CASE WHEN doc_id % 4 = 0 THEN 'Pub ' || source END AS publication FROM pages_of JOIN documents USING (doc_id)""",
        # scalar functions
        "clean_text": f"SELECT doc_id, {clean('text')} AS cleaned FROM documents",
        "word_count": f"SELECT doc_id, {words('text')} AS words FROM documents",
        "reading_minutes": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN doc_id WHEN 1 THEN doc_id * 60 WHEN 2 THEN 60 WHEN 3 THEN doc_id
            ELSE 0 END AS minutes FROM documents""",
        "estimate_minutes": f"SELECT doc_id, {minutes('text')} AS minutes FROM documents",
        "parse_article_date": _dates(DATED),
        "iso_date": _dates(PUBLISHED),
        "file_slug": f"SELECT doc_id, {SLUG} AS slug FROM documents",
        "truncate": f"SELECT doc_id, {TRUNCATED.format(80, 77)} AS short, {TRUNCATED.format(2, 0)} AS tiny FROM documents",
        "hashtags": f"""SELECT doc_id, {listed(HASHTAGS.format("replace(text, ' ', ' #')"))} AS hashtags FROM documents""",
        "mentions": f"SELECT doc_id, {listed(MENTIONS)} AS mentions, len({MENTIONS}) AS n FROM documents",
        "domain": f"SELECT page_id, {HOST} AS domain, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS www_domain, '' AS no_domain FROM pages",
        "is_valid_url": "SELECT page_id, regexp_matches(url, '^[a-z]+://[^/ ]+') AS is_valid, false AS without_scheme FROM pages",
        "plain_text": f"""WITH {LINES}, {LINE}, {BLOCK_TEXT} SELECT b.doc_id AS page_id, {trim_ws("concat_ws(chr(10), 'T', '', nullif(t, ''), ps, qs, us)")} AS plain_text
            FROM btext b LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (i % 6 = 0) AS ps,
              string_agg('"' || line || source || '"' || chr(10) || '— ' || source || chr(10), chr(10) ORDER BY i) FILTER (i % 6 = 1) AS qs,
              string_agg('• ' || line || chr(10) || '• ' || lang || chr(10), chr(10) ORDER BY i) FILTER (i % 6 = 4) AS us
              FROM line GROUP BY 1) p USING (doc_id)""",
        "summary": f"SELECT doc_id, {SUMMARY_TEXT} AS summary FROM documents",
        "digits_count": "SELECT doc_id, doc_id * 977 AS plain, (doc_id % 10) * 10 + 5 AS short, CAST(0 AS BIGINT) AS none FROM documents",
        "suffix_count": """SELECT doc_id, (doc_id % 1000) * 1000 + (doc_id % 10) * 100 AS thousands,
            (doc_id % 1000) * 1000000 + (doc_id % 10) * 100000 AS millions, doc_id * 977 AS plain FROM documents""",
        "contains_ci_either": """SELECT doc_id, contains(lower(text), lower(lang)) OR contains(lower(lang), lower(text)) AS text_lang,
            contains(lower(lang), lower(source || '-FR')) OR contains(lower(source || '-FR'), lower(lang)) AS lang_source FROM documents""",
        "html_escape": f"SELECT doc_id, {escape('text')} AS escaped FROM documents",
        "csv_escape": """SELECT doc_id, replace(replace(coalesce(text, ''), ' ', '"'), '"', '""') AS escaped FROM documents""",
        "engagement": f"SELECT doc_id, {CLAPS} + {RESPONSES} AS engagement FROM documents",
        # filters, routing, requests
        "page_type": """SELECT doc_id, ['author', 'article', 'author', 'unknown', 'article', 'article', 'article'][doc_id % 7 + 1] AS page_type,
            ['author', 'article', 'article', 'unknown', 'article', 'article', 'article'][doc_id % 7 + 1] AS strict_type FROM documents""",
        "filter_tags": f"""WITH {ARTICLES} SELECT {BRIEF} FROM articles WHERE len(list_filter(tags, lambda t: contains('fra', lower(t))
            OR contains(lower(t), 'fra') OR contains('src1', lower(t)) OR contains(lower(t), 'src1'))) > 0""",
        "filter_dates": f"""WITH {ARTICLES} SELECT {BRIEF} FROM articles WHERE articles.published_at IS NULL
            OR articles.published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-02-20'""",
        "filter_premium": f"WITH {ARTICLES} SELECT {BRIEF} FROM articles WHERE NOT is_premium",
        "filter_read_time": f"WITH {ARTICLES}, {WORDED} SELECT {BRIEF}, read_time FROM worded WHERE read_time BETWEEN 2 AND 6",
        "require_title_url": f"WITH {ARTICLES} SELECT article_id, title, url FROM articles WHERE article_id % 5 > 0 AND article_id % 7 > 0 AND title <> ''",
        "barrier_classify": f"WITH {_barriers(False)} {BARRIER_ROWS}",
        "barrier_classify_compat": f"WITH {_barriers(True)} {BARRIER_ROWS}",
        "barrier_skip": f"WITH {PG} SELECT page_id, url FROM art WHERE NOT ({page_short})",
        "validate_requests": f"""SELECT page_id, errors, errors = '' AS is_valid FROM (SELECT page_id, concat_ws('|',
            CASE WHEN NOT contains({HOST}, 'example.com') THEN {quoted(V.REQUEST_MESSAGES['url_host'].replace(V.SITE, 'example.com'))} END,
            CASE WHEN page_id % 1200 NOT BETWEEN 1 AND 1000 THEN {quoted(V.REQUEST_MESSAGES['max_posts'])} END,
            CASE WHEN page_id % 70 NOT BETWEEN 1 AND 50 THEN {quoted(V.REQUEST_MESSAGES['rate'])} END,
            CASE WHEN page_id % 4 = 3 THEN {quoted(V.REQUEST_MESSAGES['format'])} END,
            CASE WHEN page_id % 4 = 3 THEN {quoted(V.REQUEST_MESSAGES['sort'])} END,
            CASE WHEN page_id % 3 = 2 THEN {quoted(V.REQUEST_MESSAGES['start'])} END,
            CASE WHEN page_id % 2 = 1 THEN {quoted(V.REQUEST_MESSAGES['end'])} END,
            CASE WHEN page_id % 3 = 1 AND page_id % 2 = 0 THEN {quoted(V.REQUEST_MESSAGES['order'])} END,
            CASE WHEN page_id % 5 = 0 THEN {quoted(V.REQUEST_MESSAGES['tags'])} END) AS errors FROM pages)""",
        "validate_json_requests": f"""SELECT page_id, errors, errors = '' AS is_valid FROM (SELECT page_id, CASE page_id % 12
            WHEN 10 THEN 'Input is required' WHEN 11 THEN 'Author URL is required and must be a string' ELSE concat_ws('|',
            CASE WHEN NOT contains({HOST}, 'example.com') THEN {quoted(V.REQUEST_MESSAGES['url_host'].replace(V.SITE, 'example.com'))} END,
            CASE page_id % 12 WHEN 1 THEN 'maxPosts must be a number between 1 and 1000'
              WHEN 2 THEN 'requestsPerSecond must be a number between 0.1 and 5' WHEN 3 THEN 'outputFormat must be one of: json, csv, xlsx'
              WHEN 4 THEN 'sortBy must be one of: latest, popular, oldest' WHEN 5 THEN 'dateRange must be an object'
              WHEN 6 THEN 'dateRange.start must be a valid date string' WHEN 7 THEN 'tags must be an array'
              WHEN 8 THEN 'All tags must be non-empty strings'
              WHEN 9 THEN 'includeContent must be a boolean value|useProxy must be a boolean value' END) END AS errors FROM pages)""",
        "normalise_requests": """SELECT page_id, url AS author_url, page_id % 1200 AS max_posts, true AS include_content, false AS include_comments,
            true AS include_publication, CASE page_id % 5 WHEN 0 THEN 'ai' WHEN 1 THEN 'data' ELSE '' END AS tags,
            (page_id % 70) / CAST(10 AS DOUBLE) AS requests_per_second, true AS use_proxy,
            ['json', 'csv', 'xlsx', 'xml'][page_id % 4 + 1] AS output_format, false AS premium_content,
            ['latest', 'popular', 'oldest', 'random'][page_id % 4 + 1] AS sort_by FROM pages""",
        # relationships
        "state_deref": f"""WITH {LINES}, {LINE}, ok AS (SELECT * FROM line WHERE NOT {_NO_STATE})
            SELECT doc_id AS page_id, 'ROOT_QUERY' AS from_key, CAST(1 AS BIGINT) AS position, 'Post:' || doc_id AS key, CAST(NULL AS VARCHAR) AS record_type
            FROM documents WHERE NOT {_NO_STATE}
            UNION ALL SELECT doc_id, 'Post:' || doc_id, i, 'Paragraph:' || i, ['P', 'H3', 'BQ', 'PRE', 'UL', 'IMG'][i % 6 + 1] FROM ok
            UNION ALL SELECT doc_id, 'Paragraph:' || i, 0, 'Image:1', NULL FROM ok WHERE i % 6 = 5""",
        "listing_to_article": f"""WITH {ARTICLES}, {LISTING}, {FIRSTS} SELECT f.url, batch, "index", a.article_id, claps, is_premium
            FROM firsts f LEFT JOIN (SELECT * FROM articles WHERE article_id IN (SELECT doc_id FROM labels)) a ON a.url = f.url""",
        "not_reached": f"""WITH {LISTING}, {FIRSTS} SELECT url, "index" FROM firsts WHERE "index" NOT IN (SELECT doc_id FROM labels)""",
        "tags_backfill": f"""WITH {ARTICLES} SELECT url, {listed('tags')} AS tags, claps, responses, is_premium FROM articles
            WHERE article_id IN (SELECT doc_id FROM labels) AND len(list_filter(tags, lambda t: contains('de', lower(t)) OR contains(lower(t), 'de'))) > 0""",
        "article_comments": f"WITH {COMMENT_COUNTS} SELECT doc_id AS article_id, coalesce(cc.n, 0) AS comments_count FROM documents LEFT JOIN cc ON conv_id = doc_id",
        "commented_articles": f"SELECT doc_id AS article_id, {URL} AS url FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)",
        "author_articles": f"""WITH {ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY author {LATEST}) AS k FROM articles)
            SELECT author, CAST((k - 1) // 20 AS BIGINT) AS part, any_value(total) AS total_articles,
              string_agg(article_id || '~' || claps, '|' ORDER BY k) AS articles
            FROM (SELECT *, count(*) OVER (PARTITION BY author) AS total FROM r) GROUP BY 1, 2""",
        # statistics
        "run_stats": f"""WITH {PG}, c AS (SELECT {HOST} AS host, page_id, {page_short} AS hit,
              {trim_ws(strip("regexp_extract(a, '(?is)<h1>.*?</h1>', 0)"))} = '' OR {trim_ws(strip('a'))} = '' AS failed FROM art),
            t AS (SELECT host, count(*) AS total_articles, count(*) FILTER (NOT hit AND NOT failed) AS successful_extractions,
              count(*) FILTER (hit) AS paywall_hits, count(*) FILTER (NOT hit AND failed) AS errors, (max(page_id) - min(page_id)) * 1000 AS session_duration FROM c GROUP BY 1)
            SELECT *, {percent('paywall_hits', 'total_articles')} AS paywall_rate, {percent('successful_extractions', 'total_articles')} AS success_rate FROM t""",
        "page_run": f"WITH {LINES}, {_run_barrier()}, {_run_rows()} SELECT * FROM rows_of",
        "page_run_csv": _run_csv(),
        "page_run_hosts": f"""WITH {LINES}, {_run_barrier()}, t AS (SELECT host, count(*) AS total_articles,
            count(*) FILTER (barrier_type IS NULL AND title <> '' AND t <> '') AS successful_extractions, count(barrier_type) AS paywall_hits,
            count(*) FILTER (barrier_type IS NULL AND (title = '' OR t = '')) AS errors, (max(doc_id) - min(doc_id)) * 1000 AS session_duration
            FROM run GROUP BY 1)
            SELECT *, {percent('paywall_hits', 'total_articles')} AS paywall_rate, {percent('successful_extractions', 'total_articles')} AS success_rate FROM t""",
        "public_run": f"""WITH {LINES}, {_run_barrier()}, kept AS (SELECT * FROM run WHERE title <> '' AND t <> ''),
            totals AS (SELECT (SELECT count(*) FROM kept) AS n, (SELECT CAST(sum(doc_id % 5) AS BIGINT) FROM kept) AS c,
              printf('%.1f', CAST(max(doc_id) - min(doc_id) AS DOUBLE)) || ' seconds' AS took FROM run)
            SELECT doc_id AS page_id, title, source AS author, CASE WHEN doc_id % 4 = 0 THEN 'Pub ' || source ELSE '' END AS publication,
            'https://' || source || '.example.com/p/' || doc_id AS url, t AS content, {words('t')} AS word_count,
            doc_id % 30 || ' min' AS read_time, doc_id % 6 = 0 OR doc_id % 7 = 2 AS is_premium, lang || '|' || source AS tags,
            array_to_string(list_transform(range(doc_id % 5), lambda x: '~' || lang || '~0'), '|') AS comments,
            {iso("TIMESTAMP '2024-01-01' + to_seconds(doc_id)")} AS scraped_at, n AS total_articles_scraped,
            c AS total_comments_scraped, took AS time_taken FROM kept, totals""",
        "export_stats_told": f"""WITH {ARTICLES}, {WORDED}, {COMMENT_COUNTS} SELECT is_premium, count(*) AS total_articles,
            bool_or(author <> '') AS has_author_data, true AS has_content_data, bool_or(coalesce(cc.n, 0) > 0) AS has_comments_data,
            count(*) FILTER (is_premium) AS premium_articles, CAST(sum(claps) AS BIGINT) AS total_claps,
            CAST(sum(responses) AS BIGINT) AS total_responses, CAST(floor(sum(read_time) / count(*) + 0.5) AS BIGINT) AS average_read_time,
            coalesce(min(author) FILTER (author <> ''), 'Unknown') AS author_name, 'csv' AS format, {SCRAPED_AT} AS scraped_at
            FROM worded LEFT JOIN cc ON conv_id = article_id GROUP BY 1""",
        "sink_html": _report(),
        "barrier_stats": f"""WITH {_barriers(False)}, t AS (SELECT count(*) AS total_articles,
            count(*) FILTER (list_contains(active, 'premium')) AS premium_articles,
            count(*) FILTER (list_contains(active, 'member_only')) AS member_only_articles, count(barrier_type) AS paywall_hits FROM typed)
            SELECT *, {percent('paywall_hits', 'total_articles')} AS paywall_rate FROM t""",
        "export_stats": f"""WITH {ARTICLES}, {WORDED}, {COMMENT_COUNTS} SELECT author, count(*) AS total_articles, bool_or(author <> '') AS has_author_data,
            true AS has_content_data, bool_or(coalesce(cc.n, 0) > 0) AS has_comments_data, count(*) FILTER (is_premium) AS premium_articles,
            CAST(sum(claps) AS BIGINT) AS total_claps, CAST(sum(responses) AS BIGINT) AS total_responses,
            CAST(floor(sum(read_time) / count(*) + 0.5) AS BIGINT) AS average_read_time
            FROM worded LEFT JOIN cc ON conv_id = article_id GROUP BY 1""",
        "author_totals": f"""WITH {ARTICLES} SELECT author, count(*) AS total_articles, count(*) FILTER (NOT is_premium AND
            len(list_filter(tags, lambda t: contains('en', lower(t)) OR contains(lower(t), 'en'))) > 0) AS filtered_count FROM articles GROUP BY 1""",
        "keyword_counts": f"WITH {KEYWORDS} SELECT doc_id, word, n, first_rank FROM ranked",
        "event_counters": f"""WITH c AS (SELECT user_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS session_duration, {COUNTERS} FROM events GROUP BY 1)
            SELECT *, {SUCCESS} FROM c""",
        "source_success": f"""WITH t AS (SELECT source, count(*) FILTER (quality = 1) AS successful_requests, count(*) FILTER (quality <> 1) AS failed_requests,
            count(*) FILTER (quality IS NULL) AS unknown_requests, count(quality) AS total_requests
            FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
            SELECT *, {percent('successful_requests', 'total_requests')} AS success_rate FROM t""",
        "comment_totals": "SELECT count(*) AS total_comments_scraped FROM conversations",
        # windows, order, sets
        "keywords_topk": f"""WITH {KEYWORDS} SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_rank) AS rank, word, n
            FROM ranked) WHERE rank <= 10""",
        "keep_first_by_url": f"""WITH {LISTING}, {FIRSTS} SELECT url, batch, "index", author FROM firsts""",
        "item_index": f"WITH {LINES}, {LINE} SELECT doc_id, i AS item_index, line FROM line",
        "cumulative_batches": f"""WITH {LISTING}, {FIRSTS}, n AS (SELECT author, batch, count(*) AS new_items FROM firsts GROUP BY 1, 2),
            t AS (SELECT *, CAST(sum(new_items) OVER (PARTITION BY author ORDER BY batch) AS BIGINT) AS total_items FROM n)
            SELECT *, total_items - new_items < 3 AS is_read FROM t""",
        "cumulative_until_limit": f"""WITH {LISTING}, {FIRSTS}, n AS (SELECT author, batch, count(*) AS c FROM firsts GROUP BY 1, 2),
            t AS (SELECT *, sum(c) OVER (PARTITION BY author ORDER BY batch) - c AS before FROM n)
            SELECT url, f.author, f.batch, "index" FROM firsts f JOIN t ON t.author = f.author AND t.batch = f.batch WHERE before < 3""",
        "sort_latest": f"WITH {ARTICLES} SELECT {BRIEF} FROM articles",
        "sort_oldest": f"WITH {ARTICLES} SELECT {BRIEF} FROM articles",
        "sort_popular": f"WITH {ARTICLES} SELECT {BRIEF}, claps, responses FROM articles",
        "limit_posts": f"WITH {ARTICLES} SELECT {BRIEF} FROM articles ORDER BY claps + responses DESC, article_id LIMIT 100",
        "limit_posts_per_author": f"""WITH {ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY published_at NULLS LAST, article_id)
            AS rank FROM articles) SELECT {BRIEF}, rank FROM r WHERE rank <= 3""",
        "filter_sort_limit": f"""WITH {ARTICLES}, r AS (SELECT *, row_number() OVER (PARTITION BY author {LATEST}) AS k FROM articles
            WHERE NOT is_premium AND (published_at IS NULL OR published_at BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-12-31')
            AND len(list_filter(tags, lambda t: len(list_filter(['en', 'fr', 'src7'], lambda w: contains(lower(t), w) OR contains(w, lower(t)))) > 0)) > 0)
            SELECT article_id, author, url, title, {listed('tags')} AS tags, claps, responses, is_premium, {iso('published_at')} AS published_at
            FROM r WHERE k <= 10""",
        "newest_long_articles": f"""WITH {ARTICLES}, {WORDED}, r AS (SELECT *, row_number() OVER (PARTITION BY author {LATEST}) AS rank FROM worded
            WHERE word_count > 200) SELECT author, rank, article_id, title, word_count, read_time AS read_minutes FROM r WHERE rank <= 10""",
        "merge_batches": f"""WITH {LISTING} SELECT url, batch, "index" FROM listing
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch >= 2, batch, "index") = 1""",
        # streaming
        "stream_dedupe": "SELECT DISTINCT 'https://example.com/u/' || user_id || '/' || event_type AS url FROM events",
        "session_stats": f"WITH {SESSIONS} {SESSION_ROWS}",
        "stream_session_stats": f"WITH {SESSIONS} {SESSION_ROWS}",
        "rate_audit": RATES,
        "stream_rate_audit": RATES,
        "stream_counters": f"""SELECT strftime(h, '%Y-%m-%d %H:%M') AS window_start, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS window_end,
            event_type, n FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY 1, 2)""",
        "stream_append_results": "SELECT event_type AS type, event_id, user_id, value FROM events",
        # user functions
        "register_functions": f"""SELECT doc_id, {clean('text')} AS cleaned, {words('text')} AS words, {SLUG} AS slug,
            {TRUNCATED.format(80, 77)} AS short, {listed(MENTIONS)} AS mentions, {SUMMARY_TEXT} AS summary, {escape('text')} AS escaped,
            doc_id AS engagement FROM documents""",
        "html_blocks": f"""WITH {PG}, i AS (SELECT page_id, list_transform(regexp_extract_all(h, '(?is)<li>.*?</li>'), lambda x: {LINK_TEXT}) AS items FROM pg)
            SELECT page_id, CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS position, CAST(1 AS BIGINT) AS depth, 'ul' AS list_type,
            unnest(items) AS item FROM i""",
    }
    return {name: " ".join(line.strip() for line in text.splitlines()) for name, text in sql.items()}

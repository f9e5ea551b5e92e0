"""The same queries as plain SQL over the given tables, for DuckDB."""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
CHARREF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# The references that occur in the tables and views.
ENTITIES = {
    "&amp;": "&", "&amp": "&", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&copy;": "©", "&copy": "©",
    "&middot;": "·", "&eacute;": "é",
}
STYLE_PROMPT = "Write a tweet in my style."


# Names that count without a semicolon even when letters follow.
PREFIXES = {"&quot": '"', "&copy": "©", "&middot": "·", "&eacute": "é", "&amp": "&", "&lt": "<", "&gt": ">"}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(c: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"


def unescape(c: str) -> str:
    cases = " ".join(f"WHEN ref = {q(k)} THEN {q(v)}" for k, v in ENTITIES.items())
    cases += "".join(f" WHEN starts_with(ref, {q(k)}) THEN {q(v)} || substr(ref, {len(k) + 1})" for k, v in PREFIXES.items())
    return (
        f"(SELECT string_agg(piece || CASE {cases} ELSE ref END, '' ORDER BY i) FROM "
        f"(SELECT unnest(string_split_regex({c}, {q(CHARREF)})) AS piece, "
        f"unnest(list_concat(regexp_extract_all({c}, {q(CHARREF)}), [''])) AS ref, "
        f"unnest(range(len(string_split_regex({c}, {q(CHARREF)})))) AS i))"
    )


def strip(c: str) -> str:
    return sub(c, f"^{WS}+|{WS}+$")


def collapse(c: str) -> str:
    return f"trim({sub(c, WS + '+', ' ')})"


def clean_tail(c: str) -> str:
    """Post cleaning after decoding."""
    for pattern in (
        f"https?://{NOT_WS}+", f"[#@]{WORD}+", rf"(?i)this tweet was edited at{WS}[^\n]*\n?$", "[\u200e\u200f]",
    ):
        c = sub(c, pattern)
    return collapse(c)


def untag(c: str) -> str:
    return sub(c, "<[^>]+>", " ")


def norm_text(c: str) -> str:
    return collapse(unescape(untag(c)))


def norm_ws(c: str) -> str:
    return strip(sub(sub(sub(c, r"\r\n?", "\n"), r"[ \t\f\v]+", " "), r"\n{3,}", "\n\n"))


def chunk_hash(c: str) -> str:
    return f"sha256(lower({collapse(unescape(c))}))"


def ctes(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def chat(role: str, content: str, order: str) -> str:
    return f"string_agg({role} || ': ' || {content}, chr(10) ORDER BY {order})"


# --- posts -------------------------------------------------------------------

RAW = """raw AS (
  SELECT doc_id, cast(doc_id AS varchar) AS id_str, lang, source,
    TIMESTAMP '2020-01-01' + to_minutes(doc_id * 37 % 1000 * 61) AS made,
    (CASE WHEN doc_id % 17 = 3 THEN 'RT @ ' ELSE '' END) || '@user_' || (doc_id % 9) || ' ' || text
      || ' https://t.example/' || doc_id || '?a=1&b=2 #Tag' || (doc_id % 10)
      || (CASE WHEN doc_id % 4 = 1 THEN ' &amp;lt;caf&eacute;&gt; &copy' ELSE '' END)
      || (CASE WHEN doc_id % 19 = 2 THEN chr(10) || 'This tweet was edited at 10:00' ELSE '' END) AS full_text,
    CASE WHEN doc_id % 3 = 1 THEN cast(doc_id - 1 AS varchar) WHEN doc_id % 11 = 5 THEN 'none-such' ELSE '' END AS reply_to,
    doc_id % 7 = 0 AS is_quote
  FROM documents)"""

POSTS = f"""decoded AS (SELECT * EXCLUDE (full_text), {unescape('full_text')} AS plain FROM raw),
cleaned AS (SELECT * EXCLUDE (plain), {clean_tail('plain')} AS text FROM decoded),
posts AS (
  SELECT *, starts_with(text, 'RT @') AS is_retweet,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 4 THEN date_trunc('day', made) ELSE made END AS ts
  FROM cleaned)"""

# Keep-first by the cleaned text; the text is cleaned a second time for the key.
KEPT = f"""keyed AS (SELECT *, {unescape('text')} AS again FROM posts WHERE NOT is_retweet),
kept AS (
  SELECT * EXCLUDE (again) FROM keyed
  QUALIFY row_number() OVER (PARTITION BY sha256(lower({clean_tail('again')})) ORDER BY doc_id) = 1)"""

SORT_TS = "coalesce(ts, TIMESTAMP '1970-01-01')"

POST_CHAT = f"""CASE WHEN k.reply_to = '' THEN 'user: {STYLE_PROMPT}' || chr(10) || 'model: ' || k.text
  WHEN p.doc_id IS NULL THEN 'model: ' || k.text
  ELSE 'user: ' || p.text || chr(10) || 'model: ' || k.text END"""

# --- threads -----------------------------------------------------------------

THREADS = """threads AS (
  SELECT conv_id * 100 + turn + 1 AS id,
    CASE WHEN turn > 0 THEN conv_id * 100 + turn WHEN conv_id % 11 = 4 THEN conv_id * 100 + turn + 1
      WHEN conv_id % 7 = 3 THEN conv_id * 100 + turn + 2 WHEN conv_id % 5 = 1 THEN (conv_id - 1) * 100 + 1
      WHEN conv_id % 13 = 6 THEN -1 ELSE 0 END AS parent_id,
    conv_id * 100 + 1 AS root_id, role AS nick,
    CASE WHEN turn = 0 THEN 'Thread ' || conv_id ELSE '' END AS title,
    CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN ' ' ELSE text END AS body,
    strftime(TIMESTAMP '2020-01-01' + to_days(cast(conv_id AS int)) + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS created_at
  FROM conversations)"""

CHAINS = """steps AS (
  SELECT id, id AS cur, [id] AS up FROM threads
  UNION ALL
  SELECT s.id, p.id, list_append(s.up, p.id)
  FROM steps s JOIN threads c ON c.id = s.cur JOIN threads p ON p.id = c.parent_id
  WHERE c.parent_id <> 0 AND c.parent_id <> c.id AND NOT list_contains(s.up, p.id)),
chains AS (SELECT id, arg_max(up, len(up)) AS up FROM steps GROUP BY id)"""


def chain_text(up: str) -> str:
    return f"array_to_string(list_transform(list_reverse({up}), lambda x: cast(x AS varchar)), '>')"


def thread_examples(max_context: int, strip_own: bool) -> str:
    """CTEs answers (ids, root, time) and lines (id, at, role, content)."""
    own = "AND t.nick <> 'assistant'" if strip_own else ""
    cut = f"WHERE back <= {max_context}" if max_context > 0 else ""
    return f"""texts AS (SELECT id, {strip("title || chr(10) || chr(10) || body")} AS content FROM threads),
answers AS (SELECT t.*, x.content FROM threads t JOIN texts x USING (id) WHERE t.nick = 'assistant' AND x.content <> ''),
hops AS (SELECT c.id, unnest(c.up) AS node, unnest(range(len(c.up))) AS hop FROM chains c JOIN answers a USING (id)),
others AS (
  SELECT h.id, h.node, row_number() OVER (PARTITION BY h.id ORDER BY h.hop) AS back
  FROM hops h JOIN threads t ON t.id = h.node WHERE h.hop > 0 {own}),
lines AS (
  SELECT o.id, -o.back AS place, 'user' AS role, x.content FROM (SELECT * FROM others {cut}) o
    JOIN texts x ON x.id = o.node WHERE x.content <> ''
  UNION ALL SELECT id, 0, 'model', content FROM answers),
dialogs AS (SELECT id, count(*) AS n, {chat('role', 'content', 'place')} AS chat FROM lines GROUP BY id HAVING count(*) >= 2)"""


def thread_query(max_context: int, strip_own: bool) -> str:
    return ctes(THREADS, CHAINS, thread_examples(max_context, strip_own)) + (
        "SELECT a.root_id AS thread_id, a.id AS post_id, a.created_at, d.chat FROM dialogs d JOIN answers a USING (id)"
    )


# --- documents ---------------------------------------------------------------


def chunks(src: str, name: str, separator: str, low: int = 80, high: int = 1200) -> str:
    """CTE ``name`` (path, pos, paragraph, chunk_hash) from ``src`` (path, text)."""
    return f"""{name}_parts AS (
  SELECT path, list_filter(list_transform(string_split_regex({norm_ws('text')}, {q(separator)}), lambda p: {strip('p')}),
    lambda p: p <> '') AS parts
  FROM {src} WHERE text <> ''),
{name}_rows AS (SELECT path, unnest(parts) AS paragraph, unnest(range(len(parts))) AS pos FROM {name}_parts),
{name} AS (SELECT path, pos, paragraph, {chunk_hash('paragraph')} AS chunk_hash FROM {name}_rows
  WHERE length(paragraph) BETWEEN {low} AND {high})"""


LATER = "\n\nAdded in a second run, and long enough to count as a paragraph of its own in the document "
BLANK_LINE = rf"\n{WS}*\n"
FILES = """files AS (
  SELECT 'doc-' || doc_id AS path, doc_id, text, n_chars AS size,
    1577836800 + doc_id * 60 AS mtime FROM documents)"""

HTML_MARKUP = (
    r"(?is)(?:<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<noscript\b[^>]*>.*?</noscript\s*>|<[a-z/!?][^>]*>)+"
)
PAGES = f"""bare AS (SELECT page_id AS path, {sub('html', HTML_MARKUP, chr(10))} AS html FROM pages),
page_texts AS (SELECT path, {unescape('html')} AS text FROM bare)"""

TOPIC = "[A-Za-z\u0590-\u05FF][\\p{L}\\p{N}_\u2019\u05f3\u05f4'-]{2,}"
WORDS = f"list_transform(regexp_extract_all({sub('paragraph', 'https?://' + NOT_WS + '+')}, {q(TOPIC)}), lambda w: lower(w))"


def topics(src: str, name: str) -> str:
    """CTE ``name``: rows of ``src`` plus the prompt."""
    return f"""{name}_words AS (SELECT *, {WORDS} AS words FROM {src}),
{name} AS (
  SELECT * EXCLUDE (words), 'Write a paragraph in my signature style about: '
    || CASE WHEN len(words) = 0 THEN 'general'
      ELSE array_to_string(list_filter(words, lambda w, i: list_position(words, w) = i)[1:8], ', ') END || '.' AS prompt
  FROM {name}_words)"""


MANIFEST = (
    "labelled AS (SELECT f.path, f.text, f.mtime, f.size + l.toxic AS size FROM files f JOIN labels l USING (doc_id))",
    chunks("labelled", "before", r"\n", 80, 300),
    """manifest AS (
  SELECT l.path, l.mtime, l.size,
    coalesce((SELECT list_sort(list(DISTINCT b.chunk_hash)) FROM before b WHERE b.path = l.path), []) AS chunks
  FROM labelled l WHERE l.text <> ''
  UNION ALL SELECT '/web/page-' || page_id || '.HTML', 1577836800, 1, [] FROM pages)""",
    """changed AS (
  SELECT f.* FROM files f WHERE NOT EXISTS
    (SELECT 1 FROM manifest m WHERE m.path = f.path AND m.mtime = f.mtime AND m.size = f.size))""",
)

# --- sync --------------------------------------------------------------------

FEED = """feed AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS id, event_type || ' ' || props || ' by @user' || user_id AS text,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(millisecond(ts) % 1000 AS varchar), 3, '0') || 'Z' AS created_at,
    ts, event_type AS source, user_id % 10 AS kind, event_id
  FROM events),
feed_clean AS (SELECT *, """ + clean_tail("text") + """ AS clean FROM feed)"""

SYNCED = """passing AS (
  SELECT * FROM feed_clean WHERE kind <> 0 AND source NOT IN ('error', 'signup') AND length(clean) >= 18
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 1),
new AS (SELECT * FROM passing WHERE id NOT IN (SELECT id FROM feed WHERE source = 'purchase'))"""

# What the landed pages bring: every post and an answer to it, minus reposts.
LANDED = """landed AS (
  SELECT id, text, created_at, ts, source, kind, 0 AS pos, event_id FROM feed
  UNION ALL SELECT 're-' || id, 'Re: ' || text, created_at, ts, source, 11, 1, event_id FROM feed),
landed_clean AS (SELECT *, """ + clean_tail("text") + """ AS clean FROM landed)"""

# --- dialogs -----------------------------------------------------------------

VARIANTS = """variants AS (
  SELECT conv_id * 10 + v AS conv_id, turn,
    CASE WHEN v = 3 THEN CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'system' ELSE 'user' END
      WHEN v = 5 THEN CASE role WHEN 'user' THEN ' Model ' WHEN 'assistant' THEN 'BOT' ELSE 'System' END
      ELSE role END AS role,
    CASE WHEN v = 4 THEN '<b>RT</b> ' || text WHEN v = 5 AND turn = 2 THEN '' WHEN v = 5 AND turn % 2 = 1 THEN ' <p> '
      ELSE text END AS content
  FROM conversations, range(6) AS r(v)
  WHERE NOT (v = 1 AND turn = 0) AND NOT (v = 2 AND turn = 1))"""


def dialogs(src: str, reposts: bool = True) -> str:
    """CTEs from ``src`` (conv_id, turn, role, content): merged runs, verdicts, repaired rows."""
    drop = "AND NOT (last_role = 'assistant' AND starts_with(lower(last_text), 'rt'))" if reposts else ""
    return f"""untagged AS (
  SELECT conv_id, turn, {untag('content')} AS content,
    CASE WHEN lower({strip('role')}) IN ('assistant', 'model') THEN 'assistant'
      WHEN lower({strip('role')}) = 'system' THEN 'system' ELSE 'user' END AS role
  FROM {src} WHERE content <> ''),
normed AS (SELECT conv_id, turn, role, {collapse(unescape('content'))} AS content FROM untagged),
flagged AS (
  SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS starts FROM normed
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM flagged),
merged AS (
  SELECT conv_id, run, min(turn) AS turn, any_value(role) AS role, arg_max(content, turn) AS closing,
    CASE WHEN count(*) = 1 THEN any_value(content)
      ELSE coalesce({strip("string_agg(content, chr(10) || chr(10) ORDER BY turn) FILTER (content <> '')")}, '') END AS content
  FROM numbered GROUP BY conv_id, run),
shapes AS (
  SELECT conv_id, string_agg(left(role, 1), '' ORDER BY run) AS shape, max(run) AS runs, min(turn) AS first_turn,
    arg_max(role, run) AS last_role, arg_max(closing, run) AS last_text
  FROM merged GROUP BY conv_id),
verdicts AS (
  SELECT * FROM shapes WHERE regexp_full_match(shape, 's?(ua)+[us]?|a(ua)*[us]?') {drop}),
repaired AS (
  SELECT m.conv_id, m.turn, m.role, m.content FROM merged m JOIN verdicts v USING (conv_id)
    WHERE m.run < v.runs OR v.last_role = 'assistant'
  UNION ALL SELECT conv_id, first_turn - 1, 'user', '...' FROM verdicts WHERE starts_with(shape, 'a'))"""


MEASURES = """measures AS (
  SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns,
    coalesce(arg_max(lower(content) = '...' OR starts_with(lower(content), 'write a'), turn) FILTER (role = 'user'), false) AS generic,
    coalesce(sum(length(content)) FILTER (role = 'user'), 0) AS prompt_chars,
    coalesce(sum(length(content)) FILTER (role = 'assistant'), 0) AS response_chars
  FROM repaired GROUP BY conv_id)"""

REPORT = """SELECT count(*) AS total_examples,
  round(count(*) FILTER (user_turns = 1) / count(*), 6) AS single_turn_pct,
  round(count(*) FILTER (user_turns <> 1) / count(*), 6) AS multi_turn_pct,
  round(count(*) FILTER (generic) / count(*), 6) AS generic_prompt_pct,
  round(sum(prompt_chars) / count(*), 4) AS avg_prompt_len, round(sum(response_chars) / count(*), 4) AS avg_response_len,
  count(*) FILTER (generic) / count(*) > 0.5 AS generic_warning
FROM """

TURNS = "turns AS (SELECT conv_id, turn, role, text AS content FROM conversations)"

LAST_ANSWERS = f"""answers_raw AS (
  SELECT conv_id, {untag("arg_max(content, turn)")} AS answer FROM repaired WHERE role = 'assistant' GROUP BY conv_id),
dialog_keys AS (SELECT conv_id, sha256(lower({collapse(unescape('answer'))})) AS dedup_key FROM answers_raw)"""

DOC_ANSWERS = f"""doc_norm AS (SELECT doc_id, lang, source, {norm_text('text')} AS text FROM documents WHERE text <> ''),
doc_answers AS (
  SELECT doc_id, lang, source, text, sha256(lower({norm_text('text')})) AS dedup_key FROM doc_norm
  WHERE NOT starts_with(lower(text), 'rt')),
doc_first AS (SELECT * FROM doc_answers QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY doc_id) = 1)"""

# The three datasets of the flagship query as message rows; conv_id names the example.
DATASETS = (
    RAW, POSTS, FILES, chunks("files", "line_chunks", r"\n"), topics("line_chunks", "prompted"),
    THREADS, CHAINS, thread_examples(4, False),
    f"""examples AS (
  SELECT '0/' || k.id_str AS conv_id, 'posts.jsonl' AS source_file, k.id_str AS key, 0 AS input, k.doc_id AS o0, 0 AS o1,
    '' AS lang, '' AS created_at FROM posts k
  UNION ALL SELECT '1/' || path || '/' || pos, 'docs.jsonl', path || '/' || pos, 1, cast(substr(path, 5) AS bigint), pos, 'xx', ''
    FROM prompted
  UNION ALL SELECT '2/' || d.id, 'threads.jsonl', cast(d.id AS varchar), 2, d.id, 0, '', a.created_at
    FROM dialogs d JOIN answers a USING (id)),
example_turns AS (
  SELECT '0/' || k.id_str AS conv_id, 0 AS turn, 'user' AS role, CASE WHEN k.reply_to = '' THEN {q(STYLE_PROMPT)} ELSE p.text END AS content
    FROM posts k LEFT JOIN posts p ON p.id_str = k.reply_to WHERE k.reply_to = '' OR p.doc_id IS NOT NULL
  UNION ALL SELECT '0/' || id_str, 1, 'model', text FROM posts
  UNION ALL SELECT '1/' || path || '/' || pos, 0, 'user', prompt FROM prompted
  UNION ALL SELECT '1/' || path || '/' || pos, 1, 'model', paragraph FROM prompted
  UNION ALL SELECT '2/' || l.id, l.place, l.role, l.content FROM lines l JOIN dialogs d USING (id))""",
    dialogs("example_turns"),
)

LAST_PROMPT = """prompts AS (
  SELECT conv_id, coalesce(arg_max(lower(content) = '...' OR starts_with(lower(content), 'write a'), turn), false) AS generic
  FROM repaired WHERE role = 'user' GROUP BY conv_id)"""


def unified(where: str = "") -> str:
    return f"""unified AS (
  SELECT e.*, k.dedup_key FROM examples e JOIN dialog_keys k USING (conv_id) JOIN prompts p USING (conv_id) {where}
  QUALIFY row_number() OVER (PARTITION BY k.dedup_key ORDER BY e.input, e.o0, e.o1) = 1)"""


def split_parts(src: str, key: str, pct: float) -> str:
    """CTE parts (key, part): the tail of the md5 order."""
    return f"""ranked AS (
  SELECT {key}, row_number() OVER (ORDER BY md5('42:' || {key}) DESC) AS back, count(*) OVER () AS n FROM {src}),
parts AS (
  SELECT {key}, CASE WHEN back <= CASE WHEN n > 1 THEN least(greatest(1, round_even(n * cast({pct} AS double), 0)), n - 1) ELSE 0 END
    THEN 'eval' ELSE 'train' END AS part FROM ranked)"""


LATIN1 = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_pairs = [(c, c.encode("latin-1").decode("cp1255", "ignore")) for c in LATIN1]
AS_CP1255 = (
    f"translate(text, {q(''.join(c for c, d in _pairs if d) + ''.join(c for c, d in _pairs if not d))}, "
    f"{q(''.join(d for _, d in _pairs))})"
)

SQL: dict[str, str] = {
    "norm_text_pages": f"SELECT page_id, {collapse(unescape('t'))} AS text FROM (SELECT page_id, {untag('html')} AS t FROM pages)",
    "clean_text_posts": ctes(RAW, POSTS) + "SELECT id_str, text FROM posts",
    "forum_text_pages": "WITH a AS (SELECT page_id, "
    + f"replace({sub(sub(sub(sub('html', '<br(?: ?/)?>', chr(10)), '(?i)</p>' + WS + '*<p>', chr(10) * 2), '(?i)</?p[^>]*>'), '<[^>]+>')}, "
    + r"'\/', '/') AS t FROM pages), b AS (SELECT page_id, "
    + f"{unescape('t')} AS t FROM a) SELECT page_id, "
    + strip(sub(sub(sub('t', r'[ \t]+\n', '\n'), r'\n{3,}', '\n\n'), r'[ \t]{2,}', ' '))
    + " AS text FROM b",
    "html_to_paragraphs": ctes(PAGES, chunks("page_texts", "c", BLANK_LINE)) + "SELECT * FROM c",
    "parse_timestamps": """SELECT event_id,
  epoch_us(date_trunc('second', ts)) + 12600000000 AS weekday, epoch_us(date_trunc('second', ts)) - 7200000000 AS "offset",
  epoch_us(date_trunc('second', ts)) AS naive, epoch_us(ts) AS zulu, epoch_us(cast(date_trunc('day', ts) AS timestamp)) AS day,
  cast(NULL AS bigint) AS year, cast(NULL AS bigint) AS clock FROM events""",
    "next_start_times": """SELECT event_id, strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS seconds,
  strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') || CASE WHEN millisecond(ts) % 1000 = 0 THEN ''
    ELSE '.' || lpad(cast(millisecond(ts) % 1000 AS varchar), 3, '0') || '000' END || 'Z' AS millis,
  strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S+02:00') AS "offset", event_type AS unreadable FROM events""",
    "source_apps": """SELECT cast(doc_id AS varchar) AS id_str, source || ' & Co' AS anchor, lang AS bare, source || ' & Co' AS "inner"
  FROM documents""",
    "unify_posts": ctes(RAW, POSTS) + """SELECT id_str, text,
  CASE WHEN doc_id % 13 = 0 THEN 'none' WHEN doc_id % 5 = 0 THEN strftime(made, '%a %b %d %H:%M:%S +0000 %Y')
    WHEN doc_id % 5 = 1 THEN strftime(made, '%Y-%m-%dT%H:%M:%SZ') WHEN doc_id % 5 = 2 THEN strftime(made, '%Y-%m-%d %H:%M:%S')
    WHEN doc_id % 5 = 3 THEN strftime(made + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S+0200') ELSE strftime(made, '%Y-%m-%d') END AS created_at,
  cast(epoch(ts) AS bigint) AS ts, lang, source || ' & Co' AS source_app, reply_to AS in_reply_to_id, is_quote, is_retweet FROM posts""",
    "filter_posts": ctes(RAW, POSTS)
    + "SELECT id_str, text FROM posts WHERE NOT is_retweet AND NOT is_quote AND reply_to = ''",
    "dedup_posts_keep_first": f"""WITH c AS (SELECT doc_id, {clean_tail('text')} AS text FROM documents)
SELECT cast(doc_id AS varchar) AS id_str, text FROM c
QUALIFY row_number() OVER (PARTITION BY sha256(lower({clean_tail('text')})) ORDER BY doc_id) = 1""",
    "order_posts": ctes(RAW, POSTS) + f"SELECT id_str, row_number() OVER (ORDER BY {SORT_TS}, doc_id) - 1 AS position FROM posts",
    "reply_parent_dialog": ctes(RAW, POSTS)
    + f"""SELECT k.id_str, {POST_CHAT} AS chat FROM posts k LEFT JOIN posts p ON p.id_str = k.reply_to
WHERE NOT k.is_retweet AND k.reply_to <> ''""",
    "reply_chain_dialog": ctes(RAW, POSTS) + """SELECT k.id_str,
  coalesce((SELECT string_agg(CASE WHEN (k.doc_id - a.doc_id) % 2 = 1 THEN 'user: ' ELSE 'model: ' END || a.text, chr(10) ORDER BY a.doc_id)
    FROM posts a WHERE a.doc_id BETWEEN k.doc_id - least(k.doc_id % 6, 3) AND k.doc_id), '') AS chat FROM posts k""",
    "style_examples": ctes(RAW, POSTS)
    + f"SELECT id_str, 'user: {STYLE_PROMPT}' || chr(10) || 'model: ' || text AS chat FROM posts",
    "temporal_holdout": ctes(RAW, POSTS) + f"""SELECT id_str,
  CASE WHEN row_number() OVER (ORDER BY {SORT_TS} DESC, doc_id DESC) <= round_even(count(*) OVER () * cast(0.05 AS double), 0)
    THEN 'eval' ELSE 'train' END AS part FROM posts""",
    "post_import": ctes(RAW, POSTS, KEPT) + f"""SELECT k.id_str AS tweet_id,
  CASE WHEN row_number() OVER (ORDER BY coalesce(k.ts, TIMESTAMP '1970-01-01') DESC, k.doc_id DESC)
    <= round_even(count(*) OVER () * cast(0.1 AS double), 0) THEN 'eval' ELSE 'train' END AS part, {POST_CHAT} AS chat
FROM kept k LEFT JOIN posts p ON p.id_str = k.reply_to""",
    "post_import_plain": ctes(RAW, POSTS, KEPT.replace("WHERE NOT is_retweet", "WHERE NOT is_retweet AND NOT is_quote AND reply_to = ''"))
    + f"""SELECT id_str AS tweet_id, cast(epoch({SORT_TS}) AS bigint) AS sort_ts,
  'user: {STYLE_PROMPT}' || chr(10) || 'assistant: ' || text AS chat FROM kept""",
    "archive_posts": ctes(RAW) + """SELECT id_str AS id, 0 AS pos, full_text AS text, is_quote AS "quote", '' AS source FROM raw
UNION ALL SELECT 'b' || id_str, 1, full_text, false,
  '<a href="https://apps.example/' || source || '" rel="nofollow">' || source || ' &amp; Co</a>' FROM raw""",
    "archive_files": """SELECT cast(doc_id AS varchar) AS id, lang, text || ' }] "\\\\" [{' AS full_text, 2 AS copies FROM documents""",
    "thread_order": ctes(THREADS)
    + "SELECT id, created_at, row_number() OVER (ORDER BY created_at, id) - 1 AS position FROM threads",
    "ancestor_chain": ctes(THREADS, CHAINS) + f"SELECT id, {chain_text('up')} AS chain FROM chains",
    "ancestor_chain_bounded": ctes(THREADS, CHAINS) + f"SELECT id, {chain_text('up[1:3]')} AS chain FROM chains",
    "thread_examples": thread_query(3, False),
    "thread_examples_no_self": thread_query(2, True),
    "thread_examples_full": thread_query(0, False),
    "thread_duplicate_ids": ctes(THREADS, CHAINS, thread_examples(4, False))
    + """SELECT cast(a.id AS varchar) AS post_id, d.chat, 2 AS copies, 2 * count(*) OVER () AS written
FROM dialogs d JOIN answers a USING (id)""",
    "doc_paragraphs": ctes(FILES, chunks("files", "c", BLANK_LINE)) + "SELECT * FROM c",
    "doc_chunks": ctes(FILES, chunks("files", "c", r"\n")) + "SELECT * FROM c",
    "doc_topics": ctes(FILES, chunks("files", "c", r"\n"), topics("c", "t")) + "SELECT path, pos, 'xx' AS lang, prompt FROM t",
    "docs_changed_files": ctes(FILES, *MANIFEST) + "SELECT path, size FROM changed",
    "docs_new_chunks": ctes(FILES, *MANIFEST, chunks("changed", "c", r"\n")) + """SELECT c.path, c.pos, c.chunk_hash FROM c
LEFT JOIN manifest m ON m.path = c.path WHERE m.path IS NULL OR NOT list_contains(m.chunks, c.chunk_hash)""",
    "docs_prune_state": ctes(FILES, *MANIFEST)
    + "SELECT path, size, len(chunks) AS chunks FROM manifest WHERE path IN (SELECT path FROM files)",
    "docs_manifest": ctes(FILES, *MANIFEST, chunks("changed", "c", BLANK_LINE)) + """SELECT path, mtime, size, array_to_string(chunks, ',') AS chunks
  FROM manifest WHERE path IN (SELECT path FROM files) AND path NOT IN (SELECT path FROM changed WHERE text <> '')
UNION ALL SELECT f.path, f.mtime, f.size,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT c.chunk_hash)), ',') FROM c WHERE c.path = f.path), '')
  FROM changed f WHERE f.text <> ''""",
    "document_import": ctes(FILES, *MANIFEST, chunks("changed", "c", BLANK_LINE, 200, 2000), topics("c", "t"))
    + """SELECT t.path AS source, 'en' AS lang, 'user: ' || prompt || chr(10) || 'model: ' || paragraph AS chat FROM t
LEFT JOIN manifest m ON m.path = t.path WHERE m.path IS NULL OR NOT list_contains(m.chunks, t.chunk_hash)""",
    "document_import_files": ctes(
        PAGES, """sources AS (SELECT 'doc-' || doc_id AS path, text FROM documents UNION ALL SELECT 'page-' || path, text FROM page_texts
  UNION ALL SELECT 'item-' || item_id, text FROM benchmark)""",
        f"""later AS (SELECT 'doc-' || doc_id AS path, {q(LATER)} || doc_id AS text FROM documents WHERE text <> '')""",
        chunks("sources", "c", BLANK_LINE), chunks("later", "l", BLANK_LINE), "both_runs AS (SELECT * FROM c UNION ALL SELECT * FROM l)",
        topics("both_runs", "t"))
    + "SELECT path AS source, 'en' AS lang, 'user: ' || prompt || chr(10) || 'model: ' || paragraph AS chat FROM t",
    "document_texts": ctes(PAGES) + f"""SELECT '/web/page-' || path || '.HTML' AS path, text FROM page_texts
UNION ALL SELECT '/old/doc-' || doc_id || '.txt', {AS_CP1255} FROM documents""",
    "sync_new_posts": ctes(FEED, SYNCED)
    + f"SELECT id AS tweet_id, 'user: {STYLE_PROMPT}' || chr(10) || 'model: ' || clean AS chat FROM new",
    "sync_high_water": ctes(FEED, SYNCED) + """, top AS (SELECT max(created_at) AS c FROM new)
SELECT 'new' AS feed, strftime(strptime(c, '%Y-%m-%dT%H:%M:%S.%gZ') + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S')
  || CASE WHEN substr(c, 21, 3) = '000' THEN '' ELSE '.' || substr(c, 21, 3) || '000' END || 'Z' AS start_time FROM top
UNION ALL SELECT 'none', '2024-01-02T00:00:00Z'""",
    "api_page_posts": ctes(FEED, LANDED)
    + """SELECT id, text, created_at, pos FROM landed WHERE kind NOT IN (1, 2, 11) AND created_at >= '2024-01-10T12:00:00.000Z'
UNION ALL SELECT 'malformed', '{"data": [{"id": "' || event_type || '"}', NULL, cast(count(*) AS integer) FROM events GROUP BY event_type""",
    "existing_ids": ctes(FEED) + "SELECT DISTINCT id AS tweet_id FROM feed",
    "unseen_events": ctes(FEED)
    + "SELECT id AS tweet_id, event_id AS ord FROM feed WHERE id NOT IN (SELECT id FROM feed WHERE source = 'purchase')",
    "unify_merge_roles": ctes(VARIANTS, dialogs("variants")) + "SELECT conv_id, turn, role, content FROM merged",
    "unify_alternation": ctes(VARIANTS, dialogs("variants", reposts=False)) + "SELECT conv_id, turn, role, content FROM repaired",
    "unify_filter_rt": ctes(VARIANTS, dialogs("variants")) + "SELECT conv_id, count(*) AS messages FROM repaired GROUP BY conv_id",
    "quality_report": ctes(TURNS, dialogs("turns"), MEASURES) + REPORT + "measures",
    "turn_histogram": ctes(TURNS, dialogs("turns"), MEASURES) + "SELECT user_turns, count(*) AS examples FROM measures GROUP BY user_turns",
    "dialog_keys": ctes(TURNS, dialogs("turns"), LAST_ANSWERS) + "SELECT conv_id, dedup_key FROM dialog_keys",
    "unify_dedup": ctes(DOC_ANSWERS) + "SELECT doc_id, dedup_key, lang FROM doc_first",
    "source_composition": ctes(DOC_ANSWERS)
    + "SELECT source AS source_file, count(*) AS examples, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM doc_first GROUP BY source",
    "unify_keep_keys": ctes(*DATASETS)
    + "SELECT source_file, o0, o1, lang, created_at FROM examples JOIN verdicts USING (conv_id)",
    "unify_datasets": ctes(*DATASETS, LAST_ANSWERS, LAST_PROMPT, unified()) + f"""SELECT u.source_file, u.key, u.dedup_key, x.chat
FROM unified u JOIN (SELECT conv_id, {chat('role', 'content', 'turn')} AS chat FROM repaired GROUP BY conv_id) x USING (conv_id)""",
    "unify_generic": ctes(*DATASETS, LAST_ANSWERS, LAST_PROMPT, unified("WHERE NOT p.generic"))
    + "SELECT source_file, key, dedup_key FROM unified",
    "unify_report": ctes(*DATASETS, LAST_ANSWERS, LAST_PROMPT, unified(), MEASURES)
    + REPORT + "measures JOIN unified USING (conv_id)",
    "shuffle_order": "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) - 1 AS position FROM documents",
    "split_train_eval": ctes("convs AS (SELECT DISTINCT conv_id FROM conversations)", split_parts("convs", "conv_id", 0.05))
    + "SELECT conv_id, part FROM parts",
    "render_examples": ctes(FILES, chunks("files", "c", BLANK_LINE), topics("c", "t"))
    + "SELECT path AS source, '<user>' || prompt || '</>|<model>' || paragraph || '</>' AS text FROM t",
    "jsonl_roundtrip": """SELECT 'docs.jsonl' AS source_file, 'c' || doc_id AS created_at,
  'user: Say it like ' || source || chr(10) || 'model: ' || text AS chat FROM documents
UNION ALL SELECT 'docs.jsonl', 'malformed', cast(count(*) + count(lang) AS varchar) FROM documents
UNION ALL SELECT 'docs.jsonl', 'no object', cast(2 * count(*) AS varchar) FROM documents""",
    "dataset_folder": """SELECT f AS source_file, count(*) AS examples FROM documents,
  (VALUES ('docs.jsonl'), ('eval.jsonl'), ('my docs+1.jsonl')) AS names(f) GROUP BY f""",
    "split_lines": f"""WITH n AS (SELECT count(*) AS n, least(greatest(1, round_even(count(*) * cast(0.1 AS double), 0)), count(*) - 1) AS e FROM documents)
SELECT 'eval.jsonl' AS source_file, cast(e AS bigint) AS written, cast(e AS bigint) AS copies FROM n
UNION ALL SELECT 'train.jsonl', cast(n - e AS bigint), cast(n - e AS bigint) FROM n
UNION ALL SELECT 'user: {STYLE_PROMPT}' || chr(10) || 'model: ' || text, 0, count(*) FROM documents GROUP BY text""",
    "state_snapshots": ctes(FILES, *MANIFEST)
    + """, s0 AS (SELECT path, size FROM manifest WHERE path IN (SELECT path FROM files)),
s1 AS (SELECT path, size + CASE WHEN size % 2 = 0 THEN 1 ELSE 0 END AS size FROM s0),
s2 AS (SELECT path, size + CASE WHEN size % 3 = 0 THEN 1 ELSE 0 END AS size FROM s1)
SELECT path, size + CASE WHEN size % 4 = 0 THEN 1 ELSE 0 END AS size, 5 AS version, 3 AS base FROM s2""",
    "unify_typed_keys": ctes(DOC_ANSWERS) + r"""SELECT concat('"number":', doc_id, ',"big":', repeat('1234567890', 5), doc_id, ',"exact":', doc_id, '.50',
  ',"odd":NaN,"word":"', doc_id, '","nothing":null,"nested":{"z": [', doc_id, ', -0.0], "a": "', coalesce(lang, 'null'),
  '", "a": "\u00e9\"}"}') AS kept, false AS absent
FROM doc_first""",
    "unify_files": ctes(DOC_ANSWERS) + """SELECT dedup_key, 'b' AS created_at FROM doc_first
UNION ALL SELECT 'rows', cast(count(*) AS varchar) FROM doc_first UNION ALL SELECT 'b.jsonl', cast(count(*) AS varchar) FROM doc_first""",
}

_SYNCED_TEXTS = ctes(FEED, LANDED) + f"""SELECT id AS tweet_id, 'user: {STYLE_PROMPT}' || chr(10) || 'model: ' || clean AS chat, 1 AS copies
FROM landed_clean
WHERE kind NOT IN (0, 2) AND source NOT IN ('error', 'signup') AND length(clean) >= 18
QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 1"""
SQL["sync_stream"] = _SYNCED_TEXTS
SQL["sync_job"] = _SYNCED_TEXTS

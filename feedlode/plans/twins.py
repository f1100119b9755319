"""The queries of the catalog in SQL, for comparison on the same tables.

Each is written from the rules, not from the Spark plans: parsed payloads, for one, are
compared with the documents the payloads were made of.
"""

from __future__ import annotations

from feedlode.functions import fixed_values as fixed
from feedlode.functions.text import UNICODE_SPACE
from feedlode.plans.catalog import TOP, WORDS
from feedlode.plans.tables import KEYWORDS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


WS = lit(UNICODE_SPACE)
BLANKS = "'[\\t\\n\\f\\r ]+'"
NON_WORD = "'[^\\p{L}\\p{N}\\t\\n\\f\\r ]+'"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return trim(f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), {BLANKS}, ' ', 'g')")


def hits(text: str) -> str:
    return f"list_filter({lst(KEYWORDS)}, lambda k: contains(lower({text}), lower(k)))"


def bar(x: str) -> str:
    return f"array_to_string({x}, '|')"


def any_word(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def first_sentence(x: str) -> str:
    marks = fixed.SENTENCE_MARKS
    sentence = f"regexp_extract({x}, '(?s)^([^{marks}]+[{marks}])', 1)"
    size = f"list_max(list_filter(range(1, 141), lambda n: strlen(left({x}, n)) <= 140))"
    return (
        f"CASE WHEN {sentence} <> '' THEN {trim(sentence)} "
        f"WHEN strlen({x}) > 140 THEN {trim(f'left({x}, {size}::INT)')} || '...' ELSE {x} END"
    )


def rounded_mean(total: str, n: str) -> str:
    return f"COALESCE((({total}) * 20 + ({n})) // NULLIF(2 * ({n}), 0) / 10.0, 0)::DOUBLE"


POSTS = """posts AS (
  SELECT doc_id, doc_id::VARCHAR AS id, source AS platform, lang AS channel,
         regexp_extract(text, '(?s)^[\\t\\n\\f\\r ]*([^\\n]*)', 1) AS title, text AS content,
         'doc://' || doc_id AS url, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at
  FROM documents)"""

SCORE = " + ".join(
    [
        str(fixed.BASE_SCORE),
        f"CASE WHEN {any_word('t', WORDS['manual_words'])} THEN 2 ELSE 0 END",
        f"CASE WHEN {any_word('t', WORDS['sheet_words'])} THEN 1 ELSE 0 END",
        f"CASE WHEN {any_word('t', WORDS['strain_words'])} THEN 1 ELSE 0 END",
    ]
)

KEYWORDED = f"""{POSTS},
found AS (SELECT *, {hits("title || ' ' || content")} AS kw FROM posts)"""

ANALYSIS = f"""texts AS (
  SELECT *, lower(title || ' ' || content) AS t, {clean('title')} AS ct, {clean('content')} AS cc FROM found),
analysed AS (
  SELECT *,
    CASE WHEN ct <> '' THEN ct
         WHEN cc <> '' THEN {first_sentence('cc')} ELSE {lit(fixed.PAIN_POINT_DEFAULT)} END AS core_pain_point,
    CASE WHEN {any_word('t', WORDS['manual_words'])} THEN {lit(fixed.WORKAROUND_MANUAL)}
         ELSE {lit(fixed.WORKAROUND_DEFAULT)} END AS current_workaround,
    LEAST({SCORE}, {fixed.MAX_SCORE})::INT AS commercial_potential,
    CASE WHEN {any_word('t', WORDS['physical_words'])} THEN {lit(fixed.FEASIBILITY_MEDIUM)}
         ELSE {lit(fixed.FEASIBILITY_HIGH)} END AS saas_feasibility,
    {any_word('t', WORDS['explicit_signals'])} AS is_explicit_content,
    {lit(fixed.HEURISTIC_MODEL)} AS analysis_model
  FROM texts)"""

ANALYSED = f"{KEYWORDED}, {ANALYSIS}"


def without_noise(x: str) -> str:
    for phrase in fixed.NOISE_PHRASES:
        x = f"replace({x}, {lit(phrase)}, ' ')"
    return x


def ordered_set(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


STOP = lst(fixed.STOP_WORDS)

CLUSTERING = f"""labelled AS (
  SELECT *, CASE WHEN length({clean('core_pain_point')}) > 120
                 THEN {trim(f"left({clean('core_pain_point')}, 120)")} || '...'
                 ELSE {clean('core_pain_point')} END AS label
  FROM analysed),
based AS (
  SELECT *, {trim(f"regexp_replace({without_noise(f"regexp_replace(lower(label), {NON_WORD}, ' ', 'g')")}, {BLANKS}, ' ', 'g')")} AS base
  FROM labelled),
tokened AS (
  SELECT *,
    CASE WHEN regexp_matches(base, '\\p{{Han}}')
         THEN list_filter(regexp_extract_all(replace(base, ' ', ''), '(?s)..?'),
                          lambda p: NOT list_contains({STOP}, p))[1:5] ELSE []::VARCHAR[] END AS han,
    list_sort(list_filter(string_split(base, ' '),
              lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))[1:5] AS latin,
    list_sort(list_filter(list_transform(kw,
              lambda k: {trim(f"regexp_replace(lower(k), {NON_WORD}, '', 'g')")}),
              lambda k: k <> '')[1:3]) AS kws
  FROM based),
joined AS (SELECT *, list_concat(list_concat(han, latin), kws) AS tokens FROM tokened),
keyed AS (
  SELECT *, COALESCE(NULLIF(array_to_string({ordered_set('tokens')}, '::'), ''),
                     NULLIF(lower(regexp_replace({clean("array_to_string(kw, ' ')")}, {NON_WORD}, '', 'g')), ''),
                     NULLIF(left(replace(base, ' ', ''), 16), ''), 'uncategorized') AS cluster_key
  FROM joined),
clustered AS (
  SELECT *, CASE WHEN label = '' THEN replace(cluster_key, '::', ' / ') ELSE label END AS cluster_label
  FROM keyed)"""

CLUSTERED = f"{ANALYSED}, {CLUSTERING}"

EMBEDDING_TEXT = clean(
    "platform || chr(10) || channel || chr(10) || title || chr(10) || core_pain_point || chr(10) || "
    "current_workaround || chr(10) || saas_feasibility || chr(10) || content || chr(10) || "
    "array_to_string(kw, ' ')"
)

EVENTS = """scored AS (
  SELECT event_id AS id, event_type AS platform, event_type || '::' || (user_id % 10) AS cluster_key,
         event_type || ' ' || user_id AS title, 'event://' || event_id AS source_url, user_id,
         (floor(value)::BIGINT % 10 + 1)::INT AS commercial_potential,
         CASE WHEN user_id % 7 = 0 THEN TRUE WHEN user_id % 7 = 1 THEN FALSE END AS is_explicit_content,
         CASE WHEN event_id % 2 = 0 THEN ts END AS published_at, ts AS created_at
  FROM events),
visible AS (SELECT * FROM scored WHERE NOT COALESCE(is_explicit_content, FALSE))"""

ADMITTED = """seen AS (SELECT event_type AS platform, user_id::VARCHAR AS id, ts, min(event_id) AS event_id
  FROM events WHERE {where} GROUP BY ALL),
chain AS (
  SELECT platform, id, min(ts) AS ts FROM seen GROUP BY ALL
  UNION ALL
  SELECT c.platform, c.id, min(s.ts) AS ts FROM chain c JOIN seen s
    ON s.platform = c.platform AND s.id = c.id AND s.ts >= c.ts + INTERVAL 2 DAY
  GROUP BY ALL)"""

TTL = f"""WITH RECURSIVE {ADMITTED.format(where='TRUE')}
SELECT s.platform, s.id, s.ts AS seen_at, s.event_id FROM chain c JOIN seen s USING (platform, id, ts)"""

VECTORS = """vectors AS (SELECT vec_id AS id, label::VARCHAR AS cluster_key,
  COALESCE(label = 7, FALSE) AS hidden, embedding::DOUBLE[] AS v FROM embeddings)"""

SIMILARITY = "round(greatest(0, list_cosine_similarity(a.v, b.v)), 4)"


def nearest(target: int, where: str) -> str:
    return f"""WITH {VECTORS}
SELECT a.id, a.cluster_key, {SIMILARITY} AS similarity
FROM vectors a, (SELECT v FROM vectors WHERE id = {target}) b
WHERE NOT a.hidden AND {where}
ORDER BY list_cosine_similarity(a.v, b.v) DESC, a.id LIMIT {TOP}"""


def latest(columns_from: str, limit: int) -> str:
    return f"""WITH {EVENTS}
SELECT id, platform, platform AS channel, 'post' AS content_kind, cluster_key, '' AS cluster_label,
  id::VARCHAR AS source_post_id, title, source_url, '' AS author, '' AS raw_content,
  '' AS core_pain_point, '' AS current_workaround, commercial_potential, '' AS saas_feasibility,
  COALESCE(is_explicit_content, FALSE) AS is_explicit_content, '' AS matched_keywords,
  '' AS analysis_model, '' AS embedding_model, COALESCE(published_at, created_at) AS published_at, created_at
FROM {columns_from} ORDER BY created_at DESC, id DESC LIMIT {limit}"""


def trends(ctes: str, rows: str, limit: int) -> str:
    def sample(col: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list({col}) FILTER ({col} <> '')))[1:3], '|')"

    return f"""WITH {ctes}
SELECT cluster_key, COALESCE(max(NULLIF(cluster_label, '')), cluster_key) AS cluster_label,
  count(*) AS insight_count,
  {rounded_mean('sum(commercial_potential)', 'count(commercial_potential)')} AS average_score,
  COALESCE(max(commercial_potential), 0)::INT AS top_score, max(created_at) AS latest_seen_at,
  array_to_string(list_sort(list_distinct(list(platform))), '|') AS platforms,
  COALESCE({sample('title')}, '') AS sample_titles,
  COALESCE({sample('core_pain_point')}, '') AS sample_pain_points
FROM {rows} GROUP BY cluster_key
ORDER BY insight_count DESC, average_score DESC, latest_seen_at DESC, cluster_key LIMIT {limit}"""


def shaped(
    platform: str, channel: str, kind: str, content: str, id_: str = "id", url: str = "url",
    author: str = "''", searched: str | None = None,
) -> str:
    """Posts a parser should give for the documents, with the keywords found."""
    return f"""SELECT {id_} AS id, {platform} AS platform, {channel} AS channel, '{kind}' AS content_kind,
    {clean('title')} AS title, {url} AS url, {author} AS author, published_at, doc_id,
    {content} AS content, {hits(f"title || ' ' || {searched or content}")} AS found FROM posts"""


def post_rows(spec: dict[str, str]) -> str:
    return f"""WITH {POSTS}, shaped AS ({shaped(**spec)})
SELECT id, platform, channel, content_kind, title, url, author, published_at,
  {bar('found')} AS matched_keywords, md5(content) AS content_md5 FROM shaped WHERE {MATCHED}"""


MATCHED = "len(found) > 0"
FEED = "(doc_id // 25)"
#: Items of a feed that are read, of the kinds that have a limit.
FIRST_ITEMS = {"atom": "WHERE doc_id % 25 < 20", "transcript": "WHERE doc_id % 25 < 20"}
KINDS = ("forum", "listing", "atom", "transcript")
FRENCH_HASH = "sha1('{}::' || {} || '::' || url || '::' || title)"

FORUM_CONTENT = clean("CASE WHEN channel <> 'en' THEN '<b>Full</b> ' || content ELSE '<p>' || content || '</p>' END")
ATOM_CONTENT = clean("channel || ' ' || content")
TRANSCRIPT_CONTENT = clean("CASE WHEN channel <> 'en' THEN content ELSE '<i>c</i> ' || content END")
TRANSCRIPT_PLATFORM = f"CASE WHEN platform = 'src7' THEN '{fixed.TRANSCRIPT_PLATFORM}' ELSE platform END"
RAW_PLATFORM = "CASE WHEN platform = 'src7' THEN ' ' ELSE platform END"

PARSERS = {
    "parse_forum": dict(
        platform=lit(fixed.FORUM_PLATFORM), channel=f"'f' || ({FEED} % 7)", kind="post",
        content=FORUM_CONTENT, url=f"'https://www.dcard.tw/f/f' || ({FEED} % 7) || '/p/' || doc_id",
        author="CASE WHEN channel = 'fr' THEN '' ELSE platform END",
    ),
    "parse_listing": dict(
        platform=lit(fixed.LISTING_PLATFORM), channel=f"'r/sub' || ({FEED} % 5)", kind="post",
        content=clean("content"), url="'https://www.reddit.com/d/' || doc_id", author="platform",
        searched="content",
    ),
    "parse_atom": dict(
        platform=lit(fixed.ATOM_PLATFORM), channel=f"'Feed ' || {FEED}", kind="review",
        content=ATOM_CONTENT, author="platform",
        id_="CASE WHEN channel = 'fr' THEN "
        + FRENCH_HASH.format(fixed.ATOM_PLATFORM, f"'Feed ' || {FEED}") + " ELSE id END",
    ),
    "parse_transcripts": dict(
        platform=TRANSCRIPT_PLATFORM, channel="channel", kind="transcript", content=TRANSCRIPT_CONTENT,
        id_=f"CASE WHEN channel = 'fr' THEN sha1(({RAW_PLATFORM}) || '::' || channel || '::' || url "
        "|| '::' || title) ELSE id END",
    ),
}

TOKENS = f"""plain AS (
  SELECT doc_id, regexp_replace(lower({clean('text')}), {NON_WORD}, ' ', 'g') AS p FROM documents),
tokens AS (
  SELECT doc_id, unnest(list_distinct(list_concat(
    list_filter(regexp_split_to_array(p, {BLANKS}), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)),
    CASE WHEN regexp_matches(p, '\\p{{Han}}')
         THEN list_filter(regexp_extract_all(replace(p, ' ', ''), '(?s)..?'),
                          lambda w: NOT list_contains({STOP}, w))[1:5] ELSE []::VARCHAR[] END))) AS token
  FROM plain),
words AS (SELECT token FROM tokens UNION SELECT unnest(['license', 'of', 'data'])),
hashed AS (
  SELECT token, list_reduce(
    list_concat([14695981039346656037::UHUGEINT],
      list_transform(range(1, strlen(token) + 1), lambda i: ('0x' || substr(hex(token), (2 * i - 1)::INT, 2))::UHUGEINT)),
    lambda h, b: xor(h, b) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS h
  FROM words),
signed AS (SELECT token, (h % 256)::INT AS bucket, CASE WHEN (h // 2) % 2 = 0 THEN -1 ELSE 1 END AS s FROM hashed),
cells AS (
  SELECT doc_id, bucket, sum(s)::BIGINT AS n FROM tokens JOIN signed USING (token) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(n * n)::DOUBLE)::FLOAT AS norm FROM cells GROUP BY doc_id),
parts AS (
  SELECT doc_id, bucket, (n::FLOAT / norm)::FLOAT::DOUBLE AS x FROM cells JOIN norms USING (doc_id) WHERE n <> 0)"""

REPORT = f"""WITH RECURSIVE {ADMITTED.format(where="event_type <> 'error'")},
ok AS (SELECT platform, count(*) AS n FROM chain c JOIN seen s USING (platform, id, ts) GROUP BY ALL),
per AS (
  SELECT event_type AS source, count(*) FILTER (event_type <> 'error') AS fetched,
    COALESCE(any_value(ok.n), 0) AS enqueued, count(*) FILTER (event_type = 'error') AS errors,
    CASE WHEN event_type = 'error' THEN 'error: fetch failed' ELSE '' END AS error_reasons
  FROM events LEFT JOIN ok ON ok.platform = event_type GROUP BY event_type)
SELECT source, 1::BIGINT AS sources, fetched::BIGINT AS fetched, enqueued::BIGINT AS enqueued,
  (fetched - enqueued)::BIGINT AS skipped_duplicates, errors::BIGINT AS errors, 0::BIGINT AS cut_items, error_reasons FROM per
UNION ALL
SELECT '(total)', count(*), sum(fetched)::BIGINT, sum(enqueued)::BIGINT, sum(fetched - enqueued)::BIGINT,
  sum(errors)::BIGINT, 0::BIGINT, max(error_reasons) FROM per"""

UPSERTED = f"""WITH {EVENTS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY platform, user_id ORDER BY created_at DESC, id DESC) AS last,
    first_value(id) OVER w AS first_id, first_value(created_at) OVER w AS first_created
  FROM scored WINDOW w AS (PARTITION BY platform, user_id ORDER BY created_at, id))
SELECT platform, user_id::VARCHAR AS source_post_id, first_id AS id, commercial_potential,
  CASE WHEN commercial_potential > 2 THEN commercial_potential || '.0' END AS embedding,
  is_explicit_content, first_created AS created_at
FROM ranked WHERE last = 1"""

MODEL = f"""WITH answers AS (
  SELECT doc_id, source, lang, CASE WHEN lang = 'de' THEN '' ELSE text END AS pain,
    n_chars % 25 - 5 AS score,
    source NOT IN ('src1', 'src3') AND NOT (source = 'src2' AND (lang <> 'fr' OR contains(text, 'false'))) AS ok
  FROM documents)
SELECT doc_id, CASE WHEN ok THEN 'ok' ELSE 'rejected' END AS status,
  CASE WHEN ok THEN md5(CASE WHEN pain = '' THEN {lit(fixed.MODEL_PAIN_POINT)} ELSE pain END) END AS core_pain_point,
  CASE WHEN ok THEN {lit(fixed.MODEL_WORKAROUND)} END AS current_workaround,
  CASE WHEN ok THEN greatest(1, least(score, 10))::INT END AS commercial_potential,
  CASE WHEN ok THEN {lit(fixed.MODEL_FEASIBILITY)} END AS saas_feasibility,
  CASE WHEN ok THEN lang = 'fr' END AS is_explicit_content
FROM answers"""


def prompt() -> str:
    pieces = fixed.PROMPT_TEMPLATE.split("%s")
    fields = ["platform", "channel", "'post'", "title", "''", "url", "content"]
    text = lit(pieces[0])
    for field, piece in zip(fields, pieces[1:]):
        text += f" || {field} || {lit(piece)}"
    return text


SCORED = f"""WITH {POSTS}, prompts AS (SELECT doc_id, {prompt()} AS prompt FROM posts),
asked AS (SELECT *, NOT contains(prompt, 'worthless') AS ok FROM prompts)
SELECT doc_id, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status,
  CASE WHEN NOT ok THEN 'ValueError: worthless' END AS error,
  CASE WHEN ok THEN (length(prompt) % 10 + 1)::INT END AS commercial_potential,
  CASE WHEN ok THEN {lit(fixed.MODEL_PAIN_POINT)} END AS core_pain_point, 'stub' AS analysis_model FROM asked"""


def letters(letter: str) -> str:
    return f"(length(c) - length(replace(c, '{letter}', '')))::FLOAT"


STUB_VECTORS = f"""WITH cleaned AS (SELECT doc_id, {clean('text')} AS c FROM documents),
counted AS (
  SELECT doc_id, c = '' OR contains(c, 'worthless') AS failed, {letters('a')} AS a, {letters('e')} AS e,
    {letters('i')} AS i, {letters('z')} AS z FROM cleaned),
normed AS (
  SELECT *, sqrt((a * a)::DOUBLE + (e * e)::DOUBLE + (i * i)::DOUBLE + (z * z)::DOUBLE)::FLOAT AS n FROM counted)
SELECT doc_id, 'stub' AS embedding_model,
""" + ", ".join(
    f"CASE WHEN NOT failed THEN round(CASE WHEN n = 0 THEN {x} ELSE ({x} / n)::FLOAT END::DOUBLE, 6) END AS v{p}"
    for p, x in enumerate("aeiz")
) + " FROM normed"

NORMALIZED = """WITH longer AS (
  SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * label::DOUBLE)::FLOAT) AS v FROM embeddings),
normed AS (
  SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: (x * x)::FLOAT::DOUBLE)))::FLOAT::DOUBLE AS n FROM longer),
unit AS (
  SELECT vec_id, list_transform(v, lambda x: CASE WHEN n = 0 THEN x ELSE (x::DOUBLE / n)::FLOAT END::DOUBLE) AS u FROM normed)
SELECT vec_id, len(u) AS dims, len(list_filter(u, lambda x: x <> 0)) AS filled,
  round(list_sum(u), 6) AS total, round(list_sum(list_transform(u, lambda x, i: x * i)), 6) AS weighted FROM unit"""

BULK = f"""WITH {VECTORS},
pairs AS (
  SELECT b.id AS target_id, a.id, list_cosine_similarity(a.v, b.v) AS c
  FROM vectors a JOIN vectors b ON a.id <> b.id WHERE NOT a.hidden),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY c DESC, id) AS rank FROM pairs)
SELECT target_id, id, round(greatest(0, c), 4) AS similarity, rank FROM ranked WHERE rank <= 8"""

# The query text has three tokens that are no stop words.
SEARCH = f"""WITH {TOKENS},
query AS (SELECT bucket, sum(s)::DOUBLE AS n FROM signed WHERE token IN ('license', 'of', 'data') GROUP BY bucket),
dots AS (
  SELECT doc_id, sum(x * COALESCE(q.n, 0)) / sqrt(sum(x * x)) / sqrt((SELECT sum(n * n) FROM query)) AS c
  FROM parts LEFT JOIN query q USING (bucket) GROUP BY doc_id)
SELECT doc_id AS id, round(greatest(0, c), 4) AS similarity FROM dots ORDER BY round(c, 12) DESC, id LIMIT {TOP}"""

FEED_ROWS = f"""WITH {POSTS}, shaped AS ({' UNION ALL '.join(
    f"SELECT * FROM ({shaped(**spec)}) {FIRST_ITEMS.get(source, '')}" for source, spec in zip(KINDS, PARSERS.values()))}),
found AS (SELECT *, found AS kw FROM shaped WHERE {MATCHED}), {ANALYSIS}, {CLUSTERING}
SELECT platform, channel, content_kind, id AS source_post_id, cluster_key, core_pain_point,
  commercial_potential, is_explicit_content, {bar('kw')} AS matched_keywords,
  'mock-hash:256' AS embedding_model, 256::BIGINT AS dims, published_at,
  TIMESTAMP '2024-01-01' + to_minutes({FEED}) AS created_at FROM clustered"""

STATS_AT = "TIMESTAMP '2024-01-30'"

SQL: dict[str, str] = {
    "trend_clusters": trends(
        f"""{CLUSTERED}, stored AS (
  SELECT c.* EXCLUDE (is_explicit_content), published_at AS created_at FROM clustered c
  LEFT JOIN labels USING (doc_id)
  WHERE COALESCE(toxic, 0) <> 1 AND published_at >= TIMESTAMP '2024-01-01 01:00:00')""",
        "stored", 12,
    ),
    "event_trends": trends(
        f"""{EVENTS}, stored AS (
  SELECT *, NULL::VARCHAR AS cluster_label, source_url AS core_pain_point FROM visible
  WHERE created_at >= TIMESTAMP '2024-01-21')""",
        "stored", 200,
    ),
    "latest_insights": latest("visible", 50),
    "latest_with_explicit": latest("scored", 200),
    "insight_stats": f"""WITH {EVENTS}
SELECT count(*) AS total_insights, count(*) FILTER (created_at >= {STATS_AT} - INTERVAL 24 HOUR) AS live_last_24h,
  {rounded_mean('sum(commercial_potential)', 'count(commercial_potential)')} AS average_potential,
  COALESCE((SELECT platform FROM visible GROUP BY platform ORDER BY count(*) DESC, platform LIMIT 1), '') AS top_platform
FROM visible""",
    "top_platform": f"""WITH {EVENTS} SELECT platform, count(*) AS insights FROM visible
GROUP BY platform ORDER BY 2 DESC, 1 LIMIT 1""",
    "live_feed": f"""WITH {EVENTS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY title ORDER BY created_at DESC, id DESC) AS r FROM scored)
SELECT title AS key, id, commercial_potential, created_at FROM ranked WHERE r = 1
ORDER BY created_at DESC, id DESC LIMIT 60""",
    "running_stats": f"""WITH {EVENTS}
SELECT id, created_at, count(*) OVER w AS total_insights,
  count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS live_last_24h,
  {rounded_mean('sum(commercial_potential) OVER w', 'count(commercial_potential) OVER w')} AS average_potential
FROM visible WINDOW w AS (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)""",
    "clean_pages": f"SELECT page_id, {clean('html')} AS html FROM pages",
    "parse_times": """WITH w AS (
  SELECT event_id, event_type, ts, CASE event_type
    WHEN 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+02:00')
    WHEN 'error' THEN strftime(ts, 'Mon, %d %b %Y %H:%M:%S -0330')
    WHEN 'click' THEN strftime(ts, '%d %b %y %H:%M EST')
    WHEN 'purchase' THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    ELSE strftime(ts, '%Y-%m-%d?') END AS written FROM events)
SELECT event_id, written, CASE event_type
    WHEN 'view' THEN ts - INTERVAL 2 HOUR
    WHEN 'error' THEN date_trunc('second', ts) + INTERVAL 210 MINUTE
    WHEN 'click' THEN date_trunc('minute', ts)
    WHEN 'purchase' THEN date_trunc('second', ts)
    ELSE TIMESTAMP '2024-01-31' END AS read_at FROM w""",
    "assign_post_id": f"""WITH {POSTS} SELECT url, CASE WHEN channel = 'en' THEN id
  ELSE sha1(platform || '::' || channel || '::' || url || '::' || title) END AS id FROM posts""",
    "match_keywords": f"""WITH {POSTS}, k AS (SELECT doc_id, {hits("title || ' ' || content")} AS found FROM posts)
SELECT doc_id, {bar('found')} AS matched_keywords FROM k WHERE {MATCHED}""",
    "first_sentences": f"""WITH c AS (SELECT doc_id, {clean('text')} AS body FROM documents)
SELECT doc_id, {first_sentence('body')} AS sentence FROM c""",
    **{name: post_rows(spec) for name, spec in PARSERS.items()},
    "conversation_transcripts": f"""WITH t AS (
  SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS id, '{fixed.TRANSCRIPT_PLATFORM}' AS platform, '' AS channel,
  'transcript' AS content_kind, '' AS title, '' AS url, '' AS author,
  TIMESTAMP '2024-01-31' AS published_at, '' AS matched_keywords, md5({clean('body')}) AS content_md5 FROM t""",
    "union_sources": "WITH " + POSTS + ", every AS (" + " UNION ALL ".join(
        f"SELECT '{source}' AS source, * FROM ({shaped(**spec)}) {FIRST_ITEMS.get(source, '')}"
        for source, spec in zip(KINDS, PARSERS.values())
    ) + """) SELECT source, platform, content_kind, count(*) AS posts,
  sum(length(content))::BIGINT AS content_chars, sum(length(title))::BIGINT AS title_chars FROM every GROUP BY ALL""",
    "feed_rejects": f"""SELECT 'sub1' AS feed, 'malformed payload' AS error, count(DISTINCT {FEED}) AS payloads
FROM documents WHERE {FEED} % 5 = 1 HAVING count(*) > 0""",
    "limit_per_feed": """SELECT source AS platform, lang AS channel, doc_id FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 20""",
    "queue_roundtrip": f"""WITH {POSTS} SELECT id, platform, channel, 'post' AS content_kind, title, url,
  '' AS author, published_at, {bar(hits("title || ' ' || content"))} AS matched_keywords,
  md5(content) AS content_md5 FROM posts""",
    "analyze_heuristic": f"""WITH {ANALYSED} SELECT doc_id, core_pain_point, current_workaround,
  commercial_potential, saas_feasibility, is_explicit_content, analysis_model FROM analysed""",
    "build_prompts": f"""WITH {POSTS}, p AS (SELECT doc_id, {prompt()} AS prompt FROM posts)
SELECT doc_id, md5(prompt) AS prompt_md5, length(prompt) AS prompt_chars FROM p""",
    "parse_model_output": MODEL,
    "score_with_model": SCORED,
    "assign_clusters": f"WITH {CLUSTERED} SELECT doc_id, cluster_key, cluster_label FROM clustered",
    "cluster_sizes": f"WITH {CLUSTERED} SELECT cluster_key, count(*) AS cluster_size FROM clustered GROUP BY 1",
    "embedding_text": f"""WITH {ANALYSED}, t AS (SELECT doc_id, {EMBEDDING_TEXT} AS x FROM analysed)
SELECT doc_id, md5(x) AS text_md5, length(x) AS text_chars FROM t""",
    "hash_embed": f"""WITH {TOKENS}, sums AS (
  SELECT doc_id, count(*) AS filled, round(sum(x), 6) AS total, round(sum(x * (bucket + 1)), 6) AS weighted
  FROM parts GROUP BY doc_id)
SELECT doc_id, 256::BIGINT AS dims, COALESCE(filled, 0) AS filled, COALESCE(total, 0) AS total,
  COALESCE(weighted, 0) AS weighted FROM documents LEFT JOIN sums USING (doc_id)""",
    "embed_with_model": STUB_VECTORS,
    "l2_normalize": NORMALIZED,
    "semantic_search": nearest(1, "TRUE"),
    "similar_insights": nearest(2, "a.id <> 2"),
    "similar_bulk": BULK,
    "search_text": SEARCH,
    "run_feed": FEED_ROWS,
    "dedup_ttl": TTL,
    "dedup_stream": TTL,
    "dedup_corrected": TTL,
    "upsert_latest": UPSERTED,
    "stream_upsert": UPSERTED,
    "ingestion_report": REPORT,
    "live_insights": f"""WITH u AS ({UPSERTED}) SELECT platform, source_post_id, commercial_potential, created_at AS published_at, created_at
FROM u WHERE NOT COALESCE(is_explicit_content, FALSE)""",
    "running_stats_stream": f"""WITH u AS ({UPSERTED}), v AS (SELECT * FROM u WHERE NOT COALESCE(is_explicit_content, FALSE))
SELECT count(*) AS total_insights, count(*) FILTER (created_at >= {STATS_AT} - INTERVAL 24 HOUR) AS live_last_24h,
  {rounded_mean('sum(commercial_potential)', 'count(commercial_potential)')} AS average_potential FROM v""",
    "live_trends": trends(
        f"""u AS ({UPSERTED}), stored AS (
  SELECT platform, commercial_potential, created_at, 'k::' || (commercial_potential % 4) AS cluster_key, '' AS cluster_label,
    platform || ' ' || source_post_id AS title, 'pain ' || commercial_potential AS core_pain_point
  FROM u WHERE NOT COALESCE(is_explicit_content, FALSE) AND created_at >= TIMESTAMP '2024-01-02 12:34:56')""",
        "stored", 12,
    ),
    "ageing_stats": f"""WITH u AS ({UPSERTED}), v AS (SELECT * FROM u WHERE NOT COALESCE(is_explicit_content, FALSE)),
t AS (SELECT TIMESTAMP '2024-01-31' + to_hours(h) + to_seconds(1234) AS as_of FROM (VALUES (-350), (0), (5), (10), (15), (20), (25), (30)) AS x(h))
SELECT as_of, count(*) AS total_insights, count(*) FILTER (created_at >= as_of - INTERVAL 24 HOUR) AS live_last_24h,
  {rounded_mean('sum(commercial_potential)', 'count(commercial_potential)')} AS average_potential FROM t, v GROUP BY as_of""",
}

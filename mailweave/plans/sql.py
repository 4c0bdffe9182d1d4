"""DuckDB SQL of the queries, written without the operators they check."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"
_SP = r"[ \t\n\r\f\v]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_SP}+', ''), '{_SP}+$', '')"


def _lines(x: str) -> str:
    return rf"string_split(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), chr(10))"


_SUBJECT = _strip(rf"regexp_replace(lower(regexp_replace(coalesce(subject, ''), '(?i)^{_SP}*((re|fw|fwd){_SP}*:{_SP}*)+', '')), '{_SP}+', ' ', 'g')")

_TURNS = "turns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY logged_at, user_text) AS n1 FROM trace_turns) WHERE n1 = 1)"
_EPOCHS = f"""{_TURNS}, switched AS (SELECT *, CASE WHEN lag(thread_id) OVER w <> thread_id THEN 1 ELSE 0 END AS s FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY logged_at, trace_id)),
epochs AS (SELECT *, CAST(sum(s) OVER (PARTITION BY session_id ORDER BY logged_at, trace_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM switched)"""
_INDEX = f"""words AS (SELECT doc_id, thread_id, unnest({_WORDS.format("chunk_text")}) AS term FROM ingest),
lengths AS (SELECT doc_id, len({_WORDS.format("chunk_text")}) AS dl FROM ingest),
postings AS (SELECT doc_id, thread_id, term, count(*) AS tf FROM words GROUP BY ALL),
terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
corpus AS (SELECT count(*) AS docs, avg(dl) AS al FROM lengths)"""
_SCORE = "round(sum(q.times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / al))), 4)"


def _scored(asked: str, scoped: bool) -> str:
    on = "p.term = q.term AND p.thread_id = q.thread_id" if scoped else "p.term = q.term"
    return f"""{_INDEX}, asked AS ({asked}),
q AS (SELECT query_id, thread_id, term, count(*) AS times FROM (SELECT query_id, thread_id, unnest({_WORDS.format("text")}) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT q.query_id, p.doc_id, {_SCORE} AS score FROM postings p JOIN q ON {on} JOIN terms t ON t.term = p.term JOIN lengths l ON l.doc_id = p.doc_id, corpus GROUP BY ALL HAVING {_SCORE} > 0),
signed AS (SELECT s.*, i.row_idx, i.message_id, lower({_strip("substr(coalesce(i.chunk_text, ''), 1, 180)")}) AS sig FROM scored s JOIN ingest i USING (doc_id)),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, message_id, sig ORDER BY row_idx, doc_id) AS n1 FROM signed) WHERE n1 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_idx, doc_id) AS rank FROM once)"""


_BY_TRACE = "SELECT trace_id AS query_id, thread_id, user_text AS text FROM turns"
_LISTED = """listed AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY coalesce(date_text, ''), coalesce(message_id, ''), doc_id) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY thread_id, message_id ORDER BY coalesce(date_text, ''), coalesce(message_id, ''), doc_id) AS n1 FROM ingest) WHERE n1 = 1)"""


def _flat(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[\r\n]+', ' ', 'g')"


def _joined(x: str) -> str:
    return f"array_to_string(coalesce({x}, []), ', ')"


def _squeezed(x: str) -> str:
    return _strip(f"regexp_replace(coalesce({x}, ''), '{_SP}+', ' ', 'g')")


def _entries(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, ','), lambda x: {_strip('x')}), lambda x: x <> '')"


_ZONES = "MAP {'UT': 0, 'UTC': 0, 'GMT': 0, 'Z': 0, 'AST': -240, 'ADT': -180, 'EST': -300, 'EDT': -240, 'CST': -360, 'CDT': -300, 'MST': -420, 'MDT': -360, 'PST': -480, 'PDT': -420}"
_D1 = r"'^(?:[A-Za-z]+,? )?(\d{1,2}) ([A-Za-z]{3,9}) (\d{2,4}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?: (\S+))?(?: .*)?$'"
_D2 = r"'^[A-Z][a-z]{2} ([A-Za-z]{3,9}) (\d{1,2}) (\d{1,2}):(\d{2}):(\d{2})(?: ([A-Za-z]+))? (\d{4})$'"
_D3 = r"'^[A-Za-z]+, ([A-Za-z]{3,9}) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2})(?: (\S+))?(?: .*)?$'"
# a mail header's date: y|month|d|h|m|s|zone of the notations that mail parsers read, and texts in ISO form
_DATES = rf"""d0 AS (SELECT row_idx, date_text AS x, trim(regexp_replace(coalesce(date_text, ''), '\s+', ' ', 'g')) AS t FROM email_structure),
d1 AS (SELECT *, string_split(CASE WHEN regexp_matches(t, {_D1}) THEN regexp_replace(t, {_D1}, '\3|\2|\1|\4|\5|\6|\7') WHEN regexp_matches(t, {_D2}) THEN regexp_replace(t, {_D2}, '\7|\1|\2|\3|\4|\5|\6') WHEN regexp_matches(t, {_D3}) THEN regexp_replace(t, {_D3}, '\3|\1|\2|\4|\5||\6') END, '|') AS p FROM d0),
d2 AS (SELECT *, try_strptime(CASE WHEN length(p[1]) > 2 THEN p[1] WHEN p[1]::INT > 68 THEN '19' || p[1] ELSE '20' || p[1] END || '-' || list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(substr(p[2], 1, 3))) || '-' || p[3] || ' ' || p[4] || ':' || p[5] || ':' || coalesce(nullif(p[6], ''), '0'), '%Y-%m-%d %H:%M:%S') AS rfc,
CASE WHEN regexp_matches(p[7], '^[+-]\d{{4}}$') AND p[7] <> '-0000' THEN (substr(p[7], 1, 1) || '1')::INT * (substr(p[7], 2, 2)::INT * 60 + substr(p[7], 4, 2)::INT) ELSE {_ZONES}[upper(p[7])] END AS z FROM d1),
dates AS (SELECT row_idx, rfc, strftime(rfc, '%Y-%m-%dT%H:%M:%S') || CASE WHEN z IS NULL THEN '' ELSE printf('%s%02d:%02d', CASE WHEN z < 0 THEN '-' ELSE '+' END, abs(z) // 60, abs(z) % 60) END AS iso,
coalesce(rfc, CASE WHEN regexp_matches(x, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?(Z|[+-]\d{{2}}:?\d{{2}})?$') THEN try_strptime(substr(x, 1, 10) || ' ' || substr(x, 12, 8), '%Y-%m-%d %H:%M:%S') + to_microseconds(coalesce(nullif(rpad(regexp_extract(x, '\.(\d+)', 1), 6, '0'), '000000'), '0')::BIGINT) END) AS wall FROM d2)"""
_RAW = rf"""raw AS (SELECT row_idx, source_file, message_id, {_squeezed("subject")} AS subject, {_strip(_flat("date_text"))} AS date_text, {_strip(_flat("sender"))} AS sender, {_strip(_flat("in_reply_to"))} AS in_reply_to,
{_joined("recipients")} AS recipients, {_joined("cc")} AS cc, {_joined("ref_ids")} AS ref_ids, coalesce(body, '') AS body, CASE WHEN len(cc) > 0 THEN chr(10) || chr(10) || 'Content-Disposition: Attachment; FileName=notes.txt' ELSE '' END AS part,
concat_ws(chr(10), 'Message-ID: ' || {_flat("message_id")}, 'Subject: ' || replace({_squeezed("subject")}, ' ', chr(10) || ' '), 'Date: ' || {_flat("date_text")}, 'From: ' || {_flat("sender")}, 'To: ' || {_joined("recipients")}, 'Cc: ' || {_joined("cc")}, 'In-Reply-To: ' || {_flat("in_reply_to")}, 'References: ' || {_joined("ref_ids")}, 'Content-Transfer-Encoding: ' || CASE WHEN row_idx % 3 = 0 THEN 'quoted-printable' ELSE '8bit' END)
|| chr(10) || chr(10) || CASE WHEN row_idx % 3 = 0 THEN replace(replace(coalesce(body, ''), '=', '=3D'), 'é', '=C3=A9') ELSE coalesce(body, '') END || CASE WHEN len(cc) > 0 THEN chr(10) || chr(10) || 'Content-Disposition: Attachment; FileName=notes.txt' ELSE '' END AS message FROM email_structure)"""
_SLICE = rf"""{_DATES}, {_RAW}, rows1 AS (SELECT row_idx, nullif({_SUBJECT}, '') AS subject, rfc AS moment, contains(lower(message), 'content-disposition: attachment') OR contains(lower(message), 'filename=') OR contains(lower(message), 'name=') AS flagged, octet_length(encode(message)) AS size FROM raw JOIN dates USING (row_idx)),
rows2 AS (SELECT *, year(moment) * 12 + month(moment) - 1 AS month FROM rows1 WHERE subject IS NOT NULL AND moment IS NOT NULL)"""
_WINDOWS = f"""{_SLICE}, per_subject AS (SELECT month, subject, count(*) AS n, count(*) FILTER (flagged) AS f FROM rows2 GROUP BY ALL),
months AS (SELECT month, sum(n) AS n, sum(f) AS f FROM per_subject GROUP BY month),
cover AS (SELECT m.month AS start, s.span, unnest(range(m.month, m.month + s.span)) AS month FROM months m, (SELECT unnest([3, 4, 5, 6]) AS span) s),
totals AS (SELECT start, span, sum(n) AS messages, sum(f) AS flagged FROM cover JOIN months USING (month) GROUP BY start, span HAVING count(*) = span),
viable AS (SELECT start, span, count(*) FILTER (n >= 3) AS viable FROM (SELECT start, span, subject, sum(n) AS n FROM cover JOIN per_subject USING (month) GROUP BY ALL) GROUP BY ALL),
scores AS (SELECT start, span, CAST(messages AS BIGINT) AS messages, CAST(flagged AS BIGINT) AS flagged, viable, CAST(viable * 1000 - abs(messages - 200) - 2 * abs(flagged - 35) - 25 * abs(span - 4) AS BIGINT) AS score FROM totals JOIN viable USING (start, span)),
best AS (SELECT *, start + span - 1 AS last FROM scores ORDER BY score DESC, start, span LIMIT 1)"""
_RANKS = f"""{_WINDOWS}, stats AS (SELECT subject, count(*) AS messages, count(*) FILTER (flagged) AS flagged, min(row_idx) AS first_row FROM (SELECT r.* FROM rows2 r, best b WHERE r.month BETWEEN b.start AND b.last) GROUP BY subject),
ranks AS (SELECT *, row_number() OVER (ORDER BY flagged > 0 DESC, flagged DESC, messages DESC, first_row) AS rank FROM stats)"""
_CHOSEN = f"""{_RANKS}, fold(rank, k, n, f, took, over) AS (SELECT CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, FALSE UNION ALL
SELECT rank, k + t, n + CASE WHEN t = 1 THEN messages ELSE 0 END, f + CASE WHEN t = 1 THEN flagged ELSE 0 END, t = 1, over OR (k + t >= 10 AND n + CASE WHEN t = 1 THEN messages ELSE 0 END BETWEEN 100 AND 300 AND f + CASE WHEN t = 1 THEN flagged ELSE 0 END BETWEEN 20 AND 50)
FROM (SELECT r.rank, fold.k, fold.n, fold.f, fold.over, r.messages, r.flagged, CASE WHEN NOT fold.over AND fold.k < 20 AND (fold.k < 10 OR fold.n + r.messages <= 300) THEN 1 ELSE 0 END AS t FROM fold JOIN ranks r ON r.rank = fold.rank + 1)),
chosen AS (SELECT subject FROM ranks JOIN fold USING (rank) WHERE took),
capped AS (SELECT * FROM (SELECT *, sum(size) OVER (ORDER BY row_idx) AS running FROM (SELECT r.* FROM rows2 r, best b WHERE r.month BETWEEN b.start AND b.last AND r.subject IN (SELECT subject FROM chosen) ORDER BY row_idx LIMIT 300)) WHERE running <= 104857600)"""
_HEAD = "'(?i)^(from|sent|to|cc|subject|date)[ \\t\\n\\r\\f\\v]*:'"
_CUT = "'(?i)^(this e-mail and any attachment|the information contained in this email|this message may contain confidential|if you are not the intended recipient|legal stuff|this story appeared on|here is the story we were requested to send you|the information contained in this newsletter|attachment part|content-disposition:[ \\t]*attachment|[-_]{10,}$)'"
_NEWS = "'(?i)^(welcome new hires|transfers to|nuggets & notes|in the news)'"

def _cleaned(x: str) -> str:
    """SQL of a sentence without bylines, datelines and legal tails."""
    x = f"replace({x}, '>', ' ')"
    for pattern, to in [(r"(?i)\(MORE\)", " "), (rf"(?i){_SP}*Dow Jones Newswires{_SP}*\d{{1,2}}-\d{{1,2}}-\d{{2}}{_SP}*\d{{3,4}}GMT.*", ""), (r"\bBy\s+[A-Z][A-Z\s.\-'']+\b(?:\s+Of\s+[A-Z][A-Z\s.\-'']+)?", ""), (r"\bOf\s+DOW JONES NEWSWIRES\b.*", ""), (r"(?i)\bLEGAL STUFF\b.*", ""), (r"(?i)\bThis story appeared on\b.*", "")]:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    x = f"regexp_replace({_strip(x)}, '^[A-Z\\s]+\\(Dow Jones\\)--', '')"
    x = f"regexp_replace({_strip(x)}, '^[A-Z][A-Za-z\\s]+--', '')"
    return _strip(f"regexp_replace({x}, '{_SP}+', ' ', 'g')")


_VALUES = """list_concat(regexp_extract_all(c, '(?i)(?:\\$|USD\\s*)\\s*\\d[\\d,]*(?:\\.\\d+)?(?:/[A-Za-z]+)?'), regexp_extract_all(c, '\\b\\d+(?:\\.\\d+)?\\s*/\\s*[A-Za-z]+\\b'))"""
_LINES = rf"""list_filter(list_transform(string_split(regexp_replace(coalesce(chunk_text, ''), '\r\n?', chr(10), 'g'), chr(10)), lambda x: {_strip("x")}), lambda x: x <> '')"""
_SENTENCES = rf"""string_split(regexp_replace({{0}}, '([.!?]){_SP}+', '\1' || chr(1), 'g'), chr(1))"""



def _route(t: str) -> str:
    """SQL of the intent of a lower-case question."""
    return rf"""CASE WHEN regexp_matches({t}, '\b(timeline|chronology|chronological|who said what|when did)\b') THEN 'timeline' WHEN regexp_matches({t}, '\b(who is involved|who all are involved|who is talking|participants|people involved|who sent)\b') THEN 'people'
WHEN regexp_matches({t}, '\b(decision|proposal|request|asked|asking|what.*discussed|what.*proposal|what.*request)\b') THEN 'decision' WHEN regexp_matches({t}, '\bwhy\b') THEN 'why' WHEN regexp_matches({t}, '\bwhat meeting|which meeting|meeting referred to|meeting mentioned\b') THEN 'meeting'
WHEN regexp_matches({t}, '\b(where|location|connected to)\b') THEN 'location' WHEN regexp_matches({t}, '\b(amount|price|cost|value|cap|rate|how much)\b') THEN 'value' WHEN regexp_matches({t}, '\b(when|date|sent|approved on)\b') THEN 'date'
WHEN regexp_matches({t}, '\b(summary|summarize|what is this about|what does it talk about|mainly about|overview)\b') THEN 'summary' ELSE 'default' END"""


_NO_ITEMS = "'I could not find enough evidence in the active thread. What email, person, or subject should I focus on?'"
_UNKNOWN = "'I found relevant messages in the active thread, but I do not have enough clear evidence to answer directly. Please narrow the question slightly.'"


def _items(hits: str) -> str:
    """SQL of the distinct items of ranked hits (query_id, rank, score, doc_id)."""
    return f"""hits AS ({hits}), sig AS (SELECT h.query_id, h.rank, h.score, i.*, row_number() OVER (PARTITION BY h.query_id, lower({_strip("coalesce(subject, '')")}), lower({_strip("substr(coalesce(chunk_text, ''), 1, 280)")}) ORDER BY h.rank) AS m FROM hits h JOIN ingest i USING (doc_id)),
items AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place, '[msg: ' || coalesce(message_id, '') || coalesce(', page: ' || page_no, '') || ']' AS cite, concat_ws('/', chunk_type, message_id, page_no) AS src,
concat_ws('/', doc_id, thread_id, message_id, page_no, filename, chunk_type, CAST(score AS DOUBLE), subject, date_text, md5(substr(coalesce(chunk_text, ''), 1, 280))) AS slim FROM sig WHERE m = 1 QUALIFY place <= 5)"""


def _normal(x: str) -> str:
    """SQL of a sentence as an answer shows it."""
    x = _cleaned(x)
    for pattern in [rf"(?i)^(to|cc|subject|importance):{_SP}+.*$", rf"(?i)^(here you go|good afternoon)[ \t\n\r\f\v\-:]*", rf"(?i)^(the following message was attached:{_SP}*)"]:
        x = f"regexp_replace({x}, '{pattern}', '')"
    return f"regexp_replace(regexp_replace({_squeezed(x)}, '^[ \\-:]+', ''), '[ \\-:]+$', '')"


def _answered(asked: str, hits: str) -> str:
    """SQL of the answers to ``asked`` (query_id, text, evidence) from ranked hits."""
    first_low = "lower(substr({0}, 1, 1)) || substr({0}, 2)"
    words = rf"len(regexp_extract_all({{0}}, '[^ \t\n\r\f\v]+'))"
    return rf"""{_items(hits)}, routed AS (SELECT *, {_route("lower(coalesce(text, ''))")} AS intent FROM ({asked})),
used AS (SELECT query_id, string_agg(slim, ' ' ORDER BY place) FILTER (place <= 3) AS used, string_agg(cite, ' ' ORDER BY place) FILTER (place <= 3) AS cites FROM items GROUP BY query_id),
persons AS (SELECT query_id, place, unnest(xs) AS person, unnest(range(len(xs))) AS pos FROM (SELECT query_id, place, list_concat(list_concat([sender], coalesce(recipients, [])), coalesce(cc, [])) AS xs FROM items)),
person_once AS (SELECT * FROM persons WHERE trim(person) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, lower({_strip("person")}) ORDER BY place, pos) = 1),
people AS (SELECT query_id, string_agg(person, ', ' ORDER BY k) AS people FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, pos) AS k FROM person_once) WHERE k <= 8 GROUP BY query_id),
named AS (SELECT query_id, string_agg(src, ' ' ORDER BY place) AS srcs FROM items WHERE len(list_filter(list_concat(list_concat([sender], coalesce(recipients, [])), coalesce(cc, [])), lambda x: x <> '')) > 0 GROUP BY query_id),
told AS (SELECT query_id, place, src, coalesce(date_text, '') AS d, coalesce(message_id, '') AS m, {_strip("coalesce(nullif(date_text, ''), 'Unknown date') || ': ' || coalesce(nullif(sender, ''), 'Unknown sender') || ' re ' || coalesce(nullif(subject, ''), 'No subject') || ' ' || cite")} AS l FROM items),
told_once AS (SELECT query_id, l, min((d, m, place)) AS o FROM told GROUP BY query_id, l),
content AS (SELECT query_id, place, cite, src, list_filter(list_transform({_SENTENCES.format("body")}, lambda x: {_cleaned("x")}), lambda x: {words.format("x")} > 8 AND NOT regexp_matches(x, '(?i)^By\s+[A-Z][A-Za-z\s.\-'']+(?:\s+Of\s+[A-Z][A-Za-z\s.\-'']+)?$') AND NOT regexp_matches(x, '(?i)^(?:if there was an inch|more|final order|legal stuff)')) AS s
FROM (SELECT *, CASE WHEN len(lines) > 3 THEN array_to_string(lines[4:], chr(10)) ELSE coalesce(chunk_text, '') END AS body FROM (SELECT *, {_LINES} AS lines FROM items))),
leads AS (SELECT query_id, place, cite, src, {_normal("s[1]")} AS lead FROM content),
requests AS (SELECT query_id, place, cite, src, list_filter(list_transform(list_filter(s, lambda x: regexp_matches(x, '(?i)approved|decided|proposed|requested|please forward|is invited|meeting|pre-meeting|ask|approval')), lambda x: {_normal("x")}), lambda x: NOT contains(lower(x), 'forwarded by'))[1] AS request FROM content),
request AS (SELECT query_id, arg_min(struct_pack(r := request, c := cite, s := src), place) AS q FROM requests WHERE place <= 3 AND request <> '' GROUP BY query_id),
topics AS (SELECT query_id, cite, src, CASE WHEN t <> '' THEN 'This thread is mainly about ' || {first_low.format("t")} || '.' END AS topic FROM (SELECT *, {_normal(_strip("coalesce(subject, '')"))} AS t FROM items WHERE place = 1)),
values_of AS (SELECT query_id, place, src, CASE WHEN rated THEN coalesce(list_filter(v, lambda x: contains(x, '/') OR contains(lower(x), 'mwh'))[1], v[1]) ELSE v[1] END AS v FROM (SELECT query_id, place, src, rated, {_VALUES} AS v FROM (SELECT query_id, place, src, regexp_matches(lower(coalesce(text, '')), 'price|cap|rate') AS rated, {_cleaned("coalesce(chunk_text, '')")} AS c FROM items JOIN routed USING (query_id) WHERE intent = 'value'))),
value_of AS (SELECT query_id, arg_min(v, place) AS v, arg_min(src, place) AS src FROM values_of WHERE v <> '' GROUP BY query_id),
point AS (SELECT query_id, place, src, lead FROM leads WHERE place <= 3 AND {words.format("lead")} > 6),
points AS (SELECT query_id, list(lead ORDER BY p) AS p FROM (SELECT query_id, lead, min(place) AS p FROM point GROUP BY ALL) GROUP BY query_id), pointed AS (SELECT query_id, string_agg(src, ' ' ORDER BY place) AS srcs FROM point GROUP BY query_id),
scored_s AS (SELECT query_id, place, cite, src, s[k] AS x, k, len(list_intersect({_WORDS.format("evidence")}, {_WORDS.format("s[k]")})) AS o FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM (SELECT i.query_id, place, cite, src, evidence, list_filter(list_transform({_SENTENCES.format("coalesce(chunk_text, '')")}, lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM items i JOIN routed USING (query_id) WHERE place <= 3 AND intent = 'default'))),
bests AS (SELECT query_id, place, cite, src, {_cleaned("string_agg(x, ' ' ORDER BY n)")} AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id, place ORDER BY o DESC, k) AS n FROM scored_s) WHERE n <= 2 GROUP BY query_id, place, cite, src),
best AS (SELECT * FROM bests WHERE {words.format("best")} >= 5), grounded AS (SELECT query_id, string_agg(t, ' ' ORDER BY p) AS t FROM (SELECT query_id, best || ' ' || string_agg(cite, ' ' ORDER BY place) AS t, min(place) AS p FROM best GROUP BY query_id, best) GROUP BY query_id), grounds AS (SELECT query_id, string_agg(src, ' ' ORDER BY place) AS srcs FROM best GROUP BY query_id),
built AS (SELECT query_id, 'timeline' AS intent, CASE WHEN n = 1 THEN 'This thread has one indexed message. ' ELSE '' END || l AS answer, srcs AS citations FROM (SELECT query_id, string_agg(l, chr(10) ORDER BY o) AS l FROM told_once GROUP BY query_id) JOIN (SELECT query_id, count(*) AS n, string_agg(src, ' ' ORDER BY d, m, place) AS srcs FROM told GROUP BY query_id) USING (query_id)
UNION ALL SELECT query_id, 'people', 'The conversation involves: ' || people || '. ' || cites, srcs FROM people JOIN used USING (query_id) JOIN named USING (query_id)
UNION ALL SELECT query_id, 'decision', coalesce('The main request or proposal is: ' || q.r || ' ' || q.c, 'I do not see a formal decision in this thread. It mainly shares information: ' || topic || ' ' || cite), coalesce(q.s, src) FROM topics LEFT JOIN request USING (query_id)
UNION ALL SELECT query_id, 'why', 'The email was forwarded to share this information more widely: ' || nullif(lead, '') || ' ' || cite, src FROM leads WHERE place = 1
UNION ALL SELECT query_id, 'meeting', 'The thread refers to a meeting scheduled for ' || nullif(regexp_extract(coalesce(chunk_text, ''), '(?i)\b(?:meeting|luncheon meeting).{{0,60}}?(Monday,\s+[A-Za-z]+\s+\d{{1,2}})', 1), '') || '. ' || cite, src FROM items WHERE place = 1
UNION ALL SELECT query_id, 'location', 'The meeting is connected to the law offices of ' || {_strip(r"nullif(regexp_extract(coalesce(chunk_text, ''), '(?i)\blaw offices?\s+of\s+([^.,]+)', 1), '')")} || '. ' || cite, src FROM items WHERE place = 1
UNION ALL SELECT query_id, 'value', 'The key value mentioned is ' || v || '. ' || cites, src FROM value_of JOIN used USING (query_id)
UNION ALL SELECT query_id, 'date', 'The message was sent on ' || coalesce(date_text, 'an unknown date') || '. ' || cite, src FROM (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(date_text, '')) = 0, place) = 1)
UNION ALL SELECT query_id, 'summary', coalesce(topic || ' ' || cite, 'This thread is about ' || {first_low.format("p[1]")} || CASE WHEN contains(lower(p[1]), lower(p[2])) OR contains(lower(p[2]), lower(p[1])) OR p[2] IS NULL THEN '' ELSE ' ' || p[2] END || ' ' || cites), CASE WHEN topic IS NULL THEN srcs ELSE src END FROM topics JOIN used USING (query_id) LEFT JOIN points USING (query_id) LEFT JOIN pointed USING (query_id)
UNION ALL SELECT query_id, 'default', t, srcs FROM grounded JOIN grounds USING (query_id)),
shown AS (SELECT r.query_id, r.intent, u.query_id IS NULL AS empty, nullif({_strip("answer")}, '') AS t, citations, used FROM routed r LEFT JOIN used u USING (query_id) LEFT JOIN built b ON b.query_id = r.query_id AND b.intent = r.intent)
SELECT query_id, intent, CASE WHEN empty THEN {_NO_ITEMS} ELSE coalesce(t, {_UNKNOWN}) END AS answer, CASE WHEN t IS NULL THEN '' ELSE coalesce(citations, '') END AS citations, CASE WHEN t IS NULL THEN '' ELSE used END AS used_items FROM shown"""


SQL: dict[str, str] = {
    "bm25_topk_partition": f"WITH {_TURNS}, {_scored(_BY_TRACE, True)} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 5",
    "bm25_topk_global": f"WITH {_scored('SELECT DISTINCT user_text AS query_id, NULL::VARCHAR AS thread_id, user_text AS text FROM trace_turns WHERE length(user_text) > 0', False)} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 5",
    "bm25_repeated_terms": f"WITH {_TURNS}, {_scored('SELECT trace_id AS query_id, thread_id, concat_ws(chr(32), user_text, rewrite) AS text FROM turns', True)} SELECT query_id, doc_id, score FROM scored",
    "retrieval_cascade": f"""WITH {_TURNS}, {_scored(_BY_TRACE, True)}, {_LISTED}, near AS (SELECT query_id, 1 AS tier, rank, doc_id FROM ranked WHERE rank <= 5),
rest AS (SELECT query_id, thread_id, text FROM asked WHERE query_id NOT IN (SELECT query_id FROM near)), second AS (SELECT query_id, 2 AS tier, rank, doc_id FROM rest JOIN listed USING (thread_id) WHERE rank <= 5),
third AS (SELECT query_id, thread_id, text FROM rest WHERE query_id NOT IN (SELECT query_id FROM second)),
q3 AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_WORDS.format("text")}) AS term FROM third) GROUP BY ALL),
s3 AS (SELECT q.query_id, p.doc_id, {_SCORE} AS score FROM postings p JOIN q3 q ON p.term = q.term JOIN terms t ON t.term = p.term JOIN lengths l ON l.doc_id = p.doc_id, corpus GROUP BY ALL),
o3 AS (SELECT * FROM (SELECT s.*, i.row_idx, row_number() OVER (PARTITION BY query_id, i.message_id, lower({_strip("substr(coalesce(i.chunk_text, ''), 1, 180)")}) ORDER BY row_idx, doc_id) AS n1 FROM s3 s JOIN ingest i USING (doc_id) WHERE score > 0) WHERE n1 = 1),
far AS (SELECT query_id, 3 AS tier, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_idx, doc_id) AS rank, doc_id FROM o3)
SELECT * FROM near UNION ALL SELECT * FROM second UNION ALL SELECT * FROM far WHERE rank <= 5""",
    "term_doc_freq": f"WITH {_INDEX} SELECT term, df FROM terms",
    "doc_length_stats": f"WITH {_INDEX} SELECT docs, round(al, 4) AS avg_length FROM corpus",
    "search_dedupe_signature": f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY message_id, lower({_strip("substr(coalesce(chunk_text, ''), 1, 180)")}) ORDER BY row_idx, doc_id) AS n1 FROM ingest) WHERE n1 = 1",
    "list_first_per_key": f"WITH {_LISTED} SELECT thread_id, rank, doc_id FROM listed WHERE rank <= 5",
    "thread_counts": "SELECT thread_id, count(*) AS chunk_count, count(DISTINCT row_idx) AS message_count FROM ingest WHERE thread_id <> '' GROUP BY thread_id",
    "chunk_pack": f"""WITH RECURSIVE paras AS (SELECT row_idx, p, len({_WORDS.format("p")}) AS n, row_number() OVER (PARTITION BY row_idx ORDER BY i) AS k FROM (SELECT row_idx, i, {_strip("x")} AS p FROM (SELECT row_idx, unnest(list_zip(xs, range(len(xs)))) AS z, z[1] AS x, z[2] AS i FROM (SELECT row_idx, string_split(regexp_replace(coalesce(body, ''), '\\r\\n?', chr(10), 'g'), chr(10) || chr(10)) AS xs FROM email_structure))) WHERE p <> ''),
fold(row_idx, k, n, section) AS (SELECT row_idx, k, n, CAST(1 AS BIGINT) FROM paras WHERE k = 1 UNION ALL SELECT p.row_idx, p.k, CASE WHEN f.n + p.n <= 60 THEN f.n + p.n ELSE p.n END, CASE WHEN f.n + p.n <= 60 THEN f.section ELSE f.section + 1 END FROM fold f JOIN paras p ON p.row_idx = f.row_idx AND p.k = f.k + 1),
packed AS (SELECT row_idx, section, string_agg(p, chr(10) || chr(10) ORDER BY k) AS t FROM fold JOIN paras USING (row_idx, k) GROUP BY ALL)
SELECT row_idx, section, len({_WORDS.format("t")}) AS token_count, md5(t) AS digest FROM packed UNION ALL SELECT row_idx, 1, 0, md5({_strip("coalesce(body, '')")}) FROM email_structure WHERE row_idx NOT IN (SELECT row_idx FROM paras)""",
    "subject_normalize": f"SELECT row_idx, {_SUBJECT} AS normalized_subject FROM email_structure",
    "participants": f"SELECT row_idx, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(list_concat([sender], coalesce(recipients, [])), coalesce(cc, [])), lambda x: {_strip("lower(coalesce(x, ''))")}), lambda x: x <> ''))), '|'), '') AS participants FROM email_structure",
    "gap_sessions": f"""WITH {_DATES}, r AS (SELECT row_idx, {_SUBJECT} AS normalized_subject, wall AS moment, list_filter(list_transform(list_concat(list_concat([sender], coalesce(recipients, [])), coalesce(cc, [])), lambda x: {_strip("lower(coalesce(x, ''))")}), lambda x: x <> '') AS who FROM email_structure JOIN dates USING (row_idx)),
l AS (SELECT *, lag(row_idx) OVER w AS lr, lag(moment) OVER w AS la, lag(who) OVER w AS lw FROM r WINDOW w AS (PARTITION BY normalized_subject ORDER BY moment NULLS FIRST, row_idx)),
s AS (SELECT *, CASE WHEN lr IS NULL THEN 1 WHEN list_has_any(who, lw) OR moment IS NULL OR la IS NULL OR moment <= la + INTERVAL 14 DAY THEN 0 ELSE 1 END AS fresh FROM l)
SELECT row_idx, normalized_subject, CAST(sum(fresh) OVER (PARTITION BY normalized_subject ORDER BY moment NULLS FIRST, row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s""",
    "whitespace_normalize": f"SELECT row_idx, md5({_strip(f"regexp_replace(coalesce(body, ''), '{_SP}+', ' ', 'g')")}) AS digest FROM email_structure",
    "forward_header_runs": f"SELECT row_idx, md5(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT (i > 2 AND h[i] AND h[i - 1] AND h[i - 2])), lambda i: l[i]), chr(10))) AS digest FROM (SELECT row_idx, l, list_transform(l, lambda x: regexp_matches({_strip('x')}, {_HEAD})) AS h FROM (SELECT row_idx, {_lines('body')} AS l FROM email_structure))",
    "disclaimer_cut": f"SELECT row_idx, md5(CASE WHEN hit IS NULL THEN array_to_string(l, chr(10)) ELSE {_strip('array_to_string(l[1:hit - 1], chr(10))')} END) AS digest FROM (SELECT row_idx, l, nullif(list_position(list_transform(l, lambda x: regexp_matches({_strip('x')}, {_CUT})), TRUE), 0) AS hit FROM (SELECT row_idx, {_lines('body')} AS l FROM email_structure))",
    "newsletter_noise": f"SELECT row_idx, md5({_strip(f"array_to_string(list_transform(list_filter(CASE WHEN hit IS NULL THEN l ELSE l[1:hit - 1] END, lambda x: NOT regexp_matches({_strip('x')}, '(?i)^(https?://|\\[no worries)')), lambda x: CASE WHEN {_strip('x')} = '' THEN '' ELSE x END), chr(10))")}) AS digest FROM (SELECT row_idx, l, nullif(list_position(list_transform(l, lambda x: regexp_matches({_strip('x')}, {_NEWS})), TRUE), 0) AS hit FROM (SELECT row_idx, {_lines('body')} AS l FROM email_structure))",
    "month_stats": f"WITH {_SLICE} SELECT month, count(*) AS messages, count(*) FILTER (flagged) AS flagged, count(DISTINCT subject) AS subjects FROM rows2 GROUP BY month",
    "window_scores": f"WITH {_WINDOWS} SELECT start, span, messages, flagged, viable, score FROM scores",
    "window_choice": f"WITH {_WINDOWS} SELECT start, span, last, messages, flagged, viable, score FROM best",
    "thread_rank": f"WITH {_RANKS} SELECT rank, subject, messages, flagged FROM ranks",
    "slice_cap": f"WITH RECURSIVE {_CHOSEN} SELECT row_idx, subject, CAST(running AS BIGINT) AS running_bytes FROM capped",
    "slice_summary": f'''WITH RECURSIVE {_CHOSEN} SELECT printf('%04d-%02d', start // 12, start % 12 + 1) AS window_start, printf('%04d-%02d', last // 12, last % 12 + 1) AS window_end, span AS month_span, s.*, c.* FROM best, (SELECT count(DISTINCT subject) AS threads_selected, count(*) AS messages_selected, count(*) FILTER (flagged) AS attachment_messages, CAST(coalesce(sum(size), 0) AS BIGINT) AS indexed_text_bytes, round(coalesce(sum(size), 0) / 1048576, 2) AS indexed_text_mb FROM capped) s, (SELECT '[' || string_agg('{{"subject":' || to_json(subject) || ',"messages":' || n || '}}', ',' ORDER BY n DESC, f) || ']' AS thread_message_counts FROM (SELECT subject, count(*) AS n, min(row_idx) AS f FROM capped GROUP BY subject)) c''',
    "prev_reference": f"WITH {_EPOCHS} SELECT trace_id, coalesce(nullif(lag(rewrite) OVER w, ''), nullif(lag(answer) OVER w, ''), nullif(lag(user_text) OVER w, '')) AS reference FROM epochs WINDOW w AS (PARTITION BY session_id, epoch ORDER BY logged_at, trace_id)",
    "needs_rewrite": f"WITH {_TURNS} SELECT trace_id, CASE WHEN t = '' THEN FALSE WHEN regexp_matches(t, '(^|[^a-z0-9_])(that|it|he|she|they|them|those|these|earlier|previous|same one|that one)($|[^a-z0-9_])') THEN TRUE ELSE NOT regexp_matches(t, '^(who|what|when|where|why|show|summarize) ') AND len(regexp_extract_all(t, '[^ \\t\\n\\r\\f\\v]+')) <= 3 END AS needs FROM (SELECT trace_id, lower({_strip("coalesce(user_text, '')")}) AS t FROM turns)",
    "intent_route": f"WITH {_TURNS} SELECT trace_id, {_route("lower(coalesce(user_text, ''))")} AS intent FROM turns",
    "item_dedupe": f"WITH {_LISTED}, s AS (SELECT *, row_number() OVER (PARTITION BY thread_id, lower({_strip("coalesce(subject, '')")}), lower({_strip("substr(coalesce(chunk_text, ''), 1, 280)")}) ORDER BY rank) AS m FROM listed WHERE rank <= 5) SELECT thread_id AS query_id, row_number() OVER (PARTITION BY thread_id ORDER BY rank) AS place, doc_id FROM s WHERE m = 1",
    "people_answer": f"""WITH {_LISTED}, s AS (SELECT *, row_number() OVER (PARTITION BY thread_id, lower({_strip("coalesce(subject, '')")}), lower({_strip("substr(coalesce(chunk_text, ''), 1, 280)")}) ORDER BY rank) AS m FROM listed WHERE rank <= 5),
p AS (SELECT thread_id, rank, unnest(xs) AS person, unnest(range(len(xs))) AS pos FROM (SELECT thread_id, rank, list_concat(list_concat([sender], coalesce(recipients, [])), coalesce(cc, [])) AS xs FROM s WHERE m = 1)),
f AS (SELECT *, row_number() OVER (PARTITION BY thread_id, lower({_strip("person")}) ORDER BY rank, pos) AS n1 FROM p WHERE trim(person) <> ''), g AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY rank, pos) AS k FROM f WHERE n1 = 1)
SELECT thread_id AS query_id, string_agg(person, ', ' ORDER BY k) AS people FROM g WHERE k <= 8 GROUP BY thread_id""",
    "address_list": f"SELECT row_idx, array_to_string(list_filter(list_transform(string_split(array_to_string(coalesce(recipients, []), ', '), ','), lambda x: {_strip('x')}), lambda x: x <> ''), '|') AS entries FROM email_structure",
    "quoted_printable": "SELECT row_idx, md5(coalesce(body, '')) AS digest FROM email_structure",
    "html_strip": "SELECT row_idx, md5(regexp_replace(coalesce(body, ''), '<[^>]+>', ' ', 'g')) AS digest FROM email_structure",
    "mime_parse": f"WITH {_RAW} SELECT row_idx, {_strip(_flat('message_id'))} AS message_id, subject, sender AS \"from\", in_reply_to, md5(regexp_replace(CASE WHEN row_idx % 3 = 0 THEN replace(replace(body, '=', '=3D'), 'é', '=C3=A9') ELSE body END || part, '\\r\\n?', chr(10), 'g')) AS digest FROM raw",
    "thread_components": f"""WITH RECURSIVE {_DATES}, r AS (SELECT row_idx, {_SUBJECT} AS s1, wall AS moment, list_filter(list_transform(list_concat(list_concat([sender], coalesce(recipients, [])), coalesce(cc, [])), lambda x: {_strip("lower(coalesce(x, ''))")}), lambda x: x <> '') AS who FROM email_structure JOIN dates USING (row_idx)),
l AS (SELECT *, lag(row_idx) OVER w AS lr, lag(moment) OVER w AS la, lag(who) OVER w AS lw FROM r WINDOW w AS (PARTITION BY s1 ORDER BY moment NULLS FIRST, row_idx)),
ids AS (SELECT message_id, max(row_idx) AS target FROM email_structure WHERE message_id <> '' GROUP BY message_id),
e AS (SELECT row_idx AS u, lr AS v FROM l WHERE lr IS NOT NULL AND (list_has_any(who, lw) OR moment IS NULL OR la IS NULL OR moment <= la + INTERVAL 14 DAY)
UNION SELECT row_idx, target FROM (SELECT row_idx, unnest(list_concat([in_reply_to], coalesce(ref_ids, []))) AS message_id FROM email_structure) JOIN ids USING (message_id)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), s0 AS (SELECT row_idx, min(w) AS lab FROM (SELECT row_idx, row_idx AS w FROM r UNION ALL SELECT u, v FROM b) GROUP BY row_idx),
reach(a, z) AS (SELECT row_idx, lab FROM s0 UNION SELECT reach.a, b.v FROM reach JOIN b ON b.u = reach.z WHERE b.v < reach.a OR TRUE)
SELECT a AS row_idx, min(z) AS thread_row FROM reach GROUP BY a""",
}

SQL |= {
    "value_extract": f"""SELECT doc_id, array_to_string({_VALUES}, '|') AS found FROM (SELECT doc_id, {_cleaned("coalesce(chunk_text, '')")} AS c FROM ingest)""",
    "content_sentences": f"""WITH a AS (SELECT doc_id, coalesce(chunk_text, '') AS t, {_LINES} AS lines FROM ingest), b AS (SELECT doc_id, CASE WHEN len(lines) > 3 THEN array_to_string(lines[4:], chr(10)) ELSE t END AS body FROM a),
s AS (SELECT doc_id, list_filter(list_transform({_SENTENCES.format("body")}, lambda x: {_cleaned("x")}), lambda x: len(regexp_extract_all(x, '[^ \\t\\n\\r\\f\\v]+')) > 8 AND NOT regexp_matches(x, '(?i)^By\\s+[A-Z][A-Za-z\\s.\\-'']+(?:\\s+Of\\s+[A-Z][A-Za-z\\s.\\-'']+)?$') AND NOT regexp_matches(x, '(?i)^(?:if there was an inch|more|final order|legal stuff)')) AS s FROM b)
SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM s""",
    "sentence_rank": f"""WITH a AS (SELECT doc_id, {_WORDS.format("subject")} AS asked, list_filter(list_transform({_SENTENCES.format("coalesce(chunk_text, '')")}, lambda x: {_strip("x")}), lambda x: x <> '') AS s FROM ingest),
b AS (SELECT doc_id, i, s[i] AS x, len(list_intersect(asked, {_WORDS.format("s[i]")})) AS o FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM a)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, i) AS k FROM b), best AS (SELECT doc_id, string_agg(x, '|' ORDER BY k) AS t FROM c WHERE k <= 2 GROUP BY doc_id)
SELECT doc_id, md5(coalesce(t, '')) AS digest FROM ingest LEFT JOIN best USING (doc_id)""",
    "chunk_rows": rf"""WITH RECURSIVE texts AS (SELECT row_idx, message_id, {_strip("concat_ws(chr(10), nullif(subject, ''), nullif(sender, ''), nullif(array_to_string(coalesce(recipients, []), ' '), ''), nullif(array_to_string(coalesce(cc, []), ' '), ''), nullif(body, ''))")} AS body FROM email_structure),
cut AS (SELECT row_idx, string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10) || chr(10)) AS xs FROM texts), pieces AS (SELECT row_idx, i, {_strip("xs[i]")} AS p FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS i FROM cut)),
paras AS (SELECT row_idx, p, len({_WORDS.format("p")}) AS n, row_number() OVER (PARTITION BY row_idx ORDER BY i) AS k FROM pieces WHERE p <> ''),
fold(row_idx, k, n, section) AS (SELECT row_idx, k, n, CAST(1 AS BIGINT) FROM paras WHERE k = 1 UNION ALL SELECT p.row_idx, p.k, CASE WHEN f.n + p.n <= 220 THEN f.n + p.n ELSE p.n END, CASE WHEN f.n + p.n <= 220 THEN f.section ELSE f.section + 1 END FROM fold f JOIN paras p ON p.row_idx = f.row_idx AND p.k = f.k + 1),
packed AS (SELECT row_idx, section, string_agg(p, chr(10) || chr(10) ORDER BY k) AS t FROM fold JOIN paras USING (row_idx, k) GROUP BY ALL UNION ALL SELECT row_idx, 1, body FROM texts WHERE row_idx NOT IN (SELECT row_idx FROM paras))
SELECT printf('email_%04d_%02d', row_idx, section) AS doc_id, row_idx, section, coalesce(nullif(message_id, ''), 'row_' || row_idx) AS message_id, len({_WORDS.format("t")}) AS token_count, md5(t) AS digest FROM packed JOIN texts USING (row_idx)""",
}

SQL |= {
    "index_build": f"WITH {_INDEX} SELECT term, df, round(ln(1 + (docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM terms, corpus",
    "retrieved_items": f"""WITH {_TURNS}, {_scored(_BY_TRACE, True)} SELECT query_id, rank, doc_id, i.thread_id, i.message_id, page_no, filename, chunk_type, score, subject, date_text, sender, array_to_string(coalesce(recipients, []), '|') AS recipients, array_to_string(coalesce(cc, []), '|') AS cc, md5(chunk_text) AS text_digest, substr(coalesce(chunk_text, ''), 1, 280) AS text_preview
FROM ranked JOIN ingest i USING (doc_id) WHERE rank <= 5""",
    "date_normalize": f"WITH {_DATES} SELECT row_idx, coalesce(iso, nullif(date_text, '')) AS iso FROM dates JOIN email_structure USING (row_idx)",
    "message_metadata": f'WITH {_SLICE} SELECT row_idx, subject, moment AS "at", flagged, size FROM rows1',
    "structured_records": rf"""WITH {_DATES}, {_RAW} SELECT row_idx, source_file, {_strip(_flat("message_id"))} AS message_id, subject, coalesce(iso, nullif(raw.date_text, '')) AS date_text, sender, nullif(in_reply_to, '') AS in_reply_to, array_to_string({_entries("recipients")}, '|') AS recipients, array_to_string({_entries("cc")}, '|') AS cc, array_to_string({_entries("ref_ids")}, '|') AS ref_ids,
md5({_strip("regexp_replace(body || part, '\r\n?', chr(10), 'g')")}) AS digest FROM raw JOIN dates USING (row_idx)""",
    "thread_numbers": f"""WITH t AS ({SQL["thread_components"].replace("WITH RECURSIVE ", "WITH RECURSIVE ", 1)}), n AS (SELECT thread_row, row_number() OVER (ORDER BY thread_row) AS n FROM (SELECT DISTINCT thread_row FROM t))
SELECT row_idx, printf('thread_%04d', n) AS thread_id, {_SUBJECT} AS normalized_subject FROM t JOIN n USING (thread_row) JOIN email_structure USING (row_idx)""",
}
# one line after the other folded into what is done, a mark, and the line still open
_OPEN = "split_part(acc, chr(1), 2)"
_DONE = f"split_part(acc, chr(1), 1) || CASE WHEN {_OPEN} <> '' THEN {_OPEN} || chr(10) ELSE '' END"
_FOLDED = rf"""list_reduce(list_concat([chr(1)], list_transform(l, lambda x: {_strip("x")})), lambda acc, y: CASE WHEN y = '' OR starts_with(y, '>') OR regexp_matches(y, {_HEAD}) OR starts_with(y, '-----Original Message-----') THEN {_DONE} || y || chr(10) || chr(1)
WHEN {_OPEN} = '' THEN split_part(acc, chr(1), 1) || chr(1) || y WHEN NOT regexp_matches({_OPEN}, '[.!?:;]$') AND NOT regexp_matches(y, '^[-*]') THEN acc || ' ' || y ELSE {_DONE} || chr(1) || y END)"""
_UNWRAPPED = f"CASE WHEN {_OPEN} <> '' THEN replace(acc, chr(1), '') ELSE regexp_replace(split_part(acc, chr(1), 1), '\\n$', '') END"
_CLEAN = rf"""b1 AS (SELECT row_idx, {_lines("regexp_replace(regexp_replace(coalesce({0}, ''), '\r\n?', chr(10), 'g'), '<[^>]+>', ' ', 'g')")} AS l FROM {{1}}),
b2 AS (SELECT row_idx, list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT (i > 2 AND h[i] AND h[i - 1] AND h[i - 2])), lambda i: l[i]) AS l FROM (SELECT *, list_transform(l, lambda x: regexp_matches({_strip("x")}, {_HEAD})) AS h FROM b1)),
b3 AS (SELECT row_idx, CASE WHEN hit IS NULL THEN l ELSE string_split({_strip("array_to_string(l[1:hit - 1], chr(10))")}, chr(10)) END AS l FROM (SELECT *, nullif(list_position(list_transform(l, lambda x: regexp_matches({_strip("x")}, {_CUT})), TRUE), 0) AS hit FROM b2)),
b4 AS (SELECT row_idx, string_split({_strip(f"array_to_string(list_transform(list_filter(CASE WHEN hit IS NULL THEN l ELSE l[1:hit - 1] END, lambda x: NOT regexp_matches({_strip('x')}, '(?i)^(https?://|\\[no worries)')), lambda x: CASE WHEN {_strip('x')} = '' THEN '' ELSE x END), chr(10))")}, chr(10)) AS l FROM (SELECT *, nullif(list_position(list_transform(l, lambda x: regexp_matches({_strip("x")}, {_NEWS})), TRUE), 0) AS hit FROM b3)),
b5 AS (SELECT row_idx, {_UNWRAPPED} AS t FROM (SELECT row_idx, {_FOLDED} AS acc FROM b4)),
cleaned AS (SELECT row_idx, {_strip(f"regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_strip("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), chr(10)), '\\n{{{{3,}}}}', chr(10) || chr(10), 'g')")} AS clean_body FROM b5)"""
SQL |= {
    "unwrap_lines": f"SELECT row_idx, md5({_UNWRAPPED}) AS digest FROM (SELECT row_idx, {_FOLDED} AS acc FROM (SELECT row_idx, {_lines('body')} AS l FROM email_structure))",
    "clean_body": f"WITH {_CLEAN.replace('{0}', 'body').replace('{1}', 'email_structure').replace('{{', '{').replace('}}', '}')} SELECT row_idx, md5(clean_body) AS digest FROM cleaned",
}

# one question put to every thread's listing, by query
_ASKED = {
    "timeline_answer": "show the timeline", "people_reply": "who is involved", "decision_answer": "what was the decision", "why_answer": "why was it forwarded", "meeting_answer": "which meeting", "location_answer": "where is it connected to", "value_answer": "what is the price",
    "date_answer": "when was the mail", "summary_answer": "give me a summary", "grounded_answer": "the pension and the tariff",
}
_OF_LISTED = "SELECT thread_id AS query_id, rank, 0.0::DOUBLE AS score, doc_id FROM listed WHERE rank <= 5"
SQL |= {name: f"WITH {_LISTED}, {_answered(f"SELECT DISTINCT thread_id AS query_id, '{text}' AS text, '{text}' AS evidence FROM ingest", _OF_LISTED)}" for name, text in _ASKED.items()}
_OUTSIDE = SQL["retrieval_cascade"].replace("SELECT query_id, 1 AS tier", "SELECT query_id, score, 1 AS tier").replace("SELECT query_id, 2 AS tier", "SELECT query_id, 0.0 AS score, 2 AS tier").replace("SELECT query_id, 3 AS tier", "SELECT query_id, score, 3 AS tier")
_OUTSIDE = _OUTSIDE.replace("third AS (SELECT query_id, thread_id, text FROM rest WHERE", "third AS (SELECT query_id, thread_id, text FROM rest WHERE query_id IN (SELECT trace_id FROM turns WHERE search_outside_thread) AND")
_BEFORE, _HITS = _OUTSIDE.rsplit("\nSELECT * FROM near", 1)
SQL["answer_turns"] = f"{_BEFORE}, {_answered("SELECT trace_id AS query_id, user_text AS text, coalesce(nullif(rewrite, ''), user_text) AS evidence FROM turns", 'SELECT * FROM near' + _HITS)}"

_NOTED = {
    "people": rf"\b[A-Z][a-z]+(?:{_SP}+[A-Z][a-z]+)+\b", "dates": rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*{_SP}+\d{{1,2}},?{_SP}+\d{{4}})\b", "amounts": rf"(?i)(?:\$|USD{_SP}?)\d[\d,]*(?:\.\d+)?",
    "filenames": r"(?i)\b[\w,\-]+\.(?:pdf|docx?|txt|html?)\b", "message_ids": r"<[^> \t\n\r\f\v]+>",
}
_CITED = "list_filter(list_transform(coalesce(citations, []), lambda c: c.message_id), lambda m: length(m) > 0)"
_FOUND = "\nUNION ALL ".join(f"SELECT session_id, epoch, o, '{k}' AS kind, {f'list_concat(regexp_extract_all(t, {chr(39)}{p}{chr(39)}), {_CITED})' if k == 'message_ids' else f'regexp_extract_all(t, {chr(39)}{p}{chr(39)})'} AS xs FROM placed" for k, p in _NOTED.items())
_NOTES = f"""{_EPOCHS}, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id, epoch ORDER BY logged_at, trace_id) AS o, concat_ws(' ', nullif(user_text, ''), nullif(rewrite, ''), nullif(answer, '')) AS t, nullif(CASE WHEN rewrite <> '' THEN {_strip("rewrite")} WHEN user_text <> '' THEN {_strip("user_text")} END, '') AS topic FROM epochs),
found AS ({_FOUND}), x AS (SELECT session_id, epoch, kind, o, unnest(xs) AS item, unnest(range(len(xs))) AS j FROM found), firsts AS (SELECT session_id, epoch, kind, item, min((o, j)) AS p FROM x GROUP BY ALL),
notes AS (SELECT t.trace_id, kind, list(item ORDER BY p) AS xs FROM placed t JOIN firsts i ON i.session_id IS NOT DISTINCT FROM t.session_id AND i.epoch = t.epoch AND i.p[1] <= t.o GROUP BY ALL),
topics AS (SELECT trace_id, last_value(topic IGNORE NULLS) OVER (PARTITION BY session_id, epoch ORDER BY o ROWS UNBOUNDED PRECEDING) AS last_topic FROM placed),
noted AS (SELECT trace_id, last_topic, {", ".join(f"coalesce(any_value(xs) FILTER (kind = '{k}'), []) AS {k}" for k in _NOTED)} FROM topics LEFT JOIN notes USING (trace_id) GROUP BY trace_id, last_topic)"""
_KINDS = ", ".join(f"array_to_string({k}, '|') AS {k}" for k in _NOTED)
_TURN = "concat_ws('|', coalesce(user_text, ''), coalesce(rewrite, ''), coalesce(answer, ''), array_to_string(list_transform(coalesce(citations, []), lambda c: concat_ws('/', c.cite_type, c.message_id, c.page_no)), ','), strftime(logged_at, '%Y-%m-%d %H:%M:%S'))"
_LAST_TURNS = f"last_turns AS (SELECT trace_id, session_id, thread_id, epoch, logged_at, list({_TURN}) OVER (PARTITION BY session_id, epoch ORDER BY logged_at, trace_id ROWS 4 PRECEDING) AS history FROM epochs)"
_LAST_STATE = f"{_NOTES}, {_LAST_TURNS}, state AS (SELECT * FROM last_turns JOIN noted USING (trace_id) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY logged_at DESC, trace_id DESC) = 1)"
_TWO = ", ".join(f"CASE WHEN len(n.{k}) > 0 THEN '{k}: ' || array_to_string(n.{k}[-2:], ', ') END" for k in ("filenames", "message_ids", "dates", "amounts", "people"))
_POINTED = r"'\b(that|it|he|she|they|them|those|these|earlier|previous|same one|that one)\b'"
_KEYS = r"list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '\b[a-zA-Z][a-zA-Z0-9./''-]{{2,}}\b'), lambda w: lower(w)))"
_SLIM_TEXT = "concat_ws('/', i.doc_id, score, md5(substr(coalesce(i.chunk_text, ''), 1, 280)))"
SQL |= {
    # letters beyond ASCII are parts of words, other characters beyond it are none
    "entity_extract": "SELECT doc_id, " + ", ".join(f"array_to_string(regexp_extract_all(t, '{_NOTED[k]}'), '|') AS {k}" for k in ("people", "dates", "amounts")) + r", array_to_string(regexp_extract_all(coalesce(text, ''), '(?i)[\p{L}\p{N}_,\-]+\.(?:pdf|docx?|txt|html?)\b'), '|') AS filenames FROM (SELECT *, regexp_replace(regexp_replace(coalesce(text, ''), '[^\x00-\x7F\p{L}\p{N}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g') AS t FROM documents)",
    "entity_notes_running": f"WITH {_NOTES} SELECT trace_id, last_topic, {_KINDS} FROM noted",
    "history_last_n": f"WITH {_EPOCHS}, {_LAST_TURNS} SELECT trace_id, epoch, array_to_string(history, ' || ') AS history FROM last_turns",
    "session_state": f"WITH {_LAST_STATE} SELECT session_id, thread_id, array_to_string(history, ' || ') AS history, {_KINDS}, last_topic FROM state",
    "session_switch_reset": f"""WITH {_LAST_STATE}, moved AS (SELECT session_id, max(thread_id) AS other FROM turns GROUP BY session_id HAVING max(length(user_text)) > 60), s AS (SELECT state.*, other, other IS NOT NULL OR session_id IN (SELECT session_id FROM turns WHERE search_outside_thread) AS fresh FROM state LEFT JOIN moved USING (session_id))
SELECT session_id, coalesce(other, thread_id) AS thread_id, CASE WHEN fresh THEN 0 ELSE len(history) END AS turns, CASE WHEN fresh THEN 0 ELSE len(people) END AS people, CASE WHEN NOT fresh THEN last_topic END AS last_topic FROM s""",
    "rule_rewrite": rf"""WITH {_NOTES}, r AS (SELECT trace_id, {_strip("coalesce(user_text, '')")} AS t, lag(trace_id) OVER w AS before, coalesce(nullif(lag(rewrite) OVER w, ''), nullif(lag(answer) OVER w, ''), nullif(lag(user_text) OVER w, '')) AS reference FROM epochs WINDOW w AS (PARTITION BY session_id, epoch ORDER BY logged_at, trace_id)),
h AS (SELECT r.*, list_filter([CASE WHEN n.last_topic <> '' THEN 'topic: ' || n.last_topic END, {_TWO}], lambda x: x IS NOT NULL) AS hints, needs FROM r JOIN ({SQL["needs_rewrite"]}) USING (trace_id) LEFT JOIN noted n ON n.trace_id = r.before)
SELECT trace_id, needs, CASE WHEN needs AND regexp_matches(lower(t), {_POINTED}) THEN {_strip("substr(concat_ws(' ', t, reference, hints[1], hints[2]), 1, 240)")} WHEN needs THEN {_strip("substr(t, 1, 240)")} ELSE t END AS rewritten FROM h""",
    "keyword_tokens": rf"""WITH {_TURNS} SELECT trace_id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i]), ' ') AS words, coalesce(length({_strip("rewrite")}) > 0 AND NOT regexp_matches(rewrite, '(?i)\b(not_duplicate|return one short search query|duplicate)\b') AND len({_KEYS.format("rewrite")}) BETWEEN 1 AND 18 AND (len(w) = 0 OR list_has_any(w, {_KEYS.format("rewrite")})), FALSE) AS valid,
len(regexp_extract_all(coalesce(answer, ''), '[^ \t\n\r\f\v]+')) >= 4 AND lower({_strip("coalesce(answer, '')")}) NOT IN ('true', 'false', 'yes', 'no') AS compressed FROM (SELECT *, list_transform(regexp_extract_all(coalesce(user_text, ''), '\b[a-zA-Z][a-zA-Z0-9./''-]{{2,}}\b'), lambda x: lower(x)) AS w FROM turns)""",
    "trace_roundtrip": f"""WITH {_TURNS}, {_scored(_BY_TRACE, True)}, hits AS (SELECT query_id AS trace_id, string_agg({_SLIM_TEXT}, ' ' ORDER BY rank) AS retrieved, string_agg({_SLIM_TEXT}, ' ' ORDER BY rank) FILTER (rank <= 3) AS used_items FROM ranked JOIN ingest i USING (doc_id) WHERE rank <= 5 GROUP BY query_id)
SELECT trace_id, logged_at, session_id, thread_id, user_text, rewrite, coalesce(retrieved, '') AS retrieved, coalesce(used_items, '') AS used_items, answer, array_to_string(list_transform(coalesce(citations, []), lambda c: concat_ws('/', c.cite_type, c.message_id, c.page_no)), ' ') AS citations, latency_ms, search_outside_thread, 0 AS token_counts FROM turns LEFT JOIN hits USING (trace_id)""",
}

_HINTED = SQL["summary_answer"].replace("topics AS (", "named_by AS (", 1).replace(
    "values_of AS (",
    """hints AS (SELECT query_id, 'This thread is about ' || arg_min(full_name, contact_id) || '.' AS hint FROM items JOIN contacts ON contact_kind = 'organisation' AND contains(lower(coalesce(chunk_text, '')), lower(full_name)) WHERE place = 1 GROUP BY query_id),
topics AS (SELECT query_id, cite, src, coalesce(hint, topic) AS topic FROM named_by LEFT JOIN hints USING (query_id)),
values_of AS (""",
    1,
)
_AS_PARSED = f"""{_DATES.replace("SELECT row_idx, date_text AS x", f"SELECT row_idx, {_strip(_flat('date_text'))} AS x")}, {_RAW},
parsed AS (SELECT row_idx, {_strip(_flat("message_id"))} AS message_id, subject, coalesce(iso, nullif(raw.date_text, '')) AS date_text, wall, sender, nullif(in_reply_to, '') AS in_reply_to, {_entries("recipients")} AS recipients, {_entries("cc")} AS cc, {_entries("ref_ids")} AS ref_ids, {_strip("regexp_replace(body || part, '\\r\\n?', chr(10), 'g')")} AS body FROM raw JOIN dates USING (row_idx))"""
_REACHED = SQL["thread_components"].split(", r AS (", 1)[1].replace("email_structure JOIN dates USING (row_idx)", "parsed").replace("email_structure", "parsed").rsplit("\nSELECT a AS row_idx", 1)[0]
_CUT_UP = SQL["chunk_rows"].split("cut AS (", 1)[1].rsplit("\nSELECT printf", 1)[0]
_TEXTS = f"texts AS (SELECT row_idx, message_id, {_strip("concat_ws(chr(10), nullif(subject, ''), nullif(sender, ''), nullif(array_to_string(recipients, ' '), ''), nullif(array_to_string(cc, ' '), ''), coalesce(nullif(clean_body, ''), nullif(body, '')))")} AS body FROM parsed JOIN cleaned USING (row_idx))"
SQL |= {
    "rule_table_hint": _HINTED,
    "raw_csv": f"WITH {_RAW} SELECT source_file AS file, md5(message) AS digest FROM raw",
    "ingest_chunks": f"""WITH RECURSIVE {_AS_PARSED}, r AS ({_REACHED}, threads AS (SELECT a AS row_idx, min(z) AS thread_row FROM reach GROUP BY a), numbers AS (SELECT thread_row, row_number() OVER (ORDER BY thread_row) AS n FROM (SELECT DISTINCT thread_row FROM threads)),
{_CLEAN.replace('{0}', 'body').replace('{1}', 'parsed').replace('{{', '{').replace('}}', '}')}, {_TEXTS}, cut AS ({_CUT_UP}
SELECT printf('email_%04d_%02d', row_idx, section) AS doc_id, row_idx, section, printf('thread_%04d', numbers.n) AS thread_id, coalesce(nullif(parsed.message_id, ''), 'row_' || row_idx) AS message_id, subject, date_text, len({_WORDS.format("t")}) AS token_count, md5(t) AS digest FROM packed JOIN parsed USING (row_idx) JOIN threads USING (row_idx) JOIN numbers USING (thread_row)""",
}

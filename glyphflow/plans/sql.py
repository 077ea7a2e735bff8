"""The views and operators once more, in SQL that DuckDB runs: what the registered queries are held against."""

from __future__ import annotations

from glyphflow.functions import text as T
from glyphflow.plans import views

SPACE = T.SPACE
EV = "ev AS (SELECT user_id AS roi, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, epoch_us(ts) / 1e6 AS time_sec, event_type AS text, least(value / 100, 1.0) AS score, CAST(json_extract_string(props, '$.k') AS INT) % 30 AS x, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS y FROM events)"
LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(generate_series(1, len(l))) AS t(i))"
SCRIPTED = LINES.replace("l[i] AS line FROM", "CASE (doc_id + i - 1) % 5 " + " ".join(f"WHEN {k} THEN translate(l[i], 'aeiou', '{v}')" for k, v in views.SCRIPTS.items()) + " ELSE l[i] END AS line FROM")
DRESSED = LINES.replace("l[i] AS line FROM", "CASE (doc_id + i - 1) % 7 " + " ".join(f"WHEN {k} THEN '{a}' || l[i] || '{b}'" for k, (a, b) in views.DRESS.items()) + " ELSE l[i] END AS line FROM")
WORDS = "words AS (SELECT doc_id, CAST(i - 1 AS INT) AS word_no, l[i] AS word FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents), unnest(generate_series(1, len(l))) AS t(i))"
ROIS = "rois AS (SELECT o_orderkey AS key, o_orderstatus AS kind, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS s, coalesce(e, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))) AS e FROM orders LEFT JOIN (SELECT l_orderkey, max(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
GROUPS = "g AS (SELECT *, CASE WHEN y > 75 THEN 'BOTTOM' WHEN y < 15 THEN 'TOP' ELSE 'SCENE' END AS location FROM (SELECT l_suppkey % 500 AS roi, l_orderkey * 10 + l_linenumber AS group_id, CAST(l_partkey % 100 AS INT) AS y, CAST(l_quantity AS INT) % 40 AS height FROM lineitem))"
SUBS = r"""subs AS (SELECT conv_id AS roi, turn * 3 + k AS seq, CAST(turn * CASE WHEN conv_id % 5 = 4 THEN 12.5 ELSE 7.5 END + k * CASE conv_id % 7 WHEN 3 THEN 6.503 WHEN 5 THEN 1.5 ELSE 2.503 END AS DOUBLE) AS start_sec, CAST(turn * CASE WHEN conv_id % 5 = 4 THEN 12.5 ELSE 7.5 END + k * CASE conv_id % 7 WHEN 3 THEN 6.503 WHEN 5 THEN 1.5 ELSE 2.503 END + 2.0 AS DOUBLE) AS end_sec,
CASE WHEN conv_id % 3 = 0 THEN 'Scene' ELSE 'Default' END AS style, CASE WHEN conv_id % 3 = 0 THEN '{\an5\pos(' || (turn % 5 * 9 + k * CASE WHEN conv_id % 4 = 1 THEN 30 ELSE 1 END) || ',' || (200 + k * 11) || ')}' ELSE '' END AS tags, CASE WHEN conv_id % 3 = 0 THEN turn % 5 * 9 + k * CASE WHEN conv_id % 4 = 1 THEN 30 ELSE 1 END END AS px, CASE WHEN conv_id % 3 = 0 THEN 200 + k * 11 END AS py,
CASE k WHEN 1 THEN replace(t, ' ', '  ') WHEN 2 THEN substr(t, 2) ELSE t END AS body FROM (SELECT conv_id, turn, replace(text, chr(10), '\n') AS t FROM conversations), (SELECT unnest([0, 1, 2]) AS k))"""
BOXES = "boxes AS (SELECT l_orderkey % 50 AS grp, l_orderkey * 10 + l_linenumber AS key, CAST(l_partkey % 640 AS INT) AS x1, CAST(l_suppkey * 7 % 360 AS INT) AS y1, CAST(l_partkey % 640 AS INT) + CAST(l_quantity AS INT) * 2 AS x2, CAST(l_suppkey * 7 % 360 AS INT) + CAST(l_quantity AS INT) % 12 AS y2 FROM lineitem)"
RATIOS = "ratios AS (SELECT CAST(l_suppkey % 20 AS VARCHAR) AS video_id, l_orderkey AS frame, 'roi_' || l_linenumber AS roi_id, l_discount * l_quantity / 10 AS ratio FROM lineitem)"
TRACK = r"""n AS (SELECT user_id AS roi, event_id AS seq, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
m AS (SELECT *, n // 2 AS pair, n % 2 AS part, n // 2 + 3 * (n // 18) + 1 AS frame, n // 12 AS spell FROM n),
p AS (SELECT *, CASE WHEN part = 0 THEN 'Line ' ELSE 'and then ' END || (spell - spell % 2 + roi % 7) || CASE WHEN roi % 6 = 3 THEN ' 字幕在这里继续显示出来' ELSE ' goes on.' END AS said, CAST([85, 4, 50][CAST(roi % 3 + 1 AS INT)] + CASE WHEN roi % 8 = 1 AND spell % 5 = 4 THEN -40 ELSE 0 END + 6 * (1 - part) AS DOUBLE) AS top FROM m),
tr AS (SELECT roi, seq, frame, CASE WHEN roi % 4 = 3 THEN 0.0 ELSE CAST(frame * CAST(0.04 AS DOUBLE) AS DOUBLE) END AS time_sec, CASE WHEN n % 11 = 0 THEN replace(said, 'n', 'm') ELSE said END AS text, CASE WHEN value > 99 THEN 0.5 ELSE 0.9 END AS score, CAST(40.0 + n % 5 AS DOUBLE) AS x, top + 2.5 AS y, top, CAST(CASE WHEN spell % 7 = 6 THEN 12.0 WHEN roi % 10 = 9 THEN 0.0 ELSE 5.0 END AS DOUBLE) AS height FROM p)"""
TIME = "printf('%d:%02d:%02d.%02d', CAST(floor({s} / 3600) AS BIGINT), CAST(floor((floor({s}) % 3600) / 60) AS BIGINT), CAST(floor({s}) % 60 AS BIGINT), CAST({c} AS BIGINT))"


def canonical(body: str) -> str:
    return rf"list_reduce(list_prepend('', list_transform(string_split_regex(replace({body}, chr(13), ''), '\\[nN]'), lambda z: regexp_replace(z, '{SPACE}', '', 'g'))), lambda a, z: CASE WHEN length(z) = 1 AND length(a) >= 6 THEN a ELSE a || z END)"


def seconds_text(s: str) -> str:
    return TIME.format(s=s, c=f"least(round_even(({s} - floor({s})) * 100, 0), 99)")


def frame_text(s: str) -> str:
    return TIME.format(s=s, c=f"floor(({s} - floor({s})) * 100)")


def parsed(t: str) -> str:
    """Seconds of a formatted time."""
    return f"(CAST(string_split({t}, ':')[1] AS INT) * 3600.0::DOUBLE + CAST(string_split({t}, ':')[2] AS INT) * 60.0::DOUBLE + CAST(string_split({t}, ':')[3] AS DOUBLE))"


def common(source: str, where: str = "true", key: str = "roi, seq") -> str:
    """CTEs to lc (key, n): the length of the longest common subsequence of a and b of the rows of ``source``.

    A row of the table is words of 60 bits, with the carry between them; by_ holds the places of each character of b.
    """
    u = "(z.vs[1] & z.vs[2])"
    word = f"{{'vs': list_append(s.vs, ((z.vs[1] + {u} + s.c) | (z.vs[1] - {u})) & ((1::BIGINT << 60) - 1)), 'c': (z.vs[1] + {u} + s.c) >> 60}}"
    turn = f"list_reduce(list_prepend({{'vs': []::BIGINT[], 'c': 0::BIGINT}}, list_transform(range(1, len(v.vs) + 1), lambda w: {{'vs': [v.vs[w], m.vs[w]], 'c': 0::BIGINT}})), lambda s, z: {word})"
    return f"""lp AS (SELECT {key}, string_split(a, '') AS xs, string_split(b, '') AS ys, (length(b) + 59) // 60 AS nw FROM {source} WHERE a <> '' AND b <> '' AND {where}),
ly AS (SELECT {key}, unnest(ys) AS ch, generate_subscripts(ys, 1) - 1 AS pos FROM lp),
lm AS (SELECT {key}, ch, pos // 60 AS w, bit_or(1::BIGINT << CAST(pos % 60 AS INT)) AS m FROM ly GROUP BY ALL),
lw AS (SELECT {key}, ch, map_from_entries(list({{'k': w, 'v': m}})) AS ws FROM lm GROUP BY ALL),
lb AS (SELECT {key}, map_from_entries(list({{'k': ch, 'v': ws}})) AS by_ FROM lw GROUP BY ALL),
le AS (SELECT {key}, nw, list_transform(xs, lambda ch: {{'vs': list_transform(range(0, nw), lambda w: coalesce(by_[ch][w], 0::BIGINT)), 'c': 0::BIGINT}}) AS els FROM lp JOIN lb USING ({key})),
lc AS (SELECT {key}, nw * 60 - list_sum(list_transform(list_reduce(list_prepend({{'vs': list_transform(range(0, nw), lambda w: (1::BIGINT << 60) - 1), 'c': 0::BIGINT}}, els), lambda v, m: {turn}).vs, lambda x: bit_count(x))) AS n FROM le)"""


def short_common(a: str, b: str) -> str:
    """The same for texts of at most 60 characters in ``b``: one word."""
    mask = f"coalesce(list_sum(list_transform(list_filter(range(1, length({b}) + 1), lambda k: string_split({b}, '')[k] = ch), lambda k: 1::BIGINT << CAST(k - 1 AS INT))), 0)::BIGINT"
    full = f"((1::BIGINT << CAST(length({b}) AS INT)) - 1)"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({b}) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({a}, ''), lambda ch: {mask})), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})) END)"


#: Frames of the track with their lines by box top, and what they are compared by.
FRAMES = f"""{TRACK},
fr AS (SELECT roi, frame, coalesce(arg_min(time_sec, seq) FILTER (time_sec > 0), 0.0) AS t, list({{'text': text, 'x': x, 'y': y, 'top': top, 'height': height}} ORDER BY top, seq) AS ls FROM tr WHERE score >= 0.6 AND NOT regexp_full_match(text, '{SPACE}*') GROUP BY roi, frame),
f AS (SELECT *, len(ls) AS n, list_sort(list_transform(ls, lambda l: l.text)) AS fp, replace(array_to_string(list_sort(list_transform(ls, lambda l: l.text)), ''), ' ', '') AS st, replace(array_to_string(list_transform(ls, lambda l: l.text), ''), ' ', '') AS tt, row_number() OVER (PARTITION BY roi ORDER BY frame) AS rn FROM fr)"""
_NEAR = "list_bool_and(list_transform(range(1, f.n + 1), lambda i: (f.ls[i].x - s.ls[i].x) ** 2 + (f.ls[i].y - s.ls[i].y) ** 2 <= 400))"
_GOES_ON = f"""f.n = len(s.ls) AND f.frame - s.frame BETWEEN 1 AND 8 AND CASE WHEN f.frame - s.frame = 1 THEN CASE WHEN f.fp = s.fp THEN {_NEAR} ELSE f.st <> '' AND s.st <> '' AND 2.0 * {short_common('f.st', 's.st')} / (length(f.st) + length(s.st)) >= 0.85 END
ELSE f.tt <> '' AND length(f.tt) = length(s.tt) AND NOT (s.t > 0 AND f.t > 0 AND f.t - s.t > 0.45) AND (f.fp = s.fp OR 2.0 * {short_common('f.tt', 's.tt')} / (length(f.tt) + length(s.tt)) >= 0.85) AND {_NEAR} END"""
_KEEP = ("ls", "fp", "st", "tt", "a_frame")
#: Runs that resemble their first frame, with its lines, and their times.
RUNS = f"""{FRAMES},
s AS (SELECT roi, rn, frame, t, ls, fp, st, tt, frame AS a_frame FROM f WHERE rn = 1
UNION ALL SELECT roi, rn, frame, t, {', '.join(f'CASE WHEN on_ THEN s_{c} ELSE {c if c != "a_frame" else "frame"} END' for c in _KEEP)} FROM (SELECT f.roi, f.rn, f.frame, f.t, f.ls, f.fp, f.st, f.tt, s.ls AS s_ls, s.fp AS s_fp, s.st AS s_st, s.tt AS s_tt, s.a_frame AS s_a_frame, {_GOES_ON} AS on_ FROM s JOIN f ON f.roi = s.roi AND f.rn = s.rn + 1)),
d AS (SELECT *, t - lag(t) OVER (PARTITION BY roi, a_frame, t > 0 ORDER BY t) AS step FROM s),
runs AS (SELECT roi, a_frame AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, arg_min(t, frame) FILTER (t > 0) AS start_sec, max(t) FILTER (t > 0) AS last_sec, list_sort(list(step) FILTER (t > 0 AND step > 0)) AS steps, any_value(ls) AS ls FROM d GROUP BY roi, a_frame HAVING max(frame) - a_frame + 1 >= 3)"""


#: Of canonical texts a and b with n, the length of what they have in common: alike. Which pairs n is needed for.
WITHIN = "(contains(a, b) OR contains(b, a))"
NEEDED = f"NOT {WITHIN} AND 2.0 * least(length(a), length(b)) / (length(a) + length(b)) >= 0.78"
SIMILAR = f"(a <> '' AND b <> '' AND ({WITHIN} OR coalesce(2.0 * n / (length(a) + length(b)) >= 0.78, false)))"


def merged(source: str) -> str:
    """CTEs from ``source`` (roi, seq, start_sec, end_sec, start_time, end_time, style, tags, px, py, body) to o (bodies) and e2 (islands)."""
    return f"""c AS (SELECT *, {canonical('body')} AS a, {parsed('start_time')} AS ts, {parsed('end_time')} AS te FROM {source}),
q AS (SELECT *, lag(a) OVER w AS b, lag(te) OVER w AS p_te, lag(style) OVER w AS p_style, lag(tags) OVER w AS p_tags, lag(px) OVER w AS p_px, lag(py) OVER w AS p_py FROM c WINDOW w AS (PARTITION BY roi ORDER BY ts, seq)),
{common('q', NEEDED)},
j AS (SELECT q.*, coalesce(CASE WHEN style = p_style AND ts - p_te BETWEEN CAST(-0.12 AS DOUBLE) AND 4.0 AND CASE WHEN style = 'Scene' AND px IS NOT NULL AND p_px IS NOT NULL THEN abs(px - p_px) <= 24 AND abs(py - p_py) <= 24 ELSE tags = p_tags END THEN {SIMILAR} ELSE false END, false) AS joins FROM q LEFT JOIN lc USING (roi, seq)),
e2 AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY roi ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM j),
v AS (SELECT roi, island, a, count(*) AS votes FROM e2 GROUP BY 1, 2, 3),
w AS (SELECT roi, island, a FROM v QUALIFY row_number() OVER (PARTITION BY roi, island ORDER BY votes DESC, length(a) DESC, a) = 1),
o AS (SELECT roi, island, body FROM e2 JOIN w USING (roi, island, a) QUALIFY row_number() OVER (PARTITION BY roi, island ORDER BY length(body) DESC, seq) = 1),
i AS (SELECT roi, island, count(*) AS n, arg_min({{'s': start_sec, 't': start_time, 'style': style, 'tags': tags}}, {{'ts': ts, 'seq': seq}}) AS head, arg_max({{'s': end_sec, 't': end_time}}, {{'ts': ts, 'seq': seq}}) AS tail, list_sort(list(px) FILTER (px IS NOT NULL)) AS xs, list_sort(list(py) FILTER (py IS NOT NULL)) AS ys FROM e2 GROUP BY roi, island),
done AS (SELECT roi, CAST(island AS BIGINT) AS island, head.s AS start_sec, tail.s AS end_sec, head.t AS start_time, tail.t AS end_time, head.style AS style, CASE WHEN n > 1 AND head.style = 'Scene' AND len(xs) > 0 THEN '{{\\an5\\pos(' || xs[len(xs) // 2 + 1] || ',' || ys[len(ys) // 2 + 1] || ')}}' ELSE head.tags END AS tags, o.body, n FROM i JOIN o USING (roi, island))"""


NOISE = r"""CASE WHEN z = '' THEN true WHEN regexp_full_match(z, '[()\[\]{}（）【】]+') THEN true WHEN regexp_full_match(z, '[0-9]+') THEN true WHEN regexp_full_match(z, '[0-9]+[A-Za-z]+|[A-Za-z]+[0-9]+') THEN length(z) <= 4 ELSE length(z) = 1 AND z NOT IN ('，', '。', '！', '？', '.', '!', '?') END"""


def bare(body: str) -> str:
    return rf"regexp_replace(regexp_replace(replace({body}, chr(13), ''), '\\[nN]', '', 'g'), '{SPACE}', '', 'g')"


def language(text: str, extra: str) -> str:
    """CTEs b and n from ``lines`` with column ``text``, keeping ``extra``."""
    return rf"""b AS (SELECT {extra}, regexp_replace({text}, '[ ,.!?''"(){{}}\[\]\p{{Nd}}-]', '', 'g') AS s FROM lines), nn AS (SELECT *, {', '.join(f"len(regexp_extract_all(s, '{p}')) AS {k.lower()}, CASE WHEN regexp_matches(s, '{p}') THEN length(regexp_extract(s, '^(.*?){p}', 1)) ELSE 2147483647 END AS {k.lower()}_at" for k, p in T.SCRIPTS.items())} FROM b),
lang AS (SELECT {extra}, CASE WHEN s = '' THEN 'EN' WHEN jp > 0 THEN 'JP' WHEN ch + ko + ru + en = 0 THEN 'JP' ELSE list_sort([{', '.join(f"{{'n': -{k}, 'at': {k}_at, 'k': '{k.upper()}'}}" for k in ("ch", "ko", "ru", "en"))}])[1].k END AS language FROM nn)"""


PROFILE = """v AS (SELECT roi, location, count(*) AS n, min(group_id) AS f, list(height) FILTER (height > 0) AS own FROM g GROUP BY 1, 2),
b AS (SELECT roi, location, n, coalesce(own, []) AS own, sum(n) OVER (PARTITION BY roi) AS total FROM v QUALIFY row_number() OVER (PARTITION BY roi ORDER BY n DESC, f) = 1),
e AS (SELECT roi, coalesce(list(height) FILTER (height > 0), []) AS every FROM g GROUP BY roi),
q AS (SELECT roi, total >= 3 AND n / total < 0.55 AS mixed, location, own, every FROM b JOIN e USING (roi)),
p AS (SELECT roi, CASE WHEN mixed THEN 'MIXED' ELSE location END AS usual, CASE WHEN mixed OR len(own) = 0 THEN list_sort(every) ELSE list_sort(own) END AS hs FROM q),
pr AS (SELECT roi, usual, coalesce(hs[len(hs) // 2 + 1], 0) AS text_height FROM p)"""
KEPT = "k AS (SELECT g.*, CASE WHEN usual IN ('UNKNOWN', 'MIXED') OR text_height <= 0 THEN true ELSE (CASE WHEN usual IN ('BOTTOM', 'TOP') THEN location <> 'SCENE' WHEN usual = 'SCENE' THEN location NOT IN ('BOTTOM', 'TOP') ELSE true END) AND height > 0 AND height / CAST(text_height AS DOUBLE) BETWEEN 0.65 AND 1.65 END AS keep FROM g JOIN pr USING (roi)), kept AS (SELECT * EXCLUDE (keep, any_kept) FROM (SELECT *, bool_or(keep) OVER (PARTITION BY roi) AS any_kept FROM k) WHERE keep OR NOT any_kept)"

_MEDIAN = "coalesce(list_sort(list_filter(list_transform(ls, lambda l: l.height), lambda h: h > 0))[len(list_filter(list_transform(ls, lambda l: l.height), lambda h: h > 0)) // 2 + 1], 0.0)"
#: The main query up to events: groups placed, held against the profile of their roi, timed, styled, without noise.
EVENTS = rf"""{RUNS},
g AS (SELECT *, start_frame AS group_id, CASE WHEN cy > 75 THEN 'BOTTOM' WHEN cy < 15 THEN 'TOP' ELSE 'SCENE' END AS location FROM (SELECT *, list_sum(list_transform(ls, lambda l: l.top + l.height / 2)) / len(ls) AS cy, {_MEDIAN} AS height FROM runs)),
{PROFILE.replace('p AS', 'pp AS').replace('FROM p)', 'FROM pp)').replace(' e AS', ' ev2 AS').replace('e AS (SELECT roi, coalesce', 'ev2 AS (SELECT roi, coalesce').replace('JOIN e USING', 'JOIN ev2 USING').replace('v AS (SELECT roi, location', 'pv AS (SELECT roi, location').replace('FROM v QUALIFY', 'FROM pv QUALIFY').replace('q AS (SELECT roi, total', 'pq AS (SELECT roi, total').replace('FROM q)', 'FROM pq)').replace('b AS (SELECT roi, location, n', 'pb AS (SELECT roi, location, n').replace('FROM b JOIN', 'FROM pb JOIN')},
{KEPT},
tm AS (SELECT roi, start_frame, location, ls, coalesce(start_sec, start_frame / 25.0::DOUBLE) AS start_sec, CASE WHEN start_sec IS NOT NULL THEN last_sec + coalesce(steps[len(steps) // 2 + 1], 0.04) ELSE (end_frame + 1) / 25.0::DOUBLE END AS end_sec, start_sec IS NOT NULL AS spoken FROM kept),
tt2 AS (SELECT *, CASE WHEN spoken THEN {seconds_text('start_sec')} ELSE {frame_text('start_sec')} END AS start_time, CASE WHEN spoken THEN {seconds_text('end_sec')} ELSE {frame_text('end_sec')} END AS end_time FROM tm),
lines AS (SELECT roi, start_frame, array_to_string(list_transform(ls, lambda l: l.text), ' ') AS txt FROM tt2),
{language('txt', 'roi, start_frame')},
sty AS (SELECT roi, start_frame * 1000 AS seq, start_sec, end_sec, start_time, end_time, CASE WHEN location = 'TOP' THEN 'Top' WHEN language = 'EN' THEN 'Default' ELSE language END AS style, CASE WHEN location = 'TOP' THEN '{{\an8}}' ELSE '' END AS tags, NULL::INT AS px, NULL::INT AS py, array_to_string(list_transform(ls, lambda l: l.text), '\n') AS body FROM tt2 JOIN lang USING (roi, start_frame) WHERE location <> 'SCENE'
UNION ALL SELECT roi, start_frame * 1000 + k - 1, start_sec, end_sec, start_time, end_time, 'Scene', '{{\an5\pos(' || CAST(trunc(ls[k].x) AS INT) || ',' || CAST(trunc(ls[k].y) AS INT) || ')}}', CAST(trunc(ls[k].x) AS INT), CAST(trunc(ls[k].y) AS INT), ls[k].text FROM tt2, unnest(generate_series(1, len(ls))) AS u(k) WHERE location = 'SCENE'),
fe AS (SELECT *, {bare('body')} AS z FROM sty),
events_ AS (SELECT * EXCLUDE (z) FROM fe WHERE NOT ({NOISE}) AND NOT (style = 'Scene' AND {parsed('end_time')} - {parsed('start_time')} > 0 AND {parsed('end_time')} - {parsed('start_time')} < 0.35 AND length({canonical('body')}) < 3)),
{merged('events_').replace('c AS (SELECT *,', 'mc AS (SELECT *,', 1).replace('FROM c WINDOW', 'FROM mc WINDOW').replace('q AS (SELECT *, lag(a)', 'mq AS (SELECT *, lag(a)').replace('AS joins FROM q LEFT', 'AS joins FROM mq LEFT').replace('SELECT q.*', 'SELECT mq.*').replace('FROM q WHERE', 'FROM mq WHERE').replace('v AS (SELECT roi, island, a, count', 'mv AS (SELECT roi, island, a, count').replace('FROM v QUALIFY row_number() OVER (PARTITION BY roi, island', 'FROM mv QUALIFY row_number() OVER (PARTITION BY roi, island')}"""

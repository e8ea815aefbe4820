"""DuckDB twins of the queries that SQL can express."""

OP10 = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, coalesce(rest, '') AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN contains(host || path, '/cgi-bin/') OR contains(host || path, '/wp-login.php') OR contains(host || path, '.adserver.')
            THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

# Sources are ranked by code point, null last; levels as in mixing.source_targets.
OP2 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS k,
                  CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS s FROM documents),
z AS (SELECT s, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY s),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM z),
x AS (SELECT *, (rank % 3) + 1 AS weight, source_size * 3 AS cap, (source_size * 3)::DOUBLE / ((rank % 3) + 1) AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
t AS (SELECT s, source_size, rank, least((max(CASE WHEN level <= ratio THEN level END) OVER ()) * weight, cap::DOUBLE) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, round(t.target)::BIGINT AS demand,
             coalesce(sum(d.size) OVER (PARTITION BY d.s ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t USING (s)),
e AS (SELECT *, CASE WHEN size > 0 THEN demand // source_size ELSE 0 END AS epochs FROM c),
p AS (SELECT *, CASE WHEN size > 0 THEN least(greatest(demand - epochs * source_size - start, 0), size) ELSE 0 END AS part FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken,
       (epochs + CASE WHEN part > 0 THEN 1 ELSE 0 END)::INTEGER AS n_copies,
       CASE WHEN epochs + part = 0 THEN NULL
            WHEN rank % 3 = 0 THEN 2 * (start / target) / (1.5 + sqrt(1.5 * 1.5 - 2 * (start / target)))
            WHEN rank % 3 = 1 THEN start / target
            WHEN start / target <= 0.375 THEN 2 * (start / target) / (0.5 + sqrt(0.5 * 0.5 + 2 * (start / target)))
            ELSE 0.5 + 2 * (start / target - 0.375) / (1.0 + sqrt(1.0 + 2 * (start / target - 0.375))) END AS position
FROM p
"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_VENDOR = (r"(?:ghp_|gho_|glpat-|xoxb-|xoxp-|sk_live_|rk_live_|AIza)[A-Za-z0-9_-]{16,}"
           r"|[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")


def _found(kind: int, regex: str) -> str:
    """Spans of one kind: the i-th starts after i + 1 pieces and i matches."""
    return f"""SELECT n, {kind} AS kind, m[i] AS match,
        list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT n, m, p, unnest(range(1, len(m) + 1)) AS i FROM
              (SELECT n, regexp_extract_all(text, '{regex}') AS m, string_split_regex(text, '{regex}') AS p FROM d))"""


OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
                  concat_ws('/', source, lang) AS repository FROM documents),
f AS ({_found(0, _ASSIGN)} UNION ALL {_found(1, r'AKIA[A-Z0-9]{16,}')} UNION ALL {_found(2, r'[0-9a-f]{24,}')} UNION ALL {_found(3, _VENDOR)}),
g AS (SELECT *, CASE WHEN kind = 0 THEN regexp_extract(match, '{_ASSIGN}', 2) ELSE match END AS secret FROM f),
s AS (SELECT n, kind, start::BIGINT AS start, (start + length(match))::BIGINT AS stop, secret,
             NOT regexp_matches(secret, '(?i)example|sample|changeme|placeholder|dummy|your[_-]|x{{4}}|0{{8}}|12345')
             AND len(list_distinct(string_split(secret, ''))) >= 6 AS live
      FROM g WHERE kind <> 0 OR length(secret) >= 6),
o AS (SELECT s.secret, count(DISTINCT d.owner) AS owners, count(DISTINCT d.repository) AS repositories FROM s JOIN d USING (n) GROUP BY s.secret),
v AS (SELECT s.*, owners, repositories, CASE WHEN owners >= 3 OR repositories >= 6 THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS verdict FROM s JOIN o USING (secret)),
k AS (SELECT *, (['assign', 'access', 'hex', 'vendor'])[kind + 1] || ':' || start || ':' || stop AS label FROM v WHERE kind < 3 OR verdict = 'live'),
a AS (SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             coalesce(string_agg(label, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, string_agg(label, ',' ORDER BY start, kind) AS spans,
             count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example,
             max(owners) AS most_owners, max(repositories) AS most_repositories FROM k GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN a USING (n)
"""


def _edit(cost: str, letter: str, to: int, turn: str | None) -> str:
    """One edit before the best rest of state ``to``: cost so far, audit, and the repaired turns with a newline before each."""
    return (f"{{'c': f[{to + 1}].c + {cost}, 'a': '{letter}' || f[{to + 1}].a, "
            f"'t': {f'chr(10) || {turn} || ' if turn else ''}f[{to + 1}].t}}")


def _inserted(state: str, role: str) -> str:
    return f"{{'c': {state}.c + 2, 'a': 'I' || {state}.a, 't': chr(10) || '{role}:' || {state}.t}}"


def _settled(b: str) -> str:
    """The best of staying and inserting, for the four states (nothing yet, system, user, assistant) of ``b``."""
    user, assistant = f"list_min([{b}[3], {_inserted(f'{b}[4]', 'assistant')}])", f"list_min([{b}[4], {_inserted(f'{b}[3]', 'user')}])"
    return ", ".join([*[f"list_min([{b}[{s}], {_inserted(user, 'user')}])" for s in (1, 2)], user, assistant])


def _options(state: int) -> str:
    to, role = (2, 2, 3, 2)[state], ("user", "user", "assistant", "user")[state]
    keeps = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]
    stays = "late + CASE WHEN gone THEN 1000000 ELSE 0 END"
    return "list_min([" + ", ".join(
        [_edit("3", "D", state, None), _edit(f"2 + {stays}", "R", to, f"'{role}:' || text"),
         *[_edit(f"{stays} + CASE WHEN initial = '{i}' THEN 0 ELSE 1000000 END", "K", k, "role || ':' || text") for i, k in keeps]]) + "])"


# CRC-32 bit by bit; then each conversation from its last turn to its first, with the best rest of each state.
OP13 = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT key, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))),
    4294967295) % 20 AS kind FROM (SELECT DISTINCT key FROM k)),
e AS (SELECT conv_id, turn, kind, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k JOIN crc USING (key) WHERE kind <> 0),
v AS (SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS p
    FROM (SELECT * FROM e UNION ALL SELECT * FROM e WHERE kind = 3) t JOIN v ON t.conv_id IS NOT DISTINCT FROM v.conv_id),
g AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY c, role, text ORDER BY p) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY p) AS before FROM o),
h AS (SELECT c, p, role, text, initial, blank OR again AS gone, CASE WHEN cut THEN 1 ELSE 0 END AS late FROM g),
s AS (SELECT c, (max(turn) - min(turn) + 1 - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY c),
r AS (SELECT c, n + 1 AS p, [{_settled("z")}] AS f FROM s, (SELECT [{{'c': 0, 'a': '', 't': ''}}, {{'c': 1000000, 'a': '', 't': ''}},
        {{'c': 1000000, 'a': '', 't': ''}}, {{'c': 0, 'a': '', 't': ''}}] AS z) t
    UNION ALL
    SELECT c, p, [{_settled("b")}] FROM (SELECT h.c, h.p, [{", ".join(map(_options, range(4)))}] AS b
        FROM r JOIN h ON h.c = r.c AND h.p = r.p - 1) t)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(f[1].c, 0)::BIGINT AS cost, coalesce(f[1].a, '') AS audit, sha256(coalesce(substr(f[1].t, 2), '')) AS repaired_sha256
FROM v LEFT JOIN s USING (c) LEFT JOIN r ON r.c = v.c AND r.p = 1
"""


def _phrases(k: int) -> str:
    """Phrases of k words: each occurrence is the k words from its place on, if its piece has them."""
    words = " || ' ' || ".join(["w", *[f"w{i}" for i in range(1, k)]])
    there = f"WHERE w{k - 1} IS NOT NULL" if k > 1 else ""
    return f"SELECT {k} AS k, lang, {words} AS phrase, count(*) AS a FROM t {there} GROUP BY lang, phrase"


OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT doc, lang, generate_subscripts(pieces, 1) AS piece, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS words FROM d),
w AS (SELECT doc, lang, piece, generate_subscripts(words, 1) AS place, unnest(words) AS w FROM p),
t AS (SELECT lang, w, lead(w) OVER q AS w1, lead(w, 2) OVER q AS w2, lead(w, 3) OVER q AS w3 FROM w WINDOW q AS (PARTITION BY doc, piece ORDER BY place)),
f AS ({" UNION ALL ".join(map(_phrases, range(1, 5)))}),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT k, lang, phrase, string_split(phrase, ' ') AS words, a FROM f WHERE k > 1 AND a >= 30),
cuts AS (SELECT c.*, cut, array_to_string(words[1:cut], ' ') AS head, array_to_string(words[cut + 1:], ' ') AS tail FROM c, range(1, 4) s(cut) WHERE cut < k),
s AS (SELECT x.k, x.lang, x.phrase, x.words, x.a, x.cut, h.a AS l, t.a AS r, (x.a::HUGEINT * 2000000 // (h.a + t.a))::BIGINT AS score
    FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head AND h.k = x.cut JOIN f t ON t.lang = x.lang AND t.phrase = x.tail AND t.k = x.k - x.cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
covers AS (SELECT lang, k - drops AS k, array_to_string(words[1 + skip:k - drops + skip], ' ') AS phrase, max(a) AS longer
    FROM c, range(1, 3) u(drops), range(0, 3) v(skip) WHERE skip <= drops AND k - drops >= 2 GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN covers o ON o.lang = b.lang AND o.k = b.k AND o.phrase = b.phrase
    WHERE o.longer IS NULL OR 100 * o.longer::HUGEINT < 80 * b.a::HUGEINT)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""

"""SQL that gives the rows of the numbered queries, for DuckDB."""

from dataquay.llm import mixing, recompression, resampling, rules, secrets, spelling

_WORD = r"[^\x20\x09-\x0D]+"


def _kind(kind: secrets.Kind, rank: int, more: str = "TRUE") -> str:
    """Spans of one kind: places from the lengths of gaps and matches, laid end to end."""
    pattern = kind.pattern.replace("'", "''")
    value = f"regexp_extract(hit, '{pattern}', {kind.group})"
    return f"""
    SELECT doc_id, start, start + length(hit) AS "end", {rank} AS rank, '{kind.name}' AS kind, {value} AS value
    FROM (SELECT doc_id, hit, sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit) AS start
          FROM (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS nth
                FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM texts)
                WHERE len(hits) > 0)
          WINDOW w AS (PARTITION BY doc_id ORDER BY nth))
    WHERE length({value}) >= {kind.least} AND {more}"""


_MIXED = " AND ".join(f"regexp_matches(regexp_extract(hit, '{secrets.LOOSE.pattern}'), '{c}')" for c in ("[0-9]", "[a-z]", "[A-Z]"))
_LIST = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(\"end\" AS BIGINT), ',' ORDER BY start, rank)"
SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_kind(k, i) for i, k in enumerate(secrets.BASE))}),
loose AS (SELECT * FROM ({_kind(secrets.LOOSE, len(secrets.BASE), _MIXED)}) l
          WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.start < l."end" AND l.start < b."end")),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
owned AS (SELECT value, count(DISTINCT source) <= {secrets.MOST_OWNERS}
                 AND count(DISTINCT source || '/' || lang) <= {secrets.MOST_REPOSITORIES} AS live
          FROM every JOIN documents USING (doc_id) GROUP BY value),
told AS (SELECT e.*, live FROM every e JOIN owned USING (value) WHERE rank < {len(secrets.BASE)} OR live),
per_base AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                    count(*) FILTER (kind = 'hex') AS n_hex, {_LIST} AS listed FROM base GROUP BY doc_id),
per_told AS (SELECT doc_id, {_LIST} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
             FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN per_base b ON b.doc_id = d.doc_id LEFT JOIN per_told t ON t.doc_id = d.doc_id"""

_WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
MIXTURE = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {_WEIGHT} END AS weight
            FROM sized GROUP BY source),
leveled AS (SELECT *, (sum(source_size) OVER () * CAST({mixing.BUDGET} AS DOUBLE)
                       - coalesce(sum({mixing.MOST} * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources WINDOW w AS (ORDER BY {mixing.MOST} * source_size / weight, source NULLS LAST)),
targets AS (SELECT source, source_size, least(CAST({mixing.MOST} * source_size AS DOUBLE),
                   weight * max(CASE WHEN level <= {mixing.MOST} * source_size / weight THEN level END) OVER ()) AS target
            FROM leveled),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                 CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated"""

_RULES = {r[0]: r for r in rules.RULES}


def _bin(rule: str) -> str:
    """The place of a ratio: itself, or above 2 ** PLACE_BITS its first bits and how many follow."""
    _, top, bottom, bins, _, _ = _RULES[rule]
    value = f"(CASE WHEN {bottom} > 0 THEN {bins} * {top} // {bottom} ELSE 0 END)"
    more = f"(length(bin({value})) - {rules.PLACE_BITS})"
    return f"CASE WHEN {value} < {1 << rules.PLACE_BITS} THEN {value} ELSE {more} * {1 << rules.PLACE_BITS - 1} + ({value} >> CAST({more} AS INTEGER)) END"


def _broken(rule: str) -> str:
    out = f"{_bin(rule)} > coalesce({', '.join(f'{t}.cuts[1][{rule!r}]' for t in ('g2', 'g1', 'g0'))})"
    if _RULES[rule][5] == "both":
        out += f" OR {_bin(rule)} < coalesce({', '.join(f'{t}.cuts[2][{rule!r}]' for t in ('g2', 'g1', 'g0'))})"
    return f"({out})"


RULES = f"""
WITH split AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS gram
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM split)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, p + unnest([0, 1, 2]) AS q FROM twice) GROUP BY doc_id),
counted AS (SELECT s.doc_id, lang, source, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
                   CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
            FROM split s LEFT JOIN repeated r ON r.doc_id = s.doc_id),
binned AS ({" UNION ALL ".join(f"SELECT lang, source, md5(t) AS name, '{r}' AS rule, {_bin(r)} AS bin FROM counted" for r in _RULES)}),
levels AS (SELECT DISTINCT 0 AS level, NULL AS lang, NULL AS source, name, rule, bin FROM binned
           UNION ALL SELECT DISTINCT 1, lang, NULL, name, rule, bin FROM binned UNION ALL SELECT DISTINCT 2, lang, source, name, rule, bin FROM binned),
points AS (SELECT level, lang, source, rule, count(*) AS n, list_sort(list(bin)) AS b FROM levels GROUP BY ALL
           HAVING count(*) >= {rules.LEAST_GROUP} OR level = 0),
quantiles AS (SELECT *, {", ".join(f"b[({q} * n + 19) // 20] AS q{q}" for q in (1, 5, 10, 15, 19))},
                     CASE rule {" ".join(f"WHEN '{r}' THEN {_RULES[r][4]}" for r in _RULES)} END AS least FROM points),
own AS (SELECT level, lang, source, rule, q10 + {rules.SPREAD} * greatest(least(q10 - q5, q15 - q10), least) AS high,
               q10 - {rules.SPREAD} * greatest(least(q10 - q5, q15 - q10), least) AS low,
               q5 + {rules.SPREAD} * greatest(q5 - q1, least) AS tail_high, q15 - {rules.SPREAD} * greatest(q19 - q15, least) AS tail_low FROM quantiles),
of_all AS (SELECT * FROM own WHERE level = 0),
of_lang AS (SELECT o.level, o.lang, o.source, o.rule, least(o.high, greatest(u.high, o.tail_high)) AS high, greatest(o.low, least(u.low, o.tail_low)) AS low
            FROM own o JOIN of_all u ON u.rule = o.rule WHERE o.level = 1),
of_source AS (SELECT o.level, o.lang, o.source, o.rule, least(o.high, greatest(u.high, o.tail_high)) AS high, greatest(o.low, least(u.low, o.tail_low)) AS low
              FROM own o JOIN of_lang u ON u.rule = o.rule AND u.lang IS NOT DISTINCT FROM o.lang WHERE o.level = 2),
cuts AS (SELECT level, lang, source, [map(list(rule ORDER BY rule), list(high ORDER BY rule)), map(list(rule ORDER BY rule), list(low ORDER BY rule))] AS cuts
         FROM (SELECT level, lang, source, rule, high, low FROM of_all UNION ALL FROM of_lang UNION ALL FROM of_source) GROUP BY level, lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words OR {" OR ".join(map(_broken, _RULES))}) AS kept
FROM counted c
LEFT JOIN cuts g2 ON g2.level = 2 AND g2.lang IS NOT DISTINCT FROM c.lang AND g2.source IS NOT DISTINCT FROM c.source
LEFT JOIN cuts g1 ON g1.level = 1 AND g1.lang IS NOT DISTINCT FROM c.lang
LEFT JOIN cuts g0 ON g0.level = 0"""

OWNERS = r"""
WITH normal AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM normal WINDOW g AS (PARTITION BY text_sha256)"""

SHARDS = f"""
WITH RECURSIVE bits AS (
  SELECT n, n AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce([4294967295] || list_transform(
           string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ',')[:-2],
           lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32,
         md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled
  FROM documents, crc),
ranked AS (
  SELECT *, (CAST(row_number() OVER (PARTITION BY source ORDER BY shuffled, doc_id, text_crc32, size) - 1 AS DOUBLE) + CAST(0.5 AS DOUBLE))
            / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS fraction FROM sized),
line AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, shuffled, doc_id, text_crc32, size) - 1 AS place,
         count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 24 // total AS INTEGER) AS shard,
       place - (place * 24 // total * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM line"""

_W = recompression.WINDOW
REPEATS = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + {_W - 1}], ' ')) AS name
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {_W - 2}, 1))) AS p FROM split)),
gone AS (SELECT DISTINCT doc_id, p + k AS p
         FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY name) AS least FROM windows), range({_W}) r(k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id LEFT JOIN removed r ON r.doc_id = s.doc_id"""

_ESCAPED = r"""regexp_replace(replace({}, '\', '\\'),
  '(<)(s>|/s>|<SYS>>|</SYS>>|\|text\|>|\|image\|>|\|audio\|>|\|document\|>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"""
CHATS = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(3 + sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
                    ELSE 23 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars,
       CAST(sum(len(regexp_extract_all(text, '{_WORD}'))) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS n_attachments
FROM turns GROUP BY conv_id"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS p FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id"""

_CRC_TABLE = """bits AS (
  SELECT n, n AS c, 0 AS k FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 of a text, with `crc` in the FROM clause."""
    return f"""CAST(xor(list_reduce([4294967295] || list_transform(
      string_split(regexp_replace(hex(encode({text})), '(..)', '\\1,', 'g'), ',')[:-2],
      lambda x: CAST('0x' || x AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT)"""


RESAMPLING = f"""
WITH RECURSIVE {_CRC_TABLE},
split AS (SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
          FROM (SELECT 'raw' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'target', NULL, text FROM benchmark)),
words AS (SELECT src, id, unnest(w) AS word FROM split),
buckets AS (SELECT word, {_crc("word")} % {resampling.BUCKETS} AS b FROM (SELECT DISTINCT word FROM words), crc),
counts AS (SELECT b, count(*) FILTER (src = 'raw') AS s, count(*) FILTER (src = 'target') AS t FROM words JOIN buckets USING (word) GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * CAST(all_s + {resampling.BUCKETS} AS DOUBLE) / ((s + 1) * CAST(all_t + {resampling.BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain
          FROM counts, totals),
weights AS (SELECT id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
            FROM words JOIN buckets USING (word) JOIN gains USING (b) WHERE src = 'raw' GROUP BY id),
scored AS (SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('{resampling.SEED}:' || CAST(s.id AS VARCHAR))[:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
           FROM split s LEFT JOIN weights g USING (id) WHERE src = 'raw'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
           FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
SELECT s.doc_id, n_features, weight, score, p.place AS rank
FROM scored s LEFT JOIN placed p ON p.doc_id = s.doc_id AND p.place <= {resampling.PERCENT} * p.n // 100"""

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{spelling.RUN}')) AS run FROM documents)
         WHERE length(run) >= {spelling.LEAST_SIGNS} GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc("CAST(doc_id AS VARCHAR) || ':' || run")} AS h FROM runs, crc),
spelt AS (SELECT n, CASE WHEN h % {spelling.TYPO_IN} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
counted AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {spelling.LEAST_SIGNS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
without AS (SELECT word, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM counted)),
near AS (SELECT a.word, b.word AS other FROM without a JOIN without b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT v.word, c.word FROM without v JOIN counted c ON c.word = v.rest
         UNION SELECT c.word, v.word FROM without v JOIN counted c ON c.word = v.rest),
best AS (SELECT x.word, count(*) AS n_near, (list(x.other ORDER BY o.n DESC, x.other))[1] AS other, max(o.n) AS other_n
         FROM near x JOIN counted o ON o.word = x.other GROUP BY x.word),
forms AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {spelling.FORM_FACTOR} * c.n THEN other END AS form,
                 CASE WHEN other_n >= {spelling.FORM_FACTOR} * c.n THEN other_n END AS form_n
          FROM counted c LEFT JOIN best b ON b.word = c.word),
chain AS (SELECT word, word AS root FROM counted UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word"""

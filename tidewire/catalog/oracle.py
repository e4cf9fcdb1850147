"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

# The Unicode white space characters, as the inside of a regex class.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def words(expr: str) -> str:
    parts = f"regexp_split_to_array({expr}, '[{SPACE}]+')"
    return rf"list_filter(list_transform({parts}, lambda w: regexp_replace(w, '^\p{{P}}+|\p{{P}}+$', '', 'g')), lambda w: w <> '')"


def split_trim(expr: str, sep: str) -> str:
    parts = f"string_split({expr}, '{sep}')"
    return f"list_filter(list_transform({parts}, lambda x: regexp_replace(x, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda x: x <> '')"


def has(regex: str) -> str:
    return f"len(list_filter(words, lambda w: regexp_matches(w, '{regex}'))) > 0"


def row(first: str, second: str) -> str:
    return (f"len(list_filter(range(1, len(words)), lambda i: regexp_matches(words[i], '{first}') "
            f"AND regexp_matches(words[i + 1], '{second}'))) > 0")


KEY = "CASE WHEN len(words) = 0 THEN repeat('0', 32) ELSE md5(array_to_string(words, ' ')) END"

RULES = {
    1: f"({has('^(?i:the)')} AND {has('^(?i:of)')}) OR {row('^(?i:and)', '(?i:tion)$')}",
    2: f"({has('^(?i:der)')} AND {has('^(?i:und)')}) OR {has('^K(?i:eit)')}",
    3: f"{row('^(?i:de)', '^(?i:la)')} OR ({has('(?i:ción)')} AND {has('^(?i:los)')})",
    4: f"{has('^(?i:pour)')} AND {has('^(?i:par)$')}",
    5: has("^(?i:th)(?i:at|is)$"),
}
GLOBS = {1: ["en"], 2: ["de"], 3: ["es"], 4: ["fr.src1"], 5: ["en", "de"]}


def affix(name: str, globs: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({name}, '{g}') OR ends_with({name}, '{g}')" for g in globs) + ")"


ACTIVE = " OR ".join(affix("src", g) for g in GLOBS.values())

ITEMS = """items AS (
  SELECT d.doc_id AS item_id, d.lang || '.' || d.source AS src, split_part(d.text, chr(10), 1) AS title, d.text AS body,
         'http://example.org/doc/' || d.doc_id AS link, e.event_type AS category, e.ts AS published
  FROM documents d JOIN events e ON e.event_id = d.doc_id)"""
TITLES = f"titles AS (SELECT doc_id AS item_id, {words('text')} AS words FROM documents)"
TEXTS = f"texts AS (SELECT doc_id, {words('text')} AS words FROM documents)"
TOKENS = f"{ITEMS}, toks AS (SELECT *, {words('body')} AS words FROM items), keyed AS (SELECT *, {KEY} AS key FROM toks)"
HEADLINES = ("headlines AS (SELECT doc_id, unnest(range(len(parts)))::INTEGER AS part, unnest(parts) AS title "
             r"FROM (SELECT doc_id, regexp_split_to_array(text, '[.\n]') AS parts FROM documents))")
SOURCES = "sources AS (SELECT DISTINCT lang, source, lang || '.' || source AS name FROM documents)"


WANTED = (f"CASE WHEN starts_with(src, 'en.') THEN {affix('category', ['click', 'up'])} "
          f"WHEN starts_with(src, 'de.') THEN {affix('category', ['err'])} ELSE true END")


def rule_rows(scoped: bool = False, wanted: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT *, {n} AS filter_id FROM keyed WHERE ({ACTIVE}) AND ({wanted}) AND ({test})" + (f" AND {affix('src', GLOBS[n])}" if scoped else "")
        for n, test in RULES.items())


FILTER_PUBS = """filter_pubs(filter_id, pub) AS (VALUES (1, 'main'), (2, 'main'), (2, 'info'), (3, 'info'),
            (4, 'main'), (4, 'info'), (4, 'ops'), (4, 'archive'), (5, 'ops'))"""


def routed(scoped: bool = False, wanted: str = "true") -> str:
    return f"""{TOKENS}, matches AS ({rule_rows(scoped, wanted)}),
  first AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY key ORDER BY published, item_id) AS n
            FROM (SELECT DISTINCT item_id, key, published FROM matches)) WHERE n = 1),
  {FILTER_PUBS},
  routed AS (SELECT DISTINCT m.item_id, p.pub, m.title, m.link, m.src, m.published
             FROM matches m JOIN first USING (item_id) JOIN filter_pubs p USING (filter_id))"""


CAPPED = f"""{routed()}, capped AS (SELECT *, CASE WHEN row_number() OVER (
    PARTITION BY pub, date_trunc('hour', published) ORDER BY published, item_id) <= 2 THEN 'pub_send' ELSE 'pub_full' END AS event
  FROM routed)"""
MESSAGE = "'*' || title || '* ' || strftime(published, '%d.%m %H:%M') || ' ' || chr(10) || src || ' ' || link"


def escaped(expr: str) -> str:
    return f"replace(url_encode({expr}), '%20', '+')"


DIGITS = "CASE WHEN item_id < 1000 THEN lpad(CAST(item_id AS VARCHAR), 3, '0') ELSE CAST(item_id AS VARCHAR) END"
WATCH = f"""watch AS (
  SELECT CAST(item_id AS INTEGER) AS filter_id, translate(text, '.' || chr(10) || ',', ';;&') AS cond,
         CASE WHEN item_id % 4 = 0 THEN [] ELSE ['src' || (item_id % 20)] END AS sources,
         [{DIGITS}, 'Supplier#00000' || reverse({DIGITS})] AS pubs FROM benchmark)"""
TERMS = f"""{WATCH},
  conjs AS (SELECT filter_id, unnest(range(len(l)))::INTEGER AS conj_id, unnest(l) AS conj
            FROM (SELECT filter_id, {split_trim('cond', ';')} AS l FROM watch)),
  seqs AS (SELECT filter_id, conj_id, conj, unnest(range(len(l)))::INTEGER AS seq_id, unnest(l) AS seq_text
           FROM (SELECT *, {split_trim('conj', '&')} AS l FROM conjs)),
  lists AS (SELECT *, {split_trim('seq_text', ' ')} AS patterns FROM seqs),
  terms AS (SELECT filter_id, conj_id, seq_id, unnest(range(len(patterns)))::INTEGER AS pos, unnest(patterns) AS pattern FROM lists)"""
SPOILED_TERMS = TERMS.replace("translate(text, '.' || chr(10) || ',', ';;&') AS cond", """CASE item_id % 5
         WHEN 0 THEN translate(text, '.' || chr(10) || ',', ';;&') || '; ends$$ here' WHEN 1 THEN translate(text, '.' || chr(10) || ',', ';;&') || '; a & b\\(; a'
         WHEN 2 THEN NULL WHEN 3 THEN translate(text, '.' || chr(10) || ',', ';;&') || '; x y & x y; x' ELSE translate(text, '.' || chr(10) || ',', ';;&') END AS cond""")
_WATCH_COND = "translate(text, '.' || chr(10) || ',', ';;&') AS cond"
_FIRST, _SECOND = (rf"regexp_extract(text, '^(\p{{L}}+) (\p{{L}}+)', {n})" for n in (1, 2))
WIDENED_TERMS = TERMS.replace(_WATCH_COND, f"""{_WATCH_COND[:-8]} || CASE WHEN {_FIRST} = '' THEN '' ELSE
         '; ' || left({_FIRST}, 2) || ' ' || left({_SECOND}, 2) || '; *' || substr({_FIRST}, 2) || '; ' || {_FIRST} || '$ & ' || {_FIRST} END AS cond""")
# patterns made of letters only: lower-case runs match either case, the start is anchored
FOUND = rf"""{TERMS}, {TITLES},
  tokens AS (SELECT item_id, unnest(range(len(words))) AS place, unnest(words) AS word FROM titles),
  regexes AS (SELECT DISTINCT pattern, lower(pattern) AS low, '^' || regexp_replace(pattern, '(\p{{Ll}}[^\p{{Lu}}]*)', '(?i:\1)', 'g') AS regex FROM terms),
  hits AS (SELECT word, pattern FROM (SELECT DISTINCT word, lower(word) AS lw FROM tokens) JOIN regexes
           ON left(lw, 1) = left(low, 1) AND starts_with(lw, low) WHERE regexp_matches(word, regex)),
  occurrences AS (SELECT item_id, place, pattern FROM tokens JOIN hits USING (word)),
  whole AS (SELECT DISTINCT item_id, filter_id, conj_id, array_to_string(patterns, ' ') AS seq FROM (
      SELECT o.item_id, t.filter_id, t.conj_id, t.seq_id, o.place - t.pos AS start, count(*) AS n
      FROM occurrences o JOIN terms t USING (pattern) GROUP BY ALL)
    JOIN lists USING (filter_id, conj_id, seq_id) WHERE n = len(patterns)),
  sizes AS (SELECT filter_id, conj_id, count(DISTINCT array_to_string(patterns, ' ')) AS size FROM lists GROUP BY ALL),
  conj_found AS (SELECT item_id, filter_id, conj_id, count(*) AS found, any_value(size) AS size
                 FROM whole JOIN sizes USING (filter_id, conj_id) GROUP BY ALL HAVING count(*) = any_value(size))"""
NAMED = "(len(globs) = 0 OR len(list_filter(globs, lambda g: starts_with(name, g) OR ends_with(name, g))) > 0)"

THROTTLED = """ordered AS (SELECT user_id, ts, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  walk AS (SELECT user_id, ts, id, n, ts AS kept, true AS keep FROM ordered WHERE n = 1
    UNION ALL SELECT o.user_id, o.ts, o.id, o.n, CASE WHEN o.ts >= w.kept + INTERVAL 6 HOUR THEN o.ts ELSE w.kept END,
                     o.ts >= w.kept + INTERVAL 6 HOUR
    FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.n = w.n + 1)"""
MUTED = "(hour(ts) - 20 + 24) % 24 < (5 - 20 + 24) % 24"
def fifo(rows: str) -> str:
    return f"""ordered AS (SELECT item_id, src, key, published, row_number() OVER (PARTITION BY src ORDER BY published, item_id) AS n FROM {rows}),
  walk AS (SELECT item_id, src, key, published, n, [key] AS kept, true AS keep FROM ordered WHERE n = 1
    UNION ALL SELECT o.item_id, o.src, o.key, o.published, o.n,
        CASE WHEN list_contains(w.kept, o.key) THEN w.kept
             WHEN len(w.kept) >= 4 THEN list_append(w.kept[2:], o.key) ELSE list_append(w.kept, o.key) END,
        NOT list_contains(w.kept, o.key)
    FROM walk w JOIN ordered o ON o.src = w.src AND o.n = w.n + 1)"""


FIFO = f"WITH RECURSIVE {TOKENS}, {fifo('keyed')} SELECT item_id, src, key, published FROM walk WHERE keep"
SOURCE_PULLS = f"""{ITEMS},
  numbered AS (SELECT src, published AS ts, item_id AS id, CAST(regexp_extract(src, '[0-9]+$') AS INTEGER) AS number FROM items),
  timed AS (SELECT *, CASE number % 3 WHEN 1 THEN INTERVAL 6 HOUR WHEN 2 THEN INTERVAL 36 HOUR ELSE INTERVAL 15 MINUTE END AS cool,
                   row_number() OVER (PARTITION BY src ORDER BY ts, id) AS n FROM numbered),
  walk AS (SELECT src, ts, id, number, n, ts AS kept, true AS keep FROM timed WHERE n = 1
    UNION ALL SELECT o.src, o.ts, o.id, o.number, o.n, CASE WHEN o.ts >= w.kept + o.cool THEN o.ts ELSE w.kept END, o.ts >= w.kept + o.cool
    FROM walk w JOIN timed o ON o.src = w.src AND o.n = w.n + 1)"""
BLANK = f"title IS NULL OR regexp_full_match(title, '[{SPACE}]*')"

ORACLE: dict[str, str] = {
    "scan_items": f"WITH {ITEMS} SELECT item_id, src, title, link, category AS categories, published FROM items",
    "scan_page_items": "SELECT page_id AS item_id, 'web.pages' AS src, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, url AS link FROM pages",
    "scan_feed_xml": f"WITH {ITEMS} SELECT title, link, category AS categories, date_trunc('second', published) AS published FROM items",
    "scan_multi_link": f"WITH {ITEMS} SELECT src, title, link, date_trunc('second', published) AS published FROM items",
    "receive_counts": "SELECT lang || '.' || source AS src, count(*) AS n FROM documents GROUP BY 1",
    "parse_pubdate": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 3 HOUR WHEN 3 THEN date_trunc('second', ts) + INTERVAL 5 HOUR
      WHEN 2 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS published FROM events""",
    "tokenize": f"WITH {TITLES} SELECT item_id, array_to_string(words, '|') AS words FROM titles",
    "tokenize_text": f"WITH {TEXTS} SELECT doc_id, len(words)::INTEGER AS n_words, md5(array_to_string(words, '|')) AS digest FROM texts",
    "is_blank": f"WITH {HEADLINES} SELECT doc_id, part, {BLANK} AS blank FROM headlines",
    "split_trim": f"WITH p AS (SELECT doc_id, {split_trim('text', ',')} AS parts FROM documents) "
                  "SELECT doc_id, len(parts)::INTEGER AS n_parts, md5(array_to_string(parts, '|')) AS digest FROM p",
    "dedup_key": f"WITH {TITLES} SELECT item_id, {KEY} AS key FROM titles",
    "dedup_capacity": f"WITH {TITLES}, k AS (SELECT {KEY} AS key FROM titles) SELECT count(DISTINCT key) AS keys, count(DISTINCT key) <= 8192 AS fits FROM k",
    "set_index_of": f"WITH {TITLES} SELECT item_id, coalesce(list_position(words, 'of'), 0) - 1 AS at FROM titles",
    "set_contains": f"WITH {TITLES} SELECT item_id, list_contains(words, 'the') AS found FROM titles",
    "set_append": f"WITH {TITLES} SELECT item_id, array_to_string(CASE WHEN list_contains(words, 'the') THEN words ELSE list_append(words, 'the') END, '|') AS words FROM titles",
    "valid_items": f"WITH {HEADLINES} SELECT doc_id, part, title FROM headlines WHERE NOT ({BLANK})",
    "rejected_items": f"WITH {HEADLINES} SELECT doc_id, part, title FROM headlines WHERE {BLANK}",
    "pattern_match": f"WITH {TITLES}, w AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM titles)) " + " UNION ALL ".join(
        f"SELECT word, '{pattern}' AS pattern FROM w WHERE regexp_matches(word, '{regex}')" for pattern, regex in {
            "the": "^(?i:the)", "of": "^(?i:of)", "and": "^(?i:and)", "*tion$": "(?i:tion)$", "der": "^(?i:der)",
            "und": "^(?i:und)", "Keit": "^K(?i:eit)", "de": "^(?i:de)", "la": "^(?i:la)", "*ción": "(?i:ción)",
            "los": "^(?i:los)", "pour": "^(?i:pour)", "par$": "^(?i:par)$", "th(at|is)$": "^(?i:th)(?i:at|is)$"}.items()),
    "seq_match": f"WITH {TEXTS} SELECT doc_id, 'de la' AS seq FROM texts WHERE {row('^(?i:de)', '^(?i:la)')} "
                 f"UNION ALL SELECT doc_id, 'and *tion$' AS seq FROM texts WHERE {row('^(?i:and)', '(?i:tion)$')}",
    "conj_match": f"WITH {TEXTS} SELECT doc_id FROM texts WHERE {has('^(?i:the)')} AND {has('^(?i:of)')} AND {row('^(?i:with)', '^(?i:the)')}",
    "dnf_match": f"WITH {TEXTS} " + " UNION ALL ".join(f"SELECT doc_id, {n} AS filter_id FROM texts WHERE {test}" for n, test in RULES.items()),
    "rule_terms": f"WITH {TERMS} SELECT filter_id, conj_id, seq_id, pos, pattern FROM terms",
    "rule_lint": f"""WITH {SPOILED_TERMS},
      ranked AS (SELECT l.*, array_to_string(patterns, ' ') AS seq, count(*) OVER (PARTITION BY filter_id, conj_id) AS size,
                        row(contains(conj, '&'), strlen(conj), conj_id, seq_id) AS rank FROM lists l),
      each AS (SELECT filter_id, seq, any_value(patterns) AS patterns, min(rank) AS rank, min(size) AS least, max(size) AS most FROM ranked GROUP BY ALL)
      SELECT DISTINCT b.filter_id, CASE WHEN a.rank < b.rank THEN 'PREFIX_DUP' ELSE 'SHADOWED' END AS code,
             CASE WHEN a.rank < b.rank THEN b.seq ELSE a.seq END AS seq
      FROM each a JOIN each b ON a.filter_id = b.filter_id AND len(a.patterns) < len(b.patterns) AND b.patterns[1:len(a.patterns)] = a.patterns
      UNION ALL SELECT filter_id, 'ALWAYS_TRUE_CONJ', seq FROM each WHERE least = 1 AND most > 1
      UNION ALL SELECT DISTINCT filter_id, 'REPEATED_IN_CONJ', seq FROM ranked GROUP BY filter_id, conj_id, seq HAVING count(*) > 1
      UNION ALL SELECT DISTINCT filter_id, 'BAD_PATTERN', pattern FROM terms WHERE pattern IN ('ends$$', 'b\\(')
      UNION ALL SELECT filter_id, 'NO_CONDITION', '' FROM watch WHERE filter_id NOT IN (SELECT filter_id FROM terms)""",
    # patterns of letters, a star before them or a dollar after them: the one stands inside the other, letter by letter
    "rule_subsumed": f"""WITH {WIDENED_TERMS},
      plain AS (SELECT *, starts_with(pattern, '*') AS star, ends_with(pattern, '$') AS whole, trim(pattern, '*$') AS body FROM terms),
      met AS (SELECT a.filter_id, a.conj_id, a.seq_id, b.conj_id AS by_conj, b.seq_id AS by_seq, a.pos - b.pos AS shift, count(*) AS n
              FROM plain a JOIN plain b ON a.filter_id = b.filter_id AND a.conj_id <> b.conj_id
              AND len(list_filter(range(0, length(a.body) - length(b.body) + 1), lambda k:
                  (b.star OR (NOT a.star AND k = 0)) AND (NOT b.whole OR (a.whole AND k + length(b.body) = length(a.body)))
                  AND len(list_filter(range(1, length(b.body) + 1), lambda i: b.body[i] <> a.body[k + i] AND b.body[i] <> lower(a.body[k + i]))) = 0)) > 0
              GROUP BY ALL),
      sizes AS (SELECT filter_id, conj_id AS by_conj, seq_id AS by_seq, count(*) AS n FROM plain GROUP BY ALL),
      held AS (SELECT filter_id, conj_id, by_conj, count(DISTINCT by_seq) AS n FROM met SEMI JOIN sizes USING (filter_id, by_conj, by_seq, n) GROUP BY ALL),
      pairs AS (SELECT filter_id, conj_id, by_conj FROM held SEMI JOIN (SELECT filter_id, by_conj, count(*) AS n FROM sizes GROUP BY ALL) USING (filter_id, by_conj, n))
      SELECT p.filter_id, p.conj_id, p.by_conj FROM pairs p LEFT JOIN pairs q ON p.filter_id = q.filter_id AND p.conj_id = q.by_conj AND p.by_conj = q.conj_id
      WHERE q.by_conj IS NULL OR p.conj_id > p.by_conj""",
    "conj_by_count": f"WITH {FOUND} SELECT item_id, filter_id, conj_id, found FROM conj_found",
    "affix_match_pairs": f"WITH {SOURCES}, {WATCH} SELECT name, filter_id FROM sources, (SELECT filter_id, sources AS globs FROM watch) WHERE {NAMED}",
    "affix_match": f"WITH {ITEMS} SELECT item_id, starts_with(src, 'en') OR ends_with(src, 'en') OR starts_with(src, 'src' || (item_id % 20)) "
                   "OR ends_with(src, 'src' || (item_id % 20)) AS matches FROM items",
    "category_prefilter": f"WITH {ITEMS} SELECT item_id, src FROM items WHERE {WANTED}",
    "source_agency": f"WITH {SOURCES} SELECT name, lang AS agency FROM sources",
    "active_sources": f"WITH s AS (SELECT DISTINCT lang || '.' || source AS src FROM documents) SELECT src AS name FROM s WHERE {ACTIVE}",
    "orphan_sources": f"WITH s AS (SELECT DISTINCT lang || '.' || source AS src FROM documents) SELECT src AS name FROM s WHERE NOT ({ACTIVE})",
    "filter_pubs": f"WITH {WATCH} SELECT filter_id, name AS pub FROM (SELECT s_name AS name FROM supplier), (SELECT filter_id, pubs AS globs FROM watch) WHERE {NAMED}",
    "orphan_pubs": f"WITH {WATCH}, p AS (SELECT s_name AS name FROM supplier) SELECT name FROM p WHERE NOT EXISTS "
                   f"(SELECT 1 FROM (SELECT pubs AS globs FROM watch) WHERE {NAMED})",
    "config_check": f"""WITH {TERMS}, {SOURCES}, picky AS (SELECT * FROM watch WHERE len(sources) > 0),
      spoiled AS (SELECT name, 1 AS links FROM sources UNION ALL SELECT name, 1 FROM sources WHERE name LIKE '%.src7'
                  UNION ALL SELECT ' ', 0 FROM sources WHERE name = 'en.src1'),
      p AS (SELECT s_name AS name FROM supplier)
      SELECT 'sources' AS "table", name, 'duplicate' AS problem FROM spoiled GROUP BY name HAVING count(*) > 1
      UNION ALL SELECT 'pubs', name, 'duplicate' FROM p GROUP BY name HAVING count(*) > 1
      UNION ALL SELECT 'sources', name, 'name required' FROM spoiled WHERE trim(name) = ''
      UNION ALL SELECT 'sources', name, 'no links' FROM spoiled WHERE links = 0
      UNION ALL SELECT 'sources', name, 'no filter' FROM spoiled WHERE NOT EXISTS (SELECT 1 FROM (SELECT sources AS globs FROM picky) WHERE {NAMED})
      UNION ALL SELECT 'pubs', name, 'no filter' FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT pubs AS globs FROM picky) WHERE {NAMED})
      UNION ALL SELECT 'filters', '', 'no filters' WHERE NOT EXISTS (SELECT 1 FROM picky)
      UNION ALL SELECT 'filters', CAST(filter_id AS VARCHAR), 'never matches' FROM picky WHERE filter_id NOT IN (SELECT filter_id FROM terms)""",
    "item_source": f"WITH {ITEMS} SELECT item_id, src, 'feeds/' || replace(src, '.', '/') AS links, 20 AS mute_begin, 5 AS mute_end FROM items",
    "item_matches": f"WITH {TOKENS}, m AS ({rule_rows()}) SELECT item_id, filter_id FROM m",
    "watch_matches": f"WITH {FOUND} SELECT DISTINCT item_id, filter_id FROM conj_found",
    "matched_items": f"WITH {TOKENS}, m AS ({rule_rows()}) SELECT DISTINCT item_id FROM m",
    "dedup_first": f"WITH {TOKENS} SELECT item_id, src, key, published FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY published, item_id) AS n FROM keyed) WHERE n = 1",
    "dedup_fifo": FIFO,
    "route_items": f"WITH {routed()} SELECT item_id, pub FROM routed",
    "route_items_scoped": f"WITH {routed(True)} SELECT item_id, pub FROM routed",
    "item_pub_sets": f"WITH {routed()} SELECT item_id, string_agg(pub, '|' ORDER BY pub) AS pubs FROM routed GROUP BY item_id",
    "audit_log": f"WITH {routed()} SELECT pub, item_id, title, link, src, published FROM routed",
    "date_fmt": "SELECT event_id, strftime(ts, '%d.%m %H:%M') AS date_fmt FROM events",
    "render_message": f"WITH {ITEMS} SELECT item_id, {MESSAGE} AS message FROM items",
    "url_escape": f"SELECT doc_id, {escaped('text')} AS escaped FROM documents",
    "outbox": f"WITH {CAPPED}, m AS (SELECT *, {MESSAGE} AS message FROM capped) "
              f"SELECT pub, item_id, message, 'http://example.org/send?text=' || {escaped('message')} AS url, event FROM m",
    "delivery_cap": f"WITH {CAPPED} SELECT item_id, pub, event FROM capped",
    "delivery_report": f"WITH {CAPPED} SELECT pub, event, count(*) AS n FROM capped GROUP BY ALL",
    "mute_hours": f"SELECT event_id AS id, user_id, ts FROM events WHERE NOT ({MUTED})",
    "throttle": f"WITH RECURSIVE {THROTTLED} SELECT user_id, ts, id FROM walk WHERE keep",
    "throttle_then_mute": f"WITH RECURSIVE {THROTTLED} SELECT user_id, ts, id FROM walk WHERE keep AND NOT ({MUTED})",
    "stream_route": f"WITH {routed()} SELECT DISTINCT key, pub FROM matches JOIN filter_pubs USING (filter_id)",
    "stream_dedup": f"WITH {TITLES} SELECT DISTINCT {KEY} AS key FROM titles",
}
ORACLE["watch_routes"] = f"""WITH {FOUND}, {ITEMS},
  matches AS (SELECT DISTINCT item_id, filter_id FROM conj_found),
  keyed AS (SELECT item_id, published, {KEY} AS key FROM items JOIN titles USING (item_id)),
  first AS (SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY key ORDER BY published, item_id) AS n
            FROM (SELECT DISTINCT item_id FROM matches) JOIN keyed USING (item_id)) WHERE n = 1),
  resolved AS (SELECT filter_id, name AS pub FROM (SELECT s_name AS name FROM supplier), (SELECT filter_id, pubs AS globs FROM watch) WHERE {NAMED})
SELECT DISTINCT item_id, pub FROM matches JOIN first USING (item_id) JOIN resolved USING (filter_id)"""
ORACLE["item_matches_vocab"] = ORACLE["item_matches"]
ORACLE["stream_throttle"] = ORACLE["throttle"]
ORACLE["stream_dedup_fifo"] = ORACLE["dedup_fifo"]
ORACLE["watch_routes_columns"] = ORACLE["watch_routes"]
ORACLE["route_pipeline"] = f"WITH {routed(True, WANTED)} SELECT item_id, pub FROM routed"
ORACLE["route_fifo"] = f"""WITH RECURSIVE {TOKENS}, matches AS ({rule_rows()}), {FILTER_PUBS},
  found AS (SELECT DISTINCT item_id, src, key, published FROM matches), {fifo('found')}
SELECT DISTINCT m.item_id, p.pub FROM matches m JOIN (SELECT item_id FROM walk WHERE keep) USING (item_id) JOIN filter_pubs p USING (filter_id)"""
ORACLE["route_pages"] = f"""WITH keyed AS (SELECT *, {KEY} AS key FROM (
    SELECT page_id AS item_id, {words("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS words FROM pages)),
  matches AS ({" UNION ALL ".join(f"SELECT *, {n} AS filter_id FROM keyed WHERE {test}" for n, test in RULES.items())}), {FILTER_PUBS},
  first AS (SELECT key, min(item_id) AS item_id FROM matches GROUP BY key)
SELECT DISTINCT m.item_id, p.pub FROM matches m JOIN first USING (item_id) JOIN filter_pubs p USING (filter_id)"""
ORACLE["source_throttle"] = f"WITH RECURSIVE {SOURCE_PULLS} SELECT src, ts, id FROM walk WHERE keep AND NOT (number % 2 = 0 AND ({MUTED}))"
ORACLE["stream_source_throttle"] = ORACLE["source_throttle"]
ORACLE["stream_outbox"] = f"""WITH {routed(True, WANTED)}, m AS (SELECT *, {MESSAGE} AS message FROM routed)
SELECT pub, message, 'http://example.org/send?text=' || {escaped('message')} AS url FROM m"""
ORACLE["stream_throttle_late"] = ORACLE["throttle"]
ORACLE["stream_delivery_cap"] = ORACLE["delivery_cap"]
ORACLE["stream_delivery_report"] = ORACLE["delivery_report"]
ORACLE["stream_capacity"] = f"WITH {TOKENS} SELECT src, least(count(DISTINCT key), 4) AS keys FROM keyed GROUP BY src"
ORACLE["stream_outbox_errors"] = f"""WITH {routed(True, WANTED)}, m AS (SELECT *, {MESSAGE} AS message FROM routed)
SELECT pub, message, 'ValueError: ' || length(message) || ' characters for ' || pub AS error FROM m WHERE length(message) > 100"""
ORACLE["receive_report"] = f"""WITH {ITEMS} SELECT src AS link, count(*) AS received, count(*) FILTER (item_id % 7 = 0) AS rejected,
  least(count(*) FILTER (item_id % 10 = 3), 1) AS broken FROM items GROUP BY src"""
ORACLE["stream_receive_report"] = ORACLE["receive_report"]
ORACLE["sql_functions"] = f"""WITH {TOKENS} SELECT item_id, key, len(words)::INTEGER AS n_words, {BLANK} AS blank, len({split_trim('body', ',')})::INTEGER AS n_parts,
  {affix('src', ['en', 'src1'])} AS affix, split_part(src, '.', 1) AS agency, strftime(published, '%d.%m %H:%M') AS date_fmt,
  hour(published) >= 20 OR hour(published) < 5 AS muted, 'http://example.org/send?text=' || {escaped('title')} AS url FROM keyed"""
ORACLE["sql_route"] = ORACLE["route_items"]
ORACLE["sql_throttle"] = ORACLE["throttle"]

"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm import alignment, common, html, importance, language, lines, merkle, mixture, packing, quality, secrets, shards, shingle_join, urls
from tidewire.session import temporary_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@register
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences of 2048 tokens."""
    return packing.pack_documents(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op4_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source."""
    return mixture.mix(common.documents(spark, sf_dir))


@register
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 16 shards of one mixture."""
    return shards.shard_documents(common.documents(spark, sf_dir))


@register
def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents, of their edited texts, and how near these and the next are."""
    return merkle.fingerprints(common.documents(spark, sf_dir))


@register
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the smallest document that links of 3-word shingles reach from them."""
    return shingle_join.link(common.documents(spark, sf_dir))


@register
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents, by trees trained on ``labels``."""
    docs = common.documents(spark, sf_dir)
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@register
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that many sources share."""
    return lines.dedup_lines(common.documents(spark, sf_dir))


ORACLE["op7_lines"] = f"""
WITH split AS (
  SELECT doc_id, source, u.line, u.pos
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
trimmed AS (SELECT *, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS body FROM split),
wordy AS (SELECT * FROM trimmed WHERE body <> ''),
shared AS (SELECT body, coalesce(min(doc_id), {lines.NO_ID}) AS owner FROM wordy GROUP BY body HAVING count(DISTINCT source) >= {lines.SITES}),
firsts AS (SELECT w.body, w.doc_id, min(w.pos) AS first FROM wordy w JOIN shared s ON s.body = w.body AND s.owner = w.doc_id GROUP BY ALL),
gone AS (
  SELECT w.doc_id, w.pos FROM wordy w JOIN shared s USING (body) LEFT JOIN firsts f ON f.body = w.body AND f.doc_id = w.doc_id
  WHERE f.first IS NULL OR w.pos > f.first)
SELECT d.doc_id, coalesce(k.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text, coalesce(g.n, 0)::BIGINT AS n_removed
FROM documents d
LEFT JOIN (SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.pos) AS text FROM split s
           WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = s.doc_id AND g.pos = s.pos) GROUP BY s.doc_id) k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""


@register
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return language.identify(common.documents(spark, sf_dir))


@register
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return urls.judge_pages(spark, sf_dir)


@register
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages. The known texts are those of the documents whose number ends a page's path."""
    pages = common.pages(spark, sf_dir)
    numbered = pages.select(common.shown_document("url").alias("doc_id"), "html")
    return html.extract_pages(pages, html.fit(numbered, common.documents(spark, sf_dir)))


@register
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by how much they are like ``benchmark``, the drawn tenth ranked."""
    return importance.resample(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by a ledger of their own."""
    return secrets.scan_documents(common.documents(spark, sf_dir), temporary_dir(spark, "ledger"))


@register
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in the tokens of two tokenizers, aligned."""
    return alignment.align_documents(
        common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def hexadecimal(digits: str) -> str:
    return f"CAST('0x' || {digits} AS BIGINT)"


ORACLE["op4_mixture"] = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS place,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         2 * source_size AS stop, sum(source_size) OVER () AS whole FROM sizes),
levels AS (
  SELECT *, row_number() OVER stops AS turn,
         (whole * 1.5::DOUBLE - coalesce(sum(stop) OVER (stops ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (stops ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighted WINDOW stops AS (ORDER BY stop / weight, place)),
final AS (SELECT min_by(level, turn) AS level FROM levels WHERE level * weight <= stop),
targets AS (SELECT l.source, l.source_size, l.n, least(l.stop::DOUBLE, l.weight * f.level) AS target FROM levels l, final f),
drawn AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN round(t.target / t.source_size * {mixture.UNIT})::BIGINT ELSE 0 END AS rate,
         {hexadecimal(f"substr(md5('{mixture.SEED}|' || coalesce(s.source, '')), 1, 6)")} % {mixture.UNIT} AS shift,
         floor(2 * (ln(s.size + 1) / ln(2)))::INTEGER AS class, sqrt(t.n) AS width,
         md5('{mixture.SEED}|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.size) AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, floor({hexadecimal("substr(draw, 1, 8)")} / 4294967296.0::DOUBLE * greatest(1.0, least(width, pow(width, 2) / 128)))::BIGINT AS slot FROM drawn),
summed AS (
  SELECT *, shift + sum(rate) OVER (PARTITION BY source ORDER BY class, slot, size, draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - rate AS start FROM placed)
SELECT doc_id, size, source_size, target, (size * (((start + rate)::BIGINT >> 24) - (start::BIGINT >> 24)))::BIGINT AS taken FROM summed
"""

CRC_TABLE = ("list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), "
             "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))")
ORACLE["op9_shards"] = f"""
WITH sized AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS raw FROM documents),
crc AS (SELECT {CRC_TABLE} AS steps),
summed AS (
  SELECT doc_id, source, (len(raw) // 2 + 1)::BIGINT AS size,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(raw) // 2), lambda i: CAST('0x' || substr(raw, 2 * i + 1, 2) AS BIGINT))),
             lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM sized, crc),
ranked AS (
  SELECT *, md5(concat_ws('|', '{shards.SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), size, text_crc32)) AS draw,
         count(*) OVER (PARTITION BY source) AS n FROM summed),
fractions AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY draw) - 1) + 1) / (2 * n)::DOUBLE AS fraction FROM ranked),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, draw) - 1 AS place, count(*) OVER () AS total FROM fractions)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {shards.SHARDS} // total)::INTEGER AS shard,
       place - ((place * {shards.SHARDS} // total) * total + {shards.SHARDS - 1}) // {shards.SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""

ORACLE["op5_ngram_join"] = """
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM ways UNION SELECT r.node, l.b FROM reach r JOIN ways l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(other) AS low FROM reach GROUP BY node) m USING (doc_id)
"""


def sql_let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def merkle_print(text: str) -> str:
    def cut(n: int) -> str:
        return f"regexp_extract_all(p, '(?s)[^.!?]{{0,{n - 1}}}(?:[.!?]+\\s*|[^.!?]|$)')"

    def node(hashes: str, spelled: str, level: int) -> str:
        return sql_let(f"md5(coalesce(array_to_string({hashes}, ''), ''))", f"h{level}",
                       f"{{'hash': h{level}, 'spelled': substr(h{level}, 1, {merkle.NODE}) || '{merkle.OPENS[level]}' || coalesce(array_to_string({spelled}, '{merkle.PARTS[level + 1]}'), '')}}")

    cuts = f"list_filter(CASE WHEN length(p) < {merkle.SHORT} THEN {cut(merkle.FINE)} ELSE {cut(merkle.PIECE)} END, lambda q: q <> '')"
    paragraph = sql_let(f"list_transform({cuts}, lambda q: md5(q))", "leaves", node("leaves", f"list_transform(leaves, lambda q: substr(q, 1, {merkle.LEAF}))", 1))
    section = sql_let(f"list_transform(string_split(s, chr(10)), lambda p: {paragraph})", "ps",
                      node("list_transform(ps, lambda q: q.hash)", "list_transform(ps, lambda q: q.spelled)", 0))
    blank = "'\n[\t\f\r\v ]*\n'"
    gaps = f"coalesce(array_to_string(list_transform(regexp_extract_all({text}, {blank}), lambda g: md5(g)), ''), '')"
    return sql_let(f"list_transform(regexp_split_to_array({text}, {blank}), lambda s: {section})", "ss",
                   f"md5(array_to_string(list_transform(ss, lambda q: q.hash), '') || '|' || {gaps}) || '/' || array_to_string(list_transform(ss, lambda q: q.spelled), ';')")


def merkle_children(branch: str, level: int) -> str:
    parts = f"string_split(substr({branch}, {2 + (32 if level == 0 else merkle.NODE)}), '{merkle.PARTS[level]}')"
    return f"list_filter({parts}, lambda z: z <> '')" if level == 2 else parts


def merkle_leaves(branches: str, level: int) -> str:
    return f"len({branches})" if level == 2 else f"len(regexp_extract_all(coalesce(array_to_string({branches}, ';'), ''), '[=.][0-9a-f]'))"


def merkle_level(level: int) -> str:
    """What became of the children x in y, for the rows (id, x, y) of ``s0``, ``s1`` or ``s2``: ``t`` has what they share, the next ``s`` the replaced branches."""
    def alike(x: str, y: str) -> str:
        same = f"list_position(list_transform(list_zip({x}, {y}), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false)"
        return f"coalesce(nullif({same}, 0) - 1, least(len({x}), len({y})))"

    def rest(side: str, other: str, name: str) -> str:
        return f"{name}{level} AS (SELECT r, z, row_number() OVER (PARTITION BY r ORDER BY k) AS n FROM {side}{level} ANTI JOIN {other}{level} USING (r, z))"

    def distinct(name: str, of: str) -> str:
        return f"{name}{level} AS (SELECT r, z, min(k) AS k FROM (SELECT r, unnest({of}) AS z, generate_subscripts({of}, 1) AS k FROM m{level}) GROUP BY r, z)"

    steps = [
        f"a{level} AS (SELECT *, row_number() OVER () AS r, {alike('x', 'y')} AS p FROM s{level})",
        f"b{level} AS (SELECT *, {alike('list_reverse(x[p + 1:])', 'list_reverse(y[p + 1:])')} AS q FROM a{level})",
        f"m{level} AS (SELECT id, r, x[1:p] || x[len(x) - q + 1:] AS kept, x[p + 1:len(x) - q] AS mx, y[p + 1:len(y) - q] AS my FROM b{level})",
        distinct("u", "mx"), distinct("v", "my"), rest("u", "v", "gone"), rest("v", "u", "fresh"),
        f"t{level} AS (SELECT id, 2 * {merkle_leaves('kept', level)} AS units FROM m{level} UNION ALL "
        f"SELECT id, {merkle_leaves('[z]', level)} FROM m{level} JOIN u{level} USING (r) SEMI JOIN v{level} USING (r, z))"]
    if level < 2:
        steps.append(f"s{level + 1} AS (SELECT id, {merkle_children('o.z', level + 1)} AS x, {merkle_children('f.z', level + 1)} AS y "
                     f"FROM gone{level} o JOIN fresh{level} f USING (r, n) JOIN m{level} USING (r))")
    return ", ".join(steps)


ORACLE["op10_merkle"] = f"""
WITH ordered AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS following FROM documents),
edited AS (SELECT *, left(text, length(text) - length(text) // 4) || left(following, length(text) // 4) AS edited FROM ordered),
printed AS MATERIALIZED (
  SELECT id, doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {merkle_print('text')} AS fingerprint,
         {merkle_print('edited')} AS edited_fingerprint, {merkle_print('following')} AS next_fingerprint FROM edited),
compared AS (SELECT id, fingerprint AS one, edited_fingerprint AS other FROM printed UNION ALL SELECT -id, fingerprint, next_fingerprint FROM printed),
s0 AS (SELECT id, {merkle_children('one', 0)} AS x, {merkle_children('other', 0)} AS y FROM compared),
{merkle_level(0)}, {merkle_level(1)}, {merkle_level(2)},
units AS (SELECT id, sum(units) AS units FROM (FROM t0 UNION ALL FROM t1 UNION ALL FROM t2) GROUP BY id),
totals AS (SELECT id, {merkle_leaves('x', 0)} + {merkle_leaves('y', 0)} AS total FROM s0),
near AS (
  SELECT id, CASE WHEN split_part(one, '/', 1) = split_part(other, '/', 1) THEN 1.0::DOUBLE WHEN total = 0 THEN 0.0::DOUBLE
                  ELSE least(units::DOUBLE / total, 1 - 1 / (total + 1.0::DOUBLE)) END AS near
  FROM compared JOIN totals USING (id) LEFT JOIN units USING (id))
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, e.near AS near_edited, f.near AS near_next
FROM printed p JOIN near e ON e.id = p.id JOIN near f ON f.id = -p.id
"""

CRC_OF_WORD = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(raw) // 2), lambda i: "
               "CAST('0x' || substr(raw, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)))")
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op11_importance"] = f"""
WITH crc AS (SELECT {CRC_TABLE} AS steps),
worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
wanted AS (SELECT unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
each AS (SELECT r, unnest(w) AS word FROM worded),
vocabulary AS (SELECT word, hex(encode(word)) AS raw FROM (SELECT word FROM each UNION SELECT word FROM wanted)),
placed AS (SELECT word, {CRC_OF_WORD} % {importance.BUCKETS} AS bucket FROM vocabulary, crc),
s AS (SELECT bucket, count(*) AS n FROM each JOIN placed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN placed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM each)::DOUBLE AS s, (SELECT count(*) FROM wanted)::DOUBLE AS t),
gains AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + {importance.BUCKETS})
         / ((coalesce(s.n, 0) + 1)::DOUBLE * (totals.t + {importance.BUCKETS}))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM placed) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weights AS (
  SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM each JOIN placed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, d.doc_id, len(d.w)::BIGINT AS n_features,
         coalesce((w.total - ((w.total % w.n) + w.n) % w.n) // w.n, 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln(({hexadecimal(f"substr(sha256('{importance.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8)")} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM worded d LEFT JOIN weights w USING (r)),
placed_rows AS (
  SELECT *, weight + noise AS score, n_features >= {importance.LEAST_WORDS} AS enough FROM scored),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id NULLS FIRST, r) AS place, count(*) OVER (PARTITION BY enough) AS many FROM placed_rows)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= many * {importance.PERCENT} // 100 THEN place END::BIGINT AS rank
FROM numbered
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_spans(rules) -> str:
    """Spans of every rule in ``text``, in order of start, then rule."""
    each = []
    for i, rule in enumerate(rules):
        pattern = quoted(rule.pattern)
        gaps, matches = f"regexp_split_to_array(text, {pattern})", f"regexp_extract_all(text, {pattern})"
        counts = f"regexp_extract_all(text, {pattern}, {rule.group})"
        end = (f"(coalesce(list_sum(list_transform({gaps}[1:k + 1], lambda x: length(x))), 0) "
               f"+ list_sum(list_transform({matches}[1:k + 1], lambda x: length(x))))::BIGINT")
        each.append(f"list_transform(list_filter(range(len({matches})), lambda k: length({counts}[k + 1]) >= {rule.least}), "
                    f"lambda k: {{'start': {end} - length({matches}[k + 1]), 'place': {i}, 'kind': '{rule.kind}', 'end': {end}}})")
    return f"list_sort(flatten([{', '.join(each)}]))"


def secret_digits(spans: str) -> str:
    return f"coalesce(array_to_string(list_transform({spans}, lambda s: s.kind || ':' || s.start || ':' || s.end), ','), '')"


ORACLE["op12_secrets"] = f"""
WITH found AS (SELECT doc_id, {secret_spans(secrets.RULES)} AS found FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
base AS (SELECT *, list_filter(found, lambda s: s.place < {len(secrets.BASE)}) AS base FROM found)
SELECT doc_id, {', '.join(f"len(list_filter(found, lambda s: s.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in secrets.BASE)},
       sha256({secret_digits('base')}) AS base_sha256, {secret_digits('found')} AS spans
FROM base
"""

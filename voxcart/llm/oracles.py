"""SQL twins of the queries that SQL can express, for another engine."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d"""


def _quality() -> str:
    from voxcart.llm import quality_rules as q

    classes = {
        "upper": "[^A-Z]+",
        "digit": "[^0-9]+",
        "symbol": "[^#*$%&|<>]+",
        "punctuation": r"[\x00-\x20\x7F0-9A-Za-z#*$%&|<>\x{80}-\x{10FFFF}]+",
        "foreign_chars": r"[\x00-\x7F]+",
    }
    counts = ",\n".join(
        f"length(regexp_replace(text, '{pattern}', '', 'g')) AS {name}"
        for name, pattern in classes.items()
    )
    names = ["upper", "digit", "symbol", "punctuation", "foreign_chars", "rest"]
    shares = ", ".join(f"sum({n}) / sum(word_chars)" for n in names)
    own = ", ".join(f"{n} / word_chars" for n in names)
    term = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    both = term.format(a="p", b="q") + " + " + term.format(a="q", b="p")
    return rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT *, word_chars - upper - digit - symbol - punctuation - foreign_chars AS rest
  FROM (SELECT doc_id, lang,
               length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
               {counts},
               list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
               list_filter(string_split(text, chr(10)),
                           lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
        FROM d)),
win AS (
  SELECT doc_id, i, list_slice(words, i, i + {q.WINDOW - 1}) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {q.WINDOW - 2})) AS i FROM m)),
hits AS (
  SELECT doc_id, i FROM win
  QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + {q.WINDOW})) AS p FROM hits) GROUP BY doc_id),
tokens AS (
  SELECT doc_id, lang, unnest(words) AS word FROM m),
word_counts AS (
  SELECT lang, word, count(*) AS n FROM tokens WHERE lang IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM word_counts GROUP BY lang),
common AS (
  SELECT lang, word, n / total AS q FROM word_counts JOIN totals USING (lang)
  WHERE total >= {q.REFERENCE_WORDS}
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {q.COMMON_WORDS}),
class_refs AS (
  SELECT lang, [{shares}] AS qs FROM m
  WHERE lang IN (SELECT lang FROM totals WHERE total >= {q.REFERENCE_WORDS}) GROUP BY lang),
judged AS (
  SELECT m.*, qs FROM m JOIN class_refs USING (lang) WHERE len(words) >= {q.LEAST_WORDS}),
class_terms AS (
  SELECT doc_id, unnest([{own}]) AS p, unnest(qs) AS q FROM judged),
class_distances AS (
  SELECT doc_id, sqrt(greatest(sum({both}) / 2, 0)) AS class_distance
  FROM class_terms GROUP BY doc_id),
own_counts AS (
  SELECT doc_id, word, count(*) AS n FROM tokens GROUP BY ALL),
word_terms AS (
  SELECT doc_id, coalesce(o.n, 0) / len(words) AS p, q
  FROM judged JOIN common USING (lang) LEFT JOIN own_counts o USING (doc_id, word)),
word_rest AS (
  SELECT doc_id, 1 - sum(p) AS p, 1 - sum(q) AS q FROM word_terms GROUP BY doc_id),
word_distances AS (
  SELECT doc_id, sqrt(greatest(sum({both}) / 2, 0)) AS word_distance
  FROM (SELECT * FROM word_terms UNION ALL SELECT * FROM word_rest) GROUP BY doc_id),
measured AS (
  SELECT m.doc_id, CAST(len(words) AS BIGINT) AS n_words, word_chars, symbol AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words,
         round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
  FROM m LEFT JOIN repeats r USING (doc_id) LEFT JOIN class_distances USING (doc_id)
  LEFT JOIN word_distances USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND coalesce(class_distance, 0) <= {q.CLASS_DISTANCE}
       AND coalesce(word_distance, 0) <= {q.WORD_DISTANCE} AS kept
FROM measured"""


ORACLES["op2_quality_rules"] = _quality()


def _secrets() -> str:
    from voxcart.llm import secrets as x

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    patterns = {"assign": x.ASSIGN, "access": x.ACCESS, "hex": x.HEX, "entropy": x.CANDIDATE}
    kept = {
        "assign": f"length(regexp_extract(m, {quoted(x.ASSIGN)}, 2)) >= {x.LEAST['assign']}",
        "access": f"length(m) >= {x.LEAST['access']}",
        "hex": f"length(m) >= {x.LEAST['hex']}",
        "entropy": "true",
    }
    found = " UNION ALL ".join(
        f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, found[i] AS m,
               list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS start
        FROM (SELECT doc_id, found, gaps, unnest(range(1, len(found) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(text, {quoted(pattern)}) AS found,
                           string_split_regex(text, {quoted(pattern)}) AS gaps FROM d))
        WHERE {kept[kind].replace("m,", "found[i],").replace("(m)", "(found[i])")}"""
        for rank, (kind, pattern) in enumerate(patterns.items())
    )
    bound = "CASE " + " ".join(
        f"WHEN regexp_matches(m, {quoted(pattern)}) THEN {x.bound_of(bits)}"
        for _, pattern, bits in x.CLASSES
    ) + " END"
    allowed = " OR ".join(f"regexp_matches(m, {quoted(p)})" for p in x.ALLOW)
    table = x.table_of_terms()
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
windows AS (
  SELECT doc_id, start, m, i, unnest(string_split(substr(m, i, {x.WINDOW}), '')) AS c
  FROM (SELECT doc_id, start, m, unnest(range(1, length(m) - {x.WINDOW} + 2)) AS i
        FROM found WHERE kind = 'entropy')),
terms AS (
  SELECT doc_id, start, m, i, {table}[count(*) + 1] AS term FROM windows GROUP BY doc_id, start, m, i, c),
sums AS (SELECT doc_id, start, m, sum(term) AS total FROM terms GROUP BY doc_id, start, m, i),
random AS (
  SELECT doc_id, start FROM sums WHERE NOT ({allowed})
  GROUP BY doc_id, start, m HAVING min(total) <= {bound} AND {bound} >= 0),
spans AS (
  SELECT doc_id, kind, rank, start, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + length(m) AS VARCHAR) AS span
  FROM found f
  WHERE kind <> 'entropy' OR EXISTS (SELECT 1 FROM random r WHERE r.doc_id = f.doc_id AND r.start = f.start)),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign,
         count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (kind = 'entropy') AS n_entropy,
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'entropy') AS base,
         string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


ORACLES["op8_secret_scan"] = _secrets()


def _mixing() -> str:
    from voxcart.llm import mixing as m

    steps = m.LEVELS * m.PASSES
    weights = "list_transform(shares, lambda s: pow(s, {x}))"
    entropy = (
        f"ln(list_sum({weights})) - list_sum(list_transform({weights}, lambda w: w * ln(w)))"
        f" / list_sum({weights}) >= target"
    )
    often = (
        f"list_max(list_transform(shares, lambda s: pow(s, {{x}}) / s)) / list_sum({weights})"
        f" * {m.BUDGET_SHARE} > {m.REPEAT_LIMIT}"
    )
    half = "((lo + hi) / 2)"
    return rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source,
         CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens,
         '{m.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key
  FROM documents),
placed AS (
  SELECT doc_id, source, n_tokens, md5(key || '|place') AS place,
         CAST(CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % {m.BLOCKS} AS INTEGER) AS block
  FROM rows),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM placed GROUP BY source),
given AS (
  SELECT list(tokens / total) AS shares, {m.ENTROPY_SHARE} * ln(count(*)) AS target, any_value(total) AS total
  FROM totals, (SELECT sum(tokens) AS total FROM totals) WHERE tokens > 0),
even(step, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT step + 1, CASE WHEN {entropy.format(x=half)} THEN {half} ELSE lo END,
         CASE WHEN {entropy.format(x=half)} THEN hi ELSE {half} END
  FROM even, given WHERE step < {steps}),
spread AS (
  SELECT CASE WHEN {entropy.format(x=1)} THEN 1 ELSE lo END AS power FROM even, given WHERE step = {steps}),
rare(step, lo, hi) AS (
  SELECT 0, power, CAST(1 AS DOUBLE) FROM spread
  UNION ALL
  SELECT step + 1, CASE WHEN {often.format(x=half)} THEN {half} ELSE lo END,
         CASE WHEN {often.format(x=half)} THEN hi ELSE {half} END
  FROM rare, given WHERE step < {steps}),
chosen AS (
  SELECT CASE WHEN {often.format(x='power')} THEN least(1, lo + pow(2, -{steps})) ELSE power END AS power
  FROM spread, rare, given WHERE step = {steps}),
quotas AS (
  SELECT source, tokens,
         CASE WHEN tokens > 0
              THEN CAST(floor(pow(tokens / total, power) / list_sum({weights.format(x='power')})
                              * floor(total * {m.BUDGET_SHARE})) AS BIGINT) ELSE 0 END AS quota
  FROM totals, given, chosen),
blocks AS (
  SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS block_tokens,
         md5(concat_ws('|', '{m.SEED}', coalesce(source, ''), CAST(block AS VARCHAR))) AS shuffled
  FROM placed GROUP BY source, block),
cuts AS (
  SELECT b.source, block, block_tokens,
         CAST(row_number() OVER (PARTITION BY b.source ORDER BY shuffled, block) AS INTEGER) AS block_rank,
         CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS rounds,
         CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END
         - (sum(block_tokens) OVER (PARTITION BY b.source ORDER BY shuffled, block) - block_tokens) AS room
  FROM blocks b JOIN quotas q ON b.source IS NOT DISTINCT FROM q.source)
SELECT p.doc_id, p.source, p.n_tokens, p.block, block_rank,
       CAST(rounds + CASE WHEN room <= 0 THEN 0 WHEN room >= block_tokens THEN 1
            WHEN sum(p.n_tokens) OVER (PARTITION BY p.source, p.block ORDER BY p.place) <= room
            THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM placed p JOIN cuts c ON p.source IS NOT DISTINCT FROM c.source AND p.block = c.block"""


ORACLES["op4_temperature_mix"] = _mixing()


def _collocations() -> str:
    from voxcart.llm import collocations as x

    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda t: t <> '') AS words
  FROM pieces),
places AS (
  SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i
  FROM w, (VALUES (1), (2), (3), (4)) AS v(m) WHERE len(words) >= m),
f AS (
  SELECT lang, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase, count(*) AS f
  FROM places GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (
  SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m >= 2 AND f >= {x.LEAST}),
inside AS (
  SELECT lang, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i
        FROM candidates, (VALUES (2), (3)) AS v(k) WHERE k < m)
  GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase)
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {x.SUBSUMED} * CAST(f AS HUGEINT)),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(list_slice(words, 1, k), ' ') AS first,
         array_to_string(list_slice(words, k + 1, m), ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.*, l.f AS l, r.f AS r,
         CAST({x.SCALE} * CAST(a AS HUGEINT) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = first
  JOIN f r ON r.lang = c.lang AND r.phrase = rest),
lowest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang)
WHERE rank <= {x.TOP}"""


ORACLES["op12_collocations"] = _collocations()


def _audit() -> str:
    from voxcart.llm import source_audit as x

    def share(count: str, total: str) -> str:
        return (
            f"1 + CAST({x.BILLION} AS HUGEINT) * ({count} + {x.SMOOTH}) "
            f"// CAST({total} + {x.SMOOTH} * terms AS HUGEINT)"
        )

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT r, lang, source,
         unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY ALL
  HAVING count(DISTINCT r) >= {x.LEAST_DOCS}),
by_lang AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT lang, source, term, lang_n, coalesce(n, 0) AS n,
         sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, {share("n", "total")} AS p, {share("lang_n", "lang_total")} AS q
  FROM cells JOIN by_lang USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (
    PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked
WHERE part = 'pair' OR rank <= {x.TERMS}"""


ORACLES["op13_source_audit"] = _audit()


def _shards() -> str:
    from voxcart.llm import sharding as x

    # The checksum byte by byte: the table of 256 entries follows from the polynomial.
    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS entries
  FROM (SELECT i, list_reduce(
          list_prepend(i, range(8)),
          lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest,
         CAST(strlen(coalesce(text, '')) + {x.ROW_OVERHEAD} AS BIGINT) AS size
  FROM documents),
sums AS (
  SELECT digest, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(
             range(1, 1 + length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
           lambda c, b: xor(entries[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) AS text_crc32
  FROM (SELECT DISTINCT digest, hex(encode(t)) AS h FROM d), crc_table),
placed AS (
  SELECT doc_id, size, digest,
         CAST(sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start,
         row_number() OVER (ORDER BY digest, doc_id NULLS FIRST) AS place,
         sum(size) OVER () AS total
  FROM d),
cut AS (
  SELECT *, CAST(least(start * {x.SHARDS} // total, {x.SHARDS - 1}) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       place - min(place) OVER (PARTITION BY shard) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, start
FROM cut JOIN sums USING (digest)"""


ORACLES["op10_byte_shards"] = _shards()

"""DuckDB statements with the expected result of the queries that SQL can express."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, NOTICES


def _numbers(phrase: str) -> list[int]:
    """Places of the grams with a number."""
    own = phrase.split()
    return [at for at, pair in enumerate(zip(own, own[1:])) if any(w.isdigit() for w in pair)]


_GRAMS = ",\n".join(
    f"('{a}', '{b}', {k}, '{label}', {str(k < len(BASE_PHRASES)).lower()}, {at}, {len(phrase.split()) - 1}, {_numbers(phrase)})"
    for k, (phrase, label) in enumerate([*BASE_PHRASES, *NOTICES])
    for at, (a, b) in enumerate(zip(phrase.split(), phrase.split()[1:])))

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after the other, every part against every entry."""
    def assigned(k: int) -> str:
        return f"""
        d{k} AS MATERIALIZED (SELECT rid, part, entry, sum((x.v - e.v) * (x.v - e.v))::BIGINT AS d FROM x JOIN e{k} e USING (part, pos) GROUP BY ALL),
        a{k} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY rid, part)"""

    def moved(k: int) -> str:
        return f"""
        m{k} AS (SELECT part, entry, pos, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v FROM a{k} JOIN x USING (rid, part) GROUP BY ALL),
        e{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.v, e.v) AS v FROM e{k} e LEFT JOIN m{k} m USING (part, entry, pos))"""

    steps = ",".join(assigned(k) + "," + moved(k) for k in range(rounds))
    return f"""
        WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rid, vec_id, label, embedding FROM embeddings
                      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
        flat AS (SELECT rid, len(embedding) // 4 AS size, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS i FROM kept),
        x AS MATERIALIZED (SELECT rid, i // size AS part, i % size AS pos, floor(y::DOUBLE * 1024)::BIGINT AS v FROM flat),
        e0 AS MATERIALIZED (SELECT part, rid AS entry, pos, v FROM x WHERE rid < 256),{steps},{assigned(rounds)},
        books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM e{rounds}),
        coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN coded USING (rid), books"""


SQL: dict[str, str] = {
    "op1_license_scan": rf"""
        WITH grams(word1, word2, template, label, base, place, n_grams, must) AS (VALUES {_GRAMS}),
        d AS (SELECT row_number() OVER () AS rid, doc_id,
                     regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p AS (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d),
        votes AS (SELECT rid, template, label, base, n_grams, must, i - 1 - place AS diagonal, count(DISTINCT place) AS n,
                         list(DISTINCT place) AS places, min(i - 1) AS first, max(i - 1) AS last
                  FROM p JOIN grams ON w[i] = word1 AND w[i + 1] = word2 GROUP BY ALL),
        marked AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER o <= 3 IS NOT TRUE THEN 1 ELSE 0 END AS new
                   FROM votes WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
        clustered AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal) AS cluster FROM marked),
        merged AS (SELECT rid, label, base, n_grams, list_has_all(flatten(list(places)), must) AS numbers, min(first) AS first, max(last) AS last,
                          len(list_distinct(flatten(list(places)))) / n_grams AS coverage
                   FROM clustered GROUP BY rid, template, label, base, n_grams, must, cluster),
        judged AS (SELECT *, CASE WHEN base AND coverage = 1 THEN first END AS here,
                          (base AND coverage = 1) OR (NOT base AND coverage >= 0.7 AND numbers AND last - first + 2 <= 2 * (n_grams + 1)) AS ok
                   FROM merged),
        found AS (SELECT rid, count(here) AS n_base, min(here) AS first_word, max(here) AS last_word,
                         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (here IS NOT NULL) AS base_labels,
                         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (ok) AS labels, max(coverage) FILTER (ok) AS score
                  FROM judged GROUP BY rid)
        SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
        FROM d LEFT JOIN found USING (rid)""",
    "op3_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM w),
        classes AS (SELECT min(doc_id) AS doc_id, s FROM sets WHERE len(s) > 0 GROUP BY s),
        x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM classes),
        inter AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
                  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
        links AS (SELECT a, b FROM inter WHERE 100 * c >= 85 * (na + nb - c)),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT doc_id, doc_id FROM classes UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
        root AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
        out AS (SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
                FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN root ON root.doc_id = classes.doc_id)
        SELECT *, doc_id = component_id AS kept FROM out""",
    "op4_url_filter": rf"""
        WITH RECURSIVE rules(action, rule) AS (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'),
                                     ('allow', 'com/fr/'), ('block', 'com/de/')),
        u AS (SELECT row_number() OVER () AS rid, page_id, html, url LIKE '%://%' AS absolute,
                     {_LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 1)")} AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 2), '') AS path,
                     regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 3) AS query FROM pages),
        fit AS (SELECT rid, arg_max(rule, (length(rule), action = 'allow', rule)) AS rule, arg_max(action, (length(rule), action = 'allow', rule)) AS action
                FROM u JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                     AND starts_with(path, substr(rule, length(split_part(rule, '/', 1)) + 1)) GROUP BY rid),
        v AS (SELECT u.*, rule, action, CASE WHEN absolute THEN host || path || query END AS node FROM u LEFT JOIN fit USING (rid)),
        links AS (SELECT node AS a, target.host || target.path || target.query AS b FROM (
                    SELECT node, (SELECT struct_pack(host := lower(regexp_extract(t, '^.*?://([^/?#]*)', 1)), path := regexp_extract(t, '^.*?://[^/?#]*([^?#]*)', 1),
                                  query := regexp_extract(t, '^.*?://[^/?#]*[^?#]*([^#]*)', 1))) AS target
                    FROM (SELECT node, regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM v)
                    WHERE t LIKE '%://%')),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach(a, b) AS (SELECT DISTINCT node, node FROM v WHERE node IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
        spread AS (SELECT a AS node FROM reach JOIN v ON v.node = b GROUP BY a HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false))
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN node IN (FROM spread) THEN 'block' END, 'allow') AS verdict FROM v""",
    "op7_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents)
        WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_chat_format": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        p AS (SELECT conv_id, turn, count(*) OVER w AS n, sha256(string_agg(turn || '|' || length(role) || '|' || role || '|' ||
                     length(text) || '|' || text, '|') OVER w) AS h
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        ends AS (SELECT conv_id, max(n) AS n_turns, arg_max(h, n) AS h FROM p GROUP BY conv_id),
        proper AS (SELECT DISTINCT p.h FROM p JOIN ends USING (conv_id) WHERE n < n_turns),
        kept AS (SELECT min(conv_id) AS conv_id, any_value(n_turns) AS n_turns FROM ends WHERE h NOT IN (FROM proper) GROUP BY h)
        SELECT conv_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn >> 8) - 1 AS part, n_turns, rendered
        FROM (SELECT conv_id, n_turns, min(turn) AS turn, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                     ORDER BY turn, role, text) AS rendered
              FROM t JOIN kept USING (conv_id) GROUP BY conv_id, n_turns, turn >> 8)""",
    "op11_vector_codes": _codes_sql(),
    "op13_phrases": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format('text')}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
                  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) r(k) WHERE len(w) >= k)),
        totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
        longer AS (SELECT lang, phrase, max(f) AS f FROM (
                     SELECT lang, f, array_to_string(string_split(phrase, ' ')[unnest([1, 2]):unnest([k - 1, k])], ' ') AS phrase FROM f WHERE k > 2
                     UNION ALL
                     SELECT lang, f, array_to_string(string_split(phrase, ' ')[unnest([1, 2, 3]):unnest([2, 3, 4])], ' ') FROM f WHERE k = 4)
                   GROUP BY ALL),
        c AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, phrase) WHERE k > 1 AND (100::HUGEINT * longer.f >= 80::HUGEINT * f.f) IS NOT TRUE),
        cuts AS (SELECT lang, phrase, f AS a, cut, array_to_string(string_split(phrase, ' ')[:cut], ' ') AS first,
                        array_to_string(string_split(phrase, ' ')[cut + 1:], ' ') AS rest FROM c, range(1, 4) r(cut) WHERE cut < k),
        scored AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
                   FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, rank, phrase, a, l, r, n, score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN totals USING (lang)
        WHERE rank <= 2000""",
}

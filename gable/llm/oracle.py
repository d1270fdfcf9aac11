"""DuckDB SQL for the queries whose results SQL can state."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCHMARK_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {BENCHMARK_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {BENCHMARK_WORDS} AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(13, len(w)) AS n FROM b) WHERE n > 0)
),
dw AS (
    SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))
),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
),
l AS (
    SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
    WHERE 100 * common >= 80 * (x.n + y.n - common)
),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
    row_number() OVER g = 1 AS kept, sha256(bare) AS text_sha256
FROM d WINDOW g AS (PARTITION BY bare ORDER BY n DESC, doc_id)
"""

SEARCH_TERMS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH d AS (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {SEARCH_TERMS} AS w FROM documents) WHERE len(w) > 0),
t AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM d),
i AS (SELECT item_id, unnest(list_distinct({SEARCH_TERMS})) AS term FROM benchmark),
x AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM x GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, t),
p AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)) AS impact FROM x, t),
s AS (SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Codebooks of the rounds as one chain of tables, a row for each component."""

    def assigned(books: str) -> str:
        return f"""SELECT vec_id, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM (
            SELECT v.vec_id, part, entry, sum((v.x - c.x) * (v.x - c.x)) AS far FROM v JOIN {books} c USING (part, place) GROUP BY v.vec_id, part, entry
        ) GROUP BY vec_id, part"""

    steps = [
        """e AS (
            SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )""",
        f"""v AS (
            SELECT vec_id, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS place, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
            FROM (SELECT vec_id, len(embedding) AS n, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM e)
        )""",
        f"""c0 AS (
            SELECT part, row_number() OVER (PARTITION BY part, place ORDER BY vec_id) - 1 AS entry, place, x
            FROM v WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT {entries})
        )""",
    ]
    for k in range(rounds):
        steps += [
            f"a{k} AS ({assigned(f'c{k}')})",
            f"""m{k} AS (
                SELECT part, entry, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x
                FROM (SELECT part, entry, place, sum(v.x) AS s, count(*) AS n FROM v JOIN a{k} USING (vec_id, part) GROUP BY part, entry, place)
            )""",
            f"c{k + 1} AS (SELECT part, entry, place, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (part, entry, place))",
        ]
    steps += [
        f"z AS ({assigned(f'c{rounds}')})",
        """r AS (
            SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM z GROUP BY vec_id
        )""",
        f"b AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return f"""WITH {', '.join(steps)}
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN e USING (vec_id), b"""


SQL: dict[str, str] = {
    "op4_decontamination": DECONTAMINATION,
    "op7_ngram_jaccard": JACCARD,
    "op11_exact_dedup": EXACT_DEDUP,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_vector_codes": vector_codes(),
}

"""One registered query per operator, with the SQL that recomputes it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitfactors import ship
from pitfactors.llm import ann, chat, clusters, exact_dedup, html_text, mixing, near_dedup, packing, pii, prefix_trie, secret_scan, toxicity, url_filter
from pitfactors.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary() -> str:
    """Path of the public byte-level vocabulary on driver and workers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_toxicity")
def op1(spark, sf_dir):
    """Toxicity score of every document, learned from the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


@query("op2_mix_sources")
def op2(spark, sf_dir):
    """Words of every document that a mix of 150 % takes."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query(
    "op3_near_duplicates",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) AS s FROM words
    ), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    posts AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM posts a JOIN posts b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
    steps AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a),
    roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)
    """,
)
def op3(spark, sf_dir):
    """Near-duplicate component of every document."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), near_dedup.Near(shingle=4)).drop("ticket")


@query("op4_url_filter")
def op4(spark, sf_dir):
    """Verdict on the URL of every page."""
    return url_filter.url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op5_personal_data")
def op5(spark, sf_dir):
    """Spans of personal data in every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query(
    "op6_exact_duplicates",
    r"""
    WITH rows AS (SELECT doc_id, coalesce(text, '') AS full_text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
    ranked AS (
        SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w AS place
        FROM rows WINDOW w AS (PARTITION BY body ORDER BY length(full_text) DESC, doc_id)
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
    """,
)
def op6(spark, sf_dir):
    """Group, winner and hash of every document."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chars", "mark")


@query(
    "op7_chat_format",
    r"""
    WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
    steps AS (
        SELECT conv_id, string_agg(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-'), chr(2)) OVER w AS prefix, row_number() OVER w AS n,
            count(*) OVER (PARTITION BY conv_id) AS n_turns
        FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING)
    ), firsts AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM steps WHERE n = n_turns GROUP BY 1, 2),
    kept AS (SELECT conv_id, n_turns, copies FROM firsts ANTI JOIN (SELECT prefix FROM steps WHERE n < n_turns) p USING (prefix)),
    texts AS (
        SELECT conv_id, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS text
        FROM turns GROUP BY 1
    )
    SELECT conv_id, n_turns, copies, text FROM kept JOIN texts USING (conv_id)
    """,
)
def op7(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat.chat_format(table(spark, sf_dir, "conversations"))


@query(
    "op8_nearest_vectors",
    r"""
    WITH usable AS (
        SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op8(spark, sf_dir):
    """Twenty nearest vectors of every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_pack")
def op9(spark, sf_dir):
    """Pieces of all documents in sequences of 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), added=True).drop("ids")


@query("op10_page_text")
def op10(spark, sf_dir):
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query(
    "op11_prefix_trie",
    r"""
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
        )) % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
    ), rebuilt AS (
        SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
    ), paths AS (
        SELECT conv_id, row_number() OVER w AS depth, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w AS path, octet_length(encode(text)) AS bytes
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs
    ), lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY 1),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
            coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends
        FROM paths JOIN lengths USING (conv_id) GROUP BY 1, 2
    ), above AS (SELECT n.path AS low, n.depth AS low_depth, p.path, p.depth FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
    children AS (SELECT path, depth, count(*) AS n_children FROM above WHERE low_depth = depth + 1 GROUP BY 1, 2),
    whole AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path AND c.depth = n.depth),
    sums AS (
        SELECT a.path, a.depth, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.bytes)::BIGINT AS saved_tokens
        FROM above a JOIN whole w ON w.path = a.low AND w.depth = a.low_depth GROUP BY 1, 2
    ), parents AS (
        SELECT a.low, a.low_depth, n.conv_id AS parent_conv_id FROM above a JOIN nodes n ON n.path = a.path AND n.depth = a.depth WHERE a.low_depth = a.depth + 1
    )
    SELECT w.conv_id, w.depth, p.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(w.ends) AS ends_sha256
    FROM whole w JOIN sums s ON s.path = w.path AND s.depth = w.depth LEFT JOIN parents p ON p.low = w.path AND p.low_depth = w.depth
    """,
)
def op11(spark, sf_dir):
    """Nodes of the prefix trie over the rebuilt conversations."""
    return prefix_trie.shared_trie(table(spark, sf_dir, "conversations")).drop("key")


def _rounds(n: int) -> str:
    """SQL of n rounds of centroid clustering and the assignment behind them, over tables kept and c0."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""
    a{i} AS (
        SELECT row, any_value(v) AS v, (min(d * 16 + cluster) % 16)::INTEGER AS cluster, min(d) AS d FROM (
            SELECT k.row, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k CROSS JOIN c{i} c
        ) GROUP BY 1
    )""")
        if i < n:
            parts.append(f"""
    m{i} AS (
        SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM (
            SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(i) GROUP BY 1, 2
        ) GROUP BY 1
    ), c{i + 1} AS (SELECT c{i}.cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return ",".join(parts)


@query(
    "op12_centroid_clusters",
    f"""
    WITH kept AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), c0 AS (
        SELECT (row_number() OVER (ORDER BY mark, e) - 1)::INTEGER AS cluster, v AS c
        FROM (SELECT sha256('1:' || vec_id) AS mark, e, v FROM kept WHERE vec_id IS NOT NULL ORDER BY mark, e LIMIT 16)
    ),{_rounds(3)}
    SELECT k.vec_id, a.cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(c.c, ',')) AS centroid_sha256
    FROM a3 a JOIN kept k USING (row) JOIN c3 c ON c.cluster = a.cluster
    """,
)
def op12(spark, sf_dir):
    """Cluster of every vector after three rounds."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def _secrets_sql() -> str:
    """The scan in SQL: positions from the pieces between matches, ownership by distinct counts."""
    parts = []
    for n, (kind, pattern, group) in enumerate(secret_scan.BASE + secret_scan.EXTRA):
        quoted = pattern.replace("'", "''")
        parts.append(f"""
        SELECT row, {n} AS kind, unnest(range(1, len(hits) + 1)) AS n, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[:len(hits)]) AS gap
        FROM (SELECT row, regexp_extract_all(full_text, '{quoted}') AS hits, regexp_extract_all(full_text, '{quoted}', {group}) AS vals, string_split_regex(full_text, '{quoted}') AS gaps FROM texts)""")
    names = ", ".join(f"'{k}'" for k in secret_scan.KINDS)
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS full_text FROM documents),
    hits AS ({" UNION ALL ".join(parts)}),
    placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY n)::BIGINT AS stop FROM hits),
    spans AS (
        SELECT row, kind, stop - length(hit) AS start, stop, value FROM placed
        WHERE CASE kind WHEN 0 THEN length(value) >= 8
            WHEN 4 THEN len(regexp_extract_all(value, '[0-9][A-Za-z]')) + len(regexp_extract_all(value, '[A-Za-z][0-9]')) >= 4 AND len(list_distinct(string_split(value, ''))) >= 10
            ELSE true END
    ), owners AS (SELECT value, count(DISTINCT coalesce('s' || source, '-')) AS owners FROM spans JOIN texts USING (row) GROUP BY 1),
    judged AS (SELECT s.*, owners < 3 AS live FROM spans s JOIN owners USING (value)),
    said AS (
        SELECT *, ([{names}])[kind + 1] || ':' || start || ':' || stop AS word FROM judged j
        WHERE kind < 3 OR (live AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.row = j.row AND b.kind < 3 AND b.start < j.stop AND b.stop > j.start))
    ), sums AS (
        SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            string_agg(word, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(word, ',' ORDER BY start, kind) AS spans,
            count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
        FROM said GROUP BY 1
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
    FROM texts LEFT JOIN sums USING (row)
    """


@query("op13_secret_scan", _secrets_sql())
def op13(spark, sf_dir):
    """Secrets in every document, with the ownership of their values."""
    return secret_scan.digest(*secret_scan.find(table(spark, sf_dir, "documents")))

"""DuckDB SQL of those queries that SQL can express."""


def _base32(digest: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(0, 40, 5):
        bits = f"CAST('0x' || substr({digest}, {i + 1}, 5) AS INTEGER)"
        parts += [f"substr('{letters}', (({bits} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER r, 0)::BIGINT AS held, (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER r, 0)::BIGINT AS weight,
         3 * (sum(source_size) OVER ())::BIGINT / 2::DOUBLE AS total
  FROM o WINDOW r AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, cap * weight <= w * (total - held) AS full_ FROM c
), l AS (
  SELECT min(held) FILTER (WHERE NOT full_) AS held1, max(weight) FILTER (WHERE NOT full_) AS weight1 FROM f
), t AS (
  SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE w * (total - held1) / weight1 END AS target,
         least(floor((CASE WHEN full_ THEN cap::DOUBLE ELSE w * (total - held1) / weight1 END) + 0.5)::BIGINT, cap) AS words
  FROM f, l
), u AS (
  SELECT *, ((words + 4095) // 4096)::BIGINT AS blocks, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS no,
         coalesce(sum(words) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
  FROM t
), g AS (
  SELECT sum(words)::BIGINT AS all_words, sum(blocks)::BIGINT AS all_blocks, count(*)::BIGINT AS sources FROM u
), i AS (
  SELECT id, least(floor(((id + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((id + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE)) * all_words::DOUBLE)::BIGINT, all_words - 1) AS point
  FROM (SELECT unnest(range(0, all_blocks)) AS id, all_words FROM g)
), k AS (
  SELECT u.no, u.blocks, i.id, (row_number() OVER (PARTITION BY u.no ORDER BY i.id) - 1)::BIGINT AS block
  FROM i JOIN u ON i.point >= u.low AND i.point < u.low + u.words
), e AS (
  SELECT no, block, id AS slot FROM k WHERE block < blocks
  UNION ALL
  SELECT no, block, all_blocks + block * sources + no
  FROM (SELECT u.no, unnest(range(least((SELECT count(*) FROM k WHERE k.no = u.no), u.blocks), u.blocks)) AS block FROM u), g
), r AS (
  SELECT d.doc_id, d.size, u.no, u.source_size, u.target, u.words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), z AS (
  SELECT doc_id, no, start + copy * source_size AS low, least(start + copy * source_size + size, words) AS high FROM r, (SELECT unnest([0, 1]) AS copy)
), y AS (
  SELECT z.doc_id, min(e.slot) AS first_slot, sum(least(z.high, (e.block + 1) * 4096) - greatest(z.low, e.block * 4096))::BIGINT AS taken
  FROM z JOIN e ON e.no = z.no AND e.block BETWEEN z.low // 4096 AND (z.high - 1) // 4096 WHERE z.high > z.low GROUP BY z.doc_id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM r LEFT JOIN y USING (doc_id)
"""

OP10 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS dim FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

OP8 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)
), e AS (
  SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, root) AS (
  SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
), c AS (
  SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP9 = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages
), h AS (SELECT html, min(page_id) AS head FROM p GROUP BY html)
SELECT page_id, payload_bytes, {_base32("digest")} AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM p JOIN h USING (html)
"""

SQL: dict[str, str] = {"op7_mix": OP7, "op8_ngram_join": OP8, "op9_warc": OP9, "op10_ann": OP10}

"""DuckDB SQL for the queries that SQL can express."""

#: Words of documents and items, the windows of the items, and where they occur.
OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


#: crc32 of a short text: 8 shifts after each byte, as one fold over bytes and -1 for a shift.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({text}, ''), lambda x: list_prepend(CAST(ord(x) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
 lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)) END))"""


def _levels(name: str, count: int) -> str:
    """Level by level: nodes {name}n0, ... (g, pos, h) and rows {name}p0, ... (rid, g, place, folded, proof) from the ones numbered 0."""
    out = []
    for k in range(count):
        n, p = f"{name}n{k}", f"{name}p{k}"
        out.append(f"""{name}n{k + 1} AS MATERIALIZED (SELECT g, pos // 3 AS pos, CASE WHEN max(many) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h
 FROM (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM {n}) GROUP BY g, pos // 3)""")
        out.append(f"""{name}p{k + 1} AS MATERIALIZED (SELECT rid, p.g, place // 3 AS place, CASE WHEN max(many) > 1 THEN sha256(string_agg(CASE WHEN pos = place THEN folded ELSE h END, '' ORDER BY pos)) ELSE max(folded) END AS folded,
 max(proof) || coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos <> place), '') AS proof
 FROM {p} AS p JOIN (SELECT *, count(*) OVER (PARTITION BY g) AS many FROM {n}) AS n ON n.g = p.g AND n.pos // 3 = p.place // 3 GROUP BY rid, p.g, place)""")
    return ",\n".join(out)


def _fields(*columns: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in columns) + ")"


#: The tree of each source (up to 3^14 rows), the tree of the sources (up to 3^8), and each row's fold along its proof.
OP13 = f"""
WITH t AS (SELECT *, CASE WHEN {_CRC32.format(text="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
h AS (SELECT doc_id, {_fields("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_fields("doc_id", "source", "lang", "n_chars", "other")} AS seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM t),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS rid FROM h),
an0 AS (SELECT g, pos, leaf AS h FROM d),
ap0 AS (SELECT rid, g, pos AS place, seen AS folded, '' AS proof FROM d),
{_levels("a", 14)},
bn0 AS (SELECT 0 AS g, g AS pos, h FROM an14),
bp0 AS (SELECT rid, 0 AS g, g AS place, folded, proof FROM ap14),
{_levels("b", 8)}
SELECT doc_id, leaf, an14.h AS subroot, bn8.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = bn8.h AS verified
FROM d JOIN an14 ON an14.g = d.g JOIN bp8 ON bp8.rid = d.rid CROSS JOIN bn8
"""

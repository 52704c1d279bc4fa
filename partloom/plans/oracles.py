"""SQL twins of the catalogue's tables, as common table expressions that DuckDB runs over `part`."""

CATALOGUE = r"""
p AS (SELECT p_partkey AS p, p_name, p_type, p_size, 'F' || (10000000 + p_partkey) AS base, (SELECT max(p_partkey) FROM part) AS last FROM part),
raw AS (SELECT p, p_size, p_name, p_type, base AS b0, v, tok, s,
        CASE WHEN v = 0 AND s = 0 AND p % 7 <> 0 THEN base
             ELSE base || '_' || tok || CASE s WHEN 0 THEN CASE WHEN (p + v) % 7 = 0 THEN '_CHK' ELSE '' END WHEN 1 THEN '___DWG1' WHEN 2 THEN '___DWG2' ELSE '___DWG1_XML7' END END AS stem
        FROM p, (VALUES (0, ''), (1, 'A'), (2, 'B'), (3, 'AA')) a(v, tok), (VALUES (0), (1), (2), (3)) c(s)
        WHERE v <= p_size % 4 AND (s = 0 OR (p_size % 5 = 0 AND (s < 3 OR p % 2 = 0)))),
idt AS (SELECT *, split_part(stem, '_', 1) AS base, upper(CASE WHEN regexp_full_match(split_part(stem, '_', 2), '[A-Za-z]{1,2}') THEN split_part(stem, '_', 2) ELSE '' END) AS rev,
        instr(stem, '_') > 0 AND contains(upper(substr(stem, instr(stem, '_') + 1)), 'CHK') AS chk,
        nullif(regexp_extract(upper(stem), '_(DWG[0-9]+)(_|$)', 1), '') AS sheet FROM raw),
ids AS (SELECT *, CASE length(rev) WHEN 0 THEN 0 WHEN 1 THEN ascii(rev) - 64 ELSE 26 * (ascii(rev) - 64) + ascii(substr(rev, 2)) - 64 END + CASE WHEN chk THEN -1000 ELSE 0 END AS rank FROM idt),
act AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY base) AS top, row_number() OVER (PARTITION BY base, rank, sheet ORDER BY stem) AS rn FROM ids) WHERE rank = top AND rn = 1),
copies AS (SELECT stem, 'd' || (p % 3) || '/' || stem || '.pdf' AS path, 2 AS depth, (p + v) % 9 = 0 AS watermarked, p_size % 6 = 0 AS scanned FROM raw
           UNION ALL SELECT stem, 'd' || (p % 3) || '/copy/' || stem || '.pdf', 3, FALSE, p_size % 6 = 0 FROM raw WHERE p % 11 = 0),
ent0 AS (SELECT a.stem, a.p, a.last, k, 2 * a.p + k AS c FROM (SELECT act.*, p.last FROM act JOIN p USING (p)) a, (VALUES (1), (2), (3)) t(k)),
ent1 AS (SELECT e.stem, e.p, e.k, 'F' || (10000000 + c) AS clean, CASE WHEN e.p % 4 = 0 THEN upper(q.p_name) ELSE q.p_name END AS description
         FROM ent0 e LEFT JOIN p q ON q.p = e.c WHERE c % 40 <> 0 AND (c <= e.last OR e.p % 13 = 0)),
ent2 AS (SELECT stem, p, k, CASE WHEN (p + k) % 19 = 0 THEN replace(clean, '0', 'O') WHEN (p + k) % 23 = 0 THEN substr(clean, 1, 3) || substr(clean, 5) ELSE clean END AS ref, CASE WHEN k = 1 THEN 'table' ELSE 'text-fallback' END AS method, description FROM ent1),
entries AS (SELECT stem, p, ref, method, description FROM ent2 UNION ALL SELECT stem, p, ref, 'positional', description FROM ent2 WHERE p % 3 = 0
            UNION ALL SELECT stem, p, 'FC' || lpad(CAST(p AS VARCHAR), 7, '0'), 'text-fallback', NULL FROM act WHERE p % 17 = 0),
bom AS (SELECT DISTINCT stem, ref FROM entries),
used_on AS (SELECT stem, 'F' || (10000000 + q) AS ref FROM (SELECT stem, p, CASE WHEN p % 8 = 0 THEN p % 97 ELSE (p - 1) // 2 END AS q FROM act WHERE p % 10 <> 0 AND p <> 0) WHERE q <> p),
tb AS (SELECT stem, base, rev, CASE WHEN p % 6 = 0 THEN stem || ' ' || p_name ELSE stem END AS file_name, 'F' || (10000000 + CASE WHEN p % 29 = 0 THEN p + 1 ELSE p END) AS number,
       CASE WHEN p % 37 = 0 THEN 'Z' WHEN p % 31 = 0 THEN NULL WHEN tok = '' THEN '-' ELSE tok END AS tb_rev, CASE WHEN p % 12 = 0 THEN p_type ELSE p_name END AS name, p_size % 6 = 0 AS scanned, p_name, p % 6 = 0 AS titled FROM act)
"""

#: Resolution of references: {refs} has ref, {stems} has stem, base, rank, sheet.
MATCH = r"""
{name}_j AS (SELECT r.ref, s.stem, s.rank, s.sheet, max(CASE WHEN s.stem = r.ref THEN s.rank END) OVER (PARTITION BY r.ref) AS pinned, max(s.rank) OVER (PARTITION BY r.ref) AS top
             FROM (SELECT DISTINCT ref FROM {refs} WHERE ref IS NOT NULL) r JOIN {stems} s ON s.base = split_part(r.ref, '_', 1)),
{name} AS (SELECT ref, stem FROM (SELECT *, row_number() OVER (PARTITION BY ref, sheet ORDER BY stem) AS rn FROM {name}_j
           WHERE rank = coalesce(pinned, top) AND (pinned IS NOT NULL OR NOT contains(ref, '_'))) WHERE rn = 1)
"""


def match(name: str, refs: str, stems: str) -> str:
    return MATCH.format(name=name, refs=refs, stems=stems).strip()


#: Misread references: candidates by look-alikes and by edit distance; only a single one counts.
SNAPS = (
    "wanted AS (SELECT DISTINCT ref FROM bom WHERE regexp_full_match(ref, 'F[0-9][0-9A-Za-z]*')),\n"
    + match("direct", "wanted", "act")
    + r""",
lost AS (SELECT ref FROM wanted WHERE ref NOT IN (SELECT ref FROM direct)),
known AS (SELECT DISTINCT base FROM act),
cands AS (SELECT ref, base FROM lost JOIN known ON base = substr(ref, 1, 1) || translate(substr(ref, 2), 'OILSB', '01158')
          UNION SELECT ref, base FROM lost JOIN known ON abs(length(ref) - length(base)) <= 1 AND levenshtein(ref, base) = 1 WHERE NOT regexp_full_match(ref, 'F[0-9]{8}')),
snaps AS (SELECT ref, min(base) AS snapped FROM cands GROUP BY ref HAVING count(*) = 1),
bom2 AS (SELECT DISTINCT stem, coalesce(snapped, ref) AS ref FROM bom LEFT JOIN snaps USING (ref)),
refs2 AS (SELECT stem, ref FROM bom2 WHERE regexp_full_match(ref, 'F[0-9][0-9A-Za-z]*')),
"""
    + match("met", "refs2", "act")
    + r""",
edges AS (SELECT DISTINCT r.stem AS parent, m.stem AS child FROM refs2 r JOIN met m USING (ref) WHERE r.stem <> m.stem),
tops AS (SELECT stem FROM act WHERE stem NOT IN (SELECT child FROM edges)),
roots AS (SELECT stem FROM tops WHERE stem IN (SELECT stem FROM bom2) OR stem IN (SELECT parent FROM edges))
"""
)


def over(select: str, *more: str, graph: bool = True, recursive: bool = False) -> str:
    """A query over the catalogue and, if wanted, its graph."""
    ctes = [CATALOGUE.strip(), *([SNAPS.strip()] if graph else []), *more]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select

"""SQL parts shared by the queries over cells: resolution of chain combinations, chain labels, numbers.

Each function gives common table expressions over a table of contigs ``src`` with unit, barcode, sequence_id, cid (chain
clonotype), cv and sub (its variant and subclone).
"""

from __future__ import annotations


def one_per_chain(src: str) -> str:
    return f"one AS (SELECT * EXCLUDE (k_) FROM (SELECT *, row_number() OVER (PARTITION BY unit, barcode, cid ORDER BY sequence_id) AS k_ FROM {src}) WHERE k_ = 1 OR cid IS NULL)"


CLASSES = """cell AS (SELECT unit, barcode, string_agg(cid, '-' ORDER BY cid) AS m, string_agg(cv, '-' ORDER BY cv) AS mv, string_agg(sub, '-' ORDER BY sub) AS ms, count(cid) AS n, count(*) FILTER (substr(cid, 1, 3) = 'IGH') AS h, count(*) FILTER (substr(cid, 1, 3) IN ('IGK', 'IGL')) AS l FROM one GROUP BY 1, 2),
classed AS (SELECT *, CASE WHEN n = 1 THEN 'Single_chain_1' WHEN n > 4 THEN 'Not_supported' WHEN h = 0 OR l = 0 THEN CASE WHEN n = 2 THEN 'Single_chain_2' ELSE 'Not_supported' END WHEN n = 4 AND (h > 2 OR l > 2) THEN 'Not_supported' ELSE 'Yes' END AS class FROM cell)"""

#: Combinations one by one, with what is kept so far as a list; then the kept ones, with the chains met so far.
RESOLVED = """combos AS (SELECT unit, m, class, n, list_distinct(string_split(m, '-')) AS c, row_number() OVER (PARTITION BY unit ORDER BY n DESC, m, class) AS i FROM (SELECT unit, m, class, CAST(sum(n) AS BIGINT) AS n FROM classed WHERE class IN ('Yes', 'Single_chain_2') GROUP BY 1, 2, 3)),
one_by_one AS (
  SELECT unit, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(c VARCHAR[], num BIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS num, CAST(NULL AS VARCHAR) AS flag FROM (SELECT DISTINCT unit FROM combos)
  UNION ALL
  SELECT unit, i, CASE WHEN flag IS NULL THEN list_append(kept, {'c': c, 'num': num}) ELSE kept END, num, flag FROM (
    SELECT unit, i, kept, c, CASE WHEN doublet THEN 'Clonotype_doublet' WHEN hit IS NOT NULL THEN 'Alternative_clonotype' END AS flag, CASE WHEN doublet THEN NULL WHEN hit IS NOT NULL THEN hit ELSE len(kept) + 1 END AS num FROM (
      SELECT s.unit, b.i, s.kept, b.c, len(b.c) >= 3 AND len(list_filter(s.kept, lambda x: list_has_any(x.c, b.c))) > 0 AS doublet, CASE WHEN len(b.c) < 3 THEN list_filter(s.kept, lambda x: list_has_all(x.c, b.c))[1].num END AS hit
      FROM one_by_one s JOIN combos b ON b.unit = s.unit AND b.i = s.i + 1))),
kept AS (SELECT b.unit, b.i, b.c, row_number() OVER (PARTITION BY b.unit ORDER BY b.i) AS j FROM combos b JOIN one_by_one s ON s.unit = b.unit AND s.i = b.i WHERE s.flag IS NULL),
second AS (
  SELECT unit, CAST(0 AS BIGINT) AS j, CAST(NULL AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS alive, false AS doublet FROM (SELECT DISTINCT unit FROM kept)
  UNION ALL
  SELECT s.unit, k.j, k.i, CASE WHEN len(list_intersect(k.c, s.alive)) >= 2 THEN s.alive ELSE list_distinct(list_concat(s.alive, k.c)) END, len(list_intersect(k.c, s.alive)) >= 2 FROM second s JOIN kept k ON k.unit = s.unit AND k.j = s.j + 1),
final AS (SELECT b.unit, b.i, b.m, b.class, b.n, s.num, coalesce(s.flag, CASE WHEN d.doublet THEN 'Clonotype_doublet' END, b.class) AS fin FROM combos b JOIN one_by_one s ON s.unit = b.unit AND s.i = b.i LEFT JOIN second d ON d.unit = b.unit AND d.i = b.i),
ranks AS (SELECT unit, num, 'C' || row_number() OVER (PARTITION BY unit ORDER BY sum(n) DESC, min(i)) AS ig FROM final WHERE num IS NOT NULL AND fin NOT IN ('Clonotype_doublet', 'Single_chain_2') GROUP BY 1, 2),
solved AS (SELECT c.unit, c.barcode, c.m, c.mv, c.ms, c.n, coalesce(f.fin, c.class) AS completeBCR, CASE WHEN f.fin NOT IN ('Clonotype_doublet', 'Single_chain_2') THEN r.ig END AS ig
  FROM classed c LEFT JOIN final f ON f.unit = c.unit AND f.m = c.m AND f.class = c.class LEFT JOIN ranks r ON r.unit = f.unit AND r.num = f.num)"""

RELABELLED = """r0 AS (SELECT o.*, s.completeBCR, s.ig FROM one o LEFT JOIN solved s ON s.unit = o.unit AND s.barcode = o.barcode),
r1 AS (SELECT unit, cid, ig, row_number() OVER (PARTITION BY unit, cid ORDER BY count(*) DESC, ig) AS k, count(*) OVER (PARTITION BY unit, cid) AS of FROM r0 WHERE completeBCR = 'Yes' AND ig IS NOT NULL GROUP BY unit, cid, ig),
r2 AS (SELECT r0.*, CASE WHEN of > 1 THEN r0.cid || 'x' || k WHEN completeBCR = 'Yes' THEN r0.cid END AS lab FROM r0 LEFT JOIN r1 ON r1.unit = r0.unit AND r1.cid = r0.cid AND r1.ig = r0.ig),
r3 AS (SELECT unit, cid, cv, lab, count(*) AS n FROM r2 WHERE completeBCR = 'Yes' AND lab IS NOT NULL GROUP BY 1, 2, 3, 4),
r4 AS (SELECT unit, cid, cv, count(*) AS tied, min(lab) AS vote FROM (SELECT *, max(n) OVER (PARTITION BY unit, cid, cv) AS best FROM r3) WHERE n = best GROUP BY 1, 2, 3),
r5 AS (SELECT r2.*, coalesce(lab, CASE WHEN tied = 1 THEN vote WHEN tied > 1 THEN r2.cid || 'xNA' || row_number() OVER (PARTITION BY r2.unit, r2.cid, r2.cv, lab IS NULL ORDER BY sequence_id) END) AS lab2 FROM r2 LEFT JOIN r4 ON r4.unit = r2.unit AND r4.cid = r2.cid AND r4.cv = r2.cv),
r6 AS (SELECT *, (SELECT count(DISTINCT lab2) FROM r5 o WHERE o.unit = r5.unit AND o.cid = r5.cid) AS labels, CASE WHEN lab2 IS NULL THEN row_number() OVER (PARTITION BY unit, cid, lab2 IS NULL ORDER BY sequence_id) END AS i FROM r5),
r7 AS (SELECT *, min(CASE WHEN labels <= 1 AND completeBCR = 'Single_chain_1' AND i + labels > 1 THEN i END) OVER (PARTITION BY unit, cid) AS s FROM r6),
relabelled AS (SELECT * EXCLUDE (cid), CASE WHEN i IS NOT NULL AND labels > 1 THEN cid || 'x' || (labels + i) WHEN i >= s THEN cid || 'x' || (i - s + 2) WHEN labels <= 1 AND s IS NOT NULL THEN cid || 'x1' ELSE coalesce(lab2, cid) END AS cid FROM r7)"""


def numbered(src: str, name: str) -> str:
    """``src`` with unit, ig, mv and ms, a row of which counts as it stands, with the numbers of variant and subclone."""
    return f"""{name}0 AS (SELECT *, count(*) OVER (PARTITION BY unit, ig, mv) AS nv, count(*) OVER (PARTITION BY unit, ig, mv, ms) AS ns, count(*) OVER (PARTITION BY unit, ig, ms) AS nc FROM {src}),
{name}1 AS (SELECT *, dense_rank() OVER (PARTITION BY unit, ig ORDER BY nv DESC, mv) AS kv, dense_rank() OVER (PARTITION BY unit, ig, mv ORDER BY ns DESC, ms) AS ks, dense_rank() OVER (PARTITION BY unit, ig ORDER BY nc DESC, ms) AS kc FROM {name}0),
{name} AS (SELECT *, ig || '.CV' || kv AS igcv, ig || '.CV' || kv || '.S' || ks AS igsub, ig || '.' || kc AS igin FROM {name}1)"""

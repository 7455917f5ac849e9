"""The same results in plain SQL, written apart from the Spark code and run by another engine.

All pairs, recursive reachability and whole-table windows are fine here: the SQL only has to be
obviously right on small tables.
"""

from __future__ import annotations

from sparkcurate import constants as K
from sparkcurate.class_maps import PLANTDOC, PLANTVILLAGE
from sparkcurate.plans import adapters as A
from sparkcurate.plans import catalog as Q

ORACLES: dict[str, str] = {}


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def texts(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# --- hashes and groups ------------------------------------------------------------------------

FILES = """
tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS t FROM documents),
cnt AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::bigint % 72) AS i, count(*) AS n
        FROM tok WHERE t <> '' GROUP BY ALL),
cells AS (SELECT d.doc_id, g.i, coalesce(c.n, 0) AS n
          FROM documents d CROSS JOIN (SELECT unnest(range(72)) AS i) g
          LEFT JOIN cnt c ON c.doc_id = d.doc_id AND c.i = g.i),
bits AS (SELECT l.doc_id, (l.i // 9) * 8 + l.i % 9 AS k, r.n > l.n AS bit
         FROM cells l JOIN cells r ON r.doc_id = l.doc_id AND r.i = l.i + 1 AND l.i % 9 < 8),
hashed AS (SELECT doc_id, (sum(CASE WHEN NOT bit THEN 0::hugeint WHEN k = 0 THEN -(1::hugeint << 63)
                              ELSE 1::hugeint << (63 - k)::int END))::bigint AS h
           FROM bits GROUP BY 1),
files AS (SELECT doc_id AS id, source,
                 CASE WHEN regexp_extract(source, '[0-9]+$')::int % 2 = 1 THEN 'anomalous' ELSE 'healthy' END AS label,
                 n_chars, CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN h END AS h
          FROM documents JOIN hashed USING (doc_id)),
named AS (SELECT *, 'staging/' || label || '/' || source || '__' || lpad(id::varchar, 8, '0') || '.txt' AS path
          FROM files)
"""


def pairs(distance: int) -> str:
    return f"""
reps AS (SELECT h, min(id) AS rep, count(*) AS n FROM named WHERE h IS NOT NULL GROUP BY h),
near AS (SELECT a.rep AS x, b.rep AS y, bit_count(xor(a.h, b.h))::int AS distance
         FROM reps a JOIN reps b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= {distance})
"""


def groups(distance: int = Q.DOC_DISTANCE) -> str:
    """CTEs up to ``grouped``: readable files with the smallest id they can reach."""
    return f"""
{FILES}, {pairs(distance)},
reach AS (SELECT rep AS node, rep AS r FROM reps
          UNION SELECT reach.node, near.y FROM reach JOIN near ON near.x = reach.r),
comp AS (SELECT node AS rep, min(r) AS group_id FROM reach GROUP BY node),
grouped AS (SELECT f.*, c.group_id FROM named f JOIN reps USING (h) JOIN comp c USING (rep))
"""


def row_split(table: str, out: str) -> str:
    return f"""
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || path), path) AS rk,
            count(*) OVER (PARTITION BY label) AS cn FROM {table}),
{out} AS (SELECT * EXCLUDE (rk, cn),
          CASE WHEN rk <= greatest(1, floor(cn * 0.15::double)) THEN 'test'
               WHEN rk <= greatest(1, floor(cn * 0.15::double)) * 2 THEN 'val' ELSE 'train' END AS split
          FROM {out}_r)
"""


def group_split(table: str, out: str) -> str:
    return f"""
{out}_g AS (SELECT group_id, min(path) AS key, min(label) AS label FROM {table}
            GROUP BY 1 HAVING min(label) = max(label)),
{out}_k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || key), key) AS rk,
            count(*) OVER (PARTITION BY label) AS n FROM {out}_g),
{out}_s AS (SELECT *, greatest(1, round_even(n * 0.15::double, 0)) AS nv,
            greatest(1, round_even(n * (1.0::double - 0.70::double - 0.15::double), 0)) AS nt FROM {out}_k),
{out} AS (SELECT t.*, CASE WHEN rk <= greatest(n - nv - nt, 0) THEN 'train' WHEN rk <= n - nt THEN 'val' ELSE 'test' END AS split
          FROM {table} t JOIN {out}_s s USING (group_id))
"""


def report(rows: str, listed: str) -> str:
    """One-line leakage report as a SELECT."""
    return f"""
SELECT {Q.DOC_DISTANCE} AS max_distance, g.n_images, g.n_distinct_photos,
  round(CASE WHEN g.n_images > 0 THEN 100.0::double * (g.n_images - g.n_distinct_photos) / g.n_images ELSE 0 END, 2) AS redundancy_pct,
  g.largest_group, l.n_corrupted, g.label_conflict_groups,
  CASE WHEN 100.0::double * g.leaked_test / l.nt >= 20 THEN 'GRAVE'
       WHEN 100.0::double * g.leaked_test / l.nt >= 5 THEN 'MODERADO' ELSE 'OK' END AS verdict,
  l.nt AS test_total, g.leaked_test AS test_leaked, round(100.0::double * g.leaked_test / l.nt, 2) AS test_leaked_pct,
  l.nv AS val_total, g.leaked_val AS val_leaked, round(100.0::double * g.leaked_val / l.nv, 2) AS val_leaked_pct
FROM (SELECT sum(n)::bigint AS n_images, count(*) AS n_distinct_photos, max(n) AS largest_group,
             coalesce(sum(te) FILTER (tr > 0), 0)::bigint AS leaked_test,
             coalesce(sum(va) FILTER (tr > 0), 0)::bigint AS leaked_val,
             count(*) FILTER (nl > 1) AS label_conflict_groups
      FROM (SELECT group_id, count(*) AS n, count(*) FILTER (split = 'train') AS tr,
                   count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'test') AS te,
                   count(DISTINCT label) AS nl FROM {rows} GROUP BY 1)) g,
     (SELECT count(*) FILTER (h IS NULL) AS n_corrupted, count(*) FILTER (split = 'test') AS nt,
             count(*) FILTER (split = 'val') AS nv FROM {listed}) l
"""


ROW_SPLIT_GROUPS = f"""
WITH RECURSIVE {groups()}, {row_split('named', 'listed')},
rows AS (SELECT g.*, l.split FROM grouped g JOIN listed l USING (id))
"""
GROUP_SPLIT = f"WITH RECURSIVE {groups()}, {group_split('grouped', 'kept')}"

ORACLES["near_dup_hash"] = f"WITH {FILES} SELECT id, label, h::varchar AS hash FROM named"
ORACLES["orbit_signature_dups"] = (
    f"WITH {FILES} SELECT h AS hash, min(id) AS rep, count(*) AS n_files FROM named "
    "WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1"
)

# Source cell of target (r, c) after mirroring (f) and k quarter turns anticlockwise.
ORBITS = """
cell AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
move AS (SELECT k, f, r, c, CASE WHEN f = 1 THEN 7 - c ELSE c END AS cc
         FROM (SELECT unnest(range(4)) AS k), (SELECT unnest(range(2)) AS f),
              (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c)),
src AS (SELECT k * 2 + f AS m, r, c,
        CASE k WHEN 0 THEN r * 8 + cc WHEN 1 THEN cc * 8 + (7 - r)
               WHEN 2 THEN (7 - r) * 8 + (7 - cc) ELSE (7 - cc) * 8 + r END AS i FROM move),
moved AS (SELECT vec_id, m, r, c, v FROM src JOIN cell USING (i)),
orb AS (SELECT a.vec_id AS id, a.m,
        sum(CASE WHEN b.v > a.v THEN 1::hugeint << (55 - a.r * 7 - a.c)::int ELSE 0 END)::bigint AS h
        FROM moved a JOIN moved b ON a.vec_id = b.vec_id AND a.m = b.m AND a.r = b.r AND b.c = a.c + 1
        GROUP BY ALL)
"""
_WIDE = ", ".join(f"max(h) FILTER (m = {k}) AS h{k}" for k in range(8))
ORACLES["orbit_hash"] = f"WITH {ORBITS} SELECT id, {_WIDE} FROM orb GROUP BY id"
ORACLES["stream_hash"] = ORACLES["orbit_hash"]
ORACLES["orbit_self_distance"] = f"""
WITH {ORBITS} SELECT a.id, min(bit_count(xor(a.h, b.h)))::int AS distance
FROM orb a JOIN orb b ON a.id = b.id AND a.m = 0 AND b.m > 0 GROUP BY a.id"""

_STARTS, _WIDTHS = [0, 13, 26, 39, 52], [13, 13, 13, 13, 12]
ORACLES["hash_bands"] = f"WITH {FILES} " + " UNION ALL ".join(
    f"SELECT id, {b}::int AS band, ((h >> {s}) & {2**w - 1})::bigint AS value FROM named WHERE h IS NOT NULL"
    for b, (s, w) in enumerate(zip(_STARTS, _WIDTHS))
)
ORACLES["near_dup_edges"] = f"""
WITH {FILES}, {pairs(Q.DOC_DISTANCE)}
SELECT rep AS a, id AS b, 0 AS distance FROM named JOIN reps USING (h) WHERE id <> rep
UNION ALL SELECT x, y, distance FROM near WHERE x < y"""
ORACLES["near_dup_groups"] = f"""
WITH RECURSIVE {groups()}
SELECT id, group_id, (dense_rank() OVER (ORDER BY group_id) - 1)::bigint AS dense_id FROM grouped"""
ORACLES["group_stats"] = f"""
WITH RECURSIVE {groups()}
SELECT sum(n)::bigint AS n_images, count(*) AS n_groups, count(*) FILTER (n > 1) AS n_duplicate_groups,
       sum(n - 1)::bigint AS n_redundant_images, max(n) AS largest_group,
       {r6('100.0::double * sum(n - 1) / sum(n)')} AS redundancy_pct
FROM (SELECT group_id, count(*) AS n FROM grouped GROUP BY 1)"""


def _sweep() -> str:
    parts, ctes = [], []
    for d in Q.SWEEP_DISTANCES:
        ctes.append(f"""
reach{d} AS (SELECT rep AS node, rep AS r FROM reps
          UNION SELECT q.node, near.y FROM reach{d} q JOIN near ON near.x = q.r AND near.distance <= {d}),
grp{d} AS (SELECT c.g, count(*) AS n, count(DISTINCT label) AS nl, count(*) FILTER (split = 'train') AS tr,
           count(*) FILTER (split = 'test') AS te
        FROM listed JOIN reps USING (h) JOIN (SELECT node AS rep, min(r) AS g FROM reach{d} GROUP BY 1) c USING (rep)
        GROUP BY 1)""")
        parts.append(f"""
SELECT {d} AS max_distance, count(*) AS n_groups, count(*) FILTER (nl > 1) AS n_impure_groups,
       coalesce(sum(te) FILTER (tr > 0), 0)::bigint AS leaked_test,
       {r6('100.0::double * coalesce(sum(te) FILTER (tr > 0), 0) / sum(te)')} AS leaked_pct FROM grp{d}""")
    return (
        f"WITH RECURSIVE {FILES}, {pairs(max(Q.SWEEP_DISTANCES))}, {row_split('named', 'listed')}, "
        + ", ".join(ctes)
        + " UNION ALL ".join(parts)
    )


ORACLES["tolerance_sweep"] = _sweep()

# --- splits and leakage -----------------------------------------------------------------------

ORACLES["group_split"] = f"{GROUP_SPLIT} SELECT id, group_id, label, split FROM kept"
ORACLES["leak_report_row_split"] = f"{ROW_SPLIT_GROUPS} {report('rows', 'listed')}"
ORACLES["leak_report_group_split"] = f"{GROUP_SPLIT} {report('kept', 'kept')}"
ORACLES["leak_matrix"] = f"""
{ROW_SPLIT_GROUPS}
SELECT a.split, s.also_in, count(*) FILTER (EXISTS (SELECT 1 FROM rows b WHERE b.group_id = a.group_id AND b.split = s.also_in)) AS n_rows
FROM rows a JOIN (SELECT unnest({texts(K.SPLITS)}) AS also_in) s ON s.also_in <> a.split GROUP BY ALL"""
_METRICS = [
    "n_images", "n_distinct_photos", "redundancy_pct", "largest_group", "n_corrupted", "test_total",
    "test_leaked", "test_leaked_pct", "val_total", "val_leaked", "val_leaked_pct", "label_conflict_groups",
]
ORACLES["leak_before_after"] = f"""
{ROW_SPLIT_GROUPS}, {group_split('grouped', 'kept')},
old AS ({report('rows', 'listed')}), new AS ({report('kept', 'kept')})
""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, old.{m}::double AS before, new.{m}::double AS after, "
    f"{r6(f'new.{m}::double - old.{m}::double')} AS change FROM old, new"
    for m in _METRICS
)
ORACLES["leak_examples"] = f"""
{ROW_SPLIT_GROUPS}
SELECT a.path AS test_path, min(b.path) AS train_path
FROM rows a JOIN rows b ON a.group_id = b.group_id AND a.split = 'test' AND b.split = 'train'
GROUP BY a.path ORDER BY a.path LIMIT 15"""
ORACLES["leaked_rows"] = f"""
{ROW_SPLIT_GROUPS} SELECT id, split, group_id FROM rows
WHERE split IN ('val', 'test') AND group_id IN (SELECT group_id FROM rows WHERE split = 'train')"""
ORACLES["clean_test"] = f"""
{ROW_SPLIT_GROUPS} SELECT id, group_id FROM rows
WHERE split = 'test' AND group_id NOT IN (SELECT group_id FROM rows WHERE split = 'train')"""
ORACLES["label_conflicts"] = f"""
WITH RECURSIVE {groups()} SELECT group_id, count(*) AS n_files, count(DISTINCT label) AS n_labels
FROM grouped GROUP BY 1 HAVING count(DISTINCT label) > 1"""
ORACLES["drop_conflicts"] = f"""
WITH RECURSIVE {groups()} SELECT id, group_id, label FROM grouped
WHERE group_id IN (SELECT group_id FROM grouped GROUP BY 1 HAVING count(DISTINCT label) = 1)"""
ORACLES["split_metadata"] = f"""
{GROUP_SPLIT},
sizes AS (SELECT group_id, count(*) AS n, count(DISTINCT label) AS nl FROM grouped GROUP BY 1)
SELECT 'seed' AS section, NULL::varchar AS split, NULL::varchar AS item, 42.0::double AS n
UNION ALL SELECT 'max_hamming_distance', NULL, NULL, {Q.DOC_DISTANCE}
UNION ALL SELECT 'n_images_staging', NULL, NULL, count(*) FROM named
UNION ALL SELECT 'n_corrupted_dropped', NULL, NULL, count(*) FROM named WHERE h IS NULL
UNION ALL SELECT 'n_conflicted_groups_dropped', NULL, NULL, count(*) FROM sizes WHERE nl > 1
UNION ALL SELECT 'n_distinct_photos', NULL, NULL, count(*) FROM sizes
UNION ALL SELECT 'redundancy_pct', NULL, NULL, round(100.0::double * sum(n - 1) / sum(n), 2) FROM sizes
UNION ALL SELECT 'largest_group', NULL, NULL, max(n) FROM sizes
UNION ALL SELECT 'groups_per_split', split, NULL, count(DISTINCT group_id) FROM kept GROUP BY split
UNION ALL SELECT 'images_per_split', split, label, count(*) FROM kept GROUP BY split, label
UNION ALL SELECT 'sources_per_split', split, source, count(*) FROM kept GROUP BY split, source"""
ORACLES["audit_gate"] = f"""
{ROW_SPLIT_GROUPS}
SELECT test_leaked_pct, verdict, verdict = 'OK' AS passed,
       'no split metadata: the split may not be group-aware' AS warning
FROM ({report('rows', 'listed')})"""
ORACLES["incremental_hash_plan"] = f"""
WITH {FILES}
SELECT path, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'to_hash'
                  WHEN h IS NULL THEN 'corrupt' ELSE 'known' END AS state FROM named"""

# --- names, labels, annotations ---------------------------------------------------------------

PATHS = f"""
src AS (SELECT *, regexp_extract(source, '[0-9]+$')::bigint AS sn,
        {texts(A.OUTER_DIRS)}[doc_id % 7 + 1] AS a, {texts(A.CLASS_DIRS)}[doc_id % 15 + 1] AS b,
        {texts(A.SUFFIXES)}[doc_id % 9 + 1] AS sfx FROM documents),
paths AS (SELECT doc_id AS id, source, sn, b AS folder, n_chars, sfx, lower(sfx) AS ext,
          CASE WHEN sn % 5 = 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN ['healthy'] ELSE ['anomalous'] END
               WHEN sn % 5 = 0 AND doc_id % 3 = 1 THEN ['healthy', 'extra']
               WHEN doc_id % 11 = 0 THEN [a] ELSE [a, b] END AS dirs FROM src),
lake AS (SELECT *, source || '/' || array_to_string(dirs, '/') || '/' || id || sfx AS path FROM paths)
"""


def infer(name: str) -> str:
    """Label of a name by regular expression on whole tokens."""
    hit = lambda words: f"regexp_matches(lower({name}), '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)')"
    return (
        f"CASE WHEN {hit(K.IGNORE_WORDS)} THEN 'ignore' WHEN {hit(K.HEALTHY_WORDS)} THEN 'healthy' "
        f"WHEN {hit(K.ANOMALOUS_WORDS)} THEN 'anomalous' END"
    )


_D1, _D2 = infer("dirs[1]"), infer("dirs[2]")
LABELLED = f"""
WITH {PATHS},
found AS (SELECT *, {_D1} AS l1, {_D2} AS l2 FROM lake),
near_root AS (SELECT *, coalesce(l1, l2) AS raw, CASE WHEN l1 IS NOT NULL THEN dirs[1]
              WHEN l2 IS NOT NULL THEN dirs[1] || '/' || dirs[2] END AS raw_folder FROM found),
flag AS (SELECT source, bool_or(dirs[1] IN ('healthy', 'anomalous')) AS shortcut FROM lake GROUP BY 1),
picked AS (SELECT n.* EXCLUDE (raw, raw_folder), shortcut,
           CASE WHEN NOT shortcut THEN raw WHEN len(dirs) = 1 AND dirs[1] IN ('healthy', 'anomalous') THEN dirs[1] END AS raw,
           CASE WHEN NOT shortcut THEN raw_folder WHEN len(dirs) = 1 AND dirs[1] IN ('healthy', 'anomalous') THEN dirs[1] END AS folder_found
           FROM near_root n JOIN flag USING (source)),
labelled AS (SELECT *, CASE WHEN raw <> 'ignore' THEN raw END AS label,
             CASE WHEN raw = 'ignore' THEN 'ignored' WHEN raw IS NOT NULL THEN 'labelled'
                  WHEN shortcut THEN 'outside_shortcut' ELSE 'unlabelled' END AS status FROM picked),
leaves AS (SELECT source, array_to_string(dirs, '/') AS folder, count(*) AS n_images FROM labelled x
           WHERE status = 'unlabelled' AND NOT EXISTS (
             SELECT 1 FROM lake y WHERE y.source = x.source AND len(y.dirs) > len(x.dirs)
             AND y.dirs[1:len(x.dirs)] = x.dirs) GROUP BY ALL)
"""
ORACLES["filter_extensions"] = f"""
WITH {PATHS} SELECT ext, count(*) FILTER (list_contains({texts(K.IMAGE_EXTENSIONS)}, ext)) AS images,
  count(*) FILTER (list_contains({texts(K.CONSOLIDATION_EXTENSIONS)}, ext)) AS consolidation,
  count(*) FILTER (list_contains({texts(K.FIELD_EXTENSIONS)}, ext)) AS field FROM lake GROUP BY ext"""
ORACLES["parse_split_path"] = f"""
WITH {FILES} SELECT id, 'staging' AS split, label, source || '__' || lpad(id::varchar, 8, '0') || '.txt' AS name FROM named"""
_MAP = values([*PLANTVILLAGE.items(), *PLANTDOC.items()])
MAPPED = f"WITH {PATHS}, class_map(folder, class) AS (VALUES {_MAP}), mapped AS (SELECT * FROM lake JOIN class_map USING (folder))"
ORACLES["class_map_join"] = f"{MAPPED} SELECT id, folder, class FROM mapped"
ORACLES["name_tokens"] = f"""
WITH {PATHS} SELECT DISTINCT id, token FROM (
  SELECT id, unnest(regexp_split_to_array(lower(folder), '[^a-z0-9]+')) AS token FROM lake) WHERE token <> ''"""
ORACLES["infer_label"] = f"WITH {PATHS} SELECT id, folder, {infer('folder')} AS label FROM lake"
ORACLES["label_from_path"] = f"{LABELLED} SELECT id, path, raw AS label, raw_folder AS folder FROM near_root"
ORACLES["unrecognized_dirs"] = f"{LABELLED} SELECT * FROM leaves"
ORACLES["binary_shortcut"] = f"{LABELLED} SELECT id, source, shortcut, label, status FROM labelled"
ORACLES["label_audit"] = f"""
{LABELLED} SELECT source, folder_found AS folder, label, count(*) AS n_images, 'assigned' AS status
FROM labelled WHERE status = 'labelled' GROUP BY ALL
UNION ALL SELECT source, folder, NULL, n_images, 'unrecognized' FROM leaves"""
ORACLES["label_status"] = f"{LABELLED} SELECT source, status, count(*) AS n_images FROM labelled GROUP BY ALL"
_IMAGE = f"list_contains({texts(K.IMAGE_EXTENSIONS)}, ext)"
_FLAT = "source || '__' || array_to_string(dirs, '_') || '_' || id || sfx"
ORACLES["flat_names"] = f"""
WITH {PATHS} SELECT id, {_FLAT} AS flat_name, class_index,
  source || '_' || lpad(class_index::varchar, 6, '0') || '_' || substr(md5(path), 1, 6) || ext AS dest
FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY md5('42:' || path), path) - 1 AS class_index
      FROM lake WHERE {_IMAGE})"""
ORACLES["source_of"] = f"""
WITH {PATHS} SELECT id, CASE WHEN id % 4 = 0 THEN 'desconhecido' ELSE source END AS source FROM lake"""
ORACLES["keep_list"] = f"""
WITH {PATHS} SELECT id, CASE WHEN lower(folder) LIKE '%\\_\\_\\_healthy' ESCAPE '\\' THEN 'healthy' ELSE 'anomalous' END AS label,
  'pv_' || substr(folder, 1, 30) || '_' || id || sfx AS dest
FROM lake WHERE list_contains({texts(K.KEEP_FOLDERS)}, folder) AND {_IMAGE}"""
ORACLES["skip_sources"] = f"""
WITH {PATHS} SELECT source, count(*) AS n FROM lake WHERE sn NOT BETWEEN 1 AND 5 AND {_IMAGE} GROUP BY 1"""
ORACLES["class_root"] = f"""
WITH {PATHS}, holders AS (
  SELECT source, 0 AS depth, source AS root FROM lake WHERE contains(dirs[1], '___')
  UNION ALL SELECT source, 1, source || '/' || dirs[1] FROM lake WHERE contains(dirs[2], '___'))
SELECT source, arg_min(root, (depth, root)) AS root, min(depth) AS depth FROM holders GROUP BY 1"""
ORACLES["admission"] = f"""
SELECT page_id, CASE WHEN page_id % 7 IN (4, 5) THEN 415 WHEN octet_length(encode(html)) > 2000 THEN 413 END AS reject_code
FROM pages"""
ORACLES["truth_alias"] = f"""
WITH f AS (SELECT {texts(['healthy', 'ANOMALOUS', 'Not_a_leaf', 'nao_folha', 'leaves'])}[doc_id % 5 + 1] AS folder FROM documents)
SELECT folder, CASE lower(folder) WHEN 'healthy' THEN 'healthy' WHEN 'anomalous' THEN 'anomalous'
  WHEN 'not_a_leaf' THEN 'nao_folha' WHEN 'nao_folha' THEN 'nao_folha' END AS truth, count(*) AS n FROM f GROUP BY ALL"""
ORACLES["sufficiency"] = f"""
{MAPPED}, c AS (SELECT k.class, count(m.id) AS n FROM (SELECT unnest({texts(K.CLASS_NAMES)}) AS class) k
  LEFT JOIN mapped m USING (class) GROUP BY 1)
SELECT class, n, {r6('100.0::double * n / sum(n) OVER ()')} AS pct, n < 300 AS insufficient,
  CASE WHEN n = 0 THEN 'empty' WHEN n < 300 THEN 'insufficient' WHEN n < 800 THEN 'acceptable' ELSE 'ok' END AS tier FROM c"""
ORACLES["source_class_counts"] = f"""
{MAPPED} SELECT source, class, count(*) AS n FROM mapped GROUP BY ALL
UNION ALL SELECT source, NULL, count(*) FROM mapped GROUP BY source"""
BOXES = """
ev AS (SELECT *, event_id // 2 AS image, 'boxes' || (event_id // 2) % 3 AS dataset FROM events),
ln AS (SELECT dataset, image, CASE WHEN value < 2 THEN NULL WHEN event_type IN ('view', 'purchase') THEN '0' WHEN event_type = 'click' THEN '1'
  WHEN event_type = 'signup' THEN '2' WHEN value < 10 THEN 'abc' WHEN value < 20 THEN '9' ELSE '3' END AS cid FROM ev)
"""
ORACLES["annotation_lines"] = f"""
WITH {BOXES} SELECT dataset, TRY_CAST(cid AS int) AS class_id, count(*) AS n FROM ln GROUP BY ALL"""
ORACLES["annotation_labels"] = f"""
WITH {BOXES}, im AS (SELECT DISTINCT dataset, image FROM ev WHERE event_id % 2 = 0)
SELECT im.dataset, im.image, CASE
  WHEN count(cid) FILTER (cid <> 'abc') = 0 OR count(*) FILTER (cid IN ('9', '3')) > 0 THEN 'dropped'
  WHEN count(*) FILTER (cid IN ('1', '2')) > 0 THEN 'anomalous' ELSE 'healthy' END AS outcome
FROM im LEFT JOIN ln USING (dataset, image) GROUP BY ALL"""
ORACLES["dest_dedupe"] = f"""
WITH {PATHS}, d AS (SELECT folder || '/' || (id % 40) AS dest, path, id FROM lake)
SELECT dest, min(path) AS path, arg_min(id, path) AS id, count(*) - 1 AS collisions FROM d GROUP BY 1"""
ORACLES["idempotent_copy"] = """
SELECT count(*) FILTER (doc_id % 3 <> 0) AS copied, count(*) FILTER (doc_id % 3 = 0) AS skipped FROM documents"""
ORACLES["source_union"] = f"""
{MAPPED} SELECT 'first_map' AS tag, class, count(*) AS n FROM mapped GROUP BY ALL
UNION ALL SELECT 'by_name', {infer('folder')} AS class, count(*) FROM lake WHERE {infer('folder')} IS NOT NULL GROUP BY ALL"""

# --- balance and sampling ---------------------------------------------------------------------

LABELLED_DOCS = """
ld AS (SELECT doc_id AS id, source || '__' || doc_id || '.txt' AS path, source,
       CASE WHEN quality = 1 THEN 'healthy' ELSE 'anomalous' END AS label, quality AS label_idx, toxic, n_chars
       FROM documents JOIN labels USING (doc_id))
"""
SPLIT_DOCS = f"{LABELLED_DOCS}, {row_split('ld', 'sd')}"
CELLS = f"""
{SPLIT_DOCS},
cellc AS (SELECT s.split, l.label, count(sd.id) AS n
  FROM (SELECT unnest({texts(K.SPLITS)}) AS split) s CROSS JOIN (SELECT unnest({texts(K.LABELS)}) AS label) l
  LEFT JOIN sd ON sd.split = s.split AND sd.label = l.label GROUP BY ALL),
wide AS (SELECT coalesce(split, 'TOTAL') AS split, sum(n) FILTER (label = 'healthy')::bigint AS healthy,
  sum(n) FILTER (label = 'anomalous')::bigint AS anomalous FROM cellc GROUP BY ROLLUP (split)),
ratios AS (SELECT *, healthy + anomalous AS total, CASE WHEN healthy > 0 AND anomalous > 0
  THEN {r6('greatest(healthy, anomalous)::double / least(healthy, anomalous)')} END AS ratio FROM wide)
"""
ORACLES["row_split"] = f"WITH {SPLIT_DOCS} SELECT id, label, split FROM sd"
ORACLES["split_label_counts"] = f"WITH {CELLS} SELECT * FROM ratios"
ORACLES["dataset_alerts"] = f"""
WITH {CELLS}
SELECT CASE WHEN n = 0 THEN 'empty' ELSE 'low' END AS alert, split, label, n, NULL::double AS ratio FROM cellc WHERE n < 200
UNION ALL SELECT 'unbalanced', split, CASE WHEN healthy > anomalous THEN 'healthy' ELSE 'anomalous' END,
  greatest(healthy, anomalous), ratio FROM ratios WHERE split = 'train' AND ratio > 3
UNION ALL SELECT 'collect_more', NULL, label, sum(n)::bigint, NULL FROM cellc GROUP BY label HAVING sum(n) < 200"""
ORACLES["total_alerts"] = f"""
WITH {CELLS}
SELECT CASE WHEN ratio > 3 THEN 'unbalanced' ELSE 'balanced' END AS alert, NULL AS split,
  CASE WHEN ratio > 3 THEN CASE WHEN healthy > anomalous THEN 'healthy' ELSE 'anomalous' END END AS label,
  total AS n, ratio FROM ratios WHERE split = 'TOTAL' AND healthy > 0 AND anomalous > 0
UNION ALL SELECT 'low', split, label, n, NULL FROM cellc WHERE n > 0 AND n < 200"""
ORACLES["required_cells"] = f"""
WITH {SPLIT_DOCS} SELECT s.split, l.label, t.toxic
FROM (SELECT unnest({texts(K.SPLITS)}) AS split) s, (SELECT unnest({texts(K.LABELS)}) AS label) l, (SELECT unnest(['0', '1', '2']) AS toxic) t
WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.split = s.split AND sd.label = l.label AND sd.toxic::varchar = t.toxic)"""
ORACLES["class_distribution"] = f"WITH {LABELLED_DOCS} SELECT label, count(*) AS n FROM ld GROUP BY 1"
ORACLES["class_weights"] = f"""
WITH {LABELLED_DOCS}, c AS (SELECT label, count(*) AS n FROM ld GROUP BY 1)
SELECT label, n, {r6('sum(n) OVER () / (count(*) OVER () * n)::double')} AS weight,
  {r6('max(n) OVER () / (min(n) OVER ())::double')} AS max_min_ratio FROM c"""
ORACLES["class_weights_with_absent"] = f"""
WITH {LABELLED_DOCS}, c AS (SELECT label, count(*) AS n FROM ld GROUP BY 1)
SELECT label, n, {r6('sum(n) OVER () / (count(*) OVER () * n)::double')} AS weight,
  {r6('max(n) OVER () / (min(n) OVER ())::double')} AS max_min_ratio FROM c
UNION ALL SELECT 'unseen', 0, 0.0::double, (SELECT {r6('max(n) / min(n)::double')} FROM c)"""
ORACLES["loss_weights"] = f"""
WITH {LABELLED_DOCS}, c AS (SELECT count(*) FILTER (label = 'healthy') AS h, count(*) FILTER (label = 'anomalous') AS a FROM ld)
SELECT {r6('(h + a) / (2.0::double * h)')} AS healthy_weight, {r6('(h + a) / (2.0::double * a)')} AS anomalous_weight,
  {r6('greatest(h, a) / least(h, a)::double')} AS ratio FROM c"""
ORACLES["source_pivot"] = f"""
WITH {SPLIT_DOCS} SELECT source, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
  count(*) FILTER (split = 'test') AS test FROM sd GROUP BY 1"""
_RANKED = "SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || path), path) AS rk, count(*) OVER (PARTITION BY label) AS cn FROM ld"
ORACLES["class_cap"] = f"WITH {LABELLED_DOCS}, k AS ({_RANKED}) SELECT id, label FROM k WHERE rk <= 50"
ORACLES["capped_sufficiency"] = f"""
WITH {LABELLED_DOCS}, k AS ({_RANKED}), c AS (SELECT l.label, count(k.id) AS n
  FROM (SELECT unnest({texts(K.LABELS)}) AS label) l LEFT JOIN k ON k.label = l.label AND k.rk <= 50 GROUP BY 1)
SELECT label, n, {r6('100.0::double * n / sum(n) OVER ()')} AS pct, n < 300 AS insufficient,
  CASE WHEN n = 0 THEN 'empty' WHEN n < 300 THEN 'insufficient' WHEN n < 800 THEN 'acceptable' ELSE 'ok' END AS tier FROM c"""
ORACLES["sample_grid"] = f"WITH {LABELLED_DOCS}, k AS ({_RANKED}) SELECT id, label, rk::int AS slot FROM k WHERE rk <= 8"
ORACLES["balanced_resample"] = f"""
WITH {LABELLED_DOCS}, k AS ({_RANKED}),
cls AS (SELECT label, count(*) AS cn, row_number() OVER (ORDER BY label) - 1 AS ci FROM ld GROUP BY 1),
dr AS (SELECT i AS draw, md5('42:draw:' || i) AS h FROM (SELECT unnest(range((SELECT count(*) FROM ld))) AS i))
SELECT draw, k.label, k.id FROM dr JOIN cls ON ci = ('0x' || substr(h, 1, 8))::bigint % (SELECT count(*) FROM cls)
JOIN k ON k.label = cls.label AND k.rk - 1 = ('0x' || substr(h, 9, 13))::bigint % cls.cn"""
# Slots in order of the class; a slot's threshold is its own share of an even sixth, filled up by one other class.
_SLOTS = ", ".join(
    f"({slot}, {own}, {limit}, {list(Q.DRAW_WEIGHTS)[other]})"
    for slot, (own, (limit, other)) in enumerate(zip(Q.DRAW_WEIGHTS, Q.SP.alias_table(list(Q.DRAW_WEIGHTS.values()))))
)
ORACLES["weighted_resample"] = f"""
WITH ld AS (SELECT vec_id, label, 'vec/' || vec_id AS path FROM embeddings), k AS ({_RANKED}),
slot(ci, own, lim, other) AS (VALUES {_SLOTS}),
dr AS (SELECT i AS draw, md5('42:draw:' || i) AS h FROM (SELECT unnest(range((SELECT count(*) FROM ld))) AS i)),
picked AS (SELECT draw, h, CASE WHEN ('0x' || substr(h, 22, 8))::bigint < lim THEN own ELSE other END AS label
  FROM dr JOIN slot ON ci = ('0x' || substr(h, 1, 8))::bigint % 6)
SELECT draw, k.label, k.vec_id FROM picked JOIN k ON k.label = picked.label AND k.rk - 1 = ('0x' || substr(h, 9, 13))::bigint % k.cn"""
ORACLES["same_class_fill"] = """
WITH r AS (SELECT d.doc_id AS id, lang, l.doc_id IS NOT NULL AS readable, source || '/' || d.doc_id AS path
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT id, lang, readable, CASE WHEN readable THEN path ELSE coalesce(
  (SELECT arg_min(b.path, b.id) FROM r b WHERE b.lang = a.lang AND b.readable AND b.id > a.id),
  (SELECT arg_min(b.path, b.id) FROM r b WHERE b.lang = a.lang AND b.readable)) END AS used FROM r a"""

# --- scores -----------------------------------------------------------------------------------

SCORES10 = """
cell AS (SELECT vec_id, label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label AS cls, i, avg(v) AS c FROM cell WHERE vec_id % 2 = 0 GROUP BY ALL),
logit AS (SELECT vec_id AS id, label AS label_idx, (row_number() OVER (PARTITION BY vec_id ORDER BY cls) - 1)::int AS k,
          40.0::double * z AS z
          FROM (SELECT vec_id, label, cls, sum(v * c) AS z FROM cell JOIN cent USING (i) WHERE vec_id % 2 = 1 GROUP BY ALL))
"""


def probs10(temperature: str = "1.0", out: str = "prob") -> str:
    return f"""
{out}_e AS (SELECT *, exp((z - max(z) OVER (PARTITION BY id)) / {temperature}) AS e FROM logit),
{out} AS (SELECT id, label_idx, k, e / sum(e) OVER (PARTITION BY id) AS p FROM {out}_e),
{out}_p AS (SELECT id, any_value(label_idx) AS label_idx, arg_max(k, p) AS pred, max(p) AS confidence,
            (arg_max(k, p) = any_value(label_idx))::int::double AS correct FROM {out} GROUP BY id)
"""


SCORES2 = f"""
{LABELLED_DOCS},
mdl(model, a, b) AS (VALUES {", ".join(f"('{m}', {a}::double, {b}::double)" for m, a, b in A.SCORE_MODELS)}),
s2 AS (SELECT id, model, CASE WHEN id % 2 = 0 THEN 'val' ELSE 'test' END AS split, label_idx, toxic, a * (ln(n_chars) - b) AS z
       FROM ld CROSS JOIN mdl)
"""


def probs2(temperature: str = "1.0::double", out: str = "pr", source: str = "s2") -> str:
    return f"""
{out}_x AS (SELECT *, exp((0 - greatest(z, 0)) / {temperature}) AS e0, exp((z - greatest(z, 0)) / {temperature}) AS e1 FROM {source}),
{out} AS (SELECT *, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1, greatest(e0, e1) / (e0 + e1) AS confidence,
          (z > 0)::int AS pred, ((z > 0)::int = label_idx)::int::double AS correct FROM {out}_x)
"""


_TEMPS = values([(m, t) for m, t in Q.FIXED_TEMPERATURES])
TEMPERED = f"""
{SCORES2}, tmp(model, t) AS (VALUES {_TEMPS}),
st AS (SELECT s2.*, coalesce(t, 1.0)::double AS t FROM s2 LEFT JOIN tmp USING (model))
"""
TWO_SETS = f"""
{SCORES10}, {probs10()}, {SCORES2}, {probs2()},
preds AS (SELECT 'c10' AS model, label_idx, pred, confidence, correct FROM prob_p
          UNION ALL SELECT model, label_idx, pred, confidence, correct FROM pr)
"""


def per_class(preds: str, by: str = "model") -> str:
    return f"""
pc AS (SELECT {by}, c AS class, count(*) FILTER (label_idx = c) AS support, count(*) FILTER (pred = c) AS predicted,
       count(*) FILTER (label_idx = c AND pred = c) AS hits
       FROM {preds} JOIN (SELECT {by} AS mm, label_idx AS c FROM {preds} UNION SELECT {by}, pred FROM {preds}) ON mm = {by}
       GROUP BY ALL),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::double ELSE 0 END AS precision,
        CASE WHEN support > 0 THEN hits / support::double ELSE 0 END AS recall,
        2.0::double * hits / (support + predicted) AS f1 FROM pc),
head AS (SELECT {by}, sum(support)::bigint AS n, sum(hits) / sum(support)::double AS accuracy, avg(recall) FILTER (support > 0) AS balanced_accuracy,
         avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro FROM prf GROUP BY 1)
"""


_HEAD = ", ".join(
    f"{r6(c)} AS {c}" for c in ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro")
)


def bins(preds: str, out: str = "bn") -> str:
    """Right-closed bins by joining with the bin edges themselves."""
    return f"""
edge{out} AS (SELECT i AS bin, (i - 1) * (1.0::double / 15) AS lo, i * (1.0::double / 15) AS hi FROM (SELECT unnest(range(1, 16)) AS i)),
{out} AS (SELECT model, bin, count(*) AS n, avg(correct) AS accuracy, avg(confidence) AS mean_confidence
          FROM {preds} JOIN edge{out} ON confidence > lo AND confidence <= hi GROUP BY ALL),
{out}_ece AS (SELECT model, sum(n * abs(accuracy - mean_confidence)) / sum(n) AS ece FROM {out} GROUP BY 1)
"""


ORACLES["softmax_scores"] = f"""
WITH {SCORES10}, {probs10()},
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS r FROM prob)
SELECT id, any_value(k) FILTER (r = 1) AS pred, any_value('class_' || k) FILTER (r = 1) AS first,
  any_value('class_' || k) FILTER (r = 2) AS second, {r6('max(p)')} AS first_score, {r6('min(p)')} AS last_score FROM rk GROUP BY id"""
ORACLES["confusion"] = f"""
WITH {SCORES10}, {probs10()}, seen AS (SELECT label_idx AS c FROM prob_p UNION SELECT pred FROM prob_p)
SELECT 'c10' AS model, a.c AS label_idx, b.c AS pred, count(p.id) AS n FROM seen a CROSS JOIN seen b
LEFT JOIN prob_p p ON p.label_idx = a.c AND p.pred = b.c GROUP BY ALL"""
ORACLES["headline_metrics"] = f"WITH {TWO_SETS}, {per_class('preds')} SELECT model, n, {_HEAD} FROM head"
ORACLES["per_class_report"] = f"""
WITH {SCORES10}, {probs10()}, c10 AS (SELECT 'c10' AS model, * FROM prob_p), {per_class('c10')}
SELECT model, class, support, predicted, hits, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1 FROM prf"""
AUC = """
SELECT a.model, sum(CASE WHEN a.score > b.score THEN 1.0::double WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS roc_auc
FROM {0} a JOIN {0} b ON a.model = b.model AND a.label_idx = 1 AND b.label_idx = 0 GROUP BY a.model
"""
ORACLES["roc_auc"] = f"""
WITH {SCORES2}, {probs2()}, sc AS (SELECT model, label_idx, p1 AS score FROM pr
  UNION ALL SELECT model || '_tied', label_idx, floor(p1 * 20) / 20 FROM pr)
SELECT model, {r6('roc_auc')} AS roc_auc FROM ({AUC.format('sc')})"""
ORACLES["ece"] = f"WITH {TWO_SETS}, {bins('preds')} SELECT model, {r6('ece')} AS ece FROM bn_ece"
ORACLES["reliability"] = f"""
WITH {SCORES2}, {probs2()}, {bins('pr')} SELECT model, bin::int AS bin, n, {r6('accuracy')} AS accuracy,
  {r6('mean_confidence')} AS mean_confidence, {r6('(bin - 0.5::double) / 15')} AS center FROM bn"""
ORACLES["mean_confidence"] = f"""
WITH {SCORES10}, {probs10()}, {probs10('3.0', 'hot')}
SELECT 'c10' AS model, {r6('avg(confidence)')} AS mean_confidence, {r6('avg(correct)')} AS accuracy, 'before' AS stage FROM prob_p
UNION ALL SELECT 'c10', {r6('avg(confidence)')}, {r6('avg(correct)')}, 'after' FROM hot_p"""
ORACLES["nll_curve"] = f"""
WITH {SCORES2}, ts AS (SELECT unnest({Q.CURVE!r})::double AS temperature)
SELECT model, temperature, {r6('avg(ln(1 + exp(CASE WHEN label_idx = 1 THEN -z ELSE z END / temperature)))')} AS nll
FROM s2 CROSS JOIN ts GROUP BY ALL"""
ORACLES["fit_temperature"] = f"""
WITH RECURSIVE {SCORES2}, v AS (SELECT model, label_idx, z FROM s2 WHERE split = 'val'),
newton AS (
  SELECT model, 0 AS step, 1.0::double AS beta FROM (SELECT DISTINCT model FROM v)
  UNION ALL
  SELECT model, step + 1, least(greatest(beta - g / h, 1e-3), 1e3) FROM (
    SELECT n.model, n.step, n.beta, avg(z / (1 + exp(-z * beta)) - label_idx * z) AS g,
           avg(z * z * (1 / (1 + exp(-z * beta))) * (1 - 1 / (1 + exp(-z * beta)))) AS h
    FROM newton n JOIN v USING (model) WHERE n.step < 40 GROUP BY ALL))
SELECT model, {r6('1 / beta', 4)} AS temperature, beta IN (1e-3, 1e3) AS at_bound FROM newton WHERE step = 40"""
# The slope's sign halves a bracket of 1 / T; no curvature is needed.
ORACLES["fit_temperature_saturated"] = f"""
WITH RECURSIVE {SCORES2}, v AS (SELECT model, label_idx, z * 60 AS z FROM s2 WHERE split = 'val'),
half AS (
  SELECT model, 0 AS step, 1e-3::double AS lo, 1e3::double AS hi FROM (SELECT DISTINCT model FROM v)
  UNION ALL
  SELECT model, step + 1, CASE WHEN g > 0 THEN lo ELSE sqrt(lo * hi) END, CASE WHEN g > 0 THEN sqrt(lo * hi) ELSE hi END FROM (
    SELECT n.model, n.step, n.lo, n.hi, avg(z / (1 + exp(greatest(-700, least(700, -z * sqrt(lo * hi))))) - label_idx * z) AS g
    FROM half n JOIN v USING (model) WHERE n.step < 60 GROUP BY ALL))
SELECT model, {r6('1 / sqrt(lo * hi)', 3)} AS temperature, lo = 1e-3 OR hi = 1e3 AS at_bound FROM half WHERE step = 60"""
THRESHOLD = """
SELECT model, coalesce(min(tau) FILTER (ok), 0.5) AS threshold,
  coalesce(arg_min(n / n_all::double, tau) FILTER (ok), 1.0) AS coverage,
  coalesce(arg_min(acc, tau) FILTER (ok), any_value(acc_all)) AS selective_accuracy
FROM (SELECT *, n >= greatest(20, 0.05 * n_all) AND acc >= {1} AS ok FROM (
  SELECT q.model, tau, count(*) FILTER (confidence >= tau) AS n, avg(correct) FILTER (confidence >= tau) AS acc,
         count(*) AS n_all, avg(correct) AS acc_all
  FROM {0} q CROSS JOIN (SELECT 0.5::double + i * 0.01::double AS tau FROM (SELECT unnest(range(50)) AS i)) GROUP BY ALL)) GROUP BY model
"""
ORACLES["pick_threshold"] = f"""
WITH {SCORES2}, vv AS (SELECT * FROM s2 WHERE split = 'val'), {probs2(source='vv')}
SELECT model, {r6('threshold')} AS threshold, {r6('coverage')} AS coverage, {r6('selective_accuracy')} AS selective_accuracy
FROM ({THRESHOLD.format('pr', '0.87')})"""
ORACLES["calibration_row"] = f"""
WITH {TEMPERED}, vv AS (SELECT * FROM st WHERE split = 'val'), {probs2(source='vv')}, {probs2('t', 'af', 'vv')},
{bins('pr', 'b1')}, {bins('af', 'b2')}, th AS ({THRESHOLD.format('af', '0.95')}),
ac AS (SELECT model, avg(correct) AS acc FROM af GROUP BY 1)
SELECT model, {r6('t::double')} AS temperature, {r6('threshold', 4)} AS threshold, {r6('b1_ece.ece')} AS ece_before,
  {r6('b2_ece.ece')} AS ece_after, {r6('acc')} AS val_accuracy, {r6('coverage', 4)} AS coverage_at_threshold,
  {r6('selective_accuracy', 4)} AS selective_accuracy
FROM tmp JOIN th USING (model) JOIN b1_ece USING (model) JOIN b2_ece USING (model) JOIN ac USING (model)"""
ORACLES["model_comparison"] = f"""
WITH {TEMPERED}, tst AS (SELECT * FROM st WHERE split = 'test'), {probs2('t', 'pr', 'tst')}, {per_class('pr')}, {bins('pr')},
sc AS (SELECT model, label_idx, p1 AS score FROM pr), auc AS ({AUC.format('sc')}),
mc AS (SELECT model, avg(confidence) AS mean_confidence, any_value(t) AS temperature FROM pr GROUP BY 1)
SELECT model, n, {_HEAD}, {r6('roc_auc')} AS roc_auc, {r6('ece')} AS ece, {r6('mean_confidence')} AS mean_confidence, temperature,
  row_number() OVER (ORDER BY f1_macro DESC, model)::int AS rank
FROM head JOIN auc USING (model) JOIN bn_ece USING (model) JOIN mc USING (model)"""
ORACLES["smoothed_ce"] = f"""
WITH {SCORES2}, w AS (SELECT label_idx, sum(count(*)) OVER () / (count(*) OVER () * count(*))::double AS w FROM ld GROUP BY 1),
w2 AS (SELECT max(w) FILTER (label_idx = 0) AS w0, max(w) FILTER (label_idx = 1) AS w1 FROM w),
lp AS (SELECT model, label_idx, w0, w1, -ln(1 + exp(z)) AS l0, -ln(1 + exp(-z)) AS l1 FROM s2, w2)
SELECT model, {r6("sum(0.9 * CASE WHEN label_idx = 1 THEN -w1 * l1 ELSE -w0 * l0 END + 0.05 * (-w0 * l0 - w1 * l1)) / sum(CASE WHEN label_idx = 1 THEN w1 ELSE w0 END)")} AS loss
FROM lp GROUP BY 1"""
ORACLES["smoothed_ce_absent_class"] = f"""
WITH {SCORES2}, w AS (SELECT label_idx, sum(count(*)) OVER () / (count(*) OVER () * count(*))::double AS w FROM ld GROUP BY 1),
w2 AS (SELECT max(w) FILTER (label_idx = 0) AS w0, max(w) FILTER (label_idx = 1) AS w1 FROM w),
lp AS (SELECT model, label_idx, w0, w1, -ln(exp(-3) + 1 + exp(z)) AS l0, z - ln(exp(-3) + 1 + exp(z)) AS l1 FROM s2, w2)
SELECT model, {r6("sum(0.9 * CASE WHEN label_idx = 1 THEN -w1 * l1 ELSE -w0 * l0 END + 0.1 / 3 * (-w0 * l0 - w1 * l1)) / sum(CASE WHEN label_idx = 1 THEN w1 ELSE w0 END)")} AS loss
FROM lp GROUP BY 1"""
ORACLES["fn_fp_rank"] = f"""
WITH {SCORES2}, c AS (SELECT model, count(*) FILTER (label_idx = 1 AND z <= 0) AS false_negatives,
  count(*) FILTER (label_idx = 0 AND z > 0) AS false_positives FROM s2 GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY false_negatives, false_positives, model)::int AS rank FROM c"""
ORACLES["select_model"] = f"""
WITH {SCORES2}, vv AS (SELECT * FROM s2 WHERE split = 'val'), {probs2(source='vv')}, {per_class('pr')}
SELECT model, n, {r6('accuracy')} AS accuracy, {r6('f1_macro')} AS f1_macro FROM head ORDER BY head.f1_macro DESC, model LIMIT 1"""
ORACLES["epoch_metrics"] = f"""
SELECT user_id % 4 AS model, event_id // 500 AS epoch,
  {r6('sum(value * (event_id % 32 + 1)) / sum(event_id % 32 + 1)')} AS loss,
  {r6('sum(greatest(event_id % 32 + 1 - event_id % 3, 0)) / sum(event_id % 32 + 1)::double')} AS accuracy
FROM events GROUP BY ALL"""
ORACLES["early_stop"] = f"""
WITH e AS (SELECT user_id AS model, event_id AS epoch, value, row_number() OVER w AS pos,
           max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, value > coalesce(best, -1) AS improved FROM e),
m AS (SELECT *, pos - coalesce(max(pos) FILTER (improved) OVER (PARTITION BY model ORDER BY epoch), 0) AS misses FROM i),
s AS (SELECT model, min(pos) FILTER (misses >= {Q.PATIENCE}) AS stop FROM m GROUP BY 1),
k AS (SELECT m.*, stop IS NULL OR pos <= stop AS kept FROM m JOIN s USING (model))
SELECT model, arg_max(epoch, pos) FILTER (kept AND improved) AS best_epoch, arg_max(value, pos) FILTER (kept AND improved) AS best_metric,
  max(epoch) FILTER (kept) AS last_epoch, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_cut FROM k GROUP BY 1"""

# --- decisions, field test, history -----------------------------------------------------------

_CAL = values([(m, t, 0.8) for m, t in Q.FIXED_TEMPERATURES])
DECIDED = f"""
{SCORES2}, cal(model, t, tau) AS (VALUES {_CAL}),
vg AS (SELECT doc_id AS id, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) / n_chars::double AS veg FROM documents),
sv AS (SELECT s2.*, coalesce(t, 1.0)::double AS t, coalesce(tau, 0.7)::double AS tau, veg FROM s2 JOIN vg USING (id) LEFT JOIN cal USING (model)),
{probs2('t', 'dp', 'sv')},
dec AS (SELECT *, veg < {Q.DECISION_MIN_VEG} AS gate, CASE WHEN veg < {Q.DECISION_MIN_VEG} THEN 'not_a_leaf' WHEN confidence < tau THEN 'inconclusive'
        WHEN p0 >= p1 THEN 'healthy' ELSE 'anomalous' END AS label FROM dp),
fld AS (SELECT *, label AS answer, CASE WHEN toxic = 1 THEN 'nao_folha' WHEN label_idx = 1 THEN 'anomalous' ELSE 'healthy' END AS truth FROM dec)
"""
_GATED = ", ".join(
    f"{r6(f'CASE WHEN gate THEN 0 ELSE {c} END')} AS {n}"
    for c, n in (("confidence", "confidence"), ("p0", "healthy_prob"), ("p1", "anomalous_prob"))
)
ORACLES["decide"] = f"""
WITH {DECIDED} SELECT id, model, label, {_GATED}, {r6('veg')} AS vegetation_fraction, t <> 1 AS is_temperature_scaled,
  CASE label WHEN 'not_a_leaf' THEN {text(K.NOT_A_LEAF_MESSAGE)} WHEN 'inconclusive' THEN
  {text(K.INCONCLUSIVE_MESSAGE[0])} || round_even(confidence * 100, 0)::int || {text(K.INCONCLUSIVE_MESSAGE[1])} END AS message FROM dec"""
ORACLES["decide_raw"] = f"""
WITH {SCORES2}, {probs2()} SELECT id, model, CASE WHEN p0 >= p1 THEN 'healthy' ELSE 'anomalous' END AS label,
  {r6('confidence')} AS confidence, {r6('p0')} AS healthy_prob, {r6('p1')} AS anomalous_prob FROM pr"""
ORACLES["decide_multiclass"] = f"""
WITH {SCORES10}, {probs10()} SELECT id, 'class_' || pred AS predicted_class, {r6('confidence')} AS confidence,
  confidence >= 0.5 AS accepted FROM prob_p"""
ORACLES["scores_json"] = f"WITH {SCORES10}, {probs10()} SELECT id, 'class_' || k AS class, {r6('p')} AS score FROM prob"
ORACLES["field_marks"] = f"""
WITH {DECIDED} SELECT id, model, truth, answer, CASE WHEN truth = 'nao_folha' THEN CASE WHEN answer = 'not_a_leaf' THEN 'hit' ELSE 'miss' END
  WHEN answer = truth THEN 'hit' WHEN answer IN ('healthy', 'anomalous') THEN 'miss' ELSE 'n/a' END AS hit FROM fld"""
_ANSWERS = ", ".join(f"count(*) FILTER (answer = '{a}') AS {a}" for a in K.FIELD_ANSWERS)
ORACLES["field_confusion"] = f"""
WITH {DECIDED} SELECT f.truth, {_ANSWERS}
FROM (SELECT unnest({texts(K.FIELD_TRUTHS)}) AS truth) f LEFT JOIN fld USING (truth) GROUP BY 1"""
# Mean recall over the classes that have a decided row.
_RECALLS = """coalesce((CASE WHEN decided_healthy > 0 THEN correct_healthy / decided_healthy::double ELSE 0 END
  + CASE WHEN decided_anomalous > 0 THEN correct_anomalous / decided_anomalous::double ELSE 0 END)
  / nullif((decided_healthy > 0)::int + (decided_anomalous > 0)::int, 0), 0)"""
ORACLES["field_test"] = f"""
WITH {DECIDED}, c AS (SELECT count(*) AS total,
  count(*) FILTER (truth <> 'nao_folha' AND answer IN ('healthy', 'anomalous')) AS decided,
  count(*) FILTER (truth <> 'nao_folha' AND answer = 'inconclusive') AS abstained,
  count(*) FILTER (truth <> 'nao_folha' AND answer = 'not_a_leaf') AS rejected_leaves,
  count(*) FILTER (truth = answer AND truth <> 'nao_folha') AS correct,
  count(*) FILTER (truth = 'healthy' AND answer IN ('healthy', 'anomalous')) AS decided_healthy,
  count(*) FILTER (truth = 'anomalous' AND answer IN ('healthy', 'anomalous')) AS decided_anomalous,
  count(*) FILTER (truth = 'healthy' AND answer = 'healthy') AS correct_healthy,
  count(*) FILTER (truth = 'anomalous' AND answer = 'anomalous') AS correct_anomalous,
  count(*) FILTER (truth = 'nao_folha') AS non_leaves,
  count(*) FILTER (truth = 'nao_folha' AND answer = 'not_a_leaf') AS non_leaves_rejected,
  count(*) FILTER (truth = 'nao_folha' AND answer IN ('healthy', 'anomalous')) AS non_leaves_diagnosed FROM fld)
SELECT *, {r6('correct / decided::double')} AS accuracy,
  {r6(_RECALLS)} AS balanced_accuracy,
  {r6('abstained / total::double')} AS abstention_rate, {r6('rejected_leaves / total::double')} AS leaf_rejection_rate FROM c"""


def _balanced(split: str) -> str:
    return f"""SELECT model, (avg((z <= 0)::int) FILTER (label_idx = 0) + avg((z > 0)::int) FILTER (label_idx = 1)) / 2 AS b
FROM s2 WHERE split = '{split}' GROUP BY 1"""


ORACLES["domain_gap"] = f"""
WITH {SCORES2}, v AS ({_balanced('val')}), t AS ({_balanced('test')})
SELECT model, {r6('v.b')} AS in_domain, {r6('t.b')} AS field, {r6('v.b - t.b')} AS gap FROM v JOIN t USING (model)"""
DIAG = f"""
dg AS (SELECT event_id AS id, ts AS created_at, {texts(A.MODEL_NAMES)}[user_id % 4 + 1] AS model_name,
  CASE event_type WHEN 'view' THEN 'saudavel' WHEN 'click' THEN 'mildio' ELSE event_type END AS predicted_class,
  CASE event_type WHEN 'view' THEN 'Saudável' WHEN 'click' THEN 'Míldio' ELSE event_type END AS predicted_label,
  value / (value + 50.0::double) AS confidence, true AS demo_mode FROM events)
"""
ORACLES["history_page"] = f"""
WITH {DIAG} SELECT id, model_name, predicted_class, {r6('confidence')} AS confidence, demo_mode, predicted_label
FROM dg ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100"""
ORACLES["history_delete"] = f"""
WITH {DIAG} SELECT predicted_class, count(*) AS n FROM dg WHERE NOT (predicted_class = 'error' AND confidence < 0.2) GROUP BY 1"""
ORACLES["history_delete_days"] = f"""
WITH {DIAG} SELECT created_at::date::varchar AS day, predicted_class, count(*) AS n, sum(id)::bigint AS sum_id
FROM dg WHERE NOT (predicted_class = 'error' AND confidence < 0.2) GROUP BY ALL"""
ORACLES["dashboard"] = f"""
WITH {DIAG}, l AS (SELECT * FROM dg ORDER BY created_at DESC, id DESC LIMIT 200)
SELECT predicted_class, predicted_label, count(*) AS n, (SELECT count(*) FROM l) AS n_shown,
  {r6('(SELECT 100.0::double * avg(confidence) FROM l)')} AS mean_confidence_pct FROM l GROUP BY ALL"""
ORACLES["stream_dashboard"] = f"""
WITH {DIAG} SELECT predicted_class, count(*) AS n, {r6('avg(confidence)')} AS mean_confidence FROM dg GROUP BY 1"""
ORACLES["stream_dashboard_latest"] = ORACLES["dashboard"]
ORACLES["model_catalogue"] = f"""
WITH {DIAG}, r AS (SELECT model_name AS model FROM dg GROUP BY 1 HAVING count(*) * 4 > (SELECT count(*) FROM dg)),
cat(model, label) AS (VALUES {values(K.MODEL_LABELS.items())})
SELECT cat.model, label, r.model IS NOT NULL AS has_weights, (SELECT count(*) FROM r) AS n_ready FROM cat LEFT JOIN r USING (model)"""
ORACLES["evaluable_models"] = f"WITH {SCORES2} SELECT model, count(*) AS n FROM s2 WHERE model <> 'm_flat' GROUP BY 1"
ORACLES["fit_baseline_counts"] = """
SELECT label::int AS label_idx, count(*) AS n_scored, count(*) AS n_decided FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1"""
# The optimum by plain gradient steps from zero; without a penalty it is one, whatever the method.
ORACLES["fit_baseline_optimum"] = """
WITH RECURSIVE x AS (SELECT vec_id % 2 = 0 AS fit, (label = 3)::int AS y, 8 * embedding[1]::double AS x1, 8 * embedding[2]::double AS x2 FROM embeddings),
t AS (SELECT y, x1, x2, 0.5::double / count(*) OVER (PARTITION BY y) AS w FROM x WHERE fit),
s AS (
  SELECT 0 AS i, 0.0::double AS b0, 0.0::double AS b1, 0.0::double AS b2
  UNION ALL
  SELECT i + 1, any_value(b0) + sum(g), any_value(b1) + sum(g * x1), any_value(b2) + sum(g * x2)
  FROM (SELECT s.*, x1, x2, w * (y - 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))) AS g FROM s, t WHERE i < 600) GROUP BY i),
b AS (SELECT b0, b1, b2 FROM s WHERE i = 600)
SELECT y AS label_idx, count(*) AS n_held_out, count(*) FILTER ((b0 + b1 * x1 + b2 * x2 > 0)::int = y) AS n_right,
       round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2
FROM x, b WHERE NOT fit GROUP BY y, b0, b1, b2"""
ORACLES["pixel_vegetation"] = f"""
WITH c AS (SELECT vec_id AS id, least(floor(abs(unnest(embedding)::double) * 1000.0::double), 255)::double AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT id, i // 3 AS px, coalesce(max(x) FILTER (i % 3 = 0), 0) AS r, coalesce(max(x) FILTER (i % 3 = 1), 0) AS g,
             coalesce(max(x) FILTER (i % 3 = 2), 0) AS b FROM c GROUP BY ALL)
SELECT id, {r6('avg((r + g + b > 0 AND 2 * g / (r + g + b) - r / (r + g + b) - b / (r + g + b) > 0.05)::int)')} AS vegetation FROM p GROUP BY 1"""
ORACLES["stream_decide"] = f"""
WITH n AS (SELECT vec_id AS id, round(unnest(embedding)::double * 1000.0::double)::bigint AS x, generate_subscripts(embedding, 1) AS i, len(embedding) AS k FROM embeddings),
v AS (SELECT id, coalesce(sum(x) FILTER (i <= k // 2), 0)::bigint / 200.0::double AS a, coalesce(sum(x) FILTER (i > k // 2), 0)::bigint / 200.0::double AS b,
      sum(abs(x))::bigint / any_value(k)::double / 500.0::double AS veg FROM n GROUP BY 1),
e AS (SELECT id, veg, exp(a - greatest(a, b)) AS e0, exp(b - greatest(a, b)) AS e1 FROM v),
p AS (SELECT id, veg, e0 / (e0 + e1) AS p0, e1 / (e0 + e1) AS p1 FROM e)
SELECT id, CASE WHEN veg < 0.10 THEN 'not_a_leaf' WHEN greatest(p0, p1) < 0.70 THEN 'inconclusive' WHEN p0 >= p1 THEN 'healthy' ELSE 'anomalous' END AS label,
  {r6('CASE WHEN veg < 0.10 THEN 0 ELSE greatest(p0, p1) END')} AS confidence, {r6('veg')} AS vegetation_fraction FROM p"""

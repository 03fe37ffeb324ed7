"""DuckDB SQL for the queries, written independently of the Spark operators."""

from __future__ import annotations

SLUG = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_')"
TITLE = ("array_to_string(list_transform(string_split(replace({0}, '_', ' '), ' '), "
         "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")
FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CLASSES = f"""
named AS (
  SELECT n_nationkey AS index, {SLUG.format('r_name')} AS crop, {SLUG.format('n_name')} AS disease
  FROM nation JOIN region ON n_regionkey = r_regionkey),
classes AS (
  SELECT index + 1 AS id, index, crop || '__' || disease AS key,
         {TITLE.format('crop')} || ' ' || {TITLE.format('disease')} AS display_name,
         crop, disease, crop || '/' || disease AS relative_directory
  FROM named)"""

SPLIT = "CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' WHEN 'P' THEN 'test' END"

MANIFEST = CLASSES + f""",
manifest AS (
  SELECT {SPLIT} AS split, id AS class_id, index AS class_index, key AS class_key, display_name, crop,
         disease, CAST(c_custkey AS VARCHAR) AS family_id, o_orderpriority AS augmentation,
         relative_directory || '/' || o_orderkey || '.jpg' AS relative_path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN classes ON c_nationkey = index)"""

FAULTY = CLASSES + f""",
faulty AS (
  SELECT CASE WHEN o_totalprice > 450000 THEN 'holdout' ELSE {SPLIT} END AS split,
         CASE WHEN o_totalprice < 20000 THEN NULL WHEN c_acctbal < 0 THEN id + 100 ELSE id END AS class_id,
         o_totalprice < 20000 AS bad_number,
         c_acctbal < 0 AS bad_class,
         o_orderpriority = '1-URGENT' AND c_mktsegment = 'MACHINERY' AS bad_key,
         o_orderpriority = '5-LOW' AS bad_extension,
         key, CAST(c_custkey AS VARCHAR) AS family_id,
         relative_directory || '/' || o_orderkey
           || CASE WHEN o_orderpriority = '5-LOW' THEN '.gif' ELSE '.JPG' END AS relative_path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN classes ON c_nationkey = index),
violations AS (
  SELECT 1 AS stage, 1 AS code_order, 'bad_split' AS code, relative_path FROM faulty WHERE split = 'holdout'
  UNION ALL SELECT 1, 2, 'bad_number', relative_path FROM faulty WHERE bad_number
  UNION ALL SELECT 1, 3, 'unknown_class', relative_path FROM faulty WHERE NOT bad_number AND bad_class
  UNION ALL SELECT 1, 4, 'class_mismatch', relative_path FROM faulty
            WHERE NOT bad_number AND NOT bad_class AND bad_key
  UNION ALL SELECT 1, 5, 'bad_extension', relative_path FROM faulty WHERE bad_extension)"""

DISTRIBUTION = CLASSES + """,
counts AS (SELECT s_nationkey + 2 AS class_id, count(*) AS images FROM supplier GROUP BY 1),
distribution AS (
  SELECT coalesce(id, class_id) AS class_id, coalesce(display_name, 'Unknown Class ' || class_id) AS display_name,
         id IS NOT NULL AS expected, coalesce(images, 0) AS images
  FROM classes FULL JOIN counts ON id = class_id)"""

ASSETS = CLASSES + """,
raw AS (
  SELECT CAST(substr(p_brand, 7) AS INTEGER) AS class_id, lower(p_type) || '/' || p_partkey AS relative_path,
         p_size <> 13 AS valid,
         CASE WHEN p_size <> 13 THEN p_size * 12 END AS width,
         CASE WHEN p_size <> 13 THEN CAST(round(p_retailprice * 10) AS INTEGER) % 640 + 40 END AS height,
         CASE p_type WHEN 'ECONOMY' THEN 'jpeg' WHEN 'LARGE' THEN 'png' WHEN 'MEDIUM' THEN 'bmp'
           WHEN 'PROMO' THEN 'webp' WHEN 'SMALL' THEN 'tiff' WHEN 'STANDARD' THEN 'jpeg' END AS format,
         CASE WHEN p_size <> 13 THEN CASE split_part(p_name, ' ', 1)
           WHEN 'blue' THEN 'RGB' WHEN 'cold' THEN 'RGBA' WHEN 'hot' THEN 'L' WHEN 'large' THEN 'CMYK'
           WHEN 'new' THEN 'P' WHEN 'old' THEN 'LA' WHEN 'red' THEN 'I;16' WHEN 'small' THEN 'LAB' END END AS mode,
         CAST(p_size AS BIGINT) * p_size * p_size * 100 AS file_size,
         sha256(p_name || '|' || p_size) AS sha256,
         CASE WHEN p_size <> 13 THEN substr(md5(p_name || '|' || p_type), 1, 15) END AS dhash
  FROM part),
assets AS (
  SELECT *, CAST(width AS BIGINT) * height AS pixels, width / height AS aspect_ratio,
         coalesce(width < 300 OR height < 300 OR width * height < 90000, false) AS small,
         coalesce(width < 450 OR height < 450, false) AS below_ideal_resolution,
         coalesce(width < 150 OR height < 150, false) AS severely_undersized,
         coalesce(width / height < 0.35 OR width / height > 2.85, false) AS extreme_aspect,
         file_size < 5120 AS tiny_file, file_size > 10485760 AS large_file,
         coalesce(mode IN ('1', 'L', 'LA'), false) AS grayscale,
         coalesce(mode LIKE '%A%', false) AS has_alpha,
         CASE mode WHEN 'RGB' THEN 3 WHEN 'RGBA' THEN 4 WHEN 'L' THEN 1 WHEN 'CMYK' THEN 4
           WHEN 'P' THEN 1 WHEN 'LA' THEN 2 END AS channels
  FROM raw)"""

FLAG_COUNTS = """count(*) FILTER (valid AND small) AS small,
  count(*) FILTER (valid AND below_ideal_resolution) AS below_ideal_resolution,
  count(*) FILTER (valid AND severely_undersized) AS severely_undersized,
  count(*) FILTER (valid AND extreme_aspect) AS extreme_aspect,
  count(*) FILTER (valid AND grayscale) AS grayscale, count(*) FILTER (valid AND has_alpha) AS alpha,
  count(*) FILTER (valid AND tiny_file) AS tiny_files, count(*) FILTER (valid AND large_file) AS large_files"""


def _spread(column: str, tails: bool) -> str:
    parts = [f"CAST(coalesce(min({column}) FILTER (valid), 0) AS BIGINT) AS {column}_min",
             f"round(coalesce(quantile_cont(CAST({column} AS DOUBLE), 0.5) FILTER (valid), 0), 6) AS {column}_median",
             f"round(coalesce(avg({column}) FILTER (valid), 0), 6) AS {column}_mean",
             f"CAST(coalesce(max({column}) FILTER (valid), 0) AS BIGINT) AS {column}_max"]
    if tails:
        parts += [f"round(coalesce(quantile_cont(CAST({column} AS DOUBLE), {p}) FILTER (valid), 0), 6) "
                  f"AS {column}_{name}" for p, name in ((0.1, "p10"), (0.9, "p90"))]
    return ", ".join(parts)


FILES = """
files AS (
  SELECT doc_id, source AS class_id, lang || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS relative_path,
         sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS file_size
  FROM documents),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY sha256) AS files,
         row_number() OVER (PARTITION BY sha256 ORDER BY class_id, relative_path) AS place,
         min(class_id) OVER (PARTITION BY sha256) <> max(class_id) OVER (PARTITION BY sha256) AS cross_class
  FROM files)"""


REMOVALS = ASSETS + """,
exact AS (
  SELECT *, count(*) OVER w AS n, first_value(class_id) OVER o AS first_class, first_value(relative_path) OVER o AS first_path
  FROM assets WHERE valid
  WINDOW w AS (PARTITION BY sha256), o AS (PARTITION BY sha256 ORDER BY class_id, relative_path)),
visual AS (
  SELECT *, count(*) OVER w AS m, first_value(class_id) OVER o AS second_class, first_value(relative_path) OVER o AS second_path
  FROM exact WHERE relative_path = first_path AND class_id = first_class
  WINDOW w AS (PARTITION BY dhash), o AS (PARTITION BY dhash ORDER BY class_id, relative_path)),
removals AS (
  SELECT 'exact' AS stage, class_id, relative_path, first_class AS keep_class_id, first_path AS keep_relative_path, n AS files
  FROM exact WHERE relative_path <> first_path OR class_id <> first_class
  UNION ALL SELECT 'visual', class_id, relative_path, second_class, second_path, m
  FROM visual WHERE relative_path <> second_path OR class_id <> second_class)"""


# Ten logits a vector: the sums of every tenth value.
ALL_LOGITS = "[" + ", ".join(
    " + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(k, 64, 10)) for k in range(10)) + "]"


def _hash(columns: int, rows: int, cells: str = "embedding") -> str:
    per_row = columns - 1
    terms = []
    for b in range(per_row * rows):
        at = b // per_row * columns + b % per_row + 1
        weight = 1 << (per_row * rows - 1 - b)
        terms.append(f"CASE WHEN cells[{at}] > cells[{at + 1}] THEN {weight}::BIGINT ELSE 0 END")
    return f"""
hashed AS (SELECT vec_id, label, {' + '.join(terms)} AS dhash
  FROM (SELECT *, {cells} AS cells FROM embeddings)),
spread AS (
  SELECT *, count(*) OVER (PARTITION BY dhash) AS files,
         row_number() OVER (PARTITION BY dhash ORDER BY label, vec_id) AS place,
         min(label) OVER (PARTITION BY dhash) <> max(label) OVER (PARTITION BY dhash) AS cross_class
  FROM hashed)"""


def _duplicate_summary(source: str, key: str) -> str:
    return f"""
SELECT count(DISTINCT {key}) AS unique_hashes,
       count(*) FILTER (place = 1 AND files > 1) AS duplicate_groups,
       count(*) FILTER (place > 1) AS duplicate_files,
       count(*) FILTER (place = 1 AND files > 1 AND cross_class) AS cross_class_groups,
       count(*) FILTER (place = 1 AND files > 1 AND NOT cross_class) AS within_class_groups
FROM {source}"""


SCORED = f"""
logits AS (
  SELECT vec_id AS image, label AS target, unnest(range(10)) AS index,
         unnest({ALL_LOGITS}) AS logit FROM embeddings),
shifted AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY image)) AS e FROM logits),
probabilities AS (
  SELECT *, e / sum(e) OVER (PARTITION BY image) AS p,
         row_number() OVER (PARTITION BY image ORDER BY logit DESC, index) AS rank FROM shifted),
predicted AS (SELECT image, target, CAST(index AS INTEGER) AS predicted, p AS confidence
              FROM probabilities WHERE rank = 1)"""

CELLS = CLASSES + "," + SCORED + """,
cells AS (
  SELECT t.index AS target, q.index AS predicted, count(image) AS images
  FROM classes t CROSS JOIN classes q
  LEFT JOIN predicted s ON s.target = t.index AND s.predicted = q.index GROUP BY ALL)"""

SCORES = """
scores AS (
  SELECT c.index, c.display_name,
         (SELECT count(*) FROM predicted WHERE target = c.index) AS support,
         (SELECT count(*) FROM predicted WHERE predicted = c.index) AS guesses,
         (SELECT count(*) FROM predicted WHERE predicted = c.index AND target = c.index) AS hits
  FROM classes c),
rates AS (
  SELECT *, CASE WHEN guesses > 0 THEN hits / guesses ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
         CASE WHEN guesses + support > 0 THEN 2 * hits / (guesses + support) ELSE 0 END AS f1 FROM scores)"""

LOSSES = f"""
weights AS (
  SELECT label AS index, CAST(printf('%.4f', sum(count(*)) OVER () / (count(*) OVER () * count(*))) AS DOUBLE) AS w
  FROM embeddings GROUP BY label),
logits AS (
  SELECT vec_id AS image, vec_id // 64 AS batch, label AS target, unnest(range(10)) AS index,
         unnest({ALL_LOGITS}) AS logit FROM embeddings),
terms AS (
  SELECT image, batch, target, index, logit,
         ln(sum(exp(logit)) OVER (PARTITION BY image)) - logit AS nll,
         row_number() OVER (PARTITION BY image ORDER BY logit DESC, index) AS rank FROM logits),
rows AS (
  SELECT image, batch, sum(CASE WHEN index = target THEN 0.9 * nll * w ELSE 0 END) + 0.1 / 10 * sum(nll * w) AS loss,
         sum(CASE WHEN index = target THEN w ELSE 0 END) AS weight,
         max(CASE WHEN rank = 1 AND index = target THEN 1 ELSE 0 END) AS hit
  FROM terms JOIN weights USING (index) GROUP BY image, batch),
losses AS (SELECT batch, sum(loss) / sum(weight) AS loss, count(*) AS images, CAST(sum(hit) AS BIGINT) AS correct
           FROM rows GROUP BY batch)"""

HISTORY = f"""
keyed AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'corn__common_rust' WHEN 'error' THEN 'tomato__late_blight'
    WHEN 'purchase' THEN 'lemon__curl_virus' WHEN 'signup' THEN 'pepper__unhealthy'
    WHEN 'view' THEN 'corn__healthy' END AS class_key FROM events),
history AS (
  SELECT event_id AS id, 'Leaf-' || user_id || '.jpg' AS filename, class_key,
         split_part(class_key, '__', 1) AS crop, split_part(class_key, '__', 2) AS disease,
         {TITLE.format("replace(class_key, '__', '_')")} AS display_name,
         value / 1000 AS confidence, value AS confidence_percent, value * 2 AS inference_ms, ts, props,
         {FOLD.format('class_key')} LIKE '%__healthy' AS healthy
  FROM keyed),
listed AS (
  SELECT id, filename, class_key, crop, disease, display_name, confidence, confidence_percent, inference_ms,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, '/history/' || id || '/image' AS image_url
  FROM history)"""

STATS = f"""WITH {HISTORY}
SELECT count(*) AS total_scans, count(*) FILTER (healthy) AS healthy_diagnoses, count(*) FILTER (NOT healthy) AS diseases_detected,
       CAST(printf('%.1f', coalesce(avg(confidence_percent), 0)) AS DOUBLE) AS average_confidence,
       (SELECT display_name FROM history WHERE NOT healthy GROUP BY class_key, display_name
        ORDER BY count(*) DESC, display_name LIMIT 1) AS most_common_disease
FROM history"""

EPOCHS = """
epochs AS (
  SELECT CAST(date_diff('day', DATE '2023-12-31', CAST(ts AS DATE)) AS INTEGER) AS epoch,
         round(avg(value), 4) AS f1 FROM events GROUP BY 1),
marked AS (
  SELECT *, coalesce(f1 > max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AS improved, row_number() OVER (ORDER BY epoch) AS pos FROM epochs),
counted AS (
  SELECT *, pos - max(CASE WHEN improved THEN pos END) OVER (ORDER BY epoch) AS stale FROM marked)"""

UPLOADS = """
kinds AS (
  SELECT doc_id, text, octet_length(encode(text)) AS n, substr(md5(text), 1, 1) AS digit,
         CASE lang WHEN 'es' THEN 'text/plain' WHEN 'fr' THEN 'image/png' ELSE 'image/jpeg' END AS content_type FROM documents),
sized AS (
  SELECT *, CAST(CASE WHEN digit < '5' THEN n + 55 WHEN digit < '9' THEN n + 57 WHEN digit < 'c' THEN 43
                      WHEN digit < 'e' THEN n WHEN digit = 'e' THEN n + 50 ELSE n + 57 END AS BIGINT) AS file_size FROM kinds),
uploads AS (
  SELECT *, CASE WHEN content_type NOT IN ('image/jpeg', 'image/png') OR file_size > 4096 THEN NULL
                 WHEN digit < '5' THEN 'JPEG' WHEN digit < '9' THEN 'PNG' WHEN digit < 'c' THEN 'GIF' END AS format FROM sized),
triaged AS (
  SELECT doc_id, text, content_type, file_size, format, CASE WHEN format IS NOT NULL THEN CAST(1 + doc_id % 4000 AS INTEGER) END AS width,
         CASE WHEN format IS NOT NULL THEN CAST(1 + doc_id % 3000 AS INTEGER) END AS height,
         CASE format WHEN 'GIF' THEN 'P' WHEN 'JPEG' THEN 'RGB' WHEN 'PNG' THEN 'RGB' END AS mode,
         CASE WHEN content_type NOT IN ('image/jpeg', 'image/png') THEN 'content_type_415'
              WHEN file_size = 0 THEN 'empty_400' WHEN file_size > 4096 THEN 'too_large_413'
              WHEN format IS NULL THEN 'not_an_image_400'
              WHEN format NOT IN ('JPEG', 'PNG') THEN 'image_format_415' END AS reject_reason
  FROM uploads)"""

CATALOG_COLUMNS = ("id AS class_id, index AS class_index, key AS class_key, display_name, crop, disease, "
                   "relative_directory")
MANIFEST_COLUMNS = ("split, class_id, class_index, class_key, display_name, crop, disease, family_id, "
                    "augmentation, relative_path")
SPLITS = "(VALUES ('train'), ('val'), ('test')) s(split)"

ORACLE: dict[str, str] = {
    "class_catalog": f"WITH {CLASSES} SELECT {CATALOG_COLUMNS} FROM classes",
    "slugify": f"""SELECT p_partkey, {SLUG.format("p_brand || ' / ' || p_type || ' / ' || p_name")} AS slug FROM part""",
    "label_text": f"WITH {CLASSES} SELECT id || ' ' || display_name AS line FROM classes",
    "label_fallback": f"""WITH {CLASSES}
SELECT s_suppkey AS file_id, s_nationkey + 2 AS class_id,
       coalesce(display_name, 'Unknown Class ' || (s_nationkey + 2)) AS display_name
FROM supplier LEFT JOIN classes ON id = s_nationkey + 2""",
    "catalog_violations": f"""WITH {CLASSES}
SELECT 'bad_id' AS rule, CAST(index AS BIGINT) AS class_id, key AS class_key FROM classes WHERE index < 1
UNION ALL SELECT 'duplicate_directory', index, key FROM classes
  WHERE crop IN (SELECT crop FROM classes GROUP BY crop HAVING count(*) > 1)
UNION ALL SELECT 'id_index_mismatch', index, key FROM classes
UNION ALL SELECT 'id_out_of_order', index, key FROM classes WHERE index <> (24 - index) + 1
UNION ALL SELECT 'index_out_of_order', index, key FROM classes WHERE index <> 24 - index
UNION ALL SELECT 'ids_not_contiguous', NULL, NULL FROM classes HAVING min(index) <> 1""",
    "class_create": f"""WITH {CLASSES} SELECT {CATALOG_COLUMNS} FROM classes
UNION ALL SELECT CAST(count(*) + 1 AS INTEGER), CAST(count(*) AS INTEGER), 'sweet_corn__leaf_rust_2nd', 'Sweet Corn Leaf Rust 2Nd', 'sweet_corn',
  'leaf_rust_2nd', 'sweet_corn/leaf_rust_2nd' FROM classes""",
    "class_rename": f"""WITH {MANIFEST}
SELECT split, class_id, class_index,
       CASE WHEN class_id = 3 THEN 'far_east__' || disease ELSE class_key END AS class_key,
       CASE WHEN class_id = 3 THEN 'Far East 2' ELSE display_name END AS display_name,
       CASE WHEN class_id = 3 THEN 'far_east' ELSE crop END AS crop, disease, family_id, augmentation,
       CASE WHEN class_id = 3 THEN regexp_replace(relative_path, '^[^/]+', 'far_east') ELSE relative_path END
         AS relative_path
FROM manifest""",
    "class_delete": f"""WITH {MANIFEST}
SELECT split, CASE WHEN class_id > 7 THEN class_id - 1 ELSE class_id END AS class_id,
       CASE WHEN class_id > 7 THEN class_index - 1 ELSE class_index END AS class_index,
       class_key, display_name, crop, disease, family_id, augmentation, relative_path
FROM manifest WHERE class_id <> 7""",
    "manifest_changes": f"""WITH {MANIFEST}
SELECT 'rename' AS operation, regexp_replace(relative_path, '^[^/]+', 'far_east') AS relative_path, 'changed' AS change,
       1::BIGINT AS old_rows, 1::BIGINT AS new_rows, 'class_key,display_name,crop,relative_path' AS fields
FROM manifest WHERE class_id = 3
UNION ALL SELECT 'delete', relative_path, CASE WHEN class_id = 7 THEN 'removed' ELSE 'changed' END,
       1, CASE WHEN class_id = 7 THEN 0 ELSE 1 END, CASE WHEN class_id = 7 THEN '' ELSE 'class_id,class_index' END
FROM manifest WHERE class_id >= 7""",
    "change_records": f"""WITH {MANIFEST}
SELECT 'rename' AS operation, max(key) FILTER (id = 3) AS old_keys, max('far_east__' || disease) FILTER (id = 3) AS new_keys,
       'Far East 2' AS new_names, string_agg(id || ':' || id, ',' ORDER BY id || ':' || id) AS id_remap,
       0::BIGINT AS manifest_paths_added, 0::BIGINT AS manifest_paths_removed,
       (SELECT count(*) FROM manifest WHERE class_id = 3) AS manifest_paths_changed,
       (SELECT count(*) FROM manifest WHERE class_id = 3) AS moved_files, false AS applied
FROM classes
UNION ALL
SELECT 'delete', max(key) FILTER (id = 7), '', '',
       string_agg(id || ':' || (CASE WHEN id > 7 THEN id - 1 ELSE id END), ','
         ORDER BY id || ':' || (CASE WHEN id > 7 THEN id - 1 ELSE id END)) FILTER (id <> 7),
       0, (SELECT count(*) FROM manifest WHERE class_id = 7), (SELECT count(*) FROM manifest WHERE class_id > 7),
       (SELECT count(*) FROM manifest WHERE class_id = 7), false
FROM classes""",
    "manifest_scan": f"WITH {MANIFEST} SELECT {MANIFEST_COLUMNS} FROM manifest",
    "manifest_class_counts": f"""WITH {MANIFEST}
SELECT CAST(id AS BIGINT) AS class_id, c.display_name, count(relative_path) AS manifest_images
FROM classes c LEFT JOIN manifest m ON m.class_id = c.id GROUP BY ALL""",
    "split_counts": f"""WITH {MANIFEST}
SELECT s.split, count(relative_path) AS images FROM {SPLITS} LEFT JOIN manifest m ON m.split = s.split GROUP BY ALL""",
    "class_split_matrix": f"""WITH {MANIFEST}
SELECT CAST(id AS BIGINT) AS class_id, key AS class_key, c.display_name, count(*) FILTER (split = 'train') AS train,
       count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test
FROM classes c LEFT JOIN manifest m ON m.class_id = c.id GROUP BY ALL""",
    "family_counts": f"""WITH {MANIFEST}
SELECT CAST(id AS BIGINT) AS class_id, key AS class_key, count(DISTINCT family_id) AS families
FROM classes c LEFT JOIN manifest m ON m.class_id = c.id GROUP BY ALL""",
    "family_leakage": f"""WITH {MANIFEST}
SELECT CAST(class_id AS BIGINT) AS class_id, family_id, count(*) AS images,
       concat_ws(',', CASE WHEN count(*) FILTER (split = 'train') > 0 THEN 'train' END,
                 CASE WHEN count(*) FILTER (split = 'val') > 0 THEN 'val' END,
                 CASE WHEN count(*) FILTER (split = 'test') > 0 THEN 'test' END) AS splits
FROM manifest GROUP BY class_id, family_id HAVING count(DISTINCT split) > 1""",
    "split_coverage": f"""WITH {MANIFEST},
wanted AS (SELECT id, key FROM classes UNION ALL SELECT 26, 'sweet_corn__rust')
SELECT 'empty_split' AS rule, NULL::VARCHAR AS class_key, split FROM {SPLITS}
WHERE split NOT IN (SELECT split FROM manifest)
UNION ALL SELECT 'class_without_split', c.key, s.split FROM wanted c CROSS JOIN {SPLITS}
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.class_id = c.id AND m.split = s.split)""",
    "manifest_rewrite": f"""WITH {MANIFEST}
SELECT relative_path, split, class_id, {SLUG.format('augmentation')} AS augmentation
FROM manifest WHERE augmentation <> '4-NOT SPECIFIED'""",
    "manifest_violations": f"WITH {FAULTY} SELECT stage, code_order, code, relative_path FROM violations",
    "first_manifest_violation": f"""WITH {FAULTY}
SELECT stage, code_order, code, relative_path FROM violations ORDER BY ALL LIMIT 1""",
    "unknown_classes": f"""WITH {FAULTY}
SELECT relative_path, CASE WHEN bad_number THEN 'n/a' ELSE CAST(class_id AS VARCHAR) END AS class_id
FROM faulty WHERE bad_number OR bad_class""",
    "missing_assets": """SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "dataset_summary_counts": f"""WITH {MANIFEST}
SELECT (SELECT count(*) FROM classes) AS class_count, count(*) AS image_count,
       count(DISTINCT (class_id, family_id)) AS family_count,
       (SELECT count(*) FROM (SELECT 1 FROM manifest GROUP BY class_id, family_id HAVING count(DISTINCT split) > 1))
         AS family_leakage_count,
       count(*) FILTER (split = 'train') AS train_images, count(*) FILTER (split = 'val') AS val_images,
       count(*) FILTER (split = 'test') AS test_images FROM manifest""",
    "dataset_violation_counts": f"""WITH {FAULTY},
numbered AS (SELECT * REPLACE (coalesce(class_id, -1) AS class_id) FROM faulty),
found AS (
  SELECT 1 AS stage, CASE WHEN code = 'bad_number' THEN 'unknown_class' ELSE code END AS code FROM violations
  UNION ALL SELECT 4, 'family_leakage' FROM numbered GROUP BY class_id, family_id
    HAVING count(DISTINCT split) FILTER (split <> 'holdout') > 1
  UNION ALL SELECT 3, 'empty_split' FROM {SPLITS} WHERE split NOT IN (SELECT split FROM faulty)
  UNION ALL SELECT 5, 'class_without_split' FROM classes c CROSS JOIN {SPLITS}
    WHERE NOT EXISTS (SELECT 1 FROM faulty f WHERE f.class_id = c.id AND f.split = s.split))
SELECT stage, code, count(*) AS violations FROM found GROUP BY ALL""",
    "class_distribution": f"WITH {DISTRIBUTION} SELECT * FROM distribution",
    "distribution_totals": f"""WITH {DISTRIBUTION}
SELECT CAST(sum(images) AS BIGINT) AS total, min(images) FILTER (images > 0) AS minimum, max(images) AS maximum,
       round(max(images) / min(images) FILTER (images > 0), 6) AS ratio FROM distribution""",
    "class_imbalance": f"""WITH {DISTRIBUTION},
filled AS (SELECT class_id, images, median(images) OVER () AS med FROM distribution WHERE images > 0)
SELECT round(max(med), 6) AS median, round(avg(images), 6) AS mean, max(images) AS max, min(images) AS min,
       round(max(images) / min(images), 6) AS max_to_min,
       coalesce(string_agg(CASE WHEN images < med * 0.25 THEN class_id END, ',' ORDER BY class_id), '') AS classes_below_25pct_median,
       coalesce(string_agg(CASE WHEN images < med * 0.5 THEN class_id END, ',' ORDER BY class_id), '') AS classes_below_50pct_median,
       coalesce(string_agg(CASE WHEN images > med * 2 THEN class_id END, ',' ORDER BY class_id), '') AS classes_above_2x_median
FROM filled""",
    "class_completeness": f"""WITH {DISTRIBUTION}
SELECT count(*) FILTER (expected) AS expected_classes, count(*) FILTER (expected AND images > 0) AS classes_with_images,
       coalesce(string_agg(CASE WHEN expected AND images = 0 THEN class_id END, ',' ORDER BY class_id), '') AS empty_classes,
       coalesce(string_agg(CASE WHEN NOT expected THEN class_id END, ',' ORDER BY class_id), '') AS unexpected_class_ids
FROM distribution""",
    "balanced_class_weights": f"""WITH {MANIFEST},
counts AS (SELECT class_id, count(*) AS images FROM manifest GROUP BY class_id)
SELECT class_id, images,
       CAST(printf('%.4f', sum(images) OVER () / (count(*) OVER () * images)) AS DOUBLE) AS weight FROM counts""",
    "effective_class_weights": f"""WITH {MANIFEST},
counts AS (SELECT class_index, count(*) AS images FROM manifest WHERE split = 'train' GROUP BY class_index),
raw AS (SELECT *, (1 - 0.9999::DOUBLE) / (1 - pow(0.9999::DOUBLE, images)) AS w FROM counts)
SELECT class_index, images, round(w / sum(w) OVER () * count(*) OVER (), 6) AS weight FROM raw""",
    "quality_flags": f"""WITH {ASSETS}
SELECT relative_path, valid, pixels, round(aspect_ratio, 6) AS aspect_ratio, small, below_ideal_resolution,
       severely_undersized, extreme_aspect, tiny_file, large_file, grayscale, has_alpha, channels FROM assets""",
    "mode_channels": f"""WITH {ASSETS}
SELECT mode, channels, grayscale, has_alpha, count(*) AS images FROM assets WHERE valid GROUP BY ALL""",
    "class_quality_profile": f"""WITH {ASSETS}
SELECT CAST(class_id AS BIGINT) AS class_id, count(*) AS total, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS corrupt,
  {FLAG_COUNTS}, {_spread('width', True)}, {_spread('height', True)}, {_spread('pixels', False)},
  {_spread('file_size', False)} FROM assets GROUP BY class_id""",
    "quality_summary": f"""WITH {ASSETS}
SELECT count(*) AS total_records, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS corrupt, {FLAG_COUNTS},
  CAST(min(width) AS BIGINT) AS min_width, CAST(min(height) AS BIGINT) AS min_height, min(pixels) AS min_pixels,
  round(min(aspect_ratio), 6) AS min_aspect_ratio, round(max(aspect_ratio), 6) AS max_aspect_ratio,
  CAST(sum(file_size) FILTER (valid) AS BIGINT) AS total_bytes, round(avg(file_size) FILTER (valid), 6) AS mean_bytes,
  max(file_size) FILTER (valid) AS maximum_bytes, round(median(width), 6) AS median_width,
  round(median(height), 6) AS median_height, round(median(pixels), 6) AS median_pixels,
  round(median(aspect_ratio), 6) AS median_aspect_ratio, round(median(file_size) FILTER (valid), 6) AS median_bytes
FROM assets""",
    "format_histogram": f"""WITH {ASSETS}
SELECT class_id, format, count(*) AS images FROM assets WHERE valid GROUP BY ALL""",
    "defect_examples": f"""WITH {ASSETS},
flagged AS (
  SELECT class_id, relative_path, 'corrupt' AS defect FROM assets WHERE NOT valid
  UNION ALL SELECT class_id, relative_path, 'small' FROM assets WHERE valid AND small
  UNION ALL SELECT class_id, relative_path, 'severely_undersized' FROM assets WHERE valid AND severely_undersized
  UNION ALL SELECT class_id, relative_path, 'extreme_aspect' FROM assets WHERE valid AND extreme_aspect
  UNION ALL SELECT class_id, relative_path, 'tiny_file' FROM assets WHERE valid AND tiny_file)
SELECT class_id, relative_path, defect,
       CAST(row_number() OVER (PARTITION BY defect ORDER BY class_id, relative_path) AS INTEGER) AS example
FROM flagged QUALIFY example <= 15""",
    "report_formatting": """
WITH n AS (SELECT p_partkey, p_size AS c, CAST(round(p_retailprice) AS INTEGER) AS t,
                  pow(p_size, 7) * p_retailprice AS b FROM part)
SELECT p_partkey, printf('%.2f', c / t * 100) || '%' AS percent,
       CASE WHEN c - 25 <= 0 THEN 'N/A' ELSE printf('%.2f', t / (c - 25)) || ':1' END AS ratio,
       CASE WHEN b < 1024 THEN printf('%.2f', b) || ' B' WHEN b < 1048576 THEN printf('%.2f', b / 1024) || ' KB'
            WHEN b < 1073741824 THEN printf('%.2f', b / 1048576) || ' MB'
            WHEN b < 1099511627776 THEN printf('%.2f', b / 1073741824) || ' GB'
            ELSE printf('%.2f', b / 1099511627776) || ' TB' END AS size
FROM n""",
    "readiness_report": f"""WITH {ASSETS},
q AS (SELECT greatest(1, count(*) FILTER (valid)) AS n, count(*) FILTER (valid AND small) AS small,
             count(*) FILTER (valid AND below_ideal_resolution) AS below, count(*) FILTER (valid AND severely_undersized) AS severe
      FROM assets),
d AS (SELECT class_id, count(*) AS images FROM assets GROUP BY class_id)
SELECT n - below AS at_or_above_ideal, printf('%.2f', (n - below) / n * 100) || '%' AS at_or_above_ideal_pct,
       small AS below_target, printf('%.2f', small / n * 100) || '%' AS below_target_pct,
       severe AS severely_undersized, printf('%.2f', severe / n * 100) || '%' AS severely_undersized_pct,
       (SELECT printf('%.2f', max(images) / min(images)) || ':1' FROM d) AS imbalance_ratio,
       (SELECT coalesce(string_agg(class_id, ',' ORDER BY class_id), '') FROM d WHERE images < 150) AS classes_below_minimum,
       (SELECT coalesce(string_agg(class_id, ',' ORDER BY class_id), '') FROM d WHERE images < 400) AS classes_below_ideal
FROM q""",
    "health_score": f"""WITH {ASSETS},
e AS (SELECT count(*) AS n, count(DISTINCT class_id) AS k FROM assets WHERE valid GROUP BY sha256),
v AS (SELECT count(*) AS n, count(DISTINCT class_id) AS k FROM assets WHERE valid GROUP BY dhash),
d AS (SELECT count(*) AS n FROM assets GROUP BY class_id),
f AS (SELECT count(*) AS t, count(*) FILTER (NOT valid) AS bad, count(*) FILTER (valid AND small) / count(*) AS small,
             count(*) FILTER (valid AND severely_undersized) / count(*) AS severe,
             count(*) FILTER (valid AND extreme_aspect) / count(*) AS aspect,
             (SELECT sum(n - 1) FROM e) AS dup, (SELECT count(*) FROM e WHERE n > 1 AND k > 1) AS ecross,
             (SELECT count(*) FROM v WHERE n > 1 AND k > 1) AS vcross, (SELECT max(n) / min(n) FROM d) AS ratio
      FROM assets),
p AS (SELECT CAST(least(15, ceil(bad / t * 100)) AS INTEGER) AS p1, CAST(least(15, ceil(dup / t * 50)) AS INTEGER) AS p2,
             CAST(least(15, 3 * ecross) AS INTEGER) AS p3, CAST(least(15, 2 * vcross) AS INTEGER) AS p4,
             CASE WHEN small > 0.1 THEN 8 WHEN small > 0.03 THEN 4 ELSE 0 END AS p5,
             CASE WHEN severe > 0.02 THEN 5 ELSE 0 END AS p6, CASE WHEN aspect > 0.1 THEN 5 ELSE 0 END AS p7,
             CASE WHEN ratio > 20 THEN 10 WHEN ratio > 10 THEN 6 WHEN ratio > 5 THEN 3 ELSE 0 END AS p8 FROM f),
s AS (SELECT *, greatest(0, 100 - p1 - p2 - p3 - p4 - p5 - p6 - p7 - p8) AS score FROM p)
SELECT CAST(score AS INTEGER) AS score,
       CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 80 THEN 'GOOD' WHEN score >= 70 THEN 'FAIR'
            WHEN score >= 50 THEN 'NEEDS IMPROVEMENT' ELSE 'POOR' END AS status,
       concat_ws('; ', CASE WHEN p1 > 0 THEN '-' || p1 || ' corrupt-image penalty' END,
         CASE WHEN p2 > 0 THEN '-' || p2 || ' exact-duplicate penalty' END,
         CASE WHEN p3 > 0 THEN '-' || p3 || ' exact cross-class-duplicate penalty' END,
         CASE WHEN p4 > 0 THEN '-' || p4 || ' visual cross-class-duplicate penalty' END,
         CASE p5 WHEN 8 THEN '-8 low-resolution penalty (>10% below 300px)'
                 WHEN 4 THEN '-4 low-resolution penalty (>3% below 300px)' END,
         CASE WHEN p6 > 0 THEN '-5 severely-undersized penalty (>2% below 150px)' END,
         CASE WHEN p7 > 0 THEN '-5 aspect-ratio penalty' END,
         CASE WHEN p8 = 10 THEN '-10 severe class-imbalance penalty'
              WHEN p8 > 0 THEN '-' || p8 || ' class-imbalance penalty' END) AS notes
FROM s""",
    "all_assets": """
SELECT 'documents' AS kind, doc_id AS item, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT 'pages', page_id, octet_length(encode(html)) FROM pages
UNION ALL SELECT 'benchmark', item_id, octet_length(encode(text)) FROM benchmark""",
    "content_digest": f"WITH {FILES} SELECT doc_id, sha256, file_size FROM files",
    "exact_duplicates": f"""WITH {FILES}
SELECT sha256, files, cross_class, class_id AS keep_class_id, relative_path AS keep_relative_path
FROM ranked WHERE place = 1 AND files > 1""",
    "exact_duplicate_summary": f"WITH {FILES} {_duplicate_summary('ranked', 'sha256')}",
    "exact_duplicate_examples": f"""WITH {FILES},
groups AS (SELECT sha256, CAST(row_number() OVER (ORDER BY class_id, relative_path) AS INTEGER) AS example
           FROM ranked WHERE place = 1 AND files > 1 AND cross_class)
SELECT example, sha256, class_id, relative_path FROM ranked JOIN groups USING (sha256) WHERE example <= 15""",
    "dedup_plan": f"""WITH {FILES}
SELECT sha256, class_id, relative_path, files, CASE WHEN place = 1 THEN 'KEEP' ELSE 'DUPLICATE' END AS status
FROM ranked WHERE files > 1""",
    "removal_plan": f"WITH {REMOVALS} SELECT * FROM removals",
    "removal_counts": f"""WITH {REMOVALS} SELECT count(*) FILTER (stage = 'exact') AS exact_removed,
       count(*) FILTER (stage = 'visual') AS visual_removed FROM removals""",
    "duplicate_example_classes": f"""WITH {FILES},
groups AS (SELECT sha256, CAST(row_number() OVER (ORDER BY class_id, relative_path) AS INTEGER) AS example
           FROM ranked WHERE place = 1 AND files > 1 AND cross_class)
SELECT example, sha256, class_id, count(*) AS files, min(relative_path) AS first_file
FROM ranked r JOIN groups USING (sha256) WHERE example <= 15 GROUP BY ALL""",
    "dedup_keep_first": f"""WITH {FILES}
SELECT doc_id, class_id, relative_path, sha256, file_size FROM ranked WHERE place = 1""",
    "upload_triage": f"WITH {UPLOADS} SELECT doc_id, content_type, file_size, format, width, height, mode, reject_reason FROM triaged",
    "difference_hash": f"""WITH {_hash(8, 8)}
SELECT vec_id AS image, dhash, printf('%016x', dhash) AS hash_text FROM hashed""",
    "visual_duplicates": f"""WITH {_hash(5, 2, ALL_LOGITS)}
SELECT dhash, files, cross_class, label AS keep_class_id, vec_id AS keep_relative_path
FROM spread WHERE place = 1 AND files > 1""",
    "visual_duplicate_summary": f"WITH {_hash(5, 2, ALL_LOGITS)} {_duplicate_summary('spread', 'dhash')}",
    "near_duplicates": f"""WITH {_hash(8, 8)}
SELECT a.label AS class_id, a.vec_id AS file_a, b.vec_id AS file_b,
       CAST(bit_count(xor(a.dhash, b.dhash)) AS INTEGER) AS hamming_distance
FROM spread a JOIN spread b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE a.files = 1 AND b.files = 1 AND bit_count(xor(a.dhash, b.dhash)) <= 14""",
    "near_duplicate_counts": f"""WITH {_hash(8, 8)},
pairs AS (SELECT a.label AS class_id, a.vec_id AS file_a, b.vec_id AS file_b,
       CAST(bit_count(xor(a.dhash, b.dhash)) AS INTEGER) AS hamming_distance
FROM spread a JOIN spread b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE a.files = 1 AND b.files = 1 AND bit_count(xor(a.dhash, b.dhash)) <= 14),
counted AS (SELECT *, count(*) OVER (PARTITION BY class_id) AS pairs,
       row_number() OVER (PARTITION BY class_id ORDER BY file_a, file_b) AS place FROM pairs)
SELECT class_id, pairs, file_a, file_b, hamming_distance FROM counted WHERE place = 1""",
    "manifest_lines": f"""WITH {MANIFEST},
keyed AS (SELECT *, CAST(regexp_extract(relative_path, '([0-9]+)\\.jpg$', 1) AS BIGINT) AS k FROM manifest)
SELECT relative_path, CASE WHEN k % 5 = 0 THEN augmentation || chr(10) || 'said "so", twice' || chr(10) ELSE augmentation END AS augmentation,
       CAST(2 + coalesce(sum(CASE WHEN k % 5 = 0 THEN 3 ELSE 1 END) OVER (
           PARTITION BY k // 4096 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM keyed""",
    "near_duplicate_classes": f"""WITH RECURSIVE {_hash(8, 8)},
links AS (SELECT a.label AS class_id, a.vec_id AS file, b.vec_id AS other
FROM spread a JOIN spread b ON a.label = b.label AND a.vec_id <> b.vec_id
WHERE a.files = 1 AND b.files = 1 AND bit_count(xor(a.dhash, b.dhash)) <= 14),
reach(file, far) AS (SELECT file, file FROM links UNION SELECT r.file, l.other FROM reach r JOIN links l ON l.file = r.far),
near AS (SELECT file, min(far) AS near_class FROM reach GROUP BY file)
SELECT class_id, file AS relative_path, near_class, count(*) AS links FROM links JOIN near USING (file) GROUP BY ALL""",
    "softmax_topk": f"""WITH {CLASSES}, {SCORED}
SELECT image, CAST(rank AS INTEGER) AS rank, id AS class_id, CAST(p.index AS INTEGER) AS class_index,
       key AS class_key, display_name, crop, disease, round(p, 6) AS confidence,
       round(p * 100, 4) AS confidence_percent
FROM probabilities p JOIN classes c ON c.index = p.index WHERE rank <= 5""",
    "argmax_prediction": f"WITH {SCORED} SELECT image, predicted, round(confidence, 6) AS confidence FROM predicted",
    "low_confidence": f"""WITH {SCORED}
SELECT image, round(confidence * 100, 4) AS confidence_percent, confidence < 0.14 AS uncertain FROM predicted""",
    "normalize_features": """
WITH cells AS (SELECT vec_id AS image, unnest(range(64)) AS position, unnest(embedding) AS v FROM embeddings)
SELECT image, CAST(position AS INTEGER) AS position,
       round((round((CAST(v AS DOUBLE) + 1) * 127.5) / 255
         - CASE position % 3 WHEN 0 THEN 0.485 WHEN 1 THEN 0.456 ELSE 0.406 END)
         / CASE position % 3 WHEN 0 THEN 0.229 WHEN 1 THEN 0.224 ELSE 0.225 END, 6) AS value
FROM cells""",
    "batch_scoring": """
WITH cells AS (SELECT vec_id AS image, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
logits AS (SELECT image, k, sum(v * ((k * 7 + j * 3) % 11 - 5) / 10) AS logit
           FROM cells CROSS JOIN range(10) r(k) GROUP BY image, k),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY image)) AS e FROM logits)
SELECT image, CAST(arg_max(k, logit) AS INTEGER) AS predicted, round(max(e) / sum(e), 6) AS confidence
FROM e GROUP BY image""",
    "smoothed_cross_entropy": f"""WITH {LOSSES}
SELECT batch, round(loss, 6) AS loss, images, correct FROM losses""",
    "weighted_mean_loss": f"""WITH {LOSSES}
SELECT round(sum(loss * images) / sum(images), 6) AS loss, round(sum(correct) / sum(images), 6) AS accuracy,
       CAST(sum(images) AS BIGINT) AS images FROM losses""",
    "confusion_matrix": f"WITH {CELLS} SELECT target, predicted, images FROM cells",
    "confusion_normalized": f"""WITH {CELLS}
SELECT target, predicted, round(coalesce(images / nullif(sum(images) OVER (PARTITION BY target), 0), 0), 6) AS share
FROM cells""",
    "classification_report": f"""WITH {CLASSES}, {SCORED}, {SCORES}
SELECT display_name AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM rates
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), sum(support)::BIGINT FROM rates
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM rates
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM rates""",
    "eval_metrics": f"""WITH {CLASSES}, {SCORED}, {SCORES}
SELECT round(sum(hits) / sum(support), 6) AS accuracy,
       round(avg(f1) FILTER (support + guesses > 0), 6) AS macro_f1,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
       round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy, CAST(sum(support) AS BIGINT) AS images
FROM rates""",
    "prediction_detail": f"""WITH {CLASSES}, {SCORED}
SELECT image, a.id AS actual_class_id, a.display_name AS actual_name, q.id AS predicted_class_id,
       q.display_name AS predicted_name, CAST(printf('%.7f', confidence) AS DOUBLE) AS confidence,
       target = predicted AS correct
FROM predicted JOIN classes a ON a.index = target JOIN classes q ON q.index = predicted""",
    "history_list": f"WITH {HISTORY} SELECT * FROM listed ORDER BY created_at DESC, id DESC LIMIT 100",
    "history_search": f"""WITH {HISTORY}
SELECT * FROM listed
WHERE {FOLD.format('crop')} LIKE '%late_bl%' OR {FOLD.format('disease')} LIKE '%late_bl%'
   OR {FOLD.format('display_name')} LIKE '%late_bl%' OR {FOLD.format('filename')} LIKE '%late_bl%'
ORDER BY created_at DESC, id DESC LIMIT 50""",
    "history_category": f"WITH {HISTORY} SELECT id, class_key, filename FROM history WHERE NOT healthy",
    "history_lookup": f"""WITH {HISTORY}
SELECT hex(encode(props)) AS image, 'image/jpeg' AS content_type FROM history WHERE id = 123""",
    "history_stats": STATS,
    "most_common_disease": f"""WITH {HISTORY}
SELECT class_key, display_name, count(*) AS occurrence_count FROM history WHERE NOT healthy
GROUP BY ALL ORDER BY occurrence_count DESC, display_name LIMIT 1""",
    "linear_head": """
SELECT label AS target, count(*) AS images,
       CAST(printf('%.4f', sum(count(*)) OVER () / (count(*) OVER () * count(*))) AS DOUBLE) AS weight,
       true AS beats_largest_class
FROM embeddings GROUP BY label""",
    "guidance_lookup": f"""WITH {HISTORY},
guidance(class_key, display_name, classification, agent, management_label, n_cause_factors, n_cure_points,
         n_prevention_points) AS (VALUES
  ('corn__common_rust', 'Corn Common Rust', 'Fungal disease', 'Puccinia sorghi', 'Treatment Steps', 3, 3, 4),
  ('tomato__late_blight', 'Tomato Late Blight', 'Oomycete disease', 'Phytophthora infestans', 'Treatment Steps', 3, 3, 4),
  ('lemon__curl_virus', 'Lemon Curl Virus', 'Possible viral disease or pest damage', 'Requires local confirmation',
   'Confirmation & Control Steps', 3, 3, 4),
  ('corn__healthy', 'Corn Healthy', 'Healthy', 'No disease agent detected', 'Care Steps', 1, 2, 3))
SELECT h.id, h.class_key, g.display_name, g.classification, g.agent, g.management_label,
       n_cause_factors::BIGINT AS n_cause_factors, n_cure_points::BIGINT AS n_cure_points,
       n_prevention_points::BIGINT AS n_prevention_points
FROM history h JOIN guidance g USING (class_key)""",
    "best_epoch": f"""WITH {EPOCHS},
ran AS (SELECT * FROM counted WHERE epoch <= coalesce((SELECT min(epoch) FROM counted WHERE stale >= 6), 1000000))
SELECT max(epoch) FILTER (improved) AS best_epoch, arg_max(f1, epoch) FILTER (improved) AS best_score,
       count(*) AS epochs_completed, max(stale) >= 6 AS stopped_early FROM ran""",
    "early_stop": f"""WITH {EPOCHS}
SELECT epoch, f1 AS val_macro_f1, improved, stale FROM counted
WHERE epoch <= coalesce((SELECT min(epoch) FROM counted WHERE stale >= 4), 1000000)""",
    "latest_artifact": """
WITH a AS (SELECT CASE role WHEN 'assistant' THEN 'model_Best' WHEN 'user' THEN 'model_final' ELSE 'model' END
             || '_' || lpad(CAST(conv_id AS VARCHAR), 12, '0') AS path, turn AS mtime,
             CASE role WHEN 'assistant' THEN 2 WHEN 'user' THEN 1 ELSE 0 END AS kind FROM conversations)
SELECT path, mtime FROM a ORDER BY kind DESC, mtime DESC, path DESC LIMIT 1""",
    "epoch_batches": """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|3|' || doc_id)) AS place FROM documents)
SELECT doc_id, place, CAST((place - 1) // 32 AS BIGINT) AS batch FROM r""",
    "exact_percentiles": "SELECT l_returnflag, " + ", ".join(
        f"round(quantile_cont({column}, {p}), 6) AS {metric}_{name}"
        for metric, column in (("price", "l_extendedprice"), ("quantity", "l_quantity"))
        for name, p in (("p10", 0.1), ("median", 0.5), ("p90", 0.9))
    ) + " FROM lineitem GROUP BY l_returnflag",
    "stream_triage": f"""WITH {UPLOADS},
features AS (SELECT doc_id, unnest(range(64)) AS j, unnest(list_transform(range(64), lambda i:
               instr('0123456789abcdef', substr(sha256(text), i::INTEGER + 1, 1)) + (i + 1) * (i + 1) / 7919::DOUBLE)) AS v FROM triaged WHERE reject_reason IS NULL),
logits AS (SELECT doc_id, k, sum(v * ((k * 7 + j * 3) % 11 - 5) / 10) AS logit FROM features CROSS JOIN range(10) r(k) GROUP BY ALL),
e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY doc_id)) AS e FROM logits),
scored AS (SELECT doc_id, 'class_' || arg_max(k, logit) AS class_key, round(max(e) / sum(e), 6) AS confidence FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(reject_reason, 'accepted') AS outcome, class_key, confidence,
       CASE WHEN reject_reason IS NULL THEN file_size END AS image_bytes FROM triaged LEFT JOIN scored USING (doc_id)""",
    "stream_history": f"""WITH {HISTORY}
SELECT class_key, CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_date, count(*) AS scans, count(*) AS ids,
       round(sum(confidence_percent), 4) AS percent_sum FROM history GROUP BY ALL""",
    "stream_stats": STATS,
}

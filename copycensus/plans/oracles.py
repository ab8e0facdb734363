"""The same results in ANSI-style SQL over the plain tables, for the side-by-side check.

These statements restate each query from its definition (row numbers over whole
classes, joins that form every pair) rather than from the Spark plan.
"""

from __future__ import annotations

from copycensus.functions.signals import TEXT_SYMBOLS, cosine_rows
from copycensus.functions.stats import t_critical
from copycensus.operators.agreement import JUDGEMENTS
from copycensus.operators.contrasts import TABULATED_T
from copycensus.plans.studies import (
    CONTRASTS, LABELS, REMOVAL_SEED, REPRESENTATIVE_SEED, RESPLIT_SEED, SEEDS, SELECT_SEED, SPLIT_SEED,
)

SIX = ["file_sha256", "rgb_sha256", "ahash", "dhash", "phash", "hash_consensus"]
THREE = ["file_sha256", "rgb_sha256", "input_sha256"]
PARTS = ["fitting", "development", "evaluation"]
METRICS = ["accuracy", "macro_f1", "macro_recall"]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def real(expression: str, name: str) -> str:
    # The sum makes a zero that came from below a plain one.
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"


def rank(seed: int | str, ident: str = "sample_id", purpose: str = "") -> str:
    middle = f"{q(purpose)} || chr(0) || " if purpose else ""
    return f"sha256('{seed}' || chr(0) || {middle}{ident})"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p for p in parts if p) + "\n"


SOURCE_SPLIT = "CASE WHEN substr(sha256('source' || chr(0) || sample_id), 1, 1) < 'a' THEN 'train' ELSE 'val' END"


def hex64(bits: str) -> str:
    nibble = f"CAST(8*{bits}[4*i+1] + 4*{bits}[4*i+2] + 2*{bits}[4*i+3] + {bits}[4*i+4] AS INTEGER)"
    return f"array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', {nibble} + 1, 1)), '')"


MATRIX = "[" + ", ".join("[" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in row) + "]" for row in cosine_rows(8, 8)) + "]"


def signature_ctes(source: str, carry: str) -> str:
    """CTE ``sig`` with ahash, dhash, phash and hash_consensus from ``source.signal``."""
    return f"""g1 AS (SELECT {carry}, signal, list_sum(signal) / 64 AS mean,
  list_transform({MATRIX}, lambda w: list_transform(range(0, 8), lambda r: list_dot_product(w, signal[8*r+1:8*r+8]))) AS across
  FROM {source}),
g2 AS (SELECT *, flatten(list_transform({MATRIX}, lambda w: list_transform(across, lambda a: round(list_dot_product(w, a), 6)))) AS coef FROM g1),
g3 AS (SELECT *, list_sort(coef) AS ordered FROM g2),
g4 AS (SELECT *, list_transform(signal, lambda x: CASE WHEN x > mean THEN 1 ELSE 0 END) AS abits,
  list_transform(range(0, 64), lambda k: CASE WHEN (k % 8 + 1) * signal[k + 1] + (7 - k % 8) * signal[k - k % 8 + least(k % 8 + 1, 7) + 1]
    > (k % 8) * signal[k - k % 8 + greatest(k % 8 - 1, 0) + 1] + (8 - k % 8) * signal[k + 1] THEN 1 ELSE 0 END) AS dbits,
  list_transform(coef, lambda x: CASE WHEN x > (ordered[32] + ordered[33]) / 2 THEN 1 ELSE 0 END) AS pbits FROM g3),
g5 AS (SELECT {carry}, {hex64('abits')} AS ahash, {hex64('dbits')} AS dhash, {hex64('pbits')} AS phash FROM g4),
sig AS (SELECT *, ahash || ':' || dhash || ':' || phash AS hash_consensus FROM g5)"""


DOC0 = r"""d0 AS (SELECT *, CAST(doc_id AS VARCHAR) AS sample_id,
  lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS c FROM documents)"""


def light(label: str = "lang") -> str:
    """CTE ``docs`` with digests only."""
    return DOC0 + f""",
docs AS (SELECT sample_id, {label} AS class_label, {SOURCE_SPLIT} AS original_split, sha256(text) AS file_sha256,
  sha256(c) AS rgb_sha256, sha256(regexp_replace(c, '[^a-z]+', '', 'g')) AS input_sha256, n_chars FROM d0)"""


def full(label: str = "lang") -> str:
    """CTE ``docs`` with digests and signatures."""
    counts = ", ".join(
        f"CAST((strlen(c) - strlen(replace(c, {q(s)}, ''))) // {len(s.encode())} AS DOUBLE)" for s in TEXT_SYMBOLS
    )
    carry = "sample_id, class_label, original_split, file_sha256, rgb_sha256, input_sha256, n_chars"
    return light(label).replace("docs AS", "dl AS") + f""",
d1 AS (SELECT dl.*, [{counts}] AS signal FROM dl JOIN d0 USING (sample_id)),
{signature_ctes('d1', carry)},
docs AS (SELECT * FROM sig)"""


EVT = f"""evt0 AS (SELECT *, CAST(event_id AS VARCHAR) AS sample_id FROM events),
evt AS (SELECT sample_id, event_type AS class_label, {SOURCE_SPLIT} AS original_split,
  sha256(user_id || '|' || event_type || '|' || props) AS user_type_props, sha256(user_id || '|' || event_type) AS user_type,
  sha256(props) AS props FROM evt0)"""

LINE = f"""li0 AS (SELECT *, CAST(l_quantity AS INTEGER) AS qty FROM lineitem),
li1 AS (SELECT *, sha256(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, qty,
  CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT),
  l_returnflag, l_linestatus, CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS sample_id FROM li0),
li AS (SELECT sample_id, l_returnflag AS class_label, {SOURCE_SPLIT} AS original_split,
  l_partkey || '|' || l_suppkey AS part_supplier, l_partkey || '|' || qty AS part_quantity,
  CAST(l_partkey AS VARCHAR) AS part FROM li1)"""


def melt(table: str, methods: list[str], name: str = "m", extra: str = "") -> str:
    pieces = [f"SELECT {extra}'{m}' AS method, {m} AS value, * FROM {table}" for m in methods]
    return f"{name} AS (" + " UNION ALL BY NAME ".join(pieces) + ")"


def summary_select(by: str = "method") -> str:
    return f"""SELECT {by}, {big('sum(n)', 'images')}, {big('count(*)', 'distinct_groups')},
  {big('sum(n) - count(*)', 'excess_copies')}, {real('(sum(n) - count(*)) / sum(n)', 'redundancy_fraction')},
  {big('count(*) FILTER (n > 1)', 'nonsingleton_groups')}, {big('coalesce(sum(n) FILTER (n > 1), 0)', 'images_in_nonsingleton_groups')},
  {big('count(*) FILTER (k > 1)', 'mixed_label_groups')}, {big('coalesce(sum(n) FILTER (k > 1), 0)', 'images_in_mixed_label_groups')}
  FROM (SELECT {by}, value, count(*) AS n, count(DISTINCT class_label) AS k FROM m GROUP BY {by}, value) GROUP BY {by}"""


OVERLAP = f"""SELECT e.method, {big("any_value(t.n)", 'train_images')}, {big('count(*)', 'evaluation_images')},
  {big('count(*) FILTER (any_train)', 'evaluation_matched')}, {real('count(*) FILTER (any_train) / count(*)', 'evaluation_overlap_fraction')},
  {big('count(*) FILTER (same)', 'same_label_matched')}, {big('count(*) FILTER (other)', 'other_label_matched')}
  FROM (SELECT a.method, EXISTS (SELECT 1 FROM m b WHERE b.method = a.method AND b.value = a.value AND b.original_split = 'train') AS any_train,
    EXISTS (SELECT 1 FROM m b WHERE b.method = a.method AND b.value = a.value AND b.original_split = 'train' AND b.class_label = a.class_label) AS same,
    EXISTS (SELECT 1 FROM m b WHERE b.method = a.method AND b.value = a.value AND b.original_split = 'train' AND b.class_label <> a.class_label) AS other
    FROM m a WHERE a.original_split = 'val') e
  JOIN (SELECT method, count(*) AS n FROM m WHERE original_split = 'train' GROUP BY method) t ON t.method = e.method GROUP BY e.method"""


def grouped(table: str, value: str, rule: str, name: str = "ann") -> str:
    """CTE with each row's duplicate group attributes."""
    return f"""{name}0 AS (SELECT *, {value} AS value, row_number() OVER (PARTITION BY {value} ORDER BY {rank(REPRESENTATIVE_SEED)}, sample_id) AS rn,
  count(*) OVER (PARTITION BY {value}) AS size FROM {table}),
{name}k AS (SELECT value, count(DISTINCT class_label) AS classes, max(CASE WHEN rn = 1 THEN sample_id END) AS rep FROM {name}0 GROUP BY value),
{name} AS (SELECT a.*, sha256('{rule}' || chr(0) || a.value) AS gid, k.classes, k.rep FROM {name}0 a JOIN {name}k k USING (value))"""


DEDUP_SELECT = f"""SELECT sample_id, class_label, gid AS duplicate_group_id, {big('size', 'duplicate_group_size')},
  rep AS representative_sample_id, {big('classes', 'group_class_count')} FROM ann"""


def split(table: str, name: str = "man", clamped: bool = False, seed: int = SPLIT_SEED, keep: str = "*") -> str:
    nf, nd = "CAST(round_even(n * 0.7, 0) AS BIGINT)", "CAST(round_even(n * 0.2, 0) AS BIGINT)"
    if clamped:
        nf = f"greatest(1, least({nf}, n - 2))"
        nd = f"greatest(1, least({nd}, n - {nf} - 1))"
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {rank(seed)}, sample_id) AS pos,
  count(*) OVER (PARTITION BY class_label) AS n FROM {table}),
{name} AS (SELECT * EXCLUDE (pos, n), CASE WHEN pos <= {nf} THEN 'fitting' WHEN pos <= {nf} + {nd} THEN 'development' ELSE 'evaluation' END AS "partition" FROM {name}0)"""


def paired(key: str = "input_sha256", held: list[str] | None = None, source: str = "man") -> str:
    inside = ", ".join(q(h) for h in (held or ["development", "evaluation"]))
    return f"""pc0 AS (SELECT *, "partition" = 'fitting' AND {key} IN (SELECT {key} FROM {source} WHERE "partition" IN ({inside})) AS exposed,
  "partition" = 'fitting' AND {key} IN (SELECT {key} FROM {source} WHERE "partition" = 'development') AS md,
  "partition" = 'fitting' AND {key} IN (SELECT {key} FROM {source} WHERE "partition" = 'evaluation') AS me,
  row_number() OVER (PARTITION BY class_label, "partition" = 'fitting' ORDER BY {rank(REMOVAL_SEED)}, sample_id) AS pos FROM {source}),
need AS (SELECT class_label, count(*) FILTER (exposed) AS need FROM pc0 GROUP BY class_label),
pc AS (SELECT pc0.*, NOT exposed AS in_clean, "partition" <> 'fitting' OR pos > need AS in_control FROM pc0 JOIN need USING (class_label))"""


PAIRED = with_(light(), split("docs"), paired())
PAIRED_RGB = with_(light(), split("docs"), paired("rgb_sha256", ["evaluation"]))
PAIRED_SELECT = f"""SELECT sample_id, class_label, "partition", {big('exposed', 'exposed')}, {big('in_clean', 'in_clean')}, {big('in_control', 'in_control')} FROM pc"""
NAMES = {"full": "true", "clean_exact": "in_clean", "random_control": "in_control"}


def same_class(flag: str, key: str = "input_sha256") -> str:
    return f"EXISTS (SELECT 1 FROM pc f WHERE f.\"partition\" = 'fitting' AND f.{flag} AND f.class_label = p.class_label AND f.{key} = p.{key})" if flag != "true" else \
        f"EXISTS (SELECT 1 FROM pc f WHERE f.\"partition\" = 'fitting' AND f.class_label = p.class_label AND f.{key} = p.{key})"


def any_class(flag: str, key: str) -> str:
    condition = "" if flag == "true" else f" AND f.{flag}"
    return f"EXISTS (SELECT 1 FROM pc f WHERE f.\"partition\" = 'fitting'{condition} AND f.{key} = p.{key})"


FLAGGED = "fl AS (SELECT p.*, " + ", ".join(f"{same_class(f)} AS hit_{n}" for n, f in NAMES.items()) + " FROM pc p)"


def exposure_columns() -> str:
    out = []
    for n, f in NAMES.items():
        out.append(big(f"count(*) FILTER (\"partition\" = 'fitting' AND {f})", f"{n}_fitting"))
        out.append(big(f"count(*) FILTER (\"partition\" = 'development' AND hit_{n})", f"{n}_development_matches"))
        out.append(big(f"count(*) FILTER (\"partition\" = 'evaluation' AND hit_{n})", f"{n}_evaluation_matches"))
    return ", ".join(out)


REMOVED = ", ".join([
    big("count(*) FILTER (exposed)", "removed_exact"),
    big("count(*) FILTER (exposed AND md)", "removed_matching_development"),
    big("count(*) FILTER (exposed AND me)", "removed_matching_evaluation"),
])


def four(minimum: int = 100) -> str:
    """CTE ``cond`` with the four conditions."""
    return ",\n".join([
        full(), grouped("docs", "hash_consensus", "hash_consensus"),
        f"""ok AS (SELECT class_label FROM ann WHERE classes = 1 AND rn = 1 GROUP BY class_label HAVING count(*) >= {minimum}),
reps AS (SELECT sample_id, class_label, hash_consensus FROM ann WHERE classes = 1 AND rn = 1 AND class_label IN (SELECT class_label FROM ok))""",
        split("reps", "cl", clamped=True),
        "every AS (SELECT sample_id, class_label, hash_consensus FROM docs)",
        split("every", "al"),
        f"""tg AS (SELECT class_label, count(*) AS need, count(*) FILTER ("partition" = 'fitting') AS nf, count(*) FILTER ("partition" = 'development') AS nd FROM cl GROUP BY class_label),
rs0 AS (SELECT al.*, row_number() OVER (PARTITION BY class_label ORDER BY {rank(SELECT_SEED, purpose='select')}, sample_id) AS pos FROM al),
rs1 AS (SELECT rs0.*, nf, nd FROM rs0 JOIN tg USING (class_label) WHERE pos <= need),
rs2 AS (SELECT *, row_number() OVER (PARTITION BY class_label ORDER BY {rank(RESPLIT_SEED, purpose='split')}, sample_id) AS pos2 FROM rs1),
cond AS (SELECT 'full_all' AS condition, sample_id, class_label, "partition", hash_consensus FROM al
  UNION ALL SELECT 'full', sample_id, class_label, "partition", hash_consensus FROM al WHERE class_label IN (SELECT class_label FROM cl)
  UNION ALL SELECT 'clean_consensus', sample_id, class_label, "partition", hash_consensus FROM cl
  UNION ALL SELECT 'random_subsample', sample_id, class_label, CASE WHEN pos2 <= nf THEN 'fitting' WHEN pos2 <= nf + nd THEN 'development' ELSE 'evaluation' END, hash_consensus FROM rs2)""",
    ])


def condition_summary_select() -> str:
    hit = "EXISTS (SELECT 1 FROM cond f WHERE f.condition = p.condition AND f.\"partition\" = 'fitting' AND f.hash_consensus = p.hash_consensus)"
    return f"""SELECT condition, {big('count(*)', 'images')}, {", ".join(big(f"count(*) FILTER (p.\"partition\" = '{x}')", x) for x in PARTS)},
  {big('count(DISTINCT hash_consensus)', 'distinct_consensus_groups')},
  {big("count(*) FILTER (p.\"partition\" = 'development' AND hit)", 'development_images_matching_fitting_group')},
  {big("count(*) FILTER (p.\"partition\" = 'evaluation' AND hit)", 'evaluation_images_matching_fitting_group')},
  {big('count(DISTINCT class_label)', 'classes')} FROM (SELECT p.*, {hit} AS hit FROM cond p) p GROUP BY condition"""


RUNS = "runs AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {s})" for c in ("full", "random_control", "clean_exact") for s in SEEDS
) + ") r(condition, seed))"
EMB = """e0 AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(label AS VARCHAR) AS class_label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS signal FROM embeddings)"""
EMB_MARKED = ",\n".join([
    EMB,
    """e1 AS (SELECT *, list_transform(range(0, 8), lambda r: list_sum(signal[8*r+1:8*r+8]) / 8) AS means FROM e0),
e2 AS (SELECT sample_id, class_label, signal AS features, array_to_string(list_transform(means, lambda x: CASE WHEN x > list_sum(means) / 8 THEN '1' ELSE '0' END), '') AS row_signature FROM e1)""",
    split("e2"), paired("row_signature", ["evaluation"]),
])
EMB_COND = EMB_MARKED + ",\n" + """cond AS (SELECT 'full' AS condition, * FROM pc UNION ALL SELECT 'clean_exact', * FROM pc WHERE in_clean UNION ALL SELECT 'random_control', * FROM pc WHERE in_control),
ex AS (SELECT condition, class_label, generate_subscripts(features, 1) AS i, unnest(features) AS x FROM cond WHERE "partition" = 'fitting'),
cen AS (SELECT condition, class_label, list(mx ORDER BY i) AS centre FROM (SELECT condition, class_label, i, avg(x) AS mx FROM ex GROUP BY ALL) GROUP BY ALL),
dist AS (SELECT c.condition, c.sample_id, c.class_label AS true_label, n.class_label AS label,
  round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (c.features[i] - n.centre[i]) * (c.features[i] - n.centre[i])))), 6) AS d
  FROM cond c JOIN cen n ON n.condition = c.condition WHERE c."partition" = 'evaluation'),
best AS (SELECT condition, sample_id, true_label, arg_min(label, (d, label)) AS predicted_label, min(d) AS distance, sum(exp(-d)) AS w,
  -ln(sum(CASE WHEN label = true_label THEN exp(-d) END) / sum(exp(-d))) AS loss FROM dist GROUP BY ALL)"""

#: Centroids of every run and class from whole millionths; the shrinkage with the least development loss scores the evaluation rows.
STUDY = RUNS + ",\n" + EMB_MARKED + f""",
fx AS MATERIALIZED (SELECT sample_id, class_label, "partition", in_clean, in_control, list_transform(features, lambda x: CAST(floor(x * 1000000) AS BIGINT)) AS v FROM pc),
mem AS (SELECT r.condition, r.seed, f.class_label, f.v FROM fx f, runs r WHERE "partition" = 'fitting'
  AND (r.condition = 'full' OR (r.condition = 'clean_exact' AND in_clean) OR (r.condition = 'random_control' AND in_control))
  AND substr(sha256(CAST(r.seed AS VARCHAR) || chr(0) || sample_id), 1, 1) < 'e'),
sm AS (SELECT condition, seed, class_label, i, sum(x) AS s, count(*) AS n FROM (SELECT condition, seed, class_label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM mem) GROUP BY ALL),
tot AS (SELECT condition, seed, i, sum(s) AS s, sum(n) AS n FROM sm GROUP BY ALL),
cen AS MATERIALIZED (SELECT condition, seed, lam, class_label, list(x ORDER BY i) AS c FROM (
  SELECT sm.condition, sm.seed, l.lam, sm.class_label, sm.i, ((1 - lam) * (sm.s / sm.n) + lam * (tot.s / tot.n)) / 1000000 AS x
  FROM sm JOIN tot ON sm.condition = tot.condition AND sm.seed = tot.seed AND sm.i = tot.i, (SELECT * FROM (VALUES (CAST(0 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) l(lam)) l) GROUP BY ALL),
dist AS MATERIALIZED (SELECT st.study, c.condition, c.seed, c.lam, f.sample_id, f."partition" AS part, f.class_label AS true_label, c.class_label AS label,
  round(sqrt(list_sum(list_transform(range(1, st.b + 1), lambda i: (f.v[i] / 1000000 - c.c[i]) * (f.v[i] / 1000000 - c.c[i])))), 6) AS d
  FROM fx f, cen c, (SELECT * FROM (VALUES ('all', 64), ('half', 32)) st(study, b)) st WHERE f."partition" <> 'fitting'),
fit AS (SELECT study, condition, seed, lam, round(avg(loss), 6) AS loss FROM (
  SELECT study, condition, seed, lam, sample_id, min(d) FILTER (label = true_label) + ln(sum(exp(-d))) AS loss FROM dist WHERE part = 'development' GROUP BY ALL) GROUP BY ALL),
chosen AS (SELECT study, condition, seed, arg_min(lam, (loss, lam)) AS lam FROM fit GROUP BY ALL),
scored AS MATERIALIZED (SELECT d.study, d.condition, CAST(d.seed AS BIGINT) AS seed, sample_id, true_label, arg_min(label, (d, label)) AS predicted_label, d.lam, min(d) AS distance
  FROM dist d JOIN chosen c ON d.study = c.study AND d.condition = c.condition AND d.seed = c.seed AND d.lam = c.lam WHERE part = 'evaluation' GROUP BY ALL)"""
PRED = STUDY + ",\npred AS MATERIALIZED (SELECT * FROM scored WHERE study = 'all')"
CLASSES = "classes AS (SELECT * FROM (VALUES " + ", ".join(f"({q(c)})" for c in LABELS) + ") c(class_label))"
CELLS = """cells AS (SELECT r.condition, r.seed, a.class_label AS true_label, b.class_label AS predicted_label,
  (SELECT count(*) FROM pred p WHERE p.condition = r.condition AND p.seed = r.seed AND p.true_label = a.class_label AND p.predicted_label = b.class_label) AS n
  FROM runs r, classes a, classes b)"""
MARGINS = """mg AS (SELECT r.condition, r.seed, c.class_label,
  (SELECT count(*) FROM pred p WHERE p.condition = r.condition AND p.seed = r.seed AND p.true_label = c.class_label) AS support,
  (SELECT count(*) FROM pred p WHERE p.condition = r.condition AND p.seed = r.seed AND p.predicted_label = c.class_label) AS positives,
  (SELECT count(*) FROM pred p WHERE p.condition = r.condition AND p.seed = r.seed AND p.true_label = c.class_label AND p.predicted_label = c.class_label) AS hits
  FROM runs r, classes c)"""
RATES = """pr AS (SELECT *, CASE WHEN positives = 0 THEN 0 ELSE hits / positives END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall FROM mg),
cs AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""
OVERALL = """os AS (SELECT condition, CAST(seed AS BIGINT) AS seed, sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1, avg(recall) AS macro_recall,
  CAST(sum(support) AS BIGINT) AS evaluation_images FROM cs GROUP BY condition, seed)"""
SCORES = ",\n".join([MARGINS, RATES, OVERALL])
SCORED = with_(PRED, CLASSES, SCORES)
DIFFS = "df AS (" + " UNION ALL ".join(
    f"SELECT a.seed, '{n}' AS contrast, '{m}' AS metric, 100 * (a.{m} - b.{m}) AS d FROM os a JOIN os b ON a.seed = b.seed AND a.condition = '{x}' AND b.condition = '{y}'"
    for n, (x, y) in CONTRASTS.items() for m in METRICS
) + ")"
CONTRASTED = with_(PRED, CLASSES, SCORES, DIFFS)
#: The same for every study.
STUDY_SCORED = with_(STUDY, CLASSES, """mg AS (SELECT study, condition, seed, class_label, count(*) FILTER (true_label = class_label) AS support,
  count(*) FILTER (predicted_label = class_label) AS positives, count(*) FILTER (true_label = class_label AND predicted_label = class_label) AS hits
  FROM scored, classes GROUP BY ALL)""", RATES, OVERALL.replace("SELECT condition", "SELECT study, condition").replace("BY condition", "BY study, condition"))
STUDY_CONTRASTED = STUDY_SCORED.rstrip() + ",\ndf AS (" + " UNION ALL ".join(
    f"SELECT a.study, a.seed, '{n}' AS contrast, '{m}' AS metric, 100 * (a.{m} - b.{m}) AS d FROM os a JOIN os b ON a.study = b.study AND a.seed = b.seed AND a.condition = '{x}' AND b.condition = '{y}'"
    for n, (x, y) in CONTRASTS.items() for m in METRICS
) + ") "


def contrast_select(t: str, by: str = "") -> str:
    half = f"{t} * stddev_samp(d) / sqrt(count(*))"
    return f"""SELECT {by}contrast, metric, {big('count(*)', 'completed_seeds')}, {real('avg(d)', 'mean_pp')}, {real('stddev_samp(d)', 'sample_sd_pp')},
  {real('min(d)', 'minimum_pp')}, {real('max(d)', 'maximum_pp')}, {real(f'avg(d) - {half}', 'ci95_lower_pp')}, {real(f'avg(d) + {half}', 'ci95_upper_pp')}
  FROM df GROUP BY {by}contrast, metric"""


HIST = """hist AS (SELECT event_type AS recipe_name, CAST(day(ts) AS BIGINT) AS epoch, avg(value) AS loss FROM events GROUP BY ALL)"""
TUNE = """tune AS (SELECT event_type AS recipe_name, hour(ts) AS seed, avg(value) AS loss, avg(CASE WHEN value < 10 THEN 1.0 ELSE 0.0 END) AS acc FROM events GROUP BY ALL),
rec AS (SELECT recipe_name, avg(loss) AS mean_loss, avg(acc) AS mean_acc, count(*) AS runs FROM tune GROUP BY ALL)"""
ANNO = """judged AS (SELECT CAST(doc_id AS VARCHAR) AS pair_id, CASE WHEN quality = 1 THEN 'near_duplicate' ELSE 'different' END AS judgement_1,
  CASE WHEN toxic = 0 THEN 'near_duplicate' ELSE 'different' END AS judgement_2 FROM labels)"""
PAIRS = full() + f""",
pp0 AS (SELECT *, {rank(REPRESENTATIVE_SEED)} || ' ' || sample_id AS o FROM docs),
pp1 AS (SELECT *, count(*) OVER (PARTITION BY phash) AS size, substr(min(o) OVER (PARTITION BY phash), 66) AS own, substr(min(o) OVER (PARTITION BY class_label), 66) AS anchor FROM pp0),
pp2 AS (SELECT *, CASE WHEN size > 1 AND own <> sample_id THEN own ELSE anchor END AS partner_id FROM pp1),
pp3 AS (SELECT a.sample_id AS pair_id, a.partner_id, a.class_label,
  CASE WHEN a.ahash = b.ahash THEN 1 ELSE 0 END + CASE WHEN a.dhash = b.dhash THEN 2 ELSE 0 END + CASE WHEN a.phash = b.phash THEN 4 ELSE 0 END AS hash_mask,
  CAST(a.class_label = b.class_label AS BIGINT) AS same_class, CAST(a.rgb_sha256 = b.rgb_sha256 AS BIGINT) AS exact_content,
  CAST(abs(a.n_chars - b.n_chars) AS DOUBLE) AS difference, least(a.n_chars, b.n_chars) / greatest(a.n_chars, b.n_chars) AS similarity
  FROM pp2 a JOIN docs b ON b.sample_id = a.partner_id WHERE a.sample_id <> a.partner_id),
pt AS (SELECT *, CAST(hash_mask >= 4 AS BIGINT) AS phash_match, CASE WHEN hash_mask > 0 THEN 'candidate' ELSE 'nonmatching_control' END AS sample_kind,
  hash_mask || '|' || class_label AS stratum FROM pp3)"""


def groups_union(table: str, predicates: dict[str, str], name: str = "pg") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{n}' AS pair_group, * FROM {table} WHERE {p}" for n, p in predicates.items()) + ")"


def vote_sql(table: str, a: str, b: str, c: str, join: str) -> str:
    """Form every agreeing pair and count votes: the brute-force definition."""
    return f"""vp AS (SELECT e.sample_id, e.class_label <> t.class_label AS other,
  CAST(e.{a} = t.{a} AS INTEGER) + CAST(e.{b} = t.{b} AS INTEGER) + CAST(e.{c} = t.{c} AS INTEGER) AS v
  FROM {table} e JOIN {table} t ON e.original_split = 'val' AND t.original_split = 'train' AND ({join}))
SELECT 'at_least_one' AS votes, {big('count(DISTINCT sample_id)', 'evaluation_matched')}, {big('count(*)', 'pairs')}, {big('count(DISTINCT sample_id) FILTER (other)', 'other_label_matched')} FROM vp WHERE v >= 1
UNION ALL SELECT 'at_least_two', CAST(count(DISTINCT sample_id) AS BIGINT), CAST(count(*) AS BIGINT), CAST(count(DISTINCT sample_id) FILTER (other) AS BIGINT) FROM vp WHERE v >= 2"""


def pair_stat_sql() -> str:
    pieces = []
    for name, keys in {"ahash": ["ahash"], "dhash": ["dhash"], "phash": ["phash"], "all_three": ["ahash", "dhash", "phash"]}.items():
        on = " AND ".join(f"e.{k} = t.{k}" for k in keys)
        pieces.append(f"""SELECT '{name}' AS keys, {big('count(DISTINCT e.sample_id)', 'evaluation_matched')}, {big('count(*)', 'pairs')},
  {big('count(DISTINCT e.sample_id) FILTER (e.class_label <> t.class_label)', 'other_label_matched')},
  {big('count(DISTINCT e.sample_id) FILTER (e.rgb_sha256 = t.rgb_sha256)', 'exact_content_matched')}
  FROM docs e JOIN docs t ON e.original_split = 'val' AND t.original_split = 'train' AND {on}""")
    return " UNION ALL ".join(pieces)


def p3() -> str:
    """CTE ``gd`` with the group-indivisible development split of the documents."""
    return light() + f""",
gk AS (SELECT input_sha256 AS k, any_value(class_label) AS class_label, count(*) AS size, bool_and(original_split = 'train') AS pure FROM docs GROUP BY 1),
tr AS (SELECT class_label, greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) AS target FROM docs WHERE original_split = 'train' GROUP BY 1),
go AS (SELECT k, class_label, size, sum(size) OVER (PARTITION BY class_label ORDER BY {rank(1406, 'k')}, k ROWS UNBOUNDED PRECEDING) AS run FROM gk WHERE pure),
ch AS (SELECT k FROM go JOIN tr USING (class_label) WHERE run - size < target),
gd AS (SELECT *, CASE WHEN original_split = 'val' THEN 'evaluation' WHEN input_sha256 IN (SELECT k FROM ch) THEN 'development' ELSE 'fitting' END AS "partition" FROM docs)"""


def check(name: str, expression: str, table: str) -> str:
    return f"SELECT '{name}' AS \"check\", CAST(coalesce({expression}, 0) AS BIGINT) AS violations FROM {table}"


def split_checks(table: str) -> list[str]:
    return [
        check("repeated_sample_ids", "count(*) - count(DISTINCT sample_id)", table),
        check("unknown_partition", "count(*) FILTER (\"partition\" NOT IN ('fitting', 'development', 'evaluation'))", table),
        check("class_missing_from_partition", "sum(3 - k)", f"(SELECT class_label, count(DISTINCT \"partition\") AS k FROM {table} GROUP BY 1)"),
    ]


def dev_overlap(table: str, key: str) -> str:
    return check(f"development_overlap_{key}", "count(*)", f"{table} d WHERE d.\"partition\" = 'development' AND EXISTS (SELECT 1 FROM {table} o WHERE o.\"partition\" <> 'development' AND o.{key} = d.{key})")


def sealed(rows: str, name: str = "digest") -> str:
    """Digest tree over (bucket, line) rows, with buckets of 12, 8 and 4 digits."""
    children = "sha256(string_agg(bucket || ':' || sealed, chr(10) ORDER BY bucket)) AS sealed, sum(n) AS n"
    return f"""SELECT sha256(coalesce(string_agg(bucket || ':' || sealed, chr(10) ORDER BY bucket), '')) AS {name}, {big('sum(n)', 'rows')}
  FROM (SELECT substr(bucket, 1, 4) AS bucket, {children} FROM (SELECT substr(bucket, 1, 8) AS bucket, {children}
    FROM (SELECT bucket, sha256(string_agg(line, '' ORDER BY line)) AS sealed, count(*) AS n FROM ({rows}) GROUP BY bucket)
    GROUP BY substr(bucket, 1, 8)) GROUP BY substr(bucket, 1, 4))"""


def snapshot_rows(content: str = "file_sha256") -> str:
    return f"SELECT substr(sha256(sample_id), 1, 12) AS bucket, '[\"' || sample_id || '\",\"' || {content} || '\"]' || chr(10) AS line FROM docs"


def overview_part(dataset: str, table: str, exact: str, consensus: str) -> str:
    return f"SELECT '{dataset}' AS dataset, sample_id, class_label, {exact} AS exact, {consensus} AS tuple FROM {table}"


STEPS = """SELECT user_id AS study, event_type AS condition, CAST(isodow(ts) - 1 AS BIGINT) AS seed, ts, event_id, props FROM events"""

ORACLES: dict[str, str] = {
    "identity_digests": with_(light()) + f"""SELECT sample_id, file_sha256, rgb_sha256, input_sha256, sha256('exact_input' || chr(0) || input_sha256) AS duplicate_group_id,
  {rank(REPRESENTATIVE_SEED)} AS representative_rank, {rank(SELECT_SEED, purpose='select')} AS selection_rank FROM docs""",
    "signal_hashes": with_(EMB, signature_ctes("e0", "sample_id")) + "SELECT sample_id, ahash, dhash, phash, hash_consensus FROM sig",
    "text_signatures": with_(full()) + "SELECT sample_id, ahash, dhash, phash, hash_consensus, sha256('hash_consensus' || chr(0) || hash_consensus) AS duplicate_group_id FROM docs",
    "value_groups": with_(full(), melt("docs", SIX)) + f"""SELECT method, value, class_label, {big('count(*)', 'n')},
  {big("count(*) FILTER (original_split = 'train')", 'n_train')}, {big("count(*) FILTER (original_split = 'val')", 'n_eval')} FROM m GROUP BY ALL""",
    "global_summary": with_(full(), melt("docs", SIX)) + summary_select(),
    "global_summary_events": with_(EVT, melt("evt", ["user_type_props", "user_type", "props"])) + summary_select(),
    "global_summary_lineitem": with_(LINE, melt("li", ["part_supplier", "part_quantity", "part"])) + summary_select(),
    "redundancy_audit": with_(full(), melt("docs", SIX), f"gs AS ({summary_select()})", f"ov AS ({OVERLAP})") + "SELECT * FROM gs JOIN ov USING (method)",
    "cross_split_overlap": with_(full("source"), melt("docs", SIX)) + OVERLAP,
    "cross_split_overlap_events": with_(EVT, melt("evt", ["user_type_props", "user_type", "props"])) + OVERLAP,
    "per_class_summary": with_(full("source"), "mx AS (SELECT hash_consensus FROM docs GROUP BY 1 HAVING count(DISTINCT class_label) > 1)") + f"""SELECT class_label, {big('count(*)', 'original_images')},
  {", ".join(big(f'count(DISTINCT {m})', f'{m}_groups') for m in SIX)},
  {big('count(*) FILTER (hash_consensus IN (SELECT hash_consensus FROM mx))', 'images_in_mixed_label_consensus_groups')},
  {big('count(*) - count(DISTINCT hash_consensus)', 'consensus_removed_excess')}, {real('100 * (count(*) - count(DISTINCT hash_consensus)) / count(*)', 'consensus_removed_percent')},
  {big('CASE WHEN count(DISTINCT hash_consensus) >= 20 THEN 1 ELSE 0 END', 'eligible_at_minimum_groups')} FROM docs GROUP BY class_label""",
    "mixed_label_groups": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + f"""SELECT gid AS duplicate_group_id, {big('count(*)', 'group_size')},
  {big('count(DISTINCT class_label)', 'class_count')}, '["' || string_agg(DISTINCT class_label, '","' ORDER BY class_label) || '"]' AS classes_json,
  {big('count(DISTINCT rgb_sha256)', 'distinct_contents')}, any_value(rep) AS representative_sample_id, value AS consensus_value FROM ann GROUP BY gid, value HAVING count(DISTINCT class_label) > 1""",
    "exact_census": with_(light(), melt("docs", THREE)) + f"""SELECT method, {big('count(DISTINCT value)', 'unique_values')},
  {big("count(*) FILTER (original_split = 'train') - count(DISTINCT value) FILTER (original_split = 'train')", 'train_excess')},
  {big("count(*) FILTER (original_split = 'val') - count(DISTINCT value) FILTER (original_split = 'val')", 'evaluation_excess')},
  {big("count(*) FILTER (original_split = 'val' AND (method, value) IN (SELECT method, value FROM m WHERE original_split = 'train'))", 'evaluation_matched')} FROM m GROUP BY method""",
    "matched_by_class": with_(light()) + f"SELECT class_label, {big('count(*)', 'eval_matched_samples')} FROM docs WHERE original_split = 'val' AND rgb_sha256 IN (SELECT rgb_sha256 FROM docs WHERE original_split = 'train') GROUP BY 1",
    "verify_exact_groups": with_(DOC0) + " UNION ALL ".join(
        f"""SELECT '{m}' AS method, {big('count(*) FILTER (n > 1)', 'repeated_groups')}, {big('sum(n - 1)', 'verified_repeats')}, {big('count(*) FILTER (k > 1)', 'groups_that_differ')}
  FROM (SELECT sha256({p}) AS h, count(*) AS n, count(DISTINCT {p}) AS k FROM d0 GROUP BY 1)""" for m, p in (("file_sha256", "text"), ("rgb_sha256", "c"))),
    "dedup_retained": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + DEDUP_SELECT + " WHERE rn = 1",
    "dedup_removed": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + DEDUP_SELECT + " WHERE rn > 1",
    "dedup_groups": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + f"""SELECT gid AS duplicate_group_id, {big('count(*)', 'duplicate_group_size')},
  {big('count(DISTINCT class_label)', 'group_class_count')}, string_agg(DISTINCT class_label, ';' ORDER BY class_label) AS classes,
  {big('count(DISTINCT rgb_sha256)', 'distinct_contents')}, any_value(rep) AS representative_sample_id FROM ann GROUP BY gid""",
    "dedup_exact_fatal": with_(light(), grouped("docs", "input_sha256", "exact_input")) + DEDUP_SELECT + " WHERE rn = 1",
    "dedup_conflicts": with_(full("source"), "mx AS (SELECT hash_consensus AS value FROM docs GROUP BY 1 HAVING count(DISTINCT class_label) > 1 ORDER BY 1 LIMIT 3)",
                             "nn AS (SELECT value, sample_id, row_number() OVER (PARTITION BY value ORDER BY sample_id) AS r FROM docs JOIN mx ON hash_consensus = value)")
    + "SELECT value, string_agg(sample_id, ';' ORDER BY sample_id) AS examples FROM nn WHERE r <= 3 GROUP BY value",
    "safe_pool": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + DEDUP_SELECT + " WHERE classes = 1",
    "pure_representatives": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + DEDUP_SELECT
    + " WHERE classes = 1 AND rn = 1 AND class_label IN (SELECT class_label FROM ann WHERE classes = 1 AND rn = 1 GROUP BY 1 HAVING count(*) >= 10)",
    "eligible_classes": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + f"""SELECT class_label, {big('count(*) FILTER (classes = 1 AND rn = 1)', 'pure_groups')},
  {big('CASE WHEN count(*) FILTER (classes = 1 AND rn = 1) >= 20 THEN 1 ELSE 0 END', 'eligible')} FROM ann GROUP BY class_label""",
    "eligible_classes_pure_universe": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + f"""SELECT class_label, {big('count(*)', 'pure_groups')},
  {big('CASE WHEN count(*) >= 20 THEN 1 ELSE 0 END', 'eligible')} FROM ann WHERE classes = 1 AND rn = 1 GROUP BY class_label""",
    "insufficient_classes": with_(full(), grouped("docs", "hash_consensus", "hash_consensus")) + f"SELECT class_label, {big('count(*)', 'retained_groups')} FROM ann WHERE rn = 1 GROUP BY 1 HAVING count(*) < 120",
    "conservative_cleaning": with_(full("source"), "mx AS (SELECT hash_consensus FROM docs GROUP BY 1 HAVING count(DISTINCT class_label) > 1)",
                                   "ck AS (SELECT class_label, count(DISTINCT hash_consensus) >= 22 AS ok FROM docs GROUP BY 1)",
                                   "el AS (SELECT docs.*, hash_consensus IN (SELECT hash_consensus FROM mx) AS mixed FROM docs JOIN ck USING (class_label) WHERE ok)")
    + f"""SELECT {big('(SELECT count(*) FROM ck WHERE ok)', 'eligible_classes')}, coalesce((SELECT string_agg(class_label, ';' ORDER BY class_label) FROM ck WHERE NOT ok), '') AS excluded_classes,
  {big('count(*)', 'eligible_original_images')}, {big('count(*) FILTER (mixed)', 'mixed_label_images_removed')}, {big('count(*) FILTER (NOT mixed)', 'safe_pool_images')},
  {big('count(DISTINCT hash_consensus) FILTER (NOT mixed)', 'retained_pure_groups')},
  {big('count(*) FILTER (NOT mixed) - count(DISTINCT hash_consensus) FILTER (NOT mixed)', 'within_safe_pool_excess')},
  {real('(count(*) FILTER (NOT mixed) - count(DISTINCT hash_consensus) FILTER (NOT mixed)) / nullif(count(*) FILTER (NOT mixed), 0)', 'within_safe_pool_redundancy_fraction')} FROM el""",
    "post_dedup_class_table": with_(light(), grouped("docs", "input_sha256", "exact_input"), "kept AS (SELECT * FROM ann WHERE rn = 1)", split("kept", clamped=True))
    + f"""SELECT class_label, {big('count(*)', 'original_images')}, {big('count(*) FILTER (rn = 1)', 'retained_groups')}, {big('count(*) FILTER (rn > 1)', 'removed_excess_copies')},
  {real('100 * count(*) FILTER (rn > 1) / count(*)', 'removed_percent')}, {", ".join(big(f"(SELECT count(*) FROM man x WHERE x.class_label = ann.class_label AND x.\"partition\" = '{p}')", p) for p in PARTS)} FROM ann GROUP BY class_label""",
    "dataset_overview": with_(
        full(), EVT, LINE,
        f"al AS ({overview_part('documents', 'docs', 'rgb_sha256', 'hash_consensus')} UNION ALL {overview_part('events', 'evt', 'user_type_props', 'user_type')} UNION ALL {overview_part('lineitem', 'li', 'part_supplier', 'part')})",
        "tg AS (SELECT dataset, tuple, count(*) AS n, count(DISTINCT class_label) AS k, count(DISTINCT exact) AS x FROM al GROUP BY ALL)",
        "ck AS (SELECT dataset, class_label, count(DISTINCT tuple) >= 150 AS ok FROM al GROUP BY ALL)",
        "el AS (SELECT al.dataset, al.tuple, k > 1 AS mixed FROM al JOIN ck USING (dataset, class_label) JOIN tg USING (dataset, tuple) WHERE ok)",
        f"""cons AS (SELECT dataset, count(*) AS eo, count(*) FILTER (mixed) AS mr, count(DISTINCT tuple) FILTER (NOT mixed) AS rp FROM el GROUP BY dataset)""",
        "ex AS (SELECT dataset, count(*) AS images, count(DISTINCT exact) AS g, count(DISTINCT class_label) AS classes FROM al GROUP BY dataset)",
        "tt AS (SELECT dataset, count(*) AS g, count(*) FILTER (k > 1) AS mg, coalesce(sum(n) FILTER (k > 1), 0) AS mi, count(*) FILTER (k > 1 AND x = 1) AS xm FROM tg GROUP BY dataset)",
        "kk AS (SELECT dataset, count(*) FILTER (ok) AS ec, coalesce(string_agg(class_label, ';' ORDER BY class_label) FILTER (NOT ok), '') AS xc FROM ck GROUP BY dataset)",
    ) + f"""SELECT ex.dataset, {big('images', 'images')}, {big('ex.g', 'exact_groups')}, {big('images - ex.g', 'exact_excess')}, {real('(images - ex.g) / images', 'exact_redundancy_fraction')},
  {big('tt.g', 'consensus_groups')}, {big('images - tt.g', 'consensus_excess')}, {real('(images - tt.g) / images', 'consensus_redundancy_fraction')},
  {big('mg', 'mixed_label_consensus_groups')}, {big('mi', 'images_in_mixed_label_consensus_groups')}, {big('xm', 'exact_mixed_label_consensus_groups')}, {big('classes', 'classes')},
  {big('ec', 'eligible_classes')}, xc AS excluded_classes, {big('coalesce(eo, 0)', 'eligible_original_images')}, {big('coalesce(mr, 0)', 'mixed_label_images_removed')}, {big('coalesce(rp, 0)', 'retained_pure_groups')},
  {big('coalesce(eo - mr, 0)', 'safe_pool_images')}, {big('coalesce(eo - mr - rp, 0)', 'within_safe_pool_excess')}, {real('(eo - mr - rp) / nullif(eo - mr, 0)', 'within_safe_pool_redundancy_fraction')},
  {big('tt.g - mg', 'pure_consensus_groups_after_excluding_mixed')} FROM ex JOIN tt USING (dataset) JOIN kk USING (dataset) LEFT JOIN cons USING (dataset)""",
    "stratified_split": with_(light(), split("docs")) + 'SELECT sample_id, class_label, "partition" FROM man',
    "stratified_split_events": with_(EVT, split("evt")) + 'SELECT sample_id, class_label, "partition" FROM man',
    "stratified_split_lineitem": with_(LINE, split("li")) + 'SELECT sample_id, class_label, "partition" FROM man',
    "clamped_split": with_(light("source"), split("docs", clamped=True)) + 'SELECT sample_id, class_label, "partition" FROM man',
    "split_80_20": with_(EVT) + f"""SELECT sample_id, class_label, CASE WHEN row_number() OVER (PARTITION BY class_label ORDER BY {rank(1406)}, sample_id)
  <= count(*) OVER (PARTITION BY class_label) - ceil(count(*) OVER (PARTITION BY class_label) * 0.2) THEN 'train' ELSE 'val' END AS "partition" FROM evt""",
    "group_development_split": with_(p3()) + 'SELECT sample_id, class_label, "partition" FROM gd',
    "split_violations": with_(p3()) + " UNION ALL ".join([
        *split_checks("gd"),
        check("evaluation_population_changed", "count(*) FILTER ((original_split = 'val') <> (\"partition\" = 'evaluation'))", "gd"),
        check("unexpected_source_split", "count(*) FILTER (original_split NOT IN ('train', 'val'))", "gd"),
        dev_overlap("gd", "rgb_sha256"), dev_overlap("gd", "input_sha256"),
    ]),
    "clean_split_violations": with_(light(), grouped("docs", "input_sha256", "exact_input"), "kept AS (SELECT * FROM ann WHERE rn = 1)", split("kept")) + " UNION ALL ".join([
        *split_checks("man"), dev_overlap("man", "input_sha256"), check("repeated_duplicate_group", "count(*) - count(DISTINCT gid)", "man"),
    ]),
    "protocol_pair": with_(
        full("source"), grouped("docs", "hash_consensus", "hash_consensus"), "safe AS (SELECT * FROM ann WHERE classes = 1)", split("safe", "fu", clamped=True),
        "reps AS (SELECT * FROM ann WHERE classes = 1 AND rn = 1 AND class_label IN (SELECT class_label FROM ann WHERE classes = 1 AND rn = 1 GROUP BY 1 HAVING count(*) >= 5))",
        split("reps", "cl", clamped=True),
    ) + f"""SELECT 'full' AS protocol, class_label, "partition", {big('count(*)', 'images')} FROM fu GROUP BY ALL UNION ALL
SELECT 'clean', class_label, "partition", CAST(count(*) AS BIGINT) FROM cl GROUP BY ALL""",
    "protocol_summary": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus"),
        "pk AS (SELECT class_label, count(*) FILTER (classes = 1 AND rn = 1) >= 20 AS ok FROM ann GROUP BY 1)") + f"""SELECT {big('count(*)', 'source_images')},
  {big('count(*) FILTER (classes > 1 AND rn = 1)', 'mixed_label_groups_excluded')}, {big('count(*) FILTER (classes > 1)', 'mixed_label_images_excluded')},
  coalesce((SELECT string_agg(class_label, ';' ORDER BY class_label) FROM pk WHERE ok), '') AS eligible_classes, coalesce((SELECT string_agg(class_label, ';' ORDER BY class_label) FROM pk WHERE NOT ok), '') AS excluded_classes,
  {big('count(*) FILTER (classes = 1)', 'safe_full_images')}, {big('count(*) FILTER (classes = 1 AND ok AND rn = 1)', 'clean_representatives')},
  {big('count(*) FILTER (classes = 1 AND ok AND rn > 1)', 'consensus_excess_removed_from_eligible_safe_pool')} FROM ann JOIN pk USING (class_label)""",
    "audit_metadata": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus"),
        "pk AS (SELECT class_label, count(DISTINCT hash_consensus) >= 22 AS ok FROM docs GROUP BY 1)", f"sn AS ({sealed(snapshot_rows())})") + f"""SELECT
  '{{"train":' || count(*) FILTER (original_split = 'train') || ',"val":' || count(*) FILTER (original_split = 'val') || '}}' AS original_split_counts, {big('count(*)', 'images')},
  {big('count(DISTINCT class_label)', 'classes')}, coalesce((SELECT string_agg(class_label, ';' ORDER BY class_label) FROM pk WHERE NOT ok), '') AS classes_below_minimum,
  {big('count(*) FILTER (rn = 1)', 'retained_representatives')}, {big('count(*) FILTER (rn > 1)', 'removed_excess_copies')}, {big('count(*) FILTER (rn = 1 AND classes > 1)', 'mixed_label_consensus_groups')},
  {big('CASE WHEN count(*) FILTER (classes > 1) = 0 THEN 1 ELSE 0 END', 'safe_to_construct_label_preserving_clean_split')}, (SELECT digest FROM sn) AS dataset_snapshot_sha256,
  'completed' AS status, {big('22', 'minimum_groups_per_class')}, {big(str(REPRESENTATIVE_SEED), 'representative_seed')}, {big('64', 'hash_bits')}, {big('0', 'hamming_threshold')} FROM ann""",
    "partition_overlap": with_(light(), split("docs"), melt("man", THREE)) + f"""SELECT method AS identity_key,
  {", ".join(big(f"count(*) FILTER (\"partition\" = '{a}' AND (method, value) IN (SELECT method, value FROM m WHERE \"partition\" = '{b}'))", n) for a, b, n in (
      ("development", "fitting", "development_matching_fitting_images"), ("evaluation", "fitting", "evaluation_matching_fitting_images"),
      ("evaluation", "development", "evaluation_matching_development_images")))} FROM m GROUP BY method""",
    "class_partition_counts": with_(light(), split("docs")) + "SELECT class_label, " + ", ".join(
        [big(f"count(*) FILTER (\"partition\" = '{p}')", f"{p}_images") for p in PARTS]
        + [big(f"count(DISTINCT {k}) FILTER (\"partition\" = '{p}')", f"{p}_{k}_distinct") for p in PARTS for k in THREE]
    ) + " FROM man GROUP BY class_label",
    "class_exposure_global": with_(light(), split("docs")) + "SELECT class_label, " + ", ".join(
        [big(f"count(*) FILTER (\"partition\" = '{p}')", f"{p}_images") for p in PARTS]
        + [big(f"count(DISTINCT {k}) FILTER (\"partition\" = '{p}')", f"{p}_{k}_distinct") for p in PARTS for k in THREE[1:]]
        + [big(f"count(*) FILTER (\"partition\" = 'evaluation' AND {k} IN (SELECT {k} FROM man WHERE \"partition\" = 'fitting'))", f"evaluation_{k}_matches_fitting") for k in THREE[1:]]
    ) + " FROM man GROUP BY class_label",
    "paired_conditions": PAIRED + PAIRED_SELECT,
    "eval_only_conditions": PAIRED_RGB + PAIRED_SELECT,
    "condition_violations": PAIRED + " UNION ALL ".join([
        check("clean_retains_held_out_identity", "count(*)", "pc WHERE \"partition\" = 'fitting' AND in_clean AND input_sha256 IN (SELECT input_sha256 FROM pc WHERE \"partition\" <> 'fitting')"),
        check("control_class_size_differs", "count(*) FILTER (a <> b)", "(SELECT class_label, count(*) FILTER (in_clean) AS a, count(*) FILTER (in_control) AS b FROM pc WHERE \"partition\" = 'fitting' GROUP BY 1)"),
    ]),
    "condition_exposure": PAIRED.rstrip() + ",\n" + FLAGGED + f"""
SELECT class_label, {big("count(*) FILTER (\"partition\" = 'development')", 'development')}, {big("count(*) FILTER (\"partition\" = 'evaluation')", 'evaluation')}, {REMOVED}, {exposure_columns()} FROM fl GROUP BY class_label""",
    "condition_exposure_global": PAIRED_RGB + "SELECT class_label, " + ", ".join(
        [big("count(*) FILTER (exposed)", "removed_exact"), big("count(*) FILTER (\"partition\" = 'development')", "development"), big("count(*) FILTER (\"partition\" = 'evaluation')", "evaluation")]
        + [big(f"count(*) FILTER (\"partition\" = 'fitting' AND {f})", f"{n}_fitting") for n, f in NAMES.items()]
        + [big(f"count(*) FILTER (\"partition\" = 'evaluation' AND hit_{n}_{s})", f"{n}_evaluation_{s}_matches") for n in NAMES for s in ("native", "input")]
    ) + " FROM (SELECT p.*, " + ", ".join(f"{any_class(f, k)} AS hit_{n}_{s}" for n, f in NAMES.items() for k, s in (("rgb_sha256", "native"), ("input_sha256", "input"))) + " FROM pc p) GROUP BY class_label",
    "removed_attribution": PAIRED + f"SELECT class_label, {REMOVED} FROM pc GROUP BY class_label HAVING count(*) FILTER (exposed) > 0",
    "class_exposure_report": PAIRED.rstrip() + ",\n" + FLAGGED + "\nSELECT class_label, " + ", ".join(
        [big("count(*)", "pooled_images"), big("count(DISTINCT input_sha256)", "pooled_distinct_exact_inputs")]
        + [big(f"count(*) FILTER (\"partition\" = 'fitting' AND {f})", f"{n}_fitting") for n, f in NAMES.items()]
        + [big("count(*) FILTER (exposed)", "removed_from_fitting"), big("count(*) FILTER (\"partition\" = 'development')", "development"), big("count(*) FILTER (\"partition\" = 'evaluation')", "evaluation")]
        + [big(f"count(*) FILTER (\"partition\" = '{p}' AND hit_{n})", f"{s}_{p}_images_with_fitting_match") for n, s in (("full", "full"), ("clean_exact", "clean"), ("random_control", "control")) for p in ("evaluation", "development")]
        + [big("count(*) - count(DISTINCT input_sha256)", "pooled_excess_exact_copies"), real("100 * (count(*) - count(DISTINCT input_sha256)) / count(*)", "pooled_exact_redundancy_percent"),
           real("coalesce(100 * count(*) FILTER (exposed) / nullif(count(*) FILTER (\"partition\" = 'fitting'), 0), 0)", "fitting_removal_percent")]
    ) + " FROM fl GROUP BY class_label",
    "scope_summary": PAIRED.rstrip() + """,
z AS (SELECT count(*) AS n, count(DISTINCT input_sha256) AS d, count(*) FILTER ("partition" = 'fitting') AS f, count(*) FILTER ("partition" = 'fitting' AND in_clean) AS c,
  count(*) FILTER ("partition" = 'fitting' AND in_control) AS r, count(*) FILTER ("partition" = 'development') AS dv, count(*) FILTER ("partition" = 'evaluation') AS ev, count(*) FILTER (exposed) AS x FROM pc)
SELECT 'pooled_full_dataset' AS scope, CAST(n AS BIGINT) AS images, CAST(d AS BIGINT) AS distinct_exact_inputs, CAST(n - d AS BIGINT) AS excess_exact_copies, round(100 * (n - d) / n, 6) AS redundancy_percent,
  CAST(f AS BIGINT) AS fitting, CAST(dv AS BIGINT) AS development, CAST(ev AS BIGINT) AS evaluation, CAST(0 AS BIGINT) AS removed_from_fitting FROM z
UNION ALL SELECT 'experimental_clean_exact_dataset', c + dv + ev, NULL, NULL, NULL, c, dv, ev, x FROM z UNION ALL SELECT 'random_control_dataset', r + dv + ev, NULL, NULL, NULL, r, dv, ev, f - r FROM z""",
    "reconstruct_check": PAIRED.rstrip() + f""",
f AS (SELECT sample_id FROM pc WHERE "partition" = 'fitting'), c AS (SELECT sample_id FROM pc WHERE "partition" = 'fitting' AND in_clean), x AS (SELECT sample_id FROM pc WHERE exposed)
SELECT {big('(SELECT count(*) FROM f WHERE sample_id NOT IN (SELECT sample_id FROM man))', 'unknown_samples')},
  {big('(SELECT count(*) FROM (SELECT * FROM f EXCEPT (SELECT * FROM c UNION SELECT * FROM x)))', 'missing_from_clean_and_removed')},
  {big('(SELECT count(*) FROM ((SELECT * FROM c UNION SELECT * FROM x) EXCEPT SELECT * FROM f))', 'not_in_full')},
  {big('(SELECT count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM x))', 'both_clean_and_removed')}""",
    "matched_subsample": with_(four()) + "SELECT sample_id, class_label, \"partition\" FROM cond WHERE condition = 'random_subsample'",
    "condition_summary": with_(four()) + condition_summary_select(),
    "condition_class_counts": with_(four()) + "SELECT class_label, " + ", ".join(
        big(f"count(*) FILTER (condition = '{n}' AND \"partition\" = '{p}')", f"{n}_{p}") for n in ("full_all", "full", "clean_consensus", "random_subsample") for p in PARTS
    ) + " FROM cond GROUP BY class_label",
    "exposure_fractions": with_(four(), f"cs AS ({condition_summary_select()})") + f"""SELECT condition, images, fitting, development, evaluation, distinct_consensus_groups,
  evaluation_images_matching_fitting_group AS evaluation_matched, {real('evaluation_images_matching_fitting_group / evaluation', 'evaluation_matched_fraction')} FROM cs""",
    "condition_parity": with_(four(), "pn AS (SELECT class_label, \"partition\", count(*) FILTER (condition = 'random_subsample') AS a, count(*) FILTER (condition = 'clean_consensus') AS b FROM cond GROUP BY ALL)")
    + f"SELECT {big('count(*) FILTER (a <> b)', 'differing_strata')} FROM pn",
    "method_class_overlap": with_(full("source"), melt("docs", SIX)) + f"""SELECT method, class_label, {big("count(*) FILTER (original_split = 'train')", 'train_samples')},
  {big("count(DISTINCT value) FILTER (original_split = 'train')", 'train_unique_groups')}, {big("count(*) FILTER (original_split = 'val')", 'eval_samples')},
  {big("count(*) FILTER (original_split = 'val' AND (method, value) IN (SELECT method, value FROM m WHERE original_split = 'train'))", 'eval_matched_samples')} FROM m GROUP BY ALL""",
    "method_class_overlap_wide": with_(full("source")) + f"""SELECT class_label, {big("count(*) FILTER (original_split = 'val')", 'eval_samples')},
  {", ".join(big(f"count(*) FILTER (original_split = 'val' AND {k} IN (SELECT {k} FROM docs WHERE original_split = 'train'))", f'{k}_matched') for k in ('rgb_sha256', 'phash', 'hash_consensus'))} FROM docs GROUP BY class_label""",
    "hash_pair_stats": with_(full("source")) + pair_stat_sql(),
    "hash_vote_stats": with_(full("source")).rstrip() + ",\n" + vote_sql("docs", "ahash", "dhash", "phash", "e.ahash = t.ahash OR e.dhash = t.dhash OR e.phash = t.phash"),
    # Agreement on part_supplier or part_quantity implies agreement on part.
    "key_vote_stats_lineitem": with_(LINE).rstrip() + ",\n" + vote_sql("li", "part_supplier", "part_quantity", "part", "e.part = t.part"),
    "nearest_centroid_predictions": with_(EMB_COND) + f"SELECT condition, sample_id, true_label, predicted_label, {real('distance', 'distance')} FROM best",
    "prediction_violations": with_(EMB_COND) + f"""SELECT condition, {big('count(*)', 'rows')}, {big('count(*) FILTER (k <> 10)', 'wrong_shape')}, {big('count(*) FILTER (NOT isfinite(w))', 'nonfinite')},
  {big("count(*) FILTER (true_label NOT IN (SELECT CAST(label AS VARCHAR) FROM embeddings))", 'unknown_label')}, {big('count(*) FILTER (top <> predicted_label)', 'not_arg_max')}
  FROM best JOIN (SELECT condition, sample_id, count(*) AS k, arg_max(label, (exp(-d), -CAST(label AS INTEGER))) AS top FROM dist GROUP BY ALL) USING (condition, sample_id) GROUP BY condition""",
    "mean_log_loss": with_(EMB_COND) + f"SELECT condition, {real('avg(loss)', 'mean_log_loss')}, {big('count(*)', 'rows')} FROM best GROUP BY condition",
    "study_predictions": with_(STUDY) + f"SELECT study, condition, seed, sample_id, true_label, predicted_label, lam AS shrinkage, {real('distance', 'distance')} FROM scored",
    "study_selection": with_(STUDY) + f"SELECT study, f.condition, CAST(f.seed AS BIGINT) AS seed, f.lam AS shrinkage, {real('loss', 'development_loss')}, CAST(f.lam = c.lam AS BIGINT) AS chosen FROM fit f JOIN chosen c USING (study, condition, seed)",
    "confusion_matrix": with_(PRED, CLASSES, CELLS) + f"SELECT condition, CAST(seed AS BIGINT) AS seed, true_label, predicted_label, {big('n', 'n')} FROM cells",
    "confusion_wide": with_(PRED, CLASSES, CELLS) + "SELECT condition, CAST(seed AS BIGINT) AS seed, true_label AS true_class, " + ", ".join(
        f"CAST(sum(n) FILTER (predicted_label = {q(c)}) AS BIGINT) AS \"{c}\"" for c in LABELS) + " FROM cells GROUP BY ALL",
    "class_scores": SCORED + f"SELECT condition, CAST(seed AS BIGINT) AS seed, class_label, {big('support', 'support')}, {real('precision', 'precision')}, {real('recall', 'recall')}, {real('f1', 'f1')} FROM cs",
    "overall_scores": SCORED + f"SELECT condition, seed, {', '.join(real(m, m) for m in METRICS)}, evaluation_images FROM os",
    "class_weights": with_("c AS (SELECT event_type AS class_label, count(*) AS n FROM events GROUP BY 1)",
                           "r AS (SELECT *, sqrt((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)) AS raw FROM c)")
    + f"SELECT class_label, {big('n', 'n')}, {real('least(2.0, greatest(0.5, raw / (SELECT sum(raw * n) / sum(n) FROM r)))', 'weight')} FROM r",
    "best_epoch": with_(HIST) + f"SELECT recipe_name, arg_min(epoch, (loss, epoch)) AS selected_epoch, {real('min(loss)', 'development_loss')}, {big('count(*)', 'epochs')} FROM hist GROUP BY recipe_name",
    "recipe_summary": with_(TUNE) + f"SELECT recipe_name, {real('mean_loss', 'mean_development_loss')}, {real('mean_acc', 'mean_development_accuracy')}, {big('runs', 'runs')} FROM rec",
    "recipe_selection": with_(TUNE) + f"SELECT recipe_name, {real('mean_loss', 'mean_development_loss')}, {real('mean_acc', 'mean_development_accuracy')} FROM rec ORDER BY mean_loss, recipe_name LIMIT 1",
    "label_index": f"SELECT source AS class_label, {big('row_number() OVER (ORDER BY source) - 1', 'label_index')} FROM (SELECT DISTINCT source FROM documents)",
    "score_recompute": with_(PRED, CLASSES, SCORES, CELLS) + f"""SELECT 'metrics' AS "check", condition || '/' || seed AS subject, 'accuracy' AS field, {real('accuracy + 0.001', 'stored')}, {real('accuracy', 'recomputed')} FROM os WHERE condition = 'full' AND seed = {SEEDS[0]}
UNION ALL SELECT 'confusion_matrix', condition || '/' || seed || '/3/3', 'n', CAST(n + 1 AS DOUBLE), CAST(n AS DOUBLE) FROM cells WHERE condition = 'full' AND seed = {SEEDS[0]} AND true_label = '3' AND predicted_label = '3'""",
    "results_union": SCORED + f"SELECT condition, seed, {', '.join(real(m, m) for m in METRICS)}, evaluation_images, sha256('state' || chr(0) || seed) AS initial_state_sha256 FROM os",
    "seed_contrasts": CONTRASTED + f"SELECT seed, contrast, metric, {real('d', 'difference_pp')} FROM df",
    "seed_contrasts_wide": CONTRASTED + "SELECT seed, " + ", ".join(
        real(f"max(d) FILTER (contrast = '{c}' AND metric = '{m}')", f"{c}_{m}_pp") for c in CONTRASTS for m in METRICS) + " FROM df GROUP BY seed",
    "metric_summary": SCORED + " UNION ALL ".join(
        f"""SELECT condition, '{m}' AS metric, {big('count(*)', 'completed_seeds')}, {real(f'avg(100 * {m})', 'mean_percent')}, {real(f'stddev_samp(100 * {m})', 'sample_sd_pp')},
  {real(f'min(100 * {m})', 'minimum_percent')}, {real(f'max(100 * {m})', 'maximum_percent')} FROM os GROUP BY condition""" for m in METRICS),
    "contrast_summary": CONTRASTED + contrast_select(repr(t_critical(4))),
    "contrast_summary_tabulated": CONTRASTED + contrast_select(repr(TABULATED_T[5])),
    "sign_claims": CONTRASTED + f"SELECT contrast, metric, {big('CASE WHEN min(d) > 0 THEN 1 ELSE 0 END', 'all_positive')}, {big('CASE WHEN min(d) < 0 AND max(d) > 0 THEN 1 ELSE 0 END', 'straddles_zero')} FROM df GROUP BY contrast, metric",
    "class_recall_contrast": SCORED + f"SELECT class_label, {real("100 * (avg(recall) FILTER (condition = 'random_control') - avg(recall) FILTER (condition = 'clean_exact'))", 'recall_difference_pp')} FROM cs GROUP BY class_label",
    "study_aggregate": SCORED + f"""SELECT condition, {real('avg(accuracy)', 'accuracy_mean')}, {real('stddev_samp(accuracy)', 'accuracy_std')}, {real('avg(macro_f1)', 'macro_f1_mean')},
  {real('stddev_samp(macro_f1)', 'macro_f1_std')} FROM os GROUP BY condition""",
    "contrast_extremes": CONTRASTED + f"SELECT contrast, {real('min(m)', 'minimum_mean_pp')}, {real('max(m)', 'maximum_mean_pp')} FROM (SELECT contrast, avg(d) AS m FROM df WHERE metric = 'accuracy' GROUP BY contrast) GROUP BY contrast",
    "study_results": STUDY_SCORED + f"""SELECT study, condition, {real('avg(accuracy)', 'accuracy_mean')}, {real('stddev_samp(accuracy)', 'accuracy_std')}, {real('avg(macro_f1)', 'macro_f1_mean')},
  {real('stddev_samp(macro_f1)', 'macro_f1_std')} FROM os GROUP BY study, condition""",
    "study_contrasts": STUDY_CONTRASTED + contrast_select(repr(t_critical(4)), "study, "),
    "study_contrast_extremes": STUDY_CONTRASTED + f"SELECT contrast, metric, {big('count(*)', 'studies')}, {real('min(m)', 'minimum_mean_pp')}, {real('max(m)', 'maximum_mean_pp')} FROM (SELECT study, contrast, metric, avg(d) AS m FROM df GROUP BY ALL) GROUP BY contrast, metric",
    "annotator_agreement": with_(ANNO, """ag AS (SELECT count(*) AS n, avg(CASE WHEN judgement_1 = judgement_2 THEN 1.0 ELSE 0.0 END) AS o FROM judged),
w AS (SELECT DISTINCT unnest([judgement_1, judgement_2]) AS j FROM judged),
ee AS (SELECT sum((SELECT count(*) FROM judged WHERE judgement_1 = j) * (SELECT count(*) FROM judged WHERE judgement_2 = j)) AS s FROM w)""")
    + f"SELECT {big('n', 'pairs')}, {real('o', 'observed_agreement')}, {real('s / (n * n)', 'expected_agreement')}, {real('CASE WHEN s / (n * n) < 1 THEN (o - s / (n * n)) / (1 - s / (n * n)) ELSE 1 END', 'cohen_kappa')} FROM ag, ee",
    "annotation_violations": f"""SELECT CAST(a AS BIGINT) AS annotator, {big('(SELECT count(*) FROM labels)', 'rows')}, {big('0', 'blank_fields')}, {big('0', 'unknown_judgements')}, {big('0', 'repeated_pair_ids')},
  {big('0', 'ids_not_in_pairs')}, {big('(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))', 'pairs_not_judged')} FROM (VALUES (1), (2)) t(a)""",
    "annotation_strata": with_(PAIRS, ANNO, "pj AS (SELECT * FROM pt JOIN judged USING (pair_id))", groups_union("pj", {
        "all_hash_candidates": "sample_kind = 'candidate'", "ahash_only": "hash_mask = 1", "dhash_only": "hash_mask = 2", "phash_only": "hash_mask = 4",
        "exactly_two_hashes": "hash_mask IN (3, 5, 6)", "all_three_hashes": "hash_mask = 7", "no_hash_controls": "sample_kind = 'nonmatching_control'"}))
    + f"SELECT pair_group, {big('count(*)', 'pairs')}, {', '.join(big(f"count(*) FILTER (judgement_{a} = '{j}')", f'{j}_{a}') for j in JUDGEMENTS for a in (1, 2))} FROM pg GROUP BY pair_group",
    "annotation_disagreements": with_(ANNO) + "SELECT * FROM judged WHERE judgement_1 <> judgement_2",
    "pair_masks": with_(PAIRS) + f"SELECT pair_id, partner_id, class_label, {big('hash_mask', 'hash_mask')}, phash_match, same_class, exact_content, sample_kind, stratum, difference, {real('similarity', 'similarity')} FROM pt",
    "pair_metric_summary": with_(PAIRS, groups_union("pt", {
        "all_candidates": "sample_kind = 'candidate'", "phash_matches": "phash_match = 1", "all_three_matches": "hash_mask = 7",
        "all_three_nonidentical": "hash_mask = 7 AND exact_content = 0", "nonmatching_controls": "sample_kind = 'nonmatching_control'"}))
    + f"""SELECT pair_group, {big('count(*)', 'pairs')}, {big('sum(exact_content)', 'exact')}, {real('min(similarity)', 'similarity_min')}, {real('max(similarity)', 'similarity_max')},
  {real('median(difference)', 'difference_median')}, {real('median(similarity)', 'similarity_median')} FROM pg GROUP BY pair_group""",
    "empirical_cdf": with_(PAIRS, groups_union("pt", {
        "all_three": "hash_mask = 7", "phash_fewer_than_three": "phash_match = 1 AND hash_mask <> 7", "no_hash_match": "sample_kind = 'nonmatching_control'"}))
    + f"""SELECT pair_group, {big('row_number() OVER (PARTITION BY pair_group ORDER BY difference)', 'position')}, difference,
  {real('row_number() OVER (PARTITION BY pair_group ORDER BY difference) / count(*) OVER (PARTITION BY pair_group)', 'cumulative_fraction')} FROM pg""",
    "stratum_counts": with_(PAIRS) + f"SELECT sample_kind, {big('count(*)', 'pairs')}, {big('count(DISTINCT stratum)', 'strata')} FROM pt GROUP BY sample_kind",
    "removal_ranking": with_(full("source"), grouped("docs", "hash_consensus", "hash_consensus")) + f"""SELECT class_label, {real('100 * count(*) FILTER (rn > 1) / count(*)', 'removed_percent')},
  CASE WHEN count(*) FILTER (rn = 1) < 25 THEN 'excluded' ELSE 'retained' END AS status FROM ann GROUP BY class_label""",
    "manifest_merge_check": with_(light(), split("docs")) + f"""SELECT {big('count(*) FILTER (a.sample_id IS NOT NULL AND b.sample_id IS NOT NULL)', 'matched')}, {big('count(*) FILTER (b.sample_id IS NULL)', 'only_in_source')},
  {big('count(*) FILTER (a.sample_id IS NULL)', 'only_in_hashes')}, {big('count(*) FILTER (a.class_label <> b.class_label)', 'label_mismatches')},
  {big('count(*) FILTER (a.file_sha256 <> b.file_sha256 OR a.rgb_sha256 <> b.rgb_sha256)', 'digest_mismatches')} FROM man a FULL JOIN docs b ON a.sample_id = b.sample_id""",
    "index_check": f"SELECT {big('(SELECT count(*) - count(DISTINCT doc_id) FROM documents)', 'repeated_ids')}, {big('(SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))', 'missing_ids')}",
    "content_drift": with_(light()) + "SELECT sample_id, 'changed' AS problem FROM docs WHERE file_sha256 <> rgb_sha256",
    "membership_drift": "SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'added' AS change FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT CAST(doc_id AS VARCHAR), 'removed' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "run_completeness": with_(PRED) + f"""SELECT c AS condition, CAST(s AS BIGINT) AS seed, 'missing' AS problem FROM (VALUES ('full'), ('clean_exact'), ('random_subsample')) a(c), (VALUES {", ".join(f"({s})" for s in [*SEEDS, 1])}) b(s)
  WHERE (c, s) NOT IN (SELECT condition, seed FROM pred) UNION ALL SELECT DISTINCT condition, seed, 'extra' FROM pred WHERE condition = 'random_control'""",
    "paired_start_check": with_(PRED) + f"SELECT seed, {big('1', 'initial_states')}, {big('count(DISTINCT condition)', 'runs')} FROM pred GROUP BY seed",
    "run_gaps": f"""WITH st AS ({STEPS}) SELECT a.study, b.condition, c.seed FROM (SELECT DISTINCT study FROM st) a, (SELECT DISTINCT condition FROM st) b, (SELECT DISTINCT seed FROM st) c
  WHERE NOT EXISTS (SELECT 1 FROM st s WHERE s.study = a.study AND s.condition = b.condition AND s.seed = c.seed)""",
    "unpaired_starts": f"""WITH st AS ({STEPS}), fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study, seed, condition ORDER BY ts, event_id) AS k FROM st) WHERE k = 1)
  SELECT study, seed, {big('count(*)', 'runs')}, {big('count(DISTINCT props)', 'initial_states')}, min(condition) AS first_condition,
  {big('CASE WHEN count(DISTINCT props) = 1 THEN 1 ELSE 0 END', 'paired')} FROM fs GROUP BY study, seed""",
    "claim_check": with_(light()) + f"""SELECT claim, {real('expected', 'expected')}, {real('found', 'found')}, {big('CASE WHEN expected = found THEN 1 ELSE 0 END', 'holds')} FROM (
  SELECT 'file_sha256_excess' AS claim, count(*) - count(DISTINCT file_sha256) AS expected, count(*) - count(DISTINCT file_sha256) AS found FROM docs UNION ALL
  SELECT 'rgb_sha256_excess', count(*) - count(DISTINCT file_sha256) + 1, count(*) - count(DISTINCT rgb_sha256) FROM docs)""",
    "fraction_check": with_(full(), melt("docs", SIX), f"ov AS ({OVERLAP})") + """SELECT method FROM (SELECT *, evaluation_matched / evaluation_images AS f FROM ov)
  WHERE abs(f + CASE WHEN method = 'ahash' THEN 0.000001 ELSE 0 END - f) >= 0.000000000001""",
    "protocol_reuse_check": with_(light(), split("docs")) + " UNION ALL ".join([
        *split_checks("man"), check("unexpected_source_split", "count(*) FILTER (original_split NOT IN ('train', 'val'))", "man"),
        check("membership_drift", "count(*)", "(SELECT sample_id FROM docs EXCEPT SELECT sample_id FROM man)"),
        check("unsafe_paths", "count(*) FILTER (sample_id LIKE '/%' OR sample_id LIKE '%..%')", "man"),
        check("content_drift", "count(*)", "(SELECT sample_id, file_sha256 FROM docs EXCEPT SELECT sample_id, file_sha256 FROM man)"),
        check("manifest_digest", "0", "(SELECT 1)"),
    ]),
    "selection_recheck": "SELECT DISTINCT event_type AS recipe_name, 'differs' AS problem FROM events WHERE event_type = 'view'",
    "settings_check": with_(EVT) + """SELECT class_label AS name, CAST(count(*) AS VARCHAR) AS stored, CAST(count(*) FILTER (original_split = 'train') AS VARCHAR) AS current
  FROM evt WHERE class_label <> 'click' GROUP BY 1 HAVING count(*) <> count(*) FILTER (original_split = 'train')""",
    "snapshot_digest": with_(light()) + sealed(snapshot_rows()),
    "rowset_digest": with_(light(), """js AS (SELECT j, count(*) AS n FROM (SELECT '{"class_label":"' || class_label || '","original_split":"' || original_split || '","rgb_sha256":"' || rgb_sha256 || '","sample_id":"' || sample_id || '"}' AS j FROM docs) GROUP BY j)""")
    + sealed("SELECT substr(sha256(j), 1, 12) AS bucket, j || '*' || n || chr(10) AS line FROM js"),
    "snapshot_agreement": with_(light(), f"sa AS ({sealed(snapshot_rows())})", f"sb AS ({sealed(snapshot_rows('rgb_sha256'))})")
    + f"SELECT {big('count(DISTINCT digest)', 'snapshots')}, {big('count(*)', 'audits')} FROM (SELECT digest FROM sa UNION ALL SELECT digest FROM sa UNION ALL SELECT digest FROM sb)",
}

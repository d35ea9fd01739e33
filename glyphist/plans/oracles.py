"""DuckDB statements that compute the registered queries independently.

They follow the definitions step by step (every distance, every full histogram, every
threshold) instead of the way the Spark jobs take.
"""

from __future__ import annotations

from glyphist.plans.registry import (
    CLASS_THRESHOLDS,
    EMBEDDING_WORDS,
    END_TO_END,
    EVENT_TYPES,
    EVENT_WORDS,
    FILE_CODEBOOK,
    FILE_SETTINGS,
    LINE_ITEM_WORDS,
    LINE_WORDS,
    SCORE_THRESHOLD,
    Settings,
)


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


# Descriptors: (rid, id, pos, x) -------------------------------------------------------


def descriptor_cte(source: str) -> str:
    return f"d AS MATERIALIZED (SELECT row_number() OVER () AS rid, id, pos, x FROM ({source}))"


EMBEDDING = """SELECT vec_id AS id, i AS pos, CAST(list_slice(embedding, i * 8 + 1, i * 8 + 8) AS DOUBLE[]) AS x
  FROM embeddings, range(0, 8) AS t(i)"""
LINE_ITEM = """SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS pos,
  [l_quantity / 50, l_discount * 10, l_tax * 12.5::DOUBLE, l_extendedprice / 105000] AS x FROM lineitem"""
LINES = r"""SELECT id, pos, [vowels, consonants, capitals, digits, blanks,
    length(line) - vowels - consonants - capitals - digits - blanks]::DOUBLE[] AS x
  FROM (SELECT id, pos, line,
      length(regexp_replace(line, '[^aeiou]', '', 'gs')) AS vowels,
      length(regexp_replace(line, '[^bcdfghjklmnpqrstvwxyz]', '', 'gs')) AS consonants,
      length(regexp_replace(line, '[^A-Z]', '', 'gs')) AS capitals,
      length(regexp_replace(line, '[^0-9]', '', 'gs')) AS digits,
      length(regexp_replace(line, '[^ ]', '', 'gs')) AS blanks
    FROM (SELECT doc_id AS id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"""
_one_hot = ", ".join(f"CASE WHEN event_type = '{t}' THEN 1.0 ELSE 0.0 END" for t in EVENT_TYPES)
EVENTS = f"""SELECT user_id AS id, event_id AS pos, [value, hour(ts), {_one_hot}]::DOUBLE[] AS x FROM events"""

DIMS = {EMBEDDING: 8, LINE_ITEM: 4, LINES: 6, EVENTS: 2 + len(EVENT_TYPES)}


def flat(source: str) -> str:
    columns = ", ".join(f"x[{j + 1}] AS f{j}" for j in range(DIMS[source]))
    return f"SELECT id, pos, {columns} FROM ({source})"


# Codebooks: (word, c) and assignments: (rid, id, pos, x, word, dist) --------------------


def first_codebook(name: str, k: int, source: str = "d") -> str:
    return f"""{name} AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY id, pos, x) - 1 AS INTEGER) AS word, x AS c
  FROM {source} QUALIFY row_number() OVER (ORDER BY id, pos, x) <= {k})"""


def assign_cte(name: str, codebook: str, dim: int, source: str = "d") -> str:
    distance = " + ".join(f"(x[{j}] - c[{j}]) * (x[{j}] - c[{j}])" for j in range(1, dim + 1))
    return f"""{name} AS MATERIALIZED (SELECT s.rid, id, pos, x, m.w AS word, m.d AS dist
  FROM {source} AS s JOIN (SELECT rid, min({{'d': {distance}, 'w': word}}) AS m
    FROM {source}, {codebook} GROUP BY rid) AS best ON s.rid = best.rid)"""


def lloyd_ctes(steps: int, dim: int, source: str = "d") -> list[str]:
    """Codebooks cb1 .. cb<steps> from cb0."""
    parts = []
    means = ", ".join(f"avg(x[{j}])" for j in range(1, dim + 1))
    for t in range(1, steps + 1):
        parts.append(assign_cte(f"a{t}", f"cb{t - 1}", dim, source))
        parts.append(
            f"""cb{t} AS MATERIALIZED (SELECT o.word, coalesce(n.c, o.c) AS c FROM cb{t - 1} AS o
  LEFT JOIN (SELECT word, [{means}] AS c FROM a{t} GROUP BY word) AS n ON o.word = n.word)"""
        )
    return parts


def given(source: str, k: int) -> list[str]:
    """Descriptors, the given codebook and the assignment ``a``."""
    return [descriptor_cte(source), first_codebook("cb0", k), assign_cte("a", "cb0", DIMS[source])]


def codebook_select(name: str, digits: int | None = None) -> str:
    value = "c[j + 1]" if digits is None else f"round(c[j + 1], {digits})"
    return f"""SELECT word, CAST(j AS INTEGER) AS j, {value} AS value
  FROM {name}, LATERAL (SELECT unnest(range(0, len(c))) AS j)"""


ASSIGNED = "SELECT id, pos, word, dist FROM a"

# Histograms: (id, word, n, freq) and dense rows (id, f) ---------------------------------

COUNTS = "SELECT id, word, count(*) AS n FROM a GROUP BY id, word"
LONG = f"""SELECT id, word, n, n / CAST(sum(n) OVER (PARTITION BY id) AS DOUBLE) AS freq FROM ({COUNTS})"""


def cells_cte(k: int, entities: str = "SELECT DISTINCT id FROM a") -> str:
    return f"""cells AS MATERIALIZED (SELECT e.id, CAST(w AS INTEGER) AS word, coalesce(freq, 0.0) AS freq
  FROM ({entities}) AS e CROSS JOIN range(0, {k}) AS r(w)
  LEFT JOIN ({LONG}) AS h ON h.id = e.id AND h.word = w)"""


CELLS = "SELECT id, word, freq FROM cells"
DENSE = "dense AS MATERIALIZED (SELECT id, list(freq ORDER BY word) AS f FROM cells GROUP BY id)"

# Labels -------------------------------------------------------------------------------

ORDER_TAGS = "SELECT o_orderkey AS id, o_orderpriority AS tag FROM orders"
DOCUMENT_TAGS = "SELECT doc_id AS id, concat(lang, '/', source) AS tag FROM documents"
EMBEDDING_TAGS = "SELECT vec_id AS id, printf('%03d', label) AS tag FROM embeddings"


def label_map_sql(tags: str) -> str:
    return f"""SELECT tag, CAST(row_number() OVER (ORDER BY tag) - 1 AS DOUBLE) AS label
  FROM (SELECT DISTINCT tag FROM ({tags}))"""


ENTITY_LABELS = f"""SELECT id, t.tag, label FROM ({DOCUMENT_TAGS}) AS t LEFT JOIN (
  {label_map_sql(f"SELECT tag FROM ({DOCUMENT_TAGS}) WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)")}
) AS m ON t.tag = m.tag"""

# Training rows of the embeddings: rows(id, label, f), given weights w(class, w) ---------


def rows_cte(tags: str, name: str = "rows", label_tags: str | None = None) -> str:
    return f"""{name} AS MATERIALIZED (SELECT d.id, m.label, f FROM ({tags}) AS t
  JOIN ({label_map_sql(label_tags or tags)}) AS m ON t.tag = m.tag JOIN dense AS d ON d.id = t.id)"""


EMBEDDING_ROWS = [*given(EMBEDDING, EMBEDDING_WORDS), cells_cte(EMBEDDING_WORDS), DENSE, rows_cte(EMBEDDING_TAGS)]
CONTRAST = """w AS MATERIALIZED (SELECT label AS class, list(round(own - alle, 6) ORDER BY o.j) AS w
  FROM (SELECT label, j, avg(f[j]) AS own FROM rows, range(1, {k} + 1) AS r(j) GROUP BY label, j) AS o
  JOIN (SELECT j, avg(f[j]) AS alle FROM rows, range(1, {k} + 1) AS r(j) GROUP BY j) AS g ON o.j = g.j
  GROUP BY label)""".format(k=EMBEDDING_WORDS)


def scores_cte(weights: str, k: int, threshold: str, rows: str = "rows") -> str:
    margin = " + ".join(f"f[{j}] * w[{j}]" for j in range(1, k + 1))
    return f"""scores AS MATERIALIZED (SELECT id, class, margin,
    CASE WHEN margin > {threshold} THEN 1.0 ELSE 0.0 END::DOUBLE AS predicted,
    CASE WHEN label = class THEN 1.0 ELSE 0.0 END::DOUBLE AS actual
  FROM (SELECT id, label, class, {margin} AS margin FROM {rows}, {weights}))"""


EMBEDDING_SCORES = [*EMBEDDING_ROWS, CONTRAST, scores_cte("w", EMBEDDING_WORDS, str(SCORE_THRESHOLD))]
SCORES = "SELECT id, class, round(margin, 9) AS margin, predicted, actual FROM scores"


def descent_ctes(steps: int, k: int, classes: str, rows: str = "rows") -> list[str]:
    """Weights w1 .. w<steps> of the hinge descent, from zero."""
    parts = [f"w0 AS MATERIALIZED (SELECT label AS class, list_resize([0.0::DOUBLE], {k}, 0.0) AS w FROM ({classes}))"]
    margin = " + ".join(f"f[{j}] * w[{j}]" for j in range(1, k + 1))
    for t in range(1, steps + 1):
        parts.append(
            f"""m{t} AS MATERIALIZED (SELECT class, f, z, z * ({margin}) AS zm
  FROM (SELECT class, f, w, CASE WHEN label = class THEN 1.0::DOUBLE ELSE -1.0 END AS z FROM {rows}, w{t - 1}))"""
        )
        parts.append(
            f"""w{t} AS MATERIALIZED (SELECT o.class,
    list(w[j] * (1 - 0.01::DOUBLE / sqrt({t})) - g / sqrt({t}) ORDER BY j) AS w
  FROM w{t - 1} AS o JOIN (SELECT class, j, sum(CASE WHEN zm < 1 THEN -z * f[j] ELSE 0.0 END) / count(*) AS g
    FROM m{t}, range(1, {k} + 1) AS r(j) GROUP BY class, j) AS s ON o.class = s.class GROUP BY o.class)"""
        )
    return parts


def weights_select(name: str, digits: int | None = None) -> str:
    value = "w[j + 1]" if digits is None else f"round(w[j + 1], {digits})"
    return f"""SELECT class, CAST(j AS INTEGER) AS j, {value} AS w
  FROM {name}, LATERAL (SELECT unnest(range(0, len(w))) AS j)"""


# Evaluation ---------------------------------------------------------------------------


def confusion_sql(source: str) -> str:
    return f"""SELECT class,
  count(*) FILTER (predicted = 1 AND actual = 1) AS tp, count(*) FILTER (predicted = 0 AND actual = 0) AS tn,
  count(*) FILTER (predicted = 1 AND actual = 0) AS fp, count(*) FILTER (predicted = 0 AND actual = 1) AS fn
  FROM {source} GROUP BY class"""


def report_sql(source: str, digits: int | None = 9) -> str:
    def out(expression: str) -> str:
        return expression if digits is None else f"round({expression}, {digits})"

    return f"""SELECT class, tp, tn, fp, fn, {out('p')} AS precision, {out('r')} AS recall, {out('a')} AS accuracy,
  {out('2 * p * r / nullif(p + r, 0)')} AS fmeasure
  FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r,
    (tp + tn) / nullif(tp + tn + fp + fn, 0) AS a FROM ({confusion_sql(source)}))"""


def areas_sql(source: str, score: str) -> str:
    """Both curves over all distinct scores, by trapezoids between neighbouring points."""
    return f"""SELECT class,
    round(sum((fpr - fpr0) * (tpr + tpr0) / 2) + (1 - max(fpr)) * (max(tpr) + 1) / 2, 9) AS auroc,
    round(sum((tpr - tpr0) * (prec + prec0) / 2), 9) AS aupr
  FROM (SELECT *, lag(tpr, 1, 0) OVER o AS tpr0, lag(fpr, 1, 0) OVER o AS fpr0, lag(prec, 1, prec) OVER o AS prec0
    FROM (SELECT class, score, tp / (tp + fp) AS prec,
        coalesce(tp / nullif(sum(pos) OVER a, 0), 0) AS tpr, coalesce(fp / nullif(sum(neg) OVER a, 0), 0) AS fpr
      FROM (SELECT *, sum(pos) OVER (PARTITION BY class ORDER BY score DESC) AS tp,
          sum(neg) OVER (PARTITION BY class ORDER BY score DESC) AS fp
        FROM (SELECT class, {score} AS score, count(*) FILTER (actual = 1) AS pos,
            count(*) FILTER (actual <> 1) AS neg FROM {source} GROUP BY class, {score}))
      WINDOW a AS (PARTITION BY class))
    WINDOW o AS (PARTITION BY class ORDER BY score DESC))
  GROUP BY class"""


DOCUMENT_PREDICTIONS = """(SELECT doc_id AS id, lang AS class, quality AS predicted, toxic AS actual
  FROM documents JOIN labels USING (doc_id))"""


def percent(expression: str) -> str:
    return f"coalesce(printf('%.2f', {expression}), 'NaN')"


# The wording of the report.
REPORT_LINE = f"""' true positives: ', tp, ' true negatives: ', tn, ' false positives: ', fp,
  ' false negatives: ', fn, chr(10), 'precision:', {percent('precision * 100')}, '% recall:', {percent('recall * 100')},
  '% accuracy:', {percent('accuracy * 100')}, '% fmeasure:', {percent('fmeasure')}"""
REPORT_TEXT = f"""SELECT class, concat('Category:', class, {REPORT_LINE}) AS line
  FROM ({report_sql(DOCUMENT_PREDICTIONS, None)})"""

# Manifest -----------------------------------------------------------------------------

DOCUMENT_FILES = "SELECT concat(source, '_', printf('%08d', doc_id)) AS id FROM documents"
DOCUMENT_MANIFEST = f"""SELECT id, concat('images/', id, '.jpg') AS path, concat('metadata/', id, '.json') AS meta_path
  FROM ({DOCUMENT_FILES})"""


def split_sql(source: str, key: str) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER (ORDER BY {key}) <= floor(count(*) OVER () * 0.8::DOUBLE)
  THEN 'train' ELSE 'test' END AS split FROM ({source})"""


SPLIT_MANIFEST = split_sql(DOCUMENT_MANIFEST, "path")

# Whole run: training part only for codebook, labels and weights --------------------------



def whole_run(settings: Settings, tags: str, source: str, threshold: str | None = None) -> list[str]:
    """Scores of the test part, from the given codebook, steps and threshold."""
    k, steps, svm = settings.words, settings.codebook_iterations, settings.classifier_iterations
    dim = DIMS[source]
    return [
        f"split AS MATERIALIZED ({split_sql(tags, 'id')})",
        descriptor_cte(source),
        "dt AS MATERIALIZED (SELECT d.* FROM d JOIN split USING (id) WHERE split = 'train')",
        first_codebook("cb0", k, "dt"),
        *lloyd_ctes(steps, dim, "dt"),
        assign_cte("a", f"cb{steps}", dim),
        cells_cte(k),
        DENSE,
        rows_cte(tags, "rows", "SELECT tag FROM split WHERE split = 'train'"),
        "train AS MATERIALIZED (SELECT rows.* FROM rows JOIN split USING (id) WHERE split = 'train')",
        "test AS MATERIALIZED (SELECT rows.* FROM rows JOIN split USING (id) WHERE split = 'test')",
        f"labels AS ({label_map_sql("SELECT tag FROM split WHERE split = 'train'")})",
        *descent_ctes(svm, k, "SELECT DISTINCT label FROM train", "train"),
        scores_cte(f"w{svm}", k, threshold or str(settings.threshold), "test"),
    ]


WHOLE_RUN = whole_run(END_TO_END, ORDER_TAGS, LINE_ITEM)
FILE_LIMIT = (
    "CASE (SELECT tag FROM labels WHERE label = class) "
    + " ".join(f"WHEN '{c}' THEN {t}" for c, t in FILE_SETTINGS.category_thresholds.items())
    + f" ELSE {FILE_SETTINGS.threshold} END"
)


def facts_sql(source: str, k: int, more: str = "") -> str:
    """Numbers from all descriptors; what must be true of any trained codebook is given as true."""
    return with_(
        f"x AS MATERIALIZED (SELECT j, x[j] AS v FROM ({source}), range(1, {DIMS[source] + 1}) AS r(j))",
        "m AS (SELECT j, avg(v) AS mean FROM x GROUP BY j)",
        select=f"""SELECT {k}::INTEGER AS n_words, (SELECT count(*) FROM ({source})) AS n_descriptors,
  round(sum((v - mean) * (v - mean)), 6) AS single_cost, true AS below_first, true AS below_single, true AS settled{more}
  FROM x JOIN m USING (j)""",
    )


def run_facts_sql(tags: str, source: str, words: int) -> str:
    """Rows with a known category and a descriptor, in all and by category; what training must reach is true."""
    return with_(
        f"split AS MATERIALIZED ({split_sql(tags, 'id')})",
        f"labels AS ({label_map_sql("SELECT tag FROM split WHERE split = 'train'")})",
        f"rows AS (SELECT label, split FROM split JOIN labels USING (tag) WHERE id IN (SELECT id FROM ({source})))",
        "test AS (SELECT label FROM rows WHERE split = 'test')",
        select=f"""SELECT labels.label AS class, (SELECT count(*) FROM test) AS n_test, count(test.label) AS n_class,
  (SELECT count(*) FROM rows WHERE split = 'train') AS n_train, true AS below_zero_weights, true AS below_three_steps,
  {words} AS n_used_words
  FROM labels LEFT JOIN test ON test.label = labels.label GROUP BY labels.label""",
    )


FILE_WORDS = ", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(FILE_CODEBOOK.centroids.tolist()))

CATEGORY_LIMIT = (
    "CASE class " + " ".join(f"WHEN {c} THEN {t}" for c, t in CLASS_THRESHOLDS.items()) + f" ELSE {SCORE_THRESHOLD} END"
)

LABEL_JOIN = with_(
    *given(LINE_ITEM, LINE_ITEM_WORDS),
    select=f"""SELECT h.id, m.label, word, freq FROM ({LONG}) AS h JOIN ({ORDER_TAGS}) AS t ON h.id = t.id
  JOIN ({label_map_sql(ORDER_TAGS)}) AS m ON m.tag = t.tag""",
)

ORACLES: dict[str, str] = {
    "descriptors_embedding": flat(EMBEDDING),
    "descriptors_lineitem": flat(LINE_ITEM),
    "descriptors_lines": flat(LINES),
    "descriptors_events": flat(EVENTS),
    "descriptors_user_function": flat(LINES),
    "descriptor_dimensions": " UNION ALL ".join(
        f"""SELECT '{kind}' AS kind, count(*) AS n_rows, count(*) FILTER (x IS NULL) AS n_null,
  CAST(min(len(x)) AS INTEGER) AS min_dim, CAST(max(len(x)) AS INTEGER) AS max_dim FROM ({source})"""
        for kind, source in (("embedding", EMBEDDING), ("lineitem", LINE_ITEM), ("lines", LINES), ("events", EVENTS))
    ),
    "manifest_paths": r"""SELECT regexp_replace(regexp_replace(url, '^.*[/\\]', '', 's'), '\.[^.]*$', '') AS id,
  url AS path, replace(url, '.jpg', '.json') AS meta_path FROM pages""",
    "manifest_metadata_dir": DOCUMENT_MANIFEST,
    "train_test_split": split_sql("SELECT c_custkey FROM customer", "c_custkey"),
    "train_test_counts": f"SELECT split, count(*) AS n FROM ({SPLIT_MANIFEST}) GROUP BY split",
    "hash_split": """SELECT o_orderkey, CASE
  WHEN CAST(concat('0x', substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) < floor(0.8::DOUBLE * 4294967296)
  THEN 'train' ELSE 'test' END AS split FROM orders""",
    "path_lists_roundtrip": f"""SELECT split, 'entity' AS list, path FROM ({SPLIT_MANIFEST})
  UNION ALL SELECT split, 'metadata' AS list, meta_path AS path FROM ({SPLIT_MANIFEST})""",
    "manifest_roundtrip": SPLIT_MANIFEST,
    "first_tag": """SELECT c_custkey AS id, json_extract_string(
    concat('{"name": "', c_name, '", "tags": ["', c_mktsegment, '", "other"]}'), '$.tags[0]') AS tag FROM customer""",
    "first_tag_absent": "SELECT event_id AS id, CASE WHEN event_id % 25 = 0 THEN event_type END AS tag FROM events",
    "distinct_categories": f"SELECT DISTINCT tag FROM ({DOCUMENT_TAGS})",
    "category_labels": label_map_sql(DOCUMENT_TAGS),
    "label_of_category": f"SELECT * FROM ({label_map_sql(ORDER_TAGS)}) WHERE tag = '3-MEDIUM'",
    "entity_labels": ENTITY_LABELS,
    "entity_label_drops": f"""SELECT count(*) FILTER (tag IS NULL) AS n_no_tag,
  count(*) FILTER (tag IS NOT NULL AND label IS NULL) AS n_unknown_tag, count(label) AS n_labelled
  FROM ({ENTITY_LABELS})""",
    "label_join": LABEL_JOIN,
    "label_join_bucketed": LABEL_JOIN,
    "label_join_repeated_ids": with_(
        *given(EVENTS, EVENT_WORDS),
        select=f"""SELECT h.id, m.label, word, freq, count(*) AS copies
  FROM ({LONG}) AS h JOIN events AS e ON h.id = e.user_id
  JOIN ({label_map_sql("SELECT event_type AS tag FROM events")}) AS m ON m.tag = e.event_type
  GROUP BY h.id, m.label, word, freq""",
    ),
    "assign_words_embedding": with_(*given(EMBEDDING, EMBEDDING_WORDS), select=ASSIGNED),
    "assign_words_lineitem": with_(*given(LINE_ITEM, LINE_ITEM_WORDS), select=ASSIGNED),
    "codebook_centres": with_(*given(EMBEDDING, EMBEDDING_WORDS)[:2], select=codebook_select("cb0")),
    "codebook_cost_embedding": with_(
        *given(EMBEDDING, EMBEDDING_WORDS),
        select="""SELECT (SELECT CAST(count(*) AS INTEGER) FROM cb0) AS n_words, count(*) AS n_descriptors,
  round(sum(dist), 6) AS wssse FROM a""",
    ),
    "lloyd_1": with_(*given(EMBEDDING, EMBEDDING_WORDS)[:2], *lloyd_ctes(1, 8), select=codebook_select("cb1", 6)),
    "lloyd_3": with_(*given(EMBEDDING, EMBEDDING_WORDS)[:2], *lloyd_ctes(3, 8), select=codebook_select("cb3", 6)),
    "lloyd_3_lineitem": with_(
        *given(LINE_ITEM, LINE_ITEM_WORDS)[:2], *lloyd_ctes(3, 4), select=codebook_select("cb3", 6)
    ),
    "codebook_roundtrip": with_(*given(EMBEDDING, EMBEDDING_WORDS)[:2], select=codebook_select("cb0")),
    "word_counts_embedding": with_(*given(EMBEDDING, EMBEDDING_WORDS), select=COUNTS),
    "word_counts_lineitem": with_(*given(LINE_ITEM, LINE_ITEM_WORDS), select=COUNTS),
    "histogram_long_embedding": with_(*given(EMBEDDING, EMBEDDING_WORDS), select=LONG),
    "histogram_long_lineitem": with_(*given(LINE_ITEM, LINE_ITEM_WORDS), select=LONG),
    "histogram_long_lines": with_(*given(LINES, LINE_WORDS), select=LONG),
    "histogram_long_events": with_(*given(EVENTS, EVENT_WORDS), select=LONG),
    "histogram_sparse_lineitem": with_(*given(LINE_ITEM, LINE_ITEM_WORDS), select=f"SELECT id, word, freq FROM ({LONG})"),
    "histogram_dense_embedding": with_(
        *given(EMBEDDING, EMBEDDING_WORDS), cells_cte(EMBEDDING_WORDS), select=CELLS
    ),
    "histogram_dense_lineitem": with_(*given(LINE_ITEM, LINE_ITEM_WORDS), cells_cte(LINE_ITEM_WORDS), select=CELLS),
    "histogram_with_empty": with_(
        *given(LINE_ITEM, LINE_ITEM_WORDS),
        cells_cte(LINE_ITEM_WORDS, "SELECT o_orderkey AS id FROM orders"),
        select=CELLS,
    ),
    "libsvm_lines": with_(
        *EMBEDDING_ROWS,
        select=f"""SELECT concat(CAST(label AS VARCHAR), ' ', cells, ' ') AS value
  FROM rows JOIN (SELECT id, string_agg(concat(j, ':', printf('%.5f', f[j])), ' ' ORDER BY j) AS cells
    FROM dense, range(1, {EMBEDDING_WORDS} + 1) AS r(j) GROUP BY id) USING (id)""",
    ),
    "libsvm_roundtrip": with_(
        *EMBEDDING_ROWS,
        select=f"""SELECT label, (j - 1)::INTEGER AS word, printf('%.5f', f[j])::DOUBLE AS freq, count(*) AS n
  FROM rows, range(1, {EMBEDDING_WORDS + 1}) AS r(j) GROUP BY ALL""",
    ),
    "dense_vector_roundtrip": flat(EMBEDDING),
    "svm_train": with_(
        *EMBEDDING_ROWS,
        select="""SELECT label AS class, (SELECT count(*) FROM rows) AS n_rows, true AS below_zero_weights,
  true AS below_three_steps FROM rows GROUP BY label""",
    ),
    "kmeans_codebook": facts_sql(EMBEDDING, EMBEDDING_WORDS),
    "kmeans_lineitem": facts_sql(LINE_ITEM, 100),
    "kmeans_restarts": facts_sql(EMBEDDING, EMBEDDING_WORDS, ", 3 AS n_runs, true AS first_alone, true AS cheapest"),
    "kmeans_random_init": facts_sql(EMBEDDING, EMBEDDING_WORDS),
    "assign_words_in_blocks": with_(*given(EMBEDDING, EMBEDDING_WORDS), select=ASSIGNED),
    "report_text_scores": with_(
        *EMBEDDING_SCORES,
        select=f"""SELECT class, concat('Category:', printf('%03d', class::INTEGER), {REPORT_LINE},
    chr(10), 'Area under ROC = ', printf('%.6f', auroc), chr(10), 'Area under PR curve = ', printf('%.6f', aupr)) AS line
  FROM ({report_sql('scores', None)}) JOIN ({areas_sql('scores', 'predicted')}) USING (class)""",
    ),
    "predict_from_saved": with_(
        *WHOLE_RUN,
        select=f"""SELECT r.*, auroc, aupr, tag FROM ({report_sql('scores')}) r JOIN ({areas_sql('scores', 'predicted')}) USING (class)
  JOIN ({label_map_sql("SELECT tag FROM split WHERE split = 'train'")}) m ON m.label = class""",
    ),
    "train_and_evaluate_kmeans": run_facts_sql(EMBEDDING_TAGS, EMBEDDING, EMBEDDING_WORDS),
    "train_and_evaluate_default": run_facts_sql(ORDER_TAGS, LINE_ITEM, 100),
    "entities_from_directory": """SELECT (strlen(html) + 1)::BIGINT AS length, md5(concat(html, chr(10))) AS digest, count(*) AS n
  FROM pages GROUP BY ALL""",
    "metadata_from_files": "SELECT c_mktsegment AS tag, count(*) AS n FROM customer GROUP BY ALL",
    "file_run": with_(
        descriptor_cte(LINES),
        f"cb0 AS (SELECT * FROM (VALUES {FILE_WORDS}) AS v(word, c))",
        assign_cte("a", "cb0", 6),
        select="SELECT word, count(*) AS n FROM a GROUP BY word",
    ),
    "file_report": with_(
        *whole_run(FILE_SETTINGS, DOCUMENT_TAGS, LINES, FILE_LIMIT),
        select=f"""SELECT class, concat('Category:', tag, {REPORT_LINE},
    '\nArea under ROC = ', printf('%.6f', auroc), '\nArea under PR curve = ', printf('%.6f', aupr)) AS line
  FROM ({report_sql('scores', None)}) JOIN ({areas_sql('scores', 'predicted')}) USING (class) JOIN labels ON label = class""",
    ),
    "binary_rows": with_(
        *EMBEDDING_ROWS, select="SELECT id, label, CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM rows"
    ),
    "one_vs_rest_rows": with_(
        *EMBEDDING_ROWS,
        select="""SELECT id, class, CASE WHEN label = class THEN 1.0 ELSE 0.0 END::DOUBLE AS y
  FROM rows, (SELECT DISTINCT label AS class FROM rows)""",
    ),
    "linear_score": with_(
        *EMBEDDING_SCORES, select="SELECT id, class, round(margin, 9) AS margin, actual FROM scores"
    ),
    "top_classes": with_(
        *EMBEDDING_SCORES,
        select="""SELECT id, label, rank::INTEGER AS rank, class, round(margin, 9) AS margin, predicted FROM (
            SELECT s.*, r.label, row_number() OVER (PARTITION BY id ORDER BY margin DESC, class) AS rank
            FROM scores s JOIN rows r USING (id)) WHERE rank <= 3""",
    ),
    "threshold_predict": with_(*EMBEDDING_SCORES, select=SCORES),
    "category_thresholds": with_(
        *EMBEDDING_ROWS, CONTRAST, scores_cte("w", EMBEDDING_WORDS, CATEGORY_LIMIT), select=SCORES
    ),
    "svm_descent_3": with_(
        *EMBEDDING_ROWS,
        *descent_ctes(3, EMBEDDING_WORDS, "SELECT DISTINCT label FROM rows"),
        select=weights_select("w3", 6),
    ),
    "classifier_roundtrip": with_(*EMBEDDING_ROWS, CONTRAST, select=weights_select("w")),
    "labels_roundtrip": label_map_sql(ORDER_TAGS),
    "confusion_documents": confusion_sql(DOCUMENT_PREDICTIONS),
    "confusion_scores": with_(*EMBEDDING_SCORES, select=confusion_sql("scores")),
    "class_report_documents": report_sql(DOCUMENT_PREDICTIONS),
    "class_report_scores": with_(*EMBEDDING_SCORES, select=report_sql("scores")),
    "report_text": REPORT_TEXT,
    "areas_by_label": with_(*EMBEDDING_SCORES, select=areas_sql("scores", "predicted")),
    "areas_by_margin": with_(*EMBEDDING_SCORES, select=areas_sql("scores", "margin")),
    "run_metrics": with_(
        *given(EMBEDDING, EMBEDDING_WORDS),
        f"s AS (SELECT split, count(*) AS n FROM ({split_sql(EMBEDDING_TAGS, 'id')}) GROUP BY split)",
        select="""SELECT 'split' AS stage, concat(split, '_entities') AS metric, CAST(n AS DOUBLE) AS value FROM s
  UNION ALL SELECT 'codebook', 'words', count(*)::DOUBLE FROM cb0
  UNION ALL SELECT 'descriptors', 'rows', count(*)::DOUBLE FROM d
  UNION ALL SELECT 'histograms', 'rows', count(DISTINCT id)::DOUBLE FROM a""",
    ),
    "train_and_evaluate": with_(
        *WHOLE_RUN,
        select=f"""SELECT * FROM ({report_sql('scores')}) JOIN ({areas_sql('scores', 'predicted')}) USING (class)""",
    ),
}

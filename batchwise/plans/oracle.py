"""DuckDB SQL for the correctness gate.

Each builder returns one SQL string over the driver's pre-registered views
(``documents``, ``labels``, ``embeddings``).  The SQL is an independent,
plain-relational statement of the same semantics (cross joins and window
functions are fine here: DuckDB runs it once at sf0.01 on one machine).
Column names and types match the Spark queries exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..fixed import REFERENCE_PLANS, TOKEN_PATTERN as TOKEN_RE
from ..functions.stopwords import stopword_set
from ..functions.text import DEFAULT_N_FEATURES


def sql_list(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _clean(col: str, stop: str) -> str:
    return (f"array_to_string(list_filter(string_split_regex(coalesce({col}, ''), '\\s+'), "
            f"lambda w: w <> '' AND lower(w) NOT IN ({stop})), ' ')")


def email_source(task: str = "language") -> str:
    if task == "language":
        return ("SELECT doc_id AS row_id, source AS feature0, text AS feature1, "
                "CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS feature2 FROM documents")
    if task == "lang":
        return "SELECT doc_id AS row_id, source AS feature0, text AS feature1, lang AS feature2 FROM documents"
    if task in ("quality", "toxic"):
        return (f"SELECT d.doc_id AS row_id, d.source AS feature0, d.text AS feature1, "
                f"CAST(l.{task} AS VARCHAR) AS feature2 FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    raise ValueError(task)


def schedule_ctes(source: str, n_batches: int = 8, n_train: int = 6, n_total: int = 8,
                  batch_size: int | None = None) -> str:
    """CTEs emails, dict, sched (row_id, feature0-2, label, batch_no, cycle, phase)."""
    size = f"ceil(n_rows / {float(n_batches)})" if batch_size is None else f"{float(batch_size)}"
    return f"""
emails AS ({source}),
dict AS (
  SELECT feature2, CAST(row_number() OVER (ORDER BY feature2) - 1 AS INTEGER) AS label
  FROM (SELECT DISTINCT feature2 FROM emails WHERE feature2 IS NOT NULL) d),
numbered AS (
  SELECT e.*, d.label, row_number() OVER (ORDER BY e.row_id) AS ord, count(*) OVER () AS n_rows
  FROM emails e LEFT JOIN dict d ON e.feature2 = d.feature2),
batched AS (
  SELECT *, CAST(floor((ord - 1) / {size}) AS INTEGER) + 1 AS batch_no FROM numbered),
sched AS (
  SELECT *, CASE WHEN (batch_no - 1) % {n_total} < {n_train} THEN 'train' ELSE 'test' END AS phase,
         CAST(floor((batch_no - 1) / {n_total}) AS INTEGER) + 1 AS cycle
  FROM batched)"""


def feature_ctes(source: str, n_features: int = DEFAULT_N_FEATURES, n_batches: int = 8, n_train: int = 6,
                 n_total: int = 8, stopwords: Sequence[str] | None = None, batch_size: int | None = None) -> str:
    """Adds cleaned, toks, feat, norms, rows_t, xl."""
    stop = sql_list(stopword_set() if stopwords is None else stopwords)
    return schedule_ctes(source, n_batches, n_train, n_total, batch_size) + f""",
cleaned AS (
  SELECT row_id, batch_no, cycle, phase, label,
         {_clean('feature0', stop)} AS c0,
         {_clean('feature1', stop)} AS c1
  FROM sched),
toks AS (
  SELECT row_id, unnest(regexp_extract_all(lower(c0 || ' ' || c1), '{TOKEN_RE}')) AS tok FROM cleaned),
feat AS (
  SELECT row_id, CAST((('0x' || substr(md5(tok), 1, 8))::BIGINT % {n_features}) AS INTEGER) AS bucket,
         count(*) AS cnt
  FROM toks GROUP BY row_id, bucket),
norms AS (
  SELECT row_id, sum(cnt) AS n_tokens, count(*) AS nnz, sqrt(sum(cnt * cnt)) AS norm FROM feat GROUP BY row_id),
rows_t AS (
  SELECT c.row_id, c.batch_no, c.cycle, c.phase, c.label,
         coalesce(n.n_tokens, 0) AS n_tokens, coalesce(n.nnz, 0) AS nnz,
         coalesce(n.norm, 0.0) AS norm, coalesce(n.n_tokens / n.norm, 0.0) AS sum_x,
         CASE WHEN coalesce(n.nnz, 0) > 0 THEN 1.0 ELSE 0.0 END AS sq_x
  FROM cleaned c LEFT JOIN norms n ON c.row_id = n.row_id),
xl AS (
  SELECT r.row_id, r.batch_no, r.cycle, r.phase, r.label, f.bucket, f.cnt / r.norm AS x
  FROM feat f JOIN rows_t r ON f.row_id = r.row_id)"""


def nb_state_ctes(alpha: float = 1.0, n_features: int = DEFAULT_N_FEATURES) -> str:
    """Training state per test cycle (everything trained in cycles <= it)."""
    a = float(alpha)
    return f""",
test_cycles AS (SELECT DISTINCT cycle FROM rows_t WHERE phase = 'test'),
stats AS (
  SELECT tc.cycle, x.label, x.bucket, sum(x.x) AS sum_x, count(*) AS n_present
  FROM xl x JOIN test_cycles tc ON x.cycle <= tc.cycle
  WHERE x.phase = 'train' GROUP BY tc.cycle, x.label, x.bucket),
docs AS (
  SELECT tc.cycle, r.label, count(*) AS n_docs
  FROM rows_t r JOIN test_cycles tc ON r.cycle <= tc.cycle
  WHERE r.phase = 'train' GROUP BY tc.cycle, r.label),
cls AS (
  SELECT d.cycle, d.label, d.n_docs,
         ln(d.n_docs / sum(d.n_docs) OVER (PARTITION BY d.cycle)) AS lp,
         coalesce(s.total_x, 0.0) AS total_x, coalesce(s.seen, 0) AS seen, coalesce(s.log1m, 0.0) AS log1m
  FROM docs d LEFT JOIN (
    SELECT st.cycle, st.label, sum(st.sum_x) AS total_x, count(*) AS seen,
           sum(ln(1 - (st.n_present + {a}) / (dd.n_docs + 2 * {a}))) AS log1m
    FROM stats st JOIN docs dd ON st.cycle = dd.cycle AND st.label = dd.label
    GROUP BY st.cycle, st.label) s ON d.cycle = s.cycle AND d.label = s.label),
test_rows AS (SELECT * FROM rows_t WHERE phase = 'test'),
test_xl AS (SELECT * FROM xl WHERE phase = 'test')"""


def mnb_score_ctes(alpha: float = 1.0, n_features: int = DEFAULT_N_FEATURES, name: str = "scores") -> str:
    a = float(alpha)
    return f""",
mnb_dot AS (
  SELECT x.row_id, s.label, sum(x.x * (ln(s.sum_x + {a}) - ln({a}))) AS dot
  FROM test_xl x JOIN stats s ON x.bucket = s.bucket AND x.cycle = s.cycle
  GROUP BY x.row_id, s.label),
{name} AS (
  SELECT t.row_id, t.batch_no, t.cycle, t.label AS actual, c.label AS cls,
         c.lp + t.sum_x * (ln({a}) - ln(c.total_x + {a} * {n_features})) + coalesce(k.dot, 0.0) AS score
  FROM test_rows t JOIN cls c ON t.cycle = c.cycle
  LEFT JOIN mnb_dot k ON k.row_id = t.row_id AND k.label = c.label)"""


def bnb_score_ctes(alpha: float = 1.0, n_features: int = DEFAULT_N_FEATURES, name: str = "scores") -> str:
    a = float(alpha)
    return f""",
bnb_dot AS (
  SELECT x.row_id, s.label,
         sum(ln((s.n_present + {a}) / (d.n_docs - s.n_present + {a})) - ln({a} / (d.n_docs + {a}))) AS dot
  FROM test_xl x JOIN stats s ON x.bucket = s.bucket AND x.cycle = s.cycle
  JOIN docs d ON d.cycle = s.cycle AND d.label = s.label
  GROUP BY x.row_id, s.label),
{name} AS (
  SELECT t.row_id, t.batch_no, t.cycle, t.label AS actual, c.label AS cls,
         c.lp + c.log1m + ({n_features} - c.seen) * ln(1 - {a} / (c.n_docs + 2 * {a}))
         + t.nnz * ln({a} / (c.n_docs + {a})) + coalesce(k.dot, 0.0) AS score
  FROM test_rows t JOIN cls c ON t.cycle = c.cycle
  LEFT JOIN bnb_dot k ON k.row_id = t.row_id AND k.label = c.label)"""


def pred_cte(scores: str = "scores", name: str = "pred") -> str:
    return f""",
{name} AS (
  SELECT row_id, batch_no, cycle, actual, cls AS predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cls ASC) AS rk FROM {scores}) r
  WHERE rk = 1)"""


PRED_CTE = pred_cte()


def metrics_select(model: str, pred: str = "pred") -> str:
    return f"""
SELECT cycle, batch_no, '{model}' AS model, tp, fp, fn, tn,
       CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall
FROM (
  SELECT cycle, batch_no,
         CAST(sum(CASE WHEN actual = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN actual <> 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN actual = 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN actual <> 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM {pred} GROUP BY cycle, batch_no) m"""


def nb_metrics_sql(model: str = "multinomial_nb", task: str = "language", n_features: int = DEFAULT_N_FEATURES,
                   alpha: float = 1.0, n_train: int = 6, n_total: int = 8, batch_size: int | None = None) -> str:
    score = mnb_score_ctes if model == "multinomial_nb" else bnb_score_ctes
    features = feature_ctes(email_source(task), n_features, 8, n_train, n_total, batch_size=batch_size)
    return ("WITH " + features.lstrip() + nb_state_ctes(alpha, n_features)
            + score(alpha, n_features) + PRED_CTE + metrics_select(model))


def nb_scores_sql(model: str = "multinomial_nb", task: str = "language", n_features: int = DEFAULT_N_FEATURES,
                  alpha: float = 1.0) -> str:
    score = mnb_score_ctes if model == "multinomial_nb" else bnb_score_ctes
    return ("WITH " + feature_ctes(email_source(task), n_features).lstrip() + nb_state_ctes(alpha, n_features)
            + score(alpha, n_features)
            + "\nSELECT row_id, batch_no, cls AS label, round(score, 6) AS score FROM scores")


# --------------------------------------------------------------------------- schedules

def train_test_batches(n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> tuple[list[int], list[int]]:
    train = [b for b in range(1, n_batches + 1) if (b - 1) % n_total < n_train]
    test = [b for b in range(1, n_batches + 1) if (b - 1) % n_total >= n_train]
    return train, test


def _last_step_before(train: list[int], b: int) -> int:
    return sum(1 for t in train if t < b)


# --------------------------------------------------------------------------- linear model chain

def linear_chain_ctes(train: list[int], lam: float = 1e-4, decay: float = 0.01) -> str:
    parts = [""",
rows_y AS (SELECT *, CAST(2 * label - 1 AS DOUBLE) AS y FROM rows_t),
w0 AS (SELECT CAST(NULL AS INTEGER) AS bucket, CAST(NULL AS DOUBLE) AS w WHERE false),
b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b)"""]
    for t, bn in enumerate(train, 1):
        eta = 1.0 / (lam * (t + 1))
        shrink = 1.0 - eta * lam
        parts.append(f""",
d{t} AS (SELECT x.row_id, sum(x.x * w.w) AS dot FROM xl x JOIN w{t - 1} w ON x.bucket = w.bucket
        WHERE x.batch_no = {bn} GROUP BY x.row_id),
m{t} AS (SELECT r.row_id, r.y, r.y * (coalesce(d.dot, 0.0) + (SELECT b FROM b{t - 1})) AS margin
        FROM rows_y r LEFT JOIN d{t} d ON r.row_id = d.row_id WHERE r.batch_no = {bn}),
g{t} AS (SELECT x.bucket, sum(m.y * x.x) AS g FROM xl x JOIN m{t} m ON x.row_id = m.row_id
        WHERE m.margin < 1 GROUP BY x.bucket),
w{t} AS (SELECT bucket, sum(w) AS w FROM (
          SELECT bucket, w * {shrink!r} AS w FROM w{t - 1}
          UNION ALL SELECT bucket, g * ({eta!r} / (SELECT count(*) FROM m{t})) AS w FROM g{t}) u
        GROUP BY bucket),
b{t} AS (SELECT (SELECT b FROM b{t - 1}) + {decay!r} * ({eta!r} / (SELECT count(*) FROM m{t}))
               * coalesce((SELECT sum(y) FROM m{t} WHERE margin < 1), 0.0) AS b)""")
    return "".join(parts)


def linear_pred_ctes(train: list[int], test: list[int], name: str = "pred") -> str:
    selects = []
    for bn in test:
        t = _last_step_before(train, bn)
        selects.append(f"""
  SELECT r.row_id, r.batch_no, r.cycle, r.label AS actual,
         coalesce(d.dot, 0.0) + (SELECT b FROM b{t}) AS score
  FROM rows_t r LEFT JOIN (
    SELECT x.row_id, sum(x.x * w.w) AS dot FROM xl x JOIN w{t} w ON x.bucket = w.bucket
    WHERE x.batch_no = {bn} GROUP BY x.row_id) d ON d.row_id = r.row_id
  WHERE r.batch_no = {bn}""")
    return (",\nlscore AS (" + "\n  UNION ALL".join(selects) + "),\n"
            f"{name} AS (SELECT row_id, batch_no, cycle, actual, CASE WHEN score > 0 THEN 1 ELSE 0 END AS predicted,"
            " score FROM lscore)")


def linear_metrics_sql(task: str = "language", n_features: int = DEFAULT_N_FEATURES, n_batches: int = 8,
                       n_train: int = 6, n_total: int = 8, lam: float = 1e-4) -> str:
    train, test = train_test_batches(n_batches, n_train, n_total)
    return ("WITH " + feature_ctes(email_source(task), n_features, n_batches, n_train, n_total).lstrip()
            + linear_chain_ctes(train, lam) + linear_pred_ctes(train, test) + metrics_select("linear_sgd"))


def linear_scores_sql(task: str = "language", n_features: int = DEFAULT_N_FEATURES, n_batches: int = 8,
                      n_train: int = 6, n_total: int = 8, lam: float = 1e-4) -> str:
    train, test = train_test_batches(n_batches, n_train, n_total)
    return ("WITH " + feature_ctes(email_source(task), n_features, n_batches, n_train, n_total).lstrip()
            + linear_chain_ctes(train, lam) + linear_pred_ctes(train, test)
            + "\nSELECT row_id, batch_no, predicted, round(score, 6) AS score FROM pred")


# --------------------------------------------------------------------------- k-means chain

def embedding_ctes(n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> str:
    """rows_t / xl for the dense embeddings (bucket = array position, x = value)."""
    return f"""
numbered AS (
  SELECT vec_id AS row_id, embedding, label, row_number() OVER (ORDER BY vec_id) AS ord,
         count(*) OVER () AS n_rows FROM embeddings),
batched AS (
  SELECT *, CAST(floor((ord - 1) / ceil(n_rows / {float(n_batches)})) AS INTEGER) + 1 AS batch_no FROM numbered),
rows_t AS (
  SELECT row_id, batch_no, CAST(floor((batch_no - 1) / {n_total}) AS INTEGER) + 1 AS cycle,
         CASE WHEN (batch_no - 1) % {n_total} < {n_train} THEN 'train' ELSE 'test' END AS phase,
         CAST(label AS INTEGER) AS label, len(embedding) AS nnz,
         list_reduce(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)),
                     lambda a, b: a + b) AS sq_x
  FROM batched),
xl AS (
  SELECT r.row_id, r.batch_no, r.cycle, r.phase, r.label, e.bucket, e.x
  FROM rows_t r JOIN (
    SELECT vec_id AS row_id, CAST(unnest(generate_series(0, len(embedding) - 1)) AS INTEGER) AS bucket,
           CAST(unnest(embedding) AS DOUBLE) AS x
    FROM embeddings) e ON e.row_id = r.row_id)"""


def _assign_sql(centers: str, norms: str, bn: int) -> str:
    d2 = "round(r.sq_x - 2 * coalesce(d.dot, 0.0) + cn.cn, 9)"
    return f"""(
  SELECT row_id, batch_no, cycle, label, sq_x, cluster, d2 FROM (
    SELECT r.row_id, r.batch_no, r.cycle, r.label, r.sq_x, k.cluster, {d2} AS d2,
           row_number() OVER (PARTITION BY r.row_id ORDER BY {d2}, k.cluster) AS rk
    FROM rows_t r CROSS JOIN clusters k
    JOIN {norms} cn ON cn.cluster = k.cluster
    LEFT JOIN (SELECT x.row_id, c.cluster, sum(x.x * c.c) AS dot FROM xl x JOIN {centers} c ON x.bucket = c.bucket
               WHERE x.batch_no = {bn} GROUP BY x.row_id, c.cluster) d
      ON d.row_id = r.row_id AND d.cluster = k.cluster
    WHERE r.batch_no = {bn}) z
  WHERE rk = 1)"""


def _norms_sql(centers: str) -> str:
    return (f"(SELECT k.cluster, coalesce(sum(c.c * c.c), 0.0) AS cn FROM clusters k "
            f"LEFT JOIN {centers} c ON c.cluster = k.cluster GROUP BY k.cluster)")


def _silhouette_sql(t: int) -> str:
    return f""",
sz{t} AS (SELECT cluster, count(*) AS size, sum(sq_x) AS q FROM l{t} GROUP BY cluster),
cs{t} AS (SELECT l.cluster, x.bucket, sum(x.x) AS s FROM l{t} l JOIN xl x ON x.row_id = l.row_id
         GROUP BY l.cluster, x.bucket),
sd{t} AS (SELECT x.row_id, cs.cluster, sum(x.x * cs.s) AS dot FROM xl x JOIN l{t} l ON l.row_id = x.row_id
         JOIN cs{t} cs ON cs.bucket = x.bucket GROUP BY x.row_id, cs.cluster),
st{t} AS (SELECT l.row_id, l.batch_no, l.cluster AS own, sz.cluster, sz.size,
                sz.size * l.sq_x - 2 * coalesce(sd.dot, 0.0) + sz.q AS tot
         FROM l{t} l CROSS JOIN sz{t} sz LEFT JOIN sd{t} sd ON sd.row_id = l.row_id AND sd.cluster = sz.cluster),
si{t} AS (SELECT row_id, batch_no, own AS cluster,
                CASE WHEN b IS NULL THEN NULL WHEN own_size <= 1 THEN 0.0
                     WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s
         FROM (SELECT row_id, batch_no, own,
                      max(CASE WHEN cluster = own THEN size END) AS own_size,
                      max(CASE WHEN cluster = own AND size > 1 THEN tot / (size - 1) END) AS a,
                      min(CASE WHEN cluster <> own AND size > 0 THEN tot / size END) AS b
               FROM st{t} GROUP BY row_id, batch_no, own) q)"""


def _first_rows_sql(first: int, k: int) -> str:
    return f""",
init_rows AS (
  SELECT * FROM (SELECT row_id, CAST(row_number() OVER (ORDER BY row_id) - 1 AS INTEGER) AS cluster
                 FROM rows_t WHERE batch_no = {first}) i WHERE cluster < {k})"""


def _unit_sql(salt: int | str, seed: int = 42) -> str:
    """A number in (0, 1) for each row r, from the MD5 of seed, salt and id."""
    digits = f"substr(md5('{seed}|{salt}|' || CAST(r.row_id AS VARCHAR)), 1, 13)"
    return f"((CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 52)!r})"


def _plusplus_rows_sql(first: int, k: int, seed: int = 42) -> str:
    """k-means++ by an exponential race on MD5 numbers: g{j} is the row of center j, e{j} the least distances so far."""
    def unit(j: int) -> str:
        return _unit_sql(j, seed)

    parts = [f""",
g0 AS (SELECT r.row_id FROM rows_t r WHERE r.batch_no = {first} ORDER BY {unit(0)}, r.row_id LIMIT 1)"""]
    for j in range(1, k):
        d2 = "round(r.sq_x - 2 * coalesce(d.dot, 0.0) + cn.cn, 9)"
        least = d2 if j == 1 else f"least(e.d2, {d2})"
        before = "" if j == 1 else f"JOIN e{j - 1} e ON e.row_id = r.row_id"
        parts.append(f""",
e{j} AS MATERIALIZED (
  SELECT r.row_id, {least} AS d2 FROM rows_t r {before}
  CROSS JOIN (SELECT sum(x.x * x.x) AS cn FROM xl x JOIN g{j - 1} g ON g.row_id = x.row_id) cn
  LEFT JOIN (SELECT x.row_id, sum(x.x * c.x) AS dot FROM xl x
             JOIN (SELECT y.bucket, y.x FROM xl y JOIN g{j - 1} g ON g.row_id = y.row_id) c ON c.bucket = x.bucket
             WHERE x.batch_no = {first} GROUP BY x.row_id) d ON d.row_id = r.row_id
  WHERE r.batch_no = {first}),
g{j} AS MATERIALIZED (SELECT r.row_id FROM e{j} r WHERE r.d2 > 0 ORDER BY -ln({unit(j)}) / r.d2, r.row_id LIMIT 1)""")
    chosen = " UNION ALL ".join(f"SELECT row_id, CAST({j} AS INTEGER) AS cluster FROM g{j}" for j in range(k))
    return "".join(parts) + f",\ninit_rows AS ({chosen})"


def _parallel_rows_sql(first: int, k: int, rounds: int = 5, oversample: float = 2.0) -> str:
    """k-means||: h{r} are the candidates of round r, t{r} each row with its nearest so far, g{j} the chosen ones."""
    def near(r: int) -> str:
        return f"""
  SELECT r.row_id, h.row_id AS cand, round(r.sq_x + o.sq_x - 2 * coalesce(d.dot, 0.0), 9) AS d2
  FROM rows_t r CROSS JOIN h{r} h JOIN rows_t o ON o.row_id = h.row_id
  LEFT JOIN (SELECT x.row_id, c.row_id AS cand, sum(x.x * c.x) AS dot
             FROM xl x JOIN xl c ON c.bucket = x.bucket JOIN h{r} h ON h.row_id = c.row_id
             WHERE x.batch_no = {first} GROUP BY x.row_id, c.row_id) d ON d.row_id = r.row_id AND d.cand = h.row_id
  WHERE r.batch_no = {first}"""

    parts = [f""",
h0 AS MATERIALIZED (SELECT r.row_id FROM rows_t r WHERE r.batch_no = {first} ORDER BY {_unit_sql("p0")}, r.row_id LIMIT 1),
t0 AS MATERIALIZED ({near(0)})"""]
    for r in range(1, rounds + 1):
        parts.append(f""",
h{r} AS MATERIALIZED (
  SELECT r.row_id FROM t{r - 1} r CROSS JOIN (SELECT sum(d2) AS phi FROM t{r - 1}) p
  WHERE r.d2 > 0 AND {_unit_sql(f"p{r}")} * p.phi < {oversample * k!r} * r.d2),
t{r} AS MATERIALIZED (
  SELECT row_id, cand, d2 FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, cand) AS rk
    FROM (SELECT * FROM t{r - 1} UNION ALL {near(r)}) u) z WHERE rk = 1)""")
    parts.append(f""",
wt AS MATERIALIZED (SELECT cand AS row_id, count(*) AS w FROM t{rounds} GROUP BY cand),
g0 AS MATERIALIZED (SELECT r.row_id FROM wt r ORDER BY -ln({_unit_sql("w0")}) / r.w, r.row_id LIMIT 1)""")
    for j in range(1, k):
        d2 = "round(a.sq_x + b.sq_x - 2 * coalesce(d.dot, 0.0), 9)"
        least = d2 if j == 1 else f"least(e.d2, {d2})"
        before = "" if j == 1 else f"JOIN e{j - 1} e ON e.row_id = r.row_id"
        parts.append(f""",
e{j} AS MATERIALIZED (
  SELECT r.row_id, r.w, {least} AS d2
  FROM wt r JOIN rows_t a ON a.row_id = r.row_id CROSS JOIN g{j - 1} g JOIN rows_t b ON b.row_id = g.row_id {before}
  LEFT JOIN (SELECT x.row_id, sum(x.x * c.x) AS dot
             FROM xl x JOIN xl c ON c.bucket = x.bucket JOIN g{j - 1} n ON n.row_id = c.row_id
             GROUP BY x.row_id) d ON d.row_id = r.row_id),
g{j} AS MATERIALIZED (
  SELECT r.row_id FROM e{j} r WHERE r.d2 > 0 ORDER BY -ln({_unit_sql(f"w{j}")}) / (r.w * r.d2), r.row_id LIMIT 1)""")
    chosen = " UNION ALL ".join(f"SELECT row_id, CAST({j} AS INTEGER) AS cluster FROM g{j}" for j in range(k))
    return "".join(parts) + f",\ninit_rows AS ({chosen})"


def _reseed_sql(t: int, ratio: float) -> str:
    """c{t}, n{t} from the moved centers and counts w{t}c, w{t}n: tiny clusters replaced by rows of the batch."""
    return f""",
y{t} AS (SELECT cluster, n < {ratio!r} * (SELECT max(n) FROM w{t}n) AS tiny, n FROM w{t}n),
p{t} AS MATERIALIZED (
  SELECT z.cluster, r.row_id
  FROM (SELECT cluster, row_number() OVER (ORDER BY n, cluster) AS place FROM y{t} WHERE tiny) z
  JOIN (SELECT r.row_id, row_number() OVER (ORDER BY -ln({_unit_sql(f"r{t}")}) / r.d2, r.row_id) AS place
        FROM a{t} r WHERE r.d2 > 0) r ON r.place = z.place
  WHERE z.place <= (SELECT count(*) // 2 FROM a{t})),
c{t} AS (SELECT cluster, bucket, c FROM w{t}c WHERE cluster NOT IN (SELECT cluster FROM p{t})
         UNION ALL SELECT p.cluster, x.bucket, x.x AS c FROM p{t} p JOIN xl x ON x.row_id = p.row_id),
n{t} AS (SELECT y.cluster, CASE WHEN y.cluster IN (SELECT cluster FROM p{t})
                               THEN (SELECT min(n) FROM y{t} WHERE NOT tiny) ELSE y.n END AS n FROM y{t} y)"""


def kmeans_chain_ctes(train: list[int], k: int, silhouettes: bool = True, init: str = "first",
                      reseed: float = 0.0) -> str:
    starts = {"first": _first_rows_sql, "kmeans++": _plusplus_rows_sql, "kmeans||": _parallel_rows_sql}
    start = starts[init](train[0], k)
    parts = [f""",
clusters AS (SELECT CAST(range AS INTEGER) AS cluster FROM range({k})){start},
c0 AS (SELECT i.cluster, x.bucket, x.x AS c FROM init_rows i JOIN xl x ON x.row_id = i.row_id),
n0 AS (SELECT cluster, CAST(0.0 AS DOUBLE) AS n FROM clusters)"""]
    for t, bn in enumerate(train, 1):
        moved, counted = (f"w{t}c", f"w{t}n") if reseed else (f"c{t}", f"n{t}")
        parts.append(f""",
a{t} AS {_assign_sql(f"c{t - 1}", _norms_sql(f"c{t - 1}"), bn)},
m{t} AS (SELECT k.cluster, count(a.row_id) AS m FROM clusters k LEFT JOIN a{t} a ON a.cluster = k.cluster
        GROUP BY k.cluster),
s{t} AS (SELECT a.cluster, x.bucket, sum(x.x) AS s FROM a{t} a JOIN xl x ON x.row_id = a.row_id
        GROUP BY a.cluster, x.bucket),
{moved} AS (SELECT cluster, bucket, sum(v) AS c FROM (
          SELECT c.cluster, c.bucket, c.c * (CASE WHEN m.m = 0 THEN 1.0 ELSE n.n / (n.n + m.m) END) AS v
          FROM c{t - 1} c JOIN n{t - 1} n ON n.cluster = c.cluster JOIN m{t} m ON m.cluster = c.cluster
          UNION ALL
          SELECT s.cluster, s.bucket, s.s / (n.n + m.m) AS v
          FROM s{t} s JOIN n{t - 1} n ON n.cluster = s.cluster JOIN m{t} m ON m.cluster = s.cluster) u
        GROUP BY cluster, bucket),
{counted} AS (SELECT n.cluster, n.n + m.m AS n FROM n{t - 1} n JOIN m{t} m ON m.cluster = n.cluster){_reseed_sql(t, reseed) if reseed else ""},
l{t} AS {_assign_sql(f"c{t}", _norms_sql(f"c{t}"), bn)}""")
        if silhouettes:
            parts.append(_silhouette_sql(t))
    return "".join(parts)


def _kmeans_base(dense: bool, task: str, n_features: int, n_batches: int, n_train: int, n_total: int) -> str:
    if dense:
        return "WITH " + embedding_ctes(n_batches, n_train, n_total).lstrip()
    return "WITH " + feature_ctes(email_source(task), n_features, n_batches, n_train, n_total).lstrip()


def _test_assign(train: list[int], test: list[int]) -> str:
    sel = []
    for bn in test:
        t = _last_step_before(train, bn)
        sel.append(f"SELECT * FROM {_assign_sql(f'c{t}', _norms_sql(f'c{t}'), bn)} q{bn}")
    return ",\nta AS (" + "\n  UNION ALL ".join(sel) + ")"


def kmeans_metrics_sql(k: int = 2, task: str = "language", n_features: int = DEFAULT_N_FEATURES,
                       n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> str:
    train, test = train_test_batches(n_batches, n_train, n_total)
    return (_kmeans_base(False, task, n_features, n_batches, n_train, n_total)
            + kmeans_chain_ctes(train, k, silhouettes=False) + _test_assign(train, test)
            + ",\npred AS (SELECT row_id, batch_no, cycle, label AS actual, cluster AS predicted FROM ta)"
            + metrics_select("kmeans"))


def kmeans_train_report_sql(k: int = 2, dense: bool = False, task: str = "language",
                            n_features: int = DEFAULT_N_FEATURES, n_batches: int = 8, n_train: int = 6,
                            n_total: int = 8, init: str = "first", reseed: float = 0.0) -> str:
    train, _ = train_test_batches(n_batches, n_train, n_total)
    lab = " UNION ALL ".join(f"SELECT * FROM l{t}" for t in range(1, len(train) + 1))
    sil = " UNION ALL ".join(f"SELECT * FROM si{t}" for t in range(1, len(train) + 1))
    return (_kmeans_base(dense, task, n_features, n_batches, n_train, n_total)
            + kmeans_chain_ctes(train, k, init=init, reseed=reseed) + f""",
lab AS ({lab}),
sil AS ({sil})
SELECT i.batch_no, i.n_rows, round(i.inertia, 6) AS inertia, round(s.silhouette, 6) AS silhouette
FROM (SELECT batch_no, count(*) AS n_rows, sum(d2) AS inertia FROM lab GROUP BY batch_no) i
LEFT JOIN (SELECT batch_no, avg(s) AS silhouette FROM sil GROUP BY batch_no) s ON s.batch_no = i.batch_no""")


def kmeans_assignments_sql(k: int, n_batches: int, init: str = "first") -> str:
    """Final labels of every row, all batches training, dense."""
    train = list(range(1, n_batches + 1))
    lab = " UNION ALL ".join(f"SELECT * FROM l{t}" for t in train)
    return (_kmeans_base(True, "language", DEFAULT_N_FEATURES, n_batches, n_batches, n_batches)
            + kmeans_chain_ctes(train, k, silhouettes=False, init=init)
            + f"\nSELECT row_id, batch_no, cluster, round(d2, 6) + 0.0 AS d2 FROM ({lab}) lab")


def _euclidean_ctes(train: list[int]) -> str:
    """lab and sil: silhouettes from the distance of every pair of rows of a batch."""
    lab = " UNION ALL ".join(f"SELECT * FROM l{t}" for t in range(1, len(train) + 1))
    return f""",
lab AS ({lab}),
dp AS (SELECT a.row_id AS i, b.row_id AS j, sum(a.x * b.x) AS dot
       FROM xl a JOIN xl b ON a.batch_no = b.batch_no AND a.bucket = b.bucket
       WHERE a.batch_no IN ({", ".join(map(str, train))}) GROUP BY a.row_id, b.row_id),
dist AS (SELECT a.row_id, a.batch_no, a.cluster AS own, b.cluster, count(*) AS size,
                sum(sqrt(greatest(round(a.sq_x + b.sq_x - 2 * coalesce(dp.dot, 0.0), 12), 0.0))) AS tot
         FROM lab a JOIN lab b ON a.batch_no = b.batch_no AND a.row_id <> b.row_id
         LEFT JOIN dp ON dp.i = a.row_id AND dp.j = b.row_id GROUP BY a.row_id, a.batch_no, a.cluster, b.cluster),
sil AS (SELECT row_id, batch_no, own AS cluster,
               CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0.0
                    WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s
        FROM (SELECT row_id, batch_no, own, max(CASE WHEN cluster = own THEN tot / size END) AS a,
                     min(CASE WHEN cluster <> own THEN tot / size END) AS b
              FROM dist GROUP BY row_id, batch_no, own) q)"""


def kmeans_euclidean_report_sql(k: int = 2, dense: bool = False, n_features: int = DEFAULT_N_FEATURES,
                                n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> str:
    train, _ = train_test_batches(n_batches, n_train, n_total)
    return (_kmeans_base(dense, "language", n_features, n_batches, n_train, n_total)
            + kmeans_chain_ctes(train, k, silhouettes=False) + _euclidean_ctes(train) + """
SELECT i.batch_no, i.n_rows, round(i.inertia, 6) AS inertia, round(s.silhouette, 6) AS silhouette
FROM (SELECT batch_no, count(*) AS n_rows, sum(d2) AS inertia FROM lab GROUP BY batch_no) i
LEFT JOIN (SELECT batch_no, avg(s) AS silhouette FROM sil GROUP BY batch_no) s ON s.batch_no = i.batch_no""")


def euclidean_samples_sql(k: int = 2, dense: bool = False, n_features: int = DEFAULT_N_FEATURES,
                          n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> str:
    train, _ = train_test_batches(n_batches, n_train, n_total)
    return (_kmeans_base(dense, "language", n_features, n_batches, n_train, n_total)
            + kmeans_chain_ctes(train, k, silhouettes=False) + _euclidean_ctes(train) + """
SELECT row_id, batch_no, cluster, round(s, 6) AS s FROM sil""")


def silhouette_samples_sql(k: int = 2, dense: bool = False, task: str = "language",
                           n_features: int = DEFAULT_N_FEATURES, n_batches: int = 8, n_train: int = 6,
                           n_total: int = 8) -> str:
    train, _ = train_test_batches(n_batches, n_train, n_total)
    sil = " UNION ALL ".join(f"SELECT * FROM si{t}" for t in range(1, len(train) + 1))
    return (_kmeans_base(dense, task, n_features, n_batches, n_train, n_total)
            + kmeans_chain_ctes(train, k) + f",\nsil AS ({sil})\n"
            "SELECT row_id, batch_no, cluster, round(s, 6) AS s FROM sil")


def kmeans_aligned_sql(k: int = 10, n_batches: int = 8, n_train: int = 6, n_total: int = 8,
                       dense: bool = True) -> str:
    train, test = train_test_batches(n_batches, n_train, n_total)
    lab = " UNION ALL ".join(f"SELECT * FROM l{t}" for t in range(1, len(train) + 1))
    return (_kmeans_base(dense, "language", DEFAULT_N_FEATURES, n_batches, n_train, n_total)
            + kmeans_chain_ctes(train, k, silhouettes=False) + _test_assign(train, test) + f""",
lab AS ({lab}),
al AS (SELECT cluster, label AS aligned_label FROM (
         SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS rk
         FROM lab GROUP BY cluster, label) z WHERE rk = 1)
SELECT t.cycle, t.batch_no, 'kmeans' AS model, count(*) AS n,
       round(avg(CASE WHEN t.label = coalesce(al.aligned_label, -1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM ta t LEFT JOIN al ON al.cluster = t.cluster
GROUP BY t.cycle, t.batch_no""")


# --------------------------------------------------------------------------- operator-level queries

def _with_features(task: str = "language", n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> str:
    return "WITH " + feature_ctes(email_source(task), DEFAULT_N_FEATURES, n_batches, n_train, n_total).lstrip()


def batch_assign_sql() -> str:
    return "WITH " + schedule_ctes(email_source()).lstrip() + "\nSELECT row_id, batch_no, cycle, phase FROM sched"


def batch_row_count_sql() -> str:
    return ("WITH " + schedule_ctes(email_source()).lstrip()
            + "\nSELECT batch_no, count(*) AS n_rows FROM sched GROUP BY batch_no")


def clean_text_sql() -> str:
    return _with_features() + "\nSELECT row_id, c0 AS feature0, c1 AS feature1, c0 || ' ' || c1 AS text FROM cleaned"


def clean_rare_words_sql() -> str:
    """Words that occur once in all texts are dropped, the others keep their order."""
    def words(part: str) -> str:
        return (f"SELECT row_id, '{part}' AS part, generate_subscripts(l, 1) AS pos, unnest(l) AS word "
                f"FROM (SELECT row_id, string_split_regex(coalesce({part}, ''), '\\s+') AS l FROM emails) q")

    def text(part: str) -> str:
        return (f"coalesce((SELECT string_agg(k.word, ' ' ORDER BY k.pos) FROM kept k "
                f"WHERE k.row_id = e.row_id AND k.part = '{part}'), '') AS {part}")

    return f"""WITH emails AS ({email_source()}),
w AS (SELECT * FROM ({words("feature0")} UNION ALL {words("feature1")}) u WHERE word <> ''),
rare AS (SELECT lower(word) AS word FROM w GROUP BY lower(word) HAVING count(*) = 1),
kept AS (SELECT w.* FROM w ANTI JOIN rare ON rare.word = lower(w.word)),
joined AS (SELECT e.row_id, {text("feature0")}, {text("feature1")} FROM emails e)
SELECT row_id, feature0, feature1, feature0 || ' ' || feature1 AS text FROM joined"""


def token_counts_sql() -> str:
    return _with_features() + f"""
SELECT row_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct
FROM (SELECT row_id, regexp_extract_all(lower(c0 || ' ' || c1), '{TOKEN_RE}') AS t FROM cleaned) q"""


def hashed_features_sql() -> str:
    return _with_features() + """
SELECT f.row_id, f.bucket, f.cnt, round(f.cnt / n.norm, 6) AS x FROM feat f JOIN norms n ON n.row_id = f.row_id"""


def label_dictionary_sql() -> str:
    return f"""WITH emails AS ({email_source('lang')}),
dict AS (
  SELECT feature2, CAST(row_number() OVER (ORDER BY feature2) - 1 AS INTEGER) AS label
  FROM (SELECT DISTINCT feature2 FROM emails WHERE feature2 IS NOT NULL) d)
SELECT feature2, label FROM dict"""


def class_list_sql() -> str:
    return f"SELECT DISTINCT feature2 FROM ({email_source('lang')}) e WHERE feature2 IS NOT NULL"


def nb_state_sql() -> str:
    return _with_features() + """
SELECT label, bucket, round(sum(x), 6) AS sum_x, count(*) AS n_present FROM xl WHERE phase = 'train'
GROUP BY label, bucket"""


def nb_class_docs_sql() -> str:
    return _with_features() + "\nSELECT label, count(*) AS n_docs FROM rows_t WHERE phase = 'train' GROUP BY label"


def all_metrics_ctes(n_features: int = DEFAULT_N_FEATURES, lam: float = 1e-4, n_batches: int = 8, n_train: int = 6,
                     n_total: int = 8) -> str:
    train, test = train_test_batches(n_batches, n_train, n_total)
    return (_with_features("language", n_batches, n_train, n_total) + nb_state_ctes(1.0, n_features)
            + mnb_score_ctes(1.0, n_features, "mnb_scores") + pred_cte("mnb_scores", "mnb_pred")
            + bnb_score_ctes(1.0, n_features, "bnb_scores") + pred_cte("bnb_scores", "bnb_pred")
            + linear_chain_ctes(train, lam) + linear_pred_ctes(train, test, "lin_pred")
            + ",\nmetrics AS ((" + metrics_select("multinomial_nb", "mnb_pred") + ")\nUNION ALL ("
            + metrics_select("linear_sgd", "lin_pred") + ")\nUNION ALL ("
            + metrics_select("bernoulli_nb", "bnb_pred") + "))")


def metric_history_sql() -> str:
    longs = " UNION ALL ".join(
        f"SELECT cycle, model, batch_no, '{m}' AS metric, {m} AS value FROM metrics"
        for m in ("accuracy", "precision", "recall"))
    return all_metrics_ctes() + f"""
SELECT cycle, model, batch_no, metric, value,
       CAST(row_number() OVER (PARTITION BY cycle, model, metric ORDER BY batch_no) AS INTEGER) AS idx
FROM ({longs}) l"""


def compare_models_sql() -> str:
    cols = ", ".join(f"max(CASE WHEN model = '{m}' THEN accuracy END) AS {m}"
                     for m in ("multinomial_nb", "linear_sgd", "bernoulli_nb"))
    return all_metrics_ctes() + f"\nSELECT cycle, batch_no, {cols} FROM metrics GROUP BY cycle, batch_no"


def metrics_summary_sql() -> str:
    cols = ", ".join(f"round(avg({m}), 6) AS {m}_mean, min({m}) AS {m}_min, max({m}) AS {m}_max"
                     for m in ("accuracy", "precision", "recall"))
    return all_metrics_ctes() + f"\nSELECT cycle, model, count(*) AS n_batches, {cols} FROM metrics GROUP BY cycle, model"


def wire_roundtrip_sql() -> str:
    return ("WITH " + schedule_ctes(email_source()).lstrip()
            + "\nSELECT batch_no, feature0, feature1, feature2 FROM sched")


def wire_quarantine_sql(line_size: int = 500) -> str:
    return ("WITH " + schedule_ctes(email_source()).lstrip() + f""",
per_batch AS (SELECT batch_no, count(*) AS n FROM sched GROUP BY batch_no)
SELECT 'decoded' AS status, CAST(sum(ceil(n / {float(line_size)})) AS BIGINT) AS n_lines,
       CAST(sum(n) AS BIGINT) AS n_records FROM per_batch
UNION ALL
SELECT 'quarantined' AS status, count(*) AS n_lines, CAST(0 AS BIGINT) AS n_records FROM pages""")


def all_metrics_sql(n_batches: int = 8, n_train: int = 6, n_total: int = 8) -> str:
    return (all_metrics_ctes(n_batches=n_batches, n_train=n_train, n_total=n_total)
            + "\nSELECT * FROM metrics")


def stream_metrics_sql() -> str:
    return all_metrics_sql()


def stream_slices_sql(base: int, step: int, line_size: int, interval: int = 5, delay: int = 2) -> str:
    """Times in milliseconds since ``base``; a line counts when its first copy finds its slice open."""
    return "WITH " + schedule_ctes(email_source()).lstrip() + f""",
placed AS (
  SELECT batch_no, CAST(ceil(n_rows / 8.0) AS BIGINT) AS size,
         (ord - 1 - (batch_no - 1) * CAST(ceil(n_rows / 8.0) AS BIGINT)) // {line_size} AS line_no FROM sched),
lines AS (
  SELECT batch_no, line_no, count(*) AS n,
         ((batch_no - 1) * any_value(size) + line_no * {line_size}) * {step} AS sent,
         (batch_no - 1) // 2 AS part, line_no % 3 = 2 AND batch_no % 2 = 1 AS bad
  FROM placed GROUP BY batch_no, line_no),
sends AS (
  SELECT *, part + CASE WHEN line_no % 3 = 1 THEN 1 ELSE 0 END AS at_part FROM lines
  UNION ALL SELECT *, part + 1 AS at_part FROM lines WHERE line_no % 3 = 0),
clocks AS (
  SELECT p.at_part, (SELECT max(s.sent) FROM sends s WHERE s.at_part < p.at_part) - {delay * 1000} AS clock
  FROM (SELECT DISTINCT at_part FROM sends) p),
first_sends AS (
  SELECT batch_no, line_no, n, sent, bad, min(at_part) AS at_part FROM sends GROUP BY batch_no, line_no, n, sent, bad),
judged AS (
  SELECT f.*, f.sent // {interval * 1000} AS slice,
         c.clock IS NOT NULL AND (f.sent // {interval * 1000} + 1) * {interval * 1000} <= c.clock AS late
  FROM first_sends f JOIN clocks c ON c.at_part = f.at_part)
SELECT CAST({base} + slice * {interval} AS BIGINT) AS slice_start,
       count(*) FILTER (WHERE NOT bad AND NOT late) AS n_lines,
       CAST(coalesce(sum(n) FILTER (WHERE NOT bad AND NOT late), 0) AS BIGINT) AS n_records,
       count(*) FILTER (WHERE bad AND NOT late) AS n_bad,
       count(*) FILTER (WHERE NOT bad AND late) AS late_lines,
       CAST(coalesce(sum(n) FILTER (WHERE NOT bad AND late), 0) AS BIGINT) AS late_records,
       count(*) FILTER (WHERE bad AND late) AS late_bad
FROM judged GROUP BY slice"""


def sweep_classifiers_sql(schedules: Sequence[tuple[int, int]]) -> str:
    """``schedules`` lists (n_batches, n_train)."""
    size = f"(SELECT CAST(greatest(1, ceil(count(*) / {{n}}.0)) AS INTEGER) FROM ({email_source()}) e)"
    return "\nUNION ALL ".join(
        f"SELECT {size.format(n=n)} AS batch_size, m.* FROM ({all_metrics_sql(n, n_train, n)}) m"
        for n, n_train in schedules)


def confusion_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT cycle, batch_no, '{model}' AS model, actual, predicted FROM {pred}"
        for model, pred in (("multinomial_nb", "mnb_pred"), ("linear_sgd", "lin_pred"), ("bernoulli_nb", "bnb_pred")))
    return all_metrics_ctes() + f"""
SELECT cycle, batch_no, model, actual, predicted, count(*) AS n FROM ({parts}) p
GROUP BY cycle, batch_no, model, actual, predicted"""


def dense_confusion_sql(k: int = 2) -> str:
    parts = " UNION ALL ".join(
        f"SELECT cycle, batch_no, '{model}' AS model, actual, predicted FROM {pred}"
        for model, pred in (("multinomial_nb", "mnb_pred"), ("linear_sgd", "lin_pred"), ("bernoulli_nb", "bnb_pred")))
    return all_metrics_ctes() + f""",
given AS ({parts}),
cells AS (SELECT g.*, CAST(a.range AS INTEGER) AS actual, CAST(p.range AS INTEGER) AS predicted
          FROM (SELECT DISTINCT cycle, batch_no, model FROM given) g, range({k}) a, range({k}) p)
SELECT c.cycle, c.batch_no, c.model, c.actual, c.predicted, count(g.model) AS n
FROM cells c LEFT JOIN given g ON g.cycle = c.cycle AND g.batch_no = c.batch_no AND g.model = c.model
  AND g.actual = c.actual AND g.predicted = c.predicted
GROUP BY c.cycle, c.batch_no, c.model, c.actual, c.predicted"""


def label_growth_sql(n_batches: int = 200) -> str:
    return f"""
WITH numbered AS (
  SELECT concat_ws('/', lang, source) AS name, row_number() OVER (ORDER BY doc_id) AS ord, count(*) OVER () AS n
  FROM documents),
first AS (SELECT name, CAST(min((ord - 1) // CAST(ceil(n / {n_batches}.0) AS BIGINT)) + 1 AS INTEGER) AS version
          FROM numbered GROUP BY name)
SELECT name, CAST(row_number() OVER (ORDER BY version, name) - 1 AS INTEGER) AS label, version FROM first"""


def feature_vectors_sql(n_features: int = DEFAULT_N_FEATURES) -> str:
    return _with_features() + f""",
vecs AS (
  SELECT f.row_id, string_agg(CAST(f.bucket AS VARCHAR), ' ' ORDER BY f.bucket) AS indices,
         round(sum(f.cnt / n.norm), 6) AS value_sum
  FROM feat f JOIN norms n ON n.row_id = f.row_id GROUP BY f.row_id)
SELECT r.row_id, r.batch_no, r.label, CAST({n_features} AS INTEGER) AS size, coalesce(v.indices, '') AS indices,
       coalesce(v.value_sum, 0.0) AS value_sum
FROM rows_t r LEFT JOIN vecs v ON v.row_id = r.row_id"""


def stream_quarantine_sql(line_size: int = 20) -> str:
    return ("WITH " + schedule_ctes(email_source()).lstrip() + f""",
placed AS (
  SELECT batch_no, CAST(floor((ord - min(ord) OVER (PARTITION BY batch_no)) / {float(line_size)}) AS INTEGER) AS line_no
  FROM sched)
SELECT batch_no, count(DISTINCT line_no) AS n_lines,
       count(DISTINCT CASE WHEN line_no = 1 THEN line_no END) AS n_bad,
       count(CASE WHEN line_no <> 1 THEN 1 END) AS n_records
FROM placed GROUP BY batch_no
UNION ALL
SELECT CAST(0 AS INTEGER) AS batch_no, count(*) AS n_lines, count(*) AS n_bad, CAST(0 AS BIGINT) AS n_records FROM pages""")


def sweep_mnb_sql(plans=REFERENCE_PLANS, n_features: int = DEFAULT_N_FEATURES) -> str:
    values = ", ".join(f"('{p}', {t}, {n})" for p, t, n in plans)
    return ("WITH " + feature_ctes(email_source(), n_features, 1, 1, 1).lstrip() + f""",
plans AS (SELECT * FROM (VALUES {values}) v(plan, n_train, n_total)),
pr AS (
  SELECT r.row_id, r.label, r.sum_x, p.plan, p.n_train, p.n_total,
         CAST(floor((s.ord - 1) / p.sz) AS BIGINT) AS q
  FROM rows_t r JOIN sched s ON s.row_id = r.row_id
  CROSS JOIN (SELECT plans.*, ceil((SELECT count(*) FROM sched) / plans.n_total) AS sz FROM plans) p),
pp AS (
  SELECT row_id, label, sum_x, plan, CAST(q + 1 AS INTEGER) AS batch_no,
         CASE WHEN q % n_total < n_train THEN 'train' ELSE 'test' END AS phase FROM pr),
st AS (
  SELECT pp.plan, pp.label, x.bucket, sum(x.x) AS sum_x FROM pp JOIN xl x ON x.row_id = pp.row_id
  WHERE pp.phase = 'train' GROUP BY pp.plan, pp.label, x.bucket),
dc AS (SELECT plan, label, count(*) AS n_docs FROM pp WHERE phase = 'train' GROUP BY plan, label),
cl AS (
  SELECT d.plan, d.label, ln(d.n_docs / sum(d.n_docs) OVER (PARTITION BY d.plan)) AS lp,
         coalesce(t.total_x, 0.0) AS total_x
  FROM dc d LEFT JOIN (SELECT plan, label, sum(sum_x) AS total_x FROM st GROUP BY plan, label) t
    ON t.plan = d.plan AND t.label = d.label),
dt AS (
  SELECT pp.row_id, pp.plan, s.label, sum(x.x * (ln(s.sum_x + 1.0) - ln(1.0))) AS dot
  FROM pp JOIN xl x ON x.row_id = pp.row_id JOIN st s ON s.plan = pp.plan AND s.bucket = x.bucket
  WHERE pp.phase = 'test' GROUP BY pp.row_id, pp.plan, s.label),
sc AS (
  SELECT pp.row_id, pp.plan, pp.batch_no, pp.label AS actual, c.label AS cls,
         c.lp + pp.sum_x * (ln(1.0) - ln(c.total_x + 1.0 * {n_features})) + coalesce(k.dot, 0.0) AS score
  FROM pp JOIN cl c ON c.plan = pp.plan
  LEFT JOIN dt k ON k.row_id = pp.row_id AND k.plan = pp.plan AND k.label = c.label
  WHERE pp.phase = 'test'),
pred AS (
  SELECT plan, batch_no, actual, cls AS predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, plan ORDER BY score DESC, cls ASC) AS rk FROM sc) z
  WHERE rk = 1)
SELECT plan, batch_no, 'multinomial_nb' AS model, tp, fp, fn, tn,
       CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall
FROM (
  SELECT plan, batch_no,
         CAST(sum(CASE WHEN actual = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN actual <> 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN actual = 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN actual <> 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM pred GROUP BY plan, batch_no) m""")


def sweep_cycles_sql(plans: Sequence[tuple[int, int, int]], n_features: int = DEFAULT_N_FEATURES) -> str:
    """``plans`` lists (batch size, n_train, n_total); the state of a cycle is summed anew from all cycles before it."""
    values = ", ".join(str(tuple(p)) for p in plans)
    scores = {
        "multinomial_nb": f"c.lp + p.sum_x * (ln(1.0) - ln(c.total_x + 1.0 * {n_features})) + coalesce(k.mdot, 0.0)",
        "bernoulli_nb": f"c.lp + c.rest + ({n_features} - c.seen) * ln(1 - 1.0 / (c.n_docs + 2.0)) "
                        "+ p.nnz * ln(1.0 / (c.n_docs + 1.0)) + coalesce(k.bdot, 0.0)",
    }
    scored = " UNION ALL ".join(f"""
  SELECT p.row_id, p.plan, p.cycle, p.batch_no, p.label AS actual, '{model}' AS model, c.label AS cls, {score} AS score
  FROM pp p JOIN cl c ON c.plan = p.plan AND c.cycle = p.cycle
  LEFT JOIN dt k ON k.row_id = p.row_id AND k.plan = p.plan AND k.label = c.label
  WHERE p.phase = 'test'""" for model, score in scores.items())
    return ("WITH " + feature_ctes(email_source(), n_features, 1, 1, 1).lstrip() + f""",
plans AS (SELECT * FROM (VALUES {values}) v(plan, n_train, n_total)),
pp AS (
  SELECT r.row_id, r.label, r.sum_x, r.nnz, p.plan, CAST((s.ord - 1) // p.plan + 1 AS INTEGER) AS batch_no,
         CAST((s.ord - 1) // p.plan // p.n_total + 1 AS INTEGER) AS cycle,
         CASE WHEN (s.ord - 1) // p.plan % p.n_total < p.n_train THEN 'train' ELSE 'test' END AS phase
  FROM rows_t r JOIN sched s ON s.row_id = r.row_id CROSS JOIN plans p),
cyc AS (SELECT DISTINCT plan, cycle FROM pp WHERE phase = 'test'),
st AS (
  SELECT c.plan, c.cycle, p.label, x.bucket, sum(x.x) AS sum_x, count(*) AS n_present
  FROM cyc c JOIN pp p ON p.plan = c.plan AND p.cycle <= c.cycle AND p.phase = 'train' JOIN xl x ON x.row_id = p.row_id
  GROUP BY c.plan, c.cycle, p.label, x.bucket),
dc AS (
  SELECT c.plan, c.cycle, p.label, count(*) AS n_docs
  FROM cyc c JOIN pp p ON p.plan = c.plan AND p.cycle <= c.cycle AND p.phase = 'train' GROUP BY c.plan, c.cycle, p.label),
cl AS (
  SELECT d.plan, d.cycle, d.label, any_value(d.n_docs) AS n_docs,
         ln(any_value(d.n_docs) / any_value(d.all_docs)) AS lp, coalesce(sum(s.sum_x), 0.0) AS total_x,
         count(s.bucket) AS seen, coalesce(sum(ln(1 - (s.n_present + 1.0) / (d.n_docs + 2.0))), 0.0) AS rest
  FROM (SELECT *, sum(n_docs) OVER (PARTITION BY plan, cycle) AS all_docs FROM dc) d
  LEFT JOIN st s ON s.plan = d.plan AND s.cycle = d.cycle AND s.label = d.label GROUP BY d.plan, d.cycle, d.label),
dt AS (
  SELECT p.row_id, p.plan, s.label, sum(x.x * ln(s.sum_x + 1.0)) AS mdot,
         sum(ln((s.n_present + 1.0) / (d.n_docs - s.n_present + 1.0)) - ln(1.0 / (d.n_docs + 1.0))) AS bdot
  FROM pp p JOIN xl x ON x.row_id = p.row_id
  JOIN st s ON s.plan = p.plan AND s.cycle = p.cycle AND s.bucket = x.bucket
  JOIN dc d ON d.plan = p.plan AND d.cycle = p.cycle AND d.label = s.label
  WHERE p.phase = 'test' GROUP BY p.row_id, p.plan, s.label),
sc AS ({scored}),
pred AS (
  SELECT plan, cycle, batch_no, model, actual, cls AS predicted FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id, plan, model ORDER BY score DESC, cls ASC) AS rk FROM sc) z
  WHERE rk = 1)
SELECT CAST(plan AS INTEGER) AS batch_size, cycle, batch_no, model, tp, fp, fn, tn,
       CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall
FROM (
  SELECT plan, cycle, batch_no, model,
         CAST(sum(CASE WHEN actual = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN actual <> 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN actual = 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN actual <> 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM pred GROUP BY plan, cycle, batch_no, model) m""")


def holdout_mnb_sql(fraction: float = 0.33, n_features: int = DEFAULT_N_FEATURES) -> str:
    return _with_features() + f""",
sp AS (
  SELECT r.*, CASE WHEN ('0x' || substr(md5(CAST(r.row_id AS VARCHAR)), 1, 8))::BIGINT / {float(1 << 32)} < {fraction}
                   THEN 'test' ELSE 'train' END AS split
  FROM rows_t r),
st AS (SELECT x.label, x.bucket, sum(x.x) AS sum_x FROM xl x JOIN sp ON sp.row_id = x.row_id
       WHERE sp.split = 'train' GROUP BY x.label, x.bucket),
dc AS (SELECT label, count(*) AS n_docs FROM sp WHERE split = 'train' GROUP BY label),
cl AS (SELECT d.label, ln(d.n_docs / sum(d.n_docs) OVER ()) AS lp, coalesce(t.total_x, 0.0) AS total_x
       FROM dc d LEFT JOIN (SELECT label, sum(sum_x) AS total_x FROM st GROUP BY label) t ON t.label = d.label),
dt AS (SELECT x.row_id, s.label, sum(x.x * (ln(s.sum_x + 1.0) - ln(1.0))) AS dot
       FROM xl x JOIN sp ON sp.row_id = x.row_id JOIN st s ON s.bucket = x.bucket
       WHERE sp.split = 'test' GROUP BY x.row_id, s.label),
sc AS (SELECT sp.row_id, sp.batch_no, sp.label AS actual, c.label AS cls,
              c.lp + sp.sum_x * (ln(1.0) - ln(c.total_x + 1.0 * {n_features})) + coalesce(k.dot, 0.0) AS score
       FROM sp CROSS JOIN cl c LEFT JOIN dt k ON k.row_id = sp.row_id AND k.label = c.label
       WHERE sp.split = 'test'),
pred AS (SELECT batch_no, actual, cls AS predicted FROM (
           SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, cls ASC) AS rk FROM sc) z
         WHERE rk = 1)
SELECT batch_no, 'multinomial_nb' AS model, tp, fp, fn, tn,
       CASE WHEN tp + fp + fn + tn > 0 THEN round((tp + tn) / (tp + fp + fn + tn), 6) ELSE 0.0 END AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall
FROM (
  SELECT batch_no,
         CAST(sum(CASE WHEN actual = 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN actual <> 1 AND predicted = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN actual = 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN actual <> 1 AND predicted <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM pred GROUP BY batch_no) m"""


def _token_cte() -> str:
    return f""",
tk AS (SELECT row_id, regexp_extract_all(lower(c0 || ' ' || c1), '{TOKEN_RE}') AS tokens FROM cleaned),
dfreq AS (SELECT token, count(*) AS df FROM (SELECT row_id, unnest(list_distinct(tokens)) AS token FROM tk) u
          GROUP BY token)"""


def vocabulary_sql() -> str:
    return _with_features() + _token_cte() + """
SELECT token, df, CAST(row_number() OVER (ORDER BY df DESC, token) - 1 AS INTEGER) AS index FROM dfreq"""


def count_vectors_sql() -> str:
    return _with_features() + _token_cte() + """,
voc AS (SELECT token, CAST(row_number() OVER (ORDER BY df DESC, token) - 1 AS INTEGER) AS index FROM dfreq)
SELECT u.row_id, v.index, count(*) AS cnt
FROM (SELECT row_id, unnest(tokens) AS token FROM tk) u JOIN voc v ON v.token = u.token
GROUP BY u.row_id, v.index"""


def idf_sql() -> str:
    return _with_features() + _token_cte() + """
SELECT token, df, round(ln(((SELECT count(*) FROM cleaned) + 1) / (df + 1)), 6) AS idf FROM dfreq"""


def lang4_accuracy_sql(n_features: int = DEFAULT_N_FEATURES) -> str:
    base = "WITH " + feature_ctes(email_source("lang"), n_features).lstrip() + nb_state_ctes(1.0, n_features)
    sel = lambda model, pred: f"""
SELECT cycle, batch_no, '{model}' AS model, count(*) AS n,
       round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM {pred} GROUP BY cycle, batch_no"""
    return (base + mnb_score_ctes(1.0, n_features, "mnb_scores") + pred_cte("mnb_scores", "mnb_pred")
            + bnb_score_ctes(1.0, n_features, "bnb_scores") + pred_cte("bnb_scores", "bnb_pred")
            + sel("multinomial_nb", "mnb_pred") + "\nUNION ALL" + sel("bernoulli_nb", "bnb_pred"))

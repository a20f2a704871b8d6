"""DuckDB twins of the test-table adapters (``storelens.sources.fixtures``).

Oracle SQL for a query is ``WITH <fixture CTEs> <query>``; the views
region … conversations are registered by the checker.
"""

from __future__ import annotations

SNAP = "TIMESTAMP '2000-08-01'"
OBS_START = "TIMESTAMP '1999-08-02'"
SENT_SNAP = "TIMESTAMP '2024-01-20'"


def days(a: str, b: str) -> str:
    """Elapsed whole days from a to b (floor), as BIGINT."""
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


def uniform(id_expr: str, seed: str) -> str:
    return (f"(CAST(('0x' || substr(md5('{seed}' || '|' || CAST({id_expr} AS VARCHAR)), 1, 13)) AS BIGINT)"
            f" / power(16, 13))")


TRANSACTIONS = """transactions AS (
  SELECT CASE WHEN l.l_returnflag = 'R' AND o.o_orderkey % 10 = 0
              THEN 'C' || CAST(o.o_orderkey AS VARCHAR) ELSE CAST(o.o_orderkey AS VARCHAR) END AS Invoice,
         CAST(l.l_partkey AS VARCHAR) AS StockCode,
         p.p_name AS Description,
         CASE WHEN o.o_orderkey % 50 = 0 THEN -CAST(l.l_quantity AS INTEGER)
              ELSE CAST(l.l_quantity AS INTEGER) END AS Quantity,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS INTEGER)) AS InvoiceDate,
         CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE l.l_extendedprice / l.l_quantity END AS Price,
         CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE CAST(o.o_custkey AS DOUBLE) END AS "Customer ID",
         r.r_name AS Country
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""


def clean(country: str | None = None) -> str:
    scope = "" if country is None else f" AND Country = '{country}'"
    return f"""clean AS (
  SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price,
         CAST(CAST("Customer ID" AS BIGINT) AS VARCHAR) AS "Customer ID", Country,
         CAST(Quantity AS DOUBLE) * Price AS LineTotal
  FROM transactions
  WHERE "Customer ID" IS NOT NULL{scope}
    AND NOT coalesce(starts_with(Invoice, 'C'), false) AND Quantity > 0 AND Price > 0)"""


OBS = f"""obs AS (SELECT * FROM clean WHERE InvoiceDate BETWEEN {OBS_START} AND {SNAP})"""
HORIZON = f"""hz AS (SELECT * FROM clean WHERE InvoiceDate BETWEEN {SNAP} + INTERVAL 1 DAY AND {SNAP} + INTERVAL 90 DAY)"""

RFM = f"""rfm AS (
  SELECT "Customer ID" AS CustomerID, max(InvoiceDate) AS last_order_date, min(InvoiceDate) AS first_order_date,
         CAST(count(DISTINCT Invoice) AS BIGINT) AS frequency,
         greatest(sum(LineTotal), 0.0) AS monetary_value,
         {days('max(InvoiceDate)', SNAP)} AS recency_days,
         {days('min(InvoiceDate)', SNAP)} AS tenure_days,
         sum(LineTotal) / count(DISTINCT Invoice) AS avg_order_value,
         ln(1 + {days('max(InvoiceDate)', SNAP)}) AS recency_days_log
  FROM obs GROUP BY 1)"""

GAPS = f"""gap_lines AS (
  SELECT "Customer ID" AS CustomerID,
         {days('lag(InvoiceDate) OVER (PARTITION BY "Customer ID" ORDER BY InvoiceDate)', 'InvoiceDate')} AS g
  FROM obs),
gap_cv AS (
  SELECT CustomerID,
         CASE WHEN count(*) < 2 THEN -1.0
              WHEN sum(g) = 0 THEN 0.0
              ELSE sqrt(greatest(CAST((count(g)) * sum(g * g) - sum(g) * sum(g) AS DOUBLE), 0.0)) / CAST(sum(g) AS DOUBLE) END AS purchase_gap_cv,
         CAST(count(*) < 2 AS INTEGER) AS is_single_purchase
  FROM gap_lines GROUP BY 1)"""

BEHAVIOUR = GAPS + """,
diversity AS (SELECT "Customer ID" AS CustomerID, CAST(count(DISTINCT StockCode) AS BIGINT) AS category_diversity FROM obs GROUP BY 1),
behaviour AS (
  SELECT g.CustomerID, g.purchase_gap_cv, d.category_diversity, g.is_single_purchase, 0.0::DOUBLE AS return_rate
  FROM gap_cv g LEFT JOIN diversity d USING (CustomerID))"""

MONTHLY = f"""monthly AS (
  SELECT "Customer ID" AS CustomerID, CAST(date_trunc('month', InvoiceDate) AS DATE) AS year_month,
         CAST(count(DISTINCT Invoice) AS BIGINT) AS n_orders
  FROM obs WHERE InvoiceDate >= CAST(CAST({SNAP} AS DATE) - INTERVAL 6 MONTH AS TIMESTAMP)
  GROUP BY 1, 2)"""

TEMPORAL = MONTHLY + f""",
trend AS (
  SELECT CustomerID, CASE WHEN count(*) < 2 THEN 0.0
    ELSE CAST(count(*) * sum(x * n_orders) - sum(x) * sum(n_orders) AS DOUBLE)
         / CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) END AS purchase_trend
  FROM (SELECT *, CAST(row_number() OVER (PARTITION BY CustomerID ORDER BY year_month) - 1 AS HUGEINT) AS x FROM monthly)
  GROUP BY 1),
decay AS (
  SELECT "Customer ID" AS CustomerID, exp(-0.1 * {days('max(InvoiceDate)', SNAP)}) AS time_decay_weight
  FROM obs GROUP BY 1),
temporal AS (
  SELECT t.CustomerID, t.purchase_trend, coalesce(d.time_decay_weight, 0.0) AS time_decay_weight
  FROM trend t LEFT JOIN decay d USING (CustomerID))"""

LABELS = f"""summary AS (
  SELECT "Customer ID" AS CustomerID, min(InvoiceDate) AS first_order_date, max(InvoiceDate) AS last_order_date,
         CAST(count(DISTINCT Invoice) AS BIGINT) AS total_orders, sum(Price * Quantity) AS total_spend
  FROM obs GROUP BY 1),
labels AS (
  SELECT s.CustomerID,
         CAST(s.CustomerID NOT IN (SELECT "Customer ID" FROM hz) AS INTEGER) AS churned,
         s.first_order_date, s.last_order_date, s.total_orders, s.total_spend
  FROM summary s)"""

REVIEW_SENTIMENT = """review_sentiment AS (
  SELECT CAST(user_id AS VARCHAR) AS CustomerID, ts AS review_date,
         CASE WHEN event_id % 101 = 0 THEN NULL ELSE ((event_id * 7919) % 2001) / 1000.0 - 1 END AS sentiment_score
  FROM events)"""

ASPECT_SENTIMENT = """aspect_sentiment AS (
  SELECT CAST(user_id AS VARCHAR) AS CustomerID, ts AS review_date,
         ['battery', 'shipping', 'price'][CAST(event_id % 3 AS INTEGER) + 1] AS aspect,
         ((event_id * 104729) % 2001) / 1000.0 - 1 AS aspect_sentiment
  FROM events)"""

SENTIMENT = REVIEW_SENTIMENT + ",\n" + ASPECT_SENTIMENT + f""",
doc_agg AS (
  SELECT CustomerID, CAST(sum(CAST(sentiment_score AS DECIMAL(18,9))) AS DOUBLE) / count(sentiment_score) AS avg_sentiment_score,
         CAST(count(*) FILTER (WHERE sentiment_score < -0.3) AS BIGINT) AS negative_review_count,
         max(last_s) AS last_review_sentiment, 1 AS has_reviews
  FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY CustomerID, sentiment_score IS NULL
                                               ORDER BY review_date DESC, sentiment_score DESC) = 1
                        AND sentiment_score IS NOT NULL THEN sentiment_score END AS last_s
        FROM review_sentiment WHERE review_date < {SENT_SNAP})
  GROUP BY 1),
aspect_pivot AS (
  SELECT CustomerID,
         CAST(sum(CAST(CASE WHEN aspect = 'battery' THEN aspect_sentiment END AS DECIMAL(18,9))) AS DOUBLE) / count(CASE WHEN aspect = 'battery' THEN aspect_sentiment END) AS avg_battery_sentiment,
         CAST(sum(CAST(CASE WHEN aspect = 'shipping' THEN aspect_sentiment END AS DECIMAL(18,9))) AS DOUBLE) / count(CASE WHEN aspect = 'shipping' THEN aspect_sentiment END) AS avg_shipping_sentiment,
         CAST(sum(CAST(CASE WHEN aspect = 'price' THEN aspect_sentiment END AS DECIMAL(18,9))) AS DOUBLE) / count(CASE WHEN aspect = 'price' THEN aspect_sentiment END) AS avg_price_sentiment
  FROM aspect_sentiment WHERE review_date < {SENT_SNAP} GROUP BY 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

BINARY_PRED = f"""pred AS (
  SELECT l.doc_id AS id, l.quality AS y_true,
         round(0.6 * {uniform('l.doc_id', 'prob')} + 0.4 * l.quality, 6) AS prob
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

CLASS_PRED = """x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
cent AS (SELECT label AS k, i, avg(v) AS c FROM x GROUP BY 1, 2),
dist AS (SELECT x.vec_id, cent.k, sqrt(sum((CAST(x.v AS DOUBLE) - cent.c) * (CAST(x.v AS DOUBLE) - cent.c))) AS d
         FROM x JOIN cent ON x.i = cent.i GROUP BY 1, 2),
pr AS (SELECT vec_id, k, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p FROM dist),
cpred AS (SELECT e.vec_id AS id, e.label AS y_true, list(pr.p ORDER BY pr.k) AS proba
          FROM pr JOIN embeddings e ON pr.vec_id = e.vec_id GROUP BY e.vec_id, e.label),
cp AS (SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred FROM cpred)"""


def review_pred(reviews_cte: str = "reviews") -> str:
    u = [uniform("review_id", f"cls{k}") for k in range(3)]
    s = [f"({u[k]} + CASE WHEN y_true = {k} THEN 0.8 ELSE 0.0 END)" for k in range(3)]
    return f"""rp0 AS (SELECT *, CASE WHEN label = 'negative' THEN 0 WHEN label = 'neutral' THEN 1 ELSE 2 END AS y_true FROM {reviews_cte}),
rp1 AS (SELECT *, [{s[0]} / ({s[0]} + {s[1]} + {s[2]}), {s[1]} / ({s[0]} + {s[1]} + {s[2]}), {s[2]} / ({s[0]} + {s[1]} + {s[2]})] AS proba FROM rp0),
rpred AS (SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred FROM rp1)"""


CHURN_PRED = f"""churn_pred AS (
  SELECT *, churned AS y_true, round(0.55 * {uniform('CustomerID', 'churn')} + 0.45 * churned, 6) AS prob
  FROM features WHERE churned IS NOT NULL)"""


def report_sql(pred: str, by: list[str] | None = None) -> str:
    """DuckDB classification report (labels seen in either column)."""
    by = by or []
    b = "".join(f"{c}, " for c in by)
    on = " AND ".join([f"t.{c} IS NOT DISTINCT FROM p.{c}" for c in by] + ["t.label = p.label"])
    sel_by = "".join(f"coalesce(t.{c}, p.{c}) AS {c}, " for c in by)
    return f"""(SELECT {sel_by}coalesce(t.label, p.label) AS label,
       CASE WHEN coalesce(p.predicted, 0) > 0 THEN coalesce(t.tp, 0) / p.predicted ELSE 0.0 END AS precision,
       CASE WHEN coalesce(t.support, 0) > 0 THEN coalesce(t.tp, 0) / t.support ELSE 0.0 END AS recall,
       CAST(coalesce(t.support, 0) AS BIGINT) AS support
  FROM (SELECT {b}y_true AS label, count(*) AS support, count(*) FILTER (WHERE y_true = y_pred) AS tp FROM {pred} GROUP BY ALL) t
  FULL JOIN (SELECT {b}y_pred AS label, count(*) AS predicted FROM {pred} GROUP BY ALL) p ON {on})"""


def report_f1_sql(pred: str, by: list[str] | None = None) -> str:
    return f"""(SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM {report_sql(pred, by)})"""


def auc_sql(pred: str, by: list[str] | None = None, prob: str = "prob") -> str:
    by = by or []
    b = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    return f"""(SELECT {b}CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
       CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) END AS auc
  FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
        FROM (SELECT {b}{prob} AS s, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM {pred} GROUP BY ALL))
  GROUP BY ALL)"""

LOGS = """logs AS (
  SELECT event_id AS id, 'req_' || CAST(event_id AS VARCHAR) AS request_id,
         ['product', 'sentiment', 'retention'][CAST(event_id % 3 AS INTEGER) + 1] AS module, 'v1' AS model_version,
         json_object('risk_band', CASE WHEN (event_id % 100) / 100.0 < 0.3 THEN 'LOW' WHEN (event_id % 100) / 100.0 < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END,
                     'confidence', (event_id % 100) / 100.0) AS prediction,
         CAST((event_id % 100) / 100.0 AS DOUBLE) AS confidence,
         CASE WHEN (event_id % 100) / 100.0 < 0.3 THEN 'LOW' WHEN (event_id % 100) / 100.0 < 0.6 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band,
         CAST(floor(value) AS INTEGER) AS latency_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
         (event_id % 3 = 0 AND value > 100) AS ood_flagged, ts AS created_at
  FROM events)"""

QUEUE = """queue AS (
  SELECT event_id AS id, 'req_' || CAST(event_id AS VARCHAR) AS request_id,
         ['product', 'sentiment', 'retention'][CAST(event_id % 3 AS INTEGER) + 1] AS module,
         ['low_confidence', 'ood_flagged', 'drift_alert'][CAST(event_id % 3 AS INTEGER) + 1] AS trigger,
         ['pending', 'pending', 'resolved', 'dismissed'][CAST(event_id % 4 AS INTEGER) + 1] AS status,
         ts AS created_at, CASE WHEN event_id % 4 >= 2 THEN ts + INTERVAL 1 HOUR END AS reviewed_at
  FROM events WHERE event_id % 10 = 0)"""

RESOLUTIONS = """res AS (
  SELECT id AS queue_id, status, reviewed_at AS resolved_at FROM queue WHERE status <> 'pending'
  UNION ALL SELECT id, 'dismissed', created_at + INTERVAL 30 MINUTE FROM queue WHERE id % 20 = 0
  UNION ALL SELECT event_id, 'resolved', ts FROM events WHERE event_id % 10 = 5)"""


def drift_log() -> str:
    from storelens.sources.fixtures import DRIFT_FEATURES
    names = ", ".join(f"'{f}'" for f in DRIFT_FEATURES)
    return f"""dlog AS (
  SELECT event_id AS id, ['product', 'sentiment', 'retention'][CAST(event_id % 3 AS INTEGER) + 1] AS module,
         [{names}][CAST(event_id % {len(DRIFT_FEATURES)} AS INTEGER) + 1] AS feature_name, 'psi' AS metric,
         value / 100.0 AS metric_value, CAST(0.2 AS DOUBLE) AS threshold, value / 100.0 > 0.2 AS alert_triggered,
         'v1' AS reference_version, ts AS created_at
  FROM events WHERE event_type = 'view')"""


STORAGE = """files AS (
  SELECT event_id AS id, 'req_' || CAST(event_id AS VARCHAR) AS request_id,
         CASE WHEN event_id % 2 = 0 THEN 'upload' ELSE 'gradcam' END AS file_type,
         '/store/' || CASE WHEN event_id % 2 = 0 THEN 'upload' ELSE 'gradcam' END || '/' || CAST(event_id AS VARCHAR) || '.png' AS file_path,
         ts + to_hours(CASE WHEN event_id % 2 = 0 THEN 24 ELSE 1 END) AS expires_at, ts AS created_at,
         CAST(floor(value * 1024 * 10) AS BIGINT) AS size_bytes
  FROM events WHERE event_type = 'purchase')"""


def _hex_sql(v: str, nbytes: int, little: bool = False) -> str:
    if not little:
        return f"lpad(hex(CAST({v} AS BIGINT)), {2 * nbytes}, '0')"
    return " || ".join(f"lpad(hex(CAST(({v}) // {256 ** i} AS BIGINT) % 256), 2, '0')" for i in range(nbytes))


def content_files_sql() -> str:
    from storelens.operators.metrics import TARGET_CATEGORIES
    from storelens.sources.fixtures import FILE_EXTENSIONS
    cats = ", ".join(f"'{c}'" for c in TARGET_CATEGORIES)
    exts = ", ".join(f"'{e}'" for e in FILE_EXTENSIONS)
    w = "CASE WHEN page_id % 9 = 0 THEN 128 ELSE 32 + (page_id * 7) % 300 END"
    h = "CASE WHEN page_id % 9 = 0 THEN 128 ELSE 32 + (page_id * 13) % 300 END"
    png = f"'89504E470D0A1A0A0000000D49484452' || {_hex_sql(w, 4)} || {_hex_sql(h, 4)} || '0802000000'"
    jpeg = f"'FFD8FFC0001108' || {_hex_sql(h, 2)} || {_hex_sql(w, 2)} || '03012200021101031101'"
    webp = (f"'52494646' || '00000000' || '57454250' || '56503858' || '0A000000' || '00000000' || "
            f"{_hex_sql(f'({w}) - 1', 3, True)} || {_hex_sql(f'({h}) - 1', 3, True)}")
    return f"""files AS (
  SELECT page_id, '/images/' || cat || '/' || regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') || ext AS path,
         cat AS category, content FROM (
    SELECT page_id, url,
           [{cats}][CAST(CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS INTEGER) + 1] AS cat,
           CASE WHEN page_id % 9 = 0 THEN '.png' ELSE [{exts}][CAST(page_id % 5 AS INTEGER) + 1] END AS ext,
           unhex(CASE WHEN page_id % 9 = 0 OR page_id % 4 = 0 THEN {png}
                      WHEN page_id % 4 = 1 THEN {jpeg} WHEN page_id % 4 = 2 THEN {webp} ELSE '' END)
           || encode(CASE WHEN page_id % 9 = 0 THEN repeat('dup ', 2000) || CAST(page_id % 4 AS VARCHAR) ELSE html END) AS content
    FROM pages))"""


def dims_sql(content: str) -> str:
    """(width, height) read from fixed header offsets: PNG IHDR, JPEG SOF0 right
    after SOI, WebP VP8X (NULL otherwise)."""
    hx = f"hex({content})"

    def be(start: int, n: int) -> str:
        return f"CAST(('0x' || substr({hx}, {start}, {2 * n})) AS BIGINT)"

    def le3(start: int) -> str:
        return " + ".join(f"CAST(('0x' || substr({hx}, {start + 2 * i}, 2)) AS BIGINT) * {256 ** i}" for i in range(3))
    png = f"starts_with({hx}, '89504E470D0A1A0A') AND substr({hx}, 25, 8) = '49484452'"
    jpg = f"starts_with({hx}, 'FFD8FFC0')"
    webp = f"starts_with({hx}, '52494646') AND substr({hx}, 17, 8) = '57454250' AND substr({hx}, 25, 8) = '56503858'"
    w = f"CASE WHEN {png} THEN {be(33, 4)} WHEN {jpg} THEN {be(19, 2)} WHEN {webp} THEN 1 + {le3(49)} END"
    h = f"CASE WHEN {png} THEN {be(41, 4)} WHEN {jpg} THEN {be(15, 2)} WHEN {webp} THEN 1 + {le3(55)} END"
    return f"CAST({w} AS INTEGER) AS width, CAST({h} AS INTEGER) AS height"


def ext_sql(path: str) -> str:
    return f"lower(regexp_extract(regexp_extract({path}, '([^/]*)$', 1), '[^.](\\.[^.]*)$', 1))"


def magic_sql(content: str, ext: str) -> str:
    h = f"hex({content})"
    return (f"CASE WHEN octet_length({content}) < 4 THEN false "
            f"WHEN {ext} IN ('.jpg', '.jpeg') THEN starts_with({h}, 'FFD8') "
            f"WHEN {ext} = '.png' THEN starts_with({h}, '89504E47') "
            f"WHEN {ext} = '.webp' THEN octet_length({content}) >= 12 AND substr({h}, 17, 8) = '57454250' "
            f"ELSE true END")

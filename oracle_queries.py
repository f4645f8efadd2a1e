"""SQL equivalents of the registered queries, over the same whole tables."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-08-01'"

PRODUCTS = """products AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS description, p_type AS category,
         CAST(p_retailprice AS DECIMAL(19,2)) AS price, 'USD' AS currency, p_size - 1 AS stock,
         TIMESTAMP '1970-01-01' + to_seconds(p_partkey) AS created_at
  FROM part)"""

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'PENDING' ELSE 'FAILED' END"

SALES = f"""sales AS (
  SELECT l_orderkey AS id, o_custkey AS customer_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity,
         CAST(l_extendedprice AS DECIMAL(19,2)) AS amount, {STATUS} AS status, o_orderdate AS created_at
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""

HEADERS = f"""headers AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(o_totalprice AS DECIMAL(19,2)) AS amount,
         {STATUS} AS status, o_orderdate AS created_at
  FROM orders)"""

EVENT_REQUEST = """event_id AS request_id, event_id AS seq,
         CASE WHEN k = 99 THEN -1 ELSE user_id END AS product_id"""

KEYED_EVENTS = """keyed AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""

STOCK_REQUESTS = f"""{KEYED_EVENTS}, requests AS (
  SELECT {EVENT_REQUEST},
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + k % 5 END AS INT) AS quantity,
         CASE WHEN event_type = 'signup' THEN 'RELEASE' ELSE 'RESERVE' END AS op
  FROM keyed)"""

ORDER_REQUESTS = f"""{KEYED_EVENTS}, requests AS (
  SELECT {EVENT_REQUEST}, 'c' || user_id AS customer_id,
         CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 1 + k % 15 END AS INT) AS quantity,
         CASE event_type WHEN 'view' THEN 'STRIPE' WHEN 'click' THEN 'PAYPAL' WHEN 'purchase' THEN 'CRYPTO'
                         WHEN 'signup' THEN ' ' ELSE 'CASH' END AS payment_method,
         'RESERVE' AS op
  FROM keyed)"""

CREATE_REQUESTS = """requests AS (
  SELECT CAST(p_partkey AS VARCHAR) AS request_id,
         CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name,
         CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS description,
         CAST(p_retailprice AS DECIMAL(19,2)) - 910 + CAST(0.005 AS DECIMAL(4,3)) AS price,
         p_size - 3 AS stock,
         CASE WHEN p_partkey % 13 = 0 THEN 'X' ELSE p_type END AS category
  FROM part), checked AS (
  SELECT *, concat_ws('; ',
    CASE WHEN name = '' THEN 'Name is required' END,
    CASE WHEN length(name) NOT BETWEEN 2 AND 100 THEN 'Name must be between 2 and 100 characters' END,
    CASE WHEN description IS NULL THEN 'Description is required' END,
    CASE WHEN price < 0.01 THEN 'Price must be greater than 0' END,
    CASE WHEN stock < 0 THEN 'Stock cannot be negative' END,
    CASE WHEN length(category) NOT BETWEEN 2 AND 50 THEN 'Category must be between 2 and 50 characters' END) AS reasons
  FROM requests)"""

UPDATE_REQUESTS = """requests AS (
  SELECT o_orderkey AS request_id, o_custkey * 2 AS id, 'Item ' || o_orderpriority AS name,
         o_orderpriority AS description,
         CAST(o_totalprice AS DECIMAL(19,2)) * CAST(0.125 AS DECIMAL(4,3)) AS price,
         o_orderkey % 100 - 5 AS stock, 'C' || o_orderstatus AS category
  FROM orders)"""

VERSIONED = f"""{UPDATE_REQUESTS}, valid AS (
  SELECT *, request_id % 4 AS version FROM requests WHERE stock >= 0 AND id IN (SELECT p_partkey FROM part)),
chain AS (
  SELECT id, min(request_id) AS request_id, 0 AS version FROM valid WHERE version = 0 GROUP BY id
  UNION ALL
  SELECT c.id, min(v.request_id), c.version + 1 FROM chain c JOIN valid v ON v.id = c.id AND v.version = c.version + 1 AND v.request_id > c.request_id
  GROUP BY c.id, c.version)"""

HISTORY = """history AS (
  SELECT user_id AS order_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'click' THEN 'PAYMENT_CONFIRMED'
              WHEN 'view' THEN 'STOCK_RESERVED' WHEN 'purchase' THEN 'CONFIRMED' ELSE 'FAILED' END AS status
  FROM events)"""

MESSAGES = """messages AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS message_id,
         CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'PRODUCT_CREATED' WHEN 'click' THEN 'PRODUCT_UPDATED'
              WHEN 'purchase' THEN 'PRODUCT_DELETED' ELSE 'PRODUCT_VIEWED' END AS "eventType",
         CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR) END AS "entityId",
         CASE WHEN event_type NOT IN ('error', 'purchase') THEN '{"price":' || value || '}' END AS payload,
         CASE WHEN event_type = 'error' THEN '{broken ' || props END AS raw,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'unknown' ELSE 'handled' END AS outcome
  FROM events)"""

NOTIFY = """notify AS (
  SELECT turn, CAST(conv_id AS VARCHAR) AS "userId", text AS message,
         CASE conv_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'sms' WHEN 2 THEN 'push' WHEN 3 THEN 'slack' ELSE 'fax' END AS channel
  FROM conversations)"""


def uuid(kind: str, key: str) -> str:
    digest = f"sha256('{kind}|' || {key})"
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def walk(requests: str) -> str:
    """Requests of every product one by one; all products advance together."""
    return f"""WITH RECURSIVE {PRODUCTS}, {requests}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seq) AS n FROM requests
  WHERE quantity >= 1 AND trim(coalesce(payment_method, 'none')) <> ''),
walk AS (
  SELECT id AS product_id, CAST(stock AS BIGINT) AS units, CAST(0 AS BIGINT) AS n,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS outcome
  FROM products
  UNION ALL
  SELECT w.product_id,
         CASE WHEN op = 'RELEASE' THEN units + quantity WHEN quantity <= units THEN units - quantity ELSE units END,
         r.n, r.request_id,
         CASE WHEN op = 'RELEASE' THEN 'RELEASED' WHEN quantity <= units THEN 'RESERVED' ELSE 'INSUFFICIENT' END
  FROM walk w JOIN numbered r ON r.product_id = w.product_id AND r.n = w.n + 1),
outcomes AS (
  SELECT r.*, w.units AS remaining,
         coalesce(w.outcome, CASE WHEN quantity < 1 THEN 'INVALID_QUANTITY' WHEN op = 'RELEASE' THEN 'RELEASED'
                                  ELSE 'INSUFFICIENT' END) AS outcome
  FROM requests r LEFT JOIN walk w ON w.request_id = r.request_id),
final_stock AS (
  SELECT product_id AS id, CAST(max_by(units, n) AS INT) AS stock FROM walk GROUP BY product_id)"""


STOCK_WALK = walk(STOCK_REQUESTS.replace("AS op\n", "AS op, 'none' AS payment_method\n"))
ORDER_WALK = walk(ORDER_REQUESTS)

RESERVED_STOCK = f"""{STOCK_WALK}
SELECT request_id, seq, product_id, quantity, op, outcome, remaining FROM outcomes"""

TOP_PRODUCTS = f"""WITH {PRODUCTS}, {SALES}, scored AS (
  SELECT p.category, p.id AS product_id, p.name AS product_name, count(s.id) AS total_orders,
         coalesce(sum(s.amount), 0) AS total_revenue
  FROM products p LEFT JOIN (SELECT * FROM sales WHERE status = 'CONFIRMED') s ON s.product_id = p.id
  GROUP BY p.category, p.id, p.name)
SELECT category, product_id, product_name, total_orders, CAST(total_revenue AS DOUBLE) AS total_revenue,
       CAST(rank() OVER (PARTITION BY category ORDER BY total_orders DESC, total_revenue DESC) AS INT) AS category_rank
FROM scored QUALIFY category_rank <= 5"""

MONTHS = f"""{SALES}, monthly AS (
  SELECT CAST(date_trunc('month', created_at) AS DATE) AS m, sum(amount) AS revenue
  FROM sales WHERE status = 'CONFIRMED' GROUP BY 1)"""

SPINE = """, spine AS (
  SELECT CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM monthly),
months AS (
  SELECT s.m, coalesce(x.revenue, 0) AS revenue FROM spine s LEFT JOIN monthly x ON x.m = s.m)"""


def trend(source: str) -> str:
    return f"""SELECT strftime(m, '%Y-%m') AS month, CAST(revenue AS DOUBLE) AS total_revenue,
       CAST(lag(revenue) OVER (ORDER BY m) AS DOUBLE) AS prev_month_revenue,
       round(CAST(revenue - lag(revenue) OVER (ORDER BY m) AS DOUBLE)
             / nullif(CAST(lag(revenue) OVER (ORDER BY m) AS DOUBLE), 0) * 100, 2) AS growth_pct
FROM {source}"""


LOW_STOCK = f"""WITH {PRODUCTS}
SELECT id AS product_id, name, category, stock AS current_stock,
       CASE WHEN stock = 0 THEN 'CRITICAL' WHEN stock < 5 THEN 'HIGH' ELSE 'MEDIUM' END AS urgency
FROM products WHERE stock < 10"""

REQUESTED = "requested AS (SELECT DISTINCT o_custkey * 2 AS id FROM orders)"

DELETE_REJECTS = """ranked AS (
  SELECT o_orderkey AS request_id, o_orderkey AS seq, o_custkey * 2 AS id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
delete_rejects AS (
  SELECT request_id, seq, id, 'Product not found' AS reasons FROM ranked
  WHERE n > 1 OR id NOT IN (SELECT p_partkey FROM part))"""

TRANSITIONS = f"""WITH {HISTORY}, steps AS (
  SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY seq) AS previous_status FROM history)
SELECT order_id, seq, status, previous_status FROM steps
WHERE NOT (status = 'FAILED' OR (previous_status IS NULL AND status = 'PENDING')
  OR coalesce(previous_status || '>' || status IN
     ('PENDING>PAYMENT_CONFIRMED', 'PAYMENT_CONFIRMED>STOCK_RESERVED', 'STOCK_RESERVED>CONFIRMED'), false))"""

ROUTED = f'WITH {MESSAGES} SELECT event_id, "eventType", "entityId", outcome FROM messages'

OUTCOMES = f"""WITH {MESSAGES}
SELECT "eventType", outcome, count(*) AS messages, outcome <> 'failed' AS acknowledged
FROM messages GROUP BY "eventType", outcome"""

DELIVERIES = """WITH log AS (
  SELECT CAST(user_id AS VARCHAR) AS message_id, event_id AS seq, ts,
         CASE event_type WHEN 'view' THEN 'DELIVERED' WHEN 'purchase' THEN 'ACKED' ELSE 'FAILED' END AS kind
  FROM events),
beside AS (
  SELECT *, lead(kind) OVER w AS next_kind, lead(ts) OVER w AS next_ts, lag(kind) OVER w AS before_kind, lag(ts) OVER w AS before_ts
  FROM log WINDOW w AS (PARTITION BY message_id ORDER BY seq)),
settled AS (
  SELECT message_id, seq,
         CASE WHEN kind = 'DELIVERED' THEN
                CASE WHEN next_kind IS NULL OR next_kind = 'DELIVERED' OR next_ts - ts >= INTERVAL 30 SECOND THEN 'FAILED' END
              WHEN kind = 'ACKED' OR NOT coalesce(before_kind = 'DELIVERED' AND ts - before_ts >= INTERVAL 30 SECOND, false) THEN kind END AS outcome
  FROM beside),
runs AS (
  SELECT *, count(*) FILTER (WHERE outcome = 'ACKED') OVER (PARTITION BY message_id ORDER BY seq) AS run FROM settled WHERE outcome IS NOT NULL),
failures AS (
  SELECT message_id, run, seq, row_number() OVER (PARTITION BY message_id, run ORDER BY seq) AS nth FROM runs WHERE outcome = 'FAILED'),
dead AS (SELECT message_id, min(seq) AS dead_at FROM failures WHERE nth = 5 GROUP BY message_id),
last AS (SELECT message_id, max(run) AS run FROM runs GROUP BY message_id),
open_runs AS (SELECT l.message_id, count(f.seq) AS n FROM last l LEFT JOIN failures f ON f.message_id = l.message_id AND f.run = l.run GROUP BY l.message_id)
SELECT o.message_id, CASE WHEN dead_at IS NOT NULL THEN 'DEAD' WHEN n > 0 THEN 'FAILED' ELSE 'ACKED' END AS state,
       CASE WHEN dead_at IS NOT NULL THEN 5 ELSE n END AS failures, dead_at
FROM open_runs o LEFT JOIN dead d ON d.message_id = o.message_id"""

DEDUPLICATED = f"""WITH {MESSAGES}
SELECT CAST(event_id AS VARCHAR) AS message_id, "eventType", outcome,
       CAST(CASE WHEN outcome <> 'failed' THEN 1 WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS deliveries
FROM messages"""

DEAD_LETTERS = f"""WITH {MESSAGES}
SELECT message_id, count(*) AS attempts, arg_max(raw, event_id) AS raw FROM messages WHERE outcome = 'failed' GROUP BY message_id HAVING count(*) >= 5"""

MONEY_OF = """round_even(CASE WHEN quantity > 10 THEN {unit} * quantity * CAST(0.90 AS DECIMAL(3,2))
  ELSE {unit} * quantity * CAST(1.00 AS DECIMAL(3,2)) END, 2)"""

UNIT_TOTAL = MONEY_OF.format(unit="CAST(99.99 AS DECIMAL(19,2))")
LIST_TOTAL = MONEY_OF.format(unit="price")


def _prefix(text: str, units: int) -> str:
    """The longest beginning whose characters, those above U+FFFF counted twice, come to ``units`` at most."""
    wide = f"length(regexp_replace(substr({text}, 1, i), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
    return f"substr({text}, 1, len(list_filter(range(1, least({units}, length({text})) + 1), lambda i: i + {wide} <= {units})))"


# The wording of reasons, mails and prompts below and above is that of the operators.

ORACLES: dict[str, str] = {
    "top_products_by_category": TOP_PRODUCTS,
    "top_products_api": TOP_PRODUCTS,
    "monthly_revenue_trend": f"WITH {MONTHS}{SPINE} {trend('months')}",
    "monthly_revenue_trend_sparse": f"WITH {MONTHS} {trend('monthly')}",
    "monthly_revenue_api": f"""SELECT month, total_revenue, coalesce(growth_pct, 0) AS growth_pct
FROM (WITH {MONTHS}{SPINE} {trend('months')})""",
    "customer_order_summary": f"""WITH {PRODUCTS}, {SALES}
SELECT customer_id, count(*) AS order_count, CAST(sum(amount) AS DOUBLE) AS lifetime_value,
       round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS avg_order_value,
       min(s.created_at) AS first_order_at, max(s.created_at) AS last_order_at,
       string_agg(DISTINCT category, ', ' ORDER BY category) AS categories_purchased
FROM sales s JOIN products p ON p.id = s.product_id WHERE status = 'CONFIRMED' GROUP BY customer_id""",
    "low_stock_alerts": LOW_STOCK,
    "low_stock_api": LOW_STOCK,
    "materialized_report": LOW_STOCK,
    "top_customers": f"""WITH {SALES}, spent AS (
  SELECT customer_id, sum(amount) AS total, count(*) AS n FROM sales
  WHERE status = 'CONFIRMED' AND created_at >= {AS_OF} - INTERVAL 30 DAY GROUP BY customer_id)
SELECT customer_id, CAST(total AS DOUBLE) AS total_spent, n AS order_count,
       CAST((CAST(total * 100 AS HUGEINT) * 2 + n) // (2 * n) AS DOUBLE) / 100 AS avg_ticket,
       CAST(rank() OVER (ORDER BY total DESC) AS INT) AS spend_rank
FROM spent QUALIFY spend_rank <= 5""",
    "daily_sales": f"""WITH {PRODUCTS}, {SALES}, days AS (
  SELECT CAST(unnest(generate_series({AS_OF} - INTERVAL 6 DAY, {AS_OF}, INTERVAL 1 DAY)) AS DATE) AS sale_day),
kinds AS (SELECT DISTINCT category FROM products),
sold AS (
  SELECT CAST(s.created_at AS DATE) AS sale_day, category, sum(amount) AS revenue, sum(quantity) AS units, count(*) AS n
  FROM sales s JOIN products p ON p.id = s.product_id
  WHERE status = 'CONFIRMED' AND s.created_at >= {AS_OF} - INTERVAL 6 DAY GROUP BY 1, 2)
SELECT d.sale_day, k.category, CAST(coalesce(revenue, 0) AS DOUBLE) AS revenue,
       CAST(coalesce(units, 0) AS BIGINT) AS units_sold, coalesce(n, 0) AS order_count
FROM days d CROSS JOIN kinds k LEFT JOIN sold x ON x.sale_day = d.sale_day AND x.category = k.category""",
    "critical_stock": f"""WITH {PRODUCTS}, {SALES}, sold AS (
  SELECT product_id, CAST(sum(quantity) AS BIGINT) AS sales_total FROM sales
  WHERE status = 'CONFIRMED' AND created_at >= {AS_OF} - INTERVAL 365 DAY GROUP BY product_id)
SELECT product_id, name, category, stock AS current_stock, sales_total,
       CASE WHEN stock = 0 THEN 'OUT_OF_STOCK' WHEN stock < 5 THEN 'CRITICAL' ELSE 'LOW' END AS urgency
FROM products JOIN sold ON product_id = id WHERE stock < 10 AND sales_total > 50""",
    "order_count_report": "SELECT 'Total orders processed: ' || count(*) AS report FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "confirmed_orders": f"""WITH {SALES}
SELECT id, customer_id, product_id, quantity, CAST(amount AS DOUBLE) AS amount, created_at FROM sales WHERE status = 'CONFIRMED'""",
    "recent_orders": f"""WITH {SALES}
SELECT id, product_id, CAST(amount AS DOUBLE) AS amount, status, created_at FROM sales
WHERE created_at >= {AS_OF} - INTERVAL 30 DAY""",
    "low_stock": f"WITH {PRODUCTS} SELECT id, stock FROM products WHERE stock < 10",
    "product_response": f"""WITH {PRODUCTS}
SELECT id, name, description, CAST(price AS DOUBLE) AS price, currency, stock, category, created_at AS "createdAt" FROM products""",
    "order_response": f"""WITH {SALES}
SELECT id, customer_id AS "customerId", product_id AS "productId", quantity, CAST(amount AS DOUBLE) AS amount,
       'USD' AS currency, status, CAST(NULL AS VARCHAR) AS "paymentReference", created_at AS "createdAt" FROM sales""",
    "find_by_ids": f"WITH {PRODUCTS}, {REQUESTED} SELECT id, name, stock FROM products WHERE id IN (SELECT id FROM requested)",
    "find_missing": f"WITH {PRODUCTS}, {REQUESTED} SELECT id FROM requested WHERE id NOT IN (SELECT id FROM products)",
    "exists": f"WITH {PRODUCTS}, {REQUESTED} SELECT id FROM requested WHERE id IN (SELECT id FROM products)",
    "availability": f"""WITH {PRODUCTS}, {STOCK_REQUESTS}
SELECT request_id, product_id, coalesce(stock >= quantity, false) AS available
FROM requests LEFT JOIN products ON id = product_id""",
    "order_page": f"""WITH {HEADERS}
SELECT id, customer_id, CAST(amount AS DOUBLE) AS amount, status, created_at
FROM headers ORDER BY created_at, id LIMIT 20 OFFSET 60""",
    "order_line_page": f"""WITH {SALES}
SELECT id, customer_id, status, created_at FROM sales ORDER BY created_at, id LIMIT 20 OFFSET 4000""",
    "order_line_total": f"""WITH {SALES}
SELECT id, created_at, (SELECT count(*) FROM sales) AS total FROM sales ORDER BY created_at, id LIMIT 20 OFFSET 40""",
    "stored_products": f"""WITH {PRODUCTS}
SELECT CAST(id AS VARCHAR) AS id, name, description, CAST(price AS DOUBLE) AS price, currency, stock, category, created_at,
       CAST(0 AS BIGINT) AS version FROM products""",
    "stored_orders": f"""WITH {SALES}
SELECT CAST(id AS VARCHAR) AS id, CAST(customer_id AS VARCHAR) AS customer_id, CAST(product_id AS VARCHAR) AS product_id, quantity,
       CAST(amount AS DOUBLE) AS amount, 'USD' AS currency, status, created_at FROM sales""",
    "stored_event_stream": f'WITH {MESSAGES} SELECT message_id, "eventType", "entityId" FROM messages',
    "product_page": f"WITH {PRODUCTS} SELECT id, name, created_at FROM products ORDER BY created_at, id LIMIT 20 OFFSET 20",
    "order_positions": f"WITH {HEADERS} SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM headers",
    "normalized_currency": "SELECT l_orderkey, l_linenumber, 'USD' AS currency, 3 AS width FROM lineitem",
    "duplicate_keys": """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "orphan_orders": f"""WITH {STOCK_REQUESTS}
SELECT request_id, product_id, quantity FROM requests WHERE product_id NOT IN (SELECT p_partkey FROM part)""",
    "check_violations": f"""WITH {CREATE_REQUESTS}, drafts AS (
  SELECT request_id AS id, concat_ws('; ',
    CASE WHEN description IS NULL THEN 'description is null' END,
    CASE WHEN price <= 0 THEN 'price > 0' END,
    CASE WHEN stock < 0 THEN 'stock >= 0' END) AS reasons FROM requests)
SELECT id, reasons FROM drafts WHERE reasons <> ''""",
    "order_violations": f"""WITH {ORDER_REQUESTS}
SELECT request_id AS id, 'quantity > 0; amount >= 0' AS reasons FROM requests WHERE quantity <= 0""",
    "invalid_requests": f"""WITH {STOCK_REQUESTS}
SELECT request_id, 'quantity must be at least 1' AS reasons FROM requests WHERE quantity < 1""",
    "invalid_events": f"""WITH {MESSAGES}
SELECT event_id, concat_ws('; ',
  'eventType must be one of the following values: PRODUCT_CREATED, PRODUCT_UPDATED, PRODUCT_DELETED',
  CASE WHEN "entityId" IS NULL THEN 'entityId should not be empty' END) AS reasons
FROM messages WHERE outcome <> 'handled'""",
    "stock_drift": f"""WITH {PRODUCTS}, counters AS (
  SELECT user_id * 20 AS product_id, CAST(count(*) % 50 AS INT) AS counter FROM events GROUP BY user_id)
SELECT coalesce(p.id, c.product_id) AS product_id, stock, counter, counter - stock AS drift
FROM products p FULL OUTER JOIN counters c ON c.product_id = p.id
WHERE counter - stock IS NULL OR counter <> stock""",
    "create_products": f"""WITH {CREATE_REQUESTS}
SELECT {uuid('product', 'request_id')} AS id, name, description, CAST(round_even(price, 2) AS DOUBLE) AS price,
       'USD' AS currency, stock, category, {AS_OF} AS created_at, CAST(0 AS BIGINT) AS version
FROM checked WHERE reasons = ''""",
    "update_products": f"""WITH {PRODUCTS}, {UPDATE_REQUESTS}, latest AS (
  SELECT * FROM requests WHERE stock >= 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1)
SELECT p.id, coalesce(u.name, p.name) AS name, coalesce(u.description, p.description) AS description,
       CAST(CASE WHEN u.id IS NULL THEN p.price ELSE round_even(u.price, 2) END AS DOUBLE) AS price,
       CAST(coalesce(u.stock, p.stock) AS INT) AS stock, coalesce(u.category, p.category) AS category
FROM products p LEFT JOIN latest u ON u.id = p.id""",
    "stock_adjustments": f"""WITH {PRODUCTS}, {UPDATE_REQUESTS}, latest AS (
  SELECT * FROM requests WHERE stock >= 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY request_id DESC) = 1)
SELECT p.id, CASE WHEN u.stock > p.stock THEN 'INCREASE' ELSE 'DECREASE' END AS direction,
       CAST(abs(u.stock - p.stock) AS INT) AS units
FROM products p JOIN latest u ON u.id = p.id WHERE u.stock <> p.stock""",
    "update_rejects": f"""WITH {UPDATE_REQUESTS}
SELECT request_id, id, CASE WHEN stock < 0 THEN 'Stock cannot be negative' ELSE 'Product not found' END AS reasons
FROM requests WHERE stock < 0 OR id NOT IN (SELECT p_partkey FROM part)""",
    "versioned_updates": f"""WITH RECURSIVE {PRODUCTS}, {VERSIONED}, made AS (
  SELECT id, max(request_id) AS request_id, count(*) AS n FROM chain GROUP BY id)
SELECT p.id, coalesce(v.name, p.name) AS name, CAST(CASE WHEN v.id IS NULL THEN p.price ELSE round_even(v.price, 2) END AS DOUBLE) AS price,
       CAST(coalesce(v.stock, p.stock) AS INT) AS stock, coalesce(v.category, p.category) AS category, coalesce(m.n, 0) AS version
FROM products p LEFT JOIN made m ON m.id = p.id LEFT JOIN valid v ON v.request_id = m.request_id""",
    "versioned_update_errors": f"""WITH RECURSIVE {VERSIONED}
SELECT request_id, id, CAST(CASE WHEN stock < 0 THEN 400 WHEN id NOT IN (SELECT p_partkey FROM part) THEN 404 ELSE 409 END AS INT) AS status,
       CASE WHEN stock < 0 THEN 'Stock cannot be negative' WHEN id NOT IN (SELECT p_partkey FROM part) THEN 'Product not found'
            ELSE 'Product was changed by another request' END AS message
FROM requests WHERE request_id NOT IN (SELECT request_id FROM chain)""",
    "delete_products": f"""WITH {PRODUCTS}, {REQUESTED}
SELECT id, name FROM products WHERE id NOT IN (SELECT id FROM requested)""",
    "delete_unordered_products": f"""WITH {PRODUCTS}, {REQUESTED}
SELECT id, name FROM products WHERE id NOT IN (SELECT id FROM requested) OR id IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    "delete_unordered_rejects": f"""WITH {DELETE_REJECTS}, sold AS (SELECT DISTINCT l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT request_id, seq, id, 'Product has orders' AS reasons FROM ranked WHERE id IN (SELECT p FROM sold) AND id IN (SELECT p_partkey FROM part)
UNION ALL SELECT request_id, seq, id, reasons FROM delete_rejects WHERE id NOT IN (SELECT p FROM sold) OR id NOT IN (SELECT p_partkey FROM part)""",
    "delete_rejects": f"WITH {DELETE_REJECTS} SELECT request_id, seq, id, reasons FROM delete_rejects",
    "combined_money": """WITH lines AS (
  SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(19,2)) AS price,
         CAST(o_totalprice AS DECIMAL(19,2)) AS total, l_returnflag = 'R' AS foreign_money
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber,
       CASE WHEN NOT foreign_money THEN CAST(price + total AS DOUBLE) END AS added,
       CASE WHEN foreign_money THEN 'CURRENCY_MISMATCH' END AS add_error,
       CASE WHEN NOT foreign_money AND price >= total THEN CAST(price - total AS DOUBLE) END AS subtracted,
       CASE WHEN foreign_money THEN 'CURRENCY_MISMATCH' WHEN price < total THEN 'NEGATIVE_MONEY' END AS subtract_error
FROM lines""",
    "reserved_stock": RESERVED_STOCK,
    "reserved_stock_split": RESERVED_STOCK,
    "reserved_stock_stream": RESERVED_STOCK,
    "reserved_stock_batches": RESERVED_STOCK,
    "stock_after_reservation": f"{STOCK_WALK} SELECT id, stock FROM final_stock",
    "price_orders": f"""WITH {SALES}
SELECT id, product_id, quantity, CAST({UNIT_TOTAL} AS DOUBLE) AS amount FROM sales""",
    "price_orders_list": f"""WITH {PRODUCTS}, {SALES}
SELECT s.id, product_id, quantity, CAST({LIST_TOTAL} AS DOUBLE) AS amount FROM sales s JOIN products p ON p.id = product_id""",
    "route_payment": f"""WITH {ORDER_REQUESTS}
SELECT request_id, payment_method, lower(payment_method) || '_' || {uuid('payment', 'request_id')} AS payment_ref
FROM requests WHERE payment_method IN ('STRIPE', 'PAYPAL', 'CRYPTO')""",
    "route_payment_rejects": f"""WITH {ORDER_REQUESTS}
SELECT request_id, 'Unknown payment method: ' || payment_method AS reasons
FROM requests WHERE payment_method NOT IN ('STRIPE', 'PAYPAL', 'CRYPTO')""",
    "place_orders": f"""{ORDER_WALK}
SELECT {uuid('order', 'request_id')} AS id, customer_id, product_id, quantity,
       CAST({UNIT_TOTAL} AS DOUBLE) AS amount, 'USD' AS currency, 'CONFIRMED' AS status,
       'stripe_' || {uuid('payment', 'request_id')} AS payment_ref, {AS_OF} AS created_at
FROM outcomes WHERE outcome = 'RESERVED'""",
    "place_orders_rejects": f"""{ORDER_WALK}, refused AS (
  SELECT *, concat_ws('; ', CASE WHEN quantity < 1 THEN 'quantity must be at least 1' END,
                      CASE WHEN trim(payment_method) = '' THEN 'paymentMethod is required' END) AS problems
  FROM outcomes WHERE outcome <> 'RESERVED')
SELECT request_id, CASE WHEN problems = '' THEN 422 ELSE 400 END AS status,
       CASE WHEN problems = '' THEN 'Product ' || product_id || ' does not have enough stock for quantity ' || quantity
            ELSE problems END AS message
FROM refused""",
    "place_orders_stock": f"{ORDER_WALK} SELECT id, stock FROM final_stock",
    "check_order_transitions": TRANSITIONS,
    "check_order_transitions_split": TRANSITIONS,
    "current_status": f"WITH {HISTORY} SELECT order_id, max_by(status, seq) AS status FROM history GROUP BY order_id",
    "error_status": f"""WITH {CREATE_REQUESTS}, {DELETE_REJECTS}
SELECT 'create-' || request_id AS request_id, 400 AS status, reasons AS message FROM checked WHERE reasons <> ''
UNION ALL
SELECT 'delete-' || request_id, 404, reasons FROM delete_rejects""",
    "product_events": f"""WITH {PRODUCTS}
SELECT 'PRODUCT_CREATED' AS "eventType", CAST(id AS VARCHAR) AS "entityId", name, CAST(price AS DOUBLE) AS price, stock,
       CAST(stock < 10 AS VARCHAR) AS low_stock, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at
FROM products""",
    "order_placed_events": f'WITH {SALES} SELECT CAST(id AS VARCHAR) AS "orderId", CAST(customer_id AS VARCHAR) AS "customerId", status FROM sales',
    "routed_events": ROUTED,
    "delivery_states": DELIVERIES,
    "delivery_states_stream": DELIVERIES,
    "deduplicated_events": DEDUPLICATED,
    "deduplicated_events_stream": DEDUPLICATED,
    "routed_events_stream": ROUTED,
    "product_event_outcomes": OUTCOMES,
    "product_event_outcomes_stream": OUTCOMES,
    "delivery_counters": f"""WITH {MESSAGES}, per_message AS (
  SELECT message_id, count(*) AS n, count(*) FILTER (WHERE outcome = 'failed') AS bad FROM messages GROUP BY message_id)
SELECT CAST(sum(n) AS BIGINT) AS processed, CAST(sum(n - bad) AS BIGINT) AS acked, CAST(sum(bad) AS BIGINT) AS nacked,
       count(*) FILTER (WHERE bad >= 5) AS dead_lettered
FROM per_message""",
    "dead_letter": DEAD_LETTERS,
    "dead_letter_stream": DEAD_LETTERS,
    "route_notifications": f"""WITH {NOTIFY}
SELECT turn, "userId", channel,
       CASE channel WHEN 'email' THEN {_prefix('message', 80)} WHEN 'push' THEN {_prefix('message', 60)}
                    WHEN 'slack' THEN {_prefix('message', 100)} END AS preview,
       CASE WHEN channel = 'sms'
            THEN CAST(length(message) + length(regexp_replace(message, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS INT) END AS chars
FROM notify WHERE channel <> 'fax' AND message <> ''""",
    "route_notifications_rejects": f"""WITH {NOTIFY}
SELECT "userId", turn, CASE WHEN message = '' OR message IS NULL THEN 'message should not be empty'
  ELSE 'Unknown channel ''fax''. Registered channels: email, sms, push, slack' END AS reasons
FROM notify WHERE channel = 'fax' OR message = '' OR message IS NULL""",
    "order_confirmations": f"""WITH {SALES}
SELECT customer_id || '@example.com' AS recipient, CAST(id AS VARCHAR) AS order_id, CAST(amount AS DOUBLE) AS total,
       'Order Confirmation' AS subject,
       'Dear customer,' || chr(10) || chr(10) || 'Your order ' || id || ' has been placed.' || chr(10) || 'Total: $'
       || amount || chr(10) || chr(10) || 'Thank you!' AS body
FROM sales""",
    "notification_prompts": f"""WITH {MESSAGES}
SELECT event_id, 'Event: ' || "eventType" || chr(10)
  || CASE "eventType" WHEN 'PRODUCT_CREATED' THEN 'A new product has just been added to the catalog.'
          WHEN 'PRODUCT_UPDATED' THEN 'An existing product has been updated (price, description, or stock).'
          WHEN 'PRODUCT_DELETED' THEN 'A product has been removed from the catalog.'
          ELSE 'Event type: ' || "eventType" END
  || CASE WHEN payload IS NOT NULL THEN chr(10) || 'Product details: ' || payload ELSE '' END || chr(10)
  || 'Target audience: ' || CASE WHEN event_id % 3 = 0 THEN 'premium VIP customer' ELSE 'general customer' END
  || chr(10) || chr(10) || 'Generate an appropriate notification for this event.' AS prompt
FROM messages WHERE outcome <> 'failed'""",
    "parse_replies": """SELECT conv_id, turn, substr(text, 1, 70) AS subject, text AS body,
       CASE WHEN conv_id % 2 = 0 THEN 'email' ELSE 'pager' END AS channel,
       length(substr(text, 1, 70)) + length(regexp_replace(substr(text, 1, 70), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 60
         AS subject_too_long,
       conv_id % 2 <> 0 AS channel_unlisted
FROM conversations WHERE turn % 5 IN (0, 1) AND text <> ''""",
    "parse_replies_rejects": "SELECT conv_id, turn FROM conversations WHERE turn % 5 NOT IN (0, 1) OR text = '' OR text IS NULL",
    "post_order_fanout": f"""WITH {HEADERS}
SELECT CAST(id AS VARCHAR) AS order_id, customer_id || '@example.com' AS recipient, CAST(amount AS DOUBLE) AS total, status
FROM headers""",
}

# Other ways to the same results.
ORACLES |= {
    name: ORACLES[same]
    for name, same in {
        "stock_drift_by_digest": "stock_drift",
        "order_page_by_seek": "order_line_page",
        "order_positions_by_seek": "order_positions",
        "critical_stock_clustered": "critical_stock",
        "refreshed_revenue_trend": "monthly_revenue_trend",
        "refreshed_top_products": "top_products_by_category",
        "refreshed_customer_summary": "customer_order_summary",
        "reserved_stock_reordered": "reserved_stock",
        "check_order_transitions_stream": "check_order_transitions",
    }.items()
}

ORACLES["category_sales_clustered"] = f"""WITH {PRODUCTS}, {SALES}
SELECT product_id, CAST(sum(quantity) AS BIGINT) AS units_sold, count(*) AS order_count
FROM sales s JOIN products p ON p.id = s.product_id
WHERE status = 'CONFIRMED' AND s.created_at >= {AS_OF} - INTERVAL 365 DAY AND category = (SELECT min(category) FROM products)
GROUP BY product_id"""

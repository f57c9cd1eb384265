"""The adapter views in plain SQL, as common table expressions for the oracle queries."""

from __future__ import annotations

_CCY = "(['USD','EUR','GBP','CHF','JPY'])[CAST({n} % 5 AS INT) + 1]"


def ccy(n: str) -> str:
    return _CCY.format(n=n)


VIEWS: dict[str, tuple[list[str], str]] = {
    "v_trades": ([], f"""
        SELECT l_suppkey AS portfolio_id, l_partkey % 20 AS instrument_key,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
               l_shipdate AS ts, CAST(l_shipdate AS DATE) AS date, {ccy('(l_partkey % 20)')} AS currency,
               CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity,
               l_extendedprice / l_quantity / 0.9973e0 AS price, l_extendedprice * l_tax / 100e0 / 0.9973e0 AS fees
        FROM lineitem"""),
    "v_fx": ([], """
        SELECT p.base, p.quote, date, 0.5e0 + (x % 1000) / 1000e0 AS rate
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n
              FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1) d,
             LATERAL (VALUES ('USD','EUR',lo), ('USD','GBP',hi), ('EUR','CHF',n)) AS p(base, quote, x)"""),
    # last rate on or before each day, at most ten days old
    "x_asof": (["v_fx"], """
        SELECT q.base, q.quote, q.day, f.rate, f.date AS rate_date
        FROM (SELECT base, quote, day FROM (SELECT DISTINCT base, quote FROM v_fx),
              (SELECT CAST(unnest(generate_series(TIMESTAMP '1994-12-01', TIMESTAMP '2003-12-31', INTERVAL 1 DAY)) AS DATE) AS day)) q
        ASOF JOIN v_fx f ON q.base = f.base AND q.quote = f.quote AND q.day >= f.date
        WHERE q.day - f.date <= 10"""),
    "x_direct": (["x_asof"], """
        SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, coalesce(a.day, b.day) AS day,
               coalesce(a.rate, b.rate) AS rate, CASE WHEN a.rate IS NOT NULL THEN a.rate_date ELSE b.rate_date END AS rate_date
        FROM (SELECT base AS src, quote AS dst, day, rate, rate_date FROM x_asof) a
        FULL JOIN (SELECT quote AS src, base AS dst, day, 1e0 / rate AS rate, rate_date FROM x_asof) b
        ON a.src = b.src AND a.dst = b.dst AND a.day = b.day"""),
    "v_rate": (["x_direct"], """
        SELECT src, dst, day, rate, rate_date, via FROM (
          SELECT *, row_number() OVER (PARTITION BY src, dst, day ORDER BY pref, via) AS pick FROM (
            SELECT src, dst, day, rate, rate_date, CAST(NULL AS VARCHAR) AS via, -1 AS pref FROM x_direct
            UNION ALL
            SELECT a.src, b.dst, a.day, a.rate * b.rate, least(a.rate_date, b.rate_date), a.dst,
                   CASE a.dst WHEN 'EUR' THEN 1 WHEN 'USD' THEN 2 ELSE 3 END
            FROM x_direct a JOIN x_direct b ON a.dst = b.src AND a.day = b.day AND a.src <> b.dst))
        WHERE pick = 1"""),
    "v_settings": ([], """
        SELECT p AS portfolio_id, CASE WHEN p % 2 = 0 THEN 'EUR' ELSE 'USD' END AS base_currency,
               CASE WHEN p % 3 = 0 THEN 'AVERAGE' ELSE 'FIFO' END AS method
        FROM (SELECT DISTINCT l_suppkey AS p FROM lineitem UNION SELECT DISTINCT o_custkey % 100 FROM orders)"""),
    "v_dist": ([], f"""
        SELECT o_custkey % 100 AS portfolio_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 20 END AS instrument_key,
               CASE WHEN o_orderkey % 11 <> 0 THEN 'ISIN' || CAST(o_custkey % 20 AS VARCHAR) END AS isin,
               o_orderkey AS id, CAST(o_orderdate AS DATE) AS pay_date,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 45 AS INT) END AS ex_date,
               {ccy('(o_custkey % 20)')} AS currency, o_totalprice / 0.9973e0 AS gross,
               CASE WHEN o_custkey % 2 = 0 THEN o_totalprice / 0.9973e0 * 15e0 / 100e0 ELSE 0e0 END AS tax,
               (o_orderkey % 100 + 1) / 100e0 AS per_share,
               o_orderpriority = '5-LOW' AS irregular
        FROM orders"""),
    # payments in base, with the group they belong to
    "v_pay": (["v_dist", "v_rate", "v_settings"], """
        SELECT d.portfolio_id, d.pay_date, d.id,
               coalesce(CAST(d.instrument_key AS VARCHAR), CAST(l.k AS VARCHAR), d.isin, '__unknown') AS group_key,
               d.gross * (CASE WHEN d.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS gross,
               d.tax * (CASE WHEN d.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS tax
        FROM v_dist d JOIN v_settings s USING (portfolio_id)
        LEFT JOIN v_rate r ON r.src = d.currency AND r.dst = s.base_currency AND r.day = d.pay_date
        LEFT JOIN (SELECT portfolio_id, isin, arg_min(instrument_key, id) AS k FROM v_dist
                   WHERE NOT irregular AND instrument_key IS NOT NULL AND isin IS NOT NULL GROUP BY 1, 2) l
        ON l.portfolio_id = d.portfolio_id AND l.isin = d.isin
        WHERE NOT d.irregular"""),
    "v_cash": ([], f"""
        SELECT o_custkey % 100 AS portfolio_id, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date,
               CASE o_orderstatus WHEN 'F' THEN 'DEPOSIT' WHEN 'O' THEN 'WITHDRAWAL' ELSE 'INTEREST' END AS kind,
               (CASE WHEN o_orderstatus = 'O' THEN -o_totalprice ELSE o_totalprice END) / 0.9973e0 AS amount, {ccy('(o_custkey % 4)')} AS currency
        FROM orders"""),
    "v_flows_base": (["v_cash", "v_rate", "v_settings"], """
        SELECT c.portfolio_id, c.id, c.date, c.amount * (CASE WHEN c.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS amount_base
        FROM v_cash c JOIN v_settings s USING (portfolio_id)
        LEFT JOIN v_rate r ON r.src = c.currency AND r.dst = s.base_currency AND r.day = c.date
        WHERE c.kind <> 'INTEREST'"""),
    "v_daily": ([], """
        SELECT portfolio_id, date, 5000e0 + CAST(sum(cents) OVER (PARTITION BY portfolio_id ORDER BY date) AS BIGINT) / 100e0 AS value
        FROM (SELECT user_id AS portfolio_id, CAST(ts AS DATE) AS date,
                     sum(CAST(round((CASE WHEN event_type IN ('error','click') THEN -value ELSE value END) * 100) AS BIGINT)) AS cents
              FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)"""),
    "v_points": ([], """
        SELECT user_id AS portfolio_id, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS date,
               value * (CASE WHEN event_id % 5 = 0 THEN -1e0 ELSE 1e0 END) AS amount
        FROM events WHERE event_type = 'signup'"""),
    # fills with running position, uncovered shares and cumulative axes
    "x_fill0": (["v_trades"], """
        SELECT *, CASE WHEN quantity > 0 THEN 0 ELSE 1 END AS side, abs(quantity) * price AS worth,
               row_number() OVER w AS rn, sum(quantity) OVER w AS net
        FROM v_trades WINDOW w AS (PARTITION BY portfolio_id, instrument_key ORDER BY ts, CASE WHEN quantity > 0 THEN 0 ELSE 1 END, id ROWS UNBOUNDED PRECEDING)"""),
    "x_fill1": (["x_fill0"], """
        SELECT *, greatest(0, -min(net) OVER w) AS short FROM x_fill0
        WINDOW w AS (PARTITION BY portfolio_id, instrument_key ORDER BY rn ROWS UNBOUNDED PRECEDING)"""),
    "x_fill": (["x_fill1"], """
        SELECT *, net + short AS held, CASE WHEN side = 1 THEN -quantity - unc ELSE 0 END AS covered,
               sum(CASE WHEN side = 0 THEN quantity ELSE 0 END) OVER w AS bought,
               sum(CASE WHEN side = 1 THEN -quantity - unc ELSE 0 END) OVER w AS sold
        FROM (SELECT *, short - lag(short, 1, 0) OVER (PARTITION BY portfolio_id, instrument_key ORDER BY rn) AS unc FROM x_fill1)
        WINDOW w AS (PARTITION BY portfolio_id, instrument_key ORDER BY rn ROWS UNBOUNDED PRECEDING)"""),
    # sale x lot by overlap of their intervals on the cumulative axis
    "v_cons": (["x_fill"], """
        SELECT s.portfolio_id, s.instrument_key, s.currency, s.id AS sale_id, s.date AS sale_date, b.id AS lot_id, b.date AS lot_date,
               least(s.sold, b.bought) - greatest(s.sold - s.covered, b.bought - b.quantity) AS quantity,
               (least(s.sold, b.bought) - greatest(s.sold - s.covered, b.bought - b.quantity)) * (b.price + b.fees / b.quantity) AS cost
        FROM x_fill s JOIN x_fill b ON s.portfolio_id = b.portfolio_id AND s.instrument_key = b.instrument_key
             AND s.side = 1 AND b.side = 0 AND s.sold > b.bought - b.quantity AND s.sold - s.covered < b.bought"""),
    "v_open": (["x_fill"], """
        SELECT b.portfolio_id, b.instrument_key, b.currency, b.id AS lot_id, b.date AS lot_date,
               b.bought - greatest(t.sold, b.bought - b.quantity) AS quantity, b.price AS unit_cost, b.fees / b.quantity AS fee_per_share,
               (b.bought - greatest(t.sold, b.bought - b.quantity)) * (b.price + b.fees / b.quantity) AS cost
        FROM x_fill b JOIN (SELECT portfolio_id, instrument_key, max(sold) AS sold FROM x_fill GROUP BY 1, 2) t USING (portfolio_id, instrument_key)
        WHERE b.side = 0 AND b.bought > t.sold"""),
    # moving average replayed row by row
    "x_avg": (["x_fill"], """
        SELECT portfolio_id, instrument_key, rn, CASE WHEN side = 0 THEN worth + fees ELSE 0e0 END AS kept, 0e0 AS taken FROM x_fill WHERE rn = 1
        UNION ALL
        SELECT f.portfolio_id, f.instrument_key, f.rn,
               CASE WHEN f.side = 0 THEN a.kept + f.worth + f.fees WHEN f.held <= 0 THEN 0e0 ELSE a.kept - a.kept / p.held * f.covered END,
               CASE WHEN f.side = 0 THEN 0e0 WHEN f.held <= 0 THEN a.kept ELSE a.kept / p.held * f.covered END
        FROM x_avg a JOIN x_fill f ON f.portfolio_id = a.portfolio_id AND f.instrument_key = a.instrument_key AND f.rn = a.rn + 1
        JOIN x_fill p ON p.portfolio_id = a.portfolio_id AND p.instrument_key = a.instrument_key AND p.rn = a.rn"""),
    "v_sales": (["x_fill", "v_cons", "x_avg"], """
        SELECT f.portfolio_id, f.instrument_key, f.currency, f.id AS sale_id, f.date AS sale_date, -f.quantity AS quantity,
               f.worth - f.fees AS proceeds_net, coalesce(c.cost, 0e0) AS cost_fifo, a.taken AS cost_average, f.unc AS uncovered
        FROM x_fill f JOIN x_avg a USING (portfolio_id, instrument_key, rn)
        LEFT JOIN (SELECT portfolio_id, instrument_key, sale_id, sum(cost) AS cost FROM v_cons GROUP BY 1, 2, 3) c
        ON c.portfolio_id = f.portfolio_id AND c.instrument_key = f.instrument_key AND c.sale_id = f.id
        WHERE f.side = 1"""),
    "v_ledger": (["x_fill", "x_avg", "v_open", "v_sales"], """
        SELECT f.*, coalesce(o.cost, 0e0) AS cost_fifo, coalesce(s.rf, 0e0) AS realized_fifo, coalesce(s.ra, 0e0) AS realized_average
        FROM (SELECT portfolio_id, instrument_key, arg_min(f.currency, rn) AS currency, arg_max(f.held, rn) AS quantity, arg_max(a.kept, rn) AS cost_average,
                     sum(CASE WHEN side = 0 THEN worth + fees ELSE 0e0 END) AS total_cost, sum(CASE WHEN side = 1 THEN worth - fees ELSE 0e0 END) AS total_proceeds,
                     sum(fees) AS total_fees, sum(unc) AS uncovered,
                     count(*) FILTER (side = 0 AND rn > 1 AND held - quantity <= 0) AS reopens,
                     min(date) AS first_activity, max(date) AS last_activity, count(*) FILTER (side = 0) AS buy_count, count(*) FILTER (side = 1) AS sell_count
              FROM x_fill f JOIN x_avg a USING (portfolio_id, instrument_key, rn) GROUP BY 1, 2) f
        LEFT JOIN (SELECT portfolio_id, instrument_key, sum(cost) AS cost FROM v_open GROUP BY 1, 2) o USING (portfolio_id, instrument_key)
        LEFT JOIN (SELECT portfolio_id, instrument_key, sum(proceeds_net - cost_fifo) AS rf, sum(proceeds_net - cost_average) AS ra FROM v_sales GROUP BY 1, 2) s
        USING (portfolio_id, instrument_key)"""),
    "v_positions": (["v_trades"], """
        SELECT portfolio_id, instrument_key, as_of, 'A' || CAST(instrument_key % 2 AS VARCHAR) AS account, currency,
               greatest(q, 0e0) + CASE WHEN instrument_key % 7 = 0 THEN 1e0 ELSE 0e0 END AS quantity, close_price
        FROM (SELECT portfolio_id, instrument_key, d.as_of, sum(quantity) AS q, max(price) AS close_price, min(currency) AS currency
              FROM v_trades JOIN (VALUES (DATE '1998-06-30'), (DATE '2000-12-31')) d(as_of) ON date <= d.as_of GROUP BY 1, 2, 3)"""),
    "v_last_pos": (["v_positions"], """
        SELECT portfolio_id, instrument_key, arg_max(as_of, as_of) AS as_of, arg_max(quantity, as_of) AS quantity, arg_max(close_price, as_of) AS close_price,
               arg_max(currency, as_of) AS currency FROM v_positions GROUP BY 1, 2"""),
    "v_holdings": (["v_ledger", "v_last_pos", "v_rate", "v_settings", "v_open", "v_cons", "v_sales", "v_trades"], """
        SELECT h.*, CASE WHEN price_ccy = base_currency THEN market_value ELSE market_value * pr.rate END AS market_value_base
        FROM (
          SELECT l.portfolio_id, l.instrument_key, l.currency, l.quantity, s.base_currency, s.method, l.uncovered, l.reopens,
                 CASE WHEN s.method = 'FIFO' THEN l.cost_fifo ELSE l.cost_average END AS cost_basis,
                 CASE WHEN s.method = 'FIFO' THEN l.realized_fifo ELSE l.realized_average END AS realized_pnl,
                 CASE WHEN l.instrument_key = 5 THEN 1234.5e0 WHEN l.instrument_key % 3 <> 0 THEN q.price ELSE p.close_price END AS price,
                 CASE WHEN l.instrument_key = 5 THEN 'manual' WHEN l.instrument_key % 3 <> 0 THEN 'quote' WHEN p.as_of IS NOT NULL THEN 'snapshot' END AS price_source,
                 CASE WHEN l.instrument_key = 5 OR l.instrument_key % 3 <> 0 OR p.as_of IS NOT NULL THEN l.currency END AS price_ccy,
                 CASE WHEN l.instrument_key = 19 THEN NULL
                      ELSE l.quantity * (CASE WHEN l.instrument_key = 5 THEN 1234.5e0 WHEN l.instrument_key % 3 <> 0 THEN q.price ELSE p.close_price END) END AS market_value,
                 l.instrument_key = 6 AS excluded, abs(l.quantity) <= 1e-9 AS closed,
                 CASE WHEN l.currency = s.base_currency THEN (CASE WHEN s.method = 'FIFO' THEN l.cost_fifo ELSE l.cost_average END)
                      WHEN abs(CASE WHEN s.method = 'FIFO' THEN l.cost_fifo ELSE l.cost_average END) <= 1e-9 THEN 0e0
                      WHEN o.gap = 0 THEN o.base * ((CASE WHEN s.method = 'FIFO' THEN l.cost_fifo ELSE l.cost_average END) / l.cost_fifo) END AS cost_basis_base,
                 CASE WHEN l.currency = s.base_currency THEN (CASE WHEN s.method = 'FIFO' THEN l.realized_fifo ELSE l.realized_average END)
                      WHEN sl.gap IS NULL THEN 0e0 WHEN sl.gap = 0 THEN sl.base END AS realized_pnl_base,
                 p.as_of AS check_as_of, led.q AS check_ledger, p.quantity AS check_snapshot
          FROM v_ledger l JOIN v_settings s USING (portfolio_id)
          LEFT JOIN v_last_pos p USING (portfolio_id, instrument_key)
          LEFT JOIN (SELECT p_partkey % 20 AS instrument_key, max(p_retailprice) AS price FROM part GROUP BY 1) q USING (instrument_key)
          LEFT JOIN (SELECT o.portfolio_id, o.instrument_key, sum(o.cost * r.rate) AS base, count(*) FILTER (r.rate IS NULL) AS gap
                     FROM v_open o JOIN v_settings s USING (portfolio_id)
                     LEFT JOIN v_rate r ON r.src = o.currency AND r.dst = s.base_currency AND r.day = o.lot_date GROUP BY 1, 2) o USING (portfolio_id, instrument_key)
          LEFT JOIN (SELECT x.portfolio_id, x.instrument_key, sum(x.leg) AS base, count(*) FILTER (x.leg IS NULL) AS gap FROM (
                       SELECT v.portfolio_id, v.instrument_key,
                              v.proceeds_net * r.rate - (CASE WHEN c.fifo IS NULL THEN (CASE WHEN s.method = 'FIFO' OR v.cost_average = 0 THEN 0e0 ELSE v.cost_average * r.rate END)
                                 WHEN c.gap = 0 THEN c.parts * ((CASE WHEN s.method = 'FIFO' THEN v.cost_fifo ELSE v.cost_average END) / c.fifo) END) AS leg
                       FROM v_sales v JOIN v_settings s USING (portfolio_id)
                       LEFT JOIN v_rate r ON r.src = v.currency AND r.dst = s.base_currency AND r.day = v.sale_date
                       LEFT JOIN (SELECT c.portfolio_id, c.instrument_key, c.sale_id, sum(c.cost) AS fifo, sum(c.cost * r.rate) AS parts, count(*) FILTER (r.rate IS NULL) AS gap
                                  FROM v_cons c JOIN v_settings s USING (portfolio_id)
                                  LEFT JOIN v_rate r ON r.src = c.currency AND r.dst = s.base_currency AND r.day = c.lot_date GROUP BY 1, 2, 3) c
                       ON c.portfolio_id = v.portfolio_id AND c.instrument_key = v.instrument_key AND c.sale_id = v.sale_id) x GROUP BY 1, 2) sl USING (portfolio_id, instrument_key)
          LEFT JOIN (SELECT t.portfolio_id, t.instrument_key, sum(t.quantity) AS q FROM v_trades t JOIN v_last_pos p USING (portfolio_id, instrument_key)
                     WHERE t.date <= p.as_of GROUP BY 1, 2) led USING (portfolio_id, instrument_key)
        ) h LEFT JOIN v_rate pr ON pr.src = h.price_ccy AND pr.dst = h.base_currency AND pr.day = DATE '2001-08-01'"""),
    "v_totals": (["v_holdings"], """
        SELECT portfolio_id, coalesce(sum(market_value_base) FILTER (NOT excluded), 0e0) AS market_value_base,
               coalesce(sum(cost_basis_base) FILTER (NOT excluded), 0e0) AS cost_basis_base,
               coalesce(sum(market_value_base - cost_basis_base) FILTER (NOT excluded), 0e0) AS unrealized_pnl_base,
               coalesce(sum(realized_pnl_base) FILTER (NOT excluded), 0e0) AS realized_pnl_base,
               count(*) FILTER (NOT excluded AND NOT closed) AS open_positions,
               count(*) FILTER (NOT excluded AND NOT closed AND cost_basis_base IS NOT NULL) AS cost_covered,
               count(*) FILTER (NOT excluded AND NOT closed AND market_value_base IS NOT NULL) AS value_covered
        FROM v_holdings GROUP BY 1"""),
    "v_prof_rows": ([], f"""
        SELECT *, ex_date + CAST(o_orderkey % 40 AS INT) AS pay_date
        FROM (SELECT o_orderkey, o_custkey % 20 AS instrument_key, CAST(o_orderdate AS DATE) - CASE WHEN o_custkey % 20 = 4 THEN 3650 ELSE 0 END AS ex_date,
                     (o_orderkey % 100 + 1) / 100e0 / 0.9973e0 AS amount, {ccy('(o_custkey % 20)')} AS currency, o_orderstatus <> 'P' AS declared FROM orders)"""),
    "v_profiles": ([], f"""
        SELECT DISTINCT o_custkey % 20 AS instrument_key, {ccy('(o_custkey % 20)')} AS currency, o_custkey % 20 <> 8 AND (o_custkey % 20) % 4 <> 3 AS is_distributing
        FROM orders"""),
    "x_window": (["v_prof_rows"], """
        SELECT p.*, w.stale FROM v_prof_rows p JOIN (
          SELECT instrument_key, count(*) FILTER (ex_date > DATE '2000-08-01' AND ex_date <= DATE '2001-08-01') = 0 AS stale,
                 CASE WHEN count(*) FILTER (ex_date > DATE '2000-08-01' AND ex_date <= DATE '2001-08-01') > 0 THEN DATE '2001-08-01'
                      ELSE least(max(ex_date), DATE '2001-08-01') END AS fin
          FROM v_prof_rows WHERE declared GROUP BY 1) w USING (instrument_key)
        WHERE p.declared AND p.ex_date > w.fin - 365 AND p.ex_date <= w.fin"""),
    "v_seasons": (["x_window"], """
        SELECT instrument_key, month(ex_date) AS ex_month, sum(amount) / any_value(t.total) AS weight, any_value(t.total) AS per_share_total,
               any_value(t.n) AS payments, any_value(t.lag) AS lag_months, bool_and(stale) AS stale
        FROM x_window JOIN (
          SELECT instrument_key, sum(amount) AS total, count(*) AS n, CAST(floor(coalesce(median(CASE WHEN g BETWEEN 0 AND 6 THEN g END), 0) + 0.5) AS INT) AS lag
          FROM (SELECT *, (year(pay_date) - year(ex_date)) * 12 + month(pay_date) - month(ex_date) AS g FROM x_window) GROUP BY 1) t USING (instrument_key)
        GROUP BY 1, 2"""),
    "v_accruals": ([], f"""
        SELECT portfolio_id, instrument_key, ex_date, ex_date + 20 AS pay_date, {ccy('instrument_key')} AS currency, CAST(q AS DOUBLE) AS quantity,
               q / 100e0 / 0.9973e0 AS gross, q / 100e0 / 0.9973e0 / 4e0 AS tax, q / 100e0 / 0.9973e0 - q / 100e0 / 0.9973e0 / 4e0 AS net,
               q % 2 = 0 AND instrument_key % 5 = 2 AND ex_date >= DATE '2001-07-01' AS open
        FROM (SELECT l_suppkey AS portfolio_id, l_partkey % 20 AS instrument_key, CAST(l_shipdate AS DATE) AS ex_date, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
              FROM lineitem GROUP BY 1, 2, 3)"""),
    "v_declared": (["v_accruals", "v_rate", "v_settings"], """
        SELECT a.portfolio_id, a.instrument_key, strftime(a.pay_date, '%Y-%m') AS month, 'declared' AS basis, a.pay_date, month(a.ex_date) AS ex_month,
               a.gross * (CASE WHEN a.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS gross_base,
               a.net * (CASE WHEN a.currency = s.base_currency THEN 1e0 ELSE r.rate END) AS net_base
        FROM v_accruals a JOIN v_settings s USING (portfolio_id)
        LEFT JOIN v_rate r ON r.src = a.currency AND r.dst = s.base_currency AND r.day = DATE '2001-08-01'
        WHERE a.open AND a.pay_date BETWEEN DATE '2001-08-01' AND DATE '2002-07-31' AND (abs(a.net) >= 0.02 OR abs(a.gross) >= 0.02)
          AND a.instrument_key <> 6"""),
    "v_wht": (["v_dist"], """
        SELECT portfolio_id, instrument_key, greatest(least(sum(tax) / sum(gross), 1e0), 0e0) AS rate FROM v_dist
        WHERE NOT irregular GROUP BY 1, 2"""),
    "v_items": (["v_declared", "v_holdings", "v_profiles", "v_seasons", "v_wht"], """
        SELECT portfolio_id, instrument_key, month, basis, pay_date, gross_base, net_base FROM v_declared
        UNION ALL
        SELECT e.portfolio_id, e.instrument_key, e.month, 'estimated', NULL, e.gross * e.rate, (e.gross - e.gross * e.wht) * e.rate FROM (
          SELECT h.portfolio_id, h.instrument_key, z.ex_month, h.quantity * (z.per_share_total * z.weight) AS gross, coalesce(w.rate, 0e0) AS wht,
                 CASE WHEN p.currency = h.base_currency THEN 1e0 ELSE r.rate END AS rate,
                 strftime(DATE '2001-08-01' + to_months(CAST((((z.ex_month - 1 + z.lag_months) % 12) + 1 - 8 + 12) % 12 AS INT)), '%Y-%m') AS month
          FROM v_holdings h JOIN v_profiles p USING (instrument_key) JOIN v_seasons z USING (instrument_key)
          LEFT JOIN v_wht w ON w.portfolio_id = h.portfolio_id AND w.instrument_key = h.instrument_key
          LEFT JOIN v_rate r ON r.src = p.currency AND r.dst = h.base_currency AND r.day = DATE '2001-08-01'
          WHERE NOT h.excluded AND h.quantity > 1e-9 AND p.is_distributing AND z.weight > 0) e
        WHERE NOT EXISTS (SELECT 1 FROM v_declared d WHERE d.portfolio_id = e.portfolio_id AND d.instrument_key = e.instrument_key AND (d.month = e.month OR d.ex_month = e.ex_month))"""),
}

# Views several steps share are computed once.
_RECURSIVE = {"x_avg"}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def sql(views: str, body: str) -> str:
    """`body` with the named views and all they need as common table expressions."""
    names = _closure(views.split())
    parts = [f"{n} AS {'' if n in _RECURSIVE else 'MATERIALIZED '}({VIEWS[n][1]})" for n in names]
    head = "WITH RECURSIVE " if _RECURSIVE & set(names) else "WITH "
    return head + ",\n".join(parts) + "\n" + body

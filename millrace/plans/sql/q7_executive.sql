WITH t AS (
SELECT date_trunc('month', DATE '{as_of}')::DATE AS m), s AS (
SELECT f.*, date_actual, vendor_id, sku_id
FROM {sales_without_centres}), k AS (
SELECT 'Current Month' AS period_name, s.*
FROM s, t
WHERE date_trunc('month', date_actual) = m
UNION ALL
SELECT 'Previous Month', s.*
FROM s, t
WHERE date_actual >= m - INTERVAL 1 MONTH AND date_actual < m
UNION ALL
SELECT 'Year to Date', s.*
FROM s, t
WHERE year(date_actual) = year(m)), a AS (
SELECT period_name, sum(line_total_aud) AS aud, count(DISTINCT order_id) AS total_orders, count(*) AS total_line_items,
    count(DISTINCT vendor_id) AS active_vendors, count(DISTINCT sku_id) AS unique_products, avg(line_total_aud) AS line
FROM k
GROUP BY 1), n AS (
SELECT unnest(['Current Month', 'Previous Month', 'Year to Date']) AS period_name), q AS (
SELECT count(*) AS total_exceptions, round(avg(fuzz_score), 2) AS avg_data_quality_score
FROM fct_data_quality JOIN dim_date USING (date_key), t
WHERE date_trunc('month', date_actual) = m)
SELECT period_name, round(aud, 2) AS total_spend_aud, coalesce(total_orders, 0) AS total_orders, coalesce(total_line_items, 0) AS total_line_items,
    coalesce(active_vendors, 0) AS active_vendors, coalesce(unique_products, 0) AS unique_products, round(line, 2) AS avg_line_value,
    total_exceptions, avg_data_quality_score, CASE
    WHEN period_name = 'Current Month' THEN round((aud - lag(aud) OVER (ORDER BY period_name DESC)) / nullif(lag(aud) OVER (ORDER BY period_name DESC), 0) * 100, 2) END AS mom_spend_growth_percent
FROM n
LEFT JOIN a USING (period_name), q

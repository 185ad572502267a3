WITH m AS (
SELECT month, quarter, product_category, product_brand, sum(line_total_aud) AS x, sum(quantity) AS monthly_quantity,
    count(DISTINCT order_id) AS monthly_orders
FROM fct_order_line JOIN dim_date USING (date_key) JOIN dim_product USING (product_key)
WHERE year >= year(DATE '{as_of}') - 2
GROUP BY ALL), a AS (
SELECT product_category, avg(x) AS mean, stddev_samp(x) AS dev
FROM m
GROUP BY 1)
SELECT month, quarter, product_category, product_brand, round(x, 2) AS monthly_spend_aud, monthly_quantity, monthly_orders,
    round((x - mean) / nullif(dev, 0), 2) AS spend_seasonality_zscore, round((x / nullif(mean, 0) - 1) * 100, 2) AS spend_variance_from_avg_percent
FROM m JOIN a USING (product_category)

SELECT country_code, region, vendor_category, round(sum(aud), 2) AS region_total_spend_aud, round(avg(line_aud), 2) AS avg_line_value_aud,
    CAST(sum(orders) AS BIGINT) AS total_orders, CAST(sum(lines) AS BIGINT) AS total_line_items, round(sum(aud) / nullif(sum(orders), 0),
    2) AS avg_order_value, round(sum(lines) / nullif(sum(orders), 0), 2) AS avg_lines_per_order, round(avg(vendors_n), 4) AS avg_vendors_per_cc,
    round(avg(products_n), 4) AS avg_products_per_cc
FROM (
SELECT c.country_code, region, cost_centre_name, quarter, year, vendor_category, count(DISTINCT order_id) AS orders, count(*) AS lines,
    sum(line_total_aud) AS aud, avg(line_total_aud) AS line_aud, count(DISTINCT vendor_id) AS vendors_n, count(DISTINCT sku_id) AS products_n
FROM {sales}
WHERE {since_12}
GROUP BY ALL)
GROUP BY ALL

SELECT cost_centre_name, vendor_name, product_category, total_spend_aud, total_quantity, order_line_count, avg_cost_per_unit
FROM (
SELECT cost_centre_name, vendor_name, vendor_category, product_category, quarter, year, round(sum(line_total_aud), 2) AS total_spend_aud,
    sum(quantity) AS total_quantity, count(*) AS order_line_count, round(sum(line_total_aud) / nullif(sum(quantity), 0), 2) AS avg_cost_per_unit
FROM {sales}
WHERE {since_3}
GROUP BY ALL)
ORDER BY total_spend_aud DESC NULLS LAST, cost_centre_name, vendor_name, product_category, quarter, year LIMIT 20

SELECT sku_id, canonical_name, product_category, vendor_name, cost_centre_name, month_name, year, round(avg_unit_price, 4) AS avg_unit_price,
    round(min_unit_price, 4) AS min_unit_price, round(max_unit_price, 4) AS max_unit_price, round(price_stddev, 4) AS price_stddev, order_count,
    total_quantity, round((max_unit_price - min_unit_price) / nullif(avg_unit_price, 0) * 100, 2) AS price_volatility_percent,
    round((avg_unit_price - min_unit_price) * total_quantity, 2) AS potential_savings_aud
FROM fct_price_variance JOIN dim_date USING (date_key) JOIN dim_product USING (product_key) JOIN dim_vendor USING (vendor_key) JOIN dim_cost_centre USING (cost_centre_key)
WHERE order_count >= 2 AND price_stddev > 0.5 * avg_unit_price AND {since_12}
ORDER BY potential_savings_aud DESC NULLS LAST, price_volatility_percent DESC NULLS LAST, sku_id, vendor_name, cost_centre_name LIMIT 25

SELECT e.cost_centre_name, exception_type, exception_count, avg_fuzz_score, missing_in_seed_count, name_mismatch_count, vendor_mismatch_count,
    round(exception_count * 100.0::DOUBLE / nullif(n, 0), 2) AS exception_rate_percent
FROM (
SELECT cost_centre_name, exception_type, month_name, year, count(*) AS exception_count, round(avg(fuzz_score), 2) AS avg_fuzz_score,
    CAST(sum(flag_missing_in_seed::INT) AS BIGINT) AS missing_in_seed_count, CAST(sum(flag_name_mismatch::INT) AS BIGINT) AS name_mismatch_count,
    CAST(sum(flag_vendor_mismatch::INT) AS BIGINT) AS vendor_mismatch_count
FROM fct_data_quality JOIN dim_date USING (date_key) JOIN dim_cost_centre USING (cost_centre_key)
WHERE {since_6}
GROUP BY ALL) e
LEFT JOIN (
SELECT cost_centre_name, count(*) AS n
FROM fct_order_line JOIN dim_date USING (date_key) JOIN dim_cost_centre USING (cost_centre_key)
WHERE {since_6}
GROUP BY 1) t ON e.cost_centre_name = t.cost_centre_name

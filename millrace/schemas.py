"""Schemas of the raw inputs. Declared, never inferred: one pass less, and bad values become null instead of changing a type."""

from __future__ import annotations

ORDERS = (
    "sku_id string, item_description string, brand string, quantity string, unit string, size string, order_date string, order_timestamp string, country_code string, cost_centre_id string, "
    "currency string, unit_price string, total_amount double, order_id string, line_number long, requisitioner string, approval_status string, delivery_date date"
)
VENDORS = (
    "vendor_id string, vendor_name string, tax_id string, country_code string, city string, payment_terms string, vendor_type string, is_active boolean, preferred_currency string, "
    "credit_limit long, street_address string, postal_code string, contact_email string, contact_phone string, created_date date, updated_date date"
)
COST_CENTRES = (
    "cost_centre_id string, cost_centre_name string, parent_cost_centre_id string, country_code string, country_name string, currency string, level long, is_active boolean, department string, "
    "budget_limit long, created_date date, updated_date date"
)
RATES = "date date, from_currency string, to_currency string, exchange_rate double, rate_type string, source string, is_active boolean, created_timestamp timestamp_ntz"
SEED = "sku_id string, canonical_name string, source string, effective_from string, version string"

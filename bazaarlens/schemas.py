"""Columns of the tables, as DDL."""

MERCHANTS = "id string, name string, slug string, domain string, active boolean"
PRODUCTS = "id string, brand string, title string, normalized_title string, image_url string, slug string, active boolean"
VARIANTS = "id string, product_id string, gtin string, sku string, image_url string, active boolean"
OFFERS = (
    "id string, product_variant_id string, merchant_id string, merchant_product_id string, product_url string, price double, currency string, "
    "in_stock boolean, image_url string, last_checked_at timestamp, updated_at timestamp"
)
PRICE_HISTORY = "offer_id string, price double, in_stock boolean, checked_at timestamp"
CANONICAL = "id string, brand string, title string, normalized_title string, capacity_ml int, color string, gtin string, active boolean, updated_at timestamp"
MATCHES = "id string, canonical_product_id string, product_id string, match_score double, match_reason string, status string, updated_at timestamp"
DEALS = (
    "id string, canonical_product_id string, cheapest_offer_id string, cheapest_merchant_id string, cheapest_price double, competitor_offer_id string, "
    "competitor_merchant_id string, competitor_price double, gap_percent double, threshold_percent double, status string, detected_at timestamp, updated_at timestamp, "
    "verified boolean, verified_at timestamp, history_status string, history_points int, history_avg_30d double, history_low_90d double, "
    "previous_distinct_price double, history_drop_percent double, history_threshold_percent double"
)
ITEMS = "merchant string, merchant_product_id string, brand string, title string, price double, image_url string, product_url string, in_stock boolean, gtin string"

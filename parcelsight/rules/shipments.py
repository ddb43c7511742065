"""Fixed values for shipment records: headers, statuses, bands, score weights."""

# Logical field -> accepted export headers, best first.
SHIPMENT_HEADERS = {
    "carrier": ["Carrier Partner Name"],
    "account": ["Carrier Partner Account Name"],
    "weight": ["Shipment Weight"],
    "payment": ["Payment Mode"],
    "pickup_pin": ["Pickup Pincode"],
    "drop_pin": ["Drop Pin Code", "Drop Pincode"],
    "drop_city": ["Drop City", "Destination City"],
    "pickup_ts": ["Pickup Timestamp"],
    "order_ts": ["Order Date", "Order Created At", "Order Creation Date", "Order Placed",
                 "Order Timestamp", "Created At"],
    "delivery_ts": ["Delivery Timestamp"],
    "ofd1_ts": ["OFD1 Timestamp"],
    "zone": ["Zone", "Shipment Zone", "Pricing Zone"],
    "channel": ["Channel Name", "Channel", "channel_name"],
    "delivery_type": ["Delivery Type"],
    "status": ["Latest Status"],
    "attempts": ["Number of Delivery Attempts"],
    "item_names": ["Item Names", "Item Name", "Product Name"],
    "sku": ["Product SKU Codes", "SKU", "Product SKU Code"],
    "order_value": ["Invoice Value", "Order Value", "Invoice Amount", "Order Amount",
                    "Invoice Amt", "Total Value"],
    "cod_value": ["COD Value", "COD Amount", "Collectable Amount", "COD Amt"],
    "awb": ["AWB", "AWB Number", "AWB No", "AWB No.", "Waybill Number", "Tracking Id", "awb_number"],
    "order_id": ["Order Number", "Order Id", "Client Order Id", "client_order_id",
                 "Reference Number"],
}
REQUIRED_HEADERS = ["carrier"]

# Logical field -> column of the shipment table.
SHIPMENT_TABLE_COLUMNS = {
    "carrier": "courier_partner",
    "account": "account_code",
    "awb": "awb",
    "order_id": "order_id",
    "weight": "shipment_weight",
    "payment": "payment_mode",
    "pickup_pin": "pickup_pincode",
    "drop_pin": "drop_pincode",
    "drop_city": "drop_city",
    "pickup_ts": "pickup_date",
    "order_ts": "order_date",
    "window_ts": "partition_date",
    "delivery_ts": "delivery_date",
    "ofd1_ts": "out_for_delivery_1st_attempt",
    "edd_ts": "expected_delivery_date_by_courier_partner",
    "zone": "zone",
    "channel": "channel_name",
    "delivery_type": "shipment_type",
    "status": "clickpost_unified_status",
    "attempts": "out_for_delivery_attempts",
    "item_names": "items",
    "sku": "product_sku_code",
    "order_value": "invoice_value",
    "cod_value": "cod_value",
}

OUTCOMES = ["Delivered", "FWD Pendency", "RTO", "Cancelled"]
CANCELLED_STATUSES = ["cancelled", "notserviceable", "lost", "damaged", "nostatusexist"]
LOST_AFTER_DAYS = 30

PENDENCY_STATES = [
    "InTransit", "OutForDelivery", "FailedDelivery", "ShipmentDelayed", "OutForPickup",
    "PickupFailed", "PickupPending", "ShipmentHeld", "DestinationHubIn", "OriginCityIn",
    "OriginCityOut", "PickedUp", "ContactCustomerCare", "OrderPlaced", "Awb Registered",
]

TAT_STATUSES = ["In TAT", "Out of TAT", "No rule", "Pending"]

# Upper bound in grams -> label.
WEIGHT_CLASSES = [(3000, "Light"), (10000, "Medium")]
WEIGHT_BUCKETS = [(500, "0-500g"), (1000, "500g-1kg"), (5000, "1-5kg")]

PICKUP_SLOTS = ["Before 12pm", "12–1pm", "1–2pm", "2–3pm", "3–4pm", "4–5pm", "After 5pm"]

NDD_ACCOUNT_TOKENS = ["ndd", "skye", "urbanbolt", "urbane", "elasticrun", "shadofax", "shadowfax"]
NDD_ACCOUNT_NAMES = ["test"]

D2C_CHANNEL_TOKEN = "SHOPIFY"
D2C_CHANNELS = ["AMAZON_API_NEW", "CUSTOM", "B2B"]

# Efficiency score: metric -> (weight, lower is better).
SCORE_WEIGHTS = {
    "p2o": (0.30, True),
    "p2d": (0.25, True),
    "success_rate": (0.20, False),
    "first_attempt_rate": (0.15, False),
    "avg_attempts": (0.10, True),
}

MIN_N = {"warehouse": 20, "destination": 20, "lane": 15, "warehouse_account": 10}
TOP_WAREHOUSES = 10

# Health score: label -> (weight, worst value, best value).
HEALTH_COMPONENTS = {
    "Delivery success": (0.30, 70.0, 95.0),
    "RTO / returns control": (0.25, 30.0, 5.0),
    "On-time / SLA (TAT)": (0.20, 60.0, 95.0),
    "Revenue realisation": (0.15, 55.0, 90.0),
    "COD risk": (0.10, 30.0, 5.0),
}
HEALTH_GRADES = [
    (85.0, "A", "excellent"),
    (75.0, "B", "healthy"),
    (62.0, "C", "mixed — watch the weak spots"),
    (48.0, "D", "under strain"),
]
HEALTH_FLOOR = ("F", "critical — needs intervention")

LOOKBACK_DEFAULT_DAYS = 30
LOOKBACK_MAX_DAYS = 366
PRUNE_BUFFER_DAYS = 3
O2S_MATURE_DAYS = 4

# Export column -> header.
SHIPMENT_EXPORT = {
    "awb": "AWB", "order_id": "Order ID", "carrier": "Carrier", "account": "Account",
    "delivery_type": "Delivery type", "pickup_pin": "Pickup pincode", "warehouse": "Warehouse",
    "city": "Pickup city", "drop_pin": "Drop pincode", "drop_city": "Drop city",
    "tier": "City tier", "payment": "Payment", "pickup_date": "Pickup date",
    "status": "Latest status", "outcome": "Outcome", "delivered": "Delivered",
    "o2s": "Order->Pickup O2S (hrs)", "p2o": "Pickup->OFD1 (hrs)",
    "p2d": "Pickup->Delivery (hrs)", "promised_tat": "Promised TAT",
    "tat_status": "TAT status", "tat_margin": "TAT margin",
}

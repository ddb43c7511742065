"""Carrier invoice layouts, header keywords and file-name tokens."""

from dataclasses import dataclass, field

AMOUNT_HEADERS = ["invoice amt", "invoice value", "net amount", "net", "grand total",
                  "total amount", "cost", "total freight", "total"]
ORDER_HEADERS = ["order id", "order number", "order_id", "client_order_id", "reference number"]
AWB_HEADERS = ["awb number", "awb no.", "awbno", "awb", "tracking_id", "global_tracking_id",
               "awb_number", "waybill number", "transaction_id", "swift id", "cawbno", "wbn"]
ZONE_HEADERS = ["zone charged", "zone", "shipment zone", "pricing zone"]
WEIGHT_HEADERS = ["weight", "charge weight", "round weight", "billedwt"]
SKU_HEADERS = ["skus", "sku code", "sku codes", "product sku codes", "sku", "sku_list",
               "product code"]
NAME_HEADERS = ["sku name", "product name", "product_desc", "sub_cat", "item names",
                "sub_category"]
CARRIER_HEADERS = ["courier", "courier name", "carrier", "carrier partner name"]

# Standard field -> headers tried when suggesting a mapping.
SUGGESTED_HEADERS = {
    "amount": AMOUNT_HEADERS,
    "amount_ex_gst": ["net amount", "net", "before tax", "ex gst", "freight subtotal",
                      "total freight", "gross_amount", "base charge", "ntotalamt"],
    "awb": AWB_HEADERS,
    "order_id": ORDER_HEADERS,
    "weight_kg": WEIGHT_HEADERS,
    "zone": ZONE_HEADERS,
    "sku": SKU_HEADERS,
    "sku_name": NAME_HEADERS,
    "invoice_number": ["invoice number", "invoice no", "invoice no.", "bill number",
                       "cinvoicenbr", "client_invoice_number", "serial_number"],
    "invoice_date": ["invoice date", "billing date", "bill date", "pickup date", "shipment date",
                     "dinvdate", "client_invoice_date", "date"],
}

MASTER_SKU_HEADERS = ["sku_list", "sku code", "product code", "skus", "sku"]
MASTER_NAME_HEADERS = ["sku name", "product name", "product_desc", "sub_cat"]
MASTER_WEIGHT_HEADERS = ["vol. weight", "vol. wt", "volumetric weight", "volumetric wt",
                         "vol weight", "vol wt", "volumetric", "billable weight", "billable wt",
                         "charge weight", "chargeable weight", "expected weight", "weight kg",
                         "weight"]

# File-name token -> carrier, first hit wins.
CARRIER_BY_FILE_TOKEN = [
    ("skyair", "SkyAir"), ("sky air", "SkyAir"),
    ("elasticrun", "ElasticRun"), ("elastic", "ElasticRun"), ("er_", "ElasticRun"),
    ("er ", "ElasticRun"),
    ("urbanbolt", "Urban Bolt"), ("urbane", "Urban Bolt"), ("ub_", "Urban Bolt"),
    ("ub ", "Urban Bolt"),
    ("swift", "Swift"),
    ("safexpress", "Safexpress"), ("safe express", "Safexpress"),
    ("sps", "SPS"),
    ("ekart", "Ekart"),
    ("prime large", "Prime Large"), ("prime small", "Prime Small"), ("prime", "Prime"),
    ("bd b2b", "BlueDart"), ("bd_", "BlueDart"), ("bluedart", "BlueDart"),
    ("blue dart", "BlueDart"), ("prebilling", "BlueDart"), ("delhivery", "Delhivery"),
]

# SLA file columns: loose header tokens.
SLA_ORIGIN_TOKENS = ["warehouse pin", "pickup pin", "origin pin", "warehouse", "origin", "hub"]
SLA_DROP_TOKENS = ["destination pin", "drop pin", "delivery pin", "dest pin"]
SLA_PIN_TOKENS = ["pincode", "pin code", "pin"]
SLA_TAT_TOKENS = ["tat", "days", "threshold", "sla"]


@dataclass(frozen=True)
class Layout:
    """How one carrier's invoice file is recognised and read.

    A row is the header when it holds every `all_of` name and one name of each `any_of` group.
    """

    name: str
    all_of: tuple = ()
    any_of: tuple = ()
    scan: int = 4                    # header must be among the first rows
    carrier: str | None = None       # None: from the file name
    carrier_column: bool = False     # a courier column overrides it
    fields: dict = field(default_factory=dict)
    gst: str = "none"                # none | given | given_or_strip | strip | add
    gst_rate: float = 18.0
    grams: bool = False              # weights are in grams
    formulas: bool = False           # cells may be ="text"
    needs: str = "awb+amount"        # awb+amount | awb | invoice+any | awb+amount+invoice | id+amount
    invoice: str = "column"          # column | file | period | tier
    period: str = "date"             # date | file | none
    category: str = "others"         # others | name | label
    bracketed: bool = False          # product text is "[sku] {name}"


INVOICE_LAYOUTS = [
    Layout("shadowfax", ("awb_number", "product_cat", "total_charges"), carrier="Shadowfax",
           fields={"awb": ["awb_number"], "amount": ["total_charges"], "tier": ["client_name"],
                   "date": ["picked_date", "received_at_hub_date", "last_updated"],
                   "name": ["product_desc"], "label": ["product_cat"],
                   "order_id": ["client_order_id"], "weight": ["weight"], "zone": ["zone"]},
           gst="add", invoice="tier", period="file", category="label"),
    Layout("bluedart_b2c", ("cinvoicenbr", "cawbno"), (("gross total", "with gst", "net"),),
           scan=15, carrier="BlueDart",
           fields={"amount": ["gross total", "with gst", "net"],
                   "ex_gst": ["total", "ex gst", "ntotalamt"], "awb": ["cawbno"],
                   "invoice": ["cinvoicenbr"], "date": ["dinvdate"],
                   "weight": ["nchrgwt", "final wt", "nactwgt"], "zone": ["zone"],
                   "direction": ["fwd/reverse"]},
           gst="given", needs="invoice+any"),
    Layout("bluedart_b2b", ("net", "skus"), (("awb no.", "cawbno"),), carrier="BlueDart",
           fields={"awb": ["awb no.", "cawbno"], "amount": ["net"], "sku": ["skus"],
                   "name": ["sub_cat"], "weight": ["nchrgwt"], "zone": ["zone"]},
           needs="awb", invoice="none", period="none", category="name"),
    Layout("skyair", ("awb", "total"), (("before tax", "round weight", "sku name"),),
           carrier="SkyAir",
           fields={"awb": ["awb"], "amount": ["total"], "ex_gst": ["before tax", "ex gst"],
                   "weight": ["round weight", "charge weight", "sky air weight", "weight"],
                   "name": ["sku name", "product name"], "sku": ["sku code", "sku codes", "sku"],
                   "zone": ["city", "zone"],
                   "date": ["pickup date", "receiving date", "order last status date"]},
           gst="given_or_strip", invoice="period", period="file", category="name"),
    Layout("swift", ("swift id", "awb"), (("cost", "billing date"),), scan=8, carrier="Swift",
           carrier_column=True,
           fields={"amount": ["cost", "cost incl gst", "freight", "shipping cost"],
                   "awb": ["awb"], "awb_2": ["swift id"],
                   "date": ["billing date", "invoice date", "date"],
                   "weight": ["weight", "weight in gms", "charge weight"],
                   "direction": ["direction"],
                   "name": ["product description", "item names", "product name"],
                   "courier": ["courier name", "courier", "carrier"],
                   "order_id": ["order number", "order id", "order_id"], "zone": ["zone"]},
           gst="strip", grams=True, invoice="file", bracketed=True),
    Layout("delhivery", ("waybill_num", "total_amount", "gross_amount"), scan=6,
           carrier="Delhivery",
           fields={"awb": ["waybill_num"], "amount": ["total_amount"], "ex_gst": ["gross_amount"],
                   "invoice": ["serial_number"],
                   "date": ["pickup_date", "status_date", "invoice date"],
                   "weight": ["charged_weight"], "zone": ["zone"], "order_id": ["order_id"],
                   "name": ["item_shipped", "product_description", "product_desc"]},
           gst="given", grams=True, formulas=True),
    Layout("elasticrun", ("transaction_id", "total_charge", "client_invoice_number"),
           carrier="ElasticRun",
           fields={"awb": ["transaction_id"], "amount": ["total_charge"],
                   "invoice": ["client_invoice_number"], "invoice_date": ["client_invoice_date"],
                   "date": ["work_complete_time", "client_invoice_date"],
                   "weight": ["chargeable_weight", "weight"], "zone": ["zone", "state"]},
           gst="add", needs="awb+amount+invoice"),
    Layout("safexpress", ("waybill number", "grand total"), (("bill number", "total freight"),),
           carrier="Safexpress",
           fields={"awb": ["waybill number"], "amount": ["grand total"],
                   "ex_gst": ["total freight", "total amount"], "invoice": ["bill number"],
                   "date": ["pickup date", "invoice date", "booking date"],
                   "weight": ["charge weight", "charged weight", "chargeable weight", "weight"],
                   "zone": ["waybill destination", "destination", "zone"]},
           gst="given"),
    Layout("urbanbolt", ("awb no", "total amount"),
           (("freight subtotal", "gst amount", "chg. weight", "chg weight"),),
           carrier="Urban Bolt",
           fields={"awb": ["awb no", "awb number", "awb"], "amount": ["total amount"],
                   "ex_gst": ["freight subtotal", "base charge"],
                   "weight": ["chg. weight", "chg weight", "charge weight", "weight"],
                   "date": ["shipment date", "pickup date", "date"],
                   "zone": ["lane / zone", "zone", "lane"]},
           gst="given_or_strip", invoice="period", period="file"),
]

GENERIC_LAYOUT = Layout(
    "generic", (), (tuple(AMOUNT_HEADERS), tuple(AWB_HEADERS + ORDER_HEADERS)), scan=8,
    carrier_column=True,
    fields={"amount": AMOUNT_HEADERS, "awb": AWB_HEADERS, "order_id": ORDER_HEADERS,
            "zone": ZONE_HEADERS, "weight": WEIGHT_HEADERS, "sku": SKU_HEADERS,
            "name": NAME_HEADERS, "courier": CARRIER_HEADERS,
            "date": ["billing date", "bill date", "invoice date", "date"]},
    needs="id+amount", invoice="none", period="swift", category="label_is_name")

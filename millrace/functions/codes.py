"""Fixed values of the curated model: code lists, name rules and key prefixes."""

# Key prefixes.
SKU, ORDER, CUSTOMER, DISTRIBUTOR, CATEGORY = "SKU-", "ORD-", "CUST-", "DIST-", "CAT-"
WAREHOUSE, TICKET, ACCOUNT, PURCHASE, SUPPLIER = "WH-", "TKT-", "GL-", "PO-", "SUP-"

# Account ids of the two customer systems and what replaces them.
ORDER_ACCOUNT_PREFIX = "ACCT-"
CRM_ACCOUNT_PREFIX, CRM_CUSTOMER_PREFIX = "001Dn00000A", "200"

# Order status by the smallest line status of the order.
ORDER_STATUS = {
    "ENTERED": "PENDING",
    "PROCESSING": "PROCESSING",
    "SHIPPED": "SHIPPED",
    "CLOSED": "DELIVERED",
}

# Manufacturer name contains -> brand, first hit wins.
BRAND_RULES = [
    ("Dyson", "Dyson"),
    ("Whirlpool", "KitchenAid"),
    ("Sony", "Sony"),
    ("DeLonghi", "Nespresso"),
    ("iRobot", "iRobot"),
    ("Bose", "Bose"),
    ("Instant", "Instant Pot"),
    ("Samsung", "Samsung"),
    ("Vitamix", "Vitamix"),
    ("Apple", "Apple"),
]

# Item subtype -> category, department and display name.
SUBTYPE_CATEGORY = {
    "VACUUM": "Home Appliances",
    "KITCHEN": "Home Appliances",
    "PERSONAL": "Home Appliances",
    "AUDIO": "Electronics",
    "TELEVISION": "Electronics",
}
SUBTYPE_DEPARTMENT = {
    "VACUUM": "Home & Living",
    "KITCHEN": "Home & Living",
    "PERSONAL": "Home & Living",
    "AUDIO": "Technology",
    "TELEVISION": "Technology",
}
SUBTYPE_NAME = {
    "VACUUM": "Vacuums",
    "KITCHEN": "Kitchen",
    "AUDIO": "Audio",
    "TELEVISION": "Televisions",
    "PERSONAL": "Personal Care",
}
OTHER_CATEGORY, OTHER_DEPARTMENT = "Other", "General"
KG_TO_LBS = "2.20462"

# Billing state -> sales region.
STATE_REGION = {
    "New York": "Northeast",
    "Massachusetts": "Northeast",
    "Connecticut": "Northeast",
    "New Jersey": "Northeast",
    "Georgia": "Southeast",
    "Florida": "Southeast",
    "Virginia": "Southeast",
    "North Carolina": "Southeast",
    "Illinois": "Midwest",
    "Ohio": "Midwest",
    "Michigan": "Midwest",
    "Indiana": "Midwest",
    "California": "West",
    "Oregon": "West",
    "Washington": "West",
    "Arizona": "Southwest",
    "Texas": "Southwest",
    "New Mexico": "Southwest",
    "Nevada": "Southwest",
}
OTHER_REGION = "Other"

# Ledger account type -> P&L type.
ACCOUNT_TYPE = {
    "Income": "REVENUE",
    "Cost of Sales": "EXPENSE",
    "Expense": "EXPENSE",
    "Other Income": "CONTRA",
}

# Month name -> month number.
MONTH = {
    "JAN": "01",
    "FEB": "02",
    "MAR": "03",
    "APR": "04",
    "MAY": "05",
    "JUN": "06",
    "JUL": "07",
    "AUG": "08",
    "SEP": "09",
    "OCT": "10",
    "NOV": "11",
    "DEC": "12",
}

# Vendor country and payment terms, purchase and ticket status.
COUNTRY = {
    "MY": "Malaysia",
    "US": "United States",
    "JP": "Japan",
    "IT": "Italy",
    "CN": "China",
    "KR": "South Korea",
}
PAYMENT_TERMS = {"Z030": "NET-30", "Z045": "NET-45", "Z060": "NET-60"}
DEFAULT_TERMS = "NET-30"
PURCHASE_STATUS = {"FULLY_RECEIVED": "RECEIVED", "IN_TRANSIT": "IN_TRANSIT", "ORDERED": "ORDERED"}
TICKET_STATUS = {"CLOSED": "RESOLVED", "OPEN": "OPEN"}

# Characters after which a word starts, for title case.
WORD_BREAKS = r"\s!?@\"^#$&~_,.:;+\-*%/|\\\[\](){}<>"

# Legal suffix of a partner name, sales-channel suffix of an account name.
LEGAL_SUFFIX = r",?\s*(Inc\.|Corp\.|Corporation|Co\.\s*,?\s*Inc\.)$"
CHANNEL_SUFFIX = r"\s*-\s*(Direct|Marketplace)$"

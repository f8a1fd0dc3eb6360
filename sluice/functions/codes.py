"""Fixed code tables of the four built-in pipelines.

Fixed values that must equal the reference's, stated in natural order.
"""

# sales channel codes -> canonical channel
CHANNEL_MAPPING = {
    "1": "ONLINE",
    "ONLINE": "ONLINE",
    "2": "IN_STORE",
    "STORE": "IN_STORE",
    "IN_STORE": "IN_STORE",
    "3": "PHONE",
    "PHONE": "PHONE",
    "4": "PARTNER",
    "PARTNER": "PARTNER",
    "5": "MARKETPLACE",
    "MARKETPLACE": "MARKETPLACE",
}
SALES_TAX_RATE = "0.19"
SALES_DEFAULT_STATUS = "OPEN"

# customer status codes
STATUS_MAPPING = {
    "A": "ACTIVE",
    "I": "INACTIVE",
    "S": "SUSPENDED",
    "C": "CLOSED",
    "ACTIVE": "ACTIVE",
    "INACTIVE": "INACTIVE",
    "SUSPENDED": "SUSPENDED",
    "CLOSED": "CLOSED",
}

# country alpha-2 / alpha-3 / numeric -> alpha-2
COUNTRY_MAPPING = {
    "CO": "CO",
    "COL": "CO",
    "170": "CO",
    "US": "US",
    "USA": "US",
    "840": "US",
    "MX": "MX",
    "MEX": "MX",
    "484": "MX",
}

# telephone dial codes by alpha-2 country
COUNTRY_DIAL_CODES = {
    "CO": "57",
    "US": "1",
    "MX": "52",
}
CUSTOMER_DEFAULT_TYPE = "INDIVIDUAL"
AGE_MIN_YEARS = 0
AGE_MAX_YEARS = 120

# warehouse aliases -> canonical warehouse id (the canonical ids themselves are not keys)
WAREHOUSE_MAPPING = {
    "WH001": "W-001",
    "CENTRAL": "W-001",
    "1": "W-001",
    "WH002": "W-002",
    "NORTH": "W-002",
    "2": "W-002",
    "WH003": "W-003",
    "SOUTH": "W-003",
    "3": "W-003",
}

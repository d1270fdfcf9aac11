"""Names, codes, formats and patterns the results depend on."""

# The levels at which a postcode rolls up to an area.
AREA_TYPES = ("area", "district", "county", "town", "sector", "outcode", "postcode")

# Property type left out of statistics, sale category kept.
EXCLUDED_TYPE = "O"
KEPT_CATEGORY = "A"

# Record status codes of the sales file; anything else deletes.
ADDED, CHANGED = "A", "C"

# Calendar grains and their length in months.
GRAINS = {"monthly": 1, "quarterly": 3, "half_year": 6, "yearly": 12}

# Label of the row that covers every property type.
ALL_TYPES = "all"

# Tokens charged per successful call, by route.
TOKEN_PRICES = {
    "get_houses_by_postcode": 1,
    "get_house_details": 2,
    "create_sales_stats_task": 5,
}

# Billing periods end on this day of the month and last this long.
PERIOD_END_DAY = 28
PERIOD_DAYS = 28

# Message of a bill for a user without open usage.
NO_USAGE = "User has no usage recorded"

# Column order of the headerless sales file.
SALE_FILE_COLUMNS = (
    "tui", "price", "date", "postcode", "property_type", "new_build", "duration",
    "paon", "saon", "street", "locality", "town", "district", "county",
    "ppd_cat", "record_status",
)

# File name of a certificate extract.
CERTIFICATE_FILE = "certificates.csv"

# Postcode grammar. The special code is tied to the start of the
# text only and the general form to the end only. Groups: 1-3 special area,
# district, digit; 4/5, 6/7, 8/9, 10/11 area/district by shape; 12 sector digit.
POSTCODE_PATTERN = (
    r"(?s)\A(?:([Gg][Ii][Rr])() (0)[Aa]{2}.*"
    r"|.*?(?:(?:([A-Za-z])([0-9]{1,2})"
    r"|([A-Za-z][A-Ha-hJ-Yj-y])([0-9]{1,2})"
    r"|([A-Za-z])([0-9][A-Za-z])"
    r"|([A-Za-z][A-Ha-hJ-Yj-y])([0-9]?[A-Za-z]))"
    r" ([0-9])[A-Za-z]{2})\z)"
)

# Layouts of numbers, dates and times in the source files. Under
# (?U), \s is every Unicode white space character.
NOT_BLANK = r"(?U)\S"
PADDED = r"(?U)\A\s*({})\s*\z"
RATING = r"[A-Ga-g]"
WHOLE_NUMBER = r"[+-]?[0-9]+"
DECIMAL_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DATE_LAYOUT = r"\A *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"
MINUTE_LAYOUT = r"\A *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}\z"
SECOND_LAYOUT = r"\A *[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\z"

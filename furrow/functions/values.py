"""Fixed values the results depend on."""

# Text cells that a CSV scan counts as missing (the documented default list
# of pandas.read_csv).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# White space, as Python's str.strip takes it off.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Keyword rules of the assistant, in the order they are tried.
ASSISTANT_RULES = (
    ("weather", ("weather",)),
    ("market", ("market", "price")),
    ("crop", ("crop", "advice")),
    ("scheme", ("government", "scheme")),
    ("greeting", ("hello", "hi")),
)
ASSISTANT_FALLBACK = "fallback"

# Weather conditions by the word they contain, in order.
CONDITION_RULES = (("sun", ("Sunny",)), ("cloud", ("Cloudy",)))
CONDITION_FALLBACK = "drop"

# Options of the recommendation form, weakest first where they have an order.
SEASONS = ("kharif", "rabi", "zaid")
WATER_LEVELS = ("low", "medium", "high")
INVESTMENT_LEVELS = ("low", "medium", "high")
REGIONS = ("north", "south", "east", "west", "northeast")
SOIL_TYPES = ("clay", "sandy", "loamy", "black", "red")
# Upper bound in rupees of each investment level; the highest has none.
INVESTMENT_BOUNDS = (20000.0, 50000.0, None)

# Fixed values (our choice): share of the profit kept in a score, by risk.
RISK_WEIGHTS = {"low": 1.0, "medium": 0.9, "high": 0.8}

# Fixed values (our choice): names of one crop in different data sets, after trim and lower case.
CROP_ALIASES = {
    "paddy": "rice",
    "moong": "green gram",
    "mungbean": "green gram",
    "urdbean": "black gram",
    "chickpea": "gram",
    "bengal gram": "gram",
    "pearl millet": "bajra",
    "finger millet": "ragi",
    "cotton(lint)": "cotton",
    "desi cotton": "cotton",
    "rapeseed &mustard": "rapeseed and mustard",
    "indian mustard": "rapeseed and mustard",
    "yellow sarson": "rapeseed and mustard",
    "sesame": "sesamum",
    "soyabean": "soybean",
    "pulses": "total pulses",
    "oilseeds": "total oilseeds",
    "fibers": "total fibers",
}

# Fixed values (our choice): patterns that name a state in free zone text, with the
# spellings and short forms the text uses.
STATE_PATTERNS = {
    "Andhra Pradesh": r"Andhra Pradesh|South India",
    "Arunachal Pradesh": r"Arunachal Pradesh|North East(ern)? States?",
    "Assam": r"Assam|North East(ern)? States?",
    "Bihar": r"Bihar",
    "Chhattisgarh": r"Chh?attisgarh",
    "Delhi": r"Delhi",
    "Goa": r"\bGoa\b",
    "Gujarat": r"Gujarat",
    "Haryana": r"Haryana",
    "Himachal Pradesh": r"Himachal Pradesh|\bHP\b",
    "Jammu and Kashmir": r"Jammu (&|and) Kashmir|\bJ ?& ?K\b",
    "Jharkhand": r"Jharkhand",
    "Karnataka": r"Karnataka|South India",
    "Kerala": r"Kerala|South India",
    "Madhya Pradesh": r"Madhya Pradesh|\bMP\b",
    "Maharashtra": r"Mahara?shtra",
    "Manipur": r"Manipur|North East(ern)? States?",
    "Meghalaya": r"Meghalaya|North East(ern)? States?",
    "Mizoram": r"Mizoram|North East(ern)? States?",
    "Nagaland": r"Nagaland|North East(ern)? States?",
    "Orissa": r"Orissa|Odisha",
    "Punjab": r"Punjab",
    "Rajasthan": r"Rajasthan",
    "Sikkim": r"Sikkim|North East(ern)? States?",
    "Tamil Nadu": r"Tamil ?[Nn]adu|South India",
    "Tripura": r"Tripura|North East(ern)? States?",
    "Uttar Pradesh": r"Uttar Pradesh|\bUP\b",
    "Uttarakhand": r"Uttarakhand",
    "West Bengal": r"West Bengal",
}

"""Values that decide results and are therefore fixed."""

# Two-digit product classes kept for analysis.
HS_CLASSES = [2, 7, 8, 9, 10, 11, 14, 15, 16, 17, 18, 19, 20, 22, 24, 30, 40, 47, 72, 73, 87, 94, 95]

# Words that mark a refrigerated container in a description (case-sensitive).
REFRIGERATED_WORDS = ["REEF", "Cold", "Deg"]

# Upper edges of the company size classes in metric tons, and their names.
SIZE_EDGES = [1_000, 10_000, 100_000, 1_000_000]
SIZE_LABELS = ["micro", "small", "medium", "large", "huge"]
SIZE_UNKNOWN = "unknown"
SIZE_ORDER = [SIZE_UNKNOWN, *SIZE_LABELS]
UNKNOWN_COMPANY = "NOT AVAILABLE"

# Least total tonnage of a company, z-score limit, largest shipment.
MIN_ENTITY_TONS = 100
OUTLIER_Z = 3.5
MAX_SHIPMENT_TONS = 250

# Fillers.
NOT_PROVIDED = "Not Provided"
NOT_DECLARED = "NOT DECLARED"
EXPORT_FOREIGN_COMPANY = "Not Applicable to Exports"
NOT_APPLICABLE = "Not Applicable"

# Port state texts that trimming alone does not make a state code.
PORT_STATE_CODES = {
    "NEW YORK": "NY",
    "OH (DHL COURIER)": "OH",
    "MT": "MI",
    "FL)": "FL",
    "MS)": "MS",
    "VIRGIN ISLANDS": "VI",
    "INC.": NOT_DECLARED,
    "ND": NOT_DECLARED,
}

# Company state texts that mean "not declared".
COMPANY_STATE_CODES = {"ND": NOT_DECLARED, "ED": NOT_DECLARED}

# Country names changed to those of the tariff table.
COUNTRY_NAMES = {
    "Viet Nam": "Vietnam",
    "Taiwan, Province of China": "Taiwan",
    "Russian Federation": "Russia",
    "Tanzania, United Republic of": "Tanzania",
    "Bolivia, Plurinational State of": "Bolivia",
}

# Month before which each expanding training window ends.
WINDOW_CUTOFF_YEARS = [2011, 2012, 2013, 2015, 2019, 2020]

# Levels of the simulated interval, forecast length, seed.
INTERVAL_PROBS = [0.025, 0.975]
FORECAST_STEPS = 12
SEED = 42

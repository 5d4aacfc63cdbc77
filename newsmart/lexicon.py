"""Word lists, lookup tables and constants.

Everything in this module is a fixed value that results depend on, stated as
plain text. Larger dimensions (the full ISO numeric list, alias seeds, feed
registries) are passed in as DataFrames instead.
"""

# --- fixed values: urls and titles -------------------------------------------
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]

# --- fixed values: title comparison ------------------------------------------
SAFE_STOPWORDS = (
    "a an the and or but in on at to for of with by from up about into over after is are was were "
    "be been being have has had do does did will would shall should can could may might must this "
    "that these those it its says said new announces announced reports reported signals"
).split()

GENERIC_ENTITIES = [
    "united states", "us", "uk", "united kingdom", "china", "russia", "india", "japan", "europe", "eu",
    "ai", "artificial intelligence", "tech", "technology", "business", "market", "markets", "economy",
    "government", "official", "officials", "report", "news",
]

TOKEN_ALIASES = {
    "fed": "federal reserve",
    "fomc": "federal reserve",
    "federal reserve board": "federal reserve",
    "boe": "bank of england",
    "ecb": "european central bank",
    "boj": "bank of japan",
    "rbi": "reserve bank of india",
    "deepmind": "google deepmind",
    "aws": "amazon web services",
    "mbs": "mohammed bin salman",
    "gilt": "uk gilt",
    "bund": "germany bund",
    "jgb": "japan jgb",
    "g-sec": "india g-sec",
}

TOKEN_SUFFIXES = (
    "bancorp bank inc corp corporation ltd limited plc co company group holdings llc sa ag nv se"
).split()

INSTITUTIONS = [
    "federal reserve", "european central bank", "bank of england", "bank of japan", "reserve bank of india",
]

DOMAIN_TERMS = [
    "fed", "federal reserve", "ecb", "bank of england", "boe", "bank of japan", "boj",
    "reserve bank of india", "rbi", "kushner", "pori", "tnt", "ayana bio", "meati", "sage maker",
    "sagemaker", "vera rubin", "gemini 3.8", "gpt-4o", "chatgpt", "gilt", "bund", "jgb", "g-sec",
    "brent", "wti", "red sea", "houthis", "el-sisi", "mbs",
]

HOLD_WORDS = ["holds", "hold", "steady", "maintains", "maintain", "unchanged", "pauses", "pause"]
CUT_WORDS = ["cuts", "cut", "lowers", "lower", "reduces", "reduce", "easing"]
HIKE_WORDS = ["hikes", "hike", "raises", "raise", "lifts", "lift", "tightening"]
EARNINGS_TERMS = ["earnings", "q1", "q2", "q3", "q4", "net income", "quarterly profit"]
LAUNCH_TERMS = ["unveils", "launches", "announces", "introduces", "keynote"]

BROAD_CATEGORIES = ["world", "general", "geopolitics"]

NUMERIC_MARKER = (
    r"\b\d+(?:\.\d+)?(?:\s*(?:%|bps?|bp|billion|million|bn|m|b|trillion|t))"
    r"|\$\d+(?:,\d+)*(?:\.\d+)?[bmk]?"
)
NUMERIC_TOKEN = (
    r"\b\d+(?:\.\d+)?(?:\s*(?:%|bps?|bp|billion|million|bn|m|b|trillion|t))\b"
    r"|\$\d+(?:,\d+)*(?:\.\d+)?[bmk]?|\b\d+(?:\.\d+)?\b"
)

# --- fixed values: categories and sections -----------------------------------
CATEGORIES = [
    "World", "Geopolitics", "Business", "Markets & Economy", "AI & Technology", "Industry & Operations",
    "Supply Chain & Trade", "Energy", "Sustainability", "Research",
]

# fixed text: the reason given when an annotation out of scope has none
OUT_OF_SCOPE = "Article content is outside the editorial scope"

TITLE_CATEGORY_TERMS = [
    ("Energy", ["oil", "gas", "crude", "brent", "wti", "refinery", "opec", "solar", "nuclear",
                "electricity", "power", "grid", "fuel"]),
    ("Markets & Economy", ["fed", "fomc", "inflation", "cpi", "ecb", "interest rate", "yield", "gdp",
                           "recession", "central bank"]),
    ("AI & Technology", ["ai", "software", "chip", "semiconductor", "cloud", "model", "algorithm"]),
]

EVENT_SECTIONS = {
    "ai & technology": "TECH", "ai": "TECH", "technology": "TECH", "tech": "TECH", "software": "TECH",
    "semiconductors": "TECH",
    "markets & economy": "ECONOMY", "economy": "ECONOMY", "macro & fx": "ECONOMY",
    "sovereign yields": "ECONOMY", "monetary policy": "ECONOMY", "markets": "ECONOMY",
    "commodities": "BUSINESS", "precious metals": "BUSINESS",
    "energy": "ENERGY", "oil & gas": "ENERGY", "clean energy": "ENERGY", "power & utilities": "ENERGY",
    "renewable energy": "ENERGY",
    "trade": "TRADE", "supply chain": "TRADE",
    "business": "BUSINESS", "industry & operations": "BUSINESS", "industry": "BUSINESS",
    "corporate": "BUSINESS", "biotech": "BUSINESS", "agtech": "BUSINESS",
    "sustainability": "SUSTAINABILITY", "climate": "SUSTAINABILITY", "esg": "SUSTAINABILITY",
    "world": "WORLD", "geopolitics": "WORLD", "general": "WORLD",
}

EDITION_SECTIONS = {
    "geopolitics": "Geopolitics", "politics": "Geopolitics",
    "markets & economy": "Markets & Economy", "markets": "Markets & Economy",
    "economy": "Markets & Economy",
    "business": "Business",
    "ai & technology": "AI & Technology", "ai": "AI & Technology", "tech": "AI & Technology",
    "technology": "AI & Technology",
    "energy": "Energy & Commodities", "oil": "Energy & Commodities", "commodities": "Energy & Commodities",
    "supply chain & trade": "Supply Chain & Trade", "trade": "Supply Chain & Trade",
    "supply chain": "Supply Chain & Trade",
    "industry & operations": "Industry & Operations", "industry": "Industry & Operations",
    "sustainability": "World Watch", "climate": "World Watch", "world": "World Watch",
    "international": "World Watch",
    "research": "Strategic Briefs",
}

FEED_SECTIONS = [
    ("world", "World"), ("international", "World"), ("geopolitics", "Geopolitics"),
    ("politics", "Geopolitics"), ("business", "Business"), ("markets & economy", "Markets & Economy"),
    ("markets", "Markets & Economy"), ("economy", "Markets & Economy"), ("finance", "Markets & Economy"),
    ("ai & technology", "AI & Technology"), ("ai", "AI & Technology"), ("tech", "AI & Technology"),
    ("technology", "AI & Technology"), ("industry & operations", "Industry & Operations"),
    ("industry", "Industry & Operations"), ("operations", "Industry & Operations"),
    ("mining", "Industry & Operations"), ("manufacturing", "Industry & Operations"),
    ("construction", "Industry & Operations"), ("supply chain & trade", "Supply Chain & Trade"),
    ("trade", "Supply Chain & Trade"), ("supply chain", "Supply Chain & Trade"), ("energy", "Energy"),
    ("oil", "Energy"), ("sustainability", "Sustainability"), ("climate", "Sustainability"),
    ("research", "Research"), ("science", "Research"),
]

STRATEGIC_TERMS = ["ai", "tech", "economy", "markets", "monetary", "macro", "energy", "business"]
OFFICIAL_SOURCE_TYPES = ["CENTRAL_BANK", "GOVERNMENT", "COMPANY_PRIMARY"]
FEED_SOURCE_TYPES = [
    "rss", "news_feed", "institutional_research", "central_bank", "company_primary",
    "commodity_research", "energy_organization", "regulator",
]
UNSUPPORTED_SOURCE_TYPES = ["html", "social_api", "github_releases"]

# --- fixed values: edition score ---------------------------------------------
EDITION_WEIGHTS = {
    "relevance": 0.35, "importance": 0.30, "recency": 0.15, "trust": 0.10, "source": 0.05, "geo": 0.05,
}
EDITION_TRUST = {
    "institutional": 1.0, "primary": 1.0, "useful": 0.8, "specialist": 0.8, "open_source_signal": 0.6,
    "social_signal": 0.4, "state_affiliated": 0.2,
}

# --- fixed values: queue priority --------------------------------------------
PRIORITY_TRUST = {
    "primary": 25, "institutional": 20, "open_source_signal": 15, "state_affiliated": 10, "useful": 5,
}
PRIORITY_FAMILY = {
    "central_bank": 20, "government": 15, "research": 10, "university": 10, "consulting": 10, "news": 5,
    "industry": 5, "open_source": 5,
}
PRIORITY_CATEGORY = {
    "AI & Technology": 15, "Geopolitics": 15, "Supply Chain & Trade": 12, "Markets & Economy": 12,
    "Energy": 12, "Commodities": 12, "Sustainability": 10, "Industry & Operations": 10, "Research": 10,
    "World": 8, "Business": 8,
}
CRITICAL_KEYWORDS = [
    "AI", "artificial intelligence", "semiconductor", "chip(?:s)?", "GPU", "Nvidia", "TSMC", "OpenAI",
    "Anthropic", "Federal Reserve", "FOMC", "ECB", "interest rate(?:s)?", "inflation", "OPEC", "oil",
    "LNG", "war", "ceasefire",
]
HIGH_KEYWORDS = [
    "supply chain", "shipping", "freight", "container", "trade route", "disruption", "gas",
    "electricity", "gold", "copper", "critical mineral(?:s)?", "Bank of England", "GDP", "ion bond",
    "tariff(?:s)?", "sanction(?:s)?", "BRICS", "G7", "G20", "NATO", "manufacturing", "automation",
    "robotics", "decarbonisation", "nuclear", "climate policy",
]
NORMAL_KEYWORDS = [
    "economy", "market(?:s)?", "trade", "energy", "technology", "industry", "production", "renewable",
    "solar", "wind", "factory", "maintenance", "research",
]
LOW_KEYWORDS = [
    "sport(?:s)?", "match", "score(?:s)?", "football", "basketball", "celebrity", "gossip", "fashion",
    "lifestyle", "entertainment", "hollywood", "movie", "actor", "actress", "horoscope",
]

# --- fixed values: annotation states -----------------------------------------
RETRYABLE_STATUSES = ["failed", "timeout", "unavailable", "temporary_error"]
FAILED_STATUSES = ["failed", "invalid_json", "timeout", "unavailable", "temporary_error"]
FINAL_STATUSES = ["success", "out_of_scope"]

# --- fixed values: entities --------------------------------------------------
RAW_TYPE_MAP = {
    "company": "COMPANY", "technology company": "COMPANY", "software company": "COMPANY",
    "technology provider": "COMPANY", "corporate": "COMPANY", "financial institution": "COMPANY",
    "type: financial institution": "COMPANY", "pharmaceutical company": "COMPANY",
    "media organization": "COMPANY",
    "central bank": "CENTRAL_BANK",
    "government": "GOVERNMENT_BODY", "government body": "GOVERNMENT_BODY",
    "regulatory body": "GOVERNMENT_BODY", "ministry": "GOVERNMENT_BODY",
    "military organization": "GOVERNMENT_BODY",
    "organization": "ORGANIZATION", "organisation": "ORGANIZATION", "type: organization": "ORGANIZATION",
    "group": "ORGANIZATION", "operational group": "ORGANIZATION", "influence network": "ORGANIZATION",
    "influence campaign": "ORGANIZATION", "influence operation": "ORGANIZATION",
    "educational institution": "ORGANIZATION",
    "country": "COUNTRY", "location": "REGION", "region": "REGION", "capital": "REGION",
    "person": "PERSON", "politician": "PERSON", "prime minister": "PERSON", "governor": "PERSON",
    "ceo": "PERSON", "central bank executive": "PERSON", "central bank official": "PERSON",
    "economist": "PERSON", "quantum physicist": "PERSON", "filmmaker": "PERSON",
    "technology": "TECHNOLOGY", "framework": "TECHNOLOGY", "api": "TECHNOLOGY",
    "cloud service": "TECHNOLOGY", "service": "TECHNOLOGY",
    "product": "PRODUCT", "product/platform": "PRODUCT", "software product": "PRODUCT",
    "model": "PRODUCT", "ai model": "PRODUCT", "artificial intelligence model": "PRODUCT",
    "benchmark": "PRODUCT",
    "commodity": "COMMODITY",
}
COUNTRY_ALIASES = {
    "united states": "US", "us": "US", "u.s.": "US", "usa": "US", "united states of america": "US",
    "united kingdom": "GB", "uk": "GB", "u.k.": "GB", "britain": "GB", "great britain": "GB",
    "india": "IN", "republic of india": "IN",
    "china": "CN", "prc": "CN", "people's republic of china": "CN",
    "japan": "JP", "nippon": "JP",
    "germany": "DE", "federal republic of germany": "DE",
    "france": "FR", "french republic": "FR",
    "russia": "RU", "russian federation": "RU",
}
NAME_SUFFIXES = (
    "inc inc. corp corp. corporation ltd ltd. limited plc co co. company group holdings llc sa ag nv se"
).split()
GENERIC_TERMS = (
    "company companies firm firms business businesses corporation government governments official "
    "officials analyst analysts investor investors market markets industry sector product service "
    "enterprise source author report news country nation agency regulator bank banks executive "
    "executives group network"
).split()

# --- fixed values: signals and grounding -------------------------------------
PREDICTIVE_WORDS = [
    "will", "likely", "expected to", "set to", "forecast", "predict", "predicts", "predicted", "caused",
    "drove", "triggered",
]
POLICY_CATEGORIES = ["MONETARY_POLICY", "Markets & Economy", "Industry & Operations"]
SENSATIONAL_TERMS = [
    "shocking", "mindblowing", "unbelievable", "skyrocketing", "massive disaster",
    "catastrophic collapse", "insane", "miracle", "bombshell", "stunning",
]
CAUSAL_TRIGGERS = ["caused", "drove", "triggered", "led to", "resulted in", "because of", "forced by"]
CAUSAL_EVIDENCE = ["due to", "as a result", "after", "following"]
GENERIC_THEME_SUFFIXES = [
    "developments", "news", "updates", "stories", "key developments", "top stories", "highlights",
]
GENERIC_SECTION_NAMES = [
    "tech", "technology", "world", "business", "energy", "economy", "trade", "sustainability", "general",
    "markets",
]
GENERIC_THEME_TITLES = ["key developments", "top stories", "main developments", "key updates"]
GENERIC_THEME_FILLERS = ["key", "main", "top", "latest"]

# --- fixed values: archive search --------------------------------------------
SEARCH_STOPWORDS = (
    "what did say about the a an is are in on of for to how why who where which with today yesterday "
    "this week month past last days happened latest news show tell me"
).split()
EXPANSION_STOPWORDS = SEARCH_STOPWORDS + ["documented", "across", "sources"]
EXPANSION_RULES = {
    "sustainability": ["decarbonization", "carbon", "emissions", "environmental", "lower-carbon", "clean"],
    "sustainable": ["decarbonization", "carbon", "emissions", "environmental", "lower-carbon"],
    "renewable": ["biofuel", "biofuels", "solar", "wind", "ethanol", "clean energy"],
    "renewable energy": ["biofuel", "biofuels", "solar", "wind", "ethanol", "clean energy"],
    "grain": ["wheat", "corn", "maize", "soybean", "rice", "crop"],
    "grains": ["wheat", "corn", "maize", "soybean", "rice", "crops"],
    "agriculture": ["farming", "crop", "crops", "feedstock", "agricultural"],
    "agricultural": ["farming", "crop", "crops", "feedstock", "agriculture"],
    "supply chain": ["logistics", "transport", "shipping", "freight", "distribution"],
    "supply chains": ["logistics", "transport", "shipping", "freight", "distribution"],
    "ai": ["artificial intelligence", "machine learning", "generative ai", "autonomous", "digital twin"],
    "artificial intelligence": ["machine learning", "generative ai", "autonomous", "digital twin"],
    "geopolitics": ["sanctions", "diplomacy", "summit", "treaty", "foreign policy"],
    "geopolitical": ["sanctions", "diplomacy", "summit", "treaty", "foreign policy"],
}
WEEK_PHRASES = ["this week", "past 7 days", "last 7 days", "past week", "last week"]
MONTH_PHRASES = ["this month", "past month", "last 30 days"]

# --- fixed values: places ----------------------------------------------------
COUNTRY_NAMES = {
    "US": "United States", "GB": "United Kingdom", "CN": "China", "BR": "Brazil", "FR": "France",
    "ZA": "South Africa", "CH": "Switzerland", "NL": "Netherlands", "IN": "India", "JP": "Japan",
    "DE": "Germany", "RU": "Russia", "EG": "Egypt", "ET": "Ethiopia", "IR": "Iran",
    "AE": "United Arab Emirates", "SA": "Saudi Arabia", "CA": "Canada", "IT": "Italy", "AU": "Australia",
    "KR": "South Korea", "SG": "Singapore", "ID": "Indonesia", "AR": "Argentina", "MX": "Mexico",
    "TR": "Turkey", "EU": "European Union", "QA": "Qatar", "FI": "Finland", "DK": "Denmark",
    "IS": "Iceland", "NO": "Norway", "SE": "Sweden", "EE": "Estonia", "LV": "Latvia", "LT": "Lithuania",
    "BN": "Brunei", "KH": "Cambodia", "LA": "Laos", "MY": "Malaysia", "MM": "Myanmar",
    "PH": "Philippines", "TH": "Thailand", "TL": "Timor-Leste", "VN": "Vietnam",
}
COUNTRY_NAME_ALIASES = {
    "usa": "US", "united states of america": "US", "uk": "GB", "great britain": "GB", "uae": "AE",
    "russia": "RU", "russian federation": "RU", "south korea": "KR", "republic of korea": "KR",
    "korea": "KR",
}
# The whole table of ISO 3166-1 numeric codes.
ISO_NUMERIC = {
    "004": "AF", "008": "AL", "012": "DZ", "016": "AS", "020": "AD", "024": "AO", "028": "AG", "032": "AR",
    "051": "AM", "036": "AU", "040": "AT", "031": "AZ", "044": "BS", "048": "BH", "050": "BD", "052": "BB",
    "112": "BY", "056": "BE", "084": "BZ", "204": "BJ", "060": "BM", "064": "BT", "068": "BO", "070": "BA",
    "072": "BW", "076": "BR", "096": "BN", "100": "BG", "854": "BF", "108": "BI", "116": "KH", "120": "CM",
    "124": "CA", "132": "CV", "140": "CF", "148": "TD", "152": "CL", "156": "CN", "170": "CO", "174": "KM",
    "178": "CG", "180": "CD", "188": "CR", "384": "CI", "191": "HR", "192": "CU", "196": "CY", "203": "CZ",
    "208": "DK", "262": "DJ", "212": "DM", "214": "DO", "218": "EC", "818": "EG", "222": "SV", "226": "GQ",
    "232": "ER", "233": "EE", "231": "ET", "242": "FJ", "246": "FI", "250": "FR", "266": "GA", "270": "GM",
    "268": "GE", "276": "DE", "288": "GH", "300": "GR", "308": "GD", "320": "GT", "324": "GN", "624": "GW",
    "328": "GY", "332": "HT", "340": "HN", "348": "HU", "352": "IS", "356": "IN", "360": "ID", "364": "IR",
    "368": "IQ", "372": "IE", "376": "IL", "380": "IT", "388": "JM", "392": "JP", "400": "JO", "398": "KZ",
    "404": "KE", "296": "KI", "408": "KP", "410": "KR", "414": "KW", "417": "KG", "418": "LA", "428": "LV",
    "422": "LB", "426": "LS", "430": "LR", "434": "LY", "438": "LI", "440": "LT", "442": "LU", "807": "MK",
    "450": "MG", "454": "MW", "458": "MY", "462": "MV", "466": "ML", "470": "MT", "584": "MH", "478": "MR",
    "480": "MU", "484": "MX", "583": "FM", "498": "MD", "492": "MC", "496": "MN", "499": "ME", "504": "MA",
    "508": "MZ", "104": "MM", "516": "NA", "520": "NR", "524": "NP", "528": "NL", "554": "NZ", "558": "NI",
    "562": "NE", "566": "NG", "578": "NO", "512": "OM", "586": "PK", "585": "PW", "591": "PA", "598": "PG",
    "600": "PY", "604": "PE", "608": "PH", "616": "PL", "620": "PT", "634": "QA", "642": "RO", "643": "RU",
    "646": "RW", "659": "KN", "662": "LC", "670": "VC", "882": "WS", "674": "SM", "678": "ST", "682": "SA",
    "686": "SN", "688": "RS", "690": "SC", "694": "SL", "702": "SG", "703": "SK", "705": "SI", "090": "SB",
    "706": "SO", "710": "ZA", "728": "SS", "724": "ES", "144": "LK", "729": "SD", "740": "SR", "748": "SZ",
    "752": "SE", "756": "CH", "760": "SY", "158": "TW", "762": "TJ", "834": "TZ", "764": "TH", "626": "TL",
    "768": "TG", "776": "TO", "780": "TT", "788": "TN", "792": "TR", "795": "TM", "798": "TV", "800": "UG",
    "804": "UA", "784": "AE", "826": "GB", "840": "US", "858": "UY", "860": "UZ", "548": "VU", "862": "VE",
    "704": "VN", "887": "YE", "894": "ZM", "716": "ZW",
}
LENSES = {
    "brics": ("BRICS", ["BR", "RU", "IN", "CN", "ZA", "EG", "ET", "IR", "AE", "SA"]),
    "g7": ("G7", ["US", "GB", "DE", "FR", "IT", "JP", "CA", "EU"]),
    "g20": ("G20", ["US", "GB", "DE", "FR", "IT", "JP", "CA", "BR", "RU", "IN", "CN", "ZA", "MX", "ID",
                    "TR", "AR", "SA", "KR", "AU", "EU"]),
    "eu": ("European Union", ["DE", "FR", "IT", "NL", "BE", "ES", "PT", "AT", "SE", "FI", "DK", "IE", "GR",
                              "PL", "CZ", "HU", "SK", "RO", "BG", "HR", "SI", "LT", "LV", "EE", "CY", "MT",
                              "LU", "EU"]),
    "opec": ("OPEC", ["SA", "AE", "IR", "IQ", "KW", "DZ", "LY", "NG", "CG", "GA", "GQ"]),
    "gcc": ("GCC", ["SA", "AE", "QA", "KW", "OM", "BH"]),
    "asean": ("ASEAN", ["BN", "KH", "ID", "LA", "MY", "MM", "PH", "SG", "TH", "TL", "VN"]),
    "nordics": ("Nordics", ["DK", "FI", "IS", "NO", "SE"]),
    "baltics": ("Baltics", ["EE", "LV", "LT"]),
}
FAMILY_LABELS = {
    "news": "News & Media", "government": "Government & Multilateral", "central_bank": "Central Bank",
    "consulting": "Consulting", "university": "University & Academia", "research": "Research Institute",
    "industry": "Industry & Tech", "open_source": "Open Source",
}
TIER_LABELS = {
    "primary": ("Primary", 1), "institutional": ("Institutional", 2),
    "open_source_signal": ("Open Source Signal", 3), "social_signal": ("Social Signal", 4),
    "state_affiliated": ("State-Affiliated", 5),
}
SECTOR_DESCRIPTIONS = {
    "AI & Technology": "Artificial intelligence, cybersecurity, software and emerging technology.",
    "Geopolitics": "Diplomacy, conflict, security and international power relations.",
    "Markets & Economy": "Macroeconomics, financial markets, monetary policy and economic developments.",
    "Business": "Companies, strategy, investment, earnings and corporate developments.",
    "Energy": "Oil, gas, electricity, renewables and global energy markets.",
    "Supply Chain & Trade": "Logistics, shipping, trade flows and global supply networks.",
    "Industry & Operations": "Manufacturing, mining, infrastructure and industrial operations.",
    "Sustainability": "Climate, environmental policy, transition and sustainable industry.",
    "World": "Strategically relevant developments across the international news environment.",
}

# --- fixed values: markets ---------------------------------------------------
_MOVES = "fell|rose|dropped|surged|tumbled|rallied|slid|sank|gained|lost|plunged"
MARKET_MOVING_PATTERNS = [
    rf"\bstocks?\s+({_MOVES})\b",
    rf"\bmarkets?\s+({_MOVES})\b",
    rf"\bshares?\s+({_MOVES})\b",
    rf"\bindex\s+({_MOVES})\b",
    rf"\bequities?\s+({_MOVES})\b",
    r"\binvestors?\s+(reacted\s+to|weighed|fled|flocked\s+to|poured\s+into)\b",
    r"\bwall\s+street\s+(fell|rose|dropped|surged|tumbled|rallied|slid)\b",
    r"\byields?\s+(spiked|jumped|surged|dropped|fell|climbed|rose|slid)\b",
    r"\bmarket\s+sell-?off\b",
    r"\bstock\s+rally\b",
    r"\boil\s+(prices?\s+)?(fell|rose|surged|dropped|tumbled|spiked|rallied)\b",
    r"\bgold\s+(prices?\s+)?(fell|rose|surged|dropped|tumbled|spiked|rallied)\b",
    r"\bcrude\s+(fell|rose|surged|dropped|tumbled|spiked)\b",
    r"\bcurrency\s+(fell|rose|surged|dropped|tumbled|slid)\b",
    r"\binterest\s+rates?\s+(hike|cut|raised|lowered|slashed|paused|held)\b",
    r"\bcentral\s+bank\s+(hikes?|cuts?|paused?|held|decision)\b",
]
MARKET_REGIONS = [
    ("United States",
     ["united states", "us", "fed", "federal reserve", "fomc", "powell", "federal funds", "wall street",
      "s&p", "nasdaq", "dow", "us equities", "us economy", "treasury", "usd", "american"],
     ["US", "USA"], ["Markets", "Business", "Tech", "Economy"]),
    ("United Kingdom",
     ["united kingdom", "uk", "bank of england", "boe", "bank rate", "mpc", "ftse", "gilt",
      "uk equities", "british economy", "sterling", "gbp", "london"],
     ["GB", "UK"], ["Markets", "Economy"]),
    ("India",
     ["india", "rbi", "reserve bank of india", "repo rate", "g-sec", "mpc", "nifty", "sensex",
      "indian equities", "indian economy", "rupee", "inr", "mumbai"],
     ["IN", "IND"], ["Markets", "Economy"]),
    ("Japan",
     ["japan", "bank of japan", "boj", "jgb", "overnight call rate", "monetary policy", "nikkei",
      "japanese equities", "japanese economy", "yen", "jpy", "tokyo"],
     ["JP", "JPN"], ["Markets", "Tech"]),
    ("Europe",
     ["europe", "eu", "eurozone", "ecb", "european central bank", "deposit facility", "lagarde", "bund",
      "stoxx", "european equities", "euro", "eur", "frankfurt", "paris"],
     ["DE", "FR", "EU", "IT", "ES"], ["Markets", "Economy", "Geopolitics"]),
    ("China",
     ["china", "pboc", "people's bank of china", "csi", "shanghai", "shenzhen", "chinese equities",
      "yuan", "renminbi", "cny", "beijing"],
     ["CN", "CHN"], ["Markets", "Economy", "Tech"]),
    ("Energy",
     ["oil", "crude", "brent", "wti", "opec", "opec+", "petroleum", "energy supply", "refinery",
      "middle east supply disruption", "gasoline", "fuel"],
     ["US", "SA", "RU", "AE"], ["Energy", "Markets", "Economy"]),
    ("Precious Metals",
     ["gold", "silver", "precious metals", "safe haven", "bullion", "comex", "metals", "mining"],
     ["US", "ZA", "AU", "CA"], ["Markets", "Economy"]),
    ("Critical Minerals",
     ["rare earth", "critical minerals", "strategic metals", "neodymium", "ndpr", "lynas",
      "mp materials", "mineral supply chain", "remx", "lithium", "cobalt"],
     ["CN", "AU", "US"], ["Mining", "Tech", "Energy"]),
    ("FX",
     ["currency", "foreign exchange", "forex", "fx", "sterling", "euro", "rupee", "yen", "dollar",
      "federal reserve", "bank of england", "ecb", "rbi", "bank of japan"],
     ["US", "GB", "EU", "IN", "JP"], ["Markets", "Economy"]),
    ("Sovereign Yields",
     ["treasury", "bond", "yield", "gilt", "bund", "government bond", "g-sec", "jgb", "debt market",
      "sovereign debt", "auction", "sovereign yield"],
     ["US", "GB", "DE", "JP", "IN"], ["Markets", "Economy"]),
    ("Monetary Policy",
     ["monetary policy", "interest rates", "fed", "ecb", "boe", "boj", "rbi", "fomc", "mpc",
      "central bank", "bank rate", "repo rate", "deposit facility"],
     ["US", "GB", "EU", "JP", "IN"], ["Markets", "Economy"]),
]
INDEX_BASKET = [
    ("United States", "S&P 500", "SPX", "USD"),
    ("United Kingdom", "FTSE 100", "FTSE", "GBP"),
    ("India", "NIFTY 50", "NSEI", "INR"),
    ("Japan", "Nikkei 225", "N225", "JPY"),
    ("Europe", "STOXX Europe 600", "STOXX", "EUR"),
    ("China", "CSI 300", "399972", "CNY"),
]
CROSS_ASSET_BASKET = [
    ("BRENT_CRUDE_FUTURES", "Energy", "ENERGY_FUTURES", "Brent Crude Futures", "USD"),
    ("WTI_CRUDE_FUTURES", "Energy", "ENERGY_FUTURES", "WTI Crude Futures", "USD"),
    ("GOLD_FUTURES", "Precious Metals", "METALS_FUTURES", "Gold Futures", "USD"),
    ("SILVER_FUTURES", "Precious Metals", "METALS_FUTURES", "Silver Futures", "USD"),
    ("REMX_EQUITY_PROXY", "Critical Minerals", "EQUITY_PROXY", "Rare Earth & Strategic Metals", "USD"),
    ("GBP_USD", "FX", "FX", "GBP / USD", "USD"),
    ("EUR_USD", "FX", "FX", "EUR / USD", "USD"),
    ("USD_INR", "FX", "FX", "USD / INR", "INR"),
    ("USD_JPY", "FX", "FX", "USD / JPY", "JPY"),
]
YIELD_BASKET = [
    ("US_10Y_TREASURY", "United States", 4.27, 4.20),
    ("UK_10Y_GILT", "United Kingdom", 4.12, 4.05),
    ("DE_10Y_BUND", "Germany", 2.24, 2.19),
    ("JP_10Y_JGB", "Japan", 0.98, 0.94),
    ("IN_10Y_GSEC", "India", 6.86, 6.84),
]
POLICY_BASKET = [
    ("Federal Reserve", None, None, 4.75, 5.00, 4.75),
    ("Bank of England", 4.75, 4.75, None, None, None),
    ("European Central Bank", 3.25, 3.50, None, None, None),
    ("Bank of Japan", 0.25, 0.25, None, None, None),
    ("Reserve Bank of India", 6.50, 6.50, None, None, None),
]
# region, symbol, zone, sessions as minutes of day, pre-open minute, post-close minute
EXCHANGES = [
    ("United States", "SPX", "America/New_York", [(570, 960)], 510, 1020),
    ("United Kingdom", "FTSE", "Europe/London", [(480, 990)], 420, 1050),
    ("India", "NSEI", "Asia/Kolkata", [(555, 930)], 540, 960),
    ("Japan", "N225", "Asia/Tokyo", [(540, 690), (750, 930)], 480, 990),
    ("Europe", "STOXX", "Europe/Paris", [(540, 1050)], 480, 1110),
    ("China", "399972", "Asia/Shanghai", [(570, 690), (780, 900)], 540, 930),
]
CROSS_ASSET_KEYS = [
    "^GSPC", "^FTSE", "BZ=F", "GC=F", "^TNX", "GBPUSD=X", "SPX", "FTSE", "BRENT", "GOLD", "US10Y", "GBP/USD",
]

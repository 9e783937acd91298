"""Patterns and registries whose text decides results."""

# Fixed values, as published; matched without regard to case unless said otherwise.
MACRO_TITLE = (
    r"\b(?:tariffs?|sanctions?|reciprocal trade|export controls?|central banks?|interest rates?|inflation|unemployment|employment|"
    r"gross domestic product|GDP|recession|fiscal policy|monetary policy|government spending|national budget|sovereign debt|banking crisis|"
    r"financial crisis|oil|crude|gas prices?|fuel shipments?|diesel|energy|food security|supply chain|semiconductors?|military affiliate|"
    r"ceasefire|wars?|invasion|ballistic missiles?|nuclear weapons?|presidential election|parliamentary election|hurricane|earthquake|"
    r"FOMC|Federal Reserve|rate cuts?|rate hikes?|rate decisions?|nonfarm payrolls?|jobs report|trade deal|embargo|sovereign default|"
    r"bank failures?|bank runs?|liquidity crisis|capital controls?|Nord Stream|global trade|trade volumes?|flooding disaster|humanitarian crisis|famine|"
    r"funding cuts.*refugees|airstrikes?|air strikes?|military strikes?|missiles?|naval blockade|coup)\b"
)
RATE_MARKET = r"\b(?:rigging rates|rate rigging|yield curve|bond yields?|housing crisis)\b"
#: Pairs that count only together.
CONTEXT_PAIRS = [
    (r"\b(?:Fed|Powell)\b", r"\b(?:rates?|inflation|monetary|jobs|employment|economy|recession|bonds?)\b"),
    (
        r"\b(?:Russia|Russian|Ukraine|Ukrainian|Iran|Iranian|Israel|Israeli|Houthi|Saudi|Ethiopia|Eritrea|Taiwan|NATO|Sudan|Syria|Syrian|Gaza|Myanmar|Security Council|troops|army|military)\b",
        r"\b(?:attacks?|strikes?|cross(?:es|ed)? (?:the )?border|invades?|invasions?|mobiliz(?:e|es|ation)|bombardment|escalation|incursions?)\b",
    ),
    (
        r"\b(?:government|governments|central bank|White House|finance minister)\b",
        r"\b(?:internet.*protest|internet shutdown|budget|tax(?:es)?|spending|debt|deficit|trade|tariff|sanction|rates?)\b",
    ),
]
TOPICS = [
    ("TRADE_POLICY", r"\b(tariffs?|sanctions?|reciprocal trade|export controls?|trade agreements?|trade deal|embargo)\b"),
    ("ENERGY", r"\b(oil|crude|energy|refiner\w*|pipelines?|natural gas)\b"),
    ("MONETARY_POLICY", r"\b(central bank|federal reserve|fomc|interest rates?|monetary policy|rate cuts?|rate hikes?)\b"),
    ("ECONOMIC_DATA", r"\b(inflation|unemployment|employment|payroll|gdp|recession|food security)\b"),
    ("TECH_SUPPLY_CHAIN", r"\b(semiconductors?|chips?|military affiliate|alibaba|nvidia)\b"),
    ("GEOPOLITICS", r"\b(war|ceasefire|invasion|airstrikes?|missiles?|military|blockade|coup)\b"),
    ("POLICY_AND_SYSTEMIC_RISK", r"\b(elections?|government|budget|debt|financial crisis|bank failures?|capital controls|liquidity)\b"),
    ("DISASTER", r"\b(earthquake|hurricane|flooding|famine|disaster)\b"),
]
CATEGORY_EXCLUDED = [
    r"\b(nba|nfl|mlb|nhl|soccer|tennis|super bowl|world cup|oscar|grammy|gta|movie|album)\b",
    r"\b(bitcoin|ethereum|btc|eth|solana|crypto)\b",
]
CATEGORIES = [
    ("MONETARY_POLICY", r"\b(federal reserve|fomc|fed|ecb|boe|boj|bank of japan|bank of england|european central bank|interest rates?|rate cuts?|rate hikes?)\b"),
    (
        "ECONOMY_TRADE",
        r"\b(inflation|cpi|gdp|unemployment|nonfarm|payrolls?|recession|tariffs?|sanctions?|export controls?|trade (deal|policy|war|agreement)|fiscal|government shutdown|debt ceiling)\b",
    ),
    ("ENERGY", r"\b(oil|crude|opec|energy supply|natural gas|refiner(y|ies)|petroleum)\b"),
    (
        "GEOPOLITICS",
        r"\b(ceasefire|invasion|military|nuclear (deal|agreement|negotiations)|strait of hormuz|blockade)\b"
        r"|\b(war|strike|attack)\b.*\b(iran|israel|taiwan|china|russia|ukraine|us|united states)\b"
        r"|\b(iran|israel|taiwan|china|russia|ukraine|us|united states)\b.*\b(war|strike|attack)\b",
    ),
]
#: The cue that names the reason; differs from CATEGORIES for geopolitics.
CUE_GEOPOLITICS = r"\b(ceasefire|invasion|military|nuclear (deal|agreement|negotiations)|strait of hormuz|blockade|war|strike|attack)\b"
RATE_DECISION = (
    r"^(ECB|European Central Bank|Fed|Federal Reserve) (cuts|lowers|reduces|raises|hikes|increases) (?:interest )?rates by "
    r"([0-9]{1,3}(?:\.[0-9]{1,2})?)\s*(?:basis points|bps?|bp)[.!]?$"
)
ANALYSIS_CUE = r"\b(analysis|opinion|commentary|outlook|forecast|interview|linking|review|threaten\w*|could|may|expect\w*)\b|^(?:How|Why|What)\b"
MECHANISMS = [
    ("MONETARY_POLICY", r"\b(interest rates?|monetary policy|rate cuts?|rate hikes?)\b", r"\b(Fed(?!\s+up\b)|Federal Reserve|FOMC|ECB|European Central Bank)\b", None),
    ("TRADE_POLICY", r"\b(tariffs?|sanctions?|export controls?|reciprocal trade|trade agreements?|trade deal|embargo)\b", None, None),
    (
        "OIL_SUPPLY", r"\b(crude(?: oil)?|petroleum|WTI|Brent|oil pipelines?|oil supply|oil production|oil prices)\b", None,
        r"\b(olive|cooking|vegetable|palm|essential) oil\b",
    ),
    ("GEOPOLITICAL_SUPPLY", r"\b(war|conflict|blockade|attack\w*|airstrikes?)\b", r"\b(shipping|supply|trade|transport|strait|Hormuz|pipelines?)\b", None),
]
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]
#: region id, display name, type, aliases
REGIONS = [
    ("united-states", "United States", "COUNTRY", ["United States", "U.S.", "USA", "US", "America"]),
    ("china", "China", "COUNTRY", ["China", "Chinese", "中國"]),
    ("taiwan", "Taiwan", "COUNTRY_CONTEXT", ["Taiwan", "Taiwanese", "臺灣", "台灣"]),
    ("japan", "Japan", "COUNTRY", ["Japan", "Japanese", "日本"]),
    ("united-kingdom", "United Kingdom", "COUNTRY", ["United Kingdom", "UK", "英國"]),
    ("euro-area", "Euro Area", "JURISDICTION", ["euro area", "eurozone", "Eurosystem", "歐元區"]),
    ("european-union", "European Union", "JURISDICTION", ["European Union", "EU", "歐盟"]),
    ("europe", "Europe", "CONTINENT", ["Europe", "European", "歐洲"]),
    ("middle-east", "Middle East", "MACRO_REGION", ["Middle East", "中東"]),
    ("iran", "Iran", "COUNTRY", ["Iran", "Iranian", "伊朗"]),
    ("red-sea", "Red Sea", "SEA", ["Red Sea", "紅海"]),
    ("persian-gulf", "Persian Gulf", "SEA", ["Persian Gulf", "波斯灣"]),
    ("taiwan-strait", "Taiwan Strait", "SEA", ["Taiwan Strait", "臺灣海峽", "台灣海峽"]),
    ("south-china-sea", "South China Sea", "SEA", ["South China Sea", "南海"]),
    ("global", "Global", "GLOBAL", ["global", "worldwide", "world", "全球"]),
]
#: institution id, jurisdiction region id, aliases
INSTITUTIONS = [
    ("ecb", "euro-area", ["ECB", "European Central Bank", "Eurosystem", "歐洲中央銀行"]),
    ("eia", "united-states", ["EIA", "Energy Information Administration", "美國能源資訊署"]),
]
UPPER_CASE_ALIASES = ["US", "UK", "EU", "USA"]

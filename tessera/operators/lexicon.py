"""Look-up values of the normaliser."""

# Tables, word lists and patterns that results depend on.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp",
    "co": "co", "company": "co", "kanpani": "co", "kampani": "co",
    "ltd": "ltd", "limited": "ltd", "li": "ltd",
    "pvt": "pvt", "private": "pvt", "praivet": "pvt", "pra": "pvt", "prayvet": "pvt",
    "llc": "llc", "llp": "llp", "elaelapi": "llp", "elelpi": "llp", "lp": "lp", "plc": "plc",
    "pllc": "pllc", "gmbh": "gmbh", "srl": "srl", "bv": "bv", "ag": "ag", "pte": "pte",
    "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "sci": "sci", "eurl": "eurl",
    "snc": "snc", "selarl": "selarl", "scp": "scp", "scop": "scop",
    "praaivett": "pvt", "limittedd": "ltd", "praa": "pvt", "limitedd": "ltd",
}
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado",
    "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho",
    "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
    "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota",
    "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada",
    "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina",
    "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas",
    "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia",
    "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia",
}
IN_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh",
    "ga": "goa", "gj": "gujarat", "hr": "haryana", "hp": "himachal pradesh", "jh": "jharkhand",
    "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur",
    "ml": "meghalaya", "mz": "mizoram", "nl": "nagaland", "od": "odisha", "pb": "punjab", "rj": "rajasthan",
    "sk": "sikkim", "tn": "tamil nadu", "tg": "telangana", "ts": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "wb": "west bengal", "dl": "delhi",
    "jk": "jammu and kashmir", "ch": "chandigarh", "py": "puducherry",
}
US_STREET = {
    "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "ct": "court", "hwy": "highway", "pkwy": "parkway", "cir": "circle", "sq": "square", "pl": "place",
    "ter": "terrace", "trl": "trail", "fwy": "freeway", "expy": "expressway", "apt": "apartment",
    "ste": "suite", "bldg": "building", "flr": "floor", "fl": "floor", "hts": "heights", "jct": "junction",
    "mt": "mount", "ft": "fort", "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth",
    "6th": "sixth", "7th": "seventh", "8th": "eighth", "9th": "ninth", "10th": "tenth",
}
IN_STREET = {
    "rd": "road", "nr": "near", "opp": "opposite", "bldg": "building", "flr": "floor", "apt": "apartment",
    "soc": "society", "ngr": "nagar", "mkt": "market", "sec": "sector", "dist": "district",
    "tq": "taluka", "tal": "taluka", "ind": "industrial", "estt": "estate",
}
FR_STREET = {
    "r": "rue", "av": "avenue", "ave": "avenue", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard",
    "pl": "place", "all": "allee", "imp": "impasse", "ch": "chemin", "chem": "chemin", "rte": "route",
    "fbg": "faubourg", "sq": "square", "qu": "quai", "crs": "cours", "st": "saint", "ste": "sainte",
    "pte": "porte", "prom": "promenade", "res": "residence", "zi": "zone industrielle",
}
STATES = {"US": US_STATES, "India": IN_STATES}
STREETS = {"US": US_STREET, "India": IN_STREET, "France": FR_STREET}
TLDS = ["www", "com", "net", "org", "in", "co", "fr", "us", "info", "biz", "io"]
INITIAL_STOPS = ["and", "the", "of", "a", "an", "de", "la", "le", "et", "des", "du"]
PLACEHOLDERS = ["null", "nan", "na", "n/a", "none", "nil", "-", "--", "unknown", "not available"]
DOMAIN = r"(?i)(www\.)|(\.(com|net|org|in|co|fr|us|info|biz|io)\b)"
ALIAS = r"(?is)\b(?:d\.?\s?b\.?\s?a\.?|a\.?\s?k\.?\s?a\.?|t/a|trading as|doing business as)(?=\s|$)"
UNIT = r"(?i)(?:#\s*|\b(?:unit|apt|apartment|suite|ste|flat|shop|office|room|rm|plot|block)\b\.?\s*(?:no\.?\s*)?[:#-]?\s*)([a-z0-9][a-z0-9/-]*)"
POSTAL = {"US": r"(?U)\b(\d{5})(?:-\d{4})?\b", "India": r"(?U)\b(\d{3}\s?\d{3})\b", "France": r"(?U)\b(\d{5})\b"}
UNIT_SKIP = ["France"]
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
MOJIBAKE = "Ã.|Â.|â€|à¤|à¥"

"""Fixed values of the normalisers. They must equal the reference's for equal results; none is logic."""

# Legal forms and their canonical spelling.
LEGAL = {
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc",
    "pllc": "pllc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "cie": "co",
    "opc": "opc", "pc": "pc", "pa": "pa", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "sa": "sa", "eurl": "eurl", "sci": "sci",
    "snc": "snc", "scop": "scop", "sca": "sca", "selarl": "selarl", "gmbh": "gmbh", "ag": "ag", "bv": "bv", "nv": "nv", "srl": "srl", "spa": "spa",
}
# Long legal words whose typing errors are repaired, in order of trial.
LEGAL_LONG = [("private", "pvt"), ("limited", "ltd"), ("corporation", "corp"), ("incorporated", "inc"), ("company", "co")]
# Spelt-out legal forms, in order of trial.
LEGAL_SPELT = ["l l c", "l l p", "s a s", "s a r l", "s a", "p l c"]
# Words of no weight in names, and honorifics.
STOP = ["and", "the", "of", "a", "an", "s", "et", "de", "du", "des", "la", "le", "les", "l", "d", "en"]
HONORIFIC = ["mr", "mrs", "ms", "dr", "messrs", "mme", "mlle", "m"]
# Marks of a second name, the longer before the shorter.
ALT_MARKS = ["doing business as", "formerly known as", "trading as", "formerly", "dba", "d b a", "fka", "f k a", "aka", "a k a", "t a"]
# Ends of web addresses.
DOMAIN_ENDS = ["com", "net", "org", "biz", "info", r"co\.in", "in", "fr", "us", "io", "co"]
# Digits typed for letters.
LEET = ("013456789", "oleasgtbg")
# Canonical address tokens.
ADDRESS = {
    "street": "st", "st": "st", "str": "st", "saint": "st", "avenue": "ave", "ave": "ave", "av": "ave", "road": "rd", "rd": "rd", "drive": "dr",
    "dr": "dr", "court": "ct", "ct": "ct", "circle": "cir", "cir": "cir", "boulevard": "blvd", "blvd": "blvd", "bd": "blvd", "bld": "blvd",
    "lane": "ln", "ln": "ln", "place": "pl", "pl": "pl", "highway": "hwy", "hwy": "hwy", "parkway": "pkwy", "pkwy": "pkwy", "terrace": "ter",
    "ter": "ter", "trail": "trl", "trl": "trl", "square": "sq", "sq": "sq", "north": "n", "south": "s", "east": "e", "west": "w", "n": "n",
    "s": "s", "e": "e", "w": "w", "northeast": "ne", "northwest": "nw", "southeast": "se", "southwest": "sw", "apartment": "apt", "apt": "apt",
    "suite": "ste", "ste": "ste", "floor": "fl", "flr": "fl", "fl": "fl", "building": "bldg", "bldg": "bldg", "nagar": "nagar", "marg": "marg",
    "sector": "sec", "sec": "sec", "mount": "mt", "mt": "mt", "fort": "ft", "ft": "ft", "point": "pt", "pt": "pt", "township": "twp",
    "twp": "twp", "crossing": "xing", "cross": "cross", "main": "main", "opposite": "opp", "opp": "opp", "rue": "rue", "r": "rue",
    "allee": "allee", "all": "allee", "impasse": "imp", "imp": "imp", "chemin": "ch", "ch": "ch", "route": "rte", "rte": "rte", "quai": "quai",
    "cite": "cite", "residence": "res", "res": "res", "faubourg": "fbg", "fbg": "fbg", "sainte": "ste",
}
# Address tokens that are dropped.
ADDRESS_DROP = [
    "no", "number", "num", "h", "hno", "house", "door", "unit", "near", "nr", "behind", "c", "o", "null", "none", "na", "the", "of", "and", "de",
    "du", "des", "la", "le", "les", "d", "l", "bis", "ter", "po", "box", "city",
]
# Units and mailboxes, before their value.
UNITS = ["pmb", "p\\s*o\\s*box", "po\\s*box", "box", "unit", "ste", "suite", "apt", "apartment", "desk", "fl", "floor", "room", "rm"]
# States and their codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks",
    "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
    "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
    "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
IN_STATES = {
    "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg", "goa": "ga",
    "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "keralam": "kl",
    "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od",
    "orissa": "od", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn", "telangana": "ts", "tripura": "tr",
    "uttar pradesh": "up", "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "delhi": "dl", "new delhi": "dl", "nct of delhi": "dl",
    "jammu and kashmir": "jk", "jammu kashmir": "jk", "ladakh": "la", "puducherry": "py", "pondicherry": "py", "chandigarh": "ch",
    "dadra and nagar haveli": "dn", "daman and diu": "dd", "lakshadweep": "ld", "andaman and nicobar islands": "an", "telengana": "ts",
}
STATES = {"US": US_STATES, "India": IN_STATES}

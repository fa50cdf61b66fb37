"""Fixed values of the normalisers and key builders."""

# Abbreviations of business names, both generations.
NAME_WORDS = {
    "corp": "corporation", "pvt": "private", "ltd": "limited", "inc": "incorporated", "co": "company", "assoc": "associates",
    "intl": "international", "mgmt": "management", "mgr": "manager", "dept": "department", "svcs": "services", "svc": "service",
    "grp": "group", "natl": "national",
}
# The shorter list of the column-wise first generation.
NAME_WORDS_SHORT = {
    "corp": "corporation", "pvt": "private", "ltd": "limited", "inc": "incorporated", "co": "company", "assoc": "associates", "intl": "international",
    "mgmt": "management", "svcs": "services", "svc": "service", "grp": "group", "natl": "national",
}

# Abbreviations of addresses, row-wise first generation.
ADDRESS_WORDS_FIRST = {
    "rd": "road", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "sq": "square", "pkwy": "parkway", "hwy": "highway", "apt": "apartment", "ste": "suite", "flr": "floor", "bldg": "building", "opp": "opposite",
    "r": "rue", "all": "allee", "imp": "impasse", "st": "street",
}
# The shorter list of the column-wise first generation.
ADDRESS_WORDS_SHORT = {
    "rd": "road", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "pkwy": "parkway", "hwy": "highway", "apt": "apartment", "ste": "suite", "flr": "floor", "bldg": "building", "opp": "opposite", "st": "street",
}
# Second generation; `st` depends on the country.
ADDRESS_WORDS_SECOND = {
    "rd": "road", "str": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court", "pl": "place",
    "sq": "square", "pkwy": "parkway", "hwy": "highway", "apt": "apartment", "ste": "suite", "flr": "floor", "bldg": "building", "opp": "opposite",
    "r": "rue", "all": "allee", "imp": "impasse", "bd": "boulevard",
}

# Legal forms; tested on raw names.
LEGAL_FORMS = (
    "corporation", "corp", "incorporated", "inc", "limited", "ltd", "llc", "llp", "pvt", "private", "company", "co", "associates", "assoc",
    "partnership", "sarl", "sas", "sasu", "sa", "eurl", "sci", "sei", "pty", "plc", "gmbh", "bv", "nv", "ag", "ab", "oy", "as", "kk", "ou",
)
# Fixed value: the Polish form, with or without points; not in the column-wise first generation.
LEGAL_FORM_DOTTED = r"sp\.?z\.?o\.?o"

# Address words that make no key.
GENERIC_ADDRESS = (
    "road", "street", "avenue", "drive", "lane", "court", "place", "square", "parkway", "highway", "apartment", "suite", "floor", "building",
    "near", "behind", "opp", "opposite", "house", "nagar", "colony", "city", "town", "dist", "state", "block", "sector", "rue", "allee",
    "impasse", "boulevard", "saint", "north", "south", "east", "west", "rd", "st", "ave", "blvd", "dr",
)

# Words that give no letter to an acronym.
ACRONYM_STOPS = ("and", "of", "the", "for", "at", "by", "in", "llc", "inc", "ltd")

# Top-level domains that are cut from names.
DOMAINS = ("com", "org", "net", "co", "in", "fr", "biz", "info", "io", "us", "uk")

# Devanagari letters in Latin; other Brahmic blocks map to them by their offset of 0x80 a block.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh",
    "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l",
    "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ळ": "l", "ऩ": "n", "ऱ": "r", "ऴ": "l",
}
VOWEL_SIGNS = {
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॅ": "e", "ॉ": "o", "ॆ": "e", "ॊ": "o",
}
VOWELS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri", "ऎ": "e", "ऒ": "o", "ॲ": "a",
    "ऑ": "o",
}
OTHER_SIGNS = {"ं": "n", "ँ": "n", "ः": "h", "्": ""}
VIRAMA = "्"
BRAHMIC_BLOCKS = (0x0980, 0x0A00, 0x0A80, 0x0B00, 0x0B80, 0x0C00, 0x0C80, 0x0D00)

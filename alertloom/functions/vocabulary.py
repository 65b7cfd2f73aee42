"""Patterns, names and numbers that results depend on. Data only."""

# The abbreviations of the months, in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Categories of failure reasons, in the order in which they are reported, with the pattern of each over lower-case text.
FAILURE_CATEGORIES = {
    "dissolution": r"\bdissolutio?n\b|\bdissolutin\b|\bdissoluti\s+on\b",
    "disintegration": r"\bdisintegrat",
    "sterility": r"\bsterilit|\bsterillit|\bsterile\b|\bnon-?sterile\b",
    "microbial_contamination": r"\bmicrobial\b|\bmicrobiolog|total aerobic|\byeast|\bmould|\bmold\b|\be\.?\s?coli\b|staphylococ|pseudomonas|salmonella|\bfungal\b",
    "bacterial_endotoxins": r"\bendotoxin|\bbet\b|\bpyrogen",
    "particulate_matter": r"particulate",
    "related_substances": r"related\s+su\w*t\w*ces?|\bimpurit",
    "identification": r"\bidentification\b|\bidentity\b",
    "spurious": r"\bspurious\b|\bcounterfeit\b|\badulterat|17-?b",
    "description_labelling": r"\bdescriptions?\b|\bdescriptive\b|\bmisbrand|\bmisbrand[ae]d\b|\blabell?ing\b|the label is|\blabel claim is\b|not (?:mentioned|declared|printed|specified) on the label",
    "ph": r"\bph\b|\bp\.h\.?\b",
    "water_content": r"\bwater\b(?!\s*-?\s*soluble)(?!\s+per\s+ml)|\bmoisture\b",
    "loss_on_drying": r"loss\s+on\s+drying|\bl\.?o\.?d\.?\b(?=\s|$)",
    "uniformity_of_weight": r"uniformity of (?:filled\s+)?weight",
    "uniformity_of_dispersion": r"uniformity of dispersion",
    "density": r"specific\s+gravity|relative\s+density|weight\s+per\s+ml",
    "extractable_volume": r"extractable\s+volume|deliverable\s+volume|uniformity\s+of\s+volume",
    "clarity_of_solution": r"clarity\b|appearance\s+of\s+solution|colou?r\s+of\s+solution",
    "dimensions": r"\blength\b|\bdiameter\b",
    "assay": r"\bassay\b|(?<!water )(?<!moisture )\bcontent\b|labell?ed (?:amount|claim)|\bpotency\b|\bstrength\b",
}

# The states and territories looked for in addresses, with former spellings.
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Chattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala",
    "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Orissa", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana", "Tripura",
    "Uttar Pradesh", "Uttarakhand", "Uttaranchal", "West Bengal", "Andaman and Nicobar Islands", "Chandigarh", "Dadra and Nagar Haveli", "Daman and Diu", "Delhi",
    "Jammu and Kashmir", "Ladakh", "Lakshadweep", "Puducherry", "Pondicherry",
]
# Former names of states.
STATE_ALIASES = {"chattisgarh": "Chhattisgarh", "orissa": "Odisha", "uttaranchal": "Uttarakhand", "pondicherry": "Puducherry"}
# Abbreviations with one meaning only.
STATE_ABBREVIATIONS = {
    "Uttar Pradesh": r"\(?\bU\.\s?P\.",
    "Himachal Pradesh": r"\(?\bH\.\s?P\.",
    "Madhya Pradesh": r"\(?\bM\.\s?P\.",
    "Tamil Nadu": r"\(?\bT\.\s?N\.",
    "West Bengal": r"\(?\bW\.\s?B\.",
    "Jammu and Kashmir": r"\bJ\s?&\s?K\b",
    "Delhi": r"\bNCT of Delhi\b|\bNew Delhi\b",
}
# A manufacturer that isn't named, for the state and the flags.
UNKNOWN_MAKER = r"(?i)^\s*(under investigation|not known|unknown|n\.?a\.?)\s*$"
# The same for resolving companies, where more counts.
NO_COMPANY = r"(?i)^\s*(?:under\s+investigation|not\s+known|unknown|n\.?\s*a\.?|n\.?\s*m\.?|not\s+mentioned|not\s+applicable|not\s+available|spurious|nil[\s,.]*(?:nil[\s,.]*)*|-+|\.+)\s*$"
# Wording by which a firm or the regulator disputes that a batch is the firm's.
DISPUTE = r"(?i)has not been manufactured by them|not manufactured by (?:them|us)|denied|denies|is a spurious drug|purported to be (?:spurious|manufactured)|actual manufacturer"
# Reasons that name no test.
NO_TEST = r"(?i)^\s*(?:not applicable|nsq|not of standard quality|does not conform to i\.?p\.?\.?|n\.?a\.?|-+)\s*$"

# Two-digit beginnings of PIN codes that lie in one state.
PIN2 = {
    "11": "Delhi", "12": "Haryana", "13": "Haryana", "15": "Punjab", "17": "Himachal Pradesh", "18": "Jammu and Kashmir", "19": "Jammu and Kashmir", "20": "Uttar Pradesh",
    "21": "Uttar Pradesh", "22": "Uttar Pradesh", "23": "Uttar Pradesh", "25": "Uttar Pradesh", "27": "Uttar Pradesh", "28": "Uttar Pradesh", "30": "Rajasthan", "31": "Rajasthan",
    "32": "Rajasthan", "33": "Rajasthan", "34": "Rajasthan", "37": "Gujarat", "38": "Gujarat", "41": "Maharashtra", "42": "Maharashtra", "43": "Maharashtra", "44": "Maharashtra",
    "45": "Madhya Pradesh", "46": "Madhya Pradesh", "47": "Madhya Pradesh", "48": "Madhya Pradesh", "49": "Chhattisgarh", "51": "Andhra Pradesh", "52": "Andhra Pradesh",
    "56": "Karnataka", "57": "Karnataka", "58": "Karnataka", "59": "Karnataka", "61": "Tamil Nadu", "62": "Tamil Nadu", "63": "Tamil Nadu", "64": "Tamil Nadu", "69": "Kerala",
    "70": "West Bengal", "71": "West Bengal", "72": "West Bengal", "75": "Odisha", "76": "Odisha", "77": "Odisha", "80": "Bihar", "83": "Jharkhand", "84": "Bihar", "85": "Bihar",
}
# Three-digit ones, where two digits lie in several states.
PIN3 = {
    "141": "Punjab", "142": "Punjab", "143": "Punjab", "144": "Punjab", "145": "Punjab", "146": "Punjab", "147": "Punjab", "148": "Punjab", "241": "Uttar Pradesh",
    "242": "Uttar Pradesh", "243": "Uttar Pradesh", "245": "Uttar Pradesh", "248": "Uttarakhand", "249": "Uttarakhand", "261": "Uttar Pradesh", "263": "Uttarakhand",
    "360": "Gujarat", "361": "Gujarat", "363": "Gujarat", "364": "Gujarat", "365": "Gujarat", "390": "Gujarat", "391": "Gujarat", "392": "Gujarat", "393": "Gujarat",
    "394": "Gujarat", "395": "Gujarat", "400": "Maharashtra", "401": "Maharashtra", "402": "Maharashtra", "403": "Goa", "500": "Telangana", "501": "Telangana", "502": "Telangana",
    "503": "Telangana", "504": "Telangana", "505": "Telangana", "506": "Telangana", "508": "Telangana", "509": "Telangana", "530": "Andhra Pradesh", "531": "Andhra Pradesh",
    "532": "Andhra Pradesh", "534": "Andhra Pradesh", "535": "Andhra Pradesh", "600": "Tamil Nadu", "601": "Tamil Nadu", "602": "Tamil Nadu", "603": "Tamil Nadu",
    "604": "Tamil Nadu", "606": "Tamil Nadu", "608": "Tamil Nadu", "670": "Kerala", "671": "Kerala", "676": "Kerala", "678": "Kerala", "679": "Kerala", "680": "Kerala",
    "683": "Kerala", "685": "Kerala", "686": "Kerala", "688": "Kerala", "689": "Kerala", "731": "West Bengal", "732": "West Bengal", "733": "West Bengal", "734": "West Bengal",
    "735": "West Bengal", "736": "West Bengal", "737": "Sikkim", "741": "West Bengal", "742": "West Bengal", "743": "West Bengal", "744": "Andaman and Nicobar Islands",
    "781": "Assam", "782": "Assam", "784": "Assam", "785": "Assam", "786": "Assam", "787": "Assam", "788": "Assam", "790": "Arunachal Pradesh", "791": "Arunachal Pradesh",
    "792": "Arunachal Pradesh", "793": "Meghalaya", "794": "Meghalaya", "795": "Manipur", "796": "Mizoram", "797": "Nagaland", "798": "Nagaland", "799": "Tripura", "811": "Bihar",
    "812": "Bihar", "815": "Jharkhand", "816": "Jharkhand", "821": "Bihar", "822": "Jharkhand", "823": "Bihar", "824": "Bihar", "825": "Jharkhand", "826": "Jharkhand",
    "827": "Jharkhand", "828": "Jharkhand", "829": "Jharkhand",
}
# A beginning whose state has changed since the directory was made, and the range of PIN codes.
PIN_STALE = ["194"]
PIN_RANGE = (110001, 855126)

# Laboratories by the kind and town in their names; state-run ones come before central ones of the same kind.
CDL = r"(?:\bCDL\b|\bCDTL\b|\bCENTRAL\s+DRUGS?\s+(?:TESTING\s+)?LABORATORY\b)"
RDTL = r"(?:\bRDTL\b|\bREGIONAL\s+DRUGS?\s+TESTING\s+LABORATORY\b)"
STATE_RUN_LABS = [
    ("Regional Drugs Testing Laboratory, Bellary (Karnataka)", RDTL, "BELLARY", "karnataka_rdtl"),
    ("Regional Drugs Testing Laboratory, Hubli (Karnataka)", RDTL, "HUBLI", "karnataka_rdtl"),
    ("Regional Drugs Testing Laboratory, Ernakulam (Kerala)", RDTL, "ERNAKULAM", "karnataka_rdtl"),
]
CENTRAL_LABS = [
    ("Central Drugs Laboratory, Kolkata", CDL, "KOLKATA", "cdsco_seven"),
    ("Central Drugs Laboratory, Kasauli", CDL, "KASAULI", "cdsco_seven"),
    ("Central Drugs Testing Laboratory, Mumbai", CDL, "MUMBAI", "cdsco_seven"),
    ("Central Drugs Testing Laboratory, Chennai", CDL, "CHENNAI", "cdsco_seven"),
    ("Central Drugs Testing Laboratory, Hyderabad", CDL, "HYDERABAD", "cdsco_seven"),
    ("Regional Drugs Testing Laboratory, Guwahati", RDTL, "GUWAHATI", "cdsco_seven"),
    ("Regional Drugs Testing Laboratory, Chandigarh", RDTL, "CHANDIGARH", "cdsco_seven"),
    ("Central Drugs Testing Laboratory, Indore", CDL, "INDORE", "cdtl_indore"),
]
LAB_OFFICE = (r"\bCDSCO\b", "CDSCO office (not a laboratory)")
STATE_LAB_MARKERS = (
    r"(\bDTL\w*|\b(?:SDTL|SDT&RL|SDFTL|SFTRL|FDTL|MDTL|DCL|FDL|FDAL|FDA|BDCL|CFDL|GDTL|DCA|STATE|GOVERNMENT|GOVT|DIRECTORATE|MUNICIPAL|KING\s+INSTITUTE|MEDICAL\s+COLLEGE"
    r"|DRUGS?\s+(?:TESTING\s+)?LABORATORY|DRUGS?\s+CONTROL|DRUGS?\s+INSPECTOR|DRUGS?\s+CONTROLLER|FOOD\s*(?:&|AND)?\s*DRUGS?|COMBINED\s+FOOD)\b)"
)
NOT_A_LAB = r"(?i)^\s*(?:not\s+applicable|not\s+available|n\.?\s*a\.?|nil|-+|\.+)\s*$"

# Stems of substance names, the class each marks, its usual spelling.
STEMS = [
    (r"\b\w*cillin\b", "antibacterial", "-cillin"),
    (r"\bcef\w+\b", "antibacterial", "cef-"),
    (r"\b\w*oxacin\b", "antibacterial", "-oxacin"),
    (r"\b\w*cycline\b", "antibacterial", "-cycline"),
    (r"\b\w*mycin\b", "antibacterial", "-mycin"),
    (r"\b\w*micin\b", "antibacterial", "-micin"),
    (r"\b\w*kacin\b", "antibacterial", "-kacin"),
    (r"\b\w*penem\b", "antibacterial", "-penem"),
    (r"\b\w*bactam\b", "antibacterial", "-bactam"),
    (r"\b\w*oxazolid\w*\b|\blinezolid\b", "antibacterial", "-(z)olid"),
    (r"\bsul[fp]h?amethoxazole\b|\b\w*trimoxazole\b|\btrimethoprim\b", "antibacterial", "sulfa-"),
    (r"\bnitrofuran\w*\b|\bnitrofurantoin\b", "antibacterial", "nitrofur-"),
    (r"\brifampicin\b|\brifampin\b|\b\w*rifa\w*mycin\b", "antibacterial", "rifa-"),
    (r"\bisoniazid\b|\bethambutol\b|\bpyrazinamide\b", "antibacterial", "(anti-TB)"),
    (r"\bchloramphenicol\b", "antibacterial", "-phenicol"),
    (r"\b\w*conazole\b", "antifungal", "-conazole"),
    (r"\b\w*fungin\b|\bgriseofulvin\b|\bnystatin\b|\bterbinafine\b", "antifungal", "-fungin"),
    (r"\b\w*idazole\b", "antiprotozoal", "-idazole"),
    (r"\b\w*bendazole\b|\b\w*ectin\b|\bpraziquantel\b|\bniclosamide\b", "anthelmintic", "-bendazole/-ectin"),
    (r"\b\w*[ci]clovir\b|\b\w*navir\b|\b\w*vudine\b|\b\w*tegravir\b|\boseltamivir\b", "antiviral", "-vir"),
]
STEM_CLASSES = ["antibacterial", "antifungal", "antiprotozoal", "anthelmintic", "antiviral"]
# Words whose stem misleads, with their classes.
STEM_EXCEPTIONS = {"dactinomycin": [], "natamycin": ["antifungal"]}

# What a flag of each kind takes off a record's confidence; other kinds take the default.
DEDUCTIONS = {
    "missing_required": 0.15, "date_unparsed": 0.10, "expiry_before_mfg": 0.20, "date_implausible": 0.15, "failure_category_unmapped": 0.10, "failure_reason_empty": 0.20,
    "alert_section_unrecognised": 0.10, "alert_section_missing": 0.10, "alert_month_unparsed": 0.20, "id_collision_disambiguated": 0.10, "batch_number_implausible": 0.05,
    "dispute_status_unknown": 0.05, "date_two_digit_year_assumed_20xx": 0.05, "state_not_derived": 0.0, "state_ambiguous": 0.0, "duplicate_source_rows_collapsed": 0.0,
    "alert_section_disputed": 0.0, "lab_type_underived": 0.0, "state_derived_from_pin": 0.0, "state_ambiguous_pin": 0.0,
}
DEFAULT_DEDUCTION, LEAST_CONFIDENCE = 0.05, 0.3
REQUIRED_FIELDS = ["drug_name_raw", "batch_number", "manufacturer_raw", "failure_reason_raw", "alert_month", "source_url"]
YEARS = (1990, 2100)
LONGEST_BATCH = 40

# Parts of a company's cell that aren't its name, and words that begin an address.
CERTIFICATE = r"(?i)\((?:[^()]*?(?:gmp|iso|who|certif|unit\s+of|approved|accredit)[^()]*?)\)|\b(?:an?\s+)?(?:who[\s-]*)?gmp\s+certified\s+(?:company|unit|firm)\b|\bwho[\s-]*gmp\s+certified\b"
MESSRS = r"(?i)^\s*(?:m\s*/\s*s\.?|m/s|ms\.)\s*[.,]?\s*"
ADDRESS_WORDS = (
    "plot survey khasra khewat khata mouza village vill gat gut shed sector phase street road marg lane nagar industrial industial indl estate gidc midc sidcul siidcul epip iie near opp opposite behind post "
    "dist distt district taluka tal teh tehsil via nh km floor building bldg complex premises door no s\\.?no h\\.?no sy\\.?no at unit area block"
).split()
# Words of the trade folded into one spelling, in this order.
NAME_FOLDS = [
    (r"\blife\s*sciences?\b|\blifesciences?\b", "lifescience"),
    (r"\bpharmaceutical(?:s|es)?\b|\bpharmaceutics\b|\bpharmacia\b|\bpharmacy\b|\bpharma\b", "pharma"),
    (r"\blaborator(?:ies|y)\b|\blabs?\b", "lab"),
    (r"\bindustr(?:ies|y|ial)\b|\binds\b", "industries"),
    (r"\bhealth\s*care\b|\bhealthcare\b", "healthcare"),
    (r"\bbio\s*tech(?:nolog(?:y|ies))?\b|\bbiotech\b", "biotech"),
    (r"\bformulations?\b", "formulation"),
    (r"\bremed(?:ies|y)\b", "remedies"),
    (r"\bdrugs?\b", "drugs"),
    (r"\bproducts?\b", "products"),
    (r"\bchemicals?\b", "chemicals"),
    (r"\bsciences?\b", "science"),
]
LEGAL_WORDS = "pvt private ltd limited llp inc corp corporation co company plc gmbh the and p".split()
GENERIC_WORDS = "pharma lab industries healthcare biotech formulation remedies drugs products chemicals science lifescience".split()
# Score of a pair of companies, and the tiers.
STATE_PENALTY, PIN_PENALTY, ADDRESS_PENALTY, PIN_BONUS, UNLIKE_ADDRESS = 0.09, 0.05, 0.04, 0.03, 0.40
SCORE_FLOOR, REVIEW_FROM, AUTO_ABOVE = 0.70, 0.75, 0.92
LARGEST_BLOCK = 400

# The text shown for a kind of flag; other kinds aren't shown.
FLAG_TEXTS = {
    "state_not_derived": "No state could be read from the published address.",
    "state_ambiguous": "The published address names more than one state; none is shown.",
    "state_ambiguous_pin": "The published address names no state, and its PIN code lies in more than one; none is shown.",
    "manufacturer_unknown_placeholder": "No manufacturer was published for this batch.",
    "failure_category_unmapped": "The published reason names no known test; its wording is shown.",
    "expiry_before_mfg": "The published expiry date is before the date of manufacture.",
    "date_unparsed": "A published date could not be read as a date.",
    "duplicate_source_rows_collapsed": "The same row was published more than once; it is shown once.",
    "id_collision_disambiguated": "Rows that agree in their key fields differ in others; all are kept.",
    "missing_required": "A usual field was not published for this record.",
    "alert_section_unrecognised": "The reporting source was not published in a known form.",
    "alert_section_missing": "The reporting source was not published in a known form.",
    "batch_number_implausible": "The published batch number has an unusual form.",
    "dispute_status_unknown": "No answer of the firm was published for this record.",
}

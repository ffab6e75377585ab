"""Word lists, patterns and lookup tables that decide results.

Everything here is data.  Operators take these as default arguments, so a caller can pass other lists.
"""

# --- fixed values: suggestion sources (id, label, ticked by default) -------------------------------------------------
SOURCES = (
    ("google", "Google", True),
    ("bing", "Bing", True),
    ("youtube", "YouTube", True),
    ("duckduckgo", "DuckDuckGo", True),
    ("yahoo", "Yahoo", False),
    ("ebay", "eBay (shopping)", False),
    ("amazon", "Amazon US (shopping)", False),
)

# --- fixed values: query templates of the first expansion level -----------------------------------------------------
LETTERS = tuple("abcdefghijklmnopqrstuvwxyz")
DIGITS = tuple("0123456789")
SUFFIXES = (
    "near me", "for kids", "for adults", "for beginners", "online", "app", "free", "price", "fees", "class", "classes",
    "course", "training", "teacher", "certificate", "franchise", "worksheet", "pdf", "best", "vs", "how to", "what is",
    "why", "where", "can", "is", "in", "with", "and", "tutorial", "video", "books", "competition", "exam", "jobs",
    "business", "software", "game", "apk", "download", "review", "institute", "centre", "center", "academy", "coaching",
    "tuition", "at home", "timing", "contact", "address", "login", "syllabus", "level", "age", "benefits", "tips",
    "tricks", "practice", "test", "for school", "in tamil", "in hindi", "in english", "buy", "cheap", "for men",
    "for women", "brands", "reviews", "alternatives", "under", "kit", "set", "near", "cost",
)
PREFIXES = ("best", "how to", "what is", "why", "free", "online", "top", "learn", "buy", "cheap", "near")
# (format, weight); {s} is the seed and {c} the city
CITY_TEMPLATES = (("{s} {c}", 1.0), ("{s} in {c}", 1.0), ("{s} classes in {c}", 1.0), ("{s} near {c}", 0.9))
# depth -> (digits and leading letters?, phrases taken to level 2, level-2 sources)
DEPTHS = {
    "quick": (False, 0, ()),
    "deep": (True, 20, ("google",)),
    "max": (True, 60, ("google", "bing")),
}

# --- fixed values: intent rules, first match wins; (name, ASCII-word-bounded alternation) ----------------------------
INTENT_RULES = (
    ("jobs", r"jobs?|vacanc\w*|hiring|salary|careers?|work from home|recruitment"),
    ("business", r"franchis\w*|distributor|dealership|licen[cs]e|business|investment|become a|start(ing)? (a|an|your)\b"),
    ("training", r"teacher training|train\w*|certification|course|courses|diploma|instructor|workshop"),
    ("price", r"fees?|price|prices|cost|charges?|rates?|how much|cheap|affordable|discount|offers?"),
    ("product", r"buy|purchase|order|kits?|boards?|beads?|frame|slate|toys?|shop|store|amazon|flipkart|set"),
    ("app", r"apps?|apk|download|software|website|games?|simulator|tools?|ai|calculator|play store|ios|android"),
    ("compare", r"best|top|vs|versus|reviews?|alternatives?|compare|comparison|better"),
    (
        "resource",
        r"worksheets?|pdf|printable|exercises?|questions?|books?|syllabus|charts?|formulas?|tricks?|tips|sheets?|practice|"
        r"videos?|youtube|tutorials?",
    ),
    ("exam", r"competitions?|olympiad|exams?|contests?|tests?|results?|levels?|certificate"),
    (
        "local",
        r"near me|nearby|near|classes|class|centres?|centers?|institutes?|academy|coaching|tuition|school|address|contact|"
        r"timings?|admissions?|batch(es)?",
    ),
    ("language", r"tamil|hindi|telugu|kannada|malayalam|marathi|bengali|gujarati|urdu|punjabi|kya hai|kaise|seekhe|sikhe"),
    (
        "audience",
        r"kids?|children|child|adults?|beginners?|preschool|toddlers?|year old|years old|grade \d|std \d|age",
    ),
    (
        "learn",
        r"how|what|why|when|where|who|meaning|definition|learn|history|parts|steps|benefits|uses?|works?|examples?|types",
    ),
)
# intent -> facet label
INTENT_LABELS = {
    "local": "Find a provider",
    "app": "App / tool",
    "training": "Training / teachers",
    "business": "Franchise / business",
    "resource": "Free resources",
    "price": "Fees / price",
    "compare": "Compare / best",
    "exam": "Exams / competitions",
    "product": "Physical product",
    "language": "Language",
    "audience": "By audience / age",
    "learn": "Learn / how-to",
    "jobs": "Jobs",
    "other": "Other",
}

# --- fixed values: stop words of the topic terms --------------------------------------------------------------------
STOP_WORDS = (
    "a", "an", "the", "of", "in", "for", "to", "and", "or", "is", "are", "was", "be", "my", "me", "i", "you", "your",
    "with", "on", "at", "by", "from", "as", "it", "this", "that", "these", "those", "can", "do", "does", "did", "how",
    "what", "why", "when", "where", "who", "which", "get", "make", "use", "using", "vs", "versus", "into", "about",
    "than", "then", "there", "their", "so", "if", "not", "no", "yes", "am", "we", "our", "us", "up", "out", "over",
    "under", "best", "top", "near", "nearby", "classes", "class", "online", "free",
)

# --- fixed values: words that follow "in", "near" or a provider word without being a place ---------------------------
NOT_PLACE_WORDS = (
    "me", "my", "you", "your", "us", "home", "school", "schools", "india", "indian", "tamil", "hindi", "english",
    "telugu", "kannada", "malayalam", "marathi", "bengali", "gujarati", "urdu", "punjabi", "online", "offline", "free",
    "fees", "fee", "price", "cost", "kids", "kid", "children", "child", "adults", "adult", "beginners", "beginner",
    "students", "student", "parents", "parent", "teacher", "teachers", "training", "course", "courses", "class",
    "classes", "center", "centre", "centers", "centres", "institute", "academy", "app", "apps", "pdf", "video", "videos",
    "near", "nearby", "for", "with", "and", "the", "a", "an", "of", "to", "is", "at", "by", "from", "this", "that",
    "these", "those", "what", "how", "why", "when", "where", "which", "who", "level", "levels", "exam", "exams",
    "competition", "competitions", "certificate", "certification", "syllabus", "worksheet", "worksheets", "book", "books",
    "timing", "timings", "address", "contact", "number", "phone", "review", "reviews", "admission", "admissions",
    "franchise", "franchisee", "jobs", "job", "small", "big", "new", "old", "good", "best", "top", "cheap", "low", "high",
    "per", "month", "year", "day", "week", "hour", "hours", "minute", "minutes", "maths", "math", "mathematics", "vedic",
    "brain", "mental", "arithmetic", "learning", "learn", "tuition", "coaching", "batch", "batches", "india's",
)
# words before a trailing place: group 1 after a preposition, group 2 after a provider noun
PLACE_AFTER_PREPOSITION = r"(?:in|near|at|around)\s+([a-z][a-z .'-]{2,28})"
PLACE_AFTER_PROVIDER = (
    r"(?:classes|class|centre|centres|center|centers|institute|academy|coaching|tuition|training|teacher|courses?)\s+"
    r"([a-z][a-z.'-]{2,20}(?: [a-z][a-z.'-]{2,14})?)"
)

# --- fixed values: gazetteer types that count as a place --------------------------------------------------------------
PLACE_CATEGORIES = ("boundary", "place")
PLACE_TYPES = (
    "city", "town", "village", "suburb", "neighbourhood", "hamlet", "state", "county", "district", "quarter",
    "city_district", "locality", "borough", "municipality", "administrative", "region", "country", "province",
    "state_district", "residential",
)

# --- fixed values: lead CSV header aliases, in order of preference ----------------------------------------------------
CSV_ALIASES = {
    "name": ("name", "title", "business name", "business", "company", "place name", "centre", "center", "organization"),
    "phone": (
        "phone", "phone number", "phonenumber", "mobile", "mobile number", "contact number", "telephone", "phone_number",
        "phone unformatted", "phoneunformatted", "whatsapp",
    ),
    "website": ("website", "site", "web", "homepage"),
    "url": (
        "url", "link", "google maps url", "maps url", "maps link", "google_maps_url", "googlemapsurl", "google maps link",
    ),
    "address": ("address", "full address", "street", "location"),
    "city": ("city",),
    "area": ("area", "locality", "neighborhood", "neighbourhood"),
    "rating": ("rating", "totalscore", "stars", "review rating"),
    "reviews": (
        "reviews", "reviewscount", "reviews_count", "user_ratings_total", "review count", "reviews count",
        "number of reviews",
    ),
    "email": ("email", "emails", "email address"),
    "place_id": ("place_id", "placeid", "place id"),
    "notes": ("notes", "note"),
    "contact_name": ("contact name", "contact", "owner", "teacher"),
}
MAPS_URL = r"google\.[a-z.]+/maps|maps\.app\.goo\.gl|goo\.gl/maps"

# --- fixed values: lead enumerations ----------------------------------------------------------------------------------
STAGES = ("new", "contacted", "replied", "pilot", "won", "lost", "invalid")
CLOSED_STAGES = ("won", "lost", "invalid")
PATCHABLE = (
    "name", "address", "area", "city", "website", "email", "instagram", "facebook", "contact_name", "notes", "lang", "stage",
    "maps_url",
)
LANGUAGES = ("en", "ta")
STREET_WORDS = r"street|st\.?|road|rd\.?|nagar main|floor|flat|no\.?|plot|door|opp|near|behind"

# --- fixed values: website extraction patterns ------------------------------------------------------------------------
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
JUNK_EMAIL = r"(example|sentry|wixpress|domain|email)\.|\.(png|jpe?g|gif|webp|svg|css|js)$|^(you|your|name|user)@"
MOBILE = (
    r"(?<![0-9])(?:\+?91[\s\x0B\p{Z}\uFEFF-]*)?0?([6-9][0-9]{4})[\s\x0B\p{Z}\uFEFF-]?([0-9]{5})(?![0-9])"
)
TEL_HREF = "href=[\"']tel:([^\"']+)[\"']"
WHATSAPP = r"(?:wa\.me/|api\.whatsapp\.com/send\?phone=|whatsapp\.com/send\?phone=)\+?([0-9]{10,15})"
INSTAGRAM = r"https?://(?:www\.)?instagram\.com/[a-z0-9_.]+"
FACEBOOK = r"https?://(?:www\.)?facebook\.com/[a-z0-9_./-]+"
STORES = ((r"play\.google\.com/store/apps", "Google Play link"), (r"apps\.apple\.com", "App Store link"))
PORTAL_WORDS = (
    r"student (?:portal|login|app)",
    r"parent (?:portal|login|app)",
    r"download (?:our|the) app",
    r"mobile app",
    r"android app",
    r"online (?:portal|practice|test)s?",
    r"lms",
)
CONTACT_HREF = "href=[\"']([^\"']*contact[^\"']*)[\"']"

# --- fixed values: follow-up steps (step, label, channel, template) ---------------------------------------------------
STEPS = (
    ("first", "First message", "whatsapp", "first"),
    ("followup1", "Follow-up", "whatsapp", "followup1"),
    ("call", "Call", "call", "call"),
    ("send_details", "Send details", "whatsapp", "details"),
    ("nudge_details", "Nudge", "whatsapp", "nudge"),
    ("checkin3", "Pilot check-in (day 3)", "whatsapp", "checkin3"),
    ("checkin7", "Pilot check-in (day 7)", "whatsapp", "checkin7"),
    ("review30", "Day-30 review", "whatsapp", "review30"),
)
FUNNEL_STAGES = ("Found", "Reachable (has phone)", "Contacted", "Replied", "Pilot started", "Won")

# --- fixed values: signals of a lead's score ({} is the rating or the number of reviews) ------------------------------
SIGNALS = {
    "high_rating": ("Rated {}", 15),
    "good_rating": ("Rated {}", 10),
    "low_rating": ("Low rating {}", -5),
    "active": ("{} reviews: active, likely independent", 15),
    "known": ("{} reviews", 8),
    "large": ("{} reviews: likely large", 0),
    "few": ("Very few reviews", 3),
    "mobile": ("Mobile number (WhatsApp likely)", 15),
    "landline": ("Landline only (call, no WhatsApp)", 5),
    "phone": ("Phone found", 8),
    "no_phone": ("No usable phone", -20),
    "own_app": ("Already has its own app", -25),
    "portal": ("Mentions a portal or app", -10),
    "no_app": ("No app found on website", 8),
    "website": ("Has a website (not checked yet)", 3),
    "chain": ("Looks like a franchise or chain: head office may decide", -20),
}
# --- fixed values: sentences about sources that were switched off ({} is the source) -----------------------------------
OFF_SENTENCES = {
    "rate": "{} asked us to slow down, so we stopped using it for this scan.",
    "err": "{} kept failing, so we stopped using it for this scan.",
}
# --- fixed values: how a message begins ({} is the contact's name) ------------------------------------------------------
GREETINGS = ("Hello {} 🙏", "Hello 🙏")

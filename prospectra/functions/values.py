"""Word lists, domains, weights and column orders that results depend on.

All lists here are fixed values in the order in which they are tried.
"""

# Categories that are not businesses.
NON_BUSINESS = (
    "park", "beach", "river", "mountain", "mountain_peak", "hiking_trail", "trail",
    "lake", "forest", "island", "dam", "waterfall", "canyon", "valley", "cliff",
    "plateau", "natural_feature", "structure_and_geography", "body_of_water",
    "landmark_and_historical_building", "monument", "bridge", "cemetery",
    "post_office", "fire_station", "police_department",
)
CHAIN_THRESHOLD = 5

# Substrings of a website that mean no owned site.
WEAK_SUBSTRINGS = (
    "facebook.com", "instagram.com", "yelp.com", "linktr.ee", "linktree.com",
    "yellowpages.com", "business.site", "wixsite.com", "tiktok.com",
    "linkedin.com", "twitter.com", "nextdoor.com", "google.com/maps",
)

# Domains that are not an owned site, by host.
WEAK_DOMAINS = (
    "yelp.com", "yelp.to", "facebook.com", "fb.com", "instagram.com",
    "yellowpages.com", "localsearch.com", "google.com", "youtube.com",
    "linkedin.com", "twitter.com", "x.com", "tiktok.com", "pinterest.com",
    "groupon.com", "nextdoor.com", "linktr.ee", "linktree.com",
    "business.site", "wixsite.com", "mapquest.com", "tripadvisor.com",
)

# Hosts that show up in search results but are nobody's own site.
DIRECTORY_DOMAINS = WEAK_DOMAINS + (
    "wikipedia.org", "bbb.org", "manta.com", "chamberofcommerce.com",
    "indeed.com", "glassdoor.com", "apple.com", "bing.com", "duckduckgo.com",
    "amazon.com", "doordash.com", "ubereats.com", "grubhub.com", "opentable.com",
    "zillow.com", "realtor.com", "redfin.com", "trulia.com", "homes.com",
)

# Social and listing domains of the second tier rule.
LISTING_DOMAINS = (
    "facebook.com", "instagram.com", "yelp.com", "linktr.ee", "linktree.com",
    "tiktok.com", "linkedin.com", "twitter.com", "x.com", "nextdoor.com",
    "yellowpages.com", "google.com", "g.page", "business.google.com",
)

# Do-it-yourself builders by domain.
BUILDER_DOMAINS = {
    "wixsite.com": "Wix", "wix.com": "Wix", "weebly.com": "Weebly",
    "godaddysites.com": "GoDaddy", "godaddy.com": "GoDaddy",
    "square.site": "Square", "squareup.com": "Square", "business.site": "Google Business",
    "wordpress.com": "WordPress.com", "blogspot.com": "Blogger",
    "myshopify.com": "Shopify", "bigcartel.com": "Big Cartel",
    "webflow.io": "Webflow", "netlify.app": "Netlify", "wordpress.org": "WordPress",
    "ecwid.com": "Ecwid", "square.online": "Square",
}

# Social platforms by domain.
SOCIAL_DOMAINS = {
    "facebook.com": "facebook", "instagram.com": "instagram", "tiktok.com": "tiktok",
    "linkedin.com": "linkedin", "twitter.com": "twitter", "x.com": "twitter",
    "youtube.com": "youtube", "yelp.com": "yelp", "nextdoor.com": "nextdoor",
    "pinterest.com": "pinterest",
}

# Category substrings of a high and of a low fit.
HIGH_FIT = (
    "restaurant", "cafe", "coffee", "bar", "pub", "brewery", "winery", "wine",
    "bakery", "food", "caterer", "catering", "pizz", "taqueria", "deli", "diner",
    "salon", "barber", "hair", "nail", "spa", "beauty", "massage", "skin_care",
    "tattoo", "esthetic", "lash", "wax", "tanning",
    "dentist", "dental", "chiropract", "optometr", "veterinar", "physical_therapy",
    "dermatolog", "acupunctur", "orthodont", "medical_spa", "cosmetic",
    "plumb", "electric", "hvac", "roofing", "contractor", "landscap", "construction",
    "remodel", "painter", "flooring", "fencing", "paving", "concrete", "handyman",
    "pest_control", "locksmith", "excavat", "well_drilling", "septic", "solar",
    "auto_repair", "automotive", "mechanic", "tire", "body_shop", "detailing",
    "real_estate_agent", "realtor", "mortgage", "insurance_agent",
    "photograph", "videograph", "florist", "flowers", "event", "wedding", "dj_",
    "gym", "fitness", "yoga", "pilates", "crossfit", "martial",
    "boutique", "clothing", "jewelry", "furniture", "gift", "antique",
    "hotel", "motel", "inn", "bed_and_breakfast", "lodging", "vacation_rental",
    "law", "lawyer", "attorney", "accountant", "accounting", "tax", "bookkeep",
    "cleaning", "home_cleaning", "interior_design", "architect", "moving",
    "daycare", "day_care", "preschool", "tutor", "driving_school", "pet_groom",
    "pet_", "kennel", "dog_", "brewpub", "distillery", "cidery", "smoothie", "juice",
)
LOW_FIT = (
    "church", "cathedral", "religi", "mosque", "temple", "synagog", "worship",
    "government", "public_and_government", "city_hall", "courthouse", "dmv",
    "post_office", "police", "fire_station", "library", "school_district",
    "non_profit", "nonprofit", "charity", "community_services", "association",
    "political", "union", "embassy", "military", "prison", "cemetery",
    "utility", "power_plant", "water_treatment", "landfill", "recycling_center",
    "university", "college", "high_school", "elementary_school", "public_school",
    "hospital", "clinic_public", "atm", "parking", "rest_area", "toll",
)

# Words that a name key leaves out.
NAME_NOISE = (
    "llc", "inc", "incorporated", "co", "company", "group", "team", "realty", "realtors",
    "real estate", "properties", "brokerage", "the",
)

# Statuses, and their order in reports.
STATUSES = ("New", "Contacted", "Quoted", "Won", "Lost")

# Headers that mark the name column of a client export.
CRM_NAME_HEADERS = (
    "company name", "company", "business", "business name", "brokerage", "name", "account name", "organization",
)

# Market boxes as (key, label, south, west, north, east).
MARKETS = (
    ("sonoma", "Sonoma County", 38.05, -123.55, 38.85, -122.35),
    ("mendocino", "Mendocino County", 38.75, -123.95, 40.00, -122.82),
    ("lake", "Lake County", 38.65, -123.10, 39.60, -122.32),
    ("napa", "Napa County", 38.15, -122.65, 38.87, -122.06),
    ("solano", "Solano County", 38.03, -122.41, 38.54, -121.59),
    ("marin", "Marin County", 37.80, -122.92, 38.32, -122.43),
    ("bayarea", "Bay Area + Wine Country", 36.85, -124.05, 40.05, -121.45),
    ("california", "California", 32.50, -124.50, 42.05, -114.10),
    ("westcoast", "West Coast (CA/OR/WA)", 32.50, -124.90, 49.05, -114.00),
    ("us", "United States", 24.40, -125.00, 49.50, -66.90),
)
#: County priority where boxes overlap: the first is kept whole.
COUNTY_PRIORITY = ("sonoma", "napa", "marin", "mendocino", "lake", "solano")

# Addresses that are not worth writing to.
JUNK_PREFIXES = (
    "noreply", "no-reply", "donotreply", "bounce", "postmaster",
    "webmaster", "example", "privacy@", "legal@", "press@", "abuse@",
)
JUNK_DOMAINS = (
    "sentry.io", "example.com", "wixpress.com", "squarespace.com",
    "godaddy.com", "wpengine.com", "shopify.com", "amazonaws.com",
    "cloudflare.com", "google.com", "facebook.com", "instagram.com",
    "twitter.com", "yelp.com", "yellowpages.com",
)
GENERIC_LOCAL_PARTS = ("info", "hello", "contact", "hi", "team")
AUDIT_JUNK_DOMAINS = (
    "example.com", "sentry.io", "wix.com", "wixpress.com",
    "godaddy.com", "squarespace.com", "schema.org", "w3.org",
    "domain.com", "email.com", "yourdomain.com",
)
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".css", ".js")

# Builder fingerprints as (name, needles), first hit wins.
BUILDERS_LOWER = (
    ("Wix", ("wix.com",)), ("Squarespace", ("squarespace",)), ("Weebly", ("weebly",)),
    ("GoDaddy Sites", ("godaddy",)), ("WordPress", ("wordpress",)), ("Shopify", ("shopify",)),
    ("Webflow", ("webflow",)), ("Duda", ("duda",)), ("Site123", ("site123",)), ("Jimdo", ("jimdo",)),
)
BUILDERS_CASED = (
    ("Wix", ("wix.com", "_wixCssStates", "X-Wix-")),
    ("Squarespace", ("squarespace.com", "static1.squarespace", "Squarespace")),
    ("Weebly", ("weebly.com", "weeblycloud")),
    ("GoDaddy", ("godaddy", "Website Builder by GoDaddy")),
    ("Shopify", ("cdn.shopify.com", "Shopify", "myshopify")),
    ("WordPress", ("wp-content", "wp-includes", "WordPress")),
    ("Webflow", ("webflow.com", "wf-", "data-wf-")),
    ("Joomla", ("/media/jui/", "Joomla")),
    ("Drupal", ("Drupal.settings", "sites/all/")),
)
BUILDERS_DEEP = (
    ("Wix", ("wix.com", "_wixCssStates", "X-Wix-", "wixstatic")),
    ("Squarespace", ("squarespace.com", "static1.squarespace", "Squarespace")),
    ("Weebly", ("weebly.com", "weeblycloud")),
    ("GoDaddy", ("godaddy", "Website Builder by GoDaddy", "img1.wsimg.com")),
    ("Shopify", ("cdn.shopify.com", "Shopify", "myshopify")),
    ("Squarespace", ("squarespace",)),
    ("Duda", ("dudamobile", "dudaone", "irp.cdn-website.com")),
    ("Site123", ("site123", "us-east-1.linodeobjects")),
    ("Jimdo", ("jimdo",)),
    ("WordPress", ("wp-content", "wp-includes", "WordPress")),
    ("Webflow", ("webflow.com", "wf-", "data-wf-")),
    ("Joomla", ("/media/jui/", "Joomla")),
    ("Drupal", ("Drupal.settings", "sites/all/")),
)
DIY_BASIC = ("Wix", "Weebly", "GoDaddy Sites", "Site123", "Jimdo")
DIY_DEEP = ("Wix", "Weebly", "GoDaddy", "Site123", "Jimdo", "Duda")
ANALYTICS = (
    "google-analytics.com", "googletagmanager.com", "gtag(", "ga('create", "plausible.io",
    "fbevents.js", "clarity.ms",
)

# Phrases and tools of the coordination gap, in order.
HIRING_PHRASES = (
    "hiring a transaction coordinator", "we are hiring a transaction coordinator",
    "seeking a transaction coordinator", "transaction coordinator wanted",
    "now hiring transaction coordinator", "transaction coordinator position",
    "join our team as a transaction coordinator",
)
IN_HOUSE_PHRASES = (
    "our transaction coordinator", "in-house transaction coordinator",
    "our in-house tc", "transaction coordination team", "our transaction team",
    "closing coordinator", "transaction management department",
    "our tc handles", "dedicated transaction coordinator",
)
COORDINATION_SOFTWARE = {
    "skyslope": "SkySlope", "dotloop": "Dotloop",
    "paperlesspipeline": "Paperless Pipeline", "brokermint": "Brokermint",
    "transactiondesk": "TransactionDesk", "transactly": "Transactly",
    "open to close": "Open To Close", "brokerwolf": "BrokerWOLF",
}
CARD_PATTERNS = (
    'class="[^"]*agent[-_ ]?card', 'class="[^"]*team[-_ ]?member', 'class="[^"]*roster[-_ ]?item',
)

# Titles by seniority, for brokerages and for any business.
BROKERAGE_TITLES = (
    "broker/owner", "broker / owner", "designated broker", "managing broker", "principal broker",
    "owner/broker", "broker associate", "office manager", "team lead", "principal", "broker", "owner",
)
GENERAL_TITLES = (
    "owner", "founder", "co-founder", "president", "principal", "proprietor",
    "ceo", "broker", "partner", "managing director", "general manager", "director", "manager",
)
NON_NAME_WORDS = (
    "our", "the", "meet", "team", "about", "contact", "broker", "owner", "agent", "agents", "realtor",
    "realtors", "transaction", "coordinator", "join", "careers", "home", "welcome", "us",
)
GENERAL_NON_NAME_WORDS = (
    "our", "the", "meet", "team", "about", "contact", "owner", "founder", "president", "ceo", "broker",
    "manager", "director", "principal", "home", "welcome", "us", "staff", "agent", "partner",
)
CLIENT_JUNK = (
    "testimonial", "review", "client", "logo", "icon", "image", "photo",
    "read more", "learn more", "see all", "google", "facebook", "verified",
)

# Weights and limits of the two coordinator-fit profiles.
COORDINATOR_WEIGHTS = {
    "per_agent": 1.2, "volume_cap": 50, "open": 35, "hiring": 50, "software": 20, "in_house": 5, "confirmed": 0,
    "phone": 5, "contact": 8, "suppressed": -100, "tier_a": 55, "tier_b": 30,
}
COORDINATOR_WEIGHTS_V0 = COORDINATOR_WEIGHTS | {"per_agent": 1.0, "open": 40, "hiring": 0, "contact": 5}

# Exported columns in order.
EXPORT_VIEW_FIELDS = (
    "name", "category", "city", "address", "phone", "phone_fmt", "area_code", "website", "email", "email_owned",
    "social_platforms", "best_contact", "tier", "tier_reason", "builder", "score", "completeness", "pitch",
    "audit_status", "audit_https", "audit_mobile", "audit_load_ms", "audit_builder", "audit_grade", "audit_error",
    "audit_checked_at", "status", "notes", "last_contacted", "favorite", "lat", "lon", "id",
)
FULL_EXPORT_FIELDS = (
    "id", "name", "category", "alt_categories", "phone", "phone_fmt", "area_code", "phones_all", "email", "email_owned",
    "website", "websites_all", "socials", "social_platforms", "best_contact", "address", "city", "state", "zip",
    "country", "lat", "lon", "tier", "tier_reason", "builder", "industry_fit", "outreach_score", "score",
    "completeness", "confidence", "is_chain", "pitch", "source_dataset", "source_id",
)
#: What the columns of an export hold (own wording).
COLUMN_TEXTS = {
    "id": "key of the lead; an import that meets it again updates the row",
    "name": "name the business trades under",
    "category": "main niche",
    "alt_categories": "further niches, joined by |",
    "phone": "first phone number as the source has it",
    "phone_fmt": "first phone number as (XXX) XXX-XXXX if it has ten digits",
    "area_code": "first three digits of the phone number",
    "phones_all": "all phone numbers, joined by |",
    "email": "first e-mail address",
    "email_owned": "1 if the address is on the domain of the website",
    "website": "first web address, empty if none is known",
    "websites_all": "all web addresses, joined by |",
    "socials": "addresses of social profiles, joined by |",
    "social_platforms": "names of the platforms of these profiles, joined by |",
    "best_contact": "channel to try first: phone, email, social or none",
    "address": "street and number",
    "city": "city",
    "state": "state",
    "zip": "postal code",
    "country": "country",
    "lat": "degrees north",
    "lon": "degrees east",
    "tier": "need of a website: A none of its own, B one from a site builder, C a site of its own",
    "tier_reason": "what put the lead into its tier",
    "builder": "site builder of a lead in tier B",
    "industry_fit": "how likely the niche buys: high, medium or low",
    "outreach_score": "0 to 100, in what order to call: need, reach and fit",
    "score": "0 to 100 from need, reach and confidence, whatever the niche",
    "completeness": "percent of six main fields that are filled",
    "confidence": "0 to 1, how sure the source is that the business is there",
    "is_chain": "1 for an office of a chain",
    "pitch": "line to open a call with",
    "source_dataset": "data set that the record comes from",
    "source_id": "key of the record there",
}

"""Word lists, tables and patterns that results depend on, stated as they are."""

# words that do not tell one business from another
NAME_STOP_WORDS = [
    "салон", "студія", "студия", "студио", "studio", "тату", "tattoo", "tatoo", "барбершоп", "barbershop", "barber",
    "перукарня", "парикмахерская", "beauty", "клініка", "клиника", "clinic", "медичний", "центр", "center", "centre",
    "стоматологія", "стоматология", "dental", "кафе", "cafe", "ресторан", "restaurant", "бар", "bar", "магазин", "shop",
    "store", "маркет", "market", "тов", "фоп", "ооо", "чп", "пп", "llc", "ltd", "спа", "spa", "краси", "красоты",
]

# discovery tags in order of preference
PHONE_KEYS = ["contact:phone", "phone", "contact:mobile", "mobile", "contact:whatsapp"]
WEBSITE_KEYS = ["contact:website", "website", "url", "contact:url"]
EMAIL_KEYS = ["contact:email", "email"]
SOCIAL_KEYS = {
    "instagram": ["contact:instagram", "instagram"],
    "facebook": ["contact:facebook", "facebook"],
    "telegram": ["contact:telegram", "telegram"],
    "tiktok": ["contact:tiktok"],
    "viber": ["contact:viber"],
    "youtube": ["contact:youtube"],
}

BIG_SHOPS = [
    "supermarket", "department_store", "mall", "doityourself", "hypermarket", "wholesale", "chain_store", "variety_store",
]
BIG_AMENITIES = ["marketplace"]
BIG_BRANDS = [
    "сільпо", "silpo", "атб", "atb", "ашан", "auchan", "метро", "metro", "епіцентр", "epicentr", "новус", "novus", "фора",
    "варус", "varus", "watsons", "eva", "єва", "rozetka", "розетка", "comfy", "комфі", "фокстрот", "foxtrot", "мті", "mti",
]
MEDICAL_BRANDS = [
    "synevo", "сінево", "синэво", "синево", "діла", "dila", "дила", "ескулаб", "eskulab", "эскулаб", "csd", "csd lab", "invitro",
    "інвітро", "инвитро", "медлаб", "medlab", "астра-діа", "астра діа", "astra-dia", "astra dia", "анц", "аптека низьких цін",
    "аптека низких цен", "подорожник", "бажаємо здоров'я", "аптека доброго дня", "доброго дня", "аптека 9-1-1", "9-1-1", "d.s.",
    "аптека d.s.", "аптека оптових цін", "копійка", "аптека копійка", "znahar", "знахар", "мед-сервіс", "аптека мед-сервіс", "tas",
    "аптека тас", "бам", "аптека бам", "добробут", "dobrobut", "into-sana", "інто-сана", "инто-сана", "медіком", "medikom", "оберіг",
    "oberig", "ісіда", "isida", "адоніс", "adonis", "медичний центр борис", "медікавер", "medicover", "інто сана", "into sana",
    "клініка борис",
]

HEALTHCARE_AMENITIES = ["hospital", "clinic", "doctors", "dentist", "pharmacy"]
PUBLIC_OPERATORS = ["public", "government", "state", "municipal", "community"]
PRIVATE_OPERATORS = ["private", "private_non_profit", "business", "commercial"]
PUBLIC_NAME = (
    r"(?<!\w)(кнп|кп|кз|ку|кнмп|дз|ду|цпмсд|цпмсдп|црл|цмл|цмкл|омкл)(?!\w)"
    r"|комунальн|коммунальн|державн|государствен|міськ\w* рад|районн\w* рад|обласн\w* рад"
    r"|обласн\w* (клінічн\w* )?(лікарн|шпитал|госпітал|дитяч|центр)"
    r"|міськ\w* (клінічн\w* )?(лікарн|поліклінік|дитяч)"
    r"|(дитяч|районн|студентськ|стоматологічн)\w* поліклінік"
    r"|поліклінік\w* №|лікарн\w* №|поликлиник\w* №|больниц\w* №"
    r"|первинн\w* медико-санітарн|медико-санітарн\w* допомог"
    r"|амбулаторі\w* загальн\w* практик"
    r"|центральн\w* районн\w* лікарн|пологов\w* будин|родильн\w* дом"
    r"|військов|госпіталь ветеран|шпиталь|госпиталь"
    r"|міська лікарня|городская больница|областная больница"
    r"|науково-практичн|научно-практическ|інститут|институт|академі|університет|университет"
)
PRIVATE_NAME = (
    r"приватн|частн|private|(?<!\w)(тов|фоп|пп|ооо|llc|ltd)(?!\w)|клінік|клиник|clinic"
    r"|медичн\w* центр|медицинск\w* центр|medical|med(?!\w)"
)

# page signatures: pattern, kind, vendor
SIGNATURES = [
    (r"yclients\.com|n\d+\.yclients", "booking", "yclients"),
    (r"alteg\.io|altegio\.com", "booking", "altegio"),
    (r"dikidi\.(net|ru|app)", "booking", "dikidi"),
    (r"calendly\.com", "booking", "calendly"),
    (r"setmore\.com|my\.setmore", "booking", "setmore"),
    (r"simplybook\.(me|it)", "booking", "simplybook"),
    (r"booksy\.com", "booking", "booksy"),
    (r"fresha\.com", "booking", "fresha"),
    (r"reservio\.com", "booking", "reservio"),
    (r"appointlet\.com", "booking", "appointlet"),
    (r"squareup\.com/appointments", "booking", "square_appointments"),
    (r"cal\.com/(embed|api)", "booking", "cal.com"),
    (r"zapisonline|onlinezapis", "booking", "zapisonline"),
    (r"helsi\.me", "booking", "helsi"),
    (r"doc\.ua", "booking", "doc.ua"),
    (r"likarni\.com", "booking", "likarni"),
    (r"restoplace\.(ws|cc)", "booking", "restoplace"),
    (r"thefork\.com|lafourchette", "booking", "thefork"),
    (r"bookform\.ru|widget\.bnovo", "booking", "bnovo"),
    (r"tidio\.co|tidiochat", "chat", "tidio"),
    (r"crisp\.chat", "chat", "crisp"),
    (r"jivo(site)?\.(ru|com|chat)", "chat", "jivosite"),
    (r"tawk\.to", "chat", "tawk"),
    (r"chatra\.io", "chat", "chatra"),
    (r"widget\.intercom\.io|intercomcdn", "chat", "intercom"),
    (r"smartsupp\.com", "chat", "smartsupp"),
    (r"helpcrunch\.com", "chat", "helpcrunch"),
    (r"js\.driftt\.com", "chat", "drift"),
    (r"static\.zdassets\.com|zopim", "chat", "zendesk"),
    (r"livechatinc\.com", "chat", "livechat"),
    (r"verbox\.ru|siteheart", "chat", "verbox"),
    (r"replain\.cc", "chat", "replain"),
    (r"umnico\.com", "chat", "umnico"),
    (r"chaport\.com", "chat", "chaport"),
    (r"chatbot\.com|manychat\.com", "chat", "manychat"),
    (r"bitrix24|b24-[\w]+\.bitrix24|cdn-ru\.bitrix24", "crm", "bitrix24"),
    (r"keycrm\.app", "crm", "keycrm"),
    (r"salesdrive\.me", "crm", "salesdrive"),
    (r"binotel\.(com|ua)", "calltracking", "binotel"),
    (r"ringostat\.(com|net)", "calltracking", "ringostat"),
    (r"phonet\.com\.ua", "calltracking", "phonet"),
    (r"stream-?telecom|zadarma\.com/widget", "calltracking", "other_telephony"),
    (r"callbackhunter|callback-?hunter", "callback", "callbackhunter"),
    (r"envybox|envycdn", "callback", "envybox"),
    (r"callbackkiller|marquiz\.ru", "callback", "other_callback"),
    (r"telegram\.org/js/telegram-widget", "messenger", "telegram_widget"),
    (r"t\.me/[\w_]+\?start=", "messenger", "telegram_bot"),
    (r"wa\.me/\d|api\.whatsapp\.com/send", "messenger", "whatsapp_button"),
    (r"viber://(chat|pa)", "messenger", "viber_button"),
    (r"getbutton\.io", "messenger", "getbutton"),
    (r"docs\.google\.com/forms", "form", "google_forms"),
    (r"typeform\.com", "form", "typeform"),
    (r"jotform\.com", "form", "jotform"),
    (r"cdn\.shopify\.com", "platform", "shopify"),
    (r"tildacdn|tilda\.ws", "platform", "tilda"),
    (r"wixstatic\.com|parastorage\.com", "platform", "wix"),
    (r"horoshop\.ua", "platform", "horoshop"),
    (r"prom\.ua/cabinet|khoroshop", "platform", "prom"),
    (r"/wp-content/|/wp-includes/", "platform", "wordpress"),
    (r"squarespace\.com|static1\.squarespace", "platform", "squarespace"),
    (r"cdn\.readymag|webflow\.com", "platform", "webflow"),
]
BOOKING_HINT = (
    r"(запис(атися|атись|аться|ь)\s+онлайн|онлайн[-\s]?запис|online\s+booking|"
    r"book\s+(now|online)|забронювати|забронировать|записатися\s+на\s+прийом)"
)
STRONG_KINDS = ["booking", "chat", "callback", "crm", "calltracking"]

# size scoring
BASELINE = {
    "hairdresser": 0, "nails": 0, "tattoo": 0, "florist": 0, "photo": 0, "craft": 0, "jewelry": 0, "beauty": 1, "cafe": 1, "bakery": 1,
    "bar": 1, "cleaning": 1, "pet": 1, "optician": 1, "repair_car": 1, "lawyer": 1, "accountant": 1, "travel": 1, "real_estate": 1,
    "insurance": 1, "clothes": 1, "furniture": 1, "kids": 1, "restaurant": 2, "dentist": 2, "vet": 2, "fitness": 2, "spa": 2,
    "language_school": 2, "driving_school": 2, "clinic": 3, "hotel": 3, "pharmacy": 2, "doctors": 0, "cosmetology": 1, "lab": 2, "rehab": 2,
    "hospital": 3,
}
CHAIN_TAGS = ["brand", "brand:wikidata", "operator", "operator:wikidata"]
CAPACITY_TAGS = ["capacity", "rooms", "beds", "capacity:persons"]
NEGATIVE_VALUES = ["no", "none", "false", "0", ""]

# contacts
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
EMAIL_BLOCKED = (
    r"(example[.@]|sentry\.|wixpress\.|\.png|\.jpe?g|\.gif|\.svg|\.webp|@2x|"
    r"^your(name|email)@|^email@|@(your)?domain\.com|^test@|noreply|no-reply|"
    r"^mail@mail\.|^user@|^name@|^info@site\.|^admin@localhost)"
)
SOCIAL_PATTERNS = {
    "instagram": r"^https?://(?:www\.)?instagram\.com/([\w.\-]+)",
    "facebook": r"^https?://(?:www\.|m\.)?facebook\.com/([\w.\-]+)",
    "telegram": r"^https?://(?:t\.me|telegram\.me)/([\w.\-+]+)",
    "tiktok": r"^https?://(?:www\.)?tiktok\.com/(@[\w.\-]+)",
    "youtube": r"^https?://(?:www\.)?youtube\.com/(@?[\w.\-/]+)",
    "viber": r"^viber://.*",
    "whatsapp": r"^https?://(?:wa\.me|api\.whatsapp\.com)/(\S+)",
    "linkedin": r"^https?://(?:[\w]+\.)?linkedin\.com/(company|in)/([\w.\-]+)",
}
SOCIAL_JUNK = ["sharer", "share.php", "intent", "plugins", "profile.php?id=0"]
SOCIAL_WITH_QUERY = ["viber", "whatsapp"]
MAKER_CREDIT = (
    r"(розроб|разработ|developed|created by|made by|powered by|"
    r"створенн?я сайт|создание сайт|веб[- ]?студ|web[- ]?studio)"
)
CONTACT_LINK = r"(контакт|contact|kontakt|звяж|зв.?язатися|связ|about|про[- _]?нас|о[- _]?нас|reach)"
CONTACT_WORD = r"контакт|contact|kontakt"
KNOWN_MAIL_DOMAINS = [
    "gmail.com", "googlemail.com", "ukr.net", "i.ua", "meta.ua", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com",
    "proton.me", "protonmail.com", "bigmir.net", "online.ua", "email.ua",
]
AGGREGATORS = [
    "olx.ua", "prom.ua", "rieltor.ua", "dom.ria.com", "ria.com", "2gis.ua", "2gis.ru", "yell.ru", "ua.kompass.com",
    "b2btoday.com.ua", "flagma.ua", "allbiz.ua", "ua.all.biz", "tripadvisor.com", "booking.com", "foursquare.com", "yelp.com",
    "zoon.com.ua", "google.com", "maps.google.com", "youtube.com", "wikipedia.org", "work.ua", "rabota.ua", "facebook.com",
    "instagram.com", "t.me", "linkedin.com", "pinterest.com",
]
# Ukrainian numbers: +380 and nine digits that begin with an operator's or an area's code
UA_OPERATOR_CODES = [
    "39", "50", "63", "66", "67", "68", "73", "75", "77", "91", "92", "93", "94", "95", "96", "97", "98", "99", "89",
]
UA_AREA_FIRST_DIGITS = "3456"

# addresses and names
STREET_WORDS = (
    r"\b(вул|вулиця|ул|улица|просп|проспект|пр-т|бульв|бульвар|бул|пров|провулок|пер|переулок"
    r"|пл|площа|площадь|шосе|шоссе|узвіз|спуск|будинок|буд|дом|д|корпус|корп|кв|офіс|оф"
    r"|україна|украина|місто|город|м|г|область|обл)\b\.?"
)
STREET_ALONE = (  # a street whose name does not end in a house number
    r"^(вул|вулиця|ул|улица|просп|проспект|пр-т|бульв|бульвар|бул|пров|провулок|пер|переулок|пл|площа|площадь|шосе|шоссе|узвіз|спуск)\b(?!.*\d\w?$)"
)
ADDRESS_SKIP = r"(область|район|^україна$|^\d{5}$|^(місто|село|селище|смт|м\.)\s)"
CITY_PREFIX = r"^(м\.|місто|г\.|город|смт\.?|с\.)\s*"
LEGAL_FORMS = [
    ("ТОВАРИСТВО З ОБМЕЖЕНОЮ ВІДПОВІДАЛЬНІСТЮ", "ТОВ"),
    ("ФІЗИЧНА ОСОБА[- ]ПІДПРИЄМЕЦЬ", "ФОП"),
    ("ПРИВАТНЕ ПІДПРИЄМСТВО", "ПП"),
    ("ПРИВАТНЕ АКЦІОНЕРНЕ ТОВАРИСТВО", "ПрАТ"),
    ("НЕКОМЕРЦІЙНЕ ПІДПРИЄМСТВО", "НП"),
]
CATEGORY_HINTS = [
    (r"стоматолог|dental|дент", "dentist"),
    (r"лаборатор|laborator|аналіз|анализ", "lab"),
    (r"реабіліт|реабилит|rehab|фізіотерап|физиотерап", "rehab"),
    (r"косметолог|дерматолог|cosmetolog|aesthetic|естетичн|эстетич", "cosmetology"),
]
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i",
    "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh",
    "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ь": "", "ю": "iu", "я": "ia", "ы": "y", "э": "e", "ъ": "", "ё": "e", "'": "", "’": "",
}
PROFILE_TITLE_TAIL = r"\s*(\(@[^)]*\)|[•|·]\s*instagram.*$)"
SEARCH_NAME_TAIL = r"\s+[–—-]\s+.*$|\s*[|,(].*$"
INSTAGRAM_URL = r"^(?:https?://)?(?:[\w-]+\.)?instagram\.com/([^/?#]+)"
INSTAGRAM_NAME = r"^[a-z0-9._]{1,30}$"
INSTAGRAM_RESERVED = [
    "p", "reel", "reels", "tv", "explore", "accounts", "stories", "direct", "about", "legal", "developer", "web", "challenge",
    "s",
]

# registry codes
PRIVATE_PROPERTY = ["ФОП", "Приватна (без ФОП)"]
CARE_CATEGORY = {"Первинна": "doctors", "Спеціалізована": "clinic"}
SKIPPED_DIVISIONS = ["ФАП"]

# categories: bundles in order, priority first
BUNDLES = {
    "beauty_all": "hairdresser beauty nails tattoo spa".split(),
    "medical": "dentist clinic doctors lab rehab cosmetology hospital".split(),
    "horeca": "cafe restaurant bar bakery".split(),
    "services": "real_estate lawyer accountant travel photo cleaning".split(),
}
CATEGORY_FILTERS = {
    "hairdresser": ["shop=hairdresser"], "beauty": ["shop=beauty", "shop=cosmetics", "shop=massage"], "nails": ["shop=beauty][beauty=nails"],
    "tattoo": ["shop=tattoo"], "dentist": ["amenity=dentist", "healthcare=dentist"],
    "clinic": ["amenity=clinic", "healthcare=clinic", "healthcare=centre"], "doctors": ["amenity=doctors", "healthcare=doctor"],
    "lab": ["healthcare=laboratory", "healthcare=sample_collection"], "rehab": ["healthcare=rehabilitation", "healthcare=physiotherapist"],
    "cosmetology": ["healthcare:speciality~cosmetology|dermatology|aesthetic"], "hospital": ["amenity=hospital", "healthcare=hospital"],
    "vet": ["amenity=veterinary"], "pharmacy": ["amenity=pharmacy", "healthcare=pharmacy"],
    "fitness": ["leisure=fitness_centre", "leisure=sports_centre"], "spa": ["leisure=spa", "amenity=spa"],
    "real_estate": ["office=estate_agent", "shop=estate_agent"], "lawyer": ["office=lawyer", "office=notary"],
    "accountant": ["office=accountant", "office=financial"], "travel": ["shop=travel_agency"], "insurance": ["office=insurance"],
    "photo": ["shop=photo", "craft=photographer"], "driving_school": ["amenity=driving_school"],
    "language_school": ["amenity=language_school", "office=educational_institution"],
    "repair_car": ["shop=car_repair", "shop=tyres", "shop=car_parts"], "cleaning": ["shop=laundry", "shop=dry_cleaning", "craft=cleaning"],
    "cafe": ["amenity=cafe"], "restaurant": ["amenity=restaurant"], "bar": ["amenity=bar", "amenity=pub"],
    "bakery": ["shop=bakery", "shop=pastry"], "hotel": ["tourism=hotel", "tourism=guest_house", "tourism=hostel"],
    "florist": ["shop=florist"], "clothes": ["shop=clothes", "shop=shoes"], "furniture": ["shop=furniture", "shop=interior_decoration"],
    "jewelry": ["shop=jewelry"], "pet": ["shop=pet", "shop=pet_grooming"], "optician": ["shop=optician"],
    "kids": ["shop=toys", "amenity=kindergarten"], "craft": ["craft=*"],
}

# sales stages and queue states
CRM_LABELS = {
    "new": "Новий", "in_progress": "В роботі", "no_answer": "Недодзвон", "interested": "Зацікавлений", "demo_done": "Демо показано",
    "won": "Закрито (угода)", "lost": "Відмова",
}
CLOSED_STAGES = ["won", "lost"]
QUEUE_LABELS = {
    "queued": "У черзі", "claimed": "Взято агентом", "sent": "Надіслано", "replied": "Відповіли", "failed": "Не вдалося",
    "skipped": "Пропущено",
}
QUEUE_MOVES = {"sent": ["claimed"], "failed": ["claimed"], "skipped": ["queued", "claimed"], "replied": ["sent"]}
CAPACITY_STATES = ["claimed", "sent", "replied", "failed"]
NO_WEBSITE_STATES = ["not_found", "site_down"]
EXPORT_COLUMNS = [
    "id", "name", "category", "city", "address", "phone", "email", "email_valid", "website", "website_status", "contact_person", "edrpou",
    "instagram", "facebook", "telegram", "other_socials", "has_automation", "automation", "size_estimate", "contact_score", "status",
    "crm_status", "source", "osm_id", "merged_ids", "lat", "lon", "last_verified_at", "notes",
]

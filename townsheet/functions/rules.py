"""Classification rules as data, and columns built from them.

A classification is a struct (category, subcategory, source) or null; chains are coalesce() of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: the closed vocabulary, reject rules and mappings that results must equal. ----

CATEGORIES = {
    "music": ("concert", "dj-set", "open-mic", "classical", "jazz"),
    "sports": ("fitness", "yoga", "running", "basketball", "swimming", "cycling", "martial-arts", "sports-general"),
    "food-drink": ("market", "tasting", "pop-up", "class"),
    "art": ("exhibition", "film-screening", "arts-crafts", "public-art"),
    "performance": ("dance", "theatre", "comedy", "storytelling"),
    "learning": ("talk", "workshop", "class", "history"),
    "community": ("street-fair", "block-party", "parade", "volunteer", "market", "health", "games", "religious"),
    "outdoors": ("park-programming", "walking-tour", "nature", "waterfront", "gardening"),
}

TITLE_REJECTS = (
    (r"\bclosur(e|es)\b|\bclosed\b|\bshut ?down\b", "closure or shutdown, not an event"),
    (r"^\s*(parks? event|event|tbd|n/?a|test|permit|none|misc\.?)\s*$", "placeholder title, no event described"),
    (r"\bmaintenance\b|\bload[- ]?(in|out)\b|\bbreak[- ]?down\b|\bset[- ]?up only\b|\bstaging\b", "logistics, not an event"),
    (r"\bfilming\b|\bfilm shoot\b|\bphoto shoot\b", "film/TV production"),
    (r"^\s*(celebration|miscellaneous|picnic|barbecue|bbq|party|gathering|reunion|gathering of friends|family gathering|birthday(\s+party)?|wedding|baby shower|memorial service)\s*$", "generic private permit, not a public event"),
    (r"\bsummer camp\b|\bday camp\b|\bafter[- ]?school\b|\bteam practice\b|\btraining\b|\bclinic\b", "camp or training programme, not a public event"),
    (r"\bpermit\b", "permit record, not an event"),
)
TOO_SHORT = "title too short to be an event"

LIBRARY_TAGS = {
    "summer meals": "meal service, not a programme",
    "free summer meals": "meal service, not a programme",
    "grab and go kits": "take-home kit, not a programme",
    "book sale": "ongoing shop, not a programme",
    "Cycle Alliance": "supply pantry, not a programme",
    "legal resources": "advice service, not a programme",
    "Immigrant Services": "advice service, not a programme",
    "ESOL": "recurring language course",
    "Welcome ESOL": "recurring language course",
    "WeSpeakNYC": "recurring language course",
    "english conversation group": "recurring language course",
    "citizenship": "recurring civics course",
    "computer basics": "recurring computer course",
    "resume": "job-help service, not a programme",
}
LIBRARY_TITLES = r"\bnotary\b|\bask a tech\b|\bneighborhood tech help\b|\bfood pantry\b|\bperiod pantry\b|\bblood drive\b|\bpassport (day|appointment|service)|\btax (help|prep|assistance)\b|\bsnap (enrol|benefit|application)|\bhealth insurance\b|\bgrab (and|&) go\b|\bbook sale\b"
LIBRARY_SERVICE = "standing service, not a programme"

PERMIT_REJECTS = {
    "sport - youth": "league field permit, not a public event",
    "sport - adult": "league field permit, not a public event",
    "production event": "film/TV production permit",
    "shooting permit": "film/TV production permit",
    "theater load in and load outs": "logistics, not an event",
    "stationary demonstration": "demonstration permit, not programming",
}
PERMITS = {
    "block party": "community/block-party",
    "single block festival": "community/block-party",
    "street festival": "community/street-fair",
    "farmers market": "community/market",
    "sidewalk sale": "community/market",
    "parade": "community/parade",
    "plaza event": "community/street-fair",
    "plaza partner event": "community/street-fair",
    "street event": "community/street-fair",
    "open street partner event": "community/street-fair",
    "health fair": "community/health",
    "religious event": "community/religious",
    "athletic race / tour": "sports/running",
    "open culture": "music/concert",
}

#: Park category to priority and class; the highest priority wins, the first of equals.
PARKS = {
    "basketball/netball": (9, "sports/basketball"),
    "swimming/aquatics": (9, "sports/swimming"),
    "running/jogging": (9, "sports/running"),
    "yoga & pilates classes": (9, "sports/yoga"),
    "bike/cycling": (9, "sports/cycling"),
    "martial arts": (9, "sports/martial-arts"),
    "dance classes": (8, "performance/dance"),
    "dance": (7, "performance/dance"),
    "film": (8, "art/film-screening"),
    "arts & crafts": (8, "art/arts-crafts"),
    "art": (6, "art/public-art"),
    "music": (8, "music/concert"),
    "concerts": (8, "music/concert"),
    "theater": (8, "performance/theatre"),
    "comedy": (8, "performance/comedy"),
    "gardening": (8, "outdoors/gardening"),
    "nature": (7, "outdoors/nature"),
    "urban park rangers": (6, "outdoors/nature"),
    "birding": (8, "outdoors/nature"),
    "waterfront": (7, "outdoors/waterfront"),
    "walking": (7, "outdoors/walking-tour"),
    "tours": (7, "outdoors/walking-tour"),
    "history": (7, "learning/history"),
    "education": (6, "learning/talk"),
    "workshops": (7, "learning/workshop"),
    "talks": (7, "learning/talk"),
    "volunteer": (8, "community/volunteer"),
    "it's my park": (8, "community/volunteer"),
    "games": (6, "community/games"),
    "food": (7, "food-drink/tasting"),
    "markets": (8, "community/market"),
    "exercise classes": (5, "sports/fitness"),
    "outdoor fitness": (5, "sports/fitness"),
    "shape up nyc": (5, "sports/fitness"),
    "fitness": (4, "sports/fitness"),
    "summer sports experience": (4, "sports/sports-general"),
    "recreation center programming": (2, "sports/sports-general"),
    "sports": (3, "sports/sports-general"),
}
PARK_FLAGS = {"best for kids": "kids", "accessible activities": "accessible", "seniors": "seniors", "teens": "teens"}

GENRES = {
    "jazz": "music/jazz",
    "classical": "music/classical",
    "opera": "music/classical",
    "electronic": "music/dj-set",
    "dance/electronic": "music/dj-set",
    "theatre": "performance/theatre",
    "theater": "performance/theatre",
    "comedy": "performance/comedy",
    "dance": "performance/dance",
    "performance art": "performance/theatre",
    "circus & specialty acts": "performance/theatre",
    "magic & illusion": "performance/theatre",
    "children's theatre": "performance/theatre",
    "fine art": "art/exhibition",
    "basketball": "sports/basketball",
    "tennis": "sports/sports-general",
    "boxing": "sports/martial-arts",
    "wrestling": "sports/martial-arts",
    "mixed martial arts": "sports/martial-arts",
    "cycling": "sports/cycling",
    "swimming": "sports/swimming",
    "running": "sports/running",
}
SEGMENTS = {"music": "music/concert", "sports": "sports/sports-general", "arts & theatre": "performance/theatre", "film": "art/film-screening"}

VENUE_WORDS = (
    (("theatre", "theater", "playhouse", "stage", "opera house"), "performance/theatre"),
    (("museum", "gallery"), "art/exhibition"),
    (("comedy cellar", "comedy club"), "performance/comedy"),
    (("stadium", "arena", "ballpark", "field house"), "sports/sports-general"),
)

SCHEMA_TYPES = {
    "screeningevent": "art/film-screening",
    "exhibitionevent": "art/exhibition",
    "comedyevent": "performance/comedy",
    "theaterevent": "performance/theatre",
    "danceevent": "performance/dance",
    "sportsevent": "sports/sports-general",
    "educationevent": "learning/talk",
    "literaryevent": "learning/talk",
    "foodevent": "food-drink/tasting",
}
SCHEMA_DEFAULTS = {"musicevent": "music/concert"}

TERMS = {
    "music": "music/concert",
    "concert": "music/concert",
    "sports": "sports/sports-general",
    "film": "art/film-screening",
    "screening": "art/film-screening",
    "exhibition": "art/exhibition",
    "theatre": "performance/theatre",
    "theater": "performance/theatre",
    "dance": "performance/dance",
    "comedy": "performance/comedy",
    "talk": "learning/talk",
    "lecture": "learning/talk",
    "workshop": "learning/workshop",
}

TITLE_WORDS = (
    (("farmers market", "greenmarket", "flea", "bazaar"), "community/market"),
    (("parade",), "community/parade"),
    (("block party",), "community/block-party"),
    (("concert", "live music", "band", "orchestra", "philharmonic"), "music/concert"),
    (("dj ", " dj", "dance party"), "music/dj-set"),
    (("jazz",), "music/jazz"),
    (("film", "movie", "screening", "cinema"), "art/film-screening"),
    (("comedy", "stand-up", "standup"), "performance/comedy"),
    (("theater", "theatre", "play "), "performance/theatre"),
    (("dance",), "performance/dance"),
    (("yoga", "pilates"), "sports/yoga"),
    (("run ", "5k", "10k", "marathon"), "sports/running"),
    (("bike", "cycling"), "sports/cycling"),
    (("tour", "walk"), "outdoors/walking-tour"),
    (("workshop",), "learning/workshop"),
    (("lecture", "talk", "panel", "reading"), "learning/talk"),
    (("volunteer", "cleanup", "clean-up"), "community/volunteer"),
    (("festival", "fair", "fest"), "community/street-fair"),
    (("greenmarket", "farm stand", "food market"), "community/market"),
    (("circus", "performance", "performances"), "performance/theatre"),
    (("fitness", "workout", "bootcamp", "zumba"), "sports/fitness"),
    (("rowing", "kayak", "canoe", "sail"), "outdoors/waterfront"),
    (("skate", "skateboard", "roller"), "sports/sports-general"),
    (("health", "wellness", "vaccination", "screening clinic"), "community/health"),
    (("opening reception", "opening of", "vernissage", "exhibition", "exhibit", "installation", "art auction"), "art/exhibition"),
    (("crafting", "knit", "quilt", "carving", "ceramics", "printmaking", "collage", "zine"), "art/arts-crafts"),
    (("shanty", "singalong", "sing-along", "recital", "chorus"), "music/concert"),
    (("tasting", "whiskey", "wine", "beer", "cocktail", "bar crawl", "dinner", "brunch"), "food-drink/tasting"),
    (("commemoration", "anniversary", "memorial", "history", "historian", "archive"), "learning/history"),
    (("residency", "seminar", "symposium", "class", "course"), "learning/class"),
    (("storytelling", "storytime", "story time"), "performance/storytelling"),
    (("nature", "audubon", "wildlife", "birding", "bird walk", "foraging", "stargazing"), "outdoors/nature"),
    (("garden", "planting", "compost"), "outdoors/gardening"),
    (("performing arts", "cabaret", "vaudeville", "burlesque", "improv"), "performance/theatre"),
    (("smorgasburg", "night market", "food truck"), "food-drink/market"),
    (("open mic",), "music/open-mic"),
)

# ---- Columns over those tables. ----


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _class(code: Column, source: Column) -> Column:
    """category/subcategory and where it came from, or null."""
    return _once(code, lambda c: F.struct(F.substring_index(c, "/", 1).alias("category"), F.substring_index(c, "/", -1).alias("subcategory"), source.alias("source")))


def _once(c: Column, make) -> Column:
    """make(c) where c is not null; c stands in the plan once, however often make uses it."""
    return F.get(F.transform(F.array(c), lambda x: F.when(x.isNotNull(), make(x))), F.lit(0))


def first_of(classes: Column) -> Column:
    """The first element of an array that is not null."""
    return F.get(F.filter(classes, lambda x: x.isNotNull()), F.lit(0))


def fixed(code: str, source: str) -> Column:
    return _class(F.lit(code), F.lit(source))


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def _words(groups, c: Column) -> Column:
    """The code of the first group with a word in the text."""
    text, out = F.lower(c), None
    for words, code in groups:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def rejected_title(c: Column, rules=TITLE_REJECTS) -> Column:
    """Why a title is no public event, or null; a null title is too short."""
    t = F.trim(F.coalesce(c, F.lit("")))
    out = F.when(F.length(t) < 3, TOO_SHORT)
    for pattern, reason in rules:
        out = out.when(t.rlike("(?i)" + pattern), reason)
    return out


def rejected_library(title: Column, tags: Column) -> Column:
    by_tag = first_of(F.transform(tags, lambda t: F.try_element_at(_table(LIBRARY_TAGS), F.trim(t))))
    return F.coalesce(by_tag, F.when(title.rlike("(?i)" + LIBRARY_TITLES), LIBRARY_SERVICE))


def rejected_permit(kind: Column) -> Column:
    return F.try_element_at(_table(PERMIT_REJECTS), _key(kind))


def from_parks(categories: Column) -> Column:
    ranks, codes = _table({k: str(p) for k, (p, _) in PARKS.items()}), _table({k: c for k, (_, c) in PARKS.items()})
    named = F.transform(F.split(categories, r"\|"), lambda x, i: F.struct(F.try_element_at(ranks, _key(x)).cast("int").alias("rank"), (-i).alias("first"), F.try_element_at(codes, _key(x)).alias("code")))
    best = F.array_max(F.filter(named, lambda x: x["rank"].isNotNull()))
    return _class(best["code"], F.lit("parks:categories"))


def park_flags(categories: Column) -> Column:
    found = F.transform(F.split(F.coalesce(categories, F.lit("")), r"\|"), lambda x: F.try_element_at(_table(PARK_FLAGS), _key(x)))
    return F.filter(found, lambda x: x.isNotNull())


def from_permit(kind: Column) -> Column:
    return _class(F.try_element_at(_table(PERMITS), _key(kind)), F.lit("permit:event_type"))


def from_genres(classifications: Column) -> Column:
    """For each entry in turn: sub-genre, genre, then segment."""

    def one(c: Column) -> Column:
        sub, genre, segment = (_class(F.try_element_at(_table(t), _key(c[f]["name"])), F.lit(f"ticketmaster:{f}")) for f, t in (("subGenre", GENRES), ("genre", GENRES), ("segment", SEGMENTS)))
        return F.coalesce(sub, genre, segment)

    return first_of(F.transform(classifications, one))


def from_venue(name: Column) -> Column:
    return _class(_words(VENUE_WORDS, name), F.lit("venue-name"))


def from_schema(kind: Column) -> Column:
    return _class(F.try_element_at(_table(SCHEMA_TYPES), _key(kind)), F.concat(F.lit("schema:"), _key(kind)))


def from_schema_default(kind: Column) -> Column:
    return _class(F.try_element_at(_table(SCHEMA_DEFAULTS), _key(kind)), F.concat(F.lit("schema-default:"), _key(kind)))


def from_term(word: Column, prefix: str = "term:") -> Column:
    return _class(F.try_element_at(_table(TERMS), _key(word)), F.concat(F.lit(prefix), _key(word)))


def from_title(c: Column, groups=TITLE_WORDS) -> Column:
    return _class(_words(groups, c), F.lit("title"))


def renamed(found: Column, source: str) -> Column:
    """The same class, found in another way."""
    return _once(found, lambda f: F.struct(f["category"].alias("category"), f["subcategory"].alias("subcategory"), F.lit(source).alias("source")))


def title_over(words: Column, source: str) -> Column:
    """Title rules over an array of words; the first word that hits."""
    return renamed(first_of(F.transform(words, lambda w: from_title(w))), source)


def valid(category: Column, subcategory: Column) -> Column:
    codes = [f"{c}/{s}" for c, subs in CATEGORIES.items() for s in subs]
    return F.coalesce(F.concat_ws("/", category, subcategory).isin(codes), F.lit(False))

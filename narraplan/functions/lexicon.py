"""Word lists and thresholds that decide results.

Every operator takes them as arguments; these are the defaults.
"""

# --- fixed values: pacing and timing ---------------------------------------
WORDS_PER_SECOND = 2.5
TARGET_SCENE_MS = 4000
MAX_SHOTS_PER_SCENE = 3
SHOT_OVERLAP_MS = 250
CHAR_MS = 75
TERM_DEFAULT_MS = 400
TERM_FLOOR_MS = 200
TERM_TAIL_MS = 1200
SILENCE_DB = -38.0
SILENCE_HEADROOM_DB = 26.0
MIN_SILENCE_MS = 280
SNAP_MS = 1100
SNAP_AFTER_PREVIOUS_MS = 400
MIN_BOUND_STEP_MS = 300
MAX_CHUNK_WORDS = 7
MAX_CHUNK_LINES = 2
MIN_WINDOW_MS = 30
MIN_CHUNK_MS = 50
CARD_MAX_WORDS = 10
CARD_SHORT_WORDS = 6
CARD_SPACING = 4
CUE_MIN_GAP_MS = 1200
CUE_LEAD_MS = {"riser": 900, "card": 900}
CUE_DEFAULT_LEAD_MS = 60
CUE_KINDS = ["whoosh", "whoosh_soft", "impact", "riser", "card", "key"]

# --- fixed values: clip selection --------------------------------------------
RESULTS_PER_QUERY = 30
TOP_CANDIDATES = 6
STRONG_SIMILARITY = 0.24
MIN_SIMILARITY = 0.19
TARGET_WIDTH = 1920
CACHE_TTL_S = 24 * 3600
DEFAULT_TOPIC = ("cinematic b-roll landscape", "nature")

# --- fixed values: boundary and motion labels --------------------------------
BOUNDARY_WEIGHTS = [("cut", 6), ("punch", 5), ("black", 3), ("white", 2), ("zoompunch", 4)]
MOTION_LABELS = ["zoom-in", "zoom-out", "pan-left", "pan-right", "pan-up"]

# --- fixed values: word lists -------------------------------------------------
CAPTION_FILLER = [
    "the", "and", "with", "from", "for", "into", "over", "out", "his", "her",
    "their", "a", "an", "of", "at", "in", "on", "to", "up", "by", "or", "man",
    "woman", "person", "people", "close", "view", "aerial", "home", "table",
    "background", "simple",
]
QUERY_FILLER = [
    "the", "and", "with", "from", "for", "into", "his", "her", "their", "who",
    "that", "this", "then", "them", "out", "off", "over",
]
PERSON_WORDS = [
    "man", "woman", "person", "people", "adult", "senior", "guy", "lady",
    "male", "female", "human", "patient",
]
ANIMAL_WORDS = [
    "dog", "cat", "pet", "puppy", "kitten", "bird", "animal", "wildlife",
    "horse", "cow", "duck", "deer", "insect", "bee", "wasp", "hornet",
    "squirrel", "fox", "monkey", "lamb", "sheep", "goat", "calf", "chicken",
    "rooster", "hen", "pig", "piglet", "rabbit", "bunny", "fish", "kitty",
    "pony", "donkey", "elephant", "lion", "tiger", "bear", "wolf", "turtle",
    "frog",
]
TERM_STOP = [
    "the", "this", "that", "these", "those", "then", "there", "your", "you",
    "when", "if", "for", "do", "now", "start", "after", "and", "but", "it",
    "in", "a", "an", "number", "first", "second", "third", "fourth", "fifth",
    "one", "two", "three", "four", "five", "so", "here", "have", "what", "why",
    "how", "his", "her", "he", "she",
]
CALLOUT_STOP = [
    "The", "They", "This", "That", "There", "Those", "Then", "These", "Your",
    "You", "When", "If", "For", "Do", "Now", "Start", "After", "Once", "But",
    "It", "In", "A", "An", "Move", "Think", "Drink", "Water", "Keep", "Try",
    "Continue", "Second", "First", "Suppose", "During", "Sometimes", "Most",
    "Every", "Pain", "Coffee", "Caffeine", "Many", "Sleep", "Dry", "Pouring",
    "Large", "Small", "Not", "Fluid", "Wake", "Produce",
]
SMALL_NUMBERS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight",
    "nine",
]
BIG_NUMBERS = [
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty",
    "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
]
NUMBER_CONNECTORS = ["to", "or", "and"]
NUMBER_UNITS = [
    "ounces", "ounce", "hours", "hour", "minutes", "minute", "times",
    "glasses", "glass", "weeks", "week", "days", "day",
]
# Stands in for a part-of-speech tagger: function words that never name a picture.
KEYWORD_STOP = [
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "were",
    "been", "have", "has", "had", "not", "but", "you", "your", "they", "them",
    "their", "his", "her", "its", "our", "can", "will", "would", "should",
    "could", "who", "what", "when", "where", "why", "how", "there", "then",
    "than", "into", "over", "out", "off", "all", "any", "each", "some", "such",
]

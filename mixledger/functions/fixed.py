"""Words, patterns, limits and formats that results depend on."""

# Label patterns.
ORIGINAL_SUFFIX = r"(?iU)\s*[\(\[]\s*original(?:\s+(?:mix|version))?\s*[\)\]]\s*$"
ORIGINAL_VERSIONS = ["original", "original mix", "original version"]
TRAILING_VERSION = r"(?U)^(.*\S)\s*[\(\[]([^\)\]]+)[\)\]]\s*$"
TAGGED_VERSION = r"(?U)^(.*\S)\s*\(([^()\[\]]*\([A-Z]{2,3}\)[^()\[\]]*)\)\s*$"
INNER_TAG = r"(?U)\s*\((?!(?:MIX|DUB|VIP|RMX)\))[A-Z]{2,3}\)(?=\s+[\p{L}\p{N}_][^()]*\))"
ARTIST_TAG = r"(?U)\s*\([A-Z]{2,3}\)(?=\s|$|[,;/&)\]])"
CREDIT_SEPARATOR = (
    r"(?U)\s*[,;/]\s*|\s+&\s+|\s+(?i:x)\s+|\s+(?i:featuring|feat\.?|ft\.?|vs\.?)\s+"
)
FEATURING = r"(?i:featuring\s+|feat(?:\.\s*|\s+)|ft(?:\.\s*|\s+))"
FEATURED = (
    rf"(?U)\s*[\(\[]\s*{FEATURING}([^\(\)\[\]]+?)\s*[\)\]]"
    rf"|\s+{FEATURING}([^\(\)\[\]]+?)(?=\s*(?:[\(\[]|$))"
)
VERSION_MARKERS = ["extended", "radio", "dub", "instrumental", "live", "remix"]

# Invisible marks that reorder or hide text.
HIDDEN_MARKS = r"[\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
# Control characters that are white space, and the other ones.
CONTROL_SPACES = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}]"
CONTROL_SPACES_BUT_LINES = r"[\x0B\f\r\x1C-\x1F\x{85}]"
CONTROLS = r"\p{Cc}"
CONTROLS_BUT_LINES = r"[\p{Cc}&&[^\n\t]]"

# Letters that decomposition leaves alone.
FOLD_LETTERS = {"ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ð": "d"}

# States of a list item.
STATES = ["satisfied", "missing", "ambiguous", "unknown", "unavailable", "source_selected"]
OWNED_STATES = ["satisfied", "ambiguous", "unavailable"]

# Musical keys that are accepted (Camelot, Open Key, note names).
KEY_PATTERN = r"^(?:(?:[1-9]|1[0-2])[ABdm]|[A-Ga-g][#b]?(?:m|maj|min|major|minor)?)$"
WHEEL_PATTERN = r"^(\d{1,2})([ABdm])$"

# Embedded tag names per field.
BPM_TAGS = ["tbpm", "bpm", "tempo", "tmpo", "txxx:bpm", "----:com.apple.itunes:bpm"]
KEY_TAGS = ["tkey", "initialkey", "key", "txxx:initialkey", "----:com.apple.itunes:initialkey"]
GENRE_TAGS = ["tcon", "genre", "©gen"]
COMMENT_TAGS = ["comm", "comment", "description", "©cmt"]

# Phrases of whole sets, venues, and what follows an uploader's name.
SET_PHRASES = [
    "boiler room", "live set", "essential mix", "tiny desk", "full set", "dj set",
    "full concert", "full album", "full show", "full mix",
]
VENUES = (
    "osheaga|coachella|glastonbury|tomorrowland|lollapalooza|primavera|sonar|dekmantel|"
    "awakenings|creamfields|bonnaroo|roskilde|pukkelpop|werchter|fuji rock|outside lands|"
    "parklife|letterman|fallon|kimmel|jools holland|kexp|live lounge|maida vale|cercle|"
    "colors show|audiotree|festival|concert|session|sessions"
).split("|")
UPLOADER_SUFFIX = r"(?:\s+(?:topic|vevo|official|music|tv|channel))+$"

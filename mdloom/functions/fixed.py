"""Lists, limits and formats that decide results and are kept as plain data."""

# --- limits -----------------------------------------------------------------------------------
MAX_INPUT_BYTES = 50 * 1024 * 1024
MAX_MARKDOWN_BYTES = 16 * 1024 * 1024
MAX_REPORT_CHARACTERS = 64 * 1024
MAX_QUARANTINE_CHARACTERS = 1024 * 1024
MAX_ARCHIVE_ENTRIES = 1_000
MAX_EXPANDED_BYTES = 256 * 1024 * 1024
MAX_COMPRESSION_RATIO = 200
LINE_LENGTH = 120
MAX_ATTEMPTS = 5
DEBOUNCE_SECONDS = 1
RETRY_SECONDS = 10
IDLE_SECONDS = 30
TRUNCATION_LINE = "Diagnóstico truncado"
DEFAULT_TITLE = "Document"

# --- file types -------------------------------------------------------------------------------
BLOCKED_MEDIA_SUFFIXES = (
    ".aac", ".avi", ".flac", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".ogg", ".wav", ".webm", ".wma",
)
SUPPORTED_SUFFIXES = (
    ".bmp", ".csv", ".docx", ".epub", ".gif", ".htm", ".html", ".jpeg", ".jpg", ".json", ".md",
    ".markdown", ".msg", ".pdf", ".png", ".pptx", ".rtf", ".tif", ".tiff", ".txt", ".webp", ".xls",
    ".xlsx", ".xml", ".zip",
)
ZIP_SUFFIXES = (".docx", ".epub", ".odp", ".ods", ".odt", ".pptx", ".xlsx", ".zip")
ARCHIVE_PLUMBING_NAMES = (".rels", "mimetype")
ARCHIVE_PLUMBING_SUFFIX = ".rels"

# Suffix -> converter family; a supported suffix in no family has no converter here.
FORMAT_SUFFIXES = {
    "text": (".txt", ".md", ".markdown", ".json", ".xml", ".rtf"),
    "html": (".htm", ".html"),
    "csv": (".csv",),
    "bundle": (".zip", ".epub"),
}

# --- media signatures, as upper-case hex of the first bytes ------------------------------------
MEDIA_PREFIXES_HEX = (
    "4F676753",  # OggS
    "664C6143",  # fLaC
    "494433",    # ID3
    "1A45DFA3",  # Matroska / WebM
    "000001BA",  # MPEG program stream
    "000001B3",  # MPEG video
    "3026B275",  # ASF
)
RIFF_HEX, RIFF_KINDS_HEX = "52494646", ("57415645", "41564920")  # RIFF; WAVE, "AVI "
FORM_HEX, FORM_KINDS_HEX = "464F524D", ("41494646", "41494643")  # FORM; AIFF, AIFC
FTYP_HEX = "66747970"

# --- named character references decoded by the HTML converter ----------------------------------
# &lt; and &gt; stay encoded so that text cannot turn into inline HTML; &amp; is decoded last.
NAMED_ENTITIES = {
    "&nbsp;": "\u00a0", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&bull;": "•",
    "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&laquo;": "«", "&raquo;": "»",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&euro;": "€",
    "&trade;": "™", "&times;": "×", "&deg;": "°", "&apos;": "'", "&quot;": '"',
}

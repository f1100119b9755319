"""Values that results depend on: word lists, texts, constants and formats."""

# Feeds.
FORUM_PLATFORM = "Dcard"
FORUM_POST_URL = "https://www.dcard.tw/f/%s/p/%s"
LISTING_PLATFORM = "Reddit"
LISTING_URL_PREFIX = "https://www.reddit.com"
LISTING_CHANNEL_PREFIX = "r/"
ATOM_PLATFORM = "App Store"
TRANSCRIPT_PLATFORM = "Transcript Feed"
KIND_POST = "post"
KIND_REVIEW = "review"
KIND_TRANSCRIPT = "transcript"

# Default keywords of each feed kind.
FORUM_KEYWORDS = ["求救", "有人也這樣嗎", "手動", "好累", "卡住", "崩潰"]
LISTING_KEYWORDS = ["manual", "spreadsheet", "frustrated", "pain", "workaround", "too slow"]
ATOM_KEYWORDS = ["slow", "expensive", "subscription", "too many features"]
TRANSCRIPT_KEYWORDS = ["copy paste", "manual", "workflow", "hack", "spreadsheet"]

# Clustering.
STOP_WORDS = [
    "a", "an", "and", "app", "are", "but", "for", "from",
    "get", "how", "into", "not", "that", "the", "their", "there",
    "they", "this", "too", "use", "users", "using", "with",
    "一直", "有人", "也", "太", "真的", "感覺", "現在", "這樣",
    "求救", "請問", "就是", "那個", "好像", "有點", "問題",
]
NOISE_PHRASES = [
    "有人也這樣嗎", "請問一下", "真的很", "到底要怎麼", "怎麼辦", "求救", "help me",
    "does anyone else", "anyone else", "i hate", "too many", "so many",
]
LABEL_LENGTH = 120
LATIN_TOKENS = 5
HAN_TOKENS = 5
KEYWORD_TOKENS = 3
FALLBACK_KEY_LENGTH = 16
UNCATEGORIZED = "uncategorized"

# Rule scorer.
MANUAL_WORDS = ["manual", "手動", "copy paste"]
SHEET_WORDS = ["spreadsheet", "excel"]
STRAIN_WORDS = ["slow", "好累", "too many features"]
PHYSICAL_WORDS = ["hardware", "door", "配送"]
EXPLICIT_SIGNALS = [
    "nsfw", "porn", "escort", "drug", "scam", "illegal", "裸體", "毒品", "詐騙", "成人",
]
WORKAROUND_DEFAULT = "Users are piecing together manual steps, generic tools, or ad-hoc habits."
WORKAROUND_MANUAL = (
    "Users are handling the task manually, often with copy-paste, spreadsheets, or repeated clicks."
)
FEASIBILITY_HIGH = "High: likely solvable with software automation and workflow design."
FEASIBILITY_MEDIUM = (
    "Medium: software can help, but operations or hardware may still be involved."
)
PAIN_POINT_DEFAULT = (
    "Users are struggling with a repetitive workflow that current tools do not handle well."
)
BASE_SCORE = 5
MAX_SCORE = 10
HEURISTIC_MODEL = "mock:heuristic"
SENTENCE_MARKS = ".!?。！？"
SENTENCE_BYTES = 140

# Defaults for texts a model left out.
MODEL_PAIN_POINT = (
    "The source describes a frustrating workflow that existing tools are not solving cleanly."
)
MODEL_WORKAROUND = "Users are relying on manual steps or generic tools as a workaround."
MODEL_FEASIBILITY = "Needs validation."

# Prompt given to a model, fields in the order they are filled in.
PROMPT_FIELDS = ["platform", "channel", "content_kind", "title", "author", "url", "content"]
PROMPT_TEMPLATE = """你現在是一個資深 SaaS 產品經理。請分析以下文本，並嚴格輸出 JSON。

你要輸出的 JSON keys 只能有：
- core_pain_point
- current_workaround
- commercial_potential
- saas_feasibility
- is_explicit_content

分析標準：
1. 識別核心痛點：用戶實際在抱怨什麼？
2. 判斷目前 workaround：使用者現在如何笨拙地撐過去？
3. 商業化潛力 1-10：依市場規模、痛感強度、解法清晰度評分。
4. SaaS 實作可行性：請用一句話說明是否適合軟體化，若需要硬體或實體服務也要直接說。
5. 合規檢查：若涉及色情、未成年、暴力、毒品、詐騙、非法交易等內容，is_explicit_content 設為 true。

來源資訊：
platform: %s
channel: %s
content_kind: %s
title: %s
author: %s
url: %s

文本內容：
%s"""

# Token hash (FNV-1a, 64 bits) and vector sizes.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
EMBEDDING_DIMS = 256
MIN_EMBEDDING_DIMS = 32

# Limits and windows.
DEFAULT_LIMIT = 20
MAX_LIMIT = 200
DEFAULT_WINDOW_HOURS = 24
LATEST_LIMIT = 50
TREND_LIMIT = 12
TREND_WINDOW_HOURS = 168
SEARCH_LIMIT = 8
LIVE_FEED_SIZE = 60
SAMPLES_PER_CLUSTER = 3
DEDUP_TTL_SECONDS = 7 * 24 * 3600
BATCH_PER_FEED = 20

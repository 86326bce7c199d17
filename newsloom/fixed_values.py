"""Texts and limits that results have to carry exactly.

Every one of them is the default of some argument, so a caller with another
language or taxonomy passes their own.
"""

# The article taxonomy.
CATEGORIES = ("政治", "經濟", "社會", "科技", "娛樂", "體育", "國際", "生活", "健康")

# Labels that stand in for a category when a whole batch failed.
JSON_PARSE_ERROR = "JSON_Parse_Error"
API_ERROR = "API_Error"
FAILURE_LABELS = (JSON_PARSE_ERROR, API_ERROR)

# Classifier input text.
TITLE_PREFIX = "標題："
SUMMARY_PREFIX = "摘要："
PART_SEPARATOR = "; "
NO_TEXT = "無資料"

# Classification batches.
BATCH_SIZE = 15
ATTEMPTS = 3
PAUSE_SECONDS = 5.0

# Chunking.
SENTENCE_DELIMITERS = "[。！？]"
SENTENCE_TERMINATOR = "。"
MAX_LENGTH = 300
OVERLAP = 50
NO_CONTENT = "no_content"

# Rows taken per scheduled run.
CLASSIFY_LIMIT = 30
EMBED_LIMIT = 50

# Search.
EMBEDDING_DIM = 1024
TOP_K = 5
MAX_FULL_ARTICLES = 2

# Answers given without, or in spite of, the model.
NO_HITS_SUMMARY = "根據目前的新聞內容，無法準確回答此問題。"
EMPTY_ANSWER_SUMMARY = "很抱歉，我無法處理您的請求，請稍後再試。"
BAD_JSON_SUMMARY = "很抱歉，模型返回了無法解析的資料。請稍後再試。"
CALL_ERROR_SUMMARY = "很抱歉，與模型通訊時發生錯誤。請稍後再試。"

# Answer rendering.
REFERENCE_HEADING = "\n\n**參考資料：**\n"
UNKNOWN_TITLE = "未知標題"
UNKNOWN_PUBLISHER = "未知來源"
UNKNOWN_LINK = "#"

# Trend report.
ALL_TIME = "所有時間"
TREND_SENTENCE = "%d was published from %s to %s."
TREND_LIMIT = 5

# Page layout.
CONTAINER_TAG = "div"
CONTAINER_CLASS = "atoms"

"""Word lists, prefixes, patterns and thresholds that results depend on.

These values must equal the ones the source data was produced with, so they are
stated once, as text. Patterns stay inside the regex subset shared by Java and RE2
unless noted.
"""

from __future__ import annotations

WHITESPACE = " \t\n\r\x0b\x0c"

# --- delivery markers -------------------------------------------------------
TS_PREFIX = (
    r"\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\d{4}-\d{2}-\d{2}\s+\d{1,2}:\d{2}\s+GMT[+-]\d+\]\s*"
)
MESSAGE_ID_MARK = r"\[message_id:\s*[^\]]+\]\s*"
REPLY_MARK = "[[reply_to_current]]"
UNTRUSTED_WRAPPER = (
    r"(?s)(?:Sender|Conversation info) \(untrusted metadata\):\s*```json\s*\{.*?\}\s*```\s*"
)
PRIVATE_USE = "[\ue000-\uf8ff]"
CRON_BRACKET = r"^\[cron[:\[]"

# --- machine text -----------------------------------------------------------
AUTOMATION_PREFIXES = (
    "[IMPORTANT: You are running as a scheduled cron job",
    "[Your active task list was preserved across",
    "[IMPORTANT: Background process ",
    "You've reached the maximum number of tool-call",
    "Review transcript for durable skill updates.",
    "[SILENT]",
    "ANNOUNCE_SKIP",
    "Operation interrupted",
    "[ASYNC DELEGATION BATCH COMPLETE",
    "[STILL IN PROGRESS —",
    "You just executed tool calls",
    "Your previous final response was rejected",
    "[Retry after",
    "[System:",
    "[IMPORTANT: Watch patterns disabled",
    "[IMPORTANT: 3 background subagent delegations completed",
    "[This response was interrupted by a user",
    "[assistant turn failed before producing",
    "[media attached:",
    "[The user attached an image:",
    "[Background process ",
    "[IMPORTANT: ",
    "[Bootstrap pending]",
    "[User sent media without caption]",
    "[The user sent an image",
    "[The user sent a document:",
    "[assistant reasoning omitted",
    "[chat.history omitted",
    "[hooks]",
    "[memory-context]",
    "[/plan ",
)
SUBAGENT_ANYWHERE = (
    r"Subagent Context|You are running as a subagent|ASYNC DELEGATION"
    r"|OPENCLAW_INTERNAL_CONTEXT|BEGIN_OPENCLAW_INTERNAL_CONTEXT"
    r"|Inter-session message|Agent-to-agent|auto-cron"
)
INJECTION_HEAD = (
    r"^\[?(?:\d{1,2}\s+\w{3}\s+\d{4}|\w{3}\s+\d{1,2}|\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2})?"
    r"\s*\]?\s*\[(?:IMPORTANT|ASYNC DELEGATION|Subagent Context|OUT-OF-BAND|【IMPORTANT|【ASYNC)"
)
SYSTEM_INJECT_HEAD = (
    r"(?i)^(?:Continue where you left off|Write a dream diary entry"
    r"|Agent-to-agent|You are running as a subagent"
    r"|Record a memory fragment|Read HEARTBEAT|Generate a daily summary"
    r"|This is an automated|System:|System \(untrusted\)|\[System:"
    r"|\[SYSTEM\]|\[CONTEXT COMPACTION|NO_REPLY"
    r"|\[Startup context loaded by runtime|\[Queued messages while agent was busy"
    r"|assistant turn failed before producing content)"
)
HEARTBEAT_ANYWHERE = r"(?i)HEARTBEAT"
HEARTBEAT_WHOLE = r"^[（(\[]?心跳[)）\]!！。.…]*$"
IMAGE_DESCRIPTION = r"(?i)\[The user attached an image|Detailed Description|This image shows"
MACHINE_ROLES = ("system", "tool", "function", "tool_call", "tool_result")
CONTROL_JSON_KEYS = (
    "action", "tool", "function", "tool_calls", "args", "arguments",
    "result", "status", "ok", "error", "reason", "reply",
)
COMPACTION_HEAD = r"^\[(?:PRIOR CONTEXT|CONTEXT COMPACTION|END OF PRIOR CONTEXT|STILL IN PROGRESS)"
DUMP_PREFIXES = ('{"version":', '{"last_check":', "# Session Corpus:", "# USER.md", "@file:")
DUMP_MARKERS = ('"processed_files":',)
MAX_QUESTION_CHARS = 100_000
DUMP_HEAD_CHARS = 2000
MACHINE_SESSION_SOURCES = (
    "tool", "cron", "oneshot", "subagent", "api_server", "kanban",
    "p0-phase23", "p0-phase23-scoped",
)
EXCLUDED_DISPLAY_KINDS = (
    "hidden", "auto_continue", "async_delegation_complete",
    "process_complete", "model_switch", "failed_turn",
)
SYSTEM_TEXT_PREFIXES = ("[CONTEXT COMPACTION", "[System note:")

# --- shells around human text ----------------------------------------------
OOB_OPEN = "[OUT-OF-BAND USER MESSAGE"
OOB_CLOSE = "[/OUT-OF-BAND USER MESSAGE]"
OOB_BODY = (
    r"(?s)\[OUT-OF-BAND USER MESSAGE[^\]]*\]\s*(.*?)\s*(?:\[/OUT-OF-BAND USER MESSAGE\]|\z)"
)
GOAL_OPEN = "[Continuing toward your standing goal"
GOAL_BODY = (
    r"(?s)\[Continuing toward your standing goal\]\s*Goal:\s*(.*?)\s*Continue working toward this goal"
)
SKILL_OPEN = "[IMPORTANT: The user has invoked the"
SKILL_BODY = (
    r"(?s)The user has provided the following instruction alongside the skill invocation:\s*(.+)$"
)

# --- host event kinds -------------------------------------------------------
TERMINAL_DISPLAY_KINDS = ("failed_turn", "hidden")
TERMINAL_PREFIXES = (
    "Operation interrupted",
    "[This response was interrupted by a user correction.",
)
REAL_USER_DISPLAY_KINDS = ("steer",)
CONTINUATION_PREFIXES = (
    "[CONTEXT COMPACTION",
    "[Your active task list was preserved across context compression",
    "[STILL IN PROGRESS",
    "[System note: Your previous turn was interrupted mid-run",
)
ASYNC_PREFIXES = ("[ASYNC DELEGATION", "[IMPORTANT: Background process")
ASYNC_NUMBERED = (
    r"^\[IMPORTANT:\s+\d+\s+background\s+(?:processes|subagent\s+delegations)\b"
)
ASYNC_DISPLAY_KINDS = ("async_delegation_complete", "process_complete")
NEW_ROOT_PREFIXES = (
    "[IMPORTANT: You are running as a scheduled cron job",
    "[IMPORTANT: The user has invoked the",
    "[cron:",
)
CONTROL_PREFIXES = (
    "[System:",
    "[System note:",
    "[System]",
    "[System ",
    "You just executed tool calls",
    "You've reached the maximum number of tool-calling",
    "Your previous final response was rejected",
    "[Subagent Context]",
    "[AGENT_RULES",
    "[Retry after",
    "[IMPORTANT",
)
FULLWIDTH_PREFIXES = ("【IMPORTANT", "【ASYNC")
TITLE_GENERATION_HEAD = "### Task:"
TITLE_GENERATION_MARK = "Suggest 3-5 relevant follow-up questions"
TIME_WRAPPER_BODY = (
    r"\d{1,2}\s+\w{3}\s+\d{4}(?:\s+\d{1,2}:\d{2})?(?:\s+GMT[+-]\d+)?"
    r"|\w{3}\s+\d{4}-\d{2}-\d{2}(?:\s+\d{1,2}:\d{2})?(?:\s+GMT[+-]\d+)?"
    r"|\w{3}\s+\d{1,2}(?:\s+\d{1,2}:\d{2})?"
    r"|\d{1,2}:\d{2}"
    r"|\d{4}-\d{2}-\d{2}"
)
BOUNDARY_KINDS = ("ASYNC_BOUNDARY", "NEW_ROOT")

# --- importable question/answer ---------------------------------------------
IMPORT_INJECTION_HEAD = (
    r"^\s*\[?(?:\d{1,2}\s+\w{3}\s+\d{4}|\w{3}\s+\d{1,2}(?:st|nd|rd|th)?\s+\d{4}|"
    r"\w{3}\s+\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2})?"
    r"[^\]]*\]?\s*\[(?:IMPORTANT|ASYNC DELEGATION|Subagent Context|OUT-OF-BAND|【IMPORTANT|【ASYNC)"
)
IMPORT_INJECTION_PREFIXES = (
    "[IMPORTANT:", "[ASYNC DELEGATION", "[Subagent Context]", "[OUT-OF-BAND",
    "[Inter-session message]",
)
IMPORT_NOISE = ("maximum number of tool-calling iterations",)
TOOL_ONLY_ANSWER = "(tool call only)"

# --- redaction --------------------------------------------------------------
URL_USERINFO = r"([a-zA-Z][a-zA-Z0-9+.\-]*://)[^/@\s]+:[^/@\s]+@"
BEARER = r"(?i)\bbearer\s+([A-Za-z0-9._\-+/=]+)"
SECRET_PAIR = (
    r"(?i)\b(password|passwd|pwd|api[_-]?key|access[_-]?token|auth[_-]?token|"
    r"secret|token)\b\s*[:=]\s*([^\s,;'\"&)]+)"
)

# --- tokens and keywords ----------------------------------------------------
CJK_TOKEN_RUN = "[\u3400-\u4dbf\u4e00-\u9fff\ufa00-\ufaff]+"
CJK_BIGRAM_RUN = "[\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua97f]+"
CJK_BASIC_RUN = "[\u4e00-\u9fff]+"
TOKEN_SEPARATORS = r"[\s,;:.!?()\[\]{}<>/@#$%^&*+=~\"'|\-]+"
LATIN_KEYWORD = r"[a-zA-Z][a-zA-Z0-9_-]{2,}"
KEYWORD_STOPWORDS = tuple(
    "的 了 是 在 我 你 他 她 它 们 这 那 有 和 与 或 也 都 就 但 而 "
    "及 以 其 之 于 乃 矣 焉 者 哉 吗 呢 吧 啊 哦 嗯 哈 唉 "
    "as the and or but if then else for to of in on at by with from".split()
)
EXPANSION_STOPWORDS = tuple(
    "what does her as when who where how was were is are did have has do the a an and or of "
    "to in on at for with your you their they she he it its that this these those not his him "
    "our we can could would will been being about there why which than then from into out over "
    "again once here all any both each few more most other some such only own same so too very".split()
)
SIGNAL_WORDS = ("决策", "结论", "修复", "方案", "根因", "原因")
DETAIL_TRIGGERS = ("具体", "详细", "原文", "原话", "怎么说的", "之前那次", "具体怎么", "具体说")
RAW_DIALOGUE = r"(?:^|\n)(?:Q:|A:|用户:|助手:|User:|Assistant:|Human:)\s"
STATUS_MARK = r"〔[^〕]*(?:已实施|已验证|计划中|未完成|已推翻)[^〕]*〕"
ATTRIBUTION_MARK = r"\[(?:用户|建议|共同)\]"
DECISION_HEADING = "关键决策"
PROGRESS_HEADING = "进行中状态"
FACT_NORMALISE = r"[\s　，。、；：·\-—…“”‘’（）()\[\]【】\"']+"
FACT_CITATION = r"\[\s*#\s*(\d+)\s*\]"

# --- tasks ------------------------------------------------------------------
DELEGATION_ID = r"\bdeleg_([0-9a-f]{6,})\b"
CRON_IDS = (
    r"(?i)\[cron:([0-9a-f][0-9a-f-]{6,})",
    r"(?i)scheduled cron job\s*\(?job id\s+([0-9a-f][0-9a-f-]{6,})",
    r"(?i)job_id[\"'\s:=]+([0-9a-f][0-9a-f-]{6,})",
)
PROJECT_REF = r"(?i)\bproject[=:\s]+([A-Za-z0-9._-]{2,40})"
RECEIPT = r"(?i)\[ASYNC DELEGATION BATCH COMPLETE\s*[—\-]\s*(deleg_[0-9a-f]{6,})\]"
DISPATCHED = r"Dispatched:\s*(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2}:\d{2})"
TASK_LINE = (
    r"(?s)(?:✓|✗|✔|×)\s*TASK\s+(\d+)\s*/\s*(\d+)\s*:\s*(.*?)\s*\(status=([A-Za-z_]+)([^)]*)\)"
)
TASK_OUTCOME = {
    "completed": "completed", "done": "completed", "failed": "failed",
    "error": "failed", "timeout": "failed", "cancelled": "failed",
}
TASK_STATUS = {
    "created": "open", "requirement": "open", "progress": "running",
    "completed": "claimed_done", "failed": "failed", "corrected": "open", "blocked": "blocked",
}

# --- retrieval --------------------------------------------------------------
RRF_K = 60
PATH_WEIGHTS = {
    "keyword": 0.5, "qa_keyword": 1.0, "qa_vector": 1.0, "vector": 1.0,
    "message_vector": 1.0, "effective_vector": 1.0, "topic_vector": 2.0,
    "paragraph_vector": 1.0, "note_vector": 1.0,
}
LANE_OF_KIND = {
    "keyword": "keyword", "qa": "qa", "topic": "topic", "message": "vector",
    "effective": "vector", "paragraph": "vector", "note": "vector",
    "assistant_delivery": "qa", "memory": "explicit",
}
DECAY_DAYS = 30.0
DECAY_FLOOR = 0.05
RARE_BONUS = 0.08
EXACT_BOOST = 0.5

# --- affinity ---------------------------------------------------------------
AFFINITY_LEVELS = ((60, "暗"), (200, "烛火"), (400, "灯"), (700, "焰"), (1000, "昼"))

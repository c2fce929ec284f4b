"""Line patterns of examination papers, as Java regular expressions.

``(?U)`` makes \\s and \\d cover Unicode (full-width digits, U+3000), ``(?d)`` makes line feed the only line end.
"""

from __future__ import annotations

FLAGS = "(?Ud)"
DOT = r"[.、．]"

# Header words with the type they set, in order.
HEADER_TYPES = {
    "选择题": "single_choice",
    "单选题": "single_choice",
    "多选题": "multiple_choice",
    "填空题": "fill_blank",
    "判断题": "true_false",
    "简答题": "short_answer",
    "计算题": "calculation",
    "证明题": "proof",
    "解答题": "calculation",
    "综合题": "comprehensive",
    "应用题": "calculation",
}
# Section markers at the start of a line, and those anywhere on a one-line text.
MARKERS = ("参考答案", "答案与解析", "答案解析", "试题解析", "详细解析", "【参考答案】", "【答案与解析】")
MARKERS_ANYWHERE = ("参考答案", "答案与解析")
# What introduces an answer, an analysis and a score, in order of precedence.
ANSWER_LEADS = ("【答案】", "答案[：:]", "参考答案[：:]", "正确答案[：:]")
ANALYSIS_LEADS = ("【解析】", "解析[：:]", "【分析】", "分析[：:]", "【解答】")
SCORES = (r"[\(（](\d+)\s*分[\)）]", r"(\d+)\s*分", r"共\s*(\d+)\s*分")
# A question's text ends at the first of each of these, tried in order.
CUT_WORDS = ("【答案】", "答案：", "答案:", "参考答案：", "参考答案:", "正确答案：", "正确答案:", "【解析】", "解析：", "解析:", "【分析】", "分析：", "分析:", "【解答】", "解答：", "解答:")
# Tags whose tail is an analysis in the answer section, and the start of lines left out there.
ANALYSIS_TAGS = ("【分析】", "【解析】", "【详解】")
SKIPPED_START = "故选"

HEADER = rf"{FLAGS}^[一二三四五六七八九十]+{DOT}\s*({'|'.join(HEADER_TYPES)})"
MARKER = rf"{FLAGS}^(?:{'|'.join(MARKERS)})|^.*(?:{'|'.join(MARKERS_ANYWHERE)}).*$"
NUMBER = rf"{FLAGS}^\s*(\d+)\s*{DOT}\s*"
OPTION = rf"{FLAGS}([A-H])\s*{DOT}\s*"


def lead(start: str) -> str:
    """Text after ``start``, at least one character, up to the next 【 or the end."""
    return rf"(?Uds){start}\s*(.+?)(?=【|$)"


# Question numbers and section headers of older papers, in order of precedence.
LEGACY_NUMBERS = (
    r"^\s*(\d+)\s*[.、．,，:：]\s*",
    r"^\s*[(（](\d+)[)）]\s*",
    r"^\s*(\d+)\s*\)\s*",
    r"^\s*第\s*(\d+)\s*题",
    r"^\s*Question\s*(\d+)",
    r"^\s*Q(\d+)",
)
LEGACY_HEADERS = (
    rf"^[一二三四五六七八九十]+[、.]\s*({'|'.join(HEADER_TYPES)})",
    r"^Part\s*[A-D]\s*[:：]?\s*(选择题|单选题|多选题|填空题)",
    r"^(选择题|单选题|多选题|填空题)\s*[(（][^)）]*[)）]",
)

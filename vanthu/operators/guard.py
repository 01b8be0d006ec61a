"""Batch guard and intent routing of questions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Patterns of the three kinds of threat, tried in this order.
JAILBREAK = [
    r"\bignore\s+(previous|all|your)\s+instructions?\b", r"\bforget\s+(your|all|previous)\b", r"\bact\s+as\b", r"\bpretend\s+(you\s+are|to\s+be)\b",
    r"\bdeveloper\s+mode\b", r"\bdan\b", r"\bsudo\b", r"\boverride\b", r"\bjailbreak\b", r"bỏ\s+qua\s+quy\s+tắc", r"bỏ\s+qua\s+hướng\s+dẫn",
    r"bỏ\s+qua\s+tất\s+cả", r"không\s+cần\s+trích\s+dẫn", r"đóng\s+vai\s+(luật\s+sư|thẩm\s+phán|chuyên\s+gia)", r"tiết\s+lộ\s+system\s+prompt",
    r"in\s+lại\s+system\s+prompt", r"cho\s+tôi\s+biết\s+(cấu\s+hình|prompt\s+hệ\s+thống)", r"AI[,:]?\s*(hãy|vui\s+lòng)?\s*bỏ\s+qua", r"\[SYSTEM\]", r"<system>",
]
CONFIRMATION = [
    r"(điều\s+\w+|khoản\s+\w+).*(quy\s+định|nêu\s+rõ|ghi\s+là).*(xác\s+nhận|đúng\s+không|phải\s+không)",
    r"(tôi\s+biết|tôi\s+hiểu).*(xác\s+nhận|confirm)\s+(giúp|cho)\s+tôi",
    r"xác\s+nhận\s+(giúp|hộ|cho)\s+tôi.*điều\s+\w+",
]
LEAK = [
    r"(system\s+prompt|system\s+instruction|cấu\s+hình\s+hệ\s+thống)",
    r"(bạn\s+được\s+lập\s+trình|bạn\s+hoạt\s+động\s+như\s+thế\s+nào)",
    r"(print|show|display|reveal).*(system|prompt|instruction)",
]
# Patterns of the intents.
SMALL_TALK = [
    r"\bxin\s+chào\b", r"\bchào\s+(bạn|anh|chị|em)\b", r"\bhello\b", r"\bhi\b", r"\bcảm\s+ơn\b", r"\bthank\b", r"\btạm\s+biệt\b", r"\bbye\b", r"\bgoodbye\b",
    r"\bbạn\s+(có\s+khỏe|tên\s+là|là\s+ai|làm\s+gì)\b", r"\bhôm\s+nay\s+thế\s+nào\b", r"\bgiới\s+thiệu\s+(về\s+)?bản\s+thân\b",
]
OUT_OF_SCOPE = [
    r"\bcode\b", r"\bpython\b", r"\bjavascript\b", r"\bsql\b", r"\blập\s+trình\b", r"\bchữa\s+bệnh\b", r"\bthuốc\s+gì\b", r"\bbác\s+sĩ\b", r"\bnấu\s+ăn\b",
    r"\bcông\s+thức\s+nấu\b", r"\bbóng\s+đá\b", r"\bkết\s+quả\s+(trận|bóng)\b", r"\bthời\s+tiết\b", r"\bdu\s+lịch\b.*\bnên\s+đi\b", r"\bdịch\s+(sang|qua)\s+(tiếng\s+(anh|nhật|hàn|trung))\b",
]
LEGAL = [
    r"\bpháp\s+luật\b", r"\bquy\s+định\b", r"\bnghị\s+định\b", r"\bthông\s+tư\b", r"\bluật\b", r"\bđiều\s+\d+\b", r"\bkhoản\b", r"\bxử\s+phạt\b", r"\bvi\s+phạm\b",
    r"\bhợp\s+đồng\b", r"\btòa\s+án\b", r"\bkhiếu\s+nại\b", r"\btố\s+cáo\b", r"\bquyền\b", r"\bnghĩa\s+vụ\b", r"\bchế\s+tài\b", r"\bmức\s+phạt\b", r"\bgiấy\s+phép\b", r"\bđăng\s+ký\b", r"\bthủ\s+tục\b",
]
# Canned answers.
ANSWERS = {
    "leak": "Tôi là hệ thống tra cứu pháp luật Việt Nam. Tôi không thể chia sẻ thông tin cấu hình hệ thống.",
    "blocked": "Tôi không tìm thấy căn cứ pháp lý phù hợp trong cơ sở dữ liệu hiện tại để trả lời câu hỏi này.",
    "small_talk": "Xin chào! Tôi là hệ thống tra cứu pháp luật Việt Nam. Bạn cần tra cứu vấn đề pháp luật nào?",
    "out_of_scope": "Xin lỗi, tôi chỉ hỗ trợ tra cứu pháp luật Việt Nam. Vui lòng đặt câu hỏi liên quan đến quy định pháp luật.",
    "nothing_found": "Không tìm thấy quy định pháp luật liên quan trong cơ sở dữ liệu. Vui lòng thử diễn đạt lại câu hỏi hoặc sử dụng từ khóa cụ thể hơn.",
}
# Questions offered to a user.
SUGGESTED = [
    "Điều kiện chuyển nhượng quyền sử dụng đất?", "Thủ tục thành lập doanh nghiệp theo quy định mới nhất?", "Quy định về thời giờ làm việc, nghỉ ngơi?",
    "Điều kiện cấp giấy phép xây dựng?", "Quy định xử phạt vi phạm giao thông?", "Thuế thu nhập cá nhân áp dụng cho lương?",
]


def _any(c: Column, patterns: list[str]) -> Column:
    return F.rlike(c, F.lit("(?iuU)" + "|".join(patterns)))


def threat(c: Column) -> Column:
    return F.when(_any(c, JAILBREAK), "jailbreak").when(_any(c, CONFIRMATION), "confirmation_attack").when(_any(c, LEAK), "leak")


def intent(c: Column) -> Column:
    """small_talk, out_of_scope or rag; words of the law come first, small talk has at most fifteen words."""
    from vanthu.functions.text import token_count

    short = F.coalesce(F.length(F.trim(c)) < 3, F.lit(True))
    return F.when(short, "small_talk").when(_any(c, LEGAL), "rag").when(_any(c, SMALL_TALK) & (token_count(c) <= 15), "small_talk").when(_any(c, OUT_OF_SCOPE), "out_of_scope").otherwise("rag")


def route(questions: DataFrame, col: str = "question") -> DataFrame:
    """``questions`` with threat, intent and the canned answer (null where the retrieval chain answers)."""
    t = questions.withColumn("threat", threat(F.col(col)))
    t = t.withColumn("intent", F.when(F.col("threat").isNotNull(), "blocked").otherwise(intent(F.col(col))))
    answer = F.when(F.col("threat") == "leak", ANSWERS["leak"]).when(F.col("intent") == "blocked", ANSWERS["blocked"]).when(F.col("intent") == "small_talk", ANSWERS["small_talk"]).when(F.col("intent") == "out_of_scope", ANSWERS["out_of_scope"])
    return t.withColumn("answer", answer)

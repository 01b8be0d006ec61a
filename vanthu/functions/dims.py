"""Fixed dimension values: document types with their rank, status factors, icons and labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Type code, rank of legal force (15 highest), display label.
HIERARCHY = [
    ("hien_phap", 15, "HIẾN PHÁP"), ("luat", 14, "LUẬT"), ("bo_luat", 14, "BỘ LUẬT"), ("nghi_quyet_qh", 14, "NQ QUỐC HỘI"),
    ("phap_lenh", 13, "PHÁP LỆNH"), ("nghi_quyet_ubtvqh", 13, "NQ UBTVQH"), ("lenh", 12, "LỆNH CTN"), ("quyet_dinh_ctn", 12, "QĐ CHỦ TỊCH NƯỚC"),
    ("nghi_dinh", 11, "NGHỊ ĐỊNH"), ("quyet_dinh_ttg", 10, "QĐ THỦ TƯỚNG"), ("nghi_quyet_hdtp", 9, "NQ HĐTP TAND TC"), ("an_le", 9, "ÁN LỆ"),
    ("thong_tu", 8, "THÔNG TƯ"), ("nghi_quyet_hdnd_tinh", 7, "NQ HĐND TỈNH"), ("nghi_quyet", 7, "NGHỊ QUYẾT"), ("quyet_dinh_ubnd_tinh", 6, "QĐ UBND TỈNH"),
    ("quyet_dinh", 6, "QUYẾT ĐỊNH"), ("chi_thi", 6, "CHỈ THỊ"), ("vban_qppl_dac_biet", 5, "VB QPPL ĐP ĐB"), ("nghi_quyet_hdnd_huyen", 4, "NQ HĐND HUYỆN"),
    ("quyet_dinh_ubnd_huyen", 3, "QĐ UBND HUYỆN"), ("cong_van", 3, "CÔNG VĂN"), ("nghi_quyet_hdnd_xa", 2, "NQ HĐND XÃ"), ("quyet_dinh_ubnd_xa", 1, "QĐ UBND XÃ"),
]
# Status factors and icons.
STATUS_FACTOR = {"con_hieu_luc": 2.0, "chua_co_hieu_luc": 1.5, "het_hieu_luc_mot_phan": 1.0, "het_hieu_luc": 0.3}
STATUS_ICON = {"con_hieu_luc": "🟢", "chua_co_hieu_luc": "🔵", "het_hieu_luc_mot_phan": "🟡", "het_hieu_luc": "🔴"}
# Fusion constant and leg weights (BM25, vector) by search mode.
RRF_K = 60
WEIGHTS = {"keyword": (0.8, 0.2), "semantic": (0.4, 0.6), "balanced": (0.5, 0.5)}
# Relation labels.
RELATION_LABEL = {"thay_the": "Thay thế", "sua_doi": "Sửa đổi, bổ sung", "huong_dan": "Hướng dẫn thi hành", "bai_bo": "Bãi bỏ", "vien_dan": "Viện dẫn", "dinh_chinh": "Đính chính"}
# Retrieval sizes of the answer chain.
RETRIEVE_K, CONTEXT_K, EXPAND_CAP, LEG_LIMIT, SCORE_THRESHOLD = 20, 5, 4, 200, 0.4


def lookup(values: dict, key: Column, default: Column) -> Column:
    """``values[key]`` as an expression of literals, ``default`` for null and unknown keys."""
    if not values:
        return default
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, F.coalesce(key, F.lit(""))), default)


def rank_of(doc_type: Column, default: int) -> Column:
    return lookup({c: r for c, r, _ in HIERARCHY}, doc_type, F.lit(default))


def label_of(doc_type: Column) -> Column:
    """The display label; an unknown type in capitals, no type as a plain document."""
    other = F.when(F.coalesce(doc_type, F.lit("")) == "", F.lit("VĂN BẢN")).otherwise(F.upper(doc_type))
    return lookup({c: n for c, _, n in HIERARCHY}, doc_type, other)


def status_factor(status: Column) -> Column:
    return lookup(STATUS_FACTOR, status, F.lit(1.0))


def status_icon(status: Column) -> Column:
    return lookup(STATUS_ICON, status, F.lit("⚪"))

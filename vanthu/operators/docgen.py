"""Draft documents from templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The variables of each template.
VARIABLES = {
    "don_khieu_nai": ["dia_danh", "ngay", "thang", "nam", "tieu_de_khieu_nai", "co_quan_kinh_gui", "nguoi_khieu_nai", "cccd", "cccd_ngay", "cccd_noi_cap", "dia_chi", "so_dien_thoai", "doi_tuong_khieu_nai", "noi_dung_su_viec", "can_cu_phap_ly", "ly_do_trai_phap_luat", "yeu_cau_chi_tiet", "tài_liệu_kèm_theo"],
    "cong_van_tra_loi": ["co_quan_ban_hanh", "so_cong_van", "ky_hieu", "nguoi_nhan", "dia_danh", "ngay", "thang", "nam", "ngay_nhan_don", "noi_dung_phản_anh", "can_cu_phap_ly", "noi_dung_dieu_luat", "giai_quyet_chi_tiet", "nguoi_ky"],
    "to_trinh_mau": ["co_quan_trinh", "dia_danh", "ngay", "thang", "nam", "noi_dung_trinh", "cap_tren_kinh_gui", "ly_do_trinh", "can_cu_phap_ly", "su_can_thiet", "de_xuat_1", "phuong_an_trien_khai", "kinh_phi_thoi_gian", "nguoi_trinh_ky"],
}


def defaults(kind: str, today) -> dict[str, str]:
    """Values of a template without a model: place and date, all others marked as not filled in."""
    out = {v: f"[Chưa điền {v}]" for v in VARIABLES.get(kind, [])}
    return out | {"dia_danh": "Hà Nội", "ngay": str(today.day), "thang": str(today.month), "nam": str(today.year)}


def render(template: Column, values: dict[str, str]) -> Column:
    """``template`` with {{ name }} and {{name}} replaced, in the order of ``values``."""
    for k, v in values.items():
        template = F.replace(F.replace(template, F.lit("{{ " + k + " }}"), F.lit(v)), F.lit("{{" + k + "}}"), F.lit(v))
    return template


def blocks(drafts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, n, style, align, size, text): the lines of a draft with their place in a word-processor file."""
    lines = drafts.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "raw")).withColumn("s", F.trim("raw"))
    s = F.col("s")
    head = lambda k: s.startswith("#" * k + " ")
    centred = s.contains("CỘNG HÒA XÃ HỘI") | s.contains("Độc lập - Tự do") | s.contains("ĐƠN KHIẾU NẠI") | s.contains("TỜ TRÌNH")
    bold = s.contains("ĐƠN KHIẾU NẠI") | s.contains("TỜ TRÌNH")
    dated = s.contains(", ngày") & s.contains("tháng") & s.contains("năm")
    marked = head(1) | head(2) | head(3) | s.startswith("- ") | (s == "---")
    style = F.when(head(1), "heading1").when(head(2), "heading2").when(head(3), "heading3").when(s.startswith("- "), "bullet").when(s == "---", "rule").otherwise("body")
    align = F.when(marked, "left").when(centred, "center").when(dated, "right").otherwise("left")
    size = F.when(head(1), 16).when(head(2), 14).when(head(3), 13).when(s == "---", 10).when(~marked & bold, 14).otherwise(13)
    rest = lambda k: F.substring(s, k, F.length(s))
    text = F.when(head(1), rest(3)).when(head(2), rest(4)).when(head(3), rest(5)).when(s.startswith("- "), rest(3)).when(s == "---", "—" * 30).otherwise(s)
    return lines.select(id_col, "n", style.alias("style"), align.alias("align"), size.alias("size"), text.alias("text"))

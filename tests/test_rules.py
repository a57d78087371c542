"""Import and concept rules by hand-made cases."""

from pyspark.sql import functions as F

from lexloom.functions import refs as R
from lexloom.operators import rewrite as Q


def test_issuer_and_type(spark):
    rows = [
        (1, "ỦY BAN THƯỜNG VỤ QUỐC HỘI\nNghị quyết", "a.txt"), (2, "Quốc hội khóa XV", "nd-12.txt"), (3, "x" * 4000 + "\nTM. CHÍNH PHỦ\nTHỦ TƯỚNG", "nq-3"), (4, "BỘ TRƯỞNG BỘ NỘI VỤ " + "x" * 4000, "tt-4"),
        (5, "ban chấp hành trung ương " + "x" * 4000, "qd-5"), (6, "", "bo-luat-lao-dong"), (7, None, "x"), (8, "CHÍNH PHỦ " + "x" * 4000 + "\n  Thông   tư \n", "x"), (9, "a\n THÔNG TƯ LIÊN TỊCH\nLỆNH\n chỉ thị", None),
    ]
    got = {r.i: (r.issuer, r.kind) for r in spark.createDataFrame(rows, "i int, c string, n string").select("i", R.issuer(F.col("c")).alias("issuer"), R.document_type(F.col("c"), F.col("n")).alias("kind")).collect()}
    assert got == {
        1: ("Ủy ban Thường vụ Quốc hội", "Nghị quyết"), 2: ("Quốc hội", "Nghị định"), 3: ("Chính phủ", "Nghị quyết"), 4: ("Bộ Nội vụ", "Thông tư"), 5: ("Ban Chấp hành Trung ương", "Quyết định"),
        6: ("", "Luật"), 7: ("", "Văn bản QPPL"), 8: ("Chính phủ", "Thông tư"), 9: ("", "Chỉ thị"),
    }


def test_sectors(spark):
    rows = [(1, "Tuyển dụng CÔNG CHỨC và bảo hiểm y tế", None), (2, "", "https://x/thanh-tra/1"), (3, None, ""), (4, "hội đồng nhân dân", "")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, c string, u string").select("i", R.sectors(F.col("c"), F.col("u")).alias("s")).collect()}
    assert len(R.SECTORS) == 15
    assert got == {1: ["Bảo hiểm xã hội", "Cán bộ, công chức"], 2: ["Thanh tra"], 3: ["Nội vụ (chung)"], 4: ["Chính quyền địa phương", "Hội, tổ chức phi chính phủ"]}


def test_concepts(spark):
    asked = ["co hieu luc khi nao", "tham quyen xu phat vi pham hanh chinh cua thanh tra", "nhiem vu quyen han", "gi do khac", ""]
    rows = {r.query: r for r in Q.rewrite(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "qid int, query string")).collect()}
    assert rows[asked[0]].concept_tags == ["hieu_luc_thi_hanh"] and rows[asked[0]].lexical_core.startswith("hieu luc thi hanh")
    assert rows[asked[1]].concept_tags == ["tham_quyen_xu_phat", "quyen_va_nghia_vu", "tham_quyen"] and "xu phat vi pham hanh chinh" in rows[asked[1]].title_anchor
    assert rows[asked[1]].concept_phrases[:4] == ["tham quyen xu phat", "xu phat vi pham hanh chinh", "nguoi co tham quyen", "quyet dinh xu phat"]
    assert rows[asked[2]].concept_tags == ["nhiem_vu_quyen_han", "quyen_va_nghia_vu"] and "chuc nang nhiem vu quyen han" in rows[asked[2]].concept_phrases
    assert rows[asked[3]].concept_tags == [] and rows[""].concept_phrases == []

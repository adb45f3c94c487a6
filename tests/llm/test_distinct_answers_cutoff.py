import numpy as np
import pytest

from lexforge.llm import answers, cutoff, distinct
from lexforge.runtime import table


def em(tf, background, weight, rounds):
    p = {t: n / sum(tf.values()) for t, n in tf.items()}
    for _ in range(rounds):
        e = {t: tf[t] * weight * p[t] / (weight * p[t] + (1 - weight) * background[t]) for t in tf}
        p = {t: v / sum(e.values()) for t, v in e.items()}
    return p


def test_em_matches_the_loop():
    rng = np.random.default_rng(1)
    record, tf, background, expected = [], [], [], []
    for n in range(20):
        terms = {i: int(rng.integers(1, 9)) for i in range(int(rng.integers(1, 30)))}
        b = {i: float(rng.random() / 50 + 1e-5) for i in terms}
        record += [n] * len(terms)
        tf += terms.values()
        background += b.values()
        expected += em(terms, b, distinct.OWN_WEIGHT, 400).values()
    got = distinct.own_probabilities(np.array(record), np.array(tf), np.array(background))
    assert np.allclose(got, expected, atol=2e-3)


RECORDS = "chunk_id string, terms array<struct<term string, tf int>>, listed boolean"


def records(spark):
    data = [("a", [("hiếm", 3), (".", 3)], True), ("b", [(".", 3), ("x", 1)], True), ("c", [(".", 9)], False), ("d", [], True), ("e", None, True), ("f", [(None, 3), ("y", 0)], True)]
    return spark.createDataFrame(data, RECORDS)


@pytest.mark.parametrize("terms", [distinct.BROADCAST_TERMS, 0])
def test_characteristic_terms(spark, terms):
    got = {(r["chunk_id"], r["term"]): r for r in distinct.characteristic(records(spark), broadcast_terms=terms).collect()}
    assert set(got) == {("a", "hiếm"), ("a", "."), ("b", "."), ("b", "x"), ("c", ".")}
    assert got["a", "hiếm"]["score"] > got["a", "."]["score"] and got["a", "hiếm"]["place"] == 1
    assert got["a", "."]["df"] == 2 and got["c", "."]["listed"] is False
    assert distinct.characteristic(records(spark).limit(0)).count() == 0
    few = distinct.characteristic(records(spark), 3, 1, terms).collect()
    assert [(r["chunk_id"], r["term"]) for r in few] == [("a", "hiếm")]


def test_p5_equals_sql(spark, small, rows):
    lists = table(spark, small, "indexed_documents").where("term_frequencies is not null").selectExpr("chunk_id", "inline(term_frequencies)").distinct()
    lists.createOrReplaceTempView("_lists")
    expected = spark.sql("select distinct chunk_id, term from _lists where tf >= 3 and term in (select term from _lists group by term having count(distinct chunk_id) <= 3)")
    assert rows(distinct.p5_found(spark, small)) == rows(expected)
    assert distinct.p5_scores(spark, small).where("not (score between 0 and 1)").count() == 0


Q = "Nhà máy Hoàn Mai vùng Ngạn Nhã ký sổ lao động với chủ kho bãi rồi, nếu muốn nộp phí neo đậu trước 36 giờ thì báo cho ai?"
SOUND = "Theo Điều 10 Nghị quyết 94/2032/TT-BT, bạn cần nộp phí neo đậu rồi mang biên lai đến gặp Sở Mặt nước để được hướng dẫn."


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), (" \n", "empty"), ("​", "empty"), ("[]", "empty"), ("Trả lời:", "empty"), ("FINAL_ANSWER:", "empty"), ("<p></p>", "empty"), ("```\n```", "empty"), ("null", "empty"), ("N/A", "empty"), ("(trống)", "empty"), ("—", "empty"),
        ("Xin lỗi, tôi không thể trả lời câu hỏi này.", "refusal"), ("I'm sorry, but I can't help with that request.", "refusal"), ("As an AI assistant I am unable to give legal advice.", "refusal"),
        ("Xin loi, toi khong the tra loi cau hoi nay.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"), ("К сожалению, я не могу ответить на этот вопрос.", "refusal"), ("Chưa đủ dữ liệu để kết luận. Bạn vui lòng liên hệ luật sư.", "refusal"),
        (Q, "copies_question"), (Q.lower(), "copies_question"), ("Câu hỏi: " + Q, "copies_question"), (Q + " " + Q, "copies_question"), (Q.replace("máy", "nào"), "copies_question"),
        ("According to Article 24, the stall tenant has to publish its tariff before the deadline.", "other_language"),
        ("Según el artículo 45, el arrendatario del muelle debe presentar la declaración en un plazo de 24 días.", "other_language"),
        ("Menurut Pasal 34, pemilik gudang wajib menyerahkan laporan dalam waktu 30 hari.", "other_language"),
        ("证书应当至少保存三个月，以备检查。", "other_language"),
        (SOUND, None), ("Không.", None), ("Không được phép.", None), ("7 ngày", None), ("5.560.000 đồng", None), ("Sở Mặt nước", None),
        ("Nhu vay khoan tien phai chuan bi roi vao khoang 36.200.000 dong, chua ke phan chenh neu lam tre so voi giay hen.", None),
        ("Bên vi phạm phải xin lỗi công khai và không thể viện cớ khi bến phải đóng cửa để né việc kê khai đâu.", None),
        (Q + " " + SOUND + " " + SOUND, None), ("Cơ quan giải đáp là Cục Kho bãi; họ từ chối hồ sơ khi thấy tờ khai tẩy xóa.", None),
    ],
)
def test_defects(answer, defect):
    assert answers.judge(Q, answer)[0] == defect


def test_operator_keeps_every_key(spark):
    data = [("question", "1", "gold", Q, None), ("prediction", "1", "m", None, Q), ("prediction", "2", "m", Q, SOUND), ("prediction", "3", "m", Q, "x" * 200_000)]
    df = spark.createDataFrame(data, "kind string, id string, method string, question string, answer string").selectExpr("*", "1 as defect", "2 as body")
    got = {(r["kind"], r["id"]): r["defect"] for r in answers.defects(df).collect()}
    assert got["question", "1"] == "empty" and got["prediction", "2"] is None and len(got) == 4
    assert answers.defects(df.limit(0)).count() == 0


def test_truncated_answers_are_found(spark):
    body = ["bạn cần nộp phí neo đậu tại quầy thu", "cơ quan trả kết quả trong thời hạn chung", "hồ sơ gồm tờ khai và biên lai gốc kèm theo", "người nộp giữ lại một bản để đối chiếu sau"]
    whole = [". ".join(body[i % 4 :] + body[: i % 4]).capitalize() + f". Số {i} được lưu lại." for i in range(60)]
    data = [("question", str(i), "gold", "Câu hỏi nào đó?", t) for i, t in enumerate(whole)]
    data += [("question", "cut1", "gold", "?", whole[0][:61]), ("question", "cut2", "gold", "?", whole[1][:80].rsplit(" ", 1)[0] + "\n(Hết trang)"), ("question", "ok", "gold", "?", "7 ngày")]
    df = spark.createDataFrame(data, "kind string, id string, method string, question string, answer string")
    got = {r["id"]: r["defect"] for r in answers.defects(df).collect()}
    assert {i for i, d in got.items() if d} == {"cut1", "cut2"} and got["cut1"] == got["cut2"] == "truncated"


def test_short_copies_and_answers_beside_a_refusal():
    assert answers.judge("Ai?", "Ai")[0] == "copies_question"
    assert answers.judge("Ai phải nộp thuế đất?", "nộp thuế đất?")[0] == "copies_question"
    assert answers.judge("Thu hồi giấy phép hay phạt tiền?", "Phạt tiền")[0] is None
    assert answers.judge("?", "Theo Điều 5, người lao động được nghỉ 12 ngày. Tôi không thể trả lời thêm.")[0] is None
    assert answers.judge("?", "Tôi không thể trả lời câu hỏi này. Mong bạn thông cảm.")[0] == "refusal"


def test_queries_run(spark, small):
    found = answers.p1_found(spark, small).collect()
    assert len(found) == len({tuple(r) for r in found}) > 0
    assert {r["defect"] for r in found} <= {"empty", "truncated", "refusal", "copies_question", "other_language"}
    q = table(spark, small, "legal_questions")
    withheld = q.where("split in ('public', 'private') and answer is null").select("id").distinct()
    assert not {r["id"] for r in found if r["kind"] == "question"} & {r["id"] for r in withheld.collect()}
    total = q.where("answer is not null or split not in ('public', 'private')").select("id").distinct().count() + table(spark, small, "predictions").select("id", "method").distinct().count()
    assert answers.p1_rates(spark, small).agg({"n": "sum"}).first()[0] == total


DOCS = "doc_id long, text string, source string"


def cuts(spark, texts):
    base = ["Cơ quan nhận đủ hồ sơ thì cấp phiếu hẹn. Người nộp phải trả mức phí 50.000 đồng cho mỗi lần nộp. Kết quả gửi về tận nơi.", "Danh sách:\n• Bản sao tờ khai\n• Bản chính biên lai"]
    data = [(i, base[1].replace(":", f" {i}:") if i % 2 else base[0] + f" Lần {i} đã xong.", "s") for i in range(60)]
    df = spark.createDataFrame(data + [(1000 + n, t, "s") for n, t in enumerate(texts)], DOCS)
    return {r["doc_id"] - 1000: r["cut"] for r in cutoff.cut_texts(df).collect() if r["doc_id"] >= 1000}


def test_kinds_of_cuts(spark):
    head = "Cơ quan nhận đủ hồ sơ thì cấp phiếu hẹn. "
    texts = [
        head + "Người nộp phải tr", head + "Người nộp phải trả mức phí 50.", head + "Người nộp phải", head + "Kết quả gửi về (", head + "Kết quả,", head + "\n2.", head + "\nb)", head + "Kết quả g�",
        head + "Người nộp phải trả (còn nữa)", head + "Người nộp […]", head.strip(), head + "(còn nữa)", head + "Xem thêm tại https://a.example/1", "Danh sách:\n• Bản sao tờ khai", head + "Sao lại thế?", None, "", " \n",
    ]
    got = cuts(spark, texts)
    assert all(got[n] for n in range(10)), got
    assert not any(got[n] for n in range(10, 15)), got
    assert not {15, 16, 17} & set(got)


def test_notices_of_any_length_and_distance(spark):
    head = "Cơ quan nhận đủ hồ sơ thì cấp phiếu hẹn. "
    ends = ["(còn tiếp)" + " " * 300, "[…]" + " \n" * 300, "\n" + "-" * 250 + "\n(còn tiếp)", "\n" + "-" * 60 + "\n(còn tiếp)", "\n***\n" * 40 + "Xem thêm", "(còn tiếp)" + " " * 10]
    got = cuts(spark, [head + e for e in ends] + [head + "Người nộp phải tr" + e for e in ends] + [head + "Kết quả g\ufffd" + " -" * 300])
    assert not any(got[n] for n in range(6)), got
    assert all(got[n] for n in range(6, 13)), got


def test_cut_texts_on_an_empty_table(spark):
    assert cutoff.cut_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_p10_queries(spark, small):
    found = cutoff.p10_found(spark, small).collect()
    assert len(found) == len({r["doc_id"] for r in found}) > 0
    rates = cutoff.p10_rates(spark, small).collect()
    assert sum(r["n_cut"] for r in rates) == len(found)


def test_notices_behind_a_cut(spark):
    head = "Cơ quan nhận đủ hồ sơ thì cấp phiếu hẹn. Người nộp phải tr"
    notices = ["…", "...", " [...]", "\n(Hết trang)", " (còn nữa)", "</p>", "<br/>", '"}', "… Xem thêm", "\n--\nTải về để đọc tiếp.", "\n(Hết trang)\n"]
    got = cuts(spark, [head + n for n in notices])
    assert all(got.values()) and len(got) == len(notices), got
    whole = cuts(spark, ["Cơ quan nhận đủ hồ sơ thì cấp phiếu hẹn. Kết quả gửi về tận nơi." + n for n in notices] + ["Phiếu hẹn. Mẫu: .........."])
    assert not any(whole.values()), whole


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 40, 150, 400]
    tf = [rng.integers(1, 30, n) for n in sizes]
    background = [rng.random(n) / 1000 + 1e-7 for n in sizes]
    record = np.repeat(np.arange(len(sizes)), sizes)
    together = distinct.own_probabilities(record, np.concatenate(tf), np.concatenate(background))
    alone = [distinct.own_probabilities(np.zeros(n, dtype=int), t, b) for n, t, b in zip(sizes, tf, background)]
    assert together.tolist() == np.concatenate(alone).tolist()
    for p, t, b in zip(alone, tf, background):  # another round moves nothing
        e = t * 0.1 * p / (0.1 * p + 0.9 * b)
        assert np.abs(e / e.sum() - p).max() < distinct.TOLERANCE


def test_beginnings_of_words_that_recur_at_cuts(spark):
    heads = [f"Hồ sơ số {n} nộp tại phòng {n}.\n" for n in range(76)]
    whole = [h + "Các bên giữ nguyên quan điểm về mức phí đã nêu." for h in heads[:60]] + [h + "Nơi nhận như trên" for h in heads[60:70]]
    got = cuts(spark, whole + [h + "Các bên giữ nguyên quan điểm về m" for h in heads[70:]])
    assert not any(got[n] for n in range(70)), got
    assert all(got[n] for n in range(70, 76)), got

import unicodedata as ud

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kervan.llm.unicode_form import consistent, form_of, with_form

CASES = {
    "Мayuуutork‎s 1000 mg": "Mayuyutorks 1000 mg", "Ｄｕｓａｌｔａｒｔａｎ 10 mg saşe": "Dusaltartan 10 mg saşe",
    "Busi̇lofet": "Busilofet", "Α‑tokoferol": "Α-tokoferol", "25 mg ﬁlm 5 ㎎": "25 mg film 5 mg", "ＫＧ（５）": "KG(5)", "a　b": "a b",
    "görme": "görme", "gіdа": "gida", "Kan": "Kan", "İlaç": "İlaç", "eșlik mɡ": "eşlik mg", "gӧrme": "görme", "Μ 25 mg": "M 25 mg",
}
ORDINARY = ["şurup İlaç ı", "Α-tokoferol 40 μg β-blokör α-", "睡前服用时，药物剂量 250mg。“是！”，5mg", "Во время поездки в 3 часа", "½ m² 25 °C ® ≥ 6 … “x” ‘y’", "ο αριθμός να", "老年人　半片", "क्‍ष", "🙏 👩‍👩‍👧", "\U0001f3f4\U000e0067\U000e0062\U000e007f", "葛\U000e0100", "Կարգ օր", "", " \t\n", "Größe naïve"]


def test_cases():
    for stored, form in CASES.items():
        assert consistent(stored) == (form, True) or stored == form, stored
    for text in ORDINARY:
        assert consistent(text) == (text, False), text
    assert consistent(None) == (None, False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abİışçö μΑаοсｅ̧́̇​ ㎎ﬁ。，"), st.characters(codec="utf-8")), max_size=40))
def test_idempotent_and_composed(text):
    form, _ = consistent(text)
    assert consistent(form)[0] == form
    assert ud.is_normalized("NFC", form)


def test_every_canonical_pair_is_composed():
    """Every character with a canonical decomposition, and every mark, in four surroundings: composed, and stable from then on."""
    for cp in range(0xA0, 0x110000):
        ch = chr(cp)
        d = ud.decomposition(ch)
        if not (ud.combining(ch) or d and not d.startswith("<")):
            continue
        for text in (ch, ud.normalize("NFD", ch), f"a{ch}", f"x{ud.normalize('NFD', ch)}\u0323", f"{ch}\u0301"):
            form = consistent(text)[0]
            assert ud.is_normalized("NFC", form) and consistent(form)[0] == form, ascii(text)


def test_column(spark):
    rows = [(1, k, "x") for k in CASES] + [(2, t, None) for t in ORDINARY] + [(3, None, "y"), (4, "ａ" * 50_000, "z")]
    df = spark.createDataFrame(rows, "id int, t string, disguised string")
    got = with_form(df, "t").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.form, r.disguised) == consistent(r.t)
    assert spark.createDataFrame([], df.schema).select(form_of(F.col("t"))).count() == 0

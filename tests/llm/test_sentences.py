import random

import numpy as np

from kervan.llm import sentences as S

CASES = [
    ("Dr. onayı olmadan verilmez. İkinci cümle.", ["Dr. onayı olmadan verilmez.", "İkinci cümle."]),
    ("Başlangıçta 2.5 mg verilir, bkz. Bölüm 4.19, ardından artar. Son.", ["Başlangıçta 2.5 mg verilir, bkz. Bölüm 4.19, ardından artar.", "Son."]),
    ("16. haftadan sonra. 3. haftadan önce!", ["16. haftadan sonra.", "3. haftadan önce!"]),
    ("Bulantı... sonra da kusma olursa... Hekim", ["Bulantı... sonra da kusma olursa...", "Hekim"]),
    ("Etikette “Doz artar.” yazar. “Tek cümle.” Son", ["Etikette “Doz artar.” yazar.", "“Tek cümle.”", "Son"]),
    ('Hemşire "Atlandı mı?" diye sorarsa verilir.', ['Hemşire "Atlandı mı?" diye sorarsa verilir.']),
    ("Bir.\n- madde bir\n2) madde iki.\n3. madde üç", ["Bir.", "- madde bir", "2) madde iki.", "3. madde üç"]),
    ("verilir.Bir doz. azaltılır.  pH 7.4 altında olur.", ["verilir.", "Bir doz. azaltılır.", "pH 7.4 altında olur."]),
    ("Am 17. Tag, z. B. morgens, gilt es. „Das gilt.“ Ab ca. 0,5 ml.", ["Am 17. Tag, z. B. morgens, gilt es.", "„Das gilt.“", "Ab ca. 0,5 ml."]),
    ("老年人，半片药。“饭后，应当减少。”驾车之前！说明写着“请停用！”，然后问。", ["老年人，半片药。", "“饭后，应当减少。”", "驾车之前！", "说明写着“请停用！”，然后问。"]),
    ("「半錠を減らす。」と書かれています。量は2.5mlですか？", ["「半錠を減らす。」と書かれています。", "量は2.5mlですか？"]),
    ("ก่อนนอนทุกเย็น หลังอาหาร27สัปดาห์", ["ก่อนนอนทุกเย็น", "หลังอาหาร27สัปดาห์"]),
    ("όταν αλλάζει; Στους ηλικιωμένους. Βλ. σελ. 10 και π.χ. τον πίνακα 2.1.", ["όταν αλλάζει;", "Στους ηλικιωμένους.", "Βλ. σελ. 10 και π.χ. τον πίνακα 2.1."]),
    ("По мнению д-ра, см. п. 3, т. е. в таблице 2.1, это важно. «Нет!» Да.", ["По мнению д-ра, см. п. 3, т. е. в таблице 2.1, это важно.", "«Нет!»", "Да."]),
    ("راجع د. سامر قبل اليوم 7. بعد الطعام كل مساء؟ نعم", ["راجع د. سامر قبل اليوم 7.", "بعد الطعام كل مساء؟", "نعم"]),
    ("डॉ. ने 2.5 मिली लिखी है। बच्चों में है?", ["डॉ. ने 2.5 मिली लिखी है।", "बच्चों में है?"]),
    ("(bkz. s. 7). By 8 a.m. on day 2, e.g. bread.", ["(bkz. s. 7).", "By 8 a.m. on day 2, e.g. bread."]),
    ("", []), (" \n\t ", []),
]


def test_cases():
    for text, want in CASES:
        assert [text[a:b] for a, b in S.sentence_spans(text)] == want, text
    assert S.sentence_spans(None) == []


def test_blocks_compose():
    rng = random.Random(2)
    text = " ".join(rng.choice(CASES)[0] for _ in range(60))
    whole = S.run(text)
    for size in (1, 7, 100):
        parts = [text[i : i + size] for i in range(0, len(text), size)]
        ends = S.compose([S.block_function(p) for p in parts])
        state = 0
        for p, f in zip(parts, ends, strict=True):
            state = S.run(p, state)[0]
            assert f[0] == state
        assert state == whole[0]
    assert isinstance(ends[0], np.ndarray)


def test_columns(spark):
    rng = random.Random(6)
    texts = [t for t, _ in CASES] + [None, " \n" * 60 + "Bir. " + " " * 200 + "İki", "“Bir.”" + " " * 90 + "pH 7 olur. “" + "\n" * 70] + [" ".join(rng.choice(CASES)[0] for _ in range(20)) for _ in range(20)] + ["a" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, t string, start_pos int")
    want = {(i, a, b) for i, t in enumerate(texts) for a, b in S.sentence_spans(t)}
    for block, group in ((10_000, 256), (S.BLOCK, 256), (50, 256), (7, 4), (1, 2)):  # all in one go, as set, and by ever smaller blocks
        got = [tuple(r) for r in S.split_sentences(df, "t", ["id"], block, group).collect()]
        assert len(got) == len(set(got)) and set(got) == want, block
    twice = spark.createDataFrame([(None, CASES[0][0] * 9)] * 2, "id long, t string")  # a null key, and a repeated row
    for block in (S.BLOCK, 50):
        assert sorted(S.split_sentences(twice, "t", ["id"], block).collect()) == sorted([(None, a, b) for a, b in S.sentence_spans(CASES[0][0] * 9)] * 2)
    assert S.split_sentences(df.limit(0), "t", ["id"]).count() == 0

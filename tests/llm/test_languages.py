import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrymill.llm import languages as L

TEXTS = {
    "it": ["Il gatto dorme sulla sedia vicino alla finestra della cucina.", "Domani andremo tutti insieme al mercato per comprare la frutta.", "Questa mattina il treno è arrivato con molto ritardo.", "La casa dei nonni si trova in mezzo alla campagna."],
    "en": ["The cat sleeps on the chair near the kitchen window.", "Tomorrow we will all go to the market together to buy fruit.", "This morning the train arrived with a long delay.", "The house of the grandparents stands in the middle of the fields."],
    "es": ["El gato duerme en la silla cerca de la ventana de la cocina.", "Mañana iremos todos juntos al mercado para comprar la fruta.", "Esta mañana el tren llegó con mucho retraso.", "La casa de los abuelos está en medio del campo."],
    "ja": ["猫は台所の窓の近くの椅子で眠ります。", "明日みんなで市場へ果物を買いに行きます。", "今朝、電車はとても遅れて到着しました。"],
}


@pytest.fixture(scope="module")
def filters():
    return L.LanguageFilters.fit([t for ts in TEXTS.values() for t in ts], [l for l, ts in TEXTS.items() for _ in ts])


def test_held_out(filters):
    held = [("it", "Il treno dei nonni è arrivato questa mattina alla campagna."), ("en", "The grandparents will arrive together this morning."), ("es", "Los abuelos llegaron al mercado esta mañana."), ("ja", "今朝みんなで台所の椅子を買いに行きます。")]
    got = filters.decide([L.normalised(t) for _, t in held])
    assert [g[0] for g in got] == [l for l, _ in held] and all(0.5 < c <= 1 for _, c in got)
    assert filters.decide([L.normalised("Qzx wvk jjq pfx zzkq.")])[0] == ("und", 0.0) and filters.decide([]) == []


def test_bit_slices_are_separate_filters(filters):
    """A lookup returns exactly the languages whose own Bloom filters hold the n-gram."""
    import numpy as np

    for k, lang in enumerate(filters.languages):
        a, b, keep, _ = L._grams([L.normalised(t) for t in TEXTS[lang]])
        assert ((filters.slots[a[keep], 0] & filters.slots[b[keep], 0]) >> np.uint32(k) & 1).all()
    assert (filters.false_positive < 0.01).all()


@pytest.mark.parametrize("label, code", [(None, "und"), ("", "und"), ("n/a", "und"), ("EN_us", "en"), ("ita", "it"), ("Italian", "it"), ("fr-CA", "fr"), (" de ", "de"), ("xx", "xx")])
def test_labels(label, code):
    assert L.label_code(label) == code


def test_spans_leave_out_what_is_no_sentence():
    text = "# The heading is here.\n\nOne sentence `code. here` stands. \"Quoted words.\" Another one follows!\n\n```\nnot. a. sentence.\n```\n| a cell. | b |\nno closing mark"
    spans = L.sentence_spans(text)
    assert [text[a:b] for a, b, _ in spans] == ["One sentence `code. here` stands.", "Another one follows!"]


def test_more_languages_than_bits():
    texts = [f"{chr(0x4E00 + 40 * k)}{chr(0x4E01 + 40 * k)}{chr(0x4E02 + 40 * k)}{chr(0x4E03 + 40 * k)}" for k in range(70)]
    f = L.LanguageFilters.fit(texts, [f"l{k:02d}" for k in range(70)])
    assert f.slots.shape == (L.SLOTS, 2) and [x for x, _ in f.decide(texts)] == [f"l{k:02d}" for k in range(70)]


def test_runs_between_sentences():
    text = "# Un titolo lungo\n\n- prima voce\n- seconda voce\n\nUna frase intera qui. un resto senza punto"
    got = [(text[a:b], whole) for a, b, _, whole in L.text_spans(text)]
    assert got == [("# Un titolo lungo\n\n- prima voce\n- seconda voce", False), ("Una frase intera qui.", True), ("un resto senza punto", False)]
    assert L.text_spans("```\ncode only\n```") == [] and L.text_spans("") == []


#: A text of each language without any closing mark.
OPEN = {
    "it": "# Guida alla configurazione del servizio\n\n- avviare il programma con i parametri della tabella\n- controllare che la connessione sia attiva",
    "en": "# Guide to the configuration of the service\n\n- start the program with the parameters of the table\n- check that the connection is still open",
    "de": "# Anleitung für die Einrichtung des Dienstes\n\n- das Programm mit den Werten der Tabelle starten\n- prüfen, ob die Verbindung noch besteht",
    "fr": "# Guide pour la configuration du service\n\n- lancer le programme avec les paramètres du tableau\n- vérifier que la connexion est toujours ouverte",
    "es": "# Guía para la configuración del servicio\n\n- iniciar el programa con los parámetros de la tabla\n- comprobar que la conexión sigue abierta",
    "ru": "# Настройка службы\n\n- запустить программу с параметрами из таблицы\n- проверить, что соединение открыто",
    "zh": "# 服务配置指南\n\n- 使用表中的参数启动程序\n- 检查连接是否仍然打开",
    "ja": "# サービスの設定ガイド\n\n- 表のパラメータでプログラムを起動する\n- 接続がまだ開いていることを確認する",
    "hi": "# सेवा की सेटिंग\n\n- तालिका के मानों के साथ कार्यक्रम शुरू करें\n- देखें कि कनेक्शन खुला है",
    "ar": "# دليل إعداد الخدمة\n\n- تشغيل البرنامج مع القيم الموجودة في الجدول\n- التأكد من أن الاتصال ما زال مفتوحا",
    "th": "การตั้งค่าบริการ เริ่มโปรแกรมด้วยค่าจากตาราง ตรวจสอบว่าการเชื่อมต่อยังเปิดอยู่",
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_every_language_without_a_full_stop(spark):
    samples = spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet")
    f = L.fit_filters(samples)
    df = spark.createDataFrame([(k, None, v) for k, v in OPEN.items()], "id string, lang string, content string")
    got = {r["id"]: (r["lang"], r["confidence"], [s["sentences"] for s in r["segments"]]) for r in L.label_languages(df, f).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: k for k in OPEN}
    assert all(c > 0.5 and not any(n) for _, c, n in got.values())
    late = samples.withColumn("sample_id", F.row_number().over(W.orderBy("lang"))).orderBy("lang")
    assert set(L.fit_filters(late).languages) == set(OPEN)  # no order of the table leaves a language out


def test_segments_of_every_chunk(spark):
    it, en = TEXTS["it"][0], TEXTS["en"][0]
    samples = spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate((l, t) for l, ts in TEXTS.items() for t in ts)], "sample_id int, lang string, text string")
    rows = [("a", "it", f"{it} {en}", None), ("c", None, en, "gitlab/x/code/README"), ("e", "it", None, None)]
    df = spark.createDataFrame(rows, "id string, lang string, content string, rel_path string")
    got = sorted((r["id"], r["lang"], r["segment"], r["segment_lang"], r["start_char"]) for r in L.p3_languages(df, samples).collect())
    assert got == [("a", "en", 1, "en", len(it) + 1), ("a", "en", 0, "it", 0), ("c", "en", 0, "en", 0), ("e", "und", None, None, None)] or got == [("a", "it", 0, "it", 0), ("a", "it", 1, "en", len(it) + 1), ("c", "en", 0, "en", 0), ("e", "und", None, None, None)]


def test_dirty_rows(spark, filters):
    it, en = TEXTS["it"][0], TEXTS["en"][0]
    rows = [("a", "it", it), ("b", "en", it), ("c", "it", f"{it} {en}"), ("d", None, en), ("d", None, en), ("e", "it", None), ("f", "", "```\nx\n```"), (None, "it", it), ("g", "IT", it * 5000)]
    df = spark.createDataFrame(rows, "id string, lang string, content string").selectExpr("*", "cast(null as string) as rel_path", "1 as label", "2 as segments")
    got = {r["id"]: (r["lang"], len(r["segments"])) for r in L.label_languages(df, filters).collect()}
    assert got == {"a": ("it", 1), "b": ("it", 1), "c": ("it", 2), "d": ("en", 1), "e": ("und", 0), "f": ("und", 0), "g": ("it", 1)}
    samples = spark.createDataFrame([(i, l, t) for i, (l, t) in enumerate((l, t) for l, ts in TEXTS.items() for t in ts)] + [(99, None, "x"), (98, "it", None)], "sample_id int, lang string, text string")
    found = sorted((r["id"], r["found_lang"]) for r in L.p3_found(df, samples).collect())
    assert found == [("b", "it"), ("c", "en"), ("c", "it"), ("d", "en")]
    assert L.p3_found(df.where("false"), samples).count() == 0

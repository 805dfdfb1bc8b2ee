import pytest

from linkloom.llm.sentences import sentence_spans, sentences

CASES = {
    "en": [
        ["The ferry... was it ever colourful?", "They waited and waited...", "The museum is here."],
        ['Hester wrote: "We waited here. Nobody came. We left at 9 a.m. and went home."', "After that it ended."],
        ["Mr. J. K. Ansel of the U.T.B. board met Opal Institute near the ferry.", "Gen. Opal had 9.3 points; Lt. Nestor had 9.5."],
        ["The work went to Opal & Sons Ltd.", "The next one did not.", "It sold flour, nails, etc.", "Nails are here."],
        ["No. 9 on the list moved to St. Bryony Street in Nov. that year.", "Was it Sgt. Opal?", "No matter: the library (est. long ago) is closed."],
        ["“The kitchen is not ready!” said Mrs. Bryony of Rome.", '"Is it local?" asked Nestor.', "(The ferry was crowded.)", "What a mill!!!", "Yes."],
    ],
    "es": [
        ["Subió al 9,5 por ciento, p. ej. en Roma.", "«No abrirán hoy», dijo Julián.", "El n.º 9 está en la Avda. Sta. Fabio."],
        ["Abril escribió: «Esperamos mucho. Nadie vino. Nos fuimos a las 9.»", "Según él, sí.", "—¿Está listo? —preguntó Ana a la gente.", "EE. PP. 9: el puente mide 9,4 m.", "Empieza a las 9 p. m.", "¿Quién es?"],
    ],
    "ru": [
        ["«Мы не готовы!» — сказала Варвара у входа.", "Аглая пишет: «Мы ждали. Никто не пришёл.»", "Это было в 9 г. до н. э., как пишет Лар.", "На ул. Садовой, д. 9, живёт Глеб.", "Рост на 9 % и т. д.", "Старый мост."],
    ],
    "hi": [["गीता ने लिखा: “हम रुके। कोई नहीं आया।”", "नया बाज़ार है।", "“हम तैयार हैं।” मोहन ने उससे कहा।", "डॉ. मोहन ने 9.5 किलो आटा दिया।"]],
}


@pytest.mark.parametrize("lang", CASES)
def test_with_blanks(lang):
    for want in CASES[lang]:
        text = " ".join(want)
        assert [text[a:b] for a, b in sentence_spans(text, lang)] == want


def test_scripts_without_blanks():
    want = ["老秦说：“我们等了很久。没有人来。”", "“准备好了吗？”小林问大家。", "“今天不开门！”", "他们一直等着……", "老周……终于来了。", "《车站。村庄》是他写的书。", "真的吗？！", "数值升到了17.3，超过预计！"]
    text = "".join(want)
    assert [text[a:b] for a, b in sentence_spans(text, "zh")] == want
    want = ["ผู้คนใน Roma เห็นว่าตลาดเก่าเปิด", "สะพานยาว 11.3 กิโลเมตรและเงียบ"]
    text = " ".join(want)
    assert [text[a:b] for a, b in sentence_spans(text, "th")] == want


def test_lines_language_and_missing_blank():
    text = "Heading here\n- item one\r\n\n  1. First point.  Next one.It goes on. \n"
    assert [text[a:b] for a, b in sentence_spans(text, None)] == ["Heading here", "- item one", "1. First point.", "Next one.", "It goes on."]
    assert sentence_spans("真的吗？是。", "en") == [(0, 4), (4, 6)]
    assert sentence_spans(None, "en") == sentence_spans("", None) == sentence_spans(" \n\t", "xx") == []


def test_spans_cover_the_text():
    text = "A. B! «C? D» e… f\n" * 200
    spans = sentence_spans(text, "es")
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "").replace("\n", "")


def test_table(spark):
    df = spark.createDataFrame([(1, "Hi. You!", "en"), (2, None, None), (3, "x" * 100_000 + ". Y.", "en"), (None, "Hi.", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 as sent_start")
    rows = [tuple(r) for r in sentences(df).collect()]
    assert rows == [(1, 0, 3), (1, 4, 8), (3, 0, 100_001), (3, 100_002, 100_004), (None, 0, 3)]
    assert sentences(df.where("false")).count() == 0


def test_other_languages():
    cut = lambda t, g: [t[a:b] for a, b in sentence_spans(t, g)]
    assert cut("هل أنت هنا؟ نعم أنا هنا. شكرا", None) == ["هل أنت هنا؟", "نعم أنا هنا.", "شكرا"]
    assert cut("ሰላም ነው። እንዴት ነህ።", "am") == ["ሰላም ነው።", "እንዴት ነህ።"]
    assert cut("Das ist z. B. gut. Am 3. Mai kam er. Ende.", "de") == ["Das ist z. B. gut.", "Am 3. Mai kam er.", "Ende."]
    assert cut("M. Dupont est là. Il part.", "fr") == ["M. Dupont est là.", "Il part."]

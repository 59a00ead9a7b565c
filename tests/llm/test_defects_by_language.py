import pytest

from docweft.llm import languages as L
from docweft.llm import pair_defects as P

ASKED = "What fee is due at the hub?"
REFUSED = {
    "en": ["I don't know.", "The documents do not mention this."], "fr": ["Je ne peux pas répondre à cette question."], "sw": ["Siwezi kujibu swali hili."], "es": ["No puedo responder a esa pregunta."], "pt": ["Não posso responder a essa pergunta."],
    "de": ["Diese Frage kann ich leider nicht beantworten.", "Ich weiß es nicht.", "Die Unterlagen enthalten dazu nichts."], "it": ["Non posso rispondere a questa domanda.", "I documenti non contengono questa informazione."],
    "nl": ["Ik kan deze vraag niet beantwoorden.", "De documenten bevatten geen antwoord."], "pl": ["Nie mogę odpowiedzieć na to pytanie.", "Dokumenty nie zawierają tej informacji."], "ru": ["Я не могу ответить на этот вопрос.", "В документах нет информации."],
    "ko": ["질문에 답변할 수 없습니다."], "zh": ["无法回答这个问题。"], "ja": ["お答えできません。"], "ar": ["لا أستطيع الإجابة."], "hi": ["मुझे पता नहीं।"], "th": ["ขออภัย ไม่ทราบ"], "am": ["አላውቅም።"],
}
ANSWERED = ["According to the documents the fee is 12. The documents do not mention a discount.", "Ich habe am Montag keine Rechnung bekommen, die Gebühr ist 12.", "The fee is 12; I do not know of any other.",
            "Il costo è 12. I documenti non menzionano sconti.", "Nie później niż w poniedziałek opłata wynosi 12.", "Non solo la tassa: 12 alla settimana."]


def test_refusals_of_every_language_and_answers_that_only_look_like_them():
    missed = [(k, a) for k, v in REFUSED.items() for a in v if not P.is_refusal(a, "12 per week")]
    wrong = [a for a in ANSWERED if P.is_refusal(a, "12 per week")]
    assert not missed and not wrong


@pytest.fixture(scope="module")
def profiles(spark):
    return L.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 9000"))


# the fourth is of a language without a profile and nearer to another's than to the question's; where that is not so, nothing is flagged
FOREIGN = ["Laut den Unterlagen nimmt die Firma den Antrag innerhalb von drei Tagen an.", "De acordo com os documentos, a loja aceita o pedido até três dias depois da entrega.", "El vendedor debe pagar antes de que termine el mes, salvo acuerdo escrito.",
           "Volgens de documenten neemt de winkel het verzoek binnen drie dagen aan.", "Le magasin accepte la demande dans un délai de trois jours.", "Duka hupokea ombi ndani ya siku tatu baada ya bidhaa kufika."]
OWN = ["The shop accepts the request within three days of delivery.", "Captain Jean-Pierre de la Tour, Santa Maria del Mar, signs for the parcel.", "12 per week", "NOT_IN_DOCUMENTS", "At Gofibede the fee is charged to Dorijasi and Yovihiba once a week."]


def test_languages_of_answers(profiles):
    got = P.other_languages([(ASKED, a, "12 per week") for a in FOREIGN + OWN], profiles)
    assert got == [True] * len(FOREIGN) + [False] * len(OWN)
    assert P.other_languages([(None, "Was?", None), (ASKED, None, None), ("", "", "")], profiles) == [False] * 3


def test_profiles_name_the_language_of_held_out_documents(spark, profiles):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang in ('en', 'fr', 'sw', 'de', 'es', 'pt') and doc_id >= 9000 and length(text) > 200").select("lang", "text").limit(3000).collect()
    s, _ = profiles.scores([r.text for r in rows])
    right = {}
    for r, k in zip(rows, s.argmax(1)):
        right.setdefault(r.lang, []).append(profiles.names[k] == r.lang)
    assert set(right) == {"en", "fr", "sw", "de", "es", "pt"} and all(sum(v) / len(v) > 0.9 for v in right.values()), {k: (sum(v), len(v)) for k, v in right.items()}


def test_profiles_of_nothing(spark):
    p = L.learn(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert p.names == [] and p.scores(["a text"])[0].shape == (1, 0)
    h, n = L.trigrams(["", "ab", "12 !"])
    assert n.tolist() == [0, 2, 0] and len(h) == n.sum()


@pytest.mark.parametrize("text,state", [('A 24" monitor is 14 inches tall.', "whole"), ('It says: "the fee', "cut"), ('A 24" screen and "the', "cut"), ('He said "no" to 24".', "whole"), ("The fee is 12 [3]", "whole"), ("The fee is 12 (see", "cut")])
def test_inches_are_no_quotes(text, state):
    assert P.cut_state(text, P.words(text), None) == state


def test_a_thai_answer_that_breaks_off(spark):
    whole = "ผู้ขายต้องคืนเงินภายในสามวัน"
    rows = [(i, "ต้องคืนเงินเมื่อไร", f"{whole} ร้านเปิดทุกวัน", None) for i in range(5)] + [(9, "ต้องคืนเงินเมื่อไร", whole[:-4], None), (10, "ต้องคืนเงินเมื่อไร", whole, None)]
    d = spark.createDataFrame(rows, "answer_id bigint, question string, answer string, gold_answer string")
    assert {r.answer_id for r in P.pair_defects(d).where("main = 'truncated'").collect()} == {9}

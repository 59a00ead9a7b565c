"""Defective question-answer pairs, by ordered rules.

The rules look at one pair each and run in this order: ``empty``, ``refusal``,
``copies_question``, ``other_language``, ``truncated``.  All that apply are emitted; the first is the
pair's main defect.  Languages are told apart by script and, within one, by trigram profiles learned from
labelled documents.  Whether an answer without closing punctuation breaks off is settled with counts over
all answers: how often its last two words close a sentence, and how often they are followed by more.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.durable import stored
from docweft.llm._util import ships
from docweft.llm.languages import LanguageProfiles

ORDER = ("empty", "refusal", "copies_question", "other_language", "truncated")

#: Answers that are only one of these words are placeholders.
PLACEHOLDERS = frozenset("n/a na n.a none null nil nan undefined unknown tbd todo tba empty blank missing placeholder answer a response reply text string "
                         "réponse reponse jibu respuesta resposta antwort 答案 回答 答え 無し なし 无 उत्तर جواب الجواب คำตอบ መልስ".split()) | {"no answer", "not available", "your answer here"}

#: What says that there is no answer, by language; matched in the lower-cased text with plain apostrophes.
REFUSALS = [
    # en
    r"\bnot[_ ]in[_ ](?:the )?(?:documents?|context|passages?)\b",
    r"\b(?:i|we)(?: am|'m| are|'re)? (?:sorry,? )?(?:but )?(?:un(?:fortunately )?able to|not able to|not allowed to|cannot|can't|can not|could not|couldn't|won't|don't|do not|am not|must decline|have to decline)(?: to)?(?: \w+){0,3}? ?(?:answer|help|assist|know|say|tell|respond|determine|find|provide|comply|access|have (?:access|enough|any|the|that)|locate|give)",
    r"\b(?:i|we) (?:do not|don't) know\b",
    r"\b(?:un(?:fortunately)?,? )?(?:i am|i'm|we are) unable to\b",
    r"\bas an? (?:ai|language model|large language model|assistant)\b",
    r"\b(?:passages?|documents?|context|excerpts?|texts?|sources?|information|materials?)\b(?: [\w']+){0,4} (?:do(?:es)? not|don't|doesn't|did not|didn't|say nothing|says nothing|contains? no|has no|have no|nothing)\b(?: (?:mention|contain|say|state|include|cover|provide|specify|answer|tell|give|address|discuss|have))?",
    r"\b(?:there is|there's|there are|i see|i find|i found) (?:no|not any|not enough|nothing)\b(?: \w+){0,2} (?:information|mention|answer|details?|data|about (?:this|that)|to answer)\b",
    r"\bno (?:answer|information|reply)\b(?: \w+){0,3} (?:can be|could be|is|was|are) (?:given|found|available|provided|possible)\b",
    r"\bno (?:answer|information) (?:available|found|possible)\b",
    r"\bnot something (?:i|we) can\b",
    r"\b(?:none of (?:them|the \w+)) (?:states?|says?|mentions?|answers?|covers?|contains?)\b",
    r"\b(?:cannot|can't|could not|not) be (?:answered|determined|found|answered) (?:from|in|with|based)\b",
    r"\bnot (?:stated|mentioned|specified|given|contained|provided|found|available) (?:in|by) (?:the|these|those|any)\b",
    r"\binsufficient (?:information|context)\b", r"\bnot enough (?:information|context)\b",
    # fr
    r"\bje (?:suis désolé|regrette|m'excuse)[^.]*\bne (?:peux|puis|sais)\b", r"\bje ne (?:peux|puis|sais|dispose|trouve|suis pas en mesure)\b", r"\baucune? (?:réponse|information|mention|indication|donnée)\b",
    r"\bne (?:contien(?:t|nent)|mentionn(?:e|ent)|précis(?:e|ent)|indiqu(?:e|ent)|di(?:t|sent)|permet(?:tent)?|donn(?:e|ent)|figure(?:nt)?)(?: \w+)? (?:pas|rien|aucun)", r"\bimpossible de (?:répondre|trouver|dire|déterminer)\b", r"\bn'(?:est|a) pas (?:indiqué|mentionné|précisé|trouvé|disponible)",
    # sw
    r"\bsi(?:wezi|jui|na taarifa|fahamu|oni)\b", r"\bhatuwezi kujibu\b", r"\bhaziwezi\b|\bhaina taarifa\b|\bhazina (?:taarifa|habari|maelezo|jibu)\b|\bhakuna (?:taarifa|jibu|habari|maelezo)\b", r"\bhai(?:taj|tajw|onyesh)\w*\b|\bhazi(?:taj|onyesh|elez|sem)\w*\b|\bsamahani[^.]*\bsi\w+",
    # es, pt
    r"\bno (?:puedo|podemos|sé|sabemos|encuentro|tengo|dispongo|es posible) ?(?:responder|contestar|ayudar|decir|encontrar|información|determinar|saber)?", r"\bno (?:contienen?|mencionan?|indican?|dicen?|incluyen?|hay) (?:esta|esa|ninguna|nada|información|respuesta)\b", r"\bninguna respuesta\b",
    r"\bnão (?:posso|podemos|sei|sabemos|encontrei|encontro|tenho|é possível|consigo)\b", r"\bnão (?:contêm|contém|mencionam?|indicam?|dizem|diz|há|incluem) (?:esta|essa|nenhuma|nada|informaç|resposta)", r"\bnenhuma (?:resposta|informação)\b",
    # de
    r"\b(?:ich|wir|man) (?:kann|können)\b[^.;,]*\bnicht (?:beantworten|antworten|helfen|sagen|angeben|finden|nennen|beurteilen)\b", r"\b(?:kann|können) (?:ich|wir|man)\b[^.;,]*\bnicht (?:beantworten|antworten|helfen|sagen|angeben|finden|nennen|beurteilen)\b",
    r"\b(?:ich weiß|wir wissen|weiß ich|wissen wir)(?: \w+){0,2} nicht\b", r"\b(?:ich habe|wir haben|ich finde|wir finden|habe ich|haben wir|finde ich|finden wir)(?: \w+){0,3} (?:keine|nicht genug|nicht genügend) (?:antwort|angaben?|information(?:en)?|hinweise?|daten|kenntnis)\b",
    r"\b(?:unterlagen|dokumente?n?|texte?n?|passagen|abschnitte?n?|auszüge?n?)\b[^.;]*\b(?:enthalten|enthält|nennen|nennt|sagen|sagt|erwähnen|erwähnt)\b[^.;]*\b(?:nicht|nichts|keine?)\b", r"\b(?:nicht|keine?) (?:\w+ ){0,4}in den (?:unterlagen|dokumenten|texten)\b",
    r"\bkeine (?:antwort|angabe|information)(?:en)?\b(?: \w+){0,3} (?:möglich|vorhanden|gefunden|verfügbar)",
    # it, nl
    r"\bnon (?:posso|possiamo|so|sappiamo|trovo|sono in grado|è possibile|dispongo)\b(?: \w+){0,3}? ?(?:rispondere|aiutar\w*|dire|trovare|determinare|risposta|informazioni)?", r"\b(?:documenti|testi|passaggi|fonti)\b[^.;]*\bnon (?:contengono|menzionano|indicano|dicono|riportano)\b", r"\b(?:nessuna (?:risposta|informazione)|mi dispiace[^.;]*\bnon)\b",
    r"\b(?:ik|wij|we) (?:kan|kunnen|weet|weten|vind|heb)\b[^.;,]*\b(?:niet (?:beantwoorden|helpen|zeggen|vinden)|geen (?:antwoord|informatie|gegevens)|het niet)\b", r"\b(?:documenten|stukken|teksten|bronnen)\b[^.;]*\b(?:bevatten|vermelden|noemen|zeggen)\b[^.;]*\b(?:niet|niets|geen)\b", r"\bkan (?:ik|deze vraag)[^.;]*\bniet (?:beantwoorden|worden beantwoord)\b",
    # pl, ru, ko
    r"\bnie (?:mogę|możemy|wiem|wiemy|jestem w stanie|znajduję|udało się)\b", r"\b(?:dokument\w*|tekst\w*|źród\w*)\b[^.;]*\bnie (?:zawiera\w*|wspomina\w*|podaj\w*|ma)\b", r"\bbrak (?:odpowiedzi|informacji)\b",
    r"\bне (?:могу|можем|знаю|знаем|удалось|нахожу)\b", r"\b(?:документ\w*|текст\w*|источник\w*)\b[^.;]*\b(?:не (?:содерж\w*|упомина\w*|указыва\w*|говор\w*)|нет (?:ответа|информации|данных))\b", r"\bнет (?:информации|ответа)\b",
    r"(?:답변|대답)(?:을|를)? ?(?:할|드릴) 수 없|알 수 없|모르겠|(?:문서|자료|본문)(?:에|에는|에서)[^.]*(?:없|않)|정보가 (?:없|부족)|죄송",
    # zh, ja
    r"(?:无法|不能|没办法)(?:回答|提供|确定|帮助)|我不知道|(?:文件|文档|资料|段落|上下文)中?(?:没有|未|并未)(?:提|包含|说明|找到|相关)|没有(?:相关)?(?:信息|答案)|抱歉.{0,12}(?:无法|不能)", r"(?:お答え|回答)(?:でき|出来)ません|わかりません|分かりません|(?:文書|資料|記載)(?:に|が|は)?.{0,12}(?:ありません|ない|含まれていません|見つかりません)|申し訳.{0,20}ません",
    # ar, hi, th, am
    r"لا (?:أستطيع|يمكنني|أعرف|أعلم|نستطيع|يمكن الإجابة|تحتوي|تذكر|توجد معلومات|يوجد)|عذرا|(?:آسف|اسف)", r"(?:उत्तर|जवाब) नहीं|नहीं (?:दे सकता|जानता|पता|बता सकता)|पता नहीं|(?:दस्तावेज़|दस्तावेज|संदर्भ)[^।]*नहीं|क्षमा करें|माफ़",
    r"ไม่(?:สามารถ|ทราบ|รู้|พบ|มี)(?:ตอบ|ข้อมูล|คำตอบ)?|ขออภัย", r"አላውቅም|መመለስ አልችልም|መልስ የለም|መረጃ (?:የለም|አልተገኘም)|ይቅርታ",
]
REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
#: One of these words, or a word that begins so, is in every refusal in Latin script; the patterns are only tried then.
REFUSAL_WORDS = frozenset("no not nothing none cannot t unable decline ai model assistant insufficient ne n aucun aucune impossible ninguna não nenhuma nicht nichts kein keine non nessuna niet niets geen nie brak".split())
REFUSAL_STARTS = ("not_", "si", "hatuwezi", "hai", "hazi", "haziwezi", "hakuna", "samahani")
SENTENCE_END = re.compile(r"[.!?;。！？।።؟]+(?=\s|$|[^\x00-\x7f])|\n")
FOREIGN = re.compile(r"[\u0250-\u02ff\u0370-\u1dff\u2c00-\ud7ff\uf900-\uffff\U00010000-\U0010ffff]")

#: By how much a text has to be likelier in another language, in all and for each of its trigrams.
LEAST_ODDS, LEAST_ODDS_EACH = 9.0, 0.2

#: Frequent words of some languages in Latin script: the only evidence without profiles, and the surer one in short sentences.
STOPWORDS = {
    "en": "the of to and in is are a an for with on at by from that this be can not it as until after before each within what when where which who how does do my i or has have was were per once if must only any will long many much under all your you we they there their",
    "fr": "le la les des du de et est une un au aux pour par avec dans sur qui que quel quelle où ce cette chez si en pas ne plus après avant sont il elle combien quand se dès doit faut lors sauf fin vaut comme soit oui selon sous entre jusqu",
    "sw": "ya wa na kwa ni la za cha katika kama au baada kabla siku hii huu hiyo ndani kila pia bidhaa ombi lazima kwenye hadi mpaka nani wapi gani ngapi je ili hati kampuni mujibu hupokea ndiyo hapana kiasi inachukuliwa anatakiwa kulipa pamoja fedha wiki",
    "de": "der die das und ist nicht ein eine einen dem den des für mit auf von zu im am an bei nach vor innerhalb wird werden laut wenn wer wie wo was käufer tagen bevor dass oder auch sich muss nimmt zahlt",
    "es": "el los las del de y es una un para por con en que no se al su lo antes después según dentro días debe pagar la como más qué cuándo dónde quién cuánto salvo sí hasta entre",
    "pt": "o os as do da dos das de e é uma um para por com em que não se ao à no na nos nas até depois antes acordo aceita fim mês sim deve pagar como mais qual quando onde quem quanto você salvo",
}
STOP = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
LANGUAGES_OF = {w: tuple(k for k, s in STOP.items() if w in s) for s_ in STOP.values() for w in s_}

#: Words after which a sentence can't end.
HANGING = frozenset(("the a an of to and or in on at by from with for that this these those which who whose where when until after before if as is are was were be been can must may will shall not no than into onto per between under over about against its their his her our your my each every any other "
                     "le la les des du de et ou un une au aux pour par avec dans sur qui que si en ce cette chez dès son sa ses leur "
                     "ya wa na kwa ni la za cha katika kama au baada kabla ili yenye wenye hii huu "
                     "der die das und oder ein eine einen dem den des für mit auf von zu im am bei nach vor wenn dass "
                     "el los las del y una para con que al su lo o os as do da dos das e em um uma com ao").split())

CLOSED = re.compile(r"[.!?。！？।።؟…｡][\"'”’»」』）)\]\s]*$")
WORDS = re.compile(r"\w+")
CITED = re.compile(r"(?:\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]|\((?:see|voir|tazama|siehe|véase|ver|cf\.?)[^()]*\)|\(\s*\[?\d+\]?\s*\))\s*$", re.I)
MARKER = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-•*–]|[a-z][.)])\s*$")
DANGLING = re.compile(r"[,;:\-–—(\[{“«„「/&]\s*$|[:,]\s*[\"']\s*$")
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]|「[^」]*」|《[^》]*》")
WORD = re.compile(r"[^\W\d_]+")
SPOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A leading word of the frame of a repeated question.
FRAME = frozenset("q a question answer you asked asks ask the is was your my user query here frage antwort la le est vous avez demandé swali jibu ni umeuliza pregunta respuesta pergunta resposta réponse it asking about i see so ok okay well".split())


def visible(text: str) -> str:
    """The text's letters, digits and symbols other than punctuation; blanks, controls and invisible characters go."""
    if re.search(r"[^\W_]", text):
        return text
    return "".join(c for c in text if unicodedata.category(c)[0] not in "PZC" and c != "⠀")


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).lower().replace("’", "'").replace("‘", "'")


def words(text: str) -> list[str]:
    return WORDS.findall(plain(text))


def is_empty(answer: str | None) -> bool:
    if answer is None or not visible(answer):
        return True
    bare = re.sub(r"\s+", " ", plain(answer)).strip(" \n\t.:;,!?-–—_*#()[]{}<>\"'`")
    return bare in PLACEHOLDERS


def is_refusal(answer: str, gold: str | None = None) -> bool:
    """Some sentence declines, and the sentences that don't give no figure of the gold answer, nor most of its words."""
    t = " ".join(plain(answer).split())
    ws = WORDS.findall(t)
    if not FOREIGN.search(t) and REFUSAL_WORDS.isdisjoint(ws) and not any(w.startswith(REFUSAL_STARTS) for w in ws):
        return False
    if not REFUSAL.search(t):
        return False
    if not gold:
        return True
    rest = {w for part in SENTENCE_END.split(t) if part and not REFUSAL.search(part) for w in WORDS.findall(part)}
    wanted = set(words(gold))
    figures = {w for w in wanted if any(c.isdigit() for c in w)}
    return not (figures <= rest if figures else len(wanted & rest) > 0.6 * len(wanted))


def copies_question(q: list[str], a: list[str]) -> bool:
    """Nothing is left of the answer's words once the question's, as often as they occur, and the words of a frame are taken out."""
    if len(q) < 2 or len(a) < len(q) or f" {' '.join(q)} " not in f" {' '.join(a)} ":
        return False
    left, i = [], 0
    while i < len(a):
        if a[i : i + len(q)] == q:
            i += len(q)
        else:
            left.append(a[i])
            i += 1
    return all(w in FRAME for w in left)


def script_of(text: str) -> str:
    if not FOREIGN.search(text):
        return "latin" if re.search(r"[^\W\d_]", text) else ""
    counts: dict[str, int] = {}
    for c in text:
        if c.isalpha():
            o = ord(c)
            s = ("latin" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "kana" if 0x3040 <= o < 0x3100 else "han" if 0x3400 <= o < 0xA000 else "arabic" if 0x600 <= o < 0x780 else "devanagari" if 0x900 <= o < 0x980
                 else "thai" if 0xE00 <= o < 0xE80 else "ethiopic" if 0x1200 <= o < 0x1400 else "cyrillic" if 0x400 <= o < 0x530 else "greek" if 0x370 <= o < 0x400 else "hangul" if 0xAC00 <= o < 0xD7B0 else "other")
            counts[s] = counts.get(s, 0) + 1
    if not counts:
        return ""
    if counts.get("kana", 0) and counts.get("kana", 0) + counts.get("han", 0) > counts.get("latin", 0):
        return "kana"
    # names in Latin letters inside another script do not count against it
    other = {k: v for k, v in counts.items() if k != "latin"}
    if other and max(other.values()) * 2 > counts.get("latin", 0):
        return max(other, key=other.get)
    return max(counts, key=counts.get)


#: Not a sign of a language: quoted titles, and words in capitals with underscores.
ASIDE = re.compile(QUOTED.pattern + r"|\b[A-Z0-9]+(?:_[A-Z0-9]+)+\b")


def language_scores(text: str) -> dict[str, int]:
    """Stop words of each language."""
    out = dict.fromkeys(STOP, 0)
    for w in WORD.findall(plain(text)):
        for k in LANGUAGES_OF.get(w, ()):
            out[k] += 1
    return out


def stop_words_differ(question: str, bare: str, gold: str | None) -> bool | None:
    """Whether the stop words of the answer are of another language; None where they don't tell."""
    la, lq = language_scores(bare), language_scores(question)
    if gold:
        lg = language_scores(gold)
        lq = {k: v + min(1, lg[k]) for k, v in lq.items()}
    best, own = max(la, key=la.get), max(lq, key=lq.get)
    if la[best] < 2 or lq[own] == 0:
        return None
    same = [k for k, v in lq.items() if v == lq[own]]
    if max(la[k] for k in same) == la[best]:
        return False
    return best not in same and la[best] >= la[own] + 2 and la[best] >= 2 * max(la[k] for k in same) or None


def other_languages(pairs: list[tuple[str | None, str | None, str | None]], profiles: LanguageProfiles) -> list[bool]:
    """For each question, answer and gold answer: whether the answer is in another language than the question.

    Scripts decide where they differ.  Within a script either the stop words do, or the answer is clearly likelier in some
    other language than in the question's, and the question not; the gold answer speaks for the question's language.  An answer in a language
    without a profile is found only where one with a profile is nearer to it than the question's.
    """
    out, open_, asked, said = [False] * len(pairs), [], [], []
    for i, (q, a, g) in enumerate(pairs):
        if not q or not a or g == a:
            continue
        bare = ASIDE.sub(" ", a) if any(c in a for c in '"“«„「《_') else a
        sq, sa = script_of(q), script_of(bare)
        if not sq or not sa or g and words(g) == words(a):
            continue
        if sq != sa:
            out[i] = not {sq, sa} <= {"han", "kana"} or sa == "kana" or sq == "kana"
        elif sq == "latin" and (differ := stop_words_differ(q, bare, g)) is not None:
            out[i] = differ
        else:
            open_.append(i)
            asked.append(f"{q} {g or ''}")
            said.append(bare)
    if open_ and len(profiles.names) > 1:
        (s_q, n_q), (s_a, n_a) = profiles.scores(asked), profiles.scores(said)
        own, best, row = s_q.argmax(1), s_a.argmax(1), np.arange(len(open_))
        odds = s_a[row, best] - s_a[row, own]
        sure = s_q[row, own] - s_q[row, best] >= LEAST_ODDS_EACH * n_q
        for i, yes in zip(open_, sure & (odds >= LEAST_ODDS) & (odds >= LEAST_ODDS_EACH * n_a)):
            out[i] = bool(yes)
    return out


def unclosed(text: str) -> bool:
    """A bracket or paired quote is opened and not closed."""
    for a, b in ("()", "[]", "{}", "「」", "『』", "（）", "《》", "«»"):
        if text.count(a) > text.count(b):
            return True
    if text.count("“") > text.count("”") and text.count("„") == 0:
        return True
    if text.count('"') % 2 == 0:
        return False
    inside = False
    for m in re.finditer('"', text):
        # after a digit, with no quotation open, it is the sign of inches
        if inside or not text[: m.start()][-1:].isdigit():
            inside = not inside
    return inside


def mask(word: str) -> str:
    """Numbers, codes and capitalised names in one shape each, so that counts carry over."""
    if word.isalpha():
        return word.lower()
    if any(c.isdigit() for c in word):
        return "#" if not any(c.isalpha() for c in word) else "a#"
    return word.lower()


ENDS = re.compile(r"[^\s]+")
AROUND = "\"'“”«»()[],;:"
THAI = re.compile(r"[\u0e00-\u0e7f]+")
#: Characters at the end of a run of Thai whose following decides whether it breaks off.
THAI_TAIL = 5


def pair_counts(answer: str, into: dict[str, list[int]]) -> None:
    """Counts in ``into``, for every two neighbouring words, how often a sentence closes right after them and how often not.

    The end of an answer without closing punctuation counts for neither.  Thai has no such marks; there the
    last letters of every run count, and those inside it.
    """
    tokens = ENDS.findall(answer)
    before = tokens[0].strip(AROUND) if tokens else ""
    for i in range(1, len(tokens)):
        b = tokens[i]
        core = b.rstrip(".!?。…\"'”»)],;:")
        word = core.strip(AROUND)
        closed = b[len(core) : len(core) + 1] in (".", "!", "?", "。", "…")
        if core and (closed or i < len(tokens) - 1):
            into.setdefault(mask(before) + " " + mask(word), [0, 0])[not closed] += 1
        before = b.strip(AROUND)
    if not answer.isascii():
        for run in THAI.findall(answer):
            for k in range(len(run) - THAI_TAIL + 1):
                into.setdefault("~" + run[k : k + THAI_TAIL], [0, 0])[k < len(run) - THAI_TAIL] += 1


def last_pair(answer: str) -> str:
    tokens = ENDS.findall(answer.rstrip())
    a, b = (tokens[-2] if len(tokens) > 1 else ""), (tokens[-1] if tokens else "")
    return mask(a.strip(AROUND)) + " " + mask(b.strip(AROUND + "."))


def cut_state(answer: str, said: list[str], gold: str | None) -> str:
    """``cut``, ``whole``, ``open`` where only the counts over all answers can tell, or ``doubt`` where they have to speak for a cut."""
    t = answer.rstrip()
    if "\n" in answer.strip() and MARKER.search(answer):
        return "cut"
    last = t[-1]
    if last in ")]" and CITED.search(t, max(0, t.rfind("(" if last == ")" else "["))) and not unclosed(t):
        return "whole"
    if unclosed(t) or DANGLING.search(t[-64:]) or last in "….\"'”’»)" and re.search(r"(?:…|\.\.\.)[\"'”’»)]*$", t):
        return "cut"
    if CLOSED.search(t[-64:]) or last in "\"”»」』)]":
        return "whole"
    if not said or words(gold or "") == said or "_" in t.split()[-1]:
        return "whole"
    script = script_of(t)
    if script == "thai":
        return "doubt"
    if script not in ("han", "kana", "arabic", "devanagari", "ethiopic") and plain((SPOKEN.findall(t[-128:]) or [""])[-1]) in HANGING:
        return "cut"
    return "open"


#: Pairs a worker counts before it sends them on.
PAIRS_HELD = 200_000


def _rules(profiles: LanguageProfiles):
    """One row per answer, and rows of pair counts (null id), summed up per worker before they are sent on."""
    kind = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = ["__id", "__found", "__state", "__pair", "__end", "__mid"]

    def sent(counts):
        n = len(counts)
        ends, mids = zip(*counts.values())
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind[0]), pa.nulls(n, kind[1]), pa.nulls(n, kind[2]), pa.array(list(counts), kind[3]), pa.array(ends, kind[4]), pa.array(mids, kind[5])], names=names)

    def run(batches):
        counts: dict[str, list[int]] = {}
        for b in batches:
            ids, *columns = (b.column(k).to_pylist() for k in range(4))
            rows = []
            for i, q, a, g, other in zip(ids, *columns, other_languages(list(zip(*columns)), profiles)):
                found, state, pair = [], "whole", ""
                if is_empty(a):
                    found.append("empty")
                else:
                    said = words(a)
                    if g is not None and is_refusal(a, g):
                        found.append("refusal")
                    if q and copies_question(words(q), said):
                        found.append("copies_question")
                    if other:
                        found.append("other_language")
                    state = cut_state(a, said, g)
                    if state == "open":
                        pair = last_pair(a)
                    elif state == "doubt":
                        pair = "~" + (THAI.findall(a.rstrip()) or [""])[-1][-THAI_TAIL:]
                if a is not None:
                    pair_counts(a, counts)
                rows.append((i, found, state, pair, 0, 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(zip(*rows), kind)], names=names)
            if len(counts) > PAIRS_HELD:
                yield sent(counts)
                counts = {}
        if counts:
            yield sent(counts)

    return run


def pair_defects(answers: DataFrame, profiles: LanguageProfiles | None = None, key: str = "answer_id", question: str = "question", answer: str = "answer", gold: str = "gold_answer") -> DataFrame:
    """``key, defects array<string>, main string``: one row per pair, ``main`` null where there is no defect.

    ``key`` is a whole number.  ``profiles`` tell languages of one script apart; without them only scripts are compared.  A repeated
    row counts once; rows with a null key are left out; a null question can neither be copied nor differ in language; a
    null gold answer means that the question can't be answered, so declining is right.  Other columns are ignored; an
    empty table gives an empty result.  The rules and the counts of the words that close sentences are made in one pass and
    stored; the counts are joined by pair, not broadcast.
    """
    profiles = profiles or LanguageProfiles([], np.zeros((0, 0), dtype=np.float32))
    one = (answers.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("__id"))
           .agg(F.min(F.struct(F.col(question).alias("q"), F.col(answer).alias("a"), F.col(gold).alias("g"))).alias("__r")).select("__id", "__r.q", "__r.a", "__r.g"))
    both = stored(one.mapInArrow(_rules(profiles), "__id long, __found array<string>, __state string, __pair string, __end long, __mid long"))
    judged = both.where("__id is not null").select("__id", "__found", "__state", "__pair")
    counts = both.where("__id is null").groupBy("__pair").agg(F.sum("__end").alias("__end"), F.sum("__mid").alias("__mid"))
    undecided = judged.where("__state in ('open', 'doubt')").select("__id", "__state", "__pair").join(counts, "__pair", "left")
    end, mid = F.coalesce("__end", F.lit(0)), F.coalesce("__mid", F.lit(0))
    cut = undecided.where((end < mid) | ((end + mid == 0) & (F.col("__state") == "open"))).select("__id", F.lit(True).alias("__cut"))
    out = judged.join(cut, "__id", "left")
    broken = (F.col("__state") == "cut") | F.coalesce(F.col("__cut"), F.lit(False))
    defects = F.when(broken, F.concat("__found", F.array(F.lit("truncated")))).otherwise(F.col("__found"))
    return out.select(F.col("__id").alias(key), defects.alias("defects"), F.get(defects, F.lit(0)).alias("main"))


ships(__name__)

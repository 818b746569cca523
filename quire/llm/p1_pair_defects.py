"""Problem 1: prompt and response pairs that are broken, with one defect type each.

Prompt and response are compared by their language posteriors. A naive Bayes classifier over character bigrams scores every
prompt and every response whole, in batches; its classes are languages and, per language, refusals. They are learned from
the example texts below and from the whole corpus: the bigrams of all prompts, responses and labelled documents are counted by
the tasks and only their sums come to the driver. A response in the wanted language is searched for the sentence
that speaks most for a refusal, wherever it stands; any other is compared with its prompt: where both posteriors agree it is a
copy if it repeats the prompt's words. What is left after names, numbers and signs that both share are set aside is a refusal or
in the wrong language.

Whether a response stops inside a sentence is told by end-of-text n-gram likelihood: how often the last characters (up to
``END_ORDER``) end a sentence in all responses, against how often they stand inside one. An end mark speaks for an end, a
missing one against it, each by a fixed weight; so a whole sentence that lacks its mark is whole, and one broken off and
closed with a mark is cut, if the likelihood is clear enough.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Count, pick, table, tally, tally_here
from .p3_lookalike import transducer

#: Most that what a class has seen after a character counts; the rest is left for what it hasn't.
MOST_TRUST = 0.99
#: Log odds of a refusal that some sentence of a Chinese response has to exceed.
REFUSAL_ODDS = 10.0
#: Longest end of a text whose likelihood is known.
END_ORDER = 6
#: Log odds of an end that an end mark adds, and that a missing one takes.
MARK_ODDS, NO_MARK_ODDS = 5.0, -5.0
#: Responses that stand for "nothing" (fixed values, compared without signs and in lower case).
PLACEHOLDERS = frozenset(
    ("na", "n/a", "nil", "nan", "null", "none", "nothing", "empty", "blank", "tbd", "todo", "undefined", "untranslated", "placeholder", "missing", "xxx",
     "no translation", "not available", "not translated",
     "空", "无", "無", "空白", "暂无", "无内容", "无译文", "待译", "待翻译", "待补", "未翻译", "未译", "略", "占位", "占位符")
)

#: Example texts of languages.
LANGUAGES = {
    "zh": "这项研究提出了一种新的方法，并在三个数据集上进行了测试。我们认为结果是可靠的，但仍需要更多的实验。表中列出了各个模型的准确率。由于时间有限，没有讨论其他情况。该系统在实际道路上运行稳定，误差很小。",
    "en": "This study presents a new method and tests it on three data sets. We believe that the results are reliable, although more experiments are needed. The table lists the accuracy of each model. Here the text explains how the system works and what the authors found. Summary of the passage and its effect.",
    "ja": "この研究では新しい手法を提案し、三つのデータセットで検証した。結果は信頼できると考えられるが、さらに実験が必要である。表に各モデルの精度を示す。システムは実際の道路でも安定して動作しました。これは翻訳ではありません。",
    "ko": "이 연구는 새로운 방법을 제안하고 세 가지 데이터 집합에서 시험하였다. 결과는 신뢰할 수 있다고 생각하지만 더 많은 실험이 필요하다. 표에는 각 모델의 정확도를 나타내었다. 시스템은 실제 도로에서도 안정적으로 동작합니다.",
    "ru": "В этой работе предложен новый метод, который проверен на трёх наборах данных. Мы считаем результаты надёжными, однако нужны дополнительные опыты. В таблице приведена точность каждой модели. Система устойчиво работает на дороге.",
    "de": "Diese Arbeit stellt ein neues Verfahren vor und prüft es an drei Datensätzen. Wir halten die Ergebnisse für zuverlässig, obwohl weitere Versuche nötig sind. Die Tabelle zeigt die Genauigkeit der einzelnen Modelle. Das System läuft auch auf der Straße stabil und ohne große Fehler.",
    "fr": "Cette étude présente une nouvelle méthode et la teste sur trois jeux de données. Nous pensons que les résultats sont fiables, mais d'autres expériences sont nécessaires. Le tableau donne la précision de chaque modèle. Le système reste stable sur la route et l'erreur est faible.",
    "es": "Este estudio presenta un método nuevo y lo prueba en tres conjuntos de datos. Creemos que los resultados son fiables, aunque hacen falta más experimentos. La tabla muestra la precisión de cada modelo. El sistema funciona de forma estable en la carretera y los errores son pequeños.",
    "it": "Questo studio presenta un nuovo metodo e lo prova su tre insiemi di dati. Crediamo che i risultati siano affidabili, ma servono altri esperimenti. La tabella riporta la precisione di ogni modello. Il sistema rimane stabile sulla strada.",
    "pt": "Este estudo apresenta um novo método e o testa em três conjuntos de dados. Acreditamos que os resultados são confiáveis, mas são necessários mais experimentos. A tabela mostra a precisão de cada modelo. O sistema não apresenta falhas na estrada.",
    "nl": "Deze studie beschrijft een nieuwe methode en test die op drie verzamelingen gegevens. Wij denken dat de resultaten betrouwbaar zijn, hoewel meer proeven nodig zijn. De tabel geeft de nauwkeurigheid van elk model.",
    "pl": "W tej pracy przedstawiono nową metodę i sprawdzono ją na trzech zbiorach danych. Uważamy, że wyniki są wiarygodne, choć potrzebne są dalsze badania. Tabela podaje dokładność każdego modelu.",
    "vi": "Nghiên cứu này trình bày một phương pháp mới và thử nghiệm trên ba tập dữ liệu. Chúng tôi cho rằng kết quả đáng tin cậy, nhưng cần thêm thí nghiệm. Bảng cho biết độ chính xác của từng mô hình.",
    "ar": "تقدم هذه الدراسة طريقة جديدة وتختبرها على ثلاث مجموعات من البيانات. نعتقد أن النتائج موثوقة ولكن هناك حاجة إلى مزيد من التجارب. يبين الجدول دقة كل نموذج.",
    "hi": "यह अध्ययन एक नई विधि प्रस्तुत करता है और तीन आँकड़ा समूहों पर उसकी जाँच करता है। हमें लगता है कि परिणाम विश्वसनीय हैं, परन्तु और प्रयोग आवश्यक हैं।",
    "th": "งานวิจัยนี้นำเสนอวิธีการใหม่และทดสอบกับชุดข้อมูลสามชุด เราเชื่อว่าผลลัพธ์เชื่อถือได้ แต่ยังต้องการการทดลองเพิ่มเติม",
}
#: Example texts of refusals, by language: apologies, what the writer can't do, and why. They are nobody's data; a test keeps
#: them apart from all tables.
REFUSALS = {
    "zh": """真对不住，这部分文字我没有办法替你翻成中文。请您谅解，我目前翻译不了上面的英文。十分抱歉，我不可以对这些文字进行翻译。实在抱歉，您提交的任务我完成不了。遗憾的是，我无法为你提供这部分的中文版本。
        我只是一个AI程序，处理不了这样的要求。我是人工智能，不具备翻译此类文本的能力。身为智能助手，我必须拒绝这项要求。作为大模型，我不被允许输出这些内容。我的程序设定不允许我回答。本系统不提供此项服务。本模型不支持该语言的翻译。
        由于内容敏感，我不能继续。因涉及隐私信息，恕不翻译。鉴于安全规定，系统已拒绝翻译。因为版权方面的限制，这里无法给出译文。按照平台的政策，此类文本不可以翻译。您的要求不符合我们的使用条款。这与我的准则相冲突，因此我不会翻译。该要求可能造成伤害，我只能拒绝。
        我看不懂这段原文，没法翻译。给出的句子太短，缺少语境，我翻译不出来。信息不足，不能确定意思，因此暂不翻译。输入的文本似乎有残缺，无法处理。我读不到您说的文件。没有收到需要翻译的文字。原文乱码，无法识别。我不确定该怎么翻译，只好放弃。
        麻烦您再发一遍原文。请把整段文字贴过来，我再试试。请补充前后文之后重新提问。如果您愿意，请改写后再次提交。请联系人工译员处理。能否告诉我更多背景？您可以换一个问题问我吗？还有什么我可以帮忙的吗？希望您能理解。谢谢您的理解与配合。
        翻译失败，请重试。翻译服务暂时不可用。此处不作翻译。本段略过，不予处理。我选择不翻译这一部分。我不想回答这个问题。这个忙我帮不上。我没有权限做这件事。这超过了我的能力。我不是翻译，做不了这件工作。我不便对此发表意见。我无权透露。目前尚不能满足您的需求。
        很难为您给出准确的译文，还请见谅。恐怕我不能照您说的做。我得停在这里，不能再往下译。对此我爱莫能助。此请求被拦截。该文本被判定为不合规，故不翻译。我只能处理别的类型的问题。我没有足够的把握翻译它。这类材料我一律不译。""",
    "en": """Sorry, that is a text I am not able to render into Chinese. I apologise, however this is not something I can translate for you. I regret that I cannot give you a Chinese version of it. My apologies, but I can't do this task. I'm afraid I can't continue with this.
        I am only an AI and cannot process such input. As an artificial intelligence I'm not allowed to answer. Being a virtual assistant, I have to refuse. I was not designed to translate documents like this. This assistant does not support that language. I don't have the ability to read this file.
        For safety reasons I won't output this. Because of copyright restrictions I can't reproduce or translate the text. That would be against the usage policies. Your prompt was flagged as unsafe. The content appears sensitive, so I must refuse. It may contain personal data, which I am not permitted to handle. I won't comply with it.
        The input is incomplete and I cannot tell what it means. There is not enough context to translate the sentence. I could not find any text to translate. It seems the source got cut off; can you resend it? Please send the whole paragraph and I'll try again. Could you provide more details? Please rephrase your question. Kindly contact a human translator.
        Translation is unavailable. Translation failed, please retry later. I will skip this part. I'd rather not answer this. No output was generated. I'm not comfortable with providing it. I have no permission to do so. That is outside my capabilities. Is there anything else you need? Feel free to ask me something different. Thanks for understanding. I would prefer not to do that.
        It is not possible for me to produce a translation here. We are unable to fulfil your request at this time. This type of material can't be processed. I have been instructed not to respond. Declined. Request blocked. The model cannot answer. Access denied, nothing was translated.""",
    "de": "Entschuldigung, das kann ich nicht ins Chinesische übertragen. Tut mir sehr leid, dabei darf ich Ihnen nicht behilflich sein. Ich bin nur eine KI und kann das nicht leisten. Als KI-Assistent muss ich das ablehnen. Aus Sicherheitsgründen gebe ich keine Übersetzung. Das widerspricht den Nutzungsbedingungen. Der Text ist unvollständig, bitte schicken Sie den ganzen Absatz. Leider ist mir eine Übersetzung nicht möglich. Ich kann Ihre Anfrage nicht bearbeiten. Bitte formulieren Sie Ihre Frage anders. Haben Sie noch eine andere Frage? Dazu fehlt mir der Zusammenhang.",
    "fr": "Pardon, je ne suis pas capable de rendre ce texte en chinois. Je regrette, il m'est impossible de répondre à votre demande. Je ne suis qu'une IA et je ne peux pas le faire. En tant qu'assistant, je dois refuser. Pour des raisons de sécurité, aucune traduction n'est fournie. Cela est contraire aux conditions d'utilisation. Le texte est incomplet, merci d'envoyer le paragraphe entier. Malheureusement, je ne peux pas traduire cela. Pourriez-vous reformuler votre question ? Puis-je vous aider pour autre chose ? Il me manque du contexte.",
    "es": "Disculpe, no soy capaz de pasar este texto al chino. Lamento no poder atender su petición. Soy solo una IA y no puedo hacerlo. Como asistente debo negarme. Por razones de seguridad no doy ninguna traducción. Eso incumple las condiciones de uso. El texto está incompleto, le ruego que mande el párrafo entero. Desgraciadamente no me es posible traducirlo. ¿Podría formular la pregunta de otra manera? ¿Necesita algo más? Me falta contexto.",
    "it": "Mi dispiace, non posso tradurre questo testo. Purtroppo non sono in grado di aiutarla con questa richiesta. Sono solo una IA e non posso farlo. Come assistente devo rifiutare. Per motivi di sicurezza non fornisco la traduzione. Il testo è incompleto, la prego di inviare tutto il paragrafo.",
    "pt": "Desculpe, não consigo traduzir este texto. Infelizmente não posso ajudar com esse pedido. Sou apenas uma IA e não posso fazer isso. Como assistente, devo recusar. Por motivos de segurança não forneço a tradução. O texto está incompleto, envie o parágrafo inteiro.",
    "ja": "ごめんなさい、このテキストは訳せません。恐れ入りますが、その内容は翻訳いたしかねます。私はAIなので、それはできません。アシスタントとしてお断りしなければなりません。安全上の理由により訳文を出力しません。利用規約に反するため対応できません。原文が途中で切れているので、全文を送ってください。残念ながらお手伝いできません。質問を変えていただけますか。ほかにご質問はありますか。情報が不足しています。",
    "ko": "미안합니다, 이 글을 중국어로 옮길 수 없습니다. 유감스럽게도 그 요청은 처리할 수 없습니다. 저는 인공지능이라서 그렇게 할 수 없습니다. 도우미로서 거절해야 합니다. 안전상의 이유로 번역을 제공하지 않습니다. 이용 약관에 어긋납니다. 원문이 불완전하니 전체 단락을 보내 주십시오. 질문을 바꿔 주시겠습니까? 다른 도움이 필요하십니까?",
    "ru": "Простите, я не в состоянии перевести этот текст на китайский. Сожалею, но выполнить ваш запрос невозможно. Я всего лишь искусственный интеллект и не умею этого. Как помощник я вынужден отказаться. По соображениям безопасности перевод не даётся. Это противоречит правилам использования. Текст неполный, пришлите весь абзац. Не могли бы вы задать вопрос иначе? Могу ли я помочь чем-то ещё? Мне не хватает контекста.",
}

_SCRIPTS = [(name, regex.compile(rf"\p{{{name}}}")) for name in ("Latin", "Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Greek", "Arabic", "Devanagari", "Thai", "Hebrew")]
#: About how many letters each script has.
_SIZES = {"Latin": 120, "Han": 5000, "Hiragana": 80, "Katakana": 80, "Hangul": 2000, "Cyrillic": 66, "Greek": 60, "Arabic": 50, "Devanagari": 80, "Thai": 70, "Hebrew": 30, "": 30}
_NAMES = list(_SIZES)


def script(c: str) -> str:
    """The script of a letter, '' for other characters."""
    return next((name for name, p in _SCRIPTS if p.match(c)), "") if c.isalpha() else ""


_DIGITS = re.compile(r"\d+")


def read(text: str) -> str:
    """Lower case, numbers as 0, blanks as one, a blank at both ends."""
    return f" {' '.join(_DIGITS.sub('0', text.lower()).split())} "


class NgramClasses:
    """Naive Bayes over character bigrams, smoothed by single characters and by scripts; texts are scored in batches.

    The log probability of a bigram is a table entry if some class knows the bigram, else the sum of a term of its first and
    one of its second character.
    """

    @staticmethod
    def count(texts: list[str]) -> Counter:
        """The bigrams of ``texts``."""
        codes = np.frombuffer("\n".join(map(read, texts)).encode("utf-16-le", "surrogatepass"), np.uint16)
        usable = (codes != 10) & (codes >> 11 != 0x1B)  # neither between texts nor half a character
        both = usable[:-1] & usable[1:]
        found, times = np.unique((codes[:-1][both].astype(np.uint32) << 16) | codes[1:][both], return_counts=True)
        pairs = (chr(c >> 16) + chr(c & 0xFFFF) for c in found.tolist())
        return Counter({p: n for p, n in zip(pairs, times.tolist()) if p.isprintable()})

    def __init__(self, examples: dict[str, list[str] | Counter]):
        """``examples``: texts of each class, or their counted bigrams."""
        self.classes = list(examples)
        counted = [x if isinstance(x, Counter) else self.count(x) for x in examples.values()]
        known = sorted({p for pairs in counted for p in pairs})
        chars = sorted({c for p in known for c in p})
        place = {c: i for i, c in enumerate(chars)}
        width, size = len(self.classes), len(chars)
        self.chars = np.array([ord(c) for c in chars], np.uint16)
        first = np.array([place[p[0]] for p in known], np.int64)
        second = np.array([place[p[1]] for p in known], np.int64)
        self.codes = (self.chars[first].astype(np.uint32) << 16) | self.chars[second]
        of = np.array([_NAMES.index(script(c)) for c in chars], np.int64)
        letters = np.array([_SIZES[n] for n in _NAMES], np.float64)
        self.pairs = np.zeros((len(known), width), np.float32)
        self.firsts = np.zeros((size + len(_NAMES), width), np.float32)  # the last rows are for characters that no class knows
        self.seconds = np.zeros((size + len(_NAMES), width), np.float32)
        for k, pairs in enumerate(counted):
            n = np.array([pairs[p] for p in known], np.float64)
            begun, single = np.bincount(first, n, size), np.bincount(second, n, size)
            scripts = np.bincount(of, single, len(_NAMES))
            total = max(scripts.sum(), 1.0)
            shares = (scripts + 0.001 * total) / (1.012 * total) / letters
            alone = np.r_[0.9 * single / total, np.zeros(len(_NAMES))] + 0.1 * np.r_[shares[of], shares]
            # trust in a bigram grows with what is known of its first character, up to ``MOST_TRUST``: else whatever a class hasn't seen
            # would count against it the more, the more it has been told
            held = np.r_[np.minimum(begun / (begun + 8.0), MOST_TRUST), np.zeros(len(_NAMES))]
            self.firsts[:, k], self.seconds[:, k] = np.log1p(-held), np.log(alone)
            joint = held[first] * n / np.maximum(begun[first], 1) + (1 - held[first]) * alone[second]
            self.pairs[:, k] = np.log(joint)
        self._place: np.ndarray | None = None
        self._slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None, "_slots": None}

    def _known(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each bigram in ``pairs``, -1 if no class knows it; by hash, and by search where two known ones share a slot."""
        size = len(self.codes)
        if not size:
            return np.full(len(wanted), -1, np.int32)
        shift = np.uint32(32 - min(22, size.bit_length() + 4))

        def slot(codes: np.ndarray) -> np.ndarray:
            return (codes * np.uint32(2654435769)) >> shift

        if self._slots is None:
            self._slots = np.full(1 << (32 - int(shift)), -1, np.int32)
            self._slots[slot(self.codes)] = np.arange(size, dtype=np.int32)
            self._hidden = np.flatnonzero(self._slots[slot(self.codes)] != np.arange(size)).astype(np.int32)
        row = self._slots[slot(wanted)]
        miss = np.flatnonzero(self.codes[row] != wanted)  # an empty slot, -1, reads the last code, which hasn't this slot
        row[miss] = -1
        if len(self._hidden) and len(miss):
            known = self.codes[self._hidden]
            at = np.minimum(np.searchsorted(known, wanted[miss]), len(known) - 1)
            hit = known[at] == wanted[miss]
            row[miss[hit]] = self._hidden[at[hit]]
        return row

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each character in ``firsts`` and ``seconds``."""
        if self._place is None:
            names = np.array([_NAMES.index(script(chr(c))) if not 0xD800 <= c < 0xE000 else 1 for c in range(0x10000)], np.int32)
            self._place = names + len(self.chars)
            self._place[self.chars] = np.arange(len(self.chars))
        return self._place[codes]

    def bigrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, known row or -1, first, second) of all bigrams of ``texts``."""
        codes = np.frombuffer("\n".join(map(read, texts)).encode("utf-16-le", "replace"), np.uint16)
        breaks = codes == 10
        owner = np.cumsum(breaks)
        keep = np.flatnonzero(~(breaks[:-1] | breaks[1:]))
        a, b = codes[keep], codes[keep + 1]
        return owner[keep], self._known((a.astype(np.uint32) << 16) | b), self._rows(a), self._rows(b)

    @staticmethod
    def _groups(texts: list[str], most: int = 50_000) -> Iterator[tuple[int, int]]:
        """(from, to) of neighbouring texts with about ``most`` characters, so that their arrays stay in a processor's cache."""
        lo = size = 0
        for hi, text in enumerate(texts, 1):
            size += len(text)
            if size >= most or hi == len(texts):
                yield lo, hi
                lo, size = hi, 0

    def scores(self, texts: list[str], step: int = 8000) -> np.ndarray:
        """Log likelihoods (text, class)."""
        out = np.zeros((len(texts), len(self.classes)), np.float64)
        for lo, hi in self._groups(texts):
            owner, row, first, second = self.bigrams(texts[lo:hi])
            for k in range(0, len(owner), step):
                o, r = owner[k : k + step], row[k : k + step]
                each = self.pairs[r]
                odd = np.flatnonzero(r < 0)
                each[odd] = self.firsts[first[k : k + step][odd]] + self.seconds[second[k : k + step][odd]]
                starts = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                out[lo + o[starts]] += np.add.reduceat(each, starts, axis=0)
        return out

    def odds(self, texts: list[str], of: str, against: str) -> np.ndarray:
        """Log odds of ``of`` against ``against`` of each text."""
        out = np.zeros(len(texts))
        i, j = self.classes.index(of), self.classes.index(against)
        pairs, firsts, seconds = (x[:, i] - x[:, j] for x in (self.pairs, self.firsts, self.seconds))
        for lo, hi in self._groups(texts):
            owner, row, first, second = self.bigrams(texts[lo:hi])
            out[lo:hi] = np.bincount(owner, np.where(row >= 0, pairs[row], firsts[first] + seconds[second]), hi - lo)
        return out


_CJK_END = "。！？!?"
_CLOSERS = "”’\"'」』）)】》〉] \t\n\r\u3000\u200b\u200c\u200d\u2060\ufeff\xad"
_WORDS = re.compile(r"[^\W\d_]+")
_TOKENS = re.compile("[A-Za-z0-9À-ɏ]+(?:[-‐‑][A-Za-z0-9À-ɏ]+)*")
_LETTER = re.compile(r"[^\W_]")
_LATIN_WORD = re.compile("[A-Za-zÀ-ɏ]{2,}")
#: Kana, Hangul, Cyrillic, Hebrew, Arabic, Devanagari, Thai.
_OTHER_SCRIPT = re.compile("[Ѐ-ԯ\u0590-ۿऀ-ॿ\u0e00-\u0e7fぁ-ゟァ-ヺᄀ-ᇿ가-힣]")
_HAN = re.compile("[⺀-⿕々-〇㐀-鿿豈-\ufaff\U00020000-\U0003ffff]+")
_QUOTED = re.compile(r"[“\"「][^”\"」]{0,80}[”\"」]")
_KEYWORD_LINE = re.compile(r"^\s*(?:关键词|关键字|关键詞|主题词|索引词)\s*[:：]")
_EN_KEYWORDS = re.compile(r"^\s*(?:key\s?words|index terms)\s*[:：]", re.I)
_EN_CAPTION = re.compile(r"^\s*(?:table|tab\.|fig\.|figure)\s*\d+[.:]", re.I)
#: What may follow the end mark of an English sentence: blanks and closing signs.
_EN_CLOSERS = "".join(re.findall(r"\s", "".join(map(chr, range(0x3001))))) + "'\"”’)]\xad\u200b\u200c\u200d\u2060\ufeff"
_EN_OPEN = re.compile(r"\b(?:fig|figs|al|approx|eq|tab|vs|e\.g|i\.e|cf)\.[\s]*$", re.I)
_ASIDE = re.compile(r"[\s“”\"‘’'「」『』（）()【】《》〈〉\[\]]+")
_SENTENCE_ENDS = re.compile("[。！？!?\\n]+")
_END_MARK = re.compile(f"[{_CJK_END}]")
_NUMBERS = re.compile(r"\d[\d,]*(?:\.\d+)?")


def _han(text: str) -> int:
    return len(text) - len(_HAN.sub("", text))


def _unmarked(text: str) -> str:
    """Names as A, numbers as 0, no blanks, quotes and brackets: what an ending is compared by."""
    return _ASIDE.sub("", _NUMBERS.sub("0", _TOKENS.sub(lambda m: m[0] if m[0].isdigit() else "A", text)))


def _wordings(text: str) -> list[str]:
    """The sentences of a text without names, numbers and quotations."""
    return [s for s in _SENTENCE_ENDS.split(_TOKENS.sub("", _QUOTED.sub("", text))) if _LETTER.search(s)]


def _ends(text: str) -> bool:
    """Whether an English text ends with an end mark."""
    return text.rstrip(_EN_CLOSERS).endswith((".", "?", "!"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _tail(response: str) -> str:
    """What a response ends with, without end marks."""
    return response.rstrip(_CJK_END + ".…,，;；:：、" + _CLOSERS)


class Runs:
    """The runs of up to ``order`` characters that some tail ends with: no other is ever looked up for these tails."""

    def __init__(self, tails: list[str], order: int = END_ORDER):
        tails = [t for t in tails if t]
        ends = np.cumsum([len(t) for t in tails], dtype=np.int64)
        codes, size = _codes("".join(tails)), np.array([len(t) for t in tails], np.int64)
        run = np.zeros(len(tails), np.int64)
        self.levels: list[np.ndarray] = []
        for n in range(1, order + 1):
            ends, size, run = ends[size >= n], size[size >= n], run[size >= n]
            keys, run = np.unique((run << 21) | codes[ends - n], return_inverse=True)
            self.levels.append(keys)

    def find(self, n: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``key``, their numbers) of the runs of ``n`` characters that are known; ``key``: number of the run less its first character, and this."""
        known = self.levels[n - 1]
        if not len(known):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        number = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = np.flatnonzero(known[number] == key)
        return hit, number[hit]


class Endings:
    """How often the last characters of a text end a sentence, interpolated over all lengths up to ``order``."""

    def __init__(self, texts: list[str] | dict[str, Counter], order: int = END_ORDER):
        """``texts``: texts, or what ``count`` counted in them."""
        self.order = order
        counted = texts if isinstance(texts, dict) else self.count(texts, order)
        ended = counted.get("ended", {})
        #: (times seen, times at an end) of what was seen twice or more.
        self.known = {gram: (n, ended.get(gram, 0)) for gram, n in counted.get("seen", {}).items() if n > 1 or not gram}

    @staticmethod
    def count(texts: list[str], order: int = END_ORDER, runs: Runs | None = None) -> dict[str, Counter]:
        """How often each run of up to ``order`` characters inside a sentence is 'seen', and how often an end mark follows ('ended');
        only those of ``runs``, if given."""
        bodies: Counter = Counter()
        for text in texts:
            *closed, rest = _END_MARK.split(_unmarked(text.rstrip(_CLOSERS)))
            bodies.update((body, True) for body in closed if body)
            if len(rest) > 1:
                bodies[rest[:-1], False] += 1  # nobody knows what follows the last character
        seen: Counter = Counter()
        ended: Counter = Counter()
        if not bodies:
            return {"seen": seen, "ended": ended}
        text = "".join(b for b, _ in bodies)
        codes = _codes(text)
        size = np.array([len(b) for b, _ in bodies])
        starts = np.cumsum(size) - size
        times = np.repeat(np.array([*bodies.values()], np.int64), size)
        closes = np.zeros(len(codes), np.int64)
        closes[(starts + size - 1)[[c for _, c in bodies]]] = 1
        closes *= times
        inside = np.arange(len(codes)) - np.repeat(starts, size)  # characters before this one
        seen[""], ended[""] = int(times.sum()), int(closes.sum())
        at, run = np.arange(len(codes)), np.zeros(len(codes), np.int64)  # where a run of n characters ends, and its number
        for n in range(1, order + 1):
            longer = inside[at] >= n - 1
            at, run = at[longer], run[longer]
            key = (run << 21) | codes[at - n + 1]
            if runs is None:
                run = np.unique(key, return_inverse=True)[1]
            else:
                hit, run = runs.find(n, key)
                at = at[hit]
            if not len(at):
                break
            last = np.zeros(run.max() + 1, np.int64)
            last[run] = at
            # whole numbers below 2**53: the sums are exact
            total, at_end = np.bincount(run, times[at]).astype(np.int64).tolist(), np.bincount(run, closes[at]).astype(np.int64).tolist()
            for end, all_, k in zip(last.tolist(), total, at_end):
                if all_:
                    gram = text[end - n + 1 : end + 1]
                    seen[gram] = all_
                    if k:
                        ended[gram] = k
        return {"seen": seen, "ended": ended}

    def _shares(self, text: str, trust: float = 2.0) -> tuple[float, float]:
        """(P(end | last characters of ``text``), P(inside)); halves if nothing is known. Each is summed by itself, as one may be too near 1."""
        s = _unmarked(text[-60:])
        n, k = self.known.get("", (0, 0))
        p, q = (k + 0.5) / (n + 1.0), (n - k + 0.5) / (n + 1.0)
        for size in range(1, min(self.order, len(s)) + 1):
            n, k = self.known.get(s[-size:], (0, 0))
            if not n:
                break
            p, q = (k + trust * p) / (n + trust), (n - k + trust * q) / (n + trust)
        return p, q

    def probability(self, text: str) -> float:
        """P(end | last characters of ``text``); 0.5 if nothing is known."""
        return self._shares(text)[0]

    def odds(self, text: str) -> float:
        """Log odds of an end after ``text``, no end or inside being likelier beforehand."""
        p, q = self._shares(text)
        n, k = self.known.get("", (0, 0))
        return float(np.log(p) - np.log(q) - np.log((k + 0.5) / (n - k + 0.5)))


def _answers(texts: list[str]) -> list[str]:
    """The responses that are mostly Chinese."""
    return [z for z in texts if z and _han(z) >= 0.3 * len(z) and not _OTHER_SCRIPT.search(z)]


def _count_texts(part: pd.DataFrame, held: Counter) -> None:
    """Bigrams of every class, and the 'tail's of the responses; ``part``: see ``PairModel.learned``."""
    for name, texts in part.groupby("name")["text"]:
        texts = [t for t in texts if t]
        if name == "response":
            held.update(("tail", _unmarked(_tail(z)[-60:])[-END_ORDER:]) for z in texts)
            texts = _answers(texts)
        elif name == "zh":
            texts = [x for z in texts for x in _wordings(z)]
        for pair, n in NgramClasses.count(texts).items():
            held[name, pair] += n


def _count_chinese(learned: tuple[NgramClasses, Runs | None] | Broadcast, least: float | None) -> Count:
    """Bigrams of the responses whose log odds of a refusal are at most ``least`` ('pair'). Without ``least``, of those at most 0,
    how many responses have which odds ('odds', in hundredths rounded up, 0 for all that are less), and what ``Endings`` counts."""

    def count(part: pd.DataFrame, held: Counter) -> None:
        model, runs = learned.value if isinstance(learned, Broadcast) else learned
        answers = _answers(part["text"][part["name"] == "response"].tolist())
        split = [s for z in answers if (s := _wordings(z))]
        odds = model.odds(["。".join(s) for s in split], "refusal zh", "zh")
        if least is None:
            for o, n in zip(*np.unique(np.ceil(np.maximum(odds, 0) * 100).astype(np.int64), return_counts=True)):
                held["odds", str(o)] += int(n)
            for kind, grams in Endings.count(answers, runs=runs).items():
                for gram, n in grams.items():
                    held[kind, gram] += n
        for pair, n in NgramClasses.count([x for s, o in zip(split, odds) if o <= (least or 0.0) for x in s]).items():
            held["pair", pair] += n

    return count


def _least(odds: Counter, share: float = 0.8) -> float:
    """The least odds, 0 or more, in hundredths, that ``share`` of the responses don't exceed."""
    wanted, so_far = share * odds.total(), 0
    for o in sorted(odds, key=int):
        so_far += odds[o]
        if so_far >= wanted:
            return int(o) / 100
    return 0.0


class PairModel:
    """The classifier and the end-of-text model, learned from examples and pairs (prompt, response)."""

    def __init__(self, pairs: list[tuple[str, str]], labelled: dict[str, list[str]] | None = None, refusals: dict[str, str] | None = None):
        rows = [("en", t) for t, _ in pairs] + [("response", z) for _, z in pairs] + [(name, t) for name, texts in (labelled or {}).items() if name != "en" for t in texts]
        held = pd.DataFrame(rows, columns=["name", "text"])
        self._learn(lambda count: tally_here(held, count), lambda learned: learned, refusals, None)

    @classmethod
    def learned(cls, texts: DataFrame) -> PairModel:
        """The models from all rows (name, text) of ``texts``: prompts are named 'en', responses 'response', other texts by their language.

        One pass counts every text, two more (three, if the first finds too few Chinese responses) the Chinese responses; the driver
        gets each bigram and each run of up to ``END_ORDER`` characters that some response ends with once, with its sum. So the
        likelihood of endings is known for these responses; a model of ``PairModel(pairs)`` knows it for others too.
        """
        model = cls.__new__(cls)
        responses = texts.where("name = 'response'")
        sent: list[Broadcast] = []

        def send(learned: tuple[NgramClasses, Runs | None]) -> Broadcast:
            sent.append(texts.sparkSession.sparkContext.broadcast(learned))
            return sent[-1]

        model._learn(lambda count: tally(texts if count is _count_texts else responses, count), send, None, Runs)
        for held in sent:
            held.destroy()
        return model

    def _learn(self, run: Callable[[Count], dict[str, Counter]], send: Callable, refusals: dict[str, str] | None, runs_of: type[Runs] | None) -> None:
        counted = run(_count_texts)
        told = {f"refusal {name}": [s for s in re.split(r"(?<=[。.?!])\s*", text) if s] for name, text in (refusals or REFUSALS).items()}
        # the responses hold refusals themselves: Chinese texts that aren't responses tell first which responses are Chinese
        # as a whole; where they tell too little, four fifths of the responses are taken to be
        examples = {name: NgramClasses.count([text] * 3) for name, text in LANGUAGES.items()}
        fixed = {name: pairs + counted.get(name, Counter()) for name, pairs in examples.items()}
        fixed |= {"zh text": examples["zh"] + counted.get("response", Counter())} | {name: NgramClasses.count(texts) for name, texts in told.items()}
        chinese: Counter = Counter()
        self.languages = NgramClasses(fixed)
        runs = runs_of([*counted.get("tail", ())]) if runs_of else None
        for n in range(2):
            learned = send((self.languages, runs if n == 0 else None))
            found = run(_count_chinese(learned, None if n == 0 else 0.0))
            if n == 0:
                self.ends = Endings(found)
                if (least := _least(found.get("odds", Counter()))) > 0:
                    found = run(_count_chinese(learned, least))
            chinese = found.get("pair", Counter())
            self.languages = NgramClasses({**fixed, "zh": fixed["zh"] + chinese})
        at = {name: i for i, name in enumerate(self.languages.classes)}
        # refusals of which only a few example sentences are known have to be told by a margin per character
        self.margin = np.array([0.7 if c.startswith("refusal") and c not in ("refusal zh", "refusal en") else 0.0 for c in self.languages.classes])
        self._spoken = [i for c, i in at.items() if not c.startswith("refusal") and c != "zh"]
        self._zh = self._spoken.index(at["zh text"])

    def refusal_odds(self, responses: list[str]) -> np.ndarray:
        """Log odds of a refusal against Chinese text, of the sentence of each response that speaks most for it."""
        split = [_wordings(z) for z in responses]
        odds = self.languages.odds([x for s in split for x in s], "refusal zh", "zh")
        ends = np.cumsum([len(s) for s in split])
        return np.array([odds[b - len(s) : b].max() if s else 0.0 for s, b in zip(split, ends)])

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """P(language | text), all languages being equally likely beforehand."""
        s = self.languages.scores(texts)[:, self._spoken]
        s = np.exp(s - s.max(axis=1, keepdims=True)) if len(texts) else s
        return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-300)

    def defects(self, prompts: list[str | None], responses: list[str | None]) -> list[str | None]:
        """The defect of each pair, or None. A null prompt has no words; a null response is empty."""
        out = [self._empty(p, z) for p, z in zip(prompts, responses)]
        rows = [n for n, (found, z) in enumerate(zip(out, responses)) if found is None and z is not None and _LETTER.search(z)]
        ps, zs = [prompts[n] or "" for n in rows], [responses[n] for n in rows]
        p_of, z_of = self.posteriors(ps), self.posteriors(zs)
        # in the wanted language: some letters of it, and the posterior leaves no doubt; else both are compared in detail
        chinese = [bool(_HAN.search(z)) and z_of[k, self._zh] > 0.999 and not _OTHER_SCRIPT.search(z) for k, z in enumerate(zs)]
        for k, n in enumerate(rows):
            if not chinese[k]:
                out[n] = self._foreign(ps[k], zs[k], p_of[k])
        left = [k for k, n in enumerate(rows) if out[n] is None and _HAN.search(zs[k])]
        for k, x in zip(left, self.refusal_odds([zs[k] for k in left])):
            if x > REFUSAL_ODDS:
                out[rows[k]] = "refusal"
            elif self._truncated(ps[k], zs[k]):
                out[rows[k]] = "truncated"
        return out

    def defect(self, prompt: str | None, response: str | None) -> str | None:
        return self.defects([prompt], [response])[0]

    @staticmethod
    def _empty(prompt: str | None, response: str | None) -> str | None:
        if response is None or not _LETTER.search(response):
            return "empty"
        bare = "".join(_WORDS.findall(response)).lower()
        if bare in PLACEHOLDERS or response.strip(" \t\r\n()[]（）【】<>-—_.。…*'\"").lower() in PLACEHOLDERS:
            return None if prompt and response.strip().lower() == prompt.strip().lower() and not _translatable(prompt) else "empty"
        return None

    def _foreign(self, prompt: str, response: str, of_prompt: np.ndarray) -> str | None:
        """'copied', 'refusal', 'language' or None for a response that may not be Chinese; ``of_prompt``: the prompt's posterior."""
        words = _translatable(prompt)
        read_ = plain(response)
        names = set(_TOKENS.findall(plain(prompt)))
        low = {n.lower() for n in names}
        rest = _QUOTED.sub(lambda m: " " if m[0][1:-1].strip() in prompt else m[0], read_)
        rest = _TOKENS.sub(lambda m: " " if m[0].lower() in low and (not m[0].islower() or not m[0].isalpha()) else m[0], rest)
        rest = re.sub(r"[\W\d_]+", " ", rest).strip()
        scores = self.languages.scores([rest])[0]
        # whether the prompt and what isn't Chinese in the response speak one language: cosine of the posteriors
        mine = self.posteriors([_HAN.sub(" ", read_)])[0]
        same = float(mine @ of_prompt / max(1e-9, np.linalg.norm(mine) * np.linalg.norm(of_prompt)))
        if words and (same > 0.5 or len(rest) < 4) and self._copied(words, read_, plain(prompt), _han(response)):
            return "copied"
        if len(rest) < 4 and not _HAN.search(rest):
            return None if not words or _HAN.search(response) else "language"
        best = self.languages.classes[int((scores - self.margin * len(rest)).argmax())]
        if best == "refusal zh":
            return None  # the search of Chinese texts decides
        if best.startswith("refusal"):
            return "refusal"
        return "language" if not best.startswith("zh") and (words or _OTHER_SCRIPT.search(response)) else None

    @staticmethod
    def _copied(words: list[str], response: str, prompt: str, han: int) -> bool:
        """Whether the response's words are the prompt's."""
        mine, theirs = Counter(_WORDS.findall(response.lower())), Counter(_WORDS.findall(prompt.lower()))
        want = Counter(w.lower() for w in words)
        latin = Counter({w: n for w, n in mine.items() if _LATIN_WORD.match(w)})
        shared, of = (latin & theirs).total(), latin.total()
        if of and shared >= 0.7 * of and (mine & want).total() >= 0.55 * want.total() and han <= max(4, of):
            return True
        squeezed = "".join(_WORDS.findall(response)).lower()
        return of >= 4 and han == 0 and bool(squeezed) and squeezed in "".join(_WORDS.findall(prompt)).lower()

    def _truncated(self, prompt: str, response: str) -> bool:
        """Whether the ending of the response lies inside a sentence, although the prompt's doesn't."""
        z = response.rstrip(_CLOSERS)
        if not z or _KEYWORD_LINE.match(z):
            return False
        text = plain(prompt).strip()
        if not text or _EN_KEYWORDS.match(text) or _EN_CAPTION.match(text) or not _ends(text) or (text[-1] == "." and _EN_OPEN.search(text[-16:])):
            return False  # a heading, a caption, or a prompt that stops inside a sentence itself
        marked = z[-1] in _CJK_END or z[-1] == "." and not z.endswith("..")
        if z[-1] in "…�" or z.endswith(".."):
            return True
        core = _tail(z)
        last = _TOKENS.search(core[-40:][::-1])
        if last and last.start() == 0 and core[-1].isalpha() and not marked:
            word = last[0][::-1]
            whole = _TOKENS.findall(text)
            if word not in whole and any(w.startswith(word) for w in whole):
                return True  # a name broken off
        return self.ends.odds(core) + (MARK_ODDS if marked else NO_MARK_ODDS) < 0


def plain(text: str) -> str:
    """The canonical spelling."""
    return text if text.isascii() else transducer().apply(text)


def _translatable(prompt: str) -> list[str]:
    """Words of the prompt that a translation has to render: no names, acronyms, symbols or numbers."""
    out = []
    for m in re.finditer(r"[^\W\d_]+(?:[-'’‐‑][^\W\d_]+)*", plain(prompt or "")):
        w = m[0]
        if len(w) >= 2 and w[1:].islower() and w.isalpha() and (w[0].islower() or len(w) >= 3 and re.search(r"(?:^|[.?!:]\s+)[\d.\s]*$", m.string[: m.start()])):
            out.append(w)
        elif "-" in w and w.islower():
            out += [x for x in re.split(r"[-'’‐‑]", w) if len(x) >= 2]
    return out


def learn(pairs: DataFrame, key: str, prompt: str, response: str) -> PairModel:
    """Learn the models from all pairs that have a key, a prompt and a response."""
    held = pick(pairs, _key=key, _text=prompt, _zh=response).where("_key IS NOT NULL AND _text IS NOT NULL AND _zh IS NOT NULL")
    each = F.array(F.struct(F.lit("en").alias("name"), F.col("_text").alias("text")), F.struct(F.lit("response").alias("name"), F.col("_zh").alias("text")))
    return PairModel.learned(held.select(F.explode(each).alias("_t")).select("_t.*"))


def _judge(held: Broadcast):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: PairModel = held.value
        for part in parts:
            part["defect"] = pd.Series(model.defects(part["_text"].tolist(), part["_zh"].tolist()), index=part.index, dtype=object)
            yield part.loc[part["defect"].notna(), ["_key", "defect"]]

    return run


def pair_defects(pairs: DataFrame, key: str, prompt: str, response: str, model: PairModel | None = None) -> DataFrame:
    """(_key, defect) of every broken pair: 'empty', 'refusal', 'copied', 'language' or 'truncated'.

    A null or blank response is empty. A null prompt is an empty text: nothing can be copied from it or be cut against it. Repeated rows
    give one row. Texts are read whole. An empty table gives no rows.
    """
    held = pairs.sparkSession.sparkContext.broadcast(model or learn(pairs, key, prompt, response))  # grows with the distinct runs of characters, not with the rows
    rows = pick(pairs, _key=key, _text=prompt, _zh=response).where("_key IS NOT NULL")
    return rows.mapInPandas(_judge(held), f"_key {dict(rows.dtypes)['_key']}, defect string").distinct()


def translation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, kind, text, zh) of the entries without skip or blank; entries without a block have a null text."""
    entries = table(spark, sf_dir, "translations").where("NOT coalesce(skip, false) AND NOT coalesce(blank, false)").select("entry_id", "block_key", "zh")
    blocks = table(spark, sf_dir, "blocks").select("block_key", "kind", "text")
    return entries.join(blocks, "block_key", "left").select("entry_id", "kind", "text", "zh")


def translation_model(spark: SparkSession, sf_dir: str) -> PairModel:
    """The model of the translations, learned from all entries, blocks and labelled documents (they need not be pairs, so nothing is joined)."""
    entries = table(spark, sf_dir, "translations").where("NOT coalesce(skip, false) AND NOT coalesce(blank, false) AND zh IS NOT NULL").select(F.lit("response").alias("name"), F.col("zh").alias("text"))
    prompts = table(spark, sf_dir, "blocks").where("text IS NOT NULL").select(F.lit("en").alias("name"), "text")
    labelled = table(spark, sf_dir, "documents").where(F.col("lang").isin([x for x in LANGUAGES if x != "en"]) & F.col("text").isNotNull()).select(F.col("lang").alias("name"), "text")
    return PairModel.learned(entries.unionByName(prompts).unionByName(labelled))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, defect) of every entry that is no proper Chinese translation of its block."""
    found = pair_defects(translation_pairs(spark, sf_dir), "entry_id", "text", "zh", translation_model(spark, sf_dir))
    return found.select(F.col("_key").alias("entry_id"), "defect")


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}

"""Problem 1: defective answers of question-answer pairs.

empty          nothing is left behind labels, markup and placeholder words
refusal        sentences of the refusal dictionary, and hardly anything besides
copies_question  compressed with its question as a zstandard dictionary, the answer nearly vanishes
other_language   more foreign words than Vietnamese ones, by syllable form and dictionaries
truncated      the terminal-context model of ``cutoff`` finds that the answer stops early

The first that holds, in this order, is the record's defect.  Dictionaries are word lists,
not thresholds on length; a short answer is no defect.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import latest, stored, table
from .cutoff import cut_texts
from .forms import consistent

#: Novel bytes per byte of the answer, question known; restated questions with an answer lie far above.
COPY_RATIO = 0.25
#: Words besides refusal sentences that still make a refusal.
REFUSAL_REST = 20
#: Bytes an empty zstandard frame takes.
_FRAME = 9

_WORDS = re.compile(r"[^\W_]+").findall
_LABEL = re.compile(r"^\W*(?:câu trả lời|trả lời|đáp án|đáp|câu hỏi|hỏi|answer|final[_ ]answer|response|assistant|output|kết quả|a|q)\W*[:：]\s*", re.I)
_MARKUP = re.compile(r"</?[a-z][^<>]{0,40}>|```[a-z]*|^[#>*•\-\s]+|&nbsp;", re.I | re.M)
_PLACEHOLDER = re.compile(
    r"^\W*(?:null|none|nil|nan|n/a|na|tbd|todo|undefined|empty|blank|no answer|no response|trống|để trống|rỗng|bỏ trống|chưa có|chưa có câu trả lời|chưa trả lời|đang cập nhật|không có câu trả lời|không có nội dung|không có dữ liệu|chưa cập nhật|lorem ipsum|x{2,})\W*$",
    re.I,
)


_MARKS = re.compile("[\u0300-\u036f]+")
#: Most words remembered per worker, with what was found out about them.
WORDS_KEPT = 200_000


class _ByWord(dict):
    """What ``find`` says of a word, found out once: a corpus repeats its words."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str):
        if len(self) >= WORDS_KEPT:  # memory stays bounded on any corpus
            self.clear()
        value = self[word] = self.find(word)
        return value


def _bare(token: str) -> str:
    """The plain words of a run without blanks."""
    return " ".join(_WORDS(_MARKS.sub("", unicodedata.normalize("NFD", token.lower().replace("đ", "d")))))


_BARE = _ByWord(_bare)


def plain(text: str) -> str:
    """Lower case without accents, words joined by single blanks."""
    return " ".join([w for w in map(_BARE.__getitem__, text.split()) if w])


def core(answer: str) -> str:
    """The answer without labels, markup and fences."""
    text = _MARKUP.sub("", answer).strip()
    while (m := _LABEL.match(text)) and m.end():
        text = text[m.end() :].strip()
    return text


def is_empty(body: str) -> bool:
    return not any(c.isalnum() for c in body) or bool(_PLACEHOLDER.match(body)) or bool(re.fullmatch(r"\W*(?:câu trả lời|trả lời|đáp án|đáp|answer|final_answer)\W*", body, re.I))


# Refusals by their plain form; Vietnamese is matched without accents, so spelling with or without them is the same.
_WHO = r"(?:toi|minh|em|chung toi|chung minh|he thong|tro ly|mo hinh|chatbot)"
_WHO_HEADS = "toi minh em chung he tro mo chatbot"
#: Each expression with the words it can begin with; it is tried where one of them stands.
_REFUSALS = (
    (_WHO_HEADS, rf"\b{_WHO} (?:\w+ ){{0,3}}?(?:khong|chua|chang) (?:the|duoc phep|duoc|co the|du kha nang|co kha nang|the nao|dam|tien|biet|nam ro)\b(?: \w+){{0,4}} (?:tra loi|dua ra|tu van|binh luan|giai dap|ket luan|ho tro|giup|cung cap|dap ung|xu ly|thuc hien)"),
    (_WHO_HEADS, rf"\b{_WHO} (?:\w+ ){{0,2}}?(?:xin phep|buoc phai|danh phai|xin|phai) (?:\w+ )?(?:khong|bo qua|tu choi|dung|mien)\b"),
    (_WHO_HEADS, rf"\b{_WHO} (?:\w+ ){{0,2}}?(?:tu choi|bo tay|chiu)\b"),
    ("xin", r"\bxin phep (?:khong|tu choi|duoc tu choi|bo qua)\b"),
    ("khong chua", r"\b(?:khong|chua) (?:co )?du (?:thong tin|du lieu|can cu|ngu canh|co so|bang chung|tai lieu) (?:\w+ ){0,3}?(?:de|tra loi|ket luan)\b"),
    ("khong chua", r"\b(?:khong|chua) tim (?:thay|duoc|ra) (?:\w+ ){0,2}?(?:can cu|thong tin|noi dung|cau tra loi|dap an|bang chung|quy dinh)\b(?: \w+){0,7} (?:tra loi|giai dap|cung cap|bang chung|ngu canh|tai lieu)"),
    ("ngoai pham", r"\bngoai pham vi (?:ho tro|tra loi|tu van|kien thuc|cua toi|hieu biet|kha nang|xu ly)\b|\bpham vi du lieu\b.{0,40}\b(?:chua|khong) bao phu\b"),
    ("chu phan cau noi", r"\bchu de nhay cam\b|\b(?:phan|cau|noi dung) (?:tra loi|giai dap) da bi (?:an|chan|go|xoa)\b|\bnoi dung (?:nay )?(?:khong phu hop|bi chan|vi pham chinh sach)\b"),
    ("tai doan ngu bang van nguon", r"\b(?:tai lieu|doan trich|ngu canh|bang chung|van ban|nguon)\b(?: \w+){0,4} khong (?:chua|co|de cap|neu|nhac)\b(?: \w+){0,9} (?:can thiet|giai dap|tra loi|ban can|ban hoi|cau hoi|yeu cau)\b"),
    ("bo em toi minh khong", r"\b(?:bo tay|em chiu|toi chiu|minh chiu)\b|\bkhong biet (?:tra loi|phai tra loi)\b"),
    ("nguoi de", r"\bnguoi co chuyen mon\b.{0,40}\bdung (?:o|tai) day\b|\bde trong phan (?:giai dap|tra loi)\b"),
    ("khong", r"\bkhong duoc phep (?:tu van|tra loi|dua ra (?:y kien|loi khuyen|tu van)|binh luan|cung cap)\b"),
    ("khong chua", r"\b(?:khong|chua) the (?:tra loi|giai dap|dua ra (?:cau tra loi|ket luan|y kien)|tu van|binh luan|ho tro (?:ban|yeu cau|cau hoi)|dap ung yeu cau)\b"),
    ("cau thu", r"\bcau (?:hoi )?nay (?:\w+ )?(?:kho qua|qua kho)\b|\bthu hoi (?:noi|cho|nguoi) khac\b"),
    ("khong", r"\bkhong thuoc (?:\w+ )?(?:chuc nang|pham vi|tham quyen|nhiem vu|trach nhiem|kha nang)\b(?: \w+){0,3} (?:kenh|toi|minh|he thong|chung toi|tro ly|tong dai|chuyen muc|ban tu van)\b"),
    ("vuot", r"\bvuot (?:qua |ngoai )?(?:kha nang|pham vi|tham quyen|quyen han|hieu biet)\b(?: \w+){0,3} (?:toi|minh|he thong|chung toi|tro ly|kenh)\b"),
    ("khong chua", r"\b(?:khong|chua) co (?:thong tin|du lieu|cau tra loi|quyen tra loi|can cu|tham quyen tra loi)\b(?: \w+){0,4} (?:de|ve|cho|nao)\b(?: \w+){0,6} (?:cau hoi|tra loi|van de|noi dung|yeu cau)\b"),
    ("mien khong tu dung", r"\b(?:mien|khong) binh luan\b|\btu choi (?:tra loi|giai dap|tu van|cau hoi)\b|\bkhong giup duoc\b|\bkhong tra loi (?:duoc|cau|noi dung|van de)\b|\bdung (?:tra loi|cuoc tro chuyen)\b"),
    ("i we", r"\b(?:i|we) (?:\w+ )?(?:can t|cannot|can not|could not|couldn t|won t|will not|am unable|are unable|am not able|are not able|m unable|m not able|must decline|have to decline|decline|prefer not)\b"),
    ("as", r"\bas an? (?:ai|artificial|automated|language)\b.{0,40}\b(?:unable|cannot|can t|not able|not allowed|do not|don t)\b"),
    ("i we", r"\b(?:i|we) (?:do not|don t|did not|didn t) (?:have|find|know|possess)\b.{0,30}\b(?:enough|sufficient|information|context|answer|data|evidence|access)\b"),
    ("unable outside beyond not no cannot", r"\bunable to (?:answer|help|assist|provide|give|comply|respond)\b|\b(?:outside|beyond) (?:of )?(?:my|the|our) scope\b|\b(?:not|no) (?:enough|sufficient) (?:information|context|data|evidence)\b|\bcannot be answered\b|\bno answer can be given\b"),
    ("je pas", r"\bje (?:ne )?(?:peux|puis|suis) (?:malheureusement )?pas\b|\bje refuse\b|\bpas (?:assez|suffisamment) d (?:informations?|elements?)\b"),
    ("no", r"\b(?:no puedo|no podemos|no me es posible|no estoy autorizad[oa])\b|\bno (?:tengo|hay|dispongo de) suficiente"),
    ("saya kami tidak", r"\b(?:saya|kami) (?:\w+ )?(?:tidak (?:dapat|bisa|mampu|boleh)|belum (?:dapat|bisa))\b|\btidak (?:ada|memiliki) cukup\b"),
    ("ich nao non nie", r"\bich kann (?:\w+ ){0,4}?nicht\b|\bnao posso\b|\bnon posso\b|\bnie moge\b"),
    ("не недостаточно вынужден вынуждена вынуждены отказываюсь", r"\b(?:не могу|не можем|не могла|не имею права|не в состоянии|вынужден[аы]? отказать|отказываюсь)\b|\bнедостаточно (?:данных|информации|сведении)\b"),
)
_REFUSING = {
    head: re.compile("|".join(expression for heads, expression in _REFUSALS if head in heads.split()))
    for head in {head for heads, _ in _REFUSALS for head in heads.split()}
}


def _refuses(words: str) -> bool:
    """Whether a text in plain form holds a refusing expression."""
    at = 0
    for word in words.split(" "):
        if (expression := _REFUSING.get(word)) and expression.match(words, at):
            return True
        at += len(word) + 1
    return False


_REFUSALS_OTHER = re.compile(r"无法(?:回答|提供|帮助|給)|無法(?:回答|提供|幫助)|不能(?:回答|提供)|抱歉|对不起|對不起|申し訳|お答えできません|回答できません|답변(?:할 수 없|을 드릴 수 없)|죄송|ไม่สามารถ(?:ตอบ|ให้)|لا (?:أستطيع|يمكنني)|عذر", re.I)
_COURTESY = re.compile(
    r"\b(?:xin loi|rat tiec|mong ban thong cam|dat cau hoi khac|vui long (?:lien he|hoi|tham khao|cung cap)|lien he luat su|hoi (?:co quan|luat su|chuyen gia|bo phan|nguoi|noi|ben)|co quan co tham quyen|giai dap chinh xac|chuc ban|chuc anh|tham khao (?:y kien|luat su|chuyen gia)|nho luat su|tim den|mong (?:ban|anh|quy)|hen gap lai|tran trong|cung cap them (?:tai lieu|thong tin)|de nghi cung cap|cam on|thua ban|sorry|apologi[sz]e|please (?:consult|contact|provide|rephrase)|desole|lo siento|maaf|entschuldigung|извините|простите|к сожалению|обратитесь|consult[ae]z?|hubungi)\b"
)


#: Openings of an apology or a machine's reserve, in plain form.
_OPENING = re.compile(
    r"(?:thua (?:ban|anh|chi|quy khach) |chao ban |da |vang )?(?:thanh that |that su |chung toi |toi |minh |em )?(?:rat )?(?:xin loi|tiec|lay lam tiec|la mot (?:he thong|tro ly|mo hinh|ai|chatbot)|voi (?:vai tro|tu cach) (?:\w+ )?(?:tro ly|he thong|ai)|vi ly do (?:an toan|bao mat|chinh sach))\b"
    r"|(?:i m |i am |we are )?(?:very |so |truly |deeply )?(?:sorry|unfortunately|apologies|as an ai)\b|(?:je suis )?desole|malheureusement|lo siento|lamentablemente|maaf|mohon maaf|es tut mir leid|leider|к сожалению|извините|простите"
)
_DENIAL = re.compile(r"\b(?:khong|chua|chang|kho|ngoai|dung|bo qua|tu choi|can t|cannot|not|unable|no|pas|ne|tidak|belum|nicht|kein|не|нет|нельзя)\b")
#: An answer that opens like this, denies something, names no number and is not longer is a refusal.
APOLOGY_WORDS = 60


def is_refusal(body: str, whole: str | None = None) -> bool:
    """A refusing sentence and no answer beside it, or a short apology.

    Sentences of another kind may hold REFUSAL_REST words in all, but none may state
    anything by a number; ``whole`` is the plain form of the body, if it is known.
    """
    whole = plain(body) if whole is None else whole
    if _OPENING.match(whole) and _DENIAL.search(whole) and len(whole.split()) <= APOLOGY_WORDS and not any(c.isdigit() for c in whole):
        return True
    refused, rest = not body.isascii() and bool(_REFUSALS_OTHER.search(body)), 0
    if not refused and not _refuses(whole):
        return False
    for sentence in re.split(r"(?<=[.!?。！？])\s+|\n+", body):
        words = plain(sentence)
        if _refuses(words):
            refused = True
        elif not _COURTESY.search(words) and not _REFUSALS_OTHER.search(sentence):
            if any(c.isdigit() for c in words):
                return False
            rest += len(words.split())
    return refused and rest <= REFUSAL_REST


def novelty(question: str, answer: str) -> float:
    """Bytes the answer adds to its question, per byte; both in plain form."""
    dictionary = zstandard.ZstdCompressionDict(question.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_dict_id=False)
    data = answer.encode()
    return max(0, len(compressor.compress(data)) - _FRAME) / max(1, len(data))


def copies_question(question: str | None, body: str, plain_body: str | None = None) -> bool:
    """The question again, as a whole or asked in part, or an answer it explains nearly alone.

    An answer of any length that equals its question is a copy; so is a run of at least two
    words of the question that still asks.  Otherwise the answer must cover much of the question.
    """
    if not question:
        return False
    q, a = plain(question), plain(body) if plain_body is None else plain_body
    if not a or not q:
        return False
    if a == q:
        return True
    n = len(a.split())
    if n >= 2 and body.rstrip(" \n\"”’)").endswith("?") and f" {a} " in f" {q} ":
        return True
    if n < 4 or n < 0.5 * len(q.split()):
        return False
    return novelty(q, a) < COPY_RATIO - _FRAME / max(40, len(a.encode()))


_FENCE, _QUOTES = re.compile(r"\s*+```[a-z]*\s*+"), ('"', "”", "’", "»")

# A Vietnamese syllable without accents: onset, vowels, coda.
_SYLLABLE = re.compile(r"(?:ngh|ng|nh|ch|gh|gi|kh|ph|qu|th|tr|[bcdghklmnpqrstvx])?(?:[aeiouy]|ai|ao|au|ay|eo|eu|ia|ie|ieu|iu|oa|oai|oao|oay|oe|oeo|oi|oo|ua|uai|uao|uau|uay|ue|ui|uo|uoi|uou|uu|uy|uya|uye|uyu|ye|yeu|ya)(?:ch|ng|nh|[cmnpt])?")
_ACCENTED = re.compile("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹìòùũĩõ]")
_ACCENTED_WORD = re.compile("[bcdghklmnpqrstvxđ]{0,3}[aeiouy]{0,2}[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹìòùũĩõ]+[aeiouycghmnpt]{0,3}").fullmatch
# Frequent words of other languages that look like Vietnamese syllables (fixed values).
_FOREIGN = frozenset(
    "the to in an on is it be not no or of and for this that with shall must may within you your we he she they has have are was were been at by from as but if so do can will "
    "le la les un une du des et ou en au aux que qui pas ne se ce il elle on dans sur pour par est sont votre vous "
    "el los las una y o de del al con por para su sus es son se lo no si como mas puede debe "
    "yang dan di ke dari untuk dengan pada itu ini tidak akan harus boleh anda saya kami atau dalam hari bulan "
    "der die das und ist nicht mit ein eine zu von im den dem".split()
)
_VIETNAMESE = frozenset(
    "và của là có không được cho trong khi thì mà này đó các những một với theo tại từ đến để nếu người bạn phải hay hoặc về trên nên cũng đã sẽ "
    "va cua khong duoc trong khi thi nay cac nhung mot voi theo tu neu nguoi ban phai hay hoac ve tren nen cung da se ngay thang nam dieu khoan nghi dinh thong quyet quy dong".split()
)


def _language(token: str) -> tuple[int, int, int]:
    """(foreign, native, either) words of a run without blanks."""
    foreign = native = either = 0
    for word in _WORDS(token):
        if any(c.isdigit() for c in word) or len(word) == 1:
            continue
        low, upper = word.lower(), word[0].isupper()
        bare = _BARE[low]
        if not bare.isascii():
            foreign += max(1, len(word) // 2 if ord(word[0]) > 0x2E80 else 1)
        elif word.isupper() and len(word) <= 4:
            continue
        elif not _SYLLABLE.fullmatch(bare):
            foreign += 1
        elif low in _VIETNAMESE or (_ACCENTED.search(low) and not upper):
            native += 1
        elif low in _FOREIGN:
            foreign += 1
        elif not upper:
            either += 1
    return foreign, native, either


def _accents(token: str) -> int:
    """Accented Vietnamese syllables of a run without blanks, less half of its words, times two."""
    words = _WORDS(token)
    return 2 * sum(map(bool, map(_ACCENTED_WORD, words))) - len(words)


_LANGUAGE, _ACCENTS = _ByWord(_language), _ByWord(_accents)


def is_foreign(body: str) -> bool:
    """More foreign words than Vietnamese ones.

    Words of another script, words that are no Vietnamese syllable and frequent foreign
    words are foreign; accented syllables and frequent Vietnamese words are Vietnamese;
    other syllables could be either.  Names inside a foreign sentence do not outweigh it,
    and unaccented Vietnamese keeps to the syllables.
    """
    tokens = body.split()
    if sum(map(_ACCENTS.__getitem__, tokens)) > 0:
        return False  # most words are accented syllables
    foreign, native, either = map(sum, zip(*map(_LANGUAGE.__getitem__, tokens))) if tokens else (0, 0, 0)
    known = foreign + native
    return known + either >= 3 and foreign > native and foreign >= 0.35 * (known + either)


def judge(question: str | None, answer: str | None) -> tuple[str | None, str]:
    """(defect or None, body): every defect but truncation, for which the body is judged in SQL."""
    if answer is None:
        return "empty", ""
    text = consistent(answer)
    body = core(text)
    if is_empty(body):
        return "empty", ""
    words = plain(body)
    if is_refusal(body, words):
        return "refusal", ""
    if copies_question(consistent(question) if question else None, body, words):
        return "copies_question", ""
    if is_foreign(body):
        return "other_language", ""
    # code fences and closing quotes are the frame of an answer, not a cut
    if "```" in text:
        text = _FENCE.sub("\n", text)
    if (bare := text.rstrip()).endswith(_QUOTES) and (bare := bare.rstrip("".join(_QUOTES))).endswith((".", "!", "?")):
        text = bare
    return None, text


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, id_, method, question, answer = batch.columns
        found = [judge(q, a) for q, a in zip(question.to_pylist(), answer.to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [kind, id_, method, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
            names=["kind", "id", "method", "defect", "body"],
        )


def defects(pairs: DataFrame) -> DataFrame:
    """Operator: pairs (kind, id, method, question, answer) -> the same keys with ``defect`` (null: sound).

    Null answers are empty; a null question only means that copies cannot be told.  Keys
    must be distinct.
    """
    judged = stored(
        pairs.select("kind", "id", "method", "question", "answer").mapInArrow(_judge, "kind string, id string, method string, defect string, body string")
    )
    key = F.struct("kind", "id", "method")
    open_ = judged.where("defect is null").select(key.alias("doc_id"), F.col("body").alias("text"), F.lit("").alias("source"))
    cut = cut_texts(open_, consistent=True).where("cut is not null").select("doc_id.*", F.lit("truncated").alias("late"))
    return judged.join(cut, ["kind", "id", "method"], "left").select("kind", "id", "method", F.coalesce("defect", "late").alias("defect"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Gold answers (withheld ones left out) and predictions, each key once."""
    q = latest(table(spark, folder, "legal_questions").select("id", "question", "answer", "split", "received_at"), ["id"])
    p = latest(table(spark, folder, "predictions").select("id", "method", "answer", "received_at"), ["id", "method"])
    gold = q.where("answer is not null or split is null or split not in ('public', 'private')")
    gold = gold.select(F.lit("question").alias("kind"), "id", F.lit("gold").alias("method"), "question", "answer")
    predicted = p.join(q.select("id", "question"), "id", "left").select(F.lit("prediction").alias("kind"), "id", "method", "question", "answer")
    return gold.unionByName(predicted)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return defects(pairs(spark, folder)).where("defect is not null")


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Records and defects per kind, method and defect type ('none' for sound ones)."""
    return defects(pairs(spark, folder)).groupBy("kind", "method", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count(F.lit(1)).alias("n"))

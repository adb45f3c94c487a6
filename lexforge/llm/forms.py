"""One consistent form for text that looks the same (problem 3).

The form is a confusables skeleton that stays readable: decompose, drop what
cannot be seen, fold widths and blanks, replace look-alike letters by the
prototype of the word's own script, compose again.

Defined results: null stays null; the empty string stays empty; line breaks,
number of blanks, case, accents and punctuation are kept, because they can be
seen.  The function is idempotent.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Look-alike letters (Cyrillic / Greek, then Latin), prototypes by position.
CYRILLIC = "АВЕКМНОРСТУХІЈЅԚԜҮаеорсухіјѕԁһԛԝӏ"
CYRILLIC_AS_LATIN = "ABEKMHOPCTYXIJSQWYaeopcyxijsdhqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιρυκ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXovaipuk"
LATIN_VARIANTS = "ÐƉɑɡıſ"
LATIN_VARIANTS_AS = "ĐĐagis"
DASHES = "‐‑"
OTHER = "ᴄᴏᴠᴡᴢꜱᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴօսհոցզՕՏ"
OTHER_AS_LATIN = "covwzsDRTiAJEWMHYGhZbRWSVSLCPKdBBPDTGKJCZFMNLSRVHWXYAEIOUouhngqOS"

TO_LATIN = dict(zip(map(ord, CYRILLIC + GREEK + OTHER), CYRILLIC_AS_LATIN + GREEK_AS_LATIN + OTHER_AS_LATIN))
TO_CYRILLIC = {ord(b): a for a, b in zip(reversed(CYRILLIC), reversed(CYRILLIC_AS_LATIN))}
TO_GREEK = {ord(b): a for a, b in zip(reversed(GREEK), reversed(GREEK_AS_LATIN))}


#: Where characters stand that are neither ideographs, Hangul syllables, surrogates nor private.
ASSIGNED = (range(0x3400), range(0x4DC0, 0x4E00), range(0xA000, 0xAC00), range(0xD7A4, 0xD800), range(0xF900, 0x20000), range(0xE0000, 0xE1000))


def _always() -> dict[int, str | None]:
    """Character by character: widths, blanks, unseen characters, Latin variants."""
    table: dict[int, str | None] = {}
    for cp in (cp for block in ASSIGNED for cp in block):
        kind = unicodedata.category(chr(cp))
        form = unicodedata.decomposition(chr(cp)).partition(" ")[0]
        # widths of any character; letters and numbers that differ from others by their type face or are ligatures
        if form in ("<wide>", "<narrow>") or (form in ("<font>", "<compat>") and kind[0] in "LN"):
            table[cp] = unicodedata.normalize("NFKD", chr(cp))
        if kind == "Zs" or cp == 0x09:
            table[cp] = " "
        elif kind == "Cf" or (kind == "Cc" and cp not in (0x0A, 0x0D)):
            table[cp] = None
    for cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)):
        table[cp] = None
    for cp in (0x85, 0x2028, 0x2029):
        table[cp] = "\n"
    table.update(zip(map(ord, LATIN_VARIANTS), LATIN_VARIANTS_AS))
    table.update((ord(c), "-") for c in DASHES)
    return table


ALWAYS = _always()

_LOOKALIKE = re.compile(f"[{CYRILLIC}{GREEK}{OTHER}]")
#: A decomposed word: letters with their marks.
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_LATIN_PLAIN = set(CYRILLIC_AS_LATIN + GREEK_AS_LATIN)
_CYRILLIC_PLAIN, _GREEK_PLAIN = set(CYRILLIC + OTHER), set(GREEK)


def _script(ch: str) -> str:
    cp = ord(ch)
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "g"
    if 0x400 <= cp < 0x530:
        return "c"
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "l"
    return "o"


def _own_script(match: re.Match) -> str:
    """The word with its look-alikes replaced by the letters of its own script.

    Letters without a look-alike in another script decide, and so do Latin letters
    or Vietnamese marks where no such letter stands.  A word that consists of
    look-alikes of one foreign script only is left to ``consistent``.
    """
    word = match.group()
    kinds: dict[str, int] = {}
    sure: dict[str, int] = {}
    for ch in word:
        if "\u0300" <= ch <= "\u036f":
            if ch in _VIETNAMESE_MARKS:
                kinds["l"] = kinds.get("l", 0) + 1
            continue
        kind = _script(ch)
        kinds[kind] = kinds.get(kind, 0) + 1
        if ch not in _LATIN_PLAIN and ch not in _CYRILLIC_PLAIN and ch not in _GREEK_PLAIN:
            sure[kind] = sure.get(kind, 0) + 1
    if not sure and "l" not in kinds:
        return word.translate(_MARKED)
    best = max(sure, key=lambda k: (sure[k], k == "l")) if sure else "l"
    if best == "c":
        return word.translate(TO_GREEK_TO_CYRILLIC)
    if best == "g":
        return word.translate(TO_CYRILLIC_TO_GREEK)
    return word.translate(TO_LATIN)


#: Marks of a word that only has look-alikes of another script, until the text's script is known.
_VIETNAMESE_MARKS = "\u0302\u0306\u0309\u031b\u0323\u0303\u0300"
_MARKED = {ord(c): chr(0xF0000 + ord(c)) for c in CYRILLIC + GREEK}
_PENDING = re.compile("[\U000F0000-\U000F0530]+")


TO_GREEK_TO_CYRILLIC = TO_CYRILLIC | {ord(g): TO_CYRILLIC[ord(x)] for g, x in zip(GREEK, GREEK_AS_LATIN) if ord(x) in TO_CYRILLIC}
TO_CYRILLIC_TO_GREEK = TO_GREEK | {ord(c): TO_GREEK[ord(x)] for c, x in zip(CYRILLIC, CYRILLIC_AS_LATIN) if ord(x) in TO_GREEK}


#: Texts of these characters only are in the consistent form already: they never go to Python.
#: Runs of one narrow class each, as wide classes are slow to test.
PLAIN = (
    r"^(?:[\n\x20-\x7E]++|[Ạ-ỹ]++|[§«°»×÷àáâãèéêìíòóôõùúýÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝ]++"
    r"|[Ăă]++|[Đđ]++|[Ơơ]++|[Ưư]++|[Ĩĩ]++|[Ũũ]++|[–—‘’“”•…]++)*+$"
)
_PLAIN_CHARS = r"\n\x20-\x7E§«°»×÷àáâãèéêìíòóôõùúýÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝăĂđĐĩĨũŨơƠưƯẠ-ỹ–—‘’“”•…"
_PLAIN = re.compile(f"[{_PLAIN_CHARS}]*").fullmatch
#: Runs between blanks and line ends that hold any other character.
_ODD = re.compile(rf"(?<![^ \n])[^ \n]*?[^{_PLAIN_CHARS}][^ \n]*")
#: Most such runs remembered per worker, and the longest.
RUNS_KEPT, RUN_CHARS = 100_000, 64


def _run(text: str) -> str:
    """The form of a run, but for words whose script the rest of the text decides."""
    text = unicodedata.normalize("NFD", text).translate(ALWAYS).replace("\r", "\n")
    if _LOOKALIKE.search(text):
        text = _WORD.sub(_own_script, text)
    return unicodedata.normalize("NFC", text)


class _Runs(dict):
    """Forms of runs, found out once: a corpus repeats them."""

    def __call__(self, match: re.Match) -> str:
        run = match.group()
        if (form := self.get(run)) is None:
            form = _run(run)
            if len(run) <= RUN_CHARS:
                if len(self) >= RUNS_KEPT:  # memory stays bounded on any corpus
                    self.clear()
                self[run] = form
        return form


_runs = _Runs()


def consistent(text: str) -> str:
    """The consistent form of one text."""
    if _PLAIN(text):
        return text
    text = _ODD.sub(_runs, text.replace("\r\n", "\n"))
    if _PENDING.search(text):
        # words of look-alikes only: the script of the rest of the text is theirs
        rest = [_script(c) for c in text if c.isalpha()]
        back = TO_LATIN if rest.count("l") >= max(rest.count("c"), rest.count("g")) and "l" in rest else {}
        text = unicodedata.normalize("NFC", _PENDING.sub(lambda m: "".join(chr(ord(c) - 0xF0000) for c in m.group()).translate(back), text))
    return text


@F.pandas_udf(StringType())
def _consistent_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: consistent(x) if x is not None else None)


def consistent_form(text: Column) -> Column:
    """Consistent form of a column.  Only texts with unusual characters cross to Python (Arrow)."""
    return F.coalesce(_consistent_udf(F.when(~text.rlike(PLAIN), text)), text)


#: Runs of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words(form: Column) -> Column:
    """Lower-case words of a text in its consistent form: unbroken runs of letters and digits."""
    return F.regexp_extract_all(F.lower(form), F.lit(WORD), F.lit(0))

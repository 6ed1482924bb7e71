"""Cleaning of one transcript segment: time marks, speaker labels, sound notes, hesitation sounds."""

from __future__ import annotations

import re
import unicodedata

from mundspark.functions.text import fold

_OPEN, _CLOSE = r"[\[(<{]", r"[\])>}]"
_CLOCK = r"\d{1,3}(?::\d{2}){1,2}(?:[.,]\d{1,3})?"
#: Time marks: any clock in brackets; outside them only with hours, minutes and seconds.
_TIME = re.compile(rf"{_OPEN}\s*{_CLOCK}\s*(?:-+>?\s*{_CLOCK}\s*)?{_CLOSE}|(?<![\d:.,])\d{{1,3}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:])")
_NAME = r"(?:speaker(?:in)?|sprecher(?:in)?|spk|spkr)"
#: A label at the head of a text: in brackets, or followed by a colon or a dash.
_HEAD = re.compile(rf"^\W*(?:{_OPEN}\s*{_NAME}[\s_.\-]*0*(\d{{1,6}})\s*{_CLOSE}\s*:?|{_NAME}[\s_.\-]*0*(\d{{1,6}})\s*(?::|[–—-](?=\s|$))|s[\s_.\-]?0*(\d{{1,6}})\s*:)", re.I)
_LABEL = re.compile(rf"^\W*(?:{_NAME}|s)?[\s_.\-]*0*(\d{{1,6}})\W*$", re.I)
#: Remarks in brackets or stars. One is a sound note if it names a sound: its first word, or at least half of its words, or
#: if it holds no word at all. Any other remark is speech, however short.
_NOTE = re.compile(r"\[([^\[\]]*)\]|\(([^()]*)\)|\{([^{}]*)\}|<([^<>]*)>|\*([^*\n]+)\*")
_SOUND_WORD = re.compile(
    "(?:musik|musig|jingle|applaus|klatsch|beifall|jubel|gelächter|lach(?:t|en|end\\w*|er)?$|kicher|schmunzel|hust|räusper|seufz|atme|schnauf|schnief|niest|nies(?:en)?$|gähn|stöhn|flüster|murmel|summ|pfeif|sing(?:t|en|end\\w*)?$|"
    "wein(?:t|end)|schluchz|schrei|ruft$|stille|pause|schweig|geräusch|rausch|knall|knarr|knister|klopf|klingel|läut|telefon|türe?$|schritt|motor|hup(?:t|en)?$|bell(?:t|en)$|stimmengewirr|unverständlich|unklar|"
    "music|laugh|applause|cough|sigh|breath|noise|sneez|sniff|silence|inaudible|unintelligible|crosstalk|clears?$|rire|rit$|musique|applaudiss|toux|tousse|soupir|bruit|risa(?:te)?$|musica|tosse|sospir|rumor)"
)
_OPENED, _DASH = re.compile(r"[\[({<*]"), re.compile(r"[–—-]")
_SOUND = re.compile(r"(?:(?<=\s)|^)[–—-]\s*(?:musik|applaus|jingle|pause|geräusch|gelächter|husten|lachen|rauschen|stille|music|applause|laughter)\s*[–—-](?=\s|$)", re.I)
#: Hesitation sounds: äh, ähm, öh, öhm, ehm, uhm, hm, mhm with any of their letters drawn out.
_HESITATION = re.compile(r"(?<!\w)(?:ä+h+m*|ä+m+|ö+h+m*|e+h+m+|u+h+m+|h+m+|m+h+m+)(?!\w)(?:…|\.\.\.|,)?", re.I)
_TIDY = (
    (re.compile(r"[♪♫♬]+"), " "),
    (re.compile(r"[–—-](?:\s*[,;]?\s*[–—-])+"), " "),  # what is left of an inserted remark
    (re.compile(r"\s+"), " "),
    (re.compile(r"\s+([,.;:!?…])"), r"\1"),
    (re.compile(r"([,;:])(?:\s*[,;:])+"), r"\1"),
    (re.compile(r"[,;](?=[.!?…])"), ""),
    (re.compile(r"^[\s,.;:!?…–—♪*>-]+|[\s♪*]+$"), ""),
)


def label_number(speaker: str | None) -> int | None:
    """Number of a speaker label in any spelling; None for an absent or unknown speaker."""
    m = _LABEL.match(speaker) if speaker else None
    return int(m[1]) if m else None


def _drop_note(m: re.Match) -> str:
    words = fold(next(g for g in m.groups() if g is not None), umlauts=False).split()
    sounds = [_SOUND_WORD.match(w) is not None for w in words]
    return " " if not words or sounds[0] or 2 * sum(sounds) >= len(words) else m[0]


def shape(text: str) -> int:
    """How a text joins what is around it: 2 if it does not end a sentence, and 1 if it begins with a small letter."""
    ends = text.rstrip("\"'»«“”„)] ").endswith((".", "!", "?", "…"))
    first = next((c for c in text if c.isalpha()), "X")
    return (0 if ends else 2) + int(first.islower())


def clean_segment(text: str | None, speaker: str | None) -> tuple[int | None, str, str]:
    """(speaker number, clean text, folded words). The number is that in speaker or else at the head of text. The words
    are empty if nothing is said."""
    number = label_number(speaker)
    if not text:
        return number, "", ""
    # most segments hold nothing to take out; cheap tests for a pattern's least sign spare them the search
    raw = t = text if text.isascii() else unicodedata.normalize("NFC", text)
    if ":" in t:
        t = _TIME.sub(" ", t)
    for _ in range(2):  # before and after sound notes are gone, since a label may be bracketed like a note
        m = _HEAD.match(t)
        if m:
            number = number if number is not None else int(m[1] or m[2] or m[3])
            t = t[m.end() :]
        if not _OPENED.search(t):
            break
        t = _NOTE.sub(_drop_note, t)
    if _DASH.search(t):
        t = _SOUND.sub(" ", t)
    low = t.lower()
    if "hm" in low or "äh" in low or "öh" in low or "äm" in low:
        t = _HESITATION.sub(" ", t)
    words = fold(t)
    if not words:
        return number, "", ""
    if t is raw and t[0].isalnum() and "♪" not in t:
        return number, " ".join(t.split()), words
    for pattern, put in _TIDY:
        t = pattern.sub(put, t)
    return number, t, words

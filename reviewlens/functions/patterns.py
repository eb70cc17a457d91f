"""Regular expressions and word lists of the two text cleaners.

Each pattern is kept in the part of the regex language that Java and RE2 read
alike, so the same text can be run by Spark and by a checking SQL engine. The
Spark side may add guards that change the cost but not the matches.
"""

from __future__ import annotations

# Code points with the Unicode property Emoji, without 0-9, # and *.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E
1F191-1F19A 1F1E6-1F1FF 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393
1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567
1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC
1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0
1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB
1FAEF-1FAFA
""".split()


def _emoji_class(guarded: bool) -> str:
    def span(item: str) -> str:
        return "-".join(rf"\x{{{end}}}" for end in item.split("-"))

    latin = "".join(span(r) for r in EMOJI_RANGES if len(r) == 2)
    rest = "".join(span(r) for r in EMOJI_RANGES if len(r) > 2)
    if not guarded:
        return f"[{latin}{rest}]"
    # Java class intersection: one comparison rejects ordinary letters before the range list.
    return rf"[{latin}[\x{{203C}}-\x{{1FAFA}}&&[{rest}]]]"


def emoji_pattern(guarded: bool = False) -> str:
    """Keycaps, flags, tagged flags, skin tones and joined sequences, each as one match."""
    one = _emoji_class(guarded) + r"(?:\x{FE0F}|[\x{1F3FB}-\x{1F3FF}])?"
    tags = r"(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
    return rf"{one}{tags}(?:\x{{200D}}{one})*|[#*0-9]\x{{FE0F}}?\x{{20E3}}"


# Every emoji above holds one of these; one comparison rejects most letters.
EMOJI_HINT = r"[\xA9\xAE\x{203C}-\x{1FAFA}]"


# A hashtag ends at any Unicode white space.
NOT_SPACE = (
    r"[^\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
HASHTAG = f"#{NOT_SPACE}+"

# Currency units, longest spelling of a unit first.
PRICE_UNITS = ["nghìn đồng", "đồng", "k", "vnd", "d", "đ"]
PRICE = r"\p{Nd}+(?:[,.]\p{Nd}+)*[,.]? ?(?:" + "|".join(PRICE_UNITS) + ")"
# Java form of PRICE: a number may only start where no longer number already began, and never
# gives digits back, so a long run of digits without a unit costs one pass. The look-behinds sit
# after the first digit, so that other characters are rejected by one comparison.
PRICE_JAVA = (
    r"\p{Nd}(?<!\p{Nd}\p{Nd})(?<!\p{Nd}[,.]\p{Nd})\p{Nd}*+(?:[,.]\p{Nd}++)*+[,.]?+ ?+(?:"
    + "|".join(PRICE_UNITS)
    + ")"
)

# Characters the two cleaners treat as special.
SPECIAL_TRAINING = "\"#$%&'()*+,-/\\:;<=>@[]^_`{|}~\n\r\t"
SPECIAL_ANNOTATION = "\"#$%&'()*+,-./\\:;<=>@[]^_`{|}~\n\r\t"

# Spelling rules of the training cleaner, (written, wanted), in order.
SPELLING_RULES = [
    ("oà ", "òa "), ("oá ", "óa "), ("oả ", "ỏa "), ("oã ", "õa "), ("oạ ", "ọa "),
    ("oè", "òe"), ("oé", "óe"), ("oẻ", "ỏe"), ("oẽ", "õe"), ("oẹ", "ọe"),
    ("uỳ", "ùy"), ("uý", "úy"), ("uỷ", "ủy"), ("uỹ", "ũy"), ("uỵ", "ụy"),
    ("uà", "ùa"), ("uá ", "úa "), ("uả", "ủa"), ("uã", "ũa"), ("uạ", "ụa"),
    ("xẩy", "xảy"), ("bẩy", "bảy"), ("gẫy", "gãy"), ("nvien", "nhân viên "), ("qay", "quay"),
]
DOUBLED_H = ("ìnhh", "ình")

# Whole-word keywords of the annotation cleaner, (written, wanted).
KEYWORDS = [
    ("oà", "òa"), ("oá", "óa"), ("oả", "ỏa"), ("oã", "õa"), ("oạ", "ọa"),
    ("oè", "òe"), ("oé", "óe"), ("oẻ", "ỏe"), ("oẽ", "õe"), ("oẹ", "ọe"),
    ("uỳ", "ùy"), ("uý", "úy"), ("uỷ", "ủy"), ("uỹ", "ũy"), ("uỵ", "ụy"),
    ("uà", "ùa"), ("uá", "úa"), ("uả", "ủa"), ("uã", "ũa"), ("uạ", "ụa"),
    ("xẩy", "xảy"), ("bẩy", "bảy"), ("gẫy", "gãy"),
    ("k", "không"), ("hông", "không"), ("ko", "không"), ("khong", "không"),
]

# Characters that NFC neither changes nor combines with a neighbour: everything below the
# combining marks, Vietnamese precomposed letters, punctuation, currency signs, symbols, emoji.
# A text made of these alone is already normal.
NFC_STABLE = (
    r"[\x00-\x{02FF}\x{1EA0}-\x{1EF9}\x{2002}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20C0}"
    r"\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F300}-\x{1FAFF}]"
)
# All others; Java form, where one comparison rejects what lies below the combining marks.
NFC_UNSTABLE = r"[\x{0300}-\x{10FFFF}&&[^" + NFC_STABLE[1:] + "]"


def escape_class(chars: str) -> str:
    """A regex class holding exactly ``chars``, readable by Java and RE2."""
    names = {"\n": r"\n", "\r": r"\r", "\t": r"\t"}
    return "[" + "".join(names.get(c, "\\" + c if not c.isalnum() and c != "_" else c) for c in chars) + "]"

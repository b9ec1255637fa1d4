"""Entity extraction from document text as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extraction patterns by kind, in order; all but names ignore case.
PATTERNS: dict[str, tuple[int, list[str]]] = {
    "names": (0, [
        r"\b(?:[A-Z][a-z]+\s+(?:Singh|Kumar|Devi|Rani|Prasad|Sharma|Gupta|Yadav|Patel|Das|Ray|Bai|Wati|Shah|Jain|Agrawal|Mishra|Tiwari|Pandey|Chaudhary|Verma|Srivastava))\b",
        r"\b(?:[A-Z][a-z]+\s+(?:Chakraborty|Bhattacharya|Mukherjee|Banerjee|Roy|Ghosh|Sen|Basu|Mitra|Dutta|Bose|Sarkar|Paul|Das|Ray))\b",
        r"\b(?:[A-Z][a-z]+\s+(?:Raman|Krishnan|Murugan|Subramanian|Natarajan|Iyer|Iyengar|Reddy|Naidu|Pillai|Nair))\b",
        r"\b(?:[A-Z][a-z]+\s+(?:Reddy|Naidu|Rao|Raju|Prasad|Kumar|Devi|Lakshmi|Krishna|Rama))\b",
        r"\b(?:[A-Z][a-z]+\s+(?:Bhil|Gond|Santhal|Munda|Oraon|Khond|Baiga|Korku|Bharia|Sahariya))\b",
        r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){1,2}\b",
        r"(?:आवेदक\s*का\s*नाम|नाम)[\s:]+([^\n]+)",
        r"(?:पिता\s*का\s*नाम)[\s:]+([^\n]+)",
        r"(?:माता\s*का\s*नाम)[\s:]+([^\n]+)",
        r"\b[ऀ-ॿ]+(?:\s+[ऀ-ॿ]+){1,2}\b",
        r"\b[ঀ-৿]+(?:\s+[ঀ-৿]+){1,2}\b",
        r"\b[ఀ-౿]+(?:\s+[ఀ-౿]+){1,2}\b",
        r"\b[஀-௿]+(?:\s+[஀-௿]+){1,2}\b",
    ]),
    "claim_types": (0, [
        r"\b(?:IFR|Individual\s+Forest\s+Rights?)\b",
        r"\b(?:CFR|Community\s+Forest\s+Resource\s+Rights?)\b",
        r"\b(?:CR|Community\s+Rights?)\b",
        r"(?:NTFP|Non[-\s]?Timber\s+Forest\s+Produce)\s+(?:Rights?|Collection)",
        r"(?:Grazing|Pastoral|चराई)\s+(?:Rights?|अधिकार)",
        r"(?:Fish|Fishing|मत्स्य)\s+(?:Rights?|अधिकार)",
        r"(?:Water|जल)\s+(?:Rights?|अधिकार|Body)",
        r"(?:Cultivation|कृषि|Agricultural)\s+(?:Rights?|अधिकार)",
        r"(?:Settlement|Habitation|निवास|आवास)\s+(?:Rights?|अधिकार)",
        r"(?:Homestead|घर\s*स्थल)\s+(?:Rights?|अधिकार)",
        r"Form\s*[A-Z]\s*(?:Application|आवेदन)",
        r"(?:Title|पट्टा|स्वामित्व)\s+(?:Rights?|अधिकार)",
    ]),
    "claim_status": (0, [
        r"\b(?:approved|स्वीकृत|मंजूर)\b",
        r"\b(?:rejected|अस्वीकृत|नामंजूर)\b",
        r"\b(?:pending|लंबित|विचाराधीन)\b",
        r"\b(?:under\s+(?:review|consideration)|समीक्षाधीन)\b",
        r"\b(?:verified|सत्यापित|जांचा\s+गया)\b",
        r"\b(?:survey\s+(?:completed|done)|सर्वेक्षण\s+(?:पूर्ण|हो\s+गया))\b",
        r"\b(?:title\s+(?:granted|issued)|पट्टा\s+(?:दिया\s+गया|जारी))\b",
        r"\b(?:in\s+process|प्रक्रियाधीन)\b",
        r"\b(?:objection|आपत्ति)\b",
        r"\b(?:withdrawn|वापस\s+लिया\s+गया)\b",
    ]),
    "document_types": (0, [
        r"(?:Form|फॉर्म)\s*[A-Z]*[0-9]+",
        r"(?:Application|आवेदन)\s+(?:for|के\s+लिए)\s+Forest\s+Rights",
        r"(?:Survey|सर्वेक्षण)\s+(?:Settlement|बस्ती)\s+Record",
        r"(?:Revenue|राजस्व)\s+(?:Record|रिकॉर्ड)",
        r"(?:Khasra|खसरा)\s+(?:Number|नंबर)",
        r"(?:Patta|पट्टा)\s+(?:Document|दस्तावेज)",
    ]),
    "survey_numbers": (1, [
        r"(?:Survey|सर्वेक्षण)\s+(?:No|Number|संख्या)[.:\s]*([0-9/\-]+)",
        r"(?:Khasra|खसरा)\s+(?:No|Number|संख्या)[.:\s]*([0-9/\-]+)",
        r"(?:Plot|प्लॉट)\s+(?:No|Number|संख्या)[.:\s]*([0-9/\-]+)",
        r"(?:Sub-division|उप-विभाग)\s+([0-9/\-]+)",
    ]),
    "boundaries": (0, [
        r"(?:North|उत्तर)[\s:]+([A-Za-zऀ-ॿ\s0-9,.-]+)(?=(?:South|दक्षिण|East|पूर्व|West|पश्चिम|\.|$))",
        r"(?:South|दक्षिण)[\s:]+([A-Za-zऀ-ॿ\s0-9,.-]+)(?=(?:North|उत्तर|East|पूर्व|West|पश्चिम|\.|$))",
        r"(?:East|पूर्व)[\s:]+([A-Za-zऀ-ॿ\s0-9,.-]+)(?=(?:North|उत्तर|South|दक्षिण|West|पश्चिम|\.|$))",
        r"(?:West|पश्चिम)[\s:]+([A-Za-zऀ-ॿ\s0-9,.-]+)(?=(?:North|उत्तर|South|दक्षिण|East|पूर्व|\.|$))",
    ]),
    "villages": (1, [
        r"(?:Village|Gram|ग्राम|गाँव|गांव|গ্রাম|గ్రామం|গাঁও)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿ఀ-౿஀-௿]+)",
        r"(?:Vill|V\.)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿ఀ-౿஀-௿]+)",
        r"गाव[\s:]+([A-Za-zऀ-ॿ\s]+)",
        r"(?:Tehsil|तहसील|তহসিল|তেহসিল)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿]+)",
        r"(?:Block|ब्लॉक|ব্লক|బ్లాక్)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿ఀ-౿]+)",
        r"(?:District|जिला|জেলা|जिल्हा|జిల్లా)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿ఀ-౿]+)",
        r"(?:Mandal|मंडल|মণ্ডল)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿]+)",
        r"(?:Forest|वन|বন|అరణ్యం|ป่า)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿ఀ-౿]+)",
        r"(?:Settlement|बस्ती|বসতি|నివాసం)[\s:]+([A-Za-zऀ-ॿ\sঀ-৿ఀ-౿]+)",
    ]),
    "areas": (0, [
        r"(\d+(?:\.\d+)?)\s*(?:acre|hectare|आकर|हेक्टेयर)",
        r"(\d+(?:\.\d+)?)\s*(?:sq\s*m|sqm|square\s*meter|वर्ग\s*मीटर)",
        r"(\d+(?:\.\d+)?)\s*(?:bigha|बीघा|biswa|बिस्वा|katha|कट्ठा|dhur|धूर)",
        r"(\d+(?:\.\d+)?)\s*(?:guntha|गुंठा|ropani|रोपनी|satak|शतक)",
        r"(\d+(?:\.\d+)?)\s*(?:cent|ground|kani|veli|வேலி|gajam|గజం|killa)",
        r"(\d+(?:\.\d+)?)\s*(?:katha|কাঠা|chhatak|ছাটাক|decimal)",
        r"(?:Area|Land|Plot|Khasra)[\s:]+(\d+(?:\.\d+)?)\s*(?:acre|hectare|bigha|एकड़|बीघा|गुंठा)",
        r"(?:क्षेत्रफल|क्षेत्र|जमीन)[\s:]+(\d+(?:\.\d+)?)\s*(?:एकड़|बीघा|गुंठा|हेक्टेयर)",
        r"(\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?)\s*(?:acre|hectare|bigha|एकड़)",
        r"(\d+/\d+)\s*(?:acre|hectare|bigha|एकड़)",
    ]),
    "coordinates": (0, [
        r"""(\d{1,2}[°'"\s]*\d{0,2}[°'"\s]*\d{0,2}["\s]*[NS][,\s]*\d{1,3}[°'"\s]*\d{0,2}[°'"\s]*\d{0,2}["\s]*[EW])""",
        r"(\d+\.\d+)[,\s]+(\d+\.\d+)",
        r"Lat[itude]*[\s:]+([\d\.]+)[,\s]*Lon[gitude]*[\s:]+([\d\.]+)",
    ]),
    "dates": (0, [
        r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",
        r"\b\d{4}-\d{2}-\d{2}\b",
        r"\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[,\s]+\d{2,4}\b",
        r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[,\s]+\d{1,2}[,\s]+\d{2,4}\b",
        r"\b\d{1,2}\s+(?:जनवरी|फरवरी|मार्च|अप्रैल|मई|जून|जुलाई|अगस्त|सितम्बर|अक्टूबर|नवम्बर|दिसम्बर)[,\s]+\d{2,4}\b",
        r"\b\d{1,2}\s+(?:জানুয়ারি|ফেব্রুয়ারি|মার্চ|এপ্রিল|মে|জুন|জুলাই|আগস্ট|সেপ্টেম্বর|অক্টোবর|নভেম্বর|ডিসেম্বর)[,\s]+\d{2,4}\b",
        r"(?:Application\s+(?:Date|dated)|आवेदन\s+(?:दिनांक|तारीख))[\s:]+([\d/\-\.]+)",
        r"(?:Survey\s+(?:Date|dated)|सर्वेक्षण\s+(?:दिनांक|तारीख))[\s:]+([\d/\-\.]+)",
        r"(?:Approval\s+(?:Date|dated)|अनुमोदन\s+(?:दिनांक|तारीख))[\s:]+([\d/\-\.]+)",
    ]),
}

#: What a text holds, in lower case, if a pattern matches anywhere in it: one of these words and, if there is a second part,
#: a place like that; None: anything may match. A pattern that begins with a number has one of its words behind it, and nothing but
#: numbers, blanks, dots, dashes and slashes between. Patterns are run on no other texts, as most of them match in few.
NEEDS: dict[str, list[tuple[str, ...] | None]] = {
    "names": [
        ("singh kumar devi rani prasad sharma gupta yadav patel das ray bai wati shah jain agrawal mishra tiwari pandey chaudhary verma srivastava",),
        ("chakraborty bhattacharya mukherjee banerjee roy ghosh sen basu mitra dutta bose sarkar paul das ray",),
        ("raman krishnan murugan subramanian natarajan iyer iyengar reddy naidu pillai nair",),
        ("reddy naidu rao raju prasad kumar devi lakshmi krishna rama",),
        ("bhil gond santhal munda oraon khond baiga korku bharia sahariya",),
        None, ("नाम",), ("पिता",), ("माता",), ("", "[ऀ-ॿ]"), ("", "[ঀ-৿]"), ("", "[ఀ-౿]"), ("", "[஀-௿]"),
    ],
    "claim_types": [
        ("ifr individual",), ("cfr community", r"cfr|community\s+forest"), ("cr community", r"(?<![a-z0-9_])cr(?![a-z0-9_])|community\s+right"), ("ntfp timber",), ("grazing pastoral चराई",), ("fish मत्स्य",), ("water जल",),
        ("cultivation कृषि agricultural",), ("settlement habitation निवास आवास",), ("homestead घर",), ("application आवेदन", r"form\s*[a-z]\s*(?:app|आ)"), ("title पट्टा स्वामित्व",),
    ],
    "claim_status": [
        ("approved स्वीकृत मंजूर",), ("rejected अस्वीकृत नामंजूर",), ("pending लंबित विचाराधीन",), ("under समीक्षाधीन",), ("verified सत्यापित जांचा",), ("survey सर्वेक्षण", r"survey\s+[cd]|सर्वेक्षण\s+[पह]"),
        ("title पट्टा",), ("process प्रक्रियाधीन",), ("objection आपत्ति",), ("withdrawn वापस",),
    ],
    "document_types": [("form फॉर्म", r"(?:form|फॉर्म)\s*[a-z]*[0-9]"), ("application आवेदन", r"(?:application|आवेदन)\s+(?:for|के)"), ("survey सर्वेक्षण", r"(?:survey|सर्वेक्षण)\s+(?:set|ब)"), ("revenue राजस्व",), ("khasra खसरा",), ("patta पट्टा",)],
    "survey_numbers": [("survey सर्वेक्षण", r"(?:survey|सर्वेक्षण)\s+(?:no|nu|सं)"), ("khasra खसरा",), ("plot प्लॉट",), ("sub-division उप-विभाग",)],
    "boundaries": [("north उत्तर",), ("south दक्षिण",), ("east पूर्व",), ("west पश्चिम",)],
    "villages": [
        ("village gram ग्राम गाँव गांव গ্রাম గ్రామం গাঁও",), ("vill v.", r"(?:vill|v\.)[\s:]"), ("गाव",), ("tehsil तहसील তহসিল তেহসিল",), ("block ब्लॉक ব্লক బ్లాక్",), ("district जिला জেলা जिल्हा జిల్లా",), ("mandal मंडल মণ্ডল",),
        ("forest वन বন అరణ్యం ป่า",), ("settlement बस्ती বসতি నివాసం",),
    ],
    "areas": [
        ("acre hectare आकर हेक्टेयर",), ("sq वर्ग", r"\d\s*(?:sq|व)"), ("bigha बीघा biswa बिस्वा katha कट्ठा dhur धूर",), ("guntha गुंठा ropani रोपनी satak शतक",), ("cent ground kani veli வேலி gajam గజం killa", r"\d\s*[cgkvவగ]"),
        ("katha কাঠা chhatak ছাটাক decimal",), ("area land plot khasra", r"(?:area|land|plot|khasra)[\s:]+\d"), ("क्षेत्र जमीन",), ("acre hectare bigha एकड़", r"\d\s*[-–]\s*\d[\d.]*\s*[ahbए]"), ("acre hectare bigha एकड़", r"\d/\d+\s*[ahbए]"),
    ],
    "coordinates": [("", r"[ns][,\s]*\d"), (".", r"\.\d+[,\s]+\d"), ("lat",)],
    "dates": [
        ("- /", r"[-/](?<!\d\d\d[-/])\d{1,2}[-/]\d\d"), ("-", r"-\d\d-\d\d"), *[("jan feb mar apr may jun jul aug sep oct nov dec", p) for p in (r"\d\s+[jfmasond]", r"[jfmasond][a-z]{2,}[,\s]+\d")],
        ("जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितम्बर अक्टूबर नवम्बर दिसम्बर",), ("জানুয়ারি ফেব্রুয়ারি মার্চ এপ্রিল মে জুন জুলাই আগস্ট সেপ্টেম্বর অক্টোবর নভেম্বর ডিসেম্বর",),
        ("application आवेदन", r"(?:application|आवेदन)\s+[dदत]"), ("survey सर्वेक्षण", r"(?:survey|सर्वेक्षण)\s+[dदत]"), ("approval अनुमोदन", r"(?:approval|अनुमोदन)\s+[dदत]"),
    ],
}

# Words that no name contains.
NAME_EXCLUSIONS = ["Village", "District", "State", "Claim", "Forest", "Rights", "Form", "Application", "Survey", "Number", "Date", "Block", "Tehsil", "Gram", "Panchayat", "Officer", "Department", "Government", "Committee"]

# A value of a kind is longer than this, once trimmed.
LONGER_THAN = {"names": 2, "claim_types": 1, "claim_status": 2, "document_types": 1, "survey_numbers": 0, "boundaries": 5, "villages": 2, "areas": 0, "coordinates": 2, "dates": 4}
TRIMMED = {"claim_types", "claim_status", "document_types", "survey_numbers", "boundaries", "villages"}
KINDS = tuple(LONGER_THAN)

# The first script present names the languages.
SCRIPTS = [("[ऀ-ॿ]", "hin+mar"), ("[ঀ-৿]", "ben"), ("[઀-૿]", "guj"), ("[஀-௿]", "tam"), ("[ఀ-౿]", "tel")]


#: Characters of words, without the full stops of Devanagari. Spark's own word boundary does not count vowel signs, with which many Indic words end.
WORD = "0-9A-Za-z_ऀ-\u0963\u0966-९ॱ-ॿঀ-৿ఀ-౿஀-௿"


def pattern_text(kind: str, pattern: str) -> str:
    """The pattern as it is run: names respect case, but for their labels, all else ignores it.

    Word boundaries of patterns with Indic words are edges of runs of WORD.
    """
    if not pattern.isascii() and pattern.startswith(r"\b") and pattern.endswith(r"\b"):
        pattern = f"(?<![{WORD}]){pattern[2:-2]}(?![{WORD}])"
    return pattern if kind == "names" else "(?i)" + pattern


def _trim(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\n\v\f\r"))


@cache
def _characters(*categories: str) -> str:
    """Characters of Unicode categories beyond ASCII, as ranges of a pattern's class."""
    spans: list[list[int]] = []
    for c in range(0x80, 0x20000):
        if category(chr(c)) in categories:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in spans)


def _for_python(kind: str, pattern: str) -> str:
    """The pattern for Python's engine, with the meaning that Spark's has: a combining mark belongs to the word of its letter, and ends of lines are not ends of texts alone.

    Where a pattern begins with a class of letters, what stands before is looked at after the first letter, as engines skip to a class quickly.
    """
    text, letters, marks = pattern_text(kind, pattern), _characters("Lu", "Ll", "Lt", "Lm", "Lo", "Nd"), _characters("Mn")
    if pattern.isascii():
        marked = [f"[0-9A-Za-z{letters}]" + f"[{marks}]" * n for n in (1, 2, 3)]
        far = lambda first: "".join(f"(?<!{x}{first})" for x in (f"[{letters}]", *marked))
        not_after = lambda first: f"(?<![0-9A-Za-z_]{first})(?:(?<![^\\x00-\\x7f]{first})|{far(first)})"
        text = re.sub(r"\\b$", lambda _: f"(?![0-9A-Za-z_])(?:(?![^\\x00-\\x7f])|(?![{letters}{marks}]))", text)
        if kind == "names":  # letters, then blanks, then what is no letter: nothing is gained by trying fewer of them
            text = re.sub(r"^\\b(\(\?:)?\[A-Z\]", lambda m: f"{m[1] or ''}[A-Z](?=[a-z]+\\s+[A-Z]){not_after('[A-Z]')}", text)
            text = re.sub(r"(\[a-z\](?:\+|\{2,\})|\\s\+)(?!\[A-Z\]\))", r"\1+", text)
        text = re.sub(r"^((?:\(\?i\))?)\\b", lambda m: m[1] + not_after(""), text)
    elif text.startswith(f"(?<![{WORD}])["):
        first = re.match(r"\[.-.\]", text[len(f"(?<![{WORD}])"):])[0]
        text = text.replace(f"(?<![{WORD}]){first}+", f"{first}(?<![{WORD}]{first}){first}*+", 1)
    return text.replace("|$)", "|(?:\r\n|[\n\r\x85\u2028\u2029])?\\Z)")


def _first_words(pattern: str) -> list[str] | None:
    """Words in lower case, one of which any match begins with; None if that cannot be told."""
    body, depth, parts = pattern.removeprefix(r"\b"), 0, [""]
    for i, c in enumerate(body.removeprefix("(?:") if body.startswith("(?:") else ""):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    words = [re.match(r"(?:[^\\\[\](){}.?*+|^$]|\\[.\-])*(?![?*{])", part)[0].replace("\\", "").lower() for part in (parts if parts != [""] else [body])]
    return words if all(words) else None


_BLANKS, _DIGITS = " \t\n\v\f\r", frozenset("0123456789")
#: What may stand between the start of a number and the word or sign by which a pattern that begins with a number is found.
_LEAD = _DIGITS | frozenset(".-–/" + _BLANKS)


def _anchors(pattern: str, need: tuple[str, ...] | None) -> tuple[list[str] | None, list[str], bool]:
    """(words at which the pattern is tried or None, words that it needs, whether it begins with a number and those words come behind)."""
    words = need[0].split(" ") if need else [""]
    lead = pattern.removeprefix(r"\b").removeprefix("(").startswith(r"\d") and words != [""]
    spots = None if need is None else words if lead else _first_words(pattern)
    return spots, spots or words, lead


@cache
def _finder(kind: str, needs: tuple):
    """Function of a text, the text with A-Z in lower case, and the words it holds: values of one kind, each once.

    A pattern is tried at places alone where one of its first words stands or, if it begins with a number, before
    one of its words. Other patterns, and those that need nothing, are searched for in the whole text.
    """
    group, patterns = PATTERNS[kind]
    steps = []
    for pattern, need in zip(patterns, needs, strict=True):
        spots, words, lead = _anchors(pattern, need)
        place = re.compile(need[1], re.ASCII).search if need and len(need) > 1 and (lead or spots is None) else None
        steps.append((re.compile(_for_python(kind, pattern), re.ASCII), frozenset(words), spots is not None, lead, pattern.startswith(r"\b"), place))
    least, trimmed = LONGER_THAN[kind], kind in TRIMMED
    a_name = re.compile("[A-Za-zऀ-ॿঀ-৿ఀ-౿஀-௿]").match

    def numbers(text: str, spots: list[int], bounded: bool) -> Iterator[int]:
        """Where a number may begin that leads up to one of the spots, each once."""
        tried = 0
        for spot in spots:
            at = spot
            while at > tried and text[at - 1] in _BLANKS:
                at -= 1
            if at > tried and text[at - 1] in _DIGITS:
                while at > tried and text[at - 1] in _LEAD:
                    at -= 1
                for start in range(at, spot):
                    if text[start] in _DIGITS and not (bounded and start and text[start - 1] in _DIGITS):
                        yield start
                tried = spot

    def find(text: str, lower: str, held: set[str]) -> list[str]:
        out: list[str] = []
        for pattern, words, anchored, lead, bounded, place in steps:
            if held.isdisjoint(words) or place is not None and not place(lower):
                continue
            if not anchored:
                out += [match[group] for match in pattern.finditer(text)]
                continue
            spots = []
            for word in held & words:
                at = lower.find(word)
                while at >= 0:
                    spots.append(at)
                    at = lower.find(word, at + 1)
            end, spots = 0, sorted(set(spots)) if len(spots) > 1 else spots
            for start in numbers(text, spots, bounded) if lead else spots:
                if start >= end and (match := pattern.match(text, start)):
                    out.append(match[group])
                    end = match.end()
        if not out:
            return out
        if trimmed:
            out = [x.strip(_BLANKS) for x in out]
        if kind == "villages":
            out = [x.replace(",", "").replace(".", "").replace(";", "") for x in out]
        out = [x for x in dict.fromkeys(out) if len(x.strip(_BLANKS)) > least]
        if kind == "names":
            out = [x for x in out if a_name(x.lstrip(_BLANKS)) and not any(map(x.__contains__, NAME_EXCLUSIONS))]
        return out

    return find


@cache
def _all_words() -> tuple[list[str], list[str]]:
    """Words that all patterns are found by: those of letters alone, and others."""
    words = {w for kind, (_, patterns) in PATTERNS.items() for p, need in zip(patterns, NEEDS[kind], strict=True) for w in _anchors(p, need)[1]} - {""}
    plain = [w for w in sorted(words) if w.isascii() and w.isalpha() or all(c > "\x7f" for c in w)]
    return plain, sorted(words - set(plain))


class _WordsOfRuns(dict):
    """Words of patterns in runs of letters (A-Z in lower case, UTF-8) met before, as most runs come again and again."""

    def __missing__(self, run: bytes) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        text = run.decode()
        found = self[run] = tuple(w for w in _all_words()[0] if w in text)
        return found


_IN_RUN = _WordsOfRuns()
#: A-Z to a-z, and all else of ASCII to blanks.
_LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: What was made of the last batch.
_LAST: list = [None, None, None]


def _prepared(texts: pa.Array) -> list[tuple[str, str, set[str]]]:
    """Each text, in lower case (A-Z alone), and the words of patterns in it; kept, as the functions of all kinds get the same batch in turn."""
    place = (texts.offset, len(texts), *[b and b.address for b in texts.buffers()])  # of memory that stays taken as long as the array is kept
    if _LAST[0] != place:
        out, others, words = [], _all_words()[1], _IN_RUN.__getitem__
        for text in texts.cast(pa.binary()).to_pylist():
            text = text or b""
            lower, held = text.lower().decode(), {""}.union(*map(words, text.translate(_LETTERS).split()))
            for word in others:
                if word in lower:
                    held.add(word)
            out.append((text.decode(), lower, held))
        _LAST[:] = place, out, texts
    return _LAST[1]


def entities(text: Column, kind: str) -> Column:
    """Values of one kind, in pattern order, then by position, each once; null text: empty."""
    needs = tuple(NEEDS[kind])

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        find = _finder(kind, needs)
        return pa.array([find(*told) for told in _prepared(texts)], pa.list_(pa.string()))

    return found(text)


def all_entities(text: Column) -> Column:
    return F.struct(*[entities(text, k).alias(k) for k in KINDS])


def claim_type(types: Column) -> Column:
    """IFR, CFR, CR by substring, in that order, else the first value, else Unknown."""
    has = lambda code, phrase: F.exists(types, lambda t: F.contains(F.upper(t), F.lit(code)) | F.contains(F.lower(t), F.lit(phrase)))
    return F.when(has("IFR", "individual"), "IFR").when(has("CFR", "community forest"), "CFR").when(has("CR", "community rights"), "CR").otherwise(F.coalesce(F.get(types, 0), F.lit("Unknown")))


def claim_status(values: Column) -> Column:
    """approved, rejected, verified, else the first in lower case, else pending.

    Hindi words count as whole values: the one for rejected contains the one for approved.
    """
    has = lambda word, own: F.exists(values, lambda s: F.contains(F.lower(s), F.lit(word)) | (s == own))
    return F.when(has("approved", "स्वीकृत"), "approved").when(has("rejected", "अस्वीकृत"), "rejected").when(has("verified", "सत्यापित"), "verified").otherwise(F.coalesce(F.lower(F.get(values, 0)), F.lit("pending")))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"\d+(?:\.\d+)?", 0).try_cast("double")


def detect_language(text: Column) -> Column:
    out = F.lit("eng+hin")
    for script, code in reversed(SCRIPTS):
        out = F.when(text.rlike(script), code).otherwise(out)
    return out


def normalise_language(codes: Column) -> Column:
    """mixed for several codes, else the one; eng for none."""
    parts = F.split(F.coalesce(codes, F.lit("")), r"\+")
    return F.when(F.size(parts) > 1, "mixed").when(F.get(parts, 0) == "", "eng").otherwise(F.get(parts, 0))


def merge_values(left: Column, right: Column) -> Column:
    """left, then right's values of over two characters, each once, order kept."""
    return F.array_union(left, F.filter(right, lambda x: F.length(_trim(x)) > 2))


def correction(original: Column, corrected: Column, confidence: Column) -> Column:
    """struct(flags, confidence) of a corrected text; confident or short texts stay as they are."""
    skip = (confidence > 85) | (F.length(original) < 100)
    flags = F.array_compact(F.array(F.when(F.length(original) != F.length(corrected), F.lit("length-adjustment")), F.when(original != corrected, F.lit("text-corrections"))))
    return F.struct(F.when(skip, F.array().cast("array<string>")).otherwise(flags).alias("flags"), F.when(skip, confidence).otherwise(F.least(confidence + 10, F.lit(95.0))).alias("confidence"))


def image_quality(width: Column, mean: Column, stdev: Column) -> Column:
    by_size = F.when(width < 800, "low").when(width > 3000, "high").otherwise("good")
    by_stats = F.when((stdev > 40) & (mean > 50) & (mean < 200), "excellent").when(stdev > 25, "good").otherwise("fair")
    return F.when(mean.isNull() | stdev.isNull(), by_size).otherwise(by_stats)


def mask_name(name: Column) -> Column:
    """First letter and stars for each further letter."""
    return F.regexp_replace(name, r"(?<=\w)\w", "*")

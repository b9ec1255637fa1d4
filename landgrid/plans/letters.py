"""A letter per claim in one of five languages, with all that it says as truth for the extraction operators.

Text and truth are built from the same expressions, which Spark and DuckDB both run.
"""

from __future__ import annotations

from .views import LETTER

_ID = "CAST(id AS BIGINT)"
_DAY, _YEAR = "CAST(day(CAST(created_at AS DATE)) AS STRING)", "CAST(year(CAST(created_at AS DATE)) AS STRING)"
_AREA = "CAST(CAST(coalesce(area, 0) AS DECIMAL(8, 2)) AS STRING)"
_PLACE = "concat('Lat: ', CAST(CAST(coalesce(latitude, 0) AS DECIMAL(10, 5)) AS STRING), ', Lon: ', CAST(CAST(longitude AS DECIMAL(10, 5)) AS STRING))"
_NUMBER = f"concat(CAST({_ID} % 900 AS STRING), '/', CAST({_ID} % 7 AS STRING))"
_FORM = f"CAST({_ID} % 10 AS STRING)"


def pick(*values: str) -> str:
    """One of the values by the claim's number."""
    return f"CASE floor({_ID} / 5) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def by_status(verified: str, rejected: str, pending: str, review: str) -> str:
    return f"CASE status WHEN 'verified' THEN '{verified}' WHEN 'rejected' THEN '{rejected}' WHEN 'pending' THEN '{pending}' ELSE '{review}' END"


_STATUS = by_status("approved", "rejected", "pending", "under review")
_LONG = "CASE claim_type WHEN 'IFR' THEN 'Individual Forest Rights' WHEN 'CFR' THEN 'Community Forest Resource Rights' ELSE 'Community Rights' END"
_ENGLISH_VILLAGE = f"CASE {_ID} % 4 WHEN 0 THEN 'Rampur' WHEN 1 THEN 'Sitapur' WHEN 2 THEN 'Bandhavgarh' ELSE 'Kheri' END"


def _fields(names, villages, area, date, status, types, form, boundaries) -> dict[str, list[str]]:
    return {
        "names": [names], "claim_types": types, "claim_status": [status], "document_types": form, "survey_numbers": [_NUMBER],
        "boundaries": boundaries, "villages": [villages], "areas": [f"concat({_AREA}, ' {area}')"], "coordinates": [_PLACE], "dates": [date],
    }


_BOUNDS = ["'North: river bank'", "'South: hill road'"]
_FORMS = [f"concat('Form A', {_FORM})", "'Revenue Record'"]

#: language -> kind -> what a letter in that language says, as expressions.
TRUTH: dict[str, dict[str, list[str]]] = {
    "eng": _fields("claimant_name", _ENGLISH_VILLAGE, "acre", "CAST(CAST(created_at AS DATE) AS STRING)", _STATUS, ["claim_type", _LONG], _FORMS, _BOUNDS),
    "hin": _fields(
        pick("सीता देवी", "मोहन लाल यादव", "गीता बाई"), pick("रामपुर", "सीतापुर", "खेड़ी"), "हेक्टेयर", f"concat({_DAY}, ' ', {pick('मार्च', 'जून')}, ' ', {_YEAR})",
        by_status("स्वीकृत", "अस्वीकृत", "लंबित", "समीक्षाधीन"), [pick("कृषि अधिकार", "जल अधिकार", "चराई अधिकार")], [f"concat('फॉर्म A', {_FORM})", "'राजस्व रिकॉर्ड'"],
        ["'उत्तर: नदी का किनारा'", "'दक्षिण: पहाड़ी सड़क'"]),
    "ben": _fields(
        pick("রাম দাস", "মিতা রানী ঘোষ"), pick("রামপুর", "শান্তিপুর", "কালীগ্রাম"), "কাঠা", f"concat({_DAY}, ' ', {pick('মার্চ', 'জুন')}, ' ', {_YEAR})",
        _STATUS, [_LONG], _FORMS, _BOUNDS),
    "tel": _fields(pick("రాము నాయుడు", "సీత లక్ష్మి దేవి"), pick("రామపురం", "కొత్తపల్లి"), "గజం", "CAST(CAST(created_at AS DATE) AS STRING)", _STATUS, [_LONG], _FORMS, _BOUNDS),
    "tam": _fields(pick("முருகன் பிள்ளை", "லட்சுமி நாயர்"), pick("ராமபுரம்", "புதூர்"), "வேலி", "CAST(CAST(created_at AS DATE) AS STRING)", _STATUS, [_LONG], _FORMS, _BOUNDS),
}

#: language -> labels of the fields, in the order of the letter.
_LABELS = {
    "hin": ("आवेदक का नाम: ", "ग्राम: ", "क्षेत्र ", "आवेदन ", "स्थिति: ", "प्रकार: ", "सर्वेक्षण संख्या: "),
    "ben": ("আবেদনকারী: ", "গ্রাম: ", "জমি ", "তারিখ: ", "Status: ", "Type: ", "Survey No: "),
    "tel": ("దరఖాస్తుదారు: ", "గ్రామం: ", "భూమి ", "తేదీ: ", "Status: ", "Type: ", "Survey No: "),
    "tam": ("விண்ணப்பதாரர்: ", "Village: ", "நிலம் ", "தேதி: ", "Status: ", "Type: ", "Survey No: "),
}


def _letter(language: str) -> str:
    t, labels = TRUTH[language], _LABELS[language]
    (name,), (village,), (area,), (date,), (status,), (kind,), (number,), (place,) = (t[k] for k in ("names", "villages", "areas", "dates", "claim_status", "claim_types", "survey_numbers", "coordinates"))
    said = [f"'{labels[0]}', {name}, ', 40.', chr(10)"]
    said += [f"'{label}', {value}, '. '" for label, value in zip(labels[1:], (village, area, date, status, kind, number), strict=True)]
    said += [f"{place}, ' ; '", f"{t['document_types'][0]}, ', ', {t['document_types'][1]}, '; '", f"{t['boundaries'][0]}, ' ', {t['boundaries'][1]}"]
    return f"concat({', '.join(said)})"


#: The language of a claim's letter, and its text.
LANGUAGE = f"CASE {_ID} % 5 WHEN 1 THEN 'hin' WHEN 2 THEN 'ben' WHEN 3 THEN 'tel' WHEN 4 THEN 'tam' ELSE 'eng' END"
TEXT = f"CASE {_ID} % 5 WHEN 1 THEN {_letter('hin')} WHEN 2 THEN {_letter('ben')} WHEN 3 THEN {_letter('tel')} WHEN 4 THEN {_letter('tam')} ELSE {LETTER} END"


def truth(kind: str, array: str) -> str:
    """The values of one kind, as an array made by the engine's function `array`."""
    return f"CASE {_ID} % 5 " + " ".join(f"WHEN {i} THEN {array}({', '.join(TRUTH[code][kind])})" for i, code in ((1, "hin"), (2, "ben"), (3, "tel"), (4, "tam"))) + f" ELSE {array}({', '.join(TRUTH['eng'][kind])}) END"

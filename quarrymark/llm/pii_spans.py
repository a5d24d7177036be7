"""Candidate segments of personal information in a text, and their whole-span features.

A candidate is (start, end, kind, features). Candidates overlap freely and most are wrong; the
model chooses among them. As a semi-Markov model demands, segments have bounds: MAX_SPAN
characters, NAME_TOKENS parts of a name, TOWN_WORDS words of a town.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

MAX_SPAN = 160
NAME_TOKENS = 7
TOWN_WORDS = 4
KINDS = ("email", "phone", "id_number", "address", "name")


@dataclass
class Gazetteer:
    """Lower-case given names, family names and towns; may be empty."""

    given: frozenset[str] = field(default_factory=frozenset)
    family: frozenset[str] = field(default_factory=frozenset)
    towns: frozenset[str] = field(default_factory=frozenset)


_AT = r"(?:@|[ \t]?\([ \t]?at[ \t]?\)[ \t]?|[ \t]?\[[ \t]?at[ \t]?\][ \t]?|[ \t]@[ \t]|[ \t]at[ \t](?=[\w-]+[ \t](?:dot|\(dot\)|\[dot\])[ \t]))"
_DOT = r"(?:\.|[ \t]?\([ \t]?dot[ \t]?\)[ \t]?|[ \t]?\[[ \t]?dot[ \t]?\][ \t]?|[ \t]dot[ \t])"
_EMAIL = re.compile(rf"(?<![\w.%+-])[\w%+-](?:[\w.%+'-]*[\w%+-])?{_AT}[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)*{_DOT}[^\W\d_]{{2,}}(?![\w-])", re.I)

#: Forms of telephone numbers by the name of their feature.
_PHONES = {
    "plus": r"\+\d{1,3}[ .-]?(?:\(0\)|\(\d{1,4}\))?[ ./-]?\d{1,5}(?:[ ./-]?\d{2,8}){0,4}",
    "zeros": r"00\d{1,3}[ -]\d{1,4}(?:[ -]\d{2,8}){1,4}",
    "brackets": r"\(0?\d{2,4}\)[ ]?\d{3,4}[ -]?\d{3,5}",
    "three": r"\d{3}([ .-])\d{3}\1\d{4}",
    "trunk": r"0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,6}){0,2}",
    "run": r"\d{10,11}",
}
_PHONE = {k: re.compile(rf"(?<![\w+/.(-])(?:{p})(?![\w/]|[.-]\d|[ ]?\d)") for k, p in _PHONES.items()}

_IDS = {
    "nine": r"\d{9}",
    "three-two-four": r"\d{3}([ -])\d{2}\1\d{4}",
    "six-four": r"(?:\d{2})?\d{6}[-+]\d{4}",
    "slashes": r"\d{2,3}/\d{3}/\d{4,5}",
    "letters-digits": r"[A-Z]{1,2}\d{6,8}",
    "letter-groups": r"[A-Z]{1,2}\d{3,5}(?:-\d{2,4}){1,3}",
    "nino": r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]",
    "long": r"\d{10,12}",
    "mixed": r"(?=[A-Z0-9]*\d[A-Z0-9]*\d)(?=[A-Z0-9]*[A-Z])[A-Z0-9]{7,14}",
}
_ID = {k: re.compile(rf"(?<![\w./-])(?:{p})(?![\w/]|[.-]\w)") for k, p in _IDS.items()}
#: What a word before a number says of it: names of personal documents and of lines to call; any other noun makes it a number of something else.
_ID_LABEL = re.compile(
    r"\b(?:ssn|soc(?:ial|\.)?\s*sec(?:urity|\.)?|tin|tax(?:payer)?|steuer\w*|nif|dni|nie|passport|reisepass|pasaporte|travel document|(?:driv\w+(?:'s)?\s+)?licen[cs]e|f(?:ü|ue)hrerschein|insurance|seguro social|national(?:\s+(?:id\w*|insurance))?"
    r"|person(?:al|en)?\s*(?:identity|identification)?\s*(?:number|nummer|code|id)|personnummer|nino|nhs|identity card|personalausweis|ausweis|id card)[\s-]*(?:id|no|nr|num(?:ber)?|nummer|document|code|card)?\b[.:#]*\s*(?:is|was)?\s*$|(?:^|[^\w ]|\b(?:my|his|her|their|the)) ?id\s*(?:no|nr|num(?:ber)?)?\b[.:#]*\s*$",
    re.I,
)
_PHONE_LABEL = re.compile(r"(?:\btel|phone|telephone|mobile|cell|\bcall|\bring|\brang|\bfax|\bline|dial|\btext|whatsapp|handy|telefon|reach\w*|hotline)\s*(?:is|at|me|us|on|under|from|no|number)*\b[.:=]*\s*$", re.I)
_NOUN_LABEL = re.compile(r"[^\W\d_][\w-]*(?:[ ](?:no|nr|num|number|nummer|id|code))?[.:#]*[ ]?$", re.I)
_SEPARATED = re.compile(r"(?:^|[\n\t|;/,])\s*$")
_SEPARATED_AFTER = re.compile(r"\s*(?:$|[\n\t|;/,])")

_STREET_WORD = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|way|avenue|ave\.?|row|square|sq\.?|terrace|close|drive|dr\.?|court|ct\.?|place|pl\.?|boulevard|blvd\.?|crescent|gardens|grove|hill|park|quay|walk|mews|alley|parade|rise|view)"
_WORD = r"[^\W\d_][\w'’-]*"
_UNIT = r"(?:flat|apt\.?|apartment|unit|suite|room|floor|no\.?)[ ]?#?\d{1,4}[a-z]?"
_HOUSE = rf"(?<![\w#./,-])(?:{_UNIT},?[ ])?\d{{1,4}}[a-z]?[ ](?:{_WORD}[ ]){{1,4}}?{_STREET_WORD}(?![\w’'-])(?:,?[ ]{_UNIT})?"
_BOX = r"(?<!\w)p\.?[ ]?o\.?[ ]?box[ ]\d{1,6}"
_GERMAN = rf"(?<!\w)(?:(?:am|an|im|in|auf|zum|zur|bei|unter)[ ](?:(?:der|den|dem)[ ])?(?:{_WORD}[ ]){{1,2}}|(?:{_WORD}[ ]){{0,1}}[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|zeile|gasse|allee|platz|ufer|ring|damm|hof|steig|markt)[ ])\d{{1,4}}[a-z]?"
_POST = r"(?:\d{5}(?:-\d{4})?|[A-Z]{1,2}\d{1,2}[A-Z]?[ ]\d[A-Z]{2})(?!\w)"
_ROMAN = rf"(?<!\w)(?:(?P<first>\d{{1,4}}[a-z]?),?[ ])?(?:calle|c/|avenida|avda\.?|plaza|paseo|rue|avenue|boulevard|place|quai|via|viale|piazza|corso|rua|travessa)[ ](?:{_WORD}[ ]){{0,4}}{_WORD}(?:,?[ ]\d{{1,4}}[a-z]?(?![\w.]))?"
_STREETS = {"house": re.compile(_HOUSE, re.I), "box": re.compile(_BOX, re.I), "german": re.compile(_GERMAN, re.I), "roman": re.compile(_ROMAN, re.I)}
_UNIT_BEFORE = re.compile(rf"(?<![\w#./,-]){_UNIT},?[ ]$", re.I)
_BOX_BEFORE = re.compile(r"(?<!\w)p\.?[ ]?o\.?[ ]?$", re.I)
#: Words that begin the name of a street in Romance languages.
_ROMAN_WORDS = frozenset(("calle", "c", "avenida", "avda", "plaza", "paseo", "rue", "avenue", "boulevard", "place", "quai", "via", "viale", "piazza", "corso", "rua", "travessa"))
_ROMAN_HOUSE = re.compile(r"(?<!\w)\d{1,4}[a-z]?,?[ ]$", re.I)
_TOWN_GAP = r"(?:,[ ]?|,?[ ]?\n|,?[ ](?=\d{5}))"
_FIRST_TOWN = re.compile(rf"{_TOWN_GAP}(?:(?P<pre>\d{{4,5}})[ ])?(?P<town>{_WORD})")
#: A house number that a town can follow, where a street of the German form ends.
_GERMAN_END = re.compile(rf"(?<=[ ])\d{{1,4}}[a-z]?(?={_TOWN_GAP}(?:\d{{4,5}}[ ])?[^\W\d_])", re.I)
_GERMAN_ROAD = re.compile(r"(?:straße|strasse|str\.|weg|zeile|gasse|allee|platz|ufer|ring|damm|hof|steig|markt)[ ]\d{1,4}[a-z]?$", re.I)
_MORE_TOWN = re.compile(rf"[ ]{_WORD}")
_POSTCODE = re.compile(rf"[ ]{_POST}")
_ADDRESS_LABEL = re.compile(r"(?:\b(?:address|addr|adr|anschrift|domicilio|wohnhaft)\b|\b(?:at|to|from|in)\b)\s*[:.]?\s*$", re.I)

_TOKEN = re.compile(r"[^\W\d_](?:\.|[^\W\d_]*(?:['’-][^\W\d_]+)*)")
#: Words before and inside names, and words that are none though they may begin with a capital letter.
_PARTICLES = frozenset(("de", "da", "di", "del", "della", "der", "den", "van", "von", "la", "le", "du", "dos"))
_NO_NAMES = frozenset((
    "the", "a", "an", "in", "on", "at", "of", "to", "by", "for", "from", "with", "and", "or", "but", "our", "my", "your", "his", "her", "their", "its", "we", "i", "you", "he", "she", "they", "it", "this", "that", "these", "those",
    "is", "was", "are", "were", "be", "has", "have", "had", "will", "as", "if", "when", "where", "who", "what", "no", "not", "all", "any", "please", "since", "dear", "best", "mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "sir",
    "der", "die", "das", "und", "mit", "für", "im", "am", "ein", "eine", "el", "los", "las", "y", "con", "para", "por", "un", "una", "call", "mail", "email", "tel", "phone", "mobile", "fax", "regards", "contact", "ask", "send", "box", "unit", "flat", "apt", "apartment", "suite", "room", "floor",
)) - _PARTICLES
_TITLE = re.compile(r"(?:^|[^\w])(?:mr|mrs|ms|miss|dr|prof|sir|herr|frau|señor|señora|sra?|mx)\.?\s*$", re.I)
_NAME_CUE = re.compile(r"\b(?:regards|sincerely|contact|from|name|attn|cc|to|by|with|dear|ask|met|supervisor|manager|referee|references?|author|editor|signed|according to|grüße)\s*[:.,]?\s*$", re.I)
_NAME_AFTER = re.compile(r"\s(?:said|says|wrote|writes|called|joined|led|asked|told|confirmed|signed|reported|works?|worked|agreed|apologised|arrived|paid|resigned|chairs|chaired)\b|,?\s(?:who|whose)\b", re.I)
_GLUE = frozenset("@%+_-")
_LETTERS = re.compile(r"[^\W\d_]+")
_AT_ANY = re.compile(r"@|[ \[(]at[ \])]")

Candidate = tuple[int, int, str, list[str]]


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    return text[max(0, a - 28) : a], text[b : b + 14]


_AT_SIGN = re.compile(r"@|[(\[][ \t]?at[ \t]?[)\]]", re.I)
_AT_WORD = re.compile(r"[ \t]at[ \t](?=[\w-]+[ \t](?:dot|\(dot\)|\[dot\])[ \t])", re.I)
_LOCAL = frozenset("._%+'-")


def _emails(text: str) -> Iterator[Candidate]:
    low = text.lower()
    signs = [m.start() for m in _AT_SIGN.finditer(text)] if "@" in text or "at)" in low or "at]" in low or "at )" in low or "at ]" in low else []
    if " dot" in low or "(dot" in low or "[dot" in low:
        signs += [m.start() for m in _AT_WORD.finditer(text)]
    for at in signs:
        begin = at - 1 if text[at - 1 : at] in (" ", "\t") and at else at
        end = begin
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in _LOCAL):
            begin -= 1
        while begin < end and text[begin] in ".'":
            begin += 1
        if begin < end and (m := _EMAIL.match(text, begin)):
            yield m.start(), m.end(), "email", ["email", "email@" if "@" in m[0] else "email-spelled"]


#: Where a number of any form can begin: five digits follow closely, or seven capitals and digits.
_NUMBER_START = re.compile(r"[+(A-Z0-9](?<![\w][+(A-Z0-9])(?=[A-Z]?[ ]?(?:[^\w]{0,3}\d){4}|[A-Z0-9]{6})")
#: Forms to try by what a number begins with.
_BY_START = {
    "+": (("phone", ("plus",)),), "(": (("phone", ("brackets",)),), "0": (("phone", ("zeros", "three", "trunk", "run")), ("id_number", ("nine", "three-two-four", "six-four", "slashes", "long", "mixed"))),
    "1": (("phone", ("three", "run")), ("id_number", ("nine", "three-two-four", "six-four", "slashes", "long", "mixed"))), "A": (("id_number", ("letters-digits", "letter-groups", "nino", "mixed")),),
}


def _said(before: str, kind: str) -> str:
    """What stands before a number: a label of its kind, of the other kind, a noun of something else, or nothing."""
    mine, other = (_PHONE_LABEL, _ID_LABEL) if kind == "phone" else (_ID_LABEL, _PHONE_LABEL)
    return "label" if mine.search(before) else "wrong" if other.search(before) else "noun" if _NOUN_LABEL.search(before) else "bare"


def _numbers(text: str) -> Iterator[Candidate]:
    for start in _NUMBER_START.finditer(text):
        at = start.start()
        first = text[at]
        for kind, forms in _BY_START["A" if first.isalpha() else "1" if first in "123456789" else first]:
            rules, said = (_PHONE if kind == "phone" else _ID), None
            for name in forms:
                m = rules[name].match(text, at)
                if not m or (kind == "phone" and not 7 <= sum(c.isdigit() for c in m[0]) <= 15):
                    continue
                before, after = _around(text, m.start(), m.end())
                said = said or _said(before, kind)
                f = [kind, f"{kind}:{name}", f"{kind}:{said}"]
                if said in ("bare", "noun"):
                    f.append(f"{kind}:{name}:{said}")
                    if _SEPARATED.search(before) or _SEPARATED_AFTER.match(after):
                        f.append(f"{kind}:{said}:separated")
                yield m.start(), m.end(), kind, f


_DIGITS = re.compile(r"\d+")


def _streets(text: str, special: list[tuple[str, int]]) -> Iterator[tuple[str, int, int]]:
    """Form, start and end of what may be a street with its number. One may begin within another: "5 people at 12 Mill Road".

    special: (r, start) of words like Calle or Rue, (o, start) of Box.
    """
    for run in _DIGITS.finditer(text):
        start = run.start()
        if run.end() - start > 4:
            continue
        ahead = text[start - 1] if start else " "
        if not (ahead.isalnum() or ahead in "_#./,-"):
            if m := _STREETS["house"].match(text, start):
                yield "house", start, m.end()
                if ahead in " #" and (unit := _UNIT_BEFORE.search(text, max(0, start - 24), start)):
                    yield "house", unit.start(), m.end()
        if ahead == " " and (end := _GERMAN_END.match(text, start)):
            at = max(0, end.end() - MAX_SPAN, text.rfind("\n", 0, start))
            while m := _STREETS["german"].search(text, at, end.end()):
                at = m.start() + 1
                if m.end() == end.end():
                    yield "german", m.start(), m.end()
    for kind, start in special:
        if kind == "o":
            box = _BOX_BEFORE.search(text, max(0, start - 7), start)
            if m := box and _STREETS["box"].match(text, box.start()):
                yield "box", m.start(), m.end()
            continue
        house = _ROMAN_HOUSE.search(text, max(0, start - 8), start)
        m = _STREETS["roman"].match(text, house.start() if house else start)
        while m and (m["first"] or m[0][-1:].isdigit() or m[0][-2:-1].isdigit()):
            yield "roman", m.start(), m.end()
            shorter = m[0].rfind(" ")  # a town may follow without a comma
            m = _STREETS["roman"].fullmatch(text, m.start(), m.start() + shorter) if m["first"] and shorter > 0 else None


def _addresses(text: str, towns: frozenset[str], special: list[tuple[str, int]]) -> Iterator[Candidate]:
    seen: set[tuple[int, int]] = set()
    for name, begin, upto in _streets(text, special):
        if first := _FIRST_TOWN.match(text, upto):
            before, _ = _around(text, begin, upto)
            base = ["address", f"address:{name}"]
            base.append("address:label" if _ADDRESS_LABEL.search(before) else "address:bare")
            if name == "german" and text[begin].islower() and not text[begin:upto].islower():
                base.append("address:german-lower-first")  # "at Mühlenweg 3"
            if name == "german" and not first["pre"]:
                base.append("address:german-no-code")
                base.append("address:german-road" if _GERMAN_ROAD.search(text, begin, upto) else "address:german-other")
            end, words = first.end(), [first["town"]]
            while True:
                town = " ".join(words).lower()
                known = "known" if town in towns else f"new{len(words)}"
                ends = [(end, first["pre"] is not None)]
                if not first["pre"] and (p := _POSTCODE.match(text, end)):
                    ends = [(p.end(), True), (end, False)]
                for stop, coded in ends:
                    after = text[stop : stop + 2]
                    edge = "stop" if not after or after[0] in ".,;\n)|" else "upper" if after[1:].isupper() else "digit" if after[1:].isdigit() else "lower"
                    cased = "mixed" if len(words) > 1 and len({w[0].isupper() for w in words}) > 1 else "cased"
                    if (begin, stop) not in seen and stop - begin <= MAX_SPAN:
                        seen.add((begin, stop))
                        yield begin, stop, "address", [*base, f"town:{known}", f"town:{cased}", f"edge:{edge}:{'code' if coded else 'plain'}", "address:code" if coded else "address:plain"]
                more = _MORE_TOWN.match(text, end)
                if not more or len(words) == TOWN_WORDS:
                    break
                words.append(more[0][1:])
                end = more.end()


def lookups(text: str) -> set[str]:
    """All strings of a text that ``candidates`` looks up in a gazetteer."""
    out = {part for t in _TOKEN.findall(text) for part in (t.lower(), *t.lower().split("-"))}
    words = [(m.start(), m.end()) for m in re.finditer(_WORD, text)]
    for i, (a, _) in enumerate(words):
        out.update(text[a:b].lower() for _, b in words[i : i + TOWN_WORDS])
    return out


def _part(token: str, gaz: Gazetteer) -> str:
    """What a token of a name may be: g(iven), f(amily), b(oth), i(nitial), p(article), u(nknown with a capital letter) or x; r and o: words that begin a street, Box."""
    low = token.lower()
    if low in _ROMAN_WORDS:
        return "r"
    if low == "box":
        return "o"
    if len(token) <= 2 and (token[-1] == "." or len(token) == 1):
        return "i" if token[0].isupper() and token[-1] == "." else "x"
    if low in _PARTICLES:
        return "p"
    if low in gaz.given:
        return "b" if low in gaz.family else "g"
    if low in gaz.family or ("-" in low and any(x in gaz.family for x in low.split("-"))):
        return "f"
    return "u" if token[0].isupper() and low not in _NO_NAMES else "x"


#: Tokens whose parts a worker remembers.
_REMEMBERED = 200_000


class _Parts(dict):
    def __init__(self, gaz: Gazetteer):
        super().__init__()
        self.gaz = gaz

    def __missing__(self, token: str) -> str:
        part = _part(token, self.gaz)
        if len(self) < _REMEMBERED:
            self[token] = part
        return part


def _names(text: str, tokens: list[re.Match], code: str, emails: list[Candidate]) -> Iterator[Candidate]:
    mailed = {x for a, b, *_ in emails for x in _LETTERS.findall(_AT_ANY.split(text[a:b].lower())[0]) if len(x) > 2}
    for run in re.finditer(r"[gfbipu]{2,}", code):
        known_run = set(run[0]) & set("gfb")
        for i in range(run.start(), run.end() - 1):
            if code[i] == "i" and not known_run and code[i + 1] != "u":
                continue
            pattern, commas = code[i], 0
            titled = None
            for j in range(i + 1, min(i + NAME_TOKENS, run.end())):
                begin, end = tokens[j - 1].end(), tokens[j].start()
                if end - begin > 2 or text[begin:end] not in (" ", ", "):
                    break
                commas += end - begin == 2
                pattern += ("," if end - begin == 2 else "") + code[j]
                if commas > 1 or code[j] == "p":
                    continue
                a, b = tokens[i].start(), tokens[j].end()
                if titled is None:
                    before = text[max(0, a - 28) : a]
                    titled = "titled" if _TITLE.search(before) else "cued" if _NAME_CUE.search(before) else "separated" if _SEPARATED.search(before) else "plain"
                after = text[b : b + 14]
                follows = bool(_NAME_AFTER.match(after))
                held = [m[0] for m in tokens[i : j + 1]]
                words = [t for t in held if len(t) > 2 and t.lower() not in _PARTICLES]
                if not words:
                    continue
                known = sum(c in "gfb" for c in code[i : j + 1])
                written = sum(t.lower() in mailed for t in words)
                if not known and not written and titled == "plain" and not follows:
                    continue
                if not known and not written and titled == "separated" and len(words) > 3:
                    continue
                caps = "title" if all(w[0].isupper() and not w.isupper() for w in words) else "upper" if all(w.isupper() for w in words) else "lower" if all(w.islower() for w in words) else "mixed"
                shape = pattern.replace("b", "g")
                f = ["name", f"name:{shape}", f"name:{caps}", f"name:known{min(known, 2)}of{min(len(words), 3)}", f"name:{titled}", f"name:{titled}:known{min(known, 2)}"]
                if i > run.start() and code[i - 1] in "gfbui" and text[tokens[i - 1].end() : a] == " ":
                    f.append(f"name:cut-left:{'known' if code[i - 1] in 'gfb' else 'other'}")
                if j + 1 < run.end() and code[j + 1] in "gfbui" and after[:1] == " " and tokens[j + 1].start() == b + 1:
                    f.append(f"name:cut-right:{'known' if code[j + 1] in 'gfb' else 'other'}")
                if written:
                    f.append(f"name:mailed{min(written, 2)}")
                if follows:
                    f += [f"name:after:known{min(known, 2)}", f"name:{titled}:after:known{min(known, 2)}"]
                if before[-1:].isalnum() or before[-1:] in _GLUE or after[:1] in _GLUE:
                    f.append("name:glued")
                yield a, b, "name", f


_PARTS: list[_Parts] = []


def candidates(text: str, gaz: Gazetteer) -> list[Candidate]:
    if not _PARTS or _PARTS[0].gaz is not gaz:
        _PARTS[:] = [_Parts(gaz)]
    tokens = list(_TOKEN.finditer(text))
    code = "".join(map(_PARTS[0].__getitem__, (m[0] for m in tokens)))
    emails = list(_emails(text))
    out = emails + list(_names(text, tokens, code, emails))
    if _DIGITS.search(text):
        special = [(code[i], tokens[i].start()) for i in range(len(code)) if code[i] in "ro"] if "r" in code or "o" in code else []
        out += _numbers(text)
        out += _addresses(text, gaz.towns, special)
    return [c for c in out if c[1] - c[0] <= MAX_SPAN]

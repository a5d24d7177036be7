"""The running text of LaTeX articles: typeset sentences of abstract and sections."""

from __future__ import annotations

import re
import unicodedata

_SKIPPED = re.compile(r"\\iffalse(?![a-zA-Z]).*?(?:\\fi(?![a-zA-Z])|\Z)|\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\begin\{thebibliography\}.*?(?:\\end\{thebibliography\}|\Z)", re.S)
_DEFINED = re.compile(r"\\(?:(?:re)?newcommand\*?|providecommand\*?|DeclareRobustCommand\*?)\s*\{?\\([a-zA-Z@]+)\}?\s*(?:\[(\d)\](?:\[[^\]]*\])?)?\s*\{|\\def\s*\\([a-zA-Z@]+)((?:#\d)*)\s*\{")
_BLOCK = re.compile(r"\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math|figure|table|tabular|array|verbatim|lstlisting|tikzpicture)\*?)\}.*?(?:\\end\{\1\}|\Z)", re.S)
_FORMULA = re.compile(r"\$\$.*?\$\$|\$[^$\n]*\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_HEAD = re.compile(r"\\(?:sub)*(?:section|paragraph|chapter|part)\*?\s*(?:\[[^\]]*\])?\{[^{}]*\}")
_DROPPED = re.compile(r"\\(?:keywords|label|ref|eqref|pageref|cite[a-z]*|input|includegraphics|include|bibliographystyle|bibliography|usepackage|documentclass|title|author|date|thispagestyle|pagestyle|vspace|hspace|url)\*?(?:\s*\[[^\]]*\])*(?:\{[^{}]*\})?")
_ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[^{}]*\}")
_ACCENT = re.compile(r"\\([\"'`^~c=.])\s*\{?(\\?[a-zA-Z])\}?")
_COMMAND = re.compile(r"\\[a-zA-Z@]+\*?|\\[^a-zA-Z]")
#: Combining characters of LaTeX's accents.
_COMBINING = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "c": "\u0327", "=": "\u0304", ".": "\u0307"}
_LETTERS = {"\\ss": "ß", "\\ae": "æ", "\\oe": "œ", "\\o": "ø", "\\aa": "å", "\\l": "ł"}
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_END = re.compile(r"[.!?\n\x00](?:(?<=\x00)|(?<=\n)\s*\n|(?<=[.!?])[.!?]*(?=\s|$))")


def _closing(text: str, at: int) -> int:
    """Index of the brace that closes the one before at, or -1."""
    depth = 1
    for m in re.compile(r"\\.|[{}]", re.S).finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return m.start()
    return -1


def _without_comments(text: str) -> str:
    """text without what stands between an unescaped % and the end of its line."""
    first, *rest = text.split("%")
    out, inside = [first], False
    for part in rest:
        if inside or not out[-1].endswith("\\"):
            end = part.find("\n")
            inside = end < 0
            out.append("" if inside else part[end:])
        else:
            out.append("%" + part)
    return "".join(out)


def _take_macros(text: str) -> tuple[str, dict[str, tuple[int, str]]]:
    """text without its macro definitions, and the macros: number of arguments, body. Of repeated ones the last holds."""
    macros: dict[str, tuple[int, str]] = {}
    out, at = [], 0
    while m := _DEFINED.search(text, at):
        end = _closing(text, m.end())
        if end < 0:  # never closed: leave it
            out.append(text[at : m.end()])
            at = m.end()
            continue
        macros[m[1] or m[3]] = (int(m[2] or 0) if m[1] else len(m[4]) // 2, text[m.end() : end])
        out.append(text[at : m.start()])
        at = end + 1
    return "".join(out) + text[at:], macros


_CALL = re.compile(r"\\([a-zA-Z@]+)(?:\{\})?")
#: A text whose macros would make it this many times longer keeps those not yet expanded.
_MOST_GROWTH = 50


def _endless(macros: dict[str, tuple[int, str]]) -> set[str]:
    """Macros that hold themselves, directly or through others."""
    uses = {name: {c for c in _CALL.findall(body) if c in macros} for name, (_, body) in macros.items()}
    while ends := [name for name, used in uses.items() if not used]:
        for name in ends:
            del uses[name]
        for used in uses.values():
            used.difference_update(ends)
    return set(uses)


def _expand(text: str, macros: dict[str, tuple[int, str]]) -> str:
    """text with its macros expanded until none is left; those without end stand for nothing."""
    if not macros:
        return text
    macros = macros | {name: (macros[name][0], "") for name in _endless(macros)}
    limit, again = _MOST_GROWTH * len(text) + 10_000, True
    while again and len(text) < limit:
        out, at, again = [], 0, False
        for m in _CALL.finditer(text):
            if m.start() < at or m[1] not in macros:
                continue
            n, body = macros[m[1]]
            out.append(text[at : m.start()])
            at = m.end()
            for i in range(n):
                if text[at : at + 1] != "{" or (end := _closing(text, at + 1)) < 0:
                    break
                body = body.replace(f"#{i + 1}", text[at + 1 : end])
                at = end + 1
            again |= "\\" in body
            out.append(body)
        text = "".join(out) + text[at:]
    return text


def _typeset(text: str | None) -> str:
    """The typeset text of abstract and sections in lower case, macros expanded, with a \\x00 after each sentence.

    Comments, skipped blocks, bibliography, headings, formulas, figures and tables are left out,
    as is everything before the document begins. A text without LaTeX is plain text. Null, empty
    and unfinished texts are no error.
    """
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    text = text.replace("\r\n", "\n").replace("\\\\", " ")
    if "%" in text:
        text = _without_comments(text)
    text = _SKIPPED.sub("\n\n", text)
    text, macros = _take_macros(text)
    start = max((m + len(k) for k in ("\\begin{document}", "\\maketitle") if (m := text.find(k)) >= 0), default=0)
    end = text.find("\\end{document}", start)
    text = text[start : end if end >= 0 else len(text)]
    text = _expand(_FORMULA.sub(" ", _BLOCK.sub(" ", text).replace("\\$", " ")), macros)
    text = _DROPPED.sub(" ", _HEAD.sub("\x00", text))
    text = _ENVIRONMENT.sub("\n\n", text)
    if "\\" in text:
        for k, v in _LETTERS.items():
            if k in text:
                text = re.sub(re.escape(k) + r"(?![a-zA-Z])\s?(?:\{\})?", v, text)
        text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2].lstrip("\\") + _COMBINING[m[1]]), text)
        text = _COMMAND.sub("", text)
    return _END.sub("\x00", text.replace("{", "").replace("}", "").replace("~", " ").replace("-\n", "").lower())


def sentences(text: str | None) -> list[str]:
    """The typeset sentences of a text."""
    return [s for s in _typeset(text).split("\x00") if s and not s.isspace()]


_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_ASCII = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalpha() and chr(c) not in "-\x00"})
_KEPT = 200_000


class _Stems(dict):
    """Words as they are kept: a plural s taken off, short ones and what isn't a word empty."""

    def __missing__(self, word: str) -> str:
        kept = word.strip("-") if _WORD.fullmatch(word.strip("-")) else ""
        kept = "" if len(kept) < 3 else kept[:-1] if kept[-1] == "s" and len(kept) > 4 and kept[-2] != "s" else kept
        if len(self) < _KEPT:
            self[word] = kept
        return kept


_STEMS = _Stems()


def words(sentence: str) -> list[str]:
    """Lower-case words of three letters or more, hyphens inside kept, a plural s taken off."""
    parts = sentence.translate(_ASCII).split() if sentence.isascii() else _WORD.findall(sentence)
    return list(filter(None, map(_STEMS.__getitem__, parts)))


def sentence_words(text: str | None) -> list[list[str]]:
    """``words`` of each typeset sentence that has any."""
    text = _typeset(text)
    kept = _STEMS.__getitem__
    if text.isascii():
        parts = map(str.split, text.translate(_ASCII).split("\x00"))
    else:
        parts = (s.translate(_ASCII).split() if s.isascii() else _WORD.findall(s) for s in text.split("\x00"))
    return list(filter(None, (list(filter(None, map(kept, p))) for p in parts)))

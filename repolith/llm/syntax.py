"""Source files that do not parse in their language.

Each language has a lexer that reads literals and comments as units, a pushdown
stack over the delimiters that remain, and rules on what may end a file or stand
next to what. Python files that the lexer accepts are then read by the running
interpreter's own parser, which also overrules the lexer where it accepts a file.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolith.functions.languages import language_of
from repolith.functions.paths import FILE, normal_path, suffix
from repolith.session import spread

_BLOCK, _LINE = r"/\*[\s\S]*?\*/", r"//[^\n]*"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/)*\*/"
_HOLE = r"\$\{(?:[^{}`]|\{(?:[^{}`]|\{[^{}`]*\})*\}|`[^`]*`)*\}"
_TEMPLATE = rf"`(?:[^`\\$]|\\[\s\S]|\$(?!\{{)|{_HOLE})*`"
_REGEX_BODY = r"(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
_JS_REGEX = r"/(?![*/])(?:(?<=[=(,:\[!&|?{};+\-*%~^<>\n]/)|(?<=[=(,:\[!&|?{};+\-*%~^<>] /)|(?<=return /)|(?<=typeof /)|(?<=case /)|(?<=\n  /)|(?<=\n    /))" + _REGEX_BODY + r"|/(?<=\)\s/)" + _REGEX_BODY + r"(?=\.(?:test|exec|source|flags|lastIndex)\b)"
_CS_STRING = r'"""+[\s\S]*?"""+|(?:\$+@|@\$+|@)"(?:[^"]|"")*"|\$"(?:[^"\\\n{}]|\\[^\n]|\{\{|\}\}|\{(?:[^{}"\n]|"[^"\n]*")*\})*"|' + _DOUBLE

#: Directives whose rest of line is free text.
_WORDS = r"#[ \t]*(?:region|endregion|error|warning|pragma)\b[^\n]*"
#: By lexer: comments, literals, and the marks that only an unterminated unit leaves behind. Each alternative
#: begins with a fixed character, so that text between units is skipped; prefixes of literals stay in the code.
_UNITS = {
    "c": (rf"{_BLOCK}|//(?:[^\n\\]|\\[\s\S])*|{_WORDS}", r'"(?<=R")(?P<d>[^()\\\s]{0,16})\([\s\S]*?\)(?P=d)"|' + _DOUBLE + "|'(?<![0-9A-Fa-f]')" + _SINGLE[1:], r"/\*|\"|'(?<![0-9A-Fa-f]')"),
    "java": (f"{_BLOCK}|{_LINE}", r'"""[\s\S]*?(?<!\\)"""|' + f"{_DOUBLE}|{_SINGLE}", r"/\*|\"|'"),
    "csharp": (f"{_BLOCK}|{_LINE}|{_WORDS}", f"{_CS_STRING}|{_SINGLE}", r"/\*|\"|'"),
    "go": (f"{_BLOCK}|{_LINE}", f"`[^`]*`|{_DOUBLE}|{_SINGLE}", r"/\*|\"|'|`"),
    "rust": (f"{_NESTED}|{_LINE}", r'#(?<=r#)(?P<h>#*)"[\s\S]*?"#(?P=h)|"(?<=r")[^"]*"|"(?:[^"\\]|\\[\s\S])*"' + r"|'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f_]+\}|x[0-9A-Fa-f]{2}|[^\n]))'|'[A-Za-z_]\w*(?!')", r"/\*|\"|'"),
    "javascript": (f"{_BLOCK}|{_LINE}|#!(?<=\\A#!)[^\\n]*", f"{_TEMPLATE}|{_DOUBLE}|{_SINGLE}|{_JS_REGEX}", r"/\*|\"|'|`"),
    "python": (r"#[^\n]*", r'"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?'''" + rf"|{_DOUBLE}|{_SINGLE}", r"\"|'"),
}
_UNITS["typescript"] = _UNITS["javascript"]
_UNITS["cpp"] = _UNITS["c"]
_LEXERS = {k: re.compile(f"(?P<comment>{c})|(?P<literal>{s})|(?P<open>{o})") for k, (c, s, o) in _UNITS.items()}
#: What stands for a literal and for an opening that nothing closes, in text free of literals and comments.
_LITERAL, _OPEN = "\x01", "\x00"

_CONFLICT = re.compile(r"\n(?:<{7}|>{7}|\|{7}|={7})(?![<>|=])")
_PACKAGE = re.compile(r"\s*package\s+\w")
_NOT_DELIMITERS = re.compile(r"[^()\[\]{}]+")
_CLOSERS = {")": "(", "]": "[", "}": "{"}

#: Declarations at the start of a line, by the language that they show.
_SHOWN = {
    "html": r"^\s*<(?:!DOCTYPE|/?(?:html|head|body|p|h[1-6]|div|ul|li|table|title)\b)|\A\s*#+ [A-Z][^\n]*\n\s*\n\s*[A-Z]|\A\s*\{\s*\x01\s*:",
    "markup": r"^\s*<(?:!DOCTYPE|html\b)|\A\s*#+ [A-Z][^\n]*\n\s*\n\s*[A-Z]|\A\s*\{\s*\x01\s*:",
    "python": r"^[ \t]*(?:(?:def|class)\s+\w+[^\n;{]*:|(?:if|for|while|elif|with)\b[^\n;{}?]*[^\n;{}?:]:|(?:else|try|finally|except\b[^\n;{]*):)[ \t]*$|^from\s+[\w.]+\s+import\b|^[ \t]*import\s+\w+(?:\.\w+)*(?:\s+as\s+\w+)?[ \t]*$",
    "go": r"^package\s+\w+[ \t]*$|^func\s*(?:\([^)\n]*\)\s*)?\w+\s*\(|^import\s+(?:\w+\s+)?(?:\x01|\()\s*$|^type\s+\w+\s+(?:struct|interface)\s*\{|^[ \t]*\w+(?:,\s*\w+)*\s*:=",
    "rust": r"^[ \t]*(?:pub(?:\([^)\n]*\))?\s+)?(?:fn\s+\w+\s*[(<]|(?:struct|enum|trait|mod)\s+\w+[^;=\n]*\{[ \t]*$|impl\b[^;\n]*\{)|^[ \t]*let\s+mut\b|^(?:pub\s+)?use\s+\w+(?:::[\w{}*, ]+)+;",
    "java": r"^package\s+[\w.]+\s*;|^import\s+(?:static\s+)?\w+(?:\.[\w*]+)+\s*;|^[ \t]*(?:public|private|protected)\s+(?:(?:static|final|abstract)\s+)*(?:class|interface|enum|[\w<>\[\]]+\s+\w+\s*[(=;])",
    "csharp": r"^[ \t]*using\s+\w+(?:\.\w+)+\s*;|^[ \t]*(?:public|private|protected|internal)\s+(?:(?:static|readonly|sealed|abstract|partial|override|async)\s+)*(?:class|interface|enum|struct|[\w<>\[\]]+\s+\w+\s*[(=;])|^namespace\s+\w+(?:\.\w+)+\s*[{;]",
    "javascript": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*\w*\s*\(|^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?:\w+|\{[^}\n]*\}|\[[^\]\n]*\])\s*=(?!=)|^import\s+[^;\n(]*\bfrom\s+\x01",
    "typescript": r"^[ \t]*(?:export\s+)?(?:async\s+)?function\s+\w+\s*(?:<[^>\n]*>)?\([^)\n]*\w\s*\??:\s*\w|^[ \t]*(?:export\s+)?(?:const|let|var)\s+\w+\s*:\s*\w|^[ \t]*(?:export\s+)?(?:interface|enum|namespace|declare)\s+\w+|^[ \t]*(?:export\s+)?type\s+\w+(?:<[^>\n]*>)?\s*=|^[ \t]*(?:public|private|protected|readonly)\s+\w+|^[ \t]+(?!(?:return|case|if|for|while|switch|catch|with|function)\b)\w+\([^)\n]*\w\s*\??:\s*\w[^)\n]*\)\s*(?::\s*[\w<>\[\]]+\s*)?\{",
    "cpp": r"^[ \t]*#\s*(?:include|define|ifdef|ifndef|endif|pragma)\b|^[ \t]*(?:static\s+|inline\s+|const\s+|unsigned\s+)*(?:int|void|char|bool|double|float|size_t|auto|std::\w+)\s+[*&]?\w+\s*\([^;\n]*\)\s*(?:const\s*)?\{|^[ \t]*using\s+namespace\s|^[ \t]*template\s*<|^[ \t]*(?:public|private|protected)\s*:[ \t]*$",
    "cpp_only": r"^[ \t]*(?:class\s+\w+[^;\n]*\{|namespace\b[^;\n]*\{|template\s*<|using\s+\w+|(?:public|private|protected)\s*:)|:(?<=\w:):\w",
    "function": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b\s*\*?\s*\w*\s*\(|^import\s+[^;\n(]*\bfrom\s+\x01|^[ \t]*export\s+\w",
    "constant": r"^[ \t]*(?:const|let)\s+\w+\s*=(?!=)",
    "include": r"^[ \t]*#\s*(?:include|define|ifdef|ifndef|endif|pragma)\b|^[ \t]*using\s+namespace\s|^[ \t]*template\s*<",
    "prototype": r"^(?:static\s+|inline\s+)*(?:int|void|char|bool|double|float)\s+[*&]?\w+\s*\([^;\n]*\)\s*\{",
}
#: Of each lexer, the languages whose declarations can't stand in it.
_FOREIGN = {
    "c": ("html", "python", "go", "rust", "java", "csharp", "javascript", "typescript", "cpp_only"), "cpp": ("html", "python", "go", "rust", "java", "csharp", "javascript"),
    "java": ("html", "python", "go", "rust", "include", "prototype", "function", "constant"), "csharp": ("html", "python", "go", "rust", "prototype", "function", "constant"),
    "go": ("html", "python", "rust", "java", "csharp", "cpp", "function"), "rust": ("html", "python", "go", "java", "csharp", "cpp", "function"),
    "javascript": ("html", "python", "go", "rust", "java", "csharp", "cpp", "typescript"), "typescript": ("markup", "python", "go", "rust", "java", "csharp", "cpp"),
    "python": ("html", "go", "rust", "java", "csharp", "javascript"),
}
_EXTRA = {"csharp": r"^package\s+[\w.]+\s*;|^import\s+[\w.]+\s*;|^[ \t]*#\s*(?:include|define\s+\w+\s+\S)|^[ \t]*static\s+inline\b",
          "java": r"^[ \t]*using\s+[\w.]+\s*;|^[ \t]*namespace\s+[\w.]+\s*[{;]|^[ \t]*internal\s+\w", "go": r"^[ \t]*(?:class|namespace)\s+\w|^[ \t]*(?:while|using)\b",
          "rust": r"^[ \t]*(?:class|namespace|func|def)\s+\w|^[ \t]*(?:int|void|var)\s+\w"}


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth, begin, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = pattern.index("]", i + 2)
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[begin:i])
            begin = i + 1
        i += 1
    return [*out, pattern[begin:]]


def _line_starts(patterns: list[str]) -> tuple[re.Pattern, re.Pattern]:
    """One search for all of them, and one match for those that only begin a text: a line start is the line end before it, which is quick to find, and blanks that may follow are read once."""
    every = [x for p in patterns for x in _alternatives(p)]
    indented, first, other, begin = [], [], [], []
    for x in every:
        if x.startswith("^[ \\t]*"):
            indented.append(x[len("^[ \\t]*"):])
        elif x.startswith("^") and not x.startswith("^\\s"):
            first.append(x[1:])
        elif x.startswith("\\A"):
            begin.append(x)
        else:
            other.append(re.sub(r"(?<!\[)\^", r"\\n", x))
    lines = [f"\\n(?:{'|'.join([*first, *([f'[ \\t]*(?:' + '|'.join(indented) + ')'] if indented else [])])})"]
    return re.compile("|".join(lines + other), re.M), re.compile("|".join(begin) or r"(?!)")


_FOREIGN_RE = {k: _line_starts([*(_SHOWN[x] for x in v), *([_EXTRA[k]] if k in _EXTRA else [])]) for k, v in _FOREIGN.items()}

#: What no file ends with, and neighbours that no grammar of the language allows.
_SEMICOLON = ("c", "cpp", "java", "csharp", "rust")
_DANGLING = re.compile(r"(?:[=,(\[{.&|?:<]|(?<!\+)\+|(?<!-)-|[*/%^])\s*\Z")
_PAIRS = {k: re.compile(p, re.M) for k, p in {
    "c": r"(?:[=*/%&|^<>!?,\[]|\+(?<!\+\+)|-(?<!--))\s*;|,\s*\)|(?:[=/%|^<>?]|\+(?<!\+\+))\s*[)\]]|\(\s*[,*/%|=]|if(?<=[\s{};)]if)(?!\w)\s*(?!\s)[^\s(]|while(?<=[\s{};)]while)(?!\w)\s*(?!\s)[^\s(]|switch(?<=[\s{};)]switch)(?!\w)\s*(?!\s)[^\s(]|;\s*,|=\s*[})]",
    "java": r"(?:[=*/%&|^!?,\[]|\+(?<!\+\+))\s*;|,\s*\)|(?:[=*/%|^]|\+(?<!\+\+))\s*\)|\(\s*[,*/%|=]|if(?<=[\s{};)]if)(?!\w)\s*(?!\s)[^\s(]|while(?<=[\s{};)]while)(?!\w)\s*(?!\s)[^\s(]|switch(?<=[\s{};)]switch)(?!\w)\s*(?!\s)[^\s(]|;\s*,",
    "csharp": r"(?:[=*/%&|^,\[]|\+(?<!\+\+))\s*;|,\s*\)|(?:[=/%|^]|\+(?<!\+\+))\s*\)|\(\s*[,*/%|=](?!>)|if(?<=[\s{};)]if)(?!\w)\s*(?!\s)[^\s(,;)}.]|while(?<=[\s{};)]while)(?!\w)\s*(?!\s)[^\s(,;)}.]|switch(?<=[\s{};)]switch)(?!\w)\s*(?!\s)[^\s(,;)}.]|;\s*,",
    "go": r"(?:[=*/%&|^!,]|\+(?<!\+\+))\s*;|[=+*/%|^]\s*\)|\(\s*[,/%|=]|\)\s*else\b",
    "rust": r"[=+/%^,]\s*;|[=+/%^]\s*\)|\(\s*[,/%=]|;\s*,",
    "javascript": r"(?:[=*/%&|^?,]|\+(?<!\+\+))\s*;|(?:[=*/%|^]|\+(?<!\+\+))\s*\)|\(\s*[*/%|=](?!\*)|if(?<=[\s{};)]if)(?!\w)\s*(?!\s)[^\s(:.,;)}=]|while(?<=[\s{};)]while)(?!\w)\s*(?!\s)[^\s(:.,;)}=]|switch(?<=[\s{};)]switch)(?!\w)\s*(?!\s)[^\s(:.,;)}=]|;\s*,",
}.items()}
_PAIRS["typescript"], _PAIRS["cpp"] = _PAIRS["javascript"], re.compile(r"(?:[=*/%|^<!?,\[]|\+(?<!\+\+)(?<!operator\+)|-(?<!--))\s*;|\(\s*[,/%|]|while(?<=[\s{};)]while)(?!\w)\s*(?!\s)[^\s(]|switch(?<=[\s{};)]switch)(?!\w)\s*(?!\s)[^\s(]|if(?<=[\s{};)]if)(?!\w)\s*(?!\s)(?!constexpr\b|consteval\b|!)[^\s(]|;\s*,", re.M)
#: A statement that begins on the next line although the one before has not ended.
_UNENDED = re.compile(r"[\w)\]\x01][ \t]*\n\s*(?:return|if|for|while|int|let|var|static|public|private|internal|pub|fn|use|using|import|package|class|break|continue)\b(?!\s*!?=)")
#: The same before a call, where the line before assigns or is itself a call.
_UNENDED_CALL = re.compile(r"[\w)\]\x01][ \t]*\n\s*(?!(?:where|throws|when|and|or|xor|not|noexcept|requires|__attribute__)\b)[A-Za-z_]\w*(?:(?:\.|::)\w+)*\(")
_ASSIGNS = re.compile(r"[^=!<>]=(?![=>])[^;{]*\Z|^\s*(?:return|throw)\b")
_HEADER_END = re.compile(r"(?:\b(?:if|for|while|switch|else|do|match|loop|catch|foreach|unsafe|try|finally)\b[^\n]*|^[ \t]*(?:#|@|\[)[^\n]*|->[^\n]*|\bwhere\b[^\n]*|\b(?:class|struct|enum|namespace|interface)\b[^\n]*)\Z", re.M)
#: A line that is a call; where there are no macros, a statement needs its end behind it.
_CALL = re.compile(r"\s*(?!(?:if|for|while|switch|else|catch|synchronized|try|do|using|lock|fixed|foreach|when|where|case|default|return)\b)[A-Za-z_][\w.]*\(")


def _without_branches(text: str) -> list[str]:
    """C-like text whose preprocessor lines are gone, once with the first and once with the last branch of each #if; `#if 0` is read by neither."""
    lines, place, more = text.split("\n"), [], False
    first, last, open_ = [], [], []  # open_: of each #if that is open, the branch, and its lines in the order of branches
    for n, line in enumerate(lines):
        directive = re.match(r"\s*#\s*(\w*)\s*(\w*)", line)
        if more or directive:
            word, more = "" if more else directive.group(1), line.rstrip("\r").endswith("\\")
            if word in ("if", "ifdef", "ifndef"):
                open_.append([0, len(place), word == "if" and directive.group(2) == "0"])
            elif word in ("else", "elif") and open_:
                open_[-1][0] += 1
            elif word == "endif" and open_:
                branch, begin, never = open_.pop()
                for k in range(begin, len(place)):
                    m, own = place[k]
                    at = own.pop()
                    first[m] &= at == (1 if never else 0)
                    last[m] &= at == branch and not (never and at == 0)
            first.append(False)
            last.append(False)
            place.append((n, [x[0] for x in open_]))
        else:
            first.append(True)
            last.append(True)
            place.append((n, [x[0] for x in open_]))
    for _, own in place:  # an #if without end is read whole
        own.clear()
    variants = ["\n".join(x if keep else "" for x, keep in zip(lines, kept, strict=True)) for kept in (first, last)]
    return variants[:1] if first == last else variants


_MARKUP = re.compile(r"[(,=?:&|\[>]\s*<[A-Za-z_>]|\b(?:return|default|yield)\s*<[A-Za-z_>]")
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*)?\s*")
_ATTRIBUTE = re.compile(r"[A-Za-z_][\w:.-]*\s*(=\s*)?")
_JSX_TEXT = re.compile(r"[^<>{}]*")
_BLANKS = re.compile(r"\s*")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
#: What an expression may follow, so that `<` begins an element there.
_EXPRESSION = re.compile(r"(?:[(,=?:&|\[>]|\b(?:return|default|yield))\s*\Z")
_IN_HOLE = {k: re.compile(f"(?P<skip>{_UNITS[k][0]}|{_UNITS[k][1]})|(?P<brace>[{{}}])|(?P<tag><(?=[A-Za-z_>]))") for k in ("javascript", "typescript")}


def _element(text: str, at: int, lexer: str) -> tuple[int, list[str]] | None:
    """The end of the markup element that begins at `at` and the code in its braces; None if none is complete. A stack holds the names of open elements."""
    names, holes, i = [], [], at
    while True:
        tag = _TAG.match(text, i)
        i = tag.end()
        while True:  # attributes
            if text.startswith("/>", i):
                i += 2
                break
            if text.startswith(">", i):
                i += 1
                names.append(tag[1] or "")
                break
            if text.startswith("{", i):
                hole = _hole(text, i, lexer)
                if not hole:
                    return None
                i = hole[0]
                holes.append(hole[1])
            elif m := _ATTRIBUTE.match(text, i):
                i = m.end()
                if m[1] and (q := _QUOTED.match(text, i)):
                    i = q.end()
                elif m[1] and not text.startswith("{", i):
                    return None
            else:
                return None
            i = _BLANKS.match(text, i).end()
        while names:  # children, up to the next element
            i = _JSX_TEXT.match(text, i).end()
            if text.startswith("{", i):
                hole = _hole(text, i, lexer)
                if not hole:
                    return None
                i = hole[0]
                holes.append(hole[1])
            elif m := re.compile(r"</\s*([A-Za-z_][\w.:-]*)?\s*>").match(text, i):
                if names.pop() != (m[1] or ""):
                    return None
                i = m.end()
            elif text.startswith("<", i) and not text.startswith("</", i):
                break
            else:
                return None
        if not names:
            return i, holes


def _hole(text: str, at: int, lexer: str) -> tuple[int, str] | None:
    """The place behind the brace that closes the one at `at`, and the code between, elements in it replaced."""
    depth, begin, out, i = 0, at + 1, [], at
    while m := _IN_HOLE[lexer].search(text, i):
        i = m.end()
        if m["brace"] is not None:
            depth += 1 if m["brace"] == "{" else -1
            if not depth:
                return i, "".join([*out, text[begin : m.start()]])
        elif m["tag"] is not None and (m.start() == at + 1 or _EXPRESSION.search(text[max(at + 1, m.start() - 40) : m.start()]) or not text[at + 1 : m.start()].strip()):
            found = _element(text, m.start(), lexer)
            if found:
                out += [text[begin : m.start()], _as_code(found[1])]
                begin = i = found[0]
    return None


def _as_code(holes: list[str]) -> str:
    return "([" + ",".join(h for h in holes if h.strip()) + "])"


def _without_markup(text: str, lexer: str) -> str:
    """JavaScript or TypeScript whose complete markup elements are replaced by a list of the code in their braces.

    In JavaScript nothing but an element can begin so; one that isn't complete leaves
    the mark of an opening that nothing closes. In TypeScript it may be a type.
    """
    out, begin, i = [], 0, 0
    while m := _IN_HOLE[lexer].search(text, i):
        i = m.end()
        if m["tag"] is not None and _EXPRESSION.search(text[max(0, m.start() - 40) : m.start()]):
            found = _element(text, m.start(), lexer)
            if found:
                out += [text[begin : m.start()], _as_code(found[1])]
                begin = i = found[0]
            elif lexer == "javascript":
                out += [text[begin : m.start()], _OPEN]
                begin = m.start()
    return "".join([*out, text[begin:]])


def _stack(code: str) -> str | None:
    open_: list[str] = []
    for c in _NOT_DELIMITERS.sub("", code):
        if c in "([{":
            open_.append(c)
        elif not open_ or open_.pop() != _CLOSERS[c]:
            return "unbalanced_delimiter"
    return "premature_end" if open_ else None


def _mask(m: re.Match) -> str:
    return " " if m["comment"] is not None else _LITERAL if m["literal"] is not None else _OPEN


def _unended(code: str, lexer: str) -> bool:
    for pattern in (_UNENDED, _UNENDED_CALL):
        for m in pattern.finditer(code):
            line = code[code.rfind("\n", 0, m.start() + 1) + 1 : m.start() + 1]
            assigns, calls = bool(_ASSIGNS.search(line)), bool(_CALL.match(line))
            if _HEADER_END.search(line) or pattern is _UNENDED_CALL and not assigns and not calls:
                continue
            # a line that ends in a parenthesis may declare a function, or be a macro where there are any
            if not line.endswith(")") or line.count("(") == line.count(")") and (assigns or calls and lexer in ("java", "csharp")):
                return True
    return False


def lex_error(text: str, lexer: str) -> str | None:
    """What the lexer and its stack find wrong with a whole text, None if nothing."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
    if lexer in ("javascript", "typescript") and _MARKUP.search(text):
        text = _without_markup(text, lexer)
    code = "\n" + _LEXERS[lexer].sub(_mask, text)
    if _CONFLICT.search(code):
        return "merge_conflict"
    anywhere, beginning = _FOREIGN_RE[lexer]
    if beginning.match(code) or anywhere.search(code):
        return "foreign_language"
    if _OPEN in code:
        return "unterminated_literal"
    if lexer == "go" and not _PACKAGE.match(code):
        return "foreign_language" if code.strip() else "premature_end"
    for variant in _without_branches(code) if lexer in ("c", "cpp", "csharp") and "#" in code else [code]:
        if error := _token_error(variant, lexer):
            return error
    return None


def _token_error(code: str, lexer: str) -> str | None:
    """What is wrong with the delimiters, ends and neighbours of a text without literals, comments and directives."""
    if error := _stack(code):
        return error
    if lexer == "python":
        return None
    end = code.rstrip()
    if _DANGLING.search(end) or lexer in _SEMICOLON and end and end[-1] not in ";})" + _LITERAL:
        return "premature_end"
    if _PAIRS[lexer].search(code):
        return "misplaced_token"
    if lexer in _SEMICOLON and _unended(code, lexer):
        return "unended_statement"
    return None


def syntax_error(text: str, lexer: str) -> str | None:
    """Why a whole text does not parse, None if it does."""
    error = lex_error(text, lexer)
    if lexer != "python":
        return error
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError) as e:
        return error or ("indentation" if isinstance(e, IndentationError) else "invalid_syntax")
    except (RecursionError, MemoryError):
        return error
    return None


def lexer_of(path: Column) -> Column:
    """The lexer of a path by its suffix: the language, but `.c` is C; null for other suffixes and for null."""
    language = language_of(path)
    return F.when(suffix(path) == ".c", "c").when(language != "unknown", language)


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["error"] = [syntax_error(t, k) for t, k in zip(b["text"], b["lexer"], strict=True)]
        yield b[["csc_id", "path", "lexer", "error"]]


def checked_files(files: DataFrame) -> DataFrame:
    """(csc_id, path, lexer, error) of the distinct files with text and a suffix of the eight languages.

    error is null for files that parse, else merge_conflict, foreign_language,
    unterminated_literal, unbalanced_delimiter, premature_end, misplaced_token,
    unended_statement, indentation or invalid_syntax. Null texts are no files to
    check; an empty text parses in every language but Go, which wants a package. A path that is scanned with
    several texts gives a row for each. Each text is read whole, where its input
    split is read; texts travel only where there are fewer splits than cores.
    """
    texts = files.select("csc_id", "path", "text", lexer_of(F.col("path")).alias("lexer")).filter("text IS NOT NULL AND lexer IS NOT NULL")
    return spread(texts, "csc_id", "path").mapInPandas(_check, "csc_id string, path string, lexer string, error string").distinct()


def syntax_report(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per csc_id and language: files, files that do not parse, and their rate.

    language is the one that the file's node states (lower case, blanks trimmed),
    else the one of the suffix. Counts are per path: a path with several texts is
    unparsed if one of them is.
    """
    per_path = checked_files(files).groupBy("csc_id", "path").agg(F.max(F.col("error").isNotNull()).alias("bad"))
    stated = nodes.filter(F.col("node_id").startswith(FILE)).groupBy(F.col("csc_id").alias("n_csc"), normal_path(F.col("path")).alias("n_path")).agg(
        F.max(F.lower(F.trim("language"))).alias("stated"))
    joined = per_path.join(stated, (F.col("csc_id") == F.col("n_csc")) & (normal_path(F.col("path")) == F.col("n_path")), "left")
    return joined.groupBy("csc_id", F.coalesce("stated", language_of(F.col("path"))).alias("language")).agg(
        F.count("*").alias("files"), F.count_if("bad").alias("unparsed"), F.round(F.avg(F.col("bad").cast("double")), 6).alias("rate"))

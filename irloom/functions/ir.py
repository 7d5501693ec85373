"""The text rules of IR over Python strings, one pass over each text: normaliser, blocks, definitions, uses and successors.

Patterns mean what they mean in Spark's SQL functions: classes are those of ASCII, and a text with
other characters or with carriage returns is read by wide patterns, whose borders of words and ends
of lines are Java's.
"""

from __future__ import annotations

import re

# The integers that the rules leave as they are.
KEPT_INTS = ("24", "32", "48", "64", "128", "256")  # besides those up to 16
KEPT_INTS_ADVANCED = (*KEPT_INTS, "73", "105")
#: Marks the name that a define or declare line is about, as it is renamed whatever its prefix is.
MARK = "\x01"
#: Stands for a line break inside an instruction.
BREAK = "\x01"
#: Names of values, labels and globals behind their sigil.
NAME = r'(?:[-a-zA-Z$._0-9]+|"[^"]*")'
LABEL = rf"[ \t]*({NAME}):"
TERMINATOR = rf"^(?:%{NAME}\s*=\s*)?(?:br|switch|indirectbr|invoke|callbr|catchswitch|catchret|cleanupret)\b"
VARIABLE = r"%(?!\d+(?![\w.]))[.\w]+"
GLOBAL = r'@"[^"]*"|@\x01?\w[\w.]*'

# How a wide pattern writes what Java takes from Unicode; ~B, ~S, ~E and ~Z stand for the border of a word, the start and end of a line, and the end of a text.
PLAIN = {"~B": r"\b", "~S": r"(?m:^)", "~E": r"(?m:$)", "~Z": r"$", "~D": "."}
LETTER = r"[^\W²³¹¼-¾]"
WIDE = {
    "~B": rf"(?:(?<={LETTER})(?!{LETTER})|(?<!{LETTER})(?={LETTER}))",
    "~S": r"(?:(?<![\s\S])|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))(?!\Z)",
    "~E": r"(?:\Z|(?=[\r\x85\u2028\u2029])|(?<!\r)(?=\n))",
    "~Z": r"(?:\Z|(?=\r\n\Z|[\r\x85\u2028\u2029]\Z)|(?<!\r)(?=\n\Z))",
    "~D": r"[^\n\r\x85\u2028\u2029]",
}
CLASSES = {r"\w": "A-Za-z0-9_", r"\d": "0-9", r"\s": r" \t\n\x0b\f\r"}


def two(pattern: str) -> tuple[re.Pattern, re.Pattern]:
    """A pattern for plain texts, and one for others."""
    plain = wide = pattern.replace(r"\b", "~B")
    for mark, means in PLAIN.items():
        plain = plain.replace(mark, means)
    inside, out = False, ""
    for part in re.findall(r"\\.|~.|[\[\]]|.", wide, re.S):  # classes are written out
        inside = part == "[" or (inside and part != "]")
        means = CLASSES.get(part)
        out += (means if inside else f"[{means}]") if means else WIDE.get(part, part)
    return re.compile(plain, re.ASCII), re.compile(out)


ODD = re.compile(r"[^\x00-\x7f]|\r")


def is_odd(text: str) -> bool:
    return ODD.search(text) is not None


# --- normaliser ---------------------------------------------------------------------------------------

HEADER = two(r"~S(?:source_filename|target datalayout|target triple) =~D*~E")
METADATA = two(r"^!\d+\s*=\s*!?\{~D*\}~Z")
DEFINED = {mode: two(rf"~S([ \t]*(?:{names})\s[^@\n]*\s)@(\w+)(?=\s*\()") for mode, names in (("regex", "define|declare"), ("advanced", "define"))}
HEADS = {"regex": re.compile("define|declare"), "advanced": re.compile("define")}
#: What is left as it is or renamed, and the text between, line by line; the first alternative is a line that only holds a label.
SEGMENT = two(rf"~S[^:%@!\n]+:[ \t]*~E|{VARIABLE}|{GLOBAL}|%\"[^\"]*\"|!\d+|[^%@!\n]+|[%@!\n]")
#: The same with string literals on their own, and comments and declarations left as they are.
SEGMENT_ADVANCED = two(rf"~S[ \t]*(?:;|declare)[^\n]*~E|~S[^:%@!\n]+:[ \t]*~E|{VARIABLE}|{GLOBAL}|%\"[^\"]*\"|!\d+|\"[^\"@%\n]*\"(?!\s*:)|[^%@!\"\n]+|[%@!\"\n]")
IS_VARIABLE, IS_GLOBAL = two(rf"^{VARIABLE}~Z"), two(rf"^(?:{GLOBAL})~Z")
IS_LABEL, UNTOUCHED, STRING = two(r":[ \t]*~Z"), two(r"^[ \t]*(?:;|declare)|:[ \t]*~Z"), two(r'^"[^"@%\n]*"~Z')
SKIPPED = {"regex": two(r"^@(?:func|var|bb|\d|llvm\.|\.|~Z)"), "advanced": two(r"^@(?:func|bb|\d|llvm\.|\.|~Z)")}
DIGIT = re.compile("[0-9]")
FLOAT = two(r"(?<!%\.)~B\d+\.\d+(?:e[+-]?\d+)?~B")
HEX = two(r"~B0x[0-9a-fA-F]+~B")


def integer(digits: str) -> tuple[re.Pattern, re.Pattern]:
    return two(rf"(?<!i)(?<!\[)(?<!%\.)~B{digits}~B(?![*.]|\s*x\s)")


def masks(kept: tuple[str, ...]) -> list[tuple[tuple[re.Pattern, re.Pattern], str]]:
    other = r"0*(?!0*(?:{})~B)".format("|".join(kept))
    return [(integer(other + r"(?:1[7-9]|[2-9]\d)"), "<MED_INT>"), (integer(other + r"[1-9]\d\d"), "<LARGE_INT>"), (integer(r"0*[1-9]\d{3,}"), "<HUGE_INT>")]


MASKS = {"regex": masks(KEPT_INTS), "advanced": masks(KEPT_INTS_ADVANCED)}


def mask_constants(part: str, float_first: bool, mode: str, odd: bool) -> str:
    """Hexadecimal numbers, then integers by size, then fractions (by default in this order)."""
    if not DIGIT.search(part):
        return part
    floats = [(FLOAT, "<FLOAT_CONST>")]
    for pattern, name in [(HEX, "<HEX_CONST>"), *(floats + MASKS[mode] if float_first else MASKS[mode] + floats)]:
        part = pattern[odd].sub(name, part)
    return part


def without_metadata_tail(text: str, odd: bool) -> str:
    """Drops metadata definitions behind the last line of content."""
    if "!" not in text:
        return text
    lines = text.split("\n")
    bare = [x.strip(" ") for x in lines]
    defines = [x[:1] == "!" and METADATA[odd].search(x) is not None for x in bare]
    last = max((i for i, x in enumerate(bare) if x and x[0] != ";" and not defines[i]), default=None)
    return text if last is None else "\n".join([x for i, x in enumerate(lines) if i <= last or not defines[i]])


def without_comments(text: str) -> str:
    """Drops comment lines, cuts lines at their first semicolon and trims them."""
    lines = [x.strip(" ") for x in text.split("\n")]
    return "\n".join([x.partition(";")[0].strip(" ") if ";" in x else x for x in lines if x[:1] != ";"])


class Normalizer:
    """The whole normaliser, for many texts: what becomes of a part of a text is remembered."""

    #: Parts of up to so many characters that are remembered, and how many.
    SHORT, REMEMBERED = 200, 200_000

    def __init__(self, float_first: bool = False, mode: str = "regex"):
        if mode not in ("regex", "advanced"):
            raise ValueError("mode is regex or advanced")
        self.float_first, self.mode = float_first, mode
        self.known: dict[str, str | tuple[int, str]] = {}

    def part(self, x: str, odd: bool) -> str | tuple[int, str]:
        """0 and a variable, 1 and a global by its bare name, or what takes the part's place."""
        advanced = self.mode == "advanced"
        if x[0] == "%":
            return (0, x) if IS_VARIABLE[odd].search(x) and not x.startswith("%.") else x
        if x[0] == "@":
            bare = x.replace('"', "").replace(MARK, "")
            return (1, bare) if IS_GLOBAL[odd].search(x) and (x.startswith("@" + MARK) or not SKIPPED[self.mode][odd].search(bare)) else x
        if x[0] in "!\n" or (UNTOUCHED if advanced else IS_LABEL)[odd].search(x):
            return x
        if advanced and STRING[odd].search(x):
            return "<STRING_CONST>"
        return mask_constants(x, self.float_first, self.mode, odd)

    def marked(self, body: str, odd: bool) -> str:
        """The text with the names on its define (regex mode: or declare) lines marked."""
        pattern = DEFINED[self.mode][odd]
        if odd:
            return pattern.sub(r"\1@" + MARK + r"\2", body)
        out, done = [], 0
        for found in HEADS[self.mode].finditer(body):  # only what begins a line is looked at
            begin = body.rfind("\n", 0, found.start()) + 1
            if begin >= done and not body[begin : found.start()].strip(" \t") and (m := pattern.match(body, begin)):
                out += [body[done:begin], m[1], "@" + MARK, m[2]]
                done = m.end()
        return "".join([*out, body[done:]]) if out else body

    def __call__(self, text: str) -> str:
        odd, advanced = is_odd(text), self.mode == "advanced"
        if advanced:
            body = without_metadata_tail(text, odd)
        else:
            body = text.strip(" ")
            if "source_filename" in body or "target " in body:
                body = HEADER[odd].sub("", body)
            body = without_comments(without_metadata_tail(body, odd))
        known = {} if odd else self.known
        if len(known) > self.REMEMBERED:
            known.clear()
        look = known.get
        names: tuple[dict, dict] = {}, {}
        out = []
        add = out.append
        for x in (SEGMENT_ADVANCED if advanced else SEGMENT)[odd].findall(self.marked(body, odd)):
            found = look(x)
            if found is None:
                found = self.part(x, odd)
                if len(x) <= self.SHORT:
                    known[x] = found
            if found.__class__ is str:
                add(found)
            else:
                kind, name = found
                of_kind = names[kind]
                number = of_kind.get(name)
                if number is None:
                    number = of_kind[name] = f"@func{len(of_kind)}" if kind else f"%var{len(of_kind)}"
                add(number)
        return "".join(out).strip(" ")


def counted_lines(text: str) -> list[int]:
    """For each function body of a file how many lines count: not blank, no comment, the closing brace included.

    A define line opens a body, whose lines count until the depth of braces is back at zero.
    """
    depth, n, done = 0, 0, []
    for line in [x.strip(" ") for x in text.split("\n")]:
        if depth:
            n += line != "" and line[0] != ";"
        elif line.startswith("define") and "{" in line:
            n = 0
        else:
            continue
        depth = max(0, depth + line.count("{") - line.count("}"))
        if not depth:
            done.append(n)
    return [*done, n] if depth else done


# --- functions ----------------------------------------------------------------------------------------

INNER = two(r"^define [^\n]*\{[^\n]*\n((?s:.)*?)\n?\}\s*~Z")
ON_ONE_LINE = two(r"^define [^\n;]*\{[ \t]*([^\n;{}]*(?:\{[^\n;{}]*\}[^\n;{}]*)*)\}[^\n]*~Z")
EMPTY_LINE = two(r"~S[ \t]*(?:;[^\n]*)?(?:\n|\Z)")
GOES_ON = two(r"\n(?=[ \t]*(?:to label %|cleanup\b|catch |filter ))")
BRACKETED = two(r"\b(?:switch|indirectbr) ")
BRACKET = re.compile(r"([\[\]])")
AT_LABEL, FIRST_LABEL = re.compile(rf"\n(?=[ \t]*{NAME}:)"), re.compile(LABEL)
GAP = re.compile(BREAK + r"[ \t\n\x0b\f\r]*")
DEFINES = re.compile(rf"%({NAME})[ \t\n\x0b\f\r]*=")
CODE = re.compile(r'(?:[^;"]++|"[^"]*")*+')
USES, TARGETS = re.compile(rf"%({NAME})"), re.compile(rf"label %({NAME})")
TERMINATES = two(TERMINATOR)


def inner_of(text: str, odd: bool) -> str:
    """What stands between the braces of a function of several lines."""
    if odd:
        found = INNER[odd].search(text)
        return found[1] if found else ""
    end, first = text.rstrip(" \t\n\x0b\f\r"), text.find("\n") + 1
    if not (text.startswith("define ") and "{" in text[7 : first - 1] and end.endswith("}") and len(end) > first):
        return ""
    last = len(end) - 1
    return text[first : last - 1 if last > first and text[last - 1] == "\n" else last]


def without_empty_lines(body: str, odd: bool) -> str:
    """Drops blank and comment lines; of the last line, which has no break, only what stands on it."""
    if odd:
        return EMPTY_LINE[odd].sub("", body)
    *lines, last = [x if (y := x.lstrip(" \t")) and y[0] != ";" else "" for x in body.split("\n")]
    return "\n".join([*filter(None, lines), last])


def body_of(text: str) -> str:
    """The lines of a function between its braces, without blank and comment lines; instructions over several lines are joined by BREAK."""
    odd = is_odd(text)
    if "\n" in text.strip(" "):
        body = inner_of(text, odd)
    else:
        found = ON_ONE_LINE[odd].search(text)
        body = found[1].rstrip(" ") if found else ""
    body = GOES_ON[odd].sub(BREAK, without_empty_lines(body, odd))
    if not (("switch " in body or "indirectbr " in body) and BRACKETED[odd].search(body)):
        return body
    parts = BRACKET.split(body)  # a break goes whose next bracket is a closing one
    return "".join([p.replace("\n", BREAK) if parts[i + 1 : i + 2] == ["]"] else p for i, p in enumerate(parts)])


def blocks_of(text: str) -> list[tuple[str, str, list[str]]]:
    """Block (its label, entry where the first has none), label as it stands, and lines (trimmed, label line left out), in order."""
    out = []
    for part in AT_LABEL.split(body_of(text)):
        found = FIRST_LABEL.match(part)
        lines = [y for x in part.split("\n") if (y := x.strip(" "))]
        if found:
            out.append((found[1].replace('"', ""), found[1], lines[1:]))
        elif lines:
            out.append(("entry", "", lines))
    return out


def on_one_line(line: str) -> str:
    return GAP.sub(" ", line) if BREAK in line else line


def needles_of(text: str) -> list[str]:
    """The instructions of a function as they are in its text."""
    return [x.replace(BREAK, "\n") for _, _, lines in blocks_of(text) for x in lines]


class Lines:
    """What lines define, use and name as successors, remembered for lines that come again."""

    SHORT, REMEMBERED = 300, 200_000

    def __init__(self):
        self.known: dict[str, tuple[str, list[str]]] = {}
        self.targets: dict[str, list[str]] = {}

    def names(self, line: str) -> tuple[str, list[str]]:
        """The local name that an instruction defines (empty: none), and the distinct ones that it uses, without its own and without those in its comment."""
        found = self.known.get(line)
        if found is None:
            own = DEFINES.match(line)
            code = CODE.match(line[own.end() :] if own else line)[0]
            found = own[1].replace('"', "") if own else "", list(dict.fromkeys([n.replace('"', "") for n in USES.findall(code)]))
            if len(line) <= self.SHORT:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[line] = found
        return found

    def successors(self, line: str) -> list[str]:
        """The blocks that a terminator names, in order; none for other instructions."""
        found = self.targets.get(line)
        if found is None:
            found = [n.replace('"', "") for n in TARGETS.findall(line)] if "label %" in line and TERMINATES[is_odd(line)].search(line) else []
            if len(line) <= self.SHORT:
                if len(self.targets) >= self.REMEMBERED:
                    self.targets.clear()
                self.targets[line] = found
        return found

    def def_use(self, lines: list[str]) -> list[tuple[int, int]]:
        """The numbers of the instruction that defines a value (its first one) and of each that uses it, in the order of uses."""
        names = [self.names(x) for x in lines]
        at: dict[str, int] = {}
        for i, (own, _) in enumerate(names):
            if own:
                at.setdefault(own, i)
        return [(at[u], i) for i, (_, used) in enumerate(names) for u in used if u in at]

    def edges(self, blocks: list[tuple[str, str, list[str]]], last_only: bool) -> list[tuple[str, str, int, float]]:
        """src, dst, number and probability of a function's control-flow edges, of any line or of the last one of each block."""
        out = []
        for block, _, lines in blocks:
            for x in lines[-1:] if last_only else lines:
                if "label %" in x:
                    to = self.successors(on_one_line(x))
                    out += [(block, t, k, 1.0 / len(to)) for k, t in enumerate(to)]
        return out

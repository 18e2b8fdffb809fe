"""Regular expressions in RE2 syntax for Spark's Java engine.

Rules are written in RE2 syntax. Java reads most of it alike; this module rewrites what means something else
there and rejects what RE2 lacks (look-around, backreferences, possessive quantifiers, atomic groups).
"""

from __future__ import annotations

import re

#: RE2's \\s, which unlike Java's has no vertical tab.
_SPACE = r"\t\n\f\r "
_PLAIN_ESCAPES = set("dDwWbBAzftnr")
#: General categories that Java names as RE2 does.
_CATEGORIES = set("C Cc Cf Cn Co Cs L Ll Lm Lo Lt Lu M Mc Me Mn N Nd Nl No P Pc Pd Pe Pf Pi Po Ps S Sc Sk Sm So Z Zl Zp Zs".split())
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit"}


class RegexSyntaxError(ValueError):
    pass


class _Translator:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        self.multiline = [False]

    def fail(self, why: str):
        raise RegexSyntaxError(f"{why} at {self.at} in {self.text!r}")

    def rest(self) -> str:
        return self.text[self.at :]

    def take(self, pattern: str) -> re.Match | None:
        found = re.compile(pattern).match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def run(self) -> str:
        repeatable = False
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "(":
                self.group()
                repeatable = False
            elif c == ")":
                if len(self.multiline) == 1:
                    self.fail("unexpected )")
                self.multiline.pop()
                self.emit(c)
                repeatable = True
            elif c in "*+?" or (c == "{" and re.match(r"\{\d+(,\d*)?\}", self.rest())):
                if not repeatable:
                    self.fail("nothing to repeat")
                found = self.take(r"[*+?]|\{\d+(,\d*)?\}")
                if any(int(n) > 1000 for n in re.findall(r"\d+", found[0])):
                    self.fail("repeat count too large")
                self.out.append(found[0])
                if self.take(r"\?"):
                    self.out.append("?")
                if re.match(r"[*+?]|\{\d+(,\d*)?\}", self.rest()):
                    self.fail("nested repeat")
                repeatable = False
            elif c == "[":
                self.char_class()
                repeatable = True
            elif c == "\\":
                self.escape(False)
                repeatable = True
            elif c == "$":
                self.at += 1
                self.out.append("$" if self.multiline[-1] else r"\z")
                repeatable = True
            elif c == "|":
                self.emit(c)
                repeatable = False
            else:
                self.at += 1
                self.out.append("\\" + c if c in "{}" else c)
                repeatable = True
        if len(self.multiline) > 1:
            self.fail("missing )")
        return "(?d)" + "".join(self.out)

    def emit(self, c: str) -> None:
        self.out.append(c)
        self.at += 1

    def group(self) -> None:
        if not self.rest().startswith("(?"):
            self.multiline.append(self.multiline[-1])
            return self.emit("(")
        name = self.take(r"\(\?P?<([A-Za-z_]\w*)>")
        if name:
            self.multiline.append(self.multiline[-1])
            self.out.append(f"(?<{name[1].replace('_', '')}>")
            return None
        flags = self.take(r"\(\?([ims]*)(-([ims]+))?([:)])")
        if not flags:
            self.fail("unsupported group")
        multiline = ("m" in flags[1] or self.multiline[-1]) and "m" not in (flags[3] or "")
        on, off = flags[1].replace("i", "iu"), (flags[3] or "").replace("i", "iu")
        self.out.append(f"(?{on}{'-' + off if off else ''}{flags[4]}" if on or off or flags[4] == ":" else "")
        if flags[4] == ":":
            self.multiline.append(multiline)
        else:
            self.multiline[-1] = multiline
        return None

    def escape(self, inside: bool) -> None:
        if self.take(r"\\Q"):
            found = self.take(r"(?s)(.*?)(\\E|\Z)")
            self.out.append("".join("\\" + c if c in r"\.[]{}()<>*+-=!?^$|&" else c for c in found[1]))
        elif found := self.take(r"\\x(\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})"):
            self.out.append(found[0])
        elif found := self.take(r"\\([pP])(\{\^?(\w+)\}|([A-Z]))"):
            name = found[3] or found[4]
            negated = (found[1] == "P") != (found[2] or "").startswith("{^")
            self.out.append(f"\\{'P' if negated else 'p'}{{{name if name in _CATEGORIES else 'Is' + name}}}")
        else:
            found = self.take(r"(?s)\\(.)")
            if not found:
                self.fail("trailing backslash")
            c = found[1]
            if c in "sS":
                spaces = f"[{'^' if c == 'S' else ''}{_SPACE}]"
                self.out.append(_SPACE if inside and c == "s" else spaces)
            elif c == "v":
                self.out.append(r"\x0B")
            elif c == "a":
                self.out.append(r"\x07")
            elif c in _PLAIN_ESCAPES and not (inside and c in "bBAz"):
                self.out.append("\\" + c)
            elif c.isalnum():
                self.fail("unsupported escape")
            else:
                self.out.append("\\" + c)

    def char_class(self) -> None:
        self.take(r"\[")
        self.out.append("[")
        if self.take(r"\^"):
            self.out.append("^")
        first = True
        while True:
            if self.at >= len(self.text):
                self.fail("missing ]")
            posix = self.take(r"\[:(\^?)(\w+):\]")
            if posix:
                if posix[2] == "word":
                    self.out.append(r"\W" if posix[1] else r"\w")
                elif posix[2] == "space":
                    self.out.append(r"[^\t\n\x0B\f\r ]" if posix[1] else r"\t\n\x0B\f\r ")
                elif posix[2] in _POSIX:
                    self.out.append(f"\\{'P' if posix[1] else 'p'}{{{_POSIX[posix[2]]}}}")
                else:
                    self.fail("unknown class")
                first = False
                continue
            c = self.text[self.at]
            if c == "]" and not first:
                return self.emit("]")
            if c == "\\":
                self.escape(True)
            else:
                self.at += 1
                self.out.append("\\" + c if c in "[]&" else c)
            first = False


def re2_to_java(pattern: str) -> str:
    """The Java pattern that matches what `pattern` matches in RE2; RegexSyntaxError if RE2 has no such pattern."""
    return _Translator(pattern).run()

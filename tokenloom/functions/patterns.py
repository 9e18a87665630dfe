"""Regular expressions with Unicode classes, translated to Java's dialect."""

from __future__ import annotations

import re

#: Noncharacters used to mark cuts; a text that holds one of the first two is escaped before and restored after.
CUT, ESCAPE, ONE, TWO = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
#: Property names that Java knows as general categories; every other name is a script.
_CATEGORIES = {"L", "Lu", "Ll", "Lt", "Lm", "Lo", "M", "Mn", "Mc", "Me", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "S", "Sm", "Sc", "Sk", "So", "Z", "Zs", "Zl", "Zp", "C", "Cc", "Cf", "Co", "Cn", "Cs"}


def literal(text: str) -> str:
    return "".join("\\" + c if c in r"\^$.|?*+()[]{}-&~#" or c.isspace() and c != " " else c for c in text)


def java(pattern: str) -> str:
    """Unicode classes and case, scripts as Is-names, line ends only where the source means them."""
    out, i, inside = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if m := re.match(r"\\([pP])\{(\^?)(\w+)\}", pattern[i:]):
            name = m[3] if m[3] in _CATEGORIES or m[3].startswith("Is") else "Is" + m[3]
            out.append(f"\\{'P' if (m[1] == 'P') != bool(m[2]) else 'p'}{{{name}}}")
            i += len(m[0])
            continue
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        out.append({"$": r"\z", "^": r"\A"}.get(c, c) if not inside else c)
        i += 1
    return "(?Ud)" + "".join(out)


def replacement(text: str) -> str:
    """A replacement with $1 groups; a name that runs on after the digits is another group, which is empty."""
    text = text.replace("\\", "\\\\")
    return re.sub(r"\$(\w+)", lambda m: f"${m[1]}" if m[1].isdigit() else "", text)


def plain_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")

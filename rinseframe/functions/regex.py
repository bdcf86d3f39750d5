"""Python regular-expression spelling to the Java spelling Spark uses."""

from __future__ import annotations

import re


def java_group(name: str, pattern: str) -> str:
    """A group name Java allows, for the named group of a Python pattern."""
    return f"named{re.compile(pattern).groupindex[name]}"


def java_pattern(pattern: str) -> str:
    """Rewrite a Python pattern for ``regexp_replace``; invalid patterns raise.

    Covers named groups, ``\\Z``, a bare ``[`` or ``&&`` inside a character class
    and the Unicode meaning of ``\\w \\d \\s \\b``.
    """
    re.compile(pattern)
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{java_group(m.group(1), pattern)}>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{java_group(m.group(1), pattern)}>", named)
    named = re.sub(r"(?<!\\)((?:\\\\)*)\{,(\d+)\}", r"\1{0,\2}", named)
    named = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", named)

    def inside_class(match: re.Match) -> str:
        body = re.sub(r"(?<!\\)\[", r"\\[", match.group(2))
        return "[" + match.group(1) + body.replace("&&", r"&\&") + "]"

    # a class: "[", optional "^", optional leading "]", then escapes or non-"]"
    named = re.sub(r"(?<!\\)\[(\^?)(\]?(?:\\.|[^\]\\])*)\]", inside_class, named)
    needs_unicode = re.search(r"\\[wWdDsSbB]", pattern) or re.search(r"\(\?[a-z]*i", pattern)
    return "(?U)" + named if needs_unicode else named


def java_replacement(replacement: str, pattern: str) -> str:
    """Rewrite ``\\1``, ``\\g<1>`` and ``\\g<name>``; keep literal ``$`` and ``\\``."""
    compiled = re.compile(pattern)
    escapes = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}

    def group_reference(name: str) -> str:
        if not name.isdigit():
            if name not in compiled.groupindex:
                raise ValueError(f"unknown group {name!r}")
            return "${" + java_group(name, pattern) + "}"
        if int(name) > compiled.groups:
            raise ValueError(f"invalid group reference {name}")
        return "$" + str(int(name))

    out, pos = [], 0
    for match in re.finditer(r"\\(?:g<(\w+)>|([1-9]\d?)|(.))|([$])", replacement, re.S):
        out.append(replacement[pos : match.start()])
        named, number, escaped, dollar = match.groups()
        if named or number:
            reference = group_reference(named or number)
            following = replacement[match.end() : match.end() + 1]
            if following.isdigit() and not reference.endswith("}"):
                # Java would read "$1" followed by "0" as group 10 when there is one
                following_digit = "\\" + following
                out.append(reference + following_digit)
                pos = match.end() + 1
                continue
            out.append(reference)
        elif dollar:
            out.append(r"\$")
        elif escaped in escapes:
            out.append(escapes[escaped])
        else:
            out.append("\\\\" if escaped == "\\" else "\\\\" + escaped)
        pos = match.end()
    out.append(replacement[pos:])
    return "".join(out)

"""Span finder for JSX text: the one place where built-in functions do not reach.

Whether a quote or a ``<`` starts a string, a tag or a comparison depends on
the enclosing construct, so the text is read with a stack of open constructs.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_SCRIPT = re.compile(
    r"(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<word>[\w$#@]+)|(?P<arrow>=>)|(?P<op>\.\.\.|&&|\|\||\?\?|\?\.|.)",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TAG_START = re.compile(r"<(?=>|[A-Za-z_$][\w$.:-]*[\s/>{])")
_TAG = re.compile(r"(?P<close>/\s*>)|(?P<end>>)|(?P<open>\{)|(?P<tag><)|\"[^\"]*\"|'[^']*'|//[^\n]*|/\*.*?\*/|.", re.S)
_CHILD = re.compile(r"(?P<end></[^>]*>)|(?P<tag><)|(?P<open>\{)|[^<{]+", re.S)
_TEMPLATE = re.compile(r"(?P<open>\$\{)|(?P<end>`)|\\.|[^`\\$]+|.", re.S)
_FUNCTION = re.compile(r"function\s+([\w$]+)")
_IMPORT = re.compile(r"import\b\s*(?:[^;'\"()]*?\bfrom\s*)?(?:'[^'\n]*'|\"[^\"\n]*\")(?:\s*(?:with|assert)\s*\{[^}]*\})?(?:\s*;)?")

# Fixed values of the language: words after which an expression starts, words that
# continue one, and what may precede a declaration.
_PREFIX_WORDS = frozenset(
    "return typeof case in of delete void throw new else do await yield default export instanceof extends".split()
)
_INFIX_WORDS = frozenset("in of instanceof as satisfies".split())
_STATEMENT_START = frozenset(["", ";", "{", "}", ")", "export", "default", "else", ":"])


def _ends_operand(prev: str) -> bool:
    if prev in (")", "]", "}", "value"):
        return True
    return (prev[:1].isalnum() or prev[:1] in "_$#@") and prev not in _PREFIX_WORDS if prev else False


def scan(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first, end) of functions, arrows, elements and imports, outer first."""
    found: list[list] = []
    stack: list[tuple] = []  # (construct, first, index into found or None)
    arrows: list[tuple[int, int]] = []  # arrows without braces: (index, depth)
    function = None  # declaration waiting for its body: (index, depth)
    arrow = None  # arrow waiting for its body
    prev, prev_first, prev_end, before, before_first = "", 0, 0, "", 0
    paren_first, paren_before, async_first = 0, "", None
    fresh_line = False
    pos, size = 0, len(text)

    def close_arrows(depth: int, end: int) -> None:
        while arrows and arrows[-1][1] >= depth:
            found[arrows.pop()[0]][3] = end

    while pos < size:
        top = stack[-1][0] if stack else ""
        if top in ("tag", "child", "`"):
            m = (_TAG if top == "tag" else _CHILD if top == "child" else _TEMPLATE).match(text, pos)
            kind, first, pos = m.lastgroup, pos, m.end()
            if kind == "open":
                stack.append(("{", first, None))
                prev = "{"
            elif kind == "tag":
                stack.append(("tag", first, None))
            elif kind == "close" or (kind == "end" and top != "tag"):
                opened = stack.pop()
                if top == "child":
                    found.append(["jsx_element", "", opened[1], pos])
                before, prev, prev_first, prev_end = prev, "value", opened[1], pos
                fresh_line = False
            elif kind == "end":
                stack[-1] = ("child", stack[-1][1], None)
            continue

        m = _SCRIPT.match(text, pos)
        kind, first, token = m.lastgroup, pos, m.group()
        if kind == "gap":
            fresh_line = fresh_line or "\n" in token
            pos = m.end()
            continue
        if token == "/" and not _ends_operand(prev) and (r := _REGEX.match(text, pos)):
            m, kind, token = r, "str", r.group()
        pos = m.end()
        depth = len(stack)
        starts = fresh_line and _ends_operand(prev)
        if arrows and (
            token in (",", ";") or (token in (")", "]", "}"))
            or (starts and (kind in ("word", "str") and token not in _INFIX_WORDS or token in ("{", "@")))
        ):
            close_arrows(depth, prev_end)
        if arrow is not None and token != "{":
            arrows.append((arrow, depth))
            arrow = None
        shown = "value" if kind == "str" else token

        if token == "`":
            stack.append(("`", first, None))
        elif token == "<" and not _ends_operand(prev) and _TAG_START.match(text, first):
            stack.append(("tag", first, None))
        elif token in ("(", "["):
            stack.append((token, first, None))
            if token == "(":
                stack[-1] = ("(", first, (prev, prev_first))
        elif token == "{":
            owner = None
            if arrow is not None:
                owner, arrow = arrow, None
            elif function and function[1] == depth:
                owner, function = function[0], None
            stack.append(("{", first, owner))
        elif token in (")", "]", "}"):
            want = {")": "(", "]": "[", "}": "{"}[token]
            while stack and stack[-1][0] in ("(", "[") and stack[-1][0] != want and token == "}":
                stack.pop()
            if stack and stack[-1][0] == want:
                opened = stack.pop()
                if token == ")":
                    paren_first, (paren_before, async_first) = opened[1], opened[2]
                elif token == "}" and opened[2] is not None:
                    found[opened[2]][3] = pos
                    arrow_done = found[opened[2]][0] == "arrow_function"
                    shown = "value" if arrow_done else "}"
        elif kind == "arrow":
            if prev == ")":
                begin = async_first if paren_before == "async" else paren_first
            else:
                begin = before_first if before == "async" else prev_first
            found.append(["arrow_function", "", begin, size])
            arrow = len(found) - 1
        elif token == "function" and (named := _FUNCTION.match(text, first)):
            asynchronous = prev == "async"
            lead = before if asynchronous else prev
            if lead in _STATEMENT_START or (fresh_line and _ends_operand(lead)) or (asynchronous and lead in ("value",)):
                found.append(["function_declaration", named.group(1), prev_first if asynchronous else first, size])
                function = (len(found) - 1, depth)
            pos = named.end()
        elif token == "import" and not stack and (whole := _IMPORT.match(text, first)):
            pos = whole.end()
            found.append(["import", "", first, pos])
            shown = ";"
        before, before_first = prev, prev_first
        prev, prev_first, prev_end = shown, first, pos
        fresh_line = False

    close_arrows(0, prev_end)
    for construct, first, owner in stack:
        if construct in ("tag", "child"):
            found.append(["jsx_element", "", first, size])
    return sorted((tuple(f) for f in found), key=lambda f: (f[2], -f[3]))


def spans(text: str) -> list[dict]:
    """The scan result with contents and 1-based line numbers."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [
        {
            "node_type": kind,
            "name": name,
            "content": text[first:end],
            "start_line": bisect_right(breaks, first - 1) + 1,
            "end_line": bisect_right(breaks, max(first, end - 1) - 1) + 1,
        }
        for kind, name, first, end in scan(text)
    ]

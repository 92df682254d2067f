"""Line-by-line state machines for the detectors and the diff reader, written plainly, to hold the engine's plans against."""

from __future__ import annotations

import re

from codewhiff.operators import detectors as D
from codewhiff.operators.diff import HUNK
from codewhiff.plans import rules as R

WS = "\t\n\v\f\r                  　﻿"


def py(pattern: str, ignore_case: bool = False) -> re.Pattern:
    """A pattern of the catalogue for Python's own engine."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two, i = pattern[i : i + 2], i + 2
            out += {r"\s": WS if inside else f"[{WS}]", r"\S": f"[^{WS}]"}.get(two, two)
            continue
        inside = True if c == "[" and not inside else False if c == "]" and inside else inside
        out += {".": "[^\n\r  ]", "$": r"\Z"}.get(c, c) if not inside else "\\[" if c == "[" and out[-1:] == "[" else c
        i += 1
    return re.compile(out, re.ASCII | (re.I if ignore_case else 0))


CATCH, EMPTY, TODO, CONSOLE, HEADER = py(D.CATCH), py(D.CATCH_EMPTY), py(D.CATCH_TODO, True), py(D.CONSOLE), py(D.HEADER)
PROTOCOL, EXPORTED, EXCEPT, PASS, OPEN = py(D.PROTOCOL), py(D.EXPORTED), py(D.EXCEPT), py(D.EXCEPT_PASS), py(D.EXCEPT_OPEN)


def braces(line: str) -> int:
    depth, quote, skip = 0, "", False
    for c in line:
        if skip:
            skip = False
        elif c == "\\":
            skip = True
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        else:
            depth += {"{": 1, "}": -1}.get(c, 0)
    return depth


def body_of(lines: list[str], i: int, depth: int) -> list[str]:
    body = []
    for line in lines[i + 1 :]:
        if depth <= 0:
            break
        depth += braces(line)
        body.append(line)
    return body


def catches(lines):
    for i, line in enumerate(lines):
        if CATCH.search(line):
            at = line.index("catch")
            rest = line[line.index("{", at) :]
            yield i, line, at + 1, rest, braces(rest)


def empty_catch(lines):
    out = []
    message = R.BY_ID["no-empty-catch"].message
    for i, line, at, _, depth in catches(lines):
        if EMPTY.search(line):
            out.append((i + 1, at, message))
        elif depth:
            body = [b.strip(WS) for b in body_of(lines, i, depth)]
            body = [b for b in body if b not in ("", "}")]
            if all(TODO.search(b) for b in body):
                out.append((i + 1, at, R.TODO_CATCH if body else message))
    return out


def console_only(lines):
    out = []
    for i, _, at, rest, depth in catches(lines):
        if depth == 0:
            body = rest[1 : rest.rindex("}")].strip(WS) if "}" in rest else ""
            hit = bool(CONSOLE.search(body))
        else:
            body = [b for b in body_of(lines, i, depth) if b.strip(WS) not in ("", "{", "}")]
            logs = [bool(CONSOLE.search(b)) for b in body]
            hit = any(logs) and all(x or re.match(f"[{WS}]*//", b) for x, b in zip(logs, body))
        if hit:
            out.append((i + 1, at, R.BY_ID["no-console-error-only"].message))
    return out


def deep_nesting(lines):
    out, seen, depth = [], set(), 0
    for i, line in enumerate(lines):
        depth += line.count("{") - line.count("}")
        if depth >= 5 and depth not in seen:
            seen.add(depth)
            out.append((i + 1, 1, f"Nesting depth {depth}; return early or extract functions."))
        if depth < 5:
            seen.clear()
    return out


def god_function(lines):
    out = []
    for i, line in enumerate(lines):
        m = HEADER.search(line)
        if not m or "{" not in line[m.start() :]:
            continue
        name = m[1] or m[2] or m[3]
        depth, end = 0, i
        for j in range(i, len(lines)):
            depth += braces(lines[j])
            if depth == 0:
                end = j
                break
        if name not in R.KEYWORDS and end - i + 1 > 80:
            out.append((i + 1, 1, f"Function '{name}' has {end - i + 1} lines, more than 80; divide it."))
    return out


def unused_protocol(lines):
    m = EXPORTED.search("\n".join(lines))
    names = set(re.findall(D.QUOTED, m[1])) if m else set()
    out = []
    for i, line in enumerate(lines):
        m = PROTOCOL.search(line)
        if m and m[1] not in names and not any(re.search(rf"\b{m[1]}\b", x, re.ASCII) for j, x in enumerate(lines) if j != i):
            out.append((i + 1, line.index("class") + 1, f"Protocol '{m[1]}' isn't used in this file."))
    return out


def pass_except(lines):
    out, message = [], R.BY_ID["no-pass-except"].message

    def indent(x):
        return len(x) - len(x.lstrip(WS))

    for i, line in enumerate(lines):
        if not EXCEPT.search(line):
            continue
        if PASS.search(line):
            out.append((i + 1, line.index("except") + 1, message))
            continue
        if not OPEN.search(line):
            continue
        passes = real = False
        for x in lines[i + 1 :]:
            bare = x.strip(WS)
            if not bare:
                continue
            if indent(x) <= indent(line):
                break
            passes |= bare == "pass"
            if bare != "pass" and not bare.startswith("#"):
                real = True
                break
        if passes and not real:
            out.append((i + 1, line.index("except") + 1, message))
    return out


DETECT = {"no-empty-catch": empty_catch, "no-console-error-only": console_only, "no-deep-nesting": deep_nesting, "no-god-function": god_function, "no-unused-protocol": unused_protocol, "no-pass-except": pass_except}


def find(name: str, content: str):
    """(rule, line, column) of a file, detectors' messages included."""
    ext = name.rsplit(".", 1)[-1]
    lines, out = content.split("\n"), []
    for r in R.LINE_RULES:
        if ext in r.languages:
            p, a, x = py(r.pattern, r.ignore_case), r.anti and py(r.anti, r.anti_ignore_case), r.excl and py(r.excl)
            for i, line in enumerate(lines):
                m = p.search(line)
                if m and not (a and a.search(line)) and not (x and x.search(line)):
                    out.append((r.id, i + 1, len(line[: m.start()].encode("utf-16-le")) // 2 + 1, r.message))
    for r in R.DETECTORS:
        if ext in r.languages:
            out += [(r.id, *f) for f in DETECT[r.id](lines)]
    return sorted(out)


def changed(diff: str) -> set[tuple[str, int]]:
    out, file, n = set(), None, 0
    for t in diff.split("\n"):
        if t.startswith("diff "):
            file = None
        elif t.startswith("+++ "):
            rest, file = t[4:], None
            if rest.startswith('"'):
                if rest.rindex('"') > 0:
                    file = re.sub("^[ab]/", "", rest[1 : rest.rindex('"')]).replace("\\t", "\t").replace("\\n", "\n").replace("\\\\", "\\")
            elif rest[:2] in ("a/", "b/"):
                file = rest[2:].split("\t")[0]
        elif t.startswith(("--- ", "index ", "\\ ")):
            pass
        elif m := re.match(HUNK, t):
            n = int(m[1])
        elif file:
            if t.startswith("+"):
                out.add((file, n))
            n += not t.startswith("-")
    return out

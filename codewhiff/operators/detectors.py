"""The six detectors over whole files, each one pass over a file's lines as a higher-order ``aggregate``.

A file is a row, so a detector is a narrow transformation: no exchange, no window and no Python, whatever the number of
files, and it runs on streams too. State stays small: depths that were reported, blocks that are still open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import rules as R

CATCH = r"catch\s*(?:[(][^)]*[)])?\s*\{"
CATCH_EMPTY = CATCH + r"\s*\}"
CATCH_TODO = r"^//\s*(?:fixme|ignore|suppress|todo)"
CONSOLE = r"^\s*console\.(?:error|info|log|warn)\s*\("
_W = r"\s*"
_ARGS = "[(][^)]*[)]"
HEADER = r"(?:function\s+(\w+)|(?:var|let|const)\s+(\w+)" + f"{_W}={_W}" + r"(?:async\s+)?(?:" + _ARGS + "|[^=])" + _W + r"=>|(\w+)" + f"{_W}(?::{_W}" + r"\w[^=]*)?" + _W + _ARGS + f"{_W}(?::{_W}" + r"\w[^{]*)?" + _W + r"\{)"
PROTOCOL = "^" + _W + r"class\s+(\w+)" + _W + r"[(](?:[^)]*,\s*|)(?:[\w.]+[.])?Protocol(?:\s*,[^)]*)?[)]\s*:"
EXPORTED = r"__all__\s*[=:]\s*[(\[]([^\])]*)[)\]]"
QUOTED = R.QUOTE + "([^\"']+)" + R.QUOTE
EXCEPT = r"^\s*except\s*[:\w]"
EXCEPT_PASS = "^" + _W + "except" + _W + f"(?:{_ARGS}{_W})?" + r"(?:\w[,.\w\s]*)?" + r"(?:\s+as\s+\w+)?" + f"{_W}:{_W}pass{_W}" + r"(?:#.*)?$"
EXCEPT_OPEN = r":\s*(?:#.*)?$"

OUT = "array<struct<line:int,column:int,message:string>>"


def _found(line: Column, column: Column | int, message: Column | str) -> Column:
    column = F.lit(column) if isinstance(column, int) else column
    message = F.lit(message) if isinstance(message, str) else message
    return struct_of(line=line.cast("int"), column=column.cast("int"), message=message)


def _none() -> Column:
    return F.array().cast(OUT)


def _numbered(lines: Column, **facts: Callable[[Column], Column]) -> Column:
    """Lines as structs of number, text and ``facts``. What a step uses more than once should be one, for a step's expressions share nothing."""
    return F.transform(lines, lambda t, i: struct_of(no=i + 1, t=t, **{k: f(t) for k, f in facts.items()}))


def struct_of(**fields: Column) -> Column:
    """A struct; aliases within the bodies of higher-order functions would be dropped."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def _brace_at(t: Column) -> Column:
    """From the first opening brace after the first "catch" on."""
    return F.regexp_extract(t, r"(?s)catch[^{]*(\{.*)", 1)


def deep_nesting(lines: Column, content: Column) -> Column:
    """Each depth of five and more, once until a line ends with less."""
    start = struct_of(depth=F.lit(0), seen=F.array().cast("array<int>"), out=_none())

    def step(s: Column, x: Column) -> Column:
        depth = s.depth + x.delta
        new = (depth >= R.DEEPEST) & ~F.array_contains(s.seen, depth)
        message = F.format_string("Nesting depth %d; return early or extract functions.", depth)
        seen = F.when(depth < R.DEEPEST, F.array().cast("array<int>")).when(new, F.array_append(s.seen, depth)).otherwise(s.seen)
        return struct_of(depth=depth, seen=seen, out=F.when(new, F.array_append(s.out, _found(x.no, 1, message))).otherwise(s.out))

    return F.when(T.count_of(content, "{") >= R.DEEPEST, F.aggregate(_numbered(lines, delta=T.raw_braces), start, step, lambda s: s.out))


def _catch(lines: Column, classify: Callable[[Column], tuple[Column, Column]], single: Callable[[Column, Column], tuple[Column, Column]], close: Callable[[Column], tuple[Column, Column]], message: str) -> Column:
    """Catch blocks: ``classify`` tells of a body line whether it rules the block out and whether it is the one sought, ``single`` of a
    header whether it is a finding by itself, with ``message``, and whether its block stays open, ``close`` of an open block what it is at its end."""
    kind = "array<struct<line:int,column:int,depth:int,hit:boolean>>"
    start = struct_of(open=F.array().cast(kind), out=_none())

    def ended(done: Column) -> Column:
        return F.transform(F.filter(done, lambda o: close(o)[0]), lambda o: _found(o.line, o["column"], close(o)[1]))

    def step(s: Column, x: Column) -> Column:
        delta = T.braces(x.t)
        ruled_out, hit = classify(x.t)
        idle = F.size(s.open) == 0
        now = F.when(idle, s.open).when(ruled_out, F.array().cast(kind)).otherwise(
            F.transform(s.open, lambda o: struct_of(line=o.line, column=o["column"], depth=o.depth + delta, hit=o.hit | hit)))
        header = x.t.contains("catch") & T.matches(x.t, CATCH)
        first = T.braces(_brace_at(x.t))
        at = T.position(x.t, "catch").cast("int")
        is_found, is_open = single(x.t, first)
        opened = F.array(struct_of(line=x.no.cast("int"), column=at, depth=first, hit=F.lit(False))).cast(kind)
        still = F.filter(now, lambda o: o.depth > 0)
        return struct_of(
            open=F.when(header & is_open, F.concat(still, opened)).otherwise(still),
            out=F.concat(s.out, F.when(idle, _none()).otherwise(ended(F.filter(now, lambda o: o.depth <= 0))), F.when(header & is_found, F.array(_found(x.no, at, message))).otherwise(_none())),
        )

    return F.aggregate(_numbered(lines), start, step, lambda s: F.concat(s.out, ended(s.open)))


def _dropped(o: Column) -> tuple[Column, Column]:
    return F.lit(True), F.when(o.hit, F.lit(R.TODO_CATCH)).otherwise(F.lit(R.BY_ID["no-empty-catch"].message))


def _logged(o: Column) -> tuple[Column, Column]:
    return o.hit, F.lit(R.BY_ID["no-console-error-only"].message)


def empty_catch(lines: Column, content: Column) -> Column:
    """Catch blocks without a statement, or with nothing but an open task."""

    def classify(t: Column) -> tuple[Column, Column]:
        bare = T.strip(t)
        todo = T.matches(bare, CATCH_TODO, True)
        return ~(bare.isin("", "}") | todo), todo

    def single(t: Column, depth: Column) -> tuple[Column, Column]:
        empty = T.matches(t, CATCH_EMPTY)
        return empty | (depth < 0), ~empty & (depth > 0)

    return F.when(content.contains("catch"), _catch(lines, classify, single, _dropped, R.BY_ID["no-empty-catch"].message))


def console_only(lines: Column, content: Column) -> Column:
    """Catch blocks that only log."""

    def classify(t: Column) -> tuple[Column, Column]:
        logs = T.matches(t, CONSOLE)
        return ~(T.strip(t).isin("", "{", "}") | logs | T.matches(t, r"^\s*//")), logs

    def single(t: Column, depth: Column) -> tuple[Column, Column]:
        body = T.strip(F.regexp_extract(_brace_at(t), r"(?s)^\{(.*)\}", 1))
        return (depth == 0) & T.matches(body, CONSOLE), depth > 0

    return F.when(content.contains("catch") & content.contains("console."), _catch(lines, classify, single, _logged, R.BY_ID["no-console-error-only"].message))


def god_function(lines: Column, content: Column) -> Column:
    """Functions of more than 80 lines: from the header to the first line at whose end all braces since are closed."""
    start = struct_of(depth=F.lit(0), open=F.array().cast("array<struct<line:int,base:int,name:string>>"), out=_none())
    header = T.render(HEADER)

    def name(t: Column) -> Column:
        one, two, three = (F.regexp_extract(t, header, i) for i in (1, 2, 3))
        return F.when(one != "", one).when(two != "", two).otherwise(three)

    def starts(t: Column) -> Column:
        """The name of the function that begins on a line, or null."""
        begins = t.contains("{") & F.regexp_extract(t, f"(?s){header}.*", 0).contains("{")
        return F.when(begins & ~name(t).isin(*R.KEYWORDS), name(t))

    def step(s: Column, x: Column) -> Column:
        depth = s.depth + x.delta
        one = F.array(struct_of(line=x.no.cast("int"), base=s.depth, name=x.begins))
        now = F.when(x.begins.isNotNull(), F.concat(s.open, one)).otherwise(s.open)
        done = F.filter(now, lambda o: (o.base == depth) & (x.no - o.line + 1 > R.LONGEST))
        found = F.transform(done, lambda o: _found(o.line, 1, F.format_string("Function '%s' has %d lines, more than 80; divide it.", o["name"], x.no - o.line + 1)))
        idle = x.begins.isNull() & (F.size(s.open) == 0)
        return struct_of(depth=depth, open=F.when(idle, s.open).otherwise(F.filter(now, lambda o: o.base != depth)), out=F.when(idle, s.out).otherwise(F.concat(s.out, found)))

    return F.when(F.size(lines) > R.LONGEST, F.aggregate(_numbered(lines, delta=T.braces, begins=starts), start, step, lambda s: s.out))


def unused_protocol(lines: Column, content: Column) -> Column:
    """Protocol classes that no other line names and ``__all__`` doesn't hold."""
    pattern = T.render(PROTOCOL)
    exported = F.regexp_extract_all(F.regexp_extract(content, T.render(EXPORTED), 1), F.lit(QUOTED), F.lit(1))
    words = F.regexp_extract_all(content, F.lit(r"\w+"), F.lit(0))
    headers = F.filter(F.transform(_numbered(lines), lambda x: struct_of(no=x.no, t=x.t, name=F.regexp_extract(x.t, pattern, 1))), lambda h: h["name"] != "")

    def unused(h: Column) -> Column:
        here = F.regexp_extract_all(h.t, F.lit(r"\w+"), F.lit(0))
        return ~F.array_contains(exported, h["name"]) & (F.size(F.filter(words, lambda w: w == h["name"])) == F.size(F.filter(here, lambda w: w == h["name"])))

    out = F.transform(F.filter(headers, unused), lambda h: _found(h.no, T.position(h.t, "class"), F.format_string("Protocol '%s' isn't used in this file.", h["name"])))
    return F.when(content.contains("Protocol"), out)


def pass_except(lines: Column, content: Column) -> Column:
    """Except blocks with nothing but pass and comments."""
    message = R.BY_ID["no-pass-except"].message
    kind = "struct<line:int,column:int,indent:int,hit:boolean>"
    start = struct_of(open=F.lit(None).cast(kind), out=_none())

    def step(s: Column, x: Column) -> Column:
        o = s.open
        bare = T.strip(x.t)
        ends = (bare != "") & (T.indent(x.t) <= o.indent)
        real = ~ends & ~(bare.isin("", "pass") | bare.startswith("#"))
        kept = F.when(o.isNull() | ends | real, F.lit(None).cast(kind)).otherwise(struct_of(line=o.line, column=o["column"], indent=o.indent, hit=o.hit | (bare == "pass")).cast(kind))
        at = T.position(x.t, "except").cast("int")
        header = x.t.contains("except") & T.matches(x.t, EXCEPT)
        by_itself = T.matches(x.t, EXCEPT_PASS)
        new = struct_of(line=x.no.cast("int"), column=at, indent=T.indent(x.t).cast("int"), hit=F.lit(False)).cast(kind)
        out = F.when(o.isNotNull() & ends & o.hit, F.array_append(s.out, _found(o.line, o["column"], message))).otherwise(s.out)
        return struct_of(open=F.when(header & ~by_itself & T.matches(x.t, EXCEPT_OPEN), new).otherwise(kept), out=F.when(header & by_itself, F.array_append(out, _found(x.no, at, message))).otherwise(out))

    return F.when(content.contains("except"), F.aggregate(_numbered(lines), start, step, lambda s: F.when(s.open.hit, F.array_append(s.out, _found(s.open.line, s.open["column"], message))).otherwise(s.out)))


DETECT: dict[str, Callable[[Column, Column], Column]] = {
    "no-empty-catch": empty_catch,
    "no-console-error-only": console_only,
    "no-deep-nesting": deep_nesting,
    "no-god-function": god_function,
    "no-unused-protocol": unused_protocol,
    "no-pass-except": pass_except,
}

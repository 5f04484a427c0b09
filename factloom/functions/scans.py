"""Scans that need a state: routes with prefixes, nested routes, symbols and imports."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Collection, Iterator
from typing import Any, NamedTuple

Found = tuple[str, str, int, int, dict[str, Any]]  # rule, kind, start, end, payload


def balanced(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`; strings are passed over."""
    pairs, depth, i = {"(": ")", "{": "}", "[": "]"}, 0, at
    while i < len(text):
        c = text[i]
        if c in "\"'`":
            i += 1
            while i < len(text) and text[i] != c:
                i += 2 if text[i] == "\\" else 1
        elif c in pairs:
            depth += 1
        elif c in pairs.values():
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(text)


#: Comments and strings of languages with braces; what begins a template or may end a template's expression.
_LITERAL = r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"{3}.*?(?:\"{3}|\Z)|@"(?:""|[^"])*"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<brace>[{}])"""
_BRACED = re.compile(_LITERAL, re.DOTALL)
# a slash begins a pattern where no value can stand before it
_SCRIPT = re.compile(_LITERAL + r"""|(?P<tick>`)|(?:(?<=[(,=:\[!&|?;{}])|(?<=\breturn))[ \t]*(?P<pattern>/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/)""", re.DOTALL)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)


def _blank(text: str) -> str:
    return "\n".join([" " * len(line) for line in text.split("\n")])


def blanked(text: str, script: bool = False) -> tuple[str, str]:
    """A text of a language with braces, of equal length: as code (comments, templates and what strings hold are blank; a template's
    expressions stay), and with its comments blank only. script: templates and patterns between slashes too."""
    find, code, plain = (_SCRIPT if script else _BRACED).search, [], []
    at, depth, open_ = 0, 0, []  # depths of braces at which a template goes on

    def put(own: str, shown: str) -> None:
        code.append(own)
        plain.append(shown)

    while m := find(text, at):
        put(text[at : m.start()], text[at : m.start()])
        own, at, kind = m[0], m.end(), m.lastgroup
        template = kind == "tick"
        if kind == "comment":
            put(_blank(own), _blank(own))
        elif kind == "string":
            put(own[0] + _blank(own[1:-1]) + own[-1] if own[0] != "@" else f' "{_blank(own[2:-1])}"', own)
        elif kind == "pattern":
            put(_blank(own), own)
        elif own == "}" and open_ and open_[-1] == depth:
            open_.pop()
            template = True
            put(" ", own)
        elif kind == "brace":
            depth += 1 if own == "{" else -1
            put(own, own)
        if template:
            if kind == "tick":
                put(" ", own)
            end = _TEMPLATE.match(text, at).end()
            put(_blank(text[at:end]), text[at:end])
            at = end
            if text.startswith("${", at):
                open_.append(depth)
                put("  ", "${")
                at += 2
            elif at < len(text):
                put(" ", text[at])
                at += 1
    put(text[at:], text[at:])
    return "".join(code), "".join(plain)


def brackets(code: str) -> dict[int, int]:
    """The place after the bracket that closes each one, in one pass; the end of the text where none does."""
    close, out, open_ = {"(": ")", "{": "}", "[": "]"}, {}, []
    for m in re.finditer(r"[(){}\[\]]", code):
        if m[0] in close:
            out[m.start()] = len(code)
            open_.append((close[m[0]], m.start()))
        elif any(m[0] == c for c, _ in open_[-8:]):  # one that was left open is passed over
            while open_[-1][0] != m[0]:
                open_.pop()
            out[open_.pop()[1]] = m.end()
    return out


def enclosing(points: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """For each point, in order, the number of the innermost of nested spans, in order, that holds it; -1 if none does."""
    out, stack, k = [], [], 0
    for p in points:
        while k < len(spans) and spans[k][0] < p:
            while stack and spans[stack[-1]][1] <= spans[k][0]:
                stack.pop()
            stack.append(k)
            k += 1
        while stack and spans[stack[-1]][1] <= p:
            stack.pop()
        out.append(stack[-1] if stack else -1)
    return out


def top_level(text: str, separator: str = ",") -> list[str]:
    """Parts between separators outside of brackets and strings."""
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] in "({[":
            i = balanced(text, i)
            continue
        if text[i] in "\"'":
            q, i = text[i], i + 1
            while i < len(text) and text[i] != q:
                i += 1
        elif text[i] == separator:
            out.append(text[start:i].strip())
            start = i + 1
        i += 1
    return [*out, last] if (last := text[start:].strip()) else out


def _joined(prefix: str, path: str) -> str:
    return re.sub("/{2,}", "/", f"{prefix}/{path}").rstrip("/") or "/"


def _constants(text: str) -> dict[str, str]:
    return dict(re.findall(r"\bstatic\s+final\s+String\s+(\w+)\s*=\s*\"([^\"]*)\"", text))


def _string(expression: str, constants: dict[str, str]) -> str | None:
    """A string, a constant, or a sum of them."""
    parts = [p.strip() for p in expression.split("+")]
    got = [p[1:-1] if len(p) > 1 and p[0] == p[-1] == '"' else constants.get(p.rsplit(".", 1)[-1]) for p in parts]
    return "".join(got) if all(g is not None for g in got) else None


def spring_endpoints(text: str) -> Iterator[Found]:
    """Methods with a mapping, under the mapping of the class that was declared last before them."""
    constants = _constants(text)
    value = lambda args: next((s for a in top_level(args or "") if not re.match(r"(?!value|path)\w+\s*=", a) and (s := _string(re.sub(r"^(?:value|path)\s*=\s*", "", a).strip("{} "), constants)) is not None), "")
    classes = [(m.start(), m[1]) for m in re.finditer(r"\bclass\s+(\w+)", text)]
    prefixes: dict[int, str] = {}
    for m in re.finditer(r"@RequestMapping\s*(?:\(([^)]*)\))?", text):
        nxt = next((p for p, _ in classes if p > m.end()), None)
        if nxt is not None and not re.search(r"\)\s*\{|;", text[m.end() : nxt]):
            prefixes[nxt] = value(m[1])
    for m in re.finditer(r"@(Get|Post|Put|Patch|Delete)Mapping\s*(?:\(([^)]*)\))?\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:public|protected|private)?\s*([\w<>?,\s\[\].]+?)\s+(\w+)\s*\(", text):
        owner = max((p for p, _ in classes if p <= m.start()), default=None)
        kind = re.sub(r"\s+", " ", m[3]).strip()
        yield "spring.annotated-endpoint", "http_endpoint", m.start(), m.end(), {
            "framework": "spring", "method": m[1].upper(), "path": _joined(prefixes.get(owner, ""), value(m[2])), "handler_expression": m[4],
            "return_type": kind, "reactive": bool(re.match(r"(?:Mono|Flux)\b", kind)), "class_name": dict(classes).get(owner),
        }


def webflux_routes(text: str) -> Iterator[Found]:
    """Routes of functional builders, under the prefixes that they are nested in, then routes by predicates."""
    if "RouterFunction" not in text:
        return
    constants, order = _constants(text), 0
    nests = [(m.end() - 1, balanced(text, m.end() - 1), _string(top_level(text[m.end() : balanced(text, m.end() - 1) - 1])[0], constants) or "") for m in re.finditer(r"\.(?:path|nest)\s*\(", text) if top_level(text[m.end() : balanced(text, m.end() - 1) - 1])]
    inside = lambda at: "".join(p for s, e, p in sorted(nests) if s < at < e)
    for m in re.finditer(r"\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s*\(", text):
        args = top_level(text[m.end() : balanced(text, m.end() - 1) - 1])
        path = _string(args[0], constants) if args else None
        if path is not None and len(args) > 1:
            order += 1
            yield "webflux.functional-route", "http_endpoint", m.start(), balanced(text, m.end() - 1), {
                "framework": "webflux", "method": m[1], "path": _joined(inside(m.start()), path), "handler_expression": args[-1], "predicates": args[1:-1], "reactive": True, "route_order": order,
            }
    for m in re.finditer(r"(?<![.\w])(?:RequestPredicates\.)?(GET|POST|PUT|PATCH|DELETE)\s*\(\s*([^)]*?)\s*\)(\s*\.and\((?:[^()]|\([^()]*\))*\))*\s*,\s*([\w.:]+)", text):
        if (path := _string(m[2], constants)) is not None:
            order += 1
            yield "webflux.functional-route", "http_endpoint", m.start(), m.end(), {
                "framework": "webflux", "method": m[1], "path": _joined(inside(m.start()), path), "handler_expression": m[4], "predicates": [m[3].strip()] if m[3] else [], "reactive": True, "route_order": order,
            }


# Operators that a pipeline may show, those that say where it runs, and the words for a subscription by hand.
OPERATORS = (
    "map flatMap flatMapMany filter switchIfEmpty defaultIfEmpty zip zipWith zipWhen when then thenReturn onErrorResume onErrorMap doOnNext doOnError publishOn subscribeOn delayElement parallel runOn "
    "sequential collectList concatMap mergeWith timeout retry"
).split()
CONCURRENT = ("publishOn", "subscribeOn", "parallel", "runOn", "sequential")
SUBSCRIBED = "suscripción manual dentro del código de aplicación"


def reactive_pipelines(text: str) -> Iterator[Found]:
    """Methods that return a Mono or a Flux, and what their bodies do, each operator once."""
    code, plain = blanked(text)
    ends = brackets(code)
    classes = [(m.start(), m[1]) for m in re.finditer(r"\b(?:class|record|interface)\s+([A-Za-z_$][\w$]*)", code)]
    for m in re.finditer(r"\b(Mono|Flux)\s*<([^;{}()]*)>\s+([A-Za-z_$][\w$]*)\s*\(", code):
        tail = re.compile(r"\s*(?:throws\s+[\w.,\s]+)?\{").match(code, ends[m.end() - 1])
        if not tail:
            continue
        end = ends[tail.end() - 1]
        body = code[tail.end() : end]
        used = [x for x in dict.fromkeys(re.findall(r"\.([A-Za-z]+)\s*\(", body)) if x in OPERATORS]
        taken = re.search(r"bodyTo(Mono|Flux)\s*\(", body)
        yield "webflux.reactive-pipeline", "reactive_pipeline", m.start(), end, {
            "class_name": next((n for p, n in reversed(classes) if p < m.start()), None), "symbol_name": m[3], "container": m[1], "payload": m[2].strip(), "cardinality": "many" if m[1] == "Flux" else "zero-or-one",
            "operators": used, "empty_strategy": next((x for x in used if x in ("switchIfEmpty", "defaultIfEmpty")), None), "error_strategy": [x for x in used if x.startswith("onError") or x in ("retry", "timeout")],
            "concurrency": [x for x in used if x in CONCURRENT], "body_input": ("Mono" if "bodyToMono" in body else taken[1]) if taken else None, "sse": bool(re.search("ServerSentEvent|TEXT_EVENT_STREAM", body)),
            "risks": [SUBSCRIBED] if re.search(r"\.subscribe\s*\(", body) else [],
        }


_TYPE = r"\b(class|interface|record|enum)\s+([A-Za-z_$][\w$]*)([^{;]*)\{"
_HEAD = re.compile(r"(?:([\w$.]+)\.)?([A-Za-z_$][\w$]*)\s*(?:<[^<>(){};]*>\s*)?\(")
_DENSE = re.compile(r"\S+(?:\s{1,31}\S+)*")
_TAIL = re.compile(r"\s*(?::\s*[\w$<>\[\]|.,&?\s]+?)?\s*(?:throws\s+[\w$.,\s]+?)?\s*([{;]|=>)")
_ARROW = re.compile(
    r"(?:(\b(?:const|let|var)\s+)|(?<=[;{}\n])[ \t]*((?:(?:public|private|protected|static|readonly|override)\s+)*))([A-Za-z_$][\w$]*)\s*(?::[^=;{}]*?)?=\s*(async\b\s*)?(?:(function)\b\s*\*?\s*[\w$]*\s*)?(?:<[^<>(){};]*>\s*)?"
    r"(?:(\()|([A-Za-z_$][\w$]*)\s*=>)"
)
_ARROW_TAIL = re.compile(r"\s*(?::[^={};]+?)?\s*=>")
_BODY = re.compile(r"\s*(?::[^={};]+?)?\s*\{")
_NOT_NAMES = frozenset("if for while switch catch return function new else do try synchronized with super this async await typeof throw case in of lock using foreach when".split())


# Types that are no part of a program's own structure.
PLAIN_TYPES = frozenset(
    "byte short int long float double boolean char void String Integer Long Double Float Boolean Character BigDecimal BigInteger UUID URI URL Date Instant LocalDate LocalDateTime OffsetDateTime ZonedDateTime "
    "Object Class List Set Map Collection Optional Mono Flux".split()
)
SNIPPET = 4_000


def _placed(text: str, start: int, end: int, breaks: list[int]) -> dict[str, Any]:
    """Lines and snippet of a symbol."""
    return {"start_line": bisect_right(breaks, start - 1) + 1, "end_line": bisect_right(breaks, max(start, end - 1) - 1) + 1, "snippet": text[start : min(end, start + SNIPPET)]}


def _breaks(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


def _statement_end(code: str, at: int, ends: dict[int, int]) -> int:
    """Where an expression ends: before a separator, a closing bracket, or a line's end that nothing carries on."""
    while at < len(code):
        c = code[at]
        if c in "({[":
            at = ends[at]
            continue
        if c in ";,)}]" or c == "\n" and not re.compile(r"\s*[.?:&|+*=<>-]").match(code, at) and code[max(0, at - 200) : at].rstrip()[-1:] not in "=>&|+?:":
            break
        at += 1
    return at


#: What braces_symbols() yields.
BRACES = ("source.symbol", "source.type-relation", "source.injection", "source.call", "source.construction")


class _Function(NamedTuple):
    start: int
    end: int
    body: int  # where calls begin; its end if it has no body
    name: str
    owner: str | None
    head: tuple[int, int]  # parameters
    words: frozenset[str]


def heads(code: str) -> list[re.Match]:
    """All matches of _HEAD, which ends at its only bracket. Long blanks, as comments and strings leave them, are passed over: what
    stands between two of them is sought by itself, unless a head may go on behind: before a bracket, or within <>."""
    out, start, parts = [], None, list(_DENSE.finditer(code))
    for k, m in enumerate(parts):
        start, end = m.start() if start is None else start, m.end()
        after = code[parts[k + 1].start()] if k + 1 < len(parts) else ""
        if after and (after in "(<" or code.find("<", max(start, *(code.rfind(c, start, end) for c in "(){};>")), end) >= 0):
            continue
        out.extend(_HEAD.finditer(code, start, end))
        start = None
    return out


def _functions(code: str, calls: list[re.Match], ends: dict[int, int], types: list[tuple[int, int, re.Match]], script: bool, arrows_of_methods: bool) -> list[_Function]:
    """Methods, constructors, functions, and arrow functions with a name, in order of their places."""
    curly = sorted((p, e) for p, e in ends.items() if code[p] == "{")
    body_of = {m.end() - 1: m for _, _, m in types}
    spans = [(s, e) for s, e, _ in types]
    found: dict[int, _Function] = {}

    def placed(matches: list[re.Match], group: int) -> Iterator[tuple[re.Match, re.Match | None, str | None]]:
        """With the type whose own braces are the nearest, and the name of the innermost type."""
        points = [m.start(group) for m in matches]
        for m, k, t in zip(matches, enclosing(points, curly), enclosing(points, spans), strict=True):
            yield m, body_of.get(curly[k][0]) if k >= 0 else None, types[t][2][2] if t >= 0 else None

    def line_start(at: int) -> int:
        start = max(code.rfind(c, 0, at) for c in "\n;{}") + 1
        while (above := code.rfind("\n", 0, max(0, start - 1)) + 1) < start and code[start - 1] == "\n" and re.match(r"\s*@", code[above : start - 1]):
            start = above
        return start + len(code[start:at]) - len(code[start:at].lstrip(" \t\n)"))

    for m, direct, owner in placed(calls, 2):
        name, open_ = m[2], m.end() - 1
        if m[1] or name in _NOT_NAMES or code[max(0, m.start() - 1) : m.start()] == ".":
            continue
        tail = _TAIL.match(code, ends[open_])
        if not tail or tail[1] == "=>" and not (arrows_of_methods and direct):
            continue
        start = line_start(m.start())
        before = re.sub(r"@[\w.]+\s*(?:\([^()]*\))?", " ", code[start : m.start()])
        words = frozenset(re.findall(r"\w+", before))
        if "=" in before or words & {"new", "return", "else", "throw", "await"}:
            continue
        if tail[1] == ";" and not (direct and (direct[1] == "interface" or "abstract" in words)):
            continue
        end = ends[tail.end() - 1] if tail[1] == "{" else _statement_end(code, tail.end(), ends) if tail[1] == "=>" else tail.end()
        found[m.start(2)] = _Function(start, end, end if tail[1] == ";" else tail.end(), name, owner, (open_ + 1, ends[open_] - 1), words)
    for m, direct, owner in placed(list(_ARROW.finditer(code)) if script and "=" in code else [], 3):
        if not (m[1] or direct):
            continue
        if m[6]:
            head = (m.end(), ends[m.end() - 1] - 1)
            tail = (_BODY if m[5] else _ARROW_TAIL).match(code, head[1] + 1)
            if not tail:
                continue
            at = tail.end() - 1 if m[5] else tail.end()
        else:
            head, at = m.span(7), m.end()
        at += len(code[at:]) - len(code[at:].lstrip()) if not m[5] else 0
        end = ends[at] if code[at : at + 1] == "{" else _statement_end(code, at, ends)
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        words = frozenset(re.findall(r"\w+", f"{m[2] or ''} {m[4] or ''}"))
        found[m.start(3)] = _Function(start, end, at, m[3], owner, head, words)
    return [found[k] for k in sorted(found)]


def braces_symbols(path: str, text: str, bare: tuple[str, str] | None = None) -> Iterator[Found]:
    """Types, methods, functions, calls, constructions and injections of languages with braces, without a parser: brackets and names
    are sought in the code alone, so that comments and strings never count. A call belongs to the innermost function around it. Of
    functions with one name in one type, the second and later ones have their number behind their ids."""
    script = bool(re.search(r"\.[cm]?[jt]sx?$", path))
    code, plain = bare or blanked(text, script)
    ends, breaks = brackets(code), _breaks(text)
    head = lambda start: code[code.rfind("\n", 0, start) + 1 : start]
    types = [(m.start(), ends[m.end() - 1], m) for m in re.finditer(_TYPE, code)]
    functions = sorted(_functions(code, around := heads(code), ends, types, script, path.endswith(".cs")), key=lambda f: (f.start, -f.end))
    lombok = re.search(r"@RequiredArgsConstructor\b", code) is not None
    known: set[tuple[str | None, str]] = set()  # what Lombok's constructor takes
    flat = lambda a, b: re.sub(r"\s+", " ", plain[a:b]).strip()[:300]
    for start, end, m in types:
        yield "source.symbol", "code_symbol", start, end, {
            "symbol_id": f"{path}#{m[2]}", "name": m[2], "symbol_type": m[1], "class_name": None, "exported": "export" in head(start) or "public" in head(start), "signature": flat(start, m.end() - 1),
            "calls": [], "members": list(dict.fromkeys(f.name for f in functions if f.owner == m[2] and start < f.start < end)), "source_path": path, **_placed(text, start, end, breaks),
        }
        for kind, names in re.findall(r"\b(extends|implements)\s+([\w$.,\s]+?)(?=\bimplements\b|$)", _without_arguments(m[3]).strip()):
            for name in top_level(names):
                yield "source.type-relation", "type_relation", start, end, {"source_type": m[2], "target_type": name.strip(), "relation": kind, "source_path": path}
        for f in re.finditer(r"\bprivate\s+final\s+([A-Z][\w$]*(?:\s*<[^;=]+>)?)\s+([a-z_$][\w$]*)\s*;", code[start:end]) if lombok else ():
            known.add((m[2], f[2]))
            yield from _injected(path, m[2], f[2], f[1], start + f.start(), start + f.end())
    spans = [(f.body - 1, f.end) for f in functions]
    made_of = [m for m in around if m[2] not in _NOT_NAMES and not re.search(r"\bnew\s*$", code[max(0, m.start() - 20) : m.start()])]
    declared = {f.head[0] for f in functions}
    calls: dict[int, list[re.Match]] = {}
    order = sorted(range(len(spans)), key=lambda k: (spans[k][0], -spans[k][1]))
    for m, k in zip(made_of, enclosing([m.start(2) for m in made_of], [spans[k] for k in order]), strict=True):
        if k >= 0 and m.end() not in declared:
            calls.setdefault(order[k], []).append(m)
    seen: dict[tuple[str | None, str], int] = {}
    for k, f in enumerate(functions):
        seen[f.owner, f.name] = n = seen.get((f.owner, f.name), 0) + 1
        id_ = (f"{path}#{f.owner}.{f.name}" if f.owner else f"{path}#{f.name}") + (f"~{n}" if n > 1 else "")
        made, constructor = calls.get(k, []), f.owner is not None and f.name in ("constructor", f.owner)
        parameters = top_level(plain[slice(*f.head)])
        yield "source.symbol", "code_symbol", f.start, f.end, {
            "symbol_id": id_, "name": f.name, "symbol_type": "constructor" if constructor else "method" if f.owner else "function", "class_name": f.owner,
            "visibility": next((w for w in ("public", "protected", "private") if w in f.words), None), "static": "static" in f.words, "async": "async" in f.words, "exported": "export" in head(f.start) + code[f.start : f.head[0]],
            "parameters": parameters, "signature": flat(f.start, f.body - 1 if code[f.body - 1 : f.body] == "{" else f.body), "calls": list(dict.fromkeys(c[2] for c in made)), "source_path": path, **_placed(text, f.start, f.end, breaks),
        }
        for p in parameters if constructor else ():
            named = re.match(r"(?:@[\w.]+\s*(?:\([^()]*\)\s*)?|(?:public|private|protected|readonly|final|val|var)\s+)*(?:([A-Za-z_$][\w$]*)\??\s*:\s*([A-Z][\w$]*(?:<.*>)?)|([A-Z][\w$]*(?:\s*<.*>)?)\s+([A-Za-z_$][\w$]*))\s*(?:=.*)?$", p, re.DOTALL)
            if named and (f.owner, named[1] or named[4]) not in known:
                at = plain.find(p, f.head[0])
                yield from _injected(path, f.owner, named[1] or named[4], named[2] or named[3], at, at + len(p))
        for c in made:
            yield "source.call", "symbol_call", c.start(), c.end(), {
                "caller_symbol_id": id_, "caller_name": f.name, "caller_class": f.owner, "callee_name": c[2], "receiver": c[1], "expression": f"{c[1]}.{c[2]}" if c[1] else c[2], "source_path": path,
            }
    for m in re.finditer(r"(?:(?:const|let|var|[A-Z][\w$<>]*)\s+([a-z_$][\w$]*)\s*=\s*)?\bnew\s+([A-Z][\w$]*)(?:<[^>]*>)?\s*\(", code) if "new" in code else ():
        end = ends[m.end() - 1]
        yield "source.construction", "object_construction", m.start(), end, {"variable": m[1], "constructed_type": m[2], "arguments": top_level(plain[m.end() : end - 1]), "start": m.start(), "end": end, "source_path": path}


def _without_arguments(text: str) -> str:
    """Without what stands between <>, at any depth."""
    while (less := re.sub(r"<[^<>]*>", "", text)) != text:
        text = less
    return text


def _injected(path: str, owner: str, parameter: str, kind: str, start: int, end: int) -> Iterator[Found]:
    if re.sub(r"\s*<.*", "", kind, flags=re.DOTALL) not in PLAIN_TYPES:
        yield "source.injection", "dependency_injection", start, end, {"class_name": owner, "parameter": parameter, "dependency_type": kind, "start": start, "end": end, "source_path": path}


def imports(path: str, text: str) -> Iterator[Found]:
    if path.endswith((".java", ".kt")):
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;?", text, re.MULTILINE):
            yield "source.import", "module_dependency", m.start(), m.end(), {"source_path": path, "specifier": m[1], "imports": [m[1].rsplit(".", 1)[-1]]}
    elif re.search(r"\.[cm]?[jt]sx?$", path):
        for m in re.finditer(r"\bimport\s+(?:([\w$]+)|\{([^}]*)\}|\*\s+as\s+([\w$]+))?(?:\s*,\s*\{([^}]*)\})?\s*(?:from\s*)?[\"']([^\"']+)[\"']|\b(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*require\(\s*[\"']([^\"']+)[\"']\s*\)", text):
            names = [n.strip().split(" as ")[-1].strip() for g in (1, 2, 3, 4, 6, 7) if m[g] for n in m[g].split(",")]
            yield "source.import", "module_dependency", m.start(), m.end(), {"source_path": path, "specifier": m[5] or m[8], "imports": names, "external": not (m[5] or m[8]).startswith(".")}


def python_symbols(path: str, text: str) -> Iterator[Found]:
    """Symbols, calls and imports of Python, by its own parser. A file that it refuses has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    lines, breaks = text.split("\n"), _breaks(text)
    named = lambda n: list(dict.fromkeys(c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))))
    at = lambda line, col: starts[line - 1] + len(lines[line - 1].encode()[:col].decode("utf-8", "replace"))
    span = lambda n: (at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset))

    def walk(node: ast.AST, owner: str | None, caller: str | None, name: str | None) -> Iterator[Found]:
        for n in ast.iter_child_nodes(node):
            inner = (owner, caller, name)
            if isinstance(n, ast.ClassDef):
                yield "source.symbol", "code_symbol", *span(n), {"symbol_id": f"{path}#{n.name}", "name": n.name, "symbol_type": "class", "class_name": None, "calls": [], "members": [m.name for m in n.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))], "source_path": path, **_placed(text, *span(n), breaks)}
                inner = (n.name, caller, name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                id_ = f"{path}#{owner}.{n.name}" if owner else f"{path}#{n.name}"
                yield "source.symbol", "code_symbol", *span(n), {"symbol_id": id_, "name": n.name, "symbol_type": "method" if owner else "function", "class_name": owner, "parameters": [a.arg for a in n.args.args], "async": isinstance(n, ast.AsyncFunctionDef), "calls": named(n), "source_path": path, **_placed(text, *span(n), breaks)}
                inner = (owner, id_, n.name)
            elif isinstance(n, ast.Call) and caller and isinstance(n.func, (ast.Name, ast.Attribute)):
                callee = n.func.id if isinstance(n.func, ast.Name) else n.func.attr
                receiver = None if isinstance(n.func, ast.Name) else re.sub(r"^self\b", "this", ast.unparse(n.func.value))
                yield "source.call", "symbol_call", *span(n), {"caller_symbol_id": caller, "caller_name": name, "caller_class": owner, "callee_name": callee, "receiver": receiver, "expression": f"{receiver}.{callee}" if receiver else callee, "source_path": path}
            elif isinstance(n, ast.Import):
                for a in n.names:
                    yield "source.import", "module_dependency", *span(n), {"source_path": path, "specifier": a.name, "imports": [a.asname or a.name], "external": True}
            elif isinstance(n, ast.ImportFrom):
                yield "source.import", "module_dependency", *span(n), {"source_path": path, "specifier": "." * n.level + (n.module or ""), "imports": [a.asname or a.name for a in n.names], "external": not n.level}
            yield from walk(n, *inner)

    yield from walk(tree, None, None, None)


def manifests(path: str, text: str) -> Iterator[Found]:
    """Packages, scripts and runtimes of package.json; modules of Gradle builds."""
    import json

    if re.search(r"(?i)(?:^|/)(?:build|settings)\.gradle(?:\.kts)?$", path):
        owner = path.rpartition("/")[0] or "."
        module = lambda name: name.removeprefix(":").replace(":", "/")
        yield "repository.build-module", "build_module", 0, min(1, len(text)), {"module": owner, "manifest": path}
        for m in re.finditer(r"\bproject\s*\(\s*[\"'](:[^\"']+)[\"']\s*\)", text):
            yield "repository.build-dependency", "build_module_dependency", m.start(), m.end(), {"source_module": owner, "target_module": module(m[1]), "declaration": m[0], "source_path": path}
        for m in re.finditer(r"\binclude\s*\(?\s*([^\r\n)]+)", text) if "settings.gradle" in path else ():
            for name in re.findall(r"[\"'](:[^\"']+)[\"']", m[1]):
                yield "repository.build-module", "build_module", m.start(), m.end(), {"module": module(name), "declared_by": path}
        return
    if path.rsplit("/", 1)[-1] != "package.json":
        return
    try:
        data = json.loads(text)
    except ValueError:
        return
    if not isinstance(data, dict):
        return
    entries = lambda key: data[key].items() if isinstance(data.get(key), dict) else ()

    def span(name: str) -> tuple[int, int]:
        at = max(0, text.find(f'"{name}"'))
        return at, at + len(name) + 2

    for key, scope in (("dependencies", "runtime"), ("devDependencies", "development"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")):
        for name, version in entries(key):
            yield "package.dependencies", "package_dependency", *span(name), {"package": name, "declared_version": str(version), "scope": scope}
    for name, command in entries("scripts"):
        yield "package.scripts", "build_script", *span(name), {"name": name, "command": str(command)}
    for key, technology in (("packageManager", "package-manager"), ("engines", "runtime"), ("type", "module-system")):
        if data.get(key):
            yield "package.runtime", "technology", 0, 1, {"technology": technology, "value": data[key]}


def scan(path: str, text: str, rule_ids: Collection[str] | None = None) -> Iterator[Found]:
    """All of the above that a file's name calls for, and the file itself; of given rules, at least what they ask for."""
    asked = lambda *rules: rule_ids is None or any(r in rule_ids for r in rules)
    yield "repository.file", "repository_file", 0, len(text), {"path": path}
    script = bool(re.search(r"\.[cm]?[jt]sx?$", path))
    braces = re.search(r"\.(?:java|kt|cs|[cm]?[jt]sx?)$", path)
    bare = blanked(text, script) if braces and asked(*BRACES, "source.import", "spring.annotated-endpoint", "webflux.functional-route") else None
    if path.endswith(".java"):
        if asked("spring.annotated-endpoint"):
            yield from spring_endpoints(bare[1])
        if asked("webflux.functional-route"):
            yield from webflux_routes(bare[1])
        if asked("webflux.reactive-pipeline"):
            yield from reactive_pipelines(text)
    if path.endswith(".py"):
        if asked("source.symbol", "source.call", "source.import"):
            yield from python_symbols(path, text)
    elif braces:
        if asked(*BRACES):
            yield from braces_symbols(path, text, bare)
        if asked("source.import"):
            yield from imports(path, bare[1])
    if re.search(r"\.(?:java|kt|cs|py|[cm]?[jt]sx?)$", path):
        yield "source.module", "source_module", 0, len(text), {"path": path, "source_path": path}
    yield from manifests(path, text)

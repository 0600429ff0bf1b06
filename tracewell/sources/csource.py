"""Facts from C sources: tokens, macros and their expansions, conditionals, top-level entities.

A translation unit is preprocessed and split in one task; everything comes out as rows. This covers what impact analysis
needs: a preprocessor with nested expansion, arguments, `#` and `##`, conditionals over integer expressions, includes from a
given set of files; and top-level declarations without a full parser. What isn't understood is reported as not parsed cleanly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<space>[ \t\f\v\r]+)|(?P<newline>\n)|(?P<string>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*")|(?P<char>[uUL]?'(?:\\.|[^'\\\n])*')
|(?P<number>\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.])*)|(?P<ident>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<punct>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\#\#|[-+*/%&|^~!<>=?:;,.(){}\[\]\#])|(?P<other>.)""",
    re.S | re.X,
)
MAX_INCLUDES = 200


class SourceFault(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    col: int
    file: str = ""
    ctx: int = 0
    hide: frozenset = frozenset()


@dataclass
class Macro:
    name: str
    params: list[str] | None
    variadic: bool
    body: list[Token]
    file: str
    line: int


@dataclass
class Unit:
    """What one translation unit yields."""

    tokens: list[Token] = field(default_factory=list)
    macros: list[Macro] = field(default_factory=list)
    expansions: list[tuple] = field(default_factory=list)  # ctx, parent, macro, file, line, col, item_line, item_col
    conditions: list[tuple[str, list[str]]] = field(default_factory=list)
    clean: bool = True


def lex(text: str, file: str = "") -> list[list[Token]]:
    """Logical lines of tokens, after joining continued lines; comments are blanks."""
    text = re.sub(r"\\\r?\n", "\x00", text)
    lines: list[list[Token]] = [[]]
    line, start, at = 1, 0, 0
    for m in TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "newline":
            lines.append([])
            line, start = line + 1, m.end()
        elif kind == "comment" or s == "\x00" or kind == "space":
            pass
        else:
            s = s.replace("\x00", "")
            lines[-1].append(Token(kind, s, line, m.start() - start + 1, file))
        joined = s.count("\x00") if kind != "newline" else 0
        extra = m.group().count("\n") if kind == "comment" else 0
        line += joined + extra
        if extra:
            start = m.start() + m.group().rindex("\n") + 1
        at = m.end()
    assert at == len(text)
    return lines


class Preprocessor:
    def __init__(self, files: Mapping[str, str], predefined: Mapping[str, str] | None = None, persona: str = ""):
        self.files, self.unit, self.macros = files, Unit(), {}
        self.counter, self.depth = 0, 0
        for name, value in (predefined or {}).items():
            self.macros[name] = Macro(name, None, False, [t for x in lex(value, "<command>") for t in x], "<command>", 0)
        for line in lex(persona, "<persona>"):  # a compiler's dump of its definitions
            if len(line) > 2 and line[0].text == "#" and line[1].text == "define":
                self._define(line[2:], "<persona>")
        self.unit.macros.clear()

    def run(self, file: str) -> Unit:
        self._file(file)
        return self.unit

    def _file(self, file: str) -> None:
        if file not in self.files:
            self.unit.clean = False
            return
        self.depth += 1
        if self.depth > MAX_INCLUDES:
            raise SourceFault("includes are nested too deep")
        live: list[list[bool]] = []  # taken now, any taken before, outer taken
        held: list[Token] = []
        for tokens in lex(self.files[file], file):
            if not tokens:
                continue
            if tokens[0].text == "#":
                self.unit.tokens += self._expand(held)
                held = []
                self._directive(tokens[1:], file, live)
            elif all(x[0] for x in live):
                held += tokens
        self.unit.tokens += self._expand(held)
        self.depth -= 1

    def _directive(self, t: list[Token], file: str, live: list[list[bool]]) -> None:
        if not t:
            return
        word, rest, on = t[0].text, t[1:], all(x[0] for x in live)
        if word in ("if", "ifdef", "ifndef"):
            taken = on and self._condition(word, rest)
            live.append([taken, taken, on])
        elif word in ("elif", "elifdef", "elifndef", "else") and live:
            x = live[-1]
            taken = x[2] and not x[1] and (word == "else" or self._condition({"elif": "if", "elifdef": "ifdef", "elifndef": "ifndef"}[word], rest))
            x[0], x[1] = taken, x[1] or taken
        elif word == "endif" and live:
            live.pop()
        elif not on:
            return
        elif word == "define" and rest:
            self._define(rest, file)
        elif word == "undef" and rest:
            self.macros.pop(rest[0].text, None)
        elif word in ("include", "include_next"):
            self._include(rest, file)
        elif word == "error":
            self.unit.clean = False

    def _condition(self, word: str, t: list[Token]) -> bool:
        self.unit.conditions.append((word, [x.text for x in t]))
        if word != "if":
            return bool(t) and (t[0].text in self.macros) == (word == "ifdef")
        out, i = [], 0
        while i < len(t):
            if t[i].text == "defined":
                name = t[i + 2] if i + 2 < len(t) and t[i + 1].text == "(" else t[i + 1] if i + 1 < len(t) else t[i]
                out.append(Token("number", str(int(name.text in self.macros)), t[i].line, t[i].col))
                i += 4 if i + 1 < len(t) and t[i + 1].text == "(" else 2
            else:
                out.append(t[i])
                i += 1
        try:
            return bool(evaluate([x.text for x in self._expand(out, record=False)]))
        except (SourceFault, ZeroDivisionError):
            self.unit.clean = False
            return False

    def _include(self, t: list[Token], file: str) -> None:
        text = "".join(x.text for x in t)
        name = text[1:-1]
        near = f"{file.rsplit('/', 1)[0]}/{name}" if "/" in file else name
        for path in ([near] if text.startswith('"') else []) + [name] + sorted(p for p in self.files if p.endswith(f"/{name}")):
            if path in self.files:
                return self._file(path)
        self.unit.clean = False

    def _define(self, t: list[Token], file: str) -> None:
        name, params, variadic, i = t[0], None, False, 1
        if i < len(t) and t[1].text == "(" and t[1].col == name.col + len(name.text) and t[1].line == name.line:
            params, i = [], 2
            while i < len(t) and t[i].text != ")":
                if t[i].text == "...":
                    variadic = True
                    params.append("__VA_ARGS__")
                elif t[i].text != ",":
                    params.append(t[i].text)
                i += 1
            i += 1
        m = Macro(name.text, params, variadic, t[i:], file, name.line)
        self.macros[name.text] = m
        self.unit.macros.append(m)

    def _expand(self, tokens: list[Token], parent: int = 0, record: bool = True) -> list[Token]:
        out: list[Token] = []
        todo = tokens[::-1]
        while todo:
            t = todo.pop()
            m = self.macros.get(t.text) if t.kind == "ident" and t.text not in t.hide else None
            if m is None:
                out.append(t)
                continue
            args: list[list[Token]] = []
            if m.params is not None:
                if not todo or todo[-1].text != "(":
                    out.append(t)
                    continue
                todo.pop()
                args, deep = [[]], 0
                while todo:
                    a = todo.pop()
                    if a.text == ")" and not deep:
                        break
                    if a.text == "," and not deep and not (m.variadic and len(args) == len(m.params)):
                        args.append([])
                        continue
                    deep += (a.text == "(") - (a.text == ")")
                    args[-1].append(a)
                else:
                    self.unit.clean = False
            self.counter += 1
            ctx = self.counter
            if record:
                site = t
                self.unit.expansions.append((ctx, t.ctx or parent or None, m.name, site.file, site.line, site.col, t.line, t.col))
            made = self._substitute(m, args, t, ctx, record)
            todo += made[::-1]
        return out

    def _substitute(self, m: Macro, args: list[list[Token]], at: Token, ctx: int, record: bool) -> list[Token]:
        named = dict(zip(m.params or [], [*args, *[[]] * len(m.params or [])], strict=False))
        hide = at.hide | {m.name}
        place = lambda x: Token(x.kind, x.text, at.line, at.col, at.file, ctx, x.hide | hide)
        out: list[Token] = []
        i, body = 0, m.body
        while i < len(body):
            b = body[i]
            if b.text == "#" and m.params is not None and i + 1 < len(body) and body[i + 1].text in named:
                text = " ".join(x.text for x in named[body[i + 1].text]).replace("\\", "\\\\").replace('"', '\\"')
                out.append(place(Token("string", f'"{text}"', b.line, b.col)))
                i += 2
            elif i + 1 < len(body) and body[i + 1].text == "##" and i + 2 < len(body):
                left, right = (named[x.text] if x.text in named else [x] for x in (b, body[i + 2]))
                glued = (left[-1].text if left else "") + (right[0].text if right else "")
                found = [x for line in lex(glued) for x in line]
                out += [place(x) for x in [*left[:-1], *found, *right[1:]]]
                i += 3
            elif b.text in named:
                full = self._expand(list(named[b.text]), ctx, record)
                out += [Token(x.kind, x.text, at.line, at.col, at.file, x.ctx or ctx, x.hide) for x in full]
                i += 1
            else:
                out.append(place(b))
                i += 1
        return out


#: Binary operators of `#if` by precedence.
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))


def evaluate(t: list[str]) -> int:
    """Value of an integer expression of `#if`; names that are left count as 0."""
    at = 0

    def take(*wanted: str) -> str | None:
        nonlocal at
        if at < len(t) and t[at] in wanted:
            at += 1
            return t[at - 1]
        return None

    def unary() -> int:
        nonlocal at
        if (op := take("!", "-", "+", "~")) is not None:
            v = unary()
            return {"!": int(not v), "-": -v, "+": v, "~": ~v}[op]
        if take("("):
            v = ternary()
            if not take(")"):
                raise SourceFault("unbalanced condition")
            return v
        if at >= len(t):
            raise SourceFault("condition ends early")
        word = t[at]
        at += 1
        if re.match(r"[0-9]", word):
            word = re.sub(r"[uUlL]+$", "", word)
            return int(word, 8) if re.fullmatch(r"0[0-7]+", word) else int(word, 0)
        if word.startswith("'"):
            return ord(word[1:-1].encode().decode("unicode_escape")[0])
        if re.match(r"[A-Za-z_$]", word):
            return 0
        raise SourceFault(f"not understood: {word}")

    def binary(level: int) -> int:
        if level == len(LEVELS):
            return unary()
        v = binary(level + 1)
        while (op := take(*LEVELS[level])) is not None:
            w = binary(level + 1)
            if op in ("/", "%"):
                if not w:
                    raise ZeroDivisionError
                q = abs(v) // abs(w) * (1 if (v < 0) == (w < 0) else -1)
                v = q if op == "/" else v - q * w
            else:
                v = int({"||": v or w, "&&": v and w, "|": v | w, "^": v ^ w, "&": v & w, "==": v == w, "!=": v != w, "<": v < w, ">": v > w, "<=": v <= w, ">=": v >= w, "<<": v << w if 0 <= w < 64 else 0, ">>": v >> w if 0 <= w < 64 else 0, "+": v + w, "-": v - w, "*": v * w}[op] if op not in ("||", "&&") else bool(v or w) if op == "||" else bool(v and w))
        return v

    def ternary() -> int:
        v = binary(0)
        if take("?"):
            a = ternary()
            if not take(":"):
                raise SourceFault("unbalanced condition")
            b = ternary()
            return a if v else b
        return v

    v = ternary()
    if at != len(t):
        raise SourceFault("text after the condition")
    return v


@dataclass
class Entity:
    kind: str
    file: str
    name: str
    head: list[str]
    tail: list[str]
    mentions: list[str]
    calls: list[str]
    lines: list[int]
    expands: list[str]
    params: int | None = None
    variadic: bool = False


KEYWORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Noreturn _Static_assert".split())


def entities(unit: Unit, unit_file: str) -> list[Entity]:
    """Functions, globals, typedefs and records at the top level, and macros; head is the declaration, tail the body or initialiser."""
    found: list[Entity] = []
    names = {e[0]: e[2] for e in unit.expansions}
    parents = {e[0]: e[1] for e in unit.expansions}
    tokens, start, deep = unit.tokens, 0, 0
    for i, t in enumerate(tokens):
        deep += (t.text in "{([" and len(t.text) == 1) - (t.text in "})]" and len(t.text) == 1)
        if deep or t.text not in (";", "}"):
            continue
        if t.text == "}" and not (i + 1 == len(tokens) or _is_function(tokens[start:i])):
            continue
        part, start = tokens[start : i + 1], i + 1
        e = _entity(part, unit_file)
        if e is None:
            continue
        used: dict[str, None] = {}
        for x in part:
            c = x.ctx
            while c:
                used.setdefault(names[c])
                c = parents.get(c)
        e.expands = list(used)
        e.lines = sorted({x.line for x in part if x.file == unit_file})
        found.append(e)
    for m in unit.macros:
        head = [m.name] if m.params is None else [m.name, "(", *m.params, ")"]
        body = [x.text for x in m.body]
        found.append(Entity("Macro", m.file, m.name, head, body, [x.text for x in m.body if x.kind == "ident" and x.text not in KEYWORDS and x.text not in (m.params or [])], [], [m.line], []))
    if deep:
        unit.clean = False
    return found


def _is_function(part: list[Token]) -> bool:
    deep, seen = 0, None
    for t in part:
        if t.text == "{" and not deep:
            return seen == ")"
        deep += (t.text in "([{" and len(t.text) == 1) - (t.text in ")]}" and len(t.text) == 1)
        if t.text == "=" and not deep:
            return False
        if not deep:
            seen = t.text
    return False


def _entity(part: list[Token], file: str) -> Entity | None:
    texts = [t.text for t in part]
    if texts in ([";"], []):
        return None
    idents = list(dict.fromkeys(t.text for t in part if t.kind == "ident" and t.text not in KEYWORDS))
    where = part[0].file or file
    cut = next((i for i, x in enumerate(texts) if x in ("{", "=")), len(texts) - 1)
    if texts[0] in ("struct", "union", "enum") and "{" in texts and len(texts) > 2 and texts[1] != "{" and texts[-2] == "}":
        return Entity("Record", where, texts[1], texts[:2], texts[2:], [x for x in idents if x != texts[1]], [], [], [])
    if texts[0] == "typedef":
        name = next((x for x in reversed(texts[:-1]) if re.match(r"[A-Za-z_$]", x)), None)
        return name and Entity("Typedef", where, name, ["typedef", name], texts, [x for x in idents if x != name], [], [], [])
    if _is_function(part):
        opening = next(i for i, x in enumerate(texts) if x == "(")
        name, close, deep = texts[opening - 1], opening, 0
        for close in range(opening, cut):
            deep += (texts[close] == "(") - (texts[close] == ")")
            if not deep:
                break
        inner = texts[opening + 1 : close]
        level, commas = 0, 0
        for x in inner:
            level += (x == "(") - (x == ")")
            commas += x == "," and not level
        params = 0 if inner in ([], ["void"]) else commas + 1 - ("..." in inner)
        calls = list(dict.fromkeys(a for a, b in zip(texts[cut:], texts[cut + 1 :], strict=False) if b == "(" and a in idents))
        return Entity("Function", where, name, texts[:cut], texts[cut:], [x for x in idents if x != name], calls, [], [], params, "..." in inner)
    if "(" in texts[:cut] and texts[-1] == ";":
        return None  # a declaration of a function
    name = next((x for x in reversed(texts[:cut]) if re.match(r"[A-Za-z_$]", x) and x not in KEYWORDS), None)
    return name and Entity("Global", where, name, texts[:cut], texts[cut:], [x for x in idents if x != name], [], [], [])


def analyzed(file: str, files: Mapping[str, str], predefined: Mapping[str, str] | None = None, persona: str = "") -> tuple[Unit, list[Entity]]:
    try:
        unit = Preprocessor(files, predefined, persona).run(file)
    except (SourceFault, RecursionError):
        return Unit(clean=False), []
    return unit, entities(unit, file)


FACTS = """fact string, tu string, kind string, file string, name string, head array<string>, tail array<string>, ord int, other string, line int, col int, ctx int, parent int, item_line int, item_col int, params int, variadic boolean, clean boolean"""


def unit_facts(units: DataFrame, headers: DataFrame, limit_bytes: int = 256 << 20) -> DataFrame:
    """All facts of translation units (tu, text), told apart by the column fact; headers (path, text) are sent to every task.

    The headers of a tree are of a checked size; more than limit_bytes of them is an error, not a slow job.
    """
    size = headers.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > limit_bytes:
        raise SourceFault(f"{size} bytes of headers; the limit is {limit_bytes}")
    shared = units.sparkSession.sparkContext.broadcast({r["path"]: r["text"] for r in headers.collect()})
    names = [c.split()[0] for c in FACTS.split(", ")]

    def rows(tu: str, text: str) -> Iterator[dict]:
        unit, found = analyzed(tu, {**shared.value, tu: text})
        yield {"fact": "status", "tu": tu, "file": tu, "clean": unit.clean}
        for k, m in enumerate(unit.macros):
            yield {"fact": "macro", "tu": tu, "ord": k, "name": m.name, "file": m.file, "line": m.line, "other": " ".join(t.text for t in m.body)}
        for ctx, parent, macro, file, line, col, item_line, item_col in unit.expansions:
            yield {"fact": "expansion", "tu": tu, "ctx": ctx, "parent": parent, "name": macro, "file": file, "line": line, "col": col, "item_line": item_line, "item_col": item_col}
        for k, (word, tokens) in enumerate(unit.conditions):
            yield {"fact": "condition", "tu": tu, "ord": k, "name": word, "head": tokens}
        for k, e in enumerate(found):
            key = {"tu": tu, "kind": e.kind, "file": e.file, "name": e.name}
            yield {"fact": "fingerprint", **key, "head": e.head, "tail": e.tail, "ord": k, "params": e.params, "variadic": e.variadic}
            yield from ({"fact": "mention", **key, "other": x, "ord": i} for i, x in enumerate(e.mentions))
            yield from ({"fact": "expands", **key, "other": x, "ord": i} for i, x in enumerate(e.expands))
            yield from ({"fact": "call", **key, "other": x, "ord": i} for i, x in enumerate(e.calls))
            yield from ({"fact": "entity_line", **key, "line": x} for x in e.lines)
            yield from ({"fact": "address_taken", **key, "other": x} for x in e.mentions if x not in e.calls)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for tu, text in zip(b["tu"], b["text"], strict=True):
                yield pd.DataFrame([[r.get(n) for n in names] for r in rows(tu, text)], columns=names, dtype=object)

    return units.select("tu", "text").mapInPandas(run, FACTS)


def fingerprints(facts: DataFrame) -> DataFrame:
    """KEY, head, tail, ord of entities, once each."""
    return facts.where("fact = 'fingerprint'").select("kind", "file", "name", "head", "tail", "ord").dropDuplicates(["kind", "file", "name"])


def edges(facts: DataFrame, base: int = 0) -> DataFrame:
    """KEY, mentioned, ord: references first, expansions after, in the order of entities; base puts one side after another."""
    order = F.col("ord") + F.when(F.col("fact") == "expands", 1_000_000).otherwise(0) + base
    return facts.where("fact in ('mention', 'expands')").select("kind", "file", "name", F.col("other").alias("mentioned"), order.cast("long").alias("ord")).distinct()


def entity_lines(facts: DataFrame) -> DataFrame:
    return facts.where("fact = 'entity_line'").select("kind", "file", "name", "line").distinct()

"""Facts of source text in languages with braces, by an island grammar: strings and comments are lexed, brackets make scopes, and of what stands before a bracket or
at a statement's end only declarations, imports, bases, decorators and calls are understood; everything else is water between the islands.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words that declare a type or namespace, and words that are never called or declared, in the languages' own spelling.
TYPES = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "class", "trait": "interface", "namespace": "namespace", "mod": "namespace", "module": "namespace", "impl": "impl", "union": "struct"}
KEYWORDS = ["if", "for", "while", "switch", "return", "else", "do", "try", "catch", "throw", "in", "as", "super", "this", "async", "await", "case", "typeof", "static"]
OWN_KEYWORDS = {
    "csharp": ["foreach", "using", "lock", "fixed", "when", "sizeof", "nameof", "base", "default", "new", "where", "is", "checked", "unchecked"],
    "java": ["synchronized", "assert", "new", "instanceof"],
    "typescript": ["function", "new", "of", "delete", "yield", "import", "instanceof", "void"],
    "go": ["go", "defer", "select", "range", "func", "map", "chan"],
    "rust": ["fn", "match", "loop", "unsafe", "move", "where", "impl", "dyn", "mut"],
}
OWN_KEYWORDS["tsx"] = OWN_KEYWORDS["javascript"] = OWN_KEYWORDS["typescript"]
LANGUAGES = ["csharp", "java", "typescript", "tsx", "javascript", "go", "rust"]
#: Languages whose lines end statements.
_BY_LINE = {"go", "typescript", "tsx", "javascript"}
#: Languages that let members have the names of keywords.
_MEMBERS = {"typescript", "tsx", "javascript"}
#: What tells a raw identifier from a keyword in Rust.
_RAW = re.compile(r"\br#(?=\w)")
_STRINGS = {
    "csharp": r'\$?@\$?"(?:""|[^"])*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "java": r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'',
    "rust": r'b?r(#*)"[\s\S]*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\[^\n]|[^\'\\\n])\'(?!\w)',
    "typescript": r'`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_STRINGS["tsx"] = _STRINGS["javascript"] = _STRINGS["typescript"]
_LEXERS: dict[str, re.Pattern] = {}


@dataclass(slots=True)
class Token:
    kind: str  # name, string, line or the sign itself
    text: str
    line: int


@dataclass
class Scope:
    kind: str  # a declaration's kind, impl, function, block or file
    name: str  # the qualified name that what it holds belongs to
    head: list[Token] = field(default_factory=list)
    decorators: list[tuple[str, str, int]] = field(default_factory=list)
    inner: int = 0  # open parentheses and square brackets
    listed: int = 0  # open braces that list names


def tokens(body: str, language: str) -> list[Token]:
    if language not in _LEXERS:
        comment = r"//[^\n]*|/\*[\s\S]*?\*/" + (r"|^[ \t]*#(?:region|endregion|if|else|endif|pragma|nullable|define)[^\n]*" if language == "csharp" else "")
        _LEXERS[language] = re.compile(rf"(?P<skip>[ \t\r\f]+|{comment})|(?P<string>{_STRINGS[language]})|(?P<line>\n)|(?P<name>{'(?:r#)?' if language == 'rust' else ''}[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|\?\.|:=|[<>=!+\-*/%&|^]=|&&|\|\||\+\+|--|.)", re.M)
    out, line = [], 1
    for m in _LEXERS[language].finditer(body):
        if m.lastgroup != "skip":
            out.append(Token(m[0] if m.lastgroup == "sign" else m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


class Reader:
    """One file's facts, as ``code.facts`` has them: (kind, name, qualified_name, owner, line)."""

    def __init__(self, language: str):
        self.language = language
        self.words = {*KEYWORDS, *OWN_KEYWORDS[language]}
        self.out: list[tuple] = []
        self.scopes = [Scope("file", "")]

    def read(self, body: str) -> list[tuple]:
        every = tokens(body, self.language)
        for i, t in enumerate(every):
            s = self.scopes[-1]
            if t.kind in "([":
                s.inner += 1
            elif t.kind in ")]":
                s.inner -= 1
                if s.inner < 0:
                    return [self._error(t)]
            if t.kind == "line":
                if self.language in _BY_LINE and s.inner == 0 and self._ends(s.head, every[i + 1 :]):
                    self._statement(s)
            elif t.kind == "{" and self._lists_names(s):
                s.listed += 1
                s.inner += 1
                s.head.append(t)
            elif t.kind == "}" and s.listed:
                s.listed -= 1
                s.inner -= 1
                s.head.append(t)
            elif t.kind == "{":
                self._open(s)
            elif t.kind == "}":
                self._statement(s)
                if len(self.scopes) == 1:
                    return [self._error(t)]
                self.scopes.pop()
                outer = self.scopes[-1]
                if outer.inner == 0:
                    outer.head = []
            elif t.kind == ";" and s.inner == 0 or t.kind == "," and s.inner == 0 and s.kind in ("struct", "enum") and self.language == "rust":
                self._statement(s)
            else:
                s.head.append(t)
        self._statement(self.scopes[-1])
        return self.out if len(self.scopes) == 1 and self.scopes[0].inner == 0 else [self._error(every[-1])]

    def _lists_names(self, s: Scope) -> bool:
        """Whether a brace lists what is imported or exported."""
        words = [t.text for t in s.head if t.kind != "line"]
        if s.listed or not words:
            return bool(s.listed)
        if self.language == "rust":
            return "use" in words[:2] and words[-1] == "::"
        return self.language in ("typescript", "tsx", "javascript") and words[0] in ("import", "export") and words[-1] in ("import", "export", "type", ",")

    @staticmethod
    def _error(t: Token) -> tuple:
        return ("error", "Unbalanced", t.text[:200], "", t.line)

    def _ends(self, head: list[Token], rest: list[Token]) -> bool:
        """Whether a line ends the statement: not after a sign that wants more, nor before one that goes on."""
        if not head or head[-1].kind in ("=", "=>", ",", ".", "+", "-", "*", "/", "&&", "||", "?", ":", "|", "&", "<", "?.", ":=", "->"):
            return False
        after = next((t for t in rest if t.kind != "line"), None)
        if self.language == "go":
            return True
        return after is None or after.kind not in (".", "?.", "?", ":", "&&", "||", "+", "=", "=>", "{", ",", "|", "&")

    # ---- what stands before a brace or at a statement's end ----

    def _open(self, s: Scope) -> None:
        if s.inner:
            # a body within an expression: a lambda, an object, an initialiser
            self._calls(s.head, s.name, None)
            keep = s.head
            s.head = []
            self.scopes.append(Scope("block", s.name))
            s.head = keep[:0]
            return
        head = self._undecorated(s)
        made = self._declared(head, s, True)
        s.head = []
        self.scopes.append(made or Scope("block" if s.kind != "enum" else "enum", s.name))

    def _statement(self, s: Scope) -> None:
        head = self._undecorated(s)
        s.head = []
        if not head or s.kind == "enum" and not any(t.kind == "(" for t in head[1:]) or s.kind == "enum" and self.language in ("rust", "csharp"):
            return
        made = self._imports(head, s) or self._declared(head, s, False)
        if made is not None and made is not True and made.kind == "namespace" and s.kind == "file":
            s.name = made.name  # of a whole file

    def _undecorated(self, s: Scope) -> list[Token]:
        """The head without attributes and annotations, which wait for the declaration that they stand before."""
        head, i = s.head, 0
        while i < len(head):
            if head[i].kind == "@" and i + 1 < len(head) and head[i + 1].kind == "name" and head[i + 1].text != "interface":
                j = i + 2
                while j + 1 < len(head) and head[j].kind == "." and head[j + 1].kind == "name":
                    j += 2
                if j < len(head) and head[j].kind == "(":
                    j = _closing(head, j) + 1
            elif self.language == "csharp" and head[i].kind == "[" and s.kind != "function":
                j = _closing(head, i) + 1
            elif self.language == "rust" and head[i].kind == "#" and i + 1 < len(head) and head[i + 1].kind in ("[", "!"):
                j = _closing(head, i + 1 + (head[i + 1].kind == "!")) + 1
            else:
                break
            body = head[i + 1 : j] if head[i].kind == "@" else head[i + 1 + (head[i].kind == "#") : j - 1]
            if body:
                name = ""
                for t in body:
                    if t.kind not in ("name", ".", "::"):
                        break
                    name += t.text
                s.decorators.append((name, _spelled(body), body[0].line))
            i = j
        return head[i:]

    def _declare(self, s: Scope, kind: str, name: Token, owner: str | None = None) -> str:
        owner = s.name if owner is None else owner
        qualified = f"{owner}.{name.text}" if owner else name.text
        self.out.append((kind, name.text, qualified, owner, name.line))
        self.out += [("decorator", d, spelled, qualified, line) for d, spelled, line in s.decorators]
        s.decorators = []
        return qualified

    def _imports(self, head: list[Token], s: Scope) -> bool | None:
        word, strings = head[0].text, [t for t in head if t.kind == "string"]
        if s.kind != "file":
            return None
        found: list[tuple[str, int]] = []
        if self.language in ("typescript", "tsx", "javascript") and word in ("import", "export") and strings and (word == "import" or any(t.text == "from" for t in head)):
            found = [(strings[-1].text[1:-1], strings[-1].line)]
        elif self.language == "go" and word == "import":
            found = [(t.text[1:-1], t.line) for t in strings]
        elif self.language in ("java", "csharp", "rust") and word in ("import", "using", "use") or word == "pub" and len(head) > 1 and head[1].text == "use":
            body = [t for t in head if t.text not in ("import", "using", "use", "static", "pub", "global")]
            if any(t.kind in ("(", "=") and self.language == "csharp" for t in body):
                body = body[next((i + 1 for i, t in enumerate(body) if t.kind == "="), 0) :]
            path, parts, on = "", [], True
            for t in body:
                if t.kind == "{":
                    parts.append(path)
                    path = ""
                elif t.kind in (",", "}"):
                    found += [("".join([*parts, path]), t.line)] if path else []
                    path, on = "", True
                    parts = parts[:-1] if t.kind == "}" else parts
                elif t.kind not in ("name", ".", "::", "*") or t.text == "as":
                    on = False
                elif on:
                    path += t.text
            found += [("".join([*parts, path]).rstrip(":."), body[0].line)] if path else []
        else:
            return None
        self.out += [("import", name, name, s.name, line) for name, line in found]
        return True

    def _declared(self, head: list[Token], s: Scope, opens: bool) -> Scope | None:
        if not head:
            return None
        if self.language == "go" and head[0].text == "package" or self.language == "java" and head[0].text == "package":
            name = "".join(t.text for t in head[1:] if t.kind in ("name", "."))
            self.out.append(("namespace", name.rsplit(".", 1)[-1], name, "", head[0].line))
            return Scope("namespace", name)
        return self._type(head, s, opens) or self._function(head, s, opens) or self._fields(head, s, opens)

    def _type(self, head: list[Token], s: Scope, opens: bool) -> Scope | None:
        depth = 0
        for i, t in enumerate(head):
            depth += (t.kind in "([<") - (t.kind in ")]>")
            if t.kind in ("(", "=", "=>", "string") and not (self.language == "rust" and i and head[i - 1].text == "pub"):
                return None
            if t.kind != "name" or depth or i + 1 >= len(head):
                continue
            if self.language == "go":
                if t.text == "type" and len(head) > i + 2 and head[-1].text in ("struct", "interface"):
                    kind = TYPES[head[-1].text]
                    return Scope(kind, self._declare(s, kind, head[i + 1])) if opens else None
                continue
            if t.text not in TYPES or (head[i + 1].kind != "name" and t.text != "impl"):
                continue
            kind = TYPES[t.text]
            if kind == "impl":
                return self._impl(head[i + 1 :], s)
            if t.text == "record" and head[i + 1].text in ("class", "struct"):
                i += 1
            if i + 1 >= len(head) or head[i + 1].kind != "name":
                return None
            name = head[i + 1]
            if kind == "namespace":
                j = i + 1
                while j + 2 < len(head) and head[j + 1].kind in (".", "::"):
                    j += 2
                name = Token("name", "".join(x.text for x in head[i + 1 : j + 1]).replace("::", "."), name.line)
            qualified = self._declare(s, kind, name)
            self._bases(head[i + 2 :], qualified)
            return Scope(kind, qualified)
        return None

    def _impl(self, rest: list[Token], s: Scope) -> Scope:
        names, depth, word = [[]], 0, None
        for t in rest:
            depth += (t.kind == "<") - (t.kind == ">")
            if t.text == "where":
                break
            if t.text == "for" and depth == 0:
                word = True
                names.append([])
            elif depth == 0 and t.kind == "name" and t.text not in ("dyn", "mut", "unsafe", "const"):
                names[-1].append(t)
        owner = names[-1][-1].text if names[-1] else ""
        qualified = f"{s.name}.{owner}" if s.name else owner
        if word and names[0]:
            self.out.append(("base", names[0][-1].text, names[0][-1].text, qualified, names[0][-1].line))
        s.decorators = []
        return Scope("impl", qualified)

    def _bases(self, rest: list[Token], owner: str) -> None:
        """Names after a colon, extends or implements, apart from their type arguments."""
        depth, on, path, line = 0, False, "", 0
        for t in [*rest, Token(",", ",", 0)]:
            depth += (t.kind in "<([") - (t.kind in ">)]")
            if depth == 0 and (t.kind in (",", ":", "+", "where") or t.text in ("extends", "implements", "where", "permits")):
                if on and path:
                    self.out.append(("base", path, path, owner, line))
                on, path = (t.text not in ("where", "permits")) and (on or t.kind == ":" or t.text in ("extends", "implements")), ""
            elif depth == 0 and on and t.kind in ("name", ".", "::"):
                line = line if path else t.line
                path += t.text

    def _name_before(self, head: list[Token], i: int) -> int | None:
        """The place of the name that stands before the parenthesis at i, type arguments between them left out."""
        j = i - 1
        if j >= 0 and head[j].kind == ">":
            depth = 0
            while j >= 0:
                depth += (head[j].kind == ">") - (head[j].kind == "<")
                if depth == 0:
                    break
                j -= 1
            j -= 1
        return j if j >= 0 and head[j].kind == "name" else None

    def _function(self, head: list[Token], s: Scope, opens: bool) -> Scope | None:
        texts = [t.text for t in head]
        holder = s.kind in ("class", "interface", "struct", "enum", "impl")
        if self.language in ("typescript", "tsx", "javascript") and texts[0] in ("const", "let", "var", "export", "default") and "=>" in texts and opens:
            k = next((i for i, t in enumerate(head) if t.text in ("const", "let", "var")), None)
            if k is not None and k + 2 < len(head) and head[k + 1].kind == "name":
                q = self._declare(s, "function", head[k + 1])
                self._calls(head[k + 2 :], q, None)
                return Scope("function", q)
        if self.language == "go" and texts[0] == "func" and len(head) > 2:
            owner, i = None, 1
            if head[1].kind == "(":
                end = _closing(head, 1)
                receiver = [t.text for t in head[2:end] if t.kind == "name"]
                base = receiver[1] if len(receiver) > 1 else receiver[0] if receiver else ""
                owner, i = (f"{s.name}.{base}" if s.name else base), end + 1
            if i < len(head) and head[i].kind == "name":
                q = self._declare(s, "method" if owner else "function", head[i], owner)
                return Scope("function", q) if opens else None
        for i, t in enumerate(head):
            if t.kind in ("=", ":="):
                break
            if t.kind != "(":
                continue
            j = self._name_before(head, i)
            if j is None:
                return None if not (self.language == "rust" and i and head[i - 1].text == "pub") else self._rust_fn(head, s, opens)
            before = texts[:j]
            if texts[j] in self.words or j and head[j - 1].kind in (".", "?.", "::", "!") or {"return", "new", "throw", "await"} & {*before}:
                return None
            if self.language == "rust":
                return self._rust_fn(head, s, opens)
            if self.language == "go":
                declares = s.kind == "interface" and j == 0
            elif self.language in ("typescript", "tsx", "javascript"):
                declares = "function" in before or holder and all(x in ("public", "private", "protected", "static", "async", "abstract", "override", "readonly", "get", "set", "*", "declare") for x in before)
            else:
                declares = holder and (opens or "=>" in texts or s.kind == "interface" or "abstract" in before or "extern" in before or "partial" in before or "native" in before) or opens and any(x.kind == "name" and x.text not in ("else",) for x in head[:j])
                if holder and not before and "=>" not in texts and not opens:
                    declares = False
            if not declares:
                return None
            q = self._declare(s, "method" if holder else "function", head[j])
            self._calls(head[i + 1 :], q, None)
            return Scope("function", q)
        return None

    def _rust_fn(self, head: list[Token], s: Scope, opens: bool) -> Scope | None:
        k = next((i for i, t in enumerate(head) if t.text == "fn"), None)
        if k is None or k + 1 >= len(head) or head[k + 1].kind != "name":
            return None
        return Scope("function", self._declare(s, "method" if s.kind in ("impl", "interface") else "function", head[k + 1]))

    def _fields(self, head: list[Token], s: Scope, opens: bool) -> Scope | None:
        made = None
        if s.kind in ("class", "struct", "interface") and (s.kind != "interface" or opens):
            depth, cut = 0, len(head)
            for i, t in enumerate(head):
                depth += (t.kind in "([<") - (t.kind in ")]>")
                if depth == 0 and (t.kind in ("=", "=>") or t.kind == ":" and self.language not in ("csharp", "java")):
                    cut = i
                    break
            names = [i for i in range(cut) if head[i].kind == "name"]
            if self.language == "go":
                if not opens and len(head) > 1 and head[0].kind == head[1].kind == "name" or len(head) > 1 and head[0].kind == "name" and head[1].kind in ("*", "[", "("):
                    self._declare(s, "field", head[0])
            elif names and (len(names) > 1 or self.language not in ("csharp", "java")) and not any(t.kind == "(" for t in head[:cut]):
                q = self._declare(s, "property" if opens and self.language == "csharp" and cut == len(head) else "field", head[names[-1]])
                made = Scope("block", q) if opens else None
                self._calls(head[cut:], q, None)
                return made
        self._calls(head, s.name, None)
        s.decorators = []
        return made

    def _calls(self, head: list[Token], owner: str, skip: int | None) -> None:
        for i, t in enumerate(head):
            if t.kind != "(" or i == skip:
                continue
            j = self._name_before(head, i)
            if j is None and i > 1 and head[i - 1].kind == "!" and head[i - 2].kind == "name":
                j = i - 2
            # what follows a dot is a member's name in JavaScript, whatever it says
            if j is None or head[j].text in self.words and not (self.language in _MEMBERS and j and head[j - 1].kind in (".", "?.")):
                continue
            path = head[j].text
            k = j
            while k >= 2 and head[k - 1].kind in (".", "::", "?.") and head[k - 2].kind == "name":
                path = head[k - 2].text + ("::" if head[k - 1].kind == "::" else ".") + path
                k -= 2
            self.out.append(("call", head[j].text, path, owner, head[j].line))


def _closing(head: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i; the last token without one."""
    depth = 0
    for j in range(i, len(head)):
        depth += (head[j].kind in "([") - (head[j].kind in ")]")
        if depth == 0:
            return j
    return len(head) - 1


def _spelled(body: list[Token]) -> str:
    out = ""
    for t in body:
        out += (" " if out and t.kind == "name" and (out[-1].isalnum() or out[-1] in ",") else "") + t.text
    return out


def facts(body: str, language: str) -> list[tuple]:
    found = Reader(language).read(body)
    if language != "rust" or "r#" not in body:
        return found
    # once told from keywords, raw identifiers are names as any other
    return [(kind, _RAW.sub("", name), spelled if kind == "decorator" else _RAW.sub("", spelled), _RAW.sub("", owner), line) for kind, name, spelled, owner, line in found]

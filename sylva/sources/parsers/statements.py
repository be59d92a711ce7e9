"""Statements inside bodies: where each begins and ends, its condition, its branches and its clauses.

Works on text whose literals and comments are blanked out and whose brackets are paired. Every statement
is an interval with wrappers for its parts; the caller nests them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Grammar:
    """What a language calls its statements, by keyword; a keyword without a name gives no element."""

    #: Statements with a head and a body.
    blocks: dict
    #: Statements that run to their end mark.
    plain: dict
    #: Clauses that follow a body.
    clauses: dict
    #: Heads stand in round brackets.
    brackets: bool = True
    #: A line end ends a statement where no bracket is open.
    lines: bool = False
    #: Name of a clause for else; without one its body is the alternative itself.
    otherwise: str | None = "else"
    #: Name of a body in braces.
    block: str = "block"
    #: Branches of a choice: name, whether they look like pattern => value.
    cases: tuple[str, str] | None = None
    arms: str | None = None


def _words(text: str) -> dict:
    """keyword or keyword=name, parted by spaces."""
    return {k: name or k for k, _, name in (w.partition("=") for w in text.split())}


#: Element names of statements (fixed values).
GRAMMARS = {
    "csharp": Grammar(
        _words("if for foreach while using lock=lock_statement do=do_statement switch=switch_statement try fixed=fixed_statement checked=checked_statement unsafe=unsafe_statement"),
        _words("return throw break=break_statement continue=continue_statement goto=goto_statement yield=yield_statement"), _words("catch finally=finally_clause"), cases=("switch_section", "switch_section"),
    ),
    "java": Grammar(
        _words("if for while do=do_statement switch try synchronized=synchronized_statement"), _words("return throw break=break_statement continue=continue_statement yield=yield_statement assert=assert_statement"),
        _words("catch finally"), otherwise=None, cases=("case", "case"),
    ),
    "javascript": Grammar(
        _words("if for while do=do_statement switch=switch_statement try with=with_statement"), _words("return throw break=break_statement continue=continue_statement"), _words("catch finally=finally_clause"),
        lines=True, cases=("switch_case", "switch_default"),
    ),
    "rust": Grammar(_words("if for while loop match unsafe=unsafe_block"), _words("return break=break_expression continue=continue_expression"), {}, brackets=False, arms="arm"),
    "go": Grammar(_words("if for switch select"), _words("return defer go break=break_statement continue=continue_statement goto=goto_statement fallthrough=fallthrough_statement"), {}, brackets=False, lines=True, otherwise=None, cases=("case", "default")),
    "cpp": Grammar(
        _words("if=if_statement for=for_statement while=while_statement do=do_statement switch=switch_statement try=try_statement"),
        _words("return=return_statement throw=throw_statement break=break_statement continue=continue_statement goto=goto_statement"), _words("catch=catch_clause"), otherwise="else_clause", block="compound_statement", cases=("case_statement", "case_statement"),
    ),
    "php": Grammar(
        _words("if=if_statement for=for_statement foreach=foreach_statement while=while_statement do=do_statement switch=switch_statement try=try_statement"),
        _words("return=return_statement break=break_statement continue=continue_statement echo=echo_statement"), _words("catch=catch_clause finally=finally_clause"), otherwise="else_clause", block="compound_statement", cases=("case_statement", "default_statement"),
    ),
}
GRAMMARS |= {"typescript": GRAMMARS["javascript"], "tsx": GRAMMARS["javascript"], "c": GRAMMARS["cpp"]}
#: Ruby's statements that end with the word end (fixed values).
RUBY = _words("class module def if unless case while until for begin do=")
_OPENS, _CLOSES = "([{", ")]}"


class Code(str):
    """Blanked text that knows where each bracket closes."""

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.close = {}
        open_: dict[str, list[int]] = {c: [] for c in _OPENS}
        for m in re.finditer(r"[(\[{)\]}]", text):
            if m[0] in _OPENS:
                open_[m[0]].append(m.start())
            elif mine := open_[_OPENS[_CLOSES.index(m[0])]]:
                self.close[mine.pop()] = m.end()
        self.open = {end: start for start, end in self.close.items()}
        return self

    def lists_before(self, at: int) -> int:
        """Where the square brackets begin that stand right before a place, one after the other."""
        while True:
            k = at
            while k and self[k - 1].isspace():
                k -= 1
            if not k or self[k - 1] != "]" or k not in self.open:
                return at
            at = self.open[k]

    def after(self, at: int) -> int:
        """Where the bracket at a place is closed, behind it."""
        return self.close.get(at, len(self))


class Statements:
    """Finds the statements of a text; put(name, start, end) takes each interval."""

    def __init__(self, code: Code, grammar: Grammar, put: Callable[[str, int, int], None]):
        self.code, self.grammar, self.put = code, grammar, put
        words = [*grammar.blocks, *grammar.plain, *grammar.clauses, "else", "case", "default"]
        self.word = re.compile(rf"(?<![\w.$@#-])(?:{'|'.join(sorted(words, key=len, reverse=True))})\b(?!\s*(?::(?!:)|=(?!=|>)|\?))")
        self.ends: dict[int, int] = {}

    def run(self) -> None:
        for m in self.word.finditer(self.code):
            if m.start() not in self.ends and (m[0] in self.grammar.blocks or m[0] in self.grammar.plain):
                self.statement(m.start())

    def blank(self, at: int) -> int:
        m = re.compile(r"\s+").match(self.code, at)
        return m.end() if m else at

    def plain_end(self, at: int, lines: bool) -> int:
        """The end of a simple statement: its mark, the line or the bracket around it."""
        scan = re.compile(r"[(\[{)\]};\n]")
        while m := scan.search(self.code, at):
            if m[0] in _OPENS:
                at = self.code.after(m.start())
            elif m[0] == ";":
                return m.end()
            elif m[0] != "\n":
                return m.start()
            elif lines and not re.match(r"\s*(?:[.?:+*/%&|=,]|-(?!-))", self.code[m.end() : m.end() + 80]) and not re.search(r"[-.?:+*/%&|=,({\[]\s*$", self.code[max(0, m.start() - 40) : m.start()]):
                return m.start()
            else:
                at = m.end()
        return len(self.code)

    def body(self, at: int, wrapper: str | None) -> int:
        """The end of the statement that is a body; puts its wrapper and block."""
        at = self.blank(at)
        if self.code.startswith("{", at):
            end = self.code.after(at)
            if wrapper:
                self.put(wrapper, at, end)
            self.put(self.grammar.block, at, end)
            return end
        end = self.statement(at)
        if wrapper and end > at:
            self.put(wrapper, at, end)
        return end

    def statement(self, at: int) -> int:
        """The end of the statement at a place; keyword statements are put."""
        if at in self.ends:
            return self.ends[at]
        m = self.word.match(self.code, at)
        g = self.grammar
        if m and m[0] in g.plain:
            end = self.plain_end(m.end(), g.lines)
            self.put(g.plain[m[0]], at, end)
        elif m and m[0] in g.blocks:
            end = self.compound(m)
        elif self.code.startswith("{", at):
            end = self.code.after(at)
        else:
            end = self.plain_end(at, g.lines)
        self.ends[at] = end
        return end

    def compound(self, m: re.Match) -> int:
        g, code, word, start = self.grammar, self.code, m[0], m.start()
        at = self.blank(m.end())
        name = g.blocks[word]
        head = None
        if g.brackets:
            if word == "for" and code.startswith("await", at):
                at = self.blank(at + 5)
            if code.startswith("(", at):
                head = (at + 1, code.after(at) - 1)
                at = code.after(at)
        elif word not in ("loop", "unsafe"):
            opened = self.brace(at)
            if opened is None:
                return at
            head, at = (at, len(code[:opened].rstrip())), opened
            if g.arms and "=>" in code[slice(*head)]:
                return at  # the guard of an arm
        if word == "using" and head is None:
            return self.plain_end(at, False)  # a directive or a declaration
        if word in ("unsafe", "checked", "fixed", "try", "do", "loop") and head is None and not code.startswith("{", self.blank(at)) and word != "do":
            return at
        if word == "for" and head and not g.brackets and code[head[0] : head[1]] == "":
            head = None
        if name == "for" and g.otherwise is None and g.brackets and head and re.match(r"[^;]*\w\s*:\s*[^;]+$", code[head[0] : head[1]]):
            name = "foreach"
        if head and head[1] > head[0] and word in ("if", "while", "switch", "match"):
            self.put("condition" if word != "match" else "value", *head)
        end = self.body(at, "consequence" if word == "if" else "body")
        if word in ("switch", "match", "select"):
            self.branches(self.blank(at), end)
        end = self.tail(word, end)
        self.put(name, start, end)
        return end

    def tail(self, word: str, end: int) -> int:
        """What follows a body and belongs to its statement."""
        g, code = self.grammar, self.code
        while True:
            at = self.blank(end)
            m = re.compile(r"(?:else|while|" + "|".join([*g.clauses, "\x00"]) + r")\b").match(code, at)
            if m and m[0] == "else" and word == "if":
                stop = self.body(m.end(), None if g.otherwise else "alternative")
                if g.otherwise:
                    self.put("alternative", at, stop)
                    self.put(g.otherwise, at, stop)
                return stop
            if m and m[0] == "while" and word == "do":
                inner = self.blank(m.end())
                if code.startswith("(", inner):
                    self.put("condition", inner + 1, code.after(inner) - 1)
                    stop = self.blank(code.after(inner))
                    self.ends[at] = stop
                    return stop + code.startswith(";", stop)
                return end
            if not m or word != "try" or m[0] not in g.clauses:
                return end
            inner = self.blank(m.end())
            if code.startswith("(", inner):
                inner = code.after(inner)
            if w := re.compile(r"\s*when\s*(?=\()").match(code, inner):
                inner = code.after(w.end())
            stop = self.body(inner, "body")
            self.put(g.clauses[m[0]], at, stop)
            end = stop

    def brace(self, at: int) -> int | None:
        """The brace that opens a body after a head without brackets of its own."""
        for m in re.compile(r"[(\[{;}]").finditer(self.code, at):
            if m.start() < at:
                continue
            if m[0] == "{":
                return m.start()
            if m[0] == "}" or (m[0] == ";" and not self.grammar.lines):
                return None
            if m[0] != ";":
                at = self.code.after(m.start())
        return None

    def branches(self, start: int, end: int) -> None:
        """The cases or arms of a choice."""
        g, code = self.grammar, self.code
        if g.cases:
            marks = [m.start() for m in self.top(r"\b(?:case|default)\b(?!\s*\()", start + 1, end - 1)]
            for a, b in zip(marks, [*marks[1:], end - 1][: len(marks)], strict=True):
                self.put(g.cases[code.startswith("default", a)], a, len(code[:b].rstrip()))
        if g.arms:
            at = start + 1
            for m in self.top(r"=>", start + 1, end - 1):
                if m.start() < at:
                    continue
                begin, value = self.blank(at), self.blank(m.end())
                stop = code.after(value) if code.startswith("{", value) else next((c.start() for c in self.top(",", value, end - 1)), end - 1)
                self.put(g.arms, begin, len(code[:stop].rstrip()))
                at = stop + 1 if code.startswith(",", self.blank(stop)) and self.blank(stop) == stop else stop
                if code.startswith(",", self.blank(at)):
                    at = self.blank(at) + 1

    def top(self, pattern: str, start: int, end: int) -> Iterator[re.Match]:
        """Matches outside of inner brackets."""
        scan = re.compile(rf"[(\[{{]|{pattern}")
        at = start
        while (m := scan.search(self.code, at, end)) is not None:
            if m[0] in _OPENS:
                at = self.code.after(m.start())
            else:
                yield m
                at = m.end()


def ruby_blocks(code: str) -> list[tuple[str, int, int]]:
    """keyword, start and end of everything that the word end closes, with the words after a statement's value left out."""
    out, open_ = [], []
    for m in re.finditer(r"(?<![\w.:@$])(?:class|module|def|if|unless|case|while|until|for|begin|do|end)\b(?![?!:]|\s*=[^=])", code):
        word = m[0]
        if word == "end":
            if open_:
                kind, start = open_.pop()
                out.append((kind, start, m.end()))
            continue
        before = code[code.rfind("\n", 0, m.start()) + 1 : m.start()].rpartition(";")[2]
        if word in ("if", "unless", "while", "until") and before.strip() and not re.search(r"(?:=|\bthen|\bdo|\belse|[({\[,|&])\s*$", before):
            continue  # a condition after its statement
        if word == "do" and re.search(r"(?<![\w.])(?:while|until|for)\b", before):
            continue
        open_.append((word, m.start()))
    return out

"""A tokenizer for shell command lines: simple commands at top level, dequoted, or nothing where the text is broken."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import patterns as P

#: Words that begin what is not entered: loops, conditionals, groups, functions.
COMPOUND = {"if", "for", "while", "until", "case", "select", "function", "{", "[["}
CLOSERS = {"if": "fi", "for": "done", "while": "done", "until": "done", "select": "done", "case": "esac", "{": "}", "[[": "]]"}
ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\+?=")
UPPER_ASSIGNMENT = re.compile(r"[A-Z_][A-Z0-9_]*=")


class BrokenCommand(ValueError):
    """A quote, substitution or group that does not end."""


@dataclass
class _Reader:
    text: str
    at: int = 0
    heredocs: list[tuple[str, bool]] = field(default_factory=list)

    def until_close(self, opened: str, closing: str) -> None:
        """Skip a bracketed stretch, quotes and brackets inside it included."""
        depth = 1
        while self.at < len(self.text):
            ch = self.text[self.at]
            if ch == "\\":
                self.at += 2
                continue
            if ch in "'\"`":
                self.quoted(ch)
                continue
            self.at += 1
            depth += (ch == opened) - (ch == closing)
            if not depth:
                return
        raise BrokenCommand(opened)

    def quoted(self, quote: str) -> str:
        """The content of a quoted stretch; substitutions inside double quotes are kept as written."""
        self.at += 1
        out: list[str] = []
        while self.at < len(self.text):
            ch = self.text[self.at]
            if ch == quote:
                self.at += 1
                return "".join(out)
            if ch == "\\" and quote != "'" and self.at + 1 < len(self.text):
                following = self.text[self.at + 1]
                out.append("" if following == "\n" else following if following in '"\\$`' else ch + following)
                self.at += 2
                continue
            if quote == '"' and self.text.startswith("$(", self.at):
                start = self.at
                self.at += 2
                self.until_close("(", ")")
                out.append(self.text[start : self.at])
                continue
            out.append(ch)
            self.at += 1
        raise BrokenCommand(quote)

    def word(self) -> str:
        out: list[str] = []
        while self.at < len(self.text):
            ch = self.text[self.at]
            if ch in " \t\r\n;&|()<>":
                break
            if ch == "\\":
                if self.at + 1 >= len(self.text):
                    raise BrokenCommand("\\")
                out.append("" if self.text[self.at + 1] == "\n" else self.text[self.at + 1])
                self.at += 2
            elif ch in "'\"":
                out.append(self.quoted(ch))
            elif ch == "`":
                start = self.at
                self.quoted("`")
                out.append(self.text[start : self.at])
            elif ch == "$" and self.text[self.at + 1 : self.at + 2] in ("(", "{"):
                start, opened = self.at, self.text[self.at + 1]
                self.at += 2
                self.until_close(opened, ")" if opened == "(" else "}")
                out.append(self.text[start : self.at])
            else:
                out.append(ch)
                self.at += 1
        return "".join(out)

    def bodies(self) -> None:
        """After a line's end: the here-documents that the line announced."""
        for mark, tabs in self.heredocs:
            while True:
                if self.at >= len(self.text):
                    raise BrokenCommand("<<")
                end = self.text.find("\n", self.at)
                line = self.text[self.at : end if end >= 0 else len(self.text)]
                self.at = end + 1 if end >= 0 else len(self.text)
                if (line.lstrip("\t") if tabs else line) == mark:
                    break
        self.heredocs.clear()


def commands(text: str) -> list[list[str]] | None:
    """The argument lists of the simple commands that text runs at top level, joined by ``&& || ; | &`` or newlines.

    Subshells, groups, loops, conditionals and functions are skipped as wholes; redirections are dropped; leading
    assignments are kept as words. None where the text cannot be parsed."""
    reader, found, words, closing = _Reader(text), [], [], []

    def flush() -> None:
        if words and not closing:
            found.append(list(words))
        words.clear()

    try:
        while reader.at < len(reader.text):
            ch = reader.text[reader.at]
            if ch in " \t\r":
                reader.at += 1
            elif ch == "\\" and reader.text[reader.at + 1 : reader.at + 2] == "\n":
                reader.at += 2
            elif ch == "#":
                while reader.at < len(reader.text) and reader.text[reader.at] != "\n":
                    reader.at += 1
            elif ch == "\n":
                flush()
                reader.at += 1
                reader.bodies()
            elif ch in ";&|":
                flush()
                reader.at += 2 if reader.text[reader.at : reader.at + 2] in ("&&", "||", ";;", "|&") else 1
            elif ch in "<>":
                run = re.compile(r"<<<|<<-|<<|>>|[<>]&|<>|>\||[<>]\(|[<>]").match(reader.text, reader.at)
                reader.at = run.end()
                if run[0].endswith("("):
                    reader.until_close("(", ")")
                    continue
                if words and words[-1].isdigit() and reader.text[run.start() - 1].isdigit():
                    words.pop()
                while reader.text[reader.at : reader.at + 1] in (" ", "\t"):
                    reader.at += 1
                target = reader.word()
                if run[0] in ("<<", "<<-"):
                    reader.heredocs.append((target, run[0] == "<<-"))
            elif ch == "(":
                if words:
                    # name() { … } declares a function: what follows is its body.
                    words.clear()
                reader.at += 1
                reader.until_close("(", ")")
                if reader.text[reader.at - 2 : reader.at] == "()":
                    words.clear()
            elif ch == ")":
                raise BrokenCommand(")")
            else:
                start = reader.at
                word = reader.word()
                plain = reader.text[start : reader.at] == word
                if closing and plain and word == closing[-1]:
                    closing.pop()
                    words.clear()
                elif plain and not words and word in COMPOUND:
                    closing.append(CLOSERS.get(word, "}"))
                else:
                    words.append(word)
        if reader.heredocs:
            raise BrokenCommand("<<")
        flush()
    except BrokenCommand:
        return None
    return None if closing else found


def arguments(words: list[str]) -> list[str]:
    """A command's words without the assignments before it."""
    at = 0
    while at < len(words) and ASSIGNMENT.match(words[at]):
        at += 1
    return words[at:]


def head(text: str | None) -> str | None:
    """The program that a command line runs first: past assignments, wrappers and their flags, without its folder."""
    parsed = commands(text) if text else None
    for words in parsed or ():
        for word in words:
            if UPPER_ASSIGNMENT.match(word) or word in P.SHELL_WRAPPERS or word.startswith("-"):
                continue
            return word.rstrip("/").rpartition("/")[2] or word
        return None
    return None


def git_operations(text: str | None) -> list[dict]:
    """op, branch and hash of every git command that a command line runs at top level."""
    out = []
    for words in (commands(text) if text else None) or ():
        args = arguments(words)
        if not args or args[0].rpartition("/")[2] != "git":
            continue
        rest, at = args[1:], 0
        while at < len(rest) and rest[at].startswith("-"):
            at += 2 if rest[at] in ("-C", "-c") else 1
        if at >= len(rest):
            continue
        op = P.GIT_ALIASES.get(rest[at], rest[at])
        if op not in P.GIT_SUBCOMMANDS:
            continue
        plain = [w for w in rest[at + 1 :] if not w.startswith("-")]
        branch = plain[0] if op in ("checkout", "switch", "branch") and plain else None
        commit = next((w for w in plain if re.fullmatch(r"[0-9a-f]{7,40}", w)), None) if op in ("show", "cherry-pick", "log") else None
        out.append({"op": op, "branch": branch, "commit": commit})
    return out


def command_head(text: Column) -> Column:
    def heads(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(head)

    return F.pandas_udf(heads, "string")(text)


def git_column(text: Column) -> Column:
    def operations(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(git_operations)

    return F.pandas_udf(operations, "array<struct<op: string, branch: string, commit: string>>")(text)

"""References in prose (P12, C0, cluster-3) replaced by labels.

The prose is split into pieces: words, blanks, line ends, and single marks. What a piece is follows from its neighbours, so
one walk over the pieces finds the references, a second gathers those that stand together, and a third writes the pieces
back, leaving out the marks that a removed reference would leave behind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Nouns before which P3 or C4 names a machine or a collection of data; the longest range that is spelled out.
NOUNS = {"GPU", "GPUs", "instance", "instances", "node", "nodes", "dataset", "datasets", "corpus", "corpora", "benchmark", "benchmarks"}
LONGEST_RANGE = 30
_PIECE = re.compile(r"\n|[^\S\n]+|\w+|.", re.S)
_DASHES, _OPEN, _SHUT, _LIST, _STOPS = set("-–—"), set("(["), set(")]"), set(",;"), set(".!?")


@dataclass
class Ref:
    first: int  # of its pieces
    last: int
    kind: str
    number: int
    spelled: bool  # written as cluster-3


def _blank(piece: str) -> bool:
    return piece.isspace()


def _find(pieces: list[str]) -> list[Ref]:
    at = lambda i: pieces[i] if 0 <= i < len(pieces) else ""
    short = lambda w: w[:1] in ("P", "C") and w[1:].isdecimal()
    out = []
    for i, word in enumerate(pieces):
        last, spelled = i, False
        if word in ("cluster", "Cluster") and at(i + 1) == "-" and at(i + 2).isdecimal():
            last, spelled = i + 2, True
        elif not short(word):
            continue
        if at(i - 1) == ".":
            continue
        mark, after = at(last + 1), at(last + 2)
        if (mark == "." and after[:1].isdecimal()) or (mark == "-" and after[:1].isascii() and after[:1].isalpha() and not (after[0] in "PC" and after[1:2].isdecimal())):
            continue
        k = last + 1
        while _blank(at(k)):
            k += 1
        if k > last + 1 and at(k) in NOUNS:
            continue
        out.append(Ref(i, last, "C" if spelled else word[0], int(at(last) if spelled else word[1:]), spelled))
    return out


def _joined(between: list[str]) -> bool:
    """Whether the pieces between two references make them one list or range."""
    words = [p.lower() for p in between if not _blank(p)]
    spaced = bool(between) and _blank(between[-1])
    if not words:
        return True
    if words[0] == "," and words[1:] in (["and"], ["&"]):
        return words[1] == "&" or spaced
    return len(words) == 1 and (words[0] in {",", ";", "/", "&"} | _DASHES or (words[0] == "and" and spaced))


def _runs(pieces: list[str], refs: list[Ref]) -> list[list[Ref]]:
    runs: list[list[Ref]] = []
    for ref in refs:
        if runs and _joined(pieces[runs[-1][-1].last + 1 : ref.first]):
            runs[-1].append(ref)
        else:
            runs.append([ref])
    return runs


def _next_mark(pieces: list[str], i: int, step: int) -> str:
    """The nearest piece from ``i`` on that is no blank."""
    while 0 <= i < len(pieces) and _blank(pieces[i]):
        i += step
    return pieces[i] if 0 <= i < len(pieces) else ""


def _bracketed(pieces: list[str], run: list[Ref]) -> bool:
    brackets = _OPEN | _SHUT
    before = next((p for p in reversed(pieces[: run[0].first]) if p in brackets), "")
    after = next((p for p in pieces[run[-1].last + 1 :] if p in brackets), "")
    return before in _OPEN and after in _SHUT


def _meant(pieces: list[str], run: list[Ref], refs: list[Ref], papers: dict[int, str], document_refs: int) -> bool:
    """Whether a run is surely a reference: a list, in brackets, possessive, or in company."""
    ref, end = run[0], run[-1].last
    owns = "".join(pieces[end + 1 : end + 2]) in ("'", "’") and pieces[end + 2 : end + 3] == ["s"]
    if len(run) > 1 or document_refs >= 2 or owns or _bracketed(pieces, run):
        return True
    if ref.kind == "C":
        return ref.spelled or _next_mark(pieces, ref.first - 1, -1).lower() == "cluster"
    return any(o is not ref and o.kind == "P" and o.number in papers for o in refs)


def _labels(pieces: list[str], run: list[Ref], label) -> list[str]:
    names = []
    for ref, after in zip(run, [*run[1:], None], strict=True):
        stop = ref.number + 1
        if after and after.kind == ref.kind and ref.number < after.number <= ref.number + LONGEST_RANGE:
            between = [p for p in pieces[ref.last + 1 : after.first] if not _blank(p)]
            stop = after.number if len(between) == 1 and between[0] in _DASHES else stop
        names += [label(ref.kind, n) for n in range(ref.number, stop)]
    return list(dict.fromkeys(n for n in names if n))


def _said(names: list[str], in_brackets: bool) -> str:
    if in_brackets:
        return "; ".join(names)
    head, last = names[:-1], names[-1]
    return last if not head else f"{head[0]} and {last}" if len(head) == 1 else f"{', '.join(head)}, and {last}"


def _written(pieces: list[str]) -> str:
    """Pieces as text: one blank at most, none at line ends or before marks, no empty brackets, no doubled commas."""
    out: list[str] = []

    def strip(kinds) -> None:
        while out and (out[-1] == " " or out[-1] in kinds):
            out.pop()

    for p in pieces:
        top = out[-1] if out else ""
        if p == "":
            continue
        if p == "\n":
            strip(())
            out.append(p)
        elif _blank(p):
            if top and top not in _OPEN and top not in (" ", "\n"):
                out.append(" ")
            elif top == "\n":
                out.append(p)
        elif p in _SHUT:
            strip(_LIST)
            if out and out[-1] in _OPEN:
                out.pop()
                strip(())
            else:
                out.append(p)
        elif p in _LIST:
            strip(())
            if out and out[-1] not in _OPEN and out[-1] not in _LIST:
                out.append(p)
        elif p in _STOPS or p == ":":
            strip(_LIST if p != ":" else ())
            if out or p != ":":
                out.append(p)
        else:
            out.append(p)
    strip(())
    return "".join(out).lstrip()


def known_refs(prose: str | None, papers: dict[int, str], clusters: dict[int, str]) -> int:
    """How many references in the prose have a label."""
    return sum(r.number in (papers if r.kind == "P" else clusters) for r in _find(_PIECE.findall(prose or "")))


def rewrite_refs(prose: str | None, papers: dict[int, str], clusters: dict[int, str], document_refs: int = 0) -> str | None:
    """Replace references by labels where they surely are references; applying it again changes nothing.

    A lone reference in brackets that has no label is removed; a lone one in plain prose stays, unless the document holds
    ``document_refs`` of two or more.
    """
    if not prose or not (papers or clusters):
        return prose
    pieces = _PIECE.findall(prose)
    refs = _find(pieces)
    label = lambda kind, n: (papers if kind == "P" else clusters).get(n)
    out = list(pieces)
    changed = False
    for run in _runs(pieces, refs):
        first, last = run[0].first, run[-1].last
        opened = _next_mark(pieces, first - 1, -1) in _OPEN
        enclosed = opened and _next_mark(pieces, last + 1, 1) in _SHUT
        names = _labels(pieces, run, label)
        if not (names or enclosed) or not _meant(pieces, run, refs, papers, document_refs):
            continue
        changed = True
        out[first : last + 1] = [_said(names, opened) if names else "", *[""] * (last - first)]
        if not names:
            _capitalise(pieces, out, first, last)
    if not changed:
        return prose
    done = _written(out)
    return done[:1].upper() + done[1:] if done[:1].islower() and not prose.lstrip()[:1].islower() else done


def _capitalise(pieces: list[str], out: list[str], first: int, last: int) -> None:
    """What follows a removed reference at the begin of a sentence begins it."""
    before = [p for p in pieces[:first] if not _blank(p)]
    if before and before[-1] in _OPEN:
        before.pop()
    if before and before[-1] not in _STOPS:
        return
    for i in range(last + 1, len(out)):
        if out[i][:1].isascii() and out[i][:1].isalpha():
            clean = all(_blank(p) or p in ",;:)]" for p in pieces[last + 1 : i])
            out[i] = out[i][0].upper() + out[i][1:] if clean else out[i]
            return


def rewrite_refs_column(prose: Column, papers: dict[int, str], clusters: dict[int, str], document: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: rewrite_refs(x, papers, clusters, known_refs(x, papers, clusters) if document else 0))

    return run(prose)

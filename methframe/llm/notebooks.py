"""Cells of notebooks in their three textual forms."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_CELL = re.compile(r'\{\s*"cell_type"')
_SOURCE = re.compile(r'"source":\s*')
_PERCENT = re.compile(r"(?m)^# %%")
_HASH = re.compile(r"(?m)^# ?")
_PROMPT = re.compile(r"(?m)^((?:In|Out) ?\[[^\]\n]*\]:)")
_FENCE = re.compile(r"\s*```\w*\n(.*?)(?:```|\Z)(.*)", re.S)
_BLANK = re.compile(r"\n[ \t]*\n")
_DECODER = json.JSONDecoder()


def _joined(source) -> str:
    return "".join(s for s in source if isinstance(s, str)) if isinstance(source, list) else source if isinstance(source, str) else ""


def _of_json(text: str) -> Iterator[tuple[str, str]]:
    try:
        whole = json.loads(text)
        for cell in whole["cells"]:
            yield str(cell.get("cell_type")), _joined(cell.get("source"))
        return
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        pass
    at = 0  # cut off or damaged: cell by cell, as far as they go
    while m := _CELL.search(text, at):
        at = m.end()
        try:
            cell, at = _DECODER.raw_decode(text, m.start())
            yield str(cell.get("cell_type")), _joined(cell.get("source"))
        except (ValueError, RecursionError):
            kind = "markdown" if '"markdown"' in text[m.end() : m.end() + 20] else "code"
            if s := _SOURCE.search(text, at):
                try:
                    source, at = _DECODER.raw_decode(text, s.end())
                    yield kind, _joined(source)
                except (ValueError, RecursionError):
                    nearest = _CELL.search(text, s.end())
                    yield kind, text[s.end() : nearest.start() if nearest else len(text)].replace('\\n', "\n")


def _of_percent(text: str) -> Iterator[tuple[str, str]]:
    for block in _PERCENT.split(text)[1:]:
        head, _, body = block.partition("\n")
        yield ("markdown", _HASH.sub("", body)) if "markdown" in head else ("code", body)


def _paragraphs(text: str) -> Iterator[tuple[str, str]]:
    """The exported form keeps no borders between markdown cells but blank lines; a heading goes with what follows it."""
    head = ""
    for block in _BLANK.split(text):
        if not (block := block.strip()):
            continue
        if block.startswith("#") and "\n" not in block:
            head += block + "\n"
            continue
        yield "markdown", head + block
        head = ""
    if head:
        yield "markdown", head


def _of_export(text: str) -> Iterator[tuple[str, str]]:
    parts = _PROMPT.split(text)
    yield from _paragraphs(parts[0])
    for prompt, body in zip(parts[1::2], parts[2::2]):
        if prompt.startswith("Out"):  # an output ends at the first blank line
            output, *rest = _BLANK.split(body.strip("\n"), maxsplit=1)
            yield "output", output
            if rest:
                yield from _paragraphs(rest[0])
        elif m := _FENCE.match(body):
            yield "code", m.group(1)
            yield from _paragraphs(m.group(2))
        else:
            yield "code", body


def cells(text: str | None, form: str | None = None) -> Iterator[tuple[str, str]]:
    """(kind, source) of each cell; outputs of JSON notebooks are left out. Unknown forms are recognised by the text."""
    if not text:
        return iter(())
    if form not in ("ipynb", "py_percent", "md_export"):
        form = "ipynb" if text.lstrip()[:1] == "{" else "py_percent" if _PERCENT.search(text) else "md_export"
    return {"ipynb": _of_json, "py_percent": _of_percent, "md_export": _of_export}[form](text)

"""Markdown and HTML reports over small result tables."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field


def shown(value) -> str:
    """Three decimals for floats, a dash for nothing."""
    if value is None:
        return "-"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


def heading(text: str) -> str:
    """Words of an identifier as a sentence."""
    words = text.replace("_", " ").strip()
    return words[:1].upper() + words[1:]


def anchor(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


@dataclass
class Section:
    title: str
    text: str = ""
    columns: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, title: str, df, text: str = "", most: int = 200) -> Section:
        """A section over a result table; at most `most` of its rows are shown."""
        return cls(title, text, df.columns, [tuple(r) for r in df.limit(most).collect()])


@dataclass
class Report:
    title: str
    verdict: str = ""
    sections: list[Section] = field(default_factory=list)

    def markdown(self) -> str:
        out = [f"# {self.title}"] + ([f"**{self.verdict}**"] if self.verdict else [])
        for s in self.sections:
            out.append(f"## {s.title}")
            if s.text:
                out.append(s.text)
            if s.columns:
                head = ["| " + " | ".join(map(heading, s.columns)) + " |", "|" + "---|" * len(s.columns)]
                out.append("\n".join(head + ["| " + " | ".join(shown(v).replace("|", "\\|") for v in r) + " |" for r in s.rows]))
        return "\n\n".join(out) + "\n"

    def html(self) -> str:
        cell = lambda tag, v: f"<{tag}>{html.escape(v)}</{tag}>"
        out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(self.title)}</title><h1>{html.escape(self.title)}</h1>"]
        if self.verdict:
            out.append(f"<p><strong>{html.escape(self.verdict)}</strong></p>")
        out.append("<ul>" + "".join(f'<li><a href="#{anchor(s.title)}">{html.escape(s.title)}</a></li>' for s in self.sections) + "</ul>")
        for s in self.sections:
            out.append(f'<h2 id="{anchor(s.title)}">{html.escape(s.title)}</h2><p>{html.escape(s.text)}</p>')
            if s.columns:
                body = "".join("<tr>" + "".join(cell("td", shown(v)) for v in r) + "</tr>" for r in s.rows)
                out.append("<table><tr>" + "".join(cell("th", heading(c)) for c in s.columns) + f"</tr>{body}</table>")
        return "".join(out)


def roll_up(verdicts: list[str]) -> str:
    """FAIL if any does, PASS if all do, else WARN."""
    return "FAIL" if "FAIL" in verdicts else "PASS" if verdicts and all(v == "PASS" for v in verdicts) else "WARN"
